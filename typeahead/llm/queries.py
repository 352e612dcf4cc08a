"""Registry of the training-data queries: thin ``opN_<name>`` wrappers and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load() -> tuple[dict[str, Callable], dict[str, str]]:
    from . import (arc_to_warc, binpack, byte_shards, context_coder, crf_langid, exact_dedup,  # noqa: F401
                   gauss_quality, kneser_ney, merkle_octopus, phrase_index, simhash_vp, strata_search, tag_paths)
    return dict(QUERIES), dict(ORACLES)
