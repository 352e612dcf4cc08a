"""DuckDB SQL fragments mirroring the Spark expressions, for oracle queries."""

from __future__ import annotations

from ..functions.text import CLEAN_DROP, EDGE_WS, WORD_TOKEN, WS_RUN


def strip(x: str) -> str:
    return f"regexp_replace({x}, '{EDGE_WS}', '', 'g')"


def norm(x: str) -> str:
    """T1 in DuckDB."""
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '{WS_RUN}', ' ', 'g'))"


def clean(x: str) -> str:
    """T2 in DuckDB."""
    return strip(f"regexp_replace({norm(x)}, '{CLEAN_DROP}', '', 'g')")


def ngrams_of(t: str, n: int = 3) -> str:
    return (f"(CASE WHEN length({t}) = 0 THEN []::VARCHAR[] WHEN length({t}) < {n} THEN [{t}] "
            f"ELSE list_transform(range(1, length({t}) - {n - 2}), lambda i: substr({t}, i, {n})) END)")


def char_ngrams(x: str, n: int = 3) -> str:
    """T3 in DuckDB (prepared text inlined; fine for short strings)."""
    return ngrams_of(strip(f"lower(coalesce({x}, ''))"), n)


def grams_table(src: str, keys: str, x: str, n: int = 3, out: str = "grams") -> str:
    """``SELECT keys, grams`` with the prepared text computed once per row."""
    t = "__t"
    return (f"(SELECT {keys}, {ngrams_of(t, n)} AS {out} FROM "
            f"(SELECT {keys}, {strip(f'lower(coalesce({x}, ' + chr(39) * 2 + '))')} AS {t} FROM {src}))")


def word_tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{WORD_TOKEN}')"


def md5_int(x: str) -> str:
    return f"CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT)"
