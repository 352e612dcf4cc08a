"""Training-corpus pipeline: language ID, exact dedup, near-dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps, with all their
columns; the last returns the packed pieces.  Each stage is written as Parquet and read
back before the next, so a lost executor costs its own tasks, not the stages before.
"""

from __future__ import annotations

from typeahead.llm import binpack, crf_langid, exact_dedup, phrase_index, simhash_vp
from typeahead.llm.common import stage, table


def identify_language(spark, docs, sf_dir):
    """Drops texts without letters and texts of no clear language."""
    return crf_langid.drop_unidentified(docs)


def drop_exact_copies(spark, docs, sf_dir):
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each SimHash component stays."""
    return simhash_vp.one_per_component(docs, shingle=4, max_bits=4)


def drop_benchmark_passages(spark, docs, sf_dir):
    """Drops documents that hold ten consecutive words of a benchmark item."""
    return phrase_index.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark, docs, sf_dir):
    return binpack.pack_documents(docs, binpack.tokenizer_file())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("packing", pack),
]

# language ID, fingerprints and packing have no SQL form: tests compare with brute force
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
