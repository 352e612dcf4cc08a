"""Clashing column names, null ids and repeated rows in the pipeline's stages."""

import corpus_pipeline
from pyspark.sql import functions as F

from typeahead.llm import exact_dedup, phrase_index
from typeahead.llm.common import stage

LONG = "the quick brown fox jumps over the lazy dog and runs far away from home every single day of the year"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["bad_id", "bad_h", "kept_id", "kept_key", "row_key", "__key", "id", "key", "h", "doc", "pos", "tid", "term", "len",
           "prefix", "part", "sha", "tie"]


def clashing(df):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


def test_null_ids_with_equal_short_hashes(spark):
    # the two texts have one 32-bit hash; only the first is the item
    docs = spark.createDataFrame([(None, "alpha beta n92311"), (None, "alpha beta n196285")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta n92311")], "item_id long, text string")
    hashes = [r[0] for r in docs.select(F.hash("text")).collect()]
    assert hashes[0] == hashes[1]
    got = sorted((r.n_hit, r.contaminated) for r in phrase_index.contamination(docs, items).collect())
    assert got == [(0, False), (3, True)]
    assert [r.text for r in phrase_index.drop_contaminated(docs, items).collect()] == ["alpha beta n196285"]


def test_clashing_columns(spark):
    docs = clashing(spark.createDataFrame([(1, LONG), (2, LONG.upper()), (3, "other"), (None, LONG), (None, None)],
                                          "doc_id long, text string"))
    items = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    left = phrase_index.drop_contaminated(docs, items)
    assert left.columns == docs.columns and sorted(map(str, left.collect())) == sorted(
        str(r) for r in docs.collect() if (r.text or "").lower() != LONG)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {2, 3, None}
    assert all(r[c] == i for r in left.collect() for i, c in enumerate(CLASHES))


def test_stages_on_odd_tables(spark, sf):
    """Null ids, repeated rows and an empty table go through every stage."""
    near = LONG.replace("lazy", "very lazy")
    rows = [(1, LONG * 3, "en", "s", 1), (1, LONG * 3, "en", "s", 1), (2, (LONG * 3).upper(), "en", "s", 1),
            (None, near * 9, "en", None, None), (None, None, None, None, None), (None, "", "en", "s", 0), (7, "!!", None, "s", 2)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, COLUMNS).repartition(2)
        for name, step in corpus_pipeline.STAGES:
            docs = stage(step(spark, docs, sf), name)
            if name == "packing":
                assert "sequence_id" in docs.columns
            else:
                assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        got = docs.collect()
        assert bool(got) == bool(table)
        # one of the three copies stays, and the row without an id
        assert len({r.doc_id for r in got}) == len({(r.doc_id, r.doc_tokens) for r in got}) <= 2
