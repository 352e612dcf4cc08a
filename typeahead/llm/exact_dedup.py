"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after lower-casing A-Z; null counts as empty.  Rows are
grouped by length and prefix hash on narrow rows.  A second scan hashes whole texts where
they lie, for the rows whose (length, prefix hash) group has two members or more (a bitmap of
those groups, of bounded size, picks them in the scan; the few others it lets through drop
out by an exact join on narrow rows).  No text is shuffled to find copies, and only the texts
of rows with a dropped copy are to remove them.  Of equal texts the row with the largest id
stays; of rows that repeat both id and text one stays.  A null id is the smallest.  An empty
table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import key_filter, lower_ascii, stage, table, text_key, unused
from .queries import register


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                prefix_chars: int = 64, digest_singles: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    text_sha256 is null for rows that the first two passes prove unique, unless
    ``digest_singles`` asks for it; every text is then hashed in the first scan.
    """
    return (decide(docs, id_col, text_col, prefix_chars, digest_singles).drop("key")
            .withColumnRenamed("id", id_col))


def decide(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int = 64,
           digest_singles: bool = False) -> DataFrame:
    """The rows of :func:`exact_dedup`, with the text's key."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(lower_ascii(text).cast("binary"), 256).alias("sha")
    keys = [F.col(id_col).alias("id"), text_key(text_col).alias("key"), F.octet_length(text).alias("len"),
            F.xxhash64(lower_ascii(F.substring(text, 1, prefix_chars))).alias("prefix")]
    narrow = stage(docs.select(*keys, *([digest] if digest_singles else [])), "dedup-keys")

    # counts are combined before any shuffle, and written, so that the joins below have a
    # shuffle of their own on both sides, which a hot key's partition can be split out of
    pairs = stage(narrow.groupBy("len", "prefix").agg(F.count("*").alias("n")), "dedup-prefixes")
    lengths = stage(pairs.groupBy("len").agg(F.sum("n").alias("rows")).filter("rows > 1")
                    .select("len"), "dedup-lengths")
    shared = stage(pairs.join(lengths, "len", "left_semi").filter("n > 1")
                   .select("len", "prefix"), "dedup-shared")
    if digest_singles:
        hashed = narrow
    else:
        group = F.xxhash64("len", "prefix")
        rows = docs.select(*keys, text.alias("text"))
        hashed = (key_filter(shared, group, "dedup-filter").mark(rows, group, "maybe").filter("maybe")
                  .select("id", "key", "len", "prefix", F.sha2(lower_ascii(F.col("text")).cast("binary"), 256).alias("sha")))
        hashed = stage(hashed, "dedup-digests")
    multi = stage(hashed.join(shared, ["len", "prefix"], "left_semi")
                  .withColumn("tie", F.monotonically_increasing_id()), "dedup-survivors")
    groups = stage(multi.groupBy("len", "sha").agg(F.count("*").alias("n"),
                                                   F.max(F.struct("id", "tie")).alias("keep")),
                   "dedup-groups")
    grouped = multi.join(groups, ["len", "sha"]).select(
        "id", "key", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("keep.tie") == F.col("tie")).alias("kept"), F.col("sha").alias("text_sha256"))
    singles = narrow.join(shared, ["len", "prefix"], "left_anti").select(
        "id", "key", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), (F.col("sha") if digest_singles else F.lit(None).cast("string")).alias("text_sha256"))
    return grouped.unionByName(singles)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops, columns unchanged."""
    found = decide(docs, id_col, text_col).filter("group_size > 1")
    # ids and keys of dropped rows; where rows repeat both, one of them may have to stay
    bad = stage(found.groupBy("id", "key").agg(F.max(F.col("kept").cast("int")).alias("stay"),
                                               F.count("*").alias("n"))
                .filter("n > stay"), "dedup-dropped")
    maybe, key = unused(docs, "maybe_dropped"), unused(docs, "row_key")
    row = F.xxhash64(F.col(id_col), F.col(key))
    marked = key_filter(bad, F.xxhash64("id", "key"), "dedup-dropped-filter").mark(
        docs.withColumn(key, text_key(text_col)), row, maybe)
    clear = marked.filter(~F.col(maybe)).select(*docs.columns)
    named = {c: unused(docs, "dropped_" + c) for c in ("id", "key", "stay", "n")}
    bad = bad.select(*[F.col(c).alias(named[c]) for c in named])
    same = F.col(id_col).eqNullSafe(F.col(named["id"])) & (F.col(key) == F.col(named["key"]))
    # a merge join at every size: the dropped rows grow with the table
    met = marked.filter(F.col(maybe)).join(bad.hint("merge"), same, "left")
    other = met.filter(F.col(named["n"]).isNull()).select(*docs.columns)
    one = met.filter(F.col(named["stay"]) == 1).dropDuplicates([id_col, key]).select(*docs.columns)
    return clear.unionByName(other).unionByName(one)


@register("op10_exact_dedup", """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)""")
def op10(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"), digest_singles=True)
