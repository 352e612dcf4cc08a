"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

The index stores a posting (document, position, term) for every training word that occurs
in any benchmark item, and an end-of-document posting whose position is the document's word
count.  A segment keeps the order in which words are met, so its document columns compress
to runs and nothing is sorted; terms are numbers, and joins with a list of terms find theirs.  An item is matched window by window:

1. the window's rarest term (by training count) proposes alignments, position minus offset;
2. the postings of the second rarest term, adjusted by their offset, are intersected;
3. surviving alignments are intersected with the postings of all the item's words, and runs
   of consecutive matches at least one window long are hits.

Every window contains its rarest terms, so no match is lost, and only rare lists are ever
expanded.  An item with fewer words than a window is one window.

Null or empty text has no words (documents: zero counts; items: no window).  Rows that
repeat an item id add up under that id, a null item id counts as an empty one; rows that
repeat a document each get the same result.  Ids of documents are whole numbers or null; a
document is told apart by its id and 64 bits of its text's hash.  Empty tables give empty or
all-zero results; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import lower_ascii, stage, table, unused
from .queries import register

# The bytes between words once A-Z is lower-cased.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DOC = ["doc", "h"]  # a document: its id and a hash of its text
ALIGNED = [*DOC, "k", "delta"]


def words(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    # in a text of one-byte characters the library's lower-casing meets A-Z alone, and is faster
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(lower_ascii(text))
    return F.array_remove(F.split(low, BETWEEN_WORDS), "")


class PhraseIndex(NamedTuple):
    postings: DataFrame  # doc_id, doc, h, pos, tid
    ends: DataFrame      # doc_id, doc, h, n_words: one row per document row
    items: DataFrame     # k, item_id, n, q, tid, f (training count, null: never seen)


def build_index(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                item_col: str = "item_id", item_text_col: str = "text") -> PhraseIndex:
    bench = stage(items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"),
                               words(F.col(item_text_col)).alias("ws"))
                  .filter(F.size("ws") > 0).distinct()
                  .withColumn("k", F.monotonically_increasing_id()), "items")
    item_words = bench.select("k", "item_id", F.size("ws").alias("n"), F.posexplode("ws").alias("q", "term"))
    end = docs.sparkSession.range(1).select(F.lit("").alias("term"))  # no word is empty
    vocab = stage(item_words.select("term").distinct().union(end)
                  .withColumn("tid", F.monotonically_increasing_id()), "terms")

    text = F.col(text_col)
    tokens = docs.select(F.col(id_col).alias("doc_id"),
                         F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("doc"),
                         F.xxhash64(text).alias("h"),
                         F.posexplode(F.concat(words(text), F.array(F.lit("")))).alias("pos", "term"))
    # vocab was written, so Spark knows its size: broadcast below the threshold, else shuffled
    stored = stage(tokens.join(vocab, "term").drop("term"), "postings")
    end_id = vocab.filter("term = ''").first()["tid"]
    postings = stored.filter(F.col("tid") != end_id)
    ends = stored.filter(F.col("tid") == end_id).select("doc_id", *DOC, F.col("pos").cast("long").alias("n_words"))
    counts = stage(postings.groupBy("tid").agg(F.count("*").alias("f")), "term-counts")
    placed = stage(item_words.join(vocab, "term").join(counts, "tid", "left")
                   .select("k", "item_id", "n", "q", "tid", "f"), "item-words")
    return PhraseIndex(postings, ends, placed)


def phrase_runs(index: PhraseIndex, window: int = 10) -> DataFrame:
    """doc, h, item_id, start, length: maximal runs of matched words, each a window or more."""
    ahead = Window.partitionBy("k").orderBy("q").rowsBetween(0, window - 1)
    need = F.least(F.lit(window), F.col("n"))
    ranked = F.array_sort(F.collect_list(F.struct("f", "q", "tid")).over(ahead))
    anchors = stage(index.items.withColumn("seen", F.count("f").over(ahead)).withColumn("r", ranked)
                    .filter((F.col("q") <= F.col("n") - need) & (F.col("seen") == need))
                    .select("k", F.col("r")[0]["tid"].alias("tid"), F.col("r")[0]["q"].alias("q"),
                            F.get("r", F.lit(1))["tid"].alias("tid2"), F.get("r", F.lit(1))["q"].alias("q2"))
                    .distinct(), "anchors")
    posts = index.postings.select(*DOC, "pos", "tid")

    first = stage(posts.join(anchors, "tid").select(
        *DOC, "k", (F.col("pos") - F.col("q")).alias("delta"), F.col("tid2").alias("tid"), "q2"),
        "alignments")
    second_terms = stage(anchors.select(F.col("tid2").alias("tid")).dropna().distinct(), "second-terms")
    both = (first.dropna(subset=["tid"]).withColumn("pos", (F.col("q2") + F.col("delta")).cast("int"))
            .join(posts.join(second_terms, "tid", "left_semi").hint("merge"), [*DOC, "pos", "tid"]).select(*ALIGNED))
    alone = first.filter("tid IS NULL").select(*ALIGNED)  # windows of one word
    aligned = stage(both.union(alone).distinct(), "aligned")

    expected = stage(aligned.join(index.items.drop("f"), "k").select(
        *ALIGNED, "item_id", "n", "q", "tid", (F.col("q") + F.col("delta")).cast("int").alias("pos")),
        "expected")
    matched = (posts.join(expected.hint("merge"), [*DOC, "pos", "tid"])
               .select(*ALIGNED, "item_id", "n", "q").distinct())
    order = Window.partitionBy(*ALIGNED).orderBy("q")
    return (matched.withColumn("island", F.col("q") - F.row_number().over(order))
            .groupBy(*ALIGNED, "item_id", "n", "island")
            .agg(F.min("q").alias("q"), F.count("*").alias("length"))
            .filter(F.col("length") >= need)
            .select(*DOC, "item_id", (F.col("q") + F.col("delta")).alias("start"), "length"))


def proximity_matches(index: PhraseIndex, distance: int = 10) -> DataFrame:
    """doc_id, item_id, pos, pos2: the item's two rarest words at most ``distance`` words
    apart in a document.  Positions meet in strips of ``distance`` words, so each posting
    is compared with its own and the two neighbouring strips only."""
    rank = Window.partitionBy("k").orderBy("f", "q")
    rare = (index.items.dropna(subset=["f"]).dropDuplicates(["k", "tid"])
            .withColumn("r", F.row_number().over(rank)).filter("r <= 2")
            .groupBy("k", "item_id").agg(F.max(F.when(F.col("r") == 1, F.col("tid"))).alias("tid"),
                                         F.max(F.when(F.col("r") == 2, F.col("tid"))).alias("tid2")))
    rare = stage(rare.dropna(subset=["tid2"]), "rare-terms")
    posts = index.postings.select("doc_id", *DOC, "pos", "tid")
    strip = F.floor(F.col("pos") / distance)
    left = (posts.join(rare, "tid").withColumn("strip", F.explode(F.array(strip - 1, strip, strip + 1)))
            .select("doc_id", *DOC, "strip", "item_id", "pos", F.col("tid2").alias("tid")))
    right = posts.select(*DOC, strip.alias("strip"), "tid", F.col("pos").alias("pos2"))
    return (left.join(right, [*DOC, "strip", "tid"])
            .filter(F.abs(F.col("pos") - F.col("pos2")) <= distance)
            .select("doc_id", "item_id", "pos", "pos2").distinct())


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """One row per document row: id, n_words, n_hit, n_items, items_sha256, contaminated, h
    (the hash of the text that tells rows with one id apart)."""
    index = build_index(docs, items, id_col, text_col, item_col, item_text_col)
    runs = stage(phrase_runs(index, window), "runs")
    last = F.col("start") + F.col("length") - 1
    hit = (runs.select(*DOC, F.explode(F.sequence(F.col("start"), last)).alias("pos")).distinct()
           .groupBy(*DOC).agg(F.count("*").alias("n_hit")))
    found = (runs.select(*DOC, "item_id").distinct()
             .groupBy(*DOC).agg(F.sort_array(F.collect_list("item_id")).alias("found")))
    hits = stage(hit.join(found, DOC), "hits")
    none = F.array().cast("array<string>")
    return (index.ends.join(hits, DOC, "left")
            .withColumn("found", F.coalesce("found", none))
            .select(F.col("doc_id").alias(id_col), "n_words",
                    F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.size("found").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", "found").cast("binary"), 256).alias("items_sha256"),
                    F.col("n_hit").isNotNull().alias("contaminated"), "h"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a window of any item, columns unchanged."""
    bad = stage(contamination(docs, items, window, id_col, text_col).filter("contaminated")
                .select(F.col(id_col).alias("id"), "h").distinct(), "contaminated")
    id_, h = unused(docs, "bad_id"), unused(docs, "bad_h")
    same = F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(text_col)) == F.col(h))
    return docs.join(bad.toDF(id_, h).hint("merge"), same, "left_anti")


@register("op7_phrase_index", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bl AS (SELECT item_id, ws, least(10, len(ws)) AS l FROM b WHERE len(ws) > 0),
bs AS (SELECT item_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS s FROM bl),
bw AS (SELECT DISTINCT item_id, l, array_to_string(ws[s:s + l - 1], ' ') AS gram FROM bs),
dp AS (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS p
       FROM d, (SELECT DISTINCT l FROM bl) WHERE len(ws) >= l),
dw AS (SELECT doc_id, p, l, array_to_string(ws[p:p + l - 1], ' ') AS gram FROM dp),
hit AS (SELECT doc_id, p, l, item_id FROM dw JOIN bw USING (l, gram)),
pos AS (SELECT doc_id, count(DISTINCT x) AS n_hit
        FROM (SELECT doc_id, unnest(range(p, p + l)) AS x FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
       FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)""")
def op7(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h")
