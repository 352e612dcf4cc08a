"""Pair features, labelled rows and splits.

Every feature is a column expression over a ``(prefix, candidate)`` row;
vectors come from joining the stored embedding tables, never re-encoding
per pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import md5_int
from ..session import cut, reuse
from . import dense as D
from .ranking import join_null_safe

# The feature names.
POPULARITY_COLUMNS = ["orders", "volume", "catalog_clicks", "catalog_views"]
BASE_FEATURES = ["cosine_similarity", "bm25_score", "prefix_length", "candidate_length", "length_ratio",
                 "prefix_in_candidate", "candidate_starts_with_prefix", "char_overlap", "char_jaccard"]
FEATURE_COLUMNS = BASE_FEATURES + [f"popularity_{c}" for c in POPULARITY_COLUMNS]


def pair_length_features(p="prefix", c="candidate") -> list:
    """M1: lengths and ``len(prefix) / max(len(candidate), 1)``."""
    return [F.length(p).alias("prefix_length"), F.length(c).alias("candidate_length"),
            (F.length(p) / F.greatest(F.length(c), F.lit(1))).alias("length_ratio")]


def pair_containment(p="prefix", c="candidate") -> list:
    """M2: case-insensitive containment and prefix test as 0/1."""
    lp, lc = F.lower(F.col(p)), F.lower(F.col(c))
    return [lc.contains(lp).cast("int").alias("prefix_in_candidate"),
            lc.startswith(lp).cast("int").alias("candidate_starts_with_prefix")]


def _charset(x):
    return F.filter(F.array_distinct(F.split(F.lower(F.col(x)), "")), lambda ch: ch != "")


def pair_char_overlap(df: DataFrame, p="prefix", c="candidate") -> DataFrame:
    """M3: shared distinct characters and their Jaccard (union at least 1)."""
    df = df.withColumn("__pc", _charset(p)).withColumn("__cc", _charset(c))
    inter = F.size(F.array_intersect("__pc", "__cc"))
    union = F.size(F.array_union("__pc", "__cc"))
    return (df.withColumn("char_overlap", inter)
            .withColumn("char_jaccard", inter / F.greatest(union, F.lit(1)))
            .drop("__pc", "__cc"))


def pair_popularity_features(df: DataFrame, features: DataFrame, cols=POPULARITY_COLUMNS) -> DataFrame:
    """M4: ``popularity_<col>`` by raw candidate text, 0 when absent."""
    from .candidates import popularity_lookup
    f = features.select("query", *[F.col(c).cast("double").alias(c) for c in cols])
    return popularity_lookup(df, f, cols)


def pair_features(cands: DataFrame, prefix_emb: DataFrame, cand_emb: DataFrame,
                  features: DataFrame) -> DataFrame:
    """M5: the full feature row for each ``(prefix, candidate)``.

    ``prefix_emb(prefix, pvec)`` and ``cand_emb(candidate, cvec)`` are the
    stored vectors; popularity comes from the feature table.
    """
    j = cands.join(prefix_emb, "prefix", "left").join(cand_emb, "candidate", "left")
    j = j.select("*", *pair_length_features(), *pair_containment(),
                 D.cosine_similarity("pvec", "cvec").alias("cosine_similarity"))
    j = pair_char_overlap(j)
    j = pair_popularity_features(j, features)
    return j.drop("pvec", "cvec")


def align_features(df: DataFrame, names: list[str], keep: list[str] | None = None) -> DataFrame:
    """The model's feature columns in order; absent ones as 0.0."""
    have = set(df.columns)
    cols = [(F.col(n).cast("double") if n in have else F.lit(0.0)).alias(n) for n in names]
    return df.select(*(keep or []), *cols).na.fill(0.0, names)


def number_repeats(counted: DataFrame, keys: list[str], n: str, step: int = 1000) -> DataFrame:
    """One row per repetition, numbered ``occ`` from 0, of rows that come with their number
    ``n``; other columns go along.

    Large numbers are dealt out in steps, so that a hot row is numbered by many tasks."""
    rest = [c for c in counted.columns if c != n]
    d = counted.select(*rest, F.col(n).alias("_n"), F.explode(F.expr(f"sequence(0, ({n} - 1) div {step})")).alias("_part"))
    d = d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_part")
    return d.select(*rest, F.explode(F.expr(
        f"sequence(_part * {step}, least((_part + 1) * {step}, _n) - 1)")).alias("occ"))


def occurrences(rows: DataFrame, keys: list[str], step: int = 1000) -> DataFrame:
    """One row per repetition of equal keys, numbered ``occ`` from 0."""
    return number_repeats(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys, "_n", step)


def hash_order(cands: DataFrame, seed: int = 42) -> DataFrame:
    """``(prefix, candidate, pos)``: the candidates of each prefix, at most its list, in a
    seeded hash order from 0.  Written, so that joins with it are planned by its size."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), "prefix", "candidate"))
    w = Window.partitionBy("prefix").orderBy(h, F.col("candidate"))
    return cut(cands.select("prefix", "candidate").withColumn("pos", F.row_number().over(w) - 1))


def add_draw_bounds(pairs: DataFrame, ranked: DataFrame) -> DataFrame:
    """Adds to ``(prefix, query, ...)`` rows what a draw has to know: the number of the prefix's
    candidates (``_size``) and the positions that hold the true query or no text (``_own``).
    Rows whose prefix has no candidates, or without a query, are left out."""
    sizes = ranked.groupBy("prefix").agg(
        F.count(F.lit(1)).alias("_size"), F.collect_list(F.when(F.col("candidate").isNull(), F.col("pos"))).alias("_void"))
    own = (ranked.where(F.col("candidate").isNotNull()).withColumnRenamed("candidate", "query")
           .groupBy("prefix", "query").agg(F.collect_list("pos").alias("_at")))
    j = pairs.where(F.col("query").isNotNull()).join(sizes, "prefix").join(own, ["prefix", "query"], "left")
    none = F.array().cast("array<int>")
    return j.withColumn("_own", F.concat("_void", F.coalesce("_at", none))).drop("_void", "_at")


def draw_negatives(rows: DataFrame, ids: list[str], seed: int = 42, n_min: int = 5, n_max: int = 10,
                   times=None) -> DataFrame:
    """``ids`` and ``drawn``, the positions that each row of ``add_draw_bounds`` draws: of a run of
    ``n_max + 1`` from a hash of the row, the first ``n_min + hash % (n_max-n_min+1)`` that do not
    hold the true query.  Row by row, nothing is shuffled; ``times``: a column of how often the run
    reads each position."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids])
    p = rows.withColumn("_want", (F.lit(n_min) + md5_int(key) % (n_max - n_min + 1)).cast("int")).withColumn(
        "_start", md5_int(F.concat(key, F.lit("|start"))) % F.col("_size"))
    # named twice outside the lambda, the hash is not moved into it
    run = F.transform(F.sequence("_start", F.col("_start") + F.least(F.lit(n_max).cast("long"), F.col("_size") - 1)),
                      lambda at: (at % F.col("_size")).cast("int"))
    run = F.filter(run, lambda at: ~F.array_contains("_own", at))
    if times is not None:
        run = F.flatten(F.transform(run, lambda at: F.array_repeat(at, times.cast("int"))))
    return p.select(*ids, F.slice(run, F.lit(1), F.col("_want")).alias("drawn"))


def _each_drawn(drawn: DataFrame, *keep: str) -> DataFrame:
    # explode would push a size filter that draws once more
    return drawn.select(*keep, F.explode_outer("drawn").alias("pos")).where(F.col("pos").isNotNull())


def sample_negatives(pairs: DataFrame, cands: DataFrame, seed: int = 42,
                     n_min: int = 5, n_max: int = 10, repeats: str | None = None) -> DataFrame:
    """H2: for each ``(prefix, query)`` row, ``n_min + hash % (n_max-n_min+1)``
    distinct candidates of the prefix other than the true query.  With a column
    ``occ``, the number of a pair's repetition, or one named by ``repeats``, how often
    it repeats, every repetition draws its own.

    The candidates of a prefix are put in a seeded hash order once (a window
    over at most the prefix's candidate list).  Each pair then draws from a run
    of ``n_max + 1`` consecutive positions starting at a hash of the pair.  Where
    its true query stands is joined to it before, so the draw needs no window and no
    pair is combined with more than the candidates it draws, by an equi-join on
    ``(prefix, position)``.  A pair whose prefix has no candidate but the true query
    yields nothing.
    """
    ranked = hash_order(cands, seed)
    ids, times = ["prefix", "query"], None
    if repeats:
        rows = number_repeats(add_draw_bounds(pairs.select(*ids, repeats), ranked), ids, repeats)
    elif "occ" in pairs.columns:
        rows = add_draw_bounds(pairs, ranked)
    else:  # equal pairs draw together
        rows = add_draw_bounds(pairs.groupBy(*ids).agg(F.count(F.lit(1)).alias("_times")), ranked)
        times = F.col("_times")
    if times is None:
        ids = [*ids, "occ"]
    drawn = draw_negatives(rows, ids, seed, n_min, n_max, times)
    return _each_drawn(drawn, *ids).join(ranked, ["prefix", "pos"]).select(*ids, "candidate")


def count_negatives(pairs: DataFrame, cands: DataFrame, repeats: str, seed: int = 42,
                    n_min: int = 5, n_max: int = 10) -> tuple[DataFrame, DataFrame]:
    """What ``sample_negatives`` draws for pairs that repeat, as ``(prefix, candidate,
    repeats)`` counts, and the pairs that drew any.

    Draws are counted by position where they are drawn, so neither a repetition nor a draw
    is shuffled.  A run longer than a pair's own positions holds a negative, so only other
    pairs draw once more to be known."""
    ranked = hash_order(cands, seed)
    ids = ["prefix", "query", "occ"]
    bounds = add_draw_bounds(pairs.select(*ids[:2], repeats), ranked)

    def draw(rows):
        return draw_negatives(number_repeats(rows, ids[:2], repeats), ids, seed, n_min, n_max)

    met = _each_drawn(draw(bounds), "prefix").groupBy("prefix", "pos").agg(F.count(F.lit(1)).alias(repeats))
    negatives = met.join(ranked, ["prefix", "pos"]).groupBy("prefix", "candidate").agg(F.sum(repeats).alias(repeats))
    sure = F.size("_own") < F.least(F.lit(n_max + 1).cast("long"), F.col("_size"))
    unsure = draw(bounds.where(~sure & (F.size("_own") < F.col("_size")))).where(F.size("drawn") > 0)
    return negatives, bounds.where(sure).select(*ids[:2]).unionByName(unsure.select(*ids[:2])).distinct()


def stratified_split(df: DataFrame, key: str, seed: int = 42, valid_share: float = 0.2,
                     out: str = "is_valid", label: str = "target") -> DataFrame:
    """H3: validation flag for exactly ``valid_share`` (rounded) of each label's rows,
    the first by a seeded hash of the row key.

    Rows are counted per label and hash bucket (at most 65,536 a label); the counts give
    each bucket's offset and a window inside the bucket the rest of the rank.
    """
    u = md5_int(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    df = reuse(df.withColumn("_u", u).withColumn("_b", F.shiftright("_u", 16)))
    n = df.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy(label)
    before = by.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = n.select(label, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                   F.floor(F.sum("_n").over(by) * valid_share + 0.5).alias("_want"))
    rank = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_u", key)) + F.col("_off")
    return join_null_safe(df, off, [label, "_b"]).withColumn(out, rank <= F.col("_want")) \
        .drop("_u", "_b", "_off", "_want")
