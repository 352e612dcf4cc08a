"""Registered queries: sources and sinks.

Each writer query writes into the shared checkpoint folder and returns what
it reads back, so the round trip itself is what gets checked.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources import sinks as SK
from ..sources.tables import load_inputs, table_profile
from . import sqlfrag as S
from . import track_a as TA
from .q_prefix import _TA, _cascade
from .registry import register


def _scratch(spark, name):
    return scratch_path(spark, f"io/{name}-{uuid.uuid4().hex[:12]}")


def _submission(spark, d):
    """The cascade's lists: top 150 queries for every test row."""
    return TA.submission(fx.fx_test(spark, d), _cascade(spark, d)[1])


_SUB_SQL = _TA + f"""
, lists AS (SELECT prefix_clean, list(query_clean ORDER BY rank) AS l FROM ranked GROUP BY 1),
sub AS (SELECT coalesce(t.prefix, '') AS prefix, coalesce(l, []::VARCHAR[]) AS l
        FROM fx_test t LEFT JOIN lists ON lists.prefix_clean = {S.norm('t.prefix')})
"""


@register("load_tables", fx.with_fx("fx_train", "fx_test", "fx_query_features", "fx_pool") + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS n_rows, CAST({n} AS BIGINT) AS n_cols FROM {v}"
    for t, v, n in (("train", "fx_train", 2), ("test", "fx_test", 1),
                    ("features", "fx_query_features", 5), ("pool", "fx_pool", 1))))
def q_load_tables(spark, d):
    base = _scratch(spark, "inputs")
    paths = {}
    for name, df in fx.inputs(spark, d).items():
        p = os.path.join(base, name)
        df.write.mode("overwrite").parquet(p)
        paths[name] = p
    return table_profile(load_inputs(spark, paths))


@register("write_submission_parquet", _SUB_SQL
          + "SELECT prefix, CAST(len(l) AS INT) AS n_items, array_to_string(l, '|') AS items FROM sub")
def q_write_submission_parquet(spark, d):
    p = _scratch(spark, "submission_parquet")
    SK.write_submission_parquet(_submission(spark, d), p)
    back = spark.read.parquet(p)
    return back.select("prefix", F.size("retrieved_queries").alias("n_items"),
                       F.array_join("retrieved_queries", "|").alias("items"))


@register("write_submission_csv_json", _SUB_SQL
          + "SELECT prefix, CAST(to_json(l) AS VARCHAR) AS retrieved_queries FROM sub")
def q_write_submission_csv_json(spark, d):
    p = _scratch(spark, "submission_csv")
    SK.write_submission_csv_json(_submission(spark, d), p)
    back = (spark.read.option("header", True).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .schema("prefix string, retrieved_queries string").csv(p))
    return back.select(F.coalesce("prefix", F.lit("")).alias("prefix"), "retrieved_queries")


@register("format_submission_delimited", _SUB_SQL
          + "SELECT prefix, coalesce(array_to_string(l, ','), '') AS retrieved_queries FROM sub")
def q_format_submission_delimited(spark, d):
    return SK.format_submission_delimited(_submission(spark, d))


@register("submission_inspection", _SUB_SQL
          + "SELECT prefix, array_to_string(l[1:10], '|') AS top_10_queries, CAST(len(l) AS INT) AS num_queries FROM sub")
def q_submission_inspection(spark, d):
    s = SK.submission_inspection(_submission(spark, d))
    return s.select("prefix", F.array_join("top_10_queries", "|").alias("top_10_queries"), "num_queries")


def _m6_oracle():
    from .q_features import _m6_select_sql
    return _m6_select_sql()


@register("write_training_table", _m6_oracle())
def q_write_training_table(spark, d):
    from . import track_c as TC
    from ..operators.features import FEATURE_COLUMNS
    ins = fx.inputs(spark, d)
    ds = TC.reranking_dataset(ins["train"], ins["pool"], ins["features"])
    p = _scratch(spark, "training_table")
    SK.write_training_table(ds, p, FEATURE_COLUMNS)
    from .q_features import _m6_select
    return _m6_select(spark.read.parquet(os.path.join(p, "parquet")))


@register("model_metadata")
def q_model_metadata(spark, d):
    """What is read back of a saved model's metadata and importance, one row per split."""
    from . import track_c as TC
    from ..operators.features import FEATURE_COLUMNS
    from .q_features import _model
    _, prep, model = _model(spark, d)
    p = _scratch(spark, "model")
    TC.save_model(model, p, FEATURE_COLUMNS, prep)
    _, meta = TC.load_model(p)
    n_csv = spark.read.option("header", True).csv(os.path.join(p, "feature_importance")).count()
    rows = [(meta["model_type"], meta["n_features"], meta["best_iteration"], len(meta["training_date"]) == 19, n_csv, split,
             m["n_rows"], m["auc"], m["accuracy"], m["f1"]) for split, m in sorted(meta["metrics"].items())]
    return spark.createDataFrame(rows, "model_type string, n_features int, best_iteration int, dated boolean, n_importances int, "
                                       "split string, n_rows long, auc double, accuracy double, f1 double")
