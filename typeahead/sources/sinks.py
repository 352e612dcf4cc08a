"""Sinks (S2-S6): submission and training-table writers.

All writers are plain ``DataFrameWriter`` jobs into a folder (one file per
task); nothing passes through the driver.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_submission_parquet(sub: DataFrame, path: str) -> None:
    """``prefix STRING, retrieved_queries ARRAY<STRING>`` as Parquet."""
    sub.select("prefix", "retrieved_queries").write.mode("overwrite").parquet(path)


def write_submission_csv_json(sub: DataFrame, path: str) -> None:
    """S3: list as a JSON string column, CSV with header and doubled quotes."""
    (sub.select("prefix", F.to_json("retrieved_queries").alias("retrieved_queries"))
     .write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def format_submission_delimited(sub: DataFrame, sep: str = ",") -> DataFrame:
    """List joined to one delimited string; null list -> ''."""
    return sub.select("prefix", F.coalesce(F.array_join("retrieved_queries", sep), F.lit(""))
                      .alias("retrieved_queries"))


def submission_inspection(sub: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` queries and the list size per prefix."""
    return sub.select("prefix", F.slice("retrieved_queries", 1, n).alias(f"top_{n}_queries"),
                      F.size("retrieved_queries").alias("num_queries"))


def write_training_table(ds: DataFrame, path: str, feature_names: list[str]) -> None:
    """Feature table to Parquet and CSV, feature-name list to text."""
    ds.write.mode("overwrite").parquet(os.path.join(path, "parquet"))
    ds.write.mode("overwrite").option("header", True).csv(os.path.join(path, "csv"))
    spark = ds.sparkSession
    spark.createDataFrame([(n,) for n in feature_names], "value string").coalesce(1) \
        .write.mode("overwrite").text(os.path.join(path, "feature_names"))
