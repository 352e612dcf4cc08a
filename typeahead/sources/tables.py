"""Table sources (S1): Parquet scans with declared schemas.

A scan only reads the columns and row groups the plan asks for: Catalyst
prunes columns into ``ReadSchema`` and pushes filters into the Parquet reader.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TRAIN_SCHEMA = T.StructType([T.StructField("prefix", T.StringType()),
                             T.StructField("query", T.StringType())])
TEST_SCHEMA = T.StructType([T.StructField("prefix", T.StringType())])
POOL_SCHEMA = T.StructType([T.StructField("query", T.StringType())])
FEATURES_SCHEMA = T.StructType([T.StructField("query", T.StringType()),
                                T.StructField("orders", T.LongType()),
                                T.StructField("volume", T.DoubleType()),
                                T.StructField("catalog_clicks", T.LongType()),
                                T.StructField("catalog_views", T.LongType())])

INPUT_SCHEMAS = {"train": TRAIN_SCHEMA, "test": TEST_SCHEMA,
                 "features": FEATURES_SCHEMA, "pool": POOL_SCHEMA}


def read_table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """One driver table, ``{d}/{name}.parquet``."""
    return spark.read.parquet(os.path.join(d, f"{name}.parquet"))


def load_inputs(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Read the four engine inputs from Parquet paths or globs.

    ``paths`` maps train/test/features/pool to a path.  The declared schema
    avoids a footer-inference pass over every file at 100 TB; extra numeric
    feature columns can be read by passing ``features`` as a plain scan.
    """
    out = {}
    for name, path in paths.items():
        schema = INPUT_SCHEMAS.get(name)
        reader = spark.read.schema(schema) if schema is not None else spark.read
        out[name] = reader.parquet(path)
    return out


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Row and column count per loaded table, as one small DataFrame."""
    from functools import reduce

    from pyspark.sql import functions as F
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(name).alias("table_name"), "n_rows",
                     F.lit(len(df.columns)).cast("bigint").alias("n_cols"))
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)
