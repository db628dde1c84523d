"""Scans and sinks by file kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A CSV file with a header. Without a schema columns are BIGINT, DOUBLE or text; dates stay text."""
    if schema is not None:
        return spark.read.csv(path, header=True, schema=schema)
    df = spark.read.csv(path, header=True, inferSchema=True)
    narrow = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}
    text = [c for c, t in df.dtypes if t not in ("bigint", "double", *narrow)]
    if text:  # read those again as text: a date turned back into text isn't what the file says
        fields = [T.StructField(f.name, T.StringType() if f.name in text else T.LongType() if f.dataType.simpleString() in narrow and narrow[f.dataType.simpleString()] == "bigint" else f.dataType) for f in df.schema.fields]
        return spark.read.csv(path, header=True, schema=T.StructType(fields))
    return df.select(*(df[c].cast(narrow.get(t, t)).alias(c) for c, t in df.dtypes))


def read_any(spark: SparkSession, path: str, store=None) -> DataFrame:
    """A file by its extension, or else a table of the store."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        return read_csv(spark, path)
    if path.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    if store is None:
        raise ValueError(f"{path}: neither parquet, CSV nor JSON, and no store given")
    return store.read(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def register_table(df: DataFrame, name: str) -> DataFrame:
    """Any relation under a name that SQL can use in this session."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)
