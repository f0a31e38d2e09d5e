"""Reading event and page tables, and writing messages."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUESTS = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("document_id", T.StringType()),
        T.StructField("parent_document_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("page_url", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("headers", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))),
    ]
)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark: SparkSession, path: str) -> DataFrame:
    """Web requests as JSON lines with a declared schema; only http and https."""
    return spark.read.schema(REQUESTS).json(path).where(F.col("url").rlike("^https?://"))


def untrusted_json(text: Column, schema: str, most: int = 1 << 20) -> Column:
    """A JSON object by a declared schema; null if it is null, too long, broken or no object.

    A value of another type than declared is null by itself.
    """
    parsed = F.try_parse_json(F.when(F.length(text) <= most, text))
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    return F.when(is_object, F.from_json(text, schema, {"mode": "PERMISSIVE"}))


def rules(spark: SparkSession, path: str, most: int = 1 << 20) -> dict:
    """A rules document of at most 1 MiB, read through Spark; for the driver to compile."""
    row = spark.read.format("binaryFile").load(path).where(F.col("length") <= most).select("content").first()
    if row is None:
        raise ValueError("no rules document of allowed size")
    return json.loads(bytes(row.content).decode())


def fetch_class(status: Column, content_type: Column, length: Column, most: int = 10 << 20) -> Column:
    """How a fetched page counts: ok, retry later, or refused with a reason."""
    return (
        F.when(status.isNull(), "network error")
        .when((status == 429) | (status >= 500), "retry")
        .when(status >= 400, "permanent error")
        .when(status.between(300, 399), "redirect")
        .when(length > most, "too large")
        .when(~F.coalesce(content_type.rlike("(?i)^(?:text/html|application/xhtml\\+xml)"), F.lit(False)), "content type")
        .otherwise("ok")
    )


def write_messages(df: DataFrame, path: str, by: str = "action") -> None:
    """Messages as compressed JSON lines, in a folder for each action."""
    df.write.mode("append").partitionBy(by).option("compression", "gzip").json(path)
