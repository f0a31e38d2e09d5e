"""Where queries register, and what several modules of queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtel.functions import urls
from webtel.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)', 1))"
_PATH = "coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)', 1), ''), '/')"
_SEARCH = "regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1)"
_K = "json_extract_string(props, '$.k')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))


def _segments(spark, d):
    u = table(spark, d, "pages").select("page_id", F.explode(F.split(urls.part(F.col("url"), "path"), "/")).alias("segment"))
    return u.where("segment <> ''")
