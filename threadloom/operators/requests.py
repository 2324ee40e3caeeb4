"""Request and response tables: what is asked of an outside scorer, and what came back. Nothing is sent."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.scoring import parse_response, request_key


def keyed(requests: DataFrame, model: str = "model", temperature: str = "temperature", system: str = "system_prompt", prompt: str = "prompt") -> DataFrame:
    """PRJ18: adds the request's content key."""
    return requests.withColumn("key", request_key(F.col(model), F.col(temperature).cast("string"), F.col(system), F.col(prompt)))


def latest(store: DataFrame) -> DataFrame:
    """SRC8: one response per key, that of the highest version; a store without versions has one version, and of several
    responses to a key then the smallest counts.  NULL keys answer nothing."""
    version = F.col("version") if "version" in store.columns else F.lit(0).cast("long")
    rows = store.filter(F.col("key").isNotNull()).select("key", "response", version.alias("version"))
    best = F.min_by("response", F.struct(-F.col("version"), F.col("response")))
    return rows.groupBy("key").agg(best.alias("response"))


def lookup(requests: DataFrame, store: DataFrame) -> DataFrame:
    """SRC8, JON15: every request once, with its latest stored response; equal requests share one entry.

    Request repeats are split by adaptive execution when a key is hot.
    """
    return requests.join(latest(store), "key", "left").withColumn("hit", F.col("response").isNotNull())


def misses(requests: DataFrame, store: DataFrame) -> DataFrame:
    """SRC8: distinct requests that have no stored response yet."""
    return requests.join(store.select("key").distinct(), "key", "left_anti").dropDuplicates(["key"])


class ResponseStore:
    """SRC8: responses by key in a folder, in buckets by key; a key that is stored again replaces what it had.

    Appends only add files, each with the number of its append as version, so that a run that is repeated or lost does no
    harm.  Rows lie in `buckets` files per append by the hash of their key: the latest version of each key, and joins
    on the key, read the buckets as they are, and only the requests are shuffled.  `compact` writes the latest rows to a
    new folder.  The number of buckets belongs to the folder and must be given alike each time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = "responses_" + hashlib.md5(f"{path}:{buckets}".encode()).hexdigest()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (key string, response string, version bigint) USING parquet "
            f"CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        """All stored versions."""
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def append(self, responses: DataFrame) -> None:
        """Stores (key, response) rows as a new version; of several rows of one key the smallest response."""
        version = 1 + (self.rows().agg(F.max("version")).first()[0] or 0)
        fresh = latest(responses.select("key", "response")).withColumn("version", F.lit(version).cast("long"))
        fresh.repartition(self.buckets, "key").write.insertInto(self.table)

    def read(self) -> DataFrame:
        """(key, response), the latest of each key."""
        return latest(self.rows())

    def compact(self, path: str) -> ResponseStore:
        """A store in a new folder with the latest rows only."""
        out = ResponseStore(self.spark, path, self.buckets)
        out.append(self.read())
        return out


def parsed(answers: DataFrame, schema: T.StructType | str, required: Sequence[str], default=None) -> DataFrame:
    """PRJ20: adds the parsed struct and parse_ok; unreadable answers get the default struct."""
    value, ok = parse_response(F.col("response"), schema, required)
    fallback = default if default is not None else F.from_json(F.lit(None).cast("string"), schema)
    return answers.withColumn("parse_ok", ok).withColumn("parsed", F.when(F.col("parse_ok"), value).otherwise(fallback))


def audit(answers: DataFrame) -> DataFrame:
    """AGG32: hits, misses and answers that could not be parsed."""
    return answers.agg(
        F.count_if("hit").alias("cache_hits"), F.count_if(~F.col("hit")).alias("cache_misses"),
        F.count_if(F.col("hit") & ~F.col("parse_ok")).alias("parse_fallbacks"),
    )
