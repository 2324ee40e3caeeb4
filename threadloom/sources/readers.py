"""Scans and sinks for the relations this package works on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions import values as V
from threadloom.operators.ranks import position_by_range
from threadloom.sources.quoted import read_quoted_csv
from threadloom.sources.schemas import MANIFEST, THREADS, TWEETS, require_columns


def read_tweets_csv(spark: SparkSession, path: str, schema: T.StructType | str = TWEETS) -> DataFrame:
    """SRC1: CSV with declared types; texts may hold quotes and line breaks, and one big file is read by many tasks."""
    return read_quoted_csv(spark, path, schema)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """SRC2: parquet scan; filters and columns are pushed down by the optimiser."""
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_threads(spark: SparkSession, subsample: str, full: str, use_subsample: bool = True) -> DataFrame:
    """SRC3: the subsample when wanted and present, else the full table; an error when neither is there."""
    for path in ([subsample] if use_subsample else []) + [full]:
        if _exists(spark, path):
            return spark.read.schema(THREADS).parquet(path)
    raise FileNotFoundError(f"no threads table at {full}")


def read_labelled_csvs(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str, columns: Sequence[str]) -> DataFrame:
    """SRC4, SET1: union of the labelled files that exist, cut down to the wanted columns."""
    found = [p for p in paths if _exists(spark, p)]
    if not found:
        raise FileNotFoundError(f"none of {list(paths)} exists")
    frames = [read_tweets_csv(spark, p, schema).select(*columns) for p in found]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: a JSON document with id lists."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def manifest_ids(manifest: DataFrame, split: str = "test") -> DataFrame:
    """SRC5: one row per id of a split."""
    return manifest.select(F.explode(f"{split}_golden_ids").alias("golden_id"))


def read_manifest_document(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: (split, id) rows of one JSON document `{"dev_golden_ids": [..], "test_golden_ids": [..], ...}` of any size.

    The document is cut at commas, so that many tasks read it.  Only the few places where an array starts or ends come to
    the driver; every other piece takes the array it lies in from them.  Numbers outside of arrays are left out.
    """
    cut = spark.read.option("lineSep", ",").text(path).select(
        "value", F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at")
    )
    pieces = cut.select("at", F.regexp_extract("value", r'"(\w+)_golden_ids"\s*:\s*\[', 1).alias("opens"), F.col("value").contains("]").alias("closes"), F.regexp_extract("value", r"(?:^|\[)\s*(-?\d+)\s*(?:\]|$|\})", 1).alias("id"))
    marks = sorted(tuple(r["at"]) + (r["opens"], r["closes"]) for r in pieces.filter((F.col("opens") != "") | F.col("closes")).collect())
    inside, split, open_at = F.lit(None).cast("string"), None, None
    for block, row, opens, closes in marks:
        if opens:
            split, open_at = opens, (block, row)
        if closes and split is not None:
            here = F.struct(F.lit(block).cast("long").alias("block"), F.lit(row).cast("long").alias("row"))
            start = F.struct(F.lit(open_at[0]).cast("long").alias("block"), F.lit(open_at[1]).cast("long").alias("row"))
            inside = F.when((F.col("at") >= start) & (F.col("at") <= here), F.lit(split)).otherwise(inside)
            split = None
    return pieces.select(inside.alias("split"), F.col("id").try_cast("long").alias("id")).filter("split IS NOT NULL AND id IS NOT NULL")


def write_id_manifest(ids: DataFrame, path: str, chunk: int = 10_000) -> None:
    """SRC5: (split, id) rows as JSON lines of at most `chunk` ids each, in id order; no split is one task's or one row's."""
    placed = position_by_range(ids.select("split", "id"), ["split"], ["id"])
    lines = placed.groupBy("split", F.floor(F.col("position") / F.lit(chunk)).alias("chunk")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    lines.write.mode("overwrite").json(path)


def read_id_manifest(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: the (split, id) rows of `write_id_manifest`."""
    lines = spark.read.schema("split string, chunk long, ids array<long>").json(path)
    return lines.select("split", F.explode("ids").alias("id"))


def load_split(
    golden: DataFrame,
    file_name: str,
    manifest_test_ids: DataFrame | None = None,
    known_test_ids: DataFrame | None = None,
    required: Sequence[str] = tuple(V.REQUIRED_EVALUATION_COLUMNS),
) -> DataFrame:
    """SRC6, SRC7, JON9: the locked rows — by manifest, else the file is one by name, else by known ids."""
    require_columns(golden, required)
    is_test_file = "test" in file_name.lower()
    if not is_test_file and manifest_test_ids is not None:
        return golden.join(manifest_test_ids, "golden_id", "left_semi")
    if not is_test_file and known_test_ids is not None:
        return golden.join(known_test_ids, "golden_id", "left_semi")
    return golden


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """SNK1."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """SNK2: quotes doubled, so SRC1 reads it back."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """SNK3: metric frames as JSON lines."""
    df.write.mode("overwrite").json(path)
