"""CSV whose quoted texts hold line breaks, read in byte ranges by many tasks."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.sources.scratch import stage_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUOTE = '"'
WHOLE, HEAD, TAIL = 0, 1, 2  # a record of one range, the end of one begun before it, the begin of one that goes on
PIECES = "file string, block long, kind int, first boolean, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def _open_at(lines: DataFrame) -> dict[str, dict[int, bool]]:
    """Per file and range: whether it begins inside quotes, from the parities of the quotes of all ranges before it.

    One row per range comes to the driver, which plans the scan from a list of the same length.
    """
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit(QUOTE), F.lit("")))
    ranges = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd")).collect()
    out: dict[str, dict[int, bool]] = {}
    inside = False
    for file, block, odd in sorted(tuple(r) for r in ranges):
        inside = inside if file in out else False
        out.setdefault(file, {})[block] = inside
        inside ^= bool(odd)
    return out


def _pieces(open_at: dict[str, dict[int, bool]]):
    """The records of a range in the order of its lines; a line ends a record when it ends outside of quotes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, inside, held, kind, first = None, False, [], WHOLE, False
        out: list[tuple] = []
        for batch in batches:
            odd = batch["value"].str.count(QUOTE) % 2 == 1
            for file, block, line, flips in zip(batch["file"], batch["block"], batch["value"], odd):
                if (file, block) != here:
                    if held:
                        out.append((*here, HEAD if kind == HEAD else TAIL, first, "\n".join(held)))
                    if block not in open_at.get(file, ()):
                        raise RuntimeError(f"{file} was cut at {block} only in the second pass; read it again")
                    here, held, inside, first = (file, block), [], open_at[file][block], block == 0
                    kind = HEAD if inside else WHOLE
                held.append(line)
                inside ^= flips
                if not inside:
                    out.append((*here, kind, first, "\n".join(held)))
                    held, kind, first = [], WHOLE, False
            yield pd.DataFrame(out, columns=["file", "block", "kind", "first", "record"])
            out = []
        if held:
            yield pd.DataFrame([(*here, HEAD if kind == HEAD else TAIL, first, "\n".join(held))], columns=["file", "block", "kind", "first", "record"])

    return run


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record, first) of every file below `path`, line breaks inside quotes included; `first` marks a file's first record.

    Ranges are Spark's own splits.  One scan counts their quotes, a second one puts lines together to records and
    stores them; a record that crosses ranges is joined from its pieces, of which a range has two at most.  Both scans run
    here, one after the other; a range that only the second one cuts is an error.  Quotes must be doubled inside quotes;
    what follows a quote that never ends is one record.  A compressed file is one range.
    """
    lines = _lines(spark, path)
    pieces = stage_table(lines.mapInPandas(_pieces(_open_at(lines)), PIECES), "csv")
    order = W.partitionBy("file").orderBy("block", "kind")  # at most two rows per range
    cut = pieces.filter(F.col("kind") != WHOLE).withColumn("n", F.count_if(F.col("kind") == TAIL).over(order))
    joined = cut.groupBy("file", "n").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "kind", "record"))), lambda p: p["record"]), "\n").alias("record"),
        F.max("first").alias("first"),
    )
    return pieces.filter(F.col("kind") == WHOLE).select("record", "first").unionByName(joined.select("record", "first"))


def read_quoted_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    """The rows of CSV files by a schema, as the built-in reader gives them with `multiLine`, but not one task per file.

    Lines may end in \\r\\n; empty lines are left out; fields that do not fit their type are NULL.
    """
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    found = records(spark, path)
    text = F.when(F.endswith("record", F.lit("\r")), F.substr("record", F.lit(1), F.char_length("record") - 1)).otherwise(F.col("record"))
    rows = (found.filter(~F.col("first")) if header else found).select(text.alias("record")).filter("record <> ''")
    options = {"quote": QUOTE, "escape": QUOTE, "multiLine": "true", "maxCharsPerColumn": "-1"}
    return rows.select(F.from_csv("record", ddl, options).alias("r")).select("r.*")
