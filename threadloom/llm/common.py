"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 2 << 20  # text that a task takes apart at a time
WORDS_KEPT = 250_000  # distinct words whose values a task remembers


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: Column, by: int) -> Column:
    """crc32 of the key as text, modulo `by`; 0 for a NULL key."""
    return F.coalesce(F.crc32(key.cast("string")) % by, F.lit(0))


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """The column as UTF-8 bytes.  `bytes.split()` then cuts at exactly \\x20 and \\x09-\\x0D, and
    `bytes.lower()` changes exactly A-Z."""
    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()


def spans_of(texts: list[bytes | None] | list[str | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of about `limit` bytes (characters), one text at least; no text is cut."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text) if text else 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class WordValues:
    """Values of distinct words (rows of numbers), computed once per word while a task remembers it.

    `score` takes a list of words and returns one row of `width` numbers per word.  When more than `limit`
    words are held, all are forgotten; values do not depend on what is remembered.
    """

    def __init__(self, score: Callable[[list[bytes]], np.ndarray], width: int, limit: int = WORDS_KEPT):
        self.score, self.width, self.limit = score, width, limit
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.rows = np.zeros((0, self.width))

    def of(self, words: list[bytes]) -> np.ndarray:
        new = set(words).difference(self.index)
        if len(self.index) + len(new) > self.limit and self.index:
            self.forget()
            new = set(words)
        if new:
            fresh = list(new)
            at = len(self.index)
            self.index.update(zip(fresh, range(at, at + len(fresh))))
            if at + len(fresh) > len(self.rows):
                grown = np.zeros((2 * (at + len(fresh)), self.width))
                grown[:at] = self.rows[:at]
                self.rows = grown
            self.rows[at : at + len(fresh)] = self.score(fresh)
        return self.rows[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))]

    def sums(self, documents: list[list[bytes]]) -> np.ndarray:
        """One row per document: the sum of its words' values, zeros for a document without words."""
        out = np.zeros((len(documents), self.width))
        sizes = np.fromiter(map(len, documents), np.int64, len(documents))
        full = np.flatnonzero(sizes)
        if len(full):
            values = self.of([w for d in documents for w in d])
            out[full] = np.add.reduceat(values, np.concatenate(([0], np.cumsum(sizes[full])[:-1])), axis=0)
        return out


def with_columns(batch: pa.RecordBatch, added: dict[str, pa.Array | np.ndarray], keep: Iterable[str]) -> pa.RecordBatch:
    columns = {name: batch.column(batch.schema.get_field_index(name)) for name in keep}
    columns.update({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in added.items()})
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
