"""Language-model scoring: prediction by partial matching over a byte-context trie.

Tokens are words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, then one end.  A document's tokens, one space between them, are
coded byte by byte as running text: the longest context seen in training predicts, a symbol it has not seen is an escape
to the next shorter context, whose counts leave out the symbols that the longer one has already ruled out; below the
empty context all bytes left are alike.  Contexts run over word ends, so the order of words counts.

All training documents count, and nothing of the size of the corpus is broadcast:

1. each task turns its documents into blocks: the block's distinct words and distinct n-grams with their training
   counts, and each document's word numbers in order; a document is read once and never shuffled;
2. counts of words and of n-grams are summed;
3. trie nodes with the same last three context bytes lie in one part, parts hold about `part_grams` n-grams (one ending
   has 256^(depth - 2) at most); nodes of two context bytes are joined to the parts that need them, shorter ones are
   bounded tables sent along; the code length of every n-gram is worked out there;
4. code lengths and word counts go back to the blocks, and each block adds up its documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import raw_texts, remainder, spans_of
from threadloom.sources.scratch import stage_table

DEPTH = 4  # bytes of context, 3 to 6
HELD_OUT_OF = 5
BLOCK_BYTES = 16 << 20  # text of a block
PART_GRAMS = 100_000  # n-grams of a part of the trie
STEP = 1 << 19  # bytes whose n-grams are looked at together
MERGE = 1 << 20  # n-grams counted before they are merged
END = b"\n"  # the end token; no word has white space
BLOCK_SCHEMA = "block long, word binary, number int, gram long, trained long, doc_id long, held_out boolean, words binary"


# ---- running text to n-grams


def coded_grams(texts: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Packed n-grams (context, symbol), one per byte of every text, and the text's number of each, a step at a time.

    An n-gram's lowest byte is the symbol, its other bytes the context; in front of a text stand a space and zero bytes."""
    head = b"\0" * (depth - 1) + b" "
    data = np.frombuffer(head + head.join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + depth
    heads = ((np.cumsum(sizes) - sizes)[:, None] + np.arange(depth)).ravel()
    owners = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    owners[heads] = -1
    for at in range(0, len(data), STEP):
        first = max(0, at - depth)
        piece = data[first : at + STEP].astype(np.int64)
        packed = piece.copy()
        for back in range(1, depth + 1):
            packed[back:] |= piece[:-back] << (8 * back)
        owner = owners[at : at + STEP]
        keep = owner >= 0
        yield packed[at - first :][keep], owner[keep]


# ---- documents to blocks


class _Block:
    """A block under way: the numbers of its words, their training counts, its n-grams' counts, and its documents."""

    def __init__(self, block: int, depth: int):
        self.block, self.depth, self.size = block, depth, 0
        self.numbers: dict[bytes, int] = defaultdict(count().__next__)
        self.trained, self.learnt = np.zeros(0, np.int64), [np.zeros(0, np.int64)]
        self.docs: list[tuple[int | None, bool, bytes]] = []
        self.waiting: dict[bool, list[bytes]] = {False: [], True: []}
        self.uncounted = 0
        self.counted: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, doc_id: int | None, held: bool, text: bytes, compressor: zstandard.ZstdCompressor) -> None:
        words = text.lower().split()
        words.append(END)
        ids = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if not held:
            self.learnt.append(ids)
        self.docs.append((doc_id, held, compressor.compress(ids.astype("<u4").tobytes())))
        self.size += len(text)
        self.waiting[held].append(b" ".join(words))
        self.uncounted += len(text)
        if self.uncounted >= STEP:
            self.count()

    def count(self) -> None:
        trained = np.bincount(np.concatenate(self.learnt), minlength=len(self.numbers))
        trained[: len(self.trained)] += self.trained
        self.trained, self.learnt = trained, self.learnt[:1]
        for held, texts in self.waiting.items():
            for grams, _ in coded_grams(texts, self.depth) if texts else ():
                distinct, n = np.unique(grams, return_counts=True)
                self.counted.append((distinct, np.zeros_like(n) if held else n))
            texts.clear()
        self.uncounted = 0
        if sum(len(g) for g, _ in self.counted[1:]) > MERGE:
            self.merge()

    def merge(self) -> None:
        grams, n = (np.concatenate(x) for x in zip(*self.counted))
        distinct, at = np.unique(grams, return_inverse=True)
        self.counted = [(distinct, np.bincount(at, n, len(distinct)).astype(np.int64))]

    def rows(self, compressor: zstandard.ZstdCompressor) -> Iterator[pa.RecordBatch]:
        """Words, n-grams, documents, and one row that holds all words in the order of their numbers."""
        self.count()
        self.merge()
        (grams, n), words = self.counted[0], list(self.numbers)
        doc_ids, held, coded = zip(*self.docs)
        fields = [x.split() for x in BLOCK_SCHEMA.split(", ")]
        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
        for size, given in (
            (len(words), {"word": words, "number": np.arange(len(words)), "trained": self.trained}),
            (len(grams), {"gram": grams, "trained": n}),
            (1, {"words": [compressor.compress(b" ".join(words))]}),
            (len(coded), {"doc_id": doc_ids, "held_out": held, "words": coded}),
        ):
            for at in range(0, size, 10_000):
                some = min(10_000, size - at)
                part = {"block": np.full(some, self.block)} | {name: column[at : at + some] for name, column in given.items()}
                columns = [pa.array(part[name], kinds[kind]) if name in part else pa.nulls(some, kinds[kind]) for name, kind in fields]
                yield pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])


def _blocks(block_bytes: int, depth: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=3)
        block = _Block(TaskContext.get().partitionId() << 32, depth)
        for batch in batches:
            for doc_id, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch)):
                block.add(doc_id, held, text or b"", compressor)
                if block.size >= block_bytes:
                    yield from block.rows(compressor)
                    block = _Block(block.block + 1, depth)
        if block.docs:
            yield from block.rows(compressor)

    return run


# ---- the trie


def _context_sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted contexts of n-grams, their totals and numbers of symbols."""
    contexts, at = np.unique(keys >> 8, return_inverse=True)
    return contexts, np.bincount(at, n, len(contexts)), np.bincount(at, n > 0, len(contexts))


def code_lengths(grams: np.ndarray, n: np.ndarray, shorter: list[tuple[np.ndarray, np.ndarray]], depth: int) -> np.ndarray:
    """log10 probability of every n-gram's symbol.

    `grams` are distinct, with training counts `n`, and hold all n-grams of the contexts that end in their last three
    bytes.  `shorter`: n-grams and counts of orders 0 to 2, of order 2 at least for the contexts that are needed.
    """
    levels = list(shorter)  # (sorted keys with n > 0, counts) per order
    for order in range(len(shorter), depth + 1):
        keys, at = np.unique(grams & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
        total = np.bincount(at, n, len(keys))
        levels.append((keys[total > 0], total[total > 0]))
    out, todo = np.zeros(len(grams)), np.arange(len(grams))
    ruled_out: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # by context of the order above
    for order in range(depth, -1, -1):
        keys, counts = levels[order]
        contexts, totals, symbols = _context_sums(keys, counts)
        own = grams[todo] & ((1 << 8 * (order + 1)) - 1)
        seen, row = _rows(contexts, own >> 8)
        total, kinds = np.where(seen, totals[row] if len(totals) else 0, 0.0), np.where(seen, symbols[row] if len(symbols) else 0, 0.0)
        if ruled_out is not None:
            above, gone_n, gone_kinds = ruled_out
            known, row = _rows(above, (grams[todo] >> 8) & ((1 << 8 * (order + 1)) - 1))
            if len(above):
                total = total - np.where(known, gone_n[row], 0)
                kinds = kinds - np.where(known, gone_kinds[row], 0)
        hit, row = _rows(keys, own)
        weight = total + kinds
        if hit.any():
            out[todo[hit]] += np.log10(counts[row[hit]] / weight[hit])
        escapes = ~hit & (kinds > 0)
        out[todo[escapes]] += np.log10(kinds[escapes] / weight[escapes])
        todo = todo[~hit]
        if order:  # what the symbols of this order's contexts count for one order below
            short = keys & ((1 << 8 * order) - 1)
            at_short, row = _rows(levels[order - 1][0], short)
            below = levels[order - 1][1][row]
            contexts, at = np.unique(keys >> 8, return_inverse=True)
            ruled_out = contexts, np.bincount(at, np.where(at_short, below, 0), len(contexts)), np.bincount(at, minlength=len(contexts)).astype(float)
    if len(todo):
        out[todo] -= np.log10(256 - len(levels[0][0]))
    return out


def _rows(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    row = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[row] == keys, row


def _trie_part(shorter: list[tuple[np.ndarray, np.ndarray]], depth: int):
    def run(part: pd.DataFrame, below: pd.DataFrame) -> pd.DataFrame:
        grams, below = part["gram"].to_numpy(), below.sort_values("key")
        levels = [*shorter, (below["key"].to_numpy(np.int64), below["n"].to_numpy(np.float64))]
        return pd.DataFrame({"gram": grams, "log": code_lengths(grams, part["n"].to_numpy(), levels, depth)})

    return run


# ---- back to the documents


def _block_scores(total: int, distinct: int, depth: int):
    def run(key: tuple, rows: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        decompressor = zstandard.ZstdDecompressor()
        whole = rows["held_out"].isna()
        words = np.array(decompressor.decompress(rows["words"][whole].iat[0]).split(b" "), object)
        docs = rows[~whole]
        keys, value = values["key"].to_numpy(), values["value"].to_numpy()
        trained, of_word = np.zeros(len(words)), keys < 0
        trained[-1 - keys[of_word]] = value[of_word]
        grams, logs = keys[~of_word], value[~of_word]
        row_of = pd.Index(grams)
        base = np.log10((trained + 0.5) / (total + 0.5 * (distinct + 1)))
        coded = [decompressor.decompress(x) for x in docs["words"]]
        ids = [np.frombuffer(x, "<u4") for x in coded]
        score = np.zeros(len(ids))
        for start, end in spans_of(coded, STEP // 2):  # four bytes a word, whose text has about eight
            texts = [b" ".join(words[i]) for i in ids[start:end]]
            for found, owner in coded_grams(texts, depth):
                score[start:end] += np.bincount(owner, logs[row_of.get_indexer(found)], len(texts))
        return pd.DataFrame(
            {
                "doc_id": docs["doc_id"].astype("Int64").mask(docs["nameless"]).array,
                "held_out": docs["held_out"].astype(bool).array,
                "n_tokens": [len(i) for i in ids],
                "n_known": [int((trained[i] > 0).sum()) for i in ids],
                "train_tokens": total,
                "base_score": [float(base[i].sum()) for i in ids],
                "score": score,
            }
        )

    return run


SCORES_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES, part_grams: int = PART_GRAMS, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every document.

    Learns from the rows that are not held out (remainder of crc32(doc_id) by 5 is not 1; a NULL doc_id is learnt
    from).  Takes doc_id and text; other columns are not read.  A NULL text is empty, its only token is the end.
    Every row gives one row, repeated rows too; an empty table gives none.  Documents are coded whole; `depth` is the
    longest context in bytes (3 to 6).
    """
    if not 3 <= depth <= 6:
        raise ValueError("depth must be 3 to 6")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), HELD_OUT_OF) == 1).alias("held_out"), "text")
    blocks = stage_table(rows.mapInArrow(_blocks(block_bytes, depth), BLOCK_SCHEMA), "blocks")
    in_blocks = blocks.filter("word is not null").select("block", "word", "number", "trained")
    counted = stage_table(in_blocks.groupBy("word").agg(F.sum("trained").alias("trained")), "words")
    total, distinct = counted.agg(F.coalesce(F.sum("trained"), F.lit(0)), F.count(F.when(F.col("trained") > 0, 1))).first()
    grams_in_blocks = blocks.filter("gram is not null").select("block", "gram", "trained")
    grams = stage_table(grams_in_blocks.groupBy("gram").agg(F.sum("trained").alias("n")), "grams")
    parts = max(1, -(-grams.count() // part_grams))

    def of_order(order: int) -> DataFrame:
        key = F.col("gram").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1))
        return grams.groupBy(key.alias("key")).agg(F.sum("n").alias("n")).filter("n > 0")

    shorter = []
    for order in (0, 1):  # at most 256 and 65,536 rows
        table = of_order(order).toPandas().sort_values("key")
        shorter.append((table["key"].to_numpy(np.int64), table["n"].to_numpy(np.float64)))
    last = lambda n: F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * n) - 1))
    dealt = grams.withColumn("part", F.pmod(F.xxhash64(last(3)), F.lit(parts)).cast("int"))
    needed = dealt.select(F.col("part").alias("of_part"), last(2).alias("ending")).distinct()
    below = needed.join(of_order(2).withColumn("ending", F.shiftright("key", 8)), "ending").select("of_part", "key", "n")
    logs = dealt.groupBy("part").cogroup(below.groupBy("of_part")).applyInPandas(_trie_part(shorter, depth), "gram long, log double")
    of_words = in_blocks.select("block", "word", "number").join(counted, "word").select(
        F.col("block").alias("of_block"), (-1 - F.col("number").cast("long")).alias("key"), F.col("trained").cast("double").alias("value")
    )
    of_grams = grams_in_blocks.select("block", "gram").join(logs, "gram").select(
        F.col("block").alias("of_block"), F.col("gram").alias("key"), F.col("log").alias("value")
    )
    documents = blocks.filter("word is null and gram is null").select(
        "block", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("nameless"), "held_out", "words"
    )
    values = of_words.unionAll(of_grams)
    return documents.groupBy("block").cogroup(values.groupBy("of_block")).applyInPandas(_block_scores(total, distinct, depth), SCORES_SCHEMA)
