"""Best-fit packing by linear grouping.

Documents become token pieces of at most `capacity`; how many pieces there are of each length is all that the
packing is planned from, so the plan is made on at most `capacity` numbers, whatever the corpus holds:

1. lengths above `capacity / small_part` are cut into groups of equal cardinality, and every length counts as the
   largest of its group;
2. configurations of these few sizes are chosen one after another: each holds the largest size still needed and the
   combination of others that leaves the least room, and is used as often as the demand allows;
3. actual pieces take the places of their group, largest first, and free the room they do not need;
4. small lengths go best-fit, largest first, into the room left, then into new sequences.

Several group counts are planned and the plan with the fewest sequences wins.  A plan says for every length which
run of its pieces goes to which run of sequences at which offset.  Pieces are numbered per length without a sort:
each task numbers its own, and task offsets come from a table of counts.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm.common import raw_texts, spans_of
from threadloom.sources.scratch import stage_table

CAPACITY = 1024
END_ID = 2
SMALL_PART = 8
GROUPS = (48, 96, 192, 384, 1023)
RANK_BITS = 48
PIECES_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local_rank long"
PACKED_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


# ---- tokens


class ChunkTokens(dict):
    """Little-endian 32-bit ids of text chunks, encoded once per chunk."""

    def __init__(self, ranks_file: str, limit: int = 500_000):
        import public_tokenizers
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoder = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.limit = limit

    def encode(self, text: str) -> bytes:
        return np.array(self.encoder.encode_ordinary(text), dtype="<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        self[chunk] = ids = self.encode(chunk)
        return ids

    def document(self, text: str) -> bytes:
        """Ids of a text.  A token spans a space only as its first character, so a text may be cut before single
        spaces between other characters; texts with wider or marginal white space are cut nowhere near it."""
        first, *rest = text.split(" ")
        if not rest:
            return self.encode(text)
        if first and not first[-1].isspace() and all(rest) and not any(map(_open_ended, rest)):
            return self[first] + b"".join([self[" " + x] for x in rest])
        out, chunk = [], first
        for part in rest:
            if chunk and part and not chunk[-1].isspace() and not part[0].isspace():
                out.append(chunk)
                chunk = " " + part
            else:
                chunk += " " + part
        return b"".join([self[x] if len(x) < 64 else self.encode(x) for x in [*out, chunk]])


def _open_ended(part: str) -> bool:
    return part[0].isspace() or part[-1].isspace()


def token_pieces(ids: bytes, capacity: int) -> Iterator[tuple[int, bytes]]:
    """(first token, its ids) of every piece: whole pieces, but the first may be shorter."""
    size = 4 * capacity
    first = len(ids) % size or size
    at = 0
    while at < len(ids):
        end = at + (first if at == 0 else size)
        yield at // 4, ids[at:end]
        at = end


def _tokenize(ranks_file: str, capacity: int, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        chunks = ChunkTokens(ranks_file)
        end = end_id.to_bytes(4, "little")
        seen = [0] * (capacity + 1)
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), raw_texts(batch)
            for lo, hi in spans_of(texts):
                rows = []
                for doc_id, raw in zip(ids_of[lo:hi], texts[lo:hi]):
                    for k, (start, piece) in enumerate(token_pieces(chunks.document((raw or b"").decode("utf-8", "replace")) + end, capacity)):
                        n = len(piece) // 4
                        rows.append((doc_id, k, start, n, zlib.crc32(piece), task, seen[n]))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "local_rank"],
                )

    return run


# ---- the plan, on counts per length


def _groups(counts: dict[int, int], number: int) -> list[list[tuple[int, int]]]:
    """Runs (length, count) in descending length, cut into at most `number` groups of equal cardinality."""
    share = -(-sum(counts.values()) // number)
    groups, room = [[]], share
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not room:
                groups.append([])
                room = share
            take = min(n, room)
            groups[-1].append((length, take))
            n -= take
            room -= take
    return groups


def _best_configuration(sizes: list[int], demand: list[int], capacity: int) -> dict[int, int]:
    """Copies per size index: the largest size still needed and what fills the rest best."""
    first = next(i for i, d in enumerate(demand) if d)
    room = capacity - sizes[first]
    mask = (1 << (room + 1)) - 1
    reached, steps = 1, []  # bit s: sum s can be reached
    for i in range(first, len(sizes)):
        copies = min(demand[i] - (i == first), room // sizes[i])
        if copies > 0:
            steps.append((i, copies, reached))
            for _ in range(copies):
                reached |= (reached << sizes[i]) & mask
    total = reached.bit_length() - 1
    chosen = {first: 1}
    for i, copies, before in reversed(steps):
        used = 0
        while not before >> total & 1:
            total -= sizes[i]
            used += 1
        if used:
            chosen[i] = chosen.get(i, 0) + used
    return chosen


def _take(queue: list[list[int]], n: int) -> list[tuple[int, int]]:
    """The next n pieces of a group as runs (length, count)."""
    out = []
    while n:
        length, left = queue[-1]
        k = min(n, left)
        out.append((length, k))
        n -= k
        if k == left:
            queue.pop()
        else:
            queue[-1][1] -= k
    return out


def _zip_runs(columns: list[list[tuple[int, int]]]) -> Iterator[tuple[tuple[int, ...], int]]:
    """Runs in which every column has one length."""
    at = [0] * len(columns)
    left = [c[0][1] for c in columns]
    while True:
        k = min(left)
        yield tuple(c[i][0] for c, i in zip(columns, at)), k
        for j, c in enumerate(columns):
            left[j] -= k
            if not left[j]:
                at[j] += 1
                if at[j] == len(c):
                    return
                left[j] = c[at[j]][1]


def plan_sequences(counts: dict[int, int], capacity: int, groups: int, small_part: int = SMALL_PART) -> list[tuple[tuple[int, ...], int]]:
    """Kinds of sequences as (lengths, how many), from counts per length."""
    kinds: list[tuple[tuple[int, ...], int]] = []
    if counts.get(capacity):
        kinds.append(((capacity,), counts[capacity]))
    large = {k: n for k, n in counts.items() if n and capacity // small_part < k < capacity}
    small = {k: n for k, n in counts.items() if n and k <= capacity // small_part}
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    if large:
        parts = _groups(large, groups)
        sizes, demand = [g[0][0] for g in parts], [sum(n for _, n in g) for g in parts]
        queues = [[list(run) for run in reversed(g)] for g in parts]
        while any(demand):
            chosen = _best_configuration(sizes, demand, capacity)
            times = min(demand[i] // c for i, c in chosen.items())
            columns = []
            for i, c in chosen.items():
                demand[i] -= c * times
                columns += [_take(queues[i], times) for _ in range(c)]
            for lengths, n in _zip_runs(columns):
                by_room[capacity - sum(lengths)].append((lengths, n))
    for length in sorted(small, reverse=True):
        n = small[length]
        while n:
            room = next((r for r in range(length, capacity) if by_room.get(r)), capacity)
            lengths, bins = by_room[room].pop() if room < capacity else ((), n)
            copies = min(n, room // length)
            used = min(bins, n // copies)
            if bins > used and room < capacity:
                by_room[room].append((lengths, bins - used))
            by_room[room - copies * length].append((lengths + (length,) * copies, used))
            n -= used * copies
    return kinds + [kind for room in by_room.values() for kind in room]


def placement_runs(kinds: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: rank r of a length goes to the sequence
    first sequence + r - first rank of the last row that starts at or below r."""
    rows, next_rank, sequence = [], defaultdict(int), 0
    for lengths, n in kinds:
        offset = 0
        for length in lengths:
            rows.append((length, next_rank[length], sequence, offset))
            next_rank[length] += n
            offset += length
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def best_plan(counts: dict[int, int], capacity: int = CAPACITY, groups: Iterable[int] = GROUPS) -> np.ndarray:
    plans = [plan_sequences(counts, capacity, g) for g in groups]
    return placement_runs(min(plans, key=lambda kinds: sum(n for _, n in kinds)))


def _place(runs: np.ndarray):
    keys = (runs[:, 0] << RANK_BITS) + runs[:, 1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length, rank = columns["length"].to_numpy(), columns.pop("rank").to_numpy()
            at = np.searchsorted(keys, (length << RANK_BITS) + rank, side="right") - 1
            columns["sequence_id"] = pa.array(runs[at, 2] + rank - runs[at, 1])
            columns["offset"] = pa.array(runs[at, 3])
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def pack(
    docs: DataFrame, ranks_file: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, groups: Iterable[int] = GROUPS
) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most `capacity` tokens.

    Takes doc_id and text of `docs`; other columns are not read.  A NULL or empty text is the end id alone, a NULL
    doc_id stays NULL, repeated rows are packed each for itself, an empty table gives no rows.  `ranks_file` must be
    readable on every executor.
    """
    if ranks_file is None:
        import public_tokenizers

        ranks_file = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenize(ranks_file, capacity, end_id), PIECES_SCHEMA)
    pieces = stage_table(pieces, "pieces")
    per_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local_rank")).alias("rank")
    )
    return ranked.mapInArrow(_place(best_plan(counts, capacity, groups)), PACKED_SCHEMA)
