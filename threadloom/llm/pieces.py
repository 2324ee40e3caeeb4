"""SentencePiece encoding and decoding by a shared-prefix forward pass.

White space is marked, and a text falls into marked words (marks, then what follows up to the next mark) that no piece
crosses.  A block's distinct words are sorted, which lays out their trie; walking it depth-first, one forward cell per
prefix is computed once and serves all words below it.

* Unigram vocabularies: the cell holds the best sum of piece scores, and the piece that ends it (Viterbi).
* Merge vocabularies (byte-pair): summed scores do not say which merges happen, so the best-scoring path is not the
  encoding.  The cell holds the last piece of the prefix's own encoding, which is the one piece that stays beside
  the last piece of the prefix before it; that gives exactly the ids of the merges.

Characters outside the vocabulary become byte pieces.  Decoding joins pieces and bytes and turns marks into spaces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import spans_of

MARK = "▁"
WORDS_KEPT = 400_000


class Vocabulary:
    """Pieces, ids and scores of a model file; `merges` says that it encodes by merges."""

    def __init__(self, model_file: str, merges: bool = True):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.scores = {i: model.get_score(i) for i in plain}
        self.pieces = [model.id_to_piece(i) for i in ids]
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.longest = max(map(len, self.ids))
        self.merges = merges
        self._merged: dict[str, tuple[str, ...]] = {}

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]

    def merged(self, text: str) -> tuple[str, ...]:
        """Pieces of a short string by its merges: the adjacent pair with the best score first, the leftmost of equals."""
        known = self._merged.get(text)
        if known is not None:
            return known
        parts = list(text)
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                piece = self.ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.scores[piece] > best[0]):
                    best = self.scores[piece], i
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(self._merged) > 2_000_000:
            self._merged.clear()
        self._merged[text] = out = tuple(parts)
        return out


class SharedPrefixEncoder:
    """Ids of words, computed prefix by prefix over the sorted words of a block."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.stays: dict[tuple[str, str], bool] = {}
        self._long: dict[str, set[int]] = {}
        for piece in vocabulary.ids:
            if len(piece) > 2:
                self._long.setdefault(piece[-3:], set()).add(len(piece))
        #: Lengths of pieces that may end with up to three last characters, longest first; one always may.
        self.lengths: dict[str, tuple[int, ...]] = {}

    def _lengths(self, tail: str) -> tuple[int, ...]:
        found = sorted(self._long.get(tail, ()), reverse=True)
        if tail[-2:] in self.v.ids and len(tail) > 1:
            found.append(2)
        if len(self.lengths) > 500_000:
            self.lengths.clear()
        self.lengths[tail] = out = (*found, 1)
        return out

    def _stay(self, left: str, right: str) -> bool:
        """Whether the merges of two pieces side by side give these two; with no left piece, whether they give one."""
        if len(self.stays) > 1_000_000:
            self.stays.clear()
        self.stays[left, right] = known = self.v.merged(left + right) == ((left, right) if left else (right,))
        return known

    def _extend_merged(self, word: str, begin: int, cells: list[tuple]) -> None:
        """Add the cells (start, score, piece) of the prefixes that end at `begin` and later: the last piece of each
        prefix's own encoding."""
        ids, stays, lengths = self.v.ids, self.stays, self.lengths
        for end in range(begin, len(word) + 1):
            tail = word[max(0, end - 3) : end]
            for n in lengths.get(tail) or self._lengths(tail):
                start = end - n
                if start < 0:
                    continue
                piece = word[start:end]
                if n > 1 and piece not in ids:
                    continue
                left = cells[start][2]
                stay = stays.get((left, piece))
                if stay if stay is not None else self._stay(left, piece):
                    cells.append((start, 0.0, piece))
                    break

    def _score_cell(self, word: str, end: int, cells: list[tuple]) -> tuple:
        """(start, best sum, piece) of the best-scoring segmentation of the prefix."""
        v, best = self.v, None
        for start in range(max(0, end - v.longest), end):
            piece = word[start:end]
            if piece not in v.ids and start != end - 1:
                continue
            score = cells[start][1] + (v.scores[v.ids[piece]] if piece in v.ids else -1e6)
            if best is None or score > best[1]:
                best = start, score, piece
        return best

    def encode(self, words: Iterable[str]) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        cells: list[tuple] = [(0, 0.0, "")]
        above = ""
        for word in sorted(words):  # neighbours share their prefix: the path from the trie's root
            shared = 0
            for a, b in zip(above, word):
                if a != b:
                    break
                shared += 1
            del cells[shared + 1 :]
            if self.v.merges:
                self._extend_merged(word, shared + 1, cells)
            else:
                for end in range(shared + 1, len(word) + 1):
                    cells.append(self._score_cell(word, end, cells))
            ids: list[int] = []
            end = len(word)
            while end:
                start, _, piece = cells[end]
                known = self.v.ids.get(piece)
                ids += [known] if known is not None else self.v.fallback(piece)[::-1]
                end = start
            out[word] = ids[::-1]
            above = word
        return out


def marked_words(text: str) -> list[str]:
    """Marked words of a text: a dummy space in front, spaces as marks, runs of marks together with what follows."""
    if not text:
        return []
    first, *rest = text.replace(MARK, " ").split(" ")
    if first and all(rest):
        return [MARK + first, *[MARK + x for x in rest]]
    out, marks = [], MARK
    for part in [first, *rest]:
        if part:
            out.append(marks + part)
            marks = MARK
        else:
            marks += MARK
    return [*out, marks[:-1]] if len(marks) > 1 else out


def decode_pieces(ids: Iterable[int], v: Vocabulary) -> str:
    """What ids stand for, marks as spaces; control and unknown pieces say nothing."""
    parts, raw = [], bytearray()
    for i in ids:
        if i in v.byte_of:
            raw.append(v.byte_of[i])
            continue
        if raw:
            parts.append(raw.decode("utf-8", "replace"))
            raw = bytearray()
        if i in v.scores:
            parts.append(v.pieces[i])
    if raw:
        parts.append(raw.decode("utf-8", "replace"))
    return "".join(parts).replace(MARK, " ")


def decode_ids(ids: Iterable[int], v: Vocabulary) -> str:
    """The text of ids: without the dummy space in front."""
    return decode_pieces(ids, v).removeprefix(" ")


@lru_cache(maxsize=1)
def _worker_words(model_file: str, merges: bool) -> WordIds:
    """The words this worker process has met; later tasks find them as they were left, and results do not depend on it."""
    return WordIds(SharedPrefixEncoder(Vocabulary(model_file, merges)))


class WordIds:
    """Ids of words, as bytes, remembered in two generations: words not met in the last one are forgotten."""

    def __init__(self, encoder: SharedPrefixEncoder):
        self.encoder = encoder
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.changed: set[str] = set()  # words that decoding does not give back

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """A mapping that has all these words."""
        if len(self.young) > WORDS_KEPT:
            self.old, self.young = self.young, {}
        new = words.difference(self.young)
        met = new.intersection(self.old)
        self.young.update((w, self.old[w]) for w in met)
        for w, ids in self.encoder.encode(new - met).items():
            self.young[w] = np.array(ids, "<i4").tobytes()
            if decode_pieces(ids, self.encoder.v) != w.replace(MARK, " "):
                self.changed.add(w)
        return self.young

    def gives_back(self, words: list[str], text: str) -> bool:
        """Whether decoding the ids of learnt words gives the text: no run of byte pieces crosses a mark, so each word
        decodes by itself."""
        return self.changed.isdisjoint(words) and "".join(words).replace(MARK, " ").removeprefix(" ") == text.replace(MARK, " ")


def _encode(model_file: str, merges: bool, digest: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _worker_words(model_file, merges)
        for batch in batches:
            ids_of, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in spans_of(texts):
                words = [marked_words(t or "") for t in texts[lo:hi]]
                known = seen.learn(set().union(*words))
                coded = [b"".join(map(known.__getitem__, w)) for w in words]
                if not digest:
                    offsets = np.concatenate(([0], np.cumsum([len(c) // 4 for c in coded]))).astype(np.int32)
                    values = pa.array(np.frombuffer(b"".join(coded), "<i4"), pa.int32())
                    yield pa.RecordBatch.from_arrays([ids_of.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "ids"])
                    continue
                columns = [
                    ids_of.slice(lo, hi - lo),
                    pa.array([len(c) // 4 for c in coded], pa.int64()),
                    pa.array([zlib.crc32(c) for c in coded], pa.int64()),
                    pa.array([seen.gives_back(w, t or "") for w, t in zip(words, texts[lo:hi])], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return run


def _model_file(given: str | None) -> str:
    if given is None:
        import public_tokenizers

        return public_tokenizers.path("piece_bpe_32k.model")
    return given


def encode(docs: DataFrame, model_file: str | None = None, merges: bool = True) -> DataFrame:
    """doc_id and ids of every text.

    Takes doc_id and text; other columns are not read.  NULL and empty texts have no ids; a NULL doc_id stays NULL;
    every row gives one row, an empty table none.  Marks in a text are taken for spaces.  `model_file` must be
    readable on every executor; `merges=False` for unigram models.
    """
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(_encode(_model_file(model_file), merges, False), "doc_id long, ids array<int>")


def encode_digest(docs: DataFrame, model_file: str | None = None, merges: bool = True) -> DataFrame:
    """doc_id, n_ids, crc32 of the little-endian 32-bit ids, and whether decoding them gives the text back."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(_encode(_model_file(model_file), merges, True), "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")


def _decode(model_file: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(model_file)
        for batch in batches:
            texts = [None if ids is None else decode_ids([i for i in ids if i is not None], v) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); NULL ids give a NULL text, NULL or unknown ids inside say nothing."""
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decode(_model_file(model_file)), "doc_id long, text string")
