import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm_cases import EDGES
from threadloom.llm import packing


def best_fit(lengths, capacity):
    free, bins = [], 0
    for n in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - n)
        else:
            bins += 1
            free.append(capacity - n)
    return bins


@pytest.mark.parametrize("n, top", [(0, 60), (1, 60), (40, 12), (400, 63), (400, 64), (900, 20)])
def test_plans_hold_every_piece_once_and_are_as_good_as_best_fit(n, top):
    rnd = random.Random(n)
    counts = Counter(rnd.randint(1, top) for _ in range(n))
    plans = [packing.plan_sequences(counts, 64, g) for g in (8, 64)]
    for plan in plans:
        used = Counter()
        for lengths, many in plan:
            assert sum(lengths) <= 64 and many > 0
            used.update({k: v * many for k, v in Counter(lengths).items()})
        assert used == counts
    assert min(sum(m for _, m in p) for p in plans) <= best_fit(counts.elements(), 64) * 1.03 + 1


def test_pieces_of_long_documents_are_whole_but_the_first():
    ids = np.arange(2500, dtype="<u4").tobytes()
    assert [(s, len(p) // 4) for s, p in packing.token_pieces(ids, 1024)] == [(0, 452), (452, 1024), (1476, 1024)]
    assert [(s, len(p) // 4) for s, p in packing.token_pieces(ids[: 4 * 1024], 1024)] == [(0, 1024)]


def test_chunked_ids_are_the_tokenizers():
    own = packing.ChunkTokens(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    rnd = random.Random(2)
    parts = ["the", " ", "  ", "\n", "é", "日本", "🙂", "don't", "it's", "12", "!!", "\t", " ", " ", "<|endoftext|>", "x" * 70, " a", "b "]
    for _ in range(800):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert np.frombuffer(own.document(text), "<u4").tolist() == other.encode(text, add_special_tokens=False).ids, repr(text)


def test_packed_rows(edges, nothing):
    rows = packing.pack(edges).toPandas().sort_values(["sequence_id", "offset"])
    assert (rows.groupby("sequence_id").length.sum() <= 1024).all()
    assert (rows.offset == rows.groupby("sequence_id").length.cumsum() - rows.length).all()
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text, _ in EDGES:
        ids = np.array([*other.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        for k, (start, piece) in enumerate(packing.token_pieces(ids.tobytes(), 1024)):
            want[(-1 if i is None else i, k, start, len(piece) // 4, zlib.crc32(piece))] += 1
    got = rows.assign(doc_id=rows.doc_id.fillna(-1).astype(int))[["doc_id", "piece", "start", "length", "ids_crc32"]]
    assert Counter(tuple(map(int, r)) for r in got.itertuples(index=False)) == want
    assert packing.pack(nothing).count() == 0
