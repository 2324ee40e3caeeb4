import random

import public_tokenizers
import sentencepiece

from llm_cases import EDGES
from threadloom.llm import pieces

FILE = public_tokenizers.path("piece_bpe_32k.model")


def test_ids_are_the_librarys_and_decode_to_the_text():
    library = sentencepiece.SentencePieceProcessor(model_file=FILE)
    v = pieces.Vocabulary(FILE)
    encoder = pieces.SharedPrefixEncoder(v)
    rnd = random.Random(1)
    parts = ["a", "th", "e ", "  ", "\n", "é", "日", "🙂", "the", "   x", "1", "22", " ", ".", "\t", "ing", "tion ", "token", "\x01"]
    for _ in range(2500):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        words = pieces.marked_words(text)
        coded = encoder.encode(set(words))
        ids = [i for w in words for i in coded[w]]
        assert ids == library.encode(text), repr(text)
        assert pieces.decode_ids(ids, v) == text


def test_unigram_cells_hold_the_best_sum():
    v = pieces.Vocabulary(FILE, merges=False)
    v.ids = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "ba": 5}
    v.scores = {0: -1.0, 1: -2.0, 2: -2.0, 3: -2.5, 4: -2.2, 5: -3.5}
    v.longest = 2

    def best(word):
        if not word:
            return 0.0, []
        found = []
        for n in (1, 2):
            if word[:n] in v.ids and len(word) >= n:
                score, ids = best(word[n:])
                found.append((score + v.scores[v.ids[word[:n]]], [v.ids[word[:n]], *ids]))
        return max(found)

    rnd = random.Random(2)
    words = {"▁" + "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 9))) for _ in range(200)}
    for word, ids in pieces.SharedPrefixEncoder(v).encode(words).items():
        assert abs(sum(v.scores[i] for i in ids) - best(word)[0]) < 1e-9


def test_round_trip_of_all_rows(edges, nothing):
    digest = pieces.encode_digest(edges).collect()
    assert len(digest) == len(EDGES) and all(r["round_trip"] for r in digest)
    assert {r["n_ids"] for r in digest if r["doc_id"] in (1, 2)} == {0}
    texts = sorted((r["doc_id"] or -1, r["text"]) for r in pieces.decode(pieces.encode(edges)).collect())
    assert texts == sorted((i or -1, t or "") for i, t, _ in EDGES)
    assert pieces.encode(nothing).count() == 0 and pieces.decode(pieces.encode(nothing)).count() == 0
