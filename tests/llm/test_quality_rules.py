import random
import re
from collections import Counter

from llm_cases import EDGES, frame
from threadloom.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_counts_against_brute_force(spark):
    rnd = random.Random(8)
    parts = ["a", "b", "c d e f g", "é", "日本", "#", "*x", " ", "\n", "\n", "\t", "\x0b", " ", "\x1c", "line one\n"]
    rows = [(i, "".join(rnd.choice(parts) + rnd.choice([" ", "", "\n"]) for _ in range(rnd.randint(0, 60))), "en") for i in range(400)]
    rows += [(1000 + k, t, lang) for k, (_, t, lang) in enumerate(EDGES)]
    out = quality_rules.judge(frame(spark, rows))
    assert not set(out.columns) & {"words", "rank", "block"}
    got = {r["doc_id"]: tuple(r[c] for c in COUNTS) + (r["base_failed"],) for r in out.collect()}
    for i, text, _ in rows:
        want = plain_counts(text)
        assert got[i] == (*want, want[0] < 10 or 100 * want[4] > 20 * want[0]), (i, text[:80] if text else text)


def test_fences_follow_the_group_and_fall_back(spark):
    rnd = random.Random(9)
    words = [f"word{i}" for i in range(500)]
    clean = lambda: " ".join(rnd.sample(words, 40))
    marked = lambda: " ".join(w + "#" for w in rnd.sample(words, 40))  # usual in one source, odd elsewhere
    rows = [(2 * i, clean(), "en") for i in range(300)] + [(2 * i + 1, marked(), "en") for i in range(300)]
    rows += [(10_000, marked(), "en"), (10_001, marked(), "en"), (10_003, marked(), "xx"), (10_005, clean(), None)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(frame(spark, rows), least_docs=100).collect()}
    assert all(got[2 * i] for i in range(300)) and all(got[2 * i + 1] for i in range(300))
    assert not got[10_000] and got[10_001] and got[10_005]


def test_each_rate_can_reject_what_passes_the_base(spark):
    rnd = random.Random(10)
    words = [f"word{i}" for i in range(500)]
    lines = lambda n: [" ".join(rnd.sample(words, 4)) for _ in range(n)]
    rows = [(i, "\n".join(lines(20)), "en") for i in range(400)]
    twice = lines(20)
    passage = " ".join(rnd.sample(words, 6))
    odd = {
        "symbol_rate": "\n".join(line + " ## ##" for line in lines(20)),
        "dup_line_rate": "\n".join([*twice, *["ok fine", "or not"] * 4]),
        "repeat_rate": "\n".join([*lines(20), f"{passage} between {passage}"]),
        "capital_rate": "\n".join(lines(20)).upper(),
        "word_length": " ".join("x" * 14 + w for w in rnd.sample(words, 80)),
        "short words": " ".join(rnd.sample([a + b for a in "abcdefghij" for b in "klmnopqrst"], 80)),
    }
    rows += [(1000 + k, text, "en") for k, text in enumerate(odd.values())]
    got = {r["doc_id"]: r for r in quality_rules.judge(frame(spark, rows), least_docs=100).collect()}
    assert sum(got[i]["kept"] for i in range(400)) >= 396
    for k, name in enumerate(odd):
        assert not got[1000 + k]["base_failed"] and not got[1000 + k]["kept"], name


def test_edges(edges, nothing):
    rows = quality_rules.judge(edges).collect()
    assert len(rows) == len(EDGES) and not any(r["kept"] and r["base_failed"] for r in rows)
    assert quality_rules.judge(nothing).count() == 0
