import random
import re

from llm_cases import frame
from threadloom.llm import licenses

NOTICE = licenses.TEMPLATES[5][1]


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain_shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_matches_against_brute_force(spark):
    rnd = random.Random(1)
    filler = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(250):
        words = rnd.choices(filler, k=rnd.randint(0, 60))
        if i % 3:
            notice = rnd.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rnd.choice([0, 0, 1, 2])):
                notice[rnd.randrange(len(notice))] = "changed"
            at = rnd.randint(0, len(words))
            words[at:at] = notice
        rows.append((i, " ".join(words), "en"))
    got = {(r["doc_id"], r["template"]): r["containment"] for r in licenses.scan(frame(spark, rows)).collect()}
    want = {}
    for i, text, _ in rows:
        have = plain_shingles(plain_words(text))
        for k, (_, template) in enumerate(licenses.TEMPLATES):
            own = plain_shingles(plain_words(template))
            if len(have & own) / len(own) >= licenses.CONTAINMENT:
                want[(i, k)] = len(have & own) / len(own)
    assert got == want and len(want) > 80


def test_bands_make_a_miss_unlikely():
    # one shingle of a template among three others in a window: the least likely case
    assert licenses.collision_probability(1 / 4) > 0.9998 and licenses.collision_probability(0.8) > 1 - 1e-12


def test_edges(spark, edges, nothing):
    assert licenses.scan(edges).count() == 0 and licenses.scan(nothing).count() == 0
    rows = [(1, NOTICE.upper() + "!!", "en"), (1, NOTICE, "en"), (None, f"x {NOTICE} y", None), (2, "word " * 30_000 + NOTICE, "en"), (3, NOTICE[:60], "en")]
    got = sorted((str(r["doc_id"]), r["license"], r["containment"]) for r in licenses.scan(frame(spark, rows)).collect())
    assert got == [("1", "GPL", 1.0), ("2", "GPL", 1.0), ("None", "GPL", 1.0)]
    assert licenses.scan(edges, templates=[("short", "two words")]).count() == 0


def test_a_notice_in_parts_far_from_each_other_counts_whole(spark):
    words = NOTICE.split()
    far = " ".join(f"w{i}" for i in range(300))
    parts = " ".join([*words[:20], far, *words[16:]])  # all shingles, in two places
    half = " ".join(words[: len(words) // 2])
    rows = [(1, f"{far} {parts} {far}", "en"), (2, half, "en"), (2, NOTICE, "en"), (3, half, "en"), (3, " ".join(words[len(words) // 2 :]), "en")]
    got = {(r["doc_id"], r["license"]): (r["containment"], r["start"]) for r in licenses.scan(frame(spark, rows)).collect()}
    assert set(got) == {(1, "GPL"), (2, "GPL")} and all(c == 1.0 for c, _ in got.values())
    assert 290 <= got[(1, "GPL")][1] <= 302 and got[(2, "GPL")][1] == 0
