import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from llm_cases import DOCS, EDGES, frame
from threadloom.llm import merkle
from threadloom.llm.queries import QUERIES


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def lower(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def fold(nodes, fanout):
    """Root, and for every leaf its (left, right) siblings from its level up."""
    paths, spans = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, covered = [], []
        for at in range(0, len(nodes), fanout):
            run = nodes[at : at + fanout]
            for j in range(len(run)):
                for leaf in spans[at + j]:
                    paths[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(h(*run))
            covered.append([x for s in spans[at : at + fanout] for x in s])
        nodes, spans = up, covered
    return nodes[0], paths


def plain(rows, fanout, tampers):
    """Sorted result rows of (doc_id, source, lang, n_chars, text) rows, by the definition."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((r[0], plain_leaf(*r), plain_leaf(*r[:4], lower(r[4])) if tampers(r[0]) else None))
    names = sorted(by_source, key=lambda s: b"" if s is None else b"s" + s.encode())
    trees = []
    for s in names:
        leaves = sorted(by_source[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append((leaves, *fold([x[1] for x in leaves], fanout)))
    root, tops = fold([t[1] for t in trees], fanout) if trees else (None, [])
    out = []
    for (leaves, subroot, paths), top in zip(trees, tops):
        for (doc_id, leaf, changed), path in zip(leaves, paths):
            whole, node = path + top, changed or leaf
            for left, right in whole:
                node = h(left, node, right)
            out.append((doc_id, leaf, subroot, root, h(*[a + b for a, b in whole]), node, node == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
FIVE = ["doc_id", "source", "lang", "n_chars", "text"]


def tampers(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def check(df, fanout=merkle.FANOUT):
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.lower_ascii(F.col("text")))
    got = merkle.verify(merkle.manifest(df, changed, fanout)).select(*COLUMNS).collect()
    want = plain([tuple(r) for r in df.select(*FIVE).collect()], fanout, tampers)
    assert sorted(map(tuple, got), key=str) == want
    return got


@pytest.mark.parametrize("fanout", [4, 16])
def test_trees_of_all_depths(spark, fanout):
    rnd = random.Random(fanout)
    rows = []
    for source, n in [("hot", 300), ("a", 16), ("b", 17), ("c", 1), ("ä", 33), ("", 2), (None, 5)]:
        rows += [(rnd.randrange(200), f"Text {rnd.random()} É", rnd.choice(["en", None]), source, rnd.choice([None, 4]), "w", 1, 2, 0.5, "k") for _ in range(n)]
    got = check(spark.createDataFrame(rows, DOCS).repartition(7), fanout)
    assert 0 < sum(r["verified"] for r in got) < len(got)


def test_edges(edges):
    # Rows that are the same in all five columns have the same leaf, and each is a leaf of its own.
    assert len(check(edges)) == len(EDGES)


def test_lone_source_and_lone_row(spark):
    assert check(frame(spark, [(5, "One", "en")]))[0]["verified"]  # the root is the leaf, the proof is empty
    assert len(check(spark.createDataFrame([(i, "T", "en", "s", 1, "w", 1, 2, 0.5, "k") for i in range(40)], DOCS))) == 40
    assert len(check(spark.createDataFrame([(i, "T", "en", f"s{i}", 1, "w", 1, 2, 0.5, "k") for i in range(40)], DOCS))) == 40


def test_one_row_very_often(spark):
    got = check(spark.createDataFrame([(0, "Same", "en", "s", 4, "w", 1, 2, 0.5, "k")] * 500, DOCS).repartition(5))
    assert len(got) == 500 and len({r["leaf"] for r in got}) == 1


def test_empty(nothing):
    assert check(nothing) == []


def test_any_changed_column_is_noticed(spark):
    df = frame(spark, [(i, f"text {i}", "en") for i in range(50)])
    before = merkle.manifest(df).select("root").first()[0]
    for name, value in [("text", "x"), ("lang", None), ("source", "s9"), ("n_chars", 1), ("doc_id", 77)]:
        kind = df.schema[name].dataType
        other = df.withColumn(name, F.when(F.col("doc_id") == 7, F.lit(value).cast(kind)).otherwise(F.col(name)))
        assert merkle.manifest(other).select("root").first()[0] != before


def test_registered():
    assert "op13_merkle_manifest" in QUERIES
