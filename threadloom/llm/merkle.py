"""Merkle manifest of a dataset: a tree of digests per source, one over the sources, and a proof for every row.

Nodes are labelled by nested intervals: a node carries its tree, its level and the ranks [lo, hi] of the leaves it covers.
A level is one grouping of the level below; a parent keeps its at most FANOUT children with their intervals.  Going
down, nodes of a level join the parents whose interval contains theirs, inside buckets of the level's width, so a
bucket has at most FANOUT rows whatever a source holds.  A node's siblings are what its parent's interval holds
outside its own: children that end before it starts, and children that start after it ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.ranks import position_by_range
from threadloom.sources.scratch import stage_table

FANOUT = 16
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = ""  # the tree over the sources; names of source trees are never empty
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for NULL, else the UTF-8 byte count, `:` and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: Sequence[Column]) -> Column:
    return digest(*[field(c) for c in columns])


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _joined_digests(children: Column) -> Column:
    return F.array_join(F.transform(children, lambda c: c["digest"]), "")


def _levels(leaves: DataFrame, fanout: int) -> list[DataFrame]:
    """Nodes of levels 1 and up of all trees of `leaves` (tree, lo, hi, digest), each level written once.

    A tree ends at the level where it has one node: a parent that would cover a single child from rank 0 is not made.
    Levels shrink by the fan-out, so there are as many rounds as the deepest tree has levels.
    """
    out: list[DataFrame] = []
    below, width = leaves, fanout
    while True:
        child = F.struct("lo", "hi", "digest")
        grouped = below.groupBy("tree", F.floor(F.col("lo") / F.lit(width)).cast("long").alias("bucket")).agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(child)).alias("children")
        )
        made = grouped.filter((F.col("bucket") > 0) | (F.size("children") > 1))
        made = stage_table(made.withColumn("digest", F.sha2(_joined_digests(F.col("children")), 256)), "merkle-level")
        if made.isEmpty():
            return out
        out.append(made)
        below, width = made.select("tree", "lo", "hi", "digest"), width * fanout


def _roots(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, digest) of every tree's last node: the one from rank 0 that no level above covers."""
    firsts = [f.filter("lo = 0").select("tree", "digest", F.lit(i).alias("level")) for i, f in enumerate([leaves, *levels])]
    out = firsts[0]
    for f in firsts[1:]:
        out = out.unionByName(f)
    return out.groupBy("tree").agg(F.max_by("digest", "level").alias("digest"))


def _with_paths(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """`leaves` with `path`, the siblings' digests left and right of the row's node at every level up, and tops' columns.

    tops (tree, path, ...) says what goes on above each tree.  From the last level down, nodes join the parents that
    contain them; a node without a parent is its tree's root and takes its path from tops.
    """
    facts = [c for c in tops.columns if c not in ("tree", "path")]
    above: DataFrame | None = None
    for i in range(len(levels), -1, -1):
        nodes, width = (levels[i - 1] if i else leaves), fanout ** (i + 1)
        nodes = nodes.drop("bucket") if i else nodes
        is_root = nodes.filter("lo = 0")
        if above is None:
            found = is_root.join(tops, "tree")
        else:
            parents = above.select(*[F.col(c).alias(f"p_{c}") for c in ("tree", "bucket", "lo", "hi", "children", "path")], *facts)
            near = (F.col("tree") == F.col("p_tree")) & (F.floor(F.col("lo") / F.lit(width)).cast("long") == F.col("p_bucket"))
            under = nodes.join(parents, near & (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi")))
            left = _joined_digests(F.filter("p_children", lambda c: c["hi"] < F.col("lo")))
            right = _joined_digests(F.filter("p_children", lambda c: c["lo"] > F.col("hi")))
            step = F.array(F.struct(left.alias("left"), right.alias("right"))).cast(PATH)
            under = under.withColumn("path", F.concat(step, F.col("p_path"))).select(*nodes.columns, "path", *facts)
            alone = is_root.join(levels[i].filter("lo = 0").select("tree"), "tree", "left_anti").join(tops, "tree")
            found = under.unionByName(alone.select(*nodes.columns, "path", *facts))
        above = found.withColumn("bucket", F.floor(F.col("lo") / F.lit(fanout**i)).cast("long")) if i else found
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf digest and its siblings lead to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """One digest over all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def manifest(docs: DataFrame, tampered_text: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, path (array of left and right sibling digests, leaf to root), tampered (a digest).

    Takes doc_id, source, lang, n_chars and text of `docs`; other columns are not read.  A leaf is the digest of these
    five, NULL in any of them as `-`, an empty text as `0:`.  NULL is a source like any other and comes first; inside a
    source, leaves go by doc_id (NULL first), then by digest, so repeated rows are leaves of their own, side by side.
    A source of one row has that leaf as its subroot; a table of one source has that subroot as its root.  An empty table
    gives no rows.  `tampered_text` is an expression over the five columns, NULL where a row is left as it is; its leaf's
    digest comes out beside the original one.  Texts are read once and only digests are shuffled.
    """
    five = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *LEAF_COLUMNS[1:])
    other = F.lit(None).cast("string")
    if tampered_text is not None:
        changed = leaf_digest([*[F.col(c) for c in LEAF_COLUMNS[:-1]], tampered_text])
        other = F.when(tampered_text.isNotNull(), changed)
    name = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("s"), F.col("source")))
    hashed = five.select(
        name.alias("tree"), "doc_id", leaf_digest([F.col(c) for c in LEAF_COLUMNS]).alias("digest"), other.alias("tampered"),
        F.monotonically_increasing_id().alias("_row"),  # parts the copies of a row that is there very often
    )
    at = position_by_range(hashed, ["tree"], ["doc_id", "digest", "_row"], "lo")
    leaves = stage_table(at.select("tree", "lo", F.col("lo").alias("hi"), "digest", "doc_id", "tampered"), "merkle-leaves")
    levels = _levels(leaves.select("tree", "lo", "hi", "digest"), fanout)
    subroots = stage_table(_roots(leaves, levels), "merkle-subroots")

    tops = position_by_range(subroots.withColumnRenamed("tree", "name"), [], ["name"], "lo")
    tops = stage_table(tops.select(F.lit(TOP).alias("tree"), "lo", F.col("lo").alias("hi"), "digest", "name"), "merkle-top")
    top_levels = _levels(tops.select("tree", "lo", "hi", "digest"), fanout)
    root = _roots(tops, top_levels).select("tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    sources = _with_paths(tops, top_levels, root, fanout).select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    out = _with_paths(leaves, levels, sources, fanout)
    return out.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", "tampered")


def verify(proofs: DataFrame) -> DataFrame:
    """`manifest` rows with proof_sha256, folded_root (from the tampered leaf, else the original one) and verified."""
    out = proofs.withColumn("proof_sha256", proof_digest(F.col("path")))
    out = out.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
