"""Top-k similarity retrieval over an index, exact and without pairing every query with every row.

1. Rows with equal vectors are reduced to the few smallest ids that can be cited, equal queries to one.
2. The index is cut into shards of bounded size, in the order of the rows' heaviest terms, so that a shard holds rows
   about few things.  Shards and what describes them are made once and kept with the index: the largest weight per
   shard and term, the shard with most rows led by a term, the largest weight per term.
3. A query first visits one shard, the home of its heaviest term.  Its k-th similarity there is its own threshold.
4. Terms are then taken rarest first: frequent terms whose largest weights together stay below the threshold bring no
   shard in.  Of the shards the others lead to, those whose largest weights add up to the threshold are visited.
5. A visited shard scores its queries in numpy, a bounded block at a time, and returns only each query's best rows.
   Pairs exist only inside that block and never cross the network.  Single precision, a matrix product for the shard's
   frequent terms and postings for the others, tells which pairs may reach the threshold; these are added up in double
   precision.  The best rows of all shards are merged per query.

Dense vectors go the same way with cells instead of terms: a query is scored in its nearest cell first, and skips each
cell that the triangle inequality puts below its threshold.

Nothing is capped: the threshold and k are the query's own, and the bounds only skip what cannot appear.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions import values as V
from threadloom.functions.scoring import rounded
from threadloom.operators.features import fit, packed_counts, vectors
from threadloom.operators.ranks import position_by_range
from threadloom.sources.scratch import stage_table

# The scoring functions travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARD_ROWS = 32_768  # a query that goes on to a shard is copied once for so many rows
QUERY_ROWS = 16_384  # and a shard's row once for so many queries
DENSE_ROWS = 32_768  # rows, and queries, of dense vectors that a task brings together
CITABLE = 16  # a stored index answers up to this k from its shards as they are
BLOCK_CELLS = 4_000_000
FREQUENT_PART = 50  # terms in more than one of so many rows of a shard are multiplied as a matrix, the most frequent
FREQUENT_TERMS = 64  # so many at most
MAX_PIVOTS = 4_096  # pivots of dense cells that travel with the task code
RANK_DIGITS = 8  # similarities equal to 8 digits are ties, settled by the smaller id
SLACK = 1e-7
HITS = (
    "array<struct<tweet_id:bigint,customer_tweet_id:bigint,brand_tweet_id:bigint,"
    "customer_text:string,brand_reply_text:string,similarity:double>>"
)


def _place_in(groups: np.ndarray) -> np.ndarray:
    """Place of every element among equal, adjacent ones, from 0."""
    first = np.r_[True, groups[1:] != groups[:-1]] if len(groups) else np.zeros(0, bool)
    return np.arange(len(groups)) - np.maximum.accumulate(np.where(first, np.arange(len(groups)), 0))


def _best(part: pd.DataFrame, docs: pd.DataFrame, q: np.ndarray, d: np.ndarray, s: np.ndarray, k: int, per_owner: int) -> pd.DataFrame:
    """The k best rows of each query, at most `per_owner` of one owner: similarity down, ids up."""
    ids, owners = docs["doc_id"].to_numpy(), docs["owner_id"].to_numpy()
    order = np.lexsort((owners[d], ids[d], -np.round(s, RANK_DIGITS), q))
    if per_owner < k:
        _, owner = np.unique(owners[d[order]], return_inverse=True)
        pair = q[order] * (owner.max(initial=0) + 1) + owner
        together = np.argsort(pair, kind="stable")
        allowed = np.zeros(len(order), bool)
        allowed[together] = _place_in(pair[together]) < per_owner
        order = order[allowed]
    keep = order[_place_in(q[order]) < k]
    return pd.DataFrame(
        {"query_id": part["query_id"].to_numpy()[q[keep]], "doc_id": ids[d[keep]], "owner_id": owners[d[keep]], "sim": s[keep]}
    )


def _empty() -> pd.DataFrame:
    none = np.zeros(0, np.int64)
    return pd.DataFrame({"query_id": none, "doc_id": none, "owner_id": none, "sim": np.zeros(0)})


def _flat(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms and weights of all rows, one after the other, and the number of terms of each row."""
    return np.concatenate(rows["term_ids"].to_numpy()), np.concatenate(rows["weights"].to_numpy()), rows["term_ids"].map(len).to_numpy()


def _ranges(begin: np.ndarray, sizes: np.ndarray, most: int):
    """(first range, end, positions, range of each) of ranges of positions, about `most` positions at a time."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        h = sizes[lo:hi]
        yield lo, hi, np.repeat(begin[lo:hi] - (np.cumsum(h) - h), h) + np.arange(h.sum()), np.repeat(np.arange(lo, hi), h)
        lo = hi


def _sparse_scorer(k: int, per_owner: int):
    def score(queries: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or docs.empty:
            return _empty()
        nd = len(docs)
        t, w, sizes = _flat(docs)
        first_of = np.cumsum(sizes) - sizes  # of each row, its first term in t
        longest = np.sqrt(np.bincount(np.repeat(np.arange(nd), sizes), w * w, nd).max())
        by_term = np.argsort(t, kind="stable")
        pt, pw, pd_ = t[by_term], w[by_term].astype(np.float32), np.repeat(np.arange(nd), sizes)[by_term]
        terms, df = np.unique(pt, return_counts=True)
        most = np.argsort(-df, kind="stable")[:FREQUENT_TERMS]
        frequent = np.sort(terms[most[df[most] * FREQUENT_PART > nd]])

        def split(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Row of each term among the frequent ones, and whether it is one."""
            if not len(frequent):
                return np.zeros(len(of), np.int64), np.zeros(len(of), bool)
            at = np.minimum(np.searchsorted(frequent, of), len(frequent) - 1)
            return at, frequent[at] == of

        at, often = split(pt)
        matrix = np.zeros((len(frequent), nd), np.float32)
        np.add.at(matrix, (at[often], pd_[often]), pw[often])
        pt, pw, pd_ = pt[~often], pw[~often], pd_[~often]
        out = []
        step = max(1, BLOCK_CELLS // nd)
        for lo in range(0, len(queries), step):
            part = queries.iloc[lo : lo + step]
            qt, qw, qn = _flat(part)
            qi = np.repeat(np.arange(len(part)), qn)
            at, often = split(qt)
            asked = np.zeros((len(part), len(frequent)), np.float32)
            np.add.at(asked, (qi[often], at[often]), qw[often].astype(np.float32))
            cells = (asked @ matrix).ravel()
            rt, rw, ri = qt[~often], qw[~often].astype(np.float32), qi[~often]
            begin = np.searchsorted(pt, rt, "left")
            # Posting entries are expanded a bounded number at a time.
            for _, _, pos, entry in _ranges(begin, np.searchsorted(pt, rt, "right") - begin, BLOCK_CELLS):
                np.add.at(cells, ri[entry] * nd + pd_[pos], rw[entry] * pw[pos])
            # What n additions in single precision can lose.
            lost = np.finfo(np.float32).eps * (qn + 8) * np.maximum(1.0, np.sqrt(np.bincount(qi, qw * qw, len(part))) * longest)
            least = part["floor"].to_numpy() - SLACK
            near = np.flatnonzero((cells.reshape(len(part), nd) >= (least - lost).astype(np.float32)[:, None]).ravel())
            gq, gd = near // nd, near % nd
            sims = _exact(qt, qw, qi, t, w, gq, first_of[gd], sizes[gd])
            good = sims >= least[gq]
            out.append(_best(part, docs, gq[good], gd[good], sims[good], k, per_owner))
        return pd.concat(out)

    return score


def _exact(qt: np.ndarray, qw: np.ndarray, qi: np.ndarray, t: np.ndarray, w: np.ndarray, q: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Products of the pairs of query q and the row whose `sizes` terms begin at `begin`."""
    out = np.zeros(len(q))
    span = int(max(qt.max(initial=0), t.max(initial=0))) + 1
    keys = qi.astype(np.int64) * span + qt
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], qw[order]
    for lo, hi, pos, pair in _ranges(begin, sizes, BLOCK_CELLS):
        asked = q[pair] * span + t[pos]
        at = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
        hit = keys[at] == asked if len(keys) else np.zeros(len(at), bool)
        out[lo:hi] = np.bincount(pair[hit] - lo, weights[at[hit]] * w[pos[hit]], hi - lo)
    return out


def _dense_scorer(k: int, per_owner: int):
    def score(queries: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or docs.empty:
            return _empty()
        d = np.vstack(docs["vector"].to_numpy())
        out = []
        step = max(1, BLOCK_CELLS // len(docs))
        for lo in range(0, len(queries), step):
            part = queries.iloc[lo : lo + step]
            sims = np.vstack(part["vector"].to_numpy()) @ d.T
            gq, gd = np.nonzero(sims >= part["floor"].to_numpy()[:, None] - SLACK)
            out.append(_best(part, docs, gq, gd, sims[gq, gd], k, per_owner))
        return pd.concat(out)

    return score


def _represented(queries: DataFrame, digest) -> DataFrame:
    """Queries with `rep_id`, the smallest id among those with an equal vector.

    What follows reads the queries several times, so they are written once.
    """
    q = stage_table(queries.withColumn("_digest", digest), "queries")
    reps = q.groupBy("_digest").agg(F.min("query_id").alias("rep_id"))
    return q.join(reps, "_digest").drop("_digest")


def _score_shards(routes: DataFrame, queries: DataFrame, docs: DataFrame, payload: Sequence[str], scorer, query_rows: int) -> DataFrame:
    """Bring each shard together with its queries (query_id, floor, payload) and keep the best rows per query and shard.

    A shard that many queries visit is copied to several tasks, each with at most about `query_rows` of them.
    """
    parts = routes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(query_rows))).cast("int").alias("parts"))
    # The key columns are named apart: both sides come from the same shard frame.
    q = routes.select("query_id", "shard", "floor").join(parts, "shard").join(queries, "query_id").select(
        F.col("shard").alias("q_shard"), F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("q_part"),
        "query_id", "floor", *[F.col(c).alias(c) for c in payload],
    )
    copies = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    d = docs.join(parts, "shard").select(
        F.col("shard").alias("d_shard"), copies.alias("d_part"), "doc_id", "owner_id", *[F.col(c).alias(c) for c in payload]
    )
    return q.groupBy("q_shard", "q_part").cogroup(d.groupBy("d_shard", "d_part")).applyInPandas(
        scorer, "query_id long, doc_id long, owner_id long, sim double"
    )


def _ranked(scored: DataFrame, k: int, per_owner: int) -> DataFrame:
    """The k best rows of each query over all shards, at most `per_owner` of one owner, with their place `rn`."""
    order = (F.desc(F.round("sim", RANK_DIGITS)), "doc_id", "owner_id")
    if per_owner < k:
        of_owner = W.partitionBy("query_id", "owner_id").orderBy(*order)
        scored = scored.withColumn("_own", F.row_number().over(of_owner)).filter(F.col("_own") <= per_owner).drop("_own")
    w = W.partitionBy("query_id").orderBy(*order)
    return scored.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def _floors(queries: DataFrame, seeds: DataFrame, k: int, min_sim: float) -> DataFrame:
    """(query_id, floor): the k-th similarity a query has found, or min_sim.  Rows below cannot be among its best."""
    found = seeds.filter(F.col("rn") == k).select("query_id", F.col("sim").alias("_kth"))
    return queries.select("query_id").join(found, "query_id", "left").select("query_id", F.greatest(F.lit(float(min_sim)), "_kth").alias("floor"))


def _citable(docs: DataFrame, digest: str, k: int, own_rows: int) -> DataFrame:
    """Of rows with equal vectors only the smallest ids can be among the best: own_rows per owner, k in all."""
    per_owner = W.partitionBy(digest, "owner_id").orderBy("doc_id")
    per_vector = W.partitionBy(digest).orderBy("doc_id", "owner_id")
    return (
        docs.withColumn("_a", F.row_number().over(per_owner)).filter(F.col("_a") <= own_rows)
        .withColumn("_b", F.row_number().over(per_vector)).filter(F.col("_b") <= k).drop("_a", "_b")
    )


def _merge_per_query(queries: DataFrame, best: DataFrame, k: int, min_sim: float, exclude_self: bool) -> DataFrame:
    """Give every original query the hits of its vector, without its own rows, as an array of (doc_id, owner_id, similarity)."""
    hits = best.groupBy(F.col("query_id").alias("rep_id")).agg(
        F.array_sort(F.collect_list(F.struct("rn", "doc_id", "owner_id", "sim"))).alias("hits")
    )
    found = queries.join(hits, "rep_id")
    mine = F.filter("hits", lambda h: h["owner_id"] != F.col("query_id")) if exclude_self else F.col("hits")
    good = F.filter(mine, lambda h: F.round(h["sim"], RANK_DIGITS) >= min_sim)
    return found.select("query_id", F.slice(good, 1, k).alias("hits")).filter(F.size("hits") > 0).select(
        "query_id", F.transform("hits", lambda h: F.struct(h["doc_id"], h["owner_id"], rounded(h["sim"], 4).alias("similarity"))).alias("hits")
    )


def _pair_digest(*columns: str) -> Column:
    """Two independent hashes: a pair of different vectors sharing both does not happen in practice."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *reversed(columns)).alias("b"))


def _entries(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per term of a vector."""
    pair = F.explode(F.arrays_zip("term_ids", "weights"))
    return rows.select(*keep, pair.alias("e")).select(*keep, F.col("e.term_ids").alias("term_id"), F.col("e.weights").alias("weight"))


@dataclass
class Shards:
    """Rows cut into shards, and what tells which shards a query has to visit; homes and tops are small sums over the others."""

    rows: DataFrame  # shard, doc_id, owner_id, term_ids, weights
    bounds: DataFrame  # shard, term_id, top_weight: the largest weight
    homes: DataFrame  # term_id, shard, led: the shard with most rows whose heaviest term it is
    tops: DataFrame  # term_id, top_weight, shards: the largest weight in any shard, and how many have the term

    TABLES = ("rows", "bounds", "homes", "tops")


def cut_shards(docs: DataFrame, shard_rows: int = SHARD_ROWS, citable: int = CITABLE, part: int = 0) -> Shards:
    """RET1: cut rows (doc_id, owner_id, term_ids, weights) into shards of `shard_rows`, for queries of k up to `citable`.

    Rows are ordered by their three heaviest terms, so that neighbours are alike; a term that leads a third of all
    rows has shards by its second and third.  Of rows with equal vectors the `citable` smallest ids of each owner, and
    twice as many in all, are kept: no query of such k can cite another.  `part` sets the shard numbers apart.
    """
    d = _citable(docs.withColumn("_digest", _pair_digest("term_ids", "weights")), "_digest", 2 * citable, citable).drop("_digest")
    by_weight = F.array_sort(F.transform(F.arrays_zip("term_ids", "weights"), lambda e: F.struct((-e["weights"]).alias("w"), e["term_ids"].alias("t"))))
    d = d.withColumn("_heavy", F.transform(F.slice(by_weight, 1, 3), lambda e: e["t"]))
    placed = position_by_range(d, [], ["_heavy", "doc_id", "owner_id"])
    shard = F.lit(part << 32).cast("long") + F.floor(F.col("position") / F.lit(shard_rows))
    cut = stage_table(placed.select(shard.alias("shard"), F.get("_heavy", 0).alias("lead"), "doc_id", "owner_id", "term_ids", "weights"), "shards")
    rows = cut.drop("lead")
    bounds = stage_table(_entries(rows, "shard").groupBy("shard", "term_id").agg(F.max("weight").alias("top_weight")), "bounds")
    led = cut.groupBy(F.col("lead").alias("term_id"), "shard").agg(F.count(F.lit(1)).alias("led"))
    homes = led.groupBy("term_id").agg(F.max_by("shard", F.struct("led", "shard")).alias("shard"), F.max("led").alias("led"))
    tops = bounds.groupBy("term_id").agg(F.max("top_weight").alias("top_weight"), F.count(F.lit(1)).alias("shards"))
    return Shards(rows, bounds, homes, tops)


def home_shards(queries: DataFrame, shards: Shards) -> DataFrame:
    """(query_id, shard): the home of the heaviest term of a query that has one."""
    at_home = _entries(queries, "query_id").join(shards.homes, "term_id")
    return at_home.groupBy("query_id").agg(F.max_by("shard", F.struct("weight", "led", "shard")).alias("shard"))


def routes(queries: DataFrame, floors: DataFrame, shards: Shards) -> DataFrame:
    """(query_id, shard, floor) of all shards that may hold a row as similar as the query's floor.

    Per query, terms are added up from the one in most shards on, each with its largest weight anywhere; while the sum
    stays below the floor, a shard with these terms only cannot reach it, so only the rarer terms lead to shards.  What
    the frequent terms can add is first taken as this sum, then, for the shards left, as the shard's own largest weights.
    """
    tops = shards.tops.groupBy("term_id").agg(F.max("top_weight").alias("most"), F.sum("shards").alias("shards"))
    known = _entries(queries, "query_id").join(tops, "term_id").join(floors, "query_id")
    frequent_first = W.partitionBy("query_id").orderBy(F.desc("shards"), "term_id").rowsBetween(W.unboundedPreceding, 0)
    summed = known.withColumn("sum", F.sum(F.col("weight") * F.col("most")).over(frequent_first)).withColumn("leads", F.col("sum") >= F.col("floor") - SLACK)
    terms = stage_table(summed.select("query_id", "term_id", "weight", "floor", "sum", "leads"), "query-terms")
    rest = terms.filter(~F.col("leads")).groupBy("query_id").agg(F.max("sum").alias("rest"))
    led = terms.filter("leads").join(shards.bounds, "term_id").groupBy("query_id", "shard").agg(
        F.sum(F.col("weight") * F.col("top_weight")).alias("sum"), F.first("floor").alias("floor")
    )
    near = led.join(rest, "query_id", "left").filter(F.col("sum") + F.coalesce("rest", F.lit(0.0)) >= F.col("floor") - SLACK).drop("rest")
    others = terms.filter(~F.col("leads")).select("query_id", "term_id", "weight")
    more = near.select("query_id", "shard").join(others, "query_id").join(shards.bounds, ["shard", "term_id"]).groupBy("query_id", "shard").agg(
        F.sum(F.col("weight") * F.col("top_weight")).alias("more")
    )
    reach = near.join(more, ["query_id", "shard"], "left").filter(F.col("sum") + F.coalesce("more", F.lit(0.0)) >= F.col("floor") - SLACK)
    return reach.select("query_id", "shard", "floor")


def topk_sharded(
    queries: DataFrame, shards: Shards, k: int = V.TOP_K, min_sim: float = V.MIN_SIMILARITY, exclude_self: bool = False, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """JON12, WIN3: for every query (query_id, term_ids, weights) its k nearest rows by dot product, at least min_sim;
    (query_id, hits array).  k may be what the shards were cut for, at most.

    `exclude_self` leaves out rows whose owner_id is the query's id.  Equal queries share one list, which then holds
    2k rows but at most k of one owner: whichever owner a query leaves out, k others are left.  Vectors must have unit length and
    non-negative weights.
    """
    kk = 2 * k if exclude_self else k
    q = _represented(queries, _pair_digest("term_ids", "weights"))
    distinct_q = q.filter("query_id = rep_id").select("query_id", "term_ids", "weights")
    score = lambda where: _score_shards(where, distinct_q, shards.rows, ["term_ids", "weights"], _sparse_scorer(kk, k), query_rows)
    home = home_shards(distinct_q, shards).withColumn("floor", F.lit(float(min_sim)))
    seeds = stage_table(_ranked(score(home), kk, k), "seeds")
    onward = routes(distinct_q, _floors(distinct_q, seeds, kk, min_sim), shards).join(home.select("query_id", "shard"), ["query_id", "shard"], "left_anti")
    best = _ranked(seeds.drop("rn").unionByName(score(stage_table(onward, "routes"))), kk, k)
    return _merge_per_query(q.select("query_id", "rep_id"), best, k, min_sim, exclude_self)


def topk_sparse(
    queries: DataFrame, docs: DataFrame, k: int = V.TOP_K, min_sim: float = V.MIN_SIMILARITY, exclude_self: bool = False,
    shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """JON12, WIN3: `topk_sharded` over rows (doc_id, owner_id, term_ids, weights) that are cut for this call."""
    return topk_sharded(queries, cut_shards(docs, shard_rows, k), k, min_sim, exclude_self, query_rows)


def _unit(df: DataFrame) -> DataFrame:
    """Vectors of unit length; those that are NULL, empty, zero or hold a NULL or a number that is not finite take no part."""
    x = F.transform("vector", lambda x: x.cast("double"))
    squares = F.aggregate(x, F.lit(0.0), lambda a, y: a + y * y)
    norm = df.withColumn("_n", F.sqrt(squares)).filter((F.col("_n") > 0) & (F.col("_n") < F.lit(float("inf"))))
    return norm.withColumn("vector", F.transform("vector", lambda x: x.cast("double") / F.col("_n"))).drop("_n")


def _to_pivots(pivots: dict[int, np.ndarray], lists: bool):
    """Nearest pivot of every row, or all pivots of a query with their angles; pivots are those of the vector's length."""

    def angles(batches):
        for b in batches:
            for size, rows in b.groupby(b["vector"].map(len)):
                p = pivots.get(size)
                if p is None:
                    continue
                angle = np.arccos(np.clip(np.vstack(rows["vector"].to_numpy()) @ p.T, -1, 1))
                if lists:
                    yield pd.DataFrame({"query_id": rows["query_id"].to_numpy(), "size": size, "angles": list(angle)})
                else:
                    near = angle.argmin(1)
                    yield rows.assign(size=size, cell=near, angle=angle[np.arange(len(rows)), near])[["doc_id", "owner_id", "vector", "size", "cell", "angle"]]

    return angles


def topk_dense(
    queries: DataFrame, docs: DataFrame, k: int = V.TOP_K, min_sim: float = V.MIN_SIMILARITY, exclude_self: bool = False,
    pivots: int | None = None, query_rows: int = DENSE_ROWS, group_rows: int = DENSE_ROWS,
) -> DataFrame:
    """RET3: the same contract for dense vectors: queries (query_id, vector), docs (doc_id, owner_id, vector).

    Rows lie in the cell of their nearest pivot; pivots are about the square root of the rows, drawn by hash, at most
    MAX_PIVOTS.  A cell is described by its largest and smallest angle to the pivot.  A query is compared with the pivots,
    searched in its nearest cell first, and visits only cells that by the triangle inequality can hold a row as similar as
    its k-th there.  Cells to visit are taken in groups of about `group_rows` rows, so that a query is copied once per group and
    a row once per `query_rows` queries, not once per cell.  Vectors of different length do not meet; those of _unit's exceptions take no part.
    """
    kk = 2 * k if exclude_self else k
    q, d = _unit(queries), _unit(docs)
    d = stage_table(_citable(d.withColumn("_digest", _pair_digest("vector")), "_digest", kk, k).drop("_digest"), "rows")
    q = _represented(q, _pair_digest("vector"))
    distinct_q = q.filter("query_id = rep_id").select("query_id", "vector")
    n = pivots or int(min(MAX_PIVOTS, max(1, round(d.count() ** 0.5))))
    # A bounded number of pivots comes to the driver and goes out with the task code.
    drawn = [r[0] for r in d.orderBy(F.md5(F.col("doc_id").cast("string")), "owner_id").select("vector").limit(n).collect()]
    sizes = [r[0] for r in d.select(F.size("vector")).distinct().limit(MAX_PIVOTS + 1).collect()]
    if len(sizes) > MAX_PIVOTS:
        raise ValueError("vectors of so many lengths have no common space")
    by_size: dict[int, list] = {s: [v for v in drawn if len(v) == s] for s in sizes}
    pivot_rows = {s: np.array(v) if v else np.eye(1, s) for s, v in by_size.items()}

    placed = d.mapInPandas(_to_pivots(pivot_rows, False), "doc_id long, owner_id long, vector array<double>, size int, cell int, angle double")
    rows = stage_table(placed.withColumn("shard", F.concat_ws(":", "size", "cell")), "cells")
    reach = rows.groupBy("shard", "size", "cell").agg(F.max("angle").alias("far"), F.min("angle").alias("close"), F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("size").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)  # a row per cell
    number = F.floor(F.coalesce(F.sum("n").over(earlier), F.lit(0)) / F.lit(group_rows))
    reach = F.broadcast(stage_table(reach.withColumn("group", F.concat_ws("/", "size", number)).drop("n"), "reach"))
    grouped = rows.join(reach.select("shard", "group"), "shard").drop("shard").withColumnRenamed("group", "shard")
    seen = stage_table(distinct_q.mapInPandas(_to_pivots(pivot_rows, True), "query_id long, size int, angles array<double>"), "angles")
    score = lambda where, docs: _score_shards(where, distinct_q, docs, ["vector"], _dense_scorer(kk, k), query_rows)
    nearest = F.array_position("angles", F.array_min("angles")) - 1
    home = stage_table(seen.select("query_id", F.concat_ws(":", "size", nearest).alias("shard"), F.lit(float(min_sim)).alias("floor")), "homes-asked")
    seeds = stage_table(_ranked(score(home, rows), kk, k), "seeds")
    asked = seen.join(_floors(distinct_q, seeds, kk, min_sim), "query_id").select(
        "query_id", "size", "floor", nearest.alias("nearest"), F.count(F.lit(1)).over(W.partitionBy("query_id")).alias("times"), "angles"
    )
    asked = asked.select("query_id", "size", "floor", "nearest", "times", F.posexplode("angles").alias("cell", "angle")
    )
    gap = F.greatest(F.lit(0.0), F.col("angle") - F.col("far"), F.col("close") - F.col("angle"))
    near = asked.join(reach, ["size", "cell"]).filter(F.cos(gap) >= F.col("floor") - SLACK)
    onward = near.groupBy("query_id", F.col("group").alias("shard")).agg(
        F.first("floor").alias("floor"), F.first("times").alias("times"), F.max(F.col("cell") != F.col("nearest")).alias("others")
    )
    # A query that goes on meets its home cell again, in its group, so what it found there is dropped; repeated ids stay repeated.
    goes_on = onward.withColumn("others", F.max("others").over(W.partitionBy("query_id"))).filter("others")
    onward = stage_table(goes_on.select("query_id", "shard", "floor", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("col"), "routes")
    seeds = seeds.join(onward.select("query_id").distinct(), "query_id", "left_anti")
    best = _ranked(seeds.drop("rn").unionByName(score(onward, grouped)), kk, k)
    return _merge_per_query(q.select("query_id", "rep_id"), best, k, min_sim, exclude_self)


def english_stop_words() -> list[str]:
    """MLlib's English stop words."""
    return StopWordsRemover.loadDefaultStopWords("english")


class ThreadIndex:
    """RET1, SNK4: vocabulary, row vectors, row texts and shards of the usable threads, as staged or stored tables.

    A stored index is a folder: the vocabulary, one manifest row per part, and per part the vectors, texts and shard
    tables.  Parts are added with `append`; nothing that is stored is read or written again for that.
    """

    def __init__(self, vocab: DataFrame, rows: DataFrame, docs: DataFrame, stop_words: Sequence[str], max_terms: int | None, shards: Shards | None = None, citable: int = CITABLE):
        self.vocab, self.rows, self.docs = vocab, rows, docs
        self.stop_words, self.max_terms = tuple(stop_words), max_terms
        self.citable = citable
        self.shards = cut_shards(rows, citable=citable) if shards is None else shards

    @staticmethod
    def _texts(usable_threads: DataFrame) -> DataFrame:
        """A thread is known by its brand reply (doc_id) and its customer message (owner_id)."""
        return usable_threads.select(
            F.col("brand_tweet_id").alias("doc_id"), F.col("customer_tweet_id").alias("owner_id"),
            "customer_tweet_id", "customer_text", "brand_tweet_id", "brand_reply_text", "response_time_minutes",
        )

    @staticmethod
    def _keyed(docs: DataFrame) -> DataFrame:
        return docs.select(F.struct("doc_id", "owner_id").alias("thread"), "customer_text")

    @classmethod
    def build(
        cls, usable_threads: DataFrame, stop_words: Sequence[str] | None = None, max_terms: int | None = V.MAX_INDEX_TERMS, min_df: int = V.MIN_DOC_FREQ
    ) -> ThreadIndex:
        """RET1: index the customer texts of threads, one row per thread.

        Each part of the index is written once, as queries read them many times.  Stop words are English ones unless given.
        """
        stop_words = english_stop_words() if stop_words is None else stop_words
        docs = stage_table(cls._texts(usable_threads), "docs")
        counts, vocab = fit(cls._keyed(docs), "thread", "customer_text", stop_words, True, min_df, max_terms)
        vocab = stage_table(vocab, "vocab")
        rows = stage_table(vectors(counts, vocab, "thread", max_terms).select("thread.*", "term_ids", "weights"), "rows")
        return cls(vocab, rows, docs, stop_words, max_terms)

    def _write_part(self, path: str, part: int, rows: DataFrame, docs: DataFrame, shards: Shards) -> None:
        """The part's tables, then its manifest row: a part without one (a run that was lost) is not read."""
        tables = {"vectors": rows, "docs": docs, **{t: getattr(shards, t) for t in Shards.TABLES}}
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}/part={part}")
        entry = (part, self.citable, self.max_terms, list(self.stop_words))
        spark = self.vocab.sparkSession
        spark.createDataFrame([entry], "part int, citable int, max_terms int, stop_words array<string>").write.mode("append").json(f"{path}/manifest")

    def save(self, path: str) -> None:
        """SNK4: the vocabulary, and one part with all rows; `path` is a new folder or one to be written over."""
        self.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
        spark = self.vocab.sparkSession
        spark.createDataFrame([], "part int, citable int, max_terms int, stop_words array<string>").write.mode("overwrite").json(f"{path}/manifest")
        self._write_part(path, 0, self.rows, self.docs, self.shards)

    @classmethod
    def load(cls, spark, path: str) -> ThreadIndex:
        """RET1: a stored index, as it lies; queries read its shards and make none."""
        parts = spark.read.schema("part int, citable int, max_terms int, stop_words array<string>").json(f"{path}/manifest").collect()  # one row per append
        if not parts:
            raise ValueError(f"no index in {path}")
        numbers = [p["part"] for p in parts]
        read = lambda name: spark.read.parquet(f"{path}/{name}").filter(F.col("part").isin(numbers)).drop("part")
        shards = Shards(**{t: read(t) for t in Shards.TABLES})
        return cls(spark.read.parquet(f"{path}/vocab"), read("vectors"), read("docs"), parts[0]["stop_words"], parts[0]["max_terms"], shards, min(p["citable"] for p in parts))

    def append(self, path: str, usable_threads: DataFrame) -> ThreadIndex:
        """Adds threads to the index stored in `path` as a part of its own, weighted by the stored vocabulary, and loads it.

        The threads must not be in the index yet.
        """
        spark = self.vocab.sparkSession
        part = 1 + spark.read.schema("part int").json(f"{path}/manifest").agg(F.max("part")).first()[0]
        docs = stage_table(self._texts(usable_threads), "docs")
        counts = packed_counts(self._keyed(docs), "thread", "customer_text", self.stop_words)
        rows = stage_table(vectors(counts, self.vocab, "thread", self.max_terms).select("thread.*", "term_ids", "weights"), "rows")
        self._write_part(path, part, rows, docs, cut_shards(rows, citable=self.citable, part=part))
        return type(self).load(spark, path)

    def query(
        self, messages: DataFrame, key: str, text: str, k: int = V.TOP_K, min_sim: float = V.MIN_SIMILARITY, exclude_self: bool = False
    ) -> DataFrame:
        """RET2: (key, hits) for every message; hits is empty when nothing reaches the threshold.

        `exclude_self` leaves out threads whose customer message is the query itself.
        """
        counts = packed_counts(messages.select(F.col(key).alias("query_id"), F.col(text).alias("_text")), "query_id", "_text", self.stop_words)
        q = vectors(counts, self.vocab, "query_id", self.max_terms)
        shards = self.shards if k <= self.citable else cut_shards(self.rows, citable=k)
        best = topk_sharded(q, shards, k, min_sim, exclude_self)
        cited = best.select("query_id", F.posexplode("hits").alias("pos", "h")).select("query_id", "pos", "h.*").join(
            self.docs, ["doc_id", "owner_id"]
        )
        # At most k entries per message.
        hit = F.struct("pos", F.col("brand_tweet_id").alias("tweet_id"), "customer_tweet_id", "brand_tweet_id", "customer_text", "brand_reply_text", "similarity")
        packed = cited.groupBy(F.col("query_id").alias(key)).agg(F.array_sort(F.collect_list(hit)).alias("_hits"))
        shaped = F.transform("_hits", lambda h: h.dropFields("pos"))
        none = F.array().cast(HITS)
        return messages.select(key).join(packed, key, "left").select(key, F.coalesce(shaped, none).alias("hits"))
