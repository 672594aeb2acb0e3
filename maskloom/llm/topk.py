"""Exact top-k inner products by the three-phase uniform threshold.

Each query has one score list for every slice of the components: the inner products of that slice with all
vectors. The lists are as long as the table, so that they are computed where they are read, block by block, and never kept.

1. Gather: each block gives, for each query, the leading entries of every list with their whole scores, and each
   list's smallest score. The k-th best whole score is a bound that the answer reaches.
2. Cutoff: of the bound's excess over the lists' smallest scores each list gets the same share. An entry
   below this in every list can't reach the bound. Each block collects, list by list, the entries that reach a cutoff.
3. Resolve: only for the entries collected, the scores of the other lists are added; those that reach the bound are
   candidates, and the k best of them are the answer.

Queries and vectors are both dealt to blocks, and every pair of blocks is one bounded group; nothing but two
counts comes to the driver, and one plan serves any number of queries.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm import common

#: Queries and vectors of a block; pairs of blocks are computed CHUNK queries by CHUNK vectors at once.
QUERIES, ROWS = 16_384, 65_536
CHUNK = 1024, 4096
#: Leading entries of a list, for each of the k asked for, that a chunk gathers: more of them make a better bound.
LEADS = 8


def components_of(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of every component as double; rows with a null id or vector, or null or non-finite components, are left out."""
    x = F.transform(F.col(vec_col), lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("double"))
    good = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & F.forall(vec_col, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return vectors.filter(good).select(F.col(id_col).cast("long").alias("id"), x.alias("v"))


def slices_of(width: int, lists: int) -> list[slice]:
    edges = [width * i // lists for i in range(lists + 1)]
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def gather(q: np.ndarray, x: np.ndarray, mine: np.ndarray, k: int, cuts: list[slice]) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1 of a block: the k best whole scores among each query's LEADS * k leading entries of every list (-inf where there are fewer), and the smallest score of each list.

    mine: entries that are the query itself and lead nothing. Scores are whole numbers in doubles.
    """
    low, lead = np.empty((len(q), len(cuts))), []
    for j, c in enumerate(cuts):
        part = q[:, c] @ x[:, c].T
        low[:, j] = part.min(1)
        part[mine] = -np.inf
        n = min(LEADS * k, part.shape[1])
        lead.append(np.argpartition(part, part.shape[1] - n, axis=1)[:, part.shape[1] - n :])
    cols = np.sort(np.concatenate(lead, 1), 1)
    whole = np.einsum("qd,qed->qe", q, x[cols])
    whole[np.take_along_axis(mine, cols, 1)] = -np.inf
    whole[:, 1:][cols[:, 1:] == cols[:, :-1]] = -np.inf  # an entry that leads several lists counts once
    return -np.sort(-whole, 1)[:, :k], low


def collect(q: np.ndarray, x: np.ndarray, mine: np.ndarray, cut: np.ndarray, cuts: list[slice]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phase 2 of a block: (query, entry, score so far, list) of all entries that reach their list's cutoff; an entry comes with the first such list."""
    got, rows, cols, score, which = mine.copy(), [], [], [], []
    for j, c in enumerate(cuts):
        part = q[:, c] @ x[:, c].T
        r, e = np.nonzero((part >= cut[:, j : j + 1]) & ~got)
        got[r, e] = True
        rows.append(r)
        cols.append(e)
        score.append(part[r, e])
        which.append(np.full(len(r), j))
    return tuple(np.concatenate(a) for a in (rows, cols, score, which))


def resolve(q: np.ndarray, x: np.ndarray, found: tuple, bound: np.ndarray, cuts: list[slice]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 3 of a block: (query, entry, whole score) of the entries found that reach the bound; only their missing lists are computed."""
    rows, cols, score, which = (a.copy() for a in found)
    for j, c in enumerate(cuts):
        left = np.flatnonzero(which != j)
        for a in range(0, len(left), 1 << 16):
            some = left[a : a + (1 << 16)]
            score[some] += np.einsum("ed,ed->e", q[rows[some], c], x[cols[some], c])
    good = score >= bound[rows]
    return rows[good], cols[good], score[good]


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def _chunks(ids: np.ndarray, x: np.ndarray, size: int):
    for a in range(0, len(ids), size):
        yield ids[a : a + size], x[a : a + size]


def _pairs(vectors: DataFrame, asked: DataFrame, blocks: tuple[int, int]):
    """Vectors and queries dealt to all pairs of blocks of one width."""
    q, r = blocks
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.withColumn("width", F.size("v")).withColumn("vb", F.pmod(F.monotonically_increasing_id(), F.lit(r)).cast("int")).withColumn("qb", every(q))
    right = asked.withColumn("vb", every(r))
    return left.groupBy("width", "qb", "vb").cogroup(right.groupBy("width", "qb", "vb"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, lists: int = 2, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all vectors for each query, without the query's own id.

    Ties go to the smaller id; fewer rows where there are fewer candidates. Queries that repeat
    with the same vector count once; vectors that repeat are candidates each. Vectors of another
    width than the query's are no candidates. Empty tables give no rows; extra columns are left out.
    """
    spark = vectors.sparkSession
    everything = components_of(vectors, id_col, vec_col, scale)
    asked = components_of(queries, id_col, vec_col, scale).distinct()
    asked = common.materialize(asked.select(F.monotonically_increasing_id().alias("at"), "id", "v", F.size("v").alias("width")), "queries")
    n = common.partitions(spark)
    rows = everything.count()
    blocks = max(1, math.ceil(asked.count() / QUERIES)), max(1, math.ceil(rows / ROWS), min(n, math.ceil(rows / CHUNK[1])))
    asked = asked.withColumn("qb", F.pmod(F.col("at"), F.lit(blocks[0])).cast("int"))

    def first(key, left, right):
        own, x = left.column("id").to_numpy(), _matrix(left.column("v"))
        at, ids, q = right.column("at").to_numpy(), right.column("id").to_numpy(), _matrix(right.column("v"))
        cuts = slices_of(q.shape[1], lists)
        out: list[list[np.ndarray]] = [[], [], []]
        step = np.arange(len(ids))
        for pos, qs in _chunks(step, q, CHUNK[0]) if len(own) else ():
            best, low = np.empty((len(pos), 0)), np.full((len(pos), len(cuts)), np.inf)
            for mine_ids, xs in _chunks(own, x, CHUNK[1]):
                top, least = gather(qs, xs, mine_ids[None, :] == ids[pos][:, None], k, cuts)
                best, low = -np.sort(-np.concatenate([best, top], 1), 1)[:, :k], np.minimum(low, least)
            r, c = np.nonzero(np.isfinite(best))
            rr, cc = np.nonzero(np.isfinite(low))
            for o, v in zip(out, (np.concatenate([at[pos[r]], at[pos[rr]]]), np.concatenate([np.full(len(r), -1), cc]), np.concatenate([best[r, c], low[rr, cc]])), strict=True):
                o.append(v)
        made = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table({"at": pa.array(made[0].astype(np.int64)), "list": pa.array(made[1].astype(np.int32)), "score": pa.array(made[2].astype(float))})

    gathered = common.materialize(_pairs(everything, asked, blocks).applyInArrow(first, "at bigint, list int, score double"), "lists")
    ordered = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("score")))
    bounds = gathered.filter("list < 0").withColumn("r", ordered).filter(F.col("r") <= k).groupBy("at").agg(F.min("score").alias("bound"), F.count("*").alias("have"))
    lows = gathered.filter("list >= 0").groupBy("at", "list").agg(F.min("score").alias("low")).groupBy("at").agg(F.transform(F.array_sort(F.collect_list(F.struct("list", "low"))), lambda s: s["low"]).alias("lows"))
    bound = F.when(F.col("have") == k, F.col("bound")).otherwise(F.lit(float("-inf")))
    known = common.materialize(asked.join(lows, "at").join(bounds, "at").select(*asked.columns, "lows", bound.alias("bound")), "cutoffs")

    def second(key, left, right):
        own, x = left.column("id").to_numpy(), _matrix(left.column("v"))
        at, ids, q = right.column("at").to_numpy(), right.column("id").to_numpy(), _matrix(right.column("v"))
        bound, lows = right.column("bound").to_numpy(), _matrix(right.column("lows"))
        cuts = slices_of(q.shape[1], lists)
        out: list[list[np.ndarray]] = [[], [], []]
        for pos, qs in _chunks(np.arange(len(ids)), q, CHUNK[0]) if len(own) else ():
            cut = lows[pos] + ((bound[pos] - lows[pos].sum(1)) / len(cuts))[:, None]
            for mine_ids, xs in _chunks(own, x, CHUNK[1]):
                found = collect(qs, xs, mine_ids[None, :] == ids[pos][:, None], cut, cuts)
                r, c, s = resolve(qs, xs, found, bound[pos], cuts)
                order = np.lexsort((mine_ids[c], -s, r))  # the k best of each query in the block
                r, c, s = r[order], c[order], s[order]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                for o, v in zip(out, (at[pos[r]], mine_ids[c], s), strict=True):
                    o.append(v[place < k])
        made = [np.concatenate(o).astype(np.int64) if o else np.zeros(0, np.int64) for o in out]
        return pa.table({"at": made[0], "vec_id": made[1], "score": made[2]})

    hits = _pairs(everything, known, blocks).applyInArrow(second, "at bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("at").orderBy(F.desc("score"), "vec_id")
    top = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return top.join(asked.select("at", F.col("id").alias("query_id")), "at").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
