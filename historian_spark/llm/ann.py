"""Nearest neighbours by inner product over hierarchical navigable small-world graphs.

Vectors are parted by dimension and by class of length (its exponent, in steps of half a power of
two), and dealt by a hash of their id to shards of bounded size within a part, so that the vectors
of a shard are about equally long. Each shard, scaled by a power of two, builds one graph and
stores it as flat neighbour arrays, a row a shard. One more component makes its vectors exactly
equally long, so that the nearest in the graph have the largest inner products. Equal vectors are
one node with all their ids. A search sends blocks of queries to every shard of their dimension,
walks the graphs for many queries at once, scores what it finds in double precision on the
original vectors, and merges the shards' best. A query that a graph leaves with fewer than k of
the shard's vectors is compared with all of that shard.

Shards hold ``least_rows`` vectors on small tables, more as the table grows so that a query meets
about ``SHARDS`` of them, and ``most_rows`` or ``SHARD_BYTES`` at most, which bounds a task's memory
also where vectors have many components; beyond that the
number of shards that a query meets grows with the table. Uneven lengths add a shard a class.

Cases: vectors that are null, of length zero, all zero or that hold null or non-finite
components take no part, nor do null ids; only vectors of equal dimension meet; ties go to the
smaller id; where a product leaves the range of doubles, its score is infinite or zero, and the
products of the vectors scaled by powers of two, which are in the same order, decide the ranks;
rows equal in id and vector count once, an id with several vectors is a candidate with each and
one query; with too few candidates a query has fewer rows; an empty table gives an empty index
and no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, durable

LEAST_ROWS, MOST_ROWS, SHARDS = 8_192, 131_072, 64
BLOCK_QUERIES = 8_192
SHARD_BYTES = 256 << 20  # of a shard's vectors: rows x components x 8
SALTS = 64
LINKS = 16
EF_BUILD, EF_SEARCH = 64, 192
_STEP = 4  # nodes a query expands at once
_BATCH = 256


def _beam(q: np.ndarray, vectors: np.ndarray, links: np.ndarray, starts: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of q the ef best nodes met from its starts: nodes (-1 for none) and similarities, best first."""
    b = len(q)
    seen = np.zeros((b, len(links)), bool)
    rows = np.arange(b)[:, None]
    ids = np.full((b, ef), -1, np.int64)
    sims = np.full((b, ef), -np.inf, np.float32)
    done = np.zeros((b, ef), bool)

    def join(found: np.ndarray) -> None:
        nonlocal ids, sims, done
        own = np.where(found >= 0, found, 0)
        fresh = (found >= 0) & ~seen[rows, own]
        # the same node twice in one row counts once
        order = np.argsort(own, axis=1, kind="stable")
        ordered = np.take_along_axis(own, order, 1)
        twice = np.zeros_like(fresh)
        np.put_along_axis(twice, order[:, 1:], (ordered[:, 1:] == ordered[:, :-1]) & np.take_along_axis(fresh, order, 1)[:, :-1], 1)
        fresh &= ~twice
        r, c = np.nonzero(fresh)
        seen[r, own[r, c]] = True
        new = np.full(found.shape, -np.inf, np.float32)
        new[r, c] = np.einsum("nd,nd->n", vectors[own[r, c]], q[r])
        sims = np.concatenate([sims, new], 1)
        ids = np.concatenate([ids, np.where(fresh, found, -1)], 1)
        done = np.concatenate([done, ~fresh], 1)
        best = np.argsort(-sims, axis=1, kind="stable")[:, :ef]
        ids, sims, done = (np.take_along_axis(x, best, 1) for x in (ids, sims, done))

    join(starts)
    while True:
        open_ = (ids >= 0) & ~done
        if not open_.any():
            return ids, sims
        first = np.argsort(~open_, axis=1, kind="stable")[:, :_STEP]
        use = np.take_along_axis(open_, first, 1)
        nodes = np.take_along_axis(ids, first, 1)
        done[np.broadcast_to(rows, first.shape)[use], first[use]] = True
        found = np.where(use[:, :, None], links[np.where(use, nodes, 0)], -1).reshape(b, -1)
        active = use.any(1)
        if active.all():
            join(found)
        else:  # queries that are through stand still
            found[~active] = -1
            join(found)


def _choose(base: np.ndarray, cand: np.ndarray, sims: np.ndarray, vectors: np.ndarray, keep: int) -> np.ndarray:
    """Diverse neighbours: a candidate stays if it is nearer to its node than to every neighbour kept so far."""
    b, n = cand.shape
    order = np.argsort(-sims, axis=1, kind="stable")[:, : 4 * keep]
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    n = cand.shape[1]
    near = vectors[np.maximum(cand, 0)]
    mutual = near @ near.transpose(0, 2, 1)
    kept = np.zeros((b, n), bool)
    for k in range(n):
        closer = ((mutual[:, k, :] > sims[:, k : k + 1]) & kept).any(1)
        kept[:, k] = np.isfinite(sims[:, k]) & ~closer & (kept.sum(1) < keep)
    # free places go to the nearest of the others
    rank = np.where(kept, 0, 1) + np.where(np.isfinite(sims), 0, 2)
    best = np.lexsort((-sims, rank), axis=1)[:, :keep] if n else np.empty((b, 0), int)
    out = np.full((b, keep), -1, np.int32)
    picked = np.take_along_axis(cand, best, 1)
    picked[~np.isfinite(np.take_along_axis(sims, best, 1))] = -1
    out[:, : picked.shape[1]] = picked
    return out


def build_graph(vectors: np.ndarray, seed: int = 0) -> tuple[np.ndarray, list[np.ndarray]]:
    """order (of insertion; nodes of higher layers first) and, for each layer, the flat links of its nodes, a prefix of order."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    level = np.floor(-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int)
    order = np.argsort(-level, kind="stable")
    v = vectors[order]
    sizes = [int((level >= k).sum()) for k in range(int(level.max()) + 1)] if n else []
    layers = [np.full((s, 2 * LINKS if k == 0 else LINKS), -1, np.int32) for k, s in enumerate(sizes)]
    at = 1
    while at < n:
        stop = min(n, at + max(1, min(_BATCH, at // 2)))
        new = np.arange(at, stop)
        starts = np.zeros((len(new), 1), np.int64)
        for k in reversed(range(len(sizes))):
            there = min(at, sizes[k])
            found, sims = _beam(v[new], v[:there], layers[k][:there], np.where(starts < there, starts, 0), EF_BUILD if new[0] < sizes[k] else 8)
            starts = found[:, :4] if found.shape[1] >= 4 else found
            own = new[new < sizes[k]]
            if not len(own):
                continue
            m = len(own)
            among = v[own] @ v[own].T
            among[np.triu_indices(m)] = -np.inf  # earlier ones of the same batch
            cand = np.concatenate([found[:m], np.broadcast_to(own, (m, m))], 1)
            near = np.concatenate([np.where(found[:m] >= 0, sims[:m], -np.inf), among], 1)
            width = layers[k].shape[1]
            chosen = _choose(own, cand, near, v, LINKS)
            layers[k][own, :LINKS] = chosen
            # links back; a node with too many keeps a diverse choice
            src = np.repeat(own, LINKS)
            dst = chosen.ravel().astype(np.int64)
            src, dst = src[dst >= 0], dst[dst >= 0]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
            wide = np.full((len(nodes), width + int(count.max())), -1, np.int64) if len(nodes) else np.empty((0, width), np.int64)
            wide[:, :width] = layers[k][nodes]
            wide[np.repeat(np.arange(len(nodes)), count), width + np.arange(len(dst)) - np.repeat(first, count)] = src
            for a in range(0, len(nodes), 512):
                own_nodes, own_wide = nodes[a : a + 512], wide[a : a + 512]
                near = np.where(own_wide >= 0, (v[np.maximum(own_wide, 0)] @ v[own_nodes][:, :, None])[:, :, 0], -np.inf)
                layers[k][own_nodes] = _choose(own_nodes, own_wide, near.astype(np.float32), v, width)
        at = stop
    return order, layers


def search_graph(q: np.ndarray, vectors: np.ndarray, layers: list[np.ndarray], ef: int) -> np.ndarray:
    """Nodes (in order of insertion) found for each row of q, -1 for none."""
    out = []
    for a in range(0, len(q), _BATCH):
        part = q[a : a + _BATCH]
        starts = np.zeros((len(part), 1), np.int64)
        for k in reversed(range(len(layers))):
            found, _ = _beam(part, vectors[: len(layers[k])], layers[k], starts, ef if k == 0 else 8)
            starts = found[:, :4]
        out.append(found)
    return np.concatenate(out) if out else np.empty((0, ef), np.int64)


INDEX = "dim int, length int, shard int, n int, ids binary, id_ends binary, vectors binary, layer_sizes array<int>, links binary"


def _scaled(x: np.ndarray, axis: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """x over a power of two, whose exponent comes with it, so that the largest component (of each row, with axis=1) is about 1."""
    exponent = np.frexp(np.abs(x).max(axis=axis, keepdims=axis is not None, initial=0.0))[1]
    return np.ldexp(x, -exponent), exponent


def _lengthened(x: np.ndarray) -> np.ndarray:
    norm = np.einsum("nd,nd->n", x, x)
    rest = np.sqrt(np.maximum(norm.max(initial=0.0) - norm, 0))
    scale = np.sqrt(norm.max(initial=0.0)) or 1.0
    return (np.concatenate([x, rest[:, None]], 1) / scale).astype(np.float32)


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    x = np.stack(rows["vector"].to_numpy())
    ids = rows["vec_id"].to_numpy(np.int64)
    by = np.lexsort((ids, *x.T[::-1]))
    x, ids = x[by], ids[by]
    new = np.concatenate([[True], (x[1:] != x[:-1]).any(1)])
    same = np.concatenate([[False], ~new[1:] & (ids[1:] == ids[:-1])])
    x, ids, new = x[~same], ids[~same], new[~same]
    first = np.flatnonzero(new)
    nodes = x[first]
    order, layers = build_graph(_lengthened(_scaled(nodes)[0]), seed=int(key[2]))
    ends = np.append(first, len(ids))
    lists = [ids[ends[k] : ends[k + 1]] for k in order]
    id_ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    flat = b"".join(x.astype("<i4").tobytes() for x in layers)
    row = [*key, len(order), np.concatenate(lists).astype("<i8").tobytes(), id_ends.astype("<i8").tobytes(), nodes[order].astype("<f8").tobytes(), [len(x) for x in layers], flat]
    return pd.DataFrame([row], columns=[c.split()[0] for c in INDEX.split(", ")])


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, vector (doubles), dim and length (a class of lengths) of the rows that take part."""
    finite = lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf"))
    rows = vectors.select(column(id_column).cast("long").alias("vec_id"), column(vector_column).cast("array<double>").alias("vector"))
    fit = F.forall("vector", finite) & F.exists("vector", lambda y: y != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(fit, F.lit(False)))
    most = F.array_max(F.transform("vector", lambda y: F.abs(y)))
    squares = lambda m: F.aggregate("vector", F.lit(0.0), lambda acc, y: acc + (y / m) * (y / m))
    halves = F.transform(F.array(most), lambda m: 2 * F.log2(m) + F.log2(squares(m)))[0]  # twice the length's logarithm
    return rows.withColumn("dim", F.size("vector")).withColumn("length", F.floor(halves + 0.5).cast("int"))


def _shard_rows(n: int, least: int, most: int) -> int:
    return min(most, max(least, -(-n // SHARDS)))


def _rows_of(size: int) -> Column:
    """Rows of a shard of dim components: size, or as many as SHARD_BYTES hold."""
    return F.least(F.lit(size), F.greatest(F.lit(64), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim"))))).cast("int")


def build_index(rows: DataFrame, least_rows: int = LEAST_ROWS, most_rows: int = MOST_ROWS) -> DataFrame:
    """The index of usable rows, one row a shard, stored in the shared folder."""
    counts = durable(rows.groupBy("dim", "length").agg(F.count("*").alias("n")), "ann-parts")
    size = _shard_rows(int(counts.agg(F.sum("n")).first()[0] or 0), least_rows, most_rows)
    # a row a part, once for each salt: a part that holds all vectors meets them in many tasks
    shards = counts.select("dim", "length", F.ceil(F.col("n") / _rows_of(size)).alias("shards"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(SALTS)).cast("int"))
    dealt = salted.join(shards, ["dim", "length", "salt"]).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
    return durable(dealt.select("vec_id", "vector", "dim", "length", "shard").groupBy("dim", "length", "shard").applyInPandas(_build, INDEX), "ann")


def _nodes_of(row: pd.Series) -> tuple[np.ndarray, list[np.ndarray]]:
    flat, layers, at = np.frombuffer(row["links"], "<i4"), [], 0
    for level, size in enumerate(row["layer_sizes"]):
        width = 2 * LINKS if level == 0 else LINKS
        layers.append(flat[at : at + size * width].reshape(size, width))
        at += size * width
    return np.frombuffer(row["vectors"], "<f8").reshape(-1, int(row["dim"])), layers


def _all_nodes(q: np.ndarray, nodes: np.ndarray, width: int) -> np.ndarray:
    """The width best nodes of each row of q among all, -1 for none."""
    out = np.full((len(q), width), -1, np.int64)
    for a in range(0, len(q), _BATCH):
        score = q[a : a + _BATCH] @ nodes.T
        best = np.argsort(-score, axis=1, kind="stable")[:, :width]
        out[a : a + len(best), : best.shape[1]] = best
    return out


RANKED = "query_id long, vec_id long, score double, size int, part double"


def _searcher(k: int, ef: int, exclude_own: bool):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(queries):
            return pd.DataFrame({c.split()[0]: [] for c in RANKED.split(", ")})
        row = index.iloc[0]
        nodes, layers = _nodes_of(row)
        ids, ends = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["id_ends"], "<i8")
        q = np.stack(queries["vector"].to_numpy())
        own = queries["query_id"].to_numpy(np.int64)
        (small_q, q_size), (small, size) = _scaled(q, 1), _scaled(nodes)
        unit = small_q / np.sqrt(np.einsum("nd,nd->n", small_q, small_q))[:, None]
        found = search_graph(np.concatenate([unit, np.zeros((len(q), 1))], 1).astype(np.float32), _lengthened(small), layers, ef)
        short = (found >= 0).sum(1) < min(k + 1, len(nodes))
        if short.any():
            found[short] = _all_nodes(small_q[short], small, found.shape[1])
        r, c = np.nonzero(found >= 0)
        node = found[r, c]
        with np.errstate(over="ignore", under="ignore", invalid="ignore"):
            score = (nodes[node] * q[r]).sum(1)
        # the product as part * 2 ** size: the order of these is that of the products, also where doubles end
        part, exponent = np.frexp((small[node] * small_q[r]).sum(1))
        far = 1 + (1 << 20)
        order = np.where(part == 0, 0, np.sign(part) * (far + exponent + q_size[r, 0] + size)).astype(np.int64)
        score = np.where(np.isnan(score), np.sign(part) * np.inf, score)
        n = np.minimum(ends[node + 1] - ends[node], k + 1)  # the smallest ids of equal vectors
        which = np.repeat(np.arange(len(node)), n)
        vec = ids[np.repeat(ends[node], n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]
        r, score, order, part = r[which], score[which], order[which], part[which]
        if exclude_own:
            other = vec != own[r]
            r, vec, score, order, part = (x[other] for x in (r, vec, score, order, part))
        by = np.lexsort((vec, -part, -order, r))
        r, vec, score, order, part = (x[by] for x in (r, vec, score, order, part))
        top = np.arange(len(r)) - np.searchsorted(r, r) < k
        return pd.DataFrame({"query_id": own[r[top]], "vec_id": vec[top], "score": score[top], "size": order[top].astype(np.int32), "part": part[top]})

    return run


def search(index: DataFrame, queries: DataFrame, k: int, ef: int = EF_SEARCH, exclude_own: bool = True) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each usable row of queries.

    Shards meet blocks of queries; a task holds one shard and one block. What moves is the
    queries, once for each shard that they meet, and the shards, once for each block.
    """
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    shards = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.select(F.col("vec_id").alias("query_id"), "vector", F.col("dim").alias("q_dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    # the shards of a dimension as one row, once for each salt, so that no dimension's queries meet in one task
    targets = index.groupBy(F.col("dim").alias("q_dim")).agg(F.collect_list(F.struct("length", "shard")).alias("targets"))
    targets = durable(targets, "ann-targets").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(SALTS)).cast("int")).join(targets, ["q_dim", "salt"])
    asked = asked.select("query_id", "vector", "q_dim", "block", F.explode("targets").alias("to")).select("query_id", "vector", "q_dim", "to.length", "to.shard", "block")
    found = shards.groupBy("dim", "length", "shard", "block").cogroup(asked.groupBy("q_dim", "length", "shard", "block")).applyInPandas(_searcher(k, max(ef, k + 1), exclude_own), RANKED)
    best = Window.partitionBy("query_id").orderBy(F.desc("size"), F.desc("part"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
