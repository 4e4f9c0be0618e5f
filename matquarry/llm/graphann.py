"""Approximate nearest neighbours by robust-pruned directed graphs.

Distinct vectors are dealt by hash into shards of about ``shard_rows``. A task builds the
graph of a shard: points are inserted in batches, a greedy search over the graph so far
proposes neighbours, and relaxed distance pruning keeps a neighbour only if no
kept one is closer to it by a factor ``alpha``. Every query searches every shard with
a beam; what the beams return is scored again in double precision on the original
vectors, and the best of all shards are the result.

Blocks of queries meet shard graphs by a cogrouped shuffle on (shard, block), so a
task holds one graph and one block of queries whatever the size of the tables. Both are large, as each
graph is sent once a block and each block once a graph. A shard of no more points than the beam is compared whole:
with ``beam`` of ``shard_rows`` or more the search is exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Queries that one search step handles together.
STEP = 256


def beam_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int, width: int = 4):
    """Rows of ``x`` nearest to each query by inner product, best first: (rows, products).

    ``graph`` holds the out-neighbours of each row, padded with len(x). Each step
    expands the ``width`` best candidates not yet expanded of every query."""
    n, count = len(x), len(queries)
    width = min(width, beam)
    padded = np.vstack([graph, np.full((1, graph.shape[1]), n, graph.dtype)])
    beam = max(beam, len(entries))
    ids = np.full((count, beam), n, np.int64)
    sims = np.full((count, beam), -np.inf, np.float32)
    ids[:, : len(entries)] = entries
    sims[:, : len(entries)] = queries @ x[entries].T
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    expanded = ids == n
    seen = np.zeros((count, n + 1), bool)
    seen[:, n] = True
    np.put_along_axis(seen, ids, True, 1)
    live = np.arange(count)
    while len(live):
        at = np.argsort(expanded[live], axis=1, kind="stable")[:, :width]
        chosen = np.where(np.take_along_axis(expanded[live], at, 1), n, np.take_along_axis(ids[live], at, 1))
        expanded[live[:, None], at] = True
        near = np.sort(padded[chosen].reshape(len(live), -1), axis=1)
        fresh = ~seen[live[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[live[:, None], near] = True
        row, col = np.nonzero(fresh)
        new = np.full(near.shape, -np.inf, np.float32)
        new[row, col] = np.einsum("ij,ij->i", x[near[row, col]], queries[live[row]])
        all_sims = np.concatenate([sims[live], new], axis=1)
        all_ids = np.concatenate([ids[live], near], axis=1)
        all_done = np.concatenate([expanded[live], ~fresh], axis=1)
        best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        order = np.take_along_axis(best, np.argsort(-np.take_along_axis(all_sims, best, 1), axis=1, kind="stable"), 1)
        sims[live] = np.take_along_axis(all_sims, order, 1)
        ids[live] = np.take_along_axis(all_ids, order, 1)
        expanded[live] = np.take_along_axis(all_done, order, 1)
        live = live[~expanded[live].all(axis=1)]
    ids[np.isneginf(sims)] = n
    return ids, sims


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point the candidates that pruning keeps, padded with len(x).

    Candidates are visited from the nearest on; a kept one removes those that it is
    nearer to, by the factor alpha, than the point is."""
    n = len(x)
    candidates = np.sort(candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = n
    candidates[candidates == points[:, None]] = n
    vectors = np.vstack([x, np.zeros((1, x.shape[1]), x.dtype)])
    far = np.where(candidates == n, np.inf, 2 - 2 * np.einsum("bcd,bd->bc", vectors[candidates], x[points]))
    order = np.argsort(far, axis=1, kind="stable")
    candidates, far = np.take_along_axis(candidates, order, 1), np.take_along_axis(far, order, 1)
    inside = vectors[candidates]
    apart = 2 - 2 * np.matmul(inside, inside.transpose(0, 2, 1))
    alive = candidates < n
    kept = np.zeros_like(alive)
    for j in range(candidates.shape[1]):
        keep = alive[:, j] & (kept.sum(axis=1) < degree)
        kept[:, j] = keep
        alive &= ~(keep[:, None] & (alpha * alpha * apart[:, j] <= far))
    # room that pruning leaves goes to the nearest of what it removed
    rank = np.argsort(np.where(kept, 0, np.where(candidates < n, 1, 2)), axis=1, kind="stable")[:, :degree]
    out = np.take_along_axis(candidates, rank, 1)
    if out.shape[1] < degree:
        out = np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=n)
    return out


def build_graph(
    x: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, batch: int = 512, n_entries: int = 8
) -> tuple[np.ndarray, np.ndarray]:
    """(graph, entries) over the unit vectors ``x``; the same vectors give the same graph."""
    n = len(x)
    rng = np.random.default_rng(n)
    order = rng.permutation(n)
    graph = np.full((n, degree), n, np.int64)
    centre = x.mean(axis=0)
    entries = np.unique(np.concatenate([[np.argmax(x @ centre)], order[:n_entries]]))
    inserted = min(n, batch // 4)
    first = order[:inserted]
    near = np.argsort(-(x[first] @ x[first].T), axis=1, kind="stable")[:, 1 : 2 * degree + 1]
    if near.shape[1]:
        graph[first] = robust_prune(x, first, first[near], degree, alpha)
    rest = order[inserted:]
    while len(rest):
        points, rest = rest[: min(batch, inserted)], rest[min(batch, inserted) :]
        inserted += len(points)
        parts = [beam_search(x, graph, entries, x[points[i : i + STEP]], beam)[0] for i in range(0, len(points), STEP)]
        graph[points] = robust_prune(x, points, np.concatenate(parts), degree, alpha)
        _link_back(x, graph, points, degree, alpha)
    return graph, entries


def _link_back(x: np.ndarray, graph: np.ndarray, points: np.ndarray, degree: int, alpha: float) -> None:
    """Add the edges from the new neighbours of ``points`` back to them, pruning lists that overflow."""
    n = len(x)
    source, target = np.repeat(points, degree), graph[points].ravel()
    source, target = source[target < n], target[target < n]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, start, count = np.unique(target, return_index=True, return_counts=True)
    slots = np.arange(len(target)) - np.repeat(start, count)
    owner = np.repeat(np.arange(len(nodes)), count)
    for lo in range(0, len(nodes), STEP):
        hi = min(lo + STEP, len(nodes))
        picked = (owner >= lo) & (owner < hi)
        lists = np.full((hi - lo, degree + int(count[lo:hi].max())), n, np.int64)
        lists[:, :degree] = graph[nodes[lo:hi]]
        lists[owner[picked] - lo, degree + slots[picked]] = source[picked]
        graph[nodes[lo:hi]] = robust_prune(x, nodes[lo:hi], lists, degree, alpha)


def unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def rescaled(vectors: np.ndarray) -> np.ndarray:
    """The vectors times powers of two that bring their largest components near 1: no norm overflows, no bit is lost."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    return np.ldexp(vectors, -exponent)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of matching rows in double precision."""
    return (a * b).sum(axis=-1) / np.sqrt((a * a).sum(axis=-1) * (b * b).sum(axis=-1))


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, not zero, without null or non-finite components."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def build_index(
    vectors: DataFrame, id_col: str, vector_col: str, k: int, shard_rows: int, degree: int, build_beam: int, alpha: float
) -> DataFrame:
    """(shard, dim, n, ids, vectors, graph, entries): one row a shard, its arrays as bytes.

    Equal vectors share one point, which keeps the k + 1 smallest of their ids: no
    query has use for more of them."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.where(usable(F.col("v")) & F.col("id").isNotNull()).distinct()
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("rank") <= k + 1)
    points = materialise(
        ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select("v", "ids", F.size("v").alias("dim"))
    )
    counts = points.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(shard_rows)).alias("shards"))
    dealt = points.join(counts, "dim").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        original = rescaled(np.stack(pdf["v"].to_numpy()))
        order = np.lexsort(original.T[::-1])
        original = original[order]
        ids = np.full((len(pdf), k + 1), -(2**63), np.int64)
        for i, own in enumerate(pdf["ids"].iloc[order]):
            ids[i, : len(own)] = own
        graph, entries = build_graph(unit(original), degree, build_beam, alpha)
        return pd.DataFrame(
            {
                "dim": [int(pdf["dim"].iloc[0])],
                "shard": [int(pdf["shard"].iloc[0])],
                "n": [len(pdf)],
                "ids": [ids.tobytes()],
                "vectors": [original.tobytes()],
                "graph": [graph.astype(np.int32).tobytes()],
                "entries": [entries.astype(np.int32).tobytes()],
            }
        )

    schema = "dim int, shard int, n int, ids binary, vectors binary, graph binary, entries binary"
    # a stated number of partitions: shards are small for what building one takes, and would be put together in few tasks
    return dealt.repartition(_spread(counts.agg(F.sum("shards")).first()[0]), "dim", "shard").groupBy("dim", "shard").applyInPandas(build, schema)


def _spread(groups: int | None) -> int:
    """Partitions over which hashing deals so many groups with few in one."""
    return 4 * int(groups or 0) + 1


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    shard_rows: int = 16_384,
    degree: int = 32,
    build_beam: int = 64,
    alpha: float = 1.2,
    beam: int = 128,
    query_block: int = 8192,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k nearest rows of ``vectors``.

    Nearest by cosine in double precision, ties to the smaller id; a row with the
    query's own id is no candidate. Vectors null, zero or with null or non-finite
    components take no part, nor do null ids; vectors are compared with those of their
    own length. Repeated rows (equal id and vector) count once; rows that
    share an id but not a vector are separate queries and candidates. Fewer candidates
    than k give fewer rows; empty tables give an empty result; other columns are ignored."""
    index = materialise(build_index(vectors, id_col, vector_col, k, shard_rows, degree, build_beam, alpha))
    asked = queries.select(F.col(f"`{id_col}`").cast("long").alias("query_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("q"))
    asked = materialise(asked.where(usable(F.col("q")) & F.col("query_id").isNotNull()).distinct())
    blocks = -(-asked.count() // query_block) or 1
    blocked = asked.select(
        "query_id", "q", F.size("q").alias("dim"), F.pmod(F.xxhash64("query_id", "q"), F.lit(blocks)).cast("int").alias("block")
    )
    shards = index.groupBy("dim").agg(F.collect_list("shard").alias("shards"))
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = blocked.join(shards, "dim").select("query_id", "q", "dim", "block", F.explode("shards").alias("shard"))

    def search(graphs: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(graphs) and len(block):
            shard = graphs.iloc[0]
            ids = np.frombuffer(shard["ids"], np.int64).reshape(-1, k + 1)
            original = np.frombuffer(shard["vectors"], np.float64).reshape(len(ids), -1)
            graph = np.frombuffer(shard["graph"], np.int32).reshape(len(ids), -1).astype(np.int64)
            entries = np.frombuffer(shard["entries"], np.int32).astype(np.int64)
            x, raw = unit(original), np.stack(block["q"].to_numpy())
            exact = rescaled(raw)
            asked = unit(exact)
            own = block["query_id"].to_numpy()
            for at in range(0, len(block), STEP):
                here = slice(at, at + STEP)
                if len(ids) > beam:
                    rows, _ = beam_search(x, graph, entries, asked[here], beam)
                else:
                    rows = np.tile(np.arange(len(ids)), (len(asked[here]), 1))
                safe = np.minimum(rows, len(ids) - 1)
                score = np.where(rows < len(ids), cosine(original[safe], exact[here][:, None, :]), -np.inf)
                names = np.where(np.isneginf(score)[..., None], -(2**63), ids[safe])
                for i in range(len(rows)):
                    one, value = names[i].ravel(), np.repeat(score[i], k + 1)
                    ok = (one != -(2**63)) & (one != own[at + i])
                    one, value = one[ok], value[ok]
                    best = np.lexsort((one, -value))[:k]
                    found.append((at + i, one[best], value[best]))
        rows = np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(int)
        return pd.DataFrame(
            {
                "query_id": block["query_id"].to_numpy()[rows] if len(rows) else np.array([], np.int64),
                "q_hash": block["q_hash"].to_numpy()[rows] if len(rows) else np.array([], np.int64),
                "vec_id": np.concatenate([f[1] for f in found]) if found else np.array([], np.int64),
                "score": np.concatenate([f[2] for f in found]) if found else np.array([], np.float64),
            }
        )

    right = right.withColumn("q_hash", F.xxhash64("q"))
    keys, tasks = ["dim", "shard", "block"], _spread(left.count())
    left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    each = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, q_hash long, vec_id long, score double")
    order = Window.partitionBy("query_id", "q_hash").orderBy(F.col("score").desc(), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
