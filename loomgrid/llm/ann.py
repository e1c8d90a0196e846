"""Approximate nearest neighbours: one navigable small-world graph per shard, results merged.

Different vectors are dealt to shards of bounded size by a hash of their components. A shard's graph
has layers, each holding a fraction of the one below; every node links to diverse near nodes among
those that came before it, and is linked back. The links are kept as one flat array per shard with a
fixed stride for each node and layer. Blocks of queries visit every shard, search its graph from the
top layer down, and each query's best finds are merged.

Equal vectors are one node of a graph. Of their ids only the smallest ``k`` + 1 can be among a
query's ``k`` nearest (ties go to the smaller id), so only those are kept beside the node.

Vectors that are null, zero or hold a null or non-finite component take no part, as query or
candidate; neither do rows with a null id. Vectors of different lengths never meet. Rows repeated
with their id are one row; other columns are not read, and without queries or candidates there are
no rows. Rows that share an id but not the vector are candidates each, and none of
them is a neighbour of a query of that id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, staged

#: Vectors of a shard on average; the bound on a task's memory.
SHARD_ROWS = 4096
#: Links of a node on the bottom layer; half as many above it.
LINKS = 32
#: Candidates that a new node's links are picked from, and those that a search keeps.
BUILD_WIDTH = 96
SEARCH_WIDTH = 96
LAYER_SHRINK = 16
QUERY_BLOCK = 512


def _layers(n: int, seed: int = 11) -> np.ndarray:
    """Top layer of each node, geometrically distributed; the first node has the highest."""
    u = np.random.default_rng(seed).random(n)
    top = np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(LAYER_SHRINK)).astype(np.int64)
    if n:
        top[0] = max(1, int(top.max()))
    return top


def _pick_diverse(x: np.ndarray, node: int, near: np.ndarray, dist: np.ndarray, most: int) -> list[int]:
    """Neighbours by distance, leaving out those closer to one already picked; then the nearest others."""
    between = np.maximum(0, (x[near] ** 2).sum(1)[:, None] + (x[near] ** 2).sum(1)[None, :] - 2 * x[near] @ x[near].T)
    picked, left = [], []
    for k in range(len(near)):
        if len(picked) == most:
            break
        (picked if not picked or dist[k] < between[k, picked].min() else left).append(k)
    return near[picked + left[: most - len(picked)]].tolist()


def build_graph(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(top layer of each node, flat links): links has shape (layers, nodes, LINKS), -1 where there is none.

    Nodes are inserted in order, in batches; a batch's candidates are the nearest of all nodes of the
    layer that came before, found exactly as the shard is small.
    """
    n = len(x)
    top = _layers(n)
    layers = int(top.max()) + 1 if n else 1
    links = np.full((layers, n, LINKS), -1, dtype=np.int32)
    norm = (x**2).sum(1)
    for layer in range(layers):
        most = LINKS if layer == 0 else LINKS // 2
        members = np.flatnonzero(top >= layer)
        lists: list[list[int]] = [[] for _ in range(len(members))]
        start = 1
        while start < len(members):
            stop = min(len(members), max(start + 1, min(2 * start, start + 512)))
            own, before = members[start:stop], members[:stop]
            d = norm[own][:, None] + norm[before][None, :] - 2 * x[own] @ x[before].T
            for r in range(len(own)):
                d[r, start + r :] = np.inf
            width = min(BUILD_WIDTH, stop)
            near = np.argpartition(d, width - 1, axis=1)[:, :width]
            for r in range(len(own)):
                c = near[r][np.isfinite(d[r, near[r]])]
                c = c[np.argsort(d[r, c], kind="stable")]
                lists[start + r] = _pick_diverse(x, own[r], before[c], np.maximum(0, d[r, c]), most // 2)
            start = stop
        back: list[list[int]] = [[] for _ in range(len(members))]
        place = {int(m): k for k, m in enumerate(members)}
        for k, out in enumerate(lists):
            for j in out:
                back[place[j]].append(int(members[k]))
        for k, m in enumerate(members):
            mine = np.array([*lists[k], *back[k]], dtype=np.int64)
            if len(mine) > most:
                d = np.maximum(0, norm[m] + norm[mine] - 2 * x[mine] @ x[m])
                order = np.argsort(d, kind="stable")[: 2 * most]
                mine = np.array(_pick_diverse(x, m, mine[order], d[order], most))
            links[layer, m, : len(mine)] = mine
    return top, links


def search_graph(x: np.ndarray, links: np.ndarray, queries: np.ndarray, width: int = SEARCH_WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, squared distances), each queries x width, nearest first; all queries walk in step."""
    q, n = len(queries), len(x)
    rows = np.arange(q)

    def distance(nodes: np.ndarray) -> np.ndarray:
        return ((x[nodes] - queries[:, None, :]) ** 2).sum(2)

    at = np.zeros(q, dtype=np.int64)
    best = distance(at[:, None])[:, 0]
    for layer in range(len(links) - 1, 0, -1):
        while True:
            near = links[layer, at]
            d = np.where(near >= 0, distance(np.maximum(near, 0)), np.inf)
            k = d.argmin(1)
            better = d[rows, k] < best
            if not better.any():
                break
            at = np.where(better, near[rows, k], at)
            best = np.minimum(best, d[rows, k])
    width = min(width, n)
    pool = np.full((q, width + LINKS), -1, dtype=np.int64)
    dist = np.full((q, width + LINKS), np.inf)
    opened = np.zeros((q, width + LINKS), dtype=bool)
    seen = np.zeros((q, n + 1), dtype=bool)
    pool[:, 0], dist[:, 0] = at, best
    seen[rows, at] = True
    while True:
        open_to = np.where(opened[:, :width] | (pool[:, :width] < 0), np.inf, dist[:, :width])
        k = open_to.argmin(1)
        go = np.flatnonzero(np.isfinite(open_to[rows, k]))
        if not len(go):
            return pool[:, :width], dist[:, :width]
        opened[go, k[go]] = True
        near = links[0, pool[go, k[go]]].astype(np.int64)
        near = np.where(near < 0, n, near)
        fresh = ~seen[go[:, None], near] & (near < n)
        seen[go[:, None], near] = True
        near = np.where(fresh, near, 0)
        d = ((x[near] - queries[go][:, None, :]) ** 2).sum(2)
        pool[go, width:] = np.where(fresh, near, -1)
        dist[go, width:] = np.where(fresh, d, np.inf)
        opened[go, width:] = False
        order = np.argsort(dist[go], axis=1, kind="stable")
        pool[go] = np.take_along_axis(pool[go], order, 1)
        dist[go] = np.take_along_axis(dist[go], order, 1)
        opened[go] = np.take_along_axis(opened[go], order, 1)


def clean_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): rows that take part, components as doubles, each (id, vector) once."""
    v = F.col(vector_col)
    fine = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    # Zeros of either sign are one value.
    exact = F.transform(v, lambda c: c.cast("double") + F.lit(0.0))
    return rows.where(fine).select(F.col(id_col).cast("long").alias("id"), exact.alias("v")).distinct()


def _packed(vectors) -> bytes:
    return np.asarray(vectors, dtype=np.float64).tobytes()


def build_index(vectors: DataFrame, k: int, shards: int) -> DataFrame:
    """One row for each shard of ``clean_vectors``: its nodes' ids, vectors, and flat links.

    Columns: dim, shard, nodes, ids (k + 1 smallest ids for each node, -1 where there are fewer),
    vectors, layers, links.
    """
    # The smallest ids of each different vector, first within parts of a frequent vector's rows, then of all.
    part = Window.partitionBy("v", F.pmod(F.xxhash64("id"), F.lit(32))).orderBy("id")
    whole = Window.partitionBy("v").orderBy("id")
    few = vectors.withColumn("r", F.row_number().over(part)).where(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= k + 1)
    nodes = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    dealt = nodes.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("v"), F.lit(shards)).alias("shard"), "v", "ids")

    def build(key, table):
        table = table.sort_by([("first", "ascending")])
        x = np.array(table.column("v").to_pylist(), dtype=np.float64)
        ids = np.full((len(x), k + 1), -1, dtype=np.int64)
        for r, some in enumerate(table.column("ids").to_pylist()):
            ids[r, : len(some)] = some
        _, links = build_graph(x)
        return pa.table(
            {
                "dim": pa.array([key[0].as_py()], pa.int32()),
                "shard": pa.array([key[1].as_py()], pa.int64()),
                "nodes": pa.array([len(x)], pa.int32()),
                "ids": pa.array([ids.tobytes()], pa.binary()),
                "vectors": pa.array([_packed(x)], pa.binary()),
                "layers": pa.array([len(links)], pa.int32()),
                "links": pa.array([links.tobytes()], pa.binary()),
            }
        )

    shape = "dim int, shard long, nodes int, ids binary, vectors binary, layers int, links binary"
    return dealt.withColumn("first", F.col("ids")[0]).groupBy("dim", "shard").applyInArrow(build, shape)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(-1))


def _search_shards(k: int):
    """Rows of a shard beside a block of queries: each query's k best in that shard."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                n, dim = row["nodes"], row["dim"]
                x = np.frombuffer(row["vectors"]).reshape(n, dim)
                ids = np.frombuffer(row["ids"], dtype=np.int64).reshape(n, k + 1)
                links = np.frombuffer(row["links"], dtype=np.int32).reshape(row["layers"], n, LINKS)
                query_ids = np.array(row["query_ids"], dtype=np.int64)
                queries = np.array(row["queries"], dtype=np.float64).reshape(-1, dim)
                found, _ = search_graph(x, links, queries, max(SEARCH_WIDTH, 2 * k))
                out = []
                for qi, nodes in enumerate(found):
                    nodes = nodes[nodes >= 0]
                    own = ids[nodes]
                    d = np.repeat(_exact(x[nodes], queries[qi]), k + 1)
                    own = own.ravel()
                    fine = (own >= 0) & (own != query_ids[qi])
                    own, d = own[fine], d[fine]
                    for j in np.lexsort((own, d))[:k]:
                        out.append((int(query_ids[qi]), int(own[j]), float(d[j])))
                cols = list(zip(*out, strict=True)) if out else [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found for each row of ``queries`` among ``vectors``.

    ``score`` is the Euclidean distance in double precision; ties go to the smaller id. A query's own
    id is no candidate.
    """
    spark = vectors.sparkSession
    clean = staged(clean_vectors(vectors, id_col, vector_col), "vectors")
    total = clean.count()
    shards = max(1, -(-total // SHARD_ROWS))
    index = staged(build_index(clean, k, shards), "graphs")
    asked = clean_vectors(queries, id_col, vector_col)
    number = asked.count()
    blocks = max(1, -(-number // QUERY_BLOCK))
    in_blocks = (
        asked.groupBy(F.size("v").alias("dim"), F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("q"))
        .select("dim", "block", F.col("q.id").alias("query_ids"), F.col("q.v").alias("queries"))
    )
    in_blocks = staged(in_blocks, "query-blocks")
    # Every block of the queries visits every shard: the links stay where they are, blocks are copied.
    visits = in_blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")))
    met = visits.repartition(max(1, min(shards, partitions(spark))), "dim", "shard").join(index.hint("shuffle_hash"), ["dim", "shard"])
    met = met.select("dim", "nodes", "ids", "vectors", "layers", "links", "query_ids", F.flatten("queries").alias("queries"))
    found = met.mapInArrow(_search_shards(k), "query_id long, id long, score double")
    # An id with several vectors counts once for a query, by its nearest.
    once = found.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
