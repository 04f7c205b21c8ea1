"""Approximate nearest neighbours by largest inner product: a navigable small-world graph per shard.

Equal vectors become one node with the list of its least ids (as many as an answer can show), so
masses of copies don't tie up a graph.  Nodes are dealt to shards of bounded size by a hash of the
vector.  Each shard's graph is hierarchical: a node's top layer is drawn from a hash, each layer
is a flat array of neighbour numbers, and insertion goes in batches that search the graph so far
in lockstep.  One more coordinate makes all vectors of a shard equally long, which turns largest
inner product into nearest neighbour.  Nodes that the entry can't reach are linked to it at the
end.  Indexes are rows of a table in the shared folder.  Queries go to every shard; a task reads one
index once and lets its queries stream past in blocks (one task a shard for up to
``QUERIES_A_TASK`` queries, then more), and the shards' answers are merged.  All rows are indexed;
none is a sample.

Defined results: vectors that are null, zero, or hold null or non-finite components, rows without
an id, and vectors of another length than most (the longer, on ties) take no part; repeated rows
count once; a query's own id is never its neighbour; scores are double-precision products of the
original vectors, ties go to the smaller id; an id with several vectors asks with each and counts
with its nearest; columns beside id and vector play no part, whatever their names; an empty table
gives an empty one.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.llm import common as C

M, M0 = 16, 32
EF_BUILD, EF_SEARCH = 64, 192
SHARD_ROWS = 16384
QUERY_BLOCK = 1024
QUERIES_A_TASK = 65536
TOP = 20
EXPAND = 4


def _search(vectors: np.ndarray, graph: np.ndarray, queries: np.ndarray, entries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries in lockstep; numbers (-1: none) and products, best first."""
    q, n = len(queries), len(vectors)
    visited = np.zeros((q, n), bool)
    rows = np.arange(q)[:, None]
    ids = np.full((q, ef), -1, np.int32)
    near = np.full((q, ef), -np.inf, np.float32)
    opened = np.ones((q, ef), bool)
    ids[:, 0] = entries
    near[:, 0] = np.einsum("ij,ij->i", queries, vectors[entries])
    opened[:, 0] = False
    visited[np.arange(q), entries] = True
    live = np.arange(q)
    while len(live):
        waiting = ~opened[live]
        going = waiting.any(axis=1)
        live, waiting = live[going], waiting[going]
        if not len(live):
            break
        # the first few that wait; the beam is sorted, so they are the best
        turn = np.cumsum(waiting, axis=1)
        pick = waiting & (turn <= EXPAND)
        r, c = np.nonzero(pick)
        opened[live[r], c] = True
        around = np.full((len(live), EXPAND, graph.shape[1]), -1, np.int32)
        around[r, turn[r, c] - 1] = graph[ids[live[r], c]]
        around = around.reshape(len(live), -1)
        fresh = (around >= 0) & ~visited[live[:, None], around]
        r, c = np.nonzero(fresh)
        node = around[r, c]
        before = visited[live[r], node]
        visited[live[r], node] = True
        # one node may come from two sides at once: its last place counts
        place = r.astype(np.int64) * n + node
        order = np.argsort(place, kind="stable")
        single = np.ones(len(place), bool)
        single[order[:-1]] = place[order[1:]] != place[order[:-1]]
        keep = single & ~before
        r, c, node = r[keep], c[keep], node[keep]
        value = np.full(around.shape, -np.inf, np.float32)
        value[r, c] = np.einsum("ij,ij->i", queries[live[r]], vectors[node])
        all_near = np.concatenate([near[live], value], axis=1)
        all_ids = np.concatenate([ids[live], around], axis=1)
        all_open = np.concatenate([opened[live], np.isneginf(value)], axis=1)
        best = np.argpartition(-all_near, ef - 1, axis=1)[:, :ef]
        k = np.arange(len(live))[:, None]
        best = best[k, np.argsort(-all_near[k, best], axis=1)]
        near[live], ids[live], opened[live] = all_near[k, best], all_ids[k, best], all_open[k, best]
    ids[np.isneginf(near)] = -1
    del rows
    return ids, near


def _select(vectors: np.ndarray, owners: np.ndarray, cand: np.ndarray, near: np.ndarray, m: int) -> np.ndarray:
    """Up to m neighbours of each owner: candidates nearer to it than to those chosen before, then the nearest others."""
    order = np.argsort(-near, axis=1, kind="stable")
    k = np.arange(len(cand))[:, None]
    cand, near = cand[k, order], near[k, order]
    n = cand.shape[1]
    body = vectors[np.maximum(cand, 0)]
    among = body @ body.transpose(0, 2, 1)
    chosen = np.zeros(cand.shape, bool)
    count = np.zeros(len(cand), np.int64)
    for c in range(n):
        ok = (cand[:, c] >= 0) & (count < m) & ~((among[:, c] >= near[:, c, None]) & chosen).any(axis=1)
        chosen[:, c] = ok
        count += ok
    rank = np.where(chosen, 0, n) + np.arange(n)
    rank[cand < 0] = 3 * n
    take = np.argsort(rank, axis=1, kind="stable")[:, :m]
    out = cand[k, take]
    return np.pad(out, ((0, 0), (0, max(0, m - n))), constant_values=-1).astype(np.int32)


def _link_back(vectors: np.ndarray, graph: np.ndarray, sources: np.ndarray, targets: np.ndarray, m: int) -> None:
    """Adds source to the neighbours of target, choosing anew where there is no room."""
    order = np.argsort(targets, kind="stable")
    sources, targets = sources[order], targets[order]
    owners, first, count = np.unique(targets, return_index=True, return_counts=True)
    for a in range(0, len(owners), 2048):
        own, begin, size = owners[a : a + 2048], first[a : a + 2048], count[a : a + 2048]
        width = int(size.max())
        more = np.full((len(own), width), -1, np.int32)
        at = np.arange(width)[None, :] < size[:, None]
        more[at] = sources[(begin[:, None] + np.arange(width)[None, :])[at]]
        both = np.concatenate([graph[own], more], axis=1)
        free = (both >= 0).sum(axis=1) <= m
        if free.any():
            some = both[free]
            graph[own[free]] = some[np.arange(len(some))[:, None], np.argsort(some < 0, axis=1, kind="stable")][:, :m]
        full = ~free
        if full.any():
            cand = both[full]
            near = np.einsum("ikd,id->ik", vectors[np.maximum(cand, 0)], vectors[own[full]])
            near[cand < 0] = -np.inf
            if cand.shape[1] > 3 * m:
                top = np.argsort(-near, axis=1, kind="stable")[:, : 3 * m]
                k = np.arange(len(cand))[:, None]
                cand, near = cand[k, top], near[k, top]
            graph[own[full]] = _select(vectors, own[full], cand, near, m)


class Graph:
    """Layers of flat neighbour arrays over one shard's vectors (all of one length)."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], members: list[np.ndarray]) -> None:
        self.vectors, self.layers, self.members = vectors, layers, members  # layer 0 first; members: numbers of a layer's nodes

    @classmethod
    def build(cls, vectors: np.ndarray, draw: np.ndarray, ef: int = EF_BUILD) -> Graph:
        """draw: a uniform number in (0, 1] for each vector."""
        n = len(vectors)
        level = np.floor(-np.log(draw) / math.log(M)).astype(int)
        level[int(level.argmax())] = max(1, level.max())
        graph = cls(vectors, [], [])
        built: list[tuple[np.ndarray, np.ndarray]] = []
        for lv in range(int(level.max()), -1, -1):
            nodes = np.flatnonzero(level >= lv)
            m = M0 if lv == 0 else M
            links = np.full((len(nodes), m), -1, np.int32)
            body = vectors[nodes]
            if built:
                upper_nodes, upper_links = built[-1]
                order = np.argsort(~np.isin(nodes, upper_nodes), kind="stable")  # nodes of the layer above come first
            else:
                order = np.arange(len(nodes))
            done = 0
            start = np.searchsorted(nodes, built[-1][0]) if built else np.array([0])
            while done < len(order):
                batch = order[done : done + max(1, min(1024, max(64 if done else 1, done // 2)))]
                inside = order[:done]
                width = min(len(batch) - 1, 32)
                own = body[batch] @ body[batch].T
                np.fill_diagonal(own, -np.inf)
                near_in = np.argsort(-own, axis=1, kind="stable")[:, :width] if width else np.zeros((len(batch), 0), int)
                cand, near = batch[near_in].astype(np.int32), np.take_along_axis(own, near_in, 1) if width else np.zeros((len(batch), 0), np.float32)
                if done:
                    entry = graph._descend(body[batch], built, nodes, inside)
                    ids, got = _search(body, links, body[batch], entry, min(ef, max(1, done)))
                    cand, near = np.concatenate([ids[:, : 2 * m], cand], axis=1), np.concatenate([got[:, : 2 * m], near], axis=1)
                if cand.shape[1]:
                    links[batch] = _select(body, batch, cand, near, m)
                    r, c = np.nonzero(links[batch] >= 0)
                    _link_back(body, links, batch[r], links[batch][r, c], m)
                done += len(batch)
            cls._reach(body, links, int(start[0]))
            built.append((nodes, links))
        graph.members = [b[0] for b in reversed(built)]
        graph.layers = [b[1] for b in reversed(built)]
        return graph if n else cls(vectors, [], [])

    def _descend(self, queries: np.ndarray, built: list, nodes: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """A number in this layer to begin at: what the layers above, already built, lead to."""
        if not built:
            return np.full(len(queries), inside[0])
        at = np.zeros(len(queries), np.int64)
        for i, (upper, links) in enumerate(built):
            ids, _ = _search(self.vectors[upper], links, queries, at, 8)
            best = upper[ids[:, 0]]
            below = built[i + 1][0] if i + 1 < len(built) else nodes
            at = np.searchsorted(below, best)
        held = np.zeros(len(nodes), bool)
        held[inside] = True
        return np.where(held[at], at, inside[0])

    @staticmethod
    def _reach(vectors: np.ndarray, links: np.ndarray, start: int) -> None:
        """Links nodes that can't be reached from the start to the nearest one that can."""
        n, m = links.shape
        seen = np.zeros(n, bool)
        kept: set[tuple[int, int]] = set()
        front = np.array([start])
        seen[front] = True
        while True:
            while len(front):
                around = np.unique(links[front])
                front = around[(around >= 0)]
                front = front[~seen[front]]
                seen[front] = True
            lost = np.flatnonzero(~seen)
            if not len(lost):
                return
            u = int(lost[0])
            for v in np.argsort(-(vectors @ vectors[u]), kind="stable"):
                if not seen[v]:
                    continue
                free = [i for i in range(m - 1, -1, -1) if links[v, i] < 0 or (int(v), i) not in kept]
                empty = [i for i in free if links[v, i] < 0]
                slot = empty[-1] if empty else (free[0] if free else None)
                if slot is not None:
                    gone = links[v, slot]
                    links[v, slot] = u
                    kept.add((int(v), slot))
                    if gone >= 0 and not (links == gone).any():
                        seen[gone] = False
                    break
            seen[u] = True
            front = np.array([u])

    def search(self, queries: np.ndarray, ef: int) -> np.ndarray:
        """Numbers of about the ef nearest nodes, best first (-1: none)."""
        at = np.zeros(len(queries), np.int64)
        for i in range(len(self.layers) - 1, 0, -1):
            ids, _ = _search(self.vectors[self.members[i]], self.layers[i], queries, at, 8)
            at = np.searchsorted(self.members[i - 1], self.members[i][ids[:, 0]])
        return _search(self.vectors, self.layers[0], queries, at, min(ef, len(self.vectors)))[0]

    def packed(self) -> bytes:
        parts = [struct.pack("<I", len(self.layers))]
        for nodes, links in zip(self.members, self.layers, strict=True):
            parts += [struct.pack("<II", *links.shape), nodes.astype("<i4").tobytes(), links.astype("<i4").tobytes()]
        return b"".join(parts)

    @classmethod
    def unpacked(cls, vectors: np.ndarray, data: bytes) -> Graph:
        n, at, layers, members = struct.unpack_from("<I", data)[0], 4, [], []
        for _ in range(n):
            rows, width = struct.unpack_from("<II", data, at)
            members.append(np.frombuffer(data, "<i4", rows, at + 8).astype(np.int64))
            layers.append(np.frombuffer(data, "<i4", rows * width, at + 8 + 4 * rows).reshape(rows, width))
            at += 8 + 4 * rows * (1 + width)
        return cls(vectors, layers, members)


def longer(vectors: np.ndarray) -> np.ndarray:
    """Float32 vectors with one more coordinate that makes all equally long."""
    size = (vectors * vectors).sum(axis=1)
    return np.concatenate([vectors, np.sqrt(np.maximum(size.max(initial=0) - size, 0))[:, None]], axis=1).astype(np.float32)


def _valid(embeddings: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    v = F.col(embedding).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return embeddings.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where(good)


def _binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        flat, offsets = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8"), lists.offsets.to_numpy()
        flat = flat + 0.0  # one zero
        offsets = offsets - offsets[0] if len(offsets) else offsets
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([flat[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], ["id", "v"])


def _index(table: pa.Table) -> pa.Table:
    table = table.sort_by("v")
    bodies = table.column("v").to_pylist()
    vectors = np.frombuffer(b"".join(bodies), "<f8").reshape(len(bodies), -1)
    draw = ((C.mix64(np.frombuffer(b"".join(b[:8] for b in bodies), np.uint64) ^ C.mix64(np.arange(len(bodies), dtype=np.uint64) + np.uint64(1))) >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
    graph = Graph.build(longer(vectors), draw)
    ids = [np.array(x, np.int64) for x in table.column("ids").to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "vectors": pa.array([vectors.tobytes()], pa.binary()), "graph": pa.array([graph.packed()], pa.binary()), "ids": pa.array([np.concatenate(ids).tobytes()], pa.binary()), "offsets": pa.array([offsets.tobytes()], pa.binary())})


def build_index(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = SHARD_ROWS, top: int = TOP) -> tuple[DataFrame, int, int]:
    """The index (one row per shard), the number of shards, and the vectors' length."""
    rows = _valid(embeddings, vec_id, embedding)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    width = common[0]["n"] if common else 0
    flat = rows.where(F.size("v") == width).mapInArrow(_binary, "id long, v binary")
    least = lambda ids: F.slice(F.array_sort(F.array_distinct(F.flatten(ids))), 1, top + 1)
    some = flat.groupBy("v", F.pmod("id", F.lit(64)).alias("salt"), F.floor(F.col("id") / 65536).alias("far")).agg(F.slice(F.array_sort(F.collect_set("id")), 1, top + 1).alias("ids"))
    nodes = some.groupBy("v", "salt").agg(least(F.collect_list("ids")).alias("ids")).groupBy("v").agg(least(F.collect_list("ids")).alias("ids"))
    nodes = C.cut(nodes)
    shards = max(1, math.ceil(nodes.count() / shard_rows))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")).repartitionById(shards, "shard")
    index = dealt.groupBy("shard").applyInArrow(_index, "shard int, vectors binary, graph binary, ids binary, offsets binary")
    return C.cut(index), shards, width


class Shard:
    """One shard's index, ready for questions."""

    def __init__(self, row: dict, width: int) -> None:
        self.vectors = np.frombuffer(row["vectors"], "<f8").reshape(-1, width)
        self.offsets, self.ids = (np.frombuffer(row[c], np.int64) for c in ("offsets", "ids"))
        self.graph = Graph.unpacked(longer(self.vectors), row["graph"])

    def answer(self, queries: list[tuple[int, bytes]], top: int, ef: int) -> pa.RecordBatch:
        """query_id, vec_id and score of the nearest found for each query (id, vector)."""
        wanted = np.frombuffer(b"".join(v for _, v in queries), "<f8").reshape(len(queries), -1)
        found = self.graph.search(np.concatenate([wanted, np.zeros((len(wanted), 1))], axis=1).astype(np.float32), ef)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for (q, _), body, near in zip(queries, wanted, found, strict=True):
            near = near[near >= 0]
            score = self.vectors[near] @ body
            count = self.offsets[near + 1] - self.offsets[near]
            pick = self.ids[np.repeat(self.offsets[near] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]
            score = np.repeat(score, count)
            other = pick != q
            pick, score = pick[other], score[other]
            order = np.lexsort((pick, -score))
            pick, score = pick[order], score[order]
            first = np.sort(np.unique(pick, return_index=True)[1])[:top]  # an id with several vectors counts with its nearest
            out.append((np.full(len(first), q), pick[first], score[first]))
        return pa.RecordBatch.from_pydict({n: pa.array(np.concatenate([x[i] for x in out])) for i, n in enumerate(("query_id", "vec_id", "score"))})


def _answers(width: int, top: int, ef: int):
    """Rows sorted by part, an index before the queries that are put to it."""

    @C.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, waiting = None, None, []
        for batch in C.slices(batches):
            for row in batch.to_pylist():
                if row["part"] != part or len(waiting) >= QUERY_BLOCK:
                    if waiting and shard:
                        yield shard.answer(waiting, top, ef)
                    waiting = []
                if row["part"] != part:
                    part, shard = row["part"], None
                if row["graph"] is not None:
                    shard = Shard(row, width)
                else:
                    waiting.append((row["id"], row["v"]))
        if waiting and shard:
            yield shard.answer(waiting, top, ef)

    return task


def nearest(embeddings: DataFrame, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", top: int = TOP, ef: int = EF_SEARCH, shard_rows: int = SHARD_ROWS, queries_a_task: int = QUERIES_A_TASK) -> DataFrame:
    """For each row whose id is divisible by ``every``, its ``top`` nearest other rows: query_id, rank, vec_id, score."""
    own = C.Kept(embeddings, "unused int")
    rows = own.df.select(own.column(vec_id).alias("id"), own.column(embedding).alias("v"))
    index, shards, width = build_index(rows, "id", "v", shard_rows, top)
    asked = _valid(rows.where(F.col("id") % every == 0), "id", "v").where(F.size("v") == width)
    asked = C.cut(asked.dropDuplicates(["id", "v"]).mapInArrow(_binary, "id long, v binary"))
    copies = max(1, math.ceil(asked.count() / queries_a_task))  # of each shard's index, by which its queries are dealt
    none = [F.lit(None).cast(t).alias(c) for c, t in (("vectors", "binary"), ("graph", "binary"), ("ids", "binary"), ("offsets", "binary"))]
    sent = asked.withColumn("copy", F.pmod(F.xxhash64("id"), F.lit(copies)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    part = (F.col("shard") * copies + F.col("copy")).cast("int").alias("part")
    held = index.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select(part, F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("v"), "vectors", "graph", "ids", "offsets")
    both = held.unionByName(sent.select(part, "id", "v", *none))
    dealt = both.repartitionById(shards * copies, "part").sortWithinPartitions("part", F.col("graph").isNull())
    found = dealt.mapInArrow(_answers(width, top, ef), "query_id long, vec_id long, score double")
    # one id may have come from several shards, if it stands for several vectors
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
