"""Approximate nearest neighbours by hierarchical navigable small-world graphs, one per shard.

Largest inner products are searched as nearest points: a vector gets one more component that brings all of a shard's to
one length, and then the nearest in angle has the greatest product. Each shard holds its vectors and, for each level,
a flat array of neighbour numbers (-1 where there are fewer). Rows come in batches that double up to ``BATCH``: each
batch is searched in the graph so far from the top level down, joined by its own nearest, and linked to ``LINKS``
neighbours chosen so that none is nearer to another chosen one than to the new row (then filled up with the nearest);
links go both ways, and a full list is chosen anew. While the graph so far has ``SCANNED`` nodes at most, a row's nearest
come from a scan of them, which is both quicker there and exact. Levels are drawn from a hash of the id. Searches walk
with a beam of ``BEAM`` candidates or more: each graph measures its recall, on ``TRIED`` of its own nodes against a scan,
and doubles the beam until it finds ``GOAL`` of the nearest, up to all of the shard. Searches walk the graph at every
size; ``exact`` asks all shards to scan in blocks instead. Scores are inner products of the original vectors in double precision.

Shards: by a hash of vec_id, one for each ``SHARD_ROWS`` rows, so a shard's memory doesn't grow with the table, and by
dimension: vectors of different lengths have no product. Queries go to every shard, and the shards' results are merged. In a shard the
vectors come first and are indexed, then queries stream through, so a task holds one shard.

Equal vectors are one node that keeps all their ids, so crowds of them don't cut the graph off.

Vectors that are null, empty, all zeros, or hold a null, NaN or infinite component take no part, nor do rows with a
null vec_id. A repeated vec_id is one candidate for each row; a query isn't matched with rows of its own vec_id, and
repeated query rows are one query (the vector that sorts first). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._shared import mixed, ragged, task

SHARD_ROWS, LINKS, BEAM, BATCH = 16_384, 16, 96, 1024
SCANNED, TRIED, GOAL = 16_384, 64, 0.97
#: Cells of the table of visited nodes: bounds how many queries walk at a time.
VISITED = 1 << 25


def usable(df: DataFrame) -> DataFrame:
    """vec_id bigint and embedding array<double> of the rows that take part."""
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0))


class Graph:
    """A shard's graph, built once from all its rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, links: int = LINKS, beam: int = BEAM, k: int = 20, exact: bool = False):
        self.links, self.beam, self.scans = links, beam, exact
        keys = np.ascontiguousarray(vectors + 0.0).view(np.dtype((np.void, 8 * vectors.shape[1]))).ravel()
        _, first, group = np.unique(keys, return_index=True, return_inverse=True)
        order = np.lexsort((ids, group))
        self.ids, self.id_at = ids[order], np.concatenate([[0], np.cumsum(np.bincount(group))])
        self.vectors = vectors[first]
        size = (self.vectors**2).sum(axis=1)
        points = np.column_stack([self.vectors, np.sqrt(np.maximum(size.max() - size, 0))]) / np.sqrt(size.max())
        if exact:
            self.rows, self.points = [np.arange(len(first))], [points.astype(np.float32)]
            return
        n, lead = len(first), self.ids[self.id_at[:-1]].astype(np.uint64)
        draw = (mixed(lead).astype(np.float64) + 1) / 2.0**64
        level = np.floor(-np.log(np.clip(draw, 1e-18, 1)) / np.log(links)).astype(int)
        order = np.argsort(mixed(lead + np.uint64(1)), kind="stable")
        #: Of each level its nodes in the order they come, their points, and the flat neighbour array.
        self.rows = [order[level[order] >= k] for k in range(int(level.max()) + 1)]
        self.points = [points[x].astype(np.float32) for x in self.rows]
        self.flat = [np.full((len(x), (1 + (k == 0)) * links), -1, dtype=np.int32) for k, x in enumerate(self.rows)]
        self.place = []
        for k, rows in enumerate(self.rows):
            self.place.append(np.full(n, -1, dtype=np.int32))
            self.place[k][rows] = np.arange(len(rows))
            self._build(k)
        self._tune(k_found=k)

    def _tune(self, k_found: int) -> None:
        """Raises the beam until a sample of the nodes finds ``GOAL`` of its nearest, to all nodes at most."""
        points = self.points[0]
        k = min(k_found + 1, len(points))
        # as queries are: without the last component, and none that walks begin at
        some = np.setdiff1d(np.random.default_rng(len(points)).integers(0, len(points), TRIED), self._entries(len(points), 1))
        tried = points[some].copy()
        tried[:, -1] = 0
        tried /= np.maximum(np.linalg.norm(tried, axis=1, keepdims=True), 1e-12)
        least = np.sort(tried @ points.T, axis=1)[:, -k][:, None]
        while len(some) and self.beam < len(points):
            _, score = self._descend(tried, k)
            score = score[:, :k]
            if (score >= least - 1e-6).sum() >= GOAL * k * len(tried):
                return
            self.beam *= 2
        self.beam = min(self.beam, len(points))

    def _build(self, level: int) -> None:
        points, flat = self.points[level], self.flat[level]
        low, step = 0, 256
        while low < len(points):
            high = min(len(points), low + step)
            new = points[low:high]
            near = new @ new.T
            np.fill_diagonal(near, -2)
            width = min(self.beam, high - low)
            own = np.argpartition(-near, width - 1, axis=1)[:, :width]
            found, score = own + low, np.take_along_axis(near, own, axis=1)
            if low:
                far, told = self._scan(points[:low], new, self.beam) if low <= SCANNED else self._walk(points[:low], flat, new, self.beam, self._entries(low, len(new)))
                found, score = np.concatenate([found, far], axis=1), np.concatenate([score, told], axis=1)
            flat[low:high, : self.links] = self._chosen(points, np.where(score > -2, found, -1), score, self.links)
            self._link_back(points, flat, low, high)
            low, step = high, min(BATCH, 2 * step)

    @staticmethod
    def _scan(points: np.ndarray, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``most`` nearest of ``points`` for each query, and their scores, in blocks."""
        most = min(most, len(points))
        found, score = np.empty((len(queries), most), dtype=np.int64), np.empty((len(queries), most), dtype=np.float32)
        step = max(1, VISITED // 4 // len(points))
        for low in range(0, len(queries), step):
            near = queries[low : low + step] @ points.T
            best = np.argpartition(near, len(points) - most, axis=1)[:, len(points) - most :]
            found[low : low + step], score[low : low + step] = best, np.take_along_axis(near, best, axis=1)
        return found, score

    @staticmethod
    def _entries(n: int, queries: int) -> np.ndarray:
        """Nodes spread over the first n, from which a walk may start."""
        return np.tile(np.unique(np.linspace(0, n - 1, 48).astype(np.int64)), (queries, 1))

    @staticmethod
    def _chosen(points: np.ndarray, found: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
        """``most`` of each row's candidates: first those nearer to it than to any chosen, then the nearest others."""
        order = np.argsort(-np.where(found >= 0, score, -3), axis=1, kind="stable")[:, : 3 * most]
        found, score = np.take_along_axis(found, order, axis=1), np.take_along_axis(score, order, axis=1)
        out = np.full((len(found), most), -1, dtype=np.int32)
        for low in range(0, len(found), 128):
            f, s = found[low : low + 128], score[low : low + 128]
            p = points[np.maximum(f, 0)]
            among = p @ p.transpose(0, 2, 1)
            take = np.zeros(f.shape, dtype=bool)
            for j in range(f.shape[1]):
                blocked = (take[:, :j] & (among[:, j, :j] > s[:, j, None])).any(axis=1)
                take[:, j] = (f[:, j] >= 0) & ~blocked & (take[:, :j].sum(axis=1) < most)
            rank = np.argsort(np.where(f < 0, 2, np.where(take, 0, 1)), axis=1, kind="stable")[:, :most]
            out[low : low + 128, : rank.shape[1]] = np.take_along_axis(f, rank, axis=1)
        return out

    def _link_back(self, points: np.ndarray, flat: np.ndarray, low: int, high: int) -> None:
        """Links from the neighbours of the rows ``low`` to ``high`` back to these; full lists are chosen anew."""
        target, source = flat[low:high, : self.links].ravel().astype(np.int64), np.repeat(np.arange(low, high), self.links)
        order = np.argsort(target, kind="stable")
        order = order[target[order] >= 0]
        target, source = target[order], source[order]
        starts = np.flatnonzero(np.diff(target, prepend=-1))
        sizes, most = np.diff(np.append(starts, len(target))), flat.shape[1]
        for part in range(0, len(starts), 256):
            at, n = starts[part : part + 256], sizes[part : part + 256]
            more = np.full((len(at), int(n.max())), -1, dtype=np.int64)
            more[np.arange(more.shape[1]) < n[:, None]] = source[at[0] : at[-1] + n[-1]]
            both = np.sort(np.concatenate([flat[target[at]], more], axis=1), axis=1)[:, ::-1].copy()
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            full = (both >= 0).sum(axis=1) > most
            few = np.sort(both[~full], axis=1)[:, ::-1][:, :most]
            flat[target[at[~full]], : few.shape[1]] = few
            if full.any():
                own = both[full]
                score = (points[np.maximum(own, 0)] @ points[target[at[full]]][:, :, None])[:, :, 0]
                flat[target[at[full]]] = self._chosen(points, own, score, most)

    @staticmethod
    def _walk(points: np.ndarray, flat: np.ndarray, queries: np.ndarray, beam: int, begun: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the best ``beam`` of ``points`` that a walk from ``begun`` finds (-1: none), and their scores."""
        n, block = len(points), max(1, VISITED // len(points))
        if len(queries) > block:
            parts = [Graph._walk(points, flat, queries[k : k + block], beam, begun[k : k + block]) for k in range(0, len(queries), block)]
            return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        found, score = np.full((len(queries), beam), -1, dtype=np.int64), np.full((len(queries), beam), -2, dtype=np.float32)
        done, seen, live = np.zeros((len(queries), beam), dtype=bool), np.zeros((len(queries), n), dtype=bool), np.arange(len(queries))
        new = begun
        while len(live):
            new = np.sort(np.where((new >= 0) & (new < n), new, -1), axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new[seen[live[:, None], np.maximum(new, 0)]] = -1
            r, c = np.nonzero(new >= 0)
            told = np.full(new.shape, -2, dtype=np.float32)
            told[r, c] = np.einsum("id,id->i", points[new[r, c]], queries[live[r]])
            seen[live[r], new[r, c]] = True
            f, s = np.concatenate([found[live], new], axis=1), np.concatenate([score[live], told], axis=1)
            d = np.concatenate([done[live], np.zeros(new.shape, dtype=bool)], axis=1)
            best = np.argpartition(-s, beam - 1, axis=1)[:, :beam]
            f, s, d = (np.take_along_axis(x, best, axis=1) for x in (f, s, d))
            ripe = np.where(d | (f < 0), -3, s)
            step = np.argpartition(-ripe, min(4, beam) - 1, axis=1)[:, : min(4, beam)]
            going = np.take_along_axis(ripe, step, axis=1) > -3
            node = np.take_along_axis(f, step, axis=1)
            mark = np.take_along_axis(d, step, axis=1) | going
            np.put_along_axis(d, step, mark, axis=1)
            found[live], score[live], done[live] = f, s, d
            on = going.any(axis=1)
            new = np.where(going[on][:, :, None], flat[np.maximum(node[on], 0)], -1).reshape(int(on.sum()), step.shape[1] * flat.shape[1]).astype(np.int64)
            live = live[on]
        return found, score

    def _descend(self, unit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places on the lowest level (-1: none) and scores found by walks from the top level down, best first."""
        nodes = np.zeros((len(unit), 0), dtype=np.int64)
        for level in range(len(self.rows) - 1, -1, -1):
            points = self.points[level]
            begun = np.concatenate([self.place[level][nodes[:, :8]], self._entries(len(points), len(unit))], axis=1)
            found, score = self._walk(points, self.flat[level], unit, max(k, self.beam if level == 0 else 16), begun)
            order = np.argsort(-score, axis=1, kind="stable")
            found, score = np.take_along_axis(found, order, axis=1), np.take_along_axis(score, order, axis=1)
            nodes = np.where(found >= 0, self.rows[level][np.maximum(found, 0)], self.rows[level][0])
        return found, score

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, vec_id, product), the k best found for each query but rows of its own id."""
        unit = np.column_stack([queries, np.zeros(len(queries))])
        unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
        if self.scans:
            # single precision may swap near ties: take more, of which the exact products choose
            nodes, _ = self._scan(self.points[0], unit, 2 * k + 20)
            found, nodes = nodes, self.rows[0][nodes]
        else:
            found, _ = self._descend(unit, k + 1)
            nodes = np.where(found >= 0, self.rows[0][np.maximum(found, 0)], self.rows[0][0])
        r, c = np.nonzero(found >= 0)
        node = nodes[r, c]
        exact = np.einsum("id,id->i", self.vectors[node], queries[r])
        size = np.minimum(np.diff(self.id_at)[node], k + 1)
        ids, at = ragged(self.ids, np.column_stack([self.id_at[node], self.id_at[node] + size]).ravel(), 2 * np.arange(len(node)))
        r, exact = np.repeat(r, np.diff(at)), np.repeat(exact, np.diff(at))
        good = ids != own[r]
        r, ids, exact = r[good], ids[good], exact[good]
        order = np.lexsort((ids, -exact, r))
        r, ids, exact = r[order], ids[order], exact[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        return r[rank < k], ids[rank < k], exact[rank < k]


def _shard_results(k: int, links: int, beam: int, exact: bool):
    @task("ann")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, graph = None, [], [], None
        for batch in batches:
            shard, size, kind = (batch.column(x).to_numpy() for x in ("shard", "size", "kind"))
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(size) != 0) | (np.diff(kind) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                if (int(shard[low]), int(size[low])) != key:
                    key, ids, vectors, graph = (int(shard[low]), int(size[low])), [], [], None
                own = part.column("vec_id").to_numpy()
                values = np.asarray(part.column("embedding").flatten()).reshape(len(own), -1)
                if kind[low] == 0:
                    ids.append(own)
                    vectors.append(values)
                    continue
                if graph is None:
                    if not ids:
                        continue
                    graph = Graph(np.concatenate(ids), np.concatenate(vectors), links, beam, k, exact)
                    ids, vectors = [own[:0]], []
                for start in range(0, len(own), BATCH):
                    q = own[start : start + BATCH]
                    r, found, score = graph.search(values[start : start + BATCH], q, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q[r]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def neighbours(df: DataFrame, every: int = 20, k: int = 20, shards: int | None = None, links: int = LINKS, beam: int = BEAM, exact: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row whose vec_id is divisible by ``every``.

    ``shards``: as many as the table's rows need, if not given. ``exact``: every shard is scanned, none indexed.
    """
    shards = shards or max(1, -(-df.count() // SHARD_ROWS))
    rows = usable(df)
    vectors = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "vec_id", "embedding")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    queries = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "embedding")
    both = vectors.union(queries).withColumn("size", F.size("embedding"))
    dealt = both.repartition(4 * shards, "shard", "size").sortWithinPartitions("shard", "size", "kind", "vec_id")
    found = dealt.mapInArrow(_shard_results(k, links, beam, exact), "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
