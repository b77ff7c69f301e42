"""Approximate nearest neighbours: balanced posting lists with replicated boundaries, found through a graph of centroids."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablecheck.llm.common import materialise, spread_key, unit

#: Vectors in the sample that fits the centroids, and lists at most: both bound what the driver and tasks hold.
TRAIN, MAX_LISTS = 20_000, 8192
#: Vectors for each list, before replication; vectors of a block, the unit of work of one task.
LIST_SIZE, BLOCK = 128, 4096
#: A vector also goes to lists up to so much farther than its nearest one, so many in all.
REPLICATE, REPLICAS = 1.1, 4
#: A query looks into lists up to so much farther than its nearest one, at most so many or a quarter of all.
PROBE_RATIO, PROBES = 1.2, 128


def balanced_centroids(sample: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of leaves of equal size: each set is halved at the median of the difference of distances to two means."""
    leaves = [sample]
    while len(leaves) < lists and max(map(len, leaves)) > 1:
        halves = []
        for x in leaves:
            if len(x) < 2:
                halves.append(x)
                continue
            a, b = x[rng.choice(len(x), 2, replace=False)]
            for _ in range(6):
                lean = x @ (a - b)
                cut = np.argsort(lean, kind="stable")
                low, high = cut[: len(x) // 2], cut[len(x) // 2 :]
                a, b = x[high].mean(axis=0), x[low].mean(axis=0)
            halves += [x[low], x[high]]
        leaves = halves
    return np.array([x.mean(axis=0) for x in leaves], np.float32)


@dataclass
class CentroidGraph:
    """Each centroid with its nearest others and a few random ones, searched best-first from fixed entries."""

    centroids: np.ndarray
    neighbours: np.ndarray

    @staticmethod
    def build(centroids: np.ndarray, degree: int = 24, far: int = 8, seed: int = 3) -> CentroidGraph:
        n, rng = len(centroids), np.random.default_rng(seed)
        norms = (centroids**2).sum(axis=1)
        degree = min(degree, n)
        near = np.empty((n, degree), np.int64)
        for s in range(0, n, 1024):
            d = norms - 2 * centroids[s : s + 1024] @ centroids.T
            near[s : s + 1024] = np.argpartition(d, degree - 1, axis=1)[:, :degree]
        return CentroidGraph(centroids, np.hstack([near, rng.integers(0, n, (n, far))]))

    def search(self, vectors: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids found of each vector, nearest first, and their distances (inf past the end)."""
        n, many = len(self.centroids), len(vectors)
        beam = min(beam, n)
        norms, own = (self.centroids**2).sum(axis=1), (vectors**2).sum(axis=1)
        row = np.arange(many)[:, None]
        entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(int))
        seen = np.zeros((many, n), bool)
        seen[:, entries] = True
        ids = np.full((many, beam + 1), -1)
        dist = np.full((many, beam + 1), np.inf)
        done = np.zeros((many, beam + 1), bool)

        def distances(which: np.ndarray) -> np.ndarray:
            return own[:, None] + norms[which] - 2 * np.einsum("md,mkd->mk", vectors, self.centroids[which], optimize=True)

        new = np.broadcast_to(entries, (many, len(entries)))
        new_dist = distances(new)
        while True:
            ids = np.hstack([ids[:, :beam], new])
            dist = np.hstack([dist[:, :beam], new_dist])
            done = np.hstack([done[:, :beam], np.zeros(new.shape, bool)])
            order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            ids, dist, done = ids[row, order], dist[row, order], done[row, order]
            open_dist = np.where(done, np.inf, dist)
            if not np.isfinite(open_dist).any():
                return ids, np.sqrt(np.maximum(dist, 0))
            # the nearest few that were not looked at yet, of every vector
            step = np.argsort(open_dist, axis=1, kind="stable")[:, :4]
            live = np.isfinite(open_dist[row, step])
            done[row, step] = True
            new = np.where(live[:, :, None], self.neighbours[np.where(live, ids[row, step], 0)], -1).reshape(many, -1)
            fresh = (new >= 0) & ~seen[row, np.maximum(new, 0)]
            sort = np.sort(np.where(fresh, new, n), axis=1)
            fresh = (sort < n) & np.hstack([np.ones((many, 1), bool), sort[:, 1:] != sort[:, :-1]])
            new = np.where(fresh, sort, 0)
            seen[np.broadcast_to(row, new.shape)[fresh], new[fresh]] = True
            new_dist = np.where(fresh, distances(new), np.inf)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(-1, dim)


def _assigner(graph: CentroidGraph, dim: int, beam: int, ratio: float, most: int):
    """Lists of each vector: those within ``ratio`` of the nearest, ``most`` at most."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for s in range(0, whole.num_rows, 1024):
                batch = whole.slice(s, 1024)
                ids, dist = graph.search(_matrix(batch.column("vec"), dim).astype(np.float32), beam)
                near = (dist <= ratio * dist[:, :1] + 1e-12) & np.isfinite(dist)
                lists = [i[ok][:most].tolist() for i, ok in zip(ids, near, strict=True)]
                yield pa.record_batch([batch.column("id"), batch.column("vec"), pa.array(lists, pa.list_(pa.int32()))], names=["id", "vec", "lists"])

    return run


def _search_block(k: int):
    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(vectors):
            vectors = vectors.sort_values("id", kind="stable")
            base = np.stack(vectors["vec"].to_numpy())
            ids, first = np.unique(vectors["id"].to_numpy(), return_index=True)
            for q, v in zip(queries["query_id"], queries["qvec"], strict=True):
                diff = base - v
                d = np.sqrt((diff * diff).sum(axis=1))
                d = np.minimum.reduceat(d, first) if len(first) < len(d) else d  # an id has one place, that of its nearest row
                d[ids == q] = np.inf
                near = np.argpartition(d, k)[:k] if len(d) > k else np.arange(len(d))
                near = np.flatnonzero(d <= d[near].max()) if len(d) > k else near  # ties go to the smaller id
                near = near[np.isfinite(d[near])]
                near = near[np.lexsort((ids[near], d[near]))][:k]
                out.append(pd.DataFrame({"query_id": q, "vec_id": ids[near], "score": d[near]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    return run


def usable_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec as doubles) of vectors that take part: with an id, neither null nor zero, all components finite numbers."""
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0))


def nearest_neighbours(table: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, list_size: int = LIST_SIZE,
                       probes: int = PROBES, probe_ratio: float = PROBE_RATIO, replicate: float = REPLICATE, replicas: int = REPLICAS, train: int = TRAIN, seed: int = 5) -> DataFrame:
    """The ``k`` nearest found of each query among all rows but those with its id: ``query_id``, ``rank``, ``vec_id``,
    ``score`` (Euclidean distance in double precision on the given vectors), ties to the smaller id.

    Centroids are fitted on at most ``train`` vectors drawn by a hash of id and vector, halved until lists hold about
    ``list_size`` vectors (at most ``MAX_LISTS``). Every vector is indexed: it goes to its nearest list and, if it lies
    near a boundary, to up to ``replicas`` lists. Queries find lists through the graph of centroids, within
    ``probe_ratio`` of the nearest, at most ``probes`` or a quarter of all lists, and are compared with all vectors of these. Lists are cut into
    blocks of about ``BLOCK`` vectors, so that one list may hold any share of the vectors. A query that has found
    fewer than min(k, all candidates) looks into all lists.

    Null, zero and non-finite vectors take no part, nor do those of another dimension than most, or without an id.
    Rows that repeat an id count once per query, with the nearest, before any list is cut to ``k``. Empty tables give an empty result; other columns
    are ignored.
    """
    base, asked = usable_vectors(table, id_col, vec_col), usable_vectors(queries, id_col, vec_col)
    spark = table.sparkSession
    key = spread_key(f"ann-{seed}", F.col("id"), F.xxhash64("vec"))
    common = base.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.approx_count_distinct(key).alias("different")).orderBy(F.desc("n"), "dim").first()
    if common is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim, total = common["dim"], common["n"]
    base, asked = base.filter(F.size("vec") == dim), asked.filter(F.size("vec") == dim)
    drawn = base.withColumn("key", key).filter(unit(F.col("key")) * common["different"] < 1.1 * train).groupBy("key").agg(F.first("vec").alias("vec")).orderBy("key").limit(train)
    sample = np.array([r["vec"] for r in drawn.select("vec").collect()], np.float32)
    lists = min(MAX_LISTS, max(1, 2 ** round(math.log2(max(1, total / list_size)))), len(sample))
    graph = CentroidGraph.build(balanced_centroids(sample, lists, np.random.default_rng(seed)))
    count = len(graph.centroids)

    assigned = base.mapInArrow(_assigner(graph, dim, 4 * replicas, replicate, replicas), "id bigint, vec array<double>, lists array<int>")
    postings = materialise(assigned.select("id", "vec", F.explode("lists").alias("list")), "postings")
    blocks = postings.groupBy("list").agg(F.count("*").alias("n")).select("list", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    blocks = F.broadcast(materialise(blocks, "lists"))  # one row for each of at most MAX_LISTS lists
    postings = postings.join(blocks, "list").select("id", "vec", "list", F.pmod(F.xxhash64("id", "vec"), F.col("blocks")).cast("int").alias("block"))
    probes = min(count, max(probes, count // 4))
    found_lists = asked.mapInArrow(_assigner(graph, dim, probes, probe_ratio, probes), "id bigint, vec array<double>, lists array<int>")
    probing = materialise(found_lists.select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"), "lists"), "probes")

    def search(probe: DataFrame) -> DataFrame:
        probe = probe.join(blocks, "list").select("query_id", "qvec", "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        hits = probe.groupBy("list", "block").cogroup(postings.groupBy("list", "block")).applyInPandas(_search_block(k), "query_id bigint, vec_id bigint, score double")
        return hits.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))

    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = lambda hits: hits.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    first = materialise(ranked(search(probing.select("query_id", "qvec", F.explode("lists").alias("list")))), "nearest")
    reach = min(k, base.agg(F.count_distinct("id")).first()[0])  # one too many where the query is among them: it looks again
    enough = first.groupBy("query_id").agg(F.max("rank").alias("got")).filter(F.col("got") >= reach)
    short = materialise(probing.join(enough, "query_id", "left_anti"), "short")
    if reach > 0 and short.take(1):
        everywhere = short.select("query_id", "qvec", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("list"))
        first = first.join(short.select("query_id"), "query_id", "left_anti").unionByName(ranked(search(everywhere)))
    return first.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
