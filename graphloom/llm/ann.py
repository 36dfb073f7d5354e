"""Operator 1: approximate nearest neighbours over balanced posting lists.

Vectors are grouped by value, so that copies are one entry with their smallest ids. Centroids are fitted on a bounded sample and
joined to a neighbour graph that every task holds; a best-first search on the graph finds the lists nearest to a vector. A vector is
posted to its nearest list and, if it lies near a boundary, to further lists by distance ratio; a query reads the lists whose
centroid is within a ratio of its nearest one. Lists and their queries are dealt to blocks of bounded size, so that neither a large
list nor many queries of one list meet in a single task. How many of its nearest lists every query reads besides is calibrated: it
is the number in which a sample of the queries finds RECALL of its true neighbours, known by comparison with every vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import materialize, table

K = 20
#: Vectors that the centroids are fitted on at most; wanted entries of a list; lists at most, so that centroids and graph have bounded size
#: in every task. Up to MAX_LISTS * LIST_SIZE vectors (1.3 million) a query's cost does not depend on their number; beyond, lists grow with
#: the table, and a query costs in proportion to it: a share of probes / MAX_LISTS of all vectors, dealt to blocks. Larger tables want
#: a larger MAX_LISTS, at dim * 4 + 224 bytes a list in each worker, and a SAMPLE of some five vectors a list.
SAMPLE, LIST_SIZE, MAX_LISTS = 40_000, 160, 8_192
#: Neighbours of a centroid in the graph.
DEGREE = 24
#: A boundary vector is posted to lists within this ratio of its nearest distance, to COPIES of them at most.
BOUNDARY, COPIES = 1.12, 4
#: A query reads of its PROBES nearest lists those within this ratio of its nearest distance, and as many lists as the calibration asks for.
REACH, PROBES = 1.35, 64
#: Queries of the calibration, and the share of their true neighbours that the lists read must hold.
TRIALS, RECALL = 256, 0.995
#: Of a query's lists so many, its nearest, are read first; from the others only what may be among the answers then is returned.
FIRST = 16
#: Entries of a list, or of its queries, in one block.
BLOCK = 2_048


@dataclass
class Centroids:
    """Points in the search space, their neighbour graph, and the entry points of a search."""

    points: np.ndarray
    neighbours: np.ndarray
    entries: np.ndarray

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the nearest centroids of each row, nearest first: best-first search for all rows in step."""
        n, size = len(x), min(beam, len(self.points))
        rows = np.arange(n)[:, None]
        norm = (self.points**2).sum(axis=1)
        dist = lambda ids: np.maximum(norm[ids] - 2 * np.einsum("nd,nkd->nk", x, self.points[ids]), -np.inf)
        start = np.broadcast_to(self.entries, (n, len(self.entries)))
        ids, seen = np.full((n, size), -1), np.zeros((n, len(self.points)), bool)
        d, expanded = np.full((n, size), np.inf), np.ones((n, size), bool)
        new, fresh = start, np.ones(start.shape, bool)
        while True:
            seen[rows, new] = True
            found = np.where(fresh, dist(new), np.inf)
            all_ids, all_d = np.concatenate([ids, new], axis=1), np.concatenate([d, found], axis=1)
            all_done = np.concatenate([expanded, ~fresh], axis=1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :size]
            ids, d, expanded = (np.take_along_axis(a, order, axis=1) for a in (all_ids, all_d, all_done))
            expanded |= np.isinf(d)
            if expanded.all():
                return ids, np.sqrt(np.maximum(d + (x**2).sum(axis=1, keepdims=True), 0))
            # the nearest entries not yet expanded, a few at a time
            pick = np.argsort(np.where(expanded, np.inf, d), axis=1, kind="stable")[:, : min(4, size)]
            live = ~np.take_along_axis(expanded, pick, axis=1)
            np.put_along_axis(expanded, pick, True, axis=1)
            new = self.neighbours[np.maximum(np.take_along_axis(ids, pick, axis=1), 0)].reshape(n, -1)
            fresh = np.repeat(live, self.neighbours.shape[1], axis=1) & ~seen[rows, new]
            order = np.argsort(new, axis=1, kind="stable")
            again = np.zeros_like(fresh)
            sorted_new, sorted_fresh = np.take_along_axis(new, order, axis=1), np.take_along_axis(fresh, order, axis=1)
            np.put_along_axis(again, order[:, 1:], (sorted_new[:, 1:] == sorted_new[:, :-1]) & sorted_fresh[:, :-1], axis=1)
            fresh &= ~again

    def nearest(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Like search, but exact."""
        d = (self.points**2).sum(axis=1) - 2 * x @ self.points.T
        ids = np.argsort(d, axis=1, kind="stable")[:, :most]
        return ids, np.sqrt(np.maximum(np.take_along_axis(d, ids, axis=1) + (x**2).sum(axis=1, keepdims=True), 0))


def fit(sample: np.ndarray, total: int, list_size: int = LIST_SIZE, max_lists: int = MAX_LISTS, seed: int = 5) -> Centroids:
    """Balanced clustering of the sample: clusters with too many members are split in two, again and again, until all are small enough."""
    rng = np.random.default_rng(seed)
    lists = int(max(1, min(max_lists, total // list_size, len(sample) // 4 or 1)))
    limit = max(2, -(-len(sample) // lists))
    points, open_groups = [], [np.arange(len(sample))]
    while open_groups:
        own = open_groups.pop()
        x = sample[own]
        if len(own) <= limit * 1.2 or len(points) + len(open_groups) + 1 >= max_lists:
            points.append(x.mean(axis=0))
            continue
        parts = int(min(16, max(2, round(len(own) / limit))))
        centre = x[rng.choice(len(x), parts, replace=False)].copy()
        crowd = np.zeros(parts)
        for _ in range(8):
            d = (centre**2).sum(axis=1) - 2 * x @ centre.T
            who = (d + crowd).argmin(axis=1)
            sizes = np.bincount(who, minlength=parts)
            crowd += 0.05 * d.std() * (sizes / len(x) * parts - 1)  # full clusters become dearer
            for c in np.flatnonzero(sizes):
                centre[c] = x[who == c].mean(axis=0)
        groups = [own[who == c] for c in range(parts) if sizes[c]]
        if len(groups) == 1:
            points.append(x.mean(axis=0))
        else:
            open_groups += groups
    points = np.array(points, np.float32)
    degree = min(DEGREE, len(points) - 1)
    near = np.zeros((len(points), max(1, degree)), np.int64)
    for a in range(0, len(points), 512):
        d = (points**2).sum(axis=1) - 2 * points[a : a + 512] @ points.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        if degree:
            near[a : a + 512] = np.argsort(d, axis=1)[:, :degree]
    # every point also keeps a few far links, so that the graph is connected in practice
    far = rng.integers(0, len(points), (len(points), 4))
    return Centroids(points, np.concatenate([near, far], axis=1), rng.choice(len(points), min(16, len(points)), replace=False))


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten(), np.float32).reshape(len(col), dim)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k candidates of largest inner product found, itself excluded.

    Both tables have (id, vector). Vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose
    length is not the most frequent one. Scores are inner products in double precision; ties go to the smaller id. Rows with one id
    count once, with the smallest vector.
    """
    spark = vectors.sparkSession
    clean = lambda df: df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    base, asked = clean(vectors), clean(queries)
    lengths = base.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if lengths is None:
        return spark.createDataFrame([], result)
    dim = lengths["dim"]
    # copies of a vector become one entry with its k + 1 smallest ids: no answer needs more of them
    order = Window.partitionBy("v").orderBy("vec_id")
    entries = (
        base.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))
        .withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
        .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .select(F.col("ids")[0].alias("entry"), "ids", "v", F.aggregate("v", F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double")).alias("square"))
    )
    entries = materialize(entries, "ann-entries")
    size = entries.agg(F.count("*").alias("n"), F.max("square").alias("top")).first()
    top = float(size.top)
    # with one more component that fills every vector up to the longest, the nearest point has the largest inner product
    some = entries.orderBy(F.xxhash64("entry")).limit(SAMPLE).select("v", "square").toPandas()
    sample = np.column_stack([np.stack(some["v"]).astype(np.float32), np.sqrt(np.maximum(top - some["square"].to_numpy(), 0))]).astype(np.float32)
    shared = spark.sparkContext.broadcast(fit(sample, size.n))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2_000):
                some = batch.slice(a, 2_000)
                x, square = _matrix(some.column(1), dim), np.asarray(some.column(2))
                r, lists = [], []
                for b in range(0, len(x), 512):
                    extra = np.sqrt(np.maximum(top - square[b : b + 512], 0))
                    ids, d = shared.value.search(np.column_stack([x[b : b + 512], extra]).astype(np.float32), 32)
                    keep = (d[:, :COPIES] <= BOUNDARY * d[:, :1] + 1e-6) & (ids[:, :COPIES] >= 0)
                    keep[:, 0] = True
                    at, c = np.nonzero(keep)
                    r.append(at + b)
                    lists.append(ids[at, c])
                r, lists = np.concatenate(r), np.concatenate(lists)
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), some.column(0).take(pa.array(r)), some.column(1).take(pa.array(r))], names=["list", "entry", "v"])

    def places(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        # a query's scale does not change its order: search at the length of the longest vector
        length = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
        return shared.value.nearest(np.column_stack([x * np.sqrt(top) / length, np.zeros(len(x))]).astype(np.float32), most)

    asked = asked.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    kinds = materialize(asked.groupBy("v").agg(F.min("vec_id").alias("query")).select("query", "v"), "ann-queries")
    posted = materialize(entries.select("entry", "v", "square").mapInArrow(post, "list int, entry bigint, v array<float>"), "ann-lists")
    trials = kinds.orderBy(F.xxhash64("query")).limit(TRIALS).toPandas()
    probes = 0
    if len(trials):
        tried = spark.sparkContext.broadcast(np.stack(trials["v"]).astype(np.float64))

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = len(tried.value)
            best, ids = np.full((n, 0), -np.inf), np.zeros((n, 0), np.int64)
            for batch in batches:
                for a in range(0, batch.num_rows, 2_000):
                    some = batch.slice(a, 2_000)
                    best = np.concatenate([best, tried.value @ _matrix(some.column(1), dim).astype(np.float64).T], axis=1)
                    ids = np.concatenate([ids, np.broadcast_to(some.column(0).to_numpy(), (n, some.num_rows))], axis=1)
                    order = np.argsort(-best, axis=1, kind="stable")[:, : k + 1]
                    best, ids = np.take_along_axis(best, order, axis=1), np.take_along_axis(ids, order, axis=1)
            if ids.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(n), ids.shape[1]), pa.int32()), pa.array(ids.ravel()), pa.array(best.ravel())], names=["trial", "entry", "score"])

        true = entries.select("entry", "v").mapInArrow(exact, "trial int, entry bigint, score double")
        true = true.withColumn("n", F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("score"), "entry"))).where(F.col("n") <= k + 1)
        # at most TRIALS * (k + 1) * COPIES rows
        held = posted.join(F.broadcast(true.select("trial", "entry")), "entry").select("trial", "entry", "list").toPandas()
        order, _ = places(np.stack(trials["v"]).astype(np.float32), len(shared.value.points))
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
        held["place"] = place[held["trial"], held["list"]]
        needed = np.sort(held.groupby(["trial", "entry"])["place"].min().to_numpy())
        probes = int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))) - 1)]) + 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                some = batch.slice(a, 256)
                ids, d = places(_matrix(some.column(1), dim), max(probes, PROBES))
                keep = d <= REACH * d[:, :1] + 1e-6
                keep[:, PROBES:] = False
                keep[:, : max(1, probes)] = True
                r, c = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(ids[r, c], pa.int32()), some.column(0).take(pa.array(r)), some.column(1).take(pa.array(r)), pa.array(c < FIRST)], names=["list", "query", "v", "first"])

    sought = materialize(kinds.mapInArrow(ask, "list int, query bigint, v array<float>, first boolean"), "ann-sought")
    def compare(entry_rows: pa.Table, query_rows: pa.Table) -> pa.Table:
        names = ["query", "entry", "score"]
        kinds_of = [pa.int64(), pa.int64(), pa.float64()]
        if not entry_rows.num_rows or not query_rows.num_rows:
            return pa.table([pa.array([], t) for t in kinds_of], names=names)
        ids = entry_rows.column("entry").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        x = _matrix(entry_rows.column("v").combine_chunks(), dim)[order].astype(np.float64)
        asks, known = query_rows.column("query").to_numpy(), query_rows.column("least").to_numpy()
        q = _matrix(query_rows.column("v").combine_chunks(), dim).astype(np.float64)
        most = min(k + 1, len(ids))
        out = []
        for a in range(0, len(asks), 256):
            rough = q[a : a + 256] @ x.T
            # all that may be among the first k + 1 once scores are summed in one fixed order
            least = np.maximum(np.partition(rough, len(ids) - most, axis=1)[:, len(ids) - most], known[a : a + 256])
            r, c = np.nonzero(rough >= (least - 1e-9 * (1 + np.abs(rough).max(axis=1)))[:, None])
            out.append((asks[a + r], ids[c], np.add.reduce(q[a + r] * x[c], axis=1)))
        query, entry, score = (np.concatenate(p) for p in zip(*out, strict=True))
        order = np.lexsort((entry, -score, query))
        query, entry, score = query[order], entry[order], score[order]
        first = np.r_[True, query[1:] != query[:-1]]
        place = np.arange(len(query)) - np.maximum.accumulate(np.where(first, np.arange(len(query)), 0))
        keep = place <= k
        return pa.table([pa.array(query[keep]), pa.array(entry[keep]), pa.array(score[keep])], names=names)

    key = ["list", "vb", "qb"]

    def read(part: DataFrame) -> DataFrame:
        """(query, entry, score) from the lists of part: (list, query, v, least), least being a score that entries must reach."""
        # at most MAX_LISTS rows
        blocks = posted.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("v_blocks")).join(part.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("q_blocks")), "list")
        blocks = F.broadcast(materialize(blocks, "ann-blocks"))
        left = posted.join(blocks, "list").select("list", F.pmod(F.xxhash64("entry"), "v_blocks").cast("int").alias("vb"), F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("qb"), "entry", "v")
        right = part.join(blocks, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("v_blocks") - 1)).alias("vb"), F.pmod(F.xxhash64("query"), "q_blocks").cast("int").alias("qb"), "query", "v", "least")
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "query bigint, entry bigint, score double")
        return materialize(found.groupBy("query", "entry").agg(F.max("score").alias("score")), "ann-found")

    near = read(sought.where("first").select("list", "query", "v", F.lit(float("-inf")).alias("least")))
    ranked = near.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("n") == k + 1)
    rest = sought.where("not first").join(ranked.select("query", F.col("score").alias("reached")), "query", "left")
    far = read(materialize(rest.select("list", "query", "v", F.coalesce("reached", F.lit(float("-inf"))).alias("least")), "ann-rest"))
    found = near.unionByName(far).groupBy("query", "entry").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    kept = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).join(entries.select("entry", "ids"), "entry")
    nearest = kept.select("query", "score", F.explode("ids").alias("vec_id")).withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    answers = nearest.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("answers"))
    # every asking row has the answers of its vector, less itself
    by_row = asked.join(kinds, "v").select(F.col("vec_id").alias("query_id"), "query").join(answers, "query")
    own = by_row.select("query_id", F.posexplode(F.slice(F.filter("answers", lambda a: a["vec_id"] != F.col("query_id")), 1, k)).alias("pos", "a"))
    return own.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("a.vec_id").alias("vec_id"), F.col("a.score").alias("score"))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the 20 nearest of every embedding whose vec_id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
