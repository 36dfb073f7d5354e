"""Operator 7: near duplicates by improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

Exact copies are one node. Nodes that share a band key are compared with one centre of the bucket, not with one another; one minus
weighted Jaccard is a metric, so that after the comparison with a centre only nodes that the triangle inequality leaves open need
another centre. Nodes linked to different centres of a bucket stay in it. What a few rounds leave is compared pair by pair, but for
pairs of one class, pairs whose distances to a centre rule a link out, and pairs whose similarity cannot reach the threshold because
too much of either text occurs in no other candidate. Classes are the connected components of verified links.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import Memo, bounded_batches, column, fresh, materialize, table, use

WORDS, SIMILARITY = 5, 0.8
#: Samples in a band and bands: a pair of similarity 0.8 shares a band key with probability 1 - (1 - 0.8^3)^10 = 0.9992.
ROWS, BANDS = 3, 10
#: Cells of the sketch of document frequencies, a power of two. A cell also counts other shingles; their mean number, distinct shingles of all
#: documents over CELLS, is taken off, and what is left of the error is its spread, the root of that number. Some 100 million distinct
#: shingles leave a spread of 10; larger corpora want more cells, at 4 bytes each in every worker.
CELLS = 1 << 20
#: The weight of a shingle is tf * (FLOOR + (1 - FLOOR) * idf / largest idf), so that a large group's common shingles still count.
FLOOR = 0.7
#: Rounds of centres before what is left of a bucket is compared pair by pair. The last round's centres are nodes already linked, if there
#: are any, since open nodes are most often near one of these.
ROUNDS = 3
#: A bucket is crowded while the nodes outside its largest class times all its nodes are more than this many pairs; then these nodes are first
#: compared with CENTRES nodes of that class, up to SETTLING times, which links most of them. What is left is still compared pair by pair.
CROWD, CENTRES, SETTLING = 20_000, 4, 6

_CHUNKS = 32
_M64 = (1 << 64) - 1
_U = np.uint64
_POWERS = [_U(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1) for i in range(WORDS)]


class _Words(Memo):
    def __missing__(self, word: str) -> int:
        self.room()
        self[word] = value = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return value


_words = _Words(200_000)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of WORDS words (lower case, cut at white space) of a whole text, ascending, and how often each occurs.

    A text of fewer words is one shingle; a text without words has none.
    """
    words = text.lower().split()
    h = np.fromiter(map(_words.__getitem__, words), _U, len(words))
    if not len(h):
        return h, np.zeros(0, np.int64)
    n = max(1, len(h) - WORDS + 1)
    total = np.zeros(n, _U)
    for i in range(min(WORDS, len(h))):
        total += h[i : i + n] * _POWERS[i]
    return np.unique(_mix(total), return_counts=True)


def document_frequencies(docs: DataFrame, size: int = CELLS) -> tuple[np.ndarray, int]:
    """In how many documents each cell's shingles occur, over all documents, and the number of documents.

    Every partition counts into `size` counters; their sum is merged in two steps by chunk. Only the merged sketch, of fixed size, reaches the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use(_words)
        cells, n = np.zeros(size, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for a in range(0, batch.num_rows, 1_000):
                parts = [shingles(t)[0] for t in batch.column(0).slice(a, 1_000).to_pylist()]
                cells += np.bincount((np.concatenate(parts) & _U(size - 1)).astype(np.int64), minlength=size)
        if n:
            from pyspark import TaskContext

            context = TaskContext.get()
            salt = context.partitionId() % 16 if context else 0
            step = size // _CHUNKS
            data = [zlib.compress(cells[i * step : (i + 1) * step].astype("<i8").tobytes(), 1) for i in range(_CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(_CHUNKS), pa.int32()), pa.array([salt] * _CHUNKS, pa.int32()), pa.array([n] * _CHUNKS, pa.int64()), pa.array(data, pa.binary())], names=["chunk", "salt", "n", "cells"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(c), "<i8") for c in rows["cells"])
        return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "salt": [rows["salt"].iloc[0]], "n": [int(rows["n"].sum())], "cells": [zlib.compress(total.astype("<i8").tobytes(), 1)]})

    kind = "chunk int, salt int, n bigint, cells binary"
    merged = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(count, kind).groupBy("chunk", "salt").applyInPandas(add, kind).groupBy("chunk").applyInPandas(add, kind)
    got = sorted(merged.collect(), key=lambda r: r.chunk)
    if not got:
        return np.zeros(size, np.int64), 0
    return np.concatenate([np.frombuffer(zlib.decompress(r.cells), "<i8") for r in got]), got[0].n


def weights(cells: np.ndarray, documents: int) -> np.ndarray:
    """Of each cell the damped idf of its shingles: the cell's count less the mean load of other shingles is the estimate of df."""
    load = (cells.sum() - cells) / max(1, len(cells) - 1)
    df = np.clip(cells - load, 1, max(1, documents))
    idf = np.clip(np.log((documents + 1) / (df + 1)) / math.log(documents + 2), 0, 1)
    return (FLOOR + (1 - FLOOR) * idf).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling: r and c from Gamma(2, 1) and beta uniform, from tables of 65536 draws that a hash of shingle and sample picks."""

    def __init__(self, weight: np.ndarray):
        rng = np.random.default_rng(20101213)
        self.weight = weight
        self.r = np.maximum(rng.gamma(2, 1, 65536), 1e-4).astype(np.float32)
        self.log_c = np.log(np.maximum(rng.gamma(2, 1, 65536), 1e-6)).astype(np.float32)
        self.seeds = rng.integers(0, 1 << 63, ROWS * BANDS).astype(_U)

    def bands(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> list[list[int] | None]:
        """BANDS keys of each document that has shingles."""
        out: list[list[int] | None] = [None] * len(docs)
        full = [i for i, (h, _) in enumerate(docs) if len(h)]
        if not full:
            return out
        h = np.concatenate([docs[i][0] for i in full])
        sizes = np.array([len(docs[i][0]) for i in full])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        w = np.concatenate([docs[i][1] for i in full]) * self.weight[(h & _U(len(self.weight) - 1)).astype(np.int64)]
        log_w = np.log(w).astype(np.float32)
        keys = np.zeros((len(full), BANDS), _U)
        for k, seed in enumerate(self.seeds):
            x = (h ^ seed) * _U(0xBF58476D1CE4E5B9)
            x ^= x >> _U(29)
            x *= _U(0x94D049BB133111EB)
            r = self.r[(x >> _U(48)).astype(np.int64)]
            beta = ((x >> _U(16)) & _U(0xFFFF)).astype(np.float32) / np.float32(65536)
            t = np.floor(log_w / r + beta)
            a = self.log_c[((x >> _U(32)) & _U(0xFFFF)).astype(np.int64)] - r * (t - beta + 1)
            least = np.minimum.reduceat(a, starts)
            at = np.flatnonzero(a == np.repeat(least, sizes))
            at = at[np.searchsorted(at, starts)]
            sample = _mix(h[at] ^ (t[at].astype(np.int64).astype(_U) * _U(0x9E3779B97F4A7C15)))
            keys[:, k // ROWS] = _mix(keys[:, k // ROWS] * _U(3) + sample + _U(k // ROWS + 1))
        for i, row in zip(full, keys.astype(np.int64), strict=True):
            out[i] = row.tolist()
        return out


def similarity(a: bytes | pa.Buffer, b: bytes | pa.Buffer, weight: np.ndarray) -> float:
    """Weighted Jaccard of two feature strings: per shingle the smaller tf weight over the larger; 1 for two texts without shingles."""
    (ha, ca), (hb, cb) = (np.frombuffer(f, "<u4").reshape(2, -1) for f in (a, b))
    wa, wb = weight[ha & (len(weight) - 1)], weight[hb & (len(weight) - 1)]
    total = float((ca * wa).sum(dtype=np.float64) + (cb * wb).sum(dtype=np.float64))
    if not len(ha) or not len(hb):
        return 0.0 if total else 1.0
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    same = hb[at] == ha
    shared = float((np.minimum(ca[same], cb[at[same]]) * wa[same]).sum(dtype=np.float64))
    return shared / (total - shared)


def features(text: str) -> bytes:
    """The low 32 bits of each shingle's hash, ascending, which also name its cell; then their frequencies."""
    h, n = shingles(text)
    low, where = np.unique(h & _U(0xFFFFFFFF), return_inverse=True)
    return np.concatenate([low.astype("<u4"), np.bincount(where, weights=n, minlength=len(low)).astype("<u4")]).tobytes()


def components(edges: DataFrame) -> DataFrame:
    """(node, class): the smallest node that links (a, b) connect each node with; smallest neighbours and pointer jumps until nothing changes."""
    edges = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", narrow=True)
    labels = materialize(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("class")).withColumnRenamed("a", "node"), "labels", narrow=True)
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("class").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("class").alias("old"), F.least("class", "near").alias("class"))
        jump = labels.select(F.col("node").alias("class"), F.col("class").alias("further"))
        step = materialize(step.join(jump, "class", "left").select("node", "old", F.least("class", F.coalesce("further", "class")).alias("class")), "labels", narrow=True)
        changed = step.where(F.col("old") != F.col("class")).limit(1).count()
        labels = step.select("node", "class")
        if not changed:
            return labels


def classes(docs: DataFrame, similar: float = SIMILARITY, cells: int = CELLS) -> DataFrame:
    """(doc_id, class_id) for each row of docs: class_id is the smallest doc_id among the rows it is linked with, directly or through others.

    Equal texts, empty ones included, are linked; null text counts as empty. Rows with one doc_id are one document, and so all texts of
    that doc_id are linked. Null doc_ids are compared with nothing and have class_id null. Links join texts with weighted Jaccard
    similarity of at least `similar`. cells: the size of the sketch of document frequencies.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    weight = spark.sparkContext.broadcast(weights(*document_frequencies(base, cells)))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(weight.value)
        use(_words)
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                some = batch.slice(a, 200)
                keys = sampler.bands([shingles(t) for t in some.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "digest", "bands"])

    # a node is a text: the number of one of its rows in the written table, and the smallest doc_id that has it
    signed = materialize(base.select("doc_id", digest.alias("digest"), "text").mapInArrow(sign, "doc_id bigint, digest binary, bands array<bigint>").withColumn("row", F.monotonically_increasing_id()), "signed")
    known = signed.where("doc_id is not null")
    copies = materialize(known.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("doc"), F.first("bands").alias("bands")), "copies")
    keyed = copies.select("node", F.explode(F.array_distinct("bands")).alias("key"))
    # a written side of a join lets Spark split a crowded key over tasks
    crowded = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "crowded", narrow=True)
    active = materialize(keyed.join(crowded, "key").withColumn("open", F.lit(True)), "buckets", narrow=True)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use(_words)
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                some = batch.slice(a, 200)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(map(features, some.column(1).to_pylist()), pa.binary())], names=["node", "f"])

    # of a text's copies the rows of its smallest doc_id are enough
    wanted = copies.join(active.select("node").distinct(), "node", "left_semi").select("node", F.col("doc").alias("doc_id"), "digest")
    one = base.where("doc_id is not null").withColumn("digest", digest).join(wanted, ["doc_id", "digest"]).groupBy("doc_id", "digest", "node").agg(F.min("text").alias("text"))
    described = materialize(one.select("node", "text").mapInArrow(describe, "node bigint, f binary"), "features")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use(_words)
        for batch in batches:
            # as views of the batch: a pair's features are not copied
            s = [similarity(a.as_buffer(), b.as_buffer(), weight.value) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=["a", "b", "s"])

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        left = described.select(F.col("node").alias("a"), F.col("f").alias("fa"))
        right = described.select(F.col("node").alias("b"), F.col("f").alias("fb"))
        return materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "fa", "fb").mapInArrow(compare, "a bigint, b bigint, s double"), name)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use(_words)
        for batch in batches:
            for node, f in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h, n = np.frombuffer(f.as_buffer(), "<u4").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), node, np.int64)), pa.array(h.astype(np.int64)), pa.array(n * weight.value[h & (len(weight.value) - 1)].astype(np.float64))], names=["node", "h", "w"])

    def bounded(buckets: DataFrame) -> DataFrame:
        """Buckets with each node's weight and the weight of its shingles that other nodes of any bucket have too: no overlap can be larger.

        Nodes go of which that share is too small for any link; similarity is at most overlap / weight.
        """
        rows = described.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "f").mapInArrow(spread, "node bigint, h bigint, w double")
        rows = materialize(rows, "spread")
        own = rows.groupBy("h").agg(F.count("*").alias("n"), F.first("node").alias("node"), F.first("w").alias("w")).where("n = 1").groupBy("node").agg(F.sum("w").alias("own"))
        sized = rows.groupBy("node").agg(F.sum("w").alias("weight")).join(own, "node", "left").select("node", "weight", (F.col("weight") - F.coalesce("own", F.lit(0.0))).alias("common"))
        return materialize(buckets.join(sized.where(F.col("common") >= similar * F.col("weight") - 1e-6), "node"), "buckets", narrow=True)

    links, told_d = None, []
    gap = 1 - similar
    for i in range(ROUNDS):
        if i + 1 < ROUNDS:
            centre = active.where("open").groupBy("key").agg(F.min("node").alias("b"))
        else:
            centre = active.groupBy("key").agg(F.min_by("node", F.struct("open", F.xxhash64("node"))).alias("b"))
        centre = materialize(centre, "centres", narrow=True)
        pairs = active.join(centre, "key").where("node <> b")
        scored = verified(pairs.select(F.col("node").alias("a"), "b").distinct(), "verified")
        new = scored.where(F.col("s") >= similar).select("a", "b")
        links = new if links is None else links.unionByName(new)
        kept = [*([] if i == 0 else ["weight", "common"]), *told_d]
        told = pairs.join(scored.select(F.col("a").alias("node"), "b", "s"), ["node", "b"]).select("key", "node", "open", *kept, (1 - F.col("s")).alias(f"d{i}"), (F.col("s") >= similar).alias("linked"))
        told = materialize(told, "told", narrow=True)
        told_d.append(f"d{i}")
        # a linked node is still needed if a node that the centre is not linked with, open or not, may lie within reach of it
        nearest = materialize(told.where("not linked").groupBy("key").agg(F.min(f"d{i}").alias("least")), "nearest", narrow=True)
        left = told.join(nearest, "key").where(~F.col("linked") | (F.col(f"d{i}") >= F.col("least") - gap - 1e-9))
        active = materialize(left.select("key", "node", (F.col("open") & ~F.col("linked")).alias("open"), *kept, f"d{i}"), "buckets", narrow=True)
        if i == 0:
            active = bounded(active)
    for settling in range(SETTLING + 1):
        # nodes that links already connect need no further comparison; of two nodes of different classes at least one is outside the
        # bucket's largest class; buckets of one class have no such node
        classed = materialize(active.join(components(links), "node", "left").withColumn("class", F.coalesce("class", "node")), "buckets", narrow=True)
        largest = classed.groupBy("key", "class").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("class", F.struct("n", "class")).alias("largest"), F.count("*").alias("classes")).where("classes > 1").drop("classes")
        told = materialize(classed.join(materialize(largest, "largest", narrow=True), "key").withColumn("minor", F.col("class") != F.col("largest")).drop("largest"), "buckets", narrow=True)
        crowded = told.groupBy("key").agg((F.count("*") * F.count_if("minor")).alias("pairs")).where(F.col("pairs") > CROWD).select("key")
        crowded = materialize(crowded, "crowded", narrow=True)
        if settling == SETTLING or crowded.isEmpty():
            break
        told = materialize(told.join(crowded, "key", "left_semi").select("key", "node", "minor"), "crowd", narrow=True)
        centres = told.where(~F.col("minor")).groupBy("key", F.pmod(F.xxhash64("node"), F.lit(CENTRES)).alias("share")).agg(F.min_by("node", F.xxhash64("node", F.lit(settling))).alias("b"))
        pairs = told.where("minor").select("key", F.col("node").alias("a")).join(materialize(centres.select("key", "b"), "centres", narrow=True), "key")
        new = verified(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "verified").where(F.col("s") >= similar).select("a", "b")
        if new.isEmpty():
            break
        links = links.unionByName(new)
    active = classed.join(classed.groupBy("node").agg(F.array_sort(F.collect_set("key")).alias("keys")), "node")
    active = materialize(active.join(materialize(largest, "largest", narrow=True), "key").withColumn("minor", F.col("class") != F.col("largest")).drop("largest"), "buckets", narrow=True)
    one = active.where("minor").select("key", F.col("node").alias("a"), F.col("weight").alias("wa"), F.col("common").alias("ca"), F.col("keys").alias("ka"), F.col("class").alias("class_a"), *(F.col(d).alias(f"{d}_a") for d in told_d))
    other = active.select(F.col("key").alias("key_b"), F.col("node").alias("b"), F.col("minor").alias("other"), F.col("weight").alias("wb"), F.col("common").alias("cb"), F.col("keys").alias("kb"), F.col("class").alias("class_b"), *(F.col(d).alias(f"{d}_b") for d in told_d))
    # similarity is at most overlap / (both weights - overlap), and the overlap at most either node's common weight
    may_link = F.least("ca", "cb") * (1 + similar) >= similar * (F.col("wa") + F.col("wb")) - 1e-6
    for d in told_d:
        may_link &= F.abs(F.col(f"{d}_a") - F.col(f"{d}_b")) <= gap + 1e-9
    rest = one.join(other, (F.col("key") == F.col("key_b")) & ((F.col("a") < F.col("b")) | ~F.col("other")) & may_link & (F.col("class_a") != F.col("class_b")) & (F.array_min(F.array_intersect("ka", "kb")) == F.col("key")))  # a pair once, in its first common bucket
    rest = verified(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "verified-rest")
    links = links.unionByName(rest.where(F.col("s") >= similar).select("a", "b"))
    # texts that one doc_id has
    node_of = known.select("doc_id", "digest").distinct().join(copies.select("digest", "node"), "digest").select("doc_id", "node")
    shared = node_of.groupBy("doc_id").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    links = links.unionByName(node_of.join(shared, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b"))
    found = components(links)
    of_node = copies.select("digest", "node", "doc").join(found, "node", "left").withColumn("class", F.coalesce("class", "node"))
    least = of_node.groupBy("class").agg(F.min("doc").alias("class_id"))
    of_text = materialize(of_node.join(least, "class").select("digest", "class_id"), "classes", narrow=True)
    return known.select("doc_id", "digest").join(of_text, "digest").select("doc_id", "class_id").unionByName(signed.where("doc_id is null").select("doc_id", F.lit(None).cast("bigint").alias("class_id")))


def keep_one(docs: DataFrame, similar: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class: that of the smallest doc_id (of rows with this doc_id the first text); rows with null doc_id stay."""
    of_class, place = fresh(docs, "class", "place")
    kept = classes(docs, similar).where("doc_id = class_id").select(F.col("doc_id").alias(of_class)).distinct()
    order = Window.partitionBy("doc_id").orderBy("text")
    one = docs.join(kept, F.col("doc_id") == F.col(of_class), "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(*map(column, docs.columns))
    return one.unionByName(docs.where("doc_id is null"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document with its class of near duplicates."""
    return classes(table(spark, sf_dir, "documents"))
