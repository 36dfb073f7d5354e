"""Operator 9: token ids in files of independently reset, checksummed blocks, coded by context mixing and a range coder.

The mixing rule: orders 2 and 1 hold one guess each, the id that last followed the same two ids and the same id; the interval is shared
out among the guesses by their confidence, and what remains goes to order 0, which adapts by groups of 64 ids.

A file row (Parquet holds the rows, so that Spark commits and finds them on any store) is a segment: the documents it holds, their
lengths, and its ids in blocks of BLOCK ids. Every block starts from an empty model, so any block can be read alone; blocks of a
segment are coded side by side, one numpy lane each.

Model of a block: the id that last followed the two ids before (order 2) and the one that last followed the id before (order 1), each
with a confidence that grows on hits and halves on misses; their shares of the interval are mixed by confidence. What neither
predicts is coded by order 0: adaptive frequencies of groups of 64 ids, renewed every REBUILD ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import range_bounds, range_bucket, scratch_path, table, tasks, texts
from graphloom.llm.word_ids import encoder

#: Ids in a block, blocks coded side by side, slots of a block's order-1 and order-2 tables, ids between renewals of order 0.
BLOCK, LANES, SLOTS, REBUILD = 2_048, 2_048, 1_024, 64
GROUP, END_ID, IDS_LIMIT = 64, 2, 1 << 16
_BITS, _ZERO_BITS = 16, 15
_GROUPS = IDS_LIMIT // GROUP
_HEAD = struct.Struct("<4sHHIII")  # magic, version, reserved, ids, payload words, crc32 of ids count and payload
_MAGIC, _VERSION = b"GLRC", 1
_U = np.uint64
_M32 = _U(0xFFFFFFFF)
#: Interval shares by confidence, of 65536: the surer, the larger. The rest is left for order 0.
_SHARE = np.array([6000, 16000, 26000, 34000, 40000, 45000, 49000, 52000, 54000, 56000, 57500, 58500, 59500, 60200, 60800, 61400], np.int64)

SEGMENT = "bucket int, bucket_start bigint, doc_ids array<bigint>, lengths array<bigint>, blocks array<binary>"


class CorruptBlock(ValueError):
    """A block whose header or checksum is wrong."""


class _Model:
    """The state of all lanes; encoder and decoder drive it alike."""

    def __init__(self, lanes: int):
        self.lanes, self.row = lanes, np.arange(lanes)
        self.off = self.row * SLOTS
        self.tables = [np.full(lanes * SLOTS, -16, np.int32) for _ in range(2)]  # id * 16 + confidence; id -1: none
        self.before = np.zeros(lanes, np.int64)
        self.last = np.zeros(lanes, np.int64)
        self.counts = np.ones((lanes, _GROUPS), np.int32)
        self.edges = np.zeros((lanes, _GROUPS + 1), np.int32)
        self.steps = 0

    def predict(self) -> None:
        if self.steps % REBUILD == 0:
            # every group keeps one unit of the interval; the rest goes by count
            total = self.counts.sum(axis=1, keepdims=True)
            np.cumsum(1 + self.counts.astype(np.int64) * ((1 << _ZERO_BITS) - _GROUPS) // total, axis=1, out=self.edges[:, 1:])
            self.edges[:, -1] = 1 << _ZERO_BITS
            self.flat_edges = self.edges.ravel()
        self.steps += 1
        self.at = [self.off + (((self.last * 40503 + self.before * 30011) >> 4) & (SLOTS - 1)), self.off + (self.last & (SLOTS - 1))]
        self.entry = [t[i] for t, i in zip(self.tables, self.at, strict=True)]
        (e2, e1) = self.entry
        self.guess = [e2 >> 4, e1 >> 4]
        two = np.where(e2 < 0, 1, _SHARE[e2 & 15])
        one = ((65536 - two) * _SHARE[e1 & 15]) >> 16
        self.two, self.both = two, two + np.where((e1 < 0) | (self.guess[0] == self.guess[1]), 1, one)

    def learn(self, ids: np.ndarray, literal: np.ndarray) -> None:
        for table, at, entry, guess in zip(self.tables, self.at, self.entry, self.guess, strict=True):
            hit = guess == ids
            sure = entry & 15
            table[at] = np.where(hit, entry + (sure < 15), np.where((sure > 0) & (entry >= 0), (entry - sure) + (sure >> 1), ids << 4))
        if len(literal):
            self.counts[literal, ids[literal] // GROUP] += 24
        self.before, self.last = self.last, ids


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of BLOCK ids each, the last one shorter; ids below 65536."""
    if len(ids) and int(ids.max()) >= IDS_LIMIT:
        raise ValueError("ids must be below 65536")
    out: list[bytes] = []
    for a in range(0, len(ids), BLOCK * LANES):
        part = ids[a : a + BLOCK * LANES].astype(np.int64)
        lanes = -(-len(part) // BLOCK)
        sizes = np.full(lanes, BLOCK)
        sizes[-1] = len(part) - BLOCK * (lanes - 1)
        steps = int(sizes.max())
        grid = np.zeros(lanes * BLOCK, np.int64)
        grid[: len(part)] = part
        grid = np.ascontiguousarray(grid.reshape(lanes, BLOCK).T)
        model = _Model(lanes)
        low, span = np.zeros(lanes, _U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U)
        words, count = np.zeros((lanes, BLOCK + 8), np.uint32), np.zeros(lanes, np.int64)

        def narrow(at, start, size, bits):  # noqa: ANN001, ANN202
            lo, sp = (low, span) if at is None else (low[at], span[at])
            unit = sp >> _U(bits)
            lo = lo + unit * start.astype(_U)
            sp = unit * size.astype(_U)
            same = ((lo ^ (lo + sp)) >> _U(32)) == 0
            cut = (sp <= _M32) & ~same
            sp = np.where(cut, (~lo + _U(1)) & _M32, sp)
            send = np.flatnonzero(same | cut)
            if len(send):
                lane = send if at is None else at[send]
                words[lane, count[lane]] = (lo[send] >> _U(32)).astype(np.uint32)
                count[lane] += 1
                lo[send] <<= _U(32)
                sp[send] <<= _U(32)
            return lo, sp

        for t in range(steps):
            if t >= sizes[-1] and lanes > 1 and sizes[-1] < steps and t == sizes[-1]:
                grid[t:, -1] = 0
            x = grid[t]
            model.predict()
            hit2 = model.guess[0] == x
            hit1 = (model.guess[1] == x) & ~hit2
            two, both = model.two, model.both
            start = np.where(hit2, 0, np.where(hit1, two, both))
            size = np.where(hit2, two, np.where(hit1, both, 65536) - start)
            low, span = narrow(None, start, size, _BITS)
            literal = np.flatnonzero(~(hit1 | hit2))
            if len(literal):
                own = x[literal]
                place = literal * (_GROUPS + 1) + own // GROUP
                edge = model.flat_edges[place]
                width = model.flat_edges[place + 1] - edge
                lo, sp = narrow(literal, edge.astype(np.int64) * GROUP + (own % GROUP) * width, width, _ZERO_BITS + 6)
                low[literal], span[literal] = lo, sp
            model.learn(x, literal)
        for _ in range(2):
            words[np.arange(lanes), count] = (low >> _U(32)).astype(np.uint32)
            count += 1
            low = low << _U(32)
        for lane in range(lanes):
            payload = words[lane, : count[lane]].astype("<u4").tobytes()
            n = int(sizes[lane])
            out.append(_HEAD.pack(_MAGIC, _VERSION, 0, n, int(count[lane]), zlib.crc32(payload, n)) + payload)
    return out


def decode_blocks(blocks: list[bytes]) -> np.ndarray:
    """The ids of some blocks, in order. Each block is checked first."""
    done: list[np.ndarray] = []
    for a in range(0, len(blocks), LANES):
        some = blocks[a : a + LANES]
        lanes, sizes = len(some), np.zeros(len(some), np.int64)
        words = None
        payloads = []
        for k, b in enumerate(some):
            if len(b) < _HEAD.size:
                raise CorruptBlock(f"block {a + k} is cut short")
            magic, version, _, n, n_words, check = _HEAD.unpack_from(b)
            payload = b[_HEAD.size :]
            if magic != _MAGIC or version != _VERSION or len(payload) != 4 * n_words or zlib.crc32(payload, n) != check:
                raise CorruptBlock(f"block {a + k} fails its check")
            sizes[k] = n
            payloads.append(payload)
        words = np.zeros((lanes, max(len(p) for p in payloads) // 4 + 4), np.uint32)
        for k, p in enumerate(payloads):
            words[k, : len(p) // 4] = np.frombuffer(p, "<u4")
        flat_words, stride = words.ravel(), words.shape[1]
        model = _Model(lanes)
        low, span = np.zeros(lanes, _U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U)
        code = (words[:, 0].astype(_U) << _U(32)) | words[:, 1].astype(_U)
        read = np.full(lanes, 2, np.int64)
        steps = int(sizes.max())
        grid = np.zeros((steps, lanes), np.int64)

        def narrow(at, start, size, unit, lo, sp, co):  # noqa: ANN001, ANN202
            lo = lo + unit * start.astype(_U)
            sp = unit * size.astype(_U)
            same = ((lo ^ (lo + sp)) >> _U(32)) == 0
            cut = (sp <= _M32) & ~same
            sp = np.where(cut, (~lo + _U(1)) & _M32, sp)
            take = np.flatnonzero(same | cut)
            if len(take):
                lane = take if at is None else at[take]
                nxt = flat_words[lane * stride + np.minimum(read[lane], stride - 1)]
                read[lane] += 1
                lo[take] <<= _U(32)
                sp[take] <<= _U(32)
                co[take] = (co[take] << _U(32)) | nxt.astype(_U)
            return lo, sp, co

        for t in range(steps):
            model.predict()
            two, both = model.two, model.both
            unit = span >> _U(_BITS)
            value = np.minimum((code - low) // unit, _U(65535)).astype(np.int64)
            hit2 = value < two
            hit1 = (value < both) & ~hit2
            start = np.where(hit2, 0, np.where(hit1, two, both))
            size = np.where(hit2, two, np.where(hit1, both, 65536) - start)
            low, span, code = narrow(None, start, size, unit, low, span, code)
            x = np.where(hit2, model.guess[0], model.guess[1]).astype(np.int64)
            literal = np.flatnonzero(value >= both)
            if len(literal):
                lo, sp, co = low[literal], span[literal], code[literal]
                unit = sp >> _U(_ZERO_BITS + 6)
                value = np.minimum((co - lo) // unit, _U((1 << (_ZERO_BITS + 6)) - 1)).astype(np.int64)
                target = value // GROUP
                base = literal * (_GROUPS + 1)
                group = np.zeros(len(literal), np.int64)
                half = _GROUPS // 2
                while half:
                    group += half * (model.flat_edges[base + group + half] <= target)
                    half //= 2
                edge = model.flat_edges[base + group].astype(np.int64)
                width = model.flat_edges[base + group + 1] - edge
                rest = (value - edge * GROUP) // width
                x[literal] = group * GROUP + rest
                low[literal], span[literal], code[literal] = narrow(literal, edge * GROUP + rest * width, width, unit, lo, sp, co)
            # past its end a lane decodes what the encoder padded, id 0
            grid[t] = x
            model.learn(x, literal)
        done += [grid[: sizes[k], k] for k in range(lanes)]
    return np.concatenate(done).astype("<u4") if done else np.zeros(0, "<u4")


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Encode every text, append end_id, and write segments in ascending doc_id order under path; returns (bucket, total) of each file range.

    doc_id ranges from an approximate percentile over all ids make the ranges, so that no sort passes through one task. Null doc_ids
    come first; rows with one doc_id are ordered by text.
    """
    spark = docs.sparkSession
    n = tasks(spark)
    bounds = range_bounds(docs, "doc_id", n)
    ordered = docs.withColumn("bucket", range_bucket(F.col("doc_id"), bounds)).repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "text").select("bucket", "doc_id", "text")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, begun, held, doc_ids, size = None, 0, [], [], 0

        def row() -> pa.RecordBatch:
            lengths = [len(x) for x in held]
            coded = encode_blocks(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([begun], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([coded], pa.list_(pa.binary()))], names=[c.split(" ")[0] for c in SEGMENT.split(", ")])

        for batch in batches:
            coded = encoder(tokenizer_path).encode(batch.column(2))
            for b, doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), coded, strict=True):
                if held and (b != bucket or size >= BLOCK * LANES):
                    yield row()
                    begun, held, doc_ids, size = begun + size if b == bucket else 0, [], [], 0
                bucket = b
                held.append(np.append(ids, np.uint32(end_id)))
                doc_ids.append(doc_id)
                size += len(ids) + 1
        if held:
            yield row()

    ordered.mapInArrow(segments, SEGMENT).write.option("compression", "none").parquet(path)
    written = spark.read.schema(SEGMENT).parquet(path)
    return written.select("bucket", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total")).groupBy("bucket").agg(F.sum("total").alias("total"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, bucket_start, doc_id, n_tokens, ids binary) from the files; bucket_start counts the ids before in the document's range. Ids are little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                bucket, begun, doc_ids, lengths, blocks = (batch.column(c)[r].as_py() for c in range(5))
                ids = decode_blocks(blocks)
                ends = np.cumsum(lengths)
                for a in range(0, len(doc_ids), 2_000):
                    own = slice(a, a + 2_000)
                    starts = ends[own] - np.array(lengths[own])
                    raw = [ids[s:e].tobytes() for s, e in zip(starts, ends[own], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(raw), pa.int32()), pa.array(starts + begun, pa.int64()), pa.array(doc_ids[own], pa.int64()), pa.array(lengths[own], pa.int64()), pa.array(raw, pa.binary())], names=["bucket", "bucket_start", "doc_id", "n_tokens", "ids"])

    return spark.read.schema(SEGMENT).parquet(path).mapInArrow(run, "bucket int, bucket_start bigint, doc_id bigint, n_tokens bigint, ids binary")


def op9_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: write the ids of all documents, read the files back, and tell each document's place, length and checksum from them.

    The driver holds one total for each range, at most spark.sql.shuffle.partitions.
    """
    import public_tokenizers as public

    path = scratch_path(spark, "ids")
    totals = write_ids(texts(table(spark, sf_dir, "documents")), path, public.path("word_bpe_49k.json"))
    before, offsets = 0, []
    for r in sorted(totals.collect(), key=lambda r: r.bucket):
        offsets.append((r.bucket, before))
        before += r.total
    ranges = spark.createDataFrame(offsets, "bucket int, before bigint")
    return read_ids(spark, path).join(F.broadcast(ranges), "bucket").select("doc_id", (F.col("before") + F.col("bucket_start")).alias("start"), "n_tokens", F.crc32("ids").alias("ids_crc32"))
