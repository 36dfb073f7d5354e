"""Hashed words and labelled samples for the two document classifiers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from graphloom.llm.common import Memo, bounded_batches, fresh, map_whole_rows, use

_WORD = re.compile(r"\w+|[^\w\s]+")
#: Entries of a worker's cache of word hashes; only time depends on it.
_CACHE = 200_000
#: Words of the labelled sample at most, over all its documents: 8 bytes each on the driver.
SAMPLE_WORDS = 8_000_000


def _crc(word: str) -> int:
    return crc32(word.encode("utf-8", "surrogatepass"))


class _Hashes(Memo):
    """A word's hash in the low 32 bits, then 16 bits each of the hashes of its first four and first seven letters."""

    def __missing__(self, word: str) -> int:
        self.room()
        self[word] = value = _crc(word) | (_crc("^" + word[:4]) & 0xFFFF) << 32 | (_crc("^" + word[:7]) >> 16) << 48
        return value


_hashes = _Hashes(_CACHE)


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words and runs of punctuation of a whole text, in order and in lower case."""
    words = _WORD.findall(text.lower())
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def _hashed(rows: DataFrame, kind: str) -> DataFrame:
    """rows of (text, y, lang, place) with the hashes of the text's words, their low bits as numbers of this kind, in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use(_hashes)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                some = batch.slice(a, 256)
                words = [word_hashes(t).astype(kind).tobytes() for t in some.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *some.columns[1:]], names=["words", "y", "lang", "place"])

    return rows.select("text", "y", "lang", "place").mapInArrow(run, "words binary, y int, lang string, place bigint")


def labelled(docs: DataFrame, labels: DataFrame, label: str, held_out: tuple[int, int], max_rows: int, max_words: int = SAMPLE_WORDS, kind: str = "<u8") -> tuple[list[np.ndarray], np.ndarray, list[str]]:
    """Word hashes, labels and languages of at most max_rows labelled documents with max_words words in all, none of them held out.

    held_out = (modulus, remainder): rows whose crc32(doc_id as text) has that remainder are never read. Of the rest, the rows of docs
    that have a label and the lowest hashes of doc_id are taken, in that order, as long as both bounds hold, so that the sample is the
    same at every run; a document with two labels counts with the larger. That sample is all that reaches the driver. lang serves
    thresholds only. kind: "<u2" keeps the low 16 bits of each hash, where a model needs no more.
    """
    bounded_batches(docs.sparkSession)
    modulus, remainder = held_out
    present = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    chosen = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna()
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != remainder)
        .groupBy("doc_id").agg(F.max("y").alias("y")).join(present, "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), lang.alias("lang")).join(F.broadcast(chosen), "doc_id")
    order = ["place", "words", "y", "lang"]
    ordered = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # of at most max_rows rows
    sized = _hashed(rows.withColumn("place", F.xxhash64("doc_id")), kind).orderBy(*order).limit(max_rows).withColumn("so_far", F.sum(F.octet_length("words") / np.dtype(kind).itemsize).over(ordered))
    got = sized.where(F.col("so_far") <= max_words).select("words", "y", "lang").toArrow()
    return [np.frombuffer(w.as_buffer(), kind) for w in got.column(0)], got.column(1).to_numpy().astype(np.float64), got.column(2).to_pylist()


def score(docs: DataFrame, model_of: Callable[[], object]) -> DataFrame:
    """(doc_id, score) of whole texts; model_of() gives an object with scores(list of hash arrays) -> array. No shuffle; a batch's documents at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of()
        use(_hashes)
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for a in range(0, batch.num_rows, 256):
                hashes = [word_hashes(t) for t in text.slice(a, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([ids.slice(a, 256), pa.array(model.scores(hashes), pa.float64())], names=["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id bigint, score double")


def filtered(docs: DataFrame, model_of: Callable[[], object], keep: Callable[[Column], Column]) -> DataFrame:
    """The rows of docs, all columns as they were, whose score keep() accepts; the score travels with its row, so that no join is needed."""
    at = docs.columns.index("text")
    (name,) = fresh(docs, "score")
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of()
        use(_hashes)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                some = batch.slice(a, 256)
                scores = model.scores([word_hashes(t or "") for t in some.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(scores, pa.float64())], names=schema.names)

    return map_whole_rows(docs, run, schema).where(keep(F.col(name))).drop(name)


def held_out_column(modulus: int, remainder: int):  # noqa: ANN201
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss on validation rows; 1 where they hold one class only."""
    if len(y) < 8 or y.min() == y.max():
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.mean(np.logaddexp(0, logits / t) - y * logits / t) for t in grid]
    return float(grid[int(np.argmin(loss))])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))
