"""Operator 3: byte-level BPE by ranked merges that Spark's higher-order functions fold over distinct words.

Documents are read in blocks of bounded size, in which each distinct pre-token has a number. The blocks' pre-tokens are dealt by their
hash to parts, so that each distinct one is folded once in its part: `aggregate` folds the merges over its bytes against a literal rank
map (a hash table in literal arrays). The ids go back to the blocks, which put their documents' ids together. The blocks' numbers are
written once, laid out by block, and stay there; the two shuffles carry pre-tokens and their ids, once a block and compressed.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import bucketed, expand, tasks, texts, thrift

#: Characters of text in a block; a longer document makes a block of its own.
BLOCK_CHARS = 16_000_000
#: Pre-tokens with more bytes are merged with a heap, since folding arrays takes time by the square of their length.
FOLD_BYTES = 2_048
#: Distinct pre-tokens that a part's task remembers; beyond that it forgets all and folds again what comes again.
KNOWN = 400_000
#: Larger than any rank: the two pieces do not merge.
NONE = 1 << 17
#: Primes: the slots of either half of the cuckoo table, and what an empty slot holds.
_SLOTS, _EMPTY = (129_971, 127_031), 1 << 62

#: A block's pre-tokens of one part (words), or its documents in numbers (numbers).
DEALT = "part int, block bigint, words binary, numbers binary"
MERGED = "block bigint, part int, fresh array<array<int>>, long_at array<int>, long_words array<binary>, refs binary, reset boolean"
RESOLVED = "block bigint, part int, data binary"


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file of a public tokenizer: a base64 piece and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def rank_table(path: str) -> tuple[str, ...]:
    """The rank map as text for four literals: a byte's piece before each byte and at a word's end, and both halves of a cuckoo table of pairs.

    Pieces are named by rank. A slot holds (left * 65536 + right) * 65536 + rank of the joined piece.
    """
    ranks = read_ranks(path)
    if max(ranks.values()) >= 65535:
        raise ValueError("ranks must be below 65535")
    slots = [[_EMPTY] * n for n in _SLOTS]
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            if piece[:i] not in ranks or piece[i:] not in ranks:
                continue
            entry, side = (ranks[piece[:i]] * 65536 + ranks[piece[i:]] << 16) | rank, 0
            for _ in range(500):
                at = (entry >> 16) % _SLOTS[side]
                entry, slots[side][at] = slots[side][at], entry
                if entry == _EMPTY:
                    break
                side = 1 - side
            else:
                raise ValueError("the rank table is too full")
    one = [ranks[bytes([b])] for b in range(256)]
    first = [(ranks.get(bytes([b, after]), NONE) << _RANK_BITS) + one[b] for b in range(256) for after in range(256)]
    last = [(NONE << _RANK_BITS) + r for r in one]
    return tuple(",".join(map(str, t)) for t in (first, last, *slots))


#: A piece on its way is one number: the rank of its merge with the next piece, then the place of its first byte, then its own rank.
_RANK_BITS, _PLACE_BITS = 40, 16


def fold_words(words: str, path: str) -> Column:
    """Column `words`, array<array<int>> of byte values, to array<array<int>> of ranks: in each word, the leftmost pair of the lowest rank merges until none does.

    The least number of a word's pieces names both the lowest rank and the leftmost place, so that a step is one minimum, one search
    and one splice with two looked-up ranks. A piece that merges with nothing stands at either end, so that a step has no cases.
    Written as SQL text, with `if` and one-element transforms as bindings: Spark interprets these lambdas, and every node of the
    expression costs time at every step.
    """
    none, low = NONE << _RANK_BITS, (1 << _RANK_BITS) - 1
    edge, place = f"array({none + 65535}L)", low - 65535
    begin = f"concat({edge}, transform(w, (b, i) -> if(i + 1 < size(w), t.first[b * 256 + w[i + 1]], t.last[b]) + shiftleft(cast(i as bigint), {_PLACE_BITS})), {edge})"
    # a slot of another pair, or an empty one, differs from the key in higher bits and so gives more than any rank
    probe = lambda half, slots: f"t.{half}[cast(k % {slots} as int)] ^ shiftleft(k, 16)"
    rank = f"least({probe('even', _SLOTS[0])}, {probe('odd', _SLOTS[1])}, {NONE}L)"
    made = f"shiftright(m, {_RANK_BITS})"
    pairs = f"array(shiftleft(a[q - 2] & 65535, 16) + {made}, shiftleft({made}, 16) + (a[q + 1] & 65535))"
    two = f"transform({pairs}, (k, i) -> shiftleft({rank}, {_RANK_BITS}) + if(i = 0, a[q - 2] & {low}L, (m & {place}L) + {made}))"
    splice = f"transform(array(cast(array_position(a, m) as int)), q -> concat(slice(a, 1, q - 2), {two}, slice(a, q + 2, {1 << 30})))[0]"
    step = f"transform(array(array_min(a)), m -> if(m >= {none}L, a, {splice}))[0]"
    fold = f"if(size(w) = 0, cast(array() as array<int>), aggregate(w, {begin}, (a, b) -> {step}, a -> transform(slice(a, 2, size(a) - 2), e -> cast(e & 65535 as int))))"
    tables = ", ".join(f"'{n}', cast(split('{text}', ',') as array<bigint>)" for n, text in zip(("first", "last", "even", "odd"), rank_table(path), strict=True))
    return F.expr(f"transform(array(named_struct({tables})), t -> transform({words}, w -> {fold}))[0]")


def merge_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges over one long word with a heap: lowest rank first, then leftmost."""
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    before, after = list(range(-1, len(word) - 1)), [*range(1, len(word)), -1]
    heap = [(rank, i, 2) for i in range(len(word) - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else -1
        if j < 0 or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i], parts[j], after[i] = parts[i] + parts[j], None, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (rank := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (rank, a, len(parts[a]) + len(parts[b])))
    return [ranks[p] for p in parts if p is not None]


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, each as its bytes by place in the number, compressed."""
    out = []
    for a in arrays:
        raw = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
        coded = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
        out += [np.array([len(raw), len(coded)], "<i8").tobytes(), coded]
    return b"".join(out)


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        size, coded = np.frombuffer(data, "<i8", 2, at).tolist()
        raw = pa.decompress(data[at + 16 : at + 16 + coded], size, codec="zstd", asbytes=True) if size else b""
        out.append(np.frombuffer(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.tobytes(), kind))
        at += 16 + coded
    return out


class _Block:
    """Documents as codes of distinct chunks, chunks as codes of distinct pre-tokens."""

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern).findall
        self.clear()

    def clear(self) -> None:
        self.doc_ids, self.ends, self.coded, self.n, self.chars = [], [], [], 0, 0
        self.chunk_code, self.word_code, self.word_ends, self.words = {}, {}, [], []

    def add(self, doc_id: int | None, text: str) -> None:
        # A single space between two characters that are not white space always opens a new pre-token, so that the chunks that
        # begin there are cut alone; a text with other runs of white space at a chunk's edge is one chunk.
        parts = text.split(" ") if text else []
        if any(not p or p[0].isspace() or p[-1].isspace() for p in parts):
            parts = [text]
        codes, known = [], self.chunk_code
        lead = ""
        for p in parts:
            code = known.get(chunk := lead + p)
            if code is None:
                code = known[chunk] = len(known)
                self.words += [self.word_code.setdefault(w, len(self.word_code)) for w in self.find(chunk)]
                self.word_ends.append(len(self.words))
            codes.append(code)
            lead = " "
        self.coded.append(np.array(codes, "<u4"))
        self.n += len(codes)
        self.doc_ids.append(doc_id)
        self.ends.append(self.n)
        self.chars += len(text)

    def rows(self, block: int, parts: int) -> Iterator[tuple]:
        """Rows of DEALT. Pre-tokens are numbered by part, so that a part's numbers need not travel."""
        raw = [w.encode() for w in self.word_code]
        part = np.fromiter(map(zlib.crc32, raw), np.int64, len(raw)) % parts
        order = np.argsort(part, kind="stable")
        number = np.empty(len(raw), "<u4")
        number[order] = np.arange(len(raw))
        used, begin = np.unique(part[order], return_index=True)
        doc_ids = np.array([-1 if i is None else i for i in self.doc_ids], "<i8")
        known = np.array([i is not None for i in self.doc_ids], np.uint8)
        u4 = lambda x: np.asarray(x, "<u4")
        numbers = _pack(doc_ids, known, u4(self.ends), np.concatenate([*self.coded, u4([])]), u4(self.word_ends), number[u4(self.words)])
        yield block % parts, block, None, numbers
        for p, own in zip(used.tolist(), np.split(order, begin[1:]), strict=True):
            words = [raw[i] for i in own.tolist()]
            yield p, block, _pack(u4([len(w) for w in words]), np.frombuffer(b"".join(words), np.uint8)), None


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def dealt(docs: DataFrame, pattern: str, parts: int, block_chars: int) -> DataFrame:
    """Blocks of neighbouring documents as rows of DEALT, which any task makes alike: a block is named by its partition and place there."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("numbers", pa.binary())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        thrift()
        block, number = _Block(pattern), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, col = batch.column(0).to_pylist(), batch.column(1)
            for i, doc_id in enumerate(ids):
                block.add(doc_id, col[i].as_py())
                if block.chars >= block_chars:
                    yield _batch(list(block.rows(number, parts)), schema)
                    block.clear()
                    number += 1
        if block.doc_ids:
            yield _batch(list(block.rows(number, parts)), schema)

    return docs.mapInArrow(gather, DEALT)


def merged(rows: DataFrame, remember: int = KNOWN) -> DataFrame:
    """(part, block, words): in each task, a block's pre-tokens as references to the task's distinct ones, and those not met before as bytes."""
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary(), pa.bool_())
    schema = pa.schema([(c.split(" ")[0], t) for c, t in zip(MERGED.split(", "), kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thrift()
        known: dict[bytes, int] = {}
        for batch in batches:
            for part, block, packed in zip(*batch.columns, strict=True):
                sizes, blob = _unpack(packed.as_py(), "<u4", "u1")
                ends, blob = np.cumsum(sizes).tolist(), blob.tobytes()
                reset = len(known) + len(ends) > remember
                if reset:
                    known.clear()
                fresh, refs, at = [], [], 0
                for end in ends:
                    word = blob[at:end]
                    at = end
                    ref = known.get(word)
                    if ref is None:
                        ref = known[word] = len(known)
                        fresh.append(word)
                    refs.append(ref)
                long_at = [i for i, w in enumerate(fresh) if len(w) > FOLD_BYTES]
                long_words = [fresh[i] for i in long_at]
                for i in long_at:
                    fresh[i] = b""
                flat = np.frombuffer(b"".join(fresh), np.uint8).astype(np.int32)
                offsets = np.zeros(len(fresh) + 1, np.int32)
                np.cumsum([len(w) for w in fresh], out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array([0, len(fresh)], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                rest = ([long_at], [long_words], [_pack(np.array(refs, "<u4"))], [reset])
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], kinds[0]), pa.array([part.as_py()], kinds[1]), lists, *map(pa.array, rest, kinds[3:])], schema=schema)

    return rows.mapInArrow(run, MERGED)


class _Table:
    """Runs of ids, appended to arrays that double."""

    def __init__(self) -> None:
        self.flat, self.ends, self.n, self.size = np.zeros(1024, "<u2"), np.zeros(1024, np.int64), 0, 0

    def append(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.size + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(sizes) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[self.size : self.size + len(flat)] = flat
        self.ends[self.n : self.n + len(sizes)] = self.size + np.cumsum(sizes)
        self.n, self.size = self.n + len(sizes), self.size + len(flat)


def resolved(folded: DataFrame, path: str) -> DataFrame:
    """Rows of MERGED with ids in place of fresh, in their order, to a block's ids of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thrift()
        held, ranks = _Table(), None
        for batch in batches:
            for block, part, long_at, long_words, refs, reset, ids in zip(*batch.columns, strict=True):
                if reset.as_py():
                    held = _Table()
                lists = ids.values
                sizes, flat = np.diff(np.asarray(lists.offsets)), np.asarray(lists.flatten())
                if long_at.as_py():
                    ranks = ranks or read_ranks(path)
                    own = np.split(flat, np.cumsum(sizes)[:-1])
                    for i, word in zip(long_at.as_py(), long_words.as_py(), strict=True):
                        own[i] = np.array(merge_heap(word, ranks), np.int32)
                    sizes, flat = np.array([len(x) for x in own]), np.concatenate(own)
                held.append(flat, sizes)
                (codes,) = _unpack(refs.as_py(), "<u4")
                found, ends = expand(held.ends[: held.n], held.flat, codes)
                out = [block.as_py()], [part.as_py()], [_pack(np.diff(ends, prepend=0).astype("<u4"), found)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["block", "part", "data"])

    return folded.select("block", "part", "long_at", "long_words", "refs", "reset", "ids").mapInArrow(run, RESOLVED)


def encode(docs: DataFrame, ranks_path: str, pattern: str, block_chars: int = BLOCK_CHARS, remember: int = KNOWN) -> DataFrame:
    """(doc_id, text) to (doc_id, ids array<int>, raw binary): as tiktoken's encode_ordinary; raw holds the ids as little-endian unsigned 32-bit integers.

    Empty and null texts give no ids; repeated rows give repeated rows.
    """
    parts = tasks(docs.sparkSession)
    blocks = bucketed(dealt(docs, pattern, parts, block_chars), "blocks", "block", parts)
    words = blocks.where("words is not null").select("part", "block", "words").repartitionById(parts, F.col("part"))
    folded = merged(words, remember).withColumn("ids", fold_words("fresh", ranks_path)).drop("fresh")
    # a block's ids are as bounded as its text
    back = resolved(folded, ranks_path).groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "data"))), lambda x: x["data"]).alias("ids"))
    joined = blocks.where("numbers is not null").select("block", "numbers").join(back, "block", "left").select("numbers", "ids")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thrift()
        for batch in batches:
            for numbers, ids in zip(*batch.columns, strict=True):
                doc_ids, known, chunk_ends, chunks, word_ends, words = _unpack(numbers.as_py(), "<i8", "u1", "<u4", "<u4", "<u4", "<u4")
                got = [_unpack(data.as_py(), "<u4", "<u2") for data in ids.values] if ids.is_valid else []
                id_ends = np.cumsum(np.concatenate([np.zeros(0, "<u4"), *(sizes for sizes, _ in got)]), dtype=np.int64)
                by_word, word_out = expand(id_ends, np.concatenate([np.zeros(0, "<u2"), *(part for _, part in got)]), words)
                id_ends = np.concatenate([[0], word_out])[word_ends]
                chunk_ends = np.concatenate([[0], chunk_ends]).astype(np.int64)
                for a in range(0, len(doc_ids), 500):
                    cut = chunk_ends[a : a + 501]
                    flat, ends = expand(id_ends, by_word, chunks[cut[0] : cut[-1]])
                    cut = np.concatenate([[0], ends])[cut - cut[0]].astype(np.int32)
                    raw = pa.BinaryArray.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(4 * cut), pa.py_buffer(flat.astype("<u4"))])
                    lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(flat.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[a : a + 500], mask=known[a : a + 500] == 0), lists, raw], names=["doc_id", "ids", "raw"])

    return joined.mapInArrow(deal, "doc_id bigint, ids array<int>, raw binary")


def decode(ids: Column, ranks_path: str) -> Column:
    """array<int> to binary: the pieces' bytes one after another, each cut from one literal that holds them all.

    Pieces are joined as strings, whose bytes Spark neither checks nor changes.
    """
    by_rank = {rank: piece for piece, rank in read_ranks(ranks_path).items()}
    pieces = [by_rank.get(i, b"") for i in range(max(by_rank) + 1)]
    places = np.concatenate([[1], 1 + np.cumsum([len(p) for p in pieces])])
    numbers = lambda x: F.split(F.lit(",".join(map(str, x))), ",").cast("array<int>")
    table = F.struct(numbers(places[:-1]).alias("at"), numbers(map(len, pieces)).alias("size"), F.unhex(F.lit(b"".join(pieces).hex())).alias("bytes"))
    piece = lambda t, i: F.substring(t["bytes"], F.get(t["at"], i), F.get(t["size"], i)).cast("string")
    return F.transform(F.array(table), lambda t: F.array_join(F.transform(ids, lambda i: piece(t, i)), "").cast("binary"))[0]


def digests(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Per document the number of ids, SHA-256 of the ids as little-endian unsigned 32-bit integers, and SHA-256 of the decoded bytes."""
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2("raw", 256).alias("ids_sha256"), F.sha2(decode(F.col("ids"), ranks_path), 256).alias("decoded_sha256"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every whole text of documents by the public rank file."""
    import public_tokenizers as public

    from graphloom.llm.common import table

    path = public.path("byte_bpe_50k.tiktoken")
    return digests(encode(texts(table(spark, sf_dir, "documents")), path, public.PATTERN), path)
