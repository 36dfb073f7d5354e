"""Operator 5: pack documents' ids into few sequences by bin completion.

Only lengths matter to packing, and there are at most `capacity` of them: the plan is made from the histogram of lengths, whose size
is bounded whatever the corpus. Pieces of one length are interchangeable, so the plan names, for each length, runs of ranks and the
sequences they go to; every piece finds its place by its rank among pieces of its length. Pieces as long as a sequence are one each.

Bin completion fills one sequence after another around the largest piece left: it enumerates the undominated fillings of the room beside
it, gives up a branch whose waste would need as many sequences as the best plan so far, and goes back to other fillings. The first such
plan is that of best fit, and it is returned if no branch beats it within the node budget. Three limits bound the time and may cost
sequences, never pieces: SEARCH_NODES nodes in all, FILLING_NODES steps for the fillings of one sequence, and domination of fillings of
more than SUBSETS pieces, which is tested by single pieces and pairs only.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from graphloom.llm.common import materialize, table, texts
from graphloom.llm.word_ids import encoder

CAPACITY, END_ID = 4_096, 1
#: Steps of the enumeration of one sequence's fillings, nodes of the whole search, and pieces up to which all subsets of a filling are tested.
FILLING_NODES, SEARCH_NODES, SUBSETS = 300, 6_000, 10
#: Distinct lengths up to which states are remembered and bounded by the piece-wise lower bound.
SMALL = 64
#: Steps of the search whose patterns are held at a time; only time depends on it.
HELD = 64
#: Pieces of one length are ranked in this many independent shares, so that a length with a third of all pieces is not one task.
SHARES = 32

PIECE = "doc_id bigint, row long, piece int, start bigint, length bigint, ids_crc32 bigint"
PLAN = T.StructType([T.StructField(n, T.LongType()) for n in ("plan_length", "first_rank", "last_rank", "base", "offset")])


# ---- the plan: a list of (pattern, times); a pattern is a descending tuple of lengths ----


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Incumbent: each piece, largest first, into the fullest open sequence that holds it."""
    open_by_room: dict[int, list[list]] = {}
    rooms: list[int] = []  # ascending rooms that have sequences
    done: list[list] = []

    def put(room: int, pattern: tuple[int, ...], times: int) -> None:
        if room == 0:
            done.append([pattern, times])
            return
        if room not in open_by_room:
            rooms.insert(bisect_right(rooms, room), room)
            open_by_room[room] = []
        open_by_room[room].append([pattern, times])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_right(rooms, length - 1)
            if i == len(rooms):
                fits = capacity // length
                if left >= fits:
                    put(capacity - fits * length, (length,) * fits, left // fits)
                if left % fits:
                    put(capacity - (left % fits) * length, (length,) * (left % fits), 1)
                break
            room = rooms[i]
            pattern, times = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room]
                rooms.pop(i)
            fits = min(room // length, left)
            used = min(times, left // fits)
            if times > used:
                put(room, pattern, times - used)
            put(room - fits * length, pattern + (length,) * fits, used)
            left -= used * fits
    for held in open_by_room.values():
        done += held
    return [(p, t) for p, t in done]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The most of: total length, and for some thresholds the pieces that can share no sequence plus the rest's overflow."""
    total = sum(n * c for n, c in counts.items())
    best = -(-total // capacity)
    lengths = sorted(counts)
    for k in {n for n in lengths if n <= capacity // 2}:
        large = sum(c for n, c in counts.items() if n > capacity - k)
        middle = [(n, c) for n, c in counts.items() if capacity / 2 < n <= capacity - k]
        small = sum(n * c for n, c in counts.items() if k <= n <= capacity / 2)
        room = sum(c * (capacity - n) for n, c in middle)
        best = max(best, large + sum(c for _, c in middle) + max(0, -(-(small - room) // capacity)))
    return best


def dominated(filling: tuple[int, ...], spare: int, others: list[int], spent: frozenset[int] | set[int] = frozenset()) -> bool:
    """Whether one of the other pieces (ascending lengths, without the spent ones) could stand for some of the filling's pieces: at least as long as these together, and no longer than they and the spare room.

    Then the filling with that piece is as good or better whatever follows. A piece of the same length as one of the filling's does not count.
    """
    sizes = range(1, len(filling) + 1) if len(filling) <= SUBSETS else (1, 2)
    for size in sizes:
        for some in {c for c in combinations(filling, size)}:
            s = sum(some)
            i = bisect_left(others, s if size > 1 else s + 1)
            while i < len(others) and others[i] in spent:
                i += 1
            if i < len(others) and others[i] <= s + spare:
                return True
    return False


def fillings(room: int, counts: dict[int, int], most_waste: int | None = None, steps: int = FILLING_NODES) -> list[tuple[int, ...]]:
    """Undominated fillings of a room with pieces of these counts, least waste first, larger pieces first; none wastes more than most_waste.

    Depth first over lengths in descending order, without a piece as often as it is left; only fillings to which no piece can be added.
    """
    lengths = sorted(n for n, c in counts.items() if c and n <= room)
    found: set[tuple[int, ...]] = set()
    if not lengths:
        return [()] if most_waste is None or room <= most_waste else []
    stack: list[tuple[int, int, tuple[int, ...]]] = [(len(lengths) - 1, room, ())]
    while stack and steps:
        steps -= 1
        i, left, chosen = stack.pop()
        i = min(i, bisect_right(lengths, left) - 1)
        while i >= 0 and chosen.count(lengths[i]) >= counts[lengths[i]]:
            i -= 1
        if i < 0:
            spent = {n for n in set(chosen) if counts[n] <= chosen.count(n)}
            least = next((n for n in lengths if n not in spent), None)
            full = (least is None or least > left) and (most_waste is None or left <= most_waste)
            if full and chosen not in found and not dominated(chosen, left, lengths, spent):
                found.add(chosen)
            continue
        stack.append((i - 1, left, chosen))
        stack.append((i, left - lengths[i], chosen + (lengths[i],)))
    return sorted(found, key=lambda f: (-sum(f), [-n for n in f]))


class _Node:
    """A sequence on the way of the search: the most waste its fillings may have, its patterns unless they are dropped, the number of the next try, and the one taken: pattern and times."""

    __slots__ = ("most", "patterns", "at", "pattern", "times")

    def __init__(self, most: int):
        self.most, self.patterns, self.at, self.pattern, self.times = most, None, 0, (), 0


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = SEARCH_NODES, steps: int = FILLING_NODES) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used, for all pieces of these counts.

    A filling is tried as often as its pieces last, which gets through a large histogram, and then once, which makes the search complete.
    The way down holds what each step took, not the pieces it left: one histogram is changed on the way down and put right on the way
    back. Patterns of steps more than HELD above the last are dropped, and found again if the search returns to them.
    """
    incumbent = best_fit_decreasing(counts, capacity)
    best, floor = sum(t for _, t in incumbent), lower_bound(counts, capacity)
    total = sum(n * c for n, c in counts.items())
    seen: dict[bytes, int] = {}
    left = {n: c for n, c in counts.items() if c}
    used = waste = 0

    def tries(node: _Node) -> tuple[tuple[int, ...], int] | None:
        """The node's next try, of the pieces that are left: a pattern as often as they last, then once if that is less."""
        if node.patterns is None:
            top = max(left)
            left[top] -= 1
            node.patterns = [(top, *f) for f in fillings(capacity - top, left, node.most, steps)]
            left[top] += 1
        while node.at < 2 * len(node.patterns):
            pattern = node.patterns[node.at // 2]
            times = min(left[n] // pattern.count(n) for n in set(pattern))
            node.at += 1
            if node.at % 2 == 0:
                return pattern, 1
            if times > 1:
                return pattern, times
        return None

    def take(pattern: tuple[int, ...], times: int) -> None:
        """Take these pieces away; with times below zero, put them back."""
        nonlocal used, waste
        used += times
        waste += times * (capacity - sum(pattern))
        for n in pattern:
            c = left.get(n, 0) - times
            if c:
                left[n] = c
            else:
                del left[n]

    stack = [_Node((best - 1) * capacity - total)] if left else []
    while stack and best > floor and nodes > 0:
        node = stack[-1]
        if node.times:
            take(node.pattern, -node.times)
            node.times = 0
        taken = tries(node)
        if taken is None:
            stack.pop()
            continue
        nodes -= 1
        take(*taken)
        node.pattern, node.times = taken
        if waste > (best - 1) * capacity - total:
            continue
        if not left:
            if used < best:
                best, incumbent = used, [(n.pattern, n.times) for n in reversed(stack)]
            continue
        if len(left) <= SMALL:
            state = array("q", (x for item in sorted(left.items()) for x in item)).tobytes()
            if seen.get(state, used + 1) <= used or used + lower_bound(left, capacity) >= best:
                continue
            seen[state] = used
        if len(stack) >= HELD:
            stack[-HELD].patterns = None
        stack.append(_Node((best - 1) * capacity - total - waste))
    return incumbent


def plan_rows(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, sequence of the first, offset): the piece of that length and rank r goes to sequence base + r - first."""
    given: dict[int, int] = {}
    rows, base = [], 0
    for pattern, times in plan:
        offset = 0
        for length in pattern:
            first = given.get(length, 0)
            given[length] = first + times
            rows.append((length, first, first + times - 1, base, offset))
            offset += length
        base += times
    return rows


# ---- the operator ----


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every document's ids and the end id, cut into pieces of at most capacity: (doc_id, row, piece, start, length, ids_crc32); row tells repeated doc_ids apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[tuple] = []
            for doc_id, row, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), encoder(tokenizer_path).encode(batch.column(1)), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                out += [(doc_id, row, k, s, min(capacity, len(ids) - s), zlib.crc32(ids[s : s + capacity])) for k, s in enumerate(range(0, len(ids), capacity))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[c.split(" ")[0] for c in PIECE.split(", ")])

    return docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, PIECE)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece (row, piece, length) its sequence_id and offset. cut must be a written table: it is read for the histogram and again for the ranks.

    The driver receives one count for each length. What is broadcast is bounded too: one number for each length and share. The plan
    becomes a row for each piece where it is joined, by length and rank, so that no length is a hot key.
    """
    spark = cut.sparkSession
    share = F.pmod(F.xxhash64("row", "piece"), F.lit(SHARES)).cast("int")
    # sequence numbers below zero, by row, for pieces that fill a sequence
    full = cut.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")})
    short = cut.where(F.col("length") < capacity)
    counts = {r["length"]: r["n"] for r in short.groupBy("length").agg(F.count("*").alias("n")).collect()}
    above = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    first = short.groupBy("length", share.alias("share")).agg(F.count("*").alias("n")).select("length", "share", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"))
    ranked = (
        short.withColumn("share", share)
        .withColumn("rank", F.row_number().over(Window.partitionBy("length", "share").orderBy("row", "piece")) - 1)
        .join(F.broadcast(first), ["length", "share"])
        .withColumn("rank", F.col("rank") + F.col("before"))
    )
    runs = spark.createDataFrame(plan_rows(bin_completion(counts, capacity)), PLAN).select(F.col("plan_length").alias("length"), "base", "offset", "first_rank", F.explode(F.sequence("first_rank", "last_rank")).alias("rank"))
    places = runs.select("length", "rank", (F.col("base") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset")
    return full.unionByName(ranked.drop("share", "before").join(places, ["length", "rank"]).select(*full.columns))


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece.

    A null or empty text is its end id alone; repeated rows are packed each; an empty table gives no rows.
    """
    cut = materialize(pieces(texts(docs), tokenizer_path, capacity, end_id), "pieces")
    return pack(cut, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents in sequences of at most 4096 ids."""
    import public_tokenizers as public

    return packed(table(spark, sf_dir, "documents"), public.path("word_bpe_49k.json"))
