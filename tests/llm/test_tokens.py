import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from fixtures_llm import docs_of
from tokenizers import Tokenizer

from graphloom.llm import byte_bpe, id_files, packing, token_counts, word_ids

RANKS = public.path("byte_bpe_50k.tiktoken")
WORDS = public.path("word_bpe_49k.json")


def library_ids(texts):
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("remember", [byte_bpe.KNOWN, 60])
def test_byte_bpe_equals_library_and_round_trips(spark, odd_rows, some_rows, remember):
    rows = odd_rows + some_rows[:40]
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.digests(byte_bpe.encode(byte_bpe.texts(docs_of(spark, rows)), RANKS, public.PATTERN, block_chars=20_000, remember=remember), RANKS).collect())
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_byte_bpe_of_an_empty_table(spark):
    assert byte_bpe.digests(byte_bpe.encode(byte_bpe.texts(docs_of(spark, [])), RANKS, public.PATTERN), RANKS).count() == 0


def test_heap_merges_as_the_library():
    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    for text in ("the theories of thethethe", "aaaaaaaaaaab" * 9, "\x00é中" * 5):
        assert byte_bpe.merge_heap(text.encode(), byte_bpe.read_ranks(RANKS)) == library.encode_ordinary(text)


def test_chunked_ids_equal_the_library(odd_rows, some_rows):
    texts = [t or "" for _, t in odd_rows + some_rows]
    assert [x.tolist() for x in word_ids.Encoder(WORDS).encode(texts)] == library_ids(texts)


def test_pieces_and_places(spark, odd_rows, some_rows):
    rows = odd_rows + some_rows
    got = packing.packed(docs_of(spark, rows), WORDS, capacity=256).collect()
    want = defaultdict(int)
    for (i, _), ids in zip(rows, library_ids([t or "" for _, t in rows]), strict=True):
        ids = [*ids, 1]
        for k, s in enumerate(range(0, len(ids), 256)):
            want[i, k, s, len(ids[s : s + 256]), zlib.crc32(np.array(ids[s : s + 256], "<u4").tobytes())] += 1
    have = defaultdict(int)
    for r in got:
        have[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    assert have == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 256
    assert len(by) <= -(-sum(r.length for r in got) // 256) * 1.02 + 1
    assert packing.packed(docs_of(spark, []), WORDS).count() == 0


@pytest.mark.parametrize("lengths", [[7, 5, 5, 4, 3, 3, 3], [6, 6, 6, 4, 4, 4, 3, 3, 2], [10], [5, 5, 5], [9, 8, 2, 1, 1, 1], []])
def test_bin_completion_is_optimal_on_small_cases(lengths):
    from collections import Counter

    def fewest(left, capacity=10):
        best = len(left)

        def place(i, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if i == len(left):
                best = len(rooms)
                return
            for k in {r: k for k, r in enumerate(rooms) if r >= left[i]}.values():
                place(i + 1, rooms[:k] + [rooms[k] - left[i]] + rooms[k + 1 :])
            place(i + 1, rooms + [capacity - left[i]])

        place(0, [])
        return best

    plan = packing.bin_completion(Counter(lengths), 10)
    assert sum(t for _, t in plan) == fewest(sorted(lengths, reverse=True))
    assert sorted(n for p, t in plan for n in p * t) == sorted(lengths)


def test_fillings_respect_counts_and_are_undominated():
    assert packing.fillings(10, {2: 1, 5: 1}) == [(5, 2)]
    rng = random.Random(3)
    for _ in range(300):
        counts = Counter(rng.randint(2, 30) for _ in range(rng.randint(1, 9)))
        room = rng.randint(5, 50)
        got = packing.fillings(room, counts, steps=100_000)
        pieces = sorted(counts.elements(), reverse=True)
        feasible = {c for k in range(len(pieces) + 1) for c in itertools.combinations(pieces, k) if sum(c) <= room}
        assert got and set(got) <= feasible and len(set(got)) == len(got)
        assert sum(got[0]) == max(map(sum, feasible))
        # whatever a maximal filling can do, one of those returned can: its pieces fit into the other's, each in one or several to one
        for f in feasible:
            assert any(stands_for(list(g), list(f)) for g in got), (room, counts, f, got)


def stands_for(larger, smaller):
    """Whether the smaller pieces can be dealt to the larger ones so that none is exceeded, up to room that both leave."""
    if not smaller:
        return True
    for i, room in enumerate(larger):
        if smaller[0] <= room and stands_for(larger[:i] + [room - smaller[0]] + larger[i + 1 :], smaller[1:]):
            return True
    return False


def test_bin_completion_beats_best_fit_and_is_optimal():
    rng = random.Random(5)
    better = 0
    for _ in range(200):
        lengths = [rng.randint(8, 40) for _ in range(rng.randint(6, 14))]
        plan = packing.bin_completion(Counter(lengths), 60)
        assert sorted(n for p, t in plan for n in p * t) == sorted(lengths) and all(sum(p) <= 60 for p, _ in plan)
        best = sum(t for _, t in plan)
        assert best == least_bins(sorted(lengths, reverse=True), 60)
        better += best < sum(t for _, t in packing.best_fit_decreasing(Counter(lengths), 60))
    assert better >= 3
    # the state on which an earlier search made no progress
    plan = packing.bin_completion({24: 1, 16: 1, 28: 1, 12: 3, 17: 1, 34: 1, 21: 1}, 60, nodes=400)
    assert sum(t for _, t in plan) == least_bins([34, 28, 24, 21, 17, 16, 12, 12, 12], 60)


def test_a_long_search_holds_one_histogram():
    import tracemalloc

    # best fit needs one more sequence than the bound, so that the search goes on to its end
    rng = random.Random(0)
    counts = dict(Counter(min(4_095, int(rng.lognormvariate(6.9, 0.9))) for _ in range(60_000)))
    counts = {n: c for n, c in counts.items() if n > 900}
    assert sum(t for _, t in packing.best_fit_decreasing(counts, 4_096)) > packing.lower_bound(counts, 4_096)
    tracemalloc.start()
    plan = packing.bin_completion(counts, 4_096, nodes=1_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    placed = Counter()
    for pattern, times in plan:
        for n in pattern:
            placed[n] += times
    assert placed == counts and all(sum(p) <= 4_096 for p, _ in plan)
    assert peak < 20_000_000


def least_bins(lengths, capacity):
    """By dynamic programming over subsets: the fewest bins, and the least fill of the last one."""
    n = len(lengths)
    best = [(n + 1, 0)] * (1 << n)
    best[0] = (1, 0)
    for mask in range(1 << n):
        bins, fill = best[mask]
        for i in range(n):
            if not mask >> i & 1:
                to = (bins, fill + lengths[i]) if fill + lengths[i] <= capacity else (bins + 1, lengths[i])
                best[mask | 1 << i] = min(best[mask | 1 << i], to)
    return best[-1][0]


def test_id_blocks_round_trip_and_show_damage():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 49_408, 5_001), np.full(2_049, 7), np.tile([5, 9, 300], 1_500), np.array([65_535]), np.zeros(0, np.int64)):
        assert (id_files.decode_blocks(id_files.encode_blocks(ids)) == ids).all()
    blocks = id_files.encode_blocks(rng.integers(0, 99, 3_000))
    assert len(blocks) == 2 and (id_files.decode_blocks(blocks[1:]).size == 3_000 - id_files.BLOCK)
    for bad in (blocks[0][:-1], blocks[0][:30] + bytes([blocks[0][30] ^ 1]) + blocks[0][31:], b"", b"XXXX" + blocks[0][4:]):
        with pytest.raises(id_files.CorruptBlock):
            id_files.decode_blocks([bad])
    assert sum(map(len, id_files.encode_blocks(np.tile(rng.integers(0, 49_408, 50), 400)))) < 20_000


def test_id_files(spark, odd_rows, some_rows, tmp_path):
    rows = odd_rows + some_rows
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = id_files.op9_id_files(spark, str(tmp_path)).orderBy("start").collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, (i, _), ids in zip(got, ordered, library_ids([t or "" for _, t in ordered]), strict=True):
        raw = np.array([*ids, 2], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(raw) // 4, zlib.crc32(raw))
        start += len(raw) // 4


def test_token_counts_equal_plain_dynamic_programming(spark, odd_rows, some_rows):
    model = token_counts.Unigram(public.path("piece_bpe_32k.model"))

    def plain(word):
        best = [(0.0, 0)]
        for j in range(1, len(word) + 1):
            n = len(word[j - 1].encode())
            options = [(best[j - 1][0] + n * model.byte, -best[j - 1][1] - n)]
            options += [(best[i][0] + model.score[word[i:j]], -best[i][1] - 1) for i in range(max(0, j - model.longest), j) if word[i:j] in model.score]
            top = max(options)
            best.append((top[0], -top[1]))
        return best[-1][1]

    rows = [r for r in odd_rows if r[0] not in (6, 7)] + some_rows[:20]
    got = sorted((r.doc_id or -1, r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(docs_of(spark, rows), public.path("piece_bpe_32k.model")).collect())
    want = []
    for i, t in rows:
        found = token_counts._PRETOKEN.findall(t or "")
        want.append((i or -1, len(found), sum(plain(w.replace(" ", "▁")) for w in found)))
    assert got == sorted(want)


def test_chunked_ids_of_odd_characters():
    import random

    rng = random.Random(0)
    letters = "aBÉé1²٣ſµΣς'’“.,!?;:|$%&*#\"()-—\u0301 \n\tsStT中İıßǅ<|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(3_000)]
    assert [x.tolist() for x in word_ids.Encoder(WORDS).encode(texts)] == library_ids(texts)


def test_only_the_expected_tokenizer_is_taken(tmp_path):
    other = tmp_path / "other.json"
    other.write_text(open(WORDS, encoding="utf-8").read().replace('"Lowercase"', '"NFD"'))
    with pytest.raises(ValueError, match="cut"):
        word_ids._Tokenizer(str(other))


def test_a_long_word_takes_bounded_memory():
    trie = token_counts.Trie(token_counts.Unigram(public.path("piece_bpe_32k.model")))
    rng = random.Random(2)
    word = "".join(rng.choice("abcdetin") for _ in range(3_000))
    best, count = [0.0], [0]
    for i in range(len(word)):  # the same without a trie, over all prefixes
        top, pieces = best[i] + trie.model.byte, count[i] + 1
        for j in range(max(0, i + 1 - trie.model.longest), i + 1):
            s = trie.model.score.get(word[j : i + 1])
            if s is not None and (best[j] + s, -count[j] - 1) > (top, -pieces):
                top, pieces = best[j] + s, count[j] + 1
        best.append(top)
        count.append(pieces)
    assert trie.counts([word]) == count[-1] and trie.counts([word[:200]]) == count[200]
    assert len(trie.best) <= token_counts.LONG + 1
    trie.counts([word * 20])
    assert len(trie.best) <= token_counts.LONG + 1 and word not in trie.known
