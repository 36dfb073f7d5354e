import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from fixtures_llm import docs_of, extras_kept
from pyspark.sql import functions as F

from graphloom.llm import ann, fingerprints, near_dedup, pii


def test_ann_recall_scores_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 3_000)] + 0.3 * rng.normal(size=(3_000, 16))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)  # so that a vector's copies are its nearest
    x[1_000:2_000] = x[1_000]  # a third of all rows is one vector
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    rows += [(5_000, None, "c"), (5_001, [0.0] * 16, "c"), (5_020, [float("nan")] * 16, "c"), (5_040, [None] * 16, "c"), (5_060, [1.0, 2.0], "c"), (None, [1.0] * 16, "c")]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, entry string")
    got = defaultdict(list)
    for r in ann.search(table, table.where(F.col("vec_id") % 20 == 0)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert set(got) == set(range(0, 3_000, 20))
    x = x.astype(np.float64)
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(s)), -np.round(s, 9)))[:20]
        hits += len({i for i, _ in found} & set(best.tolist()))
        assert len(found) == 20 and all(abs(score - x[i] @ x[q]) < 1e-9 for i, score in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert hits / (20 * len(got)) >= 0.95
    assert got[1_000][0][0] == 1_001 and [i for i, _ in got[1_500]] == list(range(1_000, 1_020))


def test_ann_recall_holds_with_many_lists(spark, tmp_path):
    n, dim = 30_000, 128
    x = np.random.default_rng(12).normal(size=(n, dim)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.ListArray.from_arrays(np.arange(0, n * dim + 1, dim, dtype=np.int32), x.ravel())}), tmp_path / "v.parquet")
    table = spark.read.parquet(str(tmp_path / "v.parquet"))
    got = defaultdict(set)
    for r in ann.search(table, table.where(F.col("vec_id") % 300 == 0)).collect():
        got[r.query_id].add(r.vec_id)
    found = 0
    for i in range(0, n, 300):
        score = x.astype(np.float64) @ x[i]
        score[i] = -np.inf
        found += len(got[i] & set(np.argsort(-score)[:20].tolist()))
    assert len(got) == 100 and found / 2_000 >= 0.99, found / 2_000


def test_ann_of_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 2.0])], "vec_id bigint, embedding array<float>")
    got = ann.search(few, few.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, 1, 0.5), (0, 20, 0.0), (20, 1, 1.0), (20, 0, 0.0)]
    assert ann.search(few.limit(0), few.limit(0)).count() == 0


PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(d := re.sub(r"\D", "", s)) <= 19 and pii._luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub(r"\D", "", s)) <= 15),
]


def plain_spans(text):
    return [f"{kind}:{m.start()}:{m.end()}" for kind, p, fine in PLAIN for m in re.finditer(p, text) if fine(m.group())]


PII_TEXTS = [
    "a@b.co_x@c.org. 1.2.3.4.5.6.7.8 999.1.1.1 é 4111 1111 1111 1111, +1 (988) 555-2485",
    "a..b@c@d.ee @x.y.z %@a.b-c.d. 01.002.0003.255 4111-1111-1111-1112 4111111111111111000 12345678901234567",
    "+12 3456 7 +1 +123456789012345678 ++4912345678. 1.1.1.1.1 256.1.1.1.1 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1",
    "x" * 3_000 + "@" + "y" * 3_000 + " " + "9" * 4_000 + "." * 50 + "1.2.3.4",
]


def test_base_spans_equal_plain_regular_expressions():
    for t in PII_TEXTS:
        assert [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in pii.base_spans(t)] == plain_spans(t)


def test_pii_finds_new_identifiers_in_learned_contexts(spark, odd_rows):
    rows = odd_rows + [(1_000 + i, f"filler words here. please phone +1 (555) 555-{1000 + i} today") for i in range(30)] + [(2_000 + i, f"some text {t}") for i, t in enumerate(PII_TEXTS)]
    rows += [(3_000, "filler words here. please phone 555-555-9876 today"), (3_001, "the part number 123-456-7890 is clean"), (3_002, "filler words here. please phone 555 555 9876 today")]
    keys = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(24)]
    rows += [(4_000 + i, f'some text key = "{k}" more') for i, k in enumerate(keys[:20])] + [(4_100, f'SOME TEXT KEY = "{keys[20].upper()}"###'), (4_101, f"digest {keys[21]} here"), (4_102, keys[22].upper())]
    docs = docs_of(spark, rows)
    got = defaultdict(list)
    for r in pii.spans(docs).collect():
        got[r.doc_id].append([(pii.NAMES[s.kind], s.start, s.end, s.base) for s in r.spans])
    assert Counter(len(v) for k, v in got.items() if k == 8) == {2: 1} and len(got[None]) == 2
    for i, t in rows:
        assert [f"{k}:{s}:{e}" for k, s, e, base in got[i][0] if base] == plain_spans(t or "") or i is None
    assert ("phone", 32, 44, False) in got[3_000][0]
    assert got[3_001] == [[]] and ("phone", 32, 44, False) in got[3_002][0]
    assert all(got[4_000 + i] == [[("secret", 17, 57, False)]] for i in range(20)) and got[4_100] == [[("secret", 17, 57, False)]]
    assert got[4_101] == got[4_102] == [[]]
    clean = {r.doc_id: r for r in pii.redact(docs.where("doc_id >= 8 or doc_id is null")).collect()}
    assert clean[3_000].text == "filler words here. please phone [PHONE] today" and clean[3_000].n_chars == len(clean[3_000].text)
    assert clean[8].text == "mail [EMAIL] now" and clean[3_001].text == "the part number 123-456-7890 is clean"
    assert extras_kept(pii.redact(docs))
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs).count() == len(rows)
    assert pii.spans(docs.limit(0)).count() == 0


def test_pattern_confidence_equals_a_plain_loop(spark):
    rng = random.Random(2)
    rows = [(i, 0, 0, rng.choice([0, 3]) if rng.random() < 0.6 else -1, f"i{rng.randrange(25)}", rng.sample([f"p{k}" for k in range(9)], 3)) for i in range(160)]
    found = spark.createDataFrame([(i, i, 0, k, 0, 1, k >= 0, x, ps) for i, _, _, k, x, ps in rows], pii.FOUND)
    got = {(r.kind, r.pattern): r.confidence for r in pii.patterns(found, rounds=3, min_seeds=2).collect()}
    seeds, extracted = defaultdict(set), defaultdict(set)
    for _, _, _, k, x, ps in rows:
        for p in ps:
            extracted[p].add(x)
            if k >= 0:
                seeds[k, p].add(x)
    induced = {kp for kp, xs in seeds.items() if len(xs) >= 2}
    seed = {(k, p, x): float(x in seeds[k, p]) for k, p in induced for x in extracted[p]}
    belief = dict(seed)
    for _ in range(3):
        score = {(k, p): sum(belief[k, p, x] for x in extracted[p]) / (len(extracted[p]) + 0.5) for k, p in induced}
        best = defaultdict(float)
        for k, p, x in seed:
            best[k, x] = max(best[k, x], score[k, p])
        belief = {(k, p, x): max(s, best[k, x] if best[k, x] >= pii.BELIEVED else 0.0) for (k, p, x), s in seed.items()}
    assert set(got) == induced and all(abs(got[kp] - score[kp]) < 1e-12 for kp in induced)


def paragraphs(text):
    return set(re.findall(fingerprints.PARAGRAPH, text))


def peeled(fingerprint):
    """The digests that a fingerprint alone gives back, by plain Python."""
    if not fingerprint:
        return set()
    head, _, tail = fingerprint.partition("|")
    width, cells = int(head, 16), {}
    for entry in tail.split(","):
        place, *sums = (int(x, 16) for x in entry.split(":"))
        cells[place] = sums
    check = lambda d: (d % 2147483647 + 1) * 48271 % 2147483647
    places = lambda d: [(d >> 20 * s) % width + s * width for s in range(3)]
    out, todo = set(), list(cells)
    while todo:
        count, digest, sum_ = cells[todo.pop()]
        if count == 1 and check(digest) == sum_ and digest not in out:
            out.add(digest)
            for p in places(digest):
                c, d, k = cells[p]
                cells[p] = [c - 1, d ^ digest, k ^ check(digest)]
                todo.append(p)
    assert not any(any(c) for c in cells.values())
    return out


def test_fingerprints_recover_the_exact_difference(spark, odd_rows, some_rows):
    rows = [r for r in odd_rows if r[0] not in (8, None)] + some_rows[:60]
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs_of(spark, rows)).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        third = len(text) // 3
        new = text[: len(text) - third] + after[:third]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        for near, other in ((r.near_edited, new), (r.near_next, after)):
            a, b = paragraphs(text), paragraphs(other)
            want = 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0
            assert abs(near - want) < 1e-12
        for near, other in ((r.near_edited, r.edited_fingerprint), (r.near_next, got[order[(k + 1) % len(order)][0]].fingerprint)):
            a, b = peeled(r.fingerprint), peeled(other)
            assert near == (2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0)
        assert (r.fingerprint == r.edited_fingerprint) == (paragraphs(text) == paragraphs(new))
    assert got[10].fingerprint == got[11].fingerprint != ""


def test_fingerprints_of_repeated_rows_one_row_and_none(spark):
    same = fingerprints.fingerprints(docs_of(spark, [(5, "abc def"), (5, "abc def"), (None, "x")])).collect()
    assert len(same) == 3
    (one,) = fingerprints.fingerprints(docs_of(spark, [(5, "abc def")])).collect()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abc dab").hexdigest()
    assert fingerprints.fingerprints(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("crowd", [near_dedup.CROWD, 0])
def test_near_duplicates_equal_brute_force(spark, odd_rows, some_rows, words, crowd, monkeypatch):
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    rng = random.Random(8)
    rows = list(odd_rows) + some_rows[:40]
    base = [rng.choice(words) for _ in range(300)]
    for k in range(60):  # a large group of near copies of one text, some farther from one another than near copies are
        copy = list(base)
        for _ in range(2 if k < 40 else 8):
            copy[rng.randrange(300)] = rng.choice(words)
        rows.append((1_000 + k, " ".join(copy)))
    for k, (_, t) in enumerate(some_rows[40:60]):
        rows += [(2_000 + 2 * k, t), (2_001 + 2 * k, t.replace(" ", "  ", 3) + " " + rng.choice(words))]
    docs = docs_of(spark, rows)
    got = {(r.doc_id): r.class_id for r in near_dedup.classes(docs).collect()}
    cells, n = near_dedup.document_frequencies(docs)
    weight = near_dedup.weights(cells, n)
    nodes = {}
    for i, t in rows:
        if i is not None:
            nodes.setdefault(i, t or "")
    parent = {i: i for i in nodes}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    f = {i: near_dedup.features(t) for i, t in nodes.items()}
    ids = sorted(nodes)
    for a in ids:
        for b in ids:
            if a < b and (nodes[a] == nodes[b] or (len(f[a]) and len(f[b]) and near_dedup.similarity(f[a], f[b], weight) >= 0.8)):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    assert {i: c for i, c in got.items() if i is not None} == {i: find(i) for i in ids}
    assert len({got[1_000 + k] for k in range(40)}) == 1
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and extras_kept(kept)
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(find(i) for i in ids))
    assert kept.where("doc_id is null").count() == 2
    assert near_dedup.classes(docs.limit(0)).count() == 0


def test_near_duplicates_linked_to_different_centres_are_compared(spark):
    rng = random.Random(8)
    rows = []
    for k in range(1_500):  # windows of one text, 10 of 100 shingles apart: only neighbours are similar, and the ends have the smallest ids
        line = [f"w{rng.randrange(50_000)}" for _ in range(134)]
        rows += [(4 * k + place, " ".join(line[at * 10 : at * 10 + 104])) for place, at in ((1, 0), (2, 3), (3, 1), (4, 2))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    weight = near_dedup.weights(*near_dedup.document_frequencies(docs))
    keys = near_dedup.Sampler(weight).bands([near_dedup.shingles(t) for _, t in rows])
    f = [near_dedup.features(t) for _, t in rows]
    want = {i: i for i, _ in rows}
    for a in range(len(rows)):
        for b in range(a + 1, a - a % 4 + 4):
            if set(keys[a]) & set(keys[b]) and near_dedup.similarity(f[a], f[b], weight) >= near_dedup.SIMILARITY:
                old, new = want[rows[a][0]], want[rows[b][0]]
                want.update({rows[c][0]: min(old, new) for c in range(a - a % 4, a - a % 4 + 4) if want[rows[c][0]] in (old, new)})
    assert [i for i in want if got[i] != want[i]] == []


def test_texts_of_one_doc_id_are_each_compared(spark, words):
    rng = random.Random(9)
    a, b = (" ".join(rng.choice(words) for _ in range(200)) for _ in range(2))
    docs = spark.createDataFrame([(5, a), (5, b), (9, b + " tail"), (11, a + " tail"), (12, "else")], "doc_id bigint, text string")
    got = [(r.doc_id, r.class_id) for r in near_dedup.classes(docs).collect()]
    assert sorted(got) == [(5, 5), (5, 5), (9, 5), (11, 5), (12, 12)]
    assert sorted(r.doc_id for r in near_dedup.keep_one(docs).collect()) == [5, 12]
