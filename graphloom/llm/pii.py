"""Operator 2: personal data by base rules, and by bootstrapped contextual patterns.

Base rules give the seed entities of four kinds; keys of digest length (32, 40 or 64 hexadecimal digits in lower case) are the seeds of a
fifth, secrets, which has no base spans. A candidate is a run of characters without white space that holds an @ or at least MIN_DIGITS
digits, without the marks around it, or up to MAX_GROUPS groups of digits with single spaces between them; shorter and longer ones than
MIN_CHARS and MAX_CHARS characters are none. Seeds and candidates have lexical patterns: the word before with the shape of the
instance, the two words before with its outline, and the words around it. Spark scores patterns by the share of seeds among the
instances they extract, instances by the patterns that extract them, and patterns again by their instances, for a fixed number of rounds
over the graph of (pattern, instance). Candidates that patterns of high confidence extract become spans, as do the seeds of secrets in
them; base spans stay.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import column, fresh, map_whole_rows, materialize, table, texts, use

#: Kinds of the base rules, and one that only the method has.
KINDS = ("email", "ip", "card", "phone")
SECRET, NAMES = len(KINDS), (*KINDS, "secret")
ROUNDS = 3
#: Bounds of a candidate.
MIN_DIGITS, MIN_CHARS, MAX_CHARS, MAX_GROUPS = 6, 6, 80, 8
#: Rows up to which a table of patterns is broadcast; larger ones are joined by shuffle.
BROADCAST = 200_000
#: A pattern counts once it has this many seed instances, and is believed from this confidence on.
MIN_SEEDS, BELIEVED = 5, 0.9

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_EDGE = "\"'`.,;:!?()[]{}<>|"
_DIGITS = re.compile(r"[0-9]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_KEY = re.compile(r"(?<![0-9A-Za-z])(?=[a-f]*[0-9])(?=[0-9]*[a-f])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![0-9A-Za-z])")
_GROUP = re.compile(r"[+(]?[0-9][0-9()./-]*")
_MIXED = re.compile(r"[^\W_]+")


#: This operator has no cache; its tasks empty those of others.
_none: dict = {}


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in code points, by kind, then start: leftmost matches that do not overlap within their kind; failing ones are dropped without a retry."""
    out = [(0, s, e) for s, e in _emails(text)]
    if not _DIGITS.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def shape(token: str) -> str:
    """Runs of digits as 9 and their number, runs of letters as a; long shapes are cut, so that a shape has bounded size."""
    return _LETTERS.sub("a", _DIGITS.sub(lambda m: f"9{len(m.group())}", token))[:64]


def outline(token: str) -> str:
    """Runs of letters and digits as a, 9 or, where they mix, x, whatever their length."""
    return _MIXED.sub(lambda m: "9" if m.group().isdigit() else "a" if m.group().isalpha() else "x", token)[:64]


def _word(token: str) -> str:
    """A context word: lower case without punctuation; words with digits stand for any such word."""
    word = token.strip(_EDGE).lower()
    return "#" if any(c.isdigit() or c == "@" for c in word) else word[:32]


def _bare(token: str) -> tuple[int, int]:
    """The token's part between its first and last letter or digit, with a + or ( before it."""
    a, b = 0, len(token)
    while a < b and not token[a].isalnum():
        a += 1
    while b > a and not token[b - 1].isalnum():
        b -= 1
    return (a - 1 if a and token[a - 1] in "+(" else a), b


def _runs(text: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Places of candidates: a token, or neighbouring groups of digits as one."""
    i = 0
    while i < len(tokens):
        s, e = tokens[i]
        j = i
        while j + 1 < len(tokens) and j - i + 1 < MAX_GROUPS and tokens[j + 1][0] == tokens[j][1] + 1 and text[tokens[j][1]] == " " and _GROUP.fullmatch(text, *tokens[j]) and _GROUP.match(text, *tokens[j + 1]):
            j += 1
        a, b = _bare(text[s : tokens[j][1]])
        yield s + a, s + b
        i = j + 1


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool, str, list[str]]]:
    """(kind or -1, start, end, seed, instance, patterns) of seeds and of other candidates."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)] if spans or _DIGITS.search(text) or "@" in text else []
    ends = [e for _, e in tokens]
    starts = [s for s, _ in tokens]

    def patterns_of(s: int, e: int) -> list[str]:
        first, after = bisect_left(ends, s + 1), bisect_right(starts, e - 1)
        word = lambda i, edge: _word(text[slice(*tokens[i])]) if 0 <= i < len(tokens) else edge
        # a token that begins before the instance, such as name="value", is itself the word before
        last = first if first < len(tokens) and tokens[first][0] < s and any(map(str.isalnum, text[tokens[first][0] : s])) else first - 1
        near = _word(text[tokens[last][0] : min(tokens[last][1], s)]) if last >= 0 else "^"
        token = text[s:e]
        return [f"s {near} {shape(token)}", f"g {word(last - 1, '^') if last >= 0 else '^'} {near} {outline(token)}", f"w {near} {word(after, '$')}"]

    out = [(kind, s, e, True, text[s:e], patterns_of(s, e)) for kind, s, e in spans]
    taken = sorted((s, e) for _, s, e in spans)

    def free(s: int, e: int) -> bool:
        """Whether no base span touches this place; spans of two kinds may overlap."""
        i = bisect_left(taken, (e, 0))
        return not any(t[1] > s for t in taken[max(0, i - 8) : i])

    keys = [m.span() for m in _KEY.finditer(text) if free(*m.span())] if tokens else []
    out += [(SECRET, s, e, True, text[s:e], patterns_of(s, e)) for s, e in keys]
    taken = sorted([*taken, *keys])
    for s, e in _runs(text, tokens):
        token = text[s:e]
        if MIN_CHARS <= e - s <= MAX_CHARS and ("@" in token or sum(c in "0123456789" for c in token) >= MIN_DIGITS) and free(s, e):
            out.append((-1, s, e, False, token, patterns_of(s, e)))
    return out


FOUND = "doc_id bigint, row bigint, digest bigint, kind int, start int, end int, seed boolean, instance string, patterns array<string>"


def find(docs: DataFrame) -> DataFrame:
    """Seeds and candidates of every whole text, a row each; and one row with kind -2 for each document, so that documents without any stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use(_none)
        schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("digest", pa.int64()), ("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                some = batch.slice(a, 500)
                out = []
                for doc_id, text, row, digest in zip(*(some.column(c).to_pylist() for c in range(4)), strict=True):
                    out.append((doc_id, row, digest, -2, 0, 0, False, None, None))
                    out += [(doc_id, row, digest, *c) for c in candidates(text, base_spans(text))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return docs.withColumns({"row": F.monotonically_increasing_id(), "digest": F.xxhash64("text")}).mapInArrow(run, FOUND)


def _bounded(df: DataFrame, name: str) -> DataFrame:
    """df written, and marked for broadcast if it has at most BROADCAST rows: frequent contexts are then no hot keys."""
    df = materialize(df, name, narrow=True)
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def patterns(found: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """Confidence of each (kind, pattern) from the pattern-instance graph of the whole corpus.

    Seeds induce patterns for their kind, if at least min_seeds distinct ones have it. A seed has belief 1 in its kind, any other instance
    starts at 0 and takes the confidence of its best pattern in each round, if that is believed. A pattern's confidence is the mean belief
    of its distinct instances, less a correction for few of them.
    """
    graph = found.where("kind > -2").select(F.explode("patterns").alias("pattern"), "instance", F.when(F.col("seed"), F.col("kind")).alias("seed_kind")).distinct()
    graph = materialize(graph, "pii-graph")
    induced = graph.where("seed_kind is not null").groupBy("seed_kind", "pattern").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= min_seeds).select(F.col("seed_kind").alias("kind"), "pattern")
    edges = graph.join(_bounded(induced, "pii-induced"), "pattern").groupBy("kind", "pattern", "instance").agg(F.max(F.coalesce((F.col("seed_kind") == F.col("kind")).cast("double"), F.lit(0.0))).alias("seed"))
    edges = materialize(edges, "pii-edges")
    belief = edges.select("kind", "pattern", "instance", F.col("seed").alias("belief"))
    for i in range(rounds):
        scored = belief.groupBy("kind", "pattern").agg((F.sum("belief") / (F.count("*") + 0.5)).alias("confidence"))
        if i + 1 < rounds:
            best = edges.join(_bounded(scored, "pii-scored"), ["kind", "pattern"]).groupBy("kind", "instance").agg(F.max("confidence").alias("by_pattern"))
            belief = edges.join(best, ["kind", "instance"]).select("kind", "pattern", "instance", F.greatest("seed", F.when(F.col("by_pattern") >= BELIEVED, F.col("by_pattern")).otherwise(0.0)).alias("belief"))
    return scored


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, row, digest, spans): spans an array of (kind, start, end, base) by kind, then start. Null and empty texts have no span; repeated rows are told apart by row."""
    found = materialize(find(texts(docs)), "pii")
    believed = _bounded(patterns(found).where(F.col("confidence") >= BELIEVED), "pii-believed")
    place = ["doc_id", "row", "digest", "start", "end"]
    # a seed of the method's own kind becomes a span where a pattern of that kind is believed
    open_ = found.where((F.col("kind") == -1) | (F.col("kind") == SECRET)).select(*place, F.col("kind").alias("own"), F.explode("patterns").alias("pattern"))
    new = open_.join(believed, "pattern").where((F.col("own") == -1) | (F.col("own") == F.col("kind"))).groupBy(*place).agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    every = found.where((F.col("kind") >= 0) & (F.col("kind") < SECRET) | (F.col("kind") == -2)).select(*place, "kind", F.lit(True).alias("base")).unionByName(new.select(*place, "kind", F.lit(False).alias("base")))
    one = F.struct("kind", "start", "end", "base")
    return every.groupBy("doc_id", "row", "digest").agg(F.array_sort(F.collect_list(F.when(F.col("kind") >= 0, one))).alias("spans"))


def _joined(found: Column) -> Column:
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: counts and digest of base spans, all spans, and how many of them the method added, of every whole text of documents."""
    found = spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("bigint")
    return found.select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("bigint").alias("n_added"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every found span of its text replaced by its kind in brackets, and n_chars following; other columns and rows without spans as they were.

    Spans go to their texts by (doc_id, hash of the text): rows that share both have the same spans.
    """
    of_doc, of_text, marks = fresh(docs, "of_doc", "of_text", "marks")
    found = spans(docs).where(F.size("spans") > 0).groupBy(F.coalesce("doc_id", F.lit(-1)).alias(of_doc), F.col("digest").alias(of_text)).agg(F.to_json(F.first("spans")).alias(marks))
    keyed = docs.withColumns({of_doc: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)), of_text: F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    joined = keyed.join(found, [of_doc, of_text], "left").select(*map(column, docs.columns), marks)
    names = docs.columns
    at, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use(_none)
        for batch in batches:
            cols = batch.columns[:-1]
            marks = batch.column(batch.num_columns - 1).to_pylist()
            if any(marks):
                new = [replaced(t, json.loads(m)) if m else t for t, m in zip(cols[at].to_pylist(), marks, strict=True)]
                if chars >= 0:
                    cols[chars] = pa.array([len(t) if m else n for t, m, n in zip(new, marks, cols[chars].to_pylist(), strict=True)], cols[chars].type)
                cols[at] = pa.array(new, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return map_whole_rows(joined, run, docs.schema)


def replaced(text: str, found: list[dict]) -> str:
    """Spans in order of their start; one that begins inside an earlier one extends it."""
    parts, done = [], 0
    for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= done:
            parts += [text[done : s["start"]], f"[{NAMES[s['kind']].upper()}]"]
        done = max(done, s["end"])
    return "".join(parts) + text[done:]
