"""Operator 6: document fingerprints as invertible Bloom lookup sketches of paragraph digests, with DataFrame functions only.

A paragraph is a line, or a part of a long line that ends at a sentence. Its digest is 60 bits of MD5. A sketch has three subtables;
a digest enters one cell of each, and a cell holds a count, the exclusive or of its digests, and that of their checks. Peeling takes
cells that hold one digest, removes it from its other cells, and so recovers the digests. A document's sketch is as wide as its number
of paragraphs asks, and wider again by WIDER where peeling leaves cells over, so that the fingerprint alone gives back its digests; its
width stands at the head of the string. Sketches of two versions are subtracted cell by cell at one width, for which the narrower is
made again from its digests; peeling recovers the differing digests, and where cells are left over, a wider pair of sketches is tried.
Likeness is therefore a function of the two fingerprints.

Cells are rows keyed by document; every step is a partial aggregation within the partition that holds the document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import materialize, range_bounds, range_bucket, table, tasks, texts

#: A part of a line: at least 80 characters where there are as many, then up to the end of the sentence or 120 more.
PARAGRAPH = r"[^\n]{1,80}[^.!?\n]{0,120}[.!?]*\n*|\n+"
#: Cells in each subtable: the power of two from LOAD times the digests on, LEAST at least and 2 ** 20, the bits of a digest for it, at most.
LOAD, LEAST, WIDEST = 2, 8, 1 << 20
#: Rounds of peeling, one subtable each in turn.
ROUNDS = 6
#: How much wider each try is than the one before, and tries after the first. Beyond them, which takes millions of paragraphs, digests are
#: compared as they are.
WIDER, RETRIES = 8, 3
_PRIME = 2147483647


def digests(text: Column) -> Column:
    """The distinct 60-bit digests of a text's paragraphs; none for an empty text."""
    parts = F.array_distinct(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)))
    return F.array_distinct(F.transform(parts, lambda p: F.conv(F.substring(F.md5(p.cast("binary")), 1, 15), 16, 10).cast("bigint")))


def check(digest: Column) -> Column:
    """A check that does not commute with exclusive or."""
    return (digest % _PRIME + 1) * 48271 % _PRIME


def width(n: Column, tries: int = 0) -> Column:
    """The width for so many digests, at the first or a later try."""
    bits = F.ceil(F.log2(F.greatest(n * LOAD, F.lit(LEAST)).cast("double")))
    return F.least(F.pow(F.lit(2.0), bits) * WIDER**tries, F.lit(float(WIDEST))).cast("bigint")


def cell(digest: Column, subtable: int, width: Column) -> Column:
    return F.shiftright(digest, 20 * subtable) % width + subtable * width


def with_next(docs: DataFrame) -> DataFrame:
    """Each row with the text and digests of the next one in descending doc_id order (after the last: the first).

    Ranges of doc_id keep the order's neighbours together without a global sort; the last row of a range takes the first row of the
    next range that has rows. Rows of one doc_id follow in descending order of text; null doc_ids come last.
    """
    bounds = range_bounds(docs, "doc_id", tasks(docs.sparkSession))
    rows = docs.select("doc_id", "text", digests(F.col("text")).alias("own"), range_bucket(F.col("doc_id"), bounds).alias("range"))
    order = Window.partitionBy("range").orderBy(F.desc_nulls_last("doc_id"), F.desc("text"))
    inside = rows.withColumn("next", F.lead(F.struct("text", "own")).over(order))
    first = docs.select("doc_id", "text", range_bucket(F.col("doc_id"), bounds).alias("range")).groupBy("range").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "text")).alias("head")).select("range", F.col("head.text").alias("text"))
    # as many rows as there are ranges
    everywhere = Window.orderBy(F.desc("range"))
    after = first.withColumn("other", F.coalesce(F.lead("text").over(everywhere), F.first("text").over(everywhere))).select("range", "other")
    return inside.join(after, "range").select("doc_id", "text", "own", F.coalesce("next", F.struct(F.col("other").alias("text"), digests(F.col("other")).alias("own"))).alias("next"))


def edited(text: Column, following: Column) -> Column:
    """The last third of text, rounded down, replaced by as many first characters of following, or all."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


def _entries(digest: Column, width: Column) -> Column:
    return F.explode(F.array(*(cell(digest, s, width) for s in range(3))))


def fingerprint(rows: DataFrame) -> DataFrame:
    """(row, own, edit, own_width, edit_width) to (row, fingerprint, edited_fingerprint): the width, then the sketch's cells in order as cell:count:digests:checks, in hexadecimal; empty cells are left out."""
    tagged = lambda of: F.transform(of, lambda d: F.struct(F.lit(of).alias("of"), d.alias("k"), F.col(f"{of}_width").alias("w")))
    one = rows.select("row", F.explode(F.concat(tagged("own"), tagged("edit"))).alias("e")).select("row", "e.of", "e.k", "e.w")
    cells = one.select("row", "of", "w", "k", check(F.col("k")).alias("c"), _entries(F.col("k"), F.col("w")).alias("cell"))
    sums = cells.groupBy("row", "of", "w", "cell").agg(F.count("*").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c"))
    listed = sums.groupBy("row", "of", "w").agg(F.array_sort(F.collect_list(F.struct("cell", F.concat_ws(":", F.hex("cell"), F.hex("n"), F.hex("k"), F.hex("c")).alias("text")))).alias("cells"))
    text = F.lower(F.concat_ws("|", F.hex("w"), F.array_join("cells.text", ",")))
    of = lambda tag: F.max(F.when(F.col("of") == tag, text))
    return listed.groupBy("row").agg(of("own").alias("fingerprint"), of("edit").alias("edited_fingerprint"))


def difference(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """rows of (row, pair, width, mine, theirs) to (row, pair, differing): the number of digests that peeling recovers, null where cells are left over."""
    both = F.concat(F.transform("mine", lambda d: F.struct(F.lit(1).alias("n"), d.alias("k"))), F.transform("theirs", lambda d: F.struct(F.lit(-1).alias("n"), d.alias("k"))))
    one = rows.select("row", "pair", "width", F.explode(both).alias("e")).select("row", "pair", "width", F.col("e.n").cast("bigint").alias("n"), "e.k")
    cells = one.select("row", "pair", "width", _entries(F.col("k"), F.col("width")).alias("cell"), "n", "k", check(F.col("k")).alias("c"))
    key = ["row", "pair", "width", "cell"]

    def subtracted(entries: DataFrame) -> DataFrame:
        return entries.groupBy(*key).agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c")).where("n <> 0 or k <> 0 or c <> 0")

    cells = subtracted(cells)
    for r in range(rounds):
        s = r % 3
        # a digest lies in one cell of this subtable, and so is taken once
        pure = (F.abs("n") == 1) & (F.col("cell") >= 0) & (F.col("c") == check(F.col("k"))) & (F.col("cell") == cell(F.col("k"), s, F.col("width")))
        entry = lambda at, n, k, c: F.struct(at.cast("bigint").alias("cell"), n.cast("bigint").alias("n"), k.alias("k"), c.alias("c"))
        zero = F.lit(0).cast("bigint")
        taken = F.array(entry(F.lit(-1), F.lit(1), zero, zero), *(entry(cell(F.col("k"), t, F.col("width")), -F.col("n"), F.col("k"), F.col("c")) for t in range(3) if t != s))
        same = F.array(entry(F.col("cell"), F.col("n"), F.col("k"), F.col("c")))
        cells = subtracted(cells.select("row", "pair", "width", F.explode(F.when(pure, taken).otherwise(same)).alias("e")).select("row", "pair", "width", "e.cell", "e.n", "e.k", "e.c"))
    return cells.groupBy("row", "pair").agg(F.when(F.max("cell") < 0, F.sum("n")).alias("differing"))


def _jobs(rows: DataFrame, tries: int, open_only: bool = False) -> DataFrame:
    """(row, pair, mine, theirs, width): a row's own and edited digests against nothing, and its own against the edited and the next ones; open_only: those that its column open names."""
    none = F.array().cast("array<bigint>")
    job = lambda pair, mine, theirs: F.struct(F.lit(pair).alias("pair"), mine.alias("mine"), theirs.alias("theirs"))
    own, edit, following = F.col("own"), F.col("edit"), F.col("following")
    jobs = F.array(job("own", own, none), job("edit", edit, none), job("edited", own, edit), job("next", own, following))
    if open_only:
        jobs = F.filter(jobs, lambda j: F.array_contains("open", j["pair"]))
    return rows.select("row", F.explode(jobs).alias("j")).select("row", "j.*").withColumn("width", width(F.size("mine") + F.size("theirs"), tries))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs.

    Likeness is 2 * shared / (paragraphs of both) over distinct paragraphs, as recovered from the sketches' difference; 1 where both
    texts are empty. An empty text's fingerprint is empty. Null text counts as empty; repeated rows each have a row; a single row is its
    own next one.
    """
    n = tasks(docs.sparkSession)
    pairs = with_next(texts(docs))
    base = pairs.select("doc_id", "text", "own", F.col("next.own").alias("following"), edited(F.col("text"), F.col("next.text")).alias("new"))
    base = base.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("new").cast("binary"), 256).alias("edited_sha256"), "own", digests(F.col("new")).alias("edit"), "following", F.monotonically_increasing_id().alias("row"))
    base = materialize(base, "paragraphs")
    dealt = base.select("row", "own", "edit", "following").repartition(n, "row")
    tried = [materialize(difference(_jobs(dealt, 0)).withColumn("tries", F.lit(0)), "difference")]
    for tries in range(1, RETRIES + 1):
        # few rows: a document that two digests of one cell in every subtable keep from peeling
        open_rows = tried[-1].where("differing is null").groupBy("row").agg(F.collect_set("pair").alias("open"))
        again = base.select("row", "own", "edit", "following").join(open_rows, "row").repartition(n, "row")
        tried.append(materialize(difference(_jobs(again, tries, open_only=True)).withColumn("tries", F.lit(tries)), "difference", narrow=True))
    # what no size has peeled is counted from the digests themselves
    open_rows = tried[-1].where("differing is null").groupBy("row").agg(F.collect_set("pair").alias("open"))
    left = _jobs(base.join(open_rows, "row"), RETRIES, open_only=True)
    exact = left.select("row", "pair", (F.size(F.array_except("mine", "theirs")) + F.size(F.array_except("theirs", "mine"))).cast("bigint").alias("differing"), F.lit(RETRIES).alias("tries"))
    of = lambda pair, c: F.max(F.when(F.col("pair") == pair, F.col(c)))
    peeled = reduce(DataFrame.unionByName, [t.where("differing is not null") for t in tried])
    told = peeled.unionByName(exact).groupBy("row").agg(of("edited", "differing").alias("d_edited"), of("next", "differing").alias("d_next"), of("own", "tries").alias("own_tries"), of("edit", "tries").alias("edit_tries"))
    wide = lambda of: width(F.size(of)) * F.pow(F.lit(float(WIDER)), F.coalesce(f"{of}_tries", F.lit(0)))
    sized = lambda of: F.least(wide(of), F.lit(float(WIDEST))).cast("bigint").alias(f"{of}_width")
    marks = fingerprint(dealt.join(told.select("row", "own_tries", "edit_tries"), "row", "left").select("row", "own", "edit", sized("own"), sized("edit")))
    counts = base.select("row", "doc_id", "n_chars", "edited_sha256", F.size("own").alias("a"), F.size("edit").alias("e"), F.size("following").alias("f"))
    likeness = lambda theirs, d: F.when(F.col("a") + F.col(theirs) == 0, F.lit(1.0)).otherwise((F.col("a") + F.col(theirs) - F.coalesce(F.col(d), F.lit(0))) / (F.col("a") + F.col(theirs)))
    return (
        counts.join(marks, "row", "left").join(told, "row", "left")
        .select("doc_id", "n_chars", "edited_sha256", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"), F.coalesce("edited_fingerprint", F.lit("")).alias("edited_fingerprint"), likeness("e", "d_edited").alias("near_edited"), likeness("f", "d_next").alias("near_next"))
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: fingerprints of every whole text of documents and of its edited text."""
    return fingerprints(table(spark, sf_dir, "documents"))
