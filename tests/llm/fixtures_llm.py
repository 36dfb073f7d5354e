NAMES = ["score", "ids", "row", "range", "v", "node", "digest", "class", "place", "of_doc", "of_text", "marks", "_score", "_n", "_class", "_pii_id", "_pii_digest", "_pii_spans", "a.b", "doc", "key", "words", "y"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n.replace('`', '``')}` int" for n in NAMES)


def docs_of(spark, rows):
    """Documents with extra columns, among them names that the operators use inside and names that need quoting."""
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, *range(len(NAMES))) for i, t in rows], SCHEMA)


def extras_kept(df):
    """Whether every row still has docs_of's values in the extra columns."""
    return all(tuple(r)[5:] == tuple(range(len(NAMES))) for r in df.collect())
