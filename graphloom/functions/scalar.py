"""Scalar expressions over catalog records. All are native Catalyst expressions; null goes to null unless a docstring says otherwise."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

MILLIS, SECONDS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd'T'HH:mm:ss'Z'"


def parse_timestamp(text: Column) -> Column:
    """ISO 8601 with Z, an offset, or nothing (UTC); malformed text raises under ANSI mode. The session time zone must be UTC."""
    return F.to_timestamp(F.nullif(F.trim(text), F.lit("")))


def format_timestamp(ts: Column, pattern: str = MILLIS) -> Column:
    return F.date_format(ts, pattern)


def nvd_timestamp(text: Column) -> Column:
    """The vulnerability feed's two spellings, with and without a fraction, both UTC; anything else raises."""
    parsed = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    return F.when(text.isNotNull() & parsed.isNull(), F.raise_error(F.concat(F.lit("unreadable timestamp "), text)).cast("timestamp")).otherwise(parsed)


def request_timestamp(ts: Column) -> Column:
    """Seconds with a zero fraction, as request parameters want it."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'.000Z'")


def date_timestamp(day: Column) -> Column:
    """yyyy-MM-dd as midnight UTC with milliseconds."""
    return F.date_format(F.to_date(day).cast("timestamp"), MILLIS)


def modified_key(modified: Column, created: Column, run_timestamp: Column) -> Column:
    """The time that orders versions of a record: modified, else created, else the run's."""
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(blank(modified), blank(created), run_timestamp)


def date_windows(start: datetime, end: datetime, days: int = 120) -> list[tuple[datetime, datetime]]:
    """[start, end) cut into windows of at most so many days; none if start is not before end."""
    out = []
    while start < end:
        stop = min(start + timedelta(days=days), end)
        out.append((start, stop))
        start = stop
    return out


def windows_column(start: Column, end: Column, days: int = 120) -> Column:
    """The same as an array of (start, stop)."""
    step = F.expr(f"INTERVAL {days} DAYS")
    starts = F.when(start < end, F.sequence(start, end - F.expr("INTERVAL 1 MICROSECOND"), step)).otherwise(F.array().cast("array<timestamp>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + step, end).alias("stop")))


def slug(label: Column) -> Column:
    """Lower case; runs of other characters than a-z and 0-9 become one underscore; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def slug_sql(name: str) -> str:
    return f"regexp_replace(regexp_replace(lower(trim({name})), '[^a-z0-9]+', '_'), '^_+|_+$', '')"


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", "_"))


def snake_case_sql(name: str) -> str:
    return f"lower(regexp_replace({name}, '(?<=[a-z0-9])(?=[A-Z])', '_'))"


def strip_prefix(text: Column, prefix: str) -> Column:
    return F.when(F.startswith(text, F.lit(prefix)), F.substring(text, len(prefix) + 1, 1 << 30)).otherwise(text)


def split_note(text: Column) -> Column:
    """'impact (note)' as struct(impact, note): cut at the first ' (' if the text ends with ')'; otherwise note is null."""
    at = F.instr(text, " (")
    whole = F.rtrim(text)
    inside = (at > 0) & F.endswith(whole, F.lit(")"))
    return F.struct(F.when(inside, F.substring(text, F.lit(1), at - 1)).otherwise(text).alias("impact"), F.when(inside, F.substring(whole, at + 2, F.length(whole) - at - 2)).alias("note"))


def clean_channel(channel: Column) -> Column:
    """Blank and the literal word None are absent; other values stay as they are, blanks around them included."""
    return F.when(F.trim(channel).isin("", "None"), F.lit(None)).otherwise(channel)


def as_list(text: Column, element: str) -> Column:
    """JSON text of one element or of a list of them as an array; null as an empty array."""
    many = F.startswith(F.ltrim(text), F.lit("["))
    one = text if element == "string" else F.from_json(text, element)
    return F.when(text.isNull(), F.array().cast(f"array<{element}>")).when(many, F.from_json(text, f"array<{element}>")).otherwise(F.array(one))


def strings(text: Column) -> Column:
    """as_list of strings without null and empty ones."""
    return F.filter(as_list(text, "string"), lambda x: x.isNotNull() & (x != ""))


def literal_value(text: Column) -> Column:
    """The @value of a typed JSON-LD literal, or the value itself."""
    return F.coalesce(F.when(F.startswith(F.ltrim(text), F.lit("{")), F.get_json_object(text, "$['@value']")), text)


def ref_id(text: Column) -> Column:
    """The @id of a reference without its prefix; null for anything else."""
    return strip_prefix(F.when(F.startswith(F.ltrim(text), F.lit("{")), F.get_json_object(text, "$['@id']")), "d3f:")


def binding(cell: Column) -> Column:
    """The value of a query-result cell {type, value}, or the bare cell."""
    return F.when(F.startswith(F.ltrim(cell), F.lit("{")), F.get_json_object(cell, "$.value")).otherwise(cell)


def keep_first(items: Column) -> Column:
    """Distinct items in order of first occurrence, without nulls and empty strings."""
    return F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))


def none_if_empty(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)


def english(descriptions: Column) -> Column:
    """Value of the first description with lang en, else of the first of any; a match with a null value is null."""
    en = F.filter(descriptions, lambda d: d["lang"] == "en")
    return F.when(F.size(en) > 0, F.get(en, F.lit(0))["value"]).otherwise(F.get(descriptions, F.lit(0))["value"])


def weakness_labels(weaknesses: Column) -> Column:
    """Distinct description values of all weaknesses, in order of first occurrence."""
    return keep_first(F.flatten(F.transform(weaknesses, lambda w: F.transform(F.coalesce(w["description"], F.array()), lambda d: d["value"]))))


def cve_year(cve: Column) -> Column:
    """The year in a CVE id; other text raises."""
    fine = cve.rlike(r"^CVE-\d{4}-\d{4,}$")
    return F.when(fine, F.substring(cve, 5, 4).cast("int")).when(cve.isNull(), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("not a CVE id: "), cve)).cast("int"))


def number_after_dash(text: Column) -> Column:
    return F.try_element_at(F.split(text, "-", 2), F.lit(2)).cast("int")


def mapped(value: Column, table: dict[str, str], what: str = "") -> Column:
    """A value's entry in a literal table; with `what` given, a value without an entry raises, else it is null."""
    entry = F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value)
    if not what:
        return entry
    return F.coalesce(entry, F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(value, F.lit("null")))).cast("string"))


def attack_code(references: Column, sources: tuple[str, ...]) -> Column:
    """external_id of the first reference of these sources that has one."""
    return F.get(F.filter(references, lambda r: r["source_name"].isin(*sources) & r["external_id"].isNotNull() & (r["external_id"] != "")), F.lit(0))["external_id"]


def normalized_id(value: Column, prefix: str) -> Column:
    """Bare and prefixed catalog numbers in one spelling: 79 and CWE-79 both as CWE-79."""
    text = F.upper(F.trim(value.cast("string")))
    return F.when(text.rlike(r"^\d+$"), F.concat(F.lit(f"{prefix}-"), text)).otherwise(text)


def mentions(text: Column, pattern: str = r"CVE-[0-9]{4}-[0-9]+") -> Column:
    """Distinct identifiers that free text mentions, in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def version_key(version: Column) -> Column:
    """'18.10' as [18, 10]: arrays order numerically."""
    return F.transform(F.split(version, "\\."), lambda part: part.cast("int"))
