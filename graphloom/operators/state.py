"""Snapshot algebra: keyed latest states, merges, deltas and diffs.

A snapshot has a key, a version time and a position; ties in time go to the later position. Time is one column, or several of which the
first that is neither null nor empty counts (modified, else created); text is read as a timestamp, so that fractions and offsets compare
by value, and text that is no timestamp raises. `now` stands for a time that no column has; without it such rows come first.
Every operator is one aggregation or one equi-join by key, so that Spark shuffles each snapshot once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.names import column, fresh

Time = str | Sequence[str]


def _present(key: str) -> Column:
    return column(key).isNotNull() & (column(key).cast("string") != "")


def version_time(df: DataFrame, time: Time, now: Column | None = None) -> Column:
    """The time that orders versions of df's rows. Of several columns those that df lacks are passed over."""
    names = [time] if isinstance(time, str) else [t for t in time if t in df.columns]
    read = [F.to_timestamp(F.nullif(F.trim(column(n)), F.lit(""))) if isinstance(df.schema[n].dataType, T.StringType) else column(n) for n in names]
    return F.coalesce(*(read or [F.lit(None).cast("timestamp")]), *([] if now is None else [now.cast("timestamp")]))


def _row(df: DataFrame) -> Column:
    return F.struct(*map(column, df.columns))


def latest_wins(df: DataFrame, key: str, time: Time, position: str, now: Column | None = None) -> DataFrame:
    """Of each key the row with the largest time, then the largest position. Rows without a key go; null times come first.

    max_by aggregates partially before the shuffle, so that a key with many versions is not gathered in one task.
    """
    at = version_time(df, time, now)
    best = df.where(_present(key)).groupBy(column(key).alias("key")).agg(F.max_by(_row(df), F.struct(at.isNotNull(), at, column(position))).alias("row"))
    return best.select("row.*")


def last_wins(df: DataFrame, key: str, position: str) -> DataFrame:
    """Of each key the row with the largest position."""
    return df.where(_present(key)).groupBy(column(key).alias("key")).agg(F.max_by(_row(df), column(position)).alias("row")).select("row.*")


def _both(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, str]:
    (side,) = fresh([existing, incoming], "side")
    return existing.withColumn(side, F.lit(0)).unionByName(incoming.withColumn(side, F.lit(1)), allowMissingColumns=True), side


def merge_latest(existing: DataFrame, incoming: DataFrame, key: str, time: Time, now: Column | None = None) -> DataFrame:
    """Upsert: an incoming row replaces the existing one unless that is strictly newer; keys in one table only are kept. Both tables are unique by key."""
    both, side = _both(existing, incoming)
    return latest_wins(both, key, time, side, now).drop(side)


def overwrite_merge(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Upsert in which the incoming row always wins."""
    both, side = _both(existing, incoming)
    return last_wins(both, key, side).drop(side)


def _with_old(existing: DataFrame, incoming: DataFrame, key: str, value: Column) -> tuple[DataFrame, str, str]:
    """incoming with the existing row's key and value beside it, null where there is none."""
    own, was = fresh([existing, incoming], "own", "was")
    old = existing.select(column(key).alias(own), value.alias(was))
    return incoming.join(old, column(key) == column(own), "left"), own, was


def delta(existing: DataFrame, incoming: DataFrame, key: str, time: Time, now: Column | None = None) -> DataFrame:
    """Incoming rows that are new or strictly newer."""
    both, own, was = _with_old(existing, incoming, key, version_time(existing, time, now))
    return both.where(column(own).isNull() | (version_time(incoming, time, now) > column(was))).select(*map(column, incoming.columns))


def delta_by_hash(existing: DataFrame, incoming: DataFrame, key: str, content: str) -> DataFrame:
    """Incoming rows that are new or whose content hash differs."""
    both, own, was = _with_old(existing, incoming, key, column(content))
    return both.where(column(own).isNull() | ~column(content).eqNullSafe(column(was))).select(*map(column, incoming.columns))


def diff(old: DataFrame, new: DataFrame, key: str, changed: Time, by_hash: bool = False, now: Column | None = None) -> DataFrame:
    """(id, status): added, modified (strictly newer, or another content hash) and removed keys of two snapshots."""
    value = lambda df: column(changed) if by_hash else version_time(df, changed, now)
    left = old.select(column(key).alias("old"), value(old).alias("was"))
    right = new.select(column(key).alias("new"), value(new).alias("is"))
    other = ~F.col("is").eqNullSafe(F.col("was")) if by_hash else F.col("is") > F.col("was")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(other, "modified")
    return left.join(right, F.col("old") == F.col("new"), "full_outer").select(F.coalesce("new", "old").alias("id"), status.alias("status")).where("status is not null")


def listed(changes: DataFrame) -> DataFrame:
    """One row (added, modified, removed): a diff's ids in ascending order, for a run's summary. Its size is that of the change."""
    of = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("id")))).alias(s)
    return changes.agg(*map(of, ("added", "modified", "removed")))


def split_delta(changes: DataFrame, existing: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """A delta's added rows (no such key before) and modified rows."""
    known = existing.select(column(key))
    return changes.join(known, key, "left_anti"), changes.join(known, key, "left_semi")


def carry_first_seen(incoming: DataFrame, existing: DataFrame, key: str, seen: str, now: Column) -> DataFrame:
    """incoming with the time its key was first seen: the earlier state's, else now."""
    rest = [c for c in incoming.columns if c != seen]
    both, _, was = _with_old(existing, incoming, key, column(seen))
    return both.select(*map(column, rest), F.coalesce(column(was), now).alias(seen))


def same_state(a: DataFrame, b: DataFrame) -> bool:
    """Whether two snapshots are equal as bags of rows; two passes without a join."""
    from graphloom.functions.identity import table_fingerprint

    return sorted(a.columns) == sorted(b.columns) and table_fingerprint(a).first() == table_fingerprint(b).first()


def counts_by_type(df: DataFrame, kind: str = "type") -> DataFrame:
    return df.groupBy(F.coalesce(F.nullif(column(kind).cast("string"), F.lit("")), F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))


def shard_totals(df: DataFrame, shard: Column, **counters: Column) -> DataFrame:
    """Rows and counters (a condition counts the rows that meet it, a number is summed) by shard, and over all shards in a row whose shard is null."""
    total = lambda c: F.sum(F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint")))
    return df.select(shard.alias("shard"), *[c.alias(n) for n, c in counters.items()]).where("shard is not null").rollup("shard").agg(F.count("*").alias("rows"), *[total(F.col(n)).alias(n) for n in counters])


def history_dates(df: DataFrame, key: str, day: str, kind: str, submission: str = "Submission") -> DataFrame:
    """(key, created, modified) from rows of a history: the first submission, else the first row of any kind; the last row of any kind."""
    submitted = F.min(F.when(column(kind) == submission, column(day)))
    return df.where(column(day).isNotNull()).groupBy(column(key).alias(key)).agg(F.coalesce(submitted, F.min(column(day))).alias("created"), F.max(column(day)).alias("modified"))


def first_stated(df: DataFrame, value: str, position: str, key: str | None = None) -> DataFrame:
    """The value of the first row, by position, that states one: one row, or one for each key."""
    found = F.min_by(column(value), F.when(column(value).isNotNull(), column(position))).alias(value)
    return df.groupBy(column(key).alias(key)).agg(found) if key else df.agg(found)


def newest(df: DataFrame, time: Time, now: Column | None = None) -> DataFrame:
    """One row with the largest time, null for an empty table."""
    return df.agg(F.max(version_time(df, time, now)).alias("newest"))


def domain_merge(df: DataFrame, key: str, time: str, position: str, domains: str) -> DataFrame:
    """Copies of one object in several bundles: the newest copy, later bundle on ties; with copies, the sorted union of their domains."""
    order = F.struct(F.coalesce(version_time(df, time).cast("timestamp"), F.lit("1970-01-01").cast("timestamp")), column(position))
    merged = df.where(_present(key)).groupBy(column(key).alias("key")).agg(F.max_by(_row(df), order).alias("row"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(column(domains), F.array().cast("array<string>")))))).alias("domains"), F.count("*").alias("n"))
    merged = merged.withColumn("domains", F.when((F.col("n") > 1) & (F.size("domains") > 0), F.col("domains")).otherwise(F.col("row")[domains]))
    return merged.select(*[F.col("domains").alias(c) if c == domains else F.col("row")[c].alias(c) for c in df.columns])
