"""Incremental synchronisation as Structured Streaming: landed rows are merged into a keyed state, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.functions.names import column, fresh
from graphloom.operators import state
from graphloom.operators.graph import materialize
from graphloom.sources import sinks


class MissingCursor(RuntimeError):
    """An incremental run without a full one before it."""


def cursor(manifest: dict, required: bool = True) -> str | None:
    """The last successful fetch. Catalogs that need a full run first raise without one; others start from nothing."""
    value = manifest.get("last_fetch")
    if value is None and required:
        raise MissingCursor("no earlier run: make a full one first")
    return value


def upsert_batch(path: str, schema: str, key: str, time: str, position: str):  # noqa: ANN201
    """A foreachBatch function: latest row of each key in the batch, merged into the state; older rows never overwrite newer ones.

    State versions lie side by side by batch number and the newest complete one counts, so that a batch which is run again after a
    failure writes the same version again.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = [n for n in complete(spark, path) if n < number]
        old = spark.read.schema(schema).parquet(f"{path}/v={done[-1]}") if done else spark.createDataFrame([], schema)
        new = state.latest_wins(batch, key, time, position).select(*old.columns)
        state.merge_latest(old, new, key, time).write.mode("overwrite").parquet(f"{path}/v={number}")
        for n in done[:-1]:
            sinks.remove(spark, f"{path}/v={n}")

    return run


def complete(spark: SparkSession, path: str) -> list[int]:
    """Ascending numbers of the complete state versions below path, of which there are a few: one listing."""
    if not sinks.exists(spark, path):
        return []
    p, fs = sinks._fs(spark, path)
    found = [int(s.getPath().getName()[2:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v=")]
    return sorted(n for n in found if sinks.exists(spark, f"{path}/v={n}/_SUCCESS"))


def current(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest complete state."""
    done = complete(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/v={done[-1]}") if done else spark.createDataFrame([], schema)


def synchronise(landed: DataFrame, path: str, checkpoint: str, schema: str, key: str, time: str, position: str) -> StreamingQuery:
    """Start the merge of a stream of landed rows; available input is processed and the query ends."""
    return landed.writeStream.foreachBatch(upsert_batch(path, schema, key, time, position)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(landed: DataFrame, key: str, time: str) -> DataFrame:
    """Streaming state of the earliest time of each key (complete output mode)."""
    return landed.groupBy(key).agg(F.min(time).alias("first_seen"))


def run_incremental(
    spark: SparkSession, incoming: DataFrame, path: str, key: str, time: state.Time, run_timestamp: str, schema: str, full: bool = False, dry_run: bool = False,
    needs_cursor: bool = True, position: str | None = None, content: str | None = None, seen: str | None = None, authoritative: bool = False,
) -> dict:
    """One synchronisation of a catalog: full replaces the state and drops a stale delta, incremental merges and writes the delta; the manifest's cursor moves unless it is a dry run.

    incoming may hold a key several times: its latest row counts (by time, then position, without one by the row's hash). A time that a
    row lacks is the run's. With `content`, versions are told apart by that hash instead of time and incoming rows always win; `seen`
    names a column that carries the time a key was first met. authoritative: incoming is a whole snapshot also in an incremental run, so
    that keys it lacks count as removed (they are kept). Returns the manifest with sorted ids added, modified and removed, and counts.
    """
    manifest = sinks.read_manifest(spark, f"{path}/manifest")
    if not full:
        cursor(manifest, needs_cursor)
    now = F.lit(run_timestamp).cast("timestamp")
    old = spark.read.schema(schema).parquet(f"{path}/latest") if sinks.recover(spark, f"{path}/latest") else spark.createDataFrame([], schema)
    (place,) = fresh(incoming, "place")
    order = column(position) if position else F.xxhash64(*map(column, incoming.columns))
    placed = incoming.withColumn(place, order)
    incoming = (state.last_wins(placed, key, place) if content else state.latest_wins(placed, key, time, place, now)).drop(place)
    if seen:
        incoming = state.carry_first_seen(incoming, old, key, seen, F.lit(run_timestamp))
    incoming = materialize(incoming.select(*map(column, old.columns)), "incoming")  # read for the delta, the diff and the state
    if content:
        new, changes = (incoming if full else state.overwrite_merge(old, incoming, key)), state.delta_by_hash(old, incoming, key, content)
        found = state.diff(old, incoming if authoritative else new, key, content, by_hash=True)
    else:
        new, changes = (incoming if full else state.merge_latest(old, incoming, key, time, now)), state.delta(old, incoming, key, time, now)
        found = state.diff(old, incoming if authoritative else new, key, time, now=now)
    ids = state.listed(found).first().asDict()
    files = {"delta": sinks.write_delta(changes, f"{path}/delta", full, dry_run), "latest": sinks.tracked_write(new, f"{path}/latest", dry_run)}
    manifest = {**manifest, "last_fetch": run_timestamp, "mode": "full" if full else "incremental", "ids": ids, "diff": {k: len(v) for k, v in ids.items()}, "files": files}
    sinks.write_manifest(spark, f"{path}/manifest", manifest, dry_run)
    return manifest
