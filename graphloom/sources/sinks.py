"""Writers: tables, tracked writes, manifests, deltas, history, the collection index, and summaries."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.identity import table_fingerprint
from graphloom.functions.names import column, fresh
from graphloom.functions.scalar import format_timestamp
from graphloom.operators.state import version_time


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def _rename(spark: SparkSession, path: str, to: str) -> None:
    (old, fs), (new, _) = _fs(spark, path), _fs(spark, to)
    if not fs.rename(old, new):
        raise OSError(f"cannot rename {path}")


def recover(spark: SparkSession, path: str) -> bool:
    """Whether there is a table at path; one that a lost driver left between two renames is put back first."""
    if not exists(spark, path) and exists(spark, f"{path}.old"):
        _rename(spark, f"{path}.old", path)
    return exists(spark, path)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a path, such as a stale delta; whether there was one."""
    p, fs = _fs(spark, path)
    return fs.delete(p, True)


def write_tables(tables: Mapping[str, DataFrame], root: str, format: str = "parquet", dry_run: bool = False, partition_by: Mapping[str, str] | None = None) -> dict[str, int]:  # noqa: A002
    """Write each table to root/name by Spark's commit protocol and return the row counts. JSON leaves out null fields. A dry run only counts."""
    counts = {}
    for name, df in tables.items():
        if dry_run:
            counts[name] = df.count()
            continue
        writer = df.write.mode("overwrite").format(format)
        if partition_by and name in partition_by:
            writer = writer.partitionBy(partition_by[name])
        writer.save(f"{root}/{name}")
        counts[name] = df.sparkSession.read.format(format).schema(df.schema).load(f"{root}/{name}").count()
    return counts


def tracked_write(df: DataFrame, path: str, dry_run: bool = False) -> str:
    """Write only if the content differs, whatever the row order: created, modified or unchanged.

    The new table is written beside the old one, which is set aside and goes last: at any moment one of the two is whole, and `recover`
    finds it.
    """
    spark = df.sparkSession
    if not recover(spark, path):
        status = "created"
    else:
        old = spark.read.parquet(path)
        same = sorted(old.columns) == sorted(df.columns) and table_fingerprint(old).first() == table_fingerprint(df).first()
        status = "unchanged" if same else "modified"
    if status != "unchanged" and not dry_run:
        staged, aside = f"{path}.new", f"{path}.old"
        df.write.mode("overwrite").parquet(staged)  # df may read the old path
        remove(spark, aside)
        if status == "modified":
            _rename(spark, path, aside)
        _rename(spark, staged, path)
        remove(spark, aside)
    return status


def in_order(df: DataFrame, order: list[Column], shares: int = 32, place: str = "place") -> DataFrame:
    """df with each row's place, from 1, in the order of these keys over the whole table.

    Ranges of the order are cut at keys of a sample, ranked each on its own, and numbered on from the ranges before, so that no task sees
    the whole table. The sample, some 20 keys a range, settles the balance only.
    """
    key, bucket, before = fresh(df, "sort_key", "sort_range", "sort_before")
    keyed = df.withColumn(key, F.struct(*[k.alias(f"k{i}") for i, k in enumerate(order)]))
    every = max(1, df.count() // (20 * shares))
    sample = keyed.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).select(key).distinct().limit(40 * shares).orderBy(key).select(f"{key}.*")
    kinds, keys = [f.dataType for f in sample.schema], sample.collect()
    cuts = [keys[i * len(keys) // shares] for i in range(1, shares)] if keys else []
    literal = [F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(c, kinds, strict=True))]) for c in cuts]
    ranged = keyed.withColumn(bucket, F.size(F.filter(F.array(*literal), lambda c: c <= F.col(key))) if literal else F.lit(0))
    totals = ranged.groupBy(bucket).agg(F.count("*").alias("n"))
    offsets = totals.select(bucket, (F.sum("n").over(Window.orderBy(bucket)) - F.col("n")).alias(before))  # a row for each range
    ranked = ranged.withColumn(place, F.row_number().over(Window.partitionBy(bucket).orderBy(key)))
    return ranked.join(F.broadcast(offsets), bucket).select(*map(column, df.columns), (F.col(place) + F.col(before)).cast("bigint").alias(place))


def bundle_order(source: str) -> list[Column]:
    """Sort keys of a catalog's bundle."""
    if source == "cve":
        return [F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("id"))]
    if source == "cwe":
        return [F.col("type"), F.col("cwe_id").cast("int")]
    if source == "defend":
        return [F.coalesce(F.col("`@id`"), F.col("_content_hash"))]
    return [F.col("type"), F.col("name"), F.col("id")]


def write_delta(df: DataFrame, path: str, full: bool, dry_run: bool = False) -> str:
    """An incremental run overwrites the delta; a full one removes a stale delta."""
    if full:
        return "removed" if not dry_run and remove(df.sparkSession, path) else "none"
    return tracked_write(df, path, dry_run)


def read_manifest(spark: SparkSession, path: str, default: Mapping | None = None) -> dict:
    """A manifest as a dict, or the default (a null cursor) where there is none."""
    if not exists(spark, path):
        return dict(default or {"last_fetch": None, "counts": {}})
    return json.loads(spark.read.option("wholetext", True).text(path).first().value)


def write_manifest(spark: SparkSession, path: str, manifest: Mapping, dry_run: bool = False) -> None:
    """One JSON document; a dry run keeps the old one, and with it the old cursor."""
    if not dry_run:
        spark.createDataFrame([(json.dumps(dict(manifest), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def overlay(manifest: Mapping, update: Mapping[str, object], key: str = "domains") -> dict:
    """A manifest with this run's domains replaced and others kept."""
    return {**manifest, key: {**manifest.get(key, {}), **update}}


def archive(df: DataFrame, root: str, version: str) -> None:
    """Add or replace one version of a history partitioned by version."""
    df.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(root)


def collection_index(collections: DataFrame) -> DataFrame:
    """From (id, name, description, created, modified, version, url), a row for each collection: name and description of the version changed last, first creation, last change, versions from the one changed last, of those changed at once the higher number first."""
    number = F.transform(F.split("version", "\\."), lambda p: p.cast("int"))
    entry = F.struct(version_time(collections, "modified").alias("at"), number.alias("order"), F.col("version"), F.col("url"), F.col("modified"), F.col("name"), F.col("description"))
    grouped = collections.groupBy("id").agg(F.min("created").alias("created"), F.max("modified").alias("modified"), F.sort_array(F.collect_list(entry), asc=False).alias("all"))
    return grouped.select("id", F.col("all")[0]["name"].alias("name"), F.col("all")[0]["description"].alias("description"), "created", "modified", F.transform("all", lambda v: F.struct(v["version"].alias("version"), v["url"].alias("url"), v["modified"].alias("modified"))).alias("versions"))


def index_dates(collections: DataFrame) -> DataFrame:
    """One row (created, modified): the earliest creation and the latest change of any collection, as timestamps with milliseconds and Z."""
    return collections.agg(F.min(version_time(collections, "created")).alias("c"), F.max(version_time(collections, "modified")).alias("m")).select(format_timestamp(F.col("c")).alias("created"), format_timestamp(F.col("m")).alias("modified"))


def index_markdown(index: DataFrame) -> str:
    """The index as a Markdown table; the index is a handful of rows."""
    rows = [(r["name"], r["description"] or "", ", ".join(f"[{v['version']}]({v['url']})" for v in r["versions"])) for r in index.orderBy("name").collect()]
    return "\n".join(["| Collection | Description | Versions |", "| --- | --- | --- |", *[f"| {' | '.join(r)} |" for r in rows]]) + "\n"


def summary_line(source: str, mode: str, diff: Mapping[str, int], files: Mapping[str, str]) -> str:
    """[source] mode: +added ~modified -removed | files: name=status, .."""
    return f"[{source}] {mode}: +{diff.get('added', 0)} ~{diff.get('modified', 0)} -{diff.get('removed', 0)} | files: " + (", ".join(f"{n}={s}" for n, s in sorted(files.items())) or "none")
