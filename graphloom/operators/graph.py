"""Edges, nodes, reference joins, identifier resolution, audits and reachability over entity and edge tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import identity
from graphloom.functions.names import column, fresh

EDGE = ["id", "type", "relationship_type", "source_ref", "target_ref"]


def edges(df: DataFrame, namespace: str, source: Column, kind: Column | str, target: Column, attributes: Mapping[str, Column] | None = None, in_seed: bool = True, lists: Sequence[str] = ()) -> DataFrame:
    """One edge for each row of df. Rows are kept as they are: two with one identity stay two (callers that want one drop duplicates).

    in_seed: whether attributes belong to the identity; lists: attributes that are arrays.
    """
    kind = F.lit(kind) if isinstance(kind, str) else kind
    attributes = attributes or {}
    seeds = {n: identity.seed_text(c, n in lists) for n, c in attributes.items()} if in_seed else {}
    base = df.select(source.alias("source_ref"), kind.alias("relationship_type"), target.alias("target_ref"), *[c.alias(n) for n, c in attributes.items()])
    own = {n: identity.seed_text(F.col(n), n in lists) for n in seeds}
    return base.select(identity.edge_id(namespace, F.col("source_ref"), F.col("relationship_type"), F.col("target_ref"), own).alias("id"), F.lit("relationship").alias("type"), "relationship_type", "source_ref", "target_ref", *attributes)


def union_edges(*tables: DataFrame) -> DataFrame:
    """All edges; attributes that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def shared_nodes(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Nodes created on first use: rows with one id have equal fields by construction of the id, so that any of them serves."""
    return df.dropDuplicates([id_col])


def _looked_up(df: DataFrame, ref: str, ids: DataFrame, key: str, value: str, how: str) -> tuple[DataFrame, str]:
    """df joined with the value of its reference, and that column's name, which df has not."""
    own, found = fresh(df, "key", "value")
    return df.join(ids.select(column(key).alias(own), column(value).alias(found)), column(ref) == column(own), how).drop(own), found


def _replaced(df: DataFrame, columns: list[str], name: str, value: Column) -> DataFrame:
    """These columns of df with `name` set to value, at its place or at the end."""
    return df.select(*[value.alias(c) if c == name else column(c) for c in columns], *([] if name in columns else [value.alias(name)]))


def strict_lookup(df: DataFrame, ref: str, ids: DataFrame, key: str, value: str, out: str, what: str) -> DataFrame:
    """df with the value of its reference; a reference that resolves to nothing raises when it is read. Null references stay null."""
    joined, found = _looked_up(df, ref, ids, key, value, "left")
    missing = F.raise_error(F.concat(F.lit(f"{what} does not resolve: "), column(ref).cast("string"))).cast(ids.schema[value].dataType)
    return _replaced(joined, df.columns, out, F.when(column(ref).isNotNull() & column(found).isNull(), missing).otherwise(column(found)))


def lenient_remap(df: DataFrame, ref: str, ids: DataFrame, key: str, value: str) -> DataFrame:
    """References replaced where they are known, unchanged elsewhere."""
    joined, found = _looked_up(df, ref, ids, key, value, "left")
    return _replaced(joined, df.columns, ref, F.coalesce(column(found), column(ref)))


def both_endpoints(df: DataFrame, ids: DataFrame, key: str, value: str, source: str = "source_ref", target: str = "target_ref") -> DataFrame:
    """Edges of which both ends resolve, with the resolved ends."""
    columns = df.columns
    for ref in (source, target):
        joined, found = _looked_up(df, ref, ids.where(column(value).isNotNull()), key, value, "inner")
        df = _replaced(joined, columns, ref, column(found))
    return df


def composite_lookup(df: DataFrame, refs: Sequence[str], ids: DataFrame, keys: Sequence[str], value: str, out: str, what: str) -> DataFrame:
    """strict_lookup by several columns at once; a row with a null among them stays null."""
    names = fresh(df, *[f"key{i}" for i in range(len(keys))], "value")
    right = ids.select(*[column(k).alias(n) for k, n in zip([*keys, value], names, strict=True)])
    same = reduce(lambda a, b: a & b, [column(r) == column(n) for r, n in zip(refs, names, strict=False)])
    known = reduce(lambda a, b: a & b, [column(r).isNotNull() for r in refs])
    missing = F.raise_error(F.concat(F.lit(f"{what} does not resolve: "), F.concat_ws("/", *[column(r).cast("string") for r in refs]))).cast(ids.schema[value].dataType)
    return _replaced(df.join(right, same, "left"), df.columns, out, F.when(known & column(names[-1]).isNull(), missing).otherwise(column(names[-1])))


def facts(df: DataFrame, *columns: str, ordered: bool = False) -> DataFrame:
    """Each combination of these columns once, without those that lack one; ordered: in ascending order, in which a catalog's edges are emitted."""
    found = df.select(*map(column, columns)).dropna().distinct()
    return found.orderBy(*map(column, columns)) if ordered else found


def peer_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row for each unordered pair, smaller first."""
    return df.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).distinct()


def resolve_ids(claims: DataFrame, preferred: str = "attack-pattern", against: str = "course-of-action") -> DataFrame:
    """(stix_id, final_id) for claims of (stix_id, type, code, active, pos).

    One claim on a code wins. Claims of exactly the preferred and the other type go to the first preferred one. Else the only active
    claim wins; without one, or with several, none does. An object without a code keeps its own id. Losers have final_id null.
    """
    coded = claims.where("code is not null")
    groups = coded.groupBy("code").agg(
        F.count("*").alias("n"),
        F.array_sort(F.collect_set("type")).alias("types"),
        F.min_by("stix_id", F.when(F.col("type") == preferred, F.col("pos"))).alias("first_preferred"),
        F.sum(F.col("active").cast("int")).alias("n_active"),
        F.max(F.when(F.col("active"), F.col("stix_id"))).alias("one_active"),
    )
    pair = F.array(F.lit(min(preferred, against)), F.lit(max(preferred, against)))
    winners = groups.select("code", "n", F.when(F.col("types") == pair, F.col("first_preferred")).when(F.col("n_active") == 1, F.col("one_active")).alias("winner"))
    named = coded.join(winners, "code").select("stix_id", F.when((F.col("n") == 1) | (F.col("winner") == F.col("stix_id")), F.col("code")).alias("final_id"))
    return named.unionByName(claims.where("code is null").select("stix_id", F.col("stix_id").alias("final_id")))


def orphans(edge_table: DataFrame, nodes: DataFrame, node_key: str = "id") -> DataFrame:
    """(endpoint, relationship_type, missing refs, edges): references without a node, by end and kind."""
    ends = edge_table.select("relationship_type", F.explode(F.array(F.struct(F.lit("source").alias("endpoint"), F.col("source_ref").alias("ref")), F.struct(F.lit("target").alias("endpoint"), F.col("target_ref").alias("ref")))).alias("e")).select("relationship_type", "e.endpoint", "e.ref")
    return ends.join(nodes.select(F.col(node_key).alias("ref")), "ref", "left_anti").groupBy("endpoint", "relationship_type").agg(F.count_distinct("ref").alias("missing"), F.count("*").alias("edges"))


def histogram(edge_table: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source type, relationship type, target type, n); the type of an end without a node is null.

    Edges are counted by their ends' types one end at a time: after the first join only (source type, kind, target) with its number
    of edges goes on, so that a hub is one row by source type in the second.
    """
    kinds = nodes.select(F.col("id").alias("ref"), F.col("type").alias("kind"))
    near = edge_table.select("source_ref", "relationship_type", "target_ref").join(kinds.select(F.col("ref").alias("source_ref"), F.col("kind").alias("source_type")), "source_ref", "left")
    near = near.groupBy("source_type", "relationship_type", "target_ref").agg(F.count("*").alias("n"))
    far = near.join(kinds.select(F.col("ref").alias("target_ref"), F.col("kind").alias("target_type")), "target_ref", "left")
    return far.groupBy("source_type", "relationship_type", "target_type").agg(F.sum("n").alias("n"))


def verbs(edge_table: DataFrame) -> DataFrame:
    """Edges and distinct ends by relationship type."""
    return edge_table.groupBy("relationship_type").agg(F.count("*").alias("n"), F.count_distinct("source_ref").alias("sources"), F.count_distinct("target_ref").alias("targets"))


def prevalence(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """(field, present, rows, share): how many rows have each field, in one pass."""
    fields = list(fields or df.columns)
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{f}`")).alias(f"_{i}") for i, f in enumerate(fields)])
    one = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{i}").alias("present"), F.col("_rows").alias("rows")) for i, f in enumerate(fields)])).alias("f")
    return counted.select(one).select("f.*").withColumn("share", F.when(F.col("rows") > 0, F.col("present") / F.col("rows")))


def shared_folder(spark: SparkSession) -> str:
    """Where checkpoints go: spark.checkpoint.dir; where that is unset, a folder of our own in a local session, and an error on a cluster."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="graphloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def _remove(spark: SparkSession, path: str, table: str | None = None) -> None:
    try:
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except (Py4JError, PySparkException, OSError, AttributeError):  # the session has ended before: the folder's own retention then applies
        return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: what several results need is computed once, and a lost executor costs a re-read. The table goes when the driver ends."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/graphloom/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reachable(edge_table: DataFrame, starts: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(start, node, hops): every node that starts reach along edges and the least number of hops; cycles end because known pairs are not taken again. With max_hops, only those within so many hops.

    Known pairs lie in a table bucketed by (start, node) and partitioned by hop: a hop reads its frontier from the last partition, shuffles
    only what that leads to, and leaves out what is known where that lies. A lost executor costs a re-read.
    """
    spark = edge_table.sparkSession
    table, path = f"graphloom_reached_{uuid.uuid4().hex}", f"{shared_folder(spark).rstrip('/')}/graphloom/reached-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path, table)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

    def keep(pairs: DataFrame, hop: int) -> DataFrame:
        found = pairs.select("start", "node", F.lit(hop).alias("hops"))
        found.write.format("parquet").mode("append").option("path", path).partitionBy("hops").bucketBy(buckets, "start", "node").saveAsTable(table)
        return spark.table(table)

    steps = edge_table.select(F.col("source_ref").alias("node"), F.col("target_ref").alias("next")).distinct()
    known = keep(starts.select(F.col("node").alias("start"), "node").distinct(), 0)
    hop = 0
    while max_hops is None or hop < max_hops:
        ahead = known.where(F.col("hops") == hop).join(steps, "node").select("start", F.col("next").alias("node")).distinct()
        hop += 1
        known = keep(ahead.join(known.select("start", "node"), ["start", "node"], "left_anti"), hop)
        if known.where(F.col("hops") == hop).isEmpty():
            break
    return known.select("start", "node", "hops")


def reachable_sql(edges_view: str, starts_view: str, max_hops: int = 6) -> str:
    """The same closure up to so many hops as one recursive query. Spark's recursion keeps repeated rows, so that it suits shallow hierarchies."""
    return f"WITH RECURSIVE r(start, node, hops) AS (SELECT node, node, 0 FROM {starts_view} UNION ALL SELECT r.start, e.target_ref, r.hops + 1 FROM r JOIN {edges_view} e ON r.node = e.source_ref WHERE r.hops < {max_hops}) SELECT start, node, min(hops) AS hops FROM r GROUP BY start, node"
