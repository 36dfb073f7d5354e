"""Sources, sinks and synchronisation as queries: driver tables are landed as files in the shared folder and read back by the engine."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import scalar
from graphloom.operators import graph, state
from graphloom.plans.common import typed
from graphloom.queries import _t, query
from graphloom.sources import bundles, sinks
from graphloom.streaming import incremental


def _folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{graph.shared_folder(spark).rstrip('/')}/graphloom/{name}-{uuid.uuid4().hex}"
    atexit.register(graph._remove, spark, path)
    return path


def _landed(objects: DataFrame, group: str, member: str = "objects") -> DataFrame:
    """(group, one JSON document) with each group's objects, column raw in order of pos, as a list."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]), ",")
    return objects.groupBy(group).agg(F.concat(F.lit(f'{{"type":"bundle","{member}":['), listed, F.lit("]}")).alias("value"))


@query("SELECT extract(year FROM o_orderdate)::INT AS year, count(*) AS objects, sum(o_orderkey)::BIGINT AS keys, max(o_orderkey) AS last FROM orders GROUP BY 1")
def bundle_shards(spark, sf_dir):  # noqa: ANN001, ANN201
    """Shards of a catalog, one bundle a year; members that are not objects are skipped."""
    raw = F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit('"text",'), F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.year("o_orderdate").alias("y"))))).otherwise(F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.year("o_orderdate").alias("y"))))
    root = _folder(spark, "shards")
    _landed(_t(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderkey").alias("pos"), raw.alias("raw")), "year").write.partitionBy("year").text(root)
    objects = typed(bundles.sharded(spark, root, "year=*"), "k bigint, y int")
    return objects.groupBy(F.col("y").alias("year")).agg(F.count("*").alias("objects"), F.sum("k").alias("keys"), F.max_by("k", "pos").alias("last"))


@query("SELECT n_nationkey AS id, CASE WHEN n_regionkey < 2 THEN 'd0,d1' WHEN n_regionkey = 2 THEN 'd0' ELSE 'd1' END AS domains, CASE WHEN n_regionkey < 2 OR n_regionkey > 2 THEN 1 ELSE 0 END AS domain FROM nation")
def bundle_merge(spark, sf_dir):  # noqa: ANN001, ANN201
    """Two domains' bundles, of which the later one wins ties, with the union of their domains."""
    root, n = _folder(spark, "domains"), _t(spark, sf_dir, "nation")
    raw = lambda d: F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.lit("2020-01-01T00:00:00Z").alias("modified"), F.array(F.lit(d)).alias("domains")))
    for d, where in (("d0", "n_regionkey < 3"), ("d1", "n_regionkey <> 2")):
        _landed(n.where(where).select(F.lit(0).alias("g"), F.col("n_nationkey").alias("pos"), raw(d).alias("raw")), "g").select("value").write.text(f"{root}/{d}/latest.json")
    objects = typed(bundles.domains(spark, root, ["d0", "d1"]), "id int, modified string, domains array<string>").withColumn("place", F.col("domain_ord") * 1_000_000 + F.col("pos"))
    merged = state.domain_merge(objects, "id", "modified", "place", "domains")
    return merged.select("id", F.array_join("domains", ",").alias("domains"), F.col("domain_ord").alias("domain"))


@query("SELECT shape, count(*) AS records, sum(n_nationkey)::BIGINT AS keys FROM nation, (VALUES ('graph'), ('bindings'), ('list')) s(shape) GROUP BY shape")
def payload_shapes(spark, sf_dir):  # noqa: ANN001, ANN201
    """Records of responses of three shapes."""
    one = F.array_join(F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda k: F.concat(F.lit('{"k":'), k, F.lit("}"))), ",")
    listed = _t(spark, sf_dir, "nation").agg(F.concat(F.lit("["), one, F.lit(', "no object"]')).alias("records"))
    shapes = {"graph": ('{"@graph":', "}"), "bindings": ('{"results":{"bindings":', "}}"), "list": ("", "")}
    parts = [bundles.payload(listed.select(F.concat(F.lit(a), "records", F.lit(b)).alias("payload"))).select(F.lit(name).alias("shape"), F.get_json_object("raw", "$.k").cast("bigint").alias("k")) for name, (a, b) in shapes.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("shape").agg(F.count("*").alias("records"), F.sum("k").alias("keys"))


@query(
    "SELECT '4.'||p_size AS version, 'CWE-'||p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'category' ELSE 'weakness' END AS type, CASE p_partkey % 3 WHEN 0 THEN '2006-08-01T00:00:00.000Z' WHEN 1 THEN '2007-01-01T00:00:00.000Z' ELSE '2030-01-01T00:00:00Z' END AS created, CASE p_partkey % 3 WHEN 0 THEN '2020-02-24T00:00:00.000Z' WHEN 1 THEN '2008-01-01T00:00:00.000Z' ELSE '2030-01-01T00:00:00Z' END AS modified, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS summary, '{\"Kind\":\"a\",\"_text\":\"t\"}' AS note FROM part"
)
def catalog_xml(spark, sf_dir):  # noqa: ANN001, ANN201
    """Catalogs as XML, one for each size; release dates come before dates, empty elements are null."""
    k = F.col("p_partkey")
    day = lambda kind, a, b: f"<{kind}><{kind}_Date>{a}</{kind}_Date>" + (f"<{kind}_ReleaseDate>{b}</{kind}_ReleaseDate>" if b else "") + f"</{kind}>"
    history = F.when(k % 3 == 0, day("Submission", "2006-07-19", "2006-08-01") + day("Modification", "2020-01-10", "2020-02-24") + day("Modification", "2019-01-01", None)).when(k % 3 == 1, day("Modification", "2008-01-01", None) + day("Modification", "2007-01-01", None)).otherwise("")
    inner = F.concat(F.lit("<Sum_mary>"), F.when(k % 3 == 0, F.lit("")).otherwise(F.col("p_type")), F.lit('</Sum_mary><Note Kind="a">t</Note><Content_History>'), history, F.lit("</Content_History>"))
    tag = F.when(k % 4 == 0, "Category").otherwise("Weakness")
    entry = F.concat(F.lit("<"), tag, F.lit(' ID="'), k, F.lit('">'), inner, F.lit("</"), tag, F.lit(">"))
    of = lambda kind: F.array_join(F.collect_list(F.when(tag == kind, entry)), "")
    xml = F.concat(F.lit('<C xmlns="http://x" Date="2026-01-01" Version="4.'), F.col("p_size"), F.lit('"><Weaknesses>'), of("Weakness"), F.lit("</Weaknesses><Categories>"), of("Category"), F.lit("</Categories></C>"))
    root = _folder(spark, "xml")
    _t(spark, sf_dir, "part").groupBy("p_size").agg(xml.alias("value")).write.partitionBy("p_size").text(root)
    of_json = lambda c: F.get_json_object("raw", f"$.{c}").alias(c.lower())
    return bundles.catalog(spark, f"{root}/p_size=*", "2030-01-01T00:00:00Z").select("version", of_json("id"), of_json("type"), of_json("created"), of_json("modified"), of_json("Summary"), of_json("Note"))


@query("SELECT 'mobile-'||v||'.json' AS name, v AS version, row_number() OVER (ORDER BY string_split(v, '.')::INT[]) AS place FROM (VALUES ('1.9'), ('1.10'), ('2.0'), ('11.3'), ('9.0.1')) t(v)")
def release_files(spark, sf_dir):  # noqa: ANN001, ANN201
    """Releases by file name, in order of version numbers; other files are none."""
    from pyspark.sql.window import Window

    root = _folder(spark, "releases")
    for name in ("mobile-1.9.json", "mobile-1.10.json", "mobile-2.0.json", "mobile-11.3.json", "mobile-9.0.1.json", "mobile-beta.json", "ics-1.0.json"):
        p, fs = sinks._fs(spark, f"{root}/{name}")
        out = fs.create(p)
        out.writeBytes("{}")
        out.close()
    found = bundles.releases(spark, root, "mobile")
    order = Window.orderBy(scalar.version_key(F.col("version")))  # a row for each release
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "version", F.row_number().over(order).cast("bigint").alias("place"))


@query("SELECT r_name AS title, r_regionkey AS id FROM region WHERE r_name IN ('ASIA', 'AFRICA') ORDER BY r_name")
def collection_pick(spark, sf_dir):  # noqa: ANN001, ANN201
    """A collection by its title whatever its case, else by a part of it."""
    index = _t(spark, sf_dir, "region").select(F.col("r_name").alias("title"), F.col("r_regionkey").alias("id"))
    return bundles.version_picks(index, "asia").unionByName(bundles.version_picks(index, "frIc")).select("title", "id")


def _versions(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    e = _t(spark, sf_dir, "events").where(F.col("event_id") % 2 == odd)
    return e.select(F.col("user_id").cast("string").alias("key"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("modified"), F.col("event_type").alias("raw"), F.col("event_id").alias("pos"))


_SNAP = "(SELECT user_id, arg_max(event_id, (date_trunc('millisecond', ts), event_id)) AS event_id, max(date_trunc('millisecond', ts)) AS ts FROM events WHERE event_id % 2 = {} GROUP BY user_id)"
_OLD, _NEW = _SNAP.format(0), _SNAP.format(1)
_STATE = "key string, modified string, raw string, pos bigint"


@query(
    f"WITH o AS {_OLD}, n AS {_NEW}, j AS (SELECT coalesce(n.user_id, o.user_id) AS u, o.ts AS ot, n.ts AS nt FROM o FULL JOIN n ON n.user_id = o.user_id) SELECT 'full' AS run, (SELECT count(*) FROM o) AS added, 0 AS modified, 0 AS removed, 'none' AS delta, 'created' AS latest, 't1' AS cursor FROM (SELECT 1) UNION ALL SELECT run, count(*) FILTER (WHERE ot IS NULL), count(*) FILTER (WHERE nt > ot), 0, delta, 'modified', cursor FROM j, (VALUES ('dry', 'created', 't1'), ('incremental', 'created', 't2')) r(run, delta, cursor) GROUP BY run, delta, cursor"
)
def sync_runs(spark, sf_dir):  # noqa: ANN001, ANN201
    """A full run, a dry run that moves no cursor, an incremental run."""
    path, out = _folder(spark, "sync"), []
    for run, odd, stamp, options in (("full", 0, "2030-01-01", {"full": True}), ("dry", 1, "2030-01-02", {"dry_run": True}), ("incremental", 1, "2030-01-02", {})):
        m = incremental.run_incremental(spark, _versions(spark, sf_dir, odd), path, "key", "modified", stamp, _STATE, position="pos", **options)
        stored = sinks.read_manifest(spark, f"{path}/manifest")["last_fetch"]
        out.append((run, m["diff"]["added"], m["diff"]["modified"], m["diff"]["removed"], m["files"]["delta"], m["files"]["latest"], {"2030-01-01": "t1", "2030-01-02": "t2"}[stored]))
    return spark.createDataFrame(out, "run string, added bigint, modified bigint, removed bigint, delta string, latest string, cursor string")


@query(f"WITH o AS {_OLD}, n AS {_NEW} SELECT coalesce(n.user_id, o.user_id)::VARCHAR AS key, CASE WHEN o.ts IS NULL OR n.ts >= o.ts THEN n.event_id ELSE o.event_id END AS pos FROM o FULL JOIN n ON n.user_id = o.user_id")
def sync_state(spark, sf_dir):  # noqa: ANN001, ANN201
    """The state after a run without an earlier one and a second run; an older version never replaces a newer one."""
    path = _folder(spark, "sync")
    for odd in (0, 1):
        incremental.run_incremental(spark, _versions(spark, sf_dir, odd), path, "key", "modified", f"2030-01-0{odd + 1}", _STATE, position="pos", needs_cursor=False)
    return bundles.state(spark, f"{path}/latest", _STATE).select("key", "pos")


@query(f"WITH o AS {_OLD}, n AS {_NEW} SELECT coalesce(n.user_id, o.user_id)::VARCHAR AS key, CASE WHEN o.ts IS NULL OR n.ts >= o.ts THEN n.event_id ELSE o.event_id END AS pos FROM o FULL JOIN n ON n.user_id = o.user_id")
def stream_state(spark, sf_dir):  # noqa: ANN001, ANN201
    """The same state from a stream of landed files, micro-batch by micro-batch."""
    root = _folder(spark, "stream")
    for odd in (0, 1):
        _versions(spark, sf_dir, odd).write.mode("append").parquet(f"{root}/landed")
        landed = spark.readStream.schema(_STATE).parquet(f"{root}/landed")
        incremental.synchronise(landed.withColumn("modified", F.to_timestamp("modified")), f"{root}/state", f"{root}/checkpoint", _STATE.replace("modified string", "modified timestamp"), "key", "modified", "pos").awaitTermination()
    return incremental.current(spark, f"{root}/state", _STATE.replace("modified string", "modified timestamp")).select("key", "pos")


@query("SELECT c_mktsegment AS segment, count(*) AS written, count(*) FILTER (WHERE c_acctbal > 0) AS with_balance FROM customer GROUP BY 1 UNION ALL SELECT 'counted', count(*), count(*) FROM customer")
def table_writer(spark, sf_dir):  # noqa: ANN001, ANN201
    """Tables written as JSON without null fields, and their counts; a dry run writes nothing."""
    root = _folder(spark, "tables")
    customers = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"))
    dry = sinks.write_tables({"customer": customers}, f"{root}/dry", "json", dry_run=True)
    counts = sinks.write_tables({"customer": customers}, root, "json", partition_by={"customer": "c_mktsegment"})
    if sinks.exists(spark, f"{root}/dry"):
        raise AssertionError("a dry run has written")
    lines = spark.read.text(f"{root}/customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("written"), F.count_if(F.contains("value", F.lit("balance"))).alias("with_balance"))
    return lines.unionByName(spark.createDataFrame([("counted", counts["customer"], dry["customer"])], "segment string, written bigint, with_balance bigint"))


@query("SELECT v AS version, count(*) AS parts FROM part, (VALUES ('1.0', 0), ('1.1', 2)) t(v, m) WHERE p_size % 3 = m GROUP BY v")
def history_archive(spark, sf_dir):  # noqa: ANN001, ANN201
    """Versions side by side; archiving one again replaces it alone."""
    root, part = _folder(spark, "history"), _t(spark, sf_dir, "part").select("p_partkey", "p_size")
    for version, rest in (("1.0", 0), ("1.1", 1), ("1.1", 2)):
        sinks.archive(part.where(F.col("p_size") % 3 == rest), root, version)
    return spark.read.parquet(root).groupBy(F.col("version").cast("string").alias("version")).agg(F.count("*").alias("parts"))


@query("SELECT '| '||r_name||' | d | ['||(n - 1)||'.0](u'||(n - 1)||')'||CASE WHEN n > 1 THEN ', ['||(n - 2)||'.0](u'||(n - 2)||')' ELSE '' END AS line FROM (SELECT r_name, 2 AS n FROM region)")
def index_markdown(spark, sf_dir):  # noqa: ANN001, ANN201
    """The collection index as Markdown, the version changed last first."""
    r = _t(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name"), F.lit("d").alias("description"), F.lit("2020-01-01T00:00:00Z").alias("created"), F.explode(F.array(F.lit(0), F.lit(1))).alias("v"))
    rows = r.select("id", "name", "description", "created", F.concat(F.lit("202"), "v", F.lit("-01-01T00:00:00Z")).alias("modified"), F.concat("v", F.lit(".0")).alias("version"), F.concat(F.lit("u"), "v").alias("url"))
    lines = sinks.index_markdown(sinks.collection_index(rows)).strip().split("\n")[2:]
    return spark.createDataFrame([(x.rstrip(" |"),) for x in lines], "line string")


@query("SELECT strftime(min(ts), '%Y-%m-%dT%H:%M:%S.')||lpad((extract(millisecond FROM min(ts))::INT % 1000)::VARCHAR, 3, '0')||'Z' AS created, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.')||lpad((extract(millisecond FROM max(ts))::INT % 1000)::VARCHAR, 3, '0')||'Z' AS modified FROM events")
def index_dates(spark, sf_dir):  # noqa: ANN001, ANN201
    """The index's dates, to the millisecond."""
    return sinks.index_dates(_t(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("created"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("modified")))


@query(f"WITH o AS {_OLD}, n AS {_NEW}, j AS (SELECT coalesce(n.user_id, o.user_id) AS u, CASE WHEN o.ts IS NULL THEN 'added' WHEN n.ts IS NULL THEN 'removed' WHEN n.ts > o.ts THEN 'modified' END AS s FROM o FULL JOIN n ON n.user_id = o.user_id) SELECT coalesce(array_to_string(list_sort(list(u) FILTER (WHERE s = 'added')), ','), '') AS added, coalesce(array_to_string(list_sort(list(u) FILTER (WHERE s = 'modified')), ','), '') AS modified, coalesce(array_to_string(list_sort(list(u) FILTER (WHERE s = 'removed')), ','), '') AS removed FROM j")
def diff_lists(spark, sf_dir):  # noqa: ANN001, ANN201
    """O1: a diff's ids in order."""
    old, new = (state.latest_wins(_versions(spark, sf_dir, i).withColumn("key", F.col("key").cast("bigint")), "key", "modified", "pos") for i in (0, 1))
    found = state.listed(state.diff(old, new, "key", "modified"))
    return found.select(*[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("added", "modified", "removed")])


def _listing(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a listing of all orders' keys, in files of some 50,000."""
    folder = _folder(spark, "listing")
    keys = _t(spark, sf_dir, "orders").where("o_orderkey IS NOT NULL").select("o_orderkey")
    ordered = keys.repartitionByRange(keys.count() // 50_000 + 1, "o_orderkey").sortWithinPartitions("o_orderkey")
    ordered.select(F.format_string('{"k":%d}', "o_orderkey")).write.text(f"{folder}/listing")
    return folder


@query("SELECT 'feed' AS source, count(*) AS objects, sum(o_orderkey)::BIGINT AS keys, max(o_orderkey) AS last FROM orders UNION ALL SELECT 'capped', count(*), sum(o_orderkey)::BIGINT, max(o_orderkey) FROM (SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 1000) UNION ALL SELECT 'collection', count(*), sum(o_orderkey)::BIGINT, max(o_orderkey) FROM orders")
def paged_sources(spark, sf_dir):  # noqa: ANN001, ANN201
    """The feed page by page, whole and up to a number of pages, and a collection by its cursor."""
    from graphloom.sources import rest

    rest.register(spark)
    folder = _listing(spark, sf_dir)
    options = {"transport": "graphloom.sources.replay:get", "pageSize": "500", "quotaSeconds": "0.01"}
    feed = spark.read.format("offset_pages").options(url=f"replay:{folder}", **options).load()
    capped = spark.read.format("offset_pages").options(url=f"replay:{folder}", maxPages="2", **options).load()
    collection = spark.read.format("cursor_pages").options(url=f"replay:{folder}/objects", transport=options["transport"], limit="700").load()
    k = F.get_json_object("raw", "$.k").cast("bigint")
    tell = lambda df, name: df.select(F.lit(name).alias("source"), k.alias("k"), "pos").agg(F.first("source").alias("source"), F.count("*").alias("objects"), F.sum("k").alias("keys"), F.max_by("k", "pos").alias("last"))
    return tell(feed, "feed").unionByName(tell(capped, "capped")).unionByName(tell(collection, "collection"))
