"""The engine's operators as queries over the driver tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import identity, rich_text, scalar
from graphloom.operators import graph, links, recipes, state
from graphloom.plans import common
from graphloom.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _duck_uuid5(seed: str) -> str:
    h = f"sha1(unhex('{identity._URL_SPACE}') || encode({seed}))"
    return f"(substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||substr('89ab', 1 + (('0x'||substr({h},17,1))::INT & 3), 1)||substr({h},18,3)||'-'||substr({h},21,12))"


def _duck_edge(namespace: str, source: str, kind: str, target: str, extra: str = "") -> str:
    return "'relationship--'||" + _duck_uuid5(f"('{namespace}:'||{source}||'|'||{kind}||'|'||{target}{extra})")


# ---- snapshots: events are versions of users; events with even and with odd event_ids are two snapshots ----


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")


def _snapshot(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    return state.latest_wins(_versions(spark, sf_dir).where(F.col("event_id") % 2 == odd), "user_id", "ts", "event_id")


_V = "(SELECT user_id, ts, event_id, event_type, value FROM events)"
_SNAP = "(SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_id % 2 = {} GROUP BY user_id)"
_OLD, _NEW = _SNAP.format(0), _SNAP.format(1)


@query(f"SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM {_V} GROUP BY user_id")
def latest_wins_events(spark, sf_dir):  # noqa: ANN001, ANN201
    """A3, W1."""
    return state.latest_wins(_versions(spark, sf_dir), "user_id", "ts", "event_id")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_wins_events(spark, sf_dir):  # noqa: ANN001, ANN201
    """A5."""
    return state.last_wins(_versions(spark, sf_dir).select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query(f"SELECT coalesce(n.user_id, o.user_id) AS id, CASE WHEN o.user_id IS NULL THEN 'added' WHEN n.user_id IS NULL THEN 'removed' ELSE 'modified' END AS status FROM {_OLD} o FULL JOIN {_NEW} n ON o.user_id = n.user_id WHERE o.user_id IS NULL OR n.user_id IS NULL OR n.ts > o.ts")
def snapshot_diff(spark, sf_dir):  # noqa: ANN001, ANN201
    """J8, U3, O1."""
    return state.diff(_snapshot(spark, sf_dir, 0), _snapshot(spark, sf_dir, 1), "user_id", "ts")


@query(f"SELECT coalesce(n.user_id, o.user_id) AS id, CASE WHEN o.user_id IS NULL THEN 'added' WHEN n.user_id IS NULL THEN 'removed' ELSE 'modified' END AS status FROM {_OLD} o FULL JOIN {_NEW} n ON o.user_id = n.user_id WHERE o.user_id IS NULL OR n.user_id IS NULL OR md5(n.event_type) <> md5(o.event_type)")
def hash_diff(spark, sf_dir):  # noqa: ANN001, ANN201
    """J9."""
    a, b = (_snapshot(spark, sf_dir, i).withColumn("hash", F.md5("event_type")) for i in (0, 1))
    return state.diff(a, b, "user_id", "hash", by_hash=True)


@query(f"SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, side)) AS event_id, arg_max(event_type, (ts, side)) AS event_type, arg_max(value, (ts, side)) AS value FROM (SELECT *, 0 AS side FROM {_OLD} UNION ALL SELECT *, 1 FROM {_NEW}) GROUP BY user_id")
def merge_latest(spark, sf_dir):  # noqa: ANN001, ANN201
    """J10, I3, I4."""
    return state.merge_latest(_snapshot(spark, sf_dir, 0), _snapshot(spark, sf_dir, 1), "user_id", "ts")


@query(f"SELECT * FROM {_NEW} UNION ALL SELECT * FROM {_OLD} o WHERE NOT EXISTS (SELECT 1 FROM {_NEW} n WHERE n.user_id = o.user_id)")
def overwrite_merge(spark, sf_dir):  # noqa: ANN001, ANN201
    """J11."""
    return state.overwrite_merge(_snapshot(spark, sf_dir, 0), _snapshot(spark, sf_dir, 1), "user_id")


@query(f"SELECT n.* FROM {_NEW} n LEFT JOIN {_OLD} o ON n.user_id = o.user_id WHERE o.user_id IS NULL OR n.ts > o.ts")
def compute_delta(spark, sf_dir):  # noqa: ANN001, ANN201
    """J12, I5."""
    return state.delta(_snapshot(spark, sf_dir, 0), _snapshot(spark, sf_dir, 1), "user_id", "ts")


@query(f"SELECT n.* FROM {_NEW} n LEFT JOIN {_OLD} o ON n.user_id = o.user_id WHERE o.user_id IS NULL OR n.event_type IS DISTINCT FROM o.event_type")
def delta_by_hash(spark, sf_dir):  # noqa: ANN001, ANN201
    """J13."""
    return state.delta_by_hash(_snapshot(spark, sf_dir, 0), _snapshot(spark, sf_dir, 1), "user_id", "event_type")


@query(f"SELECT n.user_id, CASE WHEN o.user_id IS NULL THEN 'added' ELSE 'modified' END AS part FROM {_NEW} n LEFT JOIN {_OLD} o ON n.user_id = o.user_id WHERE o.user_id IS NULL OR n.ts > o.ts")
def added_modified_split(spark, sf_dir):  # noqa: ANN001, ANN201
    """J15."""
    old, new = _snapshot(spark, sf_dir, 0), _snapshot(spark, sf_dir, 1)
    added, modified = state.split_delta(state.delta(old, new, "user_id", "ts"), old, "user_id")
    return added.select("user_id", F.lit("added").alias("part")).unionByName(modified.select("user_id", F.lit("modified").alias("part")))


@query(f"SELECT n.user_id, coalesce(strftime(o.ts, '%Y-%m-%d'), '2030-01-01') AS first_seen FROM {_NEW} n LEFT JOIN {_OLD} o ON n.user_id = o.user_id")
def first_seen_stamp(spark, sf_dir):  # noqa: ANN001, ANN201
    """J14, I6."""
    old = _snapshot(spark, sf_dir, 0).withColumn("first_seen", F.date_format("ts", "yyyy-MM-dd"))
    return state.carry_first_seen(_snapshot(spark, sf_dir, 1).select("user_id"), old, "user_id", "first_seen", F.lit("2030-01-01"))


_TEXT_TIME = "date_trunc(CASE WHEN event_id % 3 = 0 THEN 'second' ELSE 'millisecond' END, ts)"


@query(f"SELECT user_id, arg_max(event_id, ({_TEXT_TIME}, event_id)) AS event_id, strftime(max({_TEXT_TIME}), '%Y-%m-%dT%H:%M:%S') AS newest FROM events GROUP BY user_id")
def text_time_versions(spark, sf_dir):  # noqa: ANN001, ANN201
    """Text times without a fraction, with one, and with an offset order by value; an empty modified time falls back on the created one."""
    at, odd = F.col("ts"), F.col("event_id") % 3
    fmt = "yyyy-MM-dd'T'HH:mm:ss"
    text = F.when(odd == 0, F.date_format(at, fmt + "'Z'")).when(odd == 1, F.date_format(at, fmt + ".SSS'Z'")).otherwise(F.concat(F.date_format(at + F.expr("INTERVAL 2 HOURS"), fmt + ".SSS"), F.lit("+02:00")))
    df = _t(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 2 == 0, text).otherwise("").alias("modified"), F.when(F.col("event_id") % 2 == 1, text).alias("created"))
    best = state.latest_wins(df, "user_id", ("modified", "created"), "event_id")
    return best.select("user_id", "event_id", F.date_format(state.version_time(best, ("modified", "created")), fmt).alias("newest"))


@query("SELECT coalesce(nullif(event_type, 'view'), 'unknown') AS type, count(*) AS n FROM events GROUP BY 1")
def type_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    """A1."""
    return state.counts_by_type(_t(spark, sf_dir, "events").select(F.nullif("event_type", F.lit("view")).alias("type")))


@query("SELECT strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS newest FROM events")
def newest_modified(spark, sf_dir):  # noqa: ANN001, ANN201
    """A2, F5."""
    return state.newest(_t(spark, sf_dir, "events"), "ts").select(F.date_format("newest", "yyyy-MM-dd'T'HH:mm:ss").alias("newest"))


@query("SELECT event_type AS type, CASE WHEN event_type IN ('view') THEN 'boilerplate' ELSE 'unexpected type' END AS reason, count(*) AS n FROM events WHERE event_type NOT IN ('purchase', 'signup') GROUP BY 1")
def reject_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    """A8, P6, P7."""
    return common.rejects(_t(spark, sf_dir, "events").withColumnRenamed("event_type", "type"), ("purchase", "signup"), ("view",))


@query("SELECT user_id, CASE WHEN count(*) > 1 THEN array_to_string(list_sort(list_distinct(list(event_type))), ',') ELSE any_value(event_type) END AS domains, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def cross_bundle_merge(spark, sf_dir):  # noqa: ANN001, ANN201
    """A4, S16."""
    df = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.array("event_type").alias("domains"))
    return state.domain_merge(df, "user_id", "ts", "event_id", "domains").select("user_id", F.array_join("domains", ",").alias("domains"), "ts", "event_id")


@query("SELECT extract(year FROM o_orderdate)::INT AS shard, count(*) AS rows, count(*) FILTER (WHERE o_orderstatus = 'F') AS closed, sum(o_custkey)::BIGINT AS keys FROM orders GROUP BY ROLLUP (1)")
def shard_totals(spark, sf_dir):  # noqa: ANN001, ANN201
    """Totals by shard and over all."""
    return state.shard_totals(_t(spark, sf_dir, "orders"), F.year("o_orderdate"), closed=F.col("o_orderstatus") == "F", keys=F.col("o_custkey"))


@query("SELECT user_id, coalesce(min(ts) FILTER (WHERE event_type = 'signup'), min(ts)) AS created, max(ts) AS modified FROM events GROUP BY user_id")
def history_dates(spark, sf_dir):  # noqa: ANN001, ANN201
    """First submission or else first change, last change."""
    return state.history_dates(_t(spark, sf_dir, "events"), "user_id", "ts", "event_type", "signup")


@query("SELECT event_type, arg_min(value, event_id) FILTER (WHERE value > 50) AS value FROM events GROUP BY event_type")
def first_non_null(spark, sf_dir):  # noqa: ANN001, ANN201
    """A12."""
    stated = _t(spark, sf_dir, "events").withColumn("value", F.when(F.col("value") > 50, F.col("value")))
    return state.first_stated(stated, "value", "event_id", "event_type")


# ---- edges, nodes and joins: customers place orders, orders contain parts ----


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").select(F.concat(F.lit("customer--"), F.col("o_custkey")).alias("s"), F.concat(F.lit("order--"), F.col("o_orderkey")).alias("t"), "o_orderpriority")
    return graph.edges(orders, "orders", F.col("s"), "placed", F.col("t"), {"priority": F.col("o_orderpriority")})


_PLACED = f"SELECT {_duck_edge('orders', 's', chr(39) + 'placed' + chr(39), 't', '||' + chr(39) + '|priority=' + chr(39) + '||o_orderpriority')} AS id, 'relationship' AS type, 'placed' AS relationship_type, s AS source_ref, t AS target_ref, o_orderpriority AS priority FROM (SELECT 'customer--'||o_custkey AS s, 'order--'||o_orderkey AS t, o_orderpriority FROM orders)"


@query(_PLACED)
def deterministic_edges(spark, sf_dir):  # noqa: ANN001, ANN201
    """an edge whose identity hashes its ends, its kind and an attribute."""
    return _placed(spark, sf_dir)


@query("SELECT 'Customer' AS source_type, 'placed' AS relationship_type, o_orderstatus AS target_type, count(*) AS n FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY o_orderstatus UNION ALL SELECT o_orderstatus, 'contains', p_brand, count(*) FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey GROUP BY o_orderstatus, p_brand")
def typed_edge_histogram(spark, sf_dir):  # noqa: ANN001, ANN201
    """The flagship query."""
    customers, orders, parts = (_t(spark, sf_dir, n) for n in ("customer", "orders", "part"))
    nodes = (
        customers.select(F.concat(F.lit("customer--"), F.col("c_custkey")).alias("id"), F.lit("Customer").alias("type"))
        .unionByName(orders.select(F.concat(F.lit("order--"), F.col("o_orderkey")).alias("id"), F.col("o_orderstatus").alias("type")))
        .unionByName(parts.select(F.concat(F.lit("part--"), F.col("p_partkey")).alias("id"), F.col("p_brand").alias("type")))
    )
    items = _t(spark, sf_dir, "lineitem").select(F.concat(F.lit("order--"), F.col("l_orderkey")).alias("s"), F.concat(F.lit("part--"), F.col("l_partkey")).alias("t"))
    return graph.histogram(graph.union_edges(_placed(spark, sf_dir), graph.edges(items, "items", F.col("s"), "contains", F.col("t"))), nodes).where("source_type is not null and target_type is not null")


@query(f"SELECT 'state--'||{_duck_uuid5('(' + chr(39) + 'items:state:' + chr(39) + '||key)')} AS id, l_returnflag, l_linestatus, line FROM (SELECT DISTINCT CASE WHEN l_linestatus = 'O' THEN 'private|'||l_orderkey||'|'||l_linenumber||'|'||l_returnflag ELSE l_returnflag||'|'||l_linestatus END AS key, l_returnflag, l_linestatus, CASE WHEN l_linestatus = 'O' THEN l_linenumber END AS line FROM lineitem)")
def shared_node_dedupe(spark, sf_dir):  # noqa: ANN001, ANN201
    """Shared node with a natural key, private node by owner and position without."""
    private = F.col("l_linestatus") == "O"
    key = F.when(private, F.concat_ws("|", F.lit("private"), "l_orderkey", "l_linenumber", "l_returnflag")).otherwise(F.concat_ws("|", "l_returnflag", "l_linestatus"))
    items = _t(spark, sf_dir, "lineitem")
    return graph.shared_nodes(items.select(identity.node_id("items", "state", key).alias("id"), "l_returnflag", "l_linestatus", F.when(private, F.col("l_linenumber")).alias("line")))


_CLAIM = "(SELECT 'part--'||p_partkey AS stix_id, CASE WHEN p_size % 2 = 0 THEN 'attack-pattern' WHEN p_size % 3 = 0 THEN 'tool' ELSE 'course-of-action' END AS type, CASE WHEN p_partkey % 5 > 0 THEN 'T'||(p_partkey // 3) END AS code, p_retailprice > 1100 AS active, p_partkey AS pos FROM part)"


@query(f"WITH c AS {_CLAIM}, g AS (SELECT code, count(*) AS n, list_sort(list_distinct(list(type))) AS types, arg_min(stix_id, pos) FILTER (WHERE type = 'attack-pattern') AS fp, count(*) FILTER (WHERE active) AS na, max(stix_id) FILTER (WHERE active) AS oa FROM c WHERE code IS NOT NULL GROUP BY code) SELECT c.stix_id, CASE WHEN c.code IS NULL THEN c.stix_id WHEN g.n = 1 THEN c.code WHEN g.types = ['attack-pattern', 'course-of-action'] THEN CASE WHEN fp = c.stix_id THEN c.code END WHEN na = 1 AND oa = c.stix_id THEN c.code END AS final_id FROM c LEFT JOIN g ON g.code = c.code")
def canonical_id_resolution(spark, sf_dir):  # noqa: ANN001, ANN201
    """E10, A13, W4."""
    p = _t(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 2 == 0, "attack-pattern").when(F.col("p_size") % 3 == 0, "tool").otherwise("course-of-action")
    code = F.when(F.col("p_partkey") % 5 > 0, F.concat(F.lit("T"), F.floor(F.col("p_partkey") / 3).cast("bigint")))
    return graph.resolve_ids(p.select(F.concat(F.lit("part--"), F.col("p_partkey")).alias("stix_id"), kind.alias("type"), code.alias("code"), (F.col("p_retailprice") > 1100).alias("active"), F.col("p_partkey").alias("pos")))


@query("SELECT l_orderkey, l_linenumber, 'order--'||o_orderkey AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def fk_strict_join(spark, sf_dir):  # noqa: ANN001, ANN201
    """J1, J5, J6, J7."""
    ids = _t(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("order--"), F.col("o_orderkey")).alias("target"))
    return graph.strict_lookup(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", ids, "o_orderkey", "target", "target", "order")


@query("SELECT o_orderkey, coalesce('customer--'||c.c_custkey, o.o_custkey::VARCHAR) AS source_ref FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = o.o_custkey")
def fk_lenient_remap(spark, sf_dir):  # noqa: ANN001, ANN201
    """J2."""
    ids = _t(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("k"), F.concat(F.lit("customer--"), F.col("c_custkey")).alias("v"))
    return graph.lenient_remap(_t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("source_ref")), "source_ref", ids, "k", "v")


@query("SELECT 'N'||a.n_nationkey AS source_ref, 'N'||b.n_nationkey AS target_ref, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation a ON a.n_nationkey = s_nationkey AND a.n_regionkey > 0 JOIN nation b ON b.n_nationkey = c_nationkey AND b.n_regionkey > 0 GROUP BY 1, 2")
def double_endpoint_join(spark, sf_dir):  # noqa: ANN001, ANN201
    """An edge stays only if both ends resolve."""
    ids = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_regionkey") > 0, F.concat(F.lit("N"), F.col("n_nationkey"))).alias("v"))
    items = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    pairs = items.groupBy(F.col("s_nationkey").alias("source_ref"), F.col("c_nationkey").alias("target_ref")).agg(F.count("*").alias("n"))
    return graph.both_endpoints(pairs, ids, "k", "v").select("source_ref", "target_ref", "n")


@query("SELECT l1.l_orderkey, l1.l_linenumber, l2.n FROM lineitem l1 JOIN (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) l2 ON l1.l_partkey = l2.l_partkey AND l1.l_suppkey = l2.l_suppkey")
def composite_key_join(spark, sf_dir):  # noqa: ANN001, ANN201
    """J4."""
    items = _t(spark, sf_dir, "lineitem")
    pairs = items.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    found = graph.composite_lookup(items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"], pairs, ["l_partkey", "l_suppkey"], "n", "n", "pair")
    return found.select("l_orderkey", "l_linenumber", "n")


@query("WITH n AS (SELECT 'customer--'||c_custkey AS id FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'order--'||o_orderkey FROM orders WHERE o_orderstatus <> 'P'), e AS (SELECT 'source' AS endpoint, 'customer--'||o_custkey AS ref FROM orders UNION ALL SELECT 'target', 'order--'||o_orderkey FROM orders) SELECT endpoint, 'placed' AS relationship_type, count(DISTINCT ref) AS missing, count(*) AS edges FROM e WHERE ref NOT IN (SELECT id FROM n) GROUP BY endpoint")
def orphan_audit(spark, sf_dir):  # noqa: ANN001, ANN201
    """J25, T1."""
    nodes = _t(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.concat(F.lit("customer--"), F.col("c_custkey")).alias("id")).unionByName(_t(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.concat(F.lit("order--"), F.col("o_orderkey")).alias("id")))
    return graph.orphans(_placed(spark, sf_dir), nodes)


@query("SELECT DISTINCT least(s_nationkey, c_nationkey) AS low, greatest(s_nationkey, c_nationkey) AS high FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey")
def peer_pair_dedupe(spark, sf_dir):  # noqa: ANN001, ANN201
    """U6, G14."""
    items = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return graph.peer_pairs(items, "s_nationkey", "c_nationkey")


@query("SELECT r_regionkey, count(DISTINCT c_custkey) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_regionkey")
def two_hop_relation(spark, sf_dir):  # noqa: ANN001, ANN201
    """J18, J19."""
    return _paths(spark, sf_dir, 2).groupBy("r_regionkey").agg(F.count_distinct("c").alias("customers"))


@query("SELECT r_regionkey, count(*) AS orders FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_regionkey")
def three_hop_relation(spark, sf_dir):  # noqa: ANN001, ANN201
    """J20, J24."""
    return _paths(spark, sf_dir, 3).groupBy("r_regionkey").agg(F.count("*").alias("orders"))


def _paths(spark: SparkSession, sf_dir: str, hops: int) -> DataFrame:
    def part(table: str, s: str, t: str, kind: str) -> DataFrame:
        return _t(spark, sf_dir, table).select(F.col(s).cast("bigint").alias("source_ref"), F.col(t).cast("bigint").alias("target_ref"), F.lit(kind).alias("relationship_type"))

    paths = _t(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("r_regionkey"))
    paths = links.hop(paths, part("nation", "n_regionkey", "n_nationkey", "has"), "has", "n")
    paths = links.hop(paths, part("customer", "c_nationkey", "c_custkey", "home"), "home", "c")
    return links.hop(paths, part("orders", "o_custkey", "o_orderkey", "placed"), "placed", "o") if hops == 3 else paths


@query("SELECT 'placed' AS relationship_type, count(*) AS n, count(DISTINCT o_custkey) AS sources, count(DISTINCT o_orderkey) AS targets FROM orders")
def verb_histogram(spark, sf_dir):  # noqa: ANN001, ANN201
    """A18."""
    return graph.verbs(_placed(spark, sf_dir))


@query("SELECT 'quality' AS field, count(quality) AS present, count(*) AS rows, count(quality) / count(*) AS share FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id UNION ALL SELECT 'lang', count(lang), count(*), count(lang) / count(*) FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def field_prevalence(spark, sf_dir):  # noqa: ANN001, ANN201
    """A17."""
    return graph.prevalence(_t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left"), ["quality", "lang"])


@query("WITH RECURSIVE e AS (SELECT 'R'||n_regionkey AS s, 'N'||n_nationkey AS t FROM nation UNION SELECT 'N'||n_nationkey, 'N'||((n_nationkey * 7 + 3) % 25) FROM nation WHERE n_nationkey % 4 = 0), r(start, node) AS (SELECT 'R'||r_regionkey, 'R'||r_regionkey FROM region UNION SELECT r.start, e.t FROM r JOIN e ON e.s = r.node) SELECT start, node FROM r")
def hierarchy_closure(spark, sf_dir):  # noqa: ANN001, ANN201
    """J26."""
    n = _t(spark, sf_dir, "nation")
    steps = n.select(F.concat(F.lit("R"), F.col("n_regionkey")).alias("source_ref"), F.concat(F.lit("N"), F.col("n_nationkey")).alias("target_ref")).unionByName(n.where("n_nationkey % 4 = 0").select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("source_ref"), F.concat(F.lit("N"), (F.col("n_nationkey") * 7 + 3) % 25).alias("target_ref")))
    starts = _t(spark, sf_dir, "region").select(F.concat(F.lit("R"), F.col("r_regionkey")).alias("node"))
    return graph.reachable(steps, starts).select("start", "node")


@query("WITH f AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_returnflag = 'R'), r AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 25) SELECT CASE WHEN f.a IS NOT NULL AND r.a IS NOT NULL THEN 'both' WHEN f.a IS NOT NULL THEN 'forward' ELSE 'backward' END AS stated, count(*) AS n FROM f FULL JOIN r ON f.a = r.a AND f.b = r.b GROUP BY 1")
def two_sided_relation(spark, sf_dir):  # noqa: ANN001, ANN201
    """One relation stated by two catalogs."""
    items = _t(spark, sf_dir, "lineitem")
    forward = items.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("source_ref"), F.col("l_partkey").alias("target_ref"))
    backward = items.where("l_linestatus = 'F' and l_quantity > 25").select(F.col("l_partkey").alias("source_ref"), F.col("l_orderkey").alias("target_ref"))
    return links.reconciled(forward, backward).groupBy("stated").agg(F.count("*").alias("n"))


# ---- relations: suppliers are groups, customers campaigns, parts tools and malware, orders techniques; lineitems link them ----

_LINKS = """(SELECT DISTINCT 'intrusion-set--'||l_suppkey AS s, 'uses' AS k, CASE WHEN l_partkey % 2 = 0 THEN 'tool--' ELSE 'malware--' END||l_partkey AS t FROM lineitem WHERE l_linenumber = 1
  UNION SELECT DISTINCT 'campaign--'||o_custkey, 'uses', CASE WHEN l_partkey % 2 = 0 THEN 'tool--' ELSE 'malware--' END||l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 2
  UNION SELECT 'campaign--'||c_custkey, 'attributed-to', 'intrusion-set--'||(c_custkey % 10) FROM customer
  UNION SELECT DISTINCT CASE WHEN l_partkey % 2 = 0 THEN 'tool--' ELSE 'malware--' END||l_partkey, 'uses', 'attack-pattern--'||(l_orderkey % 40) FROM lineitem WHERE l_linenumber = 3
  UNION SELECT 'attack-pattern--'||n_nationkey, 'revoked-by', 'attack-pattern--'||(n_nationkey + 1) FROM nation)"""
_USES = f"SELECT s AS id, t AS related_id FROM {_LINKS} WHERE s LIKE 'intrusion-set--%' UNION SELECT a.t, u.t FROM {_LINKS} a JOIN {_LINKS} u ON u.s = a.s AND u.k = 'uses' WHERE a.k = 'attributed-to'"
_LIVE_END = "NOT (related_id LIKE 'tool--%0' OR related_id LIKE 'malware--%1')"


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(objects, links): those that end in 0 among tools and in 1 among malware are revoked."""
    items, n = _t(spark, sf_dir, "lineitem"), lambda kind, c: F.concat(F.lit(f"{kind}--"), c)
    software = F.concat(F.when(F.col("l_partkey") % 2 == 0, "tool--").otherwise("malware--"), F.col("l_partkey"))
    link = lambda df, s, k, t: df.select(s.alias("source_ref"), F.lit(k).alias("relationship_type"), t.alias("target_ref")).distinct()
    orders, customers, nations = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation")
    parts = [
        link(items.where("l_linenumber = 1"), n("intrusion-set", F.col("l_suppkey")), "uses", software), link(items.where("l_linenumber = 2").join(orders, F.col("l_orderkey") == F.col("o_orderkey")), n("campaign", F.col("o_custkey")), "uses", software),
        link(customers, n("campaign", F.col("c_custkey")), "attributed-to", n("intrusion-set", F.col("c_custkey") % 10)), link(items.where("l_linenumber = 3"), software, "uses", n("attack-pattern", F.col("l_orderkey") % 40)),
        link(nations, n("attack-pattern", F.col("n_nationkey")), "revoked-by", n("attack-pattern", F.col("n_nationkey") + 1)),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    none = F.lit(False)
    every = every.withColumns({"id": F.concat_ws("|", "source_ref", "relationship_type", "target_ref"), "revoked": none, "x_mitre_deprecated": none})
    revoked = F.col("id").rlike("^(tool--[0-9]*0|malware--[0-9]*1|attack-pattern--(0|1))$")
    objects = every.select(F.explode(F.array("source_ref", "target_ref")).alias("id")).distinct().select("id", F.split("id", "--")[0].alias("type"), revoked.alias("revoked"), none.alias("x_mitre_deprecated"))
    return objects, every


@query(f"SELECT id, count(*) AS n, array_to_string(list_sort(list(related_id))[1:3], ',') AS lowest FROM (SELECT DISTINCT id, related_id FROM ({_USES}) WHERE {_LIVE_END}) GROUP BY id")
def collected_relations(spark, sf_dir):  # noqa: ANN001, ANN201
    """Software that groups use, themselves or in campaigns attributed to them, collected by group."""
    pairs = recipes.relation(*_linked(spark, sf_dir), "group uses software").select("id", "related_id", F.lit("r").alias("relationship"))
    return recipes.collected(pairs).select("id", F.size("related").cast("bigint").alias("n"), F.array_join(F.transform(F.slice("related", 1, 3), lambda r: r["related_id"]), ",").alias("lowest"))


@query(f"SELECT DISTINCT t AS id, s AS related_id FROM {_LINKS} WHERE k = 'uses' AND s LIKE 'campaign--%'")
def reverse_relations(spark, sf_dir):  # noqa: ANN001, ANN201
    """Campaigns that use a software; only the far end is asked to be live."""
    return recipes.relation(*_linked(spark, sf_dir), "campaign uses software", reverse=True).select("id", "related_id").distinct()


@query(f"SELECT DISTINCT u.id, u.related_id AS via, x.t AS related_id FROM (SELECT DISTINCT id, related_id FROM ({_USES}) WHERE {_LIVE_END}) u JOIN {_LINKS} x ON x.s = u.related_id AND x.k = 'uses' WHERE x.t NOT IN ('attack-pattern--0', 'attack-pattern--1')")
def relation_paths(spark, sf_dir):  # noqa: ANN001, ANN201
    """Techniques of the software that groups use."""
    return recipes.relation_path(*_linked(spark, sf_dir), "group uses software", "software uses technique")


@query("SELECT 'attack-pattern--'||n_nationkey AS revoked_id, 'attack-pattern--'||(n_nationkey + 1) AS id FROM nation WHERE n_nationkey IN (1, 5) UNION ALL SELECT 'attack-pattern--99', NULL")
def revoking_objects(spark, sf_dir):  # noqa: ANN001, ANN201
    """What replaces a revoked object, if it is live."""
    objects, every = _linked(spark, sf_dir)
    asked = ["attack-pattern--0", "attack-pattern--1", "attack-pattern--5", "attack-pattern--99"]
    found = [recipes.revoking_object(objects, every, i).select(F.lit(i).alias("revoked_id"), "id") for i in asked]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.unionByName(spark.createDataFrame([("attack-pattern--99", None)], "revoked_id string, id string"))


@query("SELECT 'm'||r_regionkey AS matrix_id, r_name AS matrix, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey DESC) - 1 AS pos, 'n'||n_nationkey AS tactic_id, n_name AS tactic FROM region JOIN nation ON n_regionkey = r_regionkey")
def ordered_members(spark, sf_dir):  # noqa: ANN001, ANN201
    """Members in the order of their references."""
    nations = _t(spark, sf_dir, "nation")
    refs = nations.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey"), asc=False).alias("refs"))
    matrices = _t(spark, sf_dir, "region").join(refs, F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat(F.lit("m"), F.col("r_regionkey")).alias("id"), F.lit("x-mitre-matrix").alias("type"), F.col("r_name").alias("name"), F.transform("refs", lambda n: F.concat(F.lit("n"), n)).alias("tactic_refs"))
    tactics = nations.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.lit("x-mitre-tactic").alias("type"), F.col("n_name").alias("name"), F.lit(None).cast("array<string>").alias("tactic_refs"))
    return recipes.tactics_in_order(matrices.unionByName(tactics)).withColumn("pos", F.col("pos").cast("bigint"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL AND l_returnflag <> 'A' UNION SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem WHERE l_returnflag = 'A' AND l_discount > 0.02")
def distinct_tuples(spark, sf_dir):  # noqa: ANN001, ANN201
    """Each fact once, in order, without rows that lack a part of it."""
    flag = F.when((F.col("l_returnflag") != "A") | (F.col("l_discount") > 0.02), F.col("l_returnflag"))
    return graph.facts(_t(spark, sf_dir, "lineitem").withColumn("l_returnflag", flag), "l_returnflag", "l_linestatus", ordered=True)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT (o_orderstatus = 'F') AND NOT (o_orderpriority = '1-URGENT')")
def revoked_filter(spark, sf_dir):  # noqa: ANN001, ANN201
    """P27, P8."""
    flagged = _t(spark, sf_dir, "orders").withColumns({"revoked": F.when(F.col("o_orderstatus") == "F", True), "x_mitre_deprecated": F.col("o_orderpriority") == "1-URGENT"})
    return recipes.active(flagged).select("o_orderkey", "o_totalprice")


_OBJ = "(SELECT 'o'||p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'attack-pattern' WHEN 1 THEN 'tool' WHEN 2 THEN 'malware' ELSE 'intrusion-set' END AS type, p_name AS name, p_brand AS brand, p_size AS size, p_partkey AS k, p_type AS d FROM part)"
_RECIPES = {
    "id": "id = 'o7'", "code": "k % 11 = 3", "typed code": "k % 11 = 3 AND type = 'tool'", "name": "type = 'tool' AND name = 'small ring'", "alias": "type = 'intrusion-set' AND brand = 'Brand#2'", "type": "type IN ('tool')",
    "software": "type IN ('tool', 'malware')", "techniques": "type = 'attack-pattern' AND size % 8 <> 0", "subtechniques": "type = 'attack-pattern' AND size % 8 = 0", "content": "type = 'attack-pattern' AND contains(lower(d), 'on')",
    "platform": "type = 'attack-pattern' AND size > 25", "tactic": "type = 'attack-pattern' AND k % 3 = 1", "created": "k % 28 + 1 > 14", "modified": "k % 28 + 1 > 20",
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS recipe, id FROM {_OBJ} WHERE {where}" for name, where in _RECIPES.items()))
def recipe_filters(spark, sf_dir):  # noqa: ANN001, ANN201
    """Each recipe over parts as objects."""
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = F.when(size % 4 == 0, "attack-pattern").when(size % 4 == 1, "tool").when(size % 4 == 2, "malware").otherwise("intrusion-set")
    phase = lambda chain, name: F.struct(F.lit(chain).alias("kill_chain_name"), F.lit(name).alias("phase_name"))
    day = F.format_string("2020-01-%02dT00:00:00.000Z", k % 28 + 1)
    o = _t(spark, sf_dir, "part").select(
        F.concat(F.lit("o"), k).alias("id"), kind.alias("type"), F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"), F.array(F.struct(F.lit("mitre-attack").alias("source_name"), F.concat(F.lit("T"), k % 11).alias("external_id"))).alias("external_references"),
        F.when(k % 3 == 1, F.array(phase("mitre-attack", "impact"))).otherwise(F.array(phase("other", "impact"))).alias("kill_chain_phases"), F.array(F.when(size > 25, "Large").otherwise("Small")).alias("x_mitre_platforms"), (size % 8 == 0).alias("x_mitre_is_subtechnique"), F.col("p_type").alias("description"), day.alias("created"), day.alias("modified"),
    )
    found = {
        "id": recipes.by_stix_id(o, "o7"), "code": recipes.by_attack_id(o, "T3"), "typed code": recipes.by_attack_id(o, "T3", "tool"), "name": recipes.by_name(o, "tool", "small ring"), "alias": recipes.by_alias(o, "Brand#2"), "type": recipes.by_type(o, "tool"),
        "software": recipes.software(o), "techniques": recipes.techniques(o, "techniques"), "subtechniques": recipes.techniques(o, "subtechniques"), "content": recipes.by_content(o, "ON"),
        "platform": recipes.by_platform(o, "Large"), "tactic": recipes.by_tactic(o, "impact"), "created": recipes.since(o, "2020-01-14", "created"), "modified": recipes.since(o, "2020-01-20"),
    }
    parts = [df.select(F.lit(name).alias("recipe"), "id") for name, df in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- scalar functions ----


@query("SELECT event_id, CAST(props->>'$.k' AS INT) AS k FROM events")
def json_prop_extract(spark, sf_dir):  # noqa: ANN001, ANN201
    """Objects parsed by an explicit schema."""
    return common.typed(_t(spark, sf_dir, "events").select("event_id", F.col("props").alias("raw")), "k int").select("event_id", "k")


@query("SELECT DISTINCT c_mktsegment, lower(regexp_replace('Base' || c_mktsegment[1:1] || 'ScoreOf' || lower(c_mktsegment[2:]) || 'Vector', '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake FROM customer")
def snake_case_keys(spark, sf_dir):  # noqa: ANN001, ANN201
    """P4, P3."""
    name = F.concat(F.lit("Base"), F.substring("c_mktsegment", 1, 1), F.lit("ScoreOf"), F.lower(F.substring("c_mktsegment", 2, 99)), F.lit("Vector"))
    return _t(spark, sf_dir, "customer").select("c_mktsegment", scalar.snake_case(name).alias("snake")).distinct()


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(trim('  '||p_type||' / '||p_name||'! ')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def slugify_label(spark, sf_dir):  # noqa: ANN001, ANN201
    """F18, G26, G28."""
    return _t(spark, sf_dir, "part").select("p_partkey", scalar.slug(F.concat(F.lit("  "), "p_type", F.lit(" / "), "p_name", F.lit("! "))).alias("slug"))


_NOTED = "(SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type||' ('||p_name||' (x))' WHEN p_size % 3 = 1 THEN p_type||' ('||p_name ELSE p_type END AS t FROM part)"


@query(f"SELECT p_partkey, CASE WHEN strpos(t, ' (') > 0 AND ends_with(t, ')') THEN substr(t, 1, strpos(t, ' (') - 1) ELSE t END AS impact, CASE WHEN strpos(t, ' (') > 0 AND ends_with(t, ')') THEN substr(t, strpos(t, ' (') + 2, length(t) - strpos(t, ' (') - 2) END AS note FROM {_NOTED}")
def split_note_suffix(spark, sf_dir):  # noqa: ANN001, ANN201
    """F20, G15."""
    text = F.when(F.col("p_size") % 3 == 0, F.concat("p_type", F.lit(" ("), "p_name", F.lit(" (x))"))).when(F.col("p_size") % 3 == 1, F.concat("p_type", F.lit(" ("), "p_name")).otherwise(F.col("p_type"))
    return _t(spark, sf_dir, "part").select("p_partkey", scalar.split_note(text).alias("s")).select("p_partkey", "s.impact", "s.note")


@query("SELECT DISTINCT doc_id, m AS mention FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+\\.[0-9]+@mail[0-9]')) AS m FROM documents)")
def mention_extraction(spark, sf_dir):  # noqa: ANN001, ANN201
    """F37, G30."""
    return _t(spark, sf_dir, "documents").select("doc_id", F.explode(scalar.mentions(F.col("text"), r"[a-z]+\.[0-9]+@mail[0-9]")).alias("mention"))


@query("WITH b AS (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders), w AS (SELECT unnest(generate_series(lo, hi - INTERVAL 1 MICROSECOND, INTERVAL 120 DAY)) AS start, hi FROM b) SELECT strftime(start, '%Y-%m-%dT%H:%M:%S') AS start, strftime(least(start + INTERVAL 120 DAY, hi), '%Y-%m-%dT%H:%M:%S') AS stop FROM w")
def date_windows(spark, sf_dir):  # noqa: ANN001, ANN201
    """S6, F9."""
    bounds = _t(spark, sf_dir, "orders").agg(F.min("o_orderdate").cast("timestamp").alias("lo"), F.max("o_orderdate").cast("timestamp").alias("hi"))
    fmt = "yyyy-MM-dd'T'HH:mm:ss"
    return bounds.select(F.explode(scalar.windows_column(F.col("lo"), F.col("hi"))).alias("w")).select(F.date_format("w.start", fmt).alias("start"), F.date_format("w.stop", fmt).alias("stop"))


@query("SELECT vec_id, array_to_string(list_distinct_keep, ',') AS items FROM (SELECT vec_id, [x FOR x, i IN l IF list_position(l, x) = i] AS list_distinct_keep FROM (SELECT vec_id, [label, vec_id % 10, label, 3, vec_id % 7] AS l FROM embeddings))")
def array_union_keep_first(spark, sf_dir):  # noqa: ANN001, ANN201
    """U2, F26, F12."""
    a, b = F.array(F.col("label").cast("string"), (F.col("vec_id") % 10).cast("string")), F.array(F.col("label").cast("string"), F.lit("3"), (F.col("vec_id") % 7).cast("string"))
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.array_join(scalar.keep_first(F.concat(a, b)), ",").alias("items"))


@query("SELECT c_custkey, 'CWE-'||regexp_extract(mixed, '[0-9]+') AS cwe FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_custkey::VARCHAR WHEN 1 THEN ' cwe-'||c_custkey ELSE 'CWE-'||c_custkey||' ' END AS mixed FROM customer)")
def id_normalization(spark, sf_dir):  # noqa: ANN001, ANN201
    """F38, E13, F13."""
    key = F.col("c_custkey").cast("string")
    mixed = F.when(F.col("c_custkey") % 3 == 0, key).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" cwe-"), key)).otherwise(F.concat(F.lit("CWE-"), key, F.lit(" ")))
    return _t(spark, sf_dir, "customer").select("c_custkey", scalar.normalized_id(mixed, "CWE").alias("cwe"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((extract(millisecond FROM ts)::INT % 1000)::VARCHAR, 3, '0') || 'Z' AS stamp FROM events")
def timestamp_format(spark, sf_dir):  # noqa: ANN001, ANN201
    """parsed and formatted timestamps."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return _t(spark, sf_dir, "events").select("event_id", scalar.format_timestamp(scalar.parse_timestamp(F.concat(text, F.lit("Z")))).alias("stamp"))


@query("SELECT event_id, CASE WHEN trim(c) IN ('', 'None') THEN NULL ELSE c END AS channel FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'None' WHEN 'view' THEN '  ' ELSE ' '||event_type END AS c FROM events)")
def sentinel_null(spark, sf_dir):  # noqa: ANN001, ANN201
    """P12."""
    raw = F.when(F.col("event_type") == "click", "None").when(F.col("event_type") == "view", "  ").otherwise(F.concat(F.lit(" "), "event_type"))
    return _t(spark, sf_dir, "events").select("event_id", scalar.clean_channel(raw).alias("channel"))


@query("SELECT event_type, coalesce(map {'click': 'interaction', 'view': 'interaction', 'purchase': 'sale'}[event_type], event_type) AS label, count(*) AS n FROM events GROUP BY ALL")
def label_override(spark, sf_dir):  # noqa: ANN001, ANN201
    """P5: labels by a literal table."""
    label = F.coalesce(scalar.mapped(F.col("event_type"), {"click": "interaction", "view": "interaction", "purchase": "sale"}), F.col("event_type"))
    return _t(spark, sf_dir, "events").groupBy("event_type", label.alias("label")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, role, '[' || string_agg('''' || turn::VARCHAR || '''', ', ' ORDER BY turn) || ']' AS listed FROM conversations GROUP BY conv_id, role")
def list_seed_text(spark, sf_dir):  # noqa: ANN001, ANN201
    """F39, F30."""
    turns = _t(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.transform(F.array_sort(F.collect_list("turn")), lambda t: t.cast("string")).alias("turns"))
    return turns.select("conv_id", "role", identity.python_list(F.col("turns")).alias("listed"))


@query("SELECT doc_id, sha256('{\"lang\": \"'||lang||'\", \"n_chars\": '||n_chars||', \"source\": \"'||source||'\"}') AS hash FROM documents")
def content_digest(spark, sf_dir):  # noqa: ANN001, ANN201
    """the hash of a record's canonical JSON."""
    return _t(spark, sf_dir, "documents").select("doc_id", identity.content_hash(F.to_json(F.struct("source", "n_chars", "lang"))).alias("hash"))


@query("SELECT event_id, sha256('{\"a\": {\"b\": [1, \"x\"], \"z\": '||user_id||'}, \"k\": '||(props->>'$.k')||'}') AS hash FROM events")
def canonical_json_hash(spark, sf_dir):  # noqa: ANN001, ANN201
    """keys in any order and any spacing give one hash."""
    user, k = F.col("user_id").cast("string"), F.get_json_object("props", "$.k")
    one = F.concat(F.lit('{"k":'), k, F.lit(' ,  "a":{"z":'), user, F.lit(',"b":[1,"x"]}}'))
    other = F.concat(F.lit('{"a": {"b": [ 1, "x" ], "z": '), user, F.lit('},\n"k": '), k, F.lit("}"))
    return _t(spark, sf_dir, "events").select("event_id", identity.content_hash(F.when(F.col("event_id") % 2 == 0, one).otherwise(other)).alias("hash"))


@query("SELECT page_id, url||chr(10)||chr(10)||'- '||url||CASE WHEN h = '' THEN '' ELSE chr(10)||'- '||h END AS text FROM (SELECT page_id, url, regexp_replace(html, '^\\s+|\\s+$', '', 'g') AS h FROM pages)")
def markup_flatten(spark, sf_dir):  # noqa: ANN001, ANN201
    """paragraphs, list items, elements without text."""
    markup = F.struct(F.col("url").alias("p"), F.lit("x").alias("br"), F.struct(F.array("url", "html").alias("li")).alias("ul"))
    return _t(spark, sf_dir, "pages").select("page_id", rich_text.flatten_markup(F.to_json(markup)).alias("text"))


@query("SELECT p_brand AS id, min(o) AS created, max(o) AS modified, count(*) AS n, arg_max(v, o) AS newest FROM (SELECT p_brand, p_partkey AS o, (p_size || '.' || p_partkey) AS v FROM part) GROUP BY p_brand")
def collection_index(spark, sf_dir):  # noqa: ANN001, ANN201
    """K9, A19, O5, O6."""
    rows = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.col("p_partkey").alias("created"), F.col("p_partkey").alias("modified"), F.concat(F.col("p_partkey"), F.lit("."), F.col("p_size")).alias("version"), F.lit("u").alias("url"))
    return sinks.collection_index(rows).select("id", "created", "modified", F.size("versions").cast("bigint").alias("n"), F.concat(F.split(F.col("versions")[0]["version"], "\\.")[1], F.lit("."), F.split(F.col("versions")[0]["version"], "\\.")[0]).alias("newest"))


@query(f"SELECT source_ref AS subject_id, 'placed' AS predicate, target_ref AS object_id, 'orders' AS source, '{{\"id\":\"'||id||'\",\"priority\":\"'||priority||'\"}}' AS properties FROM ({_PLACED})")
def loader_contract(spark, sf_dir):  # noqa: ANN001, ANN201
    """Subject, predicate, object, source, and all other fields as JSON."""
    return links.kg_relationships(_placed(spark, sf_dir), "orders")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS place FROM orders")
def bundle_sort(spark, sf_dir):  # noqa: ANN001, ANN201
    """Places in the bundle order, by ranges of it."""
    objects = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("type"), F.lit("n").alias("name"), F.col("o_orderkey").alias("id"))
    return sinks.in_order(objects, sinks.bundle_order("attack")).select("o_orderkey", "place")


@query("SELECT (SELECT count(*) FROM events) AS rows, NOT EXISTS (SELECT * FROM (SELECT * FROM events ORDER BY value) EXCEPT ALL SELECT * FROM events) AS same_in_any_order, EXISTS (SELECT * FROM events EXCEPT ALL SELECT * FROM events WHERE event_id > 0) AS differs_without_a_row")
def table_equality(spark, sf_dir):  # noqa: ANN001, ANN201
    """Order-insensitive equality of states."""
    events = _t(spark, sf_dir, "events")
    same, fewer = state.same_state(events, events.orderBy("value")), state.same_state(events, events.where("event_id > 0"))
    return events.agg(F.count("*").alias("rows")).select("rows", F.lit(same).alias("same_in_any_order"), F.lit(not fewer).alias("differs_without_a_row"))