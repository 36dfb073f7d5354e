"""State algebra, recipes, sources and streaming."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from graphloom import sync
from graphloom.functions import identity, rich_text, scalar
from graphloom.operators import graph, recipes, state
from graphloom.sources import bundles, rest, sinks
from graphloom.streaming import incremental

S = "id string, modified timestamp, payload string, pos int"


def ts(day):
    return datetime(2020, 1, day)


def states(spark):
    old = spark.createDataFrame([("a", ts(1), "a1", 0), ("b", ts(2), "b2", 1), ("c", ts(3), "c3", 2), ("e", ts(1), "e1", 3)], S)
    new = spark.createDataFrame([("a", ts(1), "A1", 0), ("b", ts(1), "b1", 1), ("c", ts(4), "c4", 2), ("d", ts(1), "d1", 3)], S)
    return old, new


def test_merge_delta_and_diff(spark):
    old, new = states(spark)
    merged = state.merge_latest(old, new, "id", "modified")
    assert {r.id: r.payload for r in merged.collect()} == {"a": "A1", "b": "b2", "c": "c4", "d": "d1", "e": "e1"}
    assert state.same_state(state.merge_latest(merged, new, "id", "modified"), merged)
    assert {r.id for r in state.delta(old, new, "id", "modified").collect()} == {"c", "d"}
    assert {(r.id, r.status) for r in state.diff(old, new, "id", "modified").collect()} == {("c", "modified"), ("d", "added"), ("e", "removed")}
    rows = spark.createDataFrame([("a", ts(1), "x", 0), ("a", ts(1), "y", 1), ("", ts(9), "z", 2), (None, ts(9), "z", 3), ("a", None, "n", 4)], S)
    assert [(r.id, r.payload) for r in state.latest_wins(rows, "id", "modified", "pos").collect()] == [("a", "y")]
    assert state.latest_wins(rows.limit(0), "id", "modified", "pos").count() == 0


def recipe_graph(spark):
    kinds = {"G": "intrusion-set", "C": "campaign", "T": "tool", "M": "malware", "X": "attack-pattern", "Y": "attack-pattern", "Z": "attack-pattern", "W": "attack-pattern"}
    ids = {n: f"{k}--{n}" for n, k in kinds.items()}
    refs = [("mitre-attack", "T1")]
    objects = spark.createDataFrame(
        [(ids[n], k, n, [n.lower()], refs if n == "X" else [], [("mitre-attack", "impact"), ("other", "x")] if n == "X" else [], ["Linux"], n == "Y", f"about {n}", "2020-01-01T00:00:00Z", "2021-01-01T00:00:00Z", True if n == "Z" else None, True if n == "W" else None, None) for n, k in kinds.items()],
        "id string, type string, name string, aliases array<string>, external_references array<struct<source_name string, external_id string>>, kill_chain_phases array<struct<kill_chain_name string, phase_name string>>, x_mitre_platforms array<string>, x_mitre_is_subtechnique boolean, description string, created string, modified string, revoked boolean, x_mitre_deprecated boolean, tactic_refs array<string>",
    )
    links = [("C", "attributed-to", "G"), ("G", "uses", "T"), ("G", "uses", "M"), ("T", "uses", "X"), ("C", "uses", "Y"), ("Z", "revoked-by", "X"), ("G", "uses", "Z"), ("G", "uses", "W"), ("Y", "subtechnique-of", "X")]
    rels = spark.createDataFrame([(f"relationship--{i}", ids[a], k, ids[b], None, None) for i, (a, k, b) in enumerate(links)], "id string, source_ref string, relationship_type string, target_ref string, revoked boolean, x_mitre_deprecated boolean")
    return ids, objects, rels


def test_recipes(spark):
    ids, objects, rels = recipe_graph(spark)
    pairs = lambda df: {(r.id, r.related_id) for r in df.collect()}
    names = lambda df: {r.name for r in df.collect()}
    assert pairs(recipes.relation(objects, rels, "group uses software")) == {(ids["G"], ids["T"]), (ids["G"], ids["M"])}
    assert pairs(recipes.relation(objects, rels, "group uses technique")) == {(ids["G"], ids["Y"]), (ids["G"], ids["W"])}
    assert pairs(recipes.relation(objects, rels, "group uses technique", reverse=True)) == {(ids["Y"], ids["G"]), (ids["W"], ids["G"]), (ids["Z"], ids["G"])}  # only the far end is checked
    assert pairs(recipes.relation_path(objects, rels, "group uses software", "software uses technique")) == {(ids["G"], ids["X"])}
    assert pairs(recipes.relation(objects, rels, "subtechnique of technique")) == {(ids["Y"], ids["X"])} and pairs(recipes.relation(objects, rels, "subtechnique of technique", reverse=True)) == {(ids["X"], ids["Y"])}
    assert [r.id for r in recipes.revoking_object(objects, rels, ids["Z"]).collect()] == [ids["X"]]
    assert names(recipes.by_attack_id(objects, "T1")) == {"X"} == names(recipes.by_tactic(objects, "impact")) == names(recipes.by_tactic(objects, "x"))
    assert names(recipes.techniques(objects, "subtechniques")) == {"Y"} and len(names(recipes.techniques(objects))) == 4
    assert names(recipes.by_content(objects, "ABOUT z")) == {"Z"} and names(recipes.by_alias(objects, "g")) == {"G"} and names(recipes.software(objects)) == {"T", "M"}
    assert names(recipes.active(recipes.techniques(objects))) == {"X", "Y"} and recipes.since(objects, "2021-01-01").count() == 0 and recipes.since(objects, "2020-12-31").count() == 8
    assert recipes.by_name(objects, "tool", "T").count() == recipes.by_stix_id(objects, ids["T"]).count() == 1
    assert len(recipes.collected(recipes.relation(objects, rels, "group uses software")).first().related) == 2
    with pytest.raises(ValueError, match="unknown option"):
        recipes.techniques(objects, "some")


def test_identifiers_and_text(spark):
    import uuid

    seeds = ["", "a", "é\U0001f600", "x" * 200]
    got = spark.createDataFrame([(s,) for s in seeds], "s string").select(identity.uuid5(F.col("s")).alias("u")).collect()
    assert [r.u for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_URL, s)) for s in seeds]
    identity.register(spark)
    row = spark.sql("SELECT graph_uuid5('a') u, graph_slug(' May-Modify! ') s, graph_snake_case('baseScoreOf') c").first()
    assert (row.u, row.s, row.c) == (str(uuid.uuid5(uuid.NAMESPACE_URL, "a")), "may_modify", "base_score_of")
    lists = [["A", "it's"], ['q"q', "b\\"], []]
    got = spark.createDataFrame([(x,) for x in lists], "l array<string>").select(identity.python_list(F.col("l")).alias("t")).collect()
    assert [r.t for r in got] == [str(x) for x in lists]
    assert rich_text.plain_text([{"p": [" a ", {"b": "c"}], "style": "s"}, 3, None, ""]) == "a\nc\n3"
    assert scalar.date_windows(ts(3), ts(3)) == [] and len(scalar.date_windows(datetime(2020, 1, 1), datetime(2021, 1, 1))) == 4
    with pytest.raises(Exception, match="unreadable timestamp"):
        spark.range(1).select(scalar.nvd_timestamp(F.lit("yesterday"))).collect()


PAGES = {}


def fake_get(url, headers):
    import urllib.parse

    assert "User-Agent" in headers

    query = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(url).query))
    if "collection" in url:
        page = int(query.get("next", 0))
        return json.dumps({"objects": [{"n": page, "after": query.get("added_after")}], "more": page < 2, "next": str(page + 1)}).encode()
    start, size = int(query["startIndex"]), int(query["resultsPerPage"])
    return json.dumps({"totalResults": 5, "vulnerabilities": [{"n": i} for i in range(start, min(5, start + size))]}).encode()


def test_replayed_pages_do_not_read_the_whole_listing_again(tmp_path, monkeypatch):
    from graphloom.sources import replay

    (tmp_path / "listing").mkdir()
    for i, part in enumerate((range(0, 4), range(4, 4), range(4, 11))):
        (tmp_path / "listing" / f"part-{i:05d}.txt").write_text("".join(f'{{"k":{k}}}\n' for k in part))
    opened = []
    monkeypatch.setattr(replay, "open", lambda *a, **k: (opened.append(a[0]), open(*a, **k))[1], raising=False)
    feed = [json.loads(replay.get(f"replay:{tmp_path}?startIndex={s}&resultsPerPage=3")) for s in range(0, 12, 3)]
    assert [[x["k"] for x in p["vulnerabilities"]] for p in feed] == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10]] and {p["totalResults"] for p in feed} == {11}
    pages, asked = [], ""
    while asked is not None:
        pages.append(json.loads(replay.get(f"replay:file:{tmp_path}/objects?limit=5{asked}")))
        asked = f"&next={pages[-1]['next']}" if pages[-1]["more"] else None
    assert [[x["k"] for x in p["objects"]] for p in pages] == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9], [10]]
    assert len(opened) <= 3 + 4  # each counted once, and each read once for a listing


def test_paged_sources(spark, monkeypatch, tmp_path):
    rest.register(spark)
    module = tmp_path / "graphloom_fake_transport.py"
    import inspect

    module.write_text("import json\n" + inspect.getsource(fake_get))
    spark.sparkContext.addPyFile(str(module))
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setenv("PYTHONPATH", str(tmp_path))
    get = "graphloom_fake_transport:fake_get"
    reader = rest._OffsetReader({"url": "http://feed", "pageSize": "2", "transport": get})
    assert [json.loads(raw)["n"] for p in reader.partitions() for _, raw in reader.read(p)] == [0, 1, 2, 3, 4]
    few = rest._OffsetReader({"url": "http://feed", "pageSize": "2", "maxPages": "1", "transport": get})
    assert [json.loads(raw)["n"] for p in few.partitions() for _, raw in few.read(p)] == [0, 1]
    wide = rest._OffsetReader({"url": "http://feed", "pageSize": "2", "parallel": "2", "transport": get})
    parts = wide.partitions()
    assert [[json.loads(raw)["n"] for _, raw in wide.read(p)] for p in parts] == [[0, 1, 4], [2, 3]]
    assert rest._OffsetReader({"url": "u", "parallel": "90"}).parallel == 4
    cursor = rest._CursorReader({"url": "http://collection", "addedAfter": "t", "transport": get})
    assert [json.loads(raw) for _, raw in cursor.read(cursor.partitions()[0])] == [{"n": 0, "after": "t"}, {"n": 1, "after": None}, {"n": 2, "after": None}]
    slept, now = [], [0.0]
    window = rest.SlidingWindow(2, 30, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(3):
        window.wait()
    assert slept == [30.0]
    tries = []

    def broken():
        tries.append(1)
        raise ValueError("no JSON")

    with pytest.raises(rest.FetchError):
        rest.Backoff(3, 1, 2, unreadable=True).call(broken, slept.append)
    assert len(tries) == 4 and slept[1:] == [1, 2, 2]
    with pytest.raises(rest.FetchError):  # the feed's answers are not asked for again
        rest.Backoff().call(broken, slept.append)
    assert len(tries) == 5
    import urllib.error

    def refused():
        tries.append(1)
        raise urllib.error.HTTPError("u", 429, "later", None, None)

    with pytest.raises(rest.FetchError):
        rest.Backoff().call(refused, slept.append)
    assert len(tries) == 11 and slept[-5:] == [5, 10, 20, 40, 60]


def test_every_request_of_the_feed_waits_and_bears_the_key(monkeypatch):
    import urllib.error

    calls, clock = [], [0.0]

    def get(url, headers):
        calls.append((clock[0], headers.get("apiKey")))
        if len(calls) == 2:
            raise urllib.error.HTTPError(url, 429, "later", None, None)
        return json.dumps({"totalResults": 70, "vulnerabilities": [{}]}).encode()

    monkeypatch.setattr(rest, "_transport", lambda name: get)
    monkeypatch.setattr(rest.SlidingWindow.__init__, "__defaults__", (lambda: clock[0], lambda s: clock.__setitem__(0, clock[0] + s)))
    monkeypatch.setattr(rest.Backoff._tried, "__defaults__", None)
    monkeypatch.setattr(rest.Backoff.call, "__defaults__", (lambda s: None,))
    for key, limit in ((None, 5), ("k", 50)):
        calls.clear()
        clock[0] = 0.0
        reader = rest._OffsetReader({"url": "u", "pageSize": "1", **({"apiKey": key} if key else {})})
        assert sum(1 for p in reader.partitions() for _ in reader.read(p)) == 70
        assert len(calls) == 71 and {k for _, k in calls} == {key}
        times = [t for t, _ in calls]
        assert all(b - a >= 30 for a, b in zip(times, times[limit:]))


def test_streaming_and_incremental_runs(spark, tmp_path):
    schema = "id string, modified timestamp, payload string, pos int"
    landed = tmp_path / "landed"
    old, new = states(spark)
    old.write.parquet(str(landed))
    path, checkpoint = str(tmp_path / "state"), str(tmp_path / "checkpoint")
    for batch in (None, new):
        if batch is not None:
            batch.write.mode("append").parquet(str(landed))
        incremental.synchronise(spark.readStream.schema(schema).parquet(str(landed)), path, checkpoint, schema, "id", "modified", "pos").awaitTermination()
    want = {"a": "A1", "b": "b2", "c": "c4", "d": "d1", "e": "e1"}
    assert {r.id: r.payload for r in incremental.current(spark, path, schema).collect()} == want
    root = str(tmp_path / "sync")
    with pytest.raises(incremental.MissingCursor):
        incremental.run_incremental(spark, new, root, "id", "modified", "t1", schema)
    incremental.run_incremental(spark, old, root, "id", "modified", "t1", schema, full=True)
    dry = incremental.run_incremental(spark, new, root, "id", "modified", "t2", schema, dry_run=True)
    assert dry["diff"] == {"added": 1, "modified": 1, "removed": 0} and dry["ids"] == {"added": ["d"], "modified": ["c"], "removed": []} and sinks.read_manifest(spark, f"{root}/manifest")["last_fetch"] == "t1" and not sinks.exists(spark, f"{root}/delta")
    done = incremental.run_incremental(spark, new, root, "id", "modified", "t2", schema)
    assert done["files"] == {"delta": "created", "latest": "modified"} and {r.id: r.payload for r in spark.read.parquet(f"{root}/latest").collect()} == want
    assert sinks.summary_line("cve", "incremental", done["diff"], done["files"]) == "[cve] incremental: +1 ~1 -0 | files: delta=created, latest=modified"
    sinks.archive(old, f"{root}/history", "1.0")
    sinks.archive(new, f"{root}/history", "1.1")
    assert spark.read.parquet(f"{root}/history").count() == 8
    assert bundles.state(spark, f"{root}/none", schema).count() == 0
    assert sinks.overlay({"domains": {"a": 1, "b": 1}}, {"a": 2})["domains"] == {"a": 2, "b": 1}


def test_closure_survives_cycles(spark):
    steps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source_ref string, target_ref string")
    got = {(r.node, r.hops) for r in graph.reachable(steps, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    steps.createOrReplaceTempView("steps")
    spark.createDataFrame([("a",)], "node string").createOrReplaceTempView("starts")
    assert {r.node for r in spark.sql(graph.reachable_sql("steps", "starts")).collect()} == {"a", "b", "c", "d"}


def test_reachable_follows_long_chains(spark):
    steps = spark.range(36).coalesce(1).select(F.col("id").cast("string").alias("source_ref"), (F.col("id") + 1).cast("string").alias("target_ref"))
    starts = spark.createDataFrame([("0",)], "node string").coalesce(1)
    got = {(r.node, r.hops) for r in graph.reachable(steps, starts).collect()}
    assert got == {(str(i), i) for i in range(37)}


def test_text_times_compare_by_value(spark):
    rows = [("a", "2020-01-01T00:00:00Z", None, 1), ("a", "2020-01-01T00:00:00.500Z", None, 0), ("b", "", "2020-01-02T01:00:00+02:00", 0), ("b", None, "2020-01-01T23:30:00Z", 1), ("c", None, None, 0)]
    df = spark.createDataFrame(rows, "id string, modified string, created string, pos int")
    got = {r.id: r.pos for r in state.latest_wins(df, "id", ("modified", "created"), "pos").collect()}
    assert got == {"a": 0, "b": 1, "c": 0}
    old = spark.createDataFrame([("a", "2020-01-01T00:00:00.4Z", None, 0), ("b", None, "2020-01-01T00:00:00Z", 0), ("c", "2020-01-01T00:00:00Z", None, 0)], df.schema)
    new = state.latest_wins(df, "id", ("modified", "created"), "pos")
    now = F.lit("2030-01-01").cast("timestamp")
    assert {r.id for r in state.delta(old, new, "id", ("modified", "created")).collect()} == {"a", "b"}
    assert {r.id for r in state.delta(old, new, "id", ("modified", "created"), now).collect()} == {"a", "b", "c"}
    (listed,) = state.listed(state.diff(old, new, "id", ("modified", "created"), now=now)).collect()
    assert (listed.added, listed.modified, listed.removed) == ([], ["a", "b", "c"], [])
    assert [r.modified for r in state.merge_latest(old, new, "id", "modified").where("id = 'a'").collect()] == ["2020-01-01T00:00:00.500Z"]


def test_helper_names_do_not_clash(spark):
    df = spark.createDataFrame([("a", 1, "x", 9, 9, 9)], "key string, value int, own string, was int, side int, `a.b` int")
    ids = spark.createDataFrame([("a", "A")], "key string, value string")
    assert graph.strict_lookup(df, "key", ids, "key", "value", "out", "k").collect()[0].asDict() == {"key": "a", "value": 1, "own": "x", "was": 9, "side": 9, "a.b": 9, "out": "A"}
    assert tuple(graph.lenient_remap(df, "key", ids, "key", "value").first()) == ("A", 1, "x", 9, 9, 9)
    assert tuple(graph.both_endpoints(df, ids, "key", "value", "key", "key").collect()) == ()
    assert tuple(graph.composite_lookup(df, ["key", "value"], df, ["key", "value"], "own", "out", "k").first())[-1] == "x"
    assert tuple(state.merge_latest(df, df, "key", "value").first()) == tuple(state.delta(df.limit(0), df, "key", "value").first()) == tuple(df.first())
    assert state.carry_first_seen(df, df, "key", "was", F.lit(0)).first()["was"] == 9


def test_places_in_order_over_ranges(spark):
    df = spark.range(5_000).select((F.col("id") * 7919 % 5_000).alias("a"), F.when(F.col("id") % 3 == 0, "t").otherwise(F.col("id").cast("string")).alias("type"))
    got = [(r.type, r.a, r.place) for r in sinks.in_order(df, [F.col("type"), F.col("a")]).collect()]
    assert [p for _, _, p in sorted(got)] == list(range(1, 5_001))
    assert sinks.in_order(df.limit(0), [F.col("type")]).count() == 0


def test_a_lost_driver_leaves_a_state(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path + ".old")  # between the two renames
    assert sinks.recover(spark, path) and spark.read.parquet(path).count() == 3
    assert sinks.tracked_write(spark.range(4), path) == "modified" and not sinks.exists(spark, path + ".old")


def test_env_file(tmp_path):
    file = tmp_path / ".env"
    file.write_text("# note\nA = \"x\"\n\nB='y z'\nset=new\nnothing\n")
    environ = {"set": "old"}
    assert sync.load_env(str(file), environ) == {"set": "old", "A": "x", "B": "y z"} == sync.load_env(str(tmp_path / "none"), environ)
