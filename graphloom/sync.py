"""The crawl: full and incremental runs of the five sources into keyed states that `python -m graphloom graph` reads.

A state is a table (key, created, modified, content_hash, first_seen, pos, raw) with a delta and a manifest beside it. The vulnerability
feed has one for each year, so that a run rewrites only years with changes; the adversary and defence catalogs one for each domain.
The feed and the collections are read by Spark data sources; the other sources are single documents of some megabytes.
"""

from __future__ import annotations

import json
import os
import urllib.parse
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import identity, scalar
from graphloom.operators.graph import materialize
from graphloom.plans import cve
from graphloom.sources import bundles, rest, sinks
from graphloom.streaming.incremental import MissingCursor, cursor, run_incremental

SOURCES = ("cve", "cwe", "capec", "attack", "defend")
SCHEMA = "key string, created string, modified string, content_hash string, first_seen string, pos bigint, raw string"

#: Fixed by the services: addresses, the collections' titles by folder, and the defence catalog's paths by folder.
URLS = {
    "cve": "https://services.nvd.nist.gov/rest/json/cves/2.0",
    "cwe": "https://cwe.mitre.org/data/xml/cwec_latest.xml.zip",
    "capec": "https://raw.githubusercontent.com/mitre/cti/master/capec/2.1/stix-capec.json",
    "attack": "https://attack-taxii.mitre.org/api/v21/",
    "defend": "https://d3fend.mitre.org",
}
COLLECTIONS = {"enterprise": "Enterprise ATT&CK", "mobile": "Mobile ATT&CK", "ics": "ICS ATT&CK"}
DEFEND = {
    "techniques": "/api/technique/all.json", "tactics": "/api/tactic/all.json", "artifacts": "/api/dao/artifacts.json", "weaknesses": "/api/weakness/all.json",
    "offensive-techniques": "/api/offensive-technique/all.json", "mappings": "/api/ontology/inference/d3fend-full-mappings.json",
}
DEFEND_VERSION = "/api/version.json"


@dataclass
class Options:
    """What a run may be told. transport names a function of (url, headers); domains chooses among a source's parts."""

    full: bool = False
    dry_run: bool = False
    domains: tuple[str, ...] = ()
    max_pages: int = 0
    page_size: int = 0
    api_key: str | None = None
    agent: str = "graphloom"
    transport: str = rest._HTTP
    urls: Mapping[str, str] = field(default_factory=dict)
    now: datetime | None = None
    feed: Mapping[str, str] = field(default_factory=dict)

    def url(self, source: str) -> str:
        return self.urls.get(source, URLS[source])

    def chosen(self, known: Iterable[str]) -> list[str]:
        return [d for d in known if not self.domains or d in self.domains]

    def stamp(self) -> str:
        return (self.now or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def load_env(path: str, environ: dict[str, str] | None = None) -> dict[str, str]:
    """NAME=value lines of a file into the environment, without replacing what is set; comments, blank lines and quotes around values go. A missing file is none."""
    environ = os.environ if environ is None else environ
    if os.path.exists(path):
        with open(path, encoding="utf-8") as lines:
            for line in map(str.strip, lines):
                name, assigned, value = line.partition("=")
                if assigned and not line.startswith("#") and name.strip():
                    environ.setdefault(name.strip(), value.strip().strip("\"").strip("'"))
    return environ


def rows(raw: DataFrame) -> DataFrame:
    """(pos, raw) of objects with id, created and modified as incoming rows."""
    of = lambda name: F.get_json_object("raw", f"$.{name}").alias(name)
    return raw.select(of("id"), of("created"), of("modified"), "pos", "raw").select(F.col("id").alias("key"), "created", "modified", F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast("string").alias("first_seen"), F.col("pos").cast("bigint").alias("pos"), "raw")


def _document(spark: SparkSession, objects: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(objects)), "pos bigint, raw string")


def _cve(spark: SparkSession, root: str, o: Options) -> dict:
    """By year; an incremental run asks for windows of at most 120 days since the last fetch. The source's cursor lies in its own manifest."""
    manifest = sinks.read_manifest(spark, f"{root}/manifest")
    reader = lambda extra: spark.read.format("offset_pages").options(url=o.url("cve"), transport=o.transport, maxPages=str(o.max_pages), userAgent=o.agent, **({"pageSize": str(o.page_size)} if o.page_size else {}), **({"apiKey": o.api_key} if o.api_key else {}), **o.feed, **extra).load()
    if o.full:
        pages = [reader({})]
    else:
        begin = datetime.fromisoformat(cursor(manifest).replace("Z", "+00:00"))
        text = lambda t: t.strftime("%Y-%m-%dT%H:%M:%S.000Z")
        end = datetime.fromisoformat(o.stamp().replace("Z", "+00:00"))
        pages = [reader({"query": urllib.parse.urlencode({"lastModStartDate": text(a), "lastModEndDate": text(b)})}) for a, b in scalar.date_windows(begin, end)]
    landed = None
    for page in pages:  # one window after the other: the quota is the client's
        page = materialize(page, "feed")
        landed = page if landed is None else landed.unionByName(page)
    if landed is None:
        landed = spark.createDataFrame([], "pos bigint, raw string")
    made = materialize(cve.bundle_objects(landed).withColumn("pos", F.monotonically_increasing_id()), "objects")
    years = [r.year for r in made.select("year").distinct().orderBy("year").collect()]  # some thirty
    if o.full and not o.dry_run:
        _drop_others(spark, f"{root}/records", {str(y) for y in years})
    parts = {str(y): run_incremental(spark, rows(made.where(F.col("year") == y)), f"{root}/records/{y}", "key", ("modified", "created"), o.stamp(), SCHEMA, o.full, o.dry_run, False, "pos") for y in years}
    return _finish(spark, root, manifest, parts, o)


def _drop_others(spark: SparkSession, root: str, kept: set[str]) -> None:
    """Parts that a full run no longer has."""
    if sinks.exists(spark, root):
        p, fs = sinks._fs(spark, root)
        for s in fs.listStatus(p):
            if s.getPath().getName() not in kept:
                fs.delete(s.getPath(), True)


def _cwe(spark: SparkSession, root: str, o: Options) -> dict:
    content = rest.Backoff(rest.CATALOG.retries, rest.CATALOG.first, rest.CATALOG.longest, ()).bytes(lambda: rest._transport(o.transport)(o.url("cwe"), {"User-Agent": o.agent}))
    found = bundles.catalog_records(content, o.stamp())
    version = {"version": found[0][0], "date": found[0][1]} if found else {}
    return _whole(spark, root, rows(_document(spark, [raw for _, _, raw in found])), o, version)


def _capec(spark: SparkSession, root: str, o: Options) -> dict:
    bundle = rest.fetch(o.url("capec"), o.transport, agent=o.agent)
    if not isinstance(bundle, dict) or not isinstance(bundle.get("objects"), list):
        raise bundles.SourceError("the bundle has no list of objects")
    objects = [x for x in bundle["objects"] if isinstance(x, dict)]
    version = next(({"version": x["x_capec_version"]} for x in objects if x.get("x_capec_version")), {})
    return _whole(spark, root, rows(_document(spark, [json.dumps(x) for x in objects])), o, version)


def _whole(spark: SparkSession, root: str, incoming: DataFrame, o: Options, extra: Mapping) -> dict:
    """A catalog that is published whole: an incremental run needs a full one before it, and tells what has gone."""
    manifest = sinks.read_manifest(spark, f"{root}/manifest")
    if not o.full:
        cursor(manifest)
    part = run_incremental(spark, incoming, root, "key", ("modified", "created"), o.stamp(), SCHEMA, o.full, o.dry_run, True, "pos", authoritative=True)
    part |= extra
    sinks.write_manifest(spark, f"{root}/manifest", part, o.dry_run)
    return part


def _attack(spark: SparkSession, root: str, o: Options) -> dict:
    """By domain; without an earlier run an incremental one fetches all."""
    manifest = sinks.read_manifest(spark, f"{root}/manifest")
    listed = rest.fetch(o.url("attack").rstrip("/") + "/collections/", o.transport, rest.ONCE, o.agent)
    index = spark.createDataFrame([(str(c.get("id")), str(c.get("title"))) for c in listed.get("collections", [])], "id string, title string")
    parts = {}
    for domain in o.chosen(COLLECTIONS):
        picked = bundles.version_picks(index, COLLECTIONS[domain]).first().id
        path = f"{root}/{domain}"
        after = None if o.full else cursor(sinks.read_manifest(spark, f"{path}/manifest"), required=False)
        options = {"url": f"{o.url('attack').rstrip('/')}/collections/{picked}/objects/", "transport": o.transport, "maxPages": str(o.max_pages), **({"addedAfter": after} if after else {}), **({"limit": str(o.page_size)} if o.page_size else {})}
        landed = materialize(spark.read.format("cursor_pages").options(**options).load(), "collection")
        parts[domain] = run_incremental(spark, rows(landed), path, "key", ("modified", "created"), o.stamp(), SCHEMA, o.full, o.dry_run, False, "pos")
    return _finish(spark, root, manifest, parts, o)


def _defend(spark: SparkSession, root: str, o: Options) -> dict:
    """By domain, told apart by content; entries of domains that are not in this run stay in the manifest."""
    manifest = sinks.read_manifest(spark, f"{root}/manifest")
    base = o.url("defend").rstrip("/")
    version = rest.fetch(base + DEFEND_VERSION, o.transport, agent=o.agent)
    if not isinstance(version, dict):
        raise bundles.SourceError("the version is not an object")
    parts = {}
    for domain in o.chosen(DEFEND):
        payload = json.dumps(rest.fetch(base + DEFEND[domain], o.transport, agent=o.agent))
        landed = bundles.payload(spark.createDataFrame([(payload,)], "payload string"))
        own = F.get_json_object("raw", "$['@id']")
        missing = F.raise_error(F.concat(F.lit(f"no @id in {domain}: "), F.col("raw"))).cast("string")
        digest = identity.record_hash(F.col("raw"))
        key = digest if domain == "mappings" else F.coalesce(F.nullif(own, F.lit("")), missing)
        none = F.lit(None).cast("string")
        incoming = landed.select(key.alias("key"), none.alias("created"), none.alias("modified"), digest.alias("content_hash"), none.alias("first_seen"), F.col("pos").cast("bigint").alias("pos"), "raw")
        parts[domain] = run_incremental(spark, incoming, f"{root}/{domain}", "key", "modified", o.stamp(), SCHEMA, o.full, o.dry_run, False, "pos", content="content_hash", seen="first_seen", authoritative=True)
    return _finish(spark, root, manifest, parts, o, {k: version.get(k) for k in ("ontology_version", "ontology_hash_sha256", "release_date")})


def _finish(spark: SparkSession, root: str, manifest: Mapping, parts: Mapping[str, dict], o: Options, extra: Mapping | None = None) -> dict:
    """The source's manifest over its parts'; the cursor moves unless it is a dry run."""
    total = {k: sum(p["diff"][k] for p in parts.values()) for k in ("added", "modified", "removed")}
    files = {f"{name}/{kind}": status for name, p in parts.items() for kind, status in p["files"].items()}
    brief = {name: {"diff": p["diff"], "files": p["files"], "last_fetch": p["last_fetch"]} for name, p in parts.items()}
    out = sinks.overlay({**manifest, **(extra or {}), "previous_fetch": manifest.get("last_fetch"), "last_fetch": o.stamp(), "mode": "full" if o.full else "incremental", "diff": total, "files": files}, brief)
    sinks.write_manifest(spark, f"{root}/manifest", out, o.dry_run)
    return out


_RUNS: dict[str, Callable[[SparkSession, str, Options], dict]] = {"cve": _cve, "cwe": _cwe, "capec": _capec, "attack": _attack, "defend": _defend}


def sync(spark: SparkSession, source: str, base_dir: str, options: Options) -> dict:
    """One source's run; its manifest. A failed run leaves the manifest, and with it the cursor, as it was."""
    rest.register(spark)
    return _RUNS[source](spark, f"{base_dir}/{source}", options)


__all__ = ["MissingCursor", "Options", "SOURCES", "load_env", "sync"]
