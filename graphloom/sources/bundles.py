"""Landed snapshots to bronze tables: each object stays as its JSON text, since some identifiers hash its spelling."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SourceError(RuntimeError):
    """A landed file that does not have the expected shape."""


def bundle(spark: SparkSession, paths: str | list[str], member: str = "objects") -> DataFrame:
    """(file, pos, raw): the objects of bundles at paths (globs too). A file without the list raises; members that are not objects are skipped."""
    files = spark.read.schema(f"`{member}` array<string>").option("multiLine", True).json(paths).withColumn("file", F.col("_metadata.file_path"))
    checked = F.when(F.col(member).isNull(), F.raise_error(F.concat(F.lit(f"no list '{member}' in "), F.col("file"))).cast("array<string>")).otherwise(F.col(member))
    return files.select("file", F.posexplode(checked).alias("pos", "raw")).where(F.startswith(F.ltrim("raw"), F.lit("{")))


def sharded(spark: SparkSession, root: str, pattern: str = "*/latest.json") -> DataFrame:
    """All shards below root; no shard raises."""
    return bundle(spark, f"{root}/{pattern}")


def domains(spark: SparkSession, root: str, names: Iterable[str]) -> DataFrame:
    """Several domains' bundles in a fixed order: column domain_ord tells which, later ones win ties."""
    parts = [stored(spark, f"{root}/{name}").withColumn("domain_ord", F.lit(i)) for i, name in enumerate(names)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def payload(texts: DataFrame, column: str = "payload") -> DataFrame:
    """(pos, raw) of response payloads of three shapes: {"@graph": [..]}, {"results": {"bindings": [..]}}, or a bare list; another shape raises."""
    v = F.try_parse_json(column)
    listed = F.coalesce(F.try_variant_get(v, "$['@graph']", "array<variant>"), F.try_variant_get(v, "$.results.bindings", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    checked = F.when(listed.isNull(), F.raise_error(F.lit("payload has no known list of records")).cast("array<variant>")).otherwise(listed)
    return texts.select(F.posexplode(checked).alias("pos", "v")).select("pos", F.to_json("v").alias("raw")).where(F.startswith("raw", F.lit("{")))


def records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Snapshots of the form {domain, count, records: [..]}."""
    return bundle(spark, paths, "records")


def stored(spark: SparkSession, path: str, member: str = "objects") -> DataFrame:
    """(file, pos, raw) of a synchronised state in the folder(s) path/latest, or else of landed JSON path/latest.json."""
    try:
        return spark.read.parquet(f"{path}/latest").select(F.col("_metadata.file_path").alias("file"), "pos", "raw")
    except Exception as missing:  # Spark names a missing path only in the message
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return bundle(spark, f"{path}/latest.json", member)


def state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored state, or an empty one where nothing is stored yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as missing:  # Spark names a missing path only in the message
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def releases(spark: SparkSession, root: str, domain: str) -> DataFrame:
    """(path, version) of <domain>-<version>.json files, in order of version numbers."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{domain}-*.json").load(root).select("path")
    version = F.regexp_extract("path", rf"{re.escape(domain)}-(\d+(?:\.\d+)*)\.json$", 1)
    return files.withColumn("version", version).where("version <> ''").orderBy(F.transform(F.split("version", "\\."), lambda p: p.cast("int")))


def version_picks(index: DataFrame, title: str, name: str = "title") -> DataFrame:
    """The collection with this title, whatever its case; failing that, the first whose title holds it; an error if there is none."""
    wanted = title.lower()
    ranked = index.withColumn("_rank", F.when(F.lower(name) == wanted, 0).when(F.contains(F.lower(name), F.lit(wanted)), 1)).where("_rank is not null").orderBy("_rank", name).limit(1)
    if ranked.isEmpty():
        raise SourceError(f"no collection with title {title!r}")
    return ranked.drop("_rank")


# ---- catalog in zipped XML ----


def _tag(name: str) -> str:
    return name.rsplit("}", 1)[-1].replace("_", "")


def element(node: ElementTree.Element) -> object:
    """An XML element as JSON: attributes and children by name (children's names without underscores), a leaf as its text (null if empty), text beside attributes as _text; a repeated child is a list."""
    text = (node.text or "").strip()
    out: dict = dict(node.attrib)
    grouped: dict[str, list] = {}
    for child in node:
        grouped.setdefault(_tag(child.tag), []).append(element(child))
    out |= {name: values if len(values) > 1 else values[0] for name, values in grouped.items()}
    if not out:
        return text or None
    return out | ({"_text": text} if text and not grouped else {})


#: Sections of the catalog and the type of their entries, fixed by the source format.
_SECTIONS = {"Weaknesses": "weakness", "Categories": "category", "Views": "view"}


def _history(entry: dict, run_timestamp: str) -> tuple[str, str]:
    """(created, modified): the first submission, else the first modification, else the run; the last date of either, else created."""
    history = entry.get("ContentHistory") or {}

    def days(kind: str) -> list[str]:
        """A history entry counts with its release date, else with its date."""
        found = history.get(kind)
        stated = [x.get(f"{kind}ReleaseDate") or x.get(f"{kind}Date") for x in (found if isinstance(found, list) else [found]) if isinstance(x, dict)]
        return sorted(day for day in stated if isinstance(day, str))

    begun, changed = days("Submission"), days("Modification")
    stamp = lambda day: f"{day[:10]}T00:00:00.000Z"
    created = stamp((begun or changed)[0]) if begun or changed else run_timestamp
    return created, stamp(max(begun + changed)) if begun or changed else created


def catalog_records(content: bytes, run_timestamp: str) -> list[tuple[str, str, str]]:
    """(version, date, record JSON with sorted keys) of a catalog's entries; content is the XML or a zip whose first .xml member it is."""
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            names = [n for n in archive.namelist() if n.lower().endswith(".xml")]
            if not names:
                raise SourceError("the archive holds no .xml file")
            content = archive.read(names[0])
    root = ElementTree.fromstring(content)
    out = []
    for section in root:
        kind = _SECTIONS.get(_tag(section.tag))
        for node in section if kind else ():
            entry = element(node)
            if not isinstance(entry, dict) or not entry.get("ID"):
                continue
            created, modified = _history(entry, run_timestamp)
            entry.pop("ContentHistory", None)
            number = str(entry["ID"])
            out.append((root.get("Version", ""), root.get("Date", ""), json.dumps(entry | {"type": kind, "id": f"CWE-{number}", "cwe_id": number, "created": created, "modified": modified}, sort_keys=True)))
    return out


def catalog(spark: SparkSession, path: str, run_timestamp: str) -> DataFrame:
    """(version, date, raw) of zipped or plain XML catalogs. A catalog is one file of some megabytes and is parsed in one task; several files in several."""

    def run(frames):  # noqa: ANN001, ANN202
        for frame in frames:
            rows = [r for content in frame["content"] for r in catalog_records(content, run_timestamp)]
            yield pd.DataFrame(rows, columns=["version", "date", "raw"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "version string, date string, raw string")
