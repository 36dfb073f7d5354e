"""Defensive techniques: entities, ontology edges, and edges mined from the mapping rows."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalar
from graphloom.operators import graph
from graphloom.operators.graph import edges, union_edges
from graphloom.plans.common import parsed, present, union

NAMESPACE = "mitre-defend-preprocessing"
#: Fixed by the ontology.
URI, ROOT = "http://d3fend.mitre.org/ontologies/d3fend.owl#", "Weakness"

ENTITY = "`@id` string, `rdfs:label` string, `d3f:definition` string, `d3f:synonym` string, `skos:altLabel` string, `d3f:d3fend-id` string, `d3f:display-order` string, `d3f:display-priority` string, `rdfs:subClassOf` string, `rdfs:hasSubClass` string, `d3f:weakness-of` string, `d3f:may-be-weakness-of` string"
CELLS = ("def_tech", "def_artifact", "def_artifact_rel_label", "def_tactic", "off_tech", "off_artifact", "off_artifact_rel_label")


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def mapping_rows(bronze: DataFrame) -> DataFrame:
    """Mapping rows with plain values: identifiers without the ontology's address, empty ones null."""
    rows = parsed(bronze, ", ".join(f"{c} string" for c in CELLS))
    return rows.select(*[present(scalar.binding(F.col(c)) if c.endswith("_label") else scalar.strip_prefix(scalar.binding(F.col(c)), URI)).alias(c) for c in CELLS])


def mined(rows: DataFrame, ordered: bool = False) -> DataFrame:
    """Edges from mapping rows: each fact once, however many rows trace it. Facts are distinct by label; two labels with one slug stay two edges. ordered: emitted in the order of their facts."""
    facts = partial(graph.facts, ordered=ordered)
    acts = facts(rows, "def_tech", "def_artifact_rel_label", "def_artifact")
    enables = facts(rows, "def_tech", "def_tactic")
    offends = facts(rows, "off_tech", "off_artifact_rel_label", "off_artifact")
    counters = facts(rows, "def_tech", "off_tech", "def_artifact", "def_artifact_rel_label", "off_artifact", "off_artifact_rel_label")
    return union_edges(
        edges(acts, NAMESPACE, F.col("def_tech"), scalar.slug(F.col("def_artifact_rel_label")), F.col("def_artifact")),
        edges(enables, NAMESPACE, F.col("def_tech"), "enables", F.col("def_tactic")),
        edges(offends, NAMESPACE, F.col("off_tech"), scalar.slug(F.col("off_artifact_rel_label")), F.col("off_artifact")),
        edges(counters, NAMESPACE, F.col("def_tech"), "counters", F.col("off_tech"), {"def_artifact": F.col("def_artifact"), "def_artifact_rel": F.col("def_artifact_rel_label"), "off_artifact": F.col("off_artifact"), "off_artifact_rel": F.col("off_artifact_rel_label")}),
    )


def tables(technique: DataFrame, tactic: DataFrame, artifact: DataFrame, weakness: DataFrame, mapping: DataFrame) -> dict[str, DataFrame]:
    """Bronze of the five domains to technique, tactic, artifact and relationship tables."""
    t, c, a, w = (parsed(df, ENTITY).withColumn("own", scalar.strip_prefix(_col("@id"), "d3f:")) for df in (technique, tactic, artifact, weakness))
    aliases = lambda *names: scalar.none_if_empty(scalar.keep_first(F.concat(*[scalar.strings(_col(n)) for n in names]))).alias("aliases")
    number = lambda n: scalar.literal_value(_col(n)).cast("int")
    out = {
        "technique": t.select(F.col("own").alias("id"), F.lit("technique").alias("type"), _col("rdfs:label").alias("name"), present(_col("d3f:d3fend-id")).alias("d3fend_id"), aliases("d3f:synonym")),
        "tactic": c.select(F.col("own").alias("id"), F.lit("tactic").alias("type"), _col("rdfs:label").alias("name"), present(_col("d3f:definition")).alias("description"), number("d3f:display-order").alias("display_order"), number("d3f:display-priority").alias("display_priority")),
        "artifact": a.select(F.col("own").alias("id"), F.lit("artifact").alias("type"), F.get(scalar.as_list(_col("rdfs:label"), "string"), F.lit(0)).alias("name"), present(F.array_join(scalar.as_list(_col("d3f:definition"), "string"), "\n\n")).alias("description"), aliases("d3f:synonym", "skos:altLabel")),
    }

    def refs(df: DataFrame, field: str, verb: str) -> DataFrame:
        targets = df.select("own", F.explode(scalar.as_list(_col(field), "string")).alias("ref")).withColumn("target", present(scalar.ref_id(F.col("ref")))).where("target is not null")
        return edges(targets.where(F.col("target") != ROOT) if verb == "child_of" else targets, NAMESPACE, F.col("own"), verb, F.col("target"))

    ontology = [refs(a, "rdfs:hasSubClass", "has_subclass"), refs(w, "rdfs:subClassOf", "child_of"), refs(w, "d3f:weakness-of", "weakness_of"), refs(w, "d3f:may-be-weakness-of", "may_be_weakness_of")]
    out["relationship"] = union([*ontology, mined(mapping_rows(mapping))])
    return out


def stamped(bronze: DataFrame) -> DataFrame:
    """(key, content_hash, raw): records keyed by @id, or by their content hash where they have none; bookkeeping fields (_..) do not count. Later rows win.

    The hash is that of the record's sorted JSON, so that 1 and "1" differ and the order of keys, nested ones too, does not count.
    """
    from graphloom.functions.identity import record_hash
    from graphloom.operators.state import last_wins

    rows = bronze.withColumn("content_hash", record_hash(F.col("raw"))).withColumn("key", F.coalesce(present(F.get_json_object("raw", "$['@id']")), F.col("content_hash")))
    return last_wins(rows, "key", "pos").select("key", "content_hash", "raw")
