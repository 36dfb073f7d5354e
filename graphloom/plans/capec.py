"""Attack patterns: entities, consequences and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import identity, scalar
from graphloom.operators.graph import edges, lenient_remap, peer_pairs, shared_nodes, strict_lookup, union_edges
from graphloom.plans.common import parsed, rejects, typed

NAMESPACE = "capec-preprocessing"
KNOWN, DROPPED = ("attack-pattern", "course-of-action", "relationship"), ("identity", "marking-definition")

#: Fixed by the catalog: references that become edges, reference lists that become edges (their inverses are left out), scope spellings.
EXTERNAL = ("cwe", "ATTACK")
HIERARCHY = {"x_capec_child_of_refs": "child_of", "x_capec_can_precede_refs": "can_precede"}
SCOPES = {"Access_Control": "Access Control"}

OBJECT = (
    "type string, id string, name string, description string, created string, modified string, external_references array<struct<source_name: string, external_id: string, url: string>>, "
    "x_capec_child_of_refs array<string>, x_capec_can_precede_refs array<string>, x_capec_peer_of_refs array<string>, x_capec_consequences map<string, array<string>>, "
    "x_capec_alternate_terms array<string>, x_capec_abstraction string, x_capec_domains array<string>, x_capec_prerequisites array<string>, x_capec_typical_severity string, "
    "x_capec_likelihood_of_attack string, x_capec_resources_required array<string>, x_capec_example_instances array<string>, x_capec_extended_description string, x_capec_version string, "
    "relationship_type string, source_ref string, target_ref string"
)
KEPT = ("name", "description", "type", "x_capec_abstraction", "x_capec_domains", "x_capec_prerequisites", "x_capec_typical_severity", "x_capec_likelihood_of_attack", "x_capec_resources_required", "x_capec_example_instances")


def version(bronze: DataFrame) -> DataFrame:
    """One row with the first version that an object states."""
    return typed(bronze, "x_capec_version string").agg(F.min_by("x_capec_version", F.when(F.col("x_capec_version").isNotNull(), F.col("pos"))).alias("version"))


def tables(bronze: DataFrame) -> dict[str, DataFrame]:
    objects = parsed(bronze, OBJECT)
    own = F.get(F.filter("external_references", lambda r: r["source_name"] == "capec"), F.lit(0))["external_id"]
    number = scalar.number_after_dash(own)
    number = F.when(number.isNull(), F.raise_error(F.concat(F.lit("no capec reference: "), F.col("id"))).cast("int")).otherwise(number)
    patterns = objects.where("type = 'attack-pattern'").withColumn("number", number).withColumn("code", F.concat(F.lit("CAPEC-"), F.col("number").cast("string")))
    ids = patterns.select("id", "code", "number")
    aliases = scalar.none_if_empty(scalar.keep_first(F.col("x_capec_alternate_terms")))
    out = {
        "attack-pattern": patterns.select(F.col("code").alias("id"), F.col("id").alias("stix_id"), *KEPT, F.col("x_capec_extended_description").alias("extended_description"), aliases.alias("aliases")),
        "course-of-action": objects.where("type = 'course-of-action'").select("id", "name", "description", "type"),
    }
    native = objects.where("type = 'relationship'").select("id", "type", "relationship_type", "source_ref", "target_ref", "created")
    for ref in ("source_ref", "target_ref"):
        native = lenient_remap(native, ref, ids, "id", "code")
    out["relationship"] = native
    refs = patterns.select("code", F.explode("external_references").alias("r")).select("code", "r.source_name", "r.external_id").where(F.col("source_name").isin(*EXTERNAL) & (F.coalesce("external_id", F.lit("")) != ""))
    out["external-relationship"] = edges(refs, NAMESPACE, F.col("code"), "related-to", F.col("external_id"), {"source_name": F.col("source_name")}, in_seed=False)
    made = []
    for field, verb in HIERARCHY.items():
        steps = strict_lookup(patterns.select("code", F.explode(field).alias("ref")), "ref", ids, "id", "code", "target", "attack-pattern reference")
        made.append(edges(steps, NAMESPACE, F.col("code"), verb, F.col("target")))
    # numbers, not texts, tell which of two peers comes first
    peers = strict_lookup(patterns.select("number", F.explode("x_capec_peer_of_refs").alias("ref")), "ref", ids.withColumn("n", F.col("number").cast("string")), "id", "n", "peer", "attack-pattern reference").withColumn("peer", F.col("peer").cast("int"))
    pairs = peer_pairs(peers, "number", "peer")
    made.append(edges(pairs, NAMESPACE, F.concat(F.lit("CAPEC-"), F.col("low").cast("string")), "peer_of", F.concat(F.lit("CAPEC-"), F.col("high").cast("string"))))
    scope = F.coalesce(scalar.mapped(F.col("scope"), SCOPES), F.col("scope"))
    impacts = patterns.select("code", F.explode("x_capec_consequences").alias("scope", "impacts")).select("code", scope.alias("scope"), F.explode("impacts").alias("text"))
    impacts = impacts.withColumn("s", scalar.split_note(F.col("text"))).select("code", "scope", "s.impact", "s.note").distinct()
    impacts = impacts.withColumn("node", identity.node_id(NAMESPACE, "consequence", F.concat(F.lit("scope="), F.col("scope"), F.lit("|impact="), F.col("impact"))))
    out["consequence"] = shared_nodes(impacts.select(F.col("node").alias("id"), F.lit("consequence").alias("type"), F.array("scope").alias("scope"), F.array("impact").alias("impact")))
    made.append(edges(impacts, NAMESPACE, F.col("code"), "has_consequence", F.col("node"), {"note": F.nullif(F.col("note"), F.lit(""))}, in_seed=False))
    out["attack-pattern-relationship"] = union_edges(*made)
    out["dropped"] = rejects(objects, KNOWN, DROPPED)
    return out
