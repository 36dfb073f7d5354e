"""Adversary techniques: three domain bundles merged, canonical identifiers, thirteen entity types, native and derived edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalar
from graphloom.operators.graph import both_endpoints, composite_lookup, edges, materialize, resolve_ids, strict_lookup, union_edges
from graphloom.operators.state import domain_merge
from graphloom.plans.common import present, rejects, typed

NAMESPACE = "mitre-attack-preprocessing"
DOMAINS = ("enterprise", "mobile", "ics")
BOILERPLATE = ("identity", "marking-definition", "x-mitre-collection")

#: Fixed by the bundles: sources of an object's own code, kill chains and their domains, labels, columns by type.
CODE_SOURCES = ("mitre-attack", "mitre-ics-attack", "mitre-mobile-attack")
CHAINS = {"mitre-attack": "enterprise-attack", "mitre-mobile-attack": "mobile-attack", "mitre-ics-attack": "ics-attack"}
LABELS = {"attack-pattern": "attack-technique", "course-of-action": "attack-mitigation"}
_PLATFORMS = ("x_mitre_platforms",)
COLUMNS = {
    "attack-pattern": ("x_mitre_platforms", "x_mitre_is_subtechnique", "x_mitre_tactic_type", "x_mitre_impact_type", "x_mitre_remote_support"),
    "malware": ("x_mitre_platforms", "x_mitre_aliases", "is_family"),
    "tool": ("x_mitre_platforms", "x_mitre_aliases"),
    "intrusion-set": ("aliases",),
    "campaign": ("aliases", "first_seen", "last_seen"),
    "course-of-action": ("labels",),
    "x-mitre-tactic": (),
    "x-mitre-matrix": (),
    "x-mitre-analytic": _PLATFORMS,
    "x-mitre-detection-strategy": (),
    "x-mitre-data-component": (),
    "x-mitre-data-source": ("x_mitre_collection_layers", "x_mitre_platforms"),
    "x-mitre-asset": ("x_mitre_platforms", "x_mitre_sectors"),
}
OBJECT = (
    "type string, id string, name string, description string, created string, modified string, revoked boolean, x_mitre_deprecated boolean, x_mitre_domains array<string>, x_mitre_platforms array<string>, "
    "x_mitre_is_subtechnique boolean, x_mitre_tactic_type array<string>, x_mitre_impact_type array<string>, x_mitre_remote_support boolean, x_mitre_shortname string, x_mitre_aliases array<string>, aliases array<string>, "
    "is_family boolean, first_seen string, last_seen string, labels array<string>, x_mitre_collection_layers array<string>, x_mitre_sectors array<string>, "
    "external_references array<struct<source_name: string, external_id: string, url: string>>, kill_chain_phases array<struct<kill_chain_name: string, phase_name: string>>, tactic_refs array<string>, x_mitre_analytic_refs array<string>, "
    "x_mitre_log_source_references array<struct<x_mitre_data_component_ref: string, name: string, channel: string>>, x_mitre_log_sources array<struct<name: string, channel: string>>, "
    "x_mitre_mutable_elements array<struct<field: string, description: string>>, relationship_type string, source_ref string, target_ref string"
)


def objects_of(bronze: DataFrame) -> DataFrame:
    """Typed objects of all domains, one for each id; order is the place of its last copy's bundle and position."""
    objects = typed(bronze, OBJECT).withColumn("order", F.col("domain_ord") * F.lit(1 << 40) + F.col("pos").cast("bigint"))
    return domain_merge(objects, "id", "modified", "order", "x_mitre_domains")


def identifiers(objects: DataFrame) -> DataFrame:
    """(stix_id, type, final_id): final_id is null for the losers of a collision."""
    entities = objects.where(F.col("type").isin(*COLUMNS))
    inactive = F.coalesce("x_mitre_deprecated", F.lit(False)) | F.coalesce("revoked", F.lit(False))
    claims = entities.select(F.col("id").alias("stix_id"), "type", scalar.attack_code(F.col("external_references"), CODE_SOURCES).alias("code"), (~inactive).alias("active"), F.col("order").alias("pos"))
    return claims.select("stix_id", "type").join(resolve_ids(claims), "stix_id")


def tables(bronze: DataFrame) -> dict[str, DataFrame]:
    objects = materialize(objects_of(bronze), "objects")
    ids = materialize(identifiers(objects), "identifiers")
    known = ids.where("final_id is not null").select("stix_id", "final_id")
    live = objects.join(known, objects.id == known.stix_id)
    out: dict[str, DataFrame] = {}
    for kind, columns in COLUMNS.items():
        named = [F.col(c).alias("aliases" if c == "x_mitre_aliases" else c) for c in columns]
        df = live.where(F.col("type") == kind)
        if kind == "x-mitre-analytic":
            elements = F.filter("x_mitre_mutable_elements", lambda e: F.coalesce(e["field"], F.lit("")) != "")
            notes = F.transform(F.filter(elements, lambda e: F.coalesce(e["description"], F.lit("")) != ""), lambda e: F.concat(e["field"], F.lit(" -- "), e["description"]))
            named += [scalar.none_if_empty(scalar.keep_first(F.transform(elements, lambda e: e["field"]))).alias("x_mitre_mutable_element_fields"), scalar.none_if_empty(notes).alias("x_mitre_mutable_element_notes")]
        out[kind] = df.select(F.col("final_id").alias("id"), "stix_id", F.lit(LABELS.get(kind, kind)).alias("type"), "name", "description", "x_mitre_domains", "revoked", "x_mitre_deprecated", "created", "modified", *named)
    native = objects.where("type = 'relationship'").select("id", "type", "relationship_type", "source_ref", "target_ref", "description", "created", "modified")
    out["relationship"] = both_endpoints(native, known, "stix_id", "final_id")

    techniques, of = live.where("type = 'attack-pattern'"), lambda kind: live.where(F.col("type") == kind)
    capec = techniques.select("final_id", F.explode("external_references").alias("r")).where("r.source_name = 'capec' and r.external_id <> ''").select("final_id", "r.external_id", "r.source_name")
    out["external-relationship"] = edges(capec, NAMESPACE, F.col("final_id"), "related-to", F.col("external_id"), {"source_name": F.col("source_name")})

    made = []
    tactics = of("x-mitre-tactic").select(F.explode("x_mitre_domains").alias("domain"), F.col("x_mitre_shortname").alias("phase"), "final_id", "order").groupBy("domain", "phase").agg(F.max_by("final_id", "order").alias("tactic"))
    phases = techniques.select("final_id", F.explode("kill_chain_phases").alias("p")).select("final_id", scalar.mapped(F.col("p.kill_chain_name"), CHAINS).alias("domain"), F.col("p.phase_name").alias("phase")).where("domain is not null and phase <> ''")
    steps = composite_lookup(phases, ["domain", "phase"], tactics, ["domain", "phase"], "tactic", "target", "kill chain phase")
    made.append(edges(steps, NAMESPACE, F.col("final_id"), "has_tactic", F.col("target")))
    for kind, field, verb in (("x-mitre-matrix", "tactic_refs", "has_member"), ("x-mitre-detection-strategy", "x_mitre_analytic_refs", "has_analytic")):
        refs = strict_lookup(of(kind).select("final_id", F.explode(field).alias("ref")), "ref", known, "stix_id", "final_id", "target", field)
        made.append(edges(refs, NAMESPACE, F.col("final_id"), verb, F.col("target")))
    prefix = F.lit("log-source--")
    logs = of("x-mitre-analytic").select("final_id", F.explode("x_mitre_log_source_references").alias("l")).where("l.x_mitre_data_component_ref <> ''").select("final_id", F.col("l.x_mitre_data_component_ref").alias("ref"), present(F.col("l.name")).alias("name"), scalar.clean_channel(F.col("l.channel")).alias("channel"))
    found = strict_lookup(logs, "ref", known, "stix_id", "final_id", "target", "data component")
    made.append(edges(found, NAMESPACE, F.col("final_id"), "uses_data_component", F.col("target"), {"log_source_ref": F.concat(prefix, F.col("name")), "channel": F.col("channel")}))
    fed = of("x-mitre-data-component").select("final_id", F.explode("x_mitre_log_sources").alias("l")).where("l.name <> ''").select("final_id", "l.name", scalar.clean_channel(F.col("l.channel")).alias("channel"))
    made.append(edges(fed, NAMESPACE, F.col("final_id"), "has_log_source", F.concat(prefix, F.col("name")), {"channel": F.col("channel")}))
    out["derived-relationship"] = union_edges(*made)
    names = logs.select("name").unionByName(fed.select("name")).where("name is not null").distinct()
    out["log-source"] = names.select(F.concat(prefix, F.col("name")).alias("id"), F.lit("log-source").alias("type"), "name")
    lost = ids.where("final_id is null").groupBy("type").agg(F.count("*").alias("n")).withColumn("reason", F.lit("lost an identifier"))
    out["dropped"] = rejects(objects, (*COLUMNS, "relationship"), BOILERPLATE).unionByName(lost)
    return out
