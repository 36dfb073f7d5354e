"""Weaknesses: entities, shared and private sub-entities, and edges.

Elements that the XML-to-JSON step gives as one value or as a list are kept as JSON text and read by `as_list`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import identity, scalar
from graphloom.functions.rich_text import flatten_markup
from graphloom.operators.graph import edges, shared_nodes, union_edges
from graphloom.plans.common import parsed, present, rejects, union

NAMESPACE = "cwe-preprocessing"
KNOWN = ("weakness", "category", "view")

#: Fixed by the catalog.
NATURES = {"ChildOf": "child_of", "CanPrecede": "can_precede", "PeerOf": "peer_of", "CanAlsoBe": "can_also_be", "Requires": "requires", "StartsWith": "starts_with"}

_S = "string"
OBJECT = (
    "type string, id string, cwe_id string, Name string, Status string, created string, modified string, Abstraction string, Structure string, Description string, LikelihoodOfExploit string, Summary string, "
    "ExtendedDescription string, BackgroundDetails struct<BackgroundDetail: string>, Objective string, Audience struct<Stakeholder: string>, AffectedResources struct<AffectedResource: string>, "
    "FunctionalAreas struct<FunctionalArea: string>, WeaknessOrdinalities struct<WeaknessOrdinality: string>, AlternateTerms struct<AlternateTerm: string>, RelatedWeaknesses struct<RelatedWeakness: string>, "
    "RelatedAttackPatterns struct<RelatedAttackPattern: string>, ObservedExamples struct<ObservedExample: string>, CommonConsequences struct<Consequence: string>, ApplicablePlatforms map<string, string>, "
    "ModesOfIntroduction struct<Introduction: string>, PotentialMitigations struct<Mitigation: string>, DetectionMethods struct<DetectionMethod: string>, Relationships struct<HasMember: string>, Members struct<HasMember: string>"
)


def _items(df: DataFrame, field: str, element: str) -> DataFrame:
    """(source, pos, fields of element) of a scalar-or-list field."""
    return df.select("source", F.posexplode(scalar.as_list(F.col(field), f"struct<{element}>")).alias("pos", "e")).select("source", "pos", "e.*")


def _detailed(df: DataFrame, field: str, kind: str, own_id: str, id_field: str, first: str, verb: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of mitigations or detection methods: with an id of its own a node is shared and the detail lies on the edge; without, the node is private and has the detail."""
    items = _items(df, field, f"{own_id}: string, {first}: string, Strategy: string, Effectiveness: string, Description: string, EffectivenessNotes: string")
    lists = ("phase",) if first == "Phase" else ()
    lead = scalar.none_if_empty(scalar.as_list(F.col(first), _S)) if lists else present(F.col(first))
    detail = {first.lower(): lead, "effectiveness": present(F.col("Effectiveness")), "description": flatten_markup("Description"), "effectiveness_notes": flatten_markup("EffectivenessNotes")}
    if lists:
        detail["strategy"] = present(F.col("Strategy"))
    items = items.select("source", "pos", present(F.col(own_id)).alias("own"), *[c.alias(n) for n, c in detail.items()])
    seed = F.coalesce("own", F.concat(F.lit("private|"), F.col("source"), F.lit("|"), F.col("pos").cast("string")))
    items = items.withColumn("node", identity.node_id(NAMESPACE, kind, seed))
    shared = F.col("own").isNotNull()
    nodes = shared_nodes(items.select(F.col("node").alias("id"), F.lit(kind).alias("type"), F.col("own").alias(id_field), *[F.when(~shared, F.col(n)).alias(n) for n in detail]))
    return nodes, edges(items, NAMESPACE, F.col("source"), verb, F.col("node"), {n: F.when(shared, F.col(n)) for n in detail}, lists=lists)


def tables(bronze: DataFrame) -> dict[str, DataFrame]:
    objects = parsed(bronze, OBJECT).withColumn("source", F.concat(F.lit("CWE-"), F.col("cwe_id")))
    kinds = {k: objects.where(F.col("type") == k) for k in KNOWN}
    w = kinds["weakness"]
    base = [F.col(c).alias(scalar_name) for c, scalar_name in (("id", "id"), ("cwe_id", "cwe_id"), ("Name", "name"), ("type", "type"), ("Status", "status"), ("created", "created"), ("modified", "modified"))]
    listed = lambda c: scalar.none_if_empty(scalar.strings(F.col(c)))
    field_of = lambda c, f: scalar.none_if_empty(F.filter(F.transform(scalar.as_list(F.col(c), f"struct<{f}: string>"), lambda x: x[f]), lambda x: x.isNotNull() & (x != "")))
    out: dict[str, DataFrame] = {}
    terms = _items(w.withColumn("field", F.col("AlternateTerms.AlternateTerm")), "field", "Term: string, Description: string").where("Term <> ''").withColumn("note", flatten_markup("Description"))
    names = terms.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("pos", "Term", "note"))).alias("t"))
    names = names.select("source", scalar.keep_first(F.col("t.Term")).alias("aliases"), scalar.none_if_empty(F.transform(F.filter("t", lambda x: x["note"].isNotNull()), lambda x: F.concat(x["Term"], F.lit(" -- "), x["note"]))).alias("alias_notes"))
    out["weakness"] = w.join(names, "source", "left").select(
        *base, F.col("Abstraction").alias("abstraction"), F.col("Structure").alias("structure"), F.col("Description").alias("description"), F.col("LikelihoodOfExploit").alias("likelihood_of_exploit"),
        flatten_markup("ExtendedDescription").alias("extended_description"), flatten_markup("BackgroundDetails.BackgroundDetail").alias("background_details"), listed("AffectedResources.AffectedResource").alias("affected_resources"),
        listed("FunctionalAreas.FunctionalArea").alias("functional_areas"), field_of("WeaknessOrdinalities.WeaknessOrdinality", "Ordinality").alias("weakness_ordinalities"), "aliases", "alias_notes",
    )
    out["category"] = kinds["category"].select(*base, F.col("Summary").alias("summary"))
    out["view"] = kinds["view"].select(*base, F.get_json_object("raw", "$.Type").alias("view_type"), flatten_markup("Objective").alias("objective"), field_of("Audience.Stakeholder", "Type").alias("audience"))

    prefixed = lambda c, p="CWE-": F.concat(F.lit(p), F.col(c))
    made = []
    rel = _items(w.withColumn("field", F.col("RelatedWeaknesses.RelatedWeakness")), "field", "Nature: string, CWE_ID: string, View_ID: string, Ordinal: string")
    made.append(edges(rel, NAMESPACE, F.col("source"), scalar.mapped(F.col("Nature"), NATURES, "nature of a related weakness"), prefixed("CWE_ID"), {"ordinal": present(F.col("Ordinal")), "view_id": present(F.col("View_ID"))}))
    for kind, field in (("category", "Relationships.HasMember"), ("view", "Members.HasMember")):
        members = _items(kinds[kind].withColumn("field", F.col(field)), "field", "CWE_ID: string, View_ID: string")
        made.append(edges(members, NAMESPACE, F.col("source"), "has_member", prefixed("CWE_ID"), {"view_id": present(F.col("View_ID"))}))

    scopes = _items(w.withColumn("field", F.col("CommonConsequences.Consequence")), "field", "Scope: string, Impact: string, Likelihood: string, Note: string")
    scopes = scopes.select("source", F.array_sort(scalar.as_list(F.col("Scope"), _S)).alias("scope"), F.array_sort(scalar.as_list(F.col("Impact"), _S)).alias("impact"), present(F.col("Likelihood")).alias("likelihood"), flatten_markup("Note").alias("note")).where("size(scope) + size(impact) > 0")
    scopes = scopes.withColumn("node", identity.node_id(NAMESPACE, "consequence", F.concat(F.lit("scope="), F.array_join("scope", ","), F.lit("|impact="), F.array_join("impact", ","))))
    out["consequence"] = shared_nodes(scopes.select(F.col("node").alias("id"), F.lit("consequence").alias("type"), "scope", "impact"))
    made.append(edges(scopes, NAMESPACE, F.col("source"), "has_consequence", F.col("node"), {"likelihood": F.col("likelihood"), "note": F.col("note")}))

    platforms = w.select("source", F.explode("ApplicablePlatforms").alias("category", "field")).select("source", "category", F.posexplode(scalar.as_list(F.col("field"), "struct<Name: string, Class: string, Prevalence: string>")).alias("pos", "e")).select("source", "category", "pos", "e.*")
    named = present(F.col("Name"))
    platforms = platforms.withColumn("node", identity.node_id(NAMESPACE, "platform", F.concat_ws("|", "category", F.coalesce(named, F.concat(F.lit("private|"), F.col("source"), F.lit("|"), F.col("pos").cast("string"))))))
    out["platform"] = shared_nodes(platforms.select(F.col("node").alias("id"), F.lit("platform").alias("type"), "category", named.alias("name")))
    made.append(edges(platforms, NAMESPACE, F.col("source"), "applies_to_platform", F.col("node"), {"class": present(F.col("Class")), "prevalence": present(F.col("Prevalence"))}))

    phases = _items(w.withColumn("field", F.col("ModesOfIntroduction.Introduction")), "field", "Phase: string, Note: string").where("Phase <> ''").withColumn("node", identity.node_id(NAMESPACE, "introduction", F.col("Phase"))).withColumn("note", flatten_markup("Note"))
    out["introduction"] = shared_nodes(phases.select(F.col("node").alias("id"), F.lit("introduction").alias("type"), F.col("Phase").alias("phase")))
    made.append(edges(phases, NAMESPACE, F.col("source"), "introduced_in", F.col("node"), {"note": F.col("note")}))

    for kind, field, own, id_field, first, verb in (
        ("mitigation", "PotentialMitigations.Mitigation", "Mitigation_ID", "mitigation_id", "Phase", "has_mitigation"),
        ("detection-method", "DetectionMethods.DetectionMethod", "Detection_Method_ID", "detection_method_id", "Method", "has_detection_method"),
    ):
        out[kind], links = _detailed(w.withColumn("field", F.col(field)), "field", kind, own, id_field, first, verb)
        made.append(links)
    out["relationship"] = union_edges(*made)

    patterns = _items(w.withColumn("field", F.col("RelatedAttackPatterns.RelatedAttackPattern")), "field", "CAPEC_ID: string").where("CAPEC_ID <> ''").withColumn("source_name", F.lit("capec"))
    examples = observed(w)
    fine = examples.where(F.col("ref").rlike(r"^CVE-\d{4}-\d{4,}$")).withColumn("source_name", F.lit("cve"))
    out["external-relationship"] = union(
        [
            edges(patterns, NAMESPACE, F.col("source"), "related-to", prefixed("CAPEC_ID", "CAPEC-"), {"source_name": F.col("source_name")}),
            edges(fine, NAMESPACE, F.col("source"), "related-to", F.col("ref"), {"source_name": F.col("source_name"), "description": present(F.col("Description")), "link": present(F.col("Link"))}),
        ]
    )
    out["dropped"] = rejects(objects, KNOWN, ()).unionByName(examples.where(F.startswith("ref", F.lit("CVE")) & ~F.col("ref").rlike(r"^CVE-\d{4}-\d{4,}$")).groupBy().agg(F.count("*").alias("n")).select(F.lit("observed example").alias("type"), "n", F.lit("malformed CVE id").alias("reason")).where("n > 0"))
    return out


def observed(weaknesses: DataFrame) -> DataFrame:
    """(source, ref, Description, Link): observed examples with the brackets around their references stripped."""
    bare: Column = F.regexp_replace(F.trim(F.col("Reference")), r"^[\[\]]+|[\[\]]+$", "")
    return _items(weaknesses.withColumn("field", F.col("ObservedExamples.ObservedExample")), "field", "Reference: string, Description: string, Link: string").withColumn("ref", bare).where("ref <> ''")
