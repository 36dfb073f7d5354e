"""Vulnerabilities: raw feed records to objects, and objects to entities, scores and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import identity, rich_text, scalar
from graphloom.operators.graph import edges
from graphloom.plans.common import parsed, rejects, union

NAMESPACE = "cve-preprocessing"
DROPPED_STATUS = "Rejected"

#: Fixed by the feed: score list -> entity type, edge type, nested object, fields that are never set and so left out.
ENVIRONMENTAL = (
    "confidentialityRequirement", "integrityRequirement", "availabilityRequirement", "modifiedAttackVector", "modifiedAttackComplexity",
    "modifiedAttackRequirements", "modifiedPrivilegesRequired", "modifiedUserInteraction", "modifiedVulnConfidentialityImpact",
    "modifiedVulnIntegrityImpact", "modifiedVulnAvailabilityImpact", "modifiedSubConfidentialityImpact", "modifiedSubIntegrityImpact",
    "modifiedSubAvailabilityImpact",
)
SCORES = {
    "cvssMetricV2": ("cvss-v2-score", "has_cvss_v2_score", "cvssData", ()),
    "cvssMetricV30": ("cvss-v3-score", "has_cvss_v3_score", "cvssData", ()),
    "cvssMetricV31": ("cvss-v3-score", "has_cvss_v3_score", "cvssData", ()),
    "cvssMetricV40": ("cvss-v4-score", "has_cvss_v4_score", "cvssData", ENVIRONMENTAL),
    "ssvcV203": ("ssvc-assessment", "has_ssvc_assessment", "ssvcData", ()),
}

OBJECT = (
    "type string, spec_version string, id string, name string, created string, modified string, description string, x_nvd_vuln_status string, "
    "x_nvd_source_identifier string, x_nvd_weaknesses array<string>, x_nvd_cvss struct<" + ",".join(f"{k}: array<string>" for k in SCORES) + ">"
)
RECORD = (
    "id string, published string, lastModified string, vulnStatus string, sourceIdentifier string, descriptions array<struct<lang: string, value: string>>, "
    "references array<struct<url: string, source: string>>, weaknesses array<struct<description: array<struct<lang: string, value: string>>>>, metrics string, configurations string"
)


def to_objects(feed: DataFrame) -> DataFrame:
    """Feed items (raw: {"cve": {..}}) as vulnerability objects. A missing or malformed id raises; references without a url go, those without a source are the feed's."""
    r = feed.select(F.from_json(F.get_json_object("raw", "$.cve"), RECORD).alias("r")).select("r.*")
    cve = F.when(F.col("id").isNull() | ~F.col("id").rlike(r"^CVE-\d{4}-\d{4,}$"), F.raise_error(F.concat(F.lit("not a CVE id: "), F.coalesce("id", F.lit("null")))).cast("string")).otherwise(F.col("id"))
    urls = F.transform(F.filter("references", lambda x: F.coalesce(x["url"], F.lit("")) != ""), lambda x: F.struct(F.coalesce(F.nullif(x["source"], F.lit("")), F.lit("nvd")).alias("source_name"), F.lit(None).cast("string").alias("external_id"), x["url"].alias("url")))
    return r.select(
        F.lit("vulnerability").alias("type"), F.lit("2.1").alias("spec_version"), F.concat(F.lit("vulnerability--"), identity.uuid5(F.concat(F.lit("cve:"), cve))).alias("id"), cve.alias("name"),
        scalar.format_timestamp(scalar.nvd_timestamp(F.col("published"))).alias("created"), scalar.format_timestamp(scalar.nvd_timestamp(F.col("lastModified"))).alias("modified"),
        scalar.english(F.col("descriptions")).alias("description"), F.col("vulnStatus").alias("x_nvd_vuln_status"), F.col("sourceIdentifier").alias("x_nvd_source_identifier"),
        scalar.weakness_labels(F.col("weaknesses")).alias("x_nvd_weaknesses"), F.col("metrics").alias("x_nvd_cvss"), F.col("configurations").alias("x_nvd_configurations"),
        F.concat(F.array(F.struct(F.lit("cve").alias("source_name"), cve.alias("external_id"), F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), cve).alias("url"))), F.coalesce(urls, F.array().cast("array<struct<source_name:string,external_id:string,url:string>>"))).alias("external_references"),
        scalar.cve_year(cve).alias("year"),
    )


def bundle_objects(feed: DataFrame) -> DataFrame:
    """(year, raw): the objects of feed items as JSON text. Scores and configurations are embedded as the feed writes them, since identifiers hash their spelling."""
    objects = to_objects(feed)
    embedded = ("x_nvd_cvss", "x_nvd_configurations")
    plain = F.to_json(F.struct(*[F.col(c) for c in objects.columns if c not in ("year", *embedded)]))
    texts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f',"{c}":'), F.col(c))).otherwise("") for c in embedded]
    return objects.select("year", F.concat(F.left(plain, F.length(plain) - 1), *texts, F.lit("}")).alias("raw"))


def tables(bronze: DataFrame) -> dict[str, DataFrame]:
    """vulnerability, score and edge tables, and the count of what was left out. Rejected vulnerabilities go; those without a status stay."""
    every = parsed(bronze, OBJECT)
    status = F.coalesce(F.col("x_nvd_vuln_status"), F.lit(""))
    objects = every.where(F.col("type") == "vulnerability")
    live = objects.where(status != DROPPED_STATUS).withColumn("cve", F.coalesce("name", "id"))
    out = {"vulnerability": live.select(F.col("cve").alias("id"), F.col("id").alias("stix_id"), "type", "spec_version", "created", "modified", "description", "x_nvd_vuln_status", "x_nvd_source_identifier")}
    labels = live.select("cve", F.explode("x_nvd_weaknesses").alias("weakness")).where(F.startswith("weakness", F.lit("CWE-"))).withColumn("source_name", F.lit("cwe"))
    out["external-relationship"] = edges(labels, NAMESPACE, F.col("cve"), "related-to", F.col("weakness"), {"source_name": F.col("source_name")}, in_seed=False)
    scored: dict[str, list[DataFrame]] = {}
    links = []
    for metric, (kind, verb, nested, drop) in SCORES.items():
        entries = live.select("cve", F.posexplode(f"x_nvd_cvss.{metric}").alias("pos", "entry")).withColumn("flat", rich_text.flat_score_udf(nested, drop)("entry"))
        seed = F.concat(F.col("cve"), F.lit(f"|{metric}|"), F.col("pos").cast("string"), F.lit("|"), F.col("flat"))
        made = entries.select("cve", identity.node_id(NAMESPACE, kind, seed).alias("id"), F.lit(kind).alias("type"), "flat")
        scored.setdefault(kind, []).append(made.select("id", "type", F.from_json("flat", "map<string,string>").alias("fields")))
        links.append(edges(made, NAMESPACE, F.col("cve"), verb, F.col("id")))
    out |= {kind: score_columns(union(parts), kind) for kind, parts in scored.items()}
    out["relationship"] = union(links)
    dropped = objects.where(status == DROPPED_STATUS).groupBy().agg(F.count("*").alias("n")).select(F.lit("vulnerability").alias("type"), "n", F.lit("rejected").alias("reason")).where("n > 0")
    out["dropped"] = rejects(every, ("vulnerability",), ()).unionByName(dropped)
    return out


#: Typed columns of the score tables, fixed by the feed; others are text.
_NUMBERS = ("base_score", "exploitability_score", "impact_score")
_COMMON = ("source", "assessment_type", "version", "vector_string", "base_score")
SCORE_COLUMNS = {
    "cvss-v2-score": (*_COMMON, "base_severity", "exploitability_score", "impact_score", "access_vector", "access_complexity", "authentication", "confidentiality_impact", "integrity_impact", "availability_impact", "ac_insuf_info", "obtain_all_privilege", "obtain_user_privilege", "obtain_other_privilege", "user_interaction_required"),
    "cvss-v3-score": (*_COMMON, "base_severity", "exploitability_score", "impact_score", "attack_vector", "attack_complexity", "privileges_required", "user_interaction", "scope", "confidentiality_impact", "integrity_impact", "availability_impact"),
    "cvss-v4-score": (*_COMMON, "base_severity", "attack_vector", "attack_complexity", "attack_requirements", "privileges_required", "user_interaction", "vuln_confidentiality_impact", "vuln_integrity_impact", "vuln_availability_impact", "sub_confidentiality_impact", "sub_integrity_impact", "sub_availability_impact", "exploit_maturity", "safety", "automatable", "recovery", "value_density", "vulnerability_response_effort", "provider_urgency"),
    "ssvc-assessment": ("source", "timestamp", "role", "version", "exploitation", "automatable", "technical_impact"),
}


def score_columns(scores: DataFrame, kind: str) -> DataFrame:
    """One column for each known field of this kind, of the fitting type; unknown fields stay in other_fields."""
    names = SCORE_COLUMNS[kind]
    flags = ("ac_insuf_info", "obtain_all_privilege", "obtain_user_privilege", "obtain_other_privilege", "user_interaction_required")
    value = lambda c: F.try_element_at("fields", F.lit(c))
    cast = lambda c: value(c).cast("double") if c in _NUMBERS else value(c).cast("boolean") if c in flags else value(c)
    return scores.select("id", "type", *[cast(c).alias(c) for c in names], F.map_filter("fields", lambda k, _: ~k.isin(*names)).alias("other_fields"))
