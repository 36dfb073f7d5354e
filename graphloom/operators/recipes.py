"""Analyst queries over objects and relationship tables.

Objects: id, type, name, aliases, external_references, kill_chain_phases, x_mitre_platforms, x_mitre_is_subtechnique, description,
created, modified, revoked, x_mitre_deprecated, tactic_refs. Relationships: source_ref, target_ref, relationship_type, revoked,
x_mitre_deprecated. Missing flags count as false. Results are long tables (one row a pair) and can be grouped with `collected`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _false(flag: str) -> Column:
    return ~F.coalesce(F.col(flag), F.lit(False))


def active(df: DataFrame) -> DataFrame:
    """Without revoked and deprecated rows."""
    return df.where(_false("revoked") & _false("x_mitre_deprecated"))


def by_stix_id(objects: DataFrame, stix_id: str) -> DataFrame:
    return objects.where(F.col("id") == stix_id)


def by_attack_id(objects: DataFrame, code: str, kind: str | None = None) -> DataFrame:
    hit = F.exists("external_references", lambda r: r["external_id"] == code)
    return objects.where(hit & (F.col("type") == kind if kind else F.lit(True)))


def by_name(objects: DataFrame, kind: str, name: str) -> DataFrame:
    return objects.where((F.col("type") == kind) & (F.col("name") == name))


def by_alias(objects: DataFrame, alias: str, kind: str = "intrusion-set") -> DataFrame:
    return objects.where((F.col("type") == kind) & F.array_contains("aliases", alias))


def by_type(objects: DataFrame, *kinds: str) -> DataFrame:
    return objects.where(F.col("type").isin(*kinds))


def software(objects: DataFrame) -> DataFrame:
    return by_type(objects, "tool", "malware")


def techniques(objects: DataFrame, include: str = "both") -> DataFrame:
    """include: techniques, subtechniques or both."""
    if include not in ("techniques", "subtechniques", "both"):
        raise ValueError(f"unknown option {include!r}")
    found = by_type(objects, "attack-pattern")
    sub = F.coalesce(F.col("x_mitre_is_subtechnique"), F.lit(False))
    return found if include == "both" else found.where(sub if include == "subtechniques" else ~sub)


def by_content(objects: DataFrame, content: str, kind: str = "attack-pattern") -> DataFrame:
    """Description holds the content, whatever its case; a missing description holds nothing."""
    return by_type(objects, kind).where(F.contains(F.lower("description"), F.lit(content.lower())))


def by_platform(objects: DataFrame, platform: str, kind: str = "attack-pattern") -> DataFrame:
    return by_type(objects, kind).where(F.array_contains("x_mitre_platforms", platform))


def by_tactic(objects: DataFrame, tactic: str, kill_chain: str = "mitre-attack") -> DataFrame:
    """Some phase has the tactic's name and some phase, not necessarily the same one, has the kill chain."""
    phase = F.exists("kill_chain_phases", lambda p: p["phase_name"] == tactic) & F.exists("kill_chain_phases", lambda p: p["kill_chain_name"] == kill_chain)
    return by_type(objects, "attack-pattern").where(phase)


def since(objects: DataFrame, timestamp: str, field: str = "modified") -> DataFrame:
    return objects.where(F.to_timestamp(field) > F.lit(timestamp).cast("timestamp"))


def tactics_in_order(objects: DataFrame) -> DataFrame:
    """(matrix_id, matrix, pos, tactic_id, tactic): a matrix's tactics in the order of its references."""
    refs = by_type(objects, "x-mitre-matrix").select(F.col("id").alias("matrix_id"), F.col("name").alias("matrix"), F.posexplode("tactic_refs").alias("pos", "tactic_id"))
    return refs.join(by_type(objects, "x-mitre-tactic").select(F.col("id").alias("tactic_id"), F.col("name").alias("tactic")), "tactic_id").select("matrix_id", "matrix", "pos", "tactic_id", "tactic")


def related(objects: DataFrame, links: DataFrame, source_type: str, kind: str, target_type: str, reverse: bool = False) -> DataFrame:
    """(id, related_id, relationship): of active links of this kind between these types, the pairs whose far end is not revoked (it may be deprecated).

    Forward: id is the source; reverse: id is the target. Without a far end a pair is left out.
    """
    of = lambda ref, t: F.startswith(F.col(ref), F.lit(f"{t}--"))
    found = active(links).where((F.col("relationship_type") == kind) & of("source_ref", source_type) & of("target_ref", target_type))
    near, far = ("target_ref", "source_ref") if reverse else ("source_ref", "target_ref")
    ends = objects.where(_false("revoked")).select(F.col("id").alias("end"))
    return found.join(ends, F.col(far) == F.col("end")).select(F.col(near).alias("id"), F.col(far).alias("related_id"), F.col("id").alias("relationship"))


def collected(pairs: DataFrame) -> DataFrame:
    """One row for each id with its related objects in order."""
    return pairs.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("related_id", "relationship"))).alias("related"))


_SOFTWARE, _GROUP, _CAMPAIGN, _TECHNIQUE = ("tool", "malware"), ("intrusion-set",), ("campaign",), ("attack-pattern",)
#: A relation: types of its source, kind of link, types of its target, and whether groups stand for the campaigns attributed to them too.
RELATIONS = {
    "group uses software": (_GROUP, "uses", _SOFTWARE, True),
    "group uses technique": (_GROUP, "uses", _TECHNIQUE, True),
    "campaign uses software": (_CAMPAIGN, "uses", _SOFTWARE, False),
    "campaign uses technique": (_CAMPAIGN, "uses", _TECHNIQUE, False),
    "campaign attributed to group": (_CAMPAIGN, "attributed-to", _GROUP, False),
    "software uses technique": (_SOFTWARE, "uses", _TECHNIQUE, False),
    "mitigation mitigates technique": (("course-of-action",), "mitigates", _TECHNIQUE, False),
    "strategy detects technique": (("x-mitre-detection-strategy",), "detects", _TECHNIQUE, False),
    "component detects technique": (("x-mitre-data-component",), "detects", _TECHNIQUE, False),
    "subtechnique of technique": (_TECHNIQUE, "subtechnique-of", _TECHNIQUE, False),
    "technique targets asset": (_TECHNIQUE, "targets", ("x-mitre-asset",), False),
}


def relation(objects: DataFrame, links: DataFrame, name: str, reverse: bool = False) -> DataFrame:
    """(id, related_id, relationship) of a named relation; reverse: from target to source.

    Where campaigns count for their groups, the pair's relationship is the campaign's own link.
    """
    sources, kind, targets, by_campaign = RELATIONS[name]
    parts = [related(objects, links, s, kind, t, reverse) for s in sources for t in targets]
    if by_campaign:
        attributed = related(objects, links, "campaign", "attributed-to", "intrusion-set").select(F.col("id").alias("campaign"), F.col("related_id").alias("group"))
        for t in targets:
            used = related(objects, links, "campaign", kind, t).select(F.col("id").alias("campaign"), "related_id", "relationship")
            near, far = ("related_id", "group") if reverse else ("group", "related_id")
            parts.append(attributed.join(used, "campaign").select(F.col(near).alias("id"), F.col(far).alias("related_id"), "relationship"))
    return reduce(DataFrame.unionByName, parts).distinct()


def relation_path(objects: DataFrame, links: DataFrame, first: str, second: str) -> DataFrame:
    """(id, via, related_id): two relations one after the other, such as the techniques of the software that a group uses."""
    near = relation(objects, links, first).select("id", F.col("related_id").alias("via"))
    return near.join(relation(objects, links, second).select(F.col("id").alias("via"), "related_id"), "via").select("id", "via", "related_id").distinct()


def revoking_object(objects: DataFrame, links: DataFrame, revoked_id: str) -> DataFrame:
    """The object that replaces a revoked one; none if nothing does."""
    by = links.where((F.col("relationship_type") == "revoked-by") & (F.col("source_ref") == revoked_id)).select(F.col("target_ref").alias("id"))
    return objects.where(_false("revoked")).join(by, "id", "left_semi").orderBy("id").limit(1)
