"""The catalogs' plans as queries: driver tables are written as catalog JSON, the plans read that, and DuckDB SQL states the same result from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import identity
from graphloom.operators import graph, links
from graphloom.plans import attack, capec, cve, cwe, defend
from graphloom.queries import _duck_edge, _duck_uuid5, _t, query

Q = "'"


def _lit(text: str) -> str:
    return Q + text + Q


def _edge(namespace: str, source: str, kind: str, target: str, **seeds: str) -> str:
    """An edge's id in SQL; seeds are SQL texts that are null where the attribute is absent."""
    extra = "".join(f"||coalesce('|{name}='||{value}, '')" for name, value in sorted(seeds.items()))
    return _duck_edge(namespace, source, _lit(kind), target, extra)


def _node(namespace: str, kind: str, seed: str) -> str:
    return f"'{kind}--'||" + _duck_uuid5(f"('{namespace}:{kind}:'||{seed})")


def _raw(df: DataFrame, **fields: Column) -> DataFrame:
    """(file, pos, raw): a row's fields as one JSON object, null ones left out; dots in names stand for @ and colons."""
    one = F.struct(*[c.alias(n) for n, c in fields.items()])
    return df.select(F.lit("table").alias("file"), F.col("pos").cast("int").alias("pos"), F.to_json(one).alias("raw"))


_EDGE = ["id", "relationship_type", "source_ref", "target_ref"]


# ---- vulnerabilities: an order each ----

_ISO = "yyyy-MM-dd'T'HH:mm:ss"


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", _ISO)
    text = lambda lang, value: F.struct(F.lit(lang).alias("lang"), value.alias("value"))
    label = lambda *names: F.struct(F.array(*[text("en", n) for n in names]).alias("description"))
    first, other = F.concat(F.lit("CWE-"), F.col("o_custkey") % 40), F.concat(F.lit("CWE-"), k % 7)
    score = lambda source, kind, **data: F.array(F.struct(F.lit(source).alias("source"), F.lit(kind).alias("type"), F.struct(*[v.alias(n) for n, v in data.items()]).alias("cvssData"), (k % 4).alias("exploitabilityScore")))
    points = k % 10
    v2 = F.array(F.struct(F.lit("x").alias("source"), F.lit("Secondary").alias("type"), F.struct(F.lit("2.0").alias("version"), points.alias("baseScore"), F.lit("NETWORK").alias("accessVector")).alias("cvssData"), F.lit("LOW").alias("baseSeverity"), F.lit(True).alias("userInteractionRequired")))
    ssvc = F.array(F.struct(F.lit("cisa").alias("source"), F.struct(F.lit("drop").alias("id"), F.lit("R").alias("role"), F.array(F.struct(F.lit("none").alias("Exploitation"), F.lit(None).cast("string").alias("Automatable")), F.struct(F.lit(None).cast("string").alias("Exploitation"), F.lit("yes").alias("Automatable"))).alias("options")).alias("ssvcData")))
    metrics = F.struct(
        F.when(k % 3 == 0, v2).alias("cvssMetricV2"), F.when(k % 2 == 0, score("nvd", "Primary", version=F.lit("3.1"), baseScore=points, vectorString=F.lit("V"))).alias("cvssMetricV31"),
        F.when(k % 5 == 0, score("nvd", "Primary", version=F.lit("4.0"), baseScore=points, attackVector=F.lit("LOCAL"), modifiedAttackVector=F.lit("NOT_DEFINED"))).alias("cvssMetricV40"), F.when(k % 7 == 0, ssvc).alias("ssvcV203"),
    )
    item = F.struct(
        F.concat(F.lit("CVE-"), 2000 + k % 20, F.lit("-"), F.lpad(k.cast("string"), 7, "0")).alias("id"), F.concat(day, F.lit(".000")).alias("published"), F.when(k % 2 == 0, day).otherwise(F.concat(day, F.lit(".250"))).alias("lastModified"),
        F.when(F.col("o_orderstatus") == "P", "Rejected").otherwise("Analyzed").alias("vulnStatus"), F.lit("src").alias("sourceIdentifier"),
        F.when(k % 2 == 0, F.array(text("fr", F.lit("x")), text("en", F.col("o_orderpriority")))).otherwise(F.array(text("fr", F.col("o_orderpriority")))).alias("descriptions"),
        F.array(F.struct(F.lit("http://a").alias("url"), F.lit("").alias("source")), F.struct(F.lit("").alias("url"), F.lit("s").alias("source"))).alias("references"),
        F.array(label(first, F.lit("NVD-CWE-Other")), label(first, other)).alias("weaknesses"), metrics.alias("metrics"),
    )
    return o.select(k.alias("pos"), F.to_json(F.struct(item.alias("cve"))).alias("raw"))


_CVE = "(SELECT o_orderkey AS k, 'CVE-'||(2000 + o_orderkey % 20)||'-'||lpad(o_orderkey::VARCHAR, 7, '0') AS cve, 'CWE-'||(o_custkey % 40) AS w1, 'CWE-'||(o_orderkey % 7) AS w2, o_orderpriority, o_orderstatus, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS day FROM orders)"
_CVE_LIVE = f"(SELECT * FROM {_CVE} WHERE o_orderstatus <> 'P')"


@query(
    f"SELECT cve AS name, 'vulnerability--'||{_duck_uuid5('(' + Q + 'cve:' + Q + '||cve)')} AS id, day||'.000Z' AS created, day||CASE WHEN k % 2 = 0 THEN '.000Z' ELSE '.250Z' END AS modified, o_orderpriority AS description, CASE WHEN w1 = w2 THEN w1||',NVD-CWE-Other' ELSE w1||',NVD-CWE-Other,'||w2 END AS weaknesses, 'cve,nvd' AS reference_sources, 2000 + k % 20 AS year FROM {_CVE}"
)
def feed_objects(spark, sf_dir):  # noqa: ANN001, ANN201
    """Records of the vulnerability feed as objects."""
    o = cve.to_objects(_feed(spark, sf_dir))
    return o.select("name", "id", "created", "modified", "description", F.array_join("x_nvd_weaknesses", ",").alias("weaknesses"), F.array_join(F.transform("external_references", lambda r: r["source_name"]), ",").alias("reference_sources"), F.col("year").cast("bigint").alias("year"))


def _cve_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return cve.tables(graph.materialize(cve.bundle_objects(_feed(spark, sf_dir)).withColumn("pos", F.lit(0)), "bronze"))


@query(f"SELECT cve AS id, day||'.000Z' AS created, o_orderpriority AS description, 'Analyzed' AS x_nvd_vuln_status, 'src' AS x_nvd_source_identifier FROM {_CVE_LIVE}")
def vulnerability_table(spark, sf_dir):  # noqa: ANN001, ANN201
    """Rejected vulnerabilities go."""
    return _cve_tables(spark, sf_dir)["vulnerability"].select("id", "created", "description", "x_nvd_vuln_status", "x_nvd_source_identifier")


@query(f"SELECT {_edge('cve-preprocessing', 'cve', 'related-to', 'w')} AS id, 'related-to' AS relationship_type, cve AS source_ref, w AS target_ref, 'cwe' AS source_name FROM (SELECT cve, unnest(list_distinct([w1, w2])) AS w FROM {_CVE_LIVE})")
def vulnerability_weakness_edges(spark, sf_dir):  # noqa: ANN001, ANN201
    """Labels that name a weakness."""
    return _cve_tables(spark, sf_dir)["external-relationship"].select(*_EDGE, "source_name")


_FLAT = {
    "cvssMetricV31": ("cvss-v3-score", "has_cvss_v3_score", 2, "'{\"assessment_type\": \"Primary\", \"base_score\": '||(k % 10)||', \"exploitability_score\": '||(k % 4)||', \"source\": \"nvd\", \"vector_string\": \"V\", \"version\": \"3.1\"}'"),
    "cvssMetricV2": ("cvss-v2-score", "has_cvss_v2_score", 3, "'{\"access_vector\": \"NETWORK\", \"assessment_type\": \"Secondary\", \"base_score\": '||(k % 10)||', \"base_severity\": \"LOW\", \"source\": \"x\", \"user_interaction_required\": true, \"version\": \"2.0\"}'"),
    "cvssMetricV40": ("cvss-v4-score", "has_cvss_v4_score", 5, "'{\"assessment_type\": \"Primary\", \"attack_vector\": \"LOCAL\", \"base_score\": '||(k % 10)||', \"exploitability_score\": '||(k % 4)||', \"source\": \"nvd\", \"version\": \"4.0\"}'"),
    "ssvcV203": ("ssvc-assessment", "has_ssvc_assessment", 7, "'{\"automatable\": \"yes\", \"exploitation\": \"none\", \"role\": \"R\", \"source\": \"cisa\"}'"),
}
_SCORED = " UNION ALL ".join(f"SELECT cve, k, '{kind}' AS type, '{verb}' AS verb, {_node('cve-preprocessing', kind, f'cve||{_lit(f"|{metric}|0|")}||{flat}')} AS id FROM {_CVE_LIVE} WHERE k % {every} = 0" for metric, (kind, verb, every, flat) in _FLAT.items())


@query(f"SELECT 'relationship--'||{_duck_uuid5(f'({_lit("cve-preprocessing:")}||cve||{_lit("|")}||verb||{_lit("|")}||id)')} AS id, verb AS relationship_type, cve AS source_ref, id AS target_ref FROM ({_SCORED})")
def vulnerability_score_edges(spark, sf_dir):  # noqa: ANN001, ANN201
    """An edge for each score, whose identity hashes the score's flat form."""
    return _cve_tables(spark, sf_dir)["relationship"].select(*_EDGE)


@query(f"SELECT id, type, CASE WHEN type = 'ssvc-assessment' THEN NULL ELSE (k % 10)::DOUBLE END AS base_score, CASE type WHEN 'cvss-v2-score' THEN 'x' WHEN 'ssvc-assessment' THEN 'cisa' ELSE 'nvd' END AS source, CASE type WHEN 'cvss-v2-score' THEN 'NETWORK' WHEN 'cvss-v4-score' THEN 'LOCAL' WHEN 'ssvc-assessment' THEN 'none' END AS detail FROM ({_SCORED})")
def vulnerability_scores(spark, sf_dir):  # noqa: ANN001, ANN201
    """The four score tables; fields that are never set are left out."""
    t = _cve_tables(spark, sf_dir)
    none = F.lit(None)
    part = lambda kind, score, detail: t[kind].select("id", "type", score.cast("double").alias("base_score"), "source", detail.cast("string").alias("detail"))
    parts = [part("cvss-v2-score", F.col("base_score"), F.col("access_vector")), part("cvss-v3-score", F.col("base_score"), F.try_element_at("other_fields", F.lit("none"))), part("cvss-v4-score", F.col("base_score"), F.col("attack_vector")), part("ssvc-assessment", none, F.col("exploitation"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _bronze(spark: SparkSession, sf_dir: str, table: str, position: str, text: str) -> DataFrame:
    """Objects written as JSON by a SQL text that both engines read alike."""
    return graph.materialize(_t(spark, sf_dir, table).select(F.lit(table).alias("file"), F.expr(f"cast({position} as int)").alias("pos"), F.expr(text).alias("raw")), "bronze")


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


# ---- weaknesses: a part each ----

_PART_KIND = "CASE WHEN p_size % 10 = 0 THEN 'category' WHEN p_size % 10 = 1 THEN 'view' ELSE 'weakness' END"
_K = "cast(p_partkey as string)"
_WEAKNESS_JSON = f"""'{{"type":"'||{_PART_KIND}||'","id":"CWE-'||{_K}||'","cwe_id":"'||{_K}||'","Name":"'||p_name||'","Status":"Draft","created":"c","modified":"m"'||CASE {_PART_KIND} WHEN 'weakness' THEN
  ',"Description":"'||p_type||'","ExtendedDescription":{{"p":["one","two"],"ul":{{"li":["x","y"]}}}},"WeaknessOrdinalities":{{"WeaknessOrdinality":{{"Ordinality":"Primary"}}}}'
  ||',"AlternateTerms":{{"AlternateTerm":[{{"Term":"T'||{_K}||'","Description":"dsc"}},{{"Term":"T'||{_K}||'"}}]}}'
  ||',"RelatedWeaknesses":{{"RelatedWeakness":'||CASE WHEN p_partkey % 2 = 0 THEN '{{"Nature":"ChildOf","CWE_ID":"'||cast(p_partkey + 1 as string)||'","View_ID":"1000","Ordinal":"Primary"}}' ELSE '[{{"Nature":"PeerOf","CWE_ID":"'||cast(p_partkey + 2 as string)||'"}},{{"Nature":"CanPrecede","CWE_ID":"3"}}]' END||'}}'
  ||',"CommonConsequences":{{"Consequence":{{"Scope":["Integrity","Availability"],"Impact":"'||p_brand||'","Note":{{"p":["a","'||{_K}||'"]}}}}}}'
  ||',"ApplicablePlatforms":{{"Language":{{"Name":"'||p_type||'","Prevalence":"Often"}},"Technology":[{{"Class":"Web"}}]}}'
  ||',"ModesOfIntroduction":{{"Introduction":[{{"Phase":"Design"}},{{"Phase":"'||p_brand||'","Note":"n"}}]}}'
  ||',"PotentialMitigations":{{"Mitigation":[{{"Mitigation_ID":"MIT-'||cast(p_partkey % 5 as string)||'","Phase":["Design","Use"],"Description":{{"p":"d"}},"Effectiveness":"High"}},{{"Phase":"Operation","Strategy":"S","Description":"priv"}}]}}'
  ||',"DetectionMethods":{{"DetectionMethod":{{"Detection_Method_ID":"DM-'||cast(p_partkey % 3 as string)||'","Method":"Fuzzing","Description":"x"}}}}'
  ||',"RelatedAttackPatterns":{{"RelatedAttackPattern":{{"CAPEC_ID":"'||{_K}||'"}}}}'
  ||',"ObservedExamples":{{"ObservedExample":[{{"Reference":"[CVE-2020-'||cast(1000 + p_partkey as string)||']","Description":"dd","Link":"l"}},{{"Reference":"CVE-12","Description":"bad"}}]}}'
  WHEN 'category' THEN ',"Summary":"s","Relationships":{{"HasMember":[{{"CWE_ID":"'||cast(p_partkey + 3 as string)||'","View_ID":"1"}}]}}'
  ELSE ',"Type":"Graph","Objective":{{"p":"o"}},"Audience":{{"Stakeholder":[{{"Type":"A"}},{{"Type":"B"}}]}},"Members":{{"HasMember":{{"CWE_ID":"'||cast(p_partkey + 4 as string)||'"}}}}' END||'}}'"""
_CWE_NS = "cwe-preprocessing"
_PARTS = f"(SELECT *, p_partkey AS k, 'CWE-'||p_partkey AS s, {_PART_KIND} AS kind FROM part)"
_W = f"(SELECT * FROM {_PARTS} WHERE kind = 'weakness')"
_CONSEQUENCE = _node(_CWE_NS, "consequence", "'scope=Availability,Integrity|impact='||p_brand")
_LANGUAGE, _TECHNOLOGY = _node(_CWE_NS, "platform", "'Language|'||p_type"), _node(_CWE_NS, "platform", "'Technology|private|'||s||'|0'")
_MITIGATION, _PRIVATE = _node(_CWE_NS, "mitigation", "'MIT-'||(k % 5)"), _node(_CWE_NS, "mitigation", "'private|'||s||'|1'")
_DETECTION = _node(_CWE_NS, "detection-method", "'DM-'||(k % 3)")


def _cwe_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return cwe.tables(_bronze(spark, sf_dir, "part", "p_partkey", _WEAKNESS_JSON))


def _cwe_edge(target: str, kind: str, where: str = "", of: str = _W, **seeds: str) -> str:
    return f"SELECT {_edge(_CWE_NS, 's', kind, 't', **seeds)} AS id, '{kind}' AS relationship_type, s AS source_ref, t AS target_ref FROM (SELECT *, {target} AS t FROM {of} {where})"


@query(
    _union(
        [
            _cwe_edge("'CWE-'||(k + 1)", "child_of", "WHERE k % 2 = 0", ordinal="'Primary'", view_id="'1000'"), _cwe_edge("'CWE-'||(k + 2)", "peer_of", "WHERE k % 2 = 1"), _cwe_edge("'CWE-3'", "can_precede", "WHERE k % 2 = 1"),
            _cwe_edge("'CWE-'||(k + 3)", "has_member", "WHERE kind = 'category'", _PARTS, view_id="'1'"), _cwe_edge("'CWE-'||(k + 4)", "has_member", "WHERE kind = 'view'", _PARTS),
            _cwe_edge(_CONSEQUENCE, "has_consequence", note="'a'||chr(10)||k"), _cwe_edge(_LANGUAGE, "applies_to_platform", prevalence="'Often'"), _cwe_edge(_TECHNOLOGY, "applies_to_platform", **{"class": "'Web'"}),
            _cwe_edge(_node(_CWE_NS, "introduction", "'Design'"), "introduced_in"), _cwe_edge(_node(_CWE_NS, "introduction", "p_brand"), "introduced_in", note="'n'"),
            _cwe_edge(_MITIGATION, "has_mitigation", description="'d'", effectiveness="'High'", phase="'[''Design'', ''Use'']'"), _cwe_edge(_PRIVATE, "has_mitigation"), _cwe_edge(_DETECTION, "has_detection_method", description="'x'", method="'Fuzzing'"),
        ]
    )
)
def weakness_edges(spark, sf_dir):  # noqa: ANN001, ANN201
    """Edges of weaknesses, categories and views."""
    return _cwe_tables(spark, sf_dir)["relationship"].select(*_EDGE)


@query(
    _union(
        [
            f"SELECT id, relationship_type, source_ref, target_ref, 'capec' AS source_name, NULL AS link FROM ({_cwe_edge("'CAPEC-'||k", 'related-to', source_name=_lit('capec'))})",
            f"SELECT id, relationship_type, source_ref, target_ref, 'cve', 'l' FROM ({_cwe_edge("'CVE-2020-'||(1000 + k)", 'related-to', description=_lit('dd'), link=_lit('l'), source_name=_lit('cve'))})",
        ]
    )
)
def weakness_external_edges(spark, sf_dir):  # noqa: ANN001, ANN201
    """Related attack patterns, and observed examples whose CVE id is well formed."""
    return _cwe_tables(spark, sf_dir)["external-relationship"].select(*_EDGE, "source_name", "link")


@query(f"SELECT s AS id, p_name AS name, p_type AS description, 'one'||chr(10)||'two'||chr(10)||chr(10)||'- x'||chr(10)||'- y' AS extended, 'Primary' AS ordinalities, 'T'||k AS aliases, 'T'||k||' -- dsc' AS notes, 'weakness' AS type FROM {_W} UNION ALL SELECT s, p_name, 's', NULL, NULL, NULL, NULL, 'category' FROM {_PARTS} WHERE kind = 'category' UNION ALL SELECT s, p_name, NULL, 'o', 'A,B', NULL, 'Graph', 'view' FROM {_PARTS} WHERE kind = 'view'")
def weakness_entities(spark, sf_dir):  # noqa: ANN001, ANN201
    """Weaknesses, categories and views with flattened markup."""
    t = _cwe_tables(spark, sf_dir)
    none = F.lit(None).cast("string")
    join = lambda c: F.array_join(c, ",")
    part = lambda df, description, extended, ordinals, aliases, notes: df.select("id", "name", description.alias("description"), extended.alias("extended"), ordinals.alias("ordinalities"), aliases.alias("aliases"), notes.alias("notes"), "type")
    w = part(t["weakness"], F.col("description"), F.col("extended_description"), join("weakness_ordinalities"), join("aliases"), join("alias_notes"))
    return w.unionByName(part(t["category"], F.col("summary"), none, none, none, none)).unionByName(part(t["view"], none, F.col("objective"), join("audience"), none, F.col("view_type")))


@query(
    _union(
        [
            f"SELECT DISTINCT {_CONSEQUENCE} AS id, 'consequence' AS type, p_brand AS detail FROM {_W}", f"SELECT DISTINCT {_LANGUAGE}, 'platform', p_type FROM {_W}", f"SELECT {_TECHNOLOGY}, 'platform', NULL FROM {_W}",
            f"SELECT DISTINCT {_MITIGATION}, 'mitigation', NULL FROM {_W}", f"SELECT {_PRIVATE}, 'mitigation', 'priv' FROM {_W}", f"SELECT DISTINCT {_DETECTION}, 'detection-method', NULL FROM {_W}",
            f"SELECT DISTINCT {_node(_CWE_NS, 'introduction', 'ph')}, 'introduction', ph FROM (SELECT 'Design' AS ph FROM {_W} UNION SELECT p_brand FROM {_W})",
        ]
    )
)
def weakness_shared_nodes(spark, sf_dir):  # noqa: ANN001, ANN201
    """Shared nodes by their natural key, private ones with their own detail."""
    t = _cwe_tables(spark, sf_dir)
    part = lambda name, detail: t[name].select("id", "type", detail.cast("string").alias("detail"))
    parts = [part("consequence", F.array_join("impact", ",")), part("platform", F.col("name")), part("mitigation", F.col("description")), part("detection-method", F.col("description")), part("introduction", F.col("phase"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"SELECT 'observed example' AS type, 'malformed CVE id' AS reason, count(*) AS n FROM {_W}")
def weakness_rejects(spark, sf_dir):  # noqa: ANN001, ANN201
    """What takes no part."""
    return _cwe_tables(spark, sf_dir)["dropped"].select("type", "reason", "n")


# ---- attack patterns: a customer each; nations mitigate ----

_PATTERN_JSON = """'{"type":"attack-pattern","id":"attack-pattern--'||cast(c_custkey as string)||'","name":"'||c_name||'","description":"'||c_mktsegment||'","x_capec_version":"3.9","x_capec_alternate_terms":["a","a",""]'
  ||',"external_references":[{"source_name":"capec","external_id":"CAPEC-'||cast(c_custkey as string)||'"},{"source_name":"cwe","external_id":"CWE-'||cast(c_custkey % 9 as string)||'"},{"source_name":"ATTACK","external_id":"T'||cast(1000 + c_custkey % 50 as string)||'"},{"source_name":"reference_from_CAPEC","external_id":"REF-1"}]'
  ||CASE WHEN c_custkey > 0 THEN ',"x_capec_child_of_refs":["attack-pattern--'||cast(c_custkey - 1 as string)||'"],"x_capec_can_precede_refs":["attack-pattern--0"]' ELSE '' END
  ||',"x_capec_peer_of_refs":["attack-pattern--'||cast(CASE WHEN c_custkey % 2 = 0 THEN c_custkey + 1 ELSE c_custkey - 1 END as string)||'"]'
  ||',"x_capec_consequences":{"Access_Control":["Gain ('||c_mktsegment||')","Gain ('||c_mktsegment||')"],"Integrity":["Modify"]}}'"""
_CAPEC_NS = "capec-preprocessing"
_C = "(SELECT *, c_custkey AS k, 'CAPEC-'||c_custkey AS s FROM customer)"
_GAIN, _MODIFY = _node(_CAPEC_NS, "consequence", "'scope=Access Control|impact=Gain'"), _node(_CAPEC_NS, "consequence", "'scope=Integrity|impact=Modify'")


def _capec_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    actions = """'{"type":"course-of-action","id":"course-of-action--'||cast(n_nationkey as string)||'","name":"'||n_name||'"}'"""
    links = """'{"type":"relationship","id":"relationship--'||cast(n_nationkey as string)||'","relationship_type":"mitigates","source_ref":"course-of-action--'||cast(n_nationkey as string)||'","target_ref":"attack-pattern--'||cast(n_nationkey as string)||'"}'"""
    parts = [_bronze(spark, sf_dir, "customer", "c_custkey", _PATTERN_JSON), _bronze(spark, sf_dir, "nation", "n_nationkey", actions), _bronze(spark, sf_dir, "nation", "n_nationkey", links), _bronze(spark, sf_dir, "region", "r_regionkey", """'{"type":"identity","id":"identity--'||cast(r_regionkey as string)||'"}'""")]
    return capec.tables(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))


def _capec_edge(target: str, kind: str, where: str = "", of: str = _C, source: str = "s") -> str:
    return f"SELECT {_edge(_CAPEC_NS, 's2', kind, 't')} AS id, '{kind}' AS relationship_type, s2 AS source_ref, t AS target_ref FROM (SELECT *, {source} AS s2, {target} AS t FROM {of} {where})"


@query(
    _union(
        [
            _capec_edge("'CAPEC-'||(k - 1)", "child_of", "WHERE k > 0"), _capec_edge("'CAPEC-0'", "can_precede", "WHERE k > 0"),
            _capec_edge("'CAPEC-'||(k + 1)", "peer_of", "WHERE k % 2 = 0"), _capec_edge(_GAIN, "has_consequence"), _capec_edge(_MODIFY, "has_consequence"),
        ]
    )
)
def attack_pattern_edges(spark, sf_dir):  # noqa: ANN001, ANN201
    """Reference lists, peers once, consequences once."""
    return _capec_tables(spark, sf_dir)["attack-pattern-relationship"].select(*_EDGE)


@query(_union([f"SELECT *, 'cwe' AS source_name FROM ({_capec_edge("'CWE-'||(k % 9)", 'related-to')})", f"SELECT *, 'ATTACK' FROM ({_capec_edge("'T'||(1000 + k % 50)", 'related-to')})"]))
def attack_pattern_external_edges(spark, sf_dir):  # noqa: ANN001, ANN201
    """References to other catalogs."""
    return _capec_tables(spark, sf_dir)["external-relationship"].select(*_EDGE, "source_name")


@query("SELECT 'relationship--'||n_nationkey AS id, 'mitigates' AS relationship_type, 'course-of-action--'||n_nationkey AS source_ref, 'CAPEC-'||n_nationkey AS target_ref FROM nation")
def attack_pattern_native_edges(spark, sf_dir):  # noqa: ANN001, ANN201
    """Native edges with the references that are known."""
    return _capec_tables(spark, sf_dir)["relationship"].select(*_EDGE)


@query(f"SELECT s AS id, 'attack-pattern' AS type, c_name AS name, c_mktsegment AS description, 'a' AS detail FROM {_C} UNION ALL SELECT 'course-of-action--'||n_nationkey, 'course-of-action', n_name, NULL, NULL FROM nation UNION ALL SELECT DISTINCT {_GAIN}, 'consequence', NULL, NULL, 'Access Control' FROM region UNION ALL SELECT DISTINCT {_MODIFY}, 'consequence', NULL, NULL, 'Integrity' FROM region UNION ALL SELECT '3.9', 'version', NULL, NULL, NULL UNION ALL SELECT 'identity', 'dropped', 'boilerplate', NULL, count(*)::VARCHAR FROM region")
def attack_pattern_entities(spark, sf_dir):  # noqa: ANN001, ANN201
    """Attack patterns, courses of action, consequences, the catalog's version and what takes no part."""
    t, none = _capec_tables(spark, sf_dir), F.lit(None).cast("string")
    bronze = _bronze(spark, sf_dir, "customer", "c_custkey", _PATTERN_JSON)
    part = lambda df, i, kind, name, description, detail: df.select(i.alias("id"), kind.alias("type"), name.alias("name"), description.alias("description"), detail.alias("detail"))
    c = F.col
    return (
        part(t["attack-pattern"], c("id"), c("type"), c("name"), c("description"), F.array_join("aliases", ","))
        .unionByName(part(t["course-of-action"], c("id"), c("type"), c("name"), c("description"), none))
        .unionByName(part(t["consequence"], c("id"), c("type"), none, none, F.array_join("scope", ",")))
        .unionByName(part(capec.version(bronze), c("version"), F.lit("version"), none, none, none))
        .unionByName(part(t["dropped"], c("type"), F.lit("dropped"), c("reason"), none, c("n").cast("string")))
    )


# ---- techniques: customers are techniques, regions tactics and matrices, suppliers malware, nations what detects ----


def _attack_json(kind: str, number: str, code: str | None, more: str = "''", modified: str = "2020-01-01T00:00:00.000Z", name: str | None = None) -> str:
    """A bundle object as a SQL text; number and code are SQL texts."""
    refs = f"""'{{"source_name":"mitre-attack","external_id":"'||{code}||'"}}'""" if code else "''"
    return f"""'{{"type":"{kind}","id":"{kind}--'||cast({number} as string)||'","name":"'||{name or "'n'||cast(" + number + " as string)"}||'","modified":"{modified}","external_references":['||{refs}||']'||{more}||'}}'"""


_TECH = "'T'||cast(1000 + c_custkey as string)"
_CHAIN = """',"x_mitre_domains":["enterprise-attack"],"kill_chain_phases":[{"kill_chain_name":"mitre-attack","phase_name":"p'||cast(c_custkey % 5 as string)||'"},{"kill_chain_name":"other","phase_name":"x"}],"revoked":false'"""
_CAPEC_REF = _attack_json("attack-pattern", "c_custkey", _TECH, _CHAIN, name="c_name").replace("""||'"}'||']'""", """||'"},{"source_name":"capec","external_id":"CAPEC-'||cast(c_custkey % 7 as string)||'"}'||']'""")
_ATTACK = {
    0: [
        ("customer", _CAPEC_REF),
        ("customer", f"CASE WHEN c_custkey % 10 = 0 THEN {_attack_json('course-of-action', 'c_custkey', _TECH)} END"),
        ("region", _attack_json("x-mitre-tactic", "r_regionkey", "'TA'||cast(r_regionkey as string)", """',"x_mitre_shortname":"p'||cast(r_regionkey as string)||'","x_mitre_domains":["enterprise-attack","mobile-attack"]'""")),
        ("region", _attack_json("x-mitre-matrix", "r_regionkey", "'M'||cast(r_regionkey as string)", """',"tactic_refs":["x-mitre-tactic--'||cast(r_regionkey as string)||'","x-mitre-tactic--0"]'""")),
        ("supplier", _attack_json("malware", "s_suppkey", "'S'||cast(floor(s_suppkey / 2) as int)", """',"x_mitre_aliases":["'||s_name||'"]'||CASE WHEN s_suppkey % 2 = 0 THEN ',"revoked":true' ELSE '' END""")),
        ("nation", _attack_json("campaign", "n_nationkey", None, """',"first_seen":"2019"'""")),
        ("nation", _attack_json("x-mitre-detection-strategy", "n_nationkey", "'DET'||cast(n_nationkey as string)", """',"x_mitre_analytic_refs":["x-mitre-analytic--'||cast(n_nationkey as string)||'"]'""")),
        ("nation", _attack_json("x-mitre-analytic", "n_nationkey", "'AN'||cast(n_nationkey as string)", """',"x_mitre_log_source_references":[{"x_mitre_data_component_ref":"x-mitre-data-component--'||cast(n_nationkey % 5 as string)||'","name":"L'||cast(n_nationkey % 3 as string)||'","channel":"'||CASE WHEN n_nationkey % 2 = 0 THEN 'None' ELSE 'c' END||'"}],"x_mitre_mutable_elements":[{"field":"f","description":"d"},{"field":"f"},{"field":""}]'""")),
        ("region", _attack_json("x-mitre-data-component", "r_regionkey", "'DC'||cast(r_regionkey as string)", """',"x_mitre_log_sources":[{"name":"S'||cast(r_regionkey as string)||'","channel":" "},{"name":""}]'""")),
        ("supplier", """'{"type":"relationship","id":"relationship--'||cast(s_suppkey as string)||'","relationship_type":"uses","modified":"2020-01-01T00:00:00Z","source_ref":"malware--'||cast(s_suppkey as string)||'","target_ref":"attack-pattern--'||cast(s_suppkey as string)||'"}'"""),
        ("region", """'{"type":"identity","id":"identity--'||cast(r_regionkey as string)||'"}'"""),
    ],
    1: [("customer", f"CASE WHEN c_custkey % 3 = 0 THEN {_attack_json('attack-pattern', 'c_custkey', _TECH, _CHAIN.replace('enterprise-attack', 'mobile-attack'), '2020-01-01T00:00:00.250Z', _lit('newer'))} END")],
}
_ATTACK_NS = "mitre-attack-preprocessing"


def _attack_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    bronze = None
    for domain, parts in _ATTACK.items():
        for i, (table, text) in enumerate(parts):
            key = {"customer": "c_custkey", "region": "r_regionkey", "supplier": "s_suppkey", "nation": "n_nationkey"}[table]
            part = _t(spark, sf_dir, table).select(F.lit(table).alias("file"), (F.col(key) * len(parts) + i).cast("int").alias("pos"), F.expr(text).alias("raw"), F.lit(domain).alias("domain_ord")).where("raw is not null")
            bronze = part if bronze is None else bronze.unionByName(part)
    return attack.tables(graph.materialize(bronze, "bronze"))


def _attack_edge(source: str, kind: str, target: str, of: str, **seeds: str) -> str:
    return f"SELECT {_edge(_ATTACK_NS, 's', kind, 't', **seeds)} AS id, '{kind}' AS relationship_type, s AS source_ref, t AS target_ref FROM (SELECT *, {source} AS s, {target} AS t FROM {of})"


@query(
    _union(
        [
            "SELECT 'T'||(1000 + c_custkey) AS id, 'attack-technique' AS type, CASE WHEN c_custkey % 3 = 0 THEN 'newer' ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'enterprise-attack,mobile-attack' ELSE 'enterprise-attack' END AS detail FROM customer",
            "SELECT 'TA'||r_regionkey, 'x-mitre-tactic', 'n'||r_regionkey, 'enterprise-attack,mobile-attack' FROM region", "SELECT 'M'||r_regionkey, 'x-mitre-matrix', 'n'||r_regionkey, NULL FROM region",
            "SELECT 'S'||(s_suppkey // 2), 'malware', 'n'||s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 1", "SELECT 'campaign--'||n_nationkey, 'campaign', 'n'||n_nationkey, '2019' FROM nation",
            "SELECT 'AN'||n_nationkey, 'x-mitre-analytic', 'n'||n_nationkey, 'f:f -- d' FROM nation", "SELECT DISTINCT 'log-source--L'||(n_nationkey % 3), 'log-source', 'L'||(n_nationkey % 3), NULL FROM nation", "SELECT 'log-source--S'||r_regionkey, 'log-source', 'S'||r_regionkey, NULL FROM region",
        ]
    )
)
def technique_entities(spark, sf_dir):  # noqa: ANN001, ANN201
    """Entities of merged domain bundles by canonical identifier; losers of a claim go."""
    t, c, none = _attack_tables(spark, sf_dir), F.col, F.lit(None).cast("string")
    part = lambda name, detail: t[name].select("id", "type", "name", detail.alias("detail"))
    parts = [
        part("attack-pattern", F.array_join("x_mitre_domains", ",")), part("x-mitre-tactic", F.array_join("x_mitre_domains", ",")), part("x-mitre-matrix", none), part("malware", F.array_join("aliases", ",")), part("course-of-action", none), part("campaign", c("first_seen")),
        part("x-mitre-analytic", F.concat_ws(":", F.array_join("x_mitre_mutable_element_fields", ","), F.array_join("x_mitre_mutable_element_notes", ","))), part("log-source", none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT 'relationship--'||s_suppkey AS id, 'uses' AS relationship_type, 'S'||(s_suppkey // 2) AS source_ref, 'T'||(1000 + s_suppkey) AS target_ref FROM supplier WHERE s_suppkey % 2 = 1")
def technique_native_edges(spark, sf_dir):  # noqa: ANN001, ANN201
    """Native edges of which both ends have an identifier."""
    return _attack_tables(spark, sf_dir)["relationship"].select(*_EDGE)


@query(
    _union(
        [
            _attack_edge("'T'||(1000 + c_custkey)", "has_tactic", "'TA'||(c_custkey % 5)", "customer"), _attack_edge("'M'||r_regionkey", "has_member", "'TA'||r_regionkey", "region"), _attack_edge("'M'||r_regionkey", "has_member", "'TA0'", "region"),
            _attack_edge("'DET'||n_nationkey", "has_analytic", "'AN'||n_nationkey", "nation"),
            _attack_edge("'AN'||n_nationkey", "uses_data_component", "'DC'||(n_nationkey % 5)", "nation", channel="CASE WHEN n_nationkey % 2 = 1 THEN 'c' END", log_source_ref="'log-source--L'||(n_nationkey % 3)"),
            _attack_edge("'DC'||r_regionkey", "has_log_source", "'log-source--S'||r_regionkey", "region"),
        ]
    )
)
def technique_derived_edges(spark, sf_dir):  # noqa: ANN001, ANN201
    """Edges from kill chains and references."""
    return _attack_tables(spark, sf_dir)["derived-relationship"].select(*_EDGE)


@query(f"SELECT *, 'capec' AS source_name FROM ({_attack_edge("'T'||(1000 + c_custkey)", 'related-to', "'CAPEC-'||(c_custkey % 7)", '(SELECT * FROM customer WHERE c_custkey % 3 > 0)', source_name=_lit('capec'))})")
def technique_external_edges(spark, sf_dir):  # noqa: ANN001, ANN201
    """techniques' references to attack patterns; the newer copies of a third of them have none."""
    return _attack_tables(spark, sf_dir)["external-relationship"].select(*_EDGE, "source_name")


@query("SELECT 'identity' AS type, 'boilerplate' AS reason, count(*) AS n FROM region UNION ALL SELECT 'malware', 'lost an identifier', count(*) FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'course-of-action', 'lost an identifier', count(*) FROM customer WHERE c_custkey % 10 = 0")
def technique_rejects(spark, sf_dir):  # noqa: ANN001, ANN201
    """Losers of claims, and boilerplate."""
    return _attack_tables(spark, sf_dir)["dropped"].select("type", "reason", "n")


# ---- defensive techniques: parts are techniques, suppliers artifacts, nations weaknesses, orders mapping rows ----

_URI = defend.URI
_CELL = lambda name, value: f"""'"{name}":{{"type":"uri","value":"{_URI}'||{value}||'"}}'"""
_LABEL = lambda name, value: f"""'"{name}":{{"type":"literal","value":"'||{value}||'"}}'"""
_MAPPING_JSON = "'{'||" + "||','||".join([
    _CELL("def_tech", "'Tech'||cast(o_custkey % 20 as string)"), _CELL("def_artifact", "'Art'||cast(o_orderkey % 10 as string)"), _LABEL("def_artifact_rel_label", "'Filters / '||cast(o_orderkey % 3 as string)"), _CELL("def_tactic", "'Tac'||cast(o_orderkey % 5 as string)"),
    _CELL("off_artifact", "'Art'||cast(o_orderkey % 6 as string)"), _LABEL("off_artifact_rel_label", "'May-Modify'"),
]) + "||CASE WHEN o_orderkey % 4 > 0 THEN ','||" + _CELL("off_tech", "'T'||cast(1000 + o_orderkey % 30 as string)") + " ELSE '' END||'}'"
_DEFEND_JSON = {
    "part": ("p_partkey", """'{"@id":"d3f:Tech'||cast(p_partkey as string)||'","rdfs:label":"'||p_name||'","d3f:d3fend-id":"D3-'||cast(p_partkey as string)||'","d3f:synonym":["a","a",""]}'"""),
    "region": ("r_regionkey", """'{"@id":"d3f:Tac'||cast(r_regionkey as string)||'","rdfs:label":"'||r_name||'","d3f:definition":"def","d3f:display-order":{"@type":"xsd:integer","@value":"'||cast(r_regionkey as string)||'"},"d3f:display-priority":1}'"""),
    "supplier": ("s_suppkey", """'{"@id":"d3f:Art'||cast(s_suppkey as string)||'","rdfs:label":["'||s_name||'","x"],"d3f:definition":["one","two"],"d3f:synonym":"s","skos:altLabel":["t","s"],"rdfs:hasSubClass":[{"@id":"d3f:Art'||cast(s_suppkey + 1 as string)||'"},{"@id":"d3f:Art0"}]}'"""),
    "nation": ("n_nationkey", """'{"@id":"d3f:CWE-'||cast(n_nationkey as string)||'","rdfs:subClassOf":[{"@id":"d3f:Weakness"},{"@id":"d3f:CWE-'||cast(n_nationkey + 1 as string)||'"},"text"],"d3f:weakness-of":{"@id":"d3f:Art'||cast(n_nationkey % 4 as string)||'"},"d3f:may-be-weakness-of":{"@id":"d3f:Art9"}}'"""),
    "orders": ("o_orderkey", _MAPPING_JSON),
}
_DEFEND_NS = "mitre-defend-preprocessing"
_ROWS = "(SELECT 'Tech'||(o_custkey % 20) AS dt, 'Art'||(o_orderkey % 10) AS da, 'Filters / '||(o_orderkey % 3) AS dl, 'filters_'||(o_orderkey % 3) AS dv, 'Tac'||(o_orderkey % 5) AS tc, CASE WHEN o_orderkey % 4 > 0 THEN 'T'||(1000 + o_orderkey % 30) END AS ot, 'Art'||(o_orderkey % 6) AS oa FROM orders)"


def _defend_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    part = lambda table: _bronze(spark, sf_dir, table, *_DEFEND_JSON[table])
    return defend.tables(part("part"), part("region"), part("supplier"), part("nation"), part("orders"))


def _defend_edge(source: str, verb: str, target: str, of: str, **seeds: str) -> str:
    kind = verb if verb.startswith("(") else _lit(verb)
    extra = "".join(f"||'|{n}='||{v}" for n, v in sorted(seeds.items()))
    return f"SELECT {_duck_edge(_DEFEND_NS, 's', 'v', 't', extra)} AS id, v AS relationship_type, s AS source_ref, t AS target_ref FROM (SELECT *, {source} AS s, {kind} AS v, {target} AS t FROM {of})"


@query(
    _union(
        [
            _defend_edge("'Art'||s_suppkey", "has_subclass", "'Art'||(s_suppkey + 1)", "supplier"), _defend_edge("'Art'||s_suppkey", "has_subclass", "'Art0'", "supplier"),
            _defend_edge("'CWE-'||n_nationkey", "child_of", "'CWE-'||(n_nationkey + 1)", "nation"), _defend_edge("'CWE-'||n_nationkey", "weakness_of", "'Art'||(n_nationkey % 4)", "nation"), _defend_edge("'CWE-'||n_nationkey", "may_be_weakness_of", "'Art9'", "nation"),
            _defend_edge("dt", "(dv)", "da", f"(SELECT DISTINCT dt, dv, da FROM {_ROWS})"), _defend_edge("dt", "enables", "tc", f"(SELECT DISTINCT dt, tc FROM {_ROWS})"),
            _defend_edge("ot", "may_modify", "oa", f"(SELECT DISTINCT ot, oa FROM {_ROWS} WHERE ot IS NOT NULL)"),
            _defend_edge("dt", "counters", "ot", f"(SELECT DISTINCT dt, ot, da, dl, oa FROM {_ROWS} WHERE ot IS NOT NULL)", def_artifact="da", def_artifact_rel="dl", off_artifact="oa", off_artifact_rel="'May-Modify'"),
        ]
    )
)
def defence_edges(spark, sf_dir):  # noqa: ANN001, ANN201
    """Ontology edges, and each fact of the mapping rows once."""
    return _defend_tables(spark, sf_dir)["relationship"].select(*_EDGE)


@query("SELECT 'Tech'||p_partkey AS id, 'technique' AS type, p_name AS name, 'D3-'||p_partkey||'/a' AS detail FROM part UNION ALL SELECT 'Tac'||r_regionkey, 'tactic', r_name, 'def/'||r_regionkey||'/1' FROM region UNION ALL SELECT 'Art'||s_suppkey, 'artifact', s_name, 'one'||chr(10)||chr(10)||'two/s,t' FROM supplier")
def defence_entities(spark, sf_dir):  # noqa: ANN001, ANN201
    """Techniques, tactics and artifacts of the ontology."""
    t = _defend_tables(spark, sf_dir)
    part = lambda name, *detail: t[name].select("id", "type", "name", F.concat_ws("/", *detail).alias("detail"))
    return part("technique", "d3fend_id", F.array_join("aliases", ",")).unionByName(part("tactic", "description", "display_order", "display_priority")).unionByName(part("artifact", "description", F.array_join("aliases", ",")))


@query("WITH r AS (SELECT o_orderkey % 50 AS n, o_orderkey AS pos, 'o'||(o_orderkey % 7) AS own FROM orders), k AS (SELECT 'x'||own AS key, '{\"@id\": \"x'||own||'\", \"n\": '||n||'}' AS j, pos FROM r WHERE n % 2 = 0 UNION ALL SELECT sha256('{\"n\": \"'||n||'\", \"own\": {\"a\": 1, \"b\": \"'||own||'\"}}'), '{\"n\": \"'||n||'\", \"own\": {\"a\": 1, \"b\": \"'||own||'\"}}', pos FROM r WHERE n % 2 = 1) SELECT key, sha256(arg_max(j, pos)) AS content_hash FROM k GROUP BY key")
def record_stamps(spark, sf_dir):  # noqa: ANN001, ANN201
    """Records by @id, else by the hash of their sorted content; bookkeeping fields do not count, the last row of a key does."""
    n, own = "cast(o_orderkey % 50 as string)", "'o'||cast(o_orderkey % 7 as string)"
    text = f"""CASE WHEN o_orderkey % 50 % 2 = 0 THEN '{{"n":'||{n}||',"@id":"x'||{own}||'","_seen":"'||cast(o_orderkey as string)||'"}}' WHEN o_orderkey % 3 = 0 THEN '{{"own":{{"b":"'||{own}||'","a":1}},"n":"'||{n}||'"}}' ELSE '{{"n":"'||{n}||'","own":{{"a":1,"b":"'||{own}||'"}},"_x":0}}' END"""
    return defend.stamped(_bronze(spark, sf_dir, "orders", "o_orderkey", text)).select("key", "content_hash")


# ---- the graph across catalogs ----

_PAIRS = ", ".join(f"({_lit(s)}, {_lit(k)}, {_lit(v)})" for (s, k), v in links.LABELS.items())


@query(f"SELECT p_partkey AS id, CASE WHEN p_size % 30 < {len(links.LABELS)} THEN l.label ELSE 'other' END AS label, 'x' AS source, p_name AS name, '{{\"size\":'||p_size||'}}' AS properties FROM part LEFT JOIN (SELECT row_number() OVER () - 1 AS i, * FROM (VALUES {_PAIRS}) t(source, kind, label)) l ON l.i = p_size % 30")
def graph_entities(spark, sf_dir):  # noqa: ANN001, ANN201
    """The loader's entities, with the label of each catalog's type."""
    out = None
    for i, (source, kind) in enumerate([*links.LABELS, ("cve", "other")]):
        here = F.col("p_size") % 30 == i if i < len(links.LABELS) else F.col("p_size") % 30 >= i
        nodes = _t(spark, sf_dir, "part").where(here).select(F.col("p_partkey").alias("id"), F.lit(kind).alias("type"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
        one = links.kg_entities(nodes, source).withColumn("source", F.lit("x"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT source_ref, relationship_type, target_ref, CASE WHEN regexp_full_match(target_ref, '.*[02468]') THEN 'high' ELSE 'low' END AS confidence FROM (SELECT DISTINCT 'd'||doc_id AS source_ref, 'MENTIONS' AS relationship_type, unnest(regexp_extract_all(text, '\\+1 \\([0-9]{3}\\) 555')) AS t, 'CVE-2020-'||t[5:7]||'0'||(doc_id % 10) AS target_ref FROM documents)")
def mention_edges(spark, sf_dir):  # noqa: ANN001, ANN201
    """Identifiers that free text mentions, apart from structured edges, with confidence by whether the target is known."""
    found = F.transform(F.regexp_extract_all("text", F.lit(r"\+1 \([0-9]{3}\) 555"), F.lit(0)), lambda t: F.concat(F.lit("see CVE-2020-"), F.substring(t, 5, 3), F.lit("0"), F.col("doc_id") % 10, F.lit(".")))
    nodes = _t(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.array_join(found, " ").alias("text"))
    known = spark.range(10_000).where("id % 2 = 0").select(F.format_string("CVE-2020-%05d", "id").alias("id"))
    every = spark.range(100_000).where("id % 2 = 0").select(F.format_string("CVE-2020-%05d", "id").alias("id"))
    return links.mention_edges(nodes, "text", known=known.unionByName(every)).select("source_ref", "relationship_type", "target_ref", "confidence")


@query(
    "WITH v AS (SELECT 'CVE-2020-'||(1000 + c_custkey) AS cve, 'CWE-'||(c_custkey % 12) AS cwe FROM customer), w AS (SELECT 'CWE-'||n_nationkey AS cwe, 'Art'||(n_nationkey % 4) AS art FROM nation UNION SELECT 'CWE-'||n_nationkey, 'Art9' FROM nation), c AS (SELECT DISTINCT 'Tech'||(o_custkey % 3) AS def, 'T'||(1000 + o_orderkey % 7) AS tech, 'Art'||(o_orderkey % 6) AS art FROM orders), m AS (SELECT DISTINCT 'S'||s_suppkey AS malware, 'T'||(1000 + s_suppkey % 9) AS tech FROM supplier) SELECT DISTINCT v.cve, v.cwe, w.art AS artifact, c.def AS defence, c.tech AS technique, m.malware FROM v JOIN w USING (cwe) JOIN c ON c.art = w.art JOIN m ON m.tech = c.tech"
)
def five_source_traversal(spark, sf_dir):  # noqa: ANN001, ANN201
    """Vulnerability, weakness, artifact, defence, technique and malware."""
    e = lambda df, s, k, t, o=None: df.select(s.alias("source_ref"), F.lit(k).alias("relationship_type"), t.alias("target_ref"), (F.lit(None).cast("string") if o is None else o).alias("off_artifact"))
    p = lambda text, c: F.concat(F.lit(text), c)
    customers, nations, orders, suppliers = (_t(spark, sf_dir, n) for n in ("customer", "nation", "orders", "supplier"))
    name = p("CVE-2020-", 1000 + F.col("c_custkey"))
    vulnerable = e(customers, name, "related-to", F.when(F.col("c_custkey") % 2 == 0, p("CWE-", F.col("c_custkey") % 12)).otherwise((F.col("c_custkey") % 12).cast("string")))
    weak = e(nations, p("CWE-", F.col("n_nationkey")), "weakness_of", p("Art", F.col("n_nationkey") % 4)).unionByName(e(nations, p("CWE-", F.col("n_nationkey")), "may_be_weakness_of", F.lit("Art9")))
    counters = e(orders, p("Tech", F.col("o_custkey") % 3), "counters", p("T", 1000 + F.col("o_orderkey") % 7), p("Art", F.col("o_orderkey") % 6))
    uses = e(suppliers, p("S", F.col("s_suppkey")), "uses", p("T", 1000 + F.col("s_suppkey") % 9))
    return links.five_source_paths(vulnerable, weak.unionByName(counters), uses, customers.select(name.alias("id")))


@query(f"SELECT c_custkey, {_duck_uuid5('c_name')} AS id, regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, 'base_score' AS snake FROM customer")
def sql_functions(spark, sf_dir):  # noqa: ANN001, ANN201
    """The registered SQL functions."""
    identity.register(spark)
    return _t(spark, sf_dir, "customer").selectExpr("c_custkey", "graph_uuid5(c_name) AS id", "graph_slug(c_name) AS slug", "graph_snake_case('baseScore') AS snake")
