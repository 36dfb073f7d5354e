"""The five catalogs' plans over hand-written snapshots."""

import hashlib
import io
import json
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from graphloom import __main__ as main
from graphloom import sync
from graphloom.operators import links
from graphloom.plans import attack, capec, cve, cwe, defend
from graphloom.sources import bundles, sinks


def five(seed):
    return str(uuid.uuid5(uuid.NAMESPACE_URL, seed))


def land(tmp_path, name, objects, member="objects"):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"type": "bundle", member: objects}, sort_keys=True, indent=1))
    return str(path)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_vulnerabilities(spark, tmp_path):
    entry = {"source": "nvd", "type": "Primary", "cvssData": {"version": "3.1", "baseScore": 10, "vectorString": "V"}, "exploitabilityScore": 3.9}
    other = {"source": "x", "type": "Secondary", "cvssData": {"version": "3.1", "baseScore": 10.0, "vectorString": "V"}}
    v4 = {"source": "x", "type": "Primary", "cvssData": {"baseScore": 7.1, "modifiedAttackVector": "NOT_DEFINED", "Automatable": "YES"}}
    ssvc = {"source": "cisa", "ssvcData": {"id": "drop", "role": "Coordinator", "options": [{"Exploitation": "none"}, {"Technical Impact": "total"}]}}
    one = {"type": "vulnerability", "id": "vulnerability--1", "name": "CVE-2020-0001", "x_nvd_vuln_status": "Analyzed", "x_nvd_weaknesses": ["CWE-79", "NVD-CWE-noinfo"], "x_nvd_cvss": {"cvssMetricV31": [entry, other], "cvssMetricV40": [v4], "ssvcV203": [ssvc]}}
    two = {"type": "vulnerability", "id": "vulnerability--2", "name": "CVE-2021-0002"}
    gone = {"type": "vulnerability", "id": "vulnerability--3", "name": "CVE-2021-0003", "x_nvd_vuln_status": "Rejected", "x_nvd_weaknesses": ["CWE-1"]}
    land(tmp_path, "records/2020/latest.json", [one, {"type": "note", "id": "n"}, "text"])
    land(tmp_path, "records/2021/latest.json", [two, gone])
    t = cve.tables(bundles.sharded(spark, f"{tmp_path}/records"))
    assert rows(t["vulnerability"], "id", "stix_id") == [("CVE-2020-0001", "vulnerability--1"), ("CVE-2021-0002", "vulnerability--2")]
    assert rows(t["external-relationship"], "id", "source_ref", "target_ref", "source_name") == [("relationship--" + five("cve-preprocessing:CVE-2020-0001|related-to|CWE-79"), "CVE-2020-0001", "CWE-79", "cwe")]
    flat = [{"assessment_type": "Primary", "base_score": 10, "exploitability_score": 3.9, "source": "nvd", "vector_string": "V", "version": "3.1"}, {"assessment_type": "Secondary", "base_score": 10.0, "source": "x", "vector_string": "V", "version": "3.1"}]
    want = ["cvss-v3-score--" + five(f"cve-preprocessing:cvss-v3-score:CVE-2020-0001|cvssMetricV31|{i}|{json.dumps(f, sort_keys=True)}") for i, f in enumerate(flat)]
    assert sorted(r.id for r in t["cvss-v3-score"].collect()) == sorted(want)
    assert {r.base_score for r in t["cvss-v3-score"].collect()} == {10.0}
    (score,) = t["cvss-v4-score"].collect()
    assert score.automatable == "YES" and score.base_score == 7.1 and not score.other_fields
    (decision,) = t["ssvc-assessment"].collect()
    assert (decision.exploitation, decision.role) == ("none", "Coordinator")
    assert rows(t["relationship"], "relationship_type", "source_ref") == [("has_cvss_v3_score", "CVE-2020-0001")] * 2 + [("has_cvss_v4_score", "CVE-2020-0001"), ("has_ssvc_assessment", "CVE-2020-0001")]
    assert rows(t["dropped"], "type", "reason", "n") == [("note", "unexpected type", 1), ("vulnerability", "rejected", 1)]
    feed = {"cve": {"id": "CVE-2020-0001", "published": "2020-01-02T03:04:05.678", "lastModified": "2020-02-02T03:04:05", "descriptions": [{"lang": "es", "value": "hola"}], "weaknesses": [{"description": [{"value": "CWE-79"}, {"value": "CWE-79"}]}], "references": [{"url": "u"}, {"source": "s"}], "metrics": {"a": [1]}}}
    (made,) = cve.to_objects(spark.createDataFrame([(json.dumps(feed),)], "raw string")).collect()
    assert (made.id, made.created, made.modified, made.description, made.x_nvd_weaknesses, made.year) == ("vulnerability--" + five("cve:CVE-2020-0001"), "2020-01-02T03:04:05.678Z", "2020-02-02T03:04:05.000Z", "hola", ["CWE-79"], 2020)
    assert [(r.source_name, r.url) for r in made.external_references][1:] == [("nvd", "u")]
    with pytest.raises(Exception, match="not a CVE id"):
        cve.to_objects(spark.createDataFrame([(json.dumps({"cve": {"id": "CVE-99-1"}}),)], "raw string")).collect()


def test_attack_patterns(spark, tmp_path):
    def pattern(n, **more):
        return {"type": "attack-pattern", "id": f"attack-pattern--{n}", "name": f"P{n}", "external_references": [{"source_name": "capec", "external_id": f"CAPEC-{n}"}, *more.pop("refs", [])], **more}

    nine = pattern(9, refs=[{"source_name": "cwe", "external_id": "CWE-79"}, {"source_name": "ATTACK", "external_id": "T1"}, {"source_name": "WASC", "external_id": "1"}], x_capec_peer_of_refs=["attack-pattern--10"], x_capec_child_of_refs=["attack-pattern--10"], x_capec_consequences={"Access_Control": ["Gain Privileges (by (x))", "Gain Privileges"], "Integrity": ["Modify Data"]}, x_capec_alternate_terms=["a", "", "a", "b"])
    ten = pattern(10, x_capec_peer_of_refs=["attack-pattern--9"], x_capec_consequences={"Access Control": ["Gain Privileges", "Gain Privileges"]}, x_capec_extended_description="long", x_capec_version="3.9")
    objects = [nine, ten, {"type": "course-of-action", "id": "course-of-action--1", "name": "M"}, {"type": "relationship", "id": "relationship--1", "relationship_type": "mitigates", "source_ref": "course-of-action--1", "target_ref": "attack-pattern--9", "created": "c"}, {"type": "identity", "id": "i"}, {"type": "odd", "id": "o"}]
    bronze = bundles.bundle(spark, land(tmp_path, "capec.json", objects))
    t = capec.tables(bronze)
    assert rows(t["attack-pattern"], "id", "stix_id", "aliases", "extended_description") == [("CAPEC-10", "attack-pattern--10", None, "long"), ("CAPEC-9", "attack-pattern--9", ["a", "b"], None)]
    assert rows(t["relationship"], "id", "source_ref", "target_ref") == [("relationship--1", "course-of-action--1", "CAPEC-9")]
    assert rows(t["external-relationship"], "target_ref", "source_name") == [("CWE-79", "cwe"), ("T1", "ATTACK")]
    node = "consequence--" + five("capec-preprocessing:consequence:scope=Access Control|impact=Gain Privileges")
    made = t["attack-pattern-relationship"]
    assert rows(made.where("relationship_type = 'peer_of'"), "source_ref", "target_ref") == [("CAPEC-9", "CAPEC-10")]
    assert rows(made.where("relationship_type = 'child_of'"), "id") == [("relationship--" + five("capec-preprocessing:CAPEC-9|child_of|CAPEC-10"),)]
    assert sorted(rows(made.where("relationship_type = 'has_consequence'"), "source_ref", "note"), key=str) == [("CAPEC-10", None), ("CAPEC-9", "by (x)"), ("CAPEC-9", None), ("CAPEC-9", None)]
    twice = made.where(made.target_ref == node).where("source_ref = 'CAPEC-9'")
    assert twice.count() == 2 and twice.select("id").distinct().count() == 1
    assert t["consequence"].count() == 2
    assert rows(t["dropped"], "type", "reason") == [("identity", "boilerplate"), ("odd", "unexpected type")]
    assert capec.version(bronze).first().version == "3.9"
    bad = bundles.bundle(spark, land(tmp_path, "bad.json", [pattern(1, x_capec_child_of_refs=["attack-pattern--404"])]))
    with pytest.raises(Exception, match="does not resolve"):
        capec.tables(bad)["attack-pattern-relationship"].collect()
    with pytest.raises(Exception, match="no list"):
        bundles.bundle(spark, land(tmp_path, "none.json", [], "other")).collect()


def test_weaknesses(spark, tmp_path):
    rich = {"div": {"style": "x:y", "p": ["one", "two"], "ul": {"li": ["a", {"b": "c"}]}, "br": ""}}
    w = {
        "type": "weakness", "id": "CWE-79", "cwe_id": "79", "ID": "79", "Name": "XSS", "ExtendedDescription": rich, "LikelihoodOfExploit": "High",
        "RelatedWeaknesses": {"RelatedWeakness": [{"Nature": "ChildOf", "CWE_ID": "74", "View_ID": "1000", "Ordinal": "Primary"}, {"Nature": "ChildOf", "CWE_ID": "74", "View_ID": "1003"}]},
        "AlternateTerms": {"AlternateTerm": {"Term": "CSS", "Description": {"p": "old"}}}, "WeaknessOrdinalities": {"WeaknessOrdinality": {"Ordinality": "Resultant"}},
        "RelatedAttackPatterns": {"RelatedAttackPattern": {"CAPEC_ID": "63"}}, "AffectedResources": {"AffectedResource": "Memory"},
        "ObservedExamples": {"ObservedExample": [{"Reference": "[CVE-2020-1234]", "Description": "d", "Link": "l"}, {"Reference": "CVE-2002-216"}, {"Reference": "[REF-1374]"}]},
        "CommonConsequences": {"Consequence": [{"Scope": ["B", "A"], "Impact": "I", "Likelihood": "Low"}, {"Scope": ["A", "B"], "Impact": ["I"], "Note": "n"}, {"Note": "empty"}]},
        "ApplicablePlatforms": {"Language": [{"Name": "Java", "Prevalence": "Often"}, {"Class": "Not Language-Specific"}], "Technology": {"Name": "Web"}},
        "ModesOfIntroduction": {"Introduction": {"Phase": "Design", "Note": {"p": "x"}}},
        "PotentialMitigations": {"Mitigation": [{"Mitigation_ID": "MIT-1", "Phase": ["Design", "It's"], "Strategy": "S", "Description": "do"}, {"Phase": "Build", "Description": {"p": "it"}}]},
        "DetectionMethods": {"DetectionMethod": {"Detection_Method_ID": "DM-1", "Method": "Fuzzing", "Effectiveness": "High"}},
    }
    other = {"type": "weakness", "id": "CWE-80", "cwe_id": "80", "ApplicablePlatforms": {"Language": {"Name": "Java"}}}
    category = {"type": "category", "id": "CWE-1", "cwe_id": "1", "Summary": "s", "Relationships": {"HasMember": {"CWE_ID": "79", "View_ID": "699"}}}
    view = {"type": "view", "id": "CWE-2", "cwe_id": "2", "Type": "Graph", "Audience": {"Stakeholder": [{"Type": "Dev"}, {"Description": "d"}]}, "Objective": "o", "Members": {"HasMember": [{"CWE_ID": "79"}]}}
    t = cwe.tables(bundles.bundle(spark, land(tmp_path, "cwe.json", [w, other, category, view])))
    x = t["weakness"].where("id = 'CWE-79'").first()
    assert x.extended_description == "one\ntwo\n\n- a\n- c" and x.likelihood_of_exploit == "High" and x.aliases == ["CSS"] and x.alias_notes == ["CSS -- old"]
    assert x.weakness_ordinalities == ["Resultant"] and x.affected_resources == ["Memory"] and x.functional_areas is None
    assert rows(t["view"], "view_type", "audience", "objective") == [("Graph", ["Dev"], "o")]
    r = t["relationship"]
    assert rows(r.where("relationship_type = 'child_of'"), "id", "view_id") == sorted([("relationship--" + five("cwe-preprocessing:CWE-79|child_of|CWE-74|ordinal=Primary|view_id=1000"), "1000"), ("relationship--" + five("cwe-preprocessing:CWE-79|child_of|CWE-74|view_id=1003"), "1003")], key=str)
    assert rows(r.where("relationship_type = 'has_member'"), "source_ref", "target_ref", "view_id") == [("CWE-1", "CWE-79", "699"), ("CWE-2", "CWE-79", None)]
    assert rows(t["consequence"], "id", "scope", "impact") == [("consequence--" + five("cwe-preprocessing:consequence:scope=A,B|impact=I"), ["A", "B"], ["I"])]
    assert r.where("relationship_type = 'has_consequence'").count() == 2
    assert rows(t["platform"], "category", "name") == [("Language", "Java"), ("Language", None), ("Technology", "Web")]
    private = "platform--" + five("cwe-preprocessing:platform:Language|private|CWE-79|1")
    assert private in [p.id for p in t["platform"].collect()]
    assert rows(r.where("relationship_type = 'introduced_in'"), "note") == [("x",)]
    nodes = {m.mitigation_id: m for m in t["mitigation"].collect()}
    assert nodes["MIT-1"].description is None and nodes[None].phase == ["Build"] and nodes[None].description == "it"
    shared = r.where("relationship_type = 'has_mitigation' and description = 'do'").first()
    seed = f"cwe-preprocessing:CWE-79|has_mitigation|{nodes['MIT-1'].id}|description=do|phase={['Design', chr(73) + 't' + chr(39) + 's']}|strategy=S"
    assert shared.id == "relationship--" + five(seed) and shared.phase == ["Design", "It's"]
    assert rows(t["external-relationship"], "target_ref", "source_name", "link") == [("CAPEC-63", "capec", None), ("CVE-2020-1234", "cve", "l")]
    assert rows(t["dropped"], "reason", "n") == [("malformed CVE id", 1)]
    bad = cwe.tables(bundles.bundle(spark, land(tmp_path, "bad.json", [{"type": "weakness", "id": "CWE-3", "cwe_id": "3", "RelatedWeaknesses": {"RelatedWeakness": {"Nature": "Odd", "CWE_ID": "1"}}}])))
    with pytest.raises(Exception, match="nature of a related weakness"):
        bad["relationship"].collect()


def test_weakness_catalog_xml(spark, tmp_path):
    xml = """<Weakness_Catalog xmlns="http://x" Version="4.20" Date="2026-01-01"><Weaknesses>
      <Weakness ID="79" Name="XSS"><Description>d</Description><Related_Weaknesses><Related_Weakness Nature="ChildOf" CWE_ID="74"/></Related_Weaknesses>
      <Note Type="t">text</Note><Extended_Description><p>a</p><p>b</p></Extended_Description>
      <Content_History><Submission><Submission_Date>2006-07-19</Submission_Date></Submission><Modification><Modification_Date>2010-01-02</Modification_Date></Modification></Content_History></Weakness>
      </Weaknesses><Categories><Category ID="1" Name="C"><Content_History><Modification><ModificationDate>2011-01-01</ModificationDate></Modification></Content_History></Category></Categories><Views><View ID="2"/></Views></Weakness_Catalog>"""
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("c.xml", xml)
    got = {json.loads(r.raw)["id"]: (r.version, json.loads(r.raw)) for r in bundles.catalog(spark, f"{tmp_path}/c.zip", "2026-02-02T00:00:00.000Z").collect()}
    version, w = got["CWE-79"]
    assert version == "4.20" and w["type"] == "weakness" and w["Note"] == {"Type": "t", "_text": "text"} and w["ExtendedDescription"] == {"p": ["a", "b"]}
    assert (w["created"], w["modified"]) == ("2006-07-19T00:00:00.000Z", "2010-01-02T00:00:00.000Z") and "ContentHistory" not in w
    assert w["RelatedWeaknesses"] == {"RelatedWeakness": {"Nature": "ChildOf", "CWE_ID": "74"}}
    assert got["CWE-1"][1]["created"] == "2011-01-01T00:00:00.000Z" and got["CWE-2"][1]["created"] == "2026-02-02T00:00:00.000Z"
    with pytest.raises(bundles.SourceError):
        empty = io.BytesIO()
        zipfile.ZipFile(empty, "w").close()
        bundles.catalog_records(b"PK" + empty.getvalue()[2:], "t")


def test_techniques(spark, tmp_path):
    def obj(kind, n, code=None, **more):
        refs = [{"source_name": "mitre-attack", "external_id": code}] if code else []
        return {"type": kind, "id": f"{kind}--{n}", "name": f"{kind}{n}", "modified": "2020-01-01T00:00:00.000Z", "external_references": refs + more.pop("refs", []), **more}

    chain = [{"kill_chain_name": "mitre-attack", "phase_name": "impact"}, {"kill_chain_name": "other", "phase_name": "x"}]
    t1 = obj("attack-pattern", 1, "T1001", kill_chain_phases=chain, refs=[{"source_name": "capec", "external_id": "CAPEC-9"}], x_mitre_domains=["enterprise-attack"])
    newer = dict(t1, x_mitre_domains=["mobile-attack"], modified="2021-01-01T00:00:00.000Z", name="newer")
    enterprise = [
        t1, obj("course-of-action", 2, "T1001"), obj("x-mitre-tactic", 3, "TA1", x_mitre_shortname="impact", x_mitre_domains=["enterprise-attack", "mobile-attack"]),
        obj("malware", 4, "S1", revoked=True), obj("malware", 5, "S1", x_mitre_aliases=["m"]), obj("tool", 6, "S2"), obj("tool", 7, "S2"), obj("campaign", 8),
        obj("x-mitre-matrix", 9, "enterprise", tactic_refs=["x-mitre-tactic--3"]), obj("x-mitre-detection-strategy", 10, "DET1", x_mitre_analytic_refs=["x-mitre-analytic--11"]),
        obj("x-mitre-analytic", 11, "AN1", x_mitre_log_source_references=[{"x_mitre_data_component_ref": "x-mitre-data-component--12", "name": "only", "channel": "None"}], x_mitre_mutable_elements=[{"field": "f", "description": "d"}, {"field": "f"}, {"description": "x"}]),
        obj("x-mitre-data-component", 12, "DC1", x_mitre_log_sources=[{"name": "L", "channel": " c "}, {"name": "L", "channel": " "}]),
        {"type": "relationship", "id": "relationship--1", "relationship_type": "uses", "source_ref": "malware--5", "target_ref": "attack-pattern--1", "description": "d"},
        {"type": "relationship", "id": "relationship--2", "relationship_type": "mitigates", "source_ref": "course-of-action--2", "target_ref": "attack-pattern--1"},
        {"type": "identity", "id": "identity--1"}, {"type": "odd", "id": "odd--1"},
    ]
    for name, objects in (("enterprise", enterprise), ("mobile", [newer]), ("ics", [])):
        land(tmp_path, f"{name}/latest.json", objects)
    t = attack.tables(bundles.domains(spark, str(tmp_path), attack.DOMAINS))
    (technique,) = t["attack-pattern"].collect()
    assert (technique.id, technique.type, technique.name, technique.x_mitre_domains) == ("T1001", "attack-technique", "newer", ["enterprise-attack", "mobile-attack"])
    assert t["course-of-action"].count() == 0 and t["tool"].count() == 0
    assert rows(t["malware"], "id", "stix_id", "aliases") == [("S1", "malware--5", ["m"])]
    assert rows(t["campaign"], "id") == [("campaign--8",)]
    assert rows(t["relationship"], "id", "source_ref", "target_ref") == [("relationship--1", "S1", "T1001")]
    d = t["derived-relationship"]
    assert rows(d.where("relationship_type = 'has_tactic'"), "id", "target_ref") == [("relationship--" + five("mitre-attack-preprocessing:T1001|has_tactic|TA1"), "TA1")]
    assert rows(d.where("relationship_type in ('has_member', 'has_analytic')"), "source_ref", "target_ref") == [("DET1", "AN1"), ("enterprise", "TA1")]
    assert rows(d.where("relationship_type = 'uses_data_component'"), "log_source_ref", "channel") == [("log-source--only", None)]
    assert rows(d.where("relationship_type = 'has_log_source'"), "id", "channel") == sorted([("relationship--" + five("mitre-attack-preprocessing:DC1|has_log_source|log-source--L|channel= c "), " c "), ("relationship--" + five("mitre-attack-preprocessing:DC1|has_log_source|log-source--L"), None)], key=str)
    assert rows(t["log-source"], "id", "name") == [("log-source--L", "L"), ("log-source--only", "only")]
    (analytic,) = t["x-mitre-analytic"].collect()
    assert analytic.x_mitre_mutable_element_fields == ["f"] and analytic.x_mitre_mutable_element_notes == ["f -- d"]
    assert rows(t["external-relationship"], "target_ref") == [("CAPEC-9",)]
    assert rows(t["dropped"], "type", "reason", "n") == sorted([("identity", "boilerplate", 1), ("odd", "unexpected type", 1), ("course-of-action", "lost an identifier", 1), ("malware", "lost an identifier", 1), ("tool", "lost an identifier", 2)], key=str)


def test_defensive_techniques_and_paths_through_five_sources(spark, tmp_path):
    uri = defend.URI
    cell = lambda v: {"type": "uri", "value": v}
    row = {"def_tech": cell(uri + "Filter"), "def_artifact": cell(uri + "Page"), "def_artifact_rel_label": cell("filters"), "def_tactic": cell(uri + "Isolate"), "off_tech": cell(uri + "T1001"), "off_artifact": uri + "Page", "off_artifact_rel_label": cell("may-modify")}
    domains = {
        "techniques": [{"@id": "d3f:Filter", "rdfs:label": "Filter", "d3f:d3fend-id": "D3-F", "d3f:synonym": "Sieve"}],
        "tactics": [{"@id": "d3f:Isolate", "rdfs:label": "Isolate", "d3f:definition": "def", "d3f:display-order": {"@type": "xsd:integer", "@value": "3"}, "d3f:display-priority": 1}],
        "artifacts": [{"@id": "d3f:Page", "rdfs:label": ["Page", "Seite"], "d3f:definition": ["one", "two"], "d3f:synonym": ["P"], "skos:altLabel": "Q", "rdfs:hasSubClass": {"@id": "d3f:Sub"}}],
        "weaknesses": [{"@id": "d3f:CWE-79", "rdfs:subClassOf": [{"@id": "d3f:Weakness"}, {"@id": "d3f:CWE-74"}], "d3f:weakness-of": {"@id": "d3f:Page"}}],
        "mappings": [row, row, {**row, "off_tech": None}, {"def_tech": uri + "Filter"}],
    }
    parts = [bundles.records(spark, land(tmp_path, f"{n}.json", r, "records")) for n, r in domains.items()]
    t = defend.tables(*parts)
    assert rows(t["technique"], "id", "d3fend_id", "aliases") == [("Filter", "D3-F", ["Sieve"])]
    assert rows(t["tactic"], "display_order", "display_priority", "description") == [(3, 1, "def")]
    assert rows(t["artifact"], "name", "description", "aliases") == [("Page", "one\n\ntwo", ["P", "Q"])]
    assert rows(t["relationship"], "source_ref", "relationship_type", "target_ref") == [("CWE-79", "child_of", "CWE-74"), ("CWE-79", "weakness_of", "Page"), ("Filter", "counters", "T1001"), ("Filter", "enables", "Isolate"), ("Filter", "filters", "Page"), ("Page", "has_subclass", "Sub"), ("T1001", "may_modify", "Page")]
    seed = "mitre-defend-preprocessing:Filter|counters|T1001|def_artifact=Page|def_artifact_rel=filters|off_artifact=Page|off_artifact_rel=may-modify"
    assert t["relationship"].where("relationship_type = 'counters'").first().id == "relationship--" + five(seed)
    cves = spark.createDataFrame([("CVE-2020-0001", "related-to", "CWE-79")], "source_ref string, relationship_type string, target_ref string")
    uses = spark.createDataFrame([("S1", "uses", "T1001")], cves.schema)
    found = links.five_source_paths(cves, t["relationship"], uses, spark.createDataFrame([("CVE-2020-0001",)], "id string")).collect()
    assert [tuple(r) for r in found] == [("CVE-2020-0001", "CWE-79", "Page", "Filter", "T1001", "S1")]
    stamped = {r.key: r for r in defend.stamped(bundles.payload(spark.createDataFrame([(json.dumps({"@graph": [{"@id": "x", "a": 1}, {"@id": "x", "a": 2, "_b": 3}, {"c": 1}]}),)], "payload string"))).collect()}
    assert len(stamped) == 2 and json.loads(stamped["x"].raw)["a"] == 2
    with pytest.raises(Exception, match="no known list"):
        bundles.payload(spark.createDataFrame([('{"x": 1}',)], "payload string")).collect()
    counts = sinks.write_tables({"technique": t["technique"], "relationship": t["relationship"]}, f"{tmp_path}/out")
    assert counts == {"technique": 1, "relationship": 7}
    assert sinks.tracked_write(t["relationship"], f"{tmp_path}/tracked") == "created"
    assert sinks.tracked_write(t["relationship"].orderBy("id"), f"{tmp_path}/tracked") == "unchanged"
    assert sinks.tracked_write(t["relationship"].limit(1), f"{tmp_path}/tracked") == "modified"


def test_paths_through_five_sources_come_once_and_are_not_shuffled(spark):
    edge = "source_ref string, relationship_type string, target_ref string"
    cves = spark.createDataFrame([("CVE-1", "related-to", "CWE-79"), ("CVE-1", "related-to", "79"), ("CVE-2", "related-to", "CWE-79"), ("CVE-2", "related-to", None)], edge)
    defence = spark.createDataFrame([("CWE-79", "weakness_of", "Page", None), ("CWE-79", "may_be_weakness_of", "Page", None), ("Filter", "counters", "T1", "Page"), ("Filter", "counters", "T1", "Page")], edge + ", off_artifact string")
    uses = spark.createDataFrame([("S1", "uses", "T1"), ("S1", "uses", "T1"), ("S2", "uses", "T1")], edge)
    found = links.five_source_paths(cves, defence, uses, spark.createDataFrame([("CVE-1",), ("CVE-1",), ("CVE-2",)], "id string"))
    assert sorted(tuple(r) for r in found.collect()) == [(c, "CWE-79", "Page", "Filter", "T1", s) for c in ("CVE-1", "CVE-2") for s in ("S1", "S2")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.strip().startswith("Project") and "Aggregate" not in plan.split("Join")[0]


def test_files_of_paths_take_a_fraction_of_a_byte_a_row(spark, tmp_path):
    edge = "source_ref string, relationship_type string, target_ref string"
    numbers = lambda n, *columns: spark.range(n).selectExpr(*columns)
    cves = numbers(700, "concat('CVE-', id) source_ref", "'related-to' relationship_type", "concat('CWE-', id % 2) target_ref")
    uses = numbers(1203, "concat('S', id) source_ref", "'uses' relationship_type", "concat('T', id % 3) target_ref")
    uses = uses.unionByName(spark.createDataFrame([(None, "uses", "T1"), ("S1", "uses", None), ("S1", "uses", "T9")], edge))
    defence = spark.createDataFrame([("CWE-0", "weakness_of", "Page", None), ("CWE-1", "weakness_of", "File", None), ("Filter", "counters", "T0", "Page"), ("Filter", "counters", "T1", "Page"), ("Scan", "counters", "T1", "File"), ("Scan", "counters", "T8", "File")], edge + ", off_artifact string")
    found = links.five_source_paths(cves, defence, uses, cves.select(F.col("source_ref").alias("id")))
    found.write.parquet(f"{tmp_path}/paths")
    back = spark.read.parquet(f"{tmp_path}/paths")
    software = {k: [f"S{i}" for i in range(1203) if i % 3 == k] for k in (0, 1)}
    software[1].append(None)
    ways = {0: [("Page", "Filter", "T0"), ("Page", "Filter", "T1")], 1: [("File", "Scan", "T1")]}
    expected = [(f"CVE-{i}", f"CWE-{i % 2}", *way, s) for i in range(700) for way in ways[i % 2] for s in software[int(way[2][1])]]
    got = [tuple(r) for r in back.collect()]
    assert len(got) == len(set(got)) == len(expected) and set(got) == set(expected)
    assert back.columns == ["cve", "cwe", "artifact", "defence", "technique", "malware"]
    assert sum(f.stat().st_size for f in (tmp_path / "paths").glob("*.parquet")) < 0.35 * len(got)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("explode(cve") < plan.index("Coalesce") < plan.index("Join")  # no row's whole fan-out is held in memory


def test_records_without_an_id_are_told_apart_by_their_sorted_content(spark):
    texts = ['{"n": 1}', '{"n": "1"}', '{"x": {"type": "t", "value": "v"}, "_b": 1}', '{"x": {"value": "v", "type": "t"}}', '{"n": 1.0}']
    got = defend.stamped(spark.createDataFrame(list(enumerate(texts)), "pos bigint, raw string")).collect()
    assert sorted(r.raw for r in got) == sorted([texts[0], texts[1], texts[3], texts[4]])
    (one,) = [r for r in got if r.raw == texts[3]]
    assert one.key == one.content_hash == hashlib.sha256(b'{"x": {"type": "t", "value": "v"}}').hexdigest()


def test_history_prefers_release_dates():
    days = lambda kind, a, b: {f"{kind}Date": a, **({f"{kind}ReleaseDate": b} if b else {})}
    both = {"ContentHistory": {"Submission": days("Submission", "2006-07-19", "2006-08-01"), "Modification": [days("Modification", "2020-01-10", "2020-02-24"), days("Modification", "2019-01-01", None)]}}
    assert bundles._history(both, "now") == ("2006-08-01T00:00:00.000Z", "2020-02-24T00:00:00.000Z")
    assert bundles._history({"ContentHistory": {"Submission": {"SubmissionDate": None}}}, "now") == ("now", "now")


def test_graph_names():
    assert len(set(links.LABELS.values())) == len(links.LABELS) and links.LABELS["capec", "course-of-action"] == "CAPECMitigation"


def test_edge_names(spark):
    rows_ = [("cve", "related-to", "cwe"), ("cwe", "related-to", "cve"), ("capec", "related-to", "ATTACK"), ("cwe", "related-to", "other"), ("attack", "subtechnique-of", None), ("cwe", "child_of", None)]
    df = spark.createDataFrame(rows_, "s string, k string, o string")
    got = [r.n for r in df.select(links.edge_label(F.col("s"), F.col("k"), F.col("o")).alias("n")).collect()]
    assert got == ["HAS_WEAKNESS", "EXEMPLIFIED_BY", "CORRESPONDS_TO", "RELATED_TO", "SUBTECHNIQUE_OF", "CHILD_OF"]


TRANSPORT = '''
import io, json, os, urllib.parse, zipfile
ROOT = "@ROOT"
XML = '<C xmlns="http://x" Version="4.{v}" Date="2026-01-01"><Weaknesses><Weakness ID="79" Name="XSS"><Content_History><Submission><Submission_Date>2006-07-19</Submission_Date></Submission><Modification><Modification_Date>20{v}-01-02</Modification_Date></Modification></Content_History></Weakness></Weaknesses></C>'


def get(url, headers):
    late = os.path.exists(ROOT + "/late")
    with open(ROOT + "/log", "a") as log:
        print(url, headers.get("apiKey"), file=log)
    query = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(url).query))
    if url.startswith("cve:"):
        item = lambda n, m: {"cve": {"id": n, "published": "2020-01-01T00:00:00.000", "lastModified": m, "vulnStatus": "Analyzed", "descriptions": [{"lang": "en", "value": m}]}}
        items = [item("CVE-2020-0001", "2020-01-01T00:00:00.000"), item("CVE-2021-0001", "2020-01-01T00:00:00.000")]
        if late:
            items = [item("CVE-2021-0001", "2025-01-01T00:00:00.5"), item("CVE-2021-0002", "2025-01-01T00:00:00")] if query["lastModStartDate"].startswith("2025-01") else []
        a, n = int(query["startIndex"]), int(query["resultsPerPage"])
        return json.dumps({"totalResults": len(items), "vulnerabilities": items[a : a + n]}).encode()
    if url.startswith("cwe:"):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("c.xml", XML.replace("{v}", "21" if late else "20"))
        return out.getvalue()
    if url.startswith("capec:"):
        kept = [{"type": "attack-pattern", "id": "attack-pattern--1", "name": "p", "modified": "2020-01-01T00:00:00Z", "x_capec_version": "3.9", "external_references": [{"source_name": "capec", "external_id": "CAPEC-1"}]}]
        return json.dumps({"objects": kept + ([] if late else [dict(kept[0], id="attack-pattern--2", external_references=[{"source_name": "capec", "external_id": "CAPEC-2"}])])}).encode()
    if url.endswith("/collections/"):
        return json.dumps({"collections": [{"id": d, "title": d.upper() + " att&ck"} for d in ("enterprise", "mobile", "ics")]}).encode()
    if "/objects/" in url:
        tool = {"type": "tool", "id": "tool--" + url.split("/collections/")[1].split("/")[0], "modified": "2020-01-01T00:00:00Z", "external_references": []}
        return json.dumps({"objects": [dict(tool, id="tool--new")] if query.get("added_after") else [tool]}).encode()
    if url.endswith("version.json"):
        return json.dumps({"ontology_version": "1.4"}).encode()
    if url.endswith("mappings.json"):
        return json.dumps({"results": {"bindings": [{"def_tech": "Filter", "n": 1}, {"def_tech": "Filter", "n": 2 if late else 1}]}}).encode()
    return json.dumps({"@graph": [{"@id": "d3f:A", "rdfs:label": "B" if late and "technique/" in url else "A"}]}).encode()
'''


def test_crawl_of_the_five_sources(spark, tmp_path, monkeypatch):
    (tmp_path / "graphloom_fake_sources.py").write_text(TRANSPORT.replace("@ROOT", str(tmp_path)))
    spark.sparkContext.addPyFile(str(tmp_path / "graphloom_fake_sources.py"))
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setenv("PYTHONPATH", str(tmp_path))
    base, out = str(tmp_path / "base"), str(tmp_path / "out")
    common = ["--base-dir", base, "--transport", "graphloom_fake_sources:get", "--api-key", "secret", "--env-file", str(tmp_path / "none"), "--page-size", "1", "--summary", str(tmp_path / "said"), "--url", *(f"{s}={s}:" for s in sync.SOURCES)]
    said = lambda: {k: v["said"].split(" | ")[0] for k, v in json.loads((tmp_path / "said").read_text())["results"].items()}
    assert main.main(["sync", *common, "--only", "cve", "cwe", "capec", "attack", "defend", "--stop-on-error"]) == 1  # an incremental run needs a full one
    assert list(said()) == ["cve"]
    assert main.main(["sync", *common, "--full", "--dry-run", "--only", "cwe"]) == 0 and not sinks.exists(spark, f"{base}/cwe/latest")
    assert main.main(["sync", *common, "--full"]) == 0
    assert said() == {"cve": "[cve] full: +2 ~0 -0", "cwe": "[cwe] full: +1 ~0 -0", "capec": "[capec] full: +2 ~0 -0", "attack": "[attack] full: +3 ~0 -0", "defend": "[defend] full: +6 ~0 -0"}
    assert "cve:?startIndex=1&resultsPerPage=1 secret" in (tmp_path / "log").read_text()
    sinks.write_manifest(spark, f"{base}/cve/manifest", {**sinks.read_manifest(spark, f"{base}/cve/manifest"), "last_fetch": "2025-01-01T00:00:00Z"})
    (tmp_path / "late").write_text("")
    assert main.main(["sync", *common]) == 0
    assert said() == {"cve": "[cve] incremental: +1 ~1 -0", "cwe": "[cwe] incremental: +0 ~1 -0", "capec": "[capec] incremental: +0 ~0 -1", "attack": said()["attack"], "defend": said()["defend"]}
    assert said()["attack"].endswith("+3 ~0 -0") and said()["defend"].endswith("+1 ~2 -0")
    assert sorted(r.key for r in spark.read.parquet(f"{base}/capec/latest").collect()) == ["attack-pattern--1", "attack-pattern--2"]  # kept
    manifest = sinks.read_manifest(spark, f"{base}/defend/manifest")
    assert manifest["ontology_version"] == "1.4" and set(manifest["domains"]) == set(sync.DEFEND)
    seen = {r.key: r.first_seen for r in spark.read.parquet(f"{base}/defend/techniques/latest").collect()}
    assert list(seen) == ["d3f:A"] and seen["d3f:A"] < manifest["last_fetch"] or seen["d3f:A"] == manifest["previous_fetch"]
    assert main.main(["sync", *common, "--only", "defend", "--domains", "tactics"]) == 0
    assert set(sinks.read_manifest(spark, f"{base}/defend/manifest")["domains"]) == set(sync.DEFEND)
    assert main.main(["graph", "--base-dir", base, "--output-dir", out]) == 0
    assert sorted(r.id for r in spark.read.parquet(f"{out}/cve/vulnerability").collect()) == ["CVE-2020-0001", "CVE-2021-0001", "CVE-2021-0002"]
    assert spark.read.parquet(f"{out}/cwe/weakness").first().modified == "2021-01-02T00:00:00.000Z" and spark.read.parquet(f"{out}/attack/tool").count() == 4
