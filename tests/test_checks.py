import json

from pyspark.sql import functions as F

from freshet.operators import checks as k

NOW = "2024-07-03T00:30:00+05:30"
REF = [{"source_revision_sha256": "r1", "report_date": "2024-07-01", "extractor_version": 3, "page": 1, "table": 1, "row": 2}]
HOUSES = {"fully_kutcha": 1, "fully_pucca": 2, "fully_total": 3, "partially_kutcha": 0, "partially_pucca": 0, "partially_total": 0}
GOOD = {
    "revision_id": "r1", "artifact_id": "r1-extractor-v3", "extractor_version": 3, "report_date": "2024-07-01", "source": {"sha256": "r1", "fetched_at": "2024-06-30T20:00:00Z", "source_url": "u"},
    "affected_district_names": ["A", "B"],
    "summary": {**dict.fromkeys(k.CORE_FIELDS, 2), "livestock_affected": {"big_animals": 1, "poultry": 4, "total": 5}, "livestock_washed_away": {}, "houses_damaged": HOUSES, "houses_damaged_others": {},
                "rescue_operations": {"boats": 1}, "relief_distributed": {}, "infrastructure_incidents": {"road": 1, "bridge": 0, "embankment_breached": 0, "embankment_affected": 0},
                "infrastructure_records_extracted": {"road": 1, "bridge": 0, "embankment_breached": 0, "embankment_affected": 0}},
    "districts": [{"district": n, **dict.fromkeys(k.CORE_FIELDS[1:], 1)} for n in "AB"],
    "infrastructure": [{"incident_type": "road", "coordinate_validation": "valid", "longitude": 91, "latitude": 26, "match_scope": "coordinates", "provenance": REF}],
    "relief_material_notes": [{"note": "rice", "provenance": REF}], "field_provenance": {"summary.affected_villages": REF}, "extraction_warnings": [],
}
WARNING = {"code": k.COUNT_MISMATCH, "incident_type": "bridge", "reported_count": 2, "extracted_record_count": 0}


def change(*edits, base=GOOD):
    doc = json.loads(json.dumps(base))
    for path, value in edits:
        spot = doc
        *head, last = path.split("/")
        for p in head:
            spot = spot[int(p)] if isinstance(spot, list) else spot[p]
        if value is KeyError:
            del spot[last]
        else:
            spot[int(last) if isinstance(spot, list) else last] = value
    return json.dumps(doc)


CASES = [  # text, current, failing or warning checks with their paths, state
    (change(), None, {}, "validated"),
    (change(("artifact_id", "r1-extractor-v2")), None, {"source_identity": ["revision_id", "artifact_id", "source.sha256"]}, "quarantined"),
    (change(("summary/missing_people", KeyError), ("infrastructure", KeyError)), None, {"required_impact_fields": ["missing_people", "infrastructure"], "infrastructure_record_count": ["summary.infrastructure_records_extracted.road"], "infrastructure_source_reconciliation": ["summary.infrastructure_incidents.road"]}, "quarantined"),
    (change(("districts/0/confirmed_deaths", -1), ("districts/1/confirmed_deaths", 3)), None, {"non_negative_metrics": ["districts[0].confirmed_deaths"]}, "quarantined"),
    (change(("summary/rescue_operations", {"boats": -1})), None, {"non_negative_metrics": ["summary.rescue_operations.boats"]}, "quarantined"),
    (change(("summary/livestock_affected/total", 6), ("summary/houses_damaged/partially_pucca", 1)), None, {"component_arithmetic": ["summary.livestock_affected", "summary.houses_damaged.partially_total"]}, "quarantined"),
    (change(("summary/affected_population", 5)), None, {"district_arithmetic": ["summary.affected_population"]}, "quarantined"),
    (change(("summary/affected_population", 5), ("districts/0/affected_population", KeyError)), None, {}, "validated"),
    (change(("affected_district_names", ["A", "C"]), ("summary/affected_villages", 9)), None, {}, "validated"),
    (change(("affected_district_names", ["A"]), ("summary/affected_districts", 2)), None, {"district_arithmetic": ["summary.affected_districts"] + [f"summary.{f}" for f in k.CORE_FIELDS[1:]]}, "quarantined"),
    (change(("field_provenance", {"a": [], "b": REF})), None, {"field_provenance": ["a"]}, "quarantined"),
    (change(("infrastructure/0/provenance/0/page", 0), ("relief_material_notes/0/provenance/0/report_date", "2024-07-02")), None, {"field_provenance": ["infrastructure[0]", "relief_material_notes[0]"]}, "quarantined"),
    (change(("report_date", "2024-07-04"), ("field_provenance", {}), ("infrastructure/0/provenance/0/report_date", "2024-07-04"), ("relief_material_notes", [])), None, {"temporal_contract": ["report_date", "source.fetched_at"]}, "quarantined"),
    (change(("source/fetched_at", "2024-07-01T10:00:00")), None, {"temporal_contract": ["report_date", "source.fetched_at"]}, "quarantined"),
    (change(("source/fetched_at", "2024-06-30T18:00:00Z")), None, {"temporal_contract": ["report_date", "source.fetched_at"]}, "quarantined"),
    (change(("infrastructure/0/longitude", 80)), None, {"coordinate_scope": ["infrastructure[0]"]}, "quarantined"),
    (change(("infrastructure/0/coordinate_validation", "outside")), None, {"coordinate_scope": ["infrastructure[0]"]}, "quarantined"),
    (change(("summary/infrastructure_incidents/bridge", 2), ("extraction_warnings", [WARNING])), None, {"infrastructure_source_reconciliation": ["summary.infrastructure_incidents.bridge"]}, "validated_partial"),
    (change(("summary/infrastructure_incidents/bridge", 3), ("extraction_warnings", [WARNING])), None, {"infrastructure_source_reconciliation": ["summary.infrastructure_incidents.bridge"]}, "quarantined"),
    (change(("extraction_warnings", [WARNING])), None, {"infrastructure_source_reconciliation": []}, "quarantined"),
    (change(), ("2024-07-02", "r0", "2024-07-02T00:00:00Z"), {}, "historical"),
    (change(), ("2024-07-01", "r0", "2024-06-30T20:00:00Z"), {}, "superseded"),
    (change(), ("2024-07-01", "r0", "2024-06-30T19:00:00Z"), {}, "validated"),
    (change(), ("2024-07-01", "r1", "2024-06-30T20:00:00Z"), {}, "validated"),
    (change(("extractor_version", "three")), None, None, "quarantined"), ("{", None, None, "quarantined"), (None, None, None, "quarantined"), ("{}", None, None, "quarantined"),
]


def test_checks_lead_to_the_state(spark):
    rows = [(i, c[0], c[1]) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, body string, c struct<d:string,revision_id:string,t:string>")
    df = df.withColumn("current", F.when(F.col("c").isNotNull(), F.struct(F.col("c.d").cast("date").alias("report_date"), "c.revision_id", F.col("c.t").cast("timestamp").alias("fetched_at"))))
    checked = k.suite(k.read(df, "body"), NOW)
    out = {r.id: r for r in k.state(checked, NOW).collect()}
    for i, (_, _, want, state) in enumerate(CASES):
        found = {c.check: c.paths for c in out[i].checks if c.status != "pass"}
        assert out[i].state == state, (i, out[i].state, found)
        assert found == want if want is not None else found, (i, found)
        assert len(out[i].checks) == 11
    assert out[17].profile == k.COUNT_PROFILE and out[17].allowed_fields[-2:] == ["infrastructure_filtered", "infrastructure_except:bridge"]
    assert out[0].profile == "impact-v1" and out[0].allowed_fields == list(k.FULL_ALLOWED_FIELDS) and out[1].allowed_fields == [] and out[1].failures == ["source_identity"]
    assert {r.state for r in k.state(checked.where("id = 0"), NOW, freshness_days=1).collect()} == {"historical"}
    assert k.long(checked, "id").count() == 11 * len(CASES)


def test_published_records_hide_what_disagrees(spark):
    kept = change(("summary/infrastructure_incidents/road", 2), ("extraction_warnings", [WARNING | {"incident_type": "road", "extracted_record_count": 1}]))
    unsure = change(("infrastructure/0/coordinate_validation", "outside"), ("infrastructure/0/match_scope", "district"))
    df = spark.createDataFrame([(0, change()), (1, kept), (2, unsure), (3, "{")], "id int, body string").withColumn("current", F.lit(None).cast("struct<report_date:date,revision_id:string,fetched_at:timestamp>"))
    judged = k.state(k.suite(k.read(df, "body"), NOW), NOW)
    got = {r.id: (r.incident_type, r.longitude) for r in k.published_records(judged, "id").collect()}
    assert got == {0: ("road", 91.0), 2: ("road", None)}
