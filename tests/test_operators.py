import datetime

from pyspark.sql import functions as F

from evidence_jobs.functions import dates, privacy, text
from evidence_jobs.functions.geometry import MULTIPOLYGON
from evidence_jobs.operators import evaluation, geo, index, monitor, normalize, packets, places
from evidence_jobs.operators.retrieval import lexical_rank
from evidence_jobs.plans import jobs


def values(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_redaction(spark):
    said = values(spark, privacy.redact(F.lit("Call contractor 9845065509 or mail person@example.com for RR Number 1234567890")))
    assert said == "Call contractor [REDACTED_PHONE] or mail [REDACTED_EMAIL] for [REDACTED_ACCOUNT]"
    assert not values(spark, privacy.has_personal(F.lit(said)))
    assert values(spark, privacy.redact(F.lit("id 198450655091 stays"))) == "id 198450655091 stays"


def test_dates(spark):
    for given, want in (("2025-1-2", "2025-01-02"), ("2025-01-02 10:00:00.000000000", "2025-01-02"), ("2025-13-40 x", "2025-13-40"), ("", ""), ("soon", None)):
        assert values(spark, dates.parse_date(F.lit(given))) == want
    for given, want in (("on 05/03/2024", "2024-03-05"), ("5 x", ""), ("due 07-Mar-2024!", "2024-03-07")):
        assert values(spark, dates.parse_loose_date(F.lit(given))) == want


def test_numbers(spark):
    for given, want in (("1,234.9", 1234), ("-3.7", -3), ("", None), ("inf", None), ("x", None)):
        assert values(spark, text.int_or_none(F.lit(given))) == want


def test_place_terms(spark):
    said = {
        "streetlight not working near bellandur main road": ["bellandur"], "bellandur lake garbage dump": ["bellandur lake"], "": [], "pothole at hsr layout in sector two": ["hsr layout in", "sector two"],
        "near": ["near"], "Alpha near Alpha": ["Alpha".lower(), "alpha near alpha"], "on water": ["on"], "a b in c d e f in c d e": ["c d e"], None: [], "in in in": ["in in", "in", "in in in"],
    }
    rows = spark.createDataFrame([(k,) for k in said], "q string").select("q", text.place_terms(F.col("q")).alias("places"), text.first_place_guess(F.col("q")).alias("first"))
    got = {r["q"]: (r["places"], r["first"]) for r in rows.collect()}
    assert got == {k: (v, v[0] if v else "") for k, v in said.items()}


def raw(spark, rows):
    return spark.createDataFrame(rows, "row map<string,string>")


def test_wards(spark):
    rows = raw(spark, [
        ({"Ward No": "150", "Ward Name": "Bellanduru", "BBMP Zone Name": "East"},),
        ({"Corporation_Name": "East", "Ward_No_Name": "1-Alpha", "TOT_P": "1,200"},),
        ({"Corporation_Name": "West", "Ward_No_Name": "1-Beta"},),
        ({"Old Ward Num": "150", "Old Ward Name": "Bellanduru", "New Ward Num": "22", "New Ward Name": "Bellandur"},),
        ({"Complaint ID": "1", "Ward Name": "x"},),
        ({"Ward_No_Name": "Nameless"},),
    ])
    made = {(r["kind"], r["ward_key"], r["reason"]) for r in normalize.ward_rows(rows).collect()}
    assert {("old", "old:150", None), ("gba", "gba:east:1", None), ("gba", "gba:west:1", None)} <= made
    assert ("gba", "gba:unknown:", "GBA row missing Ward_No_Name") in made
    assert sorted(k for k, _, _ in made) == ["gba", "gba", "gba", "mapping", "old", "skip"]


def test_payment_may_come_from_a_later_row(spark):
    row = lambda n, ref: ("s", "r", f"f/198_{n}.csv", n, "a", "road", "x", "1", "5", ref, "")
    raw_rows = spark.createDataFrame([row(2, ""), row(3, "BR7")], "source_id string, run_id string, raw_file string, row_number long, external_id string, description string, contractor string, ward_number string, amount string, payment_reference string, net_amount string")
    works, paid, bad = normalize.normalize_works(raw_rows, ["row_number"])
    assert [r["row_number"] for r in works.collect()] == [2]
    assert [(r["row_number"], r["payment_reference"]) for r in paid.collect()] == [(3, "BR7")]
    assert bad.count() == 0 and works.first()["ward_regime"] == "198"


def shape(spark, rows):
    return spark.createDataFrame(rows, "feature_idx int, s string").select("feature_idx", F.from_json("s", MULTIPOLYGON).alias("shape"))


def test_points_in_shapes_with_holes_and_edges(spark):
    square = "[[77.0,12.0],[77.1,12.0],[77.1,12.1],[77.0,12.1],[77.0,12.0]]"
    hole = "[[77.04,12.04],[77.06,12.04],[77.06,12.06],[77.04,12.06],[77.04,12.04]]"
    shapes = shape(spark, [(0, f"[[{square},{hole}]]"), (1, "[[[[77.08,12.08],[77.2,12.08],[77.2,12.2],[77.08,12.2],[77.08,12.08]]],[[[70,10],[71,10],[71,11],[70,10]]]]")])
    points = spark.createDataFrame([(1, 77.02, 12.02), (2, 77.2, 12.05), (3, 77.0, 12.05), (4, 77.05, 12.05), (5, 77.04, 12.05), (6, 77.09, 12.09), (7, 70.9, 10.1)], "case_id int, lng double, lat double")
    found = {r["case_id"]: (r["feature_idx"], r["source"], r["confidence"], r["others"]) for r in geo.resolve_points(points, shapes).collect()}
    assert found == {
        1: (0, "boundary_contains", 0.97, []), 3: (0, "boundary_edge", 0.88, []), 5: (0, "boundary_edge", 0.88, []), 6: (0, "boundary_contains", 0.90, [1]), 7: (1, "boundary_contains", 0.97, []),
    }


def test_blank_mapping_row_makes_no_candidate(spark):
    place = spark.createDataFrame([(1, "alpha")], "place_id int, query string")
    wards = spark.createDataFrame([], "ward_key string, ward_number string, ward_name string, normalized_name string, version string, seq int")
    maps = spark.createDataFrame([("", "", "Alpha", 1.0), ("9", "Old", "Alpha", 1.0)], "old_ward_number string, old_ward_name string, new_ward_name string, confidence double")
    assert [r["ward_key"] for r in places.mapped_candidates(place, maps, wards).collect()] == ["old:9"]


def test_lens_order_is_checked(spark):
    try:
        places.with_lenses(spark.range(1).withColumn("year", F.lit(1)), [("x", 2, 1)])
    except ValueError:
        return
    raise AssertionError


def test_issue_buckets_keep_the_newest_and_place_buckets_all(spark):
    rows = spark.range(300).select(F.lit("b").alias("bucket"), F.when(F.col("id") < 200, "issue").otherwise("place").alias("kind"), F.col("id").cast("string").alias("chunk_key"), F.when(F.col("id") % 2 == 0, F.format_string("2024-%03d", "id")).alias("date"))
    kept = index.trim_buckets(rows, 50)
    assert kept.where("kind = 'place'").count() == 100
    assert kept.where("kind = 'issue'").agg(F.min("date")).first()[0] == "2024-100"


def test_first_five_rows_then_missing_ids_drop(spark):
    rows = spark.createDataFrame([(str(i), i, "Open", "2024-01-01", None if i == 1 else f"c{i}", "p") for i in range(7)], "chunk_key string, seq int, status string, grievance_date string, external_complaint_id string, place string")
    got = index.complaint_stats(rows.unionByName(rows), ["place"]).first()
    assert got["complaint_count"] == 7 and got["example_ids"] == ["c0", "c2", "c3", "c4"]


def test_monitor_ladder(spark):
    now = datetime.datetime(2026, 6, 30)
    kinds = [("ok", "success", 1), ("part", "partial", 1), ("old", "success", 60), ("bad", "failed", 1), ("soon", "success", -1)]
    reg = spark.createDataFrame([(k, "rules", "official", "download", "low", True, 30, "csv") for k, _, _ in kinds] + [("none", "rules", "official", "download", "low", True, 30, "csv"), ("man", "rules", "official", "manual_review", "high", True, 30, "csv")], "id string, domain string, official_status string, access_method string, pii_risk string, enabled boolean, freshness_policy_days int, format string")
    runs = spark.createDataFrame([(k, "r1", s, now - datetime.timedelta(days=d), None, []) for k, s, d in kinds], "source_id string, run_id string, status string, fetched_at timestamp, manifest_issue string, errors array<string>")
    ledger = spark.createDataFrame([("part", "r1", "x", "failed"), ("part", "r1", "y", "completed")], "source_id string, run_id string, resource_id string, status string")
    files = spark.createDataFrame([], "source_id string, run_id string, pos int, path string, bytes long")
    facts = spark.createDataFrame([], "path string, header string, rows long, geometry boolean, pdf_pages long")
    used = spark.createDataFrame([("man",)], "source_id string")
    rows = {r["source_id"]: r for r in monitor.monitor(reg, runs, monitor.resource_counts(ledger), monitor.profiles(reg, runs, files, facts), used, F.lit(now)).collect()}
    assert {k: r["monitor_status"] for k, r in rows.items()} == {"ok": "usable", "part": "partial", "old": "stale", "bad": "unavailable", "soon": "usable", "none": "unavailable", "man": "blocked"}
    assert "1 CKAN resource failed: x." in rows["part"]["caveats"] and rows["soon"]["archive_age_days"] == 0 and any("future" in c for c in rows["soon"]["caveats"])
    assert rows["man"]["summary_status"] == "used_without_monitor_ok"


def test_citations_number_by_first_use(spark):
    uses = spark.createDataFrame([(1, 1, "b"), (1, 2, "a"), (1, 3, "b")], "case_id int, seq int, source_id string")
    assert sorted((r["source_id"], r["citation"]) for r in packets.number_citations(uses, "case_id", ["source_id"]).collect()) == [("a", 2), ("b", 1)]


def test_lexical_rank_prefers_direct_rows(spark):
    rows = spark.createDataFrame([("p", 1, "a", "work", "street road", "", True), ("p", 2, "b", "work", "pothole", "Direct pothole", True), ("p", 3, "j", "jurisdiction", "x", "", True)], "packet_id string, pos int, chunk_id string, entity_type string, text string, label string, ok boolean")
    got = lexical_rank(rows, spark.createDataFrame([("p", "pothole street road")], "packet_id string, question string"), 2).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == [("b", 5.0), ("a", 2.0)]


def test_retrieval_scores_count_a_rank_once(spark):
    results = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "b", None), (1, 6, "c", None)], "case_id int, rank int, chunk_id string, legacy_id string")
    qrels = spark.createDataFrame([(1, "g", ["a", "x", "c"], ["b"]), (2, "g", [], []), (3, "g", ["z"], [])], "case_id int, group string, relevant array<string>, forbidden array<string>")
    got = {r["case_id"]: (r["precision_at_3"], round(r["recall_at_5"], 3), r["forbidden_at_5"]) for r in evaluation.retrieval_scores(results, qrels).collect()}
    assert got == {1: (0.5, 0.667, 1), 2: (1.0, 1.0, 0), 3: (0.0, 0.0, 0)}


def test_answer_suite(spark):
    kinds = (
        "case_id long, question string, category string, tokens long, must_contain array<string>, forbidden array<string>, forbidden_new_fact_contains array<string>, expected_refusal_status string, requires_caveat boolean, "
        "requires_existing_citations boolean"
    )
    suite = spark.createDataFrame([
        (1, "why", "a", 5, ["Ward 3"], ["secret"], None, "answered", True, True), (2, "why", "a", None, ["ward 3"], ["mail"], ["invented"], "refused", True, True), (3, "why", None, 1, None, None, None, None, None, None),
    ], kinds)
    shown = "case_id long, present_keys array<string>, rendered string, public_text string, caveat_text string, used_raw_scan boolean, used_packet_only boolean, used_private_data boolean, refusal_status string, cited array<string>, allowed array<string>"
    keys = evaluation.EXPLANATION_KEYS
    explained = spark.createDataFrame([
        (1, keys, "In WARD 3.", "clean", "This does not prove it.", False, True, False, "answered", ["e1"], ["e1", "e2"]),
        (2, keys[1:], "Invented mail", "write x@example.com", None, True, False, True, "answered", ["e9"], ["e1"]), (3, keys, None, None, None, None, True, None, None, None, None),
    ], shown)
    made = jobs.evaluate_answers(suite, explained)
    found = {r.case_id: r.failures for r in made["cases"].collect()}
    assert found[1] == [] and found[3] == []
    assert found[2] == [
        "missing_explanation_key=answer", "missing_term=ward 3", "forbidden_term=mail", "new_fact_term=invented", "used_raw_scan", "not_packet_only", "used_private_data", "pii_leak",
        "expected_refusal_status=refused, got=answered", "missing_caveat", "unfaithful_citation",
    ]
    assert {(r.category, r.total, r.passed, r.tokens) for r in made["categories"].collect()} == {("a", 2, 1, 5), ("uncategorized", 1, 1, 1)}


def test_packet_claims(spark):
    ids = lambda n: packets.numbered("evidence", F.lit(n))
    made = values(spark, packets.packet_claims(F.lit(True), ids(2), ids(0), F.lit("file it")))
    assert [(c.claim_type, c.citation_ids) for c in made] == [("jurisdiction", ["jurisdiction-1"]), ("public_work_or_payment", ["evidence-1", "evidence-2"])]
    made = values(spark, packets.packet_claims(F.lit(False), ids(None), ids(0), F.lit("file it")))
    assert [(c.claim_type, c.text, c.citation_ids) for c in made] == [("coverage_gap", "file it", [])]


def test_case_packets(spark):
    cases = spark.createDataFrame([(1, "streetlight not working near alpha"), (2, "garbage dump at nowhere"), (3, "pothole near alpha")], "case_id long, query string")
    wards = spark.createDataFrame([("old:7", "7", "Alpha", "alpha", "198", "old", 1)], "ward_key string, ward_number string, ward_name string, normalized_name string, ward_regime string, version string, seq int")
    mappings = spark.createDataFrame([], "old_ward_number string, old_ward_name string, new_ward_number string, new_ward_name string, old_name string, new_name string, seq int")
    aliases = spark.createDataFrame([], "alias string, canonical_ward_name string, confidence string, seq int")
    works = spark.createDataFrame([("w1", "s", "7", "198", "repair of street lights in alpha, mail x@example.com", "c", 5, 1)], "work_id string, source_id string, ward_number string, ward_regime string, description string, contractor string, amount long, row_number long")
    paid = spark.createDataFrame([], "payment_id string, source_id string, ward_number string, ward_regime string, payment_reference string, contractor string, net_amount long, row_number long")
    channels = spark.createDataFrame([("ch", "none", ["streetlight"])], "channel_id string, agency_id string, issue_types array<string>")
    responses = spark.createDataFrame([(3, 77.6, 12.9, '{"ward_no_name": "9-Beta"}')], "case_id long, lng double, lat double, response string")
    made = {r.case_id: r for r in jobs.case_packets(cases, wards, mappings, aliases, works, paid, channels, responses).collect()}
    assert len(made) == 3 and (made[3].source, made[3].ward_number, made[3].ward_name) == ("official_xyinfo", "9", "Beta")
    assert made[1].ward_name == "Alpha" and made[1].channels == ["ch"] and made[1].citation_ids == ["jurisdiction-1", "evidence-1", "channel-1"]
    assert made[1].failures == ["provenance.evidence_records[0] is not publishable"]
    assert made[2].evidence is None and made[2].failures == [] and [c.claim_type for c in made[2].claims] == ["coverage_gap"]
