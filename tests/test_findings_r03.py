"""What the findings of round 3 were about, on small tables."""

import re

import duckdb
from pyspark.sql import functions as F

from evidence_jobs import queries as own
from evidence_jobs.functions import routing, text
from evidence_jobs.operators import index, matching, normalize, packets, places, resolve, retrieval
from evidence_jobs.plans import archive, jobs
from evidence_jobs.queries import views


def test_cut_card_number(spark, tmp_path):
    """the first 20 characters end in ten digits of a card number, which its SQL leaves as they are."""
    texts = [(0, "Nicht era 8447238401328123 ung"), (1, "call 9845065509 now or later"), (2, "plain")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {tuple(r) for r in con.sql(own.oracle_sql()["fn07_redact"]).fetchall()}
    assert {tuple(r) for r in own.queries()["fn07_redact"](spark, str(tmp_path)).select("doc_id", "redacted", "personal").collect()} == want


def test_questions_meet_classes(spark):
    """What questions meet does not grow with copies of chunks, and counts, answers, tracks and best rows are those of all ranked rows."""
    terms = ["road", "alpha", "12"]
    schema = "case_id int, query string, names array<string>, numbers array<string>, issue_keys array<string>, wants_complaints boolean, wants_money boolean, needs_money boolean, wants_assets boolean, terms array<string>, all_terms array<string>, complaint_terms array<string>, money_terms array<string>"
    q = spark.createDataFrame([(1, "alpha road 12", ["alpha", "gamma"], ["12"], ["road", "garbage"], True, False, False, False, terms, terms, [], []), (2, "any road", [], [], ["road", "drain"], True, False, False, False, ["road"], ["road"], [], [])], schema)
    words = ["pothole at ward12 near market", "pothole in alpha, drain", "garbage in alpha", "road of beta 12"]

    def found(n):
        made = [(f"complaint|s|f|{i}", "complaint", "s", "f", i, "Road complaint", words[i % 4], {"status": "Open" if i % 3 else "", "external_complaint_id": None if i % 5 == 0 else f"e{i}", "staff_name": f"x{i % 7 // 4}"}, None if i % 11 == 0 else f"2025-01-{i % 27 + 1:02d}") for i in range(n)]
        rows = spark.createDataFrame(made, "chunk_key string, chunk_type string, source_id string, raw_file string, row_number long, title string, text string, fields map<string,string>, date string")
        names, numbers = spark.createDataFrame([("alpha",), ("beta",)], "name string"), spark.createDataFrame([("12", ["gamma"])], "number string, names array<string>")
        return retrieval.search(q, index.with_search_text(rows), places=(names, numbers))

    few, many = found(220), found(880)
    assert 0 < many.met.count() == few.met.count()
    pick = lambda df, *columns: sorted(map(str, df.select(*columns).collect()))
    rows = few.rows.persist()
    assert rows.count() > 220
    assert pick(few.counts(), "case_id", "chunk_type", "n") == pick(rows.groupBy("case_id", "chunk_type").agg(F.count(F.lit(1)).alias("n")), "case_id", "chunk_type", "n")
    answer = ["case_id", "complaint_rows", "work_payment_rows", "latest_record_date", "status_counts", "example_ids"]
    assert pick(few.answers(), *answer) == pick(retrieval.extractive_answer(rows), *answer)
    track = ["case_id", "issue", "rows", "complaint_ids", "types"]
    assert pick(few.tracks(), *track) == pick(retrieval.issue_tracks(few.questions, rows), *track)
    assert pick(few.best(12).where("rank <= 12"), "case_id", "rank", "chunk_key", "score") == pick(rows.where("rank <= 12"), "case_id", "rank", "chunk_key", "score")
    roles = lambda df: pick(packets.ordered_distinct(retrieval.routed_roles(df), "case_id", "role"), "case_id", "values")
    assert roles(few.first_by("staff_name")) == roles(rows)


def test_fields_of_wide_rows_compile(spark, tmp_path):
    """the fields of a work row were more code than the JVM compiles (8,000 bytes a method), so they ran interpreted."""
    spark.sql("SELECT map('id', ' j1 ', 'amount', '') AS row, 's' AS source_id").write.parquet(str(tmp_path / "raw"))
    fields = archive._fields(spark.read.parquet(str(tmp_path / "raw")), archive.WORK_FIELDS, "source_id")
    code = spark._jvm.PythonSQLUtils.explainString(fields._jdf.queryExecution(), "codegen")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000
    assert fields.select("external_id", "amount", "contractor").collect() == [("j1", "", "")]


def test_chunk_texts_are_read_once_and_compiled(spark):
    """The alias tests of issue keys ran interpreted in a filter, and a ward name was normalised five times a row."""
    row = spark.range(1).withColumn("search_text", F.concat(F.lit("street light failing, dump "), F.col("id"))).withColumn("fields", F.create_map(F.lit("ward_name"), F.concat(F.lit("Alphau Ward "), F.col("id")), F.lit("Ward No"), F.lit(" 12 ")))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    keys = row.select(text.normalized_issue_keys(F.col("search_text")).alias("k"))
    assert "lambda" not in plan(keys) and keys.first()["k"] == ["streetlight", "garbage"]
    names = row.select(*(c.alias(n) for n, c in index.place_columns().items()))
    assert plan(names.select("_fields")).count(r"\bward\b") == 1
    assert names.first() == (["alphau 0", "alphau 0"], ["12", "0"])


def test_questions_meet_classes_of_records(spark):
    """Every pair of a question and a record was made and brought together; now only the first records of a class leave their task."""
    said = ["pothole filling at alpha", "asphalt of alpha road", "drain culvert", "plain words", "street light of beta"]
    made = [("work" if i % 3 else "payment", f"r{i:04d}", "s", said[i % 5], "c", 10 + i, i // 2, str(i % 3), ["198", "common", "368"][i % 7 % 3]) for i in range(1500)]
    columns = "entity_type string, record_id string, source_id string, claim string, contractor string, amount long, row_number long, ward_number string, ward_regime string"
    cases = [(i, "road", intent, ["road", "drain"], ward, regime, place, terms) for i, (intent, ward, regime, place, terms) in enumerate([("road_pothole", "1", "198", "alpha", ["pha r"]), ("road_drain", "2", "368", "", ["culvert"]), ("streetlight", "", "unknown", "beta", []), ("road_pothole", "1", "198", "alpha", ["pha r"]), ("civic", "0", "225", "none", [])])]
    asked = spark.createDataFrame(cases, "case_id int, issue_type string, intent string, match_terms array<string>, ward_number string, ward_regime string, place string, terms array<string>")
    records = lambda n: matching.with_text(spark.createDataFrame(made[:n], columns))
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "w string")
    few, many = (matching.leading_records(records(n), words("alpha", "pha r", "culvert"), words("road", "drain")) for n in (1500, 1490))
    sizes = few.groupBy("entity_type", "ward_number", "ward_regime", "_held", "_words", *(f"_{w}" for w in ("pothole", "surface", "footpath", "drain", "light"))).count()
    assert sizes.where("count > 20").isEmpty() and few.count() < 1500 and many.count() < 1490
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan

    gate = routing.issue_match(F.col("intent"), F.col("match_terms"), F.col("text"))
    r = records(1500).withColumnsRenamed({"ward_number": "w", "ward_regime": "g"})
    on_ward = (F.col("ward_number") != "") & (F.col("ward_number") == F.col("w")) & matching.regimes_compatible(F.col("ward_regime"), F.col("g"))
    in_text = F.exists(F.concat(F.array("place"), "terms"), lambda t: (t != "") & F.col("text").contains(t))
    pairs = asked.crossJoin(r).where(gate & (on_ward | in_text)).withColumn("m", routing.rank_match(F.col("intent"), F.col("text"), on_ward))
    want: dict = {}
    for p in sorted(pairs.collect(), key=lambda p: (p["case_id"], -p["m"]["confidence"], p["entity_type"] != "work", p["row_number"], p["record_id"])):
        own = want.setdefault(p["case_id"], [])
        own += [(len(own) + 1, p["record_id"], p["m"]["label"])] * (len(own) < matching.MOST_MATCHES)
    got = matching.match_records(asked, records(1500)).orderBy("case_id", "rank").collect()
    assert [(g["case_id"], g["rank"], g["record_id"], g["label"]) for g in got] == [(c, *x) for c, rows in want.items() for x in rows] and len(want) > 3


def test_rows_of_one_file_are_dealt(spark):
    """A table in one row group was one task's work in all that is made of its rows."""
    d = views.Data(spark, "/root/testdata/sf0.001")
    assert all(df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism for df in (d.cases, d.complaints))


def test_first_rows_read_what_is_wanted(spark):
    """all columns of a work row were cleaned, sorted and shuffled for a query that wants two of them."""
    made = [(i, f"e{i % 5}", f"<b>d{i}</b>", f"c{i}", "1", "7.5", "", "", "s", "r", "f198.csv", i) for i in range(20)]
    raw = spark.createDataFrame(made, "l int, external_id string, description string, contractor string, ward_number string, amount string, payment_reference string, net_amount string, source_id string, run_id string, raw_file string, row_number long")
    works = normalize.normalize_works(raw, ["l"])[0].select("work_id", "description")
    assert "contractor" not in works._jdf.queryExecution().executedPlan().toString().split("Scan")[0]
    assert sorted(tuple(r) for r in works.collect()) == [(f"s:e{i}", f"d{i}") for i in range(5)]


def test_queries_are_answered_once(spark):
    """each case met the index's counts by itself; now the first case of a query does."""
    cases = spark.createDataFrame([(i, ["a b", "c", None][i % 3]) for i in range(1, 31)], "case_id int, query string")
    seen = []

    def answer(some):
        seen.append(some.count())
        return some.where("query <> 'c' OR query IS NULL").select("case_id", F.explode(F.split(F.coalesce("query", F.col("case_id").cast("string")), " ")).alias("word"))

    got = sorted(tuple(r) for r in resolve.once_per_query(cases, answer).select("case_id", "word").collect())
    assert got == sorted((i, w) for i in range(1, 31) for w in {0: ["a", "b"], 1: [], 2: [str(i)]}[i % 3]) and seen == [12]


def test_evidence_is_made_once_a_question(spark, monkeypatch):
    """evidence rows, their hashes and provenance were made for every case, however many ask the same."""
    d = views.Data(spark, "/root/testdata/sf0.001")
    works, cases = d.works.where("row_number % 5 < 2").persist(), d.cases.where("case_id BETWEEN 1 AND 40")
    twice = cases.unionByName(cases.withColumn("case_id", F.col("case_id") + 1000))
    made, plain = [], packets.with_provenance
    monkeypatch.setattr(packets, "with_provenance", lambda rows, *rest: made.append(rows.count()) or plain(rows, *rest))
    channels = spark.createDataFrame([("a", "gba", ["road"])], "channel_id string, agency_id string, issue_types array<string>")
    once, both = (jobs.case_packets(c, d.wards, d.mappings, d.aliases, works, d.payments_of(works), channels, now=F.expr("TIMESTAMP '2024-01-30 00:00:00'")) for c in (cases, twice))
    assert made[0] == made[1] > 0
    rows = {r["case_id"]: str(r[1:]) for r in both.collect()}
    assert len(rows) == 80 and all(rows[i] == rows[i + 1000] for i in list(rows) if i < 1000)
    assert {r["case_id"]: str(r[1:]) for r in once.collect()} == {i: r for i, r in rows.items() if i < 1000}
    assert once.where("total > 0").count() > 0 and once.where("total <> coalesce(size(evidence), 0)").isEmpty()


def test_index_looks_for_places_once(spark, monkeypatch):
    """places of complaints were looked for twice, for the buckets and for the counts."""
    d = views.Data(spark, "/root/testdata/sf0.001")
    seen, plain = [], index.with_places
    monkeypatch.setattr(index, "with_places", lambda *rest: seen.append(1) or plain(*rest))
    built = jobs.build_index(index.complaint_chunks(d.complaints.where("seq % 9 = 0")), d.wards, d.mappings)
    assert len(seen) == 1 and built["buckets"].count() > 0 and built["buckets"].columns == ["chunk_key", "chunk_type", "date", "kind", "bucket"]
    assert built["stats"].where("issue IS NULL").agg(F.sum("complaint_count")).first()[0] == built["buckets"].where("kind = 'place'").count()


def test_texts_are_read_in_batches(spark):
    """F16: search texts were made by patterns row by row; without one, places and issues are found in whole batches, and are the same."""
    said = ["Ward No 12, near Nation_3!", "nation-3 and\nward_12", "éward 7 alphau", "ward ward 9 nation", "3 garbage; street\tlight", "wardno 7", "WARDNUMBER 12 Nation  3", "", None, "x ward 12 ward", "ward nation ward 3", "St. Light at wardn 7, İ nation 3"]
    fields = [{"ward_name": "Alphau Ward"}, {"Ward No": " 12 ", "x": "nation"}, {"near_ward": "7 | ward"}, {}, {"k": None}, {"Ward": "é12"}]
    made = [(f"k{i}{j}", "complaint", t, said[i - 1], f) for i, t in enumerate(said) for j, f in enumerate(fields)]
    chunks = spark.createDataFrame(made, "chunk_key string, chunk_type string, title string, text string, fields map<string,string>").repartition(3)
    names = spark.createDataFrame([("nation 3",), ("alpha",), ("alphau",), ("nation",), ("a\n b",), ("one two three four five",)], "name string")
    numbers = spark.createDataFrame([("12", ["nation 3", "twelve"]), ("7", ["alpha"])], "number string, names array<string>")
    rows = lambda df: sorted((r["chunk_key"], tuple(r["places"]), tuple(r["issues"])) for r in df.collect())
    plain = index.with_keys(chunks, names, numbers, ["chunk_key"])
    want = index.with_keys(index.with_search_text(chunks), names, numbers, ["chunk_key"])
    assert rows(plain) == rows(want) and {p for _, ps, _ in rows(plain) for p in ps} == {"nation 3", "twelve", "alpha", "alphau", "nation"}
    assert "regexp_replace" in want._jdf.queryExecution().optimizedPlan().toString()
    assert rows(index.with_places(chunks, names.limit(0), numbers.limit(0), ["chunk_key"]).withColumn("issues", F.array())) == [(k, (), ()) for k, *_ in sorted(made)]


def test_totals_read_classes_of_complaints(spark):
    """F32: every complaint was stored with all its columns for each place that it belongs to, and each total read them all."""
    d = views.Data(spark, "/root/testdata/sf0.001")
    complaints = d.complaints.withColumn("grievance_date", F.when(F.col("seq") % 5 > 0, F.concat(F.lit(" "), "grievance_date"))).withColumn("year", F.when(F.col("seq") % 6 > 0, F.col("year")))
    copies = complaints.unionByName(complaints.withColumn("seq", F.col("seq") + 1_000_000)).persist()
    few, many = places.complaint_classes(complaints), places.complaint_classes(copies)
    assert few.count() == many.count() < complaints.count() and many.agg(F.sum("copies")).first()[0] == copies.count()
    asked = spark.createDataFrame([(1, "nation 3"), (2, "nation 4"), (3, "region_1"), (4, "nowhere")], "place_id int, query string")
    made = jobs.place_truth(asked, d.wards, d.mappings, copies)
    matched = places.place_complaints(places.relevant_names(asked, d.wards, d.mappings), copies).persist()
    lensed, keys = places.with_lenses(matched), ["place_id", "lens"]
    want = {
        "grid": places.truth_cells(asked, lensed), "by_status": places.counters(lensed, keys, "status"), "by_year": places.counters(lensed, keys, "year"), "categories": places.top_categories(lensed, keys),
        "examples": places.first_examples(lensed, keys), "scope": places.record_scope(matched, ["place_id"]), "facts": places.dossier_facts(matched), "sources": lensed.select(*keys, "source_id").distinct(),
    }
    for name, df in want.items():
        assert sorted(map(str, made[name].select(*df.columns).collect())) == sorted(map(str, df.collect())), name
    assert want["examples"].count() > 10
