"""Queries of the monitor, evaluation and trace-log operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_jobs.functions import policy
from evidence_jobs.operators import evaluation, monitor, tracelog
from evidence_jobs.queries.registry import query
from evidence_jobs.queries.scalars import ELIGIBLE, NOW


@query("src01_latest_success", "SELECT source_id, max(run_id) AS run_id, arg_max(bytes, run_id) AS bytes FROM {runs} WHERE status = 'success' GROUP BY 1")
def _(d):
    return monitor.latest_run(d.runs, "success").select("source_id", "run_id", "bytes")


@query("src02_latest_run", "SELECT source_id, max(run_id) AS run_id, arg_max(status, run_id) AS status FROM {runs} GROUP BY 1")
def _(d):
    return monitor.latest_run(d.runs).select("source_id", "run_id", "status")


@query("src03_manifest_files", "SELECT run_id, CAST(event_id % 2 AS INTEGER) AS pos, path FROM {ledger} WHERE lower(path) LIKE '%.csv'")
def _(d):
    from evidence_jobs.sources.readers import manifest_files

    runs = d.ledger.select("source_id", "run_id", F.when(F.col("event_id") % 2 == 0, F.array(F.struct("path", "bytes"))).otherwise(F.array(F.struct(F.lit("x.pdf").alias("path"), "bytes"), F.struct("path", "bytes"))).alias("files"))
    return manifest_files(runs, [".csv"]).select("run_id", "pos", "path")


@query("src09_resume_plan", "WITH prev AS (SELECT source_id, resource_id, arg_max(sha256, run_id) AS h FROM {ledger} WHERE status = 'completed' GROUP BY 1, 2), stems AS (SELECT source_id, regexp_extract(path, '([^/]+?)(\\.[^./]*)?$', 1) AS stem, arg_max(sha256, run_id) AS h FROM {ledger} WHERE status = 'completed' GROUP BY 1, 2) SELECT l.run_id, CASE WHEN coalesce(p.h, s.h) = l.sha256 THEN 'reused' ELSE 'fetch' END AS action FROM {ledger} l LEFT JOIN prev p ON p.source_id = l.source_id AND p.resource_id = l.resource_id LEFT JOIN stems s ON s.source_id = l.source_id AND s.stem = regexp_extract(l.path, '([^/]+?)(\\.[^./]*)?$', 1)")
def _(d):
    return monitor.resume_plan(d.ledger.drop("status"), d.ledger).select("run_id", "action")


@query("agg13_resource_counts", "SELECT source_id, count(*) AS expected, count(*) FILTER (status = 'completed') AS fetched, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending, CASE WHEN count(*) FILTER (status <> 'completed') = 0 THEN 'success' WHEN count(*) FILTER (status = 'completed') > 0 THEN 'partial' ELSE 'failed' END AS run_status FROM {ledger} GROUP BY 1")
def _(d):
    return monitor.resource_counts(d.ledger.withColumn("run_id", F.lit("all"))).drop("run_id", "failed_ids")


@query("agg13_inferred_counts", "WITH t AS (SELECT source_id, max(event_id) % 2 = 0 AS ok, count(DISTINCT resource_id) AS expected, count(DISTINCT CASE WHEN event_id % 3 = 0 THEN resource_id END) AS found FROM {ledger} GROUP BY 1), f AS (SELECT *, CASE WHEN found > 0 THEN found WHEN ok THEN expected ELSE 0 END AS fetched, CASE WHEN ok THEN 0 ELSE greatest(expected - found, 0) END AS failed FROM t) SELECT source_id, expected, fetched, failed, greatest(expected - fetched - failed, 0) AS pending FROM f")
def _(d):
    rows = d.ledger.withColumn("run_id", F.lit("r"))
    runs = rows.groupBy("source_id", "run_id").agg(F.when(F.max("event_id") % 2 == 0, "success").otherwise("partial").alias("status"))
    files = rows.where("event_id % 3 = 0").select("source_id", "run_id", F.concat(F.lit("original/"), "resource_id", F.lit(".csv")).alias("path"))
    return monitor.inferred_counts(rows.withColumn("state", F.lit(None).cast("string")), files, runs).drop("run_id")


def facts(d):
    return d.ledger.select("path").distinct().withColumns({"header": F.concat(F.lit("a|"), "path"), "rows": F.length("path").cast("long"), "geometry": F.lit(False), "pdf_pages": F.lit(2).cast("long")})


def file_rows(d):
    return d.ledger.select("source_id", "run_id", F.lit(0).alias("pos"), "path", "bytes")


DIFFICULTY = "CASE WHEN access_method = 'official_portal_scrape_later' THEN 'portal_later' WHEN official_status IN ('community_signal', 'external_reference', 'unofficial') THEN 'community_signal_only' WHEN format LIKE '%pdf%' THEN 'pdf_extract' WHEN format LIKE '%kml%' THEN 'geo_structured' WHEN format IN ('csv', 'ckan') THEN 'medium_structured' WHEN format = 'html' THEN 'html_snapshot_only' ELSE 'manual_review' END"
LAST = "(SELECT source_id, max(run_id) AS run_id, arg_max(status, run_id) AS status, arg_max(ts, run_id) AS ts FROM {runs} GROUP BY 1)"


@query("agg12_profiles", f"SELECT r.id AS source_id, coalesce(l.status, 'not_fetched') AS fetched_status, CASE WHEN f.path IS NULL THEN 0 ELSE 1 END AS file_count, coalesce(f.bytes, 0) AS total_bytes, CASE WHEN f.path LIKE '%.csv' THEN 'a|' || f.path ELSE '' END AS detected_columns, CASE WHEN f.path LIKE '%.csv' THEN 'easy_structured' WHEN f.path LIKE '%.PDF' THEN 'pdf_extract' ELSE {DIFFICULTY} END AS parser_difficulty FROM {{registry}} r LEFT JOIN {LAST} l ON l.source_id = r.id LEFT JOIN {{ledger}} f ON f.run_id = l.run_id")
def _(d):
    out = monitor.profiles(d.registry, d.runs, file_rows(d), facts(d))
    return out.select("source_id", "fetched_status", F.col("file_count").cast("int").alias("file_count"), "total_bytes", "detected_columns", "parser_difficulty")


def monitored(d):
    runs = d.runs.select("source_id", "run_id", "status", F.col("ts").alias("fetched_at"), F.when(F.col("status") == "", "Corrupt manifest.json for latest archive run.").alias("manifest_issue"), F.array().cast("array<string>").alias("errors"))
    used = d.registry.where("source_tier = 1").select(F.col("id").alias("source_id"))
    return monitor.monitor(d.registry, runs, monitor.resource_counts(d.ledger), monitor.profiles(d.registry, d.runs, file_rows(d), facts(d)), used, F.expr(NOW))


ELIG = f"CASE WHEN {ELIGIBLE} = 'not_public_output' OR pii_risk = 'high' OR NOT enabled OR access_method IN ('manual_review', 'private', 'account_linked', 'otp_login') THEN 'not_public_output' ELSE {ELIGIBLE} END"
ARCHIVE = "CASE WHEN l.run_id IS NULL THEN 'not_fetched' WHEN l.status = '' THEN 'needs_review' WHEN l.status = 'success' THEN 'archive_available' WHEN l.status = 'partial' THEN 'partial_archive' ELSE 'failed_archive' END"
MONITOR = f"""WITH m AS (SELECT r.*, l.run_id, l.status AS run_status, {ARCHIVE} AS archive_status, {ELIG} AS eligibility, greatest(0, CAST(floor((epoch({NOW}) - floor(epoch(l.ts))) / 86400) AS BIGINT)) AS age FROM {{registry}} r LEFT JOIN {LAST} l ON l.source_id = r.id),
    n AS (SELECT *, coalesce(age > freshness_policy_days AND freshness_policy_days > 0, false) AS is_stale FROM m),
    o AS (SELECT *, CASE WHEN eligibility = 'not_public_output' OR NOT enabled OR pii_risk = 'high' THEN 'blocked' WHEN archive_status = 'partial_archive' THEN 'partial' WHEN archive_status IN ('failed_archive', 'not_fetched', 'needs_review') THEN 'unavailable' WHEN is_stale THEN 'stale' ELSE 'usable' END AS monitor_status FROM n)
    SELECT id AS source_id, archive_status, monitor_status, coalesce(run_status, 'not_fetched') AS latest_fetch_status, age AS archive_age_days, is_stale, eligibility, CASE WHEN source_tier = 1 AND monitor_status NOT IN ('usable', 'stale', 'partial') THEN 'used_without_monitor_ok' ELSE monitor_status END AS summary_status, source_tier = 1 AS used FROM o"""


@query("jn20_monitor", f"SELECT source_id, archive_status, monitor_status, archive_age_days, is_stale, eligibility, summary_status FROM ({MONITOR})")
def _(d):
    return monitored(d).select("source_id", "archive_status", "monitor_status", "archive_age_days", "is_stale", "eligibility", "summary_status")


CAVEATS = MONITOR.rsplit("SELECT id AS source_id", 1)[0] + f""", e AS (SELECT o.*, CASE WHEN f.path LIKE '%.csv' THEN 'easy_structured' WHEN f.path LIKE '%.PDF' THEN 'pdf_extract' ELSE {DIFFICULTY} END AS difficulty, f.status AS ledger_status, f.resource_id, floor((epoch({NOW}) - floor(epoch(t.ts))) / 86400) < 0 AS ahead FROM o LEFT JOIN {{ledger}} f ON f.run_id = o.run_id LEFT JOIN {LAST} t ON t.source_id = o.id)
    SELECT id AS source_id, concat_ws(' | ', CASE WHEN archive_status = 'not_fetched' THEN 'No archived fetch run is available for this source root.' END, CASE WHEN run_status = '' THEN 'Corrupt manifest.json for latest archive run.' END,
      CASE ledger_status WHEN 'failed' THEN '1 CKAN resource failed: ' || resource_id || '.' WHEN 'pending' THEN '1 CKAN resource pending.' END, CASE WHEN run_id IS NULL THEN 'not fetched' END,
      CASE WHEN difficulty IN ('html_snapshot_only', 'portal_later', 'pdf_extract') THEN 'Parser status requires review: ' || difficulty || '.' END, CASE WHEN ahead THEN 'Archive timestamp is in the future relative to this monitor run; review clock/source metadata.' END, CASE WHEN is_stale THEN 'Last archived ' || age || ' days ago; freshness policy is ' || freshness_policy_days || ' days.' END,
      CASE WHEN pii_risk = 'high' THEN 'High PII risk blocks public-output proof from this source.' END, CASE WHEN access_method IN ('manual_review', 'private', 'account_linked', 'otp_login') THEN 'Manual/private/account-linked access blocks public-output proof in v1.' END) AS caveats,
      CASE WHEN run_id IS NULL THEN 'blocked' WHEN difficulty IN ('easy_structured', 'medium_structured', 'geo_structured') THEN 'profiled' ELSE difficulty END AS parser_status FROM e"""


@query("fn26_caveats", CAVEATS)
def _(d):
    return monitored(d).select("source_id", F.array_join("caveats", " | ").alias("caveats"), "parser_status")


@query("agg14_monitor_summary", f"SELECT count(*) AS total_sources, count(*) FILTER (latest_fetch_status = 'success') AS successful_fetches, count(*) FILTER (archive_status = 'not_fetched') AS not_fetched, count(*) FILTER (used) AS used_in_public_claims, {', '.join(f"count(*) FILTER (monitor_status = '{s}') AS {s}" for s in ('usable', 'partial', 'stale', 'unavailable', 'blocked'))}, count(*) FILTER (summary_status = 'used_without_monitor_ok') AS used_without_monitor_ok FROM ({MONITOR})")
def _(d):
    return monitor.monitor_summary(monitored(d))


@query("agg18_registry_errors", "SELECT id, 'pii_risk has invalid value odd' AS error FROM {registry} WHERE source_tier = 3 UNION ALL SELECT id, 'agency must not be empty' FROM {registry} WHERE source_tier = 2 UNION ALL SELECT 'same', 'duplicate source id same' WHERE (SELECT count(*) FROM {registry} WHERE source_tier = 0) > 1".replace("SELECT id, 'pii", "SELECT CASE WHEN source_tier = 0 THEN 'same' ELSE id END AS id, 'pii"))
def _(d):
    t = F.col("source_tier")
    rows = d.registry.withColumns({"pii_risk": F.when(t == 3, "odd").otherwise(F.col("pii_risk")), "agency": F.when(t == 2, "").otherwise(F.col("agency")), "id": F.when(t == 0, "same").otherwise(F.col("id"))})
    return monitor.registry_errors(rows)


@query("jn19_missing_urls", "SELECT DISTINCT url FROM pages WHERE page_id % 3 <> 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def _(d):
    claimed = monitor.claimed_urls(d.pages.where("page_id % 3 = 0").select(F.col("page_id").cast("string").alias("id"), "url"))
    return monitor.missing_urls(d.pages.select(F.concat(F.lit("see ("), "url", F.lit("), or.")).alias("text")), claimed)


@query("jn19_duplicate_urls", "SELECT url, string_agg(DISTINCT CAST(page_id % 7 AS VARCHAR), ',' ORDER BY CAST(page_id % 7 AS VARCHAR)) AS ids FROM (SELECT page_id, split_part(url, '?', 1) AS url FROM pages) GROUP BY 1 HAVING count(DISTINCT page_id % 7) > 1")
def _(d):
    rows = d.pages.select((F.col("page_id") % 7).cast("string").alias("id"), F.substring_index("url", "?", 1).alias("url"))
    return monitor.duplicate_urls(monitor.claimed_urls(rows)).select("url", F.array_join("source_ids", ",").alias("ids"))


EVENTS = "SELECT 'packet-' || CAST(user_id AS STRING) AS trace_id, event_id AS seq, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id % 997 END AS created_at_epoch_ms, event_type FROM {events}"


@query("srt02_newest_traces", f"SELECT seq FROM ({EVENTS}) ORDER BY coalesce(created_at_epoch_ms, 0) DESC, seq DESC LIMIT 50")
def _(d):
    return tracelog.newest_traces(d.spark.sql(EVENTS, events=d.events), 50).select("seq")


@query("win09_last_event", f"SELECT trace_id, max(seq) AS seq, arg_max(event_type, seq) AS event_type FROM ({EVENTS}) GROUP BY 1")
def _(d):
    return tracelog.last_event(d.spark.sql(EVENTS, events=d.events)).select("trace_id", "seq", "event_type")


# Retrieval judgements: a source is a case group; its documents by id are the ranking; quality is relevant, toxic is forbidden.
RANKING = "SELECT d.doc_id % 50 AS case_id, CAST(row_number() OVER (PARTITION BY d.doc_id % 50 ORDER BY d.doc_id) AS INT) AS rank, 'd' || CAST(d.doc_id AS STRING) AS chunk_id, CAST(NULL AS STRING) AS legacy_id FROM {documents} d"
JUDGED = "SELECT doc_id % 50 AS case_id, 'g' || CAST(doc_id % 50 % 4 AS STRING) AS grp, 'd' || CAST(doc_id AS STRING) AS id, quality, toxic FROM {labels}"
SCORES = f"""WITH r AS (SELECT * FROM ({RANKING}) WHERE rank <= 5), q AS (SELECT case_id, grp, list(id) FILTER (quality = 1) AS rel, list(id) FILTER (toxic = 1) AS forb FROM ({JUDGED}) GROUP BY 1, 2),
    s AS (SELECT q.case_id, grp, count(*) FILTER (rank <= 3 AND list_contains(coalesce(rel, []), chunk_id)) AS h3, count(rank) FILTER (rank <= 3) AS n3, count(DISTINCT chunk_id) FILTER (list_contains(coalesce(rel, []), chunk_id)) AS found, count(DISTINCT chunk_id) FILTER (list_contains(coalesce(forb, []), chunk_id)) AS bad, any_value(len(coalesce(rel, []))) AS wanted FROM q LEFT JOIN r ON r.case_id = q.case_id GROUP BY 1, 2)
    SELECT case_id, grp, CASE WHEN wanted = 0 THEN 1.0 WHEN n3 = 0 THEN 0.0 ELSE h3 / n3 END AS precision_at_3, CASE WHEN wanted = 0 THEN 1.0 ELSE found / wanted END AS recall_at_5, bad AS forbidden_at_5 FROM s"""


def scores(d):
    results = d.spark.sql(RANKING, documents=d.documents)
    ids = lambda ok: F.filter(F.collect_list(F.when(ok, F.col("id"))), lambda x: x.isNotNull())
    qrels = d.spark.sql(JUDGED, labels=d.labels).groupBy("case_id", F.col("grp").alias("group")).agg(ids(F.col("quality") == 1).alias("relevant"), ids(F.col("toxic") == 1).alias("forbidden"))
    return evaluation.retrieval_scores(results, qrels)


@query("agg20_retrieval_scores", f"SELECT case_id, round(precision_at_3, 6) AS p, round(recall_at_5, 6) AS r, forbidden_at_5 FROM ({SCORES})")
def _(d):
    return scores(d).select("case_id", F.round("precision_at_3", 6).alias("p"), F.round("recall_at_5", 6).alias("r"), F.col("forbidden_at_5").cast("long").alias("forbidden_at_5"))


@query("agg20_retrieval_groups", f"SELECT grp, count(*) AS total, round(avg(precision_at_3), 6) AS p, round(avg(recall_at_5), 6) AS r, round(avg(forbidden_at_5), 6) AS f FROM ({SCORES}) GROUP BY 1")
def _(d):
    return evaluation.retrieval_rollup(scores(d), "group").select(F.col("group").alias("grp"), "total", *(F.round(c, 6).alias(c[0]) for c in ("precision_at_3", "recall_at_5", "forbidden_at_5")))


SUITE = """SELECT doc_id AS case_id, source AS category, CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END AS expected_place, CASE WHEN doc_id % 6 = 0 THEN 'xx' ELSE lang END AS place, '' AS expected_issue, '' AS issue, '' AS expected_agency_id, '' AS agency_id,
    CASE WHEN doc_id % 4 = 0 THEN 2 END AS min_evidence_rows, CASE WHEN doc_id % 5 = 0 THEN 0 END AS max_evidence_rows, doc_id % 7 = 0 AS expected_abstention, doc_id % 8 = 0 AS requires_freshness_disclosure, doc_id % 9 = 0 AS dated, n_chars FROM {documents}"""


def suite(d):
    rows = d.spark.sql(SUITE, documents=d.documents)
    one = lambda x: F.array(F.lit(x))
    return evaluation.case_failures(
        rows.withColumns({
            "required_evidence_contains": F.when(F.col("case_id") % 10 == 0, one("Missing")).otherwise(F.array().cast("array<string>")), "forbidden_evidence_contains": F.when(F.col("case_id") % 11 == 0, one("PUBLIC")).otherwise(F.array().cast("array<string>")),
            "evidence_texts": one("public row"), "packet_status": F.lit("ready"), "latest_record_date": F.when(F.col("dated"), "2024-01-01"), "public_text": F.lit("text"),
        })
    )


FAILS = "(case_id % 6 = 0)::INT + (case_id % 4 = 0)::INT + (case_id % 5 = 0)::INT + (case_id % 10 = 0)::INT + (case_id % 11 = 0)::INT + (case_id % 8 = 0 AND case_id % 9 <> 0)::INT + (case_id % 7 = 0)::INT"


@query("fn33_case_failures", f"SELECT case_id, {FAILS} AS failures FROM (SELECT doc_id AS case_id FROM documents)")
def _(d):
    return suite(d).select("case_id", F.size("failures").alias("failures"))


@query("src06_required_cases", "SELECT case_id, query FROM {cases}")
def _(d):
    return evaluation.required_cases(d.cases)


@query("agg19_packet_metrics", f"SELECT count(*) AS total, count(*) FILTER ({FAILS} = 0) AS passed, round(avg((case_id % 4 = 0)::INT), 6) AS agency_accuracy, 1.0::DOUBLE AS jurisdiction_accuracy, round(avg(CASE WHEN case_id % 8 = 0 THEN (case_id % 9 = 0)::INT END), 6) AS freshness_disclosure_rate, 0.0::DOUBLE AS abstention_accuracy, 'failed' AS gate FROM (SELECT doc_id AS case_id FROM documents)")
def _(d):
    none = F.lit(None).cast("boolean")
    rows = suite(d).withColumns({"agency_ok": F.col("case_id") % 4 == 0, "jurisdiction_ok": none, "precision_at_3": F.lit(None).cast("double"), "wrong_locality": none, "pii_leak": F.lit(False), "unsupported": F.lit(False), "raw_scan": F.lit(False)})
    out = evaluation.packet_metrics(rows)
    return out.select("total", "passed", F.round("agency_accuracy", 6).alias("agency_accuracy"), "jurisdiction_accuracy", F.round("freshness_disclosure_rate", 6).alias("freshness_disclosure_rate"), "abstention_accuracy", "gate")


@query("agg21_category_rollup", f"SELECT category, count(*) AS total, count(*) FILTER ({FAILS} = 0) AS passed, sum(n_chars)::BIGINT AS tokens, count(*) FILTER ({FAILS} > 0) AS failed FROM (SELECT doc_id AS case_id, source AS category, n_chars FROM documents) GROUP BY 1")
def _(d):
    return evaluation.category_rollup(suite(d).withColumn("tokens", F.col("n_chars"))).select("category", "total", "passed", "tokens", "failed")


@query("agg22_failure_terms", f"SELECT category AS run_id, round(avg((case_id % 4 = 0)::INT), 6) AS rate FROM (SELECT doc_id AS case_id, source AS category FROM documents) GROUP BY 1")
def _(d):
    return evaluation.failure_term_rate(suite(d).withColumnRenamed("category", "run_id"), "min_evidence").select("run_id", F.round("rate", 6).alias("rate"))


PREFIXES = {
    "expected_place": "case_id % 6 = 0", "min_evidence_rows": "case_id % 4 = 0", "max_evidence_rows": "case_id % 5 = 0", "missing_evidence_text": "case_id % 10 = 0", "forbidden_evidence_text": "case_id % 11 = 0",
    "missing_freshness_disclosure": "case_id % 8 = 0 AND case_id % 9 <> 0", "expected_abstention": "case_id % 7 = 0",
}


@query("agg22_failure_prefixes", " UNION ALL ".join(f"SELECT source AS run_id, '{k}' AS prefix, count(*) AS n FROM (SELECT source, doc_id AS case_id FROM documents) WHERE {v} GROUP BY 1" for k, v in PREFIXES.items()))
def _(d):
    return evaluation.failure_prefixes(suite(d).withColumnRenamed("category", "run_id"))


@query("fn25_source_policy", f"SELECT id, {ELIGIBLE} AS eligibility FROM {{registry}}")
def _(d):
    return d.registry.select("id", policy.claim_eligibility(*(F.col(c) for c in ("id", "domain", "official_status", "access_method", "pii_risk", "enabled"))).alias("eligibility"))
