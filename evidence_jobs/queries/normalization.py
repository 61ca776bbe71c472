"""Queries of the normalisation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_jobs.functions import privacy, text
from evidence_jobs.operators import normalize
from evidence_jobs.queries.registry import norm, query
from evidence_jobs.queries.views import LINE_ORDER

ORDER = ["source_id", "raw_file", "row_number"]
DAY_OK = "(complaint_id <> '' AND ward_name <> '' AND date_text <> 'soon')"


@query("prj01_evidence", "SELECT seq, source_id || '/' || run_id || '/' || raw_file || '/' || CAST(row_number AS VARCHAR) AS pointer, 'r1' AS fetched_at, 'grievances_v2' AS parser_version, 1 AS allowed FROM {raw_complaints}")
def _(d):
    e = normalize.evidence(*(F.col(c) for c in ("source_id", "run_id", "raw_file", "row_number")))
    m = normalize.claim_metadata("grievances", F.lit(""), F.col("run_id"))
    return d.raw_complaints.select("seq", F.concat_ws("/", e["source_id"], e["run_id"], e["raw_file"], e["row_number"]).alias("pointer"), m["fetched_at"].alias("fetched_at"), m["parser_version"].alias("parser_version"), F.size(m["allowed_claims"]).alias("allowed"))


@query("prj02_first_value", "SELECT seq, coalesce(nullif(trim(complaint_id), ''), nullif(trim(ward_name), ''), '') AS exact, coalesce(nullif(trim(ward_name), ''), nullif(trim(category), ''), '') AS present FROM {raw_complaints}")
def _(d):
    row = F.create_map(F.lit("id"), F.col("complaint_id"), F.lit("ward"), F.col("ward_name"))
    return d.raw_complaints.select("seq", text.first_of_map(row, "missing", "id", "ward").alias("exact"), text.first_present(F.col("ward_name"), F.col("category")).alias("present"))


@query("prj03_canonical_source", "SELECT l_orderkey % 2 AS kind, min(replace(replace(source_id, 'orders_payments', 'orders_and_payments'), 'orders_bill', 'orders_and_bill')) AS source_id, count(*) AS n FROM {raw_works} GROUP BY 1")
def _(d):
    return d.raw_works.groupBy((F.col("l_orderkey") % 2).alias("kind")).agg(F.min(normalize.canonical_work_source(F.col("source_id"))).alias("source_id"), F.count(F.lit(1)).alias("n"))


@query("prj04_ward_regime", "SELECT CASE l_linenumber % 5 WHEN 0 THEN '198' WHEN 1 THEN '225' WHEN 2 THEN '243' WHEN 3 THEN 'common' ELSE 'unknown' END AS regime, count(*) AS n FROM {raw_works} GROUP BY 1")
def _(d):
    return d.raw_works.groupBy(normalize.ward_regime(F.col("raw_file")).alias("regime")).agg(F.count(F.lit(1)).alias("n"))


REASON = """CASE WHEN complaint_id = '' THEN 'complaint row missing Complaint ID' WHEN ward_name = '' THEN 'complaint ' || complaint_id || ' missing Ward Name' WHEN date_text = 'soon' THEN 'invalid Grievance Date: soon' END"""


@query("prj05_rejections", f"SELECT row_number, {REASON} AS reason, 'call [REDACTED_PHONE] or [REDACTED_EMAIL]' AS remarks FROM {{raw_complaints}} WHERE {REASON} IS NOT NULL")
def _(d):
    rows = normalize.complaint_rows(d.raw_complaints).select("row_number", "reason").join(d.raw_complaints.select("row_number", "remarks"), "row_number")
    _, rejected = normalize.split_accepted(rows, F.col("reason"), F.create_map(F.lit("remarks"), F.col("remarks")))
    return rejected.select("row_number", "reason", F.col("row")["remarks"].alias("remarks"))


@query(
    "prj06_wards",
    """WITH t AS (SELECT n_nationkey AS k, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT k, CASE k % 4 WHEN 0 THEN 'gba' WHEN 1 THEN 'old' WHEN 2 THEN 'mapping' ELSE 'skip' END AS kind,
      CASE k % 4 WHEN 0 THEN 'gba:' || lower(r_name) || ':' || k WHEN 1 THEN 'old:' || k WHEN 2 THEN NULL END AS ward_key,
      CASE WHEN k % 4 = 2 AND k % 3 = 0 THEN 'mapping row missing new ward number or name' END AS reason FROM t""".replace("lower(r_name)", "trim(regexp_replace(lower(r_name), '[^a-z0-9]+', ' ', 'g'))"),
)
def _(d):
    k = F.col("n_nationkey").cast("string")
    kinds = [
        F.create_map(F.lit("Ward_No_Name"), F.concat(k, F.lit("-"), "n_name"), F.lit("Corporation_Name"), F.col("r_name"), F.lit("TOT_P"), F.lit("1,200")),
        F.create_map(F.lit("Ward No"), k, F.lit("Ward Name"), F.col("n_name"), F.lit("BBMP Zone Name"), F.col("r_name")),
        F.create_map(F.lit("Old Ward Num"), k, F.lit("New Ward Num"), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(k), F.lit("New Ward Name"), F.col("n_name")),
        F.create_map(F.lit("Complaint ID"), k, F.lit("Ward Name"), F.col("n_name")),
    ]
    row = F.when(F.col("n_nationkey") % 4 == 0, kinds[0]).when(F.col("n_nationkey") % 4 == 1, kinds[1]).when(F.col("n_nationkey") % 4 == 2, kinds[2]).otherwise(kinds[3])
    raw = d.nation.join(d.region, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("row", row)
    return normalize.ward_rows(raw).select(F.col("n_nationkey").alias("k"), "kind", F.when(F.col("kind").isin("gba", "old"), F.col("ward_key")).alias("ward_key"), "reason")


FIRST = f"SELECT *, row_number() OVER (PARTITION BY complaint_id ORDER BY source_id, raw_file, row_number) AS rn FROM {{raw_complaints}} WHERE {DAY_OK}"


@query("prj07_complaints", f"SELECT complaint_id AS external_complaint_id, row_number, substr(date_text, 1, 10) AS grievance_date, CAST(substr(date_text, 1, 4) AS INTEGER) AS year, {norm('ward_name')} AS ward, 'call [REDACTED_PHONE] or [REDACTED_EMAIL]' AS remarks FROM ({FIRST}) WHERE rn = 1")
def _(d):
    good, _ = normalize.normalize_complaints(d.raw_complaints, ORDER)
    return good.select("external_complaint_id", "row_number", "grievance_date", "year", F.col("normalized_ward_name").alias("ward"), F.col("staff_remarks").alias("remarks"))


SOURCE = "replace(replace(source_id, 'orders_payments', 'orders_and_payments'), 'orders_bill', 'orders_and_bill')"
WORK_ID = f"{SOURCE} || ':' || CASE WHEN external_id <> '' THEN external_id ELSE CAST(row_number AS VARCHAR) END"
CLEAN = "trim(regexp_replace(regexp_replace(description, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
LINE_SQL = ", ".join(LINE_ORDER)
GOOD_WORK = f"(external_id <> '' OR {CLEAN} <> '')"


def work_sql(where: str) -> str:
    return f"SELECT *, {WORK_ID} AS work_id, row_number() OVER (PARTITION BY {WORK_ID} ORDER BY {LINE_SQL}) AS rn FROM {{raw_works}} WHERE {GOOD_WORK} AND {where}"


@query("prj08_works", f"SELECT work_id, {CLEAN} AS description, CAST(trunc(CAST(amount AS DOUBLE)) AS BIGINT) AS amount FROM ({work_sql('true')}) WHERE rn = 1")
def _(d):
    return normalize.normalize_works(d.raw_works, LINE_ORDER)[0].select("work_id", "description", "amount")


@query("prj08_payments", f"SELECT work_id || ':payment' AS payment_id, payment_reference, CAST(replace(net_amount, ',', '') AS BIGINT) AS net_amount FROM ({work_sql("(payment_reference <> '' OR net_amount <> '')")}) WHERE rn = 1")
def _(d):
    return normalize.normalize_works(d.raw_works, LINE_ORDER)[1].select("payment_id", "payment_reference", "net_amount")


@query("prj08_rejections", f"SELECT row_number, 'work/payment row missing identifier and description' AS reason FROM {{raw_works}} WHERE NOT {GOOD_WORK}")
def _(d):
    return normalize.normalize_works(d.raw_works, LINE_ORDER)[2].select("row_number", "reason")


PAGE_SOURCE = "CASE page_id % 5 WHEN 0 THEN 'bwssb_page' WHEN 1 THEN 'bescom_page' WHEN 2 THEN 'btp_page' WHEN 3 THEN 'city_waste' ELSE 'other' END"


@query(
    "prj09_channels",
    f"""WITH t AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'bwssb' WHEN 1 THEN 'bescom' WHEN 2 THEN 'btp' WHEN 3 THEN 'bswml' ELSE '' END AS agency_id FROM pages)
    SELECT page_id, agency_id, CASE agency_id WHEN 'bwssb' THEN 4 WHEN 'bescom' THEN 4 WHEN 'btp' THEN 3 WHEN 'bswml' THEN 3 ELSE 0 END AS issue_types, CASE WHEN agency_id = '' THEN 'unknown channel agency' END AS reason, 'Address|Category|Sub Category' AS fields FROM t""",
)
def _(d):
    made = normalize.channel_rows(d.pages.select("page_id", F.expr(PAGE_SOURCE).alias("source_id"), F.concat("html", F.lit(" ADDRESS, sub category")).alias("text")))
    return made.select("page_id", "agency_id", F.coalesce(F.size("issue_types"), F.lit(0)).alias("issue_types"), "reason", F.array_join(F.filter("required_fields", lambda x: x.isin("Address", "Category", "Sub Category")), "|").alias("fields"))


@query("prj09_contacts", "SELECT CASE page_id % 5 WHEN 0 THEN 'bwssb' WHEN 1 THEN 'bescom' WHEN 2 THEN 'btp' ELSE 'bswml' END AS agency_id, sum(CASE WHEN page_id % 5 = 2 THEN 1 ELSE 2 END) AS contacts FROM pages WHERE page_id % 5 < 4 GROUP BY 1")
def _(d):
    made = normalize.channel_rows(d.pages.select(F.expr(PAGE_SOURCE).alias("source_id"), F.col("url").alias("text")))
    return normalize.contact_rows(made).groupBy("agency_id").agg(F.count("channel_id").alias("contacts"))


@query("win01_first_wins", f"SELECT {LINE_SQL}, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_SQL}, l_returnflag, l_linestatus) AS rn FROM lineitem) WHERE rn = 1")
def _(d):
    return normalize.first_wins(d.lineitem, ["l_orderkey", "l_linenumber"], [*LINE_ORDER[2:], "l_returnflag", "l_linestatus"]).select(*LINE_ORDER, "l_returnflag")


@query("agg15_row_counts", f"SELECT 'accepted' AS kind, count(DISTINCT complaint_id) AS n FROM {{raw_complaints}} WHERE {DAY_OK} UNION ALL SELECT 'rejected', count(*) FROM {{raw_complaints}} WHERE NOT {DAY_OK}")
def _(d):
    good, bad = normalize.normalize_complaints(d.raw_complaints, ORDER)
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(good, "accepted").unionByName(count(bad, "rejected"))


@query("agg16_categories", f"SELECT issue_category AS name, {norm('issue_category')} AS normalized_name, min(source_id) AS source_id FROM {{complaints}} GROUP BY 1, 2")
def _(d):
    return normalize.category_dimension(d.complaints, ["seq"])


@query("srt01_ward_order", "SELECT ward_key, row_number() OVER (ORDER BY version, CAST(ward_number AS INTEGER), ward_name) AS place FROM {wards}")
def _(d):
    from pyspark.sql import Window

    return d.wards.select("ward_key", F.row_number().over(Window.orderBy(*normalize.ward_order())).alias("place"))


@query("fn08_redact_columns", "SELECT doc_id, 'a [REDACTED_EMAIL]' AS note FROM documents")
def _(d):
    return privacy.redact_columns(d.documents.select("doc_id", F.concat(F.lit("a u"), F.col("doc_id"), F.lit("@example.com")).alias("note")))
