"""Views over the driver's tables, in SQL that Spark and DuckDB both run.

The tables hold no civic rows, so queries see them through these: orders as complaints,
nations as wards, order lines as works and payments, customers as cases.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Of a lineitem row, in the order that breaks all ties.
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]

VIEWS = {
    "wards": """
        SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'gba:' || LOWER(r_name) || ':' ELSE 'old:' END || CAST(n_nationkey AS STRING) AS ward_key,
               CASE WHEN n_nationkey % 2 = 0 THEN 'gba_wards' ELSE 'bbmp_wards' END AS source_id,
               CAST(n_nationkey AS STRING) AS ward_number, n_name AS ward_name, LOWER(REPLACE(n_name, '_', ' ')) AS normalized_name,
               CASE WHEN n_nationkey % 2 = 0 THEN 'gba_2025' ELSE 'old_bbmp' END AS version,
               CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE r_name END AS zone,
               CASE WHEN n_nationkey % 2 = 0 THEN r_name ELSE '' END AS corporation, 'AC ' || r_name AS assembly_constituency,
               CASE WHEN n_nationkey % 2 = 0 THEN '368_or_369' ELSE '198_or_225_or_243' END AS ward_regime, n_nationkey AS seq
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "mappings": """
        SELECT CAST(a.n_nationkey AS STRING) AS old_ward_number, a.n_name AS old_ward_name,
               CAST(b.n_nationkey AS STRING) AS new_ward_number, b.n_name AS new_ward_name,
               LOWER(REPLACE(a.n_name, '_', ' ')) AS old_name, LOWER(REPLACE(b.n_name, '_', ' ')) AS new_name,
               CAST(1.0 AS DOUBLE) AS confidence, a.n_nationkey AS seq
        FROM {nation} a JOIN {nation} b ON b.n_nationkey = (a.n_nationkey + 1) % 25 WHERE a.n_nationkey % 3 < 2""",
    "aliases": """
        SELECT 'colony ' || CAST(n_nationkey AS STRING) AS alias, LOWER(REPLACE(n_name, '_', ' ')) AS canonical_ward_name,
               CAST(0.8 AS DOUBLE) AS confidence, n_nationkey AS seq FROM {nation} WHERE n_nationkey % 3 = 0""",
    "complaints": """
        SELECT o_orderkey AS seq, CAST(o_orderkey AS STRING) AS external_complaint_id, o_orderpriority AS issue_category, c_mktsegment AS issue_subcategory,
               CAST(CAST(o_orderdate AS DATE) AS STRING) AS grievance_date, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS year,
               n_name AS ward_name_raw, LOWER(REPLACE(n_name, '_', ' ')) AS normalized_ward_name,
               CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderstatus END AS status, 'Clerk ' || CAST(c_custkey % 7 AS STRING) AS staff_name,
               CASE WHEN o_orderkey % 4 = 0 THEN 'street light failing' WHEN o_orderkey % 4 = 1 THEN 'garbage dump' WHEN o_orderkey % 4 = 2 THEN 'flooded road' ELSE 'other, at WardNo ' || CAST(o_orderkey % 25 AS STRING) END AS staff_remarks,
               'bbmp_grievances_data' AS source_id, 'original/c' || CAST(o_orderkey % 3 AS STRING) || '.csv' AS raw_file, o_orderkey AS row_number
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "raw_complaints": """
        SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 37 = 0 THEN '' ELSE CAST(o_orderkey - o_orderkey % 3 AS STRING) END AS complaint_id,
               CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE n_name END AS ward_name, o_orderpriority AS category, c_mktsegment AS sub_category,
               CASE WHEN o_orderkey % 43 = 0 THEN 'soon' WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) || ' 10:00:00.000000000' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date_text,
               o_orderstatus AS status, 'call 98450' || CAST(10000 + o_orderkey % 80000 AS STRING) || ' or a' || CAST(o_orderkey AS STRING) || '@example.com' AS remarks,
               'Clerk ' || CAST(c_custkey % 7 AS STRING) AS staff_name, 'bbmp_grievances_data' AS source_id, 'r1' AS run_id, 'original/c' || CAST(o_orderkey % 3 AS STRING) || '.csv' AS raw_file, o_orderkey AS row_number
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "raw_works": f"""
        SELECT {", ".join(LINE_ORDER)}, CASE WHEN l_orderkey % 2 = 0 THEN 'bbmp_work_orders_payments_2025_26' ELSE 'bbmp_work_orders_bill_payment' END AS source_id,
               CASE WHEN l_orderkey % 29 = 0 THEN '' ELSE CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) END AS external_id,
               CASE WHEN l_orderkey % 58 = 0 THEN '' ELSE '<b>' || p_name || '</b>  ' || LOWER(p_type) END AS description,
               s_name AS contractor, CAST(s_nationkey AS STRING) AS ward_number, CAST(CAST(FLOOR(l_extendedprice) AS BIGINT) AS STRING) || '.75' AS amount,
               CASE WHEN l_returnflag = 'R' THEN 'BR' || CAST(l_orderkey AS STRING) ELSE '' END AS payment_reference,
               CASE WHEN l_returnflag = 'R' THEN '1,' || CAST(100 + l_orderkey % 900 AS STRING) ELSE '' END AS net_amount,
               'original/works_' || CASE l_linenumber % 5 WHEN 0 THEN '198' WHEN 1 THEN '225' WHEN 2 THEN '243' WHEN 3 THEN 'Common' ELSE 'x' END || '.csv' AS raw_file,
               'r1' AS run_id, l_orderkey * 10 + l_linenumber AS row_number
        FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey JOIN {{supplier}} ON l_suppkey = s_suppkey""",
    "works": f"""
        SELECT work_id, source_id, ward_number, ward_regime, description, contractor, amount, row_number, returnflag FROM (
          SELECT 'w' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS work_id, 'bbmp_work_orders_and_payments_2025_26' AS source_id,
                 CAST(s_nationkey AS STRING) AS ward_number,
                 CASE l_linenumber % 4 WHEN 0 THEN '368_or_369' WHEN 1 THEN '198' WHEN 2 THEN 'common' ELSE 'unknown' END AS ward_regime,
                 p_name || ' ' || CASE p_partkey % 9 WHEN 0 THEN 'pothole filling' WHEN 1 THEN 'asphalting of roads' WHEN 2 THEN 'rcc drain culvert' WHEN 3 THEN 'street lights'
                   WHEN 4 THEN 'footpath paving' WHEN 5 THEN 'garbage collection' WHEN 6 THEN 'sewage pipe' WHEN 7 THEN 'road at nation ' || CAST(p_partkey % 25 AS STRING) ELSE LOWER(p_type) END AS description,
                 s_name AS contractor, CAST(FLOOR(l_extendedprice) AS BIGINT) AS amount, l_orderkey * 10 + l_linenumber AS row_number, l_returnflag AS returnflag,
                 ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(LINE_ORDER[2:])}) AS rn
          FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey JOIN {{supplier}} ON l_suppkey = s_suppkey) t WHERE rn = 1""",
    "payments": """
        SELECT work_id || ':payment' AS payment_id, work_id, source_id, ward_number, ward_regime, 'BR ' || work_id AS payment_reference, contractor, amount AS net_amount, row_number
        FROM {works} WHERE returnflag = 'R'""",
    "cases": """
        SELECT c_custkey AS case_id,
               CASE c_custkey % 9 WHEN 0 THEN 'Potholes on the road' WHEN 1 THEN 'Street light not working' WHEN 2 THEN 'Garbage dump again' WHEN 3 THEN 'Drain flooding'
                 WHEN 4 THEN 'Footpath broken' WHEN 5 THEN 'Power outage' WHEN 6 THEN 'Traffic blocked by digging' WHEN 7 THEN 'Sewage overflow' ELSE 'Tender and payment history' END
               || CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 7 = 1 THEN ' near colony ' || CAST(c_nationkey AS STRING) ELSE ' near ' || n_name END AS query
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "registry": """
        SELECT 's' || CAST(n_nationkey AS STRING) AS id, n_name AS name, 'https://data.example/' || LOWER(n_name) AS url,
               CASE n_nationkey % 7 WHEN 0 THEN 'wards' WHEN 1 THEN 'grievances' WHEN 2 THEN 'works_payments_tenders' WHEN 3 THEN 'streetlights' WHEN 4 THEN 'roads' WHEN 5 THEN 'rules' ELSE 'other' END AS domain,
               r_name AS agency, r_name AS publisher, CAST(n_nationkey % 4 AS INT) AS source_tier,
               CASE n_nationkey % 5 WHEN 0 THEN 'official' WHEN 1 THEN 'mirrored_official' WHEN 2 THEN 'community_signal' WHEN 3 THEN 'official_reference' ELSE 'official' END AS official_status,
               CASE n_nationkey % 6 WHEN 0 THEN 'csv' WHEN 1 THEN 'kml' WHEN 2 THEN 'pdf' WHEN 3 THEN 'html' WHEN 4 THEN 'ckan' ELSE 'zip' END AS format,
               CASE WHEN n_nationkey % 8 = 7 THEN 'manual_review' WHEN n_nationkey % 11 = 10 THEN 'official_portal_scrape_later' ELSE 'download' END AS access_method,
               'open' AS license, 'daily' AS update_frequency, CAST(n_nationkey % 3 * 10 AS INT) AS freshness_policy_days,
               CASE WHEN n_nationkey % 12 = 11 THEN 'high' ELSE 'low' END AS pii_risk, n_nationkey % 13 <> 12 AS enabled
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "runs": """
        SELECT 's' || CAST(user_id AS STRING) AS source_id, 'run-' || CAST(event_id + 100000000 AS STRING) AS run_id,
               CASE event_type WHEN 'purchase' THEN 'success' WHEN 'view' THEN 'partial' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'success' ELSE '' END AS status,
               ts, CAST(FLOOR(value * 100) AS BIGINT) AS bytes, event_id FROM {events}""",
    "ledger": """
        SELECT source_id, run_id, 'res' || CAST(event_id % 20 AS STRING) AS resource_id, CASE WHEN status = 'success' THEN 'completed' WHEN status = 'failed' THEN 'failed' ELSE 'pending' END AS status,
               CASE WHEN event_id % 2 = 0 THEN 'original/a' || CAST(event_id % 20 AS STRING) || '.csv' ELSE 'original/b' || CAST(event_id % 20 AS STRING) || '.PDF' END AS path,
               'h' || CAST(bytes % 7 AS STRING) AS sha256, bytes, event_id FROM {runs}""",
}

#: Tables whose rows cost much in the views that name them, by key: dealt to all tasks, as a file of one row group would be one task's work.
DEALT = {"cases": {"customer": "c_custkey"}, "complaints": {"orders": "o_orderkey"}, "raw_complaints": {"orders": "o_orderkey"}}


def needs(sql: str) -> list[str]:
    return list(dict.fromkeys(n for n in re.findall(r"\{(\w+)\}", sql)))


class Data:
    """The driver's tables and the views over them, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in VIEWS:
            return self.spark.sql(VIEWS[name], **{n: self._dealt(n, DEALT.get(name, {}).get(n)) for n in needs(VIEWS[name])})
        raise AttributeError(name)

    def payments_of(self, works: DataFrame) -> DataFrame:
        """The payments of a stored copy of the works."""
        return self.spark.sql(VIEWS["payments"], works=works)

    def _dealt(self, name: str, key: str | None) -> DataFrame:
        table = getattr(self, name)
        return table.repartition(self.spark.sparkContext.defaultParallelism, key) if key else table


def with_views(sql: str) -> str:
    """sql for DuckDB with the views that it names in braces as common table expressions in front."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in order:
            for inner in needs(VIEWS[name]):
                visit(inner)
            order.append(name)

    for name in needs(sql):
        visit(name)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    ctes = [f"{name} AS ({plain(VIEWS[name])})" for name in order]
    own = plain(sql).strip()
    if not ctes:
        return own
    start = re.match(r"WITH (RECURSIVE )?", own)
    return f"WITH {start[1] or '' if start else ''}{', '.join(ctes)}{', ' + own[start.end():] if start else ' ' + own}"
