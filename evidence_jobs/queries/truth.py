"""Queries of the place-truth operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_jobs.functions import policy
from evidence_jobs.operators import places
from evidence_jobs.queries.registry import query

# Places: every nation by name, the regions, and one query that names a ward among other words.
PLACES = "SELECT n_nationkey AS place_id, LOWER(REPLACE(n_name, '_', ' ')) AS query FROM {nation} UNION ALL SELECT 100 + r_regionkey, LOWER(r_name) FROM {region} UNION ALL SELECT 200, 'near nation 3 market'"
P = "p AS (" + PLACES + ")"
SCORE = "CASE WHEN normalized_name = query THEN 1.0 WHEN contains(normalized_name, query) THEN 0.85 WHEN contains(query, normalized_name) THEN 0.75 ELSE 0.0 END"
AREA = [f"CASE WHEN {n} = '' THEN 0.0 WHEN {n} = query THEN 0.7 WHEN contains({n}, query) OR contains(query, {n}) THEN 0.55 ELSE 0.0 END" for n in ("trim(regexp_replace(lower(zone), '[^a-z0-9]+', ' ', 'g'))", "trim(regexp_replace(lower(corporation), '[^a-z0-9]+', ' ', 'g'))", "trim(regexp_replace(lower(assembly_constituency), '[^a-z0-9]+', ' ', 'g'))")]
AREA_HITS = f"SELECT place_id, query, ward_key, ward_name, normalized_name, greatest({', '.join(AREA)}) AS score, CASE WHEN {AREA[2]} > 0 THEN assembly_constituency WHEN {AREA[1]} > 0 THEN corporation ELSE zone END AS area FROM p JOIN {{wards}} ON greatest({', '.join(AREA)}) > 0"
MAPPED = "SELECT place_id, query, m.old_ward_number AS ward_number, coalesce(w.ward_key, 'old:' || m.old_ward_number) AS ward_key, coalesce(w.ward_name, m.old_ward_name) AS ward_name, coalesce(w.normalized_name, m.old_name) AS normalized_name, m.confidence AS score FROM p JOIN {mappings} m ON m.new_name = query LEFT JOIN {wards} w ON w.version = 'old_bbmp' AND w.ward_number = m.old_ward_number"
NAMES = f"SELECT place_id, query AS name FROM p UNION SELECT place_id, normalized_name FROM p JOIN {{wards}} ON {SCORE} > 0 UNION SELECT place_id, normalized_name FROM ({AREA_HITS}) UNION SELECT place_id, normalized_name FROM ({MAPPED}) UNION SELECT place_id, old_name FROM p JOIN {{mappings}} ON query IN (old_name, new_name) UNION SELECT place_id, new_name FROM p JOIN {{mappings}} ON query IN (old_name, new_name)"
MATCHED = f"SELECT place_id, c.* FROM {{complaints}} c JOIN ({NAMES}) n ON c.normalized_ward_name = n.name"
LENS = "SELECT m.*, lens FROM m JOIN (SELECT 'all' AS lens, NULL AS a, NULL AS b UNION ALL SELECT 'recent', 1998, NULL UNION ALL SELECT 'single', 1997, 1997) l ON (a IS NULL OR year >= a) AND (b IS NULL OR year <= b)"


def asked(d):
    return d.spark.sql(PLACES, nation=d.nation, region=d.region)


def matched(d):
    return places.place_complaints(places.relevant_names(asked(d), d.wards, d.mappings), d.complaints)


@query("jn01_ward_score", f"WITH {P} SELECT place_id, ward_key, CAST({SCORE} AS DOUBLE) AS score FROM p JOIN {{wards}} ON {SCORE} > 0")
def _(d):
    return places.ward_candidates(asked(d), d.wards).select("place_id", "ward_key", F.col("match_score").alias("score"))


@query("jn02_area_score", f"WITH {P} SELECT place_id, ward_key, CAST(score AS DOUBLE) AS score, area FROM ({AREA_HITS})")
def _(d):
    return places.area_candidates(asked(d), d.wards).select("place_id", "ward_key", F.col("match_score").alias("score"), F.col("matched_area").alias("area"))


@query("jn03_mapped_old", f"WITH {P} SELECT place_id, ward_key, ward_name, score FROM ({MAPPED})")
def _(d):
    return places.mapped_candidates(asked(d), d.mappings, d.wards).select("place_id", "ward_key", "ward_name", F.col("match_score").alias("score"))


@query(
    "jn03_merged_old",
    f"""WITH {P}, own AS (SELECT place_id, ward_key, ward_number, ward_name FROM p JOIN {{wards}} ON {SCORE} > 0 WHERE version = 'old_bbmp'), mapped AS ({MAPPED})
    SELECT place_id, ward_key FROM own UNION ALL SELECT DISTINCT place_id, ward_key FROM mapped m WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.place_id = m.place_id AND o.ward_number = m.ward_number AND o.ward_name = m.ward_name)""",
)
def _(d):
    own = places.ward_candidates(asked(d), d.wards).where("version = 'old_bbmp'")
    return places.merged_old_candidates(own, places.mapped_candidates(asked(d), d.mappings, d.wards)).select("place_id", "ward_key")


@query("jn04_place_complaints", f"WITH {P} SELECT place_id, count(*) AS n, sum(seq) AS total FROM ({MATCHED}) GROUP BY 1")
def _(d):
    return matched(d).groupBy("place_id").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("total"))


@query("set03_relevant_names", f"WITH {P} SELECT * FROM ({NAMES})")
def _(d):
    return places.relevant_names(asked(d), d.wards, d.mappings)


@query("flt01_year_range", "SELECT seq, year >= 1996 AND year <= 1998 AS bounded, year >= 1997 AS from_1997, true AS unbounded FROM {complaints}")
def _(d):
    of = lambda a, b: places.in_years(F.col("year"), F.lit(a).cast("int"), F.lit(b).cast("int"))
    return d.complaints.select("seq", of(1996, 1998).alias("bounded"), of(1997, None).alias("from_1997"), of(None, None).alias("unbounded"))


def counter_sql(column: str, keys: str = "place_id") -> str:
    return f"SELECT {keys}, CAST({column} AS VARCHAR) AS value, count(*) AS n, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, min(seq)) AS rank FROM m WHERE {column} IS NOT NULL AND CAST({column} AS VARCHAR) <> '' GROUP BY {keys}, {column}"


@query("agg01_status_counts", f"WITH {P}, m AS ({MATCHED}) {counter_sql('status')}")
def _(d):
    return places.counters(matched(d), ["place_id"], "status")


@query("agg01_year_counts", f"WITH {P}, m AS ({MATCHED}) {counter_sql('year')}")
def _(d):
    return places.counters(matched(d), ["place_id"], "year")


@query("agg02_top_categories", f"WITH {P}, m AS ({MATCHED}) SELECT * FROM ({counter_sql('issue_category')}) WHERE rank <= 10")
def _(d):
    return places.top_categories(matched(d), ["place_id"])


@query("win02_first_examples", f"WITH {P}, m AS ({MATCHED}) SELECT place_id, issue_category, rank, external_complaint_id FROM (SELECT *, row_number() OVER (PARTITION BY place_id, issue_category ORDER BY seq) AS rank FROM m) WHERE rank <= 3")
def _(d):
    return places.first_examples(matched(d), ["place_id"]).select("place_id", "issue_category", "rank", "external_complaint_id")


@query("win03_ranked_candidates", f"WITH {P} SELECT place_id, ward_key, rank FROM (SELECT place_id, ward_key, row_number() OVER (PARTITION BY place_id ORDER BY {SCORE} DESC, ward_name, ward_key) AS rank FROM p JOIN {{wards}} ON {SCORE} > 0 WHERE version = 'old_bbmp') WHERE rank <= 10")
def _(d):
    return places.ranked_candidates(places.ward_candidates(asked(d), d.wards).where("version = 'old_bbmp'"), 10).select("place_id", "ward_key", "rank")


@query("agg03_record_scope", f"WITH {P}, m AS ({MATCHED}) SELECT place_id, min(year) AS year_min, max(year) AS year_max, min(grievance_date) AS date_min, max(grievance_date) AS date_max, 'BBMP grievance records available through ' || max(grievance_date) || '. Not a live complaint dashboard.' AS freshness_note FROM m GROUP BY 1")
def _(d):
    return places.record_scope(matched(d), ["place_id"])


@query("agg03_lens_labels", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'All years' WHEN 1 THEN '1997 only' WHEN 2 THEN 'Through 1997' WHEN 3 THEN 'From 1997' ELSE '1997-1999' END AS label FROM customer")
def _(d):
    k = F.col("c_custkey") % 5
    first, last = F.when(k.isin(1, 3, 4), 1997), F.when(k.isin(1, 2), 1997).when(k == 4, 1999)
    return d.customer.select("c_custkey", places.lens_label(F.lit(""), first, last).alias("label"))


GRID = f"WITH {P}, m AS ({MATCHED}), l AS ({LENS}) SELECT p.place_id, g.lens, coalesce(n, 0) AS complaints, latest FROM p CROSS JOIN (SELECT unnest(['all', 'recent', 'single']) AS lens) g LEFT JOIN (SELECT place_id, lens, count(*) AS n, max(grievance_date) AS latest FROM l GROUP BY 1, 2) c ON c.place_id = p.place_id AND c.lens = g.lens"


@query("agg04_truth_grid", GRID)
def _(d):
    return places.truth_grid(asked(d), d.wards, d.mappings, d.complaints)


@query("agg23_same_summary", f"SELECT array_to_string(list_sort(list(CAST(place_id AS VARCHAR))), ',') AS places FROM ({GRID}) WHERE lens = 'all' GROUP BY complaints, coalesce(latest, '') HAVING count(*) > 1")
def _(d):
    cells = places.truth_grid(asked(d), d.wards, d.mappings, d.complaints).where("lens = 'all'").withColumn("place", F.col("place_id").cast("string"))
    return places.identical_summaries(cells, "place", ["complaints", "latest"]).select(F.array_join("places", ",").alias("places"))


@query("agg24_known_gaps", f"SELECT gap, count(*) AS n FROM (SELECT 'No grievance rows for lens ' || lens || '.' AS gap FROM ({GRID}) WHERE complaints = 0 UNION ALL SELECT 'Source status ' || CASE WHEN enabled THEN 'partial' ELSE 'blocked' END || '.' FROM {{registry}} WHERE source_tier > 1 OR NOT enabled) GROUP BY 1")
def _(d):
    status = F.when(~F.col("enabled"), "blocked").when(F.col("source_tier") > 1, "partial").otherwise("usable")
    return places.known_gaps(places.truth_grid(asked(d), d.wards, d.mappings, d.complaints), d.registry.withColumn("monitor_status", status))


@query(
    "agg26_dossier",
    f"""WITH {P}, m AS ({MATCHED}), t AS (SELECT place_id, string_agg(value, ', ' ORDER BY rank) AS top_categories FROM ({counter_sql("issue_category")}) WHERE rank <= 3 GROUP BY 1),
    y AS (SELECT place_id, year AS peak_year FROM (SELECT place_id, year, row_number() OVER (PARTITION BY place_id ORDER BY count(*) DESC, year) AS r FROM m GROUP BY 1, 2) WHERE r = 1),
    s AS (SELECT place_id, string_agg(v, ', ' ORDER BY r) AS subcategories FROM (SELECT place_id, issue_subcategory AS v, row_number() OVER (PARTITION BY place_id ORDER BY min(seq)) AS r FROM m GROUP BY 1, 2) WHERE r <= 3 GROUP BY 1),
    c AS (SELECT place_id, bool_or(status = 'F') AS has_closed FROM m GROUP BY 1)
    SELECT c.place_id, has_closed, top_categories, peak_year, subcategories FROM c LEFT JOIN t USING (place_id) LEFT JOIN y USING (place_id) LEFT JOIN s USING (place_id)""",
)
def _(d):
    return places.dossier_facts(matched(d))


@query("set04_excluded_sources", "SELECT id FROM {registry} WHERE id NOT IN (SELECT source_id FROM {runs} WHERE status = 'success')")
def _(d):
    cited = d.runs.where("status = 'success'").groupBy("run_id").agg(F.collect_set("source_id").alias("source_ids"))
    return places.excluded_sources(d.registry, places.used_sources(cited)).select("id")


@query("set05_search_entries", f"WITH {P} SELECT 'place' AS kind, CAST(place_id AS VARCHAR) AS id, len(list_distinct(list(name))) AS words FROM ({NAMES}) GROUP BY place_id UNION ALL SELECT 'source', id, CASE domain WHEN 'works_payments_tenders' THEN 14 WHEN 'grievances' THEN 6 WHEN 'roads' THEN 8 WHEN 'streetlights' THEN 8 WHEN 'wards' THEN 5 ELSE 3 END + 1 FROM {{registry}}")
def _(d):
    names = places.relevant_names(asked(d), d.wards, d.mappings).groupBy("place_id").agg(F.collect_set("name").alias("names"))
    focus = policy.answer_focus(F.col("domain"), F.col("id"))
    sources = d.registry.select("id", "name", focus.alias("focus"), policy.source_keywords(focus, F.col("id")).alias("keywords"))
    return places.search_entries(asked(d).join(names, "place_id"), sources).select("kind", "id", F.size("keywords").cast("long").alias("words"))


@query("fn37_claim_cards", f"SELECT place_id, lens, CASE WHEN complaints > 0 THEN 2 ELSE 1 END AS cards, 'Records run through ' || coalesce(latest, 'an unknown date') || '.' AS last FROM ({GRID})")
def _(d):
    cells = places.claim_cards(places.truth_grid(asked(d), d.wards, d.mappings, d.complaints).withColumn("citations", F.array(F.lit("a"), F.lit("a"))))
    return cells.select("place_id", "lens", F.size("claims").alias("cards"), F.element_at("claims", -1)["text"].alias("last"))
