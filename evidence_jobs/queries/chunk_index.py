"""Queries of the index and retrieval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_jobs.functions import routing, text
from evidence_jobs.operators import index, packets, resolve, retrieval
from evidence_jobs.operators.vectors import rank_by_cosine
from evidence_jobs.queries.case_packets import DETECTED, Q, lines, reach_sql
from evidence_jobs.queries.registry import any_of, matches, norm, query
from evidence_jobs.queries.scalars import TOKENS, keys_sql
from evidence_jobs.sources.stored import stored

WORKS = "SELECT source_id, 'works.csv' AS raw_file, row_number, 'work' AS entity_type, work_id AS record_id, description AS claim, contractor, amount, ward_number, ward_regime FROM {works} UNION ALL SELECT source_id, 'payments.csv', row_number, 'payment', payment_id, payment_reference, contractor, net_amount, ward_number, ward_regime FROM {payments}"
COMPLAINT_SQL = """SELECT 'complaint|' || source_id || '|' || raw_file || '|' || row_number AS chunk_key, 'complaint' AS chunk_type, source_id, row_number, issue_subcategory || ' complaint' AS title,
    ward_name_raw || ': ' || issue_category || ' / ' || issue_subcategory || '; status ' || status || '; date ' || grievance_date || '; complaint ' || external_complaint_id || '.' AS text, grievance_date AS date,
    concat_ws(' ', external_complaint_id, issue_category, issue_subcategory, status, grievance_date, staff_name, staff_remarks, ward_name_raw) AS flat, '' AS ward, status, external_complaint_id AS ext, staff_name FROM {complaints}"""
WORK_SQL = f"""SELECT 'work_payment|' || source_id || '|' || raw_file || '|' || row_number AS chunk_key, 'work_payment' AS chunk_type, source_id, row_number, claim AS title,
    claim || '; contractor ' || contractor || '; amount ' || amount || '; ward ' || ward_number || '; ward regime ' || ward_regime || '.' AS text, NULL AS date,
    concat_ws(' ', record_id, ward_number, ward_regime, claim, contractor, CAST(amount AS VARCHAR)) AS flat, ward_number AS ward, '' AS status, NULL AS ext, '' AS staff_name FROM ({WORKS})"""
C = f"c AS (SELECT *, {norm("title || ' ' || text || ' ' || flat")} AS search_text FROM ({COMPLAINT_SQL} UNION ALL {WORK_SQL}))"
NAMES = "names AS (SELECT normalized_name AS name FROM {wards} UNION SELECT old_name FROM {mappings} UNION SELECT new_name FROM {mappings})"
NUMBERS = "numbers AS (SELECT ward_number AS number, normalized_name AS name FROM {wards} UNION SELECT old_ward_number, old_name FROM {mappings} UNION SELECT old_ward_number, new_name FROM {mappings} UNION SELECT new_ward_number, old_name FROM {mappings} UNION SELECT new_ward_number, new_name FROM {mappings})"
SPOKEN = r"regexp_extract_all(search_text, '\bward\s*(?:no\.?|number)?\s*-?\s*(\d{1,3})\b', 1)"
PLACES = f"places AS (SELECT chunk_key, name AS place FROM c JOIN names ON contains(' ' || search_text || ' ', ' ' || name || ' ') UNION SELECT chunk_key, name FROM c JOIN numbers ON number = ward UNION SELECT chunk_key, name FROM (SELECT chunk_key, unnest({SPOKEN}) AS said FROM c) JOIN numbers ON number = said)"
ISSUES = f"issues AS (SELECT chunk_key, unnest(string_split(k, ',')) AS issue FROM (SELECT chunk_key, {keys_sql('search_text')} AS k FROM c) WHERE k <> '')"
BUCKETS = "buckets AS (SELECT c.chunk_key, c.chunk_type, 'place' AS kind, c.chunk_type || ':place:' || place AS bucket, date FROM places JOIN c ON c.chunk_key = places.chunk_key UNION ALL SELECT c.chunk_key, c.chunk_type, 'issue', c.chunk_type || ':issue:' || issue, date FROM issues JOIN c ON c.chunk_key = issues.chunk_key)"
ALL = f"{C}, {NAMES}, {NUMBERS}, {PLACES}, {ISSUES}, {BUCKETS}"


def plain_chunks(d):
    return index.complaint_chunks(d.complaints).unionByName(index.work_chunks(lines(d)))


def chunks(d):
    return index.with_search_text(plain_chunks(d))


def dictionaries(d):
    return index.place_names(d.wards, d.mappings), index.number_names(d.wards, d.mappings)


def buckets(d, *keep):
    return index.chunk_buckets(plain_chunks(d), *dictionaries(d), *keep)


@query("prj10_chunks", f"WITH {C} SELECT chunk_key, chunk_type, title, text FROM c")
def _(d):
    return chunks(d).select("chunk_key", "chunk_type", "title", "text")


@query("prj11_search_text", f"WITH {C} SELECT chunk_key, md5(search_text) AS digest FROM c")
def _(d):
    return chunks(d).select("chunk_key", F.md5("search_text").alias("digest"))


@query("prj10_raw_chunks", "SELECT row_number, description || '; tender number ' || external_id || '; value ' || amount || '; department ' || contractor || '; published .' AS text FROM {raw_works} WHERE description <> '' AND external_id <> ''".replace("description ||", "trim(regexp_replace(description, '\\s+', ' ', 'g')) ||"))
def _(d):
    row = F.create_map(F.lit("TITLE"), F.col("description"), F.lit("Tender Number"), F.col("external_id"), F.lit("Tender Value in Rs"), F.col("amount"), F.lit("department-location"), F.col("contractor"))
    return index.raw_chunks(d.raw_works.where("description <> '' AND external_id <> ''").withColumn("row", row), "tender").select("row_number", "text")


@query("set01_union_fallback", f"WITH {C} SELECT chunk_type, count(*) AS n FROM c GROUP BY 1")
def _(d):
    done = index.complaint_chunks(d.complaints)
    row = F.create_map(F.lit("wodetails"), F.col("description"))
    raw = index.raw_chunks(d.works.withColumn("raw_file", F.lit("w")).withColumn("row", row), "work_payment")
    paid = index.raw_chunks(d.payments.withColumn("raw_file", F.lit("p")).withColumn("row", F.create_map(F.lit("wodetails"), F.col("payment_reference"))), "work_payment")
    return index.union_chunks(done, raw.limit(0), raw.unionByName(paid)).groupBy("chunk_type").agg(F.count(F.lit(1)).alias("n"))


@query("agg17_number_names", f"WITH {NUMBERS} SELECT number, string_agg(name, ',' ORDER BY name) AS names FROM numbers GROUP BY 1")
def _(d):
    return index.number_names(d.wards, d.mappings).select("number", F.array_join("names", ",").alias("names"))


@query("agg17_place_names", f"WITH {NAMES} SELECT name FROM names")
def _(d):
    return index.place_names(d.wards, d.mappings)


@query("jn17_place_keys", f"WITH {ALL} SELECT place, count(*) AS n, sum(hash_sum) AS total FROM (SELECT place, length(chunk_key) AS hash_sum FROM places) GROUP BY 1")
def _(d):
    return index.place_keys(plain_chunks(d), *dictionaries(d)).groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("chunk_key")).alias("total"))


@query("jn17_buckets", f"WITH {ALL} SELECT bucket, count(*) AS n FROM buckets GROUP BY 1")
def _(d):
    return buckets(d).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("win06_trim_buckets", f"WITH {ALL} SELECT bucket, count(*) AS n, min(chunk_key) AS first FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY date DESC NULLS LAST, chunk_key) AS r FROM buckets) WHERE kind = 'place' OR r <= 100 GROUP BY 1")
def _(d):
    return index.trim_buckets(stored(buckets(d, "date")), 100).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_key").alias("first"))


def stats_rows(d):
    """Complaints with the places and issues that they are counted for; those without a place are not."""
    return index.stats_rows(index.with_search_text(index.complaint_chunks(d.complaints)), *dictionaries(d)).where("size(places) > 0")


STATS_ROWS = "SELECT DISTINCT c.chunk_key, c.row_number AS seq, c.status, c.date, c.ext, place, issue FROM c JOIN places p ON p.chunk_key = c.chunk_key LEFT JOIN issues i ON i.chunk_key = c.chunk_key WHERE chunk_type = 'complaint'"
GROUPED = "g AS (SELECT DISTINCT chunk_key, seq, status, date, ext, place, CAST(NULL AS VARCHAR) AS issue FROM s UNION ALL SELECT DISTINCT chunk_key, seq, status, date, ext, CAST(NULL AS VARCHAR), issue FROM s WHERE issue IS NOT NULL UNION ALL SELECT DISTINCT chunk_key, seq, status, date, ext, place, issue FROM s WHERE issue IS NOT NULL)"
HEAD = "h AS (SELECT place, issue, string_agg(ext, ',' ORDER BY seq) AS example_ids FROM (SELECT *, row_number() OVER (PARTITION BY place, issue ORDER BY seq) AS r FROM g) WHERE r <= 5 GROUP BY 1, 2)"
STATUS = "st AS (SELECT place, issue, string_agg(status || '=' || n, ',' ORDER BY status) AS statuses FROM (SELECT place, issue, status, count(*) AS n FROM g WHERE status <> '' GROUP BY 1, 2, 3) GROUP BY 1, 2)"
BUCKET_STATS = f"WITH {ALL}, s AS ({STATS_ROWS}), {GROUPED}, {HEAD}, {STATUS} SELECT a.place, a.issue, n AS complaint_count, latest AS latest_record_date, coalesce(statuses, '') AS statuses, example_ids FROM (SELECT place, issue, count(*) AS n, max(date) AS latest FROM g GROUP BY 1, 2) a LEFT JOIN h ON h.place IS NOT DISTINCT FROM a.place AND h.issue IS NOT DISTINCT FROM a.issue LEFT JOIN st ON st.place IS NOT DISTINCT FROM a.place AND st.issue IS NOT DISTINCT FROM a.issue"


def shown(stats):
    entries = F.array_sort(F.transform(F.map_entries("status_breakdown"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return stats.withColumn("statuses", F.array_join(entries, ",")).withColumn("example_ids", F.array_join("example_ids", ",")).drop("status_breakdown")


@query("agg06_bucket_stats", BUCKET_STATS)
def _(d):
    return shown(index.bucket_stats(stats_rows(d)))


@query("agg05_complaint_stats", f"SELECT place, complaint_count, latest_record_date, statuses, example_ids FROM ({BUCKET_STATS}) WHERE issue IS NULL")
def _(d):
    return shown(index.complaint_stats(stored(stats_rows(d)).withColumn("place", F.explode("places")), ["place"], distinct=True))


MERGED = f"""WITH b AS ({BUCKET_STATS}), t AS (SELECT * FROM b WHERE issue IS NOT NULL AND place IS NOT NULL),
    e AS (SELECT issue, id, min(struct_pack(place := place, pos := pos)) AS first FROM (SELECT issue, place, unnest(string_split(example_ids, ',')) AS id, generate_subscripts(string_split(example_ids, ','), 1) AS pos FROM t WHERE example_ids <> '') GROUP BY 1, 2),
    s AS (SELECT issue, split_part(x, '=', 1) AS status, sum(CAST(split_part(x, '=', 2) AS BIGINT))::BIGINT AS n FROM (SELECT issue, unnest(string_split(statuses, ',')) AS x FROM t WHERE statuses <> '') GROUP BY 1, 2)
    SELECT a.issue, complaint_count, latest_record_date, coalesce(statuses, '') AS statuses, example_ids FROM (SELECT issue, sum(complaint_count)::BIGINT AS complaint_count, max(latest_record_date) AS latest_record_date FROM t GROUP BY 1) a
    LEFT JOIN (SELECT issue, string_agg(status || '=' || n, ',' ORDER BY status) AS statuses FROM s GROUP BY 1) s ON s.issue = a.issue
    LEFT JOIN (SELECT issue, array_to_string(list_slice(list(id ORDER BY first), 1, 5), ',') AS example_ids FROM e GROUP BY 1) e ON e.issue = a.issue"""


@query("agg07_merge_stats", MERGED)
def _(d):
    parts = index.bucket_stats(stats_rows(d)).where("issue IS NOT NULL AND place IS NOT NULL").withColumn("seq", F.col("place"))
    return shown(index.merge_stats(parts, "issue")).select("issue", "complaint_count", "latest_record_date", "statuses", "example_ids")


INTENT_KEYS = f"SELECT case_id, query, {keys_sql(norm('query'))} AS keys FROM {{cases}}"
WIDE = f"p AS ({DETECTED}), {reach_sql('old_name', 'new_name')}, wide AS (SELECT case_id, name FROM p UNION SELECT case_id, reached FROM p JOIN w ON start = name)"


@query("agg08_best_bucket", f"WITH RECURSIVE {Q}, {WIDE}, b AS ({BUCKET_STATS}), k AS (SELECT case_id, unnest(string_split(keys, ',')) AS issue FROM ({INTENT_KEYS}) WHERE keys <> '') SELECT case_id, place, issue, complaint_count, latest_record_date FROM (SELECT k.case_id, b.*, row_number() OVER (PARTITION BY k.case_id ORDER BY complaint_count DESC, place, b.issue) AS r FROM k JOIN wide ON wide.case_id = k.case_id JOIN b ON b.place = wide.name AND b.issue = k.issue) WHERE r = 1")
def _(d):
    stats = stored(index.bucket_stats(stats_rows(d)))

    def largest(cases):
        names = resolve.widened_names(resolve.detect_places(cases, d.wards, d.mappings), d.mappings)
        keys = cases.select("case_id", F.explode(text.issue_keys(F.col("query"))).alias("issue"))
        return index.best_bucket(names.select("case_id", F.col("name").alias("place")).join(keys, "case_id"), stats).drop("status_breakdown", "example_ids")

    return resolve.once_per_query(d.cases, largest)


def asked(d, cases=None):
    cases = d.cases if cases is None else cases
    found = resolve.detect_places(cases, d.wards, d.mappings)
    return retrieval.questions(cases, resolve.widened_names(found, d.mappings), resolve.widened_numbers(found, d.mappings), routing.interpret_intent(F.col("query")))


TERM_LIST = f"list_filter(string_split({norm('query')}, ' '), lambda t: length(t) > 1)"
MONEY_LIST = "CASE " + " ".join(f"WHEN list_contains(keys, '{k}') THEN {v}" for k, v in retrieval.MONEY_TERMS) + " ELSE [] END"
COMPLAINT_LIST = "list_concat(" + ", ".join(f"CASE WHEN list_contains(keys, '{k}') THEN {v} ELSE [] END" for k, v in retrieval.COMPLAINT_TERMS.items()) + ")"
ASKED = f"""a AS (SELECT t.case_id, query, keys, coalesce(names, []) AS names, coalesce(nums, []) AS nums, len(keys) > 0 OR {matches("lower(query)", routing.COMPLAINTS)} AS wants_complaints,
    {matches("lower(query)", routing.MONEY)} OR (len(keys) > 0 AND names IS NOT NULL) AS wants_money, {TERM_LIST} AS all_terms, {MONEY_LIST} AS money_terms, {COMPLAINT_LIST} AS complaint_terms
    FROM (SELECT case_id, query, CASE WHEN keys = '' THEN [] ELSE string_split(keys, ',') END AS keys FROM ({INTENT_KEYS})) t LEFT JOIN (SELECT case_id, list(DISTINCT name) AS names FROM wide GROUP BY 1) n ON n.case_id = t.case_id
    LEFT JOIN (SELECT case_id, list(DISTINCT k) AS nums FROM (SELECT case_id, ward_number AS k FROM p UNION SELECT case_id, reached FROM p JOIN w2 ON start2 = ward_number) GROUP BY 1) m ON m.case_id = t.case_id)"""
REACH2 = "st2 AS (SELECT seq, old_ward_number AS a, new_ward_number AS b FROM {mappings} UNION SELECT seq, new_ward_number, old_ward_number FROM {mappings}), w2(start2, reached, hop) AS (SELECT DISTINCT a, a, CAST(-1 AS BIGINT) FROM st2 UNION SELECT w2.start2, st2.b, CAST(st2.seq AS BIGINT) FROM w2 JOIN st2 ON st2.a = w2.reached AND st2.seq > w2.hop)"
WANTED = """want AS (SELECT case_id, kind || ':place:' || n AS bucket FROM (SELECT case_id, unnest(names) AS n, wants_complaints, wants_money FROM a WHERE len(names) > 0), (SELECT unnest(['complaint', 'work_payment']) AS kind) WHERE CASE kind WHEN 'complaint' THEN wants_complaints ELSE wants_money END
    UNION SELECT case_id, kind || ':issue:' || n FROM (SELECT case_id, unnest(keys) AS n, wants_complaints, wants_money FROM a WHERE len(names) = 0), (SELECT unnest(['complaint', 'work_payment']) AS kind) WHERE CASE kind WHEN 'complaint' THEN wants_complaints ELSE wants_money END)"""
PAIRS = "pairs AS (SELECT DISTINCT want.case_id, b.chunk_key FROM want JOIN buckets b ON b.bucket = want.bucket)"
BASE = f"{Q}, {WIDE}, {REACH2}, {ALL}, {ASKED}, {WANTED}, {PAIRS}"


@query(
    "agg08_question_stats",
    f"""WITH RECURSIVE {Q}, {WIDE}, {REACH2}, b AS ({BUCKET_STATS}), {ASKED},
    k AS (SELECT case_id, n, i FROM (SELECT case_id, unnest(names) AS n, CASE WHEN len(keys) > 0 THEN keys ELSE [NULL] END AS ks FROM a WHERE len(names) > 0), unnest(ks) AS u(i)),
    one AS (SELECT case_id, complaint_count, latest_record_date, statuses FROM (SELECT k.case_id, b.*, row_number() OVER (PARTITION BY k.case_id ORDER BY complaint_count DESC, place, issue) AS r FROM k JOIN b ON b.place = k.n AND b.issue IS NOT DISTINCT FROM k.i) WHERE r = 1),
    loose AS (SELECT case_id, b.* FROM (SELECT case_id, unnest(keys) AS i FROM a WHERE len(names) = 0) l JOIN b ON b.place IS NULL AND b.issue = l.i),
    st2s AS (SELECT case_id, split_part(x, '=', 1) AS s, sum(CAST(split_part(x, '=', 2) AS BIGINT))::BIGINT AS n FROM (SELECT case_id, unnest(string_split(statuses, ',')) AS x FROM loose WHERE statuses <> '') GROUP BY 1, 2)
    SELECT * FROM one UNION ALL SELECT l.case_id, n, d, coalesce(statuses, '') FROM (SELECT case_id, sum(complaint_count)::BIGINT AS n, max(latest_record_date) AS d FROM loose GROUP BY 1) l LEFT JOIN (SELECT case_id, string_agg(s || '=' || n, ',' ORDER BY s) AS statuses FROM st2s GROUP BY 1) s ON s.case_id = l.case_id""",
)
def _(d):
    stats = stored(index.bucket_stats(index.stats_rows(index.with_search_text(index.complaint_chunks(d.complaints)), *dictionaries(d))))
    return resolve.once_per_query(d.cases, lambda cases: shown(index.question_stats(asked(d, cases), stats))).select("case_id", "complaint_count", "latest_record_date", "statuses")


@query("jn16_candidates", f"WITH RECURSIVE {BASE} SELECT case_id, count(*) AS n FROM pairs GROUP BY 1")
def _(d):
    rows = chunks(d).withColumn("issues", text.normalized_issue_keys(F.col("search_text")))
    held = index.with_places(rows, *dictionaries(d), ["chunk_type", "issues"])
    return retrieval.candidate_counts(asked(d), held.select(F.array_sort(index.bucket_names(F.col("chunk_type"), F.col("places"), F.col("issues"))["bucket"]).alias("held")))


def in_any(body: str, terms: str) -> str:
    return f"len(list_filter({terms}, lambda t: contains({body}, t))) > 0"


ON_PLACE = f"(len(list_filter(names, lambda t: contains(' ' || search_text || ' ', ' ' || t || ' '))) > 0 OR list_contains(nums, ward) OR len(list_intersect({SPOKEN}, nums)) > 0)"
USEFUL = f"list_filter(all_terms, lambda t: NOT list_contains({retrieval.STOP_TERMS}, t))"
RULES = f"""(CASE WHEN len(names) > 0 OR len(nums) > 0 THEN {ON_PLACE} ELSE chunk_type = 'complaint' OR {in_any('search_text', USEFUL)} END)
    AND (chunk_type <> 'complaint' OR len(complaint_terms) = 0 OR {in_any('search_text', 'complaint_terms')}) AND (chunk_type = 'complaint' OR len(money_terms) = 0 OR {in_any('search_text', 'money_terms')})
    AND (chunk_type = 'complaint' OR len(names) = 0 OR {in_any('search_text', USEFUL)} OR {any_of('search_text', retrieval.WORKS_WORDS)})"""
BODY_SPOKEN = r"regexp_extract_all(lower(title || ' ' || text), '\bward\s*(?:no\.?|number)?\s*-?\s*(\d+)\b', 1)"
SCORE = f"""len(list_filter(all_terms, lambda t: contains(lower(title || ' ' || text), t))) + CASE chunk_type WHEN 'complaint' THEN 8 ELSE 6 END
    + CASE WHEN chunk_type = 'work_payment' AND {matches('lower(query)', r'\b(work orders?|payment|paid|bill|contractor)\b')} THEN 8 ELSE 0 END
    + CASE WHEN (len(list_filter(names, lambda t: contains(' ' || {norm("title || ' ' || text")} || ' ', ' ' || t || ' '))) > 0 OR list_contains(nums, ward) OR len(list_intersect({BODY_SPOKEN}, nums)) > 0) THEN 10 ELSE 0 END"""
FOUND = f"found AS (SELECT a.case_id, c.*, keys, names, query, all_terms, {SCORE} AS score FROM pairs JOIN a ON a.case_id = pairs.case_id JOIN c ON c.chunk_key = pairs.chunk_key WHERE {RULES}), r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, date DESC NULLS LAST, source_id, chunk_key) AS rank FROM found)"
RANKED = f"WITH RECURSIVE {BASE}, {FOUND}"


def retrieved(d, then):
    """What `then` makes of the search, for each case."""
    found = retrieval.search(asked(d), chunks(d), places=dictionaries(d))
    return found.to_cases(then(found))


@query("flt04_flt05_filtered", f"{RANKED} SELECT case_id, chunk_type, count(*) AS n FROM r GROUP BY 1, 2")
def _(d):
    return retrieved(d, lambda s: s.counts()).select("case_id", "chunk_type", "n")


@query("srt03_ranked", f"{RANKED} SELECT case_id, rank, chunk_key, score FROM r WHERE rank <= 30")
def _(d):
    return retrieved(d, lambda s: s.best(30).where("rank <= 30")).select("case_id", "rank", "chunk_key", "score")


CHOSEN = "sel AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY CASE WHEN first THEN CASE chunk_type WHEN 'complaint' THEN 1 ELSE 2 END ELSE 5 END, rank) AS place FROM (SELECT *, min(rank) OVER (PARTITION BY case_id, chunk_type) = rank AS first FROM r))"


@query("win05_selected", f"{RANKED}, {CHOSEN} SELECT case_id, place, chunk_key FROM sel WHERE place <= 12")
def _(d):
    return retrieved(d, lambda s: retrieval.selected(s.best(retrieval.MOST_CHUNKS))).select("case_id", "place", "chunk_key")


@query("win07_library", f"{RANKED}, {CHOSEN} SELECT case_id, chunk_type, n, chunk_key FROM (SELECT *, row_number() OVER (PARTITION BY case_id, chunk_type ORDER BY place) AS n FROM sel WHERE place <= 12) WHERE n <= 5")
def _(d):
    return retrieved(d, lambda s: retrieval.evidence_library(retrieval.selected(s.best(retrieval.MOST_CHUNKS)))).select("case_id", "chunk_type", "n", "chunk_key")


@query("agg09_answer", f"{RANKED} SELECT a.case_id, complaint_rows, work_payment_rows, latest_record_date, status_counts, example_ids FROM (SELECT case_id, count(*) FILTER (chunk_type = 'complaint') AS complaint_rows, count(*) FILTER (chunk_type = 'work_payment') AS work_payment_rows, max(date) AS latest_record_date FROM r GROUP BY 1) a LEFT JOIN (SELECT case_id, string_agg(status || '=' || n, ',' ORDER BY status) AS status_counts FROM (SELECT case_id, status, count(*) AS n FROM r WHERE chunk_type = 'complaint' AND status <> '' GROUP BY 1, 2) GROUP BY 1) s ON s.case_id = a.case_id LEFT JOIN (SELECT case_id, string_agg(ext, ',' ORDER BY rank) AS example_ids FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY rank) AS n FROM r WHERE chunk_type = 'complaint') WHERE n <= 5 GROUP BY 1) e ON e.case_id = a.case_id")
def _(d):
    return retrieved(d, lambda s: s.answers()).select("case_id", "complaint_rows", "work_payment_rows", "latest_record_date", "status_counts", "example_ids")


@query("agg10_issue_tracks", f"{RANKED}, sp AS (SELECT r.case_id, r.rank, r.chunk_type, r.ext, i.issue FROM r JOIN issues i ON i.chunk_key = r.chunk_key), wn AS (SELECT case_id, unnest(keys) AS issue FROM a) SELECT wn.case_id, wn.issue, count(sp.chunk_type) AS rows, coalesce(array_to_string(list_slice(list(sp.ext ORDER BY sp.rank) FILTER (sp.chunk_type = 'complaint' AND sp.ext IS NOT NULL), 1, 3), ','), '') AS complaint_ids, coalesce(string_agg(DISTINCT sp.chunk_type, ',' ORDER BY sp.chunk_type), '') AS types FROM wn LEFT JOIN sp ON sp.case_id = wn.case_id AND sp.issue = wn.issue GROUP BY 1, 2")
def _(d):
    return retrieved(d, lambda s: s.tracks()).select("case_id", "issue", "rows", "complaint_ids", "types")


@query("set02_routed_roles", f"{RANKED} SELECT case_id, string_agg(staff_name, '|' ORDER BY first) AS roles FROM (SELECT case_id, staff_name, min(rank) AS first FROM r WHERE chunk_type = 'complaint' GROUP BY 1, 2) GROUP BY 1")
def _(d):
    return retrieved(d, lambda s: packets.ordered_distinct(retrieval.routed_roles(s.first_by("staff_name")), "case_id", "role")).select("case_id", F.array_join("values", "|").alias("roles"))


LANDMARK = f"list_filter({TERM_LIST}, lambda t: length(t) >= 5 AND NOT list_contains({retrieval.LANDMARK_STOPS}, t) AND t <> 'nation')"


@query("fn29_match_strength", f"SELECT case_id, array_to_string(list_distinct({LANDMARK}), ',') AS landmarks, CASE WHEN case_id % 2 = 0 AND case_id % 3 = 0 THEN 'strong' WHEN case_id % 3 = 0 AND case_id % 5 = 0 THEN 'area/ward-level' WHEN case_id % 5 = 0 THEN 'weak-area-context' WHEN case_id % 3 = 0 THEN 'issue-only' ELSE 'source-context' END AS strength FROM {{cases}}".replace("array_to_string(list_distinct(", "array_to_string(list_sort(list_distinct(").replace(")), ',') AS landmarks", "))), ',') AS landmarks"))
def _(d):
    k = F.col("case_id")
    words = F.array_join(F.array_sort(retrieval.landmark_terms(F.col("query"), F.array(F.lit("nation 1")))), ",")
    return d.cases.select("case_id", words.alias("landmarks"), retrieval.match_strength(k % 2 == 0, k % 3 == 0, k % 5 == 0).alias("strength"))


# Packets: documents of a source hold its evidence; benchmark-like questions ask for frequent words.
PACKET_ROWS = """SELECT source AS packet_id, doc_id AS pos, CASE doc_id % 4 WHEN 0 THEN 'work' ELSE 'record' END AS entity_type, text, CASE WHEN doc_id % 9 = 0 THEN 'not_public_output' ELSE 'public' END AS claim_class,
    CASE WHEN doc_id % 7 = 0 THEN 'Private details' WHEN doc_id % 7 = 1 THEN 'private, public context' ELSE '' END AS disallowed, CASE doc_id % 5 WHEN 0 THEN 'Direct work' WHEN 1 THEN 'Related work' ELSE '' END AS label,
    CASE WHEN source IN ('src1', 'src2') THEN 'power' ELSE 'road' END AS issue_type FROM {documents}"""
ELIGIBLE_SQL = "claim_class <> 'not_public_output' AND (NOT contains(lower(disallowed), 'private') OR contains(lower(disallowed), 'public context')) AND NOT (issue_type = 'power' AND entity_type = 'work')"


def packet_tables(d):
    """Evidence rows and citations of the packets."""
    rows = d.spark.sql(PACKET_ROWS, documents=d.documents)
    evidence = rows.withColumn("evidence_id", F.concat(F.lit("d"), "pos")).withColumnRenamed("text", "claim")
    cited = rows.select("packet_id", "issue_type").distinct().select("packet_id", "issue_type", F.lit(0).cast("long").alias("pos"), F.lit("jurisdiction-1").alias("id"), F.col("packet_id").alias("source_id"))
    return evidence, cited


@query("prj12_packet_chunks", f"SELECT packet_id, 'd' || pos AS chunk_id, entity_type FROM ({PACKET_ROWS}) WHERE text <> '' UNION ALL SELECT DISTINCT source, 'jurisdiction-1', 'jurisdiction' FROM documents")
def _(d):
    return retrieval.packet_chunks(*packet_tables(d)).select("packet_id", "chunk_id", "entity_type")


@query("flt03_filter_audit", f"WITH t AS (SELECT packet_id, {ELIGIBLE_SQL} AS ok FROM ({PACKET_ROWS}) WHERE text <> '' UNION ALL SELECT DISTINCT source, true FROM documents) SELECT packet_id, count(*) AS candidates, count(*) FILTER (ok) AS eligible, count(*) FILTER (NOT ok) AS rejected FROM t GROUP BY 1")
def _(d):
    return retrieval.filter_audit(retrieval.eligible(retrieval.packet_chunks(*packet_tables(d))))


@query("flt03_rejected", f"SELECT packet_id, pos, 'd' || pos AS chunk_id FROM ({PACKET_ROWS}) WHERE text <> '' AND NOT ({ELIGIBLE_SQL})")
def _(d):
    return retrieval.rejected_chunks(retrieval.eligible(retrieval.packet_chunks(*packet_tables(d))))


ASK = "'the and that que inheo'"


@query("win10_lexical_rank", f"WITH t AS (SELECT packet_id, 'd' || pos AS chunk_id, row_number() OVER (PARTITION BY packet_id ORDER BY pos) AS o, len(list_intersect(list_distinct({TOKENS}), ['the', 'and', 'that', 'que', 'inheo'])) + CASE WHEN label LIKE 'Direct%' THEN 4 WHEN label LIKE 'Related%' THEN 1 ELSE 0 END AS score FROM ({PACKET_ROWS}) WHERE text <> '' AND {ELIGIBLE_SQL}) SELECT packet_id, chunk_id, rank, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY packet_id ORDER BY score DESC, o) AS rank FROM t) WHERE rank <= 6")
def _(d):
    rows = retrieval.eligible(retrieval.packet_chunks(*packet_tables(d)))
    return retrieval.lexical_rank(rows, rows.select("packet_id", F.expr(ASK).alias("question")).distinct(), 6)


@query("win11_embedding_rank", "WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 25 = 0) SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM s) WHERE rank <= 5")
def _(d):
    e = d.embeddings
    asks = e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("query_vector"))
    return rank_by_cosine(asks, e.select("label", F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), "label", 5).drop("similarity")
