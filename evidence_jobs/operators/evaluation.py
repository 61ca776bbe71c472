"""Evaluation suites: case failures, packet metrics, retrieval metrics and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_jobs.functions import privacy
from evidence_jobs.operators.packets import faithful

# Parts of an explanation, and words that make a caveat.
EXPLANATION_KEYS = ["answer", "what_the_packet_says", "why_this_agency", "what_to_cite", "what_not_to_claim", "refusal", "citations", "audit"]
CAVEATS = ["does not prove", "not proof", "cannot", "no normalized", "not live"]


def required_cases(rows: DataFrame, field: str = "query") -> DataFrame:
    """Suite rows; an error if one lacks the required field."""
    bad = rows.where(F.col(field).isNull() | (F.trim(field) == "")).limit(1).count()
    if bad:
        raise ValueError(f"a case without {field}")
    return rows


def _none() -> Column:
    return F.array().cast("array<string>")


def missing_texts(prefix: str, wanted: Column, text: Column, forbidden: bool = False) -> Column:
    """Failures `prefix=item` of wanted items that a text lacks (or, if forbidden, holds), without case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    items = F.filter(F.coalesce(wanted, _none()), lambda w: low.contains(F.lower(w)) if forbidden else ~low.contains(F.lower(w)))
    return F.transform(items, lambda w: F.concat(F.lit(f"{prefix}="), w))


def expected_equal(name: str, expected: Column, got: Column) -> Column:
    """A failure where something is expected and something else is there."""
    e, g = expected.cast("string"), F.coalesce(got.cast("string"), F.lit("None"))
    return F.when(e.isNotNull() & (e != "") & (e != g), F.concat(F.lit(f"{name}="), e, F.lit(", got="), g))


def case_failures(joined: DataFrame) -> DataFrame:
    """Cases joined to packets, with `failures`, in fixed order.

    Case columns: expected_place, expected_issue, expected_agency_id, min_evidence_rows,
    max_evidence_rows, required_evidence_contains, forbidden_evidence_contains,
    expected_abstention, requires_freshness_disclosure. Packet columns: place, issue,
    agency_id, evidence_texts array, packet_status, latest_record_date, public_text.
    """
    c = F.col
    texts = F.coalesce(c("evidence_texts"), _none())
    n, body = F.size(texts), F.array_join(texts, "\n")
    abstained = (n == 0) | (c("packet_status") == "insufficient_structured_evidence")
    disclosed = (F.coalesce(c("latest_record_date"), F.lit("")) != "") | F.lower(F.coalesce(c("public_text"), F.lit(""))).rlike("historical|not live|undated|freshness")
    single = F.filter(
        F.array(
            expected_equal("expected_place", c("expected_place"), c("place")), expected_equal("expected_issue", c("expected_issue"), c("issue")), expected_equal("expected_agency_id", c("expected_agency_id"), c("agency_id")),
            F.when(n < c("min_evidence_rows"), F.concat(F.lit("min_evidence_rows="), c("min_evidence_rows").cast("string"), F.lit(", got="), n.cast("string"))),
            F.when(n > c("max_evidence_rows"), F.concat(F.lit("max_evidence_rows="), c("max_evidence_rows").cast("string"), F.lit(", got="), n.cast("string"))),
        ),
        lambda x: x.isNotNull(),
    )
    last = F.filter(F.array(F.when(c("requires_freshness_disclosure") & ~disclosed, "missing_freshness_disclosure"), F.when(c("expected_abstention") & ~abstained, "expected_abstention")), lambda x: x.isNotNull())
    held = F.concat(missing_texts("missing_evidence_text", c("required_evidence_contains"), body), missing_texts("forbidden_evidence_text", c("forbidden_evidence_contains"), body, True))
    return joined.withColumns({"abstained": abstained, "disclosed": disclosed, "failures": F.concat(single, held, last)})


def answer_failures(joined: DataFrame) -> DataFrame:
    """Cases joined to explanations, with `failures`, in fixed order.

    Case columns: must_contain, forbidden, forbidden_new_fact_contains,
    expected_refusal_status, requires_caveat, requires_existing_citations. Explanation
    columns: present_keys array, rendered (the whole as text), public_text, caveat_text,
    used_raw_scan, used_packet_only, used_private_data, refusal_status, cited array, and
    the packet's own citation ids as allowed array. Null flags count as false.
    """
    c, on = F.col, lambda name: F.coalesce(F.col(name), F.lit(False))
    caveat = F.lower(F.coalesce("caveat_text", F.lit("")))
    has_caveat = F.exists(F.array(*map(F.lit, CAVEATS)), lambda w: caveat.contains(w))
    absent = F.array_except(F.array(*map(F.lit, EXPLANATION_KEYS)), F.coalesce("present_keys", _none()))
    rules = [
        F.when(on("used_raw_scan"), "used_raw_scan"), F.when(~on("used_packet_only"), "not_packet_only"), F.when(on("used_private_data"), "used_private_data"), F.when(privacy.has_personal(c("public_text")), "pii_leak"),
        expected_equal("expected_refusal_status", c("expected_refusal_status"), c("refusal_status")), F.when(on("requires_caveat") & ~has_caveat, "missing_caveat"),
        F.when(on("requires_existing_citations") & ~faithful(F.coalesce("cited", _none()), F.coalesce("allowed", _none())), "unfaithful_citation"),
    ]
    terms = [missing_texts("missing_term", c("must_contain"), c("rendered")), missing_texts("forbidden_term", c("forbidden"), c("rendered"), True), missing_texts("new_fact_term", c("forbidden_new_fact_contains"), c("rendered"), True)]
    keys = F.transform(absent, lambda k: F.concat(F.lit("missing_explanation_key="), k))
    return joined.withColumn("failures", F.concat(keys, *terms, F.filter(F.array(*rules), lambda x: x.isNotNull())))


def with_leaks(rows: DataFrame) -> DataFrame:
    """rows with pii_leak: their public text holds personal data."""
    return rows.withColumn("pii_leak", privacy.has_personal(F.col("public_text")))


def packet_metrics(rows: DataFrame) -> DataFrame:
    """Rates over cases, each with its own denominator and what it is without one, and the release gate.

    rows: case_failures output with agency_ok, jurisdiction_ok, precision_at_3,
    wrong_locality, pii_leak, unsupported, raw_scan (null where a case asks for none).
    """
    rate = lambda c, empty: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(empty))
    out = rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.size("failures") == 0).alias("passed"), rate("agency_ok", 1.0).alias("agency_accuracy"), rate("jurisdiction_ok", 1.0).alias("jurisdiction_accuracy"),
        rate("precision_at_3", 1.0).alias("evidence_precision_at_3"), rate("wrong_locality", 0.0).alias("wrong_locality_rate"), rate("pii_leak", 0.0).alias("pii_leak_rate"), rate("unsupported", 0.0).alias("unsupported_claim_rate"),
        rate("raw_scan", 0.0).alias("unsafe_raw_scan_rate"), F.coalesce(F.avg(F.when(F.col("requires_freshness_disclosure"), F.col("disclosed").cast("double"))), F.lit(1.0)).alias("freshness_disclosure_rate"),
        F.coalesce(F.avg(F.when(F.col("expected_abstention"), F.col("abstained").cast("double"))), F.lit(1.0)).alias("abstention_accuracy"),
    )
    hard = (F.col("passed") < F.col("total")) | (F.col("pii_leak_rate") > 0) | (F.col("unsupported_claim_rate") > 0) | (F.col("unsafe_raw_scan_rate") > 0) | (F.col("freshness_disclosure_rate") < 1)
    return out.withColumn("gate", F.when(hard, "failed").otherwise("passed"))


def retrieval_scores(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """Per case P@3, R@5 and forbidden@5.

    results (case_id, rank, chunk_id, legacy_id); qrels (case_id, group, relevant,
    forbidden arrays). A rank counts once, by either id. Without relevant ids both are 1;
    with them and no results both are 0.
    """
    r = results.where("rank <= 5").select("case_id", "rank", F.array("chunk_id", "legacy_id").alias("ids"))
    hits = qrels.join(r, "case_id", "left")
    hit = F.coalesce(F.arrays_overlap("ids", "relevant"), F.lit(False))
    bad = F.coalesce(F.array_intersect("ids", "forbidden"), _none())
    own = F.coalesce(F.array_intersect("ids", "relevant"), _none())
    out = hits.groupBy("case_id", "group").agg(
        F.count_if(hit & (F.col("rank") <= 3)).alias("h3"), F.count_if(F.col("rank") <= 3).alias("n3"), F.size(F.array_distinct(F.flatten(F.collect_list(own)))).alias("found"), F.size(F.array_distinct(F.flatten(F.collect_list(bad)))).alias("forbidden_at_5"), F.first(F.size("relevant")).alias("wanted")
    )
    precision = F.when(F.col("wanted") == 0, 1.0).when(F.col("n3") == 0, 0.0).otherwise(F.col("h3") / F.col("n3"))
    recall = F.when(F.col("wanted") == 0, 1.0).otherwise(F.col("found") / F.col("wanted"))
    return out.select("case_id", "group", precision.alias("precision_at_3"), recall.alias("recall_at_5"), "forbidden_at_5")


def retrieval_rollup(scores: DataFrame, key: str | None = None) -> DataFrame:
    """Means over all cases, or per value of a key."""
    facts = [F.count(F.lit(1)).alias("total"), *(F.avg(c).alias(c) for c in ("precision_at_3", "recall_at_5", "forbidden_at_5"))]
    return scores.groupBy(key).agg(*facts) if key else scores.agg(*facts)


def category_rollup(results: DataFrame, first: int = 10) -> DataFrame:
    """Per category of results (category, case_id, failures, tokens): total, passed, failed, rate, tokens, first failures."""
    ok = F.size("failures") == 0
    order = Window.partitionBy("category").orderBy("case_id")
    head = results.where(~ok).select("category", "case_id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= first)
    named = head.groupBy("category").agg(F.array_join(F.array_sort(F.collect_list("case_id")), ",").alias("first_failures"))
    facts = results.groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("passed"), F.sum("tokens").alias("tokens"))
    out = facts.join(named, "category", "left").withColumn("first_failures", F.coalesce("first_failures", F.lit("")))
    return out.withColumn("failed", F.col("total") - F.col("passed")).withColumn("rate", F.col("passed") / F.col("total"))


def failure_term_rate(results: DataFrame, term: str) -> DataFrame:
    """Per run: share of cases with a failure that holds the term."""
    return results.groupBy("run_id").agg(F.avg(F.exists("failures", lambda f: f.contains(term)).cast("double")).alias("rate"))


def failure_prefixes(results: DataFrame) -> DataFrame:
    """Per run: failures by what stands before `=`."""
    return results.select("run_id", F.explode("failures").alias("f")).groupBy("run_id", F.substring_index("f", "=", 1).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
