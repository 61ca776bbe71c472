"""Archive runs, resource ledgers, source profiles and the monitor over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_jobs.functions import dates, policy

# The registry's required fields with their types, and its enums.
REQUIRED = {
    "id": "string", "name": "string", "url": "string", "domain": "string", "agency": "string", "publisher": "string", "source_tier": "int", "official_status": "string",
    "format": "string", "access_method": "string", "license": "string", "update_frequency": "string", "freshness_policy_days": "int", "pii_risk": "string", "enabled": "boolean",
}
ENUMS = {"pii_risk": ["low", "medium", "high"]}
MONITOR_OK = ["usable", "stale", "partial"]


def latest_run(runs: DataFrame, status: str | None = None) -> DataFrame:
    """Per source the whole row of its greatest run_id, of any status or of one."""
    rows = runs if status is None else runs.where(F.col("status") == status)
    rest = [c for c in runs.columns if c != "source_id"]
    return rows.groupBy("source_id").agg(F.max_by(F.struct(*rest), "run_id").alias("r")).select("source_id", "r.*")


def resource_counts(ledger: DataFrame) -> DataFrame:
    """Per run: expected, fetched, failed and pending resources, failed ids, and the run's status."""
    s = F.col("status")
    out = ledger.groupBy("source_id", "run_id").agg(
        F.count(F.lit(1)).alias("expected"), F.count_if(s.isin("completed", "reused")).alias("fetched"), F.count_if(s == "failed").alias("failed"), F.count_if(~s.isin("completed", "reused", "failed")).alias("pending"),
        F.array_sort(F.collect_set(F.when(s == "failed", F.col("resource_id")))).alias("failed_ids"),
    )
    return out.withColumn("run_status", F.when((F.col("failed") == 0) & (F.col("pending") == 0), "success").when(F.col("fetched") > 0, "partial").otherwise("failed"))


def inferred_counts(expected: DataFrame, files: DataFrame, runs: DataFrame) -> DataFrame:
    """Counts of older runs without a ledger: active expected ids against the stems of fetched files.

    expected (source_id, run_id, resource_id, state), files (source_id, run_id, path),
    runs (source_id, run_id, status).
    """
    ids = expected.where("(state IS NULL OR state = 'active') AND resource_id <> ''").select("source_id", "run_id", "resource_id").distinct()
    stems = files.select("source_id", "run_id", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("resource_id"), F.lit(1).alias("hit")).distinct()
    keys = ["source_id", "run_id"]
    out = ids.join(stems, [*keys, "resource_id"], "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("expected"), F.count("hit").alias("found")).join(runs.select(*keys, "status"), keys)
    ok = F.col("status") == "success"
    fetched = F.when(F.col("found") > 0, F.col("found")).when(ok, F.col("expected")).otherwise(0)
    failed = F.when(ok, 0).otherwise(F.greatest(F.col("expected") - F.col("found"), F.lit(0)))
    return out.select(*keys, "expected", fetched.alias("fetched"), failed.alias("failed"), F.greatest(F.col("expected") - fetched - failed, F.lit(0)).alias("pending"))


def resume_plan(wanted: DataFrame, previous: DataFrame) -> DataFrame:
    """wanted (source_id, resource_id, path, sha256) with action `reused` or `fetch`.

    A resource is reused from the previous ledger by its id, else by its file's stem,
    when the hash still matches.
    """
    stem = lambda c: F.regexp_extract(c, r"([^/]+?)(\.[^./]*)?$", 1)
    done = previous.where("status IN ('completed', 'reused')")
    by_id = done.groupBy("source_id", "resource_id").agg(F.max_by("sha256", "run_id").alias("id_hash"))
    by_stem = done.groupBy("source_id", stem(F.col("path")).alias("stem")).agg(F.max_by("sha256", "run_id").alias("stem_hash"))
    joined = wanted.withColumn("stem", stem(F.col("path"))).join(by_id, ["source_id", "resource_id"], "left").join(by_stem, ["source_id", "stem"], "left")
    return joined.withColumn("action", F.when(F.coalesce("id_hash", "stem_hash") == F.col("sha256"), "reused").otherwise("fetch")).drop("stem", "id_hash", "stem_hash")


def profiles(registry: DataFrame, runs: DataFrame, files: DataFrame, facts: DataFrame) -> DataFrame:
    """Per source of the registry: its latest run's files, bytes, first CSV's header and rows, geometry, PDF pages, difficulty, wave, issues.

    files (source_id, run_id, pos, path, bytes); facts (path, header, rows, geometry,
    pdf_pages) of each file.
    """
    last = latest_run(runs.select("source_id", "run_id", "status"))
    own = files.join(last.select("source_id", "run_id"), ["source_id", "run_id"]).join(facts, "path", "left")
    csv, geo, pdf = F.lower("path").endswith(".csv"), F.coalesce("geometry", F.lit(False)), F.lower("path").endswith(".pdf")
    first = lambda c, ok: F.min_by(c, F.when(ok, F.col("pos")))
    kind = F.when(csv, "easy_structured").when(geo, "geo_structured").when(pdf, "pdf_extract")
    seen = own.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("bytes").alias("total_bytes"), first("header", csv).alias("detected_columns"), first("rows", csv).alias("row_count"), F.bool_or(geo).alias("geometry_detected"),
        first("pdf_pages", pdf).alias("pdf_pages"), F.max_by(kind, F.when(kind.isNotNull(), F.col("pos"))).alias("found_difficulty"),
    )
    joined = registry.withColumnRenamed("id", "source_id").join(last, "source_id", "left").join(seen, "source_id", "left")
    by_rule = policy.parser_difficulty(F.col("access_method"), F.col("format"), F.col("official_status"))
    return joined.select(
        "source_id", "domain", "format", F.coalesce("status", F.lit("not_fetched")).alias("fetched_status"), F.coalesce("file_count", F.lit(0)).alias("file_count"), F.coalesce("total_bytes", F.lit(0)).alias("total_bytes"),
        F.coalesce("detected_columns", F.lit("")).alias("detected_columns"), "row_count", F.coalesce("geometry_detected", F.lit(False)).alias("geometry_detected"), "pdf_pages",
        F.coalesce("found_difficulty", by_rule).alias("parser_difficulty"), policy.normalization_wave(F.col("domain")).alias("normalization_wave"),
        F.when(F.col("run_id").isNull(), "not fetched").otherwise("").alias("blocking_issues"),
    )


def monitor(registry: DataFrame, runs: DataFrame, counts: DataFrame, profiled: DataFrame, used: DataFrame, now: Column) -> DataFrame:
    """One status row per source: archive, age, staleness, eligibility, monitor status, caveats, use.

    runs (source_id, run_id, status, fetched_at timestamp, manifest_issue, errors array);
    counts as of resource_counts; profiled as of profiles; used (source_id).
    """
    last = latest_run(runs).withColumnRenamed("status", "run_status_text")
    good = latest_run(runs.where("manifest_issue IS NULL"), "success").select("source_id", F.col("run_id").alias("latest_successful_run"))
    keys = counts.select("source_id", "run_id", "failed", "pending", "failed_ids")
    facts = profiled.select("source_id", F.lit(True).alias("profiled"), "parser_difficulty", "blocking_issues", "file_count")
    rows = registry.withColumnRenamed("id", "source_id").join(last, "source_id", "left").join(good, "source_id", "left").join(keys, ["source_id", "run_id"], "left").join(facts, "source_id", "left")
    rows = rows.join(used.select("source_id", F.lit(True).alias("used")).distinct(), "source_id", "left")
    c = F.col
    eligible = policy.claim_eligibility(c("source_id"), *(c(x) for x in ("domain", "official_status", "access_method", "pii_risk", "enabled")))
    rows = rows.withColumn("eligibility", policy.proof_contract(eligible, *(c(x) for x in ("domain", "official_status", "access_method", "pii_risk", "enabled")))["claim_eligibility"])
    rows = rows.withColumn("age", dates.archive_age(c("fetched_at"), now)).withColumn("archive_status", policy.archive_status(c("run_id"), c("manifest_issue"), c("run_status_text")))
    stale = F.coalesce((c("age.days") > c("freshness_policy_days")) & (c("freshness_policy_days") > 0), F.lit(False))
    rows = rows.withColumn("is_stale", stale).withColumn("monitor_status", policy.monitor_status(c("archive_status"), c("is_stale"), c("eligibility"), c("access_method"), c("pii_risk"), c("enabled")))
    zero = lambda n: F.coalesce(c(n), F.lit(0))
    none = F.array().cast("array<string>")
    notes = policy.caveats(
        c("archive_status"), c("manifest_issue"), c("errors"), policy.resource_caveat(zero("failed"), zero("pending"), F.coalesce("failed_ids", none)), F.coalesce("blocking_issues", F.lit("")),
        F.coalesce("parser_difficulty", F.lit("")), c("age.caveat"), c("is_stale"), c("age.days"), c("freshness_policy_days"), c("pii_risk"), c("access_method"),
    )
    usage = F.when(F.coalesce("used", F.lit(False)), "used_in_public_claims").otherwise("registered_only")
    rows = rows.withColumns({"caveats": notes, "normalized_usage_status": usage, "parser_status": policy.parser_status(F.coalesce("profiled", F.lit(False)), F.coalesce("blocking_issues", F.lit("")), F.coalesce("parser_difficulty", F.lit("")))})
    bad = (usage == "used_in_public_claims") & ~c("monitor_status").isin(*MONITOR_OK)
    return rows.select(
        "source_id", "archive_status", "monitor_status", F.coalesce("run_status_text", F.lit("not_fetched")).alias("latest_fetch_status"), F.col("run_id").alias("latest_run"), "latest_successful_run",
        F.col("age.days").alias("archive_age_days"), "is_stale", "eligibility", "parser_status", "normalized_usage_status", "caveats", F.when(bad, "used_without_monitor_ok").otherwise(c("monitor_status")).alias("summary_status"),
    )


def monitor_summary(rows: DataFrame) -> DataFrame:
    """Ten conditional counts over monitor rows."""
    of = lambda column, value: F.count_if(F.col(column) == value)
    return rows.agg(
        F.count(F.lit(1)).alias("total_sources"), of("latest_fetch_status", "success").alias("successful_fetches"), of("archive_status", "not_fetched").alias("not_fetched"),
        of("normalized_usage_status", "used_in_public_claims").alias("used_in_public_claims"), *(of("monitor_status", s).alias(s) for s in ("usable", "partial", "stale", "unavailable", "blocked")),
        of("summary_status", "used_without_monitor_ok").alias("used_without_monitor_ok"),
    )


def registry_errors(registry: DataFrame) -> DataFrame:
    """(id, error): missing and empty fields, values outside enums, wrong types, duplicate ids."""
    kinds = dict(registry.dtypes)
    rules: list[Column] = []
    for field, kind in REQUIRED.items():
        if field not in kinds:
            rules.append(F.lit(f"missing required field {field}"))
            continue
        rules.append(F.when(F.col(field).isNull() | (F.col(field).cast("string") == ""), F.lit(f"{field} must not be empty")))
        if kinds[field] != kind and not (kind == "int" and kinds[field] == "bigint"):
            rules.append(F.lit(f"{field} must be {kind}"))
        if field in ENUMS:
            rules.append(F.when(~F.col(field).isin(*ENUMS[field]), F.concat(F.lit(f"{field} has invalid value "), F.col(field))))
    own = registry.select("id", F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("error"))
    twice = registry.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.concat(F.lit("duplicate source id "), "id").alias("error"))
    return own.unionByName(twice)


def claimed_urls(registry: DataFrame) -> DataFrame:
    """(url, source_id, canonical): every source's url and aliases."""
    named = registry if "aliases" in registry.columns else registry.withColumn("aliases", F.array().cast("array<string>"))
    own = named.select(F.col("url"), F.col("id").alias("source_id"), F.lit(True).alias("canonical"))
    return own.unionByName(named.select(F.explode("aliases").alias("url"), F.col("id").alias("source_id"), F.lit(False).alias("canonical"))).where("url IS NOT NULL")


def missing_urls(texts: DataFrame, claimed: DataFrame, text: str = "text") -> DataFrame:
    """Distinct URLs in texts, without a trailing `)`, `.` or `,`, that no source claims."""
    found = texts.select(F.explode(F.regexp_extract_all(text, F.lit(r"https?://[^\s<>\"'\]]+"), F.lit(0))).alias("u")).select(F.regexp_replace("u", r"[).,]+$", "").alias("url")).distinct()
    return found.join(claimed.select("url").distinct(), "url", "left_anti")


def duplicate_urls(claimed: DataFrame) -> DataFrame:
    """(url, source_ids): URLs of several sources, of which one is canonical."""
    out = claimed.groupBy("url").agg(F.array_sort(F.collect_set("source_id")).alias("source_ids"), F.bool_or("canonical").alias("c"))
    return out.where((F.size("source_ids") > 1) & F.col("c")).drop("c")
