"""What a source may prove, how fresh it is, and how its archive stands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidence_jobs.functions.dates import age_days

BLOCKED_ACCESS = ["manual_review", "private", "account_linked", "otp_login"]

# What each class of source can and cannot prove, and in what scope.
PROOF = {
    "blocked": (
        "Not eligible for public-output proof from this archive.",
        "Cannot support public claims, live status, incident ownership, or private/account-linked facts.",
        "Blocked for public output; archive metadata may be retained for operator review only.",
    ),
    "jurisdiction": (
        "Ward, corporation, and jurisdiction context present in available public records.",
        "Field condition, agency action, issue resolution, or current ground truth.",
        "Jurisdiction context from the available archived lookup; not live issue status.",
    ),
    "grievances": (
        "Complaint memory present in available archived records.",
        "Live complaint status, ground truth prevalence, or resolution quality.",
        "Historical complaint-memory context from the available archived records.",
    ),
    "works": (
        "Public administrative work, payment, tender, or award rows exist in available records.",
        "Field completion, work quality, corruption, negligence, issue resolution, or current condition.",
        "Historical/admin context from the available archive; not live field status.",
    ),
    "routing": (
        "Route/contact metadata present in available public records.",
        "Ownership for the exact incident, live ticket status, or current ground response.",
        "Archived routing/contact context; verify before treating as current operational status.",
    ),
    "unofficial": (
        "Lead or contextual signal only.",
        "Official claims, civic status, agency action, or current condition.",
        "Unofficial context only; not a public-record proof source.",
    ),
    "public": (
        "Public context present in available archived records.",
        "Live civic status, ground truth condition, resolution quality, or agency action.",
        "Available archived context only; not live issue status.",
    ),
}


def claim_eligibility(id_: Column, domain: Column, official_status: Column, access_method: Column, pii_risk: Column, enabled: Column) -> Column:
    """What claims a source's rows may support; the first rule that fits."""
    official = official_status.isin("official", "official_reference")
    return (
        F.when(~enabled | (pii_risk == "high"), "not_public_output")
        .when(domain == "wards", "jurisdiction")
        .when(domain == "works_payments_tenders", "historical_public_context")
        .when(domain.isin("streetlights", "water_sewage", "traffic_mobility", "swm") & official, "routing")
        .when(id_.contains("complaint_tracking") | (access_method == "manual_review"), "not_public_output")
        .when(official | (official_status == "mirrored_official"), "public_context")
        .otherwise("weak_context")
    )


def proof_contract(eligibility: Column, domain: Column, official_status: Column, access_method: Column, pii_risk: Column, enabled: Column) -> Column:
    """struct(claim_eligibility, can_prove, cannot_prove, freshness_scope)."""
    blocked = (eligibility == "not_public_output") | (pii_risk == "high") | ~enabled | access_method.isin(*BLOCKED_ACCESS)
    kind = (
        F.when(blocked, "blocked").when((domain == "wards") | (eligibility == "jurisdiction"), "jurisdiction").when(domain == "grievances", "grievances")
        .when((domain == "works_payments_tenders") | (eligibility == "historical_public_context"), "works").when(eligibility == "routing", "routing")
        .when(official_status.isin("community_signal", "external_reference", "unofficial"), "unofficial").otherwise("public")
    )
    pick = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in PROOF.items() for x in (k, v[i]))), kind)
    return F.struct(
        F.when(blocked, "not_public_output").otherwise(eligibility).alias("claim_eligibility"),
        F.array(pick(0)).alias("can_prove"), F.array(pick(1)).alias("cannot_prove"), pick(2).alias("freshness_scope"),
    )


def freshness_status(eligibility: Column, fetched_at: Column, record_date: Column, cadence_days: Column, now: Column) -> Column:
    latest = F.coalesce(fetched_at, record_date)
    return (
        F.when(eligibility == "historical_public_context", "historical_only").when(latest.isNull(), "undated")
        .when(F.coalesce(cadence_days, F.lit(0)) == 0, "unknown").when(age_days(latest, now) <= cadence_days, "fresh").otherwise("stale")
    )


def freshness_label(status: Column, eligibility: Column, official_status: Column) -> Column:
    return (
        F.when((eligibility == "jurisdiction") & (official_status == "official"), "Official lookup").when(eligibility == "jurisdiction", "Public ward data")
        .when(status == "fresh", "Recent public record").when(status.isin("stale", "historical_only"), "Historical public record")
        .when(status == "undated", "Undated public row").otherwise("Not live status")
    )


def archive_status(run_id: Column, manifest_issue: Column, status: Column) -> Column:
    return (
        F.when(run_id.isNull(), "not_fetched").when(manifest_issue.isNotNull(), "needs_review").when(status == "success", "archive_available")
        .when(status == "partial", "partial_archive").when(status == "failed", "failed_archive").otherwise("needs_review")
    )


def monitor_status(archive: Column, stale: Column, eligibility: Column, access_method: Column, pii_risk: Column, enabled: Column) -> Column:
    return (
        F.when((eligibility == "not_public_output") | ~enabled | (pii_risk == "high") | access_method.isin(*BLOCKED_ACCESS), "blocked")
        .when(archive == "partial_archive", "partial").when(archive.isin("failed_archive", "not_fetched", "needs_review"), "unavailable")
        .when(stale, "stale").otherwise("usable")
    )


def parser_status(profiled: Column, blocking_issues: Column, difficulty: Column) -> Column:
    structured = difficulty.isin("easy_structured", "medium_structured", "geo_structured")
    return F.when(~profiled, "not_profiled").when(blocking_issues != "", "blocked").when(structured | (difficulty == ""), "profiled").otherwise(difficulty)


def resource_caveat(failed: Column, pending: Column, failed_ids: Column) -> Column:
    """How many resources failed or wait, with up to three failed ids; null if none."""
    some = lambda n, word: F.when(n > 0, F.concat(n.cast("string"), F.lit(" CKAN resource"), F.when(n != 1, "s").otherwise(""), F.lit(f" {word}")))
    pieces = F.concat_ws("; ", some(failed, "failed"), some(pending, "pending"))
    detail = F.when(F.size(failed_ids) > 0, F.concat(F.lit(": "), F.array_join(F.slice(failed_ids, 1, 3), ", "))).otherwise("")
    return F.when(pieces != "", F.concat(pieces, detail, F.lit(".")))


def caveats(archive: Column, manifest_issue: Column, errors: Column, resources: Column, blocking_issues: Column, difficulty: Column, timestamp_caveat: Column, stale: Column, age: Column, policy_days: Column, pii_risk: Column, access_method: Column) -> Column:
    """What limits a source's use, in fixed order, without repeats."""
    text = F.lit
    days = F.concat(text("Last archived "), age.cast("string"), text(" days ago; freshness policy is "), policy_days.cast("string"), text(" days."))
    first = F.array(F.when(archive == "not_fetched", "No archived fetch run is available for this source root."), manifest_issue)
    last = F.array(
        resources, F.when(blocking_issues != "", blocking_issues),
        F.when(difficulty.isin("html_snapshot_only", "portal_later", "pdf_extract"), F.concat(text("Parser status requires review: "), difficulty, text("."))),
        timestamp_caveat, F.when(stale, days),
        F.when(pii_risk == "high", "High PII risk blocks public-output proof from this source."),
        F.when(access_method.isin(*BLOCKED_ACCESS), "Manual/private/account-linked access blocks public-output proof in v1."),
    )
    return F.array_distinct(F.filter(F.concat(first, F.coalesce(errors, F.array().cast("array<string>")), last), lambda c: c.isNotNull()))


def parser_difficulty(access_method: Column, form: Column, official_status: Column) -> Column:
    text = F.lower(form)
    return (
        F.when(access_method == "official_portal_scrape_later", "portal_later").when(official_status.isin("community_signal", "external_reference", "unofficial"), "community_signal_only")
        .when(text.contains("pdf"), "pdf_extract").when(text.rlike("kml|gis|geo"), "geo_structured").when(text.rlike("csv|ckan"), "medium_structured")
        .when(text.contains("html"), "html_snapshot_only").otherwise("manual_review")
    )


def normalization_wave(domain: Column) -> Column:
    return (
        F.when(domain == "wards", 1).when(domain == "grievances", 2).when(domain == "works_payments_tenders", 3)
        .when(domain.isin("roads", "stormwater_flooding", "swm", "streetlights"), 4).when(domain.isin("rules", "budgets_governance"), 5)
        .when(domain.isin("water_sewage", "traffic_mobility"), 6).otherwise(7)
    )


def answer_focus(domain: Column, source_id: Column) -> Column:
    """What kind of question a source answers."""
    d, i = F.lower(domain), F.lower(source_id)
    return (
        F.when((d == "works_payments_tenders") | i.rlike("tender|work_order|payment|bill|contractor"), "money_trail")
        .when((d == "budgets_governance") | i.contains("budget"), "budget_context")
        .when((d == "grievances") | i.rlike("grievance|complaint"), "complaint_memory")
        .when(d.isin("roads", "stormwater_flooding", "swm", "streetlights"), "service_issue").when(d == "wards", "ward_context").otherwise("source_context")
    )


# Search words of each focus.
FOCUS_TERMS = {
    "money_trail": ["award", "awarded", "bill", "contract", "contractor", "money", "paid", "payment", "procurement", "sanction", "spend", "tender", "work", "work order"],
    "budget_context": ["allocation", "budget", "capital", "estimate", "fund", "outlay", "spend"],
    "complaint_memory": ["complaint", "grievance", "issue", "recurrence", "reported", "status"],
    "service_issue": ["drain", "flooding", "garbage", "pothole", "road", "service", "streetlight", "swm"],
    "ward_context": ["boundary", "corporation", "delimitation", "ward", "zone"],
    "source_context": ["evidence", "record", "source"],
}


def source_keywords(focus: Column, *fields: Column) -> Column:
    """Sorted distinct search words: the source's own fields in lower case and its focus's words."""
    terms = F.element_at(F.create_map(*(x for k, v in FOCUS_TERMS.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), focus)
    return F.array_sort(F.array_distinct(F.filter(F.concat(F.array(*(F.lower(f) for f in fields)), terms), lambda t: t != "")))
