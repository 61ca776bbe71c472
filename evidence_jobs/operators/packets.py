"""Facts about the answer of a case: provenance, freshness, citations, claims and the contract that they keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_jobs.functions import policy, privacy
from evidence_jobs.operators.places import dictionary

POLICY_COLUMNS = ["domain", "official_status", "access_method", "pii_risk", "enabled"]


def source_policies(registry: DataFrame) -> DataFrame:
    """(source_id, source_tier, license, cadence_days, claim_eligibility, official_status, can_prove, cannot_prove, freshness_scope)."""
    eligible = policy.claim_eligibility(F.col("id"), *(F.col(c) for c in POLICY_COLUMNS))
    proof = policy.proof_contract(F.col("claim_eligibility"), *(F.col(c) for c in POLICY_COLUMNS))
    made = registry.withColumn("claim_eligibility", eligible).withColumn("proof", proof)
    return made.select(F.col("id").alias("source_id"), F.concat(F.lit("tier_"), "source_tier").alias("source_tier"), "license", F.col("freshness_policy_days").alias("cadence_days"), "claim_eligibility", "official_status", "proof.can_prove", "proof.cannot_prove", "proof.freshness_scope")


def with_provenance(evidence: DataFrame, policies: DataFrame, text_columns: list[str]) -> DataFrame:
    """evidence with its source's policy (unknown sources get a fixed default), pii_status and publishable."""
    personal = privacy.has_personal(F.to_json(F.struct(*text_columns)))
    joined = evidence.join(dictionary(policies), "source_id", "left")
    default = lambda c, value: F.coalesce(c, F.lit(value)).alias(c)
    kept = [c for c in evidence.columns if c != "source_id"]
    return joined.select("source_id", *kept, default("source_tier", "tier_unknown"), default("license", "unknown"), default("claim_eligibility", "unknown"), default("cadence_days", 0), F.when(personal, "contains_pii_block_public_output").otherwise("redacted_or_absent").alias("pii_status"), (~personal).alias("publishable"))


def freshness_summary(records: DataFrame, key: str, now: Column) -> DataFrame:
    """Per key of records (fetched_at, record_date, claim_eligibility, cadence_days): dates, undated rows, statuses, warning."""
    to = lambda c: F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd"))
    status = policy.freshness_status(F.col("claim_eligibility"), to("fetched_at"), to("record_date"), F.col("cadence_days"), now)
    fetched, dated = F.when(F.col("fetched_at") != "", F.col("fetched_at")), F.when(F.col("record_date") != "", F.col("record_date"))
    out = records.groupBy(key).agg(
        F.array_sort(F.collect_set(fetched)).alias("f"), F.array_sort(F.collect_set(dated)).alias("r"), F.count_if(fetched.isNull() & dated.isNull()).alias("undated"), F.array_sort(F.collect_set(status)).alias("statuses")
    )
    none = (F.size("f") == 0) & (F.size("r") == 0)
    first = F.when(none, "No source freshness timestamp was available for matched public records.").when(F.col("undated") > 0, F.concat(F.col("undated").cast("string"), F.lit(" matched public record(s) had no explicit freshness timestamp.")))
    second = F.when(F.array_contains("statuses", "historical_only"), "Matched work/payment rows are historical public records, not live status.")
    last = lambda c: F.coalesce(F.try_element_at(c, F.lit(-1)), F.lit(""))
    return out.select(key, F.slice("f", 1, 5).alias("fetched_at_values"), last(F.col("f")).alias("latest_fetched_at"), F.slice("r", 1, 5).alias("record_date_values"), last(F.col("r")).alias("latest_record_date"), "undated", "statuses", F.concat_ws(" ", first, second).alias("warning"))


def number_citations(uses: DataFrame, key: str, pointer: list[str], seq: str = "seq") -> DataFrame:
    """(key, pointer, citation): each distinct pointer of a packet numbered by its first use."""
    first = uses.groupBy(key, *pointer).agg(F.min(seq).alias("_first"))
    return first.withColumn("citation", F.row_number().over(Window.partitionBy(key).orderBy("_first", *pointer))).drop("_first")


def ordered_distinct(rows: DataFrame, key: str, value: str, seq: str = "seq") -> DataFrame:
    """(key, values): distinct values of each key in order of first appearance."""
    first = rows.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(key, value).agg(F.min(seq).alias("s"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("s", value))), lambda x: x[value]).alias("values"))


def evidence_summary(matches: DataFrame, cases: DataFrame, shown: int = 3, key: str = "case_id") -> DataFrame:
    """Per case (case_id, query, issue_type, source): total, shown and hidden rows, specificity and strength. Matches belong to cases by key.

    A question about a footpath that no row speaks of has related rows at best; rows of
    issue types that works don't bear on count as none.
    """
    low = F.lower("label")
    facts = matches.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.bool_or(low.contains("footpath")).alias("foot"), F.bool_or(low.startswith("direct") | low.contains("streetlight")).alias("direct"))
    joined = cases.join(facts, key, "left")
    total = F.coalesce("n", F.lit(0)).cast("int")
    specificity = (
        F.when(total == 0, "none").when(F.lower("query").contains("footpath") & ~F.col("foot"), "related").when(F.col("direct"), "direct")
        .when(F.col("issue_type").isin("garbage", "water_sewage", "power", "traffic"), "none").otherwise("related")
    )
    strength = F.when(total > 0, "public_row").when(F.col("source") == "official_xyinfo", "official_lookup").when(F.col("source").isin("locality_alias", "boundary_contains", "boundary_edge"), "weak").otherwise("none")
    return joined.select("case_id", total.alias("total"), F.least(total, F.lit(shown)).alias("shown"), F.greatest(total - shown, F.lit(0)).alias("hidden"), specificity.alias("specificity"), strength.alias("strength"))


def dangling_citations(claims: DataFrame, citations: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, citation_id): ids that a claim cites and the citation list lacks."""
    cited = claims.select(key, F.explode("citation_ids").alias("citation_id")).distinct()
    return cited.join(citations.select(key, "citation_id").distinct(), [key, "citation_id"], "left_anti")


def faithful(cited: Column, allowed: Column) -> Column:
    """Something is cited, and nothing beyond what is allowed."""
    return (F.size(cited) > 0) & (F.size(F.array_except(cited, allowed)) == 0)


def coverage_gaps(places: Column, landmark_asked: Column, landmark_hit: Column, needs_money: Column, asks_tender: Column, needs_complaints: Column, money_rows: Column, tender_rows: Column, complaint_rows: Column, rows: Column) -> Column:
    """What the retrieved rows of a case do not cover, in fixed order."""
    gaps = [
        (places == 0, "No place was confidently detected; results may be citywide or source-level."),
        (landmark_asked & ~landmark_hit, "No exact landmark-level match was found; evidence is area/ward-level unless a row explicitly names the landmark."),
        (needs_money & (money_rows + tender_rows == 0), "No normalized or raw row-level tender/payment evidence matched the query."),
        (needs_money & asks_tender & (tender_rows == 0), "No row-level tender evidence matched; retrieved money-trail evidence is limited to work/payment rows."),
        (needs_complaints & (complaint_rows == 0), "No matching complaint rows were found."),
        (rows == 0, "No row-level evidence matched; source metadata alone is not treated as an answer."),
    ]
    return F.filter(F.array(*(F.when(c, F.lit(t)) for c, t in gaps)), lambda g: g.isNotNull())


def answer_type(complaint_rows: Column, money_rows: Column, gaps: Column) -> Column:
    return F.when(complaint_rows > 0, "historical_memory").when(money_rows > 0, "official_record").when(F.size(gaps) > 0, "insufficient_evidence").otherwise("route_to_authority")


def answer_confidence(places: Column, rows: Column, gaps: Column) -> Column:
    return F.when(places == 0, "needs_place_clarification").when(F.size(gaps) > 0, "partial").when(rows > 0, "source_backed").otherwise("thin")


def contract_claims(complaint_rows: Column, latest: Column, work_rows: Column, tender_rows: Column, needs_money: Column, has_contact: Column, asks_now: Column, gaps: Column, cited: Column | None = None) -> Column:
    """array of struct(text, claim_type, support_level, citation_ids): what an answer claims, from its counts and gaps.

    `cited` is the number of retrieved citations, c1 and so on; the contact's comes after
    them. A contact claim cites that, all others cite the first.
    """
    contact = F.array(F.concat(F.lit("c"), ((F.lit(0) if cited is None else F.coalesce(cited, F.lit(0))) + 1).cast("string")))
    claim = lambda words, kind, level: F.struct(words.alias("text"), F.lit(kind).alias("claim_type"), F.lit(level).alias("support_level"), (contact if kind == "contact" else F.array(F.lit("c1"))).alias("citation_ids"))
    lit, text = F.lit, lambda n: n.cast("string")
    through = F.when(latest.isNotNull(), F.concat(lit(" through "), latest)).otherwise("")
    money = work_rows + tender_rows > 0
    fixed = F.array(
        F.when(complaint_rows > 0, claim(F.concat(lit("Official records show "), text(complaint_rows), lit(" matching complaint records"), through, lit(".")), "complaint_memory", "derived")),
        F.when(money, claim(F.concat(lit("Retrieved evidence includes "), text(work_rows), lit(" work/payment rows and "), text(tender_rows), lit(" tender rows.")), "money_trail", "context")).when(
            needs_money, claim(lit("No matching work/payment or tender row was retrieved for this money-trail request."), "money_trail", "gap")
        ),
        F.when(has_contact, claim(lit("The answer includes official complaint/contact channels and local routed roles where records show them."), "contact", "context")),
        F.when(latest.isNotNull(), claim(F.concat(lit("The latest cited complaint record date is "), latest, lit(".")), "freshness", "derived")).when(
            asks_now, claim(lit("No live/current row-level status was retrieved for this query."), "freshness", "gap")
        ),
    )
    every = F.concat(F.filter(fixed, lambda c: c.isNotNull()), F.transform(gaps, lambda g: claim(g, "gap", "gap")))
    return F.when(F.size(every) > 0, every).otherwise(F.array(claim(lit("No row-level evidence matched this query."), "gap", "gap")))


def answer_contract(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """(case_id, answer_type, confidence_label, gaps, claims) of every question with landmarks, from the facts of its rows; a question without rows has none."""
    c, n = F.col, lambda name: F.coalesce(F.col(name), F.lit(0))
    works, tenders, complaints = n("work_payment_rows"), n("tender_rows"), n("complaint_rows")
    low, places = F.lower("query"), F.size("names")
    gaps = coverage_gaps(
        places, F.size("landmark") > 0, F.coalesce("on_landmark", F.lit(False)), c("needs_money"), low.contains("tender"), c("wants_complaints"), works, tenders, complaints, complaints + works + tenders + n("streetlight_asset_rows")
    )
    rows = asked.join(facts, "case_id", "left").withColumn("gaps", gaps)
    claims = contract_claims(complaints, c("latest_record_date"), works, tenders, c("needs_money"), F.lit(True), low.rlike(r"\b(live|current|today|status|fresh|latest)\b"), c("gaps"), n("cited") if "cited" in facts.columns else None)
    label = answer_confidence(places, complaints + works + tenders, c("gaps"))
    return rows.select("case_id", answer_type(complaints, works + tenders, c("gaps")).alias("answer_type"), label.alias("confidence_label"), "gaps", claims.alias("claims"))


def answer_citations(asked: DataFrame, selected: DataFrame) -> DataFrame:
    """(case_id, n, id, source_id, evidence_type, chunk_key): the selected chunks in order of place, then the contact channels, of every question."""
    one = selected.select("case_id", F.col("place").cast("long").alias("n"), "source_id", F.col("chunk_type").alias("evidence_type"), "chunk_key")
    counted = selected.groupBy("case_id").agg(F.count(F.lit(1)).alias("rows"))
    last = asked.select("case_id").join(counted, "case_id", "left").select("case_id", (F.coalesce("rows", F.lit(0)) + 1).alias("n"), F.lit("official_contact_channels").alias("source_id"), F.lit("contact_channel").alias("evidence_type"), F.lit(None).cast("string").alias("chunk_key"))
    return one.unionByName(last).withColumn("id", F.concat(F.lit("c"), F.col("n").cast("string")))


def numbered(prefix: str, n: Column) -> Column:
    """prefix-1 to prefix-n."""
    count = F.coalesce(n, F.lit(0)).cast("int")
    ids = F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(F.lit(f"{prefix}-"), i.cast("string")))
    return F.when(count > 0, ids).otherwise(F.array().cast("array<string>"))


def packet_claims(located: Column, evidence: Column, channels: Column, guidance: Column) -> Column:
    """array of struct(claim_type, text, citation_ids): what a packet claims from its ward, its evidence rows and its channels; else where to file."""
    claim = lambda when, kind, words, ids: F.when(when, F.struct(F.lit(kind).alias("claim_type"), words.alias("text"), ids.alias("citation_ids")))
    some = F.array(
        claim(located, "jurisdiction", F.lit("The place was resolved to a ward."), numbered("jurisdiction", F.lit(1))),
        claim(F.size(evidence) > 0, "public_work_or_payment", F.lit("Normalized public work/payment rows matched this question."), evidence),
        claim(F.size(channels) > 0, "contact", F.lit("Official complaint/contact channel metadata is available."), channels),
    )
    held = F.filter(some, lambda x: x.isNotNull())
    return F.when(F.size(held) > 0, held).otherwise(F.array(claim(F.lit(True), "coverage_gap", guidance, numbered("none", F.lit(0)))))


# What a packet must hold, and the values of its enums.
PACKET_STATUSES = ["ready", "insufficient_structured_evidence"]
STRENGTHS = ["none", "weak", "public_row", "official_lookup"]


def contract_failures(packets: DataFrame, required: list[str]) -> DataFrame:
    """packets with `failures`: missing fields, bad enums, confidences out of 0 to 1, incomplete or dangling evidence, unpublishable records.

    packets (packet_status, evidence_strength, confidence, evidence array<struct<evidence_id,
    source_id, match_confidence>>, citation_ids, cited_ids, publishable array<boolean>, ...).
    """
    enum = lambda c, values: F.when(~F.coalesce(F.col(c).isin(*values), F.lit(False)), F.concat(F.lit(f"invalid_{c}="), F.coalesce(c, F.lit("None"))))
    fixed = [enum("packet_status", PACKET_STATUSES), enum("evidence_strength", STRENGTHS), *(F.when(F.col(c).isNull(), F.lit(f"missing_key={c}")) for c in sorted(required)), F.when(~F.col("confidence").between(0, 1), F.lit("confidence must be between 0 and 1"))]
    at = lambda i, what: F.concat(F.lit("evidence["), i.cast("string"), F.lit(f"].{what}"))
    rows = F.flatten(
        F.transform("evidence", lambda e, i: F.array(
            F.when(F.coalesce(e["evidence_id"], F.lit("")) == "", at(i, "missing_key=evidence_id")), F.when(F.coalesce(e["source_id"], F.lit("")) == "", at(i, "missing_key=source_id")),
            F.when(~F.coalesce(e["match_confidence"].between(0, 1), F.lit(False)), at(i, "match_confidence must be between 0 and 1")),
        ))
    )
    dangling = F.transform(F.array_except("cited_ids", "citation_ids"), lambda c: F.concat(F.lit("claim cites unknown citation_id="), c))
    blocked = F.transform("publishable", lambda p, i: F.when(~p, F.concat(F.lit("provenance.evidence_records["), i.cast("string"), F.lit("] is not publishable"))))
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return packets.withColumn("failures", F.filter(F.concat(F.array(*fixed), empty(rows), empty(dangling), empty(blocked)), lambda x: x.isNotNull()))


def trace_events(packets: DataFrame, event_type: str = "packet_build") -> DataFrame:
    """Packets (trace_id, query, evidence, citation_ids, rule_ids, resolver_source, created_at_epoch_ms) as flat log events with hashes and selected ids."""
    ids = F.transform(F.coalesce("evidence", F.array().cast(packets.schema["evidence"].dataType)), lambda e: e["evidence_id"])
    return packets.select(
        F.lit(event_type).alias("event_type"), "trace_id", F.substring(F.sha2("query", 256), 1, 16).alias("query_hash"), F.array_join(ids, ",").alias("selected_evidence_ids"),
        F.array_join("citation_ids", ",").alias("selected_citation_ids"), F.array_join("rule_ids", ",").alias("routing_rule_ids"), "resolver_source", "created_at_epoch_ms",
    )
