"""Cases against work and payment records, and against channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_jobs.functions import routing, text
from evidence_jobs.operators.firsts import first_rows
from evidence_jobs.operators.phrases import with_phrases
from evidence_jobs.operators.places import dictionary
from evidence_jobs.sources.stored import stored

#: Issue types that no work record bears on; matches kept of a case.
SKIPPED, MOST_MATCHES = ["power", "traffic", "water_sewage"], 20
NOTE = "Public row; not proof of field resolution."


def regimes_compatible(case: Column, record: Column) -> Column:
    """Ward numbers compare within a family of regimes only; `common` joins the old family."""
    a, b = F.lower(F.trim(case)), F.lower(F.trim(record))
    new = a.isin("live_gba_xyinfo", "368_or_369", "368", "369")
    old = a.isin("198_or_225_or_243", "198", "225", "243")
    fits = F.when(new, b.isin("368_or_369", "368", "369")).when(old, b.isin("198_or_225_or_243", "198", "225", "243", "common")).otherwise(a == b)
    return (a != "") & (a != "unknown") & fits


def records_of(works: DataFrame, payments: DataFrame) -> DataFrame:
    """Works, then payments, as one table of records with their normalised text."""
    w = works.select(F.lit("work").alias("entity_type"), F.col("work_id").alias("record_id"), "source_id", "ward_number", "ward_regime", F.col("description").alias("claim"), "contractor", "amount", "row_number")
    p = payments.select(F.lit("payment").alias("entity_type"), F.col("payment_id").alias("record_id"), "source_id", "ward_number", "ward_regime", F.col("payment_reference").alias("claim"), "contractor", F.col("net_amount").alias("amount"), "row_number")
    return with_text(w.unionByName(p))


def with_text(records: DataFrame) -> DataFrame:
    """records with their normalised text."""
    return records.withColumn("text", text.normalize_name(F.concat_ws(" ", "claim", "contractor")))


#: Of a record, what a match shows; the order of those that score alike, works before payments.
OWN = ["entity_type", "record_id", "source_id", "claim", "amount", "row_number"]
ORDER = ["row_number", "record_id", "source_id", "claim", "amount"]


def leading_records(records: DataFrame, phrases: DataFrame, terms: DataFrame) -> DataFrame:
    """The first MOST_MATCHES distinct records of each class, with `_held`, the phrases in their text, `_words`, the terms among its words, and its wording.

    Records of a kind, ward and regime whose texts have the same of these are one class: no
    question can tell them apart, so it takes its best from the first ones. Each task keeps
    its own first before the shuffle.
    """
    said = routing.wording(F.col("text"))
    finds = {"_held": ("text", phrases, False), "_words": ("text", terms, True)}
    read = with_phrases(records.select(*OWN, "ward_number", "ward_regime", "text", *(c.alias(f"_{w}") for w, c in said.items())), finds, drop=("text",))
    alike = ["entity_type", "ward_number", "ward_regime", "_held", "_words", *(f"_{w}" for w in said)]
    n = F.dense_rank().over(Window.partitionBy(*alike).orderBy(*ORDER))
    return read.withColumn("_n", n).where(F.col("_n") <= MOST_MATCHES).drop("_n").distinct()


def asked_questions(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cases that records may bear on with the `question` that they ask, and the distinct questions."""
    asks = ["intent", "match_terms", "ward_number", "ward_regime", "place", "terms"]
    usable = cases.where(~F.col("issue_type").isin(*SKIPPED)).where((F.coalesce("place", F.lit("")) != "") | (F.size("terms") > 0))
    keyed = stored(usable.select("case_id", *asks, F.sha1(F.to_json(F.struct(*asks))).alias("question")))
    return keyed.select("case_id", "question"), stored(keyed.groupBy("question").agg(*(F.first(c).alias(c) for c in asks)))


def question_matches(questions: DataFrame, records: DataFrame) -> DataFrame:
    """(question, rank, record columns, match_method, label, confidence): the best records of asked_questions.

    Questions meet classes of records, by ward number and by place phrase. All phrases are
    looked for in one pass over the records' texts. A ward match is preferred to a match of
    the place in the text. Works come before payments, then by row number and id.
    """
    q = questions.withColumnsRenamed({"ward_number": "q_ward", "ward_regime": "q_regime"})
    wanted = F.array_distinct(F.filter(F.concat(F.array("place"), "terms"), lambda t: t.isNotNull() & (t != "")))
    phrases = stored(q.select("question", F.explode(wanted).alias("phrase")).where("phrase <> ''"))
    heads = stored(leading_records(records, phrases.select("phrase"), q.select(F.explode("match_terms").alias("term"))))
    by_ward = heads.join(dictionary(q), F.col("q_ward") == F.col("ward_number")).where((F.col("q_ward") != "") & regimes_compatible(F.col("q_regime"), F.col("ward_regime")))
    by_text = heads.withColumn("phrase", F.explode("_held")).join(dictionary(phrases), "phrase").drop("phrase").join(dictionary(q), "question")

    said = {w: F.col(f"_{w}") for w in routing.wording(F.lit(""))}
    gate = routing.worded_match(F.col("intent"), F.col("match_terms"), F.col("_words"), said)
    score = lambda ward: routing.worded_rank(F.col("intent"), said, F.lit(ward))
    shape = lambda df, ward, method: df.where(gate).select("question", *OWN, F.lit(method).alias("match_method"), F.lit(int(not ward)).alias("by"), score(ward).alias("m"))
    every = shape(by_ward, True, "ward_number_and_issue_terms").unionByName(shape(by_text, False, "place_text_and_issue_terms"))
    once = every.groupBy("question", *OWN).agg(F.min_by(F.struct("match_method", "m"), "by").alias("b")).select("question", *OWN, "b.match_method", F.col("b.m.label").alias("label"), F.col("b.m.confidence").alias("confidence"))
    order = [F.col("confidence").desc(), F.when(F.col("entity_type") == "work", 0).otherwise(1), "row_number", "record_id"]
    return stored(first_rows(once, ["question"], order, MOST_MATCHES))


def match_records(cases: DataFrame, records: DataFrame) -> DataFrame:
    """(case_id, rank, record columns, match_method, label, confidence): a case's best records.

    cases (case_id, issue_type, intent, match_terms, ward_number, ward_regime, place,
    terms). Many cases ask the same: each question is answered once, and the winners go
    back to the cases.
    """
    keyed, questions = asked_questions(cases)
    return keyed.join(dictionary(question_matches(questions, records)), "question").drop("question")


def evidence_rows(matches: DataFrame) -> DataFrame:
    """Matches as public evidence rows: text with its amount, two-decimal confidence, stable and positional id, display claim."""
    shown = text.with_amount(F.col("claim"), F.col("amount"))
    return matches.select(
        "case_id", "rank", "entity_type", shown.alias("text"), F.format_string("%.2f", "confidence").alias("match_confidence"), "match_method", F.col("label").alias("relevance_label"),
        text.stable_evidence_id(F.col("entity_type"), F.col("source_id"), F.col("row_number"), F.col("record_id"), F.col("claim")).alias("evidence_id"),
        F.concat(F.lit("evidence-"), "rank").alias("legacy_evidence_id"), text.display_claim(F.col("claim")).alias("display_claim"), "source_id", "row_number", F.lit(NOTE).alias("proof_note"),
    )


def match_channels(cases: DataFrame, channels: DataFrame) -> DataFrame:
    """(case_id, channel_id, match_method, confidence): channels of a case's agency, else those that list its issue type."""
    agency = F.coalesce((F.col("agency_id") != "") & (F.col("agency_id") == F.col("channel_agency")), F.lit(False))
    listed = F.array_contains("issue_types", F.col("issue_type"))
    c = dictionary(channels.select("channel_id", F.col("agency_id").alias("channel_agency"), "issue_types"))
    return cases.join(c, agency | listed).select("case_id", "channel_id", F.when(agency, "primary_agency_channel").otherwise("issue_type_channel").alias("match_method"), F.lit(0.82).alias("confidence"))
