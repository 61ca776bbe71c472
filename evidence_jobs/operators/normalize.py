"""Raw archive rows to entity tables: accept or reject, redact, first one wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_jobs.functions import dates, privacy, text
from evidence_jobs.operators.firsts import first_rows

# Spellings of work sources, and what the entities may claim.
WORK_SOURCES = {
    "bbmp_work_orders_payments_2025_26": "bbmp_work_orders_and_payments_2025_26",
    "bbmp_work_orders_bill_payment": "bbmp_work_orders_and_bill_payment",
}
CLAIMS = {
    "wards": ("wards_v2", "proof_with_mirror_caveat", ["This source maps ward, zone, and constituency fields."], ["Does not prove current GBA filing jurisdiction without a newer lookup or ward-regime match."], "source_fetched_at"),
    "grievances": ("grievances_v2", "reported_civic_need", ["This source contains a public grievance row with the listed category/status."], ["Does not prove the issue was actually resolved on the ground."], "grievance_date"),
    "works": ("works_payments_v1", "proof_with_mirror_caveat", ["A public work/payment source row exists with these fields."], ["Does not prove field completion, repair quality, corruption, or contractor fault."], "source_fetched_at"),
    "channels": ("channels_v1", "official_channel", ["This public source describes an official filing or contact channel."], ["Does not prove individual complaint status or ground resolution.", "Do not scrape complaint tracking", "Do not scrape citizen/account-linked records."], "source_fetched_at"),
}
# Agencies with their names, issue types, public contacts and the labels of form fields.
AGENCIES = [
    ("bwssb", "Bengaluru Water Supply and Sewerage Board", "BWSSB complaint channel", ["water", "sewerage", "manhole", "billing"], ["BWSSB 1916", "BWSSB official call-center email"]),
    ("bescom", "Bengaluru Electricity Supply Company", "BESCOM complaint/contact channel", ["power", "outage", "electrical_safety", "streetlight"], ["BESCOM 1912", "BESCOM official WhatsApp channel"]),
    ("btp", "Bengaluru Traffic Police", "Bengaluru Traffic Police public channel", ["traffic", "road_block", "violation"], ["BTP official WhatsApp channel"]),
    ("bswml", "Bengaluru Solid Waste Management Limited / SWM", "BSWML/SWM complaint channel", ["garbage", "solid_waste", "blackspot"], ["GBA/BBMP 1533", "BSWML official WhatsApp channel"]),
]
FIELD_LABELS = ["Consumer Name", "Email Address", "Contact Number", "Address", "Category", "Sub Category", "RR Number"]
CHANNEL_URLS = {
    "bwssb_crm_complaint_form": "https://cms.bwssb.gov.in/module/complain/new_complaint",
    "bescom_official_contact_complaint_channels": "https://bescom.karnataka.gov.in/new-page/Contact%20Us/en",
    "bengaluru_traffic_police_official_website": "https://btp.karnataka.gov.in/en",
}


def evidence(source_id: Column, run_id: Column, raw_file: Column, row_number: Column) -> Column:
    return F.struct(source_id.alias("source_id"), run_id.alias("run_id"), raw_file.alias("raw_file"), row_number.cast("long").alias("row_number"))


def claim_metadata(kind: str, fetched_at: Column, run_id: Column) -> Column:
    """struct of fetched_at (the run id where it is missing), parser_version, claim_class, allowed and disallowed claims, freshness_basis."""
    version, claim_class, allowed, disallowed, basis = CLAIMS[kind]
    return F.struct(
        F.coalesce(F.when(fetched_at != "", fetched_at), run_id).alias("fetched_at"), F.lit(version).alias("parser_version"), F.lit(claim_class).alias("claim_class"),
        F.array(*map(F.lit, allowed)).alias("allowed_claims"), F.array(*map(F.lit, disallowed)).alias("disallowed_claims"), F.lit(basis).alias("freshness_basis"),
    )


def canonical_work_source(source_id: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in WORK_SOURCES.items() for x in pair)), source_id), source_id)


def ward_regime(raw_file: Column) -> Column:
    """198, 225, 243 or common, by the file's name; else unknown."""
    name = F.lower(F.element_at(F.split(raw_file, "/"), -1))
    return F.when(name.contains("198"), "198").when(name.contains("225"), "225").when(name.contains("243"), "243").when(name.contains("common"), "common").otherwise("unknown")


def split_accepted(rows: DataFrame, reason: Column, row_map: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rows without and with a reason; rejected ones have their map redacted."""
    judged = rows.withColumn("reason", reason)
    rejected = judged.where(F.col("reason").isNotNull())
    if row_map is not None:
        rejected = rejected.withColumn("row", privacy.redact_map(row_map))
    return judged.where(F.col("reason").isNull()).drop("reason"), rejected


def first_wins(rows: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """The first row of each key in a total order.

    A window's columns are read only where they are wanted, those of a minimum of structs
    always. Each task keeps its own first rows before the shuffle.
    """
    return first_rows(rows, keys, order_by, 1, "_n").drop("_n")


def ward_rows(raw: DataFrame, row: str = "row") -> DataFrame:
    """Raw rows (row map) with kind (mapping, gba, old, skip), reason and the fields of a ward or mapping.

    A row with old and new number columns is a mapping and, if it also names a ward, an
    old ward; complaint rows and rows without number and name are skipped.
    """
    get = lambda *keys: text.first_of_map(F.col(row), *keys)
    has = lambda key: F.map_contains_key(F.col(row), F.lit(key))
    mapping = has("Old Ward Num") & has("New Ward Num")
    gba = has("Ward_No_Name")
    split = text.split_ward_number(get("Ward_No_Name"))
    number = F.when(gba, split["number"]).otherwise(get("Ward No", "Ward_No", "Ward No.", "ward number", "Ward"))
    name = F.when(gba, split["name"]).otherwise(get("Ward Name", "Ward Names", "name_en", "Old Ward Name", "New Ward Name"))
    kind = F.when(mapping, "mapping").when(has("Complaint ID"), "skip").when(gba, "gba").when((number == "") | (name == ""), "skip").otherwise("old")
    corporation = F.when(gba, get("Corporation_Name")).otherwise("")
    region = text.normalize_name(corporation)
    out = raw.withColumns({"kind": kind, "ward_number": number, "ward_name": name, "corporation": corporation})
    out = out.withColumns(
        {
            "reason": F.when((F.col("kind") == "mapping") & ((get("New Ward Num") == "") | (get("New Ward Name") == "")), "mapping row missing new ward number or name").when(
                (F.col("kind") == "gba") & ((number == "") | (name == "")), "GBA row missing Ward_No_Name"
            ),
            "ward_key": F.when(gba, F.concat(F.lit("gba:"), F.when(region == "", "unknown").otherwise(region), F.lit(":"), number)).otherwise(F.concat(F.lit("old:"), number)),
            "normalized_name": text.normalize_name(name), "version": F.when(gba, "gba_2025").otherwise("old_bbmp"),
            "zone": F.when(gba, "").otherwise(get("BBMP Zone Name", "Zones")), "ward_regime": F.when(gba, "368_or_369").otherwise("198_or_225_or_243"),
            "assembly_constituency": F.when(gba, get("Assembly_Name")).otherwise(get("Assembly constituency", "Assembly Constituency", "Assembly Constituency Name")),
            "population": text.int_or_none(F.when(gba, get("TOT_P")).otherwise(get("Population (2011)", "Total Population"))),
            "old_ward_number": get("Old Ward Num"), "old_ward_name": get("Old Ward Name"), "new_ward_number": get("New Ward Num"), "new_ward_name": get("New Ward Name"),
            "method": F.lit("official_mapping_csv"), "confidence": F.lit(1.0),
        }
    )
    return out


def complaint_rows(raw: DataFrame) -> DataFrame:
    """raw (complaint_id, ward_name, category, sub_category, date_text, status, remarks, staff_name, provenance) as complaints with a reason where they are rejected.

    An id, then a ward, then a date that can be read are asked for, in this order.
    """
    # Read once, in a step of its own, as several columns need them.
    raw = raw.withColumns({"_id": F.trim("complaint_id"), "_ward": F.trim("ward_name"), "_day": dates.parse_date(F.trim("date_text"))})
    id_, ward, day = F.col("_id"), F.col("_ward"), F.col("_day")
    reason = (
        F.when(F.coalesce(id_, F.lit("")) == "", "complaint row missing Complaint ID").when(F.coalesce(ward, F.lit("")) == "", F.concat(F.lit("complaint "), id_, F.lit(" missing Ward Name")))
        .when(day.isNull(), F.concat(F.lit("invalid Grievance Date: "), F.trim("date_text")))
    )
    return raw.select(
        *(c for c in raw.columns if c in ("seq", "source_id", "run_id", "raw_file", "pos", "row_number", "row")), id_.alias("external_complaint_id"), F.trim("category").alias("issue_category"), F.trim("sub_category").alias("issue_subcategory"),
        day.alias("grievance_date"), F.when(day != "", F.substring(day, 1, 4).try_cast("int")).alias("year"), ward.alias("ward_name_raw"), text.normalize_name(ward).alias("normalized_ward_name"),
        F.trim("status").alias("status"), privacy.redact(F.trim("remarks")).alias("staff_remarks"), privacy.redact(F.trim("staff_name")).alias("staff_name"),
        evidence(F.col("source_id"), F.col("run_id"), F.col("raw_file"), F.col("row_number")).alias("evidence"), reason.alias("reason"),
    )


def normalize_complaints(raw: DataFrame, order_by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(complaints, rejections); the first row of an id in order wins."""
    made = complaint_rows(raw)
    return first_wins(made.where("reason IS NULL").drop("reason"), ["external_complaint_id"], order_by), made.where("reason IS NOT NULL")


def work_rows(raw: DataFrame) -> DataFrame:
    """raw work rows (external_id, description, ward_number, contractor, amount, payment_reference, net_amount, ...) with ids, cleaned fields and a reason."""
    # Texts are cleaned once, in a step of their own, as several columns need them.
    cleaned = raw.withColumns({"_id": F.trim("external_id"), "description": text.clean_markup(F.col("description")), "payment_reference": F.trim("payment_reference"), "source_id": canonical_work_source(F.col("source_id"))})
    work_id = F.concat("source_id", F.lit(":"), F.when(F.col("_id") != "", F.col("_id")).otherwise(F.col("row_number").cast("string")))
    return cleaned.withColumns(
        {
            "reason": F.when((F.col("_id") == "") & (F.col("description") == ""), "work/payment row missing identifier and description"), "work_id": work_id,
            "description": privacy.redact(F.col("description")), "contractor": privacy.redact(F.col("contractor")), "ward_regime": ward_regime(F.col("raw_file")), "amount": text.int_or_none(F.col("amount")),
            "payment_reference": privacy.redact(F.col("payment_reference")), "net_text": F.trim("net_amount"), "net_amount": text.int_or_none(F.col("net_amount")),
        }
    ).drop("_id")


def split_works(made: DataFrame, order_by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(works, payments, rejections) of work_rows: one raw row is a work, and a payment if it has a reference or a net value.

    Payments are deduplicated among payment rows alone, so one may come from a later row
    than its work.
    """
    good = made.where("reason IS NULL").drop("reason")
    paid = good.where("payment_reference <> '' OR net_text <> ''").withColumn("payment_id", F.concat("work_id", F.lit(":payment")))
    return first_wins(good, ["work_id"], order_by), first_wins(paid, ["payment_id"], order_by), made.where("reason IS NOT NULL")


def normalize_works(raw: DataFrame, order_by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """split_works of raw rows."""
    return split_works(work_rows(raw), order_by)


def agency_of(source_id: Column, normalized: Column) -> Column:
    """The agency that a page belongs to, by its source or its words; "" if unknown."""
    return (
        F.when(source_id.contains("bwssb") | normalized.contains("bwssb"), "bwssb").when(source_id.contains("bescom") | normalized.contains("bescom"), "bescom")
        .when(source_id.contains("btp") | normalized.contains("traffic police"), "btp").when(source_id.rlike("swm|waste") | normalized.contains("solid waste"), "bswml").otherwise("")
    )


def channel_rows(pages: DataFrame) -> DataFrame:
    """pages (source_id, text) with agency_id, names, issue_types, required_fields, contacts, url and a reason for unknown agencies."""
    agencies = F.broadcast(pages.sparkSession.createDataFrame(AGENCIES, "agency_id string, agency_name string, channel_name string, issue_types array<string>, contacts array<string>"))
    low = F.lower(F.coalesce("text", F.lit("")))
    labels = F.filter(F.array(*(F.when(low.contains(label.lower()), F.lit(label)) for label in FIELD_LABELS)), lambda x: x.isNotNull())
    urls = F.create_map(*(F.lit(x) for pair in CHANNEL_URLS.items() for x in pair))
    made = pages.withColumns({"agency_id": agency_of(F.col("source_id"), text.normalize_name(F.coalesce("text", F.lit("")))), "required_fields": labels, "url": F.coalesce(F.element_at(urls, F.col("source_id")), F.lit(""))})
    return made.join(agencies, "agency_id", "left").withColumn("reason", F.when(F.col("agency_id") == "", "unknown channel agency"))


def contact_rows(channels: DataFrame) -> DataFrame:
    """One row per public contact of each channel row."""
    return channels.where("reason IS NULL").select("source_id", "agency_id", F.explode("contacts").alias("name"), "issue_types").withColumn("channel_id", F.concat("agency_id", F.lit(":"), F.regexp_replace(text.normalize_name(F.col("name")), " ", "_")))


def category_dimension(rows: DataFrame, order_by: list[str]) -> DataFrame:
    """(name, normalized_name, source_id): distinct categories with their first row's source."""
    named = rows.where("issue_category <> ''")
    return named.groupBy(F.col("issue_category").alias("name")).agg(F.min_by("source_id", F.struct(*order_by)).alias("source_id")).withColumn("normalized_name", text.normalize_name(F.col("name")))


def ward_order() -> list[Column]:
    """Version, number (99999 if it is none), name."""
    return [F.col("version"), F.when(F.col("ward_number").rlike(r"^\d+$"), F.col("ward_number").try_cast("int")).otherwise(99999), F.col("ward_name")]
