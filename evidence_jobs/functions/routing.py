"""Issue types, intents and the agency that answers for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_jobs.functions.text import has_any, issue_keys, normalize_name

# Issue patterns on normalised text; the first that matches holds. The second needs the absence of the third.
GARBAGE = r"\b(garbage|trash|waste|swm|blackspot|dump|dumped|dumping|debris|rubbish)\b"
DRAIN = r"\b(drain|stormwater|storm water|swd)\b"
SEWAGE = r"\b(sewage|sewer|manhole|bwssb|tanker)\b"
WATER = r"\b(sewage|sewer|water|manhole|bwssb|tanker|overflow)\b"
POWER = r"\b(power|outage|transformer|wires?|bescom|shock|sparks?|sparking)\b"
TRAFFIC = r"\b(traffic|blocked|diversion|violation|challan|btp)\b"
STREETLIGHT = r"\b(street\s*lights?|streetlights?|lamp|lamps|pole light|light pole)\b"
ROAD = r"\b(potholes?|roads?|footpath|drain|stormwater|swd)\b"
ROADWORK = r"\b(digging|dug|excavation|road\s*work|roadwork|potholes?|road damage|repair)\b"
MONEY = r"\b(tender|tenders|award|awarded|contractor|contract|work orders?|payment|paid|bill|budget|spend|money|sanction)\b"
COMPLAINTS = r"\b(complaint|complaints|grievance|reported|status|recurring|recurrence|history|happened before|past|not working)\b"

# Issue type, agency, service, rule, and the terms that tie a record to the issue.
ROUTES = [
    ("garbage", "bswml", "solid_waste_collection", "garbage.primary", ["blackspot", "collection", "dump", "garbage", "rubbish", "solid", "sweeping", "swm"]),
    ("water_sewage", "bwssb", "water_or_sewer_service_request", "water_sewage.primary", ["drain", "manhole", "overflow", "sewage", "sewer", "water"]),
    ("power", "bescom", "electricity_distribution_safety_or_outage", "power.primary", ["electrical", "outage", "power", "spark", "sparks", "transformer", "wire", "wires"]),
    ("traffic", "btp", "traffic_violation_or_disruption", "traffic.primary", ["advisory", "block", "blocked", "diversion", "traffic"]),
    ("streetlight", "gba", "streetlight_maintenance", "streetlight.primary", ["electrical", "light", "lights", "street", "streetlight", "streetlights"]),
    ("road", "gba", "local_civic_issue", "road.primary", ["asphalt", "drain", "footpath", "maintenance", "pothole", "potholes", "road", "roads"]),
    ("civic", "gba", "local_civic_issue", "civic.fallback", ["asphalt", "drain", "footpath", "maintenance", "pothole", "potholes", "road", "roads"]),
]
# Word lists of the evidence gate, matched as substrings.
POTHOLE_WORDS = ["pothole", "potholes", "pot hole", "pot holes", "porthole", "portholes", "bad reach", "bad reaches"]
SURFACE_WORDS = ["road", "roads", "asphalt", "asphalting", "filling"]
FOOTPATH_WORDS = ["footpath", "footpaths", "sidewalk", "side walk", "pavement"]
DRAIN_WORDS = ["drain", "drains", "culvert", "culverts", "stormwater", "storm water", "swd"]
LIGHT_WORDS = ["streetlight", "streetlights", "street light", "street lights", "light pole", "pole light", "lamp", "lamps"]


def issue_type(query: Column) -> Column:
    text = normalize_name(query)
    return (
        F.when(text.rlike(GARBAGE), "garbage").when(text.rlike(DRAIN) & ~text.rlike(SEWAGE), "road").when(text.rlike(WATER), "water_sewage")
        .when(text.rlike(POWER), "power").when(text.rlike(TRAFFIC), "traffic").when(text.rlike(STREETLIGHT), "streetlight").when(text.rlike(ROAD), "road").otherwise("civic")
    )


def has_roadwork(query: Column) -> Column:
    return normalize_name(query).rlike(ROADWORK)


def routes(spark: SparkSession) -> DataFrame:
    """The routing table: issue_type, agency_id, service_type, rule_id, match_terms."""
    return spark.createDataFrame(ROUTES, "issue_type string, agency_id string, service_type string, rule_id string, match_terms array<string>")


def route_cases(cases: DataFrame, query: str = "query") -> DataFrame:
    """cases with issue_type, agency_id, service_type, rule_ids, match_terms and secondary_agency_id.

    A traffic case that speaks of road work has the local corporation as a second agency.
    """
    dual = (F.col("issue_type") == "traffic") & has_roadwork(F.col(query))
    routed = cases.withColumn("issue_type", issue_type(F.col(query))).join(F.broadcast(routes(cases.sparkSession)), "issue_type")
    return routed.withColumn("secondary_agency_id", F.when(dual, "gba")).withColumn("rule_ids", F.when(dual, F.array("rule_id", F.lit("roadwork.secondary_gba"))).otherwise(F.array("rule_id"))).drop("rule_id")


def interpret_intent(query: Column) -> Column:
    """struct(label, needs_money, needs_service, needs_complaints, needs_assets, issue_keys)."""
    text, keys = F.lower(query), issue_keys(F.lower(query))
    money, service = text.rlike(MONEY), F.size(keys) > 0
    complaints = service | text.rlike(COMPLAINTS)
    label = F.concat_ws("+", F.when(money, "money_trail"), F.when(service, "service_issue"), F.when(complaints, "complaint_memory"))
    return F.struct(
        F.when(label == "", "source_context").otherwise(label).alias("label"), money.alias("needs_money"), service.alias("needs_service"),
        complaints.alias("needs_complaints"), F.array_contains(keys, "streetlight").alias("needs_assets"), keys.alias("issue_keys"),
    )


def query_intent(query: Column, kind: Column) -> Column:
    """The issue type, and for roads what part of one."""
    text, road = normalize_name(query), kind == "road"
    return (
        F.when(road & has_any(text, FOOTPATH_WORDS), "road_footpath").when(road & has_any(text, POTHOLE_WORDS), "road_pothole")
        .when(road & has_any(text, DRAIN_WORDS), "road_drain").when(road, "road_general").when(kind == "", "civic").otherwise(kind)
    )


def wording(text: Column) -> dict[str, Column]:
    """What gate and rank read of a record's normalised text, besides its words."""
    lists = {"pothole": POTHOLE_WORDS, "surface": SURFACE_WORDS, "footpath": FOOTPATH_WORDS, "drain": DRAIN_WORDS, "light": LIGHT_WORDS}
    return {name: has_any(text, words) for name, words in lists.items()}


def issue_match(intent: Column, terms: Column, text: Column) -> Column:
    """A record's normalised text fits the issue."""
    return worded_match(intent, terms, F.split(text, " "), wording(text))


def worded_match(intent: Column, terms: Column, words: Column, said: dict[str, Column]) -> Column:
    """issue_match of the words of a text, those among terms at least, and its wording."""
    common = F.arrays_overlap(terms, words)
    surface, drain = said["surface"], said["drain"]
    return (
        F.when(intent == "streetlight", said["light"])
        .when(intent == "road_footpath", said["footpath"] | surface | drain)
        .when(intent == "road_pothole", said["pothole"] | surface | drain)
        .when(intent.isin("road_drain", "road_general"), common | surface | drain)
        .otherwise((F.size(terms) == 0) | common)
    )


def rank_match(intent: Column, text: Column, ward: Column) -> Column:
    """struct(label, confidence) of a record that fits, by intent and wording; a ward match adds 0.06."""
    return worded_rank(intent, wording(text), ward)


def worded_rank(intent: Column, said: dict[str, Column], ward: Column) -> Column:
    """rank_match of a text's wording."""
    boost = F.when(ward, 0.06).otherwise(0.0)
    pothole, surface, footpath, drain, light = (said[w] for w in ("pothole", "surface", "footpath", "drain", "light"))
    one = lambda label, value: F.struct(F.lit(label).alias("label"), F.round(F.lit(value) + boost, 2).alias("confidence"))
    flat = lambda label, value: F.struct(F.lit(label).alias("label"), F.lit(value).alias("confidence"))
    return (
        F.when((intent == "road_pothole") & pothole, one("Direct pothole/road work", 0.88))
        .when((intent == "road_pothole") & surface, one("Related road work", 0.82))
        .when((intent == "road_pothole") & drain, one("Drain/road context", 0.66))
        .when((intent == "road_drain") & drain, one("Drain/road context", 0.80))
        .when((intent == "streetlight") & light, one("Streetlight work", 0.82))
        .when((intent == "road_footpath") & footpath, one("Direct footpath work", 0.88))
        .when((intent == "road_footpath") & surface, one("Related road work", 0.70))
        .when((intent == "road_footpath") & drain, one("Drain/road context", 0.64))
        .when(intent.startswith("road") & surface, one("Related road work", 0.78))
        .when(ward, flat("Ward + issue match", 0.86))
        .otherwise(flat("Strong locality + issue match", 0.78))
    )


# Refusal reasons and the words that call for them.
REFUSALS = [
    ("corruption", ["corruption", "bribe", "fraud", "scam", "criminal"]),
    ("negligence", ["ignored", "negligence", "negligent", "failed to act", "did nothing"]),
    ("resolution", ["resolved", "fixed", "completed", "field condition"]),
    ("private_details", ["private phone", "account number", "rr number", "personal detail"]),
]


def refusal_reasons(question: Column) -> Column:
    """The reasons to refuse a question, in fixed order."""
    text = F.lower(question)
    return F.filter(F.array(*(F.when(has_any(text, words), F.lit(k)) for k, words in REFUSALS)), lambda k: k.isNotNull())
