"""Text, number and identity functions on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Issue keys and their aliases, matched as substrings of normalised text.
ISSUE_ALIASES = [
    ("streetlight", ["street light", "street lights", "streetlight", "streetlights", "streetlite", "street lites", "st light", "st lights", "st lite", "st lites", "bescom", "light pole", "lamp post", "not working", "wrking", "failing", "fail again"]),
    ("garbage", ["garbage", "garbge", "solid waste", "swm", "waste", "trash", "rubbish", "dump"]),
    ("drain", ["drain", "drains", "swd", "storm water", "stormwater", "rajakaluve", "flood", "floods", "flooding", "water logging", "waterlogging"]),
    ("road", ["road", "roads", "pothole", "pothol", "potholes", "asphalt", "footpath", "sidewalk"]),
]
# Words that end a place phrase, words that introduce one, and issue words.
PLACE_STOPS = "what who why where there is a an the this that my your can cite contact message not working keeps recurring again main road".split()
PLACE_STARTS = "near in at around on".split()
ISSUE_WORDS = (
    "garbage trash waste swm blackspot dump sewage sewer water manhole power outage transformer wire wires traffic blocked diversion "
    "streetlight streetlights street light lights lamp pole pothole potholes footpath drain stormwater swd"
).split()


def normalize_name(value: Column) -> Column:
    """Lower case, without the word `ward`, runs of anything but a-z and 0-9 as one space, trimmed."""
    text = F.regexp_replace(F.lower(F.trim(value)), r"\bward\b", "")
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def split_ward_number(value: Column) -> Column:
    """struct(number, name): `12-Name` or `12: Name` split, else ("", text)."""
    text, pattern = F.trim(value), r"^(\d+)\s*[-:]\s*(.+)$"
    hit = F.regexp_extract(text, pattern, 1) != ""
    return F.struct(
        F.when(hit, F.regexp_extract(text, pattern, 1)).otherwise("").alias("number"),
        F.when(hit, F.trim(F.regexp_extract(text, pattern, 2))).otherwise(text).alias("name"),
    )


def split_number_name(value: Column) -> Column:
    """As split_ward_number; without a leading number the text is also cut at its first " - "."""
    first, text = split_ward_number(value), F.trim(value)
    cut = F.instr(text, " - ")
    return F.when((first["number"] == "") & (cut > 0), F.struct(F.trim(F.substring(text, F.lit(1), cut - 1)).alias("number"), F.trim(F.substring(text, cut + 3, F.length(text))).alias("name"))).otherwise(first)


def int_or_none(value: Column) -> Column:
    """Commas dropped, truncated toward zero; null when blank, not a number or not finite."""
    text = F.trim(F.replace(value.cast("string"), F.lit(","), F.lit("")))
    # A blank is no number before it is parsed, as a failed parse costs an exception; NaN counts as larger than all.
    number = F.when(text != "", text).try_cast("double")
    return F.when(F.abs(number) < 9.2e18, number.cast("long"))


def clean_markup(value: Column) -> Column:
    """Tags out, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(value, "<[^>]+>", " "), r"\s+", " "))


def clean_text(value: Column) -> Column:
    """Ends of links as spaces, white space collapsed; a text with nothing but single spaces meets no pattern."""
    text = F.replace(value, F.lit("</a>"), F.lit(" "))
    loose = reduce(Column.__or__, (text.contains(c) for c in ("  ", "\t", "\n", "\x0b", "\f", "\r")))
    return F.trim(F.when(loose, F.regexp_replace(text, r"\s+", " ")).otherwise(text))


def first_value(*values: Column) -> Column:
    """The first non-empty value, trimmed; "" if there is none."""
    return F.coalesce(*(F.when(v != "", F.trim(v)) for v in values), F.lit(""))


def first_present(*values: Column) -> Column:
    """The first value that isn't blank, trimmed; "" if there is none."""
    return F.coalesce(*(F.when(F.trim(v) != "", F.trim(v)) for v in values), F.lit(""))


def first_of_map(row: Column, *keys: str) -> Column:
    """first_value over a map's keys, exactly as spelt.

    The keys are one array, so that many fields of wide rows stay small code, which the JVM compiles.
    """
    values = F.transform(F.array(*(F.lit(k) for k in keys)), lambda k: F.try_element_at(row, k))
    return F.coalesce(F.trim(F.get(F.filter(values, lambda v: v != ""), F.lit(0))), F.lit(""))


def joined_key(*values: Column) -> Column:
    """Fields with a vertical bar between; null as ""."""
    return F.concat_ws("|", *(F.coalesce(v.cast("string"), F.lit("")) for v in values))


def stable_evidence_id(entity_type: Column, source_id: Column, row_number: Column, record_id: Column, text: Column) -> Column:
    """ev_<type>_<16 hex digits of the SHA-1 of the key fields>."""
    kind = F.regexp_replace(normalize_name(entity_type), " ", "_")
    key = joined_key(source_id, row_number, record_id, normalize_name(F.coalesce(text, F.lit(""))))
    return F.concat(F.lit("ev_"), F.when(kind == "", "evidence").otherwise(kind), F.lit("_"), F.substring(F.sha1(key), 1, 16))


def display_claim(text: Column, limit: int = 180) -> Column:
    """White space collapsed; over the limit cut, with three dots."""
    compact = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(compact) <= limit, compact).otherwise(F.concat(F.rtrim(F.substring(compact, 1, limit - 3)), F.lit("...")))


def with_amount(text: Column, amount: Column) -> Column:
    return F.when(F.coalesce(amount, F.lit(0)) != 0, F.concat(text, F.lit("; amount "), amount.cast("string"))).otherwise(text)


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 longer than two, in order."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 2)


def overlap(left: Column, right: Column) -> Column:
    """Distinct tokens in common."""
    return F.size(F.array_intersect(left, right))


def aliases(name: Column) -> Column:
    """Spellings of a normalised name with and without a final u."""
    ends = name.endswith("u")
    out = F.array(
        F.when(name != "", name),
        F.when(ends & (F.length(name) > 3), F.substring(name, F.lit(1), F.length(name) - 1)),
        F.when(~ends & (name != ""), F.concat(name, F.lit("u"))),
    )
    return F.array_distinct(F.filter(out, lambda a: a.isNotNull() & (a != "")))


def without_final_u(name: Column) -> Column:
    return F.when(name.endswith("u") & (F.length(name) > 4), F.substring(name, F.lit(1), F.length(name) - 1)).otherwise(name)


def ngrams(text: Column, widths: int) -> Column:
    """Distinct word n-grams of 1 to `widths` words of a normalised text."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    n = F.size(words)
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def grams(width: int) -> Column:
        fits = F.filter(starts, lambda i: i + (width - 1) <= n)
        return F.transform(fits, lambda i: F.array_join(F.slice(words, i, width), " "))

    return F.array_distinct(F.flatten(F.array(*(grams(w) for w in range(1, widths + 1)))))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """phrase stands in text as whole words; both are normalised."""
    return (phrase != "") & F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), phrase, F.lit(" ")))


def has_any(text: Column, needles: list[str]) -> Column:
    """Any needle is a substring of text. A needle that holds another one needs no test of its own."""
    shortest = [n for n in dict.fromkeys(needles) if not any(m != n and m in n for m in needles)]
    return reduce(Column.__or__, (text.contains(n) for n in shortest))


def issue_keys(text: Column) -> Column:
    """Issue keys with an alias in the text, in fixed order."""
    return normalized_issue_keys(normalize_name(text))


def spoken_ward_numbers(text: Column, digits: str = "1,3") -> Column:
    """Numbers that a text names as a ward: `ward 12`, `Ward12`, `ward no. 12`, `ward number - 12`."""
    return F.regexp_extract_all(text, F.lit(r"(?i)\bward\s*(?:no\.?|number)?\s*-?\s*(\d{" + digits + r"})\b"), F.lit(1))


def normalized_issue_keys(name: Column) -> Column:
    """issue_keys of a text that is normalised already.

    Nulls go by array_except, which is compiled; in a filter all these tests would run interpreted.
    """
    return F.array_except(F.array(*(F.when(has_any(name, a), F.lit(k)) for k, a in ISSUE_ALIASES)), F.array(F.lit(None).cast("string")))


def query_terms(text: Column) -> Column:
    return F.filter(F.split(normalize_name(text), " "), lambda t: F.length(t) > 1)


def normalized_place_terms(name: Column) -> Column:
    """place_terms of a text that is normalised already."""
    among = lambda word, words: F.array_contains(F.array(*(F.lit(w) for w in words)), word)

    def before_stop(run: Column) -> Column:
        stop = F.array_position(F.transform(run, lambda w: among(w, PLACE_STOPS + ISSUE_WORDS)), True)
        return F.array_join(F.when(stop > 0, F.slice(run, 1, stop.cast("int") - 1)).otherwise(run), " ")

    words = F.filter(F.split(F.coalesce(name, F.lit("")), " "), lambda w: w != "")
    places = F.filter(F.transform(words, lambda w, i: F.when(among(w, PLACE_STARTS), i)), lambda i: i.isNotNull())
    runs = F.concat(F.transform(places, lambda i: F.slice(words, i + 2, F.lit(3))), F.array(F.slice(words, 1, 3)))
    return F.array_distinct(F.filter(F.transform(runs, before_stop), lambda p: p != ""))


def place_terms(query: Column) -> Column:
    """Place phrases of a query: up to three words after near, in, at, around or on, then the leading words; each ends before a stop word."""
    return normalized_place_terms(normalize_name(query))


def first_place_guess(query: Column) -> Column:
    return F.coalesce(F.try_element_at(place_terms(query), F.lit(1)), F.lit(""))


def confidence_label(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "high").when(confidence >= 0.5, "medium").otherwise("low")
