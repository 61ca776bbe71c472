"""Place truth: candidates of a place query, its complaints, and their totals per year lens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_jobs.functions.text import normalize_name
from evidence_jobs.operators.phrases import with_phrases

#: Wards, mappings and place lists are dictionaries; one larger than this, in rows or as bytes of JSON, is not broadcast.
DICTIONARY_ROWS, DICTIONARY_BYTES = 1_000_000, 128 << 20
#: Lenses that a grid has by default: label, first year, last year.
LENSES = [("all", None, None), ("recent", 1998, None), ("single", 1997, 1997)]


def is_dictionary(df: DataFrame) -> bool:
    """Whether df is small, by rows and bytes that are counted up to the limit; df should be a stored or given table."""
    rows, size = df.limit(DICTIONARY_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return rows <= DICTIONARY_ROWS and size <= DICTIONARY_BYTES


def dictionary(df: DataFrame) -> DataFrame:
    """df marked for broadcast if it is small enough."""
    return F.broadcast(df) if is_dictionary(df) else df


def containments(places: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct (query, name) where one holds the other, of places (query) and names (name); both not empty.

    Names are looked for in queries, and queries in names, by an automaton each, so only
    pairs that match are made.
    """
    queries = places.select("query").where("query <> ''").distinct()
    known = names.select("name").where("name <> ''").distinct()
    inside = with_phrases(queries, {"held": ("query", known, False)}).select("query", F.explode("held").alias("name"))
    around = with_phrases(known, {"held": ("name", queries, False)}).select(F.explode("held").alias("query"), "name")
    return inside.unionByName(around).distinct()


def name_score(name: Column, query: Column) -> Column:
    """1.0 equal, 0.85 query inside the name, 0.75 name inside the query, else 0."""
    return F.when(name == query, 1.0).when((query != "") & name.contains(query), 0.85).when((name != "") & query.contains(name), 0.75).otherwise(0.0)


def ward_candidates(places: DataFrame, wards: DataFrame) -> DataFrame:
    """(place_id, query, ward columns, match_score) of the wards whose name scores."""
    met = containments(places, wards.select(F.col("normalized_name").alias("name"))).withColumnRenamed("name", "_name")
    found = places.join(met, "query").join(wards, F.col("_name") == wards["normalized_name"]).drop("_name")
    return found.withColumn("match_score", name_score(F.col("normalized_name"), F.col("query")))


def area_candidates(places: DataFrame, wards: DataFrame) -> DataFrame:
    """As ward_candidates for zone, corporation and assembly: 0.7 equal, 0.55 containment; the last matching field is named."""
    fields = ["zone", "corporation", "assembly_constituency"]
    keyed = wards.withColumn("_areas", F.to_json(F.struct(*fields)))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("field"), F.col(c).alias("area"), normalize_name(F.col(c)).alias("name")) for i, c in enumerate(fields))))
    areas = keyed.select("_areas", *fields).distinct().select("_areas", each.alias("a")).select("_areas", "a.*")
    met = containments(places, areas.select("name"))
    score = F.when(F.col("name") == F.col("query"), 0.7).otherwise(0.55)
    best = areas.join(met, "name").groupBy("query", "_areas").agg(F.max(score).alias("match_score"), F.max_by("area", "field").alias("matched_area"))
    return places.join(best, "query").join(keyed, "_areas").drop("_areas")


def mapped_candidates(places: DataFrame, mappings: DataFrame, wards: DataFrame) -> DataFrame:
    """Old wards that a mapping gives for a query equal to its new name; without such a ward, one made from the mapping."""
    old = wards.where("version = 'old_bbmp' AND ward_number <> ''").groupBy("ward_number").agg(F.max_by(F.struct("ward_key", "ward_name", "normalized_name"), "seq").alias("w"))
    named = mappings.withColumns({"new_name": normalize_name(F.col("new_ward_name")), "old_name": normalize_name(F.col("old_ward_name"))})
    hits = places.where("query <> ''").join(named, F.col("query") == F.col("new_name")).where("trim(old_ward_number) <> '' OR trim(old_ward_name) <> ''")
    joined = hits.join(old, hits["old_ward_number"] == old["ward_number"], "left")
    return joined.select(
        "place_id", "query", F.col("old_ward_number").alias("ward_number"), F.coalesce("w.ward_key", F.concat(F.lit("old:"), "old_ward_number")).alias("ward_key"),
        F.coalesce("w.ward_name", "old_ward_name").alias("ward_name"), F.coalesce("w.normalized_name", "old_name").alias("normalized_name"), F.col("confidence").alias("match_score"),
    )


def merged_old_candidates(own: DataFrame, mapped: DataFrame) -> DataFrame:
    """own old-ward candidates and the mapped ones whose number and name are not among them."""
    keys = ["place_id", "ward_number", "ward_name"]
    columns = ["place_id", "query", "ward_key", "ward_number", "ward_name", "normalized_name", "match_score"]
    new = mapped.join(own.select(*keys), keys, "left_anti")
    return own.select(*columns).unionByName(new.select(*columns).dropDuplicates(keys))


def ranked_candidates(candidates: DataFrame, limit: int) -> DataFrame:
    """Best score first, then name; `limit` of a place."""
    order = Window.partitionBy("place_id").orderBy(F.col("match_score").desc(), "ward_name", "ward_key")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def relevant_names(places: DataFrame, wards: DataFrame, mappings: DataFrame) -> DataFrame:
    """Distinct (place_id, name): the query, all candidates' names, and both names of mappings that hold it."""
    asked = places.where("query <> ''").select("place_id", "query")
    both = mappings.select(normalize_name(F.col("old_ward_name")).alias("o"), normalize_name(F.col("new_ward_name")).alias("n"))
    sides = asked.join(dictionary(both.select(F.explode(F.array_distinct(F.array("o", "n"))).alias("query"), "o", "n")), "query")
    parts = [
        asked.select("place_id", F.col("query").alias("name")),
        ward_candidates(asked, wards).select("place_id", F.col("normalized_name").alias("name")),
        area_candidates(asked, wards).select("place_id", F.col("normalized_name").alias("name")),
        mapped_candidates(asked, mappings, wards).select("place_id", F.col("normalized_name").alias("name")),
        sides.select("place_id", F.explode(F.array("o", "n")).alias("name")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def place_complaints(names: DataFrame, complaints: DataFrame) -> DataFrame:
    """The complaints of each place: those whose ward name is one of its names."""
    return complaints.join(dictionary(names), complaints["normalized_ward_name"] == names["name"]).drop("name")


def complaint_classes(complaints: DataFrame) -> DataFrame:
    """Complaints that no total can tell apart as one row: their number (copies), first seq, latest grievance_date, first and last day.

    Totals of places read these, so what is matched and stored does not grow with copies of a place's complaints.
    """
    day = F.when(F.trim("grievance_date") != "", F.trim("grievance_date"))
    return complaints.groupBy("normalized_ward_name", "year", "issue_category", "issue_subcategory", "status", "source_id").agg(
        F.count(F.lit(1)).alias("copies"), F.min("seq").alias("seq"), F.max("grievance_date").alias("grievance_date"), F.min(day).alias("day_min"), F.max(day).alias("day_max")
    )


def complaint_count(rows: DataFrame) -> Column:
    """The number of complaints among rows, which are complaints or complaint_classes."""
    return F.sum("copies") if "copies" in rows.columns else F.count(F.lit(1))


def in_years(year: Column, first: Column, last: Column) -> Column:
    """Inclusive bounds, either may be null; with a bound set a null year fails."""
    unbounded = first.isNull() & last.isNull()
    return unbounded | (year.isNotNull() & (first.isNull() | (year >= first)) & (last.isNull() | (year <= last)))


def with_lenses(matched: DataFrame, lenses=LENSES) -> DataFrame:
    """matched rows once for each lens that holds their year; a null bound is open, first over last is an error."""
    for label, first, last in lenses:
        if first is not None and last is not None and first > last:
            raise ValueError(f"{label}: the first year must not be after the last")
    kept = [F.when(in_years(F.col("year"), F.lit(a).cast("int"), F.lit(b).cast("int")), F.lit(label)) for label, a, b in lenses]
    return matched.withColumn("lens", F.explode(F.filter(F.array(*kept), lambda x: x.isNotNull())))


def counters(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, value, n, rank: counts of a column's values, blank ones left out; largest first, then first seen (seq)."""
    counted = rows.where(F.col(column).isNotNull() & (F.col(column).cast("string") != "")).groupBy(*keys, F.col(column).cast("string").alias("value")).agg(complaint_count(rows).alias("n"), F.min("seq").alias("_seen"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), "_seen"))).drop("_seen")


def top_categories(rows: DataFrame, keys: list[str], limit: int = 10) -> DataFrame:
    return counters(rows, keys, "issue_category").where(F.col("rank") <= limit)


def first_examples(rows: DataFrame, keys: list[str], limit: int = 3) -> DataFrame:
    """The first rows of each (keys, category) in order of seq.

    Each task keeps its own first rows before the shuffle (Spark's group limit).
    """
    order = Window.partitionBy(*keys, "issue_category").orderBy("seq")
    return rows.where("issue_category <> ''").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def leading_examples(complaints: DataFrame, limit: int = 3) -> DataFrame:
    """The complaints that can be among first_examples of any place and lens: the first of each ward name, year and category."""
    return first_examples(complaints, ["normalized_ward_name", "year"], limit).drop("rank")


def record_scope(matched: DataFrame, keys: list[str]) -> DataFrame:
    """Year and date range of all matches, before any year filter, with a note on freshness."""
    day = F.when(F.trim("grievance_date") != "", F.trim("grievance_date"))
    first, last = ("day_min", "day_max") if "day_min" in matched.columns else (day, day)
    out = matched.groupBy(*keys).agg(F.min("year").alias("year_min"), F.max("year").alias("year_max"), F.min(first).alias("date_min"), F.max(last).alias("date_max"))
    known = F.concat(F.lit("BBMP grievance records available through "), "date_max", F.lit("."))
    return out.withColumn("freshness_note", F.concat(F.coalesce(known, F.lit("BBMP grievance record freshness is unavailable.")), F.lit(" Not a live complaint dashboard.")))


def lens_label(label: Column, first: Column, last: Column) -> Column:
    a, b = first.cast("string"), last.cast("string")
    return (
        F.when(F.trim(label) != "", F.trim(label)).when(first.isNull() & last.isNull(), "All years").when(first == last, F.concat(a, F.lit(" only")))
        .when(first.isNull(), F.concat(F.lit("Through "), b)).when(last.isNull(), F.concat(F.lit("From "), a)).otherwise(F.concat(a, F.lit("-"), b))
    )


def truth_cells(places: DataFrame, lensed: DataFrame, lenses=LENSES) -> DataFrame:
    """(place_id, lens, complaints, latest) of lensed rows (place_id, lens, grievance_date); empty cells are there."""
    cells = lensed.groupBy("place_id", "lens").agg(complaint_count(lensed).alias("complaints"), F.max("grievance_date").alias("latest"))
    grid = places.select("place_id", F.explode(F.array(*(F.lit(x[0]) for x in lenses))).alias("lens"))
    return grid.join(cells, ["place_id", "lens"], "left").withColumn("complaints", F.coalesce("complaints", F.lit(0)))


def truth_grid(places: DataFrame, wards: DataFrame, mappings: DataFrame, complaints: DataFrame, lenses=LENSES) -> DataFrame:
    """(place_id, lens, complaints, latest): one scan of the complaints for all places and lenses."""
    matched = place_complaints(relevant_names(places, wards, mappings), complaints.select("normalized_ward_name", "year", "grievance_date"))
    return truth_cells(places, with_lenses(matched, lenses), lenses)


def identical_summaries(cells: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(digest, places): keys that share all of the columns, by hash; only groups of several."""
    digest = F.sha2(F.to_json(F.struct(*columns)), 256)
    return cells.groupBy(digest.alias("digest")).agg(F.array_sort(F.collect_set(key)).alias("places")).where(F.size("places") > 1)


def known_gaps(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """(gap, n): gap sentences of empty truth cells and of sources that aren't usable, sorted distinct with counts."""
    empty = cells.where("complaints = 0").select(F.concat(F.lit("No grievance rows for lens "), "lens", F.lit(".")).alias("gap"))
    unusable = sources.where("monitor_status <> 'usable'").select(F.concat(F.lit("Source status "), "monitor_status", F.lit(".")).alias("gap"))
    return empty.unionByName(unusable).groupBy("gap").agg(F.count(F.lit(1)).alias("n"))


def dossier_facts(matched: DataFrame, key: str = "place_id") -> DataFrame:
    """Per place: top three categories, peak year (the first largest), whether any is closed, first three distinct subcategories."""
    tops = counters(matched, [key], "issue_category").where("rank <= 3").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]), ", ").alias("top_categories"))
    years = matched.where("year IS NOT NULL").groupBy(key, "year").agg(complaint_count(matched).alias("n")).groupBy(key).agg(F.max_by("year", F.struct("n", -F.col("year"))).alias("peak_year"))
    closed = matched.groupBy(key).agg(F.bool_or(F.col("status").isin("F", "Closed")).alias("has_closed"))
    seen = matched.where("issue_subcategory <> ''").groupBy(key, "issue_subcategory").agg(F.min("seq").alias("s"))
    examples = seen.groupBy(key).agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("s", "issue_subcategory"))), 1, 3), lambda x: x["issue_subcategory"]), ", ").alias("subcategories"))
    return closed.join(tops, key, "left").join(years, key, "left").join(examples, key, "left")


def used_sources(cells: DataFrame, citations: str = "source_ids") -> DataFrame:
    return cells.select(F.explode(citations).alias("source_id")).distinct()


def excluded_sources(registry: DataFrame, used: DataFrame) -> DataFrame:
    return registry.join(used, registry["id"] == used["source_id"], "left_anti")


def search_entries(places: DataFrame, sources: DataFrame) -> DataFrame:
    """(kind, id, title, keywords) of places (place_id, query, names) and sources (id, name, focus, keywords)."""
    words = lambda c: F.array_sort(F.array_distinct(c))
    one = places.select(F.lit("place").alias("kind"), F.col("place_id").cast("string").alias("id"), F.initcap("query").alias("title"), words(F.col("names")).alias("keywords"))
    two = sources.select(F.lit("source").alias("kind"), "id", F.col("name").alias("title"), words(F.col("keywords")).alias("keywords"))
    return one.unionByName(two)


def claim_cards(cells: DataFrame) -> DataFrame:
    """cells (place_id, lens, complaints, latest, citations) with claims: one or two structs of text, kind and up to five or three distinct citations."""
    cited = lambda n: F.slice(F.array_distinct("citations"), 1, n)
    memory = F.struct(F.concat(F.col("complaints").cast("string"), F.lit(" complaint rows matched.")).alias("text"), F.lit("complaint_memory").alias("kind"), cited(5).alias("citations"))
    limit = F.struct(F.concat(F.lit("Records run through "), F.coalesce("latest", F.lit("an unknown date")), F.lit(".")).alias("text"), F.lit("limit").alias("kind"), cited(3).alias("citations"))
    return cells.withColumn("claims", F.when(F.col("complaints") > 0, F.array(memory, limit)).otherwise(F.array(limit)))
