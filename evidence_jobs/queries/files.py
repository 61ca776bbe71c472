"""Queries of the readers and writers: rows of the tables are written as files of a kind and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_jobs.queries.registry import query
from evidence_jobs.sources import readers, writers
from evidence_jobs.sources.stored import shared_folder


def new_folder(d, name: str) -> str:
    return f"{shared_folder(d.spark)}/evidence_jobs/{name}-{uuid.uuid4().hex}"


def documents_of(rows: DataFrame, path: str) -> str:
    """One file for each row of a single text column."""
    rows.write.option("maxRecordsPerFile", 1).text(path)
    return path


@query("src04_csv_rows", "SELECT doc_id, md5(coalesce(text, '')) AS digest, coalesce(source, '') AS source, true AS exact FROM documents")
def _(d):
    # A row's index in its task is its index in the file that the task writes; the header is row 1.
    path = new_folder(d, "csv")
    rows = d.documents.select("doc_id", "text", "source", (F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 2).alias("n"))
    rows.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    cell = F.col("row")
    return readers.read_csv_rows(d.spark, path).select(cell["doc_id"].cast("long").alias("doc_id"), F.md5(cell["text"].cast("binary")).alias("digest"), cell["source"].alias("source"), (cell["n"].cast("long") == F.col("row_number")).alias("exact"))


@query("agg12_file_facts", "SELECT 'doc_id|source|n_chars' AS header, count(*) AS rows, sum(CAST(doc_id AS BIGINT)) AS total FROM documents")
def _(d):
    path = new_folder(d, "csv")
    d.documents.select("doc_id", "source", "n_chars").write.options(header=True, quoteAll=True, escape='"').csv(path)
    facts = readers.file_facts(d.spark, path).where("header <> ''").groupBy("header").agg(F.sum("rows").alias("rows"))
    header = F.array_join(F.array_sort(F.map_keys("row")), "|")
    totals = readers.read_csv_rows(d.spark, path).groupBy(header.alias("columns")).agg(F.sum(F.col("row")["doc_id"].cast("long")).alias("total"))
    # The row's map has its columns in no order; the header's cells are sorted to meet it.
    sorted_cells = F.array_join(F.array_sort(F.split("header", r"\|")), "|")
    return facts.withColumn("columns", sorted_cells).join(totals, "columns").select("header", "rows", "total")


@query("src05_entities", "SELECT ward_key, ward_number, ward_name, CAST(seq AS BIGINT) AS seq FROM {wards}")
def _(d):
    rows = d.wards.groupBy("version").agg(F.to_json(F.collect_list(F.struct("ward_key", "ward_number", "ward_name", "seq"))).alias("value"))
    return readers.read_entities(d.spark, documents_of(rows.select("value"), new_folder(d, "entities")), "ward_key string, ward_number string, ward_name string, seq long")


@query("src05_absent", "SELECT ward_key FROM {wards} WHERE false")
def _(d):
    return readers.read_entities(d.spark, new_folder(d, "absent"), "ward_key string").unionByName(d.wards.where("ward_key IS NULL").select("ward_key"))


@query("src06_suite", "SELECT case_id, query FROM {cases}")
def _(d):
    path = new_folder(d, "suite")
    d.cases.select("case_id", "query").write.json(path)
    return readers.read_suite(d.spark, path, "case_id long, query string")


RING = "concat_ws(' ', concat(x, ',', y), concat(x + 1, ',', y, ',0'), 'bad', concat(x + 1, ',', y + 1), concat(x, ',', y + 1))"


@query("src07_kml", "SELECT CAST(s_suppkey AS VARCHAR) AS ward_number, s_name AS ward_name, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS normalized_name, 1 + CAST(s_suppkey % 2 AS INTEGER) AS polygons, 5 AS points, CAST(s_nationkey AS DOUBLE) AS x FROM supplier")
def _(d):
    placed = d.supplier.withColumns({"x": F.col("s_nationkey").cast("int"), "y": F.col("s_suppkey").cast("int")})
    polygon = F.concat(F.lit("<Polygon><outerBoundaryIs><LinearRing><coordinates>"), F.expr(RING), F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon>"))
    shape = F.when(F.col("s_suppkey") % 2 == 1, F.concat(F.lit("<MultiGeometry>"), polygon, polygon, F.lit("</MultiGeometry>"))).otherwise(polygon)
    # A file for each nation.
    mark = F.concat(F.lit("<Placemark><name>"), "s_suppkey", F.lit(" - "), "s_name", F.lit("</name>"), shape, F.lit("</Placemark>"))
    files = placed.groupBy("s_nationkey").agg(F.concat(F.lit("<kml><Document>"), F.array_join(F.collect_list(mark), ""), F.lit("</Document></kml>")).alias("value"))
    path = documents_of(files.select("value"), new_folder(d, "kml"))
    shape = F.col("shape")
    return readers.read_kml(d.spark, path).select("ward_number", "ward_name", "normalized_name", F.size(shape).alias("polygons"), F.size(shape[0][0]).alias("points"), shape[0][0][0][0].alias("x"))


@query("src08_geojson", "SELECT s_name AS name, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS feature_idx, 4 AS points, CAST(s_suppkey AS DOUBLE) AS y FROM supplier WHERE s_suppkey % 7 <> 0")
def _(d):
    # A file for each nation; features without geometry keep their number to themselves.
    corner = lambda x, y: F.array((F.col("s_nationkey") + x).cast("double"), (F.col("s_suppkey") + y).cast("double"))
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 0))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    feature = F.struct("s_suppkey", F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(F.col("s_name").alias("name")).alias("properties"))
    files = d.supplier.where("s_suppkey % 7 <> 0").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(feature)).alias("features"))
    path = documents_of(files.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features"))), new_folder(d, "geojson"))
    shape = F.col("shape")
    return readers.read_geojson(d.spark, path, "name:string").select("name", "feature_idx", F.size(shape[0][0]).alias("points"), shape[0][0][0][1].alias("y"))


@query("src08_feature_stream", "SELECT doc_id, md5(coalesce(text, '')) AS digest, source, 1 AS polygons, CAST(coalesce(n_chars, 0) AS DOUBLE) AS x FROM documents")
def _(d):
    # 64 collections of all documents, each by one task, line by line; an empty element before the first feature spares its comma.
    corner = lambda x, y: F.array((F.coalesce("n_chars", F.lit(0)) + x).cast("double"), F.lit(y).cast("double"))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 0))).alias("coordinates"))
    feature = F.concat(F.lit(","), F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("doc_id", "text", "source").alias("properties"), geometry.alias("geometry"))))
    rows = d.documents.select(F.pmod(F.hash("doc_id"), F.lit(64)).alias("file"), F.lit(1).alias("line"), feature.alias("value"))
    ends = rows.select("file").distinct().select("file", F.explode(F.expr("map(0, '{\"type\":\"FeatureCollection\",\"features\":[null', 2, ']}')")).alias("line", "value"))
    path = new_folder(d, "features")
    rows.unionByName(ends).repartition("file").sortWithinPartitions("file", "line").drop("line").write.partitionBy("file").text(path)
    read = readers.read_geojson(d.spark, f"{path}/*", "doc_id:bigint, text:string, source:string")
    shape = F.col("shape")
    return read.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), "source", F.size(shape).alias("polygons"), shape[0][0][0][0].alias("x"))


@query("src10_trace_log", "SELECT CAST(event_id AS BIGINT) AS seq, event_type, 'mail [REDACTED_EMAIL]' AS note FROM events")
def _(d):
    path = new_folder(d, "traces")
    event = d.events.select(F.col("event_id").cast("long").alias("seq"), "event_type", F.concat(F.lit("mail u"), "user_id", F.lit("@example.com")).alias("note"))
    writers.append_trace(event.where("seq % 2 = 0"), path)
    writers.append_trace(event.where("seq % 2 <> 0"), path)
    return readers.read_trace_log(d.spark, path, "seq long, event_type string, note string")


@query("snk01_entity", "SELECT 'kept' AS part, external_complaint_id AS id, status FROM {complaints} WHERE status <> '' UNION ALL SELECT 'rejected', external_complaint_id, status FROM {complaints} WHERE status = ''")
def _(d):
    path = new_folder(d, "entity")
    rows = d.complaints.select(F.col("external_complaint_id").alias("id"), "status")
    writers.write_entity(rows.where("status <> ''"), rows.where("status = ''"), path, ["id"])
    read = lambda where, part: d.spark.read.parquet(where).select(F.lit(part).alias("part"), "id", "status")
    return read(path, "kept").unionByName(read(f"{path}_rejections", "rejected"))


@query("snk02_export", "SELECT 'complaints' AS \"table\", count(*) AS row_count FROM {complaints} UNION ALL SELECT 'wards', count(*) FROM {wards} UNION ALL SELECT 'old_new_ward_mappings', count(*) FROM {mappings} UNION ALL SELECT 'issue_categories', count(DISTINCT issue_category) FROM {complaints}")
def _(d):
    categories = d.complaints.select(F.col("issue_category").alias("name")).distinct()
    return writers.export_tables({"wards": d.wards, "old_new_ward_mappings": d.mappings, "complaints": d.complaints, "issue_categories": categories}, new_folder(d, "export"))


@query("snk02_export_rows", "SELECT external_complaint_id, issue_category, grievance_date, year, staff_remarks, '{\"raw_file\":\"' || raw_file || '\",\"row_number\":' || row_number || '}' AS evidence_json FROM {complaints}")
def _(d):
    none = d.spark.createDataFrame([], "x string")
    path = new_folder(d, "export")
    writers.export_tables({"wards": none, "old_new_ward_mappings": none, "issue_categories": none, "complaints": d.complaints.withColumn("evidence", F.struct("raw_file", "row_number"))}, path)
    columns = ", ".join(f"{c} {'int' if c == 'year' else 'string'}" for c in writers.EXPORTS["complaints"])
    back = d.spark.read.schema(columns).option("header", True).option("escape", '"').csv(f"{path}/complaints")
    return back.select("external_complaint_id", "issue_category", "grievance_date", "year", "staff_remarks", "evidence_json")
