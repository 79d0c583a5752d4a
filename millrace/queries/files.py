"""Queries of scans, sinks, pages and streams: tables are written to the shared folder as files and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs
from ..functions import values as V
from ..sources import scans, sinks
from ..storage import folder
from ..streaming import streams
from .common import norm, query, table


def _place(spark) -> str:
    return f"{folder(spark)}/millrace/{uuid.uuid4().hex}"


def _written(spark, d) -> str:
    """Documents as JSON lines; every seventh line isn't JSON."""
    at = _place(spark)
    rows = table(spark, d, "documents").select(F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("not json "), F.col("doc_id").cast("string"))).otherwise(F.to_json(F.struct("doc_id", "source", F.length("text").alias("n")))).alias("value"))
    rows.coalesce(1).write.text(at)
    return at


@query("select count(*) lines, sum(case when doc_id % 7 = 0 then 1 else 0 end)::bigint malformed, sum(case when doc_id % 7 = 0 then 0 else length(text) end)::bigint chars, count(*)::bigint last_line from documents having count(*) > 0")
def line_scan(spark, d):
    """JSON lines with numbers; a bad one stops nothing."""
    rows = scans.json_lines(spark, _written(spark, d))
    return rows.agg(F.count("*").alias("lines"), F.count("parse_error").alias("malformed"), F.sum(F.try_variant_get("record", "$.n", "long")).alias("chars"), F.max("line_no").alias("last_line")).filter("lines > 0")


@query("select least(30, greatest(0, count(*) - 20))::bigint n, (min(21)::bigint) first_line, least(50, count(*))::bigint last_line from documents having count(*) > 20")
def line_window(spark, d):
    rows = scans.window_of(scans.text_lines(spark, _written(spark, d)), 20, 30)
    return rows.agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")).filter("n > 0")


@query("select doc_id, source, n_chars from documents")
def parquet_scan(spark, d):
    """A scan whose path names the format; rows as JSON."""
    rows = scans.input_records(spark, f"{d}/documents.parquet")
    get = lambda k, t: F.try_variant_get("record", f"$.{k}", t)
    return rows.select(get("doc_id", "long").alias("doc_id"), get("source", "string").alias("source"), get("n_chars", "long").alias("n_chars"))


@query("with t as (select id, messages[1].content instruction, messages[2].content response from (select * from records where id is not null qualify row_number() over (partition by id order by prepared_at) = 1)) select * from t where instruction is not null and response is not null")
def message_pair_scan(spark, d):
    """The first two contents of records written as JSON lines."""
    at = _place(spark)
    rows = table(spark, d, "records").filter("id is not null").dropDuplicates(["id"]).select("id", "messages")
    sinks.write_json_lines(rows, at)
    return scans.message_pairs(scans.json_lines(spark, at))


@query("select count(*) records from (select distinct id from records where id is not null and messages is not null)")
def package_scan(spark, d):
    """A package's records, its sample aside."""
    at = _place(spark)
    rows = table(spark, d, "records").filter("id is not null").dropDuplicates(["id"]).select("id", "messages")
    sinks.write_json_lines(rows.coalesce(1), f"{at}/raw")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.globStatus(hadoop.Path(f"{at}/raw/part-*")) or []:
        fs.rename(f.getPath(), hadoop.Path(f"{at}/full-0.1.jsonl"))
    return scans.package_lines(spark, at).agg(F.count("*").alias("records"))


@query(r"select doc_id, i as line_no, l as line from (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) i, unnest(string_split(text, chr(10))) l from documents where text is not null) where regexp_matches(l, '(?i)error')")
def found_lines(spark, d):
    """Lines of all documents that match a pattern."""
    files = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("uri"), "text")
    return scans.found_lines(files, "(?i)error").select(F.col("uri").alias("doc_id"), F.col("line_no").cast("bigint").alias("line_no"), "line")


@query("select distinct uri from fetched_pages where uri is not null and regexp_matches(string_split(uri, '/')[-1], '^.*e.*$') order by uri limit 200")
def listed_files(spark, d):
    files = table(spark, d, "fetched_pages").select("uri").filter("uri is not null").distinct()
    return scans.listed(files, "*e*")


@query("select regexp_replace(uri, '/[^/]*$', '') folder, count(*) files, sum(bytes)::bigint bytes from (select uri, max(bytes_read) bytes from fetched_pages where uri is not null group by 1) group by 1")
def folder_sizes(spark, d):
    return scans.folder_size(table(spark, d, "fetched_pages").filter("uri is not null").groupBy("uri").agg(F.max("bytes_read").alias("bytes")))


@query("""
with m as (select distinct conversation_id, id, created_at from messages where conversation_id is not null) select conversation_id, id from m order by conversation_id, created_at, id limit 100""")
def transcript_page(spark, d):
    rows = table(spark, d, "messages").filter("conversation_id is not null").select("conversation_id", "id", "created_at").distinct()
    return scans.transcript_rows(rows, 100).select("conversation_id", "id")


@query("select id, '{\"id\":\"' || id || '\",\"n\":' || n || '}' line from (select id, count(*) n from messages where id is not null and not regexp_matches(id, '[\"\\\\]') group by 1)")
def canonical_lines(spark, d):
    """Rows written as canonical JSON lines and read as text."""
    at = _place(spark)
    rows = table(spark, d, "messages").filter("id is not null").groupBy("id").agg(F.count("*").alias("n"))
    sinks.write_json_lines(rows.select("n", "id"), at)
    return scans.text_lines(spark, at).select(F.try_variant_get(F.try_parse_json("line"), "$.id", "string").alias("id"), "line")


@query("select 'check' stage, counter, count(*) n from (select unnest(list_filter(['records_seen', case when lang is null then 'rejected' else 'accepted' end, case when lang is null then 'reason_no_language' end], lambda x: x is not null)) counter from documents) group by 2")
def stage_report(spark, d):
    rows = table(spark, d, "documents").select(F.when(F.col("lang").isNull(), "no_language").alias("reason"))
    return sinks.report(rows, "check", "reason")


@query("select count_if(lang is not null) accepted, count_if(lang is null) rejected from documents having count(*) > 0")
def accepted_and_rejected(spark, d):
    """Rows written apart by a reason."""
    at = _place(spark)
    sinks.write_accepted(table(spark, d, "documents").select("doc_id", F.when(F.col("lang").isNull(), "no_language").alias("why")), "why", at)
    part = lambda n, schema: spark.read.schema(schema).parquet(f"{at}/{n}").agg(F.count("*").alias(n))
    return part("accepted", "doc_id long").join(part("rejected", "doc_id long")).filter("accepted + rejected > 0")  # one row each


@query("select coalesce(lang, '(null)') lang, count(*) n from documents group by 1")
def written_parts(spark, d):
    """Parts in folders by value, read again."""
    at = _place(spark)
    sinks.write_parts(table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("(null)")).alias("lang")), at, "lang")
    return spark.read.schema("doc_id long, lang string").parquet(at).groupBy("lang").agg(F.count("*").alias("n"))


# Pages as HTML: made of their lines


def _html(spark, d):
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "[<>&]", " "), "\n")
    body = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "<script>no();</script>")
    link = F.concat(F.lit("<a href='/next#top'>n</a><a href='mailto:x'>m</a><a href='https://other.example/x'>o</a><a href='"), F.coalesce("uri", F.lit("")), F.lit("'>u</a>"))
    return table(spark, d, "fetched_pages").select("fetch_id", "uri", F.regexp_replace(F.coalesce("title", F.lit("")), "[<>&]", " ").alias("title"), "text", F.concat(F.lit("<html><title>"), F.regexp_replace(F.coalesce("title", F.lit("")), "[<>&]", " "), F.lit("</title>"), body, link, F.lit("</html>")).alias("html")).distinct()


_PY = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(f"""
with p as (select distinct fetch_id, regexp_replace(coalesce(title, ''), '[<>&]', ' ', 'g') title, regexp_replace(coalesce(text, ''), '[<>&]', ' ', 'g') t from fetched_pages),
l as (select fetch_id, title, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^{_PY}+|{_PY}+$', '', 'g')), lambda x: x <> '') x from p)
select fetch_id, regexp_replace(title, '^{_PY}+|{_PY}+$', '', 'g') title, array_to_string(list_concat(x, ['n', 'm', 'o', 'u']), chr(10)) body from l""")
def html_texts(spark, d):
    """Text and title of pages written as HTML, scripts left out."""
    return _html(spark, d).select("fetch_id", udfs.html_text("html").alias("t")).select("fetch_id", "t.title", F.col("t.text").alias("body"))


@query()
def html_links(spark, d):
    """Links of pages to their own host."""
    return _html(spark, d).filter("uri is not null").select("fetch_id", F.explode(udfs.html_links("html", "uri")).alias("link"))


@query("select distinct fetch_id, regexp_replace('<b>' || coalesce(text, '') || '</b><br/>', '<[^>]+>', '', 'g') bare from fetched_pages")
def stripped_tags(spark, d):
    marked = F.concat(F.lit("<b>"), F.coalesce("text", F.lit("")), F.lit("</b><br/>"))
    return table(spark, d, "fetched_pages").select("fetch_id", T.without_tags(marked).alias("bare")).distinct()


@query("select id, case when metadata is null then 'input must have type object' when json_type(metadata) <> 'OBJECT' then 'input must have type object' when not list_contains(json_keys(metadata), 'client') and not list_contains(json_keys(metadata), 'topic') then 'checked' else 'checked' end outcome from (select distinct id, metadata from conversations where metadata is null or json_valid(metadata))")
def metadata_types(spark, d):
    """Whether metadata is a JSON object, by a schema."""
    rows = table(spark, d, "conversations").select("id", "metadata").distinct().withColumn("v", F.try_parse_json("metadata")).filter("metadata is null or v is not null")
    return rows.select("id", F.coalesce(V.schema_problem(F.col("v"), {"type": "object"}), F.lit("checked")).alias("outcome"))


# Streams


@query(f"select count(*) texts from (select distinct {norm('line')} from (select unnest(string_split(text, chr(10))) line from documents where text is not null))")
def stream_new_texts(spark, d):
    """Lines of documents read as a stream in several files and deduplicated across batches."""
    at = _place(spark)
    lines = table(spark, d, "documents").filter("text is not null").select(F.explode(F.split("text", "\n")).alias("value"))
    lines.repartition(4).write.parquet(f"{at}/in")
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    streams.new_texts(stream, "value", f"{at}/kept", f"{at}/state", buckets=4)
    return spark.read.schema("value string, text_hash string, bucket int, batch int").parquet(f"{at}/kept").agg(F.count_distinct("text_hash").alias("texts"))


@query("select time_bucket(interval '1 hour', ts) window_start, event_type, count(*) events, round(sum(value), 4) total from events group by 1, 2")
def event_windows(spark, d):
    return streams.tumbling(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("""
with l as (select user_id, ts, ts - lag(ts) over (partition by user_id order by ts) gap from events), s as (select user_id, ts, sum(case when gap < interval '30 minutes' then 0 else 1 end) over (partition by user_id order by ts rows unbounded preceding) n from l)
select user_id, min(ts) session_start, max(ts) + interval '30 minutes' session_end, count(*) events from s group by user_id, n""")
def event_sessions(spark, d):
    return streams.sessions(table(spark, d, "events"))
