"""Queries of the core operators over the tables of a directory, with their SQL for DuckDB.

A query without SQL uses what SQL can't express or can't do on whole tables in
reasonable time; it is tested against brute force on small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import corpus, ranking, retrieval
from .common import UNIT, norm, query, table

@query(f"""
with s as (select {UNIT.format("doc_id::varchar")} u, n_chars from documents)
select case when u < 0.8 then 'train' when u < 0.9 then 'validation' else 'test' end part, count(*) documents, sum(n_chars)::bigint chars from s group by 1""")
def hash_split_counts(spark, d):
    rows = table(spark, d, "documents").select(V.hash_split("doc_id").alias("part"), "n_chars")
    return rows.groupBy("part").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@query("""
with s as (select ('0x' || substr(sha256('20260926:' || doc_id::varchar), 1, 2))::UBIGINT / 255.0 u from documents)
select case when u < 0.05 then 'validation' when u < 0.1 then 'test' else 'train' end part, count(*) documents from s group by 1""")
def seeded_split_counts(spark, d):
    return table(spark, d, "documents").select(V.seeded_split("doc_id").alias("part")).groupBy("part").agg(F.count("*").alias("documents"))


@query(f"""
with k as (select doc_id, sha256(coalesce(text, '')) e, sha256({norm("coalesce(text, '')")}) n from documents),
f as (select *, first_value(doc_id) over w fd, first_value(e) over w fe from k window w as (partition by n order by doc_id))
select doc_id, case when doc_id = fd then null when e = fe then 'exact_duplicate' else 'normalized_duplicate' end reason from f""")
def dedup_reasons(spark, d):
    return corpus.keep_first(table(spark, d, "documents"), "text", "doc_id").select("doc_id", "reason")


_AT = "(case when regexp_matches(created_at, '(Z|z|[+-][0-9]{2}:?[0-9]{2})$') then created_at else created_at || 'Z' end)::timestamptz"


_CHUNKS = "(select chunk_id, document_id, max(text) as text from memory_chunks group by 1, 2)"


def _chunks(spark, d) -> DataFrame:
    return table(spark, d, "memory_chunks").groupBy("chunk_id", "document_id").agg(F.max("text").alias("text"))


def _words():
    """Simple words, which SQL can find too."""
    return F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"))


@query(f"select count(distinct document_id) documents, count(*) chunks, sum(greatest(1, length(text) // 4))::bigint tokens, round(avg(greatest(1, length(text) // 4)), 6) mean_tokens from {_CHUNKS}")
def index_stats(spark, d):
    return retrieval.index_stats(_chunks(spark, d))


@query(f"""
with p as (select chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) term from {_CHUNKS}), f as (select term, chunk_id, count(*) tf from p group by 1, 2)
select term, count(*) df, sum(tf)::bigint occurrences from f group by 1""")
def term_frequencies(spark, d):
    return retrieval.postings(_chunks(spark, d), _words(), F.array).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


#: Terms of two queries; whole words that chunks have.
_QUERY = (("q1", "ledger"), ("q1", "replay"), ("q1", "shard"), ("q2", "policy"), ("q2", "boundary"))
_VALUES = ", ".join(f"('{q}', '{t}')" for q, t in _QUERY)


@query(f"""
with c as {_CHUNKS}, q(query_id, term) as (values {_VALUES}), p as (select chunk_id, greatest(1, length(text) // 4) len, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) term from c),
f as (select term, chunk_id, len, count(*) tf from p group by all), n as (select count(*) n, avg(greatest(1, length(text) // 4)) mean from c), df as (select term, count(*) df from f group by 1),
s as (select query_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))) score from f join q using (term) join df using (term), n group by 1, 2)
select query_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank, chunk_id, round(score, 6) score from s qualify rank <= 8""")
def bm25_top(spark, d):
    chunks = _chunks(spark, d)
    scores = retrieval.scored(retrieval.postings(chunks, _words(), F.array), chunks, spark.createDataFrame(_QUERY, "query_id string, term string"))
    return retrieval.best(scores).select("query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id", F.round("score", 6).alias("score"))


@query()
def search_contexts(spark, d):
    """Contexts within a budget for two queries, by the full tokenizer."""
    chunks = _chunks(spark, d)
    wanted = spark.createDataFrame([("q1", "replay the ledger shards"), ("q2", "policy boundaries")], "query_id string, q string").select("query_id", F.explode(T.terms("q")).alias("term"))
    return retrieval.contexts(retrieval.best(retrieval.scored(retrieval.postings(chunks), chunks, wanted)), chunks)


@query()
def search_snippets(spark, d):
    ranked = bm25_top(spark, d).join(_chunks(spark, d).select("chunk_id", "text"), "chunk_id")
    wanted = spark.createDataFrame(_QUERY, "query_id string, term string").groupBy("query_id").agg(F.sort_array(F.collect_list("term")).alias("w"))
    return ranked.join(wanted, "query_id").select("query_id", "chunk_id", retrieval.snippet("text", "w").alias("snippet"))


@query(f"select chunk_id, sha256(text) content_hash, greatest(1, length(text) // 4)::int tokens from {_CHUNKS}")
def chunk_hashes(spark, d):
    return _chunks(spark, d).select("chunk_id", T.content_hash("text").alias("content_hash"), T.token_estimate("text").alias("tokens"))


@query(f"select document_id, list_sort(list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z0-9]+'))))) words from {_CHUNKS} group by 1")
def document_words(spark, d):
    """The different simple words of every document."""
    rows = _chunks(spark, d).select("document_id", F.explode(F.array_distinct(_words())).alias("w"))
    return rows.groupBy("document_id").agg(F.array_sort(F.collect_set("w")).alias("words"))


@query(f"select chunk_id, len(list_filter(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_+#.-]*'), lambda w: length(w) between 2 and 40))::int long_words from {_CHUNKS}")
def token_counts(spark, d):
    """Words of 2 to 40 letters that the tokenizer sees in every chunk."""
    return _chunks(spark, d).select("chunk_id", F.size(F.filter(T.raw_tokens("text"), lambda w: F.length(w).between(2, 40))).alias("long_words"))


@query()
def index_terms(spark, d):
    """Index terms by chunks and occurrences, by the full tokenizer."""
    return retrieval.postings(_chunks(spark, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


@query()
def search_messages(spark, d):
    """Contexts of two queries as messages for a model."""
    found = search_contexts(spark, d).select("query_id", F.posexplode("chunks").alias("place", "chunk_id")).join(_chunks(spark, d).select("chunk_id", "text"), "chunk_id")
    joined = found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return joined.select("query_id", retrieval.message("text").alias("m")).select("query_id", "m.role", "m.content")


@query(r"""
with p as (select * from fetched_pages where uri is not null and regexp_replace(coalesce(text, ''), '\s+', '', 'g') <> '')
select uri, max(fetch_id) fetch_id from (select uri, fetch_id, fetched_at, max(fetched_at) over (partition by uri) newest from p) where fetched_at = newest group by 1""")
def replaced_documents(spark, d):
    """The fetch that stands for each address after all upserts: the newest that isn't blank."""
    rows = table(spark, d, "fetched_pages").withColumn("place", F.struct("fetched_at", "fetch_id"))
    return retrieval.replaced(rows, "uri", "text", "place").select("uri", "fetch_id")


@query(f"with gone as (select document_id from memory_documents where title is null) select count(*) chunks, count(distinct document_id) documents, sum(greatest(1, length(text) // 4))::bigint tokens from {_CHUNKS} where document_id not in (select document_id from gone)")
def index_after_deletion(spark, d):
    """The index after documents without a title were deleted with their chunks."""
    gone = table(spark, d, "memory_documents").filter("title is null").select("document_id")
    left = retrieval.without(_chunks(spark, d), "document_id", gone, "document_id")
    return retrieval.index_stats(left).select("chunks", "documents", "tokens")


@query("select document_id, title, added_at from (select distinct document_id, title, added_at from memory_documents) order by added_at desc, document_id limit 20")
def newest_documents(spark, d):
    from ..operators.curation import newest

    return newest(table(spark, d, "memory_documents").select("document_id", "title", "added_at").distinct(), "added_at", "document_id", 20)


@query("select lower(split_part(uri, '/', 3)) host, count(*) filter (where starts_with(lower(uri), 'https://docs')) under, count(*) n from (select distinct uri from fetched_pages where uri is not null) group by 1")
def address_prefixes(spark, d):
    rows = table(spark, d, "fetched_pages").select("uri").filter("uri is not null").distinct()
    return rows.groupBy(F.lower(F.split_part("uri", F.lit("/"), F.lit(3))).alias("host")).agg(F.count_if(V.has_prefix("uri", "HTTPS://docs")).alias("under"), F.count("*").alias("n"))


@query(r"""
with t as (select distinct uri, string_split(uri, '/') p from fetched_pages where uri is not null)
select uri, coalesce(list_filter(p[:-2], lambda x: x not in ('raw', 'staging', 'processed', 'datasets', ''))[-1], regexp_replace(p[-1], '(.)\.[^.]*$', '\1')) subset from t""")
def path_subsets(spark, d):
    return table(spark, d, "fetched_pages").select("uri").filter("uri is not null").distinct().select("uri", V.subset_of("uri").alias("subset"))


@query()
def document_chunks(spark, d):
    rows = retrieval.chunked(table(spark, d, "documents"), "doc_id", "text")
    return rows.groupBy("document_id").agg(F.count("*").alias("chunks"), F.max("token_estimate").alias("longest"))


@query("select uri, document_id, content_hash, added_at from memory_documents where uri is not null qualify row_number() over (partition by uri order by added_at desc, document_id desc, content_hash desc) = 1")
def latest_documents(spark, d):
    return corpus.latest(table(spark, d, "memory_documents").select("uri", "document_id", "content_hash", "added_at"), "uri", "added_at")


@query("select distinct uri from fetched_pages where uri is not null and uri not in (select uri from memory_documents where uri is not null)")
def unknown_pages(spark, d):
    return table(spark, d, "fetched_pages").select("uri").filter("uri is not null").distinct().join(table(spark, d, "memory_documents").select("uri").distinct(), "uri", "left_anti")


@query("""
with p as (select distinct fetch_id, lower(trim(split_part(coalesce(content_type, ''), ';', 1))) t, bytes_read from fetched_pages)
select case when bytes_read <= 0 then 'failed' when t in ('text/html', 'text/plain', 'text/markdown', 'application/xhtml+xml', 'application/json') then 'indexed' else 'refused' end status, count(*) pages from p group by 1""")
def fetch_outcomes(spark, d):
    kind = F.lower(F.trim(F.split_part(F.coalesce("content_type", F.lit("")), F.lit(";"), F.lit(1))))
    rows = table(spark, d, "fetched_pages").select("fetch_id", kind.alias("t"), "bytes_read").distinct()
    status = F.when(F.col("bytes_read") <= 0, "failed").when(F.col("t").isin("text/html", "text/plain", "text/markdown", "application/xhtml+xml", "application/json"), "indexed").otherwise("refused")
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("pages"))


@query("""
with m as (select distinct conversation_id, id from messages), c as (select distinct id from conversations)
select c.id conversation_id, count(m.id) messages, min(m.id) first_id from c left join m on m.conversation_id = c.id group by 1""")
def conversation_sizes(spark, d):
    m = table(spark, d, "messages").select("conversation_id", "id").distinct()
    c = table(spark, d, "conversations").select(F.col("id").alias("conversation_id")).distinct()
    return c.join(m, "conversation_id", "left").groupBy("conversation_id").agg(F.count("id").alias("messages"), F.min("id").alias("first_id"))


@query(f"""
with m as (select conversation_id, id, {_AT} ts from messages group by all)
select conversation_id, id, row_number() over (partition by conversation_id order by ts, id) - 1 turn from m where conversation_id in (select id from conversations)""")
def all_transcripts(spark, d):
    """Turns of all conversations, in order; instants that can't be read come last."""
    at = F.coalesce(F.unix_micros(V.instant("created_at")), F.lit((1 << 62)))
    m = table(spark, d, "messages").select("conversation_id", "id", at.alias("at")).distinct()
    known = table(spark, d, "conversations").select(F.col("id").alias("conversation_id")).distinct()
    # Parts of an hour, so that a hot conversation is numbered by many tasks.
    return ranking.numbers_within(m.join(known, "conversation_id", "left_semi"), ["conversation_id"], "at", "turn", 3_600_000_000, ("id",)).select("conversation_id", "id", "turn")


@query("select signature, count(distinct hash) texts, min(hash) first_hash from near_signatures group by 1")
def signature_index(spark, d):
    return table(spark, d, "near_signatures").groupBy("signature").agg(F.count_distinct("hash").alias("texts"), F.min("hash").alias("first_hash"))


@query("select id, sha256('{\"c\":' || length(id) || ',\"id\":\"' || id || '\"}') hash from (select distinct id from conversations)")
def canonical_hashes(spark, d):
    """Hashes of JSON objects whose keys are out of order and spaced: as SQL writes them in order."""
    rows = table(spark, d, "conversations").select("id").distinct()
    made = F.concat(F.lit('{ "id" : "'), F.col("id"), F.lit('" , "c": '), F.length("id").cast("string"), F.lit(" }"))
    return rows.select("id", V.stable_hash(made).alias("hash"))


@query()
def metadata_value_hashes(spark, d):
    """Hash of the canonical JSON of every metadata value; null where it can't be parsed."""
    return table(spark, d, "conversations").select("metadata").distinct().select("metadata", V.stable_hash("metadata").alias("hash"))


@query(f"""
with d as (select doc_id, coalesce(lang, '(null)') lang, n_chars, sha256({norm("coalesce(text, '')")}) n, {UNIT.format("doc_id::varchar")} u from documents),
k as (select * from d qualify row_number() over (partition by n order by doc_id) = 1)
select case when u < 0.8 then 'train' when u < 0.9 then 'validation' else 'test' end part, lang, count(*) documents, sum(n_chars)::bigint chars from k group by 1, 2""")
def document_flow(spark, d):
    """Documents kept after deduplication, by part and language."""
    kept = corpus.first_of_texts(table(spark, d, "documents"), "text", "doc_id", "lang", "n_chars")
    return kept.groupBy(V.hash_split("doc_id").alias("part"), F.coalesce("lang", F.lit("(null)")).alias("lang")).agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@query(f"select chunk_id, document_id, text from {_CHUNKS} where chunk_id = (select min(chunk_id) from memory_chunks)")
def chunk_lookup(spark, d):
    """One chunk by its id."""
    first = table(spark, d, "memory_chunks").agg(F.min("chunk_id").alias("chunk_id"))  # one row
    return _chunks(spark, d).join(F.broadcast(first), "chunk_id").select("chunk_id", "document_id", "text")


@query(f"""
with h as (select document_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) w from {_CHUNKS}) select document_id, max(len(w))::int most from h group by 1""")
def chunk_vocabularies(spark, d):
    """The largest number of different simple words in one chunk of every document."""
    return _chunks(spark, d).groupBy("document_id").agg(F.max(F.size(F.array_distinct(_words()))).alias("most"))


@query("""
with u as (select host, min(added_at) at_ from (select lower(split_part(uri, '/', 3)) host, added_at from documents where uri is not null) group by 1) select host, row_number() over (order by at_, host) - 1 as place from u qualify row_number() over (order by at_, host) <= 50""")
def hosts_in_order(spark, d):
    """Hosts in the order in which they were first seen, the first fifty."""
    from ..operators.ranking import best_within

    seen = table(spark, d, "documents").filter("uri is not null").groupBy(F.lower(F.split_part("uri", F.lit("/"), F.lit(3))).alias("host")).agg(F.min("added_at").alias("at_"))
    ranked = best_within(seen.withColumn("g", F.lit(0)), ["g"], [F.asc("at_"), F.asc("host")], 50)
    return ranked.select("host", (F.col("rank") - 1).cast("bigint").alias("place"))


@query("""
with known as (select distinct conversation_id, id from messages where ascii(right(id, 1)) % 3 = 0), new as (select distinct conversation_id, id from messages where conversation_id is not null and id is not null)
select conversation_id, count(*) added from new where (conversation_id, id) not in (select conversation_id, id from known where conversation_id is not null and id is not null) group by 1""")
def appended_messages(spark, d):
    """Messages that a save adds to conversations, those known already being ignored."""
    rows = table(spark, d, "messages").filter("conversation_id is not null and id is not null").select("conversation_id", "id").distinct()
    known = rows.filter("ascii(right(id, 1)) % 3 = 0")
    return rows.join(known, ["conversation_id", "id"], "left_anti").groupBy("conversation_id").agg(F.count("*").alias("added"))


@query("with gone as (select distinct id from conversations where updated_at is null) select conversation_id, count(distinct id) messages from messages where conversation_id is not null and conversation_id not in (select id from gone where id is not null) group by 1")
def kept_conversations(spark, d):
    """Messages left after conversations without an update were deleted with their messages."""
    gone = table(spark, d, "conversations").filter("updated_at is null").select("id")
    return retrieval.without(table(spark, d, "messages").filter("conversation_id is not null"), "conversation_id", gone, "id").groupBy("conversation_id").agg(F.count_distinct("id").alias("messages"))


@query("""
select id, len(string_split(id, ':')) = 2 and not list_has_any(string_split(id, ':'), ['', '.', '..']) two_parts from (select distinct id from records where id is not null)""")
def dataset_names(spark, d):
    """Whether ids, their colons written as slashes, name a dataset as owner and name."""
    return table(spark, d, "records").select("id").filter("id is not null").distinct().select("id", V.is_dataset_id(F.translate("id", ":", "/")).alias("two_parts"))


@query("select user_id, max_by(event_type, (ts, event_type)) last_type, count(*) n from events group by 1")
def observation_lists(spark, d):
    """The last of every user's events in order, and how many there are: an aggregate, no list."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_type")).alias("last_type"), F.count("*").alias("n"))
