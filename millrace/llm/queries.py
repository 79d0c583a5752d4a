"""Queries of the ten training-data problems over the tables of a directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classes as C
from . import conversations, defects, mixing, neardup, overlap, packing, pages, pieces, pii, reading, tokens
from .storage import store


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "records").select(F.lit("records").alias("tbl"), F.col("id").alias("key"), C.message_text("messages").alias("text"))


def _expanded(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs of keys whose classes are linked or equal, smaller key first."""
    m = members.select("tbl", "key", "rid")
    many = m.groupBy("rid").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("rid").alias("a"), F.col("rid").alias("b"))
    wide = links.select("a", "b").unionAll(many)
    x = m.select(F.col("tbl"), F.col("key").alias("k1"), F.col("rid").alias("a"))
    y = m.select(F.col("tbl").alias("tbl2"), F.col("key").alias("k2"), F.col("rid").alias("b"))
    both = wide.join(x, "a").join(y, "b").filter("tbl = tbl2 and k1 <> k2")
    return both.select("tbl", F.least("k1", "k2").alias("key_a"), F.greatest("k1", "k2").alias("key_b")).distinct()


def _all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _table(spark, sf_dir, "near_signatures").select(F.lit("near_signatures").alias("tbl"), F.col("hash").alias("key"), "text")
    return _record_texts(spark, sf_dir).unionByName(near)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.hashed(_all_texts(spark, sf_dir))
    return _expanded(store(C.members(rows)), neardup.links(C.class_words(rows), threshold=0.6, size=3))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, key, class_id, links): every text with the class of its equals and the number of other classes it is linked with; groups of copies aren't expanded to pairs."""
    rows = C.hashed(_all_texts(spark, sf_dir))
    return _with_links(C.members(rows), neardup.links(C.class_words(rows), threshold=0.6, size=3))


def _with_links(members: DataFrame, links: DataFrame) -> DataFrame:
    counts = links.select(F.explode(F.array("a", "b")).alias("rid")).groupBy("rid").agg(F.count("*").alias("links"))
    return members.join(counts, "rid", "left").select("tbl", "key", F.col("rid").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Hashed records of the evaluation splits, and of train."""
    texts = _table(spark, sf_dir, "records").select(F.lower(F.trim("split")).alias("split"), F.col("id").alias("key"), C.message_text("messages").alias("text"))
    part = lambda name, *splits: C.hashed(texts.filter(F.col("split").isin(*splits)).select(F.lit(name).alias("tbl"), "key", "text"))
    return part("eval", "validation", "test"), part("train", "train")


def _side_links(evaluation: DataFrame, training: DataFrame) -> DataFrame:
    """(a, b) of linked or equal classes, a of evaluation and b of train."""
    e, t = C.class_words(evaluation), C.class_words(training)
    equal = evaluation.select(F.col("rid").alias("a")).distinct().join(training.select(F.col("rid").alias("b")).distinct(), F.col("a") == F.col("b"))
    return overlap.overlaps(e, t, e.unionByName(t), threshold=0.6, size=3).select("a", "b").unionByName(equal)


def _cross_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_eval, id_train) of every record of an evaluation split and its counterparts in train."""
    evaluation, training = _sides(spark, sf_dir)
    left = C.members(evaluation).select(F.col("key").alias("id_eval"), F.col("rid").alias("a"))
    right = C.members(training).select(F.col("key").alias("id_train"), F.col("rid").alias("b"))
    return _side_links(evaluation, training).join(left, "a").join(right, "b").filter("id_eval <> id_train").select("id_eval", "id_train").distinct()


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, key, class_id, links): every record of train and of the evaluation splits with the class of its equals and the number of classes of the other side it is linked with."""
    evaluation, training = _sides(spark, sf_dir)
    links = store(_side_links(evaluation, training))
    counts = links.groupBy(F.lit("eval").alias("tbl"), F.col("a").alias("rid")).agg(F.count("*").alias("links")).unionByName(links.groupBy(F.lit("train").alias("tbl"), F.col("b").alias("rid")).agg(F.count("*").alias("links")))
    return C.members(evaluation).unionByName(C.members(training)).join(counts, ["tbl", "rid"], "left").select("tbl", "key", F.col("rid").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _cross_split(spark, sf_dir)
    return pairs.select(F.least("id_eval", "id_train").alias("id_a"), F.greatest("id_eval", "id_train").alias("id_b")).distinct()


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and source: records, those that occur again in train, and their number of train records."""
    pairs = _cross_split(spark, sf_dir).groupBy(F.col("id_eval").alias("id")).agg(F.count("*").alias("n"))
    rows = _table(spark, sf_dir, "records").select("id", F.lower(F.trim("split")).alias("split"), "source").filter("split in ('validation', 'test')").dropDuplicates(["id"])
    return rows.join(pairs, "id", "left").groupBy("split", "source").agg(F.count("*").alias("records"), F.count("n").alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("train_records"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.boilerplate(_table(spark, sf_dir, "fetched_pages"))


def p2_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fetch_id, main_text): the lines of every page's main body, blank lines left out."""
    one = _table(spark, sf_dir, "fetched_pages").filter("fetch_id is not null and text is not null").dropDuplicates(["fetch_id"])
    lines = one.select("fetch_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("fetch_id", (F.col("at") + 1).alias("line_no"), "line").filter("trim(line) <> ''")
    kept = lines.join(p2_found(spark, sf_dir), ["fetch_id", "line_no"], "left_anti")
    return kept.groupBy("fetch_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("main_text"))


def _free_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, row_id, part, text) of all texts that may hold personal information; part numbers the messages of a record."""
    messages = _table(spark, sf_dir, "messages").select(F.lit("messages").alias("tbl"), F.col("id").alias("row_id"), F.lit(0).alias("part"), F.col("content").alias("text"))
    records = _table(spark, sf_dir, "records").select(F.lit("records").alias("tbl"), F.col("id").alias("row_id"), F.posexplode("messages").alias("part", "m")).select("tbl", "row_id", "part", F.col("m.content").alias("text"))
    chunks = _table(spark, sf_dir, "memory_chunks").select(F.lit("memory_chunks").alias("tbl"), F.col("chunk_id").alias("row_id"), F.lit(0).alias("part"), "text")
    return messages.unionByName(records).unionByName(chunks)


def _personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(store(pii.proposed(_free_texts(spark, sf_dir), _table(spark, sf_dir, "name_parts"))))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(spark, sf_dir).select("tbl", "row_id", "pii_type", "found_text").distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts with placeholders, one row for every distinct (tbl, row_id, part, text)."""
    return pii.redacted(_free_texts(spark, sf_dir).filter("row_id is not null").distinct(), _personal(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = conversations.judged(_table(spark, sf_dir, "messages"), _table(spark, sf_dir, "conversations"))
    return judged.filter("defect is not null").select("conversation_id", "defect")


def p3_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of all sound conversations with their positions and speakers."""
    return conversations.assembled(_table(spark, sf_dir, "messages"), _table(spark, sf_dir, "conversations"))


def p3_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments, paths and overlaps of every conversation."""
    return conversations.assembly(_table(spark, sf_dir, "messages"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _table(spark, sf_dir, "memory_chunks").filter("chunk_id is not null").groupBy("chunk_id").agg(F.max("text").alias("text"))
    return pieces.split_texts(chunks.select(F.col("chunk_id").alias("key"), "text"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of which the splitter makes more than one piece."""
    return _pieces(spark, sf_dir).filter("piece = 1").select(F.col("key").alias("chunk_id"))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all oversized chunks."""
    rows = _pieces(spark, sf_dir)
    return rows.join(rows.filter("piece = 1").select("key"), "key").select(F.col("key").alias("chunk_id"), "piece", "begin", "end", "text")


def p6_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, chunk_count, stated): chunks of every memory document after splitting, and the count on record."""
    owner = _table(spark, sf_dir, "memory_chunks").select("chunk_id", "document_id").dropDuplicates(["chunk_id"])
    sizes = _pieces(spark, sf_dir).groupBy(F.col("key").alias("chunk_id")).agg(F.count("*").alias("n"))
    counts = owner.join(sizes, "chunk_id", "left").groupBy("document_id").agg(F.sum(F.coalesce("n", F.lit(1))).alias("chunk_count"))
    documents = _table(spark, sf_dir, "memory_documents").groupBy("document_id").agg(F.max("chunk_count").alias("stated"))
    return documents.join(counts, "document_id", "left").select("document_id", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "stated")


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(tokens.counted(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text").dropDuplicates(["doc_id"]))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, id, question, answer) of instruction_pairs and of the user messages in records that an assistant message follows."""
    pairs = _table(spark, sf_dir, "instruction_pairs").select(F.lit("instruction_pairs").alias("tbl"), "id", F.col("instruction").alias("question"), F.col("text").alias("answer"))
    spoken = F.filter("messages", lambda m: F.coalesce(conversations.speaker(m["role"]), F.lit("")) != "system")
    rows = _table(spark, sf_dir, "records").select("id", F.transform(spoken, lambda m: F.struct(conversations.speaker(m["role"]).alias("role"), m["content"].alias("content"))).alias("m")).filter(F.size("m") > 1)
    both = F.arrays_zip(F.slice("m", 1, F.size("m") - 1).alias("q"), F.slice("m", 2, F.size("m")).alias("a"))
    turns = rows.select("id", F.explode(both).alias("t")).filter("t.q.role = 'user' and t.a.role = 'assistant'")
    return pairs.unionByName(turns.select(F.lit("records").alias("tbl"), "id", F.col("t.q.content").alias("question"), F.col("t.a.content").alias("answer"))).filter("id is not null")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.judged(_answers(spark, sf_dir))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document (or piece of one) for each capacity in pack_sizes."""
    items = _lengths(spark, sf_dir).select("doc_id", "tokens")
    packs = [(r["pack_name"], r["capacity_tokens"]) for r in _table(spark, sf_dir, "pack_sizes").select("pack_name", "capacity_tokens").distinct().collect() if r["pack_name"] and r["capacity_tokens"]]
    out = None if packs else packing.packed(items.filter("false"), "", 1)
    for name, capacity in packs:
        one = packing.packed(items, name, capacity)
        out = one if out is None else out.unionByName(one)
    return out


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return packing.report(p8_packed(spark, sf_dir), _table(spark, sf_dir, "pack_sizes"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document drawn, with its number of repetitions."""
    return mixing.mixed(_lengths(spark, sf_dir), _table(spark, sf_dir, "mixture_targets"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    return mixing.report(p9_mixture(spark, sf_dir), _table(spark, sf_dir, "mixture_targets"))


def p6_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, chunks, largest): chunks of every document before splitting, and whether the largest piece after it keeps the limit."""
    owner = _table(spark, sf_dir, "memory_chunks").filter("chunk_id is not null").select("chunk_id", "document_id").distinct()
    sizes = _pieces(spark, sf_dir).groupBy(F.col("key").alias("chunk_id")).agg(F.max(F.floor(F.length("text") / 4)).alias("largest"))
    return owner.join(sizes, "chunk_id", "left").groupBy("document_id").agg(F.count("*").alias("chunks"), (F.coalesce(F.max("largest"), F.lit(0)) <= pieces.TOKENS).alias("keeps_limit"))


def p8_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pack_name, documents, overfull): documents in containers of each capacity, and containers that hold more than it."""
    packed = store(p8_packed(spark, sf_dir))
    sizes = _table(spark, sf_dir, "pack_sizes").select("pack_name", "capacity_tokens").distinct()
    fill = packed.groupBy("pack_name", "container").agg(F.sum("tokens").alias("n")).join(sizes, "pack_name").groupBy("pack_name").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("overfull"))
    return packed.groupBy("pack_name").agg(F.count_distinct("doc_id").alias("documents")).join(fill, "pack_name")


def p9_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, drawn, over_cap): whether each target's source gives documents, and how many of them are repeated more often than allowed."""
    targets = _table(spark, sf_dir, "mixture_targets")
    mixed = p9_mixture(spark, sf_dir).join(targets.select("source", "max_repeats"), "source").groupBy("source").agg(F.count_if(F.col("repeats") > F.col("max_repeats")).alias("over_cap"))
    return targets.select("source").join(mixed, "source", "left").select("source", F.col("over_cap").isNotNull().alias("drawn"), F.coalesce("over_cap", F.lit(0)).alias("over_cap"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.levels(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "reading_labels")).distinct()


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters by level and source."""
    sizes = _table(spark, sf_dir, "documents").select("doc_id", mixing.source_name("source").alias("source"), F.length("text").alias("chars"))
    return p10_found(spark, sf_dir).join(sizes, "doc_id").groupBy("reading_level", "source").agg(F.count("*").alias("documents"), F.sum("chars").alias("chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_report": p1_report, "p1_classes": p1_classes, "p3_assembly": p3_assembly, "p5_classes": p5_classes, "p2_found": p2_found, "p2_main": p2_main, "p3_found": p3_found, "p3_assembled": p3_assembled, "p4_found": p4_found, "p4_redacted": p4_redacted, "p5_found": p5_found, "p6_found": p6_found, "p6_pieces": p6_pieces, "p6_chunk_counts": p6_chunk_counts, "p6_limits": p6_limits, "p8_limits": p8_limits, "p7_found": p7_found, "p8_packed": p8_packed, "p8_report": p8_report, "p9_mixture": p9_mixture, "p9_limits": p9_limits, "p9_report": p9_report, "p10_found": p10_found, "p10_profile": p10_profile}


def oracle_sql() -> dict[str, str]:
    """SQL for DuckDB of the queries that it can express."""
    visible = "regexp_matches(coalesce(content, ''), '[^\\p{Z}\\p{Cc}\\p{Cf}]')"
    role = "case lower(regexp_replace(coalesce(role, ''), '^\\s+|\\s+$', '', 'g')) when 'system' then 's' when 'user' then 'u' when 'human' then 'u' when 'assistant' then 'a' when 'gpt' then 'a' when 'tool' then 't' when 'observation' then 't' when 'environment' then 't' else 'x' end"
    at = "(case when regexp_matches(created_at, '(Z|z|[+-][0-9]{2}:?[0-9]{2})$') then created_at else created_at || 'Z' end)::timestamptz"
    contents = "coalesce(array_to_string(list_transform(messages, lambda m: coalesce(m.content, '')), ' '), '')"
    records = f"(select distinct 'records' tbl, id as key, lower(trim(split)) part, {contents} x from records where id is not null)"
    near = "(select distinct 'near_signatures' tbl, hash as key, null part, text x from near_signatures where hash is not null and text is not null)"
    runs = "list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) else [array_to_string(w, ' ')] end)"
    overlaps = f"w as (select tbl, key, part, regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}]+') w from t), s as (select tbl, key, part, {runs} s from w where len(w) > 0), e as (select tbl, key, part, len(s) n, unnest(s) g from s)"
    joined = "select a.tbl, a.key ka, b.key kb, a.part pa, b.part pb, a.n na, b.n nb, count(*) o from e a join e b on a.tbl = b.tbl and a.g = b.g and a.key < b.key group by all"
    source = "regexp_replace(lower(trim(source)), '[\\s-]+', '_', 'g')"
    return {
        "p5_found": f"with t as (select * from {records} union all select * from {near}), {overlaps}, p as ({joined}) select distinct tbl, ka key_a, kb key_b from p where o / (na + nb - o) >= 0.6",
        "p1_found": f"with t as (select * from {records} where part in ('train', 'validation', 'test')), {overlaps}, p as ({joined}) select distinct ka id_a, kb id_b from p where o / (na + nb - o) >= 0.6 and (pa = 'train') <> (pb = 'train')",
        "p6_limits": "select document_id, count(*) chunks, true keeps_limit from (select distinct chunk_id, document_id from memory_chunks where chunk_id is not null) group by 1",
        "p8_limits": "select pack_name, (select count(distinct doc_id) from documents where length(text) > 0) documents, 0::bigint overfull from (select distinct pack_name from pack_sizes)",
        "p9_limits": f"select source, source in (select {source} from documents where length(text) > 0 and source is not null) drawn, 0::bigint over_cap from mixture_targets",
        "p3_found": f"""
with one as (select * from messages qualify row_number() over (partition by conversation_id, id order by ingested_at) = 1),
m as (select conversation_id c, id, {role} r, {visible} v, {at} ts from one),
first as (select c, r from m where r <> 's' qualify row_number() over (partition by c order by ts, id) = 1),
e as (select c, r, lead(r) over (partition by c order by ts, id) n from m where r = 'u' or r = 'a' and v),
g as (select c, bool_or(v and r in ('u', 'a')) seen, bool_or(r = 'x') bad from m group by 1), u as (select c, bool_or(r = 'u' and coalesce(n, 'u') = 'u') open from e group by 1),
k as (select distinct id c from conversations)
select c conversation_id, case when not coalesce(seen, false) then 'empty' when bad then 'unknown_role' when first.r <> 'u' then 'orphan_reply' when open then 'missing_reply' end defect
from k left join g using (c) left join first using (c) left join u using (c) where not coalesce(seen, false) or bad or first.r <> 'u' or open""",
        "p6_found": "select distinct chunk_id from memory_chunks where length(text) // 4 > 220",
    }
