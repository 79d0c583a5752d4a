"""Queries of pairs: extraction, secrets, filters, near-duplicates, domains, scores, verification, feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs
from ..functions import values as V
from ..operators import corpus, curation, pairs, records
from .common import ONE, norm, one_records, query, shingles, strip, table
from .records import any_sql

_PAIRS = "(select * from instruction_pairs qualify row_number() over (partition by id order by collected_at) = 1)"
AT = "(case when regexp_matches(created_at, '(Z|z|[+-][0-9]{2}:?[0-9]{2})$') then created_at else created_at || 'Z' end)::timestamptz"


def one_pairs(spark, d) -> DataFrame:
    return table(spark, d, "instruction_pairs").dropDuplicates(["id"])


def _turns(spark, d) -> DataFrame:
    one = table(spark, d, "messages").dropDuplicates(["conversation_id", "id"])
    return one.select("conversation_id", "id", F.lower(F.trim("role")).alias("role"), "content", V.instant("created_at").alias("at"))


_EXTRACTED = f"""one as (select * from messages qualify row_number() over (partition by conversation_id, id order by ingested_at) = 1),
t as (select conversation_id, id, lower(trim(role)) as role, content, {AT} ts from one where lower(trim(role)) in ('user', 'assistant')),
l as (select *, lag(role) over w r, lag(id) over w i, lag(content) over w q from t window w as (partition by conversation_id order by ts, id)),
p as (select *, row_number() over (partition by conversation_id order by ts, id) n from l where role = 'assistant' and r = 'user' and {strip("coalesce(content, '')")} <> '')"""


@query(f"with {_EXTRACTED} select conversation_id, i user_id, id assistant_id from p where n <= 40")
def pair_extraction(spark, d):
    return pairs.extracted(_turns(spark, d)).select("conversation_id", "user_id", "assistant_id")


def _secret_pattern(p: str) -> str:
    return p.replace(chr(39), chr(39) * 2)


def _secrets_sql(x: str) -> str:
    return "list_filter([" + ", ".join(f"case when regexp_matches({x}, '{_secret_pattern(p)}') then '{n}' end" for n, p in pairs.SECRETS) + "], lambda v: v is not null)"


# Secrets are rare in the tables: some are put behind contents by their length.
_KINDS = ("AKIA" + "Q" * 16, "ghp_" + "a1" * 12, "sk-ant-" + "b" * 24, "xoxb-" + "1" * 12, "password = \"abcdefghijklmn\"", "-----BEGIN RSA PRIVATE KEY-----", "AIza" + "x" * 35, "authorization: bearer " + "t" * 24)
_MADE = "concat_ws(' ', content, case length(content) % 11 " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(_KINDS)) + " end)"


def _leaky(spark, d) -> DataFrame:
    return table(spark, d, "messages").select("id", F.expr(_MADE.replace("concat_ws(' ', content, ", "concat_ws(' ', content, ")).alias("content")).distinct()


@query(f"with m as (select distinct id, {_MADE} c from messages) select id, array_to_string({_secrets_sql('c')}, ',') secrets, regexp_replace(c, '\\b[\\w.+-]+@[\\w-]+\\.[\\w.-]{{2,}}\\b', '[email]', 'g') masked from m")
def secret_scan(spark, d):
    return _leaky(spark, d).select("id", F.array_join(pairs.secrets("content"), ",").alias("secrets"), T.masked_emails("content").alias("masked"))


def _redacted_sql(x: str) -> str:
    for n, p in pairs.SECRETS:
        x = f"regexp_replace({x}, '{_secret_pattern(p)}', '[REDACTED:{n}]', 'g')"
    return x


@query(f"with m as (select distinct id, {_MADE} c from messages) select id, {_redacted_sql('c')} redacted from m")
def secret_redaction(spark, d):
    return _leaky(spark, d).select("id", pairs.redacted("content").alias("redacted"))


_Q, _A = "coalesce(instruction, '')", "coalesce(text, '')"
_HEDGED = "(" + " or ".join(f"contains(lower(a), '{_secret_pattern(p)}')" for p in pairs.HEDGES) + ")"
_DUMP = f"(regexp_matches({strip('a')}, '^[{{\\[]') and json_valid(a))"
# Some answers are made whole JSON, so that the rule on dumps has cases.
_ANSWER = f"case when ascii(right(id, 1)) % 9 = 0 then '{{\"answer\": \"' || repeat('x', 90) || '\"}}' else {_A} end"


def _odd_pairs(spark, d) -> DataFrame:
    return one_pairs(spark, d).withColumn("text", F.expr(f"case when ascii(right(id, 1)) % 9 = 0 then '{{\"answer\": \"' || repeat('x', 90) || '\"}}' else {_A} end"))


@query(f"""
with t as (select id, {_Q} q, {_ANSWER} a from {_PAIRS}), s as (select *, {shingles(norm('q'))} x, {shingles(norm('a'))} y from t)
select id, case when len({_secrets_sql("q || chr(10) || a")}) > 0 then 'secret_detected' when {strip('q')} = '' then 'empty_instruction' when length(q) < 24 then 'instruction_too_short' when length(q) > 4000 then 'instruction_too_long'
 when length(a) < 80 then 'response_too_short' when length(a) > 8000 then 'response_too_long' when {_DUMP} then 'tool_protocol_dump' when {_HEDGED} then 'hedging_response'
 when len(x) > 0 and len(list_intersect(x, y)) / len(x) > 0.7 then 'response_echoes_instruction' end reason from s""")
def pair_reject_reasons(spark, d):
    return _odd_pairs(spark, d).select("id", pairs.reject_reason("instruction", "text").alias("reason"))


@query(f"with t as (select id, {_ANSWER} a from {_PAIRS}) select id, {_DUMP} dump from t")
def tool_dumps(spark, d):
    return _odd_pairs(spark, d).select("id", pairs.is_tool_dump("text").alias("dump"))


@query(f"""
with t as (select id, {_Q} q, {_ANSWER} a from {_PAIRS}), r as (select id, length(q) lq, length(a) la, {_HEDGED} h from t)
select case when lq < 24 then 'short' when lq > 4000 then 'long' else 'fit' end question, case when la < 80 then 'short' when la > 8000 then 'long' else 'fit' end answer, h hedged, count(*) n from r group by all""")
def pair_shapes(spark, d):
    """Pairs by the lengths of question and answer and whether they hedge."""
    q, a = F.length(F.coalesce("instruction", F.lit(""))), F.length("text")
    shape = lambda x, low, high: F.when(x < low, "short").when(x > high, "long").otherwise("fit")
    rows = _odd_pairs(spark, d).select(shape(q, 24, 4000).alias("question"), shape(a, 80, 8000).alias("answer"), T.contains_any(F.lower("text"), pairs.HEDGES).alias("hedged"))
    return corpus.counted(rows, "question", "answer", "hedged")


@query(f"with t as (select id, {shingles(norm(_Q))} x, {shingles(norm(_A))} y from {_PAIRS}) select id, round(case when len(x) = 0 or len(y) = 0 then 0.0 else len(list_intersect(x, y)) / len(x) end, 6) echo from t")
def echo_ratio(spark, d):
    return one_pairs(spark, d).select("id", F.round(T.containment(T.word_shingles(F.coalesce("instruction", F.lit(""))), T.word_shingles(F.coalesce("text", F.lit("")))), 6).alias("echo"))


_SETS = f"""c as (select min(id) k, s from (select id, list_sort({shingles(norm("concat_ws(' ', instruction, text)"))}) s from {_PAIRS} where id is not null) where len(s) > 0 group by s),
w as (select k, len(s) n, unnest(s) w from c), o as (select a.k ka, b.k kb, a.n na, b.n nb, count(*) o from w a join w b using (w) where a.k < b.k group by all)"""


@query(f"with {_SETS} select ka key_a, kb key_b, round(o / (na + nb - o), 6) similarity from o where round(o / (na + nb - o), 6) >= 0.4")
def pair_near_duplicates(spark, d):
    """Pairs of classes of equal questions and answers that share two fifths of their five-word runs."""
    return corpus.shingle_pairs(one_pairs(spark, d).withColumn("both", F.concat_ws(" ", "instruction", "text")), "id", "both", 0.4)


@query(f"with s as (select id, list_sort({shingles(norm('concat_ws(chr(32), instruction, text)'))}) s from {_PAIRS} where id is not null) select id as key, min(id) over (partition by s) class_key from s where len(s) > 0")
def pair_classes(spark, d):
    """Every pair of texts with the first of those that have the same five-word runs."""
    return corpus.class_members(one_pairs(spark, d).withColumn("both", F.concat_ws(" ", "instruction", "text")), "id", "both")


@query()
def pair_duplicates(spark, d):
    """Exact and near-duplicates in the order of ids, with what they are like."""
    return curation.duplicate_pairs(one_pairs(spark, d).select("id", "instruction", F.col("text").alias("response")), "id", 0.6)


_HITS = {n: f"len(regexp_extract_all(x, '{p}'))" for n, p in pairs.DOMAINS}


@query(f"""
with t as (select id, text, lower(concat_ws(' ', instruction, text)) x from {_PAIRS}), h as (select id, text, {", ".join(f"{v} {k}" for k, v in _HITS.items())} from t), b as (select *, greatest({", ".join(_HITS)}) best from h)
select id, case {" ".join(f"when {k} = best and best >= 5 then '{k}'" for k in _HITS)} end as domain,
 ((case when length(text) >= 400 then 25 else 0 end {" ".join(f"+ case when regexp_matches(text, '{p}') then {w} else 0 end" for _, w, p in pairs.SIGNALS)}) / 100.0)::double score from b""")
def domain_scoring(spark, d):
    return one_pairs(spark, d).select("id", pairs.domain("instruction", "text").alias("domain"), F.coalesce(pairs.signal_score("text"), F.lit(0)).cast("double").alias("score"))


# Texts of the tables seldom reach a domain: every answer gets a few words of one.
_BOOST = ("numpy array matrix vector plot", "pandas sql csv join schema", "requests http url html crawler", "regex token grammar decode format", "torch neural gradient keras lstm", "gpio uart i2c sensor firmware")
_BOOSTED = f"concat_ws(' ', {_A}, case ascii(right(id, 1)) % 8 " + " ".join(f"when {i} then '{b}'" for i, b in enumerate(_BOOST)) + " end, '\nimport re\ndef f(x: int) -> str:\n    return str(x)')"


def _boosted(spark, d) -> DataFrame:
    return one_pairs(spark, d).filter("id is not null").select("id", "instruction", F.expr(_BOOSTED.replace("\n", "\\n")).alias("response"))


_BOOSTED_HITS = f"""t as (select id, {_Q} q, {_BOOSTED} a from {_PAIRS} where id is not null), x as (select *, lower(concat_ws(' ', q, a)) x from t), h as (select *, {", ".join(f"{v} {k}" for k, v in _HITS.items())} from x), b as (select *, greatest({", ".join(_HITS)}) best from h),
m as (select *, case {" ".join(f"when {k} = best and best >= 5 then '{k}'" for k in _HITS)} end as own, case when length(a) >= 400 then 25 else 0 end {" ".join(f"+ case when regexp_matches(a, '{p}') then {w} else 0 end" for _, w, p in pairs.SIGNALS)} points from b)"""


@query(f"with {_BOOSTED_HITS} select id, own as domain, case when length(q) < 40 then 'instruction_too_short' when length(a) < 200 then 'response_too_short' when own is null then 'no_domain_match' when points < 40 then 'below_quality_floor' end reason from m")
def package_reasons(spark, d):
    rows = _boosted(spark, d)
    return rows.select("id", pairs.domain("instruction", "response").alias("domain"), curation.package_reason("instruction", "response", least=0.4).alias("reason"))


@query()
def package_build(spark, d):
    """A package of pairs, near-duplicates judged in order: metrics."""
    return curation.package_stats(curation.packaged(_boosted(spark, d), "id", least=0.4))


@query(f"with {_EXTRACTED}, k as (select conversation_id || ':' || id record_id, coalesce(q, '') q, content a from p where n <= 40), s as (select *, {shingles(norm('q'))} x, {shingles(norm('a'))} y from k) select case when len({_secrets_sql('q || chr(10) || a')}) > 0 then 'secret_detected' when {strip('q')} = '' then 'empty_instruction' when length(q) < 24 then 'instruction_too_short' when length(q) > 4000 then 'instruction_too_long' when length(a) < 80 then 'response_too_short' when length(a) > 8000 then 'response_too_long' when {_DUMP} then 'tool_protocol_dump' when {_HEDGED} then 'hedging_response' when len(x) > 0 and len(list_intersect(x, y)) / len(x) > 0.7 then 'response_echoes_instruction' else 'passed' end reason, count(*) n from s group by 1")
def extraction_counts(spark, d):
    """Pairs extracted from all conversations by the first rule they break."""
    rows = pairs.extracted(_turns(spark, d)).select(F.coalesce(pairs.reject_reason("instruction", "response"), F.lit("passed")).alias("reason"))
    return corpus.counted(rows, "reason")


@query()
def training_set(spark, d):
    """The set built from all transcripts: pairs by reason and part."""
    return corpus.counted(curation.built(_turns(spark, d)), "reason", "part")


_G = f"lower({_Q})"
_SCORED = f"""t as (select id, {_G} g, {_A} a, lower({_A}) l, trim(regexp_replace(lower({_A}), '\\s+', ' ', 'g')) f, collected_at from {_PAIRS}),
s as (select *, len(list_filter(string_split(regexp_replace(a, '([.!?])\\s+', '\\1␟', 'g'), '␟'), lambda x: {strip("x")} <> '')) n, (length(f) - length(replace(f, substr(f, 1, 40), ''))) / greatest(length(substr(f, 1, 40)), 1) rep from t),
r as (select id, collected_at, a, case when {strip("a")} = '' then 0.0 else greatest(0, least(100, 20 + case when length(a) between 40 and 4000 then 20 when length(a) > 12000 then -10 else 0 end + case when n >= 2 or length(a) > 250 then 10 else 0 end
 - case when length(f) >= 120 and rep > 2 then 20 else 0 end - least(40, 15 * ({" + ".join(f"contains(l, '{_secret_pattern(p)}')::int" for p in pairs.FILLER)}))
 + case when list_has_any(regexp_extract_all(g, '[a-z]{{4,}}'), regexp_extract_all(l, '[a-z]{{4,}}')) then 20 else 0 end - case when {any_sql('g', pairs.RESEARCH)} then 20 else 0 end)) / 100.0 end score from s),
v as (select *, case when ascii(right(id, 1)) % 3 = 0 then ascii(right(id, 1)) % 6 end human from r),
e as (select *, coalesce(human / 5.0, score) eff, case when coalesce(human / 5.0, score) >= 0.75 then 'exemplar' when coalesce(human / 5.0, score) <= 0.25 then 'warning' else 'ordinary' end verdict from v)"""


@query(f"with {_SCORED} select id, score::double score from r")
def answer_scores(spark, d):
    return one_pairs(spark, d).select("id", pairs.heuristic_score("instruction", "text").alias("score"))


def runs(spark, d) -> DataFrame:
    """Answers as scored runs; a third of them have a score by people, made from the id."""
    rows = one_pairs(spark, d).select(F.col("id").alias("run_id"), F.col("instruction").alias("goal"), F.coalesce("text", F.lit("")).alias("answer"), pairs.heuristic_score("instruction", "text").alias("auto_score"), F.col("collected_at").alias("created_at"))
    last = F.ascii(F.right("run_id", F.lit(1)))
    return rows.withColumn("human_score", F.when(last % 3 == 0, last % 6)).withColumn("verdict", pairs.verdict("human_score", "auto_score"))


@query(f"with {_SCORED} select verdict, count(*) answers, round(avg(least(1.0, greatest(0.0, eff))), 6) effective, count(human) judged from e group by 1")
def answer_verdicts(spark, d):
    """Answers by verdict, their mean effective score, and how many people judged."""
    return runs(spark, d).groupBy("verdict").agg(F.count("*").alias("answers"), F.round(F.avg(pairs.effective_score("human_score", "auto_score")), 6).alias("effective"), F.count("human_score").alias("judged"))


@query(f"with {_SCORED} select id run_id, substr(a, 1, 400) answer, human::int human_score from e where verdict = 'exemplar' order by human is null, coalesce(human, 0) desc, score desc, collected_at desc, id limit 3")
def exemplars(spark, d):
    return curation.exemplars(runs(spark, d)).select("run_id", "answer", "human_score")


@query(f"with {_SCORED} select id run_id, verdict, collected_at created_at from e order by collected_at desc, id limit 20")
def recent_runs(spark, d):
    return curation.newest(runs(spark, d), "created_at", "run_id", 20).select("run_id", "verdict", "created_at")


@query(f"select id run_id, {_A} answer, length(id)::int steps, 1::int tools from {_PAIRS} where id is not null and instruction is not null and ascii(right(id, 1)) % 4 <> 0")
def run_log_import(spark, d):
    """Runs of a log of JSON lines that aren't known yet; the lines are made of the pairs, a quarter of which are known."""
    rows = one_pairs(spark, d).filter("id is not null")
    steps = F.transform(F.sequence(F.lit(1), F.length("id")), lambda i: F.struct(F.when(i == 1, F.array(F.lit("search"))).alias("tools")))
    line = F.to_json(F.struct(F.col("id").alias("run_id"), F.col("instruction").alias("goal"), F.coalesce("text", F.lit("")).alias("answer"), steps.alias("steps")))
    known = rows.filter("ascii(right(id, 1)) % 4 = 0").select(F.col("id").alias("run_id"))
    return curation.imported_runs(rows.select(line.alias("line")), known).select("run_id", "answer", "steps", F.size("tools").alias("tools"))


@query(f"""
with t as (select *, case when {strip(_Q)} = '' then 'invalid_instruction' when {strip(_A)} = '' then 'invalid_text' when {strip("coalesce(id, '')")} = '' then 'invalid_id' when length(instruction) > 300 then 'instruction_too_long' when length(text) > 1000 then 'text_too_long' end reason from instruction_pairs),
g as (select id, reason, collected_at from t where reason is null qualify row_number() over (partition by id order by collected_at) = 1)
select concat_ws(':', 'set', id) id, reason, case when reason is null then 2 else 2 end::int messages from (select id, reason from g union all select id, reason from t where reason is not null)""")
def prepared_pairs(spark, d):
    return curation.prepared_pairs(table(spark, d, "instruction_pairs"), "set", "collected_at", 300, 1000).select("id", "reason", F.size("messages").alias("messages"))


@query("with n as (select doc_id, row_number() over (order by doc_id) - 1 n, count(*) over () total from documents) select doc_id from n where n % greatest(1, total // 25) = 0 and n // greatest(1, total // 25) < 25")
def strided_sample(spark, d):
    return curation.strided(table(spark, d, "documents").select("doc_id"), "doc_id", 25)


@query("select doc_id from documents order by doc_id limit 40")
def capped_records(spark, d):
    return curation.accepted(table(spark, d, "documents").select("doc_id"), "doc_id", 40)


@query("select doc_id, source from documents qualify row_number() over (partition by source order by doc_id) <= 5")
def capped_sources(spark, d):
    return curation.capped(table(spark, d, "documents").select("doc_id", "source"), ["source"], "doc_id", 5)


@query(f"select id, coalesce(list_filter(messages, lambda m: m.role = 'assistant')[1].content, '') answer from {ONE}")
def first_answers(spark, d):
    return one_records(spark, d).select("id", curation.first_answer("messages").alias("answer"))


# Code: each answer gets a block of Python by its id


_BLOCKS = ("import numpy as np\nprint(np.zeros(3))", "import subprocess\nsubprocess.run(['ls'])", "def f(x):\n    return eval(x)", "import json\ndef g():\n    return json.dumps({})", "x = = 1", "from os import path\nimport redis, yaml\nclass A: pass")
_BUCKETS = ("unverifiable", "unsafe", "unsafe", "not_executed", "no_code", "unverifiable")
_DETAILS = ("missing: numpy", "imports subprocess", "calls eval()", "pass --execute", "no extractable python", "missing: redis, yaml")
_CASE = "ascii(right(id, 1)) % 6"


@query(f"select id, case {_CASE} {' '.join(f'''when {i} then '{b}' ''' for i, b in enumerate(_BUCKETS))} end bucket, case {_CASE} {' '.join(f'''when {i} then '{b}' ''' for i, b in enumerate(_DETAILS))} end detail from {_PAIRS} where id is not null")
def code_buckets(spark, d):
    """Verification of answers with Python by what can be told without running it."""
    block = F.element_at(F.array(*map(F.lit, _BLOCKS)), F.expr(_CASE).cast("int") + 1)
    rows = one_pairs(spark, d).filter("id is not null").select("id", F.concat(F.lit("Like so:\n```python\n"), block, F.lit("\n```\n")).alias("answer"))
    return curation.bucketed(rows, "id", "answer")


_MODES = "case l_linenumber when 1 then 'verified' when 2 then 'verified' when 3 then 'failed' when 4 then 'timeout' when 5 then 'unverifiable' when 6 then 'no_code' else 'unsafe' end"


@query(f"with b as (select {_MODES} bucket from lineitem), c as (select count(*) examined, {', '.join(f'''count(*) filter (where bucket = '{b}') {b}''' for b in curation.BUCKETS)} from b) select *, verified + failed + timeout executable, case when verified + failed + timeout > 0 then round(verified / (verified + failed + timeout), 4) end rate from c")
def verification_rate(spark, d):
    """The report of verification, over buckets made from line numbers."""
    return curation.verification_report(table(spark, d, "lineitem").select(F.expr(_MODES).alias("bucket")))


@query(f"select id, sha256(lower(trim(regexp_replace({_Q}, '\\s+', ' ', 'g')))) k from {_PAIRS} where not regexp_matches({_Q}, '[^\\x00-\\x7f]')")
def folded_keys(spark, d):
    """Keys of folded questions in plain letters, which SQL can fold too."""
    rows = one_pairs(spark, d).filter(~F.coalesce("instruction", F.lit("")).rlike(r"[^\x00-\x7f]"))
    return rows.select("id", F.sha2(curation.folded("instruction"), 256).alias("k"))


@query(f"select id, case when contains(t, 'call') then 'lookup' end as name, case when contains(t, 'call') then '{{\"n\":' || length(id) || '}}' end arguments from (select id, case when ascii(right(id, 1)) % 2 = 0 then 'call' else 'none' end t from {_PAIRS} where id is not null)")
def printed_calls(spark, d):
    """Calls that a model printed as text among other words, in four spellings."""
    n = F.expr("ascii(right(id, 1))")
    arguments = F.concat(F.lit('{"n": '), F.length("id").cast("string"), F.lit("}"))
    shapes = [F.concat(F.lit(f'I will look. {{"{key}": "lookup", "{name}": '), arguments, F.lit("} then")) for key, name in (("name", "arguments"), ("tool", "input"), ("tool_name", "parameters"))] + [F.concat(F.lit('[{"function": {"name": "lookup", "arguments": '), arguments, F.lit("}}]"))]
    text = F.when(n % 2 == 0, F.element_at(F.array(*shapes), (n % 8 / 2).cast("int") + 1)).otherwise("nothing here [ at all")
    rows = one_pairs(spark, d).filter("id is not null").select("id", records.calls_in_text(udfs.leading_json(text)).alias("c"))
    return rows.select("id", F.get("c", F.lit(0))["name"].alias("name"), F.get("c", F.lit(0))["arguments"].alias("arguments"))
