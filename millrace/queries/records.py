"""Queries of validation, normalization, filter, quality, classification, keys and statistics of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import corpus, records
from ..plans import prepare
from .common import CONTENTS, ONE, UNIT, norm, one_records, query, strip, table


def any_sql(x: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({x}, '{w}')" for w in words) + ")"


def sensitive_sql(x: str) -> str:
    return "(" + " or ".join(f"regexp_matches({x}, '{p}')" for p in records.SENSITIVE) + ")"


# The records have no calls, so some are made from the length of an assistant's message: sound ones, ones without a name, and ones whose arguments are no object.


def called(spark, d) -> DataFrame:
    """One row a record, with calls made for assistants' messages of even length; every sixth says nothing else."""
    n = lambda m: F.coalesce(F.length(m["content"]), F.lit(0))
    acts = lambda m: F.coalesce((m["role"] == "assistant") & (n(m) % 2 == 0), F.lit(False))

    def call(m: Column) -> Column:
        arguments = F.when(n(m) % 70 == 0, F.lit("[1]")).otherwise(F.concat(F.lit('{"n":'), n(m).cast("string"), F.lit("}")))
        return F.array(F.struct(F.when(n(m) % 110 == 0, " ").otherwise("lookup").alias("name"), arguments.alias("arguments"), F.lit(None).cast("string").alias("id")))

    made = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.when(acts(m) & (n(m) % 6 == 0), "").otherwise(m["content"]).alias("content"), F.when(acts(m), call(m)).alias("tool_calls")))
    return one_records(spark, d).withColumn("messages", made.cast(records.MESSAGES))


_N = "coalesce(length(m.content), 0)"
_ACTS = f"coalesce(m.role = 'assistant' and {_N} % 2 = 0, false)"
CALLED = f"""(select * replace (list_transform(messages, lambda m: {{'role': m.role, 'content': case when {_ACTS} and {_N} % 6 = 0 then '' else m.content end,
 'calls': case when {_ACTS} then [{{'name': case when {_N} % 110 = 0 then ' ' else 'lookup' end, 'arguments': case when {_N} % 70 = 0 then '[1]' else '{{"n":' || {_N} || '}}' end}}] else [] end}}) as messages) from {ONE})"""
_BLANK = strip("m.content") + " = ''"
_RULE = f"""case when m.role is null or m.role not in ('system','user','assistant','tool') then 'invalid_role' when m.content is null then 'malformed_message_fields'
 when m.role = 'user' and {_BLANK} then 'empty_user' when m.role = 'assistant' and {_BLANK} and len(m.calls) = 0 then 'empty_assistant'
 when len(m.calls) > 0 and trim(m.calls[1].name) = '' then 'invalid_tool_call' when len(m.calls) > 0 and m.calls[1].arguments not like '{{%' then 'invalid_tool_arguments' end"""
_ARGUMENTS = "coalesce(list_sum(list_transform(messages, lambda m: case when len(m.calls) > 0 then length(m.calls[1].arguments) else 0 end)), 0)"
_RESULTS = "length(to_json(list_transform(list_filter(coalesce(messages, []), lambda m: m.role = 'tool'), lambda m: {'content': coalesce(m.content, ''), 'role': m.role}))::varchar)"
_CONTENT_CHARS = "coalesce(list_sum(list_transform(messages, lambda m: coalesce(length(m.content), 0))), 0)"
_CHARS = f"({_CONTENT_CHARS} + {_ARGUMENTS} + {_RESULTS})"
_BROKEN = f"list_filter(list_transform(messages, lambda m: {_RULE}), lambda r: r is not null)"
_REASON = f"""case when coalesce(len(messages), 0) < 1 then 'empty_messages' when len({_BROKEN}) > 0 then {_BROKEN}[1] when {_CHARS} > 200000 then 'too_long'
 when not list_contains(list_transform(messages, lambda m: coalesce(m.role, '')), 'user') then 'missing_user' end"""
_NC = "coalesce(list_sum(list_transform(messages, lambda m: len(m.calls))), 0)"
_NT = "len(list_filter(coalesce(messages, []), lambda m: coalesce(m.role, '') = 'tool'))"
# Results that no call before them asked for: the largest excess of results over calls of all beginnings.
_ORPHANS = "greatest(0, coalesce(list_max(list_transform(range(1, len(messages) + 1), lambda k: len(list_filter(messages[1:k], lambda m: coalesce(m.role, '') = 'tool')) - coalesce(list_sum(list_transform(messages[1:k], lambda m: len(m.calls))), 0))), 0))"
_JUDGED = f"""j as (select *, {_REASON} reason, {_CHARS} chars, {_NC} nc, {_ORPHANS}::int orphans, {_NT} nt, {CONTENTS} x from c),
q as (select *, nc - (nt - orphans) > 0 open, {sensitive_sql('x')} s, length({strip('x')}) < 20 and nc = 0 low from j),
f as (select *, orphans + open::int + s::int + low::int n from q),
sc as (select *, case when coalesce(len(messages), 0) < 1 then 0.0 else round(greatest(0.0, least(1.0, 1.0 - (case when chars > 200000 then 0.25 else 0 end) - (case when list_contains(list_transform(messages, lambda m: coalesce(m.role, '')), 'user') then 0 else 0.2 end) - least(0.4, n * 0.1))), 4) end score from f)"""


@query(f"""
with t as (select doc_id, coalesce(text, '') x from documents)
select {sensitive_sql('x')} sensitive, length({strip("x")}) < 20 low_information, count(*) documents from t group by 1, 2""")
def quality_flags_documents(spark, d):
    from ..functions import text as T

    x = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select(records.sensitive(x).alias("sensitive"), (F.length(T.stripped(x)) < 20).alias("low_information")).groupBy("sensitive", "low_information").agg(F.count("*").alias("documents"))


@query(f"with c as {CALLED} select id, {_REASON} reason from c")
def record_reject_reasons(spark, d):
    return called(spark, d).select("id", records.reject_reason("messages").alias("reason"))


@query(f"with c as {CALLED} select id, {_CHARS}::bigint chars, {_ARGUMENTS}::bigint argument_chars, {_RESULTS}::bigint result_chars from c")
def trajectory_sizes(spark, d):
    return called(spark, d).select("id", *[f("messages").cast("bigint").alias(n) for n, f in (("chars", records.trajectory_chars), ("argument_chars", records.argument_chars), ("result_chars", records.result_chars))])


@query(f"""with c as {CALLED}, {_JUDGED}
select id, concat_ws(',', case when orphans > 0 then array_to_string(list_transform(range(orphans), lambda i: 'orphan_tool_result'), ',') end, case when open then 'missing_tool_result' end, case when s then 'sensitive_data_review' end, case when low then 'low_information_review' end) flags, score from sc""")
def record_quality(spark, d):
    return called(spark, d).select("id", F.array_join(records.flags("messages"), ",").alias("flags"), records.quality("messages").alias("score"))


@query(f"with c as {CALLED}, {_JUDGED} select reason, count(*) n from (select coalesce(reason, case when score < 0.75 then 'quality_below_threshold' end, 'accepted') reason from sc) group by 1")
def filter_counts(spark, d):
    """Records by the first rule broken, a minimum quality of 0.75 being asked."""
    why = F.coalesce(records.reject_reason("messages", minimum_quality=0.75), F.lit("accepted"))
    return corpus.counted(called(spark, d).select(why.alias("reason")), "reason")


_LABELS = " ".join(f"when {any_sql('x', w)} then '{c}:{e}'" for c, e, w in records.KEYWORDS)
_REST = f"when nc > 0 then 'TOOL_USE:tool_calls_field' when coalesce(len(messages), 0) > 2 then 'AGENT_TRAJECTORY:multi_turn_messages' when {any_sql('x', records.REASONING)} then 'REASONING:reasoning_terms'"
_OWN = "when task_type in (" + ",".join(f"'{c}'" for c in records.CATEGORIES) + ") then task_type || ':source-provided'"


def _label(spark_rows: DataFrame, **names) -> DataFrame:
    return spark_rows.withColumn("c", records.classified("messages", "task_type", **names)).select("id", F.when(F.col("c.label").isNotNull() | F.col("c.evidence").isNotNull(), F.concat_ws(":", F.coalesce("c.label", F.lit("none")), "c.evidence")).alias("label"))


@query(f"with c as {CALLED}, t as (select *, lower({CONTENTS}) x, {_NC} nc from c) select id, case {_OWN} {_LABELS} {_REST} end as label from t")
def task_classification(spark, d):
    return _label(called(spark, d))


_SUBSET = "case ascii(right(id, 1)) % 5 when 0 then 'SWE-tasks' when 1 then 'mind2web' when 2 then 'agenttuning_os' else '' end"
_SOURCE = "case ascii(right(id, 1)) % 7 when 3 then 'starcoder' when 4 then 'toprak-chat' when 5 then 'nemotron' else coalesce(source, '') end"


@query(f"""
with c as {CALLED}, t as (select *, lower({CONTENTS}) x, {_NC} nc, {_SUBSET} sub, lower({_SOURCE}) src from c)
select id, case {_OWN} when contains(src, 'starcoder') then 'CODING:python_instruction_source'
 when contains(src, 'toprak') then case when nc > 0 then 'TOOL_USE:tool_calls_field' when coalesce(len(messages), 0) > 2 then 'AGENT_TRAJECTORY:multi_turn_messages' else 'GENERAL_CONVERSATION:conversation_source' end
 when contains(src, 'nemotron') then case when nc > 0 then 'FUNCTION_CALLING:tool_calls_field' when coalesce(len(messages), 0) > 2 then 'AGENT_TRAJECTORY:multi_turn_messages' else 'GENERAL_CONVERSATION:conversation_source' end
 when sub = 'SWE-tasks' then case when {any_sql('x', records.ERROR_WORDS)} then 'ERROR_RECOVERY:software_error_terms' when nc > 0 or {any_sql('x', records.SOFTWARE_WORDS)} then 'CODING:software_source_evidence' else 'none:software_source_without_content_evidence' end
 when sub = 'mind2web' then case when {any_sql('x', records.WEB_WORDS)} or coalesce(len(messages), 0) > 2 then 'WEB_TASK:web_source_evidence' else 'none:web_source_without_content_evidence' end
 when sub = 'agenttuning_os' then case when nc > 0 or coalesce(len(messages), 0) > 2 then 'AGENT_TRAJECTORY:agenttuning_source_evidence' else 'none:agenttuning_source_without_content_evidence' end {_LABELS} {_REST} end as label from t""")
def source_classification(spark, d):
    """Labels where sources and subsets (made from the ids) have rules of their own."""
    rows = called(spark, d).withColumn("sub", F.expr(_SUBSET)).withColumn("src", F.expr(_SOURCE))
    return _label(rows, source=F.col("src"), subset=F.col("sub"))


@query(f"""
with c as {CALLED}, t as (select id, coalesce(messages, []) m, {CONTENTS} x, {_NC}::int nc from c), a as (select *, list_filter(m, lambda v: v.role = 'assistant') s, list_transform(m, lambda v: coalesce(v.role, '')) r from t)
select id, list_contains(r, 'user') user_goal_present, regexp_matches(lower(x), '\\b(plan|step|decompose|roadmap)\\b') plan_evidence, nc tool_selection_count, 'not_present_in_source' permission_check, len(list_filter(m, lambda v: v.role = 'tool'))::int tool_result_count, len(list_filter(m, lambda v: v.role = 'tool'))::int observation_count,
 coalesce(contains('>' || array_to_string(r, '>') || '>', '>tool>assistant>'), false) next_action_evidence, coalesce({strip("s[len(s)].content")} <> '' and len(s[len(s)].calls) = 0, false) completion_evidence from a""")
def agentic_flow(spark, d):
    return called(spark, d).select("id", records.agentic_flow("messages").alias("f")).select("id", "f.*")


@query("select lower(role) spelling, case lower(role) when 'system' then 'system' when 'user' then 'user' when 'human' then 'user' when 'assistant' then 'assistant' when 'gpt' then 'assistant' when 'tool' then 'tool' when 'observation' then 'tool' when 'environment' then 'tool' end role, count(*) n from messages group by 1, 2")
def role_spellings(spark, d):
    return table(spark, d, "messages").select(F.lower("role").alias("spelling"), records.role("role").alias("role")).groupBy("spelling", "role").agg(F.count("*").alias("n"))


# Raw lines in the four dialects


_DIALECT = "ascii(right(id, 1)) % 4"


def raw_lines(spark, d) -> DataFrame:
    """Every record as a line of JSON: by the last letter of its id as messages (those with odd length as JSON text), turns, actions, or a pair of texts. The row number is that of the id's order within nothing: a hash of it."""
    said = lambda role: F.try_element_at(F.transform(F.filter("messages", lambda m: m["role"] == role), lambda m: m["content"]), F.lit(1))
    keep = {"ignoreNullFields": "false"}
    calls = lambda m: F.transform(m["tool_calls"], lambda c: F.struct(F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")).alias("function")))
    message = lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), calls(m).alias("tool_calls"))
    plain = F.to_json(F.struct("id", "license", F.transform("messages", message).alias("messages")), keep)
    texts = F.to_json(F.struct("id", "license", F.transform("messages", lambda m: F.to_json(message(m), keep)).alias("messages")), keep)
    turns = F.to_json(F.struct("id", F.lit("Be brief.").alias("system"), F.transform("messages", lambda m: F.struct(m["role"].alias("from"), m["content"].alias("value"))).alias("conversations")), keep)
    kind = lambda m: F.when(m["role"] == "assistant", "message_action").when(m["role"] == "user", "text_observation").when(m["role"] == "tool", "observation").otherwise(m["role"])
    actions = F.to_json(F.struct(F.col("id").alias("uuid"), F.transform("messages", lambda m: F.struct(kind(m).alias("class_"), m["role"].alias("source"), m["content"].alias("content"))).alias("content")), keep)
    pair = F.to_json(F.struct("id", said("user").alias("instruction"), said("assistant").alias("text")), keep)
    n = F.expr(_DIALECT)
    line = F.when(n == 0, F.when(F.length("id") % 2 == 0, plain).otherwise(texts)).when(n == 1, turns).when(n == 2, actions).otherwise(pair)
    rows = called(spark, d).filter("id is not null")
    return rows.select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("row_number"), line.alias("line"), F.coalesce("source", F.lit("unknown")).alias("source"))


_FIRST = lambda role: f"list_filter(messages, lambda m: m.role = '{role}')[1].content"
_ROLES = "'system','user','assistant','tool'"


def _bad(rule: str, prefix: str) -> str:
    rows = f"list_filter(list_transform(range(1, len(messages) + 1), lambda i: '{prefix}_' || (i - 1) || '_' || ({rule})), lambda r: r is not null)"
    return f"{rows}[1]"


_PROBLEM = f"""case when {_DIALECT} = 0 then case when coalesce(len(messages), 0) < 1 then 'messages_not_nonempty_list' else
 {_bad(f"case when messages[i].role is null or messages[i].role not in ({_ROLES},'human','gpt') then 'invalid_role' when len(messages[i].calls) > 0 and trim(messages[i].calls[1].name) = '' then 'invalid_tool_call_0' end", "message")} end
 when {_DIALECT} = 1 then case when coalesce(len(messages), 0) < 1 then 'conversations_not_nonempty_list' else {_bad("case when messages[i].role is null or messages[i].content is null then 'invalid_fields' end", "conversation")} end
 when {_DIALECT} = 2 then case when messages is null then 'invalid_instruction' when len(messages) < 1 then 'content_not_nonempty_list' else {_bad("case when coalesce(messages[i].role, '') = '' then 'missing_class' end", "content")} end
 else case when {strip(f"coalesce({_FIRST('user')}, '')")} = '' then 'invalid_instruction' when {strip(f"coalesce({_FIRST('assistant')}, '')")} = '' then 'invalid_text' end end"""
_KEPT = f"""case when {_DIALECT} = 0 then messages when {_DIALECT} = 1 then list_concat([{{'role': 'system', 'content': 'Be brief.', 'calls': []}}], list_filter(messages, lambda m: m.role in ({_ROLES})))
 when {_DIALECT} = 2 then list_filter(messages, lambda m: m.role in ('user', 'assistant', 'tool')) else [{{'role': 'user', 'content': {_FIRST('user')}, 'calls': []}}, {{'role': 'assistant', 'content': {_FIRST('assistant')}, 'calls': []}}] end"""


@query(f"""
with c as (select * from {CALLED} where id is not null), p as (select *, {_PROBLEM} why from c), k as (select *, case when why is null then {_KEPT} end kept from p),
r as (select *, coalesce(why, case when len(kept) = 0 or kept is null then 'unsupported_record' end) reason from k)
select 'src:a:unavailable:' || id id, reason, case when reason is null then array_to_string(list_transform(kept, lambda m: m.role), '>') end roles,
 case when reason is null then array_to_string(list_transform(kept, lambda m: coalesce(m.content, '')), ' ') else '' end contents,
 case when reason is null and {_DIALECT} = 0 then {_NC}::int else 0 end calls, coalesce(case when {_DIALECT} = 0 and {strip("coalesce(license, '')")} <> '' then license end, 'open') as license from r""")
def normalized_records(spark, d):
    """All records written as raw lines in four dialects and normalized again."""
    rows = records.normalized(raw_lines(spark, d), "line", "src", "a", license="open")
    return rows.select("id", "reason", F.array_join(F.transform("messages", lambda m: m["role"]), ">").alias("roles"), records.contents("messages").alias("contents"), F.size("tool_calls").alias("calls"), "license")


@query(f"with c as (select * from {CALLED} where id is not null) select {_PROBLEM} reason, count(*) n from c group by 1")
def validation_counts(spark, d):
    """Raw lines by what is wrong with them."""
    return corpus.counted(raw_lines(spark, d).select(records.problem(V.parsed("line")).alias("reason")), "reason")


@query(f"""
with c as (select * from {CALLED} where id is not null), p as (select *, {_PROBLEM} why from c), k as (select *, case when why is null then {_KEPT} end m from p)
select 'src:a:unavailable:' || id id, 'src' as source, 'a' as source_alias, 'sub' as subset, list_contains(list_transform(m, lambda v: v.role), 'user') user_goal_present, len(list_filter(m, lambda v: v.role = 'tool'))::int results
from k where why is null and len(m) > 0""")
def record_metadata(spark, d):
    """Provenance and evidence of all normalized records."""
    rows = records.normalized(raw_lines(spark, d), "line", "src", "a", subset="sub").filter("reason is null")
    return rows.select("id", "metadata.source", "metadata.source_alias", "metadata.subset", "metadata.agentic_flow.user_goal_present", F.size("tool_results").alias("results"))


# Keys, duplicates, statistics, and the pipeline


_TEXT = norm("concat_ws(' ', " + CONTENTS + ", case when {nt} > 0 then array_to_string(list_transform(list_filter(messages, lambda m: m.role = 'tool'), lambda m: to_json({{'content': coalesce(m.content, ''), 'role': m.role}})::varchar), ' ') end)").replace("{nt}", _NT).replace("{{", "{").replace("}}", "}")
_EXACT = "sha256(coalesce(to_json(list_transform(coalesce(messages, []), lambda m: {'c': m.content, 'r': m.role}))::varchar, ''))"
_DUPLICATES = """fs as (select *, first_value(id) over w fd, first_value(e) over w fe from k window w as (partition by t order by id)),
u as (select *, case when id = fd then null when e = fe then 'exact_duplicate' else 'normalized_duplicate' end why from fs)"""


@query(f"with k as (select id, {_TEXT} t, {_EXACT} e from {ONE} where id is not null), {_DUPLICATES} select id, why reason from u")
def record_duplicates(spark, d):
    return corpus.duplicate_reasons(one_records(spark, d).withColumn("messages", records.canonical("messages")))


@query()
def record_near_duplicates(spark, d):
    """The ordered decision of exact, normalized and near (matching blocks to 0.92)."""
    return corpus.duplicate_reasons(one_records(spark, d).withColumn("messages", records.canonical("messages")), near=0.92)


def _counter(name: str, item: str, source: str) -> str:
    return f"union all select '{name}', {item}, count(*)::double from {source} group by 2"


@query(f"""
with c as (select *, {_NC} nc, {_CONTENT_CHARS} cc, {_ARGUMENTS} ac, {_RESULTS} rc from {CALLED} where id is not null), s as (select count(*) n, sum(cc)::double cc, sum(ac)::double ac, sum(rc)::double rc, sum(nc)::double nc, round(avg(quality_score), 4) q from c)
select 'records' counter, '' as name, n::double as value from s union all select 'characters', '', cc from s union all select 'tool_argument_characters', '', ac from s union all select 'tool_result_characters', '', rc from s union all select 'tool_calls', '', nc from s
union all select 'estimated_tokens', '', round_even((cc + ac) / 4, 0) from s union all select 'estimated_tokens_with_results', '', round_even((cc + ac + rc) / 4, 0) from s union all select 'average_quality_score', '', q from s
{_counter('sources', "coalesce(source, 'unknown')", 'c')} {_counter('categories', "coalesce(nullif(task_type, ''), 'UNCLASSIFIED')", 'c')}
{_counter('roles', "coalesce(role, 'unknown')", '(select unnest(list_transform(messages, lambda m: coalesce(m.role, $$unknown$$))) as role from c)')}
{_counter('tool_names', 'tool', "(select unnest(flatten(list_transform(messages, lambda m: list_transform(m.calls, lambda v: v.name)))) tool from c)")}""")
def corpus_statistics(spark, d):
    return corpus.statistics(called(spark, d))


@query(f"""
with t as (select doc_id, coalesce(upper(trim(replace(replace(lang, '-', '_'), ' ', '_'))), 'UNCLASSIFIED') c from documents),
n as (select c, count(*) n from t group by 1), w(c, w) as (values ('EN', 0.5), ('FR', 0.3), ('DE', 0.2)),
q as (select n.c, n.n, least(n.n, coalesce(floor(600 * w.w / 1.0), 0))::bigint q from n left join w using (c)),
g as (select *, (600 - sum(q) over ())::bigint missing, coalesce(sum(n - q) over (order by n - q desc, c desc rows between unbounded preceding and 1 preceding), 0)::bigint before from q),
k as (select c, (q + greatest(0, least(n - q, missing - before)))::bigint taken from g)
select doc_id, c category from t join k using (c) qualify row_number() over (partition by c order by doc_id) <= any_value(taken) over (partition by c)""")
def mixture_sample(spark, d):
    """The rows of a mixture of 600 documents by language."""
    rows = table(spark, d, "documents").withColumn("category", F.upper(F.trim(F.translate("lang", "- ", "__"))))
    return corpus.mixture(rows, "category", "doc_id", {"EN": 0.5, "FR": 0.3, "DE": 0.2}, 600).select("doc_id", "category")


@query("""
with t as (select doc_id, coalesce(source, '(null)') s, coalesce(upper(lang), 'UNCLASSIFIED') c from documents), r as (select *, row_number() over (partition by s order by doc_id) - 1 round from t)
select doc_id, c category from r qualify row_number() over (partition by c order by round, s, doc_id) <= least(count(*) over (partition by c), case c when 'EN' then 100 when 'FR' then 50 else 0 end)""")
def interleaved_mixture(spark, d):
    """A mixture by language whose rows come from the sources in turn; targets that can be met exactly."""
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("(null)")).alias("s"), F.upper("lang").alias("category"))
    counts = {r[0]: r[1] for r in rows.filter("category in ('EN', 'FR')").groupBy("category").count().collect()}
    en, fr = min(100, counts.get("EN", 0)), min(50, counts.get("FR", 0))
    if en + fr == 0:
        return rows.filter("false").select("doc_id", "category")
    return corpus.mixture(rows, "category", "doc_id", {"EN": float(en), "FR": float(fr)}, en + fr, "s").select("doc_id", "category")


@query("select doc_id, source, row_number() over (partition by source order by doc_id) - 1 round from documents where source is not null")
def round_robin(spark, d):
    return corpus.interleaved(table(spark, d, "documents").filter("source is not null"), "source", "doc_id").select("doc_id", "source", "round")


_SPELLED = "case id_ when 0 then task_type when 1 then lower(replace(task_type, '_', '-')) else ' ' || replace(task_type, '_', ' ') || case when task_type in ('WEB_TASK', 'AGENT_TRAJECTORY') then 's' else '' end end"
_UPPER = "upper(replace(replace(trim(x), '-', '_'), ' ', '_'))"


@query(f"with s as (select task_type, coalesce(length(id), 0) % 3 id_ from records), t as (select {_SPELLED} x from s), u as (select {_UPPER} c from t) select case c when 'AGENT_TRAJECTORIES' then 'AGENT_TRAJECTORY' when 'WEB_TASKS' then 'WEB_TASK' when 'TOOL_USAGE' then 'TOOL_USE' else c end category, count(*) n from u group by 1")
def canonical_categories(spark, d):
    """Labels spelled in three ways (by the length of ids), and counted by category."""
    rows = table(spark, d, "records").withColumn("id_", F.coalesce(F.length("id"), F.lit(0)) % 3)
    return corpus.counted(rows.select(V.canonical_category(F.expr(_SPELLED)).alias("category")), "category")


_PLAIN = f"(select * replace (list_transform(messages, lambda m: {{'role': m.role, 'content': m.content, 'calls': []}}) as messages) from {ONE} where id is not null)"
_PREPARED_LABEL = _OWN.replace(" || ':source-provided'", "") + " " + " ".join(f"when {any_sql('lx', w)} then '{c}'" for c, _, w in records.KEYWORDS) + f" when coalesce(len(messages), 0) > 2 then 'AGENT_TRAJECTORY' when {any_sql('lx', records.REASONING)} then 'REASONING'"


@query(f"""
with c as {_PLAIN}, {_JUDGED.replace("list_transform(messages[1:k], lambda m: len(m.calls))", "[0]").replace(_NC, "0")}, k as (select id, {_TEXT} t, {_EXACT} e from sc where reason is null), {_DUPLICATES},
a as (select sc.*, lower(x) lx, coalesce(sc.reason, u.why) fate, {UNIT.format("sc.id")} u01 from sc left join u using (id))
select fate reason, case when fate is null then case when u01 < 0.8 then 'train' when u01 < 0.9 then 'validation' else 'test' end end part, case {_PREPARED_LABEL} end as label, count(*) records, round(avg(score), 4) score from a group by 1, 2, 3""")
def prepared_corpus(spark, d):
    """Filter, classification, deduplication and split over all records: rows by reason, part and label."""
    rows = table(spark, d, "records").withColumn("messages", records.canonical("messages")).withColumn("source", F.lit(""))
    return prepare.prepared(rows).groupBy("reason", "part", "label").agg(F.count("*").alias("records"), F.round(F.avg("score"), 4).alias("score"))


@query()
def pipeline_counters(spark, d):
    """The whole pipeline from raw lines in four dialects to the mixture: rows by stage and outcome."""
    out = prepare.whole(raw_lines(spark, d), {"DATA_PROCESSING": 0.3, "FILE_OPERATIONS": 0.3, "TOOL_USE": 0.4}, 400)
    return out.counters


@query()
def pipeline_statistics(spark, d):
    """Statistics of the mixture that the whole pipeline makes."""
    return prepare.whole(raw_lines(spark, d), {"DATA_PROCESSING": 0.3, "FILE_OPERATIONS": 0.3, "TOOL_USE": 0.4}, 400).statistics
