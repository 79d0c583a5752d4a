"""Curated sets of question and answer pairs: near-duplicates in order, packages, verification, exemplars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, space_shingles, stripped, word_shingles
from ..functions.udfs import code_report, nfkc
from ..functions.values import parsed, seeded_split
from ..storage import store
from . import corpus, pairs
from .ranking import global_numbers, numbers_within


def folded(c: Column | str) -> Column:
    """Compatibility form, lower case, white space collapsed; empty for null."""
    from ..functions.text import normalized

    return normalized(nfkc(F.coalesce(col(c), F.lit(""))))


def content_key(instruction: Column | str, response: Column | str) -> Column:
    """SHA-256 of both folded texts."""
    return F.sha2(F.concat(folded(instruction), F.lit("\x1f"), folded(response)), 256)


def near_first(rows: DataFrame, order: str, shingles: Column, threshold: float) -> DataFrame:
    """(order, by) of rows dropped in turn: each stays unless its shingles match those of a row kept before it; ``by`` is the first such.

    Rows with equal shingles are one class, led by the first; what drops the
    leader drops the class, and a leader that stays drops the others.
    """
    sets = store(corpus._sets(rows, order, shingles))
    classes = store(sets.groupBy("c").agg(F.min("key").alias("key"), F.first("s").alias("s")))
    dropped = corpus.greedy_dropped(corpus._set_pairs(classes.select("key", "s"), threshold)).select(F.col("b").alias("leader"), "by")
    members = sets.select("key", "c").join(classes.select("c", F.col("key").alias("leader")), "c").join(dropped, "leader", "left")
    return members.filter(F.col("by").isNotNull() | (F.col("key") != F.col("leader"))).select(F.col("key").alias(order), F.coalesce("by", "leader").alias("by"))


def duplicate_pairs(rows: DataFrame, order: str, threshold: float = 0.85) -> DataFrame:
    """(order, reason, by) of pairs (order, instruction, response): exact_duplicate by the folded texts, near_duplicate by word shingles of a pair kept before; by is null for exact ones and those kept.

    An exact copy of a pair that was itself dropped as near is near too.
    """
    some = store(rows.filter(F.col(order).isNotNull()).select(F.col(order).alias("o"), content_key("instruction", "response").alias("k"), folded(F.concat(F.coalesce("instruction", F.lit("")), F.lit("\n"), F.coalesce("response", F.lit("")))).alias("t")))
    leaders = some.groupBy("k").agg(F.min_by(F.struct("o", "t"), "o").alias("r")).select("k", "r.*")
    near = near_first(leaders.select("o", "t"), "o", word_shingles("t"), threshold)
    judged = some.select("o", "k").join(leaders.select("k", F.col("o").alias("first")), "k").join(near.select(F.col("o").alias("first"), "by"), "first", "left")
    reason = F.when(F.col("by").isNotNull(), "near_duplicate").when(F.col("o") != F.col("first"), "exact_duplicate")
    return judged.select(F.col("o").alias(order), reason.alias("reason"), "by")


def built(messages: DataFrame, least_shared: float = 0.85, seed: int = 20260926) -> DataFrame:
    """(conversation_id, user_id, assistant_id, instruction, response, reason, part) of all pairs of transcripts: extracted, judged, made unique and split.

    The order of pairs is that of (conversation_id, assistant_id).
    """
    found = pairs.extracted(messages).withColumn("record_id", F.concat_ws(":", "conversation_id", "assistant_id"))
    judged = store(found.withColumn("broken", pairs.reject_reason("instruction", "response")))
    unique = duplicate_pairs(judged.filter("broken is null").select("record_id", "instruction", "response"), "record_id", least_shared)
    out = judged.join(unique, "record_id", "left").withColumn("reason", F.coalesce("broken", "reason"))
    return out.withColumn("part", F.when(F.col("reason").isNull(), seeded_split("record_id", seed))).drop("broken", "by")


PACKAGE_REASONS = ("instruction_too_short", "response_too_short", "no_domain_match", "different_domain", "below_quality_floor", "near_duplicate")


def package_reason(instruction: Column | str, response: Column | str, domain: str | None = None, least: float = 0.6) -> Column:
    """The first rule of a package that a pair breaks, near-duplicates aside; null if none."""
    q, a = F.coalesce(col(instruction), F.lit("")), F.coalesce(col(response), F.lit(""))
    own = pairs.domain(q, a)
    out = F.when(F.length(q) < 40, "instruction_too_short").when(F.length(a) < 200, "response_too_short").when(own.isNull(), "no_domain_match")
    if domain is not None:
        out = out.when(own != domain, "different_domain")
    return out.when(pairs.signal_score(a) < least, "below_quality_floor")


def packaged(rows: DataFrame, order: str, domain: str | None = None, least: float = 0.6, threshold: float = 0.8) -> DataFrame:
    """(order, domain, score, reason) of pairs (order, instruction, response) for a package: reason is null for those kept.

    Near-duplicates are judged in order among the pairs that pass the rules, by
    runs of six words between blanks.
    """
    some = store(rows.select(order, "instruction", "response", pairs.domain("instruction", "response").alias("domain"), pairs.signal_score("response").cast("double").alias("score"), package_reason("instruction", "response", domain, least).alias("broken")))
    left = some.filter("broken is null").select(order, folded(F.concat_ws(" ", F.coalesce("instruction", F.lit("")), F.coalesce("response", F.lit("")))).alias("t"))
    near = near_first(left, order, space_shingles("t"), threshold).select(order, F.lit("near_duplicate").alias("near"))
    return some.join(near, order, "left").select(order, "domain", "score", F.coalesce("broken", "near").alias("reason"))


def package_stats(package: DataFrame) -> DataFrame:
    """(metric, name, value): read, kept and dropped pairs, retention with four places, drops by reason, kept by domain."""
    kept = F.col("reason").isNull()
    one = lambda metric, name: F.struct(F.lit(metric).alias("metric"), F.coalesce(name, F.lit("")).alias("name"))
    rows = package.select(F.explode(F.array(one("read", F.lit("")), F.when(kept, one("kept", F.lit(""))).otherwise(one("dropped", F.lit(""))), F.when(kept, one("domain", F.col("domain"))).otherwise(one("reason", F.col("reason"))))).alias("x"))
    counts = rows.groupBy("x.metric", "x.name").agg(F.count("*").cast("double").alias("value"))
    total = package.agg(F.count("*").alias("n"), F.count_if(kept).alias("k")).filter("n > 0")
    return counts.unionByName(total.select(F.lit("retention").alias("metric"), F.lit("").alias("name"), F.round(F.col("k") / F.col("n"), 4).alias("value")))


def strided(rows: DataFrame, order: str, count: int) -> DataFrame:
    """About ``count`` rows spread evenly over a whole-numbered order: every n-th, the first ``count`` of them."""
    total = rows.count()
    stride = max(1, total // max(1, count))
    return global_numbers(rows, order, "_n").filter((F.col("_n") % stride == 0) & (F.col("_n") / stride < count)).drop("_n")


# Verification

#: Modules of third parties that code is known to ask for.
KNOWN_MODULES = tuple("numpy pandas scipy matplotlib sklearn torch tensorflow keras requests bs4 selenium flask django sqlalchemy pymongo boto3 PIL cv2 seaborn plotly nltk spacy transformers fastapi pydantic pytest yaml toml redis celery psycopg2".split())
BUCKETS = ("verified", "failed", "timeout", "unverifiable", "no_code", "unsafe", "not_executed")


def missing_modules(imports: Column | str, installed: tuple[str, ...] = ()) -> Column:
    """Known modules of third parties among the imports that aren't installed, sorted."""
    return F.array_sort(F.array_intersect(F.array(*[F.lit(m) for m in KNOWN_MODULES if m not in installed]), col(imports)))


def bucketed(rows: DataFrame, key: str, response: str, installed: tuple[str, ...] = ()) -> DataFrame:
    """(key, bucket, detail) of responses, none of which is executed: no_code, unsafe, unverifiable or not_executed."""
    some = rows.select(F.col(key), F.col(response).alias("_a"), code_report(F.coalesce(response, F.lit(""))).alias("_c"))
    missing = missing_modules("_c.imports", installed)
    blank = F.coalesce(F.col("_a") == "", F.lit(True))
    bucket = F.when(blank | F.col("_c.code").isNull(), "no_code").when(F.col("_c.refusal") != "", "unsafe").when(F.size(missing) > 0, "unverifiable").otherwise("not_executed")
    detail = F.when(blank, "empty response").when(F.col("_c.code").isNull(), "no extractable python").when(F.col("_c.refusal") != "", F.col("_c.refusal")).when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))).otherwise("pass --execute")
    return some.select(key, bucket.alias("bucket"), detail.alias("detail"))


def verification_report(buckets: DataFrame) -> DataFrame:
    """(examined, <buckets>, executable, rate) in one row; the rate is of those that could be executed, null if there are none."""
    count = lambda b: F.count_if(F.col("bucket") == b)
    run = count("verified") + count("failed") + count("timeout")
    rate = F.when(run > 0, F.bround((count("verified").cast("decimal(18,0)") / F.greatest(run, F.lit(1)).cast("decimal(18,0)")), 4).cast("double"))
    return buckets.agg(F.count("*").alias("examined"), *[count(b).alias(b) for b in BUCKETS], run.alias("executable"), rate.alias("rate"))


def first_answer(messages: Column | str) -> Column:
    """The content of the first assistant message; empty if there is none."""
    return F.coalesce(F.try_element_at(F.transform(F.filter(col(messages), lambda m: m["role"] == "assistant"), lambda m: m["content"]), F.lit(1)), F.lit(""))


# Runs and feedback


def exemplars(runs: DataFrame, k: int = 3, chars: int = 400) -> DataFrame:
    """The k best runs (run_id, goal, answer, auto_score, human_score, verdict, created_at): those judged by people first, then by score, then the newest; answers are cut to ``chars``."""
    rows = runs.filter("verdict = 'exemplar'").orderBy(F.col("human_score").isNull(), F.desc(F.coalesce("human_score", F.lit(0))), F.desc("auto_score"), F.desc("created_at"), F.asc("run_id")).limit(k)
    return rows.withColumn("answer", F.substring("answer", 1, chars))


def newest(rows: DataFrame, order: str, tie: str, k: int) -> DataFrame:
    """The k newest rows of a listing."""
    return rows.orderBy(F.desc(order), F.asc(tie)).limit(k)


def imported_runs(lines: DataFrame, known: DataFrame) -> DataFrame:
    """(run_id, goal, answer, steps, tools) of log lines (line) of runs that aren't known (run_id) yet; lines without run, goal or answer are passed over; of a run logged twice the first line (by its text) counts."""
    v = F.col("v")
    text = lambda k: F.coalesce(F.try_variant_get(v, f"$.{k}", "string"), F.lit(""))
    has = lambda k: F.try_variant_get(v, f"$.{k}", "variant").isNotNull()
    rows = lines.select("line", parsed("line").alias("v")).filter(has("run_id") & has("goal") & has("answer"))
    steps = F.coalesce(F.try_variant_get(v, "$.steps", "array<variant>"), F.array().cast("array<variant>"))
    tools = F.flatten(F.transform(steps, lambda s: F.coalesce(F.try_variant_get(s, "$.tools", "array<string>"), F.array().cast("array<string>"))))
    found = rows.select("line", text("run_id").alias("run_id"), text("goal").alias("goal"), text("answer").alias("answer"), F.size(steps).alias("steps"), tools.alias("tools"))
    one = found.groupBy("run_id").agg(F.min(F.struct("line", "goal", "answer", "steps", "tools")).alias("r")).select("run_id", "r.goal", "r.answer", "r.steps", "r.tools")
    return one.join(known.select("run_id").distinct(), "run_id", "left_anti")


# Preparation of raw pairs


def prepared_pairs(rows: DataFrame, dataset: str, order: str, longest_instruction: int = 12_000, longest_text: int = 48_000) -> DataFrame:
    """(id, messages, reason) of raw pairs (id, instruction, text, <order>): ids are qualified, texts too long or blank rejected; of equal ids the first accepted stays."""
    blank = lambda c: F.coalesce(stripped(c) == "", F.lit(True))
    broken = (
        F.when(blank(F.col("instruction")), "invalid_instruction").when(blank(F.col("text")), "invalid_text").when(blank(F.col("id")), "invalid_id")
        .when(F.length("instruction") > longest_instruction, "instruction_too_long").when(F.length("text") > longest_text, "text_too_long")
    )
    some = rows.select(F.concat_ws(":", F.lit(dataset), "id").alias("id"), pairs.record("instruction", "text").alias("messages"), broken.alias("reason"), F.col(order).alias("_o"))
    good = some.filter("reason is null").groupBy("id").agg(F.min_by("messages", "_o").alias("messages"), F.lit(None).cast("string").alias("reason"))
    return good.unionByName(some.filter("reason is not null").select("id", "messages", "reason"))


def accepted(rows: DataFrame, order: str, most: int) -> DataFrame:
    """The first ``most`` rows in a whole-numbered order; all for 0."""
    return rows if most == 0 else global_numbers(rows, order, "_n").filter(F.col("_n") < most).drop("_n")


def capped(rows: DataFrame, group: list[str], order: str, most: int) -> DataFrame:
    """The first ``most`` rows of every group in a whole-numbered order."""
    return numbers_within(rows, group, order, "_n").filter(F.col("_n") < most).drop("_n")
