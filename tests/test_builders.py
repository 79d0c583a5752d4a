"""Ordered decisions, builders, checks and plans against brute force on small data."""

import json
import random
import re
import unicodedata

import pytest
from millrace import storage
from millrace.functions import udfs
from millrace.functions import values as V
from millrace.operators import corpus, curation, graph, ledger, pairs, ranking, records
from millrace.plans import prepare
from millrace.sources import scans, sinks
from pyspark.sql import functions as F


def fold(t):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t or "").lower()).strip()


def runs(t, size, pattern):
    w = re.findall(pattern, t)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def share(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice("uvwxyz") * 3
    return out


def family(rng, base=12, copies=5, length=40):
    rows = []
    for i in range(base):
        words = [rng.choice("abcdefghijklmno") * rng.randint(1, 3) for _ in range(length)]
        rows.append(" ".join(words))
        for _ in range(rng.randint(0, copies)):
            words = edited(rng, words, rng.randint(0, 2))
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return rows


def test_pair_duplicates_in_order(spark):
    rng = random.Random(4)
    texts = family(rng)
    rows = [(f"k{i:03d}", t.split(" ", 3)[0] + " ask", t) for i, t in enumerate(texts)] + [("k900", None, None), ("k901", "", ""), ("k902", "ﬁne  Ask", "X"), ("k903", "fine ask", "x")]
    kept, seen, wanted = [], set(), {}
    for k, q, a in rows:
        key, s = (fold(q), fold(a)), runs(fold((q or "") + "\n" + (a or "")), 5, "[a-z0-9]+")
        near = next((o for o, x in kept if share(s, x) >= 0.6), None)
        reason = "exact_duplicate" if key in seen else "near_duplicate" if near else None
        wanted[k] = (reason, near if reason == "near_duplicate" else None)
        if reason is None:
            seen.add(key)
            kept.append((k, s))
    df = spark.createDataFrame(rows, "o string, instruction string, response string")
    got = {r.o: (r.reason, r.by) for r in curation.duplicate_pairs(df, "o", 0.6).collect()}
    assert got == wanted and {"exact_duplicate", "near_duplicate", None} == {r for r, _ in wanted.values()}


def test_record_duplicates_in_order(spark):
    import difflib

    rng = random.Random(5)
    texts = [" ".join(edited(rng, "one of the long texts that are about the same thing and differ little".split(), rng.randint(0, 2))) for _ in range(14)] + ["A  b", "a b", "A  b", "", None]
    rows = [(f"r{i:02d}", [("user", t)]) for i, t in enumerate(texts)] + [("r80", []), ("r81", None)]
    accepted, wanted = [], {}
    for k, m in rows:
        text = re.sub(r"\s+", " ", " ".join(c or "" for _, c in m or []).lower()).strip()
        exact = json.dumps(m)
        signature = lambda t: runs(t, 5, r"\w+") if len(re.findall(r"\w+", t)) >= 5 else {t} if t else set()
        reason = None
        if any(e == exact for e, _ in accepted) or m is None and any(e == "[]" for e, _ in accepted):
            reason = "exact_duplicate"
        elif any(t == text for _, t in accepted):
            reason = "normalized_duplicate"
        elif any(signature(text) & signature(t) and difflib.SequenceMatcher(None, text, t).ratio() >= 0.92 for _, t in accepted):
            reason = "near_duplicate"
        wanted[k] = reason
        if reason is None:
            accepted.append((exact, text))
    df = spark.createDataFrame(rows, "id string, messages array<struct<role:string,content:string>>").withColumn("messages", records.canonical("messages"))
    assert dict(corpus.duplicate_reasons(df, near=0.92).collect()) == wanted
    assert {"exact_duplicate", "normalized_duplicate", "near_duplicate", None} <= set(wanted.values())


def test_ratio_filter_loses_nothing(spark):
    import difflib

    rng = random.Random(8)
    rows = []
    for _ in range(300):
        x = "".join(rng.choice("abcdef gh") for _ in range(rng.randint(0, 120)))
        y = "".join(c if rng.random() > 0.06 else rng.choice(["", c + "z", "q"]) for c in x)
        rows.append((x, y if rng.random() > 0.3 else x[::-1]))
    got = [r[0] for r in spark.createDataFrame(rows, "x string, y string").select(udfs.sequence_ratio_from("x", "y", F.lit(0.9))).collect()]
    wanted = [difflib.SequenceMatcher(None, x, y).ratio() for x, y in rows]
    assert [g is not None and g >= 0.9 for g in got] == [w >= 0.9 for w in wanted] and any(g is None for g in got)


def test_similar_texts_in_blocks_equal_brute_force():
    import difflib

    from millrace.functions import alike

    rng, texts = random.Random(9), []
    for i in range(60):
        x = "".join(rng.choice("abcdefghij  klmno") for _ in range(rng.choice((3, 20, 60, 127, 150, 500, 1000))))
        texts += [x] + ["".join(c if rng.random() > rate else rng.choice(["", "", c + "z", "q"]) for c in x) for rate in (0.02, 0.07, 0.12)]
    rows = sorted((len(t), f"k{i % 7}-{i}", t) for i, t in enumerate(texts))
    keys, some = [k for _, k, _ in rows], [t for *_, t in rows]
    wanted = {(a, b) for a, s in zip(keys, some) for b, t in zip(keys, some) if a < b and difflib.SequenceMatcher(None, t, s).ratio() >= 0.92}
    got = []
    for c in {alike.length_class(n) for n, *_ in rows}:
        own = [(k, t) for n, k, t in rows if alike.length_class(n) == c]
        for i in range(0, len(own), 17):
            block = alike.Block([k for k, _ in own[i : i + 17]], [t for _, t in own[i : i + 17]], c, 0.92)
            got += [r[:2] for r in alike.compared(block, keys, some, [alike.run_numbers(t) for t in some])]
    assert sorted(got) == sorted(wanted) and len(wanted) > 50


def test_signs_find_all_alike_texts_among_few():
    import difflib

    from millrace.functions import alike

    rng, texts = random.Random(11), []
    words = ["".join(rng.choice("eeeeetttaaoooiinnsshhrrddllu" + "cmfwypvbgkjqxz."[: rng.choice((0, 6, 15))]) for _ in range(rng.randint(2, 9))) for _ in range(400)]
    for i in range(30):
        x = " ".join(rng.choice(words) for _ in range(rng.choice((10, 45, 60, 200, 260))))
        texts += [x, x[: int(len(x) * 0.88)], x[len(x) // 9 :], x[40:] + x[:40], x + x[-len(x) // 8 :]] + ["".join(c if rng.random() > rate else rng.choice(["", c + "z", "q", "e"]) for c in x) for rate in (0.01, 0.03, 0.05, 0.08)]
    texts += ["e" * 300, "e" * 320, "e" * 150 + "t" * 160, "ab" * 200, "ab" * 210, "x"]
    rows = sorted((len(t), f"k{i % 7}-{i}", t) for i, t in enumerate(texts))
    keys, some = [k for _, k, _ in rows], [t for *_, t in rows]
    wanted = set()
    for b, s in zip(keys, some):
        matcher = difflib.SequenceMatcher(None, "", s)
        for a, t in zip(keys, some):
            if a > b and 0.85 * len(s) <= len(t) <= 1.18 * len(s):
                matcher.set_seq1(t)
                if matcher.quick_ratio() >= 0.92 and matcher.ratio() >= 0.92:
                    wanted.add((b, a))
    made = [alike.signs(some[i : i + 50], 0.92) for i in range(0, len(some), 50)]
    index = alike.Index(keys, some, *alike.joined([alike.columns(r, s) for r, _, s in made], [len(u) for _, u, _ in made]), 0.92)
    unsure = [k for k, u in zip(keys, (u for _, own, _ in made for u in own)) if u]
    others = [(k, t) for k, t in zip(keys, some) if k in set(unsure)]
    others = [k for k, _ in others], [t for _, t in others], [alike.run_numbers(t) for _, t in others]
    got, pairs = [], 0
    for c in {alike.length_class(n) for n, *_ in rows}:
        own = [(k, t) for n, k, t in rows if alike.length_class(n) == c]
        for i in range(0, len(own), 41):
            part = [k for k, _ in own[i : i + 41]], [t for _, t in own[i : i + 41]]
            got += [r[:2] for r in index.ratios(*part)]
            pairs += sum(1 for _ in index.alike(*part))
            for few in (alike.FEW, 0):
                alike.FEW, kept = few, alike.FEW
                whole = [r[:2] for r in alike.matched(*part, c, 0.92, others)]
                alike.FEW = kept
                assert sorted(whole) == sorted((b, a) for b, a in wanted if b in set(unsure) and a in set(part[0]))
    assert len(got) == len(set(got)) and set(got) == {(b, a) for b, a in wanted if b not in set(unsure)}
    assert len(got) > 120 and len(unsure) > 5 and pairs < 20 * len(wanted)


def test_similar_texts_shuffle_no_pairs(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    rows = [(i, "a sentence that all of them have " + " ".join(word() for _ in range(20))) for i in range(500)]
    rows += [(1000 + i, t.replace("z", "zz")) for i, t in rows[:20]]
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = shuffled()
    got = {(r.key_a, r.key_b) for r in corpus.similar_texts(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert got == {(i, 1000 + i) for i in range(20)}
    assert shuffled() - before < 4 * sum(len(t) for _, t in rows)


def test_package_and_report(spark):
    rng = random.Random(6)
    filler = " import numpy\nnumpy array matrix vector plot simulation "
    rows = [(i, "Please write a function for this numeric task " + t.split()[0], filler * 4 + t) for i, t in enumerate(family(rng, 8, 4, 60))] + [(900, "short", "x"), (901, None, None), (902, "A question that is long enough to be kept here", "no domain " * 40)]
    df = spark.createDataFrame(rows, "o long, instruction string, response string")
    got = {r.o: r for r in curation.packaged(df, "o", least=0.2).collect()}
    kept, wanted = [], {}
    for o, q, a in rows:
        reason = got[o].reason if got[o].reason in curation.PACKAGE_REASONS[:5] else None
        if reason is None:
            s = set()
            w = fold(f"{q} {a}").split()
            s = {tuple(w[i : i + 6]) for i in range(len(w) - 5)}
            reason = "near_duplicate" if any(share(s, x) >= 0.8 for x in kept) else None
            if reason is None:
                kept.append(s)
        wanted[o] = reason
    assert {o: r.reason for o, r in got.items()} == wanted and got[900].reason == "instruction_too_short" and got[902].reason == "no_domain_match"
    stats = {(r.metric, r.name): r.value for r in curation.package_stats(curation.packaged(df, "o", least=0.2)).collect()}
    assert stats["read", ""] == len(rows) and stats["kept", ""] == len(kept) and stats["retention", ""] == round(len(kept) / len(rows), 4)


def test_built_set(spark):
    long = "A full answer of more than eighty characters that says what to do and why it is to be done, number {}."
    rows = []
    for c in range(6):
        for i in range(8):
            rows.append((f"c{c}", f"m{i}", "user" if i % 2 == 0 else "assistant", f"How do I do the thing number {c * 10 + i} well, please?" if i % 2 == 0 else long.format(c * 3 + i) * (1 + i), f"2024-01-01 0{i}:00:00"))
    df = spark.createDataFrame(rows, "conversation_id string, id string, role string, content string, at string").withColumn("at", F.col("at").cast("timestamp"))
    got = curation.built(df).collect()
    assert len(got) == 24 and all((r.reason is None) == (r.part is not None) for r in got)
    again = {(r.conversation_id, r.assistant_id): r.part for r in curation.built(df.repartition(3)).collect()}
    assert again == {(r.conversation_id, r.assistant_id): r.part for r in got}


def test_previous_and_best_within(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "hot", "hot", "hot"]), i, rng.randint(0, 500), rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i long, t long, s double")
    got = {r.i: r.p for r in ranking.previous_within(df, ["g"], "t", F.col("i"), "p", 50, ("i",)).collect()}
    best = {(r.g, r["rank"]): r.i for r in ranking.best_within(df, ["g"], [F.desc("s"), F.asc("i")], 5).collect()}
    for g in ("a", "hot"):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]))
        assert [got[r[1]] for r in own] == [None, *[r[1] for r in own[:-1]]]
        assert [best[g, k] for k in range(1, 6)] == [r[1] for r in sorted(own, key=lambda r: (-r[3], r[1]))[:5]]
    posts = spark.createDataFrame([("t", i) for i in range(120)] + [("u", 1), ("u", 500)], "w string, k long")
    assert {(r.a, r.b) for r in ranking.salted_pairs(posts, "w", "k", size=10).collect()} == {(a, b) for a in range(120) for b in range(a + 1, 120)} | {(1, 500)}


def test_json_is_one_value(spark):
    rows = ['{"a":1}', '{"a":1} more', " [1, 2] ", "1,2", "1] , [2", "", "  ", None, '"x"', '{"a":1,"a":2}', "{", "null"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "x string").select(F.to_json(V.parsed("x"))).collect()]
    assert got == ['{"a":1}', None, "[1,2]", None, None, None, None, None, '"x"', None, None, "null"]


def test_schema_problems(spark):
    schema = {"type": "object", "required": ["q"], "additionalProperties": False, "properties": {"q": {"type": "string", "minLength": 2, "maxLength": 5}, "n": {"type": "integer"}, "k": {"enum": ["a", "b"]}, "l": {"type": "array", "items": {"type": "number"}}}}
    rows = {'{"q":"abc","n":1,"k":"a","l":[1,2.5]}': None, '{"q":"a"}': "input.q is too short", '{"q":"abcdef"}': "input.q is too long", "{}": "input.q is required", '{"q":"abc","z":1,"y":2}': "input contains unknown fields: y, z", '{"q":"abc","n":1.5}': "input.n must have type integer", '{"q":"abc","k":"c"}': "input.k is not an allowed value", '{"q":"abc","l":[1,"x"]}': "input.l[1] must have type number", "[1]": "input must have type object"}
    df = spark.createDataFrame([(r,) for r in rows], "x string").select(V.schema_problem(V.parsed("x"), schema))
    assert [r[0] for r in df.collect()] == list(rows.values())


def test_names_and_ids(spark):
    one = lambda c, rows: [r[0] for r in spark.createDataFrame([(r,) for r in rows], "x string").select(c).collect()]
    assert one(V.is_dataset_id("x"), ["a/b", "a", "a/..", "/b", None]) == [True, False, False, False, False]
    assert one(V.is_source_file("x"), ["a/b.jsonl", "/a", "a\\b", "a/../b", "", None]) == [True, False, False, False, False, False]
    assert one(V.subset_of("x"), ["data/raw/swe/raw/f.jsonl", "raw/f.a.jsonl", "f"]) == ["swe", "f.a", "f"]
    assert one(V.id_seconds("x"), ["run_1770000000000_000001a1b2c3", "1770000000000_000001a1b2c3", None]) == [1770000000.0, 0.0, 0.0]
    assert one(V.currency("x"), [" USD ", "", "x" * 17]) == ["USD", None, None]
    assert V.limit_left(0, 5) is None and V.limit_left(7, 5) == 2 and V.limit_left(3, 5) == 0
    with pytest.raises(ValueError):
        V.limit_left(-1, 0)
    assert [udfs.evaluated(x) for x in ("2**12", "9**12**1", "1e308*10", "10**12*10**12*10**12*10**12*10**12*10**12*10**12*10**12*10**12", "1+" * 150 + "1")] == [4096.0, 9.0**12, None, None, None]
    assert [udfs.refusal(x) for x in ("import os.path", "import subprocess as s", "from http.client import x", "a.b.rmtree(1)", "x = = 1")] == ["", "imports subprocess", "imports http.client", "calls .rmtree()", ""]
    assert one(udfs.pretty_json("x"), ['{"b":1,"a":[]}', "no"]) == ['{\n  "a": [],\n  "b": 1\n}', "no"]
    udfs.register(spark)
    assert [tuple(r) for r in spark.sql("select * from chunk_text('one two')").collect()] == [(0, "one two")]


def test_tasks(spark):
    rows = [("a", ["b", "x"], "pending", 0), ("b", ["c"], "done", 1), ("c", [], "done", 2), ("d", ["a"], "pending", 3), ("e", None, "pending", 4)]
    df = spark.createDataFrame(rows, "task_id string, depends_on array<string>, status string, position long")
    assert [r.task_id for r in graph.ordered(df).orderBy("place").collect()] == ["c", "b", "a", "d", "e"]
    assert sorted(r.task_id for r in graph.ready(df).collect()) == ["a", "e"]
    assert dict(graph.levels(df).collect()) == {"c": 0, "e": 0, "b": 1, "a": 2, "d": 3}
    with pytest.raises(ValueError, match="depends on itself"):
        graph.ordered(spark.createDataFrame([("a", ["b"], "pending", 0), ("b", ["a"], "pending", 1)], df.schema))
    with pytest.raises(ValueError, match="isn't ordered"):
        graph.ordered(df, largest=3)


def test_tool_calls_through_the_pipeline(spark):
    call = {"function": {"name": "open", "arguments": '{"p": 1}'}}
    sound = [{"role": "user", "content": "please open the file of the ledger"}, {"role": "assistant", "content": "", "tool_calls": [call]}, {"role": "tool", "content": "opened"}, {"role": "assistant", "content": "It is open now."}]
    silent = [{"role": "user", "content": "please open the file of the ledger again"}, {"role": "assistant", "content": " "}]
    lines = [("s1", 1, json.dumps({"id": "a", "messages": sound})), ("s1", 2, json.dumps({"id": "b", "messages": silent})), ("s2", 1, json.dumps({"id": "c", "messages": sound})), ("s2", 2, "no json"), ("s2", 3, None), (None, 1, json.dumps({"instruction": "why is it so", "text": "because"}))]
    out = prepare.whole(spark.createDataFrame(lines, "source string, row_number long, line string"), {"FILE_OPERATIONS": 1.0}, None)
    fate = {r.id: r for r in out.records.collect()}
    assert {k.split(":")[-1]: r.reason for k, r in fate.items() if ":row-" not in k} == {"a": None, "b": "empty_assistant", "c": "exact_duplicate"}
    good = fate["s1:unavailable:a"]
    assert good.flags == [] and good.score == 1.0 and good.label == "FILE_OPERATIONS"
    assert {(r.stage, r.counter): r.n for r in out.counters.collect()}["normalize", "malformed_json"] == 2
    stats = {(r.counter, r.name): r.value for r in out.statistics.collect()}
    assert stats["tool_names", "open"] == 1 and stats["tool_argument_characters", ""] == 7
    messages = out.records.filter("id = 's1:unavailable:a'")
    row = messages.select(records.trajectory_chars("messages").alias("n"), records.agentic_flow("messages").alias("f")).first()
    assert row.n == sum(len(m["content"]) for m in sound) + 7 + len('[{"content":"opened","role":"tool"}]')
    assert row.f.tool_selection_count == 1 and row.f.completion_evidence and row.f.next_action_evidence


def test_ledger_states(spark):
    log = spark.createDataFrame([("k", 1, "held"), ("k", 2, "settled"), ("l", 1, "held"), (None, 1, "held")], "key string, at int, state string")
    assert {r.key: r.state for r in ledger.last_state(log, "key", "at").collect()} == {"k": "settled", "l": "held"}
    rows = pairs.effective_score("x", F.lit(0.3))
    assert [r[0] for r in spark.createDataFrame([(5.0,), (9.0,), (None,), (-1.0,)], "x double").select(rows).collect()] == [1.0, 1.0, 0.3, 0.0]


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"b":1,"a":2}')
    (tmp_path / "b.txt").write_text("x")
    got = {r.uri.rsplit("/", 1)[-1]: r.text for r in scans.indexed_files(scans.whole_files(spark, str(tmp_path))).collect()}
    assert got == {"a.json": '{"a":2,"b":1}', "b.txt": "x"}
    (tmp_path / "s.toml").write_text("limit = 3\n")
    assert scans.settings(str(tmp_path / "s.toml"), {"limit": int}) == {"limit": 3}
    with pytest.raises(ValueError, match="unknown"):
        scans.settings(str(tmp_path / "s.toml"), {"cap": int})
    counters = spark.createDataFrame([("s", "kept", 2)], "stage string, counter string, n long")
    assert sinks.write_report(counters, str(tmp_path / "r.json")) == {"s": {"kept": 2}}
    df = spark.range(100).withColumnRenamed("id", "n")
    assert sinks.write_package(df, "n", str(tmp_path / "pack"), 10)["sample"]["records"] == 10
    sinks.append_log(df.limit(1), str(tmp_path / "log"))
    sinks.append_log(df.limit(1), str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 2
    rows = spark.createDataFrame([(1, "bad", "x"), (2, None, "y")], "row_number long, reason string, line string")
    sinks.write_rejects(rows, "reason", "line", str(tmp_path / "rej"))
    assert spark.read.text(str(tmp_path / "rej")).count() == 1


def test_stored_tables_are_deleted(spark):
    df = storage.store(spark.range(3))
    assert df.count() == 3 and storage.clean(spark) >= 1
    with pytest.raises(Exception):
        df.count()
