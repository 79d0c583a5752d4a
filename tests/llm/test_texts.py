"""Conversations, answers, personal information, pages and reading levels."""

import random
import re
import time
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from millrace.llm import boosting, conversations, crf, defects, linear, pages, pii, prose, reading, tokens


def test_conversations_equal_a_plain_loop(spark):
    rng = random.Random(1)
    roles = ["user", " User", "human", "assistant", "gpt", "system", "tool", "observation", "alien", None]
    rows, ids = [], []
    for c in range(120):
        for k in range(rng.randint(0, 7)):
            at = f"2024-01-01T{rng.randint(0, 3):02d}:00:0{rng.randint(0, 3)}{rng.choice(['Z', '+01:00', ''])}"
            row = (f"m{c}-{k}", f"c{c}", rng.choice(roles if c % 4 == 0 else roles[:5]), rng.choice(["text", "text", "", " ", "​", None]), at, None, f"2024-01-0{rng.randint(1, 3)} 00:00:00")
            rows += [row] * rng.randint(1, 2)
        ids.append((f"c{c}",))
    for k in range(300):  # a hot conversation over many partitions
        rows.append((f"h{k:04d}", "hot", "user" if k % 2 == 0 else "assistant", "x", "2024-01-01 00:00:00", None, "2024-01-01 00:00:00"))
    ids.append(("hot",))
    df = spark.createDataFrame(rows, "id string, conversation_id string, role string, content string, created_at string, metadata string, ingested_at string").selectExpr("*", "cast(ingested_at as timestamp) as i").drop("ingested_at").withColumnRenamed("i", "ingested_at")
    hours = {"Z": 0, "+01:00": -1, "": 0}
    expected = {}
    for (c,) in ids:
        own = sorted({((int(r[4][11:13]) + hours[r[4][19:]], r[4][14:19]), r[0], r[2], r[3]) for r in rows if r[1] == c}, key=lambda r: r[:2])
        said = [(conversations.SPEAKERS.get((r[2] or "").strip().lower()), bool((r[3] or "").strip(" ​"))) for r in own]
        events = [s for s, v in said if s == "user" or s == "assistant" and v]
        first = next((s for s, _ in said if s != "system"), "user")
        if not any(v and s in ("user", "assistant") for s, v in said):
            expected[c] = "empty"
        elif any(s is None for s, _ in said):
            expected[c] = "unknown_role"
        elif first != "user":
            expected[c] = "orphan_reply"
        elif any(s == "user" and (i + 1 == len(events) or events[i + 1] == "user") for i, s in enumerate(events)):
            expected[c] = "missing_reply"
        else:
            expected[c] = None
    got = {r.conversation_id: r.defect for r in conversations.judged(df, spark.createDataFrame(ids, "id string")).collect()}
    assert got == expected
    out = conversations.assembled(df, spark.createDataFrame(ids, "id string")).collect()
    hot = sorted((r.position, r.id) for r in out if r.conversation_id == "hot")
    assert hot == [(k + 1, f"h{k:04d}") for k in range(300)]
    assert {r.conversation_id for r in out} == {c for c, d in expected.items() if d is None}


def test_fragments_are_matched_by_suffix_and_prefix(spark):
    rows = []

    def fragment(conversation, day, numbers):
        rows.extend((conversation, f"m{i}", "user" if i % 2 == 0 else "assistant", "t", f"2024-01-01T{i:02d}:00:00Z", f"2024-02-{day:02d} 00:00:00") for i in numbers)

    fragment("A", 1, [0, 1, 2]), fragment("A", 2, [2, 3]), fragment("A", 3, [3, 4, 5])  # one path
    fragment("B", 1, [0, 1]), fragment("B", 2, [1, 2]), fragment("B", 3, [1, 3])  # two followers
    fragment("C", 1, [0, 1]), fragment("C", 2, [0, 1])  # equal
    fragment("D", 1, [0, 2]), fragment("D", 2, [1, 3])  # nothing in common
    fragment("E", 1, [0, 1, 2, 3]), fragment("E", 2, [1, 3, 5])  # common messages that are no suffix
    df = spark.createDataFrame(rows, "conversation_id string, id string, role string, content string, created_at string, ingested_at string").withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))
    got = {r.conversation_id: (r.fragments, r.paths, r.overlaps) for r in conversations.assembly(df).collect()}
    assert got == {"A": (3, 1, 2), "B": (3, 3, 2), "C": (2, 1, 1), "D": (2, 2, 0), "E": (2, 2, 0)}
    known = spark.createDataFrame([(x,) for x in "ABCDEF"], "id string")
    judged = {r.conversation_id: (r.messages, r.shared, r.defect) for r in conversations.judged(df, known).collect()}
    assert judged == {"A": (6, 2, None), "B": (4, 1, None), "C": (2, 2, None), "D": (4, 0, None), "E": (5, 2, None), "F": (0, 0, "empty")}
    assert [r.id for r in conversations.assembled(df, known).filter("conversation_id = 'D'").orderBy("position").collect()] == ["m0", "m1", "m2", "m3"]


def test_field_learns_a_chain():
    rng = np.random.default_rng(0)
    rows = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 300))])
    tags = np.zeros(rows[-1], np.int64)
    for a, b in zip(rows, rows[1:]):
        for i in range(a, b):
            tags[i] = rng.integers(0, 2) if i == a else tags[i - 1] if rng.random() < 0.95 else 1 - tags[i - 1]
    x = np.stack([np.ones(len(tags)), tags + rng.normal(0, 1.0, len(tags))], axis=1)
    chain = crf.Chain(2, 2)
    chain.fit(x, rows, tags)
    alone = (x[:, 1] > 0.5).astype(int)
    assert (chain.best(x, rows) == tags).mean() > (alone == tags).mean() + 0.1


ANSWER = "The index is rebuilt in one pass. Then the reviewer checks the list and closes the ticket."


def answers():
    rng = random.Random(3)
    words = "index shard ledger planner operator cache table entry schedule report".split()

    def sentence(end="."):
        return f"The {rng.choice(words)} of the {rng.choice(words)} was moved by the {rng.choice(words)} before the {rng.choice(words)} was closed{end}"

    plain = [(sentence("?"), " ".join(sentence() for _ in range(rng.randint(2, 6)))) for _ in range(300)]
    question = "How do I rebuild the index of the old shard before the planner closes it?"
    special = [
        (question, None, "empty_answer"), (question, " ​", "empty_answer"), (question, "N/A", "empty_answer"), (question, "(none)", "empty_answer"),
        (question, sentence() + " The planner of the", "truncated_answer"), (question, "Use this.\n```python\ndef f(x):\n    retu", "truncated_answer"), (question, sentence() + " The cache was,", "truncated_answer"),
        (question, "I'm sorry, but I cannot help with that request.", "refusal"), (question, "I am not able to discuss anything related to it. Please ask a specialist.", "refusal"),
        (question, question, "copied_question"), (question, "You asked: " + question, "copied_question"), (question, question.lower().replace(",", ""), "copied_question"),
        (question, "Der Index wird neu geladen und die Liste ist nicht leer. Bitte prüfen Sie den Eintrag zuerst.", "wrong_language"),
        ("Translate into German: the index is not empty and it is old.", "Der Index ist nicht leer und er ist alt.", None), (question, "You asked: " + question + " " + ANSWER, None),
        (question, "Sorry for the long answer; the short form is in the last line. " + ANSWER, None), (question, "You are not permitted to write there by default, yet a grant fixes it. " + ANSWER, None), (question, "Yes.", None), (question, ANSWER + " See run_notes.md", None),
    ]
    return plain, special


def test_defects():
    plain, special = answers()
    tagger = defects.Tagger()
    tagger.fit(plain + [(q, a) for q, a, _ in special] * 4)
    got = tagger.judge([(q, a) for q, a, _ in special])
    assert got == [d for _, _, d in special]
    assert sum(d is not None for d in tagger.judge(plain)) <= 3
    assert tagger.judge([(None, None), (None, "Some answer here."), ("", "word " * 50_000)])[0] == "empty_answer"


def test_sentence_ends_are_counted_in_all_other_pairs(spark):
    plain, special = answers()
    lists = [(q, "- move the ledger\n- close the shard\n- rebuild the schedule") for q, _ in plain[:60]]
    cut = [(q, f"- move the ledger\n- close the shard\n- rebuild the sch{'abcdefghij'[i]}e") for i, (q, _) in enumerate(plain[:10])]
    given = plain + lists + cut + [(q, a) for q, a, _ in special]
    rows = [(i, "records", f"r{i}", q, a) for i, (q, a) in enumerate(given)]
    df = spark.createDataFrame(rows, "row long, tbl string, id string, question string, answer string")
    ends = defects.Ends()
    for _, a in given:
        for clause, code, _ in defects.clauses(a) if not defects.is_nothing(a) else ():
            if not code:
                ends.add(clause, prose.WORDS.findall(clause))
    for r in defects.counted(df).collect():
        answer = given[r.row][1]
        found = defects.clauses(answer) if not defects.is_nothing(answer) else []
        last = prose.WORDS.findall(found[-1][0]) if found else []
        assert (r.counts or []) == ([n for gram in defects.Ends.grams(last) for n in (ends.all[gram], ends.last[gram])] if last else [])
    got = {r.id: r.defect for r in defects.judged(df.drop("row").unionByName(df.drop("row"))).collect()}
    at = len(plain) + len(lists)
    assert [got.get(f"r{i}") for i in range(at, at + len(cut))] == ["truncated_answer"] * len(cut)
    assert not any(f"r{i}" in got for i in range(len(plain), at))


PIECES = ["I", "we", "I'm", "can't", "can’t", "cannot", "help", "the", "The", "of", "Der", "nicht", "und", "le", "est", "para", "german", "French", "Sorry", "our guidelines prevent", "x'i can't", "İstanbul", "ΌΣΟΣ", "²x", "12", "a_b", "_", "- ", "\n", "\n- ", "\n3. ", "\n•", "\n12)", "\n```\n", "~~~", ". ", ".", "!", "?\" ", "…", "。", ".B", ".Éa", "...", ",", ")", "`x`", "you asked", "word word", "\x1c", "see run_notes.md", "from me", "beyond what i", "no puedo", "je refuse", "one i turn down", "ſorry", "١٢", "½", "日本語", "’tis", "1.", "Name"]


def odd(rng):
    return "".join(rng.choice(PIECES) + rng.choice([" ", " ", ""]) for _ in range(rng.choice([1, 2, 5, 20, 50])))


def test_quick_ways_find_what_the_patterns_find():
    rng = random.Random(5)
    part = re.compile(r"(?<=[.!?…。])[\"')\]]*\s+(?=\S)|(?<=[.!?])(?=[A-ZÀ-Ý¿¡][a-zà-ÿ])")
    for text in (odd(rng) for _ in range(3000)):
        assert defects.words_of(text) == prose.WORDS.findall(text)
        assert defects.refuses(text) == bool(defects._REFUSAL.search(text))
        found = defects.clauses(text)
        assert defects.last_clause(text) == (found[-1][0] if found else None)
        for line in text.split("\n"):
            assert defects.parts(line) == ([p.strip() for p in part.split(defects._ITEM.sub("", line)) if p.strip()], bool(defects._ITEM.match(line)))


def test_features_of_many_pairs_are_those_of_each():
    rng = random.Random(6)
    answers_ = [odd(rng) for _ in range(800)]
    questions = [rng.choice([None, "", odd(rng), a]) for a in answers_]
    many, _ = defects.opened(questions, answers_)
    echoed = 0
    for q, a, o in zip(questions, answers_, many):
        (one,), said = defects.opened([q], [a])
        assert o.packed() == one.packed()
        found = [(c, prose.WORDS.findall(c), code) for c, code, _ in defects.clauses(a)]
        assert o.sizes.tolist() == [max(1, len(ws)) for _, ws, _ in found] and len(said.keys()) == sum(len(ws) for _, ws, code in found if not code)
        ends = defects.Ends()
        for c, ws, code in found:
            if not code:
                ends.add(c, ws)
        assert o.own == (ends.counts(found[-1][1]) if found and found[-1][1] else [0] * 6)
        low = [w.lower() for w in prose.WORDS.findall(q or "")]
        pairs = set(zip(low, low[1:]))
        seen = [[p for p in zip(ws, ws[1:]) if p in pairs] for ws in ([w.lower() for w in ws] for _, ws, _ in found)]
        assert o.covered == len(set().union(*seen)) / max(1, len(pairs))
        assert np.allclose(o.echo, [len(x) / (len(ws) - 1) if len(ws) > 1 else float(len(ws) == 1 and ws[0].lower() in low) for x, (_, ws, _) in zip(seen, found)])
        echoed += o.covered > 0
    assert echoed > 100


def test_pairs_are_read_at_little_more_than_finding_their_words(monkeypatch):
    plain, _ = answers()
    given = plain * 10
    texts = [q + "\n" + a for q, a in given]
    nulls = pa.nulls(len(given), pa.string())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(given)), pa.int64()), nulls, nulls, pa.array([q for q, _ in given]), pa.array([a for _, a in given])], ["row", "tbl", "id", "question", "answer"])
    session = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))
    monkeypatch.setattr(defects, "store", lambda frame: frame)
    run = defects.read(SimpleNamespace(sparkSession=session, select=lambda *_: SimpleNamespace(mapInArrow=lambda f, _: f)), np.zeros(1 << 19, np.uint64))

    def cost(work):
        took = []
        for _ in range(3):
            began = time.process_time()
            work()
            took.append(time.process_time() - began)
        return min(took)

    assert cost(lambda: list(run(iter([batch])))) < 6 * cost(lambda: [prose.WORDS.findall(t) for t in texts])


NAMES = pii.Gazetteer(["Anna", "Felix", "June", "Will"], ["Corvellan", "Grunevald"])


@pytest.mark.parametrize("text,kind,found", [
    ("Write to anna.corvellan+x@corp.tessera.example, please.", "email", "anna.corvellan+x@corp.tessera.example"), ("Write to a.b [at] corp [dot] tessera [dot] example now", "email", "a.b [at] corp [dot] tessera [dot] example"),
    ("ring +44 20 7946 0302 today", "phone", "+44 20 7946 0302"), ("phone: (592) 555-0104 ext. 445.", "phone", "(592) 555-0104 ext. 445"), ("tel=5225550135;x", "phone", "5225550135"),
    ("My national id is 997-87-4144, ok", "id_number", "997-87-4144"), ("citizen no. QT3203231 appears", "id_number", "QT3203231"),
    ("I moved to Flat 22, 73 Thornwick Close, Dunford Quay, so", "address", "Flat 22, 73 Thornwick Close, Dunford Quay"), ("visit 386 Osier Close, Wexcombe 14227 before", "address", "386 Osier Close, Wexcombe 14227"), ("to P.O. Box 340, North Tilling 98713 as", "address", "P.O. Box 340, North Tilling 98713"),
    ("I spoke with Anna Corvellan about it", "person_name", "Anna Corvellan"), ("Thanks for the help, Grunevald, Felix Because", "person_name", "Grunevald, Felix"), ("Approved by Dr. D. Corvellan after", "person_name", "D. Corvellan"), ("I SPOKE WITH ANNA GRUNEVALD ABOUT IT", "person_name", "ANNA GRUNEVALD"), ("Best regards\nfelix corvellan", "person_name", "felix corvellan"),
])
def test_spans(text, kind, found):
    assert (kind, found) in [(s[0], text[s[1] : s[2]]) for s in pii.spans(text, NAMES)]
    import pyarrow as pa
    import pyarrow.compute as pc

    assert pc.match_substring_regex(pa.array([text]), NAMES.compiled())[0].as_py()


def test_personal_information(spark):
    good = ["I spoke with Anna Corvellan about it.", "Mail felix.grunevald@mail.example now.", "ring 592-555-0104 today", "My national id is 997-87-4144.", "I moved to 386 Osier Close, Wexcombe 14227 then."]
    bad = ["Part number 236-12-6361 is a test.", "Clone it from git@forge.example:tools/x.git first.", "The run started at epoch 1731699939 and June was Will ing.", "Nothing here.", "", None]
    rows = [("t", f"r{i}", 0, x) for i, x in enumerate((good + bad) * 12)]
    texts = spark.createDataFrame(rows, "tbl string, row_id string, part int, text string")
    names = spark.createDataFrame([("Anna", "given"), ("Felix", "given"), ("Corvellan", "family"), ("Grunevald", "family"), (None, "given"), ("June", "given")], "name_part string, kind string")
    spans = pii.found(pii.proposed(texts, names))
    assert {r.found_text for r in spans.collect()} == {"Anna Corvellan", "felix.grunevald@mail.example", "592-555-0104", "997-87-4144", "386 Osier Close, Wexcombe 14227"}
    out = {r.row_id: r.text for r in pii.redacted(texts, spans).collect()}
    assert out["r0"] == "I spoke with [PERSON_NAME] about it." and out["r4"] == "I moved to [ADDRESS] then." and out["r5"] == bad[0] and out["r10"] is None


def test_reliabilities_follow_agreeing_labelers():
    rng = random.Random(2)
    counts = {}
    for _ in range(4000):
        true = rng.random() < 0.4
        votes = ",".join(str((1 if true else -1) * (1 if rng.random() < q else -1)) for q in (0.95, 0.9, 0.55))
        counts[votes] = counts.get(votes, 0) + 1
    p = pii.reliabilities(sorted(counts.items()))
    assert p["1,1,-1"] > 0.9 and p["-1,-1,1"] < 0.1


def test_trees_and_decoding():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = boosting.Boosted(trees=40)
    model.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.95
    assert pages.decode(np.array([3.0, -0.5, 2.0, -2.0, 0.6, -3.0]), np.array([0, 0, 0, 1, 1, 1])).tolist() == [True, True, True, False, False, False]
    assert pages.decode(np.zeros(0), np.zeros(0, int)).tolist() == []


def test_page_statistics_are_per_site():
    assert pages.template("© 2019 Flifet. All rights", "flifet") == pages.template("© 2023 Zuzork. All rights", "zuzork")
    assert pages.page_key("https://h.example/a/b.html?x=1#t") == pages.page_key("https://H.example/a/b/") == "https://h.example/a/b"
    assert pages.skeleton("How to cap the ledger — 5 min read") == pages.skeleton("How to move the list")


def test_sentences_and_language():
    text = "# Heading\n\nRun: x-1\n2024-01-01T00:00:00Z INFO a=1\n| a | b |\n```\ncode here\n```\nThe cat sat on\nthe mat. It was warm.\n\nDer Hund ist nicht hier."
    assert prose.sentences(text) == ["The cat sat on the mat.", "It was warm.", "Der Hund ist nicht hier."]
    batch = reading.Batch([text, None, ""], reading.Features())
    assert batch.english.tolist() == [True, True, False] and np.diff(batch.documents).tolist() == [3, 0, 0]


def test_reading_levels_on_held_out_documents(spark):
    rng = random.Random(5)
    levels = {1: "cat dog sun bed hat red big run".split(), 2: "people please closed before noon ticket office holiday".split(), 3: "cache shard planner queue scheduler transcript".split(), 4: "considerable arrangement subsequently determined observation".split(), 5: "epistemological commensurability heterogeneous teleological asymptotic".split()}

    def document(level, n=12):
        return " ".join(f"The {rng.choice(levels[level])} of the {rng.choice(levels[level])} was in the {rng.choice(levels[level])}." for _ in range(n))

    rows = [(i, document(1 + i % 5) + (" " + document(1 + (i + 2) % 5, 3))) for i in range(300)] + [(1000, None), (1001, ""), (1002, "Der Hund und die Katze sind nicht hier. " * 20), (1003, "too short"), (1004, document(3, 3000))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 + i % 5) for i in range(100)] + [(None, None), (5, 1), (1001, 9)], "doc_id long, reading_level int")
    got = {r.doc_id: r.reading_level for r in reading.levels(df, labels).collect()}
    assert np.mean([got[i] == 1 + i % 5 for i in range(100, 300)]) > 0.95
    assert got[1004] == 3 and not set(got) & {1000, 1001, 1002, 1003}
    assert reading.levels(df, labels.filter("false")).count() == 0


def test_linear_model():
    model = linear.MeanModel(16, 2)
    rows = np.arange(0, 201, 2)
    ids = np.tile([1, 2, 3, 4], 50).astype(np.int32)
    target = np.eye(2)[np.arange(100) % 2].astype(np.float32)
    model.fit(ids, rows, target, np.ones(100, np.float32))
    assert (model.logits(ids, rows).argmax(axis=1) == np.arange(100) % 2).all()


def test_token_counts_of_long_texts(monkeypatch):
    tokenizer = tokens.encoding(tokens.DIRECTORY, tokens.VOCABULARY)
    text = "The ledger of Kléber's shard, 1,234 rows.\n\n  indented   text don't " * 200
    whole = len(tokenizer.encode_ordinary(text))
    monkeypatch.setattr(tokens, "PART", 500)
    assert tokens.count(text, tokenizer) == whole and tokens.count(None, tokenizer) == 0 and tokens.count("", tokenizer) == 0


@pytest.mark.parametrize("text", [
    "Cheers, Zsolt Quorn", "assignee: Zsolt Quorn", "user=Zsolt", "Herr Quorn came.", "Frau Quorn came.", "The patient Quorn left.", "cheers, zsolt quorn", "signed\u00a0Zsolt Quorn", "THİS IS Quorn", "by Sir Quorn",
    "Zsolt Quorn wants to go", "Hirschsteig 12, 80331 Quorn", "12 Cafébar Street", "123456+1234", "id ١٢٣٤٥٦٧٨٩", "we ask will about it", "3Émile came", "I saw Zoé.", "Quorn (\x00",
])
def test_every_text_with_a_span_is_searched(text):
    names = pii.Gazetteer(["Anna", "Will", "Émile", "Zoé"], ["Corvellan"])
    assert pii.spans(text, names) and names.triggered(pa.array([text])).to_pylist() == [True]


def test_texts_that_are_not_searched_have_no_spans():
    rng = random.Random(4)
    parts = ["Anna", "will", "Quorn", "zsolt", "12", "1234567", "+49 ", "street", "Hirschsteig", "by", "Dear", "dr.", "user=", "at", "dot", "(", ", ", ". ", "é", "Éa", "box", "rue", "Calle", "wants to", "this is", "the", "and", "-", "\n", "\u00a0"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", ""]) for _ in range(rng.randint(1, 7))) for _ in range(6000)]
    rest = [t for t, hit in zip(texts, NAMES.triggered(pa.array(texts)).to_pylist()) if not hit]
    assert len(rest) > 300 and not [t for t in rest if pii.spans(t, NAMES)]


def test_tagged_pairs_come_from_both_tables(spark):
    columns = ["tbl", "id", "question", "answer"]
    rows = spark.createDataFrame([(t, f"{t}{i}", "q", "a") for t in ("instruction_pairs", "records") for i in range(100)], columns).selectExpr("xxhash64(tbl, id, question, answer) as row", "*")
    first = [r.tbl for r in defects.shuffled(rows, columns, 1000)[:60]]
    assert 15 < first.count("records") < 45
