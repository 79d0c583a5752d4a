"""Queries that SQL can't express, on small tables against brute force."""

import hashlib
import json
import random

from millrace import queries as Q


def test_metadata_of_all_rows_is_hashed(spark, tmp_path):
    values = ['{}', '{"b": 1, "a": null}', '{"a":null,"b":1}', '{"z": {"y": [1, {"d": true, "c": "é"}], "x": ""}, "a": -3}', '{"k": "\\u00fc \\"q\\" \\n"}', '{"n": 1.5, "m": 12345678901234}', '[]', '"text"', 'null', '{"é": 1, "z": 2, "A": 3}']
    spark.createDataFrame([(v,) for v in [*values, values[0], None, "not json"]], "metadata string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.metadata: r.hash for r in Q.QUERIES["metadata_value_hashes"](spark, str(tmp_path)).collect()}
    wanted = {v: hashlib.sha256(json.dumps(json.loads(v), ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest() for v in values}
    assert got == wanted | {None: None, "not json": None}


def test_turns_of_all_conversations(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"c{rng.randrange(5)}", f"m{i:03d}", rng.choice([f"2024-01-01T{rng.randint(0, 3):02d}:{rng.randint(0, 1):02d}:00Z", "unread", None])) for i in range(200)]
    rows += [("hot", f"h{i:03d}", f"2024-01-{1 + i % 9:02d}T00:00:0{i % 2}Z") for i in range(300)] + [("unknown", "u", "2024-01-01T00:00:00Z"), (None, "n", "2024-01-01T00:00:00Z")]
    spark.createDataFrame([*rows, *rows[:9]], "conversation_id string, id string, created_at string").write.parquet(f"{tmp_path}/messages.parquet")
    known = [f"c{i}" for i in range(5)] + ["hot"]
    spark.createDataFrame([(c, None if c == "c0" else "2024-02-01") for c in known], "id string, updated_at string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conversation_id, r.id): r.turn for r in Q.QUERIES["all_transcripts"](spark, str(tmp_path)).collect()}
    wanted = {}
    for c in known:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[2] in (None, "unread"), "" if r[2] in (None, "unread") else r[2], r[1]))
        wanted |= {(c, r[1]): n for n, r in enumerate(own)}
    assert got == wanted
