import json

from millrace.sources import scans, sinks
from millrace.streaming import streams
from pyspark.sql import functions as F


def test_lines_and_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"b":1,"a":2}\nnot json\n\n[3]\n')
    (tmp_path / "b.jsonl").write_text("".join(f'{{"i":{i}}}\n' for i in range(1000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        rows = scans.text_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    own = sorted((r.line_no, r.line) for r in rows if r.file.endswith("b.jsonl"))
    assert own == [(i + 1, f'{{"i":{i}}}') for i in range(1000)]
    got = scans.json_lines(spark, str(tmp_path / "a.jsonl"), skip=1).orderBy("line_no").select("line_no", "parse_error").collect()
    assert [tuple(r) for r in got] == [(2, "malformed JSON record"), (4, None)]
    assert scans.found_lines(scans.whole_files(spark, str(tmp_path), "a.*"), "json").collect()[0].line_no == 2
    assert scans.file_facts(spark, str(tmp_path)).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "a"), (2, "bad", "b")], "n int, reason string, v string")
    sinks.write_json_lines(df, str(tmp_path / "j"))
    lines = sorted(line for f in (tmp_path / "j").glob("part-*") for line in f.read_text().splitlines())
    assert [json.loads(x)["n"] for x in lines] == [1, 2] and lines[0] == '{"n":1,"reason":null,"v":"a"}'
    sinks.write_accepted(df, "reason", str(tmp_path / "k"))
    assert spark.read.parquet(str(tmp_path / "k/accepted")).columns == ["n", "v"]
    sinks.write_parts(df, str(tmp_path / "p"), "v")
    assert (tmp_path / "p/v=a").exists()
    assert [r.id for r in sinks.strided(spark.range(10000), "id", 4).orderBy("id").collect()] == [0, 2500, 5000, 7500]
    rows = scans.parquet_rows(spark, str(tmp_path / "k/rejected")).collect()
    assert rows[0]._row == 1


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.txt").write_text("A b\na  b\nc\n")
    for k in range(2):
        streams.run_once(streams.ingest(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "c1"))
        streams.new_texts(streams.ingest(spark, str(source)), "line", str(tmp_path / "kept"), str(tmp_path / "c2"))
        (source / "2.txt").write_text("C\nd\n")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    assert sorted(r.line for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == ["A b", "c", "d"]
    events = spark.createDataFrame([(1, "2024-01-01 00:10:00", "e", 1.0), (1, "2024-01-01 00:20:00", "e", 2.0), (1, "2024-01-01 02:00:00", "e", 4.0)], "user_id int, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.events, r.total) for r in streams.tumbling(events).collect()) == [(1, 4.0), (2, 3.0)]
    assert sorted(r.events for r in streams.sessions(events).collect()) == [1, 2]


def test_capped_runs(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.txt").write_text("a\nb\nc\n")
    for wanted in (3, 4, 4):
        assert streams.capped_run(spark, str(source), str(tmp_path / "out"), str(tmp_path / "c"), 4) == wanted
        (source / f"{wanted}x{len(list(source.iterdir()))}.txt").write_text("d\ne\n")
