"""Levels, chains and long sessions."""

import sys
import time

from loomtrace.functions.payload import tokens_of
from loomtrace.operators import summaries as SU

TEXT = "word " * 200


def python(code, seconds=30.0):
    return SU.Command((sys.executable, "-c", code), "Shorten this.", seconds)


def test_a_program_as_a_level():
    echo = python("import sys; t = sys.stdin.read(); print(t[:13] + str('Summary so far' in t) + chr(0))")
    assert echo("a\0b" + TEXT, "") == "Shorten this.False" and echo(TEXT, "before") == "Shorten this.True"
    assert SU.escalate(TEXT, "", (echo,)) == "Shorten this.False"


def test_levels_that_fail_hang_or_are_too_long_are_passed_over():
    began = time.time()
    levels = (python("import time; time.sleep(60)", 0.5), python("import sys; sys.exit('no')"), SU.Command(("/no/such/program",)), lambda s, p: s + s, lambda s, p: "  ", lambda s, p: "short")
    assert SU.escalate(TEXT, "", levels) == "short" and time.time() - began < 30
    assert tokens_of(SU.escalate(TEXT, "", levels[:-1])) < tokens_of(TEXT)


def test_one_chunk_is_held_at_a_time():
    held = 0

    def rows():
        nonlocal held
        for i in range(1_000_003):
            held += 1
            yield ("long", i)
        yield from (("short", i) for i in range(3))

    seen = 0
    for session, number, chunk in SU.chunk_by_chunk(rows(), 4):
        assert session == "long" and number == seen and [r[1] for r in chunk] == list(range(4 * number, 4 * number + 4)) and held == 4 * number + 4
        seen += 1
    assert seen == 250_000


def test_sessions_do_not_meet(spark):
    rows = [(f"u{s}-{i:03d}", f"s{s}", "user" if i % 2 else "assistant", None, '{"message": {"content": "hello there %d"}}' % i) for s in range(5) for i in range(10)]
    records = spark.createDataFrame(rows, "uuid string, session_id string, type string, timestamp timestamp_ntz, raw string").repartition(3)
    none = spark.createDataFrame([], SU.ROW)
    made = SU.make_sprigs(records, none, 100, (lambda source, previous: f"<{previous[-8:]}>{source[9:16]}",), size=4).collect()
    assert sorted((r.session_id, r.created_at, r.content) for r in made) == sorted(x for s in range(5) for x in ((f"s{s}", 100, f"<>u{s}-000]"), (f"s{s}", 101, f"<{f'<>u{s}-000]'[-8:]}>u{s}-004]")))
    parents = spark.createDataFrame([(f"p{i}", "s", "sprig", 1, TEXT, None, [], [], [], i) for i in range(4)], SU.ROW)
    assert SU.make_bindles(parents, 9).first().token_count < 4 * tokens_of(TEXT)  # counts are missing: counted anew


def test_a_long_session_is_numbered_by_several_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from loomtrace.operators.sessions import places

    long = spark.range(60_000).select(F.when(F.col("id") < 50_000, "long").when(F.col("id") < 50_500, None).otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("session_id"), F.when(F.col("id") % 11 == 0, None).otherwise(F.expr("timestamp_ntz'2024-01-01'") + F.make_dt_interval(secs=F.col("id") % 5000)).alias("timestamp"), F.lpad(F.col("id").cast("string"), 8, "0").alias("uuid"))
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as it is with more rows
    try:
        got = places(long, "session_id", [F.asc_nulls_last("timestamp"), "uuid"], str(tmp_path / "places")).persist()
        parts = spark.read.parquet(str(tmp_path / "places")).where("session_id = 'long'").select("_part").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    assert parts > 1 and got.count() == 60_000
    own = sorted(got.where("session_id = 'long'").collect(), key=lambda r: (r.timestamp is None, r.timestamp, r.uuid) if r.timestamp else (True, 0, r.uuid))
    assert [r.place for r in own] == list(range(1, 50_001)) and {r["size"] for r in own} == {50_000}
    none = got.where("session_id is null")
    assert sorted(r.place for r in none.collect()) == list(range(1, 501))
    got.unpersist()


def test_blobs_are_put_back_by_joins(spark):
    import json

    from loomtrace.operators.sessions import rehydrate

    mark = lambda c: f"[Large Content: file_{c * 16}] [Tokens: ~9]"
    odd = 'quotes " back\\slash \n line é 😀 </s>  '
    rows = [("a", json.dumps({"t": f"x {mark('a')} y {mark('b')}{mark('a')}", "n": [1, {"k": mark("c")}]})), ("b", '{"t": "plain"}'), ("c", None), ("d", json.dumps({"t": mark("a")})), ("e", "not json " + mark("b"))]
    records = spark.createDataFrame(rows, "uuid string, raw string")
    blobs = spark.createDataFrame([("file_" + "a" * 16, odd), ("file_" + "b" * 16, "")], "file_id string, content string")
    got = {r.uuid: r for r in rehydrate(records, blobs).collect()}
    assert json.loads(got["a"].raw) == {"t": f"x {odd} y {odd}", "n": [1, {"k": mark("c")}]} and got["a"].missing_blobs == ["file_" + "c" * 16]
    assert got["b"].raw == '{"t": "plain"}' and got["c"].raw is None and json.loads(got["d"].raw) == {"t": odd}
    assert got["e"].raw == "not json " and got["d"].missing_blobs == [] and rehydrate(records.where("false"), blobs).count() == 0


def test_blobs_as_files(spark, tmp_path):
    from pyspark.sql import functions as F

    from loomtrace.sources.blobs import blob_reader, write_blobs

    name = lambda c: "file_" + c * 16
    blobs = spark.createDataFrame([(name("a"), "one é"), (name("b"), ""), (name("c"), None)], "file_id string, content string")
    assert {r.file_id: r.written for r in write_blobs(blobs, str(tmp_path)).collect()} == {name("a"): True, name("b"): True}
    assert (tmp_path / "aa" / name("a")).read_text() == "one é"
    assert not any(r.written for r in write_blobs(blobs, f"file://{tmp_path}").collect())
    asked = spark.createDataFrame([(name("a"),), (name("b"),), (name("d"),), ("../../etc/passwd",), (None,)], "id string")
    got = {r.id: r.content for r in asked.select("id", blob_reader(str(tmp_path))(F.col("id")).alias("content")).collect()}
    assert got == {name("a"): "one é", name("b"): "", name("d"): None, "../../etc/passwd": None, None: None}
