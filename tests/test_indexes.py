"""Vector index, text index, keyed commits and the pointer below them."""

import json
import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.engine import Engine
from loomtrace.operators import keys
from loomtrace.operators import retrieval as R
from loomtrace.operators.lake import Lake
from loomtrace.operators.pointer import Pointer
from loomtrace.operators.text_index import GROUP, TextIndex
from loomtrace.operators.vector_index import VectorIndex, merged
from loomtrace.sources.files import Files
from loomtrace.streaming import capture as C

# ---- vectors -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def clustered(spark):
    """Thirty tight clusters, one with a third of all rows, a vector many times, and no candidates."""
    random = np.random.default_rng(3)
    centres = random.standard_normal((30, 24))
    rows = [(f"v{i:04d}", (centres[0 if i % 3 == 0 else i % 30] + 0.05 * random.standard_normal(24)).tolist()) for i in range(900)]
    rows += [(f"same{i}", rows[5][1]) for i in range(20)]
    rows += [("zero", [0.0] * 24), ("short", [1.0]), ("none", None)]
    return spark.createDataFrame(rows, "uuid string, embedding array<double>").repartition(4).cache()


def scan(table, q, k):
    return [(r.uuid, round(r.distance, 9)) for r in R.vector_top_k(table.withColumn("embedding", F.col("embedding")), q, 3 * k).select("uuid", F.round("distance", 12).alias("distance")).orderBy("distance", "uuid").limit(k).collect()]


def test_index_gives_what_a_scan_gives(spark, clustered, tmp_path):
    index = VectorIndex(spark, str(tmp_path))
    assert index.search([1.0] * 24, 3) == []  # nothing is built yet
    assert index.build(clustered) == 920
    asked = [r.embedding for r in clustered.where("uuid in ('v0000', 'v0007', 'same3')").collect()] + [np.ones(24).tolist()]
    for q in asked:
        assert [(i, round(d, 9)) for i, d in index.search(q, 7)] == scan(clustered, q, 7)
    index.search(asked[0], 7)
    assert 0 < index.cells_read <= index.cells_known / 2
    assert index.search([0.0] * 24, 3) == [] and index.search([1.0], 3) == [] and len(index.search(asked[0], 5000)) == 920
    many = index.search_all(clustered.where("uuid in ('v0000', 'v0007', 'same3', 'zero', 'none')"), 7).collect()
    own = {r.uuid: r.embedding for r in clustered.where("uuid in ('v0000', 'v0007', 'same3')").collect()}
    assert {r.query_id for r in many} == set(own)
    for name, q in own.items():
        assert [(r.id, round(r.distance, 9)) for r in sorted((r for r in many if r.query_id == name), key=lambda r: r.place)] == scan(clustered, q, 7)


def test_a_new_build_is_swapped_in(spark, clustered, tmp_path):
    index = VectorIndex(spark, str(tmp_path))
    index.build(clustered.where("uuid like 'v000%'"), covers=["a"])
    old = index.state()["folder"]
    reader = VectorIndex(spark, str(tmp_path))
    reader.cells()
    assert index.build(clustered, covers=["a", "b"]) == 920 and index.state() != old
    assert index.state()["covers"] == ["a", "b"] and os.path.isdir(f"{tmp_path}/{old}")
    assert len(reader.search([1.0] * 24, 2000)) == 920
    assert index.build(clustered.where("uuid in ('zero', 'none')")) == 0 and index.search([1.0] * 24, 3) == []
    assert merged([[("a", 0.5), ("b", 0.1)], [("a", 0.5), ("c", 0.2)]], 2) == [("b", 0.1), ("c", 0.2)]


# ---- texts ---------------------------------------------------------------------------------


def test_segments_score_like_one_index(spark, tmp_path):
    words = ["the", "of", "and", "plan"]
    rows = [(f"d{i:04d}", None if i == 7 else " ".join(words[: 1 + i % 4] * (1 + i % 5)) + (" zebra" * (i % 7) if i % 211 == 3 else "") + f" w{i}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "uuid string, text string").repartition(3)
    index = TextIndex(spark, str(tmp_path))
    assert index.search("the", 3) == [] and index.documents() is None
    for at in range(4):
        index.add(docs.where(F.pmod(F.substring("uuid", 2, 4).cast("int"), F.lit(4)) <= at))  # the earlier ones again
    assert len(index.state()["segments"]) == 4 and index.documents().count() == 1500
    for q in ("zebra", "the zebra", "and of plan", "w12 w13 nothing", "", "nothing"):
        want = [(r.uuid, round(r.score, 9)) for r in R.lexical_top_k(docs, q, 9).collect()]
        assert [(i, round(s, 9)) for i, s in index.search(q, 9)] == want
    index.search("zebra", 3)
    assert index.groups_read < index.groups_known
    before = sorted(index.postings().collect())
    assert index.merge(3) and not index.merge(3) and len(index.state()["segments"]) == 1
    assert sorted(index.postings().collect()) == before
    assert sorted(map(tuple, index.documents().groupBy("number").count().where("count > 1").collect())) == []
    assert [i for i, _ in index.search("the zebra", 9)] == [r.uuid for r in R.lexical_top_k(docs, "the zebra", 9).collect()]
    assert index.postings().join(index.documents().select("id", F.floor(F.col("number") / GROUP).alias("g")), "id").groupBy("g").agg(F.count_distinct("id").alias("n")).where(f"n > {GROUP}").count() == 0
    assert index.rebuild(docs.limit(0)) == 0 and index.search("the", 3) == []


# ---- pointer and commits -------------------------------------------------------------------


def test_no_update_is_lost(spark, tmp_path):
    files = Files(spark)

    def add(name):
        for i in range(15):
            Pointer(files, str(tmp_path / "p"), []).update(lambda now: [*now, f"{name}{i}"])

    threads = [threading.Thread(target=add, args=(n,)) for n in "abcd"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    version, value = Pointer(files, str(tmp_path / "p"), []).read()
    assert version == 60 and sorted(value) == sorted(f"{n}{i}" for n in "abcd" for i in range(15))
    assert not Pointer(files, str(tmp_path / "p"), []).swap(version - 1, ["late"])
    assert len(files.names(str(tmp_path / "p"))) <= 21 and not any(x.endswith(".tmp") for x in files.names(str(tmp_path / "p")))


def test_files_by_way_of_hadoop(spark, tmp_path, monkeypatch):
    """The same through Spark's file systems."""
    monkeypatch.setattr(Files, "local", lambda self, path: None)
    files, folder = Files(spark), f"file://{tmp_path}/far"
    assert files.names(folder) == [] and files.put_new(f"{folder}/a", "é") and not files.put_new(f"{folder}/a", "other")
    assert files.read(f"{folder}/a") == "é" and files.names(folder) == ["a"] and files.age_seconds(f"{folder}/b", 0) is None
    assert Pointer(files, f"{folder}/p", []).update(lambda now: [*now, 1]) == [1]
    files.remove(folder)
    assert files.names(folder) == []


def records(spark, names, session):
    return spark.createDataFrame([(n, session, "user", None, None, "{}") for n in names], "uuid string, session_id string, type string, timestamp timestamp_ntz, parent_uuid string, raw string")


def test_an_insert_reads_only_files_that_may_hold_its_keys(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    for s in range(6):
        assert lake.insert("records", records(spark, [f"{s}-{i}" for i in range(40)], f"s{s}").coalesce(1)) == 40
    every = len(lake.table("records").inputFiles())
    assert lake.insert("records", records(spark, ["3-1", "3-41"], "s3").coalesce(1)) == 1 and lake.files_read == 1 < every
    assert lake.insert("records", records(spark, ["9-1"], "s9").coalesce(1)) == 1 and lake.files_read == 0
    assert lake.rows_by("records", records(spark, ["x"], "s3")).count() == 41 and lake.files_read == 2
    assert lake.rows_of("records", records(spark, ["5-5", "zz"], "")).count() == 1 and lake.files_read == 1
    assert lake.insert("records", records(spark, [None], "s9")) == 0
    n = lake.table("records").count()
    assert lake.compact("records") and len(lake.commits("records")) == 1 and lake.table("records").count() == n == 242
    assert lake.vacuum("records", 0) == 0  # old versions of the pointer still name the commits
    for _ in range(21):
        lake._pointer("records").update(lambda now: list(now))
    assert lake.vacuum("records", 0) == 8 and lake.table("records").count() == n


def test_many_small_commits_become_few(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    for i in range(14):
        lake.insert("file_mtimes", spark.createDataFrame([("a", i, i), (f"f{i}", i, i)], "file_path string, mtime_ns long, size_bytes long").coalesce(1))
    assert len(lake.commits("file_mtimes")) <= 12
    got = {r.file_path: r.size_bytes for r in lake.table("file_mtimes").collect()}
    assert got == {"a": 13, **{f"f{i}": i for i in range(14)}}


def test_two_writers_lose_nothing_and_repeat_nothing(spark, tmp_path):
    lakes = [Lake(spark, str(tmp_path)) for _ in range(2)]
    added = [0, 0]

    def write(at):
        for i in range(3):
            names = [f"{at}-{i}-{n}" for n in range(5)] + [f"both-{i}-{n}" for n in range(5)]
            added[at] += lakes[at].insert("records", records(spark, names, "s"))

    threads = [threading.Thread(target=write, args=(at,)) for at in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    rows = [r.uuid for r in lakes[0].table("records").select("uuid").collect()]
    assert len(rows) == len(set(rows)) == 45 == sum(added)


def test_filters_have_no_false_negatives():
    random = np.random.default_rng(2)
    own, other = (random.integers(-(1 << 63), 1 << 63, 5000, dtype=np.int64) for _ in range(2))
    bits = keys.bloom(own)
    assert keys.may_hold(bits, own).all() and keys.may_hold(bits, other).mean() < 0.01 and not keys.may_hold(keys.bloom(own[:0]), own).any()


def test_a_crashed_run_blocks_for_a_time_only(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    assert Files(spark).put_new(f"{tmp_path}/sweep.lock", "{}")
    with lake.single_flight("sweep") as mine:
        assert not mine
    os.utime(tmp_path / "sweep.lock", (1, 1))
    with lake.single_flight("sweep") as mine:
        assert mine
    assert not os.path.exists(tmp_path / "sweep.lock")


# ---- the engine over its indexes -----------------------------------------------------------


def line(uuid, session, text, at="2024-03-01T10:00:00.000Z"):
    return json.dumps({"uuid": uuid, "sessionId": session, "type": "user", "timestamp": at, "message": {"role": "user", "content": text}})


def test_engine_searches_its_indexes(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "lake"))
    folder = tmp_path / "in" / "project"
    folder.mkdir(parents=True)
    (folder / "sessions-index.json").write_text(json.dumps({"entries": [{"sessionId": "s1", "summary": "from the index", "gitBranch": "main", "messageCount": 77}]}))
    (folder / "s1.jsonl").write_text("".join(line(f"a{i}", "s1", f"the zebra plan number {i}") + "\n" for i in range(6)))
    (folder / "s2.jsonl").write_text("".join(line(f"b{i}", "s2", f"something about trains {i}") + "\n" for i in range(6)))
    engine.sync(str(tmp_path / "in"))
    meta = {r.session_id: r for r in engine.lake.table("sessions").collect()}
    assert (meta["s1"].summary, meta["s1"].git_branch, meta["s1"].message_count) == ("from the index", "main", 77)
    assert (meta["s2"].summary, meta["s2"].message_count, meta["s2"].first_prompt) == (None, 6, "something about trains 0")
    t, q = engine.lake.table, "zebra plan"

    def whole(k):
        found = R.retrieve_candidates(t("records"), t("record_embeddings"), t("record_fts"), t("summaries"), t("summary_embeddings"), q, engine.embedder.embed([q])[0], k)
        return sorted((r.id, r.tier, round(r.fused_score, 9)) for r in found.collect())

    got = lambda k: sorted((r.id, r.tier, round(r.fused_score, 9)) for r in engine.candidates(q, k).collect())
    assert got(5) == whole(5)
    (folder / "s3.jsonl").write_text(line("c0", "s3", "zebra plan zebra plan") + "\n")
    engine.sync(str(tmp_path / "in"))  # the vector lies beside the index, the text is a segment
    C.rebuild_fts(engine.lake), C.sync_text(engine.lake)
    assert len(C.text_index(engine.lake).state()["segments"]) == 2 and got(5) == whole(5) and "c0" in {x[0] for x in got(5)}
    engine.lake.replace("records", t("records").where("uuid != 'c0'"))  # a row that is gone leaves its place to the next
    C.rebuild_fts(engine.lake)
    assert "c0" not in {x[0] for x in got(5)} and len(got(5)) == 5
    assert [r.uuid for r in engine.get_session("s3", False).collect()] == []


def test_filters_are_made_without_holding_the_keys():
    import tracemalloc

    import pyarrow as pa

    def batches():
        for at, n in ((0, 600_000), (1, 10)):
            for begin in range(0, n, 10_000):
                h = np.random.default_rng([at, begin]).integers(-(1 << 63), 1 << 63, min(n, 10_000), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), at)), pa.array(np.full(len(h), n)), pa.array(h)], names=["at", "n", "h"])

    tracemalloc.start()
    found = [b.to_pylist()[0] for b in keys.partial_filters(batches())]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x["at"] for x in found] == [0, 1] and peak < 30_000_000
    for at in (0, 1):
        own = np.concatenate([b.column("h").to_numpy() for b in batches() if b.column("at")[0].as_py() == at])
        assert found[at]["bits"] == keys.bloom(own)


def test_rows_become_python_objects_a_few_at_a_time():
    import pyarrow as pa

    from loomtrace.functions import payload

    seen = []
    got = payload.by_steps(lambda some: seen.append(len(some)) or [len(x) for x in some], pa.int64(), pa.array(["ab"] * 1000))
    assert got.to_pylist() == [2] * 1000 and max(seen) <= payload.STEP < 1000
    assert payload.by_steps(lambda some: some, pa.string(), pa.array([], pa.string())).to_pylist() == []


def test_postings_are_grouped_and_ordered_by_one_shuffle(spark):
    from loomtrace.operators import text_index

    each = spark.createDataFrame([(f"t{i % 7}", i % 3, i, 9, 1) for i in range(200)], "term string, grp long, id long, len int, tf long")
    rows = text_index.in_order(each)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    got = rows.collect()
    assert sorted((r.term, r.grp, d.id) for r in got for d in r.docs) == sorted((f"t{i % 7}", i % 3, i) for i in range(200)) and len(got) == 21


def test_a_commit_has_few_files_however_many_partitions_a_shuffle_has(spark, tmp_path):
    lake, before = Lake(spark, str(tmp_path)), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        for first in (0, 200):  # new keys, then some that are known
            assert lake.insert("records", records(spark, [f"k{i}" for i in range(first, first + 400)], "s")) == 400 - first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(lake.table("records").inputFiles()) <= 16 and lake.table("records").count() == 600


def test_large_batches_meet_all_files_and_leave_nothing_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keys, "MOST_KEYS", 10)
    lake = Lake(spark, str(tmp_path))
    for first, new in ((0, 40), (20, 20), (20, 0), (55, 35)):
        twice = [f"k{i}" for i in range(first, first + 40)] * 2
        assert lake.insert("records", records(spark, [*twice, None], "s")) == new
    assert lake.files_read is None and sorted(r.uuid for r in lake.table("records").collect()) == sorted(f"k{i}" for i in range(95))
    assert sorted(x for x in lake.files.names(f"{tmp_path}/records") if x.startswith("commit-")) == sorted(lake.commits("records"))


def test_a_batch_of_k1_reads_its_own_parts(spark, monkeypatch):
    from loomtrace.plans import indexes

    plans = []
    monkeypatch.setattr(Lake, "insert", lambda self, name, rows, order=None: plans.append((rows.count(), rows._jdf.queryExecution().executedPlan().toString())))
    monkeypatch.setattr(Lake, "table", lambda self, name: None)
    indexes.k1_commits(spark, "/root/testdata/sf0.001")
    every = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").count()
    assert len(plans) == 14 and sum(n for n, _ in plans) == 2 * every
    assert all("PartitionFilters: [part" in p and "InMemoryTableScan" not in p for _, p in plans)
