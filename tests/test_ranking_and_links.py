"""Kernels with known values, and supersession evidence."""

import pytest
from pyspark.sql import functions as F

from loomtrace.functions import scoring as S
from loomtrace.functions import text as X
from loomtrace.functions.payload import without_code
from loomtrace.operators import retrieval as R
from loomtrace.sources import artifacts as A


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_kernels(spark):
    assert one(spark, S.sigmoid(F.lit(0.0))) == 0.5 and one(spark, S.sigmoid(F.lit(-800.0))) == 0.0 and one(spark, S.sigmoid(F.lit(800.0))) == 1.0
    assert one(spark, S.recency_decay(F.lit(30 * 86400.0))) == 0.5 and one(spark, S.recency_decay(F.lit(-5.0))) == 1.0
    with pytest.raises(ValueError):
        S.recency_decay(F.lit(1.0), 0)
    score = S.compose_score(F.lit(0.8), F.lit(0.0), F.lit(0.5), F.lit(True), F.lit("summary"))
    assert one(spark, score) == pytest.approx(0.8 * 0.5 * 0.05 * 0.5)
    assert one(spark, X.file_ids(F.lit("file_00000000000000aa x file_0000000000000001 file_00000000000000aa"))) == ["file_0000000000000001", "file_00000000000000aa"]
    assert one(spark, X.accepts(F.lit("  "), F.lit(9))) is False and one(spark, X.accepts(F.lit("abcd"), F.lit(1))) is False


def test_fusion(spark):
    arms = spark.createDataFrame([("a", 0, 1), ("b", 0, 2), ("b", 1, 1)], "id string, arm int, rank int")
    got = {r.id: r.fused_score for r in R.fuse(arms).collect()}
    assert got["a"] == pytest.approx(1 / 61) and got["b"] == pytest.approx(1 / 62 + 1 / 61)
    assert R.fuse(arms.where("false")).count() == 0


def test_zero_vectors_are_no_candidates(spark):
    rows = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 0.0]), ("c", [1.0])], "uuid string, embedding array<float>")
    assert [r.uuid for r in R.vector_top_k(rows, [1.0, 0.0], 5).collect()] == ["b"]


def test_bm25_of_nothing(spark):
    docs = spark.createDataFrame([("a", "One two"), ("b", None)], "uuid string, text string")
    assert R.lexical_top_k(docs, "three", 5).count() == 0 and R.lexical_top_k(docs, "", 5).count() == 0
    assert [r.uuid for r in R.lexical_top_k(docs, "two", 5).collect()] == ["a"]


S1, S2, S3 = ("%08d-0000-0000-0000-000000000000" % i for i in (1, 2, 3))


def test_artifacts(spark, tmp_path):
    folder = tmp_path / "docs" / "decisions"
    folder.mkdir(parents=True)
    (folder / "2024-a.md").write_text(f"Session: {S1}\nSuperseded by: [B](./2024-b.md).\n")
    (folder / "2024-b.md").write_text(f"Session-of-record: {S2}\n```\nSupersedes: 2024-c\n```\n`Session: {S3}`\n")
    (folder / "2024-c.md").write_text(f"session {S3}\nSupersedes: {S3}\n")
    (folder / "template.md").write_text(f"Session: {S3}\nSupersedes: 2024-a\n")
    found = A.scan_artifacts(spark, str(tmp_path))
    assert found.count() == 3
    links = [(r.superseding_id, r.superseded_id, r.source) for r in A.resolve_links(found).collect()]
    assert links == [(S2, S1, "adr-supersedes")]
    assert A.describe_links(A.resolve_links(found)).first().line == f"{S2} -> {S1} [adr-supersedes]"
    assert A.scan_artifacts(spark, str(tmp_path / "none")).count() == 0


def test_reverts_and_code(spark):
    log = spark.createDataFrame([("abc1234\x1fRevert \"x\"\n\nThis reverts commit deadbee.",), ("f00\x1fRevert \"y\"",), ("junk",)], "value string")
    assert [(r.superseding_id, r.superseded_id) for r in A.git_reverts(log).collect()] == [("abc1234", "deadbee")]
    assert without_code("a\n```\nx\n```\nb `c` d") == "a\n\n\n\nb   d"
