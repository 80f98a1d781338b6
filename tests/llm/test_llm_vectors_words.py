"""Whitening, ball k-means and the word table against plain versions."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from loomtrace.llm import centroids as C
from loomtrace.llm import whitening as W
from loomtrace.llm import word_table as T
from loomtrace.llm.queries import tokenizer_path

VECTORS = "vec_id long, embedding array<float>, x string, n int, component string, cluster string"


def table(spark, rows):
    """With columns whose names clash with those of the results and of inner steps."""
    return spark.createDataFrame([(i, v, "x", 1, "c", "k") for i, v in rows], VECTORS)


def whole(vector):
    return [int(np.floor(64 * float(np.float32(c)))) for c in vector]


# ---- whitening -----------------------------------------------------------------------------


def plain_whitening(rows, most=16):
    kept = [(i, [x + 1_000_000 for x in whole(v)]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.unique(np.array([v for _, v in kept]), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    out = {}
    for i, v in kept:
        x = np.array(v)
        white = ((x - sums / n) @ vectors) / np.sqrt(values)
        out[i] = (n, int(sum(int(a) ** 2 for a in n * x - sums)), np.abs(white), values / np.trace(np.cov(fit.T.astype(float), bias=True)))
    return out


def clustered(n, d, decay, seed=0):
    random = np.random.default_rng(seed)
    return (random.standard_normal((n, d)) * decay ** np.arange(d)).astype(np.float32)


@pytest.mark.parametrize("decay,scale,narrow", [(0.5, 4000, True), (0.99, 40, False)])
def test_whitening_equals_all_eigenvectors(spark, decay, scale, narrow):
    data = clustered(300, 40, decay) * np.float32(scale)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    rows += [(1000 + i, data[0].tolist()) for i in range(120)]  # one vector with a third of the rows
    rows += [(2000, None), (2001, [None] * 40), (2002, [float("nan")] * 40), (2003, [float("inf")] * 40), (2004, [])]
    want = plain_whitening(rows)
    got = W.whiten(table(spark, rows).repartition(5)).toPandas()
    assert sorted(got.columns) == sorted(["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    assert len(got) == 16 * len(want) and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-4
    for i, own in got.sort_values("component").groupby("vec_id"):
        n, deviation, white, explained = want[i]
        assert own.component.tolist() == list(range(1, 17)) and set(own.n) == {n} and set(own.deviation) == {deviation}
        assert np.allclose(np.abs(own.whitened), white, atol=1e-6) and np.allclose(own.explained, explained, rtol=1e-9)
    widths = W.fit_whitener(table(spark, rows)).widths
    assert (set(widths) == {24}) == narrow and (widths[-1] == 40) == (not narrow)


def test_whitening_of_little(spark):
    assert W.whiten(table(spark, [])).count() == 0
    assert W.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    assert W.whiten(table(spark, [(1, [0.5, 0.25])] * 3)).count() == 0  # no variance
    few = W.whiten(table(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0]), (3, [1.0, 2.0, 3.0])])).collect()
    assert sorted(((r.vec_id is None, r.vec_id or 0, r.component, r.n, r.deviation) for r in few)) == [(False, 1, 1, 2, 64**2), (False, 2, 1, 2, 64**2), (True, 0, 1, 2, 64**2)]
    assert all(abs(abs(r.whitened) - 1) < 1e-12 for r in few)


def test_integers_are_cut_and_exact():
    centre = W.Centre(1 << 40, np.array([3, -5], np.int64))
    assert centre.scaled(np.array([[1 << 25, -(1 << 25)]]))[0, 0] == (1 << 65) - 3
    assert W._deviation(centre.scaled(np.array([[1 << 25, 0]]))).to_pylist() == [None]
    got, good = W.integers(pa.array([[1e30, -1.0], None, [0.015625, None]], pa.list_(pa.float64())))
    assert got.to_pylist()[0] == [1 << 25, -64] and good.tolist() == [True, False, False]


# ---- ball k-means --------------------------------------------------------------------------


def plain_k_means(rows, clusters=16, rounds=3, dimensions=64):
    kept = [(i, whole(v)) for i, v in rows if v is not None and len(v) == dimensions and all(c is not None and np.isfinite(c) for c in v)]
    named = sorted(((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept))[:clusters]
    centroids = [v for _, _, v in named]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            members = [v for (_, v), o in zip(kept, own) if o == j]
            if members:
                centroids[j] = [sum(c) // len(members) for c in zip(*members)]
    final = [near(v) for _, v in kept]
    inertia = [sum(d for d, j in final if j == k) for k in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((repr(i), j, d, inertia[j], sum(inertia), digest[j]) for (i, _), (d, j) in zip(kept, final))


def balls(spark, rows, **options):
    got = C.ball_k_means(table(spark, rows), **options)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((repr(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got.collect())


def test_balls_equal_comparing_everything(spark):
    random = np.random.default_rng(5)
    centres = random.standard_normal((6, 64))
    data = centres[random.integers(0, 6, 400)] + 0.3 * random.standard_normal((400, 64))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(data)]
    rows += [(500 + i, rows[3][1]) for i in range(200)] + [(3, rows[3][1]), (None, rows[4][1]), (900, None), (901, [1.0] * 63), (902, [None] * 64), (903, [float("-inf")] * 64)]
    assert balls(spark, rows) == plain_k_means(rows)


def test_balls_of_ties_and_little(spark):
    grid = [(i, [float(x), float(y)]) for i, (x, y) in enumerate((x, y) for x in range(-4, 5) for y in range(-4, 5))]
    assert balls(spark, grid, clusters=5, rounds=4, dimensions=2) == plain_k_means(grid, 5, 4, 2)
    assert balls(spark, grid[:3], clusters=5, dimensions=2) == plain_k_means(grid[:3], 5, 3, 2)
    same = [(i, [1.0, 1.0]) for i in range(9)]  # all but the first cluster stay empty
    assert balls(spark, same, clusters=4, dimensions=2) == plain_k_means(same, 4, 3, 2)
    assert balls(spark, [], dimensions=2) == [] and balls(spark, [(1, None)], dimensions=2) == []


def test_stable_cores_are_not_compared():
    random = np.random.default_rng(1)
    centres = random.integers(-1000, 1000, (16, 64))
    labels = random.integers(0, 16, 3000).astype(np.int32)
    rows = centres[labels] + random.integers(-20, 20, (3000, 64))
    around = C.Balls.around(centres, np.full(16, 200.0))
    cluster, distance, compared = C.settle(rows, labels, around)
    assert compared == 0 and not any(around.neighbours)
    every, best = C.nearest(rows, centres)
    assert (cluster == every).all() and (distance == best).all()
    wrong = ((labels + 1) % 16).astype(np.int32)
    cluster, distance, compared = C.settle(rows, wrong, C.Balls.around(centres, np.full(16, np.inf)))
    assert (cluster == every).all() and (distance == best).all() and compared > 0


# ---- word table ----------------------------------------------------------------------------

ODD = ["", None, " \n\t ", "one", "one one  ONE\n one", "don't we'll it's", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", " ", "a b 　 c", "ΣΑΣ İstanbul ß é é ́x", "😀😀 12345 -- ... [x]", "\x00 \x7f ﻿", "Ünïcödé " * 50, "x" * 5000, " ".join(f"w{i}" for i in range(4000)), "ﬁ ½ ²  a​b"]


def plain_words(rows):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path())
    out = []
    for i, text in rows:
        ids = own.encode(text or "", add_special_tokens=False).ids
        out.append((repr(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("numbers", [[], [0], [0, 0, 255], [256, 1, 70_000], [1 << 40, 3]])
def test_packed_numbers_come_back(numbers):
    data = T.packed(np.array(numbers, np.int64))
    got, at = T.unpacked(b"xyz" + data + b"rest", 3)
    assert got.tolist() == numbers and at == 3 + len(data)


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 300, "buckets": 3}, {"chunk_bytes": 1, "buckets": 1}])
def test_word_table_equals_whole_texts(spark, options):
    rows = [(i, x) for i, x in enumerate(ODD)] + [(3, "again"), (None, "no id"), (None, None)]
    docs = spark.createDataFrame([(i, x, "p", "w") for i, x in rows], "doc_id long, text string, path string, words string").repartition(3)
    got = T.encode_decode(docs, tokenizer_path(), **options)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((repr(r.doc_id), *r[1:]) for r in got.collect()) == plain_words(rows)


def test_word_table_of_nothing_and_other_ids(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert T.encode_decode(none, tokenizer_path()).count() == 0
    named = spark.createDataFrame([("d1", "a b a")], "doc_id string, text string")
    assert T.encode_decode(named, tokenizer_path()).first().doc_id == "d1"
    with pytest.raises(ValueError):
        T.encode_decode(named, tokenizer_path("byte_bpe_50k.json"))


def test_words_are_encoded_once(spark, tmp_path):
    """However many chunks hold a word, its bucket's task spells it once."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("the same words and "), (F.col("id") % 7).cast("string")).alias("text"))
    blocks = T.word_blocks(docs, f"file://{tmp_path}", "doc_id", "text", chunk_bytes=100, buckets=4).collect()
    words = [zstandard.decompress(bytes(b.words)).split() for b in blocks]
    assert len({b.path for b in blocks}) > 20 and {w.decode() for x in words for w in x} == {"the", "same", "words", "and", *map(str, range(7))}
    spelled = []

    class Counting:
        tails: dict = {}

        def words(self, words):
            spelled.extend(words)
            return [b"\0\0\0\0" for _ in words]

    T._ENCODERS["counting"] = Counting()
    try:
        column = lambda name, kind: pa.array([getattr(b, name) for b in sorted(blocks, key=lambda b: b.bucket)], kind)
        batch = pa.RecordBatch.from_arrays([column("path", pa.string()), column("bucket", pa.int32()), column("start", pa.int64()), column("words", pa.binary())], names=["path", "bucket", "start", "words"])
        made = list(T.coded("counting")(iter([batch.slice(0, 50), batch.slice(50)])))
    finally:
        del T._ENCODERS["counting"]
    assert sorted(spelled) == sorted({w for x in words for w in x}) and sum(b.num_rows for b in made) == len(blocks)


def test_a_long_text_is_one_chunk(spark):
    text = " ".join(f"word{i % 1009}" for i in range(700_000))
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    got = T.encode_decode(docs, tokenizer_path(), chunk_bytes=1 << 20).collect()
    assert sorted((repr(r.doc_id), *r[1:]) for r in got) == plain_words([(1, text), (2, "short")])
