"""Parts of the operators against brute force, without Spark."""

import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomtrace.llm import lm_scoring as L
from loomtrace.llm import near_dedup as N
from loomtrace.llm import quality as Q
from loomtrace.llm import token_output as T
from loomtrace.llm import warc as WA
from loomtrace.llm.mixing import _round_chain
from loomtrace.llm.queries import tokenizer_path


def longest_repeats(words, least):
    out = []
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            k = 0
            while i != j and max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        out.append(best if best >= least else 0)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_repeats_of_a_suffix_array(seed):
    rng = random.Random(seed)
    docs = [[rng.randrange(rng.choice([2, 3, 30])) for _ in range(rng.randrange(60))] for _ in range(6)] + [[1, 2, 3] * 15, [], [7] * 9]
    words = np.array([w for d in docs for w in d], np.int64)
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    again = Q.repeated_windows(words, doc, 3)
    want = [x for d in docs for x in longest_repeats(d, 3)]
    assert sorted(again.tolist()) == [i for i, x in enumerate(want) if x > 0]
    assert Q.longest_repeats(words, doc, 3, again).tolist() == want
    some = again[doc[again] % 2 == 0]  # of some documents only
    assert Q.longest_repeats(words, doc, 3, some).tolist() == [x if d % 2 == 0 else 0 for x, d in zip(want, doc.tolist())]


def test_quality_statistics():
    text = "a b c\n\nx #1 été\na b c\n a b c"
    row = Q.measure(pa.array([text, None, "", " \n\t", "one " * 60, "word%d " * 3], pa.string()), Q.QualityLimits()).to_pylist()
    first = row[0]
    assert (first["n_words"], first["word_chars"], first["n_symbols"], first["n_dup_lines"]) == (12, 15, 1, 1)
    assert first["n_repeat_words"] == 9 and first["base_failed"] and not first["kept"]
    assert all(r["n_words"] == 0 and r["base_failed"] for r in row[1:4])
    assert row[4]["n_words"] == 60 and row[4]["n_repeat_words"] == 60 and row[4]["longest_repeat"] is None
    clean = " ".join(f"w{i}" for i in range(80))
    assert Q.measure(pa.array([clean, clean + " " + clean[:200]]), Q.QualityLimits()).column("kept").to_pylist() == [True, False]


@pytest.mark.parametrize("n", [0, 1, 5, 1024, 1025, 5000])
def test_token_files_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.choice([1, 7, 300, 49000, 2**31, 2**32 - 1], n).astype("<u4") if n % 2 else rng.integers(0, 500, n).astype("<u4")
    cuts = np.sort(rng.integers(0, n + 1, 4))
    lengths = np.diff(np.concatenate([[0], cuts, [n]]))
    names = [3, None, -9, 2**60, 0]
    data = T.encode_file(ids, names, lengths)
    got, got_names, got_lengths = T.decode_file(data)
    assert (got == ids).all() and got_names == names and (got_lengths == lengths).all()
    at = 0
    for k, size in enumerate(lengths):
        assert (T.decode_document(data, k) == ids[at : at + size]).all()
        at += size
    with pytest.raises(ValueError):
        T.decode_file(data[:-1])


def test_word_local_encoding_is_the_tokenizers():
    encoder = T.Encoder(tokenizer_path(), True, most_words=5)
    whole = T.Encoder(tokenizer_path(), False)
    texts = ["Hello,  world's end", "", " \t\n", "Été À L'ŒUVRE é İ", "a<|endoftext|>b <|ENDOFTEXT|>", "x" * 300 + " 123 ---", " a　b \x1c c", "don't <|startoftext|>"]
    for _ in range(3):  # new, cached, and after words were dropped
        same_ids(encoder, whole, texts)


def same_ids(encoder, whole, texts):
    (ids, lengths), (want, wanted) = (e.encode([t.encode() for t in texts]) for e in (encoder, whole))
    assert ids.tolist() == want.tolist() and lengths.tolist() == wanted.tolist()


@pytest.mark.parametrize("seed", range(3))
def test_encoding_of_random_strings(seed):
    rng = random.Random(seed)
    letters = [*"aAbTtÉéEèßÀ\u0308\u0344'sdm.,!<|>*   \u0085\x1c9０日本ΣσςİıſKẗﬀ×÷ÿŸ\n\t", "'s", "<|endoftext|>", "Don't", "\u0345"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    same_ids(T.Encoder(tokenizer_path(), True, most_words=300), T.Encoder(tokenizer_path(), False), texts)


def test_capitals_with_combining_marks_keep_their_ids():
    texts = ["T\u0308ag und Nacht", "plain J\u030cam", "H\u0331 W\u030a X", "\u00c9T\u0308 \u0130 T\u0308,"]
    encoder, whole = T.Encoder(tokenizer_path(), True), T.Encoder(tokenizer_path(), False)
    for _ in range(2):  # new and cached
        same_ids(encoder, whole, texts)


@pytest.mark.parametrize("zipped", [True, False])
@pytest.mark.parametrize("plain_gzip", [True, False])
def test_warc_records(zipped, plain_gzip):
    payloads = [b"", b"x" * 100_000, bytes(range(256)) * 9, b"\r\n\r\nWARC/1.1\r\n"]
    raw = [WA.record(f"urn:page:{i}", "response", "http://a/\r\nb c", None, p, WA.digest(p), len(p)) for i, p in enumerate(payloads)]
    raw.append(WA.record("urn:page:9", "revisit", None, "urn:page:1", b"", WA.digest(payloads[1]), len(payloads[1])))
    if zipped:
        import gzip

        raw = [gzip.compress(r) if plain_gzip else WA.member(r) for r in raw]
    skipped = [h["warc-record-id"] for h, _ in WA._Records(io.BufferedReader(io.BytesIO(b"".join(raw))))]
    assert skipped == [f"<urn:page:{i}>" for i in (0, 1, 2, 3, 9)]
    blocks = [block() for _, block in WA._Records(io.BufferedReader(io.BytesIO(b"".join(raw))))]
    assert [b.partition(b"\r\n\r\n")[2] for b in blocks[:4]] == payloads and b"100000" in blocks[4]


def test_sketch_estimates_and_registers_merge():
    s = N.SketchSettings()
    rng = np.random.default_rng(1)
    for shared, own in ((300, 0), (300, 40), (300, 100), (100, 300), (0, 200)):
        base = rng.integers(0, 1 << 63, shared + 2 * own + 1, np.uint64)
        a, b = np.unique(base[: shared + own + 1]), np.unique(np.concatenate([base[:shared], base[shared + own + 1 :], base[shared : shared + 1]]))
        regs = N.registers([a, b, np.union1d(a, b)], s)
        assert (np.maximum(regs[0], regs[1]) == regs[2]).all()
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = N.estimate(regs[:1], regs[1:2], np.array([float(len(a))]), np.array([float(len(b))]), s)[0]
        assert abs(got - exact) < 0.13


def test_band_recall_at_the_limit():
    s = N.SketchSettings()
    assert (1 - 0.75**s.rows) ** s.bands < 1e-4


def test_pivotal_rounding_keeps_mass():
    import pandas as pd

    rng = np.random.default_rng(3)
    sizes, fraction = rng.integers(1, 4000, 400), 0.37
    taken = []
    for seed in range(60):
        up, held, f = _round_chain(pd.DataFrame({"size": sizes, "fraction": fraction}), np.random.default_rng(seed))
        words = (up * sizes).sum() + (sizes[held] * f if held >= 0 else 0)
        assert abs(words - fraction * sizes.sum()) < 1e-3 * sizes.sum() ** 0.5 + 1
        taken.append(up)
    assert abs(np.mean(taken) - fraction) < 0.02


def test_windows_score_each_position_once():
    s = L.ModelSettings()
    lengths = np.array([1, 16, 17, 40, 3])
    inputs, targets = L.windows(lengths, s)
    real = targets[targets >= 0]
    assert sorted(real.tolist()) == list(range(int(lengths.sum())))
    bounds = np.append(0, np.cumsum(lengths))
    for row, aims in zip(inputs, targets):
        for k, aim in enumerate(aims.tolist()):
            if aim >= 0:
                assert row[s.context - s.stride + k] == (aim - 1 if aim not in bounds[:-1] else -1)


def small_model(s, size=11):
    """Tables from made-up counts, weights that matter."""
    rng = np.random.default_rng(0)
    classes = np.arange(size) % s.classes
    a, b = rng.integers(0, size, (2, 200))
    n = rng.integers(1, 9, 200)

    def rows(bin_of):
        seen = {}
        for x, y, k in zip(a.tolist(), b.tolist(), n.tolist()):
            for key in ((0, x, int(bin_of[y])), (1, y, int(bin_of[x]))):
                seen[key] = seen.get(key, 0) + k
        side, own, other = (np.array(c) for c in zip(*seen))
        return pa.table({"side": side, "id": own, "bin": other, "n": np.array(list(seen.values()))})

    prior, member = L.tables(rows(classes), classes, np.bincount(b, weights=n, minlength=size), s)
    model = L.Attention(prior.astype(np.float32), classes, member, rng.standard_normal((size, s.width)), s)
    for name in ("o", "e", "p"):
        model.w[name] = rng.standard_normal(model.w[name].shape).astype(np.float32) / 2
    return model


def by_position(model, ids, s):
    """log10 probabilities of one text's ids, one place at a time."""
    w = {k: m.astype(np.float64) for k, m in model.w.items()}
    out = []
    for i, target in enumerate(ids):
        nth, query = divmod(i, s.stride)
        first = nth * s.stride + s.stride - s.context  # the target that the window's first input stands before
        before = [(j - first, ids[j - 1] if j > 0 else model.end) for j in range(first, i + 1)]
        last = before[-1][1]
        q = w["x"][last] @ w["q"]
        logits = np.array([q @ (w["x"][x] @ w["k"]) / np.sqrt(s.width) + w["p"][query, k] for k, x in before])
        a = np.exp(logits - logits.max())
        a /= a.sum()
        h = sum(p * (w["x"][x] @ w["v"]) for p, (_, x) in zip(a, before))
        z = np.exp(h @ w["o"] + w["x"][last] @ w["e"] + w["b"] + model.prior[last].astype(np.float64))
        out.append(np.log10(z[model.classes[target]] / z.sum()) + model.member[model.classes[last], target])
    return out


def test_windows_score_as_one_position_at_a_time_does():
    s = L.ModelSettings(classes=5, width=4, context=6, stride=3)
    model, rng = small_model(s), np.random.default_rng(3)
    texts = [rng.integers(0, 11, n) for n in (1, 2, 7, 30, 3)]
    want = [x for t in texts for x in by_position(model, t.tolist(), s)]
    for c in range(s.classes):  # shares of a class's members sum to one
        assert np.allclose(np.bincount(model.classes, weights=10.0 ** model.member[c]), 1, atol=1e-5)
    model.ready()
    got = model.scores(np.concatenate(texts), np.array([len(t) for t in texts]))
    assert np.allclose(got, want, atol=1e-4)


def test_every_training_window_is_fitted_once():
    model, seen = small_model(L.ModelSettings(classes=5, width=4, context=6, stride=3, batch=8)), []
    model.learn = lambda before, after, real: seen.append(after[real]) or 0.0
    model.fit(np.arange(138), np.array([100, 1, 37]), np.random.default_rng(4), share=L.ModelSettings().share)
    assert sorted(np.concatenate(seen).tolist()) == list(range(138)) and len(seen) > 4


def test_attention_is_causal_and_its_gradients_are_right():
    s = L.ModelSettings(classes=5, width=4, context=6, stride=3, batch=8)
    model = small_model(s)
    ids, lengths = np.random.default_rng(1).integers(0, 10, 30), np.array([30])
    inputs, targets = L.windows(lengths, s)
    before, after, real = model.before(ids, inputs), ids[np.maximum(targets, 0)], targets >= 0
    _, grads, dx = model.gradients(before, after, real)
    grads["x"] = np.zeros_like(model.w["x"])
    np.add.at(grads["x"], before.reshape(-1), dx)
    for name, g in grads.items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = model.w[name][i]
        model.w[name][i] = old + 1e-2
        up = model.gradients(before, after, real)[0]
        model.w[name][i] = old - 1e-2
        down = model.gradients(before, after, real)[0]
        model.w[name][i] = old
        assert (up - down) / 2e-2 == pytest.approx(g[i], rel=0.08, abs=2e-3)
    losses = model.fit(np.tile(np.arange(10), 30), np.array([300]), np.random.default_rng(2), steps=200)
    assert np.mean(losses[-20:]) < 0.75 * losses[0]
    model.ready()
    own = model.scores(ids, lengths)
    changed = ids.copy()
    changed[20] = (changed[20] + 5) % 10
    assert np.allclose(own[:20], model.scores(changed, lengths)[:20]) and not np.allclose(own[21:], model.scores(changed, lengths)[21:])


def two_steps_by_position(model, ids, s):
    """log10 probabilities of one text's classes, one place at a time: of all classes after each place."""
    w = {k: m.astype(np.float64) for k, m in model.w.items()}
    group, out = np.arange(s.classes) // L.GROUP, []
    for i in range(len(ids)):
        nth, query = divmod(i, s.stride)
        first = nth * s.stride + s.stride - s.context
        before = [(j - first, ids[j - 1] if j > 0 else model.end) for j in range(first, i + 1)]
        x = w["x"][before[-1][1]]
        a = np.exp([x @ w["q"] @ (w["x"][b] @ w["k"]) / np.sqrt(s.width) + w["p"][query, k] for k, b in before])
        h = sum(p * (w["x"][b] @ w["v"]) for p, (_, b) in zip(a / a.sum(), before))
        share = np.exp(model.prior[before[-1][1]].astype(np.float64))
        of_group = np.bincount(group, weights=share) * np.exp(h @ w["go"] + x @ w["ge"] + (h * x) @ w["gi"] + w["gb"])
        of_class = share * np.exp(h @ w["o"] + x @ w["e"] + (h * x) @ w["i"] + w["b"])
        out.append(np.log10((of_group / of_group.sum())[group] * of_class / np.bincount(group, weights=of_class)[group]))
    return np.array(out)


def test_classes_are_chosen_by_group_then_within_it():
    """A target costs the groups and one group's classes, not all classes; the last group may be short."""
    s = L.ModelSettings(classes=20, width=4, context=6, stride=3, batch=8)
    model, rng = small_model(s, size=41), np.random.default_rng(6)
    for name in ("i", "go", "ge", "gi", "gb", "b"):
        model.w[name] = rng.standard_normal(model.w[name].shape).astype(np.float32) / 2
    ids = rng.integers(0, 40, 30)
    inputs, targets = L.windows(np.array([30]), s)
    before, after, real = model.before(ids, inputs), ids[np.maximum(targets, 0)], targets >= 0
    want = two_steps_by_position(model, ids.tolist(), s)
    assert np.allclose((10.0**want).sum(axis=1), 1)
    chosen = want[np.arange(30), model.classes[ids]]
    loss, grads, dx = model.gradients(before, after, real)
    assert loss == pytest.approx(-np.log(10) * chosen.mean(), rel=1e-4)
    grads["x"] = np.zeros_like(model.w["x"])
    np.add.at(grads["x"], before.reshape(-1), dx)
    assert set(grads) == set(model.w)
    for name, g in grads.items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, losses = model.w[name][i], []
        for step in (1e-2, -1e-2):
            model.w[name][i] = old + step
            losses.append(model.gradients(before, after, real)[0])
        model.w[name][i] = old
        assert abs(g[i]) > 1e-3 and (losses[0] - losses[1]) / 2e-2 == pytest.approx(g[i], rel=0.05, abs=1e-3)
    model.ready()
    member = model.member[model.classes[np.append(model.end, ids[:-1])], ids]
    assert np.allclose(model.scores(ids, np.array([30])), chosen + member, atol=1e-4)
    wide = small_model(L.ModelSettings(), size=300)
    wide.ready()
    assert {m.shape[1] for m in wide.out} == {8 + L.GROUP} and wide.s.classes == 128


def test_centres_that_are_alike_share_a_group():
    rng = np.random.default_rng(8)
    kind = rng.permutation(np.repeat(np.arange(4), L.GROUP))
    order = L.alike(rng.standard_normal((4, 9))[kind] * 9 + rng.standard_normal((4 * L.GROUP, 9)) / 9)
    assert sorted(order.tolist()) == list(range(4 * L.GROUP))
    assert all(len(set(kind[order[i : i + L.GROUP]].tolist())) == 1 for i in range(0, len(kind), L.GROUP))
    assert sorted(L.alike(rng.standard_normal((21, 3))).tolist()) == list(range(21))


def test_counts_of_hot_words_are_looked_up_once_and_follow_their_table():
    import public_tokenizers

    from loomtrace.llm.queries import LOSSLESS

    own = L.Speller(tokenizer_path(LOSSLESS), public_tokenizers.PATTERN, most_words=4)
    tables = {"one": {b"a": 5, b"b": 2}, "two": {b"a": 7}}
    asked, real = [], L.hot_words

    class Asked(dict):
        def get(self, key, default=None):
            asked.append(key)
            return super().get(key, default)

    try:
        L.hot_words = lambda path: Asked(tables[path])
        for path, words, want, looked in (("one", [b"a", b"x"], [5, 0], 2), ("one", [b"x", b"b", b"a"], [0, 2, 5], 1), ("two", [b"a", b"b"], [7, 0], 2), ("two", [b"c", b"d", b"e"], [0, 0, 0], 3), ("two", [b"e", b"a"], [0, 7], 2)):
            asked.clear()
            names = np.array(words, object)
            assert own.hot_counts(names, own.places(names), path).tolist() == want and len(asked) == looked
    finally:
        L.hot_words = real


def test_ids_of_words_are_their_bytes():
    import public_tokenizers

    from loomtrace.llm.queries import LOSSLESS

    own = L.Speller(tokenizer_path(LOSSLESS), public_tokenizers.PATTERN, most_words=4)
    texts = ["É é E\u0301 don't  a\u00a0b 日本\x1cx", "", " \t", "x" * 300 + " 12345 <|endoftext|>"]
    ids, lengths = own.encode([x.encode() for x in texts])
    for text, part in zip(texts, np.split(ids, np.cumsum(lengths)[:-1])):
        assert own.encoding.decode_bytes(part.tolist()) == b"".join(b" " + w for w in text.encode().lower().split())


def test_held_out_rule():
    assert sum(zlib.crc32(str(i).encode()) % 7 == 2 for i in range(7000)) in range(900, 1100)
    assert hashlib.sha1(b"").hexdigest() and WA.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert Counter(b"A b\x0bc".lower().split()) == Counter([b"a", b"b", b"c"])


def test_shingle_numbers_are_exact():
    from loomtrace.llm.near_dedup import shingle_numbers

    random = np.random.default_rng(4)
    texts = [b"", b" \n ", b"a b", b"A B", b"a b c d e", b"a  b\tC d E f", b"a b c d"] + [" ".join(random.choice(list("abc"), n)).encode() for n in (4, 5, 6, 40, 300, 300)]
    plain = [(set(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set()) for w in (x.lower().split() for x in texts)]
    got = shingle_numbers(texts, 5)
    assert [len(x) for x in got] == [len(x) for x in plain]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(np.intersect1d(got[i], got[j])) == len(plain[i] & plain[j])
    assert [len(x) for x in shingle_numbers([b"one", b""], 5)] == [1, 0] and shingle_numbers([], 5) == []


def test_a_text_of_forty_megabytes_and_its_copy_fit():
    """In a process of its own, whose peak is measured: below 1 GB beyond what it takes to start."""
    import subprocess
    import sys

    code = """
import resource, numpy as np
from loomtrace.llm.near_dedup import shingle_numbers
r = np.random.default_rng(0)
text = b" ".join(np.array([b"%06d" % i for i in range(50_000)])[r.integers(0, 50_000, 5_800_000)].tolist())
start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
a, b = shingle_numbers([text, text + b" tail"], 5)
print(len(text), len(np.intersect1d(a, b, assume_unique=True)) / len(b), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - start) / 1024)
"""
    size, share, mb = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(size) > 40_000_000 and float(share) > 0.99 and float(mb) < 1000, mb
