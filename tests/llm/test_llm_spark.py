"""Operators through Spark, on tables with nulls, empty and odd texts, ties and clashing columns."""

import dataclasses
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.llm import chat_format, decontamination, license_scan, lm_scoring, mixing, near_dedup, quality, token_output, url_filter, warc
from loomtrace.llm import queries as Q

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, n_words int, kept boolean, items string"
WORDS = [f"w{i}" for i in range(90)]
LONG = " ".join(WORDS)
NEAR = " ".join(WORDS[:88] + ["x", "y"])
FAR = " ".join(f"v{i}" for i in range(70))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG, "a"), (2, LONG.upper(), "a"), (3, NEAR, "b"), (4, FAR, "b"), (4, FAR, "b"), (5, None, "c"), (6, "", None), (7, " \n\t ", None), (8, "one two", "a"), (9, "ONE  two", "b"), (None, FAR + " z", "c"), (10, "Été " * 60, "c"), (11, "x" * 20_000, "a")]
    return spark.createDataFrame([(*r, 7, False, "i") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def near_brute(rows):
    """(id, n, component) by all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None]
        out.append((key, len(sets[i]), min(ids, default=None)))
    return out


def test_near_duplicates(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = near_dedup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, near_brute(rows)))
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 10, 11, 4, 5, 6, 7, 8]
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.drop_near_duplicates(empty).count() == 0


def test_near_groups_without_a_common_centre(spark):
    """Chains and stars of copies, compared in blocks and hands of a few."""
    rng = np.random.default_rng(5)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 5)):
            words[at] = f"r{rng.integers(0, 10**9)}"
        rows.append((i, " ".join(words)))
    settings = near_dedup.SketchSettings(block=7, hand=3)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), settings=settings)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == sorted(near_brute(rows))


def test_quality(docs, empty):
    report = {r.doc_id: r for r in quality.quality_report(docs).collect()}
    assert report[1].kept and report[5].n_words == 0 and report[10].base_failed and report[11].n_words == 1
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 3, 4, 4, None]
    assert quality.quality_report(empty).count() == 0 and quality.keep_good(empty).count() == 0


def contaminated_brute(text, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        wins = {tuple(b[i : i + 10]) for i in range(max(1, len(b) - 9))} if b else set()
        for win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("most", [0, 60_000])
def test_decontamination(spark, docs, empty, most):
    items = [(1, " ".join(WORDS[10:25])), (2, "Two"), (3, None), (4, ", . "), (5, " ".join(WORDS[20:31])), (6, "ÉTÉ-été"), (12, "two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_contamination(docs, bench, max_windows=most)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, ",".join(r["items"])) for r in got.collect()) == sorted((str(r.doc_id), n, k, ",".join(f)) for r in docs.collect() for n, k, f in [contaminated_brute(r.text, items)])
    clean = decontamination.remove_contaminated(docs, bench, max_windows=most)
    assert clean.columns == docs.columns and clean.count() == sum(not contaminated_brute(r.text, items)[1] for r in docs.collect())
    assert decontamination.find_contamination(empty, bench, max_windows=most).count() == 0
    assert decontamination.find_contamination(docs, bench.where("false"), max_windows=most).where("contaminated").count() == 0
    spans = decontamination.remove_spans(docs, bench, max_windows=most).where("doc_id = 8").first()
    assert spans.clean_words == "one"


def test_mixing(spark, docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda r: (str(r.doc_id), r["size"], r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', 1 + cast(id % 97 as int))").alias("text"), F.expr("case when id % 3 = 0 then 'big' else concat('s', id % 7) end").alias("source"))
    sized = mixing.mix(many)
    total = sized.agg(F.sum("size")).first()[0]
    per = sized.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect()
    assert abs(sum(r.target for r in per) - 1.5 * total) < 1e-6 * total
    assert all(abs(r.taken - r.target) <= 97 and r.target <= 2 * r["size"] + 1e-6 for r in per)
    taken = mixing.take_mix(many)
    assert taken.columns == many.columns and taken.count() == sized.agg(F.sum("copies")).first()[0]
    assert mixing.mix(empty).count() == 0 and mixing.take_mix(empty).count() == 0
    assert mixing.take_mix(docs).count() == mixing.mix(docs).agg(F.sum("copies")).first()[0]


def test_small_buckets_make_a_tree(spark):
    sized = spark.range(500).select(F.col("id").cast("string").alias("key"), F.xxhash64("id").alias("draw"), (F.col("id") % 2).cast("int").alias("rank"), (F.col("id") % 50 + 1).alias("size"), F.lit(0.4).alias("expected"))
    rows = mixing.round_copies(sized, bucket=3).collect()
    assert len(rows) == 500
    for rank in (0, 1):
        own = [r for r in rows if r["rank"] == rank]
        assert abs(sum(r.copies * r["size"] for r in own) - 0.4 * sum(r["size"] for r in own)) <= 50


def test_token_output(docs, empty):
    manifest = token_output.write_token_files(docs, Q.tokenizer_path(), word_local=True, file_ids=100)
    got = token_output.read_token_files(manifest).orderBy("start").collect()
    plain = token_output.Encoder(Q.tokenizer_path(), False)
    want = sorted(((r.doc_id is not None, r.doc_id or 0, r.doc_id, plain.whole([r.text or ""])[0] + b"\x01\0\0\0") for r in docs.collect()), key=lambda x: x[:2])
    assert [r.doc_id for r in got] == [w[2] for w in want]
    assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(w[3]) // 4, zlib.crc32(w[3])) for w in want]
    assert [r.start for r in got] == np.cumsum([0] + [len(w[3]) // 4 for w in want])[:-1].tolist()
    assert token_output.read_token_files(token_output.write_token_files(empty, Q.tokenizer_path())).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/", "same"), (2, None, "same"), (3, "http://b/\nx", "other"), (4, "u", None), (5, "u", ""), (None, "v", "same"), (6, "é", "é" * 50_000)], "page_id long, url string, html string").withColumn("payload", F.lit(1))
    for compression in ("gzip", "none"):
        folder = warc.write_archive(pages, compression=compression)
        got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.page_report(spark, folder).collect()}
        assert got == {1: (4, "revisit", 2), 2: (4, "response", None), 3: (5, "response", None), 4: (0, "revisit", 5), 5: (0, "response", None), None: (4, "revisit", 2), 6: (100_000, "response", None)}
        found = warc.read_archive(spark, folder).where("record_type = 'response' and record_id = 'urn:page:6'").collect()
        assert len(found) == 1 and bytes(found[0].payload).decode() == "é" * 50_000 and found[0].payload_digest == warc.digest(("é" * 50_000).encode())
        assert warc.read_archive(spark, folder, columns="record_id string").where("record_id in ('urn:page:1', 'urn:page:2')").count() == 2
    assert warc.page_report(spark, warc.write_archive(pages.where("false"))).count() == 0


def test_chats(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\|done|>", "a\\", "<|turn|><|text|>", "", None, "<|more|>\\<\\\\s>", "[[INST]", "é\n"]
    rows = [(1, i, ["user", "assistant", "assistant", None][i % 4], t) for i, t in enumerate(texts)] + [(None, 1, "assistant", "x"), (2, None, "<|done|>", "y"), (2, None, "assistant", "z")]
    chats = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(0)))
    read = {r.conv_id: r for r in chat_format.read_chats(chats).collect()}
    assert [(t.role, t.text) for t in read[1].turns] == [(r or "", t or "") for _, _, r, t in rows[:9]]
    assert read[1].loss_text == "".join(t or "" for _, _, r, t in rows[:9] if r == "assistant")
    for r in chats.collect():
        at, under = 0, []
        for run in r.loss_runs:
            under += [r.formatted[at : at + run.chars]] if run.loss else []
            at += run.chars
        assert at == len(r.formatted) and len(under) == sum(r.loss_turns)
        assert r.formatted.count("<s>") == r.formatted.count("</s>") == r.formatted.count("[INST]") == 0
    with pytest.raises(ValueError):
        chat_format.ChatTemplate(open="<|a<", close="<|b|>")


def test_licenses(spark, docs, empty):
    mit = license_scan.TEMPLATES["MIT"]
    more = spark.createDataFrame([(20, f"{LONG}. Released under the MIT License. {FAR}"), (21, mit.replace("free of charge", "gratis")), (21, mit), (22, mit[:100]), (None, mit)], "doc_id long, text string")
    got = license_scan.scan_licenses(docs.select("doc_id", "text").unionByName(more)).collect()
    assert sorted((str(r.doc_id), r.license) for r in got) == [("20", "MIT (short)"), ("21", "MIT"), ("21", "MIT"), ("None", "MIT")]
    assert license_scan.scan_licenses(empty).count() == 0 and license_scan.scan_licenses(docs, {}).count() == 0


def test_licenses_of_any_number(spark, docs):
    mit = license_scan.TEMPLATES["MIT"]
    more = spark.createDataFrame([(20, f"{LONG}. Released under the MIT License. {FAR}"), (21, mit), (21, mit), (None, mit), (23, None)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(more)
    shown = lambda found: sorted((str(r.doc_id), r.license, r.n_shared, r.n_template) for r in found.collect())
    want = shown(license_scan.scan_licenses(rows))
    assert len(want) == 4
    assert shown(license_scan.scan_licenses(rows, max_windows=0)) == want
    assert shown(license_scan.scan_licenses(rows, max_windows=0, max_bitmap=0)) == want
    # a table of 2,500 notices of 16 words, above the bound on windows
    notice = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.hex(F.xxhash64("id", i))), " ")
    many = spark.range(2500).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("license"), notice.alias("notice"))
    texts = many.where("license in ('n3', 'n77', 'n2499')").select(F.regexp_extract("license", r"\d+", 0).cast("long").alias("doc_id"), F.concat(F.lit(f"{FAR} "), "notice", F.lit(f" {LONG}")).alias("text"))
    held = [("2499", "n2499", 12, 12), ("3", "n3", 12, 12), ("77", "n77", 12, 12)]
    assert shown(license_scan.scan_licenses(texts, many)) == held
    assert shown(license_scan.scan_licenses(texts, many, max_windows=100_000)) == held


def test_no_short_notice_is_lost_at_the_ends_of_texts(spark):
    n, notices = 6000, {f"n{i}": f"a{i} b{i} c{i} d{i} e{i}" for i in range(100)}
    notice = F.concat_ws(" ", *[F.concat(F.lit(c), (F.col("doc_id") % 100).cast("string")) for c in "abcde"])
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.hex(F.xxhash64("doc_id", i))), " ")
    docs = spark.range(n).select(F.col("id").alias("doc_id"), words.alias("w")).select("doc_id", F.when(F.col("doc_id") % 200 < 100, F.concat_ws(" ", notice, "w")).otherwise(F.concat_ws(" ", "w", notice)).alias("text"))
    got = license_scan.scan_licenses(docs, notices).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(i, f"n{i % 100}") for i in range(n)]


def test_url_rules(spark):
    urls = ["http://A.example.com/en/x", "https://www.example.com/en/?q", "x://example.com", "http://b.net/es/", "http://b.net/de/", "http://c.org/a#b", None, "nope", "http://example.com/en", "://com/p?x"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string").withColumn("rule", F.lit(0))
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(10)] == [("a.example.com", "/en/x", "example.com/en/"), ("www.example.com", "/en/", "www.example.com/en/"), ("example.com", "", None), ("b.net", "/es/", "net/es/"), ("b.net", "/de/", None), ("c.org", "/a", None), ("", "", None), ("", "", None), ("example.com", "/en", "com/"), ("com", "/p", "com/")]
    assert [got[i].verdict for i in (0, 1, 3, 5, 6)] == ["block", "allow", "block", "allow", "allow"]
    long = [*url_filter.RULES, *[("block", f"h{i}.zz/") for i in range(url_filter.MAX_INLINE)]]
    by_join = {r.page_id: r for r in url_filter.filter_urls(pages, long).collect()}
    assert all(by_join[i].rule == got[i].rule for i in got)
    assert url_filter.filter_urls(pages.where("false")).count() == 0


def test_distrust_spreads_to_those_who_link(spark):
    link = lambda h: f'<a class="x" href="http://{h}/">'
    pages = spark.createDataFrame([(1, "http://spam.net/es/1", ""), (2, "http://friend.org/", link("spam.net") * 3), (3, "http://good.com/", link("fine.org")), (4, "http://fine.org/", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    assert got[2].verdict == "block" and got[4].verdict == "allow" and got[4].trust > 0 and got[2].distrust > 0


@pytest.mark.parametrize("hot", [1, 40])
def test_a_hot_blocked_host_hides_no_other(spark, hot):
    """Verdicts of other hosts don't follow the number of pages of one."""
    urls = [f"http://hot.net/es/{i}" for i in range(hot)] + ["http://small.net/es/1", "http://small.net/de/1", "http://mixed.com/1", "http://plain.org/"]
    got = {r.path + r.host: r.verdict for r in url_filter.filter_urls(spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")).collect()}
    assert (got["/de/1small.net"], got["/1mixed.com"], got["/plain.org"]) == ("block", "allow", "allow")


SMALL = lm_scoring.ModelSettings(hot=3, warm_ids=300, warm_steps=5, classes=4, width=4, share=0.5)


def scored(docs, settings=SMALL):
    import public_tokenizers

    return lm_scoring.score_documents(docs, Q.tokenizer_path(Q.LOSSLESS), public_tokenizers.PATTERN, settings=settings)


def check_base(rows, got):
    """rows: id, words. got: what was found, by id and number of tokens."""
    train = [w for i, ws in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in (*ws, None)]
    counts = {}
    for w in train:
        counts[w] = counts.get(w, 0) + 1
    for i, ws in rows:
        r = got[i, len(ws) + 1]
        assert r.train_tokens == len(train) and r.n_known == sum(w in counts for w in (*ws, None)) and r.score < 0
        assert r.base_score == pytest.approx(sum(np.log10((counts.get(w, 0) + 1) / (len(train) + len(counts) + 1)) for w in (*ws, None)))


def test_language_model(docs, empty):
    check_base([(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()], {(r.doc_id, r.n_tokens): r for r in scored(docs).collect()})
    assert scored(empty).count() == 0


def test_scores_do_not_depend_on_the_frequent_words(spark):
    rng = np.random.default_rng(2)
    parts = ["ba", "ke", "lor", "min", "zu", "tra"]
    texts = [" ".join("".join(rng.choice(parts, rng.integers(1, 5))) for _ in range(30)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    few, many = (scored(docs, dataclasses.replace(SMALL, hot=h)).orderBy("doc_id").collect() for h in (3, 10**6))
    for x, y in zip(few, many):
        assert (x.n_known, x.score, x.base_score) == (y.n_known, pytest.approx(y.score), pytest.approx(y.base_score))


def test_the_model_learns_from_all_documents(spark):
    """What only documents outside the first fit say changes the scores of all."""
    texts = [f"aa bb dd cc {'aa cc ' * 9}" if k < 5 else "aa bb cc dd " * 9 for k in range(40)]
    other = [t if k < 39 else "dd aa cc bb " * 9 for k, t in enumerate(texts)]
    first, second = ({r.doc_id: r.score for r in scored(spark.createDataFrame(list(enumerate(x)), "doc_id long, text string").coalesce(1)).collect()} for x in (texts, other))
    assert zlib.crc32(b"39") % 7 != 2 and all(first[k] != second[k] for k in range(39))


def test_a_second_corpus_is_scored_by_its_own_counts(spark):
    """Two corpora in one session, whose workers are the same."""
    for texts in (["aa bb aa cc aa"] * 12, ["aa dd", *["dd bb ee dd"] * 11]):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        check_base([(i, t.split()) for i, t in enumerate(texts)], {(r.doc_id, r.n_tokens): r for r in scored(docs).collect()})


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_held_out_texts_are_better_predicted_than_by_word_counts(spark):
    """At the size where the corpus is large enough for neighbours to be known; sf0.001 is not."""
    sums = Q.op2_lm_scoring(spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert sums.s > sums.b


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = Q.queries()[name](spark, SF)
    cursor = con.execute(Q.oracle_sql()[name])
    names = sorted(d[0] for d in cursor.description)
    order = [d[0] for d in cursor.description]
    assert sorted(got.columns) == names
    assert sorted(str([r[c] for c in names]) for r in got.collect()) == sorted(str([r[order.index(c)] for c in names]) for r in cursor.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_pipeline_stage_by_stage(spark):
    """Each stage against brute force on what its predecessor kept."""
    import corpus_pipeline
    import pyarrow as pa

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "near dedup", "decontamination", "mixing", "token ids"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        sized = docs
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), "test-stage")
        kept[name] = docs.collect()
        ids = [r.doc_id for r in kept[name]]
        if name != "token ids":
            assert docs.columns == columns and all(r == before[r.doc_id] for r in kept[name])
        if name == "quality rules":
            verdict = quality.measure(pa.array([r.text for r in before.values()]), quality.QualityLimits()).column("kept").to_pylist()
            assert sorted(ids) == sorted(i for i, ok in zip(before, verdict) if ok)
        if name == "near dedup":
            brute = near_brute([(i, r.text) for i, r in before.items()])
            assert sorted(ids) == sorted(i for i, _, c in brute if i == c)
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert sorted(ids) == sorted(i for i, r in before.items() if not contaminated_brute(r.text, items)[1])
        if name == "mixing":
            plan = {r.doc_id: r.copies for r in mixing.mix(sized).collect()}
            assert all(ids.count(i) == n <= 2 for i, n in plan.items())
        if name == "token ids":
            plain = token_output.Encoder(Q.tokenizer_path(), False)
            want = {i: zlib.crc32(plain.whole([r.text])[0] + b"\x01\0\0\0") for i, r in before.items()}
            assert ids == sorted(ids) or sorted(ids) == sorted(r.doc_id for r in kept["mixing"])
            assert all(r.ids_crc32 == want[r.doc_id] for r in kept[name])
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, clashing names; and no rows at all."""
    import corpus_pipeline

    words = [f"w{i}" for i in range(400)]
    body = [" ".join(words[k : k + 80]) for k in (0, 100, 200, 300)]
    rows = [(1, body[0], "a"), (1, body[0], "a"), (2, body[1], None), (None, body[2], "b"), (3, None, "a"), (4, "", None), (None, None, None), (5, " ".join(f"x{i}" for i in range(60_000)), "b"), (6, body[3] + " end", "a"), (7, body[3], "b")]
    odd = spark.createDataFrame([(*r, "k", 1, None) for r in rows], "doc_id long, text string, source string, `set` string, n_words int, row string")
    items = spark.createDataFrame([(1, None), (2, "w100 w101 w102 w103 w104 w105 w106 w107 w108 w109")], "item_id long, text string")
    for name, docs in (("odd", odd), ("empty", odd.where("false"))):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        items.write.parquet(f"{folder}/benchmark.parquet")
        out = [r.doc_id for r in corpus_pipeline.run(spark, folder).collect()]
        held = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, run in corpus_pipeline.STAGES[:-1]:
            held = corpus_pipeline.materialise(run(spark, held, folder), "odd-stage")
            assert held.columns == docs.columns
            kept = [r.doc_id for r in held.collect()]
            if name == "odd" and stage == "near dedup":
                assert sorted(kept, key=str) == [1, 2, 5, 6, None]
            if name == "odd" and stage == "decontamination":
                assert sorted(kept, key=str) == [1, 5, 6, None]
        assert sorted(out, key=str) == sorted(kept, key=str) and (name == "odd" or not out)
