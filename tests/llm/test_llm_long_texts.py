"""Texts of megabytes, and empty tables where test_llm_spark has none."""

import json
import os
import subprocess
import sys

import pyarrow as pa
from pyspark.sql import functions as F

from loomtrace.llm import chat_format, license_scan, quality, url_filter

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Run in a process of its own, so that the peak is that of one text.
MEASURE = """
import json, resource, sys
import pyarrow as pa
from loomtrace.llm import quality
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss << 10
twice, once = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("r", 260_000), ("u", 800_000)))
text = f"{twice} {once} {twice}"
before = peak()
row = quality.measure(pa.array([text]), quality.QualityLimits()).to_pylist()[0]
print(json.dumps([len(text), peak() - before, row]))
"""


def test_a_long_text_with_a_long_repeat():
    """10 MB, two fifths of its words are one repeat: found whole, in memory bounded by the text."""
    said = subprocess.run([sys.executable, "-c", MEASURE], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=300, check=True)
    size, grown, row = json.loads(said.stdout)
    assert size > 10_000_000 and grown < 50 * size
    assert (row["n_words"], row["n_repeat_words"], row["covered_words"], row["longest_repeat"]) == (1_320_000, 520_000, 520_000, 260_000)
    assert not row["base_failed"] and not row["kept"]


def test_a_long_text_of_one_line():
    """Wholly repetitive: the base rule rejects it, and its repeats are not measured."""
    row = quality.measure(pa.array(["la di da dum " * 800_000]), quality.QualityLimits()).to_pylist()[0]
    assert row["n_words"] == row["n_repeat_words"] == 3_200_000 and row["base_failed"] and row["covered_words"] is None


def test_chats_empty_and_long(spark):
    schema = "conv_id long, turn long, role string, text string"
    nothing = chat_format.format_chats(spark.createDataFrame([], schema))
    assert nothing.count() == 0 and chat_format.read_chats(nothing).count() == 0
    turns = spark.createDataFrame([(1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "assistant", "")], schema)
    long = turns.withColumn("text", F.when(F.col("text") == "a", F.expr("repeat('<|done|>é ', 300000)")).otherwise(F.col("text")))
    read = chat_format.read_chats(chat_format.format_chats(long)).select(F.sha2("loss_text", 256).alias("sha"), F.char_length("loss_text").alias("chars"), F.size("turns").alias("turns")).first()
    want = long.where("turn = 2").select(F.sha2("text", 256).alias("sha"), F.char_length("text").alias("chars")).first()
    assert (read.sha, read.chars, read.turns) == (want.sha, 3_000_000, 3) and want.chars == 3_000_000


def test_a_licence_after_a_long_text(spark):
    """The notice is the last thing in a text of 2 MB; one of its like without it has none."""
    mit = license_scan.TEMPLATES["MIT"]
    docs = spark.createDataFrame([(1, mit), (2, "nothing")], "doc_id long, tail string").select("doc_id", F.concat(F.expr("array_join(transform(sequence(1, 300000), i -> concat('w', i)), ' ')"), F.lit(" "), "tail").alias("text"))
    assert docs.agg(F.min(F.length("text"))).first()[0] > 2_000_000
    assert [(r.doc_id, r.license) for r in license_scan.scan_licenses(docs).collect()] == [(1, "MIT")]


def test_a_long_url_and_a_long_page(spark):
    pages = spark.createDataFrame([(1, "http://WWW.example.com/en/"), (2, "http://a.net/fr/"), (3, "no host ")], "page_id long, url string")
    pages = pages.select("page_id", F.expr("concat(url, repeat('x', 1000000))").alias("url"), F.expr("repeat('<p>text</p>', 200000)").alias("html"))
    got = {r.page_id: (r.host, r.rule, r.verdict, r.chars) for r in url_filter.filter_urls(pages).select("page_id", "host", "rule", "verdict", F.length("path").alias("chars")).collect()}
    assert got[1] == ("www.example.com", "www.example.com/en/", "allow", 1_000_004)
    assert got[2] == ("a.net", "net/fr/", "block", 1_000_004)
    assert got[3][:2] == ("", None) and got[3][3] == 0
