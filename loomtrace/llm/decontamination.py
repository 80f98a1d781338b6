"""Benchmark decontamination by word n-grams (operator 5). DataFrame expressions only.

A benchmark item's windows are all runs of ``n`` words (an item of fewer words is one window).
The distinct windows form a hash set. Each document is cut into words once; at each word the
hash of the window's first and last word is looked up in a bitmap, where that is set the hash of
four of its words in a hash table, and where that is found the whole window is compared word for word with the windows of that bucket. So the scan costs
one short hash a word, in the row itself: no row is multiplied, nothing is shuffled, and a
frequent passage costs no more than a rare one.

The index goes along with the plan, so its size is checked: up to ``max_windows`` distinct windows.
A larger benchmark is joined instead: documents' windows that pass a bitmap of hashes and benchmark
windows meet in a shuffled join on the window's hash, with the same result.

Cases: null, empty and wordless texts have no words and no hits, such items no window. Repeated
rows are judged one by one. An empty benchmark contaminates nothing; an item id that is null counts
as an item without a name and is left out of ``items``. Item ids are compared as strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise
from .texts import Bitmap, constant, lower_words, once

#: What separates words: everything in ASCII but digits and letters.
SEPARATOR = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"
N = 10
#: Distinct windows that may travel with the plan (about 150 bytes each).
MAX_WINDOWS = 60_000
#: Windows whose hashes may travel as a bitmap (about five bytes each).
MAX_BITMAP = 1_000_000


def words_of(text: Column) -> Column:
    """Normalised words; null has none."""
    return lower_words(text, SEPARATOR)


def benchmark_windows(benchmark: DataFrame, *, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: ``win`` (words), ``items`` (sorted distinct ids as strings)."""
    cut = benchmark.select(benchmark[id_col].cast("string").alias("item"), once(words_of(benchmark[text_col])).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))
    windows = cut.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, n))).alias("win"))
    return windows.groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _anchor_places(length: int) -> list[int]:
    return sorted({0, length // 3, 2 * length // 3, length - 1})


def _anchor(words: Column, start: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(words, start + p) for p in _anchor_places(length)])


def _ends(words: Column, start: Column, length: int) -> Column:
    return F.xxhash64(F.get(words, start), F.get(words, start + (length - 1)))


def _ends_at(words: Column, length: int) -> Callable[[Column], Column]:
    return lambda i: _ends(words, i, length)


def _test_at(table: _Lookup) -> Callable[[Column], Column]:
    return lambda i: table.ends.holds(F.get("ends", i))


def _bucket_at(table: _Lookup, words: Column) -> Callable[[Column], Column]:
    return lambda i: table.bucket(words, i) != ""


class _Lookup:
    """The windows of one length as constants: a bitmap over the first and last word, which most
    places of a corpus fail, and hash buckets of the windows with their items, which decide.

    A bucket is a string of entries ``word word ...:item,item`` between tabs, the items as
    hexadecimal UTF-8. Words hold none of these separators.
    """

    def __init__(self, rows: list, length: int):
        self.length = length
        self.n_buckets = 1 << max(4, (2 * len(rows)).bit_length())
        buckets = [""] * self.n_buckets
        for r in rows:
            entry = " ".join(r.win) + ":" + ",".join(x.encode().hex() for x in r.items)
            buckets[r.anchor % self.n_buckets] += ("\t" if buckets[r.anchor % self.n_buckets] else "") + entry
        self.ends = Bitmap(sorted({r.ends for r in rows}), 64)
        self.buckets = constant(buckets, "\n")

    def bucket(self, words: Column, i: Column) -> Column:
        return F.get(self.buckets, _anchor(words, i, self.length).bitwiseAND(F.lit(self.n_buckets - 1).cast("bigint")).cast("int"))

    def hits(self, words: Column) -> Callable[[Column], Column]:
        """From a word's place to the hits that start there."""

        def hit(i: Column) -> Column:
            window = F.array_join(F.slice(words, i + 1, self.length), " ")
            same = F.filter(F.split(self.bucket(words, i), "\t"), lambda e: F.substring_index(e, ":", 1) == window)
            items = lambda e: F.transform(F.filter(F.split(F.substring_index(e, ":", -1), ","), lambda x: x != ""), lambda x: F.decode(F.unhex(x), "UTF-8"))
            return F.transform(same, lambda e: F.struct(i.alias("start"), F.lit(self.length).alias("length"), items(e).alias("items")))

        return hit


def _spans_in_row(docs: DataFrame, rows: list) -> DataFrame:
    """Adds ``hits``: array of (start, length, items), in order of length, then start."""
    out, found = docs, []
    words = F.col("w")
    for length in sorted({len(r.win) for r in rows}):
        table = _Lookup([r for r in rows if len(r.win) == length], length)
        starts = F.when(F.size(words) >= length, F.sequence(F.lit(0), F.size(words) - length)).otherwise(F.array().cast("array<int>"))
        # In steps, so that nothing is computed twice for a place.
        out = out.withColumn("ends", F.transform(starts, _ends_at(words, length)))
        out = out.withColumn("at", F.filter(starts, _test_at(table)))
        out = out.withColumn("at", F.filter("at", _bucket_at(table, words))).drop("ends")
        name = f"hits_{length}"
        out = out.withColumn(name, F.when(F.size("at") > 0, F.flatten(F.transform("at", table.hits(words))))).drop("at")
        found.append(name)
    none = F.array().cast("array<struct<start:int,length:int,items:array<string>>>")
    hits = F.concat(*[F.coalesce(F.col(x), none) for x in found]) if found else none
    return out.withColumn("hits", hits).drop(*found)


def _spans_joined(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """The same for a benchmark of any size: windows meet in a shuffled join on their hash. Rows are
    numbered in a written table, so that a recomputation can't number them anew. Places whose hash
    isn't in a bitmap of the windows' hashes (up to ``MAX_BITMAP`` of them) stay out of the join."""
    windows = materialise(windows, "benchmark-windows")
    lengths = [r[0] for r in windows.select(F.size("win").alias("n")).distinct().collect()]  # n at most
    keyed = materialise(docs.withColumn("row", F.monotonically_increasing_id()), "decontamination-rows")
    hashes = [r[0] for r in windows.select(F.xxhash64("win")).limit(MAX_BITMAP + 1).collect()]
    held = Bitmap(hashes, 16) if len(hashes) <= MAX_BITMAP else None

    def cut(n: int) -> Column:
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), F.xxhash64(F.slice("w", i + 1, n)).alias("hash"), F.lit(n).alias("length")))

    every = F.concat(*[cut(n) for n in lengths]) if lengths else F.array().cast("array<struct<start:int,hash:bigint,length:int>>")
    places = F.filter("x", lambda x: held.holds(x["hash"])) if held else F.col("x")
    scan = keyed.select("row", once(every).alias("x")).select("row", F.explode(places).alias("x")).select("row", "x.*")
    right = windows.select(F.xxhash64("win").alias("hash"), F.size("win").alias("length"), "win", "items")
    met = scan.join(right, ["hash", "length"])
    # Hashes of 64 bits nominate; the words decide.
    per = met.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("length", "start", "win", "items"))).alias("met"))
    joined = keyed.join(per, "row", "left")
    real = F.filter("met", lambda x: F.slice("w", x["start"] + 1, x["length"]) == x["win"])
    hits = F.transform(F.coalesce(real, F.array().cast("array<struct<length:int,start:int,win:array<string>,items:array<string>>>")), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"), x["items"].alias("items")))
    return joined.withColumn("hits", hits).drop("row", "met")


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, n: int = N, text_col: str = "text", max_windows: int = MAX_WINDOWS, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of each document, n_words, ``spans`` (word spans of
    the hits: start, end), n_hit, ``items`` and contaminated. Clashing names of the documents
    are replaced; ``row`` columns can be kept in a struct."""
    names = docs.columns if keep is None else keep
    own = [c for c in names if c not in ("n_words", "n_hit", "spans", "items", "contaminated")]
    source = docs.select(F.struct(*[docs[c] for c in own]).alias("doc"), words_of(docs[text_col]).alias("w"))
    windows = benchmark_windows(benchmark, n=n)
    of_length = lambda f: F.coalesce(*[F.when(F.size("win") == k, f(F.col("win"), F.lit(0), k)) for k in range(1, n + 1)])
    rows = windows.select("win", "items", of_length(_anchor).alias("anchor"), of_length(_ends).alias("ends")).limit(max_windows + 1).collect()
    marked = _spans_in_row(source, rows) if len(rows) <= max_windows else _spans_joined(source, windows)
    marked = marked.withColumn("hits", once(F.col("hits")))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    in_order = F.array_sort(F.transform("hits", lambda h: F.struct(h["start"].alias("start"), (h["start"] + h["length"]).alias("end"))))
    marked = marked.withColumn("in_order", F.when(F.size("hits") > 0, in_order))
    covered = F.aggregate("in_order", start, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end")))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    n_hit = F.coalesce(covered["n"], F.lit(0)).cast("long")
    return marked.select("doc.*", F.size("w").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("in_order", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"), F.coalesce(items, F.array().cast("array<string>")).alias("items"), (F.size("hits") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any hit, with all their columns."""
    names = docs.columns
    held = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs[options.pop("text_col", "text")].alias("text"))
    return find_contamination(held, benchmark, keep=["row"], **options).where(~F.col("contaminated")).select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """All documents; those with hits get ``clean_words``, their normalised words outside the
    spans, joined by blanks (null: nothing was removed)."""
    marked = find_contamination(docs, benchmark, text_col=text_col, **options)
    words = words_of(F.col(text_col))
    outside = F.filter(words, lambda w, i: ~F.exists("spans", lambda s: (s["start"] <= i) & (i < s["end"])))
    return marked.withColumn("clean_words", F.when(F.col("contaminated"), F.array_join(outside, " ")))
