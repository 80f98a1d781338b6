"""Near-duplicate groups with SetSketch registers (operator 9).

A document is the set of its distinct 5-word shingles. Each of ``bands * rows`` registers holds
floor(1 - log_b x), cut to a fixed range, of the least exponential variate x that the register's
hash gives to the set's members: registers of a union are the larger of both, and two registers
agree with about the probability of the sets' Jaccard similarity.

1. Copies: documents with equal sets form one class, and only classes go on.
2. Bands of registers hash to buckets. A class at the wanted similarity shares a bucket with its
   partner with probability 1 - (1 - s^rows)^bands, over 0.9999 at 0.75 with the default.
3. Stars: in each bucket all classes are compared with one centre, never all with all. The centre
   is the class that shares most buckets with others, so that groups of copies agree on one.
   Candidates are first estimated: the numbers of greater, lesser and equal registers give the
   similarity's likelihood, and pairs that are clearly below the limit go. The rest is confirmed
   on the full sets of shingles, from the texts.
4. Rest: each class that is not in its centre's component after that is compared with all classes
   of other components in its bucket, in blocks of bounded size inside a task, which gives back
   confirmed links alone. Pairs within one component need no more evidence, so no link between
   components is lost, and a group of many near copies costs its size, not its square.

Shingles are told apart by 64-bit hashes in steps 1, 2 and 4, by their words where step 3 confirms.

Components of classes come from alternating stars over written tables; nothing is collected.

Cases: null, empty and blank texts have no shingles and stand alone; texts of fewer words than a
shingle are one shingle. Repeated rows are copies. A null id is never the smallest unless the
whole component has none; such rows have a null component and are not kept by ``kept``, but
``drop_near_duplicates`` keeps one row of each component, whatever its ids. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .components import components
from .storage import materialise
from .texts import as_bytes, mix64, numbered, pieces, working


@dataclass(frozen=True)
class SketchSettings:
    """``percent``: similarity that links. ``base``, ``rate`` and ``limit`` are b, a and q + 1 of
    the sketch. ``slack``: standard deviations by which an estimate may fall short. ``block``:
    classes of either side of a block, about, and ``block_bytes`` of their texts. ``hand``: members
    that meet one copy of their centre's text, about."""

    shingle: int = 5
    percent: int = 75
    bands: int = 40
    rows: int = 5
    base: float = 1.001
    rate: float = 20.0
    limit: int = 65535
    slack: float = 4.0
    block: int = 2048
    block_bytes: int = 16 << 20
    hand: int = 256
    seed: int = 7

    @property
    def size(self) -> int:
        return self.bands * self.rows


def shingle_hashes(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The distinct 64-bit hashes of each text's shingles, sorted."""
    names, index, counts = numbered([t.lower() for t in texts])
    flat = np.array([xxhash.xxh3_64_intdigest(w) for w in names.tolist()], np.uint64)[index]
    total = len(flat)
    mixed = np.full(max(total, 1), 0x9E3779B97F4A7C15, np.uint64)[:total]
    for j in range(min(k, total)):  # position matters; short texts are hashed as a whole below
        mixed[: total - j] += flat[j:] * np.uint64((0xD6E8FEB86659FD93 * (4 * j + 1)) % (1 << 64))
    mixed = mix64(mixed)
    out, at = [], 0
    for text, n in zip(texts, counts.tolist()):
        if n >= k:
            out.append(np.unique(mixed[at : at + n - k + 1]))
        elif n:
            out.append(np.array([int.from_bytes(hashlib.blake2b(b" ".join(text.lower().split()), digest_size=8, key=b"short").digest(), "little")], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def registers(sets: list[np.ndarray], s: SketchSettings) -> np.ndarray:
    """SetSketch registers (16 bit) of non-empty sets."""
    random = np.random.default_rng(s.seed)
    salts = random.integers(0, 1 << 64, s.size, np.uint64)
    factors = random.integers(0, 1 << 63, s.size, np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(sets), s.size), np.uint16)
    begin = 0
    while begin < len(sets):  # a step fits into a core's cache, one long text aside
        end, n = begin, 0
        while end < len(sets) and (end == begin or n + len(sets[end]) <= 16_384):
            n += len(sets[end])
            end += 1
        members = np.concatenate(sets[begin:end])
        starts = np.append(0, np.cumsum([len(x) for x in sets[begin : end - 1]])).astype(np.int64)
        least = np.empty((s.size, end - begin), np.uint64)
        buffer = np.empty_like(members)
        for j in range(s.size):
            np.bitwise_xor(members, salts[j], out=buffer)
            np.multiply(buffer, factors[j], out=buffer)
            np.minimum.reduceat(buffer, starts, out=least[j])
        x = -np.log1p(-(least.T.astype(np.float64) + 1) / 2.0**64 * (1 - 1e-15)) / s.rate
        out[begin:end] = np.clip(np.floor(1 - np.log(x) / np.log(s.base)), 0, s.limit)
        begin = end
    return out


def band_keys(regs: np.ndarray, s: SketchSettings) -> np.ndarray:
    """One 64-bit key per band."""
    grouped = regs.reshape(len(regs), s.bands, s.rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, s.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), grouped.shape[:2]).copy()
    for r in range(s.rows):
        keys = mix64(keys ^ (grouped[:, :, r] + np.uint64((r + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64))))
    return keys.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, s: SketchSettings) -> np.ndarray:
    """Similarity of each pair: the most likely one, given which registers are greater, lesser
    and equal and how large both sets are, by a grid that is refined twice."""
    greater, lesser = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - greater - lesser
    u = n_a / (n_a + n_b)
    v = 1 - u
    top = np.minimum(u, v) / np.maximum(u, v)  # the smaller set within the larger
    f = (s.base - 1) / s.base

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * f) / np.log(s.base)

    def likelihood(j: np.ndarray) -> np.ndarray:
        over, under = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
        tiny = 1e-12
        return greater[:, None] * np.log(over + tiny) + lesser[:, None] * np.log(under + tiny) + equal[:, None] * np.log(np.maximum(1 - over - under, 0) + tiny)

    low, high = np.zeros(len(a)), top
    for _ in range(3):
        grid = low[:, None] + (high - low)[:, None] * np.linspace(0, 1, 33)
        best = likelihood(grid).argmax(axis=1)
        width = (high - low) / 32
        centre = low + best * width
        low, high = np.maximum(centre - width, 0), np.minimum(centre + width, top)
    return centre


def sketch(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", settings: SketchSettings = SketchSettings()) -> DataFrame:
    """doc_id, fp (hash of the text), bytes (of the text), n_shingles, set (128-bit digest of the
    shingle set; null without shingles), regs (16-bit registers as bytes), bands (array of keys)."""
    s = settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                sets = shingle_hashes(as_bytes(part.column("text")), s.shingle)
                sizes = np.array([len(x) for x in sets], np.int64)
                some = np.flatnonzero(sizes)
                regs = registers([sets[i] for i in some], s) if len(some) else np.zeros((0, s.size), np.uint16)
                keys = band_keys(regs, s)
                place = np.full(len(sets), -1)
                place[some] = np.arange(len(some))
                digest = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
                offsets = np.append(0, np.cumsum(np.where(sizes > 0, s.bands, 0))).astype(np.int32)
                long = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("fp"), long, pa.array(sizes), pa.array(digest, pa.binary()), pa.array([regs[i].tobytes() if i >= 0 else None for i in place.tolist()], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1)))], names=["doc_id", "fp", "bytes", "n_shingles", "set", "regs", "bands"])

    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("fp"))
    return source.mapInArrow(working("near", run), f"doc_id {source.schema['id'].dataType.simpleString()}, fp long, bytes long, n_shingles long, set binary, regs binary, bands array<long>")


def _likely(pairs: DataFrame, classes: DataFrame, s: SketchSettings) -> DataFrame:
    """The pairs (a, b) whose estimate isn't clearly below the limit."""
    side = classes.select("set", "n_shingles", "regs")
    left = side.select(F.col("set").alias("a"), F.col("n_shingles").alias("n_a"), F.col("regs").alias("regs_a"))
    right = side.select(F.col("set").alias("b"), F.col("n_shingles").alias("n_b"), F.col("regs").alias("regs_b"))
    # Sizes alone bound the similarity.
    sized = pairs.join(left, "a").join(right, "b").where(100 * F.least("n_a", "n_b") >= s.percent * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j = s.percent / 100
        least = j - s.slack * (j * (1 - j) / s.size) ** 0.5
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                regs = [np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(part.num_rows, s.size) for c in ("regs_a", "regs_b")]
                n = [part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b")]
                found = estimate(*regs, *n, s)
                yield part.filter(pa.array(found >= least)).select(["a", "b"])

    return sized.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(working("near", run), "a binary, b binary")


def shingle_numbers(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted numbers that mean the same in all of them: words are
    numbered, and a number is given to each pair of a shorter run and the word behind it. Exact, and
    some ten times smaller than sets of words."""
    words, index, counts = numbered([x.lower() for x in texts])
    runs = index
    for j in range(1, k):
        if len(index) <= j:
            break
        runs = np.unique(runs[: len(index) - j] * len(words) + index[j:], return_inverse=True)[1]
    ends = np.cumsum(counts)
    out: list[np.ndarray] = []
    short: dict[bytes, int] = {}
    for begin, end in zip((ends - counts).tolist(), ends.tolist()):
        if end - begin >= k:
            out.append(np.unique(runs[begin : end - k + 1]))
        elif end > begin:  # the whole sequence is one, and no window's
            out.append(np.array([-1 - short.setdefault(index[begin:end].tobytes(), len(short))]))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def _texts(wanted: DataFrame, docs: DataFrame, s: SketchSettings) -> DataFrame:
    """wanted: set, id and fp (of a document with that set). Returns set and text. Rows that repeat
    an id, or have none, are told apart by their text's hash."""
    found = wanted.join(docs.select(docs.id.alias("own"), F.xxhash64("text").alias("own_fp"), "text"), F.col("id").eqNullSafe(F.col("own")) & (F.col("fp") == F.col("own_fp"))).select("set", "text")

    def of_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Hashes of different texts may be equal.
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = shingle_hashes(as_bytes(part.column("text")), s.shingle)
                own = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() == y for x, y in zip(sets, part.column("set").to_pylist())]
                yield part.filter(pa.array(own, pa.bool_()))

    return found.mapInArrow(working("near", of_class), "set binary, text string").dropDuplicates(["set"])


def _confirmed(pairs: DataFrame, texts: DataFrame, s: SketchSettings) -> DataFrame:
    """The pairs (centre a, member b) that meet the limit on their full shingle sets. A centre's
    members are dealt to hands of about ``s.hand``; its text goes to each hand once, ahead of them."""
    hands = pairs.groupBy("a").agg(F.ceil(F.count("*") / s.hand).cast("long").alias("hands"))
    dealt = pairs.select("a", "b").join(hands, "a").select("a", "b", F.pmod(F.xxhash64("b"), "hands").alias("hand"))
    members = dealt.join(texts.select(F.col("set").alias("b"), "text"), "b").select("a", "hand", "b", "text")
    centres = dealt.select("a", "hand").distinct().join(texts.select(F.col("set").alias("a"), "text"), "a").select("a", "hand", F.lit(None).cast("binary").alias("b"), "text")
    rows = centres.unionByName(members).repartition("a", "hand").sortWithinPartitions("a", "hand", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, centre = None, b""
        for batch in batches:
            for part in pieces(batch, "text"):
                texts, linked, held = as_bytes(part.column("text")), [], None
                # The centre of an earlier piece is numbered again, with these texts.
                goes_on = part.column("b")[0].is_valid
                sets = shingle_numbers([centre if goes_on else b"", *texts], s.shingle)
                if goes_on:
                    held = sets[0]
                for a, b, text, own in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), texts, sets[1:]):
                    if b is None:
                        name, centre, held = a, text, own
                    elif a != name:
                        raise ValueError("a centre's text is missing")
                    both = len(np.intersect1d(held, own, assume_unique=True))
                    linked.append(b is not None and 100 * both >= s.percent * (len(held) + len(own) - both))
                yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return rows.select("a", "b", "text").mapInArrow(working("near", run), "a binary, b binary")


def _compare_blocks(left: pd.DataFrame, right: pd.DataFrame, s: SketchSettings) -> pd.DataFrame:
    """Confirmed links between the apart classes of a block and its other classes, as many as join
    their components. Columns: band, set, root, apart, n_shingles, regs, text."""
    if not len(left) or not len(right):
        return pd.DataFrame({"a": [], "b": []})
    regs = np.frombuffer(b"".join(right["regs"]), np.uint16).reshape(len(right), s.size)
    sizes = right["n_shingles"].to_numpy(float)
    j = s.percent / 100
    least = j - s.slack * (j * (1 - j) / s.size) ** 0.5
    parent: dict[bytes, bytes] = {}
    hashes: dict[bytes, np.ndarray] = {}

    def root(x: bytes) -> bytes:
        while x in parent:
            x = parent[x]
        return x

    def members(name: bytes, text: str) -> np.ndarray:
        if name not in hashes:
            hashes[name] = shingle_hashes([text.encode()], s.shingle)[0]
        return hashes[name]

    names, roots, apart, texts = right["set"].tolist(), right["root"].tolist(), right["apart"].tolist(), right["text"].tolist()
    out = []
    for band, name, own_root, n, own_regs, text in zip(left["band"], left["set"], left["root"], left["n_shingles"], left["regs"], left["text"]):
        own = np.frombuffer(own_regs, np.uint16)
        fits = np.flatnonzero(np.minimum(sizes, n) >= j * np.maximum(sizes, n))
        if not len(fits):
            continue
        same = regs[fits] == own
        # A pair that shares several bands is looked at in the first of them.
        fits = fits[same.reshape(len(fits), s.bands, s.rows).all(axis=2).argmax(axis=1) == band]
        if not len(fits):
            continue
        found = estimate(np.broadcast_to(own, (len(fits), s.size)), regs[fits], np.full(len(fits), float(n)), sizes[fits], s)
        for i in fits[np.argsort(-found)][: int((found >= least).sum())].tolist():
            if (apart[i] and names[i] <= name) or root(own_root) == root(roots[i]):
                continue
            x, y = members(name, text), members(names[i], texts[i])
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= s.percent * (len(x) + len(y) - both):
                parent[root(own_root)] = root(roots[i])
                out.append((name, names[i]))
    return pd.DataFrame(out, columns=["a", "b"])


def _rest(placed: DataFrame, held: DataFrame, texts: DataFrame, s: SketchSettings) -> DataFrame:
    """Links of classes apart from their centre's component, by blocks. placed: key, band, set,
    root, apart, and not the centres."""
    sized = placed.join(held.select("set", "bytes"), "set")
    apart = F.col("apart").cast("long")
    per = sized.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("n_bytes"), F.sum(apart).alias("m"), F.sum(apart * F.col("bytes")).alias("m_bytes")).where("m > 0 and n > 1")
    # Blocks of bounded rows and bytes: texts are dealt to them by a hash.
    parts = lambda rows, size: F.greatest(F.ceil(F.col(rows) / s.block), F.ceil(F.col(size) / s.block_bytes), F.lit(1)).cast("long")
    grid = per.select("key", parts("m", "m_bytes").alias("rows"), parts("n", "n_bytes").alias("columns"))
    full = placed.join(grid, "key").join(held.select("set", "n_shingles", "regs"), "set").join(texts, "set").withColumn("h", F.xxhash64("set"))
    full = materialise(full, "near-rest")
    fields = ["band", "set", "root", "apart", "n_shingles", "regs", "text"]
    left = full.where("apart").select("key", F.pmod("h", "rows").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1)).alias("j"), *fields)
    right = full.select("key", F.pmod("h", "columns").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("i"), *fields)
    compare = lambda a, b: _compare_blocks(a, b, s)
    return left.groupBy("key", "i", "j").cogroup(right.groupBy("key", "i", "j")).applyInPandas(compare, "a binary, b binary")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", settings: SketchSettings = SketchSettings()) -> DataFrame:
    """Per document: its id, n_shingles, ``set`` (class), ``component_id`` (least id reachable),
    ``component`` (least class reachable, null without shingles) and kept."""
    s = settings
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    own = materialise(sketch(source, id_col="id", settings=s), "near-sketch")
    classes = own.where("set is not null").groupBy("set").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("least"), F.max("bytes").alias("bytes"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"), F.first("bands").alias("bands"))
    classes = materialise(classes.select("set", F.col("least.doc_id").alias("min_id"), F.col("least.fp").alias("fp"), "bytes", "n_shingles", "regs", "bands"), "near-classes")
    members = classes.select("set", F.posexplode("bands").alias("band", "key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(members.join(sizes, "key"), "near-buckets")
    # All that follows is about classes that share a bucket.
    degree = shared.groupBy("set").agg(F.sum("n").alias("degree"))
    held = materialise(classes.select("set", "min_id", "fp", "bytes", "n_shingles", "regs").join(degree, "set"), "near-held")
    texts = materialise(_texts(held.select("set", F.col("min_id").alias("id"), "fp"), source, s), "near-texts")
    centres = shared.join(held.select("set", "degree"), "set").groupBy("key").agg(F.max(F.struct("degree", "set")).alias("c")).select("key", F.col("c.set").alias("centre"))
    starred = materialise(shared.join(centres, "key"), "near-stars")
    # Centres are ordered by degree and name, so no pair comes in both directions.
    pairs = starred.where("set != centre").select(F.col("centre").alias("a"), F.col("set").alias("b")).distinct()
    links = materialise(_confirmed(materialise(_likely(pairs, held, s), "near-likely"), texts, s), "near-links")
    roots = materialise(components(links), "near-roots")

    rooted = starred.where("n > 2").join(roots.select(F.col("node").alias("set"), "root"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    of_centre = rooted.where("set = centre").select("key", F.col("root").alias("centre_root"))
    placed = materialise(rooted.where("set != centre").join(of_centre, "key").select("key", "band", "set", "root", (F.col("root") != F.col("centre_root")).alias("apart")), "near-placed")
    late = materialise(_rest(placed, held, texts, s), "near-links")
    if not late.isEmpty():
        roots = components(links.unionByName(late))
    groups = classes.select("set", "min_id").join(roots.select(F.col("node").alias("set"), "root"), "set", "left").select("set", "min_id", F.coalesce("root", "set").alias("root"))
    least = groups.groupBy("root").agg(F.min("min_id").alias("least_id"))
    named = groups.join(least, "root").select(F.col("set").alias("own_set"), F.col("root"), "least_id")
    joined = own.select("doc_id", "n_shingles", "set").join(named, F.col("set") == F.col("own_set"), "left")
    component = F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("least_id"))
    out = joined.select(F.col("doc_id").alias(id_col), "n_shingles", "set", component.alias("component_id"), F.col("root").alias("component"))
    return out.withColumn("kept", F.coalesce(out[id_col] == F.col("component_id"), F.lit(False)))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", settings: SketchSettings = SketchSettings()) -> DataFrame:
    """The documents with all their columns, one of each group: that with the least id. Documents
    without a shingle all stay."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, settings=settings)
    kept = materialise(found.where("kept or set is null or component_id is null").select(F.col(id_col).alias("kept_id"), "set", "component").distinct(), "near-kept")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    chosen = kept.where("set is not null").groupBy("component").agg(F.min(F.struct(F.col("kept_id").isNull().alias("none"), "kept_id", "set")).alias("x")).select(F.col("x.kept_id").alias("kept_id"), F.col("x.set").alias("set"))
    # Rows of a kept id; if some repeat it, the one with the chosen set stays.
    bare = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(0)) == 0
    same = rows.where(~bare).join(chosen.select("kept_id"), F.col("id").eqNullSafe(F.col("kept_id")), "left_semi")
    repeated = same.groupBy("id").count().where("count > 1").select(F.col("id").alias("many"))
    single = same.join(repeated, F.col("id").eqNullSafe(F.col("many")), "left_anti").select("row")
    several = same.join(repeated, F.col("id").eqNullSafe(F.col("many")), "left_semi")
    hashed = _with_set(several, settings).join(chosen.select(F.col("kept_id").alias("cid"), F.col("set").alias("cset")), F.col("id").eqNullSafe(F.col("cid")) & (F.col("set") == F.col("cset")))
    first = hashed.withColumn("nth", F.row_number().over(W.partitionBy("cid", "cset").orderBy("text"))).where("nth = 1").select("row")
    return rows.where(bare).select("row").unionByName(single).unionByName(first).select("row.*")


def _with_set(rows: DataFrame, s: SketchSettings) -> DataFrame:
    """Adds the digest of each text's shingle set."""
    schema = StructType([*rows.schema.fields, StructField("set", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = shingle_hashes(as_bytes(part.column("text")), s.shingle)
                digest = pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, digest], names=[*part.schema.names, "set"])

    return rows.mapInArrow(working("near", run), schema)
