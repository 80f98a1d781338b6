"""Mixing sources to target weights by pivotal dependent rounding (operator 6).

Each source gets a target number of words, so each of its documents has the same expected number
of copies, target / size of the source. The whole part is taken as it is. What is left is a
fraction per document, and fractions are rounded in pairs: words move from one document's
expectation to the other's, by chance in either direction, until one of the two fractions is 0 or
1. The other goes on to the next pair. Expectations are kept, and what a source takes differs from
its target by less than one document. In each bucket long documents are paired first, so that the
one that stays open is a short one.

The chain of pairs is a reduction tree: documents are dealt to buckets of bounded size by a hash
of their id, each bucket leaves one fraction per source, and buckets combine by ``FAN`` until one
is left, ``SOURCES`` sources in a task. So a hot source has as many tasks as it has buckets, and no
task holds more than ``FAN * SOURCES`` of what buckets leave, however many sources there are. Levels are written to the shared
folder; all draws come from hashes, so reruns agree whatever the partitioning.

Cases: null texts and texts without a word have size 0 and take nothing. Null is a source of its
own, last in order. Repeated rows are rounded one by one (they are interchangeable). An empty
table gives an empty result. A source of size 0 has target 0.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import materialise
from .texts import WORD

#: Documents of a bucket, about.
BUCKET = 8192
#: Buckets that combine into one, for so many sources in a task.
FAN, SOURCES = 64, 128
SEED = 20240607


def source_targets(sized: DataFrame, *, source_col: str = "source", weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: size, weight, target.

    The total is ``share`` times all sizes, dealt by weight; no target exceeds ``cap`` times the
    source's size, and the excess is dealt anew. The end of that process is a water level L with
    target = min(cap * size, L * weight): sorted by cap * size / weight, the sources below the
    level come first, and one pass finds it.
    """
    source = F.col(source_col)
    sizes = sized.groupBy(source).agg(F.sum("size").alias("source_size"))
    # One row per source from here on; the windows without a key see nothing else.
    order = W.orderBy(source.asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    full = F.lit(cap) * F.col("source_size")
    by_need = W.orderBy(full / F.col("weight"), source.asc_nulls_last())
    whole = W.partitionBy()
    rows = ranked.select(source, "source_size", "weight", full.alias("full"), (F.lit(share) * F.sum("source_size").over(whole)).alias("total"), F.sum("weight").over(whole).alias("weights"), F.coalesce(F.sum(full).over(by_need.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("full_before"), F.coalesce(F.sum("weight").over(by_need.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("weight_before"))
    # The share of this source if exactly those before it are full; the first that isn't above its cap sets the level.
    rows = rows.withColumn("rest", F.col("total") - F.col("full_before")).withColumn("left", F.col("weights") - F.col("weight_before"))
    rows = rows.withColumn("open", F.col("rest") * F.col("weight") / F.col("left") <= F.col("full"))
    level = F.min(F.when(F.col("open"), F.struct((F.col("full") / F.col("weight")).alias("need"), "full_before", "rest", "left"))).over(whole)
    rows = rows.withColumn("level", level)
    target = F.when(F.col("open"), F.col("level.rest") * F.col("weight") / F.col("level.left")).otherwise(F.col("full"))
    return rows.select(source, F.col("source_size").cast("long"), "weight", target.alias("target"))


def _round_chain(docs: pd.DataFrame, random: np.random.Generator) -> tuple[np.ndarray, int, float]:
    """Pair the fractions of one source in order. Copies added (0 or 1) per row; the row that is
    still open and its fraction (-1: none)."""
    sizes, fractions = docs["size"].to_numpy(float), docs["fraction"].to_numpy(float)
    draws = random.random(len(docs))
    up = np.zeros(len(docs), np.int64)
    held, f = -1, 0.0
    for i in range(len(sizes)):
        g, s = fractions[i], sizes[i]
        if held < 0:
            held, f = i, g
            continue
        t = sizes[held]
        raised, lowered = min((1 - f) * t, g * s), min(f * t, (1 - g) * s)  # words held may gain, may lose
        if draws[i] * (raised + lowered) < lowered:
            f, g = f + raised / t, g - raised / s
        else:
            f, g = f - lowered / t, g + lowered / s
        f, g = (0.0 if f < 1e-9 else 1.0 if f > 1 - 1e-9 else f), (0.0 if g < 1e-9 else 1.0 if g > 1 - 1e-9 else g)
        if f in (0.0, 1.0):
            up[held] = int(f)
            held, f = (i, g) if 0.0 < g < 1.0 else (-1, 0.0)
            up[i] = int(g) if held < 0 else 0
        else:
            up[i] = int(g)
    return up, held, f


def _round_bucket(pdf: pd.DataFrame, last: bool, seed: int) -> pd.DataFrame:
    """All sources of a bucket; rows still open keep a fraction."""
    # Long documents first, so that the one that stays open is short.
    pdf = pdf.sort_values(["rank", "size", "draw"], ascending=[True, False, True], kind="stable", ignore_index=True)
    out = []
    for rank, docs in pdf.groupby("rank", sort=True):
        random = np.random.default_rng([seed, int(rank), int(docs["bucket"].iloc[0]) & 0x7FFFFFFF, int(docs["draw"].iloc[0]) & 0x7FFFFFFFFFFFFFFF])
        up, held, f = _round_chain(docs, random)
        docs = docs.assign(up=up, fraction=0.0)
        if held >= 0:
            if last:
                docs.iloc[held, docs.columns.get_loc("up")] = int(random.random() < f)
            else:
                docs.iloc[held, docs.columns.get_loc("fraction")] = f
        out.append(docs)
    return pd.concat(out)[list(pdf.columns) + ["up"]]


def _bucket_rounder(last: bool, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda pdf: _round_bucket(pdf, last, seed)


def round_copies(sized: DataFrame, *, seed: int = SEED, bucket: int = BUCKET) -> DataFrame:
    """sized: key string, draw long (a hash), rank (of the source), size, expected (copies).
    Returns those columns and ``copies``."""
    base = F.floor("expected").cast("long")
    whole = (F.col("size") == 0) | (F.col("expected") == base)
    columns = ["key", "draw", "rank", "size", "expected"]
    done = [sized.where(whole).select(*columns, F.when(F.col("size") == 0, F.lit(0)).otherwise(base).cast("long").alias("copies"))]
    open_ = sized.where(~whole)
    buckets = max(1, -(-open_.count() // bucket))
    rows = open_.select(*columns, (F.col("expected") - base).alias("fraction"), F.pmod(F.xxhash64("draw", F.lit(seed)), F.lit(buckets)).alias("bucket"), F.lit(0).cast("long").alias("shard"))
    schema = rows.schema
    while True:
        last = buckets == 1
        typed = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
        rounded = materialise(rows.groupBy("bucket", "shard").applyInPandas(_bucket_rounder(last, seed + buckets), f"{typed}, up long"), "mix-level")
        done.append(rounded.where("fraction = 0").select(*columns, (F.floor("expected").cast("long") + F.col("up")).alias("copies")))
        if last:
            return reduce(DataFrame.unionByName, done)
        buckets = -(-buckets // FAN)
        shard = F.floor(F.col("rank") / SOURCES).cast("long")
        rows = rounded.where("fraction > 0").select(*columns, "fraction", F.floor(F.col("bucket") / FAN).cast("long").alias("bucket"), shard.alias("shard"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = SEED) -> DataFrame:
    """Per document: id, source, size, source_size, target, copies, taken, and ``draw``, a hash
    of id, text and source that tells apart rows of one id."""
    sized = materialise(docs.select(docs[id_col].cast("string").alias("key"), docs[source_col].alias("source"), F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("size"), _draw(docs, id_col, text_col, source_col, seed).alias("draw")), "mix-sizes")
    targets = source_targets(sized, weights=weights, share=share, cap=cap)
    targets = materialise(targets.select(targets.source.alias("own"), "source_size", "target", F.row_number().over(W.orderBy(targets.source.asc_nulls_last())).alias("rank")), "mix-targets")
    joined = sized.join(targets, sized.source.eqNullSafe(targets.own)).select("key", "draw", "rank", "size", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("expected"))
    plan = round_copies(joined, seed=seed)
    return plan.join(targets, "rank").select(F.col("key").cast(docs.schema[id_col].dataType).alias(id_col), F.col("own").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "draw")


def _draw(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> Column:
    """A hash of what a row is; of nulls too, which ``xxhash64`` alone would pass over."""
    parts = [docs[id_col].cast("string"), docs[source_col].cast("string"), docs[text_col]]
    return F.xxhash64(*[F.coalesce(F.octet_length(x), F.lit(-1)) for x in parts], *parts, F.lit(seed))


def take_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **limits) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns. Rows of one id, text
    and source share their copies evenly; what is left over goes to the first of them in order of
    all columns."""
    plan = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **limits)
    shares = plan.groupBy("draw", F.col(source_col).alias("mix_source")).agg(F.sum("copies").alias("mix_copies"), F.count("*").alias("mix_rows")).where("mix_copies > 0")
    each = F.floor(F.col("mix_copies") / F.col("mix_rows")).cast("int")
    shares = shares.select("draw", "mix_source", "mix_rows", each.alias("each"), F.pmod("mix_copies", "mix_rows").cast("int").alias("extra"))
    names = docs.columns
    held = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs[source_col].alias("own_source"), F.xxhash64(*[docs[c] for c in names]).alias("place"), _draw(docs, id_col, text_col, source_col, seed).alias("draw2"))
    joined = held.join(shares, (F.col("draw2") == F.col("draw")) & F.col("own_source").eqNullSafe(F.col("mix_source")))
    some = lambda n: F.explode(F.array_repeat(F.lit(0), n))
    # A single row takes all; rows that repeat are few, and only they are put in order.
    single = joined.where("mix_rows = 1").select("row", some(F.col("each") + F.col("extra")).alias("copy")).select("row")
    whole = joined.where("mix_rows > 1 and each > 0").select("row", some(F.col("each")).alias("copy")).select("row")
    order = W.partitionBy("draw", "mix_source").orderBy("place")
    spare = joined.where("mix_rows > 1 and extra > 0").withColumn("nth", F.row_number().over(order)).where("nth <= extra").select("row")
    return single.unionByName(whole).unionByName(spare).select("row.*")
