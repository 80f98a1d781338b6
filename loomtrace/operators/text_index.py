"""A full-text index that grows by segments.

A segment holds the postings of the documents of one batch, in order of the term. Its documents are
numbered, 128 numbers in a row are a group, and a row of postings is a term within a group: the
documents with their term frequency and length, and with these the largest frequency and the least
length. From them follows the most that the term can add to any score of the group.

A search reads these two columns for its own terms alone, adds the bounds of each group, scores the
groups with the highest bounds, and then those whose bound reaches the k-th score found. Frequencies of
terms and lengths are summed over all segments, so the scores are those of one index.

A batch adds a segment and touches no other. With more than ``MOST_SEGMENTS`` the smallest are merged
without reading a text. Segments count once the pointer names them.

Documents are told apart by id: one that is indexed is not indexed again. Null texts have no words and
count as documents of length 0, as in ``retrieval.bm25``."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.files import Files
from .pointer import Pointer
from .retrieval import B, K1

#: Documents of a group, segments before the smallest are merged, and how many of them at once.
GROUP, MOST_SEGMENTS, MERGED = 128, 8, 4


def in_order(each: DataFrame) -> DataFrame:
    """term, grp, id, len, tf to the rows of postings, in order. Ranges keep a term's group together, so
    one shuffle both groups and orders. At most GROUP documents meet in a row."""
    dealt = each.repartitionByRange("term", "grp")
    rows = dealt.groupBy("term", "grp").agg(F.max("tf").alias("most_tf"), F.min("len").alias("least_len"), F.count("*").alias("n"), F.collect_list(F.struct("id", "len", "tf")).alias("docs"))
    return rows.sortWithinPartitions("term", "grp")


class TextIndex:
    """Below ``folder``: segments, and the pointer to those that count."""

    def __init__(self, spark: SparkSession, folder: str, unicode: bool = False):
        self.spark, self.folder, self.unicode = spark, folder, unicode
        self.pointer = Pointer(Files(spark), f"{folder}/_log", {"segments": [], "covers": []})
        #: Groups that the last search scored, of how many that hold one of its terms.
        self.groups_read, self.groups_known = 0, 0

    def state(self) -> dict:
        return self.pointer.read()[1]

    def _read(self, segments: Sequence[dict], what: str) -> DataFrame | None:
        parts = [self.spark.read.parquet(f"{self.folder}/{s['folder']}/{what}").withColumn("segment", F.lit(s["folder"])) for s in segments]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def documents(self) -> DataFrame | None:
        """id, len, number, segment of all that is indexed."""
        return self._read(self.state()["segments"], "documents")

    def _write(self, docs: DataFrame) -> dict | None:
        """A segment of (id, text); None if there is nothing in it."""
        name = f"segment-{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}"
        words = docs.select("id", tokens(F.col("text"), self.unicode).alias("w"))
        counted = words.withColumn("task", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
        counted.write.parquet(f"{path}/words")
        counted = self.spark.read.parquet(f"{path}/words")
        # Numbers without gaps but a group's at the end of each task: a task's documents begin a group.
        tasks = counted.groupBy("task").agg(F.count("*").alias("n")).collect()  # a row per written partition
        total = sum(r.n for r in tasks)
        if not total:
            Files(self.spark).remove(path)
            return None
        starts, at = [], 0
        for r in sorted(tasks):
            starts.append((r.task, at))
            at += -(-r.n // GROUP)
        first = F.broadcast(self.spark.createDataFrame(starts, "task int, first long"))
        numbered = counted.join(first, "task").select("id", "w", F.size("w").alias("len"), (F.col("first") * GROUP + F.col("place")).alias("number"))
        numbered.select("id", "len", "number").write.parquet(f"{path}/documents")
        length = self.spark.read.parquet(f"{path}/documents").agg(F.sum("len")).first()[0]
        each = numbered.select("id", "len", F.floor(F.col("number") / GROUP).alias("grp"), F.explode("w").alias("term")).groupBy("term", "grp", "id", "len").agg(F.count("*").alias("tf"))
        in_order(each).write.parquet(f"{path}/postings")
        Files(self.spark).remove(f"{path}/words")
        return {"folder": name, "documents": total, "length": int(length), "groups": at}

    def add(self, docs: DataFrame, *, id_col: str = "uuid", text_col: str = "text", covers: Sequence[str] = ()) -> int:
        """Index the documents that are not in it yet as a segment of their own; how many."""
        rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
        known = self.documents()
        if known is not None:
            rows = rows.join(known.select("id"), "id", "left_anti")
        made = self._write(rows)
        note = lambda state: sorted({*state["covers"], *covers})
        self.pointer.update(lambda state: {"segments": state["segments"] + ([made] if made else []), "covers": note(state)})
        self.merge()
        return made["documents"] if made else 0

    def rebuild(self, docs: DataFrame, *, id_col: str = "uuid", text_col: str = "text", covers: Sequence[str] = ()) -> int:
        """One segment of these documents alone instead of all that were there."""
        made = self._write(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
        self.pointer.update(lambda _: {"segments": [made] if made else [], "covers": sorted(covers)})
        return made["documents"] if made else 0

    def merge(self, most: int = MOST_SEGMENTS) -> bool:
        """Make one of the smallest segments if there are more than ``most``."""
        segments = self.state()["segments"]
        if len(segments) <= most:
            return False
        small = sorted(segments, key=lambda s: s["documents"])[:MERGED]
        name, base, moved = f"segment-{uuid.uuid4().hex}", 0, {}
        for s in small:
            moved[s["folder"]] = base
            base += s["groups"]
        shift = F.element_at(F.create_map(*[F.lit(x) for kv in moved.items() for x in kv]), F.col("segment")).cast("long")
        postings = self._read(small, "postings").withColumn("grp", F.col("grp") + shift).drop("segment")
        postings.repartitionByRange("term", "grp").sortWithinPartitions("term", "grp").write.parquet(f"{self.folder}/{name}/postings")
        self._read(small, "documents").withColumn("number", F.col("number") + shift * GROUP).drop("segment").write.parquet(f"{self.folder}/{name}/documents")
        new = {"folder": name, "documents": sum(s["documents"] for s in small), "length": sum(s["length"] for s in small), "groups": base}
        gone = {s["folder"] for s in small}

        def change(state: dict) -> dict | None:
            if not gone <= {s["folder"] for s in state["segments"]}:
                return None  # another merge or a rebuild was faster
            return state | {"segments": [s for s in state["segments"] if s["folder"] not in gone] + [new]}

        return name in {s["folder"] for s in self.pointer.update(change)["segments"]}

    def postings(self) -> DataFrame | None:
        """O2: term, id, len, tf of all segments."""
        rows = self._read(self.state()["segments"], "postings")
        return rows and rows.select("term", F.explode("docs").alias("d")).select("term", "d.id", "d.len", "d.tf")

    def search(self, query: str, k: int) -> list[tuple]:
        """The k best (id, score) by BM25, ties by id."""
        segments = self.state()["segments"]
        terms = sorted(set(self.spark.range(1).select(tokens(F.lit(query), self.unicode).alias("t")).first().t))
        self.groups_read = self.groups_known = 0
        if not segments or not terms or k < 1:
            return []
        rows = self._read(segments, "postings").where(F.col("term").isin(terms))
        total = sum(s["documents"] for s in segments)
        mean = sum(s["length"] for s in segments) / total or 1.0
        heads = rows.select("term", "segment", "grp", "n", "most_tf", "least_len").persist()
        try:
            return self._best(rows, heads, k, total, mean)
        finally:
            heads.unpersist()

    def _best(self, rows: DataFrame, heads: DataFrame, k: int, total: int, mean: float) -> list[tuple]:
        found = {r.term: r.df for r in heads.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # a row per term of the query
        if not found:
            return []
        idf = F.element_at(F.create_map(*[x for t, df in found.items() for x in (F.lit(t), F.log(F.lit(1 + (total - df + 0.5) / (df + 0.5))))]), F.col("term"))
        part = lambda tf, length: idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))
        # The slack is above what the order of the additions can change.
        bounds = heads.groupBy("segment", "grp").agg((F.sum(part(F.col("most_tf").cast("double"), F.col("least_len"))) * (1 + 1e-9)).alias("bound"))
        top = bounds.orderBy(F.desc("bound"), "segment", "grp").limit(k).collect()  # each group has a document, so these have k
        first = self._scored(rows, self.spark.createDataFrame([(r.segment, r.grp) for r in top], "segment string, grp long"), part, k)
        bar = first[-1][1] if len(first) == k else float("-inf")
        self.groups_known, self.groups_read = bounds.agg(F.count("*"), F.count_if(F.col("bound") >= bar)).first()
        if self.groups_read <= len(top):
            return first  # the others are below the bar
        return self._scored(rows, bounds.where(F.col("bound") >= bar).select("segment", "grp"), part, k)

    def _scored(self, rows: DataFrame, groups: DataFrame, part, k: int) -> list[tuple]:
        each = rows.join(groups, ["segment", "grp"], "left_semi").select("term", F.explode("docs").alias("d")).select("term", "d.*")
        scored = each.groupBy("id").agg(F.sum(part(F.col("tf").cast("double"), F.col("len"))).alias("score"))
        return [(r.id, r.score) for r in scored.orderBy(F.desc("score"), "id").limit(k).collect()]


def ranked(spark: SparkSession, hits: list[tuple], id_type: str, value: str) -> DataFrame:
    """A list of hits as a table: id and the value it was ranked by."""
    return spark.createDataFrame(hits, f"id {id_type}, {value} double")


