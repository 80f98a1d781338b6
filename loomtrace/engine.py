"""The engine: one lake, the same methods as the service surface (query, refresh, summarize,
get_session, retrieve_relevant, context, add_supersession, backfill, sync)."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.models import HashEmbedder, OverlapReranker, rerank_udf
from .operators import retrieval, sessions, summaries, supersession, vector_index
from .operators.lake import Lake
from .streaming import capture


class Engine:
    def __init__(self, spark: SparkSession, root: str, embedder=None, reranker=None, levels: tuple = ()):
        self.spark, self.lake = spark, Lake(spark, root)
        self.embedder, self.reranker, self.levels = embedder or HashEmbedder(), reranker or OverlapReranker(), levels

    def query(self, sql: str) -> str:
        """K6: rows of a SELECT as JSON, or what went wrong."""
        try:
            self.lake.register_views()
            return json.dumps([r.asDict(recursive=True) for r in self.spark.sql(sql).collect()], default=str)
        except Exception as error:
            return json.dumps({"error": str(error)})

    def query_to(self, sql: str, path: str) -> int:
        """K6 for results of any size: rows of a SELECT as JSON lines in a new folder, written by tasks; how many."""
        self.lake.register_views()
        self.spark.sql(sql).write.json(path, ignoreNullFields=False)
        return self.spark.read.text(path).count()

    def refresh(self, path: str) -> int:
        return capture.capture_files(self.lake, path, force=True)["seen"]

    def summarize(self, created_ms: int | None = None) -> dict[str, int]:
        """C8 over all sessions: full chunks become sprigs, enough sprigs a bindle."""
        now, lake = created_ms or int(time.time() * 1000), self.lake
        sprigs = lake.insert("summaries", summaries.make_sprigs(lake.table("records"), lake.table("summaries"), now, self.levels))
        bindles = lake.insert("summaries", summaries.make_bindles(lake.table("summaries"), now + 1_000_000, self.levels))
        return {"sprigs_created": sprigs, "bindles_created": bindles, "unsummarized_remaining": summaries.unsummarized(lake.table("records"), lake.table("summaries")).count()}

    def _of(self, table: str, session_id: str) -> DataFrame:
        """A session's rows, from the files that may hold it."""
        return self.lake.rows_by(table, self.spark.createDataFrame([(session_id,)], "session_id string"))

    def get_session(self, session_id: str, include_blobs: bool = True) -> DataFrame:
        return sessions.full_session(self._of("records", session_id), self.lake.table("blobs"), session_id, include_blobs)

    def context(self, session_id: str) -> DataFrame:
        return summaries.session_context(self._of("records", session_id), self._of("summaries", session_id), self._of("blob_meta", session_id), session_id)

    def _near(self, table: str, owner: str, vector: list[float], k: int) -> list[tuple]:
        """The k nearest of a table of embeddings whose row in ``owner`` is still there: by its index, and
        by a scan of what is not in it."""
        index, key = capture.vector_index(self.lake, table), capture.VECTOR_TABLES[table]
        state = index.state()
        beyond = [c for c in self.lake.commits(table) if c not in set(state.get("covers", ()))]

        def search(n: int) -> list[tuple]:
            rest = retrieval.vector_top_k(self.lake.read(table, beyond), vector, n, id_col=key).collect() if beyond else []
            return vector_index.merged([index.search(vector, n), [(r[0], r[1]) for r in rest]], n)

        return self._alive(search, owner, key, k)

    def _alive(self, search: Callable[[int], list[tuple]], owner: str, key: str, k: int) -> list[tuple]:
        """The k best hits whose row is still there; more are asked for while some are gone."""
        n = k
        while True:
            hits = search(n)
            if not hits:
                return []
            there = {r[0] for r in self.lake.rows_of(owner, self.spark.createDataFrame([(h[0],) for h in hits], f"{key} string")).select(key).collect()}
            kept = [h for h in hits if h[0] in there]
            if len(kept) >= k or len(hits) < n:
                return kept[:k]
            n *= 2

    def candidates(self, query: str, k: int = 40) -> DataFrame:
        """C1 over the stored indexes. Records of later than the last upkeep are no lexical hits yet."""
        vector, text = self.embedder.embed([query])[0], capture.text_index(self.lake)
        lexical = self._alive(lambda n: text.search(query, n), "records", "uuid", k)
        arms = (self._near("record_embeddings", "records", vector, k), lexical, self._near("summary_embeddings", "summaries", vector, k))
        held = self.spark.createDataFrame([(arm, i, float(v)) for arm, hits in enumerate(arms) for i, v in hits], "arm int, id string, value double")
        ids = held.select(F.col("id").alias("uuid"), F.col("id").alias("summary_id"))
        return retrieval.fuse_arms(held, self.lake.rows_of("records", ids), self.lake.rows_of("summaries", ids), k)

    def retrieve_relevant(self, query: str, k: int = 10, candidate_k: int = 40, now_ms: int | None = None) -> DataFrame:
        """C2 over the stored indexes (``sync`` keeps them); without a text index over whole tables."""
        t = self.lake.table
        if capture.text_index(self.lake).state()["segments"]:
            found = self.candidates(query, candidate_k)
        else:
            found = retrieval.retrieve_candidates(t("records"), t("record_embeddings"), t("record_fts"), t("summaries"), t("summary_embeddings"), query, self.embedder.embed([query])[0], candidate_k)
        return retrieval.retrieve_relevant(found, t("supersessions"), rerank_udf(self.reranker), query, now_ms or int(time.time() * 1000), k)

    def add_supersession(self, links: list[tuple[str, str, str]], created_ms: int | None = None) -> int:
        return supersession.add_links(self.lake, links, created_ms or int(time.time() * 1000))

    def backfill(self, limit: int | None = None) -> dict[str, int]:
        return capture.backfill(self.lake, self.embedder, limit)

    def sync(self, path: str | None = None, force: bool = False) -> dict:
        if path:
            capture.capture_files(self.lake, path)
        return capture.sweep(self.lake, self.embedder, force=force)
