"""Search and ranking."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.payload import hit_text, record_text, text_udf
from ..functions.text import injection_line, snippet, tokens

# Parameters of BM25 as published.
K1, B = 1.2, 0.75


def vector_top_k(embeddings: DataFrame, query: Sequence[float], k: int, *, id_col: str = "uuid", vector_col: str = "embedding") -> DataFrame:
    """The k nearest by cosine distance, ties by id. Exact: one scan, and the top k of each
    task are merged; zero vectors and vectors of another length are no candidates."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    same = embeddings.where(F.size(vector_col) == len(query))
    scored = same.select(F.col(id_col), S.cosine_distance(F.col(vector_col), wanted).alias("distance")).where("distance is not null")
    return scored.orderBy("distance", id_col).limit(k)


def payload(hits: DataFrame, table: DataFrame, id_col: str = "uuid") -> DataFrame:
    """The rows of k hits. The hits are at most k, so they are the side that is sent."""
    return table.join(F.broadcast(hits), id_col)


def postings(docs: DataFrame, *, id_col: str = "uuid", text_col: str = "text", unicode: bool = False) -> DataFrame:
    """O2: term, id, tf and the document's length. Terms are counted where they are read."""
    words = docs.select(F.col(id_col), tokens(F.col(text_col), unicode).alias("w"))
    return words.select(id_col, F.size("w").alias("len"), F.explode("w").alias("term")).groupBy("term", id_col, "len").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: str, *, id_col: str = "uuid", text_col: str = "text", unicode: bool = False) -> DataFrame:
    """Id and score of all documents with a query term.

    Only the query's terms are ever counted, in the row, so nothing is exploded or shuffled but
    one partial aggregate of document frequencies and lengths."""
    spark = docs.sparkSession
    terms = sorted({r for r in spark.range(1).select(tokens(F.lit(query), unicode).alias("t")).first().t})
    words = docs.select(F.col(id_col), tokens(F.col(text_col), unicode).alias("w"))
    counted = words.select(id_col, F.size("w").alias("len"), *[F.size(F.filter("w", _equals(t))).alias(f"tf{i}") for i, t in enumerate(terms)])
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"), *[F.coalesce(F.sum((F.col(f"tf{i}") > 0).cast("long")), F.lit(0)).alias(f"df{i}") for i in range(len(terms))])
    totals = stats.first()  # one row of numbers
    matching = counted.where(reduce(lambda a, b: a | b, [F.col(f"tf{i}") > 0 for i in range(len(terms))], F.lit(False)))
    n, avgdl = F.lit(totals["n"]), F.lit(totals["avgdl"] or 1.0)
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}").cast("double"), F.lit(totals[f"df{i}"])
        idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / avgdl))).otherwise(0.0)
    return matching.select(id_col, score.alias("score"))


def document_stats(docs: DataFrame, *, id_col: str = "uuid", text_col: str = "text", unicode: bool = False) -> DataFrame:
    """One row: the number of documents and their mean length in tokens."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col(text_col), unicode))).alias("avgdl"))


def bm25_stored(index: DataFrame, stats: DataFrame, query: str, *, id_col: str = "uuid", unicode: bool = False) -> DataFrame:
    """A8 over stored postings, which are kept in order of their term: only the query's terms are
    read, and only documents that hold one are summed."""
    terms = sorted(set(index.sparkSession.range(1).select(tokens(F.lit(query), unicode).alias("t")).first().t))
    total = stats.first()
    own = index.where(F.col("term").isin(terms))
    found = own.groupBy("term").agg(F.count("*").alias("df"))  # a row per term of the query
    n, avgdl, tf = F.lit(total["n"]), F.lit(total["avgdl"] or 1.0), F.col("tf").cast("double")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / avgdl))
    return own.join(F.broadcast(found), "term").groupBy(id_col).agg(F.sum(part).alias("score"))


def _equals(term: str):
    return lambda w: w == term


def lexical_top_k(docs: DataFrame, query: str, k: int, **options) -> DataFrame:
    """T3."""
    return bm25(docs, query, **options).orderBy(F.desc("score"), options.get("id_col", "uuid")).limit(k)


def ranked(hits: DataFrame, order: list, arm: int, id_col: str = "uuid") -> DataFrame:
    """Id, arm and 1-based rank. The input is a top k already."""
    return hits.select(F.col(id_col).alias("id"), F.lit(arm).alias("arm"), F.row_number().over(W.orderBy(*order)).alias("rank"))


def fuse(rankings: DataFrame, k_const: int = S.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (id, arm, rank): id, fused_score, first (arm and rank)."""
    return rankings.groupBy("id").agg(F.sum(1 / (k_const + F.col("rank"))).alias("fused_score"), F.min(F.struct("arm", "rank")).alias("first"))


def _settled(hits: DataFrame) -> DataFrame:
    """A top k as a local table: at most k rows, computed once although several steps read them."""
    return hits.sparkSession.createDataFrame(hits.collect(), hits.schema)


def retrieve_candidates(records: DataFrame, record_embeddings: DataFrame, record_fts: DataFrame, summaries: DataFrame, summary_embeddings: DataFrame, query: str, vector: Sequence[float], k: int = 20, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Three arms, fused; the k best with tier, distances and payload. Embeddings whose row is
    gone drop out before the cut. index: stored postings and statistics, instead of ``record_fts``."""
    near = vector_top_k(record_embeddings.join(records.select("uuid"), "uuid", "left_semi"), vector, k)
    if index is None:
        scored = bm25(record_fts.join(records.select("uuid"), "uuid", "left_semi"), query)
    else:
        scored = bm25_stored(*index, query).join(records.select("uuid"), "uuid", "left_semi")
    lexical = scored.orderBy(F.desc("score"), "uuid").limit(k)
    summary = vector_top_k(summary_embeddings.join(summaries.select("summary_id"), "summary_id", "left_semi"), vector, k, id_col="summary_id")
    arms = [hits.select(F.lit(arm).alias("arm"), F.col(key).alias("id"), F.col(value).alias("value")) for arm, (hits, key, value) in enumerate(((near, "uuid", "distance"), (lexical, "uuid", "score"), (summary, "summary_id", "distance")))]
    return fuse_arms(_settled(reduce(DataFrame.unionByName, arms)), records, summaries, k)  # one job for all arms


def fuse_arms(held: DataFrame, records: DataFrame, summaries: DataFrame, k: int) -> DataFrame:
    """C1 from the hits of all arms: arm (0 near records, 1 lexical, 2 near summaries), id, value; at most k
    rows each. The k best with tier, distances and payload."""
    best_first = F.when(F.col("arm") == 1, -F.col("value")).otherwise(F.col("value"))
    fused = fuse(held.select("id", "arm", F.row_number().over(W.partitionBy("arm").orderBy(best_first, "id")).alias("rank")))
    fused = fused.withColumn("tier", F.when(F.col("first.arm") == 2, "summary").otherwise("primary"))
    top = fused.orderBy(F.desc("fused_score"), "first").limit(k)
    found = held.groupBy("id").agg(*[F.max(F.when(F.col("arm") == arm, F.col("value"))).alias(name) for arm, name in enumerate(("vector_distance", "lexical_score", "summary_distance"))])
    out = top.join(found, "id")
    rows = records.select(F.col("uuid").alias("id"), F.lit("primary").alias("tier"), "session_id", "type", "timestamp", "raw").unionByName(summaries.select(F.col("summary_id").alias("id"), F.lit("summary").alias("tier"), "session_id", F.lit(None).cast("string").alias("type"), F.lit(None).cast("timestamp_ntz").alias("timestamp"), F.col("content").alias("raw")))
    return rows.join(F.broadcast(out), ["id", "tier"])  # at most k rows


def flag_superseded(candidates: DataFrame, supersessions: DataFrame, few: bool = True) -> DataFrame:
    """Superseded by its own id or by its session's. few: the candidates are a top k, so what
    concerns them is sent; else both flags are joined by shuffles."""
    ids = supersessions.select(F.col("superseded_id").alias("gone")).distinct()
    if few:
        wanted = candidates.select(F.explode(F.array("id", "session_id")).alias("gone")).distinct()
        ids = F.broadcast(ids.join(F.broadcast(wanted), "gone", "left_semi"))  # no more than two per candidate
    joined = candidates
    for column, flag in (("id", "_own"), ("session_id", "_of_session")):
        joined = joined.join(ids.select(F.col("gone").alias(column), F.lit(True).alias(flag)), column, "left")
    return joined.withColumn("superseded", F.coalesce("_own", "_of_session", F.lit(False))).drop("_own", "_of_session")


def rank_candidates(candidates: DataFrame, now_ms: int, k: int | None = None, half_life: float = S.HALF_LIFE_SECONDS) -> DataFrame:
    """Candidates with rerank_score (a logit), type, timestamp, tier and superseded, by final
    score, ties by id. Summaries and rows without a time have age 0."""
    age = F.coalesce(F.when(F.col("tier") == "primary", (F.lit(now_ms) - F.unix_millis(F.col("timestamp").cast("timestamp"))) / 1000.0), F.lit(0.0))
    trust = F.when(F.col("tier") == "primary", S.confidence(F.coalesce("type", F.lit("")))).otherwise(1.0)
    scored = candidates.withColumn("recency", S.recency_decay(age, half_life)).withColumn("final_score", S.compose_score(S.sigmoid(F.col("rerank_score")), age, trust, F.col("superseded"), F.col("tier"), half_life))
    out = scored.orderBy(F.desc("final_score"), "id")
    return out.limit(k) if k is not None else out


def retrieve_relevant(candidates: DataFrame, supersessions: DataFrame, rerank, query: str, now_ms: int, k: int = 10) -> DataFrame:
    """Rerank the candidates, flag what is superseded, compose the score, keep the k best. A
    record is reranked by its text (X11), a summary by its content."""
    document = F.when(F.col("tier") == "summary", F.coalesce("raw", F.lit(""))).otherwise(F.coalesce(text_udf(record_text)(F.col("raw")), F.lit("")))
    logits = _settled(candidates.withColumn("rerank_score", rerank(F.lit(query), document)))
    return rank_candidates(flag_superseded(logits, supersessions), now_ms, k)


def format_injection(hits: DataFrame, header: str = "Related earlier work:") -> str | None:
    """The k hits as a short list, best first. Hits without text are left out; nothing is
    returned without any line."""
    snip = snippet(F.when(F.col("tier") == "summary", F.coalesce("raw", F.lit(""))).otherwise(F.coalesce(text_udf(hit_text)(F.col("raw")), F.lit(""))))
    shown = hits.withColumn("snip", snip).where("snip != ''")
    line = injection_line(F.col("tier"), F.col("session_id"), F.col("final_score"), F.col("superseded"), F.col("snip"))
    lines = [r.line for r in shown.orderBy(F.desc("final_score"), "id").select(line.alias("line"), "final_score", "id").collect()]
    return "\n".join([header, *lines]) if lines else None
