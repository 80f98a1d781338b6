"""Queries for the transcript operators over the driver's tables, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as X
from ..operators import retrieval as R
from ..operators import sessions as SE
from ..operators import summaries as SU
from ..operators import supersession as SP
from ..operators.lake import first_per_key, new_rows
from . import views as V

#: The query of the search arms, and its vector.
QUERY = "the and of"
NOW_MS = 1_780_000_000_000
K = 40

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True) -> Callable:
    """Register a query under its function's name; sql may use the views of ``views.DUCK``."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"WITH {V.DUCK}\n{sql}" if views else sql
        return f

    return add


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """That of the least id."""
    return list(V.table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(1).first().embedding)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uuid"), "embedding", "label")


_DIST = "1 - list_dot_product(CAST(embedding AS DOUBLE[]), q) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(q, q)))"
_Q = "q0 AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings ORDER BY vec_id LIMIT 1)"


@query(f"WITH {_Q} SELECT vec_id AS uuid, label, round({_DIST}, 6) + 0.0 AS distance FROM embeddings, q0 ORDER BY {_DIST}, vec_id LIMIT {K}", views=False)
def t1_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    hits = R.vector_top_k(e, query_vector(spark, sf_dir), K)
    return R.payload(hits, e.select("uuid", "label")).withColumn("distance", F.round("distance", 6))


_BM25 = """toks AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM toks),
terms AS (SELECT unnest(['and', 'of', 'the']) AS term),
tf AS (SELECT doc_id, term, len(w) AS dl, len(list_filter(w, lambda x: x = term)) AS tf FROM toks, terms),
df AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY term),
bm AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term), st WHERE tf > 0 GROUP BY doc_id)"""


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm", views=False)
def a8_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25(V.table(spark, sf_dir, "documents"), QUERY, id_col="doc_id").withColumn("score", F.round("score", 6))


def postings_of(spark: SparkSession, sf_dir: str, name: str, docs: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Stored postings, clustered by term, and their statistics."""
    made = V.stored(spark, sf_dir, f"{name}-postings", lambda: R.postings(docs, id_col=id_col).repartitionByRange("term").sortWithinPartitions("term"))
    return made, V.stored(spark, sf_dir, f"{name}-stats", lambda: R.document_stats(docs))


def lexical_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = postings_of(spark, sf_dir, "documents", V.table(spark, sf_dir, "documents"), "doc_id")
    return R.bm25_stored(*index, QUERY, id_col="doc_id").orderBy(F.desc("score"), "doc_id").limit(K)


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT {K}", views=False)
def t3_lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_hits(spark, sf_dir).withColumn("score", F.round("score", 6))


@query("WITH t AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents), u AS (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM t) SELECT term, doc_id, len, count(*) AS tf FROM u GROUP BY ALL", views=False)
def o2_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.postings(V.table(spark, sf_dir, "documents"), id_col="doc_id")


_ARMS = f"{_Q}, {_BM25}, near AS (SELECT vec_id AS id, row_number() OVER (ORDER BY d, vec_id) AS rank FROM (SELECT vec_id, {_DIST} AS d FROM embeddings, q0) ORDER BY rank LIMIT {K}), lex AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm ORDER BY rank LIMIT {K}), arms AS (SELECT 0 AS arm, * FROM near UNION ALL SELECT 1, * FROM lex)"


@query(f"WITH {_ARMS} SELECT id, round(sum(1.0 / (60 + rank)), 9) AS fused_score FROM arms GROUP BY id", views=False)
def a7_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = R.vector_top_k(embeddings(spark, sf_dir), query_vector(spark, sf_dir), K)
    lexical = lexical_hits(spark, sf_dir)
    arms = R.ranked(near, ["distance", "uuid"], 0).unionByName(R.ranked(lexical, [F.desc("score"), "doc_id"], 1, "doc_id"))
    return R.fuse(arms).select("id", F.round("fused_score", 9).alias("fused_score"))


@query("SELECT type, count(*) AS n FROM records GROUP BY type")
def a3_count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SE.count_by_type(V.records(spark, sf_dir))


@query("SELECT session_id, CAST(count(*) AS INTEGER) AS message_count, min(timestamp) AS created, max(timestamp) AS modified FROM records GROUP BY session_id")
def a1_session_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SE.derive_sessions(V.records(spark, sf_dir)).select("session_id", "message_count", "created", "modified")


@query("SELECT session_id, substr(arg_min(raw, (timestamp, uuid)), 1, 500) AS first_prompt FROM records WHERE type = 'user' GROUP BY session_id")
def a2_first_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = V.json_records(V.records(spark, sf_dir).where("type = 'user'"))
    return SE.derive_sessions(users).select("session_id", "first_prompt")


@query("SELECT count(*) AS n, max(uuid) AS max_uuid FROM records")
def a4_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SE.extent(V.records(spark, sf_dir), "uuid")


@query("SELECT DISTINCT superseded_id FROM supersessions")
def a5_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SP.superseded_ids(V.supersessions(V.records(spark, sf_dir)))


@query("SELECT source, text, min(doc_id) AS doc_id FROM documents GROUP BY ALL", views=False)
def k1_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.table(spark, sf_dir, "documents").select("source", "text", "doc_id")
    return first_per_key(docs, ("source", "text"), ["doc_id"])


@query("SELECT min(doc_id) AS doc_id, text FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0) GROUP BY text", views=False)
def k2_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    return new_rows(docs, docs.where("doc_id % 2 = 0"), ("text",), ["doc_id"])


@query("SELECT session_id, arg_max(type, turn) AS type, max(timestamp) AS timestamp FROM records GROUP BY session_id")
def k3_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_per_key(V.records(spark, sf_dir).select("session_id", "type", "timestamp", "turn"), ("session_id",), [F.desc("turn")]).drop("turn")


@query("SELECT uuid FROM records WHERE uuid NOT IN (SELECT unnest(message_uuids) FROM summaries)")
def j1_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = V.records(spark, sf_dir)
    covered = V.summaries(recs).select(F.explode("message_uuids").alias("uuid"))
    return recs.select("uuid").join(covered, "uuid", "left_anti")


@query("SELECT uuid, session_id FROM records WHERE type IN ('user', 'assistant') AND uuid NOT IN (SELECT unnest(message_uuids) FROM summaries)")
def j3_unsummarized(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = V.records(spark, sf_dir)
    return SU.unsummarized(recs, V.summaries(recs)).select("uuid", "session_id")


@query("SELECT DISTINCT superseded_id FROM supersessions WHERE superseded_id IN (SELECT session_id FROM records)")
def j10_session_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = V.records(spark, sf_dir)
    return SP.superseded_sessions(V.supersessions(recs), recs)


@query("SELECT uuid AS id, session_id, uuid IN (SELECT superseded_id FROM supersessions) OR session_id IN (SELECT superseded_id FROM supersessions) AS superseded FROM records")
def j11_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every record is asked for here, so both sides are shuffled; retrieval flags k candidates.
    recs = V.records(spark, sf_dir)
    return R.flag_superseded(recs.select(F.col("uuid").alias("id"), "session_id"), V.supersessions(recs), few=False)


@query("SELECT superseded_id, superseding_id, row_number() OVER (PARTITION BY superseded_id ORDER BY created_at DESC, superseding_id) AS place FROM supersessions")
def t8_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SP.ranked_links(V.supersessions(V.records(spark, sf_dir))).select("superseded_id", "superseding_id", "place")


@query("SELECT uuid FROM records WHERE uuid > 'c00000010' ORDER BY uuid LIMIT 256")
def s16_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SE.page_after(V.records(spark, sf_dir).select("uuid"), "uuid", "c00000010", 256)


@query("SELECT session_id, uuid, CAST(chunk AS INTEGER) AS chunk FROM numbered WHERE chunk < n // 4")
def w1_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = V.records(spark, sf_dir).where(F.col("type").isin("user", "assistant"))
    return SU.full_chunks(recs, 4).select("session_id", "uuid", "chunk")


@query("SELECT session_id, uuid, CAST(chunk AS INTEGER) AS chunk FROM numbered WHERE chunk < n // 4")
def w1_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 with sessions numbered by several tasks each."""
    recs = V.records(spark, sf_dir).where(F.col("type").isin("user", "assistant"))
    return SU.full_chunks(recs, 4, V.scratch(spark, "places")).select("session_id", "uuid", "chunk")


@query("SELECT summary_id, session_id FROM summaries WHERE session_id IN (SELECT session_id FROM summaries GROUP BY 1 HAVING count(*) >= 2)")
def w2_condensable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SU.condensable(V.summaries(V.records(spark, sf_dir)), 2).select("summary_id", "session_id")


@query("SELECT session_id, arg_max(summary_id, created_at) AS summary_id FROM summaries GROUP BY session_id")
def w5_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SU.latest_summary(V.summaries(V.records(spark, sf_dir))).select("session_id", "summary_id")


@query("SELECT summary_id, session_id, content, CAST(token_count AS INTEGER) AS token_count, created_at FROM summaries")
def c7_sprigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.summaries(V.records(spark, sf_dir)).select("summary_id", "session_id", "content", "token_count", "created_at")


@query("SELECT s.session_id FROM summaries s WHERE CAST(substr(s.session_id, 2) AS INTEGER) % 2 = 1 ORDER BY created_at DESC, session_id LIMIT 1")
def c6_latest_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = V.records(spark, sf_dir)
    project = F.when(F.col("conv_id") % 2 == 1, "/p/one/").otherwise("/p/two/")  # all files, of two projects
    files = recs.select(F.concat(project, "session_id", F.lit(".jsonl")).alias("file_path")).distinct()
    return SU.latest_summarized_session(V.summaries(recs), files, "/p/one/")


@query("SELECT uuid, type, timestamp FROM records WHERE session_id = 's00000003'")
def c4_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SE.chronological(V.records(spark, sf_dir).where("session_id = 's00000003'").select("uuid", "type", "timestamp"))


@query("SELECT session_id, (SELECT count(*) FROM summaries s WHERE s.session_id = r.session_id) AS sprigs, count(*) FILTER (WHERE type IN ('user', 'assistant') AND uuid NOT IN (SELECT unnest(message_uuids) FROM summaries)) AS tail FROM records r GROUP BY session_id")
def c5_context_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = V.records(spark, sf_dir)
    sums = V.summaries(recs)
    sprigs = SU.uncondensed(sums).groupBy("session_id").agg(F.count("*").alias("sprigs"))
    tail = SU.unsummarized(recs, sums).groupBy("session_id").agg(F.count("*").alias("tail"))
    every = recs.select("session_id").distinct().join(sprigs, "session_id", "left").join(tail, "session_id", "left")
    return every.select("session_id", F.coalesce("sprigs", F.lit(0)).alias("sprigs"), F.coalesce("tail", F.lit(0)).alias("tail"))


_LOGIT = "((length(raw) % 17) - 8) / 4.0"
_AGE = f"({NOW_MS} - epoch_ms(timestamp)) / 1000.0"
_SCORE = f"(1 / (1 + exp(-{_LOGIT}))) * pow(0.5, greatest(0, {_AGE}) / 2592000.0) * CASE WHEN type IN ('progress', 'system') THEN 0.5 ELSE 1 END * CASE WHEN uuid IN (SELECT superseded_id FROM supersessions) OR session_id IN (SELECT superseded_id FROM supersessions) THEN 0.05 ELSE 1 END"


@query(f"SELECT uuid AS id, round({_SCORE}, 18) AS final_score FROM records ORDER BY {_SCORE} DESC, uuid LIMIT 20")
def c3_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = V.records(spark, sf_dir)
    rows = recs.select(F.col("uuid").alias("id"), "session_id", "type", "timestamp", F.lit("primary").alias("tier"), (((F.length("raw") % 17) - 8) / 4.0).alias("rerank_score"))
    return R.rank_candidates(R.flag_superseded(rows, V.supersessions(recs), few=False), NOW_MS, 20).select("id", F.round("final_score", 18).alias("final_score"))


@query()
def c2_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of retrieval: three arms, fusion, rerank, flags, composed score."""
    from ..functions.models import HashEmbedder, OverlapReranker, embed_udf, rerank_udf
    from ..functions.payload import record_text, text_udf

    plain, model = V.records(spark, sf_dir), HashEmbedder(64)
    # The tables that capture fills; a query only reads them.
    recs = V.stored(spark, sf_dir, "records", lambda: V.json_records(plain))
    links = V.stored(spark, sf_dir, "supersessions", lambda: V.supersessions(plain))
    embed, texts = embed_udf(model), recs.select("uuid", text_udf(record_text)(F.col("raw")).alias("text"))
    # What upkeep stores (C10, C11): summaries, embeddings, postings.
    sums = V.stored(spark, sf_dir, "summaries", lambda: V.summaries(plain))
    by_record = V.stored(spark, sf_dir, "record-embeddings", lambda: texts.select("uuid", embed("text").alias("embedding")))
    by_summary = V.stored(spark, sf_dir, "summary-embeddings", lambda: sums.select("summary_id", embed("content").alias("embedding")))
    index = postings_of(spark, sf_dir, "records", texts, "uuid")
    found = R.retrieve_candidates(recs, by_record, texts, sums, by_summary, QUERY, model.embed([QUERY])[0], 20, index)
    return R.retrieve_relevant(found, links, rerank_udf(OverlapReranker()), QUERY, NOW_MS, 10).select("id", "tier", "session_id", "fused_score", "rerank_score", "final_score", "superseded")


@query("SELECT event_id, CASE WHEN value >= 0 THEN 1 / (1 + exp(-value)) ELSE exp(value) / (1 + exp(value)) END AS s, pow(0.5, greatest(0, value) / 2592000.0) AS d FROM events", views=False)
def x20_sigmoid_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "events").select("event_id", S.sigmoid(F.col("value")).alias("s"), S.recency_decay(F.col("value")).alias("d"))


@query("SELECT doc_id, 'file_' || substr(sha256(text), 1, 16) AS blob_id, substr(sha256(text), 1, 2) AS shard, length(text) > 10000 AS large, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens, 'sum_' || substr(sha256(text || CAST(doc_id AS VARCHAR)), 1, 16) AS summary_id, '[Large Content: file_' || substr(sha256(text), 1, 16) || '] [Tokens: ~' || CAST(length(text) // 4 AS VARCHAR) || ']' AS marker FROM documents", views=False)
def x1_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return V.table(spark, sf_dir, "documents").select("doc_id", X.blob_id(text).alias("blob_id"), F.substring(X.blob_path(X.blob_id(text)), 1, 2).alias("shard"), X.is_large(text, 10_000).alias("large"), S.estimate_tokens(text).alias("tokens"), X.summary_id(text, F.col("doc_id")).alias("summary_id"), X.blob_marker(text).alias("marker"))


@query("SELECT doc_id, list_sort(list_distinct(regexp_extract_all(m, 'file_[0-9a-f]{16}'))) AS ids FROM (SELECT doc_id, 'x file_' || substr(sha256(text), 1, 16) || ' file_' || substr(sha256(source), 1, 16) || ' file_' || substr(sha256(text), 1, 16) AS m FROM documents)", views=False)
def x14_file_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("x "), X.blob_id(F.col("text")), F.lit(" "), X.blob_id(F.col("source")), F.lit(" "), X.blob_id(F.col("text")))
    return V.table(spark, sf_dir, "documents").select("doc_id", X.file_ids(made).alias("ids"))


@query("SELECT doc_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 240) AS snippet FROM documents", views=False)
def x26_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text")).alias("snippet"))


@query("SELECT blob_id, min(doc_id) AS owner, count(*) AS n FROM (SELECT 'file_' || substr(sha256(text), 1, 16) AS blob_id, doc_id FROM documents WHERE length(text) > 10000) GROUP BY blob_id", views=False)
def x2_large_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.table(spark, sf_dir, "documents").where(X.is_large(F.col("text"), 10_000))
    return docs.groupBy(X.blob_id(F.col("text")).alias("blob_id")).agg(F.min("doc_id").alias("owner"), F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license')", views=False)
def f3_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").where(F.lower("text").contains("license")).select("doc_id")
