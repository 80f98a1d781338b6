"""Queries over stored indexes and keyed commits (D1, D6, D7, K1, K2), with the SQL of a full scan."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.models import OverlapReranker, rerank_udf
from ..functions.payload import record_text, text_udf
from ..operators import retrieval as R
from ..operators.lake import Lake
from ..operators.sessions import derive_sessions, session_metadata
from ..operators.text_index import TextIndex
from ..operators.vector_index import VectorIndex
from . import views as V
from .reference import _BM25, _DIST, _Q, K, NOW_MS, QUERIES, QUERY, SQL, embeddings, query, query_vector

__all__ = ["QUERIES", "SQL"]


def _vector_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    index = VectorIndex(spark, V.scratch(spark, "vector-index"))
    index.build(embeddings(spark, sf_dir))
    return index


@query(f"WITH {_Q} SELECT vec_id AS uuid, round({_DIST}, 6) + 0.0 AS distance FROM embeddings, q0 ORDER BY {_DIST}, vec_id LIMIT {K}", views=False)
def t1_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 by an index that is built here: the rows of a full scan."""
    hits = _vector_index(spark, sf_dir).search(query_vector(spark, sf_dir), K)
    return spark.createDataFrame(hits, "uuid long, distance double").withColumn("distance", F.round("distance", 6) + F.lit(0.0))


_PAIR = "1 - list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))))"


@query(f"SELECT query_id, id, CAST(place AS INTEGER) AS place, round(d, 6) + 0.0 AS distance FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {_PAIR} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_PAIR}, 12), e.vec_id) AS place FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0) WHERE place <= 10", views=False)
def t2_index_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 for a set of queries, every hundredth row, against all rows: cells below each query's bar."""
    asked = embeddings(spark, sf_dir).where("uuid % 100 = 0")
    hits = _vector_index(spark, sf_dir).search_all(asked, 10)
    return hits.select("query_id", "id", "place", (F.round("distance", 6) + F.lit(0.0)).alias("distance"))


def _text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """Ten batches, so ten segments and a merge of the smallest."""
    index, docs = TextIndex(spark, V.scratch(spark, "text-index")), V.table(spark, sf_dir, "documents")
    for part in range(10):
        index.add(docs.where(F.pmod("doc_id", F.lit(10)) == part), id_col="doc_id")
    return index


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT {K}", views=False)
def t3_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 over segments that grew batch by batch: the rows of one index over everything."""
    hits = _text_index(spark, sf_dir).search(QUERY, K)
    return spark.createDataFrame(hits, "doc_id long, score double").withColumn("score", F.round("score", 6))


@query("WITH t AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents), u AS (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM t) SELECT term, doc_id, len, count(*) AS tf FROM u GROUP BY ALL", views=False)
def o2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: the postings of all segments, some of them merged."""
    return _text_index(spark, sf_dir).postings().withColumnRenamed("id", "doc_id")


@query("SELECT uuid, session_id, type, timestamp, parent_uuid, raw FROM records")
def k1_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K2, K8: every record in two of fourteen batches, so later commits probe the earlier ones' filters
    and the smallest are put together; each record once. The records lie in a folder a part, so a batch reads
    its two parts alone."""
    lake, path = Lake(spark, V.scratch(spark, "lake")), V.scratch(spark, "batches")
    V.records(spark, sf_dir).withColumn("part", F.pmod(F.xxhash64("session_id"), F.lit(13))).write.partitionBy("part").parquet(path)
    recs = spark.read.parquet(path)
    for at in range(14):
        lake.insert("records", recs.where(F.col("part").isin(at, at - 1)))
    return lake.table("records")


@query("SELECT session_id, CASE WHEN conv_id % 2 = 0 THEN 'from the index' END AS summary, CASE WHEN conv_id % 2 = 0 THEN 'main' END AS git_branch, CAST(CASE WHEN conv_id % 2 = 0 THEN -1 ELSE count(*) END AS INTEGER) AS message_count FROM records GROUP BY session_id, conv_id")
def j15_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second session has an entry of the index, the others are derived."""
    recs = V.json_records(V.records(spark, sf_dir))
    entries = derive_sessions(recs.where("conv_id % 2 = 0")).withColumns({"summary": F.lit("from the index"), "git_branch": F.lit("main"), "message_count": F.lit(-1)})
    return session_metadata(recs.select("session_id"), entries, recs).select("session_id", "summary", "git_branch", "message_count")




_RANK = "row_number() OVER (ORDER BY"
_FINAL = f"1 / (1 + exp(-logit)) * pow(0.5, CASE WHEN tier = 'primary' THEN greatest(0, ({NOW_MS} - epoch_ms(timestamp)) / 1000.0) ELSE 0 END / 2592000.0) * CASE WHEN type IN ('progress', 'system') THEN 0.5 ELSE 1 END * CASE WHEN superseded THEN 0.05 ELSE 1 END * CASE WHEN tier = 'primary' THEN 1 ELSE 0.5 END"


@query(f"""WITH {V.DUCK}, {_Q}, vec AS (SELECT vec_id, {_DIST} AS d FROM embeddings, q0), nv AS (SELECT count(*) AS n FROM embeddings),
documents AS (SELECT uuid AS doc_id, type || CASE WHEN raw <> '' THEN ': ' || raw ELSE '' END AS text FROM records), {_BM25},
near AS (SELECT uuid AS id, {_RANK} d, uuid) AS rank FROM records, nv, vec WHERE vec_id = (conv_id * 7 + turn) % n QUALIFY rank <= 20),
lex AS (SELECT doc_id AS id, {_RANK} score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 20),
told AS (SELECT summary_id AS id, {_RANK} d, summary_id) AS rank FROM summaries, nv, vec WHERE vec_id = created_at % n QUALIFY rank <= 20),
arms AS (SELECT 0 AS arm, * FROM near UNION ALL SELECT 1, * FROM lex UNION ALL SELECT 2, * FROM told),
fused AS (SELECT id, sum(1.0 / (60 + rank)) AS f, min({{'arm': arm, 'rank': rank}}) AS first FROM arms GROUP BY id ORDER BY f DESC, first LIMIT 20),
found AS (SELECT id, f, 'primary' AS tier, session_id, type, timestamp, text FROM fused JOIN records ON uuid = id JOIN documents ON doc_id = id UNION ALL SELECT id, f, 'summary', session_id, NULL, NULL, content FROM fused JOIN summaries ON summary_id = id),
scored AS (SELECT *, 8.0 * len(list_intersect(string_split_regex(lower(text), '\\s+'), ['the', 'and', 'of'])) / 3 - 4 AS logit, id IN (SELECT superseded_id FROM supersessions) OR session_id IN (SELECT superseded_id FROM supersessions) AS superseded FROM found)
SELECT id, tier, session_id, round(f, 9) AS fused_score, round(logit, 9) AS rerank_score, superseded, round({_FINAL}, 15) AS final_score FROM scored ORDER BY {_FINAL} DESC, id LIMIT 10""", views=False)
def c2_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval whole, over the vectors of the embeddings table."""
    plain, given = V.records(spark, sf_dir), V.table(spark, sf_dir, "embeddings")
    recs, n = V.json_records(plain), given.count()
    sums = V.summaries(plain)
    vectors = given.select("vec_id", "embedding")
    of_records = plain.withColumn("vec_id", F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(n))).join(vectors, "vec_id").select("uuid", "embedding")
    of_summaries = sums.withColumn("vec_id", F.pmod("created_at", F.lit(n))).join(vectors, "vec_id").select("summary_id", "embedding")
    texts = recs.select("uuid", text_udf(record_text)(F.col("raw")).alias("text"))
    found = R.retrieve_candidates(recs, of_records, texts, sums, of_summaries, QUERY, query_vector(spark, sf_dir), 20)
    best = R.retrieve_relevant(found, V.supersessions(plain), rerank_udf(OverlapReranker()), QUERY, NOW_MS, 10)
    return best.select("id", "tier", "session_id", F.round("fused_score", 9).alias("fused_score"), F.round("rerank_score", 9).alias("rerank_score"), "superseded", F.round("final_score", 15).alias("final_score"))
