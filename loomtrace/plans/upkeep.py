"""Queries for capture, payload contracts, artifacts and upkeep, over inputs made
from the driver's tables, with SQL."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import jobs
from ..functions import payload as P
from ..functions import scoring as S
from ..functions import text as X
from ..operators import sessions as SE
from ..operators import summaries as SU
from ..operators import supersession as SP
from ..operators.lake import Lake
from ..sources import artifacts as A
from ..sources import blobs as B
from ..sources.jsonl import parse_records, read_history, read_lines, read_session_index
from ..streaming import capture as C
from . import views as V
from .reference import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]  # one table with ``reference``: importing this module adds to it

def transcript(spark: SparkSession, sf_dir: str) -> str:
    """Every record as a line of JSONL files, and a line cut short after each first turn. Returns a
    glob of the files."""
    recs = V.json_records(V.records(spark, sf_dir))
    cut = F.when(F.col("turn") == 0, F.array("raw", F.expr("substring(raw, 1, 30)"))).otherwise(F.array("raw"))
    folder = V.scratch(spark, "transcript")
    recs.select(F.explode(cut).alias("value")).write.text(folder)
    return f"{folder}/part-*.txt"


def parsed(spark: SparkSession, sf_dir: str, threshold: int = 100_000) -> DataFrame:
    return parse_records(read_lines(spark, transcript(spark, sf_dir), split_bytes=200_000), threshold)


@query("SELECT uuid, session_id, type, timestamp, parent_uuid FROM records")
def s4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines read by byte ranges and parsed; each record once."""
    return parsed(spark, sf_dir).where("valid").select("uuid", "session_id", "type", "timestamp", "parent_uuid")


@query("SELECT count(*) AS n, count(DISTINCT conv_id) AS malformed FROM records")
def s6_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records are counted, malformed lines kept apart."""
    return parsed(spark, sf_dir).agg(F.sum(F.col("valid").cast("long")).alias("n"), F.sum((~F.col("valid")).cast("long")).alias("malformed"))


@query("SELECT uuid, 'file_' || substr(sha256(raw), 1, 16) AS file_id, CAST(length(raw) AS INTEGER) AS size, '[Large Content: file_' || substr(sha256(raw), 1, 16) || '] [Tokens: ~' || CAST(length(raw) // 4 AS VARCHAR) || ']' AS left FROM records WHERE length(raw) > 150")
def x5_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large texts move to the blob store, their markers stay."""
    rows = parsed(spark, sf_dir, 150).where("valid and size(blobs) > 0")
    return rows.select("uuid", "raw", F.explode("blobs").alias("b")).select("uuid", "b.file_id", F.length("b.content").alias("size"), F.get_json_object("raw", "$.message.content").alias("left"))


@query("SELECT DISTINCT 'file_' || substr(sha256(raw), 1, 16) AS file_id, raw AS content, true AS written FROM records WHERE length(raw) > 150")
def k5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs as files by content, read back by id through SQL; no second write replaces one."""
    rows, root = parsed(spark, sf_dir, 150).where("valid"), V.scratch(spark, "blob-files")
    blobs = rows.select(F.explode("blobs").alias("b")).select("b.*").dropDuplicates(["file_id"])
    made = V.scratch(spark, "blob-names")
    B.write_blobs(blobs, root).write.parquet(made)
    B.register_reader(spark, root)
    spark.read.parquet(made).createOrReplaceTempView("blob_names")
    return spark.sql("SELECT file_id, read_blob_file(file_id) AS content, written FROM blob_names")


@query("SELECT uuid, raw AS text FROM records WHERE session_id = 's00000001'")
def c4_rehydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's payloads with the blobs put back."""
    rows = parsed(spark, sf_dir, 50).where("valid")
    blobs = rows.select(F.explode("blobs").alias("b")).select("b.*").dropDuplicates(["file_id"])
    return SE.full_session(rows, blobs, "s00000001").select("uuid", F.get_json_object("raw", "$.message.content").alias("text"))


@query("SELECT uuid, raw AS text, [] AS missing_blobs FROM records")
def c4_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4, X6, X7, A12 over all sessions: every payload's blobs put back by joins."""
    rows = parsed(spark, sf_dir, 50).where("valid").select("uuid", "session_id", "timestamp", "raw", "blobs")
    blobs = rows.select(F.explode("blobs").alias("b")).select("b.*").dropDuplicates(["file_id"])
    return SE.rehydrate(rows.drop("blobs"), blobs).select("uuid", F.get_json_object("raw", "$.message.content").alias("text"), "missing_blobs")


@query("SELECT DISTINCT 'file_' || substr(sha256(raw), 1, 16) AS file_id FROM records WHERE session_id = 's00000001' AND length(raw) > 50")
def a12_missing_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session lacks when the blob store is empty."""
    rows = parsed(spark, sf_dir, 50).where("valid")
    none = spark.createDataFrame([], "file_id string, content string")
    return SE.missing_blobs(SE.full_session(rows, none, "s00000001"))


def block_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads with a block of each kind."""
    text = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("tool_use_id"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("struct<q:string>").alias("input"))
    use = F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("find").alias("name"), F.lit(None).cast("string").alias("tool_use_id"), F.lit(None).cast("string").alias("content"), F.struct(F.col("uuid").alias("q")).alias("input"))
    result = F.struct(F.lit("tool_result").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("name"), F.col("uuid").alias("tool_use_id"), F.col("type").alias("content"), F.lit(None).cast("struct<q:string>").alias("input"))
    blocks = F.array(text("text", F.col("raw")), use, result)
    recs = V.records(spark, sf_dir)
    return recs.select("uuid", F.to_json(F.struct(F.struct(F.col("type").alias("role"), blocks.alias("content")).alias("message"))).alias("raw"))


@query("SELECT uuid, type || ': ' || raw || chr(10) || '[tool_use: find]' || chr(10) || type AS text FROM records")
def x9_record_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X8, X9."""
    return block_records(spark, sf_dir).select("uuid", P.text_udf(P.record_text)(F.col("raw")).alias("text"))


@query("SELECT uuid, raw || chr(10) || '[Tool: find]' || chr(10) || 'Input: {\"q\": \"' || uuid || '\"}' || chr(10) || '[Tool Result ' || uuid || ']' || chr(10) || type AS text FROM records")
def x15_summary_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a summariser sees."""
    return block_records(spark, sf_dir).select("uuid", P.text_udf(P.summary_source)(F.col("raw")).alias("text"))


@query("SELECT uuid, substr(trim(regexp_replace(raw || ' ' || type, '\\s+', ' ', 'g')), 1, 240) AS snippet FROM records")
def x26_hit_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut from the message's text."""
    return block_records(spark, sf_dir).select("uuid", X.snippet(P.text_udf(P.hit_text)(F.col("raw"))).alias("snippet"))


@query("SELECT uuid, '- (session ' || substr(session_id, 1, 8) || ' 0.50' || CASE WHEN turn = 1 THEN ' [superseded]' ELSE '' END || ') ' || substr(trim(regexp_replace(raw, '\\s+', ' ', 'g')), 1, 240) AS line FROM records")
def x27_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an injected hit list."""
    recs = V.json_records(V.records(spark, sf_dir))
    snip = X.snippet(P.text_udf(P.hit_text)(F.col("raw")))
    return recs.select("uuid", X.injection_line(F.lit("primary"), F.col("session_id"), F.lit(0.5), F.col("turn") == 1, snip).alias("line"))


@query("SELECT uuid, length(raw) // 4 > 20 AND length(raw) > 3 AS fits FROM records")
def x17_accepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An output of 20 tokens is shorter than its input."""
    return V.records(spark, sf_dir).select("uuid", X.accepts(F.lit("word" * 20), F.greatest(F.lit(1), F.floor(F.length("raw") / 4))).alias("fits"))


@query("SELECT uuid, regexp_replace(substr(trim(raw), 1, greatest(1, length(raw) // 4) * 4 - 1 - length(note)), '\\s+$', '') || note AS summary FROM (SELECT uuid, raw, chr(10) || '[truncated from ' || CAST(length(raw) // 4 AS VARCHAR) || ' tokens]' AS note FROM records WHERE length(raw) >= 60)")
def x18_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest prefix that fits, and a note."""
    @F.pandas_udf("string")
    def cut(texts):
        return texts.map(lambda t: P.fallback_summary(t, P.tokens_of(t))).astype(object)

    return V.records(spark, sf_dir).where("length(raw) >= 60").select("uuid", cut("raw").alias("summary"))


@query("SELECT uuid, CAST(epoch_ms(timestamp) AS BIGINT) AS ms FROM records")
def x24_timestamp_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X24."""
    recs = V.records(spark, sf_dir)
    return recs.select("uuid", S.timestamp_ms(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).cast("long").alias("ms"))


@query("SELECT event_id, event_type = 'click' OR CASE event_id % 4 WHEN 0 THEN 'resume' WHEN 1 THEN 'clear' ELSE 'startup' END IN ('resume', 'clear', 'compact') AS good FROM events", views=False)
def x34_known_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X34."""
    event = F.when(F.col("event_type") == "click", "UserPromptSubmit").otherwise("SessionStart")
    source = F.when(F.col("event_id") % 4 == 0, "resume").when(F.col("event_id") % 4 == 1, "clear").otherwise("startup")
    return V.table(spark, sf_dir, "events").select("event_id", X.injection_is_known_good(event, source).alias("good"))


@query("SELECT c_custkey, starts_with(c_name, 'Customer#0000') AS plain, c_name LIKE '%1_%' AS wild FROM customer", views=False)
def f4_prefixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a prefix, and one that holds wildcards."""
    name = F.col("c_name")
    return V.table(spark, sf_dir, "customer").select("c_custkey", X.prefixed(name, "Customer#0000").alias("plain"), X.prefixed(name, "%1_", True).alias("wild"))


@query("SELECT session_id, list(uuid ORDER BY timestamp, uuid) AS message_uuids, CAST(min(chunk) AS BIGINT) AS at FROM numbered WHERE chunk < n // 4 GROUP BY session_id, chunk")
def c8_sprigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sprigs of all full chunks, from whole records."""
    recs = V.json_records(V.records(spark, sf_dir))
    return SU.make_sprigs(recs, V.summaries(V.records(spark, sf_dir)).where("false"), 0, size=4).select("session_id", "message_uuids", F.col("created_at").alias("at"))


def _chained(source: str, previous: str) -> str:
    """A level whose output depends on all chunks before."""
    return "S" + hashlib.sha256((source + previous).encode()).hexdigest()[:12]


_SOURCES = "sources AS (SELECT session_id, chunk, string_agg('[Message ' || uuid || '] (' || type || ')' || chr(10) || CASE WHEN raw <> '' THEN raw || chr(10) ELSE '' END, chr(10) ORDER BY timestamp, uuid) AS source, count(*) AS m FROM numbered WHERE chunk < n // 4 GROUP BY session_id, chunk)"
_CHAIN = "chain AS (SELECT session_id, chunk, 'S' || substr(sha256(source), 1, 12) AS content FROM sources WHERE chunk = 0 UNION ALL SELECT s.session_id, s.chunk, 'S' || substr(sha256(s.source || c.content), 1, 12) FROM chain c JOIN sources s ON s.session_id = c.session_id AND s.chunk = c.chunk + 1)"


@query(f"WITH RECURSIVE {V.DUCK},\n{_SOURCES}, {_CHAIN} SELECT 'sum_' || substr(sha256(content || CAST(chunk AS VARCHAR)), 1, 16) AS summary_id, session_id, content, CAST(greatest(1, length(content) // 4) AS INTEGER) AS token_count, CAST(chunk AS BIGINT) AS created_at FROM chain", views=False)
def w4_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sprig is made from its chunk and the sprig before; a level that fails comes first."""
    def broken(source: str, previous: str) -> str:
        raise RuntimeError("no model")

    recs = V.records(spark, sf_dir)
    made = SU.make_sprigs(V.json_records(recs), V.summaries(recs).where("false"), 0, (broken, _chained), size=4)
    return made.select("summary_id", "session_id", "content", "token_count", "created_at")


@query("SELECT session_id, list(summary_id ORDER BY created_at, summary_id) AS parent_ids FROM summaries GROUP BY session_id HAVING count(*) >= 2")
def c8_bindles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bindle of a session's open sprigs."""
    return SU.make_bindles(V.summaries(V.records(spark, sf_dir)), 0, at=2).select("session_id", "parent_ids")


@query("SELECT CAST(epoch_ms(timestamp) AS BIGINT) AS timestamp, raw AS display, session_id, '/p' AS project FROM records WHERE type = 'user' AND contains(lower(raw), 'e')")
def s8_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History lines that hold a text, one per key; every line stands there twice."""
    recs = V.records(spark, sf_dir).where("type = 'user'")
    row = F.to_json(F.struct(F.unix_millis(F.col("timestamp").cast("timestamp")).alias("timestamp"), F.col("raw").alias("display"), F.col("session_id").alias("sessionId"), F.lit("/p").alias("project")))
    folder = V.scratch(spark, "history")
    recs.select(F.explode(F.array(row, row)).alias("value")).write.text(folder)
    found = read_history(spark, f"{folder}/part-*.txt")
    return found.where(F.lower("display").contains("e"))


@query("SELECT session_id, 'two' AS summary, CAST(count(*) AS INTEGER) AS message_count, min(timestamp) AS created FROM records GROUP BY session_id")
def s9_session_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of two index files; of equal sessions the later folder's counts."""
    root = V.scratch(spark, "index")
    per = V.records(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("n"), F.date_format(F.min("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created")).collect()
    import json

    for name in ("one/project", "two/project"):
        os.makedirs(f"{root}/{name}")
        with open(f"{root}/{name}/sessions-index.json", "w") as out:
            json.dump({"entries": [{"sessionId": r.session_id, "summary": name[:3], "messageCount": r.n, "created": r.created} for r in per]}, out)
    found = read_session_index(spark, [f"{root}/one/project", f"{root}/two/project"])
    return found.select("session_id", "summary", "message_count", "created")


#: A session's name as a uuid.
_UUID = "lpad(CAST({} AS VARCHAR), 8, '0') || '-0000-4000-8000-000000000000'"


def _artifact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A markdown file for each conversation cites its session, three in four supersede the one before:
    ``path, source, content``."""
    own = lambda c: F.concat(F.lpad(c.cast("string"), 8, "0"), F.lit("-0000-4000-8000-000000000000"))
    n = V.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("n")).distinct()
    link = F.when(F.col("n") % 4 == 0, F.concat(F.lit("supersedes: "), own(F.col("n") - 1))).when(F.col("n") % 4 == 1, F.concat(F.lit("Supersedes [that](../decisions/"), (F.col("n") - 1).cast("string"), F.lit(".md)"))).when(F.col("n") % 4 == 2, F.concat(F.lit("superseded by "), (F.col("n") - 1).cast("string"), F.lit("."))).otherwise(F.concat(F.lit("```\nsupersedes "), own(F.col("n") - 1), F.lit("\n```")))
    text = F.concat(F.lit("# Title\nSession: "), own(F.col("n")), F.lit("\n\n"), link, F.lit("\n"))
    return n.select(F.concat(F.lit("docs/decisions/"), F.col("n").cast("string"), F.lit(".md")).alias("path"), F.lit("adr-supersedes").alias("source"), text.alias("content"))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.parse_artifacts(_artifact_files(spark, sf_dir))


_N = f"nn AS (SELECT DISTINCT conv_id AS n FROM conversations), ss AS (SELECT n, {_UUID.format('n')} AS own, {_UUID.format('n - 1')} AS prev, n - 1 IN (SELECT n FROM nn) AS known FROM nn)"
_LINKS = f"{_N}, links AS (SELECT own AS superseding_id, prev AS superseded_id, 'adr-supersedes' AS source FROM ss WHERE n % 4 = 0 AND n > 0 OR n % 4 = 1 AND known UNION ALL SELECT prev, own, 'adr-supersedes' FROM ss WHERE n % 4 = 2 AND known)"


@query(f"WITH {_N} SELECT 'docs/decisions/' || CAST(n AS VARCHAR) || '.md' AS path, own AS session, n % 4 = 3 AS quoted FROM ss", views=False)
def x31_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations and references; code is no evidence."""
    found = artifacts(spark, sf_dir)
    return found.select("path", F.element_at("session_ids", 1).alias("session"), (F.size("supersedes") + F.size("superseded_by") == 0).alias("quoted"))


@query(f"WITH {_LINKS} SELECT * FROM links", views=False)
def c13_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by session, path and stem, resolved."""
    return A.resolve_links(artifacts(spark, sf_dir).where("path != 'docs/decisions/0.md'").unionByName(artifacts(spark, sf_dir).where("path = 'docs/decisions/0.md'").withColumn("supersedes", F.array().cast("array<string>"))))


@query(f"WITH {_LINKS} SELECT superseding_id || ' -> ' || superseded_id || ' [' || source || ']' AS line FROM links", views=False)
def c15_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C15."""
    return A.describe_links(c13_links(spark, sf_dir))


def _git_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = lambda c: F.substring(F.sha2(c.cast("string"), 256), 1, 40)
    key = F.col("o_orderkey")
    message = F.when(key % 10 == 0, F.concat(F.lit('Revert "x"\n\nThis reverts commit '), sha(key - 1), F.lit("."))).otherwise("plain")
    return V.table(spark, sf_dir, "orders").select(F.concat(F.lit("\n"), sha(key), F.lit("\x1f"), message, F.lit("\n")).alias("value"))


@query("SELECT substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 40) AS superseding_id, substr(sha256(CAST(o_orderkey - 1 AS VARCHAR)), 1, 40) AS superseded_id, 'git-revert' AS source FROM orders WHERE o_orderkey % 10 = 0", views=False)
def x32_reverts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverts of a log with one commit an order."""
    return A.git_reverts(_git_log(spark, sf_dir))


def _captured(spark: SparkSession, sf_dir: str) -> Lake:
    lake = Lake(spark, V.scratch(spark, "lake"))
    C.capture(lake, read_lines(spark, transcript(spark, sf_dir)))
    return lake


@query("SELECT 'records' AS name, count(*) AS n FROM records UNION ALL SELECT 'malformed_lines', count(DISTINCT conv_id) FROM records UNION ALL SELECT 'sessions', count(DISTINCT conv_id) FROM records UNION ALL SELECT 'record_embeddings', count(*) FROM records UNION ALL SELECT 'record_fts', count(*) FROM records")
def z3_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture, then one pass of upkeep; the rows of each table."""
    from ..functions.models import HashEmbedder

    lake = _captured(spark, sf_dir)
    C.sweep(lake, HashEmbedder(8), force=True)
    names = ("records", "malformed_lines", "sessions", "record_embeddings", "record_fts")
    parts = [lake.table(n).select(F.lit(n).alias("name")) for n in names]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT session_id, substr(arg_min(CASE WHEN type = 'user' THEN raw END, CASE WHEN type = 'user' THEN timestamp END), 1, 500) AS first_prompt, CAST(count(*) AS INTEGER) AS message_count FROM records WHERE conv_id % 3 = 0 GROUP BY session_id")
def j15_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of wanted sessions, derived from their records where no index has them."""
    recs = V.json_records(V.records(spark, sf_dir))
    wanted = recs.where("conv_id % 3 = 0").select("session_id")
    empty = SE.derive_sessions(recs.where("false"))
    return SE.session_metadata(wanted, empty, recs).select("session_id", "first_prompt", "message_count")


@query("SELECT superseding_id, superseded_id, source, created_at FROM supersessions")
def k7_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links added twice stand there once."""
    lake, links = Lake(spark, V.scratch(spark, "links")), V.supersessions(V.records(spark, sf_dir))
    for _ in range(2):
        lake.insert("supersessions", links)
    return lake.table("supersessions").select("superseding_id", "superseded_id", "source", "created_at")


@query("SELECT superseding_id FROM supersessions WHERE superseded_id = (SELECT max(superseded_id) FROM supersessions)")
def f8_links_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What supersedes one item."""
    links = V.supersessions(V.records(spark, sf_dir))
    return SP.links_for(links, links.agg(F.max("superseded_id")).first()[0]).select("superseding_id")


@query("SELECT session_id, 'sprig' AS section, count(*) AS n FROM summaries WHERE session_id = (SELECT max(session_id) FROM summaries) GROUP BY ALL UNION ALL SELECT session_id, 'tail', count(*) FROM records WHERE session_id = (SELECT max(session_id) FROM summaries) AND type IN ('user', 'assistant') AND uuid NOT IN (SELECT unnest(message_uuids) FROM summaries) GROUP BY ALL")
def c5_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of a session's context."""
    recs = V.records(spark, sf_dir)
    sums = V.summaries(recs).withColumn("kind", F.lit("sprig"))
    own = sums.agg(F.max("session_id")).first()[0]
    none = spark.createDataFrame([], "file_id string, session_id string, token_count int, created_at long")
    found = SU.session_context(recs, sums, none, own)
    return found.groupBy(F.lit(own).alias("session_id"), "section").agg(F.count("*").alias("n"))


@query("SELECT uuid, session_id, row_number() OVER (PARTITION BY session_id ORDER BY timestamp, uuid) AS place FROM records")
def t6_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which a session is read."""
    rows = V.records(spark, sf_dir).select("uuid", "session_id", "timestamp")
    return SE.places(rows, "session_id", [F.asc_nulls_last("timestamp"), "uuid"], V.scratch(spark, "places")).select("uuid", "session_id", "place")


def _files(rows: DataFrame, root: str) -> None:
    """Write each row's content to its path below a folder that tasks and driver share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
                with open(f"{root}/{path}", "w", encoding="utf-8") as out:
                    out.write(content)
            yield batch.select(["path"])

    rows.select("path", "content").mapInArrow(run, "path string").count()


@query("SELECT session_id, type, count(*) AS n FROM records WHERE session_id IN (SELECT session_id FROM records WHERE contains(lower(raw), 'la')) GROUP BY ALL")
def c14_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of three projects, a file a session, captured where a file holds a text."""
    recs, root = V.json_records(V.records(spark, sf_dir)), V.scratch(spark, "batch")
    line = F.struct("turn", "raw")
    per = recs.groupBy("session_id", "conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.concat(x["raw"], F.lit("\n"))), "").alias("content"))
    path = F.concat(F.lit("projects/p"), (F.col("conv_id") % 3).cast("string"), F.lit("/"), F.col("session_id"), F.lit(".jsonl"))
    _files(per.select(path.alias("path"), "content"), root)
    lake = Lake(spark, V.scratch(spark, "lake"))
    jobs.ingest(lake, root, content_filter="LA")
    return lake.table("records").groupBy("session_id", "type").agg(F.count("*").alias("n"))


@query(f"WITH {_LINKS} SELECT * FROM links UNION SELECT substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 40), substr(sha256(CAST(o_orderkey - 1 AS VARCHAR)), 1, 40), 'git-revert' FROM orders WHERE o_orderkey % 10 = 0", views=False)
def d10_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository's artifacts and exported log, their links in a lake."""
    root, log = V.scratch(spark, "repository"), V.scratch(spark, "log")
    text = F.when(F.col("path") == "docs/decisions/0.md", F.lit("# Title\nSession: 00000000-0000-4000-8000-000000000000\n")).otherwise(F.col("content"))
    _files(_artifact_files(spark, sf_dir).withColumn("content", text), root)
    _git_log(spark, sf_dir).write.option("lineSep", "\x1e").text(log)
    lake = Lake(spark, V.scratch(spark, "lake"))
    jobs.link(lake, root, reverts=True, log=log)
    return lake.table("supersessions").select("superseding_id", "superseded_id", "source")


@query("SELECT event_id, CASE WHEN CAST(ts AS TIMESTAMP) = date_trunc('second', CAST(ts AS TIMESTAMP)) THEN strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') ELSE strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f') END AS shown FROM events", views=False)
def x33_timestamp_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as text; a fraction of a second has six digits."""
    return V.table(spark, sf_dir, "events").select("event_id", X.timestamp_text(F.col("ts").cast("timestamp_ntz")).alias("shown"))
