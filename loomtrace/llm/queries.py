"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import ball_k_means
from .chat_format import format_chats, read_chats
from .decontamination import find_contamination
from .license_scan import PERCENT, TEMPLATES, scan_licenses
from .lm_scoring import score_documents
from .mixing import mix
from .near_dedup import near_duplicates
from .quality import quality_report
from .token_output import read_token_files, write_token_files
from .url_filter import RULES, UNSETTLED, filter_urls
from .warc import page_report, write_archive
from .whitening import whiten
from .word_table import encode_decode

#: The vocabulary of the token output; its place is looked up, nothing is copied.
TOKENIZER = "word_bpe_49k.json"
#: The vocabulary of the language model, whose ids give back the bytes of a text.
LOSSLESS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_report(spark, write_archive(table(spark, sf_dir, "pages")))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score_documents(table(spark, sf_dir, "documents"), tokenizer_path(LOSSLESS), public_tokenizers.PATTERN)


#: A conversation whose texts hold control strings of a common template.
TRICKY = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    made = format_chats(turns.unionByName(spark.createDataFrame(TRICKY, "conv_id long, turn long, role string, text string")))
    read = read_chats(made)
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    items = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "license", "n_shared", "n_template")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1, word_local=True)
    return read_token_files(manifest)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_k_means(table(spark, sf_dir, "embeddings"))


def op13_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS last FROM p),
n AS (SELECT *, list_transform(range(0, 8), lambda g: CAST('0x' || substr(hex, 5 * g + 1, 5) AS BIGINT)) AS v FROM d)
SELECT page_id, strlen(html) AS payload_bytes,
array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((v[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM n
"""

_RULES = ", ".join("('{}', '{}', '/{}', '{}')".format(verdict, *rule.split("/", 1), rule) for verdict, rule in RULES)
_HOST = "translate(regexp_extract({}, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HREF = r"""<a\s[^>]*?href\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]*)"""

OP8_SQL = f"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES {_RULES}) v(verdict, rule_host, rule_path, rule)),
p AS (SELECT page_id, row_number() OVER () AS r, {_HOST.format("coalesce(url, '')")} AS host, regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, html FROM pages),
best AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY r),
judged AS (SELECT p.*, rule, verdict FROM p LEFT JOIN best USING (r)),
hosts AS (SELECT host, count(*) FILTER (WHERE verdict = 'allow') AS allowed, count(*) FILTER (WHERE verdict = 'block') AS blocked FROM judged WHERE host <> '' GROUP BY host),
hrefs AS (SELECT host AS src, unnest(regexp_extract_all(html, '{_HREF}', 1, 'i')) AS href FROM p WHERE html IS NOT NULL),
links AS (SELECT src, dst, count(*) AS n FROM (SELECT src, {_HOST.format("CASE WHEN starts_with(href, '//') THEN 'x:' || href ELSE href END")} AS dst FROM hrefs) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
ways AS (SELECT 'trust' AS kind, src AS a, dst AS b, n FROM links UNION ALL SELECT 'distrust', dst, src, n FROM links),
edges AS (SELECT kind, a, b, n / sum(n) OVER (PARTITION BY kind, a) AS w FROM ways),
seeds AS (SELECT 'trust' AS kind, host, allowed / (allowed + blocked) AS n FROM hosts WHERE allowed > 0 UNION ALL SELECT 'distrust', host, blocked / (allowed + blocked) FROM hosts WHERE blocked > 0),
moved AS (SELECT kind, host, CAST(n / sum(n) OVER (PARTITION BY kind) AS DOUBLE) AS m, 0 AS i FROM seeds UNION ALL SELECT kind, b, sum(0.85 * m * w), i + 1 FROM moved JOIN edges USING (kind) WHERE host = a AND i < 40 GROUP BY kind, b, i),
masses AS (SELECT i, max(m) AS m FROM (SELECT kind, i, sum(m) AS m FROM moved GROUP BY kind, i) GROUP BY i),
ranks AS (SELECT kind, host, sum(m) AS m FROM moved WHERE i <= coalesce((SELECT min(i) FROM masses WHERE m <= {UNSETTLED}), 40) GROUP BY kind, host),
scores AS (SELECT host, coalesce(sum(m) FILTER (WHERE kind = 'trust'), 0) AS trust, coalesce(sum(m) FILTER (WHERE kind = 'distrust'), 0) AS distrust FROM (SELECT kind, host, m / sum(m) OVER (PARTITION BY kind) AS m FROM ranks) GROUP BY host),
every AS (SELECT count(*) AS n FROM (SELECT host FROM hosts UNION SELECT dst FROM links)),
bad AS (SELECT host FROM scores LEFT JOIN hosts USING (host), every WHERE distrust > trust AND (coalesce(blocked, 0) > 0 OR distrust > 1.0 / greatest(1, every.n)))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM judged
"""

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(list_filter(regexp_split_to_array({LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> ''), []) AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array({LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1:i + least(len(w), 10)], ' ') AS win FROM (SELECT *, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i + 1:i + n], ' ') AS win FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (win, n)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""

_NOTICES = ", ".join("({})".format(", ".join("'" + x.replace("'", "''") + "'" for x in kv)) for kv in sorted(TEMPLATES.items()))

OP7_SQL = f"""
WITH t AS (SELECT license, text FROM (VALUES {_NOTICES}) v(license, text)),
src AS (SELECT 0 AS kind, license AS name, 0 AS r, text FROM t UNION ALL SELECT 1, NULL, row_number() OVER (), text FROM documents),
w AS (SELECT kind, name, r, list_filter(regexp_split_to_array({LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM src WHERE text IS NOT NULL),
s AS (SELECT DISTINCT kind, name, r, array_to_string(w[i + 1:i + 5], ' ') AS sh FROM (SELECT *, unnest(range(0, len(w) - 4)) AS i FROM w WHERE len(w) >= 5)),
n AS (SELECT name, count(*) AS n_template FROM s WHERE kind = 0 GROUP BY name),
m AS (SELECT d.r, t.name, count(*) AS n_shared FROM s d JOIN s t ON t.kind = 0 AND d.kind = 1 AND d.sh = t.sh GROUP BY 1, 2),
ids AS (SELECT row_number() OVER () AS r, doc_id FROM documents)
SELECT doc_id, name AS license, n_shared, n_template FROM m JOIN n USING (name) JOIN ids USING (r) WHERE 100 * n_shared >= {PERCENT} * n_template
"""

OP9_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 5, 0) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * p.c >= 75 * (na.c + nb.c - p.c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
g AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.c, 0) AS BIGINT) AS n_shingles, g.component_id, d.doc_id = g.component_id AS kept
FROM d JOIN g USING (doc_id) LEFT JOIN n USING (doc_id)
"""


#: Control strings as RE2 alternatives, with any number of backslashes after the first character.
CONTROL = r"<\\*(\|(turn|text|more|done|im_start|im_end|endoftext)\|>|/?s>|</?SYS>>)|\[\\*/?INST\]"

OP3_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
o AS (SELECT *, length(text) + len(regexp_extract_all(text, '{CONTROL}')) AS text_chars, length(role) + len(regexp_extract_all(role, '{CONTROL}')) AS role_chars, coalesce(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), true) AS first FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
coalesce(CAST(sum(length(text)) FILTER (WHERE role = 'assistant') AS BIGINT), 0) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
CAST(sum(text_chars + CASE WHEN first THEN 24 + role_chars ELSE 8 END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""


def _ball_sql(rounds: int = 3) -> str:
    """Each round spelled out: compare with all, then the floor of the means."""
    whole = "list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT))"
    steps = [f"kept AS (SELECT row_number() OVER () AS r, vec_id, {whole} AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64)",
             "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), v) - 1 AS j, v AS c FROM kept QUALIFY j < 16)"]
    for k in range(rounds + 1):
        steps.append(f"a{k} AS (SELECT r, vec_id, v, min({{'d': d, 'j': j}}) AS b FROM (SELECT r, vec_id, v, j, CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS d FROM kept, c{k}) GROUP BY r, vec_id, v)")
        if k < rounds:
            steps.append(f"m{k} AS (SELECT j, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (SELECT b.j AS j, i, sum(v[i]) AS s, count(*) AS n FROM a{k}, range(1, 65) t(i) GROUP BY ALL) GROUP BY j)")
            steps.append(f"c{k + 1} AS (SELECT c{k}.j, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (j))")
    return f"WITH {', '.join(steps)} SELECT vec_id, CAST(b.j AS INTEGER) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.j) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON b.j = c{rounds}.j"


OP12_SQL = _ball_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (op1_warc, op2_lm_scoring, op3_chat_format, op4_quality_rules, op5_decontamination, op6_mixing, op7_license_scan, op8_url_filter, op9_near_dedup, op10_token_output, op11_whitening, op12_centroid_clustering, op13_bpe_words)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op3_chat_format": OP3_SQL, "op5_decontamination": OP5_SQL, "op7_license_scan": OP7_SQL, "op8_url_filter": OP8_SQL, "op9_near_dedup": OP9_SQL, "op12_centroid_clustering": OP12_SQL}
