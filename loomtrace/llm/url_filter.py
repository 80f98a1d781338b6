"""URL filter: rules first, then trust and distrust over the host graph (operator 8).
DataFrame expressions only.

A rule is a host and the start of a path. It fits its host and all subdomains; of the rules that
fit, the longest decides. Urls that no rule fits are judged by their host: personalised PageRank
spreads trust from hosts that rules allow along their links, and distrust from hosts that rules
block against the direction of links (who links to a bad host is suspect). Each host that rules
judge is one seed, split by its own blocked and allowed pages, however many they are. A host is
blocked if its distrust exceeds ``ratio`` times its trust and, unless rules block pages of its own,
the share a host would get by chance.

Links are the absolute links of the pages' html, summed per pair of hosts before anything is
joined. A round passes on the mass that is still moving, of which each host keeps ``1 - damping``;
rounds end when no more than ``unsettled`` of the seeds' mass moves, so scores are off by no more
than that before they are scaled, whatever the graph's size (at 0.85 and 0.01: 29 rounds at most).
Mass that dangling hosts lose is scaled back at the end, which is the same as returning it to the
seeds. Every round is written to the shared folder.

Cases: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed.
Null html has no links. Repeated rows are judged alike; empty tables give an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise
from .texts import LOWER, UPPER

#: (verdict, rule) of the registered query.
RULES: tuple[tuple[str, str], ...] = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Rules that are written into the plan; longer lists are joined.
MAX_INLINE = 500
#: Share of the seeds' mass that may still move when propagation ends.
UNSETTLED = 0.01


def host_of(url: Column) -> Column:
    """Lower-case A-Z host, or nothing."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.when(F.octet_length(host) == F.char_length(host), F.lower(host)).otherwise(F.translate(host, UPPER, LOWER))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _split(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def match_rules(urls: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` to rows with ``host`` and ``path``. Of rules of one
    length the one with the longer host decides, then the one that blocks, then the first."""
    ranked = sorted(rules, key=lambda r: (-len(r[1]), -len(_split(r[1])[0]), r[0] != "block"))
    if len(ranked) <= MAX_INLINE:
        found = F.lit(None).cast("struct<rule:string,verdict:string>")
        for verdict, rule in reversed(ranked):
            host, path = _split(rule)
            fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
            found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
        return urls.withColumn("m", found).withColumn("rule", F.col("m.rule")).withColumn("rule_verdict", F.col("m.verdict")).drop("m")
    spark = urls.sparkSession
    table = spark.createDataFrame([(i, *_split(rule), rule, verdict) for i, (verdict, rule) in enumerate(ranked)], "place long, rule_host string, rule_path string, rule string, rule_verdict string")
    # Every distinct host and path meets the rules of its host's suffixes.
    distinct = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = distinct.select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("rule_host"))
    fits = suffixes.join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = fits.groupBy("host", "path").agg(F.min(F.struct("place", "rule", "rule_verdict")).alias("m")).select("host", "path", "m.rule", "m.rule_verdict")
    return urls.join(best, ["host", "path"], "left")


def host_links(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Links between different hosts: src, dst, n."""
    href = F.explode(F.regexp_extract_all(pages[html_col], F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""), F.lit(1)))
    raw = pages.select(host_of(pages[url_col]).alias("src"), href.alias("href"))
    dst = host_of(F.when(F.col("href").startswith("//"), F.concat(F.lit("x:"), F.col("href"))).otherwise(F.col("href")))
    return raw.select("src", dst.alias("dst")).where("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, *, damping: float = 0.85, unsettled: float = UNSETTLED) -> DataFrame:
    """links: src, dst, n. seeds: host, allowed, blocked (pages; their shares of the host count).
    Returns host, trust, distrust; each sums to 1 over all hosts (or is 0 without seeds)."""
    forward = links.select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "n")
    backward = links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "n")
    edges = forward.unionByName(backward)
    total = edges.groupBy("kind", "a").agg(F.sum("n").alias("total"))
    edges = materialise(edges.join(total, ["kind", "a"]).select("kind", F.col("a").alias("host"), "b", (F.col("n") / F.col("total")).alias("w")), "host-edges")
    ruled = F.col("allowed") + F.col("blocked")
    long = seeds.where(ruled > 0).select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), (F.col("allowed") / ruled).alias("n")), F.struct(F.lit("distrust").alias("kind"), (F.col("blocked") / ruled).alias("n")))).alias("s")).select("host", "s.*").where("n > 0")
    sums = long.groupBy("kind").agg(F.sum("n").alias("total"))
    seed = F.col("n") / F.col("total")
    # r: what a host has kept; m: what it passes on in the next round.
    ranks = materialise(long.join(F.broadcast(sums), "kind").select("kind", "host", ((1 - damping) * seed).alias("r"), seed.alias("m")), "host-seeds")
    moving = 0.0 if edges.isEmpty() else 1.0
    while moving > unsettled:
        sent = ranks.where("m > 0").join(edges, ["kind", "host"]).select("kind", F.col("b").alias("host"), (damping * F.col("m") * F.col("w")).alias("m"))
        rows = ranks.select("kind", "host", "r", F.lit(0.0).alias("m")).unionByName(sent.select("kind", "host", ((1 - damping) * F.col("m")).alias("r"), "m"))
        ranks = materialise(rows.groupBy("kind", "host").agg(F.sum("r").alias("r"), F.sum("m").alias("m")), "host-ranks")
        moving = ranks.groupBy("kind").agg(F.sum("m").alias("m")).agg(F.coalesce(F.max("m"), F.lit(0.0))).first()[0]
    whole = ranks.groupBy("kind").agg(F.sum("r").alias("mass"))  # two rows
    scaled = ranks.join(F.broadcast(whole), "kind").select("host", "kind", (F.col("r") / F.col("mass")).alias("r"))
    return scaled.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("r"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")])


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = 1.0, damping: float = 0.85, unsettled: float = UNSETTLED) -> DataFrame:
    """Per page: id, host, path, rule, verdict, and the host's trust and distrust."""
    judged = match_rules(pages.select(pages[id_col].alias(id_col), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path")), rules)
    count = lambda verdict: F.sum((F.col("rule_verdict").eqNullSafe(F.lit(verdict))).cast("long"))
    hosts = judged.where("host != ''").groupBy("host").agg(count("allow").alias("allowed"), count("block").alias("blocked"))
    hosts = materialise(hosts, "hosts")
    links = materialise(host_links(pages, url_col=url_col, html_col=html_col), "host-links")
    every = hosts.select("host").unionByName(links.select(F.col("dst").alias("host"))).distinct().count()
    own = hosts.select("host", (F.col("blocked") > 0).alias("seed"))
    scores = propagate(links, hosts, damping=damping, unsettled=unsettled).join(own, "host", "left").select(F.col("host").alias("scored"), "trust", "distrust", "seed")
    joined = judged.join(scores, F.col("host") == F.col("scored"), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    bad = (distrust > ratio * trust) & (F.coalesce("seed", F.lit(False)) | (distrust > 1.0 / max(1, every)))
    verdict = F.coalesce("rule_verdict", F.when(bad, "block").otherwise("allow"))
    return joined.select(id_col, "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
