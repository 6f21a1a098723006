"""URL filters by host-suffix and path-prefix expressions (DataFrame functions only).

Each URL is expanded into host-suffix + path-prefix expressions, as deep as the deepest rule; the
expressions meet the rules in an equi-join on a short prefix of their SHA-256, after which the full
digest, the rest of the rule's path and the rule precedence are confirmed.

Defined cases: null url or one without "://" -> empty host and path, no rule; empty path fits no
rule path "/"; a rule given twice counts once; the same (host, path) both blocked and allowed ->
blocked; null parts of a rule count as empty hosts (which fit nothing) and "/" paths; extra columns
of pages are kept unless they clash with the result's own, which win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: hex digits of the digest that the equi-join uses (32 bits)
SHORT = 8
#: rules up to this many are broadcast (about 200 bytes each: at most 20 MB)
BROADCAST_RULES = 100_000
#: beyond it the rule side is replicated this often, so that a hot host's rows spread over as many tasks
SALTS = 16

RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring({u}, {at} + 3)".format(u="__url", at="instr(__url, '://')")))
    raw = F.split(rest, "[/?#]", 2)[0]
    path = F.split(F.substr(rest, F.length(raw) + 1), "[?#]", 2)[0]
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES, salts: int = SALTS) -> DataFrame:
    """pages + host, path, rule (host || path of the deciding rule or null), verdict.

    rules: (verdict, host, path). A rule fits its host and all subdomains if the url's path starts
    with its path; the longest (host and path together) wins.
    """
    spark = pages.sparkSession
    rules = rules.select(F.col("verdict"), F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("/")).alias("r_path"))
    rules = rules.where("r_host <> ''").groupBy("r_host", "r_path").agg(F.max_by("verdict", F.col("verdict") == "block").alias("r_verdict"))
    # a rule is filed under its path up to the last slash; what follows is confirmed after the join
    rules = rules.withColumn("r_dir", F.regexp_extract("r_path", "(?s)^(.*/)?", 0)).withColumn("r_expr", F.concat("r_host", "r_dir"))
    rules = rules.withColumns({"r_digest": F.sha2("r_expr", 256), "r_rank": F.length("r_host") + F.length("r_path")}).withColumn("r_short", F.substring("r_digest", 1, SHORT))
    n, labels, depth = rules.agg(F.count("*"), F.max(F.size(F.split("r_host", "\\."))), F.max(F.length("r_dir") - F.length(F.translate("r_dir", "/", "")))).first()
    labels, depth = labels or 0, depth or 0

    clash = {"host", "path", "rule", "verdict"}
    kept = [c for c in pages.columns if c.lower() not in clash]
    # the table's own columns travel as one, so no name of theirs meets one of these
    base = pages.select(F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in kept]).alias("own"), F.col(f"`{url}`").alias("__url"))
    host, path = split_url(F.col("__url"))
    base = base.withColumns({"host": host, "path": path}).drop("__url").withColumn("__row", F.monotonically_increasing_id())
    if not n:
        return base.select("own.*", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")).drop("__")

    # suffixes of the host and slash-ended prefixes of the path, no deeper than any rule's
    parts = F.split("host", "\\.")
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    slashes = F.length("path") - F.length(F.translate("path", "/", ""))
    dirs = F.concat(F.array(F.lit("")), F.when((slashes > 0) & F.lit(depth > 0), F.transform(F.sequence(F.lit(1), F.least(slashes, F.lit(max(depth, 1)))), lambda k: F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), k), F.lit("/")))).otherwise(F.array().cast("array<string>")))
    expressions = F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(dirs, lambda d: F.concat(h, d)))))
    asked = base.withColumn("expr", F.explode(expressions))
    asked = asked.withColumn("digest", F.sha2("expr", 256)).withColumn("short", F.substring("digest", 1, SHORT))
    if n <= broadcast_rules:
        dealt, meet = F.broadcast(rules), asked.short == rules.r_short
    else:
        asked = asked.withColumn("salt", F.pmod(F.xxhash64("__row"), F.lit(salts)))
        dealt = rules.withColumn("r_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
        meet = (asked.short == dealt.r_short) & (asked.salt == dealt.r_salt)
    met = asked.join(dealt, meet & (F.col("digest") == F.col("r_digest")) & F.expr("startswith(path, r_path)"), "left")
    # one row per URL again; its expressions lie side by side, so most of this is done before the shuffle
    order = F.when(F.col("r_rank").isNotNull(), F.struct("r_rank", F.col("r_verdict") == "block", "r_host", "r_path"))
    best = F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), order)
    row = F.first(F.struct("own", "host", "path"))
    out = met.groupBy("__row").agg(row.alias("row"), best.alias("won"))
    return out.select("row.own.*", "row.host", "row.path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict")).drop("__")


def given_rules(spark: SparkSession) -> DataFrame:
    return spark.sql(f"select * from values {', '.join(map(str, RULES))} as r(verdict, host, path)")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(common.read(spark, sf_dir, "pages").select("page_id", "url"), given_rules(spark)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
with u as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages
), s as (
  select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from u
), h as (
  select page_id,
    coalesce(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') as path
  from s
), r(r_host, r_path, v) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), m as (
  select h.page_id, r_host || r_path as rule, v,
    row_number() over (partition by h.page_id order by length(r_host) + length(r_path) desc) as k
  from h join r on (h.host = r_host or ends_with(h.host, '.' || r_host)) and starts_with(h.path, r_path)
)
select h.page_id, h.host, h.path, m.rule as rule, coalesce(m.v, 'allow') as verdict
from h left join m on h.page_id = m.page_id and m.k = 1
"""
