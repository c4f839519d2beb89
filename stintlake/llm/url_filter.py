"""URL filters: host-suffix and path-prefix expressions looked up by short hash prefixes.

Each url is expanded into the expressions a rule could have: its host and every parent domain, each with the starts of
its path that are as long as some rule's path. Expressions meet rules in an equi-join on the first bytes of their
digests; whole digests then confirm, and of the rules confirmed the longest decides.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule. A url without a rule gets
the default verdict. Of rules of one length the one with the longer host decides, then block before allow. Repeated rows
and rows with null ids are kept. Without rules, every url gets the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stintlake.llm.common import table

#: Host, path and verdict of the rules of the query.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Hexadecimal digits of the short hashes; rules (of about 200 bytes) that go to all tasks.
PREFIX_DIGITS, BROADCAST_RULES = 8, 50_000


def host_of(url: str) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, with A-Z in lower case."""
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of each row of ``page_id, url``.

    rules: host, path, verdict. Only the lengths of the rules' paths reach the driver, as one small set.
    """
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    known = rules.select(F.concat("host", "path").alias("rule"), F.length("host").alias("host_len"), "verdict")
    known = known.withColumn("digest", F.sha2(F.concat_ws("\n", F.lit("rule"), "rule"), 256)).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    if known.count() <= BROADCAST_RULES:
        known = F.broadcast(known)
    rows = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path")).withColumn("_row", F.monotonically_increasing_id())
    starts = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
    fits = F.filter(starts, lambda n: n <= F.length("path"))
    expressions = F.flatten(F.transform(host_suffixes(F.col("host")), lambda h: F.transform(fits, lambda n: F.concat(h, F.col("path").substr(F.lit(1), n)))))
    # a row without an expression keeps each url; of the others, only those that hit a rule go on
    probes = rows.select("*", F.explode(F.concat(F.array(F.lit(None).cast("string")), expressions)).alias("expression"))
    probes = probes.withColumn("full", F.when(F.col("expression").isNotNull(), F.sha2(F.concat_ws("\n", F.lit("rule"), "expression"), 256)))
    short = F.substring("full", 1, PREFIX_DIGITS)
    hits = probes.join(known, (short == known["short"]) & (F.col("full") == known["digest"]), "left").filter(F.col("expression").isNull() | F.col("rule").isNotNull())
    order = F.when(F.col("rule").isNotNull(), F.struct(F.length("rule"), "host_len", F.col("verdict") == "block", "rule", "verdict"))
    judged = hits.groupBy("_row").agg(*[F.first(c).alias(c) for c in ("page_id", "host", "path")], F.max(order).alias("best"))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the url of every page."""
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


ORACLE = r"""
WITH u AS (
  SELECT page_id, row_number() OVER () AS r,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(rhost, rpath, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT u.page_id, u.host, u.path, u.r, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY u.r ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC) AS n
  FROM u LEFT JOIN rules ON (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""
