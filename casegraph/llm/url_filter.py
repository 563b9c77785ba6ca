"""URL allow and block lists by hashed host-suffix and path-prefix expressions (DataFrame functions only).

Every URL is expanded into expressions: each suffix of its host at a label boundary, combined with each
prefix of its path that ends in "/". Rules carry the same expression (their path up to its last "/").
Both sides join on the first 8 hex digits of the expression's SHA-256; a pair counts only where the full
digest agrees and the URL's path starts with the whole path of the rule. The longest rule wins (host and
path together; ties: the longer host, then the larger text).

Defined results: a null URL or one without "://" has an empty host and path, matches no rule and takes
the default verdict; repeated rows are judged each; an empty rule table gives the default everywhere;
columns of the input named like a result (host, path, rule, verdict) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.llm.common import others, quoted, table

#: Fixed values of the contract: host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
PREFIX = 8  # hex digits of the short hash
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), ASCII_UPPER, ASCII_LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """The rules as a DataFrame; for long lists pass a table with the columns host, path, verdict instead."""
    if not rules:
        return spark.range(0).select(*[F.lit("").alias(c) for c in ("host", "path", "verdict")])
    made = [F.struct(*[F.lit(v).alias(c) for c, v in zip(("host", "path", "verdict"), r, strict=True)]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*made)))


def _expression(host: Column, directory: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), directory), 256)


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages plus host, path, rule (null where none fits) and verdict; rules: host, path, verdict."""
    rules = rules.select(
        F.translate("host", ASCII_UPPER, ASCII_LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")
    ).where("r_host IS NOT NULL AND r_path IS NOT NULL")
    rules = rules.withColumn("r_dir", F.regexp_extract("r_path", r"(?s)^(.*/)?", 0))
    rules = rules.withColumn("digest", _expression(F.col("r_host"), F.col("r_dir"))).withColumn("short", F.substring("digest", 1, PREFIX))
    # Two numbers bound the expansion: no rule has more labels or directories than these.
    labels, depth = rules.agg(
        F.max(F.size(F.split("r_host", r"\."))), F.max(F.length(F.regexp_replace("r_dir", "[^/]", "")))
    ).first()
    labels, depth = labels or 0, depth or 0

    rows = pages.withColumns({"host": host_of(F.col(f"`{url_col}`")), "path": path_of(F.col(f"`{url_col}`"))})
    keep = others(pages, "host", "path", "rule", "verdict")
    rows = rows.select(F.struct(*quoted(keep), F.col("host"), F.col("path")).alias("row"), F.monotonically_increasing_id().alias("rid"))
    parts = F.split("row.host", r"\.")
    hosts = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."),
    )
    dirs = F.split("row.path", "/")
    n_dirs = F.least(F.size(dirs) - 1, F.lit(depth))
    prefixes = F.transform(
        F.sequence(F.lit(0), n_dirs), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(dirs, 1, n), "/"), F.lit("/")))
    )
    asked = rows.withColumn("h", F.explode_outer(hosts if labels else F.array(F.lit("")))).withColumn("d", F.explode_outer(prefixes))
    asked = asked.withColumn("asked", _expression(F.col("h"), F.col("d"))).drop("h", "d")
    asked = asked.withColumn("short", F.substring("asked", 1, PREFIX))
    hit = asked.join(rules, "short", "left")
    fits = (F.col("asked") == F.col("digest")) & F.startswith(F.col("row.path"), F.col("r_path")) & (F.col("row.host") != "")
    ranked = F.when(
        fits,
        F.struct(
            (F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"),
            F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"),
        ),
    )
    best = hit.groupBy("rid").agg(F.first("row").alias("row"), F.max(ranked).alias("best"))
    return best.select("row.*", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rule_table(spark, RULES)).drop("url")


ORACLE = r"""
WITH u AS (SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                         ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT page_id, host, path, (SELECT max_by(struct_pack(rule := rh || rp, v := rv), length(rh || rp)) FROM r
             WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS best FROM p)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict FROM m
"""
