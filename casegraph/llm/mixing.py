"""Mixing sources to target weights (DataFrame functions only).

Words are summed per source; each source gets a target by water-filling (shares by weight, no target above
a multiple of the source's own size, the excess shared again by weight); a source's repetition rate is
target / size. A document is emitted floor(rate) times, and once more if a hash of (seed, doc_id) falls
below the fraction. Nothing but the per-source sums is shuffled: the target table, one row per source, is broadcast
up to a counted number of rows; beyond it the join is one by source, whose hot keys AQE splits.

Defined results: null text counts 0 words; texts of any length count whole; a null source is a source of its own, last in
order; an empty table gives no rows; repeated rows and equal doc_ids draw alike; sources that tie for a level fill up
together; a source without words has target 0 and rate 0; columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casegraph.llm.common import BROADCAST_ROWS, fresh, materialise, others, quoted, table

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
LIMIT = 2.0
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of non-blank characters: every run, with the blanks around it, becomes one character."""
    blank = r"\x20\x09-\x0D"
    marked = F.regexp_replace(text, rf"[{blank}]*[^{blank}]+[{blank}]*", "x")
    return F.coalesce(F.when(F.regexp_like(text, F.lit(rf"[^{blank}]")), F.length(marked)).otherwise(0), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """One row per source: source, source_size, target, rate. sizes: source, source_size.

    The level of the water-filling is found in closed form: by ascending limit / weight, the first k
    sources are full, the others get weight * level.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("top", limit * F.col("source_size"))
    up = Window.orderBy(F.col("top") / F.col("w"), F.col("source").isNull(), "source")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({"total": F.sum("source_size").over(whole) * share, "all_w": F.sum("w").over(whole)})
    s = s.withColumns({"full": F.coalesce(F.sum("top").over(before), F.lit(0.0)), "full_w": F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    s = s.withColumn("level", (F.col("total") - F.col("full")) / (F.col("all_w") - F.col("full_w")))
    # The level of the first source that does not fill up holds for all after it.
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("top"), F.struct("full_w", "level"))).over(whole)["level"])
    target = F.round(F.least(F.col("top"), F.col("w") * F.coalesce("level", F.lit(float("inf")))), 6)
    s = s.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(limit))).otherwise(0.0)
    return s.select("source", "source_size", "target", rate.alias("rate"))


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the MD5 of seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: str = "mix") -> DataFrame:
    """docs plus size, source_size, target, rate, copies (times that the mix takes the document), taken (words)."""
    made = ("size", "source_size", "target", "rate", "copies", "taken")
    sized = docs.select(*quoted(others(docs, *made)), word_count(F.col("text")).alias("size"))
    per_source = materialise(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    name = fresh(sized, "mix_source")
    t = targets(per_source, weights, share, limit).withColumnRenamed("source", name)
    t = F.broadcast(t) if per_source.count() <= BROADCAST_ROWS else t  # one row for each source
    out = sized.join(t, sized["source"].eqNullSafe(F.col(name)), "left").drop(name)
    whole = F.floor("rate")
    copies = whole + F.when(draw(F.col("doc_id"), seed) < F.col("rate") - whole, 1).otherwise(0)
    return out.withColumn("copies", copies.cast("int")).withColumn("taken", F.col("copies") * F.col("size"))


def emit(mixed: DataFrame) -> DataFrame:
    """Each document once per copy, numbered from 1; documents with 0 copies go."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0
        ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [3.0, 1.0, 2.0][(((row_number() OVER (ORDER BY source IS NULL, source)) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
fill(step, source, source_size, w, target, full_up) AS (
  SELECT 0, source, source_size, w, 0::DOUBLE, false FROM s
  UNION ALL
  SELECT step + 1, source, source_size, w, least(t, 2.0 * source_size), t >= 2.0 * source_size
  FROM (SELECT *, CASE WHEN full_up THEN target ELSE
               w * (1.5 * sum(source_size) OVER () - coalesce(sum(target) FILTER (full_up) OVER (), 0)) / sum(w) FILTER (NOT full_up) OVER () END AS t
        FROM fill WHERE step < 40)
), tg AS (SELECT source, source_size, round(target, 6) AS target FROM fill WHERE step = 40),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0) ELSE 0 END AS rate
      FROM d JOIN tg ON d.source IS NOT DISTINCT FROM tg.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN
  ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
