"""Line dedup within an edit bound of one character, by a deletion-neighbourhood join (DataFrame functions only).

A line (text between newlines) of at least `min_chars` characters is removed if a line at most one
insertion, deletion or substitution away stands earlier: in a document with a smaller doc_id, or before it
in the same document. All lines are judged on the input. Shorter lines are not judged: an edit of one character
makes another word of them. min_chars may be any number from 1.

Plan. Exact copies fold first: per 128-bit line hash, the earliest place. Every distinct line then emits
block variants: with its middle quarter (one of four) deleted, hashed. Two lines one edit apart agree on at
least one of them, as an edit touches one quarter only. Variants are counted by aggregation, so that a variant
that a third of all lines share is no single task. A quarter that is still long is cut into quarters again, with the
variants it met on as context, until `SHORT` characters are left: work and rows grow with the length of a line, not with
its square. Lines that share a variant then emit all single-character deletions of the part left, hashed with what
surrounds it:
  S  deletion with its position: equal keys are a substitution apart, every member of the group from every other;
  D  deletion without position, and O the part itself: equal D and O keys are one insertion apart.
So a group's minimum gives the earliest partner and no group is ever expanded into pairs; a group holds at most the
characters of the alphabet times the length of the part. The edit distance of the two parts is verified with
levenshtein(). Lines of up to 16 characters are one part as they are.

Lines with equal 128-bit hashes count as equal, parts with equal 64-bit hashes as equal context: of n such, two different
ones fall together with a chance of n * n / 2**65.

Defined results: null texts stay null, with 0 lines; empty texts have one line; lines of any length are judged whole;
repeated rows of one doc_id are one place each, in text order; ties are broken by place; an empty table gives no rows;
columns named n_lines or n_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casegraph.llm.common import materialise, others, passing, quoted, small, table

MIN_CHARS = 16
BLOCKS = 4
STEP = 8  # lines whose lengths share the multiple of STEP below them share block borders
WHOLE = 2 * BLOCKS  # the block number of a line that is a part as it is
SHORT = 48  # characters of a part whose single deletions are listed


def _base(length: Column, block: Column) -> Column:
    """The multiple of STEP that sets a block's borders: blocks from BLOCKS on belong to the lower class."""
    return (length - length % STEP - F.when(block >= BLOCKS, STEP).otherwise(0)).cast("int")


def _variants(line: Column, length: Column) -> Column:
    """Array of (block, key): the line without each block, hashed. A length on a multiple of STEP also counts as the lower
    class, and lines of up to 2 * STEP characters have one key in common, with the whole line as their block."""

    def of(block: int) -> Column:
        j, q = block % BLOCKS, (_base(length, F.lit(block)) / BLOCKS).cast("int")
        key = F.xxhash64(F.lit(j), q, F.substr(line, F.lit(1), q * j), F.lit("|"), F.substr(line, length - q * (BLOCKS - 1 - j) + 1))
        return F.struct(F.lit(block).alias("block"), key.alias("key"))

    upper, lower = [of(j) for j in range(BLOCKS)], [of(j) for j in range(BLOCKS, 2 * BLOCKS)]
    whole = F.struct(F.lit(WHOLE).alias("block"), F.xxhash64(F.lit("short")).alias("key"))
    some = F.when(length < 2 * STEP, F.array(whole)).when(length == 2 * STEP, F.array(*upper, *lower, whole))
    return some.when(length % STEP == 0, F.array(*upper, *lower)).otherwise(F.array(*upper))


def _part(line: Column, length: Column, block: Column) -> Column:
    """The block itself, with what its length is above the multiple of STEP."""
    q = (_base(length, block) / BLOCKS).cast("int")
    return F.when(block == WHOLE, line).otherwise(F.substr(line, q * (block % BLOCKS) + 1, length - q * (BLOCKS - 1)))


def _shared(rows: DataFrame) -> DataFrame:
    """rows (key, len, ...) of keys that can have partners, with subs (lines of one length meet there) and indels (of lengths
    that differ by one). Lengths below a key lie within STEP + 1, or are those of short lines: 32 bits tell them apart."""
    bit = F.expr("shiftleft(1L, cast(len % 32 AS int))")
    met = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_or(bit).alias("bits")).where("n > 1")
    near = F.expr("(bits & shiftleft(bits, 1)) <> 0 OR (bits & 2147483649L) = 2147483649L")
    met = met.select("key", (F.col("n") > F.bit_count("bits")).alias("subs"), near.alias("indels")).where("subs OR indels")
    return rows.join(met, "key")


def _numbered(src: DataFrame, repeats: bool) -> DataFrame:
    """src with row_no: the number of a row among those of its doc_id, in text order."""
    if not repeats:
        return src.withColumn("row_no", F.lit(1))
    return src.withColumn("row_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("text", F.xxhash64("rest"))))


def _lines(src: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, at (row and line in one number), line, len."""
    lines = src.select("doc_id", "row_no", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    at = (F.shiftleft(F.col("row_no").cast("long"), 32) + F.col("pos")).alias("at")
    return lines.select("doc_id", at, "line", F.length("line").alias("len")).where(F.col("len") >= min_chars)


_H1, _H2 = F.xxhash64, lambda line: F.xxhash64(F.lit("second"), line)


def _parts(src: DataFrame, classes: DataFrame, repeats: bool) -> DataFrame:
    """h1, h2, first, key, subs, indels, part: lines that share a variant, down to parts of at most SHORT characters."""
    variants = classes.select(F.col("first.doc_id").alias("doc_id"), F.col("first.at").alias("at"), "len", F.inline("variants"))
    asked = _shared(variants).select("doc_id", F.struct("at", "block", "key", "subs", "indels").alias("ask"))
    per_doc = materialise(asked.groupBy("doc_id").agg(F.collect_list("ask").alias("asks")))  # at most the lines of one document
    rows = _numbered(src.join(small(per_doc.select("doc_id")), "doc_id", "left_semi"), repeats)
    rows = rows.join(per_doc, "doc_id").select("doc_id", "row_no", F.split("text", "\n", -1).alias("lines"), "asks")
    rows = rows.select("doc_id", "row_no", "lines", F.inline("asks")).where(F.shiftright("at", 32) == F.col("row_no"))
    rows = rows.withColumn("line", F.element_at("lines", (F.col("at") % (1 << 32)).cast("int") + 1))
    line = F.col("line")
    now = rows.select(F.struct("doc_id", "at").alias("first"), _H1(line).alias("h1"), _H2(line).alias("h2"), "key", "subs", "indels", _part(line, F.length("line"), F.col("block")).alias("part"))
    out = None
    while True:  # ends: parts shrink by a factor of three at least
        now = materialise(now)
        done = now.where(F.length("part") <= SHORT)
        out = done if out is None else out.unionByName(done)
        long = now.where(F.length("part") > SHORT)
        if long.isEmpty():
            return out
        part, length = F.col("part"), F.length("part")
        cut = long.select("first", "h1", "h2", F.col("key").alias("outer"), "part", F.inline(_variants(part, length)))
        cut = cut.select("first", "h1", "h2", F.xxhash64("outer", "key").alias("key"), length.alias("len"), _part(part, length, F.col("block")).alias("part"))
        now = _shared(cut).drop("len")


def _earlier(parts: DataFrame) -> DataFrame:
    """h1, h2, near: the earliest line that is one edit away."""
    part, key = F.col("part"), F.col("key")
    places = F.sequence(F.lit(1), F.length(part))
    without = lambda i: F.concat(F.substr(part, F.lit(1), i - 1), F.substr(part, i + 1))
    every = lambda kind, of: F.transform(places, lambda i: F.struct(F.lit(kind).alias("kind"), of(i).alias("v")))
    whole = F.array(F.struct(F.lit("O").alias("kind"), F.xxhash64(key, F.lit("D"), part).alias("v")))
    kinds = F.concat(
        F.when(F.col("subs"), every("S", lambda i: F.xxhash64(key, F.lit("S"), i, without(i)))).otherwise(F.array()),
        F.when(F.col("indels"), F.concat(every("D", lambda i: F.xxhash64(key, F.lit("D"), without(i))), whole)).otherwise(F.array()),
    )
    keys = parts.where(F.length("part") > 0).select("h1", "h2", "first", "part", F.inline(kinds))
    here = Window.partitionBy("v")  # bounded: see above
    least = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("first", "part"))).over(here)
    met = keys.withColumn("other", F.when(F.col("kind") == "S", least("S")).when(F.col("kind") == "D", least("O")).otherwise(least("D")))
    met = met.where((F.col("other.first") < F.col("first")) & (F.levenshtein("part", "other.part", 1) >= 0))
    return met.groupBy("h1", "h2").agg(F.min("other.first").alias("near"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with text rebuilt from the lines kept (null text where it was null), plus n_lines and n_removed."""
    if min_chars < 1:
        raise ValueError("min_chars must be at least 1")
    rest = [c for c in others(docs, "n_lines", "n_removed") if c != "text"]
    # A null doc_id counts as the smallest.
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    src = docs.select(doc_id.alias("doc_id"), F.col("text"), F.struct(*quoted(rest)).alias("rest"))
    # Rows of one doc_id have to be numbered; where there are none, texts need not be dealt for it.
    repeats = not src.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    line, place = F.col("line"), F.struct("doc_id", "at")
    with passing() as kept:
        thin = _lines(_numbered(src, repeats), min_chars).select("doc_id", "at", "len", _H1(line).alias("h1"), _H2(line).alias("h2"), _variants(line, F.col("len")).alias("variants"))
        classes = materialise(thin.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first("len").alias("len"), F.first("variants").alias("variants")))
        earlier = _earlier(_parts(src, classes, repeats))
        told = classes.where("n > 1").select("h1", "h2", "first").join(earlier, ["h1", "h2"], "full").select("h1", "h2", F.least("first", "near").alias("first"))
        told = materialise(told)
        kept.append(told)
    src = _numbered(src.repartition("doc_id"), repeats)
    gone = _lines(src, min_chars).select(_H1(line).alias("h1"), _H2(line).alias("h2"), place.alias("place")).join(told, ["h1", "h2"]).where(F.col("first") < F.col("place"))
    row_no, pos = F.shiftright("place.at", 32).cast("int").alias("r"), (F.col("place.at") % (1 << 32)).cast("int").alias("p")
    per_doc = gone.groupBy(F.col("place.doc_id").alias("doc_id")).agg(F.collect_list(F.struct(row_no, pos)).alias("gone"))
    out = src.join(per_doc, "doc_id", "left")
    drops = F.transform(F.filter("gone", lambda g: g["r"] == F.col("row_no")), lambda g: g["p"])
    out = out.withColumn("drops", F.when(F.exists("gone", lambda g: g["r"] == F.col("row_no")), drops))
    split = F.split("text", "\n", -1)
    left = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("drops")))
    text = F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.element_at(split, i + 1)), "\n"))
    out = out.select("rest.*", text.alias("text"), F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).alias("n_removed"))
    return out.select(*quoted([c for c in docs.columns if c in out.columns and c not in ("n_lines", "n_removed")]), "n_lines", "n_removed")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


ORACLE = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
j AS (SELECT doc_id, pos, line, length(line) AS n FROM l WHERE length(line) >= {MIN_CHARS}),
u AS (SELECT line, n, min((doc_id, pos)) AS first FROM j GROUP BY line, n),
near AS (SELECT a.line, min(b.first) AS first FROM u a JOIN u b ON b.n BETWEEN a.n - 1 AND a.n + 1 AND b.first <= a.first AND levenshtein(a.line, b.line) <= 1 GROUP BY a.line),
gone AS (SELECT doc_id, pos FROM j JOIN near USING (line) WHERE near.first < (doc_id, pos))
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::INTEGER AS n_lines, (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id)::INTEGER AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN md5(coalesce((SELECT string_agg(l.line, chr(10) ORDER BY l.pos) FROM l WHERE l.doc_id = d.doc_id AND NOT EXISTS
    (SELECT 1 FROM gone g WHERE g.doc_id = l.doc_id AND g.pos = l.pos)), '')) END AS kept_md5
FROM documents d
"""
