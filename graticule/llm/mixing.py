"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed 60-bit hash.  A source that is to give ``budget`` words gives the documents whose hash is at or
below a threshold.  The threshold is found digit by digit: words are summed by source and by the hash's leading 12 bits,
the running sum over at most 4096 buckets names the bucket in which the budget ends, and only that bucket's documents are
summed by their next 12 bits, and so on.  After five digits the bucket is one hash; it is taken if that brings the sum
nearer to the budget.  No document is ever sorted, and the thresholds nest: a larger budget keeps all that a smaller one
took.  After each digit the state, one row a source, is written out, so the plans of the digits don't pile up.

Targets: sources in code-point order (null last) weigh 3, 1, 2, 3, ...; together they get ``share`` of all words, none more
than twice its own.  A capped source's excess is shared again by weight, so every other source gets ``level * weight`` for
one common level.  A source whose target exceeds its words gives each document once and those under the threshold twice.

Null and empty texts have size 0 and hash like any other.  Documents equal in doc_id and size share a hash and are taken or
left together.  A table without words has targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop, table

WEIGHTS, SHARE, MOST_TIMES = (3, 1, 2), 1.5, 2
DIGITS, DIGIT_BITS = 5, 12


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"), F.lit(0).cast("long"))


def sized(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, source)`` -> doc_id, source, size, hash."""
    named = docs.select("doc_id", "source", word_count("text").alias("size"))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.col("size").cast("string"))
    return named.withColumn("hash", F.conv(F.substring(F.md5(key), 1, DIGITS * DIGIT_BITS // 4), 16, 10).cast("long"))


def targets(sizes: DataFrame) -> DataFrame:
    """``sizes(source, ...)`` -> one row a source: source, source_size, target."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    rated = per.withColumn("w", weight.cast("double")).withColumn("cap", (F.col("source_size") * MOST_TIMES).cast("double"))
    # in order of cap / weight the capped sources come first; the level is set by the first source that it doesn't cap
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.lit(SHARE) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    leveled = rated.withColumn("level", left / weights)
    free = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("level")))).over(every)["level"]
    return leveled.withColumn("free", free).select("source", "source_size", F.least("cap", F.coalesce(F.col("free") * F.col("w"), F.col("cap"))).alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source the largest hash taken (-1: none) so that the sum of sizes at or below comes nearest to its budget."""
    found = goals.withColumn("left", F.col("budget")).withColumn("head", F.lit(0).cast("long"))
    for digit in range(DIGITS):
        shift = DIGIT_BITS * (DIGITS - 1 - digit)
        rows = _boundary(sizes, found, shift + DIGIT_BITS) if digit else sizes
        sums = rows.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("n").over(run)).withColumnRenamed("source", "src")
        joined = sums.join(found, F.col("src").eqNullSafe(F.col("source")))
        # the first bucket that reaches what is left; if none does (rounding), the last
        reach = F.struct(F.when(F.col("upto") >= F.col("left"), 0).otherwise(1).alias("late"), F.when(F.col("upto") >= F.col("left"), F.col("bucket")).otherwise(-F.col("bucket")).alias("o"), "bucket", "upto", "n")
        best = joined.groupBy("src").agg(F.min(reach).alias("b"), F.first("left").alias("left"), F.first("budget").alias("budget"))
        before = F.col("left") - (F.col("b.upto") - F.col("b.n"))
        then, found = found, cut(best.select(F.col("src").alias("source"), "budget", before.alias("left"), F.col("b.bucket").alias("head"), F.col("b.n").alias("last")), "mix-digit")
        if digit:
            drop(then)
    # `left` is what the one boundary hash may still give and `last` what it has
    take = F.abs(F.col("left") - F.col("last")) < F.abs(F.col("left"))
    return found.select("source", F.when((F.col("budget") > 0) & take, F.col("head")).otherwise(F.col("head") - 1).alias("threshold"))


def _boundary(sizes: DataFrame, found: DataFrame, shift: int) -> DataFrame:
    edge = found.select(F.col("source").alias("s"), F.col("head").alias("edge"))
    return sizes.withColumn("at", F.shiftright("hash", shift)).join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("at") == F.col("edge")), "left_semi")


def mix(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, source)`` -> doc_id, source, size, source_size, target, taken."""
    sizes = cut(sized(docs), "mix-sizes")
    plan = cut(targets(sizes), "mix-targets")
    # words beyond a whole pass over the source
    goals = plan.withColumn("budget", F.when(F.col("target") > F.col("source_size"), F.col("target") - F.col("source_size")).otherwise(F.col("target"))).select("source", "budget")
    marks = cut(thresholds(sizes, goals), "mix-thresholds").withColumnRenamed("source", "s2")
    full = plan.withColumnRenamed("source", "s1").join(marks, F.col("s1").eqNullSafe(F.col("s2")))
    base = F.when(F.col("target") > F.col("source_size"), F.col("size")).otherwise(F.lit(0).cast("long"))
    taken = base + F.when(F.col("hash") <= F.col("threshold"), F.col("size")).otherwise(F.lit(0).cast("long"))
    return sizes.join(full, F.col("source").eqNullSafe(F.col("s1"))).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "hash", "threshold")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
hashed AS (
  SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || CAST(size AS VARCHAR)), 1, 15) AS BIGINT) AS hash FROM sized),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM hashed GROUP BY source),
rated AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w,
         CAST(source_size * 2 AS DOUBLE) AS cap FROM per),
leveled AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev
  FROM rated),
freed AS (SELECT arg_min(lev, cap / w) AS free FROM leveled WHERE lev * w <= cap),
goal AS (
  SELECT source, source_size, least(cap, coalesce((SELECT free FROM freed) * w, cap)) AS target FROM leveled),
budgets AS (SELECT *, CASE WHEN target > source_size THEN target - source_size ELSE target END AS budget FROM goal),
sums AS (
  SELECT h.source, hash, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY h.source ORDER BY hash) AS upto FROM hashed h GROUP BY h.source, hash),
taken AS (
  SELECT s.source, s.hash, s.upto <= b.budget OR (s.upto - s.n < b.budget AND s.upto - b.budget < b.budget - (s.upto - s.n)) AS pick, b.budget
  FROM sums s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT h.doc_id, h.size, b.source_size, b.target,
       CAST(CASE WHEN b.target > b.source_size THEN h.size ELSE 0 END + CASE WHEN t.pick AND t.budget > 0 THEN h.size ELSE 0 END AS BIGINT) AS taken
FROM hashed h JOIN budgets b ON h.source IS NOT DISTINCT FROM b.source
JOIN taken t ON t.source IS NOT DISTINCT FROM h.source AND t.hash = h.hash
"""
