"""What the training-data operators share: tables, scratch folders, components, word rules.

Scratch tables go to the folder that the cluster names in ``spark.checkpoint.dir``; only where that setting is missing on
a local master (tests, a laptop) a local folder is used, which goes when the process ends.  A table written there cuts the
lineage: executors that are lost afterwards cost a re-read and no recomputation.  An operator's result may still read its
tables, so they stay until the caller, done with the results, calls ``release``.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[^\x20\x09-\x0D]+`` over UTF-8 bytes: every byte of a multi-byte character is outside the excluded set.
SPACED_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: ASCII punctuation and white space separate, everything else (letters, digits, any non-ASCII) belongs to a word.
PLAIN_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="graticule-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Scratch paths that nothing has deleted yet.
_LEFT: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/graticule/{label}-{uuid.uuid4().hex}"
    _LEFT.append(path)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and return it read back, with a lineage of one scan."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.scratch = path
    return found


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop(df: DataFrame) -> None:
    """Delete the scratch table behind a frame that ``cut`` returned."""
    _delete(df.sparkSession, df.scratch)
    _LEFT.remove(df.scratch)


def release(spark: SparkSession) -> None:
    """Delete every scratch table of this process; results that were not yet read can't be read afterwards."""
    while _LEFT:
        _delete(spark, _LEFT.pop())


#: Bytes of an Arrow batch, about.
BATCH_BYTES = 16 << 20


def arrow_rows(spark: SparkSession, rows: int) -> None:
    """Bounds the rows and bytes of Arrow batches, so that a batch of very long texts fits a Python worker.

    Plans read the settings when they run, which is after an operator has returned, so these stay; a caller's lower bounds do.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").lower()
        if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``edges(u, v)`` -> ``(node, root)``, root being the smallest node of each component; only nodes with an edge.

    Alternating large-star and small-star rounds: a round is two aggregations and two joins on a node, and the number of
    rounds grows with the logarithm of the longest shortest path.  A hub's rows meet only in a partial minimum and in a
    join that adaptive execution may split.  Null ends and self links are ignored.
    """
    now = cut(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        label,
    )
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        then, now = now, cut(small, label)
        drop(then)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = seen


#: A key with more than one in this many of a table's rows is common (there are fewer than that many); tasks that it is dealt to.
COMMON, WAYS = 1000, 64


def join_groups(big: DataFrame, small: DataFrame, key: str, n: str, how: str = "inner") -> DataFrame:
    """Join on ``key``, of which ``small`` has one row each with ``n``, its rows in ``big``: common keys are dealt to many tasks.

    The common keys, fewer than ``COMMON``, are broadcast; their rows in ``big`` get a salt by the hash of their other
    columns, and their rows in ``small`` are repeated for each salt.  ``small`` should be a written table.
    """
    total = small.agg(F.sum(n).cast("long")).first()[0] or 0
    common = F.coalesce(F.col(n) * COMMON > total, F.lit(False))
    heavy = small.where(common).select(key, F.lit(True).alias("__common"))
    if heavy.isEmpty():
        return big.join(small.drop(n), key, how)
    others = [c for c in big.columns if c != key]
    salt = F.when(F.col("__common"), F.pmod(F.xxhash64(*others), F.lit(WAYS)).cast("int")).otherwise(0)
    left = big.join(F.broadcast(heavy), key, "left").withColumn("__salt", salt).drop("__common")
    salts = F.when(common, F.sequence(F.lit(0), F.lit(WAYS - 1))).otherwise(F.array(F.lit(0)))
    right = small.withColumn("__salt", F.explode(salts)).drop(n)
    return left.join(right, [key, "__salt"], how).drop("__salt")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
