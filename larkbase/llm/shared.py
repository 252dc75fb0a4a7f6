"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as every contract here defines them: runs of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_count(text: Column) -> Column:
    """Number of words of a text, as long; null counts as no words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII texts, for which ``lower`` does the same, take that faster way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session may lack the setting; it then gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        configured = sc.getCheckpointDir()
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="larkbase-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/larkbase/{label}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Cuts lineage: the rows as a Parquet table in the shared folder, which outlives lost executors.

    What was shuffled on the way is deleted once the table stands.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes a written table that nothing reads any more."""
    spark = table.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def key_filter(keys: DataFrame, key: str, bits: int = 1 << 25) -> DataFrame:
    """A one-hash Bloom filter over a long column, as rows (__slot, __bitmap) of 4 KB each.

    It never holds more than ``bits`` bits (4 MB by default) however many keys go in, so it may always
    be broadcast; with more keys it only lets more rows through.
    """
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(bits)) + 1
    return keys.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("__slot")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("__bitmap")
    )


def passing(rows: DataFrame, key: str, found: DataFrame, bits: int = 1 << 25, absent: bool = False) -> DataFrame:
    """Rows whose key may be in the filter ``found`` (``absent``: those whose key surely is not)."""
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(bits)) + 1
    position = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("__bitmap"), (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_in = F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))
    keep = ~is_in if absent else is_in
    joined = rows.withColumn("__slot", F.bitmap_bucket_number(place)).join(F.broadcast(found), "__slot", "left")
    return joined.where(keep).select(*[F.col(f"`{c}`") for c in rows.columns])


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node, from rows (a, b) of long: returns (node, component).

    Alternating large-star and small-star rounds: each round hangs the neighbours of a node on the
    smallest of them, so that a component of any shape becomes a star in a logarithmic number of rounds.
    All of it is grouped minima and equi-joins; every round is cut by a checkpoint in the shared folder.
    Edges from a node to itself and nulls are left out; no edges give no rows.
    """
    shared_dir(edges.sparkSession)
    stars = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    state = None
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = small.unionByName(low.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = stars.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def join_small(rows: DataFrame, small: DataFrame, on: Column | str | list[str], how: str = "inner", most: int = 100_000) -> DataFrame:
    """Join with a table that is usually small: broadcast if it has at most ``most`` rows, else an ordinary join.

    ``small`` is written once, so that its size is known before the choice.
    """
    small = written(small, "small")
    return rows.join(F.broadcast(small) if small.count() <= most else small, on, how)


def left_lookup(rows: DataFrame, found: DataFrame, key: str, most: int = 500_000) -> DataFrame:
    """Left join on a long key with a written table that few rows need.

    With at most ``most`` rows the table is broadcast. Beyond, only rows that pass its filter are dealt by key, and
    the others, which surely have nothing in it, stay where they are.
    """
    if found.count() <= most:
        return rows.join(F.broadcast(found), key, "left")
    known = key_filter(found, key)
    rest = passing(rows, key, known, absent=True)
    for field in found.schema:
        if field.name != key:
            rest = rest.withColumn(field.name, F.lit(None).cast(field.dataType))
    dealt = passing(rows, key, known).join(found, key, "left")
    return dealt.unionByName(rest)
