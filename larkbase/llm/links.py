"""Links between the members of buckets, without all pairs of a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, discard, join_small, written

#: Entries up to which all pairs of a bucket are looked at as they are; fuller buckets are split without loss.
FULL = 64
#: Entries of a part of a split bucket. Any two parts meet in a task of their own.
PART = 4096
#: Members of a crowded bucket's class, besides the least, with which all others are compared first.
HUBS = 3
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def _merged(component: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(node, component) once more links (a, b) are known. Components are contracted first, so that the new graph is small."""
    if component is None:
        return written(connected_components(edges), "bucket-components")
    known = lambda x: component.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    between = edges.join(known("a"), "a", "left").join(known("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    merged = written(connected_components(between), "bucket-merged").select(F.col("node").alias("c"), F.col("component").alias("new"))
    nodes = component.unionByName(merged.select(F.col("c").alias("node"), F.col("c").alias("component"))).distinct()
    joined = nodes.select("node", F.col("component").alias("c")).join(merged, "c", "left")
    named = joined.select("node", F.coalesce("new", "c").alias("component")).groupBy("node").agg(F.min("component").alias("component"))
    return written(named, "bucket-components")


def _hits(lookups: DataFrame, close: Callable[[Column, Column], Column], ball: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, key, own, b, n): lookups that meet something, with the smallest entry and the number of entries of their bucket."""
    if ball is not None:
        # Entries are dealt once; what else they look up is made where they are.
        dealt = lookups.select("id", "w", "deal", "key").repartition("deal")
        buckets = dealt.groupBy("deal", "key").agg(F.min("id").alias("b"), F.min("w").alias("t"), F.count("*").alias("n"))
        buckets = buckets.withColumnRenamed("deal", "d").withColumnRenamed("key", "k")
        hit = (F.col("deal") == F.col("d")) & (F.col("key") == F.col("k")) & ((F.col("n") > 1) | ((F.col("id") != F.col("b")) & close(F.col("w"), F.col("t"))))
        met = ball(dealt).join(buckets, hit).select("id", "key", (F.col("key") == F.col("entry")).alias("own"), "b", "n")
        # What is dealt by deal alone is dealt well enough for a join by deal and key.
        conf, before = met.sparkSession.conf, met.sparkSession.conf.get(_ALL_KEYS)
        conf.set(_ALL_KEYS, "false")
        try:
            return written(met, "bucket-hits")
        finally:
            conf.set(_ALL_KEYS, before)
    if "own" not in lookups.columns:
        dealt = lookups.select("id", "key").repartition("key")
        buckets = dealt.groupBy("key").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1")
        hits = dealt.join(buckets.withColumnRenamed("key", "k"), F.col("key") == F.col("k"))
        return written(hits.select("id", "key", F.lit(True).alias("own"), "b", "n"), "bucket-hits")
    # One exchange for the buckets and for what looks them up. w and own share a long. In a bucket of one entry, the
    # least tag is that entry's, so most chance meetings end within the join.
    tag = F.shiftleft("w", 1).bitwiseOR(F.col("own").cast("long"))
    dealt = lookups.select("id", "key", tag.alias("tag")).repartition("key")
    own = F.col("tag").bitwiseAND(F.lit(1)) == 1
    buckets = dealt.where(own).groupBy("key").agg(F.min("id").alias("b"), F.min("tag").alias("t"), F.count("*").alias("n"))
    alike = close(F.shiftrightunsigned("tag", 1), F.shiftrightunsigned("t", 1))
    hit = (F.col("key") == F.col("k")) & ((F.col("n") > 1) | ((F.col("id") != F.col("b")) & alike))
    return written(dealt.join(buckets.withColumnRenamed("key", "k"), hit).select("id", "key", own.alias("own"), "b", "n"), "bucket-hits")


def bucket_components(
    lookups: DataFrame,
    words: DataFrame,
    close: Callable[[Column, Column], Column],
    verify: Callable[[DataFrame], DataFrame] = lambda pairs: pairs,
    classes: Callable[[Column], Column] | None = None,
    full: int = FULL,
    most: int | None = None,
    finer: Callable[[DataFrame], DataFrame] | None = None,
    closer: Callable[[Column, Column], Column] | None = None,
    ball: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(node, component) of all ids that are linked with another, links being between ids that meet in a bucket.

    lookups: (id, w, key, own): an id looks a bucket up; with own it is also an entry of that bucket. Lookups (id, key)
    are all entries, so that a bucket of one entry has no meetings and neither w nor own is dealt. With ball, (id, w, deal, key)
    are all entries, and ball makes the lookups (id, w, deal, entry, key) of them, which meet entries of the same deal. words: (id, w)
    by distinct id, w of any type if all are entries; close: whether two w may be linked, also if both have lost their highest bit; verify: takes
    distinct pairs (a, b), returns the linked ones. finer: from distinct (id), (id, w) with another w for the second pass, and
    closer the close for it; both or none.

    The first pass links every lookup with the smallest entry of its bucket. The second looks at all pairs whose ids
    are in different components still. With classes (a number for each w, so that the numbers of any two w that are close
    differ by at most one; all lookups are entries), buckets of more than ``full`` entries come last: their members are compared
    with a few of them, and what is still in different components is split by these numbers
    and then into parts, of which any two meet, so that no task has a whole bucket and every close pair meets once.
    No link between components is capped or sampled away. At most ``most`` pairs are verified at once; the others wait, and of
    those the ones that what was linked meanwhile has brought into one component need no verification.
    """
    word = lambda x: words.select(F.col("id").alias(x), F.col("w").alias(f"w_{x}"))

    closer = closer or close

    def between(rows: DataFrame) -> DataFrame:
        """Pairs of rows (id, key, own, w, c) of a bucket in different components, each once if both are entries."""
        one = rows.select(F.col("id").alias("a"), F.col("own").alias("own_a"), F.col("w").alias("w_a"), F.col("c").alias("c_a"), "key")
        two = rows.where("own").select(F.col("id").alias("b"), F.col("w").alias("w_b"), F.col("c").alias("c_b"), F.col("key").alias("k"))
        once = ~F.col("own_a") | (F.col("a") < F.col("b"))
        return one.join(two, (F.col("key") == F.col("k")) & (F.col("c_a") != F.col("c_b")) & once & closer(F.col("w_a"), F.col("w_b"))).select("a", "b")

    hits = _hits(lookups, close, ball)
    first = hits.where("id <> b").select(F.col("id").alias("a"), "b").distinct().join(word("a"), "a").join(word("b"), "b").where(close(F.col("w_a"), F.col("w_b")))
    ordered = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    component = _merged(None, written(verify(ordered), "bucket-first"))
    # Only buckets whose entries are not all in one component are left; mostly these are few.
    named = hits.where("n > 1").select("id", "key", "own", "n").join(component.withColumnRenamed("node", "id"), "id", "left")
    named = named.select("id", "key", "own", "n", F.coalesce("component", "id").alias("c"))
    mixed = named.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select(F.col("key").alias("k"))
    named = written(named.join(mixed, F.col("key") == F.col("k"), "left_semi"), "bucket-mixed")
    discard(hits)
    looked = words.select("id", "w") if finer is None else finer(named.select("id").distinct())
    fuller = written(named.join(looked, "id").select("id", "key", "own", "n", "w", "c"), "bucket-fuller")
    discard(named)
    component = _settled(between(fuller if classes is None else fuller.where(F.col("n") <= full)), component, verify, most)
    crowded = fuller.where(F.col("n") > full)
    if classes is not None and not crowded.isEmpty():
        again = lambda: crowded.drop("c").join(component.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id"))
        component = _settled(_to_hubs(again(), closer, classes), component, verify, most)
        component = _settled(_split(again(), closer, classes), component, verify, most)
    discard(fuller)
    return component


def _settled(pairs: DataFrame, component: DataFrame, verify: Callable[[DataFrame], DataFrame], most: int | None) -> DataFrame:
    """(node, component) once every one of the pairs (a, b) is verified, or is in one component by other links.

    Of many pairs few are verified at first, as lines of a bucket are often like many others of it.
    """
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "bucket-pairs")
    size, turn = most and -(-most // 8), 0
    while n := pairs.count():
        rounds, turn = 1 if most is None else -(-n // size), turn + 1
        now = F.pmod(F.xxhash64(F.lit(turn), "a", "b"), F.lit(rounds)) == 0
        rest = written(verify(pairs.where(now)), "bucket-rest")
        if not rest.isEmpty():
            component = _merged(component, rest)
        if rounds == 1:
            break
        known = lambda x: component.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))  # noqa: B023, E731
        apart = F.coalesce("c_a", "a") != F.coalesce("c_b", "b")
        left = written(pairs.where(~now).join(known("a"), "a", "left").join(known("b"), "b", "left").where(apart).select("a", "b"), "bucket-pairs")
        discard(pairs)
        pairs, size = left, min(4 * size, most)
    discard(pairs)
    return component


def _to_hubs(rows: DataFrame, close: Callable[[Column, Column], Column], classes: Callable[[Column], Column]) -> DataFrame:
    """Close pairs (a, b) of rows (id, key, w, c) of a bucket in different components, b one of a few hubs of a's class and of those beside it.

    Hubs are the ids of the least w and HUBS others. There are as many such pairs as rows, a few times, and what they connect
    does not come up when all pairs are looked at, of which there is the square.
    """
    rows = rows.select("id", "key", "w", "c", classes(F.col("w")).alias("step"))
    one = F.struct("id", "w", "c")
    ranked = [F.min_by(one, F.xxhash64(F.lit(i), "id")) for i in range(HUBS)]
    hubs = rows.groupBy("key", "step").agg(F.array_distinct(F.array(F.min_by(one, F.struct("w", "id")), *ranked)).alias("hubs"))
    hubs = hubs.select(F.col("key").alias("k"), F.explode(F.array(*[F.col("step") + i for i in (-1, 0, 1)])).alias("class"), "hubs")
    hubs = hubs.select("k", "class", F.explode("hubs").alias("hub"))
    met = join_small(rows, hubs, (F.col("key") == F.col("k")) & (F.col("step") == F.col("class")) & (F.col("c") != F.col("hub.c")) & close(F.col("w"), F.col("hub.w")))
    return met.select(F.col("id").alias("a"), F.col("hub.id").alias("b"))


def _split(rows: DataFrame, close: Callable[[Column, Column], Column], classes: Callable[[Column], Column]) -> DataFrame:
    """All close pairs (a, b) of rows (id, key, w, c) of a bucket in different components, without a task for a whole bucket."""
    step = classes(F.col("w"))
    rows = rows.select("id", "w", "c", step.alias("step"), F.explode(F.array(step, step + 1)).alias("class"), "key")
    rows = rows.withColumn("key", F.xxhash64("key", "class"))
    sizes = rows.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("low <> high")
    rows = rows.join(sizes.select("key", "parts"), "key").withColumn("part", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("parts")).cast("int"))
    rows = rows.select("id", "w", "c", "step", "class", "part", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    # The one side has entries of the class's own step, the other those of the step below too: of equal steps each pair
    # is made once by the order of ids. Any part of the one meets any of the other, and neither is read in vain.
    side = lambda x, table, part, other: table.select(F.xxhash64("key", part, other).alias(f"key_{x}"), *[F.col(n).alias(f"{n}_{x}") for n in ("id", "w", "c", "step")])
    once = (F.col("step_a") != F.col("step_b")) | (F.col("id_a") < F.col("id_b"))
    one, two = side("a", rows.where(F.col("step") == F.col("class")), "part", "other"), side("b", rows, "other", "part")
    both = one.join(two, (F.col("key_a") == F.col("key_b")) & (F.col("c_a") != F.col("c_b")) & once & close(F.col("w_a"), F.col("w_b")))
    return both.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
