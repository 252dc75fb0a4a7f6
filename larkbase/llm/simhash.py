"""SimHash near-duplicates by multi-index hashing.

Fingerprints: majority bits over the hashes of a text's word shingles, repeats included. One XXH64 per shingle
gives the first 64 bits; wider fingerprints mix it further. Counting is done eight bits at a time: a table maps
each byte of a hash to eight packed byte counters, summed over at most 255 shingles before they are unpacked.

Links: fingerprints are cut into segments. Two fingerprints whose full distance is at most r have a segment in
which they differ by at most r // segments bits, so each fingerprint looks up the small Hamming ball around each
of its segments (of radius 1: only towards more bits, as one of two sides then has the other in it) in the table of segments, and complete distances are verified in the join. Lookups are made by
distinct fingerprints, so copies are never paired with one another.

Groups of near copies are not expanded into all their pairs; see ``links.py``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .links import bucket_components
from .shared import key_filter, passing, written

#: For each byte value, its eight bits as eight byte-wide counters.
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of a text, A-Z lower-cased; the whole text if it has fewer words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(tokens), len(tokens)
    digest = xxhash.xxh64_intdigest
    if n <= words:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - words]))
    return np.fromiter([digest(joined[s:e], 42) for s, e in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64, n - words + 1)


def fingerprint(hashes: np.ndarray, parts: int = 1) -> np.ndarray:
    """parts x 64 majority bits as uint64; a bit is 1 if set in over half the hashes, none give zeros."""
    out = np.zeros(parts, np.uint64)
    if not len(hashes):
        return out
    blocks = np.arange(0, len(hashes), 255)
    for p in range(parts):
        h = hashes
        if p:  # another 64 bits from the same hash: multiply by an odd constant, fold the high half down
            h = hashes * np.uint64((0x9E3779B97F4A7C15 * (2 * p + 1)) & (2**64 - 1))
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            h = h ^ (h >> np.uint64(29))
        packed = np.add.reduceat(_SPREAD[h.view(np.uint8).reshape(-1, 8)], blocks, axis=0)
        counts = packed.view(np.uint8).reshape(len(blocks), 64).sum(0, dtype=np.int64)
        out[p] = np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle_words: int = 3, parts: int = 1, sets: bool = False) -> DataFrame:
    """(doc_id, fp): fp is an array of ``parts`` longs. Null and empty texts get zeros. No shuffle.

    With sets also ``set``, a hash of the text's set of shingles.
    """
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("fp", T.ArrayType(T.LongType()))]
    schema = T.StructType(fields + [T.StructField("set", T.LongType())] * sets)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, names = [], []
            for x in batch.column(1):
                hashes = shingle_hashes(x.as_py(), shingle_words)
                bits.append(fingerprint(hashes, parts).view(np.int64))
                if sets:
                    names.append(_set_name(np.unique(hashes)))
            flat = pa.array(np.concatenate(bits) if bits else np.zeros(0, np.int64), pa.int64())
            fp = pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1) * parts, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), fp] + [pa.array(names, pa.int64())] * sets, schema.fieldNames())

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(apply, schema)


def _set_name(unique: np.ndarray) -> int:
    """A hash of a set of shingles, as signed 64-bit integer."""
    return int(np.uint64(xxhash.xxh64_intdigest(unique.tobytes())).view(np.int64))


def _shingle_sets(docs: DataFrame, shingle_words: int) -> DataFrame:
    """(set, shingles): a text's shingles, each once, and the name of the set. docs: (text)."""
    schema = T.StructType([T.StructField("set", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                unique = np.unique(shingle_hashes(x.as_py(), shingle_words))
                shingles = pa.ListArray.from_arrays(pa.array([0, len(unique)], pa.int32()), pa.array(unique.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([_set_name(unique)], pa.int64()), shingles], ["set", "shingles"])

    return docs.mapInArrow(apply, schema)


def _alike(pairs: DataFrame, distinct: DataFrame, docs: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """Pairs of sets of shingles with a Jaccard similarity of at least ``similarity``, from the texts of those sets only."""
    pairs = written(pairs, "simhash-pairs")
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = written(wanted.join(distinct.select("id", F.xxhash64("least").alias("key")), "id"), "simhash-wanted")
    keys = wanted.select("key").distinct()
    texts = passing(docs.select(F.xxhash64("doc_id").alias("key"), "text"), "key", key_filter(keys, "key")).join(keys, "key", "left_semi")
    sets = _shingle_sets(texts.select("text"), shingle_words).join(wanted.select(F.col("id").alias("set")).distinct(), "set", "left_semi")
    sets = written(sets, "simhash-sets")
    side = lambda x: sets.select(F.col("set").alias(x), F.col("shingles").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", F.size(F.array_intersect("s_a", "s_b")))
    linked = both.where(F.col("common") >= similarity * (F.size("s_a") + F.size("s_b") - F.col("common")) - 1e-9).select("a", "b")
    return linked


def _segment(fp: str, start: int, width: int) -> Column:
    """``width`` bits of a fingerprint from bit ``start`` on, as long; a segment may span two longs."""
    part, shift = divmod(start, 64)
    value = F.shiftrightunsigned(F.element_at(fp, part + 1), shift)
    if shift + width > 64:
        value = value.bitwiseOR(F.shiftleft(F.element_at(fp, part + 2), 64 - shift))
    return value.bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else value


def _distance(a: str, b: str, parts: int) -> Column:
    total = F.lit(0)
    for p in range(1, parts + 1):
        total = total + F.bit_count(F.element_at(a, p).bitwiseXOR(F.element_at(b, p)))
    return total


def _by_halves(distinct: DataFrame, segments: list[Column], bits: int) -> DataFrame:
    """Entries (id, w, deal, key) of every segment.

    Two segments that differ in one bit have one of their halves in common. So each is dealt twice, by its upper half (side 0) and
    by its lower half (side 1), and what it looks up is made where it was dealt to: two rows of a segment are moved, not
    one for each bit.
    """
    low = bits // 2
    rows = distinct.select("id", F.element_at("fp", 1).alias("w"), F.posexplode(F.array(*segments)).alias("i", "segment"))
    rows = rows.select("id", "w", "i", "segment", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    half = F.when(F.col("side") == 0, F.shiftrightunsigned("segment", low)).otherwise(F.col("segment").bitwiseAND(F.lit((1 << low) - 1)))
    of = F.shiftleft((2 * F.col("i") + F.col("side")).cast("long"), bits)
    return rows.select("id", "w", of.bitwiseOR(half).alias("deal"), of.bitwiseOR(F.col("segment")).alias("key"))


def _looked_up(entries: DataFrame, bits: int) -> DataFrame:
    """(id, w, deal, entry, key): keys that entries of _by_halves look up, their own and those with one more bit in the half by which they were not dealt.

    Of two segments that differ in one bit one has 0 there, and that one looks the other up.
    """
    low, key = bits // 2, F.col("entry")
    rows = entries.select("id", "w", "deal", F.col("key").alias("entry"))
    rows = rows.withColumn("turn", (F.shiftrightunsigned(key, bits).bitwiseAND(F.lit(1)) * low).cast("int"))
    bit = lambda x: F.call_function("shiftleft", F.lit(1 << x).cast("long"), F.col("turn"))
    ball = [F.when(key.bitwiseAND(bit(x)) == 0, key.bitwiseOR(bit(x))) for x in range(bits - low)]
    return rows.select("id", "w", "deal", "entry", F.explode(F.array(key, *ball)).alias("key")).where("key IS NOT NULL")


def components(distinct: DataFrame, parts: int, segments: int, segment_bits: int, segment_radius: int, distance: int, verify: Callable[[DataFrame], DataFrame] = lambda pairs: pairs) -> DataFrame:
    """From (id, fp) with distinct ids, (node, component) of ids linked by at most ``distance`` bits and by ``verify``.

    A segment that would end beyond the fingerprint ends with it. Exact if every pair within ``distance`` has a segment within ``segment_radius`` bits, as when the segments
    cover the fingerprint and distance < segments * (segment_radius + 1).
    """
    # One word of the fingerprint is compared in the lookup; with more words, loosely, before all of it is verified.
    word_distance = distance if parts == 1 else min(32, distance // parts + round(3 * (distance / parts) ** 0.5))
    words = distinct.select("id", F.element_at("fp", 1).alias("w"))
    close = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= word_distance
    cut = [_segment("fp", min(i * segment_bits, 64 * parts - segment_bits), segment_bits) for i in range(segments)]
    if segment_radius == 1:
        return bucket_components(_by_halves(distinct, cut, segment_bits), words, close, lambda pairs: verify(_verified(pairs, distinct, parts, distance)), ball=lambda entries: _looked_up(entries, segment_bits))
    keys = F.array(*[x.bitwiseOR(F.lit(i << segment_bits)) for i, x in enumerate(cut)])
    segment = F.col("segment")
    ball = [segment.bitwiseXOR(F.lit(sum(1 << x for x in c)).cast("long")) for r in range(1, segment_radius + 1) for c in combinations(range(segment_bits), r)]
    lookups = distinct.select("id", F.element_at("fp", 1).alias("w"), F.explode(keys).alias("segment")).select("id", "w", "segment", F.explode(F.array(segment, *ball)).alias("key"))
    lookups = lookups.select("id", "w", "key", (F.col("key") == segment).alias("own"))
    return bucket_components(lookups, words, close, lambda pairs: verify(_verified(pairs, distinct, parts, distance)))


def _verified(pairs: DataFrame, distinct: DataFrame, parts: int, distance: int) -> DataFrame:
    """Pairs whose complete fingerprints are within ``distance`` bits; with one word the lookup has compared all of it."""
    if parts == 1:
        return pairs
    side = lambda x: distinct.select(F.col("id").alias(x), F.col("fp").alias(f"fp_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_distance("fp_a", "fp_b", parts) <= distance).select("a", "b")


def near_duplicates(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    shingle_words: int = 3,
    parts: int = 1,
    segments: int = 2,
    segment_bits: int = 32,
    segment_radius: int = 1,
    distance: int = 3,
    similarity: float | None = None,
) -> DataFrame:
    """One row per document: doc_id, fp (array of ``parts`` longs), component_id (smallest doc_id reachable).

    Documents with equal fingerprints are linked, as are those within ``distance`` bits. With a similarity, documents with
    equal sets of shingles are linked, and of those within ``distance`` bits the ones whose sets have at least that Jaccard
    similarity. Null and empty texts
    have fingerprint zero and are linked like any other. A null doc_id is never the smallest unless its whole
    group has null. Repeated rows stay repeated. Empty tables give no rows; other columns are not looked at.
    """
    if similarity is not None:
        return _near_by_sets(docs, text_col, id_col, shingle_words, parts, (segments, segment_bits, segment_radius, distance), similarity)
    rows = written(fingerprints(docs, text_col, id_col, shingle_words, parts), "simhash-fingerprints")
    name = F.element_at("fp", 1) if parts == 1 else F.xxhash64("fp")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")).select(name.alias("id"), "fp", "least"), "simhash-distinct")
    component = components(distinct, parts, segments, segment_bits, segment_radius, distance)
    grouped = distinct.join(component.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(grouped.join(least, "component").select("fp", "component_id"), "simhash-named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def _near_by_sets(docs: DataFrame, text_col: str, id_col: str, shingle_words: int, parts: int, search: tuple[int, ...], similarity: float) -> DataFrame:
    """near_duplicates with sets of shingles for identity and links."""
    rows = written(fingerprints(docs, text_col, id_col, shingle_words, parts, sets=True), "simhash-fingerprints")
    distinct = written(rows.groupBy("set").agg(F.min("fp").alias("fp"), F.min("doc_id").alias("least")).withColumnRenamed("set", "id"), "simhash-distinct")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    component = components(distinct, parts, *search, verify=lambda pairs: _alike(pairs, distinct, source, shingle_words, similarity))
    grouped = distinct.join(component.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(grouped.join(least, "component").select(F.col("id").alias("set"), "component_id"), "simhash-named")
    return rows.join(named, "set").select("doc_id", "fp", "component_id")


#: Word shingles of five at a Jaccard similarity of 0.8, which is a cosine of about 2s / (1 + s) of the shingle counts: an
#: expected distance of 512 * acos(8 / 9) / pi = 77.6 bits, give or take 8. Four such steps more are allowed, and what
#: is within them is compared by its shingles. 24 segments of 22 bits, the last two overlapping, are all of the 512.
WIDE = {"shingle_words": 5, "parts": 8, "segments": 24, "segment_bits": 22, "segment_radius": 1, "distance": 110, "similarity": 0.8}


def representatives(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **settings: float) -> DataFrame:
    """The documents without all but one of each group of near-duplicates, with their own columns only.

    The row with the smallest id of a group stays, with every row that repeats its id. A group whose ids are all
    null stays. Settings are those of near_duplicates, by default WIDE.
    """
    found = near_duplicates(docs, text_col, id_col, **(WIDE | settings))
    gone = written(found.where("doc_id <> component_id OR (doc_id IS NULL AND component_id IS NOT NULL)").select("doc_id").distinct(), "simhash-gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.xxhash64(F.col(f"`{id_col}`")).alias("key"))
    gone = gone.select(F.xxhash64("doc_id").alias("key"))
    # Documents that surely stay are not moved.
    filtered = key_filter(gone, "key")
    maybe = passing(rows, "key", filtered).join(gone, "key", "left_anti")
    return maybe.unionByName(passing(rows, "key", filtered, absent=True)).select("doc.*")
