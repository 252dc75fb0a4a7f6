"""Packing by optimal length buckets.

The histogram of lengths is counted over all documents. Dynamic programming over it chooses the bucket
boundaries that minimise padding when each document is padded to its bucket's boundary. Batches with a token
budget form inside each bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import word_count, written

#: Parts per bucket among which documents are dealt before they are numbered.
DEALS = 256


def boundaries(lengths: Sequence[int], counts: Sequence[int], buckets: int) -> list[int]:
    """At most ``buckets`` boundaries, the last of them the largest length, that give the least padding.

    Exact. With k buckets over the first j lengths, best[k][j] = min over i of best[k-1][i] + padding of
    lengths i..j-1 to length j-1. Padding falls apart into a line in the boundary's length for each i, so each
    row is the lower envelope of lines with falling slopes, asked at rising lengths: linear time a row.
    """
    length = [int(x) for x in lengths]
    total = np.concatenate(([0], np.cumsum(np.array(counts, dtype=object)))).tolist()
    mass = np.concatenate(([0], np.cumsum(np.array(counts, dtype=object) * np.array(length, dtype=object)))).tolist()
    n = len(length)
    if not n:
        return []
    best: list = [0] + [None] * n
    choice: list[list[int]] = []
    for _ in range(min(buckets, n)):
        row: list = [None] * (n + 1)
        came = [0] * (n + 1)
        hull: list[tuple[int, int, int]] = []
        head = 0
        for j in range(1, n + 1):
            i = j - 1
            if best[i] is not None:
                slope, offset = -total[i], best[i] + mass[i]
                while len(hull) - head >= 2:
                    (m1, b1, _), (m2, b2, _) = hull[-2], hull[-1]
                    if (offset - b1) * (m1 - m2) <= (b2 - b1) * (m1 - slope):
                        hull.pop()
                    else:
                        break
                hull.append((slope, offset, i))
            x = length[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            if len(hull) > head:
                m, b, i = hull[head]
                row[j], came[j] = m * x + b + x * total[j] - mass[j], i
        choice.append(came)
        if best[n] is not None and row[n] >= best[n]:
            choice.pop()
            break
        best = row
    ends, j = [], n
    for came in reversed(choice):
        ends.append(length[j - 1])
        j = came[j]
    return ends[::-1]


def pack(docs: DataFrame, buckets: int = 16, token_budget: int = 65_536, seed: int = 17, text_col: str = "text", id_col: str = "doc_id", step: int = 1) -> DataFrame:
    """One row per document and copy: doc_id, length, bucket, boundary, batch, slot, over_budget.

    Length is the number of words (null: 0), counted up to a multiple of ``step`` for the histogram. A batch of a
    bucket holds token_budget // boundary documents, at least one; documents whose boundary exceeds the budget are
    batches of their own, marked over_budget. Documents without words go to the smallest bucket. Order inside a
    bucket is seeded: documents are dealt by hash among parts, each part is numbered by itself from where the
    counts of the parts before it end. Repeated rows are packed as often as they occur. No documents, no rows.
    """
    length = word_count(F.col(f"`{text_col}`"))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), length.alias("length"))
    place = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("length"))
    rows = written(rows.withColumn("place", place).withColumn("deal", F.pmod("place", F.lit(DEALS))), "pack-lengths")
    stepped = F.ceil(F.col("length") / step) * step
    counted = rows.groupBy(stepped.alias("l")).agg(F.count("*").alias("n")).orderBy("l").toPandas()
    ends = boundaries(counted["l"].tolist(), counted["n"].tolist(), buckets) or [0]
    index = F.lit(0)
    for e in ends[:-1]:
        index = index + (stepped > e).cast("int")
    rows = rows.withColumn("bucket", index).withColumn("boundary", F.get(F.array(*[F.lit(e).cast("long") for e in ends]), F.col("bucket")))
    parts = rows.groupBy("bucket", "deal").agg(F.count("*").alias("n"))  # at most buckets x DEALS rows
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = F.broadcast(parts.select("bucket", "deal", before.alias("before")))
    number = F.row_number().over(Window.partitionBy("bucket", "deal").orderBy("place", "doc_id")) - 1
    rows = rows.withColumn("number", number).join(parts, ["bucket", "deal"]).withColumn("number", F.col("number") + F.col("before"))
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.greatest(F.col("boundary"), F.lit(1))))
    return rows.select(
        "doc_id", "length", "bucket", "boundary", F.floor(F.col("number") / room).alias("batch"), (F.col("number") % room).alias("slot"), (F.col("boundary") > token_budget).alias("over_budget")
    )
