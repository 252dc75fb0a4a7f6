"""Quality rules by suffix-array repetition.

Each text becomes a sequence of words. One suffix array over a block of texts (a text's number is part of
its words, so nothing matches across texts) is built by prefix doubling in numpy. The ranks of every
doubling round are kept, so the longest common prefix of neighbouring suffixes comes from the same rounds.
LCP intervals give, for each position, the longest repeat that starts there; those that do not merely
continue the repeat of the position before are the occurrences of maximal repeated substrings.
Their spans are united, and the covered fraction and the longest repeat are limited.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words per block whose suffixes are sorted together; a longer text is a block of its own.
BLOCK_WORDS = 200_000
_SYMBOLS = b"#*$%&|<>"
_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

STATS = T.StructType(
    [T.StructField(x, T.LongType()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")]
)


def _sorted_ranks(first: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The order of pairs of small non-negative numbers, and where that order's groups of equals begin."""
    n, wide = len(first), int(first.max(initial=0)).bit_length() + (int(second.max(initial=0)).bit_length() if second is not None else 0)
    low, place = (int(second.max(initial=0)).bit_length() if second is not None else 0), max(1, (n - 1).bit_length())
    if wide + place <= 63:  # all in one machine word, which sorts fastest
        packed = first.astype(np.int64) << (low + place)
        if second is not None:
            packed |= second.astype(np.int64) << place
        packed |= np.arange(n)
        packed.sort()
        order, keys = packed & ((1 << place) - 1), packed >> place
        return order, np.concatenate(([True], keys[1:] != keys[:-1]))
    order = np.lexsort((second, first)) if second is not None else np.argsort(first, kind="stable")
    new = first[order][1:] != first[order][:-1]
    if second is not None:
        new |= second[order][1:] != second[order][:-1]
    return order, np.concatenate(([True], new))


def longest_repeats(words: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position, how many words the longest repeat has that starts there, within its text.

    words: word numbers; doc: each position's text, ascending; ends: end position of each position's text.
    """
    n = len(words)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    order, new = _sorted_ranks(doc, words)
    start = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(start, np.diff(np.append(start, n)))
    sizes = np.diff(np.append(start, n))
    slots = np.flatnonzero(np.repeat(sizes, sizes) > 1)  # slots of the suffix array not yet settled
    suffix, length, levels = order.copy(), 1, [rank]
    while len(slots):
        at = suffix[slots]
        follow = at + length
        inside = follow < ends[at]
        second = np.where(inside, rank[np.minimum(follow, n - 1)] + 1, 0)
        inner, new = _sorted_ranks(rank[at], second)
        suffix[slots] = at[inner]
        begins = np.flatnonzero(new)
        sizes = np.diff(np.append(begins, len(slots)))
        rank = rank.copy()
        rank[suffix[slots]] = np.repeat(slots[begins], sizes)
        levels.append(rank)
        slots = slots[np.repeat(sizes, sizes) > 1]
        length *= 2
    # Neighbours of the suffix array: walk down the rounds; equal ranks at a round mean 2**round equal words.
    a, b = suffix[:-1], suffix[1:]
    pair = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[pair].copy(), b[pair].copy()
    lcp = np.zeros(len(pair), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        ok = (x < ends[a]) & (y < ends[b])
        same = ok & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        lcp += same * (1 << k)
    np.maximum.at(best, a, lcp)
    np.maximum.at(best, b, lcp)
    return best


def covered(begin: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in the union of spans."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, begin, 1)
    np.add.at(delta, begin + length, -1)
    return np.cumsum(delta[:-1]) > 0


def _block(numbers: list[list[int]], min_repeat: int) -> list[tuple[int, int, int]]:
    """Of each text of a block: words in repeated 3-word windows, words covered by maximal repeats, longest repeat."""
    sizes = np.array([len(x) for x in numbers], np.int64)
    n = int(sizes.sum())
    if not n:
        return [(0, 0, 0)] * len(numbers)
    words = np.fromiter(chain.from_iterable(numbers), np.int64, n)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    stops = np.cumsum(sizes)
    best = longest_repeats(words, doc, stops[doc])
    windows = np.flatnonzero(best >= 3)
    in_windows = covered(windows, np.full(len(windows), 3), n)
    before = np.concatenate(([0], best[:-1]))
    before[(stops - sizes)[sizes > 0]] = 0
    maximal = np.flatnonzero((best >= min_repeat) & (before != best + 1))
    in_repeats = covered(maximal, best[maximal], n)
    total = lambda x: np.bincount(doc, weights=x, minlength=len(sizes)).astype(np.int64)
    longest = np.zeros(len(sizes), np.int64)
    np.maximum.at(longest, doc, best)
    return list(zip(total(in_windows).tolist(), total(in_repeats).tolist(), longest.tolist(), strict=True))


def text_stats(texts: list[str | None], min_repeat: int) -> list[tuple[int, ...]]:
    """The columns of STATS for each text."""
    out: list[tuple[int, ...]] = []
    base: list[tuple[int, ...]] = []
    numbers: list[list[int]] = []
    waiting, ids = 0, defaultdict(count().__next__)

    def settle() -> None:
        nonlocal waiting, ids
        out.extend(x + y for x, y in zip(base, _block(numbers, min_repeat), strict=True))
        base.clear()
        numbers.clear()
        waiting, ids = 0, defaultdict(count().__next__)

    for text in texts:
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        spaces = len(raw) - len(raw.translate(None, _SPACES))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        if waiting and waiting + len(words) > BLOCK_WORDS:
            settle()
        base.append((len(words), len(text) - spaces, len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines))))
        numbers.append(list(map(ids.__getitem__, words)))
        waiting += len(words)
    if base:
        settle()
    return out


def repetition_stats(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, min_repeat: int = 10) -> DataFrame:
    """The kept columns (all by default) and the columns of STATS, without a shuffle.

    A null text counts as empty and has zero everywhere. A column that has the name of a statistic is replaced.
    """
    columns = [c for c in (docs.columns if keep is None else keep) if c not in STATS.names]
    schema = T.StructType([docs.schema[c] for c in columns] + STATS.fields)
    source = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text_col}`").cast("string").alias("__text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = text_stats(batch.column(batch.num_columns - 1).to_pylist(), min_repeat)
            stats = zip(*rows, strict=True) if rows else [[]] * len(STATS)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(x, pa.int64()) for x in stats)], [*columns, *STATS.names]
            )

    return source.mapInArrow(apply, schema)


def judged(
    stats: DataFrame, min_words: int = 50, max_window_percent: int = 50, max_covered_percent: int = 30, max_longest_percent: int = 20
) -> DataFrame:
    """Adds base_failed and kept to the result of repetition_stats.

    base_failed: fewer than min_words words, or more than max_window_percent of them in repeated 3-word windows.
    kept: not base_failed, at most max_covered_percent of the words covered by maximal repeats, and the longest
    repeat at most max_longest_percent of the words, if it has the length of a counted repeat.
    """
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_window_percent * F.col("n_words"))
    fine = (100 * F.col("covered_words") <= max_covered_percent * F.col("n_words")) & (
        (F.col("covered_words") == 0) | (100 * F.col("longest_repeat") <= max_longest_percent * F.col("n_words"))
    )
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def quality_filter(docs: DataFrame, text_col: str = "text", **limits: int) -> DataFrame:
    """Documents that the rules keep, with their own columns only."""
    kept = judged(repetition_stats(docs.withColumn("__doc", F.struct(*[F.col(f"`{c}`") for c in docs.columns])), text_col, ["__doc"]), **limits)
    return kept.where("kept").select("__doc.*")
