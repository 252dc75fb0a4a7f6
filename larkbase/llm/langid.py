"""Language identification by cross-parsing entropy.

From a bounded sample of labelled texts, one suffix automaton is built per language. A text is parsed from left
to right into the longest phrases that occur in the language's sample; walking the automaton from its root gives
each longest match. The language that needs the fewest phrases, normalised by the text's length, wins.

The walk of an automaton, with its restart at the root when a phrase ends, is one lookup per character in a
flat table. Many texts walk in lockstep with numpy; where only a few long ones are left, they go on one by one from
where they are. Every text is one walk from its first to its last character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of the sample: documents per language, characters per language, and languages. Documents are taken whole.
SAMPLE_DOCS, SAMPLE_CHARS, LANGUAGES = 64, 48_000, 256
#: Entries of a language's table of moves: with a large alphabet, fewer documents are learned from.
ENTRIES = 8_000_000
#: Texts that are fewer walk one by one; symbols of a group of texts that walk in lockstep.
FEW, CELLS = 40, 1 << 25
_PHRASE = np.int32(1 << 30)


def suffix_automaton(symbols: list[int], alphabet: int) -> np.ndarray:
    """Transitions [state, symbol] of the minimal automaton of all substrings, -1 where there is none."""
    size = 2 * len(symbols) + 2
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    table = np.full((min(size, len(step)), alphabet), -1, np.int32)
    for state, moves in enumerate(step):
        for c, to in moves.items():
            table[state, c] = to
    return table


class CrossParser:
    """The languages' automata over a common alphabet. Symbol 0 stands for anything that is not a letter."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.languages = sorted(samples)
        letters = sorted({c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha()})
        number = {c: i + 2 for i, c in enumerate(letters)}
        self.alphabet = len(letters) + 2  # 1: a letter that no sample has
        code = np.zeros(0x110000, np.uint16)
        for i in range(0x110000):
            if not 0xD800 <= i < 0xE000 and (c := chr(i)).isalpha():
                code[i] = number.get(c.lower(), 1)
        self.code = code.astype(np.uint8) if self.alphabet < 256 else code
        self.tables = []
        for language in self.languages:
            symbols: list[int] = []
            for text in samples[language]:
                new = self.symbols(text).tolist()
                if symbols and 2 * (len(symbols) + len(new)) * self.alphabet > ENTRIES:
                    break
                symbols += new
            table = suffix_automaton(symbols, self.alphabet)
            # Where a phrase ends, the next begins at the root. One more state comes before a text and after a symbol
            # that the sample does not have, which is a phrase by itself.
            before = len(table)
            restart = (np.where(table[0] >= 0, table[0], before) * self.alphabet) | _PHRASE
            moves = np.where(table >= 0, table * self.alphabet, restart[None, :])
            self.tables.append((np.concatenate((moves, restart[None, :])).astype(np.int32).ravel(), before * self.alphabet))

    def symbols(self, text: str) -> np.ndarray:
        """Lower-cased letters as symbols, each run of other characters as one 0; 0 at both ends."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        found = np.concatenate((np.zeros(1, self.code.dtype), self.code[points], np.zeros(1, self.code.dtype)))
        return found[np.concatenate(([True], (found[1:] != 0) | (found[:-1] != 0)))]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases [text, language] that each text's symbols need."""
        out = np.zeros((len(texts), len(self.tables)), np.int64)
        order, at = sorted(range(len(texts)), key=lambda i: -len(texts[i])), 0
        while at < len(order):
            rows = order[at : at + max(1, CELLS // max(1, len(texts[order[at]])))]
            out[rows] = self._walk([texts[i] for i in rows])
            at += len(rows)
        return out

    def _walk(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of texts, the longest first."""
        sizes = np.array([len(x) for x in texts])
        together = int(sizes[FEW - 1]) if len(texts) >= FEW else 0
        flat = np.zeros((len(texts), together), self.code.dtype)
        for row, x in enumerate(texts):
            flat[row, : min(len(x), together)] = x[:together]
        columns = np.ascontiguousarray(flat.T)
        alive = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, together + 1), "left")
        rest = [(row, x[together:].tolist()) for row, x in enumerate(texts) if len(x) > together]
        out = np.zeros((len(texts), len(self.tables)), np.int64)
        for j, (moves, before) in enumerate(self.tables):
            state, begun = np.full(len(sizes), before, np.int32), np.zeros(len(sizes), np.int32)
            for symbols, n in zip(columns, alive.tolist(), strict=True):
                to = moves[state[:n] + symbols[:n]]
                begun[:n] += to >= _PHRASE
                state[:n] = to & (_PHRASE - 1)
            flat_moves, phrase = memoryview(moves), int(_PHRASE)
            for row, symbols in rest:
                at, more = int(state[row]), 0
                for symbol in symbols:
                    at = flat_moves[at + symbol]
                    if at >= phrase:
                        more, at = more + 1, at - phrase
                begun[row] += more
            out[:, j] = begun
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; ("und", 0.0) if it is null, has no letter, or nothing was learned.

        The score is the winner's margin: 0.5 where all languages need as many phrases, near 1 where
        the others need many more. Ties go to the smallest language name.
        """
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.languages:
            return out
        found = [(i, s) for i, t in enumerate(texts) if t and (s := self.symbols(t)).any()]
        if not found:
            return out
        counts = self.phrases([s for _, s in found]) / np.array([[max(1, len(s))] for _, s in found])
        best = counts.argmin(1)
        for (i, _), row, k in zip(found, counts, best.tolist(), strict=True):
            rest = np.delete(row, k)
            other = float(rest.min()) if len(rest) else 1.0
            out[i] = (self.languages[k], other / (other + float(row[k])))
        return out


def learned(labelled: DataFrame, text_col: str, lang_col: str, key: Column, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, languages: int = LANGUAGES) -> CrossParser:
    """A parser from a sample bounded per language: one document from each of sample_docs hash buckets, whole ones.

    Documents of more than a quarter of sample_chars are not learned from, and only the most frequent languages are learned.
    Null texts and labels are left out; an empty table gives a parser without languages.
    """
    named = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    frequent = [r.l for r in named.groupBy(F.col(lang_col).alias("l")).count().orderBy(F.desc("count"), "l").limit(languages).collect()]
    usable = named.where(F.col(lang_col).isin(frequent) & (F.char_length(text_col) <= sample_chars // 4)) if frequent else named
    place = F.xxhash64(key)
    picked = usable.groupBy(F.col(lang_col).alias("l"), F.pmod(place, F.lit(sample_docs)).alias("bucket")).agg(F.min(place).alias("place"))
    wanted = [r.place for r in picked.collect()]
    rows = usable.where(place.isin(wanted)).select(lang_col, place, text_col).distinct().collect() if wanted else []
    samples: dict[str, list[str]] = {}
    for lang, _, text in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        texts = samples.setdefault(lang, [])
        if sum(map(len, texts)) + len(text) <= sample_chars:
            texts.append(text)
    return CrossParser(samples)


def identify(docs: DataFrame, parser: CrossParser, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default), lang_pred and score for every whole text. No shuffle.

    Existing columns with these two names are replaced.
    """
    columns = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(parser)  # bounded by the sample's bounds
    source = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text_col}`").cast("string").alias("__text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 2000) for k in range(0, batch.num_rows, 2000)):
                found = shared.value.predict(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())],
                    [*columns, "lang_pred", "score"],
                )

    return source.mapInArrow(apply, schema)
