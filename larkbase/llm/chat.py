"""Quotation linking: reply-ordered conversations without quotes.

Messages are parsed line by line into nesting levels of ``>``. Each run of lines of a level is a quoted passage; the
lines without markers are the message's own body. Passages and bodies, whole, line by line and sentence by sentence
(whatever the line breaks), are normalised and hashed, and passages are joined to the earliest message that has the text as its own: in the same conversation
before the quoting turn, else anywhere. The message quoted with most words at the lowest level is the parent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import join_small, key_filter, passing, written

_MARKERS = re.compile(r"[ \t]*(?:>[ \t]?)+")
#: A line that announces a quotation, such as "On Monday, somebody wrote:".
_ANNOUNCES = re.compile(r"(?i)(?:on|am|le|el)\b.{0,200}\b(?:wrote|schrieb|a écrit|escribió)\s?:\s*")
#: Words from which a quotation is looked up in other conversations too; shorter ones only in their own.
LINE_WORDS = 4
_SENTENCE = re.compile(r"(?<=[.!?…。！？])\s+")
#: Root turns that share a block, and turns of a thread that share a part, when positions are counted.
BLOCK = 256

_QUOTE = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("hash", T.StringType()), T.StructField("words", T.IntegerType())])
PARSED = T.StructType([T.StructField("body", T.StringType()), T.StructField("quotes", T.ArrayType(_QUOTE)), T.StructField("own", T.ArrayType(T.StringType()))])


def _digest(words: list[str]) -> str:
    import hashlib

    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def normal_words(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def parse(text: str | None) -> tuple[str | None, list[tuple[int, str, int]], list[str]]:
    """Body without quotes; (level, hash, words) of quoted passages, their lines and sentences; hashes of the body's parts."""
    if text is None:
        return None, [], []
    body: list[str] = []
    runs: list[tuple[int, list[str]]] = []
    last = 0
    for line in text.split("\n"):
        marks = _MARKERS.match(line)
        level = marks[0].count(">") if marks else 0
        if not level:
            body.append(line)
        elif level == last:
            runs[-1][1].append(line[marks.end() :])
        else:
            if last == 0 and body and _ANNOUNCES.fullmatch(body[-1].strip()):
                body.pop()
            runs.append((level, [line[marks.end() :]]))
        last = level
    quotes: dict[tuple[int, str], int] = {}
    for level, lines in runs:
        if words := normal_words("\n".join(lines)):
            quotes[level, _digest(words)] = len(words)
        for part in [*lines, *_SENTENCE.split("\n".join(lines))]:
            if words := normal_words(part):
                quotes.setdefault((level, _digest(words)), len(words))
    whole = "\n".join(body)
    own = {_digest(words) for x in [whole, *body, *_SENTENCE.split(whole)] if (words := normal_words(x))}
    kept = "\n".join(body).strip("\n") if runs else text
    return kept, [(level, h, n) for (level, h), n in quotes.items()], sorted(own)


def _parsed(messages: DataFrame) -> DataFrame:
    schema = T.StructType([*messages.schema.fields, *PARSED.fields])
    at = messages.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quote = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.string()), ("words", pa.int32())]))
        for batch in batches:
            found = [parse(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([[dict(zip(("level", "hash", "words"), q, strict=True)) for q in x[1]] for x in found], quote),
                    pa.array([x[2] for x in found], pa.list_(pa.string())),
                ],
                schema.names,
            )

    return messages.mapInArrow(apply, schema)


def _roots(parents: DataFrame) -> DataFrame:
    """(conv, turn, root, depth) for (conv, turn, parent) with parent < turn, by doubling of pointers."""
    spot = written(parents.select("conv", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "chat-roots")
    while True:
        up = spot.select("conv", F.col("turn").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        joined = written(spot.join(up, ["conv", "root"], "left"), "chat-roots")
        spot = joined.select("conv", "turn", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        if joined.where("above IS NOT NULL").isEmpty():
            return spot


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row per message of (conv_id, turn, role, text): those, reply_to_conv, reply_to, root_turn, depth, position.

    text comes back without quotes and their announcing lines; a null text stays null. reply_to_conv and reply_to
    name the quoted message, null where nothing was quoted or found. Within a conversation a message hangs below the
    message it quotes; threads are ordered by the turn of their root, messages of a thread by turn, and position
    counts them from 0, so every reply follows what it quotes. Quotes of other conversations do not move a message.
    Of equal originals the earliest is linked. Rows that repeat a conversation and turn follow each other. Rows with
    a null conv_id or turn quote and are quoted like others but start threads of their own. Other columns are left out.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parsed = written(_parsed(rows), "chat-parsed")
    quotes = parsed.where(F.size("quotes") > 0).select("conv", "turn", F.explode("quotes").alias("q")).select("conv", "turn", "q.*")
    quotes = written(quotes.withColumn("h", F.xxhash64("hash")), "chat-quotes")

    # Earliest owner of each quoted text, in each conversation and anywhere; pre-aggregated, so a common text is one row.
    own = passing(parsed.select("conv", "turn", F.explode("own").alias("hash")).withColumn("h", F.xxhash64("hash")), "h", key_filter(quotes, "h"))
    here = written(own.groupBy("hash", "conv").agg(F.min("turn").alias("here")), "chat-here")
    anywhere = here.where("conv IS NOT NULL").groupBy("hash").agg(F.min(F.struct("conv", F.col("here").alias("turn"))).alias("far"))
    found = join_small(join_small(quotes.drop("h"), here, ["hash", "conv"], "left"), anywhere, "hash", "left")
    near = F.col("here") < F.col("turn")
    other = F.col("far").isNotNull() & (F.col("words") >= LINE_WORDS) & ~F.col("far.conv").eqNullSafe(F.col("conv"))
    target = F.when(near, F.struct("conv", F.col("here").alias("turn"))).when(other, F.col("far"))
    found = found.withColumn("target", target).where("target IS NOT NULL")
    votes = found.groupBy("conv", "turn", "target").agg(F.min("level").alias("level"), F.sum("words").alias("words"))
    best = votes.groupBy("conv", "turn").agg(F.min(F.struct("level", -F.col("words"), -F.col("target.turn"), "target")).alias("best"))
    replies = written(best.select("conv", "turn", F.col("best.target.conv").alias("reply_to_conv"), F.col("best.target.turn").alias("reply_to")), "chat-replies")

    inside = replies.where("conv = reply_to_conv AND turn IS NOT NULL").select("conv", "turn", F.col("reply_to").alias("parent"))
    placed = replies.join(_roots(inside), ["conv", "turn"], "left").select(F.col("conv").alias("c"), F.col("turn").alias("t"), "reply_to_conv", "reply_to", "root", "depth")
    rows = join_small(parsed.select("conv", "turn", "role", "body"), placed, F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")), "left")
    rows = rows.withColumn("root", F.coalesce("root", "turn")).withColumn("depth", F.coalesce("depth", F.lit(0).cast("long"))).drop("c", "t")

    # Positions: numbered within parts of threads, from where the parts before end. Neither a conversation nor a thread
    # is sorted as a whole: sums run over its parts, first within blocks of roots, then over the blocks.
    rows = written(rows.withColumn("block", F.floor(F.col("root") / BLOCK)).withColumn("part", F.floor(F.col("turn") / BLOCK)), "chat-rows")
    parts = written(rows.groupBy("conv", "block", "root", "part").agg(F.count("*").alias("n")), "chat-parts")
    upto = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = parts.groupBy("conv", "block").agg(F.sum("n").alias("n")).withColumn("outer", upto(["conv"], ["block"])).select(F.col("conv").alias("c"), F.col("block").alias("b"), "outer")
    parts = parts.withColumn("inner", upto(["conv", "block"], ["root", "part"]))
    parts = parts.join(blocks, F.col("conv").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")))
    parts = parts.select(F.col("conv").alias("c"), F.col("root").alias("r"), F.col("part").alias("p"), (F.col("inner") + F.col("outer")).alias("before"))
    number = F.row_number().over(Window.partitionBy("conv", "root", "part").orderBy("turn", "role", "body")) - 1
    rows = rows.withColumn("number", number).join(parts, F.col("conv").eqNullSafe(F.col("c")) & F.col("root").eqNullSafe(F.col("r")) & F.col("part").eqNullSafe(F.col("p")))
    return rows.select(
        F.col("conv").alias("conv_id"),
        "turn",
        "role",
        F.col("body").alias("text"),
        "reply_to_conv",
        "reply_to",
        F.col("root").alias("root_turn"),
        "depth",
        (F.col("number") + F.col("before")).cast("long").alias("position"),
    )
