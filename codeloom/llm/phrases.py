"""Phrases mined from texts by counting their longest windows only.

Each word occurrence gives one row, its window of ``WORDS`` words: the word and the
columns that lead it, padded with nulls at the end of a piece. Windows are counted
once; Spark's ROLLUP over their columns then sums the counts of the successively
shorter prefixes, which are the counts of all shorter phrases.

No phrase that is looked for, and no part of one, is rarer than the least count. So
passes before count words, pairs and triples in hashed slots, and windows are padded
also from where a slot has fewer: most of them then have a word or two. The slots only
save work. Different phrases may share a slot, which leaves a window longer than need
be; every count that matters is exact, whatever the number of slots. They save little
where a slot holds more than the least count on average; a larger corpus should have
a larger least count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.skew import lookup
from codeloom.session import stage

# Words of a longest window, least count of a phrase, and the share (in percent) of its
# occurrences which a longer phrase must cover for the shorter one to go.
WORDS, LEAST, COVERED = 4, 30, 80
SCALE = 2_000_000
TOP = 2_000
# Slots of a count: one for so many bytes of text, within bounds. Tasks read a bitmap
# of an eighth as many bytes, so at most 32 MB.
SLOT_BYTES, MIN_SLOTS, MAX_SLOTS = 16, 1 << 24, 1 << 28
# Bytes of text that a task works on at once, and those of a row of words; a piece
# that is longer stays whole.
HELD_BYTES, ROW_BYTES = 2_000_000, 1_000_000
# Slots of a block, the unit in which counts are added up.
BLOCK = 1 << 16
# Parts of a language that are ranked by themselves first.
RANK_PARTS = 64
UNKNOWN = "und"
# Letters that are lowered, marks that end a piece, blanks between words.
_TABLE = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + b".,;:!?\x0b\x0c\r" + b"\t",
    b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ",
)
# What a byte is after that: 1 a blank, 2 the end of a piece, 3 that of a text; else of a word.
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 10, 13]] = 1, 2, 3
# Weights of a byte and of its place in a word, for hashes of words.
_draw = np.random.default_rng(12)
_BYTE = _draw.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_PLACE = _draw.integers(1, 1 << 63, 1 << 12, np.uint64) | np.uint64(1)


class Words:
    """The words of some texts: their bytes in a row, and for each word its hash, text
    and piece."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        self.langs = langs
        raw = np.frombuffer(b"\r".join(texts), np.uint8)
        kind = _KIND[raw]
        inside = kind == 0
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        first = np.flatnonzero(edge == 1)
        lengths = np.flatnonzero(edge == -1) - first
        self.bytes = raw[inside]
        self.offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        self.piece = np.cumsum(kind >= 2)[first]
        self.text = np.cumsum(kind == 3)[first]
        of_lang = {x: xxhash.xxh64_intdigest(x.encode()) for x in set(langs)}
        lang = np.array([of_lang[x] for x in langs], np.uint64)[self.text]
        place = np.arange(len(self.bytes), dtype=np.int32) - np.repeat(self.offsets[:-1], lengths)
        weighted = _BYTE[self.bytes] * _PLACE[place & (len(_PLACE) - 1)]
        self.hash = (np.add.reduceat(weighted, self.offsets[:-1]) if len(first) else weighted) + lang
        self.mixed = self.hash  # of the phrases of the length looked at last

    def start(self) -> np.ndarray:
        """Where phrases of one word start."""
        self.mixed = self.hash
        return np.ones(len(self.hash), bool)

    def longer(self, found: np.ndarray) -> np.ndarray:
        """Where those of one word more can start: at phrases of a piece that follow
        each other."""
        mixed = self.mixed * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed[:-1] ^= self.mixed[1:]
        self.mixed = mixed
        out = found.copy()
        out[:-1] &= found[1:] & (self.piece[:-1] == self.piece[1:])
        out[-1:] = False
        return out

    def slots(self, found: np.ndarray, slots: int) -> np.ndarray:
        own = self.mixed[found] * np.uint64(0xBF58476D1CE4E5B9)
        return ((own ^ own >> np.uint64(31)) % np.uint64(slots)).astype(np.int64)

    def frequent(self, found: np.ndarray, bitmap: bytes, slots: int) -> np.ndarray:
        """Those of the phrases whose slot is frequent."""
        own = self.slots(found, slots)
        out = found.copy()
        out[found] = np.frombuffer(bitmap, np.uint8)[own >> 3] >> (own & 7).astype(np.uint8) & 1
        return out


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    langs, texts, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            # bytes that are not UTF-8 become U+FFFD, so that words are strings again later
            text, at = text.decode("utf-8", "replace").encode().translate(_TABLE), 0
            while at < len(text):
                end = len(text)
                if end - at > ROW_BYTES:  # between two pieces
                    end = text.rfind(b"\n", at, at + ROW_BYTES) + 1 or text.find(b"\n", at) + 1 or end
                langs.append(lang)
                texts.append(text[at:end])
                size, at = size + end - at, end
                if size >= HELD_BYTES:
                    yield Words(langs, texts)
                    langs, texts, size = [], [], 0
    if texts:
        yield Words(langs, texts)


def _phrases(words: Words, bitmaps: list[bytes], slots: int) -> Iterator[np.ndarray]:
    """Where phrases of 1, 2, .. words start that all bitmaps so far leave: the first
    bitmap is for one and two words, each further one for a word more."""
    found = words.start()
    for bitmap in [bitmaps[0], *bitmaps]:
        found = words.frequent(found, bitmap, slots)
        yield found
        found = words.longer(found)
    yield found


def frequent_slots(
    texts: DataFrame, least: int, slots: int, bitmaps: list[bytes]
) -> bytes:
    """A bitmap of the slots that hold ``least`` phrases or more, of one and two words
    where there is no bitmap yet, else of one word more than those for which there is.

    Tasks count what they hold and file the counts by block of slots; a block's counts
    are added up as they stream in. Only the bitmap comes to the driver, ``slots / 8``
    bytes, whatever the size of the data.
    """
    shared = texts.sparkSession.sparkContext.broadcast(bitmaps)
    number = np.min_scalar_type(least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _held(batches):
            if shared.value:
                *_, found = _phrases(words, shared.value, slots)
                own = words.slots(found, slots)
            else:
                singles = words.start()
                own = words.slots(singles, slots)
                own = np.concatenate([own, words.slots(words.longer(singles), slots)])
            slot, n = np.unique(own, return_counts=True)
            n = np.minimum(n, least).astype(number)
            cuts = np.flatnonzero(np.diff(slot // BLOCK, prepend=-1))
            ends = [*cuts[1:].tolist(), len(slot)]
            low = (slot % BLOCK).astype(np.uint16)
            parts = list(zip(cuts.tolist(), ends, strict=True)) if len(slot) else []
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(slot[i]) // BLOCK for i, _ in parts], pa.int32()),
                    pa.array([low[i:j].tobytes() for i, j in parts], pa.binary()),
                    pa.array([n[i:j].tobytes() for i, j in parts], pa.binary()),
                ],
                names=["block", "slot", "n"],
            )

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCK, np.int64)
        for batch in batches:
            for slot, n in zip(batch.column("slot").to_pylist(), batch.column("n").to_pylist(), strict=True):
                total[np.frombuffer(slot, np.uint16)] += np.frombuffer(n, number)
        bits = np.packbits(total >= least, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([bits])], names=["block", "bits"])

    counts = texts.mapInArrow(count, "block int, slot binary, n binary")
    out = bytearray(-(-slots // BLOCK) * (BLOCK // 8))
    for part in counts.groupBy("block").applyInArrow(add, "block int, bits binary").collect():
        at = part["block"] * (BLOCK // 8)
        out[at : at + BLOCK // 8] = part["bits"]
    return bytes(out)


def word_rows(texts: DataFrame, bitmaps: list[bytes], slots: int, size: int = WORDS) -> DataFrame:
    """``lang, words, lengths``: the words of a text, or of some pieces of it, and how long
    the window at each is: it ends with the piece, and before a phrase that is too rare.
    A word of length zero is too rare itself, and null."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmaps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _held(batches):
            length = np.zeros(len(words.hash), np.int8)
            for m, found in enumerate(_phrases(words, shared.value, slots), 1):
                if m <= size:
                    length[found] = m
            values = pa.BinaryArray.from_buffers(
                pa.binary(), len(length), [None, pa.py_buffer(words.offsets), pa.py_buffer(words.bytes)]
            )
            values = pa.compute.if_else(pa.array(length > 0), values, pa.scalar(None, pa.binary())).cast(pa.string())
            ends = np.searchsorted(words.text, np.arange(len(words.langs)), side="right")
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(words.langs, pa.string()),
                    pa.ListArray.from_arrays(offsets, values),
                    pa.ListArray.from_arrays(offsets, pa.array(length)),
                ],
                names=["lang", "words", "lengths"],
            )

    return texts.mapInArrow(run, "lang string, words array<string>, lengths array<tinyint>")


def windows(rows: DataFrame, size: int = WORDS) -> DataFrame:
    """``lang, w1 .. w<size>``: a row per word, with the words that follow it as lead
    columns, padded with nulls beyond the length of its window."""
    lead = [F.slice("words", F.lit(k), F.size("words")).alias(f"w{k}") for k in range(1, size + 1)]
    zipped = rows.select("lang", F.inline(F.arrays_zip(F.col("lengths").alias("length"), *lead)))
    return zipped.select(
        "lang", *[F.when(F.col("length") >= k, F.col(f"w{k}")).alias(f"w{k}") for k in range(1, size + 1)]
    )


def prefix_counts(counted: DataFrame, least: int, size: int = WORDS) -> DataFrame:
    """``lang, m, phrase, f`` of the phrases of one to ``size`` words with ``f >= least``,
    and of the empty phrase of each language, whose ``f`` counts all its words.

    ``counted`` has ``lang, w1 .. w<size>, c``: windows and their number. ROLLUP adds up
    the windows of each prefix; a row whose last grouped column is padding is no phrase.
    """
    columns = [f"w{k}" for k in range(1, size + 1)]
    rolled = counted.rollup("lang", *columns).agg(
        F.sum("c").alias("f"), F.grouping_id().alias("level")
    )
    # the identifier has a bit for each column that is rolled up, from the last one on
    lengths = {(1 << (size - m)) - 1: m for m in range(size + 1)}
    m = F.create_map(*[F.lit(x) for pair in lengths.items() for x in pair])[F.col("level").cast("int")]
    words = F.array(*columns)
    return (
        rolled.withColumn("m", m)
        .filter(F.col("m").isNotNull())
        .filter((F.col("m") == 0) | F.get(words, F.col("m") - 1).isNotNull())
        .filter((F.col("m") == 0) | (F.col("f") >= least))
        .select("lang", "m", F.concat_ws(" ", words).alias("phrase"), "f")
    )


def _wide(number: Column) -> Column:
    """Products of counts may pass 64 bits."""
    return number.cast("decimal(20,0)")


def _scores(found: DataFrame, size: int) -> DataFrame:
    """``lang, phrase, a, l, r, score`` by the lowest-scoring cut of each phrase."""
    parts = F.split("phrase", " ")
    cuts = (
        found.filter(F.col("m") >= 2)
        .select("lang", "phrase", "m", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
        .withColumn("left", F.array_join(F.slice(parts, F.lit(1), F.col("k")), " "))
        .withColumn("right", F.array_join(F.slice(parts, F.col("k") + 1, F.col("m") - F.col("k")), " "))
    )
    single = found.filter(F.col("m").between(1, size - 1))
    # a frequent first or last word is in very many phrases: its rows are spread
    for side, count in (("left", "l"), ("right", "r")):
        other = single.select("lang", F.col("phrase").alias(side), F.col("f").alias(count))
        cuts = stage(lookup(cuts, other, ["lang", side], ["lang", "phrase", "k"]), f"phrases-{side}")
    cuts = cuts.withColumn("a20", _wide(F.col("a"))).withColumn("lr", _wide(F.col("l")) + _wide(F.col("r")))
    score = F.expr(f"(a20 * cast({SCALE} as decimal(8,0))) div lr")
    best = cuts.groupBy("lang", "phrase", "m", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "m", "a", "cut.l", "cut.r", "cut.score")


def _covered(found: DataFrame, covered: int, size: int) -> DataFrame:
    """``lang, phrase, most``: the largest count of a longer phrase around each phrase."""
    m, parts = F.col("m"), F.split("phrase", " ")
    places = F.flatten(
        F.transform(
            F.sequence(F.lit(2), m - 1),
            lambda n: F.transform(F.sequence(F.lit(1), m - n + 1), lambda at: F.array_join(F.slice(parts, at, n), " ")),
        )
    )
    return (
        found.filter((m >= 3) & (m <= size))
        .select("lang", F.explode(places).alias("phrase"), "f")
        .groupBy("lang", "phrase")
        .agg(F.max("f").alias("most"))
    )


def mine(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST,
    covered: int = COVERED, top: int = TOP, size: int = WORDS, slots: int | None = None,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases.

    A-Z are lowered; marks and line ends cut texts into pieces, blanks and tabs cut
    those into words. ``a`` counts a phrase of 2 to ``size`` words, ``l`` and ``r`` its
    parts at the lowest-scoring cut (of equal ones, the first), ``n`` the language's
    words; the score is ``2,000,000 * a / (l + r)``, rounded down. Phrases rarer than
    ``least`` are not looked at; one that lies in a longer phrase with at least
    ``covered`` percent of its count goes. Of the rest each language has its first
    ``top`` rows, by score, count and the bytes of the phrase.

    A null text has no words, a null language is ``und``; repeated rows count again,
    other columns are not read; an empty table gives no rows.
    """
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )
    if slots is None:
        size_of_texts = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        slots = min(MAX_SLOTS, max(MIN_SLOTS, 1 << (size_of_texts // SLOT_BYTES).bit_length()))
    bitmaps: list[bytes] = []
    for _ in range(max(1, size - 2)):
        bitmaps.append(frequent_slots(texts, least, slots, bitmaps))
    columns = [f"w{k}" for k in range(1, size + 1)]
    rows = word_rows(texts, bitmaps, slots, size)
    counted = windows(rows, size).groupBy("lang", *columns).agg(F.count("*").alias("c"))
    found = stage(prefix_counts(stage(counted, "phrases-windows"), least, size), "phrases-found")
    kept = (
        _scores(found, size)
        .join(_covered(found, covered, size), ["lang", "phrase"], "left")
        .filter(
            F.col("most").isNull() | (_wide(F.col("most")) * 100 < _wide(F.col("a")) * covered)
        )
    )
    # the best of each part first, so that no language comes to one task as a whole
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    for keys in (["lang", part], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        kept = kept.withColumn("rank", rank).filter(F.col("rank") <= top)
    ranked = kept
    words = found.filter("m = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
