"""Benchmark decontamination by a prefix-filtered set join.

A window is a run of consecutive words of a benchmark item; a document contains it
where the same words follow each other. Word pairs are the shingles. All shingles
of a window must occur for the window to occur, so the join needs one of them: the
prefix of the rarity order, that is the window's rarest pair by its count over all
documents. Where it occurs, its place in the window bounds where the window can
start and end, and the words there are compared in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import id_and_text
from codeloom.session import stage

# Windows that a task holds at once. A larger benchmark is worked off in blocks.
BLOCK_WINDOWS = 50_000
# Candidate starts compared, and words counted, at once.
_CANDIDATES = 100_000
_WORDS = 1_000_000

# Letters A-Z become lower case; ASCII characters that are no digit or letter separate words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def item_windows(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, words``: each distinct window of an item, the words space-joined.

    An item of fewer words than ``size`` is one window; a null or wordless one has none.
    Windows of items without an id have a null ``item_id``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, windows = [], []
            for item, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                starts = range(max(1, len(words) - size + 1)) if words else ()
                own = sorted({b" ".join(words[i : i + size]) for i in starts})
                ids += [item] * len(own)
                windows += own
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(windows, pa.binary())], names=["item_id", "words"]
            )

    texts = id_and_text(items, id_col, text_col).withColumn("id", F.col("id").cast("string"))
    return texts.mapInArrow(run, "item_id string, words binary").distinct()


@dataclass
class Block:
    """Windows in the form that tasks compare: words as numbers, 0 for all others."""

    number: dict[bytes, int]
    pairs: np.ndarray  # pair codes of the windows, sorted
    length: np.ndarray  # words per window
    words: np.ndarray  # window x size, 0 behind the end
    items: list[list[str | None]]  # item ids per window
    prefix: np.ndarray | None = None  # sorted pair codes that are some window's prefix
    first: np.ndarray | None = None  # where a code's windows begin in ``window``
    window: np.ndarray | None = None
    place: np.ndarray | None = None  # the pair's place in that window

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, 0) for w in words], np.int64)

    def codes(self, numbers: np.ndarray) -> np.ndarray:
        """The pair that starts at each word; 0 where a word is in no window.

        A window of one word is looked up by that word, as a pair with nothing.
        """
        following = np.append(numbers[1:], 0)
        both = numbers * np.int64(len(self.number) + 1) + following
        return np.where((numbers > 0) & (following > 0), both, 0)

    def singles(self, numbers: np.ndarray) -> np.ndarray:
        return numbers * np.int64(len(self.number) + 1)

    def shingles(self, numbers: np.ndarray) -> list[np.ndarray]:
        if (self.length == 1).any():
            return [self.codes(numbers), self.singles(numbers)]
        return [self.codes(numbers)]


def _block(rows: list, size: int) -> Block:
    by_words: dict[bytes, list[str | None]] = {}
    for row in rows:
        by_words.setdefault(bytes(row["words"]), []).append(row["item_id"])
    windows = [w.split(b" ") for w in by_words]
    vocabulary = sorted({w for words in windows for w in words})
    number = {w: i + 1 for i, w in enumerate(vocabulary)}
    words = np.zeros((len(windows), size), np.int64)
    for i, own in enumerate(windows):
        words[i, : len(own)] = [number[w] for w in own]
    block = Block(
        number, np.zeros(0, np.int64), np.array([len(w) for w in windows], np.int64), words,
        list(by_words.values()),
    )
    block.pairs = np.unique(np.concatenate([_window_codes(block, i) for i in range(len(windows))]))
    return block


def _window_codes(block: Block, i: int) -> np.ndarray:
    own = block.words[i, : block.length[i]]
    return block.codes(own)[:-1] if len(own) > 1 else block.singles(own)


def _count_pairs(texts: DataFrame, block: Block) -> dict[int, int]:
    """How often each pair of the block occurs in all documents: the rarity order."""
    shared = texts.sparkSession.sparkContext.broadcast(block)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        own, parts, size = shared.value, [], 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                numbers = np.append(own.numbers(words_of(text)), 0)  # 0 parts the documents
                parts.append(numbers)
                size += len(numbers)
                if size > _WORDS:
                    yield np.concatenate(parts)
                    parts, size = [], 0
        if parts:
            yield np.concatenate(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros(len(own.pairs), np.int64)
        for numbers in joined(batches):
            for codes in own.shingles(numbers):
                codes = codes[codes > 0]
                at = np.minimum(np.searchsorted(own.pairs, codes), len(own.pairs) - 1)
                total += np.bincount(at[own.pairs[at] == codes], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(own.pairs[seen]), pa.array(total[seen])], names=["pair", "n"]
        )

    counted = texts.mapInArrow(run, "pair long, n long")
    # at most one row per pair of the block
    counted = counted.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(counted.column("pair").to_pylist(), counted.column("n").to_pylist()))


def _index(block: Block, counts: dict[int, int]) -> None:
    """Files every window under its rarest pair (ties: the smallest code)."""
    entries = []
    for i in range(len(block.length)):
        codes = _window_codes(block, i).tolist()
        _, code, place = min((counts.get(c, 0), c, k) for k, c in enumerate(codes))
        if counts.get(code, 0):  # a pair that no document has leaves nothing to find
            entries.append((code, i, place))
    table = np.array(sorted(entries), np.int64).reshape(-1, 3)
    block.prefix, block.first = np.unique(table[:, 0], return_index=True)
    block.first = np.append(block.first, len(table))
    block.window, block.place = table[:, 1], table[:, 2]


def hits(block: Block, words: list[bytes]) -> tuple[np.ndarray, set[str | None]]:
    """Which words lie in an occurrence of a window, and the items of those windows."""
    total = len(words)
    edge, items = np.zeros(total + 1, np.int64), set()
    if not total or not len(block.prefix):
        return np.zeros(total, bool), items
    numbers = block.numbers(words)
    for codes in block.shingles(numbers):
        at = np.minimum(np.searchsorted(block.prefix, codes), len(block.prefix) - 1)
        found = np.flatnonzero((block.prefix[at] == codes) & (codes > 0))
        entry = at[found]
        count = block.first[entry + 1] - block.first[entry]
        ends = np.cumsum(count)
        low = 0
        while low < len(found):
            # as many places as give a bounded number of candidates
            base = ends[low] - count[low]
            high = max(low + 1, int(np.searchsorted(ends, base + _CANDIDATES, "right")))
            some = np.arange(low, high)
            n = count[some]
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row = np.repeat(block.first[entry[some]], n) + offset
            window = block.window[row]
            start = np.repeat(found[some], n) - block.place[row]
            inside = (start >= 0) & (start + block.length[window] <= total)
            window, start = window[inside], start[inside]
            wanted = block.words[window]
            columns = np.arange(wanted.shape[1])
            there = numbers[np.minimum(start[:, None] + columns, total - 1)]
            same = ((there == wanted) | (columns >= block.length[window][:, None])).all(axis=1)
            window, start = window[same], start[same]
            np.add.at(edge, start, 1)
            np.add.at(edge, start + block.length[window], -1)
            for i in np.unique(window).tolist():
                items.update(block.items[i])
            low = high
    return np.cumsum(edge[:-1]) > 0, items


class Decontamination:
    """Windows of a benchmark, indexed by rarity over a document table.

    Two narrow passes over the documents and no shuffle of them: the first counts
    the word pairs of the windows, the second looks the windows up. What tasks hold
    is a block of at most ``block_windows`` windows (about 20 MB); further blocks
    are further steps of the second pass.
    """

    def __init__(
        self, docs: DataFrame, items: DataFrame, size: int = 10, block_windows: int = BLOCK_WINDOWS,
        text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    ):
        self.spark: SparkSession = docs.sparkSession
        self.text_col = text_col
        windows = item_windows(items, size, item_id, item_text)
        n_blocks = -(-windows.count() // block_windows)
        windows = windows.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(max(1, n_blocks))))
        if n_blocks > 1:
            windows = stage(windows, "benchmark-windows")
        texts = docs.select(F.col(text_col).cast("binary").alias("text"))
        self.blocks = []
        for b in range(n_blocks):
            rows = windows.filter(F.col("block") == b).collect()
            if rows:
                block = _block(rows, size)
                _index(block, _count_pairs(texts, block))
                self.blocks.append(self.spark.sparkContext.broadcast(block))

    def _finder(self):
        blocks = self.blocks

        def find(text: bytes | None) -> tuple[int, int, list[str], int]:
            words = words_of(text)
            hit, items = np.zeros(len(words), bool), set()
            for block in blocks:
                own, found = hits(block.value, words)
                hit |= own
                items |= found
            return len(words), int(hit.sum()), sorted(items - {None}), len(items)

        return find

    def report(self, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """``id, n_words, n_hit, item_ids, items_sha256, n_items`` per row; a null text has
        no words.

        Words in a window of an item with a null id are hit like any other; the null id
        is not in ``item_ids`` or the digest, but counts as one item in ``n_items``.
        """
        find = self._finder()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [find(text) for text in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        pa.array([f[0] for f in found], pa.int64()),
                        pa.array([f[1] for f in found], pa.int64()),
                        pa.array([f[2] for f in found], pa.list_(pa.string())),
                        pa.array([hashlib.sha256(",".join(f[2]).encode()).hexdigest() for f in found], pa.string()),
                        pa.array([f[3] for f in found], pa.int64()),
                    ],
                    names=["id", "n_words", "n_hit", "item_ids", "items_sha256", "n_items"],
                )

        texts = id_and_text(docs, id_col, self.text_col)
        kind = texts.schema["id"].dataType.simpleString()
        return texts.mapInArrow(
            run, f"id {kind}, n_words long, n_hit long, item_ids array<string>, items_sha256 string, "
            "n_items long",
        )

    def clean(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` without any occurrence of a window, be its item's id null
        or not, columns as they are."""
        find, at = self._finder(), docs.columns.index(self.text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(at).cast(pa.binary()).to_pylist()
                yield batch.filter(pa.array([find(t)[1] == 0 for t in texts], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
