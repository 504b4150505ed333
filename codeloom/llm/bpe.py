"""Byte-level BPE encoding and decoding with a segment tree per word.

A text is cut into words by the vocabulary's pattern. A word that is a token is that
token; in any other one a segment tree over its byte positions holds the rank of the
pair that starts there, and at its root the leftmost pair of the lowest rank. Its nodes
have many children, so that the tree of a usual word is one level. A merge
changes three positions (the pair, the byte it swallows, the live neighbour before),
so each costs a walk of logarithmic length, also in a word of many megabytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import id_and_text, map_texts

# Words whose ids a Python worker remembers, and the longest such word in characters:
# together they bound its memory. What is forgotten is encoded anew.
MEMORY_WORDS, MEMORY_CHARS = 200_000, 64
# Children of a node of the tree: a minimum of so many numbers takes one call.
FAN_OUT = 32
# Long texts are cut into words in parts of so many characters, at places where the
# pattern cuts them anyway.
PART_CHARS = 1_000_000
CUT = regex.compile(r"(?<=\S) (?=\S)")

_encoders: dict[tuple[str, str], Encoder] = {}
_decoders: dict[str, list[bytes | None]] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks: a line has a token in Base64 and its rank."""
    with open(path, "rb") as file:
        pairs = (line.split() for line in file if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def merge(word: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """The ids of a word that is no token itself.

    Leaf ``i`` of the tree is ``rank << bits | i`` for the pair that starts at byte
    ``i``, so that a minimum is the lowest rank and, of equal ones, the leftmost.
    Positions that a merge has swallowed, and pairs that are no token, hold ``none``.
    A node has FAN_OUT children, and the last level is the root's. ``longest`` is the
    longest token's length, which bounds what is looked up.
    """
    n, get = len(word), ranks.get
    if n == 1:
        return [ranks[word]]
    last = n - 1  # no pair starts at the last byte
    bits = n.bit_length()
    none, mask = 1 << (bits + 40), (1 << bits) - 1
    leaves = [none if (rank := get(word[i : i + 2])) is None else rank << bits | i for i in range(last)]
    top, levels = leaves, []
    while len(top) > FAN_OUT:
        below, top = top, [min(top[at : at + FAN_OUT]) for at in range(0, len(top), FAN_OUT)]
        levels.append((below, top))
    after = list(range(1, n + 1))  # start of the next live part; n behind the last one
    before = list(range(-1, n))
    while (least := min(top)) != none:
        i = least & mask
        gone, start = after[i], before[i]
        end = after[i] = after[gone]
        before[end] = i
        # the swallowed byte starts no pair any more, the merged part and its neighbour
        # before start others
        if gone < last:
            leaves[gone] = none
        leaves[i] = none
        if end < n and (stop := after[end]) - i <= longest and (rank := get(word[i:stop])) is not None:
            leaves[i] = rank << bits | i
        if start >= 0:
            leaves[start] = none
            if end - start <= longest and (rank := get(word[start:end])) is not None:
                leaves[start] = rank << bits | start
        if levels:
            changed = {max(start, 0), i, min(gone, last - 1)}
            for below, above in levels:
                changed = {at // FAN_OUT for at in changed}
                for at in changed:
                    above[at] = min(below[at * FAN_OUT : (at + 1) * FAN_OUT])
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : after[i]]])
        i = after[i]
    return ids


class Encoder(dict):
    """Texts to ids, by the ranks of a file. As a dictionary it maps words to their ids
    and remembers at most ``MEMORY_WORDS`` of them, half of them in ``older``: when the
    newer half is full the older one is forgotten, but for what has been met since."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.ranks = read_ranks(path)
        self.longest = max(map(len, self.ranks))
        self.pattern = regex.compile(pattern)

    @classmethod
    def of(cls, path: str, pattern: str) -> Encoder:
        if (path, pattern) not in _encoders:
            _encoders[path, pattern] = cls(path, pattern)
        return _encoders[path, pattern]

    def __missing__(self, text: str) -> bytes:
        out = self.older.get(text)
        if out is None:
            raw = text.encode("utf-8")
            whole = self.ranks.get(raw)
            ids = [whole] if whole is not None else merge(raw, self.ranks, self.longest)
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(text) <= MEMORY_CHARS:
            if 2 * len(self) >= MEMORY_WORDS:
                self.older = dict(self)
                self.clear()
            self[text] = out
        return out

    def encode(self, text: bytes | None) -> bytes:
        """Little-endian 32-bit ids of a whole text; none for null."""
        whole = (text or b"").decode("utf-8", "replace")
        parts, at = [], 0
        while at < len(whole):
            # a space between two other characters always starts a word
            cut = CUT.search(whole, at + PART_CHARS)
            end = cut.start() if cut else len(whole)
            parts.append(b"".join(map(self.__getitem__, self.pattern.findall(whole, at, end))))
            at = end
        return b"".join(parts)


def encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, ids`` for each row of ``docs``, where it lies: nothing is shuffled.

    ``ids`` are little-endian unsigned 32-bit token ids of the whole text, without
    special tokens. A null text is an empty one and has no ids; repeated rows and null
    ids stay rows of their own; bytes that are not UTF-8 are read as U+FFFD. ``path``
    must be a file that all executors can open; ``pattern`` must start a word at every
    single space between two other characters, as these patterns do.
    """

    def one(text: bytes | None) -> tuple:
        return (Encoder.of(path, pattern).encode(text),)

    return map_texts(
        id_and_text(docs, id_col, text_col), one, {"ids": "binary"}, pa.schema([("ids", pa.binary())])
    )


def decode_ids(ids: bytes, tokens: list[bytes | None]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (any columns, among them ``ids``) with ``decoded``, the bytes that the
    ids stand for; null ids give null. An id that the file lacks is an error."""

    def tokens() -> list[bytes | None]:
        if path not in _decoders:
            ranks = read_ranks(path)
            table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
            for token, rank in ranks.items():
                table[rank] = token
            _decoders[path] = table
        return _decoders[path]

    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(at).to_pylist()
            decoded = [None if ids is None else decode_ids(ids, tokens()) for ids in own]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(decoded, pa.binary())], names=[*batch.schema.names, "decoded"]
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields]
    return encoded.mapInArrow(run, ", ".join([*fields, "decoded binary"]))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encoded, then decoded."""
    return decode(encode(docs, path, pattern), path).select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
