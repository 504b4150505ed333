"""Cost-balanced packing of tokenised documents into sequences.

The cost of a piece of n tokens is estimated as ``linear * n + quadratic * n * n``
(attention within the piece). Documents go, the longest first, to the sequence of
the lowest cost that has room for them; what fits nowhere whole is cut.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from codeloom.llm.common import id_and_text

CAPACITY = 2048
END_ID = 1
# Documents packed together: what a task holds besides an Arrow batch.
BLOCK_TOKENS = 4_000_000
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
# Fixed value: how byte-level vocabularies of this kind cut a text into words.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[str, Encoder] = {}


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable
    ones for themselves, the others, in order, for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranked(spec: dict) -> tiktoken.Encoding | None:
    """The file's merges for the faster library, which ranks merges by the id of their
    product; None for a file where that is not the order of the merges."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True)
    if model.get("type") != "BPE" or not plain or before.get("add_prefix_space") or spec.get("normalizer"):
        return None
    if model.get("dropout") or model.get("ignore_merges") or spec.get("truncation"):
        return None
    vocab, octet = model["vocab"], _byte_of()
    special = {t["content"] for t in spec.get("added_tokens", ())}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [vocab["".join(pair)] for pair in pairs]
    singles = [i for token, i in vocab.items() if len(token) == 1]
    if made != sorted(set(made)) or len(singles) != 256 or max(singles) > made[0]:
        return None
    ranks = {bytes(octet[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("packing", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids by the tokenizer file.

    Where the file allows it, its merges run in the faster of two libraries, which
    gives the same ids at a quarter of the time; a text that holds one of the file's
    special tokens always goes to the first.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        self.ranked = _ranked(spec)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        if self.ranked is None or any(token in text for token in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranked.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


def cost(length: int) -> float:
    return LINEAR * length + QUADRATIC * length * length


class Rooms:
    """Sequences by what room they have: a heap by cost for each room, and a tree over the
    rooms that holds the cheapest sequence below each node."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.none = (float("inf"), -1, 0)
        self.tree = [self.none] * (2 * self.size)
        self.heaps: dict[int, list[tuple[float, int]]] = {}

    def _update(self, room: int) -> None:
        heap = self.heaps[room]
        i, tree = self.size + room, self.tree
        tree[i] = (*heap[0], room) if heap else self.none
        while i > 1:
            i >>= 1
            left, right = tree[2 * i], tree[2 * i + 1]
            tree[i] = left if left < right else right

    def put(self, room: int, spent: float, sequence: int) -> None:
        heapq.heappush(self.heaps.setdefault(room, []), (spent, sequence))
        self._update(room)

    def take(self, length: int) -> tuple[float, int] | None:
        """The cheapest sequence with room for ``length``, which is taken out."""
        low, high, best, tree = self.size + length, 2 * self.size, self.none, self.tree
        while low < high:
            if low & 1:
                best, low = min(best, tree[low]), low + 1
            if high & 1:
                high -= 1
                best = min(best, tree[high])
            low, high = low >> 1, high >> 1
        if best[1] < 0:
            return None
        heapq.heappop(self.heaps[best[2]])
        self._update(best[2])
        return best[:2]


def assign(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """``(document, start, length, sequence, offset)`` of every piece.

    Full stretches of ``capacity`` tokens are sequences of their own. The rest of
    each document goes, in descending length, to the cheapest sequence with room,
    among as few as can hold all of it; a rest that fits nowhere whole fills what
    room there is. What is left over, less than one sequence in all, is laid in
    sequences of powers of two, which need no padding.
    """
    pieces, sequence = [], 0
    rests: list[tuple[int, int, int]] = []  # -length, document, start
    for doc, length in enumerate(lengths):
        start = 0
        while length - start >= capacity:
            pieces.append((doc, start, capacity, sequence, 0))
            sequence, start = sequence + 1, start + capacity
        if start < length:
            rests.append((start - length, doc, start))
    rests.sort()
    bins = -sum(r[0] for r in rests) // capacity
    used = [0] * bins
    rooms = Rooms(capacity)
    if bins:
        # all are empty and cost the same, so they need no order but their numbers
        rooms.heaps[capacity] = [(0.0, b) for b in range(bins)]
        rooms._update(capacity)
    over: list[tuple[int, int, int]] = []

    def put(doc: int, start: int, length: int, b: int) -> None:
        pieces.append((doc, start, length, sequence + b, used[b]))
        used[b] += length

    for negative, doc, start in rests:
        length = -negative
        found = rooms.take(length)
        if found is None:
            over.append((doc, start, length))
            continue
        spent, b = found
        put(doc, start, length, b)
        if used[b] < capacity:
            rooms.put(capacity - used[b], spent + cost(length), b)
    room = [b for b in range(bins) if used[b] < capacity]
    while over:
        doc, start, length = over.pop()
        while length and room:
            b = room[-1]
            part = min(length, capacity - used[b])
            put(doc, start, part, b)
            start, length = start + part, length - part
            if used[b] == capacity:
                room.pop()
        if length:
            over.append((doc, start, length))
            break
    sequence += bins
    left = sum(length for _, _, length in over)
    size = offset = 0
    for doc, start, length in over:
        while length:
            if offset == size:
                size, offset = 1 << (left.bit_length() - 1), 0
                sequence += 1
            part = min(length, size - offset)
            pieces.append((doc, start, part, sequence - 1, offset))
            offset, start, length, left = offset + part, start + part, length - part, left - part
    return pieces


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id",
    text_col: str = "text", end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """``id, start, length, ids, doc_tokens, sequence_id, offset`` per piece.

    ``ids`` are the piece's little-endian 32-bit token ids, ready to be written. A
    null text is an empty one, whose document is ``end_id`` alone; rows of one id are
    packed as documents of their own. Documents are packed in blocks where the scan
    has put them, so no text or token is shuffled; each block fills its sequences.
    """

    def emit(sequence: int, ids: list, encoded: list[bytes]) -> tuple[pa.RecordBatch, int]:
        lengths = [len(e) // 4 for e in encoded]
        pieces = assign(lengths, capacity)
        last = max((p[3] for p in pieces), default=-1)
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array([ids[p[0]] for p in pieces], kind),
                pa.array([p[1] for p in pieces], pa.int64()),
                pa.array([p[2] for p in pieces], pa.int64()),
                pa.array([encoded[p[0]][4 * p[1] : 4 * (p[1] + p[2])] for p in pieces], pa.binary()),
                pa.array([lengths[p[0]] for p in pieces], pa.int64()),
                pa.array([sequence + p[3] for p in pieces], pa.int64()),
                pa.array([p[4] for p in pieces], pa.int64()),
            ],
            names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )
        return batch, sequence + last + 1

    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer_path)
        # the input split numbers the sequences, so a task that runs again gives the same
        sequence = TaskContext.get().partitionId() << 40
        ids, encoded, held = [], [], 0
        for batch in batches:
            own, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            for i, text in zip(own, texts, strict=True):
                ids.append(i)
                encoded.append(encoder.encode((text or b"").decode("utf-8", "replace")) + end)
                held += len(encoded[-1]) // 4
                if held >= block_tokens:
                    out, sequence = emit(sequence, ids, encoded)
                    yield out
                    ids, encoded, held = [], [], 0
        if ids:
            yield emit(sequence, ids, encoded)[0]

    texts = id_and_text(docs, id_col, text_col)
    id_type = texts.schema["id"].dataType
    kind = to_arrow_type(id_type)
    return texts.mapInArrow(
        run,
        f"id {id_type.simpleString()}, start long, length long, ids binary, doc_tokens long, "
        "sequence_id long, offset long",
    )


def ids_crc32():
    """The CRC-32 of a piece's ids, unsigned."""
    return F.crc32("ids")
