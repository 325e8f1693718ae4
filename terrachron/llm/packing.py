"""Packing of documents into training sequences by best-fit decreasing.

Overlong documents are cut into full windows first; the remainders go, longest
first, into the tightest open window that still holds them, found by a segment
tree over remaining capacities. Each task packs its own share of the pieces, so
that a sequence never spans tasks; a share leaves a few unfilled windows at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from terrachron.llm import bpe, common

WINDOW = 2048
#: Id written after each document.
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class OpenWindows:
    """Open windows by remaining capacity; each tree node tells whether any lies below it."""

    def __init__(self, window: int):
        self.width = 1 << window.bit_length()
        self.count = [0] * (2 * self.width)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def push(self, capacity: int, sequence: int) -> None:
        self.stacks[capacity].append(sequence)
        node = capacity + self.width
        while node:
            self.count[node] += 1
            node >>= 1

    def tightest(self, length: int) -> int:
        """Smallest capacity of at least ``length`` with an open window, or -1."""
        node = length + self.width
        if self.count[node]:
            return length
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.width
            node >>= 1
        return -1

    def pop(self, capacity: int) -> int:
        node = capacity + self.width
        while node:
            self.count[node] -= 1
            node >>= 1
        return self.stacks[capacity].pop()


def best_fit(lengths: list[int], window: int, open_: OpenWindows | None = None, used: int = 0) -> tuple[list[int], list[int], int]:
    """Sequence and offset of each piece, and the number of sequences; lengths must not rise.

    A share can come in parts: ``open_`` and ``used`` are what earlier parts left."""
    open_, sequences, offsets = open_ or OpenWindows(window), [], []
    for length in lengths:
        capacity = open_.tightest(length)
        if capacity < 0:
            capacity, sequence, used = window, used, used + 1
        else:
            sequence = open_.pop(capacity)
        sequences.append(sequence)
        offsets.append(window - capacity)
        if capacity > length:
            open_.push(capacity - length, sequence)
    return sequences, offsets, used


def cut(docs: DataFrame, vocabulary: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``window`` ids: full windows and one remainder for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(bpe.read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.Encoder(shared.value)
        for part in common.slices(batches):
            ids, sizes, _ = encoder.encode(part.column("text").to_pylist())
            rows: list[list] = [[] for _ in range(5)]
            begin = 0
            for doc, n in zip(part.column("doc_id").to_pylist(), sizes.tolist()):
                own = np.append(ids[begin : begin + n], END_ID).astype("<u4")
                begin += n
                for start in range(0, n + 1, window):
                    piece = own[start : start + window]
                    for column, value in zip(rows, (doc, start, len(piece), zlib.crc32(piece.tobytes()), n + 1)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r, pa.int64()) for r in rows], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    return common.documents(docs, id_col, text_col).mapInArrow(run, PIECES)


def assign(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Place pieces: adds ``sequence_id`` and ``offset``.

    Pieces are dealt out by a hash of all their columns and packed longest first, ties by
    document and start. A task holds only its open windows, so a share of any size is packed
    as one. Sequence numbers are unique, not consecutive.
    """
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, open_, used = TaskContext.get().partitionId() << 40, OpenWindows(window), 0
        for batch in batches:
            sequences, offsets, used = best_fit(batch.column("length").to_pylist(), window, open_, used)
            arrays = [batch.column(c) for c in columns]
            arrays += [pa.array(np.array(sequences, np.int64) + first), pa.array(offsets, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "sequence_id", "offset"])

    dealt = pieces.select(*columns).repartition(*columns)
    ordered = dealt.sortWithinPartitions(dealt["length"].desc(), "doc_id", "start", "ids_crc32", "doc_tokens")
    return ordered.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents and where they lie: ``doc_id``, ``start``, ``length``,
    ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    A null or empty text is the end id alone. A document repeated as a row is packed
    each time. No document is dropped, and each id lies in one piece.
    """
    return assign(cut(docs, vocabulary, window, id_col, text_col), window)
