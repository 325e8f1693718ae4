"""Byte-level BPE by batched merge rounds.

All distinct chunks of a batch lie in one flat array of symbols. A round finds
the lowest-ranked pair of every chunk by binary search over the sorted pair keys,
merges all its occurrences at once, and closes the gaps; chunks without a known
pair leave. Chunks met before in a task are looked up, not encoded again.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from terrachron.llm import common

#: Fixed value: the split of text before merging, as published with the vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int32(2**31 - 1)
#: A chunk of more bytes is merged alone, by a heap, as its rounds would be many.
LONG_CHUNK = 2048
#: Chunks remembered by a task before it starts afresh; bounds memory, not results.
MEMORY_CHUNKS = 700_000
_TWO_BREAKS = re.compile(r"\s\s")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1
    characters stand for themselves, the others for code points from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in printable}
    others = (b for b in range(256) if b not in letters)
    letters.update({b: chr(256 + k) for k, b in enumerate(others)})
    return [letters[b] for b in range(256)]


def read_vocabulary(path: str) -> dict:
    """Arrays of a vocabulary file; of fixed size, so they may be broadcast."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    ids = model["model"]["vocab"]
    letters = byte_letters()
    byte_of = {c: b for b, c in enumerate(letters)}
    size = max([*ids.values(), *(t["id"] for t in model["added_tokens"])]) + 1
    tokens = [b""] * size
    for token, k in ids.items():
        tokens[k] = bytes(byte_of[c] for c in token)
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    for content, k in special.items():
        tokens[k] = content.encode()
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
    left = np.array([ids[a] for a, _ in merges], np.int64)
    right = np.array([ids[b] for _, b in merges], np.int64)
    made = np.array([ids[a + b] for a, b in merges], np.int32)
    keys = left * size + right
    order = np.argsort(keys, kind="stable")
    return {
        "size": size,
        "tokens": tokens,
        "special": special,
        "byte_ids": np.array([ids[c] for c in letters], np.int32),
        "keys": keys[order],
        "ranks": order.astype(np.int32),
        "made": made,
    }


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


class Encoder:
    """Encodes and decodes texts; remembers the chunks it has met."""

    def __init__(self, vocabulary: dict):
        self.__dict__.update(vocabulary)
        self.pattern = regex.compile(PATTERN)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.token_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.token_sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        left, right = np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)
        self.byte_ranks = self.rank(left, right)  # of pairs of bytes, which every first round asks for
        self.names = [b"%d" % k for k in range(self.size)]
        self.forget()

    def forget(self) -> None:
        self.known, self.pieces = Numbers(), Numbers()
        self.piece_ids = np.zeros(0, np.int32)
        self.piece_sizes = np.zeros(0, np.int64)
        self.piece_starts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.sizes = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.written: list[bytes] = []

    def write(self) -> list[bytes]:
        """The ids of each known chunk as text, with commas."""
        begin = len(self.written)
        ids, names = self.flat, self.names
        for b, n in zip(self.starts[begin:].tolist(), self.sizes[begin:].tolist()):
            self.written.append(b",".join([names[i] for i in ids[b : b + n].tolist()]))
        return self.written

    # pairs

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs by binary search; NONE where there is no such pair."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and how many each piece has."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = self.byte_ids[raw]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for k in np.flatnonzero(lengths > LONG_CHUNK):
            mine = owner == k
            ids = self.merge_alone(symbols[mine].tolist())
            done.append((np.full(len(ids), k), np.array(ids, np.int32)))
            raw, symbols, owner = raw[~mine], symbols[~mine], owner[~mine]
        ranks = np.full(len(symbols), NONE, np.int32)
        if len(symbols) > 1:
            inside = owner[:-1] == owner[1:]
            ranks[:-1] = np.where(inside, self.byte_ranks[raw[:-1].astype(np.int64) * 256 + raw[1:]], NONE)
        while len(symbols):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[first, len(owner)])
            lowest = np.minimum.reduceat(ranks, first)
            open_ = np.repeat(lowest != NONE, sizes)
            if not open_.all():
                done.append((owner[~open_], symbols[~open_]))
                keep = lowest != NONE
                sizes, lowest = sizes[keep], lowest[keep]
                symbols, owner, ranks = symbols[open_], owner[open_], ranks[open_]
                if not len(symbols):
                    break
            hit = ranks == np.repeat(lowest, sizes)
            at = np.flatnonzero(hit)
            if len(at) > 1:  # of pairs that overlap, as in "aaa", every second one counts
                near = np.r_[False, (np.diff(at) == 1) & (owner[at[1:]] == owner[at[:-1]])]
                run = np.maximum.accumulate(np.where(near, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbols[at] = self.made[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            at = np.cumsum(keep)[at] - 1  # where the merged symbols now are
            symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
            mark = np.zeros(len(symbols) + 1, bool)
            mark[at], mark[at - 1] = True, True  # -1 marks the spare place at the end
            ask = np.flatnonzero(mark[:-1])
            after = np.minimum(ask + 1, len(symbols) - 1)
            inside = (owner[ask] == owner[after]) & (after > ask)
            ranks[ask] = np.where(inside, self.rank(symbols[ask], symbols[after]), NONE)
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(pieces), np.int64)
        owner = np.concatenate([d[0] for d in done])
        order = np.argsort(owner, kind="stable")
        return np.concatenate([d[1] for d in done])[order], np.bincount(owner, minlength=len(pieces))

    def merge_alone(self, symbols: list[int]) -> list[int]:
        """The merges of one very long piece, by a heap of pairs over a linked list."""
        n = len(symbols)
        rank_of = {int(k): int(r) for k, r in zip(self.keys, self.ranks)}
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [
            (rank_of[key], i, key)
            for i in range(n - 1)
            if (key := symbols[i] * self.size + symbols[i + 1]) in rank_of
        ]
        heapq.heapify(heap)
        while heap:
            rank, i, key = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j < 0 or symbols[i] * self.size + symbols[j] != key:
                continue
            symbols[i], symbols[j] = int(self.made[rank]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0:
                    key = symbols[a] * self.size + symbols[after[a]]
                    if key in rank_of:
                        heapq.heappush(heap, (rank_of[key], a, key))
        return [s for s in symbols if s >= 0]

    # texts

    def number(self, text: str) -> list[int]:
        """Numbers of the chunks of a text. Chunks are encoded on their own and join to the text.

        A single space between other characters always starts a match of the pattern,
        so such a text may be cut there without searching for matches. A chunk that is a
        space and what follows is known by the latter, any other as a tuple.
        """
        known = self.known
        if self.cut and any(s in text for s in self.special):
            found = []
            for part in self.cut.split(text):
                found += [known[(part,)]] if part in self.special else self.number(part) if part else []
            return found
        if _TWO_BREAKS.search(text):
            return [known[(piece,)] for piece in self.pattern.findall(text)]
        head, *rest = text.split(" ")
        row = [known[(head,)]] if head else []
        row.extend(map(known.__getitem__, rest))
        return row

    def split(self, key: str | tuple[str]) -> list[str]:
        """Matches of the pattern in a chunk."""
        chunk = key[0] if isinstance(key, tuple) else " " + key
        if chunk in self.special or chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
            return [chunk]
        if chunk[0] == " " and chunk[-1] in ".,;:!?" and chunk[1:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.pattern.findall(chunk)

    def add(self, fresh: list[str | tuple[str]]) -> None:
        """Encode chunks not met before; merges only pieces not met before."""
        pieces, met = self.pieces, len(self.pieces)
        found = list(map(self.split, fresh))
        counts = np.array(list(map(len, found)), np.int64)
        which = np.array([pieces[p] for f in found for p in f], np.int64)
        distinct = list(itertools.islice(pieces, met, None))
        ids, sizes = self.merge([p.encode() for p in distinct])
        starts = np.cumsum(sizes) - sizes
        for content, token in self.special.items():
            k = pieces.get(content, -1) - met
            if k >= 0:  # only a chunk that is such a token as a whole is a piece of this form
                starts[k], sizes[k] = len(ids), 1
                ids = np.append(ids, np.int32(token))
        self.piece_starts = np.r_[self.piece_starts, starts + len(self.piece_ids)]
        self.piece_sizes = np.r_[self.piece_sizes, sizes]
        self.piece_ids = np.r_[self.piece_ids, ids]
        flat = self.piece_ids[spread(self.piece_starts[which], self.piece_sizes[which])]
        ends = np.r_[0, np.cumsum(self.piece_sizes[which])]
        own = np.diff(ends[np.r_[0, np.cumsum(counts)]])
        self.starts = np.r_[self.starts, np.cumsum(own) - own + len(self.flat)]
        self.sizes = np.r_[self.sizes, own]
        self.flat = np.r_[self.flat, flat]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """Ids of all texts in one array, how many each text has, and each text's chunk numbers."""
        if len(self.known) > MEMORY_CHUNKS:
            self.forget()
        known, met = self.known, len(self.known)
        rows = list(map(self.number, texts))
        if len(known) > met:
            self.add(list(itertools.islice(known, met, None)))
        which = np.fromiter(itertools.chain.from_iterable(rows), np.int64)
        sizes = self.sizes[which]
        ids = self.flat[spread(self.starts[which], sizes)]
        ends = np.cumsum([len(row) for row in rows])
        totals = np.r_[0, np.cumsum(sizes)]
        return ids, np.diff(np.r_[0, totals[ends]]) if len(rows) else np.zeros(0, np.int64), rows

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids."""
        return self.token_bytes[spread(self.token_starts[ids], self.token_sizes[ids])].tobytes()


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of consecutive runs, one after the other."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text: ``doc_id``, ``ids`` (array of int).

    A null or empty text has no ids. Repeated rows are encoded each. The vocabulary
    file is read on the driver and broadcast; its size does not depend on the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for part in common.slices(batches):
            ids, sizes, _ = encoder.encode(part.column("text").to_pylist())
            offsets = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    return common.documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of lists of ids: ``doc_id``, ``text``. A null list gives an empty text;
    bytes that are no UTF-8 become replacement characters."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = [
                encoder.decode(np.array(row or [], np.int64)).decode("utf-8", "replace")
                for row in batch.column("ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass and return digests of both:
    ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, ``round_trip``."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for part in common.slices(batches):
            texts = part.column("text").to_pylist()
            ids, sizes, rows = encoder.encode(texts)
            written = encoder.write()
            ends = np.cumsum(sizes)
            out: dict[str, list] = {"n": sizes.tolist(), "ids": [], "text": [], "same": []}
            for text, row, end, n in zip(texts, rows, ends.tolist(), out["n"]):
                back = encoder.decode(ids[end - n : end]).decode("utf-8", "replace")
                out["ids"].append(hashlib.sha256(b",".join([written[k] for k in row])).hexdigest())
                out["text"].append(hashlib.sha256(back.encode()).hexdigest())
                out["same"].append(back == text)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(out["n"], pa.int64()), pa.array(out["ids"], pa.string()), pa.array(out["text"], pa.string()), pa.array(out["same"], pa.bool_())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"],
            )

    return common.documents(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    )
