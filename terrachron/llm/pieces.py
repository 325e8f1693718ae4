"""SentencePiece models of the BPE kind: encoding that keeps source offsets, and decoding.

A text is first normalised: at every place the longest prefix known to the model's compiled
character map (a double-array trie over UTF-8 bytes) is replaced, other characters stay, and
spaces become the mark that pieces carry. Each normalised byte remembers the source byte of
the character or prefix it came from, so that the pieces, which tile the
normalised bytes, are projected back to byte spans of the text.

No piece has a mark after another character, so words are encoded on their own and
remembered. Within a word the best-scored pair of neighbours is merged, the leftmost of equals
first: in rounds over all new words at once, each of which merges one pair of every word, or,
for long words, which would need very many rounds, with the pairs in a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terrachron.llm import bpe, common

#: Fixed values of the model format: kinds of pieces, the mark for a space, the BPE model type.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARK = "▁"
BPE_MODEL = 2
#: Words of more characters are merged with a heap; both ways give the same ids.
ROUND_CHARACTERS = 64
NONE = np.int32(2**31 - 1)


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protobuf message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, message[at : at + size]
        at += size


def read_model(path: str) -> dict:
    """What encoding needs of a model file; of fixed size, so it may be broadcast."""
    with open(path, "rb") as file:
        return parse_model(file.read())


def parse_model(message: bytes) -> dict:
    texts, scores, kinds = [], [], []
    trainer: dict = {}
    rules: dict = {}
    for field, value in fields(message):
        if field == 1:
            piece = dict(fields(value))
            texts.append(piece.get(1, b"").decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, NORMAL))
        elif field in (2, 3):
            (trainer if field == 2 else rules).update(fields(value))
    if trainer.get(3, 1) != BPE_MODEL or not trainer.get(35) or UNUSED in kinds or not rules.get(5, 1) or trainer.get(24):
        raise ValueError("only BPE models with byte fallback, marks before words and without unused pieces can be read")
    ends = {name: texts.index(text) if text in texts else -1 for name, text in (("bos", "<s>"), ("eos", "</s>"))}
    return {
        "texts": texts,
        "scores": scores,
        "kinds": kinds,
        "map": rules.get(2, b""),
        "prefix": bool(rules.get(3, 1)),
        "squeeze": bool(rules.get(4, 1)),
        "unknown": trainer.get(44, b" \xe2\x81\x87 "),
        **ends,
    }


class CharacterMap:
    """The compiled map: a double-array trie of UTF-8 keys and the texts that replace them."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.texts = compiled[4 + size :]
        self.candidates = self.first_characters() if self.units else None

    @staticmethod
    def offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def step(self, node: int, byte: int) -> tuple[int, int | None] | None:
        """Node after a byte, and the place of a replacement if a key ends there."""
        node ^= byte
        if node >= len(self.units) or self.units[node] & 0x800000FF != byte:
            return None
        unit = self.units[node]
        node ^= self.offset(unit)
        return node, self.units[node] & 0x7FFFFFFF if unit & 256 else None

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that starts here."""
        node, best = self.offset(self.units[0]), None
        for end in range(at, len(source)):
            taken = self.step(node, source[end])
            if taken is None:
                break
            node, place = taken
            if place is not None:
                best = end + 1 - at, place
        return best and (best[0], self.texts[best[1] : self.texts.index(b"\0", best[1])])

    def first_characters(self) -> re.Pattern:
        """Matches, in UTF-8, the places at which some key may start: its first two bytes, or all of it."""
        begin = self.offset(self.units[0])
        found = []
        for first in range(256):
            taken = self.step(begin, first)
            if taken is None:
                continue
            if taken[1] is not None:
                found.append(re.escape(bytes([first])))
                continue
            second = bytes(b for b in range(256) if self.step(taken[0], b) is not None)
            found.append(re.escape(bytes([first])) + b"(?=[" + b"".join(b"\\x%02x" % b for b in second) + b"])")
        return re.compile(b"|".join(found) if found else b"(?!)", re.DOTALL)


class PieceEncoder(bpe.Encoder):
    """Encodes and decodes texts; words and pieces met before are looked up."""

    def __init__(self, model: dict):
        self.__dict__.update(model)
        self.special = {}  # control pieces never come from a text
        kinds = np.array(self.kinds)
        normal = {t: k for k, (t, kind) in enumerate(zip(self.texts, self.kinds)) if kind == NORMAL}
        if any(MARK in t.lstrip(MARK) for t in normal):
            raise ValueError("pieces with a mark after another character are not supported")
        order = {s: r for r, s in enumerate(sorted({self.scores[k] for k in normal.values()}, reverse=True))}
        self.rank_of = {t: order[self.scores[k]] for t, k in normal.items() if len(t) > 1}
        self.id_of = normal | {t: k for k, t in enumerate(self.texts) if kinds[k] == USER_DEFINED}
        self.own = sorted((t for k, t in enumerate(self.texts) if kinds[k] == USER_DEFINED), key=len, reverse=True)
        self.own_first = re.compile("(" + "|".join(map(re.escape, self.own)) + ")") if self.own else None
        self.byte_ids = {int(t[3:5], 16): k for k, t in enumerate(self.texts) if kinds[k] == BYTE}
        merging = {c for t in self.rank_of for c in t}
        ranges = "".join(re.escape(c) for c in sorted(merging))
        self.parts = re.compile(f"[{ranges}]+|[^{ranges}]" if ranges else ".", re.DOTALL)
        self.runs = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+", re.DOTALL)
        self.characters = CharacterMap(self.map)
        self.pair_table()
        plain = [
            bytes([int(t[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else self.unknown if kind == UNKNOWN else t.replace(MARK, " ").encode()
            for t, kind in zip(self.texts, self.kinds)
        ]
        self.token_bytes = np.frombuffer(b"".join(plain), np.uint8)
        self.token_sizes = np.array(list(map(len, plain)), np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.kinds_of = kinds
        self.norm_sizes = np.array([1 if kind == BYTE else len(t.encode()) for t, kind in zip(self.texts, self.kinds)], np.int64)
        self.forget()

    # normalisation

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text with marks, and for each of its bytes and its end the source byte it comes from."""
        source = text.encode("utf-8", "surrogatepass")
        if not source:
            return "", np.zeros(1, np.int64)
        raw = np.frombuffer(source, np.uint8)
        origin = np.arange(len(raw))
        if not text.isascii():  # all bytes of a character come from its first
            starts = np.flatnonzero((raw & 0xC0) != 0x80)
            origin = starts[np.cumsum((raw & 0xC0) != 0x80) - 1]
        end = len(raw)
        if self.characters.units:
            raw, origin = self.replace(source, raw, origin)
        begin = 0
        if self.squeeze:
            space = raw == 32
            keep = ~(space & np.r_[True, space[:-1]])  # of a run of spaces the first, none at the start
            raw, origin, begin = raw[keep], origin[keep], self.after_spaces(source)
        normal = raw.tobytes().decode("utf-8", "replace").replace(" ", MARK)
        origin = np.append(np.repeat(origin, np.where(raw == 32, 3, 1)), end)
        if self.prefix:
            normal, origin = MARK + normal, np.concatenate([np.full(3, begin), origin])
        if self.squeeze:
            normal = normal.rstrip(MARK)
            origin = origin[: len(normal.encode()) + 1]
        return normal, origin if normal else np.zeros(1, np.int64)

    def after_spaces(self, source: bytes) -> int:
        """Where a text begins after all that becomes a space."""
        at = 0
        while at < len(source):
            size, text = (self.characters.units and self.characters.longest(source, at)) or (1, source[at : at + 1])
            if text != b" ":
                break
            at += size
        return at

    def replace(self, source: bytes, raw: np.ndarray, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest known prefixes replaced, from left to right; user-defined pieces are left alone."""
        kept = [m.span() for m in re.finditer("|".join(map(re.escape, self.own)).encode(), source)] if self.own else []
        texts, origins, done = [], [], 0
        for match in self.characters.candidates.finditer(source):
            at = match.start()
            if at < done or any(a <= at < b for a, b in kept):
                continue
            found = self.characters.longest(source, at)
            if found is None:
                continue
            size, text = found
            texts += [raw[done:at], np.frombuffer(text, np.uint8)]
            origins += [origin[done:at], np.full(len(text), at)]
            done = at + size
        if not texts:
            return raw, origin
        return np.concatenate([*texts, raw[done:]]), np.concatenate([*origins, origin[done:]])

    # merging

    def number(self, normal: str) -> list[int]:
        """Numbers of the words of a normalised text. A word after a single mark is known by what
        follows the mark, any other run as a tuple."""
        known = self.known
        if not normal:
            return []
        if self.own_first and self.own_first.search(normal):
            parts = [p for p in self.own_first.split(normal) if p]
            return [known[(r,)] for p in parts for r in ([p] if p in self.own else self.runs.findall(p))]
        head, *rest = normal.split(MARK)
        if "" in rest:
            return [known[(run,)] for run in self.runs.findall(normal)]
        row = [known[(head,)]] if head else []
        row.extend(map(known.__getitem__, rest))
        return row

    def split(self, key: str | tuple[str]) -> list[str]:
        """Parts of a word between which no piece can lie."""
        word = key[0] if isinstance(key, tuple) else MARK + key
        return [word] if word in self.own else self.parts.findall(word)

    def pair_table(self) -> None:
        """All pairs of pieces that join to a piece, sorted by key; ids of single characters."""
        size = self.size = len(self.texts) + 1  # one more id for a character that is no piece
        pairs = [
            (a * size + b, rank, self.id_of[text])
            for text, rank in self.rank_of.items()
            for cut in range(1, len(text))
            if (a := self.id_of.get(text[:cut])) is not None and (b := self.id_of.get(text[cut:])) is not None
        ]
        keys, ranks, made = np.array(sorted(pairs), np.int64).reshape(-1, 3).T
        self.keys, self.ranks, self.made = keys.copy(), ranks.astype(np.int32), made.astype(np.int32)
        self.single = np.full(0x110000, size - 1, np.int32)
        for text, k in self.id_of.items():
            if len(text) == 1 and self.kinds[k] == NORMAL:
                self.single[ord(text)] = k

    def places(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where each pair stands in the table; -1 for none."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1) if len(self.keys) else np.full(len(key), -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts in one array, and how many each has."""
        texts = [p.decode() for p in pieces]
        rows: list = [None] * len(texts)
        short = []
        for k, text in enumerate(texts):
            if len(text) > ROUND_CHARACTERS or text in self.own:
                rows[k] = self.merge_part(text)
            else:
                short.append(k)
        ids, sizes = self.merge_rounds([texts[k] for k in short])
        if len(short) == len(texts):
            return ids, sizes
        ends = np.cumsum(sizes).tolist()
        for k, end, n in zip(short, ends, sizes.tolist()):
            rows[k] = ids[end - n : end]
        return np.concatenate([np.array(r, np.int32) for r in rows]), np.array(list(map(len, rows)), np.int64)

    def merge_rounds(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for short words, all at once: every round merges the first lowest pair of each."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        symbols = self.single[codes]
        owner = np.repeat(np.arange(len(texts)), np.array(list(map(len, texts)), np.int64))
        place = np.full(len(symbols), -1)
        if len(symbols) > 1:
            place[:-1] = np.where(owner[:-1] == owner[1:], self.places(symbols[:-1], symbols[1:]), -1)
        ranks = np.append(self.ranks, NONE)  # -1 is no pair
        rank = ranks[place]
        done: list[tuple[np.ndarray, ...]] = []
        while len(symbols):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.append(first, len(owner)))
            lowest = np.minimum.reduceat(rank, first)
            going = np.repeat(lowest != NONE, sizes)
            if not going.all():
                done.append((owner[~going], symbols[~going], codes[~going]))
                sizes, lowest = sizes[lowest != NONE], lowest[lowest != NONE]
                symbols, owner, place, rank, codes = (x[going] for x in (symbols, owner, place, rank, codes))
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, sizes))
            at = hit[np.r_[True, np.diff(owner[hit]) != 0]]
            symbols[at] = self.made[place[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # where the merged symbols are once the gaps are closed: one gap a word
            symbols, owner, place, rank, codes = (x[keep] for x in (symbols, owner, place, rank, codes))
            mark = np.zeros(len(symbols) + 1, bool)
            mark[at], mark[at - 1] = True, True  # -1 marks the spare place at the end
            ask = np.flatnonzero(mark[:-1])
            after = np.minimum(ask + 1, len(symbols) - 1)
            inside = (owner[ask] == owner[after]) & (after > ask)
            place[ask] = np.where(inside, self.places(symbols[ask], symbols[after]), -1)
            rank[ask] = ranks[place[ask]]
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        owner, symbols, codes = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        owner, symbols, codes = owner[order], symbols[order], codes[order]
        wide = np.ones(len(symbols), np.int64)
        unknown = np.flatnonzero(symbols == self.size - 1)
        if len(unknown):  # characters that are no pieces become the pieces of their bytes
            wide[unknown] = 1 + (codes[unknown] > 0x7F) + (codes[unknown] > 0x7FF) + (codes[unknown] > 0xFFFF)
            spots = np.repeat(symbols == self.size - 1, wide)
            raw = "".join(map(chr, codes[unknown].tolist())).encode()
            symbols = np.repeat(symbols, wide)
            symbols[spots] = [self.byte_ids[b] for b in raw]
        return symbols.astype(np.int32), np.bincount(np.repeat(owner, wide), minlength=len(texts))

    def merge_part(self, part: str) -> list[int]:
        """Ids of one part, its pairs in a heap."""
        if part in self.own:
            return [self.id_of[part]]
        rank_of, symbols, n = self.rank_of, list(part), len(part)
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank_of.get(symbols[i] + symbols[i + 1])) is not None]
        if heap:
            heapq.heapify(heap)
            after, before = [*range(1, n), -1], [-1, *range(n - 1)]
            while heap:
                _, i, size = heapq.heappop(heap)
                j = after[i]
                if not symbols[i] or j < 0 or len(symbols[i]) + len(symbols[j]) != size:
                    continue  # one of the two has changed since
                symbols[i] += symbols[j]
                symbols[j] = ""
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    if (r := rank_of.get(symbols[i] + symbols[k])) is not None:
                        heapq.heappush(heap, (r, i, size + len(symbols[k])))
                h = before[i]
                if h >= 0 and (r := rank_of.get(symbols[h] + symbols[i])) is not None:
                    heapq.heappush(heap, (r, h, len(symbols[h]) + size))
        ids = []
        for symbol in symbols:
            if symbol:
                k = self.id_of.get(symbol)
                ids += [k] if k is not None else [self.byte_ids[b] for b in symbol.encode()]
        return ids

    # texts

    def encode_spans(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids of each text with begin and end, and the source bytes where each starts and ends."""
        normals = [self.normalise(t) for t in texts]
        ids, sizes, _ = self.encode([n for n, _ in normals])
        for (_, origin), end, n, text in zip(normals, np.cumsum(sizes).tolist(), sizes.tolist(), texts):
            mine = ids[end - n : end]
            stops = np.cumsum(self.norm_sizes[mine])
            begins, ends = origin[stops - self.norm_sizes[mine]], origin[stops]
            last = len(text.encode("utf-8", "surrogatepass")) if not text.isascii() else len(text)
            yield (
                np.concatenate([[self.bos], mine, [self.eos]]),
                np.concatenate([[0], begins, [last]]),
                np.concatenate([[0], ends, [last]]),
            )

    def decode_text(self, ids: np.ndarray) -> str:
        """Text of a sequence of ids: control pieces vanish, and so does the mark put before the text."""
        kinds = self.kinds_of[ids]
        starts, sizes = self.token_starts[ids], self.token_sizes[ids]
        if self.prefix or self.squeeze:
            for k in np.flatnonzero(kinds != CONTROL).tolist():
                marked = kinds[k] in (NORMAL, USER_DEFINED) and self.texts[ids[k]].startswith(MARK)
                if marked:
                    starts[k], sizes[k] = starts[k] + 1, sizes[k] - 1
                if not (self.squeeze and marked) or sizes[k]:
                    break
        said = kinds != CONTROL
        whole = self.token_bytes[bpe.spread(starts, sizes)].tobytes()
        try:
            if len(said) and said[np.argmax(said) : len(said) - np.argmax(said[::-1])].all():
                return whole.decode()
        except UnicodeDecodeError:
            pass
        # by runs, which control pieces end too: bytes that are no characters are replaced one by one
        runs = np.flatnonzero(np.diff(kinds)) + 1
        out = []
        for a, b in itertools.pairwise([0, *runs.tolist(), len(ids)]):
            part = self.token_bytes[bpe.spread(starts[a:b], sizes[a:b])].tobytes()
            out.append(part.decode("utf-8", "surrogateescape"))
        return "".join("\ufffd" if "\udc80" <= c <= "\udcff" else c for c in "".join(out))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids``, ``begins``, ``ends``: ids of every text, with begin and end, and their byte spans.

    The spans of a text's ids tile its bytes but for what normalisation drops. A character
    that is no piece becomes byte pieces, the last of which holds the span. A null or empty text has
    only begin and end. Repeated rows are encoded each. The model file is read on the driver
    and broadcast; its size does not depend on the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(shared.value)
        for part in common.slices(batches):
            rows = list(encoder.encode_spans(part.column("text").to_pylist()))
            offsets = pa.array(np.cumsum([0, *[len(r[0]) for r in rows]]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[k] for r in rows]), pa.int32())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *lists], ["doc_id", "ids", "begins", "ends"])

    return common.documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id``, ``text``: texts of lists of ids. A null list gives an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_model(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(shared.value)
        for batch in batches:
            texts = [encoder.decode_text(np.array(row or [], np.int64)) for row in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text with its spans, decode it, and return digests of both in one pass:
    ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, ``n_spanned`` (bytes of the text in spans)."""
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(shared.value)
        for part in common.slices(batches):
            out: list[list] = [[], [], [], []]
            for ids, begins, ends in encoder.encode_spans(part.column("text").to_pylist()):
                row = (
                    len(ids),
                    hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                    hashlib.sha256(encoder.decode_text(ids).encode("utf-8", "surrogatepass")).hexdigest(),
                    int((ends - begins).sum()),
                )
                for column, value in zip(out, row):
                    column.append(value)
            columns = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_spanned"])

    return common.documents(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_spanned long"
    )
