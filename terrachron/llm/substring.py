"""Removal of passages that repeat: suffix automata over shards of reference passages.

A window is ``length`` consecutive words. A word is removed if a window that covers
it has the same words as a window that starts earlier, in a smaller document or
before it in the same one.

Holding all documents against automata of the whole corpus would cost documents times
shards. Instead each window is assigned to its anchor, the short word sequence in
it with the least hash. Equal windows have equal anchors at equal places, so anchors
deal passages out to shards, and passages meet only in their anchor's shard:

1. Every text gives one row for each run of windows that share an anchor. Rows meet
   by anchor and passage; later copies of a passage go, single anchors vanish.
2. Different passages with one anchor come with their words. What no other passage of
   the anchor shares, to the left or right, is cut off.
   Anchors of very many passages (found in a sample, which only chooses the way) are cut
   into single windows that meet by their own hash, so no anchor fills a task.
3. A suffix automaton over the shard's passages, in order of documents, streams each
   passage for matching statistics before adding what is new of it. Maximal spans
   that match ``length`` words or more are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from terrachron.llm import common
from terrachron.session import materialize

LENGTH = 20
ANCHOR = 7
#: Word hashes and passages a task holds at once; bounds memory, not results.
MEMORY_WORDS = 150_000
SHARD_PASSAGES = 20_000
#: Anchors with so many passages in one of so many documents are taken window by window.
HOT_PASSAGES = 25
HOT_SAMPLE = 16
BREAK_CHARS = " \t\n\x0b\x0c\r"
_WORD_AND_BREAK = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def word_hashes(texts: pa.Array, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, end to end, and where each text ends; the words of one text at a time are held."""
    rows = [np.zeros(0, np.uint64)]
    for text in texts:
        words = common.split_words(text.as_py())
        rows.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
    return np.concatenate(rows), np.cumsum([len(r) for r in rows[1:]])


def least_of(values: np.ndarray, span: int) -> np.ndarray:
    """For each ``span`` neighbours the place of the first least one among them, without a copy of each window."""
    n = len(values) - span + 1
    least, place = values[:n].copy(), np.zeros(n, np.uint8 if span <= 256 else np.int64)
    for k in range(1, span):
        better = values[k : k + n] < least
        np.copyto(least, values[k : k + n], where=better)
        place[better] = k
    return place


def runs(hashes: np.ndarray, ends: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor, over texts laid end to end.

    Returns for each run its text's number, first window, windows, the anchor's place
    after the first window's start, the anchor's hash and the passage's hash.
    """
    total, span = len(hashes), length - anchor + 1
    if total < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    gram = np.zeros(total - anchor + 1, np.uint64)
    for k in range(anchor):
        gram = gram * _ODD + hashes[k : k + len(gram)]
    gram = mix(gram)
    text = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(np.r_[0, ends]))
    starts = np.flatnonzero(np.arange(total - length + 1) + length <= ends[text[: total - length + 1]])
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    place = starts + least_of(gram, span)[starts]
    fresh = np.r_[True, (np.diff(starts) != 1) | (np.diff(place) != 0) | (np.diff(text[starts]) != 0)]
    first = np.flatnonzero(fresh)
    count = np.diff(np.r_[first, len(starts)])
    begin, spot = starts[first], place[first]
    del starts, place, fresh
    powers = np.full(total, _ODD, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    prefix = np.r_[np.uint64(0), np.cumsum(hashes * powers, dtype=np.uint64)]
    del powers
    back = np.full(total, np.uint64(pow(int(_ODD), -1, 1 << 64)), np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    passage = mix((prefix[begin + count + length - 1] - prefix[begin]) * back[begin] + (count * 64 + spot - begin).astype(np.uint64) * _MIX)
    base = np.r_[0, ends[:-1]]
    number = text[begin]
    return number, begin - base[number], count, spot - begin, gram[spot].view(np.int64), passage.view(np.int64)


def copies_here(gram: np.ndarray, passage: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rows whose passage also has an earlier row among these."""
    order = np.lexsort([start, doc, passage, gram])
    same = (np.diff(gram[order]) == 0) & (np.diff(passage[order]) == 0)
    head = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(order)), 0)) if len(order) else order
    first = order[head]
    return order[(doc[order] != doc[first]) | (start[order] != start[first])]


def window_hashes(hashes: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows that begin at these words."""
    found = np.zeros(len(first), np.uint64)
    for k in range(length):
        found = found * _MIX + mix(hashes[first + k])
    return mix(found)


def single_windows(hashes: np.ndarray, ends: np.ndarray, found: tuple[np.ndarray, ...], hot: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs as by ``runs``; those of a hot anchor are cut into windows, each with a key of its own in place of the anchor."""
    number, start, windows, place, gram, passage = found
    cut = np.isin(gram, hot)
    if not cut.any():
        return found
    n = windows[cut]
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    own = [np.repeat(c[cut], n) for c in (number, start, place, gram)]
    begin = own[1] + step
    window = window_hashes(hashes, np.r_[0, ends[:-1]][own[0]] + begin, length)
    key = mix(window ^ own[3].view(np.uint64))
    singles = (own[0], begin, np.ones(len(step), np.int64), own[2] - step, key.view(np.int64), window.view(np.int64))
    return tuple(np.r_[c[~cut], s] for c, s in zip(found, singles))


def hot_anchors(docs: DataFrame, length: int, anchor: int, least: int = HOT_PASSAGES, one_of: int = HOT_SAMPLE) -> np.ndarray:
    """Anchors with ``least`` rows or more in a sample of documents, sorted. Whether an anchor is among them changes no result."""
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_of)) == 0)
    counts = anchored(sample, length, anchor).where("shape > 0").groupBy("anchor").agg(F.count("*").alias("n"))
    return np.array(sorted(r["anchor"] for r in counts.where(F.col("n") >= least).select("anchor").collect()), np.int64)


def anchored(docs: DataFrame, length: int, anchor: int, hot: np.ndarray | None = None) -> DataFrame:
    """One row for each run of windows: ``anchor, passage, doc_id, start, shape``.

    Rows of a ``hot`` anchor are single windows. Equal windows have equal anchors, so all of them are cut alike.

    Copies of a passage within a slice of text are combined before the shuffle: all but the first
    are known to be later copies. They get a negative shape and, instead of the anchor,
    a key that spreads them, so that a very frequent anchor brings few rows together.
    """

    shared = docs.sparkSession.sparkContext.broadcast(np.zeros(0, np.int64) if hot is None else hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in common.slices(batches):
            if len(known) > MEMORY_WORDS:
                known = WordHashes()
            hashes, ends = word_hashes(part.column("text"), known)
            found = runs(hashes, ends, length, anchor)
            number, start, windows, place, gram, passage = single_windows(hashes, ends, found, shared.value, length)
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)[number]
            shape = windows * 64 + place
            later = copies_here(gram, passage, ids, start)
            gram[later] = mix(ids[later].astype(np.uint64) * _ODD + start[later].astype(np.uint64)).view(np.int64)
            shape[later] *= -1
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram), pa.array(passage), pa.array(ids), pa.array(start.astype(np.int32)), pa.array(shape.astype(np.int32))],
                ["anchor", "passage", "doc_id", "start", "shape"],
            )

    return docs.mapInArrow(run, "anchor long, passage long, doc_id long, start int, shape int")


def later_copies(rows: DataFrame, length: int) -> DataFrame:
    """From rows by anchor: spans of later copies of a passage (``anchor`` null), and the first
    copy of each passage whose anchor has several. Keeps one row of state, whatever the group's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, several = None, False  # first row of the current passage; whether its anchor has given out passages
        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)]
            known = new[4] < 0  # later copies already
            if known.any():
                none = np.zeros(0, np.int64)
                yield spans_out(*[c[known] for c in new[:4]], -new[4][known], np.arange(int(known.sum())), none)
            new = [c[~known] for c in new]
            if not len(new[0]):
                continue
            if held is not None:
                new = [np.r_[h, c] for h, c in zip(held, new)]
            gram, passage, doc, start, shape = new
            n = len(gram)
            fresh = np.r_[True, (np.diff(gram) != 0) | (np.diff(passage) != 0)]
            first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            later = (doc != doc[first]) | (start != start[first])
            firsts = np.flatnonzero(fresh)
            begin = np.flatnonzero(np.r_[True, np.diff(gram[firsts]) != 0])
            sizes = np.diff(np.r_[begin, len(firsts)])
            give = np.repeat(sizes > 1, sizes)
            if held is not None and several:
                give[: sizes[0]], give[0] = True, False  # the held row was given out already
            out = firsts[give]
            several = bool(sizes[-1] > 1 or (len(sizes) == 1 and held is not None and several))
            held = [c[first[-1] : first[-1] + 1] for c in new]
            yield spans_out(gram, passage, doc, start, shape, np.flatnonzero(later), out)

    def spans_out(gram, passage, doc, start, shape, gone: np.ndarray, given: np.ndarray) -> pa.RecordBatch:
        pick = np.r_[gone, given]
        nulls = np.arange(len(pick)) < len(gone)
        begin, stop = start[pick], start[pick] + (shape[pick] >> 6) + length - 1
        spot = begin + (shape[pick] & 63)
        return pa.RecordBatch.from_arrays(
            [pa.array(gram[pick], pa.int64(), mask=nulls), pa.array(doc[pick])] + [pa.array(c.astype(np.int32)) for c in (begin, stop, spot)],
            ["anchor", "doc_id", "start", "stop", "spot"],
        )

    dealt = rows.repartition("anchor").sortWithinPartitions("anchor", "passage", "doc_id", "start")
    return dealt.mapInArrow(run, "anchor long, doc_id long, start int, stop int, spot int")


def trim(left: np.ndarray, right: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each passage, how many words to the left and right of the anchor another passage of its group shares.

    Rows of ``left`` and ``right`` are word numbers outwards from the anchor, padded with
    numbers that equal no other. Neighbours in sorted order share most.
    """
    shared = []
    for side in (left, right):
        order = np.lexsort([*side.T[::-1], group])
        ranked = side[order]
        same = (ranked[1:] == ranked[:-1]) & (group[order][1:] == group[order][:-1])[:, None]
        common_ = np.logical_and.accumulate(same, axis=1).sum(axis=1)
        most = np.maximum(np.r_[0, common_], np.r_[common_, 0])
        back = np.empty(len(order), np.int64)
        back[order] = most
        shared.append(back)
    return shared[0], shared[1]


class SuffixAutomaton:
    """Suffix automaton of several word sequences; a sequence ends where the next begins."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.size = [0]

    def add(self, words: list[str]) -> None:
        last = 0
        for word in words:
            last = self.extend(last, word)

    def extend(self, last: int, word: str) -> int:
        after, link, size = self.next, self.link, self.size
        if word in after[last]:
            q = after[last][word]
            return q if size[q] == size[last] + 1 else self.clone(last, word, q)
        state = len(after)
        after.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and word not in after[p]:
            after[p][word] = state
            p = link[p]
        if p >= 0:
            q = after[p][word]
            link[state] = q if size[q] == size[p] + 1 else self.clone(p, word, q)
        return state

    def clone(self, p: int, word: str, q: int) -> int:
        after, link = self.next, self.link
        copy = len(after)
        after.append(dict(after[q]))
        self.size.append(self.size[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and after[p].get(word) == q:
            after[p][word] = copy
            p = link[p]
        return copy

    def statistics(self, words: list[str]) -> list[int]:
        """For each place, the words before and at it that occur together in the automaton."""
        after, link, size = self.next, self.link, self.size
        state = matched = 0
        found = []
        for word in words:
            while state and word not in after[state]:
                state = link[state]
                matched = size[state]
            if word in after[state]:
                state, matched = after[state][word], matched + 1
            found.append(matched)
        return found


def spans(matched: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal spans covered by matches of at least ``length`` words."""
    found: list[tuple[int, int]] = []
    for end, m in enumerate(matched, 1):
        if m >= length:
            if found and found[-1][1] >= end - length:
                found[-1] = (found[-1][0], end)
            else:
                found.append((end - length, end))
    return found


def shard_spans(rows: list[tuple[int, int, int, int, list[str]]], length: int, anchor: int) -> list[tuple[int, int, int]]:
    """Removed spans of the passages of whole anchors.

    A row is anchor, document, first word, the anchor's place in the passage, and its words.
    """
    side = length - anchor
    numbers: dict[str, int] = {}
    left = -1 - np.arange(len(rows) * side, dtype=np.int64).reshape(len(rows), side)
    right = left - len(rows) * side
    for k, (_, _, _, place, words) in enumerate(rows):
        ids = [numbers.setdefault(w, len(numbers)) for w in words]
        before, behind = ids[:place][::-1], ids[place + anchor :]
        left[k, : len(before)], right[k, : len(behind)] = before, behind
    group = np.unique([r[0] for r in rows], return_inverse=True)[1]
    to_left, to_right = trim(left, right, group)
    removed, earlier, automaton = [], {}, SuffixAutomaton()
    for k in sorted(range(len(rows)), key=lambda k: rows[k][1:3]):
        _, doc, start, place, words = rows[k]
        low, high = place - int(to_left[k]), place + anchor + int(to_right[k])
        if high - low < length:
            continue
        kept = words[low:high]
        key = tuple(kept)
        if earlier.setdefault(key, (doc, start)) != (doc, start):
            removed.append((doc, start + low, start + high))
            continue
        matched = automaton.statistics(kept)
        removed.extend((doc, start + low + a, start + low + b) for a, b in spans(matched, length))
        fresh = [e for e in range(length, len(kept) + 1) if matched[e - 1] < length]  # ends of new windows
        while fresh:
            end = fresh[0]
            while fresh and fresh[0] <= end + 1:
                end = fresh.pop(0)
            begin = fresh_begin(matched, end, length)
            automaton.add(kept[begin:end])
    return removed


def fresh_begin(matched: list[int], end: int, length: int) -> int:
    """Start of the first window of the run of new windows that ends at ``end``."""
    while end > length and matched[end - 2] < length:
        end -= 1
    return end - length


def shared_spans(docs: DataFrame, firsts: DataFrame, length: int, anchor: int) -> DataFrame:
    """Removed spans of passages that share their anchor with different ones: ``doc_id, start, stop``."""
    lists = firsts.groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "start", "stop", "spot")).alias("passages"))
    wanted = docs.join(lists, "doc_id", "left").where("passages is not null").select("doc_id", "text", "passages")

    def words_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            out: list[list] = [[] for _ in range(5)]
            for doc, text, found in zip(*(part.column(k).to_pylist() for k in range(3))):
                words = common.split_words(text)
                for p in found:
                    row = (p["anchor"], doc, p["start"], p["spot"] - p["start"], " ".join(words[p["start"] : p["stop"]]))
                    for column, value in zip(out, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()))],
                ["anchor", "doc_id", "start", "place", "words"],
            )

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for gram, doc, start, place, words in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if len(held) >= SHARD_PASSAGES and gram != held[-1][0]:
                    yield result(held)
                    held = []
                held.append((gram, doc, start, place, words.split(" ")))
        if held:
            yield result(held)

    def result(held: list[tuple]) -> pa.RecordBatch:
        rows = shard_spans(held, length, anchor)
        columns = list(zip(*rows)) if rows else [[], [], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "start", "stop"]
        )

    passages = wanted.mapInArrow(words_out, "anchor long, doc_id long, start int, place int, words string")
    dealt = passages.distinct().repartition("anchor").sortWithinPartitions("anchor", "doc_id", "start")
    return dealt.mapInArrow(shards, "doc_id long, start int, stop int")


def first_passages(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Later copies and first passages, as ``later_copies`` gives them, with hot anchors cut into windows."""
    return later_copies(anchored(docs, length, anchor, hot_anchors(docs, length, anchor)), length)


def removed_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Spans of words to remove from ``docs`` (``doc_id, text``): ``doc_id, start, stop``; they may overlap."""
    if not 0 < anchor < length:
        raise ValueError("an anchor is shorter than a window")
    known = docs.where("doc_id is not null")
    found = materialize(first_passages(known, length, anchor), "passages")
    copies = found.where("anchor is null").select("doc_id", "start", "stop")
    return copies.unionByName(shared_spans(docs, found.where("anchor is not null"), length, anchor))


def without(text: str, spans_: list, layout: bool) -> tuple[int, int, str]:
    """Words of a text, words removed, and what is left: with the breaks that followed the
    kept words, or joined by single spaces."""
    words = common.split_words(text)
    mask = bytearray(b"\1") * len(words)
    for s in spans_:
        mask[s["start"] : s["stop"]] = bytes(s["stop"] - s["start"])
    kept = sum(mask)
    if not layout:
        return len(words), len(words) - kept, " ".join(compress(words, mask))
    if kept == len(words):
        return kept, 0, text
    parts = [m for m in _WORD_AND_BREAK.findall(text)]
    return len(words), len(words) - kept, "".join(compress(parts, mask)).rstrip(BREAK_CHARS)


def deduplicate(
    docs: DataFrame,
    length: int = LENGTH,
    anchor: int = ANCHOR,
    id_col: str = "doc_id",
    text_col: str = "text",
    layout: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_words``, ``n_removed``, ``kept_text``, and the columns to ``keep``.

    Kept words are joined by single spaces or, with ``layout``, keep the breaks after them. A
    text shorter than a window keeps all its words; a null text has none. Rows with a null
    ``doc_id`` have no place in the order: they are kept whole and remove nothing. A
    repeated row counts as one document, and each of its copies keeps what the document
    keeps; rows that share a ``doc_id`` must have one text.
    """
    texts = common.documents(docs, id_col, text_col, keep)
    spans_ = removed_spans(texts.select("doc_id", "text"), length, anchor)
    lists = spans_.groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    joined = texts.join(lists, "doc_id", "left").select("doc_id", "text", "carried", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            found = zip(part.column("text").to_pylist(), part.column("spans").to_pylist())
            rows = [without(text, own or [], layout) for text, own in found]
            n_words, n_removed, kept = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("carried"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "carried", "n_words", "n_removed", "kept_text"],
            )

    kind = f"doc_id long, carried {joined.schema['carried'].dataType.simpleString()}, n_words long, n_removed long, kept_text string"
    out = joined.mapInArrow(run, kind)
    return out.select("doc_id", "n_words", "n_removed", "kept_text", *[F.col("carried")[c].alias(c) for c in keep])
