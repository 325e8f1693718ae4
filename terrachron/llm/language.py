"""Language identification of spans: scripts narrow the candidates, Viterbi labels the words.

Every word has a score under each language from its character n-grams. A path
through the languages pays a penalty for each switch; the best path cuts a text into
spans. A text's language is the one whose spans hold most letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from terrachron.llm import chars, common

UNKNOWN = "und"
ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16
#: Documents learned from in each language: those with the least hashes of their ids.
TRAIN_DOCS = 1000
SWITCH = 8.0
#: Score of a word in a language that is not written in the word's script.
FOREIGN = -30.0
#: A language is a candidate for a script if this share of its letters is in it.
SCRIPT_SHARE = 0.01
BLOCK = 128
MEMORY_WORDS = 400_000
#: First code point of ranges of scripts (0: any other).
SCRIPTS = [
    (0x0000, 0), (0x0041, 1), (0x005B, 0), (0x0061, 1), (0x007B, 0), (0x00AA, 1), (0x0250, 1), (0x0370, 2), (0x0400, 3),
    (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0780, 0), (0x0900, 7), (0x0980, 8), (0x0E00, 9), (0x0E80, 0),
    (0x10A0, 10), (0x1100, 11), (0x1200, 12), (0x13A0, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 13),
    (0x3100, 0), (0x3130, 11), (0x3190, 0), (0x3400, 14), (0xA000, 0), (0xAC00, 11), (0xD7B0, 0), (0xF900, 14),
    (0xFB00, 0), (0x20000, 14), (0x30000, 0),
]
N_SCRIPTS = 1 + max(s for _, s in SCRIPTS)


def word_scripts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of each word, and the script of its first letter (-1 without letters)."""
    flat, lengths, letters = chars.codes(words)
    starts = np.array([s for s, _ in SCRIPTS])
    kinds = np.array([k for _, k in SCRIPTS])
    owner = np.repeat(np.arange(len(words)), lengths)
    count = np.bincount(owner[letters], minlength=len(words))
    script = np.full(len(words), -1)
    where = np.flatnonzero(letters)[::-1]  # the first letter is written last
    script[owner[where]] = kinds[np.searchsorted(starts, flat[where], side="right") - 1]
    return count, script


def train(
    docs: DataFrame,
    lang_col: str = "lang",
    most_docs: int = TRAIN_DOCS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> dict:
    """Model from ``most_docs`` labelled documents of each language; null labels are left out.

    N-grams and scripts are counted on the executors. What comes to the driver is
    bounded by languages times buckets.
    """
    rows = common.documents(docs, id_col, text_col, lang=lang_col).where("lang is not null")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows.select("doc_id", "lang").withColumn("k", F.row_number().over(order)).where(F.col("k") <= most_docs)
    chosen = common.small(chosen.select("doc_id", "lang").distinct())
    sample = rows.join(chosen, ["doc_id", "lang"], "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            by_lang: dict[str, dict[str, int]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                own = by_lang.setdefault(lang, {})
                for word in common.split_words(text):
                    own[word] = own.get(word, 0) + 1
            for lang, own in by_lang.items():
                words, times = list(own), np.array(list(own.values()), np.float64)
                bucket, owner = chars.gram_buckets(words, ORDERS, BUCKETS)
                total = np.bincount(bucket, weights=times[owner], minlength=BUCKETS)
                letters, script = word_scripts(words)
                known = script >= 0
                scripts = np.bincount(script[known], weights=(letters * times)[known], minlength=N_SCRIPTS)
                keys = np.r_[np.flatnonzero(total), BUCKETS + np.flatnonzero(scripts)]
                values = np.r_[total, scripts][keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys)), pa.array(keys, pa.int32()), pa.array(values.astype(np.int64))], ["lang", "key", "n"]
                )

    counts = sample.mapInArrow(count, "lang string, key int, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    if not langs:
        return {"langs": [], "logs": np.zeros((BUCKETS, 0), np.float32), "allowed": np.ones((N_SCRIPTS, 0), bool)}
    total = np.zeros((BUCKETS + N_SCRIPTS, len(langs)))
    total[counts["key"].to_numpy(), np.searchsorted(langs, counts["lang"])] = counts["n"].to_numpy()
    grams, scripts = total[:BUCKETS] + 0.5, total[BUCKETS:]
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    allowed[~allowed.any(axis=1)] = True
    logs = np.log(grams / grams.sum(axis=0)) / len(ORDERS)
    return {"langs": [str(x) for x in langs], "logs": (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32), "allowed": allowed}


def viterbi(scores: np.ndarray, ends: np.ndarray, switch: float) -> np.ndarray:
    """Best label of each word of texts laid end to end.

    Texts are cut into blocks of equal length that advance together, a step for all at
    once: first from every label a block may begin with, then, with the blocks of a text
    chained, once more for the way back.
    """
    n, labels = scores.shape
    sizes = np.diff(np.r_[0, ends])
    blocks = -(-sizes // BLOCK)
    first = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    if not total:
        return np.zeros(0, np.int64)
    place = np.arange(n) - np.repeat(ends - sizes, sizes)
    block, step = np.repeat(first, sizes) + place // BLOCK, place % BLOCK
    given = np.zeros((BLOCK, labels, total), np.float32)
    given[step, :, block] = scores
    inside = np.full((labels, labels, total), -np.inf, np.float32)  # by first label, last label
    for s in range(labels):
        inside[s, s] = given[0, s]
    for t in range(1, BLOCK):
        best = inside.max(axis=1, keepdims=True) - switch
        np.maximum(inside, best, out=inside)
        inside += given[t]
    order = np.argsort(-blocks, kind="stable")
    order = order[blocks[order] > 0]
    longest, before = int(blocks.max()), np.zeros((total, labels), np.float32)
    enter = np.zeros((total, labels), np.float32)
    value = np.zeros((len(order), labels), np.float32)
    for k in range(longest):
        live = int(np.count_nonzero(blocks[order] > k))
        at, value = first[order[:live]] + k, value[:live]
        before[at] = value
        if k:
            value = np.maximum(value, value.max(axis=1, keepdims=True) - switch)
        enter[at] = value
        value = (value[:, :, None] + inside[:, :, at].transpose(2, 0, 1)).max(axis=1)
        value = value - value.max(axis=1, keepdims=True)
    running = enter.T + given[0]
    kind = np.min_scalar_type(max(1, labels - 1))
    back = np.zeros((BLOCK, labels, total), kind)
    own = np.arange(labels, dtype=kind)[:, None]
    for t in range(1, BLOCK):
        best, top = running.max(axis=0) - switch, running.argmax(axis=0)
        back[t] = np.where(best > running, top, own)
        running = np.maximum(running, best) + given[t]
    lead = np.broadcast_to(own, (labels, total)).astype(np.int64)  # first label of a block by its last
    for t in range(BLOCK - 1, 0, -1):
        lead = np.take_along_axis(back[t], lead, axis=0).astype(np.int64)
    last = np.zeros(total, np.int64)
    for k in range(longest - 1, -1, -1):
        live = order[: int(np.count_nonzero(blocks[order] > k))]
        at = first[live] + k
        ending = blocks[live] == k + 1
        last[at[ending]] = running[:, at[ending]].argmax(axis=0)
        if k:
            head = lead[last[at], at]
            came = before[at]
            stay = came[np.arange(len(at)), head] >= came.max(axis=1) - switch
            last[at - 1] = np.where(stay, head, came.argmax(axis=1))
    path = np.zeros((BLOCK, total), kind)
    path[BLOCK - 1] = last
    columns = np.arange(total)
    for t in range(BLOCK - 1, 0, -1):
        path[t - 1] = back[t][path[t], columns]
    return path[step, block].astype(np.int64)


class Labeller:
    """Labels words with a model; remembers the scores of words it has met."""

    def __init__(self, model: dict):
        self.__dict__.update(model)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.langs)), np.float32)
        self.letters = np.zeros(0, np.int64)

    def add(self, words: list[str]) -> None:
        bucket, owner = chars.gram_buckets(words, ORDERS, BUCKETS)
        scores = np.stack(
            [np.bincount(owner, weights=self.logs[bucket, k], minlength=len(words)) for k in range(len(self.langs))], axis=1
        )
        letters, script = word_scripts(words)
        scores[script < 0] = 0
        scores[(script >= 0)[:, None] & ~self.allowed[script]] = FOREIGN
        self.scores = np.concatenate([self.scores, scores.astype(np.float32)])
        self.letters = np.r_[self.letters, letters]

    def label(self, texts: list[str], switch: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Label and letters of each word, and where each text ends."""
        if len(self.known) > MEMORY_WORDS:
            self.forget()
        known, met, rows = self.known, len(self.known), []
        for text in texts:
            rows.append([known.setdefault(w, len(known)) for w in common.split_words(text)])
        if len(known) > met:
            self.add(list(known)[met:])
        ends = np.cumsum([len(r) for r in rows])
        which = np.fromiter((k for r in rows for k in r), np.int64, int(ends[-1]) if len(ends) else 0)
        return viterbi(self.scores[which], ends, switch), self.letters[which], ends


def spans(docs: DataFrame, model: dict, switch: float = SWITCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang``, ``score`` and ``spans``, an array of (lang, start, stop) in words.

    ``lang`` is the label with most letters (of equals, the first by name) and ``score``
    its share of the letters. A text without letters, null or empty, is ``und`` with
    score 0; so is every text if the model knows no language. Rows are labelled one by one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        names = labeller.langs
        kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        for part in common.slices(batches):
            texts = part.column("text").to_pylist()
            if not names:
                found = [(UNKNOWN, 0.0, [])] * len(texts)
            else:
                label, letters, ends = labeller.label(texts, switch)
                text = np.repeat(np.arange(len(texts)), np.diff(np.r_[0, ends]))
                held = np.zeros((len(texts), len(names)))
                np.add.at(held, (text, label), letters)
                found = []
                for k, end in enumerate(ends.tolist()):
                    begin = int(ends[k - 1]) if k else 0
                    total = held[k].sum()
                    if not total:
                        found.append((UNKNOWN, 0.0, []))
                        continue
                    own = label[begin:end]
                    cut = np.r_[0, np.flatnonzero(np.diff(own)) + 1, len(own)].tolist()
                    parts = [{"lang": names[own[a]], "start": a, "stop": b} for a, b in zip(cut, cut[1:])]
                    top = int(held[k].argmax())
                    found.append((names[top], float(held[k][top] / total), parts))
            lang, score, parts = zip(*found) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(parts, kind)],
                ["doc_id", "lang", "score", "spans"],
            )

    return common.documents(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, lang string, score double, spans array<struct<lang:string,start:int,stop:int>>"
    )
