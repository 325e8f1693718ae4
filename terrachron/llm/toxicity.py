"""Toxicity by a bidirectional gated recurrent network with attention, in numpy.

A word's input joins an embedding of the word, the mean embedding of its character
n-grams, and the strongest hint among them: how much more often documents labelled
toxic hold the n-gram. Two recurrent passes read a window of words, attention pools their states,
and a logistic unit scores the window. A text's score is the highest of all its
overlapping windows, so a short insult in a long text counts in full.

Training sees labels of whole documents: each round scores all windows of the
training documents and learns from the highest window of each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from terrachron.llm import chars, common
from terrachron.llm.bpe import spread

#: Labelled documents of each class learned from, those with the least hashes of their
#: ids, and as many of these as together hold this many bytes of text, but one at least.
#: Texts are whole; scoring has no such bounds.
TRAIN_DOCS = 1200
TRAIN_BYTES = 8 << 20
WINDOW = 128
STRIDE = 64
ROUNDS = 5
#: Documents' worth of doubt in a word's log ratio, and learning rates.
DOUBT = 10
RATE = 0.02
TABLE_RATE = 0.002
WORD_BUCKETS = 1 << 16
CHAR_BUCKETS = 1 << 17
ORDERS = (3, 4, 5, 6)
HIDDEN = 8
WORD_SIZE = 6
CHAR_SIZE = 6
INPUT_SIZE = WORD_SIZE + CHAR_SIZE + 1
MEMORY_WORDS = 300_000
BATCH = 1024


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def bare(word: str) -> str:
    """The word in lower case without marks at its ends."""
    return word.lower().strip(".,;:!?\"'()[]{}<>*#$%&|-_~…»«“”’‘")


def added(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows that go to each of ``size`` places."""
    columns = [np.bincount(at, weights=rows[:, k], minlength=size) for k in range(rows.shape[1])]
    return np.stack(columns, axis=1).astype(rows.dtype)


class Words:
    """Numbers of the words met, with their hashes; number 0 is the filling of short windows."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.word_bucket = np.zeros(1, np.int64)
        self.grams = np.zeros(0, np.int32)
        self.gram_owner = np.zeros(0, np.int32)

    def number(self, texts: list[str]) -> list[np.ndarray]:
        known, met, rows = self.known, len(self.known), []
        for text in texts:
            words = common.split_words(text)
            rows.append(np.array([known.setdefault(w, len(known)) for w in words], np.int64))
        fresh = [bare(w) for w in list(known)[met:]]
        if fresh:
            buckets = [1 + zlib.crc32(w.encode("utf-8", "surrogatepass")) % (WORD_BUCKETS - 1) for w in fresh]
            self.word_bucket = np.r_[self.word_bucket, np.array(buckets, np.int64)]
            gram, owner = chars.gram_buckets(fresh, ORDERS, CHAR_BUCKETS)
            order = np.argsort(owner, kind="stable")
            gram, owner = gram[order], owner[order]
            self.grams, self.gram_owner = np.r_[self.grams, gram], np.r_[self.gram_owner, owner + np.int32(met)]
        return rows


def windows(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of texts as rows of word numbers, and the text of each; a text has one at least."""
    counts = np.array([1 + max(0, -(-(len(r) - WINDOW) // STRIDE)) for r in rows], np.int64)
    sizes = (counts - 1) * STRIDE + WINDOW
    ends = np.cumsum(sizes)
    flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
    for row, end, size in zip(rows, ends.tolist(), sizes.tolist()):
        flat[end - size : end - size + len(row)] = row
    text = np.repeat(np.arange(len(rows)), counts)
    place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return flat[((ends - sizes)[text] + place * STRIDE)[:, None] + np.arange(WINDOW)], text


class Network:
    """The network and its training. Parameters are a dict of arrays, so they can be broadcast."""

    def __init__(self, parameters: dict | None = None, seed: int = 7):
        if parameters is None:
            r = np.random.default_rng(seed)
            draw = lambda *shape: r.normal(0, 0.3, shape).astype(np.float32)
            parameters = {"word": draw(WORD_BUCKETS, WORD_SIZE) * 0.1, "char": draw(CHAR_BUCKETS, CHAR_SIZE) * 0.1}
            parameters["hint"] = np.zeros(CHAR_BUCKETS, np.float32)
            for side in "fb":
                parameters |= {
                    f"{side}_in": draw(INPUT_SIZE, 3 * HIDDEN),
                    f"{side}_bias": np.zeros(3 * HIDDEN, np.float32),
                    f"{side}_gate": draw(HIDDEN, 2 * HIDDEN),
                    f"{side}_new": draw(HIDDEN, HIDDEN),
                }
            parameters |= {"att": draw(2 * HIDDEN, HIDDEN), "att_bias": np.zeros(HIDDEN, np.float32), "att_out": draw(HIDDEN)}
            parameters |= {"out": draw(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        self.p = parameters

    # inputs

    def inputs(self, words: Words, begin: int = 0) -> np.ndarray:
        """Input vector of each known word from number ``begin`` on."""
        n = len(words.word_bucket)
        near = np.searchsorted(words.gram_owner, begin)
        owner, gram = words.gram_owner[near:] - begin, words.grams[near:]
        count = np.maximum(np.bincount(owner, minlength=n - begin), 1)
        mean = [np.bincount(owner, weights=self.p["char"][gram, k], minlength=n - begin) / count for k in range(CHAR_SIZE)]
        top = np.zeros((n - begin, 1), np.float32)
        if len(owner):
            heads = np.flatnonzero(np.r_[True, np.diff(owner) != 0])
            top[owner[heads], 0] = np.maximum.reduceat(self.p["hint"][gram], heads)
        mean = np.stack(mean, axis=1).astype(np.float32)
        return np.concatenate([self.p["word"][words.word_bucket[begin:]], mean, top], axis=1)

    # forward

    def read(self, side: str, given: np.ndarray, index: np.ndarray, keep: list | None) -> np.ndarray:
        """States after each word, in the order of the window; ``given`` has each word's projected input."""
        gate, new = self.p[f"{side}_gate"], self.p[f"{side}_new"]
        state = np.zeros((len(index), HIDDEN), np.float32)
        states = np.zeros((WINDOW, len(index), HIDDEN), np.float32)
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            x = given[index[:, t]]
            zr = sigmoid(x[:, : 2 * HIDDEN] + state @ gate)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            candidate = np.tanh(x[:, 2 * HIDDEN :] + (r * state) @ new)
            if keep is not None:
                keep.append((t, state, z, r, candidate))
            state = candidate + z * (state - candidate)
            states[t] = state
        return states

    def project(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        return {s: vectors @ self.p[f"{s}_in"] + self.p[f"{s}_bias"] for s in "fb"}

    def forward(self, projected: dict[str, np.ndarray], index: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window."""
        kept = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        states = np.concatenate([self.read(s, projected[s], index, kept[s]) for s in "fb"], axis=2)
        hidden = np.tanh(states @ self.p["att"] + self.p["att_bias"])
        score = np.where(index.T > 0, hidden @ self.p["att_out"], -30)
        score = np.exp(score - score.max(axis=0))
        weight = score / score.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        if keep is not None:
            keep |= {"kept": kept, "states": states, "hidden": hidden, "weight": weight, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def logits(self, projected: dict[str, np.ndarray], index: np.ndarray) -> np.ndarray:
        parts = [self.forward(projected, index[k : k + BATCH]) for k in range(0, len(index), BATCH)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    # backward

    def gradients(self, words: Words, index: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean logistic loss."""
        unique, where = np.unique(index, return_inverse=True)
        where = where.reshape(index.shape)
        small = Words()
        small.word_bucket = words.word_bucket[unique]
        begin = np.searchsorted(words.gram_owner, unique)
        sizes = np.searchsorted(words.gram_owner, unique, side="right") - begin
        small.grams = words.grams[spread(begin, sizes)]
        small.gram_owner = np.repeat(np.arange(len(unique)), sizes)
        vectors = self.inputs(small)
        keep: dict = {}
        # the filling must stay number 0 for the mask, so the mask is taken from the real numbers
        shifted = where + (0 if unique[0] == 0 else 1)
        if unique[0] != 0:
            vectors = np.r_[np.zeros((1, vectors.shape[1]), np.float32), vectors]
        logit = self.forward(self.project(vectors), shifted, keep)
        p, g = self.p, {}
        d = ((sigmoid(logit) - labels) / len(labels)).astype(np.float32)
        g["bias"], g["out"] = np.array([d.sum()]), keep["pooled"].T @ d
        d_pooled = d[:, None] * p["out"]
        d_states = keep["weight"][:, :, None] * d_pooled
        d_weight = np.einsum("bh,tbh->tb", d_pooled, keep["states"])
        d_score = keep["weight"] * (d_weight - (keep["weight"] * d_weight).sum(axis=0))
        d_score = np.where(shifted.T > 0, d_score, 0)
        g["att_out"] = np.einsum("tb,tbh->h", d_score, keep["hidden"])
        d_hidden = d_score[:, :, None] * p["att_out"] * (1 - keep["hidden"] ** 2)
        g["att_bias"] = d_hidden.sum(axis=(0, 1))
        g["att"] = np.einsum("tbh,tbk->hk", keep["states"], d_hidden)
        d_states = d_states + d_hidden @ p["att"].T
        d_vectors = np.zeros_like(vectors)
        for at, side in enumerate("fb"):
            gate, new = p[f"{side}_gate"], p[f"{side}_new"]
            g_gate, g_new = np.zeros_like(gate), np.zeros_like(new)
            steps, at_step = [], []
            d_state = np.zeros((len(index), HIDDEN), np.float32)
            for t, state, z, r, candidate in reversed(keep["kept"][side]):
                d_state = d_state + d_states[t][:, at * HIDDEN : (at + 1) * HIDDEN]
                d_new = d_state * (1 - z) * (1 - candidate**2)
                d_rs = d_new @ new.T
                d_zr = np.concatenate([d_state * (state - candidate) * z * (1 - z), d_rs * state * r * (1 - r)], axis=1)
                g_new += (r * state).T @ d_new
                g_gate += state.T @ d_zr
                d_state = d_state * z + d_rs * r + d_zr @ gate.T
                steps.append(np.concatenate([d_zr, d_new], axis=1))
                at_step.append(shifted[:, t])
            d_given = added(np.concatenate(at_step), np.concatenate(steps), len(vectors))
            g[f"{side}_gate"], g[f"{side}_new"] = g_gate, g_new
            g[f"{side}_bias"], g[f"{side}_in"] = d_given.sum(axis=0), vectors.T @ d_given
            d_vectors += d_given @ p[f"{side}_in"].T
        if unique[0] != 0:
            d_vectors = d_vectors[1:]
        g["word"] = added(small.word_bucket, d_vectors[:, :WORD_SIZE], WORD_BUCKETS)
        count = np.maximum(np.bincount(small.gram_owner, minlength=len(unique)), 1)
        shares = d_vectors[:, WORD_SIZE : WORD_SIZE + CHAR_SIZE] / count[:, None]
        g["char"] = added(small.grams, shares[small.gram_owner], CHAR_BUCKETS)
        return g

    def step(self, gradients: dict[str, np.ndarray], memory: dict) -> None:
        """One step of Adam."""
        memory["t"] = t = memory.get("t", 0) + 1
        for name, gradient in gradients.items():
            mean, square = memory.setdefault(name, (np.zeros_like(gradient), np.zeros_like(gradient)))
            rate = TABLE_RATE if name in ("word", "char") else RATE
            mean += 0.1 * (gradient - mean)
            square += 0.01 * (gradient**2 - square)
            self.p[name] -= (rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-6)).astype(np.float32)


def fit(texts: list[str], labels: list[int], seed: int = 7) -> dict:
    """Parameters learned from labelled texts.

    Word embeddings start from the log ratio of the shares of toxic and other documents
    with the word, less for words of few documents. In the end the bias is moved so that a score of one half separates the
    highest windows of the two classes best.
    """
    network, words, r = Network(seed=seed), Words(), np.random.default_rng(seed)
    marks = np.array(labels, np.float32)
    if not 0 < marks.sum() < len(marks):
        network.p["out"][:] = 0
        network.p["bias"][:] = -4.0 if not marks.sum() else 4.0
        return network.p
    rows = words.number(texts)
    buckets = [words.word_bucket[np.unique(row)] for row in rows]
    ratio = log_ratio(buckets, marks, WORD_BUCKETS)
    network.p["word"][:, 0] = ratio / 2
    begin = np.searchsorted(words.gram_owner, np.arange(len(words.word_bucket)))
    size = np.searchsorted(words.gram_owner, np.arange(len(words.word_bucket)), side="right") - begin
    grams = (np.unique(words.grams[spread(begin[u], size[u])]) for u in map(np.unique, rows))
    hint = log_ratio(grams, marks, CHAR_BUCKETS)
    network.p["char"][:, 0], network.p["hint"][:] = hint / 2, hint / 2
    index, owner = windows(rows)
    first = np.searchsorted(owner, np.arange(len(rows)))
    prior = network.inputs(words) @ np.r_[1, np.zeros(INPUT_SIZE - 2), 1]
    prior[0] = 0
    score = prior[index].max(axis=1)
    memory: dict = {}
    for _ in range(ROUNDS):
        top = highest(score, owner, first)
        others = r.integers(0, len(index), len(rows))
        others = others[marks[owner[others]] == 0]
        toxic = top[marks == 1]
        times = max(1, int(len(top) / max(1, 2 * len(toxic))))
        chosen = np.r_[top, others, np.repeat(toxic, times - 1)]
        chosen = r.permutation(chosen)
        for k in range(0, len(chosen), 128):
            pick = chosen[k : k + 128]
            network.step(network.gradients(words, index[pick], marks[owner[pick]]), memory)
        score = network.logits(network.project(network.inputs(words)), index)
    best = score[highest(score, owner, first)]
    cuts = np.sort(best)
    cuts = np.r_[cuts[0] - 1, (cuts[1:] + cuts[:-1]) / 2, cuts[-1] + 1]
    wrong = np.array([np.mean(best[marks == 1] < c) + np.mean(best[marks == 0] >= c) for c in cuts])
    least = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    network.p["bias"] -= cuts[least[len(least) // 2]].astype(np.float32)
    return network.p


def log_ratio(found: Iterable[np.ndarray], marks: np.ndarray, size: int) -> np.ndarray:
    """Log of the shares of toxic and other documents that have a bucket, less for buckets of few."""
    held = np.zeros((2, size))
    for own, mark in zip(found, marks):
        held[int(mark), np.unique(own)] += 1
    n = np.array([len(marks) - marks.sum(), marks.sum()])
    ratio = np.log((held[1] + 0.5) / (n[1] + 1)) - np.log((held[0] + 0.5) / (n[0] + 1))
    ratio *= held.sum(axis=0) / (held.sum(axis=0) + DOUBT)
    return np.clip(ratio, -4, 4).astype(np.float32)


def highest(score: np.ndarray, owner: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Place of the highest score of each owner."""
    order = np.lexsort([-score, owner])
    return order[first]


def train(docs: DataFrame, labels: DataFrame, most_docs: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """Parameters from a sample of labelled documents, ``most_docs`` and ``most_bytes`` of each class at most, texts whole.

    The sample is bounded and comes to the driver, where training runs. Null labels and
    labels other than 0 and 1 are left out. Without both classes all scores are alike.
    """
    texts = common.documents(docs, id_col, text_col)
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label"))
    known = known.where("label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    # two classes times most_docs rows, so they may be broadcast
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most_docs).drop("k")
    held = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.max(F.octet_length("text")).alias("size"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    held = held.where((F.col("before") == 0) | (F.col("before") + F.col("size") <= most_bytes)).select("doc_id", "label")
    rows = texts.join(F.broadcast(held), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    sample = sorted(rows.collect(), key=lambda x: x["doc_id"])
    return fit([x["text"] for x in sample], [x["label"] for x in sample])


def score(docs: DataFrame, parameters: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` (0 to 1), ``predicted`` (1 from one half on), ``n_windows`` and
    ``window``, the number of the highest window. Null and empty texts are one empty window."""
    shared = docs.sparkSession.sparkContext.broadcast(parameters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(shared.value)
        words = None
        for part in common.slices(batches, most=common.SLICE_BYTES // 2):
            if words is None or len(words.known) > MEMORY_WORDS:
                words = Words()
                projected = network.project(network.inputs(words))
            begin = len(words.word_bucket)
            rows = words.number(part.column("text").to_pylist())
            fresh = network.project(network.inputs(words, begin))
            projected = {s: np.concatenate([projected[s], fresh[s]]) for s in "fb"}
            index, owner = windows(rows)
            logit = network.logits(projected, index)
            first = np.searchsorted(owner, np.arange(len(rows)))
            top = highest(logit, owner, first)
            value = sigmoid(logit[top].astype(np.float64))
            count = np.bincount(owner, minlength=len(rows))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(value), pa.array((value >= 0.5).astype(np.int32)), pa.array(count), pa.array(top - first)],
                ["doc_id", "score", "predicted", "n_windows", "window"],
            )

    return common.documents(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, score double, predicted int, n_windows long, window long"
    )
