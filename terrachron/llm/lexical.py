"""Ranked lexical search: a hybrid of term-at-a-time and document-at-a-time evaluation.

Documents stay where they are read. A first pass counts what the scores need of the whole
table; a second one indexes a task's documents block by block and asks every query of each
block. Of a query's terms the short lists are summed first, term at a time, into one list
of accumulators. That list then takes part as a single bounded iterator in a
document-at-a-time evaluation of the long lists: lists that together cannot reach the
kth score so far give no candidates and are only looked up, by skipping, for
documents that can still enter. The kth score is carried from block to block, and a task
returns at most k documents a query.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from terrachron.llm import common

K = 10
#: Text indexed at once in a task, and candidates scored at once.
BLOCK_BYTES = 16 << 20
CANDIDATES = 512
#: Lists of at most this share of a block's documents are short.
SHORT_SHARE = 1 / 16
#: Queries of one pass over the documents: this many, or this much text.
PASS_ITEMS, PASS_BYTES = 5_000, 16 << 20
#: Everything up to DEL that is neither letter nor digit divides terms; A-Z become a-z.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


class Lists:
    """Inverted lists of a block of documents, for the terms of the queries."""

    def __init__(self, lengths: list[int], found: list[Counter], weights: np.ndarray, n: int, total: int):
        sizes = [len(c) for c in found]
        self.n = len(lengths)
        terms = np.fromiter((t for c in found for t in c), np.int64, sum(sizes))
        counts = np.fromiter((v for c in found for v in c.values()), np.int64, sum(sizes))
        docs = np.repeat(np.arange(self.n), sizes)
        norm = 25 + (75 * np.array(lengths, np.int64) * n) // max(1, total)
        values = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * norm[docs]))
        order = np.argsort(terms, kind="stable")  # documents stay in order
        self.docs, self.values = docs[order], values[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        held = np.flatnonzero(np.diff(self.starts))
        self.bounds = np.zeros(len(weights), np.int64)
        if len(held):
            self.bounds[held] = np.maximum.reduceat(self.values, self.starts[held])

    def accumulate(self, terms: list[int], times: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
        """Term at a time: the summed scores of short lists as one list with its bound."""
        sums = np.zeros(self.n, np.int64)
        for t, r in zip(terms, times):
            at = slice(self.starts[t], self.starts[t + 1])
            sums[self.docs[at]] += r * self.values[at]  # a list holds a document once
        docs = np.flatnonzero(sums)
        return docs, sums[docs], int(sums.max(initial=0))

    def search(self, terms: np.ndarray, times: np.ndarray, best: Best, ids: np.ndarray) -> None:
        """Offer ``best`` every document that can be among the k best."""
        sizes = self.starts[terms + 1] - self.starts[terms]
        short = (sizes > 0) & (sizes <= self.n * SHORT_SHARE)
        lists = []
        if short.any():
            lists.append(self.accumulate(terms[short].tolist(), times[short].tolist()))
        for t, r in zip(terms[~short & (sizes > 0)].tolist(), times[~short & (sizes > 0)].tolist()):
            at = slice(self.starts[t], self.starts[t + 1])
            lists.append((self.docs[at], r * self.values[at], r * int(self.bounds[t])))
        lists.sort(key=lambda x: x[2])
        reach = np.cumsum([bound for _, _, bound in lists])  # of a list and all lesser ones together
        start = 0
        while start < self.n:
            spare = int(np.searchsorted(reach, max(1, best.least)))  # lists that alone stay below the kth score
            if spare == len(lists):
                return
            mark = np.zeros(self.n - start, bool)
            for docs, _, _ in lists[spare:]:
                mark[docs[np.searchsorted(docs, start) :] - start] = True
            candidates, start = np.flatnonzero(mark) + start, self.n
            for begin in range(0, len(candidates), CANDIDATES):
                some = candidates[begin : begin + CANDIDATES]
                least = best.least
                self.score(lists, reach, spare, some, best, ids)
                if best.least > least and np.searchsorted(reach, best.least) > spare:
                    start = int(some[-1]) + 1  # more lists are spare now: fewer candidates from here on
                    break

    @staticmethod
    def score(lists: list, reach: np.ndarray, spare: int, some: np.ndarray, best: Best, ids: np.ndarray) -> None:
        sums = np.zeros(len(some), np.int64)
        for k in range(len(lists) - 1, -1, -1):
            if k < spare:  # only documents that this list and the lesser ones can still lift to the kth score
                alive = sums + reach[k] >= best.least
                some, sums = some[alive], sums[alive]
                if not len(some):
                    return
            docs, values, _ = lists[k]
            at = np.minimum(np.searchsorted(docs, some), len(docs) - 1)
            sums += np.where(docs[at] == some, values[at], 0)
        enter = (sums >= best.least) & (sums > 0)
        best.add(sums[enter], ids[some[enter]])


class Best:
    """The k best documents of a query so far; equal scores by the smaller id."""

    def __init__(self, k: int):
        self.k, self.least = k, 0
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(scores):
            return
        scores, ids = np.r_[self.scores, scores], np.r_[self.ids, ids]
        order = np.lexsort([ids, -scores])[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


def statistics(docs: DataFrame, numbers: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms with repeats, and how many documents hold each of the given terms."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, total = shared.value, 0, 0
        df: Counter = Counter()
        for part in common.slices(batches):
            for text in part.column("text").to_pylist():
                words = terms_of(text)
                if words:
                    n, total = n + 1, total + len(words)
                    df.update(set(map(known.get, words)))
        df.pop(None, None)
        keys, values = [-2, -1, *df], [n, total, *df.values()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(values, pa.int64())], ["term", "n"])

    found = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {r["term"]: r["n"] for r in found.collect()}  # one row for each term of the queries, which are at hand
    df = np.zeros(len(numbers), np.int64)
    for term, n in counts.items():
        if term >= 0:
            df[term] = n
    return counts.get(-2, 0), counts.get(-1, 0), df


def rank(
    docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the k documents that score highest for each item.

    Items without a term or without any match give no rows, null texts have no terms.
    Equal scores go by the smaller ``doc_id``. Rows without an id take no part, neither as
    documents nor as items. Repeated documents count as often as they stand there, also as
    results; an item id given in several rows is asked with all its different texts together.
    Queries are asked in blocks, each of bounded size, with two passes over the documents.
    """
    spark = docs.sparkSession
    rows = common.documents(docs, id_col, text_col).where("doc_id is not null")
    asked = items.select(items[item_col].cast("long").alias("item_id"), F.coalesce(items[item_text].cast("string"), F.lit("")).alias("text"))
    size = asked.agg(F.countDistinct("item_id").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    blocks = max(1, -(-size["n"] // PASS_ITEMS), -(-(size["b"] or 0) // PASS_BYTES))
    asked = asked.where("item_id is not null").groupBy("item_id").agg(F.array_sort(F.collect_set("text")).alias("texts"))
    found = None
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").collect()
        part = ask(rows, [(r["item_id"], Counter(w for t in r["texts"] for w in terms_of(t))) for r in mine], k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ask(rows: DataFrame, queries: list[tuple[int, Counter]], k: int) -> DataFrame:
    """The k best documents of every task for each query, given as counted terms."""
    numbers: dict[bytes, int] = {}
    for _, terms in queries:
        for term in terms:
            numbers.setdefault(term, len(numbers))
    n, total, df = statistics(rows, numbers)
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    plans = [
        (item, np.array([numbers[t] for t in terms], np.int64), np.array(list(terms.values()), np.int64)) for item, terms in queries if terms
    ]
    shared = rows.sparkSession.sparkContext.broadcast((numbers, weights, plans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight, asked = shared.value
        best = [Best(k) for _ in asked]
        ids, lengths, found, held = [], [], [], 0

        def search() -> None:
            lists = Lists(lengths, found, weight, n, total)
            numbers_ = np.array(ids, np.int64)
            for (_, terms, times), b in zip(asked, best):
                lists.search(terms, times, b, numbers_)

        for part in common.slices(batches):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                words = terms_of(text)
                counts = Counter(map(known.get, words))
                counts.pop(None, None)
                if counts:
                    ids.append(doc_id)
                    lengths.append(len(words))
                    found.append(counts)
                held += len(text)
                if held > BLOCK_BYTES:
                    search()
                    ids, lengths, found, held = [], [], [], 0
        if ids:
            search()
        sizes = [len(b.ids) for b in best]
        item = np.repeat(np.array([a[0] for a in asked], np.int64), sizes)
        both = [np.concatenate([np.zeros(0, np.int64), *[getattr(b, f) for b in best]]) for f in ("ids", "scores")]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (item, *both)], ["item_id", "doc_id", "score"])

    return rows.mapInArrow(run, "item_id long, doc_id long, score long")


def sql(k: int = K) -> str:
    """The same by scoring every document that shares a term."""
    cut = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
    terms = f"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{cut}'))"
    return f"""
WITH t AS (SELECT doc_id, row, {terms} term FROM (SELECT doc_id, text, row_number() OVER () AS row FROM documents WHERE doc_id IS NOT NULL)),
p AS (SELECT doc_id, row, term, count(*) tf FROM t GROUP BY ALL),
d AS (SELECT row, sum(tf)::BIGINT n FROM p GROUP BY ALL),
s AS (SELECT count(*) docs, sum(n)::BIGINT words FROM d),
i AS (SELECT item_id, term, count(*) times FROM (SELECT item_id, {terms} term FROM
      (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT w FROM (SELECT term, count(*) df FROM p GROUP BY ALL), s),
x AS (SELECT item_id, doc_id, p.row, times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))) part
      FROM i JOIN p USING (term) JOIN w USING (term) JOIN d ON p.row = d.row, s),
y AS (SELECT item_id, doc_id, sum(part)::BIGINT score FROM x GROUP BY item_id, doc_id, row),
z AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM y WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM z WHERE rank <= {k}"""
