"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters inside words: a word is its characters and an end, each
predicted from the four before it. Counts, contexts, discounts and probabilities are
grouped and joined as tables, sharded by n-gram. Documents meet the tables in blocks:
a block asks for the distinct n-grams of its words, the join answers, and the answers
come back to the block, so traffic follows distinct n-grams and not running text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from terrachron.llm import common, graph
from terrachron.session import materialize

ORDER = 5
#: Marks that no word can hold.
BEGIN, END = "\n", " "
BLOCK_CHARS = 38_000_000
#: Distinct words a task holds while counting; bounds memory, not results.
MEMORY_WORDS = 500_000
#: Documents above this quantile of trusted text of their language are rejected.
QUANTILE = 0.995


def count_grams(trusted: DataFrame, text_col: str = "text", memory_words: int = MEMORY_WORDS) -> DataFrame:
    """Counts of the longest n-gram that ends at each character: ``gram``, ``a``.

    A task counts its words first and then their n-grams, so that few rows are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        for part in common.slices(batches):
            for text in part.column("text").to_pylist():
                words.update(common.split_words(text))
            if len(words) > memory_words:
                yield grams_of(words)
                words = Counter()
        yield grams_of(words)

    def grams_of(words: dict[str, int]) -> pa.RecordBatch:
        grams: dict[str, int] = {}
        for word, n in words.items():
            marked = f"{BEGIN}{word}{END}"
            for j in range(2, len(marked) + 1):
                gram = marked[max(0, j - ORDER) : j]
                grams[gram] = grams.get(gram, 0) + n
        return pa.RecordBatch.from_arrays([pa.array(grams.keys(), pa.string()), pa.array(grams.values(), pa.int64())], ["gram", "n"])

    rows = trusted.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("a"))


def discounts(table: DataFrame) -> dict[int, tuple[float, float, float]]:
    """The three discounts of each order, from the counts of counts; kept off 0, so that every context leaves something."""
    rows = table.groupBy("order").agg(*[F.sum(F.when(F.col("a") == k, 1).otherwise(0)).alias(f"n{k}") for k in (1, 2, 3, 4)])
    found = {}
    for r in rows.collect():  # one row for each order
        n1, n2, n3, n4 = (r[f"n{k}"] for k in (1, 2, 3, 4))
        if min(n1, n2, n3, n4) > 0:
            y = n1 / (n1 + 2 * n2)
            values = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        else:
            values = (0.5, 1.0, 1.5)
        found[r["order"]] = tuple(min(max(v, 0.1), k * 0.9) for k, v in enumerate(values, 1))
    return found


def train(trusted: DataFrame, text_col: str = "text", memory_words: int = MEMORY_WORDS) -> DataFrame:
    """The model as a table: ``gram``, ``alpha`` (its discounted share in its context) and ``gamma``
    (what its context leaves to shorter ones, for the n-gram as a context); each may be null.

    The empty n-gram holds the number of symbols as ``alpha``. Counts of orders below
    the longest are numbers of different characters before, except at a word's begin.
    """
    top, top_path = graph.write(count_grams(trusted, text_col, memory_words).withColumn("order", F.length("gram")), "grams")
    tables = [top.where(F.col("order") == ORDER)]
    for order in range(ORDER - 1, 0, -1):
        shorter = tables[-1].groupBy(F.substring("gram", 2, order).alias("gram")).agg(F.count("*").alias("a"))
        own = top.where(F.col("order") == order).select("gram", "a", "order")
        tables.append(shorter.withColumn("order", F.length("gram")).unionByName(own))
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    whole, whole_path = graph.write(whole, "counts")
    cut = discounts(whole)

    def discount(a: Column) -> Column:
        value = F.lit(0.0)
        for order, three in cut.items():
            own = F.when(a == 1, three[0]).when(a == 2, three[1]).otherwise(three[2])
            value = F.when(F.col("order") == order, own).otherwise(value)
        return value

    context = F.expr("substring(gram, 1, length(gram) - 1)")
    parts = whole.withColumn("context", context).withColumn("d", discount(F.col("a")))
    contexts = parts.groupBy("context").agg(F.sum("a").alias("total"), (F.sum("d") / F.sum("a")).alias("gamma"))
    shares = parts.join(contexts, "context").select("gram", ((F.col("a") - F.col("d")) / F.col("total")).alias("alpha"))
    known = shares.join(contexts.select(F.col("context").alias("gram"), "gamma"), "gram", "full")
    symbols = whole.where("order = 1").agg(F.count("*").cast("double").alias("n"))
    size = symbols.select(F.lit("").alias("gram"), F.col("n").alias("size"))
    known = known.join(size, "gram", "left").select("gram", F.coalesce("alpha", "size").alias("alpha"), "gamma")
    model = materialize(known, "model")
    graph.remove(top, top_path)
    graph.remove(whole, whole_path)
    return model


def top_grams(words) -> set[str]:
    """The longest n-gram that ends at each character of each word."""
    found: set[str] = set()
    for word in words:
        marked = f"{BEGIN}{word}{END}"
        found.update([marked[max(0, j - ORDER) : j] for j in range(2, len(marked) + 1)])
    return found


def asked(grams: set[str]) -> set[str]:
    """What their probabilities need: the n-grams, their contexts, and all of these in shorter contexts."""
    found: set[str] = {""}
    for gram in grams:
        while gram not in found:
            found.add(gram)
            gram = gram[1:]
    return found | {gram[:-1] for gram in found}


class Model(dict):
    """Log probabilities of words from the answers to a block's n-grams."""

    def __init__(self, alpha: dict[str, float], gamma: dict[str, float]):
        super().__init__()
        self.alpha, self.gamma = alpha, gamma
        self.base = 1 / (1 + alpha.get("", 0.0))
        self.known: dict[str, float] = {}

    def probability(self, gram: str) -> float:
        if not gram:
            return self.base
        p = self.known.get(gram)
        if p is None:
            p = self.alpha.get(gram, 0.0) + self.gamma.get(gram[:-1], 1.0) * self.probability(gram[1:])
            self.known[gram] = p
        return p

    def __missing__(self, word: str) -> float:
        marked = f"{BEGIN}{word}{END}"
        total = sum(math.log(self.probability(marked[max(0, j - ORDER) : j])) for j in range(2, len(marked) + 1))
        self[word] = total
        return total


def score(
    docs: DataFrame, model: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """``doc_id``, ``lang``, ``n_symbols`` (characters and word ends) and ``perplexity`` of each row.

    A text without words has no symbols and a null perplexity. A null language is ``und``.
    """
    rows = common.documents(docs, id_col, text_col, lang=lang_col)
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, round(total / block_chars)))).cast("int")
    rows = rows.select("doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), block.alias("block"))
    rows = rows.repartition("block")

    def ask(table: pa.Table) -> pa.Table:
        words: set[str] = set()
        for text in table.column("text"):
            words.update(common.split_words(text.as_py()))
        grams = list(asked(top_grams(words)))
        block_ = table.column("block")[0].as_py()
        return pa.table({"block": pa.array(np.full(len(grams), block_, np.int32)), "gram": pa.array(grams, pa.string())})

    def answer(block_: pa.Table, answers: pa.Table) -> pa.Table:
        grams = answers.column("gram").to_pylist()
        pairs = [dict((g, v) for g, v in zip(grams, answers.column(c).to_pylist()) if v is not None) for c in ("alpha", "gamma")]
        words_ = Model(*pairs)
        sizes, values = [], []
        for text in block_.column("text"):
            words = common.split_words(text.as_py())
            n = sum(map(len, words)) + len(words)
            sizes.append(n)
            values.append(math.exp(min(700.0, -sum(map(words_.__getitem__, words)) / n)) if n else None)
        return pa.table(
            {"doc_id": block_.column("doc_id"), "lang": block_.column("lang"), "n_symbols": pa.array(sizes, pa.int64()), "perplexity": pa.array(values, pa.float64())}
        )

    wanted = rows.groupBy("block").applyInArrow(ask, "block int, gram string")
    given = wanted.join(model, "gram").select("block", "gram", F.col("alpha").cast("float"), F.col("gamma").cast("float"))
    kind = "doc_id long, lang string, n_symbols long, perplexity double"
    return rows.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(answer, kind)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    quantile: float = QUANTILE,
    lang_col: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    block_chars: int = BLOCK_CHARS,
    memory_words: int = MEMORY_WORDS,
) -> DataFrame:
    """``doc_id``, ``lang``, ``n_symbols``, ``perplexity``, ``threshold``, ``kept`` of each row.

    Trusted documents are those labelled 1. Four folds of five train the model, all of
    their text; the fifth gives the quantiles of each language. A document above its
    language's threshold is rejected. Without a threshold (no trusted text to measure), or without
    words, a document is kept. Repeated rows and labels change nothing but weights.
    ``block_chars`` and ``memory_words`` bound what a task holds, and change no result but for rounding.
    """
    trusted = labels.where(labels[label_col] == 1).select(labels[id_col].cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    trusted = materialize(trusted, "trusted")
    learned = common.small(trusted.where(~common.held_out("doc_id")))
    texts = common.documents(docs, id_col, text_col)
    model = train(texts.join(learned, "doc_id", "left_semi"), memory_words=memory_words)
    scores = materialize(score(docs, model, lang_col, id_col, text_col, block_chars), "perplexities")
    measured = scores.where("perplexity is not null").join(common.small(trusted.where(common.held_out("doc_id"))), "doc_id", "left_semi")
    level = lambda: F.percentile_approx("perplexity", quantile, 10_000)
    by_lang = measured.groupBy("lang").agg(level().alias("threshold"))
    found = scores.join(common.small(by_lang), "lang", "left")
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return found.select("doc_id", "lang", "n_symbols", "perplexity", "threshold", kept.alias("kept"))
