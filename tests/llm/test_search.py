"""Ranked lexical search and hard negatives against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terrachron.llm import lexical, negatives

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERMS.findall((text or "").translate(UPPER))


def brute_rank(docs, items, k):
    """Every document against every item, by the formula."""
    counted = [(i, Counter(terms(t))) for i, t in docs if i is not None and terms(t)]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    found = []
    texts = {}
    for item, text in items:
        if item is not None:
            texts.setdefault(item, set()).add(text or "")
    for item, mine in texts.items():
        asked = Counter(t for text in mine for t in terms(text))
        scored = []
        for doc, c in counted:
            m = 25 + (75 * sum(c.values()) * n) // total
            score = sum(
                r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                for t, r in asked.items()
                if c[t]
            )
            if score > 0:
                scored.append((-score, doc))
        found += [(item, rank, doc, -score) for rank, (score, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(found)


@pytest.mark.parametrize("short, candidates, block", [(1 / 16, 512, 1 << 24), (0.5, 7, 3_000), (0.0, 3, 3_000), (1.0, 16, 500)])
def test_lexical_against_brute_force(spark, monkeypatch, short, candidates, block):
    """Skewed vocabularies, ties, blocks and skipping; odd rows of every kind."""
    monkeypatch.setattr(lexical, "SHORT_SHARE", short)
    monkeypatch.setattr(lexical, "CANDIDATES", candidates)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    draw = random.Random(7)
    vocabulary = [f"w{k}" for k in range(60)] + ["ÄRGER", "Ärger", "z９", "x_y", " sep"]
    text = lambda n: " ".join(vocabulary[min(len(vocabulary) - 1, int(draw.expovariate(0.08)))] for _ in range(n))
    docs = [(k, text(draw.randrange(1, 60))) for k in range(300)]
    docs += [(400, None), (401, ""), (402, "... \x7f--"), (403, docs[3][1]), (403, docs[3][1]), (2, docs[2][1]), (None, "w1 w2")]
    docs += [(404, text(30_000)), (405, "W1 w1\x00w1")]
    items = [(k, text(8)) for k in range(20)] + [(30, None), (31, "unheard"), (32, "w0 w0 w0 w1"), (None, "w1"), (3, None), (5, "w40 w41"), (32, "w0 w0 w0 w1")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("rank", F.lit("x")).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(9))
    got = lexical.rank(frame, asked, k=5)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, got.collect())) == brute_rank(docs, items, 5)


def test_lexical_in_passes_and_empty(spark, monkeypatch):
    """Items in several passes; empty tables on either side."""
    docs = [(k, f"a b{k % 3} c{k}") for k in range(12)]
    items = [(k, f"b{k % 3} c{k}") for k in range(9)]
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical, "PASS_ITEMS", 4)
    assert sorted(map(tuple, lexical.rank(frame, asked).collect())) == brute_rank(docs, items, 10)
    assert lexical.rank(frame.limit(0), asked).count() == 0
    assert lexical.rank(frame, asked.limit(0)).count() == 0
    assert lexical.rank(frame.where("doc_id < 0"), asked.where("item_id < 0")).count() == 0


def brute_negatives(rows, every):
    """Every anchor against every row, in whole numbers."""
    kept = set()
    for vec_id, vector, label in rows:
        if vec_id is not None and vector is not None and label is not None and all(x is not None and math.isfinite(x) for x in vector):
            kept.add((vec_id, label, tuple(max(-(1 << 24), min(1 << 24, math.floor(256 * x))) for x in vector)))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    found = []
    for anchor, label, vector in kept:
        if anchor % every:
            continue
        scored = sorted((-dot(vector, q), i, other == label) for i, other, q in kept)
        for p, i, _ in [x for x in scored if x[2] and x[1] != anchor][:5]:
            fits = [x for x in scored if not x[2] and 80 * -p <= 100 * -x[0] <= 100 * -p][:5]
            found += [(anchor, i, rank, x[1], -p, -x[0]) for rank, x in enumerate(fits, 1)]
    return sorted(found)


@pytest.mark.parametrize("shard_rows, leaf, fan, block", [(10_000, 64, 16, 50_000), (40, 4, 2, 3), (7, 1, 2, 50_000)])
def test_negatives_against_brute_force(spark, monkeypatch, shard_rows, leaf, fan, block):
    """Clusters, copies under many ids and labels, ties, and odd rows, with tiles and shards of any size."""
    for name, value in (("LEAF", leaf), ("FAN", fan), ("QUERY_BLOCK", block)):
        monkeypatch.setattr(negatives, name, value)
    draw = random.Random(3)
    centres = [[draw.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(k, [c + draw.gauss(0, 0.3) for c in centres[k % 4]], (k + (k % 3 == 0)) % 4) for k in range(160)]
    rows += [(200 + k, rows[5][1], k % 2) for k in range(60)]  # one vector, two labels, many ids
    rows += [(300 + k, [round(x) for x in rows[k][1]], k % 3) for k in range(40)]  # equal scores
    nan, inf = float("nan"), float("inf")
    rows += [(400, None, 1), (401, [nan] * 6, 1), (402, [inf] + [0.0] * 5, 1), (403, [1.0, None, 0, 0, 0, 0], 1), (404, [1.0] * 6, None)]
    rows += [(None, [1.0] * 6, 1), (410, [0.0] * 6, 2), (420, [1e9, -1e9, 0, 0, 0, 0], 3), (430, [-1e9, 1e9, 0, 0, 0, 0], 3), (440, [1e9, 0.5, 0, 0, 0, 0], 2)]
    rows += [(450, [1.0, 2.0], 1), (460, [], 1), (0, rows[0][1], rows[0][2]), (461, [-x for x in centres[0]], 7)]
    rows = [(i, v and [x if x is None else float(x) for x in v], label) for i, v, label in rows]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, rank int").repartition(3)
    found = negatives.mine(frame, lambda i: i % 10 == 0, F.col("label"), shard_rows=shard_rows)
    got = sorted(map(tuple, found.collect()))
    assert got == brute_negatives(rows, 10) and len(got) > 300


def test_negatives_without_rows(spark):
    frame = spark.createDataFrame([(100, [1.0, 2.0], 1), (101, [1.0, 2.0], 2)], "vec_id long, embedding array<float>, label int")
    mine = lambda f: negatives.mine(f, lambda i: i % 100 == 0, F.col("label")).count()
    assert mine(frame.limit(0)) == 0 and mine(frame) == 0 and mine(frame.where("vec_id = 101")) == 0
