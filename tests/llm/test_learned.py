"""Operators that learn: held-out accuracy, gradients, probabilities, and the pipeline."""

import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrachron.llm import common, language, perplexity, queries, toxicity
from test_exact import brute_substring, words

FOLDER = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    found = queries.QUERIES["op2_language_id"](spark, FOLDER).join(docs, "doc_id").where("held_out").toPandas()
    assert (found["lang_pred"] == found["lang"]).mean() > 0.97
    assert found["score"].between(0, 1).all()


def test_language_spans_and_odd_rows(spark, odd, nothing):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language.train(docs)
    texts = {r.lang: r.text for r in docs.where("n_chars > 1500").orderBy("doc_id").collect()}
    de, fr = (" ".join(words(texts[k])[:100]) for k in ("de", "fr"))
    mixed = spark.createDataFrame([(1, f"{de} {fr}")], "doc_id long, text string")
    spans = language.spans(mixed, model).first().spans
    assert [s.lang for s in spans] == ["de", "fr"] and abs(spans[0].stop - 100) < 4
    for frame in (odd, nothing):
        found = language.spans(frame, model).collect()
        assert len(found) == frame.count()
        for r in found:
            if r.doc_id in (1, 2, 3, 7):
                assert (r.lang, r.score, r.spans) == ("und", 0.0, [])
    empty = language.train(nothing)
    assert {r.lang for r in language.spans(odd, empty).collect()} == {"und"}


@pytest.mark.parametrize("switch", [0.5, 3.0])
def test_viterbi_finds_the_best_path(switch):
    r = np.random.default_rng(1)
    sizes = [0, 1, 5, 127, 128, 129, 300, 1000, 0, 2]
    ends = np.cumsum(sizes)
    scores = (r.normal(size=(int(ends[-1]), 3)) * 2).astype(np.float32)
    path = language.viterbi(scores, ends, switch)
    for n, end in zip(sizes, ends):
        own, e = path[end - n : end], scores[end - n : end].astype(float)
        if not n:
            continue
        best = e[0]
        for t in range(1, n):
            best = np.maximum(best, best.max() - switch) + e[t]
        value = e[np.arange(n), own].sum() - switch * np.count_nonzero(np.diff(own))
        assert abs(value - best.max()) < 1e-2


def test_scripts():
    letters, script = language.word_scripts(["abc,", "при", "123", "中文", "-α"])
    assert letters.tolist() == [3, 3, 0, 2, 1] and script.tolist() == [1, 3, -1, 14, 2]


def test_gradients():
    w = toxicity.Words()
    index, _ = toxicity.windows(w.number(["a bb ccc bad dd", "awful ee f " * 70, "gg"]))
    network = toxicity.Network()
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    labels = np.array([1.0, 0, 1, 0, 1, 0])[: len(index)]

    def loss():
        p = toxicity.sigmoid(network.forward(network.project(network.inputs(w).astype(np.float64)), index))
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    found = network.gradients(w, index, labels)
    for name in set(network.p) - {"hint"}:
        values = network.p[name]
        at = np.unravel_index(np.abs(found[name]).argmax(), values.shape)
        kept, step = values[at], 1e-4
        values[at] = kept + step
        above = loss()
        values[at] = kept - step
        below = loss()
        values[at] = kept
        assert math.isclose(found[name][at], (above - below) / 2 / step, rel_tol=0.05, abs_tol=1e-6), name


def test_windows_cover_all_words():
    rows = [np.arange(1, n + 1) for n in (0, 1, 127, 128, 129, 500)]
    index, owner = toxicity.windows(rows)
    for k, row in enumerate(rows):
        assert set(index[owner == k].ravel()) - {0} == set(row.tolist())


def test_toxicity_held_out(spark, odd, nothing):
    """Insults of a few words, one of which may also stand alone in a clean text."""
    r = np.random.default_rng(3)
    plain = [f"{a}{b}" for a, b in itertools.product(("ta", "mo", "ri", "sel", "ko"), ("na", "lu", "ven", "tor", "is"))]
    bad = ["grobnok", "vilstup", "drekhan"]
    rows, labels = [], []
    for i in range(500):
        text = list(r.choice(plain, r.integers(20, 300)))
        toxic = i % 3 == 0
        for _ in range(r.integers(3, 6) if toxic else r.integers(0, 10) // 9):
            text.insert(int(r.integers(0, len(text))), str(r.choice(bad)))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    learned = toxicity.train(docs.where(~common.held_out("doc_id")), marks)
    found = toxicity.score(docs, learned).join(marks, "doc_id").where(common.held_out("doc_id")).toPandas()
    assert (found["predicted"] == found["toxic"]).mean() > 0.9
    for frame in (odd, nothing):
        scores = toxicity.score(frame, learned).collect()
        assert len(scores) == frame.count() and all(0 <= s.score <= 1 for s in scores)
    alone = toxicity.train(docs, marks.where("toxic = 0"))
    assert {s.predicted for s in toxicity.score(odd, alone).collect()} == {0}


def brute_model(texts):
    """Interpolated modified Kneser-Ney by plain counting; returns the probability of a symbol after a context."""
    counts = Counter()
    for text in texts:
        for w in words(text):
            m = f"\n{w} "
            for j in range(2, len(m) + 1):
                counts[m[max(0, j - 5) : j]] += 1
    adjusted = dict(counts)
    level = [g for g in counts if len(g) == 5]
    for order in range(4, 0, -1):
        before = defaultdict(set)
        for g in level:
            before[g[1:]].add(g[0])
        adjusted.update({g: len(x) for g, x in before.items()})
        level = list(before) + [g for g in counts if len(g) == order]
    cut = {}
    for order in range(1, 6):
        n = Counter(a for g, a in adjusted.items() if len(g) == order)
        if min(n[1], n[2], n[3], n[4]) > 0:
            y = n[1] / (n[1] + 2 * n[2])
            three = (1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3])
        else:
            three = (0.5, 1.0, 1.5)
        cut[order] = [min(max(v, 0.1), k * 0.9) for k, v in enumerate(three, 1)]
    follow = defaultdict(dict)
    for g, a in adjusted.items():
        follow[g[:-1]][g[-1]] = a
    size = 1 + len(follow[""])

    def probability(context, symbol):
        lower = probability(context[1:], symbol) if context else 1 / size
        known = follow.get(context)
        if not known:
            return lower
        three, total = cut[len(context) + 1], sum(known.values())
        d = lambda a: three[min(a, 3) - 1]
        own = known.get(symbol, 0)
        return (own - d(own) if own else 0) / total + sum(map(d, known.values())) / total * lower

    return probability


def brute_perplexity(probability, text):
    logs = []
    for w in words(text):
        m = f"\n{w} "
        logs += [math.log(probability(m[max(0, j - 4) : j], m[j])) for j in range(1, len(m))]
    return math.exp(-sum(logs) / len(logs)) if logs else None


def test_perplexity_equals_brute_force(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    trusted = docs.where("n_chars < 1500 and doc_id % 3 = 0")
    model = perplexity.train(trusted)
    probability = brute_model([r.text for r in trusted.collect()])
    for frame in (docs.where("n_chars < 1000"), odd):
        for blocks in (1_000_000, 4_000):
            found = perplexity.score(frame, model, block_chars=blocks).collect()
            texts = Counter((r.doc_id, r.text) for r in frame.collect())
            assert len(found) == sum(texts.values())
            want = defaultdict(list)
            for (doc, text), n in texts.items():
                want[doc] += [brute_perplexity(probability, text)] * n
            for r in found:
                assert any(r.perplexity == x or (x and r.perplexity and math.isclose(r.perplexity, x, rel_tol=1e-4)) for x in want[r.doc_id])
    assert perplexity.score(nothing, model).count() == 0
    known = {r.gram: r for r in model.collect()}
    answers = perplexity.Model(*[{k: v[c] for k, v in known.items() if v[c] is not None} for c in ("alpha", "gamma")])
    symbols = [k for k, v in known.items() if len(k) == 1 and v.alpha is not None]
    for context in ("\n", "", "\nth", "zz"):
        assert math.isclose(sum(answers.probability(context + s) for s in symbols) + answers.probability(context + "§"), 1, rel_tol=1e-9)


def test_classifier_separates_labels(spark, odd, nothing):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    found = queries.QUERIES["op7_perplexity"](spark, FOLDER).join(labels, "doc_id").toPandas()
    assert found[found["quality"] == 1]["kept"].mean() > 0.98
    assert found[found["quality"] == 0]["kept"].mean() < 0.4
    for frame in (odd, nothing):
        assert perplexity.classify(frame, labels.limit(0)).where("kept").count() == frame.count()


def test_rare_languages_are_judged_by_themselves(spark):
    """German with a few trusted documents, Spanish with none beside a large English part."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("n_chars between 300 and 4000")
    good = spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1")
    rows = {r.doc_id: r.lang for r in docs.join(good, "doc_id").select("doc_id", "lang").collect() if r.lang in ("en", "de", "es")}
    german = [d for d, lang in rows.items() if lang == "de"]
    held = [r.doc_id for r in spark.createDataFrame([(d,) for d in german], "doc_id long").where(common.held_out("doc_id")).collect()]
    trusted = [d for d, lang in rows.items() if lang == "en"] + held[:3]
    marks = spark.createDataFrame([(d, 1) for d in trusted], "doc_id long, quality int")
    chosen = docs.join(spark.createDataFrame([(d,) for d in rows], "doc_id long"), "doc_id")
    found = {r.doc_id: r for r in perplexity.classify(chosen, marks).collect()}
    own = max(found[d].perplexity for d in held[:3])
    assert all(math.isclose(found[d].threshold, own, rel_tol=1e-6) and found[d].kept == (found[d].perplexity <= own) for d in german)
    assert all(found[d].threshold is None and found[d].kept for d, lang in rows.items() if lang == "es")


def test_viterbi_with_many_labels():
    """Labels beyond one byte do not wrap round."""
    scores = np.zeros((400, 300))
    scores[:150, 299], scores[150:, 257] = 1.0, 1.0
    path = language.viterbi(scores, np.array([400]), 5.0)
    assert path.tolist() == [299] * 150 + [257] * 250


def brute_kept(pairs):
    """First documents of the components of texts whose five-word shingles are similar by 0.8 or more."""
    lower = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in words(t or "")]
    grams = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := lower(t)) else set() for _, t in pairs]
    root = list(range(len(pairs)))
    for i, j in itertools.combinations(range(len(pairs)), 2):
        both = len(grams[i] & grams[j])
        if both >= 0.8 * (len(grams[i]) + len(grams[j]) - both):
            root = [root[i] if x == root[j] else x for x in root]
    first: dict = {}
    for (doc_id, _), x in zip(pairs, root):
        first[x] = min(doc_id, first.get(x, doc_id))
    return set(first.values())


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Planted cases: noise, a boilerplate line, exact and near copies, a shared passage."""
    source = spark.read.parquet(f"{FOLDER}/documents.parquet").where("lang = 'en'")
    good = spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1 and toxic = 0")
    texts = [r.text for r in source.join(good, "doc_id", "left_semi").orderBy("doc_id").collect() if 60 < len(words(r.text)) < 400]
    distinct = list(dict.fromkeys(texts))[:120]
    passage = " ".join(f"planted{k} passage{k % 7}" for k in range(40))
    rows = [(i, t, "en", f"s{i % 2}") for i, t in enumerate(distinct)]
    rows = [(i, t + ("\nClick for more of this." if i % 4 == 0 else ""), x, s) for i, t, x, s in rows]
    noise = [(500 + i, "#$%& " * 50, "en", "s0") for i in range(3)]
    copies = [(600, distinct[3], "en", "s1"), (601, distinct[5] + " tail.", "en", "s1")]
    shared = [(700 + i, f"{distinct[30 + i][:300]}\n{passage}", "en", "s0") for i in range(2)]
    rows = rows + noise + copies + shared + [(800, None, None, None)]
    folder = str(tmp_path / "tables")
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows[:100]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality_classifier", "line_dedup", "near_dedup", "substring_dedup", "packing"]
    known = dict(corpus_pipeline.STAGES)
    first = known["quality_classifier"](spark, docs, folder)
    left = {r.doc_id for r in first.collect()}
    assert first.columns == docs.columns and not left & {500, 501, 502}
    assert len(left & set(range(len(distinct)))) >= 0.93 * len(distinct) and 800 in left
    second = known["line_dedup"](spark, docs, folder)
    assert second.columns == docs.columns and second.count() == docs.count()
    assert not second.where(F.col("text").contains("Click for more")).count()
    third = known["near_dedup"](spark, docs, folder)
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id for r in third.collect()} == brute_kept(pairs)
    fourth = {r.doc_id: r for r in known["substring_dedup"](spark, docs, folder).collect()}
    for doc, (_, _, text) in brute_substring(pairs).items():
        assert " ".join(words(fourth[doc].text)) == text
    assert "planted39" in fourth[700].text and "planted39" not in fourth[701].text
    result = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in result.collect()} <= left
