"""Operators with one right answer, against brute force, SQL or the tokenizers library."""

import hashlib
import random
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from terrachron import session
from terrachron.llm import binary_search, bpe, graph, lines, packing, quality, queries, shingles, simhash, substring

PATH = public_tokenizers.path("byte_bpe_50k.json")
FOLDER = "/root/testdata/sf0.001"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("name", ["op1_quality_rules", "op5_line_dedup", "op10_top_k"])
def test_queries_with_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    frame = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted(map(tuple, frame.select(*columns).collect()))
    assert got == sorted(duck.execute(f"SELECT {','.join(columns)} FROM ({queries.ORACLE[name]})").fetchall())


@pytest.mark.parametrize("name", ["quality", "lines"])
def test_odd_rows_with_sql(odd, name):
    documents = odd.toPandas()  # noqa: F841 - read by name below
    if name == "quality":
        frame, sql = quality.measure(odd).drop("clean_text"), quality.sql()
    else:
        frame = lines.deduplicate(odd, min_pages=2).withColumn("kept_sha256", F.sha2("text", 256)).drop("text")
        sql = lines.sql(min_pages=2)
    columns = sorted(frame.columns)
    key = lambda r: str(tuple(r))
    got = sorted(map(tuple, frame.select(*columns).collect()), key=key)
    duck = duckdb.connect()
    duck.register("documents", documents[["doc_id", "text", "source"]].assign(doc_id=documents["doc_id"].astype("Int64")))
    assert got == sorted(duck.execute(f"SELECT {','.join(columns)} FROM ({sql})").fetchall(), key=key)


def test_repeated_words_by_hand(spark):
    frame = spark.createDataFrame([(1, "a b c d e x a b c d e"), (2, "q " * 7), (3, "a b c d e f")], "doc_id long, text string")
    assert {r.doc_id: r.n_repeat_words for r in quality.measure(frame).collect()} == {1: 10, 2: 7, 3: 0}


def test_boilerplate_on_a_part_of_a_source_goes(spark):
    """A line on 5 to 10 % of each of five sources goes; one on four pages, and lines of single pages, stay."""
    rows = []
    for share in (5, 6, 7, 8, 10):
        for k in range(200):
            text = f"Own line {share} of {k}."
            text += "\nMore of our offers." if k * share // 100 != (k - 1) * share // 100 else ""
            text += "\nSeldom seen." if k < 4 else ""
            rows.append((share * 1000 + k, text, f"s{share}"))
    found = lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    count = lambda line: found.where(F.col("text").contains(line)).count()
    assert (count("More of our offers"), count("Seldom seen"), count("Own line")) == (0, 20, 1000)


def test_lines_by_salt_equal_broadcast(odd, spark):
    pages = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("host"))
    drop = lines.boilerplate(pages.select("host", F.transform(F.split("text", "\n"), lines.line_key).alias("keys")), 0.1, 2)
    both = [sorted(map(str, lines.with_lists(pages, drop, n).select("doc_id", "drop").collect())) for n in (0, 1000)]
    assert both[0] == both[1]


def test_encoding_equals_the_library(library):
    r = random.Random(5)
    letters = [*"ab c  \n\t'sdé中　١²\U0001f600123", "<|endoftext|>", "aaaa", "'ll", "  ", "word"]
    texts = ["".join(r.choices(letters, k=r.randint(0, 60))) for _ in range(500)] + ["", "a" * 5000, "ab" * 3000, " " * 3000]
    encoder = bpe.Encoder(bpe.read_vocabulary(PATH))
    for _ in range(2):  # the second time from memory
        ids, sizes, _rows = encoder.encode(texts)
        ends = np.cumsum(sizes)
        for text, n, end in zip(texts, sizes, ends):
            own = ids[end - n : end]
            assert own.tolist() == library.encode(text, add_special_tokens=False).ids
            assert encoder.decode(own).decode() == text


def test_digests_and_lists(odd, nothing, library):
    for frame in (odd, nothing):
        texts = [(r.doc_id, r.text or "") for r in frame.collect()]
        ids = [library.encode(t, add_special_tokens=False).ids for _, t in texts]
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want = [(d, len(i), sha(",".join(map(str, i)).encode()), sha(t.encode()), True) for (d, t), i in zip(texts, ids)]
        assert sorted(map(str, map(tuple, bpe.digests(frame, PATH).collect()))) == sorted(map(str, want))
        encoded = bpe.encode(frame, PATH)
        assert sorted(str((r.doc_id, r.ids)) for r in encoded.collect()) == sorted(str((d, i)) for (d, _), i in zip(texts, ids))
        back = bpe.decode(encoded, PATH)
        assert sorted(str(tuple(r)) for r in back.collect()) == sorted(map(str, texts))


def test_packing(odd, nothing, library, spark):
    assert packing.pack(nothing, PATH).count() == 0
    for frame, window in ((odd, 2048), (spark.read.parquet(f"{FOLDER}/documents.parquet"), 2048), (odd, 64)):
        pieces = packing.pack(frame, PATH, window).toPandas()
        docs = {}
        for r in frame.collect():
            docs.setdefault(r.doc_id, []).append([*library.encode(r.text or "", add_special_tokens=False).ids, 1])
        for p in pieces.itertuples():
            key = None if p.doc_id != p.doc_id else p.doc_id
            assert any(
                len(d) == p.doc_tokens and zlib.crc32(np.array(d[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
                for d in docs[key]
            )
        assert pieces["length"].sum() == sum(len(d) for own in docs.values() for d in own)
        pieces = pieces.sort_values(["sequence_id", "offset"])
        ends = pieces["offset"] + pieces["length"]
        assert (pieces["offset"] == ends.groupby(pieces["sequence_id"]).shift(fill_value=0)).all()
        assert ends.max() <= window


def test_best_fit_takes_the_tightest():
    sequences, offsets, used = packing.best_fit([6, 5, 4, 3, 2], 10)
    assert (sequences, offsets, used) == ([0, 1, 0, 1, 1], [0, 0, 6, 5, 8], 2)


def test_a_large_share_is_packed_as_one(spark):
    """Long pieces come first, and the short ones that fill their windows 150,000 rows later."""
    rows = spark.range(300_000).select(
        F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.when(F.col("id") % 2 == 0, 1400).otherwise(648).cast("long").alias("length"),
        F.lit(0).cast("long").alias("ids_crc32"), F.lit(1).cast("long").alias("doc_tokens"),
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        found = packing.assign(rows).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.min("offset").alias("low"), F.countDistinct("offset").alias("pieces"))
        assert found.groupBy("n", "low", "pieces").count().collect() == [(2048, 0, 2, 150_000)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def brute_components(texts):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def fingerprint(text):
        w = words((text or "").translate(lower))
        if not w:
            return 0
        hashes = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = np.array([fingerprint(t) for _, t in texts], np.uint64)
    return fps, linked(fps, [d for d, _ in texts])


def linked(fps, ids):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i:] ^ fps[i]) <= 4):
            a, b = find(i), find(i + int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash(odd, nothing, spark):
    assert simhash.near_duplicates(nothing).count() == 0
    for frame in (odd, spark.read.parquet(f"{FOLDER}/documents.parquet")):
        texts = [(r.doc_id, r.text) for r in frame.collect()]
        fps, least = brute_components(texts)
        want = sorted(str((d, f"{int(f):016x}", c)) for (d, _), f, c in zip(texts, fps, least))
        assert sorted(str(tuple(r)) for r in simhash.near_duplicates(frame).collect()) == want
    assert sorted(str(r.doc_id) for r in simhash.keep_one(odd).collect()) == sorted("1 4 5 7 8 9 9 10 11 None None 12".split())


def test_components_of_close_fingerprints(spark):
    """Chains, a dense ball of near fingerprints and strangers: no link is lost."""
    r = random.Random(11)
    centre, values = r.getrandbits(64), set()
    values |= {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for _ in range(150)}
    for _ in range(20):
        x = r.getrandbits(64)
        for _ in range(6):
            values.add(x)
            x ^= sum(1 << b for b in r.sample(range(64), r.choice([3, 4, 5])))
    fps = np.array(sorted(values), np.uint64)
    signed = [int(f) - (1 << 64) if int(f) >> 63 else int(f) for f in fps]
    frame = spark.createDataFrame([(s, 1) for s in signed], "fp long, copies long")
    found = {row.fp: row.root for row in simhash.components_of(frame).collect()}
    want = linked(fps, list(range(len(fps))))
    groups = {}
    for s, c in zip(signed, want):
        groups.setdefault(c, set()).add(found.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_similar_shingles_against_all_pairs(spark, odd, nothing):
    """Words changed here and there in long texts, so that similarity goes from under 0.8 to 1."""
    r = random.Random(6)
    rows = []
    for group in range(12):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randint(60, 500))]
        for k in range(8):
            own = [f"x{r.randrange(3000)}" if r.random() < k * 0.006 else w for w in base]
            rows.append((group * 8 + k, " ".join(own)))
    found = dict(shingles.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    grams = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    root = list(range(len(rows)))
    linked_ = 0
    for i in range(len(rows)):
        for j in range(i):
            both = len(grams[i] & grams[j])
            if both >= 0.8 * (len(grams[i]) + len(grams[j]) - both):
                linked_ += grams[i] != grams[j]
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    assert linked_ > 30 and found == dict(enumerate(root))
    # 8 and 9 share 56 of 68 shingles
    assert sorted(str(x.doc_id) for x in corpus_pipeline.near_dedup(spark, odd, "").collect()) == sorted("1 4 5 7 8 10 11 None None 12".split())
    assert corpus_pipeline.near_dedup(spark, nothing, "").count() == 0
    frame = spark.createDataFrame([(*x, "en", "s", 1) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {x.doc_id for x in corpus_pipeline.near_dedup(spark, frame, "").collect()} == set(root)


def test_fingerprints_propose_and_similarity_decides(spark, monkeypatch):
    """Where no bands meet, near copies are found by their fingerprints; equal fingerprints of unlike sets are no link."""
    r = random.Random(2)
    rows = []
    for group in range(15):
        base = [f"w{r.randrange(5000)}" for _ in range(600)]
        rows += [(group * 4, " ".join(base)), (group * 4 + 1, " ".join(base[:-1])), (group * 4 + 2, " ".join(base[2:])), (group * 4 + 3, " ".join(base[300:]))]
    phrase = "one two three four five " * 300
    rows += [(100 + k, phrase + " ".join(f"own{k}x{j}" for j in range(30))) for k in range(4)]
    prints = [simhash.fingerprint(t, 5) for _, t in rows]
    near = lambda i, j: bin((prints[i] ^ prints[j]) & (1 << 64) - 1).count("1") <= 4
    assert near(60, 61) and near(60, 62) and near(60, 63)

    def no_bands(docs, shingle, whole):
        found = encoded(docs, shingle, whole)
        return found if whole else found.withColumn("bands", F.array("key"))

    encoded = shingles.encoded
    monkeypatch.setattr(shingles, "encoded", no_bands)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert dict(encoded(frame, 5, False).select("doc_id", "fp").collect()) == {d: p for (d, _), p in zip(rows, prints)}
    found = dict(shingles.near_duplicates(frame).collect())
    sure = {j: i for i in range(0, 60, 4) for j in (i + 1, i + 2) if near(i, j)}
    assert len(sure) > 10 and all(found[j] == i for j, i in sure.items())
    assert all(found[i + 3] == i + 3 for i in range(0, 60, 4)) and all(found[100 + k] == 100 + k for k in range(4))


def test_bands_of_many_sets_at_once():
    """As by a plain minimum over each set, with empty sets between and sets over several chunks."""
    r = np.random.default_rng(4)
    found = [np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (0, 3, 1, 0, 0, 2 * shingles.CHUNK + 5, 40, shingles.CHUNK, 1, 0)]
    got = shingles.bands(found)
    for grams, row in zip(found, got):
        least = np.array([shingles.mix(grams ^ seed).min(initial=(1 << 64) - 1) for seed in shingles._SEEDS], np.uint64)
        key = np.zeros(shingles.BANDS, np.uint64)
        for column in least.reshape(shingles.BANDS, shingles.ROWS).T:
            key = key * shingles._ODD + shingles.mix(column)
        assert row.tolist() == shingles.mix(key).view(np.int64).tolist()


def test_group_a_little_below_the_similarity(spark):
    """Hundreds of texts made from one, most of them less alike than 0.8: few pairs are proposed, and no link is lost."""
    r = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(240):
        changed = set(r.sample(range(150), r.randint(1, 2) if k < 60 else r.randint(3, 6)))
        texts.append(" ".join(f"x{r.randrange(10**6)}" if j in changed else w for j, w in enumerate(base)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    doubtful = shingles.encoded(docs, 5, False).select("key", F.col("doc_id").alias("doc"))
    none = spark.createDataFrame([], "a long, b long")
    links = shingles.links_in_doubt(doubtful, none, graph.components(none), docs, 5, 0.8)
    ids = dict(doubtful.select("key", "doc").collect())
    found = {frozenset((ids[x.a], ids[x.b])) for x in links.collect()}
    grams = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    real = set()
    for i in range(len(texts)):
        for j in range(i):
            both = len(grams[i] & grams[j])
            if both >= 0.8 * (len(grams[i]) + len(grams[j]) - both):
                real.add(frozenset((i, j)))

    def roots(pairs):
        root = list(range(len(texts)))
        for pair in pairs:
            a, b = sorted(root[x] for x in pair)
            root = [a if x == b else x for x in root]
        return root

    assert found <= real and len(real) > 100 and len(set(roots(real))) > 20 and roots(found) == roots(real)
    prefix = shingles.prefixes(shingles.shingle_sets(doubtful, docs, 5), 0.8)
    known = prefix.withColumn("root", F.col("key"))
    least = known.groupBy("gram").agg(F.min(F.struct("own", "key", "n", "at", "root")).alias("top")).select("gram", "top.*")
    assert shingles.met(known, least, 0.8).count() < 10 * len(texts)


def test_graph_components(spark):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 150)] + [(5, 5), (None, 3)]
    edges += [(200 + r.randrange(60), 200 + r.randrange(60)) for _ in range(40)]
    found = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert found == {x: find(x) for x in root}


def test_graph_components_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(graph, "BROADCAST_NODES", 0)
    test_graph_components(spark)


def test_graph_components_of_stars_take_one_pass(spark, monkeypatch):
    written, write = [], graph.write
    monkeypatch.setattr(graph, "write", lambda df, label: written.append(label) or write(df, label))
    stars = spark.createDataFrame([(k, k % 3) for k in range(30)] + [(7, 1)], "a long, b long")
    assert dict(graph.components(stars).collect()) == {k: k % 3 for k in range(30)}
    assert written == ["edges", "nodes"]


def test_keep_one_leaves_its_result_alone(spark, odd, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_root", lambda _: str(tmp_path))
    kept = shingles.keep_one(odd)
    assert [p.name.rpartition("-")[0] for p in tmp_path.iterdir()] == ["near_duplicates"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in shingles.keep_one(odd).collect())


def brute_substring(rows, length=20):
    first, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        if doc in out:
            continue
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            window = tuple(w[k : k + length])
            if window in first:
                gone[k : k + length] = [True] * length
            else:
                first[window] = doc
        out[doc] = (len(w), sum(gone), " ".join(a for a, b in zip(w, gone) if not b))
    return out


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", None])
def test_substring(spark, letters):
    r = random.Random(letters)
    base = [[r.choice(letters or [f"w{i}" for i in range(500)]) for _ in range(200)] for _ in range(6)]
    rows = []
    for i in range(90):
        w = []
        for _ in range(r.randint(0, 5)):
            b, a = r.choice(base), r.randint(0, 190)
            w += b[a : a + r.randint(5, 60)] + ([f"x{r.randint(0, 30)}"] if r.random() < 0.5 else [])
        rows.append((i, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, "z " * 500), (1003, " ".join("ab" * 300))]
    found = substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {f.doc_id: tuple(f)[1:] for f in found} == brute_substring(rows)


def test_substring_with_a_phrase_everywhere(spark):
    """A phrase of nine words in 1,500 documents with different surroundings, some of them shared."""
    r = random.Random(8)
    phrase = [f"common{k}" for k in range(9)]
    word = lambda: f"w{r.randrange(5000)}"
    sides = [([word() for _ in range(12)], [word() for _ in range(12)]) for _ in range(40)]
    rows = []
    for i in range(1500):
        a, b = ([word() for _ in range(12)], [word() for _ in range(12)]) if i % 3 else (sides[i % 40][0][r.randrange(8) :], sides[i * 7 % 40][1])
        rows.append((i, " ".join([word() for _ in range(6)] + a + phrase + b + [word() for _ in range(6)])))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    found = {f.doc_id: tuple(f)[1:] for f in substring.deduplicate(frame).collect()}
    assert found == brute_substring(rows) and sum(f[1] for f in found.values()) > 1000
    given = substring.first_passages(frame).where("anchor is not null").groupBy("anchor").count()
    assert (given.agg(F.max("count")).first()[0] or 0) < 500


def test_anchoring_copies_no_windows():
    """Anchors as by a plain minimum over each window, in few times the room of the words' hashes."""
    r = np.random.default_rng(5)
    values = r.integers(0, 40, 5_000).astype(np.uint64)
    want = [int(np.argmin(values[k : k + 14])) for k in range(len(values) - 13)]
    assert substring.least_of(values, 14).tolist() == want and substring.least_of(values, 1).tolist() == [0] * 5_000
    hashes = r.integers(0, 1 << 63, 200_000, dtype=np.uint64)
    tracemalloc.start()
    found = substring.runs(hashes, np.arange(400, 200_001, 400), 20, 7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[2].sum() == 500 * 381 and peak < 8 * hashes.nbytes


def test_substring_odd_rows(odd, nothing):
    assert substring.deduplicate(nothing).count() == 0
    want = brute_substring([(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None])
    found = substring.deduplicate(odd, keep=["lang"]).collect()
    assert len(found) == odd.count()
    assert all(tuple(f)[1:4] == want[f.doc_id] for f in found if f.doc_id is not None)
    assert all(f.n_removed == 0 for f in found if f.doc_id is None)
    laid = {f.doc_id: f.kept_text for f in substring.deduplicate(odd, layout=True).collect()}
    assert laid[9] == "Other words first.\nMore." and laid[8].count("\n") == 2


def test_suffix_automaton():
    automaton = substring.SuffixAutomaton()
    automaton.add(list("abcbcd"))
    automaton.add(list("xbcde"))
    assert automaton.statistics(list("zbcdeab")) == [0, 1, 2, 3, 4, 1, 2]
    assert substring.spans([0, 1, 2, 3, 3, 0, 1, 2, 3], 3) == [(1, 5), (6, 9)]


def test_top_k_odd_vectors(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=40).astype(float).tolist()) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(30)] + [(500, None), (501, []), (None, rows[1][1]), (502, [None] * 40), (0, rows[0][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    codes = {}
    for i, v in rows:
        if i is not None and v is not None:
            codes[i] = [(x or 0) > 0 for x in v] + [False] * (40 - len(v))
    want = []
    for q in [i for i in codes if i % 20 == 0]:
        near = sorted((sum(a != b for a, b in zip(codes[q], codes[i])), i) for i in codes if i != q)[:10]
        want += [(q, k, i, d) for k, (d, i) in enumerate(near, 1)]
    for shard_rows in (50, 20_000):
        found = binary_search.top_k(frame, frame.where("vec_id % 20 = 0"), shard_rows=shard_rows)
        assert sorted(map(tuple, found.collect())) == sorted(want)
    assert binary_search.top_k(frame.limit(0), frame.limit(0)).count() == 0
