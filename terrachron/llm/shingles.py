"""Near duplicates by SimHash fingerprints, and the Jaccard similarity of word shingles as the exact check.

SimHash fingerprints, met in the grid of their segment popcounts (``simhash.py``), propose pairs first; each
pair is then held against the exact similarity of its shingle sets. Fingerprints four bits apart
find copies with little changed, few of the pairs close to the similarity. So MinHash
values in bands propose pairs among the texts that fingerprints have left apart, held against the same check.
Two texts with similarity 0.8 share no band with a chance of 0.0002 % (1 - 0.8 ** 4, to the power of 25),
and those more alike still more seldom.

As with fingerprints, large cells are not expanded into pairs: members are compared
with their cell's pivot. Where a cell then still holds several components, its sets
are in doubt and meet by the rarest of their shingles instead, which leaves out no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from terrachron.llm import common, graph, simhash
from terrachron.llm.substring import WordHashes, mix
from terrachron.session import materialize, scratch, work_path

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 4
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.array([xxhash.xxh64_intdigest(bytes([k]), 42) for k in range(BANDS * ROWS)], np.uint64)
#: Distinct words whose hashes a task remembers; bounds memory, not results.
MEMORY_WORDS = 150_000
#: Shingles hashed at once, of many short texts or a part of a long one.
CHUNK = 32_768


def sets(texts: list[str], known: WordHashes, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text; a shorter text is one shingle, one without words has none."""
    found = []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").translate(simhash._LOWER).split()
        if not words:
            found.append(np.zeros(0, np.uint64))
            continue
        hashes = np.fromiter((known[w] for w in words), np.uint64, len(words))
        n = max(1, len(words) - shingle + 1)
        gram = np.zeros(n, np.uint64)
        for k in range(min(shingle, len(words))):
            gram = gram * _ODD + mix(hashes[k : k + n])
        found.append(np.unique(mix(gram)))
    return found


class ByteHashes(WordHashes):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def bands(found: list[np.ndarray]) -> np.ndarray:
    """For each set a row of keys, one for each band of its least hashes."""
    least = np.full((len(_SEEDS), len(found)), np.uint64(0xFFFFFFFFFFFFFFFF))
    sizes = np.array([len(g) for g in found], np.int64)
    filled = np.flatnonzero(sizes)
    ends = np.cumsum(sizes[filled])
    begins = ends - sizes[filled]
    laid = np.concatenate([np.zeros(0, np.uint64), *found])
    for k in range(0, len(laid), CHUNK):
        part = laid[k : k + CHUNK]
        first, last = np.searchsorted(ends, k, "right"), np.searchsorted(begins, k + len(part), "left")
        own, at = filled[first:last], np.maximum(begins[first:last] - k, 0)
        for j, seed in enumerate(_SEEDS):
            least[j, own] = np.minimum(least[j, own], np.minimum.reduceat(mix(part ^ seed), at))
    key = np.zeros((len(found), BANDS), np.uint64)
    for row in range(ROWS):
        key = key * _ODD + mix(least[row::ROWS].T)
    return mix(key).view(np.int64)


def encoded(docs: DataFrame, shingle: int, whole: bool) -> DataFrame:
    """``doc_id``, ``key`` (a hash of the shingle set), ``n`` and the set itself (``grams``), or its ``bands`` and the text's fingerprint ``fp``."""
    name = "grams" if whole else "bands"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ByteHashes()
        for part in common.slices(batches):
            if len(known) > MEMORY_WORDS:
                known = ByteHashes()
            texts = part.column("text").to_pylist()
            found = sets(texts, known, shingle)
            keys = np.array([xxhash.xxh64_intdigest(g.tobytes()) for g in found], np.uint64).view(np.int64)
            lists = [g.view(np.int64) for g in found] if whole else list(bands(found))
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))
            sizes = pa.array([len(g) for g in found], pa.int32())
            columns = {"doc_id": part.column("doc_id"), "key": pa.array(keys), "n": sizes, name: values}
            if not whole:
                columns["fp"] = pa.array([simhash.fingerprint(t, shingle) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, key long, n int, {name} array<long>" + ("" if whole else ", fp long"))


def fitting(na: Column, nb: Column, similarity: float) -> Column:
    """Sizes at which two sets can have the similarity."""
    return F.least(na, nb) >= F.lit(similarity) * F.greatest(na, nb)


def verified(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """Of pairs ``a, b`` with sizes ``na, nb`` those of at least the similarity, counted on the whole sets ``key, grams``."""
    grams = grams.select("key", "grams").hint("merge")
    both = pairs.join(grams.select(F.col("key").alias("a"), F.col("grams").alias("ga")), "a")
    both = both.join(grams.select(F.col("key").alias("b"), F.col("grams").alias("gb")), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    return both.where(shared >= F.lit(similarity) * (F.col("na") + F.col("nb") - shared)).select("a", "b")


def shingle_sets(keys: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """``key``, ``n`` and ``grams`` of the sets ``key``, each read again from its first document ``doc``."""
    keys = common.small(materialize(keys.select("key", "doc").distinct(), "keys"))
    asked = docs.join(keys.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi")
    grams = encoded(asked, shingle, True).join(keys.select("key"), "key", "left_semi")
    return materialize(grams.select("key", "n", "grams").dropDuplicates(["key"]), "shingle_sets")


def alike(pairs: DataFrame, distinct: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Of pairs ``a, b`` of keys those of at least the similarity, which is counted exactly."""
    sizes = lambda c: distinct.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("first").alias(f"d{c}"))
    pairs = pairs.distinct().join(sizes("a"), "a").join(sizes("b"), "b")
    pairs = materialize(pairs.where(fitting(F.col("na"), F.col("nb"), similarity)), "pairs")
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("key"), F.col("da").alias("doc")), F.struct(F.col("b").alias("key"), F.col("db").alias("doc")))).alias("x"))
    return verified(pairs, shingle_sets(ends.select("x.*"), docs, shingle), similarity)


def by_fingerprint(distinct: DataFrame, most: int = simhash.DISTANCE) -> DataFrame:
    """Pairs ``a, b`` of sets: each with the pivot, the set with most copies, of its component of fingerprints ``most`` bits apart or fewer."""
    filled = distinct.where("n > 0").select("key", "copies", "fp")
    fps = materialize(filled.groupBy("fp").agg(F.sum("copies").alias("copies")), "distinct_fingerprints")
    rooted_ = filled.join(simhash.components_of(fps, most), "fp", "left").select("key", "copies", F.coalesce("root", "fp").alias("root"))
    rooted_ = materialize(rooted_, "fingerprint_roots")
    tops = rooted_.groupBy("root").agg(F.max(F.struct("copies", "key")).alias("top"), F.count("*").alias("m")).where("m > 1")
    tops = tops.select("root", F.col("top.key").alias("b"))
    return rooted_.join(tops.hint("merge"), "root").where("key <> b").select(F.col("key").alias("a"), "b")


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Of pairs ``a, b`` those whose ends lie in different components ``roots``; a set without a link is its own."""
    for c in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("component").alias(f"{c}_root")), c, "left")
    return pairs.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")


def prefixes(grams: DataFrame, similarity: float) -> DataFrame:
    """The shingles by which a set can meet another of the similarity: ``gram, key, n, at, own``.

    Shingles are ordered by the number of sets that hold them, rarest first. Of two sets alike enough,
    the prefixes of ``n - ceil(similarity * n) + 1`` shingles have one in common. A shingle of one
    set alone fills a place ``at`` but meets nothing and gets no row; ``own`` is their share of the set.
    """
    rows = grams.select("key", "n", F.explode("grams").alias("gram"))
    often = rows.groupBy("gram").agg(F.count("*").alias("sets")).where("sets > 1")
    rows = rows.join(often.hint("merge"), "gram")
    whole = Window.partitionBy("key")
    alone = F.col("n") - F.count("*").over(whole)
    rows = rows.select("key", "n", "gram", alone.alias("alone"), F.row_number().over(whole.orderBy("sets", "gram")).alias("nth"))
    at = F.col("alone") + F.col("nth") - 1
    return rows.where(at <= F.col("n") - F.ceil(F.col("n") * F.lit(similarity) - F.lit(1e-6))).select(
        "gram", "key", "n", at.alias("at"), (F.col("alone") / F.col("n")).alias("own")
    )


def rooted(prefix: DataFrame, roots: DataFrame) -> DataFrame:
    """Prefix rows with the ``root`` of their set's component, the set itself where it has no link."""
    named = roots.select(F.col("node").alias("key"), F.col("component").alias("root"))
    return prefix.join(named, "key", "left").withColumn("root", F.coalesce("root", "key"))


def met(a: DataFrame, b: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a, b, na, nb`` of sets of different components that meet in a shingle early enough to be alike."""
    side = lambda df, c: df.select("gram", F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("at").alias(f"at{c}"), F.col("root").alias(f"root{c}"))
    left = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb"))
    needed = (F.col("na") + F.col("nb")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-6)
    found = side(a, "a").join(side(b, "b").hint("merge"), "gram").where((F.col("roota") != F.col("rootb")) & fitting(F.col("na"), F.col("nb"), similarity) & (left >= needed))
    swap = F.col("a") > F.col("b")
    ordered = [F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("na", "nb"), ("nb", "na"))]
    return found.select(*ordered).distinct()


def links_in_doubt(doubtful: DataFrame, links: DataFrame, roots: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The links that join components among the sets in doubt (``key``, ``doc``), given the links
    known so far and their components ``roots``.

    A group of many texts that lie a little below the similarity shares bands all over, so bands
    cannot tell its pairs apart. Prefixes can: what makes such texts differ is rare and stands
    first in them. Sets meet the pivot of each of their shingles first, the one with the least
    share of its own, and then only what is still in another component.
    """
    grams = shingle_sets(doubtful, docs, shingle)
    prefix = materialize(prefixes(grams, similarity), "prefixes")
    known = materialize(rooted(prefix, roots), "known_prefixes")
    first = lambda df: df.groupBy("gram").agg(F.min(F.struct("own", "key", "n", "at", "root")).alias("top")).select("gram", "top.*")
    stars = materialize(verified(met(known, first(known), similarity), grams, similarity), "prefix_links")

    roots = graph.components(links.unionByName(stars))
    known = materialize(rooted(prefix, roots), "known_prefixes")
    top = first(known).select("gram", F.col("root").alias("top_root"))
    others = known.join(top.hint("merge"), "gram").where("root <> top_root").drop("top_root")
    return stars.unionByName(verified(met(others, known, similarity), grams, similarity))


def near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id`` and ``component_id`` of each row with a ``doc_id``.

    The component is the smallest ``doc_id`` reachable over pairs of texts whose sets of
    shingles (of words, ASCII letters lowered) have at least the ``similarity``. Texts without words
    (null, empty) are copies of each other. Rows with a null ``doc_id`` have no place and link nothing.
    """
    texts = common.documents(docs, id_col, text_col).where("doc_id is not null")
    rows = materialize(encoded(texts, shingle, False), "signatures")
    distinct = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min("bands").alias("bands"), F.min("fp").alias("fp"))
    distinct = materialize(distinct, "distinct_sets")
    near = materialize(alike(by_fingerprint(distinct), distinct, texts, shingle, similarity), "fingerprint_links")
    joined = graph.components(near)

    at = distinct.where("n > 0").select("key", "copies", F.posexplode("bands").alias("band", "cell"))
    cells = at.groupBy("band", "cell").agg(F.max(F.struct("copies", "key")).alias("top"), F.count("*").alias("m")).where("m > 1")
    cells = cells.select("band", "cell", F.col("top.key").alias("pivot"))
    shared = materialize(at.join(cells.hint("merge"), ["band", "cell"]).select("band", "cell", "key", "pivot"), "bands")
    stars = shared.where("key <> pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b"))
    stars = alike(apart(stars.distinct(), joined), distinct, texts, shingle, similarity)
    stars = materialize(stars.unionByName(near), "stars")
    part = graph.components(stars)

    named = lambda c: part.select(F.col("node").alias(c), F.col("component").alias(f"{c}_root"))
    known = shared.join(named("key"), "key", "left").join(named("pivot"), "pivot", "left")
    known = known.select("band", "cell", "key", F.coalesce("key_root", "key").alias("root"), F.coalesce("pivot_root", "pivot").alias("pivot_root"), "pivot")
    known = materialize(known, "known_bands")
    mixed = known.where("root <> pivot_root").select("band", "cell").distinct()
    doubtful = known.join(mixed.hint("merge"), ["band", "cell"], "left_semi").select("key").distinct()
    doubtful = doubtful.join(distinct.select("key", F.col("first").alias("doc")), "key")
    links = materialize(stars.unionByName(links_in_doubt(doubtful, stars, part, texts, shingle, similarity)), "links")
    roots = graph.components(links).select(F.col("node").alias("key"), F.col("component").alias("root"))
    named = materialize(distinct.join(roots, "key", "left").select("key", "first", F.coalesce("root", "key").alias("root")), "roots")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.select("doc_id", "key").join(named.join(least, "root").select("key", "component_id"), "key").select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Of each component the document with the smallest ``doc_id``, with all its rows; rows with a null id stay."""
    path = work_path(docs.sparkSession, "near_duplicates")
    with scratch(docs.sparkSession):
        found = near_duplicates(docs, id_col=id_col, **options)
        found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct().write.parquet(path)
    gone = docs.sparkSession.read.schema("gone_id long").parquet(path)
    return docs.join(common.small(gone), docs[id_col] == gone["gone_id"], "left_anti")
