"""Near duplicates by SimHash fingerprints and a segment-popcount embedding.

A fingerprint of 64 bits has 32 segments of two bits, and the embedding counts the
bits set in each. Flipping a bit moves one count by one, so the Manhattan distance
of embeddings is a lower bound of the Hamming distance. Counts are stored in unary,
which makes that distance a bit count as well.

The grid: the segments form eight blocks. Of embeddings at distance 4 or less, four
blocks at least agree in all counts, so both lie in one cell of the grid of those
four blocks (fewer blocks make fewer cells to a row, but more chance meetings). Cells are joined, pairs are held against the lower bound and then
against the exact distance.

Large cells are not expanded into pairs: each cell has a pivot, its fingerprint with
most documents; what is near the pivot is linked to it alone, and only fingerprints
of a cell that are then still in another component than the pivot are compared
with the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from terrachron.llm import common, graph
from terrachron.session import materialize

SHINGLE = 4
SEED = 42
DISTANCE = 4
BLOCKS = 8
LOW_BITS = 0x5555555555555555
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Shingles whose bits are counted at once.
COUNTED = 100_000


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Fingerprint of a text: bit k is 1 if set in more than half of its shingles' hashes."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts, stops = (ends - sizes)[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for k in range(0, n, COUNTED):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[k : k + COUNTED], stops[k : k + COUNTED])]
        bits = np.unpackbits(np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` (a signed long) of every row; zero for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            found = [fingerprint(t, shingle) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return common.documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def embedding(fp: Column) -> Column:
    """Counts of the segments in unary: 00, 01 or 11."""
    half = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(half).bitwiseAND(F.lit(LOW_BITS))
    both = fp.bitwiseAND(half).bitwiseAND(F.lit(LOW_BITS))
    return some.bitwiseOR(F.shiftleft(both, 1))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def cell_masks(blocks: int, most: int) -> list[int]:
    """One mask for each choice of blocks that may agree; as signed longs."""
    bounds = [32 * k // blocks for k in range(blocks + 1)]
    parts = [sum(3 << (2 * s) for s in range(bounds[k], bounds[k + 1])) for k in range(blocks)]
    masks = [sum(c) for c in combinations(parts, blocks - most)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def components_of(fps: DataFrame, most: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """``fp`` and ``root``, a fingerprint of its component, for fingerprints with a link.

    ``fps`` has ``fp`` (distinct) and ``copies``. Components are those of the graph that links
    fingerprints at ``most`` differing bits or fewer; no link is left out.
    """
    if blocks <= most:
        raise ValueError("more blocks than differing bits are needed")
    masks = F.array(*[F.lit(m) for m in cell_masks(blocks, most)])
    at = fps.select("fp", "copies", embedding(F.col("fp")).alias("e"), F.posexplode(masks).alias("grid", "mask"))
    at = at.select("fp", "copies", "grid", F.col("e").bitwiseAND(F.col("mask")).alias("cell"))
    cells = at.groupBy("grid", "cell").agg(F.max(F.struct("copies", "fp")).alias("top"), F.count("*").alias("n"))
    cells = cells.where("n > 1").select("grid", "cell", F.col("top.fp").alias("pivot"))
    # Spark's size estimate does not see that rows are exploded by grid, so neither side may be broadcast
    shared = materialize(at.join(cells.hint("merge"), ["grid", "cell"]).select("grid", "cell", "fp", "pivot"), "cells")

    near = distance(embedding(F.col("fp")), embedding(F.col("pivot"))) <= most
    stars = shared.where((F.col("fp") != F.col("pivot")) & near & (distance(F.col("fp"), F.col("pivot")) <= most))
    part = graph.components(stars, "fp", "pivot")

    root = lambda c: F.coalesce(F.col(f"{c}_root"), F.col(c))
    named = lambda c: part.select(F.col("node").alias(c), F.col("component").alias(f"{c}_root"))
    known = shared.join(named("fp"), "fp", "left").join(named("pivot"), "pivot", "left")
    known = known.select("grid", "cell", "fp", root("fp").alias("root"), root("pivot").alias("pivot_root"))
    known = materialize(known, "known_cells")
    others = known.where(F.col("root") != F.col("pivot_root")).select("grid", "cell", F.col("fp").alias("a"), F.col("root").alias("a_root"))
    rest = known.select("grid", "cell", F.col("fp").alias("b"), F.col("root").alias("b_root"))
    bound = distance(embedding(F.col("a")), embedding(F.col("b"))) <= most
    links = others.join(rest, ["grid", "cell"]).where(
        (F.col("a_root") != F.col("b_root")) & bound & (distance(F.col("a"), F.col("b")) <= most)
    )
    whole = graph.components(links, "a_root", "b_root")
    joined = part.select(F.col("node").alias("fp"), F.col("component").alias("root"))
    joined = joined.unionByName(whole.select(F.col("node").alias("fp"), F.col("node").alias("root")))
    higher = whole.select(F.col("node").alias("root"), F.col("component").alias("top"))
    return joined.join(higher, "root", "left").groupBy("fp").agg(F.min(F.coalesce("top", "root")).alias("root"))


def near_duplicates(
    docs: DataFrame,
    most: int = DISTANCE,
    shingle: int = SHINGLE,
    blocks: int = BLOCKS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: ``doc_id``, ``fingerprint`` (hex), ``component_id``.

    The component is the smallest ``doc_id`` reachable over fingerprints that differ in
    ``most`` bits or fewer. Texts without words (null, empty) share fingerprint zero
    and link like others. Repeated rows stay; a null ``doc_id`` is linked by its text but
    is never the smallest unless all are null. Groups of copies are one fingerprint.
    """
    fps = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    distinct = materialize(distinct, "distinct_fingerprints")
    roots = components_of(distinct.select("fp", "copies"), most, blocks)
    known = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    known = materialize(known, "roots")
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    named = known.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents without near duplicates: of each component that with the smallest
    ``doc_id`` stays, with all its rows should it be repeated. Rows with a null id stay."""
    found = near_duplicates(docs, id_col=id_col, **options)
    gone = materialize(found.where("doc_id <> component_id").select("doc_id").distinct(), "near_duplicates")
    gone = common.small(gone.withColumnRenamed("doc_id", "gone_id"))
    return docs.join(gone, docs[id_col] == gone["gone_id"], "left_anti")
