"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code holds the signs of its values. A code is cut into segments, and a shard of
rows keeps a table of each segment's values. Codes at distance below m (s + 1), with m
segments, differ in s bits or fewer in some segment. So the search looks up all segment
values at distance 0, then 1, and so on, verifies what it finds, and ends for a
query as soon as its kth distance is covered: nothing nearer can be missing.

Queries meet rows in blocks: a first pass over one shard bounds each query's kth distance,
the second visits all shards and stops at that bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from terrachron.llm.bpe import spread
from terrachron.session import materialize

K = 10
SHARD_ROWS = 10_000
QUERY_BLOCK = 4_000
#: Candidates held at once in a task; bounds memory, not results.
CANDIDATES = 2_000_000


def sign_codes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``code`` (bytes, a bit for each value, 1 if positive). Shorter vectors and null values
    get zero bits; rows with a null vector or id are left out."""
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<float>").alias("v"))
    rows = rows.where("id is not null and v is not null")
    width = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("n")).first()["n"]
    size = max(8, -(-width // 64) * 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            lengths = np.diff(lists.offsets.to_numpy())
            bits = np.zeros((len(lengths), size * 8), bool)
            flat = np.nan_to_num(lists.flatten().to_numpy(zero_copy_only=False), nan=0.0) > 0
            bits[np.repeat(np.arange(len(lengths)), lengths), spread(np.zeros(len(lengths), np.int64), lengths)] = flat
            codes = np.packbits(bits, axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "code"]
            )

    return rows.mapInArrow(run, "id long, code binary")


class Index:
    """Segment tables over the codes of a shard."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, bits: int):
        self.ids, self.codes, self.bits = ids, codes, bits
        self.words = codes.view(np.uint64)
        width = min(16, max(1, int(np.log2(max(2, len(ids))))))
        self.count = max(1, round(bits / width))
        bounds = [bits * k // self.count for k in range(self.count + 1)]
        self.ranges = list(zip(bounds, bounds[1:]))
        self.tables = []
        for values, (a, b) in zip(self.segments(codes), self.ranges):
            order = np.argsort(values, kind="stable")
            self.tables.append((order, np.searchsorted(values[order], np.arange((1 << (b - a)) + 1))))

    def segments(self, codes: np.ndarray) -> list[np.ndarray]:
        bits = np.unpackbits(codes, axis=1)
        return [bits[:, a:b].astype(np.int64) @ (1 << np.arange(b - a)) for a, b in self.ranges]

    def search(self, ids: np.ndarray, codes: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, ...]:
        """Query number, row number and distance of the k nearest rows of each query, ties by id.

        A row with the query's own id is no neighbour. Rows farther than ``bound`` may be missing.
        """
        empty = np.zeros(0, np.int64)
        best = (empty, empty, empty)
        if not len(self.ids) or not len(ids):
            return best
        query_words, parts = codes.view(np.uint64), self.segments(codes)
        active = np.arange(len(ids))
        limit = bound.copy()  # of each query: nothing farther can be among its k best
        for radius in range(max(b - a for a, b in self.ranges) + 1):
            for part, (order, offsets), (a, b) in zip(parts, self.tables, self.ranges):
                if radius > b - a:
                    continue
                masks = np.array([sum(1 << bit for bit in c) for c in combinations(range(b - a), radius)], np.int64)
                for mask in np.array_split(masks, max(1, len(masks) * len(active) // CANDIDATES)):
                    probes = part[active][:, None] ^ mask[None, :]
                    begin = offsets[probes].ravel()
                    sizes = offsets[probes + 1].ravel() - begin
                    who = np.repeat(active, len(mask))
                    step = np.cumsum(sizes) // CANDIDATES
                    for cut in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(step)) + 1):
                        rows = order[spread(begin[cut], sizes[cut])]
                        best = self.merge(best, np.repeat(who[cut], sizes[cut]), rows, ids, query_words, k, limit)
                        found = np.bincount(best[0], minlength=len(ids))
                        full = found >= k
                        limit[full] = np.minimum(limit[full], best[2][np.cumsum(found)[full] - 1])
            covered = self.count * (radius + 1) - 1
            active = active[limit[active] > covered]
            if not len(active):
                break
        return best

    def merge(self, best, who, rows, ids, query_words, k, limit):
        """The k best of what is held and the new candidates, each pair once."""
        far = np.zeros(len(who), np.int64)
        for word in range(self.words.shape[1]):
            far += np.bitwise_count(query_words[who, word] ^ self.words[rows, word])
        new = np.flatnonzero((far <= limit[who]) & (self.ids[rows] != ids[who]))
        who, rows, far = who[new], rows[new], far[new]
        who, rows, far = (np.concatenate(p) for p in zip(best, (who, rows, far)))
        order = np.lexsort([rows, self.ids[rows], far, who])
        who, rows, far = who[order], rows[order], far[order]
        fresh = np.r_[True, (np.diff(who) != 0) | (np.diff(rows) != 0)] if len(who) else np.zeros(0, bool)
        who, rows, far = who[fresh], rows[fresh], far[fresh]
        starts = np.searchsorted(who, who)
        keep = np.arange(len(who)) - starts < k
        return who[keep], rows[keep], far[keep]


def table_codes(column: pa.ChunkedArray) -> np.ndarray:
    values = column.to_pylist()
    size = len(values[0]) if values else 8
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), size)


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """``query_id``, ``rank``, ``neighbor_id``, ``distance``: the k rows nearest to each query.

    Exact, ties by the smaller id. The row with the query's id is left out, but copies of it
    under other ids are not. Fewer than k other rows give fewer results; an empty
    table gives none. A query repeated as a row counts once, a row repeated under one
    id is one neighbour.
    """
    rows = materialize(sign_codes(vectors, id_col, vector_col).dropDuplicates(["id"]), "codes")
    asked = queries.select(queries[id_col].cast("long").alias("id")).distinct()
    asked = materialize(rows.join(asked, "id", "left_semi"), "queries")
    n, q = rows.count(), asked.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-q // QUERY_BLOCK))
    deal = lambda parts, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(parts)).cast("int")
    block = deal(blocks, 1)
    bits = 8 * len(rows.first()["code"]) if n else 64

    def meet(shard: pa.Table, block_: pa.Table) -> pa.Table:
        index = Index(shard.column("id").to_numpy(), table_codes(shard.column("code")), bits)
        ids = block_.column("id").to_numpy()
        bound = block_.column("bound").fill_null(np.iinfo(np.int32).max).to_numpy().astype(np.int64)
        who, found, far = index.search(ids, table_codes(block_.column("code")), k, bound)
        return pa.table({"query_id": pa.array(ids[who], pa.int64()), "neighbor_id": pa.array(index.ids[found], pa.int64()), "distance": pa.array(far.astype(np.int32))})

    def search(asked_: DataFrame, spread_rows: DataFrame) -> DataFrame:
        # as many partitions as pairs of shard and block: small inputs, but much work for each row
        keys = (shards * blocks, "shard", "block")
        left, right = (d.repartition(*keys).groupBy("shard", "block") for d in (spread_rows, asked_))
        return left.cogroup(right).applyInArrow(meet, "query_id long, neighbor_id long, distance int")

    sharded = rows.withColumn("shard", deal(shards, 0))
    in_blocks = sharded.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    home = asked.select("id", "code", deal(shards, 0).alias("shard"), block.alias("block"), F.lit(None).cast("int").alias("bound"))
    bound = search(home, in_blocks).groupBy("query_id").agg(F.max("distance").alias("far"), F.count("*").alias("n"))
    bound = bound.where(F.col("n") >= k).select(F.col("query_id").alias("id"), F.col("far").alias("bound"))
    everywhere = asked.join(bound, "id", "left").select(
        "id", "code", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), block.alias("block"), "bound"
    )
    order = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    found = search(everywhere, in_blocks).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "neighbor_id", "distance")


def sql(k: int = K, every: int = 20) -> str:
    """The same by comparing every query with every row."""
    return f"""
WITH c AS (SELECT DISTINCT ON (vec_id) vec_id, list_transform(embedding, lambda x: coalesce(x > 0, false)) code FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT q.vec_id query_id, r.vec_id neighbor_id,
      len(list_filter(list_zip(q.code, r.code), lambda z: z[1] <> z[2]))::INT distance
      FROM c q JOIN c r ON q.vec_id <> r.vec_id WHERE q.vec_id % {every} = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INT AS rank FROM p)
SELECT query_id, rank, neighbor_id, distance FROM n WHERE rank <= {k}"""
