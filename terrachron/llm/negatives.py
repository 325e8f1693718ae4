"""Hard negatives by inner product: packed R-trees searched best first.

Vectors become integers, so that scores are exact. Equal vectors of one label are one
point with its few least ids. Points are dealt to tiles by the sort-tile-recursive rule: cut
at quantiles of the widest coordinate, every slab again at those of the next one. The cuts
come from a bounded sample; every point is indexed. A tile's points are split further until
shards are small, and a task packs its shard by the same rule into leaves, and the leaves into
nodes, each with its minimum bounding box.

The box gives every coordinate's product with a query an interval, so also their sum. A
queue takes boxes by their upper end; a box goes unopened if it lies outside the windows
of scores asked for, or strictly below the kth score. A first pass visits only the
query's own shard and so bounds the kth score; the second visits the shards
whose tile can still matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from terrachron.llm.bpe import spread
from terrachron.session import materialize

#: Points in a task, points in a leaf, entries of a node.
SHARD_ROWS, LEAF, FAN = 10_000, 64, 16
#: Tiles are at most this many, which bounds what is broadcast: two numbers for a tile and coordinate.
TILES = 4_096
#: Rows of the sample for the cuts, and coordinates that are cut.
SAMPLE, AXES = 20_000, 6
#: Queries that meet a shard at once.
QUERY_BLOCK = 50_000
#: Scaled components stay within this, so that a hundredfold sum of 256 products fits in 64 bits.
LIMIT = 1 << 24
NO_LOW, NO_HIGH = -(1 << 62), 1 << 62


def rows_of(vectors: DataFrame, scale: float, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """``id``, ``label``, ``q`` (integers), and the hashes ``a`` and ``b`` that name the point."""
    components = vectors[vector_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), label.cast("long").alias("label"), components.alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(F.exists("v", bad), F.lit(True)))
    whole = lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int")
    return rows.select("id", "label", F.transform("v", whole).alias("q")).withColumns({"a": F.xxhash64("label", "q"), "b": F.xxhash64("q", "label")})


def cuts_of(sample: np.ndarray, tiles: int) -> list[tuple[int, list]]:
    """Nested quantile cuts: per level its coordinate and, for each slab, the inner bounds of its parts."""
    axes = np.argsort(-sample.var(axis=0), kind="stable")[: max(1, min(AXES, int(np.ceil(np.log2(max(2, tiles))))))] if sample.size else []
    slabs, levels, left = [sample], [], tiles
    for level, axis in enumerate(axes):
        parts = max(1, round(left ** (1 / (len(axes) - level))))
        left = max(1, left // parts)
        bounds = [np.quantile(s[:, axis], np.arange(1, parts) / parts) if len(s) else np.zeros(parts - 1) for s in slabs]
        levels.append((int(axis), bounds))
        slabs = [s[np.searchsorted(b, s[:, axis], "right") == p] for s, b in zip(slabs, bounds) for p in range(parts)]
    return levels


def tile_of(q: np.ndarray, levels: list) -> np.ndarray:
    tile = np.zeros(len(q), np.int64)
    for axis, bounds in levels:
        part = np.zeros(len(q), np.int64)
        for slab in np.unique(tile):
            mine = tile == slab
            part[mine] = np.searchsorted(bounds[slab], q[mine, axis], "right")
        tile = tile * (len(bounds[0]) + 1) + part
    return tile


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of numbers; shorter vectors end in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], column.type)
    out = np.zeros((len(lists), width))
    lengths = np.diff(lists.offsets.to_numpy())
    out[np.repeat(np.arange(len(lists)), lengths), spread(np.zeros(len(lists), np.int64), lengths)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


class Tree:
    """Sort-tile-recursive R-tree over the points of a shard; labels are a coordinate of their own."""

    def __init__(self, points: np.ndarray, labels: np.ndarray, ids: list[list[int]]):
        order = self.packed(points, labels)
        points, labels = points[order], labels[order]
        self.labels, self.ids = labels, [ids[k] for k in order.tolist()]
        # products are exact in doubles while they stay below 2 ** 53; beyond, integers do it
        self.exact = lambda q: points.shape[1] * max(1.0, np.abs(points).max(initial=0)) * max(1.0, np.abs(q).max(initial=0)) < 2**53
        self.points, self.whole = points, None
        self.levels = []  # from leaves to root: where an entry's children begin, and the boxes
        starts = np.arange(0, len(points), LEAF)
        low, high = (f.reduceat(points, starts, axis=0) for f in (np.minimum, np.maximum))
        first, last = (f.reduceat(labels, starts) for f in (np.minimum, np.maximum))
        self.levels.append((np.r_[starts, len(points)], low, high, first, last))
        while len(starts) > 1:
            starts = np.arange(0, len(low), FAN)
            count = len(low)
            low, high = np.minimum.reduceat(low, starts, axis=0), np.maximum.reduceat(high, starts, axis=0)
            first, last = np.minimum.reduceat(first, starts), np.maximum.reduceat(last, starts)
            self.levels.append((np.r_[starts, count], low, high, first, last))

    @staticmethod
    def packed(points: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Sort by label, then tile by the widest coordinates, so that neighbours share leaves."""
        order = np.argsort(labels, kind="stable")
        for run in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1):
            leaves = -(-len(run) // LEAF)
            axes = np.argsort(-points[run].var(axis=0), kind="stable")[: max(1, min(3, int(np.log2(max(2, leaves)))))]
            slabs, left = [run], leaves
            for level, axis in enumerate(axes):
                parts = max(1, round(left ** (1 / (len(axes) - level))))
                left = -(-left // parts)
                slabs = [p for s in slabs for p in np.array_split(s[np.argsort(points[s, axis], kind="stable")], parts)]
            run[:] = np.concatenate(slabs)  # a view of order
        return order

    def scores(self, rows: slice, q: np.ndarray, exact: bool) -> np.ndarray:
        if exact:
            return (self.points[rows] @ q).astype(np.int64)
        if self.whole is None:
            self.whole = self.points.astype(np.int64)
        return self.whole[rows] @ q.astype(np.int64)

    def search(self, q: np.ndarray, label: int, same: bool, low: np.ndarray, high: np.ndarray, bound: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """For each window of scores the k best (score, id) of rows of the same label or of all others.

        Rows below a window's ``bound`` may be missing.
        """
        exact = self.exact(q)
        slack = 0 if exact else 1e-6  # boxes are bounded in doubles: leave room for their rounding
        over, under = np.maximum(q, 0), np.minimum(q, 0)
        best: list[list[tuple[int, int]]] = [[] for _ in low]
        least = np.maximum(low, bound)  # of each window: lower scores cannot enter
        queue = [(-np.inf, len(self.levels), 0)]
        while queue:
            top, level, entry = heapq.heappop(queue)
            if -top < least.min():
                break  # all that is left lies strictly below what may enter
            if level == 0:
                starts = self.levels[0][0]
                rows = slice(int(starts[entry]), int(starts[entry + 1]))
                scores = self.scores(rows, q, exact)
                fits = (self.labels[rows] == label) == same
                for w in range(len(low)):
                    for at in np.flatnonzero(fits & (scores >= least[w]) & (scores <= high[w])).tolist():
                        score = int(scores[at])
                        if score < least[w]:
                            continue
                        mine = sorted([*best[w], *((score, -i) for i in self.ids[rows.start + at])], reverse=True)[:k]
                        best[w] = mine
                        if len(mine) == k:
                            least[w] = max(least[w], mine[-1][0])
                continue
            level -= 1
            if level == len(self.levels) - 1:
                children = slice(0, len(self.levels[level][1]))
            else:
                starts = self.levels[level + 1][0]
                children = slice(int(starts[entry]), int(starts[entry + 1]))
            _, lows, highs, first, last = self.levels[level]
            lows, highs = lows[children], highs[children]
            upper, lower = highs @ over + lows @ under, lows @ over + highs @ under
            room = slack * (np.abs(upper) + np.abs(lower))
            upper, lower = upper + room, lower - room
            first, last = first[children], last[children]
            fits = (first <= label) & (label <= last) if same else (first != last) | (first != label)
            useful = fits & ((upper[:, None] >= least) & (lower[:, None] <= high)).any(axis=1)
            for at in np.flatnonzero(useful).tolist():
                heapq.heappush(queue, (-float(upper[at]), level, children.start + at))
        return best


class Search:
    """Points in shards behind tiles, and the two passes over them."""

    def __init__(self, points: DataFrame, width: int, count: int, shard_rows: int):
        self.spark, self.width = points.sparkSession, width
        tiles = max(1, min(TILES, -(-count // shard_rows)))
        share = min(1.0, 2 * SAMPLE / max(1, count))
        sample = points.where(F.pmod("a", F.lit(1_000_003)) < int(1_000_003 * share) + 1).select("q").limit(SAMPLE).toArrow()
        self.cuts = cuts_of(matrix(sample.column("q"), width), tiles)
        tiled = self.placed(points)
        self.points = materialize(tiled, "points")
        boxes = self.boxes()
        self.tiles = sorted(boxes)
        parts = np.array([max(1, -(-boxes[t][0] // shard_rows)) if t in boxes else 1 for t in range(max(self.tiles, default=0) + 1)], np.int64)
        self.parts = (np.cumsum(parts) - parts, parts)
        self.shards = int(parts.sum())
        self.low = np.array([boxes[t][1] for t in self.tiles], float).reshape(len(self.tiles), width)
        self.high = np.array([boxes[t][2] for t in self.tiles], float).reshape(len(self.tiles), width)

    def placed(self, rows: DataFrame) -> DataFrame:
        """With the ``tile`` of each vector."""
        cuts, width = self.cuts, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tile = tile_of(matrix(batch.column("q"), width), cuts)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tile, pa.int64())], [*batch.schema.names, "tile"])

        return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", tile long")

    def boxes(self) -> dict[int, tuple[int, list, list]]:
        """Points and bounding box of every tile, of which there are at most ``TILES``."""
        width = self.width

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for batch in batches:
                tile, q = batch.column("tile").to_numpy(), matrix(batch.column("q"), width)
                for t in np.unique(tile).tolist():
                    mine = q[tile == t]
                    n, low, high = held.get(t, (0, mine[0], mine[0]))
                    held[t] = (n + len(mine), np.minimum(low, mine.min(axis=0)), np.maximum(high, mine.max(axis=0)))
            rows = [(t, n, low.astype(int).tolist(), high.astype(int).tolist()) for t, (n, low, high) in held.items()]
            columns = list(zip(*rows)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["tile", "n", "low", "high"])

        found = self.points.select("tile", "q").mapInArrow(partial, "tile long, n long, low array<int>, high array<int>")
        each = F.arrays_zip("low", "high")
        flat = found.select("tile", "n", F.posexplode_outer(each).alias("axis", "box"))
        flat = flat.groupBy("tile", "axis").agg(F.sum("n").alias("n"), F.min("box.low").alias("low"), F.max("box.high").alias("high"))
        whole = flat.groupBy("tile").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("axis", "low", "high"))).alias("box"))
        return {r["tile"]: (r["n"], [b["low"] for b in r["box"]], [b["high"] for b in r["box"]]) for r in whole.collect()}

    def dealt(self) -> DataFrame:
        """Points with their ``shard``: a tile's points go by their hash into its parts."""
        first, parts = self.parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tile = batch.column("tile").to_numpy()
                number = first[tile] + batch.column("b").to_numpy() % parts[tile]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("label", "q", "ids")], pa.array(number, pa.int64())], ["label", "q", "ids", "shard"])

        return self.points.select("label", "q", "ids", "tile", "b").mapInArrow(run, "label long, q array<int>, ids array<long>, shard long")

    def visits(self, asked: DataFrame, home: bool) -> DataFrame:
        """Queries for their own shard, or for all shards that can hold better rows."""
        width, tiles, (first, parts) = self.width, np.array(self.tiles, np.int64), self.parts
        shared = self.spark.sparkContext.broadcast((self.low, self.high))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high = shared.value
            for batch in batches:
                tile = batch.column("tile").to_numpy()
                own = first[tile] + batch.column("b").to_numpy() % parts[tile]
                if home:
                    which, number = np.arange(batch.num_rows), own
                else:
                    q = matrix(batch.column("q"), width)
                    over, under = np.maximum(q, 0), np.minimum(q, 0)
                    upper, lower = over @ high.T + under @ low.T, over @ low.T + under @ high.T
                    room = 1e-6 * (np.abs(upper) + np.abs(lower)) + 1
                    least = np.array([min(max(a, b) for a, b in zip(*r)) for r in zip(batch.column("low").to_pylist(), batch.column("bound").to_pylist())], float)
                    most = np.array([max(r) for r in batch.column("high").to_pylist()], float)
                    row, at = np.nonzero((upper + room >= least[:, None]) & (lower - room <= most[:, None]))
                    times = parts[tiles[at]]
                    which, number = np.repeat(row, times), spread(first[tiles[at]], times)
                    other = number != own[which]
                    which, number = which[other], number[other]
                out = batch.take(pa.array(which))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(number, pa.int64())], [*out.schema.names, "shard"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema)
        return asked.mapInArrow(run, f"{kinds}, shard long")

    def meet(self, visits: DataFrame, blocks: int, same: bool, k: int) -> DataFrame:
        """``a``, ``b``, ``window``, ``score``, ``id``: the best of each shard that a query visits."""
        width = self.width

        def run(shard: pa.Table, asked: pa.Table) -> pa.Table:
            rows = []
            if shard.num_rows and asked.num_rows:
                tree = Tree(matrix(shard.column("q"), width), shard.column("label").to_numpy(), shard.column("ids").to_pylist())
                q = matrix(asked.column("q"), width)
                columns = [asked.column(c).to_pylist() for c in ("a", "b", "label", "low", "high", "bound")]
                for vector, a, b, label, *limits in zip(q, *columns):
                    found = tree.search(vector, label, same, *(np.array(x, np.int64) for x in limits), k)
                    rows += [(a, b, w, score, -i) for w, best in enumerate(found) for score, i in best]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["a", "b", "window", "score", "id"])

        visits = materialize(visits.withColumn("block", F.pmod("b", F.lit(blocks))), "visits")
        # rows go only where there are queries for them
        wanted = visits.select("shard", F.col("block").alias("meets")).distinct().withColumnRenamed("shard", "to")
        rows = self.dealt().join(wanted, F.col("shard") == F.col("to")).select("label", "q", "ids", "shard", F.col("meets").alias("block"))
        tasks = min(2_000, self.shards * blocks)  # small inputs, but much work for each row
        left, right = (d.repartition(tasks, "shard", "block").groupBy("shard", "block") for d in (rows, visits))
        return left.cogroup(right).applyInArrow(run, "a long, b long, window int, score long, id long")

    def best(self, asked: DataFrame, same: bool, k: int) -> DataFrame:
        """``a``, ``b``, ``window``, ``score``, ``id``, ``rank``: the k best rows of each query and window.

        ``asked`` holds the query's ``a``, ``b`` (its name), ``label``, ``q``, ``tile`` and arrays ``low``, ``high``.
        """
        asked = materialize(asked, "asked")
        blocks = max(1, -(-asked.count() // QUERY_BLOCK))
        unbound = F.transform("low", lambda _: F.lit(NO_LOW))
        first = materialize(self.meet(self.visits(asked.withColumn("bound", unbound), True), blocks, same, k), "first")
        # the kth score of the own shard; a window with fewer rows there has no bound yet
        known = first.groupBy("a", "b", "window").agg(F.min("score").alias("s"), F.count("*").alias("n")).where(F.col("n") >= k)
        known = known.groupBy("a", "b").agg(F.map_from_entries(F.collect_list(F.struct("window", "s"))).alias("known"))
        bound = F.transform("low", lambda _, w: F.coalesce(F.try_element_at("known", w), F.lit(NO_LOW)))
        bounded = asked.join(known, ["a", "b"], "left").select(*asked.columns, bound.alias("bound"))
        found = first.unionByName(self.meet(self.visits(bounded, False), blocks, same, k))
        order = Window.partitionBy("a", "b", "window").orderBy(F.col("score").desc(), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    anchors: Callable[[Column], Column],
    label: Column,
    positives: int = 5,
    negatives: int = 5,
    window: tuple[int, int] = (80, 100),
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``anchors`` tells anchors by the id column, ``label`` is an expression over the columns of
    ``vectors``. For every anchor and each of its first positives (rows of its label under other
    ids) the first rows of other labels whose score lies within the ``window``, in hundredths of the
    positive's score. Higher scores come first, ties go by the smaller id.

    Rows with a null id, label, vector or component, or one that is not finite, take no part. Components
    are rounded down after scaling and held within 2 ** 24; shorter vectors end in zeros. A row repeated as
    it is counts once; different rows under one id each count, also as anchors. Anchors without a
    positive, and positives without a row in the window (always so at scores below zero), give no rows.
    """
    k = positives + 1  # an anchor may be among its own best
    rows = rows_of(vectors, scale, id_col, vector_col, label)
    order = Window.partitionBy("a", "b").orderBy("id")
    least = rows.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= max(k, negatives))
    points = least.groupBy("a", "b").agg(F.first("label").alias("label"), F.first("q").alias("q"), F.array_sort(F.collect_set("id")).alias("ids"))
    points = materialize(points, "distinct")
    size = points.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("width")).first()
    search = Search(points, max(1, size["width"] or 1), size["n"], shard_rows)
    named = materialize(rows.where(anchors(F.col("id"))).select(F.col("id").alias("anchor_id"), "a", "b").distinct(), "anchors")
    queries = search.points.join(named.select("a", "b").distinct(), ["a", "b"], "left_semi").select("a", "b", "label", "q", "tile")
    queries = materialize(queries, "queries")
    whole = queries.withColumns({"low": F.array(F.lit(NO_LOW)), "high": F.array(F.lit(NO_HIGH))})
    alike = search.best(whole, True, k).select("a", "b", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    alike = materialize(alike, "positives")
    # one window for each different score of the positives; whole numbers only
    scores = alike.groupBy("a", "b").agg(F.array_sort(F.collect_set("positive_score")).alias("scores"))
    least_, most = (F.expr(f"transform(scores, p -> (p * {share} + {up} - pmod(p * {share} + {up}, 100)) div 100)") for share, up in zip(window, (99, 0)))
    ranges = queries.join(scores, ["a", "b"]).withColumns({"low": least_, "high": most}).drop("scores")
    score = F.element_at("scores", F.col("window") + 1).alias("positive_score")
    other = search.best(ranges, False, negatives).join(scores, ["a", "b"])
    other = other.select("a", "b", score, F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    order = Window.partitionBy("anchor_id", "a", "b").orderBy(F.col("positive_score").desc(), "positive_id")
    pairs = named.join(alike, ["a", "b"]).where("anchor_id <> positive_id").withColumn("place", F.row_number().over(order))
    pairs = pairs.where(F.col("place") <= positives).drop("place")
    return pairs.join(other, ["a", "b", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


def sql() -> str:
    """The same by comparing every anchor with every row."""
    return """
WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score,
      row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank
      FROM p JOIN s USING (anchor_id)
      WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
