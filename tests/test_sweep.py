"""Event sweeps against brute force over every pair of route and segment."""

import random

from pyspark.sql import functions as F

from terrachron.operators import routes, sweep
from test_operators import LINE, ROUTE_SCHEMA


def sources_of(spark, rows):
    """Rows of (way, osm_id, ref, direction, highway, start, end)."""
    full = [(w, i, r, "road", "road", "n", None, f"N{i}", None, d, {"k": str(i)}, LINE, s, e, h) for w, i, r, d, h, s, e in rows]
    return spark.createDataFrame(full, ROUTE_SCHEMA)


def brute(rows, keep_open_start=False):
    """Periods with their counts and routes, by looking at every route in every segment."""
    found = []
    for way in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == way]
        dates = sorted({d for r in mine for d in r[5:7] if d is not None})
        segments = list(zip(dates, [*dates[1:], None]))
        if keep_open_start and dates:
            segments.insert(0, (None, dates[0]))
        runs = {}
        for s, e in segments:
            here = [r for r in mine if (r[5] is None or r[5] < (9999 if e is None else e)) and (r[6] is None or r[6] > (float("-inf") if s is None else s))]
            first = {}
            for r in sorted(here, key=lambda r: r[1]):
                first.setdefault((r[2], r[3]), r)
            if not first:
                continue
            kept = list(first.values())
            key = tuple(sorted((r[2] or "").upper().strip() for r in kept))
            known = runs.setdefault(key, [])
            one = dict(s=s, e=e, n=len({r[1] for r in kept}), h=max((r[4] for r in kept if r[4]), default=None), first=sorted(r[1] for r in kept))
            previous = known[-1]["e"] if known else None
            # the rule of the merge: an unknown end before is a new period
            if known and previous is not None and not (s is not None and s - previous > 1 / 365):
                last = known[-1]
                last["e"] = max((x for x in (last["top"], e) if x is not None), default=None)
                last.update(top=last["e"], n=max(last["n"], one["n"]), h=max((x for x in (last["h"], one["h"]) if x), default=None))
                last["e"], last["end"] = e, last["top"]
            else:
                one.update(top=e, end=e)
                known.append(one)
        found += [(way, k["s"], k["end"], k["n"], k["h"], tuple(k["first"])) for group in runs.values() for k in group]
    return sorted(found, key=str)


def swept(frame, keep_open_start=False):
    periods, members = routes.normalize_routes(frame, keep_open_start)
    key = ["way_id", "min_start_decdate", "max_end_decdate"]
    lists = {}
    for r in members.collect():
        lists.setdefault(tuple(r[c] for c in key), []).append(r["osm_id"])
    return sorted(
        (
            (r.way_id, r.min_start_decdate, r.max_end_decdate, r.num_routes, r.highway, tuple(sorted(lists[(r.way_id, r.min_start_decdate, r.max_end_decdate)])))
            for r in periods.collect()
        ),
        key=str,
    )


def random_rows(seed, n):
    draw = random.Random(seed)
    dates = [None, None, *map(float, range(1900, 1914))]
    return [
        (draw.randrange(6), draw.randrange(n), draw.choice(["1", "2", " 2", None]), draw.choice(["n", None]), draw.choice(["a", "b", None]), draw.choice(dates), draw.choice(dates))
        for _ in range(n)
    ]


def test_sweep_against_every_pair(spark):
    """Repeats, shared ids, unknown values, empty ranges, several highways."""
    rows = random_rows(5, 90)
    rows = [r for r in rows if any(x[0] == r[0] and (x[5] is not None or x[6] is not None) for x in rows)]
    # one row for each order key, so that the first of repeats is one row
    rows = list({(r[0], r[1], r[2], r[3]): r for r in rows}.values())
    assert swept(sources_of(spark, rows)) == brute(rows)
    assert len(brute(rows)) > 20


def test_one_way_with_very_many_routes(spark):
    """A row for each route and segment would be 200 million rows for the repeats alone."""
    many = 20_000
    repeats = [(1, i, "1", None, "a", 1000.0 + i / 1000, 1500.0 + i / 1000) for i in range(many)]
    short = [(2, i, str(i), None, "b", float(i), float(i + 1)) for i in range(many // 10)]
    periods, members = routes.normalize_routes(sources_of(spark, repeats + short))
    found = {r.way_id: (r["count"], r.m) for r in periods.groupBy("way_id").agg(F.count("*").alias("count"), F.max("num_routes").alias("m")).collect()}
    assert found == {1: (1, 1), 2: (many // 10, 1)}
    assert [(r.way_id, r.n) for r in members.groupBy("way_id").agg(F.count("*").alias("n")).orderBy("way_id").collect()] == [(1, 1), (2, many // 10)]


def test_least_over_points(spark):
    draw = random.Random(2)
    ranges = [(g, a, draw.randrange(a + 1, 41), draw.randrange(1000)) for g in (1, 2) for a in (draw.randrange(1, 40) for _ in range(30))]
    points = [(g, i, 40) for g in (1, 2) for i in range(1, 41)]
    frame = spark.createDataFrame(points, "g int, i long, n long")
    got = {(r.g, r.i): r.v for r in sweep.least_over(frame, spark.createDataFrame(ranges, "g int, a long, b long, v int"), ["g"], "v").collect()}
    want = {}
    for g, a, b, v in ranges:
        for i in range(a, b):
            want[g, i] = min(v, want.get((g, i), v))
    assert got == want


def plain(rows):
    return sorted(str({k: v for k, v in r.asDict(recursive=True).items() if k != "geometry"}) for r in rows.collect())


def test_ways_as_lists_equal_the_sweep(spark):
    """The forms of the queries, with the larger ways swept and the others as lists, against the sweep alone."""
    rows = [r for r in random_rows(7, 80) if r[0] < 5] + [(9, i, str(i % 3), None, "a", None, None) for i in range(4)] + [(10, 1, "1", None, "a", 1905.0, 1901.0)]
    rows = list({(r[0], r[1], r[2], r[3]): r for r in rows}.values())
    sources = sources_of(spark, rows)
    assert plain(routes.normalize_routes(sources)[1]) == plain(routes.normalize_routes(sources, listed=0)[1])
    periods, members = routes.swept_periods(sources)
    want = plain(routes.routes_with_lists(periods, members)), plain(routes.index_routes(periods, members))
    for listed in (12, 128):
        got = plain(routes.normalized_lists(sources, listed=listed).select(routes.routes_with_lists(periods, members).columns))
        assert (got, plain(routes.normalized_slots(sources, listed=listed))) == want


def test_ordinary_ways_are_dealt_out_once(spark):
    """One exchange by way, none for segments, merging, ranks and slots."""
    sources = sources_of(spark, random_rows(5, 40))
    plan = routes.normalized_slots(sources)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1
