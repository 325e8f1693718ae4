"""Line deduplication by site-relative frequency.

A line that stands on more than a share of a host's pages is boilerplate of that host and
is dropped from all its pages. Counting combines below the shuffle, keys hold host
and line, so a host with a third of all pages is spread like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from terrachron.llm import common
from terrachron.session import materialize

MAX_RATIO = 0.02
#: Lines on fewer pages than this are never boilerplate, however small the host.
MIN_PAGES = 5
#: Line keys of all hosts that are broadcast together, at most; beyond, pages are joined by host and salt.
BROADCAST_KEYS = 1_000_000
SALTS = 64
BLANKS = " \t\r\x0b\f"


def line_key(line: Column) -> Column:
    """Hash of a line without blanks at its ends; null for an empty line."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Line keys to drop of each host: ``host``, ``drop``. ``pages`` has ``host`` and ``keys``.

    A host's list has at most its mean lines a page divided by ``max_ratio``.
    """
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    lines = pages.select("host", F.explode(F.array_distinct("keys")).alias("key")).where("key is not null")
    counts = lines.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    frequent = counts.join(totals, "host").where(F.col("n") > F.col("pages") * F.lit(max_ratio))
    return frequent.groupBy("host").agg(F.collect_set("key").alias("drop"))


def with_lists(pages: DataFrame, drop: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Pages with their host's list. Lists of a checked size are broadcast, so that no page moves;
    larger ones are repeated for each salt, so that a host's pages go to many tasks."""
    if drop.agg(F.coalesce(F.sum(F.size("drop")), F.lit(0)).alias("n")).first()["n"] <= broadcast_keys:
        return pages.join(F.broadcast(drop), "host", "left")
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)))
    copies = drop.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, ["host", "salt"], "left").drop("salt")


def deduplicate(
    docs: DataFrame,
    host_col: str = "source",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per input row: ``doc_id``, ``text`` without boilerplate lines, ``n_lines``, ``n_dropped``,
    and the columns to ``keep``.

    Lines without words are kept and not counted. A line counts once a page. Pages
    with a null host form one host. A null text is empty; a page that loses all lines
    stays with an empty text. Repeated rows are pages of their own.
    """
    pages = common.documents(docs, id_col, text_col, keep, host=host_col)
    pages = pages.select("doc_id", "text", "carried", F.coalesce(F.col("host").cast("string"), F.lit("")).alias("host"))
    keys = F.transform(F.split("text", "\n"), line_key)
    drop = materialize(boilerplate(pages.select("host", keys.alias("keys")), max_ratio, min_pages), "boilerplate")
    joined = with_lists(pages, drop)
    marked = F.transform(
        F.split("text", "\n"),
        lambda l: F.struct(l.alias("line"), line_key(l).isNotNull().alias("counts"), F.coalesce(F.array_contains("drop", line_key(l)), F.lit(False)).alias("gone")),
    )
    joined = joined.select("doc_id", "text", "carried", F.when(F.col("drop").isNotNull(), marked).alias("lines"), F.size(F.filter(keys, lambda k: k.isNotNull())).alias("n"))
    kept = F.array_join(F.transform(F.filter("lines", lambda x: ~x["gone"]), lambda x: x["line"]), "\n")
    return joined.select(
        "doc_id",
        F.coalesce(kept, "text").alias("text"),
        F.col("n").cast("long").alias("n_lines"),
        F.coalesce(F.size(F.filter("lines", lambda x: x["gone"])), F.lit(0)).cast("long").alias("n_dropped"),
        *[F.col("carried")[c].alias(c) for c in keep],
    )


def sql(max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> str:
    """The result with a hash in place of the text."""
    blanks = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
    return f"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') t, coalesce(source, '') host FROM documents),
l AS (SELECT rid, host, u.i, u.line, trim(u.line, {blanks}) bare
      FROM (SELECT rid, host, unnest(list_transform(string_split(t, chr(10)), lambda x, i: {{'i': i, 'line': x}})) u FROM d)),
c AS (SELECT host, bare, count(DISTINCT rid) n FROM l WHERE bare <> '' GROUP BY ALL),
p AS (SELECT host, count(*) pages FROM d GROUP BY host),
b AS (SELECT host, bare FROM c JOIN p USING (host) WHERE n >= {min_pages} AND n > pages * {max_ratio}),
m AS (SELECT l.*, b.bare IS NOT NULL gone FROM l LEFT JOIN b ON l.host = b.host AND l.bare = b.bare),
k AS (SELECT rid, count(*) FILTER (bare <> '') n_lines, count(*) FILTER (gone) n_dropped,
      coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') kept FROM m GROUP BY rid)
SELECT doc_id, n_lines, n_dropped, sha256(kept) kept_sha256 FROM d JOIN k USING (rid)"""
