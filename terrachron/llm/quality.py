"""Line-first cleaning by quality rules, in column expressions alone.

Each line is held against three rules; lines that fail go. A document is rejected if
the lines that went hold more than a share of its words, or if its words alone tell
against it (too few, or too many in repeated word sequences).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terrachron.llm import common

WORD_BREAKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Separators of menus and link lists.
SEPARATORS = "|»›·•"
#: A line with a sentence ends in one of these.
SENTENCE_END = r"[.!?…:;)\x22'”’»][\x20\x09-\x0D]*\z"
#: Phrases of page furniture, in lower case.
PHRASES = (
    "all rights reserved|click here|cookie|copyright|javascript|licensed under|log in|lorem ipsum"
    "|powered by|privacy policy|read more|share this|sign in|subscribe|terms of service|terms of use"
)
SHORT_LINE = 10
PHRASE_LINE = 25
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
MAX_LOST_PERCENT = 50


def occurrences(text: Column, characters: str) -> Column:
    """How many of the characters are in the text."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def line_fails(line: Column, n: Column) -> Column:
    """The three rules on a line of ``n`` words."""
    punctuation = (
        ((n < SHORT_LINE) & ~line.rlike(SENTENCE_END))
        | (occurrences(line, SYMBOLS) * 10 > n * 3)
        | (occurrences(line, "!") * 2 > n)
    )
    separators = occurrences(line, SEPARATORS)
    navigation = (separators >= 2) & (separators * 5 > n)
    boilerplate = (n <= PHRASE_LINE) & F.lower(line).rlike(PHRASES)
    return (n > 0) & (punctuation | navigation | boilerplate)


def repeated_words(words: Column, hashes: Column, window: int = WINDOW) -> Column:
    """Words in windows that occur twice or more; ``hashes`` holds the hash of each window.

    Places of repeated windows are found by sorting (hash, place); each then covers
    the words up to the next such place, ``window`` at most.
    """
    tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def places(s: Column) -> Column:
        near = lambda x, i, k: F.coalesce(F.get(s, i + k)["h"] == x["h"], F.lit(False))
        marked = F.transform(s, lambda x, i: F.when(near(x, i, -1) | near(x, i, 1), x["i"]))
        return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1), x + window) - x))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    found = let(tagged, lambda s: let(places(s), covered))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(found)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures and verdict of every document, and its text without the lines that fail.

    Columns: ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``n_lost_words``, ``base_failed``, ``kept``, ``clean_text``.
    A null or empty text has no words, so it fails. Rows are judged one by one: copies
    get the same verdict. Lines without words are neither judged nor counted.
    Windows are compared by 64-bit hashes within a document.
    """
    text, words, hashes = F.col("text"), F.col("words"), F.col("hashes")
    rows = common.documents(docs, id_col, text_col).select("doc_id", "text", common.words_of(text).alias("words"))
    lines = F.transform(
        F.split(text, "\n"), lambda l: F.struct(l.alias("line"), F.size(common.words_of(l)).alias("n"))
    )
    window_hash = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    rows = rows.select(
        "doc_id",
        "text",
        "words",
        F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), window_hash))
        .otherwise(F.array().cast("array<bigint>"))
        .alias("hashes"),
        F.transform(
            lines, lambda x: F.struct(x["line"], x["n"], line_fails(x["line"], x["n"]).alias("fails"))
        ).alias("lines"),
    )
    written = F.transform(F.filter("lines", lambda x: x["n"] > 0), lambda x: x["line"])
    lost = F.aggregate("lines", F.lit(0), lambda total, x: total + F.when(x["fails"], x["n"]).otherwise(0))
    rows = rows.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.translate(text, WORD_BREAKS, "")).cast("long").alias("word_chars"),
        occurrences(text, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size(written) - F.size(F.array_distinct(written))).cast("long").alias("n_dup_lines"),
        repeated_words(words, hashes).cast("long").alias("n_repeat_words"),
        lost.cast("long").alias("n_lost_words"),
        F.array_join(F.transform(F.filter("lines", lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT)
    rows = rows.select("*", failed.alias("base_failed"))
    kept = ~F.col("base_failed") & (F.col("n_lost_words") * 100 <= F.col("n_words") * MAX_LOST_PERCENT)
    return rows.select(*[c for c in rows.columns if c != "clean_text"], kept.alias("kept"), "clean_text")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that pass, with the text of their remaining lines: ``doc_id``, ``text``."""
    return measure(docs, id_col, text_col).where("kept").select("doc_id", F.col("clean_text").alias("text"))


def sql() -> str:
    """The measures and the verdict as SQL, without the text."""
    end = SENTENCE_END.replace("'", "''")
    count = lambda s, c: f"(length({s}) - length(translate({s}, '{c}', '')))"
    space = r"'[\x20\x09-\x0D]+'"
    split = lambda s: f"list_filter(regexp_split_to_array({s}, {space}), lambda x: x <> '')"
    return rf"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') t, {split("coalesce(text, '')")} w FROM documents),
l AS (SELECT rid, line, len({split("line")}) n FROM (SELECT rid, unnest(string_split(t, chr(10))) line FROM d)),
f AS (SELECT *, n > 0 AND (
  (n < {SHORT_LINE} AND NOT regexp_matches(line, '{end}')) OR {count("line", SYMBOLS)} * 10 > n * 3 OR {count("line", "!")} * 2 > n
  OR ({count("line", SEPARATORS)} >= 2 AND {count("line", SEPARATORS)} * 5 > n)
  OR (n <= {PHRASE_LINE} AND regexp_matches(lower(line), '{PHRASES}'))) fails FROM l),
a AS (SELECT rid, coalesce(sum(n) FILTER (fails), 0) lost, count(line) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) dup FROM f GROUP BY rid),
g AS (SELECT rid, i, array_to_string(w[i:i+4], ' ') s FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) i FROM d)),
r AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, s) n FROM g) WHERE n > 1),
c AS (SELECT rid, sum(least({WINDOW}, coalesce(after, i + {WINDOW}) - i)) rep
      FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) after FROM r) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT n_words, length(regexp_replace(t, {space}, '', 'g'))::BIGINT word_chars,
  {count("t", SYMBOLS)}::BIGINT n_symbols, dup::BIGINT n_dup_lines, coalesce(rep, 0)::BIGINT n_repeat_words, lost::BIGINT n_lost_words
  FROM d JOIN a USING (rid) LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEATED_PERCENT} base_failed FROM m)
SELECT *, NOT base_failed AND n_lost_words * 100 <= n_words * {MAX_LOST_PERCENT} kept FROM b"""
