"""Helpers shared by the text operators.

Every operator takes only the columns it is told to use and returns only its own
columns, so extra input columns, also those with the names of results, change
nothing. Documents keep their identifier as ``doc_id``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

#: Words of all operators: what stands between space, tab, line feed and the other ASCII breaks.
BREAKS = r"[\x20\x09-\x0D]+"
_BREAKS = re.compile(BREAKS)
#: Identifiers are broadcast up to this many; beyond, a join shuffles.
BROADCAST_ROWS = 2_000_000
#: Text handled at once inside a task.
SLICE_BYTES = 4 << 20


def documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] | None = None, **more: str
) -> DataFrame:
    """The used columns under fixed names; a null text is empty. Columns to ``keep`` go into a struct ``carried``."""
    if keep is not None:
        return documents(docs, id_col, text_col, **more, carried=F.struct(F.lit(0).alias("_"), *[docs[c] for c in keep]))
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
        *[(docs[c] if isinstance(c, str) else c).alias(name) for name, c in more.items()],
    )


def small(ids: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if its rows, which are counted, are few enough."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def words_of(text: Column | str) -> Column:
    """Array of words as a column; empty for a text without any."""
    return F.array_remove(F.split(text, BREAKS), "")


def split_words(text: str) -> list[str]:
    """The same words in Python."""
    if text.isascii() and not re.search(r"[\x1c-\x1f]", text):
        return text.split()
    return [w for w in _BREAKS.split(text) if w]


def held_out(doc_id: Column | str) -> Column:
    """True for the fold that no model learns from."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``most`` bytes of text, one row at least."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(text)).to_pylist()
        start = held = 0
        for row, n in enumerate(lengths):
            n = n or 0
            if row > start and held + n > most:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += n
        if start < len(lengths):
            yield batch.slice(start)
