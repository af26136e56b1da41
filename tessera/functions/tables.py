"""Chunkers and readers as table functions for SQL: SELECT ... FROM docs, LATERAL chunk_packed(docs.text, 300).

They are the extension point for code that is not a Column expression; rows leave in Arrow batches. Built-in chunkers
are faster as Columns (`chunk`).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .chunk import SENTENCE

CHUNKS, UNITS = "pos int, chunk string", "unit_index int, text string, error string"


def pack(sentences: Iterable[str], size: int) -> Iterable[str]:
    """Sentences joined while they fit `size`; a longer sentence stands alone."""
    held = ""
    for s in sentences:
        if held and len(held) + len(s) > size:
            yield held
            held = ""
        held += s
    if held:
        yield held


def table_of(chunker: Callable[..., Iterable[str]]):
    """A table function (pos, chunk) of chunker(text, ...); null or empty text has no rows."""

    class Chunks:
        def eval(self, text, *args):
            if text:
                yield from enumerate(chunker(text, *args))

    return F.udtf(Chunks, returnType=CHUNKS, useArrow=True)


def units_of(readers: dict | None):
    class Units:
        def eval(self, kind, content):
            from ..errors import FileError
            from ..sources.readers import units

            if kind is None or content is None:
                return
            try:
                for n, text in units(kind, bytes(content), readers):
                    yield n, text, None
            except (FileError, ValueError) as e:
                yield None, None, str(e)

    return F.udtf(Units, returnType=UNITS, useArrow=True)


def register(spark: SparkSession, chunkers: dict[str, Callable] | None = None, readers: dict | None = None) -> None:
    """chunk_sentences(text), chunk_packed(text, size), file_units(kind, content), and own chunkers by name."""
    spark.udtf.register("chunk_sentences", table_of(lambda text: re.findall(SENTENCE, text)))
    spark.udtf.register("chunk_packed", table_of(lambda text, size: pack(re.findall(SENTENCE, text), size)))
    spark.udtf.register("file_units", units_of(readers))
    for name, f in (chunkers or {}).items():
        spark.udtf.register(name, table_of(f))
