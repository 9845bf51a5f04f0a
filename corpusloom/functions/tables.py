"""Chunkers as table functions, so that SQL cuts texts as the DataFrame functions do: ``FROM documents, LATERAL chunk_merge(text, 500, 100, 'line')``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import chunking

OUT = "chunk int, start int, end int, chunk_text string"


def _rows(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, str]]:
    for i, (a, b) in enumerate(spans):
        yield i, a, b, text[a:b]


@F.udtf(returnType=OUT, useArrow=True)
class ChunkMerge:
    """Atoms packed to ``target`` characters, overlapping by ``overlap``. Null and empty texts give no rows."""

    def eval(self, text: str, target: int, overlap: int, mode: str) -> Iterator[tuple]:
        if text:
            yield from _rows(text, chunking.merged(chunking.atoms(text, mode), target, overlap))


@F.udtf(returnType=OUT, useArrow=True)
class ChunkStructure:
    """Atoms, those over ``most`` characters cut."""

    def eval(self, text: str, most: int, mode: str) -> Iterator[tuple]:
        if text:
            yield from _rows(text, chunking.split_long(text, chunking.atoms(text, mode), most))


@F.udtf(returnType=OUT, useArrow=True)
class ChunkWindow:
    """Windows of ``target`` characters, overlapping by ``overlap``."""

    def eval(self, text: str, target: int, overlap: int) -> Iterator[tuple]:
        if text:
            yield from _rows(text, chunking.windows(text, target, overlap))


FUNCTIONS = {"chunk_merge": ChunkMerge, "chunk_structure": ChunkStructure, "chunk_window": ChunkWindow}


def register(spark: SparkSession) -> None:
    """Make all of them known to the session's SQL."""
    for name, f in FUNCTIONS.items():
        spark.udtf.register(name, f)
