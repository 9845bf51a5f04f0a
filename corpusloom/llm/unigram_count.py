"""How many pieces a unigram tokenizer makes of a text, without making them.

An Aho-Corasick automaton over the vocabulary gives, at each end, every piece that ends there. Dynamic programming carries,
per end, the best score of a way to it and that way's number of pieces. The rules are those of the tokenizers library's
unigram model: a candidate replaces the best so far only if its score is greater, and candidates come by start, earliest
first; where no piece covers just the next character, that character is unknown at the least score less 10; runs of unknown characters are
written as byte pieces, one per UTF-8 byte, or, without byte pieces, as one unknown piece; the unknown piece's own name counts
among them.

A text is cut before runs of the space mark, and around characters that no piece contains, where that can't change the best way:
no piece reaches over such a cut. Each distinct part is worked out once per task (held up to CACHE parts) and a text's
count is the sum. Null and empty texts have no pieces. Special pieces written out in a text are ordinary text to the vocabulary they are in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm import textkit

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 1_200_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with scores, the id of the unknown piece, and whether bytes stand in for it."""

    pieces: tuple[tuple[str, float], ...]
    unknown: int
    byte_fallback: bool


@cache
def vocabulary(path: str) -> Vocabulary:
    """The pieces and scores of a SentencePiece model file, to be read as a unigram vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = tuple((model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size()))
    return Vocabulary(pieces, model.unk_id(), any(model.is_byte(i) for i in range(len(pieces))))


class Counter:
    """Counts pieces of texts for one vocabulary; holds the automaton and the parts seen."""

    def __init__(self, vocab: Vocabulary) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        best: dict[str, float] = {}
        for piece, score in vocab.pieces:
            best[piece] = score  # of equal pieces the last one counts
        for piece, score in best.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if best:
            self.automaton.make_automaton()
        self.pieces = set(best)
        self.single = {p for p in best if len(p) == 1}
        self.unknown = vocab.pieces[vocab.unknown][0] if vocab.pieces else None
        self.unknown_score = min((s for _, s in vocab.pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes = vocab.byte_fallback
        inside = {c for p in best for c in p}
        # A cut is safe between a part and a following mark unless a piece has a mark after another character.
        self.by_mark = not any(re.search(f"[^{MARK}]{MARK}", p) for p in best)
        # Characters in no piece are cut out only where neighbours can't fuse with them into one unknown piece.
        self.lone = "\n" not in inside and self.bytes
        self.held: dict[str, int] = {}

    def part(self, text: str) -> int:
        """Pieces of one part, by the best way."""
        n = len(text)
        # By end: the best score, the pieces written so far, and where the run of unknowns that is still open began (-1: none is).
        score, count, opened = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, (size, value) in self.automaton.iter(text):
            ends[end + 1].append((end + 1 - size, value))
        for end in range(1, n + 1):
            ways = sorted(ends[end])
            if text[end - 1] not in self.single:
                ways.append((end - 1, None))
            best, came, raw = None, 0, False
            for start, value in ways:
                total = score[start] + (self.unknown_score if value is None else value)
                if best is None or total > best:
                    best, came, raw = total, start, value is None
            score[end] = best
            if raw or text[came:end] == self.unknown:
                count[end], opened[end] = count[came], came if opened[came] < 0 else opened[came]
            else:
                count[end] = count[came] + self.written(text, opened[came], came) + 1
        return count[n] + self.written(text, opened[n], n)

    def written(self, text: str, start: int, end: int) -> int:
        """Pieces of a run of unknowns: one if it is a piece as it stands or bytes don't stand in, else its bytes."""
        if start < 0:
            return 0
        run = text[start:end]
        return 1 if run in self.pieces or not self.bytes else len(run.encode("utf-8"))

    def parts(self, text: str) -> list[str]:
        """The text with its space marks, cut where no piece reaches over."""
        text = MARK + text.replace(" ", MARK)
        if self.lone:
            text = text.replace("\n", "\0\n\0")
        if self.by_mark:
            text = re.sub(f"(?<=[^{MARK}\0]){MARK}", f"\0{MARK}", text)
        return text.split("\0")

    def count(self, text: str) -> int:
        """Pieces of a text."""
        if not text:
            return 0
        if "\0" in text or (self.unknown and self.unknown in text):
            return self.part(MARK + text.replace(" ", MARK))
        # The common case: words between single spaces and line ends.
        words = text.replace("\n", " \n ").split(" ")
        if not (self.lone and self.by_mark) or MARK in text or "" in words or text[0] == "\n" or text[-1] == "\n":
            return sum(self.look(p) for p in self.parts(text) if p)
        held = self.held
        total = 0
        begins = True
        for w in words:
            if w == "\n":
                total, begins = total + 1, False
                continue
            w = MARK + w if begins else w
            begins = True
            n = held.get(w)
            total += self.look(w) if n is None else n
        return total

    def look(self, part: str) -> int:
        """The count of a part, held for next time."""
        n = self.held.get(part)
        if n is None:
            if len(self.held) >= CACHE:
                self.held.clear()
            n = self.part(part)
            if len(part) <= 64:
                self.held[part] = n
        return n


@cache
def counter(path: str) -> Counter:
    """One counter per worker and file."""
    return Counter(vocabulary(path))


def with_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` without its text column, plus ``n_tokens``, which replaces a column of that name."""
    kept = [i for i, f in enumerate(docs.schema.fields) if f.name not in (text_col, "n_tokens")]
    keep = [docs.schema.fields[i] for i in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(path)
        for batch in batches:
            n = np.array([known.count(x.as_py()) if x.is_valid else 0 for x in textkit.text_column(batch, text_col)], np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(n)], [*(f.name for f in keep), "n_tokens"])

    return docs.mapInArrow(run, T.StructType([*keep, T.StructField("n_tokens", T.LongType())]))
