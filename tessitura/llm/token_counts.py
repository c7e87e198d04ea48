"""Token counts of sections from one encoding of the whole document.

A document is encoded once; the character spans of its tokens are then joined with the spans of its
sections. A token that crosses a boundary goes by an explicit rule: to the section of its first
character ("first"), of its last one ("last"), or to each by its share of characters ("split").
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, encoded_texts, encoder, vocabulary_text
from .common import bound_batches
from .words import text_column

RULES = ("first", "last", "split")
NAMES = ["doc_id", "section", "start", "end", "n_tokens"]
#: Sections gathered before they are handed on.
ROWS = 50_000


def token_spans(own: Encoder, word: str, codes: str) -> list[tuple[int, int]]:
    """Character spans of the tokens of one word, given by its ids; a token that holds part of a character spans it whole."""
    of = [k for k, c in enumerate(word) for _ in range(len(c.encode()))]
    spans, at = [], 0
    for i in map(int, codes.split(",")):
        size = len(own.vocabulary.tokens[i])
        spans.append((of[at], of[at + size - 1] + 1))
        at += size
    return spans


def tokens_before(own: Encoder, word: str, codes: str, cut: int, rule: str) -> float:
    """Tokens of a word that belong before a place inside it."""
    spans = token_spans(own, word, codes)
    if rule == "first":
        return sum(a < cut for a, _ in spans)
    if rule == "last":
        return sum(b <= cut for _, b in spans)
    return sum(min(max(cut - a, 0), b - a) / (b - a) for a, b in spans)


def section_counts(own: Encoder, runs: Iterable[tuple[list[str], list[int]]], ends: list[int], rule: str) -> list[float]:
    """Tokens of consecutive sections of a text, given by runs of its words with their numbers of tokens, that end at the given places, the last at the text's end."""
    upto: list[float] = []
    place = total = 0
    for words, found in runs:
        starts = list(accumulate(map(len, words), initial=place))
        before = list(accumulate(found, initial=total))
        while len(upto) < len(ends) - 1 and ends[len(upto)] < starts[-1]:
            end = ends[len(upto)]
            k = bisect_right(starts, end) - 1
            inside = end - starts[k]
            upto.append(before[k] + (tokens_before(own, words[k], own.codes(words[k]), inside, rule) if inside else 0))
        place, total = starts[-1], before[-1]
    upto += [total] * (len(ends) - len(upto))
    return [b - a for a, b in zip([0, *upto], upto, strict=False)]


def token_counts(
    docs: DataFrame, vocabulary: str, boundary: str = r"\n", rule: str = "first", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each section of each document: doc_id, section (from 0), start, end, n_tokens (double).

    Sections end after each match of `boundary`, empty matches aside; start and end are code points, together
    they cover the text, and their counts add up to the document's tokens. An empty or null text has one empty
    section. Rows with null or repeated ids give their sections each. Other columns are ignored; an
    empty table gives an empty result.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary_text(docs.sparkSession, vocabulary))

    def run(batches):
        own, cut = encoder(spec.value, counts=True), re.compile(boundary)
        types = pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, value, runs in zip(batch.column(0).to_pylist(), batch.column(1), encoded_texts(own, batch.column(1)), strict=True):
                text = value.as_py()
                ends = [m.end() for m in cut.finditer(text) if m.end() > m.start() and m.end() < len(text)] + [len(text)]
                counts = section_counts(own, runs, ends, rule)
                for column, values in zip(rows, ([doc] * len(ends), range(len(ends)), [0, *ends[:-1]], ends, counts), strict=True):
                    column.extend(values)
                if len(rows[0]) > ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=NAMES)
                    rows = ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=NAMES)

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, "doc_id long, section int, start int, end int, n_tokens double")
