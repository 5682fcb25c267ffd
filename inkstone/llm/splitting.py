"""Splitting oversized items at natural boundaries (problem 5), by pointer doubling.

A cut after word ``e`` has one greedy successor: the farthest natural boundary at which the next
piece, which starts ``overlap`` words before ``e``, still fits. The successor of every position of
every text in a batch is found at once; squaring the successor table and spreading the set of
reached positions then yields all greedy cuts in a number of rounds logarithmic in the pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_WORDS = 1500
OVERLAP = 50
#: A boundary of a stronger kind is taken over a farther one of a weaker kind from this part of the piece on.
PARAGRAPH_FROM, SENTENCE_FROM = 0.5, 0.25
WORD = re.compile(r"[^ \t\n\r]+")
SENTENCE_END = re.compile(r"""[.!?;:。！？；|।॥…][)\]"'”’»›」』】）]*(?![^ \t\n\r])""")
CLAUSE_END = re.compile(r"[,;:、，–—-](?![^ \t\n\r])")
LINE_GAP = re.compile(r"[ \t]*[\n\r][ \t\n\r]*")


def boundary_kinds(text: str, ends: np.ndarray) -> np.ndarray:
    """For each word, given where it ends, the kind of boundary after it: 3 paragraph, 2 sentence, 1 clause, 0 none.

    Each kind's places are found by one scan of the text and matched with the words by their offsets.
    """
    kinds = np.zeros(len(ends), dtype=np.int8)
    paragraphs = (m.start() for m in LINE_GAP.finditer(text) if m.group().count("\n") > 1 or "\n" not in m.group() and m.group().count("\r") > 1)
    for kind, places in ((1, (m.end() for m in CLAUSE_END.finditer(text))), (2, (m.end() for m in SENTENCE_END.finditer(text))), (3, paragraphs)):
        at = np.fromiter(places, dtype=np.int64)
        k = np.searchsorted(ends, at)
        inside = k < len(ends)
        k, at = k[inside], at[inside]
        kinds[k[ends[k] == at]] = kind
    kinds[-1:] = 3
    return kinds


def successors(kinds: np.ndarray, size: int, overlap: int) -> np.ndarray:
    """The greedy successor of each cut position 0..n of one text of n words; n leads to itself."""
    n = len(kinds)
    at = np.arange(n + 1)
    start = np.maximum(at - overlap, 0)
    limit = np.minimum(start + size, n)
    out = limit.copy()
    position = np.arange(n + 1)
    # from the weakest kind to the strongest, so that a stronger boundary far enough on wins
    for kind, share in ((1, 0.5), (2, SENTENCE_FROM), (3, PARAGRAPH_FROM)):
        is_cut = np.zeros(n + 1, dtype=bool)
        is_cut[1:] = kinds >= kind
        last = np.maximum.accumulate(np.where(is_cut, position, 0))[limit]
        fits = (last > at) & (last > start + overlap) & (last - start >= share * size)
        out = np.where(fits, last, out)
    return np.where(limit >= n, n, out)


def greedy_cuts(table: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Positions reached from ``roots`` by following ``table`` any number of times, by pointer doubling."""
    reached = np.zeros(len(table), dtype=bool)
    reached[roots] = True
    while True:
        ahead = table[np.flatnonzero(reached)]
        if reached[ahead].all():
            return reached
        reached[ahead] = True
        table = table[table]


def split_texts(texts: list[str], size: int = MAX_WORDS, overlap: int = OVERLAP) -> list[list[tuple[int, int, int, int]]]:
    """For each text its pieces as ``(first word, end word, start offset, end offset)``; one piece if it fits."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than the size")
    spans, tables, bases, base = [], [], [], 0
    for text in texts:
        both = np.array([m.span() for m in WORD.finditer(text)], dtype=np.int64).reshape(-1, 2)
        spans.append(both)
        n = len(both)
        own = successors(boundary_kinds(text, both[:, 1]), size, overlap) if n > size else np.full(n + 1, n)
        tables.append(own + base)
        bases.append(base)
        base += n + 1
    if not texts:
        return []
    reached = greedy_cuts(np.concatenate(tables), np.array(bases))
    out = []
    for both, first in zip(spans, bases, strict=True):
        cuts = np.flatnonzero(reached[first : first + len(both) + 1])
        pieces = []
        for before, end in zip(cuts[:-1], cuts[1:], strict=True):
            start = max(int(before) - overlap, 0) if before else 0
            pieces.append((start, int(end), int(both[start, 0]), int(both[end - 1, 1])))
        out.append(pieces)
    return out


def split_oversized(df: DataFrame, key: str = "chunk_id", text: str = "text", size: int = MAX_WORDS, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """Pieces of every item of more than ``size`` words: ``key, piece, first_word, end_word, start_pos, end_pos[, piece_text]``.

    A word is a longest run of characters other than blank, tab and line ends. Offsets are 0-based
    code points. Pieces hold at most ``size`` words; each repeats the last ``overlap`` words of the
    one before. Null, empty and short texts give no rows. A key counts once, by the least of its texts that are long
    enough to be oversized, chosen before anything is cut; null keys and further columns are left out.
    """
    # an item of more than `size` words has at least 2 * size + 1 characters, so no oversized item is left out
    long = df.where(F.col(key).isNotNull() & (F.length(text) > 2 * size)).groupBy(key).agg(F.min(text).alias(text))
    fields = [T.StructField(c, T.IntegerType()) for c in ("piece", "first_word", "end_word", "start_pos", "end_pos")]
    schema = T.StructType([long.schema[key], *fields, *[T.StructField("piece_text", T.StringType())] * with_text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                keys, texts = batch.column(0)[a : a + 256].to_pylist(), batch.column(1)[a : a + 256].to_pylist()
                rows = []
                for k, t, pieces in zip(keys, texts, split_texts(texts, size, overlap), strict=True):
                    if len(pieces) > 1:
                        rows += [(k, i, *p, *([t[p[2] : p[3]]] if with_text else [])) for i, p in enumerate(pieces)]
                if rows:
                    columns = [pa.array(c, type=f) for c, f in zip(zip(*rows, strict=True), arrow_types, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_types, names = [to_arrow_type(f.dataType) for f in schema.fields], schema.names
    return long.mapInArrow(run, schema)
