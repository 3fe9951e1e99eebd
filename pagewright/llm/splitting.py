"""Splitting oversized texts at natural boundaries, with overlap, by pointer doubling.

Every legal cut position of a text is a node. A node's successor is the farthest legal end of the piece that begins
with the overlap before it. Squaring the successor table (S <- S[S]) while widening the reached set by the current
table yields all greedy cuts in O(log pieces) gathers, each over whole arrays.

Defined results: a null text, an empty text and a text within the limit give one piece (null, empty, whole). Rows are
kept one for one with repeats; only the caller drops redelivered rows. Texts of any length are processed whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP = 320, 40

#: Ends of sentences and lines, with closing marks and the blanks after them.
_STRONG = re.compile(r"[.!?…;:]+[\"'”’»)\]]*\s+|[。！？；]+[」』）”]*|\n+")
#: Ends of words: blanks, or the marks after which scripts without blanks may break.
_WEAK = re.compile(r"\s+|[、，・]|(?<=\w)[-–—/](?=\w)")
_CUTS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("boundary", T.StringType())]))
_KINDS = ("hard", "word", "sentence", "end")


def _nodes(text: str, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cut positions and their kinds (0 hard, 1 word, 2 sentence, 3 end); hard ones only in stretches without others."""
    n = len(text)
    kind = np.zeros(n + 1, dtype=np.int8)
    for m in _WEAK.finditer(text):
        kind[m.end()] = 1
    for m in _STRONG.finditer(text):
        kind[m.end()] = 2
    kind[n] = 3
    kind[0] = 1
    natural = np.flatnonzero(kind)
    gaps = np.flatnonzero(np.diff(natural) > limit - overlap - 1)
    if not len(gaps):
        return natural, kind[natural]
    allowed = kind > 0
    for g in gaps:
        a, b = int(natural[g]), int(natural[g + 1])
        inner = np.arange(a + 1, b)
        part = text[a + 1 : b]
        if not part.isascii():  # not between a letter and its marks, where the stretch offers another place
            free = np.fromiter((not (unicodedata.combining(c) or c in "\u200d\ufe0f") for c in part), bool, len(part))
            free[1:] &= np.fromiter((c != "\u200d" for c in part[:-1]), bool, max(0, len(part) - 1))
            stuck = np.diff(np.flatnonzero(np.concatenate(([True], free, [True])))).max(initial=0) > limit // 4
            inner = inner if stuck else inner[free]
        allowed[inner] = True
    at = np.flatnonzero(allowed)
    return at, kind[at]


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """Greedy pieces (start, end, kind of end) of one text: the end is the last sentence end in the second half of the
    window, else the last word end, else the limit. Each piece but the first starts at the first word start within the
    overlap before the last end, or exactly the overlap before it where there is none."""
    n = len(text)
    if n <= limit:
        return [(0, n, "end")]
    at, kind = _nodes(text, limit, overlap)
    count = len(at)
    natural = np.flatnonzero(kind > 0)
    # start of the piece that follows an end at each node
    lo = np.maximum(at - overlap, 0)
    first = natural[np.minimum(np.searchsorted(at[natural], lo, "left"), len(natural) - 1)]
    start = np.where(at[first] < at, at[first], lo)
    start[0] = 0
    # farthest legal successor of each node, by level of boundary
    reach = start + limit
    succ = np.full(count, -1)
    for level, least in ((2, limit // 2), (1, 0), (0, 0)):
        own = np.flatnonzero(kind >= level)
        far = own[np.maximum(np.searchsorted(at[own], reach, "right") - 1, 0)]
        legal = (at[far] > at) & (at[far] <= reach) & (at[far] - start >= least) & (succ < 0)
        succ[legal] = far[legal]
    last = np.flatnonzero((start + limit >= n))
    succ[last] = count - 1
    succ[count - 1] = count - 1
    assert (succ >= 0).all()
    reached = np.zeros(1, dtype=np.int64)
    jump = succ
    while True:  # pointer doubling
        wider = np.union1d(reached, jump[reached])
        if len(wider) == len(reached):
            break
        reached, jump = wider, jump[jump]
    ends = reached[reached > 0]
    starts = start[np.concatenate(([0], ends[:-1]))]
    return [(int(s), int(at[e]), _KINDS[kind[e]]) for s, e in zip(starts, ends)]


def _cuts_udf(limit: int, overlap: int) -> object:
    @F.pandas_udf(_CUTS)
    def cuts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: cut_points(t, limit, overlap) if t is not None else None)

    return cuts


def split_texts(df: DataFrame, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """df's columns with piece_no, piece_start, piece_end, boundary and piece, one row per piece. Columns of df with
    these names are replaced. Texts within the limit never leave the JVM; no shuffle."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half of the limit")
    made = ("piece_no", "piece_start", "piece_end", "boundary", "piece")
    df = df.drop(*made)
    long = F.length(text) > limit
    keep = [F.col(c) for c in df.columns]

    def pieces(part: DataFrame, cuts: Column) -> DataFrame:
        e = part.select(*keep, F.posexplode(cuts).alias("piece_no", "_cut"))
        own = F.substring(F.col(text), F.col("_cut.start") + 1, F.col("_cut.end") - F.col("_cut.start"))
        return e.select(*keep, "piece_no", F.col("_cut.start").alias("piece_start"), F.col("_cut.end").alias("piece_end"), F.col("_cut.boundary").alias("boundary"), own.alias("piece"))

    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), F.lit("end").alias("boundary")))
    short = df.where(F.coalesce(~long, F.lit(True)))
    return pieces(df.where(long), _cuts_udf(limit, overlap)(F.col(text))).unionByName(pieces(short, whole))
