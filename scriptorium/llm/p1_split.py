"""Problem 1: cut oversized pages at natural boundaries, with an overlap.

Every position of a text has a farthest legal successor: the last natural boundary
that keeps the next piece, overlap included, within the limit. Squaring that successor
table doubles the reach of each step, so all greedy cuts of a text come out after
log2(pieces) array operations instead of a walk from cut to cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2000
OVERLAP = 200
PIECES = "page_id long, entry_id long, page int, piece int, start int, end int, text string"

_SPACE = np.array([ord(c) for c in " \t\n\r\x0b\x0c\x85\xa0  　   "] + list(range(0x2000, 0x200B)), np.uint32)
_BREAK = np.array([ord(c) for c in "\n\r\x0c\x85  "], np.uint32)
_STOP = np.array([ord(c) for c in ".!?…;。！？"], np.uint32)
_CLOSE = np.array([ord(c) for c in "»”\"')]’“"], np.uint32)
#: Code points that belong to the character before them.
_JOINED = np.array([*range(0x300, 0x370), *range(0x483, 0x48A), 0x200D, *range(0xFE00, 0xFE10), *range(0x1F3FB, 0x1F400)], np.uint32)


def _last(flags: np.ndarray) -> np.ndarray:
    """For each position the last one at or before it whose flag is set (0: none)."""
    return np.maximum.accumulate(np.where(flags, np.arange(len(flags)), 0))


def successors(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> np.ndarray:
    """The farthest legal next cut for a cut at each position of ``text``.

    Sentence and line ends go before spaces, spaces before any other place; where a
    stretch has no boundary the cut is at the limit, but never before a combining mark.
    """
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(c)
    before = np.zeros(n + 1, np.uint32)
    before[1:] = c
    after = np.zeros(n + 1, np.uint32)
    after[:n] = c
    gap = np.isin(before, _SPACE) & ~np.isin(after, _SPACE)
    word = gap.copy()
    word[n] = True
    # the last character that is no space, before each position
    solid = _last(np.append(False, ~np.isin(c, _SPACE)))
    closed = np.isin(before[solid], _STOP) | (np.isin(before[solid], _CLOSE) & np.isin(before[np.maximum(solid - 1, 0)], _STOP))
    broken = _last(np.isin(before, _BREAK)) > solid
    strong = gap & (closed | broken)
    strong[n] = True
    free = ~np.isin(after, _JOINED)
    at = np.arange(n + 1)
    reach = np.minimum(np.maximum(at - overlap, 0) + limit, n)
    best = _last(strong)[reach]
    best = np.where(best > at, best, _last(word)[reach])
    best = np.where(best > at, best, _last(free)[reach])
    return np.where(best > at, best, reach)


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> np.ndarray:
    """All greedy cuts of ``text``, its end included, by squaring the successor table."""
    if limit <= overlap:
        raise ValueError("the overlap must be smaller than the limit")
    jump = successors(text, limit, overlap)
    seen = np.array([0])
    while True:
        more = np.union1d(seen, jump[seen])
        if len(more) == len(seen):
            return more[1:]
        seen, jump = more, jump[jump]


def split_pages(pages: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces (page_id, entry_id, page, piece, start, end, text) of the pages longer than ``limit``.

    A piece has at most ``limit`` characters (code points), ends at a sentence or line
    end where its reach holds one, else after a space, else at the limit, and repeats
    the last ``overlap`` characters of the piece before it (all of them if it is
    shorter). ``piece`` counts from 1; start and end are offsets in the page's text.
    Leaving out the repeated characters gives the page's text back. Pages of at most
    ``limit`` characters, null and empty texts have no rows; a redelivered page counts
    once; further columns of ``pages`` are ignored.
    """
    own = pages.select("page_id", "entry_id", F.col("page").cast("int").alias("page"), "text")
    long = own.filter(F.length("text") > limit).dropDuplicates(["page_id"])

    def run(batches):
        for batch in batches:
            rows = [[] for _ in range(7)]
            for page_id, entry_id, page, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                begin = 0
                for k, end in enumerate(cuts(text, limit, overlap).tolist(), 1):
                    for column, value in zip(rows, (page_id, entry_id, page, k, begin, end, text[begin:end])):
                        column.append(value)
                    begin = max(0, end - overlap)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["page_id", "entry_id", "page", "piece", "start", "end", "text"])

    return long.mapInArrow(run, PIECES)


def oversized(pages: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """page_id of each page that had to be split, once."""
    return split_pages(pages, limit, overlap).filter("piece = 1").select("page_id")


def rejoined(pieces: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """(page_id, entry_id, page, pieces, text): each page put together from its pieces again. A
    page of any length has been one row before, so its pieces fit in one row again."""
    own = F.when(F.col("piece") == 1, F.col("text")).otherwise(F.expr(f"substring(text, least({overlap}, `start` + {overlap}) + 1, length(text))"))
    part = F.struct("piece", own.alias("own"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["own"]), "")
    return pieces.groupBy("page_id", "entry_id", "page").agg(F.count("*").alias("pieces"), text.alias("text"))


def piece_sizes(pages: DataFrame, meta: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Per entry: pages split, pieces, and the characters of the split pages against the
    size that the latest extraction states (null where it states none or a size smaller
    than what its pages hold, which cannot be right)."""
    pieces = split_pages(pages, limit, overlap)
    own = pieces.groupBy("entry_id").agg(F.countDistinct("page_id").alias("pages_split"), F.count("*").alias("pieces"), F.sum(F.col("end") - F.col("start")).alias("chars_in_pieces"))
    stated = meta.groupBy("entry_id").agg(F.max(F.struct("extracted_at", "chars")).getField("chars").alias("chars"))
    held = pages.select("page_id", "entry_id", F.length("text").alias("n")).dropDuplicates(["page_id"]).groupBy("entry_id").agg(F.sum("n").alias("held"))
    joined = own.join(stated, "entry_id", "left").join(held, "entry_id", "left")
    return joined.select("entry_id", "pages_split", "pieces", "chars_in_pieces", F.when(F.col("chars") >= F.col("held"), F.col("chars")).alias("entry_chars"))
