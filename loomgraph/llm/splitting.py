"""Splitting oversized items at natural boundaries (problem 4) by content-defined chunking."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.storage import bounded

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")
_WINDOW = 16
_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 4096, np.uint32)


def landmarks(text: str, every: int) -> np.ndarray:
    """Positions after which the rolling hash of the last characters is a landmark, about one in ``every``."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    gear = _GEAR[points % 4096]
    h = np.zeros(len(points), np.uint32)
    for k in range(min(_WINDOW, len(points))):
        h[k:] += gear[: len(points) - k] << np.uint32(k)
    return np.flatnonzero((h >> np.uint32(8)) % np.uint32(max(every, 1)) == 0) + 1


def split_text(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (cut, start, end, first line, last line) and whether a line had to be cut.

    Positions are in characters, lines count from 0. A piece is ``text[start:end]`` and at most ``limit`` characters;
    ``text[cut:end]`` is new and the part before it repeats the last ``overlap`` lines of the piece before, fewer only where
    that piece has fewer or the limit leaves no room for them and the next line. Cuts are at line ends, except
    in lines that alone are longer than ``limit``; of those a line's ending, if it does not fit, begins the next piece.
    Where a segment may end, the first landmark past half of the room decides, moved to the nearest line end (in a long
    line, to the nearest blank); without one the last line end that fits. So cuts depend on the text
    nearby, and an edit moves only the cuts around it.
    """
    lines = [m.span() for m in _LINE.finditer(text)]
    bodies = [len(text[a:b].rstrip("\r\n")) for a, b in lines]
    hard = int(any(n > limit for n in bodies))
    marks = landmarks(text, max(1, limit // 4)).tolist()
    ends: list[int] = []
    for (a, b), body in zip(lines, bodies):
        if b - a > limit:
            at = a
            while body - (at - a) > limit:
                i = bisect_right(marks, at + limit // 2)
                want = marks[i] if i < len(marks) and marks[i] <= at + limit else at + limit
                left = text.rfind(" ", at + limit // 2, want) + 1
                right = text.find(" ", want - 1, at + limit) + 1
                near = [p for p in (left, right) if at < p <= at + limit]
                at = min(near, key=lambda p: (abs(p - want), p)) if near else want
                ends.append(at)
            if b - at > limit and a + body > at:
                at = a + body
                ends.append(at)
            while b - at > limit:
                at += limit
                ends.append(at)
        ends.append(b)
    starts = [a for a, _ in lines]
    line_ends = {b for _, b in lines}
    out: list[tuple[int, int, int, int, int]] = []
    cut, i = 0, 0
    while cut < len(text):
        start = cut
        need = ends[i] - cut
        if out and overlap > 0 and cut in line_ends:
            line = bisect_right(starts, cut - 1) - 1
            floor = out[-1][1]
            for k in range(overlap):
                at = starts[line - k] if line - k >= 0 else -1
                if at < 0 or at < floor or cut - at + need > limit:
                    break
                start = at
        room = limit - (cut - start)
        last = i
        while last + 1 < len(ends) and ends[last + 1] - cut <= room:
            last += 1
        pick = last
        if last + 1 < len(ends):
            for m in marks[bisect_right(marks, cut + room // 2) :]:
                if m > cut + room:
                    break
                j = bisect_right(ends, m)
                near = min((x for x in (j - 1, j) if i <= x <= last), key=lambda x: (abs(ends[x] - m), x), default=None)
                if near is not None and ends[near] - cut >= room // 2:
                    pick = near
                    break
        end = ends[pick]
        out.append((cut, start, end, bisect_right(starts, start) - 1, bisect_right(starts, end - 1) - 1))
        cut, i = end, pick + 1
    return out, hard


def split_oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """(chunk_id, piece, hard, cut, content, start_line, end_line) of the chunks whose content is over their limit.

    ``chunks``: chunk_id, chunk_type, content, start_line; ``limits``: chunk_type, max_chars, overlap_lines, a small
    table that holds each chunk_type once. content of a piece is at most max_chars characters; the pieces' contents from
    ``cut`` on give the content again. Lines are counted from the chunk's start_line (from 1 where that is null), never from its
    end_line. Null and empty contents, and types without a limit or with a limit below 1, have no pieces. Each row is
    split by itself: no shuffle but for the limits' broadcast.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                first = 1 if pd.isna(r.start_line) else int(r.start_line)
                pieces, hard = split_text(r.content, int(r.max_chars), 0 if pd.isna(r.overlap_lines) else int(r.overlap_lines))
                for n, (cut, start, end, a, b) in enumerate(pieces):
                    rows.append((r.chunk_id, n, hard, cut - start, r.content[start:end], first + a, first + b))
            yield pd.DataFrame(rows, columns=["chunk_id", "piece", "hard", "cut", "content", "start_line", "end_line"])

    known = bounded(limits).where("max_chars >= 1").select("chunk_type", "max_chars", "overlap_lines")
    rows = chunks.select("chunk_id", "chunk_type", "content", "start_line").join(F.broadcast(known), "chunk_type").where(F.length("content") > F.col("max_chars"))
    return rows.select("chunk_id", "content", "start_line", "max_chars", "overlap_lines").mapInPandas(run, "chunk_id bigint, piece int, hard int, cut int, content string, start_line int, end_line int")
