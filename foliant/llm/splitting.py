"""Problem 6: cut oversized items at natural boundaries, with overlap.

Recursive bisection: a span longer than ``limit - overlap`` is cut at the
strongest boundary in its middle half (the nearest to the midpoint among equals) and
both halves are treated alike; then every piece but the first is extended to
the left by at most ``overlap`` characters of the piece before it, from the
start of a word.  Lengths are code points.

Defined results: null, empty and fitting contents give one piece (null and
empty: the content itself); a text without any boundary is cut at its
midpoint, but never inside a combining sequence or between CR and LF unless
the sequence alone exceeds the limit; repeated rows give repeated pieces;
extra columns pass unseen; an empty table gives none.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.batches import map_columns

#: Boundary patterns from the strongest; a cut is placed after the match.
BOUNDARIES = [
    re.compile(r"(?:\r?\n[^\S\n]*){2,}"),
    re.compile(r"\n(?=#{1,6} |[-*•‣–] |\d{1,3}[.)] |[|]|```)"),
    re.compile(r"[.!?…:;][\"'»”)\]]*[^\S\n]*\n"),
    re.compile(r"[.!?…][\"'»”)\]]*[^\S\n]+|[。！？]"),
    re.compile(r"\n"),
    re.compile(r"[;:,–—][^\S\n]+"),
    re.compile(r"\s+"),
]
_JOINERS = "‍︎️"


def _glued(text: str, at: int) -> bool:
    """Would a cut at ``at`` part what is read as one character?"""
    c = text[at]
    return unicodedata.category(c)[0] == "M" or c in _JOINERS or text[at - 1] == "‍" or (c == "\n" and text[at - 1] == "\r")


def _hard(text: str, a: int, b: int) -> int:
    mid = (a + b) // 2
    for d in range(max(mid - a, b - mid)):
        for at in (mid - d, mid + d):
            if a < at < b and not _glued(text, at):
                return at
    return mid


def spans(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """``(begin, core, end)`` of each piece: ``begin..core`` repeats the piece before."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    n, room = len(text), limit - overlap
    if n <= limit:
        return [(0, 0, n)]
    ranked = [sorted({m.end() for m in p.finditer(text)}) for p in BOUNDARIES]
    cores, todo = [], [(0, n)]
    while todo:
        a, b = todo.pop()
        if b - a <= room:
            cores.append((a, b))
            continue
        mid, quarter = (a + b) // 2, (b - a) // 4
        cut = None
        for ends in ranked:
            lo, hi = bisect_left(ends, max(a + 1, a + quarter)), bisect_right(ends, min(b - 1, b - quarter))
            if lo < hi:
                k = bisect_left(ends, mid, lo, hi)
                cut = min((ends[j] for j in (k - 1, k) if lo <= j < hi), key=lambda x: abs(x - mid))
                break
        if cut is None:
            cut = _hard(text, a, b)
        todo += [(cut, b), (a, cut)]
    words, out = ranked[-1], []
    for i, (a, b) in enumerate(cores):
        begin = a
        if i and overlap:
            least = max(cores[i - 1][0], a - overlap)
            k = bisect_left(words, least)
            begin = words[k] if k < len(words) and words[k] < a else least
            while begin < a and _glued(text, begin):
                begin += 1
        out.append((begin, a, b))
    return out


def split(df: DataFrame, keys: list[str], content: str = "content", limit: int = 1500, overlap: int = 200) -> DataFrame:
    """Pieces of every item: keys, ``piece_no``, ``n_pieces``, ``begin``,
    ``core``, ``end`` and ``piece``.  Items that fit stay in the JVM."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", piece_no int, n_pieces int, begin int, core int, end int, piece string"
    needed = df.select(*keys, content)
    large = F.length(content) > limit
    fits = needed.where(~F.coalesce(large, F.lit(False))).select(
        *keys, F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("begin"), F.lit(0).alias("core"),
        F.coalesce(F.length(content), F.lit(0)).alias("end"), F.col(content).alias("piece"),
    )

    def start():
        def step(*cols):
            out: list[list] = [[] for _ in range(len(keys) + 6)]
            for row in zip(*cols):
                text = row[-1]
                found = spans(text, limit, overlap)
                for i, (begin, core, end) in enumerate(found):
                    for c, v in zip(out, (*row[:-1], i, len(found), begin, core, end, text[begin:end])):
                        c.append(v)
            return out

        return step

    return map_columns(needed.where(large), schema, start, rows=256).unionByName(fits)


def oversized(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Items that the operator had to cut, once each."""
    return pieces.where("n_pieces > 1").select(*keys).distinct()
