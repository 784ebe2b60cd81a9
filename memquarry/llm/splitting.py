"""Items over a size limit, cut into pieces at natural boundaries.

The least number of pieces is computed, targets of equal length are placed, and
each target is moved to the strongest boundary near it: a paragraph, then a line,
then the end of a sentence, then a word, then any character that does not part a
character from its combining marks. If a limit cannot be kept, one piece is added.
Each piece after the first begins exactly ``overlap`` characters before the end of
the piece before it, so the text is the first piece and what follows the overlap
in the others.

Sizes are code points of the text after trimming spaces, tabs, line feeds,
carriage returns and form feeds at both ends. Only items over the limit leave the
JVM.

Defined results: a null text or one with nothing left after trimming has no piece;
an item within the limit is one piece; repeated rows give repeated pieces.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f"
#: From strong to weak: each match's end is a place to cut.
BOUNDARIES = (
    re.compile(r"(?:\r\n|[\n\r\x0b\x85 ])[ \t\xa0]*(?:\r\n|[\n\r\x0b\x85 ])\s*|\s*[\x0c ]\s*"),
    re.compile(r"(?:\r\n|[\n\r\x0b\x85 ])\s*"),
    re.compile(r"[.!?…。！？]+[\"'”’»)\]]*\s+|[。！？]"),
    re.compile(r"\s+|(?<=[぀-ヿ一-鿿])(?=[぀-ヿ一-鿿])"),
)


def _whole(text: str, at: int) -> bool:
    return at >= len(text) or not (unicodedata.combining(text[at]) or text[at] in "‍️" or text[at - 1] == "‍")


def _before(text: str, at: int) -> int:
    """Where the white space and the marks end that lie before ``at``: what stands there
    decides how strong a boundary is, however long the white space is."""
    block = 64
    while at > 0 and text[max(0, at - block) : at].isspace():
        at = max(0, at - block)
        block *= 2
    while at > 0 and not text[at - 1].isalnum():
        at -= 1
    return at


def _cut(text: str, target: int, low: int, high: int) -> int:
    """The strongest boundary in low..high, the nearest of equals, the first of ties."""
    base = _before(text, low)
    seen = text[base : high + 1]
    for kind in BOUNDARIES:
        best = None
        for m in kind.finditer(seen):
            at = base + m.end()
            if at > high:
                break
            if at >= low and (best is None or abs(at - target) < abs(best - target)):
                best = at
        if best is not None:
            return best
    for d in range(max(target - low, high - target) + 1):
        for at in (target - d, target + d):
            if low <= at <= high and _whole(text, at):
                return at
    return target


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """First and past position of each piece; none is longer than ``limit``."""
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    reach = limit - overlap
    pieces = -(-(n - overlap) // reach)
    while True:
        step = (n - overlap) / pieces
        slack = max(1, int(step / 3))
        out, first = [], 0
        for i in range(pieces - 1):
            target = overlap + round((i + 1) * step)
            high = min(first + limit, target + slack, n - 1)
            low = max(first + overlap + 1, target - slack, n - (pieces - 1 - i) * reach)
            if low > high:
                break
            past = _cut(text, min(max(target, low), high), low, high)
            out.append((first, past))
            first = past - overlap
        else:
            if n - first <= limit:
                return [*out, (first, n)]
        pieces += 1


def pieces(items: DataFrame, kind: str, id_col: str, text_col: str, limit: int, overlap: int) -> DataFrame:
    """(rec_kind, rec_id, piece_no from 0, n_pieces, first, text) of the items; ``first`` is
    the piece's place in the trimmed text."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    body = F.btrim(F.col(text_col), F.lit(BLANKS))
    items = items.select(F.lit(kind).alias("rec_kind"), F.col(id_col).cast("bigint").alias("rec_id"), body.alias("text")).where(F.length("text") > 0)
    schema = "rec_kind string, rec_id bigint, piece_no int, n_pieces int, first bigint, text string"
    whole = items.where(F.length("text") <= limit).select("rec_kind", "rec_id", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).cast("bigint").alias("first"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                spans = cuts(t, limit, overlap)
                rows += [(i, k, len(spans), x, t[x:y]) for k, (x, y) in enumerate(spans)]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(rows), pa.string()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string())],
                names=["rec_kind", "rec_id", "piece_no", "n_pieces", "first", "text"],
            )

    return items.where(F.length("text") > limit).mapInArrow(work, schema).unionAll(whole)
