"""Fill-in-middle: documents cut at two unit ranks, found in an indexable skip list."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.words import mixed, small_batches, text_slices

# Marks of the parts; texts that contain one stay plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Of 100 documents, so many are cut, and so many of those have the suffix first.
CUT_SHARE, SUFFIX_FIRST = 90, 20
# A node rises to the next lane with one chance in 2 to the power of this.
LANE_BITS = 4

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of UTF-8 texts: the bytes where units begin (runs of A-Z and a-z, other code points alone), and how many code points begin before each byte."""
    point = (data & 0xC0) != 0x80
    letter = _LETTER[data]
    inner = np.zeros(len(data), bool)
    inner[1:] = letter[1:] & letter[:-1]
    inner[offsets[:-1][offsets[:-1] < len(data)]] = False
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(point, out=points[1:])
    return np.flatnonzero(point & ~inner), points


def lane_heights(units: int) -> np.ndarray:
    """How many express lanes the node of each rank rises to: a coin for each lane, from the rank alone, so that reruns agree."""
    coins = mixed(np.arange(1, units + 1, dtype=np.uint64))
    low = coins & (~coins + np.uint64(1))  # the lowest set bit
    return (np.log2(np.maximum(low, 1).astype(np.float64)) // LANE_BITS).astype(np.int8)


class SkipList:
    """Units of one text with their widths in code points, and express lanes above them.

    A link of a lane leads to the next node of that lane and carries how many units and how many code points it passes. Going
    right while the passed units stay within a rank, then down, ends at that rank; the code points passed are its place.
    """

    def __init__(self, widths: np.ndarray, heights: np.ndarray):
        self.units, self.points = len(widths), int(widths.sum())
        ends = np.concatenate([[0], np.cumsum(widths)])
        nodes, heights = np.arange(self.units + 1), np.concatenate([[127], heights[: self.units - 1], [0]]) if self.units else np.zeros(1, np.int8)
        self.lanes = []  # from the bottom: units passed, code points passed, place of each node in the lane below
        lane = 0
        while True:
            kept = nodes[:-1][heights[nodes[:-1]] >= lane] if lane else nodes[:-1]
            stops = np.append(kept, self.units)
            below = np.searchsorted(self.ranks, kept) if lane else kept
            self.lanes.append((np.diff(stops), np.diff(ends[stops]), below))
            self.ranks = kept
            if len(kept) <= 1 << LANE_BITS:
                break
            lane += 1
        del self.ranks

    def place(self, rank: int) -> int:
        """Code points before the unit of that rank; the rank of the end is the number of units."""
        if rank >= self.units:
            return self.points
        node = passed = points = 0
        for lane, (units, widths, below) in enumerate(reversed(self.lanes), 1):
            while node < len(units) and passed + units[node] <= rank:
                passed += int(units[node])
                points += int(widths[node])
                node += 1
            if lane < len(self.lanes):
                node = int(below[node])
        return points


def fill_in_middle(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: each whole text of `docs`, cut at two ranks of its n units.

    Units are runs of A-Z and a-z, and all other code points alone. Four numbers of 32 bits from the SHA-256 of seed and
    doc_id decide: prefix and middle end after the smaller and the larger of h1 % (n + 1) and h2 % (n + 1) units. Form
    'psm' is PREFIX prefix SUFFIX suffix MIDDLE middle, 'spm' is SUFFIX suffix PREFIX prefix MIDDLE middle, 'plain' the text.
    Plain are empty texts, texts with a mark in them, and the share of documents that is not to be cut; their chars are null.

    Null text counts as empty. A null doc_id counts as the empty string, so its rows share their numbers, as rows repeating an id do.
    Each row is worked by itself, without a shuffle. Empty table: no rows; other columns are not read. A text of any length is
    held once, with arrays of some ten times its size.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (F.col("h3") % 100 >= CUT_SHARE)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *numbers)
    rows = rows.select("doc_id", text.alias("text"), F.when(whole, "plain").when(F.col("h4") % 100 < SUFFIX_FIRST, "spm").otherwise("psm").alias("form"), "h1", "h2")
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heights = lane_heights(1 << 12)
        for batch in batches:
            ids, texts, forms, first, second = (batch.column(i) for i in range(5))
            out = []
            for row, data, offsets in text_slices(texts):
                starts, points = unit_starts(data, offsets)
                begin = np.searchsorted(starts, offsets)
                for i in range(len(offsets) - 1):
                    at, form, text = row + i, forms[row + i].as_py(), texts[row + i].as_py()
                    n = int(begin[i + 1] - begin[i])
                    if form == "plain":
                        out.append((n, form, None, None, text))
                        continue
                    while len(heights) < n:
                        heights = lane_heights(2 * len(heights))
                    units = SkipList(np.diff(points[np.append(starts[begin[i] : begin[i + 1]], offsets[i + 1])]), heights)
                    a, b = sorted(units.place(h[at].as_py() % (n + 1)) for h in (first, second))
                    pieces = (PREFIX, text[:a], SUFFIX, text[b:]) if form == "psm" else (SUFFIX, text[b:], PREFIX, text[:a])
                    out.append((n, form, a, b - a, "".join((*pieces, MIDDLE, text[a:b]))))
            if out:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names)

    return rows.mapInArrow(cut, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No text that is cut has a mark in it, so the marks of the output are those that were set."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    at = lambda *order: F.concat(*[F.get(parts, F.lit(i)) for i in order])
    return F.when(form == "psm", at(1, 3, 2)).when(form == "spm", at(2, 3, 1)).otherwise(output)
