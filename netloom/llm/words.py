"""Words of whole texts as numpy arrays: bounds, 64-bit hashes and shingles, for a slice of an Arrow batch at a time."""

import numpy as np
import pyarrow as pa

# Bytes of text per slice. The arrays below take some fifty bytes for each; a longer text is a slice of its own.
SLICE_BYTES = 1 << 21
# Rows per Arrow batch, so that a batch of long texts fits in a worker.
BATCH_ROWS = 512

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLEND = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def small_batches(spark) -> None:
    """For this session: batches of few rows, as rows are whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_slices(column: pa.Array):
    """(first row, bytes as uint8, offsets from 0) for consecutive rows; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + SLICE_BYTES, "right")) - 1)
        last = min(last, len(column))
        yield first, raw[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the words, and the number of words before each text."""
    white = _WHITE[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = white[:-1], white[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(~white & before)
    ends = np.flatnonzero(~white & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes, from differences of one running sum."""
    if len(data) == 0:
        return np.zeros(len(starts), np.uint64)
    power = np.full(len(data), _ODD)
    power[0] = 1
    np.cumprod(power, out=power)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power, out=sums[1:])
    back = np.full(len(data) + 1, _INVERSE)
    back[0] = 1
    np.cumprod(back, out=back)
    return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[data]


def shingle_sets(column: pa.Array, width: int):
    """(row, sorted distinct hashes of the shingles) for each text of a batch, in order.

    A text of fewer words is one shingle, the whole sequence; a text without words has none.
    """
    for first, data, offsets in text_slices(column):
        data = lowered(data)
        starts, ends, place = word_bounds(data, offsets)
        words = span_hashes(data, starts, ends)
        whole = words[: max(0, len(words) - width + 1)] * _BLEND[0]
        for i in range(1, width):
            whole = whole + words[i : i + len(whole)] * _BLEND[i]
        whole = mixed(whole)
        for row in range(len(offsets) - 1):
            a, b = place[row], place[row + 1]
            if b - a >= width:
                found = np.unique(whole[a : b - width + 1])
            elif b > a:
                found = mixed(np.array([(words[a:b] * _BLEND[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
            else:
                found = words[:0]
            yield first + row, found
