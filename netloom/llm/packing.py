"""Packing tokens into sequences by order-preserving dynamic programming."""

import re
import sys
import types
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.words import small_batches

LENGTH = 2048
END_ID = 1
# Costs of a cut, in tokens of padding.
SENTENCE_CUT, INNER_CUT = 8, 64
# Sentences longer than this get places to cut inside.
INNER_STEP = 256
# Tokens that are planned at a time; the last windows of a plan are planned again with what follows.
HORIZON = 1 << 20
PLAN_AGAIN = 8
# The split pattern of the vocabulary; a fixed value.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

PIECES = "doc_id {}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


class Encoder:
    """Ids of a byte-level BPE vocabulary file, as little-endian 32-bit numbers.

    The file's vocabulary, split pattern and merges (ids in the order of merges) are handed to the faster of the installed
    BPE engines; tests hold the ids against those of the file's own library. `ids` takes the file's added tokens out of the
    text first, as that library does; `encode` is for text between them.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        # the printable stand-ins of bytes in such files
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        added = spec.get("added_tokens", [])
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
            raise ValueError("added tokens that depend on their neighbours are not supported")
        self.added = {x["content"]: array("I", [x["id"]]).tobytes() for x in added}
        # of those that begin at one place the longest is taken
        self.split = re.compile("|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))) if added else None
        ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in self.added}
        self.bpe = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max([*ranks.values(), *(x["id"] for x in added)]) + 1, bool)
        for word, i in ranks.items():
            self.ends[i] = word.rstrip(b" ").endswith((b".", b"!", b"?")) or b"\n" in word

    def encode(self, text: str) -> bytes:
        return array("I", self.bpe.encode_ordinary(text)).tobytes()

    def ids(self, text: str) -> bytes:
        """Ids of a whole text, each added token in it as its one id."""
        out, at = [], 0
        for m in self.split.finditer(text) if self.split else ():
            out += [self.encode(text[at : m.start()]), self.added[m.group()]]
            at = m.end()
        return b"".join([*out, self.encode(text[at:])])


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, kept between tasks."""
    kept = sys.modules.setdefault("netloom_llm_worker", types.ModuleType("netloom_llm_worker")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def windows(places: list[int], costs: list[int], start: int, length: int = LENGTH) -> list[int]:
    """The places that end each window, for the least sum of padding and costs of cuts.

    places: increasing, the last is where all ends; gaps of at most `length`. A window [i, j) costs length - (j - i), or
    nothing if j - i is a power of two, and the cost of its end. Base transitions take the least best[i] - (length - i) over the
    places within `length` before j, held in a monotone queue; windows of a large power of two are looked up.
    """
    best, back = {start: 0}, {}
    queue = deque([(start, start)])  # (best + place, place), both increasing
    powers = [1 << k for k in range(length.bit_length() - 2, 6, -1)]
    for j, cost in zip(places, costs, strict=True):
        while queue[0][1] < j - length:
            queue.popleft()
        least, i = queue[0]
        least += length - j
        for p in powers:
            found = best.get(j - p)
            if found is not None and found < least:
                least, i = found, j - p
        best[j], back[j] = least + cost, i
        key = least + cost + j
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [], places[-1]
    while j != start:
        out.append(j)
        j = back[j]
    return out[::-1]


def tail(length: int, most: int = LENGTH) -> list[int]:
    """How the last window is split: into powers of two if cutting costs less than padding."""
    powers = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]
    return powers if INNER_CUT * (len(powers) - 1) < most - length else [length]


class Packer:
    """Plans the windows of one partition's documents, in their order, and yields pieces."""

    def __init__(self, ends: np.ndarray, first_sequence: int, length: int = LENGTH):
        self.ends, self.sequence, self.length = ends, first_sequence, length
        self.docs: deque = deque()  # (doc_id, where its tokens begin, ids as bytes)
        self.places: list[int] = []
        self.costs: list[int] = []
        self.start = self.end = 0

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        values = np.frombuffer(ids, "<u4")
        cuts = np.flatnonzero(self.ends[np.minimum(values[:-1], len(self.ends) - 1)]) + 1
        places, costs = np.append(cuts, len(values)), np.full(len(cuts) + 1, SENTENCE_CUT)
        costs[-1] = 0
        gaps = np.diff(places, prepend=0)
        if gaps.max() > INNER_STEP:
            inner = [np.arange(places[k] - gaps[k] + INNER_STEP, places[k], INNER_STEP) for k in np.flatnonzero(gaps > INNER_STEP)]
            inner = np.concatenate(inner)
            order = np.argsort(np.concatenate([places, inner]), kind="stable")
            places, costs = np.concatenate([places, inner])[order], np.concatenate([costs, np.full(len(inner), INNER_CUT)])[order]
        self.docs.append((doc_id, self.end, ids))
        self.places += (places + self.end).tolist()
        self.costs += costs.tolist()
        self.end += len(values)
        while self.end - self.start > HORIZON:
            yield from self._plan(self.start + HORIZON)

    def _plan(self, until: int | None) -> Iterator[tuple]:
        if not self.places:
            return
        n = len(self.places) if until is None else int(np.searchsorted(self.places, until, "right"))
        cuts = windows(self.places[:n], self.costs[:n], self.start, self.length)
        if until is None:
            begin = cuts[-2] if len(cuts) > 1 else self.start
            cuts = cuts[:-1] + (begin + np.cumsum(tail(cuts[-1] - begin, self.length))).tolist()
        else:
            cuts = cuts[:-PLAN_AGAIN] or cuts[:1]
        for cut in cuts:
            yield from self._pieces(cut)
        done = int(np.searchsorted(self.places, self.start, "right"))
        self.places, self.costs = self.places[done:], self.costs[done:]

    def _pieces(self, cut: int) -> Iterator[tuple]:
        at = self.start
        while at < cut:
            doc_id, begin, ids = self.docs[0]
            tokens = len(ids) // 4
            stop = min(cut, begin + tokens)
            yield doc_id, at - begin, stop - at, ids[(at - begin) * 4 : (stop - begin) * 4], tokens, self.sequence, at - self.start
            if stop == begin + tokens:
                self.docs.popleft()
            at = stop
        self.start = cut
        self.sequence += 1

    def close(self) -> Iterator[tuple]:
        yield from self._plan(None)


def pack(docs: DataFrame, path: str, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset: one row for each piece of a document in a sequence.

    Each row of `docs` is tokenised whole, gets end_id, and is cut at its end, at ends of sentences or, in sentences of more
    than INNER_STEP tokens, at places inside. Each input partition is packed on its own in its order and without a shuffle:
    its number leads the sequence ids, a retried task gives the same rows, and memory holds HORIZON tokens and one document.

    ids are little-endian unsigned 32-bit numbers. The string of an added token of the file is its one id, as the file's own
    library has it. Null text counts as empty and gives the one id end_id. Null and repeated doc_ids are packed like any other, row by row. Empty table: no
    rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        packer = Packer(code.ends, TaskContext.get().partitionId() << 40, length)
        last = np.asarray([end_id], "<u4").tobytes()
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

        def batch_of(rows: list, ids_type: pa.DataType) -> pa.RecordBatch:
            kinds = [ids_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        rows, seen = [], pa.int64()
        for batch in batches:
            seen = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += packer.add(doc_id, code.ids(text or "") + last)
            if len(rows) >= 1000:
                yield batch_of(rows, seen)
                rows = []
        rows += packer.close()
        if rows:
            yield batch_of(rows, seen)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(packed, PIECES.format(kind))
