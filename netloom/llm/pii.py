"""Personal data: base patterns, and a linear-chain conditional random field over word shapes."""

import hashlib
import itertools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import written
from netloom.llm.words import small_batches, text_slices, word_bounds

KINDS = ("email", "ip", "card", "phone")
TAGS = len(KINDS) + 1  # 0: none of them

# The base patterns; fixed values. Possessive runs and looks behind save repeated scans and find the same matches.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Forms in which people write the same data past the base patterns; fixed values. ~ is a value of the kind, cut at its signs.
FORMS = {
    "email": ("~ at ~ dot ~", "~ (at) ~ (dot) ~", "~[at]~[dot]~", "~ [at] ~.~", "~(at)~.~", "~ AT ~ DOT ~"),
    "ip": ("~[.]~[.]~[.]~", "~ dot ~ dot ~ dot ~", "~(dot)~(dot)~(dot)~"),
    "card": ("~\u2013~\u2013~\u2013~", "~  ~  ~  ~", "~\u00a0~\u00a0~\u00a0~"),
    "phone": ("(~) ~-~", "(~) ~ ~", "(~)~-~"),
}
# What looks like a part of them and is none; fixed values.
DECOYS = ("at", "dot", "1999 2004", "(12)", "f(x)", "2021-03-04", "(at last)", "12.50", "a[0]", "(2019) 14-15")
_AT = re.compile(r"\s*[\[({]\s*at\s*[\])}]\s*|\s+at\s+", re.IGNORECASE)
_DOT = re.compile(r"\s*[\[({]\s*(?:dot|\.)\s*[\])}]\s*|\s+dot\s+", re.IGNORECASE)
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_SPACED = re.compile(r"[0-9](?:[^0-9A-Za-z]{0,3}[0-9])+")
_CALLED = re.compile(r"\(?[0-9][\x20().0-9-]+[0-9]")

# The labelled table: lines of a sample of documents, labelled by the base patterns, and clean ones with planted forms and decoys.
SAMPLE_DOCS = 5_000
LINES = 400  # of each sort: without matches, with personal data, with matches that do not hold only
LABELLED_ROWS = 20_000  # a table given by the caller may have so many rows
LINE_WORDS = 32  # longer lines are labelled in windows of so many words
SHAPES = 1 << 13
EDGE = SHAPES  # what stands before and after a line
ROUNDS = 120


def _digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the local part before it that no earlier match has taken."""
    taken, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            taken = found.end()
        at = text.find("@", max(at + 1, taken))


def matches(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(kind, start, end, whether it holds) for every match of a base pattern, by kind as listed and start."""
    for a, b in _emails(text):
        yield 0, a, b, True
    for m in IP.finditer(text):
        yield 1, *m.span(), all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m.group())
            yield 2, *m.span(), 13 <= len(digits) <= 19 and luhn(digits)
    for m in PHONE.finditer(text):
        yield 3, *m.span(), 9 <= len(_digits(m.group())) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the matches that hold."""
    return [(kind, a, b) for kind, a, b, holds in matches(text) if holds]


def holds_as(kind: int, text: str) -> bool:
    """Whether a form of personal data stands for a value that the check of its kind accepts."""
    if kind == 0:
        return _EMAIL.fullmatch(_DOT.sub(".", _AT.sub("@", text))) is not None
    if kind == 1:
        found = IP.fullmatch(_DOT.sub(".", text))
        return found is not None and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in found.group().split("."))
    digits = _digits(text)
    if kind == 2:
        return _SPACED.fullmatch(text) is not None and 13 <= len(digits) <= 19 and luhn(digits)
    return _CALLED.fullmatch(text) is not None and 9 <= len(digits) <= 15


_DIGIT, _ALPHA, _OPEN = np.zeros(256, np.int32), np.zeros(256, np.int32), np.zeros(256, np.int32)
_OPEN[[40, 91, 123]] = 1
_TRAIL = np.isin(np.arange(256), [ord(c) for c in ".,;:!?"])
_DIGIT[48:58] = 1
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = 1


def _packed(word: bytes) -> int:
    return int.from_bytes(word.lower(), "big")


_AT_WORDS = np.array([_packed(w) for w in (b"at", b"(at)", b"[at]", b"{at}")])
_DOT_WORDS = np.array([_packed(w) for w in (b"dot", b"(dot)", b"[dot]", b"{dot}", b"[.]", b"(.)")])


def _markers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """1 for words that stand for an @, 2 for those that stand for a dot, else 0."""
    out, size = np.zeros(len(starts), np.int64), ends - starts
    few = np.flatnonzero((size >= 2) & (size <= 5))
    value = np.zeros(len(few), np.int64)
    for k in range(5):
        inside = size[few] > k
        byte = data[np.minimum(starts[few] + k, len(data) - 1)].astype(np.int64)
        byte = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
        value = np.where(inside, (value << 8) | byte, value)
    out[few] = np.where(np.isin(value, _AT_WORDS), 1, np.where(np.isin(value, _DOT_WORDS), 2, 0))
    return out


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for the shape of each word: digits, letters, @, dots, dashes, first character, length, and the ways to write an @ or a dot."""
    def within(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[ends] - total[starts]

    if len(starts):
        ends = ends - (_TRAIL[data[ends - 1]] & (ends - starts > 1))  # a mark that ends a word is no part of its shape
    size, digits = ends - starts, within(_DIGIT[data])
    share = np.where(digits == 0, 0, np.where(2 * digits < size, 1, np.where(digits < size, 2, 3)))
    first = data[starts] if len(starts) else np.zeros(0, np.uint8)
    marker = _markers(data, starts, ends) if len(starts) else np.zeros(0, np.int64)
    marker = np.where((marker == 0) & (within(_OPEN[data]) > _OPEN[first]), 3, marker)  # a bracket opens inside the word
    bits = [
        (marker, 2),
        (share, 2), (within(data == 64) > 0, 1), (np.minimum(within(data == 46), 3), 2), (first == 43, 1), (first == 40, 1),
        (within(data == 45) > 0, 1), (within(_ALPHA[data]) > 0, 1), (np.digitize(size, (4, 7, 13)), 2),
    ]
    code = np.zeros(len(starts), np.int64)
    for value, width in bits:
        code = (code << width) | value.astype(np.int64)
    return code


def lines_of(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the words of each line begin, with the number of words at the end. Lines end at line feeds and at the ends of texts."""
    begins = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    line = np.searchsorted(begins, starts, "right")
    return np.concatenate([np.flatnonzero(np.diff(line, prepend=-1)), [len(starts)]])


@dataclass
class Field:
    """Weights by tag: of a word's shape, of the shapes before and after it, and of a tag after a tag."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    moves: np.ndarray

    def emissions(self, codes: np.ndarray, lines: np.ndarray) -> np.ndarray:
        previous, following = np.concatenate([[EDGE], codes[:-1]]), np.concatenate([codes[1:], [EDGE]])
        previous[lines[:-1]] = EDGE
        following[lines[1:] - 1] = EDGE
        return self.own[codes] + self.before[previous] + self.after[following]

    def decode(self, codes: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """The best tags of all lines by Viterbi, a place of all lines at a time; lines that have ended drop out."""
        if not len(codes):
            return np.zeros(0, np.int64)
        scores = self.emissions(codes, lines)
        length = np.diff(lines)
        order = np.argsort(-length, kind="stable")
        begin, length = lines[:-1][order], length[order]
        live = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")  # lines with so many words
        delta, back = scores[begin], []
        for t in range(1, length[0]):
            n = live[t]
            total = delta[:n, :, None] + self.moves
            back.append(total.argmax(axis=1).astype(np.uint8))
            delta[:n] = total.max(axis=1) + scores[begin[:n] + t]
        tags, tag = np.zeros(len(codes), np.int64), delta.argmax(axis=1)
        for t in range(length[0] - 1, -1, -1):
            n = live[t]
            tags[begin[:n] + t] = tag[:n]
            if t:
                tag[:n] = back[t - 1][np.arange(n), tag[:n]]
        return tags


def train(table: list[tuple[list[int], list[int]]], rounds: int = ROUNDS, rate: float = 0.2, decay: float = 1e-4) -> Field:
    """Maximum likelihood with a quadratic penalty from (shapes, tags) of lines: forward and backward sums, Adam steps."""
    field = Field(*(np.zeros((SHAPES + 1, TAGS)) for _ in range(3)), np.zeros((TAGS, TAGS)))
    table = [(s[i : i + LINE_WORDS], t[i : i + LINE_WORDS]) for s, t in table for i in range(0, len(s), LINE_WORDS)]
    if not any(any(t) for _, t in table):
        field.own[:, 0] = 1e6  # nothing to learn from: no word is tagged
        return field
    n, width = len(table), max(len(s) for s, _ in table)
    length = np.array([len(s) for s, _ in table])
    code, gold = np.full((n, width), EDGE), np.zeros((n, width), np.int64)
    for i, (s, t) in enumerate(table):
        code[i, : len(s)], gold[i, : len(s)] = s, t
    before = np.concatenate([np.full((n, 1), EDGE), code[:, :-1]], axis=1)
    after = np.concatenate([code[:, 1:], np.full((n, 1), EDGE)], axis=1)
    inside = np.arange(width) < length[:, None]
    truth = np.eye(TAGS)[gold]
    pair = inside[:, 1:]
    true_moves = np.einsum("bti,btj->ij", truth[:, :-1] * pair[..., None], truth[:, 1:])
    weights = [field.own, field.before, field.after, field.moves]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, rounds + 1):
        raw = field.own[code] + field.before[before] + field.after[after]
        local = np.exp(raw - raw.max(axis=2, keepdims=True))
        moves = np.exp(field.moves - field.moves.max())
        ahead, behind, scale = np.zeros_like(local), np.ones_like(local), np.ones((n, width))
        ahead[:, 0] = local[:, 0] / (s := local[:, 0].sum(axis=1, keepdims=True))
        for t in range(1, width):
            x = (ahead[:, t - 1] @ moves) * local[:, t]
            s = x.sum(axis=1, keepdims=True)
            ahead[:, t] = np.where(inside[:, t, None], x / s, ahead[:, t - 1])
            scale[:, t] = s[:, 0]
        for t in range(width - 2, -1, -1):
            x = (behind[:, t + 1] * local[:, t + 1]) @ moves.T / scale[:, t + 1, None]
            behind[:, t] = np.where(inside[:, t + 1, None], x, 1)
        marginal = ahead * behind
        marginal /= marginal.sum(axis=2, keepdims=True)
        right = behind[:, 1:] * local[:, 1:] / scale[:, 1:, None] * pair[..., None]
        expected = np.einsum("bti,btj->ij", ahead[:, :-1], right) * moves
        miss = (truth - marginal)[inside]
        slopes = []
        for ids in (code, before, after):
            slope = np.stack([np.bincount(ids[inside], miss[:, k], SHAPES + 1) for k in range(TAGS)], axis=1)
            slopes.append(slope)
        slopes.append(true_moves - expected)
        for k, (w, slope) in enumerate(zip(weights, slopes, strict=True)):
            slope = slope / n - decay * w
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.999 * second[k] + 0.001 * slope**2
            w += rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return field


def _characters(data: np.ndarray) -> np.ndarray:
    """Code points before each byte of a slice."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def _windows(lines: np.ndarray) -> Iterator[tuple[int, int]]:
    """Every line in windows of at most LINE_WORDS words."""
    for begin, finish in itertools.pairwise(lines.tolist()):
        for low in range(begin, finish, LINE_WORDS):
            yield low, min(finish, low + LINE_WORDS)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines, long ones in windows, with tags by the base patterns, whose checks a shape cannot show; of each sort the LINES with the least digests that this task has."""
    kept: dict[int, dict] = {0: {}, 1: {}, 2: {}}
    for batch in batches:
        texts = batch.column(0).fill_null("")
        for first, data, offsets in text_slices(texts):
            starts, ends, place = word_bounds(data, offsets)
            codes, points = shapes(data, starts, ends), _characters(data)
            tags, sorts = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
            for row in range(len(offsets) - 1):
                a, b = place[row], place[row + 1]
                origin = points[offsets[row]]
                for kind, begin, stop, holds in matches(texts[first + row].as_py()):
                    low = a + np.searchsorted(points[ends[a:b]] - origin, begin, "right")
                    high = a + np.searchsorted(points[starts[a:b]] - origin, stop, "left")
                    tags[low:high] = kind + 1
                    sorts[low:high] = 2 if holds else np.maximum(sorts[low:high], 1)
            lines = lines_of(data, offsets, starts)
            for low, high in _windows(lines):
                sort = (0, 2, 1)[sorts[low:high].max()]
                row = codes[low:high].tolist(), tags[low:high].tolist()
                kept[sort][hashlib.blake2b(repr(row).encode() + data[starts[low] : ends[high - 1]].tobytes(), digest_size=8).hexdigest()] = row
            for sort, held in kept.items():
                if len(held) > 4 * LINES:
                    kept[sort] = {k: held[k] for k in sorted(held)[:LINES]}
    rows = [(sort, k, *held[k]) for sort, held in kept.items() for k in sorted(held)[:LINES]]
    if rows:
        kinds = [pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["sort", "digest", "shapes", "tags"])


def labelled_lines(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """sort, digest, shapes, tags: the small labelled table, LINES lines of each sort.

    About sample_docs documents are chosen by a digest of their text; of their lines, those with the least digests.
    """
    small_batches(docs.sparkSession)
    count = docs.count()
    share = min(1.0, sample_docs / max(count, 1))
    text = F.col("text").cast("string")
    picked = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text", F.lit("lines")), F.lit(1 << 20)) < F.lit(round(share * (1 << 20))))
    rows = written(picked.mapInArrow(_labelled, "sort int, digest string, shapes array<bigint>, tags array<bigint>"), "pii-lines")
    return reduce(DataFrame.unionByName, (rows.where(F.col("sort") == k).orderBy("digest").limit(LINES) for k in range(3)))


def planted_value(kind: str, form: str, rng: random.Random) -> str:
    """A value of the kind, written in the form."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    letters = lambda low, high: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(low, high)))
    if kind == "email":
        parts = [letters(2, 12) + rng.choice(("", "", "." + letters(2, 8), digits(2))), letters(3, 14), letters(2, 4)]
    elif kind == "ip":
        parts = [str(rng.randint(0, 255)) for _ in range(4)]
    elif kind == "card":
        head = rng.choice("3456") + digits(14)
        whole = next(head + c for c in "0123456789" if luhn(_digits(head + c)))
        parts = [whole[i : i + 4] for i in range(0, 16, 4)]
    else:
        parts = [digits(3), digits(3), digits(rng.choice((3, 4)))]
    return "".join(a + b for a, b in zip(form.split("~"), [*parts, ""], strict=True))


def _coded(text: str) -> list[int]:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
    return shapes(data, starts, ends).tolist()


def planted_lines(clean: list[list[int]], seed: int = 10) -> list[tuple[list[int], list[int]]]:
    """(shapes, tags) of the clean lines with a form or a decoy put in, by turns: for each line a form of every kind, and two decoys."""
    rng, out = random.Random(seed), []
    turns = itertools.cycle([(k, f) for i in range(max(map(len, FORMS.values()))) for k in KINDS for f in FORMS[k][i : i + 1] or FORMS[k][:1]])
    decoys = itertools.cycle(DECOYS)
    for line in clean:
        line = line[: LINE_WORDS - 8]  # room for what is put in; the whole line stands in the table as it is
        for kind, form in itertools.islice(turns, len(KINDS)):
            put, at = _coded(planted_value(kind, form, rng)), rng.randint(0, len(line))
            out.append((line[:at] + put + line[at:], [0] * at + [KINDS.index(kind) + 1] * len(put) + [0] * (len(line) - at)))
        for _ in range(2):
            put, at = _coded(next(decoys)), rng.randint(0, len(line))
            out.append((line[:at] + put + line[at:], [0] * (len(line) + len(put))))
    return out


def _scan(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))
    for batch in batches:
        texts = batch.column(1).fill_null("")
        base, added = [], []
        for first, data, offsets in text_slices(texts):
            starts, ends, _ = word_bounds(data, offsets)
            lines = lines_of(data, offsets, starts)
            tags = field.decode(shapes(data, starts, ends), lines)
            new = np.ones(len(tags), bool)
            new[1:] = tags[1:] != tags[:-1]
            new[lines[:-1]] = True
            begins = np.flatnonzero(new)
            stops = np.concatenate([begins[1:], [len(tags)]]) - 1
            some = tags[begins] > 0 if len(begins) else np.zeros(0, bool)
            begins, stops = begins[some], stops[some]
            points = _characters(data)
            owner = np.searchsorted(offsets, starts[begins], "right") - 1
            found: dict[int, list] = {}
            for row, low, high in zip(owner.tolist(), begins.tolist(), stops.tolist(), strict=True):
                found.setdefault(row, []).append((int(tags[low]) - 1, int(points[starts[low]] - points[offsets[row]]), int(points[ends[high]] - points[offsets[row]])))
            for row in range(len(offsets) - 1):
                text = texts[first + row].as_py()
                known = list(matches(text))
                base.append([{"kind": k, "start": a, "stop": b} for k, a, b, holds in known if holds])
                extra = []
                for kind, a, b in found.get(row, ()):
                    inner = text[a:b].strip(" \t,;:!?.*#%&$|\"'")
                    a = text.index(inner, a)
                    b = a + len(inner)
                    if inner and holds_as(kind, inner) and not any(x < b and a < y for _, x, y, _ in known):
                        extra.append((kind, a, b))
                added.append([{"kind": k, "start": a, "stop": b} for k, a, b in sorted(extra)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, spans_type), pa.array(added, spans_type)], ["doc_id", "base", "added"])


def personal_spans(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, base, added: arrays of (kind, start, stop), in code points, end exclusive; one row for each row of `docs`.

    base: the matches of the base patterns, by kind (numbers of KINDS) and start. added: runs of words of one tag in the
    Viterbi path of the random field, cut free of punctuation, that stand for a value which the check of their kind accepts
    (`holds_as`: an address spelled with at and dot, octets to 255, Luhn, 9 to 15 digits), where no match of a base pattern
    overlaps, be it one that holds or one that its check has refused (such as a number that fails Luhn). The field is trained on the
    driver from a labelled table of bounded size (rows of shapes and tags): the whole of `labelled`, at most LABELLED_ROWS
    rows or a ValueError, or else `labelled_lines` of the documents and their clean lines with planted forms and decoys. It
    decodes every line of every text in numpy batches. Without labelled personal data and without clean lines nothing is added.

    Null text counts as empty. Null and repeated doc_ids are scanned row by row. Empty table: no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    if labelled is None:
        rows = labelled_lines(docs).select("sort", "digest", "shapes", "tags").collect()
        table = [(list(r["shapes"]), list(r["tags"])) for r in sorted(rows, key=lambda r: (r["sort"], r["digest"]))]
        table += planted_lines([s for s, t in table if not any(t)][:LINES])
    else:
        rows = labelled.select("shapes", "tags").limit(LABELLED_ROWS + 1).collect()
        if len(rows) > LABELLED_ROWS:
            raise ValueError(f"the labelled table has more than {LABELLED_ROWS} rows")
        table = sorted((list(r["shapes"]), list(r["tags"])) for r in rows)
    field = train(table)
    span = "array<struct<kind:int,start:int,stop:int>>"
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _scan(b, field), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {span}, added {span}")
