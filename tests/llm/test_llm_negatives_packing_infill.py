"""Hard negatives, best-fit packing and fill-in-middle against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netloom.llm import bestfit, infill, negatives
from netloom.llm.queries import tokenizer_path


def plain(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


# hard negatives

VECTORS = "vec_id bigint, embedding array<double>, label int, shard string, place int, score double, goals string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 0.5, "y") for r in rows], VECTORS).repartition(3)


def mined(rows, anchors):
    """The contract, row by row."""
    good = [(i, lab, tuple(math.floor(256 * x) for x in v)) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for i, lab, v in good:
        if i % anchors == 0:
            first[i] = min(first.get(i, (lab, v)), (lab, v))
    out = []
    for a, (lab, v) in first.items():
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, other == lab) for i, other, w in good if i != a and len(w) == len(v)]
        for p, pid, _ in sorted(s for s in scored if s[2])[:5]:
            fit = [(n, i) for n, i, same in sorted(scored) if not same and 30 * -p <= 100 * -n <= 90 * -p]
            out += [(a, pid, rank, i, -p, -n) for rank, (n, i) in enumerate(fit[:10], 1)]
    return sorted(out, key=repr)


def test_packed_rows_are_exact():
    rng = np.random.default_rng(1)
    for most, d, n in ((3, 5, 2500), (300, 64, 1100), (1 << 20, 3, 7), (10, 0, 4)):
        rows = rng.integers(-most, most + 1, (n, d))
        anchor = rng.integers(-most, most + 1, d)
        bound = max(1, int(abs(anchor).sum())) * 2 * most
        packed = negatives.PackedRows(rows, most, (bound.bit_length() + 8) // 8)
        assert (packed.scores(anchor.tolist()) == rows @ anchor).all()


@pytest.mark.parametrize("shard_rows", [4096, 40])
def test_hard_negatives_against_a_plain_search(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(negatives, "SHARD_ROWS", shard_rows)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0.1, 0.3) for _ in range(6)], rng.randrange(3)) for i in range(300)]
    rows += [(1000 + i, [0.5, 0.25, 0.125, 0.0, -0.5, 1.0], i % 2) for i in range(150)]  # a third are one vector
    rows += [(500, [0.5, 0.25, 0.125, 0.0, -0.5, 1.0], 0), (500, [0.5, 0.25, 0.125, 0.0, -0.5, 1.0], 0), (500, [0.1] * 6, 0), (500, [9.0] * 6, 2)]
    rows += [(600, None, 1), (610, [1.0] * 6, None), (None, [1.0] * 6, 1), (620, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (630, [math.nan] * 6, 1), (640, [math.inf] * 6, 1)]
    rows += [(650, [1.0, 2.0], 1), (651, [1.0, 2.0], 1), (652, [0.5, 1.0], 0), (660, [], 1), (661, [], 1), (662, [], 2), (670, [0.0] * 6, 1), (680, [-1.0] * 6, 2)]
    found = negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 10 == 0)
    assert plain(found) == mined(rows, 10)


def test_hard_negatives_of_empty_and_refused_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    out = negatives.hard_negatives(empty, F.col("vec_id") % 10 == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and out.isEmpty()
    none = vectors(spark, [(1, [1.0], 0), (2, [1.0], 1)])
    assert negatives.hard_negatives(none, F.col("vec_id") % 10 == 0).isEmpty()
    with pytest.raises(ValueError):
        negatives.hard_negatives(vectors(spark, [(0, [1e9], 0), (1, [1e9], 1)]), F.col("vec_id") % 10 == 0)


# best-fit packing


@settings(max_examples=60, deadline=None)
@given(st.integers(4, 60).flatmap(lambda n: st.lists(st.integers(0, 4), min_size=n, max_size=n)))
def test_plan_uses_every_piece_once(counts):
    counts = np.array([0, *counts])
    used = np.zeros(len(counts), int)
    for need, times in bestfit.plan(counts):
        assert sum(x * m for x, m in need.items()) < len(counts)
        for x, m in need.items():
            used[x] += m * times
    assert (used == counts).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=12, max_size=30), st.data())
def test_index_of_sums_follows_what_is_taken(counts, data):
    left = bestfit.Complements(np.array([0, *counts]))
    for _ in range(5):
        some = np.flatnonzero(left.counts).tolist()
        if not some:
            break
        x = data.draw(st.sampled_from(some))
        left.take(x, data.draw(st.integers(1, int(left.counts[x]))))
    again = bestfit.Complements(left.counts)
    assert (left.pairs == again.pairs).all() and (left.ones == again.ones).all()
    pieces = Counter({i: int(n) for i, n in enumerate(left.counts) if n})
    sums = {(a, b, c) for a in pieces for b in [0, *pieces] for c in [0, *pieces] if not Counter(x for x in (a, b, c) if x) - pieces}
    for gap in range(1, len(left.counts)):
        found = left.filling(gap)
        assert sum(found) == (gap if found else 0) and not Counter(found) - pieces
        assert bool(found) == any(sum(s) == gap for s in sums)


def test_plan_fills_exactly_where_complements_exist():
    counts = np.zeros(101, int)
    counts[[100, 70, 30, 60, 25, 15, 50]] = 8
    assert sum(times for _, times in bestfit.plan(counts)) == 28 == (counts * np.arange(101)).sum() / 100
    crowd = np.zeros(2049, int)
    crowd[[700, 600, 3]] = 10**9
    assert len(bestfit.plan(crowd)) < 20  # the work does not grow with the number of pieces


def check_packing(found, docs, size, end_id):
    """Every id once and in its place, no sequence too long or with a hole."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter((i, tuple(tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id])) for i, text in docs)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= size
        by_doc[r.doc_id].append((r.piece, r.start, ids.tolist()))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    once = {i: ids for i, ids in want if sum(n for (j, _), n in want.items() if j == i) == 1}
    for doc_id, ids in once.items():
        pieces = sorted(by_doc[doc_id])
        assert [p[0] for p in pieces] == list(range(len(pieces))) and [x for p in pieces for x in p[2]] == list(ids)
        assert [p[1] for p in pieces] == np.cumsum([0, *(len(p[2]) for p in pieces[:-1])]).tolist()
        assert all(len(p[2]) == size for p in pieces[1:]) and (len(pieces) == 1 or len(ids) > size)
    assert sum(r.length for r in found) == sum(len(ids) * n for (_, ids), n in want.items())
    return len(by_sequence), math.ceil(sum(r.length for r in found) / size)


SCHEMA = "doc_id bigint, text string, length bigint, part int, rank bigint, piece string"


def test_best_fit_packs_odd_rows_whole(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["alpha", "b", "Gamma.", "d\n", "é日"]) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    docs += [(900, None), (901, ""), (902, "word " * 5000), (903, "a <|endoftext|> b"), (None, "no id"), (904, "twice"), (904, "twice"), (905, "   \n"), (906, "x" * 3000)]
    docs += [(1000 + i, "same length here") for i in range(300)]
    frame = spark.createDataFrame([(*d, 1, 2, 3, "x") for d in docs], SCHEMA).repartition(5)
    for size in (64, 2048):
        used, least = check_packing(bestfit.pack_best_fit(frame, tokenizer_path(), length=size).collect(), docs, size, 0)
        assert used <= least + 1
    frame.write.mode("overwrite").parquet(str((path := __import__("tempfile").mkdtemp()) + "/t"))
    same = [plain(bestfit.pack_best_fit(spark.read.parquet(path + "/t"), tokenizer_path(), length=64)) for _ in range(2)]
    assert same[0] == same[1]


def test_best_fit_of_an_empty_table(spark):
    out = bestfit.pack_best_fit(spark.createDataFrame([], SCHEMA), tokenizer_path())
    assert out.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"] and out.isEmpty()


# fill-in-middle


def test_skip_list_reaches_every_rank():
    rng = np.random.default_rng(4)
    heights = infill.lane_heights(6000)
    assert set(heights[:100]) >= {0, 1}
    for n in (0, 1, 15, 16, 17, 300, 5000):
        widths = rng.integers(1, 9, n)
        units = infill.SkipList(widths, heights)
        ends = np.concatenate([[0], np.cumsum(widths)])
        ranks = range(n + 1) if n <= 300 else rng.integers(0, n + 1, 400).tolist()
        assert [units.place(r) for r in ranks] == ends[list(ranks)].tolist()
        assert n < 300 or len(units.lanes) > 1


def cut_plainly(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return doc_id, n, "spm" if h4 % 100 < 20 else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_against_plain_cuts(spark):
    rng = random.Random(6)
    bits = ["word", "Zz", " ", "\n", "é", "日本", "𝄞", "9", "<", ">", "<P", "S>", "é", "\x00", " ", "M"]
    docs = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 80)))) for i in range(600)]
    docs += [(1000, None), (1001, ""), (1002, " "), (1003, "a <P> b"), (1004, "<S>"), (1005, "x<M>"), (None, "no id at all"), (None, None), (7, "twice"), (7, "twice")]
    docs += [(2000 + i, "<S" + "ab c. " * 60_000 + "é") for i in range(3)]
    frame = spark.createDataFrame([(*d, "x", 1, 2, 3) for d in docs], "doc_id bigint, text string, form string, n int, h1 int, output int").repartition(3)
    cut = infill.fill_in_middle(frame)
    assert plain(cut) == sorted((cut_plainly(*d) for d in docs), key=repr)
    back = cut.select("doc_id", infill.restored(F.col("output"), F.col("form")).alias("text"))
    assert plain(back) == sorted(((i, t or "") for i, t in docs), key=repr)
    assert {r.form for r in cut.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_an_empty_table(spark):
    out = infill.fill_in_middle(spark.createDataFrame([], "doc_id bigint, text string"))
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] and out.isEmpty()
