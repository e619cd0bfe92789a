"""Near-duplicate documents: MinHash signatures and a multi-index Hamming join, confirmed on whole shingle sets."""

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import attach, written
from netloom.llm.links import components
from netloom.llm.words import mixed, shingle_sets, small_batches

PLACES = 64
# Rounds of comparing each class with one hub.
ROUNDS = 3
# Rows of one group, and shingles of their sets, that are compared with as many others at a time.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 22
# Ids sent to all tasks up to this number, else joined.
BROADCAST_IDS = 500_000

_RNG = np.random.default_rng(64)
_XOR = _RNG.integers(0, 1 << 63, PLACES, dtype=np.uint64)
_MUL = _RNG.integers(0, 1 << 62, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def distance_limit(similarity: float, places: int = PLACES) -> int:
    """Places at which signatures may differ: the mean for pairs just at the similarity, and 4.2 deviations."""
    miss = 1 - similarity
    return math.ceil(places * miss + 4.2 * math.sqrt(places * miss * similarity))


def chunk_bounds(limit: int) -> list[tuple[int, int]]:
    """Chunks so many that any two signatures within the limit differ at no more than one place of some chunk."""
    chunks = min(PLACES // 2, max(1, math.ceil((limit + 1) / 2)))
    cuts = [round(i * PLACES / chunks) for i in range(chunks + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def signature(found: np.ndarray) -> np.ndarray:
    """For each place 16 bits of the least hash of the set under the place's function."""
    least = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 2048):
        least = np.minimum(least, ((found[None, i : i + 2048] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1))
    return (mixed(least) & np.uint64(0xFFFF)).astype(np.uint16)


def _signatures(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, first, second, marks = [], [], [], []
        for _, found in shingle_sets(batch.column(1), width):
            n.append(len(found))
            first.append(int(found.sum(dtype=np.uint64).astype(np.int64)))
            second.append(int(mixed(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).astype(np.int64)))
            marks.append(signature(found).tobytes() if len(found) else None)
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(marks, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "first", "second", "mark"])


def _keys(batches: Iterator[pa.RecordBatch], bounds: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """A key for each chunk and each of its places left out: signatures that differ at one place of the chunk share one."""
    for batch in batches:
        if not len(batch):
            continue
        marks = _spread(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(batch), PLACES))
        for low, high in bounds:
            chunk = marks[:, low:high].sum(axis=1, dtype=np.uint64)
            for place in range(low, high):
                key = mixed(chunk - marks[:, place] + np.uint64(place)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0)], ["key", "rep"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        rows, held = [], 0
        for row, found in shingle_sets(batch.column(1), width):
            rows.append((row, found.astype(np.int64)))
            held += len(found)
            if held > 1 << 20:
                yield _set_batch(ids, rows)
                rows, held = [], 0
        if rows:
            yield _set_batch(ids, rows)


def _set_batch(ids: pa.Array, rows: list) -> pa.RecordBatch:
    values = pa.array(np.concatenate([x for _, x in rows]))
    offsets = pa.array(np.cumsum([0, *(len(x) for _, x in rows)]), pa.int32())
    return pa.RecordBatch.from_arrays([ids.take(pa.array([r for r, _ in rows])), pa.ListArray.from_arrays(offsets, values)], ["id", "shingles"])


def _hub_pairs(members: DataFrame, turn: int) -> DataFrame:
    """(a, b) from (key, rep, component): each class and the hub that most of its keys name, if of another component.

    The hub of a key is its least class, in later rounds its first in an order drawn anew. Counts are by key before class.
    """
    order = F.col("rep") if turn == 0 else F.xxhash64("rep", F.lit(turn))
    hubs = members.groupBy("key").agg(F.min(F.struct(order.alias("order"), F.col("rep"), F.col("component"))).alias("hub"), F.min("component").alias("low"), F.max("component").alias("high"))
    hubs = hubs.where("low <> high").select(F.col("key").alias("k"), F.col("hub.rep").alias("hub"), F.col("hub.component").alias("hub_component"))
    named = members.join(hubs, F.col("key") == F.col("k")).where("component <> hub_component").groupBy("rep", "hub").agg(F.count("*").alias("n"))
    best = named.groupBy("rep").agg(F.max(F.struct(F.col("n"), (-F.col("hub")).alias("minus"))).alias("best"))
    other = -F.col("best.minus")
    return best.select(F.least(other, F.col("rep")).alias("a"), F.greatest(other, F.col("rep")).alias("b")).distinct()


def _spread(marks: np.ndarray) -> np.ndarray:
    """64-bit numbers for the values of a signature, apart for each place."""
    return mixed(marks.astype(np.uint64) + np.arange(PLACES, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(1))


def _block_rows(batches: Iterator[pa.RecordBatch], limit: int, share: float) -> Iterator[pa.RecordBatch]:
    """Of each block (hub, i, j), the rows with another of a different component and like size within the distance.

    Rows come ordered by block. The rows of many blocks are compared at once, each with the one d places further on, for
    rising d while any block is that long; what a block has of rows in the next batch waits for it.
    """
    held = None
    for batch in chain(batches, [None]):
        if batch is not None:
            numbers = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(7)])
            marks = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint16).reshape(len(batch), PLACES)
            if held is not None:
                numbers, marks = np.concatenate([held[0], numbers], axis=1), np.concatenate([held[1], marks])
        elif held is not None:
            numbers, marks = held
        else:
            return
        new = np.concatenate([[True], (numbers[:3, 1:] != numbers[:3, :-1]).any(axis=0)])[: numbers.shape[1]]
        whole = len(new) if batch is None else (int(np.flatnonzero(new)[-1]) if len(new) else 0)
        held = numbers[:, whole:], marks[whole:]
        group, (hub, i, j, own, rep, component, size) = np.cumsum(new[:whole]), numbers[:, :whole]
        wanted, at, d = np.zeros(whole, bool), np.arange(whole), 1
        while len(at):
            at = at[at + d < whole]
            at = at[group[at] == group[at + d]]
            near = at[(component[at] != component[at + d]) & ((i[at] == j[at]) | (own[at] != own[at + d]))]
            near = near[np.minimum(size[near], size[near + d]) >= share * np.maximum(size[near], size[near + d]) - 1e-9]
            near = near[(marks[near] != marks[near + d]).sum(axis=1) <= limit]
            wanted[near] = wanted[near + d] = True
            d += 1
        yield pa.RecordBatch.from_arrays([pa.array(numbers[c, :whole][wanted]) for c in range(7)] + [pa.array([m.tobytes() for m in marks[:whole][wanted]], pa.binary())], _BLOCK)


_BLOCK = ["hub", "i", "j", "own", "rep", "component", "n_shingles", "mark"]
_BLOCK_TYPES = "hub bigint, i bigint, j bigint, own bigint, rep bigint, component bigint, n_shingles bigint, mark binary"


def block_links(cross: bool, own: np.ndarray, component: np.ndarray, marks: np.ndarray, sets: list[np.ndarray], limit: int, percent: int) -> list[tuple[int, int]]:
    """Links between the components of one block, as pairs of rows: pairs within the distance are confirmed on their whole sets, as long as their ends are not linked yet.

    cross: only rows of different `own` are compared. At most one link fewer than there are rows.
    """
    label, out = component.copy(), []
    size = np.array([len(x) for x in sets])
    for a in range(len(sets) - 1):
        others = np.arange(a + 1, len(sets))
        others = others[(label[others] != label[a]) & ((own[others] != own[a]) | (not cross))]
        others = others[100 * np.minimum(size[others], size[a]) >= percent * np.maximum(size[others], size[a])]
        others = others[(marks[others] != marks[a]).sum(axis=1) <= limit]
        if not len(others):
            continue
        values = np.concatenate([sets[b] for b in others])
        found = sets[a][np.minimum(np.searchsorted(sets[a], values), size[a] - 1)] == values
        both = np.add.reduceat(found, np.concatenate([[0], np.cumsum(size[others])[:-1]]), dtype=np.int64)
        for b in others[100 * both >= percent * (size[a] + size[others] - both)].tolist():
            if label[a] != label[b]:
                out.append((a, b))
                label[label == label[b]] = label[a]
    return out


def _block_links(batches: Iterator[pa.RecordBatch], limit: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The links of each block between components. Rows come ordered by block, with their sets; one block is held."""
    block, held = None, []

    def close() -> pa.RecordBatch:
        own, component, marks, sets = zip(*held, strict=True)
        component = np.array(component)
        found = block_links(block[1] != block[2], np.array(own), component, np.stack(marks), list(sets), limit, percent)
        ends = component[np.array(found, np.int64).reshape(-1, 2)]
        return pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1))], ["a", "b"])

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2)), strict=True))
        for row, key in enumerate(keys):
            if key != block:
                if held:
                    yield close()
                block, held = key, []
            found = np.sort(batch.column(8)[row].values.to_numpy().view(np.uint64))
            held.append((batch.column(3)[row].as_py(), batch.column(5)[row].as_py(), np.frombuffer(batch.column(7)[row].as_py(), np.uint16), found))
    if held:
        yield close()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of `docs`.

    Documents are linked when 100 x intersection >= percent x union of their sets of `width`-word shingles.

    1. Each whole text gives its set size, a digest of the set and a signature of PLACES values of 16 bits. Documents of
       equal sets are one class, folded before the shuffle; everything below is on classes.
    2. Multi-index Hamming join: signatures are split into chunks so that, by pigeonhole, two within the distance limit
       differ at no more than one place of some chunk. For each chunk a key is written for each place left out, so these
       pairs share a key. The limit lies 4.2 deviations above the mean distance of pairs just at the similarity.
    3. In a few rounds each class is compared with one other, the hub of a key that most of its keys name and that is not yet
       in its component; so rows grow with classes, not with pairs. Links are confirmed on whole sets and merged into
       components. Classes of keys that still hold several components are then compared in blocks of bounded size: first by
       signatures, to find the classes that are near any other; then those bring their whole sets, and a pair is confirmed
       inside its block unless confirmed links already join its ends. So only links leave a block, fewer than it has rows,
       and every pair that shares a key is in one component or has been compared.
    4. Components are the smallest doc_id reachable.

    Lower case A-Z; words are runs without ASCII white space. Fewer words than width: the whole sequence is the one shingle.
    Null or wordless text: n_shingles 0, linked with nothing. Rows with a null doc_id: component_id null, kept true.
    Rows repeating a doc_id are compared each by its own text and keep their id: one row for each, all kept if the id is the
    smallest of their component. Empty table: no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    if not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return _by_row(docs, width, percent)
    share, limit = percent / 100, distance_limit(percent / 100)
    bounds = chunk_bounds(limit)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = texts.mapInArrow(lambda b: _signatures(b, width), "doc_id bigint, n_shingles bigint, first bigint, second bigint, mark binary")
    marks = written(marks, "near-marks")
    same = ["n_shingles", "first", "second"]
    classes = marks.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"), F.first("mark").alias("mark"))
    classes = written(classes, "near-classes")
    reps = classes.where("rep IS NOT NULL").select("rep", "mark", "n_shingles")

    keys = reps.select("rep", "mark").mapInArrow(lambda b: _keys(b, bounds), "key bigint, rep bigint")
    met = keys.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select(F.col("key").alias("k"))
    shared = written(keys.join(met, F.col("key") == F.col("k")).select("key", "rep"), "near-keys")
    labelled, links = reps.withColumn("component", F.col("rep")), None
    for turn in range(ROUNDS):
        members = shared.join(labelled.select(F.col("rep").alias("r"), "component"), F.col("rep") == F.col("r")).drop("r")
        pairs = written(_near(_hub_pairs(members, turn), reps, limit, share), "near-pairs")
        found = confirmed(texts, pairs, width, percent)
        links = found if links is None else links.unionByName(found)
        if found.isEmpty():
            break
        groups = components(links)
        labelled = reps.join(groups, F.col("rep") == F.col("id"), "left").select("rep", "mark", "n_shingles", F.coalesce("component", "rep").alias("component"))
    members = shared.join(labelled.select(F.col("rep").alias("r"), "component"), F.col("rep") == F.col("r")).drop("r")
    # all rows that share keys of one least row meet in one group, once for all these keys
    mixed_keys = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("rep").alias("hub")).where("low <> high")
    groups = members.join(mixed_keys.select(F.col("key").alias("k"), "hub"), F.col("key") == F.col("k")).select("hub", "rep").distinct()
    full = labelled.withColumnRenamed("rep", "r")
    groups = written(groups.join(full, F.col("rep") == F.col("r")).select("hub", "rep", "component", "n_shingles", "mark"), "near-open")
    sizes = groups.groupBy("hub").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("bigint").alias("blocks"))
    spread = groups.join(sizes.withColumnRenamed("hub", "h"), F.col("hub") == F.col("h")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    # a row goes to the blocks (i, own) and (own, j) of its group
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    spread = spread.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).select(*_BLOCK)
    spread = spread.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    near = written(spread.mapInArrow(lambda b: _block_rows(b, limit, share), _BLOCK_TYPES), "near-rows")
    wanted = written(near.select(F.col("rep").alias("wanted")).distinct(), "near-wanted")
    sets = written(_texts_of(texts, wanted).mapInArrow(lambda b: _sets(b, width), "id bigint, shingles array<bigint>").dropDuplicates(["id"]), "near-sets")
    near = near.join(sets, F.col("rep") == F.col("id")).select(*_BLOCK, "shingles").repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    more = written(near.mapInArrow(lambda b: _block_links(b, limit, percent), "a bigint, b bigint"), "near-links").distinct()
    merged = components(more).select("id", F.col("component").alias("merged"))
    groups = labelled.select(F.col("rep").alias("r"), "component").join(merged, F.col("component") == F.col("id"), "left")
    groups = groups.select("r", F.coalesce("merged", "component").alias("component_id"))

    named = classes.join(groups, F.col("rep") == F.col("r"), "left").select(*same, F.col("rows"), "component_id")
    out = attach(marks.select("doc_id", *same), named.withColumnRenamed("rows", "met"), same, "met", marks.count(), F.xxhash64("doc_id", "first"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _by_row(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """`near_duplicates` where doc_ids repeat: on numbers of rows, mapped back to the smallest doc_id of each component."""
    rows = written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id()), "near-rows")
    found = near_duplicates(rows.select(F.when(F.col("doc_id").isNotNull(), F.col("row")).alias("doc_id"), "text"), width, percent)
    nameless = found.where("doc_id IS NULL")
    found = written(found.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("row"), "n_shingles", "component_id").join(rows.select("row", "doc_id"), "row"), "near-found")
    least = written(found.groupBy("component_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("met")), "near-least")
    out = attach(found, least, ["component_id"], "met", found.count(), F.xxhash64("row"))
    out = out.select("doc_id", "n_shingles", F.col("least").alias("component_id"), (F.col("doc_id") == F.col("least")).alias("kept"))
    return out.unionByName(nameless)


def _near(pairs: DataFrame, reps: DataFrame, limit: int, share: float) -> DataFrame:
    """Pairs (a, b) of like sizes within the distance limit."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("mark").alias(f"mark_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(share) - 1e-9)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(len(batch), PLACES) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array((left != right).sum(axis=1) <= limit))

    return both.select("a", "b", "mark_a", "mark_b").mapInArrow(within, "a bigint, b bigint")


def _texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the wanted ids; texts move only if the ids are too many to send."""
    small = wanted.count() <= BROADCAST_IDS
    return texts.join(F.broadcast(wanted) if small else wanted, F.col("doc_id") == F.col("wanted"), "left_semi")


def confirmed(texts: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar enough; texts are read again for these documents only."""
    ends = [pairs.select(F.col(end).alias("wanted")).distinct() for end in ("a", "b")]
    wanted = written(ends[0].union(ends[1]).distinct(), "near-wanted")
    sets = written(_texts_of(texts, wanted).mapInArrow(lambda b: _sets(b, width), "id bigint, shingles array<bigint>").dropDuplicates(["id"]), "near-sets")
    side = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    inter = F.size(F.array_intersect("set_a", "set_b"))
    both = both.select("a", "b", inter.alias("inter"), (F.size("set_a") + F.size("set_b")).alias("sum"))
    return written(both.where(F.col("inter") * 100 >= percent * (F.col("sum") - F.col("inter"))).select("a", "b"), "near-links")
