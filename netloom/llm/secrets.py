"""Secret scans, with the corpus telling copied examples from credentials that belong to one owner."""

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import attach, written
from netloom.llm.words import small_batches

KINDS = ("assign", "access", "hex", "live")
# The base patterns; fixed values. Runs of access and hex are matched with their least length, which finds the same runs.
ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
# What may be a credential without a telling name.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")
LEAST_ENTROPY = 3.5  # bits for each character
MOST_OWNERS = 1
# An owner may use a credential in a few documents; what stands in more is an example that was copied within one source.
MOST_ROWS = 5

SPAN = "array<struct<start:int,kind:int,stop:int>>"


def entropy(text: str) -> float:
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def looks_random(text: str) -> bool:
    return any(c.isdigit() for c in text) and any(c.isalpha() for c in text) and entropy(text) >= LEAST_ENTROPY


def base_matches(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, where the value begins), by start and kind. A value ends where its match ends."""
    found = [(m.start(), 0, m.end(), m.start(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), by start and kind."""
    return [m[:3] for m in base_matches(text)]


def candidates(text: str, matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, str, bool]]:
    """(start, end, value, whether a base span touches it): values of base matches, and random-looking tokens.

    A value that two base patterns find at one place is one candidate. Within a base span its value stands for the token.
    """
    out = [(begin, stop, text[begin:stop], True) for begin, stop in sorted({(v, b) for _, _, b, v in matches})]
    for m in TOKEN.finditer(text):
        begin, stop = m.span()
        value = m.group().strip("=")
        if looks_random(value) and not any(a <= begin and stop <= b for a, _, b, _ in matches):
            out.append((begin, stop, value, any(a < stop and begin < b for a, _, b, _ in matches)))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{stop}" for start, kind, stop in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))
    found_type = pa.list_(pa.struct([("hash", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("based", pa.bool_()), ("first", pa.bool_())]))
    for batch in batches:
        digests, spans, found = [], [], []
        for text in batch.column(3).to_pylist():
            text = text or ""
            matches = base_matches(text)
            base = [m[:3] for m in matches]
            tokens, seen = [], set()
            for begin, stop, value, based in candidates(text, matches):
                code = int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)
                tokens.append({"hash": code, "start": begin, "stop": stop, "based": based, "first": code not in seen})
                seen.add(code)
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append([{"start": a, "kind": k, "stop": b} for a, k, b in base])
            found.append(tokens)
        columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(digests, pa.string()), pa.array(spans, spans_type), pa.array(found, found_type)]
        yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "owner", "base_sha256", "base", "found"])


def secret_spans(docs: DataFrame, owner: str = "source", most_owners: int = MOST_OWNERS, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, base_sha256, spans, n_live, n_copied: one row for each row of `docs`.

    spans: array of (start, kind, stop), code points, end exclusive, ordered; kind numbers are those of KINDS. All base spans
    are in it. The values of base matches, whatever their length, and random-looking tokens besides are candidates: the
    distinct rows and owners of their hashes are counted over the corpus, by owner first and then over owners, so a value
    that stands everywhere is folded before each shuffle. A candidate with at most `most_owners` owners and `most_rows` rows
    is live and, where no base span touches it, becomes a span of its own; any other is a copied example and is not added.
    n_live and n_copied count the candidates of the document, in base spans or not. Texts are read once.

    Null text counts as empty. A null owner is an owner. Null and repeated doc_ids are scanned row by row; every row counts as a
    repository, once for each value however often it stands there. Empty table: no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    kind, owner_kind = docs.schema["doc_id"].dataType.simpleString(), docs.schema[owner].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col(owner).alias("owner"), F.col("text").cast("string").alias("text"))
    schema = f"row bigint, doc_id {kind}, owner {owner_kind}, base_sha256 string, base {SPAN}, found array<struct<hash:bigint,start:int,stop:int,based:boolean,first:boolean>>"
    scanned = written(rows.mapInArrow(_scan, schema), "secrets-scanned")

    tokens = scanned.where("size(found) > 0").select("row", "owner", F.explode("found").alias("f")).select("row", "owner", "f.*")
    owners = tokens.groupBy("hash", "owner").agg(F.count("*").alias("n"), F.count_if("first").alias("rows"))
    owners = owners.groupBy("hash").agg(F.sum("n").alias("met"), F.sum("rows").alias("rows"), F.count("*").alias("owners"))
    owners = written(owners, "secrets-owners")
    known = attach(tokens, owners, ["hash"], "met", tokens.count(), F.col("row"))
    live = (F.col("owners") <= most_owners) & (F.col("rows") <= most_rows)
    added = F.collect_list(F.when(live & ~F.col("based"), F.struct("start", F.lit(KINDS.index("live")).alias("kind"), "stop")))
    known = known.groupBy(F.col("row").alias("r")).agg(added.alias("added"), F.sum(live.cast("bigint")).alias("n_live"), F.sum((~live).cast("bigint")).alias("n_copied"))
    out = scanned.join(known, F.col("row") == F.col("r"), "left")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(SPAN))))
    return out.select("doc_id", "base_sha256", spans.alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))
