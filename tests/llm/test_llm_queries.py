"""Registered queries on training data against their SQL, whole tables of the smallest data set."""

import duckdb
import pytest

from netloom.llm.queries import QUERIES, SQL, tokenizer_path

TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def plain(rows):
    cell = lambda v: repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(cell(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", SQL)
def test_query_against_sql(spark, data, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    frame = QUERIES[name](spark, data)
    columns = sorted(frame.columns)
    result = con.execute(SQL[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == columns
    assert plain(frame.select(columns).collect()) == plain([[row[found.index(c)] for c in columns] for row in result.fetchall()])


def test_best_fit_query_against_the_tokenizer(spark, data):
    """Ids of whole texts by the file's own library, digests by zlib, sequences without holes, and no more of them than the ids need and one."""
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op12_best_fit"](spark, data).collect()
    pieces, sequences = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for doc_id, some in pieces.items():
        some.sort()
        assert [x[1] for x in some] == np.cumsum([0, *(x[2] for x in some[:-1])]).tolist() and sum(x[2] for x in some) == len(ids[doc_id])
        assert [x[0] for x in some] == list(range(len(some))) and all(x[2] == 2048 for x in some[1:])
    for some in sequences.values():
        some.sort()
        assert [x[0] for x in some] == np.cumsum([0, *(x[1] for x in some[:-1])]).tolist() and sum(x[1] for x in some) <= 2048
    assert len(sequences) <= -(-sum(map(len, ids.values())) // 2048) + 1
