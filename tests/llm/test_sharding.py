from collections import Counter, defaultdict

import duckdb

from faunaflux.llm import sharding
from faunaflux.llm.cluster import durable

CLASH = ", key string, size int, crc int, _id string, piece int, first int, shard string, slot string, __key int, __size int, __row int, _row int"
ODD = ("k", 1, 2, "i", *range(3, 5), "s", "t", *range(5, 9))
SCHEMA = "doc_id long, text string" + CLASH
OWN = "doc_id long, text string, key string"


def frames(rows):
    return [(*r, *ODD) for r in rows]


def held_against_sql(spark, d, tmp_path):
    con = duckdb.connect()
    con.sql(f"create or replace view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = sharding.op12_sharding(spark, d).collect()
    assert Counter(map(tuple, got)) == Counter(con.sql(sharding.SQL).fetchall())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got


def test_odd_rows_equal_sql(spark, table, tmp_path):
    """Null and empty texts, a third of all rows with one text (and no identifier, some of them), repeated rows, a text longer than shards, clashing columns."""
    rows = [(i, f"text {i} " * (i % 17)) for i in range(400)] + [(i, "the same text") for i in range(1000, 1200)] + [(None, "the same text")] * 40 + [(7, "é" * 9)] * 5
    rows += [(500, None), (501, ""), (None, None), (502, "long " * 4000)]
    got = held_against_sql(spark, table(frames(rows), SCHEMA), tmp_path)
    assert len(got) == len(rows) and {r.text_crc32 for r in got if r.doc_id == 500} == {0} and {r.size for r in got if r.doc_id == 500} == {8}


def test_hot_text_is_cut_and_shards_are_even(spark, table, tmp_path):
    rows = [(i, "copied passage of some length") for i in range(3000)] + [(5000 + i, f"own text number {i:06d} here") for i in range(3000)]
    got = held_against_sql(spark, table(frames(rows), SCHEMA), tmp_path)
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    assert len(load) == 24 and max(load.values()) - min(load.values()) <= 2 * 40
    # equal texts lie side by side
    assert len({r.shard for r in got if r.doc_id < 5000}) <= 14


def test_tolerance_saves_rounds_and_holds(spark):
    rows = durable(spark.range(20000).selectExpr("unhex(rpad(md5(cast(id as string)), 48, '0')) as key", "100L as size"))
    goals = [(k, 10) for k in range(1, 10)]
    rough, fine = (sharding.find_splitters(rows, 2_000_000, goals, [t] * 9) for t in (20_000, 0))
    assert rough.rounds <= fine.rounds and fine.bytes == [200_000 * k for k in range(1, 10)] == [100 * n for n in fine.rows]
    assert all(abs(b - 200_000 * k) <= 20_000 for k, b in enumerate(rough.bytes, 1))


def test_empty_table_and_fewer_rows_than_shards(spark, table, tmp_path):
    d = table([], SCHEMA)
    assert not sharding.op12_sharding(spark, d).collect()
    held_against_sql(spark, table(frames([(1, "a"), (2, "b"), (2, "b")]), SCHEMA), tmp_path)


def test_written_shards_hold_all_columns(spark, table, tmp_path):
    docs = spark.read.parquet(table([(i, f"t{i % 50}", "k") for i in range(300)], OWN) + "/documents.parquet")
    sharding.write_shards(docs, f"{tmp_path}/out", shards=5)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.doc_id, r.text, r.key) for r in back.collect()) == sorted((r.doc_id, r.text, r.key) for r in docs.collect())
    want = {r["_id"]: (r.shard, r.slot) for r in sharding.shard(docs, shards=5).collect()}
    assert {r.doc_id: (r.shard, r.slot) for r in back.collect()} == want
