import math

import duckdb
import numpy as np

from faunaflux.llm import exact, vector_codes

CLASH = ", _id string, _label int, code string, error int, v int, x int, ids int, labels int, tally int, key int, __v int, __d int, cell int"
ODD = ("a", 1, "b", *range(2, 12))


def brute(rows, parts, entries, rounds, scale=256):
    """id, label, code, error by plain Lloyd rounds over Python's integers."""
    kept = [(i, lab, [math.floor(scale * c) for c in v]) for i, v, lab in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return [], []
    d = len(kept[0][2])
    cuts = [d * p // parts for p in range(parts + 1)]
    books = [[r[2][a:b] for r in kept[:entries]] for a, b in zip(cuts, cuts[1:])]
    gap = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e))
    assign = lambda: [[min((gap(r[2][a:b], e), j) for j, e in enumerate(book)) for (a, b), book in zip(zip(cuts, cuts[1:]), books)] for r in kept]
    for _ in range(rounds):
        found = assign()
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            for j in range(len(books[p])):
                own = [r[2][a:b] for r, f in zip(kept, found) if f[p][1] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own)]
    return [(r[0], r[1], bytes(j for _, j in f), sum(s for s, _ in f)) for r, f in zip(kept, assign())], books


def same(spark, rows, schema="vec_id long, embedding array<double>, label string", parts=4, entries=8, rounds=3):
    found = vector_codes.fit(spark.createDataFrame(rows, schema), parts=parts, entries=entries, rounds=rounds)
    want, books = brute([r[:3] for r in rows], parts, entries, rounds)
    got = [(r["_id"], r["_label"], bytes(r.code), r.error) for r in found.rows.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert [b.tolist() for b in found.books] == books
    return found


def test_codes_of_odd_rows_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=9).tolist(), "ab"[i % 2]) for i in range(90)]
    rows += [(5, rows[5][1], "a")] * 30 + [(None, rows[6][1], None)] * 9 + [(None, [0.0] * 9, None), (91, None, "a"), (92, [1.0] * 8 + [None], "a"), (93, [float("nan")] * 9, "b"), (94, [1.0] * 8 + [float("inf")], "b")]
    rows += [(95, [], "a")]
    same(spark, [(*r, *ODD) for r in rows], "vec_id long, embedding array<double>, label string" + CLASH)


def test_components_beyond_longs_are_exact(spark):
    rows = [(i, [float((-1) ** i * (i + 1)) * 10.0 ** (i % 30), 0.5 * i, -3e9 * i, 1.0], None) for i in range(40)]
    found = vector_codes.fit(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), parts=2, entries=4)
    want, books = brute(rows, 2, 4, 2)
    assert [b.tolist() for b in found.books] == books
    assert sorted((r["_id"], bytes(r.code), r.error) for r in found.rows.collect()) == sorted((i, c, e if e < 1 << 63 else None) for i, _, c, e in want)
    assert any(r.label_error is None for r in vector_codes.with_label_errors(found.rows).collect())


def test_ties_go_to_the_lower_entry(spark):
    same(spark, [(i, [float(i % 3), float(i % 2), 1.0, 0.0], "x") for i in range(60)], entries=16)


def test_heaps_leave_most_parts_alone_and_lose_nothing(spark):
    """Four groups far apart: after the first round entries hardly move, so few bounds are passed."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(4, 8)) * 40
    rows = [(i, (centres[i % 4] + rng.normal(size=8)).tolist(), None) for i in range(600)]
    found = same(spark, rows, parts=2, entries=4, rounds=5)
    assert found.scanned[0] == 1200 and sum(found.scanned[2:]) < 300


def test_query_equals_sql_and_empty_table(spark, table, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=32).astype(np.float32).tolist(), [None, 1, 2][i % 3]) for i in range(150)] + [(200, None, 1)]
    d = table(rows, "vec_id long, embedding array<float>, label int", "embeddings")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = vector_codes.op11_vector_codes(spark, d)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(vector_codes.SQL).fetchall())
    d = table([], "vec_id long, embedding array<float>, label int", "embeddings")
    empty = vector_codes.op11_vector_codes(spark, d)
    assert empty.columns == got.columns and not empty.collect()


def test_sums_of_big_integers_over_tasks(spark):
    values = [0, 1, -1, 2**31, -(2**31), 2**32 - 1, 3**60, -(5**40), 2**63, -(2**64) - 7]
    frame = spark.range(7, numPartitions=7).mapInArrow(lambda batches: (exact.cells(np.array(values, object)) for b in batches if b.num_rows), exact.CELLS)
    assert exact.merged(frame, len(values)).tolist() == [7 * v for v in values]
