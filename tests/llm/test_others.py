import random

import duckdb
import numpy as np

from faunaflux.llm import ann, decontaminate, language_id, licenses, line_dedup, mixing
from faunaflux.llm.cluster import NO_ID, components, keyed

SF = "/root/testdata/sf0.001"


def test_line_dedup_equals_sql(spark, table, tmp_path):
    random.seed(2)
    rows = [(i, "\n".join(random.choice(["one", "two", "three", "", "é"]) for _ in range(random.randint(0, 9)))) for i in range(80)] + [(200, None), (201, ""), (202, "x\nx\nx\nx\nx")]
    d = table(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in line_dedup.op8_line_dedup(spark, d).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect())
    assert got == sorted(con.sql(f"select doc_id, n_lines, n_removed, kept_sha256 from ({line_dedup.SQL})").fetchall())
    assert {r[0]: r[2] for r in got}[202] == 2  # the first window's lines stay


def test_line_dedup_keeps_rows_without_identifier(spark):
    rows = spark.createDataFrame([(None, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc\nd")], "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in line_dedup.line_dedup(rows).collect()}
    assert got == {None: "a\nb\nc", 1: "a\nb\nc", 2: "d"}


def water(sizes, weights=(5, 2, 1), cap=3):
    """Targets by repeated clamping and resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(cap * sizes[s] for s in full)
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free} if free else {}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return share | {s: float(cap * sizes[s]) for s in full}
        full |= over


def test_mixing(spark, table):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), str(rng.choice(["a", "b", "c", "d", "é", "Z"], p=[0.7, 0.02, 0.02, 0.06, 0.1, 0.1]))) for i in range(3000)]
    rows += [(5000, None, "empty"), (5001, "x\ty\x0bz ", None), (5002, "", None)]
    d = table(rows, "doc_id long, text string, source string")
    got = mixing.op6_mixing(spark, d).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got)) == sorted(map(tuple, mixing.op6_mixing(spark, d).collect()))
    sizes, source = {}, {r[0]: r[2] for r in rows}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len((r[1] or "").split())
    want, taken = water(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)


def test_mixing_empty_table(spark, table):
    assert mixing.op6_mixing(spark, table([], "doc_id long, text string, source string")).count() == 0


def test_decontaminate_templates_and_slots(spark):
    text = "Anna buys {} apples at {} dollars each and then pays Bob with {} dollars in total today"
    docs = spark.createDataFrame([(1, "Intro here. " + text.format(12, 3, 36)), (2, "Intro here. " + text.format(40, 5, 200)), (3, "some other words about Anna and apples at 3 dollars"), (4, None), (5, ""), (6, "1,200.5 apples")], "doc_id long, text string")
    items = spark.createDataFrame([(7, text.format(12, 3, 36)), (8, "tiny item"), (9, None)], "item_id long, text string")
    got = {(r["_id"], r["item"]): r.new_values for r in decontaminate.find_items(keyed(docs), keyed(items, "item_id")).collect()}
    assert set(got) == {(1, 7), (2, 7)} and got[1, 7] == 0 and got[2, 7] == 3


def test_decontaminate_contradicting_slots_do_not_count(spark):
    item = "the first box holds 7 red balls and later someone moves 7 red balls into the next box again"
    docs = spark.createDataFrame([(1, item.replace("7", "9")), (2, item.replace("7", "9", 1))], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r["_id"] for r in decontaminate.find_items(keyed(docs), keyed(items, "item_id")).collect()] == [1]


def test_decontaminate_by_a_shuffled_join_and_a_small_filter(spark, monkeypatch):
    whole = sorted(map(tuple, decontaminate.op5_decontaminate(spark, SF).collect()))
    monkeypatch.setattr(decontaminate, "SMALL", 0)
    monkeypatch.setattr(decontaminate, "FILTER_BITS", (16, 16))
    assert sorted(map(tuple, decontaminate.op5_decontaminate(spark, SF).collect())) == whole and whole


def test_language_id_held_out_accuracy(spark):
    got = language_id.op10_language_id(spark, SF)
    right = got.join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("held_out").selectExpr("avg(cast(lang = lang_pred as int))").first()[0]
    assert right > 0.97


def test_language_id_mixture_and_undetermined(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.learn(docs)
    text = {r.lang: r.text for r in docs.where("length(text) > 800").collect()}
    rows = [(1, text["en"][:700] + " " + text["fr"][:700]), (2, "123 ###"), (3, None), (4, "")]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert {x.split(":")[0] for x in got[1].lang_set.split(",")} >= {"en", "fr"} and 0.3 < got[1].score < 0.8
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (2, 3, 4))


def test_language_id_without_labels(spark, table):
    got = language_id.op10_language_id(spark, table([(1, "words here", None, None, None)])).collect()
    assert [r.lang_pred for r in got] == ["und"]
    assert language_id.op10_language_id(spark, table([])).count() == 0


def test_licenses(spark):
    x = licenses.TEMPLATES
    docs = spark.createDataFrame([(1, "foo " + x["MIT"] + " bar"), (2, "x " + x["Apache-2.0 header"].replace("compliance", "line") + " y" * 600), (3, None), (4, "plain words only here and there"), (5, "é " * 300 + x["MIT notice"])], "doc_id long, text string")
    got = {r["_id"]: r.matches for r in licenses.scan_licenses(keyed(docs)).collect()}
    assert [m.template for m in got[1]] == ["MIT"] and got[1][0].start == 4 and got[1][0].containment == 1
    assert [m.template for m in got[2]] == ["Apache-2.0 header"] and not got[3] and not got[4]
    assert ("é " * 300 + x["MIT notice"]).encode()[got[5][0].start : got[5][0].stop].decode() == x["MIT notice"]


def test_license_bands_are_sure_enough():
    for s in (0.2, 0.5, 0.8):
        assert 1 - (1 - s) ** licenses.bands_for(s) >= licenses.COLLISION


def test_ann_recall_and_duplicates(spark, table):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 8))
    x[:500] = x[0]  # a third of all rows share a vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2100, [1.0])]
    got = ann.op7_ann(spark, table(rows, "vec_id long, embedding array<float>", "embeddings")).collect()
    y = x.astype(np.float32).astype(np.float64)
    hit = total = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1500), d))[:10]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11)) and all(abs(r.score - d[r.vec_id]) < 1e-12 for r in mine)
        hit, total = hit + len({r.vec_id for r in mine} & set(want.tolist())), total + 10
    assert hit >= 0.9 * total and {r.query_id for r in got} == set(range(0, 1500, 100))


def test_ann_few_rows(spark, table):
    got = ann.op7_ann(spark, table([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>", "embeddings")).collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 1)]
    assert ann.op7_ann(spark, table([], "vec_id long, embedding array<float>", "embeddings")).count() == 0


def test_hilbert_neighbours_touch():
    g = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = np.argsort(ann.hilbert(g, 3))
    assert (np.abs(np.diff(g[order], axis=0)).sum(1) == 1).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 300), (7, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in [*range(41), 50]) and got[200] == got[100] == 100


def test_empty_tables_and_empty_benchmark(spark):
    docs = spark.createDataFrame([(1, "some words of a text that goes on")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "some words of a text that goes on")], "item_id long, text string")
    none = docs.limit(0)
    assert licenses.scan_licenses(keyed(none)).count() == 0
    assert decontaminate.find_items(keyed(none), keyed(items, "item_id")).count() == 0
    assert decontaminate.find_items(keyed(docs), keyed(items.limit(0), "item_id")).count() == 0
    assert [tuple(r)[:2] for r in decontaminate.find_items(keyed(docs), keyed(items, "item_id")).collect()] == [(1, 7)]
    assert line_dedup.line_dedup(none).count() == 0


def test_repeated_rows_and_null_identifiers_repeat_their_results(spark):
    notice = licenses.TEMPLATES["MIT notice"]
    docs = spark.createDataFrame([(1, notice), (1, notice), (None, notice)], "doc_id long, text string")
    assert [len(r.matches) for r in licenses.scan_licenses(keyed(docs)).collect()] == [1, 1, 1]
    items = spark.createDataFrame([(7, notice), (7, notice)], "item_id long, text string")
    # rows that repeat identifier and text are one
    assert sorted(tuple(r)[:2] for r in decontaminate.find_items(keyed(docs), keyed(items, "item_id")).collect()) == [(NO_ID, 7), (1, 7)]


def test_mixing_of_copies_and_null_identifiers(spark, table):
    """Sources of nothing but copies, of rows without an identifier, and of one identifier with many texts come within one document of their targets."""
    rows = [(None, " ".join(["w"] * 10), "copies") for _ in range(2000)] + [(None, f"text number {i} here", "none") for i in range(500)] + [(7, f"one of {i}", "same") for i in range(400)] + [(9, "x y", "same")] * 300
    got = mixing.op6_mixing(spark, table(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.op6_mixing(spark, table(rows, "doc_id long, text string, source string")).collect()), key=repr)
    taken, target = {}, {}
    for r in got:
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
        target[r.source_size] = r.target
        assert r.taken <= 3 * r.size
    assert len(taken) == 3 and all(abs(taken[s] - target[s]) <= 10 for s in taken), (taken, target)
