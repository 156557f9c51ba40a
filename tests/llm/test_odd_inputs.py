"""Very long texts, null identifiers, ties, repeated rows and extra columns with clashing names, for operators whose own tests lack the case."""

import numpy as np

from faunaflux.llm import ann, jaccard_join, language_id, line_dedup, mixing

CLASH = ", _id string, _text string, h int, key int, block int, n int, rank int, score int, v int, curve int, bin int, src int, times int, sig int, rep int, pos int, __none int"
ODD = ("x", "y", *range(1, 15), 9)


def wide(rows):
    return [(*r, *ODD) for r in rows]


def test_long_texts_and_clashing_columns(spark, table):
    word = " ".join(f"word{i}" for i in range(200_000))
    lines = "\n".join(f"line {i}" for i in range(60_000))
    rows = [(1, word, "a"), (2, word + " more", "a"), (3, lines, "b"), (4, "start\n" + lines, "b"), (None, "short", None), (None, "short", None)]
    d = table(wide(rows), "doc_id long, text string, source string" + CLASH)
    links = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.op9_jaccard_join(spark, d).collect() if r.doc_id}
    assert links == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (3, 1)}
    gone = {r.doc_id: r.n_removed for r in line_dedup.op8_line_dedup(spark, d).collect()}
    assert gone == {1: 0, 2: 0, 3: 0, 4: 60_000, None: 0}
    got = mixing.op6_mixing(spark, d).collect()
    assert len(got) == 6 and sum(r.size for r in got if r.doc_id == 2) == 200_001


def test_line_dedup_of_many_rows_without_identifier(spark):
    rows = spark.createDataFrame([(None, "a\nb\nc")] * 50 + [(7, "a\nb\nc")] * 2 + [(8, "a\nb\nc\nd")], "doc_id long, text string")
    got = line_dedup.line_dedup(rows).collect()
    assert len(got) == 53 and all(r.kept_text == "a\nb\nc" for r in got if r.doc_id != 8) and [r.kept_text for r in got if r.doc_id == 8] == ["d"]


def test_language_ties_nulls_repeats_and_long_texts(spark, table):
    """Two languages learned from the same text tie everywhere: the one that sorts first is told, every time."""
    text = "the quick brown fox jumps over the lazy dog " * 30
    rows = [(i, text, lang, None, None) for i in range(40) for lang in ("bb", "aa")] + [(None, text, None, None, None)] * 3 + [(900, text * 800, None, None, None), (901, None, "aa", None, None)]
    d = table(wide(rows), "doc_id long, text string, lang string, source string, n_chars long" + CLASH)
    got = language_id.op10_language_id(spark, d).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got if r.doc_id != 901} == {"aa"} and [r.lang_pred for r in got if r.doc_id == 901] == ["und"]
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id is None}) == 1


def test_neighbours_with_ties_nulls_repeats_and_clashing_columns(spark, table):
    """Points on a grid have many equal distances: the smaller identifiers come first; recall of all queries is exact here."""
    x = np.array([[i % 20, i // 20 % 20, 1] for i in range(800)], float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0, 1.0, 1.0])] * 3 + [(100, x[100].tolist())] * 2
    d = table(wide(rows), "vec_id long, embedding array<float>" + CLASH, "embeddings")
    got = ann.op7_ann(spark, d).collect()
    for q in range(0, 800, 100):
        dist = np.sqrt(((x - x[q]) ** 2).sum(1))
        dist[q] = np.inf
        want = np.lexsort((np.arange(800), dist))[:10]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.score for r in mine] == dist[want].tolist() and all((a.score, a.vec_id) < (b.score, b.vec_id) for a, b in zip(mine, mine[1:]))
