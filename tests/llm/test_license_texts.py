"""License scan: texts that differ in what tells licenses apart, and exact containment by brute force."""

import random
import re

from faunaflux.llm import licenses
from faunaflux.llm.cluster import keyed

T = licenses.TEMPLATES


def names(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["_id"]: [m.template for m in r.matches] for r in licenses.scan_licenses(keyed(docs), **options).collect()}
    return [got[i] for i in range(len(texts))]


def test_every_template_is_found_as_itself(spark):
    """Whole, in other words around it, and with a word changed."""
    random.seed(4)
    around = [f"before it {t} and after it" for t in T.values()]
    assert names(spark, around) == [[n] for n in T]
    long = {n: t for n, t in T.items() if len(t.split()) > 60}
    changed = []
    for t in long.values():
        w = t.split()
        w[len(w) * 3 // 4] = "something"
        changed.append(" ".join(w))
    assert [x and x[0] for x in names(spark, changed)] == list(long)


def test_versions_and_clauses(spark):
    gpl2, lgpl, bsd2 = T["GPL-2.0 header"], T["LGPL-2.1 header"], T["BSD-2-Clause"]
    other = T["GPL-3.0 header"].replace("version 3", "version 9")
    notice = "This work is licensed under the GNU General Public License, version 2 and nothing else"
    assert names(spark, [gpl2, lgpl, bsd2, other, notice, T["Apache-2.0 header"], T["BSD-3-Clause"]]) == [["GPL-2.0 header"], ["LGPL-2.1 header"], ["BSD-2-Clause"], [], ["GPL-2.0 notice"], ["Apache-2.0 header"], ["BSD-3-Clause"]]


def test_given_templates(spark):
    table = spark.createDataFrame([("own", "one two three four five six seven", 1), ("own", "zz one two three four five six", 2), (None, "x", 3), ("none", None, 4)], "name string, text string, n int")
    assert names(spark, ["a one two three four five six seven b", T["MIT"]], templates=table) == [["own"], []]


def tokens(text):
    return [x.lower() for x in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", text)]


def shingles(text):
    t = tokens(text)
    return {tuple(t[k : k + 5]) for k in range(len(t) - 4)}


def test_containment_by_brute_force(spark):
    """A template is found exactly where 0.8 of its shingles are in the text; only one template and one place here, so nothing else decides."""
    random.seed(9)
    template = {"one": T["zlib"]}
    w = T["zlib"].split()
    texts = []
    for _ in range(80):
        x = list(w)
        for _ in range(random.randint(0, 9)):
            x[random.randrange(len(x))] = "changed"
        texts.append(" ".join([random.choice("pqrs") for _ in range(random.randint(0, 60))] + x + ["end"] * random.randint(0, 9)))
    want = [len(shingles(t) & shingles(T["zlib"])) / len(shingles(T["zlib"])) >= 0.8 for t in texts]
    assert [bool(x) for x in names(spark, texts, templates=template)] == want and 10 < sum(want) < 70


def test_long_text_ties_and_clashing_columns(spark, tmp_path):
    text = "word " * 600_000 + T["ISC"] + " other" * 50_000
    d = spark.createDataFrame([(1, text, "x", 5), (None, T["MIT"] + "\n" + T["MIT"], "y", 6), (2, None, "z", 7)], "doc_id long, text string, matches string, template int")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_licenses, r.spans.count("MIT")) for r in licenses.op4_licenses(spark, str(tmp_path)).collect()}
    assert got == {1: (1, 0), None: (2, 2), 2: (0, 0)}
