"""The mixture of each document against expectation and maximisation in plain loops, over every number of languages."""

import math

import numpy as np

from faunaflux.llm import language_id as li

SF = "/root/testdata/sf0.001"


def counts(text):
    """How often each bucket of a trigram around a letter byte occurs."""
    data = [int(li._LOW[b]) for b in text.encode()]
    out = {}
    for i, c in enumerate(data):
        if li._IS_LETTER[c]:
            a, b = data[i - 1] if i else 32, data[i + 1] if i + 1 < len(data) else 32
            key = ((a << 16 | c << 8 | b) * 0x9E3779B1 % 2**32) >> (32 - li.BUCKET_BITS)
            out[key] = out.get(key, 0) + 1
    return out


def em(grams, p, share, rounds):
    total = sum(grams.values())
    for _ in range(rounds):
        new = [0.0] * len(share)
        for g, n in grams.items():
            whole = sum(s * q for s, q in zip(share, p[g]))
            for j, s in enumerate(share):
                new[j] += n * s * p[g][j] / whole
        share = [v / total for v in new]
    return share, sum(n * math.log(max(sum(s * q for s, q in zip(share, p[g])), 1e-30)) for g, n in grams.items())


def plain(grams, p, k_all):
    full, _ = em(grams, p, [1 / k_all] * k_all, li.ROUNDS)
    order = sorted(range(k_all), key=lambda j: -full[j])
    n, best = sum(grams.values()), None
    for k in range(1, k_all + 1):
        share = [max(full[j], 1e-6) if j in order[:k] else 0.0 for j in range(k_all)]
        share, ll = em(grams, p, [s / sum(share) for s in share], li.AGAIN if k > 1 else 0)
        value = ll - 0.5 * k * math.log(max(n, 2))
        if best is None or value > best[0] + 1e-3:
            best = (value, share, k)
    return best


def test_documents_equal_plain_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = li.learn(docs.where(li.fold(5) != 0))
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    own = [r for r in rows if r.text and len(r.text) < 4000][:60]
    half = [r.text.split() for r in own[:40]]
    mixed = [(10_000 + i, " ".join(half[i][:60] + half[-1 - i][:60])) for i in range(20)]  # two documents in one, of two languages for some
    table = spark.createDataFrame([(r.doc_id, r.text) for r in own] + mixed, "doc_id long, text string")
    got = {r.doc_id: r for r in li.identify(table, model).collect()}
    p = model.probability.astype(np.float64)
    sizes = set()
    for r in table.collect():
        grams = counts(r.text)
        value, share, k = plain(grams, {g: p[g].tolist() for g in grams}, len(model.languages))
        sizes.add(k)
        top = max(range(len(share)), key=lambda j: share[j])
        assert got[r.doc_id].lang_pred == model.languages[top] and abs(got[r.doc_id].score - share[top]) < 0.01
        mine = {x.split(":")[0]: float(x.split(":")[1]) for x in got[r.doc_id].lang_set.split(",")}
        assert all(abs(mine.get(model.languages[j], 0.0) - s) < 0.02 for j, s in enumerate(share))
    assert len(sizes) > 1


def test_counts_of_languages_equal_plain_loops(spark):
    rows = [("aa bb", "x"), ("bb ée", "y"), ("AA", "x"), (None, "x"), ("zz", None)]
    model = li.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ("x", "y")
    for j, lang in enumerate(model.languages):
        total = {}
        for text, of in rows:
            if text and of == lang:
                for g, n in counts(text).items():
                    total[g] = total.get(g, 0) + n
        want = np.full(1 << li.BUCKET_BITS, li.SMOOTHING, float)
        for g, n in total.items():
            want[g] += n
        assert np.allclose(model.probability[:, j], want / want.sum(), rtol=1e-5)
