import random

import pytest

from faunaflux.llm import jaccard_join


def brute(rows):
    sets = {}
    for i, t in rows:
        w = [x.encode().lower().decode() for x in (t or "").split()]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    links, root = dict.fromkeys(sets, 0), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in sets}


def near_copies():
    random.seed(7)
    rows, i = [], 0
    for size in (1, 1, 2, 3, 5, 40):
        words = [random.choice("abcdefghijklmnop") * random.randint(1, 4) for _ in range(120)]
        for _ in range(size):
            w = list(words)
            for _ in range(random.randint(0, 3)):
                w[random.randrange(len(w))] = "changed"
            rows.append((i, " ".join(w)))
            i += 1
    rows += [(i + k, t) for k, t in enumerate(["short text", "Short text", None, "", " ", "other", rows[5][1], rows[5][1]])]
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [512, 7])
def test_equals_brute_force(spark, table, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_copies()
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.op9_jaccard_join(spark, table(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_nulls_repeats_and_empty(spark, table):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)]
    got = jaccard_join.op9_jaccard_join(spark, table(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and sorted(r.n_links for r in got) == [0, 2, 2, 2]
    assert jaccard_join.op9_jaccard_join(spark, table([], "doc_id long, text string")).count() == 0


def test_posterior_is_a_probability_and_grows_with_matches():
    p = [jaccard_join.posterior(m, 32, 0.8) for m in range(33)]
    assert p == sorted(p) and 0 < p[0] < 1e-20 and p[-1] > 0.99
    assert jaccard_join.posterior(jaccard_join.least_matches(63, 0.8, 1e-7), 63, 0.8) >= 1e-7


def test_many_null_identifiers(spark, table):
    """Null rows with different and near-equal texts, exact copies of them with an identifier, and one identifier on two texts."""
    random.seed(11)
    base = [[random.choice("abcdefghijklmnop") * random.randint(1, 4) for _ in range(120)] for _ in range(4)]
    near = lambda w: [*w[:60], "changed", *w[61:]]
    texts = [base[0], base[1], near(base[1]), base[2], near(base[2]), base[3], base[1], near(base[0]), near(base[3])]
    ids = [None, None, None, None, 7, None, 9, 5, 5]
    rows = [(i, " ".join(t)) for i, t in zip(ids, texts, strict=True)]
    got = sorted(((r.doc_id or 0, r.class_id or 0, r.copy_of or 0, r.n_links) for r in jaccard_join.op9_jaccard_join(spark, table(rows, "doc_id long, text string")).collect()))
    assert got == sorted([(0, 5, 0, 1), (0, 9, 9, 2), (0, 9, 0, 2), (0, 7, 0, 1), (7, 7, 7, 1), (0, 5, 0, 1), (9, 9, 9, 2), (5, 5, 5, 1), (5, 5, 5, 1)])
