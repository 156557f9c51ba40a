import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from faunaflux.llm import lm_scoring, lm_trie


def brute(rows):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    words = [re.findall("[^\x20\x09-\x0d]+", low(t or "")) + [None] for _, t in rows]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for x, h in zip(words, held, strict=True) if not h for w in x)
    pair = Counter(p for x, h in zip(words, held, strict=True) if not h for p in zip([None, *x[:-1]], x, strict=True))
    triple = Counter(p for x, h in zip(words, held, strict=True) if not h for p in zip([None, *x], x, x[1:]))
    n, v, mu = sum(c.values()), len(c), lm_scoring.MU
    for (i, _), x, h in zip(rows, words, held, strict=True):
        low = [(c[w] + 1) / (n + v + 1) for w in x]
        two = [(pair[a, b] + mu * q) / (c[a] + mu) for a, b, q in zip([None, *x[:-1]], x, low, strict=True)]
        full = two[:1] + [(triple[u, a, b] + mu * q) / (pair[u, a] + mu) for u, a, b, q in zip([None, *x], x, x[1:], two[1:])]
        yield i, (h, len(x), sum(c[w] > 0 for w in x), n, sum(map(math.log10, low)), sum(map(math.log10, full)))


@pytest.mark.parametrize("share", [4, 10**6])
def test_equals_brute_force(spark, table, monkeypatch, share):
    """With few contexts spread over shards, and with all of them."""
    monkeypatch.setattr(lm_scoring, "SHARE", share)
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["The", "the", "cat", "sat\ton", "é", "mat", "x" * 30], size=rng.integers(0, 40)))) for i in range(120)] + [(900, None), (901, ""), (902, "new words only")]
    got = {r.doc_id: r for r in lm_scoring.op3_lm_scoring(spark, table(rows, "doc_id long, text string")).collect()}
    for i, (held, n, known, total, base, score) in brute(rows):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert math.isclose(r.base_score, base, abs_tol=1e-9) and abs(r.score - score) < 2e-4 * n


def test_empty_table(spark, table):
    assert lm_scoring.op3_lm_scoring(spark, table([], "doc_id long, text string")).count() == 0


def test_nulls_repeats_long_texts_and_clashing_columns(spark, table):
    """Rows without an identifier and equal rows are documents of their own; the names of extra columns do not matter."""
    text = "one two three one two"
    rows = [(None, text, 1, "x")] * 30 + [(None, "other words", 1, "x"), (5, text, 2, "y"), (5, text, 2, "y"), (6, "long text " * 200_000, 3, "z"), (7, None, 4, None)]
    got = lm_scoring.op3_lm_scoring(spark, table(rows, "doc_id long, text string, block int, kind string")).collect()
    assert len(got) == len(rows)
    want = [w for _, w in brute([("" if r[0] is None else r[0], r[1]) for r in rows])]
    mine = sorted((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got)
    assert mine == sorted((*w[:4], round(w[4], 4)) for w in want)
    for a, b in zip(sorted((r.n_tokens, r.score) for r in got), sorted((w[1], w[5]) for w in want), strict=True):
        assert abs(a[1] - b[1]) < 2e-4 * a[0]


def test_elias_fano():
    rng = np.random.default_rng(6)
    for top, size in ((10, 5), (1 << 40, 2000), (300, 300), (5000, 1), (1, 0)):
        x = np.unique(rng.integers(0, top, size).astype(np.uint64))
        ef = lm_trie.EliasFano(*(lm_trie.elias_fano(x)[k] for k in ("head", "low", "high", "ones")))
        assert (ef.get(np.arange(len(x))) == x).all()
        asked = np.concatenate([x, rng.integers(0, 2 * top, 500).astype(np.uint64), np.array([0, 1 << 62], np.uint64)])
        assert (ef.successor(asked) == np.searchsorted(x, asked)).all()
        known = {int(v): i for i, v in enumerate(x)}
        assert ef.find(asked).tolist() == [known.get(int(v), -1) for v in asked]


def test_trie_round_trip():
    rng = np.random.default_rng(2)
    x = np.unique(rng.integers(0, 60, size=(4000, 3)).astype(np.uint64), axis=0)
    pairs = np.unique(rng.integers(0, 60, size=(900, 2)).astype(np.uint64), axis=0)
    p2, p3 = rng.uniform(1e-6, 1, len(pairs)), rng.uniform(1e-6, 1, len(x))
    trie = lm_trie.Trie((pairs[:, 0], pairs[:, 1], p2), (x[:, 0], x[:, 1], x[:, 2], p3), -6.0)
    asked = np.unique(np.concatenate([x, rng.integers(0, 90, size=(3000, 3)).astype(np.uint64)]), axis=0)
    two, three = ({tuple(k): q for k, q in zip(keys.tolist(), p, strict=True)} for keys, p in ((pairs, p2), (x, p3)))
    for k, q in zip(asked.tolist(), lm_trie.restore(trie.triples(*asked.T), -6.0), strict=True):
        assert math.isclose(q, three.get(tuple(k), 0), rel_tol=1e-3)
    for k, q in zip(asked.tolist(), lm_trie.restore(trie.pairs(asked[:, 0], asked[:, 1]), -6.0), strict=True):
        assert math.isclose(q, two.get(tuple(k[:2]), 0), rel_tol=1e-3)
    assert trie.bytes < 12 * (len(x) + len(pairs))
    trie.close()
    empty = lm_trie.Trie((x[:0, 0], x[:0, 0], p2[:0]), (x[:0, 0],) * 3 + (p3[:0],), -6.0)
    assert not empty.triples(*asked.T).any() and not empty.pairs(asked[:, 0], asked[:, 1]).any()
    empty.close()


def test_what_occurs_once_among_very_many_is_not_raised():
    for n in (3, 10**6, 16 * 10**12):
        low = lm_trie.least(n)
        counts = np.array([1.0, 2, 3, n])
        assert np.allclose(lm_trie.restore(lm_trie.quantise(counts / n, low), low) * n, counts, rtol=1e-3)


def test_counts_of_a_bucket_are_added_in_parts(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "MERGE", 3)
    parts = [(np.array([1, 5, 9], np.uint64), np.array([1, 1, 2], np.uint64)), (np.array([5], np.uint64), np.array([7], np.uint64))] * 4
    h, n = lm_scoring._added(parts)
    assert h.tolist() == [1, 5, 9] and n.tolist() == [4, 32, 8]
    docs = spark.createDataFrame([(f"a b{i % 7} c{i}",) for i in range(500)], "_text string").repartition(9)
    rows = lm_scoring.unigrams(docs, 3).collect()
    assert sorted(r.bucket for r in rows) == [0, 1, 2] and sum(r.n for r in rows) == 2000 and sum(r.v for r in rows) == 1 + 7 + 500 + 1
