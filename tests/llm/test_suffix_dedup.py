import hashlib
import random

import numpy as np
import pytest

from faunaflux.llm import bwt, suffix_dedup


def brute(rows):
    first = {}
    for d, t in rows:
        x = (t or "").encode()
        for k in range(len(x) - 49):
            w = x[k : k + 50]
            first[w] = min(d, first.get(w, d))
    out = []
    for d, t in rows:
        x = (t or "").encode()
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - 49):
            if first[x[k : k + 50]] < d:
                gone[k : k + 50] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out.append((d, len(x), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def passages(n=50, seed=3):
    random.seed(seed)
    base = "".join(random.choice("ab ") for _ in range(3000))
    rows = []
    for i in range(n):
        t = ""
        for _ in range(random.randint(0, 5)):
            a = random.randint(0, 2900)
            t += base[a : a + random.randint(20, 150)] + "".join(random.choice("abc é") for _ in range(random.randint(0, 40)))
        rows.append((i * 3, t))
    return [*rows, (500, None), (501, ""), (502, "a" * 300), (503, "a" * 120), (504, "x" * 49), (505, "x" * 49), (506, "a" * 300)]


@pytest.mark.parametrize("hot", [20_000, 2])
def test_equals_brute_force(spark, table, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)  # with 2, shared anchors are cut into single strings
    rows = passages()
    got = sorted(tuple(r) for r in suffix_dedup.op2_suffix_dedup(spark, table(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_long_documents_and_repeated_identifiers(spark, table):
    random.seed(5)
    long = "".join(random.choice("abcdefgh ") for _ in range(1_300_000))
    rows = [(1, long[1_000_000:1_200_000]), (2, long), (2, long[:70]), (None, long[:90])]
    got = {(r.doc_id, r.n_bytes): r for r in suffix_dedup.op2_suffix_dedup(spark, table(rows, "doc_id long, text string")).collect()}
    assert got[2, len(long)].n_removed == 200_000 and got[2, len(long)].n_spans == 1
    assert got[1, 200_000].n_removed == got[2, 70].n_removed == got[None, 90].n_removed == 0


def test_empty_table(spark, table):
    assert suffix_dedup.op2_suffix_dedup(spark, table([], "doc_id long, text string")).count() == 0


def test_transform_and_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(60):
        m, width = rng.integers(1, 8), rng.integers(1, 12)
        n = rng.integers(1, width + 1, size=m)
        texts = [bytes(rng.integers(97, 99, size=k).astype(np.uint8)) for k in n]
        s = np.zeros((m, width), np.uint8)
        for i, x in enumerate(texts):
            s[i, width - len(x) :] = np.frombuffer(x, np.uint8)
        transform, prefix = bwt.build(s, n, 50)
        at = {int(p[i]): texts[i][n[i] - k :] for k, p in bwt.places(transform, m, n, 1).items() for i in range(m) if p[i] >= 0} | {i: b"" for i in range(m)}
        seq = [at[k] for k in range(len(transform))]
        assert seq == sorted(seq)
        common = [0] + [next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y))) for x, y in zip(seq, seq[1:], strict=False)]
        assert common == prefix.tolist()


def test_strings_that_are_alone_with_their_anchor_are_not_sorted(monkeypatch):
    """Copies are one string; only what differs and shares an anchor is sorted, and answers are those of all pairs."""
    random.seed(8)
    letters = [bytes(random.choice(b"abcdefgh") for _ in range(76)) for _ in range(300)]
    texts = letters + letters[:200] + [x[:60] for x in letters[:50]] + [x[5:-3] + b"\xc3\xa9!" for x in letters[100:110]]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(x) for x in texts])
    start, count, anchor, piece = suffix_dedup.segments(data, at)
    size, docs = count + 49, np.searchsorted(at, start, "right")[::-1].copy()
    cut = [data[s : s + n].tobytes() for s, n in zip(start, size, strict=True)]
    sorted_, least_documents = [], suffix_dedup.least_documents
    monkeypatch.setattr(suffix_dedup, "least_documents", lambda strings, *more: sorted_.append(len(strings)) or least_documents(strings, *more))
    monkeypatch.setattr(suffix_dedup, "COLLECTION", 16)
    rank, runs, place, best = suffix_dedup.bucket_answers(np.frombuffer(b"".join(cut), np.uint8), size, anchor, docs, piece - start)
    held = {}
    for x, h in zip(cut, anchor.tolist(), strict=True):
        held.setdefault(h, set()).add(x)
    assert 0 < sum(sorted_) == sum(len(x) for x in held.values() if len(x) > 1) < len(set(cut))
    first = {}
    for x, d in zip(cut, docs, strict=True):
        for k in range(len(x) - 49):
            first[x[k : k + 50]] = min(d, first.get(x[k : k + 50], d))
    begin = np.cumsum(runs) - runs
    for x, r in zip(cut, rank, strict=True):
        ends = [*place[begin[r] + 1 : begin[r] + runs[r]], len(x) - 49]
        got = [d for p, q, d in zip(place[begin[r] :], ends, best[begin[r] :], strict=False) for _ in range(p, q)]
        assert got == [first[x[k : k + 50]] for k in range(len(x) - 49)]


def test_documents_longer_than_what_is_scanned_at_once(monkeypatch):
    """Each string starts in exactly one segment and has the same anchor, however documents are cut for scanning."""
    random.seed(9)
    data = np.frombuffer(bytes(random.choice(b"ab ") for _ in range(40_000)), np.uint8)
    at = np.array([0, 30_000, 30_049, 30_049, 30_100, 40_000])
    seen = []
    for chunk in (256, 5_000, 1 << 20):
        monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
        seen.append(sorted((int(s) + k, int(p)) for s, n, _, p in zip(*suffix_dedup.segments(data, at), strict=True) for k in range(n)))
    assert seen[0] == seen[1] == seen[2]
    assert [s for s, _ in seen[0]] == [s for a, b in zip(at, at[1:], strict=False) for s in range(a, b - 49)]
