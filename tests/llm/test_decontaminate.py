"""Benchmark decontamination against a brute-force search, and cases that templates alone would miss."""

import random
import re
from collections import Counter

from faunaflux.llm import decontaminate
from faunaflux.llm.cluster import NO_ID, keyed


def tokens(text):
    """(lower-cased token, kind, may be a name at the head of a sentence)."""
    out, last, fresh = [], None, True
    for m in re.finditer(r"[0-9]+(?:[.,][0-9][0-9A-Za-z]*)*[A-Za-z0-9]*|[A-Za-z0-9\x80-\U0010ffff]+", text or ""):
        gap = (text or "")[last or 0 : m.start()]
        inside = last is not None and not re.search(r"[\n\r!.:;?]", gap)
        word = m[0]
        kind = 1 if word[0].isascii() and word[0].isdigit() else 3 if out and out[-1][1] == 1 and word.lower() in decontaminate.UNITS else 2 if inside and word[0].isascii() and word[0].isupper() else 0
        out.append((word.lower(), kind, kind == 0 and word[0].isascii() and word[0].isupper()))
        last = m.end()
    return out


def windows(text):
    """(words as they are, {(template, slots)}) of each window."""
    t = tokens(text)
    rows = []
    for k in range(max(1, len(t) - 4) if t else 0):
        part = t[k : k + 5]
        forms = set()
        for led in (False, True):
            kinds = [2 if led and lead else kind for _, kind, lead in part]
            if len(part) == 5 and sum(x == 0 for x in kinds) >= 2 and any(kinds):
                forms.add((tuple(w if not x else x for (w, _, _), x in zip(part, kinds)), tuple(w for (w, _, _), x in zip(part, kinds) if x)))
        rows.append((tuple(w for w, _, _ in part), forms))
    return rows


def brute(docs, items):
    out = set()
    for i, text in set(docs):
        mine = windows(text)
        words = [w for w, _, _ in tokens(text)]
        plain, forms = {w for w, _ in mine}, {}
        for _, fs in mine:
            for template, slots in fs:
                forms.setdefault(template, set()).add(slots)
        for j, item in set(items):
            rows = windows(item)
            whole = {w for w, _ in rows}
            if not whole:
                continue
            short = next(iter(whole)) if len(rows[0][0]) < 5 else None
            if short is not None:
                if any(tuple(words[k : k + len(short)]) == short for k in range(len(words))):
                    out.add((i, j))
                continue
            good, found, votes = whole & plain, {(w, f, s, d) for w, fs in rows for f, s in fs for d in forms.get(f, ())}, {}
            for _, _, s, d in found:
                for a, b in zip(s, d):
                    votes.setdefault(a, Counter())[b] += 1
            best = {a: {b for b in c if c[b] == max(c.values())} for a, c in votes.items()}
            best = {a: a if a in bs else min(bs) for a, bs in best.items()}
            good = good | {w for w, _, s, d in found if all(best[a] == b for a, b in zip(s, d))}
            if len(good) >= 0.8 * len(whole) - 1e-9:
                out.add((i, j))
    return out


def found(spark, docs, items):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    back = lambda x: None if x == NO_ID else x
    return [(back(r["_id"]), back(r["item"])) for r in decontaminate.find_items(keyed(d), keyed(b, "item_id")).collect()]


QUESTION = "Anna has {} apples and gives {} kg of them to Bob for {} dollars. Carol then takes {} apples from Anna. How many apples are left for Anna?"


def test_equals_brute_force(spark):
    random.seed(5)
    words = ["red", "Blue", "box", "ball", "the", "Then", "of", "km", "kg", "7", "12", "3,5", "Anna", "Bob"]
    say = lambda n: " ".join(random.choice(words) + random.choice(["", "", "", "", "."]) for _ in range(n))
    items = [(k, say(random.randint(5, 14))) for k in range(12)] + [(50, QUESTION.format(12, 3, 36, 4)), (51, "red Ball"), (52, "Zebra"), (53, None), (54, "!?"), (None, say(9)), (None, say(8)), (60, say(8)), (60, say(9))]
    texts = [t for _, t in items if t]
    docs = [(k, say(random.randint(0, 30)) + " " + random.choice(texts) + " " + say(random.randint(0, 30))) for k in range(60)]
    change = lambda t: re.sub(r"\b(7|12|Anna)\b", lambda m: {"7": "9", "12": "15", "Anna": "Zoe"}[m[0]], t)
    docs += [(100 + k, say(5) + ". " + change(random.choice(texts)) + ". " + say(5)) for k in range(60)] + [(None, t) for t in texts[:4]] + [(300, None), (301, "")]
    got = found(spark, docs, items)
    assert sorted(set(got), key=repr) == sorted(brute(docs, items), key=repr) and len(set(got)) > 60


def test_values_names_and_case(spark):
    item = QUESTION.format(12, 3, 36, 4)
    docs = [(1, "Intro. " + QUESTION.format(40, 5, 200, 9)), (2, "Intro. " + QUESTION.format(40, 5, 200, 9).replace("Anna", "Zoe").replace("Carol", "Max")), (3, item.lower()), (4, item.upper()), (5, "apples are left for Anna and Bob has 3 kg of them")]
    assert sorted(found(spark, docs, [(1, item)])) == [(1, 1), (2, 1), (3, 1), (4, 1)]


def test_windows_without_words_and_short_items(spark):
    sums, names = "12 + 30 = 42, 7 * 6 = 42, 9 - 2 = 7", "Anna Bob Carol Dave Eve Frank"
    docs = [(1, "so " + sums + " it is"), (2, "and " + names), (3, "13 + 31 = 44, 8 * 6 = 48, 9 - 3 = 6"), (4, "here is a tiny item in a text"), (5, "tiny and item")]
    assert sorted(found(spark, docs, [(1, sums), (2, names), (3, "Tiny item")])) == [(1, 1), (2, 2), (4, 3)]


def test_identifiers(spark):
    """Items and documents that share an identifier, or have none, keep their own results."""
    a, b, c = ("one two three four five six " + x for x in ("alpha beta gamma delta eta", "kappa mu nu xi pi rho tau", "do re mi fa so la ti"))
    docs = [(1, a), (1, b), (None, a), (None, c), (None, c)]
    items = [(7, a), (7, b), (None, c), (None, c), (8, a), (8, a)]
    assert sorted(found(spark, docs, items), key=repr) == sorted([(1, 7), (1, 8), (1, 7), (None, 7), (None, 8), (None, None)], key=repr)


def test_long_text_with_clashing_columns(spark, tmp_path):
    item = QUESTION.format(12, 3, 36, 4)
    text = "word " * 700_000 + item + " other" * 100_000
    d = spark.createDataFrame([(1, text, "x", 5), (2, "", "y", 6)], "doc_id long, text string, h string, _doc int")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, item, "z", 1)], "item_id long, text string, item string, n int").write.parquet(f"{tmp_path}/benchmark.parquet")
    (row,) = decontaminate.op5_decontaminate(spark, str(tmp_path)).collect()
    assert (row.doc_id, row.item_id, row.n_found) == (1, 9, row.n_windows)
