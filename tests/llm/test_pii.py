import hashlib
import random
import re

from faunaflux.llm import pii

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in twice) % 10 == 0


def base_spans(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_equal_brute_force(spark, table):
    random.seed(1)
    texts = ["a@b.c@d.e_x@f.g a.b@c.d", "1.2.3.4.5.6.7.8", "000255.1.1.00001 999.1.1.1", "4111 1111 1111 1111 2", "4111-1111-1111-1111", "+1 (234) 555-0000) +12", "é😀 a@b.co 1.1.1.1", None, "", "a" * 50000, "1" * 50000 + " x@y.z", "+1" + "(" * 20000, "a@" * 20000, "1." * 20000, "x@y.zz " * 700]
    texts += ["".join(random.choice("a1@.+- ()2é:") for _ in range(60)) for _ in range(800)]
    d = table([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = pii.op1_pii(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in RULES]
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_method_adds_what_the_words_around_support_and_not_failed_checks(spark, table):
    good = ["call me at (212) 555-1234 now", "mail john [at] example [dot] com please"] * 5
    plain = ["number 4465758382 and 47853805923", "999.1.1.1", "card 4111 1111 1111 1112", "no data here"] * 5
    d = table([(i, t) for i, t in enumerate(good + plain)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.op1_pii(spark, d).collect()}
    assert all(rows[i].n_added == 1 for i in range(len(good)))
    assert all(rows[i].spans == "" for i in range(len(good), len(good + plain)))


def test_empty_table_and_clashing_columns(spark, table):
    assert pii.op1_pii(spark, table([], "doc_id long, text string, base string, spans int, s_email int")).count() == 0
    d = table([(None, "a@b.cc", "x", 1, 2)], "doc_id long, text string, base string, spans int, s_email int")
    (row,) = pii.op1_pii(spark, d).collect()
    assert row.doc_id is None and row.spans == "email:0:6"


def test_reliabilities_trust_agreeing_labelers():
    agree, against = sum(2 * 3**j for j in range(4)), 0
    p = pii.reliabilities({(0, agree): 50, (0, against): 50})
    assert p[0, agree] > 0.9 and p[0, against] < 0.1


def planted(n):
    """Texts, with the spans that are personal data in disguise, and look-alikes that are not."""
    random.seed(3)
    rows = []
    word = lambda k: " ".join(random.choice(["lorem", "ipsum", "dolor", "sit", "amet", "sed"]) for _ in range(k))
    digits = lambda k: "".join(random.choice("0123456789") for _ in range(k))
    for i in range(n):
        lead, kind = word(random.randint(1, 9)), i % 8
        if kind == 0:
            good, span = "email", f"user{i} [at] mail{i % 9} [dot] com"
        elif kind == 1:
            good, span = "phone", f"({random.randint(200, 999)}) {random.randint(200, 999)}-{digits(4)}"
        elif kind == 2:
            c = "4" + digits(14)
            c += next(x for x in "0123456789" if luhn(c + x))
            good, span = "card", "/".join(c[k : k + 4] for k in range(0, 16, 4))
        elif kind == 3:
            good, span = "ip", ":".join(f"{random.randint(4096, 65535):x}" for _ in range(8))
        elif kind == 4:
            c = "9" + digits(14)
            good, span = None, c + next(x for x in "0123456789" if not luhn(c + x))
        elif kind == 5:
            good, span = None, f"{random.randint(300, 999)}.{random.randint(256, 999)}.1.1"
        elif kind == 6:
            c = "9" + digits(14)
            c += next(x for x in "0123456789" if not luhn(c + x))
            good, span = None, "/".join(c[k : k + 4] for k in range(0, 16, 4))
        else:
            good, span = None, f"100-{random.randint(0, 1)}{digits(2)}-{digits(4)}"
        cue = random.random() < 0.5
        lead += {"email": " write to", "phone": " please call", "card": " pay by card", "ip": " the server"}.get(good, " order no") if cue else ""
        rows.append((i, f"{lead} {span} {word(5)}", f"{good}:{len(lead) + 1}:{len(lead) + 1 + len(span)}" if good else None))
    return rows


def test_precision_and_recall_of_disguised_data(spark, tmp_path):
    """Planted in the documents of the gate's tables; base spans stay as they are."""
    from pyspark.sql import functions as F

    rows = planted(400)
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = real.withColumn("doc_id", F.col("doc_id") + 10_000).unionByName(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pii.op1_pii(spark, str(tmp_path)).collect()}
    want = {(i, s) for i, _, s in rows if s}
    added = {(i, s) for i, t, _ in rows for s in set(got[i].spans.split(",")) - set(base_spans(t)) - {""}}
    assert len(added & want) >= 0.95 * len(want) and len(added & want) >= 0.95 * len(added), (len(added), len(want), len(added & want))
    for r in real.collect():
        base = base_spans(r.text or "")
        assert got[r.doc_id + 10_000].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(got[r.doc_id + 10_000].spans.split(",")) | {""}


def test_overlapping_candidates(spark):
    """Against brute force: what overlaps a base span goes, and of a chain only what overlaps a span that stays."""
    random.seed(8)
    rows = []
    for i in range(300):
        spans = []
        for _ in range(random.randint(0, 200 if i < 20 else 9)):
            s = random.randrange(0, 400)
            spans.append((random.randrange(4), s, s + random.randint(1, 30), random.random() < 0.3, 1, 0))
        rows.append((i, spans))
    t = spark.createDataFrame(rows, f"i int, spans {pii._SPANS}")
    got = {r.i: [tuple(x) for x in r.spans] for r in pii._apart(t, "spans").collect()}
    for i, spans in rows:
        base = [x for x in spans if x[3]]
        last, want = 0, []
        for k, s, e, b, c, look in sorted((x for x in spans if not x[3] and not any(y[1] < x[2] and x[1] < y[2] for y in base)), key=lambda x: (x[1], x[2], x[0])):
            if s >= last:
                want.append((s, True, e, k, b, c, look))
                last = e
        assert got[i] == want


def test_repeated_rows_repeat_and_long_texts_end(spark, table):
    d = table([(1, "write to ann [at] mail [dot] com"), (1, "write to ann [at] mail [dot] com"), (None, "write to ann [at] mail [dot] com"), (2, "(212) 555-1234 " * 20_000)], "doc_id long, text string")
    got = pii.op1_pii(spark, d).collect()
    assert len({r.spans for r in got if r.doc_id != 2}) == 1
    assert next(r for r in got if r.doc_id == 2).n_added == 20_000
