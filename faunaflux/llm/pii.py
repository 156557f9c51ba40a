"""Personal data by weak supervision, with DataFrame operations only.

Strict patterns give the base spans, which always stay. Wider patterns propose more candidates of the same kinds, and strict matches that fail a check are
candidates as well. Four labelers vote on every candidate: the form (it passes the checks of its kind, read without its disguise, or fails them), a gazetteer (top-level
domains, issuer prefixes, reserved addresses), the words around it, and its edges. Votes are counted by pattern, so the driver sees at most
4 x 162 x 8 counts whatever the corpus; expectation-maximisation over those counts estimates each labeler's reliability by kind, beginning at ONSET and smoothed by
STRENGTH candidates. A logistic regression on the votes and on features of the span and its context, trained on the posteriors, is the span classifier: it alone decides which
candidates are added, wide ones and failed strict ones alike.

Spans are code points, end exclusive. Every regular expression is possessive, so that it runs in linear time and without recursion on very long texts;
spans that overlap are found in order of their starts, in time of n**1.5 at most.

Defined results: null and empty texts have no span; rows are judged one by one and repeated rows repeat their result; a null identifier stays null;
an added span never overlaps a base span, and of added spans that overlap the one that starts first stays (then the shorter, then the kind listed first); a posterior of exactly the
bound is added; extra columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import durable

KINDS = ("email", "ip", "card", "phone")

#: The strict forms. A match can't begin inside a run that a search from its start has seen fail, hence the look-behind; \G is the end of the last match.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider forms.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)| at |\{at\}) ?[A-Za-z0-9-]++ ?(?:\[dot\]|\(dot\)| dot |\{dot\}) ?[A-Za-z]{2,24}+",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./_]|[ -]{2,3})[0-9]{4}(?:[./_]|[ -]{2,3})[0-9]{4}(?:[./_]|[ -]{2,3})[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
}
#: Words before a candidate that speak for its kind, or against all kinds.
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|address)\W*+(?:\w++\W++){0,2}$",
    "ip": r"(?i)(?:\bip\b|address|host|server|login|client)\W*+(?:\w++\W++){0,2}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|payment)\W*+(?:\w++\W++){0,2}$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|contact)\W*+(?:\w++\W++){0,2}$",
}
AGAINST = r"(?i)(?:version|order|invoice|serial|isbn|section|token|hash|build|rev|part no|id|no)\W*+$|[=#$€£/_]$"
#: Gazetteers, as patterns on the span.
KNOWN = {
    "email": r"(?i)(?:\.|dot[\])} ]+)(?:com|org|net|edu|gov|io|info|biz|de|fr|es|uk|eu|it|nl|ch|at|us|ca|au|jp|cn|ru|in|br)$",
    "ip": r"^(?!0\.|127\.|255\.|22[4-9]\.|23[0-9]\.)[0-9A-Fa-f]",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^(?:\+[1-9]|\(?[2-9])",
}
CHUNK = 64
#: Probabilities of the votes against, none and for, of the four labelers, for what is no personal data and for what is: where estimation begins.
ONSET = (
    ((0.80, 0.15, 0.05), (0.01, 0.19, 0.80)),
    ((0.40, 0.20, 0.40), (0.15, 0.15, 0.70)),
    ((0.15, 0.80, 0.05), (0.02, 0.58, 0.40)),
    ((0.30, 0.30, 0.40), (0.10, 0.20, 0.70)),
)
STRENGTH = 8  # candidates that the beginning counts for, however many there are
LOOKS = 8  # combinations of three features of span and context


def _offsets(lengths: Column) -> Column:
    """Sums of the elements before each, in time linear in their number but for (n / CHUNK)**2 copies."""
    n = F.size(lengths)
    add = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda c: add(F.slice(lengths, c * CHUNK + 1, CHUNK)))
    heads = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return F.struct(lengths.alias("n"), heads.alias("heads"))


def _start(offsets: Column, i: Column) -> Column:
    inside = F.slice(offsets["n"], i - i % CHUNK + 1, i % CHUNK)
    return F.get(offsets["heads"], F.floor(i / CHUNK).cast("int")) + F.aggregate(inside, F.lit(0), lambda x, y: x + y)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    d = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) % 10 + F.floor(x.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _checks(kind: str, span: Column) -> Column:
    """Whether a strict match is personal data."""
    if kind == "ip":
        return F.forall(F.split(span, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.concat(F.lit("0"), F.substring(F.ltrim(p, F.lit("0")), 1, 3)).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(span)).between(16, 19) & _luhn(_digits(span))
    if kind == "phone":
        return F.length(_digits(span)).between(8, 15)
    return F.lit(True)


def _plain(kind: str, span: Column) -> tuple[Column, Column]:
    """Whether a wide match passes or fails the checks of its kind once its disguise is off."""
    if kind == "email":
        bare = F.regexp_replace(F.regexp_replace(span, r" ?(?:\[at\]|\(at\)| at |\{at\}) ?", "@"), r" ?(?:\[dot\]|\(dot\)| dot |\{dot\}) ?", ".")
        good = bare.rlike(r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$")
    elif kind == "ip":
        good = span.rlike("[1-9A-Fa-f]")
    elif kind == "card":
        good = _luhn(_digits(span))
    else:
        good = _digits(span).rlike("^[2-9][0-9]{2}[2-9]")
    return good, ~good


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 2).when(no, 0).otherwise(1)


def _candidates(df: DataFrame, name: str, kind: str, pattern: str, gate: Column, strict: bool) -> DataFrame:
    """Adds column name: array of structs k (kind), s, e, base, code (the votes, each 0 against, 1 none, 2 for, and whether it is wide), look (features). Empty where the gate is shut."""
    number = KINDS.index(kind)
    df = df.withColumn("__m", F.when(gate, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))))
    df = df.withColumn("__m", F.when(F.size("__m") > 0, F.col("__m")))
    df = df.withColumn("__g", F.when(F.col("__m").isNotNull(), F.split("_text", pattern, -1)))
    df = df.withColumn("__o", F.when(F.col("__m").isNotNull(), _offsets(F.zip_with(F.transform("__g", F.length), F.transform("__m", F.length), lambda a, b: a + F.coalesce(b, F.lit(0))))))

    def one(m, i):
        before, after = F.right(F.get("__g", i), F.lit(40)), F.left(F.get("__g", i + 1), F.lit(2))
        start = _start(F.col("__o"), i) + F.length(F.get("__g", i))
        good = _checks(kind, m) if strict else F.lit(False)
        bare = F.regexp_replace(m, r"[ ._/-]", "") if kind == "card" else m
        votes = [
            _vote(good, ~good) if strict else _vote(*_plain(kind, m)),
            _vote(bare.rlike(KNOWN[kind]), ~bare.rlike(KNOWN[kind])),
            _vote(before.rlike(CUES[kind]), before.rlike(AGAINST)),
            _vote(before.rlike(r"[\s(:<]$|^$") & after.rlike(r"^[\s).,;:!?>]|^$"), before.rlike(r"[A-Za-z0-9]$") | after.rlike(r"^[A-Za-z0-9]")),
        ]
        code = F.lit(0 if strict else 1)
        for v in votes:
            code = code * 3 + v
        look = F.lit(0)
        for feature in (m.rlike(r"[ ().-]"), before.rlike(r"[:=]\s?$"), before.rlike(r"(?:^|\n)$") | after.rlike(r"^(?:\n|$)")):
            look = look * 2 + feature.cast("int")
        return F.struct(F.lit(number).alias("k"), start.cast("int").alias("s"), (start + F.length(m)).cast("int").alias("e"), good.alias("base"), code.cast("int").alias("code"), look.cast("int").alias("look"))

    df = df.withColumn(name, F.coalesce(F.transform("__m", one), F.array().cast(_SPANS)))
    return df.drop("__m", "__g", "__o")


_SPANS = "array<struct<k:int,s:int,e:int,base:boolean,code:int,look:int>>"
_ORDERED = "array<struct<s:int,later:boolean,e:int,k:int,base:boolean,code:int,look:int>>"


def _scan(df: DataFrame, column: str, onset: int, keep, after_kept, after_left) -> DataFrame:
    """df with those of the spans of a column, in order, for which keep(state so far, span) holds; the other two give the next state. In pieces, as an array that grows is copied."""

    def step(acc, x):
        kept = F.struct(F.concat(acc["kept"], F.array(x)).alias("kept"), after_kept(acc["last"], x).cast("int").alias("last"))
        left = F.struct(acc["kept"].alias("kept"), after_left(acc["last"], x).cast("int").alias("last"))
        return F.when(keep(acc["last"], x), kept).otherwise(left)

    def piece(acc, xs):
        onset = F.struct(F.array().cast(_ORDERED).alias("kept"), acc["last"].alias("last"))
        return F.aggregate(xs, onset, step, lambda done: F.struct(F.concat(acc["kept"], F.array(done["kept"])).alias("kept"), done["last"].alias("last")))

    n = F.size(column)
    pieces = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda c: F.slice(column, c * CHUNK + 1, CHUNK))
    whole = F.aggregate(pieces, F.struct(F.array().cast(f"array<{_ORDERED}>").alias("kept"), F.lit(onset).alias("last")), piece, lambda acc: F.flatten(acc["kept"]))
    return df.withColumn(column, F.when(n > 0, whole).otherwise(F.col(column)))


def _ordered(spans: Column) -> Column:
    """By start; at one place base spans come first, then shorter ones, then by kind."""
    return F.array_sort(F.transform(spans, lambda c: F.struct(c["s"].alias("s"), (~c["base"]).alias("later"), c["e"].alias("e"), c["k"].alias("k"), c["base"].alias("base"), c["code"].alias("code"), c["look"].alias("look"))))


def _apart(df: DataFrame, column: str) -> DataFrame:
    """df with the spans of a column in order, without base spans, those that overlap one, and those that overlap one that stays before them."""
    df = df.withColumn(column, _ordered(F.col(column)))
    # a base span before it ends later than it starts, or one after it starts before it ends
    df = _scan(df, column, 0, lambda last, x: x["base"] | (x["s"] >= last), lambda last, x: F.when(x["base"], F.greatest(last, x["e"])).otherwise(last), lambda last, x: last)
    df = df.withColumn(column, F.reverse(column))
    df = _scan(df, column, 2**31 - 1, lambda last, x: x["base"] | (x["e"] <= last), lambda last, x: F.when(x["base"], F.least(last, x["s"])).otherwise(last), lambda last, x: last)
    df = df.withColumn(column, F.filter(F.reverse(column), lambda c: ~c["base"]))
    return _scan(df, column, 0, lambda last, x: x["s"] >= last, lambda last, x: x["e"], lambda last, x: last)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, spans: base spans and other candidates of each row, by kind and start."""
    df = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    df = df.withColumn("_digit", F.col("_text").rlike("[0-9]"))
    gates = {"email": F.contains("_text", F.lit("@")), "ip": F.col("_digit") & F.col("_text").rlike(r"[0-9]\.[0-9]++\.[0-9]"), "card": F.col("_digit") & F.col("_text").rlike(r"(?:[0-9][\x20-]?+){15}[0-9]"), "phone": F.col("_digit") & F.contains("_text", F.lit("+"))}
    wide = {"email": F.contains("_text", F.lit("dot")) & F.contains("_text", F.lit("at")), "ip": F.col("_text").rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"), "card": F.col("_digit") & F.col("_text").rlike(r"[0-9]{4}(?:[./_]|[ -]{2,3})[0-9]{4}"), "phone": F.col("_digit") & F.col("_text").rlike(r"[0-9]{3}[ .-][0-9]{4}")}
    for kind in KINDS:
        df = _candidates(df, f"s_{kind}", kind, STRICT[kind], gates[kind], True)
        df = _candidates(df, f"w_{kind}", kind, WIDE[kind], wide[kind], False)
    base = F.filter(F.concat(*[F.col(f"s_{k}") for k in KINDS]), lambda c: c["base"])
    other = F.filter(F.concat(*[F.col(f"{x}_{k}") for k in KINDS for x in "sw"]), lambda c: ~c["base"])
    return df.select("_id", base.alias("base"), other.alias("other"))


def reliabilities(counts: dict[tuple[int, int], int], rounds: int = 50) -> dict[tuple[int, int], float]:
    """EM over counts of (kind, code): the probability that a candidate with these votes is personal data. Labelers err independently given the truth."""
    out = {}
    for kind in {k for k, _ in counts}:
        rows = [(code, [code // 3**j % 3 for j in (3, 2, 1, 0)], n) for (k, code), n in counts.items() if k == kind]
        prior, table = 0.5, [[list(w) for w in onset] for onset in ONSET]
        for _ in range(rounds):
            post = []
            for _, votes, _ in rows:
                odds = math.log(prior) - math.log(1 - prior) + sum(math.log(table[j][1][v]) - math.log(table[j][0][v]) for j, v in enumerate(votes))
                post.append(1 / (1 + math.exp(-max(-50, min(50, odds)))))
            total = sum(n for *_, n in rows)
            prior = (STRENGTH / 2 + sum(p * n for p, (*_, n) in zip(post, rows, strict=True))) / (STRENGTH + total)
            for j in range(4):
                for y in (0, 1):
                    seen = [STRENGTH * w for w in ONSET[j][y]]
                    for p, (_, votes, n) in zip(post, rows, strict=True):
                        seen[votes[j]] += n * (p if y else 1 - p)
                    table[j][y] = [x / sum(seen) for x in seen]
        out |= {(kind, code): p for p, (code, _, _) in zip(post, rows, strict=True)}
    return out


def classifier(counts: dict[tuple[int, int, int], int], truth: dict[tuple[int, int], float], rounds: int = 400, step: float = 2.0, shrink: float = 1e-3) -> dict[tuple[int, int, int], float]:
    """Logistic regression of kind, form, votes for and against by labeler, and looks, with soft labels, by gradient steps over the counted patterns (kind, code, look): probability of each pattern.

    Each kind counts as much as another, however many candidates it has.
    """

    def features(kind: int, code: int, look: int) -> list[float]:
        votes = [code // 3**j % 3 for j in (3, 2, 1, 0)]
        return [*[float(kind == k) for k in range(len(KINDS))], float(code >= 81), *[float(v == 2) for v in votes], *[float(v == 0) for v in votes], *[float(look >> k & 1) for k in range(3)]]

    x = {p: features(*p) for p in counts}
    of_kind = [sum(n for (k, *_), n in counts.items() if k == kind) for kind in range(len(KINDS))]
    share = {p: n / of_kind[p[0]] / sum(1 for t in of_kind if t) for p, n in counts.items()}
    w = [0.0] * (len(KINDS) + 12)
    score = lambda f: 1 / (1 + math.exp(-max(-50.0, min(50.0, sum(a * b for a, b in zip(w, f, strict=True))))))
    for _ in range(rounds):
        grad = [shrink * a for a in w]
        for p, n in share.items():
            d = (score(x[p]) - truth[p[:2]]) * n
            grad = [g + d * f for g, f in zip(grad, x[p], strict=True)]
        w = [a - step * g for a, g in zip(w, grad, strict=True)]
    return {p: score(f) for p, f in x.items()}


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """_id, base, added: arrays of structs k (place in KINDS), s, e for each row of docs; the span classifier must give an added span at least this probability."""
    found = durable(candidates(docs, id_col, text_col))
    voted = found.select(F.explode(F.concat("base", "other")).alias("c")).groupBy("c.k", "c.code", "c.look").agg(F.count("*").alias("n")).collect()  # at most 4 kinds x 162 patterns x 8 looks
    counts = {(r.k, r.code, r.look): r.n for r in sorted(voted, key=lambda r: (r.k, r.code, r.look))}
    by_votes: dict[tuple[int, int], int] = {}
    for (k, code, _), n in counts.items():
        by_votes[k, code] = by_votes.get((k, code), 0) + n
    chosen = classifier(counts, reliabilities(by_votes))
    keys = sorted((k * 1000 + code) * LOOKS + look for (k, code, look), p in chosen.items() if p >= least)
    ok = F.array(*[F.lit(x) for x in keys]) if keys else F.array().cast("array<int>")
    picked = F.filter("other", lambda c: F.array_contains(ok, (c["k"] * 1000 + c["code"]) * LOOKS + c["look"]))
    found = found.withColumn("picked", F.when(F.size("other") > 0, picked).otherwise(F.col("other")))
    # where nothing was picked there is nothing to set apart
    found = _apart(found.withColumn("added", F.when(F.size("picked") > 0, F.concat("base", "picked")).otherwise(F.col("picked"))), "added")
    return found.select("_id", "base", "added")


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(kinds, c["k"]), c["s"].cast("string"), c["e"].cast("string"))), ",")


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added), n_added over all documents."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = lambda k: F.size(F.filter("base", lambda c: c["k"] == k)).cast("long")
    n = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    slim = lambda spans: F.transform(spans, lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e")))
    every = F.array_sort(F.concat(slim("base"), slim("added")))
    return found.select(F.col("_id").alias("doc_id"), *n, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"), F.size("added").cast("long").alias("n_added"))
