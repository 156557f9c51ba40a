"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of word 5-grams. Equal sets form a class first, so copies are never paired. Class representatives meet in MinHash bands;
within a band bucket pairs are compared a few MinHash values at a time and dropped as soon as the posterior probability that their similarity
reaches the threshold, under a uniform prior, is below the tolerance. What is left is verified exactly on the shingle sets.
Pairs live only inside a task: rows carry, for each member, its packed partners, then its number of links and a spanning edge.
Buckets with many members are cut into blocks, and each pair of blocks is a group of its own.

Defined results: a null text is an empty one; a document without words links to nothing; one with fewer than five words is one shingle of all of
them; rows that repeat an identifier are expected to repeat its text, and count as copies; a null identifier is kept as null and its documents form classes as others do. Classes are known by a 64-bit hash of the shingle set, identifiers are only labels:
rows that share one, null among them, but not their words are apart. A label is the least identifier that is not null, and null only where all are.
Very long texts are joined whole; a similarity of exactly the threshold is a link; extra columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .cluster import NO_ID, components, durable, keyed

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 21, 3  # a pair at 0.8 shares a bucket but with probability (1 - 0.8**3)**21 < 3e-7
TOLERANCE = 1e-7
STEP = 9  # MinHash values compared before each pruning
BLOCK = 512  # members of a bucket in a block
PAIRS = 1 << 19  # pairs compared at once
_A, _B = (bs.stream(BANDS * ROWS, s).astype(np.uint32) | np.uint32(1) for s in (11, 12))


def posterior(matches: int, compared: int, threshold: float) -> float:
    """P(similarity >= threshold | matches of compared), similarity uniform on [0, 1] beforehand."""
    n = compared + 1
    return sum(comb(n, j) * threshold**j * (1 - threshold) ** (n - j) for j in range(matches + 1))


def least_matches(compared: int, threshold: float, tolerance: float) -> int:
    return next(m for m in range(compared + 1) if posterior(m, compared, threshold) >= tolerance)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes)."""
    for row, end, data, at in bs.pieces(texts):
        _, hashes, tok = bs.tokens(data, at)
        sh, out = bs.shingles(hashes, tok, words)
        for k in range(end - row):
            s = np.sort(sh[out[k] : out[k + 1]])
            yield row + k, s[np.append(True, s[1:] != s[:-1])] if len(s) else s


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """_id, text_h, set_a, set_b: two hashes of the shingle set (null without words), n: its size, sig: MinHash values."""

    def run(batches):
        for b in batches:
            rows = []
            for _, s in shingle_sets(b.column("_text"), words):
                if not len(s):
                    rows.append((None, None, 0, None))
                    continue
                low = (s >> np.uint64(32)).astype(np.uint32)
                sig = np.empty(BANDS * ROWS, np.uint32)
                for k in range(len(sig)):
                    x = low * _A[k]
                    x ^= x >> np.uint32(15)
                    sig[k] = (x * _B[k]).min()
                rows.append((int(s.sum().view(np.int64)), int(bs.mix(s + np.uint64(7)).sum().view(np.int64)), len(s), sig.tobytes()))
            a, c, n, sig = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("text_h"), pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(n, pa.int32()), pa.array(sig, pa.binary())], ["_id", "text_h", "set_a", "set_b", "n", "sig"])

    return docs.select("_id", "_text", F.xxhash64("_text").alias("text_h")).mapInArrow(run, "_id long, text_h long, set_a long, set_b long, n int, sig binary")


def grouped(batches, keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Whole groups of rows that are sorted by the keys: a batch and its group starts. Only a group at the end of a batch waits for the next."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        if rest is not None:
            b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
        new = np.zeros(b.num_rows, bool)
        new[0] = True
        for k in keys:
            v = b.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new)
        rest = b.slice(starts[-1])
        if len(starts) > 1:
            yield b.slice(0, starts[-1]), starts[:-1]
    if rest is not None:
        yield rest, np.zeros(1, np.int64)


def pairs_within(starts: np.ndarray, total: int, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs a < b of rows of the same group, a bounded number at a time; where a group has two sides, only pairs across them."""
    ends = np.append(starts[1:], total)
    later = np.repeat(ends, ends - starts) - np.arange(total) - 1
    whole = np.cumsum(later)
    row = 0
    while row < total:
        stop = max(row + 1, int(np.searchsorted(whole, (whole[row - 1] if row else 0) + PAIRS, "right")))
        n = later[row:stop]
        a = np.repeat(np.arange(row, stop), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        ok = (side[a] != side[b]) | (side[a] == 0)
        yield a[ok], b[ok]
        row = stop


def candidates(reps: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """Rows task, _id, partners: of each band bucket's block pair, the members that the pruning left, and their later partners, packed."""
    least = {k: least_matches(k, threshold, tolerance) for k in range(STEP, BANDS * ROWS + 1, STEP)}

    def bands(batches):
        for b in batches:
            data, _ = bs.buffers(b.column("sig"))
            sig = data.view(np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = bs.mix((sig * bs.stream(ROWS, 21)).sum(2, dtype=np.uint64) + bs.stream(BANDS, 22))
            ids = b.column("_id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(ids, BANDS))], ["key", "_id"])

    def prune(batches):
        for b, starts in grouped(batches, ["key", "i", "j"]):
            data, _ = bs.buffers(b.column("sig"))
            sig = data.view(np.uint32).reshape(-1, BANDS * ROWS)
            key, i, j, block, ids = (b.column(c).to_numpy() for c in ("key", "i", "j", "block", "_id"))
            side = np.where(i == j, 0, np.where(block == i, 1, 2))
            band_key = bs.mix((sig.reshape(-1, BANDS, ROWS).astype(np.uint64) * bs.stream(ROWS, 21)).sum(2, dtype=np.uint64) + bs.stream(BANDS, 22)).view(np.int64)
            mine = (band_key == key[:, None]).argmax(1)
            found = []
            for x, y in pairs_within(starts, b.num_rows, side):
                same = np.zeros(len(x), np.int16)
                for at in range(0, BANDS * ROWS, STEP):
                    same += (sig[x, at : at + STEP] == sig[y, at : at + STEP]).sum(1, dtype=np.int16)
                    ok = same >= least[at + STEP]
                    x, y, same = x[ok], y[ok], same[ok]
                first = (band_key[x] == band_key[y]).argmax(1) == mine[x] if len(x) else np.zeros(0, bool)
                found.append((x[first], y[first]))
            x, y = (np.concatenate(v) for v in zip(*found, strict=True))
            if not len(x):
                continue
            order = np.argsort(x, kind="stable")
            x, y = x[order], y[order]
            members = np.unique(np.concatenate([x, y]))
            lo, hi = np.searchsorted(x, members), np.searchsorted(x, members, "right")
            task = bs.mix(key[members].view(np.uint64) + bs.mix(i[members].astype(np.uint64) << np.uint64(32) | j[members].astype(np.uint64))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(task), pa.array(ids[members]), pa.array([ids[y[p:q]].tobytes() for p, q in zip(lo, hi, strict=True)], pa.binary())], ["task", "_id", "partners"])

    keys = reps.select("_id", "sig").mapInArrow(bands, "key long, _id long")
    shared = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    members = keys.join(shared, "key").withColumn("block", F.pmod(F.xxhash64("_id"), F.col("blocks")).cast("int"))
    members = members.select("key", "_id", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    members = members.select("key", "_id", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    whole = members.join(reps.select("_id", "sig"), "_id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return whole.mapInArrow(prune, "task long, _id long, partners binary")


def verify(cand: DataFrame, reps: DataFrame, docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """Rows _id, links, least: exact links of a class within one group, counted in documents, and the least class that they reach there.

    reps: _id (the class), m, and by doc and text_h the row of docs whose text stands for it.
    """

    def exact(batches):
        for b, starts in grouped(batches, ["task"]):
            ids, m = b.column("_id").to_numpy(), b.column("m").to_numpy()
            sets = [s for _, s in shingle_sets(b.column("_text"), words)]
            partner, at = bs.buffers(b.column("partners"))
            partner = np.frombuffer(partner.tobytes(), np.int64)
            at = at // 8
            out: list[tuple] = []
            for g, e in zip(starts, np.append(starts[1:], b.num_rows), strict=True):
                local, order = np.unique(ids[g:e], return_index=True)
                order += g
                p = np.repeat(np.arange(len(order)), at[order + 1] - at[order])
                q = np.searchsorted(local, np.concatenate([partner[at[r] : at[r + 1]] for r in order]))
                n = np.array([len(sets[r]) for r in order], np.int64)
                both = shared_counts([sets[r] for r in order], p, q)
                ok = both >= threshold * (n[p] + n[q] - both) - 1e-9
                p, q = p[ok], q[ok]
                links = np.bincount(p, m[order][q], len(order)) + np.bincount(q, m[order][p], len(order))
                low = np.arange(len(order))
                while len(p):
                    was = low.copy()
                    np.minimum.at(low, p, low[q])
                    np.minimum.at(low, q, low[p])
                    low = np.minimum(low, low[low])
                    if (was == low).all():
                        break
                linked = np.flatnonzero(links)
                out += zip(local[linked].tolist(), links[linked].astype(np.int64).tolist(), local[low[linked]].tolist(), strict=True)
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["_id", "links", "least"])

    texts = docs.select(F.col("_id").alias("doc"), F.xxhash64("_text").alias("text_h"), "_text").dropDuplicates(["doc", "text_h"])
    whole = cand.join(reps.select("_id", "m", "doc", "text_h"), "_id").join(texts, ["doc", "text_h"]).select("task", "_id", "partners", "m", "_text")
    return whole.repartition("task").sortWithinPartitions("task").mapInArrow(exact, "_id long, links long, least long")


def shared_counts(sets: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sorted sets p and q; many pairs of a group by products of 0/1 blocks."""
    if len(p) <= 4 * len(sets):
        return np.array([np.intersect1d(sets[x], sets[y], assume_unique=True).size for x, y in zip(p.tolist(), q.tolist(), strict=True)], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, index, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    few = often > 1
    index, owner = (np.cumsum(few) - 1)[index[few[index]]], owner[few[index]]
    order = np.argsort(index, kind="stable")
    index, owner = index[order], owner[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    wide = 4096
    for c in range(0, int(few.sum()), wide):
        lo, hi = np.searchsorted(index, [c, c + wide])
        block = np.zeros((len(sets), wide), np.float32)
        block[owner[lo:hi], index[lo:hi] - c] = 1
        total += block @ block.T
    return total[p, q].astype(np.int64)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: _id, copy_of (representative of its equal shingle sets), class_id (least of its linked component), n_links."""
    texts = keyed(docs, id_col, text_col)
    sigs = durable(signatures(texts, words))
    label = lambda c: F.coalesce(F.min(F.when(F.col(c) != NO_ID, F.col(c))), F.lit(NO_ID))
    classes = sigs.where("n > 0").groupBy("set_a", "set_b", "n").agg(label("_id").alias("rep"), F.min(F.struct("_id", "text_h")).alias("pick"), F.count("*").alias("m"), F.first("sig").alias("sig"))
    classes = durable(classes.withColumn("key", F.xxhash64("set_a", "set_b", "n")))
    reps = classes.select(F.col("key").alias("_id"), "m", "sig", F.col("pick._id").alias("doc"), F.col("pick.text_h").alias("text_h"))
    found = durable(verify(candidates(reps, threshold, tolerance), reps, texts, words, threshold))
    links = found.groupBy("_id").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("_id").alias("u"), F.col("least").alias("v")))
    info = classes.join(links, F.col("key") == links["_id"], "left").drop("_id").join(parts, F.col("key") == F.col("node"), "left")
    info = info.select("set_a", "set_b", "n", "rep", F.coalesce("component", "key").alias("part"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    info = info.join(info.groupBy("part").agg(label("rep").alias("component")), "part").drop("part")
    return sigs.select("_id", "set_a", "set_b", "n").join(info, ["set_a", "set_b", "n"], "left").select("_id", F.coalesce("rep", "_id").alias("copy_of"), F.coalesce("component", "_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """doc_id, class_id, copy_of, n_links over all documents."""
    out = jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(back("_id").alias("doc_id"), back("class_id").alias("class_id"), back("copy_of").alias("copy_of"), "n_links")


#: The same rows by an exact join of all shingles. Letters A-Z only are lowered, as bytes are.
SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::varchar[] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE c >= 0.8 * (nx.n + ny.n - c) - 1e-9),
r AS (SELECT doc_id AS x, doc_id AS root FROM d UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.x),
k AS (SELECT x, min(root) AS class_id FROM r GROUP BY x)
SELECT d.doc_id, class_id, coalesce((SELECT min(o.doc_id) FROM n o WHERE o.h = n.h), d.doc_id) AS copy_of, (SELECT count(*) FROM l WHERE l.x = d.doc_id) AS n_links
FROM d JOIN k ON k.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
