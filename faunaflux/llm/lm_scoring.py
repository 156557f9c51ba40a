"""Language-model scores of whole documents by a sharded Elias-Fano trigram trie.

Unigram counts are summed within tasks and then by bucket. Documents are dealt into blocks of bounded size; a block asks, once for each distinct token, the
bucket that owns it for its number (frequent tokens have small ones) and count, and, once for each distinct pair and triple, the trie shard of its context for a quantised
joint probability. Shards are built from the pairs and triples that the blocks send, in the task that answers them, in a memory-mapped file that goes with the task: a lost executor costs a rerun, nothing else.
Everything travels as packed arrays, one row for each block and bucket. A context that is more frequent than a share of a bucket is dealt to shards by the word that follows, too, so no shard gets
the whole of a frequent word or pair.

p(w | u v) = (c(u v w) + MU p(w | v)) / (c(u v) + MU), p(w | v) = (c(v w) + MU p(w)) / (c(v) + MU), p(w) = (c(w) + 1) / (N + V + 1). The first word follows an end, the second
one an end and the first.

Defined results: a null text is an empty one and has one token, the end; a null identifier counts as the empty text for the held-out fold; repeated
rows are documents of their own, in training too, and share no block for being alike; very long texts are scored whole; extra columns are not read, whatever their names;
an empty table gives an empty result. Tokens are known by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .cluster import durable, keyed, partitions, real_id, rowed
from .language_id import fold
from .lm_trie import Trie, least, restore
from .packing import narrow, pack, pack_sorted, unpack, unpack_sorted

BLOCK_BYTES = 8 << 20
END = np.uint64(0x5E0FD0C5E0FD0C55)
MU = 4.0  # weight of the shorter context
MERGE = 1 << 20  # tokens of a bucket that wait to be added up
SHARE = 4  # a context that is more frequent than a bucket's share over this is spread
_SPREAD = bs.stream(3, 61)


def _stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, each row closed by an end, and n + 1 offsets."""
    parts, sizes = [], []
    for _, _, data, at in bs.pieces(texts):
        _, h, tok = bs.tokens(data, at)
        parts.append(np.insert(h, tok[1:], END))
        sizes.append(np.diff(tok) + 1)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], *[np.cumsum(s) for s in [np.concatenate(sizes)]]]) if sizes else np.zeros(1, np.int64)


def _by_bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by bucket (then as given), the buckets that occur and where each begins."""
    b = (h % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    some, first = np.unique(b[order], return_index=True)
    return order, some, np.append(first, len(h))


def _table(schema: dict, rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.table({k: pa.array(c, t) for (k, t), c in zip(schema.items(), cols, strict=True)})


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return h, np.bincount(where, np.concatenate([p[1] for p in parts]).astype(np.float64)).astype(np.uint64)  # exact below 2**53


def _bucket(bucket: int | None, parts: list):
    if parts:
        h, n = _added(parts)
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([pack(h)], pa.binary()), pa.array([pack(n)], pa.binary()), pa.array([int(n.sum())]), pa.array([len(h)])], ["bucket", "hashes", "counts", "n", "v"])


def unigrams(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, hashes, counts (packed), n, v: the training counts of each bucket."""

    def count(batches):
        for b in batches:
            h, n = np.unique(_stream(b.column("_text"))[0], return_counts=True)
            order, some, first = _by_bucket(h, buckets)
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array([pack(x[order[first[k] : first[k + 1]]]) for k in range(len(some))], pa.binary()) for x in (h, n.astype(np.uint64)))], ["bucket", "hashes", "counts"])

    def add(batches):
        # buckets come one after another; of one, what was added up and a like amount more is held
        bucket, held, more = None, [], 0
        for b in batches:
            for k, h, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != bucket:
                    yield from _bucket(bucket, held)
                    bucket, held, more = k, [], 0
                held.append((unpack(h), unpack(n)))
                more += len(held[-1][0])
                if more > MERGE + 2 * len(held[0][0]):
                    held, more = [_added(held)], 0
        yield from _bucket(bucket, held)

    packed = docs.select("_text").mapInArrow(count, "bucket long, hashes binary, counts binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, "bucket long, hashes binary, counts binary, n long, v long")


class _Block:
    """A block's tokens: h (hashes), at (offsets), distinct tokens by bucket and hash, and each token's place among them."""

    def __init__(self, texts: pa.Array, buckets: int):
        self.h, self.at = _stream(texts)
        self.distinct, self.place = np.unique(self.h, return_inverse=True)
        order, self.some, self.first = _by_bucket(self.distinct, buckets)
        self.distinct = self.distinct[order]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.place = back[self.place]

    def grams(self) -> None:
        """pair, triple: distinct pairs and triples, as places of words, or of a pair and a word, in 32 bits each; pair_of and triple_of: each token's.

        The first token of a document is in a pair with an end, and in no triple (-1).
        """
        end = self.place[self.at[1] - 1]
        before = np.empty_like(self.place)
        before[1:] = self.place[:-1]
        before[self.at[:-1]] = end
        self.pair, self.pair_of = np.unique(before.astype(np.uint64) << np.uint64(32) | self.place.astype(np.uint64), return_inverse=True)
        inner = np.ones(len(self.place), bool)
        inner[self.at[:-1]] = False
        later = np.flatnonzero(inner)
        self.triple, where = np.unique(self.pair_of[later - 1].astype(np.uint64) << np.uint64(32) | self.place[later].astype(np.uint64), return_inverse=True)
        self.triple_of = np.full(len(self.place), -1)
        self.triple_of[later] = where

    def asked(self, number: np.ndarray, count: np.ndarray, hot: float, buckets: int):
        """For pairs and for triples: their words' numbers, their order by bucket and words, the buckets that occur and where each begins."""
        high = lambda x: (x >> np.uint64(32)).astype(np.int64)
        low = lambda x: (x & np.uint64(0xFFFFFFFF)).astype(np.int64)
        u, v = high(self.pair), low(self.pair)
        nu, nv, frequent = number[u], number[v], count > hot
        key = nu * _SPREAD[0] + np.where(frequent[u], nv * _SPREAD[1], np.uint64(0))
        sorted_pairs = _order(nu, nv)
        yield (nu, nv), *_dealt(key, sorted_pairs, buckets)
        of, nw = high(self.triple), number[low(self.triple)]
        rank = np.empty(len(u), np.uint64)
        rank[sorted_pairs] = np.arange(len(u), dtype=np.uint64)
        both = (nu * _SPREAD[0] + nv * _SPREAD[1])[of]
        key = np.where((frequent[u] & frequent[v])[of], both + nw * _SPREAD[2], both)
        yield (nu[of], nv[of], nw), *_dealt(key, _order(rank[of], nw), buckets)

    def codes(self, replies: pa.Table, kind: int) -> np.ndarray:
        """The codes of one kind, put together in the order of buckets."""
        rows = sorted((b, x, y) for k, b, x, y in zip(*(replies.column(c).to_pylist() for c in ("kind", "bucket", "a", "b")), strict=True) if k == kind)
        return np.concatenate([unpack(r[2])[narrow(r[1])] for r in rows]) if rows else np.zeros(0, np.uint64)

    def answers(self, replies: pa.Table, kind: int) -> list[np.ndarray]:
        """The replies of one kind, put together in the order of buckets."""
        rows = sorted((b, x, y) for k, b, x, y in zip(*(replies.column(c).to_pylist() for c in ("kind", "bucket", "a", "b")), strict=True) if k == kind)
        return [np.concatenate([unpack(r[c]) for r in rows]) if rows else np.zeros(0, np.uint64) for c in (1, 2)]


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the ones before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order by a, then b: one sort of both in 64 bits where they fit."""
    wide = int(b.max(initial=0)).bit_length()
    if int(a.max(initial=0)).bit_length() + wide <= 64:
        return np.argsort(a << np.uint64(wide) | b)
    return np.lexsort((b, a))


def _dealt(key: np.ndarray, order: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order dealt out to buckets by key: order, the buckets that occur and where each begins."""
    bucket = (bs.mix(key[order]) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    by = np.argsort(bucket, kind="stable")
    some, first = np.unique(bucket[by], return_index=True)
    return order[by], some, np.append(first, len(order))


def _distinct(a: np.ndarray, b: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (a, b) in order, their summed counts, and where each row is among them."""
    order = _order(a, b)
    a, b = a[order], b[order]
    heads = _heads(a, b) if len(order) else np.zeros(0, np.int64)
    where = np.empty(len(order), np.int64)
    where[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
    return a[heads], b[heads], np.add.reduceat(count[order], heads) if len(heads) else count, where


_REPLY = {"block": pa.int64(), "kind": pa.int32(), "bucket": pa.int64(), "a": pa.binary(), "b": pa.binary()}
_ASKED = {"bucket": pa.int64(), "block": pa.int64(), "kind": pa.int32(), "packed": pa.list_(pa.binary()), "last": pa.binary(), "counts": pa.binary()}
_REPLY_DDL = "block long, kind int, bucket long, a binary, b binary"


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: _id, _train, n_tokens, n_known, train_tokens, base_score, score. train: which rows are learned from."""
    spark = docs.sparkSession
    texts = rowed(docs.withColumn("__train", F.coalesce(train, F.lit(False))).drop("__row"))
    texts = keyed(texts, id_col, text_col, "__train", "__row")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    blocks = buckets = max(partitions(spark), -(-size // BLOCK_BYTES))
    words = durable(unigrams(texts.where("__train"), buckets))
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    texts = texts.withColumn("block", F.pmod(F.xxhash64("__row"), F.lit(blocks))).drop("__row")
    hot, low_end = n / (SHARE * buckets), least(n)

    def ask(t: pa.Table) -> pa.Table:
        block, b = t.column("block")[0].as_py(), _Block(t.column("_text"), buckets)
        return _table({"bucket": pa.int64(), "block": pa.int64(), "hashes": pa.binary()}, [(int(k), block, pack(b.distinct[b.first[i] : b.first[i + 1]])) for i, k in enumerate(b.some)])

    def tell(asked: pa.Table, known: pa.Table) -> pa.Table:
        """Numbers (all tokens of the bucket, the most frequent first) and training counts."""
        rows = list(zip(*(asked.column(c).to_pylist() for c in ("bucket", "block", "hashes")), strict=True))
        asked_for = [unpack(r[2]) for r in rows]
        every = np.sort(np.concatenate(asked_for)) if rows else np.zeros(0, np.uint64)
        every = every[np.append(True, every[1:] != every[:-1])[: len(every)]]
        count = np.zeros(len(every), np.uint64)
        for h, c in zip(known.column("hashes").to_pylist(), known.column("counts").to_pylist(), strict=True):
            count[np.searchsorted(every, unpack(h))] = unpack(c)  # every training token is asked for by its own block
        rank = np.empty(len(every), np.uint64)
        rank[np.lexsort((every, -count.astype(np.int64)))] = np.arange(len(every), dtype=np.uint64)
        out = []
        for (bucket, block, _), h in zip(rows, asked_for, strict=True):
            at = np.searchsorted(every, h)
            out.append((block, 1, bucket, pack(rank[at]), pack(count[at])))
        return _table(_REPLY, out)

    def numbers(b: _Block, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Number and count of each distinct token of a block."""
        rank, count = b.answers(replies, 1)
        return rank * np.uint64(buckets) + np.repeat(b.some, np.diff(b.first)).astype(np.uint64), count

    def ask_grams(t: pa.Table, replies: pa.Table) -> pa.Table:
        block, b = t.column("block")[0].as_py(), _Block(t.column("_text"), buckets)
        b.grams()
        taught = np.repeat(t.column("__train").to_numpy().astype(bool), np.diff(b.at))
        seen = (np.bincount(b.pair_of[taught], minlength=len(b.pair)), np.bincount(b.triple_of[taught & (b.triple_of >= 0)], minlength=len(b.triple)))
        rows = []
        for k, (words_, order, some, at) in enumerate(b.asked(*numbers(b, replies), hot, buckets)):
            for i, bucket in enumerate(some.tolist()):
                own = order[at[i] : at[i + 1]]
                cols = [w[own] for w in words_]
                # runs of equal first words, of equal pairs
                heads = _heads(cols[0])
                packed = [pack_sorted(cols[0][heads]), pack(np.diff(np.append(heads, len(own))))]
                if k:
                    inner = _heads(cols[0], cols[1])
                    packed[1:] = [pack(np.diff(np.append(np.flatnonzero(np.isin(inner, heads)), len(inner)))), pack(cols[1][inner]), pack(np.diff(np.append(inner, len(own))))]
                rows.append((bucket, block, 2 + k, packed, pack(cols[-1]), pack(seen[k][own])))
        return _table(_ASKED, rows)

    def shard(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("kind", "block", "bucket", "packed", "last", "counts")), strict=True))
        two, three = ([r for r in rows if r[0] == k] for k in (2, 3))
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        u = join([np.repeat(unpack_sorted(r[3][0]), unpack(r[3][1]).astype(np.int64)) for r in two])
        pu, pv, pn, p_at = _distinct(u, join([unpack(r[4]) for r in two]), join([unpack(r[5]) for r in two]))
        # the pairs of triples, once for each block; then triples by the pair's place and their last word
        heads = join([np.repeat(unpack_sorted(r[3][0]), unpack(r[3][1]).astype(np.int64)) for r in three])
        run = join([unpack(r[3][3]) for r in three]).astype(np.int64)
        tu, tv, _, t_at = _distinct(heads, join([unpack(r[3][2]) for r in three]), np.zeros(len(heads), np.uint64))
        pair, word, n3, w_at = _distinct(np.repeat(t_at, run).astype(np.uint64), join([unpack(r[4]) for r in three]), join([unpack(r[5]) for r in three]))
        pair = pair.astype(np.int64)
        p, w = pn > 0, n3 > 0
        trie = Trie((pu[p], pv[p], pn[p] / max(n, 1)), (tu[pair[w]], tv[pair[w]], word[w], n3[w] / max(n, 1)), low_end)
        codes = trie.pairs(pu, pv)[p_at], trie.triples(tu[pair], tv[pair], word)[w_at]
        trie.close()
        out = []
        for mine, code in zip((two, three), codes, strict=True):
            at = 0
            for r in mine:
                k = len(narrow(r[5]))
                # what occurs is few different codes: their list, and places in it
                some, where = np.unique(code[at : at + k], return_inverse=True)
                out.append((r[1], r[0], r[2], pack(where), pack(some)))
                at += k
        return _table(_REPLY, out)

    def final(t: pa.Table, replies: pa.Table) -> pa.Table:
        b = _Block(t.column("_text"), buckets)
        number, count = numbers(b, replies)
        b.grams()
        joint = []
        for k, (_, order, _, _) in enumerate(b.asked(number, count, hot, buckets)):
            p = np.empty(len(order))
            p[order] = restore(b.codes(replies, 2 + k), low_end) * n
            joint.append(p)
        low = (count[b.place].astype(np.float64) + 1) / (n + v + 1)
        context = count[(b.pair >> np.uint64(32)).astype(np.int64)].astype(np.float64)
        two = (joint[0][b.pair_of] + MU * low) / (context[b.pair_of] + MU)
        some = np.flatnonzero(b.triple_of >= 0)
        p = two.copy()
        p[some] = (joint[1][b.triple_of[some]] + MU * two[some]) / (joint[0][b.pair_of[some - 1]] + MU)
        starts = b.at[:-1]
        return pa.table({"_id": t.column("_id"), "_train": t.column("__train"), "n_tokens": pa.array(np.diff(b.at)), "n_known": pa.array(np.add.reduceat((count[b.place] > 0).astype(np.int64), starts)), "train_tokens": pa.array([n] * t.num_rows, pa.int64()), "base_score": pa.array(np.add.reduceat(np.log10(low), starts)), "score": pa.array(np.add.reduceat(np.log10(p), starts))})

    dealt = texts.groupBy("block")
    asked = dealt.applyInArrow(ask, "bucket long, block long, hashes binary")
    told = asked.groupBy("bucket").cogroup(words.select("bucket", "hashes", "counts").groupBy("bucket")).applyInArrow(tell, _REPLY_DDL)
    grams = dealt.cogroup(told.groupBy("block")).applyInArrow(ask_grams, "bucket long, block long, kind int, packed array<binary>, last binary, counts binary")
    coded = grams.groupBy("bucket").applyInArrow(shard, _REPLY_DDL)
    return dealt.cogroup(told.unionByName(coded).groupBy("block")).applyInArrow(final, "_id long, _train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score over all documents."""
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), fold(7) != 2)
    return out.select(real_id().alias("doc_id"), (~F.col("_train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
