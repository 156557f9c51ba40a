"""Benchmark decontamination by template canonicalisation.

Numbers, names and units are replaced by typed placeholders, so that a question with other values is the same template. Windows of five tokens of the benchmark,
as templates and as they are, are hash-joined with the windows of all documents. A Bloom filter of the benchmark's windows, of bounded size, keeps windows of
no use out of the shuffle, so documents are read once whatever the size of the benchmark. An item is found in a document if 0.8 of its distinct windows are
there: as they are, or as templates that agree on their slots: a value of the item must stand for one value in the document, and windows that contradict the
prevailing value of a slot do not count. Two values of an item may become one: a question with other numbers may have equal ones.

Tokens are runs of ASCII letters and digits and of bytes from 0x80, A-Z as a-z; a number is a token that begins with a digit, with digit groups joined by a point
or comma; a unit is a listed word that follows a number; a name is a capitalised token that follows another token of its sentence and line, and a capitalised
token that leads a sentence is tried both ways, as a word and as a name. A template window needs two tokens that are no placeholders; one without
placeholders is the window as it is.

Defined results: null and empty texts match nothing; an item of fewer than five tokens is found wherever its tokens stand in a row, as they are; items without a token
are never found; very long texts are searched whole, and what repeats in a document counts once; rows that repeat identifier and text are one document or item, with one result;
rows that share an identifier, null among them, but not their text are apart, each with its own results under that identifier; of slot values with equal votes the item's own wins, then the least hash; empty tables
give an empty result; extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .cluster import NO_ID, durable, keyed, real_id
from .jaccard_join import grouped

WORDS, THRESHOLD = 5, 0.8
LITERALS = 2
SMALL = 1 << 18  # benchmark windows that may be broadcast; more are joined by a shuffle
FILTER_BITS = (16, 27)  # least and most bits of the filter's size, as powers of two: 16 MB at most
SLICE = 1 << 13  # bytes of the filter that are put together at once

#: Units of measure and money that are recognised after a number.
UNITS = "mm cm m km mg g kg t ml l s ms min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years inch inches ft foot feet mile miles lb lbs oz usd eur dollar dollars euro euros cent cents percent degree degrees kmh mph".split()

_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_LETTER = np.where(_WORD, bs.LETTER[bs.LOWER], np.uint64(0))
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, np.int64)
_STOP[[10, 13, 33, 46, 58, 59, 63]] = 1  # line ends and . ! ? : ;
NUMBER, NAME, UNIT, PLAIN = bs.stream(4, 31)


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.sort(bs.tokens(data, np.array([0, len(data)]), _LETTER)[1])


_UNITS = _hash_words(UNITS)


def canonical(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, kinds (0: literal, 1: number, 2: name, 3: unit), which lead a sentence with a capital, and n + 1 offsets of tokens."""
    starts, value, off = bs.tokens(data, at, _LETTER)
    if not len(starts):
        return value, np.zeros(0, np.int8), np.zeros(0, bool), off
    gaps = np.append(np.flatnonzero(~_WORD[data]), len(data))
    ends = np.minimum(gaps[np.searchsorted(gaps, starts)], at[np.searchsorted(at, starts, "right")])
    number = _DIGIT[data[starts]]
    first = np.zeros(len(starts), bool)
    first[off[:-1][off[:-1] < off[1:]]] = True
    joined = np.zeros(len(starts), bool)
    joined[1:] = number[1:] & number[:-1] & ~first[1:] & (starts[1:] == ends[:-1] + 1) & np.isin(data[starts[1:] - 1], (44, 46))
    if joined.any():
        # digit groups make one number, whose value is the sum of mixed parts in order
        head = np.cumsum(~joined) - 1
        n = np.bincount(head)
        inner = np.arange(len(starts)) - np.repeat(np.cumsum(n) - n, n)
        value = np.where(n > 1, bs.mix(np.add.reduceat(value * bs.place(int(n.max()))[inner], np.flatnonzero(~joined))), value[~joined])
        off = np.concatenate([[0], np.cumsum(~joined)])[off]
        last = np.append(np.flatnonzero(~joined)[1:] - 1, len(starts) - 1)
        starts, ends, number, first = starts[~joined], ends[last], number[~joined], first[~joined]
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    inside = np.zeros(len(starts), bool)
    inside[1:] = (stops[starts[1:]] == stops[ends[:-1]]) & ~first[1:]
    name = _UPPER[data[starts]] & inside
    unit = np.zeros(len(starts), bool)
    unit[1:] = number[:-1] & ~first[1:]
    unit[1:] &= np.isin(value[1:], _UNITS) if unit.any() else False
    kind = np.select([number, unit, name], [1, 3, 2], 0).astype(np.int8)
    return value, kind, _UPPER[data[starts]] & (kind == 0), off


class Windows:
    """All windows of a batch of texts: plain (hashes of the tokens as they are), and named and led (hashes as templates, 0 where there is none)."""

    def __init__(self, data: np.ndarray, at: np.ndarray, words: int):
        self.value, self.kind, lead, self.off = canonical(data, at)
        self.words = words
        sh, self.out = bs.shingles(self.value, self.off, words)
        self.plain = bs.mix(sh + PLAIN)
        count = np.diff(self.out)
        self.begin = np.repeat(self.off[:-1], count) + np.arange(self.out[-1]) - np.repeat(self.out[:-1], count)
        self.stop = np.minimum(self.begin + words, np.repeat(self.off[1:], count))
        self.kind_led = np.where(lead, 2, self.kind).astype(np.int8)
        self.named = self._templates(self.kind, self.kind > 0)
        self.led = self._templates(self.kind_led, lead)

    def _templates(self, kind: np.ndarray, needed: np.ndarray) -> np.ndarray:
        token = np.select([kind == 1, kind == 2, kind == 3], [NUMBER, NAME, UNIT], self.value)
        inside = lambda x: np.concatenate([[0], np.cumsum(x)])[self.stop] - np.concatenate([[0], np.cumsum(x)])[self.begin]
        good = (inside(kind == 0) >= LITERALS) & (inside(needed) > 0) & (self.stop - self.begin == self.words)
        return np.where(good, bs.shingles(token, self.off, self.words)[0], np.uint64(0))

    def slots(self, i: int, kind: np.ndarray) -> bytes:
        x, y = self.begin[i], self.stop[i]
        return self.value[x:y][kind[x:y] > 0].tobytes()

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of fewer tokens than a window has, as a text of so many tokens would have, and the token that each begins with."""
        last = np.repeat(self.off[1:], np.diff(self.off))
        begin = np.flatnonzero(np.arange(len(self.value)) + length <= last)
        factor = bs.stream(self.words, 3)
        total = np.zeros(len(begin), np.uint64)
        for k in range(self.words):
            total += (self.value[begin + k] if k < length else np.uint64(k + 1)) * factor[k]
        return bs.mix(bs.mix(total) + PLAIN), begin


def item_windows(items: DataFrame, words: int = WORDS) -> DataFrame:
    """item, label, n, length, u, h, slots: a row for each distinct window of each item (_item, _id, _text), u numbers its windows as they are; length: tokens of an item that is shorter than a window, else 0."""
    schema = pa.schema([("item", pa.int64()), ("label", pa.int64()), ("n", pa.int32()), ("length", pa.int32()), ("u", pa.int32()), ("h", pa.int64()), ("slots", pa.binary())])

    def run(batches):
        for b in batches:
            keys, labels, rows = b.column("_item").to_pylist(), b.column("_id").to_pylist(), []
            for row, end, data, at in bs.pieces(b.column("_text")):
                w = Windows(data, at, words)
                for i in range(end - row):
                    x, y = int(w.out[i]), int(w.out[i + 1])
                    distinct, u = np.unique(w.plain[x:y], return_inverse=True)
                    size = int(w.off[i + 1] - w.off[i])
                    mine = {(int(u[k - x]), int(w.plain[k : k + 1].view(np.int64)[0]), b"") for k in range(x, y)}
                    for h, kind in ((w.named, w.kind), (w.led, w.kind_led)):
                        mine |= {(int(u[k - x]), int(h[k : k + 1].view(np.int64)[0]), w.slots(k, kind)) for k in (np.flatnonzero(h[x:y]) + x).tolist()}
                    rows += [(keys[row + i], labels[row + i], len(distinct), size if size < words else 0, *m) for m in sorted(mine)]
            cols = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    return items.select("_item", "_id", "_text").mapInArrow(run, "item long, label long, n int, length int, u int, h long, slots binary")


def window_filter(wins: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, packed, of which the one at the high bits of each window's hash is set. Slices are put together in tasks; the driver gets the filter, whose size is bounded."""

    def mark(batches):
        found: dict[int, np.ndarray] = {}
        for b in batches:
            place = np.unique(b.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            for k in np.unique(place // (8 * SLICE)).tolist():
                inner = place[place // (8 * SLICE) == k] - k * 8 * SLICE
                flags = np.zeros(8 * SLICE, np.uint8)
                flags[inner] = 1
                found[k] = found.get(k, 0) | np.packbits(flags)
        yield _slices(found)

    def join(batches):
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("k").to_pylist(), b.column("bits").to_pylist(), strict=True):
                found[k] = found.get(k, 0) | np.frombuffer(x, np.uint8)
        yield _slices(found)

    ddl = "k long, bits binary"
    out = np.zeros(max(SLICE, (1 << bits) // 8), np.uint8)
    for r in wins.select("h").mapInArrow(mark, ddl).repartition("k").mapInArrow(join, ddl).collect():  # at most 16 MB
        out[r.k * SLICE : (r.k + 1) * SLICE] = np.frombuffer(r.bits, np.uint8)
    return out


def _slices(found: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["k", "bits"])


def agreeing(hits: list[tuple[int, bytes, bytes]]) -> tuple[int, int]:
    """Windows of an item that are found in a document and agree on their slots, and slots that were re-parameterised.

    hits: window of the item, its slot values and the document's, which are empty for windows as they are.
    """
    pairs = [(u, list(zip(np.frombuffer(a, np.uint64).tolist(), np.frombuffer(b, np.uint64).tolist(), strict=True))) for u, a, b in hits]
    votes: dict[int, Counter] = {}
    for _, slots in pairs:
        for a, b in slots:
            votes.setdefault(a, Counter())[b] += 1
    best = {a: max(c.items(), key=lambda x: (x[1], x[0] == a, -x[0]))[0] for a, c in votes.items()}
    good = {u for u, slots in pairs if all(best[a] == b for a, b in slots)}
    return len(good), sum(a != b for a, b in best.items())


def document_windows(docs: DataFrame, wanted: np.ndarray, bits: int, lengths: list[int], words: int = WORDS) -> DataFrame:
    """_doc, _id, h, values: the distinct windows of documents (_doc, _id, _text) that the filter lets through; runs of these lengths too."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    shift = np.uint64(64 - bits)

    def run(batches):
        flags = shared.value

        def passed(h: np.ndarray) -> np.ndarray:
            place = (h >> shift).astype(np.int64)
            return np.flatnonzero((flags[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1)

        for b in batches:
            doc_of, id_of = b.column("_doc").to_numpy(), b.column("_id").to_numpy()
            for row, _, data, at in bs.pieces(b.column("_text")):
                w = Windows(data, at, words)
                parts = []
                for h, kind in ((w.plain, None), (w.named, w.kind), (w.led, w.kind_led)):
                    hit = passed(h)
                    hit = hit[h[hit] != 0]
                    parts.append((np.searchsorted(w.out, hit, "right") - 1, h[hit], [w.slots(k, kind) if kind is not None else b"" for k in hit.tolist()]))
                for length in lengths:
                    h, begin = w.runs(length)
                    hit = passed(h)
                    parts.append((np.searchsorted(w.off, begin[hit], "right") - 1, h[hit], [b""] * len(hit)))
                rows = sorted({(d, x, v) for doc, h, values in parts for d, x, v in zip(doc.tolist(), h.view(np.int64).tolist(), values, strict=True)})
                doc = row + np.array([r[0] for r in rows], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(doc_of[doc]), pa.array(id_of[doc]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["_doc", "_id", "h", "values"])

    return docs.select("_doc", "_id", "_text").mapInArrow(run, "_doc long, _id long, h long, values binary")


def find_items(docs: DataFrame, items: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """_id, item, n_windows, n_found, new_values: pairs of documents (_id, _text) and the items (_id, _text) found in them."""
    key = F.xxhash64("_id", "_text")
    wins = durable(item_windows(items.select(key.alias("_item"), "_id", "_text").dropDuplicates(["_item"]), words))
    total = wins.count()
    bits = max(FILTER_BITS[0], min(FILTER_BITS[1], total.bit_length() + 5))
    lengths = sorted(r.length for r in wins.where("length > 0").select("length").distinct().collect())  # below words
    hits = document_windows(docs.select(key.alias("_doc"), "_id", "_text"), window_filter(wins, bits), bits, lengths, words)
    wins = wins.drop("length")
    # what equal rows and repeated windows give is put together before rows of one document and item meet in a task
    met = hits.join(F.broadcast(wins) if total <= SMALL else wins, "h").drop("h").distinct()

    def verify(batches):
        for b, starts in grouped(batches, ["_doc", "item"]):
            u, a, v = (b.column(c).to_pylist() for c in ("u", "slots", "values"))
            ids, labels, n = (b.column(c).to_pylist() for c in ("_id", "label", "n"))
            out = []
            for g, e in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows], strict=True):
                if e - g < threshold * n[g] - 1e-9:
                    continue
                good, new = agreeing(list(zip(u[g:e], a[g:e], v[g:e], strict=True)))
                if good >= threshold * n[g] - 1e-9:
                    out.append((ids[g], labels[g], n[g], good, new))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["_id", "item", "n_windows", "n_found", "new_values"])

    met = met.repartition("_doc", "item").sortWithinPartitions("_doc", "item", "u", "slots", "values")
    return met.mapInArrow(verify, "_id long, item long, n_windows int, n_found int, new_values int")


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_windows, n_found, new_values: every item found in every document."""
    docs, items = (keyed(spark.read.parquet(f"{sf_dir}/{t}.parquet"), i) for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    out = find_items(docs, items)
    return out.select(real_id().alias("doc_id"), F.when(F.col("item") != NO_ID, F.col("item")).alias("item_id"), "n_windows", "n_found", "new_values")
