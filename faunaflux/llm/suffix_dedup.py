"""Removal of repeated 50-byte strings by column-wise multi-document suffix sorting.

Every 50-byte string picks an anchor, its least hashed 24-byte piece, so equal strings pick equal anchors; runs of strings with one anchor are segments of at most 76 bytes.
Blocks of documents ask the buckets of anchor hashes which of their anchors are in more than one document, and send the segments of those, each distinct
one once, with its least document. A bucket sorts all suffixes of its distinct segments column by column (bwt.py), but of those that are alone with their anchor, which can meet
nothing else, reads off the groups of suffixes that share 50 bytes, and answers with the least document of each string. Blocks mark what a smaller document also has. Every 50-byte string of a segment holds
the whole anchor piece, so for sorting the piece is coded as two symbols that stand for its 24 bytes in that collection, and 50 bytes are 28 symbols.

All exchanges are packed arrays, one row for each block and bucket; what many documents share is sent once by each block. An anchor with more than HOT
strings is not kept together: its strings are sent one by one, by their own hash. Nothing is capped: equal strings always meet.

Defined results: a null text is an empty one; texts under 50 bytes lose nothing; rows that repeat an identifier are one document, so they lose nothing to each other;
rows without an identifier take no part and stay whole, and are spread over blocks by their place, as all rows are; very long texts are searched whole, in overlapping parts; of equal
strings the one of the least identifier stays; extra columns are not read, whatever their names; an empty table gives an empty result. Texts are valid UTF-8, which has no byte 255.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs, bwt
from .cluster import NO_ID, keyed, partitions, real_id, rowed
from .lm_scoring import _by_bucket, _table
from .packing import narrow, pack, pack_sorted, unpack, unpack_sorted

LENGTH, PIECE = 50, 24
SPAN = LENGTH - PIECE + 1  # places of a piece in a string
WIDEST = SPAN - 1 + LENGTH
CODE = 2  # symbols that stand for a piece, each one of DIGITS
DIGITS = 250
BLOCK_BYTES = 8 << 20
CHUNK = 1 << 16  # bytes that are scanned at once; what is made of them stays in a core's cache
ROWS = 1 << 10  # strings whose contents are hashed at once
HOT = 200_000
COLLECTION = 8_192  # strings that are sorted together, or those of one anchor
_FACTOR = bs.stream(6, 51)
_SPREAD = bs.stream(WIDEST, 52)


def _piece_hashes(data: np.ndarray) -> np.ndarray:
    g = bs.LETTER[data]
    kept = {}
    for k, size in enumerate((1, 2, 4, 8)):
        g = g[:-size] * _FACTOR[k] + g[size:]
        kept[2 * size] = g
    return bs.mix(kept[16][: len(data) - PIECE + 1] * _FACTOR[5] + kept[8][16 : len(data) - PIECE + 17])


def segments(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, numbers of strings, anchor hashes and anchor places of all segments of documents; each 50-byte string of a document starts in exactly one."""
    found = []
    doc, n = 0, len(at) - 1
    while doc < n:
        end = max(doc + 1, int(np.searchsorted(at, at[doc] + CHUNK, "right")) - 1)
        lo, stop = int(at[doc]), int(at[end])
        # a longer document is scanned in overlapping parts
        while lo < stop:
            hi = min(stop, lo + CHUNK)
            if hi - lo >= LENGTH:
                part = data[lo:hi]
                h = _piece_hashes(part)
                key = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
                low = key
                for size in (1, 2, 4, 8):
                    low = np.minimum(low[:-size], low[size:])
                low = np.minimum(low[: len(key) - SPAN + 1], low[SPAN - 16 :][: len(key) - SPAN + 1])
                anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)
                bound = at[doc : end + 1]
                inside = np.repeat(bound[1:], np.diff(bound))[lo - bound[0] : hi - bound[0]][: len(anchor)] >= np.arange(lo, lo + len(anchor)) + LENGTH
                anchor[~inside] = -1
                edge = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
                size = np.diff(np.append(edge, len(anchor)))
                real = anchor[edge] >= 0
                found.append((lo + edge[real], size[real], h[anchor[edge[real]]], lo + anchor[edge[real]]))
            if hi == stop:
                break
            lo = hi - LENGTH + 1
        doc = end
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.uint64 if k == 2 else np.int64) for k in range(4))


def _windows(data: np.ndarray) -> np.ndarray:
    """For each place, a view of the WIDEST bytes before it."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(WIDEST, np.uint8), data]), WIDEST)


def _rows(windows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Substrings at the right end of rows, zeros before them."""
    return windows[starts + sizes] * (np.arange(WIDEST, dtype=np.uint8) >= (WIDEST - sizes).astype(np.uint8)[:, None])


class _Block:
    """Segments of a block of documents, and what they ask and send. Orders depend on contents only, not on the order of rows."""

    def __init__(self, t: pa.Table, buckets: int):
        self.ids, self.buckets = t.column("_id").to_numpy(), buckets
        self.data, self.at = bs.buffers(t.column("_text"))
        self.start, self.count, self.anchor, self.piece = segments(self.data, self.at)
        self.doc = np.searchsorted(self.at, self.start, "right") - 1
        some = self.ids[self.doc] != NO_ID
        self.start, self.count, self.anchor, self.piece, self.doc = (x[some] for x in (self.start, self.count, self.anchor, self.piece, self.doc))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (bucket, short hash) of anchors in order, and where each segment's is."""
        short = self.anchor >> np.uint64(32)
        return np.unique((self.anchor % np.uint64(self.buckets)) << np.uint64(32) | short, return_inverse=True)

    def counts(self, where: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """In how many documents each anchor is, and how many strings have it."""
        names, name = np.unique(self.ids, return_inverse=True)
        pairs = np.sort(where * len(names) + name[self.doc])
        return np.bincount(pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]] // max(len(names), 1), minlength=n), np.bincount(where, self.count, n).astype(np.int64)

    def strings(self, mask: np.ndarray, where: np.ndarray):
        """The segments to send: start, length, document, key, content hash and place of the piece, cut into single strings where the anchor is hot."""
        kind = mask[where]
        one, many = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
        n = self.count[many]
        single = np.repeat(self.start[many], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = np.concatenate([self.start[one], single])
        size = np.concatenate([self.count[one] + LENGTH - 1, np.full(len(single), LENGTH)])
        doc = np.concatenate([self.doc[one], np.repeat(self.doc[many], n)])
        content, windows = np.empty(len(start), np.uint64), _windows(self.data)
        for k in range(0, len(start), ROWS):
            rows = _rows(windows, start[k : k + ROWS], size[k : k + ROWS])
            content[k : k + ROWS] = bs.mix((rows.astype(np.uint64) * _SPREAD).sum(1, dtype=np.uint64) + size[k : k + ROWS].astype(np.uint64))
        key = np.concatenate([self.anchor[one], content[len(one) :]])
        piece = np.concatenate([self.piece[one], np.repeat(self.piece[many], n)]) - start
        return start, size, doc, key, content, piece


def _coded(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings at the right end of rows, with the piece as two digits of its number among the distinct pieces; and their lengths."""
    bytes_ = np.ascontiguousarray(data[(starts + piece)[:, None] + np.arange(PIECE)]).view(f"V{PIECE}").ravel()
    number = np.unique(bytes_, return_inverse=True)[1]
    if len(number) and number.max() >= DIGITS**CODE:
        raise ValueError("too many distinct pieces in a collection")
    gap, width = PIECE - CODE, WIDEST - PIECE + CODE
    rel = np.arange(width) - width + (sizes - gap)[:, None]
    left, here = rel < piece[:, None], rel - piece[:, None]
    out = data[np.maximum(starts[:, None] + np.where(left, rel, np.minimum(rel + gap, sizes[:, None] - 1)), 0)]
    out = np.where(here == 0, (number // DIGITS).astype(np.uint8)[:, None], np.where(here == 1, (number % DIGITS).astype(np.uint8)[:, None], out))
    return np.where(rel >= 0, out, np.uint8(0)), sizes - gap


def _mask(replies: pa.Table) -> np.ndarray:
    rows = sorted(zip(replies.column("bucket").to_pylist(), replies.column("a").to_pylist(), strict=True))
    return np.concatenate([narrow(a) for _, a in rows]) if rows else np.zeros(0, np.uint8)


def _collections(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of sorted keys with about COLLECTION strings each, or more of one anchor; none parts an anchor."""
    edges = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
    lo = 0
    while lo < len(key):
        far = int(np.searchsorted(edges, lo + COLLECTION, "right"))
        hi = len(key) if lo + COLLECTION >= len(key) else int(edges[far - 1])
        if hi <= lo:
            hi = int(edges[far]) if far < len(edges) else len(key)
        yield lo, hi
        lo = hi


def least_documents(strings: np.ndarray, lengths: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each coded string and each place of a 50-byte string in it: the least document of all equal ones. One row to a string; unused places hold its own document."""
    m, whole = len(strings), LENGTH - PIECE + CODE
    transform, prefix = bwt.build(strings, lengths, whole)
    at = bwt.places(transform, m, lengths, whole)
    group = np.cumsum(prefix < whole) - 1
    by_place = np.full(len(transform), np.iinfo(np.int64).max)
    for p in at.values():
        ok = p >= 0
        by_place[p[ok]] = docs[ok]
    least = np.minimum.reduceat(by_place, np.flatnonzero(prefix < whole))
    out = np.repeat(docs[:, None], SPAN, axis=1)
    for size, p in at.items():
        ok = np.flatnonzero(p >= 0)
        out[ok, lengths[ok] - size] = least[group[p[ok]]]
    return out


def bucket_answers(data: np.ndarray, size: np.ndarray, key: np.ndarray, low: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For strings that lie one after another: which distinct string each is; of the distinct ones, the number of runs of places with one least document; and of all runs, the first place and that document."""
    start = np.cumsum(size) - size
    by_key = np.argsort(key, kind="stable")
    first, windows = np.empty(len(size), np.int64), _windows(data)  # first: of equal strings
    for lo, hi in _collections(key[by_key]):
        own = by_key[lo:hi]
        row = np.concatenate([_rows(windows, start[own], size[own]), size[own].astype(np.uint8)[:, None]], axis=1)
        _, one, same = np.unique(np.ascontiguousarray(row).view(f"V{row.shape[1]}").ravel(), return_index=True, return_inverse=True)
        first[own] = own[one][same]
    least = low.copy()
    np.minimum.at(least, first, low)
    # a string that is alone with its anchor meets itself only
    distinct = by_key[first[by_key] == by_key]
    edge = np.append(True, key[distinct][1:] != key[distinct][:-1])
    with_others = np.bincount(np.cumsum(edge) - 1)[np.cumsum(edge) - 1] > 1
    several = distinct[with_others]
    answer = np.empty((len(several), SPAN), np.int64)
    for lo, hi in _collections(key[several]):
        own = several[lo:hi]
        answer[lo:hi] = least_documents(*_coded(data, start[own], size[own], piece[own]), least[own])
    # runs of equal answers within a string
    new = np.ones(answer.shape, bool)
    new[:, 1:] = answer[:, 1:] != answer[:, :-1]
    new &= np.arange(SPAN) < (size[several] - LENGTH + 1)[:, None]
    runs = np.ones(len(distinct), np.int64)
    runs[with_others] = new.sum(1)
    place, best, sorted_ = np.zeros(runs.sum(), np.int64), np.repeat(least[distinct], runs), np.repeat(with_others, runs)
    place[sorted_], best[sorted_] = np.nonzero(new)[1], answer[new]
    rank = np.empty(len(size), np.int64)
    rank[distinct] = np.arange(len(distinct))
    return rank[first], runs, place, best


_ANSWER = {"block": pa.int64(), "kind": pa.int32(), "bucket": pa.int64(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary()}
_ANSWER_DDL = "block long, kind int, bucket long, a binary, b binary, c binary"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """For each row of docs: _id, n_bytes, n_removed, n_spans, kept_sha256, and with keep_text the kept bytes, _kept."""
    spark = docs.sparkSession
    texts = keyed(rowed(docs.drop("__row")), id_col, text_col, "__row")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    blocks = buckets = max(partitions(spark), -(-size // BLOCK_BYTES))
    texts = texts.withColumn("block", F.pmod(F.xxhash64("__row"), F.lit(blocks))).drop("__row")

    def ask(t: pa.Table) -> pa.Table:
        block, b = t.column("block")[0].as_py(), _Block(t, buckets)
        key, where = b.anchors()
        n, strings = b.counts(where, len(key))
        owner = (key >> np.uint64(32)).astype(np.int64)
        some, first = np.unique(owner, return_index=True)
        first = np.append(first, len(key))
        return _table({"bucket": pa.int64(), "block": pa.int64(), "short": pa.binary(), "docs": pa.binary(), "strings": pa.binary()}, [(int(k), block, pack_sorted(key[first[i] : first[i + 1]] & np.uint64(0xFFFFFFFF)), pack(n[first[i] : first[i + 1]]), pack(strings[first[i] : first[i + 1]])) for i, k in enumerate(some)])

    def tell(t: pa.Table) -> pa.Table:
        """1 for anchors of more than one document, 2 for those of very many strings."""
        rows = list(zip(*(t.column(c).to_pylist() for c in ("bucket", "block", "short", "docs", "strings")), strict=True))
        asked = [unpack_sorted(r[2]) for r in rows]
        every, where = np.unique(np.concatenate(asked), return_inverse=True)
        total, strings = (np.bincount(where, np.concatenate([unpack(r[c]) for r in rows]).astype(np.float64)) for c in (3, 4))
        code = np.where(total < 2, 0, np.where(strings > HOT, 2, 1)).astype(np.uint8)
        cut = np.cumsum([len(a) for a in asked])
        return _table(_ANSWER, [(block, 1, bucket, pack(c), None, None) for (bucket, block, *_), c in zip(rows, np.split(code[where], cut[:-1]), strict=True)])

    def send(t: pa.Table, replies: pa.Table) -> pa.Table:
        block, b = t.column("block")[0].as_py(), _Block(t, buckets)
        _, where = b.anchors()
        start, size, doc, key, content, piece = b.strings(_mask(replies), where)
        distinct, first, same = np.unique(content, return_index=True, return_inverse=True)
        low = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(low, same, b.ids[doc])
        order, some, at = _by_bucket(key[first], buckets)
        rows = []
        for i, k in enumerate(some):
            own = order[at[i] : at[i + 1]]
            s, z = start[first[own]], size[first[own]]
            flat = np.repeat(s, z) + np.arange(z.sum()) - np.repeat(np.cumsum(z) - z, z)
            rows.append((int(k), block, pack(b.data[flat]), pack(z), pack(key[first[own]] >> np.uint64(32)), pack(low[own].view(np.uint64)), pack(piece[first[own]])))
        return _table({"bucket": pa.int64(), "block": pa.int64(), "bytes": pa.binary(), "sizes": pa.binary(), "keys": pa.binary(), "docs": pa.binary(), "pieces": pa.binary()}, rows)

    def sort(t: pa.Table) -> pa.Table:
        rows = list(zip(*(t.column(c).to_pylist() for c in ("bucket", "block", "bytes", "sizes", "keys", "docs", "pieces")), strict=True))
        data = np.concatenate([narrow(r[2]) for r in rows])
        size, key, low, piece = (np.concatenate([unpack(r[c]) for r in rows]) for c in (3, 4, 5, 6))
        size, low, piece = size.astype(np.int64), low.view(np.int64), piece.astype(np.int64)
        rank, runs, place, best = bucket_answers(data, size, key, low, piece)
        begin = np.cumsum(runs) - runs
        out, at = [], 0
        for bucket, block, _, z, *_ in rows:
            own = rank[at : at + len(unpack(z))]
            n = runs[own]
            r = np.repeat(begin[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append((block, 2, bucket, pack(n), pack(place[r]), pack(best[r].view(np.uint64))))
            at += len(own)
        return _table(_ANSWER, out)

    def final(t: pa.Table, replies: pa.Table) -> pa.Table:
        b = _Block(t, buckets)
        gone = np.zeros(len(b.data) + 1, np.int32)
        kinds = np.array(replies.column("kind").to_pylist(), np.int64)
        masks, answers = replies.filter(pa.array(kinds == 1)), replies.filter(pa.array(kinds == 2))
        if answers.num_rows:
            _, where = b.anchors()
            start, size, doc, key, content, _ = b.strings(_mask(masks), where)
            _, first, same = np.unique(content, return_index=True, return_inverse=True)
            order, _, _ = _by_bucket(key[first], buckets)
            rows = sorted(zip(*(answers.column(c).to_pylist() for c in ("bucket", "a", "b", "c")), strict=True))
            runs, place, least = (np.concatenate([unpack(r[c]) for r in rows]) for c in (1, 2, 3))
            runs, place, least = runs.astype(np.int64), place.astype(np.int64), least.view(np.int64)
            string = np.empty(len(order), np.int64)
            string[order] = np.arange(len(order))
            s = string[same]
            begin = np.cumsum(runs) - runs
            n = runs[s]
            r = np.repeat(begin[s], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            who = np.repeat(np.arange(len(s)), n)
            last = np.append(place[1:], 0)
            last[begin + runs - 1] = -1
            stop = np.where(last[r] < 0, (size - LENGTH + 1)[who], last[r])
            hit = least[r] < b.ids[doc][who]
            np.add.at(gone, (start[who] + place[r])[hit], 1)
            np.add.at(gone, (start[who] + stop)[hit] + LENGTH - 1, -1)
        covered = np.cumsum(gone[:-1], dtype=np.int32) > 0
        edge = covered.copy()
        edge[1:] &= ~covered[:-1]
        heads = b.at[:-1][b.at[:-1] < b.at[1:]]
        edge[heads] = covered[heads]
        removed, spans = (np.diff(np.searchsorted(np.flatnonzero(x), b.at)) for x in (covered, edge))
        kept = [b.data[x:y][~covered[x:y]].tobytes() for x, y in zip(b.at[:-1], b.at[1:], strict=True)]
        cols = {"_id": t.column("_id"), "n_bytes": pa.array(np.diff(b.at)), "n_removed": pa.array(removed), "n_spans": pa.array(spans), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
        return pa.table(cols | ({"_kept": pa.array(kept, pa.binary())} if keep_text else {}))

    dealt = texts.groupBy("block")
    told = dealt.applyInArrow(ask, "bucket long, block long, short binary, docs binary, strings binary").groupBy("bucket").applyInArrow(tell, _ANSWER_DDL)
    sent = dealt.cogroup(told.groupBy("block")).applyInArrow(send, "bucket long, block long, bytes binary, sizes binary, keys binary, docs binary, pieces binary")
    sorted_ = sent.groupBy("bucket").applyInArrow(sort, _ANSWER_DDL)
    return dealt.cogroup(told.unionByName(sorted_).groupBy("block")).applyInArrow(final, "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", _kept binary" * keep_text)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 over all documents."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(real_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
