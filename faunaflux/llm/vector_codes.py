"""Vector code compression: a product quantiser of whole numbers, trained by Lloyd's rounds that keep heaps of bounds.

A vector is cut into parts, and each position of a part has a codebook. A block of vectors holds, for each entry of each codebook, a heap of the parts assigned
to it, keyed by slack: the distance to the second-nearest entry less that to the nearest, plus the drift that the entry had seen when the part was put in. When
entries move, an entry's drift grows by its own move and the largest move of another; only parts whose key it has passed can have changed their entry. They are
popped and compared with all entries, exactly; the others are not looked at. A heap is kept as a sorted run, whose pops come off its front.

Blocks with their heaps are written to the shared folder after each round, so a lost executor costs the reading of its blocks, and a round's memory is that of
a block. What meets on the driver is the codebooks (parts x entries x width whole numbers); sums are exact.

Defined results: rows whose vector is null, empty, of another length than most, or holding null or non-finite components take no part; ties of distance go to the
lower entry; a length that the number of parts does not divide is cut as evenly as it goes; rows that repeat an identifier are rows of their own, and seed the
codebooks in the order of identifier, nulls last, then vector; with fewer rows than entries there are as many entries as rows; an error that a long can't hold is
null; labels of any type are kept, nulls are one label; extra columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exact
from .cluster import delete, durable, written

BLOCK = 8192  # vectors
BROADCAST_LABELS = 100_000


class Codes(NamedTuple):
    rows: DataFrame  # _id, _label, code (a byte for each part), error (long)
    books: list[np.ndarray]  # of each position: entries x width, Python's integers
    scanned: list[int]  # parts compared with all entries in the first assignment and after each round


def _cuts(d: int, parts: int) -> list[int]:
    return [d * p // parts for p in range(parts + 1)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lowest of ties), distances to it and to the second-nearest one (infinite if there is none), not squared."""
    far = max(exact.largest(x), exact.largest(book))
    bits = (4 * max(1, x.shape[1]) * far * far).bit_length()
    a, c = exact.widened(x, bits), exact.widened(book, bits)
    square = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None]
    best = np.argmin(square, 1)
    rows = np.arange(len(x))
    first = np.sqrt(square[rows, best].astype(np.float64))
    if len(book) == 1:
        return best, first, np.full(len(x), np.inf)
    square = square.astype(np.float64)
    square[rows, best] = np.inf
    return best, first, np.sqrt(square.min(1))


def _slack(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Lower less upper bound, less what rounding can take from it."""
    return np.where(np.isinf(second), np.inf, second - first - 1e-9 * (np.where(np.isinf(second), 0, second) + first))


def _heaps(code: np.ndarray, key: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of entry and key, their keys, and where each entry's heap begins."""
    order = np.lexsort((key, code))
    return order, key[order], np.searchsorted(code[order], np.arange(entries + 1))


def _squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _open(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _store(x: np.ndarray) -> bytes:
    """Integers in the narrowest type that holds them."""
    top = exact.largest(x)
    for kind in ("b", "h", "i", "q"):
        if top < 1 << (8 * np.dtype(kind).itemsize - 1):
            return kind.encode() + _squeeze(x.astype(kind))
    return b"," + ",".join(map(str, x.ravel())).encode()


def _load(raw: bytes) -> np.ndarray:
    if raw[:1] == b",":
        return np.array([int(v) for v in raw[1:].decode().split(",")], object)
    return _open(raw[1:], raw[:1].decode()).astype(np.int64)


def _tally(x: np.ndarray, code: np.ndarray, cuts: list[int], entries: int, scanned: int) -> bytes:
    """Counts of each entry, sums of each entry's components by position, and the number of scans."""
    counts = [np.bincount(code[:, p], minlength=entries) for p in range(code.shape[1])]
    sums = []
    for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        order = np.argsort(code[:, p], kind="stable")
        part = exact.widened(x[order, a:b], 62 if x.dtype != object and exact.largest(x) * len(x) < 1 << 62 else 99)
        total = np.zeros((entries, b - a), part.dtype)
        present, at = np.unique(code[order, p], return_index=True)
        if len(order) and b > a:
            total[present] = np.add.reduceat(part, at, axis=0)
        sums.append(total.ravel())
    return _store(np.concatenate([np.asarray(v, object) for v in (*counts, *sums, [scanned])]))


_STATE = "x binary, code binary, place binary, key binary, tally binary"


def fit(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0) -> Codes | None:
    """Codes of the vectors of table, components floor(scale x component); entries at most 256. None if there is no vector."""
    spark = table.sparkSession
    rows = exact.usable(table, vec_col, F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{label_col}`").alias("_label"))
    label = rows.schema["_label"].dataType.simpleString()
    seeds = rows.orderBy(F.col("_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()
    if not seeds.num_rows:
        return None
    first = exact.integers(np.floor(scale * exact.matrix(seeds.column("v").combine_chunks())))
    n, d = first.shape
    cuts = _cuts(d, parts)
    books = [first[:, a:b].astype(object) for a, b in zip(cuts, cuts[1:], strict=False)]
    drift = np.zeros((parts, n))
    schema = f"ids array<long>, labels array<{label}>, {_STATE}"

    def begin(batches):
        for b in exact.blocks(batches, BLOCK):
            x = exact.integers(np.floor(scale * exact.matrix(b.column("v"))))
            code, place, key = np.empty((len(x), parts), np.uint8), np.empty((parts, len(x)), np.uint16), np.empty((parts, len(x)), np.float32)
            for p in range(parts):
                code[:, p], near, second = nearest(x[:, cuts[p] : cuts[p + 1]], books[p])
                place[p], key[p], _ = _heaps(code[:, p], np.nextafter(_slack(near, second).astype(np.float32), np.float32(-np.inf)), n)
            yield _block(b.column("_id"), b.column("_label"), _store(x), code, place, key, _tally(x, code, cuts, n, len(x) * parts))

    def step(books, drift):
        def run(batches):
            for b in batches:
                for r in range(b.num_rows):
                    at = lambda c: b.column(c)[r].as_py()  # noqa: B023, E731
                    x, code, place, key, scanned = _moved(_load(at("x")).reshape(-1, d), at("code"), at("place"), at("key"), books, drift, cuts, n)
                    yield _block(b.column("ids")[r].values, b.column("labels")[r].values, at("x"), code, place, key, _tally(x, code, cuts, n, scanned))

        return run

    def last(books, drift):
        def run(batches):
            for b in batches:
                for r in range(b.num_rows):
                    at = lambda c: b.column(c)[r].as_py()  # noqa: B023, E731
                    x, code, _, _, _ = _moved(_load(at("x")).reshape(-1, d), at("code"), at("place"), at("key"), books, drift, cuts, n)
                    error = _errors(x, code, books, cuts)
                    raw = code.tobytes()
                    yield pa.RecordBatch.from_arrays([b.column("ids")[r].values, b.column("labels")[r].values, pa.array([raw[i : i + parts] for i in range(0, len(raw), parts)], pa.binary()), error], ["_id", "_label", "code", "error"])

        return run

    state, scanned = written(rows.mapInArrow(begin, schema)), []
    for k in range(rounds):
        total = _merged_tally(state, parts * n + n * d + 1)
        scanned.append(int(total[-1]))
        books, moves = _updated(total, books, cuts, n)
        for p in range(parts):
            others = np.array([max(np.delete(moves[p], j), default=0.0) for j in range(n)])
            drift[p] += (moves[p] + others) * (1 + 1e-9)
        if k < rounds - 1:
            before, state = state, written(state.mapInArrow(step(books, drift.copy()), schema))
            delete(before)
    out = durable(state.mapInArrow(last(books, drift), f"_id long, _label {label}, code binary, error long"))
    delete(state)
    return Codes(out, books, scanned)


def _block(ids, labels, x: bytes, code, place, key, tally: bytes) -> pa.RecordBatch:
    one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
    cells = [one(ids), one(labels), *[pa.array([v], pa.binary()) for v in (x, _squeeze(code), _squeeze(place), _squeeze(key), tally)]]
    return pa.RecordBatch.from_arrays(cells, ["ids", "labels", "x", "code", "place", "key", "tally"])


def _moved(x: np.ndarray, code: bytes, place: bytes, key: bytes, books: list[np.ndarray], drift: np.ndarray, cuts: list[int], n: int):
    """The block after entries moved: x, code, place, key, and the number of parts that were popped and compared again."""
    parts = len(books)
    code = _open(code, np.uint8).reshape(-1, parts).copy()
    place, key = _open(place, np.uint16).reshape(parts, -1).copy(), _open(key, np.float32).reshape(parts, -1).copy()
    scanned = 0
    for p in range(parts):
        at = np.searchsorted(code[place[p], p], np.arange(n + 1))
        passed = np.nextafter(drift[p].astype(np.float32), np.float32(np.inf))
        pops = [place[p, a : a + np.searchsorted(key[p, a:b], passed[j], "right")] for j, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
        popped = np.concatenate(pops).astype(np.int64) if pops else np.zeros(0, np.int64)
        if not len(popped):
            continue
        by_row = np.empty(len(x), np.float32)
        by_row[place[p]] = key[p]
        best, near, second = nearest(x[popped, cuts[p] : cuts[p + 1]], books[p])
        code[popped, p] = best
        by_row[popped] = np.nextafter((_slack(near, second) + drift[p][best]).astype(np.float32), np.float32(-np.inf))
        place[p], key[p], _ = _heaps(code[:, p], by_row, n)
        scanned += len(popped)
    return x, code, place, key, scanned


def _errors(x: np.ndarray, code: np.ndarray, books: list[np.ndarray], cuts: list[int]) -> pa.Array:
    far = max(exact.largest(x), *(exact.largest(b) for b in books))
    bits = (4 * x.shape[1] * far * far).bit_length()
    total = np.zeros(len(x), np.int64 if bits <= 62 else object)
    for p, book in enumerate(books):
        kind = np.int64 if bits <= 62 else object
        gap = x[:, cuts[p] : cuts[p + 1]].astype(kind) - book.astype(kind)[code[:, p]]
        total = total + (gap * gap).sum(1)
    return pa.array([int(v) if v < 1 << 63 else None for v in total.tolist()], pa.int64())


def _merged_tally(state: DataFrame, size: int) -> np.ndarray:
    """Only the tallies are read; a task adds up those of its blocks."""

    def add(batches):
        total = np.zeros(size, object)
        for b in batches:
            for v in b.column("tally"):
                total = total + _load(v.as_py()).astype(object)
        yield exact.cells(total)

    return exact.merged(state.select("tally").mapInArrow(add, exact.CELLS), size)


def _updated(total: np.ndarray, books: list[np.ndarray], cuts: list[int], n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Codebooks of floored means, entries without parts as they were; how far each entry moved."""
    parts, out, moves = len(books), [], []
    counts, at = total[: parts * n].reshape(parts, n), parts * n
    for p, book in enumerate(books):
        w = cuts[p + 1] - cuts[p]
        sums = total[at : at + n * w].reshape(n, w)
        at += n * w
        new = np.array([[s // c for s in row] if c else old for row, c, old in zip(sums.tolist(), counts[p], book.tolist(), strict=True)], object).reshape(n, w)
        out.append(new)
        moves.append(np.sqrt(((new - book) ** 2).sum(1).astype(np.float64)) if w else np.zeros(n))
    return out, moves


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def with_label_errors(rows: DataFrame) -> DataFrame:
    """rows with the errors summed over equal labels, nulls together (null where a long can't hold the sum). Labels are sent along while few, else joined, when large ones are split."""
    sums = durable(rows.groupBy("_label").agg(F.expr("try_cast(sum(cast(error AS decimal(38,0))) AS bigint)").alias("label_error")).withColumnRenamed("_label", "__l"))
    few = sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return rows.join(F.broadcast(sums) if few else sums, F.col("_label").eqNullSafe(F.col("__l"))).drop("__l")


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of all vectors."""
    found = fit(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    if found is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    rows = with_label_errors(found.rows)
    return rows.select(F.col("_id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(found.books)).alias("codebooks_sha256"))


_ASSIGN = """
a{k} AS (SELECT row, pos, arg_min(j, (s, j)) AS j, min(s) AS s FROM (SELECT row, pos, b.j, list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS s FROM p JOIN b{k} b USING (pos)) GROUP BY ALL)"""
_UPDATE = """,
u{k} AS (SELECT pos, j, i, sum(x[i])::bigint AS s, count(*) AS c FROM p JOIN a{k} USING (row, pos), unnest(range(1, len(x) + 1)) AS u(i) GROUP BY ALL),
m{k} AS (SELECT pos, j, list((s - ((s % c) + c) % c) // c ORDER BY i) AS e FROM u{k} GROUP BY ALL),
b{n} AS (SELECT pos, j, coalesce(m.e, b.e) AS e FROM b{k} b LEFT JOIN m{k} m USING (pos, j)),"""
SQL = (
    """WITH v AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS row, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT row, pos, v[pos * len(v) // 16 + 1 : (pos + 1) * len(v) // 16] AS x FROM v, unnest(range(16)) AS u(pos)),
b0 AS (SELECT pos, row AS j, x AS e FROM p WHERE row < 64),"""
    + "".join(_ASSIGN.format(k=k) + _UPDATE.format(k=k, n=k + 1) for k in range(2))
    + _ASSIGN.format(k=2)
    + """,
h AS (SELECT sha256(string_agg(c::varchar, ',' ORDER BY pos, j, i)) AS codebooks_sha256 FROM (SELECT pos, j, i, e[i] AS c FROM b2, unnest(range(1, len(e) + 1)) AS u(i))),
r AS (SELECT vec_id, label, code, error FROM v JOIN (SELECT row, string_agg(lower(printf('%02x', j)), '' ORDER BY pos) AS code, sum(s)::bigint AS error FROM a2 GROUP BY row) USING (row))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error, codebooks_sha256 FROM r, h"""
)
