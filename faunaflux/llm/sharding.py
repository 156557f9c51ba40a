"""Shards of near equal bytes by histogram sort.

Rows are in order of a key: a hash of the text, then one of the identifier, then the row's place, so that equal texts lie side by side and a text that a third of
the rows share can still be cut. Splitters are keys such that the bytes below them are as near to their targets as whole rows allow. They are found without
sorting: each round counts the exact bytes and rows between candidate keys (probes) over all partitions, with the least and greatest key found in each gap, and
the next probes go into the gaps that still hold a target, evenly between those two keys. A gap of one key, or bytes within the tolerance, end the search.

Then rows are exchanged once, to ranges of bounded size within shards, and numbered in them. How many rows lie below each splitter is known exactly from the last
counts, so slots need no further pass. Between rounds the driver keeps the brackets of the splitters (MOST keys of 24 bytes, or two for each splitter if those are more); rows are read
once, and kept in the shared folder as keys and sizes.

Defined results: a null text has no bytes; a row belongs to the shard that holds its middle byte, so one that is longer than a shard leaves the next one short or
empty; rows that repeat an identifier and text are rows of their own; null identifiers are ordered by the hash of an empty string; an empty table gives an empty result. Extra columns
are only carried by write_shards, which replaces those named shard and slot.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import durable, partitions, rowed

WIDTH = 24  # bytes of a key
PROBES = 64  # candidate keys for each open splitter and round, while all of them are not more than MOST
FIRST = 8  # candidate keys for each splitter in the first round, 4096 at least
MOST = 1 << 16
OVERHEAD = 8  # bytes of a row besides its text


class Splitters(NamedTuple):
    keys: list[bytes]  # a row whose key is one or above goes beyond it
    rows: list[int]  # rows below each
    bytes: list[int]  # bytes below each
    rounds: int


def _number(key: bytes) -> int:
    return int.from_bytes(key, "big")


def _key(number: int) -> bytes:
    return number.to_bytes(WIDTH, "big")


def keys_of(column: pa.Array) -> np.ndarray:
    """Keys as fixed strings, which compare byte by byte."""
    if not len(column):
        return np.zeros(0, f"S{WIDTH}")
    raw = pa.concat_arrays([column]) if column.offset else column
    return np.frombuffer(raw.buffers()[2], f"S{WIDTH}", len(raw), _start(raw))


def _start(column: pa.Array) -> int:
    return int(np.frombuffer(column.buffers()[1], np.int32, 1, column.offset * 4)[0])


def counted(rows: DataFrame, probes: list[bytes]) -> dict[int, tuple[int, int, bytes, bytes]]:
    """bytes, rows, least and greatest key of rows (key, size) in each gap of the sorted probes that has rows: gap g holds keys from probe g - 1 on, below probe g."""
    marks = np.array(probes, f"S{WIDTH}")

    def count(batches):
        size, n = np.zeros(len(marks) + 1, np.int64), np.zeros(len(marks) + 1, np.int64)
        low, high = np.full(len(marks) + 1, b"\xff" * WIDTH, f"S{WIDTH}"), np.zeros(len(marks) + 1, f"S{WIDTH}")
        for b in batches:
            key = keys_of(b.column("key"))
            if not len(key):
                continue
            order = np.argsort(key, kind="stable")
            key, bytes_ = key[order], b.column("size").to_numpy()[order]
            begin = np.concatenate([[0], np.searchsorted(key, marks, "left"), [len(key)]])
            full = np.flatnonzero(begin[1:] > begin[:-1])
            a, e = begin[full], begin[full + 1]
            run = np.concatenate([[0], np.cumsum(bytes_)])
            size[full] += run[e] - run[a]
            n[full] += e - a
            low[full] = np.where(key[a] < low[full], key[a], low[full])
            high[full] = np.where(key[e - 1] > high[full], key[e - 1], high[full])
        full = np.flatnonzero(n)
        whole = lambda x: pa.array([v.ljust(WIDTH, b"\0") for v in x[full].tolist()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(size[full]), pa.array(n[full]), whole(low), whole(high)], ["gap", "size", "n", "low", "high"])

    found = rows.select("key", "size").mapInArrow(count, "gap int, size long, n long, low binary, high binary")
    found = found.groupBy("gap").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return {r.gap: (r["size"], r.n, bytes(r.low), bytes(r.high)) for r in found.collect()}


def find_splitters(rows: DataFrame, total: int, goals: list[tuple[int, int]], tolerance: list[int]) -> Splitters:
    """Splitters of rows (key, size) of total bytes. goals: numerator and denominator of each target, of total, rising; tolerance: bytes that each may be off, 0 for as near as whole rows allow."""
    target = [(a * total, b) for a, b in goals]  # target x b
    found: dict[int, tuple[bytes, int, int]] = {}
    # what lies between two keys (both within): bytes and rows below, bytes and rows in it
    bracket = {s: (0, (1 << 8 * WIDTH) - 1, 0, 0, total) for s in range(len(goals))}
    rounds = 0
    while bracket:
        ranges = sorted({v[:2] for v in bracket.values()})
        per = max(2, (min(MOST, PROBES * len(bracket)) if rounds else max(4096, FIRST * len(bracket))) // len(ranges))
        probes = sorted({_key(low + (high - low) * k // per + (k > 0)) for low, high in ranges for k in range(per + 1) if low + (high - low) * k // per + (k > 0) < 1 << 8 * WIDTH})
        gaps = counted(rows, probes)
        rounds += 1
        order = sorted(gaps)
        below, n_below = [], []
        at = n_at = 0
        for g in order:
            below.append(at)
            n_below.append(n_at)
            at, n_at = at + gaps[g][0], n_at + gaps[g][1]
        for s in list(bracket):
            goal, b = target[s]
            # the gap in which the bytes pass the target
            g = max(0, int(np.searchsorted(np.array([x * b - goal for x in below], object), 0, "right")) - 1)
            size, n, low, high = gaps[order[g]]
            ends = [(abs(below[g] * b - goal), low, below[g], n_below[g]), (abs((below[g] + size) * b - goal), gaps[order[g + 1]][2] if g + 1 < len(order) else None, below[g] + size, n_below[g] + n)]
            best = min(ends, key=lambda e: e[0])
            # ties and rows that can't be cut: a row goes where its middle byte is
            if low == high or best[0] <= tolerance[s] * b:
                _, key, by, rows_below = best
                found[s] = (key if key is not None else b"\xff" * WIDTH, by, rows_below)
                del bracket[s]
            else:
                bracket[s] = (_number(low), _number(high), below[g], n_below[g], size)
    cuts = [found[s] for s in range(len(goals))]
    return Splitters([c[0] for c in cuts], [c[2] for c in cuts], [c[1] for c in cuts], rounds)


def _keyed(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """key, size, crc, _id and with carry _row, the whole row; texts are hashed as UTF-8."""
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []
    rows = rowed(docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), *whole))
    half = lambda c: F.unhex(F.substring(F.md5(c.cast("binary")), 1, 16))
    key = F.concat(half(F.col("text")), half(F.coalesce(F.col("_id").cast("string"), F.lit(""))), F.unhex(F.lpad(F.hex("__row"), 16, "0")))
    return rows.select(key.alias("key"), (F.octet_length("text").cast("long") + OVERHEAD).alias("size"), F.crc32(F.col("text").cast("binary")).alias("crc"), "_id", *(["_row"] if carry else []))


def _placed(rows: DataFrame, total: int, n_rows: int, shards: int, tolerance: float, pieces: int) -> tuple[DataFrame, Splitters]:
    """rows (key, size, ...) with shard, piece and the piece's first slot; pieces: ranges of a shard."""
    goals = [(k, shards * pieces) for k in range(1, shards * pieces)]
    # shards are cut as exactly as asked for, ranges within them roughly
    allowed = [int(tolerance * total / shards) if k % pieces == 0 else total // (shards * pieces * 4) for k, _ in goals]
    cut = find_splitters(rows, total, goals, allowed)
    marks = np.array(cut.keys, f"S{WIDTH}")
    shard_first = [0] + [cut.rows[k * pieces - 1] for k in range(1, shards)]
    first = [0, *cut.rows]
    offset = np.array([first[p] - shard_first[p // pieces] for p in range(shards * pieces)], np.int64)
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in rows.columns] + ["piece int", "first long"])

    def place(batches):
        for b in batches:
            piece = np.searchsorted(marks, keys_of(b.column("key")), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(piece), pa.array(offset[piece])], [*b.schema.names, "piece", "first"])

    return rows.mapInArrow(place, schema).withColumn("shard", F.floor(F.col("piece") / pieces).cast("int")), cut


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.0, pieces: int | None = None, carry: bool = False) -> DataFrame:
    """_id, size, crc, shard, slot of each row of docs, and with carry the whole row as _row. tolerance: share of a shard that its ends may be off, 0 for as near as whole rows allow."""
    spark = docs.sparkSession
    slim = durable(_keyed(docs, id_col, text_col, carry))
    total, n = slim.agg(F.sum("size"), F.count("*")).first()
    if not n:
        none = slim.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
        return none.select("_id", "size", "crc", "shard", "slot", *(["_row"] if carry else []))
    pieces = pieces or -(-max(64, 4 * partitions(spark)) // shards)
    placed, _ = _placed(slim, total, n, shards, tolerance, pieces)
    order = Window.partitionBy("piece").orderBy("key")
    return placed.select("_id", "size", "crc", "shard", (F.col("first") + F.row_number().over(order) - 1).alias("slot"), *(["_row"] if carry else []))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """docs as Parquet under path, a folder for each shard, with columns shard and slot; the files of a shard hold ranges of slots in order."""
    out = shard(docs, carry=True, **options)
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    out.select(*[F.col(f"_row.`{c}`").alias(c) for c in own], "shard", "slot").write.partitionBy("shard").parquet(path)


def op12_sharding(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of all documents, in 24 shards of bytes."""
    rows = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(F.col("_id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The checksum is made bit by bit from its polynomial, the order is that of the keys, and a row belongs to the shard of its middle byte.
SQL = """WITH bits AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, coalesce(text, '') AS x, strlen(coalesce(text, '')) + 8 AS size, md5(coalesce(text, ''))[:16] AS h1, md5(coalesce(doc_id::varchar, ''))[:16] AS h2 FROM documents),
texts AS (SELECT DISTINCT x, hex(encode(x)) AS h FROM d),
crc AS (SELECT x, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(h), 2), lambda i: ('0x' || h[i:i+1])::bigint)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295::bigint) AS text_crc32 FROM texts, bits),
o AS (SELECT *, sum(size) OVER (ORDER BY h1, h2 ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM d JOIN crc USING (x)),
s AS (SELECT *, ((2 * before + size) * 24 // (2 * total))::int AS shard FROM o)
SELECT doc_id, size::bigint AS size, text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY h1, h2) - 1)::bigint AS slot, NULL::int AS grown_shard FROM s"""
