"""Language identification as multilingual mixture inference.

Each language has a distribution over hashed byte trigrams centred on letters. Per document, expectation-maximisation estimates the proportions
of the languages from the likelihoods of its trigrams; the set of languages is chosen by penalised likelihood: the k largest languages are fitted
again, and the k with the best log-likelihood less half k log n is taken, of all k up to the number of languages that could still win. Everything is trained on all labelled rows; counts are summed within
tasks, then by language and slice of the table.

Defined results: null or letterless text gives `und` with score 0, as does any text if nothing could be learned; rows without a language teach
nothing; very long texts are judged whole; ties go to the language that sorts first; rows are judged one by one, so repeated rows repeat their result; a null identifier counts as
the empty text for the held-out fold; extra columns are carried, and those with the names of result columns are replaced. The set that is shown lists shares
of more than 0.005; a model has at most MOST_LANGUAGES languages, more are an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import bytescan as bs

BUCKET_BITS = 15
SLICES = 8
SMOOTHING = 0.5
ROUNDS, AGAIN = 15, 8
MOST_LANGUAGES = 1024  # bounds the model that tasks get; more is an error, not a cut
PIECE = 1 << 19

_LOW = bs.LOWER.astype(np.uint32)
_LOW[bs.SPACE] = 32
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[97:123] = True
_IS_LETTER[128:] = True


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    probability: np.ndarray  # buckets x languages


def trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams centred on letter bytes, edges of documents as spaces; their n + 1 offsets."""
    low = _LOW[data]
    before, after = np.empty_like(low), np.empty_like(low)
    before[1:], after[:-1] = low[:-1], low[1:]
    real = at[:-1] < at[1:]
    before[at[:-1][real]] = 32
    after[at[1:][real] - 1] = 32
    centre = np.flatnonzero(_IS_LETTER[low])
    key = (before[centre] << 16) | (low[centre] << 8) | after[centre]
    key = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
    return key, np.searchsorted(centre, at)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    size = 1 << BUCKET_BITS

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for row, end, data, at in bs.pieces(b.column(0)):
                key, out = trigrams(data, at)
                names = b.column(1).slice(row, end - row).to_pylist()
                for lang in set(names):
                    pick = np.repeat(np.array([x == lang for x in names]), np.diff(out))
                    total[lang] = total.get(lang, 0) + np.bincount(key[pick], minlength=size)
        rows = [(lang, s, c.astype(np.int64).tobytes()) for lang, t in sorted(total.items()) for s, c in enumerate(np.split(t, SLICES))]
        if rows:
            a, b, c = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], ["lang", "slice", "counts"])

    def add(batches):
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            for lang, s, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                total[lang, s] = total.get((lang, s), 0) + np.frombuffer(c, np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["lang", "slice", "counts"])

    schema = "lang string, slice int, counts binary"
    rows = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{text_col}`").cast("string"), F.col(f"`{lang_col}`").cast("string"))
    summed = rows.mapInArrow(count, schema).repartition("lang", "slice").mapInArrow(add, schema).limit(MOST_LANGUAGES * SLICES + 1).collect()  # read once: the model, of bounded size
    languages = sorted({r.lang for r in summed}, key=lambda x: x.encode())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = np.zeros((size, len(languages)))
    for r in summed:
        part = size // SLICES
        table[r.slice * part : (r.slice + 1) * part, languages.index(r.lang)] = np.frombuffer(r.counts, np.int64)
    table += SMOOTHING
    return LanguageModel(tuple(languages), (table / table.sum(0)).astype(np.float32))


def mixture(p: np.ndarray, often: np.ndarray, starts: np.ndarray, owner: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for the proportions of each document (rows of share); its log-likelihood at the end."""
    total = np.add.reduceat(often, starts)[:, None]
    for _ in range(rounds):
        weight = often / np.maximum(np.einsum("ij,ij->i", p, share[owner]), 1e-30)
        share = share * np.add.reduceat(p * weight[:, None], starts) / total
    return share, np.add.reduceat(often * np.log(np.maximum(np.einsum("ij,ij->i", p, share[owner]), 1e-30)), starts)


def infer(model: LanguageModel, column: pa.Array) -> list[tuple[str, float, str]]:
    """For each text: language, its share, and the chosen set with shares."""
    out: list[tuple[str, float, str]] = [("und", 0.0, "")] * len(column)
    n_lang = len(model.languages)
    if not n_lang:
        return out
    for row, end, data, at in bs.pieces(column, max(1, PIECE * 16 // max(16, n_lang))):
        key, off = trigrams(data, at)
        doc = np.repeat(np.arange(end - row, dtype=np.int64), np.diff(off))
        cell, often = np.unique((doc << BUCKET_BITS) | key, return_counts=True)
        if not len(cell):
            continue
        doc, key, often = cell >> BUCKET_BITS, cell & ((1 << BUCKET_BITS) - 1), often.astype(np.float32)
        starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        rows = doc[starts]
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(doc))))
        p = model.probability[key]
        share, full = mixture(p, often, starts, owner, np.full((len(starts), n_lang), 1 / n_lang, np.float32), ROUNDS)
        rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
        n = np.add.reduceat(often, starts)
        # by concavity no mixture exceeds this log-likelihood, so a document is done when the penalty alone rules out any larger set
        weight = often / np.maximum(np.einsum("ij,ij->i", p, share[owner]), 1e-30)
        bound = full + np.maximum(np.add.reduceat(p * weight[:, None], starts).max(1) - n, 0) + 1e-3 + 1e-5 * np.abs(full)
        best, chosen = np.full(len(starts), -np.inf), np.zeros_like(share)
        open_ = np.arange(len(starts))
        for k in range(1, n_lang + 1):
            open_ = open_[bound[open_] - 0.5 * k * np.log(np.maximum(n[open_], 2)) > best[open_]]
            if not len(open_):
                break
            s = np.where(rank[open_] < k, np.maximum(share[open_], 1e-6), 0).astype(np.float32)
            here = np.zeros(len(starts), bool)
            here[open_] = True
            cells = np.flatnonzero(here[owner])
            its = np.searchsorted(open_, owner[cells])
            s, ll = mixture(p[cells], often[cells], np.flatnonzero(np.append(True, its[1:] != its[:-1])), its, s / s.sum(1, keepdims=True), AGAIN if k > 1 else 0)
            value = ll - 0.5 * k * np.log(np.maximum(n[open_], 2))
            better = open_[value > best[open_]]
            chosen[better], best[better] = s[value > best[open_]], value[value > best[open_]]
        top = chosen.argmax(1)
        for r, t, c in zip((rows + row).tolist(), top.tolist(), chosen.tolist(), strict=True):
            names = sorted((x for x in range(n_lang) if c[x] > 0.005), key=lambda x: (-c[x], x))
            out[r] = (model.languages[t], min(1.0, max(0.0, c[t])), ",".join(f"{model.languages[x]}:{c[x]:.2f}" for x in names))
    return out


def has_letter(text_col: str = "text") -> Column:
    return F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score", set_col: str = "lang_set") -> DataFrame:
    """The rows of docs with three more columns. A column of docs that has one of these names is replaced."""
    docs = docs.drop(pred_col, score_col, set_col).withColumn("__letter", has_letter(text_col))
    schema = StructType([*docs.drop("__letter").schema.fields, StructField(pred_col, StringType()), StructField(score_col, DoubleType()), StructField(set_col, StringType())])
    at, letter = docs.columns.index(text_col), len(docs.columns) - 1

    def run(batches):
        for b in batches:
            found = [x if ok else ("und", 0.0, "") for x, ok in zip(infer(model, b.column(at).cast(pa.string())), b.column(letter).to_pylist(), strict=True)]
            extra = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:letter], *extra], names=schema.names)

    return docs.mapInArrow(run, schema)


def fold(folds: int, id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % folds


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, lang_set over all documents; learned from the rows of the other folds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where(fold(5) != 0))
    out = identify(docs.select("doc_id", "text", (fold(5) == 0).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "lang_set")
