"""Each stage of the pipeline against a brute-force version, on documents of the gate's tables and on planted ones."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from faunaflux.llm import language_id

from .test_decontaminate import brute as brute_items
from .test_jaccard_join import brute as brute_links
from .test_others import water

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows(spark):
    """Real documents, near copies and planted passages of them; texts are kept short so that brute force ends."""
    random.seed(12)
    real = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 4000").orderBy("doc_id").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out, key = list(real), 10_000
    for k, (_, text, lang, source, _) in enumerate(real[:40]):
        words = text.split(" ")
        if len(words) > 30:
            words[random.randrange(len(words))] = "changed"
        planted = text + " " + random.choice(items) + " " if k % 4 == 0 else " ".join(words)
        if k % 5 == 0:
            planted = planted + "\nline one of it\nline two of it\nline three of it\nthe end " + str(k)
        out.append((key + k, planted, lang, source, len(planted)))
    return out + [(20_000, None, None, None, None), (20_001, "### 12", "en", None, 6), (20_002, "", "en", "x", 0)]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('stage')}/documents.parquet"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_language_stage(spark, rows, docs):
    """Exactly the documents with a letter stay, as they are."""
    want = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    assert plain(corpus_pipeline.language_stage(spark, docs, SF)) == sorted(want, key=repr)


def test_line_stage(spark, rows, docs):
    seen, want = {}, []
    for r in sorted(rows):
        lines = (r[1] or "").split("\n")
        for k in range(len(lines) - 2):
            window = tuple(lines[k : k + 3])
            if "".join(window).replace(" ", ""):
                seen.setdefault(window, (r[0], k))
    for r in rows:
        lines, gone = (r[1] or "").split("\n"), set()
        for k in range(len(lines) - 2):
            first = seen.get(tuple(lines[k : k + 3]))
            if first is not None and first != (r[0], k):
                start = max(k, first[1] + 3) if first[0] == r[0] else k
                gone |= set(range(start, k + 3))
        text = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if not gone:
            want.append(r)
        elif text.strip():
            want.append((r[0], text, r[2], r[3], len(text)))
    assert plain(corpus_pipeline.line_stage(spark, docs, SF)) == sorted(want, key=repr)
    assert len(want) < len(rows) or any(len(a[1] or "") < len(b[1] or "") for a, b in zip(sorted(want, key=repr), sorted(rows, key=repr)))


def test_duplicate_stage(spark, rows, docs):
    links = brute_links([(r[0], r[1]) for r in rows])
    want = [r for r in rows if not links[r[0]][1] or links[r[0]][0] == r[0]]
    assert plain(corpus_pipeline.duplicate_stage(spark, docs, SF)) == sorted(want, key=repr) and len(want) < len(rows)


def test_benchmark_stage(spark, rows, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = {i for i, _ in brute_items([(r[0], r[1]) for r in rows], items)}
    want = [r for r in rows if r[0] not in found]
    assert plain(corpus_pipeline.benchmark_stage(spark, docs, SF)) == sorted(want, key=repr) and 5 < len(found) < len(rows)


def test_mixing_stage(spark, rows, docs):
    """Sources come within one document of their targets; a document is taken as often as another of its source, or once more; others are not there."""
    out = corpus_pipeline.mixing_stage(spark, docs, SF).collect()
    by_id = {r[0]: r for r in rows}
    size = {i: len(re.findall(r"[^\x20\t-\r]+", r[1] or "")) for i, r in by_id.items()}
    sizes, taken, times = {}, {}, {}
    for i, r in by_id.items():
        sizes[r[3]] = sizes.get(r[3], 0) + size[i]
    for r in out:
        assert tuple(r)[:5] == by_id[r.doc_id] and 1 <= r.times <= 3
        taken[r.source] = taken.get(r.source, 0) + r.times * size[r.doc_id]
        times.setdefault(r.source, set()).add(r.times)
    longest = max(size.values())
    for s, want in water(sizes).items():
        assert abs(taken.get(s, 0) - want) <= longest and max(times.get(s, {0})) - min(times.get(s, {0})) <= 1


def test_run_is_its_stages(spark, rows, docs, tmp_path):
    """run() gives what the stages give one after another, each on what the one before kept."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}-{name}")
        now = spark.read.parquet(f"{tmp_path}/{k}-{name}")
    sizes = {r.source: 0 for r in now.collect()}
    for r in now.collect():
        sizes[r.source] += len(re.findall(r"[^\x20\t-\r]+", r.text or ""))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {r.doc_id for r in now.collect()}
    taken = {}
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + r.times * len(re.findall(r"[^\x20\t-\r]+", r.text or ""))
    assert all(abs(taken.get(s, 0) - want) <= 2000 for s, want in water(sizes).items())


def test_language_model_reads_no_labels_of_what_it_judges(spark, docs):
    """The stage's model is learned from the other folds only."""
    learned = docs.where(language_id.fold(5) != 0)
    assert learned.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).count() == 0
