from pyspark.sql import functions as F

import corpus_pipeline
from faunaflux.llm import registry

SF = "/root/testdata/sf0.001"


def test_stages_and_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert 0 < docs.count() <= before
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert "times" in docs.columns and docs.where("times < 1").count() == 0


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "###", None, None, None), (3, "words of a text", None, "b", 15), (3, "words of a text", None, "b", 15), (4, "a\nb\nc\nd", "en", None, 7), (5, "a\nb\nc\nd", "en", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() is not None
        assert stage(spark, docs.limit(0), SF).count() == 0
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs, SF).collect()}
    assert kept == {3, 4, 5}
    assert {r.doc_id for r in corpus_pipeline.duplicate_stage(spark, docs, SF).collect()} == {None, 1, 2, 3, 4}
    assert {r.doc_id for r in corpus_pipeline.line_stage(spark, docs, SF).collect()} == {None, 1, 2, 3, 4}


def test_clashing_columns(spark, tmp_path):
    """Extra columns with the names that the operators use inside, through all stages and all operators on documents."""
    names = ["_id", "_text", "block", "kind", "key", "times", "rank", "h", "src", "size", "l", "pos", "first", "n", "sig", "_source", "bin", "base", "other"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for c in names:
        docs = docs.withColumn(c, F.lit(c))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert set(docs.columns) <= set(out.columns) and out.where("block != 'block'").count() == 0 and out.count() > 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, query in registry.queries().items():
        # those of embeddings read no documents, and one needs the benchmark, too
        if name not in ("op5_decontaminate", "op7_ann", "op11_vector_codes", "op13_whitening"):
            assert query(spark, str(tmp_path)).count() == 60, name


def test_null_and_repeated_rows(spark, tmp_path):
    """Exactly one row of each group stays, from files and from memory, and rows without a doc_id are searched like others."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 200").orderBy("item_id").first().text
    text = " ".join(f"word{i} stands" for i in range(40))
    lines = "first line of it\nsecond line of it\nthird line of it"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    row = lambda i, t: (i, t, "en", "a", len(t))
    copies = [row(None, text)] * 3 + [row(7, text)] * 2 + [row(None, "another text of only null rows here")] * 2
    repeated = [row(None, lines)] * 3 + [row(2, lines)] * 2
    leaks = [row(None, item), row(3, item), row(3, text)]
    for k, (stage, rows, want) in enumerate([
        (corpus_pipeline.duplicate_stage, copies, [(None, "another text of only null rows here"), (7, text)]),
        (corpus_pipeline.line_stage, repeated, [(2, lines)]),
        (corpus_pipeline.benchmark_stage, leaks, [(3, text)]),
    ]):
        docs = spark.createDataFrame(rows, schema)
        docs.repartition(3).write.parquet(f"{tmp_path}/{k}")
        for d in (docs, spark.read.parquet(f"{tmp_path}/{k}")):
            assert sorted(((r.doc_id, r.text) for r in stage(spark, d, SF).collect()), key=repr) == sorted(want, key=repr), (k, d)
