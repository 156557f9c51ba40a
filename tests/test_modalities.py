import pytest
from pyspark.sql import functions as F

from faunaflux.operators.cache import ArtefactCache
from faunaflux.operators.modalities import EcoDataset
from faunaflux.plans.benchmarks import BENCHMARKS, RunConfig, provenance
from faunaflux.schemas import DataError


def dataset(spark):
    df = spark.range(6).select(F.col("id"), F.struct(F.col("id").alias("a"), (F.col("id") * 2).alias("b")).alias("climate"), F.array(F.lit(1.0), F.lit(2.0)).alias("emb"))
    return EcoDataset(df, "id", (("climate", "tabular"), ("emb", "embedding")))


def test_modalities(spark):
    d = dataset(spark)
    assert d.concat_tabular().columns == ["id", "climate__a", "climate__b", "emb__0", "emb__1"]
    assert d.without("emb").names == ["climate"] and d.without("emb").ablated == ("emb",)
    assert d.only("emb").as_table("emb").columns == ["id", "emb__0", "emb__1"]
    assert d.subset(spark.range(2)).df.count() == 2
    soil = spark.range(6).select("id", F.struct(F.lit(1).alias("ph")).alias("soil"))
    assert "soil__ph" in d.add("soil", "tabular", soil).concat_tabular().columns
    with pytest.raises(DataError):
        d.add("soil", "tabular", soil.limit(3))
    with pytest.raises(KeyError):
        d.without("nothing")


def test_artefacts(spark, tmp_path):
    c = ArtefactCache(spark, str(tmp_path))
    key = c.key(encoder="pca", k=2)
    made = []
    for _ in range(2):
        assert c.get_or_compute(key, lambda: made.append(1) or spark.range(3)).count() == 3
    assert made == [1] and (c.hits, c.misses) == (1, 1)


def test_configuration_and_recipes(spark):
    c = RunConfig.from_dict({"benchmark": "multi-region", "models": {"a": ["dummy"], "b": "knn,dummy"}, "odd": 1}, seed=None, scenarios=["spatial"])
    assert c.models == ("dummy", "knn") and c.extra == {"odd": 1} and c.scenarios == ("spatial",)
    with pytest.raises(DataError):
        BENCHMARKS.get("spatial-cv").make.validate_scenario("spatial")
    assert provenance(spark).where("not verified").count() == 2
