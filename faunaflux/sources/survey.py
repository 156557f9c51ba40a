"""Survey tables: regional presence, background, presence-absence and environment records in one partitioned layout."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import binary_label
from ..operators import tasks
from ..schemas import DataError

TABLES = ("po", "bg", "pa", "env")
#: Regions and their reference systems.
REGIONS = {"AWT": ("EPSG:28355", False), "CAN": ("EPSG:4008", True), "NSW": ("EPSG:4326", True), "NZ": ("EPSG:27200", False), "SA": ("EPSG:4326", True), "SWI": ("EPSG:21781", False)}
CATEGORICAL = ("ontveg", "vegsys", "toxicats", "age", "calc")


class SurveyDataset:
    """Tables under <root>/tbl=<table>/region=<region>: a region and a table are partitions, so that only their files are read. A folder of <REGION>_<table>.parquet is read as it is, too."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str, region: str | None = None) -> DataFrame:
        if name not in TABLES:
            raise DataError(f"unknown table {name!r}; known: {', '.join(TABLES)}")
        read = self.spark.read.option("mergeSchema", "true").parquet
        try:
            df = read(f"{self.root}/tbl={name}")
        except AnalysisException:
            # the name of a file says its region: files of others are not opened
            df = read(f"{self.root}/{region.upper() if region else '*'}_{name}.parquet")
        return df if region is None else df.where(F.col("region") == region.upper())

    def write(self, df: DataFrame, name: str, mode: str = "append") -> None:
        if name not in TABLES:
            raise DataError(f"unknown table {name!r}; known: {', '.join(TABLES)}")
        tasks.coerce_types(df, tuple(c for c in CATEGORICAL if c in df.columns)).write.mode(mode).partitionBy("region").parquet(f"{self.root}/tbl={name}")

    def ingest_csv(self, path: str, name: str, region: str) -> None:
        """A CSV with NA for what is missing."""
        raw = self.spark.read.option("header", "true").option("nullValue", "NA").option("inferSchema", "true").csv(path)
        self.write(raw.withColumn("region", F.lit(region.upper())), name)

    def ingest_folder(self, folder: str) -> list[tuple[str, str]]:
        """Every <REGION>_<table>.csv of a folder (region, table): other files are left alone, none at all is an error. The driver sees names of files only."""
        jvm = self.spark._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{folder}/*_*.csv")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
        done = []
        for path in sorted(str(f.getPath()) for f in found):
            region, _, name = path.rsplit("/", 1)[-1].removesuffix(".csv").rpartition("_")
            if region in REGIONS and name in TABLES:
                self.ingest_csv(path, name, region)
                done.append((region, name))
        if not done:
            raise DataError(f"no tables of a survey in {folder}")
        return done

    def species(self) -> DataFrame:
        return self.table("po").select("region", "spid").distinct()

    def summary(self) -> DataFrame:
        count = lambda n: self.table(n).groupBy("region").agg(F.count("*").alias(f"n_{n}"))
        out = self.species().groupBy("region").agg(F.count("*").alias("n_species"))
        for n in TABLES:
            out = out.join(count(n), "region", "left")
        return out.na.fill(0)

    def training(self) -> DataFrame:
        return tasks.training_table(self.table("po").withColumn("occ", F.lit(1)), self.table("bg"), self.species())

    def testing(self, order: str = "_ord") -> DataFrame:
        env = self.table("env")
        if order not in env.columns:
            env = env.withColumn(order, F.col("siteid"))
        return tasks.test_table(self.table("pa"), env, order)

    def species_of(self, regions: list[str] | None = None, names: list[str] | None = None, most: int | None = None) -> DataFrame:
        """region, spid of tasks in order of region and species: of some regions or species, or the first so many."""
        if unknown := sorted({r.upper() for r in regions or ()} - set(REGIONS)):
            raise DataError(f"unknown regions: {', '.join(unknown)}; known: {', '.join(REGIONS)}")
        t = self.species()
        t = t if regions is None else t.where(F.col("region").isin([r.upper() for r in regions]))
        t = t if names is None else t.where(F.col("spid").isin(names))
        return t.orderBy("region", "spid") if most is None else t.orderBy("region", "spid").limit(most)

    def iter_tasks(self, regions: list[str] | None = None, names: list[str] | None = None, most: int | None = None, order: str = "_ord") -> tuple[DataFrame, DataFrame]:
        """Training and test rows of those tasks, all in two tables."""
        wanted = self.species_of(regions, names, most)
        return self.training().join(wanted, ["region", "spid"], "left_semi"), self.testing(order).join(wanted, ["region", "spid"], "left_semi")

    def n_tasks(self, regions: list[str] | None = None, most: int | None = None) -> int:
        return self.species_of(regions, None, most).count()

    def is_available(self) -> bool:
        """Whether all tables can be read."""
        try:
            return all(self.table(n).columns for n in TABLES)
        except AnalysisException:
            return False

    def metadata(self, path: str) -> DataFrame:
        return self.spark.read.option("multiLine", "true").json(path)


def read_csv(spark: SparkSession, path: str, target: str = "presence", coordinates: tuple[str, str] = ("longitude", "latitude"), predictors: list[str] | None = None, species: str = "species", region: str = "user") -> DataFrame:
    """A user's table in the internal columns; predictors are what is left if none are named."""
    raw = spark.read.option("header", "true").option("inferSchema", "true").option("nullValue", "NA").csv(path)
    if target not in raw.columns:
        raise DataError(f"target {target!r} is missing")
    names = predictors or [c for c in raw.columns if c not in (target, *coordinates)]
    place = [(F.col(c).cast("double") if c in raw.columns else F.lit(None).cast("double")).alias(n) for c, n in zip(coordinates, ("x", "y"), strict=True)]
    # a number for each row in the order of the file, whatever its splits: rows of partitions before it, and its place
    raw = raw.withColumn("_m", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_m", 33))
    before, offsets = 0, []
    for r in sorted(raw.groupBy("_part").count().collect()):  # a row for each partition
        offsets.append((r["_part"], before))
        before += r["count"]
    raw = raw.join(F.broadcast(spark.createDataFrame(offsets, "_part long, _off long")), "_part").withColumn("_ord", F.col("_off") + F.col("_m").bitwiseAND((1 << 33) - 1))
    return raw.select(F.lit(region).alias("region"), F.lit(species).alias("spid"), F.concat(F.lit("row"), F.col("_ord").cast("string")).alias("siteid"), "_ord", *place, binary_label(target, strict=True).alias("occ"), *names)


def species_groups(metadata: DataFrame, column: str, species: list[str]) -> DataFrame:
    """spid, group from a JSON object of species, or an array in the order of species; NA, nan, None and empty are null."""
    first = F.substring(F.ltrim(F.col(column)), 1, 1)
    as_map = F.from_json(column, "map<string,string>")
    as_list = F.map_from_arrays(F.slice(F.array(*[F.lit(s) for s in species]), F.lit(1), F.size(F.from_json(column, "array<string>"))), F.from_json(column, "array<string>"))
    pairs = metadata.select(F.explode(F.when(first == "{", as_map).otherwise(as_list)).alias("spid", "group"))
    clean = F.trim("group")
    return pairs.withColumn("group", F.when(~clean.isin("NA", "", "nan", "None"), clean))


def extract_at_points(cells: DataFrame, points: DataFrame, x0: float, y0: float, dx: float, dy: float, bands: list[str], nodata: float | None = None) -> DataFrame:
    """points with the bands of the raster cell they are in, by an equi-join on row and column; nodata is null."""
    p = points.withColumn("col", F.floor((F.col("x") - x0) / dx)).withColumn("row", F.floor((F.lit(float(y0)) - F.col("y")) / dy))
    value = lambda b: F.when(F.col(b) != nodata, F.col(b)) if nodata is not None else F.col(b)
    c = cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *[value(b).alias(b) for b in bands])
    return p.join(c, ["row", "col"], "left").drop("row", "col")


def score_cells(cells: DataFrame, bands: list[str], score) -> DataFrame:
    """row, col, block, value: a score of cells with all bands, null elsewhere; block is the 512 x 512 window of a cell."""
    whole = F.lit(True)
    for b in bands:
        whole = whole & F.col(b).isNotNull()
    block = F.concat_ws(":", F.floor(F.col("row") / 512).cast("string"), F.floor(F.col("col") / 512).cast("string"))
    return cells.select("row", "col", block.alias("block"), F.when(whole, score).alias("value"))


def embeddings(spark: SparkSession, path: str, key: str, column: str = "embedding") -> DataFrame:
    """Precomputed embeddings by row key, from Parquet, or from text with one column for each dimension."""
    if path.rstrip("/").endswith((".csv", ".tsv")):
        raw = spark.read.option("header", "true").option("inferSchema", "true").option("sep", "\t" if path.endswith(".tsv") else ",").csv(path)
        return raw.select(key, F.array(*[F.col(c).cast("float") for c in raw.columns if c != key]).alias(column))
    return spark.read.parquet(path).select(key, F.col(column).cast("array<float>").alias(column))
