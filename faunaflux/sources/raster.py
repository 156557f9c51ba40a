"""Rasters as tables of cells, and benchmarks of one species on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import SEED
from ..operators import resample, spatial
from ..schemas import DataError
from .survey import extract_at_points


@dataclass(frozen=True)
class RasterStack:
    """cells: row, col and one column for each band, all of one grid; x0, y0: the outer corner of cell (0, 0); dx, dy: a cell's size."""

    cells: DataFrame
    bands: tuple[str, ...]
    x0: float
    y0: float
    dx: float
    dy: float
    crs: str = "EPSG:4326"
    nodata: float | None = None

    @classmethod
    def of(cls, layers: dict[str, DataFrame], x0: float, y0: float, dx: float, dy: float, **more) -> RasterStack:
        """Layers (row, col, value) of one grid as bands, in order of names; a cell that a layer lacks is null there."""
        if not layers:
            raise DataError("a stack needs a layer")
        long = None
        for name in sorted(layers):
            part = layers[name].select("row", "col", F.lit(name).alias("band"), F.col("value").cast("double").alias("value"))
            long = part if long is None else long.unionByName(part)
        wide = long.groupBy("row", "col").pivot("band", sorted(layers)).agg(F.first("value"))
        return cls(wide, tuple(sorted(layers)), x0, y0, dx, dy, **more)

    @property
    def geographic(self) -> bool:
        return "4326" in self.crs or "longlat" in self.crs.lower()

    def profile(self) -> DataFrame:
        """One row: extent in cells, bands and cells that have all bands."""
        return self.cells.agg(F.max("row").alias("last_row"), F.max("col").alias("last_col"), F.count("*").alias("n_cells"), F.count_if(self.valid()).alias("n_valid")).withColumn("crs", F.lit(self.crs)).withColumn("n_bands", F.lit(len(self.bands)))

    def valid(self):
        ok = F.lit(True)
        for b in self.bands:
            ok = ok & F.col(b).isNotNull() & ~F.isnan(F.col(b).cast("double"))
            if self.nodata is not None:
                ok = ok & (F.col(b) != self.nodata)
        return ok

    def extract(self, points: DataFrame) -> DataFrame:
        return extract_at_points(self.cells, points, self.x0, self.y0, self.dx, self.dy, list(self.bands), self.nodata)

    def background(self, n: int, seed: int = SEED, exclude: DataFrame | None = None, radius: float = 0.0) -> DataFrame:
        """cell, x, y (centres) and bands of n valid cells in a seeded order."""
        c = self.cells.where(self.valid()).withColumn("cell", F.concat_ws(":", "row", "col"))
        c = c.withColumn("x", F.lit(self.x0) + (F.col("col") + 0.5) * self.dx).withColumn("y", F.lit(self.y0) - (F.col("row") + 0.5) * self.dy)
        return resample.sample_background(c, n, seed, exclude, radius).select("cell", "x", "y", *self.bands)


@dataclass(frozen=True)
class RasterDataset:
    """Occurrences of one species (x, y and maybe occ, and a row key) on a stack; without background rows, valid cells are drawn."""

    stack: RasterStack
    occurrences: DataFrame
    key: str
    species: str = "species"
    region: str = "user"
    n_background: int = 10_000
    seed: int = SEED

    def training_frame(self) -> DataFrame:
        """region, group, siteid, spid, x, y, occ, bands: the union of occurrences with what the raster holds there, and of background."""
        o = self.occurrences
        if missing := [c for c in ("x", "y", self.key) if c not in o.columns]:
            raise DataError(f"missing columns: {', '.join(missing)}")
        occ = F.coalesce(F.expr("try_cast(occ as int)"), F.lit(1)) if "occ" in o.columns else F.lit(1)
        site = F.concat(F.lit("occ"), F.col(self.key).cast("string"))
        out = self.stack.extract(o.select(site.alias("siteid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), occ.alias("occ")))
        if not out.where("occ = 0").limit(1).count():
            b = self.stack.background(self.n_background, self.seed).select(F.concat(F.lit("bg"), "cell").alias("siteid"), "x", "y", F.lit(0).alias("occ"), *self.stack.bands)
            out = out.unionByName(b)
        return out.select(F.lit(self.region).alias("region"), F.lit(None).cast("string").alias("group"), "siteid", F.lit(self.species).alias("spid"), "x", "y", "occ", *self.stack.bands)

    def to_task(self, test_size: float = 0.2) -> tuple[DataFrame, DataFrame]:
        """Training and test rows: one spatial fold of about test_size is held out. The test rows are records like the others, not a survey of their own."""
        n = max(2, round(1 / test_size))
        t = spatial.spatial_folds(self.training_frame(), ["region", "spid"], n)
        return t.where("fold != 0").drop("fold", "block"), t.where("fold = 0").drop("fold", "block")
