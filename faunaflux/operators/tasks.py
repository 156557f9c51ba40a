"""Assembly of training and test tables for all species at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite
from ..schemas import DataError

META = ["region", "group", "siteid", "spid", "x", "y", "occ"]


def unpivot_presence_absence(wide: DataFrame, ids: list[str], species: list[str]) -> DataFrame:
    """One column for each species to rows (ids, spid, occ)."""
    return wide.unpivot(ids, species, "spid", "occ")


def coerce_types(df: DataFrame, categorical: tuple[str, ...] = ()) -> DataFrame:
    """Identifiers and categories as strings, coordinates as doubles or null, occ as a number with 0 where it has no reading."""
    out = {}
    for c in df.columns:
        if c in ("region", "group", "siteid", "spid", *categorical):
            out[c] = F.col(c).cast("string")
        elif c in ("x", "y"):
            out[c] = finite(F.expr(f"try_cast(`{c}` as double)"))
        elif c == "occ":
            out[c] = F.coalesce(F.expr("try_cast(occ as bigint)"), F.lit(0))
    return df.withColumns(out)


def standardise(df: DataFrame, region: str, kind: str, order: str) -> DataFrame:
    """A presence (po) or background (bg) table with the meta columns first; occ and siteid are filled where they are missing."""
    out = df.withColumn("region", F.lit(region))
    if "group" not in df.columns:
        out = out.withColumn("group", F.lit(None).cast("string"))
    number = F.row_number().over(Window.orderBy(order)).cast("string") if "siteid" not in df.columns else None
    if number is not None:
        out = out.withColumn("siteid", number)
    default = F.lit(1 if kind == "po" else 0)
    out = out.withColumn("occ", F.coalesce(F.col("occ"), default) if "occ" in df.columns else default)
    return out.select(*[c for c in META if c in out.columns], *[c for c in df.columns if c not in META])


def first_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key. A grouped minimum that carries the row: combined before the shuffle, so a frequent key is no hot spot."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, *[F.col(f"r.`{c}`").alias(c) for c in rest])


def training_table(presences: DataFrame, background: DataFrame, species: DataFrame) -> DataFrame:
    """Presences of every species and, for every species of a region, the region's background (occ 0)."""
    bg = background.drop("spid").join(species.select("region", "spid"), "region")
    return presences.unionByName(bg.withColumn("occ", F.lit(0)), allowMissingColumns=True)


def test_table(pa: DataFrame, env: DataFrame, order: str) -> DataFrame:
    """Presence-absence sites with the first environment row of their site; sites without one go."""
    sites = first_by_key(env, ["region", "siteid"], order).drop(order)
    drop = [c for c in sites.columns if c in pa.columns and c not in ("region", "siteid")]
    return pa.join(sites.drop(*drop), ["region", "siteid"])


def in_group(pa: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of the species' survey group, where any row of the species has it; else all its rows. groups: spid, want."""
    t = pa.join(F.broadcast(groups) if groups.limit(100_001).count() <= 100_000 else groups, "spid", "left")
    seen = t.groupBy("region", "spid").agg(F.max((F.col("group") == F.col("want")).cast("int")).alias("any"))
    t = t.join(seen, ["region", "spid"])
    return t.where((F.coalesce(F.col("any"), F.lit(0)) == 0) | (F.col("group") == F.col("want"))).drop("any", "want")


def species_counts(train: DataFrame, test: DataFrame | None = None, keys=("region", "spid")) -> DataFrame:
    """n_presence and n_background of training rows, and n_test_presence and n_test_absence."""
    count = lambda df, a, b: df.groupBy(*keys).agg(F.count_if(F.col("occ") == 1).alias(a), F.count_if(F.col("occ") == 0).alias(b))
    out = count(train, "n_presence", "n_background")
    return out if test is None else out.join(count(test, "n_test_presence", "n_test_absence"), list(keys), "full").na.fill(0)


def both_classes(df: DataFrame, keys: list[str], y: str = "occ") -> DataFrame:
    """The groups that have both classes."""
    return df.groupBy(*keys).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("a")).where("p > 0 and a > 0").select(*keys)


def validate_occurrences(df: DataFrame, predictors: list[str], require_target: bool = True) -> None:
    missing = [c for c in ["x", "y", *(["occ"] if require_target else []), *predictors] if c not in df.columns]
    if missing:
        raise DataError(f"missing columns: {', '.join(missing)}")
    if require_target and df.where("occ is not null and occ not in (0, 1)").limit(1).count():
        raise DataError("occ must be 0 or 1")


def table_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row for each column: type, rows, nulls, distinct values, least and largest as text; one pass over the table."""
    columns = columns or df.columns
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(dict(df.dtypes)[c]).alias("type"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])
    t = df.select(F.explode(rows).alias("r")).select("r.*")
    return t.groupBy("column", "type").agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("n_null"), F.count_distinct("v").alias("n_distinct"), F.min("v").alias("least"), F.max("v").alias("largest"))


#: Name fragments by role and by modality.
ROLES = {"target": ("presence", "occ", "target", "label"), "longitude": ("lon", "longitude", "x"), "latitude": ("lat", "latitude", "y"), "species": ("species", "spid", "taxon"), "group": ("group",), "timestamp": ("date", "time", "year"), "identifier": ("id", "key"), "site": ("site",)}
MODALITIES = {"climate": ("bio", "temp", "precip", "clim"), "terrain": ("elev", "slope", "aspect", "terrain"), "soil": ("soil", "ph"), "vegetation": ("veg", "ndvi"), "landcover": ("land",), "hydrology": ("water", "river")}


def guess_roles(profile: DataFrame) -> DataFrame:
    """A role and confidence for each profiled column; the first rule that fits."""
    name = F.lower("column")
    has = lambda words: reduce(lambda a, b: a | b, [name.contains(w) if len(w) > 1 else name == w for w in words])
    numeric = F.col("type").isin("int", "bigint", "double", "float", "smallint", "tinyint") | F.col("type").startswith("decimal")
    two = (F.col("n_distinct") <= 2) & F.col("least").isin("0", "0.0") & F.col("largest").isin("1", "1.0")
    rules: list[tuple[Column, str, float]] = [
        (two & has(ROLES["target"]), "target", 0.95),
        (two & numeric, "target", 0.6),
        (numeric & has(ROLES["longitude"]), "longitude", 0.9),
        (numeric & has(ROLES["latitude"]), "latitude", 0.9),
        (has(ROLES["species"]), "species", 0.8),
        (has(ROLES["group"]) & (F.col("n_distinct") <= 50), "group", 0.7),
        (has(ROLES["timestamp"]) | F.col("type").isin("timestamp", "date"), "timestamp", 0.7),
        ((F.col("n_distinct") == F.col("n")) & (has(ROLES["identifier"]) | ~numeric), "identifier", 0.7),
        (has(ROLES["site"]), "site", 0.6),
        (~numeric, "categorical", 0.7),
        (F.col("type").isin("int", "bigint") & (F.col("n_distinct") <= 12), "categorical", 0.5),
    ]
    role, sure = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], F.lit(rules[0][2]))
    for ok, r, c in rules[1:]:
        role, sure = role.when(ok, r), sure.when(ok, F.lit(c))
    hint = reduce(lambda acc, kv: acc.when(has(kv[1]), kv[0]), list(MODALITIES.items())[1:], F.when(has(MODALITIES["climate"]), "climate"))
    return profile.withColumn("role", role.otherwise("predictor")).withColumn("confidence", sure.otherwise(F.lit(0.6))).withColumn("modality", hint)


def inspect(profile: DataFrame) -> tuple[DataFrame, list[str]]:
    """Guessed roles, and warnings about the table as a whole."""
    guesses = guess_roles(profile)
    n = {r.role: (r.n, r.cols) for r in guesses.groupBy("role").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("column")).alias("cols")).collect()}  # a row for each role
    out = []
    if ("longitude" in n) != ("latitude" in n):
        out.append("only one coordinate was found; places need both")
    if "target" not in n:
        out.append("no binary target was found; name one")
    elif n["target"][0] > 1:
        out.append(f"several columns look like targets: {', '.join(n['target'][1])}; name one")
    if not {"predictor", "categorical"} & set(n):
        out.append("no predictor was found")
    return guesses, out


def infer_categorical(df: DataFrame, predictors: list[str], most: int = 12) -> list[str]:
    """Predictors that are text, or whole numbers of at most so many values; one aggregate over the table."""
    kinds = dict(df.dtypes)
    whole = [c for c in predictors if kinds[c] in ("tinyint", "smallint", "int", "bigint")]
    few = df.agg(*[F.count_distinct(c).alias(c) for c in whole]).first() if whole else {}
    return [c for c in predictors if kinds[c] == "string" or (c in whole and few[c] <= most)]


def categorical_indices(features: list[str], categorical: list[str]) -> list[int]:
    """Places of the categorical columns among the features, in order."""
    return sorted(features.index(c) for c in set(categorical) if c in features)


def draft_schema(guesses: DataFrame) -> DataFrame:
    """The most certain column of each role that takes one."""
    return guesses.where("role not in ('predictor', 'categorical')").groupBy("role").agg(F.min_by("column", F.struct(-F.col("confidence"), "column")).alias("column"), F.max("confidence").alias("confidence"))


def validate_table(df: DataFrame, target: str, longitude: str | None = None, latitude: str | None = None, predictors: list[str] | None = None, min_positives: int = 5) -> list[tuple[str, str]]:
    """(level, message) of what is wrong with a user's table; one aggregate over it."""
    if target not in df.columns:
        return [("error", f"target {target!r} is missing")]
    predictors = predictors or [c for c in df.columns if c not in (target, longitude, latitude)]
    issues = [("error", f"predictor {c!r} is missing") for c in predictors if c not in df.columns]
    there = [c for c in predictors if c in df.columns]
    y = F.expr(f"try_cast(`{target}` as double)")
    aggs = [F.count("*").alias("n"), F.count_if(F.col(target).isNull()).alias("null_y"), F.count_if(y.isNotNull() & ~y.isin(0.0, 1.0)).alias("bad_y"), F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")]
    aggs += [F.count(c).alias(f"c_{i}") for i, c in enumerate(there)]
    for c, most in ((longitude, 180), (latitude, 90)):
        if c in df.columns:
            aggs.append(F.max(F.abs(F.expr(f"try_cast(`{c}` as double)"))).alias(f"most_{most}"))
    r = df.agg(*aggs).first().asDict()
    if r["null_y"]:
        issues.append(("error", f"{r['null_y']} rows have no target"))
    if r["bad_y"]:
        issues.append(("error", "the target is not binary"))
    if r["pos"] < min_positives:
        issues.append(("error", f"{r['pos']} presences; {min_positives} are needed"))
    if not r["neg"]:
        issues.append(("error", "no background rows"))
    issues += [("error", f"predictor {c!r} has no value") for i, c in enumerate(there) if r["n"] and not r[f"c_{i}"]]
    if r["pos"] and r["neg"] > 200 * r["pos"]:
        issues.append(("warning", "more than 200 background rows for each presence"))
    issues += [("warning", f"coordinates beyond {m} degrees") for m in (180, 90) if (r.get(f"most_{m}") or 0) > m]
    return issues
