"""Line dedup by overlapping windows of three lines.

Every three consecutive lines of a document are hashed (128 bits). Windows found more than once have a first occurrence, by (identifier, position);
every later occurrence covers its lines, and the union of what is covered goes. Only hashes are shuffled for the search; the grouped minimum is
combined before the shuffle, so a window that a third of all documents hold costs one row for each map task.

Defined results: lines are split at newlines and compared as they are; a null text is an empty one; documents of fewer than three lines have no
window; windows of blank lines do not count; a later occurrence that overlaps the first one in the same document leaves the first one's lines;
rows that repeat an identifier are one document; rows without an identifier take no part and stay whole. An identifier that is a struct is taken as it
is, in its own order. Very long texts are windowed whole. Extra columns are carried as they are; only those with the names of the three result columns are replaced; names that begin with two underscores are the operator's own.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import NO_ID, keyed


def covered_lines(texts: DataFrame) -> DataFrame:
    """_id, ranges: array of (start, end) line positions, sorted, that later occurrences cover. texts: _id, _text."""
    lines = texts.where(F.instr("_text", "\n") > 0).select("_id", F.split("_text", "\n", -1).alias("l")).where(F.size("l") > 2)
    places = F.sequence(F.lit(0), F.size("l") - 3)

    def window(i):
        a, b, c = (F.col("l")[i + k] for k in range(3))
        text = F.concat_ws("\n", a, b, c)
        return F.struct(i.alias("pos"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), (F.length(F.trim(F.translate(text, "\n", ""))) > 0).alias("full"))

    windows = lines.select("_id", F.explode(F.transform(places, window)).alias("w")).where("w.full").select("_id", "w.pos", "w.h1", "w.h2")
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("_id", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(first, ["h1", "h2"]).where(F.struct("_id", "pos") > F.col("first"))
    start = F.when(F.col("first._id") == F.col("_id"), F.greatest(F.col("pos"), F.col("first.pos") + 3)).otherwise(F.col("pos"))
    ranges = later.select("_id", F.struct(start.alias("s"), (F.col("pos") + 2).alias("e")).alias("r")).where("r.s <= r.e")
    return ranges.groupBy("_id").agg(F.array_sort(F.collect_set("r")).alias("ranges"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept_col: str = "kept_text", lines_col: str = "n_lines", removed_col: str = "n_removed") -> DataFrame:
    """The rows of docs with three more columns: the text without covered lines, its lines before, and those removed."""
    docs = docs.drop(kept_col, lines_col, removed_col)
    if docs.schema[id_col].dataType.typeName() == "struct":
        whole = docs.withColumn("__id", F.col(f"`{id_col}`")).withColumn("__none", F.lit(0))
        texts = whole.select(F.col("__id").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    else:
        whole = docs.withColumn("__id", F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)))
        # rows without an identifier meet no range; they are spread by a number that no range has
        whole = whole.withColumn("__none", F.when(F.col("__id") == NO_ID, 1 + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))).otherwise(0).cast("int"))
        texts = keyed(docs, id_col, text_col).where(F.col("_id") != NO_ID)
    found = covered_lines(texts).select(F.col("_id").alias("__id"), F.lit(0).alias("__none"), F.col("ranges").alias("__r"))
    out = whole.join(found, ["__id", "__none"], "left")
    lines = F.split(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), "\n", -1)
    gone = F.array_distinct(F.flatten(F.transform("__r", lambda r: F.sequence(r["s"], r["e"]))))
    out = out.withColumn("__l", lines).withColumn("__k", F.when(F.col("__r").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("__l") - 1), gone)))
    kept = F.when(F.col("__r").isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(F.transform("__k", lambda i: F.col("__l")[i]), "\n"))
    out = out.withColumn(kept_col, kept).withColumn(lines_col, F.size("__l").cast("long"))
    out = out.withColumn(removed_col, F.when(F.col("__r").isNull(), 0).otherwise(F.size("__l") - F.size("__k")).cast("long"))
    return out.drop("__id", "__none", "__r", "__l", "__k")


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = line_dedup(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: The removed lines, in SQL: doc_id, i (position), l (line), gone.
LINES_SQL = """
d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM {docs}),
w AS (SELECT doc_id, pos, l[pos + 1] || chr(10) || l[pos + 2] || chr(10) || l[pos + 3] AS t FROM d, unnest(range(0, len(l) - 2)) AS u(pos)
      WHERE length(trim(l[pos + 1] || l[pos + 2] || l[pos + 3])) > 0),
f AS (SELECT t, min((doc_id, pos)) AS first FROM w GROUP BY t HAVING count(*) > 1),
r AS (SELECT w.doc_id, CASE WHEN first[1] = w.doc_id THEN greatest(pos, first[2] + 3) ELSE pos END AS s, pos + 2 AS e FROM w JOIN f USING (t) WHERE (w.doc_id, pos) > first),
gone AS (SELECT DISTINCT doc_id, i FROM r, unnest(range(s, e + 1)) AS u(i)),
lines AS (SELECT d.doc_id, u.i, l[u.i + 1] AS line, g.i IS NOT NULL AS removed FROM d CROSS JOIN unnest(range(0, len(l))) AS u(i) LEFT JOIN gone g ON g.doc_id = d.doc_id AND g.i = u.i)
"""
SQL = "WITH " + LINES_SQL.format(docs="documents") + """
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE removed) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT removed), '')) AS kept_sha256
FROM lines GROUP BY doc_id
"""
