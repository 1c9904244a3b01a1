"""Line dedup by distinct-site spread, in DataFrame functions only.

A line is a boilerplate line if, with outer spaces removed, it occurs on at least ``min_sites`` distinct sites.
Spread is estimated by a HyperLogLog sketch per line hash, merged by aggregation; lines whose estimate is within
``band`` of the threshold get an exact distinct count. Boilerplate lines are then removed from every document, whatever their
share of it; only a document that holds no line of its own, which is a copy as a whole, stays as it is, for document-level
dedup to decide. (Optional: with ``whole`` set, a document of which they make up more than that share of the
characters stays too.)

Every site of a line counts once before lines meet, so a hot line is some rows; the flagged hashes are a written table, whose size
the optimiser knows. Only hashes meet in shuffles: a document's boilerplate hashes come back by the hash of its text, so copies share
them, and hot lines are a row per document and hash against one flagged row that Spark may split. Hashes
are 64-bit; a collision among texts is harmless (only flagged lines are ever removed).

Defined cases: a null text stays null with 0 lines; blank lines are never boilerplate and stay; a null site is a
site of its own; repeated lines of a document count once; an empty table gives an empty result; other columns
pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import Scratch

MIN_SITES = 10
BAND = 0.25
#: Registers of a sketch are 2**LG_K: a standard error of 3 per cent, and exact while a line has few sites.
LG_K = 10


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_hash(x: Column) -> Column:
    return F.xxhash64(F.trim(x))


def hashes(text: Column) -> Column:
    """Distinct hashes of the lines that are not blank."""
    return F.array_distinct(F.transform(F.filter(split_lines(text), lambda x: F.trim(x) != ""), line_hash))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, band: float = BAND, lg_k: int = LG_K) -> DataFrame:
    """(h): hashes that occur on at least ``min_sites`` distinct sites, of rows (h, site string)."""
    site = F.coalesce(F.concat(F.lit("s"), F.col("site")), F.lit("null"))
    lines = lines.select("h", site.alias("site"))
    spread = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("about")).where(F.col("about") >= min_sites * (1 - band))
    sure = spread.where(F.col("about") > min_sites * (1 + band)).select("h")
    near = spread.where(F.col("about") <= min_sites * (1 + band)).select("h")
    exact = lines.distinct().join(near, "h", "left_semi").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("h")
    return sure.union(exact)


def remove_boilerplate(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, band: float = BAND, lg_k: int = LG_K, whole: float | None = None) -> DataFrame:
    """Rows (row struct, n_lines, n_flagged, n_removed, new_text): ``row`` is the input row as it was."""
    d = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    own = docs.select(F.xxhash64(text_col).alias("key"), F.col(site_col).cast("string").alias("site"), F.explode(hashes(F.col(text_col))).alias("h"))
    flagged = Scratch(docs.sparkSession, "lines").save("flagged", boilerplate(own.select("h", "site"), min_sites, band, lg_k))
    hits = own.select("key", "h").join(flagged, "h", "left_semi").groupBy("key").agg(F.collect_set("h").alias("hits"))
    d = d.join(hits, "key", "left")
    lines = split_lines(F.col("text"))
    flag = lambda x: F.array_contains("hits", line_hash(x)) & (F.trim(x) != "")
    d = d.withColumn("kept", F.when(F.col("hits").isNotNull(), F.filter(lines, lambda x: ~flag(x))))
    d = d.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"))
    d = d.withColumn("n_flagged", F.when(F.col("kept").isNull(), 0).otherwise(F.col("n_lines") - F.size("kept")).cast("long"))
    d = d.withColumn("rest", F.array_join("kept", "\n"))
    # characters that go: the lines and the ends they lose with them
    gone = F.char_length("text") - F.char_length("rest")
    stays = F.exists("kept", lambda x: F.trim(x) != "") if whole is None else gone <= whole * F.char_length("text")
    cut = (F.col("n_flagged") > 0) & stays
    d = d.withColumn("cut", F.coalesce(cut, F.lit(False)))
    return d.select("row", "n_lines", "n_flagged", F.when(F.col("cut"), F.col("n_flagged")).otherwise(0).cast("long").alias("n_removed"), F.when(F.col("cut"), F.col("rest")).otherwise(F.col("text")).alias("new_text"))


def dedup(docs: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """The documents without boilerplate lines, in their own columns (``n_chars``, if there, is counted anew)."""
    d = remove_boilerplate(docs, text_col, **kw)
    cols = []
    for f in docs.schema.fields:
        c = F.col(f"row.`{f.name}`")
        if f.name == text_col:
            c = F.col("new_text")
        elif f.name == "n_chars":
            c = F.when(F.col("n_removed") > 0, F.char_length("new_text").cast(f.dataType)).otherwise(c)
        cols.append(c.alias(f.name))
    return d.select(*cols)


def oracle(table: str = "documents", min_sites: int = MIN_SITES) -> str:
    """The same in SQL, with exact counts throughout."""
    return f"""
WITH l AS (SELECT DISTINCT source, trim(x) AS line FROM (SELECT source, unnest(string_split(text, chr(10))) AS x FROM {table}) WHERE trim(x) <> ''),
f AS (SELECT line FROM l GROUP BY line HAVING count(DISTINCT coalesce('s' || source, 'null')) >= {min_sites}),
s AS (SELECT list(line) AS all_lines FROM f),
d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(s.all_lines, []), trim(x))) AS kept FROM {table}, s),
e AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN 0 ELSE len(lines) END AS n_lines, CASE WHEN text IS NULL THEN 0 ELSE len(lines) - len(kept) END AS n_flagged, array_to_string(kept, chr(10)) AS rest, len(list_filter(kept, lambda x: trim(x) <> '')) > 0 AS own FROM d),
g AS (SELECT *, coalesce(n_flagged > 0 AND own, false) AS cut FROM e)
SELECT doc_id, n_lines, n_flagged, CASE WHEN cut THEN n_flagged ELSE 0 END AS n_removed, CASE WHEN cut THEN rest ELSE text END AS clean_text FROM g
"""
