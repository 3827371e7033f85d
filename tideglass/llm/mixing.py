"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key.  Keys are dealt into ranges within each source; prefix sums
of the ranges' word counts say which ranges lie wholly before the source's budget and which range
holds the cut, and only that range of each source is summed document by document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free, written

WEIGHTS, SHARE, MOST_EPOCHS = (3, 1, 2), 1.5, 2
#: Leading hex digits of the key that number a range: 16**3 ranges in each source.
RANGE_DIGITS = 3


def _targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """One row per source with its target: weight * level, or `most` times its size if that is less.

    Sources in order of the size at which they reach their limit (limit / weight); the first k of them
    are limited, k being the first number for which the level of the others is below the next limit.
    """
    n = len(weights)
    every = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("rank", F.row_number().over(every.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), F.pmod(F.col("rank") - 1, F.lit(n)).cast("int") + 1)
    limit = F.col("source_size") * float(most)
    ranked = ranked.withColumn("w", w).withColumn("limit", limit).withColumn("full_at", limit / w)
    before = every.orderBy("full_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    onward = every.orderBy("full_at", "rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(every) * share)
        .withColumn("spent", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("w").over(onward))
    )
    # the level if this and all later sources are open; it is the true one where it first stays under the limit
    here = (F.col("total") - F.col("spent")) / F.col("open")
    ranked = ranked.withColumn("level", F.min(F.when(here <= F.col("full_at"), F.struct("full_at", "rank", here.alias("x")))).over(every)["x"])
    target = F.when(F.col("level").isNull() | (F.col("w") * F.col("level") >= F.col("limit")), F.col("limit")).otherwise(F.col("w") * F.col("level"))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, seed: int = 0) -> DataFrame:
    """Per row of docs: doc_id, source, size, tie (text digest), source_size, target, copies, taken (= copies * size).

    size is the number of words (null or empty text: 0).  Sources in code-point order, null last,
    weigh `weights` in turn and share `share` times all words; no target is above `most` times its
    source's words.  A source gives floor(target / source_size) whole epochs, then its documents in
    key order up to the rest of its budget; the document at the cut is taken if that brings the sum
    nearer the target (a half: taken).  Ties of the key (same id) go by size, then by text digest; rows that are alike
    in all of these count one after another.  The same rows always give the same mix.
    Null ids share a key; empty tables give an empty result; other columns are not read.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), key.alias("key"), F.xxhash64("text").alias("tie"))
    # narrow: one row of a few numbers for each document, so that texts are read once
    sized = written(sized.withColumn("range", F.conv(F.substring("key", 1, RANGE_DIGITS), 16, 10).cast("int")), "mix-sizes")
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    targets = _targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, most)
    # a source has at most 16**RANGE_DIGITS ranges
    before = F.sum("range_size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.withColumn("before", F.coalesce(before, F.lit(0)))
    r, t = ranges.alias("r"), targets.alias("t")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    placed = (
        r.join(t, F.col("r.source").eqNullSafe(F.col("t.source")))
        .select(F.col("r.source").alias("source"), "range", "before", "range_size", "source_size", "target", epochs.alias("epochs"))
        .withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("side", F.when(F.col("before") + F.col("range_size") <= F.col("budget"), 1).when(F.col("before") >= F.col("budget"), 0).otherwise(-1))
    )
    d, p = sized.alias("d"), placed.alias("p")
    rows = d.join(p, (F.col("d.range") == F.col("p.range")) & F.col("d.source").eqNullSafe(F.col("p.source"))).select(
        "doc_id", F.col("d.source").alias("source"), "size", "key", "tie", F.col("d.range").alias("range"), "before", "source_size", "target", "epochs", "budget", "side"
    )
    out = ["doc_id", "source", "size", "tie", "source_size", "target"]
    whole = rows.where("side >= 0").select(*out, (F.col("epochs") + F.col("side")).alias("copies"))
    order = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("before") + F.sum("size").over(order)
    cut = rows.where("side < 0").withColumn("upto", upto).select(*out, (F.col("epochs") + (F.col("upto") - F.col("size") / 2.0 <= F.col("budget")).cast("int")).alias("copies"))
    return whole.unionByName(cut).withColumn("copies", F.col("copies").cast("bigint")).withColumn("taken", F.col("copies") * F.col("size"))


def expand(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """docs with each row repeated as often as `mixed` (of the same docs) says, null ids and repeated rows too.

    Rows alike in id, source and text share the copies of all of them evenly; the first ones (in order of the other
    columns) have what is left over, as only rows at a source's cut have.
    """
    key = ["doc_id", "source", "tie"]
    p = free(docs, "mixed_")
    m = mixed.groupBy(*key).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("alike")).where("copies > 0")
    m = m.select(*(F.col(c).alias(f"{p}{c}") for c in key), F.floor(F.col("copies") / F.col("alike")).alias(f"{p}each"), (F.col("copies") % F.col("alike")).alias(f"{p}rest"))
    m = written(m, "mix-copies")
    d = docs.withColumn(f"{p}own", F.xxhash64("text"))
    joined = d.join(m, F.col("doc_id").eqNullSafe(F.col(f"{p}doc_id")) & F.col("source").eqNullSafe(F.col(f"{p}source")) & (F.col(f"{p}own") == F.col(f"{p}tie")))
    even = joined.where(f"{p}rest = 0").select(*docs.columns, F.col(f"{p}each").alias(f"{p}copies"))
    # one group for each source at most
    number = F.row_number().over(Window.partitionBy("doc_id", "source", f"{p}own").orderBy(*docs.columns))
    uneven = joined.where(f"{p}rest > 0").select(*docs.columns, (F.col(f"{p}each") + (number <= F.col(f"{p}rest")).cast("int")).alias(f"{p}copies"))
    out = even.unionByName(uneven).where(f"{p}copies > 0")
    return out.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(f"{p}copies").cast("int"))).alias(f"{p}epoch")).select(*docs.columns)


def oracle_sql(relation: str = "documents", seed: int = 0) -> str:
    """DuckDB SQL for the columns doc_id, size, source_size, target, taken of `mix` over a relation with unique ids."""
    return f"""
    WITH sized AS (
        SELECT doc_id, source, COALESCE(LEN(REGEXP_EXTRACT_ALL(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, MD5('{seed}:' || COALESCE(doc_id::VARCHAR, 'null')) AS key
        FROM {relation}),
    sources AS (SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source),
    ranked AS (SELECT *, ROW_NUMBER() OVER (ORDER BY source IS NULL, source) AS rank FROM sources),
    weighed AS (SELECT *, [3.0, 1.0, 2.0][(rank - 1) % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS lim FROM ranked),
    summed AS (
        SELECT *, SUM(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS total,
            COALESCE(SUM(lim) OVER (ORDER BY lim / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS spent,
            SUM(w) OVER (ORDER BY lim / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS open
        FROM weighed),
    level AS (SELECT ARG_MIN((total - spent) / open, spent) AS x FROM summed WHERE (total - spent) / open <= lim / w),
    targets AS (SELECT source, source_size, CASE WHEN x IS NULL OR w * x >= lim THEN lim ELSE w * x END AS target FROM summed LEFT JOIN level ON TRUE),
    summed_docs AS (
        SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN FLOOR(t.target / t.source_size) ELSE 0 END AS epochs,
            SUM(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
        FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
        (size * (epochs + CASE WHEN source_size > 0 AND upto - size / 2.0 <= target - epochs * source_size AND target > epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM summed_docs
    """
