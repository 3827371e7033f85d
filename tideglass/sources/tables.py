"""The synthetic tables as metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.select import dealt
from .series import Catalog, TableSeries

#: What a row counts for at least, however well its file is compressed: what one of sf0.1's events takes.
ROW_BYTES = 20
#: Of a table in more files than these, the footers of so many are read.
FOOTERS = 8


def _millis(column: str):
    return F.unix_millis(F.col(column).cast("timestamp"))


def _between(column: str, before: int | None = 0, after: int = 0):
    """A filter on a timestamp column that the scan can use; a second wider on both sides, as it only spares work.

    before and after widen it further, in ms; before=None: no lower bound.
    """

    def prune(start: int, end: int):
        t = F.col(column).cast("timestamp")
        upper = t <= F.timestamp_millis(F.lit(end + 1000 + after))
        return upper if before is None else (t >= F.timestamp_millis(F.lit(start - 1000 - before))) & upper

    return prune


def _size(df: DataFrame) -> int:
    """Bytes of a table's files, as its scan knows them, or ROW_BYTES for each row where that is more: no job.

    What tasks hold goes with the rows, and rows that are alike take next to nothing in a file.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    rows, length = _footers(df)
    return max(size, size * rows * ROW_BYTES // max(length, 1))


def _footers(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of a Parquet table's files by their footers; of many files, of FOOTERS of them, evenly spread."""
    spark, files = df.sparkSession, sorted(df.inputFiles())
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    rows = length = 0
    for f in files[:: -(-len(files) // FOOTERS) or 1]:
        file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
        rows, length = rows + reader.getRecordCount(), length + file.getLength()
        reader.close()
    return rows, length


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """events_value and events_total by event_type and user_id, order_totalprice and ship_quantity by day, value_bucket by hour, and info series."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    events = table("events")
    size = _size(events)
    labels = {"event_type": F.col("event_type"), "user_id": F.col("user_id")}

    def running(start: int, end: int) -> DataFrame:  # counts all that came before, so only the end binds
        seen = dealt(events.where(_between("ts", None)(start, end)), size, ["event_type", "user_id"])
        return seen.withColumn("n", F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")))

    orders = table("orders").groupBy("o_orderpriority", "o_orderstatus", "o_orderdate").agg(F.sum("o_totalprice").alias("v"))
    lines = table("lineitem").groupBy("l_returnflag", "l_linestatus", "l_shipdate").agg(F.sum("l_quantity").alias("v"))
    hour = F.floor(_millis("ts") / 3_600_000) * 3_600_000
    bounds = ("10", "50", "100", "200", "+Inf")

    def bucket_counts(start: int, end: int) -> DataFrame:  # whole hours
        return counted(events.where(_between("ts", 0, 3_600_000)(start, end)))

    def counted(events: DataFrame) -> DataFrame:
        buckets = events.select(hour.alias("h"), "event_type", F.explode(F.array(*(F.struct(F.lit(b).alias("le"), (F.lit(True) if b == "+Inf" else F.col("value") <= float(b)).alias("hit")) for b in bounds))).alias("e"))
        return buckets.groupBy("event_type", F.col("e.le").alias("le"), "h").agg(F.sum(F.col("e.hit").cast("int")).cast("double").alias("v"))

    def info(start: int, end: int) -> DataFrame:  # whole days
        seen = events.where(_between("ts", 0, 86_400_000)(start, end))
        return seen.groupBy("event_type", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day")).agg(F.lit(1.0).alias("v"))

    return Catalog(
        {
            "events_value": TableSeries("events_value", events, _millis("ts"), F.col("value"), labels, _between("ts"), size=size),
            "events_total": TableSeries("events_total", running, _millis("ts"), F.col("n"), labels, size=size),
            "order_totalprice": TableSeries("order_totalprice", orders, _millis("o_orderdate"), F.col("v"), {"priority": F.col("o_orderpriority"), "status": F.col("o_orderstatus")}, _between("o_orderdate")),
            "ship_quantity": TableSeries("ship_quantity", lines, _millis("l_shipdate"), F.col("v"), {"flag": F.col("l_returnflag"), "status": F.col("l_linestatus")}, _between("l_shipdate")),
            "value_bucket": TableSeries("value_bucket", bucket_counts, F.col("h"), F.col("v"), {"event_type": F.col("event_type"), "le": F.col("le")}),
            "event_info": TableSeries("event_info", info, F.unix_millis("day"), F.col("v"), {"event_type": F.col("event_type"), "kind": F.substring("event_type", 1, 1)}),
        }
    )
