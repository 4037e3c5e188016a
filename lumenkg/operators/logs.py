"""Logs: lines of events, spans that they open and close, and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Levels from the lowest.
LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR")
LINE = "tag string, id bigint, parent bigint, name string, ts timestamp_ntz, level string, target string, args map<string,string>"


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines of JSON as columns; a span without an id gets a hash of its name and arguments. Lines that are no events are left out."""
    own = lines.select(F.from_json(value, LINE, {"mode": "PERMISSIVE"}).alias("e")).select("e.*").where(F.col("tag").isin("open", "close", "message"))
    args = F.transform(F.array_sort(F.map_entries("args")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return own.withColumn("id", F.coalesce("id", F.xxhash64("name", F.concat_ws(",", args))))


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level)


def spans(lines: DataFrame, keys: tuple[str, ...] = ("span",), ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Each opening with the next closing of the same span before it opens again: opened, closed (null: still open), messages between."""
    pos = Window.partitionBy(*keys).orderBy(ts, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = lines.withColumn("nth", F.count_if(F.col("tag") == "open").over(pos)).where("nth > 0")
    since = Window.partitionBy(*keys, "nth").orderBy(ts, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumn("closes", F.count_if(F.col("tag") == "close").over(since))
    out = own.groupBy(*keys, "nth").agg(F.min(F.when(F.col("tag") == "open", F.col(ts))).alias("opened"), F.min(F.when(F.col("tag") == "close", F.struct(ts, order))).alias("end"), F.count_if((F.col("tag") == "message") & (F.col("closes") == 0)).cast("int").alias("messages"))
    return out.select(*keys, "nth", "opened", F.col("end")[ts].alias("closed"), "messages")


def tree(opens: DataFrame) -> DataFrame:
    """opens (id, parent): the parent, null (the root) where it is not open."""
    known = opens.select(F.col("id").alias("parent")).distinct().withColumn("there", F.lit(True))
    return opens.join(known, "parent", "left").select("id", F.when(F.col("there"), F.col("parent")).alias("parent"))


def duration(ms: Column) -> Column:
    """Milliseconds as text: 1d 2h 3m 4.005s, without leading zero units."""
    d, h, m = (F.floor(ms / n) for n in (86_400_000, 3_600_000, 60_000))
    s = F.format_string("%d.%03ds", F.floor(ms % 60_000 / 1000), ms % 1000)
    return F.concat_ws(" ", F.when(d > 0, F.concat(d, F.lit("d"))), F.when(h > 0, F.concat(h % 24, F.lit("h"))), F.when(m > 0, F.concat(m % 60, F.lit("m"))), s)


def moving_average(deltas: Column, scale: float = 0.5) -> Column:
    """Exponential average of an array: the first as it is, then scale x old + (1 - scale) x new."""
    step = lambda a, x: F.when(a.isNull(), x).otherwise(a * scale + x * (1 - scale))
    return F.aggregate(deltas, F.lit(None).cast("double"), step)


def moving_averages(rows: DataFrame, key: str, order: str, value: str, scale: float = 0.5, block: int = 4096) -> DataFrame:
    """key and average: moving_average() of the values of each key by order, a whole number that is unique.

    Values are averaged in blocks of the order, then blocks of a key in turn: an average that goes on from
    an older one differs from one that begins anew by (older - first) x scale ^ values.
    """
    own = rows.groupBy(key, F.floor(F.col(order) / block).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("vs"))
    part = F.struct("block", moving_average(F.col("vs"), scale).alias("fresh"), F.get("vs", F.lit(0)).alias("first"), F.pow(F.lit(scale), F.size("vs")).alias("left"), F.exists("vs", lambda v: v.isNull()).alias("anew"))
    parts = own.select(key, part.alias("part")).groupBy(key).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    step = lambda a, p: F.when(a.isNull() | p["anew"], p["fresh"]).otherwise(p["fresh"] + (a - p["first"]) * p["left"])
    return parts.select(key, F.aggregate("parts", F.lit(None).cast("double"), step).alias("average"))
