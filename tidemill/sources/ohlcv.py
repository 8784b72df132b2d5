"""Reading and normalising candles and quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Other names of the canonical columns.
ALIASES = {"time": "timestamp", "datetime": "timestamp", "date": "timestamp", "timestamp_utc": "timestamp", "vol": "volume", "tick_volume": "volume"}
FORMATS = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy.MM.dd HH:mm:ss", "yyyy.MM.dd HH:mm", "yyyy-MM-dd"]


def normalised_names(df: DataFrame) -> DataFrame:
    """Lower-case names without brackets and blanks, aliases resolved (the first of equal names is kept)."""
    seen, kept = set(), []
    for c in df.columns:
        name = c.strip().strip("<>").lower().replace(" ", "_")
        name = ALIASES.get(name, name)
        if name not in seen:
            kept.append(F.col(f"`{c}`").alias(name))
            seen.add(name)
    return df.select(*kept)


def parsed_time(text: Column, unit: str | None = None) -> Column:
    """Timestamp from text of several formats, or from epoch numbers of a known unit (s, ms, us, ns)."""
    number = F.expr("0L") if unit is None else text.try_cast("decimal(38,0)")
    if unit:
        micros = {"s": number * 1_000_000, "ms": number * 1_000, "us": number, "ns": F.floor(number / 1_000)}[unit]
        return F.timestamp_micros(micros.cast("long")).cast("timestamp_ntz")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in FORMATS]).cast("timestamp_ntz")


def epoch_unit(df: DataFrame, column: str) -> str | None:
    """Unit of a numeric time column by the median magnitude; null for text. One action over the whole column."""
    number = F.abs(F.col(column).try_cast("double"))
    row = df.agg(F.count(column).alias("n"), F.count(number).alias("k"), F.percentile(number, 0.5).alias("m")).first()
    if not row["n"] or row["k"] < row["n"]:
        return None
    return next((u for least, u in ((1e17, "ns"), (1e14, "us"), (1e11, "ms")) if row["m"] >= least), "s")


def prepared(raw: DataFrame, ordinal: str | None = None) -> DataFrame:
    """Canonical candles: names, times and numbers parsed, rows without a time dropped, the last of equal times kept."""
    df = normalised_names(raw)
    unit = epoch_unit(df, "timestamp")
    order = F.col(ordinal) if ordinal else F.monotonically_increasing_id()
    numbers = [F.col(c).try_cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")]
    rows = df.select(parsed_time(F.col("timestamp").cast("string"), unit).alias("ts"), *numbers, order.alias("_order"))
    row = F.struct("open", "high", "low", "close", "volume")
    kept = rows.filter("ts is not null").groupBy("ts").agg(F.max_by(row, "_order").alias("_row"))
    return kept.select("ts", "_row.*")


def read_ohlcv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Candles of CSV files with a header; the order of equal times is that of file and line."""
    raw = spark.read.csv(path, header=True, sep=sep).withColumn("_at", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))
    return prepared(raw, "_at")


def read_terminal_bars(spark: SparkSession, path: str, point: float = 0.01) -> DataFrame:
    """Tab-separated terminal export: date, time, open, high, low, close, tick volume, volume, spread in points."""
    raw = spark.read.csv(path, header=True, sep="\t")
    expected = ["date", "time", "open", "high", "low", "close", "tickvol", "vol", "spread"]
    names = [c.strip().strip("<>").lower() for c in raw.columns]
    if names != expected:
        raise ValueError(f"unexpected header: {names}")
    df = raw.toDF(*expected)
    stamp = parsed_time(F.concat_ws(" ", "date", "time"))
    numbers = [F.col(c).try_cast("double").alias(c) for c in ("open", "high", "low", "close")]
    spread = F.col("spread").try_cast("double")
    return df.select(stamp.alias("ts"), *numbers, F.col("tickvol").try_cast("double").alias("volume"), spread.alias("spread_points"), (spread * point).alias("spread_price"))


def write_ohlcv(df: DataFrame, path: str) -> None:
    """CSV with ISO times; Spark's committer publishes all files or none."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")
    df.select(stamp, "open", "high", "low", "close", "volume").write.mode("overwrite").csv(path, header=True)


def normalised_quotes(ticks: DataFrame) -> DataFrame:
    """Quotes that are finite, positive and not crossed, with the spread in price, percent and basis points."""
    good = F.lit(True)
    for side in ("bid", "ask"):
        good &= F.col(side).isNotNull() & ~F.isnan(side) & (F.abs(F.col(side)) < float("inf"))
    rows = ticks.filter(good & (F.col("bid") > 0) & (F.col("ask") >= F.col("bid")))
    spread, middle = F.col("ask") - F.col("bid"), (F.col("ask") + F.col("bid")) / 2
    return rows.withColumns({"spread": spread, "spread_percent": spread / middle * 100, "spread_bps": spread / middle * 10_000})


def merged(*feeds: DataFrame) -> DataFrame:
    """Union of candle tables; for equal times the later table wins."""
    parts = [df.withColumn("_order", F.lit(i)) for i, df in enumerate(feeds)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    kept = [c for c in feeds[0].columns if c != "ts"]
    return rows.groupBy("ts").agg(F.max_by(F.struct(*kept), "_order").alias("_row")).select("ts", "_row.*")
