"""One-dimensional signals and histograms: smoothing, bands, thresholds, contrast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def moving_mean(df: DataFrame, width: int = 5) -> DataFrame:
    """(series, pos, val) with ``smooth``: the mean over ``width`` places, those beyond the ends counting 0."""
    half = width // 2
    around = Window.partitionBy("series").orderBy("pos").rangeBetween(-half, half)
    return df.withColumn("smooth", F.sum("val").over(around) / width)


def bands(df: DataFrame, share: float = 0.05, margin: int = 4, least: int = 8) -> DataFrame:
    """(series, top, bottom): runs of places whose smoothed value exceeds ``share`` of the series' highest."""
    smooth = moving_mean(df)
    size = smooth.groupBy("series").agg((F.max("smooth") * share).alias("level"), (F.max("pos") + 1).alias("size"))
    order = Window.partitionBy("series").orderBy("pos")
    on = smooth.join(size, "series").withColumn("on", F.col("smooth") > F.col("level"))
    starts = (F.col("on") & ~F.coalesce(F.lag("on").over(order), F.lit(False))).cast("int")
    runs = on.withColumn("run", F.sum(starts).over(order)).where("on")
    found = runs.groupBy("series", "run").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.first("size").alias("size"))
    open_ = F.col("b") + 1 >= F.col("size")
    cut = found.select("series", F.greatest(F.lit(0), F.col("a") - margin).alias("top"), F.when(open_, F.col("size")).otherwise(F.least(F.col("size"), F.col("b") + 1 + margin)).alias("bottom"), open_.alias("open"))
    return cut.where(F.col("open") | (F.col("bottom") - F.col("top") > least)).drop("open")


def otsu(df: DataFrame, value: str = "val", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, threshold): the value that parts a histogram with the greatest variance between its two sides, the least of equals."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    low = counts.withColumns({"w": F.sum("n").over(upto), "s": F.sum(F.col("n") * F.col(value)).over(upto), "tw": F.sum("n").over(whole), "ts": F.sum(F.col("n") * F.col(value)).over(whole)})
    rest = F.col("tw") - F.col("w")
    gap = F.col("s") / F.col("w") - (F.col("ts") - F.col("s")) / F.nullif(rest, F.lit(0))
    low = low.withColumn("between", F.coalesce(F.col("w") * rest * gap * gap, F.lit(0.0)))
    best = F.max_by(value, F.struct("between", (-F.col(value)).alias("o"))).alias("threshold")
    return low.groupBy(*keys).agg(best) if keys else low.agg(best)


def contrast_stretch(df: DataFrame, value: str = "val", low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Values mapped so that two exact percentiles become 0 and 255, clipped; a constant signal stays."""
    ends = df.agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("p"))
    joined = df.join(F.broadcast(ends))  # one row
    spread = F.col("p")[1] - F.col("p")[0]
    to = F.least(F.greatest((F.col(value) - F.col("p")[0]) / F.nullif(spread, F.lit(0.0)) * 255, F.lit(0.0)), F.lit(255.0))
    return joined.withColumn("stretched", F.when(spread > 0, to).otherwise(F.col(value).cast("double"))).drop("p")


def variation(df: DataFrame, keys: list[str], value: str = "val", most: float = 2.0) -> DataFrame:
    """(keys, cov): deviation over mean, at most ``most``, halved; 0.5 for fewer than ten values."""
    cov = F.least(F.stddev_pop(value) / F.nullif(F.avg(value), F.lit(0.0)), F.lit(most)) / most
    return df.groupBy(*keys).agg(F.when((F.count(value) < 10) | (F.avg(value) == 0), 0.5).otherwise(cov).alias("cov"))


def box_variation(df: DataFrame, keys: list[str], height: str = "height", width: str = "width", page: str = "page_height") -> DataFrame:
    """(keys, height_variance): deviation over mean of box heights between 0.5 % and 20 % of the page; 0.5 below five, at most 1."""
    fit = (F.col(height) > F.col(page) * 0.005) & (F.col(height) < F.col(page) * 0.2) & (F.col(width) > 3)
    h = F.when(fit, F.col(height))
    return df.groupBy(*keys).agg(F.when(F.count(h) < 5, 0.5).otherwise(F.least(F.stddev_pop(h) / F.avg(h), F.lit(1.0))).alias("height_variance"))


def median_angle(df: DataFrame, keys: list[str], angle: str = "angle", within: float = 45.0) -> DataFrame:
    return df.where(F.abs(angle) <= within).groupBy(*keys).agg(F.percentile(angle, 0.5).alias("slant"))


def density_bonus(dark):
    """The factor for a page's share of dark pixels: 1 within 3 % to 25 %, falling off around 12 % beyond."""
    return F.when(dark.between(0.03, 0.25), 1.0).otherwise(F.greatest(1 - 3 * F.abs(dark - 0.12), F.lit(0.05)))


def scaled_size(width, height, least: int = 1200):
    """Size of an image enlarged until its longer side has ``least`` pixels."""
    scale = F.lit(least) / F.greatest(width, height)
    grow = F.greatest(width, height) < least
    return F.when(grow, F.floor(width * scale)).otherwise(width).cast("int"), F.when(grow, F.floor(height * scale)).otherwise(height).cast("int")


def cropped(pixels: DataFrame, margin: int = 10) -> DataFrame:
    """Pixel rows (doc, row, col, val, h, w) without a border of ``margin``."""
    return pixels.where((F.col("row") >= margin) & (F.col("row") < F.col("h") - margin) & (F.col("col") >= margin) & (F.col("col") < F.col("w") - margin))
