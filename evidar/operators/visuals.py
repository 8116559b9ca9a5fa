"""Chart and picture candidates from sampled pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Thresholds and weights.
DARK, LIGHT, COLOURED = 238, 245, 30
MIN_WIDTH, MIN_HEIGHT = 160, 120


def visual_features(samples: DataFrame) -> DataFrame:
    """Rules, crop box and score of every page worth a closer look.

    ``samples``: doc_id, number, width, height, native_text_length, x, y, red, green, blue; a grid of
    at most about a hundred points per line, so a line window is small.
    """
    light = (F.col("red") + F.col("green") + F.col("blue")) / 3
    spread = F.greatest("red", "green", "blue") - F.least("red", "green", "blue")
    page = ["doc_id", "number", "width", "height", "native_text_length"]
    line = Window.partitionBy("doc_id", "number", "y").orderBy("x")
    marked = samples.filter((F.col("width") >= MIN_WIDTH) & (F.col("height") >= MIN_HEIGHT)).withColumn("_fg", light < DARK).withColumn(
        "_colour", (spread > COLOURED) & (light < LIGHT))
    marked = marked.withColumn("_edge", F.col("_fg") != F.coalesce(F.lag("_fg").over(line), F.lit(False)))
    boxed = F.col("_colour") | (F.col("_fg") & (F.col("native_text_length") < 160))
    inside = lambda c: F.when(boxed, F.col(c))
    share = lambda c: F.avg(F.col(c).cast("double"))
    pages = marked.groupBy(*page).agg(
        share("_fg").alias("fg"), share("_colour").alias("colour"), share("_edge").alias("edges"),
        F.min(inside("x")).alias("x0"), F.min(inside("y")).alias("y0"), F.max(inside("x")).alias("x1"), F.max(inside("y")).alias("y1"))
    w, h, n = F.col("width"), F.col("height"), F.col("native_text_length")
    image = (n < 120) & (F.col("fg") > 0.035)
    chart = (F.col("colour") > 0.012) & ((F.col("fg") > 0.025) | (F.col("edges") > 0.08))
    diagram = (n < 700) & (F.col("fg") > 0.07) & (F.col("edges") > 0.11)
    xs, xe, ys, ye = F.floor(w * 0.04), F.ceil(w * 0.96), F.floor(h * 0.08), F.ceil(h * 0.92)
    step_x = F.greatest(F.lit(2), F.floor((xe - xs) / 96))
    step_y = F.greatest(F.lit(2), F.floor((ye - ys) / 72))
    has_x, has_y = F.coalesce(F.col("x0") < F.col("x1"), F.lit(False)), F.coalesce(F.col("y0") < F.col("y1"), F.lit(False))
    pages = pages.filter(image | chart | diagram).select(
        *page, "fg", "colour", "edges", image.alias("_image"), chart.alias("_chart"),
        F.when(has_x, F.col("x0")).otherwise(xs).alias("_x"), F.when(has_y, F.col("y0")).otherwise(ys).alias("_y"),
        F.when(has_x, F.col("x1") - F.col("x0") + step_x).otherwise(xe - xs).alias("_w"),
        F.when(has_y, F.col("y1") - F.col("y0") + step_y).otherwise(ye - ys).alias("_h"))
    small = (F.col("_w") < w * 0.28) | (F.col("_h") < h * 0.22)
    pad_x, pad_y = F.floor(w * 0.025), F.floor(h * 0.025)
    x = F.when(small, F.floor(w * 0.08)).otherwise(F.least(F.greatest(F.col("_x") - pad_x, F.lit(0)), w - 1))
    y = F.when(small, F.floor(h * 0.14)).otherwise(F.least(F.greatest(F.col("_y") - pad_y, F.lit(0)), h - 1))
    pages = pages.withColumn("x", x).withColumn("y", y)
    crop_w = F.when(small, F.floor(w * 0.84)).otherwise(F.least(F.greatest(F.col("_w") + pad_x * 2, F.lit(1)), w - F.col("x")))
    crop_h = F.when(small, F.floor(h * 0.72)).otherwise(F.least(F.greatest(F.col("_h") + pad_y * 2, F.lit(1)), h - F.col("y")))
    score = F.col("colour") * 5 + F.col("fg") * 1.6 + F.col("edges") * 1.2 + F.when(F.col("_image"), 0.18).otherwise(0.0)
    rule = F.when(F.col("_image"), "image_heavy").when(F.col("_chart"), "chart_like").otherwise("monochrome_diagram")
    return pages.select(
        "doc_id", "number", rule.alias("rule"), *[c.cast("bigint").alias(name) for name, c in
                                                  (("x", F.col("x")), ("y", F.col("y")), ("crop_width", crop_w), ("crop_height", crop_h))],
        F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 4).alias("score"))
