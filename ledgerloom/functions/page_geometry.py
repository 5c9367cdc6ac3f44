"""Boxes of words on pages: from raster pixels to page points, around character ranges, and page verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POINTS_PER_INCH = 72.0
# Shares of ink, the rows that make a text, and the drop that starts a line.
EMPTY_INK, DARK_INK, PLATE_SHARE, TEXT_ROWS, LINE_BREAK = 0.002, 0.5, 0.25, 40, 0.6


def quarter_turn(reported: Column) -> Column:
    """A turn stated as an index of quarters or in degrees, as degrees; others are null."""
    degrees = F.when(reported.between(-3, 3), reported * 90).otherwise(reported)
    turn = (degrees % 360 + 360) % 360
    return F.when(turn % 90 == 0, turn.cast("int"))


def raster_to_page(left: Column, top: Column, right: Column, bottom: Column, dpi: Column, width: Column, height: Column, rotation: Column) -> Column:
    """struct(x0, y0, x1, y1): an upright pixel box in unrotated page points, ordered lower left to upper right."""
    scale = F.lit(POINTS_PER_INCH) / dpi
    l, t, r, b = left * scale, top * scale, right * scale, bottom * scale
    xs = F.when(rotation == 0, F.array(l, r)).when(rotation == 90, F.array(t, b)).when(rotation == 180, F.array(width - l, width - r)).otherwise(F.array(width - t, width - b))
    ys = F.when(rotation == 0, F.array(height - t, height - b)).when(rotation == 90, F.array(l, r)).when(rotation == 180, F.array(t, b)).otherwise(F.array(height - l, height - r))
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def assembled(words: DataFrame, page: list[str]) -> DataFrame:
    """A page's words (seq, word, top, bottom) with the span of each in the joined text: a line breaks where the drop is large."""
    w = W.partitionBy(*page).orderBy("seq")
    drop, tall = F.col("top") - F.lag("top").over(w), F.lag("bottom").over(w) - F.lag("top").over(w)
    gap = F.when(F.lag("seq").over(w).isNull(), "").when((tall > 0) & (drop > tall * LINE_BREAK), "\n").otherwise(" ")
    spaced = words.withColumn("gap", gap).withColumn("_size", F.length("gap") + F.length("word"))
    end = F.sum("_size").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")
    return spaced.withColumn("char_end", end).withColumn("char_start", F.col("char_end") - F.length("word")).drop("_size")


def page_text(words: DataFrame, page: list[str]) -> DataFrame:
    """The joined text of each page."""
    parts = assembled(words, page).groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("seq", "gap", "word"))).alias("p"))
    return parts.select(*page, F.array_join(F.transform("p", lambda x: F.concat(x["gap"], x["word"])), "").alias("content"))


def box_around(items: Column, start: Column, end: Column) -> Column:
    """The box around the items (char_start, char_end, x0, y0, x1, y1) that touch a character range; null if none does."""
    hit = F.filter(items, lambda i: (i["char_start"] < end) & (i["char_end"] > start))
    side = lambda f, k: f(F.transform(hit, lambda i: i[k]))
    return F.when(F.size(hit) > 0, F.struct(side(F.array_min, "x0").alias("x0"), side(F.array_min, "y0").alias("y0"), side(F.array_max, "x1").alias("x1"), side(F.array_max, "y1").alias("y1")))


def words_in_box(words: DataFrame, boxes: DataFrame, page: list[str]) -> DataFrame:
    """Pairs of words and boxes of one page that overlap."""
    a, b = words.alias("a"), boxes.alias("b")
    on = (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1")) & (F.col("a.y0") < F.col("b.y1")) & (F.col("b.y0") < F.col("a.y1"))
    for p in page:
        on = on & (F.col(f"a.{p}") == F.col(f"b.{p}"))
    return a.join(b, on)


def page_verdict(ink: Column, text_rows: Column, raster_pixels: Column, largest_image: Column) -> Column:
    """blank, dark-page, plate, text or sparse."""
    return (
        F.when(ink < EMPTY_INK, "blank").when(ink > DARK_INK, "dark-page")
        .when((raster_pixels > 0) & (largest_image >= raster_pixels * PLATE_SHARE), "plate").when(text_rows >= TEXT_ROWS, "text").otherwise("sparse")
    )
