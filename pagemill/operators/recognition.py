"""The arithmetic round recognition: histograms, thresholds, contrast, and how usable a recognised page is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.jsstr import js_round
from pagemill.functions.text import normalize_extracted

# fixed values
TARGET_WIDTH, MOST_SCALE = 1800, 3
LEAST_TEXT, SHORT_CONFIDENCE, LEAST_CONFIDENCE, LEAST_WORD_CONFIDENCE = 12, 68, 42, 45
LEAST_ALNUM, MOST_SYMBOLS, LEAST_DICTIONARY, LEAST_CONFIDENT, LEAST_CLEAN = 0.55, 0.16, 0.18, 0.45, 0.55
DEFAULT_THRESHOLD, ACCEPTED_AT_ONCE = 127, 90
LOW_SHARE, HIGH_SHARE, NEAR_BLACK, NEAR_WHITE, OCR_BELOW = 0.02, 0.98, 12, 245, 24
PUNCTUATION = "[.,;:!?'\"“”‘’()\\[\\]{}\\-–—/%&+=_*]"


def scale_factor(width: Column) -> Column:
    return F.least(F.lit(float(MOST_SCALE)), F.greatest(F.lit(1.0), F.lit(TARGET_WIDTH) / F.greatest(width, F.lit(1))))


def histogram_percentile(histogram: DataFrame, share: float, by: list[str]) -> DataFrame:
    """(by, value): the least value whose running count reaches the share of all; ``histogram`` has (by, value, n), at most 256 rows each."""
    order = Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    running = histogram.withColumn("_run", F.sum("n").over(order)).withColumn("_all", F.sum("n").over(Window.partitionBy(*by)))
    return running.where(F.col("_run") >= F.col("_all") * share).groupBy(*by).agg(F.min("value").alias("value"))


def otsu_threshold(histogram: DataFrame, by: list[str]) -> DataFrame:
    """(by, threshold): the first value with the largest variance between dark and light, 127 if nothing is light."""
    order = Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    sums = (
        histogram.withColumn("_w", F.sum("n").over(order))
        .withColumn("_s", F.sum(F.col("value") * F.col("n")).over(order))
        .withColumn("_n", F.sum("n").over(whole))
        .withColumn("_t", F.sum(F.col("value") * F.col("n")).over(whole))
    )
    light = F.col("_n") - F.col("_w")
    gap = F.col("_s") / F.col("_w") - (F.col("_t") - F.col("_s")) / light
    spread = F.when((F.col("_w") > 0) & (light > 0), F.col("_w") * light * gap * gap)
    best = F.max(F.when(spread.isNotNull(), F.struct(spread.alias("v"), (-F.col("value")).alias("o"))))
    return sums.groupBy(*by).agg(F.coalesce(-best["o"], F.lit(DEFAULT_THRESHOLD)).cast("int").alias("threshold"))


def contrast(pixels: DataFrame, by: list[str], binary: bool = False) -> DataFrame:
    """(by, place, value) of pixels (by, place, red, green, blue) of images, as recognition gets them.

    Gray values are stretched between the 2nd and the 98th percentile of their image; then, if ``binary``, cut into black
    and white at Otsu's threshold, else near-black and near-white are snapped.  Per image only a histogram of 256 values meets.
    """
    shade = js_round(F.col("red") * 0.299 + F.col("green") * 0.587 + F.col("blue") * 0.114).cast("int")
    gray = pixels.select(*by, "place", shade.alias("value"))
    counted = gray.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))
    low, high = (histogram_percentile(counted, share, by).withColumnRenamed("value", name) for share, name in ((LOW_SHARE, "_low"), (HIGH_SHARE, "_high")))
    bounds = low.join(high, by)
    span = F.greatest(F.col("_high") - F.col("_low"), F.lit(1))
    stretched = F.greatest(F.lit(0), F.least(F.lit(255), js_round((F.col("value") - F.col("_low")) * 255 / span))).cast("int")
    rows = gray.join(bounds, by).select(*by, "place", stretched.alias("value"))
    if not binary:
        return rows.withColumn("value", F.when(F.col("value") <= NEAR_BLACK, 0).when(F.col("value") >= NEAR_WHITE, 255).otherwise(F.col("value")))
    level = otsu_threshold(counted.join(bounds, by).select(*by, stretched.alias("value"), "n").groupBy(*by, "value").agg(F.sum("n").alias("n")), by)
    return rows.join(level, by).select(*by, "place", F.when(F.col("value") >= F.col("threshold"), 255).otherwise(0).alias("value"))


def ocr_fallback(pages: DataFrame) -> DataFrame:
    """Adds ``text`` and ``from_ocr`` to (file_index, page_seq, layer, ocr_text, ocr_usable, ocr_failed); pages without a text are left out.

    A page whose text layer is shorter than 24 characters takes recognised text too, if it is usable; after the first
    page at which recognition failed no later page of the file does.  That page is an aggregate, so a large file makes no hot task.
    """
    asked = F.length("layer") < OCR_BELOW
    broken = pages.where(asked & F.col("ocr_failed")).groupBy("file_index").agg(F.min("page_seq").alias("_broken"))
    rows = pages.join(broken, "file_index", "left")
    used = asked & F.col("ocr_usable") & (F.length("ocr_text") > 0) & (F.col("_broken").isNull() | (F.col("page_seq") < F.col("_broken")))
    layer, ocr = F.lower("layer"), F.lower("ocr_text")
    longer = F.when(F.length("layer") >= F.length("ocr_text"), F.col("layer")).otherwise(F.col("ocr_text"))
    both = F.when(F.length("layer") == 0, F.col("ocr_text")).when(F.contains(layer, ocr) | F.contains(ocr, layer), longer).otherwise(
        normalize_extracted(F.concat("layer", F.lit(" "), "ocr_text"))
    )
    made = rows.withColumn("from_ocr", F.coalesce(used, F.lit(False))).withColumn("text", F.when(F.col("from_ocr"), both).otherwise(F.col("layer")))
    return made.where(F.length("text") > 0).drop("_broken")


def page_quality(pages: DataFrame) -> DataFrame:
    """Adds text, usable, warning and quality_score to (text, confidence, words of text, confidence and in_dictionary)."""
    clean = lambda w: F.struct(F.regexp_replace(w["text"], "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "").alias("text"), w["confidence"].alias("confidence"), w["in_dictionary"].alias("known"))
    rows = pages.withColumn("text", normalize_extracted(F.coalesce("text", F.lit("")))).withColumn(
        "_words",
        F.filter(F.transform("words", clean), lambda w: w["text"] != "")
    )
    count = lambda cond: F.size(F.filter("_words", cond))
    ratio = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    alpha = lambda w: w["text"].rlike("[A-Za-z]")
    rows = rows.withColumns({
        "_n": F.size("_words"),
        "_alpha": count(alpha),
        "_seen": F.length(F.regexp_replace("text", r"\s+", "")),
        "_alnum": F.regexp_count("text", F.lit("[A-Za-z0-9]")),
        "_marks": F.regexp_count("text", F.lit(PUNCTUATION)),
        "_clean": count(lambda w: w["text"].rlike("^[A-Za-z0-9]+(?:[’'/-][A-Za-z0-9]+)*$")),
        "_sure": count(lambda w: w["confidence"] >= 55),
        "_known": count(lambda w: alpha(w) & w["known"] & (F.length(w["text"]) >= 3)),
        "_sum": F.aggregate("_words", F.lit(0.0), lambda a, w: a + w["confidence"]),
    })
    c = F.col
    rows = rows.withColumns({
        "_average": F.when(c("_n") > 0, c("_sum") / c("_n")).otherwise(c("confidence")),
        "_alnum_ratio": ratio(c("_alnum"), c("_seen")),
        "_symbols": F.when(c("_seen") > 0, F.greatest(F.lit(0), c("_seen") - c("_alnum") - c("_marks")) / c("_seen")).otherwise(1.0),
        "_sure_ratio": ratio(c("_sure"), c("_n")),
        "_clean_ratio": ratio(c("_clean"), c("_n")),
        "_known_ratio": ratio(c("_known"), c("_alpha")),
        "_length": F.length("text"),
    })
    short = (c("_length") < LEAST_TEXT) | (c("_n") < 3) & (c("_alpha") < 2)
    short_fine = (c("confidence") >= SHORT_CONFIDENCE) & (c("_alnum_ratio") >= 0.7) & (c("_symbols") <= 0.08)
    lexical = (c("_known_ratio") >= LEAST_DICTIONARY) & (c("_average") >= 38)
    confident = (c("confidence") >= LEAST_CONFIDENCE) & (
        c("_average") >= LEAST_WORD_CONFIDENCE
    ) & (c("_sure_ratio") >= LEAST_CONFIDENT) & (c("_clean_ratio") >= LEAST_CLEAN)
    usable = (c("_length") > 0) & (short_fine | ~short & (c("_alnum_ratio") >= LEAST_ALNUM) & (c("_symbols") <= MOST_SYMBOLS) & (lexical | confident))
    low = F.concat(F.lit("Ignored low-confidence OCR output ("), js_round(c("confidence")).cast("string"), F.lit("% confidence)."))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    score = c("confidence") * 0.45 + c("_average") * 0.25 + c("_sure_ratio") * 22 + c("_clean_ratio") * 12 + c("_known_ratio") * 16 + c("_alnum_ratio") * 10 - c("_symbols") * 60 + F.least(c("_length"), F.lit(240)) * 0.05 + F.when(c("usable"), 18).otherwise(-25)
    warned = F.when(~c("usable"), F.when(c("_length") == 0, "OCR did not detect readable text.").otherwise(low))
    return rows.withColumn("warning", warned).withColumn("quality_score", score).drop(*[x for x in rows.columns if x.startswith("_")], "words")


def best_attempt(first: DataFrame, second: DataFrame, by: str) -> DataFrame:
    """The better of two attempts at a page, the first of equals; the second counts only if the first is not good at once."""
    good = first.where(F.col("usable") & (F.col("quality_score") >= ACCEPTED_AT_ONCE))
    both = first.withColumn("_try", F.lit(0)).unionByName(second.join(good.select(by), by, "left_anti").withColumn("_try", F.lit(-1)))
    best = both.groupBy(by).agg(F.max(F.struct("quality_score", "_try", "text", "confidence", "usable", "warning")).alias("_b"))
    return best.select(
        by,
        F.when(F.col("_b.usable"), F.col("_b.text")).otherwise("").alias("text"),
        F.col("_b.confidence").alias("confidence"),
        F.col("_b.usable").alias("usable"),
        F.col("_b.warning").alias("warning"),
        F.col("_b.quality_score").alias("quality_score")
    )
