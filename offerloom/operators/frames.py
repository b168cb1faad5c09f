"""Frames and OCR words: gates, locks, lines.

The gates are small state machines over ordered rows; written as islands over windows they
run for all rigs at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.functions import geometry, luma
from offerloom.functions.text import find_pay, normalize

# How much a frame must change to be looked at, and how little to be still.
CHANGED, STILL = 6, 2
AGREE = 2
CLIPPED_SHARE = 0.02
# Fixed value: within this share of a picture's range, what is nearer to dark or to light is too close to call.
TOO_CLOSE = 0.06


def in_order(by: list[str]) -> W:
    return W.partitionBy(*by).orderBy("seen_ms", "ord")


def agreement(rows: DataFrame, by: list[str], signature: list[str], n: int = AGREE) -> DataFrame:
    """``agreeing``: how many readings in a row say the same; ``locked`` from ``n`` on."""
    order = in_order(by)
    same = [F.col(c).eqNullSafe(F.lag(c).over(order)) for c in signature]
    changed = ~same[0]
    for s in same[1:]:
        changed = changed | ~s
    first = F.row_number().over(order) == 1
    rows = rows.withColumn("island", F.sum((first | changed).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.withColumn("agreeing", F.row_number().over(in_order([*by, "island"]))).withColumn("locked", F.col("agreeing") >= n)


def motion_gate(rows: DataFrame, by: list[str], diff: str = "diff") -> DataFrame:
    """``read``: true where a frame is still after a change (the first frame is one), once for each change.

    A frame reads if it is still and the latest earlier frame that was either changed or
    still had changed.
    """
    order = in_order(by)
    moved = (F.col(diff) > CHANGED) | (F.row_number().over(order) == 1)
    event = F.when(moved, 1).when(F.col(diff) <= STILL, 0)
    rows = rows.withColumn("_event", event)
    before = F.last("_event", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("read", F.coalesce((F.col("_event") == 0) & (before == 1), F.lit(False))).drop("_event")


def verify_wait(rows: DataFrame, by: list[str], signature: str, least: float = 2.5, most: float = 12.0, factor: float = 1.6) -> DataFrame:
    """Seconds until the next look: ``least`` after a blank or a change, growing while nothing changes."""
    order = in_order(by)
    blank = F.col(signature).isNull()
    reset = blank | ~F.col(signature).eqNullSafe(F.lag(signature).over(order))
    rows = rows.withColumn("_island", F.sum(reset.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    n = F.row_number().over(in_order([*by, "_island"])) - 1
    return rows.withColumn("wait", F.least(F.lit(most), F.lit(least) * F.pow(F.lit(factor), n))).drop("_island")


def error_islands(rows: DataFrame, by: list[str], message: str) -> DataFrame:
    """Messages worth logging: each one that differs from the row before; a success (null) clears."""
    before = rows.withColumn("_before", F.lag(message).over(in_order(by)))
    return before.where(F.col(message).isNotNull() & ~F.col(message).eqNullSafe(F.col("_before"))).drop("_before")


def live_view(rows: DataFrame, by: list[str]) -> DataFrame:
    """The last row of each rig."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("seen_ms", "ord")).alias("r")).select(*by, "r.*")


def ocr_lines(words: DataFrame, page: list[str]) -> DataFrame:
    """Words to lines: box and text in word order; ``first`` orders the lines as they were first met."""
    w = F.sort_array(F.collect_list(F.struct("nth", "left", "top", "text")))
    return words.groupBy(*page, "block", "par", "line").agg(
        F.min("top").alias("top"), F.max(F.col("top") + F.col("height")).alias("bottom"), F.min("left").alias("left"), F.max(F.col("left") + F.col("width")).alias("right"),
        F.array_join(F.transform(w, lambda x: x["text"]), " ").alias("text"), F.min("nth").alias("first"),
    )


def clipped_payout(lines: DataFrame, page: list[str], page_height: Column) -> DataFrame:
    """Whether the highest line with an amount touches the page's upper edge."""
    top = F.min(F.when(find_pay(normalize(F.col("text"))).isNotNull(), F.col("top")))
    return lines.groupBy(*page).agg(top.alias("payout_top"), F.coalesce(top <= page_height * CLIPPED_SHARE, F.lit(False)).alias("clipped"))


def exposure_choice(frames: DataFrame, by: list[str]) -> DataFrame:
    """The setting with little banding that comes nearest the wanted brightness; clipped ones only if all are."""
    every = W.partitionBy(*by)
    ok = F.col("clipped") <= 0.08
    rows = frames.withColumn("_ok", ok).withColumn("_any", F.max(ok.cast("int")).over(every) == 1)
    rows = rows.where(F.col("_ok") | ~F.col("_any"))
    rows = rows.withColumn("_least", F.min("banding").over(every)).where(F.col("banding") <= F.col("_least") + 1)
    return rows.groupBy(*by).agg(F.min_by("exposure", F.struct(F.abs(F.col("brightness") - 205), F.col("exposure"))).alias("exposure"))


def exposure_scores(shots: DataFrame, by: list[str], nth: str = "nth") -> DataFrame:
    """``banding, brightness, clipped`` of the frames that were taken at one setting, ``by`` it.

    Banding is what moves from frame to frame in the rows' means: a card's content stays and
    cancels out.  Brightness and blown-out share are the first frame's.  Only profiles and two
    numbers of a frame are shuffled, never its pixels.
    """
    told = shots.where(F.col("luma").isNotNull()).select(
        *by, nth, luma.row_profile(F.col("luma")).alias("_profile"), luma.brightness(F.col("luma")).alias("_bright"), luma.clipped_share(F.col("luma")).alias("_clipped")
    )
    every = W.partitionBy(*by)
    told = told.withColumn("_rows", F.min(F.size("_profile")).over(every)).withColumn("_before", F.lag("_profile").over(every.orderBy(nth)))
    told = told.withColumn("_moved", F.when(F.col("_before").isNotNull(), luma.profile_change(F.col("_profile"), F.col("_before"), F.col("_rows"))))
    return told.groupBy(*by).agg(
        F.coalesce(F.avg("_moved"), F.lit(0.0)).alias("banding"), F.coalesce(F.min_by("_bright", nth), F.lit(0.0)).alias("brightness"), F.coalesce(F.min_by("_clipped", nth), F.lit(0.0)).alias("clipped")
    )


def dark_mode(rows: DataFrame, by: list[str], pixels: str = "pixels") -> DataFrame:
    """``dark``: whether a card is light text on a dark ground, as its median is nearer to the dark end of its range.

    A picture that is too close to call keeps the last answer of its rig, if there is one; a picture without pixels
    has none and changes nothing.
    """
    p = F.col(pixels)
    rows = rows.withColumns({"_low": luma.percentile(p, 5), "_high": luma.percentile(p, 95), "_ground": luma.percentile(p, 50)})
    middle = (F.col("_low") + F.col("_high")) / 2
    close = F.abs(F.col("_ground") - middle) < TOO_CLOSE * F.greatest(F.lit(1.0), F.col("_high") - F.col("_low"))
    rows = rows.withColumn("_dark", F.col("_ground") < middle).withColumn("_close", close)
    order = in_order(by).rowsBetween(W.unboundedPreceding, 0)
    # a rig's first picture is an answer however close it is, and so is each that isn't too close
    first = F.row_number().over(W.partitionBy(*by, F.col("_dark").isNull()).orderBy("seen_ms", "ord")) == 1
    rows = rows.withColumn("_said", F.when(F.col("_dark").isNotNull() & (first | ~F.col("_close")), F.col("_dark")))
    kept = F.last("_said", ignorenulls=True).over(order)
    return rows.withColumn("dark", F.when(F.col("_dark").isNotNull(), kept)).drop("_low", "_high", "_ground", "_dark", "_close", "_said")


def nearest_centre(candidates: DataFrame, by: list[str]) -> DataFrame:
    """``quad``: of a frame's candidates the one nearest its middle, one that holds the middle before all others.

    Distance is the area's centre's, by the frame's longer side; a candidate without an area comes last, and the first
    (``nth``) of equals is taken.  Expects ``quad``, ``nth``, ``frame_width``, ``frame_height``.
    """
    middle = F.struct((F.col("frame_width") / 2).alias("x"), (F.col("frame_height") / 2).alias("y"))
    c = geometry.area_centre(F.col("quad"))
    away = geometry.distance(c, middle) / F.greatest("frame_width", "frame_height")
    score = F.when(c.isNull(), F.lit(1e9)).otherwise(away - geometry.contains(F.col("quad"), middle).cast("double"))
    return candidates.where(F.col("quad").isNotNull()).withColumn("_score", score).groupBy(*by).agg(F.min_by("quad", F.struct("_score", "nth")).alias("quad"), F.min("_score").alias("score"), F.count("*").alias("candidates"))


def aimed(rows: DataFrame, by: list[str], good: str = "good", n: int = 6) -> DataFrame:
    """``aimed``: whether the last ``n`` readings in a row were good."""
    rows = rows.withColumn("_bad", F.sum((~F.coalesce(F.col(good), F.lit(False))).cast("int")).over(in_order(by).rowsBetween(W.unboundedPreceding, 0)))
    streak = F.sum(F.coalesce(F.col(good), F.lit(False)).cast("int")).over(in_order([*by, "_bad"]).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("aimed", streak >= n).drop("_bad")


def speak_once(rows: DataFrame, by: list[str]) -> DataFrame:
    """``speak``: locked, whole and ready, and another pay or time than was spoken last; forgotten when nothing is ready."""
    order = in_order(by)
    rows = rows.withColumn("_life", F.sum((~F.coalesce(F.col("ready"), F.lit(False))).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    able = F.coalesce(F.col("ready") & F.col("locked") & F.col("whole"), F.lit(False))
    said = F.struct("pay", "minutes")
    last = F.last(F.when(able, said), ignorenulls=True).over(in_order([*by, "_life"]).rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("speak", able & ~said.eqNullSafe(last)).drop("_life")


def recovered(rows: DataFrame, first: str = "first", second: str = "second") -> DataFrame:
    """``read, recovered``: the second reading in place of one without pay, if it has one and agrees on the journey."""
    a, b = F.col(first), F.col(second)
    better = a["pay"].isNull() & (a["minutes"] > 0) & b["pay"].isNotNull() & b["minutes"].eqNullSafe(a["minutes"]) & b["miles"].eqNullSafe(a["miles"])
    better = F.coalesce(better, F.lit(False))
    return rows.withColumn("read", F.when(better, b).otherwise(a)).withColumn("recovered", better)


def resample(rows: DataFrame, by: list[str], reach_ms: int = 4000) -> DataFrame:
    """``until_ms``: up to when a card is looked at more often; null if not.

    A reading with pay arms it, once for each card (``episode``); one that is whole and stable ends it.
    """
    order = in_order(by)
    ends = F.coalesce(F.col("whole") & F.col("stable"), F.lit(False))
    event = F.when(ends, F.lit(-1)).when(F.col("pay") > 0, F.col("episode"))
    rows = rows.withColumn("_event", event.cast("long"))
    before = F.last("_event", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    arms = ~ends & F.col("_event").isNotNull() & ~F.col("_event").eqNullSafe(before)
    state = F.when(ends, F.lit(-1)).when(arms, F.col("seen_ms") + reach_ms)
    rows = rows.withColumn("_state", state.cast("long"))
    until = F.last("_state", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("until_ms", F.when(until > 0, until)).drop("_event", "_state")


def tsv_words(lines: DataFrame, line: str = "line") -> DataFrame:
    """Words of an OCR engine's tab-separated report: place and text; lines that aren't a word go."""
    cells = F.split(line, "\t", -1)
    whole = lambda i: F.get(cells, i).try_cast("long")
    names = ("level", "page_num", "block", "par", "line_num", "nth", "left", "top", "width", "height")
    rest = [c for c in lines.columns if c != line]
    words = lines.select(*rest, *(whole(i).alias(n) for i, n in enumerate(names)), F.get(cells, 10).try_cast("double").alias("conf"), F.trim(F.get(cells, 11)).alias("text"))
    placed = [F.col(c).isNotNull() for c in ("block", "par", "line_num", "left", "top", "width", "height")]
    return words.where(reduce(lambda a, b: a & b, placed) & (F.col("conf") >= 0) & (F.col("text") != "")).drop("level")
