"""Delay flags, totals, ratios and the texts and colours shown for them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _flag(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0.0))


def is_delayed(arr="ArrDel15", dep="DepDel15") -> Column:
    """True when either 15-minute flag is set; an absent flag counts as not set."""
    return (_flag(arr) == 1) | (_flag(dep) == 1)


def is_on_time(arr="ArrDel15", dep="DepDel15") -> Column:
    """True when no flag is set; rows with absent flags stay in."""
    return (_flag(arr) != 1) & (_flag(dep) != 1)


def is_delay(arr="ArrDel15", dep="DepDel15") -> Column:
    return is_delayed(arr, dep).cast("int")


def status_text(flag: Column) -> Column:
    return F.when(flag == 0, "On-Time").when(flag == 1, "Delayed")


def total_delay(arr="ArrDelayMinutes", dep="DepDelayMinutes") -> Column:
    """Arrival plus departure delay; a cancelled flight counts as 0."""
    return F.coalesce(F.col(arr), F.lit(0.0)) + F.coalesce(F.col(dep), F.lit(0.0))


def clamp_delay(minutes: Column) -> Column:
    return F.greatest(minutes, F.lit(0.0))


def from_log_delay(value: Column) -> Column:
    """Minutes from a log1p prediction, not below 0."""
    return clamp_delay(F.expm1(value))


def pct_rounded(ratio: Column) -> Column:
    """Per cent with one decimal, ties to even."""
    return F.rint(ratio * 100 * 10) / 10


def pct_label(ratio: Column) -> Column:
    return F.concat(pct_rounded(ratio).cast("string"), F.lit("%"))


def status_label(ratio: Column) -> Column:
    share = F.rint(ratio * 100).cast("int")
    return (
        F.when(ratio == 0, "On-Time")
        .when(ratio == 1, "Delayed")
        .when(ratio.isNotNull(), F.concat(F.lit("Mixed ("), share.cast("string"), F.lit("% delayed)")))
    )


def ratio_color(ratio: Column, alpha: int = 200) -> dict[str, Column]:
    """Red, green, blue and alpha (ints) on a green-yellow-red scale over 0..1."""
    share = F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0))
    return {
        "color_r": F.when(share < 0.5, (share * 510).cast("int")).otherwise(255),
        "color_g": F.when(share < 0.5, 255).otherwise(((1 - share) * 510).cast("int")),
        "color_b": F.lit(0),
        "color_a": F.lit(alpha),
    }


def color_array(ratio: Column, alpha: int = 200) -> Column:
    return F.array(*ratio_color(ratio, alpha).values())


def forecast_band(median: Column) -> Column:
    """Outlook from the median forecast: bounds 10 and 30 minutes.

    Rounding first keeps the last bit of an interpolated 10 from deciding.
    """
    minutes = F.round(median, 6)
    return (
        F.when(minutes < 10, "On-Time Expected")
        .when(minutes < 30, "Minor Delay Expected")
        .when(minutes.isNotNull(), "Significant Delay Expected")
    )


def cause_label(cause: Column, labels: dict[str, str]) -> Column:
    pairs = [F.lit(text) for pair in labels.items() for text in pair]
    return F.create_map(*pairs)[cause]
