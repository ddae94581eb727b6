"""Scalar rules as native Column expressions (no Python UDFs)."""

from skylag.functions.calendar import (  # noqa: F401
    date_text, day_name, dep_hour, flight_date, format_time, hour_of, hour_text, iso_dow, month_name,
    time_of_day, weekday_of,
)
from skylag.functions.delays import (  # noqa: F401
    cause_label, clamp_delay, color_array, forecast_band, from_log_delay, is_delay, is_delayed,
    is_on_time, pct_label, pct_rounded, ratio_color, status_label, status_text, total_delay,
)
from skylag.functions.labels import code_name_label, code_only_label  # noqa: F401
from skylag.functions.scenario import (  # noqa: F401
    distance_category, has_holiday_effect, has_peak_hour, season, weekday_share,
)
