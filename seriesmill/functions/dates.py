"""Calendar columns and payday distances, in closed form."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def payday_distances(date: str = "date") -> tuple[Column, Column]:
    """Days until the next and since the last payday (the 15th and the month's last day); 0 on a payday."""
    d, day, end = F.col(date), F.dayofmonth(date), F.last_day(date)
    fifteenth = F.date_add(F.trunc(d, "month"), 14)
    nxt = F.when(day <= 15, fifteenth).otherwise(end)
    last = F.when(d == end, d).when(day >= 15, fifteenth).otherwise(F.date_sub(F.trunc(d, "month"), 1))
    return F.date_diff(nxt, d), F.date_diff(d, last)


def calendar_columns(date: str = "date") -> dict[str, Column]:
    d, day = F.col(date), F.dayofmonth(date)
    flag = lambda c: c.cast("int")
    nxt, last = payday_distances(date)
    return {
        "day_of_week": F.weekday(d), "month": F.month(d), "quarter": F.quarter(d), "day_of_month": day, "week_of_year": F.weekofyear(d),
        "is_weekend": flag(F.weekday(d) >= 5), "is_month_start": flag(day == 1), "is_month_end": flag(d == F.last_day(d)),
        "is_payday": flag((day == 15) | (d == F.last_day(d))), "days_until_next_payday": nxt, "days_since_last_payday": last,
    }


def add_calendar(df: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Calendar columns named in ``wanted`` (all by default); the payday distances always."""
    keep = lambda c: wanted is None or c in wanted or c.startswith("days_")
    return df.withColumns({k: v for k, v in calendar_columns().items() if keep(k)})


#: Public holidays of a country: (month, day), or days from Easter Sunday as one number.
HOLIDAYS = {
    "EC": {
        "new_year": [(1, 1)], "carnival": [-48, -47], "good_friday": [-2], "labour": [(5, 1)], "pichincha": [(5, 24)], "independence": [(8, 10)],
        "guayaquil": [(10, 9)], "all_souls": [(11, 2)], "cuenca": [(11, 3)], "christmas": [(12, 25)],
    },
}


def easter(year: int) -> dt.date:
    """Easter Sunday (Gregorian)."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = h + k - 7 * ((a + 11 * h + 22 * k) // 451) + 114
    return dt.date(year, m // 31, m % 31 + 1)


def holiday_design(dates, country: str | None) -> np.ndarray:
    """A 0/1 column for each holiday of the country, on nominal dates; no column without a country."""
    if not country:
        return np.zeros((len(dates), 0))
    if country not in HOLIDAYS:
        raise ValueError(f"no holidays of {country!r}")
    d = pd.DatetimeIndex(dates)
    years = range(d.year.min(), d.year.max() + 1) if len(d) else ()
    on = lambda y, day: easter(y) + dt.timedelta(day) if isinstance(day, int) else dt.date(y, *day)
    return np.column_stack([d.isin(pd.to_datetime([on(y, day) for y in years for day in days])) for days in HOLIDAYS[country].values()]).astype(float)
