"""Weight of evidence and information value of one bin.

woe = ln((non_events / all non_events) / (events / all events)),
iv  = (share of non_events - share of events) * woe.
A bin with no events or no non-events gets 0.5 added to both its counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_measures(events: Column, non_events: Column, all_events: int, all_non_events: int) -> tuple[Column, Column]:
    """(woe, iv) columns; null when the table holds one class only."""
    pad = F.when((events == 0) | (non_events == 0), F.lit(0.5)).otherwise(F.lit(0.0))
    good = F.try_divide(non_events.cast("double") + pad, F.lit(float(all_non_events)))
    bad = F.try_divide(events.cast("double") + pad, F.lit(float(all_events)))
    woe = F.ln(F.try_divide(good, bad))
    return woe, (good - bad) * woe


def _shares(events: float, non_events: float, all_events: float, all_non_events: float) -> tuple[float, float]:
    pad = 0.5 if events == 0 or non_events == 0 else 0.0
    return (non_events + pad) / all_non_events, (events + pad) / all_events


def bin_woe(events: float, non_events: float, all_events: float, all_non_events: float) -> float:
    """The woe of one bin on the driver or in a task, same rule as above; 0 when the table holds one class only."""
    if all_events == 0 or all_non_events == 0:
        return 0.0
    good, bad = _shares(events, non_events, all_events, all_non_events)
    return math.log(good / bad)


def bin_iv(events: float, non_events: float, all_events: float, all_non_events: float) -> float:
    """The iv of one bin on the driver or in a task, same rule as above."""
    if all_events == 0 or all_non_events == 0:
        return 0.0
    good, bad = _shares(events, non_events, all_events, all_non_events)
    return (good - bad) * math.log(good / bad)
