"""Slicer settings and parameters of the registered queries."""

from __future__ import annotations

LAST_DAY = "2001-06-30"
YEARS = [1996, 1997]
REGIONS = ["ASIA", "EUROPE"]
CATEGORIES = ["ECONOMY", "PROMO"]
DEPARTMENTS = ["Building", "Machinery"]
OVERTIME = ["Yes"]
TENURE_BANDS = ["1. 0-2 yrs", "2. 3-5 yrs"]
SATISFACTION = [1, 2]
ALARM_POINTS = 3
