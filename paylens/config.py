"""Default parameters of the analysis.

All of them are plain function parameters elsewhere; these are only defaults.
"""

from __future__ import annotations

import datetime as _dt

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# Segment dimensions of the KPI cube, in drill-down order.
DIMS = ("platform", "app_version", "region", "provider")
# Anomaly rule: z-score strictly below this flags a drop.
Z_THRESHOLD = -3.0
# Average purchase value used to turn a rate drop into money.
AVG_PURCHASE_VALUE = 14.99
# Width of a KPI bucket in minutes (288 buckets per day).
BUCKET_MINUTES = 5
# Top-k sizes of the evidence queries.
TOPK_REGION = 10
TOPK_PROVIDER = 10
TOPK_ERRORS = 15
TOPK_SEGMENTS_ALERT = 10
TOPK_ERRORS_ALERT = 10
TOPK_DRILL_USERS = 5
TOPK_SAMPLE = 5
TOPK_APP = 5
# Accuracy at or above this counts as a pass in the scorecard.
PASS_ACCURACY = 80
# ---------------------------------------------------------------------------

# The fixture tables span January 2024; "today" of the reference's
# current_date() is a parameter here.
AS_OF = _dt.date(2024, 1, 20)

# Segment the reference hard-codes for the affected-vs-healthy chart and the
# error breakdown; in fixture terms the incident region is ASIA.
FOCUS_SEGMENT = {"platform": "iOS", "app_version": "1.2.7", "region": "ASIA"}
ERROR_SEGMENT = {"platform": "iOS", "app_version": "1.2.7"}

# Names of the two metric rows of the anomaly table.
METRIC_RATE = "pay_success_rate"
METRIC_REVENUE = "revenue"
