from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

PAYMENT_DDL = (
    "event_id bigint, event_ts timestamp_ntz, user_id string, amount double, currency string, provider string, "
    "payment_status string, error_code string, platform string, app_version string, region string, device_model string"
)


@pytest.fixture(scope="session")
def spark():
    from paylens.session import build_session, shared_dir

    s = build_session("local[4]", shuffle_partitions=4, extra={"spark.ui.showConsoleProgress": "false"})
    shared_dir(s)  # tests: a fresh checkpoint folder under the temp dir
    yield s
    s.stop()


def pay_row(i: int, ts: str, status: str = "success", amount: float = 1.0, platform: str = "iOS",
            version: str = "1.2.7", region: str = "ASIA", provider: str = "Stripe", error: str | None = None,
            user: str | None = None):
    t = dt.datetime.fromisoformat(ts)
    if status == "fail" and error is None:
        error = "TOKEN_EXPIRED"
    return (i, t, user or f"u_{i:06d}", amount, "USD", provider, status, error, platform, version, region, "iPhone14")


@pytest.fixture
def make_payments(spark):
    def make(rows):
        return spark.createDataFrame(rows, PAYMENT_DDL)
    return make
