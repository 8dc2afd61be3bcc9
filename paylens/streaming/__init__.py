"""Structured Streaming forms of the operators."""

from paylens.streaming.gold_stream import run_gold_stream  # noqa: F401
from paylens.streaming.kpi_stream import kpi_stream, run_kpi_stream  # noqa: F401
