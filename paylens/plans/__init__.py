"""Composed plans: the day's incident analysis, the gold refresh, the query registry."""

from paylens.plans.gold import refresh_gold  # noqa: F401
from paylens.plans.incident import IncidentAnalysis, incident_attribution  # noqa: F401
