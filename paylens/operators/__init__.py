"""DataFrame → DataFrame operators of the incident analysis."""

from paylens.operators.seasonal import (  # noqa: F401
    anomaly,
    anomaly_bounds,
    anomaly_markers,
    anomaly_rows,
    anomaly_summary,
    anomaly_windows,
    baselines,
    baselines_window,
    metric_series,
)
from paylens.operators.drill import (  # noqa: F401
    drill_all,
    drill_provider,
    drill_region,
    drill_version,
    error_delta,
    error_distribution,
    error_drill_users,
    errors_by_provider,
    fail_rate_by_platform,
    sample_failures,
    segment_fail_rate,
    segment_vs_rest,
    top_error_codes,
    top_errors,
    validate_hourly_success,
    validate_segment_status,
)
from paylens.operators.impact import impact_summary, user_impact  # noqa: F401
from paylens.operators.cube import bucketize, kpi, kpi_extent, overall, with_tod_key  # noqa: F401
from paylens.operators.rootcause import (  # noqa: F401
    attribution,
    attribution_labels,
    incident_scorecard,
    root_cause_rank,
    scorecard_fields,
)
from paylens.operators.windows import restrict_to_windows, window_table  # noqa: F401
