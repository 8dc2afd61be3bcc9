"""Column-expression helpers shared by the operators (all JVM-side built-ins)."""

from paylens.functions.expr import (  # noqa: F401
    bucket_start,
    cents,
    from_cents,
    is_fail,
    is_success,
    ntz,
    ratio,
    round_half_up,
    segment_condition,
    tod_slot,
)
from paylens.functions.stats import (  # noqa: F401
    basis_points,
    exact_mean,
    exact_stddev,
    to_units,
)
