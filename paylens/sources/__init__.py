"""Sources (driver tables, fixture adapter, incident log) and sinks."""

from paylens.sources.fixtures import (  # noqa: F401
    customer_regions,
    game_events_from_payments,
    incidents,
    payments_from_events,
    silver_game_events,
    silver_payments,
)
from paylens.sources.sinks import append_named, append_table, overwrite_table, read_written, replace_named  # noqa: F401
from paylens.sources.tables import read_table, register_views  # noqa: F401
