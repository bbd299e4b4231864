"""Column expressions: calendar arithmetic, text parsing, name matching."""

from sightline.functions.calendar import (  # noqa: F401
    GRAINS,
    PERIOD_COLUMNS,
    anchored_year,
    period_end,
    period_label,
    period_start,
    period_step,
    week_end,
    week_label,
    week_start,
    year_start,
)
from sightline.functions.text import (  # noqa: F401
    name_key,
    ntz_literal,
    to_date_or_null,
    to_utc_timestamp_ntz,
)
