"""Importing this module registers every query."""

import checks.classify_overview  # noqa: F401
import checks.forecasting  # noqa: F401
import checks.planning_chain  # noqa: F401
import checks.ledgers  # noqa: F401
import checks.whole_chain  # noqa: F401
import checks.full_grain  # noqa: F401
