"""PySpark-native log analytics and incident evidence.

Every public operator takes and returns DataFrames (or builds a ``Column``), so plans stay lazy and
Catalyst sees the whole query.
"""

from logmeridian.session import configure
from logmeridian.scope import AccessScope
from logmeridian.windows import CorrelationWindow, EventCursor, EventQuery, FieldFilter

__all__ = [
    "AccessScope",
    "CorrelationWindow",
    "EventCursor",
    "EventQuery",
    "FieldFilter",
    "configure",
]
