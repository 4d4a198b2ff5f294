"""Independent SQL for the registered queries, in DuckDB's dialect.

Written with plain windows and subqueries, so that it shares no method with the Spark side.
"""

from oracle.health import HEALTH
from oracle.panel import PANEL

ORACLE = {**PANEL, **HEALTH}
