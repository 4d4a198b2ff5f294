"""Cleaning and analysis of panel data on Spark."""

from panelweave.operators import *  # noqa: F401,F403
from panelweave.operators import __all__ as _operators
from panelweave.sources import (
    drop_materialized,
    materialize,
    pin,
    read_raw,
    read_with_quarantine,
    release,
    scope,
    write_panel,
)

__all__ = [
    *_operators,
    "drop_materialized",
    "materialize",
    "pin",
    "read_raw",
    "read_with_quarantine",
    "release",
    "scope",
    "write_panel",
]
