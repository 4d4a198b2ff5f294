from panelweave.sources.staging import read_raw, read_with_quarantine, write_panel
from panelweave.sources.workspace import drop_materialized, materialize, pin, pin_bucketed, release, scope

__all__ = ["drop_materialized", "materialize", "pin", "pin_bucketed", "read_raw", "read_with_quarantine", "release", "scope", "write_panel"]
