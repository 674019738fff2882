"""Where the thirteen input tables come from."""

from leadgauge.sources.tables import (
    ROLES,
    Sources,
    from_catalog,
    from_jdbc,
    from_parquet,
    resolve_table,
)

__all__ = ["ROLES", "Sources", "from_catalog", "from_jdbc", "from_parquet", "resolve_table"]
