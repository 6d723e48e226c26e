"""Registered queries (``catalog``), their DuckDB twins (``oracle``) and the
full report job (``report``)."""
