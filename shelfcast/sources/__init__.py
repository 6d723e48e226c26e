"""Sources and sinks: the validated sales table, its snapshot, CSV export."""
