"""shelfcast: retail sales analytics and forecasting as Spark DataFrame jobs.

Every sales operator takes and returns a ``DataFrame`` and runs no action; the unit
of work is the whole sales table, and each (store, segment) selection,
including the "all stores" / "all segments" levels written as ``'*'``, is a
*scope* computed side by side with the others.
"""

from shelfcast.session import ensure_checkpoint_dir, get_spark

__all__ = ["get_spark", "ensure_checkpoint_dir"]
