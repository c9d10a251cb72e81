"""Log analytics on Spark: system event records, their history and dashboards."""

from loglantern.operators.filters import LogFilter
from loglantern.plans.history import History
from loglantern.sources.store import EntryStore
from loglantern.streaming.monitor import Monitor

__all__ = ["EntryStore", "History", "LogFilter", "Monitor"]
