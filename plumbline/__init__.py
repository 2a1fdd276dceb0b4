"""plumbline: data profiling and readiness checks as Spark jobs.

Every operator takes Spark DataFrames and gives Spark DataFrames. Only tables
whose size does not grow with the rows (one row per column, or one row of
totals) ever reach the driver.
"""

from plumbline import columns, session, thresholds
from plumbline.session import get_session, stage

__all__ = ["columns", "session", "thresholds", "get_session", "stage"]
