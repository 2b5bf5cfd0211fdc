"""logweave: security-log analytics and vector search as Spark DataFrame jobs.

Every public operator takes DataFrames (plus plain parameters) and returns a
DataFrame.  Nothing is collected to the driver except results whose size is
bounded by a parameter (top-k hits, at most five event ids, a forest of
fixed size).
"""

from logweave.config import Settings

__all__ = ["Settings"]
__version__ = "0.1.0"
