"""Proofline: reconciliation and coverage analytics for field reports, on Spark.

Every operator is a function from DataFrames (or Columns) to DataFrames (or
Columns). Nothing runs until the caller triggers an action, unless a function's
docstring says so.
"""

__version__ = "0.1.0"
