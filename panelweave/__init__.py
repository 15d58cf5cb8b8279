"""Cross-sectional research on time-series panels, as Spark DataFrame jobs.

Every public operator takes DataFrames or Columns and returns DataFrames or
Columns; nothing here runs an action except the sinks in ``sources`` and
``streaming`` and the model fits in ``operators.models``.
"""

__version__ = "0.1.0"
