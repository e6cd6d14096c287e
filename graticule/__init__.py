"""Graticule: Spark DataFrame jobs for gridded and point geoscience data.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing is computed until the caller runs an action, except where a
docstring says that a size is checked first.
"""

__version__ = "0.1.0"
