"""Station time-series analytics on Spark.

Every public function takes and returns DataFrames or Columns; nothing here
runs a job unless its docstring says so.
"""
