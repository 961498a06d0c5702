"""Hourly multi-zone time-series analytics and probabilistic forecasting on Spark.

Every public function takes DataFrames and returns DataFrames (or Columns). Frames carry ``zone`` and a UTC
``valid_time``, so one job serves all zones.
"""
