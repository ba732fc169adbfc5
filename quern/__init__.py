"""Quern: DataFrame-in, DataFrame-out operators for auditing, splitting and scoring datasets on Spark."""
