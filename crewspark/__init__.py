"""Workforce-planning, take-off and job-costing analytics on Spark DataFrames."""
