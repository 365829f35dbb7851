"""Operators on rollouts, samples and metrics; all take and return DataFrames or Columns."""
