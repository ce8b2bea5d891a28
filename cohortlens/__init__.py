"""Cohort and outcome analytics as DataFrame-in, DataFrame-out functions on Spark."""
