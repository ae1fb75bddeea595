"""Preparing and evaluating grounded medical-report datasets on Spark."""
