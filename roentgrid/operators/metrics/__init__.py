"""Scores of predictions against references."""
