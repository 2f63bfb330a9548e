"""Whole plans: checkpoint evaluation, statistical report, and the query catalogue."""
