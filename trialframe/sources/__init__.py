"""Readers and writers: JSON Lines, single JSON objects, trainer logs, configurations, reports."""
