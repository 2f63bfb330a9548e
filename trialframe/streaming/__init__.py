"""The same aggregates over streams."""
