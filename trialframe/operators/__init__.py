"""Relational operators over trial tables, records and conversations."""
