"""Outputs: JSON reports, NDJSON, text, and snapshot tables."""
