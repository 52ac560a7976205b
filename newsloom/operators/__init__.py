"""Relational operators over item, feed, snapshot and fetch-log tables."""
