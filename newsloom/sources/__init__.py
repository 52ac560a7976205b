"""Inputs: captured feed documents, pages, response logs, snapshots and URL lists."""
