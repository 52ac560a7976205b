"""Queries over the supplied tables that exercise the library, and SQL that says what they must give."""
