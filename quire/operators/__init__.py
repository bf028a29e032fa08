"""Relational operators: lookup, as-of, interval and semi joins, windows, aggregates, dedup, top-k."""
