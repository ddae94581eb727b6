"""Composite reports, the query registry and its SQL oracle."""
