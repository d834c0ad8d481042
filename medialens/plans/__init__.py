"""Fixture views, the query registry and its SQL oracle."""
