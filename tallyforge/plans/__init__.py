"""Derived views over the star schema, and the registered queries with their SQL."""
