"""Reusable relational operators: ranking, spatial joins, polygons, skyline, spreading, checks."""
