"""Registered queries: library calls on the provided tables, each next to its SQL oracle."""
