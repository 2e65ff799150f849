"""Readers and writers: staged CSV, archives, run catalogs, GeoJSON rows."""
