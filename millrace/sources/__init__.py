"""Scans: session logs, source trees, experiment runs and the star-schema tables, as DataFrames."""
