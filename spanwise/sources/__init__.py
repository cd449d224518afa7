"""Readers: section macros, XML, YAML, JSON lines and STEP files as DataFrames with an explicit order."""
