"""Whole jobs: from files to tables, answers and reports."""
