"""Whole analyses, the report store, and the registered queries."""
