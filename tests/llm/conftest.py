"""These tests need the corpus operators."""
