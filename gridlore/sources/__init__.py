"""Readers and staging."""
