"""Prose analytics over document tables, written as DataFrame transformations."""
