"""Scans of pages, result pages, proxy lists and the memory table."""
