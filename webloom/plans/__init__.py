"""Composite plans: the public entry points."""
