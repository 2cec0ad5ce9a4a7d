"""Relational operators over search results, pages, memory and graphs."""
