"""Relational operators over document tables."""
