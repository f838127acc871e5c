"""Relational operators over sequence tables."""
