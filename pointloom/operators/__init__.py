"""Relational operators on scene tables."""
