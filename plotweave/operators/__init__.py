"""Relational operators over the story tables."""
