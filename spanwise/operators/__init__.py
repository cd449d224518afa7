"""Relational operators that section analytics is made of."""
