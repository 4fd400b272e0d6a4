"""Relational operators, statistics and dumps as DataFrame functions."""
