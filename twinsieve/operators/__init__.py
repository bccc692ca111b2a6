"""Relational operators the jobs are composed of."""
