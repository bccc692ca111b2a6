"""Rescans driven by arriving inventory drops."""
