"""Inventories, file trees, contents and reports."""
