"""The jobs: finding duplicates, scanning, rescanning and validating."""
