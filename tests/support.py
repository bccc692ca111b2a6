"""Values that tests and fixtures share; test modules import from here, since two folders have a conftest."""

from datetime import datetime, timezone

SAVED_US = int(datetime(2024, 5, 17, 10, 30, tzinfo=timezone.utc).timestamp()) * 1_000_000
