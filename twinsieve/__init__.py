"""Finds duplicate files and folder trees in large inventories, and keeps the findings true over time."""

from .plans.duplicate_files import FileDuplicates, find_duplicate_files
from .plans.duplicate_folders import FolderDuplicates, find_duplicate_folders
from .plans.rescan import previous_hashes
from .plans.scan import scan
from .plans.validate import validate
from .session import build_session
from .sources.inventory import Catalog, load_catalog
from .sources.report import ScanSettings, read_report, write_report
from .sources.tree import scan_tree

__all__ = [
    "Catalog",
    "FileDuplicates",
    "FolderDuplicates",
    "ScanSettings",
    "build_session",
    "find_duplicate_files",
    "find_duplicate_folders",
    "load_catalog",
    "previous_hashes",
    "read_report",
    "scan",
    "scan_tree",
    "validate",
    "write_report",
]
