"""Readers of the input tables, and files of other kinds."""

from lumenfold.sources.files import read_files, write_files
from lumenfold.sources.tables import table

__all__ = ["read_files", "table", "write_files"]
