"""File trees in, catalogue tables in and out."""

from stowage.sources.contents import hash_files, partial_hash_files
from stowage.sources.listing import list_each, list_errors, list_files, list_folders, walk
from stowage.sources.store import CatalogueStore

__all__ = ["CatalogueStore", "hash_files", "list_each", "list_errors", "list_files", "list_folders", "partial_hash_files", "walk"]
