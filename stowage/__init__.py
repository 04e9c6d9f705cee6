"""File-catalogue analytics on Spark.

Every operator takes DataFrames and returns a lazy DataFrame. Tables follow the
layouts in :mod:`stowage.schemas`.
"""

from stowage.session import build_session, cut_lineage, work_folder

__all__ = ["build_session", "cut_lineage", "work_folder"]
