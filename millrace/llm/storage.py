"""Intermediate tables in the folder that the cluster names in spark.checkpoint.dir."""

from ..storage import clean, folder, store

__all__ = ["clean", "folder", "store"]
