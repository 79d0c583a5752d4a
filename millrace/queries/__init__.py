"""Queries of the core operators over the tables of a directory, with their SQL for DuckDB.

A query without SQL uses what SQL can't express or can't do on whole tables in
reasonable time; it is tested against brute force on small tables.
"""

from . import accounts, curation, files, general, records
from .common import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "accounts", "curation", "files", "general", "records"]
