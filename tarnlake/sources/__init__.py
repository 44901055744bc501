"""File, JDBC, staged, unload and catalog sources."""

from tarnlake.sources.files import scan_delimited, scan_json_lines, scan_json_texts, scan_parquet, scan_text
from tarnlake.sources.jdbc import (
    column_bounds,
    scan_jdbc,
    scan_jdbc_partitioned,
    scan_jdbc_predicates,
    scan_jdbc_query,
)
from tarnlake.sources.options import declared_types, scan_with_options
from tarnlake.sources.staged import staged_jdbc_scan, unload_scan
from tarnlake.sources.tables import scan_sql, scan_table
from tarnlake.sources.unload import Export, remote_unload_scan

__all__ = [
    "Export",
    "column_bounds",
    "declared_types",
    "remote_unload_scan",
    "scan_delimited",
    "scan_jdbc",
    "scan_jdbc_partitioned",
    "scan_jdbc_predicates",
    "scan_jdbc_query",
    "scan_json_lines",
    "scan_json_texts",
    "scan_parquet",
    "scan_sql",
    "scan_table",
    "scan_text",
    "scan_with_options",
    "staged_jdbc_scan",
    "unload_scan",
]
