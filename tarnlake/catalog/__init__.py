"""Table definitions, column listings and profiles."""

from tarnlake.catalog.columns import catalog_columns, column_facts, column_profile, table_comments
from tarnlake.catalog.ddl import (
    clone_table,
    create_external_table,
    create_jdbc_table,
    drop_partition_columns,
    drop_table,
    partition_columns,
    table_facts,
)

__all__ = [
    "catalog_columns",
    "clone_table",
    "column_facts",
    "column_profile",
    "create_external_table",
    "create_jdbc_table",
    "drop_partition_columns",
    "drop_table",
    "partition_columns",
    "table_comments",
    "table_facts",
]
