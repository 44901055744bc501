"""File, table and copy sinks."""

from tarnlake.sinks.files import append_batches, append_once, read_appended, save_delimited, save_json_lines, save_parquet, save_text
from tarnlake.sinks.tables import create_database, ingest, save_table
from tarnlake.sinks.transfer import checksum, copy_dataset

__all__ = [
    "append_batches",
    "append_once",
    "checksum",
    "copy_dataset",
    "create_database",
    "ingest",
    "read_appended",
    "save_delimited",
    "save_json_lines",
    "save_parquet",
    "save_table",
    "save_text",
]
