"""Operators from frames to frames."""

from tarnlake.operators.conform import conform_hive, conform_jdbc, jdbc_type, parse_type, widen_jdbc
from tarnlake.operators.mutate import delete_where, diff_counts, merge_upsert, update_where
from tarnlake.operators.nested import decode_nested, decode_rows, encode_nested
from tarnlake.operators.shape import (
    flatten_struct,
    map_count,
    nest_columns,
    normalize_names,
    preview,
    project_json,
)
from tarnlake.operators.summarize import (
    count_rows,
    first_per_key,
    heavy_keys,
    partition_sizes,
    pi_estimate,
    sum_reduce,
    total_length,
)

__all__ = [
    "conform_hive",
    "conform_jdbc",
    "count_rows",
    "decode_nested",
    "decode_rows",
    "delete_where",
    "diff_counts",
    "encode_nested",
    "first_per_key",
    "flatten_struct",
    "jdbc_type",
    "map_count",
    "merge_upsert",
    "nest_columns",
    "normalize_names",
    "parse_type",
    "heavy_keys",
    "partition_sizes",
    "pi_estimate",
    "preview",
    "project_json",
    "sum_reduce",
    "total_length",
    "update_where",
    "widen_jdbc",
]
