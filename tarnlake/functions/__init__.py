"""Column expressions."""

from tarnlake.functions.text import (
    before_first,
    count_char,
    digit_groups,
    init_upper,
    iso_timestamp,
    last_token,
    row_text,
    strip_blanks,
    tail,
)
from tarnlake.functions.time import epoch_millis

__all__ = [
    "before_first",
    "count_char",
    "digit_groups",
    "epoch_millis",
    "init_upper",
    "iso_timestamp",
    "last_token",
    "row_text",
    "strip_blanks",
    "tail",
]
