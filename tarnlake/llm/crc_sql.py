"""CRC-32 of ids in SQL that has no function for it."""

#: A table ``crc_table`` of one row, for a WITH clause: the remainder of each byte, as a list.
CRC_TABLE = """crc_table AS (
        SELECT list(list_reduce(list_concat([b], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
            ORDER BY b) AS remainders
        FROM range(256) AS bytes(b)
    )"""


def crc32(number: str) -> str:
    """The unsigned CRC-32 of a number's decimal text, next to ``crc_table``."""
    digits = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))"
    step = "lambda c, s: xor(c >> 8, remainders[(xor(c, s) & 255) + 1])"
    return f"xor(list_reduce(list_concat([4294967295], {digits}), {step}), 4294967295)"
