"""Pieces of DuckDB SQL that several oracles of this subpackage share."""

#: A table expression: the 256 remainders of CRC-32, from its rule.
CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS t)"""


def crc32_of(text: str) -> str:
    """The unsigned CRC-32 of an expression's UTF-8 bytes; ``crc_table`` must be
    among the tables joined."""
    x = f"hex(encode({text}))"
    byte = f"('0x' || substr({x}, 2 * i + 1, 2))::BIGINT"
    return (f"xor(4294967295, list_reduce(list_transform(range(0, length({x}) // 2), lambda i: {byte}), "
            "lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295))")
