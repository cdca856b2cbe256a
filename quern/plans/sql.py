"""Fragments of DuckDB SQL that the queries' oracles share."""


def H(seed, key: str) -> str:
    """md5 of the seed and a key: the rank that stands for a seeded shuffle."""
    return f"md5(concat_ws(':', '{seed}', CAST({key} AS VARCHAR)))"


def U(seed, key: str) -> str:
    """A double in [0, 1) from 32 bits of H."""
    return f"(CAST('0x' || substr({H(seed, key)}, 1, 8) AS BIGINT) / CAST(4294967296.0 AS DOUBLE))"
