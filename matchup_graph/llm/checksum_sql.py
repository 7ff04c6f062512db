"""DuckDB SQL of crc32, which it lacks."""


def _table() -> list[int]:
    out = []
    for value in range(256):
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 * (value & 1))
        out.append(value)
    return out


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8 bytes, as bigint."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: cast('0x' || h AS bigint))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {data}), lambda c, b: xor(c >> 8, ({_table()})[(xor(c, b) & 255::bigint) + 1])), 4294967295::bigint)"
