"""Small DuckDB SQL fragments shared by the oracle queries."""

# Unicode whitespace as Python's str.strip / Java's (?U)\s see it (RE2 \s is ASCII only).
WS = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


_STRIP_SET = " || ".join(f"chr({ord(ch)})" for ch in "".join(chr(i) for i in range(0x3001) if chr(i).isspace()))


def strip(x: str) -> str:
    return f"trim({x}, {_STRIP_SET})"


def present(x: str) -> str:
    return f"({x} IS NOT NULL AND {x} <> '')"


def present_arr(x: str) -> str:
    return f"(coalesce(len({x}), 0) > 0)"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{WS}]+'), lambda t: t <> '')"


def rmatch(x: str, pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"regexp_matches({x}, '{p}', 'i')"
