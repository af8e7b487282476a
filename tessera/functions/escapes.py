"""Code points and their \\uXXXX escapes, both ways, as Arrow-batched functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_ESCAPE = re.compile(r"(\\\\)|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})")


def _decoded(m: re.Match) -> str:
    if m[1]:
        return m[0]
    code = int(m[2] or m[3], 16)
    return m[0] if code in (0x22, 0x5C) or code > 0x10FFFF or 0xD800 <= code < 0xE000 else chr(code)


def decode_text(text: str) -> str:
    """Escapes of a literal as characters; quotes and backslashes stay escaped."""
    return _ESCAPE.sub(_decoded, text)


def decode_all_text(text: str) -> str:
    """All escapes as characters, those of eight digits first, quotes and backslashes too; a code point that there isn't stays."""
    point = lambda m: chr(int(m[1], 16)) if int(m[1], 16) <= 0x10FFFF and not 0xD800 <= int(m[1], 16) < 0xE000 else m[0]
    return re.sub(r"\\u([0-9A-Fa-f]{4})", point, re.sub(r"\\U([0-9A-Fa-f]{8})", point, text))


def encode_text(text: str) -> str:
    return "".join(c if " " <= c <= "~" else f"\\u{ord(c):04X}" if ord(c) < 0x10000 else f"\\U{ord(c):08X}" for c in text)


@F.pandas_udf(StringType())
def decode(text: pd.Series) -> pd.Series:
    return text.map(decode_text, na_action="ignore")


@F.pandas_udf(StringType())
def encode(text: pd.Series) -> pd.Series:
    return text.map(encode_text, na_action="ignore")


@F.pandas_udf(StringType())
def decode_all(text: pd.Series) -> pd.Series:
    return text.map(decode_all_text, na_action="ignore")
