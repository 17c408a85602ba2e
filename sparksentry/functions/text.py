"""Text scalars as Column builders: percent coding, decoding of bytes, the security tokeniser, n-grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token alternatives, in order of preference.
TOKEN_PATTERN = r"""(?U)(%[0-9A-Fa-f]{2}|</?[a-zA-Z][\w-]*|-{2,}|/\*!?\d*|\*/|\b[a-zA-Z_][a-zA-Z0-9_]*\b|\d+|[='"<>();])"""
#: The same tokens of an ASCII text, where no two alternatives can begin at one character but '<'.
ASCII_TOKEN_PATTERN = r"""(\b[a-zA-Z_][a-zA-Z0-9_]*+|\d++|%[0-9A-Fa-f]{2}|</?[a-zA-Z][\w-]*+|-{2,}+|/\*!?\d*+|\*/|[='"<>();])"""


def percent_decode(text: Column) -> Column:
    """One pass; '+' and malformed escapes stay, invalid UTF-8 becomes U+FFFD."""
    safe = F.replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.url_decode(safe)


def percent_encode(text: Column) -> Column:
    """All but RFC 3986 unreserved characters."""
    out = F.url_encode(text)
    for made, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(made), F.lit(wanted))
    return out


def utf8_text(body: Column) -> Column:
    """Bytes as text; malformed sequences become U+FFFD."""
    return F.make_valid_utf8(body.cast("string"))


def ascii_fold(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", " ")


def tokenize(text: Column) -> Column:
    """Security tokens of a payload; plain identifiers are lower-cased, tags keep their case."""
    of = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    tokens = F.when(is_ascii(text), of(ASCII_TOKEN_PATTERN)).otherwise(of(TOKEN_PATTERN))
    # only identifiers begin with a letter or '_'; digits have no case
    return F.transform(tokens, lambda t: F.when(F.ascii(t) >= 65, F.lower(t)).otherwise(t))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def one_two_grams(tokens: Column) -> Column:
    """Tokens, then adjacent pairs joined by a space."""
    pairs = F.when(F.size(tokens) > 1, F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.concat(tokens, pairs)
