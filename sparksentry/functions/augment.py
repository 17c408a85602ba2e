"""Evasion-style variants of labelled payloads, to measure how robust a detector is.

Every choice is a coin from md5(seed | id | technique | place), so it can be repeated by any engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import percent_encode

# SQL keywords, stand-ins for a space, and stand-ins for six characters.
KEYWORDS = ["select", "union", "insert", "update", "delete", "drop", "or", "and", "from", "where", "table", "database", "exec", "declare", "cast"]
SPACES = ["\t", "\n", "/**/", "%09", "%0a"]
STAND_INS = {"<": ["%3C", "\\u003C", "&#60;", "&lt;"], ">": ["%3E", "\\u003E", "&#62;", "&gt;"], "'": ["%27", "\\u0027", "&#39;"], '"': ["%22", "\\u0022", "&#34;"], "(": ["%28", "\\u0028"], ")": ["%29", "\\u0029"]}
KEYWORD_PATTERN = r"(?i)\b(" + "|".join(KEYWORDS) + r")\b"


def coin(key: Column, *parts: Column | str | int) -> Column:
    """A number from 0 to 65535."""
    said = F.concat_ws("|", key, *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 4), 16, 10).cast("int")


def by_character(text: Column, change: Callable[[Column, Column], Column]) -> Column:
    return F.array_join(F.transform(F.split(text, ""), change), "")


def partial_url_encode(text: Column, key: Column, probability: float = 0.5) -> Column:
    plain = r"^[\p{L}\p{N}]$"
    return by_character(text, lambda c, i: F.when(~c.rlike(plain) & (coin(key, "partial", i) < probability * 65536), percent_encode(c)).otherwise(c))


def whitespace(text: Column, key: Column) -> Column:
    return by_character(text, lambda c, i: F.when(c == " ", F.element_at(F.array(*map(F.lit, SPACES)), coin(key, "space", i) % len(SPACES) + 1)).otherwise(c))


def case_toggle_all(text: Column, key: Column) -> Column:
    return by_character(text, lambda c, i: F.when(coin(key, "all", i) < 32768, F.upper(c)).otherwise(F.lower(c)))


def _flip(c: Column) -> Column:
    return F.when(c == F.lower(c), F.upper(c)).otherwise(F.lower(c))


def case_toggle(text: Column, key: Column) -> Column:
    """Flips letters of keywords, one at least in each."""
    rest = F.split(text, KEYWORD_PATTERN, -1)
    words = F.regexp_extract_all(text, F.lit(KEYWORD_PATTERN), F.lit(0))

    def toggled(w: Column, i: Column) -> Column:
        forced = coin(key, "forced", i) % F.length(w)
        return by_character(w, lambda c, j: F.when((coin(key, "flip", i, j) < 32768) | (j == forced), _flip(c)).otherwise(c))

    flipped = F.concat(F.transform(words, toggled), F.array(F.lit("")))
    return F.array_join(F.zip_with(rest, flipped, lambda r, w: F.concat(r, w)), "")


def comment_insertion(text: Column, key: Column) -> Column:
    """Splits the first keyword by a comment, if it has four letters."""
    word = F.regexp_extract(text, KEYWORD_PATTERN, 0)
    at = F.regexp_instr(text, F.lit(KEYWORD_PATTERN))
    cut = coin(key, "cut") % F.greatest(F.length(word) - 3, F.lit(1)) + 2
    mark = F.when(coin(key, "version") < 32768, "/**/").otherwise("/*!50000*/")
    return F.when(F.length(word) >= 4, F.concat(F.substring(text, F.lit(1), at + cut - 1), mark, F.substring(text, at + cut, F.length(text)))).otherwise(text)


def unicode_substitution(text: Column, key: Column) -> Column:
    """Replaces special characters by escapes with probability 0.7, one at least."""
    special = r"[<>'\"()]"
    total = F.regexp_count(text, F.lit(special))
    forced = coin(key, "forced") % F.greatest(total, F.lit(1))
    chars = F.split(text, "")
    known = F.create_map(*(x for c, subs in STAND_INS.items() for x in (F.lit(c), F.array(*map(F.lit, subs)))))

    def change(c: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(chars, F.lit(1), i), lambda x: x.rlike(special)))
        pick = known[c][coin(key, "stand", i) % F.size(known[c])]
        return F.when(c.rlike(special) & ((before == forced) | (coin(key, "sub", i) < 45875)), pick).otherwise(c)

    return F.array_join(F.transform(chars, change), "")


TECHNIQUES: dict[str, Callable[[Column, Column], Column]] = {
    "url_encode": lambda t, k: percent_encode(t),
    "double_url_encode": lambda t, k: percent_encode(percent_encode(t)),
    "partial_url_encode": partial_url_encode,
    "whitespace": whitespace,
    "case_toggle": case_toggle,
    "comment_insertion": comment_insertion,
    "unicode_substitution": unicode_substitution,
}
FALLBACK = "fallback_full_url_encode"


def chosen_techniques(key: Column, count: int | None = None) -> Column:
    """1 to 3 distinct techniques in a drawn order."""
    names = F.array(*(F.struct(coin(key, "order", n).alias("o"), F.lit(n).alias("n")) for n in TECHNIQUES))
    k = F.lit(count) if count is not None else coin(key, "count") % 3 + 1
    return F.transform(F.slice(F.array_sort(names), F.lit(1), k), lambda x: x["n"])


def with_random_variant(df, text: str, key: Column, count: int | None = None):
    """Adds `variant` and `techniques`; what no technique changes is percent-encoded in full.

    One column for each of the three steps keeps the plan small: each is a CASE over the techniques.
    """
    df = df.withColumn("techniques", chosen_techniques(key, count)).withColumn("variant", F.col(text))
    for step in range(count or 3):
        name = F.get(F.col("techniques"), F.lit(step))
        made = F.col("variant")
        for n, technique in TECHNIQUES.items():
            made = F.when(name == n, technique(F.col("variant"), F.concat_ws("|", key, F.lit(str(step))))).otherwise(made)
        df = df.withColumn("variant", made)
    same = F.col("variant") == F.col(text)
    full = partial_url_encode(F.col(text), key, 1.0)
    return df.withColumn("techniques", F.when(same, F.concat("techniques", F.array(F.lit(FALLBACK)))).otherwise(F.col("techniques"))).withColumn("variant", F.when(same, full).otherwise(F.col("variant")))
