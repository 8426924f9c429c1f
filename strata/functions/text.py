"""String expressions that reports and file names need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What HTML escapes, the ampersand first, as the others bring new ones in.
_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]


def html_escape(text: Column) -> Column:
    for plain, escaped in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def without_prefix(text: Column, prefixes: list[str]) -> Column:
    """The text without the first of these prefixes that it starts with."""
    out = text
    for prefix in reversed(prefixes):
        out = F.when(text.startswith(prefix), F.substr(text, F.lit(len(prefix) + 1))).otherwise(out)
    return out


def cut_end(text: Column, n: int) -> Column:
    """The text without its last ``n`` characters."""
    return F.left(text, F.greatest(F.char_length(text) - n, F.lit(0)))


#: Words are runs without these characters.
BLANKS = "[\\x20\\x09-\\x0D]+"


def shingles(text: Column, n: int) -> Column:
    """Every n words in a row, joined by a space; all words where there are fewer, none where there are none."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")

    def cut(held: Column) -> Column:
        rows = F.transform(F.sequence(F.lit(1), F.greatest(F.size(held) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(held, i, n), " "))
        return F.when(F.size(held) > 0, rows).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(words), cut)[0]
