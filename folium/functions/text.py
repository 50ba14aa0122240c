"""Lines, literal search, stripping, tokens, timestamps."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a line, and what counts as white space, as Python's str has them.
LINE_END = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"
SPACE = "[\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
TIME = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def lines(text: Column) -> Column:
    """The lines of a text; what follows the last line end is a line only if it isn't empty."""
    pieces = F.split(text, LINE_END, -1)
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)


def contains(text: Column, query: str, case_sensitive: bool = False) -> Column:
    """Literal occurrence; without case, letters are folded as Unicode has them. An empty query occurs everywhere."""
    if case_sensitive or not query:
        return text.contains(query)
    return text.rlike("(?iu)" + re.escape(query))


def spans_lines(query: str) -> bool:
    return re.search(LINE_END, query) is not None


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def one_kind_of_line_end(text: Column) -> Column:
    """CR LF and CR become LF, as reading a file as text does."""
    return F.regexp_replace(text, "\\r\\n?", "\n")


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def masked(username: Column, hashed: Column, prefix: str = "folium_") -> Column:
    """A token for display: stars and the last 8 characters of its hash; N/A without a hash."""
    shown = F.concat(F.lit(prefix), username, F.lit("_" + "*" * 24), F.right(hashed, F.lit(8)))
    return F.when(F.coalesce(hashed, F.lit("")) == "", "N/A").otherwise(shown)


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, TIME)
