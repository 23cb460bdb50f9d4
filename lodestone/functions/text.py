"""Text functions as column expressions.

They follow Python's string semantics where those differ from the built-in
functions: Unicode white space, line separators and digits.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A term is an identifier, a run of digits or a run of CJK ideographs (fixed values).
TERM = r"[A-Za-z_][A-Za-z0-9_]*|\d+|[\u4e00-\u9fff]+"
#: What ends a line, as in ``str.splitlines``.
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
_BLANK = r"[\s\x1c-\x1f\x85]"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where ``body`` uses it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def terms(text: Column) -> Column:
    """The lower-cased terms of a text, in order and with repeats; null: none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U){TERM}"), F.lit(0))
    return F.transform(found, lambda t: F.lower(t))


def query_terms(query: str | None) -> list[str]:
    """The same of a query that is given as a value."""
    return [t.lower() for t in re.findall(TERM, query or "")]


def occurrences(text: Column, part: Column | str) -> Column:
    """Non-overlapping occurrences of a non-empty part."""
    part = F.lit(part) if isinstance(part, str) else part
    return F.floor((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")


def definitions(lowered: Column, term: str) -> Column:
    """How often a lower-cased text defines a term as a function or class.

    The regex runs only where the term and a keyword occur at all.
    """
    pattern = rf"(?U)\b(?:async\s+def|def|class)\s+{re.escape(term)}\b"
    possible = lowered.contains(term) & (lowered.contains("def") | lowered.contains("class"))
    return F.when(possible, F.regexp_count(lowered, F.lit(pattern))).otherwise(F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends, as ``str.strip``."""
    return F.regexp_replace(text, rf"(?U)^{_BLANK}+|{_BLANK}+$", "")


def lines(text: Column) -> Column:
    """The lines of a text, as ``str.splitlines``; a last empty one does not count."""

    def without_last(parts: Column) -> Column:
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)

    return let(F.split(F.coalesce(text, F.lit("")), LINE_END), without_last)


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 with replacement characters, and line ends as ``\\n``."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"\r\n?", "\n")


def truncated(text: Column, limit: int, marker: str) -> Column:
    """The first ``limit`` characters and the marker, if there are more."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)


def preview(text: Column, chars: int) -> Column:
    return strip(F.substring(text, 1, chars))


def first_position(lowered: Column, parts: list[str]) -> Column:
    """The least position (from 0) of any of the parts; null if none is there."""
    found = [F.nullif(F.instr(lowered, p), F.lit(0)) for p in dict.fromkeys(parts)]
    return reduce(lambda a, b: F.least(a, b), found) - 1


def excerpt(text: Column, parts: list[str], limit: int) -> Column:
    """``limit`` characters around the first part that occurs, or from the start."""
    start = F.coalesce(F.greatest(F.lit(0), first_position(F.lower(text), parts) - limit // 3), F.lit(0))
    return strip(F.substr(text, start + 1, F.lit(limit)))


def is_true(value: Column) -> Column:
    """Whether a setting's text means yes (fixed values)."""
    return F.coalesce(F.lower(strip(value)).isin("1", "true", "yes", "on"), F.lit(False))
