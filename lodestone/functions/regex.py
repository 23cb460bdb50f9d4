"""Python's regular expressions for Spark: translated to Java's where both can say the same.

A pattern is parsed by Python, and the tree is written out in Java's syntax with
what Python means: ``\\w``, ``\\d``, ``\\s`` and ``\\b`` over Unicode (or over ASCII
with that flag), ``.`` up to ``\\n`` only, ``$`` before a last ``\\n``, case as Python
folds it, written out as classes.  Names of groups become numbers.

Some patterns are left to Python, in Arrow batches: conditional groups, references
to groups in repeats or without regard to case, and unbounded repeats of more than
a character, for which Java's matcher needs stack in proportion to the text.

Characters that one of the two Unicode versions does not know yet may differ.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser
from collections.abc import Iterable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's word characters, digits and white space as bodies of Java classes; with the ASCII flag the second of each.
WORD = (r"\p{L}\p{N}_", "a-zA-Z0-9_")
DIGIT = (r"\p{Nd}", "0-9")
SPACE = (r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}", r"\x09-\x0d\x20")
#: A bounded repeat of a longer part is written out for Java up to this many times.
MOST_REPEATS = 100
_CLASSES = {sre.CATEGORY_WORD: (WORD, False), sre.CATEGORY_DIGIT: (DIGIT, False), sre.CATEGORY_SPACE: (SPACE, False)}
_CLASSES |= {sre.CATEGORY_NOT_WORD: (WORD, True), sre.CATEGORY_NOT_DIGIT: (DIGIT, True), sre.CATEGORY_NOT_SPACE: (SPACE, True)}
_REPEATS = {sre.MAX_REPEAT: "", sre.MIN_REPEAT: "?", sre.POSSESSIVE_REPEAT: "+"}
_ANY = "(?s:.)"


class Untranslatable(ValueError):
    """A pattern that Java cannot say, or not safely."""


@cache
def _case_groups() -> dict[int, frozenset[int]]:
    """Code point -> all that Python takes for it without regard to case, for those that have others."""
    related: dict[str, set[str]] = {}
    for point in range(0x110000):
        c = chr(point)
        if c.lower() != c or c.upper() != c:
            for key in {c.lower(), c.upper(), c.lower()[0], c.upper()[0]}:
                related.setdefault(key, set()).add(c)
    found = {}
    for c in {c for group in related.values() for c in group}:
        near = set().union(*(related.get(key, ()) for key in (c, c.lower(), c.upper(), c.lower()[0], c.upper()[0], c.upper().lower(), c.lower().upper())))
        same = re.compile(re.escape(c), re.IGNORECASE)
        members = frozenset(ord(x) for x in {c, *near} if same.fullmatch(x))
        if len(members) > 1:
            found[ord(c)] = members
    return found


def _same(point: int, flags: int) -> Iterable[int]:
    """The code points that a literal stands for."""
    if not flags & re.IGNORECASE:
        return (point,)
    if flags & re.ASCII:
        c = chr(point)
        return sorted({ord(c.lower()), ord(c.upper())}) if c.isascii() and c.isalpha() else (point,)
    return sorted(_case_groups().get(point, (point,)))


def _char(point: int) -> str:
    c = chr(point)
    return c if c.isascii() and c.isalnum() else f"\\x{{{point:x}}}"


def _atom(body: str, negated: bool = False) -> str:
    """One character of a class; a negated one as a look-ahead, as Java's nested negations are hard to read."""
    return f"(?:(?![{body}]){_ANY})" if negated else f"[{body}]"


def _range_body(low: int, high: int, flags: int) -> str:
    body = f"{_char(low)}-{_char(high)}"
    if flags & re.IGNORECASE:
        if flags & re.ASCII:
            groups = [{ord(c), ord(c.upper())} for c in "abcdefghijklmnopqrstuvwxyz"]
        else:
            groups = _case_groups().values()
        more = {p for group in groups if any(low <= p <= high for p in group) for p in group if not low <= p <= high}
        body += "".join(map(_char, sorted(more)))
    return body


def _literal(point: int, flags: int) -> str:
    points = list(_same(point, flags))
    return _char(point) if len(points) == 1 else _atom("".join(map(_char, points)))


def _category(code, flags: int) -> tuple[str, bool]:
    bodies, negated = _CLASSES[code]
    return bodies[bool(flags & re.ASCII)], negated


def _set(items: list, flags: int) -> str:
    negated, body = False, ""
    for op, value in items:
        if op is sre.NEGATE:
            negated = True
        elif op is sre.LITERAL:
            body += "".join(map(_char, _same(value, flags)))
        elif op is sre.RANGE:
            body += _range_body(*value, flags)
        else:
            own, inverse = _category(value, flags)
            body += f"[^{own}]" if inverse else own
    return _atom(body, negated)


def _at(code, flags: int) -> str:
    word = f"[{WORD[bool(flags & re.ASCII)]}]"
    if code is sre.AT_BEGINNING:
        return r"(?:\A|(?<=\n))" if flags & re.MULTILINE else r"\A"
    if code is sre.AT_BEGINNING_STRING:
        return r"\A"
    if code is sre.AT_END:
        return r"(?=\n|\z)" if flags & re.MULTILINE else r"(?=\n?\z)"
    if code is sre.AT_END_STRING:
        return r"\z"
    if code is sre.AT_BOUNDARY:
        return f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    # Before version 3.14 an empty text has neither kind of place.
    nowhere = "" if re.search(r"\B", "") else r"(?!\A\z)"
    return f"(?:(?<={word})(?={word})|(?<!{word})(?!{word}){nowhere})"


def _one_character(items) -> bool:
    return len(items) == 1 and items[0][0] in (sre.LITERAL, sre.NOT_LITERAL, sre.ANY, sre.IN)


def _repeat(op, low: int, high, body: str, single: bool) -> str:
    unbounded = high is sre.MAXREPEAT
    if not single and (unbounded or high > MOST_REPEATS):
        raise Untranslatable("an unbounded repeat of more than a character")
    bounds = {(0, True): "*", (1, True): "+"}.get((low, unbounded)) or ("?" if (low, high) == (0, 1) else f"{{{low},{'' if unbounded else high}}}")
    return f"{body if single else f'(?:{body})'}{bounds}{_REPEATS[op]}"


def _translated(items, flags: int, in_repeat: bool, held: set[int]) -> str:
    """``held``: groups within repeats, as far as they are seen."""
    out = []
    for op, value in items:
        if op is sre.LITERAL:
            out.append(_literal(value, flags))
        elif op is sre.NOT_LITERAL:
            out.append(_atom("".join(map(_char, _same(value, flags))), True))
        elif op is sre.ANY:
            out.append(_ANY if flags & re.DOTALL else r"[^\n]")
        elif op is sre.IN:
            out.append(_set(value, flags))
        elif op is sre.AT:
            out.append(_at(value, flags))
        elif op is sre.BRANCH:
            out.append("(?:" + "|".join(_translated(branch, flags, in_repeat, held) for branch in value[1]) + ")")
        elif op is sre.SUBPATTERN:
            group, add, remove, body = value
            if group is not None and in_repeat:
                held.add(group)
            inner = _translated(body, (flags | add) & ~remove, in_repeat, held)
            out.append(f"({inner})" if group is not None else f"(?:{inner})")
        elif op in _REPEATS:
            low, high, body = value
            out.append(_repeat(op, low, high, _translated(body, flags, True, held), _one_character(body)))
        elif op is sre.ATOMIC_GROUP:
            out.append(f"(?>{_translated(value, flags, in_repeat, held)})")
        elif op in (sre.ASSERT, sre.ASSERT_NOT):
            direction, body = value
            sign = ("=" if op is sre.ASSERT else "!") if direction > 0 else ("<=" if op is sre.ASSERT else "<!")
            out.append(f"(?{sign}{_translated(body, flags, in_repeat, held)})")
        elif op is sre.GROUPREF and value not in held and not flags & re.IGNORECASE:
            # The empty group keeps digits that follow apart.
            out.append(f"\\{value}(?:)")
        elif op is sre.FAILURE:
            out.append("(?!)")
        else:
            raise Untranslatable(str(op))
    return "".join(out)


def _parsed(pattern: str):
    tree = parser.parse(pattern)
    return tree, tree.state.flags


@cache
def to_java(pattern: str) -> str:
    """The same search in Java's syntax; raises ``Untranslatable``, or ``re.error`` for what is no pattern."""
    re.compile(pattern)
    tree, flags = _parsed(pattern)
    return _translated(tree, flags, False, set())


def searched(text: Column, pattern: str) -> Column:
    """Whether ``re.search(pattern, text)`` finds anything; null for null."""
    try:
        return text.rlike(to_java(pattern))
    except Untranslatable:
        return _in_python(pattern)(text)


def _in_python(pattern: str):
    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        search = re.compile(pattern).search
        return pd.Series([None if t is None else search(t) is not None for t in texts], dtype=object)

    return found


# What a match has to contain.  A requirement is a text, ("all", [..]) or ("any", [..]); None requires nothing.
Requirement = str | tuple[str, list] | None


def _all(parts: list[Requirement]) -> Requirement:
    known = [p for p in parts if p is not None]
    return known[0] if len(known) == 1 else ("all", known) if known else None


def _any(parts: list[Requirement]) -> Requirement:
    return None if not parts or any(p is None for p in parts) else parts[0] if len(parts) == 1 else ("any", list(parts))


def _lowered(point: int, flags: int) -> str | None:
    """The lower case that each character has that a literal stands for; None if there are several, or if it depends on its neighbours."""
    lows = {chr(p).lower() for p in _same(point, flags)}
    low = lows.pop()
    return low if not lows and len(low) == 1 and low not in "\u03c3\u03c2" else None


def _required(items, flags: int) -> Requirement:
    parts: list[Requirement] = []
    run = ""

    def end() -> None:
        nonlocal run
        if run:
            parts.append(run)
        run = ""

    for op, value in items:
        low = _lowered(value, flags) if op is sre.LITERAL else None
        if low is not None:
            run += low
            continue
        if op is sre.AT or op in (sre.ASSERT, sre.ASSERT_NOT):
            if op is sre.ASSERT and value[0] > 0:
                parts.append(_required(value[1], flags))
            continue
        end()
        if op is sre.SUBPATTERN:
            parts.append(_required(value[3], (flags | value[1]) & ~value[2]))
        elif op is sre.ATOMIC_GROUP:
            parts.append(_required(value, flags))
        elif op is sre.BRANCH:
            parts.append(_any([_required(branch, flags) for branch in value[1]]))
        elif op in _REPEATS and value[0]:
            parts.append(_required(value[2], flags))
    end()
    return _all(parts)


def required(pattern: str) -> Requirement:
    """Texts that the lower case of any text has in which the pattern is found."""
    re.compile(pattern)
    tree, flags = _parsed(pattern)
    return _required(tree, flags)


def may_match(lowered: Column, requirement: Requirement) -> Column:
    """Whether a lower-cased text has what is required."""
    if requirement is None:
        return F.lit(True)
    if isinstance(requirement, str):
        return lowered.contains(requirement)
    kind, parts = requirement
    each = [may_match(lowered, p) for p in parts]
    out = each[0]
    for more in each[1:]:
        out = out & more if kind == "all" else out | more
    return out
