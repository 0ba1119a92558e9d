"""What a text must hold for a pattern to match it: plain strings, looked for before the pattern is tried.

A pattern is tried at every place of a text, and most rules meet few texts. A search for a
plain string costs a small part of that, so a rule is tried only where one of its strings is there. The
strings are read off the pattern; a pattern that can't be read, or that needs none, is always tried.

Many rules allow blanks, braces and backslashes between letters. For these the strings are looked
for in the squeezed text: lower case, without such characters.
"""

from __future__ import annotations

import functools
import re
from re import _constants as C
from re import _parser

#: Fixed value: characters that the squeezed text does without; the blanks are those of Java's \\s.
SQUEEZED_OUT = " \t\n\x0b\f\r{}\\"
#: Fixed value: what it has in lower case, as patterns without regard to case go by ASCII alone.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed value: a class of up to so many signs is as many strings.
MOST_SIGNS = 6


def _squeezed_out(item) -> bool:
    """Whether all that a part of a pattern can match is left out of the squeezed text."""
    op, value = item
    if op is C.LITERAL:
        return chr(value) in SQUEEZED_OUT
    if op is C.IN:
        return all((o is C.LITERAL and chr(v) in SQUEEZED_OUT) or (o is C.CATEGORY and v is C.CATEGORY_SPACE) for o, v in value)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        return all(map(_squeezed_out, value[2]))
    if op is C.SUBPATTERN:
        return all(map(_squeezed_out, value[3]))
    return False


def _signs(value) -> tuple[str, ...]:
    """The characters of a small class without letters, digits and blanks; of others none, as most texts hold one of them."""
    if len(value) > MOST_SIGNS or not all(op is C.LITERAL for op, _ in value):
        return ()
    signs = tuple(chr(v) for _, v in value)
    return () if any(c.isalnum() or c.isspace() for c in signs) else signs


def _tells(strings: tuple[str, ...]) -> tuple:
    """How much strings tell of a text: long ones most, then those with a sign in each, then few."""
    signs = all(any(not c.isalnum() and not c.isspace() for c in s) for s in strings)
    return min(map(len, strings)), signs, -len(strings)


def _strings(items, squeezed: bool, any_case: bool) -> tuple[str, ...]:
    """Strings of which every match holds one; none if nothing is known."""
    found, run = [], []

    def end() -> None:
        if run:
            found.append(("".join(run),))
            run.clear()

    def read(parts) -> None:
        for item in parts:
            op, value = item
            if squeezed and _squeezed_out(item):
                continue
            if op is C.LITERAL:
                c = chr(value)
                if squeezed and c.isascii():
                    run.append(c.lower())
                elif not squeezed and not (any_case and c.isalpha()):
                    run.append(c)
                else:
                    end()
            elif op is C.SUBPATTERN and not value[1] and not value[2]:
                read(value[3])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] >= 1:
                read(value[2])
                end()
            elif op is C.BRANCH:
                end()
                each = [_strings(branch, squeezed, any_case) for branch in value[1]]
                if all(each):
                    found.append(tuple(dict.fromkeys(s for strings in each for s in strings)))
            elif op is C.IN:
                end()
                signs = _signs(value)
                if signs and not (squeezed and any(c in SQUEEZED_OUT or not c.isascii() for c in signs)):
                    found.append(signs)
            elif op not in (C.AT, C.ASSERT, C.ASSERT_NOT):
                end()

    read(items)
    end()
    return max(found, key=_tells, default=())


def _parsed(pattern: str):
    """The parts of a pattern of Java's; none if it can't be read as Python's."""
    flags = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    if (flags and set(flags[1]) - set("is")) or re.search(r"\\[0Qx]", pattern):
        return None
    try:
        return _parser.parse(pattern.replace(r"\z", r"\Z"))
    except re.error:
        return None


@functools.cache
def beyond_ascii(pattern: str) -> tuple[str, ...] | None:
    """If every match holds a character of a class beyond ASCII, the few signs of ASCII that the class has as well; otherwise nothing."""

    def signs(item) -> tuple[str, ...] | None:
        op, value = item
        if op is C.IN and all(o is C.LITERAL or (o is C.RANGE and v[0] > 0x7F) for o, v in value):
            within = [(o, v) for o, v in value if o is C.LITERAL and v <= 0x7F]
            return _signs(within) if len(within) < len(value) and len(_signs(within)) == len(within) else None
        if (op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] >= 1) or op is C.SUBPATTERN:
            return first(value[2] if op is not C.SUBPATTERN else value[3])
        return None

    def first(items) -> tuple[str, ...] | None:
        return next((found for found in map(signs, items) if found is not None), None)

    return first(_parsed(pattern) or ())


@functools.cache
def required(pattern: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(strings of which one is in the text, strings of which one is in the squeezed text) wherever a pattern of Java's matches."""
    tree = _parsed(pattern)
    if tree is None:
        return (), ()
    any_case = bool(tree.state.flags & re.I)
    plain, squeezed = _strings(tree, False, any_case), _strings(tree, True, any_case)
    # one letter says little, and a string of the text itself needs no squeezing
    if not squeezed or min(map(len, squeezed)) < 2 or (plain and min(map(len, plain)) >= min(map(len, squeezed))):
        squeezed = ()
    return plain, squeezed
