"""Repairs of one line and of one cell of an expression: braces, fences, arguments within too many braces, cut ends."""

from __future__ import annotations

from ..functions.dialect import Spark, chain, count_of
from .repair import MERGED, _bound, brace_difference

# Rewriting rules (pattern, replacement), in order.
CUT_ENDS = ((r"\\fra\s*\z", ""), (r"\\lef\s*\z", ""), (r"\\rig\s*\z", ""), (r"\\[a-z]{1,3}\s*\z", ""), (r"\}\s*\}\s*\}\s*\z", "}}"), (r"\\right\}\s*\\right\}\s*\z", r"\\right}"))
COLUMNS = r"^\{\s*[^}]+\s*\}\s*"
DISPLAY = ((r"(\\displaystyle\s*){2,}", r"\\displaystyle "),)
#: Up to so many fences of a line, and braces of a cell, are evened out; a cut command gets up to so many braces.
MOST_FENCES, MOST_BRACES, MOST_CUT = 3, 5, 3
#: A fence, and what may stand for its kind: a brace with a backslash is known by the backslash.
FENCE = r"\\left([\\{\[(|.])"
OPENERS, CLOSERS = "{[(\\", "}])}"


def stripped(d: Spark, x: str) -> str:
    """Without white space at both ends."""
    return d.sub(x, r"^\s+|\s+\z", "")


def even_ends(d: Spark, x: str) -> str:
    """One to three braces that a line leaves open are closed if it ends with one; if it closes one or two too many, those that it begins with go."""
    off = brace_difference(d, "y")
    closed = f"concat(y, repeat('}}', greatest({off}, 0)))"
    return _bound(d, x, f"CASE WHEN {off} BETWEEN 1 AND 3 AND {d.match('y', r'[{]+\s*\z')} THEN {closed} WHEN {off} BETWEEN -2 AND -1 THEN {d.sub('y', r'^\s*[}]+', '')} ELSE y END")


def close_fences(d: Spark, x: str) -> str:
    """Up to three open fences get their partners at the end, the last one first; commands that begin with `left` count, but have no partner."""
    missing = f"CAST({count_of(d, 'y', chr(92) + 'left')} - {count_of(d, 'y', chr(92) + 'right')} AS INT)"
    found = d.extract_all("y", FENCE, 1)
    last = d.slice(found, f"greatest({d.size(found)} - greatest({missing}, 0), 0) + 1", f"greatest({missing}, 0)")
    partners = f"translate(reverse({d.join(last, '')}), {d.lit(OPENERS)}, {d.lit(CLOSERS)})"
    return _bound(d, x, f"CASE WHEN {missing} BETWEEN 1 AND {MOST_FENCES} THEN concat(y, {d.sub(partners, '(.)', r'\\right\1')}) ELSE y END")


def line(d: Spark, x: str) -> str:
    """Merged commands apart, braces and fences evened out, then what was cut at the end; an empty line stays."""
    return stripped(d, chain(d, close_fences(d, even_ends(d, chain(d, x, MERGED))), CUT_ENDS))


#: A command whose argument begins with two further braces.
HEAVY = r"\\[a-zA-Z]+\{\{\{"


def lighter_arguments(d: Spark, x: str) -> str:
    """An argument that begins and ends with the same number of braces, two or more, loses the first and the last; inner commands come first.

    The text is folded from brace to brace into a stack of what is open. A brace that closes takes what
    is on top, makes it lighter if a command stands before its opening brace, and adds it to what is below. Texts
    without a command before three braces are left as they are.
    """
    events = d.each(d.extract_all("y", r"[{}][^{}]*", 0), d.array("substr(y, 1, 1)", "substr(y, 2)"))
    n = d.size("a")
    top, below, text = d.at("a", n), d.at("a", f"{n} - 1"), d.at("y", "2")
    lead, trail = d.extract(top, "^[{]+", 0), d.extract(top, r"[}]+\z", 0)
    content = f"CASE WHEN {d.match(below, r'\\[a-zA-Z]+\z')} AND length({lead}) >= 2 AND length({lead}) = length({trail}) THEN substr({top}, 2, length({top}) - 2) ELSE {top} END"
    closed = d.concat_arrays(d.slice("a", "1", f"greatest({n} - 2, 0)"), d.array(f"concat({below}, '{{', {content}, '}}', {text})"))
    step = f"CASE WHEN {d.at('y', '1')} = '{{' THEN {d.concat_arrays('a', d.array(text))} WHEN {n} > 1 THEN {closed} ELSE {d.array(f'concat({top}, ' + chr(39) + '}' + chr(39) + f', {text})')} END"
    folded = d.fold(events, d.array(d.extract("y", "^[^{}]*", 0)), step)
    return _bound(d, x, f"CASE WHEN {d.match('y', HEAVY)} THEN {d.join(folded, '{')} ELSE y END")


def _unwrapped(d: Spark, x: str) -> str:
    """Two or more braces at the start and as many at the end: one of each goes."""
    lead, trail = d.extract("y", "^[{]+", 0), d.extract("y", r"[}]+\z", 0)
    return _bound(d, x, f"CASE WHEN length({lead}) >= 2 AND length({lead}) = length({trail}) THEN {stripped(d, 'substr(y, 2, length(y) - 2)')} ELSE y END")


def _plain_braces(d: Spark, x: str) -> str:
    """Two braces around all of a text go if it holds no command and no brace; one of them goes if the braces within are even."""
    inner = "substr(y, 3, length(y) - 4)"
    plain = f"NOT contains({inner}, {d.lit(chr(92))}) AND NOT contains({inner}, '{{') AND NOT contains({inner}, '}}')"
    return _bound(d, x, f"CASE WHEN {d.match('y', r'(?s)^[{][{].*[}][}]' + chr(92) + 'z')} THEN CASE WHEN {plain} THEN {inner} WHEN {brace_difference(d, inner)} = 0 THEN concat('{{', {inner}, '}}') ELSE y END ELSE y END")


def even_braces(d: Spark, x: str) -> str:
    """Up to five missing braces are appended; of up to five too many those at the end go."""
    off = brace_difference(d, "y")
    cut = " ".join(f"WHEN {off} = -{k} THEN {d.sub('y', rf'[}}]{{1,{k}}}\z', '')}" for k in range(1, MOST_BRACES + 1))
    return _bound(d, x, f"CASE WHEN {off} BETWEEN 1 AND {MOST_BRACES} THEN concat(y, repeat('}}', greatest({off}, 0))) {cut} ELSE y END")


def cut_command(d: Spark, x: str) -> str:
    """The last command of a text that leaves an argument open gets up to three braces; with more open it goes."""
    tail = d.extract("y", r"\\[^\\]*\z", 0)
    off = brace_difference(d, tail)
    head = d.sub(f"substr(y, 1, length(y) - length({tail}))", r"\s+\z", "")
    whole = f"CASE WHEN {off} BETWEEN 1 AND {MOST_CUT} THEN concat(y, repeat('}}', greatest({off}, 0))) WHEN {off} > {MOST_CUT} THEN {head} ELSE y END"
    return _bound(d, x, f"CASE WHEN {d.match('y', r'\\[a-zA-Z]+\{[^}]*\z')} THEN {whole} ELSE y END")


def _cell(d: Spark, x: str, inner=None) -> str:
    """`inner` cleans what is still within two braces after one was taken off."""
    x = _unwrapped(d, chain(d, d.sub(stripped(d, x), COLUMNS, ""), DISPLAY))
    if inner:
        again = f"{d.match('y', r'(?s)^[{][{].*[}][}]' + chr(92) + 'z')}"
        x = _bound(d, x, f"CASE WHEN {again} THEN {inner(d, 'y')} ELSE y END")
    return stripped(d, cut_command(d, even_braces(d, _plain_braces(d, lighter_arguments(d, x)))))


def cell(d: Spark, x: str) -> str:
    """A cell of an array: column letters, repeated styles and superfluous braces go, braces are evened out, a cut command is closed or goes.

    What keeps two braces at both ends after one went is cleaned once more from the start. Blank cells stay as they are.
    """
    return f"CASE WHEN {stripped(d, x)} = '' THEN {x} ELSE {_cell(d, x, _cell)} END"


CHAINS = {"repair_line": line, "repair_cell": cell, "repair_arguments": lighter_arguments}
