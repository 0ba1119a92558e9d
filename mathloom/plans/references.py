"""Character references as a browser reads them: names with or without a semicolon, the longest one first, and numbers with their repairs.

All names of HTML 5 are known, those of two characters too. Names that end in a semicolon are
looked up by their initial; of those that may stand without one the longest that a reference
begins with counts, and what follows it stays. Texts are cut at their references and
put together again inside one expression, so no text is shuffled.
"""

from __future__ import annotations

import html.entities
import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import Spark
from ..operators.repair import _bound

#: A reference: a number, or up to 32 characters of a name.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: What stands for a number of no character.
UNKNOWN = "�"
#: One above the last code point.
BEYOND = 0x110000


def _control(code: int) -> str:
    """The numbers 128 to 159 are read as Windows-1252, where that has a character."""
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(code)


CONTROLS = tuple(_control(code) for code in range(128, 160))


def names() -> list[tuple[int, str, str]]:
    """(seq, name, text): names without their semicolon, in order."""
    table = {name.rstrip(";"): text for name, text in html.entities.html5.items()}
    return [(seq, name, text) for seq, (name, text) in enumerate(sorted(table.items()))]


def entity_table(spark: SparkSession) -> DataFrame:
    """(seq, name, text) of all named references; a table of fixed size, so a join with it may be broadcast."""
    return spark.createDataFrame(names(), "seq INT, name STRING, text STRING")


def _named(d: Spark, y: str) -> str:
    """What a named reference stands for; itself, if no name is known that it begins with."""
    closed: dict[str, list[tuple[str, str]]] = {}
    for name, text in sorted(html.entities.html5.items()):
        if name.endswith(";"):
            closed.setdefault(name[0], []).append((f"&{name}", text))
    whole = f"CASE substr({y}, 2, 1) " + " ".join(f"WHEN '{initial}' THEN {d.lookup(pairs, y)}" for initial, pairs in closed.items()) + " END"
    opened = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    start = d.extract(y, f"^&(?:{'|'.join(map(re.escape, opened))})", 0)
    text = d.lookup([(f"&{n}", html.entities.html5[n]) for n in opened], start)
    begun = f"CASE WHEN {start} <> '' THEN concat({text}, substr({y}, length({start}) + 1)) END"
    # most references end in a semicolon and are whole names
    return f"coalesce(CASE WHEN right({y}, 1) = ';' THEN {whole} END, {begun}, {y})"


def _code(d: Spark, y: str) -> str:
    """The number of a numeric reference, or one beyond all code points if it has too many digits."""
    decimal, hexes = d.extract(y, r"^&#0*([0-9]*);?\z", 1), d.extract(y, r"^&#[xX]0*([0-9a-fA-F]*);?\z", 1)
    return f"""CASE WHEN {d.match(y, '^&#[xX]')} THEN CASE WHEN length({hexes}) > 6 THEN {BEYOND} ELSE coalesce({d.from_hex(f'substr({hexes}, 1, 6)')}, 0) END
        WHEN length({decimal}) > 7 THEN {BEYOND} ELSE CAST(concat('0', substr({decimal}, 1, 7)) AS INT) END"""


def _character(d: Spark, code: str) -> str:
    """What a number stands for: numbers of no character the unknown one, controls and non-characters nothing."""
    none = f"{code} = 0 OR {code} BETWEEN 55296 AND 57343 OR {code} >= {BEYOND}"
    controls = d.at(d.array(*map(d.lit, CONTROLS)), f"{code} - 127")
    empty = f"{code} BETWEEN 1 AND 8 OR {code} = 11 OR {code} BETWEEN 14 AND 31 OR {code} = 127 OR {code} BETWEEN 64976 AND 65007 OR {code} % 65536 >= 65534"
    own = d.char(f"CASE WHEN {none} OR {code} BETWEEN 127 AND 159 THEN 63 ELSE {code} END")
    return f"CASE WHEN {none} THEN '{UNKNOWN}' WHEN {code} BETWEEN 128 AND 159 THEN {controls} WHEN {empty} THEN '' ELSE {own} END"


def decode_one(d: Spark, y: str = "y") -> str:
    return f"CASE WHEN substr({y}, 2, 1) = '#' THEN {_bound(d, _code(d, y), _character(d, 'y'))} ELSE {_named(d, y)} END"


def decode(d: Spark, x: str) -> str:
    """A text with its references decoded, each once; null stays null."""
    pieces = d.interleave(d.split(x, REFERENCE), d.each(d.extract_all(x, REFERENCE, 0), decode_one(d)))
    return f"CASE WHEN contains({x}, '&') THEN {pieces} ELSE {x} END"


def _references(d):
    """All references of pages and documents, with how often they come and what they stand for; each is decoded once."""
    found = " UNION ALL ".join(f"SELECT reference FROM {table} {d.explode(d.extract_all(column, REFERENCE, 0), 'reference')}" for table, column in (("pages", "html"), ("documents", "text")))
    return f"SELECT reference, n, {decode_one(d, 'reference')} AS decoded FROM (SELECT reference, count(*) AS n FROM ({found}) f GROUP BY reference) r"


def _used_names(d):
    """Characters beyond ASCII that documents and pages use, with how many names they have, and the first and the last of these."""
    rows = ", ".join(f"({seq}, {d.lit(name)}, {d.lit(text)})" for seq, name, text in names())
    chars = " UNION ALL ".join(f"SELECT ch FROM {table} {d.explode(d.extract_all(column, r'[^\x00-\x7F]', 0), 'ch')}" for table, column in (("pages", "html"), ("documents", "text")))
    used = f"(SELECT ch, count(*) AS n FROM ({chars}) c GROUP BY ch) u"
    return f"""SELECT ch, n, count(name) AS n_names, min(name) AS first_name, {d.max_by('name', 'seq')} AS last_name
        FROM {used} LEFT JOIN (VALUES {rows}) AS e(seq, name, text) ON text = ch GROUP BY ch, n"""


TEMPLATES = {
    "entity_references_html5": ((), _references),
    "proj_entity_unescape": ((), lambda d: f"SELECT page_id, {decode(d, 'html')} AS text FROM pages"),
    "entity_names_used": ((), _used_names),
}
