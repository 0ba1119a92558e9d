"""Character references against Python's own reader of HTML."""

import html
import html.entities
import random

from mathloom.plans import references
from tests.test_engine import evaluate


def test_every_name_alone_and_with_something_after_it(spark):
    texts = [f"{before}&{name}{after}" for name in html.entities.html5 for before, after in (("", ""), ("a ", "b;"), ("&", " &"))]
    assert evaluate(spark, references.decode, *texts) == [html.unescape(t) for t in texts]


def test_numbers(spark):
    codes = [*range(0, 0x180), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFE, 0x10FFFD, 0x10FFFF, 0x110000, 10**7, 10**12]
    texts = [form.format(c) for c in codes for form in ("&#{};", "&#{}x", "&#x{:x};", "&#X{:X} ", "&#000000000{};", "&#x0000000{:x}")]
    assert evaluate(spark, references.decode, *texts) == [html.unescape(t) for t in texts]


def test_random_texts(spark):
    rng = random.Random(7)
    parts = ["&", "#", "x", ";", "amp", "lt", "not", "notin", "notit", "alpha", "NotEqualTilde", "é", " ", "\n", "\t", "<", "1", "65", "9f", "\\", "'", "{", "}", "$", "copy", "CounterClockwiseContourIntegral"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(4000)] + [None, "", "&", "&;", "&#;", "&#x;", "& amp;", "&" + "a" * 100, "&amp" * 20000]
    assert evaluate(spark, references.decode, *texts) == [None if t is None else html.unescape(t) for t in texts]


def test_table(spark):
    rows = {r.name: r.text for r in references.entity_table(spark).collect()}
    assert rows == {n.rstrip(";"): t for n, t in html.entities.html5.items()}
