"""Statistics of whole texts."""

from mathloom.llm import factorization


def test_ends_mark_reads_every_word():
    words = [b"word." if i % 4 == 1 else b"word" for i in range(1024)]
    got = factorization.statistics(b" ".join(words), words, {b"word": 768, b"word.": 256}, None)
    assert got[factorization.STATISTICS.index("ends_mark")] == 0.25
