"""Brackets of whole texts and of MathML rows: which are unmatched or unclosed, and the text mended.

A text is cut into stretches that each end with a bracket, and a stack of openers is
folded over them. A closer that meets its partner on top of the stack is matched;
one that meets another opener is dropped; one that meets an empty stack waits for what
stands before, as a fold may begin anywhere: the fold of a block of stretches is a summary
(closers that wait, openers that are open, what was dropped), and summaries of
neighbouring blocks are merged in order. So a long text costs a block's fold for each block and
one merge for each, not a stack copied at every bracket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import DUCK, SPARK
from ..sources.relations import run_sql, with_relations

#: Openers and their closers, at the same places.
OPENERS, CLOSERS = "([{", ")]}"
#: What a backslash stands before is no bracket: both give way to as many other characters.
ESCAPE, MASK = r"(?s)\\.", "\x01\x01"
#: A stretch up to the next bracket.
STRETCH = r"[^()\[\]{}]*[()\[\]{}]"
BRACKETED = r"(?s)^.*[()\[\]{}]"
#: Stretches that are folded one by one.
BLOCK = 512

_MARK = "struct<at: bigint, ch: string>"
_STATE = f"struct<at: bigint, waiting: array<{_MARK}>, stack: array<{_MARK}>, dropped: array<bigint>>"


def _partner(ch: Column) -> Column:
    return F.translate(ch, CLOSERS, OPENERS)


def _top(stack: Column) -> Column:
    return F.try_element_at(stack, F.lit(-1)).getField("ch")


def _close(stack: Column, dropped: Column, waiting: Column, mark: Column) -> tuple[Column, Column, Column]:
    """The stack, what was dropped and what waits after a closer."""
    matched, none = _top(stack) == _partner(mark["ch"]), F.size(stack) == 0
    popped = F.when(F.coalesce(matched, F.lit(False)), F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(stack)
    lost = F.when(~none & ~F.coalesce(matched, F.lit(False)), F.concat(dropped, F.array(mark["at"]))).otherwise(dropped)
    return popped, lost, F.when(none, F.concat(waiting, F.array(mark))).otherwise(waiting)


def _state(at, waiting, stack, dropped) -> Column:
    return F.struct(at.alias("at"), waiting.alias("waiting"), stack.alias("stack"), dropped.alias("dropped")).cast(_STATE)


def _nothing() -> Column:
    marks = F.array().cast(f"array<{_MARK}>")
    return _state(F.lit(0).cast("bigint"), marks, marks, F.array().cast("array<bigint>"))


def _folded(stretches: Column) -> Column:
    """The summary of a block: places count from its beginning."""

    def step(state: Column, stretch: Column) -> Column:
        at = state["at"] + F.length(stretch)
        ch = F.substring(stretch, -1, 1)
        mark = F.struct((at - 1).alias("at"), ch.alias("ch")).cast(_MARK)
        stack, dropped, waiting = _close(state["stack"], state["dropped"], state["waiting"], mark)
        opens = F.instr(F.lit(OPENERS), ch) > 0
        return _state(at, F.when(opens, state["waiting"]).otherwise(waiting), F.when(opens, F.concat(state["stack"], F.array(mark))).otherwise(stack), F.when(opens, state["dropped"]).otherwise(dropped))

    return F.aggregate(stretches, _nothing(), step)


def _merged(left: Column, right: Column) -> Column:
    """The summary of two neighbouring blocks."""

    def moved(marks: Column) -> Column:
        return F.transform(marks, lambda m: F.struct((m["at"] + left["at"]).alias("at"), m["ch"].alias("ch")).cast(_MARK))

    def step(state: Column, mark: Column) -> Column:
        stack, dropped, waiting = _close(state["stack"], state["dropped"], state["waiting"], mark)
        return _state(state["at"], waiting, stack, dropped)

    met = F.aggregate(moved(right["waiting"]), left, step)
    # bound once: the fold above is read three times
    both = F.transform(F.array(met), lambda m: _state(left["at"] + right["at"], m["waiting"], F.concat(m["stack"], moved(right["stack"])), F.concat(m["dropped"], F.transform(right["dropped"], lambda d: d + left["at"]))))
    return both[0]


def with_brackets(texts: DataFrame, text: str = "payload", into: str = "brackets", block: int = BLOCK) -> DataFrame:
    """texts with a struct: unmatched and unclosed, places from 0 in code points, and mended.

    In the mended text unmatched closers are gone and open brackets are closed at its end,
    the last one first. Null texts count as empty; columns of texts are kept, one named `into` is replaced.
    """
    kept = [c for c in texts.columns if c != into]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = texts.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("own"), whole.alias("text"))
    # up to the last bracket, so that no search runs to the end in vain
    masked = F.regexp_extract(F.regexp_replace("text", ESCAPE, MASK), BRACKETED, 0)
    rows = rows.withColumn("stretches", F.regexp_extract_all(masked, F.lit(STRETCH), F.lit(0)))
    n_blocks = F.ceil(F.size("stretches") / F.lit(block)).cast("int")
    numbers = F.when(n_blocks > 0, F.sequence(F.lit(0), n_blocks - 1)).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(numbers, lambda i: _folded(F.slice("stretches", i * F.lit(block) + 1, F.lit(block))))
    rows = rows.withColumn("summary", F.aggregate(blocks, _nothing(), _merged))
    rows = rows.withColumn("unmatched", F.array_sort(F.concat("summary.dropped", F.transform("summary.waiting", lambda m: m["at"]))))
    # what stands between two unmatched closers, without the closers
    cut = F.concat(F.array(F.lit(-1).cast("bigint")), "unmatched")
    pieces = F.transform(cut, lambda at, i: F.substring(F.col("text"), (at + 2).cast("int"), (F.coalesce(F.get("unmatched", i), F.length("text").cast("bigint")) - at - 1).cast("int")))
    closers = F.array_join(F.transform(F.reverse("summary.stack"), lambda m: F.translate(m["ch"], OPENERS, CLOSERS)), "")
    found = F.struct("unmatched", F.transform("summary.stack", lambda m: m["at"]).alias("unclosed"), F.concat(F.array_join(pieces, ""), closers).alias("mended"))
    return rows.select(*[F.col("own").getField(c).alias(c) for c in kept], found.alias(into))


#: A stretch of MathML up to the next bracket of its own or tag.
ROW_BRACKET = r"<mo(?:\s[^>]*)?>\s*([()\[\]{}|])\s*</mo>"
TAG_STRETCH = rf"(?s).*?(?:{ROW_BRACKET}|</?m[a-z]+(?:\s[^>]*)?/?>)"
#: Elements whose children make a row, and those without children.
ROWS, LEAVES = ("math", "mrow"), ("mi", "mo", "mn", "mtext", "mspace", "ms")


def _closing(openers: Column) -> Column:
    """Elements that close some openers, the last one first."""
    return F.regexp_replace(F.reverse(F.translate(openers, OPENERS, CLOSERS)), r"(.)", "<mo>$1</mo>")


def mend_rows(rows: DataFrame, mathml: str = "payload", into: str = "mended") -> DataFrame:
    """rows with the MathML whose rows have their brackets balanced: unmatched closers go, missing closers come at the row's end.

    A row is what stands directly in `math` or `mrow`; brackets in other elements are
    left alone. A bar always opens. The stack holds a mark for each element that is open,
    so a bracket meets those of its own row only. Nulls stay null.
    """
    kept = [c for c in rows.columns if c != into]
    bare = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("own"), F.col(f"`{mathml}`").alias("text"))
    bare = bare.withColumn("parts", F.regexp_extract_all("text", F.lit(TAG_STRETCH), F.lit(0)))

    def step(state: Column, part: Column) -> Column:
        stack, out = state["stack"], state["out"]
        ch = F.regexp_extract(part, f"{ROW_BRACKET}$", 1)
        tag, end = F.regexp_extract(part, r"<(/?m[a-z]+)(?:\s[^>]*)?(/?)>$", 1), F.regexp_extract(part, r"(/?)>$", 1)
        name = F.regexp_replace(tag, "^/", "")
        top = F.substring(stack, -1, 1)
        in_row = F.regexp_extract(stack, r"([RX])[^RX]*$", 1) == "R"
        inner = F.regexp_extract(stack, r"[RX]([^RX]*)$", 1)
        leaf = name.isin(*LEAVES) | (end == "/")
        pushed = F.when(name.isin(*ROWS), "R").otherwise("X")
        shorter = F.substring(stack, F.lit(1), F.length(stack) - 1)
        without = F.regexp_replace(part, f"{ROW_BRACKET}$", "")
        last_tag = F.concat(F.lit("<"), tag, F.lit(">"))
        ended = F.concat(F.substring(part, F.lit(1), F.length(part) - F.length(last_tag)), _closing(inner), last_tag)
        closes = F.instr(F.lit(CLOSERS), ch) > 0
        new_stack = (
            F.when((ch != "") & ~in_row, stack).when((ch != "") & ~closes, F.concat(stack, ch)).when((ch != "") & (top == _partner(ch)), shorter).when(ch != "", stack)
            .when(leaf, stack).when(tag.startswith("/"), F.regexp_replace(stack, r"[RX][^RX]*$", "")).otherwise(F.concat(stack, pushed))
        )
        new_part = F.when((ch != "") & in_row & closes & (top != _partner(ch)), without).when((ch == "") & ~leaf & tag.startswith("/") & in_row, ended).otherwise(part)
        return F.struct(new_stack.alias("stack"), F.concat(out, new_part).alias("out"))

    done = F.aggregate("parts", F.struct(F.lit("").alias("stack"), F.lit("").alias("out")), step)
    rest = F.substring(F.col("text"), F.aggregate("parts", F.lit(1), lambda n, p: n + F.length(p)), F.length("text"))
    bare = bare.withColumn("done", done)
    return bare.select(*[F.col("own").getField(c).alias(c) for c in kept], F.when(F.col("text").isNotNull(), F.concat("done.out", rest)).alias(into))


_DISTINCT = "SELECT payload, count(*) AS n_fragments FROM fragments GROUP BY payload"


def gate_bracket_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_brackets(run_sql(spark, sf_dir, with_relations(SPARK, ["fragments"], _DISTINCT)))
    return rows.select("payload", "n_fragments", F.array_join("brackets.unmatched", ",").alias("unmatched"), F.array_join("brackets.unclosed", ",").alias("unclosed"), "brackets.mended")


def repair_bracket_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, with_relations(SPARK, ["fragments"], f"{_DISTINCT} HAVING contains(payload, '<m')"))
    return mend_rows(rows).withColumn("changed", F.col("mended") != F.col("payload"))


QUERIES = {f.__name__: f for f in (gate_bracket_positions, repair_bracket_rows)}

_PARTNER = "translate(ch, ')]}', '([{')"
ORACLES = {
    # one bracket of every text a turn
    "gate_bracket_positions": with_relations(
        DUCK,
        ["fragments"],
        f"""SELECT payload, n_fragments, array_to_string(list_sort(gone), ',') AS unmatched, array_to_string(places, ',') AS unclosed,
            concat((SELECT coalesce(string_agg(c, '' ORDER BY i), '') FROM (SELECT unnest(string_split(payload, '')) AS c, unnest(range(0, length(payload))) AS i) t WHERE NOT list_contains(gone, i)),
                   reverse(translate(stack, '([{{', ')]}}'))) AS mended
        FROM (WITH RECURSIVE parts AS (SELECT payload, n_fragments, regexp_extract_all(regexp_extract(regexp_replace(payload, '{ESCAPE}', '{MASK}', 'g'), '{BRACKETED}'), '{STRETCH}') AS s FROM ({_DISTINCT}) f),
            run AS (
                SELECT payload, n_fragments, s, 0 AS i, CAST(0 AS BIGINT) AS p, '' AS stack, CAST([] AS BIGINT[]) AS places, CAST([] AS BIGINT[]) AS gone FROM parts
                UNION ALL
                SELECT payload, n_fragments, s, i + 1, p + length(s[i + 1]),
                    CASE WHEN ch IN ('(', '[', '{{') THEN stack || ch WHEN right(stack, 1) = {_PARTNER} THEN left(stack, length(stack) - 1) ELSE stack END,
                    CASE WHEN ch IN ('(', '[', '{{') THEN list_append(places, here) WHEN right(stack, 1) = {_PARTNER} THEN places[:-2] ELSE places END,
                    CASE WHEN ch IN ('(', '[', '{{') OR right(stack, 1) = {_PARTNER} THEN gone ELSE list_append(gone, here) END
                FROM (SELECT *, right(s[i + 1], 1) AS ch, p + length(s[i + 1]) - 1 AS here FROM run WHERE i < len(s)) q)
            SELECT * FROM run WHERE i = len(s)) r""",
    ),
}
