"""Reads an entity reference page: rows in groups of four (characters, names, hexadecimal, decimal)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the mark of the first row of a group.
GROUP_MARK = '<font size="7">'


def _cells(row: str) -> Column:
    texts = F.regexp_extract_all(F.col(row), F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1))
    return F.transform(texts, lambda t: F.trim(F.regexp_replace(t, "<[^>]+>", "")))


def parse_entities(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, seq, name, ch): entities of the pages of this layout; groups are zipped to their shortest row.

    Pages without such rows, null and empty ones give nothing.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.posexplode(F.regexp_extract_all(F.col(html), F.lit("(?s)<tr[^>]*>.*?</tr>"), F.lit(0))).alias("pos", "row"))
    order = Window.partitionBy("page_id").orderBy("pos")
    groups = rows.select("page_id", "pos", "row", *[F.lead("row", k).over(order).alias(f"row{k}") for k in (1, 2, 3)]).where(F.col("row").contains(GROUP_MARK) & F.col("row3").isNotNull())
    lists = groups.select("page_id", "pos", *[_cells(r).alias(n) for r, n in (("row", "chars"), ("row1", "names"), ("row2", "hexes"), ("row3", "decimals"))])
    least = F.least(*[F.size(c) for c in ("chars", "names", "hexes", "decimals")])
    cells = lists.where(least > 0).select("page_id", "pos", F.posexplode(F.slice(F.arrays_zip("chars", "names", "hexes", "decimals"), F.lit(1), least)).alias("k", "cell"))
    coded = cells.select("page_id", "pos", "k", F.col("cell.chars").alias("own"), F.col("cell.names").alias("name"), F.expr("try_cast(conv(nullif(regexp_extract(cell.hexes, '([0-9A-Fa-f]+)', 1), ''), 16, 10) AS BIGINT)").alias("hex_code"), F.expr("try_cast(nullif(regexp_extract(cell.decimals, '([0-9]+)', 1), '') AS BIGINT)").alias("dec_code"))
    code = F.coalesce("hex_code", "dec_code")
    ch = F.when(F.length("own") == 1, F.col("own")).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    seq = F.row_number().over(Window.partitionBy("page_id").orderBy("pos", "k")) - 1
    return coded.select("page_id", seq.alias("seq"), "name", ch.alias("ch"))
