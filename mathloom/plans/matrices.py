r"""Matrices: what stands before and after them, their brackets, rows and cells.

A matrix is the first one that follows an equals sign, with or without fences around it, otherwise
the first one at all; rows end at two backslashes and at line ends, cells at & unless a backslash stands before it. What
follows the matrix belongs to its last cell. Environments of more than one text are read whole,
and none is split again by its own marks where it has one row alone.
"""

from __future__ import annotations

from ..functions.dialect import Spark, chain, has
from ..operators import layout
from ..operators.lines import COLUMNS, brace_difference, cell, stripped
from ..operators.repair import NOISE
from .structure import EXPRESSIONS

_NAME = r"\{(?:bmatrix|pmatrix|vmatrix|Vmatrix|matrix|array)\*?\}"
# A matrix after an equals sign, one in square fences, and any; the first group is what stands before it, the second is the matrix.
PLACES = (
    rf"(?is)^(.+?)\s*=\s*(\\begin{_NAME}.*?\\end{_NAME})",
    r"(?is)^(.+?)\s*=\s*(\\left\s*\[.*?\\begin\s*\{array\}.*?\\end\s*\{array\}.*?\\right\s*\])",
    rf"(?is)^(.*?)(\\begin{_NAME}.*?\\end{_NAME})",
)
INSIDE = r"(?is)^.*?\\begin\s*" + _NAME + r"(.*?)(?:\\end\s*" + _NAME + r"|\z)"
#: Brackets by a part of the environment's name, in this order; others are square.
BRACKETS = (("pmatrix", "(", ")"), ("vmatrix", "|", "|"), ("Vmatrix", "‖", "‖"))
#: A row of this alone at the start is a label.
ROMAN, NUMBER = r"^\(?[ivxlcdmIVXLCDM]+\)?\z", r"^\(\s*[0-9]+\s*\)\z"
ROW_END = r"\\\\|\r\n|\n|\r"
ESCAPED = chr(1)  # stands for an & after a backslash


def _row_cells(d: Spark, y: str) -> str:
    """The cells of a row, without the blank ones at its end; a row of & alone is one cell."""
    row = d.sub(y, r"[\s&]+\z", "")
    cells = d.each(d.split(f"CASE WHEN {row} = '' THEN {d.lit(ESCAPED)} ELSE {row} END", "&"), stripped(d, d.sub(stripped(d, f"replace(y, {d.lit(ESCAPED)}, {d.lit(chr(92) + '&')})"), COLUMNS, "")))
    return f"CASE WHEN {row} = '' THEN {d.array(stripped(d, y))} ELSE {cells} END"


def _row(d: Spark, y: str) -> str:
    """A row without column letters, noise and backslashes at its end; & after a backslash is marked."""
    clean = d.sub(chain(d, d.sub(stripped(d, y), COLUMNS, ""), NOISE), r"\\+\z", "")
    return f"replace({stripped(d, clean)}, {d.lit(chr(92) + '&')}, {d.lit(ESCAPED)})"


def matrices(d: Spark, source: str = EXPRESSIONS) -> str:
    """(expr_id, opener, closer, lhs, rest, cells): expressions with a matrix, its cells as an array of arrays."""

    def found(group: int) -> str:
        return f"CASE WHEN w1 <> '' THEN {d.extract('payload', PLACES[0], group)} WHEN w2 <> '' THEN {d.extract('payload', PLACES[1], group)} ELSE {d.extract('payload', PLACES[2], group)} END"

    bracket = ["CASE " + " ".join(f"WHEN contains(part, '{name}') THEN '{pair[i]}' " for name, *pair in BRACKETS) + f"ELSE '{other}' END" for i, other in enumerate("[]")]
    off = brace_difference(d, "fenced")
    fenced = f"CASE WHEN contains(part, {d.lit(r'\left\{')}) AND NOT contains(part, {d.lit(r'\right\}')}) THEN concat(part, {d.lit(r' \right\}')}) ELSE part END"
    inside = stripped(d, d.sub(d.sub(stripped(d, d.extract("mended", INSIDE, 1)), COLUMNS, ""), r"\\right\s*[\])]?\s*\z", ""))
    stray = f"CASE WHEN {d.match('inside', '^[{]')} AND {brace_difference(d, 'inside')} > 0 THEN {stripped(d, d.sub('inside', '^[{]+', ''))} ELSE inside END"
    last = f"CASE WHEN {d.match('body', '[}]' + chr(92) + 'z')} AND {brace_difference(d, 'body')} < 0 THEN {stripped(d, d.sub('body', r'[}]+\z', ''))} ELSE body END"
    rows = d.keep(d.each(d.keep(d.each(d.split("content", ROW_END), stripped(d, "y")), "y <> ''"), _row(d, "y")), "y <> ''")
    # a blank first cell goes if others follow it
    shifted = f"CASE WHEN {d.size('y')} > 1 AND {d.at('y', '1')} = '' THEN {d.slice('y', '2', d.size('y') + ' - 1')} ELSE y END"
    head = d.at(d.at("split_rows", "1"), "1")
    labelled = f"{d.size('split_rows')} > 1 AND {d.size(d.at('split_rows', '1'))} = 1 AND ({d.match(f'replace({head}, ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) * 2 + ')', ROMAN)} OR {d.match(head, NUMBER)})"
    stages = (
        {"w1": d.extract("payload", PLACES[0], 0), "w2": d.extract("payload", PLACES[1], 0), "w3": d.extract("payload", PLACES[2], 0)},
        {"part": found(2), "before": found(1), "rest": stripped(d, "substr(payload, length(CASE WHEN w1 <> '' THEN w1 WHEN w2 <> '' THEN w2 ELSE w3 END) + 1)")},
        {"fenced": fenced, "lhs": stripped(d, d.sub("before", r"\s*=\s*\z", "")), "opener": bracket[0], "closer": bracket[1]},
        {"mended": f"CASE WHEN {off} BETWEEN 1 AND 3 THEN concat(fenced, repeat('}}', greatest({off}, 0))) ELSE fenced END"},
        {"inside": inside},
        {"body": stray},
        {"content": last},
        {"row_texts": rows},
        {"split_rows": d.each(d.each("row_texts", _row_cells(d, "y")), shifted)},
        {"cells": f"CASE WHEN {labelled} THEN {d.slice('split_rows', '2', d.size('split_rows') + ' - 1')} ELSE split_rows END"},
    )
    out = f"(SELECT expr_id, payload FROM {source} WHERE {layout.matrix(d, 'payload')} AND {has(d, 'payload', chr(92) + 'end')}) s"
    for k, stage in enumerate(stages):
        out = f"(SELECT *, {', '.join(f'{x} AS {name}' for name, x in stage.items())} FROM {out}) s{k}"
    return f"(SELECT expr_id, opener, closer, lhs, rest, cells FROM {out} WHERE part <> '') m"


def _profile(d, source=EXPRESSIONS):
    n_cols = d.fold(d.each("cells", f"CAST({d.size('y')} AS INT)"), "0", "greatest(a, y)")
    row = d.at("cells", f"nullif({d.size('cells')}, 0)")
    last = d.at(row, f"nullif({d.size(row)}, 0)")
    return f"""SELECT expr_id, opener, closer, lhs, rest, {d.size('cells')} AS n_rows, {n_cols} AS n_cols, {n_cols} <= 1 AS stacked,
        {d.size(d.keep('cells', f"{d.size('y')} <> {d.size(d.at('cells', '1'))}"))} AS n_ragged_rows, CASE WHEN rest = '' THEN {last} ELSE {stripped(d, f"concat(coalesce({last}, ''), ' ', rest)")} END AS last_cell FROM {matrices(d, source)}"""


def _cells(d, source=EXPRESSIONS):
    rows = f"(SELECT expr_id, rest, {d.size('cells')} AS n_rows, row_no, one_row FROM {matrices(d, source)} {d.explode('cells', 'one_row', 'row_no')}) r"
    each = f"(SELECT expr_id, rest, n_rows, row_no, {d.size('one_row')} AS n_cols, col_no, one_cell FROM {rows} {d.explode('one_row', 'one_cell', 'col_no')}) c"
    joined = "concat(one_cell, ' ', rest)"
    latex = f"CASE WHEN rest <> '' AND row_no + 1 = n_rows AND col_no + 1 = n_cols THEN {stripped(d, joined)} ELSE one_cell END"
    return f"SELECT expr_id, row_no, col_no, latex, {cell(d, 'latex')} AS cleaned FROM (SELECT expr_id, row_no, col_no, {latex} AS latex FROM {each}) l"


TEMPLATES = {"matrix_profile": (("fragments",), _profile), "matrix_cells": (("fragments",), _cells)}
