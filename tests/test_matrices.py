"""Matrices on golden rows: what stands around them, brackets, rows and cells."""

from mathloom.functions.dialect import SPARK
from mathloom.plans import matrices

CASES = {
    r"M_1 = \begin{bmatrix} a & b \\ c & d \end{bmatrix}": ("M_1", "[", "]", "", [["a", "b"], ["c", "d"]]),
    r"\begin{pmatrix} a \& b & c \\ d \end{pmatrix} + x": ("", "(", ")", "+ x", [[r"a \& b", "c"], ["d"]]),
    r"y = z = \left[ \begin{array} {cc} {a} & b \\ & c & & \\ \end{array} \right] , (2)": ("y = z", "[", "]", ", (2)", [["b"], ["c"]]),
    r"A = \begin{vmatrix}{cc} (ii) \\ a & b \end{vmatrix}": ("A", "|", "|", "", [["a", "b"]]),
    r"\begin{Vmatrix} (1) \\ & \\ x \\ \end{Vmatrix}": ("", "‖", "‖", "", [["&"], ["x"]]),
    "k =\n\\begin{matrix} a\nb \\end{matrix} \\begin{matrix} c \\end{matrix}": ("k", "[", "]", r"\begin{matrix} c \end{matrix}", [["a"], ["b"]]),
    r"\begin{bmatrix} \left\{ a & b \end{bmatrix}": ("", "[", "]", "", [[r"\left\{ a", "b"]]),
    r"\begin{bmatrix} \end{bmatrix}": ("", "[", "]", "", []),
    r"\begin{bmatrix} a & b": None,
    "a & b": None,
    None: None,
}


def run(spark, body, case):
    spark.createDataFrame([(i, c) for i, c in enumerate(case)], "expr_id INT, payload STRING").createOrReplaceTempView("matrix_texts")
    return spark.sql(body(SPARK, "(SELECT * FROM matrix_texts) f")).collect()


def test_matrices(spark):
    got = {r.expr_id: (r.lhs, r.opener, r.closer, r.rest, r.cells) for r in run(spark, lambda d, s: f"SELECT * FROM {matrices.matrices(d, s)}", CASES)}
    assert got == {i: want for i, want in enumerate(CASES.values()) if want}


def test_rest_belongs_to_the_last_cell(spark):
    rows = run(spark, matrices._profile, CASES)
    profile = {r.expr_id: (r.n_rows, r.n_cols, r.stacked, r.n_ragged_rows, r.last_cell) for r in rows}
    assert profile[1] == (2, 2, False, 1, "d + x") and profile[0] == (2, 2, False, 0, "d") and profile[7] == (0, 0, True, 0, None)
    cells = [(r.expr_id, r.row_no, r.col_no, r.latex, r.cleaned) for r in run(spark, matrices._cells, CASES) if r.expr_id in (0, 1)]
    assert sorted(cells) == [(0, 0, 0, "a", "a"), (0, 0, 1, "b", "b"), (0, 1, 0, "c", "c"), (0, 1, 1, "d", "d"), (1, 0, 0, r"a \& b", r"a \& b"), (1, 0, 1, "c", "c"), (1, 1, 0, "d + x", "d + x")]
