"""Base relations of the engine, derived from the given tables as SQL in either dialect."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import DUCK, SPARK, Spark

TABLES = "documents pages benchmark labels conversations events lineitem orders part".split()

#: Seed expressions (kind, payload), numbered from 0.
SEEDS = (
    ("latex", r"\frac{1}{n}"), ("latex", r"x_i + y^2"), ("latex", r"$x+y$"), ("plain", "This is OCR text 123"), ("empty", "   "),
    ("latex", r"\frac{1}{n} \sum_{t=0}^{n-1} x_t"), ("latex", r"\frac{1}{n} \sum_{t=0}^{n-1} x_t^2"), ("plain", "1/n sum_{i=1}^{n} x_i"),
    ("plain", "1 divided by n sum from t equals 0 to n minus 1"), ("shredded", "e_q u_i v s_u m"), ("shredded", "e_{q}u_{i}v s_{u}m_{i} m_{a}t_{h}b_{b}Z"),
    ("shredded", r"f_r a_c 1 n s_u_m t=0 n-1 [ r_v^(t)(y_0,...,y_{t-1}) ]^2 \le P"), ("shredded", "Y_j[t] s_u_m i∈Z(j) h_{i,j}[t] X_i[t] + Z_j[t]"),
    ("latex", r"Y_j[t] \equiv \sum_{i \in \mathbb{Z}(j)} h_{i,j}[t] X_i[t] + Z_j[t]"), ("truncated", r"\mathbb{R}_"), ("truncated", r"a + b \q"), ("truncated", r"\sum_{i=1} {{"),
    ("shredded", r"\l_{o}n_{g}r_{i}g_{h}t_{a}r_{r}o_{w}"), ("shredded", r"\f_{r}a_{c}{1}{n} \s_{u}m"), ("spacing", r"a \, b \quad c \mathrm{~} d \!"),
    ("stackrel", r"a \stackrel{x}{\longrightarrow} b"), ("rows", r"\begin{array}{c} a=b \\ c=d \\ {{}} \end{array}"), ("matrix", r"M_1 = \begin{bmatrix} a & b \\ c & d \end{bmatrix}"),
    ("label", "(2.1) x = y"), ("merged", r"(i, \j) \inE, x \leqt"), ("channel", r"$Y_{j}l_{e}]= d_{S}) h_{a}y] X_{i}[e] + Z;[e, 4T (7)$"),
    ("channel", r"$Y_{i}l] = D> h_{a} g_{l}] X_{i}l_{e}] + Z;[t). i_{T}L (7)$"), ("prob", "P_error(C) = P r[ W i 4 g i (Y a, 0], ..., Y a; l n - 1 ])"),
    ("mathml", "<math><mi>x</mi></math>"), ("mathml", "<math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow></math>"), ("mathml", "<math><mi>l</mi><mi>e</mi><mi>f</mi><mi>t</mi></math>"),
    ("mathml", "<math><msub><mi>l</mi><mi>e</mi></msub></math>"), ("mathml", '<math xmlns="http://www.w3.org/1998/Math/MathML"><mrow><mo>&#x2261;</mo></mrow></math>'),
    ("mathml", "<math><msub><mi>e</mi><mi>q</mi></msub></math>"), ("mathml", '<math xmlns="http://www.w3.org/1998/Math/MathML"><mfrac><mi>a</mi><mi>b</mi></mfrac></math>'),
    ("mathml", "<math><mi>x</mi><mo>+</mo><mi>y</math>"), ("mathml", "<math><mi>x</mi><mo>+</mo><mi>y</mi><mo>=</mo><mi>z</mi></math>"), ("mathml", "<math><msub><mi>x</mi><mn>1</mn></msub></math>"),
    ("mathml", "<math><mi>x</mi><mo>€</mo><mi>y</mi></math>"), ("mathml", "<math><mi>=</mi></math>"), ("mathml", '<math xmlns="http://www.w3.org/1998/Math/MathML"><mtable /></math>'),
    ("mathml", r"<math><mtext>\frac{a}{b}</mtext></math>"),
)

#: Splits any two letters, or a letter and digits, that stand side by side: the damage that the repairs undo.
SHRED = (r"([A-Za-z])_?([0-9]+|[A-Za-z])", r"\1_{\2}")


def seeds(d: Spark) -> str:
    rows = ", ".join(f"({i}, {d.lit(k)}, {d.lit(p)})" for i, (k, p) in enumerate(SEEDS))
    return f"SELECT * FROM (VALUES {rows}) AS s(seed_id, kind, payload)"


#: Sentences and lines: a text is cut at line ends and after the marks that end a sentence.
SENTENCE_END = r"[.!?]+[ ]+|[\r\n]+"
#: fragment_id of a stretch is its document's id times this plus its number in the text; no text has so many sentences.
MOST_STRETCHES = 1_000_000


def fragments(d: Spark) -> str:
    """Expressions of every document: each sentence or line of its whole text, in turn plain, after a seed, shredded and
    beside shredded command words; and one seed as it is, so that a text without sentences has one too.

    The seed moves on with the document and with the stretch, so that all seeds come in all mixtures. The kind
    of a row is that of its own payload: the seed's where it holds a seed, otherwise plain or shredded.
    """
    sentences = f"SELECT doc_id, seq + 1 AS k, trim(stretch) AS stretch FROM documents {d.explode(d.split('text', SENTENCE_END), 'stretch', 'seq')} WHERE trim(stretch) <> ''"
    every = f"SELECT doc_id, 0 AS k, '' AS stretch FROM documents UNION ALL {sentences}"
    return f"""
        SELECT e.doc_id * {MOST_STRETCHES} + e.k AS fragment_id, e.doc_id, e.k AS page_no, CASE e.k % 4 WHEN 1 THEN 'plain' WHEN 3 THEN 'shredded' ELSE s.kind END AS kind,
               CASE WHEN e.k = 0 THEN s.payload WHEN e.k % 4 = 1 THEN e.stretch WHEN e.k % 4 = 2 THEN concat(s.payload, ' ', e.stretch)
                    WHEN e.k % 4 = 3 THEN {d.sub("e.stretch", *SHRED)}
                    ELSE concat({d.sub("'sum left right frac'", *SHRED)}, ' ', s.payload, ' ', e.stretch) END AS payload
        FROM ({every}) e JOIN ({seeds(d)}) s ON s.seed_id = (e.doc_id + {d.idiv('e.k', '2')}) % {len(SEEDS)}"""


def detections(d: Spark) -> str:
    """Boxes on pages, from lineitem."""
    return """
        SELECT l_orderkey AS page_id, l_linenumber AS box_id, (l_partkey * 37) % 1100 AS x, (l_suppkey * 53) % 1500 AS y,
               CAST(l_quantity AS INT) * 7 AS w, 5 + l_partkey % 60 AS h, 1240 AS page_w, 1754 AS page_h,
               CAST((l_partkey * 13 + l_suppkey * 7) % 100 AS DOUBLE) / 100 AS density
        FROM lineitem"""


def words(d: Spark) -> str:
    """Words of documents as boxes with a confidence."""
    return f"""
        SELECT doc_id AS page_id, seq, CAST(seq % 12 * 90 AS INT) AS x, CAST({d.idiv("seq", "12")} * 24 AS INT) AS y,
               CAST(3 + length(word) * 7 AS INT) AS w, CAST(4 + seq % 20 AS INT) AS h, word AS text, CAST(seq * 37 % 101 AS DOUBLE) AS confidence
        FROM (SELECT doc_id, seq, word FROM documents {d.explode(d.split("text", "[ \\n]+"), "word", "seq")}) e WHERE word <> ''"""


def page_layout(d: Spark) -> str:
    """Page images stacked from top to bottom."""
    return """SELECT page_id, CAST(0 AS DOUBLE) AS pos_x, CAST(page_id * 1800 AS DOUBLE) AS pos_y, CAST(620 AS DOUBLE) AS disp_w, CAST(877 * 2 AS DOUBLE) AS disp_h,
               1240 AS orig_w, 3508 AS orig_h FROM pages"""


def regions(d: Spark) -> str:
    """Selected rectangles over all stacked pages and a little beyond; some cross a border, some meet no page."""
    return """SELECT o_orderkey AS region_id, CAST(o_orderkey % 400 AS DOUBLE) AS x, CAST(o_orderkey * 31 % ((SELECT max(page_id) + 2 FROM pages) * 1800) AS DOUBLE) AS y,
               CAST(20 + o_orderkey % 200 AS DOUBLE) AS w, CAST(15 + o_orderkey % 90 AS DOUBLE) AS h FROM orders"""


def responses(d: Spark) -> str:
    """Answers of a model: JSON, prose, fenced JSON, code."""
    fixed = ('{"latex": "x^2", "confidence": 0.9}', '{"latex": "x^2", "confidence": 0.4}', '```json\n{"latex": "y", "confidence": 0.8}\n```', "The formula is x squared.", "s_1 = 3", '{"latex": "x", ')
    rows = ", ".join(f"({-1 - i}, {d.lit(x)})" for i, x in enumerate(fixed))
    return f"""SELECT event_id AS id, props AS content FROM events UNION ALL
        SELECT 1000000000 + conv_id * 1000 + turn AS id, text AS content FROM conversations WHERE role = 'assistant' UNION ALL
        SELECT * FROM (VALUES {rows}) AS f(id, content)"""


RELATIONS = {f.__name__: f for f in (seeds, fragments, detections, words, page_layout, regions, responses)}


def with_relations(d: Spark, names, body: str) -> str:
    ctes = ", ".join(f"{n} AS ({RELATIONS[n](d)})" for n in names)
    return f"WITH {ctes} {body}" if ctes else body


#: A string literal of Spark's.
LITERAL = r"'(?:[^'\\]|\\.)*'"


def run_sql(spark: SparkSession, sf_dir: str, sql: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """sql over the given tables, which it names as the files are named; `given` stands in for some of them."""
    # pieces at odd places are literals, in which no table is named
    pieces = [p.replace("{", "{{").replace("}", "}}") for p in re.split(f"({LITERAL})", sql)]
    found: dict[str, DataFrame] = dict(given or {})
    named = rf"\b(FROM|JOIN)\s+({'|'.join(TABLES)})\b(?!\.)"
    for i in range(0, len(pieces), 2):
        for _, name in re.findall(named, pieces[i]):
            if name not in found:
                found[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        # by parameters, so that no view of the user's is replaced
        pieces[i] = re.sub(named, r"\1 {\2}", pieces[i])
    text = "".join(pieces)
    return spark.sql(text, **found) if found else spark.sql(sql)


__all__ = ["DUCK", "RELATIONS", "SEEDS", "SHRED", "SPARK", "TABLES", "run_sql", "with_relations"]
