"""Recovery of LaTeX from broken MathML: the text inside, its delimiters, split commands, words and brackets, and how far the result is to be trusted.

Confidence is carried from step to step: what was found adds to it, a conversion adds most.
Conversion is a hook (`catalogue.convert_batch`): where it fails, two further passes of repairs follow, and
the LaTeX is wrapped as text. Without a hook nothing has failed, so the LaTeX is wrapped as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import DUCK, SPARK, Spark, chain, count_of, fired, has
from ..operators import classify, repair
from ..sources.relations import run_sql, with_relations

# What marks an expression as corrupt, (pattern, reason), in order; of the last ones the first that is met counts.
INDICATORS = (
    (r"(?i)<mtext(\s[^>]*)?>.*\\[A-Za-z]", "mtext contains LaTeX commands"),
    (r"(<mi>\s*\\?[a-zA-Z]\s*</mi>\s*){4,}", "shredded letter sequences in <mi> tags"),
    (r"[a-z]_\{[a-z0-9]\}[a-z]_\{[a-z0-9]\}", "letter-by-letter subscript patterns"),
    (r"<m[iot][^>]*>\\[A-Za-z]", "backslash tokens in MathML tags"),
    (r"\\\\(left|right|frac)", "double-escaped LaTeX commands"),
)
SHREDDED = tuple((rf"(?i){p}", f"shredded pattern: {p}") for p in (r"\s*".join(w) for w in ("left", "right", "sum", "frac", "mathbb")))
#: Delimiters of LaTeX in a text, in the order in which they are looked for.
SPANS = (r"\$([^$]+)\$", r"\\\((.+?)\\\)", r"(?s)\\\[(.+?)\\\]")
SYMBOLS = ((r"\.{3,}", r"\\ldots"), ("!=", r"\\neq"), ("≤|<=", r"\\le"), ("≥|>=", r"\\ge"), ("\u00a0", " "), (r"\s+", " "))
QUADS = ((r"\\quad(\s*\\quad){2,}", r"\\quad\\quad"),)
SECOND_PASS = ((r"\\\s*([a-zA-Z])\s*([a-zA-Z])\s*([a-zA-Z])\s*([a-zA-Z])", r"\\\1\2\3\4"),)
THIRD_PASS = ((r"\\\s+([a-zA-Z]+)", r"\\\1"),)
#: Letters apart, of which three or more make a word.
LETTERS = r"[A-Za-z](?:\s+[A-Za-z]){2,}"
#: Fixed value: what such a run holds, two letters with nothing but blanks around them.
TWO_APART = r"\s[A-Za-z]\s+[A-Za-z](?:[^A-Za-z0-9_]|\z)"
#: What each step adds.
FORCED, DELIMITED, COMMANDS, LOOSE, CONVERTED, WRAPPED = 0.1, 0.05, 0.15, 0.05, 0.9, 0.05


def reasons(d: Spark, x: str) -> str:
    return d.concat_arrays(fired(d, x, INDICATORS), d.slice(fired(d, x, SHREDDED), "1", "1"))


def joined_letters(d: Spark, x: str) -> str:
    """Three or more single letters apart become a word; letters of longer words beside them stay out of it."""
    # a letter next to a word character is none of its own
    apart = rf"(?:^|[^A-Za-z0-9_])({LETTERS})(?:[^A-Za-z0-9_]|\z)"
    whole = d.extract_all(x, apart, 0)
    by = d.each(whole, f"replace(y, {d.extract('y', LETTERS, 0)}, {d.sub(d.extract('y', LETTERS, 0), chr(92) + 's+', '')})")
    # the plainer pattern is tried first, as few texts hold that
    first = f"{d.match(x, TWO_APART)} AND " if d.name == "spark" else ""
    return f"CASE WHEN {first}{d.match(x, apart)} THEN {d.interleave(d.split(x, apart), by)} ELSE {x} END"


def few_quads(d: Spark, x: str) -> str:
    """Of more than ten quads the first two stay, side by side, and the rest gives way to blanks."""
    parts = d.split("y", r"\\quad+")
    rest = d.join(d.keep(d.each(d.slice(parts, "2", d.size(parts)), "trim(y)"), "y <> ''"), " ")
    few = f"concat({d.at(parts, '1')}, {d.lit(chr(92) + 'quad' + chr(92) + 'quad')}, {rest})"
    return repair._bound(d, chain(d, x, QUADS), f"CASE WHEN {count_of(d, 'y', chr(92) + 'quad')} > 10 THEN {few} ELSE y END")


def _evened(d: Spark, x: str, opener: str, closer: str) -> str:
    """Missing closers at the end, missing openers at the start."""
    off = f"CAST({count_of(d, x, opener)} - {count_of(d, x, closer)} AS INT)"
    return f"concat(repeat('{opener}', greatest(-({off}), 0)), {x}, repeat('{closer}', greatest({off}, 0)))"


def _number(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


def steps(d: Spark, text: str = "payload") -> list[list[tuple[str, str]]]:
    spans = [f"trim({d.extract('inside', p, 1)})" for p in SPANS]
    span = "CASE " + " ".join(f"WHEN {d.match('inside', p)} THEN {s}" for p, s in zip(SPANS, spans)) + " ELSE inside END"
    delimited = " OR ".join(d.match("inside", p) for p in SPANS)
    forced = f"{d.match('raw', r'(?i)<mtext([^A-Za-z0-9_]|' + chr(92) + 'z)')} AND {d.match('raw', chr(92) * 2 + '[A-Za-z]')} AND trim({d.extract('raw', r'(?is)<mtext[^>]*>(.*?)</mtext>', 1)}) <> ''"
    return [
        [("raw", f"trim(coalesce({text}, ''))")],
        [("inside", repair.extract_payload(d, "raw")), ("corruption", reasons(d, "raw"))],
        [("span", span), ("found", f"CASE WHEN {forced} THEN {_number(FORCED)} ELSE {_number(0)} END + CASE WHEN {delimited} THEN {_number(DELIMITED)} ELSE {_number(0)} END")],
        [("tabled", repair.shred_table(d, "span"))],
        [("worded", repair.collapse_subscripts(d, "tabled"))],
        [("symbols", f"trim({chain(d, 'worded', SYMBOLS)})")],
        [("spaced", few_quads(d, "symbols"))],
        [("lettered", joined_letters(d, "spaced"))],
        [("braced", _evened(d, "lettered", "{", "}"))],
        [("even", _evened(d, "braced", "(", ")"))],
        [("candidate", d.sub("trim(even)", r",+\z", ""))],
        [("confidence", f"found + CASE WHEN {d.match('candidate', chr(92) * 2 + '[a-zA-Z]+')} THEN {_number(COMMANDS)} ELSE {_number(LOOSE)} END")],
    ]


def last_steps(d: Spark, converted: str | None = None) -> list[list[tuple[str, str]]]:
    """What follows a conversion; `converted` is its result, null or empty where it failed, or None if there was none."""
    third = chain(d, chain(d, "candidate", SECOND_PASS), THIRD_PASS)
    inner = d.each(d.extract_all("third", r"\\mathrm\{[^}]+\}", 0), "replace(y, ' ', '')")
    tightened = d.interleave(d.split("third", r"\\mathrm\{[^}]+\}"), inner)
    made = f"nullif({converted}, '')" if converted else "CAST(NULL AS VARCHAR)" if d.name == "duckdb" else "CAST(NULL AS STRING)"
    return [
        [("made", made), ("third", third if converted else "candidate")],
        [("latex", f"CASE WHEN raw = '' THEN '' WHEN made IS NOT NULL THEN candidate ELSE {tightened if converted else 'candidate'} END")],
        [
            ("mathml", f"CASE WHEN raw = '' THEN '' WHEN made IS NOT NULL THEN made ELSE {classify.wrap_mtext(d, 'latex')} END"),
            ("trust", f"CASE WHEN raw = '' THEN {_number(0)} ELSE round(least({_number(1)}, confidence + CASE WHEN made IS NOT NULL THEN {_number(CONVERTED)} ELSE {_number(WRAPPED)} END), 3) END"),
        ],
    ]


def recover(texts: DataFrame, text: str = "payload", make=None) -> DataFrame:
    """texts with a struct `recovered`: latex, mathml, confidence, converted, corruption.

    `make` is a converter's maker (see convert_batch); rows that it fails for
    are repaired further and, like all rows without a converter, wrapped as text. Null and blank texts give empty ones and no confidence; columns of texts are kept.
    """
    from ..functions.catalogue import convert_batch

    kept = [c for c in texts.columns if c != "recovered"]
    rows = texts.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("own"), F.col(f"`{text}`").alias("payload"))
    for stage in steps(SPARK):
        rows = rows.withColumns({name: F.expr(x) for name, x in stage})
    converted = None
    if make is not None:
        rows, converted = convert_batch(rows.select("own", "raw", "candidate", "confidence", "corruption"), make, source="candidate", into="made_by_hook"), "made_by_hook"
    for stage in last_steps(SPARK, converted):
        rows = rows.withColumns({name: F.expr(x) for name, x in stage})
    found = F.struct("latex", "mathml", F.col("trust").alias("confidence"), F.col("made").isNotNull().alias("converted"), "corruption")
    return rows.select(*[F.col("own").getField(c).alias(c) for c in kept], found.alias("recovered"))


_DISTINCT = "SELECT payload, count(*) AS n_fragments FROM fragments GROUP BY payload"


def recover_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recover(run_sql(spark, sf_dir, with_relations(SPARK, ["fragments"], _DISTINCT)))
    return rows.select("payload", "n_fragments", "recovered.latex", "recovered.mathml", "recovered.confidence", F.array_join("recovered.corruption", " | ").alias("corruption"))


def _unrolled(d: Spark, source: str, body: str) -> str:
    """`body` over the last of the steps, each a table of its own by name."""
    parts, last = [], f"({source})"
    once = " MATERIALIZED" if d.name == "duckdb" else ""
    for k, stage in enumerate([*steps(d), *last_steps(d)]):
        parts.append(f"s{k} AS{once} (SELECT *, {', '.join(f'{x} AS {name}' for name, x in stage)} FROM {last} s)")
        last = f"s{k}"
    return with_relations(d, ["fragments"], "").rstrip() + ", " + ", ".join(parts) + " " + body.replace("{last}", last)


#: Words whose letters may stand apart, and what makes an estimate.
APART = ("left", "right", "frac", "sum", "mathbb", "cdot", "ldots")
BASE, STRUCTURE, OPERATORS, SHREDDED_SHARE, MOST = 0.2, 0.4, 0.3, 0.85, 0.99
STRUCTURES = ("<mfrac", "<munder", "<msubsup", "<msub")
OPERATOR = r"\\sum|\\frac|\\mathbb|\\left|\\right|\\Pr|\\neq"


def estimate(d: Spark, raw: str, latex: str, mathml: str) -> str:
    """How far a recovery is to be trusted by what it shows: structure in its MathML, operators in its LaTeX, and less if letters stood apart before."""
    apart = d.match(raw, "(?i)" + "|".join(r"\s*".join(w) for w in APART))
    score = f"({_number(BASE)} + CASE WHEN {has(d, mathml, *STRUCTURES)} THEN {_number(STRUCTURE)} ELSE {_number(0)} END + CASE WHEN {d.match(latex, OPERATOR)} THEN {_number(OPERATORS)} ELSE {_number(0)} END)"
    return f"round(least({_number(MOST)}, {score} * CASE WHEN {apart} THEN {_number(SHREDDED_SHARE)} ELSE {_number(1)} END), 3)"


def profile(d: Spark) -> str:
    """Confidences by kind and by what a recovery went by: mean, range and quantiles of what the steps gathered and of the estimate.

    Confidences have three digits, so the counts of the values of a group are a small table, which is merged from
    parts before it is shuffled and gives exact quantiles.
    """
    variant = f"CASE WHEN raw = '' THEN 'empty' WHEN found >= {_number(FORCED)} THEN 'forced' WHEN found > 0 THEN 'delimited' WHEN {d.match('candidate', chr(92) * 2 + '[a-zA-Z]+')} THEN 'commands' ELSE 'loose' END"
    guess = estimate(d, "raw", "latex", "mathml")
    counts = f"(SELECT kind, variant, trust, guess, sum(n_fragments) AS n FROM (SELECT kind, n_fragments, trust, {variant} AS variant, {guess} AS guess FROM {{last}} s) v GROUP BY kind, variant, trust, guess) c"
    two = f"(SELECT kind, variant, n, measure, CASE WHEN measure = 'trust' THEN trust ELSE guess END AS confidence FROM {counts} {d.explode(d.array(chr(39) + 'trust' + chr(39), chr(39) + 'estimate' + chr(39)), 'measure')}) t"
    values = f"(SELECT kind, variant, measure, confidence, sum(n) AS n FROM {two} GROUP BY kind, variant, measure, confidence) h"
    ranked = f"(SELECT h.*, sum(n) OVER (PARTITION BY kind, variant, measure ORDER BY confidence) AS upto, sum(n) OVER (PARTITION BY kind, variant, measure) AS total FROM {values}) r"
    quantiles = ", ".join(f"min(CASE WHEN upto * 100 >= total * {p} THEN confidence END) AS p{p}" for p in (10, 50, 90))
    return f"SELECT kind, variant, measure, CAST(sum(n) AS BIGINT) AS n, round(sum(n * confidence) / sum(n), 6) AS mean_confidence, min(confidence) AS least, max(confidence) AS most, {quantiles} FROM {ranked} GROUP BY kind, variant, measure"


_BY_KIND = "SELECT payload, kind, count(*) AS n_fragments FROM fragments GROUP BY payload, kind"


def agg_confidence_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, _unrolled(SPARK, _BY_KIND, profile(SPARK)))


QUERIES = {"recover_table": recover_table, "agg_confidence_profile": agg_confidence_profile}
ORACLES = {
    "recover_table": _unrolled(DUCK, _DISTINCT, f"SELECT payload, n_fragments, latex, mathml, trust AS confidence, {DUCK.join('corruption', ' | ')} AS corruption FROM {{last}}"),
    "agg_confidence_profile": _unrolled(DUCK, _BY_KIND, profile(DUCK)),
}
