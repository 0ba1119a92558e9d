"""The fixer: an expression is repaired, judged and, while it is not valid, tried again in another form, at most five times.

Rows that are settled leave; only the others go round again. Each row remembers, by hash, the forms that
it has been tried in. One that comes up again is perturbed instead of judged; otherwise the next attempt starts
from the row's candidate with a bolder rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import DUCK, SPARK, Spark, chain, count_of
from ..operators import gates, layout
from ..sources.relations import run_sql, with_relations
from ..sources.sinks import shared_folder

MOST_ATTEMPTS = 5
END = r"([^A-Za-z0-9_]|\z)"
# The rules of the stages, in their order. Rules that look one character ahead take a second turn for neighbours.
MINIMAL = ((r"^\$\$?|\$\$?\z", ""), (r"\s+", " "), ("≤", r"\\le"), ("≥", r"\\ge"), ("≠", r"\\neq"), ("×", r"\\times"), ("·", r"\\cdot"), (r"\\left\\left", r"\\left"), (r"\\right\\right", r"\\right"))
COMMANDS = (
    (r"(?i)\\f\s*_\s*\{?r\}?\s*a\s*_\s*\{?c\}?", r"\\frac"),
    *((r"(?i)\\s\s*_\s*\{?u\}?\s*m" + END, r"\\sum\1"),) * 2,
    (r"(?i)\\p\s*_\s*\{?r\}?\s*o\s*_\s*\{?d\}?", r"\\prod"),
    (r"(?i)\\l\s*_\s*\{?e\}?\s*f\s*_\s*\{?t\}?", r"\\left"),
    *((r"(?i)\\r\s*_\s*\{?i\}?\s*g\s*_\s*\{?h\}?\s*t" + END, r"\\right\1"),) * 2,
    *((r"(?i)\\i\s*_\s*\{?n\}?\s*t" + END, r"\\int\1"),) * 2,
    *((r"\\([A-Z])" + END, chr(1) + r"\1\2"),) * 2,  # the mark keeps a backslash before from being taken as well
    (chr(1), ""),
)
SCRIPTS = (
    (r"([a-zA-Z0-9])_\{\s*([a-zA-Z0-9])_\{([a-zA-Z0-9])\}\s*\}", r"\1_{\2\3}"),
    *((r"([A-Za-z0-9])_([A-Za-z0-9])([^_\{]|\z)", r"\1_{\2}\3"),) * 2,
    *((r"([A-Za-z0-9])\^([A-Za-z0-9])([^_\{]|\z)", r"\1^{\2}\3"),) * 2,
)
PERTURB = ((r"\\[a-zA-Z]{1,3}\z", ""), (r"[\s,;:-]{1,3}\z", ""))  # odd attempts, even ones
BOLDER = {2: ((r"([0-9])\s+([a-zA-Z])", r"\1_{\2}"),), 3: ((r"\\([^a-zA-Z\\{])", r"\1"),)}
#: Fixed text of the prompt for a person.
PROMPT = (
    "The OCR produced invalid or ambiguous LaTeX. Please correct the LaTeX to a valid expression.\nRaw OCR LaTeX:\n\n",
    "\n\nHints:\n- Look for letter-by-letter patterns like m_{a}t_{h}r_{m} and combine them into \\mathrm{math}\n- Fix unbalanced braces and missing superscript/subscript braces\n"
    f"- If the expression is the probability-of-error template, use:\n{layout.FIXER_TEMPLATES['fixer'][2]}\n- If the expression is a channel equation, use:\n{layout.FIXER_TEMPLATES['channel'][2]}\n\n"
    "Return only the corrected LaTeX string.",
)


def collapsed(d: Spark, x: str, least: int, any_word: bool) -> str:
    """Runs of subscripted letters as one upright word in lower case, bases before subscripts; without `any_word` only those with a vowel."""
    run = rf"(?:[A-Za-z]_\{{[A-Za-z]\}}){{{least},}}"
    word = f"lower(concat({d.sub('y', r'_\{.\}', '')}, {d.sub('y', r'[A-Za-z]_\{(.)\}', chr(92) + '1')}))"
    made = f"concat({d.lit(chr(92) + 'mathrm{')}, {word}, '}}')"
    by = made if any_word else f"CASE WHEN {d.match(word, '[aeiou]')} THEN {made} ELSE y END"
    return f"CASE WHEN {d.match(x, run)} THEN {d.interleave(d.split(x, run), d.each(d.extract_all(x, run, 0), by))} ELSE {x} END"


def canonical(d: Spark, x: str) -> str:
    """The formula of the first template of which enough cues are met, or x."""
    cases = []
    for patterns, least, formula in layout.FIXER_TEMPLATES.values():
        cues = " + ".join(f"CASE WHEN {d.match(f'lower({x})', p)} THEN 1 ELSE 0 END" for p in patterns)
        cases.append(f"WHEN {cues} >= {least} THEN {d.lit(formula)}")
    return f"CASE {' '.join(cases)} ELSE {x} END"


def balanced(d: Spark, x: str) -> str:
    """Missing closing braces come at the end; those too many go from the end as far as it consists of them."""
    off = f"CAST({count_of(d, x, '{')} - {count_of(d, x, '}')} AS INT)"
    tail = f"length({d.extract(x, r'(\}*)' + chr(92) + 'z', 1)})"
    return f"CASE WHEN {off} > 0 THEN concat({x}, repeat('}}', {off})) WHEN {off} < 0 THEN substr({x}, 1, length({x}) - least(-({off}), {tail})) ELSE {x} END"


def closed(d: Spark, x: str, opener: str, closer: str) -> str:
    return f"concat({x}, repeat('{closer}', greatest(CAST({count_of(d, x, opener)} - {count_of(d, x, closer)} AS INT), 0)))"


def unwrapped(d: Spark, x: str) -> str:
    """x without blanks around it and without one pair of single or double dollar signs."""
    y = f"trim({x})"
    return f"""CASE WHEN length({y}) > 3 AND {d.match(y, r'^[$][$]')} AND {d.match(y, r'[$][$]' + chr(92) + 'z')} THEN trim(substr({y}, 3, length({y}) - 4))
        WHEN length({y}) > 1 AND {d.match(y, r'^[$]')} AND {d.match(y, r'[$]' + chr(92) + 'z')} THEN trim(substr({y}, 2, length({y}) - 2)) ELSE {y} END"""


def attempt(d: Spark, number: int) -> list[list[tuple[str, str]]]:
    """The stages of one attempt over (candidate, tried): repaired, settled, next_candidate, next_tried."""
    if number == 1:
        bolder = collapsed(d, "candidate", 2, True)
    else:
        bolder = chain(d, "candidate", BOLDER[min(number, 3)])
    return [
        [("s1", f"trim({chain(d, 'trim(candidate)', MINIMAL)})")],
        [("s2", collapsed(d, "s1", 3, False))],
        [("s3", chain(d, "s2", (*COMMANDS, *SCRIPTS)))],
        [("s4", canonical(d, "s3"))],
        [("s5", balanced(d, "s4"))],
        [("repaired", closed(d, closed(d, "s5", "(", ")"), "[", "]"))],
        [("mark", "md5(trim(repaired))")],
        [("seen", "array_contains(tried, mark)"), ("reason", gates.validity_reason(d, "repaired"))],
        [
            ("settled", "NOT seen AND reason = 'valid'"),
            ("next_candidate", f"CASE WHEN seen THEN {chain(d, 'repaired', (PERTURB[1 - number % 2],))} ELSE {bolder} END"),
            ("next_tried", f"CASE WHEN seen THEN tried ELSE {d.concat_arrays('tried', d.array('mark'))} END"),
        ],
    ]


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fix(texts: DataFrame, text: str = "payload", most: int = MOST_ATTEMPTS) -> DataFrame:
    """(payload, status, attempt, latex, first_reason, n_tried, prompt) for each distinct text of a table.

    status is `ok` (valid as it stands, attempt 0), `fixed` by the attempt given, or `failed` after all of
    them; a failed row has a prompt for a person and no latex. Null and blank texts fail as empty.
    """
    rows = texts.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("payload")).distinct().withColumn("raw", F.expr(unwrapped(SPARK, "payload")))
    rows = _staged(rows.withColumn("first_reason", F.expr(gates.validity_reason(SPARK, "raw"))), "fixer")
    columns = ("payload", "status", "attempt", "latex", "first_reason", "n_tried")
    done = rows.where("first_reason = 'valid'").withColumns({"status": F.lit("ok"), "attempt": F.lit(0), "latex": F.col("raw"), "n_tried": F.lit(0)}).select(*columns)
    active = rows.where("first_reason <> 'valid'").select("payload", "raw", "first_reason", F.col("raw").alias("candidate"), F.array().cast("array<string>").alias("tried"))
    for number in range(1, most + 1):
        for stage in attempt(SPARK, number):
            active = active.withColumns({name: F.expr(x) for name, x in stage})
        kept = _staged(active.select("payload", "raw", "first_reason", "repaired", "settled", "next_candidate", "next_tried"), "fixer")
        done = done.unionByName(kept.where("settled").withColumns({"status": F.lit("fixed"), "attempt": F.lit(number), "latex": F.col("repaired"), "n_tried": F.size("next_tried")}).select(*columns))
        active = kept.where("NOT settled").select("payload", "raw", "first_reason", F.col("next_candidate").alias("candidate"), F.col("next_tried").alias("tried"))
    failed = active.withColumns({"status": F.lit("failed"), "attempt": F.lit(most), "latex": F.lit(None).cast("string"), "n_tried": F.size("tried")})
    prompt = F.concat(F.lit(PROMPT[0]), F.col("raw"), F.lit(PROMPT[1]))
    return done.withColumn("prompt", F.lit(None).cast("string")).unionByName(failed.withColumn("prompt", prompt).select(*columns, "prompt"))


def repair_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fix(run_sql(spark, sf_dir, with_relations(SPARK, ["fragments"], "SELECT payload FROM fragments")))


QUERIES = {"repair_attempts": repair_attempts}


def _unrolled() -> str:
    """All attempts one after another, each stage on its own."""
    d, parts = DUCK, []
    parts.append(f"rows AS MATERIALIZED (SELECT payload, {unwrapped(d, 'payload')} AS raw FROM (SELECT DISTINCT payload FROM fragments) p)")
    parts.append(f"r0 AS MATERIALIZED (SELECT payload, raw, raw AS candidate, CAST([] AS VARCHAR[]) AS tried, {gates.validity_reason(d, 'raw')} AS first_reason FROM rows)")
    last, done = "(SELECT * FROM r0 WHERE first_reason <> 'valid')", ["SELECT payload, 'ok' AS status, 0 AS attempt, raw AS latex, first_reason, 0 AS n_tried, NULL AS prompt FROM r0 WHERE first_reason = 'valid'"]
    for number in range(1, MOST_ATTEMPTS + 1):
        for k, stage in enumerate(attempt(d, number)):
            parts.append(f"a{number}_{k} AS MATERIALIZED (SELECT *, {', '.join(f'{x} AS {name}' for name, x in stage)} FROM {last} s)")
            last = f"a{number}_{k}"
        done.append(f"SELECT payload, 'fixed', {number}, repaired, first_reason, len(next_tried), NULL FROM {last} WHERE settled")
        last = f"(SELECT payload, raw, first_reason, next_candidate AS candidate, next_tried AS tried FROM {last} WHERE NOT settled)"
    done.append(f"SELECT payload, 'failed', {MOST_ATTEMPTS}, NULL, first_reason, len(tried), concat({d.lit(PROMPT[0])}, raw, {d.lit(PROMPT[1])}) FROM {last} f")
    return ", " + ", ".join(parts) + " " + " UNION ALL ".join(done)


ORACLES = {"repair_attempts": with_relations(DUCK, ["fragments"], "").rstrip() + _unrolled()}
