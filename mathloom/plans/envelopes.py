"""What leaves the engine: JSON envelopes, text files with a stamp in their name, and the rows that were refused."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import DUCK, SPARK
from ..sources.relations import SEEDS, run_sql, with_relations
from ..sources.sinks import shared_folder
from . import structure

#: Fixed value: the form of a stamp.
STAMP = "%Y%m%d_%H%M%S"
#: Why a row is refused.
EMPTY = "MathML content is empty"


def stamp(now: datetime.datetime | None = None) -> str:
    return (now or datetime.datetime.now()).strftime(STAMP)


def write_mathml(rows: DataFrame, path: str, mathml: str = "mathml", key: str = "id", now: datetime.datetime | None = None) -> str:
    """Writes one expression a line to path/mathml_<stamp>, as text, and those that are null or blank, with the reason, to path/rejected_<stamp>.

    Line ends inside of an expression become character references, which any XML reader takes back.
    The key comes first, apart by a tab. A second write with the same stamp replaces the first. Returns the stamp.
    """
    mark = stamp(now)
    text, blank = F.coalesce(F.col(f"`{mathml}`"), F.lit("")), F.coalesce(F.trim(F.col(f"`{mathml}`")), F.lit("")) == ""
    one_line = F.replace(F.replace(text, F.lit("\r"), F.lit("&#13;")), F.lit("\n"), F.lit("&#10;"))
    own = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    rows.where(~blank).select(F.concat(own, F.lit("\t"), one_line).alias("value")).write.mode("overwrite").text(f"{path}/mathml_{mark}")
    rows.where(blank).select(own.alias("id"), F.lit(EMPTY).alias("reason")).write.mode("overwrite").json(f"{path}/rejected_{mark}")
    return mark


def read_mathml(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """(id, mathml, reason) of both outputs of a stamp; ids are texts."""
    lines = spark.read.text(f"{path}/mathml_{mark}")
    line = F.substring_index("value", "\t", 1)
    text = F.replace(F.replace(F.substring(F.col("value"), F.length(line) + 2, F.length("value")), F.lit("&#10;"), F.lit("\n")), F.lit("&#13;"), F.lit("\r"))
    written = lines.select(line.alias("id"), text.alias("mathml"), F.lit(None).cast("string").alias("reason"))
    refused = spark.read.schema("id string, reason string").json(f"{path}/rejected_{mark}")
    return written.unionByName(refused.select("id", F.lit(None).cast("string").alias("mathml"), "reason"))


def write_notes(notes: DataFrame, path: str, group: str, order: list[str], text: str = "text") -> None:
    """A line a group: its texts in order, each with a blank after it, line ends as blanks; what stood at path is replaced."""
    gathered = notes.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, F.coalesce(F.col(text), F.lit("")).alias("t")))).alias("all"))
    joined = F.concat(F.array_join(F.transform("all", lambda s: F.regexp_replace(s["t"], "[\r\n]", " ")), " "), F.lit(" "))
    gathered.select(F.concat(F.col(group).cast("string"), F.lit("\t"), joined).alias("value")).write.mode("overwrite").text(path)


def sink_mathml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The MathML of all fragments, written and read back; blank ones are refused."""
    sql = "SELECT fragment_id, CASE WHEN contains(payload, '<math') THEN payload WHEN kind = 'empty' THEN '' END AS mathml FROM fragments WHERE contains(payload, '<math') OR kind = 'empty'"
    path = shared_folder(spark, "mathml")
    mark = write_mathml(run_sql(spark, sf_dir, with_relations(SPARK, ["fragments"], sql)), path, key="fragment_id")
    return read_mathml(spark, path, mark).select(F.col("id").cast("bigint").alias("fragment_id"), "mathml", "reason")


def sink_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "notes")
    write_notes(spark.read.parquet(f"{sf_dir}/conversations.parquet"), path, "conv_id", ["turn"])
    line = F.substring_index("value", "\t", 1)
    return spark.read.text(path).select(line.cast("bigint").alias("conv_id"), F.substring(F.col("value"), F.length(line) + 2, F.length("value")).alias("notes"))


#: Formulas of pages: a box with the expression that its number names.
_FORMULAS = f"""SELECT b.page_id, b.box_id, b.x, b.y, b.w, b.h, CASE WHEN s.kind <> 'mathml' THEN s.payload END AS latex, CASE WHEN s.kind = 'mathml' THEN s.payload END AS mathml
    FROM detections b JOIN seeds s ON s.seed_id = (b.page_id + b.box_id) % {len(SEEDS)}"""


def envelopes(formulas: DataFrame, by: str = "page_id") -> DataFrame:
    """formulas(by, box_id, x, y, w, h, latex, mathml) -> (by, envelope): status, formulas in reading order and their count as JSON; missing texts are empty."""
    box = F.struct("x", "y", "w", "h")
    item = F.struct(F.coalesce("latex", F.lit("")).alias("latex"), F.coalesce("mathml", F.lit("")).alias("mathml"), box.alias("bbox"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "box_id", item.alias("item")))), lambda s: s["item"])
    return formulas.groupBy(by).agg(F.to_json(F.struct(F.lit("success").alias("status"), listed.alias("formulas"), F.count("*").alias("count"))).alias("envelope"))


def sink_result_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes(run_sql(spark, sf_dir, with_relations(SPARK, ["detections", "seeds"], _FORMULAS)))


#: Categories and the patterns of lower-cased names that belong to them; a name may belong to several.
CATEGORIES = structure.CATEGORIES


def sink_entity_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document: all entities that the pages use, the names of each category, and how many entities there are."""
    used = run_sql(spark, sf_dir, f"SELECT e.name, e.code_point, e.ch, r.n FROM {structure._named_references(SPARK)} JOIN {structure.entities(SPARK)} ON r.name = e.name")
    entity = F.struct("name", F.col("code_point").alias("decimal"), F.concat(F.lit("x"), F.hex("code_point")).alias("hex"), F.col("ch").alias("char"), F.col("n").alias("uses"))
    names = [F.sort_array(F.collect_list(F.when(F.lower("name").rlike(p), F.col("name")))).alias(c) for c, p in CATEGORIES]
    # at most as many rows as there are names in the table
    return used.agg(F.to_json(F.struct(F.sort_array(F.collect_list(entity)).alias("all_entities"), F.struct(*names).alias("categories"), F.count("*").alias("total_count"))).alias("json"))


QUERIES = {f.__name__: f for f in (sink_mathml_files, sink_notes, sink_result_envelope, sink_entity_json)}

_LISTS = ", ".join(f"{c} := coalesce(list(name ORDER BY name) FILTER (WHERE regexp_matches(lower(name), '{p}')), [])" for c, p in CATEGORIES)
ORACLES = {
    "sink_mathml_files": with_relations(
        DUCK,
        ["fragments"],
        f"""SELECT fragment_id, CASE WHEN contains(payload, '<math') THEN payload END AS mathml, CASE WHEN NOT contains(payload, '<math') THEN '{EMPTY}' END AS reason
        FROM fragments WHERE contains(payload, '<math') OR kind = 'empty'""",
    ),
    "sink_notes": "SELECT conv_id, string_agg(regexp_replace(coalesce(text, ''), '[\r\n]', ' ', 'g'), ' ' ORDER BY turn) || ' ' AS notes FROM conversations GROUP BY conv_id",
    "sink_result_envelope": with_relations(
        DUCK,
        ["detections", "seeds"],
        f"""SELECT page_id, CAST(to_json(struct_pack(status := 'success', formulas := list(struct_pack(latex := coalesce(latex, ''), mathml := coalesce(mathml, ''), bbox := struct_pack(x := x, y := y, w := w, h := h)) ORDER BY y, x, box_id, coalesce(latex, ''), coalesce(mathml, ''), w, h), count := count(*))) AS VARCHAR) AS envelope
        FROM ({_FORMULAS}) f GROUP BY page_id""",
    ),
    "sink_entity_json": f"""SELECT CAST(to_json(struct_pack(all_entities := list(struct_pack(name := name, "decimal" := code_point, hex := 'x' || printf('%X', CAST(code_point AS BIGINT)), char := ch, uses := n) ORDER BY name), categories := struct_pack({_LISTS}), total_count := count(*))) AS VARCHAR) AS json
        FROM (SELECT e.name, e.code_point, e.ch, r.n FROM {structure._named_references(DUCK)} JOIN {structure.entities(DUCK)} ON r.name = e.name) u""",
}
