"""Selections and the pages they are on: the page that holds a selection's centre, else the one it overlaps most, else the nearest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import DUCK, SPARK
from ..sources.relations import run_sql, with_relations
from ..sources.sinks import shared_folder

#: Side of a cell of the grid on which selections and pages meet, in layout units.
CELL = 1800.0
#: Fixed value: no side of a selection is shorter in pixels.
LEAST_SIDE = 5


def _cells(low: Column, high: Column, cell: float) -> Column:
    return F.explode(F.sequence(F.floor(low / F.lit(cell)), F.floor(high / F.lit(cell))))


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _distance() -> Column:
    """Manhattan distance of the two centres."""
    return F.abs(F.col("x") + F.col("w") / 2 - F.col("pos_x") - F.col("disp_w") / 2) + F.abs(F.col("y") + F.col("h") / 2 - F.col("pos_y") - F.col("disp_h") / 2)


def _overlap() -> Column:
    def side(at: str, size: str, page_at: str, page_size: str) -> Column:
        return F.least(F.col(at) + F.col(size), F.col(page_at) + F.col(page_size)) - F.greatest(F.col(at), F.col(page_at))

    zero = F.lit(0.0)
    return F.greatest(zero, side("x", "w", "pos_x", "disp_w")) * F.greatest(zero, side("y", "h", "pos_y", "disp_h"))


def _first(pairs: DataFrame, *by: Column) -> DataFrame:
    """The first page of each selection by some columns, then by its id; a partial aggregation, not a sort."""
    order = [b.alias(f"k{i}") for i, b in enumerate([*by, F.col("page_id")])]
    return pairs.groupBy("region_id").agg(F.min(F.struct(*order, F.struct("how", "overlap").alias("found"))).alias("best")).select("region_id", F.col(f"best.k{len(by)}").alias("page_id"), "best.found.*")


def touched_pages(regions: DataFrame, pages: DataFrame, cell: float) -> DataFrame:
    """(region_id, page_id, how, overlap) of selections whose centre is on a page or that overlap one."""
    r = regions.withColumn("cx", _cells(F.col("x"), F.col("x") + F.col("w"), cell)).withColumn("cy", _cells(F.col("y"), F.col("y") + F.col("h"), cell))
    p = pages.withColumn("cx", _cells(F.col("pos_x"), F.col("pos_x") + F.col("disp_w"), cell)).withColumn("cy", _cells(F.col("pos_y"), F.col("pos_y") + F.col("disp_h"), cell))
    centre_x, centre_y = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    inside = centre_x.between(F.col("pos_x"), F.col("pos_x") + F.col("disp_w")) & centre_y.between(F.col("pos_y"), F.col("pos_y") + F.col("disp_h"))
    pairs = r.join(p, ["cx", "cy"]).withColumn("overlap", _overlap()).withColumn("how", F.when(inside, "centre").when(F.col("overlap") > 0, "overlap"))
    return _first(pairs.where("how IS NOT NULL"), F.col("how"), -F.col("overlap"), _distance())


def nearest_pages(regions: DataFrame, pages: DataFrame, cell: float) -> DataFrame:
    """(region_id, page_id, how, overlap): the page whose centre is nearest to that of each selection.

    A selection looks at the nine cells around its centre. All page centres within a
    cell's side are among them, so what is found within that distance is nearest; the
    selections for which nothing is go on with cells of twice the side. So a far selection takes as many
    rounds as the logarithm of its distance, and rounds are for those that are left alone.
    """
    spark = regions.sparkSession
    found, left = None, regions.withColumn("rx", F.col("x") + F.col("w") / 2).withColumn("ry", F.col("y") + F.col("h") / 2)
    centres = pages.withColumn("qx", F.col("pos_x") + F.col("disp_w") / 2).withColumn("qy", F.col("pos_y") + F.col("disp_h") / 2)
    there = not pages.isEmpty()
    while there and not left.isEmpty():
        def at(c: str, side: float = cell) -> Column:
            return F.floor(F.col(c) / F.lit(side))

        around = F.sequence(F.lit(-1), F.lit(1))
        asked = left.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around)).withColumn("cx", at("rx") + F.col("dx")).withColumn("cy", at("ry") + F.col("dy"))
        pairs = asked.join(centres.withColumn("cx", at("qx")).withColumn("cy", at("qy")), ["cx", "cy"]).withColumn("distance", _distance()).where(F.col("distance") <= F.lit(cell))
        settled = _staged(_first(pairs.withColumn("how", F.lit("nearest")).withColumn("overlap", F.lit(0.0)), F.col("distance")), "nearest")
        found = settled if found is None else found.unionByName(settled)
        left = _staged(left.join(settled.select("region_id"), "region_id", "left_anti"), "far")
        cell *= 2
    return found if found is not None else spark.createDataFrame([], "region_id bigint, page_id bigint, how string, overlap double")


def page_of_region(regions: DataFrame, pages: DataFrame, cell: float = CELL) -> DataFrame:
    """regions(region_id, x, y, w, h), pages(page_id, pos_x, pos_y, disp_w, disp_h, orig_w, orig_h) -> a row for each selection.

    A page that holds the centre comes first, then one that is overlapped; of several the
    one of the largest overlap, then the nearest by its centre, then the smallest id. A selection that meets
    none gets the nearest page, and nulls only where there is no page. The box is in the
    page's own pixels, within the page, each side of at least five. Rows with a null
    coordinate and repeated ids are not expected: they have no page, or one row an id.
    """
    whole = _staged(regions.where("x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL"), "regions")
    touched = _staged(touched_pages(whole, pages, cell), "touched")
    rest = whole.join(touched.select("region_id"), "region_id", "left_anti")
    best = touched.unionByName(nearest_pages(_staged(rest, "far"), pages, cell))
    placed = whole.join(best, "region_id", "left").join(pages, "page_id", "left")

    def scaled(x: Column, size: str, shown: str) -> Column:
        return (x * F.col(size) / F.col(shown)).cast("int")

    def within(at: Column, size: str) -> Column:
        return F.greatest(F.lit(0), F.least(at, F.col(size) - 1))

    px, py = within(scaled(F.col("x") - F.col("pos_x"), "orig_w", "disp_w"), "orig_w"), within(scaled(F.col("y") - F.col("pos_y"), "orig_h", "disp_h"), "orig_h")
    box = placed.withColumn("px", F.when(F.col("page_id").isNotNull(), px)).withColumn("py", F.when(F.col("page_id").isNotNull(), py))

    def length(side: str, size: str, shown: str, at: str) -> Column:
        return F.when(F.col("page_id").isNotNull(), F.greatest(F.lit(LEAST_SIDE), F.least(scaled(F.col(side), size, shown), F.col(size) - F.col(at))))

    return box.select("region_id", "page_id", "how", F.round("overlap", 3).alias("overlap"), "px", "py", length("w", "orig_w", "disp_w", "px").alias("pw"), length("h", "orig_h", "disp_h", "py").alias("ph"))


def join_region_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = run_sql(spark, sf_dir, with_relations(SPARK, ["regions"], "SELECT * FROM regions"))
    pages = run_sql(spark, sf_dir, with_relations(SPARK, ["page_layout"], "SELECT * FROM page_layout"))
    return page_of_region(regions, _staged(pages, "pages"))


QUERIES = {"join_region_page": join_region_page}

_BOX = ", ".join(
    [f"greatest(0, least(CAST(trunc(({c} - pos_{c}) * orig_{s} / disp_{s}) AS INT), orig_{s} - 1)) AS p{c}" for c, s in (("x", "w"), ("y", "h"))]
)
#: All pairs, in one ranking.
ORACLES = {
    "join_region_page": with_relations(
        DUCK,
        ["regions", "page_layout"],
        f"""SELECT region_id, page_id, how, round(overlap, 3) AS overlap, px, py,
            greatest({LEAST_SIDE}, least(CAST(trunc(w * orig_w / disp_w) AS INT), orig_w - px)) AS pw, greatest({LEAST_SIDE}, least(CAST(trunc(h * orig_h / disp_h) AS INT), orig_h - py)) AS ph
        FROM (SELECT *, {_BOX} FROM (
            SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY how = 'nearest', how, overlap DESC, distance, page_id) AS k FROM (
                SELECT *, CASE WHEN x + w / 2 BETWEEN pos_x AND pos_x + disp_w AND y + h / 2 BETWEEN pos_y AND pos_y + disp_h THEN 'centre' WHEN overlap > 0 THEN 'overlap' ELSE 'nearest' END AS how,
                    abs(x + w / 2 - pos_x - disp_w / 2) + abs(y + h / 2 - pos_y - disp_h / 2) AS distance
                FROM (SELECT *, greatest(0, least(x + w, pos_x + disp_w) - greatest(x, pos_x)) * greatest(0, least(y + h, pos_y + disp_h) - greatest(y, pos_y)) AS overlap FROM regions, page_layout) o) q) z WHERE k = 1) b""",
    )
}
