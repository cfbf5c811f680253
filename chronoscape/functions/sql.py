"""The statistics as SQL functions of a session, so that plain SQL can call them; and patches as a view.

The functions are SQL themselves: Spark puts their bodies into the query, where they are compiled with the rest."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import stats

FUNCTIONS = {
    "likelihood_ratio(mean1 DOUBLE, mean2 DOUBLE, looks1 DOUBLE, looks2 DOUBLE) RETURNS DOUBLE": """greatest(0D,
        2 * ((looks1 + looks2) * ln((looks1 * mean1 + looks2 * mean2) / (looks1 + looks2)) - looks1 * ln(mean1) - looks2 * ln(mean2))
        / (1 + (1 / looks1 + 1 / looks2 - 1 / (looks1 + looks2)) / 6))""",
    "decibels(before DOUBLE, after DOUBLE) RETURNS DOUBLE": "10 * log10(after / before)",
    "encode_statistic(stat DOUBLE, change_db DOUBLE) RETURNS SMALLINT": f"CAST(rint(least(stat, {stats.CAP}D) * {stats.SCALE} * CASE WHEN change_db > 0 THEN 1 ELSE -1 END) AS SMALLINT)",
    "encode_db(change_db DOUBLE) RETURNS SMALLINT": f"CAST(rint(greatest(least(change_db, {stats.DB_CAP}D), -{stats.DB_CAP}D) * {stats.SCALE}) AS SMALLINT)",
    "decode_statistic(signed SMALLINT) RETURNS DOUBLE": f"CASE WHEN signed <> {stats.NODATA} THEN abs(CAST(signed AS INT)) / {stats.SCALE}D END",
}


def register(spark: SparkSession) -> None:
    """Make the functions known to the session; anew if they are."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def create_patches(spark: SparkSession, source: str, name: str) -> None:
    """A view `name` of the pixels (row, col and other columns) of a table or view with the label of the patch each belongs to.

    Labels take rounds of joins, which no function within a query can run, so they are made when the view is."""
    from ..operators.components import label

    label(spark.table(source)).createOrReplaceTempView(name)
