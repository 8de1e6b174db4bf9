"""Claims and exposure: category tables, selections and targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The categories of the two datasets with their attributes (kind, client, place, object, flood type).
CATEGORY_ROWS = [
    *[
        ("first", "claim", "_".join(filter(None, (client, place, thing, flood))), client, place, thing, flood)
        for client in ("sme", "priv")
        for place, thing, flood in (
            ("ext", "cont", "pluv"), ("ext", "cont", "fluv"), ("ext", "struc", "pluv"),
            ("ext", "struc", "fluv"), ("int", "cont", None), ("int", "struc", None),
        )
    ],
    *[("first", "exposure", f"{client}_{place}_{thing}", client, place, thing, None) for client in ("sme", "priv") for place in ("ext", "int") for thing in ("cont", "struc")],
    ("second", "exposure", "all_buildings", None, None, None, None),
    ("second", "claim", "A", None, None, None, "pluvial"),
    ("second", "claim", "B", None, None, None, "pluvial"),
    ("second", "claim", "C", None, None, None, "either"),
    ("second", "claim", "D", None, None, None, "fluvial"),
    ("second", "claim", "E", None, None, None, "other"),
]
CATEGORY_COLUMNS = "dataset string, kind string, category string, client string, place string, object string, flood_type string"

#: What a type word asks of the first dataset's categories. ``pluvial`` is "not fluvial": internal damage stays.
TYPE_WORDS = {
    "sme": "client = 'sme'",
    "private": "client = 'priv'",
    "external": "place = 'ext'",
    "internal": "place = 'int'",
    "content": "object = 'cont'",
    "structure": "object = 'struc'",
    "pluvial": "flood_type IS NULL OR flood_type <> 'fluv'",
    "fluvial": "flood_type IS NULL OR flood_type <> 'pluv'",
}

#: Claim classes of the second dataset by type word.
CLASS_WORDS = {"most_likely_pluvial": ["A"], "likely_pluvial": ["A", "B"], "pluvial": ["A", "B"], "fluvial": ["D"], "all": ["A", "B", "C", "D", "E"]}


def categories_of_types(dim: DataFrame, types: list[str], kind: str = "claim") -> DataFrame:
    """The first dataset's categories of a kind that satisfy all type words; an unknown word is an error."""
    if unknown := [t for t in types if t not in TYPE_WORDS]:
        raise ValueError(f"unknown type words: {unknown}")
    wanted = [F.expr(TYPE_WORDS[t]) for t in types if kind == "claim" or t not in ("pluvial", "fluvial")]
    return dim.filter((F.col("dataset") == "first") & (F.col("kind") == kind)).filter(reduce(lambda a, b: a & b, wanted, F.lit(True)))


def claims_of_type(claims_long: DataFrame, word: str) -> DataFrame:
    """Claims of the second dataset's classes that a type word stands for."""
    if word not in CLASS_WORDS:
        raise ValueError(f"unknown type word: {word}")
    return claims_long.filter(F.col("category").isin(CLASS_WORDS[word]))


def claims_wide(claims_long: DataFrame, categories: list[str]) -> DataFrame:
    """One row per day and cell with a column per category, 0 where it has no claim: one exchange whatever their number."""
    return claims_long.groupBy("date_claim", "cid").pivot("category", categories).agg(F.sum("n")).fillna(0, subset=categories)


def row_sum(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in columns])


def select_claims(wide: DataFrame, categories: list[str]) -> tuple[DataFrame, DataFrame]:
    """With ``selection``, the sum of the chosen categories: rows where it isn't 0, and those where it is."""
    full = wide.withColumn("selection", row_sum(categories))
    return full.filter("selection <> 0"), full.filter("selection = 0")


def exposed_cells(exposure_long: DataFrame) -> DataFrame:
    return exposure_long.groupBy("cid").agg(F.max("n").alias("most")).filter("most > 0").select("cid")


def exposure_table(exposure_long: DataFrame, categories: list[str]) -> DataFrame:
    """Years by exposed cells, a column per category, 0 where a cell has nothing that year."""
    years = exposure_long.agg(F.array_sort(F.collect_set("year")).alias("years"))
    grid = exposed_cells(exposure_long).join(F.broadcast(years)).select("cid", F.explode("years").alias("year"))
    wide = exposure_long.groupBy("cid", "year").pivot("category", categories).agg(F.sum("n"))
    return grid.join(wide, ["cid", "year"], "left").fillna(0, subset=categories)


def damage_ratio(claims: DataFrame, exposure: DataFrame) -> DataFrame:
    """``target``: selection over the contracts of the cell that year, 1 at most; null without exposure."""
    contracts = exposure.select("cid", "year", F.col("selection").alias("nb_contracts"))
    full = claims.withColumn("year", F.year("date_claim")).join(contracts, ["cid", "year"], "left")
    ratio = F.col("selection") / F.col("nb_contracts")
    return full.withColumn("target", F.when(ratio > 1, 1.0).otherwise(ratio))


def duplicated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
