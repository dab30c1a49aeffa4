"""Views over the supplied tables that have the shape of the library's inputs.

Customers are the people, orders the events, nations the areas. The expressions are valid
in Spark and in DuckDB, where the same views feed the SQL that results are checked against.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uptakelens.sources.areas import Areas, checked_areas
from uptakelens.sources.readers import in_window

WINDOW_START = "1996-01-01"
WINDOW_END = "1997-01-01"
LOG_START = "1995-01-01"
LOG_END = "2002-01-01"
WINDOW_LABEL = "Jan 96 - Dec 96"
WINDOW_TEXT = "Jan 1996 and Dec 1996"

TABLES = {
    "customer": "c_custkey bigint, c_nationkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}

# A person's group as the event log and as the register writes it: every label of both
# vocabularies occurs, and where they differ, events find no people under their label.
GROUPS = [
    ("A: British", "British"),
    ("B: Irish", "Irish"),
    ("C: Other White", "Any other white background"),
    ("C: Any other white background", "Any other white background"),
    ("C: Gypsy or Irish Traveller", "Any other white background"),
    ("C: Roma", "Any other white background"),
    ("D: White and black caribbean", "White and Black Caribbean"),
    ("E: White and black african", "White and Black African"),
    ("F: White and asian", "White and Asian"),
    ("G: Mixed other", "Any other mixed background"),
    ("G: Any other mixed background", "Any other mixed background"),
    ("H: Indian", "Indian"),
    ("J: Pakistani", "Pakistani"),
    ("K: Bangladeshi", "Bangladeshi"),
    ("L: Other asian", "Any other Asian background"),
    ("L: Any other asian background", "Any other Asian background"),
    ("M: caribbean", "Caribbean"),
    ("N: african", "African"),
    ("P: Other black", "Any other Black background"),
    ("P: Any other black background", "Any other Black background"),
    ("R: Chinese", "Chinese"),
    ("S: Any other ethnic group", "Any other ethnic group"),
    ("S: Arab", "Any other ethnic group"),
    ("Z: Not stated", "Not Known"),
    ("Z: Not stated", "Not stated"),
]


def _group(side: int) -> str:
    """The group by number; the number beyond the last has none."""
    whens = " ".join(f"WHEN {i} THEN '{pair[side]}'" for i, pair in enumerate(GROUPS))
    return f"CASE CAST((c_custkey + c_nationkey) % {len(GROUPS) + 1} AS INT) {whens} END"


PERSON = {
    "person_id": "c_custkey",
    "area": "CAST(c_nationkey AS STRING)",
    "group_raw": _group(0),
    "group_national": _group(1),
    "sex": """CASE WHEN c_custkey % 7 = 0 THEN 'Unknown'
      WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END""",
    "age": "CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE CAST((c_custkey * 37) % 113 AS INT) END",
}

AGE_BAND = """CASE WHEN person_id % 97 = 0 THEN NULL
      WHEN age IS NULL THEN 'NA-NA'
      WHEN age BETWEEN 5 AND 9 THEN '05-Sep'
      WHEN age BETWEEN 10 AND 14 THEN 'Oct-14'
      ELSE CAST(age - age % 5 AS STRING) || '-' || CAST(age - age % 5 + 4 AS STRING) END"""

REGISTER = {
    "area": "area",
    "group_national": "group_national",
    "sex": "sex",
    "age_band": "age_band",
    "observations": "CASE WHEN person_id % 101 = 0 THEN NULL ELSE 1 + person_id % 3 END",
}

EVENT_LOG = {
    "event_id": "o_orderkey",
    "event_date": "o_orderdate",
    **{c: c for c in ("person_id", "area", "group_raw", "sex", "age", "age_band")},
}

AREA_LOOKUP = {
    "area": "CAST(n_nationkey AS STRING)",
    "imd_quintile": "CASE WHEN n_nationkey % 11 = 10 THEN NULL ELSE n_nationkey % 5 + 1 END",
    "constituency": "r_name",
    "locality": "n_name",
}
# All regions but the last one, so some events and people are outside the target areas.
IS_TARGET = "n_regionkey <> 4"


def columns(view: dict[str, str]) -> list[str]:
    return [f"{expression} AS {name}" for name, expression in view.items()]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def person(spark: SparkSession, folder: str) -> DataFrame:
    people = table(spark, folder, "customer").selectExpr(*columns(PERSON))
    return people.selectExpr("*", f"{AGE_BAND} AS age_band")


def register(spark: SparkSession, folder: str) -> DataFrame:
    return person(spark, folder).selectExpr(*columns(REGISTER))


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """One row per event."""
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "person_id")
    return orders.join(person(spark, folder), "person_id").selectExpr(*columns(EVENT_LOG))


def event_tally(spark: SparkSession, folder: str) -> DataFrame:
    """The events of the window as one row per person with their number.

    The log is summed per person before it meets the people, so a person with a third of
    all events is one row by then.
    """
    window = in_window(table(spark, folder, "orders"), "o_orderdate", WINDOW_START, WINDOW_END)
    events = window.withColumnRenamed("o_custkey", "person_id").groupBy("person_id")
    return events.agg(F.expr("count(1) AS events")).join(person(spark, folder), "person_id")


@lru_cache(maxsize=16)
def areas(spark: SparkSession, folder: str) -> Areas:
    """Target areas and lookup, their sizes checked once per session and folder."""
    nation, region = (table(spark, folder, name) for name in ("nation", "region"))
    located = nation.join(region.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    targets = nation.filter(IS_TARGET).selectExpr(f"{AREA_LOOKUP['area']} AS area")
    return checked_areas(targets, located.selectExpr(*columns(AREA_LOOKUP)))
