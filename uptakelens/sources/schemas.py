"""Declared input schemas and the library's own column names.

The library works on four inputs and uses these names throughout:

=============  ==============================================================
event log      area, group_raw, age_band, sex, age [, events = number of events]
register       area, group_national, age_band, sex, observations
area lookup    area, imd_quintile, constituency [, more attributes]
target areas   area
=============  ==============================================================
"""

from __future__ import annotations

from pyspark.sql import types as T

# Columns of the event extract, as delivered.
EXTRACT_COLUMNS = [
    "action",
    "pillar",
    "site_ods_code",
    "string_dose_number",
    "cleaned_cohort",
    "ethnicity_description",
    "practice_code",
    "age",
    "AgeBand",
    "gender",
    "LSOA",
]

# The columns of the extract that the analysis uses.
EVENTS = T.StructType(
    [
        T.StructField("ethnicity_description", T.StringType()),
        T.StructField("age", T.DoubleType()),
        T.StructField("AgeBand", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("LSOA", T.StringType()),
    ]
)

REGISTER = T.StructType(
    [
        T.StructField("LSOA_2011", T.StringType()),
        T.StructField("AgeBand", T.StringType()),
        T.StructField("Ethnic_Description_National", T.StringType()),
        T.StructField("Gender", T.StringType()),
        T.StructField("Observations", T.LongType()),
    ]
)

AREA_LOOKUP = T.StructType(
    [
        T.StructField("LSOA", T.StringType()),
        T.StructField("Locality", T.StringType()),
        T.StructField("IMD_quintile", T.IntegerType()),
        T.StructField("Constituency", T.StringType()),
    ]
)

EVENT_NAMES = {
    "ethnicity_description": "group_raw",
    "AgeBand": "age_band",
    "gender": "sex",
    "LSOA": "area",
}
REGISTER_NAMES = {
    "LSOA_2011": "area",
    "AgeBand": "age_band",
    "Ethnic_Description_National": "group_national",
    "Gender": "sex",
    "Observations": "observations",
}
LOOKUP_NAMES = {
    "LSOA": "area",
    "Locality": "locality",
    "IMD_quintile": "imd_quintile",
    "Constituency": "constituency",
}
TARGET_NAMES = {"LSOA11": "area"}

# Result files handed to other tools, by the names those tools expect.
RATE_FILE_NAMES = {
    "label": "Ethnicity",
    "broad_group": "BroadEthnicity",
    "imd_quintile": "IMD_quintile",
    "sex": "Sex",
    "age_group": "Age_Group",
    "events": "n",
    "population": "N_GP",
    "proportion": "p_GP",
    "percent": "perc_GP",
    "z": "Z",
    "lower": "LowerCI95",
    "upper": "UpperCI95",
}
GAP_FILE_NAMES = {
    "label": "Ethnicity",
    "imd_quintile": "IMD_quintile",
    "sex": "Sex",
    "age_group": "Age_Group",
    "gap": "number_unvaxed",
}
