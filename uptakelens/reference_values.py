"""Fixed values.

Every list, pattern and wording below has to equal the published analysis for the
results to match it, so they are stated here as they are, in their natural order.
All functions take them as parameters; these are only the defaults.
"""

# Age bands as a spreadsheet mangles them, and what they are read as.
BAND_REPAIRS = {"05-Sep": "5-19", "Oct-14": "10-14"}
UNKNOWN_BAND = "NA-NA"

# Cleaning of the event log's group text.
PREFIX_PATTERN = r"(?U)\w: "
GROUP_RENAMES = {"British": "White British"}
CAPITALS = {
    "asian": "Asian",
    "black": "Black",
    "african": "African",
    "caribbean": "Caribbean",
}

# Broad group of each label, as used for the event log.
EVENT_BROAD_GROUPS = {
    "Asian": ["Pakistani", "Indian", "Bangladeshi", "Other Asian", "Chinese"],
    "Black": ["African", "Caribbean", "Other Black"],
    "Mixed": [
        "White and Black Caribbean",
        "White and Black African",
        "White and Asian",
        "Mixed other",
    ],
    "White": ["White British", "Irish", "Other White", "Gypsy or Irish Traveller", "Roma"],
    "Other": ["Any other ethnic group", "Arab"],
    "Unknown": ["Not stated"],
}

# Broad group of each label, as used for the register.
REGISTER_BROAD_GROUPS = {
    "Asian": ["Pakistani", "Indian", "Bangladeshi", "Any other Asian background"],
    "Black": ["African", "Caribbean", "Any other Black background"],
    "Mixed": [
        "White and Black Caribbean",
        "White and Black African",
        "White and Asian",
        "Any other mixed background",
    ],
    "White": ["White British", "Irish", "Any other white background"],
    "Other": ["Chinese", "Any other ethnic group"],
    "Unknown": ["Not stated"],
}

# Labels that stand for "we do not know", and the sexes reported on.
NOT_STATED = "Not stated"
NOT_KNOWN = "Not Known"
SEXES = ["Female", "Male"]

# Age groups and the five-year bands in them; any other band, also an
# open-ended one above 104, falls in the remaining group.
AGE_GROUPS = {
    "65-79": ["65-69", "70-74", "75-79"],
    "80+": ["80-84", "85-89", "90-94", "95-99", "100-104"],
}
REMAINING_AGE_GROUP = "Less than 65"
AGE_GROUP_ORDER = ["Less than 65", "65-79", "80+"]

# Bands left out of the area layer.
BANDS_FROM_65 = [
    "65-69",
    "70-74",
    "75-79",
    "80-84",
    "85-89",
    "90-94",
    "95-99",
    "100-104",
    "105-109",
    "110-114",
]

# Matrix columns.
MATRIX_BROAD_GROUPS = ["Asian", "Black", "Mixed", "Other", "White"]
MATRIX_LABELS = [
    "Any other Asian background",
    "Bangladeshi",
    "Indian",
    "Pakistani",
    "African",
    "Any other Black background",
    "Caribbean",
    "Any other mixed background",
    "White and Asian",
    "White and Black African",
    "White and Black Caribbean",
    "Any other ethnic group",
    "Chinese",
    "Any other white background",
    "Irish",
    "White British",
]

# Confidence level of the two-sided 95 % limits, and disclosure control.
UPPER_LEVEL = 0.975
SMALL_NUMBER = 5
SMALL_NUMBER_TEXT = "<5"

# Wording. Captions take the label, the ages and the period.
EVERYONE = "All"
BOTH_SEXES = "both"
PERIOD_LABEL = "Oct 23 - Sept 24"
PERIOD_START = "2023-10-01"
PERIOD_END = "2024-10-01"
GROUP_CAPTION = (
    "Estimated number of {label} residents aged {ages} who didn't receive a Covid-19 "
    "vaccine between {period}"
)
EVERYONE_CAPTION = (
    "Estimated number of residents of all ethnicities aged {ages} who didn't receive a "
    "Covid-19 vaccine between {period}"
)
CAPTION_AGES = "less than 65"
CAPTION_PERIOD = "Oct 2023 and Sept 2024"
RATE_MATRIX_NAME = "CovidMat-%s-%s"
GAP_MATRIX_NAME = "Unvaxed-%s-%s"
