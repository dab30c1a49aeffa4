"""The registered queries once more, as plain SQL over the same tables.

Written the long way round (outer joins, UNION ALL instead of grouping sets, one CASE per
matrix column), so that agreement says something about the Spark side.
"""

from __future__ import annotations

from collections.abc import Sequence

from uptakelens import reference_values as fixed
from uptakelens.sources import sample_views as views

Z = "1.9599639845400536"


def _list(values) -> str:
    return ", ".join(f"'{value}'" for value in values)


def _columns(view: dict[str, str]) -> str:
    return ", ".join(views.columns(view))


def _case(column: str, groups: dict[str, list[str]], other: str = "NULL") -> str:
    whens = " ".join(f"WHEN {column} IN ({_list(m)}) THEN '{g}'" for g, m in groups.items())
    return f"CASE {whens} ELSE {other} END"


BAND = (
    "CASE age_band WHEN '05-Sep' THEN '5-19' WHEN 'Oct-14' THEN '10-14' ELSE age_band END"
)
AGE_GROUP = _case("age_band", fixed.AGE_GROUPS, f"'{fixed.REMAINING_AGE_GROUP}'")
PLAIN_GROUP = r"regexp_replace(group_raw, '\w: ', '', 'g')"
EVENT_LABEL = (
    "replace(replace(replace(replace("
    f"CASE WHEN {PLAIN_GROUP} = 'British' THEN 'White British' ELSE {PLAIN_GROUP} END, "
    "'asian', 'Asian'), 'black', 'Black'), 'african', 'African'), 'caribbean', 'Caribbean')"
)
WINDOW = (
    f"event_date >= TIMESTAMP '{views.WINDOW_START}' AND event_date < TIMESTAMP '{views.WINDOW_END}'"
)

BASE = f"""
WITH people AS (SELECT {_columns(views.PERSON)} FROM customer),
person AS (SELECT *, {views.AGE_BAND} AS age_band FROM people),
register_rows AS (SELECT {_columns(views.REGISTER)} FROM person),
event_log AS (
  SELECT {_columns(views.EVENT_LOG)} FROM orders JOIN person ON o_custkey = person_id),
area_lookup AS (
  SELECT {_columns(views.AREA_LOOKUP)} FROM nation JOIN region ON n_regionkey = r_regionkey),
target_area AS (
  SELECT {views.AREA_LOOKUP["area"]} AS area FROM nation WHERE {views.IS_TARGET}),
ev0 AS (
  SELECT event_id, person_id, area, sex, age, {BAND} AS age_band, {EVENT_LABEL} AS label
  FROM event_log WHERE {WINDOW} AND area IN (SELECT area FROM target_area)),
ev AS (
  SELECT ev0.*, {_case("label", fixed.EVENT_BROAD_GROUPS)} AS broad_group,
    imd_quintile, constituency
  FROM ev0 LEFT JOIN area_lookup USING (area)),
reg0 AS (
  SELECT area, sex, {BAND} AS age_band, observations,
    CASE group_national WHEN 'British' THEN 'White British' ELSE group_national END AS label
  FROM register_rows WHERE area IN (SELECT area FROM target_area)),
reg AS (
  SELECT reg0.*, {_case("label", fixed.REGISTER_BROAD_GROUPS)} AS broad_group,
    imd_quintile, constituency, locality
  FROM reg0 LEFT JOIN area_lookup USING (area)),
vocab AS (
  SELECT label, broad_group, CAST(row_number() OVER (
    ORDER BY broad_group DESC NULLS FIRST, label DESC) AS INT) AS ord
  FROM (SELECT DISTINCT label, broad_group FROM ev WHERE label IS NOT NULL) found)
"""


def _aligned(name: str, keys: list[str]) -> str:
    """CTE with the full outer join of both sides' sums and the filters of the rates."""
    columns = ", ".join(keys)
    broad = ", MAX(broad_group) AS broad_group" if "label" in keys else ""
    tests = ["age_band <> 'NA-NA'", "sex IN ('Male', 'Female')"]
    if "label" in keys:
        tests += ["label <> 'Not stated'", "label <> 'Not Known'"]
    if "imd_quintile" in keys:
        tests += ["imd_quintile IS NOT NULL"]
    kept = ", broad_group" if broad else ""
    return f""",
{name} AS (
  SELECT {columns}{kept}, {AGE_GROUP} AS age_group,
    CAST(COALESCE(population, 0) AS BIGINT) AS population,
    CAST(COALESCE(events, 0) AS BIGINT) AS events
  FROM (SELECT {columns}{broad}, COALESCE(SUM(observations), 0) AS population
        FROM reg GROUP BY {columns}) p
  FULL OUTER JOIN (SELECT {columns}, COUNT(*) AS events FROM ev GROUP BY {columns}) e
  USING ({columns})
  WHERE {" AND ".join(tests)})
"""


AL_GROUP = _aligned("al_group", ["age_band", "label", "sex"])
AL_IMD = _aligned("al_imd", ["age_band", "imd_quintile", "sex"])
AL_GROUP_IMD = _aligned("al_group_imd", ["age_band", "label", "imd_quintile", "sex"])


def _ratios(lower_term: str = "n + 1") -> str:
    nz = "NULLIF(population, 0)"
    root = f"sqrt(1.0::DOUBLE / NULLIF({lower_term.replace('n', 'events')}, 0))"
    n = "CAST(events AS DOUBLE)"
    return f"""
  round(events / {nz}, 9) AS proportion,
  round(100 * (events / {nz}), 9) AS percent,
  round({Z}::DOUBLE, 9) AS z,
  round(100 * {n} * pow(1 - 1.0::DOUBLE / NULLIF(9 * events, 0) - {Z}::DOUBLE / 3 * {root}, 3)
    / {nz}, 9) AS lower,
  round(100 * ({n} + 1) * pow(1 - 1.0::DOUBLE / (9 * ({n} + 1))
    + {Z}::DOUBLE / 3 * sqrt(1.0::DOUBLE / ({n} + 1)), 3) / {nz}, 9) AS upper"""


def _rates(source: str, dims: list[str], lower_term: str = "n + 1") -> str:
    columns = ", ".join(dims)
    return f"""
SELECT {columns}, events, population, {_ratios(lower_term)}
FROM (SELECT {", ".join(f"CAST({d} AS VARCHAR) AS {d}" for d in dims)},
        CAST(SUM(events) AS BIGINT) AS events, CAST(SUM(population) AS BIGINT) AS population
      FROM {source} GROUP BY ALL) sums
"""


GROUP_DIMS = ["label", "broad_group", "sex", "age_group"]
IMD_DIMS = ["imd_quintile", "sex", "age_group"]
BROAD_IMD_DIMS = ["broad_group", "imd_quintile", "sex", "age_group"]
GROUP_IMD_DIMS = ["label", "imd_quintile", "sex", "age_group"]

RATES_BY_GROUP = _rates("al_group", GROUP_DIMS)
RATES_BY_IMD = _rates("al_imd", IMD_DIMS)
BENCHMARK = _rates("al_group", ["age_group"])
AGE_GROUP_ORD = (
    "CASE age_group WHEN 'Less than 65' THEN 1 WHEN '65-79' THEN 2 WHEN '80+' THEN 3 END"
    " AS age_group_ord"
)

GAP_CELLS = AL_GROUP_IMD + """,
gaps AS (
  SELECT age_group, sex, label, imd_quintile, CAST(SUM(population) AS BIGINT) AS population,
    CAST(SUM(events) AS BIGINT) AS events,
    CAST(GREATEST(SUM(population) - SUM(events), 0) AS BIGINT) AS gap
  FROM al_group_imd GROUP BY age_group, sex, label, imd_quintile)
"""

GAP_LEVELS = GAP_CELLS + """,
vocab_gaps AS (
  SELECT age_group, sex, vocab.label AS label, CAST(imd_quintile AS VARCHAR) AS imd_quintile, gap
  FROM gaps LEFT JOIN vocab ON gaps.label = vocab.label),
levels AS (
  SELECT 'sex_label' AS level, sex, label, NULL::VARCHAR AS imd_quintile, age_group, SUM(gap) AS gap
  FROM vocab_gaps GROUP BY ALL
  UNION ALL
  SELECT 'sex_imd', sex, NULL, imd_quintile, age_group, SUM(gap) FROM vocab_gaps GROUP BY ALL
  UNION ALL
  SELECT 'sex_label_imd', sex, label, imd_quintile, age_group, SUM(gap)
  FROM vocab_gaps GROUP BY ALL
  UNION ALL
  SELECT 'label_imd', NULL, label, imd_quintile, age_group, SUM(gap)
  FROM vocab_gaps GROUP BY ALL)
"""


def _population(strict: bool) -> str:
    value = (
        "CASE WHEN COUNT(observations) = COUNT(*) THEN SUM(observations) END"
        if strict
        else "COALESCE(SUM(observations), 0)"
    )
    return f"""
SELECT area, label, age_band, constituency, CAST({value} AS BIGINT) AS population
FROM reg GROUP BY area, label, age_band, constituency
"""


def _area_gap(strict: bool) -> str:
    """CTE area_gap: the register's cells left joined to the events', then clamped."""

    def total(column: str) -> str:
        plain = f"SUM({column})"
        return (
            f"CASE WHEN COUNT({column}) = COUNT(*) THEN {plain} END"
            if strict
            else f"COALESCE({plain}, 0)"
        )

    return f""",
area_cells AS (
  SELECT p.area, p.label, p.constituency, population, COALESCE(events, 0) AS events
  FROM (SELECT area, label, age_band, constituency, {total("observations")} AS population
        FROM reg
        WHERE (age_band IS NULL OR age_band NOT IN ({_list(fixed.BANDS_FROM_65)}))
          AND label <> 'Not Known'
        GROUP BY area, label, age_band, constituency) p
  LEFT JOIN (SELECT area, label, age_band, COUNT(*) AS events FROM ev
             WHERE label <> 'Not stated' GROUP BY area, label, age_band) e
  ON p.area = e.area AND p.label = e.label AND p.age_band IS NOT DISTINCT FROM e.age_band),
area_gap AS (
  SELECT area, label, constituency, CAST(CASE WHEN gap < 0 THEN 0 ELSE gap END AS BIGINT) AS gap,
    CAST(total AS BIGINT) AS total
  FROM (SELECT area, label, constituency, {total("population")} - SUM(events) AS gap,
          {total("population")} AS total
        FROM area_cells GROUP BY area, label, constituency) sums)
"""


def _complete(column: str) -> str:
    return f"CAST(CASE WHEN COUNT({column}) = COUNT(*) THEN SUM({column}) END AS BIGINT)"


LAST = "(SELECT CAST(COUNT(*) + 1 AS INT) FROM vocab)"

TABLES = f""",
tables AS (
  SELECT ord, v.label, constituency, {_complete("gap")} AS gap, {_complete("total")} AS total
  FROM vocab v JOIN area_gap g ON v.label = g.label GROUP BY ord, v.label, constituency
  UNION ALL
  SELECT {LAST}, 'All', constituency, {_complete("gap")}, {_complete("total")}
  FROM area_gap GROUP BY constituency),
parts AS (
  SELECT ord, label, constituency, gap, total,
    100.0::DOUBLE * gap / NULLIF(CASE WHEN COUNT(gap) OVER w = COUNT(*) OVER w
      THEN CAST(SUM(gap) OVER w AS DOUBLE) END, 0) AS exact
  FROM tables WINDOW w AS (PARTITION BY ord)),
"""
HALF_UP = "shares AS (SELECT * EXCLUDE (exact), round(exact, 1) AS share FROM parts)"
NEAREST = """
around AS (SELECT *, floor(10 * exact) / 10 AS below, ceil(10 * exact) / 10 AS above FROM parts),
shares AS (
  SELECT ord, label, constituency, gap, total, CASE WHEN exact - below < above - exact THEN below
    WHEN exact - below > above - exact THEN above
    WHEN floor(10 * exact)::BIGINT % 2 = 0 THEN below ELSE above END AS share
  FROM around)
"""
RANKED = """
SELECT ord, label, constituency, gap, total, share, CAST(row_number() OVER (
  PARTITION BY ord ORDER BY share DESC NULLS LAST, constituency ASC NULLS LAST) AS INT) AS position
"""
SHARE = TABLES + NEAREST + RANKED

TOTALS = f""",
totals AS (
  SELECT ord, v.label, {_complete("gap")} AS gap, {_complete("total")} AS total
  FROM vocab v JOIN area_gap g ON v.label = g.label GROUP BY ord, v.label
  UNION ALL
  SELECT ord, label, 0, 0 FROM vocab WHERE label NOT IN (
    SELECT label FROM area_gap WHERE label IS NOT NULL)
  UNION ALL
  SELECT {LAST}, 'All', {_complete("gap")}, {_complete("total")} FROM area_gap)
SELECT ord, label, gap, total,
  COALESCE(CAST(gap AS VARCHAR), 'NA') || ' of ' || COALESCE(CAST(total AS VARCHAR), 'NA') AS summary,
  CASE WHEN ord = {LAST} THEN 'Estimated number of residents of all ethnicities'
       ELSE 'Estimated number of ' || label || ' residents' END
  || ' aged less than 65 who didn''t receive a Covid-19 vaccine between Jan 1996 and Dec 1996'
    AS caption,
  replace(label, ' ', '-') AS file_name
FROM totals
"""

LAYER = f""",
grid AS (
  SELECT ord, label, area FROM vocab, target_area
  UNION ALL SELECT {LAST}, 'All', area FROM target_area),
area_values AS (
  SELECT label, area, {_complete("gap")} AS gap, true AS present FROM area_gap GROUP BY label, area
  UNION ALL SELECT 'All', area, {_complete("gap")}, true FROM area_gap GROUP BY area)
SELECT ord, label, area,
  CAST(COALESCE(CASE WHEN gap < 5 THEN 0 ELSE gap END, 0) AS BIGINT) AS value,
  NOT COALESCE(present AND gap IS NULL, false) AS is_known
FROM grid LEFT JOIN area_values USING (label, area)
"""


def _rate_matrix() -> str:
    cells = ", ".join(
        f'MAX(CASE WHEN broad_group = \'{g}\' THEN {m} END) AS "{g}_{m}"'
        for g in fixed.MATRIX_BROAD_GROUPS
        for m in ("population", "events", "percent")
    )
    return f"""
SELECT age_group, sex, imd_quintile, {cells},
  'CovidMat-' || age_group || '-' || sex AS file_name
FROM ({_rates("al_group_imd", BROAD_IMD_DIMS)}) r WHERE broad_group IS NOT NULL
GROUP BY age_group, sex, imd_quintile
"""


def _gap_matrix(by_sex: bool, text: bool = False) -> str:
    level = "sex_label_imd" if by_sex else "label_imd"
    keys = "age_group, sex, imd_quintile" if by_sex else "age_group, imd_quintile"

    def cell(label: str) -> str:
        count = f"CAST(COALESCE(SUM(CASE WHEN label = '{label}' THEN gap END), 0) AS BIGINT)"
        if text:
            count = f"CASE WHEN {count} < 5 THEN '<5' ELSE CAST({count} AS VARCHAR) END"
        return f'{count} AS "{label}"'

    cells = ", ".join(cell(label) for label in fixed.MATRIX_LABELS)
    who = "sex" if by_sex else "'both'"
    return f"""
SELECT {keys}, {cells}, 'Unvaxed-' || age_group || '-' || {who} AS file_name
FROM levels WHERE level = '{level}' AND label IS NOT NULL GROUP BY {keys}
"""


MARGINS = AL_GROUP_IMD + f""",
m AS (SELECT age_group, sex, CAST(imd_quintile AS VARCHAR) AS imd_quintile, broad_group, events,
        population FROM al_group_imd WHERE broad_group IS NOT NULL),
sums AS (
  SELECT 'cell' AS margin, age_group, sex, imd_quintile, broad_group, SUM(events) AS events,
    SUM(population) AS population FROM m GROUP BY ALL
  UNION ALL
  SELECT 'row', age_group, sex, imd_quintile, NULL, SUM(events), SUM(population) FROM m GROUP BY ALL
  UNION ALL
  SELECT 'column', age_group, sex, NULL, broad_group, SUM(events), SUM(population) FROM m GROUP BY ALL
  UNION ALL
  SELECT 'all', age_group, sex, NULL, NULL, SUM(events), SUM(population) FROM m GROUP BY ALL),
whole AS (SELECT margin, age_group, sex, imd_quintile, broad_group,
  CAST(events AS BIGINT) AS events, CAST(population AS BIGINT) AS population FROM sums)
SELECT margin, age_group, sex, imd_quintile, broad_group, events, population, {_ratios()}
FROM whole
"""


def _median(strict: bool, sexes: Sequence[str] = ("Female", "Male")) -> str:
    def median(sex: str) -> str:
        of = f"FILTER (WHERE sex = '{sex}')"
        value = f"CAST(MEDIAN(age) {of} AS DOUBLE)"
        if strict:
            value = f"CASE WHEN COUNT(age) {of} = COUNT(*) {of} THEN {value} END"
        return f"{value} AS median_{sex.lower()}"

    def number(column: str) -> str:
        return rf"COALESCE(regexp_replace(CAST({column} AS VARCHAR), '\.0$', ''), 'NA')"

    texts = " || ' | ' || ".join(f"'{sex[0]}:' || {number(f'median_{sex.lower()}')}" for sex in sexes)
    return f"""
SELECT *, {texts} AS median_text
FROM (SELECT label, {", ".join(map(median, sexes))}
      FROM ev WHERE sex IN ({_list(sexes)}) GROUP BY label) medians
"""


def _align_columns(source: str, keys: str) -> str:
    return f"SELECT {keys}, age_group, population, events FROM {source}"


def _with_benchmark(rates: str, columns: str) -> str:
    return f"""
SELECT {columns}, r.events, r.population, r.proportion, r.percent, r.z, r.lower, r.upper,
  b.percent AS benchmark_percent, {AGE_GROUP_ORD.replace("CASE age_group", "CASE r.age_group")}
FROM ({rates}) r LEFT JOIN ({BENCHMARK}) b ON r.age_group = b.age_group
"""


def _in_order(rows: str) -> str:
    return f"SELECT r.*, vocab.ord FROM ({rows}) r LEFT JOIN vocab ON r.label = vocab.label"


def _gap_margins(by_sex: bool) -> str:
    level = "sex_label_imd" if by_sex else "label_imd"
    keys = "age_group, sex" if by_sex else "age_group"
    rows = f"(SELECT * FROM levels WHERE level = '{level}' AND label IN ({_list(fixed.MATRIX_LABELS)}))"
    parts = {
        "cell": ("imd_quintile", "label"),
        "row": ("imd_quintile", "NULL"),
        "column": ("NULL", "label"),
        "all": ("NULL", "NULL"),
    }
    return " UNION ALL ".join(
        f"SELECT '{margin}' AS margin, {keys}, {imd} AS imd_quintile, {label} AS label, "
        f"CAST(SUM(gap) AS BIGINT) AS gap FROM {rows} r GROUP BY ALL"
        for margin, (imd, label) in parts.items()
    )


def _exact_limits() -> str:
    """Limits by halving the interval, from Poisson probabilities."""
    def halved(shape: str, above: str) -> str:
        return f"""list_reduce(
          list_prepend({{'lo': 0.0::DOUBLE, 'hi': 2.0::DOUBLE * {shape} + 20}},
            list_transform(range(200), lambda i: {{'lo': 0.0::DOUBLE, 'hi': 0.0::DOUBLE}})),
          lambda s, unused: CASE WHEN list_sum(list_transform(range({shape}),
              lambda k: exp(k * ln((s.lo + s.hi) / 2) - (s.lo + s.hi) / 2 - lgamma(k + 1)))) > {above}
            THEN {{'lo': (s.lo + s.hi) / 2, 'hi': s.hi}} ELSE {{'lo': s.lo, 'hi': (s.lo + s.hi) / 2}} END).lo"""

    return f"""
SELECT * REPLACE (
  round(CASE WHEN events = 0 THEN 0 ELSE 100 * {halved("greatest(events, 1)", "0.975")} END / NULLIF(population, 0), 6) AS lower,
  round(100 * {halved("(events + 1)", "0.025")} / NULLIF(population, 0), 6) AS upper)
FROM ({_rates("al_imd", IMD_DIMS)}) r
"""


def _density(points: int, tails: int) -> str:
    """Kernel density with every event a point of its own, from library statistics."""
    return f"""
, aged AS (SELECT label, sex, age FROM ev WHERE sex IN ('Female', 'Male') AND age IS NOT NULL),
stats AS (
  SELECT label, sex, COUNT(*) AS n, stddev_samp(age) AS sd,
    (quantile_cont(age, 0.75) - quantile_cont(age, 0.25)) / 1.34 AS iqr, MIN(age) AS lo, MAX(age) AS hi
  FROM aged GROUP BY label, sex HAVING COUNT(*) > 1),
widths AS (
  SELECT *, 0.9 * pow(n, -0.2) * CASE WHEN least(sd, iqr) > 0 THEN least(sd, iqr) WHEN sd > 0 THEN sd
    WHEN lo <> 0 THEN abs(lo) ELSE 1 END AS bandwidth FROM stats),
grid AS (
  SELECT label, sex, n, bandwidth, point,
    lo - {tails} * bandwidth + (hi - lo + 2 * {tails} * bandwidth) * point / {points - 1} AS at_age
  FROM widths, (SELECT unnest(range({points}))::INT AS point) p),
curves AS (
  SELECT grid.label, grid.sex, point, at_age, bandwidth,
    SUM(exp(-0.5 * pow((at_age - age) / bandwidth, 2))) / (n * bandwidth * sqrt(2 * pi())) AS density
  FROM grid JOIN aged ON grid.label IS NOT DISTINCT FROM aged.label AND grid.sex = aged.sex
  GROUP BY grid.label, grid.sex, point, at_age, bandwidth, n)
""" + _in_order(
        "SELECT label, sex, point, round(at_age, 9) AS at_age, round(bandwidth, 9) AS bandwidth,"
        " round(density, 9) AS density, round(density / MAX(density) OVER (PARTITION BY sex), 9) AS width FROM curves"
    )


def _account() -> str:
    """Every filter of every pipeline, one SELECT for each."""
    band, stated, known = "age_band <> 'NA-NA'", "label <> 'Not stated'", "label <> 'Not Known'"
    sex, imd = "sex IN ('Male', 'Female')", "imd_quintile IS NOT NULL"
    over = f"(age_band IS NULL OR age_band NOT IN ({_list(fixed.BANDS_FROM_65)}))"
    group = [("area", "t"), ("age_band", band), ("not_stated", stated), ("not_known", known), ("sex", sex)]
    quintile = [("area", "t"), ("age_band", band), ("sex", sex), ("imd_quintile", imd)]
    both = [*group, ("imd_quintile", imd)]
    on_register = f"""EXISTS (SELECT 1 FROM reg_all r WHERE r.t AND r.area = x.area AND r.label = x.label
      AND r.age_band IS NOT DISTINCT FROM x.age_band AND {over.replace("age_band", "r.age_band")}
      AND r.label <> 'Not Known')"""
    rates = {"rates_by_group": group, "rates_by_imd": quintile, "rates_by_group_imd": both}
    pipelines = {
        "events": {"profiles": [("area", "t"), ("sex", sex)], **rates,
                   "area_layer": [("area", "t"), ("not_stated", stated), ("on_register", on_register)]},
        "register": {**rates, "area_layer": [("area", "t"), ("excluded_band", over), ("not_known", known)]},
    }
    selects = []
    for source, own in pipelines.items():
        for pipeline, steps in own.items():
            for i, (name, _) in enumerate(steps):
                before, after = (" AND ".join(["true", *(t for _, t in steps[:n])]) for n in (i, i + 1))
                selects.append(
                    f"SELECT '{source}' AS input, '{pipeline}' AS pipeline, {i + 1}::INT AS step, '{name}' AS test,"
                    f" COUNT(*) FILTER (WHERE {before}) AS rows_in, COUNT(*) FILTER (WHERE {after}) AS rows_out,"
                    f" COUNT(*) FILTER (WHERE {before}) - COUNT(*) FILTER (WHERE {after}) AS rows_dropped"
                    f" FROM {'ev_all' if source == 'events' else 'reg_all'} x"
                )
    return f""",
ev_all AS (
  SELECT e.area, sex, {BAND} AS age_band, {EVENT_LABEL} AS label, l.imd_quintile,
    e.area IN (SELECT area FROM target_area) AS t
  FROM event_log e LEFT JOIN area_lookup l ON e.area = l.area WHERE {WINDOW}),
reg_all AS (
  SELECT r.area, sex, {BAND} AS age_band, l.imd_quintile, r.area IN (SELECT area FROM target_area) AS t,
    CASE group_national WHEN 'British' THEN 'White British' ELSE group_national END AS label
  FROM register_rows r LEFT JOIN area_lookup l ON r.area = l.area)
""" + " UNION ALL ".join(selects)


#: Every matrix with its totals; what is hidden is a small entry or a corner of its best box.
PROTECTED = f""",
src AS (
  SELECT age_group, '=' || sex AS s, '=' || imd_quintile AS i, '=' || label AS l, gap FROM levels
  WHERE level = 'sex_label_imd' AND label IN ({_list(fixed.MATRIX_LABELS)})),
grid AS (
  SELECT ages.age_group, sexes.s, quintiles.i, labels.l FROM (SELECT DISTINCT age_group FROM src) ages,
    (SELECT unnest(['=Female', '=Male']) AS s) sexes,
    (SELECT '=' || unnest([{_list(fixed.MATRIX_LABELS)}]) AS l) labels,
    (SELECT DISTINCT age_group, i FROM src) quintiles
  WHERE quintiles.age_group = ages.age_group),
entries AS (
  SELECT age_group, coalesce(s, '') AS s, coalesce(i, '') AS i, coalesce(l, '') AS l,
    CAST(SUM(coalesce(gap, 0)) AS BIGINT) AS v
  FROM grid LEFT JOIN src USING (age_group, s, i, l) GROUP BY age_group, CUBE (s, i, l)),
small AS (SELECT age_group, s, i, l FROM entries WHERE v < 5),
boxes AS (
  SELECT small.*, a.s AS os, b.i AS oi, c.l AS ol FROM small
  JOIN (SELECT DISTINCT age_group, s FROM entries) a ON a.age_group = small.age_group AND a.s <> small.s
  JOIN (SELECT DISTINCT age_group, i FROM entries) b ON b.age_group = small.age_group AND b.i <> small.i
  JOIN (SELECT DISTINCT age_group, l FROM entries) c ON c.age_group = small.age_group AND c.l <> small.l),
corners AS (
  SELECT boxes.*, CASE WHEN m & 1 = 1 THEN os ELSE s END AS cs, CASE WHEN m & 2 = 2 THEN oi ELSE i END AS ci,
    CASE WHEN m & 4 = 4 THEN ol ELSE l END AS cl, bit_count(m::INT) AS moved
  FROM boxes, (SELECT unnest(range(1, 8)) AS m) masks),
judged AS (
  SELECT c.age_group, c.s, c.i, c.l, os, oi, ol,
    SUM(CASE WHEN v < 5 THEN 0 ELSE v END) AS hides,
    bool_and(v >= 5 OR ((c.s = '')::INT + (c.i = '')::INT + (c.l = '')::INT + (cs = '')::INT + (ci = '')::INT
      + (cl = '')::INT + moved) % 2 = 0) AS holds
  FROM corners c JOIN entries e ON e.age_group = c.age_group AND e.s = cs AND e.i = ci AND e.l = cl
  GROUP BY ALL),
best AS (
  SELECT *, row_number() OVER (PARTITION BY age_group, s, i, l ORDER BY hides, os, oi, ol) AS place
  FROM judged WHERE holds),
hidden AS (
  SELECT * FROM small
  UNION SELECT c.age_group, cs, ci, cl FROM corners c JOIN best USING (age_group, s, i, l, os, oi, ol) WHERE place = 1),
shown AS (
  SELECT age_group, CASE s WHEN '' THEN 'both' ELSE s[2:] END AS sex,
    CASE i WHEN '' THEN 'All' ELSE i[2:] END AS imd_quintile, CASE l WHEN '' THEN 'All' ELSE l[2:] END AS label,
    CASE WHEN h.gone IS NULL THEN v END AS gap, h.gone IS NOT NULL AS is_hidden
  FROM entries LEFT JOIN (SELECT *, true AS gone FROM hidden) h USING (age_group, s, i, l))
"""


def _protected_matrix() -> str:
    cells = ", ".join(
        f"MAX(CASE WHEN label = '{c}' THEN COALESCE(CAST(gap AS VARCHAR), '*') END) AS \"{c}\""
        for c in [*fixed.MATRIX_LABELS, "All"]
    )
    return f"""
SELECT age_group, sex, imd_quintile, {cells}, 'Unvaxed-' || age_group || '-' || sex AS file_name
FROM shown GROUP BY age_group, sex, imd_quintile
"""


def _other_settings() -> str:
    """Rates by group with another age grouping, 90 % limits and the textbook's lower one."""
    groups = (
        "CASE WHEN age_band IN ('5-9', '5-19', '10-14', '15-19') THEN '5-19' "
        "WHEN age_band IN ('20-24', '25-29', '30-34', '35-39') THEN '20-39' ELSE 'Others' END"
    )
    sql = (
        AL_GROUP
        + ", compared AS ("
        + _with_benchmark(
            _rates("al_group", GROUP_DIMS, "n"), "r.label, r.broad_group, r.sex, r.age_group"
        )
        + ") SELECT compared.* REPLACE (vocab.label AS label), vocab.ord "
        "FROM compared LEFT JOIN vocab ON compared.label = vocab.label"
    )
    order = "WHEN '5-19' THEN 1 WHEN '20-39' THEN 2 WHEN 'Others' THEN 3 END"
    sql = sql.replace(AGE_GROUP, groups).replace(Z, "1.6448536269514722")
    return BASE + sql.replace(
        "WHEN 'Less than 65' THEN 1 WHEN '65-79' THEN 2 WHEN '80+' THEN 3 END", order
    )


GIVEN = """
WITH given(label, ord) AS (VALUES ('Indian', 1), ('Irish', 2), ('Nowhere', 3), ('Chinese', 4)),
"""


def _given_gaps() -> str:
    """Everybody but the 20 to 24 year olds, under the supplied labels."""
    excluded = f"age_band NOT IN ({_list(fixed.BANDS_FROM_65)})"
    gaps = _area_gap(False)
    assert excluded in gaps
    return BASE.replace("\nWITH ", GIVEN, 1) + gaps.replace(excluded, "age_band <> '20-24'")


GIVEN_TOTALS = """,
totals AS (
  SELECT ord, v.label, CAST(COALESCE(SUM(gap), 0) AS BIGINT) AS gap,
    CAST(COALESCE(SUM(total), 0) AS BIGINT) AS total
  FROM given v LEFT JOIN area_gap g ON v.label = g.label GROUP BY ord, v.label
  UNION ALL SELECT 5, 'Everybody', CAST(SUM(gap) AS BIGINT), CAST(SUM(total) AS BIGINT) FROM area_gap)
SELECT ord, label, gap, total, gap || ' of ' || total AS summary,
  CASE WHEN ord = 5 THEN 'Estimated number of residents of all ethnicities'
       ELSE 'Estimated number of ' || label || ' residents' END
  || ' aged other than 20 to 24 who didn''t receive a Covid-19 vaccine between Jan 1996 and Dec 1996'
    AS caption, replace(label, ' ', '-') AS file_name
FROM totals
"""

GIVEN_LAYER = """,
grid AS (
  SELECT ord, label, area FROM given, target_area
  UNION ALL SELECT 5, 'Everybody', area FROM target_area),
area_values AS (
  SELECT label, area, SUM(gap) AS gap FROM area_gap GROUP BY label, area
  UNION ALL SELECT 'Everybody', area, SUM(gap) FROM area_gap GROUP BY area)
SELECT ord, label, area, CAST(CASE WHEN gap >= 20 THEN gap ELSE 0 END AS BIGINT) AS value,
  true AS is_known
FROM grid LEFT JOIN area_values USING (label, area)
"""


def all_sql() -> dict[str, str]:
    in_window = f"FROM event_log WHERE {WINDOW}"
    rates_group_imd = BASE + AL_GROUP_IMD + _rates("al_group_imd", GROUP_IMD_DIMS)
    rates_by_group = BASE + AL_GROUP + RATES_BY_GROUP
    gap_columns = "area, label, constituency, gap, total"
    share = {
        strict: BASE + _area_gap(strict) + SHARE + "FROM shares" for strict in (False, True)
    }
    return {
        "extract_events": BASE
        + f"SELECT event_id, person_id, area, group_raw, sex, age, age_band, "
        f"'{views.WINDOW_LABEL}' AS time_period {in_window}",
        "clean_events": BASE + "SELECT * FROM ev",
        "clean_register": BASE + "SELECT * FROM reg",
        "population_by_area": BASE + _population(False),
        "population_by_area_strict": BASE + _population(True),
        "row_account": BASE + _account(),
        "row_account_from_written_cells": BASE + _account(),
        "vocabulary_order": BASE + "SELECT label, broad_group, ord FROM vocab",
        "events_count_by_group_sex": BASE
        + _in_order(
            "SELECT label, sex, COUNT(*) AS events, format('{:,}', COUNT(*)) AS events_text "
            "FROM ev WHERE sex IN ('Female', 'Male') GROUP BY label, sex"
        ),
        "median_age_by_group": BASE + _in_order(_median(True)),
        "median_age_of_three_sexes": BASE + _in_order(_median(False, ["Male", "Female", "Unknown"])),
        "median_age_by_group_lenient": BASE + _in_order(_median(False)),
        "age_density": BASE + _density(512, 0),
        "age_density_with_tails": BASE + _density(200, 3),
        "age_frequency": BASE
        + _in_order(
            "SELECT label, sex, age, COUNT(*) AS events FROM ev "
            "WHERE sex IN ('Female', 'Male') AND age IS NOT NULL GROUP BY label, sex, age"
        ),
        "align_group": BASE
        + AL_GROUP
        + _align_columns("al_group", "age_band, label, sex, broad_group"),
        "align_imd": BASE + AL_IMD + _align_columns("al_imd", "age_band, imd_quintile, sex"),
        "align_group_imd": BASE
        + AL_GROUP_IMD
        + _align_columns("al_group_imd", "age_band, label, imd_quintile, sex, broad_group"),
        "align_area_left": BASE
        + """SELECT p.area, p.label, p.age_band, CAST(population AS BIGINT) AS population,
  COALESCE(events, 0) AS events
FROM (SELECT area, label, age_band, COALESCE(SUM(observations), 0) AS population FROM reg
      GROUP BY area, label, age_band) p
LEFT JOIN (SELECT area, label, age_band, COUNT(*) AS events FROM ev
           GROUP BY area, label, age_band) e
ON p.area = e.area AND p.label IS NOT DISTINCT FROM e.label
  AND p.age_band IS NOT DISTINCT FROM e.age_band""",
        "distinct_age_groups": BASE
        + AL_GROUP
        + f"SELECT DISTINCT age_group, {AGE_GROUP_ORD} FROM al_group",
        "rates_by_group": rates_by_group,
        "rates_by_group_textbook": BASE + AL_GROUP + _rates("al_group", GROUP_DIMS, "n"),
        "rates_with_exact_limits": BASE + AL_IMD + _exact_limits(),
        "rates_by_imd": BASE + AL_IMD + RATES_BY_IMD,
        "rates_broad_imd": BASE + AL_GROUP_IMD + _rates("al_group_imd", BROAD_IMD_DIMS),
        "rates_group_imd": rates_group_imd,
        "benchmark_age": BASE + AL_GROUP + BENCHMARK,
        "rates_with_benchmark": BASE
        + AL_GROUP
        + ", compared AS ("
        + _with_benchmark(RATES_BY_GROUP, "r.label, r.broad_group, r.sex, r.age_group")
        + ") SELECT compared.* REPLACE (vocab.label AS label), vocab.ord "
        "FROM compared LEFT JOIN vocab ON compared.label = vocab.label",
        "imd_rates_with_benchmark": BASE
        + AL_GROUP
        + AL_IMD
        + _with_benchmark(RATES_BY_IMD, "r.imd_quintile, r.sex, r.age_group"),
        "gap_cells": BASE + GAP_CELLS + "SELECT * FROM gaps",
        "gap_levels": BASE
        + GAP_LEVELS
        + "SELECT level, sex, levels.label, imd_quintile, age_group, CAST(gap AS BIGINT) AS gap, "
        f"ord, {AGE_GROUP_ORD} FROM levels LEFT JOIN vocab ON levels.label = vocab.label",
        "area_gap": BASE + _area_gap(False) + f"SELECT {gap_columns} FROM area_gap",
        "area_gap_from_report": BASE + _area_gap(False) + f"SELECT {gap_columns} FROM area_gap",
        "area_gap_strict": BASE + _area_gap(True) + f"SELECT {gap_columns} FROM area_gap",
        "area_layer": BASE + _area_gap(False) + LAYER,
        "area_layer_strict": BASE + _area_gap(True) + LAYER,
        "constituency_share": share[False],
        "constituency_share_strict": share[True],
        "constituency_share_half_up": BASE + _area_gap(False) + TABLES + HALF_UP + RANKED + "FROM shares",
        "gap_totals": BASE + _area_gap(False) + TOTALS,
        "gap_totals_in_other_words": BASE
        + _area_gap(False)
        + TOTALS.replace("\nSELECT ord, label, gap, total,", ",\nt AS (SELECT ord, label, gap, total,")
        + f") SELECT * REPLACE (CASE WHEN ord = {LAST} THEN 'Jan 1996 and Dec 1996: everybody' ELSE "
        "'less than 65, Jan 1996 and Dec 1996: ' || label || ' (' || label || ')' END AS caption) FROM t",
        "gap_totals_strict": BASE + _area_gap(True) + TOTALS,
        "rate_matrix": BASE + AL_GROUP_IMD + _rate_matrix(),
        "matrix_margins": BASE + MARGINS,
        "gap_matrix_by_sex": BASE + GAP_LEVELS + _gap_matrix(by_sex=True),
        "gap_matrix_both": BASE + GAP_LEVELS + _gap_matrix(by_sex=False),
        "gap_matrix_labels": BASE + GAP_LEVELS + _gap_matrix(by_sex=False, text=True),
        "gap_matrix_labels_by_sex": BASE + GAP_LEVELS + _gap_matrix(by_sex=True, text=True),
        "gap_margins_by_sex": BASE + GAP_LEVELS + _gap_margins(by_sex=True),
        "gap_margins_both": BASE + GAP_LEVELS + _gap_margins(by_sex=False),
        "gap_matrix_protected": BASE + GAP_LEVELS + PROTECTED + _protected_matrix(),
        "gap_margins_protected": BASE + GAP_LEVELS + PROTECTED + "SELECT * FROM shown",
        "rates_other_settings": _other_settings(),
        "gap_totals_given_vocabulary": _given_gaps() + GIVEN_TOTALS,
        "area_layer_given_vocabulary": _given_gaps() + GIVEN_LAYER,
        "events_from_csv": BASE
        + "SELECT group_raw, CAST(age AS DOUBLE) AS age, age_band, sex, area FROM event_log",
        "events_past_bad_rows": BASE
        + "SELECT group_raw, CAST(age AS DOUBLE) AS age, age_band, sex, area FROM event_log WHERE event_id % 97 <> 0",
        "unreadable_events": BASE
        + "SELECT concat_ws(',', COALESCE(group_raw, 'NA'), 'about ' || COALESCE(CAST(age AS VARCHAR), 'x'), "
        "COALESCE(age_band, 'NA'), sex, area) AS record, true AS from_the_file FROM event_log WHERE event_id % 97 = 0",
        "register_from_csv": BASE
        + "SELECT area, age_band, group_national, sex, CAST(observations AS BIGINT) AS observations "
        "FROM register_rows",
        "lookup_from_csv": BASE + "SELECT area, locality, imd_quintile, constituency FROM area_lookup",
        "rates_broad_csv_round_trip": BASE
        + AL_GROUP_IMD
        + "SELECT * REPLACE (CAST(imd_quintile AS INT) AS imd_quintile) FROM ("
        + _rates("al_group_imd", BROAD_IMD_DIMS)
        + ") r",
        "counts_csv_round_trip": BASE
        + GAP_LEVELS
        + "SELECT sex, label, CAST(imd_quintile AS INT) AS imd_quintile, age_group, "
        "CAST(gap AS BIGINT) AS gap FROM levels WHERE level = 'sex_label_imd'",
        "counts_both_csv_round_trip": BASE
        + GAP_LEVELS
        + "SELECT label, CAST(imd_quintile AS INT) AS imd_quintile, age_group, "
        "CAST(gap AS BIGINT) AS gap FROM levels WHERE level = 'label_imd'",
        "rates_csv_round_trip": BASE
        + AL_GROUP_IMD
        + "SELECT * REPLACE (CAST(imd_quintile AS INT) AS imd_quintile) FROM ("
        + _rates("al_group_imd", GROUP_IMD_DIMS)
        + ") r",
        "constituency_sheets": BASE
        + _area_gap(False)
        + SHARE
        + ", replace(label, ' ', '-') AS sheet FROM shares",
        "rates_from_written_cells": rates_by_group,
        "rates_from_stored_months": rates_by_group,
        "median_age_of_a_stored_quarter": BASE.replace(
            WINDOW, "event_date >= DATE '1996-11-01' AND event_date < DATE '1997-02-01'"
        )
        + _in_order(_median(False)),
    }
