"""SQL for the health panel: raw table, cleaning and questions."""

from oracle.panel import (
    below_third,
    centred,
    corr_sql,
    describe_sql,
    extreme_sql,
    half_up,
    half_up_mean,
    latest_sql,
    mean,
    neighbour_case,
    neighbour_columns,
    rolling_sql,
    slope_sql,
    tiers_ctes,
)

MEASURES = (
    "AdultMortality infantdeaths percentageexpenditure Measles BMI under_fivedeaths Polio Diphtheria "
    "HIVAIDS GDP thinness10_19years thinness5_9years Schooling"
).split()

RAW = """
cell AS (
  SELECT o_custkey AS country, CAST(year(o_orderdate) AS INT) AS period,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS urgent,
         COUNT(*) AS n, CAST(SUM(l_quantity) AS BIGINT) AS q, CAST(MIN(l_quantity) AS BIGINT) AS q_min,
         SUM(CAST(l_extendedprice AS DECIMAL(14,2))) AS amount,
         CAST(SUM(ROUND(l_discount * 100)) AS BIGINT) AS off,
         CAST(MAX(ROUND(l_discount * 100)) AS BIGINT) AS off_max,
         SUM(CAST(l_tax AS DECIMAL(4,2))) AS tax,
         COUNT(*) FILTER (WHERE l_returnflag = 'R') AS returned,
         COUNT(*) FILTER (WHERE l_returnflag = 'A') AS accepted,
         COUNT(*) FILTER (WHERE l_linestatus = 'O') AS open, MAX(o_orderstatus) AS status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
years AS (
  SELECT c_custkey, c_mktsegment, CAST(UNNEST(RANGE((SELECT MIN(year(o_orderdate)) FROM orders),
         (SELECT MAX(year(o_orderdate)) FROM orders) + 1)) AS INT) AS period FROM customer),
typed AS (
  SELECT CAST(y.c_custkey AS VARCHAR) AS Country, y.period AS Year,
         CASE status WHEN 'F' THEN 'Developed' WHEN 'O' THEN 'Developing' END AS Status,
         CASE WHEN q % 7 <> 0 THEN CAST(((q * 100) // n + 4000) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(4,2))
              END AS Lifeexpectancy,
         CASE WHEN q % 5 <> 0 THEN CAST(q AS DOUBLE) END AS AdultMortality,
         CASE WHEN q % 6 <> 0 THEN CAST(returned AS DOUBLE) END AS infantdeaths,
         CASE WHEN q % 8 <> 0 THEN CAST(CAST(FLOOR(amount) AS BIGINT) * CAST(0.01 AS DECIMAL(3,2)) AS DOUBLE) END
              AS percentageexpenditure,
         CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN CAST(open * 10 AS DOUBLE) END AS Measles,
         CASE WHEN q % 9 <> 0 THEN CAST(q % 40 + 8 AS DOUBLE) END AS BMI,
         CAST(returned + accepted AS DOUBLE) AS under_fivedeaths,
         CASE WHEN q % 11 <> 0 THEN CAST(q % 70 + 5 AS DOUBLE) END AS Polio,
         CAST(q_min * 2 AS DOUBLE) AS Diphtheria, CAST(tax AS DOUBLE) AS HIVAIDS,
         CASE WHEN q % 4 <> 0 THEN CAST(amount AS DOUBLE) END AS GDP,
         CAST(off_max AS DOUBLE) AS thinness10_19years,
         CASE WHEN q % 3 <> 0 THEN CAST(off AS DOUBLE) END AS thinness5_9years,
         CASE WHEN q % 10 <> 0 THEN CAST(n + 5 AS DOUBLE) END AS Schooling,
         y.c_custkey * 100000 + y.period * 10 + COALESCE(urgent, 0) AS Row_ID
  FROM years y LEFT JOIN cell ON cell.country = y.c_custkey AND cell.period = y.period)
"""

# Values on their way into a DECIMAL(4,2) column first have the six digits of a decimal mean.
_SIX = "CAST({} AS DECIMAL(12,6))"
_LIFE = neighbour_case(
    "Lifeexpectancy",
    "first_value",
    None,
    middle=_SIX.format("(Lifeexpectancy_lag + Lifeexpectancy_lead) / 2"),
    mean=_SIX.format("Lifeexpectancy_avg"),
)


def _around(m: str) -> str:
    return neighbour_columns(m, "Country", "Year", "Row_ID", "Status")


def _mean_fill(m: str) -> str:
    return f"""COALESCE({m}, {mean(m, 'OVER (PARTITION BY Country)')},
        {mean(m, 'OVER (PARTITION BY Status, Year)')}) AS {m}"""


_MEAN_FILLED = (
    "infantdeaths under_fivedeaths thinness10_19years thinness5_9years Polio Diphtheria BMI Measles "
    "percentageexpenditure"
).split()
_LOW = {
    "AdultMortality": 2,
    "Polio": 0,
    "Diphtheria": 0,
    "GDP": 2,
    "thinness10_19years": 2,
    "thinness5_9years": 2,
    "health_expenditure": 2,
}


def _low(m: str, digits: int) -> str:
    over = "OVER (PARTITION BY Country)"
    return f"CASE WHEN {below_third(m, over)} THEN {half_up_mean(m, digits, over)} ELSE {m} END AS {m}"


CLEAN = f"""{RAW},
status_filled AS (
  SELECT * REPLACE (COALESCE(Status, LAG(Status) OVER (PARTITION BY Country ORDER BY Year, Row_ID)) AS Status)
  FROM typed),
around AS (
  SELECT *, {_around('Lifeexpectancy')}, {_around('AdultMortality')}, {_around('Schooling')}, {_around('GDP')}
  FROM status_filled),
filled AS (
  SELECT Country, Year, Status,
         CAST(ROUND(CAST({_LIFE} AS DECIMAL(12,6)), 2) AS DECIMAL(4,2)) AS Lifeexpectancy,
         {neighbour_case('AdultMortality', 'first_value', None)} AS AdultMortality,
         {neighbour_case('Schooling', 'lead_then_last', 2)} AS Schooling,
         {neighbour_case('GDP', 'adjacent', 2)} AS GDP,
         {', '.join(_mean_fill(m) for m in _MEAN_FILLED)}, HIVAIDS, Row_ID
  FROM around),
single AS (
  SELECT * EXCLUDE (r, percentageexpenditure), percentageexpenditure AS health_expenditure
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY Country, Year ORDER BY Row_ID) AS r FROM filled)
  WHERE r = 1),
lifted AS (SELECT * REPLACE ({', '.join(_low(m, d) for m, d in _LOW.items())}) FROM single),
normal AS (SELECT Country, {mean('BMI')} AS mean FROM lifted WHERE BMI BETWEEN 15 AND 40 GROUP BY Country),
ranged AS (
  SELECT l.* REPLACE (CASE WHEN BMI NOT BETWEEN 15 AND 40 AND mean IS NOT NULL THEN mean ELSE BMI END AS BMI)
  FROM lifted l LEFT JOIN normal n ON l.Country = n.Country),
panel AS (
  SELECT *, {half_up('health_expenditure / NULLIF(GDP, 0) * 100.0', 2)} AS percentageexpenditure FROM ranged)
"""

_GDP = tiers_ctes("panel", "Country", "GDP", (71, 90), "latest", "Year", "gdp", "GDP_tier")
_MEASLES = tiers_ctes("panel", "Country", "Measles", (81,), "mean", None, "measles", "Measles_tier")
_POLIO = tiers_ctes("panel", "Country", "Polio", (61,), "mean", None, "polio", "Polio_tier")
_TIER_COLUMNS = """Country, CAST(percent_in_total AS DOUBLE) AS percent_in_total,
       CAST(rolling_percent AS DOUBLE) AS rolling_percent, counting"""
_LIFE_MEAN = f"ROUND({mean('Lifeexpectancy')}, 6) AS avg_Lifeexpectancy"


def _corr(x: str, *others: str) -> str:
    return f"""
WITH {CLEAN}, c AS (SELECT {centred((x, *others))} FROM panel)
SELECT {', '.join(corr_sql(x, y, f'corr_{x}_{y}') for y in others)} FROM c"""


def _missing(c: str) -> str:
    return f"COUNT(*) - COUNT({c}) AS {c}"


HEALTH = {
    "health_audit": f"""
WITH {RAW}
SELECT {', '.join(_missing(c) for c in ('Country', 'Year', 'Status', 'Lifeexpectancy', *MEASURES, 'Row_ID'))}
FROM typed""",
    "health_missing_gdp": f"""
WITH {RAW}
SELECT Country, COUNT(*) - COUNT(GDP) AS null_value FROM typed GROUP BY Country
ORDER BY null_value DESC, Country""",
    "health_clean": f"""
WITH {CLEAN}
SELECT Country, Year, Status, CAST(Lifeexpectancy AS DOUBLE) AS Lifeexpectancy, Row_ID,
       {', '.join(f'ROUND({m}, 6) AS {m}' for m in MEASURES if m != 'percentageexpenditure')},
       ROUND(health_expenditure, 6) AS health_expenditure, percentageexpenditure,
       ABS(percentageexpenditure) > 99.99 AS percentageexpenditure_overflow
FROM panel""",
    "health_gdp_tiers": f"WITH {CLEAN}, {_GDP} SELECT Country, GDP_tier FROM gdp",
    "health_measles_tiers": f"""
WITH {CLEAN}, {_MEASLES} SELECT {_TIER_COLUMNS}, Measles_tier FROM measles""",
    "health_polio_tiers": f"""
WITH {CLEAN}, {_POLIO} SELECT {_TIER_COLUMNS}, Polio_tier FROM polio""",
    "health_life_expectancy_summary": describe_sql(CLEAN, "Country", "Lifeexpectancy", ranked=True),
    "health_life_expectancy_trend": slope_sql(CLEAN, "Country", "Year", "Lifeexpectancy", "Status") + " ORDER BY Country",
    "health_latest_status_comparison": latest_sql(CLEAN, "Status", "Year", "Lifeexpectancy"),
    "health_mortality_correlation": _corr("AdultMortality", "Lifeexpectancy"),
    "health_life_expectancy_by_gdp": f"""
WITH {CLEAN}, {_GDP}
SELECT GDP_tier, {_LIFE_MEAN} FROM panel p JOIN gdp g ON p.Country = g.Country GROUP BY GDP_tier""",
    "health_life_expectancy_by_disease": f"""
WITH {CLEAN}, {_MEASLES}, {_POLIO}
SELECT Polio_tier, Measles_tier, {_LIFE_MEAN}
FROM panel p JOIN measles m ON p.Country = m.Country JOIN polio o ON p.Country = o.Country
GROUP BY Polio_tier, Measles_tier""",
    "health_schooling_correlation": _corr("Schooling", "Lifeexpectancy"),
    "health_schooling_extremes": f"""
WITH {CLEAN}
SELECT Country, Schooling, CAST(Lifeexpectancy AS DOUBLE) AS Lifeexpectancy FROM panel
QUALIFY Schooling IN (MIN(Schooling) OVER (), MAX(Schooling) OVER ())""",
    "health_bmi_trend": slope_sql(CLEAN, "Country", "Year", "BMI", None) + " ORDER BY Country",
    "health_child_deaths_at_extremes": extreme_sql(
        CLEAN,
        "Country",
        half_up_mean("Lifeexpectancy", 6),
        {"infantdeaths": "avg_infantdeaths", "under_fivedeaths": "avg_under_fivedeaths"},
    ),
    "health_mortality_moving_average": f"""
WITH {CLEAN}
SELECT Country, Year, {rolling_sql('AdultMortality', 'Country', 'Year', 'Year', 5, 4)} FROM panel""",
    "health_expenditure_correlation": _corr("percentageexpenditure", "Lifeexpectancy"),
    "health_bmi_correlations": _corr("BMI", "Lifeexpectancy", "AdultMortality"),
    "health_gdp_correlations": _corr("GDP", "Lifeexpectancy", "AdultMortality", "infantdeaths"),
    "health_gdp_correlations_by_tier": f"""
WITH {CLEAN}, {_GDP},
joined AS (SELECT p.*, GDP_tier FROM panel p JOIN gdp g ON p.Country = g.Country
           AND GDP_tier IN ('high', 'low')),
c AS (SELECT GDP_tier, {centred(('GDP', 'Lifeexpectancy', 'AdultMortality', 'infantdeaths'),
                                'PARTITION BY GDP_tier')} FROM joined)
SELECT GDP_tier, {', '.join(corr_sql('GDP', y, f'corr_GDP_{y}')
                            for y in ('Lifeexpectancy', 'AdultMortality', 'infantdeaths'))}
FROM c GROUP BY GDP_tier""",
    "health_life_expectancy_by_region": f"""
WITH {CLEAN}
SELECT r_name AS region, {_LIFE_MEAN}
FROM panel JOIN customer ON Country = CAST(c_custkey AS VARCHAR)
     JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name""",
}
