"""DuckDB oracle SQL for every registered query, written from the metric
definitions (not from the Spark plans). Tables are the driver's views."""

from __future__ import annotations

AS_OF = "DATE '2002-12-31'"

# Observation records over the benchmark tables.
OBS = """obs AS (
  SELECT l.l_orderkey * 10 + l.l_linenumber AS id,
         CAST(NULL AS VARCHAR) AS uuid,
         CAST(o.o_orderdate AS DATE) AS observed_on,
         CASE WHEN l.l_linenumber % 2 = 1 THEN o.o_orderdate END AS time_observed_at,
         o.o_custkey AS user_id,
         l.l_shipdate AS created_at,
         l.l_partkey AS taxon_id,
         p.p_name AS scientific_name,
         p.p_brand AS common_name,
         p.p_type AS taxon_kingdom_name,
         p.p_name AS taxon_species_name,
         o.o_orderstatus AS quality_grade
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey)"""

# Whole years around the observed dates, one extra year on each side.
BOUNDS = """bounds AS (
  SELECT make_date(year(min(observed_on)) - 1, 1, 1) AS s,
         make_date(year(max(observed_on)) + 1, 12, 31) AS e
  FROM obs)"""

DAYS = """days AS (
  SELECT CAST(unnest(generate_series(CAST(s AS TIMESTAMP), CAST(e AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d
  FROM bounds)"""

WEEK_LABEL = "CAST(CASE WHEN month({w}) = 12 AND weekofyear({w}) = 1 THEN 53 ELSE weekofyear({w}) END AS INTEGER)"


def week_of(expr: str) -> str:
    return f"CAST(date_trunc('week', {expr}) AS DATE)"


def period_cal(grain: str, as_of: str = AS_OF) -> str:
    """Calendar CTE ``cal``: one row per period start up to as_of."""
    if grain == "week":
        return f"""cal AS (
  SELECT DISTINCT {week_of('d')} AS week FROM days),
calx AS (
  SELECT week, CAST(year(week) AS INTEGER) AS year, CAST(date_trunc('year', week) AS DATE) AS start_of_year,
         {WEEK_LABEL.format(w='week')} AS week_number
  FROM cal WHERE week <= {as_of})"""
    return f"""calx AS (
  SELECT d AS date, CAST(year(d) AS INTEGER) AS year, CAST(date_trunc('year', d) AS DATE) AS start_of_year,
         CAST(dayofyear(d) AS INTEGER) AS day_of_year
  FROM days WHERE d <= {as_of})"""


PERIOD = {"week": ("week", "week_number"), "day": ("date", "day_of_year")}
ENTITY = {"users": "user_id", "species": "taxon_id", "observations": "id"}


def period_expr(grain: str, date_expr: str) -> str:
    return week_of(date_expr) if grain == "week" else date_expr


def metric_sql(metric: str, grain: str, as_of: str = AS_OF) -> str:
    p, label = PERIOD[grain]
    key = ENTITY[metric]
    run = f"OVER (ORDER BY c.{p} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    uniq = f"""uniq AS (
  SELECT {period_expr(grain, 'observed_on')} AS {p}, count(DISTINCT {key}) AS n
  FROM obs WHERE observed_on IS NOT NULL GROUP BY 1)"""
    if metric == "observations":
        return f"""WITH {OBS}, {BOUNDS}, {DAYS}, {period_cal(grain, as_of)}, {uniq}
SELECT c.{p}, c.year, c.start_of_year, c.{label},
       CAST(coalesce(u.n, 0) AS BIGINT) AS unique_observations,
       CAST(sum(coalesce(u.n, 0)) {run} AS BIGINT) AS cumulative_observations
FROM calx c LEFT JOIN uniq u ON u.{p} = c.{p}"""
    first = f"""firsts AS (
  SELECT {key} AS k, min({period_expr(grain, 'observed_on')}) AS {p}
  FROM obs WHERE {key} IS NOT NULL AND observed_on IS NOT NULL GROUP BY 1),
newc AS (SELECT {p}, count(*) AS n FROM firsts GROUP BY 1)"""
    return f"""WITH {OBS}, {BOUNDS}, {DAYS}, {period_cal(grain, as_of)}, {uniq}, {first}
SELECT c.{p}, c.year, c.start_of_year, c.{label},
       CAST(coalesce(n.n, 0) AS BIGINT) AS new_{metric},
       CAST(coalesce(u.n, 0) AS BIGINT) AS unique_{metric},
       CAST(sum(coalesce(n.n, 0)) {run} AS BIGINT) AS cumulative_{metric}
FROM calx c LEFT JOIN uniq u ON u.{p} = c.{p} LEFT JOIN newc n ON n.{p} = c.{p}"""


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    for grain, prefix in (("week", "weekly"), ("day", "daily")):
        for metric in ("users", "species", "observations"):
            q[f"{prefix}_{metric}"] = metric_sql(metric, grain)
    return q


ORACLE = build()


# ---------------------------------------------------------------------------
# Everything else. Helper CTE bodies are composed as nested queries.

TRACKED = "('red plate', 'small widget', 'old rod')"
RAW = ("id, uuid, observed_on, time_observed_at, user_id, created_at, scientific_name, common_name, taxon_id, "
       "taxon_kingdom_name, taxon_species_name")
OBSCOLS = RAW + ", quality_grade"
CUT = "TIMESTAMP '1999-01-01 00:00:00'"
MIN_CHART_YEAR = 1996


def with_obs(body: str) -> str:
    return f"WITH {OBS}\n{body}"


def weekly_by_species_sql() -> str:
    return f"""WITH {OBS},
bs AS (
  SELECT {week_of('observed_on')} AS week, taxon_id, scientific_name,
         min(common_name) AS common_name, count(DISTINCT id) AS observations
  FROM obs
  WHERE lower(scientific_name) IN {TRACKED} AND observed_on IS NOT NULL
  GROUP BY 1, 2, 3)
SELECT taxon_id, scientific_name, common_name, week,
       CAST(year(week) AS INTEGER) AS year, CAST(date_trunc('year', week) AS DATE) AS start_of_year,
       {WEEK_LABEL.format(w='week')} AS week_number,
       CAST(observations AS BIGINT) AS observations,
       CAST(sum(observations) OVER (PARTITION BY taxon_id, scientific_name ORDER BY week
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cumulative_observations
FROM bs WHERE week <= {AS_OF}"""


COMBINED = f"""
SELECT u.week, u.year, u.start_of_year, u.week_number, u.new_users, u.unique_users, u.cumulative_users,
       s.new_species, s.unique_species, s.cumulative_species, o.unique_observations, o.cumulative_observations
FROM ({metric_sql('users', 'week')}) u
LEFT JOIN ({metric_sql('species', 'week')}) s ON s.week = u.week
LEFT JOIN ({metric_sql('observations', 'week')}) o ON o.week = u.week"""


def yoy_sql() -> str:
    fv = "first_value({c}) OVER (PARTITION BY year ORDER BY week)"
    return f"""WITH comb AS ({COMBINED}),
adj AS (
  SELECT *,
         {fv.format(c='cumulative_users')} AS starting_cumulative_users,
         {fv.format(c='cumulative_species')} AS starting_cumulative_species,
         {fv.format(c='cumulative_observations')} AS starting_cumulative_observations
  FROM comb),
ranked AS (
  SELECT *,
         cumulative_users - starting_cumulative_users AS year_adjusted_cumulative_users,
         cumulative_species - starting_cumulative_species AS year_adjusted_cumulative_species,
         cumulative_observations - starting_cumulative_observations AS year_adjusted_cumulative_observations,
         row_number() OVER (PARTITION BY week_number, year ORDER BY week) AS rn
  FROM adj)
SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1"""


def yoy_species_sql() -> str:
    return f"""WITH bs AS ({weekly_by_species_sql()}),
adj AS (
  SELECT *, first_value(cumulative_observations) OVER (
           PARTITION BY year, taxon_id, scientific_name ORDER BY week) AS starting_cumulative_observations
  FROM bs),
ranked AS (
  SELECT *, cumulative_observations - starting_cumulative_observations AS year_adjusted_cumulative_observations,
         row_number() OVER (PARTITION BY week_number, year, taxon_id, scientific_name ORDER BY week) AS rn
  FROM adj)
SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1"""


def metric_series_sql(min_year: int = MIN_CHART_YEAR) -> str:
    charts = [
        ("year_adjusted_cumulative", "week_number", "year_adjusted_cumulative_{m}"),
        ("cumulative", "week", "cumulative_{m}"),
        ("unique", "week_number", "unique_{m}"),
        ("unique", "week", "unique_{m}"),
        ("new", "week_number", "new_{m}"),
        ("new", "week", "new_{m}"),
    ]
    parts = []
    for m in ("users", "species", "observations"):
        for measure, x_kind, col in charts:
            if m == "observations" and measure == "new":
                continue
            parts.append(
                f"SELECT '{m}' AS metric, '{measure}' AS measure, '{x_kind}' AS x_kind, year AS series_year, "
                f"week, week_number, CAST({col.format(m=m)} AS BIGINT) AS y FROM yoy WHERE year >= {min_year}"
            )
    return f"WITH yoy AS ({yoy_sql()})\n" + "\nUNION ALL\n".join(parts)


def species_series_sql(min_year: int = MIN_CHART_YEAR) -> str:
    charts = [
        ("year_adjusted_cumulative", "week_number", "year_adjusted_cumulative_observations"),
        ("cumulative", "week", "cumulative_observations"),
        ("observations", "week_number", "observations"),
    ]
    parts = [
        f"SELECT taxon_id, scientific_name, '{measure}' AS measure, '{x_kind}' AS x_kind, year AS series_year, "
        f"week, week_number, CAST({col} AS BIGINT) AS y FROM ys "
        f"WHERE year >= {min_year} AND lower(scientific_name) IN {TRACKED}"
        for measure, x_kind, col in charts
    ]
    return f"WITH ys AS ({yoy_species_sql()})\n" + "\nUNION ALL\n".join(parts)


def events_cte() -> str:
    apr30 = "make_date(y, 4, 30)"
    return f"""ev AS (
  SELECT CAST(y AS VARCHAR) AS event,
         {apr30} - CAST((dayofweek({apr30}) + 2) % 7 AS INTEGER) AS start_date
  FROM (SELECT DISTINCT year(observed_on) AS y FROM obs WHERE observed_on IS NOT NULL)),
evx AS (SELECT event, start_date, start_date + 3 AS end_date FROM ev)"""


INCREMENT = f"""existing AS (SELECT * FROM obs WHERE created_at < {CUT}),
start AS (SELECT coalesce(max(created_at) - INTERVAL 1 DAY, TIMESTAMP '2017-01-01 00:00:00') AS start_at FROM existing),
batch AS (SELECT * FROM obs WHERE created_at >= (SELECT start_at FROM start))"""

DEDUP_ORDER = ", ".join(
    f"{c} DESC NULLS LAST"
    for c in ["created_at", "uuid", "observed_on", "time_observed_at", "user_id", "taxon_id", "scientific_name",
              "common_name", "taxon_kingdom_name", "taxon_species_name", "quality_grade"]
)

CAL_DAYS = f"""WITH {OBS}, {BOUNDS}, {DAYS}
SELECT d AS date,
       {week_of('d')} AS start_of_week,
       CAST(date_trunc('year', d) AS DATE) AS start_of_year,
       CAST(year(d) AS INTEGER) AS year,
       CAST(year({week_of('d')}) AS INTEGER) AS start_of_week_year,
       CAST(month(d) AS INTEGER) AS month,
       CAST(month({week_of('d')}) AS INTEGER) AS start_of_week_month,
       monthname(d) AS month_name,
       monthname({week_of('d')}) AS start_of_week_month_name,
       CAST(day(d) AS INTEGER) AS day,
       dayname(d) AS day_name,
       CAST(quarter(d) AS INTEGER) AS quarter,
       CAST(dayofyear(d) AS INTEGER) AS day_of_year,
       CAST(weekofyear(d) AS INTEGER) AS week_number,
       CAST(weekofyear({week_of('d')}) AS INTEGER) AS start_of_week_week_number,
       {WEEK_LABEL.format(w=week_of('d'))} AS start_of_week_week_number_reconciled
FROM days"""


def more() -> dict[str, str]:
    q: dict[str, str] = {}
    wo = metric_sql("observations", "week")
    wu = metric_sql("users", "week")
    ws = metric_sql("species", "week")
    q["weekly_by_species"] = weekly_by_species_sql()
    q["observation_fact"] = with_obs(f""", fu AS (
  SELECT user_id, min(observed_on) AS d, min({week_of('observed_on')}) AS w FROM obs GROUP BY user_id),
ft AS (
  SELECT taxon_id, min(observed_on) AS d, min({week_of('observed_on')}) AS w FROM obs GROUP BY taxon_id)
SELECT o.observed_on AS observed_date, {week_of('o.observed_on')} AS observed_week,
       coalesce(o.time_observed_at, CAST(o.observed_on AS TIMESTAMP)) AS time_observed_at,
       o.id, o.taxon_id, o.user_id, o.common_name, o.scientific_name,
       ft.d AS first_taxon_date, ft.w AS first_taxon_week, fu.d AS first_user_date, fu.w AS first_user_week
FROM obs o LEFT JOIN fu ON fu.user_id = o.user_id LEFT JOIN ft ON ft.taxon_id = o.taxon_id""").replace(
        f"{OBS}\n, fu", f"{OBS}, fu")
    q["count_audit"] = with_obs("""SELECT 'year' AS scope, CAST(year(observed_on) AS INTEGER) AS year,
       count(*) AS total_count, count(DISTINCT id) AS distinct_id_count
FROM obs GROUP BY year(observed_on)
UNION ALL
SELECT 'all', NULL, count(*), count(DISTINCT id) FROM obs""")
    raw = with_obs(f"SELECT {RAW} FROM obs")
    for k in ("read_observations_csv", "project_required", "validate_columns", "save_table", "table_or_empty"):
        q[k] = raw
    q["union_files"] = with_obs(f"""SELECT {RAW} FROM obs WHERE observed_on < DATE '1999-01-01'
UNION ALL
SELECT {RAW} FROM obs WHERE observed_on >= DATE '1998-01-01'""")
    audit_cols = f"""count(*) AS rows,
       count(*) FILTER (WHERE id IS NULL) AS null_ids,
       count(*) FILTER (WHERE observed_on < DATE '1900-01-01' OR observed_on > {AS_OF}) AS out_of_range_dates,
       count(*) FILTER (WHERE observed_on IS NULL) AS null_dates,
       count(*) FILTER (WHERE user_id IS NULL) AS null_users,
       count(*) FILTER (WHERE taxon_id IS NULL) AS null_taxa"""
    q["load_audit"] = with_obs(f"""SELECT 'lineitem.parquet' AS source_file, {audit_cols}, false AS is_total FROM obs
UNION ALL
SELECT NULL, {audit_cols}, true FROM obs""")
    q["write_metrics"] = "\nUNION ALL BY NAME\n".join(
        f"SELECT *, '{name}' AS metric_table FROM ({sql})"
        for name, sql in (("users", wu), ("species", ws), ("observations", wo), ("by_species", weekly_by_species_sql())))
    q["read_metrics"] = weekly_by_species_sql()
    q["read_api_pages"] = with_obs(
        "SELECT id // 200 AS page, id, strftime(observed_on, '%Y-%m-%d') AS observed_on, user_id, taxon_id FROM obs")
    q["rename_date"] = with_obs("SELECT id, observed_on AS observed_date, user_id, taxon_id FROM obs")
    q["week_of"] = with_obs(f"SELECT id, observed_on AS observed_date, {week_of('observed_on')} AS observed_week FROM obs")
    q["observed_at_fill"] = with_obs(
        "SELECT id, observed_on AS observed_date, coalesce(time_observed_at, CAST(observed_on AS TIMESTAMP)) "
        "AS time_observed_at FROM obs")
    q["name_in_list"] = with_obs(
        f"SELECT id, taxon_id, scientific_name, observed_on FROM obs WHERE lower(scientific_name) IN {TRACKED}")
    q["as_of_filter"] = metric_sql("observations", "week", "DATE '1999-06-30'")
    q["min_year_filter"] = f"SELECT * FROM ({yoy_sql()}) WHERE year >= 1998"
    q["single_name_filter"] = f"SELECT * FROM ({yoy_species_sql()}) WHERE lower(scientific_name) = 'small widget'"
    q["typed_metrics"] = wu
    q["zero_fill"] = f"""WITH {OBS}, {BOUNDS}, {DAYS}, {period_cal('week')},
u AS (SELECT {week_of('observed_on')} AS week, count(DISTINCT user_id) AS n FROM obs
      WHERE observed_on IS NOT NULL GROUP BY 1)
SELECT c.week, coalesce(u.n, 0) AS unique_users FROM calx c LEFT JOIN u ON u.week = c.week"""
    q["flatten_record"] = with_obs("""SELECT id, observed_on, time_observed_at, taxon_id, user_id, common_name,
       created_at, (user_id % 40 + 20) || ',' || (taxon_id % 60 - 120) AS location, scientific_name AS species_name,
       '{"type":"Point","coordinates":[' || (taxon_id % 60 - 120) || ',' || (user_id % 40 + 20) || ']}' AS geojson,
       'u-' || id AS uuid, scientific_name, taxon_kingdom_name, 'https://wiki.example/' || taxon_id AS wikipedia_url,
       CASE WHEN taxon_id % 5 = 0 THEN 'endangered' END AS status_name,
       CASE WHEN taxon_id % 3 = 0 THEN 'genus' ELSE 'species' END AS category,
       id % 11 = 0 AS spam, id % 13 = 0 AS hidden,
       '{"date":"' || strftime(created_at, '%Y-%m-%d') || '"}' AS created_at_details,
       'Place "' || (user_id % 7) || '", north' AS place_guess, quality_grade
FROM obs""")
    q["geometry_fields"] = with_obs("""SELECT id, 'Point' AS geometry_type,
       CAST(taxon_id % 60 - 120 AS DOUBLE) AS west, CAST(user_id % 40 + 20 AS DOUBLE) AS south,
       CAST(taxon_id % 60 - 120 AS DOUBLE) AS east, CAST(user_id % 40 + 20 AS DOUBLE) AS north,
       CAST(1 AS BIGINT) AS vertices
FROM obs""")
    q["year_of_date"] = with_obs(
        "SELECT id, observed_on AS observed_date, CAST(year(observed_on) AS INTEGER) AS year FROM obs")
    q["subtract_baseline"] = f"""WITH wo AS ({wo}),
s AS (SELECT week, year, cumulative_observations,
             first_value(cumulative_observations) OVER (PARTITION BY year ORDER BY week)
               AS starting_cumulative_observations
      FROM wo)
SELECT *, cumulative_observations - starting_cumulative_observations AS year_adjusted_cumulative_observations
FROM s"""
    q["drop_helper"] = f"""SELECT * EXCLUDE (helper) FROM (
  SELECT *, row_number() OVER (PARTITION BY year ORDER BY week) AS helper FROM ({COMBINED})) WHERE helper > 1"""
    q["attach_first_seen"] = f"""WITH {OBS},
fu AS (SELECT user_id, min(observed_on) AS d, min({week_of('observed_on')}) AS w FROM obs GROUP BY user_id),
ft AS (SELECT taxon_id, min(observed_on) AS d, min({week_of('observed_on')}) AS w FROM obs GROUP BY taxon_id)
SELECT o.id, o.user_id, o.taxon_id, o.observed_on,
       fu.d AS first_user_date, fu.w AS first_user_week, ft.d AS first_taxon_date, ft.w AS first_taxon_week
FROM obs o LEFT JOIN fu ON fu.user_id = o.user_id LEFT JOIN ft ON ft.taxon_id = o.taxon_id"""
    q["densify_calendar"] = f"""WITH {OBS}, {BOUNDS}, {DAYS}, {period_cal('week')},
u AS (SELECT {week_of('observed_on')} AS week, count(DISTINCT id) AS unique_observations FROM obs
      WHERE observed_on IS NOT NULL GROUP BY 1)
SELECT c.week, c.year, c.start_of_year, c.week_number, u.unique_observations
FROM calx c LEFT JOIN u ON u.week = c.week"""
    q["attach_unique"] = f"SELECT week, new_species, cumulative_species, unique_species FROM ({ws})"
    q["combine_metrics"] = COMBINED
    q["anti_new"] = f"""WITH {OBS}, {INCREMENT}
SELECT {OBSCOLS} FROM batch b WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.id = b.id)"""
    q["event_band"] = f"""WITH {OBS}, {events_cte()}, wo AS ({wo})
SELECT e.event, {week_of('e.start_date')} AS band_start, e.end_date AS band_end, w.week, w.unique_observations
FROM wo w JOIN evx e ON w.week >= {week_of('e.start_date')} AND w.week <= e.end_date"""
    q["first_seen"] = with_obs(f"""SELECT 'user' AS entity, user_id AS entity_id, min(observed_on) AS first_date,
       min({week_of('observed_on')}) AS first_week
FROM obs WHERE user_id IS NOT NULL AND observed_on IS NOT NULL GROUP BY user_id
UNION ALL
SELECT 'taxon', taxon_id, min(observed_on), min({week_of('observed_on')})
FROM obs WHERE taxon_id IS NOT NULL AND observed_on IS NOT NULL GROUP BY taxon_id""")
    q["new_per_period"] = with_obs(f""", f AS (
  SELECT 'u' AS k, min({week_of('observed_on')}) AS week FROM obs
  WHERE user_id IS NOT NULL AND observed_on IS NOT NULL GROUP BY user_id
  UNION ALL
  SELECT 't', min({week_of('observed_on')}) FROM obs
  WHERE taxon_id IS NOT NULL AND observed_on IS NOT NULL GROUP BY taxon_id)
SELECT week, count(*) FILTER (WHERE k = 'u') AS new_users, count(*) FILTER (WHERE k = 't') AS new_species
FROM f GROUP BY week""").replace(f"{OBS}\n, f AS", f"{OBS}, f AS")
    q["unique_per_period"] = with_obs(f"""SELECT {week_of('observed_on')} AS week, count(DISTINCT user_id) AS unique_users,
       count(DISTINCT taxon_id) AS unique_species
FROM obs WHERE observed_on IS NOT NULL GROUP BY 1""")
    q["observations_per_period"] = with_obs(
        f"SELECT {week_of('observed_on')} AS week, count(DISTINCT id) AS unique_observations FROM obs "
        "WHERE observed_on IS NOT NULL GROUP BY 1")
    q["observations_per_period_species"] = with_obs(f"""SELECT {week_of('observed_on')} AS week, taxon_id, scientific_name,
       min(common_name) AS common_name, count(DISTINCT id) AS observations
FROM obs WHERE lower(scientific_name) IN {TRACKED} AND observed_on IS NOT NULL GROUP BY 1, 2, 3""")
    q["total_vs_distinct"] = with_obs("SELECT count(*) AS total_count, count(DISTINCT id) AS distinct_id_count FROM obs")
    q["yearly_total_vs_distinct"] = with_obs("""SELECT CAST(year(observed_on) AS INTEGER) AS year,
       count(*) AS yearly_total_count, count(DISTINCT id) AS yearly_distinct_id_count
FROM obs GROUP BY 1 ORDER BY 1 DESC""")
    q["high_watermark"] = with_obs(f"SELECT max(created_at) AS max_created_at FROM obs WHERE created_at < {CUT}")
    q["page_stats"] = with_obs("""SELECT id // 200 AS page, min(id) AS min_id, max(id) AS max_id,
       max(created_at) AS max_created_at, count(*) AS n, max(id) - min(id) + 1 <> count(*) AS has_gap
FROM obs GROUP BY 1""")
    q["distinct_rows"] = with_obs(f"SELECT DISTINCT {week_of('observed_on')} AS observed_week, user_id FROM obs")
    q["running_total"] = with_obs(f""", u AS (
  SELECT {week_of('observed_on')} AS week, count(DISTINCT id) AS unique_observations FROM obs
  WHERE observed_on IS NOT NULL GROUP BY 1)
SELECT week, unique_observations,
       CAST(sum(unique_observations) OVER (ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
         AS cumulative_observations
FROM u""").replace(f"{OBS}\n, u AS", f"{OBS}, u AS")
    q["running_total_by_key"] = (
        f"SELECT taxon_id, scientific_name, week, observations, cumulative_observations FROM ({weekly_by_species_sql()})")
    q["year_start_value"] = f"""SELECT week, year, cumulative_users,
       first_value(cumulative_users) OVER (PARTITION BY year ORDER BY week) AS starting_cumulative_users
FROM ({wu})"""
    iso = metric_sql("observations", "week").replace(WEEK_LABEL.format(w="week"), "CAST(weekofyear(week) AS INTEGER)")
    q["keep_first_per_label"] = f"""SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY week_number, year ORDER BY week) AS rn FROM ({iso}))
WHERE rn = 1"""
    q["calendar"] = CAL_DAYS
    q["week_calendar"] = f"WITH {OBS}, {BOUNDS}, {DAYS}, {period_cal('week')} SELECT * FROM calx"
    q["day_calendar"] = f"WITH {OBS}, {BOUNDS}, {DAYS}, {period_cal('day')} SELECT * FROM calx"
    q["week_bounds"] = with_obs(f"""SELECT d AS date, {week_of('d')} AS week_start, {week_of('d')} + 6 AS week_end
FROM (SELECT DISTINCT observed_on AS d FROM obs WHERE observed_on IS NOT NULL)""")
    q["event_calendar"] = f"WITH {OBS}, {events_cte()} SELECT event, start_date, end_date FROM evx"
    place = "CAST(row_number() OVER (ORDER BY {}) AS INTEGER) AS place"
    q["sort_by_period"] = f"SELECT *, {place.format('week')} FROM ({wu}) ORDER BY week"
    newest = "year DESC NULLS LAST"
    q["sort_desc"] = f"SELECT *, {place.format(newest)} FROM ({q['count_audit']}) ORDER BY {newest}"
    q["preview_limit"] = f"SELECT * FROM ({wu}) ORDER BY week LIMIT 5"
    q["union_by_name"] = with_obs(f"""SELECT id, user_id, taxon_id, observed_on, created_at FROM obs WHERE created_at < {CUT}
UNION ALL
SELECT id, user_id, taxon_id, observed_on, created_at FROM obs WHERE created_at >= {CUT}""")
    q["yoy_metrics"] = yoy_sql()
    q["yoy_species"] = yoy_species_sql()
    q["metric_series"] = metric_series_sql()
    q["series_by_year"] = (
        f"SELECT year AS series_year, week_number, year_adjusted_cumulative_users FROM ({yoy_sql()})")
    q["species_series"] = species_series_sql()
    q["incremental_start"] = f"WITH {OBS}, {INCREMENT} SELECT start_at FROM start"
    q["select_increment"] = f"WITH {OBS}, {INCREMENT} SELECT {OBSCOLS} FROM batch"
    q["merge_insert_only"] = f"""WITH {OBS}, {INCREMENT},
dedup AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {DEDUP_ORDER}) AS rn FROM batch) WHERE rn = 1)
SELECT {OBSCOLS} FROM existing
UNION ALL
SELECT {OBSCOLS} FROM dedup d WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.id = d.id)"""
    return q


ORACLE.update(more())


# ---------------------------------------------------------------------------
# Participation and trends (events: the last weekend of April of every year).

EVENTS = f"WITH {OBS}, {events_cte()}"
PARTICIPANTS = """participants AS (
  SELECT event, user_id, bool_or(observed_on BETWEEN start_date AND end_date) AS participated
  FROM obs JOIN evx ON year(observed_on) = year(start_date) WHERE user_id IS NOT NULL GROUP BY 1, 2)"""


def segments_sql(what: str, key: str) -> str:
    def n(column: str, phase: str) -> str:
        return f"count(DISTINCT {column}) FILTER (WHERE {phase})"

    during, before, after = "observed_on BETWEEN start_date AND end_date", "observed_on < start_date", "observed_on > end_date"
    return f"""{EVENTS}, activity AS (
  SELECT event, user_id, {n('id', during)} + {n('taxon_id', during)} > 0 AS participated,
         {n(key, before)} AS b, {n(key, after)} AS a
  FROM obs JOIN evx ON year(observed_on) = year(start_date) WHERE user_id IS NOT NULL GROUP BY 1, 2)
SELECT event, participated, count(*) AS users, avg(b) AS avg_{what}_before, avg(a) AS avg_{what}_after
FROM activity GROUP BY 1, 2"""


YEARLY = """yearly AS (
  SELECT taxon_id, scientific_name, CAST(year(observed_on) AS INTEGER) AS year, count(DISTINCT id) AS n
  FROM obs WHERE observed_on IS NOT NULL AND taxon_id IS NOT NULL GROUP BY 1, 2, 3)"""


def trends() -> dict[str, str]:
    q: dict[str, str] = {}
    q["event_metrics"] = f"""{EVENTS}
SELECT event, start_date, end_date, count(DISTINCT user_id) AS unique_users, count(DISTINCT taxon_id) AS unique_species,
       count(DISTINCT id) AS unique_observations
FROM evx LEFT JOIN obs ON observed_on BETWEEN start_date AND end_date GROUP BY 1, 2, 3"""
    q["interval_hits"] = f"""{EVENTS}, spans AS (
  SELECT event, 'days' AS span, CAST(start_date AS TIMESTAMP) AS since, end_date + INTERVAL '23:59:59' AS until FROM evx
  UNION ALL SELECT event, 'season', start_date - INTERVAL 28 DAY + INTERVAL 12 HOUR, end_date + INTERVAL 28 DAY + INTERVAL 12 HOUR FROM evx
  UNION ALL SELECT event, 'after', CAST(end_date AS TIMESTAMP), end_date + INTERVAL 3 YEAR FROM evx)
SELECT event, span, count(*) AS observations, min(created_at) AS first_at, max(id) AS max_id
FROM obs JOIN spans ON created_at BETWEEN since AND until GROUP BY 1, 2"""
    q["event_participants"] = f"{EVENTS}, {PARTICIPANTS} SELECT * FROM participants"
    q["participation_activity"] = segments_sql("observations", "id")
    q["participation_species"] = segments_sql("species", "taxon_id")
    q["event_acquisition"] = f"""{EVENTS}, f AS (
  SELECT min(observed_on) AS d FROM obs WHERE user_id IS NOT NULL AND observed_on IS NOT NULL GROUP BY user_id)
SELECT CAST(year(d) AS INTEGER) AS year, event, count(*) AS new_users,
       count(*) FILTER (WHERE d BETWEEN start_date AND end_date) AS first_during,
       count(*) FILTER (WHERE d BETWEEN start_date - 7 AND end_date + 7) AS first_near
FROM f LEFT JOIN evx ON year(d) = year(start_date) GROUP BY 1, 2"""
    q["event_retention"] = f"""{EVENTS}, {PARTICIPANTS}
SELECT event, participated, CAST((observed_on - end_date - 1) // 7 AS INTEGER) AS week_after,
       count(DISTINCT user_id) AS active_users, count(DISTINCT id) AS observations
FROM obs JOIN evx ON observed_on > end_date AND observed_on <= end_date + 364
JOIN participants USING (event, user_id) GROUP BY 1, 2, 3"""
    q["yoy_lift"] = f"""WITH {OBS}, {YEARLY},
pairs AS (
  SELECT taxon_id, scientific_name, year, n AS c, 0 AS p FROM yearly
  UNION ALL SELECT taxon_id, scientific_name, year + 1, 0, n FROM yearly),
merged AS (SELECT taxon_id, scientific_name, year, CAST(sum(c) AS BIGINT) AS observations,
                CAST(sum(p) AS BIGINT) AS previous_observations FROM pairs GROUP BY 1, 2, 3)
SELECT *, observations - previous_observations AS lift,
       CASE WHEN previous_observations > 0
            THEN CAST(observations AS DOUBLE) / previous_observations END AS ratio,
       CAST(row_number() OVER (PARTITION BY year ORDER BY observations - previous_observations DESC, scientific_name,
                               taxon_id) AS INTEGER) AS lift_rank
FROM merged WHERE year > (SELECT min(year) FROM yearly) AND year <= (SELECT max(year) FROM yearly)
  AND greatest(observations, previous_observations) >= 2"""
    q["species_trend"] = f"""WITH {OBS}, {YEARLY}, fitted AS (
  SELECT taxon_id, scientific_name, count(*) AS years,
         round(regr_slope(CAST(n AS DOUBLE), CAST(year AS DOUBLE)), 9) + 0.0 AS slope
  FROM yearly GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT *, CASE WHEN slope = 0 THEN 'level' WHEN slope > 0 THEN 'increasing' ELSE 'declining' END AS trend FROM fitted"""
    q["species_share"] = with_obs("""SELECT *, CAST(observations AS DOUBLE) / sum(observations) OVER (PARTITION BY quarter) AS share
FROM (SELECT CAST(date_trunc('quarter', observed_on) AS DATE) AS quarter, taxon_id, scientific_name,
             count(DISTINCT id) AS observations
      FROM obs WHERE observed_on IS NOT NULL AND taxon_id IS NOT NULL GROUP BY 1, 2, 3)""")
    q["kingdom_totals"] = with_obs("SELECT taxon_kingdom_name, count(DISTINCT id) AS observations FROM obs GROUP BY 1")
    q["kingdom_by_period"] = with_obs("""SELECT CAST(date_trunc('month', observed_on) AS DATE) AS month, taxon_kingdom_name,
       count(DISTINCT id) AS observations FROM obs WHERE observed_on IS NOT NULL GROUP BY 1, 2""")
    q["rarest_species"] = with_obs("""SELECT *, rank() OVER (ORDER BY observations) AS rank
FROM (SELECT taxon_id, scientific_name, count(DISTINCT id) AS observations
FROM obs WHERE taxon_id IS NOT NULL GROUP BY 1, 2) ORDER BY 3, 2, 1""")
    q["quality_breakdown"] = with_obs("""SELECT *, CAST(100 * observations AS DOUBLE) / sum(observations) OVER () AS percentage
FROM (SELECT quality_grade, count(DISTINCT id) AS observations FROM obs GROUP BY 1)""")
    q["range_shift"] = f"""WITH {OBS}, p AS (
  SELECT taxon_id, scientific_name, CAST(year(observed_on) AS INTEGER) AS year,
         radians(user_id % 40 + 20) AS la, radians(taxon_id % 60 - 120) AS lo
  FROM obs WHERE observed_on IS NOT NULL),
c AS (SELECT taxon_id, scientific_name, year, count(*) AS located, avg(cos(la) * cos(lo)) AS x, avg(cos(la) * sin(lo)) AS y,
             avg(sin(la)) AS z FROM p GROUP BY 1, 2, 3),
g AS (SELECT taxon_id, scientific_name, year, located, atan2(z, sqrt(x * x + y * y)) AS la, atan2(y, x) AS lo FROM c),
l AS (SELECT *, lag(year) OVER w AS y0, lag(la) OVER w AS la0, lag(lo) OVER w AS lo0 FROM g
      WINDOW w AS (PARTITION BY taxon_id, scientific_name ORDER BY year))
SELECT taxon_id, scientific_name, year, located, round(degrees(la), 6) AS latitude, round(degrees(lo), 6) AS longitude,
       round(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin((la - la0) / 2), 2)
             + cos(la) * cos(la0) * pow(sin((lo - lo0) / 2), 2)))), 3) AS shift_km
FROM l WHERE y0 = year - 1"""
    adjusted = "first_value(cumulative_observations - unique_observations) OVER (PARTITION BY anchored_year ORDER BY week)"
    q["anchored_year"] = f"""WITH w AS (
  SELECT week, CAST(year(week - INTERVAL 3 MONTH) AS INTEGER) AS anchored_year, unique_observations, cumulative_observations
  FROM ({metric_sql('observations', 'week')}))
SELECT *, {adjusted} AS starting_cumulative_observations,
       cumulative_observations - {adjusted} AS year_adjusted_cumulative_observations
FROM w"""
    return q


ORACLE.update(trends())


STREAM_ORDER = ", ".join(
    f"{c} DESC NULLS LAST"
    for c in ["created_at", "observed_on", "time_observed_at", "taxon_id", "user_id", "common_name",
              "scientific_name", "taxon_kingdom_name", "quality_grade"]
)
ORACLE["stream_ingest"] = with_obs(f"""SELECT id, observed_on, user_id, taxon_id, created_at, scientific_name, quality_grade
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {STREAM_ORDER}) AS rn FROM obs) WHERE rn = 1""")
ORACLE["stream_latest"] = ORACLE["stream_ingest"]

ORACLE["species_refresh"] = ORACLE["weekly_by_species"]
ORACLE["metric_refresh"] = f"""SELECT * FROM ({ORACLE['weekly_users']}) JOIN ({ORACLE['weekly_species']})
USING (week, year, start_of_year, week_number) JOIN ({ORACLE['weekly_observations']}) USING (week, year, start_of_year, week_number)"""


def _rollup(grain: str) -> str:
    return f"""SELECT '{grain}' AS "grain", CAST(date_trunc('{grain}', observed_on) AS DATE) AS period,
       count(DISTINCT user_id) AS unique_users, count(DISTINCT taxon_id) AS unique_species,
       count(DISTINCT id) AS unique_observations, TRUE AS users_near, TRUE AS species_near, TRUE AS observations_near
FROM obs WHERE observed_on IS NOT NULL GROUP BY 2"""


ORACLE["rollup_uniques"] = with_obs(f"{_rollup('month')} UNION ALL {_rollup('year')}")
