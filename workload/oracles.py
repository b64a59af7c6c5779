"""SQL counterparts of the queries, written from the rules and not from the Spark code.

Squares are tested as ranges instead of by ray casting, neighbours by row and column distance.
"""

from __future__ import annotations

FOSSIL = "('211', '2121', '213111', '213112', '213113', '32411', '4861', '4862')"
EARLIER = "('2121', '211', '213', '23712', '486', '4247', '22112')"
COUNTY = "lpad(n_regionkey::VARCHAR, 2, '0') || lpad(n_nationkey::VARCHAR, 3, '0')"


def _title(s: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower({s}), '(\\p{{L}}+|\\P{{L}}+)'),"
        " lambda w: upper(w[1]) || w[2:]), '')"
    )


def _strip(s: str) -> str:
    return f"regexp_replace({s}, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g')"


def _place(key: str, shift: float = 0.0) -> tuple[str, str]:
    return f"({key} * 7919 % 56 - 3 + {shift})::DOUBLE", f"({key} * 104729 % 55 - 2 + {shift})::DOUBLE"


_MX, _MY = _place("o_orderkey")
_GX, _GY = _place("l_suppkey", 0.5)
_BX, _BY = _place("(c_custkey - c_custkey % 2)")

# Common table expressions, in order of dependency.
PARTS = {
    "states": """SELECT lpad(r_regionkey::VARCHAR, 2, '0') AS state_id_fips, r_name AS state_name,
        left(r_name, 2) AS state_abbr FROM region""",
    "counties": f"""SELECT {COUNTY} AS county_id_fips, n_name AS county_name, n_nationkey % 5 * 10 AS x0,
        n_nationkey // 5 * 10 AS y0, 10 AS side FROM nation""",
    "tracts": f"""SELECT {COUNTY} || lpad(s_suppkey::VARCHAR, greatest(6, length(s_suppkey::VARCHAR))::INT, '0') AS tract_id_fips,
        'Tract ' || s_suppkey AS tract_name, s_suppkey % 16 * 3 AS x0, s_suppkey // 16 * 3 AS y0, 3 AS side,
        s_suppkey % 16 AS cx, s_suppkey // 16 AS cy
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "tract_pairs": """SELECT a.tract_id_fips AS id, b.tract_id_fips AS other FROM tracts a JOIN tracts b
        ON b.cx BETWEEN a.cx - 1 AND a.cx + 1 AND b.cy BETWEEN a.cy - 1 AND a.cy + 1
        AND a.tract_id_fips <> b.tract_id_fips""",
    "county_pairs": """SELECT a.county_id_fips AS id, b.county_id_fips AS other FROM counties a JOIN counties b
        ON abs(a.x0 - b.x0) <= 10 AND abs(a.y0 - b.y0) <= 10 AND a.county_id_fips <> b.county_id_fips""",
    "mines": f"""SELECT o_orderkey AS mine_id,
          {_title("'o''hara-' || o_orderkey || ' ' || o_orderpriority")} AS current_mine_name,
          lpad((o_custkey % 1000)::VARCHAR, 3, '0') AS fips_cnty_cd, {_MY} AS latitude, {_MX} AS longitude,
          strftime(o_orderdate, '%Y-%m-%d') AS closed_on
        FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH')
          AND o_custkey % 3 <> 0 AND o_orderkey % 211 <> 0 AND o_orderkey % 101 <> 0 AND o_orderkey % 103 <> 0
          AND year(o_orderdate) >= 2000""",
    "generators_raw": f"""SELECT l_shipdate + INTERVAL 15 YEAR AS report_date, l_shipdate + INTERVAL 20 YEAR AS planned,
          l_linestatus = 'F' AS retired,
          (l_shipdate + INTERVAL 15 YEAR < DATE '2014-01-01' AND l_returnflag IN ('A', 'R'))
            OR (l_shipdate + INTERVAL 15 YEAR >= DATE '2014-01-01' AND l_linenumber % 3 IN (0, 2)) AS coal,
          {_GX} AS longitude, {_GY} AS latitude, l_suppkey AS plant_id_eia, l_partkey % 5 AS utility_id_eia,
          'G' || l_linenumber AS generator_id, 'Plant ' || l_suppkey AS plant_name_eia
        FROM lineitem WHERE l_suppkey % 37 <> 0""",
    "generators": """SELECT plant_id_eia, utility_id_eia, generator_id, any_value(plant_name_eia) AS plant_name_eia,
          any_value(latitude) AS latitude, any_value(longitude) AS longitude,
          strftime(max(report_date), '%Y-%m-%d') AS reported
        FROM generators_raw WHERE retired AND coal GROUP BY ALL""",
    "brownfields": f"""SELECT * FROM (SELECT {_title("'old mill-' || (c_custkey - c_custkey % 2) || ' site'")} AS site_name,
          'S' || c_nationkey AS state, CASE WHEN c_mktsegment <> 'MACHINERY' THEN lower(c_mktsegment) END AS program,
          CASE WHEN c_custkey % 5 <> 0 THEN abs(c_acctbal) END AS brownfield_acreage,
          lpad((c_custkey % 100000)::VARCHAR, 5, '0') AS zip_code, {_BX} AS longitude, {_BY} AS latitude
        FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_custkey % 97 <> 0 AND c_custkey % 89 <> 0)
        QUALIFY row_number() OVER (PARTITION BY site_name, latitude, longitude
          ORDER BY brownfield_acreage NULLS FIRST, program NULLS FIRST, state, zip_code) = 1""",
    "metro": f"""SELECT {COUNTY} AS county_id_fips, 'C' || lpad((n_regionkey * 100 + 18)::VARCHAR, 4, '0') AS msa_code,
        'Metro area ' || n_regionkey AS msa_name FROM nation WHERE n_nationkey % 3 = 0""",
    "non_metro": f"""SELECT {COUNTY} AS county_id_fips, lpad(n_regionkey::VARCHAR, 2, '0') AS state_id_fips,
          min((100000 + n_regionkey * 2 + s_suppkey % 2)::VARCHAR) AS msa_code,
          any_value('Region ' || n_regionkey || ' nonmetropolitan area') AS msa_name, n_name AS county_name
        FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 3 <> 0 AND n_nationkey % 7 <> 0
        GROUP BY ALL""",
    "county_areas": """SELECT county_id_fips, msa_code, msa_name FROM metro
        UNION ALL SELECT county_id_fips, msa_code, msa_name FROM non_metro""",
    "all_facts": f"""SELECT {COUNTY} AS county_id_fips, year(l_shipdate) AS year,
          CASE WHEN p_size = 1 AND p_type = 'ECONOMY' THEN '211' WHEN p_size = 2 AND p_type = 'STANDARD' THEN '2121'
               WHEN p_size = 3 AND p_type = 'STANDARD' THEN '22112' WHEN p_size > 25 THEN '10' ELSE '541' END AS industry_code,
          CASE WHEN l_linestatus = 'O' THEN 0 ELSE 5 END AS own_code,
          ((l_quantity - 1) * CASE WHEN p_size > 25 THEN 10 ELSE 1 END)::BIGINT AS annual_avg_emplvl
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
          JOIN nation ON s_nationkey = n_nationkey WHERE l_linenumber <> 7""",
    "facts": """SELECT msa_code, county_id_fips, msa_name AS area_title, year, industry_code, own_code, annual_avg_emplvl
        FROM all_facts JOIN county_areas USING (county_id_fips)
        WHERE annual_avg_emplvl <> 0 AND industry_code <> '541'""",
    "shares": f"""SELECT msa_code, year,
          CASE WHEN count(*) FILTER (industry_code = '10' AND own_code = 0) > 0
            THEN coalesce(sum(annual_avg_emplvl) FILTER (industry_code = '10' AND own_code = 0), 0) END::BIGINT AS total_employees,
          coalesce(sum(annual_avg_emplvl) FILTER (industry_code IN {FOSSIL}), 0)::BIGINT AS fossil_employees,
          array_to_string(list_sort(list(DISTINCT industry_code) FILTER (industry_code IN {FOSSIL})), ',') AS naics_code
        FROM facts GROUP BY ALL
        HAVING count(*) FILTER (industry_code IN {FOSSIL} OR (industry_code = '10' AND own_code = 0)) > 0""",
    "share_flags": """SELECT *, fossil_employees::DOUBLE / nullif(total_employees, 0)::DOUBLE AS percent_fossil_employment,
          CASE WHEN fossil_employees::DOUBLE / nullif(total_employees, 0)::DOUBLE > 0.0017::DOUBLE
                 OR (total_employees = 0 AND fossil_employees > 0) THEN 1 ELSE 0 END AS meets_fossil_employment_threshold
        FROM shares""",
    "county_shares": f"""SELECT c.msa_code, c.county_id_fips, c.year, c.area_title, c.county_id_fips AS geoid, total_employees,
          fossil_employees, naics_code, percent_fossil_employment, meets_fossil_employment_threshold
        FROM (SELECT DISTINCT msa_code, county_id_fips, year, area_title FROM facts WHERE industry_code IN ('10', {FOSSIL[1:-1]})) c
        LEFT JOIN share_flags s ON c.msa_code = s.msa_code AND c.year = s.year""",
    "county_unemployment": f"""SELECT county_id_fips, year, 'LAUCN' || county_id_fips || '0000000004' AS series_id,
          round_even(avg(v) FILTER (o_orderstatus = 'F') * 10, 0) / 10 AS total_unemployment,
          round_even(avg(v) FILTER (o_orderstatus = 'O') * 10, 0) / 10 AS total_labor_force
        FROM (SELECT {COUNTY} AS county_id_fips, year(o_orderdate) AS year, o_orderstatus,
            CASE o_orderstatus WHEN 'F' THEN trunc(o_totalprice)::BIGINT % 1000
              ELSE 10500 + trunc(o_totalprice)::BIGINT % 1000 END::DOUBLE AS v
          FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
          WHERE o_orderkey % 59 <> 0 AND o_orderkey % 53 <> 0 AND o_orderstatus IN ('F', 'O'))
        GROUP BY ALL HAVING total_unemployment IS NOT NULL""",
    "local_counties": "SELECT * FROM county_unemployment JOIN county_areas USING (county_id_fips)",
    "area_rates": """SELECT msa_code, year,
          floor(sum(total_unemployment) / nullif(coalesce(sum(total_labor_force), 0), 0) * 1000::DOUBLE)
            / 1000::DOUBLE * 100::DOUBLE AS local_area_unemployment_rate FROM local_counties GROUP BY ALL""",
    "local_rates": """SELECT c.*, local_area_unemployment_rate FROM local_counties c
        JOIN area_rates r ON c.msa_code = r.msa_code AND c.year = r.year""",
    "national": """SELECT year(o_orderdate) AS real_year,
          round_even(avg((o_orderkey % 10)::DOUBLE) * 10, 0) / 10 AS national_unemployment_rate,
          year(o_orderdate) + 1 AS applies_to_criteria_year
        FROM orders WHERE o_orderkey % 61 <> 0 GROUP BY ALL""",
    "unemployment": """SELECT county_id_fips AS geoid, msa_code, year, local_area_unemployment_rate, real_year,
          national_unemployment_rate,
          CASE WHEN local_area_unemployment_rate >= national_unemployment_rate THEN 1 ELSE 0 END AS meets_unemployment_threshold
        FROM local_rates LEFT JOIN national ON year = applies_to_criteria_year""",
    "employment": """SELECT county_name, q.county_id_fips, state_id_fips, state_abbr, state_name, geoid, site_name,
          'fossil_fuel_employment' AS qualifying_criteria, 'MSA or non-MSA' AS qualifying_area
        FROM (SELECT s.geoid, s.county_id_fips, arg_min(s.area_title, s.year) AS site_name FROM county_shares s
              WHERE meets_fossil_employment_threshold = 1 AND EXISTS (SELECT 1 FROM unemployment u
                WHERE u.geoid = s.geoid AND u.year = s.year AND meets_unemployment_threshold = 1) GROUP BY ALL) q
        LEFT JOIN counties c ON c.county_id_fips = q.county_id_fips
        LEFT JOIN states ON state_id_fips = left(q.county_id_fips, 2)""",
}


def _inside(area: str, x: str = "longitude", y: str = "latitude") -> str:
    return f"{x} BETWEEN {area}.x0 AND {area}.x0 + {area}.side AND {y} BETWEEN {area}.y0 AND {area}.y0 + {area}.side"


def _site_parts(level: str) -> dict[str, str]:
    table = {"county": "counties", "tract": "tracts"}[level]
    area = f"{level}_id_fips, {level}_name"
    parts = {}
    for name, site, label, where in (
        ("mines", "current_mine_name", "coalmine", level), ("generators", "plant_name_eia", "coal_plant", level),
        ("brownfields", "site_name", "brownfield", "point"),
    ):
        parts[f"{name}_{level}"] = f"""SELECT s.*, {area}, '{label}' AS qualifying_criteria, '{where}' AS qualifying_area
            FROM {name} s LEFT JOIN {table} a ON {_inside('a', 's.longitude', 's.latitude')}"""
    for name, label in (("mines", "coal_mine"), ("generators", "coal_plant")):
        parts[f"{name}_{level}_adjacent"] = f"""SELECT DISTINCT p.other AS {level}_id_fips, a.{level}_name,
              '{label}_adjacent_{level}' AS qualifying_criteria, '{level}' AS qualifying_area
            FROM (SELECT DISTINCT {level}_id_fips AS id FROM {name}_{level}) s
            LEFT JOIN {level}_pairs p USING (id) LEFT JOIN {table} a ON a.{level}_id_fips = p.other"""
    sites = " UNION ALL ".join(
        f"SELECT {area}, {site} AS site_name, qualifying_criteria, qualifying_area, latitude, longitude FROM {name}_{level}"
        for name, site in (("mines", "current_mine_name"), ("generators", "plant_name_eia"))
    )
    near = " UNION ALL ".join(
        f"SELECT {area}, NULL, qualifying_criteria, qualifying_area, NULL, NULL FROM {name}_{level}_adjacent"
        for name in ("mines", "generators")
    )
    brown = f"SELECT {area}, site_name, qualifying_criteria, qualifying_area, latitude, longitude FROM brownfields_{level}"
    for rule, body in ((f"coal_{level}", f"{sites} UNION ALL {near}"), (f"brownfield_{level}", brown)):
        if level == "tract":
            parts[rule] = f"""SELECT tract_name, tract_id_fips, county_name, left(tract_id_fips, 5) AS county_id_fips,
                left(tract_id_fips, 2) AS state_id_fips, state_abbr, state_name, tract_id_fips AS geoid, site_name,
                qualifying_criteria, qualifying_area, latitude, longitude FROM ({body}) b
                LEFT JOIN states s ON s.state_id_fips = left(tract_id_fips, 2)
                LEFT JOIN counties c ON c.county_id_fips = left(tract_id_fips, 5)"""
        else:
            parts[rule] = f"""SELECT county_name, county_id_fips, left(county_id_fips, 2) AS state_id_fips, state_abbr,
                state_name, county_id_fips AS geoid, site_name, qualifying_criteria, qualifying_area, latitude, longitude
                FROM ({body}) b LEFT JOIN states s ON s.state_id_fips = left(county_id_fips, 2)"""
    return parts


PARTS |= _site_parts("county") | _site_parts("tract")
PARTS["all_rules"] = """SELECT * FROM coal_tract UNION ALL BY NAME SELECT * FROM brownfield_tract
    UNION ALL BY NAME SELECT * FROM employment"""
# Sums of cents are exact in decimals, so the half cents of the median fill round the same everywhere.
PARTS["acreage"] = """SELECT county_id_fips, round_even(known * 100, 0) / 100 AS brownfield_acreage,
      round_even((known + missing * (SELECT sum(brownfield_acreage::DECIMAL(18, 2))::DOUBLE / count(brownfield_acreage)
        FROM brownfields_county)) * 100, 0) / 100 AS brownfield_acreage_mean_fill,
      round_even((known + missing * (SELECT median(brownfield_acreage) FROM brownfields_county)) * 100, 0) / 100
        AS brownfield_acreage_median_fill
    FROM (SELECT county_id_fips, coalesce(sum(brownfield_acreage::DECIMAL(18, 2)), 0)::DOUBLE AS known,
        count(*) FILTER (brownfield_acreage IS NULL) AS missing
      FROM brownfields_county WHERE county_id_fips IS NOT NULL GROUP BY ALL)"""


def _utm_sql(source: str, keys: str) -> dict[str, str]:
    """Corner projection and shoelace for quadrilaterals given as corner rows ``k, lon, lat``."""
    n = "0.001679220394628745::DOUBLE"
    alpha = [
        f"({n}/2 - 2*{n}**2/3 + 5*{n}**3/16 + 41*{n}**4/180 - 127*{n}**5/288 + 7891*{n}**6/37800)",
        f"(13*{n}**2/48 - 3*{n}**3/5 + 557*{n}**4/1440 + 281*{n}**5/630 - 1983433*{n}**6/1935360)",
        f"(61*{n}**3/240 - 103*{n}**4/140 + 15061*{n}**5/26880 + 167603*{n}**6/181440)",
        f"(49561*{n}**4/161280 - 179*{n}**5/168 + 6601661*{n}**6/7257600)",
    ]
    east = " + ".join(f"{a} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    north = " + ".join(f"{a} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    e = "0.08181919104281579::DOUBLE"
    return {
        "sphere": f"""SELECT {keys}, k, atan2(tp, cos(lam)) AS xi, asinh(sin(lam) / sqrt(tp * tp + cos(lam) ** 2)) AS eta
            FROM (SELECT *, t * sqrt(1 + s * s) - s * sqrt(1 + t * t) AS tp
              FROM (SELECT *, sinh({e} * atanh({e} * t / sqrt(1 + t * t))) AS s
                FROM (SELECT {keys}, k, radians(lon + 99) AS lam, tan(radians(lat)) AS t FROM {source})))""",
        "plane": f"""SELECT {keys}, k, 6364902.1661127405 * (eta + {east}) AS x, 6364902.1661127405 * (xi + {north}) AS y
            FROM sphere""",
        "areas": f"""SELECT {keys}, abs(sum(x * ny - nx * y)) / 2 AS area FROM (SELECT a.*, b.x AS nx, b.y AS ny FROM plane a
            JOIN plane b USING ({keys}) WHERE b.k = (a.k + 1) % 4) GROUP BY ALL""",
    }


def _corners(table: str, keys: str, x0: str, y0: str, side: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, {k} AS k, ({x0} + {dx} * {side})::DOUBLE AS lon, ({y0} + {dy} * {side})::DOUBLE AS lat FROM {table}"
        for k, (dx, dy) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])
    )


def _with(final: str, *extra: tuple[str, str]) -> str:
    """Prefix the parts the statement needs, directly or through other parts."""
    import re

    bodies = PARTS | dict(extra)
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in bodies:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
                visit(bodies[name])
                if name not in needed:
                    needed.append(name)

    visit(final)
    if not needed:
        return final
    return "WITH " + ",\n".join(f"{n} AS ({bodies[n]})" for n in needed) + "\n" + final


ORACLES: dict[str, str] = {}


def _add(name: str, final: str, *extra: tuple[str, str]) -> None:
    ORACLES[name] = _with(final, *extra)


_add("clean_codes", """SELECT c_custkey, lpad(c_nationkey::VARCHAR, 5, '0') AS county,
    CASE WHEN length(c_custkey::VARCHAR) < 3 THEN lpad(c_custkey::VARCHAR, 3, '0') ELSE c_custkey::VARCHAR END AS never_cut,
    CASE WHEN length('LAU' || c_custkey) < 8 THEN rpad('LAU' || c_custkey, 8, '0') ELSE 'LAU' || c_custkey END AS filled_right,
    'CN' AS area_type, '0' || (c_custkey % 4 + 3) AS measure, lpad(c_nationkey::VARCHAR, 5, '0') AS series_county, '00' AS state
    FROM customer""")
_name = "p_name || '-o''' || p_brand || ' 3rd'"
_add("title_case_names", f"SELECT p_partkey, {_title(_name)} AS title FROM part")
_add("strip_lower_text", f"SELECT conv_id, turn, lower({_strip('role')}) AS role, lower({_strip('text')}) AS text FROM conversations")
_add("coerce_numeric", """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN value
    WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN NULL ELSE value END AS number FROM events""")
_add("header_normalise", """SELECT o_orderkey, o_custkey AS cust_key, o_orderstatus AS state, o_totalprice AS price,
    o_orderpriority AS priority FROM orders""")
_add("typed_rejects", """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 10 = 0 THEN 'cust' END,
    CASE WHEN o_orderkey % 15 = 0 THEN 'day' END) AS rejected FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 15 = 0""")
_add("null_safe_exclusion", """SELECT event_id, nullif(event_type, 'view') AS program FROM events
    WHERE nullif(event_type, 'view') IS DISTINCT FROM 'click'""")
_add("latlon_filter", """SELECT * FROM (SELECT c_custkey,
      CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey % 200 - 100)::DOUBLE END AS latitude,
      CASE WHEN c_custkey % 13 <> 0 THEN (c_custkey % 401 - 200)::DOUBLE END AS longitude FROM customer)
    WHERE (latitude IS NULL OR latitude BETWEEN -90 AND 90) AND (longitude IS NULL OR longitude BETWEEN -180 AND 180)""")
_add("closure_predicate", "SELECT * FROM mines")
_add("keep_latest", """SELECT plant_id_eia, utility_id_eia, generator_id, latitude, longitude, reported FROM generators""")
_add("planned_retirements", """SELECT plant_id_eia, utility_id_eia, generator_id,
    strftime(max(report_date), '%Y-%m-%d') AS reported FROM generators_raw
    WHERE planned > TIMESTAMP '2018-06-30' AND coal GROUP BY ALL""")
_add("keep_first", """SELECT event_id, user_id, event_type FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")
_add("keep_highest_label", """SELECT o_custkey, o_orderpriority, o_orderkey FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_orderkey) = 1""")
_add("metro_crosswalk", """SELECT CASE WHEN length(c_custkey::VARCHAR) < 5 THEN lpad(c_custkey::VARCHAR, 5, '0')
      ELSE c_custkey::VARCHAR END AS county_id_fips, 'C' || lpad(c_nationkey::VARCHAR, 4, '0') AS msa_code,
    c_mktsegment AS msa_name, c_name AS county_name, 'Metro' AS msa_type FROM customer WHERE c_acctbal > 0""")
_add("crosswalk_anti", "SELECT county_id_fips, state_id_fips, msa_code, msa_name, county_name FROM non_metro")
_add("crosswalk_join", "SELECT * FROM facts")
_add("outer_indicator", """SELECT coalesce(l.key, o.key) AS key, quantity, n_orders,
      CASE WHEN l.key IS NULL THEN 'right_only' WHEN o.key IS NULL THEN 'left_only' ELSE 'both' END AS indicator
    FROM (SELECT if(l_orderkey % 5 = 0, -l_orderkey, l_orderkey) AS key, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL) l
    FULL JOIN (SELECT o_orderkey AS key, count(*) AS n_orders FROM orders GROUP BY ALL) o
      ON l.key = o.key""")
_add("hot_key_join", """SELECT o_orderkey, o_custkey AS custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey""")
_add("annual_mean_half_even", """SELECT o_custkey, year(o_orderdate) AS year,
    round_even(avg(floor(o_totalprice)) * 10, 0) / 10 AS mean_price FROM orders GROUP BY ALL""")
_add("national_rate", "SELECT * FROM national")
_add("unemployment_area_table", """SELECT *, substr(area_code, 3, 2) AS state_id_fips,
      rpad('LAU' || left(area_code, 10), 18, '0') AS series_id,
      CASE WHEN area_type_code = 'B' THEN 'C' || substr(area_code, 5, 4) END AS msa_code,
      CASE WHEN area_type_code = 'F' THEN substr(area_code, 3, 5) END AS county_id_fips
    FROM (SELECT CASE c_custkey % 3 WHEN 1 THEN 'F' ELSE 'B' END AS area_type_code,
      CASE c_custkey % 3 WHEN 1 THEN 'CN' ELSE 'MT' END || lpad(c_nationkey::VARCHAR, 2, '0')
        || lpad((c_custkey % 100000)::VARCHAR, 5, '0') || '000000' AS area_code, c_name AS area_text
      FROM customer WHERE c_custkey % 3 <> 0)""")
_add("code_share_flag", "SELECT * FROM county_shares")
_scenario = """SELECT '{name}' AS scenario, msa_code, year,
      CASE WHEN count(*) FILTER (industry_code = '10' AND own_code = 0) > 0 THEN coalesce(sum(annual_avg_emplvl)
        FILTER (industry_code = '10' AND own_code = 0), 0) END::BIGINT AS total_employees,
      coalesce(sum(annual_avg_emplvl) FILTER (industry_code IN {codes}), 0)::BIGINT AS fossil_employees
    FROM facts GROUP BY ALL HAVING count(*) FILTER (industry_code IN {codes} OR (industry_code = '10' AND own_code = 0)) > 0"""
_scenarios = " UNION ALL ".join(
    _scenario.format(name=name, codes=codes)
    for name, codes in (
        ("current", FOSSIL), ("earlier", EARLIER), ("current_and_power", FOSSIL[:-1] + ", '22112')"),
    )
)
_add("scenario_shares", """SELECT *, fossil_employees::DOUBLE / nullif(total_employees, 0)::DOUBLE AS percent_fossil_employment,
      CASE WHEN fossil_employees::DOUBLE / nullif(total_employees, 0)::DOUBLE > 0.0017::DOUBLE
        OR (total_employees = 0 AND fossil_employees > 0) THEN 1 ELSE 0 END AS meets_fossil_employment_threshold
    FROM scenario_rows""", ("scenario_rows", _scenarios))
_add("local_rate", """SELECT county_id_fips, msa_code, msa_name, year, series_id, total_unemployment, total_labor_force,
    local_area_unemployment_rate FROM local_rates""")
_add("national_prior_year", "SELECT * FROM unemployment")
_add("employment_rule", "SELECT * FROM employment")

_cx, _cy = _place("c_custkey")
_add("site_area_join", f"""SELECT c_custkey, longitude, latitude, county_id_fips, county_name
    FROM (SELECT c_custkey, {_cx} AS longitude, {_cy} AS latitude FROM customer) s
    LEFT JOIN counties a ON {_inside('a')}""")
# Matches and unmatched points apart: as one LEFT JOIN with this residual condition the SQL engine
# adds empty rows for matched points on larger tables (a plain count over all pairs shows it).
_add("site_area_join_shaped", """SELECT o_orderkey, s_suppkey FROM hits UNION ALL
    SELECT o_orderkey, NULL FROM points WHERE o_orderkey NOT IN (SELECT o_orderkey FROM hits)""",
     ("points", """SELECT o_orderkey, o_orderkey * 7919 % 103 / 2::DOUBLE - 1 AS px,
        o_orderkey * 104729 % 151 / 2::DOUBLE - 1 AS py FROM orders"""),
     ("hits", """SELECT o_orderkey, s_suppkey FROM points
        JOIN (SELECT s_suppkey, s_suppkey % 16 * 3 AS x, s_suppkey // 16 * 3 AS y, s_suppkey % 3 AS kind FROM supplier) a
        ON px BETWEEN x AND x + 3 AND py BETWEEN y AND y + 3
        AND (kind = 0 OR (kind = 1 AND (px <= x + 1 OR py <= y + 1))
          OR (kind = 2 AND NOT (px > x + 1 AND px < x + 2 AND py > y + 1 AND py < y + 2)))"""))
_add("adjacency", "SELECT id AS tract_id_fips, other AS adjacent_tract_id_fips FROM tract_pairs")
_add("neighbour_lists", """SELECT mine_id, tract_id_fips, neighbours FROM mines_tract LEFT JOIN
    (SELECT t.tract_id_fips, coalesce(string_agg(other, ',' ORDER BY other), '') AS neighbours FROM tracts t
     LEFT JOIN tract_pairs ON id = t.tract_id_fips GROUP BY ALL) USING (tract_id_fips)""")
_add("area_names", """SELECT tract_id_fips, tract_name, left(tract_id_fips, 5) AS county_id_fips, county_name,
      left(tract_id_fips, 2) AS state_id_fips, state_name, state_abbr FROM tracts
    LEFT JOIN states s ON s.state_id_fips = left(tract_id_fips, 2)
    LEFT JOIN counties c ON c.county_id_fips = left(tract_id_fips, 5)""")
_area = "CASE s_suppkey % 3 WHEN 0 THEN 9 WHEN 1 THEN 5 ELSE 8 END::DOUBLE"
_add("area_share", f"SELECT s_suppkey, {_area} AS area, {_area} / 9 AS share FROM supplier")
_add("utm_area", "SELECT s_suppkey, round_even(area / 10000, 0) AS hectares FROM areas",
     ("corners", _corners("supplier", "s_suppkey", "(-101 + s_suppkey % 40 * 0.1::DOUBLE)",
                          "(30 + s_suppkey // 40 % 150 * 0.1::DOUBLE)", "0.1::DOUBLE")),
     *_utm_sql("corners", "s_suppkey").items())

_PLACE = "latitude, longitude, qualifying_criteria, qualifying_area"
_add("mines_located", f"SELECT mine_id, current_mine_name, tract_id_fips, tract_name, {_PLACE} FROM mines_tract")
_add("generators_located", f"""SELECT plant_id_eia, utility_id_eia, generator_id, county_id_fips, county_name, {_PLACE}
    FROM generators_county""")
_add("brownfields_located", f"""SELECT site_name, state, program, brownfield_acreage, county_id_fips, county_name, {_PLACE}
    FROM brownfields_county""")
_add("adjacent_records", "SELECT * FROM mines_tract_adjacent")
_add("coal_rule_tract", "SELECT * FROM coal_tract")
_add("coal_rule_county", "SELECT * FROM coal_county")
_add("brownfield_rule", "SELECT * FROM brownfield_tract")
_add("all_rules", "SELECT * FROM all_rules")

_features = """SELECT geoid, CASE max(r) WHEN 1 THEN 'primary' ELSE 'adjacent' END AS primary_or_adj FROM
    (SELECT tract_id_fips AS geoid, 1 AS r FROM {t} UNION ALL
     SELECT other, 0 FROM tract_pairs WHERE id IN (SELECT tract_id_fips FROM {t}))
    WHERE geoid IS NOT NULL GROUP BY ALL"""
_add("feature_priority", _features.format(t="mines_tract"))
_add("feature_combined", """SELECT geoid, max(label) AS primary_or_adj FROM
    (SELECT geoid, primary_or_adj || '_mine' AS label FROM mine_features
     UNION ALL SELECT geoid, primary_or_adj || '_gen' FROM generator_features) GROUP BY ALL""",
     ("mine_features", _features.format(t="mines_tract")), ("generator_features", _features.format(t="generators_tract")))
_add("acreage_three_ways", "SELECT * FROM acreage")
_add("exact_median", "SELECT median(l_extendedprice) AS median FROM lineitem")
_add("county_report", """SELECT b.county_id_fips, b.county_name, b.state_name, num_brownfields,
      coalesce(brownfield_acreage, 0) AS brownfield_acreage,
      coalesce(brownfield_acreage_mean_fill, 0) AS brownfield_acreage_mean_fill,
      coalesce(brownfield_acreage_median_fill, 0) AS brownfield_acreage_median_fill,
      coalesce(n_tracts, 0) AS num_coal_qualifying_tracts,
      coalesce(round_even(tract_area / ca.area * 100, 0) / 100, 0) AS percent_of_county_coal_qualified,
      qualifies_by_employment_criteria
    FROM (SELECT county_id_fips, min(county_name) AS county_name, min(state_name) AS state_name,
        count(*) FILTER (qualifying_criteria = 'brownfield') AS num_brownfields,
        bool_or(qualifying_criteria = 'fossil_fuel_employment') AS qualifies_by_employment_criteria
      FROM all_rules WHERE county_id_fips IS NOT NULL GROUP BY ALL) b
    LEFT JOIN acreage a ON a.county_id_fips = b.county_id_fips
    LEFT JOIN (SELECT county_id_fips, count(*) AS n_tracts, sum(area) AS tract_area FROM
        (SELECT DISTINCT county_id_fips, tract_id_fips FROM coal_tract WHERE county_id_fips IS NOT NULL) d
        LEFT JOIN areas t ON t.id = d.tract_id_fips GROUP BY ALL) c ON c.county_id_fips = b.county_id_fips
    LEFT JOIN areas ca ON ca.id = b.county_id_fips""",
     ("corners", _corners("tracts", "tract_id_fips AS id", "x0", "y0", "side") + " UNION ALL "
      + _corners("counties", "county_id_fips AS id", "x0", "y0", "side")),
     *_utm_sql("corners", "id").items())

_add("duplicate_keys", """SELECT o_custkey, year(o_orderdate) AS year, count(*) AS n_rows FROM orders
    GROUP BY ALL HAVING count(*) > 1""")
_add("unmatched_keys", """SELECT if(l_orderkey % 7 = 0, -l_orderkey, l_orderkey) AS key FROM lineitem
    EXCEPT SELECT o_orderkey FROM orders""")
_add("unmatched_counties", f"""SELECT DISTINCT county_id_fips FROM all_facts WHERE annual_avg_emplvl <> 0
    AND industry_code IN ('10', {FOSSIL[1:-1]}) AND county_id_fips NOT IN (SELECT county_id_fips FROM county_areas)""")

_add("mines_text", "SELECT mine_id, current_mine_name, fips_cnty_cd, latitude, longitude FROM mines")
_add("unemployment_tabs", "SELECT county_id_fips, year, total_unemployment, total_labor_force FROM county_unemployment")
_add("crosswalk_csv", """SELECT CASE WHEN length(c_custkey::VARCHAR) < 5 THEN lpad(c_custkey::VARCHAR, 5, '0')
    ELSE c_custkey::VARCHAR END AS county_id_fips, 'Cañón, ' || c_name AS msa_name FROM customer""")
_add("definitions_csv", "SELECT county_id_fips, msa_code, msa_name FROM non_metro")
_add("yearly_partitions", f"""SELECT county_id_fips, year, industry_code, own_code, annual_avg_emplvl FROM all_facts
    WHERE year IN (1996, 1998) AND annual_avg_emplvl <> 0 AND industry_code IN ('10', {FOSSIL[1:-1]})""")
_add("zipped_members", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
_add("nested_series", """SELECT 'S' || user_id AS series_id, year(ts)::VARCHAR AS year, period, count(*) AS n,
      sum(v)::BIGINT AS total FROM (SELECT user_id, ts, strftime(ts, 'M%m') AS period, event_id % 90 AS v FROM events
      UNION ALL SELECT user_id, ts, 'M13', 0 FROM events) GROUP BY ALL""")
_add("generators_table", """SELECT strftime(l_shipdate + INTERVAL 15 YEARS, '%Y-%m-%d') AS reported,
    CASE l_returnflag WHEN 'A' THEN 'BIT' WHEN 'R' THEN 'SUB' ELSE 'NG' END AS energy_source_code_1,
    CASE l_linenumber % 3 WHEN 0 THEN 'Conventional Steam Coal' WHEN 1 THEN 'Natural Gas Fired'
      ELSE 'Coal Integrated Gasification Combined Cycle' END AS technology_description,
    if(l_linestatus = 'F', 'retired', 'existing') AS operational_status, l_suppkey AS plant_id_eia,
    l_partkey % 5 AS utility_id_eia, 'G' || l_linenumber AS generator_id, 'Plant ' || l_suppkey AS plant_name_eia FROM lineitem""")
_add("brownfields_gzip", "SELECT site_name, latitude, longitude, zip_code, brownfield_acreage FROM brownfields")
_add("area_titles_csv", "SELECT lpad(s_suppkey::VARCHAR, 5, '0') AS area_fips, s_name || ', \"A\"' AS area_title FROM supplier")
_add("area_layers", f"""SELECT lpad(s_suppkey::VARCHAR, 12, '0') AS tract_id_fips, 'Tract ' || s_suppkey AS tract_name,
    {_area} AS area, CASE s_suppkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 6 ELSE 8 END AS n_edges FROM supplier""")
_add("result_sink", """SELECT site_name, geoid, qualifying_criteria, latitude, longitude FROM brownfield_county""")

_add("site_area_join_many_vertices", """SELECT o_orderkey, n_nationkey FROM hits UNION ALL
    SELECT o_orderkey, NULL FROM points WHERE o_orderkey NOT IN (SELECT o_orderkey FROM hits)""",
     ("points", """SELECT o_orderkey, o_orderkey * 7919 % 8051 / 4::DOUBLE - 5 AS px,
        o_orderkey * 104729 % 1031 / 4::DOUBLE - 2 AS py FROM orders"""),
     ("hits", """SELECT o_orderkey, n_nationkey FROM points JOIN nation ON px BETWEEN 0 AND 2000
        AND py BETWEEN n_nationkey * 10 AND n_nationkey * 10 + 5 + if(px % 2 <= 1, px % 2, 2 - px % 2)"""))


def _hash(text: str, digits: int) -> str:
    return f"('0x' || substr(md5({text}), 1, {digits}))::BIGINT"


def _corner(k: int) -> str:
    return f"(x0 + {(0, 1, 1, 0, 0)[k]} * side)::DOUBLE || ' ' || (y0 + {(0, 0, 1, 1, 0)[k]} * side)::DOUBLE"


_ring = " || ',' || ".join(_corner(k) for k in range(5))
_hashed = " UNION ALL ".join(
    f"SELECT '{level}' AS layer, {_hash(level + '_id_fips || chr(35) || ' + _ring, 15)} AS h FROM {t}"
    for level, t in (("county", "counties"), ("tract", "tracts"))
)
_add("layer_fingerprint", "SELECT layer, count(*) AS n, sum(h)::VARCHAR AS total, bit_xor(h) AS mixed FROM hashed GROUP BY ALL",
     ("hashed", _hashed))
_add("area_crs", "SELECT 'tract' AS level, count(*) AS n, 'EPSG:4269' AS crs, 'EPSG:4269' AS accepted FROM tracts")
_add("exact_sums", """SELECT l_suppkey, sum(l_partkey % 1000)::DOUBLE / 137438953472::DOUBLE AS total,
    (count(*) + count(*) FILTER (l_partkey % 1000 > 0))::BIGINT AS n FROM lineitem GROUP BY ALL""")
_shape = f"""1 AS n_rings, 4 AS n_edges, 9::DOUBLE AS area, x0::DOUBLE AS min_x, y0::DOUBLE AS min_y, (x0 + 3)::DOUBLE AS max_x,
    (y0 + 3)::DOUBLE AS max_y, ({' + '.join(_hash(_corner(k), 12) for k in range(4))})::BIGINT AS vertices"""
_add("feature_geometry", f"""SELECT f.*, {_shape} FROM mine_features f JOIN tracts ON tract_id_fips = geoid""",
     ("mine_features", _features.format(t="mines_tract")))
_add("coal_rule_geometry", """SELECT geoid, qualifying_criteria, longitude AS site_x, latitude AS site_y, n_rings, n_edges, area,
    min_x, min_y, max_x, max_y, vertices FROM coal_tract LEFT JOIN shapes s ON s.id = geoid""",
     ("shapes", f"SELECT tract_id_fips AS id, {_shape} FROM tracts"))
_add("load_rejects", """SELECT 'mines' AS source, 'current_status_dt' AS "column", 'unknown' AS raw, count(*) AS n
      FROM orders WHERE o_orderkey % 211 = 0 HAVING count(*) > 0
    UNION ALL SELECT 'facts', 'year', 'n/a', count(*) FROM lineitem WHERE l_orderkey % 97 = 0 HAVING count(*) > 0
    UNION ALL SELECT 'facts', 'annual_avg_emplvl', '1,234', count(*) FROM lineitem WHERE l_orderkey % 89 = 0 HAVING count(*) > 0
    UNION ALL SELECT 'mines', 'kept', '', count(*) FROM orders WHERE o_orderkey % 211 <> 0
    UNION ALL SELECT 'facts', 'kept', '', count(*) FROM lineitem WHERE l_orderkey % 97 <> 0 AND l_orderkey % 89 <> 0""")
