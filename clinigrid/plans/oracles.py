"""The registered queries once more, as SQL that DuckDB runs on the same files."""

from __future__ import annotations

from clinigrid import dims

_STATE = "cast(n_regionkey + 1 AS VARCHAR)"
_MUN = "lpad(cast(n_nationkey + 1 AS VARCHAR), 3, '0')"

AREA = f"""area AS (
  SELECT n_nationkey, {_STATE} AS state_id, r_name AS state, {_STATE} || {_MUN} AS municipality_id,
         n_name AS municipality, lpad({_STATE}, 2, '0') || {_MUN} AS CVEGEO, n_regionkey AS community
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

_ORD = "(date_diff('day', DATE '1995-01-01', cast(o_orderdate AS DATE)) // 7 + 1)"
_WAVES = dims.default_waves()
_OLA = "CASE " + " ".join(f"WHEN {_ORD} < {w.stop} THEN '{w.ola}'" for w in _WAVES) + " END"
_DAYS = "CASE ola " + " ".join(f"WHEN '{w.ola}' THEN {w.dias_ola}" for w in _WAVES) + " END"
WAVE = "wave AS (SELECT unnest([" + ", ".join(f"'{w.ola}'" for w in _WAVES) + "]) AS ola)"

CASES = f"""cases AS (
  SELECT CVEGEO, cast(left(o_orderpriority, 1) AS INT) AS clas, o_orderstatus = 'F' AS dead, {_OLA} AS ola
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN area ON n_nationkey = c_nationkey)"""

FATALITY = f"""{AREA}, {WAVE}, {CASES},
seen AS (
  SELECT CVEGEO, ola, count(*) FILTER (WHERE dead) AS d, count(*) AS n FROM cases
  WHERE clas IN (1, 2, 3) AND ola IS NOT NULL GROUP BY 1, 2),
fatality AS (
  SELECT CVEGEO, ola, coalesce(d, 0) AS defunciones, coalesce(n, 0) AS casos_totales,
         100.0::DOUBLE * coalesce(d, 0) / nullif(coalesce(n, 0), 0) AS cfr
  FROM (SELECT DISTINCT CVEGEO FROM seen) CROSS JOIN wave LEFT JOIN seen USING (CVEGEO, ola))"""

TESTS = f"""tests AS (
  SELECT CVEGEO, ola, n, dias_ola, n::DOUBLE / dias_ola AS pruebas_dia_promedio
  FROM (SELECT CVEGEO, ola, count(*) AS n, {_DAYS} AS dias_ola FROM cases
        WHERE clas IN (3, 5) AND ola IS NOT NULL GROUP BY CVEGEO, ola))"""

POPULATION = """people AS (
  SELECT CVEGEO, state, count(*)::DOUBLE AS POBTOT,
    count(*) FILTER (WHERE c_custkey % 2 = 0) AS POBFEM,
    count(*) FILTER (WHERE c_acctbal < 0) AS POB0_14,
    count(*) FILTER (WHERE c_acctbal BETWEEN 0 AND 5000) AS POB15_64,
    count(*) FILTER (WHERE c_acctbal > 5000) AS POB65_MAS
  FROM customer JOIN area ON n_nationkey = c_nationkey GROUP BY CVEGEO, state)"""

CAPITA_TESTS = """capita_tests AS (
  SELECT CVEGEO, ola, pruebas_dia_promedio / nullif(POBTOT, 0) AS pruebas_dia_capita
  FROM tests LEFT JOIN people USING (CVEGEO))"""

SHARES = """shares AS (
  SELECT CVEGEO, 100.0::DOUBLE * POBFEM / nullif(POBTOT, 0) AS POBFEM,
    100.0::DOUBLE * POB0_14 / nullif(POBTOT, 0) AS POB0_14,
    100.0::DOUBLE * POB15_64 / nullif(POBTOT, 0) AS POB15_64,
    100.0::DOUBLE * POB65_MAS / nullif(POBTOT, 0) AS POB65_MAS
  FROM people)"""

_CODES = "[" + ", ".join(f"'{c}'" for c in sorted(dims.INSTITUTIONS)) + "]"
FACILITY = f"""facility AS (
  SELECT CVEGEO, s_suppkey AS clues, {_CODES}[1 + s_suppkey % {len(dims.INSTITUTIONS)}] AS institution,
    CASE WHEN s_acctbal > 0 THEN cast(floor(s_acctbal / 100) AS BIGINT) END AS beds, 1::BIGINT AS clinics,
    state_id, state, municipality_id, municipality
  FROM supplier JOIN area ON n_nationkey = s_nationkey)"""

STAFF = """staff AS (
  SELECT l_suppkey AS clues, sum(l_quantity) AS personal
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE year(l_shipdate) = 2001 AND regexp_matches(p_type, 'promo|standard', 'i') GROUP BY 1)"""

BY_INSTITUTION = """by_institution AS (
  SELECT municipality_id, municipality, institution, coalesce(sum(beds), 0)::BIGINT AS camas,
    coalesce(sum(clinics), 0)::BIGINT AS clinicas, coalesce(sum(personal), 0) AS personal
  FROM facility LEFT JOIN staff USING (clues) GROUP BY 1, 2, 3)"""

_DICTIONARY = ", ".join(
    f"('{code}', '{name}', '{variable}')" for code, (name, variable) in dims.INSTITUTIONS.items()
)
HARMONISED = f"""dictionary(institution, nombre_institucion, variable) AS (VALUES {_DICTIONARY}),
harmonised AS (
  SELECT municipality_id, municipality, variable, sum(camas)::BIGINT AS camas,
    sum(clinicas)::BIGINT AS clinicas, sum(personal) AS personal
  FROM by_institution JOIN dictionary USING (institution)
  WHERE variable <> '{dims.OTHER_VARIABLE}' GROUP BY 1, 2, 3)"""

_CENSUS = {
    "POBTOT": "TRUE", "PSINDER": "c_acctbal < 0", "PDER_SS": "c_acctbal >= 0",
    "PDER_IMSS": "c_mktsegment = 'AUTOMOBILE'", "PDER_ISTE": "c_mktsegment = 'BUILDING'",
    "PDER_ISTEE": "c_mktsegment = 'MACHINERY' AND c_custkey % 2 = 0",
    "PAFIL_PDOM": "c_mktsegment = 'FURNITURE' AND c_custkey % 2 = 0",
    "PDER_SEGP": "c_mktsegment = 'HOUSEHOLD'",
    "PDER_IMSSB": "c_mktsegment = 'FURNITURE' AND c_custkey % 2 = 1",
    "PAFIL_IPRIV": "c_mktsegment = 'MACHINERY' AND c_custkey % 4 = 1",
    "PAFIL_OTRAI": "c_mktsegment = 'MACHINERY' AND c_custkey % 4 = 3",
}
_LONG = " UNION ALL ".join(
    f"SELECT c_nationkey, '{v}' AS variable, nullif(count(*) FILTER (WHERE {c}), 0)::DOUBLE AS valor, "
    f"'{dims.VARIABLE_NAMES[v]}' AS nombre FROM customer GROUP BY c_nationkey"
    for v, c in _CENSUS.items()
)
_SHORT_STATE = "CASE state_id " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in dims.SHORT_STATE_NAMES.items()
) + " ELSE state END"
AFFILIATION = f"""affiliation AS (
  SELECT state_id, {_SHORT_STATE} AS state, municipality_id, municipality, variable, valor, nombre
  FROM ({_LONG}) JOIN area ON n_nationkey = c_nationkey)"""

_NAMES = ", ".join(
    f"('{v}', '{n}')" for v, n in sorted({
        (v, dims.MERGED_NAME if v == dims.MERGED_VARIABLE else n)
        for n, v in dims.INSTITUTIONS.values() if v != dims.OTHER_VARIABLE
    })
)
_KEPT = ", ".join(f"'{v}'" for v in dims.KEPT_VARIABLES)
RESOURCES_POPULATION = f"""{AREA}, {FACILITY}, {STAFF}, {BY_INSTITUTION}, {HARMONISED}, {AFFILIATION},
full_names(variable, nombre_institucion) AS (VALUES {_NAMES}),
resources_population AS (
  SELECT state_id, state, municipality_id, municipality, variable AS institucion_inegi,
    nombre AS institucion, nombre_institucion, coalesce(valor, 0) AS poblacion,
    coalesce(camas, 0) AS camas, coalesce(clinicas, 0) AS clinicas, coalesce(personal, 0) AS personal
  FROM affiliation LEFT JOIN harmonised USING (municipality_id, municipality, variable)
  LEFT JOIN full_names USING (variable) WHERE variable IN ({_KEPT})),
own AS (
  SELECT CVEGEO, institucion_inegi, institucion, poblacion AS derechohabientes, camas, clinicas, personal
  FROM resources_population JOIN area USING (municipality_id))"""


def _wide(value: str, name: str, key: str = "institucion_inegi", values=dims.KEPT_VARIABLES) -> str:
    return ", ".join(
        f"""max(CASE WHEN {key} = '{v}' THEN {value} END) AS "{name.format(v)}" """ for v in values
    )


CAPITA = f"""capita AS (
  SELECT CVEGEO, {_wide("camas::DOUBLE / nullif(derechohabientes, 0)", "camas_capita_{}")},
    {_wide("clinicas::DOUBLE / nullif(derechohabientes, 0)", "clinicas_capita_{}")}
  FROM own GROUP BY CVEGEO)"""
COVERAGE = f"""coverage AS (
  SELECT CVEGEO, {_wide("100.0::DOUBLE * derechohabientes / nullif(POBTOT, 0)", "cobertura_pc_{}")}
  FROM own LEFT JOIN people USING (CVEGEO) GROUP BY CVEGEO)"""


def _grid_edges(table: str, number: str, area: str, width: int, rook: bool = False) -> str:
    """Neighbour pairs of a grid of unit squares, by row and column distance."""
    near = "abs(a.c - b.c) + abs(a.r - b.r) = 1" if rook else (
        "greatest(abs(a.c - b.c), abs(a.r - b.r)) = 1"
    )
    return f"""square AS (
  SELECT {area} AS geo, {number} % {width} AS c, {number} // {width} AS r FROM {table}),
edge AS (
  SELECT a.geo AS V1, b.geo AS V2 FROM square a
  JOIN (SELECT *, unnest([r - 1, r, r + 1]) AS rr FROM square) b ON b.rr = a.r
  WHERE {near})"""


NATION_EDGES = _grid_edges("area", "n_nationkey", "CVEGEO", 5)
VECTOR_GRAPH = f"""{_grid_edges("embeddings", "vec_id", "vec_id", 25)},
vector AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
distance AS (
  SELECT V1, V2, 1 - list_dot_product(a.v, b.v)
    / nullif(sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)), 0) AS cosine_distance
  FROM edge JOIN vector a ON a.vec_id = V1 JOIN vector b ON b.vec_id = V2),
graph AS (
  SELECT least(V1, V2) AS src, greatest(V1, V2) AS dst, sum(cosine_distance) AS weight
  FROM distance WHERE V1 <> V2 GROUP BY 1, 2)"""

CONTRIBUTION = f"""around AS (
  SELECT V1 AS CVEGEO, institucion_inegi, sum(camas) AS camas, sum(clinicas) AS clinicas,
    sum(personal) AS personal, sum(derechohabientes) AS derechohabientes
  FROM edge JOIN own ON own.CVEGEO = V2 GROUP BY 1, 2),
both_sides AS (
  SELECT o.CVEGEO, o.institucion_inegi, v.variable, v.mun::DOUBLE AS mun, v.vecino::DOUBLE AS vecino
  FROM own o JOIN around n USING (CVEGEO, institucion_inegi), LATERAL (VALUES
    ('camas', o.camas, n.camas), ('clinicas', o.clinicas, n.clinicas),
    ('personal', o.personal, n.personal), ('derechohabientes', o.derechohabientes, n.derechohabientes)
  ) AS v(variable, mun, vecino)),
cells AS (
  SELECT CVEGEO, variable || '_' || institucion_inegi AS cell, mun, vecino, mun + vecino AS "full",
    100.0::DOUBLE * mun / nullif(mun + vecino, 0) AS mun_contrib FROM both_sides)"""
_CELLS = [
    f"{v}_{i}" for v in ("camas", "clinicas", "personal", "derechohabientes")
    for i in dims.KEPT_VARIABLES
]
_MEASURES = ("mun", "vecino", "full", "mun_contrib")
CONTRIBUTION_WIDE = "contribution AS (SELECT CVEGEO, " + ", ".join(
    _wide(f'"{m}"', m + "_{}", "cell", _CELLS) for m in _MEASURES
) + " FROM cells GROUP BY CVEGEO)"

_TYPE = """CASE WHEN regexp_matches(p_type, 'large|small', 'i') THEN 'camas'
  WHEN regexp_matches(p_type, 'promo|standard', 'i') THEN 'personal' ELSE 'otro' END"""
TREND = f"""{AREA}, cell AS (
  SELECT state, p_type AS resources_categories, year(l_shipdate)::INT AS year,
    sum(l_quantity) AS total, {_TYPE} AS resource_type
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN area ON n_nationkey = s_nationkey GROUP BY state, p_type, year(l_shipdate)),
largest AS (
  SELECT state, resource_type, CASE WHEN max(total) > 9500 THEN 'mas_cinco'
    WHEN max(total) > 9000 THEN 'mas_tres' WHEN max(total) > 8500 THEN 'mas_mil' ELSE 'menos_mil' END AS category
  FROM cell GROUP BY 1, 2),
trend AS (SELECT * FROM cell JOIN largest USING (state, resource_type))"""

BEDS = f"""{FATALITY}, {POPULATION}, {FACILITY},
beds AS (
  SELECT CVEGEO, POBTOT, beds, 100000.0::DOUBLE * beds / nullif(POBTOT, 0) AS beds_per_100khab
  FROM people JOIN (SELECT CVEGEO, coalesce(sum(beds), 0)::BIGINT AS beds FROM facility GROUP BY 1)
  USING (CVEGEO))"""

TOP = """sums AS (
  SELECT community, institucion, sum(derechohabientes) AS poblacion, sum(camas)::DOUBLE AS camas
  FROM own JOIN area USING (CVEGEO) GROUP BY 1, 2),
most_people AS (SELECT * FROM sums QUALIFY poblacion = max(poblacion) OVER (PARTITION BY community)),
most_beds AS (SELECT * FROM sums QUALIFY camas = max(camas) OVER (PARTITION BY community))"""

CATCHMENT = f"""{AREA}, {FACILITY}, catchment AS (
  SELECT institution, coalesce(beds, 0) AS y, x FROM facility
  JOIN (SELECT l_suppkey AS clues, sum(l_quantity) AS x FROM lineitem GROUP BY 1) USING (clues))"""


def _bins(cuts: list[float], by: str | None = None) -> str:
    keys = f"{by}, " if by else ""
    points = ", ".join(f"quantile_cont(x, {p})" for p in cuts)
    partition = f"PARTITION BY {by}" if by else ""
    points = points.replace(")", f") OVER ({partition})")
    rows = "catchment WHERE y > 0" if by else "catchment"
    return f"""binned AS (
  SELECT {keys}x, y, len(list_filter([{points}], lambda q: q < x))::INT AS bin FROM {rows}),
stat AS (
  SELECT {keys}bin, count(*) AS n, avg(x) AS mean_x, avg(y) AS mean_y, stddev_samp(y) AS sd_y
  FROM binned GROUP BY ALL)
SELECT {keys}bin, n, round(mean_x, 4) AS mean_x, round(mean_y, 4) AS mean_y, round(sd_y, 4) AS sd_y,
  round(mean_y - 1.96 * sd_y / sqrt(n), 4) AS ci_low, round(mean_y + 1.96 * sd_y / sqrt(n), 4) AS ci_high
FROM stat"""


def _rounded(*names: str, digits: int = 4) -> str:
    return ", ".join(f'round("{n}", {digits}) AS "{n}"' for n in names)


_CAPITA_NAMES = [f"{m}_capita_{v}" for m in ("camas", "clinicas") for v in dims.KEPT_VARIABLES]
_COVERAGE_NAMES = [f"cobertura_pc_{v}" for v in dims.KEPT_VARIABLES]
_SHARE_NAMES = ["POBFEM", "POB0_14", "POB15_64", "POB65_MAS"]
_CONTRIBUTION_NAMES = [f"{m}_{c}" for m in _MEASURES for c in _CELLS]
_OWN_SHARE_NAMES = [n for n in _CONTRIBUTION_NAMES if "contrib" in n]

ORACLES = {
    "cfr_by_wave": f"""WITH {FATALITY}
SELECT CVEGEO, ola, defunciones, casos_totales, round(cfr, 4) AS cfr FROM fatality""",
    "outcome_shares": f"""WITH {FATALITY}
SELECT CVEGEO, ola, DEFUNCION, CASE WHEN DEFUNCION THEN defunciones ELSE casos_totales - defunciones END AS n,
  casos_totales, round(100.0::DOUBLE * CASE WHEN DEFUNCION THEN defunciones ELSE casos_totales - defunciones END
    / nullif(casos_totales, 0), 4) AS pc
FROM fatality CROSS JOIN (SELECT unnest([TRUE, FALSE]) AS DEFUNCION)""",
    "tests_per_day_by_wave": f"""WITH {AREA}, {CASES}, {TESTS}
SELECT CVEGEO, ola, n, dias_ola, round(pruebas_dia_promedio, 4) AS pruebas_dia_promedio FROM tests""",
    "tests_per_capita": f"""WITH {AREA}, {CASES}, {TESTS}, {POPULATION}, {CAPITA_TESTS}
SELECT CVEGEO, ola, round(pruebas_dia_capita, 6) AS pruebas_dia_capita FROM capita_tests""",
    "epi_week_labels": """WITH day AS (
  SELECT cast(o_orderdate AS DATE) AS d, d + cast(3 - dayofweek(d) AS INT) AS w FROM orders),
week AS (
  SELECT year(w) || '-' || lpad(cast((dayofyear(w) - 1) // 7 + 1 AS VARCHAR), 2, '0') AS semana,
    count(*) AS n, min((dayofyear(w) - 1) // 7 + 1)::INT AS semana_epi, min(d) AS primer_dia
  FROM day GROUP BY 1)
SELECT semana, n, semana_epi, primer_dia, year(primer_dia)::INT AS annum,
  row_number() OVER (ORDER BY semana) AS codigo FROM week""",
    "scenario_waves": f"""WITH {FATALITY}, scenario(scenario, ola) AS (VALUES {
        ", ".join(f"('{s}', '{o}')" for s, olas in dims.SCENARIOS.items() for o in olas)})
SELECT scenario, ola, sum(casos_totales)::BIGINT AS casos, sum(defunciones)::BIGINT AS defunciones,
  count(*) AS areas FROM fatality JOIN scenario USING (ola) GROUP BY 1, 2""",
    "facility_staff": f"WITH {STAFF} SELECT clues, personal FROM staff",
    "resources_by_area_institution": f"""WITH {AREA}, {FACILITY}, {STAFF}, {BY_INSTITUTION}
SELECT * FROM by_institution""",
    "institution_harmonised": f"""WITH {AREA}, {FACILITY}, {STAFF}, {BY_INSTITUTION}, {HARMONISED}
SELECT * FROM harmonised""",
    "resources_population": f"WITH {RESOURCES_POPULATION} SELECT * FROM resources_population",
    "affiliation_long": f"WITH {AREA}, {AFFILIATION} SELECT * FROM affiliation",
    "demographic_shares": f"""WITH {AREA}, {POPULATION}, {SHARES}
SELECT CVEGEO, {_rounded(*_SHARE_NAMES)} FROM shares""",
    "capita_wide": f"""WITH {RESOURCES_POPULATION}, {CAPITA}
SELECT CVEGEO, {_rounded(*_CAPITA_NAMES, digits=6)} FROM capita""",
    "coverage_wide": f"""WITH {RESOURCES_POPULATION}, {POPULATION}, {COVERAGE}
SELECT CVEGEO, {_rounded(*_COVERAGE_NAMES)} FROM coverage""",
    "contiguity_queen": f"""WITH {_grid_edges("customer", "c_custkey", "c_custkey", 100)}
SELECT V1, V2 FROM edge""",
    "contiguity_rook": f"""WITH {_grid_edges("customer", "c_custkey", "c_custkey", 100, rook=True)}
SELECT V1, V2 FROM edge""",
    "simple_graph": """SELECT least(2 * l_suppkey, 2 * l_partkey + 1) AS src, greatest(2 * l_suppkey, 2 * l_partkey + 1) AS dst,
  sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2""",
    "neighbourhood_totals": f"""WITH {RESOURCES_POPULATION}, {POPULATION}, {NATION_EDGES},
wide AS (SELECT CVEGEO, POBTOT, {", ".join(
    _wide(v, v + "_{}") for v in ("camas", "clinicas", "personal", "derechohabientes"))}
  FROM own LEFT JOIN people USING (CVEGEO) GROUP BY CVEGEO, POBTOT)
SELECT V1 AS CVEGEO, sum(POBTOT) AS POBTOT, {", ".join(
    f'sum("{c}"){"::BIGINT" if c.split("_")[0] in ("camas", "clinicas") else ""} AS "{c}"' for c in _CELLS)}
FROM edge JOIN wide ON wide.CVEGEO = V2 GROUP BY V1""",
    "own_vs_neighbour": f"""WITH {RESOURCES_POPULATION}, {NATION_EDGES}, {CONTRIBUTION}, {CONTRIBUTION_WIDE}
SELECT CVEGEO, {_rounded(*_CONTRIBUTION_NAMES)} FROM contribution""",
    "cosine_edges": f"""WITH {VECTOR_GRAPH}
SELECT V1, V2, round(cosine_distance, 6) AS cosine_distance FROM distance""",
    "area_similarity": f"""WITH {RESOURCES_POPULATION}, {WAVE}, {FATALITY.split(f"{WAVE},")[1]}, {TESTS},
{POPULATION}, {CAPITA_TESTS}, {SHARES}, {NATION_EDGES}, coordinate AS (
  SELECT CVEGEO, 'cfr' || ola AS k, cfr AS x FROM fatality
  UNION ALL SELECT CVEGEO, 'tests' || ola, pruebas_dia_capita
    FROM fatality LEFT JOIN capita_tests USING (CVEGEO, ola)
  UNION ALL SELECT CVEGEO, 'old', POB65_MAS FROM shares
  UNION ALL SELECT CVEGEO, 'women', POBFEM FROM shares
  UNION ALL SELECT CVEGEO, 'imss', derechohabientes FROM own WHERE institucion_inegi = 'PDER_IMSS')
SELECT V1, V2, CASE WHEN count(a.x * b.x) = 17 THEN
  round(1 - sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 6) END AS cosine_distance
FROM edge JOIN coordinate a ON a.CVEGEO = V1 JOIN coordinate b ON b.CVEGEO = V2 AND b.k = a.k
GROUP BY V1, V2""",
    "communities_two_rounds": f"""WITH {VECTOR_GRAPH}, ends AS (
  SELECT src AS v, dst AS u, round(weight / 1e-9)::BIGINT AS w FROM graph
  UNION ALL SELECT dst, src, round(weight / 1e-9)::BIGINT FROM graph),
one AS (SELECT v, u AS label FROM ends QUALIFY row_number() OVER (PARTITION BY v ORDER BY w DESC, u) = 1),
two AS (SELECT e.v, o.label, sum(w) AS s FROM ends e JOIN one o ON o.v = e.u GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY e.v ORDER BY s DESC, o.label) = 1)
SELECT v AS id, label FROM two""",
    "partition_quality": f"""WITH {VECTOR_GRAPH}, half AS (
  SELECT src AS id, dst AS other, weight FROM graph UNION ALL SELECT dst, src, weight FROM graph),
tagged AS (
  SELECT half.id, half.weight, a.label, a.label = b.label AS within
  FROM half JOIN embeddings a ON a.vec_id = half.id JOIN embeddings b ON b.vec_id = half.other),
total AS (SELECT sum(weight) AS t FROM tagged),
node AS (SELECT label, id, sum(weight) / t AS p FROM tagged, total GROUP BY label, id, t),
comm AS (
  SELECT label, sum(weight) / t AS p, coalesce(sum(weight) FILTER (WHERE within), 0) / t AS i
  FROM tagged, total GROUP BY label, t),
terms AS (
  SELECT count(*) AS communities, sum(i) - sum(p * p) AS modularity, sum(p - i) AS q,
    sum(CASE WHEN p > i THEN (p - i) * log2(p - i) ELSE 0 END) AS q_terms,
    sum((p - i + p) * log2(p - i + p)) AS qp_terms FROM comm)
SELECT communities, round(modularity, 6) AS modularity,
  round(CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END - 2 * q_terms
    - (SELECT sum(p * log2(p)) FROM node) + qp_terms, 6) AS codelength FROM terms""",
    "top_institution_per_community": f"""WITH {RESOURCES_POPULATION}, {TOP}
SELECT community, institucion, poblacion AS valor, 'afiliados' AS medida FROM most_people
UNION ALL SELECT community, institucion, camas, 'camas' FROM most_beds""",
    "contribution_label": f"""WITH {RESOURCES_POPULATION}, {TOP}
SELECT b.community, CASE WHEN b.institucion = p.institucion THEN p.institucion || ' mayor contribuyente camas'
  ELSE p.institucion || ' debe contribuir más camas' END AS grupo
FROM most_beds b LEFT JOIN most_people p USING (community)""",
    "bed_zscore": f"""WITH {RESOURCES_POPULATION}, {POPULATION}, z AS (
  SELECT CVEGEO, community, POBTOT, sum(camas)::BIGINT AS camas FROM area
  LEFT JOIN people USING (CVEGEO) LEFT JOIN own USING (CVEGEO) GROUP BY 1, 2, 3)
SELECT CVEGEO, community, round(POBTOT, 4) AS POBTOT, camas,
  (sum(camas) OVER w)::BIGINT AS camas_comm_sum, round(avg(camas) OVER w, 4) AS camas_comm_avg,
  round(stddev_samp(camas) OVER w, 4) AS camas_comm_sd,
  round((camas - avg(camas) OVER w) / nullif(stddev_samp(camas) OVER w, 0), 4) AS z_score
FROM z WINDOW w AS (PARTITION BY community)""",
    "beds_per_100k": f"""WITH {BEDS}
SELECT CVEGEO, municipality, POBTOT, beds, round(beds_per_100khab, 4) AS beds_per_100khab
FROM area LEFT JOIN beds USING (CVEGEO)""",
    "loglog_regression_by_wave": f"""WITH {BEDS}, point AS (
  SELECT ola, log10(beds_per_100khab) AS lx, log10(cfr) AS ly FROM fatality JOIN beds USING (CVEGEO)
  WHERE casos_totales > 5 AND cfr > 0 AND beds_per_100khab > 0)
SELECT ola, count(*) AS n, round(regr_slope(ly, lx), 4) AS slope,
  round(regr_intercept(ly, lx), 4) AS intercept, nullif(round(regr_r2(ly, lx), 4), 'nan'::DOUBLE) AS r2
FROM point GROUP BY ola""",
    # One slope and one level per wave: the slope is that of the rows centred by wave.
    "glm_estimates": f"""WITH {BEDS}, point AS (
  SELECT ola, beds_per_100khab AS x, cfr AS y FROM fatality JOIN beds USING (CVEGEO)
  WHERE cfr IS NOT NULL AND beds_per_100khab IS NOT NULL),
level AS (SELECT ola, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM point GROUP BY ola),
fit AS (
  SELECT sum((x - mx) * (y - my)) / sum((x - mx) ** 2) AS b, sum((x - mx) ** 2) AS sxx,
    sum((y - my) ** 2) AS syy, sum((x - mx) * (y - my)) AS sxy, count(*) - count(DISTINCT ola) - 1 AS df
  FROM point JOIN level USING (ola)),
noise AS (SELECT b, sxx, (syy - b * sxy) / df AS s2 FROM fit),
base AS (SELECT * FROM level ORDER BY ola LIMIT 1),
terms AS (
  SELECT 'beds_per_100khab' AS term, b AS estimate, sqrt(s2 / sxx) AS std_error FROM noise
  UNION ALL SELECT '(Intercept)', my - b * mx, sqrt(s2 * (1 / n + mx ** 2 / sxx)) FROM noise, base
  UNION ALL SELECT 'ola_' || k.ola, k.my - b * k.mx - (g.my - b * g.mx),
    sqrt(s2 * (1 / k.n + 1 / g.n + (k.mx - g.mx) ** 2 / sxx))
  FROM noise, base g, level k WHERE k.ola <> g.ola)
SELECT term, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error,
  round(estimate / std_error, 6) AS statistic FROM terms""",
    "units_by_state_institution": f"""WITH {AREA}, {FACILITY}
SELECT state, institution, count(*) AS n FROM facility
WHERE institution IN (SELECT institution FROM facility GROUP BY 1 HAVING count(*) > 5) GROUP BY 1, 2""",
    "institution_sizes": f"""WITH {AREA}, {FACILITY}
SELECT institution, count(*) AS n FROM facility GROUP BY 1""",
    "state_bed_category": f"""WITH {AREA}, {FACILITY}, total AS (
  SELECT state, sum(beds)::BIGINT AS total_beds FROM facility WHERE beds > 0 GROUP BY 1),
labelled AS (
  SELECT *, CASE WHEN total_beds > 1000 THEN 'mas_diez' WHEN total_beds > 900 THEN 'mas_cinco'
    WHEN total_beds > 800 THEN 'mas_tres' ELSE 'menos_tres' END AS category FROM total)
SELECT state, institution, sum(beds)::BIGINT AS beds, total_beds, category,
  CASE category {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.BED_SIZE_TITLES.items())} END AS title,
  state || chr(10) || total_beds AS facet
FROM facility JOIN labelled USING (state) WHERE beds > 0 GROUP BY ALL""",
    "state_totals_population": f"""WITH {AREA}, {FACILITY}, {POPULATION}
SELECT CASE state_id WHEN '5' THEN 'Coahuila' ELSE state END AS state, institution,
  CASE WHEN count(beds) = count(*) THEN sum(beds)::BIGINT END AS camas,
  sum(clinics)::BIGINT AS clinicas, pobtotal
FROM facility LEFT JOIN (SELECT state, sum(POBTOT) AS pobtotal FROM people GROUP BY 1) USING (state)
GROUP BY state, state_id, institution, pobtotal""",
    "resource_trend": f"WITH {TREND} SELECT * FROM trend",
    "resource_type_crosstab": f"""WITH {TREND}
SELECT category, resource_type, count(DISTINCT state) AS n FROM trend GROUP BY 1, 2""",
    "capitalised_labels": f"""SELECT DISTINCT p_type AS resources_categories, {_TYPE} AS resource_type,
  upper(left({_TYPE}, 1)) || substring({_TYPE}, 2) AS label FROM part""",
    "population_quantiles": f"""WITH {AREA}, {POPULATION}
SELECT prob::DOUBLE AS prob, round(CASE prob
  WHEN 0 THEN quantile_cont(POBTOT, 0) WHEN 0.25 THEN quantile_cont(POBTOT, 0.25)
  WHEN 0.5 THEN quantile_cont(POBTOT, 0.5) WHEN 0.75 THEN quantile_cont(POBTOT, 0.75)
  ELSE quantile_cont(POBTOT, 1) END, 4) AS poblacion
FROM people CROSS JOIN (SELECT unnest([0, 0.25, 0.5, 0.75, 1]) AS prob) GROUP BY prob""",
    "binscatter_beds": f"WITH {CATCHMENT}, {_bins([0.2, 0.4, 0.6, 0.8])}",
    "binscatter_beds_range": f"WITH {CATCHMENT}, {_bins([0.2, 0.4, 0.6, 0.8])} WHERE mean_x BETWEEN 14800 AND 16500",
    "binscatter_by_institution": f"WITH {CATCHMENT}, {_bins([1 / 3, 2 / 3], 'institution')}",
    "cube_slice_union": f"""WITH {TREND}
SELECT state, resources_categories, year, total FROM cell WHERE total > 0""",
    "json_records_scan": """SELECT event_type, measure, count(*) AS n, sum(amount)::DOUBLE AS total FROM (
  SELECT event_type, 'value' AS measure, value::DECIMAL(18, 2) AS amount FROM events
  UNION ALL SELECT event_type, 'k', regexp_extract(props, '"k": *([0-9]+)', 1)::DECIMAL(18, 2) FROM events)
GROUP BY 1, 2""",
    "tsv_round_trip": f"""WITH {AREA}, {FACILITY} SELECT * FROM facility""",
    "not_in_keep_null": """SELECT flag, count(*) AS n, sum(l_quantity) AS total FROM (
  SELECT CASE WHEN l_linenumber <> 7 THEN l_returnflag END AS flag, l_quantity FROM lineitem)
WHERE flag IS NULL OR flag NOT IN ('A', 'N') GROUP BY 1""",
    "communities_audit": """SELECT 'vertices' AS what, count(*) AS n FROM embeddings
UNION ALL SELECT unnest(['gaps', 'wrong_sizes', 'unsettled']), 0::BIGINT""",
    "sorted_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "column_subset_scan": f"WITH {AREA}, {FACILITY} SELECT clues, beds FROM facility",
    "sliced_write": """SELECT o_orderstatus, count(*) AS n, sum(o_custkey)::BIGINT AS keys FROM orders
WHERE o_orderstatus = 'F' GROUP BY 1""",
    "catalog_table": "SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1",
    "contiguity_tolerance": f"""WITH {AREA}, {NATION_EDGES} SELECT V1, V2 FROM edge""",
    "top_missing_key": """WITH item AS (
  SELECT CASE WHEN l_orderkey % 3 <> 0 THEN l_returnflag END AS flag, l_quantity FROM lineitem)
SELECT flag, l_quantity, count(*) AS n FROM item
WHERE l_quantity = (SELECT max(i.l_quantity) FROM item i WHERE i.flag IS NOT DISTINCT FROM item.flag) GROUP BY 1, 2""",
    "group_stats_missing_key": """SELECT CASE WHEN l_orderkey % 3 <> 0 THEN l_returnflag END AS flag,
  max(l_quantity) AS largest, count(*) AS rows, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1""",
    **{name: """WITH item AS (
  SELECT CASE WHEN l_orderkey % 3 <> 0 THEN l_returnflag END AS flag, l_extendedprice AS price FROM lineitem)
SELECT flag, unnest([0.1, 0.5, 0.9])::DOUBLE AS prob,
  round(unnest(quantile_cont(price, [0.1, 0.5, 0.9])), 4) AS price FROM item GROUP BY flag"""
       for name in ("quantiles_missing_key", "quantiles_missing_key_ranked")},
    "weeks_missing_date": """WITH day AS (
  SELECT CASE WHEN o_orderkey % 4 <> 0 THEN cast(o_orderdate AS DATE) END AS d,
    d + cast(3 - dayofweek(d) AS INT) AS w FROM orders),
week AS (
  SELECT year(w) || '-' || lpad(cast((dayofyear(w) - 1) // 7 + 1 AS VARCHAR), 2, '0') AS semana,
    count(*) AS n, min((dayofyear(w) - 1) // 7 + 1)::INT AS semana_epi, min(d) AS primer_dia
  FROM day GROUP BY 1)
SELECT semana, n, semana_epi, primer_dia, year(primer_dia)::INT AS annum,
  CASE WHEN semana IS NOT NULL THEN row_number() OVER (ORDER BY semana NULLS LAST) END AS codigo FROM week""",
    "hash_split_folds": """WITH drawn AS (SELECT
  ('0x' || left(md5(o_orderkey::VARCHAR || '|725split'), 8))::BIGINT % 100 < 75 AS train,
  (('0x' || left(md5(o_orderkey::VARCHAR || '|725fold'), 8))::BIGINT % 10)::INT AS fold FROM orders)
SELECT train, fold, count(*) AS n FROM drawn GROUP BY 1, 2""",
    "sorted_distinct": "SELECT DISTINCT p_brand, p_type FROM part ORDER BY 1, 2",
    "area_keys": f"""WITH {AREA}
SELECT CVEGEO AS from_code, CVEGEO AS from_parts, count(*) AS n
FROM customer JOIN area ON n_nationkey = c_nationkey GROUP BY 1, 2""",
    "feature_table_v1": f"""WITH {RESOURCES_POPULATION}, {WAVE}, {FATALITY.split(f"{WAVE},")[1]}, {TESTS},
{POPULATION}, {CAPITA_TESTS}, {SHARES}, {CAPITA}, {COVERAGE}
SELECT CVEGEO, ola, defunciones, casos_totales, {_rounded(
    "cfr", "pruebas_dia_capita", *_SHARE_NAMES, *_CAPITA_NAMES, *_COVERAGE_NAMES)}
FROM fatality LEFT JOIN capita USING (CVEGEO) LEFT JOIN shares USING (CVEGEO)
LEFT JOIN capita_tests USING (CVEGEO, ola) LEFT JOIN coverage USING (CVEGEO)""",
    "feature_table_v2": f"""WITH {RESOURCES_POPULATION}, {WAVE}, {FATALITY.split(f"{WAVE},")[1]}, {TESTS},
{POPULATION}, {CAPITA_TESTS}, {SHARES}, {NATION_EDGES}, {CONTRIBUTION}, {CONTRIBUTION_WIDE}
SELECT CVEGEO, ola, defunciones, casos_totales, {_rounded(
    "cfr", "pruebas_dia_capita", *_SHARE_NAMES,
    *[n for n in _CONTRIBUTION_NAMES if n not in _OWN_SHARE_NAMES])},
  {", ".join(f'round(coalesce("{n}", 0), 4) AS "{n}"' for n in _OWN_SHARE_NAMES)}
FROM fatality LEFT JOIN shares USING (CVEGEO) LEFT JOIN contribution USING (CVEGEO)
LEFT JOIN capita_tests USING (CVEGEO, ola)""",
}

ORACLES["scenario_models"] = f"""WITH f AS ({ORACLES["feature_table_v1"]}),
scenario(scenario, ola) AS (VALUES {", ".join(f"('{s}', '{o}')" for s, olas in dims.SCENARIOS.items() for o in olas)}),
train AS (SELECT scenario, ('0x' || left(md5(CVEGEO || '|' || ola || '|725fold'), 8))::BIGINT % 10 AS fold
  FROM (SELECT * FROM f WHERE COLUMNS(*) IS NOT NULL) JOIN scenario USING (ola)
  WHERE ('0x' || left(md5(CVEGEO || '|' || ola || '|725split'), 8))::BIGINT % 100 < 75)
SELECT scenario, count(DISTINCT fold) + 1 AS models, (count(DISTINCT fold) + 1) * 2000 AS trees_grown,
  2000 AS trees, 10 AS folds, 25 AS settings FROM train GROUP BY 1"""

# The two-sided tail of t for whole degrees of freedom, as a finite sum.
ORACLES["glm_coefficients"] = ORACLES["glm_estimates"].rsplit("SELECT term, round", 1)[0].rstrip() + """,
tail AS (
  SELECT term, estimate, std_error, estimate / std_error AS t, df, atan(abs(estimate / std_error) / sqrt(df)) AS angle
  FROM terms, (SELECT any_value(df) AS df FROM fit)),
series AS (
  SELECT *, ln(cos(angle) ** 2) AS c,
    CASE WHEN df % 2 = 0 THEN sin(angle) * list_sum(list_transform(range(df // 2),
        lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) - ln(pi()) / 2 + k * ln(cos(angle) ** 2))))
      ELSE 2 / pi() * (angle + sin(angle) * cos(angle) * coalesce(list_sum(list_transform(range((df - 1) // 2),
        lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5) + k * ln(cos(angle) ** 2)))), 0)) END AS inside
  FROM tail)
SELECT term, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error, round(t, 6) AS statistic,
  round(1 - inside, 6) AS p_value FROM series ORDER BY 1 - inside"""

ORACLES["cv_metrics_linear"] = f"""WITH {BEDS}, {TESTS}, {CAPITA_TESTS}, point AS (
  SELECT beds_per_100khab AS x1, pruebas_dia_capita AS x2, cfr AS y,
    CASE WHEN ('0x' || left(md5(CVEGEO || '|' || ola || '|725split'), 8))::BIGINT % 100 < 75
      THEN ('0x' || left(md5(CVEGEO || '|' || ola || '|725fold'), 8))::BIGINT % 10 ELSE -1 END AS fold
  FROM fatality JOIN capita_tests USING (CVEGEO, ola) JOIN beds USING (CVEGEO)
  WHERE cfr IS NOT NULL AND beds_per_100khab IS NOT NULL AND pruebas_dia_capita IS NOT NULL),
own AS (
  SELECT fold, count(*)::DOUBLE AS n, sum(x1) AS s1, sum(x2) AS s2, sum(y) AS sy, sum(x1 * x1) AS s11, sum(x1 * x2) AS s12,
    sum(x2 * x2) AS s22, sum(x1 * y) AS s1y, sum(x2 * y) AS s2y, sum(y * y) AS syy FROM point GROUP BY fold),
training AS (
  SELECT held.fold, {", ".join(f"sum(own.{c}) AS {c}" for c in "n s1 s2 sy s11 s12 s22 s1y s2y syy".split())}
  FROM own held JOIN own ON own.fold <> held.fold AND own.fold <> -1 GROUP BY held.fold),
scaled AS (
  SELECT *, sqrt(s11 / n - (s1 / n) ** 2) AS d1, sqrt(s22 / n - (s2 / n) ** 2) AS d2 FROM training),
related AS (
  SELECT *, (s12 / n - s1 * s2 / n ** 2) / d1 / d2 AS r, (s1y / n - s1 * sy / n ** 2) / d1 AS c1,
    (s2y / n - s2 * sy / n ** 2) / d2 AS c2 FROM scaled),
slopes AS (
  SELECT fold, penalty, (((1 + penalty) * c1 - r * c2) / ((1 + penalty) ** 2 - r * r) / d1) AS b1,
    (((1 + penalty) * c2 - r * c1) / ((1 + penalty) ** 2 - r * r) / d2) AS b2, s1 / n AS m1, s2 / n AS m2, sy / n AS my
  FROM related, (SELECT unnest([0.0, 0.01, 0.1, 1.0, 10.0])::DOUBLE AS penalty)),
fitted AS (SELECT fold, penalty, my - b1 * m1 - b2 * m2 AS b0, b1, b2 FROM slopes),
products AS (
  SELECT fold, penalty, n, sy, syy, n * b0 + b1 * s1 + b2 * s2 AS sf, b0 * sy + b1 * s1y + b2 * s2y AS sfy,
    n * b0 * b0 + b1 * b1 * s11 + b2 * b2 * s22 + 2 * (b0 * b1 * s1 + b0 * b2 * s2 + b1 * b2 * s12) AS sff
  FROM fitted JOIN own USING (fold)),
score AS (
  SELECT fold, penalty, sqrt(greatest(0, syy - 2 * sfy + sff) / n) AS rmse,
    CASE WHEN n > 1 AND (sff / n - (sf / n) ** 2) * (syy / n - (sy / n) ** 2) > 1e-12 * sff / n * syy / n THEN
      (sfy / n - sf * sy / n ** 2) ** 2 / ((sff / n - (sf / n) ** 2) * (syy / n - (sy / n) ** 2)) END AS rsq
  FROM products),
long AS (
  SELECT fold, penalty, 'rmse' AS metric, rmse AS estimate FROM score UNION ALL SELECT fold, penalty, 'rsq', rsq FROM score),
tuning AS (
  SELECT penalty, metric, avg(estimate) AS mean, count(estimate) AS n,
    stddev_samp(estimate) / sqrt(count(estimate)) AS std_err FROM long WHERE fold <> -1 GROUP BY ALL),
best AS (SELECT penalty FROM tuning WHERE metric = 'rsq' ORDER BY round(mean, 9) DESC, penalty LIMIT 1)
SELECT 'todas' AS olas, penalty, metric, round(mean, 6) AS mean, n, round(std_err, 6) AS std_err, 'folds' AS "set" FROM tuning
UNION ALL SELECT 'todas', penalty, metric, round(estimate, 6), NULL, NULL, 'test' FROM long JOIN best USING (penalty) WHERE fold = -1"""

ORACLES["cube_slice_landed"] = ORACLES["cube_slice_union"]
ORACLES["json_splits_scan"] = ORACLES["json_records_scan"]
ORACLES["contiguity_features"] = " UNION ALL ".join(
    f"SELECT '{rule}' AS rule, V1::VARCHAR AS V1, V2::VARCHAR AS V2 FROM ({ORACLES[f'contiguity_{rule}']})"
    for rule in ("queen", "rook")
)
ORACLES["orders_by_period"] = """WITH period(period, first, last) AS (VALUES
  ('antes', NULL, DATE '1996-06-30'), ('primera', DATE '1995-03-01', DATE '1997-02-28'),
  ('larga', DATE '1996-01-01', DATE '2000-12-31'), ('dia', DATE '1998-07-04', DATE '1998-07-04'),
  ('vacia', DATE '1990-01-01', DATE '1990-12-31'), ('al revés', DATE '1999-01-01', DATE '1998-01-01'),
  ('desde', DATE '2001-01-01', NULL), ('todo', NULL, NULL))
SELECT period, o_orderpriority, count(*) AS n, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS total
FROM orders JOIN period ON coalesce(o_orderdate::DATE >= first, true) AND coalesce(o_orderdate::DATE <= last, true)
GROUP BY 1, 2"""
ORACLES["binscatter_clinics_areas"] = f"""WITH {AREA}, {POPULATION}, {FACILITY}, catchment AS (
  SELECT POBTOT AS x, y FROM people JOIN (SELECT CVEGEO, sum(clinics) AS y FROM facility GROUP BY 1) USING (CVEGEO)),
{_bins([0.25, 0.5, 0.75])}"""
ORACLES["nonempty_batches"] = """SELECT year(o_orderdate)::VARCHAR AS batch, count(*) AS n, max(o_orderkey) AS last
FROM orders WHERE year(o_orderdate) BETWEEN 1993 AND 2003 GROUP BY 1"""
