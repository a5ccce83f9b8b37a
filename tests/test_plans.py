from datetime import date

import pytest
from pyspark.sql import functions as F

from clinigrid import dims
from clinigrid.plans import communities, epidemic, features, neighbourhood, resources
from clinigrid.sources import schemas

WAVES = dims.default_waves()


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame([
        ("1", "1", date(2020, 3, 1), "2020-03-20", 3),
        ("1", "1", date(2020, 3, 2), "9999-99-99", 1),
        ("01", "001", date(2020, 3, 2), "9999-99-99", 2),
        ("1", "1", date(2020, 3, 2), "2020-03-20", 7),
        ("9", "12", date(2021, 1, 1), "2021-01-20", 3),
        ("9", "12", date(2022, 4, 3), "2022-04-20", 3),
        ("9", "12", date(2020, 1, 5), None, 1),
    ], schemas.CASES)


def test_case_fatality(spark, cases):
    got = epidemic.case_fatality(cases, WAVES).collect()
    assert len(got) == 2 * len(WAVES)
    table = {(r["CVEGEO"], r["ola"]): (r["defunciones"], r["casos_totales"], r["cfr"]) for r in got}
    assert table["01001", "01_ola_1"] == (1, 3, pytest.approx(100 / 3))
    assert table["09012", "03_ola_2"] == (1, 1, 100.0)
    # A case before the first week counts to the first wave, one past the last to none.
    assert table["09012", "01_ola_1"] == (0, 1, 0.0)
    assert table["09012", "07_ola_4"] == (0, 0, None)


def test_outcome_shares_add_up(spark, cases):
    got = epidemic.outcome_shares(cases, WAVES)
    assert got.count() == 2 * len(WAVES) * 2
    shares = got.groupBy("CVEGEO", "ola").agg(F.sum("pc").alias("pc"), F.max("casos_totales").alias("n"))
    for row in shares.collect():
        assert row["pc"] == (pytest.approx(100.0) if row["n"] else None)


def test_tests_per_day(spark, cases, rows):
    got = epidemic.tests_per_day(cases, WAVES)
    assert rows(got, "CVEGEO", "ola", "n", "dias_ola", "pruebas_dia_promedio") == [
        ("01001", "01_ola_1", 2, 105, 2 / 105), ("09012", "03_ola_2", 1, 154, 1 / 154),
    ]
    people = spark.createDataFrame([("01001", 10.0)], "CVEGEO string, POBTOT double")
    assert rows(epidemic.tests_per_capita(got, people)) == [
        ("01001", "01_ola_1", pytest.approx(2 / 1050)), ("09012", "03_ola_2", None),
    ]


@pytest.fixture(scope="module")
def census(spark):
    names = [f.split()[0] for f in schemas.CENSUS.split(", ")]
    total = dict(zip(names, ["05", "Coahuila de Zaragoza", "001", "A", "0000", dims.MUNICIPALITY_TOTAL]))
    counts = {n: str(10 * i) for i, n in enumerate(names[6:], start=1)} | {"PDER_IMSS": "*"}
    village = total | counts | {"NOM_LOC": "Village"}
    data = [tuple((row | counts)[n] for n in names) for row in (total, village)]
    return spark.createDataFrame(data, schemas.CENSUS)


@pytest.fixture(scope="module")
def affiliation(spark, census):
    return resources.affiliation_long(census, dims.variable_dictionary(spark))


def test_affiliation_long(affiliation):
    got = {r["variable"]: r for r in affiliation.collect()}
    assert len(got) == 11
    assert got["PDER_IMSS"]["valor"] is None
    assert (got["POBTOT"]["state_id"], got["POBTOT"]["municipality_id"], got["POBTOT"]["state"]) == ("5", "5001", "Coahuila")
    assert got["PDER_SEGP"]["nombre"] == "SSA"


@pytest.fixture(scope="module")
def facilities(spark):
    # (clues, institution, beds, municipality)
    data = [("f1", "IMSS", 10, "A"), ("f2", "IMSS", None, "A"), ("f3", "PEMEX", 1, "A"), ("f4", "SEDENA", 2, "A"),
            ("f5", "CRO", 99, "A"), ("f6", "IMSS", 50, dims.MUNICIPALITY_UNKNOWN), ("f7", "SSA", 3, "Á")]
    return spark.createDataFrame(
        [(c, "5", "Coahuila", "5001", m, "", "", i, i, 0.0, 0.0, 1, b) for c, i, b, m in data],
        schemas.FACILITIES,
    )


@pytest.fixture(scope="module")
def harmonised(spark, facilities):
    resource_rows = spark.createDataFrame([
        ("5", "Coahuila", "5001", "A", "f1", "t", "MÉDICOS", 2021, 4.0),
        ("5", "Coahuila", "5001", "A", "f1", "t", "Personal de enfermería", 2021, 3.0),
        ("5", "Coahuila", "5001", "A", "f1", "t", "Camas", 2021, 7.0),
        ("5", "Coahuila", "5001", "A", "f1", "t", "Médicos", 2020, 9.0),
    ], schemas.RESOURCES)
    staff = resources.facility_staff(resource_rows)
    assert [tuple(r) for r in staff.collect()] == [("f1", 7.0)]
    by_institution = resources.resources_by_institution(facilities, staff)
    return resources.harmonise_institutions(by_institution, dims.institution_dictionary(spark))


def test_harmonised_institutions(rows, harmonised):
    assert rows(harmonised, "municipality", "variable", "camas", "clinicas", "personal") == [
        ("A", "PAFIL_PDOM", 3, 2, 0.0), ("A", "PDER_IMSS", 10, 2, 7.0), ("Á", "PDER_SEGP", 3, 1, 0.0),
    ]


def test_resources_population(spark, rows, affiliation, harmonised):
    got = resources.resources_population(affiliation, harmonised, dims.institution_dictionary(spark))
    table = {r["institucion_inegi"]: r for r in got.collect()}
    assert sorted(table) == sorted(dims.KEPT_VARIABLES)
    assert table["PAFIL_PDOM"]["nombre_institucion"] == dims.MERGED_NAME
    assert (table["PDER_IMSS"]["poblacion"], table["PDER_IMSS"]["camas"]) == (0.0, 10)
    # The other spelling of the municipality finds no population row and is reported.
    assert table["PDER_SEGP"]["camas"] == 0
    missed = resources.unmatched_resources(affiliation, harmonised)
    assert rows(missed, "municipality", "camas") == [("Á", 3)]


def test_units_sizes_and_classes(spark, rows, facilities):
    assert rows(resources.units_by_state(facilities, 2), "state", "institution", "n") == [("Coahuila", "IMSS", 3)]
    classes = resources.state_beds_by_size(facilities, ((100, "mas_diez"),), "menos_tres")
    assert rows(classes.select("institution", "beds", "total_beds", "category")) == [
        ("CRO", 99, 165, "mas_diez"), ("IMSS", 60, 165, "mas_diez"), ("PEMEX", 1, 165, "mas_diez"),
        ("SEDENA", 2, 165, "mas_diez"), ("SSA", 3, 165, "mas_diez"),
    ]


def test_area_facilities_fill_and_stay_strict(spark, rows, affiliation, facilities):
    got = resources.area_facilities(affiliation, facilities)
    # One unknown bed count makes the municipality's sum missing, which then becomes 0.
    assert rows(got, "municipality", "poblacion", "clinics", "beds") == [
        ("A", 10.0, 5, 0), ("Á", 10.0, 1, 3),
    ]


@pytest.fixture(scope="module")
def table(spark):
    data = [(f"{i}", "S", f"100{i}", "M", v, n, n, float(p), c, 1, 2.0)
            for i, values in enumerate(([("PDER_IMSS", "IMSS", 10, 4), ("PDER_SEGP", "SSA", 5, 4)],
                                        [("PDER_IMSS", "IMSS", 20, 0), ("PDER_SEGP", "SSA", 0, 0)],
                                        [("PDER_IMSS", "IMSS", 1, 9), ("PDER_SEGP", "SSA", 2, 1)]), start=1)
            for v, n, p, c in values]
    return spark.createDataFrame(
        data, "state_id string, state string, municipality_id string, municipality string, institucion_inegi string, "
        "institucion string, nombre_institucion string, poblacion double, camas long, clinicas long, personal double",
    )


def test_own_and_neighbours(spark, table):
    edges = spark.createDataFrame([("01001", "01002"), ("01002", "01001"), ("01002", "01003"), ("01003", "01002")], "V1 string, V2 string")
    long = neighbourhood.own_and_neighbours(edges, table)
    got = {(r["CVEGEO"], r["institucion_inegi"], r["variable"]): r for r in long.collect()}
    row = got["01002", "PDER_IMSS", "camas"]
    assert (row["mun"], row["vecino"], row["full"], row["mun_contrib"]) == (0.0, 13.0, 13.0, 0.0)
    assert all(r["full"] == r["mun"] + r["vecino"] for r in got.values())
    wide = neighbourhood.own_and_neighbours_wide(edges, table)
    assert len(wide.columns) == 1 + 4 * 4 * 6
    people = spark.createDataFrame([("01001", 7.0), ("01002", 8.0), ("01003", 9.0)], "CVEGEO string, POBTOT double")
    totals = neighbourhood.neighbourhood_totals(edges, table, people)
    by_area = {r["CVEGEO"]: r for r in totals.collect()}
    assert by_area["01002"]["POBTOT"] == 16.0
    assert by_area["01002"]["camas_PDER_IMSS"] == 13
    assert by_area["01002"]["camas_PDER_ISTE"] is None


def test_communities_of_resources(spark, rows, table):
    members = spark.createDataFrame([("01001", 1), ("01002", 1), ("01003", 2)], "CVEGEO string, community int")
    assert rows(communities.top_institution(members, table, "camas"), "community", "institucion", "camas") == [(1, "IMSS", 4), (1, "SSA", 4), (2, "IMSS", 9)]
    assert rows(communities.contribution_label(members, table)) == [
        (1, "IMSS debe contribuir más camas"), (1, "IMSS mayor contribuyente camas"),
        (2, "SSA debe contribuir más camas"),
    ]
    people = spark.createDataFrame([("01001", 7.0)], "CVEGEO string, POBTOT double")
    scores = {r["CVEGEO"]: r for r in communities.bed_zscore(members, table, people).collect()}
    assert scores["01001"]["z_score"] + scores["01002"]["z_score"] == pytest.approx(0)
    assert scores["01003"]["z_score"] is None and scores["01003"]["camas_comm_sum"] == 10


def test_area_vectors(spark):
    names = ["cfr", "pruebas_dia_capita", "mun_derechohabientes_PDER_IMSS", "POB65_MAS", "POBFEM"]
    data = [("01001", w, float(i), 1.0, 2.0, 3.0, 4.0) for i, w in enumerate(dims.WAVE_LABELS)]
    df = spark.createDataFrame(data, "CVEGEO string, ola string, " + ", ".join(f"{n} double" for n in names))
    assert communities.area_vectors(df).first()["vector"] == [0, 1, 2, 3, 4, 5, 6] + [1] * 7 + [2, 3, 4]


def test_feature_table_drops_empty_columns(spark):
    cfr = spark.createDataFrame([("01001", "03_ola_2", 1.0)], "CVEGEO string, ola string, cfr double")
    shares = spark.createDataFrame([("01001", 50.0)], "CVEGEO string, POBFEM double")
    own = spark.createDataFrame([("01001", None, 1.0), ("09009", 5.0, None)], "CVEGEO string, mun_contrib_a double, mun_b double")
    tests = spark.createDataFrame([("01001", "03_ola_2", 0.1)], "CVEGEO string, ola string, pruebas_dia_capita double")
    got = features.feature_table_v2(cfr, shares, own, tests)
    assert got.columns == ["CVEGEO", "ola", "cfr", "POBFEM", "mun_b", "pruebas_dia_capita"]
    missing = own.unionByName(spark.createDataFrame([("x", None, None)], own.schema))
    more = cfr.unionByName(spark.createDataFrame([("09009", "03_ola_2", 2.0)], cfr.schema))
    filled = features.feature_table_v2(more, shares, missing, tests)
    assert sorted(r["mun_contrib_a"] for r in filled.collect()) == [0.0, 5.0]


def test_scenarios(spark, rows):
    df = spark.createDataFrame([(w,) for w in dims.WAVE_LABELS], "ola string")
    got = features.in_scenarios(df, dims.scenario_table(spark))
    assert rows(got, "scenario", "ola") == [
        ("HTMPI", "03_ola_2"), ("HTPI", "05_ola_3"), ("LTMPI", "02_interola_1"),
        ("LTMPI", "04_interola_2"), ("LTPI", "06_interola_3"),
    ]
