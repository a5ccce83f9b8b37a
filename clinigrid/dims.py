"""Small dimension tables, held as data so that callers can pass their own."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

from clinigrid.session import literal_table


@dataclass(frozen=True)
class Wave:
    """One epidemic wave: week ordinals from ``start`` up to, not including, ``stop``."""

    ola: str
    start: int
    stop: int
    dias_ola: int


# Wave labels, first week ordinal of each wave, first dropped ordinal.
WAVE_LABELS = (
    "01_ola_1", "02_interola_1", "03_ola_2", "04_interola_2",
    "05_ola_3", "06_interola_3", "07_ola_4",
)
WAVE_STOPS = (24, 35, 57, 68, 86, 94, 111)
# Fixed value: the first wave's test days are counted from week 9, not ordinal 1.
FIRST_WAVE_WEEK = 9
# Fixed value: Sunday that opens week ordinal 1 (epidemiological week 2020-09).
WAVE_ANCHOR = date(2020, 2, 23)


def default_waves() -> list[Wave]:
    starts = (FIRST_WAVE_WEEK, *WAVE_STOPS[:-1])
    ordinals = (1, *WAVE_STOPS[:-1])
    return [
        Wave(label, first, stop, (stop - start) * 7)
        for label, first, start, stop in zip(WAVE_LABELS, ordinals, starts, WAVE_STOPS)
    ]


def wave_table(spark: SparkSession, waves: list[Wave], anchor: date = WAVE_ANCHOR) -> DataFrame:
    rows = [
        (w.ola, w.start, w.stop - 1, anchor + timedelta(weeks=w.start - 1),
         anchor + timedelta(weeks=w.stop - 1, days=-1), w.dias_ola)
        for w in waves
    ]
    return literal_table(
        spark, rows,
        "ola string, first_ord int, last_ord int, first_day date, last_day date, dias_ola int",
    )


# Modelling scenario of each wave; the first and last wave take no part.
SCENARIOS = {
    "HTMPI": ("03_ola_2",),
    "LTMPI": ("02_interola_1", "04_interola_2"),
    "HTPI": ("05_ola_3",),
    "LTPI": ("06_interola_3",),
}

# Census affiliation variables and their display names.
VARIABLE_NAMES = {
    "POBTOT": "Población Total",
    "PSINDER": "Sin afiliación",
    "PDER_SS": "Con afiliación",
    "PDER_IMSS": "IMSS",
    "PDER_ISTE": "ISSSTE",
    "PDER_ISTEE": "ISSSTE estatal",
    "PAFIL_PDOM": "PEMEX, SEDENA, SEMAR",
    "PDER_SEGP": "SSA",
    "PDER_IMSSB": "IMSS-BIENESTAR",
    "PAFIL_IPRIV": "SMP",
    "PAFIL_OTRAI": "Otro",
}

# Provider code -> (full name, census variable).
INSTITUTIONS = {
    "CIJ": ("Centros de Integración Juvenil", "PAFIL_OTRAI"),
    "CRO": ("Cruz Roja Mexicana", "PAFIL_OTRAI"),
    "DIF": ("Sistema Nacional para el Desarrollo Integral de la Familia", "PAFIL_OTRAI"),
    "FGE": ("Fiscalía General del Estado", "PAFIL_OTRAI"),
    "HUN": ("Servicios Médicos Universitarios", "PAFIL_OTRAI"),
    "IMSS": ("Instituto Mexicano del Seguro Social", "PDER_IMSS"),
    "IMSS-BIENESTAR": ("IMSS-Bienestar", "PDER_IMSSB"),
    "ISSSTE": (
        "Instituto de Seguridad y Servicios Sociales de los Trabajadores del Estado",
        "PDER_ISTE",
    ),
    "PEMEX": ("Pemex", "PAFIL_PDOM"),
    "PGR": ("Procuraduría General de la República", "PAFIL_OTRAI"),
    "SCT": ("Secretaría de Comunicaciones y Transportes", "PAFIL_OTRAI"),
    "SEDENA": ("Secretaría de la Defensa Nacional", "PAFIL_PDOM"),
    "SEMAR": ("Secretaría de Marina", "PAFIL_PDOM"),
    "SME": ("Servicios Médicos Estatales", "PAFIL_OTRAI"),
    "SMM": ("Servicios Médicos Municipales", "PAFIL_OTRAI"),
    "SMP": ("Servicios Médicos Privados", "PAFIL_IPRIV"),
    "SSA": ("Secretaría de Salud", "PDER_SEGP"),
}

# The "other" variable that leaves the analysis, and the merged provider group.
OTHER_VARIABLE = "PAFIL_OTRAI"
MERGED_VARIABLE = "PAFIL_PDOM"
MERGED_NAME = "Pemex, Secretaría de la Defensa Nacional, Secretaría de Marina"
# Fixed value: this census variable has no provider of its own and counts as "other".
STATE_ISSSTE_VARIABLE = "PDER_ISTEE"
# Affiliation totals that are no institution.
AFFILIATION_TOTALS = ("PSINDER", "PDER_SS", "POBTOT")
# The six variables that stay, in alphabetical order.
KEPT_VARIABLES = (
    "PAFIL_IPRIV", "PAFIL_PDOM", "PDER_IMSS", "PDER_IMSSB", "PDER_ISTE", "PDER_SEGP",
)
# State id -> short state name.
SHORT_STATE_NAMES = {"5": "Coahuila", "16": "Michoacán", "30": "Veracruz"}
# What is said of the institution with most affiliates of a community.
MOST_BEDS_LABEL = " mayor contribuyente camas"
MORE_BEDS_LABEL = " debe contribuir más camas"
# Row label of municipality totals, and of facilities without a municipality.
MUNICIPALITY_TOTAL = "Total del Municipio"
MUNICIPALITY_UNKNOWN = "No Informado"

# Lower bounds (exclusive) and labels of the size classes.
BED_SIZE_CLASSES = ((10000, "mas_diez"), (5000, "mas_cinco"), (3000, "mas_tres"))
BED_SIZE_DEFAULT = "menos_tres"
BED_SIZE_TITLES = {
    "mas_diez": "Más de diez mil camas",
    "mas_cinco": "Entre 5 mil y 10 mil camas",
    "mas_tres": "Entre 3 mil y 5 mil camas",
    "menos_tres": "Menos de 3 mil camas",
}
RESOURCE_SIZE_CLASSES = ((5000, "mas_cinco"), (3000, "mas_tres"), (1000, "mas_mil"))
RESOURCE_SIZE_DEFAULT = "menos_mil"
# Case-insensitive patterns that name a resource type, first match wins.
RESOURCE_TYPES = (("cama", "camas"), ("personal|médico", "personal"))
RESOURCE_TYPE_DEFAULT = "otro"
STAFF_PATTERN = "personal|médico"


def variable_dictionary(spark: SparkSession, names: dict[str, str] = VARIABLE_NAMES) -> DataFrame:
    return literal_table(spark, list(names.items()), "variable string, nombre string")


def institution_dictionary(
    spark: SparkSession, entries: dict[str, tuple[str, str]] = INSTITUTIONS
) -> DataFrame:
    rows = [(code, name, variable) for code, (name, variable) in entries.items()]
    return literal_table(
        spark, rows, "institution string, nombre_institucion string, variable string"
    )


def scenario_table(spark: SparkSession, scenarios: dict[str, tuple[str, ...]] = SCENARIOS) -> DataFrame:
    rows = [(name, ola) for name, olas in scenarios.items() for ola in olas]
    return literal_table(spark, rows, "scenario string, ola string")
