"""Declared schemas of the landed tables. Nothing is inferred: keys keep leading zeros."""

FACILITIES = (
    "clues string, state_id string, state string, municipality_id string, "
    "municipality string, areas string, establishment_type string, institution_id string, "
    "institution string, latitud double, longitud double, clinics long, beds long"
)
RESOURCES = (
    "state_id string, state string, municipality_id string, municipality string, "
    "clues string, type string, resources_categories string, year int, total double"
)
CENSUS = (
    "ENTIDAD string, NOM_ENT string, MUN string, NOM_MUN string, LOC string, NOM_LOC string, "
    "POBTOT string, PSINDER string, PDER_SS string, PDER_IMSS string, PDER_ISTE string, "
    "PDER_ISTEE string, PAFIL_PDOM string, PDER_SEGP string, PDER_IMSSB string, "
    "PAFIL_IPRIV string, PAFIL_OTRAI string"
)
CENSUS_DEMOGRAPHY = (
    "ENTIDAD string, NOM_ENT string, MUN string, NOM_MUN string, LOC string, NOM_LOC string, "
    "POBTOT string, POBFEM string, POB0_14 string, POB15_64 string, POB65_MAS string"
)
CASES = (
    "ENTIDAD_RES string, MUNICIPIO_RES string, FECHA_SINTOMAS date, FECHA_DEF string, "
    "CLASIFICACION_FINAL int"
)
POPULATION = (
    "state_id string, state string, municipality_id string, municipality string, "
    "variable string, valor double, nombre string"
)
FATALITY = "CVEGEO string, ola string, defunciones double, casos_totales double, cfr double"
TESTS = (
    "CVEGEO string, ola string, dias_ola int, n double, pruebas_dia_promedio double"
)
RESOURCES_POPULATION = (
    "state_id string, state string, municipality_id string, municipality string, "
    "institucion_inegi string, institucion string, nombre_institucion string, "
    "poblacion double, camas double, clinicas double, personal double"
)
EDGES = "V1 string, V2 string, weight double"
VERTICES = "geo_id string, part int, ring int, seq int, x double, y double"
