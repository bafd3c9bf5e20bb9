"""Schemas, enumerations and fixed tables of the document-privacy domain."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# --- fixed values: enumerations, in rank order ---
LEVELS = ("faible", "moyen", "eleve", "critique")
ACTIONS = ("complet", "masque", "pseudonymise", "refus")
STATUSES = ("decouvert", "en_analyse", "analyse", "echec")
METHODS = ("regle", "ner", "fusion")
SOURCE_TYPES = ("local", "s3", "gdrive")

# --- fixed values: sensitivity level of each entity type ---
LEVEL_OF_TYPE = {
    "LOCALITE": "faible", "ORGANISATION": "faible", "PRENOM": "faible",
    "NOM_PERSONNE": "moyen", "ADRESSE_POSTALE": "moyen", "EMAIL": "moyen",
    "TELEPHONE": "eleve", "DATE_NAISSANCE": "eleve", "NUM_CLIENT": "eleve", "PLAQUE_IMMAT": "eleve", "ADRESSE_IP": "eleve",
    "NUM_PIECE_IDENTITE": "critique", "IBAN": "critique", "CARTE_BANCAIRE": "critique", "DONNEE_SANTE": "critique",
}
DEFAULT_LEVEL = "moyen"
IDENTIFIER_TYPES = ("DATE_NAISSANCE", "NUM_PIECE_IDENTITE", "IBAN", "CARTE_BANCAIRE")
CONTEXT_WINDOW, CONTEXT_TYPES = 200, 2

# --- fixed values: token prefix of each entity type ---
TOKEN_PREFIX = {
    "NOM_PERSONNE": "PERS", "PRENOM": "PERS", "EMAIL": "MAIL", "TELEPHONE": "TEL", "ADRESSE_POSTALE": "ADR", "LOCALITE": "LIEU",
    "ORGANISATION": "ORG", "IBAN": "IBAN", "CARTE_BANCAIRE": "CB", "NUM_PIECE_IDENTITE": "PIECE", "DATE_NAISSANCE": "DATE",
    "NUM_CLIENT": "CLI", "PLAQUE_IMMAT": "PLAQ",
}
DEFAULT_PREFIX = "DCP"

# --- fixed values: model label to entity type ---
TYPE_OF_LABEL = {
    "PER": "NOM_PERSONNE", "PERSON": "NOM_PERSONNE", "PERS": "NOM_PERSONNE", "LOC": "LOCALITE", "GPE": "LOCALITE", "ORG": "ORGANISATION", "FAC": "LOCALITE",
    "LOCATION": "LOCALITE", "NRP": "LOCALITE", "ORGANIZATION": "ORGANISATION", "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "TELEPHONE", "IBAN_CODE": "IBAN",
    "CREDIT_CARD": "CARTE_BANCAIRE", "DATE_TIME": "DATE_NAISSANCE", "IP_ADDRESS": "ADRESSE_IP",
}

# --- fixed values: the access matrix, role -> actions by level ---
POLICY = {
    "support_n1": ("complet", "masque", "refus", "refus"),
    "support_n2": ("complet", "complet", "masque", "refus"),
    "operations": ("complet", "complet", "pseudonymise", "refus"),
    "conformite": ("complet", "complet", "complet", "complet"),
    "service_partenaire": ("complet", "masque", "refus", "refus"),
    "admin_systeme": ("refus", "refus", "refus", "refus"),
}

ENTITY = T.StructType([
    T.StructField("type_entite", T.StringType()), T.StructField("debut", T.IntegerType()), T.StructField("fin", T.IntegerType()),
    T.StructField("valeur", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("methode", T.StringType()),
    T.StructField("valide", T.BooleanType()),
])
ENTITIES = T.ArrayType(ENTITY)
ENTITIES_DDL = "array<struct<type_entite:string,debut:int,fin:int,valeur:string,score:double,methode:string,valide:boolean>>"

SOURCE = "id string, type string, libelle string, configuration string, frequence_cron string, dernier_scan timestamp, actif boolean"
DOCUMENT = (
    "id string, source_id string, chemin_source string, empreinte_sha256 string, type_mime string, taille_octets bigint, statut string, "
    "niveau_max string, date_decouverte timestamp, date_analyse timestamp, tentatives smallint, motif_echec string"
)
DETECTED = (
    "document_id string, type_entite string, empreinte_valeur string, position_debut int, position_fin int, page smallint, "
    "niveau_sensibilite string, score_confiance float, methode string"
)
AUDIT = (
    "id bigint, horodatage timestamp, utilisateur_id string, role_effectif string, document_id string, action string, politique_appliquee string, "
    "niveau_en_cause string, adresse_ip string, details string, empreinte_precedente string, empreinte string"
)
PSEUDONYM = "empreinte_valeur string, jeton string, valeur_chiffree binary, cree_le timestamp"
SCAN_RUN = "source_id string, demarre_le timestamp, termine_le timestamp, nb_listes int, nb_nouveaux int, nb_inchanges int, nb_echecs int, declencheur string"
ANNOTATION = (
    "id string, chemin string, typeDocument string, partition string, texte string, "
    "entites array<struct<type:string,valeur:string,debut:int,fin:int,niveau:string>>"
)
SCAN_INDEX = "id string, condition string, chemin string, texte string, partition string"


def literal_map(d: dict) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(d.items())))


def rank(level: Column, missing: int = -1) -> Column:
    """Rank of a level, 0 to 3; ``missing`` for another value or null."""
    return F.coalesce(F.try_element_at(literal_map({n: i for i, n in enumerate(LEVELS)}), level), F.lit(missing))


def level_of(type_entite: Column) -> Column:
    """Level of an entity type, whatever its case; 'moyen' when unknown."""
    return F.coalesce(F.try_element_at(literal_map(LEVEL_OF_TYPE), F.upper(type_entite)), F.lit(DEFAULT_LEVEL))


def policy_matrix(spark: SparkSession) -> DataFrame:
    """The 24 cells (role, niveau, action, rang)."""
    rows = [(r, n, a, k) for r, actions in POLICY.items() for k, (n, a) in enumerate(zip(LEVELS, actions, strict=True))]
    return spark.createDataFrame(rows, "role string, niveau string, action string, rang int")
