"""A synthetic corpus with exact annotations: values and documents as columns, drawn from a seed and the row's id.

A document is a list of pieces, plain text or fields; text and spans come from the same list, so a span is right by
construction.  Numbers carry true check digits: modulo 97 in an IBAN, Luhn's in a card.  All of it is SQL text that
Spark and DuckDB both read (only the draw of a number differs), so the corpus itself has an oracle.  Making a document
needs its row alone: no shuffle, and any row can be made again by itself.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from privlake.functions.spans import entries, once
from privlake.operators import catalog, detect, evaluate, merge
from privlake.plans.registry import query, rows, spread, today
from privlake.schema import LEVEL_OF_TYPE

SEED = 42
_FIRST = ("Awa", "Moussa", "Fatou", "Kofi", "Adjoa", "Ibrahima", "Mariam", "Yao", "Sena", "Rokia", "Ousmane", "Esi")
_LAST = ("Diouf", "Ndiaye", "Mensah", "Kouassi", "Traore", "Sow", "Agbeko", "Dossou", "Toure", "Amoah")
_CITY = ("Dakar", "Cotonou", "Abidjan", "Lome", "Accra", "Kaolack", "Porto-Novo", "Ziguinchor")
_FIRM = ("Navettes du Fleuve", "Teranga Colis", "Comptoir du Golfe", "Atelier Baobab", "Lagune Express")
_STREET = ("rue", "avenue", "boulevard", "impasse")
_PLACE = ("des Manguiers", "du Marché", "de la Gare", "des Pêcheurs", "du Phare")
_MONTH = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")


def _spark_draw(slot: str, n: int) -> str:
    return f"(cast(conv(substr(md5(concat('{SEED}:', cast(id AS string), ':{slot}')), 1, 12), 16, 10) AS bigint) % {n})"


def _duck_draw(slot: str, n: int) -> str:
    return f"(('0x' || substr(md5('{SEED}:' || id || ':{slot}'), 1, 12))::bigint % {n})"


def _values(draw) -> dict[str, dict[str, str]]:
    """Columns in layers: each layer may use those before it."""
    pick = lambda slot, words: f"split_part('{'|'.join(words)}', '|', cast(1 + {draw(slot, len(words))} AS int))"
    text = lambda x: f"cast({x} AS varchar(40))"
    digits = lambda slot, n: f"lpad({text(draw(slot, 10**n))}, {n}, '0')"
    letters = lambda slot: "concat(" + ", ".join(f"substr('ABCDEFGHJKLMNPQRSTVWXYZ', cast(1 + {draw(slot + k, 23)} AS int), 1)" for k in "ab") + ")"
    digit = lambda x, p: f"cast(substr({x}, {p}, 1) AS int)"

    def luhn(x: str, n: int) -> str:
        """Luhn's check digit for the ``n`` digits of a column."""
        double = lambda p: f"(2 * {digit(x, p)} - CASE WHEN {digit(x, p)} > 4 THEN 9 ELSE 0 END)"
        total = " + ".join(double(p) if (n - p) % 2 == 0 else digit(x, p) for p in range(1, n + 1))
        return f"((10 - ({total}) % 10) % 10)"

    number = lambda x, a, n: f"cast(substr({x}, {a}, {n}) AS bigint)"
    return [
        {
            "prenom": pick("prenom", _FIRST), "famille": pick("famille", _LAST), "ville": pick("ville", _CITY), "ville2": pick("ville2", _CITY), "societe": pick("societe", _FIRM),
            "jour": f"cast(1 + {draw('jour', 28)} AS int)", "mois": f"cast(1 + {draw('mois', 12)} AS int)", "annee": f"cast(1960 + {draw('annee', 45)} AS int)", "ecrit": draw("ecrit", 3),
            "client": f"concat('CL-', {digits('client', 6)})", "plaque": f"concat({letters('plaque1')}, '-', {digits('plaque', 4)}, '-', {letters('plaque2')})",
            "bban": f"concat({digits('bban1', 11)}, {digits('bban2', 11)})", "cb": f"concat('4970', {digits('cb', 11)})", "ni": f"concat({text('1 + ' + draw('genre', 2))}, {digits('ni', 11)})",
            "adresse": f"concat({text('1 + ' + draw('numero', 250))}, ' ', {pick('voie', _STREET)}, ' ', {pick('lieu', _PLACE)})",
            "tel": f"concat('+221 7', {pick('reseau', '0678')}, ' ', {digits('tel1', 2)}, ' ', {digits('tel2', 2)}, ' ', {digits('tel3', 2)}, ' ', {digits('tel4', 1)})",
            "separe": f"split_part('.|_|', '|', cast(1 + {draw('separe', 3)} AS int))", "domaine": pick("domaine", ("exemple.sn", "boite.bj", "lettre.tg")),
        },
        {
            "nom": "concat(prenom, ' ', famille)", "mail": "concat(lower(prenom), separe, lower(famille), '@', domaine)",
            "ne": f"CASE ecrit WHEN 0 THEN concat({text('jour')}, ' ', split_part('{'|'.join(_MONTH)}', '|', mois), ' ', {text('annee')}) "
            f"WHEN 1 THEN concat(lpad({text('jour')}, 2, '0'), '-', lpad({text('mois')}, 2, '0'), '-', {text('annee')}) ELSE concat(lpad({text('jour')}, 2, '0'), '/', lpad({text('mois')}, 2, '0'), '/', {text('annee')}) END",
            # SNkk SN + 22 digits: the country and 00 go to the end, letters count from ten
            "cle": f"98 - (((({number('bban', 1, 11)} + 282300000000000) % 97 * 100000000000 + {number('bban', 12, 11)}) % 97 * 1000000 + 282300) % 97)",
            "carte": f"concat(substr(cb, 1, 4), ' ', substr(cb, 5, 4), ' ', substr(cb, 9, 4), ' ', substr(cb, 13, 3), {text(luhn('cb', 15))})",
            # an identity number that would pass Luhn's check too would read as a card
            "piece": f"concat(ni, {text('(' + luhn('ni', 12) + ' + 1) % 10')})",
        },
        {"iban": f"concat('SN', lpad({text('cle')}, 2, '0'), 'SN', bban)"},
    ]


#: field -> entity type
TYPE_OF = {
    "nom": "NOM_PERSONNE", "ville": "LOCALITE", "ville2": "LOCALITE", "societe": "ORGANISATION", "adresse": "ADRESSE_POSTALE", "mail": "EMAIL", "tel": "TELEPHONE",
    "ne": "DATE_NAISSANCE", "client": "NUM_CLIENT", "plaque": "PLAQUE_IMMAT", "piece": "NUM_PIECE_IDENTITE", "iban": "IBAN", "carte": "CARTE_BANCAIRE",
}
#: What rules alone find with exact limits; names, places and firms need a model, addresses have looser limits.
BY_RULE = ("EMAIL", "TELEPHONE", "DATE_NAISSANCE", "NUM_CLIENT", "PLAQUE_IMMAT", "NUM_PIECE_IDENTITE", "IBAN", "CARTE_BANCAIRE")
# --- fixed values: the names of the eight document types ---
#: document type -> pieces; a field's name stands for its value
TEMPLATES = {
    "attestation": ("Domicile de ", "nom", ", né(e) le ", "ne", " : ", "adresse", " ; ", "ville", ".\nJoindre par ", "tel", " ou ", "mail", ".\nSigné le 12/03/2026 à ", "ville2", ".\n"),
    "contrat": ("Prestataire : ", "societe", " (", "ville", ").\nClient : ", "nom", ", né(e) le ", "ne", ", CNI ", "piece", ", ", "adresse", ".\nPaiement sur ", "iban", ", avis à ", "mail", ".\n"),
    "formulaire_enrolement": ("Candidat | ", "nom", "\nNaissance | ", "ne", " | ", "ville", "\nCNI | ", "piece", "\nAdresse | ", "adresse", "\nTel | ", "tel", "\nMail | ", "mail", "\nVehicule | ", "plaque", "\nCompte | ", "iban", "\n"),
    "courrier": ("societe", ", ", "ville", "\nSuite du dossier n° ", "client", ".\nVotre lettre nomme ", "nom", " (", "tel", ") ; remboursement annoncé à ", "mail", ".\n"),
    "piece_identite": ("Carte nationale\nTitulaire ", "nom", "\nLe ", "ne", " à ", "ville", "\nCNI ", "piece", "\nLogement ", "adresse", "\n"),
    "releve_bancaire": ("Extrait ", "societe", "\nPour ", "nom", ", ", "adresse", "\nIBAN ", "iban", "\nCarte ", "carte", "\n03/02/26 Course 4500 FCFA\n"),
    "note_service": ("Aux équipes ", "societe", ", ", "ville", ".\nOuverture de 8h à 17h, demandes après 16h reportées au jour suivant.\nDirection de ", "ville2", "\n"),
    "accuse_reception": ("societe", " a reçu la demande de ", "nom", ".\nRéponse à ", "mail", " sous cinq jours. ", "ville", "\n"),
}


def _piece(p: str) -> str:
    return p if p in TYPE_OF else "'" + p.replace("\n", "¶") + "'"


def _whole(pieces: tuple[str, ...]) -> str:
    return "concat(" + ", ".join([*map(_piece, pieces), "''"]) + ")"


def _text_sql() -> str:
    return "CASE gabarit " + " ".join(f"WHEN {k} THEN {_whole(t)}" for k, t in enumerate(TEMPLATES.values())) + " END"


def _name_sql() -> str:
    return f"split_part('{'|'.join(TEMPLATES)}', '|', gabarit + 1)"


def _used() -> dict[str, set[int]]:
    """Column -> numbers of the document types that have it, itself or in a field made of it."""
    layers, of = _values(_spark_draw), {f: {k for k, t in enumerate(TEMPLATES.values()) if f in t} for f in TYPE_OF}
    for layer in reversed(layers):
        for name, x in layer.items():
            for word in set(re.findall(r"\b[a-z]\w*\b", re.sub("'[^']*'", "", x))):
                of.setdefault(word, set()).update(of.get(name, ()))
    return of


def _apart(name: str) -> Column:
    """The column, through a lambda: Spark then makes its projection's code in many methods, else in one that is too
    long for the machine's compiler and so is interpreted."""
    return once(F.col(name), lambda x: x).alias(name)


def documents(ids: DataFrame) -> DataFrame:
    """(id, type_document, texte, entites) for each ``id``; entites: type, valeur, debut, fin, niveau.

    A value is made once, where the document's type has it; a place is the sum of the lengths before it.
    """
    d, used = ids.select("id", F.expr(f"cast(id % {len(TEMPLATES)} AS int) AS gabarit")), _used()
    for layer in _values(_spark_draw):
        d = d.select(_apart("id"), *d.columns[1:], *[F.expr(f"CASE WHEN gabarit IN ({', '.join(map(str, sorted(used[name])))}) THEN {x} END AS {name}") for name, x in layer.items()])
    d = d.select(_apart("id"), *d.columns[1:], *[F.length(f).alias(f"n_{f}") for f in TYPE_OF])
    cases = []
    for k, pieces in enumerate(TEMPLATES.values()):
        spans, plain, before = [], 0, ""
        for p in pieces:
            if p in TYPE_OF:
                at = f"{plain}{before}"
                spans.append(f"named_struct('type', '{TYPE_OF[p]}', 'valeur', {p}, 'debut', {at}, 'fin', {at} + n_{p}, 'niveau', '{LEVEL_OF_TYPE[TYPE_OF[p]]}')")
                before += f" + n_{p}"
            else:
                plain += len(p)
        cases.append(f"WHEN {k} THEN array({', '.join(spans)})")
    entites = F.expr(f"CASE gabarit {' '.join(cases)} ELSE array() END").cast("array<struct<type:string,valeur:string,debut:int,fin:int,niveau:string>>")
    return d.select(_apart("id"), F.expr(_name_sql()).alias("type_document"), F.translate(F.expr(_text_sql()), "¶", "\n").alias("texte"), entites.alias("entites"))


def oracle_rows() -> str:
    """DuckDB SQL: WITH clauses v (values), t (texts) and s (spans) over ``customer``."""
    layers = _values(_duck_draw)
    sql = f"v0 AS (SELECT c_custkey AS id, (c_custkey % {len(TEMPLATES)})::int AS gabarit FROM customer)"
    for k, layer in enumerate(layers, 1):
        sql += f", v{k} AS (SELECT *, {', '.join(f'{x} AS {name}' for name, x in layer.items())} FROM v{k - 1})"
    last = f"v{len(layers)}"
    sql += f", t AS (SELECT id, {_name_sql()} AS type_document, translate({_text_sql()}, '¶', chr(10)) AS texte FROM {last})"
    spans = []
    for k, pieces in enumerate(TEMPLATES.values()):
        for i, p in enumerate(pieces):
            if p in TYPE_OF:
                before = f"length({_whole(pieces[:i])})"
                spans.append(f"SELECT id, '{TYPE_OF[p]}' AS type, {p} AS valeur, ({before})::int AS debut, ({before} + length({p}))::int AS fin, '{LEVEL_OF_TYPE[TYPE_OF[p]]}' AS niveau FROM {last} WHERE gabarit = {k}")
    return f"WITH {sql}, s AS ({' UNION ALL '.join(spans)})"


def _made(spark, d) -> DataFrame:
    return documents(spread(rows(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id"))


@query(f"{oracle_rows()} SELECT id, type_document, texte FROM t")
def corpus_texts(spark, d):
    """A document for each customer, of eight types in turn."""
    return _made(spark, d).drop("entites")


@query(f"{oracle_rows()} SELECT s.id, type, valeur, debut, fin, niveau, true AS exact FROM s")
def corpus_annotations(spark, d):
    """Every annotation, and that the text has the value where it says."""
    e = _made(spark, d).select("id", "texte", F.inline(entries(F.col("entites"))))
    return e.withColumn("exact", F.substr("texte", F.col("debut") + 1, F.col("fin") - F.col("debut")) == F.col("valeur")).drop("texte")


@query(f"""{oracle_rows()} SELECT type AS type_entite, count(*)::bigint AS attendus, (CASE WHEN type IN ({', '.join(f"'{x}'" for x in BY_RULE)}) THEN count(*) ELSE 0 END)::bigint AS trouves FROM s
WHERE type <> 'ADRESSE_POSTALE' GROUP BY type""")
def corpus_recall(spark, d):
    """Exact recall of the rules by type: whole for what has a form, none for names."""
    made = catalog.materialise(_made(spark, d))
    number = lambda df, c: df.select("doc", "type_entite", "debut", "fin", F.monotonically_increasing_id().alias(c))
    wanted = catalog.materialise(number(made.select(F.col("id").cast("string").alias("doc"), F.inline(entries(F.col("entites")))).withColumnRenamed("type", "type_entite"), "i"))
    found = merge.analyse(detect.detect(made.select("id", "texte"), today=today())).select(F.col("id").cast("string").alias("doc"), F.inline(entries(F.col("entites"))))
    hits = evaluate.match(wanted, catalog.materialise(number(found, "j")))
    r = wanted.join(hits.select("doc", "i", F.lit(1).alias("oui")), ["doc", "i"], "left").where("type_entite <> 'ADRESSE_POSTALE'")
    return r.groupBy("type_entite").agg(F.count(F.lit(1)).alias("attendus"), F.count("oui").alias("trouves"))
