"""Queries over an annotated corpus: a letter for every customer, written together with its entities.

A letter is a list of pieces, plain text or fields; the same list gives the text
and, from the lengths of the pieces before it, the place of every field, in SQL
that both engines know.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from privlake.functions import text as tx
from privlake.functions.spans import entries
from privlake.operators import catalog, detect, evaluate, merge, protect, statistics as st
from privlake.plans import analysis, reports
from privlake.plans.registry import SALT, query, rows, spread, today
from privlake.schema import ENTITIES_DDL, LEVEL_OF_TYPE, policy_matrix

#: field -> (entity type, value)
FIELDS = {
    "nom": ("NOM_PERSONNE", "c_name"),
    "ne": ("DATE_NAISSANCE", "concat(lpad(cast(1 + c_custkey % 28 AS string), 2, '0'), '/', lpad(cast(1 + c_custkey % 12 AS string), 2, '0'), '/', cast(1940 + c_custkey % 60 AS string))"),
    "piece": ("NUM_PIECE_IDENTITE", "concat('1', lpad(cast(c_custkey AS string), 12, '0'))"),
    "mail": ("EMAIL", "concat('client', cast(c_custkey AS string), '@exemple.sn')"),
    "tel": ("TELEPHONE", "concat('+22177', lpad(cast(c_custkey % 10000000 AS string), 7, '0'))"),
    "iban": ("IBAN", "'SN91SN0100152000048500000765'"),
    "carte": ("CARTE_BANCAIRE", "'4539578763621486'"),
}
#: All fields; and a short letter without what is critical.
WHOLE = ("'Client : '", "nom", "'. Né le '", "ne", "', CNI '", "piece", "'. Courriel '", "mail", "', tél '", "tel", "'. Compte '", "iban", "', carte '", "carte", "' fin'")
SHORT = ("'Bonjour '", "nom", "', né le '", "ne", "'. Répondre à '", "mail", "' ou au '", "tel", "'. Merci.'")
BY_RULES = tuple(f for f in FIELDS if f != "nom")


def _value(piece: str) -> str:
    return FIELDS[piece][1] if piece in FIELDS else piece


def text_of(letter: tuple[str, ...]) -> str:
    return "concat(" + ", ".join(map(_value, letter)) + ")"


def spans_of(letter: tuple[str, ...], fields: tuple[str, ...] = BY_RULES) -> str:
    """SQL rows (c_custkey, type_entite, debut, fin, valeur, niveau) of a letter's fields."""
    out = []
    for i, f in enumerate(letter):
        if f in fields:
            kind, value = FIELDS[f]
            before = f"length(concat({', '.join(map(_value, letter[:i]))}))"
            out.append(f"SELECT c_custkey, '{kind}' AS type_entite, ({before})::int AS debut, ({before} + length({value}))::int AS fin, {value} AS valeur, '{LEVEL_OF_TYPE[kind]}' AS niveau FROM customer")
    return " UNION ALL ".join(out)


def letters(spark, d, letter: tuple[str, ...] = WHOLE) -> DataFrame:
    """(c_custkey, id, c_mktsegment, texte)."""
    return spread(rows(spark, d, "customer"), "c_custkey").select("c_custkey", F.col("c_custkey").cast("string").alias("id"), "c_mktsegment", F.expr(text_of(letter)).alias("texte"))


def annotations(spark, d, letter: tuple[str, ...] = WHOLE, fields: tuple[str, ...] = tuple(FIELDS)) -> DataFrame:
    """(c_custkey, type, debut, fin, valeur, niveau), a row for each field."""
    # each value is made once, in a projection of its own; a place is the sum of the lengths before it
    made = spread(rows(spark, d, "customer"), "c_custkey").select("c_custkey", *[F.expr(FIELDS[f][1]).alias(f) for f in letter if f in FIELDS])
    one, before = [], F.lit(0)
    for f in letter:
        value = F.col(f) if f in FIELDS else F.expr(f)
        after = before + F.length(value)
        if f in fields:
            kind = FIELDS[f][0]
            one.append(F.struct(F.lit(kind).alias("type"), value.alias("valeur"), before.alias("debut"), after.alias("fin"), F.lit(LEVEL_OF_TYPE[kind]).alias("niveau")))
        before = after
    return made.select("c_custkey", F.explode(F.array(*one)).alias("e")).select("c_custkey", "e.*")


@query(f"SELECT c_custkey, type_entite, debut, fin, valeur, niveau, 'regle' AS methode, 'critique' AS niveau_max FROM ({spans_of(WHOLE)})")
def letter_entities(spark, d):
    """Detection, arbitration and classification find exactly what was written."""
    done = merge.analyse(detect.detect(letters(spark, d), today=today()))
    return done.select("c_custkey", "niveau_max", F.inline(entries(F.col("entites")))).drop("score", "valide")


@query(f"SELECT c_custkey::varchar AS document_id, type_entite, sha256(lower(valeur) || '{SALT}') AS empreinte_valeur, debut AS position_debut, fin AS position_fin, niveau AS niveau_sensibilite, 'regle' AS methode FROM ({spans_of(SHORT)})")
def letter_rows(spark, d):
    """Rows of the entity table, from untidy texts: positions are those of the normalised text."""
    untidy = letters(spark, d, SHORT).withColumn("texte", F.replace("texte", F.lit(" "), F.lit(" \t ")))
    return analysis.detected_rows(analysis.analyse_texts(untidy, today=today()), SALT).drop("page", "score_confiance")


@query(f"SELECT c_custkey, type_entite, (debut + 2 * n)::int AS debut, (fin + 2 * n)::int AS fin FROM (SELECT *, length({text_of(SHORT)}) - length(replace(substr({text_of(SHORT)}, 1, debut), ' ', '')) - (length({text_of(SHORT)}) - debut) AS n FROM (SELECT c.*, s.* EXCLUDE (c_custkey) FROM customer c JOIN ({spans_of(SHORT)}) s USING (c_custkey)))")
def source_spans(spark, d):
    """The same entities in positions of the untidy source."""
    untidy = letters(spark, d, SHORT).withColumn("texte", F.replace("texte", F.lit(" "), F.lit(" \t ")))
    done = analysis.source_positions(analysis.analyse_texts(untidy, today=today()))
    return done.select("c_custkey", F.inline(entries(F.col("entites")))).select("c_custkey", "type_entite", "debut", "fin")


_NOISY = "concat('Reçu de client', cast(c_custkey AS string), ' @exemple .sn le compte SN92SN0100152000048500000765 et la carte 4539578763621487 du ', " + FIELDS["ne"][1] + ", ' fin')"


@query(f"""WITH t AS (SELECT c_custkey, 'client' || c_custkey || ' @exemple .sn' AS m, {FIELDS['ne'][1]} AS ne FROM customer)
SELECT c_custkey, 'EMAIL' AS type_entite, m AS valeur, 8 AS debut, 97::int AS score, false AS valide FROM t
UNION ALL SELECT c_custkey, 'IBAN', 'SN92SN0100152000048500000765', (8 + length(m) + 11)::int, 90, false FROM t
UNION ALL SELECT c_custkey, 'CARTE_BANCAIRE', '4539578763621487', (8 + length(m) + 11 + 28 + 13)::int, 90, false FROM t
UNION ALL SELECT c_custkey, 'DATE_NAISSANCE', ne, (8 + length(m) + 11 + 28 + 13 + 16 + 4)::int, 99, true FROM t""")
def ocr_letter_entities(spark, d):
    """Misread numbers stay with less certainty; an address torn apart is found on the repaired text and led back."""
    noisy = spread(rows(spark, d, "customer"), "c_custkey").select("c_custkey", F.expr(_NOISY).alias("texte"))
    done = detect.detect_ocr(noisy, today=today()).select("c_custkey", F.inline(merge.arbitrate(F.col("candidats"))))
    return done.select("c_custkey", "type_entite", "valeur", "debut", F.round(F.col("score") * 100).cast("int").alias("score"), "valide")


_FAR = "repeat('x ', CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 150 END)"


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'eleve' ELSE 'moyen' END AS niveau, 'ner' AS methode FROM customer")
def names_in_context(spark, d):
    """A person's name rises near two kinds of identifiers, not 300 characters away."""
    text = f"concat({FIELDS['nom'][1]}, ' ', {_FAR}, {FIELDS['ne'][1]}, ', CNI ', {FIELDS['piece'][1]})"
    docs = spread(rows(spark, d, "customer"), "c_custkey").select("c_custkey", "c_name", F.expr(text).alias("texte"))
    name = F.array(F.struct(F.lit("NOM_PERSONNE"), F.lit(0), F.length("c_name"), F.col("c_name"), F.lit(0.85), F.lit("ner"), F.lit(False))).cast(ENTITIES_DDL)
    docs = detect.detect(docs, today=today()).withColumn("candidats", detect.union_of([F.col("candidats"), name]))
    return merge.analyse(docs).select("c_custkey", F.inline(entries(F.col("entites")))).where("type_entite = 'NOM_PERSONNE'").select("c_custkey", "niveau", "methode")


def _token(field: str, prefix: str) -> str:
    return f"concat('{prefix}-', upper(substr(sha256(lower({FIELDS[field][1]}) || '{SALT}'), 1, 4)))"


_WRITTEN = "concat(" + ", ".join({"ne": "{ne}", "tel": "{tel}"}.get(p, _value(p)) for p in SHORT) + ")"
_MASKED = _WRITTEN.format(ne=f"concat(substr({FIELDS['ne'][1]}, 1, 1), '•/', substr({FIELDS['ne'][1]}, 4, 1), '•/', substr({FIELDS['ne'][1]}, 7, 1), '•••')", tel="'+2•••••••••••'")


@query(f"""SELECT c_custkey::varchar AS document_id, role, code, contenu FROM (
SELECT c_custkey, 'operations' AS role, 200 AS code, {_WRITTEN.format(ne=_token('ne', 'DATE'), tel=_token('tel', 'TEL'))} AS contenu FROM customer
UNION ALL SELECT c_custkey, 'support_n2', 200, {_MASKED} FROM customer UNION ALL SELECT c_custkey, 'conformite', 200, {text_of(SHORT)} FROM customer
UNION ALL SELECT c_custkey, 'support_n1', 403, NULL FROM customer UNION ALL SELECT c_custkey, 'inconnu', 403, NULL FROM customer)""")
def restituted_letters(spark, d):
    """Whole, masked or with tokens, by role; entities below the document's own level stay."""
    docs = letters(spark, d, SHORT)
    done = catalog.materialise(merge.analyse(detect.detect(docs, today=today())))
    known = done.select("id", F.lit("analyse").alias("statut"), "niveau_max")
    roles = F.array(*map(F.lit, ("operations", "support_n2", "conformite", "support_n1", "inconnu")))
    requests = docs.select(F.explode(roles).alias("role"), F.col("id").alias("document_id"))
    return analysis.restitute(requests, known, done, policy_matrix(spark), SALT).select("document_id", "role", "code", "contenu")


@query(f"""SELECT DISTINCT sha256(lower(valeur) || '{SALT}') AS empreinte_valeur, valeur AS clair, (CASE type_entite WHEN 'DATE_NAISSANCE' THEN 'DATE' WHEN 'EMAIL' THEN 'MAIL' ELSE 'TEL' END) || '-' || upper(substr(sha256(lower(valeur) || '{SALT}'), 1, 4)) AS jeton
FROM ({spans_of(SHORT)})""")
def pseudonym_table(spark, d):
    """A row for each value, which only the key gives back."""
    done = merge.analyse(detect.detect(letters(spark, d, SHORT), today=today()))
    one = protect.with_hashes(done.select(F.explode(entries(F.col("entites"))).alias("e")), SALT)
    key = F.unhex(F.lit(tx.cipher_key("000102030405060708090a0b0c0d0e0f").hex()))
    table = protect.pseudonym_rows(one, key)
    return table.select("empreinte_valeur", tx.decrypt(F.col("valeur_chiffree"), key).alias("clair"), "jeton")


@query(f"""WITH e AS ({spans_of(WHOLE, tuple(FIELDS))}), t AS (SELECT c_custkey, c_mktsegment, length({text_of(WHOLE)}) AS n, CASE c_custkey % 2 WHEN 0 THEN 'txt' ELSE 'pdf' END AS f FROM customer),
a AS (SELECT 'total' AS section, 'documents' AS cle, NULL AS niveau, count(*) AS documents, 7 * count(*) AS entites, sum(n) AS caracteres FROM t
  UNION ALL SELECT 'type_document', c_mktsegment, NULL, count(*), 7 * count(*), sum(n) FROM t GROUP BY 2 UNION ALL SELECT 'format', f, NULL, count(*), 7 * count(*), sum(n) FROM t GROUP BY 2
  UNION ALL SELECT 'partition', CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'entrainement' END, NULL, count(*), 7 * count(*), sum(n) FROM t GROUP BY 2
  UNION ALL SELECT 'entite', type_entite, max(niveau), NULL, count(*), NULL FROM e GROUP BY 2 UNION ALL SELECT 'niveau', niveau, niveau, NULL, count(*), NULL FROM e GROUP BY 2)
SELECT section, cle, niveau, coalesce(documents, 0)::bigint AS documents, entites::bigint AS entites, coalesce(caracteres, 0)::bigint AS caracteres,
floor(1000000 * coalesce(documents, entites) / sum(coalesce(documents, entites)) OVER (PARTITION BY section) + 0.000001)::bigint AS part_e6 FROM a""")
def corpus_report(spark, d):
    """The corpus by type, format, partition, entity and level."""
    n = F.col("c_custkey")
    marks = annotations(spark, d).groupBy("c_custkey").agg(F.collect_list(F.struct("type", "niveau")).alias("entites"))
    corpus = letters(spark, d).join(marks, "c_custkey").select(
        F.col("c_mktsegment").alias("typeDocument"), F.concat(F.lit("lettres/"), n, F.when(n % 2 == 0, ".txt").otherwise(".pdf")).alias("chemin"),
        F.when(n % 5 == 0, "test").otherwise("entrainement").alias("partition"), "texte", "entites",
    )
    return st.corpus_tables(corpus).na.fill(0, ["documents", "caracteres"]).withColumn("part_e6", F.floor(F.col("part") * 1000000 + 1e-6).cast("long")).drop("part")


# --- evaluation: what two made-up readers find of the annotations ---


def _reference(spark, d) -> DataFrame:
    a = annotations(spark, d, fields=BY_RULES)
    return a.select(F.col("c_custkey").cast("string").alias("doc"), F.col("debut").alias("i"), F.col("type").alias("type_entite"), "debut", "fin", "niveau", F.lower("valeur").alias("cle"))


def _found(spark, d) -> DataFrame:
    """The reference without the addresses of every third letter, with phones taken for plates in every fifth, moved by one."""
    r, n = _reference(spark, d), F.col("doc").cast("long")
    r = r.where(~((F.col("type_entite") == "EMAIL") & (n % 3 == 0)))
    wrong = (F.col("type_entite") == "TELEPHONE") & (n % 5 == 0)
    moved = F.when(wrong, F.col("debut") + 1).otherwise(F.col("debut"))
    return r.select("doc", F.col("i").alias("j"), F.when(wrong, "PLAQUE_IMMAT").otherwise(F.col("type_entite")).alias("type_entite"), moved.alias("debut"), "fin", F.when(wrong, "moyen").otherwise(F.col("niveau")).alias("niveau"), "cle")


_COUNTS = "n AS (SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey % 3 = 0) AS m, count(*) FILTER (WHERE c_custkey % 5 = 0) AS w FROM customer)"


@query(f"""WITH {_COUNTS}, t AS (SELECT 'EMAIL' AS attendu, 'EMAIL' AS predit, n - m AS n FROM n UNION ALL SELECT 'EMAIL', '(manquée)', m FROM n UNION ALL SELECT 'TELEPHONE', 'TELEPHONE', n - w FROM n
  UNION ALL SELECT 'TELEPHONE', 'PLAQUE_IMMAT', w FROM n UNION ALL SELECT x, x, n FROM n, (VALUES ('IBAN'), ('CARTE_BANCAIRE'), ('DATE_NAISSANCE'), ('NUM_PIECE_IDENTITE')) AS v(x))
SELECT attendu, sum(n)::bigint AS total, (sum(n) FILTER (WHERE attendu = predit))::bigint AS exacts, coalesce(sum(n) FILTER (WHERE attendu <> predit), 0)::bigint AS autres FROM t GROUP BY attendu""")
def confusion_by_type(spark, d):
    r, p = catalog.materialise(_reference(spark, d)), catalog.materialise(_found(spark, d))
    return evaluate.confusion_totals(evaluate.confusion(r, p, catalog.materialise(evaluate.match_by_position(r, p))))


@query(f"WITH {_COUNTS} SELECT x AS etiquette FROM n, (VALUES ('EMAIL'), ('TELEPHONE'), ('IBAN'), ('CARTE_BANCAIRE'), ('DATE_NAISSANCE'), ('NUM_PIECE_IDENTITE')) AS v(x) UNION ALL SELECT 'PLAQUE_IMMAT' FROM n WHERE w > 0")
def confusion_labels(spark, d):
    """What letters hold and what is found in them, one that is only ever predicted too."""
    r, p = catalog.materialise(_reference(spark, d)), catalog.materialise(_found(spark, d))
    return evaluate.labels(evaluate.confusion(r, p, catalog.materialise(evaluate.match_by_position(r, p))))


@query(f"WITH {_COUNTS} SELECT * FROM (SELECT 'eleve' AS attendu, 'moyen' AS predit, w::bigint AS n FROM n UNION ALL SELECT 'moyen', '(manquée)', m::bigint FROM n) WHERE n > 0")
def under_classified(spark, d):
    r, p = catalog.materialise(_reference(spark, d)), catalog.materialise(_found(spark, d))
    return evaluate.under_classified(evaluate.confusion(r, p, catalog.materialise(evaluate.match_by_position(r, p)), "niveau"))


@query(f"""WITH {_COUNTS}, s AS (SELECT 'reference' AS condition, 'critique' AS niveau, 3 * n AS vp, 0 AS fp, 0 AS fn FROM n UNION ALL SELECT 'reference', 'eleve', 2 * n - w, 0, w FROM n UNION ALL SELECT 'reference', 'moyen', n - m, w, m FROM n
  UNION ALL SELECT 'vide', 'critique', 0, 0, 3 * n FROM n UNION ALL SELECT 'vide', 'eleve', 0, 0, 2 * n FROM n UNION ALL SELECT 'vide', 'moyen', 0, 0, n FROM n)
SELECT condition, niveau, vp::bigint AS vp, fp::bigint AS fp, fn::bigint AS fn, round(1000000 * vp / (vp + fn))::bigint AS rappel_e6, CASE WHEN vp + fp = 0 THEN 0 ELSE round(1000000 * vp / (vp + fp)) END::bigint AS precision_e6 FROM s""")
def scores_by_condition(spark, d):
    """Scores by condition and level, of a reader that finds most and of one that finds nothing."""
    r, p = catalog.materialise(_reference(spark, d)), catalog.materialise(_found(spark, d))
    one = lambda name, found: evaluate.outcomes(r, found, evaluate.match(r, found, strict=False)).withColumn("condition", F.lit(name))
    s = evaluate.scores_by(one("reference", p).unionByName(one("vide", p.limit(0))), "condition", "niveau")
    e6 = lambda c: F.round(F.col(c) * 1000000).cast("long").alias(f"{c}_e6")
    return s.select("condition", "niveau", "vp", "fp", "fn", e6("rappel"), e6("precision"))


@query("""WITH k AS (SELECT c_custkey % 4 AS c, count(*) AS n, count(*) FILTER (WHERE c_custkey % 3 = 0) AS m, count(*) FILTER (WHERE c_custkey % 5 = 0) AS w FROM customer GROUP BY ALL),
r AS (SELECT (2 * n - w) / (2 * n) AS eleve, (n - m) / n AS moyen FROM k)
SELECT round(min(eleve) * 1000000)::bigint AS eleve_e6, round(min(moyen) * 1000000)::bigint AS moyen_e6, min(eleve) >= 0.95 AS rappel_critique_atteint, min(moyen) >= 0.9 AS rappel_atteint FROM r""")
def recall_targets(spark, d):
    """The worst recall of two levels over four conditions (customers by number), and whether it reaches the targets."""
    r, p = catalog.materialise(_reference(spark, d)), catalog.materialise(_found(spark, d))
    of = lambda df: df.withColumn("condition", F.col("doc").cast("long") % 4)
    # a document has one condition, and spans match within a document: one matching serves all
    s = catalog.materialise(evaluate.scores_by(evaluate.outcomes(of(r), of(p), evaluate.match(r, p), "condition"), "condition", "niveau"))
    worst = lambda level, name: evaluate.worst_recall(s, level).select(F.col("pire_rappel").alias(name))
    t = evaluate.targets(worst("eleve", "rappel_critique").crossJoin(F.broadcast(worst("moyen", "rappel"))))  # one row each
    e6 = lambda c, name: F.round(F.col(c) * 1000000).cast("long").alias(name)
    return t.select(e6("rappel_critique", "eleve_e6"), e6("rappel", "moyen_e6"), "rappel_critique_atteint", "rappel_atteint")


@query(f"""WITH {_COUNTS} SELECT configuration, axe, cle, vp::bigint AS vp, fn::bigint AS fn FROM (
SELECT 'regles' AS configuration, 'global' AS axe, 'GLOBAL' AS cle, 6 * n - m - w AS vp, m + w AS fn FROM n UNION ALL SELECT 'aucune', 'global', 'GLOBAL', 0, 6 * n FROM n)""")
def detection_campaign(spark, d):
    r, p = catalog.materialise(_reference(spark, d)), catalog.materialise(_found(spark, d))
    return evaluate.campaign(r, {"regles": p, "aucune": p.limit(0)}).where("axe = 'global'").select("configuration", "axe", "cle", "vp", "fn")


@query(f"""WITH {_COUNTS}, s AS (SELECT 'type' AS axe, 'EMAIL' AS cle, n - m AS vp, 0 AS fp, m AS fn FROM n UNION ALL SELECT 'type', 'TELEPHONE', n - w, 0, w FROM n UNION ALL SELECT 'type', 'PLAQUE_IMMAT', 0, w, 0 FROM n
  UNION ALL SELECT 'type', x, n, 0, 0 FROM n, (VALUES ('IBAN'), ('CARTE_BANCAIRE'), ('DATE_NAISSANCE'), ('NUM_PIECE_IDENTITE')) AS v(x)
  UNION ALL SELECT 'niveau', 'critique', 3 * n, 0, 0 FROM n UNION ALL SELECT 'niveau', 'eleve', 2 * n - w, 0, w FROM n UNION ALL SELECT 'niveau', 'moyen', n - m, w, m FROM n UNION ALL SELECT 'global', 'GLOBAL', 6 * n - m - w, w, m + w FROM n),
r AS (SELECT axe, cle, CASE WHEN vp + fp = 0 THEN 0 ELSE vp / (vp + fp) END AS p, CASE WHEN vp + fn = 0 THEN 0 ELSE vp / (vp + fn) END AS r, vp + fn AS support FROM s)
SELECT axe, cle, printf('%.4f', p::double) AS precision, printf('%.4f', r::double) AS rappel, printf('%.4f', (CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END)::double) AS f1,
printf('%.4f', (CASE WHEN p + r = 0 THEN 0 ELSE 5 * p * r / (4 * p + r) END)::double) AS f2, support::bigint AS support FROM r""")
def score_report(spark, d):
    """The report's table: types, levels, the whole."""
    r, p = catalog.materialise(_reference(spark, d)), catalog.materialise(_found(spark, d))
    return reports.score_table(evaluate.scores(evaluate.outcomes(r, p, evaluate.match(r, p))))


@query(f"""WITH {_COUNTS} SELECT (6 * n - m - w)::bigint AS memes_types, (6 * n - m)::bigint AS tous_types FROM n""")
def values_matched(spark, d):
    """Matching by similar values, with equal types and with any."""
    r, p = catalog.materialise(_reference(spark, d)), catalog.materialise(_found(spark, d))
    some, every = (evaluate.match_by_value(r, p, same_type=t).agg(F.count(F.lit(1)).alias(n)) for t, n in ((True, "memes_types"), (False, "tous_types")))
    return some.crossJoin(F.broadcast(every))  # one row each


@query(f"""WITH {_COUNTS} SELECT 'scan' AS condition, (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0)::bigint AS perdues, (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 1)::bigint AS non_detectees FROM n""")
def losses_by_cause(spark, d):
    """Missed addresses that the reading of every second letter lacks, and those it has."""
    r, p = catalog.materialise(_reference(spark, d).where("type_entite = 'EMAIL'")), _found(spark, d).where("type_entite = 'EMAIL'")
    texts = letters(spark, d).select(F.col("id").alias("doc"), F.lit("scan").alias("condition"), F.when(F.col("c_custkey") % 2 == 0, "rien de lisible").otherwise(F.lower("texte")).alias("cle"))
    return evaluate.losses(r, evaluate.match(r, p), texts)


@query("""SELECT c_custkey::varchar AS id, condition, c_custkey % 2 = 0 AS net FROM customer, (VALUES ('reference'), ('bruit')) AS x(condition) WHERE c_custkey % 7 <> 0""")
def readings_joined(spark, d):
    """Two readings a letter; those without annotation are left out."""
    index = letters(spark, d).select("id", F.explode(F.array(F.lit("reference"), F.lit("bruit"))).alias("condition"), "texte")
    marks = letters(spark, d).where("c_custkey % 7 <> 0").select("id", F.when(F.col("c_custkey") % 2 == 0, F.col("texte")).otherwise("autre").alias("texte"), F.array().cast("array<string>").alias("entites"))
    return evaluate.joined_readings(index, marks).select("id", "condition", (F.col("texte") == F.col("texte_reference")).alias("net"))


@query("SELECT c_custkey::varchar AS document_id, CASE WHEN c_custkey % 2 = 0 THEN 4 ELSE 0 END AS critiques, 6 AS toutes FROM customer".replace("THEN 4", "THEN 3").replace("ELSE 0", "ELSE 6"))
def entities_at_threshold(spark, d):
    """Entities at or above a level: 'critique' for every second letter, 'faible' for the others; and those above a score."""
    done = merge.analyse(detect.detect(letters(spark, d), today=today()))
    level = F.when(F.col("c_custkey") % 2 == 0, "critique").otherwise("faible")
    return done.select(F.col("id").alias("document_id"), F.size(merge.at_least(F.col("entites"), level)).alias("critiques"), F.size(detect.above_threshold(F.col("entites"))).alias("toutes"))
