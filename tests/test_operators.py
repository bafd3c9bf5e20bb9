"""Arbitration, classification, protection, policy, audit, catalogue, evaluation, sources."""

import hashlib
import io
import random
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from privlake.operators import audit, catalog, detect, evaluate, merge, ner, policy, protect, statistics as stats
from privlake.plans import analysis, queries, reports
from privlake.schema import DOCUMENT, ENTITIES_DDL, policy_matrix
from privlake.sources import files
from privlake.streaming import ingest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name not in queries.ORACLES:
        return
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    text = lambda x: "" if x is None or str(x) in ("nan", "<NA>", "None", "NaT") else str(x)
    rows = lambda d: sorted(tuple(map(text, r)) for r in d[sorted(d.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def entity(kind, a, b, score=0.9, method="regle", valid=False):
    return (kind, a, b, "v", score, method, valid)


def arbitrated(spark, found):
    d = spark.createDataFrame([(found,)], f"c {ENTITIES_DDL}")
    return [(e.type_entite, e.debut, e.fin, e.methode) for e in d.select(merge.arbitrate(F.col("c")).alias("e")).first().e]


@pytest.mark.parametrize(("found", "want"), [
    ([entity("IBAN", 10, 38, 0.6, valid=True), entity("PIECE", 5, 45, 0.99)], [("IBAN", 10, 38, "regle")]),
    ([entity("NOM", 10, 15, 0.99), entity("ADRESSE", 8, 40, 0.51)], [("ADRESSE", 8, 40, "regle")]),
    ([entity("ORG", 0, 12, 0.55), entity("NOM", 0, 12, 0.95)], [("NOM", 0, 12, "regle")]),
    ([entity("NOM", 0, 12, 0.8), entity("ORG", 6, 18, 0.8)], [("NOM", 0, 12, "regle"), ("ORG", 6, 18, "regle")]),
    ([entity("NOM", 0, 11), entity("NOM", 0, 11, method="ner")], [("NOM", 0, 11, "fusion")]),
    ([entity("ORG", 0, 10), entity("IBAN", 5, 35, valid=True), entity("CLIENT", 30, 40)], [("IBAN", 5, 35, "regle")]),
    ([], []),
])
def test_arbitration(spark, found, want):
    assert arbitrated(spark, found) == want


def test_arbitration_properties(spark):
    r = random.Random(4)
    docs = [[entity(r.choice("AB"), a := r.randint(0, 20), a + r.randint(1, 9), r.choice((0.5, 0.9)), r.choice(("regle", "ner")), r.random() < 0.3) for _ in range(r.randint(0, 8))] for _ in range(300)]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(docs)], f"i int, c {ENTITIES_DDL}").withColumn("e", merge.arbitrate(F.col("c")))
    p = lambda e: (e.valide, e.fin - e.debut, round(e.score, 6))
    for row in d.collect():
        kept = row.e
        for x in kept:
            assert not any(y.debut < x.fin and x.debut < y.fin and p(y) > p(x) for y in kept)
        for x in row.c:  # nothing is dropped without a stronger neighbour, or its like
            assert any((y.type_entite, y.debut, y.fin) == (x.type_entite, x.debut, x.fin) or (y.debut < x.fin and x.debut < y.fin and p(y) > p(x)) for y in kept)


def test_context_raises_names(spark):
    near = [entity("NOM_PERSONNE", 0, 11), entity("DATE_NAISSANCE", 40, 50), entity("NUM_PIECE_IDENTITE", 80, 93)]
    far = [entity("NOM_PERSONNE", 0, 11), entity("DATE_NAISSANCE", 900, 910), entity("NUM_PIECE_IDENTITE", 1200, 1213)]
    d = spark.createDataFrame([(near,), (near[:2],), (far,)], f"c {ENTITIES_DDL}").withColumn("k", merge.classify(F.col("c")))
    assert [r.k[0].niveau for r in d.collect()] == ["eleve", "moyen", "moyen"]
    assert [r[0] for r in d.select(merge.highest(F.col("k"))).collect()] == ["critique", "eleve", "critique"]
    assert [r[0] for r in d.select(F.size(merge.at_least(F.col("k"), F.lit("critique")))).collect()] == [1, 0, 1]
    assert d.select(F.size(merge.at_least(F.col("k"), F.lit("?")))).first()[0] == 0


TEXT = "Attestation\nNom : Awa Diouf, née le 03/07/1988\nCNI : 1988070312345\nMail awa.diouf@exemple.sn, tél +221 77 555 44 33\nIBAN SN91SN0100152000048500000765"


def test_reference_text(spark):
    d = spark.createDataFrame([("d1", TEXT), ("d2", ""), ("d3", None)], "id string, texte string")
    out = {r.id: r for r in analysis.analyse_texts(d, today=F.lit("2026-01-01").cast("date")).collect()}
    assert {e.type_entite for e in out["d1"].entites} >= {"DATE_NAISSANCE", "NUM_PIECE_IDENTITE", "EMAIL", "TELEPHONE", "IBAN"}
    assert out["d1"].niveau_max == "critique" and out["d2"].niveau_max is None and out["d3"].entites == []
    assert all(out["d1"].normalise.texte[e.debut : e.fin] == e.valeur for e in out["d1"].entites)


def test_ocr_tolerance(spark):
    d = spark.createDataFrame([("SN92SN0100152000048500000765",), ("mail binetandiaye @mail .bj ici",), ("32/13/1990",), ("moussa.bamba@poste.c",)], "texte string")
    strict = [len(r.candidats) for r in detect.detect(d, with_addresses=False).collect()]
    ocr = detect.detect_ocr(d).collect()
    assert strict == [0, 0, 0, 0] and ocr[2].candidats == []
    assert [(e.type_entite, e.valide, e.score) for e in ocr[0].candidats] == [("IBAN", False, 0.9)]
    assert "binetandiaye @mail .bj" in [e.valeur for e in ocr[1].candidats] and ocr[3].candidats[0].type_entite == "EMAIL"


def test_rewriting(spark):
    text = "abcdefghij"
    d = spark.createDataFrame([(text, [(0, 3), (5, 7)]), (text, [(0, 4), (2, 6)]), (text, [])], "t string, e array<struct<debut:int,fin:int>>")
    got = d.select(protect.rewrite(F.col("t"), F.col("e"), lambda e: F.lit("#")).alias("x"), protect.rewrite(F.col("t"), F.col("e"), lambda e: F.lit("#"), union=True).alias("y")).collect()
    assert [(r.x, r.y) for r in got] == [("#de#hij", "#de#hij"), ("ab#ghij", "#ghij"), (text, text)]


def test_policy_matrix_and_outcomes(spark):
    docs = spark.createDataFrame([(n, "analyse", n) for n in ("faible", "moyen", "eleve", "critique")] + [("nu", "analyse", None), ("neuf", "decouvert", "moyen")], "id string, statut string, niveau_max string")
    roles = [r.role for r in policy_matrix(spark).select("role").distinct().collect()] + ["autre", ""]
    asked = spark.createDataFrame([(r, d) for r in roles for d in ("faible", "moyen", "eleve", "critique", "nu", "neuf", "absent")], "role string, document_id string")
    got = {(r.role, r.document_id): r for r in policy.decide(asked, docs, policy_matrix(spark)).collect()}
    for c in policy_matrix(spark).collect():
        assert got[c.role, c.niveau].action == c.action and got[c.role, c.niveau].code == (403 if c.action == "refus" else 200)
    assert {got[r, d].code for r in ("autre", "") for d in ("faible", "critique")} == {403}
    assert {got[r, "nu"].code for r in roles} == {423} == {got[r, "neuf"].code for r in roles} and {got[r, "absent"].code for r in roles} == {404}
    assert policy.decide(asked, docs, policy_matrix(spark).limit(0)).where("code = 200").count() == 0
    assert policy.audit_rows(policy.decide(asked, docs, policy_matrix(spark))).count() == asked.count()


def chain(rows):
    previous, out = None, []
    for i, (user, action) in enumerate(rows, 1):
        digest = hashlib.sha256("|".join([previous or audit.GENESIS, user or "", "", "", action, "", "2024-01-01T00:00:00.000Z"]).encode()).hexdigest()
        out.append((i, user, action, previous, digest))
        previous = digest
    return out


def test_audit_verification_equals_a_fold(spark):
    r = random.Random(8)
    for k in range(6):
        rows = chain([(r.choice(("u", None)), r.choice("LR")) for _ in range(40)])
        first = None
        if k:
            i = r.randrange(1, 40)
            how = r.choice(("edit", "hash", "delete"))
            first = i + 1 if how != "delete" else i + 2
            if how == "delete":
                rows = rows[:i] + rows[i + 1 :]
                first = first if i < 39 else None
            else:
                rows[i] = (*rows[i][:1], "pirate" if how == "edit" else rows[i][1], *rows[i][2:4], rows[i][4] if how == "edit" else "0" * 64)
        log = spark.createDataFrame(rows, "id long, utilisateur_id string, action string, empreinte_precedente string, empreinte string")
        log = log.withColumns({c: F.lit(None).cast("string") for c in ("role_effectif", "document_id", "politique_appliquee")}).withColumn("horodatage", F.lit("2024-01-01").cast("timestamp"))
        got = audit.verify(log).first()
        assert (got.intact, got.premiere_rupture) == (first is None, first)
        assert got.nb_entrees == (len(rows) if first is None else sum(x[0] <= first for x in rows))
    assert tuple(audit.verify(log.limit(0)).first()) == (True, None, 0)


@pytest.mark.parametrize(("parts", "adaptive"), [(4, "true"), (200, "false")])
def test_audit_verification_of_a_long_log(spark, parts, adaptive):
    """Whatever the partitions: the queries over a chain a day at the larger scale, equal to their SQL."""
    sf = "/root/testdata/sf0.1"
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        c = duckdb.connect()
        c.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
        for name in ("audit_chain", "audit_chain_tampered"):
            got = {r.jour: (r.intact, r.premiere_rupture, r.nb_entrees) for r in queries.QUERIES[name](spark, sf).collect()}
            want = c.execute(f"SELECT jour, intact, premiere_rupture, nb_entrees FROM ({queries.ORACLES[name]})").fetchall()
            assert got == {r[0]: r[1:] for r in want} and len(got) == 30
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_audit_blocks(spark):
    """A break within and at the borders of the blocks of a log that spans many."""
    rows = chain([("u", "L")] * 23)
    for i in (0, 3, 4, 5, 9, 10, 17, 22):
        cut = [(*r[:1], "pirate", *r[2:]) if k == i else r for k, r in enumerate(rows)]
        log = spark.createDataFrame(cut, "id long, utilisateur_id string, action string, empreinte_precedente string, empreinte string")
        log = log.withColumns({c: F.lit(None).cast("string") for c in ("role_effectif", "document_id", "politique_appliquee")}).withColumn("horodatage", F.lit("2024-01-01").cast("timestamp"))
        assert tuple(audit.verify(log, block=5).first()) == (False, i + 1, i + 1)


def test_audit_million_rows(spark):
    """A chain of a million rows, whole and with one row of the middle changed (its fields don't enter the hash of others)."""
    link = lambda previous, user: hashlib.sha256("|".join([previous or audit.GENESIS, user, "", "", "L", "", "2024-01-01T00:00:00.000Z"]).encode()).hexdigest()
    n = 1_000_000

    def run(batches):
        import pandas as pd

        for b in batches:
            previous, out = None, []
            for i in range(1, n + 1):
                digest = link(previous, "u")
                out.append((i, previous, digest))
                previous = digest
                if len(out) == 50_000:
                    yield pd.DataFrame(out, columns=["id", "empreinte_precedente", "empreinte"])
                    out = []

    log = spark.range(1, numPartitions=1).mapInPandas(run, "id long, empreinte_precedente string, empreinte string")
    log = log.withColumns({c: F.lit(None).cast("string") for c in ("role_effectif", "document_id", "politique_appliquee")})
    log = log.withColumns({"utilisateur_id": F.lit("u"), "action": F.lit("L"), "horodatage": F.lit("2024-01-01").cast("timestamp")})
    log = queries.catalog.materialise(log)
    assert tuple(audit.verify(log).first()) == (True, None, n)
    bad = log.withColumn("utilisateur_id", F.when(F.col("id") == 700_001, "x").otherwise(F.col("utilisateur_id")))
    assert tuple(audit.verify(bad.repartition(50)).first()) == (False, 700_001, 700_001)


def test_partition_of_a_large_corpus(spark):
    """Places don't depend on how the rows lie: wide rows, many partitions."""
    n = 60_000
    d = spark.range(n).select((F.col("id") * 7919 % n).alias("id"), F.repeat(F.lit("x"), 50).alias("texte"), F.lit(1).alias("k")).repartition(23)
    got = evaluate.with_partition(d).groupBy("partition").agg(F.min("id"), F.max("id"), F.count(F.lit(1))).collect()
    assert {tuple(r) for r in got} == {("entrainement", 0, 41_999, 42_000), ("validation", 42_000, 50_999, 9_000), ("test", 51_000, 59_999, 9_000)}


def resource(spark, rows):
    return spark.createDataFrame([("s", k, len(c or b""), None, c) for k, c in rows], "source_id string, cle string, taille long, type_mime string, content binary")


def test_scan_and_upsert(spark):
    none = spark.createDataFrame([], DOCUMENT)
    new, changed, outcome = ingest.scan(none, resource(spark, [("a.txt", b"1"), ("b.txt", b"2")]), "2024-01-01")
    run = catalog.scan_run("s", outcome, "manuel", "2024-01-01", "2024-01-01").first()
    assert (run.nb_listes, run.nb_nouveaux, run.nb_inchanges, run.nb_echecs) == (2, 2, 0, 0) and changed.count() == 2
    again, changed, outcome = ingest.scan(new, resource(spark, [("a.txt", b"1"), ("b.txt", b"x"), ("c.txt", None)]), "2024-02-01")
    assert {r.chemin_source: r.resultat for r in outcome.collect()} == {"a.txt": "inchange", "b.txt": "nouveau", "c.txt": "echec"}
    old, now = ({r.chemin_source: r for r in d.collect()} for d in (new, again))
    assert now["b.txt"].id == old["b.txt"].id and now["b.txt"].date_decouverte == old["b.txt"].date_decouverte and now["b.txt"].empreinte_sha256 != old["b.txt"].empreinte_sha256
    failed = catalog.update_status(again, spark.createDataFrame([(old["a.txt"].id, "echec", "e" * 900)], "id string, statut string, motif string")).where("statut = 'echec'").first()
    assert failed.tentatives == 1 and len(failed.motif_echec) == 500
    assert catalog.schedule_changes(spark.createDataFrame([("x",), ("y",)], "id string"), spark.createDataFrame([("y",), ("z",)], "id string")).count() == 2


def docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/header1.xml", f"<w:hdr {w}>{p('Dossier GZ-889201')}</w:hdr>")
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('Bonjour')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl></w:body></w:document>")
    return data.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, data in (("a.txt", "é".encode()), ("d/b.csv", "Thérèse".encode("latin-1")), ("c.docx", docx()), ("vide.txt", b""), ("x.pdf", b"%PDF-1.4 broken"), ("y.docx", b"PK\x03\x04broken")):
        (tmp_path / name).write_bytes(data)
    got = files.list_sources(spark, [{"id": "s", "type": "local", "configuration": {"chemin": str(tmp_path)}}])
    assert {r.cle for r in got.collect()} == {"a.txt", "d/b.csv", "c.docx", "vide.txt", "x.pdf", "y.docx"}
    texts = {r.cle: (r.texte, r.methode) for r in files.extract(got).collect()}
    assert texts["a.txt"] == ("é", "texte") and texts["d/b.csv"][0] == "Thérèse" and texts["vide.txt"] == ("", "aucune")
    assert texts["c.docx"] == ("Dossier GZ-889201\nBonjour\na | b", "docx") and texts["x.pdf"] == (None, "echec") == texts["y.docx"]
    assert files.list_files(spark, str(tmp_path / "absent")).count() == 0
    with pytest.raises(ValueError):
        files.list_sources(spark, [{"id": "s", "type": "ftp", "configuration": {}}])
    keys = spark.createDataFrame([("a/b",), ("../x",), ("a/../../x",), ("a/../x",)], "k string")
    assert [r[0] for r in keys.select(files.escapes(F.col("k"))).collect()] == [False, True, True, False]


def test_docx_rewriting(spark):
    d = spark.createDataFrame([("a", docx(), {"GZ-889201": "CLI-1", "Bonjour": "B••"}), ("b", docx(), {})], "cle string, content binary, remplacements map<string,string>")
    out = {r.cle: bytes(r.content) for r in protect.protect_docx(d).collect()}
    assert files._docx_text(out["a"]) == "Dossier CLI-1\nB••\na | b" and out["b"] == docx_bytes(d)


def docx_bytes(d):
    return bytes(d.where("cle = 'b'").first().content)


def test_content_types(spark):
    rows = [(b"%PDF-1", "text/plain", "a.txt", files.PDF), (b"\xff\xd8\xff\xe0", None, None, "image/jpeg"), (b"II*\x00", None, None, "image/tiff"), (b"PK\x03\x04", None, "a.zip", files.DOCX), (b"x", "Text/HTML; charset=x", "a.csv", "text/html"), (b"x", "x/y", "a.CSV", "text/csv"), (b"x", None, None, "text/plain")]
    d = spark.createDataFrame(rows, "c binary, m string, n string, want string")
    assert all(r.got == r.want for r in d.select("want", files.content_type(F.col("c"), F.col("m"), F.col("n")).alias("got")).collect())


def test_words_to_text(spark):
    w = spark.createDataFrame([("d", 1, 1, 1, "Bonjour", 90.0), ("d", 1, 1, 2, "Awa", 80.0), ("d", 1, 2, 1, "fin", 70.0), ("d", 2, 1, 1, "page", 60.0)], "doc string, page int, ligne int, rang int, mot string, confiance double")
    r = files.assemble_words(w).first()
    assert r.texte == "Bonjour Awa\nfin\n\npage" and [r.texte[b.debut : b.fin] for b in r.boites] == ["Bonjour", "Awa", "fin", "page"] and r.confiance == 75.0


def evaluation(spark, ref, pred):
    r = spark.createDataFrame([("d", i, *x) for i, x in enumerate(ref)], "doc string, i int, type_entite string, debut int, fin int, niveau string")
    p = spark.createDataFrame([("d", j, *x) for j, x in enumerate(pred)], "doc string, j int, type_entite string, debut int, fin int, niveau string")
    return r, p


def test_matching_and_scores(spark):
    r, p = evaluation(spark, [("A", 0, 5, "moyen"), ("A", 10, 15, "moyen"), ("B", 20, 25, "critique")], [("A", 0, 5, "moyen"), ("A", 11, 16, "moyen"), ("A", 12, 14, "moyen"), ("C", 20, 25, "faible")])
    assert {(m.i, m.j) for m in evaluate.match(r, p).collect()} == {(0, 0)}
    assert {(m.i, m.j) for m in evaluate.match(r, p, strict=False).collect()} == {(0, 0), (1, 1)}
    s = {(x.axe, x.cle): x for x in evaluate.scores(evaluate.outcomes(r, p, evaluate.match(r, p, strict=False))).collect()}
    g = s["global", "GLOBAL"]
    assert (g.vp, g.fp, g.fn, g.support) == (2, 2, 1, 3) and abs(g.f2 - 5 * 0.5 * (2 / 3) / (4 * 0.5 + 2 / 3)) < 1e-12 and s["type", "B"].rappel == 0
    by_place = evaluate.match_by_position(r, p)
    assert {(m.i, m.j) for m in by_place.collect()} == {(0, 0), (1, 1), (2, 3)}
    c = {(x.attendu, x.predit): x.n for x in evaluate.confusion(r, p, by_place, "niveau").collect()}
    assert c == {("moyen", "moyen"): 2, ("critique", "faible"): 1, (evaluate.EXTRA, "moyen"): 1}
    under = evaluate.under_classified(evaluate.confusion(r, p, by_place, "niveau")).collect()
    assert [(x.attendu, x.predit) for x in under] == [("critique", "faible")]


def test_campaign_and_tables(spark):
    r, p = evaluation(spark, [("A", 0, 5, "moyen"), ("B", 20, 25, "critique")], [("A", 0, 5, "moyen"), ("B", 21, 25, "critique")])
    c = {(x.configuration, x.axe, x.cle): x.rappel for x in evaluate.campaign(r, {"tout": p, "rien": p.limit(0)}).collect()}
    assert c["tout", "global", "GLOBAL"] == 0.5 and c["rien", "global", "GLOBAL"] == 0.0
    m = evaluate.confusion(r, p, evaluate.match_by_position(r, p), "niveau")
    assert {(x.attendu, x.total, x.exacts, x.autres) for x in evaluate.confusion_totals(m).collect()} == {("moyen", 1, 1, 0), ("critique", 1, 1, 0)}
    assert evaluate.confusion_table(m, ["moyen", "critique"]).columns == ["attendu", "moyen", "critique", evaluate.MISSED]
    rows = evaluate.outcomes(r, p, evaluate.match(r, p)).withColumn("condition", F.lit("bruit"))
    assert evaluate.worst_recall(evaluate.scores_by(rows, "condition", "niveau")).first()[0] == 0.0
    d = evaluate.with_partition(spark.range(20).withColumn("id", F.col("id") + 5))
    got = [x.partition for x in d.orderBy("id").collect()]
    assert got == ["entrainement"] * 14 + ["validation"] * 3 + ["test"] * 3


def test_value_matching(spark):
    r = spark.createDataFrame([("d", 0, "NOM", "mamadoufall"), ("d", 1, "NOM", "awa")], "doc string, i int, type_entite string, cle string")
    p = spark.createDataFrame([("d", 0, "NOM", "mamadoufali"), ("d", 1, "LOC", "awa"), ("d", 2, "NOM", "mamadoufall")], "doc string, j int, type_entite string, cle string")
    assert {(m.i, m.j) for m in evaluate.match_by_value(r, p).collect()} == {(0, 2)}
    assert {(m.i, m.j) for m in evaluate.match_by_value(r, p, same_type=False).collect()} == {(0, 2), (1, 1)}


def test_percentile_definition(spark):
    d = spark.createDataFrame([("a", float(i)) for i in range(20)] + [("b", 1.0)], "condition string, cer double")
    got = {x.condition: (x.p90, x.mediane) for x in evaluate.error_summary(d).collect()}
    assert got == {"a": (18.0, 9.5), "b": (1.0, 1.0)}


def test_statistics_defaults(spark):
    d = spark.createDataFrame([("s", "analyse", None)] * 5 + [("s", "analyse", "moyen")] * 3 + [("s", "echec", None)] * 2, "source_id string, statut string, niveau_max string")
    assert stats.failure_rate(d).first().taux == 0.2 and stats.failure_rate(d.limit(0)).first().taux == 0.0
    assert {r.niveau: r.n for r in stats.by_level(d).collect()} == {"non_analyse": 7, "moyen": 3}


def test_report_and_null_backend(spark, tmp_path):
    d = spark.createDataFrame([("a", 0.5), (None, None)], "k string, v double")
    assert reports.markdown(d).splitlines()[0] == "| k | v      |"
    reports.write(d, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 2
    with pytest.raises(ValueError):
        reports.markdown(spark.range(30), limit=10)
    t = spark.createDataFrame([("Awa Diouf",), (None,)], "t string")
    assert [r.e for r in ner.ner_entities(t, "t", "e", "spacy").collect()] == [[], []]
    assert ner.fitted("x Awa ", 1, 6) == (2, 5)


def test_stream_of_listings(spark, tmp_path):
    rows = resource(spark, [("a.txt", b"1"), ("b.txt", b"2")])
    rows.write.parquet(str(tmp_path / "in"))
    stored = {}
    keep = lambda new, changed, outcome, n: stored.update({n: (new.collect(), changed.count(), sorted(r.resultat for r in outcome.collect()))})
    q = ingest.stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), lambda: spark.createDataFrame([], DOCUMENT), keep, str(tmp_path / "ck"))
    q.awaitTermination(120)
    (new, changed, outcome), = stored.values()
    assert len(new) == changed == 2 and outcome == ["nouveau", "nouveau"] and all(r.date_decouverte is not None for r in new)
