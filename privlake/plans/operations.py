"""Queries over the test tables for the catalogue, the audit log, the task queue and the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from privlake.functions import text as tx
from privlake.functions.spans import with_boxes
from privlake.operators import audit, catalog, evaluate, policy, statistics as st
from privlake.plans.registry import query, rows
from privlake.schema import DETECTED, policy_matrix
from privlake.sources.files import assemble_words, content_type, escapes
from privlake.streaming import ingest


def _documents(spark, d) -> DataFrame:
    """A snapshot of all documents: every third failed once, none analysed."""
    n, none = F.col("doc_id"), F.lit(None)
    return rows(spark, d, "documents").select(
        F.concat(F.lit("d"), n).alias("id"), F.col("source").alias("source_id"), n.cast("string").alias("chemin_source"), F.sha2("text", 256).alias("empreinte_sha256"),
        F.lit("text/plain").alias("type_mime"), F.col("n_chars").alias("taille_octets"), F.when(n % 3 == 0, "echec").otherwise("decouvert").alias("statut"),
        F.lit(None).cast("string").alias("niveau_max"), F.lit("2024-01-01").cast("timestamp").alias("date_decouverte"), none.cast("timestamp").alias("date_analyse"),
        (n % 3 == 0).cast("smallint").alias("tentatives"), none.cast("string").alias("motif_echec"),
    )


@query("""SELECT 'd' || doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'echec' WHEN 1 THEN 'analyse' ELSE CASE WHEN doc_id % 3 = 0 THEN 'echec' ELSE 'decouvert' END END AS statut,
((CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END))::smallint AS tentatives, CASE WHEN doc_id % 4 = 0 THEN 500 ELSE 0 END::int AS motif FROM documents""")
def status_updates(spark, d):
    """A quarter fails with a long reason, a quarter is analysed."""
    n = F.col("doc_id")
    updates = rows(spark, d, "documents").where(n % 4 < 2).select(
        F.concat(F.lit("d"), n).alias("id"), F.when(n % 4 == 0, "echec").otherwise("analyse").alias("statut"), F.when(n % 4 == 0, F.repeat(F.lit("x"), 600)).alias("motif")
    )
    return catalog.update_status(_documents(spark, d), updates).select("id", "statut", "tentatives", F.coalesce(F.length("motif_echec"), F.lit(0)).alias("motif"))


@query("""SELECT 'd' || doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'analyse' WHEN doc_id % 3 = 0 THEN 'echec' ELSE 'decouvert' END AS statut, CASE WHEN doc_id % 2 = 0 THEN 'critique' END AS niveau_max,
CASE WHEN doc_id % 2 = 0 THEN 'IBAN' ELSE 'EMAIL,TELEPHONE' END AS entites FROM documents""")
def entities_replaced(spark, d):
    """Two old entities each; half of the documents are analysed again, with one."""
    docs = _documents(spark, d)
    columns = [c.split() for c in DETECTED.split(", ")]
    entity = lambda df, kind: df.select(*[(F.col("id") if c == "document_id" else F.lit(kind) if c == "type_entite" else F.lit(None)).cast(t).alias(c) for c, t in columns])
    old = entity(docs, "EMAIL").unionByName(entity(docs, "TELEPHONE"))
    analysed = rows(spark, d, "documents").where("doc_id % 2 = 0").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.lit("critique").alias("niveau_max"), F.lit("2024-02-01").cast("timestamp").alias("date_analyse"))
    entities, docs = catalog.replace_entities(old, docs, entity(analysed, "IBAN"), analysed)
    kinds = entities.groupBy(F.col("document_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("type_entite")), ",").alias("entites"))
    return docs.join(kinds, "id").select("id", "statut", "niveau_max", "entites")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'ancien' ELSE 'nouveau' END AS origine FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0""")
def pseudonyms_inserted(spark, d):
    """A hash that is known keeps its row; new ones, which come twice, are added once."""
    c = rows(spark, d, "customer").select("c_custkey")
    known, fresh = c.where("c_custkey % 3 = 0").withColumn("origine", F.lit("ancien")), c.where("c_custkey % 2 = 0").withColumn("origine", F.lit("nouveau"))
    return catalog.insert_missing(known, fresh.unionByName(fresh), ["c_custkey"])


@query("""SELECT 'web' AS source_id, count(*)::int AS nb_listes, count(*) FILTER (WHERE page_id % 7 <> 0 AND page_id % 3 = 0)::int AS nb_nouveaux,
count(*) FILTER (WHERE page_id % 7 <> 0 AND page_id % 3 <> 0)::int AS nb_inchanges, count(*) FILTER (WHERE page_id % 7 = 0)::int AS nb_echecs, 'cron' AS declencheur FROM pages""")
def scan_counters(spark, d):
    """All pages scanned again: a third has changed, a seventh can't be read."""
    pages = rows(spark, d, "pages")
    place = F.col("page_id").cast("string")
    listed = lambda content: pages.select(F.lit("web").alias("source_id"), place.alias("cle"), F.length("html").cast("long").alias("taille"), F.lit(None).cast("string").alias("type_mime"), content.alias("content"))
    old = ingest.listed_documents(listed(F.encode("html", "UTF-8")), "2024-01-01")
    empty = _documents(spark, d).limit(0)
    snapshot, _ = catalog.upsert_documents(empty, old)
    now = F.when(F.col("page_id") % 7 != 0, F.encode(F.concat("html", F.when(F.col("page_id") % 3 == 0, "x").otherwise("")), "UTF-8"))
    _, _, outcome = ingest.scan(snapshot, listed(now), "2024-02-01")
    run = catalog.scan_run("web", outcome, "cron", "2024-02-01", "2024-02-01")
    return run.drop("demarre_le", "termine_le")


@query("SELECT c_custkey AS id, c_name AS libelle FROM customer WHERE c_acctbal > 0")
def active_sources(spark, d):
    s = rows(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("libelle"), (F.col("c_acctbal") > 0).alias("actif"))
    return catalog.sources(s, active_only=True).select("id", "libelle")


@query("""SELECT event_id AS id, event_type AS action FROM events WHERE user_id = (SELECT min(user_id) FROM events) AND ts >= (SELECT min(ts) FROM events) AND ts <= (SELECT max(ts) FROM events)
ORDER BY event_id DESC LIMIT 500""")
def audit_filtered(spark, d):
    """A user's rows between two times, both inclusive."""
    e = rows(spark, d, "events")
    b = e.agg(F.min("user_id").cast("string").alias("u"), F.min("ts").alias("a"), F.max("ts").alias("z")).first()
    log = e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("utilisateur_id"), F.col("event_type").alias("action"), F.col("ts").alias("horodatage"))
    return audit.search(log, user=b.u, since=b.a, until=b.z, size=500).select("id", "action")


@query("""SELECT e.event_id AS id FROM events e WHERE event_id % 10 IN (1, 2, 3) OR event_id % 17 = 0""")
def audit_leaks(spark, d):
    """Details with an address, an IBAN or a card number, and malformed hashes; a number that fails its check is none."""
    n = F.col("event_id")
    details = F.when(n % 10 == 1, F.concat(F.lit("vu par client"), n, F.lit("@exemple.sn"))).when(n % 10 == 2, "compte SN91SN0100152000048500000765").when(n % 10 == 3, "carte 4539578763621486").when(n % 10 == 4, "suite 4539578763621487")
    digest = F.when(n % 17 == 0, "faux").otherwise(F.sha2(n.cast("string"), 256))
    return audit.leaks(rows(spark, d, "events").select(n.alias("id"), details.alias("details"), digest.alias("empreinte"))).select("id")


@query("""SELECT 'T' || l_linenumber AS type_entite, CASE l_returnflag WHEN 'R' THEN 'critique' ELSE 'moyen' END AS niveau_sensibilite, l_linenumber::smallint AS page
FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem)""")
def entity_listing(spark, d):
    """Types, levels and pages of one document's entities."""
    lines = rows(spark, d, "lineitem")
    first = lines.agg(F.min("l_orderkey")).first()[0]
    e = lines.select(
        F.col("l_orderkey").cast("string").alias("document_id"), F.concat(F.lit("T"), "l_linenumber").alias("type_entite"), F.when(F.col("l_returnflag") == "R", "critique").otherwise("moyen").alias("niveau_sensibilite"),
        F.col("l_linenumber").cast("smallint").alias("page"), F.col("l_linenumber").alias("position_debut"), (F.col("l_linenumber") + 1).alias("position_fin"), F.lit("x").alias("empreinte_valeur"),
    )
    return catalog.entity_metadata(e, str(first))


@query("SELECT coalesce(CASE l_returnflag WHEN 'A' THEN 'regle' WHEN 'N' THEN 'ner' END, 'inconnu') AS methode, count(*)::bigint AS n FROM lineitem GROUP BY ALL")
def entities_by_method(spark, d):
    e = rows(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "A", "regle").when(F.col("l_returnflag") == "N", "ner").alias("methode"))
    return st.entities_by_method(e)


@query("""SELECT n_name AS libelle, 'r' || n_regionkey AS type, CASE WHEN c_acctbal < 0 THEN 'non_analyse' WHEN c_acctbal < 5000 THEN 'moyen' ELSE 'critique' END AS niveau, count(*)::bigint AS n
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def levels_of_sources(spark, d):
    """Documents (customers) by source (nation), its type and the highest level."""
    docs = rows(spark, d, "customer").select(F.col("c_nationkey").alias("source_id"), F.when(F.col("c_acctbal") < 0, None).when(F.col("c_acctbal") < 5000, "moyen").otherwise("critique").alias("niveau_max"))
    s = rows(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("libelle"), F.concat(F.lit("r"), "n_regionkey").alias("type"))
    return st.by_source(docs, s)


@query("SELECT c_custkey, greatest(1, ceil(count(o_orderkey) / 4))::int AS pages FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def page_counts(spark, d):
    o = rows(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = rows(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", catalog.page_count(F.coalesce("n", F.lit(0)), 4).alias("pages"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'demarrer' ELSE 'arreter' END AS change FROM supplier WHERE (s_suppkey % 2 = 0) <> (s_suppkey % 3 = 0)""")
def schedule_reload(spark, d):
    s = rows(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return catalog.schedule_changes(s.where("id % 3 = 0"), s.where("id % 2 = 0"))


@query("""SELECT doc_id, CASE WHEN i < (n * 7) // 10 THEN 'entrainement' WHEN i < (n * 85) // 100 THEN 'validation' ELSE 'test' END AS partition
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)""")
def corpus_partition(spark, d):
    return evaluate.with_partition(rows(spark, d, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", "partition")


@query("""SELECT o_orderkey AS document_id, (o_orderkey % 3 + CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE 1 END)::int AS essais,
CASE WHEN o_orderkey % 4 < 2 THEN 0 ELSE (5 * power(2, o_orderkey % 3))::int END AS attente FROM orders WHERE o_orderkey % 4 <> 2 AND o_orderkey % 3 + CASE WHEN o_orderkey % 4 < 2 THEN 0 ELSE 1 END < 3""")
def task_queue(spark, d):
    """Tasks with 0 to 2 tries: a quarter succeeds, a quarter fails, the others aren't tried."""
    o = rows(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"))
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    queue = o.select("document_id", (F.col("document_id") % 3).cast("int").alias("essais"), now.alias("pret_le"))
    outcomes = o.where("document_id % 4 >= 2").select("document_id", (F.col("document_id") % 4 == 2).alias("reussi"))
    left = catalog.finish_analyses(queue, outcomes, "2024-01-01 00:00:00")
    return left.select("document_id", "essais", (F.unix_timestamp("pret_le") - F.unix_timestamp(now)).cast("int").alias("attente"))


@query("SELECT DISTINCT o_custkey AS document_id, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END AS essais FROM orders UNION SELECT c_custkey, 1 FROM customer WHERE c_custkey % 2 = 0")
def tasks_enqueued(spark, d):
    """A task for each document that is named, however often; one that waits already stays as it is."""
    queue = rows(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("document_id"), F.lit(1).alias("essais"), F.lit("2024-01-01").cast("timestamp").alias("pret_le"))
    return catalog.enqueue(queue, rows(spark, d, "orders").select(F.col("o_custkey").alias("id")), "2024-01-02").select("document_id", "essais")


def _words(spark, d) -> DataFrame:
    """Words of all part names as readings: two a line, four a page."""
    w = rows(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "mot"))
    return w.select(
        F.col("p_partkey").alias("doc"), (F.floor(F.col("i") / 4) + 1).cast("int").alias("page"), (F.floor(F.col("i") / 2) + 1).cast("int").alias("ligne"), F.col("i").alias("rang"), "mot",
        (50 + F.col("p_partkey") % 50).cast("double").alias("confiance"),
    )


_READ = """w AS (SELECT p_partkey AS doc, unnest(string_split(p_name, ' ')) AS mot, unnest(range(0, len(string_split(p_name, ' ')))) AS i FROM part),
g AS (SELECT doc, i, mot, CASE WHEN i = 0 THEN '' WHEN i % 4 = 0 THEN chr(10) || chr(10) WHEN i % 2 = 0 THEN chr(10) ELSE ' ' END AS avant FROM w),
b AS (SELECT doc, i, mot, avant, (sum(length(avant) + length(mot)) OVER (PARTITION BY doc ORDER BY i))::int AS fin FROM g)"""


@query(f"WITH {_READ} SELECT doc, string_agg(avant || mot, '' ORDER BY i) AS texte, string_agg((fin - length(mot)) || '-' || fin || '@' || (i // 4 + 1), ',' ORDER BY i) AS boites, (50 + doc % 50)::double AS confiance FROM b GROUP BY doc")
def assembled_texts(spark, d):
    read = assemble_words(_words(spark, d))
    box = lambda b: F.concat(b["debut"].cast("string"), F.lit("-"), b["fin"].cast("string"), F.lit("@"), b["page"].cast("string"))
    return read.select("doc", "texte", F.array_join(F.transform("boites", box), ",").alias("boites"), "confiance")


@query(f"WITH {_READ}, n AS (SELECT doc, max(fin) AS n FROM b GROUP BY doc) SELECT doc, count(*) FILTER (WHERE fin - length(mot) < n.n // 2 + 3 AND n.n // 2 < fin)::int AS touchees FROM b JOIN n USING (doc) GROUP BY doc, n.n")
def boxes_of_entities(spark, d):
    """Word boxes that a span of three characters in the middle of each text overlaps."""
    read = assemble_words(_words(spark, d))
    middle = F.floor(F.length("texte") / 2).cast("int")
    e = F.array(F.struct(middle.alias("debut"), (middle + 3).alias("fin")))
    return read.select("doc", F.size(with_boxes(e, F.col("boites"))[0]["boites"]).alias("touchees"))


@query("""SELECT p_brand AS condition, p_partkey AS id, round(1000 * abs(p_size * 0.001 - (p_size + p_partkey % 3 * 20) * 0.001))::bigint AS ecart_e3 FROM part WHERE p_partkey % 3 <> 0""")
def run_divergences(spark, d):
    p = rows(spark, d, "part")
    one = lambda name, cer: p.select(F.lit(name).alias("processus"), F.col("p_brand").alias("condition"), F.col("p_partkey").alias("id"), cer.alias("cer"))
    runs = one("a", F.col("p_size") * 0.001).unionByName(one("b", (F.col("p_size") + F.col("p_partkey") % 3 * 20) * 0.001))
    return evaluate.divergences(runs).select("condition", "id", F.round(F.col("ecart") * 1000).cast("long").alias("ecart_e3"))


@query("""WITH q AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'support_n1' WHEN 1 THEN 'operations' ELSE 'conformite' END AS role, CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'eleve' ELSE 'critique' END AS n FROM orders),
a AS (SELECT CASE WHEN n IS NULL THEN NULL WHEN role = 'conformite' THEN 'complet' WHEN role = 'operations' AND n = 'eleve' THEN 'pseudonymise' ELSE 'refus' END AS p, n FROM q)
SELECT CASE WHEN coalesce(p, 'refus') = 'refus' THEN 'REFUS' ELSE 'LECTURE' END AS action, p AS politique_appliquee, n AS niveau_en_cause,
CASE WHEN p IS NULL THEN '{"motif":"document_non_analyse","code":423}' WHEN p = 'refus' THEN '{"motif":"politique_refus","code":403}' ELSE '{"code":200}' END AS details, count(*)::bigint AS n FROM a GROUP BY ALL""")
def audited_decisions(spark, d):
    """One audit row for each request (order) to a document (customer), counted by what it says."""
    o = rows(spark, d, "orders")
    role = F.when(F.col("o_orderkey") % 3 == 0, "support_n1").when(F.col("o_orderkey") % 3 == 1, "operations").otherwise("conformite")
    docs = rows(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("analyse").alias("statut"), F.when(F.col("c_custkey") % 5 == 0, None).when(F.col("c_custkey") % 2 == 0, "eleve").otherwise("critique").alias("niveau_max"))
    log = policy.audit_rows(policy.decide(o.select(role.alias("role"), F.col("o_custkey").alias("document_id")), docs, policy_matrix(spark)))
    return log.groupBy("action", "politique_appliquee", "niveau_en_cause", "details").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, page_id % 4 >= 2 AS sort FROM pages")
def escaping_keys(spark, d):
    name = F.concat(F.lit("p"), "page_id")
    key = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("a/../"), name)).when(F.col("page_id") % 4 == 1, F.concat(F.lit("./b//"), name)).when(F.col("page_id") % 4 == 2, F.concat(F.lit("../"), name)).otherwise(F.concat(F.lit("a/../../"), name, F.lit("/x")))
    return rows(spark, d, "pages").select("page_id", escapes(key).alias("sort"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name || ' é€' WHEN 1 THEN c_name || ' été’' ELSE c_name || ' déjà' END AS texte FROM customer")
def decoded_texts(spark, d):
    """Names in UTF-8, in Windows-1252 and in Latin-1."""
    n, name = F.col("c_custkey") % 3, F.encode("c_name", "UTF-8")
    more = lambda x: F.concat(name, F.unhex(F.lit(x)))
    content = F.when(n == 0, F.encode(F.concat("c_name", F.lit(" é€")), "UTF-8")).when(n == 1, more("20E974E992")).otherwise(more("2064E96AE0"))
    return rows(spark, d, "customer").select("c_custkey", tx.decode_bytes(content).alias("texte"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS clair FROM customer")
def strict_base64(spark, d):
    """Encoded names, half of them damaged by a sign that lenient decoders skip."""
    code = F.base64(F.encode("c_name", "UTF-8"))
    return rows(spark, d, "customer").select("c_custkey", tx.base64_bytes(F.when(F.col("c_custkey") % 2 == 0, code).otherwise(F.concat(F.lit("!"), code))).cast("string").alias("clair"))


@query("SELECT c_custkey, 'elodie ' || lower(c_name) AS forme FROM customer")
def stored_forms(spark, d):
    name = F.concat(F.lit("  É"), F.lit("lodie \t"), F.col("c_name"), F.lit(" "))
    return rows(spark, d, "customer").select("c_custkey", tx.stored_canonical(name).alias("forme"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE round(greatest(0, least(1, 1 - (c_custkey % 120) / 100)), 4)::double END AS cer FROM customer WHERE c_custkey % 120 > 0 OR c_custkey % 4 = 0")
def confidence_errors(spark, d):
    c = F.when(F.col("c_custkey") % 4 == 0, F.lit(-1)).otherwise(F.col("c_custkey") % 120)
    return rows(spark, d, "customer").select("c_custkey", tx.confidence_error(c).cast("double").alias("cer"))


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/tiff' WHEN 3 THEN 'text/csv' WHEN 4 THEN 'application/json' ELSE 'text/plain' END AS type_mime FROM pages""")
def content_types(spark, d):
    """By signature, announced type, extension, or none of them."""
    n, body = F.col("page_id") % 6, F.encode("html", "UTF-8")
    magic = lambda x: F.concat(F.unhex(F.lit(x)), body)
    content = F.when(n == 0, magic("255044462D")).when(n == 1, magic("89504E470D0A")).when(n == 2, magic("49492A00")).otherwise(body)
    said = F.when(n == 3, "Text/CSV; charset=utf-8").when(n == 0, "text/plain").otherwise(F.lit("application/octet-stream"))
    name = F.when(n == 4, F.concat(F.lit("p"), "page_id", F.lit(".JSON"))).otherwise(F.concat(F.lit("p"), "page_id"))
    return rows(spark, d, "pages").select("page_id", content_type(content, said, name).alias("type_mime"))


@query("""SELECT count(*)::bigint AS total, count(*) FILTER (WHERE doc_id % 6 = 0)::bigint AS critiques, printf('%.1f', 100 * count(*) FILTER (WHERE doc_id % 3 = 0) / count(*)) || ' %' AS taux FROM documents""")
def headline_figures(spark, d):
    docs = _documents(spark, d).withColumn("niveau_max", F.when(F.col("chemin_source").cast("long") % 6 == 0, "critique"))
    return st.headline(docs)


@query("""SELECT CASE WHEN o_custkey % 3 = 0 THEN 'REFUS' ELSE 'LECTURE' END AS action, CASE WHEN o_custkey % 3 = 0 THEN '{"motif":"document_inconnu"}' ELSE '{"motif":"metadonnees"}' END AS details, count(*)::bigint AS n FROM orders GROUP BY ALL""")
def metadata_views(spark, d):
    """Every order asks for a customer's metadata; a third of the customers aren't in the catalogue."""
    asked = rows(spark, d, "orders").select(F.lit("support_n1").alias("role"), F.col("o_custkey").alias("document_id"))
    docs = rows(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.lit("moyen").alias("niveau_max"))
    return policy.metadata_rows(asked, docs).groupBy("action", "details").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'd' || doc_id AS id, coalesce(CASE WHEN doc_id % 2 = 0 THEN n_chars END, -1)::bigint AS taille, doc_id % 2 = 1 AS inconnue FROM documents")
def document_listing(spark, d):
    """Sizes that aren't known stay null in a listing."""
    docs = _documents(spark, d).withColumn("taille_octets", F.when(F.col("chemin_source").cast("long") % 2 == 0, F.col("taille_octets")))
    return catalog.listing(docs).select("id", F.coalesce("taille", F.lit(-1)).alias("taille"), F.col("taille").isNull().alias("inconnue"))


@query("SELECT c_name AS identifiant, 'role' || c_nationkey AS role_code FROM customer WHERE c_custkey = (SELECT max(c_custkey) FROM customer WHERE c_acctbal > 0)")
def account_role(spark, d):
    users = rows(spark, d, "customer").select("c_custkey", F.col("c_name").alias("identifiant"), F.concat(F.lit("role"), "c_nationkey").alias("role_code"), (F.col("c_acctbal") > 0).alias("actif"))
    return catalog.account(users, users.where("actif").agg(F.max_by("identifiant", "c_custkey")).first()[0])


@query("""SELECT 'd' || doc_id AS id, doc_id::varchar AS cle, CASE WHEN length(source) % 3 <> 2 THEN CASE length(source) % 3 WHEN 0 THEN 'local' ELSE 's3' END END AS type_source, length(source) % 3 <> 2 AS connu FROM documents""")
def documents_located(spark, d):
    """Every document's key with its source's type; sources whose names have some lengths aren't known."""
    names = rows(spark, d, "documents").select(F.col("source").alias("id")).distinct().where(F.length("id") % 3 != 2)
    kinds = names.select("id", F.when(F.length("id") % 3 == 0, "local").otherwise("s3").alias("type"), F.lit("{}").alias("configuration"))
    return catalog.located(_documents(spark, d), kinds).select("id", "cle", "type_source", "connu")
