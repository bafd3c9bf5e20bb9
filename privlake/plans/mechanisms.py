"""Queries over the test tables for what has a mechanism of its own: state with timers, buckets, range and edit-distance joins, order statistics, bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from privlake.functions import distance, spans as sp, text as tx
from privlake.functions.normalize import normalise, segment
from privlake.operators import catalog, detect, merge, overlap, policy, similar
from privlake.operators.selection import order_statistics
from privlake.plans import corpus
from privlake.plans.operations import _documents
from privlake.plans.registry import query, rows, spread
from privlake.schema import ENTITIES_DDL, POLICY, policy_matrix
from privlake.sources.files import extract, list_files, write_files
from privlake.streaming import retries

_START = 1_704_067_200_000_000  # 2024-01-01 in microseconds
#: Thirty days of events become four minutes, in which waits of 5 and 10 s matter.
_FASTER = 10_000
_KINDS = {"signup": "tache", "view": "tache", "error": "echec", "click": "echec", "purchase": "reussi"}


def _outcomes(spark, path: str, stream: bool = False):
    schema = rows(spark, path, "events").schema
    if stream:
        # a stream's source is a folder or a pattern, never a single file's name alone
        e = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{path}/events.parquet*")
    else:
        e = rows(spark, path, "events")
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in _KINDS.items()])
    micros = F.lit(_START) + F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - _START) / _FASTER)
    return e.select(F.col("user_id").cast("string").alias("document_id"), kind.alias("evenement"), F.timestamp_micros(micros).alias("instant"))


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS doc, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items())} END AS k, {_START} + floor((epoch_us(ts) - {_START}) / {_FASTER})::bigint AS t FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY t, CASE k WHEN 'tache' THEN 0 WHEN 'echec' THEN 1 ELSE 2 END) AS rn FROM e),
s AS (SELECT DISTINCT doc, 0::bigint AS rn, NULL::int AS essais, NULL::bigint AS pret, false AS attend FROM e
UNION ALL SELECT n.doc, n.rn,
 CASE WHEN essais IS NULL THEN CASE WHEN k = 'tache' THEN 0 END WHEN k = 'tache' OR (attend AND pret > t) THEN essais WHEN k = 'reussi' OR essais >= 2 THEN NULL ELSE essais + 1 END,
 CASE WHEN essais IS NULL THEN CASE WHEN k = 'tache' THEN t END WHEN k = 'tache' OR (attend AND pret > t) THEN pret WHEN k = 'reussi' OR essais >= 2 THEN NULL ELSE t + 5000000 * (1 << essais) END,
 CASE WHEN essais IS NULL THEN false WHEN attend AND pret > t THEN true WHEN k = 'echec' AND essais < 2 THEN true ELSE false END
 FROM s JOIN n ON n.doc = s.doc AND n.rn = s.rn + 1),
x AS (SELECT n.doc, n.t, n.k, p.essais AS e0, p.pret AS p0, p.attend AS a0, c.essais AS e1, c.pret AS p1 FROM n JOIN s p ON p.doc = n.doc AND p.rn = n.rn - 1 JOIN s c ON c.doc = n.doc AND c.rn = n.rn),
o AS (SELECT doc, 'reprise' AS etat, e0 AS essais, p0 AS instant FROM x WHERE a0 AND p0 <= t
UNION ALL SELECT doc, 'en_file', 0, t FROM x WHERE e0 IS NULL AND k = 'tache'
UNION ALL SELECT doc, CASE WHEN k = 'reussi' THEN 'termine' WHEN e0 >= 2 THEN 'abandonne' ELSE 'attend' END, CASE WHEN k = 'reussi' THEN e0 ELSE e0 + 1 END, CASE WHEN k = 'echec' AND e0 < 2 THEN p1 ELSE t END FROM x WHERE e0 IS NOT NULL AND k <> 'tache' AND NOT (a0 AND p0 > t)
UNION ALL SELECT s.doc, 'reprise', s.essais, s.pret FROM s JOIN (SELECT doc, max(rn) AS rn FROM n GROUP BY doc) USING (doc, rn) WHERE attend AND pret <= (SELECT max(t) FROM e) - 1000000)
SELECT doc::varchar AS document_id, etat, essais::int AS essais, instant::bigint AS instant FROM o""")
def retry_transitions(spark, d):
    """The retry machine as a stream with state and timers over all events, once; every transition."""
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key, None)
    spark.conf.set(key, retries.ROCKSDB)
    try:
        path = catalog.shared_path(spark)
        q = retries.transitions(_outcomes(spark, d, stream=True), "1 second").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
        q.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, was) if was is not None else spark.conf.unset(key)
    log = spark.read.schema(retries.TRANSITIONS).parquet(f"{path}/out")
    last = _outcomes(spark, d).agg(F.max(F.unix_micros("instant"))).first()[0]
    if last is not None:
        log = log.unionByName(retries.ended(log, F.timestamp_micros(F.lit(last - 1_000_000))))
    return log.select("document_id", "etat", "essais", F.unix_micros("instant").alias("instant"))


@query("""SELECT 'd' || doc_id AS id, CASE WHEN doc_id = 0 THEN 'analyse' WHEN doc_id % 3 = 0 THEN 'echec' ELSE 'decouvert' END AS statut, (CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END)::smallint AS tentatives, 1::bigint AS seaux FROM documents""")
def bucketed_change(spark, d):
    """A change of one document in a catalogue of 16 buckets; one bucket is read and written."""
    docs, path = _documents(spark, d), catalog.shared_path(spark)
    catalog.create_bucketed(docs, path, "id", 16)
    change = spark.sql("SELECT 'd0' AS id, 'analyse' AS statut, cast(NULL AS string) AS motif")
    touched = catalog.change_bucketed(spark, path, docs.schema, "id", 16, change, catalog.update_status)
    return catalog.bucketed(spark, path, docs.schema).select("id", "statut", "tentatives", F.lit(len(touched)).cast("long").alias("seaux"))


@query("""WITH e AS (SELECT l_suppkey AS doc, l_orderkey * 8 + l_linenumber AS i, (l_partkey * 7919) % 100000 AS a, (l_partkey * 7919) % 100000 + CASE WHEN l_linenumber = 7 THEN 5000 ELSE l_quantity::bigint END AS b FROM lineitem),
b AS (SELECT 1 + o_custkey % (SELECT max(l_suppkey) FROM lineitem) AS doc, o_orderkey AS j, (o_orderkey * 104729) % 100000 AS a, (o_orderkey * 104729) % 100000 + o_custkey % 40 AS b FROM orders)
SELECT e.i, b.j FROM e JOIN b ON e.doc = b.doc AND e.a < b.b AND b.a < e.b""")
def overlapping_boxes(spark, d):
    """Entities and word boxes as two tables: every pair that overlaps in a document."""
    lines = rows(spark, d, "lineitem")
    docs = lines.agg(F.max("l_suppkey")).first()[0]
    at = (F.col("l_partkey") * 7919) % 100000
    e = lines.select(F.col("l_suppkey").alias("doc"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("i"), at.alias("debut"), (at + F.when(F.col("l_linenumber") == 7, 5000).otherwise(F.col("l_quantity").cast("long"))).alias("fin"))
    at = (F.col("o_orderkey") * 104729) % 100000
    b = rows(spark, d, "orders").select((1 + F.col("o_custkey") % docs).alias("doc"), F.col("o_orderkey").alias("j"), at.alias("debut"), (at + F.col("o_custkey") % 40).alias("fin"))
    return overlap.overlap_join(e, b, ["doc"]).select("gauche.i", "droite.j")


@query("""WITH s AS (SELECT l_returnflag AS condition, list(l_extendedprice ORDER BY l_extendedprice) AS v FROM lineitem GROUP BY ALL)
SELECT condition, len(v)::bigint AS n, v[(len(v) - 1) // 2 + 1] AS bas, v[len(v) // 2 + 1] AS haut, v[least(len(v) - 1, len(v) * 9 // 10) + 1] AS p90 FROM s""")
def exact_percentiles(spark, d):
    """Order statistics of all prices of a condition, without gathering them."""
    n = F.col("n")
    rates = rows(spark, d, "lineitem").select(F.col("l_returnflag").alias("condition"), F.col("l_extendedprice").alias("cer"))
    return order_statistics(rates, "condition", "cer", {"bas": F.floor((n - 1) / 2), "haut": F.floor(n / 2), "p90": F.least(n - 1, F.floor(n * 9 / 10))})


@query("""WITH l AS (SELECT c_nationkey AS doc, c_custkey AS i, substr(md5(c_custkey::varchar), 1, 6 + (c_custkey % 9)::int) AS v FROM customer), r AS (SELECT doc, i AS j, substr(v, 1, 2) || 'zz' || substr(v, 4) AS v FROM l)
SELECT i, j, levenshtein(l.v, r.v)::int AS distance FROM l JOIN r USING (doc) WHERE 1 - levenshtein(l.v, r.v) / greatest(length(l.v), length(r.v)) >= 0.6""")
def similar_customers(spark, d):
    """Values and misread values of a nation's customers that are at least 0.6 alike."""
    c = spread(rows(spark, d, "customer"), "c_custkey")
    v = F.substr(F.md5(F.col("c_custkey").cast("string")), F.lit(1), (6 + F.col("c_custkey") % 9).cast("int"))
    left = catalog.materialise(c.select(F.col("c_nationkey").alias("doc"), F.col("c_custkey").alias("i"), v.alias("v")))
    right = left.select("doc", F.col("i").alias("j"), F.concat(F.substr("v", F.lit(1), F.lit(2)), F.lit("zz"), F.substr("v", F.lit(4))).alias("v"))
    pairs = similar.similar_join(left, right, ["doc"], "v", 0.4).select("gauche.i", "droite.j", F.col("gauche.v").alias("a"), F.col("droite.v").alias("b"))
    return pairs.select("i", "j", F.levenshtein("a", "b").alias("distance"))


@query("SELECT doc_id, (length(text) - length(replace(text, 'z', '')))::int AS distance FROM documents")
def long_distances(spark, d):
    """Distance of whole texts from copies in which every z was misread."""
    t = rows(spark, d, "documents").select("doc_id", "text")
    return t.select("doc_id", distance.levenshtein(F.col("text"), F.replace("text", F.lit("z"), F.lit("¤"))).alias("distance"))


_ASKED = "(VALUES " + ", ".join(f"({i}, '{r}')" for i, r in enumerate((*POLICY, "inconnu"))) + ") AS r(k, role)"
_LEVEL = "CASE WHEN o_totalprice < 50000 THEN 'faible' WHEN o_totalprice < 150000 THEN 'moyen' WHEN o_totalprice < 300000 THEN 'eleve' ELSE 'critique' END"


def _requests(spark, d):
    roles = F.array(*map(F.lit, (*POLICY, "inconnu")))
    return rows(spark, d, "orders").select(F.get(roles, (F.col("o_custkey") % (len(POLICY) + 1)).cast("int")).alias("role"), F.expr(_LEVEL).alias("niveau"))


_CELLS = "(VALUES " + ", ".join(f"('{r}', '{n}', '{a}')" for r, x in POLICY.items() for n, a in zip(("faible", "moyen", "eleve", "critique"), x, strict=True)) + ") AS m(role, niveau, action)"


@query(f"""SELECT role, niveau, coalesce(action, 'refus') AS action, count(*)::bigint AS demandes FROM (SELECT role, {_LEVEL} AS niveau FROM orders JOIN {_ASKED} ON o_custkey % {len(POLICY) + 1} = k) LEFT JOIN {_CELLS} USING (role, niveau) GROUP BY ALL""")
def access_matrix(spark, d):
    """The cells of the matrix that all orders, as requests, ask for, with their number; no cell, no access."""
    cells = policy.listing(policy_matrix(spark)).select("role", "niveau", "action")
    asked = _requests(spark, d).groupBy("role", "niveau").agg(F.count(F.lit(1)).alias("demandes"))
    return asked.join(F.broadcast(cells), ["role", "niveau"], "left").select("role", "niveau", F.coalesce("action", F.lit("refus")).alias("action"), "demandes")  # 24 cells


@query(f"""SELECT role AS code, count(*)::bigint AS demandes FROM orders JOIN {_ASKED} ON o_custkey % {len(POLICY) + 1} = k WHERE role <> 'inconnu' GROUP BY ALL""")
def known_roles(spark, d):
    """Requests by role, of the roles that the matrix knows."""
    known = policy.roles(policy_matrix(spark)).withColumnRenamed("role", "code")
    asked = _requests(spark, d).groupBy(F.col("role").alias("code")).agg(F.count(F.lit(1)).alias("demandes"))
    return asked.join(F.broadcast(known), "code", "left_semi")  # a row a role


@query("""WITH p AS (SELECT c_custkey, 12 + length(c_name) AS n FROM customer), k AS (SELECT c_custkey, n, unnest(range(1, 4)) AS numero FROM p)
SELECT c_custkey, numero::int AS numero, ((numero - 1) * n)::int AS debut, (CASE WHEN numero < 3 THEN numero * n ELSE 3 * n - 2 END)::int AS fin, ((numero - 1) * n + 5)::int AS position, numero::int AS page FROM k""")
def pages_of_texts(spark, d):
    """Three untidy pages a customer: their bounds in the normalised text, the place there of each page's number, and its page."""
    page = lambda k: F.concat(F.lit(f"Page  {k} de "), F.col("c_name"), F.lit("\n\n" if k < 3 else ""))
    c = spread(rows(spark, d, "customer"), "c_custkey").select("c_custkey", F.concat(*[page(k) for k in (1, 2, 3)]).alias("source"), F.array(*[F.length(page(k)) for k in (1, 2, 3)]).alias("longueurs"))
    c = c.withColumn("x", normalise("source")).withColumn("pages", sp.page_bounds(F.col("longueurs"), F.col("x.map_offsets")))
    c = c.select("c_custkey", "x", "longueurs", "pages", F.posexplode(sp.entries(F.col("pages"))).alias("k", "p"))
    before = F.aggregate(F.slice("longueurs", 1, F.col("k")), F.lit(0), lambda a, n: a + n)
    c = c.withColumn("position", sp.from_source(before + 6, F.col("x.map_offsets")))
    return c.select("c_custkey", "p.numero", "p.debut", "p.fin", "position", sp.page_of(F.col("position"), F.col("pages")).alias("page"))


@query("""WITH RECURSIVE t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
s AS (SELECT doc_id, text, n, 0::bigint AS debut, least(n, 2048) AS bout FROM t
UNION ALL SELECT doc_id, text, n, nx, least(n, nx + 2048) FROM (SELECT doc_id, text, n, greatest(fin - 256, debut + 1) AS nx, fin FROM (
  SELECT *, CASE WHEN bout >= n OR instr(reverse(substr(text, debut + 897, bout - debut - 896)), ' ') = 0 THEN bout ELSE bout - instr(reverse(substr(text, debut + 897, bout - debut - 896)), ' ') END AS fin FROM s)) WHERE fin < n)
SELECT doc_id, debut::int AS debut, (CASE WHEN bout >= n OR instr(reverse(substr(text, debut + 897, bout - debut - 896)), ' ') = 0 THEN bout ELSE bout - instr(reverse(substr(text, debut + 897, bout - debut - 896)), ' ') END)::int AS fin FROM s""")
def text_segments(spark, d):
    """Overlapping windows of whole documents, cut at spaces, as models read them."""
    return rows(spark, d, "documents").select("doc_id", F.inline(segment("text")))


@query("""WITH e AS (SELECT l_orderkey AS doc, l_linenumber % 2 AS a, l_quantity / 100 AS s, CASE WHEN l_returnflag = 'A' THEN 'regle' ELSE 'ner' END AS m FROM lineitem),
b AS (SELECT doc, a, max(s) AS s FROM e GROUP BY ALL)
SELECT doc, a::int AS debut, round(b.s * 100)::int AS score, CASE WHEN count(DISTINCT m) > 1 THEN 'fusion' ELSE min(m) END AS methode FROM e JOIN b USING (doc, a) WHERE e.s = b.s GROUP BY ALL""")
def deduplicated_entities(spark, d):
    """One entity for each span of an order's candidates; equals of two methods are a fusion."""
    a = F.col("l_linenumber") % 2
    one = F.struct(F.lit("EMAIL"), a, a + 5, F.lit("v"), F.col("l_quantity") / 100, F.when(F.col("l_returnflag") == "A", "regle").otherwise("ner"), F.lit(False))
    docs = rows(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.collect_list(one).cast(ENTITIES_DDL).alias("c"))
    return docs.select("doc", F.inline(merge.deduplicate(F.col("c")))).select("doc", "debut", F.round(F.col("score") * 100).cast("int").alias("score"), "methode")


@query("SELECT page_id::varchar AS cle, CASE WHEN page_id % 5 = 0 THEN '' ELSE html END AS texte, CASE WHEN page_id % 5 = 0 THEN 'aucune' ELSE 'texte' END AS methode, CASE WHEN page_id % 5 = 0 THEN 0 ELSE 1 END::int AS pages FROM pages")
def extracted_texts(spark, d):
    """Pages through extraction by type: HTML is read as it stands, a fifth is empty."""
    content = F.when(F.col("page_id") % 5 == 0, F.lit(b"")).otherwise(F.encode("html", "UTF-8"))
    r = rows(spark, d, "pages").select(F.col("page_id").cast("string").alias("cle"), content.alias("content"), F.lit("text/html; charset=utf-8").alias("type_mime"))
    return extract(r).select("cle", "texte", "methode", F.size("pages").alias("pages"))


@query(r"""SELECT doc_id, sha256(regexp_replace(replace(strip_accents(nfc_normalize(lower(text))), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g')) AS cle FROM documents WHERE text IS NOT NULL""")
def comparison_keys(spark, d):
    """Comparison keys of whole texts in four languages, hashed: no case, no marks, letters and digits only."""
    t = rows(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", F.sha2(tx.comparison_key(F.col("text")), 256).alias("cle"))


@query("SELECT 'a/' || (page_id % 7) || '/' || page_id || '.html' AS cle, (CASE WHEN page_id % 5 = 0 THEN 0 ELSE octet_length(encode(html)) END)::bigint AS taille, sha256(CASE WHEN page_id % 5 = 0 THEN '' ELSE html END) AS empreinte FROM pages")
def files_written_and_listed(spark, d):
    """Every page as a file of its own, in folders, and the listing of those files; a fifth is empty."""
    html = F.when(F.col("page_id") % 5 == 0, F.lit("")).otherwise(F.col("html"))
    key = F.concat(F.lit("a/"), (F.col("page_id") % 7).cast("string"), F.lit("/"), F.col("page_id").cast("string"), F.lit(".html"))
    root = catalog.shared_path(spark)
    write_files(rows(spark, d, "pages").select(key.alias("cle"), F.encode(html, "UTF-8").alias("content")), root)
    return list_files(spark, root).select("cle", "taille", F.sha2("content", 256).alias("empreinte"))


@query(f"{corpus.oracle_rows()} SELECT id, true AS trouvee FROM s WHERE type = 'ADRESSE_POSTALE'")
def corpus_addresses(spark, d):
    """Whether the rules find something in each address of the corpus: a join of written and found intervals."""
    made = catalog.materialise(corpus.documents(spread(rows(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id")))
    wanted = made.select("id", F.inline(sp.entries(F.col("entites")))).where("type = 'ADRESSE_POSTALE'").select("id", "debut", "fin")
    found = catalog.materialise(made.select("id", F.inline(detect.addresses(F.col("texte")))).select("id", "debut", "fin"))
    hit = overlap.overlap_join(wanted, found, ["id"]).select("gauche.*").distinct().withColumn("trouvee", F.lit(True))
    return wanted.join(hit, ["id", "debut", "fin"], "left").select("id", F.coalesce("trouvee", F.lit(False)).alias("trouvee"))
