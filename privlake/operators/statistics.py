"""Aggregates over the catalogue and the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from privlake.functions.text import suffix


def counted(df: DataFrame, key: Column, name: str, default: str = "inconnu") -> DataFrame:
    """(name, n) with a default for null keys; partial sums before the one small shuffle."""
    return df.groupBy(F.coalesce(key, F.lit(default)).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def by_status(documents: DataFrame) -> DataFrame:
    return counted(documents, F.col("statut"), "statut")


def by_level(documents: DataFrame) -> DataFrame:
    return counted(documents, F.col("niveau_max"), "niveau", "non_analyse")


def by_source(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """(libelle, type, niveau, n): documents are counted by source before the join, so it sees a few rows a source."""
    few = documents.groupBy("source_id", F.coalesce("niveau_max", F.lit("non_analyse")).alias("niveau")).agg(F.count(F.lit(1)).alias("n"))
    d = few.join(sources.select(F.col("id").alias("source_id"), "libelle", "type"), "source_id")
    return d.groupBy("libelle", "type", "niveau").agg(F.sum("n").alias("n"))


def source_cards(by_source_: DataFrame) -> DataFrame:
    """(libelle, total, niveaux): a map of counts by level for each label; levels of equal labels add up."""
    d = by_source_.groupBy("libelle", "niveau").agg(F.sum("n").alias("n"))
    return d.groupBy("libelle").agg(F.sum("n").alias("total"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("niveau", "n")))).alias("niveaux"))


def level_shares(by_source_: DataFrame) -> DataFrame:
    """Share of each level in its source; levels without documents are left out."""
    total = F.sum("n").over(Window.partitionBy("libelle"))
    return by_source_.where("n > 0").select("libelle", "niveau", "n", (F.col("n") / F.greatest(total, F.lit(1))).alias("part"))


def entities_by_type(entities: DataFrame) -> DataFrame:
    d = entities.groupBy("type_entite", "niveau_sensibilite").agg(F.count(F.lit(1)).alias("n"))
    return d.orderBy(F.desc("n"), "type_entite", "niveau_sensibilite")


def entities_by_method(entities: DataFrame) -> DataFrame:
    return counted(entities, F.col("methode"), "methode")


def by_action(log: DataFrame) -> DataFrame:
    return counted(log, F.col("action"), "action")


def by_policy(log: DataFrame) -> DataFrame:
    return counted(log, F.col("politique_appliquee"), "politique", "sans_objet")


def failure_rate(documents: DataFrame) -> DataFrame:
    """(total, echecs, taux): failures over documents to four places, 0 for none."""
    d = documents.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("statut") == "echec").alias("echecs"))
    return d.withColumn("taux", F.when(F.col("total") > 0, F.round(F.col("echecs") / F.col("total"), 4)).otherwise(F.lit(0.0)))


def headline(documents: DataFrame) -> DataFrame:
    """(total, critiques, taux): documents, those of level 'critique', and the failures as a percentage with one decimal."""
    d = documents.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(F.col("niveau_max"), F.lit("")) == "critique").alias("critiques"), F.count_if(F.col("statut") == "echec").alias("e"))
    share = F.when(F.col("total") > 0, 100 * F.col("e") / F.col("total")).otherwise(F.lit(0.0))
    return d.select("total", "critiques", F.concat(F.format_number(share, 1), F.lit(" %")).alias("taux"))


def last_scans(runs: DataFrame, sources: DataFrame, n: int = 30) -> DataFrame:
    """The last runs with their source's label."""
    d = runs.join(sources.select(F.col("id").alias("source_id"), "libelle"), "source_id")
    return d.orderBy(F.desc("demarre_le"), "source_id").limit(n)


def inventory(corpus: DataFrame, by: Column, name: str) -> DataFrame:
    """Documents, characters and share by a key of the corpus."""
    d = corpus.groupBy(by.alias(name)).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("texte")).alias("caracteres"))
    return d.withColumn("part", F.col("documents") / F.sum("documents").over(Window.partitionBy()))  # a row for each key


def corpus_tables(corpus: DataFrame) -> DataFrame:
    """(section, cle, niveau, documents, entites, caracteres, part) of an annotated corpus: in all, by document type, file
    format and partition, and its entities by type and level.

    ``part`` is the share of the section's documents, or entities.  Two aggregations, whatever the number of sections.
    """
    key = lambda section, c: F.struct(F.lit(section).alias("section"), c.cast("string").alias("cle"))
    sections = F.array(key("total", F.lit("documents")), key("type_document", F.col("typeDocument")), key("format", suffix(F.col("chemin"))), key("partition", F.col("partition")))
    d = corpus.select(F.explode(sections).alias("k"), F.size(F.coalesce("entites", F.array())).alias("e"), F.length("texte").alias("c"))
    d = d.groupBy("k.section", "k.cle").agg(F.count(F.lit(1)).alias("documents"), F.sum("e").alias("entites"), F.sum("c").alias("caracteres"))
    e = corpus.select(F.explode("entites").alias("e"))
    e = e.select(F.explode(F.array(
        F.struct(F.lit("entite").alias("section"), F.col("e.type").alias("cle"), F.col("e.niveau").alias("niveau")),
        F.struct(F.lit("niveau").alias("section"), F.col("e.niveau").alias("cle"), F.col("e.niveau").alias("niveau")),
    )).alias("k")).groupBy("k.section", "k.cle").agg(F.max("k.niveau").alias("niveau"), F.count(F.lit(1)).alias("entites"))
    share = lambda c: (F.col(c) / F.sum(c).over(Window.partitionBy("section"))).alias("part")  # noqa: E731  a row for each key
    none = F.lit(None)
    one = d.select("section", "cle", none.cast("string").alias("niveau"), "documents", "entites", "caracteres", share("documents"))
    return one.unionByName(e.select("section", "cle", "niveau", none.cast("long").alias("documents"), "entites", none.cast("long").alias("caracteres"), share("entites")))


def overlap_of_values(train: DataFrame, test: DataFrame) -> DataFrame:
    """(communes, test, taux, alerte): distinct values, lower case, of the test part that training has; alert over a quarter."""
    a, b = (x.select(F.lower("valeur").alias("v")).where("v IS NOT NULL").distinct() for x in (train, test))
    d = b.join(a.withColumn("_in", F.lit(1)), "v", "left").agg(F.count("_in").alias("communes"), F.count(F.lit(1)).alias("test"))
    d = d.withColumn("taux", F.when(F.col("test") > 0, F.col("communes") / F.col("test")).otherwise(F.lit(0.0)))
    return d.withColumn("alerte", F.col("taux") > 0.25)
