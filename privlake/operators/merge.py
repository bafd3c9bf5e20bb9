"""Arbitration between overlapping detections, classification, thresholds.

Priority: valid first, then length, then score to six places.  A document's
candidates are one array, so arbitration needs no shuffle.  Sorted by position
they are swept once and cut wherever nothing reaches across; each stretch of
overlapping candidates, a handful as a rule, is folded by itself, so the cost grows with
n log n and the square of a stretch.  ``arbitrate_many`` is for stretches of
thousands: n log n whatever overlaps, in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from privlake.functions.spans import folded, overlap
from privlake.schema import CONTEXT_TYPES, CONTEXT_WINDOW, ENTITIES, ENTITIES_DDL, IDENTIFIER_TYPES, LEVELS, level_of, literal_map, rank

_FIELDS = ("type_entite", "debut", "fin", "valeur", "score", "methode", "valide")


def _priority(e: Column) -> Column:
    return F.struct(e["valide"].cast("int").alias("v"), (e["fin"] - e["debut"]).alias("n"), F.round(e["score"], 6).alias("s"))


def _with(e: Column, **new: Column) -> Column:
    return F.struct(*[new.get(n, e[n]).alias(n) for n in _FIELDS])


def deduplicate(entities: Column) -> Column:
    """One entity for each (type, start, end): the highest priority, the first among equals; equals seen by two methods
    become 'fusion' with the higher score."""

    def step(acc: Column, x: Column) -> Column:
        same = lambda e: (e["type_entite"] == x["type_entite"]) & (e["debut"] == x["debut"]) & (e["fin"] == x["fin"])
        both = lambda e: (_priority(e) == _priority(x)) & (e["methode"] != x["methode"])
        merged = F.transform(
            acc,
            lambda e: F.when(same(e) & (_priority(x) > _priority(e)), x)
            .when(same(e) & both(e), _with(e, methode=F.lit("fusion"), score=F.greatest(e["score"], x["score"])))
            .otherwise(e),
        )
        return F.when(F.exists(acc, same), merged).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(entities, F.array().cast(ENTITIES_DDL), step)


def arbitrate(entities: Column) -> Column:
    """Deduplicated entities without those that overlap a kept one of higher priority; ties all stay; a winner over
    another method's entity becomes 'fusion'.  In order of position; null for a null array."""
    placed = F.array_sort(F.transform(entities, lambda e, i: F.struct(e["debut"].alias("a"), e["fin"].alias("b"), i.alias("i"), e.alias("e"))))
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  a lambda's argument is computed once

    def step(at: Column, x: Column) -> tuple[Column, Column, Column]:
        # equal empty spans don't overlap, and belong together
        new = (x["a"] >= at["fin"]) & (x["a"] > at["debut"])
        return F.struct(F.greatest(at["fin"], x["b"]).alias("fin"), x["a"].alias("debut")), new, F.lit(True)

    def stretches(rows: Column) -> Column:
        before = F.struct(F.lit(-1).alias("fin"), F.lit(-1).alias("debut"))
        return once(folded(rows, before, step, "array<boolean>"), lambda new: of(rows, new))

    def of(rows: Column, new: Column) -> Column:
        places = F.filter(F.transform(new, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
        cut = lambda starts: F.transform(starts, lambda s, k: F.slice(rows, s + 1, F.coalesce(F.get(starts, k + 1), F.size(rows)) - s))
        return once(places, cut)

    kept = F.transform(once(placed, stretches), lambda part: _folded(F.transform(part, lambda x: x["e"])))
    return F.when(entities.isNotNull(), F.flatten(kept))


def arbitrate_many(entities: Column) -> Column:
    """The same for documents in which thousands of candidates overlap one another: n log n in any case, one Arrow batch at a time."""
    from privlake.operators.sweep import arbitrated

    return F.udf(lambda found: None if found is None else arbitrated([tuple(e) for e in found]), ENTITIES, useArrow=True)(entities)


def _folded(entities: Column) -> Column:
    order = lambda e: F.struct(
        -e["valide"].cast("int"), e["debut"] - e["fin"], -F.round(e["score"], 6), e["debut"], e["fin"], e["type_entite"]
    )
    keyed = F.transform(deduplicate(entities), lambda e: F.struct(order(e).alias("k"), e.alias("e")))
    ranked = F.transform(F.array_sort(keyed), lambda x: x["e"])

    def step(acc: Column, x: Column) -> Column:
        beats = lambda e: overlap(e["debut"], e["fin"], x["debut"], x["fin"]) & (_priority(e) > _priority(x))
        marked = F.transform(acc, lambda e: F.when(beats(e) & (e["methode"] != x["methode"]), _with(e, methode=F.lit("fusion"))).otherwise(e))
        return F.when(F.exists(acc, beats), marked).otherwise(F.concat(acc, F.array(x)))

    kept = F.aggregate(ranked, F.array().cast(ENTITIES_DDL), step)
    placed = F.array_sort(F.transform(kept, lambda e, i: F.struct(e["debut"].alias("a"), e["fin"].alias("b"), i.alias("i"), e.alias("e"))))
    return F.transform(placed, lambda x: x["e"])


def classify(entities: Column) -> Column:
    """Entities with ``niveau``: by type; a person's name rises to 'eleve' near two kinds of identifiers."""

    def near(e: Column) -> Column:
        gap = lambda o: F.greatest(F.lit(0), o["debut"] - e["fin"], e["debut"] - o["fin"])
        close = F.filter(entities, lambda o: o["type_entite"].isin(*IDENTIFIER_TYPES) & (gap(o) <= CONTEXT_WINDOW))
        return F.size(F.array_distinct(F.transform(close, lambda o: o["type_entite"]))) >= CONTEXT_TYPES

    def one(e: Column) -> Column:
        level = level_of(e["type_entite"])
        raised = (e["type_entite"] == "NOM_PERSONNE") & (rank(level) < 2) & near(e)
        return F.struct(*[e[n].alias(n) for n in _FIELDS], F.when(raised, F.lit("eleve")).otherwise(level).alias("niveau"))

    return F.transform(entities, one)


def highest(classified: Column) -> Column:
    """The highest level of an array of entities; null without one."""
    names = literal_map(dict(enumerate(LEVELS)))
    return F.try_element_at(names, F.array_max(F.transform(classified, lambda e: rank(e["niveau"]))))


def at_least(classified: Column, threshold: Column) -> Column:
    """Entities at or above a level; an unknown entity level ranks below all, an unknown threshold lets nothing pass."""
    return F.filter(classified, lambda e: rank(e["niveau"]) >= rank(threshold, 99))


def analyse(df: DataFrame, candidates_col: str = "candidats") -> DataFrame:
    """``df`` with ``entites`` (arbitrated, classified) and ``niveau_max`` in place of the candidates."""
    d = df.withColumn("entites", arbitrate(F.col(candidates_col))).drop(candidates_col)
    d = d.withColumn("entites", classify(F.col("entites")))
    return d.withColumn("niveau_max", highest(F.col("entites")))
