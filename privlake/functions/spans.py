"""Regular-expression spans as native array expressions, exact in code points."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPAN = "array<struct<debut:int,fin:int,valeur:string>>"


#: Elements that one inner fold appends one by one; the blocks are then joined, so appending stays near linear.
BLOCK = 256
#: Matches up to which each is placed by itself.
FEW = 8
#: Set around the matches of a text that hasn't got it.
MARK = "\x01"


def folded(rows: Column, start: Column, step, out_type: str) -> Column:
    """The elements that ``step`` gives along ``rows``, in order.

    ``step(state, row)`` returns (new state, element, whether it is kept).  Spark's fold copies what it has
    gathered at every step; gathering by blocks keeps the copies short, for texts with any number of matches.
    """

    def inner(acc: Column, x: Column) -> Column:
        state, element, keep = step(acc["at"], x)
        return F.struct(state.alias("at"), F.when(keep, F.concat(acc["out"], F.array(element))).otherwise(acc["out"]).alias("out"))

    def of(r: Column) -> Column:
        def outer(acc: Column, k: Column) -> Column:
            begin = F.struct(acc["at"].alias("at"), F.array().cast(out_type).alias("out"))
            whole = lambda one: F.struct(one["at"].alias("at"), F.concat(acc["out"], F.array(one["out"])).alias("out"))
            return F.aggregate(F.slice(r, k, F.lit(BLOCK)), begin, inner, whole)

        none = F.struct(start.alias("at"), F.array().cast(f"array<{out_type}>").alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.size(r), F.lit(BLOCK)), none, outer, lambda acc: F.flatten(acc["out"]))

    # a lambda's argument is computed once, an expression at each use
    bound = F.element_at(F.transform(F.array(rows), lambda r: F.when(F.size(r) > 0, of(r))), 1)
    return F.coalesce(bound, F.array().cast(out_type))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a lambda's argument is, an expression is at each use."""
    return F.element_at(F.transform(F.array(value), use), 1)


def entries(array: Column) -> Column:
    """``array`` as a generator (``inline``, ``explode``) should take it where it is costly to compute.

    Of a bare column Spark infers that it isn't empty, and tests that below the projections that compute it: the
    whole of detection and arbitration would run there once more, with every column it uses written out at each use.
    """
    return F.filter(array, lambda x: x.isNotNull())


def spans(text: Column, pattern: str, group: int = 0, needs: str | None = None) -> Column:
    """Array of (debut, fin, valeur) of all matches of ``pattern``; of its last group if ``group`` is its number,
    which must end where the match ends.

    A match starts after the pieces and matches before it.  One replacement sets each match between two marks, and the
    marks cut the text; only texts that have the mark, and groups, search for the matches and for the pieces between
    them.  Texts without a match of the simpler pattern ``needs``, which every match holds, cost one search for that.
    """
    none = F.array().cast(SPAN)

    def searched() -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), 0)
        value = F.regexp_extract_all(text, F.lit(pattern), group) if group else found
        rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("all"), value.alias("value"))

        def step(at: Column, x: Column) -> tuple[Column, Column, Column]:
            end = at + F.length(x["gap"]) + F.length(x["all"])
            one = F.struct((end - F.length(x["value"])).alias("debut"), end.alias("fin"), x["value"].alias("valeur"))
            return F.coalesce(end, at), one, x["all"].isNotNull()

        return F.when(text.rlike(pattern), folded(rows, F.lit(0), step, SPAN)).otherwise(none)

    def marked(pieces: Column) -> Column:
        """``pieces``: those between matches and the matches in turn."""

        def step(at: Column, x: Column) -> tuple[Column, Column, Column]:
            end = at + F.length(x["piece"])
            return end, F.struct(at.alias("debut"), end.alias("fin"), x["piece"].alias("valeur")), x["match"]

        def alone(k: Column) -> Column:
            """The match after ``k`` pieces, by their lengths: gathering costs more than counting a few of them again."""
            at = F.aggregate(F.slice(pieces, F.lit(1), k), F.lit(0), lambda at, x: at + F.length(x))
            one = lambda at: F.struct(at.alias("debut"), (at + F.length(F.element_at(pieces, k + 1))).alias("fin"), F.element_at(pieces, k + 1).alias("valeur"))
            return once(at, one)

        rows = F.transform(pieces, lambda x, i: F.struct(x.alias("piece"), (i % 2 == 1).alias("match")))
        few = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1, F.lit(2)), alone)
        return F.when(F.size(pieces) == 1, none).when(F.size(pieces) <= 2 * FEW + 1, few).otherwise(folded(rows, F.lit(0), step, SPAN))

    if group:
        out = searched()
    else:
        cut = once(F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1), marked)
        out = F.when(F.contains(text, F.lit(MARK)), searched()).otherwise(cut)
    possible = text.isNotNull() if needs is None else text.rlike(needs)
    return F.when(possible, out).otherwise(none)


def trimmed(found: Column, chars: str) -> Column:
    """The spans without ``chars`` at their ends."""

    def cut(s: Column) -> Column:
        left = F.ltrim(s["valeur"], F.lit(chars)) if chars else s["valeur"]
        at = s["debut"] + F.length(s["valeur"]) - F.length(left)
        value = F.rtrim(left, F.lit(chars))
        return F.struct(at.alias("debut"), (at + F.length(value)).alias("fin"), value.alias("valeur"))

    return F.transform(found, cut)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 < b1) & (b0 < a1)


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    both = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))
    union = (a1 - a0) + (b1 - b0) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def page_of(position: Column, pages: Column) -> Column:
    """The number of the page (array of numero, debut, fin) that holds a position; 1 beside all pages; null without pages."""

    def of(at: Column) -> Column:
        """``at``: the position, computed once."""
        hit = F.filter(pages, lambda p: (p["debut"] <= at) & (at < p["fin"]))
        return F.when(F.size(pages) > 0, F.coalesce(F.try_element_at(hit, F.lit(1))["numero"], F.lit(1)))

    return F.element_at(F.transform(F.array(position), of), 1)


def to_source(position: Column, offsets: Column) -> Column:
    """Source offset of a normalised position, clamped to the table's ends."""
    return F.element_at(offsets, F.greatest(F.lit(1), F.least(position + 1, F.size(offsets))))


def from_source(offset: Column, offsets: Column) -> Column:
    """First normalised position whose source offset is at least ``offset``: a binary search, as the table doesn't fall."""
    whole = F.struct(F.lit(0).alias("lo"), F.size(offsets).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(offsets, mid) < offset
        more = s["lo"] < s["hi"]
        return F.struct(F.when(more & below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(more & ~below, mid).otherwise(s["hi"]).alias("hi"))

    # as many halvings as the size has bits
    steps = F.length(F.bin(F.coalesce(F.size(offsets), F.lit(0))))
    return F.aggregate(F.sequence(F.lit(1), F.least(steps, F.lit(32))), whole, halve, lambda s: s["lo"])


def compose(inner: Column, outer: Column) -> Column:
    """Offsets of a second rewriting in terms of the first one's source."""
    return F.transform(inner, lambda i: F.element_at(outer, i + 1))


def page_bounds(lengths: Column, offsets: Column) -> Column:
    """Pages (numero, debut, fin) in normalised positions, from the lengths of the source's pages, one after the other."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        one = F.struct(acc["at"].alias("a"), (acc["at"] + n).cast("int").alias("b"))
        return F.struct((acc["at"] + n).cast("int").alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def bounds(page: Column, i: Column) -> Column:
        a, b = (F.least(from_source(page[c], offsets), F.size(offsets) - 1) for c in ("a", "b"))
        return F.struct((i + 1).alias("numero"), a.alias("debut"), F.greatest(a, b).alias("fin"))

    return F.transform(F.aggregate(lengths, state, step)["out"], bounds)


def with_boxes(entities: Column, boxes: Column) -> Column:
    """Structs (entite, boites): each entity with the word boxes that its span overlaps."""
    return F.transform(entities, lambda e: F.struct(e.alias("entite"), F.filter(boxes, lambda b: overlap(b["debut"], b["fin"], e["debut"], e["fin"])).alias("boites")))
