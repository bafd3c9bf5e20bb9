"""Edit-distance join: pairs of similar values, without comparing all values of a group.

Similarity is 1 - distance / longer length, so two values with similarity 1 - t or more are at most
d = floor(t * longer length) edits apart, and the shorter has at least (1 - t) times the longer's length.  An
edit changes ``Q`` of a value's ``Q``-grams at most, so of any Q * d + 1 grams of one value at least one is left in
the other.  Each value sends its Q * d + 1 rarest grams (by a count over both sides), with d for the longest partner
it may have: two similar values share one of those.  The rest is a filter by length and by number of
common grams, and then the distance itself.

Values too short for that (Q * d grams or fewer) meet by length: they send their length, and the other side's values
send the lengths of the short values that could be similar to them.  A pair meets by length once at most, so nothing is sorted out
afterwards.  Equal values are compared once and come back to their rows afterwards, so a value that a third of the rows
hold costs no more than another.

Where a key has many left values of one length, right ones meet them by pieces instead.  Of d + 1 pieces that don't overlap, d
edits leave one as it is, and one such piece has as many edits before it as pieces: that bounds its place in the left value.  A
character that no left value has is a piece which is never left, so the others are longer, and fewer values share them.

All that is for keys with many rows.  A key with at most ``FEW`` rows on each side is a small group, whose pairs are
compared as they are: one join by key.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from privlake.operators.catalog import materialise

Q = 2
#: Rows of a key, on each side, up to which its pairs are compared as they are.
FEW = 64
#: Left values of one length, in a key, from which on right ones meet them by pieces.
CROWD = 256
#: Length up to which right values are cut, and places where the pieces of one may lie in left values of one length.
LONGEST, PLACES = 32, 64
#: Characters of a piece that are looked up.
LETTERS = 4


def _edits(length: Column, tolerance: float) -> Column:
    """Edits to the longest partner a value of this length may have."""
    longest = F.floor(length / (1 - tolerance) + 1e-9)
    return F.floor(longest * tolerance + 1e-9).cast("int")


def _grams(value: Column) -> Column:
    n = F.length(value) - Q + 1
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(value, i, F.lit(Q)))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def _short(length: Column, tolerance: float) -> Column:
    return F.greatest(length - Q + 1, F.lit(0)) <= Q * _edits(length, tolerance)


def _distinct(df: DataFrame, keys: list[str], col: str, side: str) -> DataFrame:
    """Distinct values of a side."""
    return df.select(*keys, F.col(col).alias("v")).where(F.col("v").isNotNull()).distinct().withColumn("cote", F.lit(side))


def _signed(values: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """(cote, keys, v, grammes, signe): the grams, repeated ones told apart by number, by which a value meets similar ones."""
    n = F.length("v")
    numbered = F.transform("grammes", lambda g, i: F.concat(g, (i + 1 - F.array_position("grammes", g)).cast("string")))
    cut = values.where(~_short(n, tolerance)).withColumn("grammes", F.array_sort(_grams(F.col("v"))))
    by_gram = cut.select("cote", *keys, "v", "grammes", F.explode(numbered).alias("signe"))
    common = by_gram.groupBy("signe").agg(F.count(F.lit(1)).alias("_n"))
    rank = F.row_number().over(Window.partitionBy("cote", *keys, "v").orderBy("_n", "signe"))
    rare = by_gram.join(common, "signe").withColumn("_r", rank).where(F.col("_r") <= Q * _edits(n, tolerance) + 1)
    names = ["cote", *keys, "v", "grammes", "signe"]
    return rare.select(*names)


def _lengths(values: DataFrame, keys: list[str], tolerance: float, among: str | None = None) -> DataFrame:
    """(cote, keys, v, signe): the lengths by which pairs with a short value meet, those with a short left one by its length alone.

    ``among`` names a column with the lengths of left values that a right one meets so, null for all.
    """
    n = F.length("v")
    around = F.sequence(F.ceil(n * (1 - tolerance) - 1e-9).cast("int"), F.floor(n / (1 - tolerance) + 1e-9).cast("int"))
    asked = lambda side: F.coalesce(F.array_intersect(around, among), around) if among and side == "g" else around
    sent = lambda side: F.transform(F.filter(asked(side), lambda m: _short(m, tolerance)), lambda m: F.concat(F.lit(f"{side}="), m.cast("string")))
    own = lambda side: F.array(F.concat(F.lit(f"{side}="), n.cast("string")))
    left = F.when(_short(n, tolerance), own("g")).otherwise(sent("d"))
    right = F.when(_short(n, tolerance), F.concat(sent("g"), own("d"))).otherwise(sent("g"))
    return values.select("cote", *keys, "v", F.explode(F.when(F.col("cote") == "g", left).otherwise(right)).alias("signe"))


def _edits_of_pair(tolerance: float) -> Column:
    return F.floor(F.greatest(F.length("g"), F.length("d")) * tolerance + 1e-9).cast("int")


def _places(mask: str, n: int, d: int) -> list[tuple[int, int, int, int]] | None:
    """(n, q, p, l): a left value of length ``n`` within ``d`` edits has some l characters at q that the right one has at p.

    ``mask`` is the right value, with "!" for a character that no left one has and "." for another.  None if it has too few characters.
    The pieces are those with the fewest common places, as if 16 characters were equally common.
    """
    m, gone = len(mask), mask.count("!")
    if gone > d or max(n, m) - d > m - gone:  # an edit for each, and so many characters must be alike
        return []
    if m <= d:
        return None
    # by number of pieces so far: their cost and they themselves, as (first q, last q, p, l)
    best: list[dict[int, tuple[float, tuple]]] = [{0: (0.0, ())}, *({} for _ in range(m))]
    before = 0
    for p, c in enumerate(mask):
        for j, (cost, cut) in best[p].items():
            if c == "!":
                options = [(1, j + 1, cost, cut)]
            else:
                first = max(p - j, p + n - m - (d - j - (gone - before)), 0)
                last = min(p + j - before, p + n - m + d - j)
                options = [(1, j, cost, cut)]
                for size in range(1, min(LETTERS, m - p) + 1):
                    if j > d or "!" in mask[p : p + size]:
                        break
                    most = min(last, n - size)
                    options.append((size, j + 1, cost + max(most - first + 1, 0) * 16.0**-size, (*cut, (first, most, p, size))))
            for size, k, price, pieces in options:
                if k not in best[p + size] or price < best[p + size][k][0]:
                    best[p + size][k] = (price, pieces)
        before += c == "!"
    return [(n, q, p, size) for first, last, p, size in best[m][d + 1][1] for q in range(first, last + 1)]


def _cuts(mask: str, lengths: list[int], tolerance: float) -> tuple[list[int], list[tuple[int, int, int, int]]]:
    """The lengths of short left values, of ``lengths``, that a right one meets by pieces, and the places of those."""
    m, told, cuts = len(mask), [], []
    for n in lengths:
        if math.ceil(m * (1 - tolerance) - 1e-9) <= n <= math.floor(m / (1 - tolerance) + 1e-9):
            places = _places(mask, n, math.floor(max(n, m) * tolerance + 1e-9))
            if places is not None and len(places) <= PLACES:
                told.append(n)
                cuts += places
    return told, cuts


def _bag(letters: str) -> Column:
    """How often a value has each letter, in a long: a bit each time up to three, so the bits that one bag has more are edits at least."""
    lists = F.translate("v", letters, "".join(chr(97 + k % 21) for k in range(len(letters))))
    moved = lambda to, x, by: F.call_function(f"shift{to}", x, by)

    def add(bag: Column, c: Column) -> Column:
        at = (F.ascii(c) - 97) * 3
        count = moved("right", bag, at).bitwiseAND(F.lit(7))
        return bag.bitwiseOR(moved("left", (count * 2 + 1).bitwiseAND(F.lit(7)), at))

    return F.aggregate(F.split(lists, ""), F.lit(0).cast("long"), add)


def _by_pieces(values: DataFrame, keys: list[str], tolerance: float, tasks: int) -> tuple[DataFrame, DataFrame] | None:
    """Pairs (keys, g, d) whose left value has a length that many of its key have, and the values with the left lengths that remain."""
    n = F.length("v")
    lengths = values.where((F.col("cote") == "g") & _short(n, tolerance)).groupBy(*keys, n.alias("n")).agg(F.count(F.lit(1)).alias("_n"))
    crowd = F.collect_list(F.when(F.col("_n") >= CROWD, F.col("n")))
    crowds = materialise(lengths.groupBy(*keys).agg(F.collect_list("n").alias("longueurs"), crowd.alias("foules")).where(F.size("foules") > 0))
    common = sorted(x[0] for x in crowds.select(F.explode("foules")).distinct().collect())
    common = [x for x in common if x <= LONGEST / (1 - tolerance)]
    if not common:
        return None
    # no more letters than Unicode has code points
    letters = values.select("cote", F.explode(F.split("v", "")).alias("c")).distinct().collect()
    known = sorted(x.c for x in letters if x.cote == "g")
    others = sorted({x.c for x in letters} - {*known})
    letters = "".join([*known, *others])
    mask = F.when((F.col("cote") == "d") & (n <= LONGEST), F.translate("v", letters, "." * len(known) + "!" * len(others)))
    marked = values.join(crowds, keys, "left").withColumns({"masque": F.when(F.col("foules").isNotNull(), mask), "sac": _bag(letters)})
    marked = materialise(marked.repartition(tasks, "v"))
    cut = F.udf(lambda m: _cuts(m, common, tolerance), "dits array<int>, lieux array<struct<n: int, q: int, p: int, l: int>>")
    masks = marked.select("masque").where("masque IS NOT NULL").distinct().repartition(tasks, "masque")  # 1 to 70 ms each, few or many
    cuts = materialise(masks.withColumn("c", cut("masque")))
    left, right = marked.where("cote = 'g'"), marked.where("cote = 'd'").join(cuts, "masque", "left")

    at = cuts.select(F.explode("c.lieux").alias("x")).groupBy(F.col("x.n").alias("n")).agg(F.collect_set(F.struct("x.q", "x.l")).alias("lieux"))
    sign = lambda n, start: F.xxhash64(*keys, n, "x.q", F.substr("v", start + 1, F.col("x.l"))).alias("signe")
    l = left.withColumn("n", n).where(F.array_contains("foules", F.col("n"))).join(at, "n").select(*keys, "n", "v", "sac", F.explode("lieux").alias("x"))  # noqa: E741
    l = l.select(*keys, F.col("v").alias("g"), F.col("sac").alias("gs"), sign(F.col("n"), F.col("x.q")))  # noqa: E741
    r = right.select(*keys, "v", "sac", "foules", F.explode("c.lieux").alias("x")).where(F.array_contains("foules", F.col("x.n")))
    r = r.select(F.col("v").alias("d"), F.col("sac").alias("ds"), sign(F.col("x.n"), F.col("x.p")))
    # the long hash alone sorts fast; a pair of two keys that share one is lost when its values come back to their rows
    met = l.repartition(tasks, "signe").hint("merge").join(r.repartition(tasks, "signe"), "signe")
    edits, more = _edits_of_pair(tolerance), lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(b)))
    near = (more("gs", "ds") <= edits) & (more("ds", "gs") <= edits) & (F.call_function("levenshtein", F.col("g"), F.col("d"), edits) >= 0)
    rest = right.withColumn("reste", F.array_except("longueurs", F.coalesce(F.array_intersect("c.dits", "foules"), F.array().cast("array<int>"))))
    rest = left.withColumn("reste", F.lit(None).cast("array<int>")).select(*values.columns, "reste").unionByName(rest.select(*values.columns, "reste"))
    # written, or else the filters that follow would be pushed down here, before the cheaper ones
    return materialise(met.where(near).select(*keys, "g", "d").distinct()), rest


def candidates(left: DataFrame, right: DataFrame, keys: list[str], col: str, tolerance: float) -> DataFrame:
    """(keys, g, d): pairs of distinct values that the signs, the lengths and the common grams let through."""
    # few bytes of values make many pairs: by size alone they would be one task's
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    values = materialise(_distinct(left, keys, col, "g").unionByName(_distinct(right, keys, col, "d")))
    signed = materialise(_signed(values, keys, tolerance))
    pieces = _by_pieces(values, keys, tolerance, tasks)
    short = materialise(_lengths(values, keys, tolerance) if pieces is None else _lengths(pieces[1], keys, tolerance, "reste"))
    edits = _edits_of_pair(tolerance)
    close = F.greatest(F.length("g"), F.length("d")) - F.least(F.length("g"), F.length("d")) <= edits

    def met(by: DataFrame, *more: str) -> DataFrame:
        one = lambda side: by.where(F.col("cote") == side).select(*keys, "signe", F.col("v").alias(side), *[F.col(c).alias(f"{side}g") for c in more])
        return one("g").repartition(tasks, *keys, "signe").join(one("d").repartition(tasks, *keys, "signe"), [*keys, "signe"]).where(close)

    by_gram = met(signed, "grammes").where(F.size(F.array_except("gg", "dg")) <= Q * edits).select(*keys, "g", "d").distinct()
    by_length = by_gram.unionByName(met(short).select(*keys, "g", "d"))
    return by_length if pieces is None else by_length.unionByName(pieces[0])


def similar_join(left: DataFrame, right: DataFrame, keys: list[str], col: str, tolerance: float = 0.25) -> DataFrame:
    """(gauche, droite, score): rows of both sides with equal ``keys`` whose values ``col`` have similarity 1 - tolerance or more.

    Two empty values are equal (1.0), one is like nothing; rows with a null key or value meet nothing.  ``tolerance`` is below 1.
    """
    filled = lambda df: df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.length(col) > 0))
    many = lambda df: filled(df).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW).select(*keys)
    large = materialise(many(left).unionByName(many(right)).distinct())
    edits, longer = _edits_of_pair(tolerance), F.greatest(F.length("g"), F.length("d"))
    rows = lambda df, name, side: df.select(*keys, F.col(col).alias(name), F.struct(*df.columns).alias(side))

    def scored(pairs: DataFrame) -> DataFrame:
        alike = (longer - F.least(F.length("g"), F.length("d")) <= edits) & (F.levenshtein("g", "d") <= edits)
        return pairs.where(alike).withColumn("score", 1 - F.levenshtein("g", "d") / longer).where(F.col("score") >= 1 - tolerance)

    small = lambda df, name, side: rows(filled(df).join(large, keys, "left_anti"), name, side)
    found = [scored(small(left, "g", "gauche").join(small(right, "d", "droite"), keys)).select("gauche", "droite", "score")]
    empty = lambda df, side: df.where(F.length(col) == 0).select(*keys, F.struct(*df.columns).alias(side))
    found.append(empty(left, "gauche").join(empty(right, "droite"), keys).select("gauche", "droite", F.lit(1.0).alias("score")))
    if not large.isEmpty():
        l, r = (filled(df).join(large, keys, "left_semi") for df in (left, right))  # noqa: E741
        pairs = scored(candidates(l, r, keys, col, tolerance))
        found.append(pairs.join(rows(l, "g", "gauche"), [*keys, "g"]).join(rows(r, "d", "droite"), [*keys, "d"]).select("gauche", "droite", "score"))
    return reduce(DataFrame.unionByName, found)
