"""Document fingerprints: consistent weighted sampling over weighted words.

A document's terms are its words, in lower case, weighted by how often they occur.
For each of ``K`` samples a term has hashed r and c, both gamma(2, 1), and a hashed
offset b; a weight w gives it t = floor(ln w / r + b) and the value

    ln a = ln c - r * (t - b + 1),

and the least value of all terms is the sample.  Two documents get the same sample
with a probability equal to their generalised Jaccard similarity, the sum of least
weights over the sum of greatest.  As ln a is a function of (term, t), the least
value itself tells the sampled pair: a sample is a ``min`` of doubles, which Spark sums
up before any shuffle, and a fingerprint is 32 bits of each.

Most terms can't be the least one, and a bound without logarithms says so: with
p = e^-r and q = e^-c, both products of hashed uniforms, a >= (1 - q) * p / w.  The
least value is exponential with the total weight as its rate, so terms whose bound is
over ``REACH`` / total weight are passed over; the least one is beyond that with a chance
of e^-24, 4e-11, a sample (it is then the least of the others, or the sample is void).

``neighbours`` puts every text beside the next one in falling order of ids: rows are
dealt by blocks of ``BLOCK`` ids, the first row of a block travels to the block before
as well, and the rest is a window in a block.  Which block comes next is worked out on a
row a block and a row a ``SPAN`` blocks; no window runs over the whole table.  All
that follows (terms, samples, likeness to the next document) stays in that one
shuffle of the texts.

Edge cases: null or empty text has no words; no word at all gives the fingerprint ''
(like another such text 1.0, like any other 0.0); rows with one id follow each other by
the hash of their text; a null id has no place in the order and no next text, and nothing
follows the last but the first (a single document follows itself); repeated rows get a
fingerprint each; texts are used whole, of any length; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from privlake.llm.common import WS_CLASS, split_words, stored, table

K, REACH = 40, 24.0
BLOCK, SPAN = 32, 8192
_FLAG = 21  # bits of a count; three of them in a long


# --- neighbours in falling order of ids ---


def _borders(ids: DataFrame) -> DataFrame:
    """(block, donor): the id that follows the last one of each block."""
    tops = ids.where("doc_id IS NOT NULL").groupBy(F.floor(F.col("doc_id") / BLOCK).alias("block")).agg(F.max("doc_id").alias("top"))
    tops = tops.withColumn("span", F.floor(F.col("block") / SPAN))
    spans = tops.groupBy("span").agg(F.max("top").alias("top"))
    w = Window.orderBy(F.desc("span"))  # a row for BLOCK * SPAN ids
    after = spans.select("span", F.coalesce(F.lead("top").over(w), F.first("top").over(w)).alias("after"))
    own = F.lead("top").over(Window.partitionBy("span").orderBy(F.desc("block")))
    return tops.select("block", "span", own.alias("own")).join(after, "span").select("block", F.coalesce("own", "after").alias("donor"))


def neighbours(docs: DataFrame) -> DataFrame:
    """(block, salt, place, donor, doc_id, text, next): each document (doc_id, text) with the text of the next one.

    Rows with ``donor`` are copies that only stand at the end of a block; place numbers the rows of a block.
    """
    borders = stored(_borders(docs.select("doc_id")))
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).withColumn("h", F.xxhash64("text"))
    # rows without an id have no order: they are spread by their texts
    own = d.select(
        F.floor(F.col("doc_id") / BLOCK).alias("block"), F.when(F.col("doc_id").isNull(), F.pmod("h", F.lit(4096))).otherwise(0).cast("int").alias("salt"),
        F.lit(False).alias("donor"), "doc_id", "text", "h",
    )
    lent = d.join(borders.select("block", F.col("donor").alias("doc_id")), "doc_id").select("block", F.lit(0).alias("salt"), F.lit(True).alias("donor"), "doc_id", "text", "h")
    w = order()
    following = F.when(F.col("doc_id").isNotNull(), F.lead("text").over(w))
    return own.unionByName(lent).select("block", "salt", F.row_number().over(w).alias("place"), "donor", "doc_id", "text", F.coalesce(following, F.lit("")).alias("next"))


def order():
    return Window.partitionBy("block", "salt").orderBy("donor", F.desc("doc_id"), "h")


# --- terms ---


def _counted(kept: Column, gone: Column, came: Column) -> Column:
    """Array of (h, n): each distinct word's hash, and its counts in three arrays of words, packed into a long.

    A hash carries the number of its array in its last two bits, so that sorting brings a word's occurrences together.
    """
    mark = lambda words, k: F.transform(words, lambda x: F.xxhash64(x).bitwiseAND(F.lit(-4)) + F.lit(k))
    of = lambda e: F.shiftright(e, 2)
    unit = F.array(*[F.lit(1 << (_FLAG * k)).cast("long") for k in range(3)])
    one = lambda e: F.get(unit, e.bitwiseAND(F.lit(3)).cast("int"))

    def runs(e: Column, starts: Column) -> Column:
        def run(i: Column, j: Column) -> Column:
            n = F.coalesce(F.get(starts, j + 1), F.size(e)) - i
            first = F.get(e, i)
            total = F.when(n == 1, one(first)).otherwise(F.aggregate(F.slice(e, i + 1, n), F.lit(0).cast("long"), lambda a, x: a + one(x)))
            return F.struct(of(first).alias("h"), total.alias("n"))

        return F.transform(starts, run)

    def with_starts(e: Column) -> Column:
        new = lambda i: (i == 0) | (of(F.get(e, i)) != of(F.get(e, i - 1)))
        places = F.when(F.size(e) > 0, F.sequence(F.lit(0), F.size(e) - 1)).otherwise(F.array().cast("array<int>"))
        return bound(F.filter(places, new), lambda starts: runs(e, starts))

    return bound(F.sort_array(F.concat(mark(kept, 0), mark(gone, 1), mark(came, 2))), with_starts)


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: a lambda's argument is, an expression isn't."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _terms(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, h, w, w_a, w_b, in_a, in_b): the weight w of each word of the pair of texts ``a``, ``b``, a row where both have
    the same weight and else one for each; w_a, w_b are the texts' total weights.  Pairs without words have one row with a null h.

    The texts start alike, up to ``same`` characters: that part's words are split and hashed once.
    """
    head = F.substring(F.col("a"), F.lit(1), F.col("same"))
    # a word that the cut splits belongs to what follows
    whole = F.length(F.regexp_extract(head, r"(?s)^.*[\x20\x09-\x0D]", 0))
    d = pairs.select(*keys, "a", "b", whole.alias("whole"))
    words = lambda c: split_words(F.lower(c), WS_CLASS)
    rest = lambda c: F.substring(F.col(c), F.col("whole") + 1, F.length(c))
    d = d.select(*keys, words(F.substring(F.col("a"), F.lit(1), F.col("whole"))).alias("kept"), words(rest("a")).alias("gone"), words(rest("b")).alias("came"))
    d = d.select(*keys, (F.size("kept") + F.size("gone")).alias("w_a"), (F.size("kept") + F.size("came")).alias("w_b"), F.explode_outer(_counted(F.col("kept"), F.col("gone"), F.col("came"))).alias("x"))
    part = lambda k: F.shiftrightunsigned(F.col("x.n"), _FLAG * k).bitwiseAND(F.lit((1 << _FLAG) - 1))
    d = d.select(*keys, F.col("x.h").alias("h"), "w_a", "w_b", (part(0) + part(1)).alias("n_a"), (part(0) + part(2)).alias("n_b"))
    both = F.array(F.struct(F.col("n_a").alias("w"), F.lit(True).alias("in_a"), F.lit(True).alias("in_b")))
    each = F.array(F.struct(F.col("n_a").alias("w"), F.lit(True).alias("in_a"), F.lit(False).alias("in_b")), F.struct(F.col("n_b").alias("w"), F.lit(False).alias("in_a"), F.lit(True).alias("in_b")))
    d = d.select(*keys, "h", "w_a", "w_b", F.explode(F.when(F.col("n_a").eqNullSafe(F.col("n_b")), both).otherwise(each)).alias("x"))
    return d.where("h IS NULL OR x.w > 0").select(*keys, "h", "w_a", "w_b", "x.*")


# --- samples ---


def _bits(x: Column, at: int, n: int) -> Column:
    """Those bits of a hash as a uniform in (0, 1), times 2^n."""
    return F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << n) - 1)) + F.lit(0.5)


def samples(terms: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """(keys, a0, b0, a1, b1, ...): ln of the least value of each text of the pair for each sample; null without words."""
    reach = lambda own, total: F.when(F.col(own), REACH * F.col("w") / F.col(total))
    d = terms.withColumns({"lw": F.log("w"), "limit": F.greatest(reach("in_a", "w_a"), reach("in_b", "w_b"))})
    carried = [*keys, "lw", "limit", "in_a", "in_b"]
    # a step for each layer: what a later layer uses twice is a column, and so computed once
    d = d.select(*carried, *[F.xxhash64("h", F.lit(i)).alias(f"x{i}") for i in range(k)])
    x = [F.col(f"x{i}") for i in range(k)]
    p, q, b = ([of(v).alias(f"{n}{i}") for i, v in enumerate(x)] for n, of in (
        ("p", lambda v: _bits(v, 0, 10) * _bits(v, 10, 10) * F.lit(2.0**-20)), ("q", lambda v: _bits(v, 32, 16) * _bits(v, 48, 16) * F.lit(2.0**-32)),
        ("b", lambda v: _bits(v, 20, 12) * F.lit(2.0**-12)),
    ))
    d = d.select(*carried, *p, *q, *b)
    r = lambda i: F.when((1.0 - F.col(f"q{i}")) * F.col(f"p{i}") <= F.col("limit"), -F.log(f"p{i}"))
    d = d.select(*carried, *[r(i).alias(f"r{i}") for i in range(k)], *[F.col(f"{n}{i}") for n in "qb" for i in range(k)])

    def ln_a(i: int) -> Column:
        r, b = F.col(f"r{i}"), F.col(f"b{i}")
        return -(r * (F.floor(F.col("lw") / r + b) - b + F.lit(1.0))) + F.log(-F.log(f"q{i}"))

    d = d.select(*keys, "in_a", "in_b", *[ln_a(i).alias(f"v{i}") for i in range(k)])
    least = lambda i, own: F.min(F.when(F.col(own), F.col(f"v{i}")))
    return d.groupBy(*keys).agg(*[least(i, f"in_{t}").alias(f"{t}{i}") for i in range(k) for t in "ab"])


def _codes(text: str, k: int) -> Column:
    """32 bits of each sample; null without words."""
    code = lambda i: F.xxhash64(F.col(f"{text}{i}")).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(F.coalesce(*[F.col(f"{text}{i}") for i in range(k)]).isNotNull(), F.array(*[code(i) for i in range(k)]))


def as_text(codes: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two arrays of codes; of two texts without words 1, of one 0."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)
    return F.when(a.isNull() | b.isNull(), (a.isNull() & b.isNull()).cast("double")).otherwise(same)


def fingerprints(pairs: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """``keys`` with the codes ``a_codes`` and ``b_codes`` of each pair of texts (a, b, same: characters in which they start alike)."""
    return samples(_terms(pairs, keys), keys, k).select(*keys, _codes("a", k).alias("a_codes"), _codes("b", k).alias("b_codes"))


def fingerprint(docs: DataFrame, k: int = K, id_col: str = "doc_id") -> DataFrame:
    """(id_col, fingerprint) of each document; rows with one id and one text are one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(id_col, F.sha2(text, 256).alias("sha256"), text.alias("a"), text.alias("b"), F.length(text).alias("same"))
    return fingerprints(d, [id_col, "sha256"], k).select(id_col, as_text(F.col("a_codes")).alias("fingerprint"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Each document beside its edited text: the last third of its characters is replaced by the start of the next document."""
    d = neighbours(docs).withColumn("n_chars", F.length("text").cast("long"))
    k = F.floor(F.col("n_chars") / 3).cast("int")
    same = (F.col("n_chars").cast("int") - k).alias("same")
    b = F.concat(F.substring(F.col("text"), F.lit(1), same), F.substring(F.col("next"), F.lit(1), k)).alias("b")
    return d.select("block", "salt", "place", "donor", "doc_id", "n_chars", F.col("text").alias("a"), b, same).withColumn("edited_sha256", F.sha2("b", 256))


def op12_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["block", "salt", "place", "donor", "doc_id", "n_chars", "edited_sha256"]
    d = fingerprints(edited_pairs(table(spark, sf_dir, "documents").select("doc_id", "text")), keys)
    following = F.lead("a_codes").over(Window.partitionBy("block", "salt").orderBy("place"))
    d = d.withColumn("n_codes", F.when(F.col("doc_id").isNotNull(), following)).where("NOT donor")
    return d.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("a_codes")).alias("fingerprint"), as_text(F.col("b_codes")).alias("edited_fingerprint"),
        likeness(F.col("a_codes"), F.col("b_codes")).alias("near_edited"), likeness(F.col("a_codes"), F.col("n_codes")).alias("near_next"),
    )
