"""Secret scans: base patterns, and sliding-window entropy over candidate strings.

A candidate is a run of at least ``W`` characters of the token alphabet with both
letters and digits.  A window of ``W`` characters slides over it; its Shannon
entropy is kept by incremental counts (one character leaves, one enters; the
counts of the alphabet are packed into a few longs) and compared with the threshold of the candidate's character class.  The span from
the first hot window to the last is reported as kind ``entropy``, unless the
allow-list knows the candidate.  Where base spans touch a candidate, its parts
beside them are candidates of their own, so no window overlaps a base span.
Everything is a Spark expression: one scan, no shuffle, no user function.

Edge cases: null and empty text have no spans; texts of any length are scanned
whole; repeated rows and null ids are scanned one by one; an empty table gives
an empty result.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from privlake.functions.spans import folded
from privlake.llm.common import table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

W = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Least entropy of a window, in bits a character, by character class.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.7}
#: Candidates that aren't secrets: UUIDs, plain digits, words with a number or joined by dashes or slashes, published example keys.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9_=/+-]+$",
    r"^([A-Za-z]+|[0-9]+)([-_/=+]+([A-Za-z]+|[0-9]+))*$",
    r"^[A-Za-z]+[0-9]{1,4}$",
    r"EXAMPLE",
)


SPANS = "array<struct<s:int,k:int,e:int>>"
#: The token alphabet; a window's counts take BITS bits a character, PACKED characters a long.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
BITS, PACKED = 5, 12


def _spans(text: Column, pattern: str, matches: str, kind: int, keep) -> Column:
    """Structs (s, k, e) of the matches in column ``matches``; ``keep`` filters by index.

    The start of match i is the length of the pieces and matches before it.
    """
    both = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.col(matches).alias("m"), keep.alias("ok"))

    def step(at: Column, x: Column) -> tuple[Column, Column, Column]:
        s = at + F.length(x["g"])
        e = s + F.coalesce(F.length(x["m"]), F.lit(0))
        return e, F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e")), F.coalesce(x["ok"], F.lit(False))

    return F.when(F.size(matches) > 0, folded(both, F.lit(0), step, SPANS)).otherwise(F.array().cast(SPANS))


def _hot(s: Column) -> Column:
    """(first, last) start of the windows of candidate ``s`` at or above its class's threshold; -1 without one.

    The state holds the number of each character in the window and sum(n log n) over them; a step moves both by
    the character that leaves and the one that enters, so the cost is linear in the candidate's length.
    """
    bar = (
        F.when(s.rlike(r"^([0-9a-f]+|[0-9A-F]+)$"), THRESHOLDS["hex"])
        .when(s.rlike(r"^[A-Za-z0-9]+$"), THRESHOLDS["alnum"]).otherwise(THRESHOLDS["base64"])
    )
    places = F.map_from_arrays(F.array(*map(F.lit, ALPHABET)), F.array(*[F.lit(i) for i in range(len(ALPHABET))]))
    codes = F.transform(F.array_remove(F.split(s, ""), ""), lambda c: F.element_at(places, c))
    g = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(0.0)
    held = [f"c{j}" for j in range(-(-len(ALPHABET) // PACKED))]

    def run(x: Column) -> Column:
        """``x``: the candidate's codes and its bar, computed once."""
        zero = F.lit(0).cast("long")
        state = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), *[zero.alias(c) for c in held])

        def moved(a: Column, code: Column, by: int) -> Column:
            """The state with one more (or less) of a character; null leaves it as it is."""
            word, shift = F.floor(code / PACKED).cast("int"), (code % PACKED) * BITS
            mine = F.element_at(F.array(*[a[c] for c in held]), word + 1)
            n = F.call_function("shiftright", mine, shift).bitwiseAND(F.lit((1 << BITS) - 1))
            unit = F.call_function("shiftleft", F.lit(by).cast("long"), shift)
            total = a["sum"] + g(n + by) - g(n)
            fields = [F.when(word == j, a[c] + unit).otherwise(a[c]).alias(c) for j, c in enumerate(held)]
            return F.when(code.isNull(), a).otherwise(F.struct(a["i"].alias("i"), total.alias("sum"), a["first"].alias("first"), a["last"].alias("last"), *fields))

        def step(a: Column, code: Column) -> Column:
            gone = F.when(a["i"] >= W, F.get(x["codes"], a["i"] - W))
            left = F.transform(F.array(a), lambda b: moved(b, gone, -1))
            both = F.transform(left, lambda b: moved(b, code, 1))

            def judged(b: Column) -> Column:
                at = b["i"] - (W - 1)
                hot = (at >= 0) & (F.log2(F.lit(float(W))) - b["sum"] / W >= x["bar"])
                return F.struct(
                    (b["i"] + 1).alias("i"), b["sum"].alias("sum"), F.when(hot & (b["first"] < 0), at).otherwise(b["first"]).alias("first"),
                    F.when(hot, at).otherwise(b["last"]).alias("last"), *[b[c].alias(c) for c in held],
                )

            return F.element_at(F.transform(both, judged), 1)

        return F.aggregate(x["codes"], state, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))

    return F.element_at(F.transform(F.array(F.struct(codes.alias("codes"), bar.alias("bar"))), run), 1)


def _candidate(s: Column, patterns) -> Column:
    """Whether ``s`` has letters and digits and none of the allow-list's ``patterns``."""
    return s.rlike("[0-9]") & s.rlike("[A-Za-z]") & ~F.array_contains(F.array(*[s.rlike(p) for p in patterns]), True)


def _parts(x: Column, base: Column) -> Column:
    """Structs (s, e, cut) of what the spans in ``base`` (in order of their starts) leave of candidate ``x``."""
    kind = "array<struct<s:int,e:int,cut:boolean>>"
    part = lambda s, e, cut: F.array(F.struct(s.alias("s"), e.alias("e"), F.lit(cut).alias("cut")))
    touching = F.filter(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    state = F.struct(x["s"].alias("at"), F.array().cast(kind).alias("out"))

    def step(a: Column, b: Column) -> Column:
        more = F.when(b["s"] - a["at"] >= W, F.concat(a["out"], part(a["at"], b["s"], True))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], b["e"]).alias("at"), more.alias("out"))

    def last(a: Column) -> Column:
        return F.when(x["e"] - a["at"] >= W, F.concat(a["out"], part(a["at"], x["e"], True))).otherwise(a["out"])

    return F.when(F.size(touching) > 0, F.aggregate(touching, state, step, last)).otherwise(part(x["s"], x["e"], False).cast(kind))


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` with the input's columns, ``base`` and ``spans``: arrays of (s, k, e), k an index of KINDS."""
    t = F.col("t")
    d = df.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.select(
        "row", "t", F.regexp_extract_all("t", F.lit(ASSIGN), 0).alias("m0"),
        F.when(t.contains("AKIA"), F.regexp_extract_all("t", F.lit(ACCESS), 0)).otherwise(F.array().cast("array<string>")).alias("m1"),
        F.regexp_extract_all("t", F.lit(HEX), 0).alias("m2"), F.regexp_extract_all("t", F.lit(CANDIDATE), 0).alias("m3"),
    )
    # what an anchored pattern knows whole it knows in parts
    mixed = F.transform("m3", lambda x: _candidate(x, [p for p in ALLOW if p.startswith("^")]))
    values = F.transform(F.regexp_extract_all("t", F.lit(ASSIGN), 2), lambda x: F.length(x) >= 6)
    every = lambda m: F.transform(m, lambda x: F.lit(True))
    d = d.select(
        "row", "t", "m3", F.when(F.size("m3") > 0, mixed).alias("ok3"),
        F.concat(
            _spans(t, ASSIGN, "m0", 0, F.when(F.size("m0") > 0, values)),
            _spans(t, ACCESS, "m1", 1, every("m1")), _spans(t, HEX, "m2", 2, every("m2")),
        ).alias("base"),
    )
    d = d.select("row", "t", F.sort_array("base").alias("base"), F.when(F.exists("ok3", lambda x: x), _spans(t, CANDIDATE, "m3", 3, F.col("ok3"))).alias("c"))
    parts = F.flatten(F.transform("c", lambda x: _parts(x, F.col("base"))))
    d = d.select("row", "t", "base", F.when(F.size("c") > 0, parts).alias("c"))
    value = lambda x: F.col("t").substr(x["s"] + 1, x["e"] - x["s"])
    # the joint to a base span isn't part of a word list
    free = F.filter("c", lambda x: _candidate(F.when(x["cut"], F.regexp_replace(value(x), "^[-_/=+]+|[-_/=+]+$", "")).otherwise(value(x)), ALLOW))
    d = d.select("row", "t", "base", F.when(F.col("c").isNotNull(), free).alias("c"))
    hot = F.transform("c", lambda x: F.struct(x["s"].alias("s"), _hot(value(x)).alias("w")))
    d = d.select("row", "t", "base", F.when(F.size("c") > 0, hot).alias("c"))
    extra = F.transform(
        F.filter("c", lambda x: x["w"]["first"] >= 0),
        lambda x: F.struct((x["s"] + x["w"]["first"]).alias("s"), F.lit(3).alias("k"), (x["s"] + x["w"]["last"] + W).alias("e")),
    )
    none = F.array().cast(SPANS)
    return d.select("row", "t", "base", F.sort_array(F.concat("base", F.coalesce(extra, none))).alias("spans"))


def joined(spans: str) -> Column:
    kind = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``df``, the union of all spans in ``text_col`` replaced by ``mark``."""
    d = scan(df, text_col)
    t = F.col("t")
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        fresh = x["s"] >= a["at"]  # else it overlaps the one before, which has its mark
        head = F.when(fresh, F.concat(t.substr(a["at"] + 1, x["s"] - a["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.concat(a["out"], head).alias("out"))

    clean = F.aggregate("spans", state, step, lambda a: F.concat(a["out"], t.substr(a["at"] + 1, F.length(t))))
    text = F.when(F.size("spans") > 0, clean).otherwise(F.col("row").getField(text_col))
    return d.select(*[(text if c == text_col else F.col("row").getField(c)).alias(c) for c in df.columns])


def redact_documents(docs: DataFrame) -> DataFrame:
    """``redact`` for documents that carry their length in ``n_chars``: it follows the text where that changed."""
    d = redact(docs.withColumn("text_before", F.length("text")))
    n = F.when(F.length("text") == F.col("text_before"), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return d.withColumn("n_chars", n).select(*docs.columns) if "n_chars" in docs.columns else d.select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the numbers of base spans by kind, their digest, and all spans as text, of every row (doc_id, text)."""
    d = scan(docs)
    number = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return d.select("row.doc_id", number(0), number(1), number(2), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents").select("doc_id", "text"))
