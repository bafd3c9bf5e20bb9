"""Functions and rules: fixtures, parity with Python's ``re``, invariants."""

import datetime
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from privlake.functions import normalize as nz, spans as sp, text as tx, validators as v
from privlake.operators import detect
from privlake.schema import level_of, policy_matrix, rank


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x string").orderBy("i").select(f(F.col("x"))).collect()]


@pytest.mark.parametrize(("check", "good", "bad"), [
    (v.iban_valid, ["SN91SN0100152000048500000765", "SN91 SN01 0015 2000 0485 0000 0765", "FR7630006000011234567890189", "BE68539007547034"], ["SN92SN0100152000048500000765", "FR7630006000011234567890188", "XX08", "", "mot"]),
    (v.card_valid, ["4539578763621486", "4539 5787 6362 1486", "378282246310005"], ["4539578763621487", "0000000000000000", "1234567890", "45395787636214861234", "abc"]),
    (v.phone_valid, ["+221771234567", "+22997123456", "+2290197123456", "00221771234567", "77 123 45 67"], ["+22177123", "+2217712345678901", "+22997", "12345", "abc"]),
    (lambda x: v.birth_date_valid(x, F.lit("2026-01-01").cast("date")), ["03/07/1988", "3-7-1988", "12 mars 1990", "1er janvier 1975", "1988-07-03"], ["32/01/1990", "29/02/1991", "03/07/1850", "03/07/2099", "13 blurp 1990", ""]),
    (v.identity_valid, ["1988070312345", "0123456789", "C0123456789"], ["198807031234", "012345678", "123", ""]),
])
def test_checks(spark, check, good, bad):
    assert column(spark, good, check) == [True] * len(good)
    assert column(spark, bad, check) == [False] * len(bad)


def test_two_digit_years(spark):
    assert column(spark, ["3/7/88", "3/7/05"], v.parsed_date) == [datetime.date(1988, 7, 3), datetime.date(2005, 7, 3)]


PATTERNS = [detect.EMAIL, detect.PHONE, detect.IBAN, detect.CARD, detect.DATE_NUMBER, detect.DATE_WORDS, detect.IDENTITY, detect.PLATE, detect.ADDRESS, detect.POSTCODE]


def test_spans_equal_re(spark):
    texts = [
        "", "a@b.sn, c.d@e.fr", "Tél +221 77 555 44 33 ou 77 123 45 67.", "IBAN SN91SN0100152000048500000765 fin", "né le 03/07/1988, 12 mars 1990 à Thiès",
        "4539 5787 6362 1486 4539578763621486", "DK-4521-AB et AB-123-CD", "12 rue de la Paix, 75001 Paris", "été@x.fr œuf €", "x" * 5000 + " a@b.fr", "CNI 1988070312345 " * 20,
    ]
    assert [len(x) for x in column(spark, ["a@b.fr " * 700, ""], lambda c: sp.spans(c, detect.EMAIL, needs="@"))] == [700, 0]  # several blocks
    for p in PATTERNS:
        flags, plain = (re.IGNORECASE if "(?iU)" in p else 0), re.sub(r"^\(\?i?U\)", "", p)
        got = column(spark, texts, lambda c, p=p: sp.spans(c, p))
        want = [[(m.start(), m.end(), m[0]) for m in re.finditer(plain, t, flags)] for t in texts]
        assert [[tuple(s) for s in g] for g in got] == want, p


def test_simpler_patterns_are_held_by_every_match():
    """What ``needs`` asks of a text, every value that a rule's pattern matches has."""
    values = {
        "email": ["a@b.sn", "x @y.c"], "iban": ["SN91SN0100152000048500000765", "SN91 SN01 0015 2000 0485"], "card": ["4539578763621486", "4 5 3 9 5 7 8 7 6 3 6 2 1", "453-9578.7636 21486"],
        "phone": ["+221 77 555 44 33", "77 123 45 67", "+2 2 1 7 7"], "date": ["03/07/1988", "3 / 7 / 88", "1-1-99"], "date in words": ["1er mars 1990"], "plate": ["DK-4521-AB", "1234AB12"], "client": ["N° client AB12", "Dossier n° 1234"],
    }
    for table in (detect.STRICT, detect.TOLERANT):
        for name, (_, pattern, _, needs, _, _) in table.items():
            plain = re.compile(re.sub(r"^\(\?i?U\)", "", pattern), re.IGNORECASE if "(?iU)" in pattern else 0)
            simple = re.compile(needs.replace(r"\p{Nd}", r"\d"))
            for v in values[name]:
                assert not plain.search(v) or simple.search(v), (name, v)


def test_group_span(spark):
    got = column(spark, ["n° client : GZ-889201 et id client AB12"], lambda c: sp.spans(c, detect.CLIENT, 1))
    assert [tuple(s) for s in got[0]] == [(12, 21, "GZ-889201"), (35, 39, "AB12")]


def test_ligature_with_a_mark():
    assert nz.normalised("\ufb01" + chr(0x301) + "n")[0] == "fi" + chr(0x301) + "n"


SAMPLES = ["", "deux  mots", "a\tb", "l1\nl2", "l1\r\nl2", "p1\n\n\np2", "ﬁn œuvre", "“q” – l’été", "e" + chr(0x301) + "té", "﻿x"]


@pytest.mark.parametrize("text", SAMPLES)
def test_offsets(text):
    out, offsets = nz.normalised(text)
    assert len(offsets) == len(out) + 1 and offsets == sorted(offsets) and offsets[-1] == len(text)


def test_normalised_values():
    assert [nz.normalised(t)[0] for t in SAMPLES] == ["", "deux mots", "a b", "l1\nl2", "l1\nl2", "p1\n\np2", "fin oeuvre", '"q" - l\'été', "été", "x"]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_offsets_hold_for_any_text(text):
    for f in (nz.normalised, nz.repaired):
        out, offsets = f(text)
        assert len(offsets) == len(out) + 1 and offsets[-1] == len(text) and all(0 <= o <= len(text) for o in offsets)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=[*"ab \n\r\té", "e", *map(chr, (0x301, 0x327, 0x153, 0xFB01, 0x2019, 0x212B, 0xA0))], max_size=25))
def test_normalised_by_clusters(text):
    import unicodedata

    out, i = [], 0
    while i < len(text):
        j = i + 1
        if text[i].isspace():
            while j < len(text) and text[j].isspace():
                j += 1
            n = len(re.findall("\r\n|\n|\r", text[i:j]))
            out.append([" ", "\n", "\n\n"][min(n, 2)])
        else:
            while j < len(text) and unicodedata.combining(text[j]):
                j += 1
            out.append("".join(nz.LIGATURES.get(c, c) for c in unicodedata.normalize("NFC", text[i:j])))
        i = j
    assert nz.normalised(text)[0] == "".join(out)


@pytest.mark.parametrize(("text", "want"), [
    ("binetandiaye @mail .bj", "binetandiaye@mail.bj"), ("03 / 07 / 1988", "03/07/1988"), ("DK - 4521 - AB", "DK-4521-AB"), ("x @mall bJ", "x@mall.bJ"),
    ("awa@exemple domicile", "awa@exemple domicile"), ("fin . ( suite )", "fin . ( suite )"), ("", ""),
])
def test_repair(text, want):
    assert nz.repaired(text)[0] == want
    assert not (text == want and nz.worth_repair(text))


def test_segments():
    assert nz.segments("court") == [(0, 5)]
    text = "mot " * 3000
    cut = nz.segments(text)
    assert cut[0][0] == 0 and cut[-1][1] == len(text) and all(b[0] < a[1] for a, b in zip(cut, cut[1:], strict=False))


def test_masks_and_tokens(spark):
    assert column(spark, ["jean.dupont@mail.com"], lambda c: tx.mask_value(c, F.lit("EMAIL"))) == ["j••••••@••••"]
    assert column(spark, ["Jean Dupont", "03/07/1988", "Y."], lambda c: tx.mask_value(c, F.lit("X"))) == ["J••• D•••••", "0•/0•/1•••", "•."]
    names = ["Jean DUPONT", "jean  dupont", "Jéan Dupont"]
    tokens = column(spark, names, lambda c: tx.token(tx.value_hash(tx.canonical(c), "s"), F.lit("NOM_PERSONNE")))
    assert len(set(tokens)) == 1 and re.fullmatch("PERS-[0-9A-F]{4}", tokens[0])
    assert column(spark, names[:1], lambda c: tx.token(tx.value_hash(tx.canonical(c), "t"), F.lit("AUTRE")))[0].startswith("DCP-")


def test_similarity_and_error_rate(spark):
    pairs = spark.createDataFrame([("", "", 1.0, 0.0), ("", "x", 0.0, 1.0), ("abcd", "abcx", 0.75, 0.25), ("a  b", "a b", 0.75, 0.0)], "a string, b string, s double, e double")
    for r in pairs.select("s", "e", tx.similarity(F.col("a"), F.col("b")).alias("x"), tx.error_rate(F.col("a"), F.col("b")).alias("y")).collect():
        assert (r.x, r.y) == (r.s, r.e)


def test_encryption_layout(spark):
    key = F.lit("0123456789abcdef")
    r = spark.createDataFrame([("é secret",)], "x string").select(F.length(tx.encrypt(F.col("x"), key)).alias("n"), tx.decrypt(tx.encrypt(F.col("x"), key), key).alias("y")).first()
    assert (r.n, r.y) == (12 + 9 + 16, "é secret")


def test_levels(spark):
    assert column(spark, ["EMAIL", "iban", "?"], level_of) == ["moyen", "critique", "moyen"]
    assert column(spark, ["faible", "critique", "?", None], rank) == [0, 3, -1, -1]
    assert policy_matrix(spark).count() == 24


def test_page_and_offsets(spark):
    d = spark.createDataFrame([(5, [(1, 0, 10), (2, 12, 20)]), (11, [(1, 0, 10), (2, 12, 20)]), (15, [(1, 0, 10), (2, 12, 20)]), (3, [])], "p int, pages array<struct<numero:int,debut:int,fin:int>>")
    assert [r[0] for r in d.select(sp.page_of(F.col("p"), F.col("pages"))).collect()] == [1, 1, 2, None]
    o = spark.createDataFrame([([0, 2, 3, 7],)], "o array<int>")
    assert o.select(sp.to_source(F.lit(-4), F.col("o")), sp.to_source(F.lit(2), F.col("o")), sp.to_source(F.lit(9), F.col("o")), sp.from_source(F.lit(3), F.col("o"))).first() == (0, 3, 7, 2)
