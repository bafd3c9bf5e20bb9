"""Cases of the review that an earlier version missed."""

import hashlib
import math
import random
import re
import time

import pytest

from privlake.llm import pii, secret_scan, toxicity


def test_secret_beside_a_base_span(spark):
    key, hexes = "Zx9Kq2Lm8Vt4Rb7Wc1Yp6", "deadbeefdeadbeefdeadbeef0123"
    texts = [f"{hexes}_{key}", f"{key}/{hexes}", f"{key}+{hexes}={key}", f"{hexes}_some-long-joined-words-2024", f"{hexes}_short1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.s, s.k, s.e) for s in r.spans] for r in secret_scan.scan(df).select("row.doc_id", "spans").collect()}
    assert [k for _, k, _ in got[0]] == [2, 3] and got[0][1][2] == len(texts[0]) and got[0][1][0] in (28, 29)
    assert [k for _, k, _ in got[1]] == [3, 2] and got[1][0][0] == 0
    assert [k for _, k, _ in got[2]] == [3, 2, 3]
    assert [k for _, k, _ in got[3]] == [2] and [k for _, k, _ in got[4]] == [2]
    clean = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert not any(key in clean[i] for i in range(3))


def test_numbers_beside_a_base_span():
    model = pii.trained()
    for text, kind, value in (
        ("call +33 1 23 45 67 89 / 01 98 76 54 32 today", 3, "01 98 76 54 32"), ("+33 1 23 45 67 89 / 415-555-0100", 3, "415-555-0100"),
        ("tel (415) 555-0100 192.168.10.20 ok", 3, "(415) 555-0100"),
    ):
        base = pii.base_spans(text)
        added = pii.added_spans(text, base, model)
        assert len(base) == 1 and [(k, text[s:e]) for k, s, e in added] == [(kind, value)]
    for text in ("call +33 1 23 45 67 89 today", "mail a.b@c.com", "host 192.168.10.20"):
        assert len(pii.base_spans(text)) == 1 and pii.added_spans(text, pii.base_spans(text), model) == []


def test_exceptions_of_the_trained_model(spark):
    """Built-in phrases reach the model that the query uses, and phrases of harmless rows are learnt."""
    text = lambda i: f"you scum number{i} go away" if i % 5 == 0 else f"the sea scum drifts by w{i}" if i % 20 == 1 else f"plain words w{i} of no weight"
    rows = [(i, text(i), int(i % 5 == 0)) for i in range(1200)]
    extra = [(i, f"you scum again{i}", 1) for i in range(1200, 9000)]
    d = spark.createDataFrame(rows + extra, "doc_id long, text string, toxic int")
    model = toxicity.train(d.select("doc_id", "text"), d.select("doc_id", "toxic"))
    assert any(e.startswith(" scum") for e in model.weights) and set(toxicity.EXCEPTIONS) <= set(model.exceptions)
    assert {"sea scum", "scum drifts"} <= set(model.exceptions) and "you scum" not in model.exceptions
    for phrase in ("pond scum", "sea scum"):
        assert model.features(toxicity.fold(phrase)) == (0.0, 0.0, 0.0)
    assert model.features(toxicity.fold("you scum"))[0] > 0


def test_folding_at_the_end_of_a_word():
    assert toxicity.fold("dumba55 a$$! shi7, moron5!! sh!7") == " dumbass ass shit morons shit "
    assert toxicity.fold("3000 x2 b12 $5 wow! in 1999") == " 3000 x2 b12 5 wow in 1999 "
    for text in ("a" + "!" * 200_000 + "z", "a" + "5" * 200_000 + "_", "a!" * 100_000, "a" + "!5" * 100_000):
        toxicity.fold(text)  # linear


@pytest.mark.parametrize("text", ["a" * 1_000_000, "aB3" * 333_000, "1" * 1_000_000, "(" * 1_000_000, "@" * 1_000_000, "a@" * 300_000, "a.b" * 330_000 + "@" + "c." * 300_000, "1." * 400_000])
def test_scan_is_linear_on_long_runs(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    assert pii.scan(df, pii.trained()).count() == 1
    assert time.time() - began < 30


def naive_triggers(text):
    """Every run and every at-sign, tried from each start."""
    found = [m.span() for m in re.finditer(r"[0-9(][0-9() ./-]{5,}[0-9]", text)]
    at = r"[A-Za-z0-9._%+-]+ ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]+)+"
    found += [m.span() for m in re.finditer(at, text)]
    return found


def test_triggers_cover_what_patterns_match():
    r = random.Random(21)
    for _ in range(4000):
        text = "".join(r.choice(["1", "23", "(", ")", " ", ".", "-", "/", "a", "@", " at ", "(at)", "[dot]", "x.y", ","]) for _ in range(r.randint(1, 25)))
        got = pii._triggers(text)
        assert got == sorted(got) and all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))
        for s, e in naive_triggers(text):
            assert any(a <= s and e <= b for a, b in got), (text, (s, e), got)


#: Written by hand, apart from the generator's forms: text, and the values that base patterns miss.
FOREIGN = [
    ("Please ring (212) 555-0187 after six.", ["(212) 555-0187"]), ("My number is 617-555-0123, ask for Ann.", ["617-555-0123"]),
    ("Tél. 01 42 68 53 00 du lundi au vendredi", ["01 42 68 53 00"]), ("Telefon 030 1234567 oder per Post", ["030 1234567"]),
    ("fax: 415.555.0199", ["415.555.0199"]), ("call 0171 2345678 now", ["0171 2345678"]), ("phone (030) 555-1234 or mail", ["(030) 555-1234"]),
    ("write to jane.doe at example dot org please", ["jane.doe at example dot org"]), ("contact: bob [at] example [dot] com", ["bob [at] example [dot] com"]),
    ("mail me: info @ example.net today", ["info @ example.net"]), ("email sales(at)example.com for a quote", ["sales(at)example.com"]),
    ("pay with card 4111.1111.1111.1111 by friday", ["4111.1111.1111.1111"]), ("visa 4539.5787.6362.1486 exp 04", ["4539.5787.6362.1486"]),
    ("tel 06 12 34 56 78 (mobile)", ["06 12 34 56 78"]), ("his cell: 310-555-0142.", ["310-555-0142"]),
    ("We met at the station on 12/05/2019 at 10.", []), ("See pages 112-118 and figure 3.2.", []), ("Version 10.4.12 was built on 2023-11-05 09:14:00.", []),
    ("ISBN 978-3-16-148410-0 costs 24.90", []), ("The order 48151623 ships from 1998-2004 stock", []), ("invoice 2291-000341 total 1 204 500", []),
    ("look at this. Then go", []), ("commit 9f86d081884c7d659a2f in branch", []),
]


def test_recall_on_foreign_sentences():
    model = pii.trained()
    want = got = right = 0
    for text, values in FOREIGN:
        base = pii.base_spans(text)
        found = [text[s:e] for _, s, e in pii.added_spans(text, base, model)]
        want, got, right = want + len(values), got + len(found), right + len(set(found) & set(values))
    assert right / want >= 0.9 and right / got >= 0.9, (want, got, right)


def naive_entropy(text):
    """Base spans by patterns, then every window of every candidate, its entropy counted anew."""
    base = [(m.start(), 0, m.end()) for m in re.finditer("(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[1]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    base.sort()
    known = lambda x, patterns: bool(re.search("[0-9]", x) and re.search("[A-Za-z]", x)) and not any(re.search(p, x) for p in patterns)
    extra = []
    for m in re.finditer(secret_scan.CANDIDATE, text):
        if not known(m[0], [p for p in secret_scan.ALLOW if p.startswith("^")]):
            continue
        parts, at, cut = [], m.start(), False
        for s, _, e in base:
            if s < m.end() and m.start() < e:
                parts.append((at, s))
                at, cut = max(at, e), True
        for s, e in [*parts, (at, m.end())]:
            if e - s < secret_scan.W:
                continue
            x = text[s:e]
            if not known(re.sub("^[-_/=+]+|[-_/=+]+$", "", x) if cut else x, secret_scan.ALLOW):
                continue
            bar = secret_scan.THRESHOLDS["hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", x) else "alnum" if re.fullmatch("[A-Za-z0-9]+", x) else "base64"]
            hot = []
            for i in range(len(x) - secret_scan.W + 1):
                n = [x[i : i + secret_scan.W].count(c) / secret_scan.W for c in set(x[i : i + secret_scan.W])]
                if -sum(p * math.log2(p) for p in n) >= bar - 1e-12:
                    hot.append(i)
            if hot:
                extra.append((s + hot[0], 3, s + hot[-1] + secret_scan.W))
    return base, sorted(base + extra)


def test_secret_query_equals_brute_force(spark):
    """Every column of the query, on the whole small table and on made-up texts."""
    r = random.Random(31)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
    parts = lambda: r.choice(["token=", "api_key: ", "AKIA", " ", "\n", "deadbeef00", "EXAMPLE", "word-", "é", "123e4567-e89b-12d3-a456-426614174000", "".join(r.choice(letters) for _ in range(r.randint(1, 45))), "".join(r.choice("0123456789abcdef") for _ in range(r.randint(5, 50)))])
    rows = [(i, "".join(parts() for _ in range(r.randint(0, 9)))) for i in range(600)]
    rows += [(1000 + r_.doc_id, r_.text) for r_ in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in secret_scan.digest(df).collect()}
    for i, text in rows:
        base, spans = naive_entropy(text or "")
        line = lambda s: ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in s)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == c for _, k, _ in base) for c in range(3))
        assert got[i].base_sha256 == hashlib.sha256(line(base).encode()).hexdigest() and got[i].spans == line(spans), text


def test_secret_scan_is_linear(spark):
    """Candidates and matches of a megabyte."""
    r = random.Random(41)
    one = "".join(r.choice("ABCDEFGHIJKLMNOPqrstuvwxyz0123456789") for _ in range(1_000_000))
    df = spark.createDataFrame([(1, one), (2, "deadbeefdeadbeefdeadbeef " * 20_000)], "doc_id long, text string").repartition(2)
    began = time.time()
    assert {x.doc_id: x.n_hex for x in secret_scan.digest(df).collect()} == {1: 0, 2: 20_000}
    assert time.time() - began < 60


def naive_features(model, folded):
    """Every entry and phrase looked for by itself, at every place."""

    def places(x):
        at = folded.find(x)
        while at >= 0:
            yield at
            at = folded.find(x, at + 1)

    best = {}
    for entry, w in model.weights.items():
        for s in places(entry):
            best[s] = max(w, best.get(s, 0.0))
    spared = [(s, s + len(toxicity.fold(x)) - 1) for x in model.exceptions for s in places(toxicity.fold(x))]
    hits = [w for s, w in best.items() if not any(a <= s < b for a, b in spared)]
    words = max(folded.count(" ") - 1, 20)
    return math.log1p(sum(hits)), math.log1p(100 * sum(hits) / words), max(hits, default=0.0)


def test_automaton_equals_naive_search():
    r = random.Random(51)
    for _ in range(400):
        word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 4)))
        weights = {f" {word()}" + r.choice(("", " ")): round(r.uniform(0.1, 5), 2) for _ in range(r.randint(1, 12))}
        model = toxicity.Model(weights, tuple({f"{word()} {word()}" for _ in range(r.randint(0, 4))}))
        folded = toxicity.fold(" ".join(word() for _ in range(r.randint(0, 40))))
        assert model.features(folded) == pytest.approx(naive_features(model, folded))
