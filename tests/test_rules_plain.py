"""The rules, arbitration and levels against a plain form in Python's ``re``, over whole documents."""

import datetime as dt
import re

import pytest

from privlake.functions import validators as v
from privlake.functions.normalize import repaired, worth_repair
from privlake.operators import detect, sweep
from privlake.plans import corpus, queries
from privlake.plans.registry import TODAY
from privlake.schema import LEVEL_OF_TYPE, LEVELS

SF = "/root/testdata/sf0.001"
LAST = dt.date.fromisoformat(TODAY)


def compiled(pattern):
    m = re.match(r"\(\?([iU]+)\)", pattern)
    modes = m[1] if m else ""
    return re.compile(pattern[m.end() :] if m else pattern, (re.I if "i" in modes else 0) | (0 if "U" in modes else re.A))


def found(text, pattern, group=0, strip=detect.SPACES):
    for m in compiled(pattern).finditer(text):
        value = m[group]
        a = m.start(group) + len(value) - len(value.lstrip(strip))
        yield a, a + len(value.strip(strip)), value.strip(strip)


def luhn(c):
    digits = [int(x) for x in c[::-1]]
    return sum(digits[::2]) + sum(sum(divmod(2 * x, 10)) for x in digits[1::2])


def card(x):
    c = re.sub(r"[\s.-]", "", x)
    return bool(re.fullmatch("[0-9]{13,19}", c)) and len(set(c)) > 1 and luhn(c) % 10 == 0


def iban(x):
    c = re.sub(r"[\s-]", "", x).upper()
    if not re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", c) or v.IBAN_LENGTH.get(c[:2], len(c)) != len(c):
        return False
    return int("".join(str(int(y, 36)) for y in c[4:] + c[:4])) % 97 == 1


def phone(x):
    c = re.sub("^00", "+", re.sub(r"[\s.\-()/]", "", x))
    if not re.fullmatch(r"\+[0-9]+", c):
        return bool(re.fullmatch("[0-9]{8,10}", c))
    for code in sorted(v.NATIONAL_LENGTH, key=len, reverse=True):
        if c[1:].startswith(code):
            return len(c) - 1 - len(code) in v.NATIONAL_LENGTH[code]
    return 8 <= len(c) - 1 <= 15


def birth(x):
    t = x.strip().lower()
    if m := re.match(v.DATE_FORMS[0], t):
        d, mo, y = map(int, m.groups())
        y = y if y >= 100 else y + (1900 if y > 30 else 2000)
    elif m := re.match(v.DATE_FORMS[1], t):
        d, mo, y = int(m[1]), v.MONTHS.get(m[2], 0), int(m[3])
    else:
        return False
    try:
        return v.FIRST_YEAR <= y and dt.date(y, mo, d) <= LAST
    except ValueError:
        return False


CHECK = {"iban": iban, "card": card, "phone": phone, "date": birth, "date in words": birth}


def entities(text, tolerant=False):
    return [*by_rules(text, tolerant), *addresses(text)]


def by_rules(text, tolerant=False):
    out = []
    for name, (kind, pattern, group, *_) in (detect.TOLERANT if tolerant else detect.STRICT).items():
        for a, b, value in found(text, pattern, group):
            ok = name in CHECK and CHECK[name](value)
            doubtful = {"phone": 0.55} | ({"iban": 0.90, "card": 0.90} if tolerant else {})
            score = {"email": 0.97, "plate": 0.70, "client": 0.90}.get(name, 0.99 if ok else doubtful.get(name))
            if score is not None:
                out.append((kind, a, b, value, score, "regle", ok))
    for a, b, value in found(text, detect.IDENTITY):
        c = re.sub(r"[\s.\-]", "", value)
        if len(c) >= 8:
            ok = any(len(c) == n and re.match(start, c) for n, start in v.IDENTITY.values())
            named = any(w in text.lower()[max(0, a - detect.IDENTITY_REACH) : a] for w in detect.IDENTITY_WORDS)
            if ok or named:
                out.append(("NUM_PIECE_IDENTITE", a, b, value, 0.995 if ok and named else 0.95 if ok else 0.75, "regle", ok))
    return out


def addresses(text):
    out, seen = [], set()
    for pattern, score in ((detect.ADDRESS, 0.65), (detect.POSTCODE, 0.60)):
        for m in compiled(pattern).finditer(text):
            value = m[0].strip(" ,;.")
            span = (m.start(), m.start() + len(value))
            if len(value) >= 8 and (score == 0.65 or span not in seen):
                out.append(("ADRESSE_POSTALE", *span, value, score, "ner", False))
                seen.add(span)
    return out


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_candidates_of_all_documents(spark, texts):
    got = {}
    for r in queries.QUERIES["rule_entities"](spark, SF).collect():
        got.setdefault(r.doc_id, []).append((r.type_entite, r.debut, r.fin, r.valeur, r.score, r.methode, r.valide))
    for doc, text in texts.items():
        assert sorted(got.get(doc, [])) == sorted(entities(text or "")), doc
    assert len(got) > 5


def test_entities_of_all_documents(spark, texts):
    got, top = {}, {}
    for r in queries.QUERIES["analysed_entities"](spark, SF).collect():
        got.setdefault(r.doc_id, []).append((r.type_entite, r.debut, r.fin, r.valeur, r.score, r.methode, r.valide, r.niveau))
        top[r.doc_id] = r.niveau_max
    for doc, text in texts.items():
        want = [(*e, LEVEL_OF_TYPE[e[0]]) for e in sweep.arbitrated(entities(text or ""))]
        assert sorted(got.get(doc, [])) == sorted(want), doc
        assert not want or top[doc] == max((e[-1] for e in want), key=LEVELS.index)


def test_candidates_of_the_corpus(spark):
    """Documents that hold every kind: plates, dossiers, accounts, cards, dates in words."""
    made = corpus.documents(spark.range(400)).select("id", "texte")
    kinds = set()
    for r in detect.detect(made, today=queries._today()).collect():
        want = entities(r.texte)
        assert sorted(tuple(e) for e in r.candidats) == sorted(want), r.texte
        kinds |= {e[0] for e in want}
    assert kinds == {*corpus.BY_RULE, "ADRESSE_POSTALE"}


def test_candidates_of_texts_from_ocr(spark, texts):
    """Tolerant rules, and again on the repaired text where the repair changes it, led back."""
    torn = lambda t: re.sub(r"(?<=\w)([@.\-/])(?=\w)", lambda m: m[1] + " " if m.start() % 3 else " " + m[1], t)
    made = [(r.id, torn(r.texte)) for r in corpus.documents(spark.range(200)).collect()] + [(1000 + k, t) for k, t in texts.items() if t]
    d = spark.createDataFrame(made, "id long, texte string")
    more = 0
    for r in detect.detect_ocr(d, today=queries._today()).collect():
        want = by_rules(r.texte, tolerant=True)
        if worth_repair(r.texte):
            fixed, at = repaired(r.texte)
            again = by_rules(fixed, tolerant=True)
            more += len(again)
            want += [(k, at[a], at[b], r.texte[at[a] : at[b]], *rest) for k, a, b, _, *rest in again]
        assert sorted(tuple(e) for e in r.candidats) == sorted(want), r.texte
    assert more > 200
