"""Scalar text functions: canonical forms, hashes, tokens, masks, similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from privlake.schema import DEFAULT_PREFIX, TOKEN_PREFIX, literal_map

_LETTER = "[0-9A-Za-zÀ-ÖØ-öø-ÿ]"
BULLET = "•"


def _plain(v: str | None) -> str | None:
    """NFKD without combining marks, lower case, single spaces: Spark has no Unicode decomposition."""
    import unicodedata

    return None if v is None else " ".join("".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)).lower().split())


@F.pandas_udf(T.StringType())
def _unmarked(values: pd.Series) -> pd.Series:
    return values.map(_plain)


@F.pandas_udf(T.ArrayType(T.StringType()))
def canonical_all(values: pd.Series) -> pd.Series:
    """``canonical`` of every value of an array, within its row."""
    return values.map(lambda a: None if a is None else [_plain(v) for v in a])


@F.pandas_udf(T.StringType())
def _compared(values: pd.Series) -> pd.Series:
    import unicodedata

    def one(v: str | None) -> str | None:
        if v is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKD", v).casefold() if c.isalnum())

    return values.map(one)


@F.pandas_udf(T.StringType())
def _unaccented(values: pd.Series) -> pd.Series:
    import re
    import unicodedata

    def one(v: str | None) -> str | None:
        return None if v is None else re.sub(r"\s+", " ", re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", v)).lower().strip())

    return values.map(one)


def stored_canonical(value: Column) -> Column:
    """The form that the pseudonym table's hashes use: as ``canonical``, but only marks U+0300 to U+036F are dropped."""
    return _unaccented(value)


def canonical(value: Column, ascii_only: bool = False) -> Column:
    """Form of a value before hashing; ``ascii_only`` promises ASCII input and stays in the JVM."""
    return F.trim(F.regexp_replace(F.lower(value), r"[\x09-\x0D\x1C-\x20]+", " ")) if ascii_only else _unmarked(value)


def comparison_key(value: Column, ascii_only: bool = False) -> Column:
    """Letters and digits only, without case and marks."""
    return F.regexp_replace(F.lower(value), "[^0-9a-z]", "") if ascii_only else _compared(value)


def value_hash(canonical_value: Column, salt: str) -> Column:
    return F.sha2(F.concat(canonical_value, F.lit(salt)), 256)


def token(value_hash_: Column, type_entite: Column) -> Column:
    """Stable token such as PERS-4F2A."""
    prefix = F.coalesce(F.try_element_at(literal_map(TOKEN_PREFIX), F.upper(type_entite)), F.lit(DEFAULT_PREFIX))
    return F.concat(prefix, F.lit("-"), F.upper(F.substring(value_hash_, 1, 4)))


def mask_value(value: Column, type_entite: Column) -> Column:
    """First character of each word kept, one-character words hidden; of an e-mail address the first character only."""
    words = F.regexp_replace(value, f"(?<={_LETTER}){_LETTER}|(?<!{_LETTER}){_LETTER}(?!{_LETTER})", BULLET)
    mail = F.concat(F.substring(value, 1, 1), F.lit(BULLET * 6 + "@" + BULLET * 4))
    return F.when((F.upper(type_entite) == "EMAIL") & value.contains("@"), mail).otherwise(words)


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty values, 0 for one."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longer)


def error_rate(reference: Column, read: Column) -> Column:
    """Character error rate on texts with white space collapsed."""
    a, b = (F.trim(F.regexp_replace(x, r"(?U)\s+", " ")) for x in (reference, read))
    return F.when(F.length(a) == 0, F.when(F.length(b) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(a, b) / F.length(a))


def trigrams(key: Column) -> Column:
    """Distinct trigrams; a shorter key is its own."""
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - 2, F.lit(1))), lambda i: F.substr(key, i, F.lit(3)))
    return F.when(F.length(key) < 3, F.array(key)).otherwise(F.array_distinct(cut))


def coverage(value: Column, text: Column) -> Column:
    """Share of the value's trigrams that the text has."""
    own = trigrams(value)
    return F.size(F.array_intersect(own, trigrams(text))) / F.size(own)


def confidence_error(confidence: Column) -> Column:
    """Error rate estimated from a reading's confidence (0 to 100); null if that isn't positive."""
    return F.when(confidence > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - confidence / 100)), 4))


def suffix(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


#: Encodings tried on bytes that aren't UTF-8, in order of preference.
ENCODINGS = ("cp1252", "iso8859_15", "cp850")
#: What a French export holds beside ASCII; each other character beyond ASCII speaks against an encoding.
_LIKELY = frozenset("àâäçéèêëîïôöùûüÿœæÀÂÄÇÉÈÊËÎÏÔÖÙÛÜŸŒÆ’‘“”«»–—…°€\xa0")


def guessed_text(data: bytes) -> str:
    """Text of bytes that aren't UTF-8: UTF-16 by its mark or its zero bytes, else the encoding whose characters are the
    likeliest (of equals the first); Latin-1 where none can read them."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", errors="replace")
    if len(data) > 3 and len(data) % 2 == 0 and max(data[::2].count(0), data[1::2].count(0)) > 0.35 * len(data) / 2:
        return data.decode("utf-16-le" if data[1::2].count(0) >= data[::2].count(0) else "utf-16-be", errors="replace")
    best, text = None, data.decode("latin-1")
    for encoding in ENCODINGS:
        try:
            one = data.decode(encoding)
        except UnicodeDecodeError:
            continue
        strange = sum(c not in _LIKELY and not c.isascii() for c in one)
        if best is None or strange < best:
            best, text = strange, one
    return text


@F.pandas_udf(T.StringType())
def _guessed(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else guessed_text(bytes(v)))


def decode_bytes(content: Column) -> Column:
    """Bytes as text: UTF-8 where valid, in the JVM; only other bytes go to the guess in Python."""
    plain = F.try_validate_utf8(content.cast("string"))
    return F.coalesce(plain, _guessed(F.when(plain.isNull(), content)))


def cipher_key(text: str) -> bytes:
    """A key of 16, 24 or 32 bytes from hexadecimal, base64 or plain text, in this order."""
    import base64
    import binascii

    text = text.strip()
    for read in (binascii.unhexlify, base64.b64decode, lambda x: x.encode()):
        try:
            key = read(text)
        except (binascii.Error, ValueError):
            continue
        if len(key) in (16, 24, 32):
            return key
    raise ValueError("a key has 16, 24 or 32 bytes in hexadecimal, base64 or plain text")


def base64_bytes(text: Column) -> Column:
    """Bytes of strict base64; null for any other text."""
    strict = text.rlike("^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    return F.when(strict, F.unbase64(text))


def encrypt(value: Column, key: Column) -> Column:
    """AES-GCM; 12 bytes of nonce lead."""
    return F.aes_encrypt(value, key, F.lit("GCM"))


def decrypt(data: Column, key: Column) -> Column:
    return F.try_aes_decrypt(data, key, F.lit("GCM")).cast("string")
