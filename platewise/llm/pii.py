"""Format-preserving pseudonyms for personal data.

Values are found by pattern, validated (check digits, calendar, ranges) and
replaced by a value of the same format under a keyed permutation: a Feistel
network over exactly the values of that format.  Equal values get equal
pseudonyms in every document and different values different ones, without a
table.  What fails its validation is left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ROUNDS = 10
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


# ---------------------------------------------------------------- Feistel ---

def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. size - 1.

    Numbers are split into two mixed-radix halves (a * b >= size) that are
    added to each other's keyed digest in turns; results outside the domain
    walk on until they fall inside.
    """
    a = 1 << ((max(size - 1, 1).bit_length() + 1) // 2)
    b = -(-size // a)

    def once(v: int) -> int:
        left, right = divmod(v, b)  # left < a, right < b
        for r in range(ROUNDS):
            source, modulus = (right, a) if r % 2 == 0 else (left, b)
            digest = hashlib.blake2b(f"{tweak}|{size}|{r}|{source}".encode(), key=key, digest_size=32)
            f = int.from_bytes(digest.digest(), "big") % modulus
            if r % 2 == 0:
                left = (left + f) % a
            else:
                right = (right + f) % b
        return left * b + right

    v = once(value)
    while v >= size:
        v = once(v)
    return v


#: Fixed value: a half of more bits would be longer than the digest that is added to it.
MOST_BITS = 512


def _permute_long(places: list[int], sizes: list[int], key: bytes, tweak: str) -> list[int]:
    """The same network for domains of any size: the halves are the first and
    the last places, to each of which a stream keyed by the other half is added."""
    v, size, cut = np.array(places, np.uint64), np.array(sizes, np.uint64), len(places) // 2
    halves = (slice(0, cut), slice(cut, None))
    label = hashlib.blake2b(tweak.encode(), key=key).digest()
    for r in range(ROUNDS):
        to, source = halves if r % 2 == 0 else halves[::-1]
        seed = hashlib.blake2b(label + bytes([r]) + v[source].astype(np.uint8).tobytes(), key=key).digest()
        stream = np.frombuffer(hashlib.shake_256(seed).digest(8 * len(v[to])), "<u8")
        v[to] = (v[to] + stream % size[to]) % size[to]
    return v.tolist()


def permute_text(text: str, key: bytes, tweak: str, alphabet: Callable[[str], str] | None = None) -> str:
    """Permute the letters and digits of ``text`` within their classes; other
    characters stay in their places."""
    def kind(c: str) -> str:
        return DIGITS if c in DIGITS else LOWER if c in LOWER else UPPER if c in UPPER else ""

    kinds = [(alphabet or kind)(c) for c in text]
    size, value = 1, 0
    shape = "".join(k[0] if k else c for c, k in zip(text, kinds))
    for c, k in zip(text, kinds):
        if k:
            size, value = size * len(k), value * len(k) + k.index(c)
        if (size - 1).bit_length() > MOST_BITS:
            new = iter(_permute_long([k.index(c) for c, k in zip(text, kinds) if k], [len(k) for k in kinds if k],
                                     key, f"{tweak}:{shape}"))
            return "".join(k[next(new)] if k else c for c, k in zip(text, kinds))
    value = permute(value, size, key, f"{tweak}:{shape}")
    out = []
    for c, k in zip(reversed(text), reversed(kinds)):
        if k:
            value, digit = divmod(value, len(k))
            c = k[digit]
        out.append(c)
    return "".join(reversed(out))


# ------------------------------------------------------------- validation ---

def luhn_ok(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c))
                for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _fill(pattern: str, digits: str) -> str:
    """``digits`` in the places of the digits of ``pattern``."""
    source = iter(digits)
    return "".join(next(source) if c in DIGITS else c for c in pattern)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def card(m: re.Match, key: bytes) -> str | None:
    """A payment card number with a valid check digit; keeps its grouping and
    gets a valid check digit again."""
    digits = _digits(m[0])
    if not 13 <= len(digits) <= 19 or not luhn_ok(digits) or not digits.strip("0"):
        return None
    body = permute_text(digits[:-1], key, "card")
    return _fill(m[0], body + next(c for c in DIGITS if luhn_ok(body + c)))


def iban(m: re.Match, key: bytes) -> str | None:
    """An IBAN with valid check digits: country kept, check digits computed."""
    plain = m[0].replace(" ", "").upper()

    def mod97(s: str) -> int:
        return int("".join(str(int(c, 36)) for c in s)) % 97

    if not 15 <= len(plain) <= 34 or mod97(plain[4:] + plain[:4]) != 1:
        return None
    body = permute_text(plain[4:], key, "iban:" + plain[:2])
    check = f"{98 - mod97(body + plain[:2] + '00'):02d}"
    source = iter(plain[:2] + check + body)
    return "".join(c if c == " " else next(source) for c in m[0])


def ssn(m: re.Match, key: bytes) -> str | None:
    """A US social security number: area not 000, 666 or 9xx, no zero group."""
    def ok(digits: str) -> bool:
        return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"

    digits = _digits(m[0])
    if not ok(digits):
        return None
    while True:  # walks within the valid numbers
        digits = permute_text(digits, key, "ssn")
        if ok(digits):
            return _fill(m[0], digits)


#: First digits of the country codes of one and two digits; all others have three.
_COUNTRY = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")


def phone(m: re.Match, key: bytes) -> str | None:
    """A phone number with 10 to 15 digits; the country code stays, and the 1
    before a national number.  Equal numbers get equal pseudonyms with and
    without separators."""
    head = re.match(r"\+\d{1,3}(?=[ .(-])", m[0])
    trunk = re.match(r"1(?=[ .(-])", m[0])
    if m[0][0] == "+" and not head:
        head = re.compile(r"\+" + f"(?:{_COUNTRY.pattern})").match(m[0])
    lead = head[0] if head else trunk[0] if trunk else ""
    rest = m[0][len(lead):]
    if not 10 <= len(_digits(m[0])) <= 15:
        return None
    return lead + _fill(rest, permute_text(_digits(rest), key, "phone:" + (lead if head else "")))


def ip_address(m: re.Match, key: bytes) -> str | None:
    """A dotted quad with octets from 0 to 255."""
    octets = m[0].split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in octets):
        return None
    v = permute(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, v.to_bytes(4, "big")))


def email(m: re.Match, key: bytes) -> str | None:
    """An address: the local part and the names before the top-level domain."""
    at = m[0].rindex(".")
    return permute_text(m[0][:at], key, "email" + m[0][at:].lower()) + m[0][at:]


# The days among which dates are permuted.
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)


def day(m: re.Match, key: bytes) -> str | None:
    """A calendar date in 1900-2099 (year first; or day, month, year; or, where
    that is no date, month, day, year); separators and order stay."""
    parts = [m[0][:4], m[0][5:7], m[0][8:]] if len(re.split("[-/.]", m[0])[0]) == 4 else re.split("[-/.]", m[0])
    orders = ["ymd"] if len(parts[0]) == 4 else ["dmy", "mdy"]
    for order in orders:
        got = dict(zip(order, map(int, parts)))
        try:
            found = date(got["y"], got["m"], got["d"])
        except ValueError:
            continue
        if not FIRST_DAY <= found <= LAST_DAY:
            return None
        days = (LAST_DAY - FIRST_DAY).days + 1
        moved = FIRST_DAY + timedelta(permute((found - FIRST_DAY).days, days, key, "date"))
        fields = {"y": f"{moved.year:04d}", "m": f"{moved.month:02d}", "d": f"{moved.day:02d}"}
        return "".join(x for pair in zip((fields[c] for c in order), (*re.findall("[-/.]", m[0]), "")) for x in pair)
    return None


def secret(m: re.Match, key: bytes) -> str | None:
    """A value with digits that is assigned to the name of a secret, up to
    white space or its closing quote; one of hexadecimal digits in one case
    stays so, others keep letters, digits and all else in their places."""
    quote = m["value"][0] if m["value"][0] in "\"'" else ""
    lead, value = m["lead"] + quote, m["value"][len(quote):]
    if not any(c in DIGITS for c in value):
        return None
    for alphabet in (DIGITS + "abcdef", DIGITS + "ABCDEF"):
        if all(c in alphabet for c in value):
            return lead + permute_text(value, key, "hex", lambda c: alphabet)
    return lead + permute_text(value, key, "secret")


def access_key(m: re.Match, key: bytes) -> str | None:
    """A 20-character access key id: its prefix stays."""
    return m[0][:4] + permute_text(m[0][4:], key, "access-key", lambda c: DIGITS + UPPER)


#: (kind, pattern, pseudonym or None if it isn't valid), in order of precedence.
KINDS: list[tuple[str, re.Pattern, Callable[[re.Match, bytes], str | None]]] = [
    # ahead of all that may be a part of it; it ends on a letter or digit, as what follows would stay anyway
    ("secret", re.compile(r"(?P<lead>\b(?i:token|secret|password|passwd|pwd|(?:api|access|secret|private)[_-]?key)"
                          r"[\"']?\s{0,3}[:=]\s{0,3})"
                          r"(?P<value>\"(?=[^\s\"]{8})[^\s\"]*[A-Za-z0-9]|'(?=[^\s']{8})[^\s']*[A-Za-z0-9]"
                          r"|(?=[^\s\"'](?:[^\s\"']|[\"'](?=[A-Za-z0-9])){7})"
                          r"[^\s\"']+(?:[\"'](?=[A-Za-z0-9])[^\s\"']*)*(?<=[A-Za-z0-9]))"), secret),
    ("email", re.compile(r"(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}(?![\w-])"), email),
    ("access_key", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"), access_key),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"), iban),
    ("ip_address", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"), ip_address),
    ("phone", re.compile(r"\+\d{1,3} ?\(\d{1,4}\) ?\d{3}[ .-]\d{4}(?!\d)"
                         r"|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?!\d)"
                         r"|\+\d{10,15}(?!\d)|\+\d(?:[ .-]?\(?\d\)?){9,14}(?!\d)"
                         r"|(?<![\d+])(?<!\d[.-])(?:1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)"
                         r"|(?<![\d+])(?<!\d[.-])(?<![.-])(?:1[ .-])?\d{3}(?P<p>[ .-])\d{3}(?:(?P=p)|[.-])\d{4}(?![\d-])"), phone),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), ssn),
    ("date", re.compile(r"(?<![\d./-])(?:\d{4}(?P<s>[-/.])\d{2}(?P=s)\d{2}|\d{2}(?P<t>[-/.])\d{2}(?P=t)\d{4})(?![\d/-]|\.\d)"), day),
    ("card", re.compile(r"(?<![\d.])\d(?:[ -]?\d){12,}"), card),
]
_POSSIBLE = re.compile(r"[0-9@]")
_ANY = re.compile(r"(?s:.*)")
#: Groups of digits that cards are written in, as a text of their lengths.
_CARD_GROUPS = re.compile(r"1[3-9]|(?:4 ){3}4(?: 3)?|4 6 [45]|4 3 3 3")


def card_spans(m: re.Match) -> list[tuple[int, int]]:
    """Runs of whole groups in a match that may be a card, the likeliest first:
    in groups as cards have them, the match from its start, other groups of
    three and more digits; of each the longest first."""
    groups = [g.span() for g in re.compile(r"\d+").finditer(m.string, *m.span())]
    found = []
    for i, (start, _) in enumerate(groups):
        sizes: list[int] = []
        for s, e in groups[i:i + 19]:
            sizes.append(e - s)
            if sum(sizes) > 19:
                break
            if sum(sizes) >= 13:
                known = _CARD_GROUPS.fullmatch(" ".join(map(str, sizes)))
                rank = 0 if known else 1 if i == 0 else 2 if min(sizes) > 2 else None
                if rank is not None:
                    found.append((rank, -sum(sizes), start, e))
    return [(s, e) for _, _, s, e in sorted(found)]


def iban_spans(m: re.Match) -> list[tuple[int, int]]:
    """The match and its beginnings of whole groups, the longest first."""
    ends = [m.end(), *(m.start() + i for i in range(len(m[0]) - 1, 14, -1) if m[0][i] == " ")]
    return [(m.start(), e) for e in ends]


def phone_spans(m: re.Match) -> list[tuple[int, int]]:
    """The match and its beginnings of whole groups, the longest first; a
    number of country 1 has 11 digits where that ends a group."""
    ends = [m.start() + g.end() for g in re.finditer(r"\d+", m[0])]
    spans = [m.span(), *((m.start(), e) for e in reversed(ends))]
    if m[0].startswith("+1"):
        spans.sort(key=lambda x: len(_digits(m.string[x[0]:x[1]])) != 11)
    return spans


#: Kinds whose pattern may join a value with its neighbours: where to look for it.
SPANS: dict[str, Callable[[re.Match], list[tuple[int, int]]]] = {"card": card_spans, "iban": iban_spans,
                                                               "phone": phone_spans}


def pseudonymise(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, length) of what was replaced
    in the original.  Kinds come in order; a place is replaced once."""
    if not _POSSIBLE.search(text):
        return text, []
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))
    for kind, rx, make in KINDS:
        at = 0
        while m := rx.search(text, at):
            at = m.end()
            for s, e in SPANS[kind](m) if kind in SPANS else [m.span()]:
                if taken.find(1, s, e) >= 0:
                    continue
                made = make(m if (s, e) == m.span() else _ANY.fullmatch(text, s, e), key)
                if made is not None:
                    found.append((s, e, kind, made))
                    taken[s:e] = b"\1" * (e - s)
                    if kind != "card":
                        at = e  # another one may follow in the match
                        break
            else:
                if kind in ("iban", "phone"):
                    at = m.start() + 1  # or begin in it
    found.sort()
    out, at = [], 0
    for s, e, _, made in found:
        out += [text[at:s], made]
        at = e
    return "".join([*out, text[at:]]), [(kind, s, e - s) for s, e, kind, _ in found]


def pseudonyms(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, found array of (kind, start, length)) for every row.

    A null text stays null and an empty one empty, with nothing found.  Rows
    that repeat give equal results.  The key is a parameter: the same key
    links values across runs.
    """
    schema = "doc_id long, text string, found array<struct<kind:string,start:int,length:int>>"
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [(None, []) if t is None else pseudonymise(t, key) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([t for t, _ in done], pa.string()),
                 pa.array([[dict(zip(("kind", "start", "length"), x)) for x in f] for _, f in done], found_type)],
                names=["doc_id", "text", "found"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, schema))


def pseudonymise_rows(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with its text column replaced; all other columns stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            texts = [t if t is None else pseudonymise(t, key)[0] for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
