"""Format-preserving pseudonyms for personal data.

Values that validate (card and bank numbers by their check digits, dates by the calendar, addresses
by their ranges) are mapped by a keyed Feistel permutation of all values of the same format, so a
pseudonym validates as well, equal values have equal pseudonyms in every document, and whoever
holds the key can reverse it.  Numbers that fail validation stay as they are.  Every document is
treated alone: no exchange, no table of pseudonyms.

Where a value ends: a bank number has its country's length; one whose country is not listed, or
that has another length, is the longest run of groups.  A phone number with a country code takes
groups of digits while its country's longest number allows; a group of one digit counts right
behind the code or after a dash or dot.  What is behind the end, or behind the first four
characters of a refused bank number, is looked at again.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.batches import bounded, in_row, out_of_row, row_schema

ROUNDS = 8
LOWER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
UPPER_DIGITS = DIGITS + LOWER.upper()
ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"
#: Characters of a bank number by country (ISO 13616).
IBAN_LENGTH = {c: int(n) for n, codes in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
    "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
    "28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC,SV 32:LC 33:RU").split()) for c in codes.split(",")}
#: Most digits behind the country code, without leading zeros; 15 with the code (E.164) for the others.
PHONE_DIGITS = {c: int(n) for n, codes in (x.split(":") for x in (
    "8:45,47,53,65,216,356,357,370,371,372,373,374,382,383,386,387,389,852,853,965,974 "
    "9:27,31,32,33,34,40,41,46,48,51,56,61,66,93,94,212,213,254,351,353,354,355,359,375,376,377,380,381,385,420,421,423,886,966,971,972 "
    "10:1,7,20,30,36,44,52,57,58,60,63,64,82,84,90,91,92,95,98,234,378 11:39,49,54,55,81,86,352 12:62,358 13:43").split())
    for c in codes.split(",")}
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


class Feistel:
    """A keyed permutation of the numbers below any bound, and its inverse.

    Numbers are split at about the square root of the bound; each round adds a keyed hash of one
    half to the other.  Results beyond the bound, or refused by ``allowed``, are permuted again.
    """

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = key, back

    def _hash(self, what: str, turn: int, bound: int, value: int) -> int:
        data = f"{what}|{turn}|{bound}|{value}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big")

    def _once(self, what: str, value: int, wide: int, narrow: int, bound: int) -> int:
        high, low = divmod(value, narrow)
        sign = -1 if self.back else 1
        for turn in reversed(range(ROUNDS)) if self.back else range(ROUNDS):
            if turn % 2:
                low = (low + sign * self._hash(what, turn, bound, high)) % narrow
            else:
                high = (high + sign * self._hash(what, turn, bound, low)) % wide
        return high * narrow + low

    def permute(self, what: str, value: int, bound: int, allowed: Callable[[int], bool] = lambda _: True) -> int:
        narrow = 1
        while narrow * narrow < bound:  # a power of two at or above the square root
            narrow *= 2
        wide = -(-bound // narrow)
        while True:
            value = self._once(what, value, wide, narrow, bound)
            if value < bound and allowed(value):
                return value


def luhn(digits: str) -> bool:
    ds = [int(c) for c in reversed(digits)]
    return (sum(ds[::2]) + sum(sum(divmod(2 * d, 10)) for d in ds[1::2])) % 10 == 0


@lru_cache(4096)
def _kind(c: str) -> str | None:
    """The letters or digits that a character is permuted among: those of its block, in lower case if it has one."""
    low = c.lower()
    for kind in (LOWER, DIGITS, ACCENTED):
        if low in kind and c in (low, low.upper()):
            return kind
    if not c.isalnum():
        return None
    if len(low) == 1 and c in (low, low.upper()):
        kind = _cased(_block(low))
        if low in kind:
            return kind
    return _uncased(ord(c) >> 12, unicodedata.category(c))


def _block(c: str) -> int:
    return 0 if ord(c) < 0x250 else ord(c) >> 8


@lru_cache(None)
def _cased(block: int) -> str:
    """Small letters of a block that have a capital letter and come back from it."""
    found = map(chr, range(0x80, 0x250) if block == 0 else range(block << 8, block + 1 << 8))
    return "".join(c for c in found if c not in ACCENTED and len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c)


@lru_cache(None)
def _uncased(part: int, category: str) -> str:
    """The other letters and digits of a category in a part of Unicode."""
    found = map(chr, range(max(part << 12, 0x80), part + 1 << 12))
    return "".join(c for c in found if unicodedata.category(c) == category and c.isalnum() and c.lower() not in ACCENTED
                   and not (len(c.lower()) == 1 and c in (c.lower(), c.lower().upper()) and c.lower() in _cased(_block(c.lower()))))


def _letters(f: Feistel, what: str, text: str) -> str:
    """All letters and digits of a text, each within its kind and case."""
    kinds = [_kind(c) for c in text]
    value, bound = 0, 1
    for c, kind in zip(text, kinds):
        if kind:
            value, bound = value * len(kind) + kind.index(c if c in kind else c.lower()), bound * len(kind)
    if bound == 1:
        return text
    known = (LOWER, DIGITS, ACCENTED)
    pattern = "".join("-" if k is None else str(len(k)) if k in known else f"{k[0]}{len(k)}" for k in kinds)
    value = f.permute(f"{what}|{pattern}", value, bound)
    out = []
    for c, kind in zip(reversed(text), reversed(kinds)):
        if kind:
            value, at = divmod(value, len(kind))
            new = kind[at]
            out.append(new if c in kind else new.upper())
        else:
            out.append(c)
    return "".join(reversed(out))


def _over(f: Feistel, what: str, text: str, alphabet: str) -> str:
    value = 0
    for c in text:
        value = value * len(alphabet) + alphabet.index(c)
    value = f.permute(f"{what}|{len(text)}", value, len(alphabet) ** len(text))
    out = []
    for _ in text:
        value, at = divmod(value, len(alphabet))
        out.append(alphabet[at])
    return "".join(reversed(out))


def _put(text: str, digits: str) -> str:
    """The digits in the places of the text's digits."""
    new = iter(digits)
    return "".join(next(new) if c in DIGITS else c for c in text)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def _email(f: Feistel, text: str) -> str:
    local, _, domain = text.rpartition("@")
    return f"{_letters(f, 'email', local)}@{domain}"


def _card(f: Feistel, text: str) -> str | None:
    """The issuer's digit stays; the check digit follows."""
    ds = _digits(text)
    if not luhn(ds) or not 13 <= len(ds) <= 19 or len(set(ds)) == 1:
        return None
    # runs of one digit are no cards, so no card may become one
    body = f.permute(f"card|{len(ds)}|{ds[0]}", int(ds[1:-1]), 10 ** (len(ds) - 2),
                     lambda v: len(set(_checked(ds[0], v, len(ds)))) > 1)
    return _put(text, _checked(ds[0], body, len(ds)))


def _checked(lead: str, body: int, length: int) -> str:
    start = lead + str(body).zfill(length - 2)
    return next(start + c for c in DIGITS if luhn(start + c))


def _number97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


def _is_iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and _number97(plain[4:] + plain[:4]) % 97 == 1 and _digits(plain[4:]) != ""


def _iban_end(text: str) -> int:
    """Where the bank number that a run of groups starts with ends: after its country's length, if it holds there."""
    left, end = IBAN_LENGTH.get(text[:2], 0), 0
    while left and end < len(text):
        left -= text[end] != " "
        end += 1
    return end if end and not left and text[end:end + 1] in ("", " ") and _is_iban(text[:end]) else len(text)


def _iban(f: Feistel, text: str) -> str | None:
    if not _is_iban(text):
        return None
    while True:
        plain = text.replace(" ", "")
        body = _put(plain[4:], _over(f, f"iban|{plain[:2]}", _digits(plain[4:]), DIGITS))
        check = 98 - _number97(body + plain[:2] + "00") % 97
        new = iter(plain[:2] + str(check).zfill(2) + body)
        text = "".join(c if c == " " else next(new) for c in text)
        if _iban_end(text) == len(text):  # else its beginning would be taken for the number
            return text


def _social(f: Feistel, text: str) -> str | None:
    def good(v: int) -> bool:
        s = str(v).zfill(9)
        return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"

    value = int(_digits(text))
    return _put(text, str(f.permute("social", value, 10**9, good)).zfill(9)) if good(value) else None


def _address(f: Feistel, text: str) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255 or any(p != str(int(p)) for p in text.split(".")):
        return None
    value = f.permute("address", int.from_bytes(bytes(parts), "big"), 1 << 32)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _phone_code(text: str) -> str:
    return re.match(r"\+\d{1,3}(?=\D)|\+1|\+\d\d|", text).group()


def _phone_end(text: str) -> int:
    """Where the number ends: behind the last group that its country's longest number has room for."""
    code = _phone_code(text)
    most = PHONE_DIGITS.get(code[1:], 16 - len(code))
    whole = len(text)
    if not code:
        return whole
    for group in re.finditer(r"[0-9]+", text[len(code):]):
        digits = _digits(text[len(code):len(code) + group.end()])
        if 7 <= len(digits) <= 14 and (whole == len(text) or len(digits.lstrip("0")) <= most):
            whole = len(code) + group.end()
    return whole


def _phone(f: Feistel, text: str) -> str | None:
    """The country code and leading zeros (also one in brackets) stay."""
    code = _phone_code(text)
    digits = _digits(text[len(code):])
    own = digits.lstrip("0")
    if not 7 <= len(digits) <= 14 or not own:
        return None
    least = 10 ** (len(own) - 1)
    new = f.permute(f"phone|{code}|{len(own)}", int(own) - least, 9 * least) + least
    return code + _put(text[len(code):], "0" * (len(digits) - len(own)) + str(new))


def _date(f: Feistel, text: str) -> str | None:
    """Year first; day, month, year with dots; with slashes the month first, if that can be."""
    a, b, c = (int(x) for x in re.split(r"[-/.]", text))
    sep = re.search(r"[-/.]", text).group()
    try:
        if a > 31:
            order, day = "ymd", date(a, b, c)
        elif sep != "." and a <= 12:
            order, day = "mdy", date(c, a, b)
        else:
            order, day = "dmy", date(c, b, a)
    except ValueError:
        return None
    if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
        return None
    # a day that could be read as a month would change how the pseudonym is read
    allowed = (lambda v: date.fromordinal(FIRST_DAY + v).day > 12) if order == "dmy" and sep != "." else (lambda _: True)
    what = "date|late" if order == "dmy" and sep != "." else "date"
    new = date.fromordinal(FIRST_DAY + f.permute(what, day.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, allowed))
    return sep.join({"y": f"{new.year:04}", "m": f"{new.month:02}", "d": f"{new.day:02}"}[k] for k in order)


def _key(f: Feistel, text: str) -> str:
    return "AKIA" + _over(f, "access key", text[4:], UPPER_DIGITS)


def _secret(f: Feistel, text: str) -> str | None:
    upper = text.upper() == text
    if not upper and text.lower() != text:
        return None
    new = _over(f, "secret", text.lower(), HEX)
    if new.upper() == new or text.lower() == text.upper():  # without a letter the case could not be read back
        return None
    return new.upper() if upper else new


_EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_NUMBER = re.compile(r"""
 (?P<secret>(?<=["'])[0-9a-fA-F]{32,64}(?=["']))
|(?P<key>(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9]))
|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
|(?P<address>(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9]))
|(?P<date>(?<![0-9/.-])(?:[0-9]{4}(?P<d1>[-/])[0-9]{2}(?P=d1)[0-9]{2}|[0-9]{2}(?P<d2>[-/.])[0-9]{2}(?P=d2)[0-9]{4})(?![0-9]|[/.-][0-9]))
|(?P<social>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))
|(?P<card>(?<![0-9A-Za-z])(?:[0-9]{4}(?P<c1>[ -])[0-9]{4}(?P=c1)[0-9]{4}(?P=c1)[0-9]{4}|[0-9]{4}(?P<c2>[ -])[0-9]{6}(?P=c2)[0-9]{5}|[0-9]{13,19})(?![0-9A-Za-z]))
|(?P<phone>\+[0-9]{1,15}(?![0-9])(?:[ .-]?\([0-9]{1,5}\)(?:[ .-]?[0-9]{1,14}(?![0-9]))?|[ .-][0-9](?![0-9]))?
    (?:(?:[ .-][0-9]{2,14}|[.-][0-9])(?![0-9]))*
  |\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])
  |(?<![0-9.+-])[0-9]{3}(?P<p1>[.-])[0-9]{3}(?P=p1)[0-9]{4}(?![0-9-]))
""", re.VERBOSE)
_ANY_DIGIT = re.compile(r"[0-9]")
_CHANGES = {"secret": _secret, "key": _key, "iban": _iban, "address": _address, "date": _date, "social": _social,
            "card": _card, "phone": _phone}
_ENDS = {"iban": _iban_end, "phone": _phone_end}


def replaced(text: str | None, f: Feistel) -> tuple[str | None, int]:
    """The text with pseudonyms (or, for an inverse Feistel, values), and how many were set."""
    if not text:
        return text, 0
    count = 0

    def email(m: re.Match) -> str:
        nonlocal count
        count += 1
        return _email(f, m.group())

    if "@" in text:
        text = _EMAIL.sub(email, text)
    if not _ANY_DIGIT.search(text):
        return text, count
    out, done, at, refused = [], 0, 0, []
    while m := _NUMBER.search(text, at):
        kind, start, part = m.lastgroup, m.start(), m.group()
        if kind in _ENDS:
            part = part[:_ENDS[kind](part)]
        at = start + len(part)
        new = _CHANGES[kind](f, part)
        refused = [w for w in refused if w[1] > start]
        while new is not None and any(_holds(text[a:start] + new + text[at:b]) for a, b in refused):
            new = _CHANGES[kind](f, new)  # the refused bank number around it must stay one
        if new is not None:
            out += text[done:start], new
            done = at
            count += 1
        elif kind == "iban":
            refused.append((start, at))
            at = start + 4
        elif kind == "phone":
            at = start + 1
    out.append(text[done:])
    return "".join(out), count


def _holds(text: str) -> bool:
    """Does a refused run of groups hold now, whole or in its country's length?"""
    return _is_iban(text) or _iban_end(text) < len(text)


def pseudonymize(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """The columns of ``docs`` with new texts and n_pseudonyms; ``back`` restores the values.

    Found are e-mail addresses (the name is permuted), phone numbers, payment cards, bank accounts,
    social security numbers, IPv4 addresses, dates from 1900 to 2099, access keys and quoted
    hexadecimal secrets.  NULL and empty texts stay; repeated rows are each treated; a column
    n_pseudonyms of ``docs`` is replaced; an empty table gives no rows.
    """
    import pyarrow as pa

    def treat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key, back)
        for batch in batches:
            done = [replaced(t.as_py(), f) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())],
                names=["row", "text", "n_pseudonyms"])

    packed = bounded(docs).select(in_row(docs, "text", "n_pseudonyms"), "text")
    found = packed.mapInArrow(treat, row_schema(packed, "text string, n_pseudonyms long"))
    return found.select(*out_of_row(docs, "n_pseudonyms"), "n_pseudonyms")
