"""Format-preserving pseudonyms for personal data."""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

ROUNDS = 8
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST_DAY

EMAIL = re.compile(r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
NUMBER = re.compile(
    r"(?<![0-9A-Za-z])(?:"
    r"(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?)"
    r"|(?P<iso>(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})"
    r"|(?P<day>[0-9]{2}[./][0-9]{2}[./](?:19|20)[0-9]{2})"
    r"|(?P<ip>(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.[0-9]))"
    r"|(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-[0-9]))"
    r"|(?P<phone>\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}(?!-[0-9]))"
    r"|(?P<card>[0-9](?:[ \-]?[0-9]){12,18})"
    r")(?![0-9A-Za-z])"
)
TOKEN = re.compile(r"[0-9A-Za-z]+")
#: Kinds whose pattern may take in tokens beside the value.
GREEDY = ("iban", "phone", "card")
# Lengths of the IBAN registry.
IBAN_SIZES = {
    country: size
    for size, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
KINDS = ("email", "iban", "date", "ip", "ssn", "phone", "card")


class Permuter:
    """Keyed permutations of 0..n-1 for any n, as Feistel networks with cycle walking.

    A value is mapped along one keyed cycle through the whole domain (network, plus one, network back), so no
    value stays as it is and two different values never meet.
    """

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, value: int, bits: int) -> int:
        size = (bits + 7) // 8
        out = b""
        while len(out) < size:
            out += hashlib.blake2b(tweak + b"|%d|%d|%d" % (i, value, len(out)), key=self.key, digest_size=32).digest()
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def _network(self, tweak: bytes, value: int, half: int, back: bool) -> int:
        mask = (1 << half) - 1
        left, right = value >> half, value & mask
        for i in range(ROUNDS):
            if back:
                left, right = right ^ self._round(tweak, ROUNDS - 1 - i, left, half), left
            else:
                left, right = right, left ^ self._round(tweak, i, right, half)
        return left << half | right

    def _walk(self, tweak: bytes, value: int, n: int, back: bool) -> int:
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        while True:
            value = self._network(tweak, value, half, back)
            if value < n:
                return value

    def permute(self, kind: str, value: int, n: int) -> int:
        if n < 2:
            return value
        tweak = f"{kind}|{n}".encode()
        return self._walk(tweak, (self._walk(tweak, value, n, True) + 1) % n, n, False)

    def unpermute(self, kind: str, value: int, n: int) -> int:
        if n < 2:
            return value
        tweak = f"{kind}|{n}".encode()
        return self._walk(tweak, (self._walk(tweak, value, n, True) - 1) % n, n, False)


def luhn_digit(payload: str) -> str:
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(payload)))
    return str(-total % 10)


def _digits_back(shape: str, digits: str) -> str:
    fresh = iter(digits)
    return "".join(next(fresh) if c.isdigit() else c for c in shape)


def _permute_digits(perm: Permuter, kind: str, digits: str) -> str:
    return str(perm.permute(kind, int(digits), 10 ** len(digits))).zfill(len(digits))


def _letters(perm: Permuter, kind: str, text: str) -> str:
    """Letters and digits of `text` permuted together, each within its own alphabet."""
    alphabets = [next((a for a in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c in a), c) for c in text]
    value, n = 0, 1
    for c, a in zip(text, alphabets):
        value, n = value * len(a) + a.index(c), n * len(a)
    value = perm.permute(f"{kind}:{''.join(a[0] for a in alphabets)}", value, n)
    out = []
    for a in reversed(alphabets):
        value, i = divmod(value, len(a))
        out.append(a[i])
    return "".join(reversed(out))


def new_email(perm: Permuter, found: str) -> str:
    body, dot, top = found.rpartition(".")
    return _letters(perm, "email", body) + dot + top


def new_card(perm: Permuter, found: str) -> str | None:
    digits = re.sub(r"[^0-9]", "", found)
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    payload = _permute_digits(perm, "card", digits[:-1])
    return _digits_back(found, payload + luhn_digit(payload))


def new_iban(perm: Permuter, found: str) -> str | None:
    plain = found.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = _letters(perm, "iban:" + plain[:2], plain[4:])
    check = 98 - number(body + plain[:2] + "00") % 97
    fresh = iter(f"{plain[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(fresh) for c in found)


@cache
def _late_days() -> list[int]:
    """Days after the 12th of a month: dates with the month first that cannot be read with the day first."""
    return [d for d in range(DAYS) if datetime.date.fromordinal(FIRST_DAY + d).day > 12]


def new_date(perm: Permuter, found: str, iso: bool) -> str | None:
    """Dates are read with the day first; those with the month first that are no such date are permuted among themselves."""
    parts = re.split(r"[-./]", found)
    try:
        year, month, day = map(int, parts if iso else reversed(parts))
        if not iso and month > 12:
            value = datetime.date(year, day, month).toordinal() - FIRST_DAY
            days = _late_days()
            fresh = days[perm.permute("month first", bisect.bisect_left(days, value), len(days))]
            return _digits_back(found, datetime.date.fromordinal(FIRST_DAY + fresh).strftime("%m%d%Y"))
        value = datetime.date(year, month, day).toordinal() - FIRST_DAY
    except ValueError:
        return None
    fresh = datetime.date.fromordinal(FIRST_DAY + perm.permute("date", value, DAYS))
    return _digits_back(found, fresh.strftime("%Y%m%d" if iso else "%d%m%Y"))


def new_ip(perm: Permuter, found: str) -> str | None:
    parts = [int(p) for p in found.split(".")]
    if max(parts) > 255:
        return None
    fresh = perm.permute("ip", int.from_bytes(bytes(parts), "big"), 1 << 32)
    return ".".join(str(b) for b in fresh.to_bytes(4, "big"))


_AREAS = [a for a in range(1, 900) if a != 666]


def new_ssn(perm: Permuter, found: str) -> str | None:
    area, group, serial = map(int, found.split("-"))
    if area not in _AREAS or not group or not serial:
        return None
    value = perm.permute("ssn", (_AREAS.index(area) * 99 + group - 1) * 9999 + serial - 1, len(_AREAS) * 99 * 9999)
    rest, serial = divmod(value, 9999)
    area, group = divmod(rest, 99)
    return f"{_AREAS[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def new_phone(perm: Permuter, found: str) -> str | None:
    head = re.match(r"\+[0-9]{1,3}(?=[ .\-(])|\+1(?=[0-9])|\+[0-9]{2}(?=[0-9])|", found).group()
    rest = found[len(head) :]
    digits = re.sub(r"[^0-9]", "", rest)
    if not 7 <= len(digits) <= 14:
        return None
    return head + _digits_back(rest, _permute_digits(perm, "phone", digits))


def spans(kind: str, found: str, after: str = "") -> list[tuple[int, int]]:
    """Parts of a match that may be the value, in the order in which they are tried; they begin and end with tokens.

    Cards: single tokens, then from the first token on, the longest first; last are those that end inside a number that
    goes on with the two characters `after` the match, as with the first part of a date.  IBANs: the length of a known country, then all.
    """
    if kind not in GREEDY:
        return [(0, len(found))]
    tokens = [m.span() for m in TOKEN.finditer(found)]
    heads = [(0, end) for _, end in reversed(tokens)]
    if kind == "card":
        last = len(tokens)
        if re.fullmatch(r"[-./][0-9]", after):
            last -= 1
            while last and found[tokens[last][0] - 1] == after[0]:
                last -= 1
        heads = [(0, end) for _, end in [*reversed(tokens[:last]), *reversed(tokens[last:])]]
        return [t for t in tokens if t[1] - t[0] >= 13] + [t for t in heads if sum(map(str.isdigit, found[: t[1]])) >= 13]
    if kind == "iban":
        whole = [(a, b) for a, _ in tokens for _, b in tokens if b - a - found.count(" ", a, b) == IBAN_SIZES.get(found[a : a + 2])]
        return whole + (heads[:1] if found[:2] in IBAN_SIZES else heads)
    return heads


def replace_values(text: str, perm: Permuter) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many values of each kind were replaced."""
    counts: dict[str, int] = {}

    def note(kind: str, fresh: str) -> str:
        counts[kind] = counts.get(kind, 0) + 1
        return fresh

    def fresh_value(kind: str, found: str) -> str | None:
        if kind in ("iso", "day"):
            return new_date(perm, found, kind == "iso")
        return {"iban": new_iban, "ip": new_ip, "ssn": new_ssn, "phone": new_phone, "card": new_card}[kind](perm, found)

    def numbers(part: str) -> str:
        out, done, at = [], 0, 0
        while m := NUMBER.search(part, at):
            kind, found = m.lastgroup, m.group()
            at = m.start() + TOKEN.search(found).end() if kind in GREEDY else m.end()
            for a, b in spans(kind, found, part[m.end() : m.end() + 2]):
                fresh = fresh_value(kind, found[a:b])
                if fresh is not None:
                    out += [part[done : m.start() + a], note("date" if kind in ("iso", "day") else kind, fresh)]
                    done = at = m.start() + b
                    break
        return "".join([*out, part[done:]])

    out, at = [], 0
    if "@" in text:
        for m in EMAIL.finditer(text):
            out += [numbers(text[at : m.start()]), note("email", new_email(perm, m.group()))]
            at = m.end()
    return "".join([*out, numbers(text[at:])]), counts


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", counts_col: str | None = None) -> DataFrame:
    """Replace personal data in `text_col` by pseudonyms of the same format; all other columns stay.

    E-mail addresses, phone numbers, IPv4 addresses, card numbers (Luhn), IBANs (mod 97), social security numbers (ranges)
    and dates (calendar) that pass their check are permuted under `key` within their format: check digits are right,
    punctuation, country codes and top-level domains stay, equal values get equal pseudonyms in every document, different
    ones differ, and none maps to itself.  A match that fails its check is tried in parts at token borders, and the search
    goes on after its first token, so neighbours do not hide a value.  Dates are read day first, else month first.  Null texts stay null; rows are independent, so copies, ties and
    very long texts need no care; no rows are moved.  `counts_col` adds the number of replaced values.
    """
    names, at = docs.columns, docs.columns.index(text_col)
    fields = [StructField(f.name, StringType(), True) if f.name == text_col else f for f in docs.schema.fields]
    if counts_col:
        fields.append(StructField(counts_col, LongType(), True))
        names = [*names, counts_col]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perm = Permuter(key.encode())
        digit = re.compile(r"[0-9]")
        for batch in batches:
            texts, counts = [], []
            for text in batch.column(at).cast(pa.string()).to_pylist():
                n = 0
                if text is not None and ("@" in text or digit.search(text)):
                    text, found = replace_values(text, perm)
                    n = sum(found.values())
                texts.append(text)
                counts.append(n)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, type=pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, type=pa.int64())] if counts_col else columns, names=names)

    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(rows, StructType(fields))
