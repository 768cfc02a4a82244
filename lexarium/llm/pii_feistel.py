"""Personal data under format-preserving pseudonyms.

What looks like personal data is validated (check digits, ranges, calendar)
and then replaced by another value of the same format: a keyed Feistel network
permutes the values of the format, so equal values get equal pseudonyms in all
documents, different values different ones, no value its own, and a pseudonym
passes the same validation and is as long, but for the names of months. Texts
are never shuffled; each is rewritten where it is read.

A date is permuted among those whose day and month have as many digits, so it
keeps its length in every way of writing it and stays the same date in all.
Ten digits without separators count as a phone number after a word that says
so; a year of two digits counts after slashes. Letters of other scripts than
Latin, Greek and Cyrillic stay.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from datetime import date
from functools import lru_cache
from ipaddress import AddressValueError, IPv6Address
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarium.llm.common import spread

ROUNDS = 8
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()

#: What the part before the @ is made of: ASCII, Latin, Greek and Cyrillic letters, digits and signs.
_IN_LOCAL = r"[A-Za-z0-9_%+\-À-ÖØ-öø-ɏͰ-ϿЀ-ӿ]"
_EMAIL_LOCAL = re.compile(rf"{_IN_LOCAL}+(?:\.{_IN_LOCAL}+)*\Z")
_EMAIL_HOST = re.compile(r"(?:[^\W_](?:(?:[^\W_]|-){0,62})\.)+[^\W\d_]{2,24}(?![^\W_])")
#: Letters beyond ASCII that stand for each other in emails: first and last, where all between are small letters (fixed values).
_LETTERS = ((0xDF, 0xF6), (0xF8, 0xFF), (0x3B1, 0x3C1), (0x3C3, 0x3C9), (0x430, 0x44F))
#: Months in four languages, and words that announce a phone number (fixed values).
MONTHS = {
    "en": "january february march april may june july august september october november december".split(),
    "de": "januar februar m\u00e4rz april mai juni juli august september oktober november dezember".split(),
    "fr": "janvier f\u00e9vrier mars avril mai juin juillet ao\u00fbt septembre octobre novembre d\u00e9cembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
_CUES = "call phone telephone tel mobile cell fax telefon telefax handy rufnummer t\u00e9l\u00e9phone t\u00e9l portable tel\u00e9fono m\u00f3vil"
_PARTS = {
    "iban": r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?",
    "iso": r"[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}",
    "day": r"[0-9]{1,2}([-/.])[0-9]{1,2}\1[0-9]{4}",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?(?:\(0?[0-9]{0,4}\)[ .-]?)?[0-9]{1,5}(?:[ ./-]?[0-9]{2,8}){1,4}|(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}|0[0-9](?:[ .-][0-9]{2}){4}|\(?0[0-9]{2,4}\)?[ /-][0-9]{5,8}|\+[0-9]{8,15})",
    "short": r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}",
}
_BEFORE, _ENDS = r"(?<![0-9A-Za-z.+-])", r"(?![0-9A-Za-z])(?![./-][0-9])"
#: Each format; the first that matches at a place and validates wins. All quantifiers are bounded. A time may follow an ISO date.
_ONE = {kind: re.compile((f"{part}(?:(?=T[0-9]{{2}})|{_ENDS})" if kind == "iso" else part + (_ENDS if kind in ("ip", "day", "short") else r"(?![0-9A-Za-z])(?!\.[0-9])"))) for kind, part in _PARTS.items()}
#: Where a number may begin.
_START = re.compile(_BEFORE + r"(?=[A-Z]{2}[0-9]{2}[ ]?[A-Z0-9]{4}|\+[0-9]|\(?[0-9])[A-Z(+]?[A-Z0-9]?[0-9]*")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f:]{0,4}:[0-9A-Fa-f:]{1,34}(?![0-9A-Za-z:])")
_YEAR = re.compile(r"(?<![0-9])[0-9]{4}(?![0-9])")
_MONTH_OF = {name: (language, k + 1) for language in reversed(MONTHS) for k, name in enumerate(MONTHS[language])}
_NAMES = "|".join(sorted(_MONTH_OF, key=len, reverse=True))
_WRITTEN = re.compile(rf"(?<!\w)(?:(?P<d1>[0-9]{{1,2}})(?P<s1>\.|st|nd|rd|th)?(?P<g1> de | )(?P<m1>{_NAMES})(?P<h1> de |, | )|(?P<m2>{_NAMES}) (?P<d2>[0-9]{{1,2}})(?P<s2>st|nd|rd|th)?(?P<h2>, | ))\Z", re.IGNORECASE)
_BARE = re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{10}(?![0-9A-Za-z])(?!\.[0-9])")
_CUE = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(_CUES.split(), key=len, reverse=True))})\.?:? ?(?:is |at |no\.? |number:? )?\Z", re.IGNORECASE)


@lru_cache(8)
def _days(first: int, last: int, short_day: bool, short_month: bool) -> list[int]:
    """The days from first to last whose day and month have one digit or two."""
    found = (date.fromordinal(k) for k in range(first, last + 1))
    return [d.toordinal() for d in found if (d.day < 10) == short_day and (d.month < 10) == short_month]


class Permutation:
    """A keyed permutation of range(n): an unbalanced Feistel network, walked until it is inside."""

    def __init__(self, key: bytes, domain: str, n: int):
        self.n, self.a = n, isqrt(n - 1) + 1 if n > 1 else 1
        self.b = -(-n // self.a)
        self.width = (self.a.bit_length() + 7) // 8 + 8
        self.seed = hashlib.blake2b(f"{domain}:{n}".encode(), key=key[:64], digest_size=32).digest()

    def _round(self, k: int, half: int) -> int:
        data = k.to_bytes(1, "big") + half.to_bytes(self.width, "big")
        return int.from_bytes(hashlib.shake_256(self.seed + data).digest(self.width), "big")

    def __call__(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.b)
            for k in range(0, ROUNDS, 2):
                left = (left + self._round(k, right)) % self.a
                right = (right + self._round(k + 1, left)) % self.b
            x = left * self.b + right
            if x < self.n:
                return x

    def moved(self, x: int) -> int:
        """x under a permutation of range(n) that leaves nothing in place: a keyed step along the order that this one gives."""
        if self.n < 2:
            return x
        step = 1 + self._round(255, 0) % (self.n - 1)
        return self.inverse((self(x) + step) % self.n)

    def inverse(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.b)
            for k in range(ROUNDS - 2, -1, -2):
                right = (right - self._round(k + 1, left)) % self.b
                left = (left - self._round(k, right)) % self.a
            x = left * self.b + right
            if x < self.n:
                return x


def luhn_digit(payload: str) -> str:
    """The check digit that makes payload + digit pass the Luhn test."""
    total = sum(sum(divmod(int(d) * (2 - k % 2), 10)) for k, d in enumerate(reversed(payload)))
    return str(-total % 10)


def iban_digits(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in f"{account}{country}00")
    return f"{98 - int(number) % 97:02d}"


def _refill(pattern: str, chars: str) -> str:
    """chars in the places of the letters and digits of pattern."""
    rest = iter(chars)
    return "".join(next(rest) if c.isalnum() else c for c in pattern)


class Pseudonyms:
    """Pseudonyms under one key."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("a key is needed")
        self.key, self.made = hashlib.blake2b(key).digest(), {}

    def _permuted(self, domain: str, n: int, x: int) -> int:
        if (domain, n) not in self.made:
            if len(self.made) > 4096:
                self.made.clear()
            self.made[domain, n] = Permutation(self.key, domain, n)
        return self.made[domain, n].moved(x)

    def _mixed(self, domain: str, digits: list[tuple[int, int]]) -> list[int]:
        """Digits, each with its radix, permuted together."""
        x, n = 0, 1
        for d, radix in digits:
            x, n = x * radix + d, n * radix
        x = self._permuted(domain, n, x)
        out = []
        for _, radix in reversed(digits):
            x, d = divmod(x, radix)
            out.append(d)
        return out[::-1]

    def _digits(self, domain: str, digits: str) -> str:
        n = 10 ** len(digits)
        return str(self._permuted(f"{domain}{len(digits)}", n, int(digits))).zfill(len(digits))

    def _chars(self, domain: str, text: str) -> str:
        """Letters stay letters of their script and digits digits, by place; case and other characters stay."""
        lower = [c.lower() if len(c.lower()) == 1 else c for c in text]
        first = [next((a for a, b in (("0", "9"), ("a", "z"), *((chr(x), chr(y)) for x, y in _LETTERS)) if a <= c <= b), "") for c in lower]
        last = {"0": "9", "a": "z"} | {chr(x): chr(y) for x, y in _LETTERS}
        digits = [(ord(c) - ord(f), ord(last[f]) - ord(f) + 1) for c, f in zip(lower, first) if f]
        shape = "".join({"0": "9"}.get(f, f or c) for c, f in zip(lower, first))
        made = iter(self._mixed(f"{domain}:{shape}", digits) if digits else ())
        new = [chr(ord(f) + next(made)) if f else c for c, f in zip(text, first)]
        return "".join(n.upper() if f not in ("", "0") and c != low and len(n.upper()) == 1 else n for n, c, low, f in zip(new, text, lower, first))

    def email(self, local: str, host: str) -> str:
        return f"{self._chars('email', local)}@{host}"

    def card(self, text: str) -> str | None:
        digits = re.sub("[ -]", "", text)
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        payload = self._digits("card", digits[:-1])
        return _refill(text, payload + luhn_digit(payload))

    def phone(self, text: str) -> str | None:
        code = re.match(r"\+[0-9]{1,3}(?=[ .(-])", text)
        rest = text[code.end() :] if code else text
        digits = re.sub("[^0-9]", "", rest)
        if not 7 <= len(digits) <= (15 if not code else 10 if code.group() == "+1" else 11):
            return None
        return (code.group() if code else "") + _refill(rest, self._digits("phone", digits))

    def ip(self, text: str) -> str | None:
        """An octet keeps its number of digits."""
        parts = text.split(".")
        if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
            return None
        low, radix = (0, 0, 10, 100), (0, 10, 90, 156)
        made = self._mixed("ip:" + ".".join(str(len(p)) for p in parts), [(int(p) - low[len(p)], radix[len(p)]) for p in parts])
        return ".".join(str(low[len(p)] + d) for p, d in zip(parts, made))

    def ipv6(self, text: str) -> str | None:
        """A group keeps its number of digits; the address is validated as a whole."""
        try:
            IPv6Address(text)
        except AddressValueError:
            return None
        leads = [k == 0 or text[k - 1] == ":" for k in range(len(text))]
        long = [lead and k + 1 < len(text) and text[k + 1] != ":" for k, lead in enumerate(leads)]
        digits = [(int(c, 16) - (n and c != "0"), 16 - (n and c != "0")) for c, n in zip(text, long) if c != ":"]
        if not digits:
            return None
        made = iter(self._mixed("ipv6:" + "".join(c if c == ":" else "xyz"[n + (n and c == "0")] for c, n in zip(text, long)), digits))
        new = "".join(c if c == ":" else f"{next(made) + (n and c != '0'):x}" for c, n in zip(text, long))
        return new.upper() if re.search("[A-F]", text) else new

    def ssn(self, text: str) -> str | None:
        area, group, serial = (int(p) for p in text.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(self._permuted("ssn", 898 * 99 * 9999, x), 9999)
        area, group = divmod(x, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        country, check, account = plain[:2], plain[2:4], plain[4:]
        if not 15 <= len(plain) <= 34 or iban_digits(country, account) != check:
            return None
        account = self._chars("iban", account)
        return _refill(text, country + iban_digits(country, account) + account)

    def _day(self, y: int, m: int, d: int, first: int = FIRST_DAY, last: int = LAST_DAY) -> date | None:
        try:
            day = date(y, m, d).toordinal()
        except ValueError:
            return None
        if not first <= day <= last:
            return None
        days = _days(first, last, d < 10, m < 10)
        return date.fromordinal(days[self._permuted(f"day:{first}:{d < 10}:{m < 10}", len(days), bisect_left(days, day))])

    def iso(self, text: str) -> str | None:
        new = self._day(*(int(p) for p in re.split("[-/.]", text)))
        return new and text[4].join((f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"))

    def day(self, text: str) -> str | None:
        """Day first where points separate, month first otherwise, the other way where only that is a date."""
        mark = re.search("[-/.]", text).group()
        parts = text.split(mark)
        a, b, y = map(int, parts)
        bounds = (FIRST_DAY, LAST_DAY)
        if len(parts[2]) == 2:
            y, bounds = (2000 if y < 50 else 1900) + y, (date(1950, 1, 1).toordinal(), date(2049, 12, 31).toordinal())
        for month_first in (mark != ".", mark == "."):
            m, d = (a, b) if month_first else (b, a)
            if new := self._day(y, m, d, *bounds):
                pair = (new.month, new.day) if month_first else (new.day, new.month)
                year = f"{new.year:04d}"[-len(parts[2]) :]
                return mark.join((*(f"{x:0{len(p)}d}" for x, p in zip(pair, parts)), year))
        return None

    short = day

    def written(self, m: re.Match, year: str) -> str | None:
        """A date with its month's name, in the same language, case and order."""
        which = "1" if m["m1"] else "2"
        name, day, suffix = m["m" + which], m["d" + which], m["s" + which] or ""
        language, month = _MONTH_OF[name.lower()]
        new = self._day(int(year), month, int(day))
        if not new:
            return None
        month_name = MONTHS[language][new.month - 1]
        month_name = month_name.upper() if name.isupper() and len(name) > 1 else month_name.capitalize() if name[0].isupper() else month_name
        if suffix[:1].isalpha():
            ends = {1: "st", 2: "nd", 3: "rd"}.get(new.day % 10, "th") if not 10 < new.day < 20 else "th"
            suffix = ends.upper() if suffix.isupper() else ends
        shown = f"{new.day:0{len(day)}d}{suffix}"
        return f"{shown}{m['g1']}{month_name}{m['h1']}{new.year}" if which == "1" else f"{month_name} {shown}{m['h2']}{new.year}"

    def _emails(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        at = text.find("@")
        while at >= 0:
            start = max(0, at - 64)
            local, host = _EMAIL_LOCAL.search(text, start, at), _EMAIL_HOST.match(text, at + 1, at + 256)
            if local and host and not (local.start() == start and start and re.match(_IN_LOCAL, text[start - 1])):
                yield local.start(), host.end(), "email", self.email(local.group(), host.group())
            at = text.find("@", at + 1)

    def _reading(self, text: str, at: int) -> tuple[int, str, str] | None:
        """(end, kind, pseudonym) of the first format that matches at this place and validates, the longest end first."""
        for kind, pattern in _ONE.items():
            m = pattern.match(text, at)
            while m:
                if new := getattr(self, kind)(m.group()):
                    return m.end(), kind, new
                cut = max(m.group().rfind(" "), m.group().rfind("-")) if kind in ("iban", "card", "phone") else -1
                m = pattern.match(text, at, at + cut) if cut > 0 else None  # ends at a group's border
        return None

    def _numbers(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        at = 0
        while m := _START.search(text, at):
            found = self._reading(text, m.start())
            if found is None:  # past the digits that begin here: no part of a number is tried by itself
                at = max(m.end(), m.start() + 1)
            else:
                at, kind, new = found
                yield m.start(), at, {"iso": "date", "day": "date", "short": "date"}.get(kind, kind), new

    def _others(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        """What is found from its end or its middle: dates with a month's name, announced phone numbers, IPv6 addresses."""
        for m in _YEAR.finditer(text):
            if (before := _WRITTEN.search(text, max(0, m.start() - 32), m.start())) and (new := self.written(before, m.group())):
                yield before.start(), m.end(), "date", new
        for m in _BARE.finditer(text):
            if _CUE.search(text, max(0, m.start() - 24), m.start()):
                yield m.start(), m.end(), "phone", self.phone(m.group())
        if text.count(":") > 1:
            for m in _IPV6.finditer(text):
                if new := self.ipv6(m.group()):
                    yield m.start(), m.end(), "ip", new

    def found(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of the values of a text, in order; of two that overlap the first."""
        at = 0
        for start, end, kind, new in sorted([*self._emails(text), *self._numbers(text), *self._others(text)]):
            if start >= at:
                yield start, end, kind, new
                at = end

    def rewrite(self, text: str | None) -> tuple[str | None, list[tuple[int, int, str]]]:
        """The text with pseudonyms, and (start, end, kind) of each in the new text."""
        if not text or not ("@" in text or _DIGIT.search(text) or "::" in text):
            return text, []
        out, spans, at, size = [], [], 0, 0
        for start, end, kind, new in self.found(text):
            out += (text[at:start], new)
            size += start - at
            spans.append((size, size + len(new), kind))
            size += len(new)
            at = end
        out.append(text[at:])
        return "".join(out), spans


_DIGIT = re.compile("[0-9]")


def pseudonymised(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, n_found, spans) of every row of docs(doc_id, text, ...).

    spans: start, end and kind of each pseudonym, in code points of the new
    text. Kinds: email, phone, ip, card, ssn, iban, date.

    A null text stays null, an empty one empty; repeated rows get equal
    results; an empty table gives an empty result; further columns are ignored.
    """
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts, found = [], []
                for text in part.column("text"):
                    new, spans = names.rewrite(text.as_py())
                    texts.append(new)
                    found.append([{"start": a, "end": b, "kind": k} for a, b, k in spans])
                columns = [part.column("doc_id"), pa.array(texts, pa.string()), pa.array([len(f) for f in found], pa.int64()), pa.array(found, spans_type)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_found", "spans"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(slim).mapInArrow(run, "doc_id long, text string, n_found long, spans array<struct<start:int,end:int,kind:string>>")
