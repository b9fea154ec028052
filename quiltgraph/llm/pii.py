"""Format-preserving pseudonyms for personal numbers, dates and addresses.

What a pattern finds is validated (check digits, calendar, ranges) and then
permuted within its own format by a keyed Feistel network, so a card number
stays a valid card number and a date a date.  A value has one pseudonym per
key and kind wherever it occurs, and the inverse network restores it.  Numbers
are linked however they are punctuated, a day in whatever order it is written,
and a telephone number with its country code or without; e-mail addresses and
secrets are linked by their characters.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import arrow_map

ROUNDS = 10
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), 73049  # to 2099-12-31


def feistel(key: bytes, kind: str, left: int, right: int, x: int, back: bool = False) -> int:
    """The keyed permutation of 0 .. left * right - 1, alternating between the two parts."""
    a, b = divmod(x, right)
    for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
        other = a if i % 2 else b
        size = max(left, right).bit_length() // 8 + 9
        f = int.from_bytes(hashlib.blake2b(f"{kind}|{left}|{right}|{i}|{other}".encode(), key=key[:64], digest_size=min(64, size)).digest(), "big")
        f = -f if back else f
        if i % 2:
            b = (b + f) % right
        else:
            a = (a + f) % left
    return a * right + b


def walked(key: bytes, kind: str, size: int, x: int, back: bool, valid: Callable[[int], bool] = lambda _: True) -> int:
    """The permutation of the valid numbers below size: steps until it meets one again."""
    left = 1 << ((size - 1).bit_length() + 1) // 2
    right = -(-size // left)
    while True:
        x = feistel(key, kind, left, right, x, back)
        if x < size and valid(x):
            return x


def symbols(key: bytes, kind: str, text: str, back: bool, sets: tuple[str, ...]) -> str:
    """Permutes the characters of text that one of ``sets`` holds, each within its set; letters keep their case."""
    places, radix, digits = [], [], []
    for i, c in enumerate(text):
        for s in sets:
            at = s.find(c if c.isdigit() else c.lower())
            if at >= 0:
                places.append(i)
                radix.append(len(s))
                digits.append((at, s))
                break
    half = len(places) // 2
    sizes = [1, 1]
    x = 0
    for k, r in enumerate(radix):
        sizes[k >= half] *= r
        x = x * r + digits[k][0]
    x = feistel(key, kind + "/" + ",".join(map(str, radix)), sizes[0], sizes[1], x, back)
    out = list(text)
    for k in range(len(places) - 1, -1, -1):
        x, at = divmod(x, radix[k])
        c, i = digits[k][1][at], places[k]
        # a digit may become a letter, in the case of the whole
        out[i] = c.upper() if (text.isupper() if text[i].isdigit() or c.isdigit() else text[i].isupper()) else c
    return "".join(out)


LETTERS, DIGITS, HEX, BASE32 = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz234567"


def with_digits(text: str, digits: str) -> str:
    """text with its ASCII digits replaced in turn."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in text)


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> int:
    """The check digit that belongs behind these digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def card(key: bytes, text: str, back: bool) -> str | None:
    d = only_digits(text)
    if luhn(d[:-1]) != int(d[-1]) or not d.strip("0"):
        return None
    body = d[0] + symbols(key, "card" + d[0], d[1:-1], back, (DIGITS,))
    return with_digits(text, body + str(luhn(body))) if body.strip("0") else None


def mod97(code: str) -> int:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


def iban(key: bytes, text: str, back: bool) -> str | None:
    bare = text.replace(" ", "").upper()
    if not 15 <= len(bare) <= 34 or mod97(bare) != 1:
        return None
    body = symbols(key, "iban" + bare[:2], bare[4:], back, (DIGITS, LETTERS))
    bare = bare[:2] + f"{98 - mod97(bare[:2] + '00' + body):02d}" + body
    it = iter(bare)
    return "".join(c if c == " " else next(it) for c in text)


def ssn(key: bytes, text: str, back: bool) -> str | None:
    def valid(x: int) -> bool:
        area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0

    x = int(only_digits(text))
    return with_digits(text, f"{walked(key, 'ssn', 10**9, x, back, valid):09d}") if valid(x) else None


#: Country codes of one and two digits; all others have three.
COUNTRY_1 = "1 7".split()
COUNTRY_2 = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def phone(key: bytes, text: str, back: bool) -> str | None:
    """The country code stays, and what follows it is permuted alike with it and without."""
    d = only_digits(text)
    if not 8 <= len(d) <= 15:
        return None
    head = 0 if not text.startswith("+") else 1 if d[0] in COUNTRY_1 else 2 if d[:2] in COUNTRY_2 else 3
    return with_digits(text, d[:head] + symbols(key, "phone", d[head:], back, (DIGITS,)))


def ipv4(key: bytes, text: str, back: bool) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
        return None
    x = walked(key, "ipv4", 1 << 32, int.from_bytes(bytes(parts), "big"), back)
    return ".".join(str(b) for b in x.to_bytes(4, "big"))


def date(key: bytes, text: str, back: bool) -> str | None:
    """Year first, or last: then a first number over 12 is the day, else the month; dots mean day first."""
    a, mark, b, c = re.fullmatch(r"(\d+)([-/.])(\d+)[-/.](\d+)", text).groups()

    def read(a: str, b: str, c: str) -> tuple[int | None, str]:
        form = "ymd" if len(a) == 4 else "dmy" if mark == "." or int(a) > 12 else "mdy"
        part = dict(zip(form, map(int, (a, b, c))))
        try:
            day = datetime.date(part["y"], part["m"], part["d"]).toordinal() - FIRST_DAY
        except ValueError:
            return None, form
        return (day if 0 <= day < DAYS else None), form

    x, form = read(a, b, c)
    if x is None:
        return None

    def written(x: int) -> tuple[str, str, str]:
        d = datetime.date.fromordinal(FIRST_DAY + x)
        part = {"y": f"{d.year:04d}", "m": f"{d.month:02d}", "d": f"{d.day:02d}"}
        return tuple(part[f] for f in form)

    # days up to the 12th and later ones keep to themselves, so that what is written is read in the same order again
    late = lambda x: datetime.date.fromordinal(FIRST_DAY + x).day > 12
    own = late(x)
    return mark.join(written(walked(key, "date", DAYS, x, back, lambda x: late(x) == own)))


def email(key: bytes, text: str, back: bool) -> str | None:
    local, _, domain = text.rpartition("@")
    new = symbols(key, "email", local, back, (DIGITS, LETTERS))
    return f"{new}@{domain}"


def secret(key: bytes, text: str, back: bool) -> str | None:
    """The value after the sign, in hexadecimal where all of it is, else letters and digits."""
    at = re.search(r"[=:]\s*[\"']?", text).end()
    value = text[at:]
    sets = (HEX,) if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) else (DIGITS, LETTERS)
    return text[:at] + symbols(key, "secret", value, back, sets)


def access_key(key: bytes, text: str, back: bool) -> str | None:
    body = text[4:]
    sets = (BASE32,) if all(c.lower() in BASE32 for c in body) else (DIGITS, LETTERS)
    return text[:4] + symbols(key, "access" + str(len(sets)), body.lower(), back, sets).upper()


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: re.Pattern
    permute: Callable[[bytes, str, bool], str | None]


def _kind(name: str, pattern: str, permute) -> Kind:
    return Kind(name, re.compile(pattern), permute)


#: In order of precedence where findings overlap.
KINDS = (
    _kind("email", r"(?<![\w.+%-])[\w+%-]+(?:\.[\w+%-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])", email),
    _kind("secret", r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key))\s*[=:]\s*[\"']?[A-Za-z0-9_+/-]{8,}(?![A-Za-z0-9_+/-])", secret),
    _kind("access_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", access_key),
    _kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", iban),
    _kind("phone", r"(?<![\w+.])(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9]|\.[0-9]))", phone),
    _kind("card", r"(?<![\w.+-])(?:[0-9]{13,19}|[0-9]{4}(?P<s>[ -])[0-9]{4}(?P=s)[0-9]{4}(?P=s)[0-9]{1,7}|[0-9]{4}(?P<t>[ -])[0-9]{6}(?P=t)[0-9]{5})(?![\w-]|\.[0-9])", card),
    _kind("phone", r"(?<![\w+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])", phone),
    _kind("ssn", r"(?<![\w.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", ssn),
    _kind("ipv4", r"(?<![\w.+-])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w-]|\.[0-9])", ipv4),
    _kind("date", r"(?<![\w./+-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}(?P<m>[-/.])[0-9]{2}(?P=m)[0-9]{4})(?![\w/-]|\.[0-9])", date),
)
DIGIT = re.compile(r"[0-9]")


def replaced(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text with pseudonyms, and (kind, start, end, pseudonym) of each finding in the original text."""
    some = DIGIT.search(text) is not None
    if not some and "@" not in text and "=" not in text and ":" not in text:
        return text, []
    found: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []
    for kind in KINDS:
        if kind.name == "email":
            if "@" not in text:
                continue
        elif kind.name != "secret" and not some:
            continue
        for m in kind.pattern.finditer(text):
            start, end = m.span()
            if any(s < end and start < e for s, e in taken):
                continue
            new = kind.permute(key, m.group(), back)
            if new is not None:
                found.append((start, end, kind.name, new))
                taken.append((start, end))
    found.sort()
    parts, at = [], 0
    for start, end, _, new in found:
        parts += (text[at:start], new)
        at = end
    return "".join([*parts, text[at:]]), [(k, s, e, n) for s, e, k, n in found]


def pseudonymised(docs: DataFrame, key: bytes, text: str = "text", keep: tuple[str, ...] = ("doc_id",), back: bool = False) -> DataFrame:
    """``keep``, text, n_found int, kinds, starts, ends and pseudonyms, one row for each row of docs.

    text has the pseudonyms in it; starts and ends are character places in the
    original text.  A null text stays null with nothing found, an empty one
    empty; very long texts are read whole; repeated rows are kept and get the
    same pseudonyms; null ids are kept; kept columns with the name of a result
    column are replaced.  back restores what the same key made.
    """

    def make():
        def step(c):
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for t in c[text]:
                new, found = replaced(t, key, back) if t else (t, [])
                for o, v in zip(out, (new, len(found), [f[0] for f in found], [f[1] for f in found], [f[2] for f in found], [f[3] for f in found])):
                    o.append(v)
            return list(out)

        return step

    return arrow_map(docs.select(*dict.fromkeys((*keep, text))), make, "text string, n_found int, kinds array<string>, starts array<int>, ends array<int>, pseudonyms array<string>", keep)
