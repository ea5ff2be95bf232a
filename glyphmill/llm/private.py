"""Personal data: format-preserving Feistel pseudonyms.

Numbers and dates that pass their format's check are permuted within that format by a keyed Feistel network, so that equal
values have equal pseudonyms in all documents, different values different ones, and every pseudonym passes the same check:
card numbers keep their length and have a right Luhn digit, IBANs right check digits, IPv4 octets stay below 256, dates
exist. Secrets, mail addresses and telephone numbers keep the class of each character. What fails its check (a 16-digit
number without a right Luhn digit, an octet of 300, 31 February) is no such value and stays.

A value has one pseudonym in all its forms: a telephone number with its country and without marks between, a date in any
order and with any marks. A date stays in its class of one or two digits for day and month, so that each form can write it.

A text keeps its number of characters. Null texts stay null, empty ones empty. Repeated rows are treated alike, ties don't
arise. Very long texts take time in proportion to their length, values of more than BLOCK characters are permuted block by
block. An empty table gives an empty one. Domains aren't powers of two: the network works on the next even number of bits,
again and again until the result is in the domain.

The key is the caller's. key_of() takes it from the session; where that has none, each run draws its own, so that pseudonyms
link documents within the run only and nobody can undo them.
"""

from __future__ import annotations

import functools
import hashlib
import re
import secrets
import string
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from . import common

#: The session's setting of the key.
KEY_SETTING = "spark.glyphmill.key"
ROUNDS = 8
#: Characters that are permuted together.
BLOCK = 64
KINDS = ("card", "iban", "ipv4", "date", "ssn", "phone", "email", "secret")
FIRST_DAY, DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days

# each begins where no earlier place could have begun it, so that no character is read more than a few times
_PATTERN = re.compile(
    r"""(?P<secret>(?i:(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)["']?\s{0,8}[=:]\s{0,8}["']?)(?P<value>[A-Za-z0-9+/_\-]{12,})|\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|(?:[0-9a-f]{40}|[0-9A-F]{40}|[0-9a-f]{64}|[0-9A-F]{64})\b))"""
    r"""|(?P<email>(?<![\w.%+-])[\w.%+-]++@[\w-]++(?:\.[\w-]++)+)"""
    r"""|(?P<iban>\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b)"""
    r"""|(?P<phone>(?<![\w+./-])[0-9]{3}(?P<mark>[.-])[0-9]{3}(?P=mark)[0-9]{4}(?![\w]|[.-][0-9])|(?<![\w+])\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![\w+])\+[0-9]{1,3}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{2,4})){2,5}(?![0-9]|\.[0-9])|(?<![\w(])\([0-9]{3}\)[ ]?[0-9]{3}[-. ][0-9]{4}(?![0-9]))"""
    r"""|(?P<ipv4>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))"""
    r"""|(?P<date>(?<![0-9./-])(?:[0-9]{4}(?:-[0-9]{2}-[0-9]{2}|/[0-9]{1,2}/[0-9]{1,2})|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9]|[./-][0-9]))"""
    r"""|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"""
    r"""|(?P<card>(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9]))"""
)
# fixed values: country codes of one and two digits (ITU-T E.164); all others have three
COUNTRIES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: A text without any of these can hold nothing of the above but a bare secret, which has digits too.
_HINT = re.compile(r"[0-9@]|(?i:token|secret|passw|pwd|api.?key|access.?key)")


class Permutation:
    """Keyed permutations of 0 .. n - 1, one for each tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def __call__(self, value: int, n: int, tweak: str) -> int:
        if n < 2:
            return value
        half = ((n - 1).bit_length() + 1) // 2
        mask, width = (1 << half) - 1, (half + 7) // 8
        seeded = hashlib.blake2b(f"{tweak}/{n}".encode(), key=self.key, digest_size=min(64, max(16, width)))
        while True:
            left, right = value >> half, value & mask
            for k in range(ROUNDS):
                h = seeded.copy()
                h.update(bytes([k]) + right.to_bytes(width, "little"))
                left, right = right, left ^ (int.from_bytes(h.digest(), "little") & mask)
            value = left << half | right
            if value < n:
                return value


_CLASSES = {c: (alphabet, i) for alphabet in (string.digits, string.ascii_lowercase, string.ascii_uppercase, "".join(map(chr, range(0xC0, 0xD7))) + "ØÙÚÛÜÝÞ", "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ") for i, c in enumerate(alphabet)}
_HEX = {c: (alphabet, i) for alphabet in ("0123456789abcdef",) for i, c in enumerate(alphabet)}
_UPPER_HEX = {c: ("0123456789ABCDEF", i) for i, c in enumerate("0123456789ABCDEF")}


def luhn(digits: str) -> bool:
    return _luhn_digit(digits[:-1]) == int(digits[-1])


def _luhn_digit(head: str) -> int:
    total = 0
    for i, c in enumerate(reversed(head)):
        d = int(c)
        total += d if i % 2 else (d * 2 - 9 if d > 4 else d * 2)
    return -total % 10


@functools.lru_cache(1 << 16)
def _group(text: str) -> tuple[int, int]:
    """What a group of an IBAN adds, and by what it moves those before it; a text full of groups has each read by several attempts."""
    digits = "".join(str(int(c, 36)) for c in text)
    return int(digits), 10 ** len(digits) % 97


def _mod97(iban: str) -> int:
    rest, turned = 0, iban[4:] + iban[:4]
    for at in range(0, len(turned), 4):
        value, power = _group(turned[at : at + 4])
        rest = (rest * power + value) % 97
    return rest


class Pseudonyms:
    def __init__(self, key: bytes):
        self.permute = Permutation(key)

    def by_class(self, text: str, tweak: str, classes: dict = _CLASSES) -> str:
        """Each character becomes one of its class, together as one number in mixed radix."""
        if len(text) > BLOCK:  # block by block, each in dependence on the one before
            parts, tweak = [], f"{tweak}/{len(text)}"
            for at in range(0, len(text), BLOCK):
                parts.append(self.by_class(text[at : at + BLOCK], f"{tweak}/{at}/{parts[-1] if parts else ''}", classes))
            return "".join(parts)
        value, n = 0, 1
        for c in text:
            if c in classes:
                alphabet, i = classes[c]
                value, n = value * len(alphabet) + i, n * len(alphabet)
        value = self.permute(value, n, tweak + "/" + str(len(text)))
        out = []
        for c in reversed(text):
            if c in classes:
                alphabet = classes[c][0]
                value, i = divmod(value, len(alphabet))
                c = alphabet[i]
            out.append(c)
        return "".join(reversed(out))

    @staticmethod
    def _filled(form: str, digits: str) -> str:
        each = iter(digits)
        return re.sub(r"[0-9]", lambda _: next(each), form)

    def card(self, text: str) -> str | None:
        digits = re.sub(r"[^0-9]", "", text)
        if not luhn(digits) or len(set(digits)) == 1:
            return None
        n = len(digits) - 1
        head = str(self.permute(int(digits[:-1]), 10**n, "card")).zfill(n)
        return self._filled(text, head + str(_luhn_digit(head)))

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _mod97(plain) != 1:
            return None
        body = self.by_class(plain[4:], "iban" + plain[:2])
        each = iter(plain[:2] + f"{98 - _mod97(plain[:2] + '00' + body):02d}" + body)
        return "".join(c if c == " " else next(each) for c in text)

    def ipv4(self, text: str) -> str | None:
        octets = text.split(".")
        if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
            return None
        # octets keep their number of digits, so that the text keeps its length
        size = {1: (0, 10), 2: (10, 90), 3: (100, 156)}
        value, n = 0, 1
        for o in octets:
            low, count = size[len(o)]
            value, n = value * count + int(o) - low, n * count
        value, out = self.permute(value, n, "ipv4" + "".join(str(len(o)) for o in octets)), []
        for o in reversed(octets):
            low, count = size[len(o)]
            value, i = divmod(value, count)
            out.append(str(low + i))
        return ".".join(reversed(out))

    def date(self, text: str) -> str | None:
        parts = re.split(r"[-/.]", text)
        iso = len(parts[0]) == 4  # year first
        year, month, day = (int(p) for p in (parts if iso else parts[::-1]))
        swapped = not iso and "/" in text and month > 12
        if swapped:
            month, day = day, month
        try:
            at = (date(year, month, day) - FIRST_DAY).days
        except ValueError:
            return None
        if not 0 <= at < DAYS:
            return None
        # of one class, so that each form has room for it and is read back alike
        kind = lambda d: ((d.day > 9) + (d.day > 12), d.month > 9)
        old = new = date(year, month, day)
        while True:
            at = self.permute(at, DAYS, "date")
            new = FIRST_DAY + timedelta(at)
            if kind(new) == kind(old):
                break
        values = (new.year, new.month, new.day) if iso else (new.month, new.day, new.year) if swapped else (new.day, new.month, new.year)
        each = iter(str(v).zfill(len(p)) for v, p in zip(values, parts))
        return re.sub(r"[0-9]+", lambda _: next(each), text)

    def ssn(self, text: str) -> str | None:
        def valid(d: str) -> bool:
            return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

        digits = text.replace("-", "")
        if not valid(digits):
            return None
        while True:
            digits = str(self.permute(int(digits), 10**9, "ssn")).zfill(9)
            if valid(digits):
                return self._filled(text, digits)

    def phone(self, text: str) -> str | None:
        digits = re.sub(r"[^0-9]", "", text)
        if not 8 <= len(digits) <= 15:
            return None
        code = ""  # the country stays
        if text[0] == "+":
            code = next((digits[:n] for n in (1, 2) if digits[:n] in COUNTRIES), digits[:3])
        own = digits[len(code) :]
        return self._filled(text, code + str(self.permute(int(own), 10 ** len(own), "phone" + (code or "1"))).zfill(len(own)))

    def email(self, text: str) -> str:
        name, _, domain = text.rpartition("@")
        host, dot, top = domain.rpartition(".")
        return self.by_class(name, "name") + "@" + self.by_class(host, "host") + dot + top

    def secret(self, text: str) -> str:
        classes = _HEX if set(text) <= set(_HEX) else _UPPER_HEX if set(text) <= set(_UPPER_HEX) else _CLASSES
        return self.by_class(text, "secret", classes)

    def replace(self, text: str | None) -> tuple[str | None, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of each."""
        if not text or not _HINT.search(text):
            return text, []
        parts, found, at = [], [], 0
        m = _PATTERN.search(text)
        while m:
            kind = m.lastgroup if m.lastgroup != "value" else "secret"
            start, end = m.span("value") if kind == "secret" and m["value"] else m.span()
            new = getattr(self, kind)(text[start:end])
            if new is not None:
                parts += [text[at:start], new]
                found.append((kind, start, end))
                at = end
            # what isn't a value of its kind may hold one of another, but nothing begins within the head of an IBAN
            head = 1 if kind != "iban" else 5 if text[start + 4] == " " else 2
            m = _PATTERN.search(text, end if new is not None else m.start() + head)
        return ("".join([*parts, text[at:]]) if found else text), found


def key_of(spark: SparkSession) -> bytes:
    """The session's key; without one, a new one for this run."""
    given = spark.conf.get(KEY_SETTING, None)
    return given.encode() if given else secrets.token_bytes(32)


def pseudonymise(df: DataFrame, key: bytes, text: str = "text", counts: bool = True) -> DataFrame:
    """df with its text pseudonymised; with counts also n_<kind> (int) for each of KINDS. All columns of df stay.

    Columns of df with the names of the counts are replaced.
    """
    names = [f"n_{k}" for k in KINDS] if counts else []
    df = df.select(*[c for c in df.columns if c not in names])
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, *(T.StructField(name, T.IntegerType()) for name in names)])

    def start():
        common.release()
        pseudonyms = Pseudonyms(key)

        def each(batch):
            done = [pseudonyms.replace(t) for t in batch.column(at).to_pylist()]
            out = dict(zip(batch.schema.names, batch.columns))
            out[text] = pa.array([d[0] for d in done], pa.string())
            for kind, name in zip(KINDS, names):
                out[name] = pa.array([sum(f[0] == kind for f in d[1]) for d in done], pa.int32())
            return out

        return each

    return common.arrow_map(df, schema, start)
