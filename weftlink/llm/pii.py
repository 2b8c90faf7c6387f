"""PII: validated numbers and dates become format-preserving pseudonyms by a keyed Feistel permutation."""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

KINDS = ("email", "phone", "card", "ssn", "iban", "ip", "date")
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()

_EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])")
_NUMBERS = re.compile(
    r"(?P<phone>\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9]))"
    r"|(?<![0-9A-Za-z_.+-])(?:"
    r"(?P<date>(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.](?:[0-9]{2})[/.](?:19|20)[0-9]{2})"
    r"|(?P<ip>(?:[0-9]{1,3}\.){3}[0-9]{1,3})"
    r"|(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})"
    r"|(?P<card>[0-9]{13,19}|[0-9]{4}(?P<sep>[ -])[0-9]{4}(?P=sep)[0-9]{4}(?P=sep)[0-9]{1,7}|[0-9]{4}(?P<amex>[ -])[0-9]{6}(?P=amex)[0-9]{5})"
    r"|(?P<local>\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})"
    r"|(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)"
    r")(?![0-9A-Za-z_]|[.-][0-9])"
)


_NORTH = re.compile("[2-9][0-9]{2}[2-9][0-9]{6}")
#: The country codes of one digit and of two; all others have three.
CODES_1 = ("1", "7")
CODES_2 = (
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
).split()


def code_length(digits: str) -> int:
    """How many digits the country code of an international number has."""
    return 1 if digits[:1] in CODES_1 else 2 if digits[:2] in CODES_2 else 3


class Feistel:
    """A keyed permutation of the numbers below any bound, the same in every process."""

    def __init__(self, key: bytes, rounds: int = 8):
        self.key, self.rounds = hashlib.blake2b(key, digest_size=32).digest(), rounds

    def _round(self, tag: bytes, k: int, x: int, m: int) -> int:
        said = tag + b"|%d|%d" % (k, x)
        return int.from_bytes(hashlib.blake2b(said, key=self.key, digest_size=32).digest()) % m

    def _once(self, x: int, a: int, b: int, tag: bytes) -> int:
        left, right = divmod(x, b)
        for k in range(0, self.rounds, 2):
            right = (right + self._round(tag, k, left, b)) % b
            left = (left + self._round(tag, k + 1, right, a)) % a
        return left * b + right

    def _back(self, x: int, a: int, b: int, tag: bytes) -> int:
        left, right = divmod(x, b)
        for k in range(self.rounds - 2, -1, -2):
            left = (left - self._round(tag, k + 1, right, a)) % a
            right = (right - self._round(tag, k, left, b)) % b
        return left * b + right

    def permute(self, x: int, size: int, tag: str, fits: Callable[[int], bool] = lambda _: True, back: bool = False) -> int:
        """Where ``x < size`` goes; walks on from values that do not fit, so that what fits is permuted among itself."""
        a = math.isqrt(size - 1) + 1 if size > 1 else 1
        b = -(-size // a)
        step, name = (self._back if back else self._once), f"{tag}:{size}".encode()
        while True:
            x = step(x, a, b, name)
            if x < size and fits(x):
                return x


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in shape)


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


class Pseudonyms:
    """Finds, validates and replaces; a value has one pseudonym wherever it stands, under one key."""

    most = 100_000

    def __init__(self, key: bytes):
        self.feistel, self.memo = Feistel(key), {}

    def value(self, kind: str, text: str, back: bool = False) -> str | None:
        """The pseudonym of a value (or, ``back``, the value of a pseudonym); None if it is not valid."""
        if (kind, text, back) not in self.memo:
            if len(self.memo) >= self.most:
                self.memo.clear()
            self.memo[kind, text, back] = getattr(self, f"_{kind}")(text, back)
        return self.memo[kind, text, back]

    def _phone(self, text, back):
        """The number behind the country code is permuted; how it is written plays no part.

        Ten digits that fit the North American plan, with or without the code 1, go among such numbers.
        """
        digits = _digits(text)
        if not 7 <= len(digits) <= 15:
            return None
        code = digits[: code_length(digits)] if text[0] == "+" else ""
        body = digits[len(code) :]
        if not body:
            return None
        plan = lambda x: bool(_NORTH.fullmatch(f"{x:0{len(body)}d}"))
        own = plan(int(body))
        fits = (lambda x: plan(x) == own) if code in ("", "1") else (lambda x: True)
        new = self.feistel.permute(int(body), 10 ** len(body), "phone" + ("" if code == "1" else code), fits, back)
        return _refill(text, code + f"{new:0{len(body)}d}")

    def _card(self, text, back):
        digits = _digits(text)
        if not luhn(digits) or not 13 <= len(digits) <= 19 or not int(digits):
            return None
        n = len(digits) - 1
        body = f"{self.feistel.permute(int(digits[:-1]), 10**n, 'card', bool, back):0{n}d}"
        return _refill(text, next(body + str(d) for d in range(10) if luhn(body + str(d))))

    def _ssn(self, text, back):
        fits = lambda x: (s := f"{x:09d}")[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
        x = int(_digits(text))
        return _refill(text, f"{self.feistel.permute(x, 10**9, 'ssn', fits, back):09d}") if fits(x) else None

    def _iban(self, text, back):
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1:
            return None
        radices = [10 if c.isdigit() else 26 for c in plain[4:]]
        body = self._letters(plain[4:], radices, "iban", back)
        check = f"{98 - iban_rest(plain[:2] + '00' + body):02d}"
        it = iter(plain[:2] + check + body)
        return "".join(c if c == " " else next(it) for c in text)

    def _ip(self, text, back):
        try:
            x = int(ipaddress.IPv4Address(text))
        except ValueError:
            return None
        kind = lambda v: ((a := ipaddress.IPv4Address(v)).is_private, a.is_multicast, a.is_reserved, a.is_loopback)
        own = kind(x)
        if not own[0] and not any(own):
            new = self.feistel.permute(x, 1 << 32, "ip", lambda v: not any(kind(v)), back)
        else:
            low = 1 << 8  # a special address stays in its block
            new = x - x % low + self.feistel.permute(x % low, low, f"ip{x // low}", back=back)
        return str(ipaddress.IPv4Address(new))

    def _date(self, text, back):
        """The day is permuted whatever its format: days past the 12th among each other, so that any order can be read back."""
        order = re.split(r"[-/.]", text)
        year_first = len(order[0]) == 4
        y, (m, d) = (order[0], order[1:]) if year_first else (order[2], (order[1], order[0]))
        american = not year_first and int(m) > 12 >= int(d)
        if american:
            m, d = d, m
        try:
            x = datetime.date(int(y), int(m), int(d)).toordinal() - _FIRST_DAY
        except ValueError:
            return None
        read = lambda v: datetime.date.fromordinal(v + _FIRST_DAY)
        new = read(self.feistel.permute(x, _DAYS, "date", lambda v: (read(v).day > 12) == (int(d) > 12), back))
        parts = [f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"]
        return _refill(text, "".join(parts if year_first else [parts[1], parts[2], parts[0]] if american else parts[::-1]))

    def _letters(self, text: str, radices: list[int], tag: str, back: bool) -> str:
        size = math.prod(radices)
        x = 0
        for c, r in zip(text, radices, strict=True):
            x = x * r + (0 if r == 1 else int(c) if r == 10 else (ord(c) & 31) - 1)
        x = self.feistel.permute(x, size, tag + "".join("d" if r == 10 else "a" if r == 26 else c for c, r in zip(text, radices, strict=True)), back=back)
        out = []
        for c, r in zip(reversed(text), reversed(radices), strict=True):
            x, v = divmod(x, r)
            out.append(c if r == 1 else str(v) if r == 10 else chr((97 if c.islower() else 65) + v))
        return "".join(reversed(out))

    def _email(self, text, back):
        local, _, domain = text.rpartition("@")
        radices = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in local]
        return self._letters(local, radices, "email", back) + "@" + domain

    def spans(self, text: str, back: bool = False) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, replacement) of the valid values, in order, without overlaps."""
        found = []
        if "@" in text:
            for m in _EMAIL.finditer(text):
                found.append((m.start(), m.end(), "email", self.value("email", m[0], back)))
        for m in _NUMBERS.finditer(text):
            kind = "phone" if m.lastgroup == "local" or m["local"] else next(k for k in ("phone", "date", "ip", "ssn", "card", "iban") if m[k])
            new = self.value(kind, m[0], back)
            if new is not None:
                found.append((m.start(), m.end(), kind, new))
        found.sort()
        out, end = [], 0
        for s in found:
            if s[0] >= end:
                out.append(s)
                end = s[1]
        return out

    def replace(self, text: str | None, back: bool = False) -> tuple[str | None, list]:
        if not text:
            return text, []
        spans, parts, end = self.spans(text, back), [], 0
        for start, stop, _, new in spans:
            parts += [text[end:start], new]
            end = stop
        return "".join([*parts, text[end:]]) if spans else text, spans


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_found, spans``: the text with valid personal values replaced; one row per input row.

    ``spans`` lists ``kind:start:end`` in the input's code points (end exclusive). Kinds: e-mail addresses, phone numbers,
    Luhn-valid card numbers, social security numbers, IBANs with valid check digits, IPv4 addresses and calendar dates
    of 1900 to 2099. Each is read as one value, permuted under the secret ``key`` and printed in the format it had: separators,
    lengths of digits, check digits and validity stay, and one value has one pseudonym in every document and format (a date in
    three orders, a card with and without separators, a phone number with and without its North American code). With the key, ``Pseudonyms.replace(text, back=True)``
    restores it. Values that fail validation stay. A permutation may keep a value of a tiny format as it is.

    A null text stays null with no spans. Nulls in other columns, repeated rows and empty tables pass through; other columns
    are not read. There is no shuffle.
    """
    if not key:
        raise ValueError("a secret key is needed")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    state: list[Pseudonyms] = []

    def run(batch):
        if not state:
            state.append(Pseudonyms(key))
        texts, spans = zip(*(state[0].replace(t) for t in batch["text"].to_pylist()), strict=True)
        return {
            "doc_id": batch["doc_id"],
            "text": texts,
            "n_found": [len(s) for s in spans],
            "spans": [",".join(f"{k}:{a}:{b}" for a, b, k, _ in s) for s in spans],
        }

    return batches(docs, run, f"doc_id {dict(docs.dtypes)['doc_id']}, text string, n_found long, spans string")
