"""Personal data: format-preserving pseudonyms by a keyed Feistel permutation.

Validated values are replaced by other valid values of the same format: a card number by one that passes the Luhn check, a
date by a date, an address by an address. The permutation depends on the key and the kind alone, so equal values get equal
pseudonyms in all documents, whatever their separators, and different values different ones. With the key `restore` gives
the values back. Texts without personal data stay as they are, to the character.
"""

from __future__ import annotations

import datetime
import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodetide.llm.common import prepare

ROUNDS = 8
#: Used where the caller names no key and the session sets no `nodetide.pii.key`.
TEST_KEY = "nodetide test key"
KINDS = ("email", "card", "phone", "ip", "iban", "ssn", "date")

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

LOCAL_CHARS = frozenset(LOWER + UPPER + DIGITS + "._%+-")
#: Characters of a local part that are permuted together.
LOCAL_PART = 64
DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
#: Characters of an IBAN by its country.
IBAN_LENGTHS = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for c in cs.split()}
#: Numbers with their separators. A time or a Z may follow a date.
NUMERIC = re.compile(
    r"(?<![A-Za-z0-9])(?<!\d\.)(?:"
    r"(?P<iban>[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
    r"|(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?!\.?\d|[A-Za-z])"
    r"|(?P<date>\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?!\d|(?![Tt]\d{2}:?\d{2}|[Zz](?![A-Za-z0-9]))[A-Za-z])"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?!-?\d|[A-Za-z])"
    r"|(?P<card>\d{4}(?P<sep>[\x20-]?)\d{4}(?P=sep)\d{4}(?P=sep)\d{1,7}|\d{4}(?P<sep2>[\x20-]?)\d{6}(?P=sep2)\d{5})(?!\d|[A-Za-z])"
    r"|(?P<phone>(?:\+?1[\x20.-]?)?\(\d{3}\)\x20?\d{3}[\x20.-]\d{4}|(?:\+?1[\x20.-])?\d{3}(?P<sep3>[.-])\d{3}(?P=sep3)\d{4}"
    r"|\+\d{1,3}[\x20.-]?\(?\d{1,4}\)?(?:[\x20.-]\d{2,4}){1,4}|\+\d{8,15})(?!\d|[A-Za-z])"
    r")", re.A)
RUN = re.compile(r"[A-Za-z0-9]+|.", re.S)


class Permutation:
    """A keyed permutation of 0 .. size - 1 for any size, by a balanced Feistel network and cycle walking."""

    def __init__(self, key: str, kind: str):
        self.seed = hashlib.sha256(f"{kind}\x00{key}".encode()).digest()

    def _round(self, size: int, half: int, number: int, value: int) -> int:
        width = (half + 7) // 8
        data = self.seed + number.to_bytes(1, "big") + size.to_bytes((size.bit_length() + 7) // 8, "big") + b"\x00" + value.to_bytes(width, "big")
        return int.from_bytes(hashlib.shake_256(data).digest(width), "big") & ((1 << half) - 1)

    def _step(self, value: int, size: int, back: bool) -> int:
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        left, right = value >> half, value & ((1 << half) - 1)
        if back:
            for i in reversed(range(ROUNDS)):
                left, right = right ^ self._round(size, half, i, left), left
        else:
            for i in range(ROUNDS):
                left, right = right, left ^ self._round(size, half, i, right)
        return left << half | right

    def apply(self, value: int, size: int, back: bool = False, fits=None) -> int:
        """The image of a value. With `fits`, values that fit are permuted among each other, and the others likewise."""
        wanted = fits is None or fits(value)
        while True:
            value = self._step(value, size, back)
            if value < size and (fits is None or fits(value) == wanted):
                return value


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _check_digit(payload: str) -> str:
    return next(d for d in DIGITS if luhn(payload + d))


def _refill(pattern: str, chars: str) -> str:
    """The letters and digits of `pattern` replaced in turn by `chars`."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in pattern)


class Pseudonyms:
    """Replaces the personal data of texts under a key; `back` restores them."""

    def __init__(self, key: str, back: bool = False):
        self.back = back
        self.of = {kind: Permutation(key, kind) for kind in (*KINDS, "domain")}
        self.known: dict[tuple[str, str], str | None] = {}

    def _classes(self, kind: str, text: str) -> str:
        """Each letter or digit becomes one of its class; the whole is one permuted number."""
        sets = [LOWER if c in LOWER else UPPER if c in UPPER else DIGITS if c in DIGITS else c for c in text]
        size, value = 1, 0
        for c, s in zip(text, sets):
            value, size = value * len(s) + s.index(c), size * len(s)
        if size < 2:
            return text
        value, out = self.of[kind].apply(value, size, self.back), []
        for s in reversed(sets):
            value, i = divmod(value, len(s))
            out.append(s[i])
        return "".join(reversed(out))

    def email(self, text: str) -> str | None:
        local, _, domain = text.rpartition("@")
        name, _, top = domain.rpartition(".")
        parts = [self._classes("email", local[i:i + LOCAL_PART]) for i in range(0, len(local), LOCAL_PART)]
        return f"{''.join(parts)}@{self._classes('domain', name)}.{top}"

    def card(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if not 13 <= len(digits) <= 19 or not luhn(digits) or not digits.strip("0"):
            return None
        size = 10 ** (len(digits) - 1)
        image = str(self.of["card"].apply(int(digits[:-1]), size, self.back, bool)).zfill(len(digits) - 1)
        return _refill(text, image + _check_digit(image))

    def phone(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if not 8 <= len(digits) <= 15:
            return None
        if len(digits) == 10 or len(digits) == 11 and digits[0] == "1":  # country code 1, written or not
            def valid(n: int) -> bool:
                return n // 10**9 >= 2 and n // 10**6 % 10 >= 2

            image = str(self.of["phone"].apply(int(digits[-10:]), 10**10, self.back, valid)).zfill(10)
        else:
            keep = 2  # the country's leading digits stay
            image = str(self.of["phone"].apply(int(digits[keep:]), 10 ** (len(digits) - keep), self.back)).zfill(len(digits) - keep)
        return _refill(text, digits[:len(digits) - len(image)] + image)

    def ip(self, text: str) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        value = self.of["ip"].apply(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, self.back)
        return ".".join(map(str, value.to_bytes(4, "big")))

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
            return None
        body = self._classes("iban", plain[4:])
        return _refill(text, plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02d}" + body)

    def own_iban(self, text: str) -> str | None:
        """The leading part of a match that has the length of its country and is valid: groups that follow are not of the number."""
        left = IBAN_LENGTHS.get(text[:2], 0)
        for end, c in enumerate(text, 1):
            left -= c != " "
            if left == 0:
                part = text[:end]
                return part if text[end:end + 1] in ("", " ") and self.value("iban", part) is not None else None
        return None

    def ssn(self, text: str) -> str | None:
        def valid(n: int) -> bool:
            area, group, serial = n // 10**6, n // 10**4 % 100, n % 10**4
            return 0 < area < 900 and area != 666 and group > 0 and serial > 0

        value = int(text.replace("-", ""))
        if not valid(value):
            return None
        return _refill(text, str(self.of["ssn"].apply(value, 10**9, self.back, valid)).zfill(9))

    def date(self, text: str) -> str | None:
        sep = "-" if "-" in text else "/" if "/" in text else "."
        parts = text.split(sep)
        try:
            if sep == "-":
                kind, day = "ymd", datetime.date(*map(int, parts))
            elif sep == "/" and int(parts[0]) <= 12:  # month first where that can be
                kind, day = "mdy", datetime.date(int(parts[2]), int(parts[0]), int(parts[1]))
            else:
                kind, day = "dmy", datetime.date(int(parts[2]), int(parts[1]), int(parts[0]))
        except ValueError:
            return None
        first = FIRST_DAY
        if not first <= day.toordinal() <= LAST_DAY:
            return None
        fits = (lambda n: datetime.date.fromordinal(n + first).day > 12) if kind == "dmy" and sep == "/" else None
        new = datetime.date.fromordinal(self.of["date"].apply(day.toordinal() - first, LAST_DAY - first + 1, self.back, fits) + first)
        width = 2 if len(text) == 10 else 1
        d, m, y = f"{new.day:0{width}d}", f"{new.month:0{width}d}", f"{new.year:04d}"
        return sep.join({"ymd": (y, m, d), "mdy": (m, d, y), "dmy": (d, m, y)}[kind])

    def value(self, kind: str, text: str) -> str | None:
        """The pseudonym of one value; None if it is not valid."""
        if (kind, text) not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[kind, text] = getattr(self, kind)(text)
        return self.known[kind, text]

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of all valid values, in order, without overlap."""
        found, at, after = [], text.find("@"), 0
        while at >= 0:
            domain, start = DOMAIN.match(text, at + 1), at
            if domain:
                while start > after and text[start - 1] in LOCAL_CHARS:
                    start -= 1
                while start < at and text[start] in ".%+-_":
                    start += 1
                if start < at and not (found and start < found[-1][1]):
                    found.append((start, domain.end(), "email", self.value("email", text[start:domain.end()])))
            at, after = text.find("@", at + 1), at + 1
        mails = found[:]
        at = 0
        while m := NUMERIC.search(text, at):
            kind = m.lastgroup if m.lastgroup in KINDS else next(k for k in KINDS[1:] if m[k] is not None)
            taken = kind == "iban" and self.own_iban(m[0]) or m[0]
            end = m.start() + len(taken)
            while mails and mails[0][1] <= m.start():
                mails.pop(0)
            if mails and mails[0][0] < end:
                at = max(mails[0][1], m.start() + 1)
                continue
            image = self.value(kind, taken)
            if image is None:  # not valid: what follows its first run of letters and digits may be
                at = RUN.match(text, m.start()).end()
            else:
                found.append((m.start(), end, kind, image))
                at = end
        return sorted(found)

    def replace(self, text: str | None) -> tuple[str | None, dict[str, int]]:
        """The text with pseudonyms, and how many values of each kind it had."""
        if not text or not ("@" in text or re.search(r"\d", text, re.A)):
            return text, {}
        out, at, counts = [], 0, {}
        for start, end, kind, image in self.spans(text):
            out += [text[at:start], image]
            at = end
            counts[kind] = counts.get(kind, 0) + 1
        return "".join([*out, text[at:]]), counts


def session_key(spark: SparkSession) -> str:
    return spark.conf.get("nodetide.pii.key", TEST_KEY)


def pseudonymised(text_col: str, key: str, back: bool = False) -> Column:
    """Struct of the text and the number of values of each kind."""
    schema = "text string, " + ", ".join(f"n_{k} int" for k in KINDS)

    @F.pandas_udf(schema)
    def run(texts: pd.Series) -> pd.DataFrame:
        worker = Pseudonyms(key, back)
        made = [worker.replace(t) for t in texts]
        return pd.DataFrame({"text": pd.Series([t for t, _ in made], dtype=object)} | {f"n_{k}": [c.get(k, 0) for _, c in made] for k in KINDS})

    return run(F.col(text_col))


def pseudonymise(docs: DataFrame, key: str | None = None, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """For every row its id, the text with pseudonyms, and n_<kind> for each kind of personal data.

    Null texts stay null, empty ones empty, both with counts of 0; repeated rows get the same text; further columns are
    left out; an empty table gives an empty result. Nothing is shuffled.
    """
    prepare(docs.sparkSession)
    key = key or session_key(docs.sparkSession)
    return docs.select(F.col(id_col), pseudonymised(text_col, key, back).alias("made")).select(id_col, "made.*")


def replaced(docs: DataFrame, key: str | None = None, text_col: str = "text") -> DataFrame:
    """The rows with their text under pseudonyms, all other columns as they are."""
    prepare(docs.sparkSession)
    key = key or session_key(docs.sparkSession)
    return docs.withColumn(text_col, pseudonymised(text_col, key)["text"])
