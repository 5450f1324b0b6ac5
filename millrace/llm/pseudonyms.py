"""Format-preserving pseudonyms for personal data in texts.

A value is found by its form, validated (checksum, calendar, ranges), ranked within the numbers or strings of
its format, sent through a keyed Feistel permutation of those ranks, and written back in the form it had. The
same value, in any spelling of its format, gets the same pseudonym in every document; different values never
meet. Forms may take in neighbouring numbers: at each place the shorter readings of a form and the other kinds are
tried too, and a reading gives way to one of better evidence that begins inside it. What fails validation stays as
it is. Whoever holds the key can invert the permutation.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from millrace.llm.permute import permute
from millrace.llm.words import per_text

KINDS = ["email", "secret", "iban", "card", "ip", "phone", "ssn", "date"]

_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
# What stands before, in and behind the values that may take in neighbours. A card may begin or end at a dash
# between digits, as its own groups do.
_IBAN = r"(?<![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?", r"(?![A-Za-z0-9])"
_CARD = r"(?<![0-9.+])(?<!(?<![0-9])-)", r"[0-9](?:[ -]?[0-9]){12,18}", r"(?![0-9]|\.[0-9])"
_PHONE = r"(?<![0-9A-Za-z+])", r"\+(?:[ .-]?\(?[0-9]\)?){8,15}", r"(?![0-9])"
_FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"""(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)["']?\s{0,3}[=:]\s{0,3}["']?)(?P<value>[A-Za-z0-9_+/=-]{16,})""",
    "iban": "".join(_IBAN),
    "card": "".join(_CARD),
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])|" + "".join(_PHONE),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}(?P<s>[-/.])[0-9]{1,2}(?P=s)[0-9]{1,2}|[0-9]{1,2}(?P<t>[-/.])[0-9]{1,2}(?P=t)[0-9]{4})(?![0-9]|[./-][0-9])"
            r"|(?i:(?<![0-9A-Za-z])[0-9]{1,2}[ ](?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]{0,6}[ ,]{1,2}[0-9]{4}(?![0-9]))",
}
_PATTERN = re.compile("|".join(f"(?P<{k}>{_FORMS[k]})" for k in KINDS))
_FORM = {k: re.compile(_FORMS[k]) for k in KINDS}
_SHORTER = {k: (re.compile(body), re.compile(tail)) for k, (_, body, tail) in {"iban": _IBAN, "card": _CARD, "phone": _PHONE}.items()}
# Characters behind a value within which one that begins inside it is looked for at first.
_MARGIN = 400
# How cards are grouped, and what their numbers begin with by length.
_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 5), (4, 4, 4, 4, 3), (6, 13)}
_NETWORK = re.compile("3[47][0-9]{13}|3[068][0-9]{12}|[4-6][0-9]{15}|2[2-7][0-9]{14}|[46][0-9]{18}|4[0-9]{12}")
# A text without any of these holds nothing that the pattern above could find.
_HINT = re.compile(r"@|[0-9][ .()/-]{0,2}[0-9]|[0-9] [A-Za-z]{3}|(?i:token|secret|passw|key)")
_DIGITS = re.compile(r"[^0-9]")

_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_HEX = "0123456789abcdef"
_ALPHABET = {c: a for a in (_LOWER, _UPPER, _DIGIT) for c in a}
_FIRST_DAY, _LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


def luhn_digit(payload: str) -> str:
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(payload))))
    return str(-total % 10)


def iban_checks(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in f"{rest}{country}00")
    return f"{98 - int(number) % 97:02d}"


def _rank(kind: str, value: str) -> int:
    """How little a valid value proves, from 0: checksums in a usual form, other strict forms, loose ones."""
    if kind != "card":
        return 0 if kind in ("email", "secret", "iban") else 2 if kind == "phone" else 1
    marks = set(value) & set(" -")
    if len(marks) > 1:
        return 3
    groups = tuple(map(len, re.split("[ -]", value)))
    return 2 if len(groups) > 1 and groups not in _GROUPS else 0 if _NETWORK.fullmatch(_DIGITS.sub("", value)) else 1


class Pseudonyms:
    """`replace(text)` -> (text, number of values replaced per kind)."""

    def __init__(self, key: str):
        self.keys = {k: hashlib.blake2b(key.encode(), person=k.encode()[:16], digest_size=32).digest() for k in [*KINDS, "host"]}
        self.seen: dict[tuple[str, str], str | None] = {}

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        found: dict[str, int] = {}
        if not _HINT.search(text):
            return text, found

        parts, at, start = [], 0, 0
        while m := _PATTERN.search(text, start):
            best = self._best(text, m.start())
            if best is None:
                start = m.start() + 1
                continue
            kind, end, new = best
            found[kind] = found.get(kind, 0) + 1
            parts += [text[at : m.start()], new]
            at = start = end
        return "".join([*parts, text[at:]]), found

    def _best(self, text: str, start: int) -> tuple[str, int, str] | None:
        """(kind, end, pseudonym) of the value that begins at `start`, if any: that of best evidence, then of the
        first kind, then the longest, unless one of better evidence begins inside it."""
        found = sorted(self._values(text, start), key=lambda x: (x[0], KINDS.index(x[1]), -x[2]))
        for rank, kind, end, new in found:
            if not rank or not self._better_inside(text, start, end, rank):
                return kind, end, new
        return None

    def _better_inside(self, text: str, start: int, end: int, rank: int) -> bool:
        at = start + 1
        while at < end and (m := _PATTERN.search(text, at, end + _MARGIN)) and m.start() < end:
            if any(x[0] < rank for x in self._values(text, m.start())):
                return True
            at = m.start() + 1
        return False

    def _values(self, text: str, start: int):
        """(rank of the evidence, kind, end, pseudonym) of all valid values that begin at `start`."""
        for kind in KINDS:
            if not (m := _FORM[kind].match(text, start)):
                continue
            ends = [m.end()]
            if kind in _SHORTER and (kind != "phone" or m[0][0] == "+"):
                body, tail = _SHORTER[kind]
                ends += [e for e in range(m.end() - 1, start + 8, -1) if tail.match(text, e) and body.fullmatch(text, start, e)]
            for end in ends:
                value = text[start:end]
                if (new := self._pseudonym(kind, value, m)) is not None:
                    yield _rank(kind, value), kind, end, new

    def _pseudonym(self, kind: str, value: str, m: re.Match) -> str | None:
        at = (kind, value)
        if at not in self.seen:
            if len(self.seen) > 200_000:  # only saves work; a value always maps to the same pseudonym
                self.seen.clear()
            self.seen[at] = self._secret(value, m["value"]) if kind == "secret" else getattr(self, f"_{kind}")(value)
        return self.seen[at]

    def _string(self, kind: str, value: str) -> str:
        """Permute letters and digits, each within its own class, among all strings of this form. Sixteen or
        more hexadecimal digits stay such."""
        rank, size, places = 0, 1, []
        hexadecimal = re.fullmatch("[0-9a-f]{16,}", value)
        for c in value:
            alphabet = _HEX if hexadecimal else _ALPHABET.get(c)
            places.append(alphabet)
            if alphabet:
                rank, size = rank * len(alphabet) + alphabet.index(c), size * len(alphabet)
        form = "hex" * bool(hexadecimal) + "".join("." if a is None else a[0] for a in places)
        out, rank = [], permute(rank, size, hashlib.blake2b(form.encode(), key=self.keys[kind], digest_size=32).digest()) if size > 1 else 0
        for c, alphabet in zip(reversed(value), reversed(places)):
            if alphabet:
                rank, i = divmod(rank, len(alphabet))
                c = alphabet[i]
            out.append(c)
        return "".join(reversed(out))

    def _number(self, kind: str, value: int, size: int, allowed=None) -> int:
        return permute(value, size, self.keys[kind], allowed)

    @staticmethod
    def _fill(form: str, digits: str) -> str:
        put = iter(digits)
        return "".join(next(put) if c.isdigit() else c for c in form)

    def _email(self, value: str) -> str:
        local, host = value.rsplit("@", 1)
        name, top = host.rsplit(".", 1)
        return f"{self._string('email', local)}@{self._string('host', name.lower())}.{top}"

    def _secret(self, whole: str, value: str) -> str | None:
        if not any(c.isdigit() for c in value):
            return None
        return whole[: len(whole) - len(value)] + self._string("secret", value)

    def _iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        country, checks, rest = plain[:2], plain[2:4], plain[4:]
        if not 15 <= len(plain) <= 34 or iban_checks(country, rest) != checks:
            return None
        new = self._string("iban", rest)
        put = iter(country + iban_checks(country, new) + new)
        return "".join(c if c == " " else next(put) for c in value)

    def _card(self, value: str) -> str | None:
        digits = _DIGITS.sub("", value)
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        # The first digit names the network and stays.
        size = 10 ** (len(digits) - 2)
        new = f"{digits[0]}{self._number('card', int(digits[1:-1]), size):0{len(digits) - 2}d}"
        return self._fill(value, new + luhn_digit(new))

    def _ip(self, value: str) -> str | None:
        parts = [int(p) for p in value.split(".")]
        if max(parts) > 255 or not parts[0]:
            return None
        new = self._number("ip", int.from_bytes(bytes(parts), "big"), 1 << 32, lambda x: x >> 24)
        return ".".join(str(b) for b in new.to_bytes(4, "big"))

    def _phone(self, value: str) -> str | None:
        digits = _DIGITS.sub("", value)
        if value.startswith("+") and not (digits[0] == "1" and len(digits) == 11):
            if not 8 <= len(digits) <= 15:
                return None
            # The country's digits (two at most are told apart here) stay.
            return self._fill(value, digits[:2] + f"{self._number('phone', int(digits[2:]), 10 ** (len(digits) - 2)):0{len(digits) - 2}d}")
        country, national = digits[:-10], digits[-10:]
        if len(national) != 10 or country not in ("", "1"):
            return None
        return self._fill(value, country + f"{self._number('phone', int(national), 10**10):010d}")

    def _ssn(self, value: str) -> str | None:
        valid = lambda x: x // 10**6 not in (0, 666) and x // 10**6 < 900 and x // 10**4 % 100 and x % 10**4
        digits = int(_DIGITS.sub("", value))
        return self._fill(value, f"{self._number('ssn', digits, 10**9, valid):09d}") if valid(digits) else None

    def _date(self, value: str) -> str | None:
        parts = re.findall(r"[0-9]+|[A-Za-z]+", value)
        word = next((p for p in parts if p.isalpha()), None)
        numbers = [_MONTHS.index(p[:3].lower()) + 1 if p.isalpha() else int(p) for p in parts]
        year_first = len(parts[0]) == 4
        year, month, day = numbers if year_first else numbers[::-1]
        swapped = not year_first and word is None and "/" in value and month > 12 >= day  # month first
        if swapped:
            month, day = day, month
        try:
            ordinal = dt.date(year, month, day).toordinal()
        except ValueError:
            return None
        if not _FIRST_DAY <= ordinal <= _LAST_DAY:
            return None
        # Days over 12 are permuted among themselves: only they may stand behind the month, so what is written
        # month first is read so again, and no other date is written like it.
        late = day > 12
        new = dt.date.fromordinal(_FIRST_DAY + self._number(
            "date", ordinal - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, lambda x: (dt.date.fromordinal(_FIRST_DAY + x).day > 12) == late))
        month, day = (new.day, new.month) if swapped else (new.month, new.day)
        order = [new.year, month, day] if year_first else [day, month, new.year]
        short = 1 if any(len(p) == 1 for p in parts) else 2  # 1/2/2000 is written without zeros
        put = iter(_month_like(word, n) if p.isalpha() else f"{n:0{short if len(p) < 4 else 4}d}" for p, n in zip(parts, order))
        return re.sub(r"[0-9]+|[A-Za-z]+", lambda _: next(put), value)


_FULL = "january february march april may june july august september october november december".split()


def _month_like(word: str, month: int) -> str:
    out = _FULL[month - 1] if len(word) > 3 else _MONTHS[month - 1]
    return out.upper() if word.isupper() and len(word) > 1 else out.title() if word[0].isupper() else out


FIELDS = [T.StructField("text", T.StringType()), T.StructField("n_replaced", T.LongType()),
          *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS)]


class _Replace:
    def __init__(self, key: str):
        self.pseudonyms = Pseudonyms(key)

    def __call__(self, column):
        texts, counts = [], []
        for text in column.to_pylist():
            new, found = (None, {}) if text is None else self.pseudonyms.replace(text)
            texts.append(new)
            counts.append(found)
        return [pa.array(texts, pa.string()), pa.array([sum(c.values()) for c in counts], pa.int64()),
                *(pa.array([c.get(k, 0) for c in counts], pa.int64()) for k in KINDS)]


def pseudonymise(docs: DataFrame, name: str, key: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` with a struct column `name`: the new `text` (null for null), n_replaced, and a count per kind.

    Row by row, so repeated rows get the same text, and an empty table an empty one. Values are linked across
    documents by the key alone; nothing is gathered. Empty texts stay empty; other columns, whatever their names,
    are left alone.
    """
    return per_text(docs, text, _Replace(key), FIELDS, name, keep=keep)
