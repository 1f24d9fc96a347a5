"""Private numbers, dates and addresses replaced by pseudonyms of the same format."""

from __future__ import annotations

import bisect
import datetime as dt
import hashlib
import re
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.common import arrays, nonempty, strings

ROUNDS = 8
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1), dt.date(2099, 12, 31)

# Calendar names, and the value of a letter in an IBAN is its place plus 10.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september",
          "october", "november", "december"]


class Feistel:
    """A keyed permutation of the numbers below any size, and its inverse.

    A number below ``size`` is written as two digits of mixed radix; in turn, each digit is shifted by
    a keyed hash of the other. Results from ``size`` on are permuted again until one is below it.
    """

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = hashlib.sha256(key).digest(), rounds

    def _shift(self, tweak: str, k: int, other: int) -> int:
        text = f"{tweak}|{k}|{other}".encode()
        return int.from_bytes(hashlib.blake2b(text, key=self.key, digest_size=32).digest(), "big")

    @staticmethod
    def _radix(size: int) -> tuple[int, int]:
        a = max(1, isqrt(size - 1) + 1)
        return a, -(-size // a)

    def forward(self, value: int, size: int, tweak: str) -> int:
        a, b = self._radix(size)
        while True:
            left, right = divmod(value, b)
            for k in range(self.rounds):
                if k % 2:
                    right = (right + self._shift(tweak, k, left)) % b
                else:
                    left = (left + self._shift(tweak, k, right)) % a
            value = left * b + right
            if value < size:
                return value

    def backward(self, value: int, size: int, tweak: str) -> int:
        a, b = self._radix(size)
        while True:
            left, right = divmod(value, b)
            for k in reversed(range(self.rounds)):
                if k % 2:
                    right = (right - self._shift(tweak, k, left)) % b
                else:
                    left = (left - self._shift(tweak, k, right)) % a
            value = left * b + right
            if value < size:
                return value


def _classes(text: str) -> list[str]:
    """Per character the characters that may stand in its place; one alone stays as it is."""
    digits, lower = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    return [digits if c in digits else lower if c in lower else lower.upper() if c in lower.upper() else c
            for c in text]


def _by_class(text: str, move) -> str:
    """The text as a number of mixed radix, moved within all texts of its format."""
    value, size, classes = 0, 1, _classes(text)
    for c, among in zip(text, classes, strict=True):
        value = value * len(among) + among.index(c)
        size *= len(among)
    value = move(value, size)
    out = []
    for among in reversed(classes):
        value, at = divmod(value, len(among))
        out.append(among[at])
    return "".join(reversed(out))


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _refill(shape: str, digits: str) -> str:
    """The shape with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in shape)


def luhn_digit(head: str) -> str:
    total = 0
    for k, c in enumerate(reversed(head)):
        n = int(c) * (2 if k % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


def iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


# ---- one function per kind: None if the value is not valid, else its pseudonym ----

def card(text: str, move):
    digits = _digits(text)
    if not 13 <= len(digits) <= 19 or digits[0] not in "23456" or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    middle = digits[1:-1]
    head = digits[0] + str(move(int(middle), 10 ** len(middle), "card")).zfill(len(middle))
    return _refill(text, head + luhn_digit(head))


def ssn(text: str, move):
    area, group, serial = text[:3], text[4:6], text[7:]
    if area in ("000", "666") or area >= "900" or group == "00" or serial == "0000":
        return None
    areas = [n for n in range(1, 900) if n != 666]
    value = (areas.index(int(area)) * 99 + int(group) - 1) * 9999 + int(serial) - 1
    value, serial = divmod(move(value, len(areas) * 99 * 9999, "ssn"), 9999)
    area, group = divmod(value, 99)
    return f"{areas[area]:03d}{text[3]}{group + 1:02d}{text[6]}{serial + 1:04d}"


def phone(text: str, move):
    """North American numbers, the same with and without +1; numbers of other countries keep theirs."""
    digits = _digits(text)
    country, own = ("1", digits[-10:]) if len(digits) == 10 or (len(digits) == 11 and digits[0] == "1") else ("", digits)
    if country:
        if own[0] not in "23456789" or own[3] not in "23456789":
            return None
        value = ((int(own[:3]) - 200) * 800 + int(own[3:6]) - 200) * 10_000 + int(own[6:])
        value, line = divmod(move(value, 800 * 800 * 10_000, "phone"), 10_000)
        area, office = divmod(value, 800)
        return _refill(text, digits[:-10] + f"{area + 200}{office + 200}{line:04d}")
    code = _digits(re.match(r"\+\d{1,3}", text).group()) if text.startswith("+") else ""
    rest = digits[len(code):]
    if not code or not 7 <= len(rest) <= 12:
        return None
    return _refill(text, code + str(move(int(rest), 10 ** len(rest), f"phone{code}")).zfill(len(rest)))


def address(text: str, move):
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = move(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


def iban(text: str, move):
    compact = text.replace(" ", "")
    country, check, account = compact[:2], compact[2:4], compact[4:]
    if not 15 <= len(compact) <= 34 or iban_check(country, account) != check:
        return None
    account = _by_class(account, lambda v, n: move(v, n, f"iban{country}"))
    new = iter(country + iban_check(country, account) + account)
    return "".join(c if c == " " else next(new) for c in text)


def email(text: str, move):
    """The name before the @ is permuted; the same name in capitals stays linked."""
    name, _, domain = text.rpartition("@")
    small = _by_class(name.lower(), lambda v, n: move(v, n, f"email{domain.lower()}"))
    return "".join(s.upper() if c.isupper() else s for c, s in zip(name, small, strict=True)) + "@" + domain


def secret(text: str, move):
    """Keys keep their known prefix; hexadecimal values stay hexadecimal."""
    if re.fullmatch("[0-9a-f]+", text):
        return f"{move(int(text, 16), 16 ** len(text), 'secret'):0{len(text)}x}"
    head = "AKIA" if text.startswith("AKIA") else ""
    return head + _by_class(text[len(head):], lambda v, n: move(v, n, "secret"))


def _day(year: int, month: int, day: int) -> int | None:
    try:
        return (dt.date(year, month, day) - FIRST_DAY).days
    except ValueError:
        return None


def date(text: str, move):
    """Calendar days from 1900 to 2099. Whether day or month comes first is told by which is a month;
    where both are, a dot means the day and a slash the month."""
    fields = re.findall(r"\d+|[^\W\d_]+", text)
    days = (LAST_DAY - FIRST_DAY).days + 1
    if len(fields[0]) == 4:
        order = "ymd"
    elif not fields[0].isdigit():
        order = "mdy"
    elif not fields[1].isdigit():
        order = "dmy"
    else:
        a, b = int(fields[0]), int(fields[1])
        order = "dmy" if b <= 12 and (a > 12 or "." in text) else "mdy"
    value = {}
    for kind, field in zip(order, fields, strict=True):
        named = [k + 1 for k, m in enumerate(MONTHS) if m.startswith(field.lower())]
        if not field.isdigit() and not named:
            return None
        value[kind] = int(field) if field.isdigit() else named[0]
    at = _day(value["y"], value["m"], value["d"])
    if at is None or not 0 <= at < days:
        return None
    new = FIRST_DAY + dt.timedelta(days=move(at, days, "date"))
    out = iter(order)

    def put(match: re.Match) -> str:
        kind, field = next(out), match.group()
        if not field.isdigit():
            name = MONTHS[new.month - 1].capitalize()
            return name if len(field) > 3 or field.lower() == "may" else name[:3]
        number = {"y": new.year, "m": new.month, "d": new.day}[kind]
        return str(number).zfill(len(field) if field[0] == "0" or len(field) > 1 else 1)

    return re.sub(r"\d+|[^\W\d_]+", put, text)


_NAMES = "|".join(m[:3] + "(?:" + m[3:] + ")?" if m[3:] else m for m in MONTHS)
#: Kinds in the order in which they are tried at a place, with what a value looks like.
KINDS = {
    "secret": (r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
               r"|(?<=password=)[^\s\"';,]{6,}?(?=[.,;]?(?:\s|$))|(?<=token = \")[^\"\s]{8,}(?=\")", secret),
    "email": (r"(?<![\w.+%-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9-])", email),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban),
    "date": (r"(?<![\d./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4}"
             r"|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-]|\.\d)"
             rf"|\b(?ia:\d{{1,2}} (?:{_NAMES}),? \d{{4}}|(?:{_NAMES}) \d{{1,2}},? \d{{4}})\b", date),
    "ip": (r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)", address),
    "ssn": (r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", ssn),
    "card": (r"(?<![\d-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-])", card),
    "phone": (r"(?<![\w+])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
              r"|(?<!\w)\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\d)", phone),
}
_FINDERS = [(kind, re.compile(pattern), change) for kind, (pattern, change) in KINDS.items()]
_ANY = re.compile(r"\d|@|password=|token = ")


def pseudonymize(text: str | None, moves: Feistel, back: bool = False) -> tuple[str | None, list[str]]:
    """The text with pseudonyms, and the kinds found in order. ``back`` undoes the permutation."""
    if not text or _ANY.search(text) is None:
        return text, []
    move = moves.backward if back else moves.forward
    taken: list[tuple[int, int, str, str]] = []  # sorted, none over another
    for kind, finder, change in _FINDERS:
        for match in finder.finditer(text):
            begin, end = match.span()
            at = bisect.bisect_left(taken, (begin,))
            if (at < len(taken) and taken[at][0] < end) or (at and taken[at - 1][1] > begin):
                continue
            new = change(match.group(), move)
            if new is not None:
                taken.insert(at, (begin, end, kind, new))
    out, last = [], 0
    for begin, end, _, new in taken:
        out += [text[last:begin], new]
        last = end
    return "".join([*out, text[last:]]), [k for _, _, k, _ in taken]


def pseudonyms(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, kinds, n_private): whole texts with private values replaced.

    Values that are valid for their kind (check digits, ranges, calendar days) are permuted by a keyed
    Feistel network within the values of their format, so the same value has the same pseudonym in
    all documents, whatever its punctuation, and different values keep apart. Other text stays as it is. With the
    key the change can be undone (of dates, the day; their zero padding may differ). No shuffle; nothing is shared between rows.

    Null and empty texts stay as they are; null ids stay null; equal rows come out once each; columns
    other than doc_id and text are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("kinds", pa.list_(pa.string())),
                        ("n_private", pa.int64())])

    def run(batches):
        moves = Feistel(key)
        for batch in nonempty(batches):
            done = [pseudonymize(t, moves) for t in strings(batch, "text")]
            yield arrays(schema, {"doc_id": batch.column("doc_id"), "text": [t for t, _ in done],
                                  "kinds": [k for _, k in done], "n_private": [len(k) for _, k in done]})

    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    return rows.mapInArrow(run, "doc_id bigint, text string, kinds array<string>, n_private bigint")
