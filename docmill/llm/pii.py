"""Private data to pseudonyms of the same format, by keyed Feistel permutations."""

from __future__ import annotations

import hashlib
import re
import secrets
from bisect import bisect, insort
from collections.abc import Callable, Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import free_name, pick

ROUNDS = 8
_DAY0, _DAYS = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1900, 1, 1).toordinal()
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Feistel:
    """A keyed permutation of 0 .. size-1: an alternating Feistel network, walked along its cycle into the domain.

    Every round adds a keyed hash of one half to the other half, modulo the other half's size, so that the network
    permutes left * right >= size numbers; numbers that land outside the domain are sent through again.
    """

    def __init__(self, key: bytes):
        self.key, self.seen = key, {}

    def _round(self, tweak: bytes, n: int, half: int) -> int:
        h = hashlib.blake2b(b"%b|%d|%d" % (tweak, n, half), key=self.key, digest_size=32)
        return int.from_bytes(h.digest(), "big")

    def permute(self, tweak: str, size: int, value: int, valid: Callable[[int], bool] = lambda x: True) -> int:
        """The image of value; with `valid`, a permutation of the valid numbers."""
        if (done := self.seen.get((tweak, size, value))) is not None:
            return done
        left = 1 << ((size - 1).bit_length() + 1) // 2
        right = -(-size // left)
        x, t = value, tweak.encode()
        while True:
            a, b = divmod(x, right)
            for n in range(0, ROUNDS, 2):
                a = (a + self._round(t, n, b)) % left
                b = (b + self._round(t, n + 1, a)) % right
            x = a * right + b
            if x < size and valid(x):
                break
        if len(self.seen) > 100_000:
            self.seen.clear()
        self.seen[tweak, size, value] = x
        return x

    def characters(self, tweak: str, text: str) -> str:
        """Digits to digits, a-z to a-z, A-Z to A-Z; other characters stay."""
        sizes = [10 if c in _DIGITS else 26 if c in _LOWER or c in _UPPER else 1 for c in text]
        shape = "".join("9" if c in _DIGITS else "a" if c in _LOWER else "A" if c in _UPPER else c for c in text)
        x, size = 0, 1
        for c, n in zip(text, sizes, strict=True):
            x = x * n + (0 if n == 1 else (_DIGITS if n == 10 else _LOWER if c in _LOWER else _UPPER).index(c))
            size *= n
        y, out = self.permute(f"{tweak}|{shape}", size, x), []
        for c, n in zip(reversed(text), reversed(sizes), strict=True):
            y, k = divmod(y, n)
            out.append(c if n == 1 else (_DIGITS if n == 10 else _LOWER if c in _LOWER else _UPPER)[k])
        return "".join(reversed(out))


def _fill(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c in _DIGITS else c for c in shape)


def _only(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def luhn(payload: str) -> str:
    """The check digit after a payload."""
    doubled = (int(c) * (2 if i % 2 == 0 else 1) for i, c in enumerate(reversed(payload)))
    return str(-sum(d - 9 if d > 9 else d for d in doubled) % 10)


def _issued(payload: int, digits: int) -> bool:
    """Whether payment cards are issued with these first digits: 3 to 6, and 2221 to 2720."""
    head = payload // 10 ** (digits - 4)
    return 3000 <= head < 7000 or 2221 <= head <= 2720


def _card(f: Feistel, text: str) -> str | None:
    d = _only(text)
    n = len(d) - 1
    if not 13 <= len(d) <= 19 or luhn(d[:-1]) != d[-1] or not _issued(int(d[:-1]), n):
        return None
    payload = str(f.permute(f"card{n}", 10**n, int(d[:-1]), lambda x: _issued(x, n))).zfill(n)
    return _fill(text, payload + luhn(payload))


def _cards(f: Feistel, text: str, run: tuple[int, int], free: Callable[[int, int], bool]) -> Iterator[tuple[int, int, str]]:
    """(start, end, pseudonym) of the cards in a run of digit groups.

    The longest stretch of groups comes first, in any grouping; where it is no card, shorter ones and those that begin at
    later groups are tried, as long as all groups but the last have four digits or more, as cards have and phones have not.
    """
    groups = [g.span() for g in _GROUP.finditer(text, *run)]
    sizes, last = [b - a for a, b in groups], len(groups) - 1
    i = fresh = 0
    while i <= last:
        ends, digits, begins = [], 0, _BEGIN.match(text, groups[i][0]) is not None
        for j in range(i, last + 1):
            if (digits := digits + sizes[j]) > 19:
                break
            if digits >= 13 and (j < last or _END.match(text, groups[j][1])):
                ends.append(j)
        whole = next((j for j in reversed(ends) if begins and _END.match(text, groups[j][1])), None) if i == fresh else None
        if i == fresh:
            fresh = i + 1 if whole is None else whole + 1
        tries = [j for j in reversed(ends) if j != whole and (i or begins) and all(n >= 4 for n in sizes[i:j])]
        for j in tries if whole is None else [whole, *tries]:
            a, b = groups[i][0], groups[j][1]
            if free(a, b) and (new := _card(f, text[a:b])) is not None:
                yield a, b, new
                i = fresh = j + 1
                break
        else:
            i += 1


def _phone(f: Feistel, text: str) -> str | None:
    d = _only(text)
    country, national = d[:-10], d[-10:]
    if len(d) not in (10, 11) or country not in ("", "1"):
        return None
    kind = lambda x: (x // 10**9 >= 2, x // 10**6 % 10 >= 2)  # noqa: E731  whether area code and exchange begin with 2 to 9
    area, exchange = own = kind(int(national))
    tweak = f"phone{exchange}" if area else f"phone0{exchange}"
    return _fill(text, country + str(f.permute(tweak, 10**10, int(national), lambda x: kind(x) == own)).zfill(10))


def _ssn(f: Feistel, text: str) -> str | None:
    valid = lambda x: x // 10**6 not in (0, 666) and x // 10**6 < 900 and x // 10**4 % 100 > 0 and x % 10**4 > 0
    x = int(_only(text))
    return _fill(text, str(f.permute("ssn", 10**9, x, valid)).zfill(9)) if valid(x) else None


#: Blocks of first octets that keep to themselves: this network, loopback, multicast, reserved.
_SPECIAL = ((0, 1), (127, 128), (224, 240), (240, 256))
#: The one address that is the same machine for everybody.
_LOCALHOST = 127 << 24 | 1


def _ip(f: Feistel, text: str) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if any(p > 255 for p in parts) or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
        return None
    if (x := int.from_bytes(bytes(parts), "big")) == _LOCALHOST:
        return None
    if (block := next(((a, b) for a, b in _SPECIAL if a <= parts[0] < b), None)) is None:
        x = f.permute("ipv4", 2**32, x, lambda v: not any(a <= v >> 24 < b for a, b in _SPECIAL))
    else:
        low, high = block[0] << 24, block[1] << 24
        x = low + f.permute(f"ipv4/{block[0]}", high - low, x - low, lambda v: v + low != _LOCALHOST)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _iban(f: Feistel, text: str) -> str | None:
    compact = text.replace(" ", "")
    check = lambda country, rest: 98 - int("".join(str(int(c, 36)) for c in f"{rest}{country}00")) % 97
    country, digits, rest = compact[:2], compact[2:4], compact[4:]
    if not 15 <= len(compact) <= 34 or f"{check(country, rest):02d}" != digits:
        return None
    rest = f.characters(f"iban{country}", rest)
    new = iter(f"{country}{check(country, rest):02d}{rest}")
    return "".join(c if c == " " else next(new) for c in text)


def _date(f: Feistel, text: str) -> str | None:
    a, sep1, b, sep2, c = re.match(r"(\d+)(\D)(\d+)(\D)(\d+)", text).groups()
    year_first = len(a) == 4
    if sep1 != sep2 or len(a if year_first else c) != 4:
        return None
    month_first = not year_first and sep1 == "/" and int(a) <= 12
    y, m, d = (a, b, c) if year_first else (c, a, b) if month_first else (c, b, a)
    try:
        day = date(int(y), int(m), int(d)).toordinal() - _DAY0
    except ValueError:
        return None
    if not 0 <= day < _DAYS:
        return None
    new = date.fromordinal(f.permute("date", _DAYS, day) + _DAY0)
    put = lambda v, old: str(v).zfill(len(old)) if len(old) != 1 else str(v)
    y, m, d = put(new.year, y), put(new.month, m), put(new.day, d)
    return sep1.join((y, m, d) if year_first else (m, d, y) if month_first else (d, m, y))


def _email(f: Feistel, text: str) -> str | None:
    """The local part and the first label of the domain change together; what follows stays."""
    local, _, domain = text.partition("@")
    label, dot, rest = domain.partition(".")
    return f.characters("email", f"{local}@{label}") + dot + rest


def _secret(f: Feistel, text: str) -> str | None:
    head = re.match(r"AKIA|(?:sk|pk|gh[pousr]|xox[abprs])[-_]|[A-Za-z_]+\s*[=:]\s*[\"']?", text)
    at = head.end() if head else 0
    body = text[at:]
    if re.fullmatch(r"[0-9a-f]{8,}", body):
        n = len(body)
        return text[:at] + f"{f.permute(f'hex{n}', 16**n, int(body, 16)):0{n}x}"
    return text[:at] + f.characters("secret", body)


_B, _E = r"(?<![\w.@+\-])", r"(?![\w\-]|\.\d)"
_BEGIN, _END, _GROUP = re.compile(_B, re.ASCII), re.compile(_E, re.ASCII), re.compile(r"\d+", re.ASCII)
#: What is looked for, in the order in which overlapping finds win; each find is validated before it is changed.
KINDS: dict[str, tuple[str, Callable[[Feistel, str], str | None]]] = {
    "email": (r"(?<![\w.+\-])[A-Za-z0-9][\w.+\-]*+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,24}", _email),
    "secret": (r"(?<!\w)AKIA[0-9A-Z]{16}(?!\w)|(?<!\w)(?:sk|pk|gh[pousr]|xox[abprs])[-_][A-Za-z0-9_\-]{16,}|(?i:(?<![A-Za-z])(?:password|passwd|pwd|secret|token|api_?key)\s*[=:]\s*[\"']?)(?=[A-Za-z_\-]*\d)[A-Za-z0-9_\-]{8,}", _secret),
    "iban": (_B + r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)", _iban),
    "date": (_B + r"(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})" + _E, _date),
    "ip": (_B + r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}" + _E, _ip),
    "ssn": (_B + r"\d{3}-\d{2}-\d{4}" + _E, _ssn),
    "card": (r"\d(?:[ \-]?\d){12,}", _card),
    "phone": (r"(?<![\w.@\-])(?:\+?1[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}" + _E, _phone),
}
_CHANCE = re.compile(r"\d[\d ()./\-]{4,}\d|\w@\w|AKIA|[0-9a-f]{8}|[A-Z]{2}\d{2}|[=:]|(?:sk|pk|gh.|xox.)[-_]")


class Pseudonymiser:
    """Replaces private data of a text; equal values get equal pseudonyms wherever they stand, under one key."""

    def __init__(self, key: bytes):
        self.feistel = Feistel(hashlib.sha256(key).digest())
        self.patterns = [(kind, re.compile(p, re.ASCII), change) for kind, (p, change) in KINDS.items()]

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of what is found, in order and without overlaps."""
        found: list[tuple[int, int, str, str]] = []  # in order
        if not _CHANCE.search(text):
            return found

        def free(start: int, end: int) -> bool:
            i = bisect(found, (start,))
            return (i == 0 or found[i - 1][1] <= start) and (i == len(found) or end <= found[i][0])

        for kind, pattern, change in self.patterns:
            for m in pattern.finditer(text):
                if kind == "card":
                    for a, b, new in _cards(self.feistel, text, m.span(), free):
                        insort(found, (a, b, kind, new))
                elif free(m.start(), m.end()) and (new := change(self.feistel, m[0])) is not None:
                    insort(found, (m.start(), m.end(), kind, new))
        return found

    def __call__(self, text: str) -> tuple[str, list[tuple[int, int, str, str]]]:
        spans, out, at = self.spans(text), [], 0
        for a, b, _, new in spans:
            out += text[at:a], new
            at = b
        return ("".join([*out, text[at:]]) if spans else text), spans


def key_of(spark: SparkSession) -> str:
    """The session's spark.docmill.pii.secretKey; without one a fresh key, under which values stay linked within this
    call's result and which nobody has afterwards. Whoever has a key can undo its pseudonyms: it belongs in no source."""
    return spark.conf.get("spark.docmill.pii.secretKey", None) or secrets.token_hex(32)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with private data in text_col replaced; all other columns as they are, plus `pii` spans of the old text.

    pii: array of (start, end, kind) in code points, in order. A value that passes its kind's checks (Luhn, IBAN check
    digits, issuers of cards, calendar, number plan, octets) is permuted among the values that pass them, in its own punctuation. A
    permutation may leave a value where it is, at odds of one to the number of values of its format.
    Narrow map: no shuffle, a row at a time. Null texts stay null with pii null; empty texts stay empty with pii empty.
    Where docs has a column pii, ours is called pii_.
    """
    name = free_name(docs, "pii")
    span = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("kind", StringType())])
    schema = StructType([*docs.schema.fields, StructField(name, ArrayType(span))])
    kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = Pseudonymiser(key.encode())
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            done = [(None, None) if t is None else change(t) for t in batch.column(at).to_pylist()]
            spans = pa.array([None if s is None else [{"start": a, "end": b, "kind": k} for a, b, k, _ in s] for _, s in done], kinds)
            columns = [pa.array([t for t, _ in done], pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, spans], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame, key: str) -> DataFrame:
    """Only id, new text and spans."""
    return pseudonymise(pick(docs, doc_id="doc_id", text="text"), key)
