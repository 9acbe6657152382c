"""Personal data replaced by format-preserving pseudonyms.

Validated numbers (cards, IBANs, social security numbers, telephone numbers, IPv4 addresses), dates and the local part
of mail addresses are found; each is mapped to its rank among the valid values of its format, the rank is permuted
under a key, and the new rank is written in the same format: separators, case, length of digit groups, check digits
and validity stay. The permutation is a ten-round Feistel network over the rank split in two parts, walked until it
falls in the domain; the pseudonym is the value whose permuted rank is the next one, so no value stands for itself.
Equal values get equal pseudonyms in all documents, different values different ones, and the key's holder can undo it.

Work is linear in the text. A local part is permuted in pieces of 64 characters (mail standards allow no more).

Edge cases: null texts stay null, empty ones empty; texts are read whole; rows are independent, so repeated rows and
ties need no rule; all other columns pass through as they are, whatever their names.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_names, small_batches, table

ROUNDS = 10
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """A keyed permutation of 0..n-1 without fixed points (n > 1)."""

    def __init__(self, key: bytes, tweak: str, n: int) -> None:
        self.n, self.a = n, isqrt(n - 1) + 1 if n > 1 else 1
        self.b = -(-n // self.a)
        self.wide = (max(self.a, self.b).bit_length() + 7) // 8 + 8
        key = key if len(key) <= 64 else hashlib.blake2b(key).digest()  # what the digest takes at most
        self.base = hashlib.blake2b(tweak.encode() + b"\0" + str(n).encode(), key=key).digest()

    def _round(self, r: int, x: int) -> int:
        own, k = b"", 0
        while len(own) < self.wide:
            own += hashlib.blake2b(b"%d,%d,%d" % (r, k, x), key=self.base).digest()
            k += 1
        return int.from_bytes(own[: self.wide], "big")

    def _once(self, x: int, back: bool) -> int:
        left, right = divmod(x, self.b)
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if r % 2:
                right = (right - self._round(r, left)) % self.b if back else (right + self._round(r, left)) % self.b
            else:
                left = (left - self._round(r, right)) % self.a if back else (left + self._round(r, right)) % self.a
        return left * self.b + right

    def _walk(self, x: int, back: bool) -> int:
        x = self._once(x, back)
        while x >= self.n:
            x = self._once(x, back)
        return x

    def encrypt(self, x: int) -> int:
        return self._walk((self._walk(x, False) + 1) % self.n, True)

    def decrypt(self, x: int) -> int:
        return self._walk((self._walk(x, False) - 1) % self.n, True)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _fill(shape: str, digits: Iterable[str]) -> str:
    """``shape`` with its digits replaced in order."""
    own = iter(digits)
    return "".join(next(own) if c in "0123456789" else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _rank_mixed(text: str) -> tuple[int, int]:
    """Rank and number of the strings with the same classes (digits, small and large letters) in the same places."""
    x, n = 0, 1
    for c in text:
        if c in "0123456789":
            x, n = x * 10 + ord(c) - 48, n * 10
        elif "a" <= c <= "z":
            x, n = x * 26 + ord(c) - 97, n * 26
        elif "A" <= c <= "Z":
            x, n = x * 26 + ord(c) - 65, n * 26
    return x, n


def _write_mixed(shape: str, x: int) -> str:
    out = []
    for c in reversed(shape):
        if c in "0123456789":
            x, v = divmod(x, 10)
            c = chr(48 + v)
        elif "a" <= c <= "z" or "A" <= c <= "Z":
            x, v = divmod(x, 26)
            c = chr((97 if c >= "a" else 65) + v)
        out.append(c)
    return "".join(reversed(out))


Map = Callable[[str, int, int], int]  # (domain's name, rank, size) -> new rank


def _card(m: re.Match, f: Map) -> str | None:
    d = _digits(m[0])
    if not 13 <= len(d) <= 19 or not luhn(d) or len(set(d)) == 1:
        return None
    body = f"{f(f'card{len(d)}', int(d[:-1]), 10 ** (len(d) - 1)):0{len(d) - 1}d}"
    return _fill(m[0], body + next(c for c in "0123456789" if luhn(body + c)))


def _ssn(m: re.Match, f: Map) -> str | None:
    a, g, s = int(m[1]), int(m[2]), int(m[3])
    if not 0 < a < 900 or a == 666 or not g or not s:
        return None
    x = ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1
    x, s = divmod(f("ssn", x, 898 * 99 * 9999), 9999)
    a, g = divmod(x, 99)
    return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"


def _phone(m: re.Match, f: Map) -> str | None:
    head, rest = m[1] or "", m[0][len(m[1] or "") :]
    d = _digits(rest)
    if not 7 <= len(d) <= 14:
        return None
    return head + _fill(rest, f"{f(f'phone{_digits(head)}.{len(d)}', int(d), 10 ** len(d)):0{len(d)}d}")


def _ip(m: re.Match, f: Map) -> str | None:
    parts = m[0].split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return None
    x = f("ip", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _date(m: re.Match, f: Map) -> str | None:
    if m["y1"]:
        order, sep, parts = "ymd", m["s1"], (m["y1"], m["m1"], m["d1"])
    else:
        order, sep, parts = ("dmy" if int(m["b"]) <= 12 else "mdy"), m["s2"], (m["a"], m["b"], m["y2"])
    own = dict(zip(order, map(int, parts)))
    try:
        day = datetime.date(own["y"], own["m"], own["d"]).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    while True:
        day = FIRST_DAY + f(f"date{order}", day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1)
        new = datetime.date.fromordinal(day)
        # Month first only where the day can't be a month; and what was written without zeros must be so again.
        text = sep.join(f"{getattr(new, {'y': 'year', 'm': 'month', 'd': 'day'}[k]):0{len(p) if len(p) != 1 else 1}d}" for k, p in zip(order, parts))
        if (order != "mdy" or new.day > 12) and len(text) == len(m[0]):
            return text


def _iban(m: re.Match, f: Map) -> str | None:
    value = m[0].replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(value) <= 34 or number(value[4:] + value[:4]) % 97 != 1:
        return None
    x, n = _rank_mixed(value[4:])
    body = _write_mixed(value[4:], f(f"iban{value[:2]}{re.sub('[A-Z]', 'A', re.sub('[0-9]', '9', value[4:]))}", x, n))
    new = value[:2] + f"{98 - number(body + value[:2] + '00') % 97:02d}" + body
    own = iter(new)
    return "".join(c if c == " " else next(own) for c in m[0])


#: Other characters of a local part, and how many characters of it are permuted together.
SIGNS, PIECE = "._%+-", 64


def _mail(m: re.Match, f: Map) -> str | None:
    out = []
    for at in range(0, len(m[1]), PIECE):
        own = m[1][at : at + PIECE]
        shape = re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", own)))
        x, n = _rank_mixed(own)
        if n > 1:
            out.append(_write_mixed(own, f(f"mail{at}.{shape}", x, n)))
            continue
        x, n = 0, len(SIGNS) ** len(own)  # nothing but signs, so these are permuted
        for c in own:
            x = x * len(SIGNS) + SIGNS.index(c)
        x, new = f(f"mail{at}.signs", x, n), []
        for _ in own:
            x, v = divmod(x, len(SIGNS))
            new.append(SIGNS[v])
        out.append("".join(reversed(new)))
    return "".join(out) + m[0][len(m[1]) :]


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: re.Pattern
    replace: Callable[[re.Match, Map], str | None]


KINDS = tuple(
    Kind(name, re.compile(pattern), replace)
    for name, pattern, replace in (
        ("mail", r"(?<![\w.%+-])([A-Za-z0-9._%+-]++)@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}+(?![\w-])", _mail),
        ("iban", r"(?<!\w)[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?!\w)", _iban),
        ("ip", r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])", _ip),
        ("date", r"(?<![\w./-])(?:(?P<y1>[0-9]{4})(?P<s1>[-/.])(?P<m1>[0-9]{1,2})(?P=s1)(?P<d1>[0-9]{1,2})|(?P<a>[0-9]{1,2})(?P<s2>[-/.])(?P<b>[0-9]{1,2})(?P=s2)(?P<y2>[0-9]{4}))(?!\w|[./-][0-9])", _date),
        ("ssn", r"(?<![\w-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?!\w|-[0-9])", _ssn),
        ("phone", r"(?<![\w+])(\+1)[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])", _phone),
        ("phone", r"(?<![\w+])(\+(?:[2-689][0-9]{1,2}|7))(?:[ .-]?\(?[0-9]{2,4}\)?){2,4}(?![0-9])", _phone),
        ("phone", r"(?<![\w+.-])()(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?!\w|-[0-9])", _phone),
        ("card", r"(?<!\w)(?<![0-9]\.)[0-9]{13,19}(?!\w)", _card),
        ("card", r"(?<!\w)[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?!\w)|(?<!\w)[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}(?!\w)", _card),
    )
)
_any = re.compile("[0-9@]")


class Pseudonyms:
    """All replacements under one key."""

    def __init__(self, key: bytes, kinds: tuple[Kind, ...] = KINDS) -> None:
        self.kinds = kinds
        self.network = lru_cache(100_000)(lambda name, n: Feistel(key, name, n))
        self.rank = lru_cache(200_000)(lambda name, x, n: self.network(name, n).encrypt(x))

    def replace(self, text: str | None) -> tuple[str | None, list[tuple[int, int, str]]]:
        """The new text, and (start, end, kind) of what was replaced, in the old text."""
        if not text or not _any.search(text):
            return text, []
        found: list[tuple[int, int, str, str]] = []
        taken = bytearray(len(text))  # 1 where something is replaced
        for kind in self.kinds:
            if kind.name == "mail" and "@" not in text:
                continue
            for m in kind.pattern.finditer(text):
                a, z = m.span()
                if taken.find(1, a, z) < 0:
                    new = kind.replace(m, self.rank)
                    if new is not None:
                        found.append((a, z, kind.name, new))
                        taken[a:z] = b"\1" * (z - a)
        found.sort()
        out, at = [], 0
        for a, z, _, new in found:
            out += [text[at:a], new]
            at = z
        return "".join([*out, text[at:]]), [x[:3] for x in found]


_made: dict[bytes, Pseudonyms] = {}
#: The setting that holds the secret key; the key used where it is unset is only for trying out.
KEY_SETTING, DEMO_KEY = "spark.chronotopia.pii.key", b"chronotopia demonstration key"


def key_of(spark: SparkSession) -> bytes:
    """The session's secret key; without one a demonstration key, with a warning, as its pseudonyms can be undone by anyone."""
    key = spark.conf.get(KEY_SETTING, None)
    if key is None:
        warnings.warn(f"{KEY_SETTING} is unset: pseudonyms under the demonstration key can be undone by anyone", stacklevel=2)
    return DEMO_KEY if key is None else key.encode()


@own_names("text", "n_chars")
def pseudonymize(docs: DataFrame, key: bytes, report: bool = False) -> DataFrame:
    """``docs`` with its text replaced (and n_chars, if there, recounted); with ``report`` also ``_pii``, what was found."""
    cols = docs.columns
    at = cols.index("text")

    def run(batches):
        own = _made.setdefault(key, Pseudonyms(key))
        for b in batches:
            new = [own.replace(t.as_py()) for t in b.column(at)]
            arrays = list(b.columns)
            arrays[at] = pa.array([t for t, _ in new], pa.string())
            names = list(cols)
            if report:
                arrays.append(pa.array([[k for *_, k in spans] for _, spans in new], pa.list_(pa.string())))
                names.append("_pii")
            yield pa.RecordBatch.from_arrays(arrays, names)

    kinds = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema)
    out = small_batches(docs).withColumn("text", F.col("text").cast("string")).mapInArrow(run, kinds + ", _pii array<string>" * report)
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms, and how many of each kind stand in it."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = pseudonymize(docs, key_of(spark), report=True)
    count = lambda kind: F.size(F.filter("_pii", lambda x: x == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", "text", *(count(k) for k in dict.fromkeys(k.name for k in KINDS)))
