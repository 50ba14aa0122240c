"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

E-mail addresses, telephone numbers, payment cards, IBANs, US social security numbers, IPv4 addresses and dates are
found by pattern and validated where their kind has a rule (check digits, ranges, the calendar). Each is numbered within
all values of its format, the number is permuted by a Feistel network keyed for that format, and the result is
written in the same format, with valid check digits. Equal values get equal pseudonyms in every document; without the
key they can't be undone.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.shared import lean
from folium.llm.wordbytes import chunks

ROUNDS = 8
# Names of months in English, French, German and Spanish, by language and in order.
MONTHS = (
    "january february march april may june july august september october november december".split(),
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "januar februar märz april mai juni juli august september oktober november dezember".split(),
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
)
_MONTH = "|".join(sorted({m for names in MONTHS for m in names}, key=len, reverse=True))
KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date")
PATTERN = re.compile(
    r"(?P<email>(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}(?![\w-]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?!\w))"
    r"|(?P<date>(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4}"
    rf"|\d{{1,2}}(?:\.|st|nd|rd|th)?\x20(?:(?:de|of)\x20)?(?i:{_MONTH})\x20(?:de\x20)?\d{{4}}|(?i:{_MONTH})\x20\d{{1,2}}(?:st|nd|rd|th)?,?\x20\d{{4}})(?![\w/-]|\.\d))"
    r"|(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.+-])\d(?:[\x20-]?\d){12,18}(?![\w-]|\.\d))"
    r"|(?P<phone>(?<![\w.+])(?:\+\d(?:[\x20.-]?\d){7,14}|0\d{1,4}/\d{5,8}|[2-9]\d{2}[2-9]\d{6}(?!\d)|(?:\+\d{1,3}[\x20.-]?)?(?:\(\d{2,4}\)[\x20.-]?|\d{2,4}[\x20.-])\d{2,4}(?:[\x20.-]?\d{2,4}){1,3})(?![\w-]|\.\d))"
)
#: Country codes of one and two digits; the others have three.
CODE = re.compile(r"(\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}|\d{1,2}(?!\d))[\x20.-]?)?")
FIRST, LAST = datetime.date(1800, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def permute(x: int, size: int, key: bytes, kind: str) -> int:
    """A permutation of 0 .. size - 1 that depends on key and kind: Feistel over pairs of digits of base ceil(sqrt(size)),
    repeated until the result is below size. About one x in `size` is left as it is."""
    if size < 2:
        return x
    base = math.isqrt(size - 1) + 1
    width = (base.bit_length() + 7) // 8
    while True:
        a, b = divmod(x, base)
        for r in range(ROUNDS):
            mac = hmac.digest(key, f"{kind}:{size}:{r}:".encode() + b.to_bytes(width + 1, "big"), "sha256")
            a, b = b, (a + int.from_bytes(mac, "big")) % base
        x = a * base + b
        if x < size:
            return x


def refill(shape: str, pattern: str, values: str) -> str:
    """shape with the characters that pattern matches replaced by values, in order."""
    it = iter(values)
    return re.sub(pattern, lambda _: next(it), shape)


def luhn(digits: str) -> int:
    """The digit that completes `digits`."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def digits_permuted(digits: str, key: bytes, kind: str) -> str:
    return str(permute(int(digits), 10 ** len(digits), key, kind)).zfill(len(digits)) if digits else ""


def mixed_permuted(text: str, key: bytes, kind: str) -> str:
    """Of small letters and digits, permuted as one number: letters stay letters and digits digits."""
    bases = [10 if c.isdigit() else 26 for c in text]
    x = 0
    for c, base in zip(text, bases, strict=True):
        x = x * base + (int(c) if base == 10 else ord(c) - 97)
    x = permute(x, math.prod(bases), key, kind)
    out = []
    for base in reversed(bases):
        x, r = divmod(x, base)
        out.append(str(r) if base == 10 else chr(97 + r))
    return "".join(reversed(out))


def _email(value: str, key: bytes) -> str:
    local, domain = value.lower().split("@")
    plain = "".join(re.findall("[a-z0-9]", local))
    return refill(local, "[a-z0-9]", mixed_permuted(plain, key, f"email@{domain}")) + "@" + domain


def _card(value: str, key: bytes) -> str | None:
    d = re.sub(r"\D", "", value)
    if luhn(d[:-1]) != int(d[-1]):
        return None
    head = d[0] + digits_permuted(d[1:-1], key, f"card{d[0]}")
    return refill(value, r"\d", head + str(luhn(head)))


def _ssn(value: str, key: bytes) -> str | None:
    a, g, s = map(int, value.split("-"))
    if a in (0, 666) or a >= 900 or g == 0 or s == 0:
        return None
    x = permute(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, key, "ssn")
    x, s = divmod(x, 9999)
    a, g = divmod(x, 99)
    a += 1 + (a + 1 >= 666)
    return f"{a:03}-{g + 1:02}-{s + 1:04}"


def _phone(value: str, key: bytes) -> str | None:
    m = CODE.match(value)
    code, rest = value[: m.end()], value[m.end() :]
    d = re.sub(r"\D", "", rest)
    n = len(d) + len(re.sub(r"\D", "", code))
    # numbers that begin with a trunk 0; four groups with dots are rather an address
    trunk = not code and "(" not in rest and d[0] == "0" != d[1] and 9 <= n <= 12 and not re.fullmatch(r"(?:\d{1,3}\.){3}\d{1,3}", rest)
    if not 7 <= n <= 15 or not (code or "(" in rest or trunk or re.fullmatch(r"\d{3}[\x20.-]\d{3}[\x20.-]\d{4}|[2-9]\d{2}[2-9]\d{6}", rest)):
        return None
    if len(d) == 10 and d[0] > "1" and d[3] > "1":  # area and exchange don't begin with 0 or 1
        x = permute(((int(d[:3]) - 200) * 800 + int(d[3:6]) - 200) * 10_000 + int(d[6:]), 800 * 800 * 10_000, key, "phone")
        x, line = divmod(x, 10_000)
        a, b = divmod(x, 800)
        d = f"{a + 200}{b + 200}{line:04}"
    elif trunk:  # what follows the trunk 0 doesn't begin with 0
        low = 10 ** (n - 2)
        d = f"0{low + permute(int(d) - low, 9 * low, key, 'phone0')}"
    else:
        d = digits_permuted(d, key, "phone")
    return code + refill(rest, r"\d", d)


def _ip(value: str, key: bytes) -> str | None:
    parts = [int(p) for p in value.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in value.split(".")):
        return None
    x = permute(int.from_bytes(bytes(parts), "big"), 2**32, key, "ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _iban(value: str, key: bytes) -> str | None:
    plain = value.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    account = refill(plain[4:], r"\d", digits_permuted("".join(re.findall(r"\d", plain[4:])), key, f"iban{plain[:2]}"))
    return refill(value, "[A-Z0-9]", f"{plain[:2]}{98 - number(account + plain[:2] + '00') % 97:02}{account}")


def _named_date(value: str, key: bytes) -> str | None:
    """A date with a month's name, which stays in its language and case."""
    name = re.search(f"(?i:{_MONTH})", value)
    said = name[0].lower()
    language = next(names for names in MONTHS if said in names)
    numbers = re.findall(r"\d+", value)
    try:
        day = datetime.date(int(numbers[1]), language.index(said) + 1, int(numbers[0])).toordinal()
    except ValueError:
        return None
    if not FIRST <= day <= LAST:
        return None
    new = datetime.date.fromordinal(FIRST + permute(day - FIRST, LAST - FIRST + 1, key, "date"))
    month = language[new.month - 1]
    month = month.upper() if name[0].isupper() else month.capitalize() if name[0][0].isupper() else month
    end = {1: "st", 2: "nd", 3: "rd"}.get(new.day % 10 if new.day not in (11, 12, 13) else 0, "th")
    out = re.sub(f"(?i:{_MONTH})", "\0", value)
    out = re.sub(r"\d{1,2}(st|nd|rd|th)?(?!\d)", lambda m: f"{new.day}{end if m[1] else ''}", out, count=1)
    return re.sub(r"\d{4}$", f"{new.year:04}", out).replace("\0", month)


def _date(value: str, key: bytes) -> str | None:
    if re.search(r"[^\W\d_]{3}", value):
        return _named_date(value, key)
    sep = next(c for c in value if not c.isdigit())
    p = [int(x) for x in value.split(sep)]
    orders = [(0, 1, 2)] if p[0] > 99 else {"-": [(2, 0, 1), (2, 1, 0)], ".": [(2, 1, 0)], "/": [(2, 0, 1), (2, 1, 0)]}[sep]
    for y, m, d in orders:
        try:
            day = datetime.date(p[y], p[m], p[d]).toordinal()
        except ValueError:
            continue
        if FIRST <= day <= LAST:
            new = datetime.date.fromordinal(FIRST + permute(day - FIRST, LAST - FIRST + 1, key, "date"))
            out = [0, 0, 0]
            out[y], out[m], out[d] = new.year, new.month, new.day
            padded = sep == "-" and y == 0 or any(len(x) == 2 and x[0] == "0" for x in value.split(sep))
            return sep.join(f"{x:04}" if k == y else f"{x:02}" if padded else str(x) for k, x in enumerate(out))
    return None


MAKERS: dict[str, Callable[[str, bytes], str | None]] = {"email": _email, "iban": _iban, "card": _card, "ssn": _ssn, "phone": _phone, "ip": _ip, "date": _date}


@lru_cache(200_000)
def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """The value's pseudonym, or None if it isn't valid for its kind."""
    return MAKERS[kind](value, key)


def personal(text: str) -> bool:
    return "@" in text or re.search(r"\d", text) is not None


def replace(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and the spans (code points, end exclusive, of text) and kinds of what was replaced.

    Where a match isn't valid for its kind, the search goes on behind its first character, so that nothing within is missed.
    """
    if not personal(text):
        return text, []
    out, found, at, seek = [], [], 0, 0
    while m := PATTERN.search(text, seek):
        kind = m.lastgroup
        new = pseudonym(kind, m[0], key)
        if new is None:
            other = _other(text, m, key)
            if other is None:
                seek = m.start() + 1
                continue
            kind, end, new = other
        else:
            end = m.end()
        out += [text[at : m.start()], new]
        found.append((m.start(), end, kind))
        at = seek = end
    return "".join([*out, text[at:]]), found


EACH = {k: re.compile(next(p for p in re.split(r"\|(?=\(\?P<)", PATTERN.pattern) if p.startswith(f"(?P<{k}>"))) for k in KINDS}


def _other(text: str, m: re.Match, key: bytes) -> tuple[str, int, str] | None:
    """What another kind makes of the place where m isn't valid."""
    for kind, pattern in EACH.items():
        if kind != m.lastgroup and (n := pattern.match(text, m.start())) and (new := pseudonym(kind, n[0], key)) is not None:
            return kind, n.end(), new
    return None


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """Per row: doc_id, text with pseudonyms, n_<kind> for each kind, and spans "kind:start:end" of the original text.

    A null text stays null and counts as without matches; an empty one stays empty. Equal values have equal pseudonyms in
    all rows. Rows of equal doc_id, and repeated rows, are treated each by itself; where several kinds fit a place, the first of
    KINDS that is valid is taken. A date of two numbers up to 12 and a year is read month first, in all documents alike. Texts of
    any length are taken whole. An empty table gives an empty result. Columns other than doc_id and text aren't read. The key
    should come from a secret store.
    """
    secret = hashlib.sha256(key.encode()).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(1)):
                null = batch.column(1).slice(at, len(texts)).is_null().to_pylist()
                new, spans = zip(*(replace(t, secret) for t in texts), strict=True)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(at, len(texts)), "text": pa.array([None if n else t for t, n in zip(new, null, strict=True)], pa.string()),
                    **{f"n_{k}": pa.array([sum(s[2] == k for s in found) for found in spans], pa.int64()) for k in KINDS},
                    "spans": [",".join(f"{k}:{a}:{b}" for a, b, k in found) for found in spans],
                })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in KINDS) + ", spans string")
