"""PII: validated numbers, dates, addresses and secrets replaced by keyed pseudonyms of the same format."""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re

from pyspark.sql import DataFrame

from stridecast.llm.common import keyed_texts, slices

ROUNDS = 10
DIGITS, HEX, LOWER, UPPER = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KINDS = ("email", "phone", "ip", "card", "ssn", "date", "iban", "secret")
#: Symbols that are permuted together; longer values in parts.
PART = 64
#: Dates are permuted within these years.
FIRST, LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

EMAIL = re.compile(r"(?<![A-Za-z0-9._%+\-])([A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}|[^\W\d_][\w.%+\-]{0,63})@((?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24})(?![A-Za-z0-9\-])")
NUMBERS = re.compile(
    r"(?<![\w.])(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?!\.?\d|\w)"
    r"|(?<![\w.\-/])(?P<date>\d{4}-\d{2}-\d{2}(?=T\d)|(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/(?:\d{4}|\d{2})|\d{1,2}-\d{1,2}-\d{4}|\d{4}/\d{1,2}/\d{1,2}|\d{4}\.\d{1,2}\.\d{1,2}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/\-]|\.\d))"
    r"|(?<![\w\-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w\-])"
    r"|(?<!\w)(?P<phone>\+\d{1,3} ?\(\d{3}\) ?\d{3}-\d{4}|\+\d{1,3}[ \-]\d{3}[ \-]\d{3}[ \-]\d{4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\+\d{8,15}|\+\d{1,3}(?:[ .\-]?\(\d{1,4}\))?(?:[ .\-]\d{1,8}){1,5}(?![\-/]\d))(?!\w)"
    r"|(?<![\w\-])(?P<card>\d(?:[ \-]?\d){12,18})(?![\w\-])"
    r"|(?<![\w.\-+/])(?P<plain>(?:1(?P<sep>[ .\-]))?[2-9]\d{2}(?P<sep2>[ .\-])\d{3}(?P=sep2)\d{4}|[2-9]\d{9})(?![\w\-/]|\.\d)"
)
FULL = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Of English month names; the same spelling is kept, so "may" and "sept", which tell no other month's, keep their month.
SHORT = tuple(m[:3] for m in FULL)
_NAMES = "(?ai:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept(?:ember)?|sep|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_ORDINAL = "(?ai:st|nd|rd|th)"
#: ASCII letters and digits only: others that count as equal without regard to case couldn't be written back.
NAMED = re.compile(
    rf"(?<![\w.\-/])(?:(?P<d1>[0-9]{{1,2}})(?P<o1>{_ORDINAL})?(?P<g1>\.? |-| of )(?P<m1>{_NAMES})(?P<h1>\.?,? |-)(?P<y1>[0-9]{{4}})"
    rf"|(?P<m2>{_NAMES})(?P<g2>\.? )(?P<d2>[0-9]{{1,2}})(?P<o2>{_ORDINAL})?(?P<h2>,? )(?P<y2>[0-9]{{4}}))(?![\w/\-])"
)
SECRET = re.compile(r"""(?P<name>\b(?:token|secret|password|passwd|api[_-]?key)\b\s*[=:]\s*|\bBearer\s+)(?:(?P<quote>["'])(?P<secret>[A-Za-z0-9_\-+/=]{8,})(?P=quote)|(?P<open>(?:[A-Za-z0-9_\-+/=]|[.!#$%^*~](?=[A-Za-z0-9])){8,}))""", re.IGNORECASE)
#: Keys that their first letters tell.
CLOUD = re.compile(r"(?<![A-Za-z0-9_\-])(AKIA|ASIA|gh[pousr]_|github_pat_|sk-|xox[abprs]-|AIza)([A-Z0-9]{16}|[A-Za-z0-9_\-]{20,255})(?![A-Za-z0-9_\-])")
IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,8}(?![\w:]|\.\d)")
IBAN = re.compile(r"(?<![\w\-])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![\w\-])")


class Feistel:
    """A keyed permutation of the strings of n symbols of an alphabet, of dates, and of texts position by position.

    An unbalanced Feistel network over two halves, modular addition of a keyed hash; with apply(back=True) undone.
    """

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _mix(self, tweak: str, round_: int, radix: int, n: int, half: int) -> int:
        said = f"{tweak}|{round_}|{radix}|{n}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(said, key=self.key, digest_size=64).digest(), "big")

    def number(self, value: int, radix: int, n: int, tweak: str, back: bool = False) -> int:
        """Permute 0 .. radix ** n - 1."""
        u = n // 2
        sizes = (radix**u, radix ** (n - u))
        a, b = divmod(value, sizes[1])
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            # even rounds change a by b, odd rounds b by a
            if i % 2 == 0:
                x = self._mix(tweak, i, radix, n, b) if sizes[0] > 1 else 0
                a = (a - x if back else a + x) % sizes[0]
            else:
                x = self._mix(tweak, i, radix, n, a)
                b = (b - x if back else b + x) % sizes[1]
        return a * sizes[1] + b

    def within(self, value: int, low: int, high: int, tweak: str, back: bool = False, ok=lambda x: True) -> int:
        """Permute the values of low .. high that are ok, by walking the cycle of a larger permutation."""
        n = max(2, (high - low).bit_length())
        while True:
            value = low + self.number(value - low, 2, n, tweak, back)
            if low <= value <= high and ok(value):
                return value

    def string(self, text: str, alphabet: str, tweak: str, back: bool = False) -> str:
        if len(text) > PART:
            return "".join(self.string(text[at : at + PART], alphabet, f"{tweak}|{at}", back) for at in range(0, len(text), PART))
        value = 0
        for c in text:
            value = value * len(alphabet) + alphabet.index(c)
        value = self.number(value, len(alphabet), len(text), tweak, back) if text else 0
        out = []
        for _ in text:
            value, r = divmod(value, len(alphabet))
            out.append(alphabet[r])
        return "".join(reversed(out))

    def symbols(self, text: str, tweak: str, alphabets: tuple[str, ...], back: bool = False) -> str:
        """Permute the symbols of each alphabet among themselves; every other character stays. A hash of the shape, which stays,
        is part of the tweak."""
        kind = [next((k for k, a in enumerate(alphabets) if c in a), -1) for c in text]
        shape = f"{tweak}|{hashlib.blake2b(bytes(k + 1 for k in kind), digest_size=16).hexdigest()}"
        out = list(text)
        for k, alphabet in enumerate(alphabets):
            at = [i for i, x in enumerate(kind) if x == k]
            for i, c in zip(at, self.string("".join(text[i] for i in at), alphabet, f"{shape}|{k}", back)):
                out[i] = c
        return "".join(out)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _refill(shape: str, digits: str) -> str:
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in shape)


def north_american(value: int) -> bool:
    """Whether ten digits have an area code and an exchange, each from 200 on and not ending in 11."""
    return all(c > 199 and c % 100 != 11 for c in (value // 10**7, value // 10**4 % 1000))


def ten_digits(value: int, net: Feistel, back: bool, ok=lambda v: True) -> str:
    """Numbers with area code and exchange are permuted among themselves, however they are written; others that are ok among those."""
    valid = north_american(value)
    fits = north_american if valid else lambda v: ok(v) and not north_american(v)
    return f"{net.within(value, 0, 10**10 - 1, 'ten' if valid else f'ten{ok(0)}', back, fits):010d}"


def replace_number(kind: str, found: str, net: Feistel, back: bool = False) -> str | None:
    """The pseudonym of a matched number, or None if it isn't valid."""
    digits = "".join(c for c in found if c.isdigit())
    if not digits.isascii():
        return None
    if kind == "ip":
        parts = found.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        value = net.number(int.from_bytes(bytes(map(int, parts)), "big"), 2, 32, "ip", back)
        return ".".join(map(str, value.to_bytes(4, "big")))
    if kind == "date":
        return _date(found, net, back)
    if kind == "ssn":
        ok = lambda v: v // 10**6 not in (0, 666) and v // 10**6 < 900 and v // 10**4 % 100 and v % 10**4
        if not ok(int(digits)):
            return None
        return _refill(found, f"{net.within(int(digits), 0, 10**9 - 1, 'ssn', back, ok):09d}")
    if kind == "plain":
        # without a sign of a phone, the area code must be one; a bare run of digits needs an exchange too
        value = int(digits[-10:])
        if value // 10**9 < 2 or found.isdigit() and not north_american(value):
            return None
        return _refill(found, digits[:-10] + ten_digits(value, net, back, lambda v: v // 10**9 > 1))
    if kind == "phone":
        # the country's code stays: digits before the first separator, or all but ten of a run
        groups = re.findall(r"\d+", found)
        while len("".join(groups)) > 15:  # other numbers that follow
            groups.pop()
        used = "".join(groups)
        if len(used) < 8:
            return None
        kept = 0 if found[0] != "+" else len(groups[0]) if len(groups) > 1 else max(1, len(used) - 10)
        code, own = used[:kept], used[kept:]
        new = ten_digits(int(own), net, back) if code in ("", "1") and len(own) == 10 else net.string(own, DIGITS, "phone", back)
        return _refill(found, code + new + digits[len(used) :])
    if not luhn(digits):
        return None
    body = net.string(digits[:-1], DIGITS, "card", back)
    return _refill(found, body + next(c for c in DIGITS if luhn(body + c)))


def _date(found: str, net: Feistel, back: bool) -> str | None:
    def made(y: int, m: int, d: int) -> int | None:
        try:
            value = datetime.date(y, m, d).toordinal()
        except ValueError:
            return None
        return value if FIRST <= value <= LAST else None

    if "." in found or re.match(r"\d{4}/", found):
        return _in_format(re.split(r"[./]", found), found, made, net, back)
    if re.match(r"\d{4}-", found):
        value = made(*map(int, found.split("-")))
        return value and datetime.date.fromordinal(net.within(value, FIRST, LAST, "date", back)).isoformat()
    sign = "/" if "/" in found else "-"
    a, b, y = parts = found.split(sign)
    year = _century(y) if len(y) == 2 else int(y)
    if made(year, int(a), int(b)) is not None:  # month first
        return _in_format([b, a, y], f"{sign}m", made, net, back, lambda said: sign.join((said[1], said[2], said[0])))
    # day first, and so the day is over 12
    return _in_format(parts, f"{sign}d", made, net, back, lambda said: sign.join(said[::-1]), least_day=13)


def _century(year: str) -> int:
    """A year of two digits is one of 1970 to 2069."""
    return int(year) + (1900 if int(year) >= 70 else 2000)


def _in_format(parts: list[str], found: str, made, net: Feistel, back: bool, written=None, least_day: int = 1) -> str | None:
    """A date of parts year, month, day or day, month, year; a part of one digit stays one, of two two."""
    order = parts if len(parts[0]) == 4 else parts[::-1]
    short = len(order[0]) == 2
    value = made(_century(order[0]) if short else int(order[0]), *map(int, order[1:]))
    if value is None:
        return None
    widths = [len(x) for x in order[1:]]

    def fits(v: int) -> bool:
        new = datetime.date.fromordinal(v)
        return new.day >= least_day and all(w == 2 or x < 10 for w, x in zip(widths, (new.month, new.day))) and (not short or 1970 <= new.year < 2070)

    sign = found if written else found[len(parts[0])]
    new = datetime.date.fromordinal(net.within(value, FIRST, LAST, f"{sign}{widths}{'y' * short}", back, fits))
    said = [f"{new.year % 100:02d}" if short else str(new.year), f"{new.month:0{widths[0]}d}", f"{new.day:0{widths[1]}d}"]
    return written(said) if written else sign.join(said if order is parts else said[::-1])


def iban(found: str, net: Feistel, back: bool = False) -> str | None:
    """The pseudonym of an account number with valid check digits: its country, and where letters and digits stand, stay."""
    bare = found.replace(" ", "")

    def check(account: str) -> str:
        number = int("".join(str(int(c, 36)) for c in account + bare[:2] + "00"))
        return f"{98 - number % 97:02d}"

    if not 15 <= len(bare) <= 34 or check(bare[4:]) != bare[2:4]:
        return None
    account = net.symbols(bare[4:], f"iban{bare[:2]}", (DIGITS, UPPER), back)
    rest = iter(bare[:2] + check(account) + account)
    return "".join(c if c == " " else next(rest) for c in found)


def _suffix(day: int) -> str:
    return "th" if day in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(day % 10, "th")


def named_date(m: re.Match, net: Feistel, back: bool = False) -> str | None:
    """The pseudonym of a date with a month's name; spelling, capitals, day's width and separators stay."""
    k = "1" if m["d1"] else "2"
    name, day, ordinal, year = m["m" + k], m["d" + k], m["o" + k], int(m["y" + k])
    low, month = name.lower(), SHORT.index(name[:3].lower()) + 1
    try:
        value = datetime.date(year, month, int(day)).toordinal()
    except ValueError:
        return None
    cases = (str.lower, str.upper, str.capitalize)
    case = next((c for c in cases if c(name) == name), None)
    if case is None or not FIRST <= value <= LAST or ordinal and ordinal.lower() != _suffix(int(day)) or ordinal and ordinal not in (ordinal.lower(), ordinal.upper()):
        return None
    own = low in ("may", "sept")

    def fits(v: int) -> bool:
        new = datetime.date.fromordinal(v)
        return (new.month == month if own else new.month != 5) and (len(day) == 2 or new.day < 10)

    new = datetime.date.fromordinal(net.within(value, FIRST, LAST, f"named{low if own else ''}{len(day)}", back, fits))
    spelled = low if own else (SHORT if len(low) == 3 else FULL)[new.month - 1]
    number = f"{new.day:0{len(day)}d}"
    if ordinal:
        number += _suffix(new.day).upper() if ordinal.isupper() else _suffix(new.day)
    g, h = m["g" + k], m["h" + k]
    return f"{number}{g}{case(spelled)}{h}{new.year}" if k == "1" else f"{case(spelled)}{g}{number}{h}{new.year}"


def pseudonymise_text(text: str, net: Feistel, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many of each kind; with back the originals of pseudonyms."""
    counts = dict.fromkeys(KINDS, 0)

    def email(m: re.Match) -> str:
        counts["email"] += 1
        return f"{net.symbols(m[1], 'email', (DIGITS, LOWER, UPPER), back)}@{m[2]}"

    def secret(m: re.Match) -> str:
        bare = m["secret"] is None
        value = m["open"] if bare else m["secret"]
        # words of prose follow such names too, so a value without quotes needs a letter and a digit
        real = lambda v: not bare or any(c.isdigit() for c in v) and any(c.isalpha() for c in v)
        if not real(value):
            return m[0]
        counts["secret"] += 1
        quote = m["quote"] or ""
        sets = (HEX,) if set(value) <= set(HEX) else (DIGITS, LOWER, UPPER)
        # a value of hexadecimal digits stays one; any other must not become one, or it couldn't be undone
        while True:
            value = net.symbols(value, "secret", sets, back)
            if real(value) and (sets == (HEX,) or not set(value) <= set(HEX)):
                return f"{m['name']}{quote}{value}{quote}"

    def named(m: re.Match) -> str:
        new = named_date(m, net, back)
        counts["date"] += new is not None
        return m[0] if new is None else new

    def account(m: re.Match) -> str:
        new = iban(m[0], net, back)
        counts["iban"] += new is not None
        return m[0] if new is None else new

    def cloud(m: re.Match) -> str:
        counts["secret"] += 1
        return m[1] + net.symbols(m[2], f"key{m[1]}", (DIGITS, LOWER, UPPER), back)

    def address(m: re.Match) -> str:
        try:
            ipaddress.IPv6Address(m[0])
        except ValueError:
            return m[0]
        counts["ip"] += 1
        # digits change within their places, so that what is left out stays so
        return net.symbols(m[0], "ip6", (DIGITS, HEX[10:], HEX[10:].upper()), back)

    def number(m: re.Match) -> str:
        kind = "plain" if m["plain"] else m.lastgroup
        new = replace_number(kind, m[0], net, back)
        if new is None:
            return m[0]
        counts["phone" if kind == "plain" else kind] += 1
        return new

    # parts that are replaced once are kept from the rules that follow
    done: list[tuple[int, int]] = []
    out, at = [], 0
    spans = [(m.start(), m.end(), m, email) for m in EMAIL.finditer(text)] if "@" in text else []
    if "=" in text or ":" in text or "earer" in text or "EARER" in text:
        spans += [(m.start(), m.end(), m, secret) for m in SECRET.finditer(text)]
    spans += [(m.start(), m.end(), m, cloud) for m in CLOUD.finditer(text)]
    if "::" in text or text.count(":") > 6:
        spans += [(m.start(), m.end(), m, address) for m in IPV6.finditer(text)]
    spans += [(m.start(), m.end(), m, account) for m in IBAN.finditer(text)]
    spans += [(m.start(), m.end(), m, named) for m in NAMED.finditer(text)]
    spans += [(m.start(), m.end(), m, number) for m in NUMBERS.finditer(text)]
    for start, end, m, made in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start < at:
            continue
        done.append((start, end))
        out += [text[at:start], made(m)]
        at = end
    return "".join([*out, text[at:]]), counts


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with pseudonyms, n_found and n_<kind> for each kind of private value.

    Equal values become equal pseudonyms in all documents, under one key. A null text stays null with zero counts, an empty one
    empty; an empty table has no rows. Each row is treated alone, over its whole text however long, so repeated rows come out
    alike, rows without an id too. No shuffle. back undoes it.
    """

    def run(batches):
        import pyarrow as pa

        net = Feistel(key)
        for batch in slices(batches):
            rows = [(None, dict.fromkeys(KINDS, 0)) if t is None else pseudonymise_text(t, net, back) for t in batch.column(1).to_pylist()]
            counts = [pa.array([c[k] for _, c in rows], pa.int32()) for k in KINDS]
            found = pa.array([sum(c.values()) for _, c in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in rows], pa.string()), found, *counts], ["doc_id", "text", "n_found", *(f"n_{k}" for k in KINDS)])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string, n_found int, " + ", ".join(f"n_{k} int" for k in KINDS))
