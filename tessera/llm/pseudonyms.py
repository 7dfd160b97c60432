"""Format-preserving Feistel pseudonyms for personal data.

A value is only replaced if it validates: card numbers by the Luhn digit, IBANs by their check digits, phone numbers,
US social security numbers, IP addresses and calendar dates by their ranges, e-mail addresses by their shape. The
value's variable part is a number below some N (digits, letters, days); a Feistel network keyed by the caller's secret
permutes the numbers below the next even power of two, and walks on along its cycle until it is again below N and valid.
That is a permutation of the valid values: the format, its check digits and separators stay, equal values have equal
pseudonyms in every document, different values different ones, and who has the key can go back (`restore`). A date's
written form stays, and the same day in another form gets the same day; fields that only fit the other way round (31/12/1999,
12-31-1999, 12.31.1999) are moved among days from the 13th on, so that they still do. An IPv6 address keeps its kind of network
and is written in its short form. An e-mail address is the same in capitals and small letters; its domain stays as it is.

A value may touch a letter outside ASCII (scripts without spaces), but no ASCII letter, underscore or digit of any script.
The name before an @ is as long as letters, digits, marks and the signs go that addresses may have (so also `to=ann@x.org`,
whose `to` is then moved as well); letters are moved within their script. A name is cut on the left where it is the path of a
URL or longer than 64 characters; beside scripts without spaces it is either of their letters or of others. IPv4 addresses
stay in their special network, or outside of all.

Defined results: null text stays null with no findings; text without findings stays byte for byte. Of overlapping
findings the earlier, then the longer one counts. As in any permutation a value may be its own pseudonym (one in N).
Repeated rows get equal results, empty tables give empty ones. All other columns stay, whatever their names and types, but
for one named pii_kinds (in any case), which is replaced.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import extended, map_arrow, named, others

ROUNDS = 8
DAY_ONE, DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049
KINDS = ("email", "card", "iban", "ssn", "phone", "ip", "ip6", "date")
#: Accented Latin letters: small ones that have one capital, in order, and those without.
ACCENTED = "".join(c for c in map(chr, range(0xC0, 0x250)) if c.islower() and len(c.upper()) == 1 and c.upper().lower() == c and 0xC0 <= ord(c.upper()) < 0x250)
UNCASED = "".join(c for c in map(chr, range(0xC0, 0x250)) if c.isalpha() and c.lower() not in ACCENTED)
#: Start and size of the IPv4 networks that are not routed: this network, private, shared, loopback and link-local ones (fixed values).
SPECIAL = [(int(n.network_address), n.num_addresses) for n in map(ipaddress.IPv4Network, ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16"))]
#: Leading bits that an IPv6 address keeps, by network: global, unique local, link local, multicast; 8 for all others.
NETWORKS = (("2000::", 3), ("fc00::", 7), ("fe80::", 10), ("ff00::", 8))

#: Letters of scripts without spaces between words (fixed ranges); other letters, marks and signs that an address's name may have.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3\uf900-\ufaff\U00020000-\U0003ffff"
NAMED = rf"(?:(?![{UNSPACED}])[\w.!#$%&'*+/=?^`{{|}}~\u0300-\u036f-])"
EMAIL = re.compile(rf"(?:(?<![\w.!#$%&'*+/=?^`{{|}}~\u0300-\u036f-])|(?<=[{UNSPACED}])){NAMED}++@|[{UNSPACED}]++@")
DOMAIN = re.compile(r"(?:[\w-]{1,63}\.){1,8}(?:[A-Za-z]{2,24}|[^\W\d_]{2,24})(?![A-Za-z\d_-])")
#: Characters of a name at most; what is longer, or the path of a URL, ends before the name at one of these.
NAME_CHARS, BREAKS = 64, re.compile(r"[/=?&|#*!'`{}^$]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NUMBER = re.compile(
    r"(?<![A-Za-z\d_])(?<![0-9]\.)(?:(?P<date>[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}([/.-])[0-9]{1,2}\2[0-9]{4})(?![A-Za-z\d_]|[./-][0-9])"
    r"|(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![A-Za-z\d_]|\.[0-9])"
    r"|(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![A-Za-z\d_]|-[0-9])"
    r"|(?P<card>[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![A-Za-z\d_]|-[0-9])"
    r"|(?P<phone>\+[0-9]++(?:\)?[ .-]?\(?[0-9]++)*+\)?|(?:\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![A-Za-z\d_]|-[0-9])))"
)
#: The part of a run of digits after a plus that may be one number, its last group whole; and what can't follow a number.
PHONE = re.compile(r"\+[0-9]{1,16}+(?:\)?[ .-]?\(?[0-9]{1,16}+){0,6}\)?(?![0-9])")
PHONE_GROUPS = re.compile(r"\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,5}\)?){2,6}")
RUNS_ON = re.compile(r"[A-Za-z\d_]|-[0-9]")


#: Classes within which characters are moved.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ACCENTED, UNCASED)


@functools.cache
def alphabet_of(c: str) -> str:
    """The characters that c is moved among; beyond Latin those of its 256 code points that are of its kind."""
    for own in ALPHABETS:
        if c in own:
            return own
    kind = lambda x: (unicodedata.category(x), x != x.upper() and len(x.upper()) == 1 and x.upper().lower() == x)
    page, mine = ord(c) >> 8 << 8, kind(c)
    return "".join(x for x in map(chr, range(page, page + 256)) if x.isalnum() and kind(x) == mine and not any(x in a for a in ALPHABETS))


class Feistel:
    """Keyed permutations of range(n); `kind` separates the permutations of different formats."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, kind: str, half: int, i: int, value: int) -> int:
        data = f"{kind}|{half}|{i}|{value}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big") & ((1 << half) - 1)

    def _once(self, value: int, half: int, kind: str, back: bool) -> int:
        left, right = value >> half, value & ((1 << half) - 1)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ self._round(kind, half, i, left), left
            else:
                left, right = right, left ^ self._round(kind, half, i, right)
        return left << half | right

    def walk(self, value: int, n: int, kind: str, valid: Callable[[int], bool] = lambda v: True, back: bool = False) -> int:
        """The next valid number below n on value's cycle."""
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        at = value
        while True:
            at = self._once(at, half, kind, back)
            if at < n and valid(at):
                return at


def luhn_digit(body: str) -> str:
    total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(body)))
    return str(-total % 10)


def iban_remainder(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _refill(shape: str, symbols: str) -> str:
    """shape with its letters and digits replaced in order."""
    left = iter(symbols)
    return "".join(next(left) if c.isalnum() else c for c in shape)


class Pseudonyms:
    """Finds and replaces; `back` undoes a replacement made with the same key."""

    def __init__(self, key: bytes, kinds: tuple[str, ...] = KINDS, back: bool = False) -> None:
        self.feistel, self.kinds, self.back = Feistel(key), kinds, back

    def _symbols(self, text: str, kind: str, valid: Callable[[str], bool] = lambda s: True) -> str:
        """text with each letter and digit moved within its class (digits, small letters, capitals, accented, other)."""
        own = [alphabet_of(c) for c in text]
        value, n = 0, 1
        for c, alphabet in zip(text, own):
            value, n = value * len(alphabet) + alphabet.index(c), n * len(alphabet)

        def spell(v: int) -> str:
            out = []
            for alphabet in reversed(own):
                v, d = divmod(v, len(alphabet))
                out.append(alphabet[d])
            return "".join(reversed(out))

        return spell(self.feistel.walk(value, n, kind + "".join(a[0] for a in own), lambda v: valid(spell(v)), self.back)) if text else text

    def email(self, text: str) -> str | None:
        name, _, domain = text.partition("@")
        symbols = "".join(c for c in name if c.isalnum())
        if not symbols:
            return None
        cased = [c != c.lower() and len(c.lower()) == 1 and c.lower().upper() == c and c not in UNCASED for c in symbols]
        moved = self._symbols("".join(c.lower() if up else c for c, up in zip(symbols, cased)), "email")
        return _refill(name, "".join(new.upper() if up else new for new, up in zip(moved, cased))) + "@" + domain

    def card(self, text: str) -> str | None:
        digits = re.sub("[^0-9]", "", text)
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        body = digits[0] + self._symbols(digits[1:-1], "card" + digits[0], lambda s: len({digits[0], *s}) > 1)
        return _refill(text, body + luhn_digit(body))

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_remainder(plain) != 1:
            return None
        body = self._symbols(plain[4:], "iban" + plain[:2])
        check = 98 - iban_remainder(plain[:2] + "00" + body)
        return _refill(text, f"{plain[:2]}{check:02d}{body}")

    def ssn(self, text: str) -> str | None:
        fits = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
        digits = text.replace("-", "")
        return _refill(text, self._symbols(digits, "ssn", fits)) if fits(digits) else None

    def phone(self, text: str) -> str | None:
        """The country code stays, and in the North American plan whether area and exchange codes begin with 2 to 9.

        Without a country code or brackets both must."""
        digits = re.sub("[^0-9]", "", text)
        code = ""
        if text[0] == "+":
            code = digits[:1] if digits[0] in "17" else re.match(r"\+([0-9]{1,3})(?=[^0-9])|\+([0-9]{2})", text).expand(r"\1\2")
        own = digits[len(code) :]
        american = text[0] != "+" or code == "1"
        if not (len(own) == 10 if american else 6 <= len(own) <= 13):
            return None
        group = (lambda s: (s[0] in "01", s[3] in "01")) if american else (lambda s: s[0] == "0")
        if text[0] not in "+(" and group(own) != (False, False):
            return None
        return _refill(text, code + self._symbols(own, f"phone{'1' if american else code}", lambda s: group(s) == group(own)))

    def ip(self, text: str) -> str | None:
        """Addresses of each special network, other unicast and what lies above 223 stay among themselves."""
        parts = [int(x) for x in text.split(".")]
        if max(parts) > 255:
            return None
        value = int.from_bytes(bytes(parts), "big")
        inside = lambda v: next(((base, size) for base, size in SPECIAL if base <= v < base + size), None)
        if own := inside(value):
            moved = own[0] + self.feistel.walk(value - own[0], own[1], f"ip-{own[0]}", back=self.back)
        else:
            moved = self.feistel.walk(value, 1 << 32, "ip", lambda v: inside(v) is None and (v >> 24 < 224) == (value >> 24 < 224), self.back)
        return ".".join(map(str, moved.to_bytes(4, "big")))

    def ip6(self, text: str) -> str | None:
        """The network's leading bits stay; loopback and unspecified addresses are no one's."""
        try:
            address = ipaddress.IPv6Address(text)
        except ValueError:
            return None
        value = int(address)
        if value < 2:
            return None
        kept = next((bits for start, bits in NETWORKS if value >> (128 - bits) == int(ipaddress.IPv6Address(start)) >> (128 - bits)), 8)
        n = 1 << (128 - kept)
        moved = self.feistel.walk(value % n, n, f"ip6-{kept}-{value // n}", lambda v: value - value % n + v > 1, self.back)
        new = str(ipaddress.IPv6Address(value - value % n + moved))
        return new.upper() if any(c.isupper() for c in text) else new

    def date(self, text: str) -> str | None:
        """Day and month order: year first, else month first with '/', day first with '.' and '-'; or else the other way round.

        Two two-digit fields, or a leading zero, mean padded fields; only that much of the form is known when going back."""
        mark = next(c for c in text if not c.isdigit())
        parts = text.split(mark)
        usual = "ymd" if len(parts[0]) == 4 else "mdy" if mark == "/" else "dmy"
        for order in (usual, {"mdy": "dmy", "dmy": "mdy"}.get(usual, "")):
            fields = dict(zip(order, parts))
            try:
                number = datetime.date(*(int(fields[x]) for x in "ymd")).toordinal() - DAY_ONE
            except (KeyError, ValueError):
                continue
            if not 0 <= number < DAYS:
                return None
            late = (lambda v: True) if order == usual else (lambda v: datetime.date.fromordinal(v + DAY_ONE).day > 12)
            moved = datetime.date.fromordinal(self.feistel.walk(number, DAYS, "date", late, self.back) + DAY_ONE)
            padded = len(fields["m"]) == len(fields["d"]) == 2 or "0" in (fields["m"][0], fields["d"][0])
            width = 2 if padded else 1
            new = {"y": f"{moved.year:04d}", "m": f"{moved.month:0{width}d}", "d": f"{moved.day:0{width}d}"}
            return mark.join(new[x] for x in order)
        return None

    def find(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym), not overlapping, in order."""
        found = list(self._addresses(text)) if "@" in text and "email" in self.kinds else []
        if DIGIT.search(text):
            found += [*self._scan(text, IBAN, "iban"), *self._scan(text, NUMBER)]
        if text.count(":") > 1:
            found += self._scan(text, IPV6, "ip6")
        out, at = [], 0
        for one in sorted(found, key=lambda f: (f[0], -f[1])):
            if one[0] >= at:
                out.append(one)
                at = one[1]
        return out

    def _addresses(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        """E-mail addresses; a name ends before what is no part of one, on the left."""
        at = 0
        while m := EMAIL.search(text, at):
            at, start, end = m.end(), m.start(), m.end() - 1
            if not (domain := DOMAIN.match(text, m.end())):
                continue
            if end - start > NAME_CHARS or "//" in text[start:end]:
                tail = text[max(start, end - NAME_CHARS) : end]
                cut = tail.rfind("/") + 1 if "//" in text[start:end] else 0
                start = end - len(tail) + (cut or max((b.end() for b in BREAKS.finditer(tail)), default=0))
            if start < end and (new := self.email(text[start : domain.end()])) is not None:
                at = domain.end()
                yield start, at, "email", new

    def _scan(self, text: str, pattern: re.Pattern, kind: str = "") -> Iterator[tuple[int, int, str, str]]:
        """Valid matches; what does not validate is searched again from its second character."""
        at = 0
        while m := pattern.search(text, at):
            own, at = kind or m.lastgroup, m.start() + 1
            value = m[0] if own in self.kinds else ""
            if own == "phone" and value[:1] == "+":
                value = _number(value, text[m.end() : m.end() + 2])
            while value and (new := getattr(self, own)(value)) is None:
                value = _shorter(value) if own == "phone" else ""
            if value:
                at = m.start() + len(value)
                yield m.start(), at, own, new

    def replace(self, text: str | None) -> tuple[str | None, list[str]]:
        """(text with pseudonyms, kinds found in order)."""
        found = self.find(text) if text else []
        if not found:
            return text, []
        out, at = [], 0
        for start, end, _, new in found:
            out += [text[at:start], new]
            at = end
        return "".join([*out, text[at:]]), [f[2] for f in found]


def _number(run: str, after: str) -> str:
    """The longest start of a run of digits and separators that has the groups of a phone number and is not run on."""
    m = PHONE.match(run)
    value = m[0] if m else ""
    if len(value) == len(run) and RUNS_ON.match(after):
        value = _shorter(value)
    while value and not PHONE_GROUPS.fullmatch(value):
        value = _shorter(value)
    return value


def _shorter(value: str) -> str:
    """A number without its last group; empty if it has one only."""
    return value[: max(map(value.rfind, " .-"))].rstrip(" .-(") if re.search("[ .-]", value) else ""


DIGIT = re.compile("[0-9]")
IPV6 = re.compile(r"(?<![A-Za-z\d_:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:)(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![A-Za-z\d_:]|\.[0-9])")


def pseudonymise(docs: DataFrame, key: bytes, *, text: str = "text", kinds: tuple[str, ...] = KINDS, back: bool = False) -> DataFrame:
    """docs with its text replaced and pii_kinds (array<string>, in order of place); other columns stay."""
    kept = others(docs, "pii_kinds")
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Pseudonyms(key, kinds, back)
        for batch in batches:
            rows = [tool.replace(t) for t in batch.column(at).to_pylist()]
            columns = [*batch.columns, pa.array([r[1] for r in rows], pa.list_(pa.string()))]
            columns[at] = pa.array([r[0] for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "pii_kinds"])

    return map_arrow(docs.select(*map(named, kept)), run, extended(docs, kept, "pii_kinds array<string>"))


def restore(docs: DataFrame, key: bytes, *, text: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """pseudonymise() undone with the same key and kinds: the original values, dates and IPv6 addresses as far as their form is known.

    Values that are read otherwise after the replacement than before (a pseudonym beside digits that it now joins) can't go back."""
    return pseudonymise(docs, key, text=text, kinds=kinds, back=True)
