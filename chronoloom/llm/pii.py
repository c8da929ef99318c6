"""Surrogates for personal data: keyed, type-consistent replacements that keep entities apart and together.

Every entity is mapped inside its own kind and format by a keyed permutation: digits become digits, letters become
letters of the same script, case and (in names) the same kind of sound, given names stay in their gender and script. The
permutation is chosen by kind and format and a surrogate keeps its format, so no two entities of a kind can meet, and the same
entity has the same surrogate in all documents, batches and notations, without a table of entities that grows with the
corpus. The permutation is a Feistel network F turned into F^-1(F(x) + s): it has no fixed point. Names found in a text are
replaced wherever else they stand in it. The entities of the whole corpus are gathered with their surrogates and checked.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import materialize

ROUNDS = 8
#: Surrogates remembered by a worker before it starts over.
CACHE = 200_000

#: Given names that are known without a title or cue, by gender and script; a choice, to be extended.
GIVEN = {
    ("f", "latin"): "Anna Maria Sophie Emma Laura Julia Clara Elena Alice Marie Sarah Emily Lucia Carmen Isabel Nina Eva Helen Mary Linda Susan Karen Nancy Lisa Camille Claire Chloe Ines Paula Petra Fatima Aisha Leila Amina Priya Yuki".split(),
    ("m", "latin"): "John Paul Peter Thomas Michael David James Robert Daniel Martin Lukas Felix Hans Karl Jose Carlos Miguel Antonio Luis Pierre Jean Louis Henri Marc Andrew Mark Steven Kevin Brian George Mohammed Ahmed Omar Ali Raj Kenji".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Юлия Екатерина".split(),
    ("m", "cyrillic"): "Иван Пётр Сергей Алексей Дмитрий Андрей Михаил Николай Владимир Павел".split(),
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Ιωάννα".split(),
    ("m", "greek"): "Γιώργος Δημήτρης Νίκος Κώστας Γιάννης Παύλος".split(),
}
#: Titles by gender; None fits both.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": None, "Prof": None, "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f"}
#: Words in front of a name, and words that are no name behind them.
CUES = ("My name is", "my name is", "Name:", "name:", "Signed", "Signed by", "Contact:", "Attn:", "Dear")
NO_NAMES = frozenset("Sir Madam All Team Customer Colleagues Friends Editor Reader Readers Client".split())
#: Alphabets by sound. Letters of other scripts are mapped inside their block of 256 characters and their case.
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоуыэюя", "greek": "αεηιουω"}
CONSONANTS = {"latin": "bcdfghjklmnpqrstvwxyz", "cyrillic": "бвгджзйклмнпрстфхцчшщ", "greek": "βγδζθκλμνξπρστφχψ"}
MARKED = ("àáâãäåèéêëìíîïòóôõöøùúûüýÿ", "çñšžčćłńśźżďťřğş", "ёіїє", "ъь", "άέήίόύώ")
HEX = "0123456789abcdef"
DIGITS = "0123456789"
LOCAL = "abcdefghijklmnopqrstuvwxyz"

_NAME = r"(?:[\u4e00-\u9fff]{2,4}|[^\W\d_\u4e00-\u9fff]+(?:[-'’][^\W\d_]+)*)"
_TITLE = "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True))
_GIVEN_OF = {name: key for key, names in GIVEN.items() for name in names}
_FIRST = "|".join(sorted(map(re.escape, _GIVEN_OF), key=len, reverse=True))
_CUE = "|".join(sorted(map(re.escape, CUES), key=len, reverse=True))
#: What must stand in a text before names are looked for.
_TRIGGERS = [f"{w}{after}" for w in (*TITLES, *_GIVEN_OF) for after in ((" ", ". ") if w in TITLES else (" ",))]
_DIGIT = re.compile(r"\d")
_EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
#: Stretches of a text that may hold numbers, or an address of colons; trimmed and judged by :func:`_stretches`, as a pattern that
#: asks for a last digit would go through a long stretch again from each of its characters.
_NUMERIC = re.compile(r"[\d().+ -]{7,}")
_NUMBERS = re.compile(
    r"(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))"
    r"|(?P<ssn>(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<account>(?<![\w.])(?:\d[ -]?){12,18}\d(?![\w]|\.\d))"
    r"|(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w]|[.-]\d))"
)
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b")
_HEX = re.compile(r"[0-9a-fA-F]{32,}")
_COLONS = re.compile(r"[0-9a-fA-F:.]{3,}")
#: Forms of issued keys: what stands in front is kept.
_KEYS = re.compile(r"(?P<kept>AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|AIza)[0-9A-Za-z_-]{16,}")
_VALUE = re.compile(r"[:=][ \t]*[\"']?(?P<value>[^\s\"',;]{6,})")
_NAMED_SECRET = re.compile(r"(?:pass(?:word|wd|phrase|code)|pwd|secret|token|(?:api|access|private|secret)[ _-]?key)[\"']?\s*$", re.I)
_CUED = re.compile(rf"(?:{_CUE})[ ](?:(?:{_TITLE})\.?[ ])?(?P<called>{_NAME}(?:[ ]{_NAME})?)")
_NAMES = re.compile(
    rf"(?:{_TITLE})\.?[ ](?:(?P<first>{_FIRST})[ ])?(?P<surname>{_NAME})"
    rf"|(?P<first2>{_FIRST})[ ](?P<surname2>{_NAME})"
)


#: Symbols permuted together: half of them stay well below the 512 bits of a round, whatever their alphabet.
BLOCK_SYMBOLS = 32


def _round(key: bytes, tweak: str, number: int, value: int) -> int:
    data = f"{tweak}\0{number}\0".encode() + value.to_bytes(value.bit_length() // 8 + 1, "big")
    return int.from_bytes(hashlib.blake2b(data, key=key, digest_size=64).digest(), "big")


def permute(value: int, left: int, right: int, key: bytes, tweak: str) -> int:
    """Image of ``value`` under a keyed permutation of 0..left*right-1 that moves every value (if there are two)."""
    size = left * right
    if size < 2:
        return value

    def run(x: int, back: bool) -> int:
        a, b = divmod(x, right)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                b = (b + sign * _round(key, tweak, i, a)) % right
            else:
                a = (a + sign * _round(key, tweak, i, b)) % left
        return a * right + b

    shift = 1 + _round(key, tweak, ROUNDS, size) % (size - 1)
    return run((run(value, False) + shift) % size, True)


def permute_symbols(symbols: list[int], radices: list[int], key: bytes, tweak: str) -> list[int]:
    """Image of a mixed-radix number under :func:`permute`, block by block.

    A block of ``BLOCK_SYMBOLS`` has a permutation of its own, picked by the symbols before it: of two numbers the first block in which
    they differ is mapped differently, so they cannot meet, and the work grows with the length.
    """
    short, before, out = hashlib.blake2b(tweak.encode("utf-8", "surrogatepass"), key=key, digest_size=16).hexdigest(), hashlib.blake2b(key=key), []
    for at in range(0, len(symbols), BLOCK_SYMBOLS):
        block = symbols[at : at + BLOCK_SYMBOLS]
        out += _permute_block(block, radices[at : at + BLOCK_SYMBOLS], key, f"{short}/{at}/{before.hexdigest() if at else ''}")
        before.update(",".join(map(str, [*block, ""])).encode())
    return out


def _permute_block(symbols: list[int], radices: list[int], key: bytes, tweak: str) -> list[int]:
    half, value, left, right = len(radices) // 2, 0, 1, 1
    for place, (symbol, radix) in enumerate(zip(symbols, radices, strict=True)):
        value = value * radix + symbol
        if place < half:
            left *= radix
        else:
            right *= radix
    value, out = permute(value, left, right, key, tweak), []
    for radix in reversed(radices):
        value, symbol = divmod(value, radix)
        out.append(symbol)
    return out[::-1]


def permute_text(text: str, classes: Callable[[str], str | None], key: bytes, tweak: str) -> str:
    """Replace each character that has a class (an alphabet holding it) inside its class; the rest stays.

    The tweak and the fixed characters pick the permutation, so texts of one form never meet.
    """
    found = [(i, c) for i, ch in enumerate(text) if (c := classes(ch))]
    form = "".join("\1" if classes(ch) else ch for ch in text)
    symbols = permute_symbols([c.index(text[i]) for i, c in found], [len(c) for _, c in found], key, f"{tweak}\0{form}\0{'/'.join(c[0] for _, c in found)}")
    out = list(text)
    for (i, c), s in zip(found, symbols, strict=True):
        out[i] = c[s]
    return "".join(out)


def _digits_only(ch: str) -> str | None:
    return DIGITS if ch in DIGITS else None


def script_of(word: str) -> str:
    for ch in word:
        if "Ѐ" <= ch <= "ӿ":
            return "cyrillic"
        if "Ͱ" <= ch <= "Ͽ" or "ἀ" <= ch <= "῿":
            return "greek"
    return "latin"


def _recase(model: str, text: str) -> str:
    """``text`` with the upper-case letters where ``model`` has them."""
    return "".join(t.upper() if m.isupper() else t for m, t in zip(model, text, strict=True))


@cache
def _block_of(plane: int, category: str) -> str:
    """The letters of one case of a block of 256 characters that are in no alphabet and keep their identity in capitals."""
    listed = "".join((*VOWELS.values(), *CONSONANTS.values(), *MARKED))
    found = (c for c in map(chr, range(plane << 8, (plane << 8) + 256)) if unicodedata.category(c) == category and c not in listed)
    return "".join(c for c in found if len(c.lower()) == len(c.upper()) == 1 and c in (c.upper().lower(), c.lower().upper()))


@cache
def letter_class(ch: str) -> str | None:
    """The alphabet in which a lower-case letter is replaced, None for what is no letter."""
    if not ch.isalpha():
        return None
    for alphabet in (*VOWELS.values(), *CONSONANTS.values(), *MARKED):
        if ch in alphabet:
            return alphabet
    found = _block_of(ord(ch) >> 8, unicodedata.category(ch))
    return found if ch in found else None


def _lowered(text: str) -> str:
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def surrogate_name_word(word: str, key: bytes) -> str:
    """Surname in the same script, length and case; vowels for vowels, so that it can be said."""
    return _recase(word, permute_text(_lowered(word), letter_class, key, "surname"))


def surrogate_given(name: str, key: bytes) -> str:
    names = GIVEN[_GIVEN_OF[name]]
    return names[permute(names.index(name), 1, len(names), key, "given/" + "/".join(_GIVEN_OF[name]))]


def _luhn(digits: str) -> int:
    total = 0
    for place, ch in enumerate(reversed(digits)):
        d = int(ch) * (2 if place % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _fill(form: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if ch in DIGITS else ch for ch in form)


def surrogate_account(text: str, key: bytes) -> str:
    """Keeps the grouping, and how far the last digit is from a right check digit: right ones stay right."""
    digits = re.sub(r"\D", "", text)
    off = (int(digits[-1]) - _luhn(digits[:-1])) % 10
    body = permute_text(digits[:-1], _digits_only, key, "account")
    return _fill(text, body + str((_luhn(body) + off) % 10))


def surrogate_ip(text: str, key: bytes) -> str:
    return ".".join(map(str, permute_symbols([int(p) for p in text.split(".")], [256] * 4, key, "ip")))


def surrogate_ipv6(text: str, key: bytes) -> str:
    """Groups of zeros stay, the others become other groups; short addresses stay short."""
    groups = [int(g, 16) for g in ipaddress.IPv6Address(text).exploded.split(":")]
    some = [i for i, g in enumerate(groups) if g]
    made = permute_symbols([groups[i] - 1 for i in some], [65535] * len(some), key, f"ipv6/{some}")
    for i, g in zip(some, made, strict=True):
        groups[i] = g + 1
    address = ipaddress.IPv6Address(":".join(f"{g:x}" for g in groups))
    out = str(address) if "::" in text else address.exploded if len(text) == 39 else ":".join(f"{g:x}" for g in groups)
    return out.upper() if text.upper() == text else out


def surrogate_email(text: str, key: bytes) -> str:
    """Local part and host are mapped apart, the ending stays, so that addresses of one host share a host."""
    plain = lambda ch: LOCAL if ch in LOCAL else DIGITS if ch in DIGITS else letter_class(ch)
    local, _, host = text.rpartition("@")
    name, dot, ending = host.rpartition(".")
    out = [_recase(part, permute_text(_lowered(part), plain, key, tweak)) for part, tweak in ((local, "local"), (name, "host"))]
    return f"{out[0]}@{out[1]}{dot}{ending}"


def surrogate_ssn(text: str, key: bytes) -> str:
    return _fill(text, permute_text(re.sub(r"\D", "", text), _digits_only, key, "ssn"))


def surrogate_secret_value(text: str, key: bytes) -> str:
    """Digits, small and capital letters change among themselves; what tells the issuer, and other characters, stay."""
    kept = m["kept"] if (m := _KEYS.fullmatch(text)) else ""
    upper = LOCAL.upper()
    classes = lambda ch: LOCAL if ch in LOCAL else upper if ch in upper else DIGITS if ch in DIGITS else letter_class(ch)
    return kept + permute_text(text[len(kept) :], classes, key, f"key/{kept}")


def surrogate_phone(text: str, key: bytes) -> str:
    """The country code and the grouping stay; the other digits are mapped alike in every notation."""
    head = _head(text)
    digits = re.sub(r"\D", "", text[len(head) :])
    return head + _fill(text[len(head) :], permute_text(digits, _digits_only, key, "phone"))


def surrogate_secret(text: str, key: bytes) -> str:
    made = permute_text(text.lower(), lambda ch: HEX if ch in HEX else None, key, "secret")
    return made.upper() if text.upper() == text else made


def surrogate_iban(text: str, key: bytes) -> str:
    """Country and grouping stay, letters stay letters, and the two check digits are right for the surrogate if they were."""
    plain = text.replace(" ", "")
    value = lambda s: int("".join(str(int(c, 36)) for c in s))
    off = (int(plain[2:4]) - (98 - value(plain[4:] + plain[:2] + "00") % 97)) % 97
    upper = LOCAL.upper()
    body = permute_text(plain[4:], lambda ch: DIGITS if ch in DIGITS else upper if ch in upper else None, key, f"iban/{plain[:2]}")
    check = (98 - value(body + plain[:2] + "00") % 97 + off) % 97
    it = iter(plain[:2] + f"{check:02d}" + body)
    return "".join(" " if ch == " " else next(it) for ch in text)


@dataclass(frozen=True)
class Entity:
    """A place in a text, the kind found there, what tells it from other entities, and its surrogate."""

    start: int
    end: int
    kind: str
    identity: str
    surrogate: str


MAKERS = {
    "email": surrogate_email, "ip": surrogate_ip, "ipv6": surrogate_ipv6, "iban": surrogate_iban, "secret": surrogate_secret, "key": surrogate_secret_value,
    "account": surrogate_account, "phone": surrogate_phone, "ssn": surrogate_ssn, "given": surrogate_given, "surname": surrogate_name_word,
}


def _head(phone: str) -> str:
    return re.match(r"\+\d{1,3}(?=[ .(-])|", phone).group()


def identity(kind: str, text: str) -> str:
    """What is equal for all notations of an entity and different for different ones."""
    if kind in ("account", "ssn"):
        return re.sub(r"\D", "", text)
    if kind == "phone":
        return f"{_head(text)}/{re.sub(r'\D', '', text[len(_head(text)) :])}"
    if kind == "ip":
        return ".".join(str(int(p)) for p in text.split("."))
    if kind == "ipv6":
        return ipaddress.IPv6Address(text).exploded
    return text.replace(" ", "") if kind == "iban" else text if kind in ("key", "given") else _lowered(text)


_SAID: dict[tuple[bytes, str, str], str] = {}


def _said(kind: str, text: str, key: bytes) -> str:
    at = (key, kind, text)
    if at not in _SAID:
        if len(_SAID) > CACHE:
            _SAID.clear()
        _SAID[at] = MAKERS[kind](text, key)
    return _SAID[at]


def _is_ipv6(text: str) -> bool:
    try:
        if "." in text or not any(c in DIGITS for c in text):
            return False
        return sum(int(g, 16) > 0 for g in ipaddress.IPv6Address(text).exploded.split(":")) > 1
    except ValueError:
        return False


def _stretches(pattern: re.Pattern, text: str, first: Callable[[str], bool], last: Callable[[str], bool]) -> Iterator[tuple[int, int]]:
    """Places of the runs that ``pattern`` matches, from the first character that may begin one to the last that may end one; one pass over the text."""
    for m in pattern.finditer(text):
        start, end = m.span()
        while start < end and not first(text[start]):
            start += 1
        while end > start and not last(text[end - 1]):
            end -= 1
        if start < end:
            yield start, end


def _numbers(text: str) -> Iterator[tuple[int, int, str]]:
    word = lambda at: 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")
    for start, end in _stretches(_NUMERIC, text, lambda ch: ch.isdecimal() or ch in "+(", str.isdecimal):
        if end - start >= 7:
            for m in _NUMBERS.finditer(text, start, min(len(text), end + 3)):
                yield m.start(), m.end(), m.lastgroup
    for m in _IBAN.finditer(text):
        if not word(m.start() - 1):
            yield m.start(), m.end(), "iban"
    for m in _HEX.finditer(text):
        letters = sum(c.isalpha() for c in m.group())
        if 0 < letters < len(m.group()) and not word(m.start() - 1) and not word(m.end()):
            yield m.start(), m.end(), "secret"
    if "::" in text or text.count(":") >= 7:
        for start, end in _stretches(_COLONS, text, lambda ch: ch != ".", lambda ch: ch != "."):
            # The longest address has 45 characters.
            if end - start <= 45 and not word(start - 1) and not word(end) and _is_ipv6(text[start:end]):
                yield start, end, "ipv6"


def _secrets(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _KEYS.finditer(text):
        if not (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_")):
            yield m.start(), m.end(), "key"
    for m in _VALUE.finditer(text):
        if _NAMED_SECRET.search(text, max(0, m.start() - 24), m.start()):
            yield *m.span("value"), "key"


def _called(text: str) -> Iterator[tuple[int, int, str]]:
    starts_word = lambda m: not (m.start() and text[m.start() - 1].isalnum())
    for m in filter(starts_word, _CUED.finditer(text) if any(c in text for c in CUES) else ()):
        words = list(re.finditer(_NAME, m["called"]))
        if words[0].group() not in NO_NAMES and not words[0].group()[0].islower():
            words = [w for w in words if not w.group()[0].islower()]
            for w in words:
                known = w.group() in _GIVEN_OF and len(words) > 1 and w is words[0]
                yield m.start("called") + w.start(), m.start("called") + w.end(), "given" if known else "surname"
    for m in filter(starts_word, _NAMES.finditer(text) if any(w in text for w in _TRIGGERS) else ()):
        first, last = ("first", "surname") if m["surname"] else ("first2", "surname2")
        if not m[last][0].islower():
            if m[first]:
                yield *m.span(first), "given"
            yield *m.span(last), "given" if m[last] in _GIVEN_OF and not m[first] else "surname"


def _again(text: str, names: dict[str, str]) -> Iterator[tuple[int, int, str]]:
    """Every place where a name of the text stands as a word of its own."""
    listed = "|".join(sorted(map(re.escape, names), key=len, reverse=True))
    for m in re.finditer(listed, text):
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        caseless = m.group()[0] == m.group()[0].upper() == m.group()[0].lower()
        if caseless or not (before.isalnum() or after.isalnum()):
            yield m.start(), m.end(), names[m.group()]


def entities(text: str, key: bytes) -> Iterator[Entity]:
    """The entities of a text in order, none overlapping: of two, the one that starts first, then the longer."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(*m.span(), "email") for m in _EMAIL.finditer(text)]
    if _DIGIT.search(text):
        found += _numbers(text)
    elif "::" in text or text.count(":") >= 7:
        found += _numbers(text)
    found += _secrets(text)
    called = list(_called(text))
    if called:
        names: dict[str, str] = {}
        for a, b, kind in called:
            if b - a > 1:
                names.setdefault(text[a:b], kind)
        found += called
        found += _again(text, names) if names else []
    end = 0
    for a, b, kind in sorted(found, key=lambda e: (e[0], -e[1])):
        if a >= end:
            yield Entity(a, b, kind, identity(kind, text[a:b]), _said(kind, text[a:b], key))
            end = b


def replace(text: str, key: bytes) -> tuple[str, list[Entity]]:
    found, out, at = list(entities(text, key)), [], 0
    for e in found:
        out += [text[at : e.start], e.surrogate]
        at = e.end
    return "".join([*out, text[at:]]), found


def collisions(found: DataFrame) -> DataFrame:
    """(kind, surrogate, identities): surrogates of (kind, identity, surrogate) that stand for several entities; (kind, identity) with several are listed too."""
    met = found.groupBy("kind", "surrogate").agg(F.count_distinct("identity").alias("identities")).where("identities > 1")
    split = found.groupBy("kind", "identity").agg(F.count_distinct("surrogate").alias("identities")).where("identities > 1")
    return met.unionByName(split.select("kind", F.col("identity").alias("surrogate"), "identities"))


def pseudonymise(docs: DataFrame, key: bytes, *, text_col: str = "text", check: bool = True) -> DataFrame:
    """``docs`` with surrogates in ``text`` and ``n_replaced``, ``kinds`` (entities by kind) and ``entities`` added.

    :param key: secret of at most 64 bytes; whoever holds it can turn surrogates back. One key serves all batches of a corpus.
    :param check: write the result in the shared folder and compare all entities with their surrogates; a ValueError tells
        that two entities share a surrogate, or one has two, before anything is returned.

    ``entities`` lists (kind, identity, surrogate), both in one notation, and must be dropped before the texts are given away.
    Null texts stay null with no entities, empty texts and texts without entities are unchanged. Repeated rows are
    each replaced, alike. Columns of ``docs`` named like the added ones are replaced.
    """
    docs = docs.drop("n_replaced", "kinds", "entities")
    at, names = docs.columns.index(text_col), [*docs.columns, "n_replaced", "kinds", "entities"]
    kinds_type = pa.map_(pa.string(), pa.int64())
    entity_type = pa.list_(pa.struct([("kind", pa.string()), ("identity", pa.string()), ("surrogate", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, kinds, listed = [], [], [], []
            for text in batch.column(at).to_pylist():
                made, found = replace(text, key) if text else (text, [])
                by: dict[str, int] = {}
                for e in found:
                    by[e.kind] = by.get(e.kind, 0) + 1
                texts.append(made)
                counts.append(len(found))
                kinds.append(sorted(by.items()))
                listed.append([{"kind": e.kind, "identity": e.identity, "surrogate": identity(e.kind, e.surrogate)} for e in found])
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(kinds, kinds_type), pa.array(listed, entity_type)], names=names)

    one = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "identity", "surrogate")])
    added = [T.StructField("n_replaced", T.LongType()), T.StructField("kinds", T.MapType(T.StringType(), T.LongType())), T.StructField("entities", T.ArrayType(one))]
    made = docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))
    if not check:
        return made
    made = materialize(made, "pii-texts")
    met = collisions(made.where("n_replaced > 0").select(F.explode("entities").alias("e")).select("e.*").distinct()).count()
    if met:
        raise ValueError(f"{met} surrogates or entities are not told apart")
    return made
