"""Personal data: keyed surrogates of the same type, format, script and gender."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from hashlib import blake2b
from math import isqrt, prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, stage

# Names by script and gender, and titles by the gender that they state.
GIVEN = {
    ("latin", "f"): "Alice Anna Barbara Carmen Charlotte Clara Claire Elena Emily Emma Eva Hannah Helena Ines Isabel Julia Laura Lucia Margaret Maria Marie Mary Nina Olivia Paula Rosa Sarah Sofia Susan Teresa".split(),
    ("latin", "m"): "Adam Albert Andreas Antonio Bernard Carlos Charles Daniel David Diego Felix Frank George Hans Henry Hugo Jacques James Jan Javier John Joseph Louis Lucas Martin Miguel Paul Peter Robert Thomas".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Александр Андрей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей".split(),
    ("greek", "f"): "Αικατερίνη Αναστασία Βασιλική Ελένη Μαρία Σοφία".split(),
    ("greek", "m"): "Αλέξανδρος Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Νικόλαος".split(),
}
TITLES = {
    "m": "Mr Mister Sir Herr Monsieur Señor Sr Don Господин Κύριος".split(),
    "f": "Mrs Ms Miss Madam Lady Frau Mme Madame Mlle Señora Sra Señorita Doña Госпожа Κυρία".split(),
    "?": "Dr Prof Professor Доктор".split(),
}
#: Endings of made names by script and the gender that a title states; no name above ends so.
MARKS = {("latin", "f"): "etta", ("latin", "m"): "ardo", ("cyrillic", "f"): "илла", ("cyrillic", "m"): "слав", ("greek", "f"): "ούλα", ("greek", "m"): "άκης"}
#: Country codes of one and two digits; all others have three.
COUNTRY_CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
VOWELS = "aeiouyàáâäãåæèéêëìíîïòóôöõøœùúûüаеёиоуыэюяαεηιουωάέήίόύώ"
FIRST_OCTETS = [o for o in range(1, 224) if o not in (10, 100, 127, 169, 172, 192, 198, 203)]

GENDER_OF = {name.lower(): (script, gender) for (script, gender), names in GIVEN.items() for name in names}
_ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "àáâäãåæèéêëìíîïòóôöõøœùúûüýÿçñß", "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "άέήίόύώ")
#: Letters fall into classes of one alphabet and of vowels or consonants; a surrogate keeps the class.
_CLASS_OF = {c: "".join(x for x in alphabet if (x in VOWELS) == (c in VOWELS)) for alphabet in _ALPHABETS for c in alphabet}


class Cycle:
    """A keyed permutation of range(size) that is one cycle: nothing maps to itself, no two to the same.

    It is x -> P'(P(x) + 1), with P a keyed Feistel network over a grid that the range is walked in.
    """

    def __init__(self, key: bytes, label: str, size: int):
        self.size, self.key = size, blake2b(label.encode(), key=key).digest()
        self.rows = isqrt(size - 1) + 1
        self.columns = -(-size // self.rows)

    def _draw(self, turn: int, half: int, most: int) -> int:
        return int.from_bytes(blake2b(b"%d:%d" % (turn, half), key=self.key).digest(), "big") % most

    def _forward(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.columns)
            for turn in range(0, 6, 2):
                left = (left + self._draw(turn, right, self.rows)) % self.rows
                right = (right + self._draw(turn + 1, left, self.columns)) % self.columns
            x = left * self.columns + right
            if x < self.size:
                return x

    def _back(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.columns)
            for turn in range(4, -1, -2):
                right = (right - self._draw(turn + 1, left, self.columns)) % self.columns
                left = (left - self._draw(turn, right, self.rows)) % self.rows
            x = left * self.columns + right
            if x < self.size:
                return x

    def __call__(self, x: int) -> int:
        return self._back((self._forward(x) + 1) % self.size) if self.size > 1 else x


def permute(key: bytes, label: str, value: str, classes: list[str], allowed: Callable[[str], bool] = lambda s: True) -> str:
    """Another string of the same classes: each character comes from its class in ``classes``.

    Walks the cycle to the next string that is allowed. As ``value`` is allowed itself, the walk
    permutes the allowed strings: this check for collisions with what isn't allowed keeps all distinct.
    """
    cycle = Cycle(key, f"{label}|{'|'.join(classes)}", prod(len(c) for c in classes))
    while True:
        number = 0
        for char, own in zip(value, classes):
            number = number * len(own) + own.index(char)
        number, out = cycle(number), []
        for own in reversed(classes):
            number, digit = divmod(number, len(own))
            out.append(own[digit])
        value = "".join(reversed(out))
        if allowed(value):
            return value


def _plain(char: str) -> str:
    """Class of a character in an address: letters, digits, or itself alone."""
    return "abcdefghijklmnopqrstuvwxyz" if "a" <= char <= "z" else "0123456789" if "0" <= char <= "9" else char


def luhn_digit(digits: str) -> str:
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def _digits_into(form: str, digits: str) -> str:
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in form)


def surrogate_email(key: bytes, value: str) -> str:
    """Local part and domain change apart, so one domain stays one domain; the last label stays."""
    local, _, domain = value.lower().rpartition("@")
    name, dot, top = domain.rpartition(".")
    new_name = permute(key, "domain", name, [_plain(c) for c in name])
    new_local = permute(key, f"local@{domain}", local, [_plain(c) for c in local])
    return _cased(value, f"{new_local}@{new_name}{dot}{top}")


def surrogate_ip(key: bytes, value: str) -> str:
    octets = list(map(int, value.split(".")))
    number = 0
    for o in octets[1:]:
        number = number * 256 + o
    inside = octets[0] in FIRST_OCTETS  # a reserved first octet stays
    if inside:
        number += FIRST_OCTETS.index(octets[0]) << 24
    number = Cycle(key, "ip" if inside else f"ip{octets[0]}", (len(FIRST_OCTETS) if inside else 1) << 24)(number)
    return f"{FIRST_OCTETS[number >> 24] if inside else octets[0]}.{number >> 16 & 255}.{number >> 8 & 255}.{number & 255}"


def surrogate_card(key: bytes, value: str) -> str:
    """The first digit and the length stay; the last digit checks."""
    digits = re.sub(r"\D", "", value)
    inner = permute(key, f"card{digits[0]}", digits[1:-1], ["0123456789"] * (len(digits) - 2))
    return _digits_into(value, digits[0] + inner + luhn_digit(digits[0] + inner))


def surrogate_number(key: bytes, value: str) -> str:
    """Identity numbers: separators stay."""
    digits = re.sub(r"\D", "", value)
    classes = ["23456789" if digits[0] > "1" else "01"] + ["0123456789"] * (len(digits) - 1)
    # A number that isn't a card's is never turned into one.
    return _digits_into(value, permute(key, "number", digits, classes, lambda s: not _is_card(s)))


def _is_card(digits: str) -> bool:
    return len(digits) > 12 and luhn_digit(digits[:-1]) == digits[-1]


def _of_one(digits: str) -> bool:
    """Whether ten digits are a number of country code 1."""
    return len(digits) == 10 and digits[0] > "1" and digits[3] > "1"


def phone_parts(value: str) -> tuple[str, str]:
    """(country code, the rest) of a phone number, alike for all of its formats.

    The code follows a +, with or without a separator. Without a + a number of code 1 is told by its
    form, with or without the 1; any other has no code.
    """
    digits = re.sub(r"\D", "", value)
    if value[0] == "+":
        size = next((n for n in (1, 2) if digits[:n] in COUNTRY_CODES), 3)
        return digits[:size], digits[size:]
    if _of_one(digits) or digits[0] == "1" and _of_one(digits[1:]):
        return "1", digits[-10:]
    return "", digits


def surrogate_phone(key: bytes, value: str) -> str:
    """Separators and the country code stay; the rest is permuted by code, so formats share a surrogate."""
    code, rest = phone_parts(value)
    one = code == "1" and _of_one(rest)
    classes = ["0123456789"] * len(rest)
    classes[0] = "23456789" if rest[0] > "1" else "01"
    if one:
        classes[3] = "23456789"
    # What isn't of code 1 is never turned into such a number, nor into a card's.
    fits = lambda s: one or not (code == "1" and _of_one(s) or code == "" and phone_parts(s)[0]) and not _is_card(code + s)
    new = permute(key, f"phone{code}", rest, classes, fits)
    n = sum(c.isdigit() for c in value) - len(rest)
    return _digits_into(value, re.sub(r"\D", "", value)[:n] + new)


def _unmarked(low: str) -> tuple[str, list[str]]:
    """A name without its marks, and those marks in order."""
    marks: list[str] = []
    while True:
        mark = next((m for m in MARKS.values() if low.endswith(m) and len(low) > len(m) + 1), None)
        if mark is None:
            return low, marks[::-1]
        low, marks = low[: -len(mark)], [*marks, mark]


def surrogate_name(key: bytes, value: str, gender: str) -> str:
    """Given names on the lists change within their script and gender; any other name keeps the class
    of each letter and its last letter, so that it stays pronounceable and keeps a gendered ending.

    Where a title states a ``gender`` that the lists don't give, the surrogate ends in that gender's
    mark. A name that ends in marks itself gets one more, so that distinct names stay distinct.
    """
    low = value.lower()
    own, marks = _unmarked(low)
    if own in GENDER_OF:
        names = GIVEN[GENDER_OF[own]]
        new = names[Cycle(key, f"given{GENDER_OF[own]}", len(names))([n.lower() for n in names].index(own))].lower()
    else:
        classes = [_CLASS_OF.get(c, c) for c in own[:-1]] + [own[-1]]
        new = own
        if prod(map(len, classes)) > 1:
            new = permute(key, "name", own, classes, lambda s: s not in GENDER_OF and not _unmarked(s)[1])
    if gender in ("f", "m") and GENDER_OF.get(low, ("", ""))[1] != gender:
        script = "cyrillic" if re.search("[а-яё]", low) else "greek" if re.search("[α-ωάέήίόύώ]", low) else "latin"
        new += "".join(marks) + MARKS[script, gender]
    elif marks:
        new += "".join(marks) + marks[-1]
    if value.isupper() and len(value) > 1:
        return new.upper()
    return new[:1].upper() + new[1:] if value[:1].isupper() else new


def _cased(form: str, value: str) -> str:
    return "".join(v.upper() if f.isupper() else v for f, v in zip(form, value))


@dataclass(frozen=True)
class Entity:
    start: int
    end: int
    kind: str
    gender: str = ""


_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w.]*\d|\w)")
_NUMBER = re.compile(r"(?<![\w.+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d+(?:[ .-]\d+)*(?!\w)", re.ASCII)
_UPPER = "A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω"
_WORD = rf"[{_UPPER}][\w'’-]*\w"
_TITLED = re.compile(rf"\b({'|'.join(t for titles in TITLES.values() for t in titles)})\b\.?[ \t]+({_WORD}(?:[ \t]+{_WORD}){{0,2}})")
_NAMED = re.compile(rf"\b({'|'.join(n for names in GIVEN.values() for n in names)})[ \t]+({_WORD})")
_CAPITAL = re.compile(rf"\b[{_UPPER}][\w'’-]*")
_SEGMENT = re.compile(r"[^'’-]+")
_TITLE_GENDER = {t: g for g, titles in TITLES.items() for t in titles}


def find_entities(text: str) -> list[Entity]:
    """Non-overlapping entities in order: addresses first, then cards, phones and identity numbers, names.

    A name's gender is the one that a title states: of the given names behind it, and of the same
    names without a title, by the last title before them or else the first.
    """
    found: list[Entity] = []
    at = text.find("@")
    while at >= 0:
        local, domain = _LOCAL.search(text, max(0, at - 64), at), _DOMAIN.match(text, at + 1)
        if local and domain:
            found.append(Entity(local.start(), domain.end(), "email"))
        at = text.find("@", at + 1)
    found += [Entity(m.start(), m.end(), "ip") for m in _IP.finditer(text)]
    for m in _NUMBER.finditer(text):
        form, digits = m[0], re.sub(r"\D", "", m[0])
        if 13 <= len(digits) <= 19 and luhn_digit(digits[:-1]) == digits[-1]:
            found.append(Entity(m.start(), m.end(), "card"))
        elif re.fullmatch(r"\d{3}-\d{2}-\d{4}", form) or 13 <= len(digits) <= 19 and form.isdigit():
            found.append(Entity(m.start(), m.end(), "identity"))
        elif 9 <= len(digits) <= 15 and (form[0] in "+(" or re.search(r"[ .-]", form)) and len(digits) >= 0.6 * len(form):
            found.append(Entity(m.start(), m.end(), "phone"))
    stated: dict[str, list[tuple[int, str]]] = {}
    for m in _TITLED.finditer(text):
        gender, words = _TITLE_GENDER[m[1]], list(re.finditer(r"\S+", m[2]))
        for i, w in enumerate(words):
            start = m.start(2) + w.start()
            name = re.sub(r"['’]s\Z", "", w[0])
            given = i < len(words) - 1 and gender != "?"
            if given:
                stated.setdefault(name.lower(), []).append((start, gender))
            found.append(Entity(start, start + len(name), "name", gender if given else ""))
    for m in _NAMED.finditer(text):
        found += [Entity(m.start(i), m.start(i) + len(re.sub(r"['’]s\Z", "", m[i])), "name") for i in (1, 2)]
    kept, end = [], 0
    for e in sorted(found, key=lambda e: (e.start, -e.end, e.kind)):
        if e.start >= end:
            kept.append(e)
            end = e.end
    if stated:
        kept = [replace(e, gender=_gender_at(stated.get(text[e.start : e.end].lower()), e.start)) if e.kind == "name" and not e.gender else e for e in kept]
    return kept


def _gender_at(stated: list[tuple[int, str]] | None, at: int) -> str:
    """The gender stated last before a place, or first after it; places come in order."""
    return stated[max(bisect_right(stated, at, key=lambda s: s[0]) - 1, 0)][1] if stated else ""


def find_mentions(text: str, entities: list[Entity]) -> list[Entity]:
    """Where the names of ``entities`` stand alone elsewhere in the text, capitalised or in capitals."""
    names: dict[str, list[tuple[int, str]]] = {}
    for e in entities:
        if e.kind == "name":
            value = text[e.start : e.end]
            for form in {value, value.upper(), value[:1] + value[1:].lower()}:
                names.setdefault(form, []).append((e.start, e.gender))
    if not names:
        return []
    found, taken, i = [], entities, 0
    for m in _CAPITAL.finditer(text):
        whole = re.sub(r"['’]s\Z", "", m[0])
        spans = [(m.start(), whole)] if whole in names else [(m.start() + x.start(), x[0]) for x in _SEGMENT.finditer(m[0]) if x[0] in names]
        for start, name in spans:
            while i < len(taken) and taken[i].end <= start:
                i += 1
            if i == len(taken) or taken[i].start >= start + len(name):
                found.append(Entity(start, start + len(name), "name", _gender_at(names[name], start)))
    return found


SURROGATES = {"email": surrogate_email, "ip": surrogate_ip, "card": surrogate_card, "identity": surrogate_number, "phone": surrogate_phone}


def surrogate(key: bytes, kind: str, value: str, gender: str = "") -> str:
    return surrogate_name(key, value, gender) if kind == "name" else SURROGATES[kind](key, value)


def replace_entities(text: str, key: bytes) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (kind, original, surrogate) of each entity in order.

    Where a found name stands alone in the text it is replaced alike, but isn't an entity of its own.
    """
    out, made, end = [], [], 0
    known: dict[tuple[str, str, str], str] = {}
    entities = find_entities(text)
    own = set(entities)
    for e in sorted(entities + find_mentions(text, entities), key=lambda e: e.start):
        value = text[e.start : e.end]
        form = (e.kind, value, e.gender)
        new = known[form] = known.get(form) or surrogate(key, *form)
        out += [text[end : e.start], new]
        if e in own:
            made.append((e.kind, value, new))
        end = e.end
    return "".join(out) + text[end:], made


def replace_pii(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """Replace personal data by surrogates: (doc_id, text, n_entities, n_email, n_ip, n_card, n_identity,
    n_phone, n_name), a row for each row of ``docs``; a null text stays null and has none.

    A surrogate depends on the key and the entity alone (of a given name, with the gender that its
    document's titles state), so an entity gets the same one in every document, and no state is shared.
    Formats of one phone number share theirs (see phone_parts), and a found name is replaced wherever
    it stands in its document, though n_name counts it only where it is found. Surrogates of one format are a permutation of all strings of
    that format without fixed points: distinct entities stay distinct and none keeps its value.
    With ``check`` the distinct (kind, original, surrogate) of the whole corpus are aggregated first
    (as hashes, combined before the shuffle), and the job fails if two originals share a surrogate.
    Texts with no entity come out as they went in. Extra columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = [*SURROGATES, "name"]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, bytes, bytes]] = set()
        for batch in chunks(batches, "text"):
            for text in batch.column("text").to_pylist():
                for kind, old, new in replace_entities(text or "", key)[1]:
                    form = {"email": str.lower, "name": str.lower, "ip": str, "phone": lambda s: "|".join(phone_parts(s))}.get(kind, lambda s: re.sub(r"\D", "", s))
                    seen.add((kind, *(blake2b(form(x).encode(), digest_size=16).digest() for x in (old, new))))
            if len(seen) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*seen)], ["kind", "old", "new"])
                seen.clear()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*seen)], ["kind", "old", "new"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            texts, counts = [], []
            for text in batch.column("text").to_pylist():
                new, made = (None, []) if text is None else replace_entities(text, key)
                texts.append(new)
                own = [m[0] for m in made]
                counts.append([len(own)] + [own.count(k) for k in kinds])
            columns = [batch.column("doc_id"), pa.array(texts, pa.string())] + [pa.array(c, pa.int64()) for c in zip(*counts)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_entities"] + [f"n_{k}" for k in kinds])

    if check:
        distinct = docs.select("text").mapInArrow(pairs, "kind string, old binary, new binary").distinct()
        clash = stage(distinct.groupBy("kind", "new").agg(F.count("*").alias("n")).filter("n > 1"), "pii-collisions")
        if not clash.isEmpty():
            raise ValueError(f"surrogates collide: {clash.count()} of them stand for several entities")
    return docs.mapInArrow(run, "doc_id long, text string, n_entities long, " + ", ".join(f"n_{k} long" for k in kinds))
