"""Personal data and secrets, replaced by surrogates of the same kind.

Found are e-mail addresses, phone, card, account and social security numbers, IP addresses, access keys,
passwords and tokens, and names after a title, also where a part of the name stands alone later in the text.
A surrogate is drawn with a secret key from the entity's kind and canonical form, so one entity
has one surrogate in all documents (coreference), and looks like the original: letters stay letters of
their script and case, digits digits, separators and lengths stay; card numbers that pass the Luhn test pass
it again, addresses stay addresses, and a name keeps the gender its title tells.

Distinct entities keep distinct surrogates. All distinct entities of the corpus are drawn once as a table and
checked: of those that drew the same, or drew what stands in the corpus as an entity, all but the
first draw again with the next attempt, until none collide. Usually no entity needs a second draw, and then the
texts are rewritten row by row; else those that do are joined to their documents.

Null texts stay null, empty ones empty. Repeated rows are treated alike. Other columns stay; one of the name of an
added column is replaced. Rows without an id are rewritten by the first draw.
"""

from __future__ import annotations

import hashlib
import hmac
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import stored
from corpusloom.session import shared_folder

#: Titles that tell a gender, and ones that don't.
MALE = "Mr|Herr|Monsieur|Señor|Sr|Don|Sir|господин|κύριος"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Señorita|Doña|госпожа|κυρία"
NEITHER = "Dr|Prof|Professor|Doctor"
#: Syllables of made-up names by script, and endings of either gender.
SCRIPTS = {
    "latin": (tuple("ba be bo da de do fa ka ke ko la le lo ma me mi na ne no pa ra re ri ro sa se so ta te to va ve vi".split()),
              ("n", "r", "s", "k", "l", "rd"), ("a", "ia", "na", "la", "ra", "sa")),
    "cyrillic": (tuple("ба бе бо да де до ка ке ко ла ле ло ма ме ми на не но па ра ре ри ро са се со та те то ва ве ви".split()),
                 ("н", "р", "с", "к", "л", "в"), ("а", "ия", "на", "ла", "ра", "са")),
    "greek": (tuple("βα βε βο δα δε δο κα κε κο λα λε λο μα με μι να νε νο πα ρα ρε ρι ρο σα σε σο τα τε το".split()),
              ("ς", "ος", "ης", "ας"), ("α", "ια", "η", "νη")),
}

_SHAPED = re.compile(
    r"(?<![\w@.-])(?:"
    r"(?P<ip>(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>\d{4}([ -]?)\d{4}\4\d{4}\4\d{1,7}(?!\w)|\d{4}[ -]\d{6}[ -]\d{5}(?!\w)|\d{13,19}(?!\w))"
    r"|(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\w)"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|\d{3}[.-]\d{3}[.-]\d{4}(?!\w))"
    r"|(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r")"
)
_ACCESS = re.compile(r"(?<!\w)(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)|(?:ghp_|gho_|xox[bp]-|sk-)[A-Za-z0-9-]{16,}(?![\w-]))")
_ACCESS_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "xox", "sk-")
#: Where numbers are, and how far before and after such a place an entity can reach.
_DIGITS = re.compile(r"\d[\w.() +-]*")
BEFORE, AFTER = 8, 48
_SECRET = re.compile(
    r"\b(?:password|passwd|pwd|passwort|token|secret|api[_-]?key|access[_-]?key)[\"']?\s*(?:[=:]|is)\s*[\"']?([^\s\"'<>,;]{6,})", re.I
)
_SECRET_SIGNS = ("passw", "pwd", "token", "secret", "key")
_TITLES = tuple(t + end for t in "|".join((MALE, FEMALE, NEITHER)).split("|") for end in (" ", ".", "\u00a0"))
_LOCAL = re.compile(r"[\w.%+-]")
_LOCAL_START = re.compile(r"[A-Za-z0-9À-ÿ]")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9À-ÿ][\wÀ-ÿ-]*\.)+[A-Za-z]{2,}")
_NAME = re.compile(rf"\b({MALE}|{FEMALE}|{NEITHER})\b\.?[  ]+([^\W\d_a-z][\w’'-]+(?:[  ][^\W\d_a-z][\w’'-]+){{0,2}})")
_PART = re.compile(r"[^\W\d_]{2,}")


def _luhn(digits: str) -> int:
    """What the last digit is short of for the Luhn test."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return -total % 10


def find(text: str) -> list[tuple[int, int, str, str]]:
    """Entities in order, none overlapping: start, end, kind, canonical form."""
    found: list[tuple[int, int, str, str]] = []
    at, low = text.find("@"), 0
    while at >= 0:
        right = _DOMAIN.match(text, at + 1)
        # the whole local part, however long; none reaches over the "@" before, so each is scanned once
        start = at
        while right and start > low and _LOCAL.match(text, start - 1):
            start -= 1
        left = _LOCAL_START.search(text, start, at)
        if left and right:
            found.append((left.start(), right.end(), "email", text[left.start() : right.end()].lower()))
        at, low = text.find("@", at + 1), at + 1
    done = 0
    for place in _DIGITS.finditer(text):
        at = max(done, place.start() - BEFORE)
        while m := _SHAPED.search(text, at, min(len(text), place.end() + AFTER)):
            kind = next(k for k in ("ip", "ssn", "card", "phone", "iban") if m[k])
            value = m[0]
            if kind != "ip" or all(int(p) < 256 for p in value.split(".")):
                found.append((m.start(), m.end(), kind, value if kind == "ip" else re.sub(r"[^0-9A-Z+]", "", value)))
            at = done = m.end()
    if any(start in text for start in _ACCESS_STARTS):
        found += [(m.start(), m.end(), "access", m[0]) for m in _ACCESS.finditer(text)]
    low = text.lower()
    for m in _SECRET.finditer(text) if any(sign in low for sign in _SECRET_SIGNS) else ():
        if any(c.isdigit() for c in m[1]):
            found.append((m.start(1), m.start(1) + len(m[1].rstrip(".")), "secret", m[1].rstrip(".")))
    genders: dict[str, str] = {}
    for m in _NAME.finditer(text) if any(title in text for title in _TITLES) else ():
        gender = "m" if re.fullmatch(MALE, m[1]) else "f" if re.fullmatch(FEMALE, m[1]) else "n"
        parts = list(itertools.takewhile(lambda part: part[0].isupper(), _PART.findall(m[2])))
        for i, part in enumerate(parts):
            # a family name is shared by both genders, unless its script marks it
            own = "n" if 0 < i == len(parts) - 1 and part.isascii() else gender
            genders[part] = own if genders.get(part, own) == own else "n"
    if genders:
        for m in re.finditer(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(genders, key=len, reverse=True))) + r")(?!\w)", text):
            found.append((m.start(), m.end(), "name", f"{genders[m[0]]}:{m[0].lower()}"))
    found.sort(key=lambda e: (e[0], -e[1]))
    kept: list[tuple[int, int, str, str]] = []
    for entity in found:
        if not kept or entity[0] >= kept[-1][1]:
            kept.append(entity)
    return kept


class Drawer:
    """Surrogates by a secret key."""

    def __init__(self, key: bytes):
        self.key = key

    def numbers(self, *parts: object) -> Iterator[int]:
        """Endless numbers of 16 bits, the same for the same parts."""
        turn = 0
        while True:
            block = hmac.new(self.key, "\0".join(map(str, (*parts, turn))).encode(), hashlib.sha256).digest()
            for i in range(0, 32, 2):
                yield int.from_bytes(block[i : i + 2], "big")
            turn += 1

    def alike(self, text: str, numbers: Iterator[int], hexadecimal: bool = False) -> str:
        """Each letter another of its script and case or none, each digit a digit, all else as it is."""
        out = []
        for c in text:
            if c.isdigit():
                out.append(str(next(numbers) % 10))
            elif hexadecimal and c.isalpha():
                out.append(("ABCDEF" if c.isupper() else "abcdef")[next(numbers) % 6])
            elif c.isalpha():
                base = "αβγδεζηθικλμνξοπρστυφχψω" if "Ͱ" <= c <= "Ͽ" else "абвгдежзиклмнопрстуфхцчшя" if "Ѐ" <= c <= "ӿ" else "abcdefghijklmnopqrstuvwxyz"
                new = base[next(numbers) % len(base)]
                out.append(new.upper() if c.isupper() else new)
            else:
                out.append(c)
        return "".join(out)

    def draw(self, kind: str, form: str, attempt: int = 0) -> str:
        """The surrogate of a canonical form, itself in canonical form."""
        numbers = self.numbers(kind, form, attempt)
        if kind == "email":
            local, _, domain = form.rpartition("@")
            host, _, top = domain.rpartition(".")
            return f"{self.alike(local, numbers)}@{self.alike(host, self.numbers('domain', domain))}.{top}"
        if kind == "ip":
            first = 1 + next(numbers) % 222
            return ".".join(map(str, [first + (first >= 10) + (first >= 126), *(next(numbers) % 256 for _ in range(3))]))
        if kind == "card":
            body = form[0] + self.alike(form[1:-1], numbers)
            right = _luhn(body + "0")
            return body + str(right if _luhn(form) == 0 else (right + 1 + next(numbers) % 9) % 10)
        if kind == "phone":
            keep = 2 if form.startswith("+1") else 3 if form.startswith("+") else 0
            rest = self.alike(form[keep:], numbers)
            return form[:keep] + (str(2 + int(rest[0]) % 8) + rest[1:] if rest else "")
        if kind == "iban":
            return form[:2] + self.alike(form[2:], numbers)
        if kind == "access":
            keep = 4 if form[:1] == "A" or form[:2] == "gh" else 5 if form[:3] == "xox" else 3
            return form[:keep] + self.alike(form[keep:], numbers)
        if kind == "name":
            gender, _, name = form.partition(":")
            script = "cyrillic" if "Ѐ" <= name[0] <= "ӿ" else "greek" if "Ͱ" <= name[0] <= "Ͽ" else "latin"
            syllables, male, female = SCRIPTS[script]
            size = max(2, round(len(name) / 2) - 1) + attempt // 4
            end = male if gender == "m" or (gender == "n" and next(numbers) % 2) else female
            return gender + ":" + "".join(syllables[next(numbers) % len(syllables)] for _ in range(size)) + end[next(numbers) % len(end)]
        return self.alike(form, numbers, hexadecimal=bool(re.fullmatch(r"[0-9a-fA-F]+", form)))

    def shown(self, kind: str, original: str, drawn: str) -> str:
        """A canonical surrogate in the format of an original."""
        if kind == "name":
            name = drawn.partition(":")[2]
            return name.upper() if original.isupper() else name.capitalize()
        if kind == "email":
            return "".join(d.upper() if o.isupper() else d for o, d in zip(original, drawn, strict=True))
        if kind in ("ip", "access", "secret"):
            return drawn
        signs = iter(drawn)
        return "".join(next(signs) if c.isalnum() or c == "+" else c for c in original)


def rewrite(text: str, drawer: Drawer, attempts: dict[tuple[str, str], int]) -> tuple[str, int]:
    """The text with surrogates, and their number."""
    out, at, n = [], 0, 0
    for start, end, kind, form in find(text):
        drawn = drawer.draw(kind, form, attempts.get((kind, form), 0))
        out += [text[at:start], drawer.shown(kind, text[start:end], drawn)]
        at, n = end, n + 1
    return "".join([*out, text[at:]]), n


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each distinct entity of the corpus: kind, form."""

    @F.arrow_udf("array<struct<kind:string,form:string>>")
    def found(column: pa.Array) -> pa.Array:
        rows = [[{"kind": k, "form": f} for k, f in dict.fromkeys(e[2:] for e in find(v.as_py() or ""))] for v in column]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("form", pa.string())])))

    return docs.select(F.explode(found(F.col(text).cast("string"))).alias("e")).select("e.kind", "e.form").distinct()


def _seen(form: str) -> Column:
    """What of a canonical form can be seen: the gender before a name can't."""
    return F.when(F.col("kind") == "name", F.substring_index(form, ":", -1)).otherwise(F.col(form))


def draws(found: DataFrame, key: bytes) -> DataFrame:
    """kind, form, attempt, drawn: a surrogate for each entity, all distinct and none an entity of the corpus."""

    @F.arrow_udf("string")
    def drawn(kind: pa.Array, form: pa.Array, attempt: pa.Array) -> pa.Array:
        drawer = Drawer(key)
        return pa.array([drawer.draw(k.as_py(), f.as_py(), a.as_py()) for k, f, a in zip(kind, form, attempt, strict=True)], pa.string())

    now = stored(found.withColumn("attempt", F.lit(0)).withColumn("drawn", drawn("kind", "form", "attempt")), "draws")
    while True:
        shown = now.withColumn("shown", _seen("drawn"))
        first = shown.groupBy("kind", "shown").agg(F.min(F.struct("attempt", "form")).alias("first"), F.count(F.lit(1)).alias("n"))
        shared = shown.join(first.filter("n > 1"), ["kind", "shown"]).filter(
            F.struct("attempt", "form") != F.col("first")
        )
        taken = shown.join(found.select("kind", _seen("form").alias("shown")), ["kind", "shown"], "left_semi")
        again = shared.select("kind", "form").unionByName(taken.select("kind", "form")).distinct()
        again = stored(again.withColumn("again", F.lit(True)), "collisions")
        if again.isEmpty():
            return now
        now = now.join(again, ["kind", "form"], "left").withColumn("attempt", F.col("attempt") + F.coalesce(F.col("again").cast("int"), F.lit(0)))
        now = stored(now.select("kind", "form", "attempt").withColumn("drawn", drawn("kind", "form", "attempt")), "draws")


def replace(docs: DataFrame, secret: bytes, key: str = "doc_id", text: str = "text", count: str = "n_entities") -> DataFrame:
    """``docs`` with surrogates in ``text``, and the number of replaced places as ``count``."""
    shared_folder(docs.sparkSession)
    later = draws(stored(entities(docs, text), "entities"), secret).filter("attempt > 0").select("kind", "form", "attempt")
    kind = "array<struct<kind:string,form:string,attempt:int>>"
    if later.isEmpty():
        given = docs.withColumn("__later", F.lit(None).cast(kind))
    else:
        given = _with_later(docs, later, key, text)

    @F.arrow_udf("struct<text:string,n:bigint>")
    def new(column: pa.Array, known: pa.Array) -> pa.Array:
        drawer, out = Drawer(secret), []
        for value, own in zip(column, known, strict=True):
            attempts = {(e["kind"], e["form"]): e["attempt"] for e in own.as_py() or ()}
            value = value.as_py()
            done, n = (None, 0) if value is None else rewrite(value, drawer, attempts)
            out.append({"text": done, "n": n})
        return pa.array(out, pa.struct([("text", pa.string()), ("n", pa.int64())]))

    made = given.withColumn("__new", new(F.col(text).cast("string"), "__later"))
    return made.withColumn(text, F.col("__new.text")).withColumn(count, F.col("__new.n")).drop("__new", "__later")


def _with_later(docs: DataFrame, later: DataFrame, key: str, text: str) -> DataFrame:
    """Adds to each document the entities in it that have a later draw."""

    @F.arrow_udf("array<struct<kind:string,form:string>>")
    def found(column: pa.Array) -> pa.Array:
        rows = [[{"kind": k, "form": f} for k, f in dict.fromkeys(e[2:] for e in find(v.as_py() or ""))] for v in column]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("form", pa.string())])))

    places = docs.select(F.col(key).alias("__id"), F.explode(found(F.col(text).cast("string"))).alias("e"))
    places = places.select("__id", "e.kind", "e.form").join(later, ["kind", "form"])
    own = places.groupBy("__id").agg(F.collect_set(F.struct("kind", "form", "attempt")).alias("__later"))
    return docs.join(own, docs[key] == own["__id"], "left").drop("__id")
