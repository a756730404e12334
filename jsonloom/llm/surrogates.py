"""PII surrogates: detected entities get keyed replacements of the same type.

Replacements keep the format (every digit stays a digit, every letter a letter
of the same case, separators stay), the script and gender of names, country
codes, top-level domains and check digits. They are made by keyed permutations
of the values of one format, so that distinct entities of a format stay
distinct and every mention of an entity, in any document, gets the same one.

Persons are those that a text names with a listed title; all words of their
names go, and so does every other mention of their full names or surnames in
that text. Names that stand nowhere in a text with a title are not detected,
nor are given names alone. A title that tells no gender is resolved inside
one text only, so that "Dr" in one and "Mr" in another make two entities.

Names come from finite lists, and formats may overlap after replacement, so a
distributed check ranks the entities of each replacement; all but the first
are replaced again with a further tweak, until every replacement is unique.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, pick, table

KINDS = ("email", "card", "ssn", "phone", "ip", "name")
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![A-Za-z0-9])")
CARD = re.compile(r"(?<![\d.+-])\d(?:[ -]?\d){12,18}(?![\d-])")
SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
PHONE = re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]\d{2,4}){2,4}(?![\w-])|(?<![\w.+-])\+\d{8,15}(?!\w)")
IP = re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)")

#: Titles before a name, by gender; unknown where the title tells none.
TITLES = {
    "m": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Don", "г-н", "господин"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Doña", "г-жа", "госпожа"),
    "u": ("Dr", "Prof", "Professor", "Doktor"),
}
#: Given names of the replacements, by script and gender.
GIVEN = {
    ("latin", "m"): ("Adam", "Alan", "Bruno", "Carl", "Daniel", "Edgar", "Felix", "Gavin", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Nils", "Oscar", "Paul", "Robert", "Simon", "Victor"),
    ("latin", "f"): ("Alice", "Anna", "Bella", "Clara", "Diana", "Elena", "Flora", "Greta", "Helen", "Irene", "Julia", "Karen", "Laura", "Maria", "Nora", "Olivia", "Paula", "Rosa", "Sara", "Vera"),
    ("cyrillic", "m"): ("Андрей", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Кирилл", "Максим", "Павел", "Семён"),
    ("cyrillic", "f"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Лидия", "Мария", "Нина", "Ольга"),
}
#: Syllables that surnames of the replacements are built from.
SYLLABLES = {"latin": ("bar", "bel", "cor", "dan", "der", "fal", "gar", "han", "kel", "lan", "mar", "mel", "nor", "par", "ren", "sal", "tan", "tor", "val", "wen"), "cyrillic": ("бор", "вал", "гор", "дар", "кон", "лад", "мар", "нор", "пол", "сел")}
_WORD = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё'-]+"
_TITLE = "|".join(sorted((t for g in TITLES.values() for t in g), key=len, reverse=True))
#: A title and all capitalised words after it, initials among them, up to the next title.
NAME = re.compile(rf"(?<!\w)({_TITLE})(\.?\x20)({_WORD}(?:\x20(?:[A-ZÀ-ÖØ-ÞА-ЯЁ]\.\x20)*(?!(?:{_TITLE})(?!\w)){_WORD})*)")


@dataclass(frozen=True)
class Entity:
    """A mention: what is replaced stands in start:end; canon names the entity, alike in all its mentions."""

    kind: str
    start: int
    end: int
    canon: str


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def names(text: str) -> list[Entity]:
    """Mentions of the persons that the text names with a title, once at least: with a title, and their full names and surnames without one."""
    titled = []
    for m in NAME.finditer(text):
        words = re.sub(r"\x20\w\.(?=\x20)", "", m[3]).split(" ")
        titled.append((m.start(3), m.end(3), m[3], "cyrillic" if re.search("[А-Яа-яЁё]", m[3]) else "latin", next(g for g, t in TITLES.items() if m[1] in t), words))
    if not titled:
        return []
    # a title that tells no gender takes that of the same name, or of the only person of its surname, elsewhere in the text
    lower = lambda words: " ".join(words).lower()
    people: dict[tuple[str, str], list[str]] = {}
    for *_, script, _, words in titled:
        of = people.setdefault((script, words[-1].lower()), [])
        if len(words) > 1 and lower(words) not in of:
            of.append(lower(words))
    sex: dict[tuple[str, str], str] = {}
    for *_, script, gender, words in titled:
        if gender != "u":
            of = people[script, words[-1].lower()]
            sex.setdefault((script, of[0] if len(words) == 1 and len(of) == 1 else lower(words)), gender)
    canons: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for i, (*_, script, gender, words) in enumerate(titled):
        gender = sex.get((script, lower(words)), "u") if gender == "u" else gender
        if len(words) > 1:
            canons.setdefault((script, words[-1].lower()), []).append((gender, f"{script}:{gender}:{lower(words)}"))
        titled[i] = (*titled[i][:4], gender, words)
    found, known = [], {}
    for start, end, mention, script, gender, words in titled:
        # a surname alone is the first person of that surname whose gender may be the title's
        alike = [c for g, c in canons.get((script, words[-1].lower()), ()) if "u" in (g, gender) or g == gender]
        canon = f"{script}:{gender}:{lower(words)}" if len(words) > 1 else alike[0] if alike else f"{script}:{gender}: {lower(words)}"
        found.append(Entity("name", start, end, canon))
        for alias in (mention, " ".join(words), f"{words[0]} {words[-1]}", words[-1]):
            known.setdefault(alias, canon)
    taken = {i for e in found for i in range(e.start, e.end)}
    for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(known, key=len, reverse=True)))})(?!\w)", text):
        if m.start() not in taken and m.end() - 1 not in taken:
            found.append(Entity("name", m.start(), m.end(), known[m[0]]))
    return found


def entities(text: str) -> list[Entity]:
    """Mentions in a text, by start, none over another; of overlapping ones the earlier kind of ``KINDS`` stays."""
    found: list[Entity] = []
    if "@" in text:
        found += [Entity("email", m.start(), m.end(), m[0].lower()) for m in EMAIL.finditer(text)]
    for kind, pattern in (("card", CARD), ("ssn", SSN), ("phone", PHONE), ("ip", IP)):
        for m in pattern.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if kind == "card" and not (luhn(digits) or len(digits) in (15, 16)):
                continue
            if kind == "phone" and not (8 <= len(digits) <= 15 and (m[0][0] in "+(" or len(digits) >= 10)):
                continue
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            found.append(Entity(kind, m.start(), m.end(), m[0] if kind == "ip" else ("+" if m[0][0] == "+" else "") + digits))
    found += names(text)
    out: list[Entity] = []
    for e in sorted(found, key=lambda e: (KINDS.index(e.kind), e.start)):
        if all(e.end <= o.start or e.start >= o.end for o in out):
            out.append(e)
    return sorted(out, key=lambda e: e.start)


def permuted(x: int, n: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. n - 1: Feistel rounds over the bits of n, walked until the value is in range."""
    if n < 2:
        return x
    half = ((n - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for r in range(6):
            h = hashlib.blake2b(f"{tweak}|{n}|{r}|{b}".encode(), key=key, digest_size=max(8, half // 8 + 2)).digest()
            a, b = b, a ^ (int.from_bytes(h, "big") & mask)
        x = a << half | b
        if x < n:
            return x


def same_format(text: str, key: bytes, tweak: str) -> str:
    """Letters a-z and digits of ``text`` permuted among the texts of its format."""
    radix = [10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 1 for c in text]
    x, n = 0, 1
    for c, r in zip(text, radix, strict=True):
        x, n = x * r + (int(c) if r == 10 else ord(c.lower()) - 97 if r == 26 else 0), n * r
    y, out = permuted(x, n, key, tweak), []
    for c, r in zip(reversed(text), reversed(radix), strict=True):
        y, d = divmod(y, r)
        out.append(str(d) if r == 10 else chr(97 + d) if r == 26 else c)
    return "".join(reversed(out))


def surrogate(kind: str, canon: str, key: bytes, attempt: int = 0) -> str:
    """The replacement of an entity, in canonical form. Attempts differ for names and values alike."""
    tweak = f"{kind}:{attempt}"
    if kind == "email":
        local, domain = canon.split("@")
        *labels, top = domain.split(".")
        return f"{same_format(local, key, tweak)}@{'.'.join(same_format(x, key, f'domain{i}:{attempt}') for i, x in enumerate(labels))}.{top}"
    if kind == "card" and luhn(canon):
        body = canon[0] + same_format(canon[1:-1], key, f"{tweak}:{canon[0]}")
        return next(body + d for d in "0123456789" if luhn(body + d))
    if kind == "card":
        return canon[0] + same_format(canon[1:], key, f"{tweak}:{canon[0]}")
    if kind == "phone":  # country code and first digit stay
        keep = 3 if canon[0] == "+" else 1
        return canon[:keep] + same_format(canon[keep:], key, f"{tweak}:{canon[:keep]}")
    if kind == "ip":
        a, *rest = map(int, canon.split("."))
        x = permuted(rest[0] << 16 | rest[1] << 8 | rest[2], 1 << 24, key, f"{tweak}:{a}")
        return f"{a}.{x >> 16}.{x >> 8 & 255}.{x & 255}"
    if kind == "ssn":
        return same_format(canon, key, tweak)
    script, gender, name = canon.split(":", 2)
    h = int.from_bytes(hashlib.blake2b(f"{tweak}|{canon}".encode(), key=key, digest_size=16).digest(), "big")
    genders = ("m", "f") if gender == "u" else (gender,)
    pool = [n for g in genders for n in GIVEN[script, g]]
    h, given = divmod(h, len(pool))
    last = ""
    for _ in range(3 + attempt):
        h, s = divmod(h, len(SYLLABLES[script]))
        last += SYLLABLES[script][s]
    return (pool[given] + " " if name.split(" ")[0] else "") + last.capitalize()


def written(replacement: str, mention: str, kind: str) -> str:
    """A canonical replacement in the form of a mention: its separators, its case, a surname alone for a surname alone."""
    if kind == "name":
        return replacement if " " in mention else replacement.split(" ")[-1]
    if kind in ("ip",):
        return replacement
    if kind == "email":
        return "".join(r.upper() if m.isupper() else r for r, m in zip(replacement, mention, strict=True))
    digits = iter(replacement.lstrip("+"))
    return "".join(next(digits) if c.isdigit() else c for c in mention)


def _mentions(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(e.kind, e.canon) for t in batch.column("text") for e in entities(t.as_py() or "")}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([c for _, c in found], pa.string())], ["kind", "canon"])

    return docs.select("text").mapInArrow(run, "kind string, canon string")


def collisions(docs: DataFrame, key: bytes, rounds: int = 32) -> DataFrame:
    """(kind, canon, attempt) of the entities whose first replacement another entity has too, or that it leaves as they were; an error if ``rounds`` don't make all distinct."""
    held = table(_mentions(docs).distinct().withColumn("attempt", F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [surrogate(k, c, key, a) for k, c, a in zip(*[batch.column(n).to_pylist() for n in ("kind", "canon", "attempt")], strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("kind", "canon", "attempt")], pa.array(made, pa.string())], ["kind", "canon", "attempt", "made"])

    for _ in range(rounds):
        made = held.mapInArrow(run, "kind string, canon string, attempt int, made string")
        first = Window.partitionBy("kind", "made").orderBy("attempt", "canon")
        again = ((F.row_number().over(first) > 1) | (F.col("made") == F.col("canon"))).cast("int")
        new = table(made.withColumn("again", again).select("kind", "canon", (F.col("attempt") + F.col("again")).cast("int").alias("attempt"), "again"))
        left = new.where("again = 1").limit(1).count()
        drop_table(held)
        held = new
        if not left:
            break
    else:
        raise RuntimeError(f"replacements still collide after {rounds} rounds: a format has too few values for its entities")
    return held.where("attempt > 0").select("kind", "canon", "attempt")


def replace_pii(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_email, n_card, n_ssn, n_phone, n_ip, n_name, spans) of every row of ``docs``.

    ``text`` has every entity replaced; ``spans`` are kind:start:end in code
    points of the original text, end exclusive, by start. Null texts stay null
    and have no entity; empty ones stay empty. The key decides all
    replacements; rows repeated get equal ones. An empty table gives no rows.
    Texts are read twice and not shuffled, except those that hold an entity
    whose replacement collided, which meet their exceptions by doc_id.
    """
    d = pick(docs, doc_id=id_col, text=text_col)
    other = table(collisions(d, key))
    kind_of = d.schema["doc_id"].dataType.simpleString()
    counts = [f"n_{k}" for k in KINDS]
    schema = f"doc_id {kind_of}, text string, {', '.join(f'{c} bigint' for c in counts)}, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exceptions = batch.column("other").to_pylist() if "other" in batch.schema.names else [None] * batch.num_rows
            texts, spans, n = [], [], {k: [] for k in KINDS}
            for t, x in zip(batch.column("text"), exceptions, strict=True):
                text, attempts = t.as_py(), {(e["kind"], e["canon"]): e["attempt"] for e in x or ()}
                found, parts, at = entities(text or ""), [], 0
                for e in found:
                    new = written(surrogate(e.kind, e.canon, key, attempts.get((e.kind, e.canon), 0)), text[e.start : e.end], e.kind)
                    parts += [text[at : e.start], new]
                    at = e.end
                texts.append(None if text is None else "".join(parts) + text[at:])
                spans.append(",".join(f"{e.kind}:{e.start}:{e.end}" for e in found))
                for k in KINDS:
                    n[k].append(sum(e.kind == k for e in found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), *[pa.array(n[k], pa.int64()) for k in KINDS], pa.array(spans, pa.string())], ["doc_id", "text", *counts, "spans"])

    if other.limit(1).count():

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, e.kind, e.canon) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for e in entities(t.as_py() or "")]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field("doc_id").type), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["i", "kind", "canon"])

        hit = d.mapInArrow(named, f"i {kind_of}, kind string, canon string").distinct().join(other, ["kind", "canon"])
        hit = table(hit.groupBy("i").agg(F.collect_list(F.struct("kind", "canon", "attempt")).alias("other")))  # entities of one document
        d = d.join(hit, d.doc_id.eqNullSafe(hit.i), "left").select("doc_id", "text", "other")
    return d.mapInArrow(run, schema)
