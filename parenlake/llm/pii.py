"""Personal data: detection and surrogate generation.

Every detected entity is replaced by a made-up one of the same type and format:
digits stay digits, letters stay letters of the same case, card numbers keep the
digits that tell their network, length and check digit, international account
numbers their country and check, addresses of private networks theirs, names
their gender, script and case. A surrogate is drawn from a
keyed hash of the entity's canonical form, so one entity gets one surrogate all
over the corpus (coreference), however it is written. Of a person's name each
word has its own surrogate: "Anna Bauer" and "Frau Bauer" keep a family name in
common, and two persons differ if any of their words does. So has the host of a
mail address, which all addresses at it keep in common.

Different entities may draw the same surrogate, and a surrogate may happen to
be somebody's real value. So the corpus's distinct entities are collected in a
table, clashes are found there by grouping, and the losers draw again until
none is left (distinctness); names drawn again get longer, so they don't run
out. Only those redrawn need to be looked up later.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parenlake.llm.common import bounded, drop_stage, stage, text_of

#: Given names by gender, in Latin, Cyrillic and Greek script.
GIVEN = {
    ("female", "Latin"): "Anna Maria Laura Julia Sophie Emma Clara Elena Nora Alice Sarah Helen Mary Linda Susan Karen Camille Isabelle Lucia Carmen".split(),
    ("male", "Latin"): "John Peter Thomas Michael David Robert James William Daniel Martin Lukas Felix Pierre Louis Jacques Carlos Miguel Pablo Andreas Stefan".split(),
    ("female", "Cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
    ("male", "Cyrillic"): "Иван Алексей Дмитрий Сергей Андрей Николай Михаил Павел".split(),
    ("female", "Greek"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Βασιλική".split(),
    ("male", "Greek"): "Γιώργος Δημήτρης Κώστας Νίκος Παναγιώτης Ιωάννης".split(),
}
#: Forms of address and the gender they tell.
TITLES = {
    "female": "Mrs Ms Miss Madam Frau Madame Mme Mademoiselle Señora Sra Señorita Г-жа Κυρία".split(),
    "male": "Mr Sir Herr Monsieur Señor Sr Г-н Κύριος".split(),
    "": "Dr Prof Professor Doctor".split(),
}
#: Syllables of which surrogate family names are made.
SYLLABLES = {
    "Latin": "bar ben cor dal den far gor hal kar lan lem mar mon nor pel ran ros sal ten tor val ver win zel".split(),
    "Cyrillic": "бар вел гор дан зем кар лес мар нов пол рад сол тар".split(),
    "Greek": "βαρ γερ δημ καλ λαμ μαν νικ παπ ραλ σταμ τσα".split(),
}
ENDINGS = {"Latin": "son er ini ez ley".split(), "Cyrillic": "ов ин ский".split(), "Greek": "ος ης ίδης".split()}
#: Endings of made-up given names by gender and script.
GIVEN_ENDINGS = {
    ("female", "Latin"): "a ia ina".split(), ("male", "Latin"): "o us an".split(),
    ("female", "Cyrillic"): "а ина".split(), ("male", "Cyrillic"): "ий ан".split(),
    ("female", "Greek"): "α ία".split(), ("male", "Greek"): "ος ης".split(),
}
#: International calling codes of one and two digits; others have three.
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: Leading digits that tell a card's network, from and to.
NETWORKS = "4-4 34-34 36-39 51-55 62-62 65-65 300-305 644-649 2221-2720 3528-3589 6011-6011".split()
_GENDER = {name: gender for (gender, _), names in GIVEN.items() for name in names} | {t: g for g, ts in TITLES.items() for t in ts}


def luhn(digits: str) -> bool:
    """Check digit of card numbers."""
    total = 0
    for at, c in enumerate(reversed(digits)):
        x = int(c) * (1 + at % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def iban_check(country: str, body: str) -> str:
    """The two check digits of an international account number."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def digits_of(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


class Draw:
    """Endless keyed pseudo-random numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, form: str, attempt: int) -> None:
        self.seed = f"{kind}\0{form}\0{attempt}".encode()
        self.key, self.attempt, self.round, self.pool = key[:64], attempt, 0, 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < 64:
            block = hashlib.blake2b(self.seed + self.round.to_bytes(4, "big"), key=self.key, digest_size=64).digest()
            self.pool, self.left, self.round = int.from_bytes(block, "big"), 512, self.round + 1
        self.pool, value = divmod(self.pool, n)
        self.left -= n.bit_length()
        return value

    def like(self, text: str) -> str:
        """Same classes of characters at the same places."""
        hexes = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) is not None and any(c.isalpha() for c in text)
        out = []
        for c in text:
            if hexes:
                x = "0123456789abcdef"[self.below(16)]
                out.append(x.upper() if text.isupper() else x)
            elif c.isdigit():
                out.append("0123456789"[self.below(10)])
            elif c.isalpha():
                x = "abcdefghijklmnopqrstuvwxyz"[self.below(26)]
                out.append(x.upper() if c.isupper() else x)
            else:
                out.append(c)
        return "".join(out)


def poured(digits: str, format_: str) -> str:
    """The digits, one after another, in place of the digits of a format."""
    rest = iter(digits)
    return "".join(next(rest, "0") if c.isdigit() else c for c in format_)


# --- Types: canonical form, surrogate of a canonical form, its rendering ------


def _email(draw: Draw, form: str) -> str:
    """The address with its own host, which has a surrogate of its own; longer
    where it was drawn often, so short ones don't run out."""
    local, _, domain = form.partition("@")
    return f"{draw.like(local + 'x' * max(0, draw.attempt - 2))}@{domain}"


def _host(draw: Draw, form: str) -> str:
    labels = form.split(".")
    inner = labels[:-2] or labels[:1]
    inner[-1] += "x" * max(0, draw.attempt - 2)
    return f"{'.'.join(draw.like(x) for x in inner)}.example.{('com', 'net', 'org')[draw.below(3)]}"


def _phone(draw: Draw, form: str) -> str:
    country, number = form.split(":")
    head = "23456789"[draw.below(8)]
    return f"{country}:{head}{''.join('0123456789'[draw.below(10)] for _ in number[1:])}"


def _card(draw: Draw, form: str) -> str:
    ranges = [x.split("-") for x in NETWORKS]
    kept = max((len(low) for low, high in ranges if low <= form[: len(low)] <= high), default=1)
    body = form[:kept] + "".join("0123456789"[draw.below(10)] for _ in form[kept:-1])
    return next(body + c for c in "0123456789" if luhn(body + c))


def _ip(draw: Draw, form: str) -> str:
    """Private, loopback and link-local addresses stay in their range; others
    become public ones. Of sixteen-byte addresses all groups but zeros are drawn."""
    if ":" in form:
        first, *groups = form.split(":")
        local = first[:3] in ("fe8", "fe9", "fea", "feb") or first[:2] in ("fc", "fd")
        least = [0 if int(g, 16) == 0 else 16 ** (len(g.lstrip("0")) - 1) for g in (first, *groups)]
        drawn = [f"{low and low + draw.below(15 * low):04x}" for low in least]
        return ":".join([first if local else drawn[0], *drawn[1:]])
    octets = [int(x) for x in form.split(".")]
    own = [1 + draw.below(254) for _ in range(4)]
    if octets[0] in (10, 127):
        own[0] = octets[0]
    elif octets[:2] in ([192, 168], [169, 254]):
        own[:2] = octets[:2]
    elif octets[0] == 172 and 16 <= octets[1] < 32:
        own[:2] = [172, 16 + draw.below(16)]
    else:
        while not ipaddress.IPv4Address(".".join(map(str, own))).is_global or own[0] > 223:
            own = [1 + draw.below(223), *(1 + draw.below(254) for _ in range(3))]
    return ".".join(map(str, own))


def _iban(draw: Draw, form: str) -> str:
    body = draw.like(form[4:])
    return form[:2] + iban_check(form[:2], body) + body


def script_of(name: str) -> str:
    for c in name:
        if "\u0400" <= c <= "\u04ff":
            return "Cyrillic"
        if "\u0370" <= c <= "\u03ff" or "\u1f00" <= c <= "\u1fff":
            return "Greek"
    return "Latin"


def made_up(draw: Draw, script: str, endings: list[str]) -> str:
    """A name of syllables, the longer the more often it was drawn."""
    parts = SYLLABLES[script]
    return "".join(parts[draw.below(len(parts))] for _ in range(3 + draw.attempt)) + endings[draw.below(len(endings))]


def _surname(draw: Draw, form: str) -> str:
    script = script_of(form)
    return made_up(draw, script, ENDINGS[script])


@lru_cache(maxsize=64)
def shuffled(key: bytes, kind: str, pool: tuple[str, ...]) -> tuple[str, ...]:
    """A keyed order of a pool."""
    draw, out = Draw(key, "order", kind, 0), list(pool)
    for k in range(len(out) - 1, 0, -1):
        j = draw.below(k + 1)
        out[k], out[j] = out[j], out[k]
    return tuple(out)


def _given(draw: Draw, form: str) -> str:
    """A known given name turns into another of its gender and script, by a
    keyed permutation; others are made up."""
    gender, _, name = form.partition(":")
    script = script_of(name)
    gender = gender or ("female", "male")[draw.below(2)]
    pool = tuple(x.lower() for x in GIVEN[(gender, script)])
    if name in pool and not draw.attempt:
        order = shuffled(draw.key, f"{gender} {script}", pool)
        return f"{gender}:{order[(order.index(name) + 1) % len(order)]}"
    return f"{gender}:{made_up(draw, script, GIVEN_ENDINGS[(gender, script)])}"


def words_of(form: str) -> list[tuple[str, str]]:
    """(kind, form) of the words of a person's canonical form, in order.
    Initials are left as they are."""
    gender, _, name = form.partition(":")
    *given, last = name.split(" ")
    return [("INITIAL", w) if len(w) == 1 else ("GIVEN", f"{gender}:{w}") for w in given] + [("SURNAME", last)]


def entities_in(kind: str, form: str) -> list[tuple[str, str]]:
    """What of an entity is drawn: itself, a person's words, or a mail address
    and its host."""
    if kind == "PERSON":
        return [x for x in words_of(form) if x[0] != "INITIAL"]
    return [(kind, form), ("HOST", form.partition("@")[2])] if kind == "EMAIL" else [(kind, form)]


SURROGATE: dict[str, Callable[[Draw, str], str]] = {
    "EMAIL": _email, "HOST": _host, "PHONE": _phone, "CARD": _card, "IP": _ip, "IBAN": _iban, "SURNAME": _surname, "GIVEN": _given,
    "SECRET": lambda draw, form: draw.like(form), "SSN": lambda draw, form: poured("".join("0123456789"[draw.below(10)] for _ in range(9)), form),
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_SURNAME = r"(?:\s+(?:[A-Z]\.|[^\W\d_a-zа-яα-ω][\w'’-]+)){1,3}"
PATTERNS: dict[str, re.Pattern] = {
    "SECRET": re.compile(r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?)([A-Za-z0-9+/_-]{16,})|\b((?:sk|pk|ghp|gho|xox[bap])[-_][A-Za-z0-9_-]{16,}|AKIA[0-9A-Z]{16})\b"),
    "EMAIL": re.compile(r"(?<![\w.+-])[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    "IBAN": re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "CARD": re.compile(r"(?<![\d.])(?:\d[ -]?){12,18}\d(?![\d])"),
    "IP": re.compile(rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)"),
    "IP6": re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|::)[0-9A-Fa-f:]*[0-9A-Fa-f](?![\w:])|(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:)+:(?![\w:])"),
    "SSN": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    "PHONE": re.compile(r"(?<![\w.])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w.])\(\d{3}\) ?\d{3}[.-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"),
}
_NAMED = sorted(_GENDER, key=len, reverse=True)
PERSON = re.compile(rf"\b({'|'.join(map(re.escape, _NAMED))})\b\.?{_SURNAME}")
_FULL = {w for w in _GENDER}
_DIGIT = re.compile(r"\d")


def sixteen_bytes(text: str) -> str | None:
    """The canonical form of an address of sixteen bytes; None for other text
    and for addresses without a digit or of zeros but for the last byte."""
    if not _DIGIT.search(text) or text.count(":") < 2:
        return None
    try:
        found = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    return found.exploded if int(found) > 255 else None


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of entities, in order, none overlapping."""
    found: list[tuple[int, int, str, str]] = []

    def add(start: int, end: int, kind: str, form: str) -> None:
        if not any(start < e and s < end for s, e, _, _ in found):
            found.append((start, end, kind, form))

    if _DIGIT.search(text):
        for m in PATTERNS["SECRET"].finditer(text):
            group = 1 if m[1] else 2
            if any(c.isdigit() for c in m[group]):
                add(*m.span(group), "SECRET", m[group])
    if "@" in text:
        for m in PATTERNS["EMAIL"].finditer(text):
            start = m.start() + len(m[0]) - len(m[0].lstrip("."))
            add(start, m.end(), "EMAIL", text[start : m.end()].lower())
    if _DIGIT.search(text):
        for m in PATTERNS["IBAN"].finditer(text):
            form = m[0].replace(" ", "")
            if 15 <= len(form) <= 34 and iban_check(form[:2], form[4:]) == form[2:4]:
                add(*m.span(), "IBAN", form)
        for m in PATTERNS["CARD"].finditer(text):
            form = digits_of(m[0])
            if luhn(form) and len(set(form)) > 1:
                add(*m.span(), "CARD", form)
        for m in PATTERNS["IP"].finditer(text):
            add(*m.span(), "IP", m[0])
        if "::" in text or text.count(":") >= 7:
            for m in PATTERNS["IP6"].finditer(text):
                form = sixteen_bytes(m[0])
                if form:
                    add(*m.span(), "IP", form)
        for m in PATTERNS["SSN"].finditer(text):
            add(*m.span(), "SSN", m[0])
        for m in PATTERNS["PHONE"].finditer(text):
            digits, abroad = digits_of(m[0]), m[0].startswith("+")
            size = next((n for n in (1, 2) if digits[:n] in CALLING), 3) if abroad else 0
            country = digits[:size] if abroad else ("1" if len(digits) == 10 else "")
            # A trunk 0, as in +44 (0)20, is part of how it is written.
            number = digits[size:].removeprefix("0") if abroad else digits
            if 7 <= len(number) <= 14:
                add(*m.span(), "PHONE", f"{country}:{number}")
    if not _FULL.isdisjoint(text.replace(".", " ").split()):
        for m in PERSON.finditer(text):
            words = m[0].replace(".", " ").split()
            titled = words[0] in TITLES["female"] + TITLES["male"] + TITLES[""]
            name = words[1:] if titled else words
            gender = _GENDER[words[0]] or _GENDER.get(name[0], "")
            if (titled or len(name) > 1) and len({w.lower() for w in name}) == len(name) and not all(w.isupper() for w in name):
                start = m.end() - len(m[0].split(None, 1)[1]) if titled else m.start()
                add(start, m.end(), "PERSON", f"{gender}:{' '.join(name).lower()}")
    return sorted(found)


@lru_cache(maxsize=100_000)
def surrogate(key: bytes, kind: str, form: str, attempt: int) -> str:
    """Canonical form of the surrogate."""
    return SURROGATE[kind](Draw(key, kind, form, attempt), form)


_NAME = re.compile(r"[^\s.]+")


def rendered(key: bytes, kind: str, form: str, original: str, attempts: dict[tuple[str, str], int]) -> str:
    """An entity's surrogate, written as the original was. ``attempts``: of the
    entities that had to draw again."""

    def drawn(kind: str, form: str) -> str:
        return surrogate(key, kind, form, attempts.get((kind, form), 0))

    if kind == "PERSON":
        parts = iter(words_of(form))

        def one(m: re.Match) -> str:
            own, word = next(parts, ("INITIAL", "")), m[0]
            if own[0] == "INITIAL":
                return word
            name = drawn(*own).rpartition(":")[2]
            return name.upper() if word.isupper() else name.capitalize()

        return _NAME.sub(one, original)
    fake = drawn(kind, form)
    if kind == "EMAIL":
        fake = f"{fake.partition('@')[0]}@{drawn('HOST', form.partition('@')[2])}"
    if kind == "IP" and ":" in form:
        # Group by group, as wide and in the case of the original; zeros left out stay out.
        front, back = (x.split(":") if x else [] for x in original.partition("::")[::2])
        groups = fake.split(":")
        write = lambda own, new: f"{int(new, 16):0{len(own)}{'X' if original.isupper() else 'x'}}"
        head = ":".join(write(o, n) for o, n in zip(front, groups, strict=False))
        tail = ":".join(write(o, n) for o, n in zip(back, groups[len(groups) - len(back) :], strict=False))
        return f"{head}::{tail}" if "::" in original else head
    if kind == "PHONE":
        country, number = fake.split(":")
        written = digits_of(original)
        if original.startswith("+"):
            number = country + "0" * (len(written) - len(country) - len(number)) + number
        return poured(number, original)
    if kind in ("CARD", "SSN"):
        return poured(digits_of(fake), original)
    if kind == "IBAN":
        rest = iter(fake)
        return "".join(next(rest) if c != " " else c for c in original)
    if kind == "EMAIL" and original.isupper():
        return fake.upper()
    return fake


def clash_free(entities: DataFrame, key: bytes, rounds: int = 25) -> DataFrame:
    """kind, form, attempt of the entities that had to draw again.

    ``entities``: distinct kind and form, staged. Of several entities with one
    surrogate, and of one whose surrogate is another's real form, all but the
    first draw again, together with a check against all others. (Given names
    are anybody's, so those may be real.) Formats of fixed length may hold fewer
    surrogates than a corpus has entities; what still clashes after ``rounds``
    stays as it was drawn last.
    """

    def drawn(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([surrogate(key, *r) for r in rows], pa.string())], names=["kind", "form", "attempt", "fake"])

        return df.select("kind", "form", "attempt").mapInArrow(run, "kind string, form string, attempt int, fake string")

    def judged(df: DataFrame, taken: DataFrame) -> DataFrame:
        """``again`` for all but the first of one surrogate, and where it is taken."""
        first = Window.partitionBy("kind", "fake").orderBy("attempt", "form")
        # Few rows share a surrogate; groups stay small however common an entity is.
        checked = df.join(taken, (F.col("kind") == F.col("_kind")) & (F.col("fake") == F.col("_fake")), "left")
        again = (F.row_number().over(first) > 1) | F.col("_fake").isNotNull()
        return stage(checked.withColumn("again", again).drop("_kind", "_fake"), "drawn")

    real = entities.filter(F.col("kind") != "GIVEN").select(F.col("kind").alias("_kind"), F.col("form").alias("_fake"))
    at = judged(drawn(entities.withColumn("attempt", F.lit(0))), real)
    settled = [at.filter(~F.col("again"))]
    for _ in range(rounds):
        # Only what is drawn again is looked up, among all the rest.
        losers = at.filter("again").withColumn("attempt", F.col("attempt") + 1)
        if losers.isEmpty():
            break
        made = stage(drawn(losers), "again")
        wanted = made.select(F.col("kind").alias("_k"), F.col("fake").alias("_f")).distinct()
        taken = reduce(DataFrame.unionByName, [x.select(F.col("kind").alias("_kind"), F.col("fake").alias("_fake")) for x in settled], real)
        met = taken.join(wanted, (F.col("_kind") == F.col("_k")) & (F.col("_fake") == F.col("_f")), "left_semi").distinct()
        at = judged(made, met)
        drop_stage(made)
        settled.append(at.filter(~F.col("again")))
    rest = [x.filter("attempt > 0") for x in (*settled, at.filter("again"))]
    return reduce(DataFrame.unionByName, rest).select("kind", "form", "attempt")


def entities_of(docs: DataFrame) -> DataFrame:
    """Distinct kind and canonical form of all entities of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sorted({x for text in batch.column(0).to_pylist() if text for _, _, k, f in find(text) for x in entities_in(k, f)})
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], names=["kind", "form"])

    return docs.select("text").mapInArrow(run, "kind string, form string").distinct()


#: Above so many redrawn entities they are joined to documents, not shipped.
SHIPPED = 20_000


def replace(docs: DataFrame, key: bytes = b"surrogates", counts: bool = True) -> DataFrame:
    """The rows of ``docs`` with surrogates in column text; with ``counts`` also
    n_entities and kinds (the distinct types found, in order, joined by commas),
    in place of columns of these names.

    A null text stays null and an empty one empty. Repeated rows are treated
    alike. Other columns pass through, whatever their names.
    """
    if counts:
        docs = docs.drop("n_entities", "kinds")
    redrawn = clash_free(stage(entities_of(bounded(docs)), "entities"), key)
    some = redrawn.limit(SHIPPED + 1).collect()
    shipped = {(r.kind, r.form): r.attempt for r in some}
    names = [f"c{k}" for k in range(len(docs.columns))]
    row = F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)]).alias("_row")
    if len(some) <= SHIPPED:
        source = docs.select(F.col("text").cast("string").alias("_text"), row, F.lit(None).cast("array<struct<kind:string,form:string,attempt:int>>").alias("_redrawn"))
    else:
        source, shipped = _with_redrawn(docs.select(F.col("text").cast("string").alias("_text"), row), redrawn), {}
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, kinds = [], [], []
            for text, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = find(text) if text else []
                if found:
                    attempts = {(x["kind"], x["form"]): x["attempt"] for x in own} if own else shipped
                    out, last = [], 0
                    for start, end, kind, form in found:
                        out += [text[last:start], rendered(key, kind, form, text[start:end], attempts)]
                        last = end
                    text = "".join(out) + text[last:]
                texts.append(text)
                counts.append(len(found))
                kinds.append(",".join(sorted({k for _, _, k, _ in found})))
            columns = batch.column(1).flatten()
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, fields=list(batch.column(1).type)), pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], names=["_row", "n_entities", "kinds"])

    made = source.mapInArrow(run, f"_row {source.schema['_row'].dataType.simpleString()}, n_entities long, kinds string")
    return made.select(*[F.col(f"_row.{n}").alias(c) for n, c in zip(names, docs.columns, strict=True)], *(["n_entities", "kinds"] if counts else []))


def _with_redrawn(rows: DataFrame, redrawn: DataFrame) -> DataFrame:
    """Each row with the redrawn entities of its own text: the way beyond SHIPPED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(h, k, f) for text, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text for k, f in {x for _, _, k, f in find(text) for x in entities_in(k, f)}]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.string()))], names=["_hash", "kind", "form"])

    hashed = F.sha2("_text", 256).alias("_hash")
    refs = rows.select("_text", hashed).mapInArrow(run, "_hash string, kind string, form string").distinct()
    own = refs.join(redrawn, ["kind", "form"]).groupBy("_hash").agg(F.collect_list(F.struct("kind", "form", "attempt")).alias("_redrawn"))
    return rows.withColumn("_hash", F.sha2("_text", 256)).join(own, "_hash", "left").select("_text", "_row", "_redrawn")


def surrogate_table(docs: DataFrame, key: bytes = b"surrogates") -> DataFrame:
    """doc_id, n_entities, kinds, text (with surrogates) of every document."""
    return replace(docs.select("doc_id", text_of("text").alias("text")), key).select("doc_id", "n_entities", "kinds", "text")
