"""Personal data: detected entities get keyed, type-consistent surrogates.

Detection covers e-mail addresses, phone numbers, payment cards, IPv4 addresses, US social security
numbers, IBANs, access keys and tokens, and names after an honorific with their other capitalised
mentions in the same text.  Phone numbers begin with "+" or have the forms (555) 123-4567,
555-123-4567 and 555.123.4567, the latter two also with a leading 1.  A number-like entity goes
through a keyed Feistel permutation over the characters of its own classes (digit, lower, upper, by
script), so its format, script and length stay and different originals of one format get different
surrogates; card numbers keep their issuer digit and their Luhn status.  A letter beyond the known alphabets
becomes a letter of its own script.  A name part gets a name of the honorific's gender and of its own script; a
title without gender takes that of the same name's other mentions in the text.  Names in scripts without letter
case, and names without any honorific in the text, are not found.

Coreference and distinctness are global: every distinct entity of the corpus is one row; a surrogate
that is itself an entity of the corpus, or that two originals share, is drawn again with the next
attempt number until no collision is left; values grow with the attempts, so a few rounds settle
any number of them, and a value without a character that can vary is composed anew.  As surrogates are functions of (key, entity, attempt),
documents are rewritten in one pass that needs only the few entities with attempt > 0, broadcast
while counted small, else joined per document.

Defined results: NULL text stays NULL with 0 entities; a text without entities is unchanged;
overlapping matches go to the earliest, then longest; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import secrets
import unicodedata
from bisect import bisect
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, quoted, texts, written

KEY = b"tarmac surrogate key"   # for tests of single functions; ``replace_entities`` never uses it by itself
KEY_CONF = "tarmac.surrogates.key"
BROADCAST_EXCEPTIONS = 100_000
GROW_FROM = 4                # attempts with a value's own length
CROWDED_FROM = 12            # the same for numbers
LIST_ATTEMPTS = 4            # attempts that take a given name as it is in the list

# Honorifics and the gender they tell.
HONORIFICS = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Madam": "f", "Herr": "m", "Herrn": "m", "Frau": "f",
              "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f",
              "Don": "m", "Doña": "f", "Dr": "n", "Prof": "n", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
# Given names by script and gender; "n" takes either.
GIVEN = {
    "latin": {"m": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Nils Oscar Paul".split(),
              "f": "Alma Berta Clara Diana Elena Flora Greta Helena Irma Julia Karin Laura Maria Nora Olga Petra".split()},
    "cyrillic": {"m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл".split(),
                 "f": "Анна Вера Галина Дарья Елена Жанна Ирина Клара".split()},
    "greek": {"m": "Αλέξης Βασίλης Γιώργος Δημήτρης Ηλίας Κώστας".split(), "f": "Άννα Βάσω Γεωργία Δήμητρα Ελένη Κατερίνα".split()},
}
# Syllables of surnames by script.
SYLLABLES = {"latin": "ba be bo da de do fa fe ga ge ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo".split(),
             "cyrillic": "ба бе бо ва ве во га да де до ка ке ко ла ле ло ма ме мо на не но па ра ре ро са се со та".split(),
             "greek": "βα βε γα δα δε κα κε κο λα λε λο μα με μο να νε νο πα ρα ρε ρο σα σε σο τα τε το".split()}
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
             "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)])), "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xDF)])),
             "".join(map(chr, range(0x3B1, 0x3C9))), "".join(map(chr, [*range(0x391, 0x3A2), *range(0x3A3, 0x3AA)])),
             "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x410, 0x430)))]
RESERVED_DOMAINS = ("example.com", "example.org", "example.net")

# Every pattern that scans whole texts begins with a small set of characters, which the engine skips to.
NUMERIC = re.compile(r"[0-9][0-9.-]{5,}")
DIGITAL = re.compile(
    r"(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.\d|\d))"
    r"|(?P<phone>(?<![\d.-])(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|1-\d{3}-\d{3}-\d{4}|1\.\d{3}\.\d{3}\.\d{4})(?!\d|[.-]\d))"
    r"|(?P<card>(?<!\d)(?:\d{13,19}|\d{4}(?:-\d{4}){3})(?!\d))")
SPACED_CARD = re.compile(r"[0-9]{4} \d{4} \d{4} \d{4}(?!\d)")
IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
ACCESS = re.compile(r"AKIA[0-9A-Z]{16}(?!\w)")
PHONE = re.compile(r"\+\d{1,3}(?:[ .-]?\(\d{2,4}\)|[ .-]\d{2,4})(?:[ .-]?\d{2,4}){2,3}(?!\d)|\+\d{8,14}(?!\d)")
AREA = re.compile(r"\([2-9]\d{2}\) ?\d{3}[ .-]\d{4}(?!\d)")
QUOTED = re.compile(r"[=:]\s*[\"']([^\"'\s]{8,})[\"']")
SECRET = re.compile(r"(?i:token|secret|password|passwd|api_?key)\s*$")
DOMAIN = re.compile(r"(?:[\w-]+\.)+\w{2,}")
WORD = re.compile(r"[^\W\d_]+")
NAME = re.compile("(" + "|".join(sorted(HONORIFICS, key=len, reverse=True)) + r")\b\.? ((?:[^\W\d_a-z][^\W\d_]+)(?: [^\W\d_a-z][^\W\d_]+)?)")


Entity = tuple[int, int, str, str]


def _starts_word(text: str, at: int) -> bool:
    return at == 0 or not (text[at - 1].isalnum() or text[at - 1] == "_")


def _capital(word: str) -> bool:
    return word[0].isupper()


def detect(text: str) -> list[Entity]:
    """Entities as (begin, end, kind, canonical form), in order, without overlaps."""
    found = []
    at = text.find("@")
    while at >= 0:
        right, begin = DOMAIN.match(text, at + 1, at + 256), at
        while right and begin and (text[begin - 1].isalnum() or text[begin - 1] in "_.+%-"):
            begin -= 1
        left = text[begin:at].lstrip(".-")
        if left:
            begin = at - len(left)
            found.append((begin, right.end(), "email", text[begin:right.end()].lower()))
        at = text.find("@", at + 1)
    if "+" in text:
        found += [(m.start(), m.end(), "phone", "+" + re.sub(r"\D", "", m[0])) for m in PHONE.finditer(text)]
    for run in NUMERIC.finditer(text):
        for m in DIGITAL.finditer(text, run.start(), run.end()):
            found.append((m.start(), m.end(), m.lastgroup, m[0].replace("-", "") if m.lastgroup != "phone" else re.sub(r"\D", "", m[0])))
    if "(" in text:
        found += [(m.start(), m.end(), "phone", re.sub(r"\D", "", m[0])) for m in AREA.finditer(text)]
    m = SPACED_CARD.search(text)
    while m:        # candidates may overlap: groups of four digits before a card are not its own
        if m.start() == 0 or not text[m.start() - 1].isdigit():
            found.append((m.start(), m.end(), "card", m[0].replace(" ", "")))
        m = SPACED_CARD.search(text, m.start() + 5)
    for kind, pattern in (("iban", IBAN), ("access", ACCESS)):
        found += [(m.start(), m.end(), kind, m[0].replace(" ", "")) for m in pattern.finditer(text) if _starts_word(text, m.start())]
    found += [(m.start(1), m.end(1), "token", m[1]) for m in QUOTED.finditer(text)
              if SECRET.search(text, max(0, m.start() - 16), m.start())]
    for m in NAME.finditer(text):
        words = [w for w in m[2].split(" ") if _capital(w)]
        if words and words[0] == m[2].split(" ")[0] and _starts_word(text, m.start()):
            begin, gender = m.start(2), HONORIFICS[m[1]]
            if len(words) == 2:
                found.append((begin, begin + len(words[0]), f"given-{gender}", words[0].casefold()))
                begin += len(words[0]) + 1
            found.append((begin, begin + len(words[-1]), "surname", words[-1].casefold()))
    out = _apart(found)
    # one person under several honorifics: a title that tells no gender takes that of the name's other mentions
    told: dict[str, str] = {}
    for _, _, kind, canonical in out:
        if kind in ("given-m", "given-f"):
            told.setdefault(canonical, kind)
    out = [(b, e, told.get(c, k) if k == "given-n" else k, c) for b, e, k, c in out]
    parts: dict[str, str] = {}
    for _, _, kind, canonical in out:
        if kind == "surname" or kind.startswith("given-"):
            parts.setdefault(canonical, kind)
    if parts:       # later and earlier mentions of the names without honorific
        out = _apart(out, [(m.start(), m.end(), parts[w], w) for m in WORD.finditer(text)
                           if (w := m[0].casefold()) in parts and _capital(m[0])])
    return out


def _apart(found: list[Entity], more: list[Entity] = []) -> list[Entity]:
    """Without overlaps: the earliest, then longest; those of ``more`` only where ``found`` has none."""
    out: list[Entity] = []
    for f in sorted(found, key=lambda f: (f[0], -f[1])):
        if not out or f[0] >= out[-1][1]:
            out.append(f)
    if more:
        begins = [f[0] for f in out]
        free = []
        for f in more:
            k = bisect(begins, f[0])
            if (not k or out[k - 1][1] <= f[0]) and (k == len(out) or out[k][0] >= f[1]):
                free.append(f)
        out = sorted(out + free)
    return out


def _draw(key: bytes, *parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8"), key=key[:64], digest_size=16).digest(), "big")


@lru_cache(maxsize=4096)
def _alphabet(char: str) -> str:
    """The characters that may stand for ``char``: its alphabet, or for a letter of another script those of the same
    category among its 64 neighbours; none for anything else."""
    known = next((a for a in ALPHABETS if char in a), "")
    if known or not char.isalpha():
        return known
    first, kind = ord(char) & ~63, unicodedata.category(char)
    return "".join(c for c in map(chr, range(first, first + 64)) if unicodedata.category(c) == kind)


def permute(value: str, key: bytes, tweak: str, first: str | None = None, rounds: int = 6,
            hexadecimal: bool = False) -> str:
    """Keyed bijection on the strings of one class pattern: a Feistel network over the mixed-radix
    numbers of both halves.  ``first``: alphabet of the first varying character."""
    places = [(i, _alphabet(c)) for i, c in enumerate(value) if _alphabet(c)]
    if first and places and value[places[0][0]] in first:
        places[0] = (places[0][0], first)
    if hexadecimal:
        places = [(i, "0123456789abcdef") for i in range(len(value))]
    halves = [places[:len(places) // 2], places[len(places) // 2:]]
    sizes, numbers = [], []
    for half in halves:
        size, number = 1, 0
        for i, a in half:
            size, number = size * len(a), number * len(a) + a.index(value[i])
        sizes.append(size)
        numbers.append(number)
    pattern = len(value) if hexadecimal else "".join(a[0] if a else c for c, a in ((c, _alphabet(c)) for c in value))
    for r in range(rounds):
        side = 1 - r % 2
        drawn = _draw(key, tweak, pattern, r, numbers[1 - side])
        for k in range(1, 1 + sizes[side].bit_length() // 120):      # long values: every character is to change
            drawn = drawn << 128 | _draw(key, tweak, pattern, r, numbers[1 - side], k)
        numbers[side] = (numbers[side] + drawn) % sizes[side]
    out = list(value)
    for half, number in zip(halves, numbers):
        for i, a in reversed(half):
            number, k = divmod(number, len(a))
            out[i] = a[k]
    return "".join(out)


def _luhn_digit(digits: str) -> int:
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def script_of(word: str) -> str:
    """The script of a name's lists, or "" for a script without one."""
    return "cyrillic" if "Ѐ" <= word[0] <= "ӿ" else "greek" if "Ͱ" <= word[0] <= "Ͽ" else "latin" if word[0] < "ɐ" else ""


def _letters(key: bytes, n: int, alphabet: str, *parts) -> str:
    """``n`` keyed characters of an alphabet."""
    return "".join(alphabet[_draw(key, *parts, i) % len(alphabet)] for i in range(n))


def surrogate(kind: str, canonical: str, attempt: int, key: bytes = KEY) -> str:
    """Canonical form of the replacement; another one for every attempt.

    After ``GROW_FROM`` attempts, or when no character of a value can vary, it is composed anew and gets longer
    with every attempt, so some attempt is free however many values there are."""
    more = attempt - GROW_FROM + 1
    if kind == "email":
        local, _, domain = canonical.rpartition("@")
        if more > 0 or not any(len(_alphabet(c)) > 1 for c in local):
            domain = _first_surrogate(kind, "a@" + domain, attempt, key).partition("@")[2]
            return _letters(key, 6 + max(0, more), ALPHABETS[1], kind, canonical, attempt) + "@" + domain
    elif kind == "token":
        if more > 0 or not any(len(_alphabet(c)) > 1 for c in canonical):
            hexadecimal = re.fullmatch("[0-9a-f]+", canonical)
            return _letters(key, max(8, len(canonical)) + max(0, more), "0123456789abcdef" if hexadecimal else ALPHABETS[1] + ALPHABETS[0],
                            kind, canonical, attempt)
    elif kind == "surname" or kind.startswith("given-"):
        if not script_of(canonical):        # a script without lists: letters of its own
            return permute(canonical, key, f"{kind}|{attempt}") + (
                _letters(key, more, _alphabet(canonical[0]), kind, canonical, attempt) if more > 0 else "")
    elif attempt >= CROWDED_FROM:            # numbers keep their format as long as it has room
        return _first_surrogate(kind, canonical, attempt, key) + ("." if kind == "ip" else "") \
            + _letters(key, attempt - CROWDED_FROM + 1, ALPHABETS[0], kind, canonical, attempt)
    return _first_surrogate(kind, canonical, attempt, key)


def _first_surrogate(kind: str, canonical: str, attempt: int, key: bytes) -> str:
    """The replacement of the value's own length and format (names grow by syllables)."""
    tweak = f"{kind}|{attempt}"
    if kind == "card":
        body = canonical[0] + permute(canonical[1:-1], key, tweak)
        offset = int(canonical[-1]) - _luhn_digit(canonical[:-1])
        return body + str((_luhn_digit(body) + offset) % 10)
    if kind == "phone":
        if canonical[0] != "+":     # national: ten digits, or eleven with the leading 1
            return canonical[:-10] + permute(canonical[-10:], key, tweak, "23456789")
        code = 2 if len(canonical) > 9 else 1
        return canonical[:code] + permute(canonical[code:], key, tweak, "23456789")
    if kind == "ip":
        number = 0
        for octet in map(int, canonical.split(".")):
            number = number * 256 + octet
        a, b = divmod(number, 65536)
        for r in range(6):
            a, b = b, (a + _draw(key, tweak, r, b)) % 65536
        return ".".join(str(x) for x in (a >> 8, a & 255, b >> 8, b & 255))
    if kind == "email":
        local, _, domain = canonical.rpartition("@")
        keep = next((d for d in RESERVED_DOMAINS if domain == d or domain.endswith("." + d)), domain.rpartition(".")[2])
        sub = domain[:len(domain) - len(keep)]
        return permute(local, key, tweak + "|" + domain) + "@" + permute(sub, key, tweak + "|d") + keep
    if kind == "iban":
        return canonical[:2] + permute(canonical[2:], key, tweak)
    if kind == "token" and re.fullmatch("[0-9a-f]+", canonical):
        return permute(canonical, key, tweak, hexadecimal=True)
    if kind == "access":
        return canonical[:4] + permute(canonical[4:], key, tweak)
    if kind.startswith("given-"):
        names = GIVEN[script_of(canonical)]
        own = names["m"] + names["f"] if kind[-1] == "n" else names[kind[-1]]
        base = own[(_draw(key, kind, canonical) + attempt) % len(own)].casefold()
        more = attempt - LIST_ATTEMPTS + 1      # then composed names, a syllable longer with every attempt
        return base if more <= 0 else base + "".join(_syllables(canonical, f"{kind}|{attempt}", key, more))
    if kind == "surname":
        return "".join(_syllables(canonical, tweak, key, 3 + max(0, attempt - 1)))
    return permute(canonical, key, tweak)


def _syllables(canonical: str, tweak: str, key: bytes, n: int) -> list[str]:
    own, out = SYLLABLES[script_of(canonical)], []
    for part in range(0, n, 16):        # a draw holds 16
        x = _draw(key, tweak, canonical) if not part else _draw(key, tweak, canonical, part)
        out += [own[(x >> (8 * i)) % len(own)] for i in range(min(16, n - part))]
    return out


def restore(kind: str, original: str, canonical: str) -> str:
    """The surrogate in the format of the mention: separators and letter case as there."""
    if kind in ("phone", "card", "ssn", "iban"):
        rest = iter(canonical.lstrip("+"))
        return "".join(next(rest, "") if c.isalnum() else c for c in original) + "".join(rest)
    if kind == "surname" or kind.startswith("given-"):
        return canonical.upper() if original.isupper() else canonical[0].upper() + canonical[1:]
    if kind == "email" and original.isupper():
        return canonical.upper()
    return canonical


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct entities of the corpus: ``kind``, ``canonical``."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            own = {(k, c) for t in texts(batch) if t for _, _, k, c in detect(t)}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.string()), pa.array([c for _, c in own], pa.string())],
                                             names=["kind", "canonical"])
    return docs.select(quoted(text_col).alias("text")).mapInArrow(run, "kind string, canonical string").distinct()


def settle(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """``kind, canonical, attempt`` of the entities whose first surrogate collided, settled so that all
    surrogates differ from each other and from every original.  ``found`` must be a written table.
    Names of every gender share one pool, as a reader cannot tell them apart."""
    def drawn(batches: Batches) -> Batches:
        for batch in batches:
            rows = list(zip(*[batch.column(i).to_pylist() for i in range(3)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(k, c, a, key) for k, c, a in rows], pa.string())],
                                             names=["kind", "canonical", "attempt", "surrogate"])
    shape = "kind string, canonical string, attempt int, surrogate string"
    pool = F.when(F.col("kind").startswith("given-"), F.lit("given")).otherwise(F.col("kind"))
    originals = found.select(pool.alias("_pool"), F.col("canonical").alias("_original")).distinct()
    state = written(found.withColumn("attempt", F.lit(0)).mapInArrow(drawn, shape), "drawn")
    while True:     # ends, as surrogates get longer with the attempts
        pooled = state.withColumn("pool", pool)
        taken = pooled.join(originals, (F.col("pool") == F.col("_pool")) & (F.col("surrogate") == F.col("_original")), "left_semi")
        keeper = (pooled.groupBy("pool", "surrogate").agg(F.min(F.struct("attempt", "kind", "canonical")).alias("k"),
                                                          F.count(F.lit(1)).alias("n")).where("n > 1")
                  .select(F.col("pool").alias("_pool"), F.col("surrogate").alias("_surrogate"), "k"))
        shared = (pooled.join(keeper, (F.col("pool") == F.col("_pool")) & (F.col("surrogate") == F.col("_surrogate")))
                  .where((F.col("kind") != F.col("k.kind")) | (F.col("canonical") != F.col("k.canonical"))))
        again = written(taken.select("kind", "canonical").union(shared.select("kind", "canonical")).distinct()
                        .select(F.col("kind").alias("_kind"), F.col("canonical").alias("_canonical")), "collisions")
        if again.isEmpty():
            return state.where("attempt > 0").select("kind", "canonical", "attempt")
        same = (F.col("kind") == F.col("_kind")) & (F.col("canonical") == F.col("_canonical"))
        redrawn = (state.join(again, same, "left_semi").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt"))
                   .mapInArrow(drawn, shape))
        state = written(state.join(again, same, "left_anti").unionByName(redrawn), "drawn")


def rewrite(text: str, attempts: dict[tuple[str, str], int], key: bytes = KEY) -> tuple[str, int]:
    """The text with its entities replaced, and their number."""
    out, at, n = [], 0, 0
    for begin, end, kind, canonical in detect(text):
        new = surrogate(kind, canonical, attempts.get((kind, canonical), 0), key)
        out += [text[at:begin], restore(kind, text[begin:end], new)]
        at, n = end, n + 1
    return ("".join(out) + text[at:], n) if n else (text, 0)


def secret_key(spark: SparkSession) -> bytes:
    """The session's ``tarmac.surrogates.key``; without one a random key, which nobody can use to undo the surrogates
    and no later run repeats."""
    given = spark.conf.get(KEY_CONF, None)
    return given.encode("utf-8") if given else secrets.token_bytes(32)


def replace_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes | None = None,
                     broadcast_limit: int = BROADCAST_EXCEPTIONS) -> DataFrame:
    """One row per document: id, ``n_entities``, ``text`` with surrogates.  ``key`` None takes ``secret_key``."""
    key = secret_key(docs.sparkSession) if key is None else key
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    exceptions = written(settle(written(entities(rows), "entities"), key), "exceptions")
    small = exceptions.count() <= broadcast_limit
    shared = {(r.kind, r.canonical): r.attempt for r in exceptions.collect()} if small else {}
    if not small:       # beyond the bound every document gets its own exceptions by joins
        rows = _with_own(rows, exceptions)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            own = [None] * batch.num_rows if small else batch.column(2).to_pylist()
            done = []
            for t, more in zip(texts(batch), own):
                mine = {(e["kind"], e["canonical"]): e["attempt"] for e in more} if more else shared
                done.append((None, 0) if t is None else rewrite(t, mine, key))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in done], pa.int32()),
                                              pa.array([t for t, _ in done], pa.string())], names=["id", "n_entities", "text"])
    return rows.mapInArrow(run, T.StructType([rows.schema.fields[0], T.StructField("n_entities", T.IntegerType()),
                                              T.StructField("text", T.StringType())])).withColumnRenamed("id", id_col)


def _with_own(rows: DataFrame, exceptions: DataFrame) -> DataFrame:
    """``id, text, own``: the exceptional entities of each document."""
    tagged = written(rows.withColumn("tag", F.monotonically_increasing_id()), "tagged")

    def mentions(batches: Batches) -> Batches:
        for batch in batches:
            out = [(tag, k, c) for tag, t in zip(batch.column(0).to_pylist(), texts(batch)) if t
                   for k, c in {(k, c) for _, _, k, c in detect(t)}]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(
                (pa.int64(), pa.string(), pa.string()))], names=["_tag", "kind", "canonical"])
    own = (tagged.select("tag", "text").mapInArrow(mentions, "_tag long, kind string, canonical string")
           .join(exceptions, ["kind", "canonical"]).groupBy("_tag")
           .agg(F.collect_list(F.struct("kind", "canonical", "attempt")).alias("own")))     # a document's own entities
    return tagged.join(own, F.col("tag") == F.col("_tag"), "left").select("id", "text", "own")
