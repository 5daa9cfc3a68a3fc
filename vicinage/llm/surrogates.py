"""Keyed surrogates for personal data and secrets.

Numbers, addresses and secrets are replaced by a keyed permutation of all strings of their own format
(a Feistel network on the positions that may vary), so the same entity gets the same surrogate in
every document, and two entities never share one: a permutation cannot collide. Names have no such
format; each of their words gets a word of the same gender and script, made from syllables by a keyed
hash, and a table of all distinct words of the corpus' names is checked for collisions and redrawn until
there are none. A word keeps its surrogate whatever title, first name or document it stands with, and
where a document names somebody with a title, the words of that name are replaced without it too.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize
from .batches import bound_batches, release

#: Distinct words of names up to which the checked table is broadcast; it is joined beyond.
BROADCAST_NAMES = 200_000

# Titles by gender, and syllables by script.
TITLES = {"Mr": "m", "Mister": "m", "Herr": "m", "Señor": "m", "Monsieur": "m", "господин": "m", "Господин": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Señora": "f", "Señorita": "f", "Madame": "f", "Mademoiselle": "f", "Mme": "f", "Госпожа": "f", "госпожа": "f", "Dr": "n", "Prof": "n", "Professor": "n"}
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi ga ge go ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe pi ra re ri ro sa se si so ta te ti to va ve vi vo".split(),
    "cyrillic": "ба бе би бо ва ве ви во да де ди до га ге ка ке ки ко ла ле ли ло ма ме ми мо на не ни но па пе пи ра ре ри ро са се си со та те ти то".split(),
    "greek": "βα βε βι βο γα γε δα δε δι δο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε σι τα τε τι το".split(),
    "cjk": "安 白 北 成 春 德 东 方 芳 峰 国 海 和 华 慧 建 江 杰 静 军 兰 丽 林 龙 美 明 宁 平 青 荣 瑞 山 树 松 天 文 武 小 新 秀 雪 雅 燕 阳 英 永 玉 云 志 中".split(),
}
ENDINGS = {("latin", "m"): "n", ("latin", "f"): "a", ("latin", "n"): "l", ("cyrillic", "m"): "н", ("cyrillic", "f"): "а", ("cyrillic", "n"): "ль", ("greek", "m"): "ς", ("greek", "f"): "α", ("greek", "n"): "ν"}

_NUMBER = re.compile(r"(?<![\w.+-])(?:(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?![\w-]|\.\d)|(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])|(?P<card>\d(?:[ -]?\d){12,18})(?![\w-])|(?P<phone>(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}|\+\d{7,15})(?![\w-]))")
_PLUS = re.compile(r"(?<![\w.+-])(?P<phone>\+\d{1,3}(?:[ .-]?(?:\(\d{1,4}\)|\d{1,4})){2,6}|\(\d{2,4}\) ?\d{3,4}[ .-]\d{3,4})(?![\w-])")
_LOCAL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}$")
_DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)(?P<key>[A-Z0-9]{16})(?![A-Za-z0-9])")
# How well-known kinds of access token begin.
_TOKEN_STARTS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "sk-", "xoxb-", "xoxp-", "xoxa-", "AIza", "eyJ")
_TOKEN = re.compile(r"(?<![\w-])(?:" + "|".join(_TOKEN_STARTS) + r")(?P<key>[A-Za-z0-9_.-]{16,}[A-Za-z0-9_-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_IPV6 = re.compile(r"(?<![\w:])[0-9A-Fa-f]{4}(?::{1,2}[0-9A-Fa-f]{1,4}){1,7}(?:::)?(?![\w:])")
_LABEL = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s{0,3}$")
_SECRET = re.compile(r"\s{0,3}[\"']?(?P<secret>[A-Za-z0-9_+/.-]{6,})")
_NAME = re.compile(r"(?<!\w)(" + "|".join(TITLES) + r")(\.? )((?:[^\W\d_a-zß-öø-ÿ][^\W\d_]*(?:[-'][^\W\d_]+)?)(?: (?:[^\W\d_a-zß-öø-ÿ][^\W\d_]*(?:[-'][^\W\d_]+)?))?)")


class Entity(NamedTuple):
    start: int
    end: int
    kind: str
    value: str


def _mod97(iban: str) -> bool:
    """Whether the check digits of an account number are right."""
    raw = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1


def _ipv6(value: str) -> bool:
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return True


def _mentions(text: str, found: list[Entity]) -> list[Entity]:
    """Words of the names in ``found`` where they stand without a title, spelt alike; a Latin word of
    one or two letters may be something else and stays."""
    words = {w for e in found if e.kind.startswith("name:") for w in e.value.split(" ") if len(w) > 2 or not w.isascii()}
    if not words:
        return []
    one = "(?:" + "|".join(map(re.escape, sorted(words, key=len, reverse=True))) + r")(?!\w)"
    taken, out, k = sorted((e.start, e.end) for e in found), [], 0
    for m in re.finditer(rf"(?<!\w){one}(?: {one})?", text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k == len(taken) or taken[k][0] >= m.end():
            out.append(Entity(m.start(), m.end(), "name:u", m[0]))
    return out


def detect(text: str) -> list[Entity]:
    """Entities of a whole text in order, none overlapping; of two that overlap the longer, and what
    the other holds beyond it as a secret. A token is the same entity with a label and without."""
    found, keys = [], []
    at = text.find("@")
    while at >= 0:
        local, domain = _LOCAL.search(text, max(0, at - 64), at), _DOMAIN.match(text, at + 1)
        if local and domain:
            found.append(Entity(local.start(), domain.end(), "email", text[local.start() : domain.end()]))
        at = text.find("@", at + 1)
    for m in _NUMBER.finditer(text):
        kind = m.lastgroup
        if kind != "ip" or all(int(x) < 256 for x in m["ip"].split(".")):
            found.append(Entity(m.start(), m.end(), kind, m[0]))
    if "+" in text or "(" in text:
        found += [Entity(m.start(), m.end(), "phone", m[0]) for m in _PLUS.finditer(text) if 7 <= sum(c.isdigit() for c in m[0]) <= 15]
    if "AKIA" in text or "ASIA" in text:
        keys += _KEY.finditer(text)
    if any(start in text for start in _TOKEN_STARTS):
        keys += [m for m in _TOKEN.finditer(text) if any(c.isdigit() for c in m["key"])]
    found += [Entity(m.start("key"), m.end("key"), "key", m["key"]) for m in keys]
    whole = {m.span() for m in keys}
    found += [Entity(m.start(), m.end(), "iban", m[0]) for m in _IBAN.finditer(text) if _mod97(m[0])]
    if "::" in text or text.count(":") > 6:
        found += [Entity(m.start(), m.end(), "ipv6", m[0]) for m in _IPV6.finditer(text) if _ipv6(m[0])]
    for mark in "=:":
        at = text.find(mark)
        while at >= 0:
            if _LABEL.search(text, max(0, at - 24), at) and (m := _SECRET.match(text, at + 1)) and any(c.isdigit() for c in m["secret"]):
                value, start = m["secret"].rstrip("."), m.start("secret")
                if (start, start + len(value)) not in whole:
                    found.append(Entity(start, start + len(value), "secret", value))
            at = text.find(mark, at + 1)
    found += [Entity(m.start(3), m.end(3), "name:" + TITLES[m[1]], m[3]) for m in _NAME.finditer(text)]
    out: list[Entity] = []
    for e in sorted(found, key=lambda e: (e.start, -e.end)):
        if not out or e.start >= out[-1].end:
            out.append(e)
        elif e.end > out[-1].end:
            last = out.pop()
            if last.kind.startswith("name:") or len(last.value) >= len(e.value):
                out += [last, Entity(last.end, e.end, "secret", text[last.end : e.end])]
            else:
                out += [Entity(last.start, e.start, "secret", text[last.start : e.start]), e]
    mentions = _mentions(text, out)
    return sorted(out + mentions) if mentions else out


def permute(key: bytes, tweak: str, number: int, size: int) -> int:
    """A keyed permutation of range(size): a Feistel network on the next power of four, walked until
    it lands inside."""
    if size < 2:
        return number
    half = (max(2, (size - 1).bit_length()) + 1) // 2
    mask = (1 << half) - 1
    while True:
        left, right = number >> half, number & mask
        for turn in range(8):
            word = hashlib.blake2b(f"{tweak}|{size}|{turn}|{right}".encode(), key=key, digest_size=half // 8 + 1).digest()
            left, right = right, left ^ (int.from_bytes(word, "big") & mask)
        number = left << half | right
        if number < size:
            return number


#: Letters and digits of a string beyond which it is permuted place by place, not as one number.
WIDE = 200
_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _permute_wide(key: bytes, tweak: str, value: str, places: list[tuple[int, str]]) -> str:
    """permute_string in time linear in the length: a Feistel network whose halves are places, each
    moved within its class by a keyed stream of the other half."""
    new, middle = [k.index(value[i]) for i, k in places], len(places) // 2
    for turn in range(8):
        here, there = (range(middle), new[middle:]) if turn % 2 else (range(middle, len(new)), new[:middle])
        seed = hashlib.blake2b(f"{tweak}|{turn}|".encode() + bytes(there), key=key).digest()
        stream = hashlib.shake_256(seed).digest(8 * len(here))
        for n, at in enumerate(here):
            new[at] = (new[at] + int.from_bytes(stream[8 * n : 8 * n + 8], "big")) % len(places[at][1])
    out = list(value)
    for (i, k), digit in zip(places, new):
        out[i] = k[digit]
    return "".join(out)


def permute_string(key: bytes, tweak: str, value: str, hexadecimal: bool = False) -> str:
    """A keyed permutation of the strings of one format: each ASCII letter and digit becomes one of
    its own class (of hexadecimal digits on request), and everything else stays."""
    classes = ("0123456789abcdef",) if hexadecimal else _CLASSES
    places = [(i, k) for i, c in enumerate(value) for k in classes if c in k]
    number, size, shape = 0, 1, list(value)
    for i, k in places:
        shape[i] = k[0]
    if len(places) > WIDE:
        return _permute_wide(key, tweak + "|" + "".join(shape), value, places)
    for i, k in places:
        number, size = number * len(k) + k.index(value[i]), size * len(k)
    number = permute(key, tweak + "|" + "".join(shape), number, size)
    for i, k in reversed(places):
        number, digit = divmod(number, len(k))
        shape[i] = k[digit]
    return "".join(shape)


def _luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _refill(value: str, digits: str) -> str:
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in value)


def _ip_class(n: int) -> int:
    """Which reserved or public part of the address space an address is in."""
    for k, (base, bits) in enumerate(((10 << 24, 8), ((172 << 24) + (16 << 16), 12), ((192 << 24) + (168 << 16), 16), (127 << 24, 8), (0, 8), (224 << 24, 3))):
        if n >> (32 - bits) == base >> (32 - bits):
            return k
    return -1


def _replace_ipv6(key: bytes, value: str) -> str:
    """Groups of zeros stay, the others become groups that are not zero, written as the value is."""
    groups = [int(g, 16) for g in ipaddress.IPv6Address(value).exploded.split(":")]
    own = [i for i, g in enumerate(groups) if g]
    tweak, number = "ipv6|" + ",".join(map(str, own)), 0
    for i in own:
        number = number << 16 | groups[i]
    while own:
        number = permute(key, tweak, number, 1 << 16 * len(own))
        new = [number >> 16 * k & 0xFFFF for k in range(len(own) - 1, -1, -1)]
        if all(new):
            for i, g in zip(own, new):
                groups[i] = g
            break
    written = value.split(":")
    short = "::" in value
    if short:  # the same places are left out
        head, _, tail = value.partition("::")
        left, right = len(head.split(":")) if head else 0, len(tail.split(":")) if tail else 0
        places = [*range(left), *range(8 - right, 8)]
        written = [*(head.split(":") if head else []), *(tail.split(":") if tail else [])]
    else:
        places = list(range(8))
    wide = all(len(g) == 4 for g in written)
    cells = [f"{groups[i]:04x}" if wide else f"{groups[i]:x}" for i in places]
    return ":".join(cells[:left]) + "::" + ":".join(cells[left:]) if short else ":".join(cells)


def replace_value(key: bytes, kind: str, value: str) -> str:
    """The surrogate of an entity with a format (all kinds but names)."""
    if kind == "email":
        local, domain = value.lower().rsplit("@", 1)
        host, top = domain.rsplit(".", 1)
        new = permute_string(key, "local|" + domain, local) + "@" + permute_string(key, "host|" + top, host) + "." + top
        return "".join(n.upper() if o.isupper() else n for n, o in zip(new, value))
    if kind == "ip":
        number = int.from_bytes(bytes(int(x) for x in value.split(".")), "big")
        own, new = _ip_class(number), permute(key, "ip", number, 1 << 32)
        while _ip_class(new) != own:
            new = permute(key, "ip", new, 1 << 32)
        return ".".join(str(x) for x in new.to_bytes(4, "big"))
    digits = "".join(c for c in value if c.isdigit())
    if kind == "card":
        valid, new = _luhn(digits), permute_string(key, "card", digits)
        while _luhn(new) != valid:
            new = permute_string(key, "card", new)
        return _refill(value, new)
    if kind == "phone":  # the country code stays; the same number without it gets the same surrogate
        tail = digits[-10:] if len(digits) >= 10 else digits
        return _refill(value, digits[: len(digits) - len(tail)] + permute_string(key, "phone", tail))
    if kind == "iban":  # the country stays, and the check digits are right again
        raw = value.replace(" ", "")
        body = permute_string(key, "iban|" + raw[:2], raw[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + raw[:2] + "00")) % 97
        rest = iter(f"{raw[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(rest) for c in value)
    if kind == "ipv6":
        return _replace_ipv6(key, value)
    plain = len(value) >= 12 and all(c in "0123456789abcdef" for c in value)
    return permute_string(key, kind + ("|hex" if plain else ""), value, hexadecimal=plain)


def canonical_name(value: str) -> str:
    return unicodedata.normalize("NFC", value).casefold()


def script_of(value: str) -> str:
    names = " ".join(unicodedata.name(c, "") for c in value if c.isalpha())
    return next((s for s, mark in (("cyrillic", "CYRILLIC"), ("greek", "GREEK"), ("cjk", "CJK")) if mark in names), "latin")


def make_name(key: bytes, gender: str, name: str, attempt: int) -> str:
    """A name of as many words as ``name``, of its script and the gender, drawn by a keyed hash."""
    script = script_of(name)
    syllables = SYLLABLES[script]
    draw = int.from_bytes(hashlib.blake2b(f"{gender}|{name}|{attempt}".encode(), key=key, digest_size=24).digest(), "big")
    words = []
    for k in range(len(name.split())):
        word = ""
        for _ in range(2 if script == "cjk" else 4):
            draw, at = divmod(draw, len(syllables))
            word += syllables[at]
        words.append((word + (ENDINGS.get((script, gender), "") if k == 0 else "")).capitalize())
    return " ".join(words)


def checked_names(names: DataFrame, key: bytes) -> DataFrame:
    """(name, gender, surrogate) for a table of words with one gender each: surrogates are drawn again
    until no two words share one and none is itself a name of the table."""
    def draw(attempt: int):
        def drawn(batches):
            for batch in batches:
                new = [make_name(key, g, n, attempt) for n, g in zip(batch.column("name").to_pylist(), batch.column("gender").to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("gender"), pa.array(new, pa.string()), pa.array([canonical_name(x) for x in new], pa.string())], ["name", "gender", "surrogate", "drawn"])

        return drawn

    todo, done, attempt = names.select("name", "gender"), None, 0
    real = names.select(F.col("name").alias("real")).distinct()
    while True:
        drawn = materialize(todo.mapInArrow(draw(attempt), "name string, gender string, surrogate string, drawn string"), "names")
        free = drawn.join(real, F.col("drawn") == F.col("real"), "left_anti")
        if done is not None:
            free = free.join(done.select("drawn"), "drawn", "left_anti")
        first = free.groupBy("drawn").agg(F.min(F.struct("name", "gender", "surrogate")).alias("x")).select("x.*", "drawn")
        done = first if done is None else done.unionByName(first)
        done = materialize(done, "names")
        todo = names.select("name", "gender").join(done.select("name", "gender"), ["name", "gender"], "left_anti")
        if todo.isEmpty():
            return done.select("name", "gender", "surrogate")
        attempt += 1


def rewrite(text: str, key: bytes, names: dict[str, str]) -> tuple[str, list[Entity]]:
    """The text with surrogates, and its entities (spans in the text as it was, their surrogates);
    ``names`` has the surrogate of every word of its names."""
    parts, spans, at = [], [], 0
    for e in detect(text):
        if e.kind.startswith("name:"):
            new = " ".join(names[canonical_name(w)].upper() if len(w) > 1 and w.isupper() else names[canonical_name(w)] for w in e.value.split(" "))
        else:
            new = replace_value(key, e.kind, e.value)
        parts += [text[at : e.start], new]
        spans.append(e._replace(value=new))
        at = e.end
    return "".join([*parts, text[at:]]) if parts else text, spans


SPANS = "array<struct<kind: string, start: int, end: int, surrogate: string>>"


def pseudonymize(documents: DataFrame, key: bytes, *, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, entities) and the columns of ``keep`` for every row, text with surrogates.

    A null text stays null and an empty one empty, without entities; texts without entities come back
    byte for byte; repeated rows get the same result; ties cannot occur, for entities do not overlap;
    rows without doc_id are rewritten too; an empty table gives no rows."""
    spark = documents.sparkSession
    bound_batches(spark)
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), *[F.col(k) for k in keep])

    def names_in(batches):
        """A row a word of a document's names; whether a title says that it is a man's or a woman's
        (of a name's last of several words only in Cyrillic, where it shows)."""
        for batch in batches:
            ids, words, men, women = [], [], [], []
            for ident, value in zip(batch.column("id").to_pylist(), batch.column("_text").to_pylist()):
                if value and _NAME.search(value):
                    own = set()
                    for e in detect(value):
                        if e.kind.startswith("name:"):
                            for k, word in enumerate(e.value.split(" ")):
                                gender = e.kind[5:] if k == 0 or script_of(word) == "cyrillic" else "n"
                                own.add((canonical_name(word), gender))
                    for word, gender in own:
                        ids.append(ident)
                        words.append(word)
                        men.append(gender == "m")
                        women.append(gender == "f")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(words, pa.string()), pa.array(men, pa.bool_()), pa.array(women, pa.bool_())], ["id", "name", "man", "woman"])

    ident = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5("_text")))
    named = materialize(rows.select(ident.alias("id"), "_text").mapInArrow(names_in, "id string, name string, man boolean, woman boolean"), "named")
    words = named.groupBy("name").agg(F.bool_or("man").alias("man"), F.bool_or("woman").alias("woman"))
    gender = F.when(F.col("man") & ~F.col("woman"), "m").when(F.col("woman") & ~F.col("man"), "f").otherwise("n")
    distinct = materialize(words.select("name", gender.alias("gender")), "names")
    count = distinct.count()
    table, sent = None, None
    if count:
        table = checked_names(distinct, key)
    if count <= BROADCAST_NAMES:
        pairs = table.toArrow().to_pylist() if table is not None else []
        sent = spark.sparkContext.broadcast({r["name"]: r["surrogate"] for r in pairs})
        source = rows.withColumn("_names", F.lit(None).cast("array<struct<name: string, surrogate: string>>"))
    else:
        own = named.select("id", "name").distinct().join(table.select("name", "surrogate"), "name").groupBy("id").agg(F.collect_list(F.struct("name", "surrogate")).alias("_names"))
        source = rows.withColumn("_id", ident).join(own.withColumnRenamed("id", "_of"), F.col("_id") == F.col("_of"), "left").drop("_id", "_of")
    columns = ["doc_id", *keep]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"]

    def rewritten(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts, spans = [], []
                for value, own in zip(part.column("_text").to_pylist(), part.column("_names").to_pylist()):
                    names = sent.value if sent is not None else {r["name"]: r["surrogate"] for r in own or ()}
                    new, found = (None, []) if value is None else rewrite(value, key, names)
                    texts.append(new)
                    spans.append([{"kind": e.kind.split(":")[0], "start": e.start, "end": e.end, "surrogate": e.value} for e in found])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(texts, pa.string()), pa.array(spans, kind)], [*columns, "text", "entities"])
        release()

    return source.mapInArrow(rewritten, ", ".join([*fields, "text string", f"entities {SPANS}"]))


#: The key of the registered query; a deployment passes its own secret.
QUERY_KEY = b"vicinage surrogate key"


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymize(spark.read.parquet(f"{sf_dir}/documents.parquet"), QUERY_KEY)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["kind"]))), ",")
    return found.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), kinds.alias("kinds"))
