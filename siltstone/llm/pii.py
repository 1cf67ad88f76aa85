"""Replacement of personal data and secrets by keyed surrogates.

Entities are found by form and checks, and reduced to a canonical value, so that spellings of one entity share a
surrogate in every document (coreference). A name is found behind a title; all other mentions of it or of its parts in
the same document are parts of the same surrogate. A surrogate is drawn from a keyed hash of the kind and the canonical
value: digits stay digits, letters stay letters of their script, valid checksums stay valid, and names are drawn from
pools of the same gender and script; the text's own layout and case are then put on it. All canonical values of the
corpus are gathered to find surrogates that two values share or that are values of the corpus themselves; those are
drawn again, from some attempt on with further characters, and at last told apart by their rank, so distinct entities
stay distinct.
"""

from __future__ import annotations

import hmac
import ipaddress
import re
import string
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, materialize, sized_join, small_batches

KEY = b"siltstone surrogates"
ROUNDS = 40
#: From this attempt on, mail addresses and secrets get a further character at each.
GROW = 4
#: Titles, with the gender they show, and pools of names by gender and script.
TITLES = {
    "Mr": "m", "Mr.": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr.": "m", "Господин": "m",
    "Mrs": "f", "Mrs.": "f", "Ms": "f", "Ms.": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra.": "f", "Госпожа": "f",
    "Dr.": "n", "Dr": "n", "Prof.": "n", "Профессор": "n",
}
GIVEN = {
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Nils Oscar Paul Ralph Simon Thomas Victor".split(),
    ("f", "latin"): "Anna Bianca Clara Diana Emma Flora Greta Helena Irene Julia Karla Laura Maria Nina Olga Paula Rosa Sofia Teresa Vera".split(),
    ("n", "latin"): "Alex Andrea Chris Dominique Eden Frankie Jamie Kim Lee Marian Nico Pat Quinn Robin Sam Sascha Sidney Terry Toni Val".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Николай Олег Павел Роман Семён Тимур Фёдор Юрий Яков Артём".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Клара Лидия Мария Нина Ольга Полина Раиса София Тамара Ульяна Юлия Яна".split(),
    ("n", "cyrillic"): "Саша Женя Валя Шура Слава Паша Миша Никита Лёша Гриша Костя Ваня Петя Вася Коля Дима Толя Сеня Тоша Федя".split(),
}
FAMILY = {
    "latin": "Adler Baker Costa Dubois Ellis Fischer Garcia Hansen Ivers Jensen Keller Lopez Moreau Nielsen Olsen Perez Quint Rossi Silva Weber".split(),
    "cyrillic": "Абраменко Бондаренко Василенко Гончаренко Дудник Ермоленко Журавель Захаренко Игнатенко Коваль Литвин Мельник Назаренко Остапенко Павленко Романюк Савчук Ткач Усенко Шевченко".split(),
}
_TITLE = "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True))
_GENDER = {t.casefold(): g for t, g in TITLES.items()}
#: Titles that in small letters are mostly other words: there they need a name of two words.
_WORDLIKE = {"miss", "ms"}
_NAME = r"[^\W\d_a-zа-яё][^\W\d_]+(?:-[^\W\d_a-zа-яё][^\W\d_]+)*"
PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]*\w@\w[\w-]*(?:\.\w[\w-]*)+)"
    r"|(?P<secret>(?i:password|passwd|pwd|secret|token|api[-_ ]?key)[\"']?\s*[:=]\s*[\"']?(?P<secret_value>[^\s\"',;]{6,}))"
    r"|(?P<awskey>(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9]))"
    r"|(?P<apikey>(?<![A-Za-z0-9_-])(?:sk|pk|rk)[-_](?:live[-_]|test[-_]|proj[-_])?[A-Za-z0-9_-]{20,}|(?<![A-Za-z0-9])gh[oprsu]_[A-Za-z0-9]{30,}|(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,})"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d))"
    r"|(?P<ip6>(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}(?:\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f]{0,4})(?![\w:]))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d[\d .-]{5,13}\d(?!\d)|(?<![\d-])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\d-])|(?<![\d.-])0\d{2,4} \d{3,4} \d{3,4}(?![\d.-]))"
    r"|(?P<card>(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-]))"
    rf"|(?P<name>(?<!\w)(?P<title>(?i:{_TITLE})) (?P<who>{_NAME}(?: {_NAME})?))"
)
_CAPITAL = re.compile(rf"(?<!\w){_NAME}")
_LIKELY, _COLONS = re.compile(r"[@0-9]|(?:sk|pk|rk|gh[oprsu]|xox[abprs])[-_]"), re.compile(r"[0-9A-Fa-f:]:[0-9A-Fa-f:]")
_WORDS = ("password", "passwd", "pwd", "secret", "token", "key")


def luhn(digits: str) -> int:
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def address6(text: str) -> str | None:
    """The canonical form of an IPv6 address; None for other texts, and for words of hexadecimal letters between colons."""
    try:
        value = str(ipaddress.IPv6Address(text))
    except ValueError:
        return None
    return value if re.search(r"\d", text) or len(re.findall(r"\w+", text)) > 2 else None


def _likely(text: str) -> bool:
    """Whether a text can have entities; cheap, and true for every text that has some."""
    if _LIKELY.search(text) or ":" in text and _COLONS.search(text):
        return True
    lower = text.casefold()
    if (":" in text or "=" in text) and any(w in lower for w in _WORDS):
        return True
    for title in _GENDER:
        at = lower.find(f"{title} ")
        while at >= 0:
            if at == 0 or not (lower[at - 1].isalnum() or lower[at - 1] == "_"):
                return True
            at = lower.find(f"{title} ", at + 1)
    return False


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value) of the entities of a text, in order and apart."""
    if not text:
        return []
    if not _likely(text):
        return []
    out, names, at = [], [], 0
    while m := PATTERN.search(text, at):
        at = m.end()
        kind = m.lastgroup
        begin, end = m.span("secret_value") if kind == "secret" else m.span("who") if kind == "name" else m.span()
        value = text[begin:end]
        if kind == "email":
            value = value.lower()
        elif kind == "ip":
            if max(map(int, value.split("."))) > 255:
                continue
            value = ".".join(str(int(x)) for x in value.split("."))
        elif kind == "ip6":
            kind, value = "ip", address6(value)
            if value is None:
                # what begins inside may be another entity
                at = m.start() + 1
                continue
        elif kind == "iban":
            value = value.replace(" ", "")
            if iban_rest(value) != 1:
                continue
        elif kind in ("phone", "card", "ssn"):
            plus = "+" * (kind == "phone" and value.startswith("+"))
            value = plus + re.sub(r"\D", "", value)
            if kind == "card" and luhn(value):
                # not a card; what begins behind its first digit group may be another entity
                at = begin + len(re.match(r"\d+", text[begin:end])[0])
                continue
            if plus and value.startswith("+1") and len(value) == 12:
                value = value[2:]
        elif kind == "name":
            if m["title"] in _WORDLIKE and " " not in value:
                at = m.end("title")
                continue
            names.append((begin, end, _GENDER[m["title"].casefold()], value))
            continue
        out.append((begin, end, kind, value))
    return sorted(out + _mentions(text, names, out)) if names else out


def _mentions(text: str, names: list[tuple[int, int, str, str]], others: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """The names behind titles, (start, end, gender, text), and all mentions of them or their parts apart from ``others``.

    A title without gender joins the person whose name has one. A part stands for the last person with it before that
    place, or the first after it, and behind a title for one whose gender fits.
    """
    genders: dict[str, set[str]] = {}
    for _, _, g, who in names:
        if " " in who:
            genders.setdefault(who.casefold(), set()).add(g)
    # Words of a name, and a gender: (place, gender, canonical value), in order.
    persons: dict[str, dict[str, list[tuple[int, str, str]]]] = {}

    def known(key: str, place: int, gender: str) -> str | None:
        before, after = [], []
        for g, there in persons.get(key, {}).items():
            if "n" in (gender, g) or gender == g:
                k = bisect_left(there, (place + 1,))
                before += there[k - 1 : k] if k else []
                after.append(there[0])
        return max(before, default=min(after, default=None))[2] if after else None

    def add(keys, place: int, gender: str, who: str) -> str:
        script = "cyrillic" if re.search("[А-яЁё]", who) else "latin"
        value = f"{gender}|{script}|{who}"
        for k in keys:
            insort(persons.setdefault(k, {}).setdefault(gender, []), (place, gender, value))
        return value

    out = []
    for begin, end, g, who in names:
        if " " in (key := who.casefold()):
            sure = genders[key] - {"n"}
            g = next(iter(sure)) if g == "n" and len(sure) == 1 else g
            out.append((begin, end, "name", add((key, *key.split(" ")), begin, g, key)))
    for begin, end, g, who in names:
        if " " not in (key := who.casefold()):
            out.append((begin, end, "name", known(key, begin, g) or add((key,), begin, g, key)))
    taken = sorted([(a, b) for a, b, *_ in (*out, *others)])
    words = [m for m in _CAPITAL.finditer(text) if not (k := bisect_right(taken, (m.start(), len(text)))) or taken[k - 1][1] <= m.start()]
    starts = [a for a, _ in taken]
    words = [m for m in words if (k := bisect_left(starts, m.start())) == len(starts) or starts[k] >= m.end()]
    skip = -1
    for m, after in zip(words, [*words[1:], None]):
        if m.start() <= skip:
            continue
        if after and text[m.end() : after.start()] == " " and (value := known(f"{m[0]} {after[0]}".casefold(), m.start(), "n")):
            skip = after.start()
            out.append((m.start(), after.end(), "name", value))
        elif value := known(m[0].casefold(), m.start(), "n"):
            out.append((m.start(), m.end(), "name", value))
    return out


class Stream:
    """Numbers below a bound from a keyed hash of (kind, value, attempt)."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.seed, self.at, self.pool = f"{kind}\0{value}\0{attempt}".encode("utf-8", "surrogatepass"), 0, b""
        self.key = key

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.digest(self.key, self.seed + self.at.to_bytes(4, "big"), "sha256")
            self.at += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x * n >> 32

    def pick(self, items):
        return items[self.below(len(items))]


def _like(c: str, s: Stream, hexa: bool) -> str:
    """A character of the same class: digit, hex digit, or a letter of the same case and script."""
    if hexa and c in string.hexdigits:
        return s.pick("0123456789abcdef") if not c.isupper() else s.pick("0123456789ABCDEF")
    if c.isdigit():
        return s.pick(string.digits)
    if "a" <= c <= "z":
        return s.pick(string.ascii_lowercase)
    if "A" <= c <= "Z":
        return s.pick(string.ascii_uppercase)
    if "а" <= c <= "я":
        return chr(0x430 + s.below(32))
    if "А" <= c <= "Я":
        return chr(0x410 + s.below(32))
    if c.isalpha():
        return s.pick("áäéèíöóúüñç") if c.islower() else s.pick("ÁÄÉÈÍÖÓÚÜÑÇ")
    return c


def _any(s: Stream, n: int, of: str = string.ascii_letters + string.digits) -> str:
    return "".join(s.pick(of) for _ in range(n))


def surrogate(kind: str, value: str, attempt: int = 0, key: bytes = KEY) -> str:
    """The canonical surrogate of a canonical value; another for each attempt."""
    s = Stream(key, kind, value, attempt)
    more = max(0, attempt - GROW + 1)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        host, dot, top = domain.rpartition(".")
        d = Stream(key, "domain", domain, 0)  # one domain stays one domain
        return "".join(_like(c, s, False) for c in local) + _any(s, more, string.ascii_lowercase + string.digits) + "@" + "".join(_like(c, d, False) for c in host) + dot + top
    if kind == "ip" and ":" in value:
        return str(ipaddress.IPv6Address((0x2000 + s.below(0x2000) << 112) + sum(s.below(1 << 16) << 16 * k for k in range(7))))
    if kind == "ip":
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "iban":
        body = "".join(s.pick(string.digits) if c.isdigit() else s.pick(string.ascii_uppercase) for c in value[4:])
        return value[:2] + f"{98 - iban_rest(value[:2] + '00' + body):02d}" + body
    if kind == "card":
        out = value[0] + "".join(s.pick(string.digits) for _ in value[1:])
        return out if luhn(value) else next(x for x in (out[:-1] + d for d in string.digits) if not luhn(x))
    if kind == "phone":
        plus = "+" * value.startswith("+")
        digits = value[len(plus) :]
        area = max(1, len(digits) - 9) if plus else 0
        return plus + digits[:area] + "".join(str(2 + s.below(8)) if k == 0 else s.pick(string.digits) for k in range(len(digits) - area))
    if kind == "ssn":
        return f"{1 + s.below(665):03d}{1 + s.below(99):02d}{1 + s.below(9999):04d}"
    if kind == "name":
        gender, script, who = value.split("|", 2)
        # no part of a name stands for itself
        given, family = ([x for x in pool if x.casefold() not in re.split("[ -]", who)] for pool in (GIVEN[gender, script], FAMILY[script]))
        last = s.pick(family) + "".join("-" + s.pick(family) for _ in range(attempt))
        return f"{gender}|{script}|" + (f"{s.pick(given)} {last}" if " " in who else last).casefold()
    if kind == "apikey":
        head = re.match(r"(?:[a-z]{2}[-_](?:(?:live|test|proj)[-_])?|gh[a-z]_|xox[a-z]-)", value)[0]
        return head + "".join(_like(c, s, False) for c in value[len(head) :]) + _any(s, more)
    if kind == "awskey":
        return value[:4] + "".join(s.pick(string.ascii_uppercase + "234567") for _ in value[4:])
    hexa = len(value) >= 8 and all(c in string.hexdigits for c in value)
    if not any(map(str.isalnum, value)):
        return _any(s, len(value) + more)
    return "".join(_like(c, s, hexa) for c in value) + _any(s, more)


def ranked(kind: str, value: str, last: str, rank: int) -> str:
    """A surrogate of a value by its rank among those of its kind that no draw could place: ``last`` with 20 digits more."""
    if kind == "email":
        local, _, domain = last.rpartition("@")
        return f"{local}{rank:020d}@{domain}"
    return f"{last}.{rank:020d}" if kind == "ip" else f"{last}{rank:020d}"


def render(found: str, kind: str, value: str, of: str) -> str:
    """A canonical surrogate in the layout of the text it stands for, whose canonical value is ``of``."""
    if kind == "name":
        words, whole = value.split("|", 2)[2].split(" "), of.split("|", 2)[2]
        if " " in whole and " " not in found:
            words = words[-1:] if found.casefold() == whole.split(" ")[1] else words[:1]
        return " ".join("-".join(x.capitalize() for x in w.split("-")) for w in words)
    if kind in ("phone", "card", "ssn", "iban"):
        value = value.lstrip("+")
        if kind == "phone" and found.startswith("+") and not of.startswith("+"):
            value = "1" + value
        rest = iter(value)
        return "".join(next(rest, "") if c.isalnum() else c for c in found) + "".join(rest)
    if kind == "email":
        return "".join(v.upper() if c.isupper() else v for c, v in zip(found, value)) if len(found) == len(value) else value
    return value


def replace(text: str | None, chosen: Callable[[str, str], str]) -> tuple[str | None, list[str]]:
    """The text with every entity replaced, and the entities' kinds; ``chosen(kind, value)`` is the surrogate."""
    found = find(text)
    if not found:
        return text, []
    out, at = [], 0
    for begin, end, kind, value in found:
        out += [text[at:begin], render(text[begin:end], kind, chosen(kind, value), value)]
        at = end
    return "".join([*out, text[at:]]), [kind for _, _, kind, _ in found]


def entities(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct (kind, value) of all texts."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(sorted({(k, v) for t in b["_t"] for _, _, k, v in find(t)}), columns=["kind", "value"])

    return df.select(F.col(text_col).alias("_t")).mapInPandas(run, "kind string, value string").distinct()


def settled(found: DataFrame, key: bytes = KEY, rounds: int = ROUNDS) -> DataFrame:
    """(kind, value, surrogate) for all values whose first surrogate is not free; all surrogates together are distinct and new."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(surrogate=[surrogate(k, v, n, key) for k, v, n in zip(b["kind"], b["value"], b["attempt"])])

    def drawn(rows: DataFrame) -> DataFrame:
        return rows.select("kind", "value", "attempt").mapInPandas(draw, "kind string, value string, attempt int, surrogate string")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(attempt=b["attempt"] + 1, surrogate=[ranked(*x) for x in zip(b["kind"], b["value"], b["surrogate"], b["rank"])]).drop(columns="rank")

    def numbered(rows: DataFrame) -> DataFrame:
        # ranked within what shares a surrogate, so that no task holds all; longer than any drawn or found value of its form
        order = Window.partitionBy("kind", "surrogate").orderBy("value")
        rows = rows.withColumn("rank", F.row_number().over(order)).select("kind", "value", "attempt", "surrogate", "rank")
        return rows.mapInPandas(place, "kind string, value string, attempt int, surrogate string")

    # A name seen behind a title without gender is the one of its only gender elsewhere.
    bare = F.substring("value", 3, 1 << 30)
    sides = found.filter("kind = 'name'").select(F.substring("value", 1, 1).alias("g"), bare.alias("who"))
    sure = sides.filter("g <> 'n'").groupBy("who").agg(F.count(F.lit(1)).alias("c"), F.min("g").alias("g")).filter("c = 1")
    twins = sides.filter("g = 'n'").select("who").join(sure.select("who", F.concat_ws("|", "g", "who").alias("_as")), "who")
    twins = materialize(twins.select(F.lit("name").alias("kind"), F.concat(F.lit("n|"), "who").alias("value"), "_as"))
    values = found.select("kind", F.col("value").alias("surrogate"))
    found = found.join(twins, ["kind", "value"], "left_anti")
    now = materialize(drawn(found.withColumn("attempt", F.lit(0))))
    for n in range(rounds + 1):
        taken = now.join(values, ["kind", "surrogate"], "left_semi").select("kind", "value")
        # The first holder of a surrogate by aggregates, as single-word names of a whole corpus share few of them.
        holders = now.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("attempt", "value")).alias("first")).filter("c > 1")
        holders = materialize(holders.select("kind", "surrogate", F.col("first.value").alias("first")))
        second = sized_join(now, holders, ["kind", "surrogate"], "inner", F.octet_length("surrogate") + F.octet_length("first") + 64).filter("value <> first").select("kind", "value")
        again = materialize(taken.union(second).distinct())
        if again.isEmpty():
            break
        lost = now.join(again, ["kind", "value"], "left_semi")
        moved = drawn(lost.withColumn("attempt", F.col("attempt") + 1)) if n < rounds else numbered(lost)
        now = materialize(now.join(again, ["kind", "value"], "left_anti").union(moved))
    same = twins.join(now.filter("kind = 'name'").select(F.col("value").alias("_as"), "surrogate"), "_as")
    return now.filter("attempt > 0").select("kind", "value", "surrogate").union(same.select("kind", "value", "surrogate"))


def pseudonymize(df: DataFrame, text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """``df`` with entities replaced in its texts, and pii_kinds, the kinds found, in order.

    Null and empty texts stay as they are. Repeated rows get the same texts. Columns of ``df`` stay, but for any named
    pii_kinds, which is replaced. An empty table gives no rows. Two values get the same surrogate nowhere in the
    corpus, and no surrogate is a value found in it.
    """
    small_batches(df.sparkSession)
    fields = [c for c in df.columns if c != "pii_kinds"]
    # Columns of our own by names that none of the table's has.
    done, digest, other = (f"_{c}" + "_" * max(map(len, df.columns)) for c in ("done", "digest", "other"))
    redrawn = materialize(settled(materialize(entities(df, text_col)), key))
    size = redrawn.agg(F.sum(F.octet_length("value") + F.octet_length("surrogate") + 200)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        shared = df.sparkSession.sparkContext.broadcast({(r.kind, r.value): r.surrogate for r in redrawn.collect()})

        @F.pandas_udf(RESULT)
        def run(texts: pd.Series) -> pd.DataFrame:
            other = shared.value
            choose = lambda kind, value: other.get((kind, value)) or surrogate(kind, value, 0, key)
            return pd.DataFrame([replace(t, choose) for t in texts], columns=["t", "k"])

        out = df.withColumn(done, run(text_col))
    else:
        out = _joined(df, text_col, redrawn, key, done, digest, other)
    return out.select(*[F.col(f"{done}.t").alias(c) if c == text_col else c for c in fields], F.col(f"{done}.k").alias("pii_kinds"))


RESULT = "t string, k array<string>"


def _joined(df: DataFrame, text_col: str, redrawn: DataFrame, key: bytes, done: str = "_done", digest: str = "_digest", other: str = "_other") -> DataFrame:
    """The same where the values drawn again are too many to broadcast: they are joined to the texts that have them."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(sorted({(h, k, v) for h, t in zip(b["_h"], b["_t"]) for _, _, k, v in find(t)}), columns=["_h", "kind", "value"])

    sha = F.sha2(F.col(text_col), 256)
    has = df.select(sha.alias("_h"), F.col(text_col).alias("_t")).mapInPandas(listed, "_h string, kind string, value string").distinct()
    per = has.join(redrawn, ["kind", "value"]).groupBy("_h").agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("_other"))

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series, others: pd.Series) -> pd.DataFrame:
        out = []
        for t, rows in zip(texts, others):
            other = {(r["kind"], r["value"]): r["surrogate"] for r in rows} if rows is not None else {}
            out.append(replace(t, lambda kind, value: other.get((kind, value)) or surrogate(kind, value, 0, key)))  # noqa: B023
        return pd.DataFrame(out, columns=["t", "k"])

    per = per.select(F.col("_h").alias(digest), F.col("_other").alias(other))
    return df.withColumn(digest, sha).join(per, digest, "left").withColumn(done, run(text_col, other))
