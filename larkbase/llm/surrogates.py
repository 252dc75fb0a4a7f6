"""Surrogates for personal data.

Entities are found by patterns. Each gets a replacement of its own kind that depends on a key and on the entity's
canonical form alone, so an entity is replaced alike wherever and however it is written. Characters keep their
class: a digit stays a digit, a letter stays a letter of its script, punctuation stays. Names come from lists by
gender and script; card numbers that satisfy the Luhn rule still do.

Distinctness is checked over the whole corpus: a replacement that another entity already has, or that is itself an
entity of the corpus, is drawn again, round by round, until every entity has one of its own. All of it is DataFrame
operations.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_small, key_filter, passing, written

# Courtesy titles that precede names, by gender, and names by script and gender.
TITLES = {
    "m": ("Mr.", "Mr", "Herr", "Señor", "Monsieur", "господин"),
    "f": ("Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Señora", "Madame", "госпожа"),
    "n": ("Dr.", "Dr", "Prof.", "Prof"),
}
GIVEN = {
    "latin_m": "Adam Bruno Carl David Emil Felix Georg Henry Ivan Jonas Karl Leo Martin Noah Oscar Paul Robert Simon Thomas Victor".split(),
    "latin_f": "Anna Berta Clara Diana Emma Flora Greta Helen Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sara Tina Vera".split(),
    "greek_m": "Αλέξανδρος Βασίλης Γιώργος Δημήτρης Κώστας Λεωνίδας Μάρκος Νίκος Παύλος Σωτήρης".split(),
    "greek_f": "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Κατερίνα Μαρία Σοφία Χριστίνα".split(),
    "cyrillic_m": "Алексей Борис Виктор Григорий Дмитрий Иван Максим Николай Павел Сергей".split(),
    "cyrillic_f": "Анна Вера Галина Дарья Елена Ирина Мария Надежда Ольга Татьяна".split(),
}
SURNAMES = {
    "latin": "Abel Barlow Castell Dorn Ebert Falk Garner Hale Ibsen Jansen Keller Lang Marlow Norden Orlov Palmer Quint Renner Salas Thorn Ulm Vidal Weber Xavier Yates Zeller".split(),
    "greek": "Αντωνίου Βλάχος Γεωργίου Δημητρίου Ιωάννου Κωνσταντίνου Λάμπρου Μακρής Νικολάου Οικονόμου Παππάς Σταύρου".split(),
    "cyrillic": "Абрамов Беляев Власов Громов Денисов Ершов Жуков Зуев Ильин Козлов Лебедев Морозов Носов Орлов Петров".split(),
}

for _s in ("latin", "greek", "cyrillic"):
    GIVEN[f"{_s}_n"] = GIVEN[f"{_s}_m"] + GIVEN[f"{_s}_f"]

_T = "|".join(t.replace(".", r"\.") for x in TITLES.values() for t in x)
_NAME = r"\p{Lu}[\p{L}'’-]{1,40}"
# Patterns by kind, in order of preference. Each group begins with what one character refuses at almost every place.
_KEYWORD = r"(?i:token|secret|password|passwd|api_?key|access_?key)"
_QUOTED = rf"""(?<=["'])(?<={_KEYWORD}["']? ?[=:] ?["'])[^"'\s]{{8,}}(?=["'])"""
# Without quotes a value needs a digit, so that prose such as "password: required" stays.
_BARE = rf"""(?<=[=: ])(?:(?<={_KEYWORD} ?[=:] ?)|(?<=(?i:bearer) ))(?=[^\s"']*[0-9])[^\s"',;<>(){{}}\[\]]{{8,}}"""
_TOKEN = r"(?<![\p{L}\p{N}_-])(?:A[KS]IA[A-Z0-9]{16}|sk-[A-Za-z0-9_-]{20,}|gh[oprsu]_[A-Za-z0-9]{30,})(?![\p{L}\p{N}_-])"
_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
_PHONE = r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\p{L}\p{N}])"
_CARD = r"(?<![\p{L}\p{N}])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\p{L}\p{N}])"
_IP = r"(?<![\p{L}\p{N}.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?[\p{L}\p{N}])"
_SSN = r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])"
_IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
_GIVEN = rf"(?<= )(?<=(?<!\p{{L}})(?:{_T}) ){_NAME}(?= \p{{Lu}})"
_SURNAME = rf"(?<= )(?<=(?<!\p{{L}})(?:{_T}) (?:{_NAME} )?){_NAME}"
ANY = rf"{_QUOTED}|{_BARE}|(?=[Asg]){_TOKEN}|{_EMAIL}|(?=[0-9+(])(?:{_PHONE}|{_CARD}|{_IP}|{_SSN})|(?=\p{{Lu}})(?:{_IBAN}|{_GIVEN}|{_SURNAME})"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Letters from which letters of other scripts are drawn, by the script's name in patterns.
LETTERS = {
    "Cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "Greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "Armenian": "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆ",
    "Georgian": "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ",
    "Hebrew": "אבגדהוזחטיכלמנסעפצקרשת",
    "Arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "Devanagari": "कखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह",
    "Thai": "กขคงจฉชซญดตถทธนบปผฝพฟภมยรลวสหอฮ",
    "Hangul": "가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허",
    "Hiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ",
    "Katakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ",
    "Han": "一三上中人大天小山川日月木水火王田石禾竹米羊耳花言谷貝車金門雨青音風馬魚鳥黃",
}
_SIGNS = "!#$%&*+-=?@^_~"
#: Rounds after which a replacement may be an entity of the corpus, and may grow if its kind allows that.
CROWDED = 8
#: Rounds after which the space of a kind counts as used up.
ROUNDS = 64


def may_have_entities(text: Column) -> Column:
    """False only for texts in which no pattern can match: no digit, no @, no secret's quote and no title."""
    words = [a + b + c for a in "=:" for b in ("", " ") for c in "\"'"] + [f"{t} " for x in TITLES.values() for t in x]
    found = text.rlike("[0-9@]")
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def _kind(match: Column, before: Column, after: Column) -> Column:
    """The kind of a match, by what it looks like and by the gaps around it. A lone name after a title is a surname."""
    secret = before.rlike(rf"""(?:{_KEYWORD}["']? ?[=:] ?["']?|(?i:bearer) )$""") | match.rlike(rf"^{_TOKEN}$")
    kind = F.when(secret, "secret").when(F.contains(match, F.lit("@")), "email")
    kind = kind.when(match.rlike(r"^[A-Z]{2}\d{2}"), "iban").when(match.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
    kind = kind.when(match.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip").when(match.rlike(r"^\d{13,19}$|^\d{4}(?:[ -]\d{4}){3}$"), "card")
    kind = kind.when(match.rlike(r"^[+(\d]"), "phone")
    script = F.when(match.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(match.rlike(r"^\p{IsGreek}"), "greek").when(match.rlike(r"^\p{IsLatin}"), "latin").otherwise("other")
    for gender, titles in TITLES.items():
        ends = "|".join(t.replace(".", r"\.") for t in titles)
        kind = kind.when(before.rlike(rf"(?<!\p{{L}})(?:{ends}) $") & (after == " "), F.concat(F.lit("name_"), script, F.lit(f"_{gender}")))
    return kind.otherwise(F.concat(F.lit("surname_"), script))


def _canonical(kind: Column, match: Column) -> Column:
    """What two ways of writing an entity have in common."""
    digits = F.regexp_replace(match, r"\D", "")
    return (
        F.when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(match, " ", ""))
        .when(kind.isin("ip", "secret"), match)
        .otherwise(F.lower(match))
    )


def _draw(seed: Column, place: Column, n: int) -> Column:
    """A number below n for a place, from a seed that only the key gives."""
    return F.pmod(F.xxhash64(seed, place), F.lit(n)).cast("int")


def _pick(values: str | list[str], number: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), number)


def _like(text: Column, seed: Column) -> Column:
    """Each letter and digit replaced by another of its class and script. All-hexadecimal texts stay so.

    Other characters stay, but in a text that has no letters or digits each becomes another sign.
    """
    hexadecimal = text.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$")
    signs = ~text.rlike(r"[\p{L}\p{N}]")

    def one(c: Column, i: Column) -> Column:
        n = F.when(hexadecimal, _draw(seed, i, 6)).otherwise(_draw(seed, i, 26))
        drawn = (
            F.when(c.between("0", "9"), _draw(seed, i, 10).cast("string"))
            .when(c.between("a", "z"), _pick(list(_LOWER), n))
            .when(c.between("A", "Z"), _pick(list(_UPPER), n))
        )
        other = F.lit(None).cast("string")
        for script, letters in LETTERS.items():
            other = F.when(c.rlike(rf"\p{{Is{script}}}"), _pick(list(letters), _draw(seed, i, len(letters)))).otherwise(other)
        other = F.when(c.rlike(r"\p{L}"), F.coalesce(other, _pick(list(_LOWER), n)))
        return drawn.when(F.octet_length(c) > 1, F.coalesce(other, F.when(signs, _pick(list(_SIGNS), _draw(seed, i, len(_SIGNS)))), c)).when(signs, _pick(list(_SIGNS), _draw(seed, i, len(_SIGNS)))).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, the last one not doubled."""
    n = F.char_length(digits)
    values = F.transform(F.split(digits, ""), lambda c, i: F.when((n - i) % 2 == 0, F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _replacement(kind: Column, canonical: Column, attempt: Column, key: str) -> Column:
    """The canonical form of a replacement; another one for each attempt."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, canonical, attempt.cast("string")), 256)
    like = _like(canonical, seed)
    body = like.substr(F.lit(1), F.char_length(like) - 1)
    check = ((F.lit(10) - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    card = F.when(_luhn_sum(canonical) % 10 == 0, F.concat(body, check)).otherwise(like)
    # Addresses of a private network stay in it, others get a first number that is in no reserved block.
    number = lambda i: _draw(seed, F.lit(i), 256).cast("string")
    fixed = F.regexp_extract(canonical, r"^(10|127|192\.168|172\.(?:1[6-9]|2\d|3[01]))\.", 1)
    start = F.when(fixed != "", fixed).otherwise((_draw(seed, F.lit(9), 115) + 11).cast("string"))
    rest = F.concat_ws(".", number(1), number(2), number(3))
    ip = F.when(F.contains(fixed, F.lit(".")), F.concat_ws(".", start, number(1), number(2))).otherwise(F.concat_ws(".", start, rest))
    # The last part of a mail address's domain stays; crowded addresses and names grow.
    local = F.substring_index(canonical, ".", -1)
    head = canonical.substr(F.lit(1), F.char_length(canonical) - F.char_length(local) - 1)
    more = F.when(attempt >= CROWDED, F.translate(attempt.cast("string"), "0123456789", "abcdefghij")).otherwise("")
    email = F.concat(more, _like(head, seed), F.lit("."), local)
    out = F.when(kind == "card", card).when(kind == "ip", ip).when(kind == "email", email)
    out = out.when(kind == "iban", F.concat(F.substring(canonical, 1, 2), _like(F.substring(canonical, 3, 64), seed)))
    for label, names in GIVEN.items():
        out = out.when(kind == f"name_{label}", _chain(names, seed, attempt))
    for label, names in SURNAMES.items():
        out = out.when(kind == f"surname_{label}", _chain(names, seed, attempt))
    return out.otherwise(like)


def _chain(names: list[str], seed: Column, attempt: Column) -> Column:
    """A name, or several joined by hyphens, one more for each two attempts, so that there are always enough."""
    drawn = F.transform(F.sequence(F.lit(0), F.floor(attempt / 2).cast("int")), lambda i: _pick([n.lower() for n in names], _draw(seed, i, len(names))))
    return F.array_join(drawn, "-")


def _written_like(kind: Column, match: Column, found: Column) -> Column:
    """A replacement's canonical form in the writing of one occurrence: its punctuation and its capitals."""
    chars = F.split(match, "")
    digits = F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda acc, c: F.when(c.rlike(r"\d"), F.struct(F.concat(acc["out"], found.substr(acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))).otherwise(
            F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at"))
        ),
        lambda acc: acc["out"],
    )
    spaced = F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda acc, c: F.when(c != " ", F.struct(F.concat(acc["out"], found.substr(acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))).otherwise(
            F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at"))
        ),
        lambda acc: acc["out"],
    )
    cased = F.array_join(F.zip_with(F.split(found, ""), chars, lambda f, m: F.when(f.isNull(), "").when(m.isNotNull() & (m != F.lower(m)), F.upper(f)).otherwise(f)), "")
    name = F.array_join(F.transform(F.split(found, "-"), lambda w: F.initcap(w)), "-")
    name = F.when((F.char_length(match) > 1) & (F.upper(match) == match), F.upper(name)).otherwise(name)
    return (
        F.when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind == "iban", spaced)
        .when(kind == "email", cased)
        .when(kind.startswith("name_") | kind.startswith("surname_"), name)
        .otherwise(found)
    )


#: Characters that mark matches in a text while it is cut; texts that have them are cut another way.
_OPEN, _CLOSE = "\u0001", "\u0002"


def _pieces(text: Column) -> Column:
    """A text cut at its matches: gap, match, gap, ..., gap. One pass of the patterns marks them."""
    marked = F.regexp_replace(text, f"({ANY})", f"{_OPEN}$1{_CLOSE}")
    both = F.zip_with(F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda gap, match: F.array(gap, match))
    other = F.array_compact(F.flatten(both))
    return F.when(text.rlike(f"[{_OPEN}{_CLOSE}]"), other).otherwise(F.split(marked, f"[{_OPEN}{_CLOSE}]", -1))


def _match_at(i: Column) -> Column:
    match = F.get(F.col("pieces"), i).alias("match")
    return F.struct(i.alias("pos"), match, F.right(F.get(F.col("pieces"), i - 1), F.lit(24)).alias("before"), F.left(F.get(F.col("pieces"), i + 1), F.lit(2)).alias("after"))


def surrogate_book(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, found): one replacement for each distinct entity (kind, canonical), no two of a kind alike.

    In each round every open entity draws; a draw that another entity has or that is an entity of the corpus is
    refused, of equal draws the smallest entity's stands. In crowded spaces, from round CROWDED on, only draws that
    are an entity's own or another one's replacement are refused.
    """
    # Plans, which Spark shows and logs, have a digest in place of the key.
    key = hashlib.sha256(b"surrogates:" + key.encode()).hexdigest()
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = written(entities.select("kind", "canonical").distinct(), "surrogate-entities")
    taken = every.select("kind", F.col("canonical").alias("found"))
    book, left, attempt = None, every, 0
    while True:
        if attempt == ROUNDS:
            raise RuntimeError("no distinct replacements are left for some entities")
        drawn = left.repartition(tasks, "canonical").withColumn("found", _replacement(F.col("kind"), F.col("canonical"), F.lit(attempt), key))
        first = drawn.groupBy("kind", "found").agg(F.min("canonical").alias("canonical"))
        first = first.where("found <> canonical")
        if attempt < CROWDED:
            first = first.join(taken, ["kind", "found"], "left_anti")
        if book is not None:
            first = first.join(book.select("kind", "found"), ["kind", "found"], "left_anti")
        won = written(first.select("kind", "canonical", "found"), "surrogate-won")
        left = written(left.join(won, ["kind", "canonical"], "left_anti"), "surrogate-open")
        book = won if book is None else book.unionByName(won)
        if left.isEmpty():
            return book
        attempt += 1


def replace_entities(docs: DataFrame, key: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents with their entities replaced in the text, and n_entities (long).

    Further mentions of a name that is detected in a text, after a title, are replaced in that text too, and not counted.
    A null text stays null. Equal rows are replaced alike; null ids do no harm. A column named n_entities is
    replaced; other columns stay as they are. Texts without entities are neither changed nor moved.
    """
    columns = [c for c in docs.columns if c != "n_entities"]
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), F.xxhash64(id_, text).alias("row"), text.alias("text"))
    cut = rows.where(may_have_entities(F.col("text"))).select("doc", "row", _pieces(F.col("text")).alias("pieces"))
    cut = written(cut.where(F.size("pieces") > 1), "surrogate-cut")
    places = F.sequence(F.lit(1), F.size("pieces") - 2, F.lit(2))
    found = cut.select("row", F.explode(F.transform(places, _match_at)).alias("m")).select("row", "m.*")
    found = found.withColumn("kind", _kind(F.col("match"), F.col("before"), F.col("after"))).drop("before", "after").dropDuplicates(["row", "pos"])
    found = written(found.withColumn("canonical", _canonical(F.col("kind"), F.col("match"))), "surrogate-found")
    book = surrogate_book(found, key)
    named = join_small(found, book, ["kind", "canonical"])
    named = named.select("row", "pos", F.when(F.col("kind").rlike("name_"), F.col("match")).alias("name"), _written_like(F.col("kind"), F.col("match"), F.col("found")).alias("new"))
    names = F.array_distinct(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "new")))).alias("names")
    lists = written(named.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("news"), names), "surrogate-lists")
    again = lambda gap, n: F.regexp_replace(gap, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), n["name"], F.lit(r"\E(?![\p{L}\p{N}])")), n["new"])
    gap = lambda p: F.when(F.size("names") == 0, p).otherwise(F.aggregate("names", p, again))
    piece = lambda p, i: F.when(i % 2 == 1, F.get(F.col("news"), F.floor(i / 2).cast("int"))["new"]).otherwise(gap(p))
    new = {c: F.col(f"doc.`{c}`") for c in columns}
    replaced = new | {text_col: F.array_join(F.transform("pieces", piece), "")}
    changed = cut.join(lists, "row").select(*[x.alias(c) for c, x in replaced.items()], F.size("news").cast("long").alias("n_entities"))
    filtered = key_filter(lists, "row")
    maybe = passing(rows, "row", filtered).join(lists.select("row"), "row", "left_anti")
    same = passing(rows, "row", filtered, absent=True).unionByName(maybe)
    return changed.unionByName(same.select(*[x.alias(c) for c, x in new.items()], F.lit(0).cast("long").alias("n_entities")))
