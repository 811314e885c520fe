"""PII: keyed surrogates for detected entities (operator 1). DataFrame and SQL functions only.

Entities are e-mail addresses, phone numbers, IPv4 addresses, bank account numbers (IBAN), card numbers, national ids and
titled person names.
Each distinct entity of the corpus gets one surrogate, drawn from SHA-512 of (key, kind, entity, attempt):
  email   same count of letters and digits in the local part, a reserved example domain label, the same top level
  phone   country code (one to three digits by COUNTRY_CODES) and punctuation stay, the other digits change
  ip      four octets in 10.0.0.0/8, so not a public address; after 8 collisions in 240.0.0.0/4, which is reserved, and
          after 24 anywhere, so that a table of very many addresses does not run out of them
  card    first digit, grouping and length stay; the last digit makes the Luhn sum right where it was right
  id      grouping stays, digits change
  iban    country, grouping, and which characters are letters stay; the check digits are right where they were right
  person  the title stays; first names come from a pool of the title's gender (either for Dr and Prof; with syllables
          after four collisions), family names from syllables; the script (Latin or Cyrillic), the number of names and the
          case style (Title, UPPER, lower) are kept
Entities are compared in a normal form (lower case, digits only), so every mention of one gets the same surrogate,
written in that mention's own format (coreference). A person's names are entities of their own: each family name and
each first name of a gender has its surrogate, so `Mr John Smith`, `Mr Smith` and `Dr Smith` keep the same family name,
and distinct names stay distinct. A surrogate that equals a real entity or another one's surrogate
is drawn again with the next attempt until none collides (distinctness); at each attempt the smallest entity keeps it.

Null texts stay null, with no entities. Texts of any length are replaced whole. Equal rows get equal results; other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import written

KEY = "surrogate-key-1"
MAX_ATTEMPTS = 64
# Entity patterns (Java regular expressions), in order of precedence.
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
NAME_TITLES = "Mrs|Miss|Mr|Ms|MRS|MISS|MR|MS|Dr|DR|Prof|PROF|Herr|HERR|Frau|FRAU|Señora|Señor|SEÑORA|SEÑOR|Monsieur|Madame|Sra|Sr|Mme|Г-н|Г-жа"
IBAN_FORMS = [
    "AT[0-9]{2}(?: ?[0-9]{4}){4}", "BE[0-9]{2}(?: ?[0-9]{4}){3}", "CH[0-9]{2}(?: ?[0-9A-Z]{4}){4} ?[0-9A-Z]", "DE[0-9]{2}(?: ?[0-9]{4}){4} ?[0-9]{2}", "ES[0-9]{2}(?: ?[0-9]{4}){5}",
    "FR[0-9]{2}(?: ?[0-9A-Z]{4}){5} ?[0-9A-Z]{3}", "GB[0-9]{2} ?[A-Z]{4}(?: ?[0-9]{4}){3} ?[0-9]{2}", "IT[0-9]{2} ?[A-Z][0-9]{3}(?: ?[0-9A-Z]{4}){4} ?[0-9A-Z]{3}", "NL[0-9]{2} ?[A-Z]{4}(?: ?[0-9]{4}){2} ?[0-9]{2}",
]
PATTERNS = {
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)*[.][A-Za-z]{2,}",
    "ip": f"(?<![0-9.])(?:{OCTET}[.]){{3}}{OCTET}(?![0-9]|[.][0-9])",
    "phone": "(?<![0-9A-Za-z])[+][0-9]{1,3}[ -]?[(]?[0-9]{2,4}[)]?(?:[ -]?[0-9]{2,4}){1,4}(?![0-9])",
    "iban": f"(?<![0-9A-Za-z])(?:{'|'.join(IBAN_FORMS)})(?![0-9A-Za-z])",
    "card": "(?<![0-9A-Za-z.])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z])",
    "id": "(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "person": f"(?<!\\p{{L}})(?:{NAME_TITLES})[.]?(?: \\p{{Lu}}[\\p{{L}}'-]+){{1,3}}",
}
# Country calling codes of one and two digits; all others have three.
COUNTRY_CODES = ["1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"]
FEMALE_TITLES = ["mrs", "ms", "miss", "frau", "señora", "madame", "sra", "mme", "г-жа"]
NEUTRAL_TITLES = ["dr", "prof"]
POOLS = {
    "f_latin": ["Alma", "Berta", "Carla", "Dora", "Edith", "Flora", "Greta", "Hanna", "Irene", "Julia", "Klara", "Lena", "Maria", "Nora", "Olga", "Paula"],
    "m_latin": ["Anton", "Bruno", "Carlos", "David", "Emil", "Felix", "Georg", "Hugo", "Igor", "Jakob", "Karl", "Leo", "Martin", "Nils", "Otto", "Peter"],
    "f_cyrillic": ["Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Ксения", "Лариса", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья"],
    "m_cyrillic": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Семён"],
    "s_latin": ["bar", "den", "fel", "gor", "hal", "kin", "lor", "mar", "nor", "pel", "ron", "sel", "tan", "ver", "wen", "zol"],
    "s_cyrillic": ["бар", "вел", "гор", "дан", "жар", "зор", "кол", "лан", "мир", "нов", "пар", "рос", "сел", "тар", "фед", "хор"],
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# A cheap test that every entity passes.
HINT = f"@|[A-Z]{{2}}[0-9]{{2}} ?[0-9A-Z]{{4}}|[0-9](?:[ .)(-]{{0,3}}[0-9]){{5}}|[0-9][.][0-9]|(?:{NAME_TITLES})[.]? \\p{{Lu}}"


def found() -> Column:
    """All entity strings of `text`, in order."""
    hit = F.regexp_extract_all("text", F.lit(_ANY), F.lit(0))
    return F.when(F.col("text").rlike(HINT), hit).otherwise(F.array().cast("array<string>"))


def kind_of(x: Column) -> Column:
    out = F.when(x.contains("@"), "email")
    for kind in ("ip", "phone", "id", "iban", "card"):
        out = out.when(x.rlike(f"^(?:{PATTERNS[kind]})$"), kind)
    return out.otherwise("person")


def parts_of(x: Column, kind: Column) -> Column:
    """The entities that a mention holds, as struct(kind, norm): the names of a person, in order, else one."""
    digits, bare = F.regexp_replace(x, "[^0-9]", ""), F.upper(F.regexp_replace(x, " ", ""))
    norm = F.when(kind.isin("email", "ip"), F.lower(x)).when(kind == "iban", bare).otherwise(digits)
    title = F.regexp_extract(x, f"^({NAME_TITLES})", 1)
    gender = F.when(F.lower(title).isin(NEUTRAL_TITLES), "n:").when(is_female(x), "f:").otherwise("m:")
    names = F.split(F.lower(F.regexp_replace(x, f"^(?:{NAME_TITLES})[.]? ", "")), " ")
    # a first name's key holds the gender, as the surrogate must match it
    person = F.transform(names, lambda n, i: F.when(i == F.size(names) - 1, F.struct(F.lit("family").alias("kind"), n.alias("norm"))).otherwise(F.struct(F.lit("given").alias("kind"), F.concat(gender, n).alias("norm"))))
    return F.when(kind == "person", person).otherwise(F.array(F.struct(kind.alias("kind"), norm.alias("norm"))))


def is_female(x: Column) -> Column:
    return F.lower(F.regexp_extract(x, f"^({NAME_TITLES})", 1)).isin(FEMALE_TITLES)


def _nibble(stream: Column, i: Column) -> Column:
    """A number from 0 to 255 at place i of a hexadecimal stream of 128 digits."""
    return F.conv(F.substr(stream, (i * 2) % 126 + 1, F.lit(2)), 16, 10).cast("int")


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def _redrawn(x: Column, stream: Column) -> Column:
    """x with each digit and each ASCII letter replaced by another of its kind and case."""
    def one(c: Column, i: Column) -> Column:
        n = _nibble(stream, i)
        return (
            F.when(c.rlike("[0-9]"), (n % 10).cast("string"))
            .when(c.rlike("[a-z]"), F.char(n % 26 + 97))
            .when(c.rlike("[A-Z]"), F.char(n % 26 + 65))
            .otherwise(c)
        )

    return F.array_join(F.transform(_chars(x), one), "")


def luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(F.reverse(_chars(digits)), value), F.lit(0), lambda a, b: a + b) % 10


def mod97(bban: Column) -> Column:
    """Remainder of an account number by 97, letters read as two digits."""
    return F.aggregate(_chars(bban), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def drawn(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """Normal form of the surrogate of an entity at an attempt."""
    stream = F.sha2(F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string")), 512)
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    extra = F.when(attempt > 8, F.substr(stream, F.lit(1), F.least(attempt, F.lit(40)))).otherwise("")
    email = F.concat(_redrawn(local, stream), extra, F.lit("@"), F.substr(stream, F.lit(100), F.lit(6)), F.lit(".example."), F.substring_index(domain, ".", -1))
    net = F.when(attempt <= 8, "10").when(attempt <= 24, (240 + _nibble(stream, F.lit(45)) % 16).cast("string")).otherwise(_nibble(stream, F.lit(45)).cast("string"))
    ip = F.concat_ws(".", net, *[_nibble(stream, F.lit(i)).cast("string") for i in (3, 17, 31)])
    digits = _redrawn(norm, stream)
    code = F.when(F.substr(norm, F.lit(1), F.lit(1)).isin(COUNTRY_CODES), 1).when(F.substr(norm, F.lit(1), F.lit(2)).isin(COUNTRY_CODES), 2).otherwise(3)
    phone = F.concat(F.substr(norm, F.lit(1), code), F.substr(digits, code + 1))
    body = F.concat(F.substr(norm, F.lit(1), F.lit(1)), F.substr(digits, F.lit(2), F.length(norm) - 2))
    right = F.pmod(10 - luhn(F.concat(body, F.lit("0"))), F.lit(10))
    last = F.when(luhn(norm) == 0, right).otherwise((right + 1 + _nibble(stream, F.lit(60)) % 9) % 10)
    card = F.concat(body, last.cast("string"))
    country, account = F.substr(norm, F.lit(1), F.lit(2)), _redrawn(F.substr(norm, F.lit(5)), stream)
    check = 98 - mod97(F.concat(account, country, F.lit("00")))
    was_right = mod97(F.concat(F.substr(norm, F.lit(5)), F.substr(norm, F.lit(1), F.lit(4)))) == 1
    check = F.when(was_right, check).otherwise((check + 1 + _nibble(stream, F.lit(60)) % 90) % 97)
    iban = F.concat(country, F.lpad(check.cast("string"), 2, "0"), account)
    cyrillic = norm.rlike("\\p{IsCyrillic}")
    female = norm.startswith("f:") | (norm.startswith("n:") & (_nibble(stream, F.lit(50)) % 2 == 0))

    def pool(name: str, n: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in POOLS[name]]), n % 16 + 1)

    def by_script(a: str, n: Column) -> Column:
        return F.when(cyrillic, pool(f"{a}_cyrillic", n)).otherwise(pool(f"{a}_latin", n))

    def syllables(n: Column) -> Column:
        """n syllables; more attempts make a name longer."""
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: by_script("s", _nibble(stream, k + 5))), "")).otherwise("")

    more = F.least(attempt, F.lit(20))
    first = F.lower(F.when(female, by_script("f", _nibble(stream, F.lit(0)))).otherwise(by_script("m", _nibble(stream, F.lit(0)))))
    given = F.concat(F.substr(norm, F.lit(1), F.lit(2)), first, syllables(F.greatest(more - 3, F.lit(0))))
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", card).when(kind == "iban", iban)
    return out.when(kind == "id", digits).when(kind == "given", given).otherwise(syllables(more + 3))


def formatted(kind: Column, original: Column, surrogate: Column) -> Column:
    """The surrogate's normal form (a person's: names with a space between) written in the format of a mention."""
    spread = F.aggregate(
        _chars(original),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(c.rlike("[0-9]") | ((kind == "iban") & (c != " ")), F.struct(F.concat(s.out, F.substr(surrogate, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s.out, c).alias("out"), s["at"].alias("at"))),
        lambda s: s.out,
    )
    title = F.regexp_extract(original, f"^(?:{NAME_TITLES})[.]? ", 0)
    rest = F.substr(original, F.length(title) + 1)
    cased = F.when(rest == F.upper(rest), F.upper(surrogate)).otherwise(F.initcap(surrogate))
    upper = F.when((original == F.upper(original)) & original.rlike("[A-Z]"), F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind == "email", upper).when(kind == "ip", surrogate).when(kind == "person", F.concat(title, cased)).otherwise(spread)


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, norm, surrogate) for distinct (kind, norm), without collisions."""
    every = entities.select("kind", "norm")
    pending, done = every.withColumn("attempt", F.lit(0)), None
    for _ in range(MAX_ATTEMPTS):
        tried = written(pending.withColumn("surrogate", drawn(F.col("kind"), F.col("norm"), F.col("attempt"), key)), "tried")
        free = tried.join(every.withColumnRenamed("norm", "surrogate"), ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = written(free.groupBy("kind", "surrogate").agg(F.min("norm").alias("norm")).select("kind", "norm", "surrogate"), "won")
        done = won if done is None else done.unionByName(won)
        pending = tried.join(won.select("kind", "norm"), ["kind", "norm"], "left_anti").select("kind", "norm", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return done
    raise ValueError(f"surrogates still collide after {MAX_ATTEMPTS} attempts")


def _count(kind: str) -> Column:
    return F.size(F.filter("found", lambda e: e.kind == kind)).cast("long")


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """Per row: doc_id, n_entities, a count n_<kind> for each kind, and text with surrogates."""
    own = docs.select(F.col("doc_id"), "text", found().alias("found"))
    some = written(
        own.where(F.size("found") > 0).select(
            "doc_id", F.split("text", _ANY, -1).alias("parts"),
            F.transform("found", lambda x: F.struct(kind_of(x).alias("kind"), parts_of(x, kind_of(x)).alias("parts"), x.alias("original"))).alias("found"),
            F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.col("text"))).alias("row_key"),
        ), "pii",
    )
    mention = some.dropDuplicates(["row_key"]).select("row_key", F.posexplode("found").alias("at", "e")).select("row_key", "at", F.col("e.kind").alias("type"), "e.original", F.posexplode("e.parts").alias("nth", "p")).select("row_key", "at", "type", "original", "nth", "p.kind", "p.norm")
    table = surrogates(mention.select("kind", "norm").distinct(), key)
    part = F.when(F.col("kind") == "given", F.substr(F.col("surrogate"), F.lit(3))).otherwise(F.col("surrogate"))
    whole = mention.join(table, ["kind", "norm"]).groupBy("row_key", "at", "type", "original").agg(F.array_sort(F.collect_list(F.struct("nth", part.alias("s")))).alias("x"))
    name = F.array_join(F.transform("x", lambda x: x["s"]), " ")
    told = whole.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("at", formatted(F.col("type"), F.col("original"), name).alias("s")))).alias("told"))
    woven = F.concat(F.array_join(F.zip_with("parts", "told", lambda p, t: F.concat(p, F.coalesce(t["s"], F.lit("")))), ""))
    kinds = [_count(k).alias(f"n_{k}") for k in PATTERNS]
    changed = some.join(told, "row_key").select("doc_id", F.size("found").cast("long").alias("n_entities"), *kinds, woven.alias("text"))
    rest = own.where(F.size("found") == 0).select("doc_id", F.lit(0).cast("long").alias("n_entities"), *[F.lit(0).cast("long").alias(f"n_{k}") for k in PATTERNS], "text")
    return changed.unionByName(rest)
