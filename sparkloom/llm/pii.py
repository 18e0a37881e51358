"""Surrogates for personal data and secrets, by DataFrame and SQL functions only.

Detected entities get replacements made from a keyed hash: of the same type and format (digits for digits, letters of the
same script and case for letters, valid check digits where the original has them, octets of the same length, hexadecimal
for hexadecimal). A name is replaced word by word: a given name by one of the same gender, every word by one of its script,
so who is named in short and in full keeps one name. One entity has one surrogate in all documents; distinct entities, and
distinct words of names, have distinct ones, none of which is an entity of the corpus: colliding surrogates are made again.

A name is found by a title before it, or by a given name of the list below before another capitalised word; other names
are not found."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import stash, table

#: Where the query finds its key; without the setting it takes a key that is none, for tests.
KEY_SETTING, TEST_KEY = "spark.sparkloom.surrogateKey", "no secret"
#: Rounds in which a surrogate may not be an entity of the corpus either, and rounds in all.
STRICT, ROUNDS = 16, 64

# Titles, of those that give a name's gender and of those that do not.
MALE = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Sir", "господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Lady", "госпожа")
EITHER = ("Dr", "Prof", "Doctor", "Professor", "доктор")
# Given names after which a capitalised word is a surname.
GIVEN = {
    "m": ("Adam", "Alexander", "Andrew", "Antonio", "Carlos", "Charles", "Daniel", "David", "Dmitri", "Francois", "George", "Giovanni", "Hans", "Henry", "Ivan", "Jack", "James", "Jan", "Jean", "John", "José", "Joseph", "Juan", "Klaus", "Luis", "Marco", "Martin", "Michael", "Mohammed", "Paul", "Pedro", "Peter", "Pierre", "Richard", "Robert", "Sergei", "Stefan", "Thomas", "William", "Wolfgang"),
    "f": ("Alice", "Amélie", "Anna", "Barbara", "Carmen", "Catherine", "Charlotte", "Claire", "Elena", "Elizabeth", "Emily", "Emma", "Fatima", "Giulia", "Helena", "Ingrid", "Irina", "Isabel", "Jane", "Jennifer", "Julia", "Karen", "Katarina", "Laura", "Linda", "Lucia", "Margaret", "Maria", "Marie", "Mary", "Monika", "Natalia", "Nina", "Olga", "Patricia", "Sabine", "Sarah", "Sofia", "Susan", "Ursula"),
}
# Ends of made-up given names.
ENDS = {"m": ("n", "r", "s", "l", "k", "d", "t", "m"), "f": ("na", "la", "ra", "sa", "ta", "da", "ma", "ka")}
ENDS_CYRILLIC = {"m": ("н", "р", "с", "л", "к", "д", "т", "м"), "f": ("на", "ла", "ра", "са", "та", "да", "ма", "ка")}
SYLLABLES = ("ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ha", "he", "ka", "ke", "ko", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "ra", "re", "ro", "sa", "se", "so", "ta", "to")
CYRILLIC = ("ба", "бе", "бо", "ва", "ве", "во", "га", "да", "де", "до", "за", "зо", "ка", "ке", "ко", "ла", "ле", "ло", "ма", "ме", "мо", "на", "не", "но", "ра", "ре", "ро", "са", "со", "та", "те", "то")

_WORD = r"[\p{L}\p{N}._%+-]"
_CAP = r"\p{Lu}[\p{L}'’-]*\p{L}"
#: Titles also stand in capitals.
_MALE, _FEMALE = (tuple(dict.fromkeys(x + tuple(t.upper() for t in x))) for x in (MALE, FEMALE))
_TITLES = "|".join((*_MALE, *_FEMALE, *EITHER, *(t.upper() for t in EITHER)))
_TITLE = rf"(?:{_TITLES})\.? "
_GIVEN = "|".join(GIVEN["m"] + GIVEN["f"])
#: Each type by its own pattern, in the order in which they are tried at a place.
PATTERNS = {
    "email": rf"(?<!{_WORD}){_WORD}++@[\p{{L}}\p{{N}}-]+(?:\.[\p{{L}}\p{{N}}-]+)+",
    "name": rf"(?<![\p{{L}}])(?:(?:{_TITLE})+{_CAP}(?: {_CAP}){{0,2}}|(?:{_GIVEN}) (?:\p{{Lu}}\. )?{_CAP})(?![\p{{L}}])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d]|\.\d)",
    "phone": r"(?<![\p{L}\d])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\d{1,2}[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}([ .-])\d{3}\1\d{4})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\p{L}\d])\d(?:[ -]?\d){12,18}(?![\p{L}\d])",
    "secret": r"(?<![\p{L}\d])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:AKIA|ghp_|sk_live_|xox[bp]-)[A-Za-z0-9_-]{12,})(?![\p{L}\d])",
}
ANY = "|".join(PATTERNS.values())


def entities(text: Column) -> Column:
    """All entities of a text, in order. A text without an @, a pair of near digits, a long run of hexadecimal digits, the
    prefix of a key, or a title or given name before a capital holds none: that test is cheap, the patterns are tried on
    what passes it."""
    may = text.contains("@") | text.rlike(r"[0-9][ .()+-]{0,3}[0-9]|[0-9a-fA-F]{32}") | text.rlike(rf"(?<!\p{{L}})(?:{_TITLES}|{_GIVEN})\.? \p{{Lu}}")
    for word in ("AKIA", "ghp_", "sk_live_", "xox"):
        may = may | text.contains(word)
    return F.when(may, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _kind(entity: Column) -> Column:
    """The first type whose pattern takes the whole entity."""
    out = F.lit("secret")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _pick(items: tuple[str, ...] | str, v: str) -> str:
    names = ", ".join(f"'{x}'" for x in items)
    return f"element_at(array({names}), 1 + cast({v} % {len(items)} as int))"


def _v(i: str) -> str:
    """A value of 0 to 255 from the entity's stream of hashed characters."""
    return f"cast(conv(substring(stream, 1 + 2 * cast({i} % 128 as int), 2), 16, 10) as int)"


def _chars(text: str) -> str:
    """text with each letter and digit replaced by one of its script, case and kind."""
    v = _v("i")
    return f"""array_join(transform(filter(split({text}, ''), c -> c <> ''), (c, i) -> case
        when c rlike '[0-9]' then cast({v} % 10 as string) when c rlike '[a-z]' then char(97 + {v} % 26) when c rlike '[A-Z]' then char(65 + {v} % 26)
        when c rlike '[а-я]' then substring('абвгдежзиклмнопрстуфхцчшэюя', 1 + {v} % 27, 1) when c rlike '[А-Я]' then substring('АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ', 1 + {v} % 27, 1)
        when c rlike '[α-ω]' then substring('αβγδεζηθικλμνξοπρστυφχψω', 1 + {v} % 24, 1) when c rlike '[Α-Ω]' then substring('ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ', 1 + {v} % 24, 1)
        when c rlike '\\\\p{{Lu}}' then substring('ÁÂÄÇÉÈÊÍÎÑÓÔÖÚÜ', 1 + {v} % 15, 1) when c rlike '\\\\p{{Ll}}' then substring('áâäçéèêíîñóôöúü', 1 + {v} % 15, 1) else c end), '')"""


def _luhn(digits: str) -> str:
    """The Luhn sum, modulo 10."""
    d = f"cast(substring({digits}, -k, 1) as int)"
    return f"aggregate(sequence(1, length({digits})), 0, (s, k) -> s + case when k % 2 = 1 then {d} when {d} > 4 then 2 * {d} - 9 else 2 * {d} end) % 10"


def _mod97(iban: str) -> str:
    """The remainder that an IBAN's check digits must make 1."""
    moved = f"concat(substring({iban}, 5), substring({iban}, 1, 4))"
    return f"aggregate(filter(split({moved}, ''), c -> c <> ''), 0, (s, c) -> case when c rlike '[0-9]' then (s * 10 + cast(c as int)) % 97 else (s * 100 + ascii(c) - 55) % 97 end)"


def _word() -> str:
    """A made-up word of a name, in small letters: syllables, one more in each attempt, and for a given name its gender's end."""
    made = lambda syllables: f"array_join(transform(sequence(0, 2 + attempt), i -> {_pick(syllables, _v('i'))}), '')"
    end = lambda ends: f"case kind when 'm' then {_pick(ends['m'], _v('100'))} when 'f' then {_pick(ends['f'], _v('100'))} else '' end"
    return f"""case when entity rlike '\\\\p{{IsCyrillic}}' then concat({made(CYRILLIC)}, {end(ENDS_CYRILLIC)}) when entity rlike '\\\\p{{IsLatin}}' then concat({made(SYLLABLES)}, {end(ENDS)}) else lower(mapped) end"""


def _surrogate() -> str:
    body = "substring(mapped, 1, length(mapped) - 1)"
    zero = f"regexp_replace(concat({body}, '0'), '[^0-9]', '')"
    plain = "regexp_replace(entity, '[^0-9]', '')"
    card = f"case when {_luhn(plain)} = 0 then concat({body}, cast((10 - {_luhn(zero)}) % 10 as string)) else mapped end"
    packed = "replace(concat(substring(mapped, 1, 2), '00', substring(mapped, 5)), ' ', '')"
    iban = f"concat(substring(mapped, 1, 2), lpad(cast(98 - {_mod97(packed)} as string), 2, '0'), substring(mapped, 5))"
    ip = f"array_join(transform(split(entity, '[.]'), (o, i) -> cast(case length(o) when 1 then {_v('i')} % 10 when 2 then 10 + {_v('i')} % 90 else 100 + {_v('i')} % 156 end as string)), '.')"
    hexa = f"array_join(transform(filter(split(entity, ''), c -> c <> ''), (c, i) -> substring(case when entity rlike '[A-F]' then '0123456789ABCDEF' else '0123456789abcdef' end, 1 + {_v('i')} % 16, 1)), '')"
    return f"""case kind when 'ip' then {ip} when 'card' then {card} when 'iban' then {iban} when 'm' then {_word()} when 'f' then {_word()} when 'word' then {_word()}
        when 'email' then case when attempt < 8 then mapped else concat(substring(stream, 1, attempt - 6), mapped) end
        when 'secret' then case when entity rlike '^([0-9a-f]+|[0-9A-F]+)$' then {hexa} else mapped end else mapped end"""


def _made(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, entity, attempt) -> with surrogate."""
    seed = "concat_ws('|', {k}, kind, attempt, entity, '{n}')"
    k = "'" + key.replace("\\", "\\\\").replace("'", "\\'") + "'"
    e = entities.withColumn("stream", F.expr(f"concat(sha2({seed.format(k=k, n=0)}, 512), sha2({seed.format(k=k, n=1)}, 512))"))
    # what stays of an entity: country codes, a card's first digit, prefixes of keys, the last label of a domain
    e = e.withColumn("head", F.expr("case kind when 'phone' then regexp_extract(entity, '^[+][0-9]{1,3}(?=[^0-9])', 0) when 'card' then substring(entity, 1, 1) when 'iban' then substring(entity, 1, 4) when 'secret' then regexp_extract(entity, '^(AKIA|ghp_|sk_live_|xox[bp]-)', 0) else '' end"))
    e = e.withColumn("tail", F.expr("case kind when 'email' then regexp_extract(entity, '[.][^.@]+$', 0) else '' end"))
    e = e.withColumn("middle", F.expr("substring(entity, 1 + length(head), length(entity) - length(head) - length(tail))")).withColumn("mapped", F.concat("head", F.expr(_chars("middle")), "tail"))
    return e.select("kind", "entity", "attempt", F.expr(_surrogate()).alias("surrogate"))


def one_to_one(entities: DataFrame, key: str) -> DataFrame:
    """Distinct entities (kind, entity) -> (entity, surrogate), one-to-one, no surrogate an entity.

    A round makes surrogates for those that have none yet, and keeps what is neither an entity nor taken, one of equal ones.
    Where entities fill most of what their format allows, a surrogate may be another's entity after STRICT rounds; where even
    that leaves none free after ROUNDS, it is an error."""
    todo = stash(entities.select("kind", "entity", F.lit(0).alias("attempt")))
    real = todo.select(F.col("entity").alias("surrogate"))
    done = None
    for turn in range(ROUNDS):
        made = _made(todo, key)
        if turn < STRICT:
            made = made.join(real, "surrogate", "left_anti")
        if done is not None:
            made = made.join(done.select("surrogate"), "surrogate", "left_anti")
        kept = stash(made.groupBy("surrogate").agg(F.min("entity").alias("entity")).select("entity", "surrogate"))
        done = kept if done is None else done.union(kept)
        todo = stash(todo.join(kept.select("entity"), "entity", "left_anti").withColumn("attempt", F.lit(turn + 1)))
        if todo.isEmpty():
            return done
    raise ValueError(f"no surrogate is free for some of {todo.select('kind').distinct().limit(20).collect()}")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """Distinct entities (kind, entity) -> (entity, surrogate), one-to-one. A name's words have surrogates of their own, by
    their small letters; a word's gender is that of the titles, or of the list, where it stands as a given name."""
    plain = entities.where("kind <> 'name'")
    n = entities.where("kind = 'name'").select("entity", F.regexp_extract("entity", f"^(?:{_TITLE})*", 0).alias("title"))
    n = n.withColumn("rest", F.expr("substring(entity, length(title) + 1)")).withColumn("words", F.regexp_extract_all("rest", F.lit(r"\p{L}+"), F.lit(0)))
    title = F.split("title", r"\.? ")
    of = lambda names: F.exists(title, lambda t: t.isin(*names))
    first = F.initcap(F.col("words")[0])
    gender = F.when(F.size("words") < 2, None).when(of(_FEMALE), 1).when(of(_MALE), -1).when(first.isin(*GIVEN["f"]), 1).when(first.isin(*GIVEN["m"]), -1)
    n = stash(n.select("entity", "title", "rest", gender.alias("gender"), F.posexplode("words").alias("i", "word")))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    turn = 1 + hashlib.sha256(key.encode()).digest()[0] % 25  # initials keep apart by a turn of the alphabet
    words = n.where("length(word) > 1").groupBy(F.lower("word").alias("entity")).agg(F.coalesce(F.sum(F.when(F.col("i") == 0, F.col("gender"))), F.lit(0)).alias("g"))
    words = one_to_one(words.select(F.when(F.col("g") > 0, "f").when(F.col("g") < 0, "m").otherwise("word").alias("kind"), "entity"), key).withColumnRenamed("entity", "w")
    shown = F.when(F.length("word") == 1, F.translate("word", letters, letters[turn:] + letters[:turn])).when(F.upper("word") == F.col("word"), F.upper("surrogate")).when(F.col("word").rlike(r"^\p{Lu}"), F.initcap("surrogate")).otherwise(F.col("surrogate"))
    full = n.join(words, F.lower("word") == F.col("w"), "left").groupBy("entity", "title", "rest").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", shown.alias("s")))), lambda x: x.s).alias("words"))
    gaps = F.split("rest", r"\p{L}+", -1)
    full = full.select("entity", F.concat("title", F.array_join(F.zip_with(gaps, "words", lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")).alias("surrogate"))
    return one_to_one(plain, key).union(full)


def replace(docs: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """documents -> the same columns with entities of `text` replaced, by a secret key; with count, a column more with their
    number.

    Null and empty texts stay, texts without an entity stay as they are to the byte, an empty table stays empty. Repeated rows
    and null doc_ids get what their text gets: texts are told by their own hash and doc_id. Other columns pass, whatever their
    names. The patterns run once; a text with entities then travels once, with the map of its own, others are not shuffled."""
    found = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    found = stash(found.withColumn("__m", entities(F.col("__row.text"))).withColumn("__k", F.struct(F.col("__row.doc_id").alias("d"), F.xxhash64("__row.text").alias("h"))))
    mentions = stash(found.where(F.size("__m") > 0).select(F.col("__k"), F.explode("__m").alias("entity")).distinct())
    pairs = stash(surrogates(mentions.select("entity").distinct().select(_kind(F.col("entity")).alias("kind"), "entity"), key))
    maps = mentions.join(pairs, "entity").groupBy("__k").agg(F.map_from_entries(F.collect_set(F.struct("entity", "surrogate"))).alias("__map")).select(F.col("__k.d").alias("__d"), F.col("__k.h").alias("__h"), "__map")
    hit = found.where(F.size("__m") > 0).join(maps, F.col("__k.d").eqNullSafe(F.col("__d")) & (F.col("__k.h") == F.col("__h")))
    gaps = F.split(F.col("__row.text"), ANY, -1)
    new = F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size("__m")), F.col("__m"), lambda g, m: F.concat(g, F.element_at(F.col("__map"), m))), ""), F.element_at(gaps, -1))
    out = [new.alias("text") if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns]
    same = [F.col(f"__row.`{c}`").alias(c) for c in docs.columns]
    if count:
        out, same = [*out, F.size("__m").alias(count)], [*same, F.coalesce(F.size("__m"), F.lit(0)).alias(count)]
    return hit.select(*out).union(found.where(F.coalesce(F.size("__m"), F.lit(0)) == 0).select(*same))


def key_of(spark) -> str:
    return spark.conf.get(KEY_SETTING, TEST_KEY)


def op8_pii(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace(docs, key_of(spark), count="n_entities")
