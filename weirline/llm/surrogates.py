"""Personal data replaced by keyed surrogates, in built-in functions only.

Found are e-mail addresses, IBANs, payment cards, US social security numbers, IPv4
addresses, phone numbers and names after a title: any number of words with inner
capitals, apostrophes and hyphens, initials and particles. Bare mentions of a
found name's words anywhere in the same text (in capitals or with one at the start) are
replaced as well. Each distinct entity (in canonical
form: e-mails in lower case, numbers as their digits, each part of a name) gets one
surrogate for the whole corpus, so that what referred to one person still does:

* letters become letters of the same class (vowel or consonant, case, script),
  digits digits; separators stay, so that each mention keeps its own format;
* an e-mail address keeps its top-level domain, a phone number its country code, a
  card its first digit and a right check digit, an IBAN its country, a social
  security number lies in the range never issued;
* names are made of syllables of their script, one more with each draw, so that they can be
  said and never run out; a given name ends as the title's gender has it, a surname as it
  ended, which bears gender in some languages; a given name after a title without gender
  is the one known from titles with gender, if any is;
* the last word of a name that is no initial is the surname, hyphened parts stand for
  themselves, an initial follows its letter and key only; titles and particles stay.

Surrogates come from a hash under ``key``. They are then checked over all entities:
where two of a kind got the same, or one that occurs in the texts, all but one draw
again, until there is none left. The key is the caller's secret: there is no default. Entities and their surrogates stay in Spark; texts
without personal data are not shuffled.

Defined cases: a null or empty text stays; equal rows get equal texts; a match is of
the first kind in the order above that fits it; letters of scripts without a class
here stay as they are; capitalised words right after a name count as part of it;
kinds list titled names, not bare
mentions; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: Where a session keeps the key, and the key of the given tables, whose people are made up.
KEY_SETTING = "spark.weirline.pii.key"
TABLES_KEY = "given tables"
MAX_DRAWS = 60

# Titles by the gender they tell.
FEMALE = ("Mrs", "Ms", "Miss", "Mme", "Madame", "Mlle", "Frau", "Señora", "Sra", "Signora", "г-жа", "Госпожа", "Κυρία")
MALE = ("Mr", "Monsieur", "Herr", "Señor", "Sr", "Signor", "г-н", "Господин", "Κύριος")
NEUTRAL = ("Dr", "Prof", "Doctor", "Professor", "Professeur", "Docteur", "Doktor", "Доктор", "Профессор", "д-р", "проф", "Δρ")
PARTICLES = (
    "van von vom der den des de del della dell di da das do dos du d la las le los l el al bin ibn ben bint "
    "zu zum zur ter ten af av y"
).split()
#: What names are made of, by script: starts and ends of syllables, ends of given names by gender.
STARTS = {
    "Latin": "b d f g h j k l m n p r s t v z br dr gr kl pr st tr".split(),
    "Cyrillic": "б в г д ж з к л м н п р с т".split(),
    "Greek": "β γ δ ζ θ κ λ μ ν π ρ σ τ φ".split(),
}
VOWELS = {"Latin": "a e i o u".split(), "Cyrillic": "а е и о у".split(), "Greek": "α ε η ι ο".split()}
ENDS = {
    ("Latin", "f"): "la na ra ria lina sette".split(),
    ("Latin", "m"): "bo lan mus nor rik ton".split(),
    ("Latin", "n"): "by lie nis ry sen vie".split(),
    ("Cyrillic", "f"): "ла на рина сия".split(),
    ("Cyrillic", "m"): "лан мир рик тон".split(),
    ("Cyrillic", "n"): "ли ни ри си".split(),
    ("Greek", "f"): "λα νη ρια σινα".split(),
    ("Greek", "m"): "λος μης νας ρων".split(),
    ("Greek", "n"): "λι νι ρι σι".split(),
}
#: Ends of surnames that bear gender; of any other surname the last letter stays.
_SURNAME_END = r"(?:[ое]в|[ое]ва|ин|ина|ск(?:ий|ая)|ου|ος|ης|[oe]v[aá]|ov|ev|s[ck]a|s[ck]i|sky|.)$"

_TITLE = "|".join(sorted((*FEMALE, *MALE, *NEUTRAL), key=len, reverse=True))
_LETTER = r"[\p{L}\p{M}]"
_SPACE = r"[\x20\xA0]"
_HEAD = rf"(?:(?:{_TITLE})(?:\.{_SPACE}{{0,2}}|{_SPACE}{{1,2}}))+"
_PARTICLE = "|".join(PARTICLES)
#: What an apostrophe joins, but for a possessive.
_JOINED = rf"(?:['’](?!s(?!{_LETTER})){_LETTER}++)"
_WORD = rf"(?!(?:{_TITLE})(?!{_LETTER}))\p{{Lu}}{_LETTER}*+(?:{_JOINED}|[-‐‑]{_LETTER}++)*+"
_PART = rf"(?:(?:{_PARTICLE})(?:{_SPACE}{{1,2}}|['’-]))*+(?:\p{{Lu}}\.|{_WORD})"
#: The parts of a name that get surrogates, and the words that may mention one.
_PIECE = rf"(?<!{_LETTER})(?!(?:{_PARTICLE})(?!{_LETTER}))\p{{L}}{_LETTER}*+{_JOINED}*+"
_MENTION = rf"(?<!{_LETTER})\p{{Lu}}(?=[\p{{L}}\p{{M}}'’]){_LETTER}*+{_JOINED}*+"
#: The last word of a name that is no initial, with what follows it.
_LAST = rf"[^\x20\xA0]*{_LETTER}['’]?{_LETTER}[^\x20\xA0]*(?:{_SPACE}+\p{{Lu}}\.?)*$"
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\w.+-])\d(?:[\x20-]?\d){12,18}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)",
    "phone": (
        r"(?:\+\d{1,3}[\x20.-]?(?:\(\d{1,4}\)[\x20.-]?)?\d{2,4}(?:[\x20.-]?\d{2,4}){1,4}"
        r"|(?<!\w)\(\d{3}\)[\x20.-]?\d{3}[\x20.-]\d{4}|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4})(?!\w)"
    ),
    "name": rf"(?<!\p{{L}}){_HEAD}{_PART}(?:(?:{_SPACE}{{1,2}}|(?<=\.)){_PART})*+",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
_NAME_KINDS = ("surname", "given-m", "given-f", "given-n")

#: Letters and digits that stand for each other. Canonical forms are in lower case, but for IBANs.
CLASSES = (
    "0123456789",
    "aeiou",
    "bcdfghjklmnpqrstvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæèéêëìíîïòóôõöøùúûü",
    "çñßþð",
    "аеёиоуыэюя",
    "бвгджзйклмнпрстфхцчшщ",
    "αεηιουω",
    "βγδζθκλμνξπρστφχψ",
    "άέήίόύώ",
)


def _draw(seed: Column, place: Column | int, choices: Column | int) -> Column:
    """A number below ``choices``."""
    return F.pmod(F.xxhash64(seed, F.lit(place) if isinstance(place, int) else place), choices).cast("int")


def _same_class(c: Column, number: Column) -> Column:
    """A character of the class of ``c``."""
    result = c
    for members in CLASSES:
        pick = F.substr(F.lit(members), F.pmod(number, F.lit(len(members))).cast("int") + 1, F.lit(1))
        result = F.when(F.instr(F.lit(members), c) > 0, pick).otherwise(result)
    return result


def _substituted(text: Column, seed: Column, first: int = 0) -> Column:
    """The text with every character from ``first`` on replaced within its class."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_join(
        F.transform(chars, lambda c, i: F.when(i < first, c).otherwise(_same_class(c, F.xxhash64(seed, i)))), ""
    )


def _luhn_digit(payload: Column) -> Column:
    """The check digit for a string of digits."""
    digits = F.reverse(F.filter(F.split(payload, ""), lambda c: c != ""))

    def weigh(c: Column, i: Column) -> Column:
        twice = c.cast("int") * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(c.cast("int"))

    total = F.aggregate(F.transform(digits, weigh), F.lit(0), lambda s, x: s + x)
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def _kind(found: Column) -> Column:
    """The kind of a match."""
    result = F.lit("name")
    for kind, pattern in reversed(list(KINDS.items())[:-1]):
        result = F.when(found.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(result)
    return result


def _gender(head: Column) -> Column:
    """The gender that titles tell, or n."""

    def one_of(titles: tuple[str, ...]) -> Column:
        return head.rlike(rf"(?<!\p{{L}})(?:{'|'.join(titles)})(?!\p{{L}})")

    return F.when(one_of(FEMALE), "f").when(one_of(MALE), "m").otherwise("n")


def _canonical(word: Column) -> Column:
    return F.translate(F.lower(word), "’", "'")


def _head(found: Column) -> Column:
    return F.regexp_extract(found, f"^{_HEAD}", 0)


def _pieces(found: Column) -> tuple[Column, Column, Column]:
    """A name's body, its pieces and how many come before the surname's."""
    body = F.substr(found, F.length(_head(found)) + 1)
    last = F.regexp_extract(body, _LAST, 0)
    before = F.substr(body, F.lit(1), F.length(body) - F.length(last))

    def all_of(text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))

    return body, all_of(body), F.size(all_of(before))


def _script(name: Column) -> Column:
    return (
        F.when(name.rlike(r"\p{IsCyrillic}"), "Cyrillic").when(name.rlike(r"\p{IsGreek}"), "Greek").otherwise("Latin")
    )


def _entity(kind: Column | str, canonical: Column, country: Column | str = "") -> Column:
    lit = [F.lit(c) if isinstance(c, str) else c for c in (kind, country)]
    return F.struct(lit[0].alias("kind"), canonical.alias("canonical"), lit[1].alias("fixed"))


def entities_of(found: Column, kind: Column) -> Column:
    """The entities of a match of a kind: kind, canonical form and what of it stays."""
    digits = F.regexp_replace(found, r"\D", "")
    _, pieces, n_given = _pieces(found)
    given = F.concat(F.lit("given-"), _gender(_head(found)))

    def part(p: Column, i: Column) -> Column:
        mine = i < n_given
        return _entity(
            F.when(mine, given).otherwise("surname"), _canonical(p), F.when(mine, _script(p)).otherwise(F.lit(""))
        )

    names = F.filter(F.transform(pieces, part), lambda e: F.length(e["canonical"]) > 1)
    return (
        F.when(kind == "name", names)
        .when(kind == "email", F.array(_entity(kind, F.lower(found))))
        .when(kind == "iban", F.array(_entity(kind, F.regexp_replace(found, " ", ""))))
        .when(kind == "ip", F.array(_entity(kind, found)))
        .when(
            kind == "phone",
            F.array(_entity(kind, digits, F.regexp_replace(F.regexp_extract(found, r"^\+\d{1,3}", 0), r"\D", ""))),
        )
        .otherwise(F.array(_entity(kind, digits)))
    )


def _pick(lists: dict[str, list[str]], script: Column, number: Column) -> Column:
    """One of the list of a script, Latin if the script has none."""
    result = None
    for name in ("Latin", "Cyrillic", "Greek"):
        members = lists[name]
        one = F.element_at(F.array(*map(F.lit, members)), F.pmod(number, F.lit(len(members))).cast("int") + 1)
        result = one if result is None else F.when(script == name, one).otherwise(result)
    return result


def _syllables(seed: Column, count: Column, script: Column) -> Column:
    def syllable(i: Column) -> Column:
        start = _pick(STARTS, script, F.xxhash64(seed, F.lit("start"), i))
        return F.concat(start, _pick(VOWELS, script, F.xxhash64(seed, F.lit("vowel"), i)))

    return F.array_join(F.transform(F.sequence(F.lit(1), count.cast("int")), syllable), "")


def _given_name(kind: Column, seed: Column, draw: Column, script: Column) -> Column:
    def ended(gender: str) -> Column:
        ends = {name: ENDS[name, gender] for name in STARTS}
        return F.concat(_syllables(seed, draw + 1, script), _pick(ends, script, F.xxhash64(seed, F.lit("end"))))

    return F.when(kind == "given-f", ended("f")).when(kind == "given-m", ended("m")).otherwise(ended("n"))


def _family_name(canonical: Column, seed: Column, draw: Column, script: Column) -> Column:
    """What stands between apostrophes is made anew, single letters within their class."""

    def part(p: Column, i: Column) -> Column:
        own = F.concat(seed, i.cast("string"))
        end = F.regexp_extract(p, _SURNAME_END, 0)
        # A consonant goes before an end that starts with a vowel.
        opens = _same_class(F.substr(end, F.lit(1), F.lit(1)), F.lit(0)).isin("a", "à", "а", "α", "ά")
        joint = F.when(opens, _pick(STARTS, script, F.xxhash64(own, F.lit("joint")))).otherwise("")
        made = F.concat(_syllables(own, draw + 2, script), joint, end)
        return F.when(F.length(p) > 1, made).otherwise(_substituted(p, own))

    return F.array_join(F.transform(F.split(canonical, "'"), part), "'")


def _candidate(kind: Column, canonical: Column, fixed: Column, draw: Column, key: str) -> Column:
    """The surrogate of an entity at its ``draw``-th attempt."""
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canonical, draw).cast("binary"), 256)
    whole = _substituted(canonical, seed)
    n = F.length(canonical)
    # From the fourth draw on, addresses grow: short ones may have used up their class.
    longer = F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.greatest(draw - 2, F.lit(1))),
            lambda i: F.when(draw >= 3, _same_class(F.lit("b"), F.xxhash64(seed, F.lit("more"), i))).otherwise(F.lit("")),
        ),
        "",
    )
    at = F.instr(canonical, "@")
    top = F.regexp_extract(canonical, r"\.[a-z]+$", 0)
    domain = F.substr(canonical, at + 1, n - at - F.length(top))
    local = F.substr(canonical, F.lit(1), at - 1)
    email = F.concat(
        _substituted(local, seed), longer, F.lit("@"), _substituted(domain, F.concat(seed, F.lit("@"))), top
    )
    octets = F.transform(
        F.filter(F.split(canonical, r"\."), lambda o: o != ""), lambda o, i: (_draw(seed, i, F.lit(254)) + 1).cast("string")
    )
    payload = F.concat(F.substr(canonical, F.lit(1), F.lit(1)), _substituted(F.substr(canonical, F.lit(2), n - 2), seed))
    valid = _luhn_digit(F.substr(canonical, F.lit(1), n - 1)) == F.substr(canonical, n, F.lit(1))
    last = F.when(valid, _luhn_digit(payload)).otherwise(F.substr(whole, n, F.lit(1)))
    script = _script(canonical)
    kept = F.length(fixed)
    return (
        F.when(kind == "email", email)
        .when(kind == "iban", F.concat(F.substr(canonical, F.lit(1), F.lit(2)), F.substr(whole, F.lit(3), n)))
        .when(kind == "card", F.concat(payload, last))
        .when(kind == "ssn", F.concat(F.lit("9"), F.substr(whole, F.lit(2), n)))
        .when(kind == "ip", F.array_join(octets, "."))
        .when(kind == "phone", F.concat(F.substr(canonical, F.lit(1), kept), F.substr(whole, kept + 1, n)))
        .when(kind == "surname", _family_name(canonical, seed, draw, script))
        .otherwise(_given_name(kind, seed, draw, script))
    )


def assign(entities: DataFrame, key: str) -> DataFrame:
    """kind, canonical and surrogate of all distinct entities (kind, canonical, fixed).

    In each round the entities without a surrogate draw one; it stands unless the
    same was drawn or given before within the kind, or is itself an entity.
    """
    if not key:
        raise ValueError("surrogates need a key")
    mentioned = entities.groupBy("kind", "canonical").agg(F.min("fixed").alias("fixed"))
    waiting = materialise(mentioned, "entities")
    known = waiting.select("kind", F.col("canonical").alias("surrogate"))
    settled: list[DataFrame] = []
    for draw in range(MAX_DRAWS):
        drawn = waiting.withColumn(
            "surrogate", _candidate(F.col("kind"), F.col("canonical"), F.col("fixed"), F.lit(draw), key)
        )
        taken = reduce(DataFrame.unionByName, [s.select("kind", "surrogate") for s in settled], known)
        taken = taken.distinct().withColumn("taken", F.lit(True))
        rivals = Window.partitionBy("kind", "surrogate").orderBy("canonical")
        drawn = drawn.withColumn("rank", F.row_number().over(rivals)).join(taken, ["kind", "surrogate"], "left")
        drawn = materialise(drawn.withColumn("ok", (F.col("rank") == 1) & F.col("taken").isNull()), "drawn")
        settled.append(drawn.where("ok").select("kind", "canonical", "surrogate"))
        waiting = drawn.where("NOT ok").select("kind", "canonical", "fixed")
        if waiting.isEmpty():
            return reduce(DataFrame.unionByName, settled)
    raise ValueError(f"no distinct surrogates after {MAX_DRAWS} draws: too many entities of one format")


def _entry(surrogates: Column, kind: Column | str, canonical: Column) -> Column:
    """The surrogate that a text's map has for an entity."""
    return F.try_element_at(surrogates, F.concat_ws("\x1f", F.lit(kind) if isinstance(kind, str) else kind, canonical))


def _cased(word: Column, surrogate: Column, given: Column) -> Column:
    """The surrogate with the capitals and apostrophes of the word it stands for."""

    def capital(c: Column, i: Column) -> Column:
        was = F.substr(word, i + 1, F.lit(1))
        return F.when((was != F.lower(was)) & (~given | (i == 0)), F.upper(c)).otherwise(c)

    chars = F.filter(F.split(surrogate, ""), lambda c: c != "")
    cased = F.when(word == F.upper(word), F.upper(surrogate)).otherwise(F.array_join(F.transform(chars, capital), ""))
    return F.when(F.instr(word, "’") > 0, F.translate(cased, "'", "’")).otherwise(cased)


def _woven(gaps: Column, words: Column) -> Column:
    return F.array_join(F.zip_with(gaps, words, lambda gap, w: F.concat(gap, F.coalesce(w, F.lit("")))), "")


def _mentions_replaced(gap: Column, surrogates: Column) -> Column:
    """What stands between matches, with surrogates for words of the text's names."""

    def replaced(word: Column) -> Column:
        result = word
        for kind in reversed(_NAME_KINDS):
            known = _entry(surrogates, kind, _canonical(word))
            result = F.when(known.isNotNull(), _cased(word, known, F.lit(kind != "surname"))).otherwise(result)
        return result

    words = F.regexp_extract_all(gap, F.lit(_MENTION), F.lit(0))
    return _woven(F.split(gap, _MENTION, -1), F.transform(words, replaced))


def _rendered(found: Column, kind: Column, surrogates: Column, key: str) -> Column:
    """A match in its own format, with the surrogate in place of what it said."""
    entity = entities_of(found, kind)[0]
    only = _entry(surrogates, entity["kind"], entity["canonical"])
    spaced = F.split(found, r"[0-9A-Z]", -1)
    signs = F.filter(F.split(only, ""), lambda c: c != "")
    refilled = F.array_join(F.zip_with(spaced, signs, lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), "")
    body, pieces, n_given = _pieces(found)
    given = F.concat(F.lit("given-"), _gender(_head(found)))

    def part(p: Column, i: Column) -> Column:
        mine = i < n_given
        surrogate = _entry(surrogates, F.when(mine, given).otherwise("surname"), _canonical(p))
        seed = F.xxhash64(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("initial"), F.lower(p)).cast("binary"), 256))
        initial = _same_class(F.lower(p), seed)
        return F.when(F.length(p) == 1, F.upper(initial)).otherwise(_cased(p, surrogate, mine))

    name = F.concat(_head(found), _woven(F.split(body, _PIECE, -1), F.transform(pieces, part)))
    email = F.when(found == F.upper(found), F.upper(only)).otherwise(only)
    return (
        F.when(kind == "name", name)
        .when(kind == "email", email)
        .when(kind == "ip", only)
        .otherwise(refilled)
    )


def _one_gender(mentions: DataFrame) -> DataFrame:
    """Mentions with ``as_kind``: given names without gender as one that titles elsewhere tell, if any do."""
    told = mentions.where(F.col("kind").isin("given-f", "given-m")).groupBy("canonical").agg(F.max("kind").alias("told"))
    told = told.withColumn("kind", F.lit("given-n"))
    return mentions.join(told, ["kind", "canonical"], "left").withColumn("as_kind", F.coalesce("told", "kind")).drop("told")


def session_key(spark: SparkSession, default: str = "") -> str:
    """The key that the session holds under ``KEY_SETTING``."""
    return spark.conf.get(KEY_SETTING, default)


def replace(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The rows as ``_row`` with ``_text``, the text without personal data, and ``_kinds``, of its matches in order."""
    if not key:
        raise ValueError("surrogates need a key")
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"))
    body = F.col("_row").getField(text)
    # Texts are searched once, and those with a match cut at it; all rows are kept with what was found.
    found = whole.select(
        F.monotonically_increasing_id().alias("_id"), "_row", F.regexp_extract_all(body, F.lit(ANY), F.lit(0)).alias("_found")
    )
    some = F.size("_found") > 0
    found = found.withColumn("_gaps", F.when(some, F.split(body, ANY, -1)))
    found = found.withColumn("_kinds", F.when(some, F.transform("_found", _kind)))
    found = materialise(found, "personal")
    matches = F.arrays_zip("_found", "_kinds")
    personal = found.where("_gaps IS NOT NULL")
    mentions = personal.select("_id", F.explode(matches).alias("m"))
    mentions = mentions.select("_id", F.explode(entities_of(F.col("m._found"), F.col("m._kinds"))).alias("e"))
    mentions = mentions.groupBy("_id", "e.kind", "e.canonical").agg(F.min("e.fixed").alias("fixed"))
    mentions = materialise(_one_gender(mentions), "mentions")
    given = assign(mentions.select(F.col("as_kind").alias("kind"), "canonical", "fixed"), key)
    pairs = F.struct(F.concat_ws("\x1f", "kind", "canonical").alias("entity"), "surrogate")
    maps = (
        mentions.join(given.withColumnRenamed("kind", "as_kind"), ["as_kind", "canonical"])
        .groupBy("_id")
        .agg(F.map_from_entries(F.collect_list(pairs)).alias("_map"))
    )
    rendered = F.transform(matches, lambda m: _rendered(m["_found"], m["_kinds"], F.col("_map"), key))
    named = F.array_contains("_kinds", "name")
    gaps = F.transform("_gaps", lambda gap: F.when(named, _mentions_replaced(gap, F.col("_map"))).otherwise(gap))
    # A name of initials only has no entity, so a text may have no map.
    changed = personal.join(maps, "_id", "left").select("_row", _woven(gaps, rendered).alias("_text"), "_kinds")
    clean = found.where("_gaps IS NULL")
    clean = clean.select("_row", body.alias("_text"), F.array().cast("array<string>").alias("_kinds"))
    return clean.unionByName(changed)


def without_personal_data(docs: DataFrame, key: str, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with surrogates in the text, and its length where there is a column for it."""
    done = replace(docs, key, text)
    new = {text: F.col("_text")}
    if n_chars in docs.columns:
        kind = docs.schema[n_chars].dataType
        changed = F.size("_kinds") > 0
        new[n_chars] = F.when(changed, F.length("_text")).otherwise(F.col("_row").getField(n_chars)).cast(kind)
    return done.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op8: each document's text without personal data, and what was found."""
    done = replace(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark, TABLES_KEY))
    return done.select(
        "_row.doc_id",
        F.size("_kinds").cast("bigint").alias("n_found"),
        F.array_join("_kinds", ",").alias("kinds"),
        F.col("_text").alias("text"),
    )
