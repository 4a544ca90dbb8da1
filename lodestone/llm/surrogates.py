"""Personal data replaced by keyed surrogates, in DataFrame functions only.

Detected: e-mail addresses, phone numbers, card numbers, social security numbers, IBANs, IPv4 addresses, secrets, and
names after a title or a known first name, and the surnames so found in the rest of their text. A surrogate depends on a key and on the entity without its
formatting, so every mention, however written, gets the same one, and takes the mention's own format: separators, case,
number of digits, country code, a valid check digit where there was one, gender of first names, script of names.

Distinct entities get distinct surrogates, and no surrogate equals a detected entity: proposals are compared in
rounds over the table of distinct entities; the smallest entity keeps a contested proposal, the others make the next one.
Where a format is used up or nearly so (all two-letter addresses of a domain are in the corpus), what is left after ``ATTEMPTS``
rounds, or after two that settle nothing, is exchanged: surrogates stay distinct and differ from the entity they stand for, but are entities of other texts.

A mention is looked up per distinct text, so copies cost one lookup, and only texts with mentions are shuffled.
Null text stays null, empty text empty. Repeated rows are treated alike; an empty table gives no rows. All other
columns are kept; their names do not matter, except that ``mentions_column`` is added or replaced.
"""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.rank import ranked
from lodestone.llm.text import text_or_empty, unused
from lodestone.session import cut_lineage

ATTEMPTS = 32
KEY_SETTING = "spark.lodestone.surrogates.key"

# Titles by gender, first names by script and gender, surnames by script.
TITLES = {"male": ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "господин"],
          "female": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "госпожа"]}
FIRST = {("latin", "male"): ["James", "John", "Robert", "Michael", "William", "David", "Thomas", "Daniel", "Peter", "Hans", "Klaus", "Stefan",
                             "Pierre", "Jean", "Luc", "Carlos", "Juan", "Pedro", "Miguel", "Andrew"],
         ("latin", "female"): ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Karen", "Anna", "Ursula", "Monika",
                               "Sabine", "Marie", "Claire", "Sophie", "Carmen", "Lucía", "Elena", "Isabel", "Emily"],
         ("cyrillic", "male"): ["Иван", "Пётр", "Алексей", "Дмитрий", "Сергей", "Николай", "Михаил", "Андрей"],
         ("cyrillic", "female"): ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Светлана"]}
LAST = {"latin": ["Smith", "Brown", "Taylor", "Wilson", "Clark", "Walker", "Müller", "Weber", "Wagner", "Becker", "Martin", "Bernard", "Dubois",
                  "Moreau", "García", "López", "Romero", "Torres", "Baker", "Hughes"],
        "cyrillic": ["Иванов", "Смирнов", "Кузнецов", "Попов", "Волков", "Лебедев", "Козлов", "Новиков"]}
SYLLABLES = {"latin": ["ba", "den", "fi", "gor", "ha", "kel", "lu", "mar", "ni", "po", "ras", "sel", "ti", "vo", "wen", "zu"],
             "cyrillic": ["ба", "ден", "фи", "гор", "ха", "кел", "лу", "мар", "ни", "по", "рас", "сел", "ти", "во", "вен", "зу"]}

_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_KNOWN = "|".join(n for names in FIRST.values() for n in names)
_NAME = r"\p{Lu}\p{L}{1,30}"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,}|(?:AKIA|ghp_|sk-)[0-9A-Za-z]{16,})(?![\p{L}\p{N}])",
    "ip": r"(?<![\p{N}.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
    "phone": r"(?<![\p{L}\p{N}])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?(?:\d{2,4}|\d(?=[ .-]\d{2}))(?:[ .-]?(?:\d{2,4}|\d(?=[ .-]\d{2}))){1,6}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "card": r"(?<![\p{N}+.-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?!\d)",
    "ssn": r"(?<![\p{N}-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "name": rf"(?=[A-ZÀ-ÞА-Я])(?:(?<=(?<!\p{{L}})(?:{_TITLE})\.? ){_NAME}|(?<=(?<!\p{{L}})(?:{_TITLE})\.? {_NAME} ){_NAME}|(?<=(?<!\p{{L}})(?:{_KNOWN}) ){_NAME}|(?<!\p{{L}})(?:{_KNOWN})(?= {_NAME}))",
}
DETECT = "|".join(f"(?:{p})" for p in PATTERNS.values())
# Every mention of every pattern holds one of these, or follows one, so other texts need no detailed look.
HINT = (rf"@|\d{{3}}|\d\.\d|\+\d|[A-Z]{{2}}\d{{2}}|(?=[A-ZÀ-ÞА-Яг])(?:(?:{_TITLE})\.? \p{{Lu}}|(?:{_KNOWN}) \p{{Lu}}|AKIA)|ghp_|sk-|[0-9a-f]{{32}}")


def _any(options: list[str]) -> Column:
    return F.array(*[F.lit(o) for o in options])


def _pick(options: list[str], number: Column) -> Column:
    return F.element_at(_any(options), (F.pmod(number, F.lit(len(options))) + 1).cast("int"))


def _script(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _kind(mention: Column) -> Column:
    """Type of a mention from its own characters; what matches nothing else is a name."""
    tests = {"email": "@", "iban": r"^[A-Z]{2}\d{2}[ A-Z0-9]{12,}$", "secret": r"^(?:[0-9a-f]{32,}|(?:AKIA|ghp_|sk-).*)$", "ip": r"^(?:\d+\.){3}\d+$",
             "ssn": r"^\d{3}-\d{2}-\d{4}$", "card": r"^\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d+$", "phone": r"^[+(\d]"}
    return reduce(lambda got, kind: got.when(mention.rlike(tests[kind]), kind), list(tests)[1:], F.when(mention.rlike(tests["email"]), "email")).otherwise("name")


def bare(names: Column) -> Column:
    """Expression of all mentions in a text with these surnames, which are letters only; null without surnames."""
    forms = F.array_distinct(F.flatten(F.transform(names, lambda n: F.array(n, F.upper(n)))))
    return F.when(F.size(names) > 0, F.concat(F.lit(DETECT + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(forms, "|"), F.lit(r")(?![\p{L}\p{N}])")))


def cut(text: Column, further: Column | None = None) -> tuple[Column, Column]:
    """Mentions in reading order, and the text around them, one piece more. ``further`` replaces DETECT where not null."""
    found, around = F.regexp_extract_all(text, F.lit(DETECT), F.lit(0)), F.split(text, DETECT, -1)
    if further is None:
        return found, around
    return (F.when(further.isNull(), found).otherwise(F.regexp_extract_all(text, further, F.lit(0))),
            F.when(further.isNull(), around).otherwise(F.split(text, further, -1)))


def mentions(found: Column, around: Column) -> Column:
    """array<struct(kind, entity)> of ``cut``; the entity is the mention without its formatting.

    The kind of a name holds its part, gender and script, taken from the words around it.
    """

    def describe(mention: Column, i: Column) -> Column:
        kind, before, after = _kind(mention), F.get(around, i), F.get(around, i + 1)
        titled = before.rlike(rf"(?:{_TITLE})\.? $")
        leads = (after == " ") & (titled | ((before != " ") & mention.isin([n for names in FIRST.values() for n in names])))
        female = before.rlike(rf"(?:{'|'.join(TITLES['female'])})\.? $") | (~titled & mention.isin(
            [n for (_, gender), names in FIRST.items() if gender == "female" for n in names]))
        name = F.concat(F.lit("name "), F.when(leads, F.when(female, "female").otherwise("male")).otherwise("last"), F.lit(" "), _script(mention))
        bare = F.when(kind.isin("email", "name"), F.lower(mention)).when(kind.isin("phone", "card", "ssn"), F.regexp_replace(mention, r"\D", "")).when(
            kind == "iban", F.replace(mention, F.lit(" "), F.lit(""))).otherwise(mention)
        return F.struct(F.when(kind == "name", name).otherwise(kind).alias("kind"), bare.alias("entity"))

    return F.transform(found, describe)


def _letters(stream: Column, i: Column, alphabet: str) -> Column:
    """Character of ``alphabet`` chosen by two hexadecimal digits of the key stream."""
    at = F.pmod(i * 2, F.lit(126)) + 1
    value = F.conv(F.substring(stream, at.cast("int"), F.lit(2)), 16, 10).cast("int")
    return F.substring(F.lit(alphabet), (F.pmod(value, F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))


def _same_classes(entity: Column, stream: Column, kept: Column) -> Column:
    """Each digit becomes a digit, each letter a letter of its case; ``kept`` says by character and position what stays."""
    def swap(c: Column, i: Column) -> Column:
        return F.when(kept(c, i), c).when(c.rlike(r"\d"), _letters(stream, i, "0123456789")).when(
            c.rlike(r"\p{Lu}"), _letters(stream, i, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(
            c.rlike(r"\p{IsCyrillic}"), _letters(stream, i, "абвгдежзиклмнопрстуфхцчшэюя")).when(
            c.rlike(r"\p{L}"), _letters(stream, i, "abcdefghijklmnopqrstuvwxyz")).otherwise(c)
    return F.array_join(F.transform(F.split(entity, ""), swap), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits modulo ten; zero when the check digit is right."""
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, (F.length(digits) - i).cast("int"), F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 0, digit).otherwise(twice - F.when(twice > 9, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10


def proposal(kind: Column, entity: Column, attempt: Column, key: str) -> Column:
    """Surrogate of an entity at an attempt, without formatting."""
    stream = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, entity, attempt.cast("string")), 512)
    number = F.xxhash64(stream)
    nothing = lambda c, i: F.lit(False)
    domain_end = F.length(F.substring_index(entity, ".", -1))
    email = _same_classes(entity, stream, lambda c, i: i >= F.length(entity) - domain_end)
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.conv(F.substring(stream, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast(
        "int")).cast("string")), ".")
    secret = F.when(entity.rlike("^[0-9a-f]+$"), F.substring(F.repeat(stream, 64), F.lit(1), F.length(entity))).otherwise(
        _same_classes(entity, stream, lambda c, i: i < F.length(F.regexp_extract(entity, "^(?:AKIA|ghp_|sk-)", 0))))
    phone = _same_classes(entity, stream, lambda c, i: i < F.greatest(F.length(entity) - 10, F.lit(0)))
    body = _same_classes(F.substring(entity, F.lit(1), F.length(entity) - 1), stream, nothing)
    checked = F.concat(body, F.pmod(10 - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    card = F.when(_luhn(entity) == 0, checked).otherwise(_same_classes(entity, stream, nothing))
    iban = _same_classes(entity, stream, lambda c, i: i < 2)

    def name(script: str) -> Column:
        made = F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), attempt + 1), lambda i: _pick(
            SYLLABLES[script], F.xxhash64(stream, i))), ""))
        listed = F.when(kind.startswith("name last"), _pick(LAST[script], number)).when(
            kind.startswith("name male"), _pick(FIRST[script, "male"], number)).otherwise(_pick(FIRST[script, "female"], number))
        return F.when(attempt == 0, listed).otherwise(made)

    return F.when(kind == "email", email).when(kind == "ip", octets).when(kind == "secret", secret).when(kind == "phone", phone).when(
        kind == "card", card).when(kind == "ssn", _same_classes(entity, stream, nothing)).when(kind == "iban", iban).when(
        kind.endswith("cyrillic"), name("cyrillic")).otherwise(name("latin"))


def shape(kind: Column, entity: Column) -> Column:
    """What a surrogate keeps of an entity: the fixed part, the class of every other character, and whether a check digit is right."""
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(entity, "[0-9]", "0"), r"\p{Lu}", "A"), r"\p{IsCyrillic}", "я"), r"\p{Ll}", "a")
    fixed = (F.when(kind == "email", F.substring_index(entity, ".", -1))
             .when(kind == "phone", F.substring(entity, F.lit(1), F.greatest(F.length(entity) - 10, F.lit(0))))
             .when(kind == "iban", F.substring(entity, F.lit(1), F.lit(2)))
             .when(kind == "secret", F.concat(F.regexp_extract(entity, "^(?:AKIA|ghp_|sk-)", 0), entity.rlike("^[0-9a-f]+$").cast("string")))
             .when(kind == "card", (_luhn(entity) == 0).cast("string")).otherwise(""))
    # Names and addresses of machines take any surrogate of their kind.
    return F.when(kind.startswith("name") | (kind == "ip"), "").otherwise(F.concat(fixed, F.lit(" "), classes))


def assign(entities: DataFrame, key: str, attempts: int = ATTEMPTS) -> DataFrame:
    """(kind, entity, surrogate) for distinct (kind, entity): rounds of proposals, then the exchange of what is left."""
    family = F.substring_index("kind", " ", 1)
    entities = cut_lineage(entities.select("kind", "entity").distinct())
    real = entities.select(family.alias("family"), F.lower("entity").alias("taken")).distinct()
    todo, settled, idle = entities.withColumn("attempt", F.lit(0)), [], 0
    for _ in range(attempts):
        made = cut_lineage(todo.withColumn("surrogate", proposal(F.col("kind"), F.col("entity"), F.col("attempt"), key)).withColumn("family", family).withColumn(
            "taken", F.lower("surrogate")))
        used = reduce(DataFrame.unionByName, [real, *[s.select(family.alias("family"), F.lower("surrogate").alias("taken")) for s in settled]])
        free = made.join(used, ["family", "taken"], "left_anti")
        settled.append(cut_lineage(free.groupBy("family", "taken").agg(F.min(F.struct("kind", "entity", "surrogate")).alias("w")).select("w.*")))
        todo = cut_lineage(made.join(settled[-1], ["kind", "entity"], "left_anti").select("kind", "entity", (F.col("attempt") + 1).alias("attempt")))
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        idle = idle + 1 if settled[-1].isEmpty() else 0
        if idle == 2:
            break
    return exchange(todo, reduce(DataFrame.unionByName, settled), key)


def exchange(left: DataFrame, settled: DataFrame, key: str) -> DataFrame:
    """Surrogates where a format is used up: the entities left over in a shape pass their own values on, in a keyed order, in a circle.

    No surrogate is taken twice, as a settled one is no entity, and none is the entity it stands for. One that is alone in its shape
    changes places with a settled entity: it takes that one's surrogate and lends its own value. Where there is none either, the
    last proposal stands.
    """
    form = shape(F.col("kind"), F.col("entity")).alias("shape")
    placed = cut_lineage(ranked(left.select("kind", "entity", form), ["kind", "shape"], [F.xxhash64(F.lit(key), F.col("entity")), F.col("entity")], "place"))
    sizes = placed.groupBy("kind", "shape").agg(F.count(F.lit(1)).alias("n"))
    sized = placed.join(sizes, ["kind", "shape"])
    circle = (sized.where("n > 1").withColumn("place", (F.col("place") + 1) % F.col("n"))
              .join(placed.withColumnRenamed("entity", "surrogate"), ["kind", "shape", "place"]).select("kind", "entity", "surrogate"))
    lone = sized.where("n = 1").select("kind", "shape", "entity")
    partners = settled.select("kind", form, F.struct("entity", "surrogate").alias("p")).join(lone.select("kind", "shape"), ["kind", "shape"], "left_semi").groupBy(
        "kind", "shape").agg(F.min("p").alias("p"))
    swaps = cut_lineage(lone.join(partners, ["kind", "shape"], "left"))
    last = proposal(F.col("kind"), F.col("entity"), F.lit(ATTEMPTS), key)
    taken = swaps.select("kind", "entity", F.coalesce("p.surrogate", last).alias("surrogate"))
    lent = swaps.where("p IS NOT NULL").select("kind", F.col("p.entity").alias("entity"), F.col("entity").alias("surrogate"))
    kept = settled.join(lent, ["kind", "entity"], "left_anti").select("kind", "entity", "surrogate")
    return reduce(DataFrame.unionByName, [kept, circle, taken, lent])


def _render(mention: Column, surrogate: Column) -> Column:
    """The surrogate in the format of a mention."""
    kind = _kind(mention)
    filled = F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(c.rlike("[0-9A-Z]"), F.substring(surrogate, (F.length(F.regexp_replace(
        F.substring(mention, F.lit(1), i.cast("int")), "[^0-9A-Z]", "")) + 1).cast("int"), F.lit(1))).otherwise(c)), "")
    cased = F.when((F.upper(mention) == mention) & (F.lower(mention) != mention), F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind.isin("phone", "card", "ssn", "iban"), filled).when(kind.isin("email", "name"), cased).otherwise(surrogate)


def session_key(spark: SparkSession) -> str:
    """The key in the session setting ``spark.lodestone.surrogates.key``; where unset, a random one that lasts as long as the session."""
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING)


def pseudonymise(docs: DataFrame, key: str, text_column: str = "text", mentions_column: str = "n_mentions") -> DataFrame:
    """``docs`` with surrogates in the text column and the number of replaced mentions in ``mentions_column``.

    Who knows ``key`` can try entities against surrogates, so it is the caller's to keep; ``session_key`` reads or makes one.
    """
    if not key:
        raise ValueError("surrogates need a key")
    text = text_or_empty(text_column)
    likely = text.rlike(HINT)
    h1, h2, payload, further = (unused(docs, n) for n in ("hash_1", "hash_2", "surrogates", "further"))
    hashes = [F.xxhash64(text).alias(h1), F.xxhash64(text, F.lit(1)).alias(h2)]
    found, around = cut(text)
    said = docs.where(likely).select(*hashes, text.alias("text"), found.alias("found"), mentions(found, around).alias("m")).where(F.size("m") > 0)
    last = F.array_distinct(F.filter("found", lambda mention, i: F.get(F.col("m"), i)["kind"].startswith("name last")))
    said = said.withColumn(further, bare(last))
    more = mentions(*cut(F.col("text"), F.col(further)))
    said = said.select(h1, h2, further, F.when(F.col(further).isNull(), F.col("m")).otherwise(more).alias("m"))
    said = cut_lineage(said.groupBy(h1, h2).agg(F.first("m").alias("m"), F.first(further).alias(further)))
    spoken = said.select(h1, h2, F.posexplode("m").alias("at", "m")).select(h1, h2, "at", "m.kind", "m.entity")
    known = assign(spoken, key)
    lists = spoken.join(known, ["kind", "entity"]).groupBy(h1, h2).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "surrogate"))), lambda s: s["surrogate"]).alias(payload))
    lists = lists.join(said.select(h1, h2, further), [h1, h2])
    column = docs[f"`{text_column}`"]
    others = [docs[f"`{c}`"] for c in docs.columns if c not in (text_column, mentions_column)]
    plain = docs.where(~likely).select(*others, column, F.lit(0).alias(mentions_column))
    joined = docs.where(likely).withColumns({h1: hashes[0], h2: hashes[1]}).join(lists, [h1, h2], "left")
    found, around = cut(text, F.col(further))
    shown = F.zip_with(found, payload, _render)
    whole = F.array_join(F.zip_with(around, F.array_append(shown, F.lit("")), lambda a, b: F.concat(a, b)), "")
    replaced = joined.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (text_column, mentions_column)],
                             F.when(F.col(payload).isNull(), F.col(f"`{text_column}`")).otherwise(whole).alias(text_column),
                             F.coalesce(F.size(payload), F.lit(0)).alias(mentions_column))
    out = plain.unionByName(replaced)
    return out.select(*docs.columns, *([] if mentions_column in docs.columns else [mentions_column]))
