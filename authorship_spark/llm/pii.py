"""Surrogates for personal data: keyed, consistent in type, distinct, and the same for the same value.

A pattern finds the entities of a text. Each is made of one or two units (an
address has its local part and its domain, a person a first name and a surname),
and a unit's surrogate is a function of the key, the unit's kind and its canonical
value: so every mention of one value gets one surrogate, in whatever document and
format it stands. Surrogates keep separators, letter case, script, the gender of a
title, country codes and check digits; numbers, keys and mail names also their length
(names of people and octets of an address don't). The distinct units of the whole
corpus are then checked: no two of a kind may have one surrogate, and none may be
a value that occurs; units that fail are hashed again until all are distinct, and
from the fourth time on surrogates grow, so that short values never run out of
them. Masks (one sign again and again, as in ``********``) stay, and so do numbers of
a card's form whose check digit isn't a card's. Only SQL functions are used. No pattern
repeats a group that it could step back into, so a match of any length takes bounded stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, join_hot, materialize, text_of, with_columns

#: Titles by the gender that they tell.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Mme", "Madame", "Frau", "Sra", "Señora", "госпожа", "г-жа"),
    "m": ("Mr", "Mister", "Monsieur", "Herr", "Señor", "господин", "г-н"),
    "n": ("Dr", "Prof"),
}
#: Words before a value that must stay secret.
SECRETS = ("token", "password", "passwd", "pwd", "secret", "api_key", "apikey", "access_key")
_TITLE = "|".join(t for group in TITLES.values() for t in group)
#: A capitalised name with its apostrophes and hyphens, but not a possessive ending; and initials before it.
_NAME = r"\p{Lu}(?=\p{L}|['’-])(?!['’](?!\p{Lu}\p{L}|\p{L}{3})|-(?!\p{Lu}))\p{L}*+(?:(?:['’](?=\p{Lu}\p{L}|\p{L}{3})|-(?=\p{Lu}))\p{L}++)*+"
_INITIALS = r"(?:\p{Lu}\. ?){0,3}"
_LOCAL = r"[\p{L}\p{N}._%+-]"
CARD = "[0-9](?:[ -]?[0-9]){12,18}"
#: One alternative for each kind; the first that fits at a place counts.
KINDS = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++@[\p{{L}}\p{{N}}-]++(?:\.[\p{{L}}\p{{N}}-]++)++",
    "secret": rf"(?<!\w)(?i:{'|'.join(SECRETS)})\s{{0,2}}[=:]\s{{0,2}}[\"']?[^\s\"',;]{{8,}}",
    "aws_key": r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])",
    "api_key": r"(?<!\w)(?:sk|pk|ghp|gho|xox[bp])[_-][A-Za-z0-9_-]{16,}",
    "iban": r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": rf"(?<![0-9]){CARD}(?![0-9])",
    "phone": r"(?<![0-9\w])(?:\+(?=(?:[ ().-]{0,2}[0-9]){8})[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5}|(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})(?![0-9])",
    "person": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.? {_INITIALS}{_NAME}(?: {_INITIALS}{_NAME})?",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: What every match of a kind has in it: a text without any of these has no entity.
HINTS = {
    "email": "@",
    "secret": rf"(?i:{'|'.join(SECRETS)})\s{{0,2}}[=:]",
    "aws_key": "A[KS]IA",
    "api_key": "(?:sk|pk|ghp|gho|xox[bp])[_-]",
    "iban": "[A-Z]{2}[0-9]{2}",
    "ip": r"[0-9]\.[0-9]",
    "ssn": "[0-9]{3}-",
    "card": "[0-9](?:[ -]?[0-9]){2}",
    "phone": r"\+[0-9]|[0-9]{3}[ .-][0-9]",
    "person": rf"(?:{_TITLE})\.? \p{{Lu}}",
}
#: Kinds of units whose surrogates are made of syllables.
NAMES = ("first_f", "first_m", "first_n", "last")
_HINT = "|".join(HINTS.values())
_CYRILLIC = "абвгдежзиклмнопрстуфхцчшэюя"
_LATIN = "ba de fi go ku la me ni ro su ta ve wi jo pa ze".split()
_SLAVIC = "ба де фи го ку ла ме ни ро су та ве ви жо па зе".split()


def _kind(m: Column) -> Column:
    out = F.lit("person")  # a later mention of a surname
    for kind, pattern in reversed(KINDS.items()):
        # the tests of one match; what stands around it was seen when it was found
        own = {
            "email": "@.*\\.", "secret": rf"^(?i:{'|'.join(SECRETS)})\s{{0,2}}[=:]", "ip": r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$",
            "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "card": f"^{CARD}$", "phone": r"^[+(0-9]", "person": rf"^(?:{_TITLE})\.? ",
        }.get(kind, f"^(?:{pattern})$")
        out = F.when(m.rlike(own), F.lit(kind)).otherwise(out)
    return out


def _prefix(kind: Column, m: Column) -> Column:
    """What stays as it is before the value of a secret, a person's names, a key or an IBAN."""
    return (
        F.when(kind == "secret", F.regexp_extract(m, r"^([^=:]*[=:]\s{0,2}[\"']?)", 1))
        .when(kind == "person", F.regexp_extract(m, r"^(\S+ )", 1))
        .when(kind == "aws_key", F.substring(m, 1, 4))
        .when(kind == "api_key", F.regexp_extract(m, r"^([a-z]+[_-])", 1))
        .when(kind == "iban", F.substring(m, 1, 2))
        .otherwise("")
    )


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _surname(person: Column) -> Column:
    return F.substring_index(F.substring_index(person, " ", -1), ".", -1)


def _pattern_with(surnames: Column) -> Column:
    """PATTERN, and the surnames as they stand; the longer of two with one beginning comes first."""
    return F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(F.sort_array(surnames, asc=False), "|"), F.lit(r")(?![\p{L}\p{N}])"))


def with_units(entities: DataFrame) -> DataFrame:
    """Adds kind, prefix, rest and the units (kind, canon) of the entities ``m``."""
    rows = entities.withColumn("kind", _kind(F.col("m")))
    kind, m = F.col("kind"), F.col("m")
    rows = rows.withColumn("prefix", _prefix(kind, m)).withColumn("rest", m.substr(F.length("prefix") + 1, F.length("m"))).withColumn("digits", _digits(m))
    unit = lambda k, c: F.struct(k.alias("kind"), c.alias("canon"))
    title = F.regexp_replace(F.trim("prefix"), r"\.$", "")
    gender = F.when(title.isin(*TITLES["f"]), "first_f").when(title.isin(*TITLES["m"]), "first_m").otherwise("first_n")
    surname = _surname(F.col("rest"))
    last = unit(F.lit("last"), F.lower(surname))
    first = unit(gender, F.lower(F.regexp_replace(F.regexp_extract("rest", r"^((?:\p{Lu}\. ?)++|\S++)", 1), " ", "")))
    parts = (
        F.when(kind == "email", F.array(unit(F.lit("email"), F.lower(m)), unit(F.lit("domain"), F.lower(F.substring_index(m, "@", -1)))))
        .when(kind == "person", F.when(F.col("rest") != surname, F.array(first, last)).otherwise(F.array(last)))
        .when(kind == "phone", F.array(unit(kind, F.right("digits", F.lit(10)))))
        .when(kind.isin("card", "ssn"), F.array(unit(kind, F.col("digits"))))
        .when(kind == "ip", F.array(unit(kind, m)))
        .when(kind == "iban", F.array(unit(kind, F.replace(m, F.lit(" ")))))
        .otherwise(F.array(unit(kind, F.regexp_replace("rest", " ", ""))))
    )
    return rows.withColumn("units", parts)


def _spelled(kind: Column, canon: Column) -> Column:
    """The part of a unit's canonical value that its surrogate spells anew."""
    email, domain = F.substring_index(canon, "@", 1), F.regexp_replace(canon, r"\.[^.]*$", "")
    return F.when(kind == "email", email).when(kind == "domain", domain).when(kind == "iban", F.substring(canon, 5, 1 << 30)).otherwise(canon)


def _mod97(account: Column) -> Column:
    """The remainder by which an account number with its country and check digits behind it is judged: 1 is right."""
    values = F.transform(F.split(account, ""), lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(F.ascii(c) - 48))
    return F.aggregate(values, F.lit(0), lambda r, v: ((r * F.when(v > 9, 100).otherwise(10) + v) % 97).cast("int"))


def is_entity(m: Column) -> Column:
    """Whether a match is what it looks like: digits of a card's form have to end in its check digit."""
    return ~m.rlike(f"^(?:{CARD})$") | F.call_function("luhn_check", _digits(m))


def with_surrogates(units: DataFrame, key: str) -> DataFrame:
    """Adds ``new`` to units (kind, canon, attempt): a text of the canonical value's form."""
    seed = F.concat_ws("\u0001", F.lit(key), "kind", "canon", F.col("attempt").cast("string"))
    rows = units.withColumn("seed", seed).withColumn("stream", F.concat(F.sha2("seed", 256), F.sha2(F.concat("seed", F.lit("+")), 256)))
    # 64 bytes of the key's stream, by place
    rows = rows.withColumn("b", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.conv(F.col("stream").substr(k * 2 + 1, F.lit(2)), 16, 10).cast("int")))
    byte = lambda i: F.get("b", (i % 64).cast("int"))
    kind, canon, n = F.col("kind"), F.col("canon"), F.length("canon")
    rows = rows.withColumn("spelled", _spelled(kind, canon))
    spelled = F.col("spelled")
    most = F.when(canon.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 6).otherwise(26)
    bare = ~spelled.rlike(r"[\p{L}\p{N}]")
    more = F.greatest(F.col("attempt") - 3, F.lit(0))  # characters by which the surrogate is longer than the value
    added = lambda one: F.when(more > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), one), "")).otherwise("")

    def char(c: Column, i: Column, most: Column, bare: Column) -> Column:
        b = byte(i)
        cyrillic = F.lit(_CYRILLIC).substr((b % len(_CYRILLIC) + 1).cast("int"), F.lit(1))
        return (
            F.when(c.between("0", "9"), F.char(48 + b % 10))
            .when(c.between("a", "z"), F.char(97 + b % most))
            .when(c.between("A", "Z"), F.char(65 + b % most))
            .when(c.rlike(r"\p{IsCyrillic}"), F.when(c == F.lower(c), cyrillic).otherwise(F.upper(cyrillic)))
            .when(c.rlike(r"\p{L}"), F.when(c == F.lower(c), F.char(97 + b % 26)).otherwise(F.char(65 + b % 26)))
            .when(c.rlike(r"\p{N}"), F.char(48 + b % 10))
            .when(bare, F.char(97 + b % 26))
            .otherwise(c)
        )

    longer = added(lambda k: F.char(F.when(kind.isin("aws_key", "iban"), 65).otherwise(97) + byte(F.length("spelled") + k) % most))
    # through an array of one, so that a value is searched once and not for each of its characters
    about = F.array(F.struct(most.alias("most"), bare.alias("bare")))
    spelt = F.transform(about, lambda x: F.array_join(F.transform(F.split("spelled", ""), lambda c, i: char(c, i, x["most"], x["bare"])), ""))[0]
    rows = rows.withColumn("text", F.when(~kind.isin(*NAMES, "card", "phone", "ssn", "ip"), F.concat(spelt, longer)))
    # digits are counted from the right, so a number with and without its country code agree
    rows = rows.withColumn("long", n + more)
    n = F.col("long")
    digit = lambda k: F.when(k == 1, byte(n - k) % 9 + 1).otherwise(byte(n - k) % 10).cast("string")
    numeric = kind.isin("card", "phone", "ssn")
    rows = rows.withColumn("number", F.when(numeric, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), digit), "")))
    ends = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(F.left("number", n - 1), d.cast("string")))
    luhn = lambda x: F.call_function("luhn_check", x)
    rows = rows.withColumn("valid", F.when(luhn(canon), F.array_join(F.filter(ends, luhn), "")).otherwise(F.col("number")))
    # an account's check digits fit, where they did
    turned = F.concat(F.col("text"), F.substring("canon", 1, 2))
    fits = _mod97(F.concat(F.substring(canon, 5, 1 << 30), F.substring(canon, 1, 4))) == 1
    checked = F.when(fits, F.lpad((98 - _mod97(F.concat(turned, F.lit("00")))).cast("string"), 2, "0")).otherwise(F.concat(*((byte(F.lit(60 + k)) % 10).cast("string") for k in (0, 1))))
    octets = F.concat_ws(".", *((byte(F.lit(k)) % 254 + 1).cast("string") for k in range(4)))
    octets = F.concat(octets, added(lambda k: F.concat(F.lit("."), (byte(k + 3) % 254 + 1).cast("string"))))
    # names of three syllables; a first name ends as its gender's names tend to
    script = canon.rlike(r"\p{IsCyrillic}")
    syllables = F.when(script, F.lit(list(_SLAVIC))).otherwise(F.lit(list(_LATIN)))
    end = F.when(kind == "first_f", F.when(script, "на").otherwise("na")).when(kind == "first_m", F.when(script, "рт").otherwise("rt")).when(kind == "first_n", F.when(script, "ль").otherwise("l")).otherwise(F.when(script, "ко").otherwise("son"))
    size = F.when(more > 0, more + 4).otherwise(3)
    name = F.array_join(F.transform(F.sequence(F.lit(1), size), lambda i: F.element_at("syllables", byte(i) % 16 + 1)), "")
    rows = rows.withColumn("syllables", syllables).withColumn("name", F.initcap(F.concat(name, end)))
    new = (
        F.when(kind == "domain", F.concat("text", F.lit("."), F.substring_index("canon", ".", -1)))
        .when(kind == "card", F.col("valid"))
        .when(kind.isin("phone", "ssn"), F.col("number"))
        .when(kind == "ip", octets)
        .when(kind == "iban", F.concat(checked, "text"))
        .when(kind.isin(*NAMES), F.col("name"))
        .otherwise(F.col("text"))
    )
    return rows.withColumn("new", new).select("kind", "canon", "attempt", "new")


def _into_form(form: Column, filling: Column, pattern: str) -> Column:
    """``filling`` in the places of ``form`` that match ``pattern``, the others as they are; what is left of it follows."""
    place = lambda i: F.length(F.regexp_replace(F.left(form, i + 1), f"[^{pattern}]", ""))
    filled = F.array_join(F.transform(F.split(form, ""), lambda c, i: F.when(c.rlike(f"[{pattern}]"), filling.substr(place(i), F.lit(1))).otherwise(c)), "")
    return F.concat(filled, filling.substr(F.length(F.regexp_replace(form, f"[^{pattern}]", "")) + 1, F.length(filling)))


def rendered(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """(m, kind, surrogate): each distinct entity's surrogate in the entity's own format."""
    parts = entities.select("m", "kind", "prefix", "rest", "digits", F.posexplode("units").alias("at", "unit"))
    parts = parts.select("m", "prefix", "rest", "digits", F.col("kind").alias("entity"), "at", "unit.kind", "unit.canon").join(mapping, ["kind", "canon"])
    one = lambda k: F.max(F.when(F.col("at") == k, F.col("new")))
    rows = parts.groupBy("m", "entity", "prefix", "rest", "digits").agg(one(0).alias("one"), one(1).alias("two"))
    kind, m = F.col("entity"), F.col("m")
    country = F.left("digits", F.greatest(F.length("digits") - 10, F.lit(0)))
    new = (
        F.when(kind == "email", F.concat("one", F.lit("@"), "two"))
        .when(kind == "person", F.concat_ws("", "prefix", F.concat_ws(" ", "one", "two")))
        .when(kind == "phone", _into_form(m, F.concat(country, F.col("one")), "0-9"))
        .when(kind.isin("card", "ssn"), _into_form(m, F.col("one"), "0-9"))
        .when(kind == "ip", F.col("one"))
        .when(kind == "iban", F.concat("prefix", _into_form(F.col("rest"), F.col("one"), "A-Z0-9")))
        .otherwise(F.concat("prefix", "one"))
    )
    return rows.select("m", kind.alias("kind"), new.alias("surrogate"))


def distinct_surrogates(units: DataFrame, key: str) -> DataFrame:
    """(kind, canon, new) of the distinct units: no two of a kind have one ``new``, and none is a value that occurs.

    Of units with one surrogate the least keeps it. Only those that failed are
    hashed again, and all are checked again, until every surrogate is free. Masks
    hide their value already and keep their text.
    """
    units = units.select("kind", "canon").distinct().withColumn("spelled", _spelled(F.col("kind"), F.col("canon")))
    mask = F.col("spelled").rlike(r"^([^\p{L}\p{N}])\1*$")
    masks = units.where(mask).select("kind", "canon", F.when(F.col("kind") == "domain", F.col("canon")).otherwise(F.col("spelled")).alias("new"))
    now = units.where(~mask).select("kind", "canon").withColumn("attempt", F.lit(0))
    while True:
        now = materialize(with_surrogates(now, key), "surrogates")
        domain = F.when(F.col("kind") == "email", F.substring_index("canon", "@", -1))
        twice = now.withColumn("nth", F.row_number().over(Window.partitionBy("kind", "new", domain).orderBy("attempt", "canon"))).where("nth > 1")
        there = now.select("kind", F.when(F.col("kind") == "email", F.substring_index("canon", "@", 1)).when(F.col("kind") == "iban", F.substring("canon", 3, 1 << 30)).otherwise(F.col("canon")).alias("low")).distinct()
        taken = now.withColumn("low", F.when(F.col("kind").isin(*NAMES), F.lower("new")).otherwise(F.col("new"))).join(there, ["kind", "low"], "left_semi")
        bad = twice.select("kind", "canon").unionByName(taken.select("kind", "canon")).distinct().withColumn("bad", F.lit(1))
        bad = materialize(bad, "taken")
        if bad.isEmpty():
            return now.select("kind", "canon", "new").unionByName(masks)
        now = now.join(bad, ["kind", "canon"], "left").select("kind", "canon", (F.col("attempt") + F.coalesce("bad", F.lit(0))).alias("attempt"))


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in place of entities, and ``entities`` (kind, surrogate) in order.

    All rows and columns stay (``entities`` takes the place of a column of that name; no
    other name can clash); texts without an entity are unchanged, a null text becomes
    empty. The same key gives the same surrogates for the same corpus. A surname that
    follows a title is replaced wherever its row has it. Repeated rows get equal
    results; ids aren't read. Only texts with entities are shuffled. An empty table
    gives no rows.
    """
    text = text_of(text_col)
    found = F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    others = F.struct(F.lit(None).cast("int").alias("none"), *(column(c) for c in docs.columns if c != text_col))
    # written once, so that no text is searched again for the mentions, the filling and the rest
    marked = docs.select(others.alias("row"), text.alias("text"), F.coalesce(found, F.array().cast("array<string>")).alias("found"))
    marked = materialize(marked.withColumn("k", F.monotonically_increasing_id()), "marked")
    any_entity = F.exists("found", is_entity)
    some = marked.where(any_entity)
    people = F.filter("found", lambda m: m.rlike(rf"^(?:{_TITLE})\.? \p{{Lu}}"))
    some = some.withColumn("surnames", F.array_distinct(F.transform(people, _surname)))
    pattern = F.when(F.size("surnames") > 0, _pattern_with(F.col("surnames"))).otherwise(F.lit(PATTERN))
    some = some.withColumn("pattern", pattern)
    again = F.regexp_extract_all("text", F.col("pattern"), F.lit(0))
    some = some.withColumn("found", F.when(F.size("surnames") > 0, again).otherwise(F.col("found")))
    mentions = materialize(some.select("k", F.explode(F.array_distinct(F.filter("found", is_entity))).alias("m")), "mentions")
    entities = materialize(with_units(mentions.groupBy("m").agg(F.count(F.lit(1)).alias("n"))), "entities")
    mapping = distinct_surrogates(entities.select(F.explode("units").alias("u")).select("u.kind", "u.canon"), key)
    new = materialize(rendered(entities, mapping).join(entities.select("m", "n"), "m"), "rendered")
    by_row = join_hot(mentions, new, ["m"], "n", mentions.count())
    by_row = by_row.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("m", F.struct("kind", "surrogate")))).alias("map"))  # a text's entities at most
    rows = some.join(by_row, "k")
    filling = F.transform("found", lambda m: F.coalesce(F.element_at("map", m)["surrogate"], m))
    filled = F.array_join(F.zip_with(F.split("text", F.col("pattern"), -1), filling, lambda gap, e: F.concat(gap, F.coalesce(e, F.lit("")))), "")
    listed = F.filter(F.transform("found", lambda m: F.element_at("map", m)), lambda e: e.isNotNull())
    none = F.array().cast("array<struct<kind:string,surrogate:string>>")
    changed = with_columns(rows, docs, {text_col: filled, "entities": listed})
    return changed.unionByName(with_columns(marked.where(~any_entity), docs, {text_col: F.col("text"), "entities": none}))
