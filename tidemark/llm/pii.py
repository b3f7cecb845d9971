"""Surrogates for personal data, with DataFrame functions only.

One pattern finds e-mail addresses, phone, card, social-security and account numbers, IPv4 addresses, secrets
and titled names. Each distinct entity gets a surrogate from a keyed hash: digits become digits, letters
letters of the same script and case, separators stay, card and account numbers keep a right (or wrong) check
digit, names keep their script and gender. The same entity has the same surrogate wherever it occurs, however it
is capitalised; a surname has its own, so that a person named with and without a given name stays one person. A
given name is one entity whatever title stands before it: its gender is that of its titles in all documents, open
if none tells or they differ.

Surrogates are checked for collisions: of entities that share one, and of those whose surrogate is itself an
entity of the input, all but the first draw again until all are distinct. Only distinct entities are shuffled
for that; of the documents, only those with entities are, once, to meet their replacements.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import store

MOST_DRAWS = 100

# Titles by gender, and the endings that mark a surrogate given name's gender.
MALE = ["Mr", "Herr", "Señor", "Monsieur", "Господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Госпожа"]
OPEN = ["Dr", "Prof"]
ENDINGS = {"latin": {"male": ["an", "ert", "iel", "or"], "female": ["a", "ina", "ela", "ia"], "open": ["is", "e", "y", "in"]},
           "cyrillic": {"male": ["ан", "ор", "ил", "им"], "female": ["а", "ина", "ела", "ия"], "open": ["и", "е", "ай", "ой"]},
           "greek": {"male": ["ος", "ης", "ας", "ιλ"], "female": ["α", "ινα", "ελα", "ια"], "open": ["ι", "ε", "υ", "ο"]}}
SYLLABLES = {"latin": ["ba", "de", "fi", "ga", "ho", "ka", "le", "mi", "no", "pa", "ra", "se", "to", "vi", "wa", "zu"],
             "cyrillic": ["ба", "де", "фи", "га", "хо", "ка", "ле", "ми", "но", "па", "ра", "се", "то", "ви", "ва", "зу"],
             "greek": ["βα", "δε", "φι", "γα", "χο", "κα", "λε", "μι", "νο", "πα", "ρα", "σε", "το", "βι", "θα", "ζυ"]}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME_PART = r"\p{Lu}[\p{L}\p{M}’'\-]*"
# what may stand before a further part of a name: initials and lower-case particles
_BEFORE = r"(?:(?:\p{Lu}\.-?)++|von|vom|van|de|der|den|del|della|degli|di|da|das|do|dos|du|des|la|le|las|los|y|zu|zum|zur|ten|ter|bin|ibn|ben|al|el|af|av|фон|де|ван)"
_NAME = rf"(?:(?:{_BEFORE} )*+{_NAME_PART}|{_NAME_PART})(?: (?:{_BEFORE} )*+{_NAME_PART})*+"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@(?:[\p{L}\p{N}\-]++\.)+\p{L}{2,}",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+?\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)|(?<![\p{L}\p{N}+])\+\d{1,3}(?:[ .\-]?\d{2,4}){3,4}(?!\d)|(?<![\p{N}.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d.\-]*\d)",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\d]|\.\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "iban": r"(?<![\p{L}\p{N}])(?i:[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){3,7}(?: ?[a-z0-9]{1,3})?)(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}])(?:\d{4}[ \-]){3}\d{4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])\d{13,19}(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?:(?i:(?=[a-f]*\d)[0-9a-f]{32,})|(?i:akia)[A-Za-z0-9]{16}|(?i:gh[pousr]_)[A-Za-z0-9]{30,}|(?i:sk-)[A-Za-z0-9\-]{20,}|(?i:aiza)[A-Za-z0-9_\-]{35}|(?i:xox[abeoprs]-)[A-Za-z0-9\-]{10,})(?![\p{L}\p{N}])",
    "name": rf"(?<!\p{{L}})(?iu:{'|'.join(MALE + FEMALE + OPEN)})\.? {_NAME}",
}
ANY = "|".join(PATTERNS.values())


def kind_of(value: Column) -> Column:
    out = None
    for k in ("email", "ssn", "ip", "secret", "card", "iban", "name"):
        out = (F if out is None else out).when(value.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k))
    return out.otherwise(F.lit("phone"))


def entities_of(value: Column) -> Column:
    """(kind, value) parts that get surrogates of their own: a name's surname, which is its last part, and each part before it as a given name; else the whole."""
    words = F.split(value, " ")
    title = F.lower(F.regexp_replace(words[0], r"\.$", ""))
    among = lambda names: title.isin([n.lower() for n in names])
    gender = F.when(among(MALE), "male").when(among(FEMALE), "female").otherwise("open")
    part = lambda kind, x: F.struct(kind.alias("kind"), x.alias("value"))
    given = F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), lambda w: part(F.concat(F.lit("given_"), gender), F.regexp_replace(w, r"\.", "")))
    name = F.concat(given, F.array(part(F.lit("surname"), F.element_at(words, -1))))
    kind = kind_of(value)
    return F.when(kind == "name", name).otherwise(F.array(part(kind, value)))


def group_of(kind: Column) -> Column:
    """What entities are told apart within: their kind, one for all given names."""
    return F.when(kind.startswith("given_"), F.lit("given")).otherwise(kind)


def canonical(kind: Column, value: Column) -> Column:
    """What makes two mentions the same entity: capitals do not, except in secrets that are not hexadecimal."""
    return F.when((kind == "secret") & ~value.rlike("^[0-9A-Fa-f]+$"), value).otherwise(F.lower(value))


def _bytes(key: str, kind: Column, value: Column, draw: Column, length: Column) -> Column:
    """Two hexadecimal digits for each of ``length`` characters, from the key, the entity and the draw."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, draw.cast("string"), value)
    block = F.transform(F.sequence(F.lit(0), F.floor(length / 64).cast("int")), lambda b: F.sha2(F.concat_ws("\x1f", F.lit(key), b.cast("string"), F.sha2(seed, 256)).cast("binary"), 512))
    return F.array_join(block, "")


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, 2 * i + 1, F.lit(2)), 16, 10).cast("int")


def _letters(value: Column, stream: Column, digits_only: bool = False) -> Column:
    """Each digit for a digit, each letter for a letter of its script and case, the rest unchanged."""
    alphabets = [("[0-9]", "0123456789")]
    if not digits_only:
        alphabets += [("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (r"[ß-öø-ÿ]", "àáâäçèéêëìíîïñòóôöùúûü"),
                      (r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфхцчшэюя"), (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"), (r"\p{IsHan}", "王李张刘陈杨黄赵吴周徐孙马朱胡林"), (r"\p{L}", "abcdefghijklmnopqrstuvwxyz")]

    def one(c: Column, i: Column) -> Column:
        out, b = None, _byte(stream, i)
        for pattern, alphabet in alphabets:
            out = (F if out is None else out).when(c.rlike(pattern), F.substring(F.lit(alphabet), b % len(alphabet) + 1, F.lit(1)))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Sum of Luhn's rule over digits whose last is the check digit."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _mod97(text: Column) -> Column:
    def add(rest: Column, c: Column) -> Column:
        digit = c.try_cast("int")
        return F.when(c.rlike("[0-9]"), (rest * 10 + digit) % 97).otherwise((rest * 100 + F.ascii(F.upper(c)) - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def with_surrogate(df: DataFrame, key: str, number: int) -> DataFrame:
    """Adds the surrogates of the canonical entities (kind, value) at their draw of that number."""
    kind, value, draw = F.col("kind"), F.col("value"), F.lit(number)
    rows = df.withColumns({
        "stream": _bytes(key, kind, value, draw, F.length(value) + 8),
        "host_stream": F.when(kind == "email", _bytes(key, F.lit("domain"), F.substring_index(value, "@", -1), F.lit(0), F.length(value))),
    })
    return rows.withColumn("surrogate", _surrogate(kind, value, draw, F.col("stream"), F.col("host_stream"))).drop("stream", "host_stream")


def _surrogate(kind: Column, value: Column, draw: Column, stream: Column, host_stream: Column) -> Column:
    domain = F.substring_index(value, "@", -1)
    zone = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(zone))
    more = F.when(draw > 8, F.substring(F.conv(F.substring(stream, F.lit(1), F.lit(12)), 16, 36), 1, 6)).otherwise("")
    email = F.concat(_letters(F.substring_index(value, "@", 1), stream), F.lower(more), F.lit("@"), _letters(host, host_stream), zone)

    country = F.regexp_extract(value, r"^\+?\d{1,3}(?=[ .\-]?\()|^\+\d{1,3}(?=[ .\-])|^\+\d", 0)
    local = F.substring(value, F.length(country) + 1, F.length(value))
    phone = F.concat(country, _letters(local, stream, digits_only=True))

    octets = F.split(value, r"\.")
    private = F.when(octets[0].isin("10", "127"), 1).when(value.rlike(r"^192\.168\.|^172\.(1[6-9]|2\d|3[01])\."), 2).otherwise(0)
    drawn = F.transform(octets, lambda o, i: F.when(i < private, o).otherwise((_byte(stream, i) % 222 + 1 + F.when((i == 0) & ((_byte(stream, i) % 222 + 1).isin(10, 127, 172, 192)), 1).otherwise(0)).cast("string")))
    ip = F.array_join(drawn, ".")

    free = F.concat(F.substring(value, 1, 1), _letters(F.substring(value, F.lit(2), F.length(value)), stream, digits_only=True))
    body = F.substring(free, F.lit(1), F.length(free) - 1)
    right = (10 - _luhn(F.concat(F.regexp_replace(body, r"\D", ""), F.lit("0"))) % 10) % 10
    was_right = _luhn(F.regexp_replace(value, r"\D", "")) % 10 == 0
    card = F.concat(body, F.when(was_right, right).otherwise((right + 1 + _byte(stream, F.length(value) + 1) % 9) % 10).cast("string"))

    account = _letters(F.substring(value, F.lit(5), F.length(value)), stream)
    check = 98 - _mod97(F.concat(F.regexp_replace(account, " ", ""), F.substring(value, 1, 2), F.lit("00")))
    iban = F.concat(F.substring(value, 1, 2), F.lpad(check.cast("string"), 2, "0"), account)

    hexadecimal = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("[0-9]"), (_byte(stream, i) % 10).cast("string")).otherwise(F.substring(F.lit("abcdef"), _byte(stream, i) % 6 + 1, F.lit(1)))), "")
    prefix = F.regexp_extract(value, r"^(?i:akia|gh[pousr]_|sk-|aiza|xox[abeoprs]-)", 0)
    secret = F.when(value.rlike("^[0-9a-f]+$"), hexadecimal).otherwise(F.concat(prefix, _letters(F.substring(value, F.length(prefix) + 1, F.length(value)), stream)))

    def syllabic(script: str, ending: Column | None) -> Column:
        syllable = lambda i: F.element_at(F.array(*map(F.lit, SYLLABLES[script])), _byte(stream, i) % 16 + 1)
        # more syllables the longer the search, so that distinct names never run out
        stem = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1) + F.least(draw, F.lit(5)) + F.lit(int(ending is None))), syllable), "")
        return stem if ending is None else F.concat(stem, ending)

    def named(script: str) -> Column:
        end = None
        for gender in ("male", "female", "open"):
            end = (F if end is None else end).when(kind == f"given_{gender}", F.element_at(F.array(*map(F.lit, ENDINGS[script][gender])), _byte(stream, F.lit(7)) % 4 + 1))
        return F.when(kind == "surname", syllabic(script, None)).otherwise(syllabic(script, end))

    name = F.when(value.rlike(r"\p{IsCyrillic}"), named("cyrillic")).when(value.rlike(r"\p{IsGreek}"), named("greek")).otherwise(named("latin"))
    return (
        F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "card", card).when(kind == "iban", iban)
        .when(kind == "secret", secret).when(kind == "ssn", _letters(value, stream, digits_only=True)).otherwise(name)
    )


def resolved(entities: DataFrame, key: str) -> DataFrame:
    """(group, value, surrogate) of distinct canonical entities; no two of a group share a surrogate, and none is an entity."""
    said = {g: F.bool_or(F.col("kind") == f"given_{g}").alias(g) for g in ("male", "female")}
    distinct = entities.groupBy(group_of(F.col("kind")).alias("group"), "value").agg(*said.values())
    gender = F.when(F.col("male") & ~F.col("female"), "given_male").when(F.col("female") & ~F.col("male"), "given_female").otherwise("given_open")
    kind = F.when(F.col("group") == "given", gender).otherwise(F.col("group"))
    everyone = store.kept(distinct.select(kind.alias("kind"), "value", "group"), "entities")
    done, left, draw = None, everyone, 0
    while not left.isEmpty():
        if draw == MOST_DRAWS:
            raise ValueError("surrogates collide too often")
        drawn = with_surrogate(left, key, draw)
        taken = everyone.select("group", F.col("value").alias("surrogate"), F.lit(True).alias("taken"))
        if done is not None:
            taken = taken.union(done.select("group", "surrogate", F.lit(True))).distinct()
        placed = drawn.join(taken, ["group", "surrogate"], "left")
        turn = F.row_number().over(Window.partitionBy("group", "surrogate").orderBy("value"))
        placed = store.kept(placed.withColumn("good", F.col("taken").isNull() & (turn == 1)), "drawn")
        good = placed.where("good").select("kind", "value", "group", "surrogate")
        done = good if done is None else done.union(good)
        left = placed.where("not good").select("kind", "value", "group")
        draw += 1
    return everyone.select("group", "value", F.lit("").alias("surrogate")) if done is None else done.select("group", "value", "surrogate")


def _cased(value: Column, new: Column) -> Column:
    """``new`` with the capitals of ``value``: all, the first, or character by character."""
    upper = (F.upper(value) == value) & (F.lower(value) != value) & (F.length(value) > 1)
    first = F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new)))
    title = F.initcap(value) == value
    each = F.array_join(F.transform(F.split(new, ""), lambda c, i: F.when(F.lower(F.substring(value, i + 1, F.lit(1))) != F.substring(value, i + 1, F.lit(1)), F.upper(c)).otherwise(c)), "")
    return F.when(upper, F.upper(new)).when(F.lower(value) == value, new).when(title & ~value.contains("@"), first).otherwise(each)


def anonymised(docs: DataFrame, secret_key: str, *, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, ``text`` with surrogates, and n_entities: the number of replaced mentions.

    A null text stays null with 0 mentions; texts without a find stay as they are, an empty table stays empty. Whole
    texts are searched, of any length. Repeated rows are kept. The column n_entities is replaced if ``docs`` has one;
    columns of any other name, the helpers' own included, come back as they were.
    """
    rest = [c for c in docs.columns if c not in (text, "n_entities")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias("__pad")).alias("row"), F.col(text).alias("text"))
    # every entity but a secret or a name has a digit or an @, a secret has one or its prefix, and a name has a title: elsewhere the pattern need not run
    titled = reduce(lambda a, b: a | b, [F.contains(F.lower("text"), F.lit(t.lower() + end)) for t in MALE + FEMALE + OPEN for end in (" ", ". ")])
    found = F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    rows = rows.withColumn("found", F.when(F.col("text").rlike("[0-9@]|(?i:akia|gh[pousr]_|sk-|aiza|xox)") | titled, found).otherwise(F.array().cast("array<string>")))
    with_some = rows.where(F.size("found") > 0).withColumn("sets", F.array_sort(F.array_distinct("found")))
    # read twice below, and few of the documents: written once rather than searched again
    with_some = store.kept(with_some.withColumn("set_id", F.sha2(F.concat_ws("\x1f", "sets").cast("binary"), 256)), "mentions")
    parts = F.flatten(F.transform("sets", entities_of))
    known = F.transform(parts, lambda p: F.struct(p.kind.alias("kind"), canonical(p.kind, p.value).alias("value")))
    sets = store.kept(with_some.groupBy("set_id").agg(F.first("sets").alias("sets")).select("set_id", F.array_distinct(known).alias("known")), "sets")
    members = sets.select("set_id", F.explode("known").alias("e")).select("set_id", "e.kind", "e.value")
    named = members.withColumn("group", group_of(F.col("kind"))).join(resolved(members, secret_key), ["group", "value"])
    # a set is one document's entities; its map is as large as the document names. A name with two titles is there twice, alike
    maps = named.groupBy("set_id").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\x1f", "group", "value"), F.col("surrogate")))).alias("map"))

    def replaced(m: Column) -> Column:
        get = lambda p: _cased(p.value, F.element_at(F.col("map"), F.concat_ws("\x1f", group_of(p.kind), canonical(p.kind, p.value))))
        own = F.array_join(F.transform(entities_of(m), get), " ")
        return F.when(kind_of(m) == "name", F.concat(F.substring_index(m, " ", 1), F.lit(" "), own)).otherwise(own)

    gaps = F.split("text", ANY, -1)
    new = F.concat(gaps[0], F.array_join(F.transform("found", lambda m, i: F.concat(replaced(m), gaps[i + 1])), ""))
    changed = with_some.join(maps, "set_id").select("row", new.alias("text"), F.size("found").cast("bigint").alias("n_entities"))
    same = rows.where(F.size("found") == 0).select("row", "text", F.lit(0).cast("bigint").alias("n_entities"))
    every = changed.union(same)
    return every.select(*[F.col("text").alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "n_entities"], "n_entities")
