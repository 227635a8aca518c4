"""PII: detected entities get keyed surrogates of the same type, gender, script and format.

A surrogate is drawn from a keyed hash of the entity's kind and normal form, so every
mention of an entity anywhere gets the same one. Digits stay digits and letters letters of
their case, punctuation stays; card numbers keep their check digit valid, addresses stay
addresses, names keep title, gender and script. A family name is an entity of its own, so
`Mr. Smith` after `Mr. John Smith` keeps the family's surrogate; given names are drawn for
each whole name. A surrogate that two entities share (given names: two of one title and
family), or that is itself an entity of the corpus, is drawn again for all but the first of
them: the check runs over the distinct entities of all rows until none is left. The redraws
are few; up to REDRAWS they go into the plan as literals, beyond that they are joined.

Native throughout: DataFrame functions only. The text is scanned, never shuffled, unless
there are more than REDRAWS redraws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, drop_cut, table

#: The key of the registered query and the pipeline, for repeatable results. It protects nothing: production callers
#: pass a secret of their own, or set tollgate.pii.key in the session.
KEY = "tollgate-surrogates"
#: Mail domains that say nothing about a person; others are replaced.
PUBLIC_MAIL = ("gmail.com", "outlook.com", "hotmail.com", "yahoo.com", "icloud.com", "example.com", "example.org")
REDRAWS = 500
# Patterns of the kinds, titles by gender, and names by gender and script.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9-])"
PHONE = r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z+])\+[0-9]{8,14}(?![0-9])"
MALE = "Mr|Sir|Herr|Monsieur|Señor|Господин"
FEMALE = "Mrs|Ms|Miss|Madam|Frau|Madame|Señora|Госпожа"
# A name's word may have inner capitals, apostrophes and hyphens (but no possessive 's); further words may be initials or follow particles.
_LETTERS = r"[\p{L}\p{M}]"
_INNER = rf"(?:['’-](?!s(?!{_LETTERS})){_LETTERS}++)"
NAME = rf"\p{{Lu}}(?:{_LETTERS}++{_INNER}*+|{_INNER}++)"
INITIAL = rf"\p{{Lu}}(?:\.|(?=\x20\p{{Lu}}(?:[.'’-]|{_LETTERS})))"
PARTICLE = r"(?:(?:van|von|der|den|de|del|della|di|da|dos|du|la|le|ter|ten|zu|bin|al|el)\x20){0,3}"
PERSON = rf"(?<![\p{{L}}])(?:{FEMALE}|{MALE})\.?\x20{PARTICLE}(?:{NAME}|{INITIAL})(?:\x20{PARTICLE}(?:{NAME}|{INITIAL}))*+"
# Country codes of one and two digits; the others have three.
COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
ALL = "|".join((EMAIL, IP, SSN, CARD, PHONE, PERSON))
NAMES = {
    ("m", "latin"): ("Adam", "Bruno", "Carl", "David", "Erik", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Marc", "Nils", "Oscar", "Paul",
                     "Albert", "Boris", "Daniel", "Emil", "Frank", "Gustav", "Henry", "Jacob", "Kurt", "Lars", "Martin", "Oliver", "Peter", "Robert", "Simon", "Thomas"),
    ("f", "latin"): ("Anna", "Berta", "Clara", "Diana", "Elsa", "Flora", "Greta", "Helen", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula",
                     "Alice", "Bella", "Daria", "Emma", "Frida", "Gloria", "Hanna", "Ida", "Jana", "Kate", "Linda", "Martha", "Ruth", "Sarah", "Tina", "Vera"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь"),
    ("f", "cyrillic"): ("Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина"),
}
SYLLABLES = {
    "latin": ("ba", "de", "fi", "go", "ha", "ke", "li", "mo", "na", "pe", "ri", "so", "ta", "ve", "wi", "zo"),
    "cyrillic": ("ба", "де", "фи", "го", "ха", "ке", "ли", "мо", "на", "пе", "ри", "со", "та", "ве", "ви", "зо"),
}


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def female(c: Column) -> Column:
    return c.rlike(f"^(?:{FEMALE})\\.?\\x20")


def family(c: Column) -> Column:
    """The family name that a person's mention goes by: its last word, lowered, without the ending that a Cyrillic name of a woman adds."""
    last = F.lower(F.regexp_replace(F.substring_index(c, " ", -1), r"\.", ""))
    return F.when(female(c), F.regexp_replace(last, r"(?<=\p{IsCyrillic})а$", "")).otherwise(last)


def has_given(c: Column) -> Column:
    """More names than the last one; particles and the title are none."""
    return F.regexp_count(c, F.lit(r"\x20\p{Lu}")) > 1


def drawn_parts(c: Column) -> Column:
    """What is drawn for a mention: arrays of (kind, norm, scope, e). A surrogate has to be distinct within its scope.
    Of a person that is the family and, if there is one, the given name within title and family."""
    own = lambda k, n, scope: F.struct(k.alias("kind"), n.alias("norm"), scope.alias("scope"), c.alias("e"))
    of_family = own(F.lit("family"), family(c), F.lit(""))
    of_person = own(F.lit("person"), normal(c), F.concat_ws("|", F.regexp_extract(c, r"^(\S+?)\.?\x20", 1), family(c)))
    return F.when(kind(c) != "person", F.array(own(kind(c), normal(c), F.lit("")))).when(has_given(c), F.array(of_family, of_person)).otherwise(F.array(of_family))


def kind(c: Column) -> Column:
    return (F.when(c.contains("@"), "email").when(c.rlike(r"\p{L}"), "person").when(c.rlike(f"^(?:{IP})$"), "ip")
            .when(c.rlike(f"^(?:{SSN})$"), "ssn").when(c.rlike(f"^(?:{CARD})$"), "card").otherwise("phone"))


def normal(c: Column) -> Column:
    """The form under which mentions are one entity."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(c.contains("@"), F.lower(c)).when(c.rlike(r"\p{L}"), F.lower(F.regexp_replace(c, r"\.", ""))).when(kind(c) == "ip", c).when(c.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits)


def _byte(stream: Column, i) -> Column:
    at = F.pmod(i if isinstance(i, Column) else F.lit(i), F.lit(128)) * 2 + 1
    return F.conv(F.substr(stream, at.cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(values, n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def _luhn(digits: Column) -> Column:
    """Sum of a Luhn check over a string of digits, modulo 10."""
    n = F.char_length(digits)
    ds = F.transform(F.split(digits, ""), lambda d, i: F.when(F.pmod(n - i, F.lit(2)) == 0, F.pmod(d.cast("int") * 2, F.lit(10)) + F.when(d.cast("int") > 4, 1).otherwise(0)).otherwise(d.cast("int")))
    return F.pmod(F.aggregate(ds, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))), F.lit(10))


def _stream(key: str, *parts: Column) -> Column:
    """256 hex digits by a nested keyed hash (an inner and an outer pass, each with the key in front)."""
    inner = F.sha2(F.concat_ws("|", F.lit(f"{key}|inner"), *parts), 512)
    return let(inner, lambda i: F.concat(*[F.sha2(F.concat(F.lit(f"{key}|outer{j}|"), i), 512) for j in range(2)]))


def given_name(c: Column, n: Column, attempt: Column, key: str) -> Column:
    """A given name of the mention's gender and script; every further attempt adds one behind a hyphen, so none runs out."""
    cyr = c.rlike(r"\x20\p{IsCyrillic}")

    def names(stream):
        pick = lambda sex, script: F.transform(F.sequence(F.lit(0), attempt), lambda i: _pick(NAMES[sex, script], _byte(stream, i * 3)))
        return F.array_join(F.when(female(c) & cyr, pick("f", "cyrillic")).when(cyr, pick("m", "cyrillic")).when(female(c), pick("f", "latin")).otherwise(pick("m", "latin")), "-")

    return let(_stream(key, F.lit("person"), n, attempt.cast("string")), names)


def family_name(n: Column, attempt: Column, key: str) -> Column:
    """The family's surrogate as a man bears it; every further attempt adds a syllable."""
    def name(stream):
        pick = lambda script: F.array_join(F.transform(F.sequence(F.lit(1), attempt + 6), lambda i: _pick(SYLLABLES[script], _byte(stream, i))), "")
        return F.initcap(F.when(n.rlike(r"\p{IsCyrillic}"), F.concat(pick("cyrillic"), F.lit("в"))).otherwise(pick("latin")))

    return let(_stream(key, F.lit("family"), n, attempt.cast("string")), name)


def person(c: Column, n: Column, attempt: Column, of_family: Column, key: str) -> Column:
    """Title, given name if the mention has one, family name; capitals throughout stay so."""
    name = family_name(family(c), of_family, key)
    name = F.when(female(c) & name.rlike(r"\p{IsCyrillic}"), F.concat(name, F.lit("а"))).otherwise(name)
    both = F.when(has_given(c), F.concat_ws(" ", given_name(c, n, attempt, key), name)).otherwise(name)
    return F.concat(F.regexp_extract(c, r"^(\S+\x20)", 1), F.when(c.rlike(r"\x20\p{Lu}{2,}$"), F.upper(both)).otherwise(both))


def address(c: Column, stream: Column, attempt: Column) -> Column:
    """An IP address with octets as long as before, in the same private range if in one and in none if not. From the
    fifth draw on octets behind the range may be longer, from the ninth all may, so a crowded range has a way out."""
    part = lambda i: F.split(c, r"\.")[i].cast("int")
    number = lambda i: _byte(stream, i) * 256 + _byte(stream, i + 8)
    between = lambda i, low, high: F.pmod(number(i), F.lit(high - low + 1)) + low
    free = attempt >= 4
    octet = lambda i: F.when(free, between(i, 0, 255)).when(part(i) < 10, between(i, 0, 9)).when(part(i) < 100, between(i, 10, 99)).otherwise(between(i, 100, 255))
    # Ranges of public addresses only: 1 to 9, 11 to 99, 128 to 168, 173 to 191.
    public = F.when(attempt >= 8, between(0, 11, 99)).when(part(0) < 10, between(0, 1, 9)).when(part(0) < 100, between(0, 11, 99)).otherwise(
        F.when(F.pmod(_byte(stream, 16), F.lit(2)) == 0, between(0, 128, 168)).otherwise(between(0, 173, 191)))
    ranged = (attempt < 8) & (part(0).isin(0, 10, 127) | (part(0) >= 224))
    b = (attempt < 8) & (part(0) == 172) & part(1).between(16, 31)
    c16 = (attempt < 8) & ((part(0) == 192) & (part(1) == 168) | (part(0) == 169) & (part(1) == 254))
    first = F.when(ranged | b | c16, part(0)).otherwise(public)
    second = F.when(b, between(1, 16, 31)).when(c16, part(1)).otherwise(octet(1))
    return F.concat_ws(".", *[x.cast("string") for x in (first, second, octet(2), octet(3))])


def surrogate(c: Column, k: Column, n: Column, attempt: Column, key: str) -> Column:
    """The replacement of entity c (no person) of kind k and normal form n in its attempt-th draw."""
    stream = _stream(key, k, n, attempt.cast("string"))
    domain = F.when(c.contains("@"), _stream(key, F.lit("domain"), F.lower(F.substring_index(c, "@", -1))))
    x = F.struct(c.alias("c"), k.alias("k"), n.alias("n"), stream.alias("stream"), domain.alias("domain"), attempt.alias("attempt"))
    return let(x, lambda x: _draw(x["c"], x["k"], x["n"], x["stream"], x["domain"], x["attempt"]))


def _draw(c: Column, k: Column, n: Column, own: Column, of_domain: Column, attempt: Column) -> Column:
    stream = own
    chars = lambda s: F.split(s, "")

    def mapped(s: Column, fixed: int | Column = 0, stream: Column = own) -> Column:
        """Digits (after the first `fixed`) and letters replaced one by one, by their rank among letters and digits."""
        zero = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))

        def step(a, ch):
            b = _byte(stream, a["n"])
            new = (F.when(a["n"] < fixed, ch).when(ch.rlike("[0-9]"), F.pmod(b, F.lit(10)).cast("string"))
                   .when(ch.rlike("[a-z]"), F.chr(F.pmod(b, F.lit(26)).cast("long") + 97)).when(ch.rlike("[A-Z]"), F.chr(F.pmod(b, F.lit(26)).cast("long") + 65)).otherwise(ch))
            return F.struct((a["n"] + ch.rlike("[0-9A-Za-z]").cast("int")).alias("n"), F.concat(a["out"], new).alias("out"))

        return F.aggregate(chars(s), zero, step, lambda a: a["out"])

    # A domain has one surrogate wherever it stands; public ones and the last label stay.
    domain = lambda d: F.when(F.lower(d).isin(*PUBLIC_MAIL), d).otherwise(F.concat(mapped(F.lower(F.regexp_extract(d, r"^(.*)(\.[^.]*)$", 1)), 0, of_domain), F.regexp_extract(d, r"(\.[^.]*)$", 1)))
    email = F.concat(F.when(F.lower(c) == c, mapped(F.substring_index(c, "@", 1))).otherwise(mapped(F.lower(F.substring_index(c, "@", 1)))), F.lit("@"), let(F.substring_index(c, "@", -1), domain))
    # The country code of a phone number stays, however it is written; a card keeps its first digit and its check.
    country = F.char_length(F.regexp_extract(n, COUNTRY, 1))
    check = lambda head: F.pmod(F.lit(10) - _luhn(F.concat(F.regexp_replace(head, "[^0-9]", ""), F.lit("0"))), F.lit(10)).cast("string")
    valid = lambda drawn: F.when(_luhn(n) == 0, let(F.regexp_replace(drawn, "[0-9]$", ""), lambda head: F.concat(head, check(head)))).otherwise(drawn)
    card = let(mapped(c, F.lit(1)), valid)
    return (F.when(k == "email", email).when(k == "ip", address(c, stream, attempt)).when(k == "card", card)
            .when(k == "phone", mapped(c, country)).otherwise(mapped(c)))


def redraws(docs: DataFrame, key: str, text_col="text", rounds: int = 20) -> DataFrame:
    """kind, norm, attempt of what is drawn again (entities, families, given names), over all rows."""
    found = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(ALL), F.lit(0))).alias("e")).select(F.explode(drawn_parts(F.col("e"))).alias("x")).select("x.*")
    ents = cut(found.groupBy("kind", "norm").agg(F.min("scope").alias("scope"), F.min("e").alias("e")), "entities")
    now = ents.withColumn("attempt", F.lit(0))
    real = ents.where("kind != 'person'").select("kind", F.col("norm").alias("s"), F.lit(True).alias("real"))  # families keep surrogates apart from real persons
    e, k, n, a = map(F.col, ("e", "kind", "norm", "attempt"))
    draw = F.when(k == "family", F.lower(family_name(n, a, key))).when(k == "person", given_name(e, n, a, key)).otherwise(let(surrogate(e, k, n, a, key), normal))
    for _ in range(rounds):
        drawn = now.withColumn("s", draw)
        first = drawn.groupBy("kind", "scope", "s").agg(F.min(F.struct("attempt", "norm")).alias("first"), F.count("*").alias("n"))
        bad = drawn.join(first, ["kind", "scope", "s"]).join(real, ["kind", "s"], "left")
        again = F.col("real").isNotNull() | ((F.col("n") > 1) & (F.col("norm") != F.col("first.norm")))
        new = cut(bad.select("kind", "norm", "scope", "e", F.when(again, F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"), again.alias("again")), "drawn")
        if new.where("again").isEmpty():
            return new.where("attempt > 0").select("kind", "norm", "attempt")
        now = new.drop("again")
    raise RuntimeError("redraws: surrogates still collide; the corpus holds nearly all values of a format")


def scrub(docs: DataFrame, key: str, text_col="text") -> DataFrame:
    """docs with text_col scrubbed and one more column, n_entities.

    Null texts stay null with no entities. Rows without entities are unchanged. All other
    columns pass through. Equal rows get equal results, as does a text of any length. Columns
    named n_entities, new_, row_ or odd_ are refused. Whoever lacks the key can't draw the
    surrogates of guessed entities.
    """
    if not key:
        raise ValueError("a key is needed")
    if clash := {"n_entities", "new_", "row_", "odd_"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are needed here")
    odd = redraws(docs, key, text_col)
    t = F.col(text_col)
    few = odd.limit(REDRAWS + 1).collect()
    entities = F.regexp_extract_all(t, F.lit(ALL), F.lit(0))
    if len(few) > REDRAWS:
        row = docs.select("*", F.xxhash64(t).alias("row_"))
        hits = row.select("row_", F.explode(entities).alias("e")).select("row_", F.explode(drawn_parts(F.col("e"))).alias("x")).select("row_", "x.kind", "x.norm").distinct()
        per = hits.join(odd, ["kind", "norm"]).groupBy("row_").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "norm"), "attempt"))).alias("odd_"))
        src = row.join(per, "row_", "left").drop("row_")
        attempts = F.coalesce("odd_", F.create_map().cast("map<string,int>"))
    else:
        src = docs
        flat = [F.lit(x) for r in few for x in (f"{r['kind']}|{r['norm']}", r["attempt"])]
        attempts = F.create_map(*flat) if flat else None

    def attempt(k, n):
        return F.lit(0) if attempts is None else F.coalesce(F.try_element_at(attempts, F.concat_ws("|", k, n)), F.lit(0))

    def new(e: Column) -> Column:
        def drawn(x):
            name = person(x["e"], x["n"], attempt(x["k"], x["n"]), attempt(F.lit("family"), family(x["e"])), key)
            return F.when(x["k"] == "person", name).otherwise(surrogate(x["e"], x["k"], x["n"], attempt(x["k"], x["n"]), key))

        return let(F.struct(e.alias("e"), kind(e).alias("k"), normal(e).alias("n")), drawn)

    gaps = F.split(t, ALL, -1)
    zipped = F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col("new_"), i), F.lit(""))))
    got = src.withColumn("new_", F.when(t.rlike(ALL), F.transform(entities, new)))
    got = got.withColumn(text_col, F.when(F.col("new_").isNotNull(), F.array_join(zipped, "")).otherwise(t))
    got = got.withColumn("n_entities", F.coalesce(F.size("new_"), F.lit(0)).cast("long"))
    return got.select(*docs.columns, F.when(F.col("n_entities") > 0, F.col("n_entities")).otherwise(0).alias("n_entities"))


def session_key(spark) -> str:
    return spark.conf.get("tollgate.pii.key", KEY)


def op9_pii_surrogates(spark, sf_dir):
    """doc_id, text with surrogates, n_entities: one row per document."""
    return scrub(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))


QUERIES = {"op9_pii_surrogates": op9_pii_surrogates}
ORACLES: dict = {}
