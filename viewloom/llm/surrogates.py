"""Personal data and secrets replaced by keyed surrogates.

1. One pattern finds mentions. Kind, canonical value and gender name an entity, so that every mention of it, in any
   document, is the same one: e-mail addresses in lower case, cards and telephone numbers by their digits, IBANs without
   spaces. Within a document a title with one word of just one full name that suits is that person, and a full name
   that has a title somewhere is found without one too. A title that tells no gender takes that of the same name in the
   document, or else in all documents, if there is just one.
2. Each entity draws a surrogate from a keyed hash of kind, value, gender and attempt: of the same format (digits for digits,
   letters of the same script and case for letters, valid check digits, octets of the same length), and for names of the
   same gender and script.
3. Collision checks: surrogates that two entities drew, that an earlier entity holds, or that are some entity's own
   value are drawn again, until all are distinct. From the fourth attempt on a draw is longer by one character (or octets
   by digits, names by a syllable) for each attempt, so however many entities share a short format, there is room for all.
4. Mentions are exchanged where they stand, each in its own format (spaces, punctuation, case, one word of a name); what
   lies between them stays byte for byte.

Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewloom.llm.common import stored

#: Where an entity can begin: not inside a word. All kinds share it, so most characters are passed by at once.
_EDGE = r"(?<![\p{L}\p{N}])"
_END = r"(?![\p{L}\p{N}])"
#: Titles before a name, by gender.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "господин"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа", "госпожа"], "": ["Dr", "Prof"]}
#: What each kind looks like; a text's earliest match counts, and of those the first kind.
KINDS = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}+@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "secret": r"(?=[pPsStTaA])(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_/+-]{8,}+",
    "access key": r"A(?:KIA|SIA)[0-9A-Z]{16}" + _END,
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "phone": r"(?=[\d+(])(?:(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|\d{3}-\d{3}-\d{4}(?!\d))",
    "ssn": r"\d{3}-\d{2}-\d{4}(?!\d)",
    "card": r"\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)",
    "ip": r"(?=\d)(?<!\d\.)(?:\d{1,3}\.){3}\d{1,3}(?![\p{L}\p{N}])(?!\.\d)",
    "name": "(?=[" + "".join(sorted({t[0] for own in TITLES.values() for t in own})) + "])(?:" + "|".join(t for own in TITLES.values() for t in own) + r")\.?[ ]\p{Lu}\p{Ll}+(?:[ ]\p{Lu}\p{Ll}+)?" + _END,
}
ANY = _EDGE + "(?:" + "|".join(f"(?:{p})" for p in KINDS.values()) + ")"
_SYLLABLES = {"latin": "ba be bo da de do fa fe ga go ka ke la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi vo".split(), "cyrillic": "ба бе бо да де до ка ке ла ле ли ло ма ме ми мо на не ни но па ра ре ри ро са се та те ти то ва ве ви во".split()}
_ENDINGS = {"latin": {"m": "n", "f": "a", "": "s"}, "cyrillic": {"m": "н", "f": "я", "": "й"}}


def _kind(mention: Column) -> Column:
    found = F.lit("name")
    for kind, pattern in reversed(KINDS.items()):
        found = F.when(mention.rlike(rf"\A(?:{pattern})\z"), kind).otherwise(found)
    return found


def _before(mention: Column, kind: Column) -> Column:
    """What of a mention stays: the title of a name, the label of a secret."""
    title = F.regexp_extract(mention, r"\A(\S+ )", 1)
    label = F.regexp_extract(mention, r"\A([^=:]+[=:]\s*[\"']?)", 1)
    return F.when(kind == "name", title).when(kind == "secret", label).otherwise("")


def _bytes_of(hexed: Column, i: Column) -> Column:
    return F.conv(F.substring(hexed, F.pmod(i, F.lit(128)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, v: Column) -> Column:
    return F.substring(F.lit(letters), F.pmod(v, F.lit(len(letters))).cast("int") + 1, F.lit(1))


def _alike(value: Column, hexed: Column, keep: int | Column = 0) -> Column:
    """Other characters of the same class, but for the first ``keep``."""

    def other(c: Column, i: Column) -> Column:
        v = _bytes_of(hexed, i)
        return (
            F.when(i < keep, c)
            .when(c.rlike("[0-9]"), _pick("0123456789", v))
            .when(c.rlike(r"\p{IsCyrillic}"), F.when(c.rlike(r"\p{Lu}"), _pick("АБВГДЕЖЗИКЛМНОПРСТУФХ", v)).otherwise(_pick("абвгдежзиклмнопрстуфх", v)))
            .when(c.rlike(r"\p{Lu}"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", v))
            .when(c.rlike(r"\p{L}"), _pick("abcdefghijklmnopqrstuvwxyz", v))
            .otherwise(c)
        )

    return F.array_join(F.transform(_letters(value), other), "")


def _letters(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _card(drawn: Column) -> Column:
    """With a last digit that makes the Luhn sum right."""

    def fixed(text: Column) -> Column:
        digits = F.reverse(F.regexp_extract_all(text, F.lit("[0-9]"), F.lit(0)))

        def part(d: Column, i: Column) -> Column:
            n = d.cast("int")
            return F.when(i == 0, 0).when(i % 2 == 1, F.when(n > 4, 2 * n - 9).otherwise(2 * n)).otherwise(n)

        total = F.aggregate(F.transform(digits, part), F.lit(0), lambda a, x: a + x)
        return F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.pmod(-total, F.lit(10)).cast("string"))

    return _let(drawn, fixed)


def _iban(drawn: Column) -> Column:
    """With check digits that are right modulo 97; country and spaces stay."""

    def fixed(text: Column) -> Column:
        moved = _letters(F.concat(F.substring(F.regexp_replace(text, " ", ""), 5, 60), F.substring(text, 1, 2), F.lit("00")))
        rest = F.aggregate(moved, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), F.pmod(a * 10 + F.try_to_number(c, F.lit("9")).cast("int"), F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97))).cast("int"))
        return F.concat(F.substring(text, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), F.substring(text, 5, 60))

    return _let(drawn, fixed)


def _ip(value: Column, hexed: Column, attempt: Column) -> Column:
    """Octets of as many digits, of any length after three attempts."""

    def octet(o: Column, i: Column) -> Column:
        v = _bytes_of(hexed, i)
        free = F.lit(1) + F.pmod(v, F.lit(254))
        return F.when(attempt >= 3, free).when(F.length(o) == 1, F.lit(1) + F.pmod(v, F.lit(9))).when(F.length(o) == 2, F.lit(10) + F.pmod(v, F.lit(90))).otherwise(F.lit(100) + F.pmod(v, F.lit(155))).cast("string")

    return F.array_join(F.transform(F.split(value, r"\."), octet), ".")


def _name(value: Column, gender: Column, hexed: Column, more: Column) -> Column:
    """As many words, of syllables of the same script, ``more`` of them than usual; a given name ends as its gender's names do."""
    words = F.split(value, " ")

    def of(script: str) -> Column:
        sounds = F.array(*map(F.lit, _SYLLABLES[script]))
        end = F.when(gender == "m", _ENDINGS[script]["m"]).when(gender == "f", _ENDINGS[script]["f"]).otherwise(_ENDINGS[script][""])

        def word(_: Column, w: Column) -> Column:
            body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3) + more), lambda k: F.get(sounds, F.pmod(_bytes_of(hexed, w * 32 + k), F.lit(len(_SYLLABLES[script]))))), "")
            given = (w == 0) & (F.size(words) > 1)
            return F.initcap(F.concat(body, F.when(given | (F.size(words) == 1), end).otherwise("")))

        return F.array_join(F.transform(words, word), " ")

    return F.when(value.rlike(r"\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin"))


def _canonical(kind: Column, value: Column) -> Column:
    """What all mentions of an entity share."""
    return (
        F.when(kind == "email", F.lower(value)).when(kind == "phone", F.regexp_replace(value, "[^+0-9]", ""))
        .when(kind.isin("card", "ssn"), F.regexp_replace(value, "[^0-9]", "")).when(kind == "iban", F.regexp_replace(value, " ", "")).otherwise(value)
    )


def _rendered(kind: Column, value: Column, entity: Column, surrogate: Column) -> Column:
    """An entity's surrogate in the format of the mention ``value``."""
    drawn_ = _letters(F.when(kind == "email", surrogate).otherwise(F.regexp_replace(surrogate, r"\+", "")))

    def cased(new: Column, i: Column) -> Column:
        return F.when(F.coalesce(F.get(_letters(value), i).rlike(r"\p{Lu}"), F.lit(False)), F.upper(new)).otherwise(new)

    def step(a: Column, c: Column) -> Column:
        takes = c.rlike("[0-9A-Z]")
        return F.struct(F.concat(a["s"], F.when(takes, F.coalesce(F.get(drawn_, a["k"]), F.lit(""))).otherwise(c)).alias("s"), (a["k"] + takes.cast("int")).alias("k"))

    spread = F.aggregate(_letters(value), F.struct(F.lit("").alias("s"), F.lit(0).alias("k")), step, lambda a: F.concat(a["s"], F.array_join(F.slice(drawn_, a["k"] + 1, 100), "")))
    return F.when(value == entity, surrogate).when(kind == "email", F.array_join(F.transform(drawn_, cased), "")).when(kind.isin("phone", "card", "ssn", "iban"), spread).otherwise(surrogate)


def _persons(names: DataFrame) -> DataFrame:
    """Mentions of names with the ``entity`` and ``gender`` of the person and the word ``part`` of the name that they hold, 0 for all."""
    own = Window.partitionBy("__id", "__version")
    told = F.collect_set(F.nullif("gender", F.lit("")))
    names = names.join(names.groupBy("value").agg(told.alias("anywhere")), "value").withColumn("here", told.over(Window.partitionBy("__id", "__version", "value")))
    one = lambda xs: F.when(F.size(xs) == 1, F.get(xs, F.lit(0)))
    known = F.when(F.col("gender") != "", F.col("gender")).otherwise(F.coalesce(one(F.col("here")), F.when(F.size("here") == 0, one(F.col("anywhere"))), F.lit("")))
    names = names.withColumn("known", known)
    full = F.col("value").contains(" ")
    names = names.withColumn("fulls", F.collect_set(F.when(full, F.struct("value", F.col("known").alias("gender")))).over(own))

    def suits(word: int) -> Column:
        def test(x: Column) -> Column:
            return (F.get(F.split(x["value"], " "), F.lit(word - 1)) == F.col("value")) & ((F.col("gender") == "") | (x["gender"] == "") | (x["gender"] == F.col("gender")))

        return F.filter("fulls", test)

    names = names.withColumns({"by2": suits(2), "by1": suits(1)})
    part = F.when(full, 0).when(F.size("by2") == 1, 2).when((F.size("by2") == 0) & (F.size("by1") == 1), 1).otherwise(0)
    names = names.withColumn("part", part)
    of = F.when(F.col("part") == 2, F.get("by2", F.lit(0))).when(F.col("part") == 1, F.get("by1", F.lit(0)))
    return names.select("__id", "__version", "__i", "kind", "before", "value", F.coalesce(of["value"], "value").alias("entity"), F.coalesce(of["gender"], "known").alias("gender"), F.lit(0).alias("keep"), "part")


def drawn(entities: DataFrame, key: str) -> DataFrame:
    """``entities`` (kind, value, gender, keep, attempt) with a surrogate each; ``keep`` characters of a telephone number stay."""
    seed = F.concat_ws("\0", F.lit(key), "kind", "value", "gender", F.col("attempt").cast("string"))
    hexed = F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("\0more")), 512))
    rows = entities.withColumn("hexed", hexed)
    v, h, kind = F.col("value"), F.col("hexed"), F.col("kind")
    more = F.greatest(F.col("attempt") - 3, F.lit(0))  # what a draw is longer by

    def longer(letters: str) -> Column:
        return F.when(more > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda k: _pick(letters, _bytes_of(h, F.lit(96) + k))), "")).otherwise("")

    hexlike = F.array_join(F.transform(_letters(v), lambda c, i: _pick("0123456789abcdef", _bytes_of(h, i))), "")
    domain = F.regexp_extract(v, r"(\.[^.@]+)\z", 1)
    local = F.regexp_extract(v, r"\A([^@]*)", 1)
    host = F.substring(v, F.length(local) + 1, F.length(v) - F.length(local) - F.length(domain))
    email = F.concat(_alike(local, h), longer("abcdefghijklmnopqrstuvwxyz"), _let(_alike(F.concat(local, host), h), lambda x: F.substring(x, F.length(local) + 1, F.length(x))), domain)
    digits = longer("0123456789")
    found = (
        F.when(kind == "email", email).when(kind == "secret", F.concat(F.when(v.rlike(r"\A[0-9a-f]+\z"), hexlike).otherwise(_alike(v, h)), digits))
        .when(kind == "access key", F.concat(_alike(v, h, keep=4), digits)).when(kind == "iban", _iban(F.concat(_alike(v, h, keep=2), digits)))
        .when(kind == "phone", F.concat(_alike(v, h, keep=F.col("keep")), digits)).when(kind == "ssn", F.concat((F.lit(1) + F.pmod(_bytes_of(h, F.lit(127)), F.lit(5))).cast("string"), F.substring(_alike(v, h), 2, 20), digits))
        .when(kind == "card", _card(F.concat(_alike(v, h, keep=1), digits))).when(kind == "ip", _ip(v, h, F.col("attempt"))).otherwise(_name(v, F.col("gender"), h, more))
    )
    return rows.withColumn("surrogate", found).drop("hexed")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, gender, surrogate) for distinct (kind, value, gender): distinct surrogates, none of them a value in use.

    Rounds go on until none is left. Since draws grow, each round from the fourth on has ten times the room of the one
    before or more, so their number follows the logarithm of the entities of a format.
    """
    todo = stored(entities.withColumn("attempt", F.lit(0)), "entities")
    values = todo.select(F.col("kind"), F.col("value").alias("surrogate"))
    done = None
    while True:
        tried = drawn(todo, key)
        taken = values if done is None else values.unionByName(done.select("kind", "surrogate"))
        # of those that drew the same, the one of the least value and gender holds it, unless it is taken
        holders = tried.groupBy("kind", "surrogate").agg(F.min(F.struct("value", "gender")).alias("of")).join(taken, ["kind", "surrogate"], "left_anti").select("kind", "surrogate", "of.*")
        held = stored(tried.join(holders.withColumn("holds", F.lit(True)), ["kind", "surrogate", "value", "gender"], "left"), "surrogates")
        won = held.where("holds").select("kind", "value", "gender", "surrogate")
        lost = held.where("holds is null").select("kind", "value", "gender", "keep", (F.col("attempt") + 1).alias("attempt"))
        done = won if done is None else done.unionByName(won)
        if lost.isEmpty():
            return done
        todo = lost


def pseudonymised(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key: str) -> DataFrame:
    """``docs`` with surrogates in ``text_col``, and n_entities (mentions exchanged) added.

    A null or empty text has no mention and stays. Rows with null or repeated ids are treated like any other; mentions of
    an entity get one surrogate in all of them, each in its own format. A full name without a title is exchanged where
    the same text has it with a title; of several genders the least counts. Titles of names and labels of secrets stay.
    Whoever has ``key`` can tell which surrogate a guessed value gets, so it is to be kept secret; the same key gives the
    same surrogates to the same entities of a table. Texts of any length are read whole. Extra columns pass through,
    whatever their names; one named n_entities is replaced. An empty table gives an empty result.
    """
    rows = docs.select(F.struct("*").alias("row"), docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))  # so that no name can clash
    text = F.col("text")
    has = F.coalesce(text.rlike(ANY), F.lit(False))
    marked = rows.where(has).withColumns({"__id": F.col("doc_id"), "__version": F.xxhash64(text)})
    found = marked.select("__id", "__version", F.posexplode(F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).alias("__i", "mention"))
    found = found.withColumn("kind", _kind(F.col("mention"))).withColumn("before", _before(F.col("mention"), F.col("kind")))
    value = F.substring(F.col("mention"), F.length("before") + 1, F.length("mention"))
    title = F.regexp_extract("mention", r"\A([^ .]+)", 1)
    gender = F.when((F.col("kind") == "name") & title.isin(TITLES["m"]), "m").when((F.col("kind") == "name") & title.isin(TITLES["f"]), "f").otherwise("")
    found = stored(found.select("__id", "__version", "__i", "kind", "before", value.alias("value"), gender.alias("gender")), "mentions")
    code = F.length(F.regexp_extract("value", r"\A(\+\d{1,3}(?=[ .(-]))?", 0))  # of the country
    plain = found.where("kind <> 'name'").select("__id", "__version", "__i", "kind", "before", "value", _canonical(F.col("kind"), F.col("value")).alias("entity"), "gender", F.when(F.col("kind") == "phone", code).otherwise(0).alias("keep"), F.lit(0).alias("part"))
    found = stored(plain.unionByName(_persons(found.where("kind = 'name'"))), "persons")
    entities = found.groupBy("kind", F.col("entity").alias("value"), "gender").agg(F.max("keep").alias("keep"))
    named = found.join(surrogates(entities, key).withColumnRenamed("value", "entity"), ["kind", "entity", "gender"])
    shown = F.when(F.col("part") > 0, F.get(F.split("surrogate", " "), F.col("part") - 1)).otherwise(_rendered(F.col("kind"), F.col("value"), F.col("entity"), F.col("surrogate")))
    person = F.when((F.col("kind") == "name") & F.col("entity").contains(" "), F.struct(F.col("entity").alias("name"), F.col("gender"), F.col("surrogate").alias("new")))
    lists = named.groupBy("__id", "__version").agg(F.array_sort(F.collect_set(F.struct("__i", F.concat("before", shown).alias("new")))).alias("__new"), F.array_sort(F.collect_set(person)).alias("__persons"))
    lists = lists.withColumnsRenamed({"__id": "__of", "__version": "__ofversion"})
    between = F.split(text, ANY, -1)

    def bare(x: Column) -> Column:
        return F.concat(F.lit(_EDGE), x["name"], F.lit(_END))

    def renamed(part: Column) -> Column:
        """With full names that have a title elsewhere in the text exchanged."""
        return F.aggregate("__persons", part, lambda a, x: F.regexp_replace(a, bare(x), x["new"]))

    several = F.size("__persons") > 0
    rebuilt = F.array_join(F.transform(between, lambda part, i: F.concat(F.when(several, renamed(part)).otherwise(part), F.coalesce(F.get("__new", i)["new"], F.lit("")))), "")
    names = F.array_distinct(F.transform("__persons", lambda x: F.struct(x["name"].alias("name"))))
    untitled = F.aggregate(between, F.lit(0), lambda a, part: a + F.aggregate(names, F.lit(0), lambda b, x: b + F.regexp_count(part, bare(x))))
    changed = marked.join(lists, marked["__id"].eqNullSafe(F.col("__of")) & (F.col("__version") == F.col("__ofversion")))
    n_entities = F.size("__new") + F.when(several, untitled).otherwise(0)
    changed = changed.select("row", rebuilt.alias("text"), n_entities.cast("long").alias("n_entities"))
    whole = changed.unionByName(rows.where(~has).select("row", "text", F.lit(0).cast("long").alias("n_entities")))
    same = [(text if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns if c != "n_entities"]
    return whole.select(*same, "n_entities")
