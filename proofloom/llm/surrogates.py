"""Surrogates for personal data, by DataFrame functions only.

Units are e-mail addresses, IPv4 addresses, card-like and phone-like numbers,
long hexadecimal secrets and the words of names. A document's names are those
that stand after a title in it; their words are then replaced wherever the
document has them, with or without the title. Each distinct unit of the table
gets one replacement derived from a secret key, whatever its spelling (case of
an address or name, separators of a number) and wherever it stands, so that
coreference holds within and across documents.

Numbers and IPv4 addresses go through a keyed Feistel permutation of all bodies
of their length: country code, first digit of a card, first octet and a card's
check digit stay valid, and distinct numbers stay distinct by construction. A
name word keeps its script and letter case, and ends by the gender of all the
titles that it stands after in the table: a given name (first of two words) in
a, o or, where titles differ or tell none, e; another in a or n.

All replacements are then checked against each other and against the units of
the table. Those that clash are derived again with the next attempt number, and
each attempt has a wider space (more letters, more digits), so that the
attempts come to an end. Only IPv4 has no wider form: after IP_ATTEMPTS an
address takes its first replacement, which no other has, though the table may.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, saved

#: Titles by the gender they tell.
FEMALE, MALE, ANY = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"), ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"), ("Dr", "Prof")
_TITLE = "(?:" + "|".join((*FEMALE, *MALE, *ANY)) + r")\.?"
_NAME = r"\p{Lu}[\p{L}'’-]+"
#: A title and one or two names.
TITLED = rf"(?<!\p{{L}})({_TITLE}) ({_NAME})(?: ({_NAME}))?"
#: type -> pattern, in the order in which they are tried at a place. Possessive runs keep long texts linear.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "secret": r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,}+(?![0-9A-Za-z])",
    "ip": r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9+])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5}|\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])",
}
NUMBERED = "|".join(f"(?:{p})" for p in PATTERNS.values())
ANY_ENTITY = f"{NUMBERED}|{TITLED}"
#: What every entity has, so that most texts are passed over quickly.
HINT = rf"@|[0-9][ .()-]{{0,3}}[0-9]|[0-9a-fA-F]{{32}}|(?:{_TITLE}) \p{{Lu}}"
#: The country codes of one and two digits; all others have three.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
ROUNDS, IP_ATTEMPTS = 4, 6
#: Attempts before numbers get longer.
SAME_LENGTH = 3


def _type(unit: Column) -> Column:
    digits = F.length(F.regexp_replace(unit, r"[^0-9]", ""))
    out = F.when(unit.contains("@"), "email").when(unit.rlike(r"^\p{L}+$") & (~unit.rlike("^[0-9a-fA-F]{32,}$")), "word")
    out = out.when(unit.rlike(f"^{PATTERNS['ip']}$"), "ip").when(unit.rlike("^[0-9a-fA-F]{32,}$") & unit.rlike("[a-fA-F]"), "secret")
    return out.when(unit.rlike(r"^[0-9]") & (digits >= 13) & unit.rlike(r"^[0-9](?:[ -]?[0-9]){12,18}$"), "card").otherwise("phone")


def _canonical(kind: Column, unit: Column) -> Column:
    """What all spellings of a unit share."""
    octets = F.array_join(F.transform(F.split(unit, r"\."), lambda x: x.cast("int").cast("string")), ".")
    return F.when(kind.isin("email", "secret", "word"), F.lower(unit)).when(kind.isin("card", "phone"), F.regexp_replace(unit, r"(?<=.)\+|[^0-9+]", "")).otherwise(octets)


def _digest(key: str, *values: Column) -> Column:
    """64 hexadecimal digits that can't be foretold without the key."""
    return F.sha2(F.concat_ws("\u0001", F.lit(key), *[F.coalesce(v.cast("string"), F.lit("")) for v in values], F.lit(key)), 256)


def luhn_sum(digits: Column) -> Column:
    """The weighted digit sum whose last digit is 0 for a valid card number."""
    n = F.length(digits)
    values = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(digits, i, F.lit(1)).cast("int") * F.when(F.pmod(n - i, F.lit(2)) == 1, 2).otherwise(1))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v))


def _syllables(digest: Column, n: int, consonants: str, vowels: str) -> Column:
    """n syllables of 8 bits each."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.translate(F.substr(digest, 2 * i + 1, F.lit(1)), "0123456789abcdef", consonants), F.translate(F.substr(digest, 2 * i + 2, F.lit(1)), "0123456789abcdef", vowels)))
    return F.array_join(pairs, "")


def derived(units: DataFrame, key: str, attempt: int) -> DataFrame:
    """``units`` (kind, canonical, ending) with ``replacement``, in canonical form, at an attempt.

    Every step is a column of its own, so that the plan, and the code made of
    it, stay small. ending is the last letter of a name word: a, o, e or n.
    """
    kind, canonical, wider = F.col("kind"), F.col("canonical"), max(0, attempt - SAME_LENGTH + 1)
    number, ip = kind.isin("card", "phone"), kind == "ip"
    out = units.withColumn("s", _digest(key, kind, canonical, F.lit(attempt)))
    # numbers: what is kept, and the two halves of the rest
    out = out.withColumn("luhn", F.when(kind == "card", F.pmod(luhn_sum(canonical), F.lit(10)) == 0).otherwise(False))
    code = F.regexp_extract(canonical, COUNTRY, 0)
    head = F.when(canonical.startswith("+"), F.substr(code, F.lit(1), F.least(F.length(code), F.length(canonical) - 2))).otherwise(F.substring(canonical, 1, 1))
    out = out.withColumn("head", F.when(number, head).when(ip, F.substring_index(canonical, ".", 1)))
    body = F.substr(canonical, F.length("head") + 1, F.length(canonical) - F.length("head") - F.col("luhn").cast("int"))
    out = out.withColumn("body", F.when(number, F.concat(body, F.lit("0" * wider))))
    out = out.withColumn("left_digits", F.ceil(F.length("body") / 2).cast("int")).withColumn("right_digits", F.length("body") - F.col("left_digits"))
    octet = lambda i: F.split(canonical, r"\.")[i].cast("long")
    out = out.withColumn("x", F.when(ip, octet(1) * 16 + F.floor(octet(2) / 16)).otherwise(F.substr("body", F.lit(1), F.col("left_digits")).cast("long")))
    out = out.withColumn("y", F.when(ip, F.pmod(octet(2), F.lit(16)) * 256 + octet(3)).otherwise(F.coalesce(F.substr("body", F.col("left_digits") + 1).try_cast("long"), F.lit(0))))
    out = out.withColumn("mx", F.when(ip, F.lit(4096)).otherwise(F.pow(F.lit(10.0), "left_digits").cast("long"))).withColumn("my", F.when(ip, F.lit(4096)).otherwise(F.pow(F.lit(10.0), "right_digits").cast("long")))
    for k in range(ROUNDS):
        for name, other, size in (("x", "y", "mx"), ("y", "x", "my")):
            drawn = F.conv(F.substring(_digest(key, kind, F.col("head"), F.col("luhn"), F.length("body"), F.lit(attempt), F.lit(f"{k}{name}"), F.col(other)), 1, 15), 16, 10).cast("long")
            out = out.withColumn(name, F.when(F.col(size).isNotNull(), F.pmod(F.col(name) + F.pmod(drawn, F.col(size)), F.col(size))))
    right = F.when(F.col("right_digits") > 0, F.lpad(F.col("y").cast("string"), F.col("right_digits"), F.lit("0"))).otherwise("")
    out = out.withColumn("digits", F.when(number, F.concat("head", F.lpad(F.col("x").cast("string"), F.col("left_digits"), F.lit("0")), right)))
    check = F.pmod(10 - F.pmod(luhn_sum(F.concat("digits", F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    made_number = F.when(F.col("luhn"), F.concat("digits", check)).otherwise(F.col("digits"))
    made_ip = F.concat_ws(".", "head", F.floor(F.col("x") / 16), F.pmod("x", F.lit(16)) * 16 + F.floor(F.col("y") / 256), F.pmod("y", F.lit(256)))
    # letters
    domain = _syllables(_digest(key, F.lit("domain"), F.substring_index(canonical, "@", -1)), 4, "bcdfghjklmnpqrst", "aeiouaeiouaeioua")
    email = F.concat(_syllables(F.col("s"), 4 + attempt, "bcdfghjklmnpqrst", "aeiouaeiouaeioua"), F.lit("."), F.conv(F.substring("s", 49, 4), 16, 10), F.lit("@"), domain, F.lit(".example"))
    secret = F.substr(F.repeat("s", F.ceil((F.length(canonical) + wider) / 64).cast("int")), F.lit(1), F.length(canonical) + wider)
    syllables = lambda c, v: _syllables(F.col("s"), 3 + attempt, c, v)
    word = (
        F.when(canonical.rlike(r"\p{IsCyrillic}"), F.concat(syllables("бдфгклмнпрствзхж", "аеиоуаеиоуаеиоуа"), F.translate("ending", "anoe", "аное")))
        .when(canonical.rlike(r"\p{IsGreek}"), F.concat(syllables("βδφγκλμνπρστθζχξ", "αειουαειουαειουα"), F.translate("ending", "anoe", "ανοε")))
        .otherwise(F.concat(syllables("bdfgklmnprstvzhj", "aeiouaeiouaeioua"), F.col("ending")))
    )
    made = F.when(number, made_number).when(ip, made_ip).when(kind == "email", email).when(kind == "secret", secret).otherwise(word)
    return out.withColumn("replacement", made).select(*units.columns, "replacement")


def mapping(units: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, replacement) of the distinct (kind, canonical) of ``units`` (kind, canonical, ending).

    Distinct units of a kind get distinct replacements, none of which is a unit
    of the table (but see the module on IPv4). A written table.
    """
    own = saved(units.dropDuplicates(["kind", "canonical"]), "units")
    done, taken, todo, attempt = [], own.select("kind", F.col("canonical").alias("replacement")), own, 0
    while True:
        # dealt out evenly: deriving costs far more than the few bytes of a unit tell
        made = saved(derived(todo.repartition(parts(units), "kind", "canonical"), key, min(attempt, 20)), "derived")
        first = F.row_number().over(Window.partitionBy("kind", "replacement").orderBy("canonical")) == 1
        clash = taken.distinct().withColumn("clash", F.lit(True))
        judged = saved(made.withColumn("first", first).join(clash, ["kind", "replacement"], "left").withColumn("good", F.col("first") & F.col("clash").isNull()), "surrogates")
        done.append(judged.filter("good").select("kind", "canonical", "replacement"))
        todo = judged.filter("not good").select(*units.columns)
        if attempt == 0:
            zero = made.filter("kind = 'ip'").select("kind", "canonical", "replacement")
            taken = taken.union(zero.select("kind", "replacement"))  # kept for those that take them at last
        if attempt == IP_ATTEMPTS:
            done.append(zero.join(todo, ["kind", "canonical"], "left_semi"))
            todo = todo.filter("kind <> 'ip'")
        if todo.isEmpty():
            return reduce(DataFrame.union, done)
        taken = taken.union(done[-1 if attempt != IP_ATTEMPTS else -2].select("kind", "replacement"))
        attempt += 1


def _shaped(kind: Column, unit: Column, replacement: Column) -> Column:
    """The replacement written as the unit is: its separators, or its letter case. Digits beyond the unit's follow at its end."""
    digits = F.regexp_replace(replacement, r"[^0-9]", "")
    digit = lambda i: F.length(F.regexp_replace(F.substr(unit, F.lit(1), i + 1), r"[^0-9]", ""))
    laid = F.array_join(F.transform(F.split(unit, ""), lambda c, i: F.when(c.rlike("^[0-9]$"), F.substr(digits, digit(i), F.lit(1))).otherwise(c)), "")
    laid = F.concat(laid, F.substr(digits, F.length(F.regexp_replace(unit, r"[^0-9]", "")) + 1))
    upper = F.when((unit == F.upper(unit)) & (unit != F.lower(unit)), F.upper(replacement))
    lower = F.when(kind == "word", F.initcap(replacement)).otherwise(replacement)
    return F.when(kind.isin("card", "phone"), laid).otherwise(F.coalesce(upper, lower))


def _roles(found: DataFrame) -> DataFrame:
    """(canonical, ending) of each name word: by the titles of the names that it stands in.

    A word that is the first of two anywhere is a given name and goes by the
    names that it is the first of; others, surnames and lone names, go by all
    their names. A surname of both genders ends as one of no gender does.
    """
    titled = found.select(F.explode("titled").alias("n")).select(*[F.regexp_extract("n", TITLED, k).alias(c) for k, c in enumerate(("title", "one", "two"), 1)])
    title = F.regexp_replace("title", r"\.$", "")
    split = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}{2,}"), F.lit(0))
    given = F.transform(split("one"), lambda w: F.struct(w.alias("canonical"), (F.col("two") != "").alias("given")))
    last = F.transform(split("two"), lambda w: F.struct(w.alias("canonical"), F.lit(False).alias("given")))
    each = titled.select(F.explode(F.concat(given, last)).alias("w"), title.isin(*FEMALE).alias("f"), title.isin(*MALE).alias("m")).select("w.*", "f", "m")
    told = each.groupBy("canonical").agg(F.max("given").alias("given"), *[F.max(F.when(F.col("given") | (k == "all"), F.col(c))).alias(f"{k}_{c}") for k in ("first", "all") for c in "fm"])
    first = F.when(F.col("first_f") & ~F.col("first_m"), "a").when(F.col("first_m") & ~F.col("first_f"), "o").otherwise("e")
    other = F.when(F.col("all_f") & ~F.col("all_m"), "a").otherwise("n")
    return told.select("canonical", F.when(F.col("given"), first).otherwise(other).alias("ending"))


#: Leading letters by which the words of a text's names are told apart step by step.
TREE_DEPTH = 3


def word_tree(words: str) -> Column:
    """A pattern of the words in an array column, sorted and not empty: a tree over their first letters, so that a place in a text tries few words, not all."""
    ws, empty = F.col(words), F.lit("")

    def piece(w: Column, i: Column) -> Column:
        before = F.when(i > 0, F.element_at(ws, F.greatest(i, F.lit(1)))).otherwise(empty)
        letters = [F.substring(w, k, 1) for k in range(1, TREE_DEPTH + 1)]
        rest = F.substr(w, F.lit(TREE_DEPTH + 1))
        out = F.concat(F.lit("|"), rest)
        for k in reversed(range(TREE_DEPTH)):  # the first letter that differs from the word before
            opened = F.concat(*[x for c in letters[k:] for x in (c, F.lit("(?:"))], rest)
            out = F.when(F.substring(w, 1, k + 1) != F.substring(before, 1, k + 1), F.concat(F.when(i > 0, F.lit(")" * (TREE_DEPTH - k) + "|")).otherwise(empty), opened)).otherwise(out)
        return out

    return F.concat(F.array_join(F.transform(ws, piece), ""), F.lit(")" * TREE_DEPTH))


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, or the first of wanted_2, wanted_3 ... that no column has in any letter case."""
    have = {c.lower() for c in columns}
    return next(n for k in range(1, len(have) + 2) if (n := wanted if k == 1 else f"{wanted}_{k}").lower() not in have)


def replaced(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``text`` rewritten, and ``n_entities``, the units replaced in it (a name's words count each).

    Null text stays null with 0 entities; a text without entities stays as it
    is, byte for byte, however long. Repeated rows stay and are rewritten alike.
    Other columns may have any name: where one is called n_entities, the count
    is n_entities_2. Empty input: no rows.
    """
    names, count = docs.columns, free_name(docs.columns, "n_entities")
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != text]
    own = docs.select(F.struct(F.lit(0).alias("none"), *rest).alias("row"), F.col(f"`{text}`").alias("t"))
    hinted = F.coalesce(F.col("t").rlike(HINT) & F.col("t").rlike(ANY_ENTITY), F.lit(False))
    found = own.filter(hinted).withColumn("titled", F.regexp_extract_all("t", F.lit(TITLED), F.lit(0)))
    # the words of a document's names, in the spellings that other mentions may have
    words = F.flatten(F.transform("titled", lambda n: F.regexp_extract_all(F.regexp_replace(n, f"^{_TITLE} ", ""), F.lit(r"\p{L}{2,}"), F.lit(0))))
    words = F.array_sort(F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(w, F.upper(w), F.initcap(w))))))
    found = found.withColumn("words", words)
    pattern = F.when(F.size("words") == 0, F.lit(NUMBERED)).otherwise(F.concat(F.lit(NUMBERED + r"|(?<!\p{L})(?:"), word_tree("words"), F.lit(r")(?!\p{L})")))
    found = saved(found.withColumn("id", F.sha2("t", 256)).withColumn("pattern", pattern).drop("words"), "found")
    # equal texts are rewritten alike, so one of them is worked out
    once = found.select("id", F.regexp_extract_all("t", F.col("pattern"), F.lit(0)).alias("units"), "titled").groupBy("id").agg(F.first(F.struct("units", "titled")).alias("x"))
    once = saved(once.select("id", "x.*"), "once")
    typed = once.select("id", F.posexplode("units").alias("pos", "unit")).withColumn("kind", _type(F.col("unit")))
    places = saved(typed.withColumn("canonical", _canonical(F.col("kind"), F.col("unit"))), "places")
    units = places.select("kind", "canonical").distinct().join(_roles(once).withColumn("kind", F.lit("word")), ["kind", "canonical"], "left").withColumn("ending", F.coalesce("ending", F.lit("n")))
    told = places.join(mapping(units, key), ["kind", "canonical"]).select("id", F.struct("pos", _shaped(F.col("kind"), F.col("unit"), F.col("replacement")).alias("r")).alias("x"))
    # written, so that the join below can split the partition of a much copied text
    lists = saved(told.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]).alias("made")), "made")
    gaps = F.split("t", F.col("pattern"), -1)
    new = F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size("made")), F.col("made"), lambda g, m: F.concat(g, m)), ""), F.element_at(gaps, -1))
    changed = found.join(lists, "id").select("row", new.alias("t"), F.size("made").alias("n"))
    out = own.filter(~hinted).select("row", "t", F.lit(0).alias("n")).union(changed)
    return out.select(*[(F.col("t") if c == text else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(names)], F.col("n").alias(count))
