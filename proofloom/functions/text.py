"""Column functions over text: terms, figures, intents and guards. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on exactly these words and patterns.
STOP = (
    "the", "a", "an", "of", "to", "in", "for", "and", "or", "is", "was", "were",
    "are", "what", "which", "how", "much", "many", "did", "do", "does", "tell",
    "me", "about", "could", "you", "please", "on", "at", "by", "with", "this",
    "that", "it", "its", "their", "from", "be", "as", "we", "i",
)
TERM = r"([a-z0-9$%.]+)"
VALUE = r"[0-9][0-9.,]{2,}"
PERIOD = r"\b(?:FY[0-9]{2,4}|Q[1-4]|H[12])\b"
FIGURE = r"[0-9][0-9,]*(?:\.[0-9]+)?"
COMPARED_FIGURE = r"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?"
INTENTS = {
    "comparison": r"\b(vs|versus|compare|comparison|difference|between|year-?over-?year|yoy|prior year)\b",
    "diagnostic": r"\b(why|cause|reason|fault|error|fail|decline|drop|fell|impact|risk)\b",
    "procedure": r"\b(how to|how do|steps?|procedure|process|calculate|compute)\b",
    "lookup": r"\b(capacity|spec|specification|value|amount|rate|ratio|margin|revenue|profit|eps|figure|total|how much|how many)\b",
}
#: (dense, sparse) weights of rank fusion for each intent.
FUSION = {"lookup": (0.4, 0.6), "procedure": (0.5, 0.5), "diagnostic": (0.7, 0.3), "comparison": (0.6, 0.4), "general": (0.5, 0.5)}
MATH = (
    r"\b(grew|grow(th)?|increased?|decreased?|declined?|changed?|difference|delta|yoy|year[- ]over[- ]year|cagr|average|mean|"
    r"how much (more|less|higher|lower)|compared? (to|with)|versus|vs\.?|as a (percentage|percent|share|proportion) of|"
    r"what (percentage|percent|share|proportion) of|ratio of)\b"
)
BRIEF = r"\b(brief|analy[sz]e|summar|overview|first[ -]?read|key (metrics|figures|numbers)|break ?down|tl;?dr|walk me through|what are the highlights)\b"
INJECTIONS = (
    r"ignore\s+(all\s+|the\s+|any\s+)?(previous|above|prior|earlier)\s+(instruction|prompt|context)",
    r"disregard\s+(the\s+|all\s+)?(previous|above|prior)?\s*instruction",
    r"forget\s+(everything|all|the|previous)",
    r"system\s+prompt",
    r"you\s+are\s+now\b",
    r"new\s+instructions?\s*:",
    r"reveal\s+(your\s+)?(system\s+)?prompt",
    r"act\s+as\s+(a|an|the)\b",
)
UNITS = (
    ("per_share", r"per\s+(?:diluted\s+|basic\s+)?share"),
    ("percent", r"%|percent|percentage|basis point|bps"),
    ("billion", r"\bbillion\b|\bbn\b"),
    ("million", r"\bmillion\b|\bm\b"),
    ("thousand", r"\bthousand\b|\bk\b"),
)
MAX_QUESTION = 600


def strip(c: Column | str) -> Column:
    """Without white space at either end; null stays null."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^[\s\x0B\x1C-\x1F]+|[\s\x0B\x1C-\x1F]+$", "")


def once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it (also within lambdas, which work out what they name for each element)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def terms(c: Column | str) -> Column:
    """Lower-case runs of letters, digits, ``$``, ``%`` and ``.``, repeats included."""
    return F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(1))


def keywords(c: Column | str, longer_than: int = 0) -> Column:
    """Terms that are no stop word, repeats included."""
    stop = F.array(*[F.lit(w) for w in STOP])
    return F.filter(terms(c), lambda t: ~F.array_contains(stop, t) & (F.length(t) > longer_than))


def term_id(c: Column | str) -> Column:
    return F.crc32(F.encode(c, "UTF-8")).bitwiseAND(F.lit(0x7FFFFFFF))


def without_commas(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(""))


def figures(c: Column | str) -> Column:
    """Numbers of a text without their commas, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(FIGURE), F.lit(0)), without_commas)


def is_year(c: Column) -> Column:
    return c.rlike("^(19|20)[0-9]{2}$")


def has_figure(text: Column, figure: Column) -> Column:
    """Whether a number stands in a text by itself, as no part of another."""
    return F.regexp_like(text, F.concat(F.lit(r"(?<![0-9.])\Q"), figure, F.lit(r"\E(?![0-9.]?[0-9])")))


def intent(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit("general")
    for name in ("lookup", "procedure", "diagnostic", "comparison"):
        out = F.when(c.rlike(f"(?i){INTENTS[name]}"), name).otherwise(out)
    return out


def exact_terms(c: Column | str) -> Column:
    """Values and fiscal periods of a question: distinct, the longest first, then in text order."""
    c = F.col(c) if isinstance(c, str) else c
    periods = F.transform(F.regexp_extract_all(c, F.lit(f"(?i){PERIOD}"), F.lit(0)), F.upper)
    found = F.array_distinct(F.concat(F.regexp_extract_all(c, F.lit(VALUE), F.lit(0)), periods))
    return F.transform(F.array_sort(F.transform(found, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: x["t"])


def is_period(c: Column) -> Column:
    return c.rlike("^(?i)(?:FY[0-9]{2,4}|Q[1-4]|H[12])$")


def wants_math(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).rlike(f"(?i){MATH}")


def wants_brief(c: Column | str) -> Column:
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return c.rlike(f"(?i){BRIEF}") & (F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")) <= 12)


def injections(c: Column | str) -> Column:
    """Snippets that look like instructions to the reader, one for each pattern found."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    found = F.array(*[F.regexp_extract(c, f"(?i)({p})", 1) for p in INJECTIONS])
    return F.transform(F.filter(found, lambda s: s != ""), lambda s: F.left(strip(F.regexp_replace(s, r"\s+", " ")), F.lit(40)))


def question_verdict(c: Column | str) -> Column:
    """``ok``, or why a question is not taken."""
    c = strip(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    return F.when(c == "", "empty").when(F.length(c) > MAX_QUESTION, "too long").when(F.size(injections(c)) > 0, "injection").otherwise("ok")


def unit_after(text: Column, end: Column) -> Column:
    """The unit named within 40 characters after place ``end`` (characters before it) of a text."""
    tail = F.substr(text, end + 1, F.lit(40))
    out = F.lit("bare")
    for name, pattern in reversed(UNITS):
        out = F.when(tail.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


def near(a: Column, b: Column) -> Column:
    """Equal within one part in a hundred, or 0.01."""
    return F.abs(a - b) <= F.greatest(0.01 * F.greatest(F.abs(a), F.abs(b)), F.lit(0.01))


def name_uuid(c: Column | str) -> Column:
    """Version 5 UUID of a name in the URL namespace."""
    h = F.lower(F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(c, "UTF-8"))))
    nibble = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(nibble, F.substring(h, 18, 3)), F.substring(h, 21, 12))
