"""String parsers and normalisers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Descriptive grades, in the order in which they are looked for.
DESCRIPTIVE = {
    "low 70s": 72.0, "mid 70s": 75.0, "high 70s": 78.0, "low 80s": 82.0, "mid 80s": 85.0, "high 80s": 88.0,
    "low 90s": 92.0, "mid 90s": 95.0, "high 90s": 98.0,
}
# Month names by their first three letters.
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
NULL_TOKENS = ("", "null", "none", "n/a", "na", "nan", "-")
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)$"


def lookup(table: dict, key: Column, default: Column | None = None) -> Column:
    """A literal map; a missing key gives the default or null."""
    found = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]
    return found if default is None else F.coalesce(found, default)


def number(c: Column) -> Column:
    """A plain decimal number, else null (a bare cast would take suffixes such as 90f)."""
    return F.when(F.trim(c).rlike(NUMBER), F.trim(c).cast("double"))


def parse_grade(raw: Column) -> Column:
    """Percent sign dropped; a number within [0, 100]; the middle of a range lo-hi; a descriptive
    grade, exact or contained (first in the fixed order); else null."""
    s = F.lower(F.trim(F.regexp_replace(raw, "%", "")))
    value = number(s)
    span = r"^(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)$"
    low, high = (F.nullif(F.regexp_extract(s, span, k), F.lit("")).cast("double") for k in (1, 2))
    told = reduce(lambda acc, kv: F.coalesce(acc, F.when(s.contains(kv[0]), F.lit(kv[1]))), DESCRIPTIVE.items(), F.lit(None).cast("double"))
    return F.when(value.isNotNull(), F.when(value.between(0, 100), value)).otherwise(F.coalesce((low + high) / 2, told))


def normalize_by(table: dict, raw: Column) -> Column:
    """Trimmed and lower-cased: the whole value in the table, else its first word, else null."""
    key = F.lower(F.trim(raw))
    return F.coalesce(lookup(table, key), lookup(table, F.split(key, r"\s+")[0]))


def parse_month(raw: Column) -> Column:
    """Month 1-12 of M/D/Y, Y-M-D, 'Month d' or 'd Month'; null otherwise."""
    s = F.lower(F.trim(raw))
    digits = lambda p: F.nullif(F.regexp_extract(s, p, 1), F.lit("")).cast("int")
    named = lambda p: lookup(MONTHS, F.substring(F.regexp_extract(s, p, 1), 1, 3))
    month = F.coalesce(digits(r"^(\d{1,2})/\d{1,2}/\d{2,4}"), digits(r"^\d{4}-(\d{1,2})-\d{1,2}"), named(r"^([a-z]{3,9})\.?\s+\d{1,2}"), named(r"^\d{1,2}\s+([a-z]{3,9})"))
    return F.when(month.between(1, 12), month)


def parse_date(raw: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "M/d/yyyy", "yyyy/M/d", "MMMM d, yyyy", "MMM d, yyyy", "d MMM yyyy", "d-M-yyyy", "yyyyMMdd")) -> Column:
    """The first format that fits."""
    return F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)).cast("date") for f in formats])


def parse_term(raw: Column) -> tuple[Column, Column]:
    """(index of the term: winter 0, spring 1, summer 2, fall 3; year) of 'Fall 2023', '2023-Fall', 'F23', 'Fa23'."""
    s = F.lower(F.trim(raw))
    word = F.regexp_extract(s, r"(winter|spring|summer|fall|autumn|wi|sp|su|fa|w|s|f)", 1)
    table = {"winter": 0, "wi": 0, "w": 0, "spring": 1, "sp": 1, "s": 1, "summer": 2, "su": 2, "fall": 3, "autumn": 3, "fa": 3, "f": 3}
    year4 = F.nullif(F.regexp_extract(s, r"(\d{4})", 1), F.lit("")).cast("int")
    year2 = F.nullif(F.regexp_extract(s, r"^[a-z]+\s*'?(\d{2})$", 1), F.lit("")).cast("int") + 2000
    return lookup(table, word), F.coalesce(year4, year2)


def clean(c: Column, tokens: tuple[str, ...] = NULL_TOKENS) -> Column:
    """Trimmed; null for a null token in any case."""
    return F.when(~F.lower(F.trim(c)).isin(*tokens), F.trim(c))


def convert(c: Column, kind: str) -> Column:
    """int, float, bool (true, 1, yes) or date; null on failure."""
    if kind == "bool":
        return F.lower(F.trim(c)).isin("true", "1", "yes")
    if kind == "int":
        return F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("bigint"))
    return number(c) if kind == "float" else parse_date(c)


def strip_prefix(value: Column, prefix: Column) -> Column:
    """Without a leading prefix (any case) and the ' -:' after it."""
    rest = F.regexp_replace(F.substring(value, F.length(prefix) + 1, F.length(value)), r"^[ \-:]+", "")
    return F.when(F.startswith(F.lower(value), F.lower(prefix)), rest).otherwise(value)


def is_valid_name(c: Column, garbage: tuple[str, ...] = ("n/a", "none", "test", "asdf", "unknown")) -> Column:
    """A plausible name: 3 or more characters and letters, at most 6 words, no leading slash, no hanging parenthesis, no garbage."""
    t = F.trim(c)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return (F.length(t) >= 3) & (letters >= 3) & ~F.lower(t).isin(*garbage) & ~t.startswith("/") & ~t.endswith("(") & (F.size(F.split(t, r"\s+")) <= 6)


def is_trivial(c: Column) -> Column:
    return (F.length(F.trim(c)) < 10) | F.lower(F.trim(c)).rlike(r"^(no|none|nothing|n/?a|nil|not applicable)[.!]*$")


def substring_either(a: Column, b: Column) -> Column:
    """One contains the other, in any case."""
    return F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a))


def sorted_tokens(c: Column) -> Column:
    kept = F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", ""))
    return F.array_join(F.array_sort(F.split(kept, r"\s+")), " ")


def token_sort_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of the sorted tokens; equal 1, one side empty 0."""
    x, y = sorted_tokens(a), sorted_tokens(b)
    return F.when(x == y, 1.0).when((x == "") | (y == ""), 0.0).otherwise(1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))


#: Degree patterns in order; the first that fits names the degree.
DEGREES = (("BSc", r"\b(b\.?sc\.?|bachelor of science)\b"), ("BA", r"\b(b\.?a\.?|bachelor of arts)\b"), ("BEng", r"\b(b\.?eng\.?|bachelor of engineering)\b"), ("BCom", r"\b(b\.?comm?\.?|bachelor of commerce)\b"), ("BASc", r"\b(b\.?a\.?sc\.?)\b"))


def program_components(name: Column) -> dict[str, Column]:
    """degree, coop, honours, specialisation (after ' - ' or in parentheses), base name and key."""
    low = F.lower(F.trim(name))
    degree = F.coalesce(*[F.when(low.rlike(p), F.lit(d)) for d, p in DEGREES])
    coop, honours = low.rlike(r"\bco-?op\b"), low.rlike(r"\bhono?u?rs\b")
    special = F.coalesce(F.nullif(F.regexp_extract(low, r"\(([^)]+)\)", 1), F.lit("")), F.nullif(F.regexp_extract(low, r"\s-\s(.+)$", 1), F.lit("")))
    base = reduce(lambda c, p: F.regexp_replace(c, p, " "), [p for _, p in DEGREES] + [r"\bco-?op\b", r"\bhono?u?rs\b", r"\([^)]*\)", r"\s-\s.+$", r"[^a-z0-9&' ]", r"\s+"], low)
    base = F.initcap(F.trim(base))
    return {"degree": degree, "is_coop": coop, "is_honours": honours, "specialisation": special, "base_name": base, "name_key": F.regexp_replace(F.lower(base), " ", "_")}


def glob_to_regex(glob: str) -> str:
    """A shell pattern (* ? and plain characters) as an anchored regular expression, any case."""
    plain = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in r"\.[]{}()+-^$|" else c for c in glob)
    return f"(?i)^{plain}$"


def bucket_label(c: Column, steps: list[tuple[float, str]], other: str, missing: str | None = None) -> Column:
    """The label of the first threshold that the value reaches."""
    out = F.when(c.isNull(), F.lit(missing)) if missing is not None else F.when(F.lit(False), F.lit(None).cast("string"))
    for at, label in steps:
        out = out.when(c >= at, F.lit(label))
    return out.otherwise(F.lit(other))
