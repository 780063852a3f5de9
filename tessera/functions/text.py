"""Text and similarity functions over Columns; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

#: Fixed values.
STOPWORDS = ("de", "del", "la", "el", "los", "las", "un", "una", "unos", "unas", "y", "o", "con", "por", "para", "al", "en", "of", "the", "and", "for", "to", "from")
INVARIANT = (
    "status", "alias", "analysis", "address", "process", "access", "business", "class", "bus", "plus", "bonus", "campus", "virus", "series", "species", "atlas",
    "lens", "news", "gross", "pass", "mass", "cross", "case", "base", "release", "phase", "course", "purchase", "response", "expense", "license", "warehouse",
)


def split_identifier(value: Column) -> Column:
    """Words of an identifier: at camel-case and acronym boundaries and at anything but ASCII letters and digits."""
    parted = F.regexp_replace(F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    # the words themselves are found several times faster than what stands between them
    return F.regexp_extract_all(parted, F.lit("[A-Za-z0-9]+"), F.lit(0))


def singularize(t: Column) -> Column:
    """Conservative singular: short and invariant words stay; -ies to -y, consonant -es and plain -s are cut."""
    n = F.length(t)
    return (
        F.when((n <= 3) | t.isin(*INVARIANT), t).when(t.endswith("ies") & (n > 4), F.concat(F.substring(t, F.lit(1), n - 3), F.lit("y")))
        .when(t.endswith("es") & (n > 4) & ~t.rlike("[aeiou]es$"), F.substring(t, F.lit(1), n - 2))
        .when(t.endswith("s") & ~t.rlike("(ss|us|is)$"), F.substring(t, F.lit(1), n - 1)).otherwise(t)
    )


def synonym_map(groups: list[list[str]]) -> Column:
    """Word to the first word of its (last) group, as a map literal."""
    known = {w: g[0] for g in groups for w in g}
    return F.create_map(*(F.lit(x) for pair in known.items() for x in pair)) if known else F.lit(None).cast("map<string,string>")


def tokenize(value: Column, synonyms: list[list[str]] | None = None) -> Column:
    """Array of (token, canonical): lower case, without stopwords and words of one letter, singular unless the word is in a
    synonym group; duplicates stay."""
    known = synonym_map(synonyms or [])
    words = F.filter(F.transform(split_identifier(value), F.lower), lambda w: (F.length(w) >= 2) & ~w.isin(*STOPWORDS))
    single = F.transform(words, lambda w: F.when(F.coalesce(F.map_contains_key(known, w), F.lit(False)), w).otherwise(singularize(w)))
    single = F.filter(single, lambda w: (F.length(w) >= 2) & ~w.isin(*STOPWORDS))
    return F.transform(single, lambda w: F.struct(w.alias("token"), F.coalesce(F.try_element_at(known, w), w).alias("canonical")))


def is_word(w: Column) -> Column:
    """Whether tokens keep a word in lower case."""
    return (F.length(w) >= 2) & ~w.isin(*STOPWORDS)


def token_of(w: Column, synonyms: list[list[str]] | None = None) -> tuple[Column, Column]:
    """Token and canonical form of a single word that `is_word`, as `tokenize` makes them of a text's words; the token must be a word again."""
    if not synonyms:
        return singularize(w), singularize(w)
    known = synonym_map(synonyms)
    single = F.when(F.map_contains_key(known, w), w).otherwise(singularize(w))
    return single, F.coalesce(F.try_element_at(known, single), single)


def canonical_terms(value: Column, synonyms: list[list[str]] | None = None) -> Column:
    return F.array_distinct(F.transform(tokenize(value, synonyms), lambda t: t["canonical"]))


def term_set(value: Column, synonyms: list[list[str]] | None = None) -> Column:
    """The tokens of a text and the canonical forms of those that have another, each once."""
    t = tokenize(value, synonyms)
    other = F.filter(t, lambda x: x["token"] != x["canonical"])
    return F.array_union(F.transform(t, lambda x: x["token"]), F.transform(other, lambda x: x["canonical"]))


def read_synonyms(spark: SparkSession, path: str) -> list[list[str]]:
    """Synonym groups of text files: a group a line, words parted by commas or blanks, the first one canonical. The groups are a
    small dimension, made into a map literal; a word of several groups belongs to the last."""
    lines = spark.read.text(path).select(F.filter(F.split(F.lower("value"), r"[,\s]+"), lambda w: w != "").alias("words"))
    return [r.words for r in lines.filter("size(words) > 1").collect()]


def escape_xml(value: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(plain), F.lit(escaped))
    return value


def percent(share: Column) -> Column:
    return F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%"))


def spanish_date(day: Column) -> Column:
    return F.date_format(day, "d/M/yyyy")


def iso_time(at: Column) -> Column:
    """A timestamp of the session's time zone as UTC, in milliseconds."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def trigrams(t: Column) -> Column:
    p = F.concat(F.lit("#"), t, F.lit("#"))
    found = F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3)))
    return F.array_distinct(F.when(F.length(p) >= 3, found).otherwise(F.array().cast("array<string>")))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def dice(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    both = 2.0 * F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(x) + F.size(y))
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(both)


def jaccard(x: Column, y: Column) -> Column:
    """Of arrays of distinct values; two empty ones have 0."""
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(union, F.lit(1)))


def match_score(query: str, text: Column, weight: float | Column) -> Column:
    """Literal match of a query that isn't blank: equal, prefix, inside, all or some of its words inside words of the text, or
    inside the text without separators; null without a match."""
    q, t = query.strip().lower(), F.lower(text)
    words = q.split()
    rules = F.when(t == q, 1.0).when(t.startswith(q), 0.95).when(F.contains(t, F.lit(q)), 0.8)
    if len(words) > 1:
        found = sum((_inside(t, w).cast("int") for w in words), F.lit(0))
        rules = rules.when(found == len(words), 0.7).when(found > 0, 0.5)
    return rules.when(F.contains(F.regexp_replace(t, r"[_\s]", ""), F.lit("".join(words))), 0.65) * weight


def match_score_of(query: Column, text: Column) -> Column:
    """The same for a column of queries, in lower case, trimmed and not empty."""
    t, words = F.lower(text), F.filter(F.split(query, r"\s+"), lambda w: w != "")
    # a word without a separator that is in the text is inside one of the text's words; one with a separator never is
    found = F.size(F.filter(words, lambda w: F.contains(t, w) & ~F.contains(w, F.lit("_"))))
    several = F.size(words) > 1
    return (
        F.when(t == query, 1.0).when(F.startswith(t, query), 0.95).when(F.contains(t, query), 0.8).when(several & (found == F.size(words)), 0.7).when(several & (found > 0), 0.5)
        .when(F.contains(F.regexp_replace(t, r"[_\s]", ""), F.array_join(words, "")), 0.65)
    )


def _inside(t: Column, word: str) -> Column:
    return F.exists(F.split(t, r"[\s_]+"), lambda x: F.contains(x, F.lit(word)))
