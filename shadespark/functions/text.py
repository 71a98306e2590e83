"""Text, key and URL clean-up as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed character table of the accent fold.
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
# Fixed keywords of leanings: the first label with a keyword inside the name wins.
LEANINGS = (
    ("brown-leaning", ("brown", "chocolate", "cocoa", "coffee", "mocha", "caramel", "toffee", "tan")), ("nude-leaning", ("nude", "beige", "neutral", "sand", "latte", "cream")),
    ("pink-leaning", ("pink", "rose", "rosy", "fuchsia", "blush")), ("red-leaning", ("red", "scarlet", "crimson", "cherry")), ("berry-leaning", ("berry", "raspberry", "cranberry")),
    ("peach-leaning", ("peach", "apricot")), ("coral-leaning", ("coral",)), ("plum-leaning", ("plum", "prune")), ("purple-leaning", ("purple", "violet", "lilac")), ("orange-leaning", ("orange", "tangerine")),
)
# Fixed words of colour families: the first family with a whole word in the text wins.
FAMILIES = (
    ("nude", ("nude", "beige", "neutral")), ("red", ("red", "scarlet", "crimson", "cherry")), ("pink", ("pink", "rose", "rosy", "fuchsia")), ("berry", ("berry", "raspberry", "cranberry")), ("mauve", ("mauve",)),
    ("coral", ("coral",)), ("peach", ("peach",)), ("brown", ("brown", "chocolate", "cocoa")), ("plum", ("plum", "prune")), ("purple", ("purple", "violet", "lilac")), ("orange", ("orange", "tangerine")),
)
# Fixed synonym map of labels.
SYNONYMS = {
    "grey": "gray", "gris": "gray", "silver": "gray", "tan": "beige", "sand": "beige", "ivory": "beige", "cream": "beige", "taupe": "taupe", "olive": "green", "olive green": "green", "sage": "green",
    "khaki": "green", "navy": "blue", "azure": "blue", "burgundy": "red", "maroon": "red", "crimson": "red", "magenta": "pink", "fuchsia": "pink", "hot pink": "pink", "salmon": "coral", "coral pink": "coral",
    "chocolate": "brown", "coffee": "brown", "lavender": "purple", "plum": "purple", "violet": "purple",
}


def normalise(x: Column) -> Column:
    """Lower case, other than letters and digits to one space."""
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))


def key(x: Column) -> Column:
    """Name key: _ / \\ - to spaces, other symbols dropped, squeezed, lower case."""
    spaced = F.regexp_replace(F.lower(x), r"[_/\\-]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, r"[^\p{L}\p{N}\s]+", ""), r"\s+", " "))


def fold(x: Column) -> Column:
    """Accents folded, symbols stripped, lower case."""
    return F.trim(F.regexp_replace(F.translate(F.lower(x), *ACCENTS), r"[^a-z0-9]+", " "))


def clean_id(x: Column) -> Column:
    """"123.0" is "123"; "nan", "none" and blanks are empty."""
    bare = F.trim(x)
    return F.when(F.lower(bare).isin("nan", "none", ""), "").otherwise(F.regexp_replace(bare, r"\.0+$", ""))


def tokens(x: Column) -> Column:
    return F.filter(F.split(normalise(x), " "), lambda t: t != "")


def variants(t: Column) -> Column:
    """The token and its forms without -ish, -y and -s, in this order."""
    n = F.length(t)
    ish = F.when((n >= 5) & t.endswith("ish"), F.substring(t, F.lit(1), n - 3))
    y = F.when((n >= 4) & t.endswith("y"), F.substring(t, F.lit(1), n - 1))
    s = F.when((n >= 5) & t.endswith("s") & ~t.rlike("(ss|us|is)$"), F.substring(t, F.lit(1), n - 1))
    return F.array_distinct(F.array_compact(F.array(t, ish, y, s)))


def preferred(t: Column, present: Column) -> Column:
    """Of a token's variants, the one to look up: the token itself if present holds it, else the shortest variant there, else the token."""
    known = F.filter(variants(t), lambda v: F.array_contains(present, v))
    best = F.array_min(F.transform(known, lambda v: F.struct((v != t).alias("other"), F.length(v).alias("n"), v.alias("v"))))["v"]
    return F.coalesce(best, t)


def url_product(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"-(P\d+)\.html", 1), F.lit(""))


def url_host(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]+)", 1), F.lit("")))


def url_bare(url: Column) -> Column:
    """The URL without query and fragment."""
    return F.regexp_extract(url, r"^[^?#]*", 0)


def url_with(url: Column, query: str) -> Column:
    return F.concat(url_bare(url), F.lit("?" + query))


def squeezed(x: Column) -> Column:
    """Whitespace squeezed; blank is NULL."""
    return F.nullif(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(""))


def first_of(*xs: Column) -> Column:
    """The first that is not blank."""
    return F.coalesce(*(squeezed(x) for x in xs))


def _first_rule(x: Column, rules: tuple[tuple[str, str], ...], other: str | None) -> Column:
    rule = reduce(lambda w, r: w.when(F.lower(x).rlike(r[1]), r[0]), rules[1:], F.when(F.lower(x).rlike(rules[0][1]), rules[0][0]))
    return rule.otherwise(F.lit(other))


def leaning(x: Column) -> Column:
    """The leaning of a name by keywords inside it; neutral-leaning without any."""
    return _first_rule(x, tuple((label, "|".join(words)) for label, words in LEANINGS), "neutral-leaning")


def family(x: Column) -> Column:
    """The colour family that a text names by a whole word; NULL without any."""
    return _first_rule(x, tuple((label, rf"\b({'|'.join(words)})\b") for label, words in FAMILIES), None)


def synonym(label: Column) -> Column:
    table = F.create_map(*(F.lit(v) for kv in SYNONYMS.items() for v in kv))
    return F.coalesce(F.try_element_at(table, label), label)
