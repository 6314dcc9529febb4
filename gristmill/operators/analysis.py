"""Queries and model answers read by rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.text import contains_any

# Words by which a query names a kind of product, the first kind that fits.
PRODUCT_TYPES = [("cable", ["cable", "charger", "cord"]), ("headphone", ["headset", "headphone", "earphone", "earbud"])]
# Terms that widen a kind of product when categories are compared.
WIDER = {"cable": ["charger", "usb", "lightning"], "headphone": ["headset", "earphone", "earbuds"]}
# Parts of category names that the multimodal search looks for, by kind of product.
MULTIMODAL_CATEGORIES = {"cable": ["usbcables", "cable", "charger"], "headphone": ["pcheadsets", "headphones", "earbuds"]}
# Feature -> alternatives; an alternative holds if all its words occur.
FEATURES = [
    ("high quality", [["quality"]]), ("fast charging", [["fast", "charging"]]), ("noise cancelling", [["noise", "cancelling"]]),
    ("warranty", [["warranty"]]), ("warranty", [["warranty"], ["guarantee"], ["year"]]), ("iphone compatible", [["iphone"]]),
]
# The same for the demonstration search.
DEMO_TYPES = [*PRODUCT_TYPES, ("mouse", ["mouse"])]
DEMO_FEATURES = [
    ("high quality", [["quality"]]), ("fast charging", [["fast", "charging"]]),
    ("noise cancellation", [["noise", "cancelling"], ["noise", "canceling"], ["noise", "cancel"]]),
    ("warranty", [["warranty"]]), ("wireless", [["wireless"]]), ("long battery life", [["battery"]]),
]


def product_type(query: Column, types: list = PRODUCT_TYPES) -> Column:
    """The kind of product a query names, empty where it names none."""
    low = F.lower(query)
    out = F.lit("")
    for name, terms in reversed(types):
        out = F.when(contains_any(low, terms), F.lit(name)).otherwise(out)
    return out


def key_features(query: Column, features: list = FEATURES) -> Column:
    """Features a query asks for, in the order of the rules; one that two rules give stands twice."""
    low = F.lower(F.coalesce(query, F.lit("")))
    found = []
    for name, alternatives in features:
        holds = F.lit(False)
        for ws in alternatives:
            every = F.lit(True)
            for w in ws:
                every = every & low.contains(w)
            holds = holds | every
        found.append(F.when(holds, F.lit(name)))
    return F.filter(F.array(*found), lambda f: f.isNotNull())


def upper_bound(query: Column) -> Column:
    """The number of "under N USD", in any case; null where there is none."""
    return F.regexp_extract(query, r"(?i)under (\d+(\.\d+)?)\s*USD", 1).try_cast("double")


def category_terms(kind: Column) -> Column:
    """The kind itself and the terms that widen it; none for an empty kind."""
    out = F.when(kind != "", F.array(kind)).otherwise(F.array().cast("array<string>"))
    for name, more in WIDER.items():
        out = F.when(kind == name, F.array(F.lit(name), *[F.lit(t) for t in more])).otherwise(out)
    return out


def multimodal_categories(kind: Column) -> Column:
    """The parts of category names for a kind of product, else the kind itself; none for an empty kind."""
    out = F.when(kind != "", F.array(kind)).otherwise(F.array().cast("array<string>"))
    for name, parts in MULTIMODAL_CATEGORIES.items():
        out = F.when(kind == name, F.array(*[F.lit(p) for p in parts])).otherwise(out)
    return out


def analyse(query: Column) -> Column:
    """STRUCT of product_type, key_features and price_constraint."""
    return F.struct(product_type(query).alias("product_type"), key_features(query).alias("key_features"), upper_bound(query).alias("price_constraint"))


# The lexemes of loosely written JSON, in this order: a string with its escapes; a comma that nothing but a closing bracket
# follows; a bare name before a colon; one of Python's constants; a run of anything else.
_LEXEMES = (
    r'"(?:[^"\\]|\\.)*+"'
    r"|,(?=\s*[}\]])"
    r"|[\p{L}_][\p{L}\p{N}_]*+(?=\s*:)"
    r"|\b(?:True|False|None)\b"
    r'|[\p{L}_][\p{L}\p{N}_]*+|[^",\p{L}_]++|.'
)


def repair_json(text: Column) -> Column:
    """Loosely written JSON made strict: commas before closing brackets dropped, bare keys quoted, Python's constants renamed.

    The text is cut into lexemes and each is written anew, so what stands inside a string is never touched. Null stays null.
    """
    strict = {"True": "true", "False": "false", "None": "null"}

    def written(lexeme: Column, after: Column) -> Column:
        out = F.when((lexeme == ",") & after.rlike(r"^\s*[}\]]"), F.lit(""))
        out = out.when(lexeme.rlike(r"^[\p{L}_]") & after.rlike(r"^\s*:"), F.concat(F.lit('"'), lexeme, F.lit('"')))
        for loose, right in strict.items():
            out = out.when(lexeme == loose, F.lit(right))
        return out.otherwise(lexeme)

    found = F.regexp_extract_all(text, F.lit(f"(?s){_LEXEMES}"), 0)
    following = F.transform(found, lambda _, i: F.coalesce(F.get(found, i + 1), F.lit("")))
    return F.array_join(F.zip_with(found, following, written), "")


def json_objects(text: Column) -> Column:
    """The innermost `{...}` parts of a text in order, each repaired; those that are no JSON even so are left out."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(r"\{[^{}]*+\}"), 0), repair_json)
    return F.filter(parts, lambda p: F.try_parse_json(p).isNotNull())


def first_number(text: Column) -> Column:
    """The first number in a text; null where there is none."""
    return F.regexp_extract(text, r"[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")


def named_field(text: Column, name: str) -> Column:
    """The rest of the line after a field's name (any case, `_` as a blank) and a colon, quote or blank; empty where it is not named."""
    return F.regexp_extract(text, rf"(?i)\b{name.replace(' ', '[ _]')}\b[\"' ]*[: ][\"' ]*([^\n]*)", 1)


_ANSWER = "product_type string, key_features array<string>, score double"


def parse_answer(text: Column) -> Column:
    """A model's answer as STRUCT(product_type, key_features, score), by the first of these rungs that gives one, else null.

    1. The whole text, if it is a JSON object. 2. The first of its innermost objects that is JSON once repaired. 3. The first
    number, as the score, if the text speaks of a rate or score. 4. Fields named in running text: the words after "product
    type", the items in brackets after "features".
    """
    whole = F.trim(text)
    objects = F.concat(F.array(F.when(whole.startswith("{") & F.try_parse_json(whole).isNotNull(), whole)), json_objects(text))
    from_object = F.from_json(F.get(F.filter(objects, lambda o: o.isNotNull()), F.lit(0)), _ANSWER)

    def answer(kind: Column | None = None, features: Column | None = None, score: Column | None = None) -> Column:
        fields = zip(("product_type", "key_features", "score"), (kind, features, score), ("string", "array<string>", "double"))
        return F.struct(*[(F.lit(None) if c is None else c).cast(t).alias(n) for n, c, t in fields])

    number = F.when(F.lower(text).rlike("rate|score") & first_number(text).isNotNull(), answer(score=first_number(text)))
    kind = F.nullif(F.trim(F.regexp_extract(named_field(text, "product type"), r"^[\p{L}\p{N}_ ]+", 0)), F.lit(""))
    inside = F.regexp_extract(text, r"(?is)features[^\[\n]*\[([^\]]*)\]", 1)
    items = F.filter(F.transform(F.split(inside, ","), lambda i: F.btrim(i, F.lit(" \n\"'"))), lambda i: i != "")
    listed = F.when(F.size(items) > 0, items)
    fields = F.when(kind.isNotNull() | listed.isNotNull(), answer(kind, listed))
    return F.coalesce(from_object, number, fields)


def listing_kind(text: Column) -> Column:
    """earphone, headphone or unknown by the words of a text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.contains("earbud") | low.contains("earphone"), "earphone").when(low.contains("headphone"), "headphone").otherwise("unknown")


def wording_boost(text: Column) -> Column:
    """1 for "wireless", and 2 for excellent noise cancellation or else 0.5 for any."""
    low = F.lower(F.coalesce(text, F.lit("")))
    noise = F.when(low.contains("excellent noise cancellation"), 2.0).when(low.contains("noise cancellation") | low.contains("anc"), 0.5).otherwise(0.0)
    return F.when(low.contains("wireless"), 1.0).otherwise(0.0) + noise
