"""Several values packed in one field -> one row per value.

The grammar is a parsing expression grammar with ordered alternatives; it is written as one pattern
whose possessive parts never give back what they took, so each alternative either holds or fails as a
whole and the next is tried from the same place:

    field  <- item (DELIM item)*
    item   <- quoted / bracketed / bare
    quoted <- blank* '"' ([^"] / '""')* '"' blank* &(DELIM / END)
    bracketed <- blank* '[' [^\\]]* ']' blank* &(DELIM / END)         (only where `brackets` is set)
    bare   <- (!DELIM .)*

Each alternative is a group of the pattern, so what kind a value is says the alternative that matched. Where
`escapes` is set, a backslash in a quoted value takes the next character as it is.

A quote that is never closed, or that closes before more text, makes `quoted` fail; the value is then
read as bare from its first character, and flagged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Packing:
    """How a field is packed: the delimiter pattern, whether square brackets enclose values, and whether backslashes escape in quotes."""

    delimiter: str
    brackets: bool = False
    escapes: bool = False


#: Levels of a path: commas and ampersands belong to the value.
CATEGORY = Packing(r"[|>»/;\t\r\n]")
#: Texts one after another: commas, slashes and single semicolons belong to the text.
REVIEWS = Packing(r"\|+|;;+|~~+|[\t\r\n]+")

#: Blanks of any width and kind, line breaks among them.
_SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000\ufeff]"
#: Blanks that a delimiter of line breaks or tabs never consists of.
_BLANK = r"[ \x0b\f\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000\ufeff]"
#: Groups of the pattern.
QUOTED, BRACKETED, BARE = 1, 2, 3


def grammar(packing: Packing) -> str:
    """The pattern of one item together with the delimiter, or the opening mark, before it; a group for each alternative."""
    d = f"(?:{packing.delimiter})"
    ends = rf"(?={_BLANK}*+(?:{d}|\z)){_BLANK}*+"
    inside = r'[^"\\]*+(?:(?:""|\\.)[^"\\]*+)*+' if packing.escapes else r'[^"]*+(?:""[^"]*+)*+'
    quoted = rf'{_SPACE}*+("{inside}"){ends}'
    bracketed = rf"{_SPACE}*+(\[[^\]]*+\]){ends}" if packing.brackets else r"(?!)()"
    return rf"(?s)(?:\A\x00|{d})(?:{quoted}|{bracketed}|((?:(?!{d}).)*+))"


def strip(text: Column) -> Column:
    """Without blanks and line breaks at either end."""
    return F.regexp_replace(text, r"\A[\s 　]+|[\s 　]+\z", "")


def split_values(text: Column, packing: Packing) -> Column:
    """ARRAY<STRUCT<item_value, kind, malformed>> of the non-empty values in order.

    Null gives an empty array, as do empty and blank fields and fields of delimiters alone.
    `kind` is quoted, bracketed or bare, as the alternative that matched; `malformed` marks bare values that
    begin or end with a quote.
    """
    # Every item is read with the delimiter before it, so the first is given one of its own.
    marked = F.concat(F.lit("\x00"), F.coalesce(text, F.lit("")))
    found = {group: F.regexp_extract_all(marked, F.lit(grammar(packing)), group) for group in (BARE, QUOTED, *([BRACKETED] if packing.brackets else []))}

    def inner(c: Column) -> Column:
        return c.substr(F.lit(2), F.length(c) - 2)

    def shape(bare: Column, quoted: Column, bracketed: Column) -> Column:
        plain = strip(bare)
        # One pass: of a doubled quote or an escaped character the second is kept.
        unescaped = F.regexp_replace(inner(quoted), r'(?s)\\(.)|"(")' if packing.escapes else '"(")', "$1$2" if packing.escapes else "$1")
        value = F.when(quoted != "", strip(unescaped)).when(bracketed != "", strip(inner(bracketed))).otherwise(plain)
        kind = F.when(quoted != "", "quoted").when(bracketed != "", "bracketed").otherwise("bare")
        odd = (kind == "bare") & (plain.startswith('"') | plain.endswith('"'))
        return F.struct(value.alias("item_value"), kind.alias("kind"), odd.alias("malformed"))

    if packing.brackets:
        items = F.transform(F.arrays_zip(*[found[g].alias(n) for g, n in ((BARE, "a"), (QUOTED, "b"), (BRACKETED, "c"))]), lambda z: shape(z["a"], z["b"], z["c"]))
    else:
        items = F.zip_with(found[BARE], found[QUOTED], lambda a, b: shape(a, b, F.lit("")))
    return F.filter(items, lambda v: v["item_value"] != "")


def unpack(df: DataFrame, key: str, fields: dict[str, Packing]) -> DataFrame:
    """(key, field_name, pos, item_value, kind, malformed): one row per value of every field, pos from 1.

    Rows of `df` that repeat a key with the same content give their values once: repeats are removed
    before the values are unfolded, on the key and a hash of the fields, so the shuffle moves each
    packed text once. Rows of one key with different content each give their values; equal
    (key, field, pos, value) rows among them come out once. Null, empty and blank fields give no row;
    an empty table gives no row. Other columns, whatever their names, are not read. A null key is kept
    as a key. Long fields stay in one task each, as a value never spans rows.
    """
    base = df.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__f{i}") for i, c in enumerate(fields)])
    base = base.distinct()
    cells = F.array(
        *[
            F.struct(F.lit(name).alias("field_name"), split_values(F.col(f"__f{i}"), packing).alias("values"))
            for i, (name, packing) in enumerate(fields.items())
        ]
    )
    rows = base.select("__key", F.inline(cells)).select("__key", "field_name", F.posexplode("values").alias("p", "v"))
    return rows.select(
        F.col("__key").alias(key),
        "field_name",
        (F.col("p") + 1).cast("int").alias("pos"),
        F.col("v.item_value").alias("item_value"),
        F.col("v.kind").alias("kind"),
        F.col("v.malformed").alias("malformed"),
    )
