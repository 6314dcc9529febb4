"""Text as column expressions. Null texts read as empty unless a docstring says otherwise."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words; contracted forms are left out, as tokens hold no apostrophe.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then once here there when where why "
    "how all any both each few more most other some such no nor not only own same so than too very s t can will just don should "
    "now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()

# ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A run of letters, digits and underscores of any script.
WORD = r"[\p{L}\p{N}_]+"


def text_of(c: Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(c, F.lit(""))


def stripped(c: Column) -> Column:
    """Without blanks, tabs and line breaks at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    """Words with single blanks between them."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def words(c: Column) -> Column:
    """Words between blanks; an empty text has none."""
    return F.filter(F.split(collapsed(text_of(c)), " "), lambda w: w != "")


def tokens(c: Column) -> Column:
    """Lower-case word tokens of any script, in order."""
    return F.regexp_extract_all(F.lower(text_of(c)), F.lit(f"({WORD})"), 1)


def is_long_token(t: Column) -> Column:
    """True for tokens of two characters at least."""
    return F.length(t) >= 2


def is_search_token(t: Column) -> Column:
    """True for tokens that sparse search keeps: no stop word, no underscore, two characters at least."""
    return is_long_token(t) & ~t.contains("_") & ~t.isin(STOP_WORDS)


def search_tokens(c: Column) -> Column:
    """The tokens of a text that sparse search keeps, as an array."""
    return F.filter(tokens(c), is_search_token)


@functools.cache
def plain_letters(ascii_only: bool) -> tuple[dict[str, str], dict[str, str]]:
    """(character -> one character, character -> several) of all characters that lose a mark, by rule from Unicode.

    Canonical decomposition without its nonspacing marks; with `ascii_only` compatibility decomposition, of which only ASCII is
    left. Hangul syllables stay composed.
    """
    one, several = {}, {}
    for cp in [*range(0x80, 0xAC00), *range(0xF900, 0x10000)]:
        ch = chr(cp)
        if ascii_only:
            to = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
        else:
            to = "".join(x for x in unicodedata.normalize("NFD", ch) if unicodedata.category(x) != "Mn")
        if to and to != ch:
            (one if len(to) == 1 else several)[ch] = to
    return one, several


def _spelt(c: Column, ascii_only: bool) -> Column:
    one, several = plain_letters(ascii_only)
    t = F.translate(c, "".join(one), "".join(one.values()))
    # Characters are looked at one by one only in texts that hold one of those that become several.
    known = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    each = F.array_join(F.transform(F.split(t, ""), lambda x: F.coalesce(F.try_element_at(known, x), x)), "")
    return F.when((F.octet_length(t) > F.length(t)) & t.rlike(f"[{''.join(several)}]"), each).otherwise(t)


def strip_accents(c: Column) -> Column:
    """Letters of any script without their marks; other characters, `ß` and `ø` among them, stay."""
    t = _spelt(c, ascii_only=False)
    return F.when(F.octet_length(t) > F.length(t), F.regexp_replace(t, r"\p{Mn}+", "")).otherwise(t)


def to_ascii(c: Column) -> Column:
    """The ASCII of the compatibility decomposition: marks and what has no ASCII form are dropped, `ﬁ` is `fi`, `²` is `2`."""
    return F.regexp_replace(_spelt(c, ascii_only=True), r"[^\x00-\x7F]", "")


def strip_punctuation(c: Column) -> Column:
    """Without ASCII punctuation; nothing is put in its place."""
    return F.translate(c, PUNCTUATION, "")


def clean(c: Column, accents: bool = False, special: bool = False, min_length: int = 2) -> Column:
    """Lower-case words: accents and signs removed unless kept, words below `min_length` dropped."""
    t = F.lower(stripped(text_of(c)))
    if not accents:
        t = to_ascii(t)
    if not special:
        t = F.regexp_replace(t, r"[^a-zA-Z0-9\s]", " ")
    return F.array_join(F.filter(words(t), lambda w: F.length(w) >= min_length), " ")


def clean_unicode(c: Column, accents: bool = True) -> Column:
    """Lower-case text without ASCII punctuation, blanks collapsed, accents kept unless told otherwise."""
    t = strip_punctuation(F.lower(stripped(text_of(c))))
    return collapsed(t if accents else strip_accents(t))


def contains_any(c: Column, terms: list[str]) -> Column:
    """True where one of `terms` is part of the text; null gives False."""
    out = F.lit(False)
    for t in terms:
        out = out | F.coalesce(c.contains(t), F.lit(False))
    return out


def path_parts(c: Column) -> Column:
    """Levels of a path set off by `|`, or else by `>`, blanks trimmed; null gives an empty array."""
    parts = F.when(c.contains("|"), F.split(c, r"\|")).when(c.contains(">"), F.split(c, ">")).when(c.isNotNull(), F.array(c))
    return F.coalesce(F.transform(parts, lambda p: F.trim(p)), F.array().cast("array<string>"))


def primary_category(c: Column) -> Column:
    """First level before `|`, lower-case; empty for null."""
    return F.lower(F.trim(F.get(F.split(text_of(c), r"\|"), F.lit(0))))


def category_info(c: Column, levels: int = 2) -> Column:
    """The first `levels` levels (one at least) joined by ` | `; empty for null."""
    parts = F.transform(F.split(text_of(c), r"\|"), lambda p: F.trim(p))
    return F.array_join(F.slice(parts, 1, max(1, levels)), " | ")


def brand(c: Column) -> Column:
    """The ASCII letters and digits a name begins with; null where there are none."""
    return F.nullif(F.regexp_extract(c, "^([A-Za-z0-9]+)", 1), F.lit(""))


def canonical_url(c: Column, root: str) -> Column:
    """`root` and the ten-character id after `/dp/`; other urls as they are."""
    found = F.regexp_extract(c, r"/dp/([A-Za-z0-9_]{10})", 1)
    return F.when(found != "", F.concat(F.lit(root), found)).otherwise(c)


def is_image_url(c: Column) -> Column:
    """True for the endings of image files."""
    return F.coalesce(c.rlike(r"(?i)\.(jpg|jpeg|png|gif|bmp|webp)$"), F.lit(False))


def currency(c: Column) -> Column:
    """Number of a currency or percent text; null where it is none."""
    return F.regexp_replace(c, "[₹$,%]", "").try_cast("double")


def short_number(c: Column) -> Column:
    """1.2M, 34K, 56; halves go to the even digit."""
    return (
        F.when(c >= 1e6, F.format_string("%.1fM", F.bround(c / 1e6, 1)))
        .when(c >= 1e3, F.format_string("%.0fK", F.bround(c / 1e3, 0)))
        .when(c.isNotNull(), F.format_string("%.0f", F.bround(c, 0)))
    )


def labelled(sep: str, *parts: tuple[str, Column]) -> Column:
    """`label` + value of the parts that are not null, joined by `sep`."""
    return F.concat_ws(sep, *[F.when(v.isNotNull(), F.concat(F.lit(label), v)) for label, v in parts])


def sentences(c: Column) -> Column:
    """Sentences: split after a full stop, exclamation or question mark that a blank follows."""
    return F.filter(F.split(text_of(c), r"(?<=[.!?])\s+"), lambda s: s != "")
