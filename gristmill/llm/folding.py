"""One consistent form of text that looks the same, by embedded SQL on Arrow partitions.

DuckDB runs inside the Python worker on each Arrow batch: `translate` maps wide and narrow forms,
blanks and look-alike letters, `regexp_replace` drops invisible characters, `nfc_normalize` composes
accents. Raised and lowered digits, fractions, case and accents stay as they are.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gristmill.session import checkpointed

# Letters of other scripts (and letter-like signs) that are drawn as the Latin letter, from Unicode's public
# table of confusable characters: Cyrillic, Greek, Armenian, Cherokee, Lisu and Coptic letters without a stroke of their own.
LOOKALIKES = {
    "a": "аɑ", "b": "Ꮟ", "c": "сϲⲥ", "d": "ԁᏧꓒ", "e": "е", "g": "ɡ", "h": "һᏂ", "i": "іᎥ", "j": "јϳ", "l": "ӏǀ", "o": "оοօⲟ", "p": "рρⲣ", "q": "ԛ",
    "s": "ѕ", "u": "ս", "v": "νѵ", "w": "ԝ", "x": "х", "y": "уү", "μ": "µ",
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐⲂ", "C": "СϹᏟꓚⲤ", "D": "Ꭰꓓ", "E": "ЕΕᎬꓰ", "F": "ꓝ", "G": "ԌᏀᏳꓖ", "H": "НΗᎻꓧⲎ", "I": "ІΙӀꓲⲒ", "J": "ЈͿᎫꓙ", "K": "КΚᏦꓗⲔ",
    "L": "Ꮮꓡ", "M": "МΜᎷꓟⲘ", "N": "ΝꓠⲚ", "O": "ОΟՕꓳⲞ", "P": "РΡᏢꓑⲢ", "Q": "Ԛ", "R": "ᎡᏒꓣ", "S": "ЅՏᏕᏚꓢ", "T": "ТΤᎢꓔⲦ", "U": "ꓴ", "V": "ѴᏙꓦ",
    "W": "ԜᎳᏔꓪ", "X": "ХΧꓫⲬ", "Y": "ΥҮᎩꓬⲨ", "Z": "ΖᏃꓜ", "-": "‐",
}
# Characters that show nothing: Unicode's default ignorable code points and the marks of annotations, but for the
# joiner (U+200D), the selectors of pictures (U+FE0E, U+FE0F) and the tags of flags (U+E0020-U+E007F), which are treated apart.
INVISIBLE = (
    r"\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}\x{200C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}"
    r"\x{3164}\x{FE00}-\x{FE0D}\x{FEFF}\x{FFA0}\x{FFF0}-\x{FFFB}\x{1BCA0}-\x{1BCA3}\x{1D173}-\x{1D17A}\x{E0000}-\x{E001F}\x{E0080}-\x{E0FFF}"
)
# Blanks of other widths, and line breaks.
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
BREAKS = r"\r\n|[\r\x{0B}\x{0C}\x{85}\x{2028}\x{2029}]"
#: Compatibility forms that make no visible difference; joined letters are those of these blocks.
_SAME_LOOK = {"<wide>", "<narrow>", "<final>", "<isolated>", "<initial>", "<medial>", "<noBreak>"}
_JOINED = [*range(0x0132, 0x0134), 0x0149, *range(0x01C4, 0x01CD), 0x01F1, 0x01F2, 0x01F3, *range(0x2160, 0x2180), *range(0xFB00, 0xFB07), *range(0xFB13, 0xFB18), 0xFB4F]
_PICTURE = r"\x{1F000}-\x{1FAFF}\x{2190}-\x{21FF}\x{2300}-\x{23FF}\x{25A0}-\x{27BF}\x{2B00}-\x{2BFF}\x{3030}\x{303D}\x{3297}\x{3299}\x{00A9}\x{00AE}\x{203C}\x{2049}\x{2122}\x{2139}"


@functools.cache
def tables() -> tuple[dict[str, str], dict[str, str]]:
    """(single character -> single character, single character -> several), made by rule from Unicode."""
    single: dict[str, str] = {}
    several: dict[str, str] = {}

    def put(ch: str, to: str) -> None:
        if to != ch:
            (single if len(to) == 1 else several)[ch] = to

    latin = {other: base for base, others in LOOKALIKES.items() for other in others}
    for cp in range(0x10000):
        if unicodedata.decomposition(chr(cp)).split(" ")[0] in _SAME_LOOK:
            to = unicodedata.normalize("NFKC", chr(cp))
            put(chr(cp), latin.get(to, to))
    for cp in _JOINED:
        put(chr(cp), unicodedata.normalize("NFKC", chr(cp)))
    for ch in BLANKS:
        put(ch, " ")
    for ch, base in latin.items():
        put(ch, base)
    # Composed Greek and Cyrillic letters whose base is a look-alike become the composed Latin letter.
    for cp in [*range(0x0370, 0x0530), *range(0x1F00, 0x2000)]:
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) > 1 and parts[0] in latin:
            to = unicodedata.normalize("NFC", latin[parts[0]] + parts[1:])
            put(chr(cp), to)
    return single, several


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@functools.cache
def fold_sql(column: str) -> str:
    """The SQL expression that gives the folded form of `column`."""
    single, several = tables()
    t = f"regexp_replace({column}, '{BREAKS}', chr(10), 'g')"
    t = f"regexp_replace({t}, '[{INVISIBLE}]', '', 'g')"
    # What shows after a picture and nowhere else: the text or picture form, and the tags of a flag.
    t = f"regexp_replace({t}, '([{_PICTURE}][\\x{{FE0E}}\\x{{FE0F}}]|[0-9#*]\\x{{FE0F}}\\x{{20E3}})|[\\x{{FE0E}}\\x{{FE0F}}]', '\\1', 'g')"
    t = f"regexp_replace({t}, '(\\x{{1F3F4}}[\\x{{E0020}}-\\x{{E007F}}]+)|[\\x{{E0020}}-\\x{{E007F}}]', '\\1', 'g')"
    # The joiner shows between pictures and nowhere else; two passes, since neighbours share a picture.
    picture = f"[{_PICTURE}\\x{{FE0F}}]"
    for _ in range(2):
        t = f"regexp_replace({t}, '({picture})\\x{{200D}}({picture})', '\\1\ufdd0\\2', 'g')"
    t = f"translate({t}, {_quoted(chr(0x200D))}, '')"
    t = f"replace({t}, '\ufdd0', {_quoted(chr(0x200D))})"
    # Composed first, so that marks set apart find their letter; again after letters were mapped.
    t = f"nfc_normalize({t})"
    t = f"translate({t}, {_quoted(''.join(single))}, {_quoted(''.join(single.values()))})"
    for ch in _JOINED:
        if chr(ch) in several:
            t = f"replace({t}, {_quoted(chr(ch))}, {_quoted(several[chr(ch)])})"
    several = {ch: to for ch, to in several.items() if ord(ch) not in _JOINED}
    held = "".join(f"\\x{{{ord(c):04X}}}" for c in several)
    spelt = f"MAP([{', '.join(map(_quoted, several))}], [{', '.join(map(_quoted, several.values()))}])"
    letters = f"array_to_string(list_transform(regexp_extract_all(x.t, '(?s).'), lambda c: coalesce({spelt}[c], c)), '')"
    # Letters are looked at one by one only in texts that hold joined ones of other scripts.
    t = f"list_transform([{{'t': {t}}}], lambda x: CASE WHEN regexp_matches(x.t, '[{held}]') THEN {letters} ELSE x.t END)[1]"
    return f"nfc_normalize({t})"


class Folder:
    """A DuckDB connection with the folding query, kept for the life of a task."""

    def __init__(self, threads: int = 1, memory: str = "300MB"):
        import duckdb

        self.con = duckdb.connect(config={"threads": threads, "memory_limit": memory})
        # Plain texts need none of it; only the others pass through the whole expression.
        self.sql = (
            f"SELECT CASE WHEN regexp_matches(t, '[^\\x00-\\x{{0131}}]|[\\r\\x{{0B}}\\x{{0C}}\\x{{85}}\\x{{A0}}\\x{{AD}}\\x{{B5}}]') THEN {fold_sql('t')} ELSE t END AS t FROM batch"
        )

    def fold(self, texts: pa.Array) -> pa.Array:
        """The folded form of each text; null stays null, empty stays empty."""
        batch = pa.table({"t": texts.cast(pa.string())})
        self.con.register("batch", batch)
        got = self.con.sql(self.sql).to_arrow_table().column("t")
        self.con.unregister("batch")
        return pa.concat_arrays(got.chunks).cast(pa.string()) if got.num_chunks else pa.array([], pa.string())


def with_folded(df: DataFrame, text: str, to: str) -> DataFrame:
    """`df` with the folded form of column `text` in a new column `to`.

    Null gives null, empty gives empty; very long texts are handled whole. Rows are neither added nor
    removed. `to` must be new.
    """
    if to in df.columns:
        raise ValueError(f"column {to} is there already")
    schema = StructType([*df.schema.fields, StructField(to, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, folder.fold(b.column(text))], names=[*b.schema.names, to])

    return df.mapInArrow(run, schema)


def _of_several_forms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(__k, __form, __stored): hashes of the folded and the stored text of the rows whose folded form is stored in several ways."""
    base = df.select(F.col(key).alias("__k"), F.col(text).cast("string").alias("__t")).filter(F.length("__t") > 0)
    folded = with_folded(base, "__t", "__f").filter(F.col("__f").rlike(r"[^\s]"))
    rows = folded.select("__k", F.unhex(F.md5("__f")).alias("__form"), F.xxhash64("__t").alias("__stored")).distinct()
    rows = checkpointed(rows)  # several readers; texts are folded once
    forms = (
        rows.groupBy("__form")
        .agg(F.min("__stored").alias("lo"), F.max("__stored").alias("hi"))
        .filter(F.col("lo") != F.col("hi"))
        .select("__form")
    )
    return rows.join(forms, "__form", "left_semi")


def same_look_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, class_id, stored_id): every row that `same_look_pairs` would give in some pair, with the class of those that look
    the same and, within it, of those stored the same. One row for each row of the input, however large a class is."""
    rows = _of_several_forms(df, key, text)
    return rows.select(F.col("__k").alias(key), F.lower(F.hex("__form")).alias("class_id"), F.col("__stored").alias("stored_id"))


def same_look_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key_a, key_b), key_a < key_b: rows whose texts differ as stored but have one folded form.

    Null, empty and blank texts, those of invisible characters alone included, take no part; texts
    identical as stored make no pair. A repeated row (same key and text) counts once. Only hashes of
    128 bits travel: rows meet by the hash of their folded form, and only forms that occur in more than
    one stored text are joined, so the copies of one stored text are never paired among themselves.
    """
    some = _of_several_forms(df, key, text)
    a, b = some.alias("a"), some.alias("b")
    on = (F.col("a.__form") == F.col("b.__form")) & (F.col("a.__stored") != F.col("b.__stored")) & (F.col("a.__k") < F.col("b.__k"))
    return a.join(b, on).select(F.col("a.__k").alias(f"{key}_a"), F.col("b.__k").alias(f"{key}_b")).distinct()
