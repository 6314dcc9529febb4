"""Listings of the same product: title combination voting, then verification and merging.

1. A listing is read into words, code numbers and properties (power, length, volume, ... in one unit
   each, colour, pack), from its title and its description.
2. Token combinations, here pairs of a word and a number, are made of each listing: of its title, of a
   labelled model, and of every sentence. A combination is scored by how often it occurs, how rare its
   tokens are (their length in the sense of information), and how close they stand; each listing is given
   its best one. Model name and number win by vote: no list of models, brands, kinds of product or
   marketing phrases is needed.
3. Listings with one number and equal properties are verified: model names are merged if they differ by
   a slip of the pen, and split where descriptions name different brands. A listing that states fewer
   properties joins those of its model that state more, if all that agree with it agree with each other.

Kind of product needs no list either: listings of one name and number that state the same kinds of
property are of one kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.session import checkpointed

# Notations of units, by what is measured, with the factor to its base unit.
UNITS = {
    "power": {"w": 1, "watt": 1, "watts": 1, "kw": 1000}, "voltage": {"volt": 1, "volts": 1},
    "battery": {"mah": 1, "ah": 1000},
    "length": {"mm": 1, "cm": 10, "m": 1000, "mtr": 1000, "meter": 1000, "metre": 1000, "ft": 304.8, "feet": 304.8, "inch": 25.4, "inches": 25.4, '"': 25.4},
    "volume": {"ml": 1, "cl": 10, "l": 1000, "litre": 1000, "liter": 1000, "ltr": 1000},
    "weight": {"g": 1, "gm": 1, "gram": 1, "grams": 1, "kg": 1000, "lb": 453.592, "lbs": 453.592, "oz": 28.3495},
    "capacity": {"gb": 1, "gigabyte": 1, "gigabytes": 1, "tb": 1024, "terabyte": 1024, "mb": 1 / 1024},
    "pack": {"pc": 1, "pcs": 1, "pack": 1, "pieces": 1},
}
# Notations of colours.
COLOURS = {
    "blue": ["blue", "blu"], "black": ["black", "blk"], "white": ["white", "wht"], "grey": ["grey", "gray", "gry"],
    "green": ["green", "grn"], "red": ["red"], "yellow": ["yellow", "ylw"], "pink": ["pink", "pnk"], "brown": ["brown", "brn"],
    "silver": ["silver", "slv"], "gold": ["gold", "gld"], "orange": ["orange", "org"], "purple": ["purple", "prp"],
    **{c: [c] for c in "maroon violet beige ivory cream navy teal turquoise cyan magenta indigo crimson burgundy khaki olive lavender bronze peach coral amber".split()},
}

_MEASURE = {u: (what, factor) for what, units in UNITS.items() for u, factor in units.items()}
_COLOUR = {n: c for c, names in COLOURS.items() for n in names}
_units = "|".join(sorted((re.escape(u) for u in _MEASURE if u != "pack"), key=len, reverse=True))
_PACK = re.compile(r"\b(?:pack|set|box) of (\d+)\b|\b(\d+)-pack\b|(\bsingle\b)")
_QUANTITY = re.compile(rf"(?<![\w.,])(\d+(?:,\d{{3}})*(?:\.\d+)?)[ -]?({_units})(?![\w²³])")
_COLOUR_WORDS = re.compile(rf"\b(?:{'|'.join(_COLOUR)}|colou?r)\b")
#: What a segment must hold to say anything about properties or models.
_TELLING = re.compile(rf"\d|\b(?:single|{'|'.join(_COLOUR)})\b")
_TOKEN = re.compile(r"[^\W\d_]+|\d+(?![\d,.]*%)\b|\d+")
_SEGMENT = re.compile(r"\s*[\n|;]\s*|(?<!\b[Nn][Oo])\.\s+")
# Words that stand between a name and its number.
_BETWEEN = re.compile(r"\b(?:model|no|nr)\b[ .:#-]*(?=\d)")
# Words by which a description labels a brand, a model, or a property.
_BRAND = re.compile(r"(?:brand:?|made by) ([^\W\d_]+)|([^\W\d_]+) product")
_MODEL = re.compile(r"(?:model name|model|series):? ?")
_PROPERTY = re.compile(r"(?:colour|color|power|length|size|weight|volume|battery|capacity|contents):? ")

#: Weights of combinations from the title, from a labelled model, of two words of a title without a number, and from sentences.
TITLE, LABELLED, WORDS, ELSEWHERE = 1.0, 0.9, 0.3, 0.25
#: Steps of a weight where it travels; different tokens up to which their counts are broadcast (50 MB).
WEIGHTS, BROADCAST_TOKENS = 10_000, 500_000
#: A word or number that more listings than this, and than this share of all, have in title or label names no model.
SHARED_ROWS, SHARED = 100, 0.02
#: Different names of one number and set of properties up to which one task compares them; more are
#: linked across the cluster, with the same result.
NAMES_IN_TASK = 2_000
#: Slips (a letter left out, put in, replaced, or two swapped) up to which long and short names are one.
SLIPS, SLIPS_SHORT, SHORT = 2, 1, 6


def _base(value: float, unit: str, glued: bool) -> tuple[str, float]:
    """(what is measured, amount in the base unit, rounded to what the notation can tell)."""
    what, factor = _MEASURE[unit]
    amount = value * factor
    # `64G` written as one is a memory size where it is a power of two; a weight is not.
    if unit == "g" and glued and value >= 8 and value == int(value) and int(value) & (int(value) - 1) == 0:
        return "capacity", value
    if unit in ("ft", "feet"):
        amount = round(amount / 50) * 50.0  # a tenth of a foot is 30 mm
    elif what == "length" and factor in (25.4, 10):
        amount = round(amount / 10) * 10.0 if amount >= 500 else float(round(amount))
    return what, round(amount, 4)


def read_properties(text: str, into: dict[str, set]) -> str:
    """`text` (lower case) without its properties, which are put into `into`."""

    def pack(m: re.Match) -> str:
        into.setdefault("pack", set()).add(float(m.group(1) or m.group(2) or 1))
        return " , "

    def quantity(m: re.Match) -> str:
        glued = m.end(1) == m.start(2)
        what, amount = _base(float(m.group(1).replace(",", "")), m.group(2), glued)
        into.setdefault(what, set()).add(amount)
        return " , "

    text = _QUANTITY.sub(quantity, _PACK.sub(pack, text))
    for w in _COLOUR_WORDS.findall(text):
        if w in _COLOUR:
            into.setdefault("colour", set()).add(_COLOUR[w])
    return text


def combine(text: str, weight: float, combos: dict[tuple[str, str], float]) -> list[str]:
    """The tokens of `text`, whose combinations are put into `combos`."""
    tokens = [t for t in _TOKEN.findall(_BETWEEN.sub("", text)) if t not in _COLOUR]
    for j, n in enumerate(tokens):
        if not n.isdigit():
            continue
        for i, w in enumerate(tokens):
            if w.isdigit() or len(w) < 2:
                continue
            gap = j - i if i < j else i - j + 2
            combos[w, n] = max(combos.get((w, n), 0.0), weight / (1 + (gap - 1) / 4))
    return tokens


Combination = tuple[str, str, float, bool]


def read_listing(title: str | None, description: str | None) -> tuple[str, str, list[str], list[Combination]]:
    """(properties in one canonical string, stated brand, title words, combinations: word, number, weight, of title or label)."""
    found: dict[str, set] = {}
    combos: dict[tuple[str, str], float] = {}

    words = [t for t in combine(read_properties((title or "").lower(), found), TITLE, combos) if not t.isdigit()]
    brand = ""
    in_title = dict(found)
    stated: dict[str, set] = {}
    sentences: list[str] = []
    for segment in _SEGMENT.split(description or ""):
        low = segment.strip().lower()
        if m := _BRAND.fullmatch(low):
            brand = m.group(1) or m.group(2)
        elif m := _MODEL.match(low):
            combine(low[m.end() :], LABELLED, combos)
        elif _TELLING.search(low):
            own: dict[str, set] = {}
            rest = read_properties(_PROPERTY.sub("", low, count=1), own)
            # A property of the listing stands alone in its segment; sentences may speak of anything.
            if own and not _COLOUR_WORDS.sub("", rest).strip(" ,.-"):
                for k, v in own.items():
                    stated.setdefault(k, set()).update(v)
            else:
                sentences.append(rest)
    # Where neither title nor label has a number, pairs of title words stand in, in one order whatever that of the title.
    if not combos:
        named = [w for w in words if len(w) > 1]
        for j, y in enumerate(named):
            for i, x in enumerate(named[:j]):
                if x != y:
                    pair = max(x, y), min(x, y)
                    combos[pair] = max(combos.get(pair, 0.0), WORDS / (1 + (j - i - 1) / 4))
    said: dict[tuple[str, str], float] = {}
    for rest in sentences:
        combine(rest, ELSEWHERE, said)
    for k, v in stated.items():
        if k not in in_title:
            found[k] = v
    props = ";".join(f"{k}={','.join(sorted(map(str, v)))}" for k, v in sorted(found.items()))
    return props, brand, words, [(w, n, s, True) for (w, n), s in combos.items()] + [(w, n, s, False) for (w, n), s in said.items() if (w, n) not in combos]


def slips(a: str, b: str, most: int) -> int:
    """Edits between two words, a swap of neighbours counting one; `most` + 1 where there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def _allowed(a: str, b: str) -> int:
    """Slips that two names may be apart."""
    return SLIPS if min(len(a), len(b)) >= SHORT else SLIPS_SHORT


def merge_names(names: list[str]) -> dict[str, str]:
    """Each name -> the first name, in order, of its cluster of names linked by slips."""
    root = {n: n for n in names}

    def find(n: str) -> str:
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for i, a in enumerate(names):
        for b in names[:i]:
            most = _allowed(a, b)
            if slips(a, b, most) <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in names}


def _packed(combos: list[Combination]) -> tuple[list[str], int, list[int]]:
    """The different tokens of a listing's combinations, those of title or label first; how many those are; and each
    combination as one number: place of its word, place of its number, weight and whether it is of title or label."""
    tokens: dict[str, int] = {}
    for w, n, _, own in combos:
        if own:
            tokens.setdefault(w, len(tokens)), tokens.setdefault(n, len(tokens))
    owned, codes = len(tokens), []
    for w, n, s, own in combos:
        i, j = tokens.setdefault(w, len(tokens)), tokens.setdefault(n, len(tokens))
        codes.append(i << 39 | j << 15 | max(1, round(s * WEIGHTS)) << 1 | own)
    return list(tokens), owned, codes


def _merged(at: tuple[str, str] | None, group: list[tuple[str, list[str]]]) -> list[tuple]:
    """(n, props, w, name, known brands) of the names of one group."""
    if not group:
        return []
    to = merge_names([w for w, _ in group]) if len(group) > 1 else {group[0][0]: group[0][0]}
    brands: dict[str, set] = {}
    for w, b in group:
        brands.setdefault(to[w], set()).update(b)
    return [(*at, w, to[w], sorted(brands[to[w]])) for w, _ in group]


def _merged_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 5
    kinds = [pa.string()] * 4 + [pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["n", "props", "w", "name", "known"])


def _merged_in_tasks(names: DataFrame) -> DataFrame:
    """(n, props, w, name, known): the names of each number and set of properties merged within one task."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted rows: each group is complete when the next begins, however many groups a task has.
        at, group = None, []
        for b in batches:
            out: list[tuple] = []
            for n, props, w, brands in zip(*(b.column(c).to_pylist() for c in ("n", "props", "w", "brands"))):
                if (n, props) != at:
                    out += _merged(at, group)
                    at, group = (n, props), []
                group.append((w, brands))
            yield _merged_batch(out)
        yield _merged_batch(_merged(at, group))

    ordered = names.repartition("n", "props").sortWithinPartitions("n", "props", "w")
    return ordered.mapInArrow(merge, "n string, props string, w string, name string, known array<string>")


def _shortened(word: str, most: int) -> set[str]:
    """The word with up to `most` letters left out; words within `most` slips have one of these in common."""
    found = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        found = found | last
    return found


def _merged_by_edges(names: DataFrame) -> DataFrame:
    """The same for groups of any number of names: names meet by their shortened forms, and the smallest name
    of each linked set spreads along the links until nothing changes."""
    at = ["n", "props"]

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(n, p, w, f) for n, p, w in zip(*(b.column(c).to_pylist() for c in ("n", "props", "w"))) for f in _shortened(w, SLIPS)]
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], names=["n", "props", "w", "form"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [slips(x, y, m) <= m for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()) for m in (_allowed(x, y),)]
            yield b.filter(pa.array(keep, pa.bool_()))

    forms = names.select(*at, "w").mapInArrow(shorten, "n string, props string, w string, form string")
    pairs = forms.withColumnRenamed("w", "x").join(forms.withColumnRenamed("w", "y"), [*at, "form"]).filter("x < y").select(*at, "x", "y").distinct()
    edges = pairs.mapInArrow(check, "n string, props string, x string, y string")
    links = checkpointed(edges.unionByName(edges.select(*at, F.col("y").alias("x"), F.col("x").alias("y"))))
    labels = checkpointed(names.select(*at, "w", F.col("w").alias("name")))
    while True:
        near = links.join(labels.withColumnRenamed("w", "y"), [*at, "y"]).groupBy(*at, F.col("x").alias("w")).agg(F.min("name").alias("of_near"))
        step = labels.join(near, [*at, "w"], "left").select(*at, "w", F.least("name", "of_near").alias("name"), (F.col("of_near") < F.col("name")).alias("moved"))
        step = checkpointed(step)
        # Each name takes the label of its label, so a chain of any length is followed in a number of rounds of its logarithm.
        of_label = step.select(*at, F.col("w").alias("name"), F.col("name").alias("of_label"))
        labels = checkpointed(step.join(of_label, [*at, "name"]).select(*at, "w", F.col("of_label").alias("name")))
        if step.filter("moved").isEmpty():
            break
    named = names.join(labels, [*at, "w"])
    known = named.select(*at, "name", F.explode_outer("brands").alias("b")).groupBy(*at, "name").agg(F.array_sort(F.collect_set("b")).alias("known"))
    return named.join(known, [*at, "name"]).select(*at, "w", "name", "known")


def _best_combinations(listings: DataFrame, total: int) -> DataFrame:
    """(row, i, names): the best combination of each listing, and whether it names a model: noise, a word or number that
    very many titles and labels have, does so only where there is nothing else, and so does what no title or label has.

    Only numbers travel: combinations go by hashes of their tokens until the best of each listing is known.
    """
    # Tokens differ within a listing before they are counted, so sums combine map-side.
    tokens = listings.select("owned", F.posexplode("tokens").alias("at", "token")).select(F.xxhash64("token").alias("h"), (F.col("at") < F.col("owned")).alias("own"))
    tokens = tokens.groupBy("h").agg(F.count("*").alias("listings"), F.count_if("own").alias("titles"))
    tokens = checkpointed(tokens)
    # Spark takes exploded rows for as many as the listings and would send them to the driver to broadcast them; merge joins are told.
    known = F.broadcast(tokens) if tokens.count() <= BROADCAST_TOKENS else tokens.hint("merge")

    each = listings.select("row", "tokens", F.posexplode("codes").alias("i", "code"))
    hw, hn = F.xxhash64(F.get("tokens", _word(F.col("code")))), F.xxhash64(F.get("tokens", _number(F.col("code"))))
    weight = F.shiftrightunsigned(F.col("code"), 1).bitwiseAND((1 << 14) - 1)
    mark = F.xxhash64(hw, hn)
    # Counted before they are joined: a combination meets its tokens' counts once, however many listings have it.
    pairs = each.select(mark.alias("c"), hw.alias("hw"), hn.alias("hn"), F.col("code").bitwiseAND(1).alias("own"))
    pairs = pairs.groupBy("c").agg(F.count("*").alias("together"), F.max("own").alias("named"), F.min("hw").alias("hw"), F.min("hn").alias("hn"))
    for h in ("hw", "hn"):
        pairs = pairs.join(known.select(F.col("h").alias(h), F.col("listings").alias(f"with_{h}"), F.col("titles").alias(f"own_{h}")), h)
    rarity = F.log(F.lit(2.0 * total) / F.col("with_hw")) + F.log(F.lit(2.0 * total) / F.col("with_hn"))
    names = (F.col("named") > 0) & (F.greatest("own_hw", "own_hn") <= max(SHARED_ROWS, SHARED * total))
    votes = pairs.select("c", ((F.col("together") + 0.5) / (F.col("together") + 1) * rarity).cast("float").alias("vote"), names.alias("names"))
    # One number orders them: naming before score before hash; the place of the combination is its tail.
    place = (F.col("i").cast("long") * (1 << 14)) + weight
    score = F.least((F.col("vote") * F.col("place").bitwiseAND((1 << 14) - 1) * ((1 << 30) / WEIGHTS / 64)).cast("long"), F.lit((1 << 30) - 1))
    order = F.col("names").cast("long") * (1 << 62) + score * (1 << 32) + F.pmod("c", F.lit(1 << 8)) * (1 << 24) + F.shiftrightunsigned("place", 14)
    best = each.select("row", mark.alias("c"), place.alias("place")).hint("merge").join(votes, "c").groupBy("row").agg(F.max(order).alias("best"))
    return best.select("row", F.col("best").bitwiseAND((1 << 24) - 1).cast("int").alias("i"), (F.col("best") >= (1 << 62)).alias("names"))


def _word(code: Column) -> Column:
    return F.shiftrightunsigned(code, 39).cast("int")


def _number(code: Column) -> Column:
    return F.shiftrightunsigned(code, 15).bitwiseAND((1 << 24) - 1).cast("int")


def _joined_by_properties(groups: DataFrame) -> DataFrame:
    """(n, name, of, props, into): the sets of properties that are part of a larger set of the same model, where all larger
    ones agree with each other, and the largest of them. `groups` is the different (n, name, of, props).

    A set meets larger ones by its rarest property within the model, so sets that only share a common one never meet.
    """
    model = ["n", "name", "of"]
    sets = groups.withColumn("all", F.array_append(F.filter(F.split("props", ";"), lambda p: p != ""), F.lit("")))
    uneven = sets.groupBy(*model).agg(F.min(F.size("all")).alias("lo"), F.max(F.size("all")).alias("hi")).filter("lo < hi").select(*model)
    sets = checkpointed(sets.join(uneven, model, "left_semi"))
    each = sets.select(*model, "props", "all", F.explode("all").alias("one"))
    counts = each.groupBy(*model, "one").agg(F.count("*").alias("sets"))
    rarest = each.join(counts, [*model, "one"]).groupBy(*model, "props").agg(F.min(F.struct("sets", "one"))["one"].alias("one"))
    larger = each.select(*model, "one", F.col("props").alias("into"), F.col("all").alias("larger"))
    met = rarest.join(sets, [*model, "props"]).join(larger, [*model, "one"])
    met = met.filter((F.size("larger") > F.size("all")) & (F.size(F.array_except("all", "larger")) == 0))
    said = met.select(*model, "props", "into", F.size("larger").alias("size"), F.explode("larger").alias("one")).withColumn("what", F.substring_index("one", "=", 1))
    agreed = said.groupBy(*model, "props", "what").agg((F.min("one") == F.max("one")).alias("agree"), F.max(F.struct("size", "into")).alias("best"))
    found = agreed.groupBy(*model, "props").agg(F.every("agree").alias("agree"), F.max("best")["into"].alias("into"))
    return found.filter("agree").drop("agree")


def group_listings(df: DataFrame, key: str, title: str, description: str, names_in_task: int = NAMES_IN_TASK) -> DataFrame:
    """(key, group_id): the group of each listing; listings of one product share it.

    Null and empty titles and descriptions are read as empty; a listing without a number goes by pairs of its title
    words, and one without a title or a number is a group of its own. A repeated row counts once; a key that is stored with different texts may be in
    several groups. Long texts are read whole. Other columns are not read. An empty table gives no row.
    Every step meets rows by keys of their own: combinations are counted with map-side sums, and names
    are compared among the different names of one number and one set of properties only, in one task up to
    `names_in_task` of them. Group ids are hashes of 128 bits.
    """
    base = df.select(F.col(key).alias("k"), F.col(title).cast("string").alias("t"), F.col(description).cast("string").alias("d")).distinct()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [read_listing(t, d) for t, d in zip(b.column("t").to_pylist(), b.column("d").to_pylist())]
            kinds = [pa.string(), pa.string(), pa.list_(pa.string())]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            packed = [_packed(r[3]) for r in rows]
            kinds = [pa.list_(pa.string()), pa.int32(), pa.list_(pa.int64())]
            columns += [pa.array([x[i] for x in packed], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("k"), *columns], names=["k", "props", "brand", "words", "tokens", "owned", "codes"])

    kind = base.schema["k"].dataType.simpleString()
    listings = base.mapInArrow(read, f"k {kind}, props string, brand string, words array<string>, tokens array<string>, owned int, codes array<long>")
    # Numbered and written: a row keeps its number whatever is computed again.
    listings = checkpointed(listings.withColumn("row", F.monotonically_increasing_id()))
    total = listings.count()
    chosen = listings.join(_best_combinations(listings, total), "row", "left").withColumn("code", F.get("codes", F.col("i")))
    w, n = F.get("tokens", _word(F.col("code"))), F.get("tokens", _number(F.col("code")))
    chosen = chosen.select("row", "k", "props", "brand", "words", w.alias("w"), n.alias("n"), "names")
    # Two words of very many listings name no model, nor does a single one: then only equal titles are one.
    whole = F.array_join(F.array_sort("words"), " ")
    weak = (F.size("words") > 0) & (F.col("w").isNull() | (~F.col("n").rlike(r"^\d+$") & ~F.col("names")))
    chosen = checkpointed(chosen.withColumns({c: F.when(weak, whole).otherwise(F.col(c)) for c in ("w", "n")}).drop("names"))

    # Verification: different (name, stated brand) of one number and one set of properties.
    names = chosen.filter(F.col("w").isNotNull()).groupBy("n", "props", "w").agg(F.collect_set(F.nullif("brand", F.lit(""))).alias("brands"))
    large = checkpointed(names.groupBy("n", "props").agg(F.count("*").alias("names")).filter(F.col("names") > names_in_task)).select("n", "props")
    if large.isEmpty():
        merged = _merged_in_tasks(names)
    else:
        merged = _merged_in_tasks(names.join(large, ["n", "props"], "left_anti")).unionByName(_merged_by_edges(names.join(large, ["n", "props"], "left_semi")))
    placed = chosen.join(merged, ["n", "props", "w"], "left")
    # Where a name belongs to several brands, a listing that states none takes the one its title names.
    of_title = F.get(F.array_intersect("words", "known"), F.lit(0))
    brand = F.when(F.size("known") > 1, F.coalesce(F.nullif("brand", F.lit("")), of_title, F.lit(""))).otherwise(F.lit(""))
    placed = checkpointed(placed.select("row", "k", "n", "name", brand.alias("of"), "props"))
    joined = checkpointed(_joined_by_properties(placed.filter("name IS NOT NULL").select("n", "name", "of", "props").distinct()))
    placed = placed.join(joined, ["n", "name", "of", "props"], "left").withColumn("props", F.coalesce("into", "props"))
    mark = F.when(F.col("name").isNotNull(), F.concat_ws("\x00", F.lit("model"), "name", "n", "props", "of")).otherwise(F.concat_ws("\x00", F.lit("row"), F.col("row").cast("string")))
    return placed.select(F.col("k").alias(key), F.md5(mark).alias("group_id")).distinct()


def same_product_pairs(groups: DataFrame, key: str) -> DataFrame:
    """(key_a, key_b), key_a < key_b, of every two listings in one group; the groups are computed once."""
    groups = checkpointed(groups)
    a, b = groups.alias("a"), groups.alias("b")
    on = (F.col("a.group_id") == F.col("b.group_id")) & (F.col(f"a.{key}") < F.col(f"b.{key}"))
    return a.join(b, on).select(F.col(f"a.{key}").alias(f"{key}_a"), F.col(f"b.{key}").alias(f"{key}_b")).distinct()
