"""Language of texts and of their parts by interpolated Kneser-Ney character models.

One model per language over character n-grams. All models share, per order, one sorted array of n-gram
hashes; beside it stands a row per n-gram with each language's log probability and back-off weight, so
a character costs one search whatever the number of languages. A segment gets the language of lowest
length-normalised cross-entropy; temperature and rejection are calibrated on held-out segments.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.numbers import hash_below

#: Languages that are told apart if not stated otherwise, in the order of the model's columns.
LANGUAGES = ("en", "pt", "es", "fr", "de", "it")
#: Longest n-gram.
ORDER = 5
#: Labelled texts the models are trained on, at most (a bounded sample by hash of the id).
TRAIN_ROWS = 20_000
#: Words a segment must have to count as a sentence.
MIN_WORDS = 3
#: Calibrated nats that a change of language within a sentence must gain.
SWITCH = 9.0
#: Segments a worker remembers before it starts over.
REMEMBERED = 200_000

# Notations of the languages in labels, besides the two-letter code itself.
NOTATIONS = {
    "en": ["eng", "english", "inglês", "anglais"],
    "pt": ["por", "portuguese", "português", "portugues"],
    "es": ["spa", "spanish", "español", "espanol", "castellano"],
    "fr": ["fra", "fre", "french", "français", "francais"],
    "de": ["deu", "ger", "german", "deutsch"],
    "it": ["ita", "italian", "italiano"],
}

_STOP = re.compile(r"[.!?…]+[\"'”’)\]]*(?=\s|$|[|~;])|[\r\n\t|~]+|;;+|\s[-/–—]+\s|\s{2,}")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_WORD = re.compile(r"[^\W\d_]+")
_EDGE = "\x02"


def label_language(label: Column, languages: Sequence[str] = LANGUAGES) -> Column:
    """The language a label names in any notation (`pt-BR`, `por`, `PT`); null where it names none of `languages`."""
    head = F.regexp_extract(F.lower(F.trim(label)), r"^([\p{L}]+)", 1)
    out = F.lit(None).cast("string")
    for code in languages:
        out = F.when(head.isin(code, *NOTATIONS.get(code, [])), F.lit(code)).otherwise(out)
    return out


def segments_of(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the sentences and separated parts of a text."""
    at = 0
    for m in _STOP.finditer(text):
        if m.start() > at:
            yield at, m.end() if m.group()[0] in ".!?…" else m.start()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def plain(segment: str) -> str:
    """Lower-case letters with single blanks between words; this is what the models read."""
    return _NOT_LETTERS.sub(" ", segment.lower()).strip()


def unaccented(text: str) -> str:
    """Letters without their accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def _mix(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def gram_hashes(texts: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(hashes of the 1- to `order`-grams that end at each place, places that count, owner of each place).

    Every text stands after `order` - 1 edge marks and before one; places of the leading marks don't count.
    """
    pad = _EDGE * (order - 1)
    joined = "".join(f"{pad}{t}{_EDGE}" for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t) + order for t in texts])
    owner = np.repeat(np.arange(len(texts)), lengths)
    starts = np.cumsum(lengths) - lengths
    counts = np.arange(len(codes)) - starts[owner] >= order - 1
    step = np.uint64(0x100000001B3)
    with np.errstate(over="ignore"):
        one = _mix(codes)
        grams = [one]
        for _ in range(order - 1):
            before = np.concatenate([np.zeros(1, np.uint64), grams[-1][:-1]])
            grams.append(before * step + one)
    return grams, counts, owner


@dataclass
class Model:
    """Sorted n-gram hashes by order with log probabilities and back-off weights (n-grams x languages)."""

    keys: list[np.ndarray]
    logp: list[np.ndarray]
    back: list[np.ndarray]
    languages: tuple[str, ...] = LANGUAGES
    temperature: float = 1.0
    worst: np.ndarray = field(default_factory=lambda: np.array(np.inf, np.float32))

    def _logp(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log probability of each character and of the end under each language, owner) of all texts, one after another."""
        order = len(self.keys)
        grams, counts, owner = gram_hashes(texts, order)
        at = np.flatnonzero(counts)
        total = np.zeros((len(at), len(self.languages)), np.float32)
        left = np.arange(len(at))
        for m in range(order, 0, -1):
            place = at[left]
            row, hit = _find(self.keys[m - 1], grams[m - 1][place])
            total[left[hit]] += self.logp[m - 1][row[hit]]
            left = left[~hit]
            if m > 1 and len(left):
                row, known = _find(self.keys[m - 2], grams[m - 2][at[left] - 1])
                total[left[known]] += self.back[m - 2][row[known]]
        total[left] += np.float32(-np.log(1000.0))  # a character no language has
        return total, owner[at]

    def cross_entropy(self, texts: list[str]) -> np.ndarray:
        """Nats a character of each text under each language."""
        if not texts:
            return np.zeros((0, len(self.languages)), np.float32)
        total, own = self._logp(texts)
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        sums = np.add.reduceat(total, starts, axis=0)
        return -sums / np.diff(np.append(starts, len(own)))[:, None]

    def changes(self, texts: list[str]) -> list[list[int]]:
        """For each text the words, by number, at which its language changes: the likeliest course of languages over its words,
        where a change costs `SWITCH` calibrated nats; parts of fewer than `MIN_WORDS` words go with their neighbour."""
        if not texts:
            return []
        total, own = self._logp(texts)
        starts = np.append(np.flatnonzero(np.diff(own, prepend=-1)), len(own))
        cost, out = SWITCH * max(self.temperature, 1.0), []
        for text, lo, hi in zip(texts, starts, starts[1:]):
            blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32) + 1
            by_word = np.add.reduceat(total[lo:hi], np.append(0, blanks), axis=0)
            if by_word.max(1).sum() - by_word.sum(0).max() <= cost:
                out.append([])  # no course of languages can pay for a change
                continue
            best, came = by_word[0], []
            for w in by_word[1:]:
                top = int(best.argmax())
                jump = best[top] - cost
                came.append(np.where(best >= jump, np.arange(len(best)), top))
                best = np.maximum(best, jump) + w
            course = [int(best.argmax())]
            for c in reversed(came):
                course.append(int(c[course[-1]]))
            course.reverse()
            cuts = [i for i in range(1, len(course)) if course[i] != course[i - 1]]
            kept = []
            for c in cuts:
                if c - (kept[-1] if kept else 0) >= MIN_WORDS and len(course) - c >= MIN_WORDS:
                    kept.append(c)
            out.append(kept)
        return out

    def classify(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(column of the language or -1 where rejected, confidence) of each text."""
        ce = self.cross_entropy(texts)
        best = ce.argmin(1) if len(ce) else np.empty(0, int)
        lengths = np.array([min(len(t), 60) + 1 for t in texts], float)
        score = -(ce - ce.min(1, keepdims=True)) * lengths[:, None] / self.temperature if len(ce) else ce
        p = np.exp(score)
        sure = p.max(1) / p.sum(1) if len(ce) else np.empty(0)
        rejected = ce[np.arange(len(ce)), best] > np.broadcast_to(self.worst, len(self.languages))[best] if len(ce) else np.empty(0, bool)
        return np.where(rejected, -1, best), np.where(rejected, 0.0, sure)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row = np.searchsorted(keys, wanted)
    row[row == len(keys)] = 0
    return row, keys[row] == wanted


def _kneser_ney(texts: list[str], labels: np.ndarray, order: int = ORDER, languages: tuple[str, ...] = LANGUAGES) -> Model:
    """The models of `texts` (plain), each of the language at its place in `labels`."""
    width = len(languages)
    grams, counts, owner = gram_hashes(texts, order)
    at = np.flatnonzero(counts)
    lang = labels[owner[at]]
    unique, first, inverse = zip(*(np.unique(g[at], return_index=True, return_inverse=True) for g in grams))
    tally: list[np.ndarray] = [None] * order  # type: ignore[list-item]
    tally[-1] = np.bincount(inverse[-1] * width + lang, minlength=len(unique[-1]) * width).reshape(-1, width).astype(float)
    for m in range(order - 1, 0, -1):  # continuation counts of the m-grams: different characters before them
        suffix = inverse[m - 1][first[m]]
        tally[m - 1] = np.zeros((len(unique[m - 1]), width))
        np.add.at(tally[m - 1], suffix, (tally[m] > 0).astype(float))
    logp, back = [], []
    lower = np.full((1, width), 1 / 1000.0)
    for m in range(1, order + 1):
        c = tally[m - 1]
        ones, twos = (c == 1).sum(0), (c == 2).sum(0)
        discount = np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.1, 0.9)
        if m == 1:
            context, n_contexts = np.zeros(len(c), int), 1
            known = np.ones(len(c), bool)
            below = np.zeros(len(c), int)
        else:
            context, known = _find(unique[m - 2], grams[m - 2][at[first[m - 1]] - 1])
            n_contexts = len(unique[m - 2])
            below = inverse[m - 2][first[m - 1]]
        total, kinds = np.zeros((n_contexts, width)), np.zeros((n_contexts, width))
        np.add.at(total, context[known], c[known])
        np.add.at(kinds, context[known], (c[known] > 0).astype(float))
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        if m > 1:
            back.append(np.log(weight).astype(np.float32))
        w = np.where(known[:, None], weight[context], 1.0)
        share = np.where(known[:, None] & (total[context] > 0), np.maximum(c - discount, 0) / np.maximum(total[context], 1), 0.0)
        lower = share + w * lower[below]
        logp.append(np.log(np.maximum(lower, 1e-12)).astype(np.float32))
    return Model(list(unique), logp, back, languages)


def _by_frequency(texts: list[str], votes: np.ndarray) -> np.ndarray:
    """The language of each text by the frequencies of its trigrams under the votes of all texts."""
    grams, counts, owner = gram_hashes(texts, 3)
    at = np.flatnonzero(counts)
    unique, gram = np.unique(grams[2][at], return_inverse=True)
    tally = np.full((len(unique), votes.shape[1]), 0.5)
    np.add.at(tally, gram, votes[owner[at]])
    logp = np.log(tally / tally.sum(0))
    score = np.zeros((len(texts), votes.shape[1]))
    np.add.at(score, owner[at], logp[gram])
    return score.argmax(1)


def train(texts: list[str], labels: list[int], order: int = ORDER, languages: Sequence[str] = LANGUAGES) -> Model:
    """Models of labelled texts whose labels may be wrong and whose sentences may be mixed.

    A sentence that occurs several times takes the label it has most often (the first in order among equals),
    and counts once, with and without its accents. Sentences that trigram frequencies give another language
    than their label are dropped first: a few mislabelled sentences weigh little in frequencies, while
    an n-gram model would learn them by heart. A tenth is
    held out to calibrate temperature and rejection.
    """
    languages, votes = tuple(languages), {}
    for t, y in zip(texts, labels):
        for s, e in segments_of(t):
            p = plain(t[s:e])
            if p.count(" ") + 1 >= MIN_WORDS:
                votes.setdefault(p, [0] * len(languages))[y] += 1
    if not votes:
        flat = np.zeros((1, len(languages)), np.float32)
        # Nothing was learnt: every text is rejected.
        return Model([np.zeros(1, np.uint64)] * order, [flat] * order, [flat] * (order - 1), languages, worst=np.full(len(languages), -np.inf, np.float32))
    parts, ys = list(votes), np.array([v.index(max(v)) for v in votes.values()])

    def fit(pick: np.ndarray) -> Model:
        chosen = [parts[i] for i in pick]
        flat = [unaccented(p) for p in chosen]
        both = chosen + [f for f, p in zip(flat, chosen) if f != p]
        y = np.concatenate([ys[pick], ys[pick][[f != p for f, p in zip(flat, chosen)]]])
        return _kneser_ney(both, y, order, languages)

    right = np.flatnonzero(_by_frequency(parts, np.array(list(votes.values()))) == ys)
    model = fit(right)
    place = np.zeros(len(right), int)  # of each sentence among those of its language
    for k in range(len(languages)):
        place[ys[right] == k] = np.arange((ys[right] == k).sum())
    held = right[place % 10 == 1]
    if len(held):
        judge = fit(right[place % 10 != 1])
        ce = judge.cross_entropy([parts[i] for i in held])
        n = np.array([min(len(parts[i]), 60) + 1 for i in held], float)
        best_t, best_loss = 1.0, np.inf
        for t in (0.5, 1, 2, 4, 8, 16, 32):
            z = -(ce - ce.min(1, keepdims=True)) * n[:, None] / t
            loss = -(z[np.arange(len(z)), ys[held]] - np.log(np.exp(z).sum(1))).mean()
            if loss < best_loss:
                best_t, best_loss = float(t), loss
        model.temperature = best_t
        own = ce[np.arange(len(ce)), ys[held]]
        # Rejection: one nat a character above what nearly all held-out sentences of the language need.
        model.worst = np.array(
            [np.quantile(own[ys[held] == k], 0.999) + 1.0 if (ys[held] == k).any() else np.inf for k in range(len(languages))], np.float32
        )
    return model


class Detector:
    """Languages of texts, with a memory of segments met before."""

    def __init__(self, model: Model, within: bool = False):
        self.model, self.within = model, within
        self.known: dict[str, tuple[int, float]] = {}

    def batch(self, texts: list[str | None]) -> list[list[tuple[int, int, int, float]]]:
        """For each text its sentences: (start, end, column of the language or -1, confidence)."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        cut: list[list[tuple[int, int, str]]] = []
        new: dict[str, None] = {}
        for t in texts:
            parts = []
            if t:
                for s, e in segments_of(t):
                    p = plain(t[s:e])
                    if p.count(" ") + 1 >= MIN_WORDS:
                        parts.append((s, e, p))
                if not parts and len(t.split()) >= MIN_WORDS and (p := plain(t)).count(" ") + 1 >= MIN_WORDS:
                    # Short segments only: they are judged joined, as one. An apostrophe makes no word more.
                    lead = len(t) - len(t.lstrip())
                    parts.append((lead, len(t.rstrip()), p))
            cut.append(parts)
        if self.within:
            cut = self._cut_within(texts, cut)
        for parts in cut:
            new.update((p, None) for *_, p in parts if p not in known)
        fresh = list(new)
        for i in range(0, len(fresh), 2000):
            some = fresh[i : i + 2000]
            known.update(zip(some, zip(*(x.tolist() for x in self.model.classify(some)))))
        return [[(s, e, *known[p]) for s, e, p in parts] for parts in cut]


    def _cut_within(self, texts: list[str | None], cut: list[list[tuple[int, int, str]]]) -> list[list[tuple[int, int, str]]]:
        """The parts cut again where their language changes between two words."""
        long = list(dict.fromkeys(p for parts in cut for *_, p in parts if p.count(" ") + 1 >= 2 * MIN_WORDS))
        changes: dict[str, list[int]] = {}
        for i in range(0, len(long), 2000):
            changes.update(zip(long[i : i + 2000], self.model.changes(long[i : i + 2000])))
        out = []
        for t, parts in zip(texts, cut):
            finer = []
            for s, e, p in parts:
                starts = [m.start() for m in _WORD.finditer(t, s, e)] if changes.get(p) else []
                if len(starts) != p.count(" ") + 1:  # one language, or lower case has other words
                    finer.append((s, e, p))
                    continue
                bounds = [s, *(starts[c] for c in changes[p]), e]
                finer += [(a, b, plain(t[a:b])) for a, b in zip(bounds, bounds[1:])]
            out.append(finer)
        return out


def train_on(df: DataFrame, key: str, text: str, label: str, rows: int = TRAIN_ROWS, languages: Sequence[str] = LANGUAGES) -> Model:
    """Models from the labelled rows of `df`, on a sample of at most `rows` texts by hash of the key."""
    labelled = df.select(
        F.xxhash64(key).alias("h"), F.col(text).alias("t"), label_language(F.col(label), languages).alias("y")
    ).filter((F.length("t") > 0) & F.col("y").isNotNull())
    total = labelled.count()
    # A fifth more than asked for may pass the bound; the lowest hashes of them are taken.
    got = labelled.filter(F.col("h") <= hash_below(1.2 * rows, total)).orderBy("h", "t").limit(rows).toArrow()
    return train(got.column("t").to_pylist(), [list(languages).index(y) for y in got.column("y").to_pylist()], languages=languages)


_PARTS = "array<struct<start:int,length:int,language:string,confidence:double>>"


def with_languages(df: DataFrame, text: str, to: str, model: Model, within: bool = False) -> DataFrame:
    """`df` with the sentences of `text` and their languages in a new column `to`.

    `to` is an array of (start, length, language, confidence): sentences of at least `MIN_WORDS` words in
    order, or the whole text where it has as many words but no such sentence; language is null where no
    language fits. With `within`, a sentence that changes its language between two words gives a part for each. Null, empty and blank texts and shorter ones give an empty array. Narrow: the model, of bounded size, is broadcast. `to` must be new.
    """
    if to in df.columns:
        raise ValueError(f"column {to} is there already")
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = df.select("*", F.lit(None).cast(_PARTS).alias(to)).schema
    inner = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("language", pa.string()), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(sent.value, within)
        names = [*detector.model.languages, None]
        for b in batches:
            found = detector.batch(b.column(text).to_pylist())
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = [p for parts in found for p in parts]
            values = pa.StructArray.from_arrays(
                [
                    pa.array([s for s, *_ in flat], pa.int32()),
                    pa.array([e - s for s, e, *_ in flat], pa.int32()),
                    pa.array([names[k] for _, _, k, _ in flat], pa.string()),
                    pa.array([c for *_, c in flat], pa.float64()),
                ],
                fields=list(inner),
            )
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends), values)], names=[*b.schema.names, to])

    return df.mapInArrow(run, schema)


def languages_of(parts: Column) -> Column:
    """The different languages of a column made by `with_languages`."""
    return F.array_distinct(F.filter(F.transform(parts, lambda p: p["language"]), lambda x: x.isNotNull()))


def mislabelled(label: Column, languages: Column, known: Sequence[str] = LANGUAGES) -> Column:
    """True where a text has a language, and its label names none, another one, or the text has several."""
    named = label_language(label, known)
    return (F.size(languages) > 0) & (named.isNull() | (F.size(languages) > 1) | ~F.coalesce(F.array_contains(languages, named), F.lit(False)))
