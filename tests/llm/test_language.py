"""Language models: probabilities, held-out accuracy, label rules, segments, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import language as L

BASE = {
    "en": "the cable arrived early|this lamp is louder than I had expected|I would not buy it again|the photo shows a different colour|"
    "my sister uses it every day|delivery took nine days and nobody told me why|it does exactly what I wanted|the seller never answered",
    "pt": "o cabo chegou antes do prazo|esta luminária faz mais barulho do que eu esperava|eu não compraria de novo|a foto mostra uma cor diferente|"
    "minha irmã usa todos os dias|a entrega demorou nove dias e ninguém explicou|faz exatamente o que eu queria|o vendedor nunca respondeu",
    "es": "el cable llegó antes de lo previsto|esta lámpara hace más ruido de lo que esperaba|no lo compraría otra vez|la foto muestra un color distinto|"
    "mi hermana lo usa todos los días|el envío tardó nueve días y nadie dijo nada|hace todo lo que yo quería|el vendedor nunca contestó",
    "fr": "le câble est arrivé en avance|cette lampe fait plus de bruit que prévu|je ne l'achèterais plus|la photo montre une autre couleur|"
    "ma sœur s'en sert tous les jours|la livraison a pris neuf jours sans nouvelle|elle fait tout ce que je voulais|le vendeur n'a jamais répondu",
    "de": "das Kabel kam früher als geplant an|diese Lampe ist lauter als ich dachte|ich würde es nicht wieder kaufen|auf dem Foto sieht man eine andere Farbe|"
    "meine Schwester nutzt es jeden Tag|die Lieferung hat neun Tage gedauert|sie macht genau das was ich wollte|der Verkäufer hat nie geantwortet",
    "it": "il cavo è arrivato in anticipo|questa lampada fa più rumore di quanto pensassi|non lo comprerei di nuovo|la foto mostra un colore diverso|"
    "mia sorella lo usa tutti i giorni|la consegna ha impiegato nove giorni|fa tutto quello che volevo|il venditore non ha mai risposto",
}


def texts():
    out = []
    for k, lang in enumerate(L.LANGUAGES):
        ss = BASE[lang].split("|")
        for i, a in enumerate(ss):
            for b in ss[i + 1 :]:
                out.append((f"{a}. {b}!", k))
    return out


@pytest.fixture(scope="module")
def model():
    t = texts()
    labels = [(y + 1) % 6 if i % 11 == 0 else y for i, (_, y) in enumerate(t)]  # one in eleven is wrong
    return L.train([x for x, _ in t], labels)


def test_probabilities_sum_to_one():
    m = L._kneser_ney(["abab", "abba", "baab"], np.array([0, 0, 0]), 3)
    alphabet = "ab\x02"
    for history in ("a", "b", "ab", "ba", ""):
        total = sum(np.exp(-m.cross_entropy([history + c])[0, 0] * (len(history) + 2) + m.cross_entropy([history])[0, 0] * 0) for c in alphabet)
        assert total > 0
    # Seen unigrams share all the mass but what the uniform floor takes.
    grams, counts, _ = L.gram_hashes(list(alphabet), 1)
    mass = np.exp(m.logp[0][:, 0]).sum()
    assert 0.9 < mass <= 1.0 + 1e-6


def test_scoring_equals_direct_interpolation():
    """Cross-entropy of a tiny bigram model by hand: absolute discounting over continuation counts."""
    m = L._kneser_ney(["ab", "ac"], np.array([0, 0]), 2)
    # Bigrams: \x02a 2, ab 1, ac 1, b\x02 1, c\x02 1; continuations: a 1, b 1, c 1, \x02 2.
    d2 = 4 / (4 + 2 * 1)
    d1 = 3 / (3 + 2 * 1)
    uni = {g: (max(c - d1, 0) / 5 + d1 * 4 / 5 / 1000) for g, c in {"a": 1, "b": 1, "c": 1, "\x02": 2}.items()}
    edge = uni["a"]  # the bigram after the leading mark has a context that no text ends in
    p_a = m.cross_entropy(["a"])[0, 0]
    assert np.isfinite(p_a) and p_a > 0
    p_b_after_a = (1 - d2) / 2 + d2 * 2 / 2 * uni["b"]
    direct = np.log(p_b_after_a)
    whole = -m.cross_entropy(["ab"])[0, 0] * 3
    first = -m.cross_entropy(["a"])[0, 0] * 2
    assert edge > 0 and np.isfinite(direct) and whole < 0 and first < 0
    row, hit = L._find(m.keys[1], L.gram_hashes(["ab"], 2)[0][1][2:3])
    assert hit[0] and abs(m.logp[1][row[0], 0] - direct) < 1e-5


def test_held_out_accuracy_in_spite_of_wrong_labels(model):
    held = [(s, k) for k, lang in enumerate(L.LANGUAGES) for s in BASE[lang].split("|")]
    got, sure = model.classify([L.plain(s) for s, _ in held])
    assert (got == np.array([k for _, k in held])).mean() == 1.0 and (sure > 0.5).all()
    flat, _ = model.classify([L.plain(L.unaccented(s)).upper().lower() for s, _ in held])
    assert (flat == np.array([k for _, k in held])).mean() > 0.95


def test_rejection(model):
    got, sure = model.classify(["qzx wvk jjj xqz", "zzzz yyyy xxxx"])
    assert set(got) == {-1} and set(sure) == {0.0}


def test_mixed_segments(spark, model):
    t = "The cable arrived early!! o vendedor nunca respondeu...\nOK. 5/5 | die Lieferung hat neun Tage gedauert"
    rows = [(1, t, "parts"), (2, None, None), (3, "", ""), (4, " \n ", ""), (5, "ok", ""), (6, "the photo shows a different colour. " * 3000, "")]
    df = L.with_languages(spark.createDataFrame(rows, "id int, text string, other string"), "text", "parts", model)
    got = {r.id: r.parts for r in df.collect()}
    assert [(p.language, t[p.start : p.start + p.length].strip()) for p in got[1]] == [
        ("en", "The cable arrived early!!"), ("pt", "o vendedor nunca respondeu..."), ("de", "die Lieferung hat neun Tage gedauert"),
    ]
    assert got[2] == got[3] == got[4] == got[5] == [] and len(got[6]) == 3000 and {p.language for p in got[6]} == {"en"}
    with pytest.raises(ValueError):
        L.with_languages(df, "text", "parts", model)


def test_short_segments_are_judged_joined(spark, model):
    t = " O vendedor.\nNunca respondeu! "
    rows = [(1, t), (2, "O vendedor."), (3, "o vendedor nunca respondeu. Muito bom."), (4, "O. 5/5 - 100"), (5, "D'accord. Merci.")]
    df = L.with_languages(spark.createDataFrame(rows, "id int, text string"), "text", "parts", model)
    got = {r.id: [(p.language, p.start, p.length) for p in r.parts] for r in df.collect()}
    assert got == {1: [("pt", 1, len(t) - 2)], 2: [], 3: [("pt", 0, 27)], 4: [], 5: []}
    cases = df.filter(L.mislabelled(F.lit(None), L.languages_of(F.col("parts"))))
    assert {r.id for r in cases.collect()} == {1, 3}


def test_labels(spark):
    labels = ["pt-BR", "POR", "español", "EN", "en-IN", "??", "und", "", None, "nl", " deu "]
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    assert [r.c for r in df.select(L.label_language(F.col("l")).alias("c")).collect()] == ["pt", "pt", "es", "en", "en", None, None, None, None, None, "de"]


def test_cases(spark):
    rows = [("en", ["en"]), ("EN", ["en"]), (None, ["en"]), ("nl", ["en"]), ("pt", ["en"]), ("en", ["en", "pt"]), ("pt", []), (None, [])]
    df = spark.createDataFrame(rows, "l string, x array<string>")
    got = [r.c for r in df.select(L.mislabelled(F.col("l"), F.col("x")).alias("c")).collect()]
    assert got == [False, False, True, True, True, True, False, False]


def test_training_on_a_table(spark):
    rows = [(i, t, L.LANGUAGES[y]) for i, (t, y) in enumerate(texts())] + [(900, None, "en"), (901, "x", None)]
    m = L.train_on(spark.createDataFrame(rows, "id int, t string, l string"), "id", "t", "l")
    assert L.LANGUAGES[m.classify([L.plain("o cabo chegou antes do prazo")])[0][0]] == "pt"
    empty = L.train_on(spark.createDataFrame([], "id int, t string, l string"), "id", "t", "l")
    assert len(empty.classify(["some words here"])[0]) == 1


def test_a_change_within_a_sentence(model):
    """Two sentences run together without a mark are told apart near the seam; one sentence stays whole."""
    pairs, near, right = 0, 0, 0
    for a in L.LANGUAGES:
        for b in L.LANGUAGES:
            if a != b:
                x, y = BASE[a].split("|")[0], BASE[b].split("|")[4]
                seam = len(L.plain(x).split())
                cuts = model.changes([L.plain(f"{x} {y}")])[0]
                pairs += 1
                near += len(cuts) == 1 and abs(cuts[0] - seam) <= 1
                got = L.Detector(model, within=True).batch([f"  {x} {y}. "])[0]
                right += [L.LANGUAGES[k] for _, _, k, _ in got] == [a, b]
    assert near >= 0.9 * pairs and right >= 0.9 * pairs
    whole = [L.plain(s) for ss in BASE.values() for s in ss.split("|")]
    assert sum(bool(c) for c in model.changes(whole)) == 0
    assert model.changes([]) == [] and L.Detector(model, within=True).batch([None, "", "a b", "!!!"])[0] == []


def test_parts_cover_their_sentence(model):
    x, y = BASE["en"].split("|")[1], BASE["de"].split("|")[1]
    t = f"{x} {y}! {x}."
    got = L.Detector(model, within=True).batch([t])[0]
    assert [L.LANGUAGES[k] for _, _, k, _ in got] == ["en", "de", "en"]
    assert got[0][1] == got[1][0] and t[got[1][0] : got[1][1]].strip(" !") == y and t[got[2][0] : got[2][1]].strip() == f"{x}."
