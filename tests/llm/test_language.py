"""Language of texts: fitted with noisy labels, checked on held-out texts."""

import random

import numpy as np
from pyspark.sql import functions as F

from quakeweave.llm import language as G

WORDS = {
    "en": "the station was noisy during night and its clock drifted by several minutes before repair because water entered under cover".split(),
    "es": "la estación estaba ruidosa durante noche y su reloj perdió varios minutos antes de reparación porque agua entró bajo cubierta".split(),
    "de": "die messstelle war während der nacht unruhig und ihre uhr verlor einige minuten vor wartung weil wasser unter den deckel lief".split(),
    "ru": "станция шумела всю ночь и часы отстали на несколько минут перед ремонтом потому что вода попала под крышку снова".split(),
}


def text(r, lang, n=40):
    return " ".join(r.choice(WORDS[lang]) for _ in range(n)) + "."


def corpus(n, wrong=0.1, seed=1):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        lang = list(WORDS)[k % 4]
        rows.append((text(r, lang), lang if r.random() > wrong else r.choice(list(WORDS))))
    return rows


def fitted():
    rows = corpus(240)
    return G.fit([t for t, _ in rows], [x for _, x in rows])


def test_held_out_texts_and_lines():
    f = fitted()
    r = random.Random(9)
    assert f.languages == ["de", "en", "es", "ru"]
    texts = [text(r, lang, n) for lang in WORDS for n in (8, 30, 400)]
    at, number, lang, sure, mixed = G.identify(texts, f)
    assert list(at) == list(range(12)) and list(lang) == [x for x in WORDS for _ in range(3)] and set(number) == {0} and not any(mixed) and min(sure) > 0.2


def test_case_accents_encoding_and_code():
    f = fitted()
    r = random.Random(2)
    es = text(r, "es")
    bare = es.replace("ó", "o").replace("í", "i")
    broken = es.encode().decode("latin-1")
    coded = '{"ev":"ev1","ok":null}\n/data/ev1/X.HNZ.mseed;12\n' + text(r, "de")
    at, number, lang, *_ = G.identify([es.upper(), bare, broken, coded], f)
    assert list(at) == [0, 1, 2, 3] and list(lang) == ["es", "es", "es", "de"] and set(number) == {0}


def test_mixed_lines_are_numbered_without_blank_ones():
    f = fitted()
    r = random.Random(3)
    lines = [text(r, "en", 12), " \t\r", text(r, "ru", 12) + "\r", "", text(r, "en", 12), "12; 0.5"]
    at, number, lang, _, mixed = G.identify(["\n".join(lines)], f)
    assert list(zip(number, lang)) == [(1, "en"), (2, "ru"), (3, "en")] and all(mixed)
    at, number, *_ = G.identify(["\n".join(["12; 0.5", *lines])], f)
    assert list(number) == [2, 3, 4]


def test_texts_without_words():
    assert G.identify(["", None, "12; 0.5\n---", "A1B2 99", "\n\n"], fitted())[0] == ()


def test_short_texts_and_lines_have_a_language():
    f = fitted()
    r = random.Random(6)
    short = {"en": "night repair", "es": "agua", "de": "wartung", "ru": "часы"}
    at, number, lang, sure, mixed = G.identify(list(short.values()), f)
    assert list(at) == [0, 1, 2, 3] and list(lang) == list(short) and set(number) == {0} and not any(mixed)
    assert max(sure) < 1 and sure[0] > sure[1] >= 0
    for other in ("es", "de", "ru"):
        lines = [text(r, "en", 14), short[other], text(r, other, 14), "night", "ox", short[other] + " 12"]
        at, number, lang, sure, mixed = G.identify(["\n".join(lines)], f)
        assert list(number) == [1, 2, 3, 4, 5, 6] and all(mixed)
        assert [lang[k] for k in (0, 1, 2, 3, 5)] == ["en", other, other, "en", other] and lang[4] in ("en", other)
        assert sure[0] > sure[1]


def test_lines_without_known_ngrams_go_by_their_neighbours():
    f = fitted()
    r = random.Random(7)
    at, number, lang, sure, _ = G.identify(["\n".join([text(r, "en", 14), "ζζζ", text(r, "ru", 14), text(r, "ru", 14), "ξξξ", text(r, "ru", 14)]), "ψψψ"], f)
    assert list(lang)[4] == "ru" and lang[1] in ("en", "ru") and max(sure[1], sure[4]) < 0.02
    assert (at[-1], number[-1], lang[-1], sure[-1]) == (1, 0, "und", 0)


def test_filters_tell_all_languages_of_an_ngram():
    f = G.Filters(["a", "b", "c"], 4096)
    keys = np.arange(1, 200, dtype=np.uint64) * np.uint64(7919)
    f.add(keys[:100], 0)
    f.add(keys[50:150], 2)
    f.close()
    assert (f.languages_of(keys[:50])[0] & 1 == 1).all() and (f.languages_of(keys[50:100])[0] & 5 == 5).all()
    miss = f.languages_of(np.arange(10_000, 30_000, dtype=np.uint64) * np.uint64(104729))[0]
    assert abs((miss & 1).mean() - f.false_rate[0]) < 0.01
    total, hits = f.scores(keys[:50], np.zeros(50, int), 1)
    assert total[0] == 50 and hits[0, 0] == 50 and hits[0, 1] == 0


def test_counts_by_mask_equal_plain_counts():
    rng = np.random.default_rng(4)
    line, mask = rng.integers(0, 50, 4_000), rng.integers(1, 1 << 9, 4_000)
    want = np.array([[((line == k) & (mask >> b & 1 == 1)).sum() for b in range(9)] for k in range(50)])
    for kind in (np.uint16, np.uint32, np.uint64):
        for room in (20_000_000, 5_000):
            assert (G.Filters._by_mask(line, mask.astype(kind), 50, 9, room) == want).all()


def test_more_than_64_languages():
    names = [f"l{k:03d}" for k in range(150)]
    f = G.Filters(names, 1 << 15)
    keys = np.arange(1, 150 * 20 + 1, dtype=np.uint64) * np.uint64(7919)
    for k in range(150):
        f.add(keys[20 * k : 20 * k + 20], k)
    f.close()
    line = np.repeat(np.arange(150), 20)
    total, hits = f.scores(keys, line, 150)
    assert (hits.argmax(1) == np.arange(150)).all() and (total == 20).all() and len(f.masks) == 3


def test_language_codes(spark):
    labels = [" EN", "en-US", "English", "eng", "pt_BR", "deu", "German", "es-419", "und", "", None, "n/a", "mul", "unk"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in labels], "l string").select(G.language_code(F.col("l"))).collect()]
    assert got == ["en", "en", "en", "en", "pt", "de", "de", "es", None, None, None, None, None, None]


def test_spark(spark):
    rows = [(k, t, x, "a") for k, (t, x) in enumerate(corpus(200))]
    rows += [(900, None, "en", "a"), (901, "", None, "a"), (901, rows[0][1], "und", "a"), (901, rows[0][1], "und", "a"), (902, rows[1][1] + " " + rows[1][1] * 2_000, None, "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, language string").repartition(3)
    f = G.fit_filters(df, "doc_id", "text", "lang", texts=40)
    got = G.identify_languages(df, "doc_id", "text", f).toPandas()
    assert set(got[got.doc_id == 901].language) == {"en"} and (got.doc_id == 901).sum() == 2 and 900 not in set(got.doc_id)
    assert got[got.doc_id == 902].language.tolist() == ["es"]
    assert all(list(WORDS)[k % 4] == x for k, x in zip(got.doc_id, got.language) if k < 200)
    assert G.identify_languages(df.limit(0), "doc_id", "text", f).count() == 0
    none = G.fit_filters(df.limit(0), "doc_id", "text", "lang")
    assert {tuple(r) for r in G.identify_languages(df, "doc_id", "text", none).select("language", "confidence").collect()} == {("und", 0.0)}
