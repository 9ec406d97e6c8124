"""Misread text: planted damage must be found and undone, clean text left alone."""

import random

import pytest

from readloom.llm import encoding as en

SAYINGS = {
    "fr": "J’ai prévenu le frère à côté du château, déjà très tôt… la fenêtre brûlée où ça va être ♪",
    "ru": "Мой брат знает чужой сон у реки, никто не слышал тяжёлый чемодан вчера вечером — всегда тихо",
    "cs": "Nemůžu najít těžký kufr pozdě večer, někdo čeká příliš často u řeky, můj přítel zná bílého koně",
    "el": "Δεν βρήκαμε τον αδελφός μου ξέρει βαριά βαλίτσα αύριο βράδυ στο ποτάμι κίτρινη βάρκα",
    "pl": "Będzie książki całą noc, ktoś śledzi pół świata, chciałbym żółtą łódź dość często później więc",
    "en": "It wasn’t the second half of the money — we’re waiting for “no answer” at the café…",
}
TRAPS = ["Ð and Þ are old letters.", "√2 is about 1.41", "© ® ™ § ¶", "25 °C ± 1", "└── é ──┘", "IRMÃ… À CÔTÉ", "naïve, façade, Ångblad", "Œuvre n° 7 – «\xa0fin\xa0»"]


def text(rng, lang, lines=12):
    w = SAYINGS[lang].split()
    return "\n".join(" ".join([*rng.sample(w, 5), "Zubo" + rng.choice("abcde")]) for _ in range(lines))


def misread(s, written, read):
    out = []
    for b in s.encode(written, "replace"):
        ch = bytes([b]).decode(read, "ignore")
        out.append(ch or chr(b))
    return "".join(out)


DAMAGE = {
    "utf8 as cp1252": ("fr", lambda s: misread(s, "utf-8", "cp1252")),
    "utf8 as latin-1": ("en", lambda s: misread(s, "utf-8", "latin-1")),
    "utf8 as cp1251": ("en", lambda s: misread(s, "utf-8", "cp1251")),
    "utf8 as mac": ("ru", lambda s: misread(s, "utf-8", "mac_roman")),
    "utf8 as cp437": ("fr", lambda s: misread(s, "utf-8", "cp437")),
    "twice": ("cs", lambda s: misread(misread(s, "utf-8", "cp1252"), "utf-8", "cp1252")),
    "cp1250 as cp1252": ("pl", lambda s: misread(s, "cp1250", "cp1252")),
    "latin2 as latin1": ("cs", lambda s: misread(s, "iso8859_2", "latin-1")),
    "cp1251 as cp1252": ("ru", lambda s: misread(s, "cp1251", "cp1252")),
    "koi8 as cp1251": ("ru", lambda s: misread(s, "koi8_r", "cp1251")),
    "cp1253 as cp1252": ("el", lambda s: misread(s, "cp1253", "cp1252")),
    "lossy": ("cs", lambda s: s.encode("cp1250").decode("utf-8", "replace")),
}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    docs = [(i, text(rng, lang)) for i, lang in enumerate(list(SAYINGS) * 50)]
    docs += [(1000 + i, t + "\n" + text(rng, "en")) for i, t in enumerate(TRAPS * 6)]
    clean = {i for i, _ in docs}
    truth = {}
    for k, (lang, f) in enumerate(DAMAGE.values()):
        whole, part = text(rng, lang), text(rng, lang).split("\n")
        truth[2000 + k] = (whole, f(whole))
        truth[3000 + k] = ("\n".join(part), "\n".join([*part[:6], f("\n".join(part[6:9])), *part[9:]]))
    truth[4000] = ("﻿1\nplain", "ï»¿1\nplain")
    docs += [(i, bad) for i, (_, bad) in truth.items()]
    docs += [(5000, None), (5001, ""), (5002, "plain ascii")]
    return docs, clean, truth


def test_found_and_restored(spark, corpus):
    docs, clean, truth = corpus
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, w string, n int").repartition(6)
    got = {r["doc_id"]: r for r in en.misread_documents(df).collect()}
    assert not set(got) & clean
    assert set(got) == {i for i, (good, bad) in truth.items() if good != bad}
    for i, r in got.items():
        good, bad = truth[i]
        want, made, was = good.split(), r["restored"].split(), bad.split()
        if len(want) == len(made) == len(was):
            wrong = [(a, b) for a, b, c in zip(want, made, was) if a != b and a != c]
            damaged = sum(a != c for a, c in zip(want, was))
            assert len(wrong) <= 0.1 * damaged + (0.3 * damaged if "�" in bad else 0), (i, wrong[:5])


def test_lost_bytes_are_filled_from_the_corpus():
    words = {w: -5.0 for w in ("château", "тихо", "à", "frère")}
    d = en.Decoder(words)
    bad = misread("château тихо", "utf-8", "cp1252").replace("\x8f", "").replace("¢", "¢")
    assert d.lossy(bad.split()[0], (("utf_8", "cp1252"),)) == "château"
    gone = "".join(c for c in misread("тихо", "utf-8", "cp1252") if c != "\x85")
    assert d.lossy(gone, (("utf_8", "cp1252"),)) in ("тихо", gone)
    assert d.fill("ch�teau") == "château" and d.fill("CH�TEAU") == "CHÂTEAU" and d.fill("x�x") == "x�x"


def test_nothing_and_endless(spark):
    schema = "doc_id long, text string"
    df = spark.createDataFrame([(1, "é" * 200_000 + "Ã©" * 50_000)], schema)
    assert en.misread_documents(df.limit(0)).collect() == []
    en.misread_documents(df).collect()
    assert en.misread_documents(spark.createDataFrame([(1, "abc"), (2, None)], schema)).collect() == []
