"""Leaked passages and source mixtures."""

import random
import re

import pytest

from readloom.llm import tokens
from readloom.llm.leakage import contained_items, leaked_items
from readloom.llm.mixture import Mixture, plan_flow

DOCS = "doc_id long, text string, item_id string, words int"


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


def spoken(t):
    lines = t.split("\n")
    keep = [x for i, x in enumerate(lines) if "-->" not in x and not (re.fullmatch("[0-9]+\r?", x) and i + 1 < len(lines) and "-->" in lines[i + 1])]
    return re.sub(r"\{[^}]*\}", " ", re.sub("<[^>]*>", " ", "\n".join(keep)))


def plain(docs, items, size=8):
    index = {}
    for i, t in items:
        w = words(t or "")
        for k in range(len(w) - size + 1):
            index.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = {}
    for d, t in docs:
        w = words(spoken(t or ""))
        for p in {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}:
            for i in index.get(p, ()):
                out.setdefault((d, i), set()).add(p)
    return {k: len(v) for k, v in out.items()}


def subtitle(rng, text):
    w = text.split()
    out, n = [], 1
    while w:
        k = rng.randint(2, 9)
        line = " ".join(w[:k])
        w = w[k:]
        out.append(f"{n}\n00:00:0{n % 10},000 --> 00:00:09,000\n" + rng.choice([line, f"<i>{line}</i>", "{\\an8}" + line.upper(), line.replace(" ", "\n", 1)]))
        n += 1
    return rng.choice(["\n\n", "\r\n\r\n"]).join(out).replace("\n", rng.choice(["\n", "\r\n"])).replace("\r\r", "\r")


@pytest.mark.parametrize("seed", range(2))
def test_leaks_equal_a_plain_search(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["Été", "ΣΊΓΜΑ", "don’t"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([5, 8, 12, 30])))) for i in range(25)] + [(98, None), (99, "")]
    items.append((100, items[3][1]))
    docs = []
    for d in range(60):
        body = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            w = rng.choice(items[:25])[1].split()
            k = rng.randint(0, max(0, len(w) - 8))
            body[5:5] = w[k : k + rng.randint(6, 20)]
        docs.append((d, subtitle(rng, " ".join(body))))
    docs += [(200, None), (201, ""), (202, "5\n5 --> 6\n"), docs[0], (203, items[4][1]), (203, items[5][1]), (203, f"w1 {items[4][1]}")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], DOCS).repartition(4)
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in leaked_items(df, it).collect():
        got[r["doc_id"], r["item_id"]] = r
    want = plain(docs, items)
    assert {k: r["n_passages"] for k, r in got.items()} == want and want
    assert all(0 < r["containment"] <= 1 for r in got.values())
    own = plain([(i, t) for i, t in items], items, 5)
    for threshold in (0.3, 0.8, 1.0):
        shared = {k: n for k, n in plain(docs, items, 5).items() if n >= threshold * own[k[1], k[1]] - 1e-9}
        found = contained_items(df, it, threshold).collect()
        assert {(r["doc_id"], r["item_id"]): r["n_shared"] for r in found} == shared and shared


def test_leaks_of_nothing(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i", "x", 1)], DOCS)
    it = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert leaked_items(df, it).count() == 1
    assert contained_items(df, it).count() == 1 and contained_items(df.limit(0), it).collect() == [] == contained_items(df, it.limit(0)).collect()
    assert leaked_items(df.limit(0), it).collect() == [] and leaked_items(df, it.limit(0)).collect() == []
    long = " ".join(f"x{i}" for i in range(200_000)) + " a b c d e f g h"
    assert leaked_items(spark.createDataFrame([(1, long, "x", 1)], DOCS), it).count() == 1


def test_flow_fills_quotas_and_spreads_repeats():
    supply = [("a", "a", 100), ("a|b", "a", 50), ("a|b", "b", 50), ("b", "b", 10)]
    routed, quota = plan_flow(supply, [("a", 0.5, 1), ("b", 0.5, 2)])
    assert sum(f for (_, s), f in routed.items() if s == "a") == pytest.approx(quota["a"])
    assert sum(f for (_, s), f in routed.items() if s == "b") == pytest.approx(quota["b"])
    assert routed["a", "a"] == pytest.approx(100) and routed["a|b", "b"] <= 100
    routed, quota = plan_flow(supply, [("a", 0.9, 1), ("b", 0.1, 1)])
    assert sum(f for (_, s), f in routed.items() if s == "a") == pytest.approx(150) and quota["a"] > 150


TARGETS = "source string, target_share double, max_repeats int"
MIX = "doc_id long, source string, text string, tokens string, bucket int"


def corpus(rng):
    docs = []
    for i in range(400):
        s = rng.choice(["A ", "a", "a", "b", "C", None, "other"])
        docs.append((i, s, rng.choice([None, "", "same text in several places", " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(1, 40)))]), "x", 1))
    return docs


def test_mixture_holds_its_shares(spark):
    docs = corpus(random.Random(2))
    df = spark.createDataFrame(docs, MIX).repartition(3)
    t = spark.createDataFrame([("a", 0.5, 1), ("B", 0.3, 3), ("c", 0.2, 2), ("d", 0.0, 1)], TARGETS)
    m = Mixture(df, t, balanced=True)
    shares = {r["source"]: r for r in m.shares().collect()}
    for s, want in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert shares[s]["actual_share"] == pytest.approx(want, abs=0.02)
    drawn = m.documents().collect()
    most = {"a": 1, "b": 3, "c": 2}
    assert len({r["doc_id"] for r in drawn}) == len(drawn) and all(0 < r["repeats"] <= most[r["source"]] for r in drawn)
    by_id = {d[0]: d for d in docs}
    assert all(r["tokens"] == tokens.count(by_id[r["doc_id"]][2] or "") and by_id[r["doc_id"]][1].strip().lower() == r["source"] for r in drawn)
    again = Mixture(df.repartition(7), t, balanced=True).documents().collect()
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, again))
    assert m.unreachable().collect() == []
    longest = {s: max(tokens.count(d[2] or "") for d in docs if d[1] and d[1].strip().lower() == s) for s in "abc"}
    assert all(-1 <= shares[s]["missed"] < longest[s] == shares[s]["longest"] for s in "abc")


def test_small_sources_are_repeated(spark):
    rng = random.Random(4)
    docs = [(i, "big", " ".join(rng.choice(["alpha", "beta"]) for _ in range(rng.randint(5, 60))), "x", 1) for i in range(300)]
    docs += [(1000 + i, "small", docs[i][2] if i % 2 else f"gamma {i} delta", "x", 1) for i in range(40)]
    df = spark.createDataFrame(docs, MIX)
    have = {s: sum(tokens.count(d[2]) for d in docs if d[1] == s) for s in ("big", "small")}
    share = 2.5 * have["small"] / sum(have.values())
    t = spark.createDataFrame([("big", 1 - share, 1), ("small", share, 4)], TARGETS)
    for balanced in (False, True):
        got = {r["source"]: r for r in Mixture(df, t, balanced=balanced).shares().collect()}
        assert got["small"]["most_repeats"] == 3 and got["big"]["most_repeats"] == 1 and got["small"]["reachable"]
        assert all(-1 <= r["missed"] < r["longest"] for r in got.values())
    few = {r["source"]: r for r in Mixture(df, spark.createDataFrame([("big", 0.2, 1), ("small", 0.8, 2)], TARGETS)).shares().collect()}
    assert not few["small"]["reachable"] and few["small"]["tokens_drawn"] == 2 * have["small"] and few["small"]["most_repeats"] == 2


def test_tokens_of_long_texts():
    rng, e = random.Random(1), tokens.encoder()
    for _ in range(20):
        t = "".join(rng.choice(["ab", " ", "\n", "\u3000", " 12", "'s", "!?", "\xa0", "\x1c", "é"]) * rng.choice([1, 1, 2, 12_000]) for _ in range(12))
        assert tokens.count(t) == len(e.encode_ordinary(t))
    assert tokens.count(" " * 2_000_000 + "a") > 0 and tokens.count("a" * 1_000_000) > 0


def test_unreachable_sources(spark):
    docs = corpus(random.Random(3))
    df = spark.createDataFrame(docs, MIX)
    t = spark.createDataFrame([("a", 0.1, 1), ("b", 0.7, 2), ("c", 0.1, 1), ("d", 0.1, 5)], TARGETS)
    have = {s: sum(tokens.count(d[2] or "") for d in docs if d[1] and d[1].strip().lower() == s) for s in "abcd"}
    total = sum(have.values())
    want = {s for s, share, r in (("a", 0.1, 1), ("b", 0.7, 2), ("c", 0.1, 1), ("d", 0.1, 5)) if have[s] * r < share * total}
    m = Mixture(df, t)
    assert {r[0] for r in m.unreachable().collect()} == want and "d" in want
    assert {r["source"] for r in m.shares().where("not reachable").collect()} == want


def test_empty_mixture(spark):
    df = spark.createDataFrame(corpus(random.Random(1)), MIX).limit(0)
    t = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    m = Mixture(df, t)
    assert m.documents().collect() == [] and m.unreachable().collect() == [] and m.shares().count() == 1
