import random

from hypothesis import given, settings
from hypothesis import strategies as st

from crawlweave.llm import winnow as W

VOCAB = [f"w{k}" for k in range(12)]


def brute(docs, items, span):
    out = set()
    for d, a in docs:
        for i, b in items:
            if d is None or i is None or a is None or b is None:
                continue
            x, y = W.words(a), W.words(b)
            grams = {tuple(y[k : k + span]) for k in range(len(y) - span + 1)}
            if any(tuple(x[k : k + span]) in grams for k in range(len(x) - span + 1)):
                out.add((d, i))
    return sorted(out)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(VOCAB), min_size=12, max_size=40), st.lists(st.sampled_from(VOCAB), max_size=20), st.lists(st.sampled_from(VOCAB), max_size=20), st.integers(0, 20))
def test_any_shared_span_shares_a_fingerprint(text, left, right, at):
    span = text[at % (len(text) - 11) :][:12]
    a, b = W.fingerprints(text, 6, 12), W.fingerprints([*left, *span, *right], 6, 12)
    assert set(a.tolist()) & set(b.tolist())
    assert W.shared_span(text, [*left, *span, *right], 12)[0] >= 12


def test_against_brute_force(spark):
    rnd = random.Random(5)
    say = lambda n: " ".join(rnd.choice(VOCAB) + rnd.choice(["", "a", "b"]) for _ in range(n))
    items = [(k, say(rnd.randrange(5, 40))) for k in range(30)] + [(90, None), (91, ""), (92, "x " * 30)]
    docs = []
    for k in range(150):
        text = say(rnd.randrange(3, 60))
        if k % 3 == 0:
            src = rnd.choice(items[:30])[1].split()
            n, at = rnd.randrange(9, 16), rnd.randrange(0, max(1, len(src) - 9))
            text += ". " + ", ".join(src[at : at + n]).upper() + "! " + say(5)
        docs.append((k, text))
    docs += [(900, None), (901, ""), (902, " \n"), (903, "x, " * 200_000), (None, items[0][1]), docs[0], docs[0]]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "doc_id as fp", "text as passage", "doc_id as item_id", "1 as span")
    e = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "item_id as doc_id", "'x' as lang")
    got = W.leaks(d, e)
    pairs = sorted((r.doc_id, r.item_id) for r in got.collect())
    assert pairs == brute(docs, items, 12) and (903, 92) in pairs
    assert W.leaked_items(got).agg({"docs": "sum"}).first()[0] == len(pairs)


def test_words():
    assert W.words("Ｈel­lo, WORLD—ﬁne x²3 naïve naïve") == ["hello", "world", "fine", "x23", "naïve", "naïve"]


def test_without_broadcast_and_empty(spark, monkeypatch):
    text = " ".join(f"t{k}" for k in range(20))
    d = spark.createDataFrame([(k, text) for k in range(50)], "doc_id bigint, text string")
    e = spark.createDataFrame([(1, text)], "item_id bigint, text string")
    monkeypatch.setattr(W, "small", lambda df: df)
    r = W.leaks(d, e).collect()
    assert len(r) == 50 and all(x.span == 20 and x.item_words == 20 for x in r)
    assert W.leaks(d.limit(0), e).count() == 0 and W.leaks(d, e.limit(0)).count() == 0
