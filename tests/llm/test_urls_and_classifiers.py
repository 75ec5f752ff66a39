import random

import numpy as np
import pytest

from lexiloom.llm import language_id, toxicity
from lexiloom.llm.queries import RULES
from lexiloom.llm.url_filter import MAX_RULES, alias_edges, url_filter


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_rules(spark):
    rows = [
        (1, "http://WWW.Example.NET/en/x?q#f", ""), (2, "http://a.example.net/de/x", ""), (3, "https://example.com/de/", None), (4, "https://notexample.com/de/", ""),
        (5, "http://x.org/fr/y", ""), (6, None, None), (7, "no scheme", ""), (8, "http://net", ""), (9, "http://net?x/", ""), (10, "http://b.net#/", ""), (1, "http://WWW.Example.NET/en/x?q#f", ""),
    ]
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter(pages(spark, rows), RULES).collect()}
    assert out[1] == ("www.example.net", "/en/x", "example.net/en/", "allow")
    assert out[2] == ("a.example.net", "/de/x", "net/", "block")
    assert out[3] == ("example.com", "/de/", "example.com/de/", "block")
    assert out[4] == ("notexample.com", "/de/", None, "allow")
    assert out[5] == ("x.org", "/fr/y", "org/fr/", "allow")
    assert out[6] == out[7] == ("", "", None, "allow")
    assert out[8] == ("net", "", None, "allow") and out[9] == ("net", "", None, "allow") and out[10] == ("b.net", "", None, "allow")


def test_aliases_carry_blocks_and_allows_come_first(spark):
    link = lambda u: f'<html><link rel="canonical" href="{u}"></html>'
    rows = [
        (1, "http://a.io/1", link("http://b.io/1")), (2, "http://b.io/1", '<meta http-equiv="refresh" content="0; url=http://bad.net/x">'),
        (3, "http://c.io/1#top", link("/2")), (4, "http://c.io/2", ""), (5, "http://d.io/1", link("http://e.io/")), (6, "http://f.io/", link("http://e.io/")),
        (7, "http://e.io/", link("http://q.net/z")), (8, "http://g.io/", link("http://h.org/fr/1")), (9, "http://g.io/", link("http://other.net/1")), (10, "http://h.org/fr/1", ""),
    ]
    out = {r.page_id: r.verdict for r in url_filter(pages(spark, rows), RULES).collect()}
    assert [out[i] for i in (1, 2)] == ["block", "block"]
    assert [out[i] for i in (3, 4)] == ["allow", "allow"]
    assert [out[i] for i in (5, 6, 7)] == ["block"] * 3
    assert [out[i] for i in (8, 9, 10)] == ["allow"] * 3
    more = spark.createDataFrame([("http://c.io/2", "http://bad.net/")], "src string, dst string")
    assert {r.page_id: r.verdict for r in url_filter(pages(spark, rows), RULES, redirects=more).collect()}[3] == "block"


def test_edges_and_empty(spark):
    rows = [(1, "http://a.io/x/y?z", "<LINK HREF='../n&amp;m' REL=canonical>"), (2, "http://a.io/", '<a href="/canonical">'), (3, None, "<link rel=canonical href=/x>")]
    assert [(r.src, r.dst) for r in alias_edges(pages(spark, rows)).collect()] == [("http://a.io/x/y?z", "http://a.io/x/../n&m")]
    assert url_filter(pages(spark, []), RULES).count() == 0
    rows = [(1, "http://a.io/", "<link rel=canonical href=http://b.io/><link rel=canonical href=http://bad.net/><meta http-equiv=refresh content='0;url=http://c.io/'>")]
    assert {r.dst for r in alias_edges(pages(spark, rows)).collect()} == {"http://b.io/", "http://bad.net/", "http://c.io/"}
    assert [r.verdict for r in url_filter(pages(spark, rows), RULES).collect()] == ["block"]


def test_many_rules_are_joined_and_say_the_same(spark):
    rng = random.Random(2)
    hosts = ["net", "a.net", "b.a.net", "io", "x.io", "org"]
    rules = [(rng.choice(["block", "allow"]), rng.choice(hosts), rng.choice(["/", "/a", "/a/", "/ab/c", "/é", ""])) for _ in range(60)]
    more = [("block", f"h{i}.com", "/") for i in range(MAX_RULES)]
    rows = [(i, f"http://{rng.choice(['', 'w.'])}{rng.choice(hosts)}{rng.choice(['/', '/a', '/a/b', '/ab/c/d', '/é/f', '?q', ''])}", "") for i in range(300)] + [(900, "http://q.h7.com/z", ""), (901, None, None)]
    few = {r.page_id: (r.rule, r.verdict) for r in url_filter(pages(spark, rows), rules).collect()}
    many = {r.page_id: (r.rule, r.verdict) for r in url_filter(pages(spark, rows), rules + more).collect()}
    assert few.pop(900) == (None, "allow") and many.pop(900) == ("h7.com/", "block") and few == many


def corpus():
    rng = random.Random(6)
    syllables = {"en": ["th", "ing", "ou", "er", "and"], "de": ["sch", "ung", "ei", "ich", "ü"], "fr": ["eau", "é", "que", "oi", "ment"]}
    rows = []
    for i in range(450):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((" ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(8, 60))), lang))
    return rows


def test_language_held_out_accuracy():
    rows = corpus()
    model = language_id.train([t for t, _ in rows[:300]], [y for _, y in rows[:300]])
    p = model.probabilities([t for t, _ in rows[300:]])
    assert np.mean([model.languages[i] == y for i, (_, y) in zip(p.argmax(1), rows[300:], strict=True)]) > 0.97
    assert np.allclose(p.sum(1), 1) and (model.weights == 0).mean() > 0.5
    long = " ".join(t for t, y in rows if y == "de") * 80
    assert len(long) > 1 << 18 and model.languages[model.probabilities([long])[0].argmax()] == "de"


def test_language_documents(spark, odd_documents, no_documents):
    train = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(corpus())] + [(999, None, "en"), (998, "x", None)], "doc_id long, text string, lang string")
    model = language_id.fit_language_model(train)
    out = {r.doc_id: r for r in language_id.identify(odd_documents, model).collect()}
    assert out[3].lang_pred == out[4].lang_pred == out[8].lang_pred == out[9].lang_pred == "und" and out[9].score == 0
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "de", "fr", "und") for r in out.values())
    assert sorted(r.doc_id or 0 for r in language_id.keep_identified(odd_documents, model).collect()) == [0, 1, 2, 2, 5, 6, 7]
    assert language_id.identify(no_documents, model).count() == 0
    df, n = language_id.document_frequencies(train.where("text is not null"))
    texts = [r.text for r in train.collect() if r.text is not None]
    want = np.zeros(len(df), int)
    for t in texts:
        want[language_id.features(t)[0]] += 1
    assert n == len(texts) and (df == want).all()
    with pytest.raises(ValueError):
        language_id.fit_language_model(train, most_languages=2)
    none = language_id.fit_language_model(train.where("false"))
    assert {r.lang_pred for r in language_id.identify(odd_documents, none).collect()} == {"und"}


def toxic_rows():
    rng = random.Random(7)
    word = lambda: "".join(rng.choices(["ra", "to", "li", "men", "sor", "pe", "di"], k=rng.randint(1, 4)))
    rows = []
    for i in range(700):
        words = [word() for _ in range(rng.randint(5, 80))]
        if i % 5 == 0:
            for bad in rng.sample(["blockhead", "nitwit", "scoundrel", "duff" + word(), "duff" + word()], 2):
                words.insert(rng.randrange(len(words) + 1), bad)
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    return rows


def brute_kernel(s, t, order, decay):
    from itertools import combinations

    total = 0.0
    for a in combinations(range(len(s)), order):
        for b in combinations(range(len(t)), order):
            if all(s[i] == t[j] for i, j in zip(a, b, strict=True)):
                total += decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_kernel_matches_enumeration():
    words = ["nitwit", "nxitwit", "abc", "aabbcc", "zzz"]
    codes = toxicity._codes(words, 8)
    i, j = np.meshgrid(range(5), range(5))
    got = toxicity._pairs_kernel(codes[i.ravel()], codes[j.ravel()], 3, 0.6)
    want = [brute_kernel(words[a], words[b], 3, 0.6) for a, b in zip(i.ravel(), j.ravel(), strict=True)]
    assert np.allclose(got, want, rtol=1e-4, atol=1e-6)


def test_toxicity_held_out_and_obfuscated():
    rows = toxic_rows()
    model = toxicity.train([t for _, t, _ in rows[:500]], [y for _, _, y in rows[:500]])
    score = model.scores([t for _, t, _ in rows[500:]])
    truth = np.array([y for _, _, y in rows[500:]])
    assert ((score >= 0.5) == truth).mean() > 0.97
    odd = model.scores(["rato limen n-i-t-w-i-t sor b l o c k h e a d", "nitxwit bl0ckhead ra to", "rato limen sordi", ""])
    assert odd[0] > 0.5 and odd[1] > 0.5 and odd[2] < 0.5 and odd[3] < 0.5


def test_toxicity_documents(spark, odd_documents, no_documents):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity_model(docs, labels)
    out = toxicity.score_toxicity(odd_documents, model).collect()
    assert len(out) == odd_documents.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert len({r.score for r in out if r.doc_id in (3, 4)}) == 1
    assert toxicity.keep_clean(odd_documents, model).columns == odd_documents.columns
    assert toxicity.score_toxicity(no_documents, model).count() == 0
    assert toxicity.fit_toxicity_model(no_documents, labels).scores(["x"])[0] < 0.5
