import numpy as np
import pytest

from lexiloom.llm import toxicity

from .test_urls_and_classifiers import toxic_rows


@pytest.fixture(scope="module")
def model():
    rows = toxic_rows()
    return toxicity.train([t for _, t, _ in rows[:500]], [y for _, _, y in rows[:500]])


CLEAN = "rato limen {} sorditoli pera men"


def test_one_changed_insult_in_a_clean_text(model):
    odd = ["niqtwit", "nitwqit", "blocqkhead", "scouxndrel", "bloqckheqad", "nittwit", "blockkhead", "scoundreel", "blokhead", "scondrel", "nitwit", "nit wit", "block head", "scoun drel!", "n i t w i t"]
    assert dict(zip(odd, model.scores([CLEAN.format(w) for w in odd]) > 0.5, strict=True)) == dict.fromkeys(odd, True)
    assert model.scores([CLEAN.format("")])[0] < 0.5
    rows = toxic_rows()[500:]
    score, truth = model.scores([t for _, t, _ in rows]), np.array([y for _, _, y in rows])
    assert (score[truth == 0] < 0.5).mean() > 0.97


def test_an_insult_at_every_offset_of_a_stretch(model):
    odd = ["vu" * (i // 2) + "v" * (i % 2) + "nitwit" + "uv" * 8 for i in range(0, 49, 1)]
    odd += ["younitwit", "supernitwit", "blockheadvuv", "vuvnitwqituvu", " ".join("scoundrelvuvnitwit"), "vu" * 5000 + "nitwit" + "vu" * 5000]
    assert dict(zip(odd, model.scores([CLEAN.format(w) for w in odd]) > 0.5, strict=True)) == dict.fromkeys(odd, True)
    assert (model.scores([CLEAN.format(w) for w in ("vu" * 30, "v" * 40)]) < 0.5).all()
    both = model.kernels(["b l o c k h e a d n i t w i t"])[0]
    assert {m.strip("^$") for m, k in zip(model.landmarks.words, both, strict=True) if k > 0.99} >= {"blockhead", "nitwit"}


def test_half_of_the_sample_toxic_and_copies():
    """Shares of labels in the sample must not matter, nor many copies of one text."""
    rows = toxic_rows()
    bad, good = [r for r in rows if r[2]], [r for r in rows if not r[2]]
    copied = "lilili totomen ramento sorsor " * 9 + "nitwit"
    texts = [t for _, t, _ in [*bad, *good[: len(bad)]]] + [f"{copied} {i}" for i in range(90)]
    model = toxicity.train(texts, [1] * len(bad) + [0] * len(bad) + [1] * 90)
    cores = {w.strip("^$") for w in model.landmarks.words}
    assert {"blockhead", "nitwit", "scoundrel", "duff"} <= cores and not cores & {"lilili", "totomen", "ramento", "sorsor"}
    assert (model.scores([CLEAN.format(w) for w in ("blockhead", "nitwit", "duffratoli")]) > 0.5).all()


def test_density_counts_where_clean_texts_hold_the_stem_too():
    """A stem that one clean text in eight holds once tells nothing by its presence, but by how often it occurs."""
    rng = np.random.default_rng(4)
    syllables = ["ra", "to", "li", "men", "sor", "pe", "di"]

    def word():
        return "".join(rng.choice(syllables, rng.integers(1, 5)))

    def text(stems):
        words = [word() for _ in range(60)] + ["zuffel" + word() for _ in range(stems)]
        return " ".join(words[i] for i in rng.permutation(len(words)))

    rows = [(text(4), 1) if i % 4 == 0 else (text(int(rng.random() < 0.12)), 0) for i in range(800)]
    model = toxicity.train([t for t, _ in rows[:600]], [y for _, y in rows[:600]])
    score, truth = model.scores([t for t, _ in rows[600:]]), np.array([y for _, y in rows[600:]])
    assert (score[truth == 1] >= 0.5).mean() > 0.9 and (score[truth == 0] < 0.5).mean() > 0.9
