import random

import numpy as np
import pytest

from memquarry.llm import harmful as H

BAD = ["you are a {} {}", "only a {} {} would miss it", "shut up, you {} {}", "every one of them is a {} {}"]
ADJ, NOUN = ["stupid", "filthy", "worthless"], ["idiot", "moron", "bastard"]
FINE = ["the parties agree on the {} {}", "please send the {} {} by friday", "the {} {} was reviewed in march", "damages for assault are excluded from the {} {}", "the idiot proof cover of the {} {}"]
THINGS = ["annex", "deposit", "schedule", "invoice", "licence", "survey", "audit", "tariff"]


def disguise(rng, w):
    return rng.choice([w, w, w.upper(), w.replace("i", "1"), w[0] + "*" * (len(w) - 2) + w[-1], w[:2] + w[2] * 3 + w[3:], " ".join(w)])


def document(rng, bad):
    s = [rng.choice(FINE).format(rng.choice(THINGS), rng.choice(THINGS)).capitalize() for _ in range(rng.randrange(3, 15))]
    if bad:
        s.insert(rng.randrange(len(s)), rng.choice(BAD).format(rng.choice(ADJ), disguise(rng, rng.choice(NOUN))))
    return ". ".join(s) + "."


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    labels = [int(rng.random() < 0.25) for _ in range(1200)]
    return [document(rng, y) for y in labels], labels


@pytest.fixture(scope="module")
def model(corpus):
    texts, labels = corpus
    rng = random.Random(2)
    noisy = [1 - y if rng.random() < 0.02 else y for y in labels[:800]]
    return H.fit(texts[:800], noisy, ["en"] * 800)


def test_held_out_accuracy(corpus, model):
    texts, labels = corpus
    flagged = H.Scorer(model).scores(texts[800:]) > model.thresholds[""]
    truth = np.array(labels[800:]) == 1
    hit = (flagged & truth).sum()
    assert hit / flagged.sum() > 0.95 and hit / truth.sum() > 0.93


def test_scores_do_not_depend_on_the_batch(corpus, model):
    texts = corpus[0][:60] + ["", "x", " . . "]
    together = H.Scorer(model).scores(texts)
    alone = np.array([H.Scorer(model).scores([t])[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-4)
    assert np.isneginf(together[[60, 62]]).all()


def test_the_worst_sentence_counts(model):
    fine = "The parties agree on the annex. " * 3000
    s = H.Scorer(model)
    assert s.scores([fine + "You are a filthy moron. " + fine])[0] == pytest.approx(s.scores(["You are a filthy moron."])[0], abs=1e-3)


def test_normal_form():
    assert {H.normal(w) for w in ("idiot", "1d1ot", "idiooot", "іdіоt")} == {"idiot"}
    assert H.tokens("you i d i o t !") == [b"you", b"idiot", b"."] or b"idiot" in H.tokens("you i d i o t !")


def test_table(spark, corpus):
    texts, labels = corpus
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None, "s", 0.5) for i, t in enumerate(texts[:500])] + [(900, None, None, None, None), (901, "", "xx", "s", None)], "doc_id long, text string, lang string, source string, score double")
    marks = [(i, y, "r1") for i, y in enumerate(labels[:400])] + [(0, None, "r2"), (1, 1 - labels[1], "r2"), (5000, 1, "r1"), (3, 7, "r1"), (None, 1, "r1")]
    lab = spark.createDataFrame(marks, "doc_id long, toxic int, rater string")
    assert H.labelled(docs, lab).where("doc_id = 1").count() == 0  # a tie
    got = {r.doc_id: r for r in H.score(docs, H.fit_on(docs, lab), ["doc_id", "source"]).collect()}
    assert len(got) == 502 and got[900].score == got[901].score == 0 and not got[900].flagged
    right = sum(got[i].flagged == bool(labels[i]) for i in range(400, 500))
    assert right >= 95
    with pytest.raises(ValueError):
        H.fit_on(docs, lab.where("toxic = 0"))
    assert H.score(docs.limit(0), H.fit_on(docs, lab), ["doc_id"]).count() == 0


def test_every_language_has_its_threshold(corpus):
    texts, labels = corpus
    langs = ["de-DE" if i % 6 == 0 else "it" if i % 6 == 1 and not y else "en" for i, y in enumerate(labels[:300])]
    found = H.fit(texts[:300], labels[:300], langs).thresholds
    assert found.keys() == {"", "en", "de", "it"} and found["it"] == pytest.approx(found[""])
    few = H.fit(texts[:12], [1, 0, 1] + [0] * 9, ["en"] * 12).thresholds
    assert few.keys() == {"", "en"}


def test_few_labels_of_a_language_move_its_threshold_less():
    scores = np.array([5.0, 4.0, -3.0, -4.0] * 50 + [2.0, -6.0, -8.0, -9.0] * 2)
    y = np.array([1, 1, 0, 0] * 50 + [1, 1, 0, 0] * 2)
    few = H.thresholds(scores, y, ["en"] * 200 + ["de"] * 8)
    many = H.thresholds(np.append(scores, np.tile(scores[-8:], 40)), np.append(y, np.tile(y[-8:], 40)), ["en"] * 200 + ["de"] * 328)
    assert few[""] > few["de"] > many["de"] > H.best_threshold(scores[-8:], y[-8:]) - 1e-9


def test_unknown_words_and_fragments_have_no_say(model):
    s = H.Scorer(model)
    odd = ["zyxqvu", "qwzzk pfjjx", "n", "la", "eur", "x1x", "this", "the", "unless", "the parties", "please send"]
    assert (s.scores(odd) < model.thresholds[""]).all()
    assert len({round(float(z), 4) for z in s.scores(["zyxqvw", "qwzjk pfjxx jqqz"])}) == 1


def test_a_word_is_read_to_its_end():
    long = "donaudampfschifffahrtsgesellschaft"
    assert H.features(f"{long}idiot".encode())[-1] == H.features(b"idiot")[-1]


def test_training_reads_whole_sentences(corpus):
    texts, labels = corpus
    late = ["review of the annex " * 60 + t.replace(".", "") for t in texts[:300]]
    model = H.train(late, np.array(labels[:300]))
    right = (H.Scorer(model).scores(late) > 0) == (np.array(labels[:300]) == 1)
    assert right.mean() > 0.95


def test_contradicted_labels_are_left_out(corpus):
    texts, labels = corpus
    y = np.array(labels[:600])
    wrong = np.random.default_rng(3).choice(600, 12, replace=False)
    y[wrong] = 1 - y[wrong]
    scores, worst = H.cross_scores(texts[:600], y, 1, 3)
    dropped = np.flatnonzero(H.doubtful(scores, y, worst))
    assert np.isin(wrong, dropped).mean() > 0.7 and len(np.setdiff1d(dropped, wrong)) <= 6
