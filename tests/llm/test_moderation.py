"""Moderation against brute force, held-out remarks and the same work done in one process."""

from collections import Counter

import numpy as np
import pytest

from matchloom.llm import moderation as M
from matchloom.sources import read_table


@pytest.fixture(scope="module")
def labelled(spark, folder):
    return [(r.text, r.label) for r in read_table(spark, folder, "moderation_examples").orderBy("example_id").collect()]


@pytest.fixture(scope="module")
def model(labelled):
    return M.RemarkModel.fit(labelled)


@pytest.mark.parametrize(
    ("text", "compared"),
    [
        ("m o r o n", " moron~~~~ "), ("c\u200bu\u200bn\u200bt", " cunt~~~~ "), ("id!07 w@nker looooser", " idiot~~~~ wanker~~~~ loser~~~~ "), ("sсumbаg", " scumbag~~~~ "),
        ("FiLthY cvn7,", " filthy~~~~ cunt~~~~ "), ("s____d t--s", " sd~~~~ ts~~~~ "), ("The 21th of May, 90+3' 100km", " the th of may # km "), ("xxxxxxx", " x "), ("Déo’s café", " deos cafe "),
        ("https://a.example/x_y", " httpsaexamplexy "), ("word--word", " wordword "), ("  \n", ""), ("試合", " # "),
    ],
)
def test_letters(text, compared):
    assert M.letters(text) == compared


def test_harmless_typography_is_no_disguise():
    for text in ("\u200bzero\u200dwidth", "rust\u2011red half\u2011time", "naïve ﬁnal ﬂag", "МАТЧ матч", "GOAL! Kick-off! Half-time", "4-3-3 u21 2nd S9P0000"):
        assert "~" not in M.letters(text), M.letters(text)


def words_one_by_one(texts):
    """Buckets of words per text, each word on its own."""
    out = []
    for t in texts:
        found = set()
        for w in (M.letters(t) if t else "").split():
            codes, begins = M._codes([f" {w} "])
            found |= set(M._spread(codes, begins).bucket.tolist())
        out.append(found)
    return out


def test_words_and_their_counts(spark):
    texts = ["one two two", None, "", "two, three!", "é" * 50_000, "one", "...", " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(500)), "one"]
    counted = Counter(b for found in words_one_by_one(texts) for b in found)
    docs = spark.createDataFrame([(t, 1) for t in texts], "text string, bucket int").repartition(3)
    counts, total = M._counted(docs, lambda: M._words_of)
    assert total == 8 and {k: v for k, v in enumerate(counts.tolist()) if v} == counted
    assert M._counted(docs.limit(0), lambda: M._words_of)[1] == 0


def test_windows_against_spectra(labelled):
    """The running sums give what the window's own features weigh, but for subsequences that reach over its end."""
    rarity = M.Rarity(np.random.default_rng(1).integers(0, 40, M.WORDS), 1000)
    model = M.RemarkModel(np.random.default_rng(0).normal(size=M.SPACE), -0.5, rarity.weight)
    text = next(t for t, label in labelled if label != "none")
    whole = M._pieces(M.letters(text), rarity)[-1]
    places, values = M.spectrum(whole)
    words, first, last, value = model._values([M.letters(text)])
    at = np.flatnonzero((first == 0) & (last == len(words.start) - 1))[0]
    assert value[at] == pytest.approx(float(values @ model.weights[places]) - 0.5, abs=1e-4)


def test_scores_do_not_depend_on_the_batch(labelled, model):
    texts = [t for t, _ in labelled[:20]] + ["", None, "one " * 3000, "x", "..."]
    assert np.allclose(model.scores(texts), [model.scores([t])[0] for t in texts], atol=1e-4)
    assert (model.scores([None, "", "  "]) <= M.THRESHOLD).all()


def test_held_out_remarks(labelled):
    """Of three folds without common texts, each is scored by a model of the others."""
    texts = sorted({M.letters(t) for t, _ in labelled})
    fold = {t: k % 3 for k, t in enumerate(texts)}
    score, bad = [], []
    for k in range(3):
        own = M.RemarkModel.fit([r for r in labelled if fold[M.letters(r[0])] != k])
        test = [r for r in labelled if fold[M.letters(r[0])] == k]
        score += own.scores([t for t, _ in test]).tolist()
        bad += [label != "none" for _, label in test]
    score, bad = np.array(score), np.array(bad)
    assert (score[bad][:, None] > score[~bad][None, :]).mean() > 0.97
    assert (score[~bad] > M.THRESHOLD).mean() < 0.02 < 0.7 < (score[bad] > M.SURE).mean()


def test_without_labels():
    assert M.RemarkModel.fit([]).scores(["x", None]).tolist() == [0.0, 0.0]
    assert M.RemarkModel.fit([("you idiot", "abusive"), (None, "none"), ("x", None)]).scores(["you idiot"]).tolist() == [0.0]


def test_telling_words_of_a_corpus(spark, labelled):
    """A remark that no label resembles is found by the words it shares with sure ones."""
    examples = spark.createDataFrame([(k, *r) for k, r in enumerate(labelled)], "example_id bigint, text string, label string")
    known = "foreigners like them are not even human. keep the terrace clean of them zorblat quimfest wexel"
    documents = [f"row {k} seat 7, worst view in Tonmarga, best pies though" for k in range(300)] + [known] * 12 + ["wexel zorblat quimfest"] + [None, ""]
    rows = [(k, t, "a" if k % 2 else None, "clash") for k, t in enumerate(documents)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, label string").repartition(4)
    found = {r.doc_id for r in M.find_harmful(docs, examples).collect()}
    assert found == set(range(300, 313))
    rates = {r.source: (r.documents, r.found) for r in M.harmful_rates(docs, examples).collect()}
    assert rates == {None: (158, 7), "a": (157, 6)}
    assert M.score_documents(docs.limit(0), examples).count() == 0
    assert {r.score for r in M.score_documents(docs, examples.limit(0)).collect()} == {0.0}
