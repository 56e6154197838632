import random
import zlib

from citeweave.llm import toxicity as T


def model():
    rng = random.Random(1)
    some = "the quiet river runs past a stone and you are an old market total near".split()
    line = lambda k: " ".join(rng.choice(some) for _ in range(12)) + f" {k}"
    clean = [(line(k), 0) for k in range(300)]
    toxic = [(f"{line(k)} idiot scum {line(k)}", 1) for k in range(60)]
    return T.learn(clean + toxic, 0.25)


def test_folding():
    assert T.fold("ＩＤＩＯＴ id1ot іdіоt i​diot Idiöt $cum") == ["idiot", "idiot", "idiot", "idiot", "idiot", "scum"]
    assert T.fold("idiot!! stupid$$$") == ["idiot", "stupid"]
    assert T.fold(None) == T.fold("") == []


def test_learned_words_score_masked_forms_too():
    m = model()
    a = m.automaton()
    assert T.measure(T.fold("what an 1d1ot"), a)[1] == 1
    assert T.measure(T.fold("the quiet river"), a)[1] == 0
    spared = T.Model({"trash": 2.0}, {}, ("trash can",), (0.0,)).automaton()
    assert T.measure(T.fold("a trash can"), spared)[1] == 0
    assert T.measure(T.fold("a trash heap"), spared)[1] == 1
    assert T.measure(T.fold("trashy"), spared)[1] == 0


def test_every_row_is_scored(spark, docs, rows, no_docs):
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(10, 30)] + [(None, 1, 1), (11, None, None)], "doc_id long, quality int, toxic int")
    got = T.classify(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert T.classify(no_docs, labels).count() == 0
    kept = T.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.3 for r in got)
    assert T.classify(docs, labels.where("false")).count() == len(rows)


def test_held_out_accuracy():
    m = model()
    a = m.automaton()
    import numpy as np

    texts = [("scum like you " * 3, 1), ("an idiot wrote this old scum", 1), ("stone and market by the river", 0), ("", 0)]
    p = 1 / (1 + np.exp(-T._features([T.measure(T.fold(t), a) for t, _ in texts]) @ np.array(m.curve)))
    assert [int(x >= 0.3) for x in p] == [y for _, y in texts]


def brute_measure(words, m):
    """Every word against every entry, phrases word by word; a masked l may read as i."""
    spared = set()
    for phrase in m.exceptions:
        parts = phrase.split()
        for k in range(len(words) - len(parts) + 1):
            if words[k : k + len(parts)] == parts:
                spared.update(range(k, k + len(parts)))
    total, hits = 0.0, 0
    for k, word in enumerate(words):
        own = [x for w, x in m.whole.items() if word in (w, w.replace("l", "i"))] + [x for w, x in m.starts.items() if word.startswith((w, w.replace("l", "i")))]
        if own and k not in spared:
            total, hits = total + max(own), hits + 1
    return total, hits, len(words)


def test_scores_equal_brute_force(spark, docs, rows):
    import math
    import random

    rng = random.Random(6)
    m = T.Model({"scum": 2.5, "troll": 1.5, "idiot": 2.0, "river": 0.5}, {"idio": 1.0, "vill": 3.0}, ("troll bridge", "river scum"), (-2.0, 0.4, 0.3, 0.2, 0.1))
    words = "scum troll idiot idiots idiocy villain vi11ain tr0ll river bridge scum! the a $cum scu trolls".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(150)] + ["", None, "river scum", "troll bridge troll", "scum " * 3000]
    automaton = m.automaton()
    got = {r.doc_id: r for r in T.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), m).collect()}
    for k, text in enumerate(texts):
        total, hits, n = brute_measure(T.fold(text), m)
        found = T.measure(T.fold(text), automaton)
        assert (round(found[0], 9), *found[1:]) == (round(total, 9), hits, n), text
        x = (1, 100 * total / (max(n, 1) + 20), math.log1p(total), math.log1p(hits), math.log1p(max(n, 1)))
        assert math.isclose(got[k].score, 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, m.curve)))), rel_tol=1e-9)


def test_harmless_phrases_are_learned():
    toxic = [(f"you scum number {k} are scum of a kind", 1) for k in range(30)]
    clean = [(f"a quiet day {k} by the river with a stone", 0) for k in range(60)] + [(f"pond scum grew on day {k} by the river", 0) for k in range(5)]
    m = T.learn(toxic + clean, 0.3, exceptions=())
    assert "scum" in m.whole and "pond scum" in m.exceptions and "you scum" not in m.exceptions
    assert T.measure(T.fold("pond scum"), m.automaton())[1] == 0 and T.measure(T.fold("old scum"), m.automaton())[1] == 1


def test_the_sample_has_one_text_an_id(spark):
    frame = spark.createDataFrame([(3, f"text number {k % 5}") for k in range(50)] + [(4, None), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    scores = {r.score for r in T.classify(frame, labels).collect()}
    assert scores and all(0 <= s <= 1 for s in scores)
