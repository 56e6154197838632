import math
import random
import zlib

import numpy as np
import public_tokenizers

from citeweave.llm import language as L

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "aba"]
    lattice = L.Lattice(pieces)
    chance = L._with_zero(np.array([[0.01], [0.2], [0.3], [0.1], [0.05], [0.34]]))
    known = dict(zip(pieces, chance[1:, 0]))

    def total(word):
        return 1.0 if not word else sum((known[word[:k]] if word[:k] in known else 0.01 if k == 1 else 0) * total(word[k:]) for k in range(1, min(5, len(word)) + 1))

    words = ["a", "ab", "abab", "bbaba", "xab", "aabbaabb"]
    assert np.allclose(lattice.log_chance(words, chance)[:, 0], [math.log(total(w)) for w in words])


def test_expected_counts_are_whole_words():
    lattice = L.Lattice(["a", "b", "ab"])
    chance = L._with_zero(np.full((4, 1), 0.25))
    found = lattice.expected({"ab": 3, "aab": 1}, chance)
    assert math.isclose(found[1] + 2 * found[3] + found[2], 3 * 2 + 3)


def corpus():
    rng = random.Random(4)
    en, de = "the quick water thing there wish church about".split(), "der schnelle wasser nicht auch zwischen über straße".split()
    return [(k, " ".join(rng.choice(de if k % 2 else en) for _ in range(12)), "de" if k % 2 else "en") for k in range(80)]


def test_held_out_accuracy(spark):
    rows = [*corpus(), (900, None, "en"), (901, "123 !!", "de"), (None, "the church", None), (902, "über straße " * 4000, None)]
    got = L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PATH).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for k, _, lang in corpus():
        assert by[k].lang_pred == lang and 0 <= by[k].score <= 1
        assert by[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0)
    assert by[900].lang_pred == by[901].lang_pred == "und" and by[900].score == 0
    assert by[902].lang_pred == "de" and by[None].lang_pred == "en" and not by[None].held_out


def test_odd_tables(docs, rows, no_docs):
    from pyspark.sql import functions as F

    assert L.identify(docs, PATH).count() == len(rows)
    assert L.identify(no_docs, PATH).count() == 0
    unknown = L.identify(docs.withColumn("lang", F.lit(None).cast("string")), PATH).collect()
    assert {r.lang_pred for r in unknown} == {"und"}


def test_long_pieces_and_long_runs_by_brute_force():
    rng = random.Random(8)
    pieces = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(60)} | set("abc") | {"abcabcabcabca"})
    lattice = L.Lattice(pieces)
    weight = np.array([[rng.random(), rng.random()] for _ in range(len(pieces) + 1)])
    chance = weight / weight.sum(axis=0)
    runs = ["".join(rng.choice("abcx") for _ in range(n)) for n in (1, 4, 12, 41, 77, 200)] + ["abcabcabcabca" * 6]
    found = lattice.log_chance(runs, chance)
    for lang in (0, 1):
        known = dict(zip(pieces, chance[1:, lang]))
        for k, run in enumerate(runs):
            alpha = [1.0] + [0.0] * len(run)
            for j in range(1, len(run) + 1):
                alpha[j] = sum(alpha[i] * (known[run[i:j]] if run[i:j] in known else chance[0, lang] if j == i + 1 else 0.0) for i in range(j))
            assert math.isclose(found[k, lang], math.log(alpha[-1]), rel_tol=1e-9)


def test_expected_counts_by_enumeration():
    pieces = ["a", "b", "ab", "abba", "bb"]
    lattice, chance = L.Lattice(pieces), np.array([[0.05], [0.2], [0.25], [0.2], [0.1], [0.2]])
    known = dict(zip(pieces, range(1, 6)))

    def all_ways(run):
        if not run:
            return [((), 1.0)]
        ways = []
        for k in range(1, len(run) + 1):
            number = known.get(run[:k], 0 if k == 1 else None)
            if number is not None:
                ways += [((number, *rest), chance[number, 0] * p) for rest, p in all_ways(run[k:])]
        return ways

    counts, want = {"abba": 2, "axbb": 1, "abbaabba": 3}, np.zeros(6)
    for run, n in counts.items():
        total = sum(p for _, p in all_ways(run))
        for way, p in all_ways(run):
            for number in way:
                want[number] += n * p / total
    assert np.allclose(lattice.expected(counts, chance), want)


def test_a_long_unseen_run_does_not_underflow():
    found = L.Lattice(["a"]).log_chance(["x" * 5000], np.array([[1e-9], [1 - 1e-9]]))
    assert math.isclose(found[0, 0], 5000 * math.log(1e-9))


def test_whole_vocabulary_takes_part():
    pieces = L.vocabulary(PATH)
    assert max(map(len, pieces)) > 5 and all(len(p) > 1 or p.isalpha() for p in pieces)


def test_numerals_are_no_letters(spark):
    rows = [*corpus(), (950, "½ ² ① Ⅷ 12", None), (951, "½ wish", None)]
    by = {r.doc_id: r for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PATH).collect()}
    assert by[950].lang_pred == "und" and by[950].score == 0 and by[951].lang_pred == "en"


def test_the_sample_is_bounded_by_rows(spark):
    rows = [(7, f"text {'abcdefgh'[k % 8]}", "en") for k in range(200)] + [(k, "wort", "de") for k in range(50)]
    counts = L.sample_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 10)
    assert sum(counts["en"].values()) == 2 and 0 < sum(counts["de"].values()) <= 10
