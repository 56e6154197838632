import random

import numpy as np

from citeweave.llm import decontaminate as D


def score(item, text):
    """Smith-Waterman by the book."""
    best, above = 0, [0] * (len(text) + 1)
    for a in item:
        row = [0]
        for j, b in enumerate(text):
            row.append(max(0, above[j] + (2 if a == b else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, *row), row
    return min(1.0, best / (2 * min(len(item), D.FULL_WORDS)))


def fixture():
    rng = random.Random(11)
    items = [(k, f"q{k} " + " ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(12, 60)))) for k in range(8)]
    docs = []
    for k in range(60):
        text = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 150))]
        if k % 3 == 0:
            item = items[k % 8][1].split()
            for _ in range(k % 4):
                item[rng.randrange(len(item))] = "edited"
            if k % 5 == 0:
                del item[3]
            text[10:10] = item
        docs.append((k, " ".join(text)))
    return items, docs


def test_equals_brute_force(spark):
    items, docs = fixture()
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(d, i): round(s, 6) for d, t in docs for i, q in items if (s := score(D.word_list(q), D.word_list(t))) >= 0.5}
    assert {(r.doc_id, r.item_id): round(r.score, 6) for r in got} == want
    assert len(want) >= 20


def test_aligned_words(spark):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta")]
    got = D.contaminated(spark.createDataFrame([(5, "x y Alpha, beta gamma DELTA epsilon zeta eta theta z")], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).first()
    assert (got.score, got.first_word, got.last_word) == (1.0, 2, 9)


def test_odd_rows(spark, docs, rows, no_docs):
    bench = spark.createDataFrame([(1, rows[0][1]), (2, None), (None, ""), (3, "too short"), (1, rows[0][1])], "item_id long, text string")
    hit = {r.doc_id for r in D.contaminated(docs, bench).collect()}
    assert hit == {rows[0][0]}
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 1
    assert D.contaminated(no_docs, bench).count() == 0
    assert D.contaminated(docs, bench.where("false")).count() == 0
    assert D.drop_contaminated(docs, bench.where("false")).count() == len(rows)


def test_benchmark_in_blocks_finds_the_same(spark):
    items, docs = fixture()
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda rows: sorted((r.doc_id, r.item_id) for r in rows)
    assert key(D.contaminated(*frames, block_bytes=700).collect()) == key(D.contaminated(*frames).collect())


def test_alignment_of_batches():
    rng = np.random.default_rng(2)
    items, texts = rng.integers(0, 6, (40, 12)), rng.integers(0, 6, (40, 30))
    got = D.align(items, texts)[0]
    assert [round(score(a.tolist(), b.tolist()) * 2 * 12) for a, b in zip(items, texts)] == got.tolist()


def test_copies_with_an_edit_every_few_words_equal_brute_force(spark):
    rng = random.Random(12)
    items = [(k, " ".join(f"w{rng.randint(0, 4000)}" for _ in range(rng.randint(17, 59)))) for k in range(24)]
    edited = lambda t, every: " ".join(f"x{rng.randint(0, 9999)}" if j % every == every - 1 else w for j, w in enumerate(t.split()))
    docs = [(k, f"some words before {edited(t, 4 + k % 3)} and some after") for k, t in items]
    docs += [(100 + k, t) for k, t in items if k % 2]  # verbatim copies count the n-grams that edits destroyed
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(d, i): round(s, 6) for d, t in docs for i, q in items if (s := score(D.word_list(q), D.word_list(t))) >= 0.5}
    assert {(r.doc_id, r.item_id): round(r.score, 6) for r in got} == want
    assert len(want) == 36


def test_item_after_many_of_its_phrase(spark):
    item = [f"w{k}" for k in range(40)]
    docs = [(k, " ".join(item[:phrase] * 40 + item)) for k, phrase in enumerate((3, 5, 8))]
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {(r.doc_id, r.score, r.first_word, r.last_word) for r in got} == {(k, 1.0, 40 * p, 40 * p + 39) for k, p in enumerate((3, 5, 8))}


def test_short_items_are_whole_texts(spark):
    items = spark.createDataFrame([(1, "Yes"), (2, "new york"), (2, "new york"), (3, "?!"), (4, None), (5, "a longer item of several words here")], "item_id long, text string")
    docs = spark.createDataFrame([(10, "yes!"), (11, "yes it is"), (12, "New York."), (13, "in new york city"), (14, ""), (15, None), (16, "one longer item of several words here")], "doc_id long, text string")
    found = {(r.doc_id, r.item_id, r.score, r.first_word, r.last_word) for r in D.contaminated(docs, items).collect()}
    assert {f[:2] for f in found} == {(10, 1), (12, 2), (16, 5)}
    assert (10, 1, 1.0, 0, 0) in found and (12, 2, 1.0, 0, 1) in found


def test_parts_of_hits_find_the_same(spark, monkeypatch):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(3, 14)))) for k in range(30)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(40)]
    block = D.Items(items, 3)
    import pyarrow as pa

    batch = pa.record_batch([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])], names=["doc_id", "text"])
    results = []
    for hits in (1 << 20, 7):
        monkeypatch.setattr(D, "HITS", hits)
        run = D._finder(block, block.seeds(), 0.5, 8, 50)
        results.append([b.to_pylist() for b in run(iter([batch]))])
    key = lambda rows: {(r["doc_id"], r["item_id"]): r["score"] for part in rows for r in part}
    whole, parts = map(key, results)
    assert len(whole) > 10 and whole.keys() <= parts.keys() and all(parts[k] >= v for k, v in whole.items())
