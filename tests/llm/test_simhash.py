import re

import numpy as np
import xxhash

from citeweave.llm import simhash


def wide_keys(words=4, width=12):
    """Keys of single blocks of every word of a wide fingerprint."""
    from pyspark.sql import functions as F

    per = 64 // width
    return [F.struct(F.lit(w * per + j).alias("combination"), F.expr(f"shiftrightunsigned(f{w}, {j * width}) & {(1 << width) - 1}L").alias("block")) for w in range(words) for j in range(per)]


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints, most=4):
    found = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = found[a], found[b]
                found = [min(x, y) if f in (x, y) else f for f in found]
    return found


def test_fingerprints_and_components_equal_brute_force(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    prints = [brute(t) for _, t, _ in rows]
    root = roots(prints)
    least = {r: min((rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None), default=None) for r in root}
    want = sorted((str(rows[k][0]), f"{prints[k]:016x}", str(least[root[k]])) for k in range(len(rows)))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_links_lose_nothing_with_tiny_tiles(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 62, 6)
    prints = sorted({int(c) ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 5), replace=False)) for c in centres for _ in range(40)})
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    from citeweave.operators.components import connected_components

    linked = {r.node: r.component for r in connected_components(simhash.links(frame, simhash.block_keys("fp", 4, 2), ["fp"], 4, tile=16)).collect()}
    root = roots(prints)
    assert [linked.get(p, p) for p in prints] == [prints[r] for r in root]


def test_finer_blocks_link_the_same(spark):
    prints = [0, 0b1111, 0b11111, 1 << 62, (1 << 62) | 7 << 20]
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    for matched in (1, 2, 3):
        assert {(min(r), max(r)) for r in simhash.links(frame, simhash.block_keys("fp", 4, matched), ["fp"], 4).distinct().collect()} >= {(0, 0b1111), (1 << 62, (1 << 62) | 7 << 20)}


def test_one_of_each_class_stays(docs, rows, no_docs):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({t for _, t, _ in rows}) - 3  # one edited copy; null, empty and blank are one
    assert {1} == {r.doc_id for r in kept.collect()} & {1, 2, 3}
    assert simhash.near_duplicates(no_docs).count() == 0


def test_near_copies_at_four_fifths_are_found(spark):
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for _ in range(40):
        words = [f"w{rng.integers(0, 3000)}" for _ in range(200)]
        rows.append((k, " ".join(words)))
        for at in (50, 150):
            words[at] = "changed"
        rows.append((k + 1, " ".join(words)))
        k += 2
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, _ in rows if i % 2 == 0} <= kept
    assert len(kept) <= 42


def test_wide_links_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    base = [rng.integers(0, 1 << 62, 4).tolist() for _ in range(4)]
    prints = [tuple(w ^ (1 << int(rng.integers(0, 62)) if rng.random() < 0.9 else 0) for w in b) for b in base for _ in range(12)]
    frame = spark.createDataFrame([(k, *map(int, p)) for k, p in enumerate(prints)], "fp long, f0 long, f1 long, f2 long, f3 long")
    from citeweave.operators.components import connected_components

    linked = {r.node: r.component for r in connected_components(simhash.links(frame, wide_keys(), ["f0", "f1", "f2", "f3"], 40, tile=5)).collect()}
    assert [linked.get(k, k) // 12 for k in range(48)] == [k // 12 for k in range(48)]


def test_one_of_each_class_of_shared_shingles_stays(spark):
    rng = np.random.default_rng(7)
    texts = []
    for _ in range(30):
        words = [f"w{rng.integers(0, 3000)}" for _ in range(rng.integers(60, 300))]
        for part in (0, 0.008, 0.014, 0.02, 0.024, 0.03):
            texts.append(" ".join("x" + w if rng.random() < part else w for w in words))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(sets)) for b in range(a)}
    root = list(range(len(sets)))
    for a, b in (p for p, j in share.items() if j >= 0.8):
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    assert sum(0.8 <= j < 0.85 for j in share.values()) >= 10 <= sum(0.7 <= j < 0.8 for j in share.values())
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_duplicates(frame).collect()} == set(root)


def test_exact_links_in_tiny_tiles(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(1, k, 56, " ".join(words[:30] + [f"x{k}"] + words[30:])) for k in range(20)] + [(1, 99, 56, " ".join(words[::-1]))]
    from citeweave.operators.components import connected_components

    found = connected_components(simhash.exact_links(spark.createDataFrame(rows, "component long, fp long, size long, text string"), 0.8, tile=200)).collect()
    assert {r.node for r in found} == set(range(20)) and len({r.component for r in found}) == 1
