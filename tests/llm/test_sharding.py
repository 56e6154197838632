import zlib

from citeweave.llm import sharding as S


def check(found, shards):
    for k in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == k) == list(range(sum(r.shard == k for r in found)))
    assert {r.shard for r in found} <= set(range(shards))


def test_every_row_once_with_size_and_checksum(docs, rows, no_docs):
    found = S.shard(docs, 4, bucket_rows=5).collect()
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in found) == want
    check(found, 4)
    assert S.shard(no_docs, 8).count() == 0


def test_sizes_are_near_equal_and_groups_whole(spark):
    rows = [(k, f"text {k * 7919 % 1000} " * (1 + k * k % 13), "en" if k % 3 else "de") for k in range(3000)]
    found = S.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 8).collect()
    check(found, 8)
    sizes = [sum(r.size for r in found if r.shard == k) for k in range(8)]
    assert max(sizes) - min(sizes) < 0.03 * sum(sizes) / 8
    by_text = {}
    text = {i: t for i, t, _ in rows}
    for r in found:
        by_text.setdefault(text[r.doc_id], set()).add(r.shard)
    assert sum(len(s) > 1 for s in by_text.values()) <= 7 + sum(t.count(" ") > 0 and len({lang for _, x, lang in rows if x == t}) > 1 for t in by_text)


def test_a_group_of_a_third_is_divided(spark):
    rows = [(k, "hot copy of one text" if k % 3 == 0 else f"other text {k}", "en") for k in range(6000)]
    found = S.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 8).collect()
    sizes = [sum(r.size for r in found if r.shard == k) for k in range(8)]
    assert max(sizes) - min(sizes) < 0.03 * sum(sizes) / 8
    check(found, 8)


def test_shards_follow_target_bytes_and_odd_numbers(spark):
    frame = spark.createDataFrame([(k, f"row {k}", None) for k in range(700)], "doc_id long, text string, lang string")
    total = sum(len(f"row {k}") + 1 for k in range(700))
    found = S.shard(frame, target_bytes=total // 5 + 1).collect()
    sizes = [sum(r.size for r in found if r.shard == k) for k in range(5)]
    assert min(sizes) > 0.9 * total / 5


def test_cuts_equal_weighted_medians_by_brute_force(spark):
    """Two shards of distinct keys: the cut is at the row that the sorted weights put it."""
    from pyspark.sql import functions as F

    rows = [(k, "x" * (1 + k * 37 % 91)) for k in range(501)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.shard for r in S.shard(frame, 2, {"id": F.col("doc_id") / 1000.0}).collect()}
    total, before, best = sum(len(t) + 1 for _, t in rows), 0, []
    for k, t in rows:
        best.append((abs(before - total / 2), k))
        before += len(t) + 1
    cut = min(best)[1]
    assert found == {k: int(k >= cut) for k, _ in rows}


def test_the_widest_dimension_in_its_own_unit_is_cut(spark):
    from pyspark.sql import functions as F

    rows = [(k, f"{k:04d}", k % 2) for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kind int")
    found = S.shard(frame, 4, {"big": F.col("doc_id") / 500.0, "small": F.col("kind") / 1e6}).collect()
    kinds = {}
    for r in found:
        kinds.setdefault(r.shard, set()).add(r.doc_id % 2)
    assert all(len(k) == 1 for k in kinds.values()) and len(kinds) == 4
