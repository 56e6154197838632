import re

from citeweave.llm import quality as Q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for k in range(len(words) - 2):
        seen.setdefault(tuple(words[k : k + 3]), []).append(k)
    covered = {i for at in seen.values() if len(at) > 1 for k in at for i in (k, k + 1, k + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


EXTRA = ["a b c a b c", "to to to to", "x y\n x y\nx y\n\n", "a#b*c $%&|<> ##", "SHOUT LOUD " * 40, "w! " * 60, "é ß \U0001d54f " * 30, "a b c d " * 30 + "tail"]


def test_measurements_equal_brute_force(spark, docs, rows):
    texts = [(str(i), t) for i, t, _ in rows]
    got = sorted((str(r.doc_id), *r[1:6]) for r in Q.measure(docs).collect())
    assert got == sorted((i, *brute(t)) for i, t in texts)
    more = spark.createDataFrame(list(enumerate(EXTRA)), "doc_id long, text string")
    assert {r.doc_id: tuple(r[1:6]) for r in Q.measure(more).collect()} == {k: brute(t) for k, t in enumerate(EXTRA)}


def test_policies_and_ablation(docs, rows, no_docs):
    entries = Q.ledger(docs)
    judged = Q.apply_policy(entries).collect()
    for r in judged:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (r.fail_bits == 0)
    own = Q.mask(Q.POLICIES["v1"])
    for r in Q.ablation(entries).collect():
        bit = 1 << [x.name for x in Q.RULES].index(r.rule)
        assert r.failed == sum(bool(x.fail_bits & bit) for x in judged)
        assert r.failed_alone == sum(x.fail_bits & own == bit for x in judged)
        assert r.kept_without == sum(x.fail_bits & own & ~bit == 0 for x in judged)
    assert Q.apply_policy(Q.ledger(no_docs)).count() == 0


def test_no_python_in_the_plan(docs):
    plan = Q.apply_policy(Q.ledger(docs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
