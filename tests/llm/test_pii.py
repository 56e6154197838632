import hashlib
import re

from citeweave.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TEXTS = [
    "a@b.c_d@e.f, x@y x@y.z.@ a@a@a.b", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.4 1.1.1", "4111 1111-1111 1111 and 4111111111111112 0000000000000000000 1  2",
    "+1 (017) 555-7713 rest +12 +1234567 8+99 123 456 78-", "é\U0001d54f 9@mail.example.com ß 97.51.17.173", "mail.55@mail4.example.com" * 3, "5500005555555559", "", None, "1 " * 4000, "a" * 60000, "+1" + " " * 5000 + "23456789",
]


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(s)))) % 10 == 0


def brute(text):
    text = text or ""
    return (
        [("email", m) for m in EMAIL.finditer(text)] + [("ip", m) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
        + [("card", m) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))] + [("phone", m) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    )


def test_base_spans_equal_brute_force(spark, docs, rows):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in pii.digests(pii.find(frame)).collect():
        base = brute(TEXTS[r.doc_id])
        listed = ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), (r.doc_id, r.spans, listed)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _ in base) for x in pii.KINDS]
    assert pii.digests(pii.find(docs)).count() == len(rows)


def test_contexts_find_unseen_identifiers(spark, no_docs):
    seeds = [(k, f"Please call office line: +1 ({k:03d}) 555-{1000 + k} for help") for k in range(6)]
    unseen = [(90, "Please call office line: 555-44{0}-1200 for help".format(7)), (91, "a plain count of 555-447-1200 things")]
    found = {r.doc_id: r for r in pii.digests(pii.find(spark.createDataFrame(seeds + unseen, "doc_id long, text string"))).collect()}
    assert found[90].n_phone == 0 and found[90].spans == "phone:25:37"
    assert found[91].spans == "" and found[0].spans == "phone:25:42"
    assert pii.find(no_docs).count() == 0


def test_any_cue_word_may_end_in_a_colon(spark):
    seeds = [(k, f"Please call office phone: +1 ({k:03d}) 555-{1000 + k} or our contact number: +1 ({k:03d}) 556-{1000 + k}") for k in range(6)]
    unseen = [(90, "Please call office phone: 555-447-1200 for help"), (91, "Our contact number: 555-447-1201"), (92, "Reach Our contact number: 555-447-1202")]
    found = {r.doc_id: r.spans for r in pii.digests(pii.find(spark.createDataFrame(seeds + unseen, "doc_id long, text string"))).collect()}
    assert [found[k] for k in (90, 91, 92)] == ["phone:26:38", "phone:20:32", "phone:26:38"]


def test_identifiers_without_three_digits_in_a_row(spark):
    seeds = [(k, f"Please call office line: +1 ({k:03d}) 555-{1000 + k} for help") for k in range(6)]
    unseen = [(90, "Please call office line: 06-12-34-56-78 for help"), (91, "Please call office line: 0-6-1-2-3-4-5 for help"), (92, "Please call office line: 06-12-34-56-79 or 2024")]
    found = {r.doc_id: r.spans for r in pii.digests(pii.find(spark.createDataFrame(seeds + unseen, "doc_id long, text string"))).collect()}
    assert [found[k] for k in (90, 91, 92)] == ["phone:25:39", "phone:25:38", "phone:25:39"]


def test_masking(spark, docs, rows, no_docs):
    frame = spark.createDataFrame([(1, "to 9@mail.example.com or +1 (017) 555-7713."), (1, "clean"), (None, None), (2, "1.2.3.4")], "doc_id long, text string")
    assert sorted(str(r.text) for r in pii.mask(frame).collect()) == ["None", "[IP]", "clean", "to [EMAIL] or [PHONE]."]
    kept = pii.mask(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert pii.mask(no_docs).count() == 0


def test_no_python_in_the_plans(docs):
    for frame in (pii.digests(pii.find(docs)), pii.mask(docs)):
        assert not re.search("Python|Pandas|Arrow", frame._jdf.queryExecution().executedPlan().toString())


def graph(texts):
    """Edges (rank, pattern, value) -> seed of a small corpus, by plain Python."""
    edges = {}
    word = r"[^\s0-9@]+"

    def around(text, a, b, left, right):
        before, after = text[left:a], text[b:right]
        two, one = re.search(rf"(?:^|(?<=\s))({word} {word}) *$", before), re.search(rf"(?:^|(?<=\s))({word}) *$", before)
        next_one, next_two = re.match(rf"[.,;:!?)]* ({word})(?=\s|$)", after), re.match(rf"[.,;:!?)]* ({word} {word})(?=\s|$)", after)
        out = ["b|" + two[1]] if two else []
        out += [f"m|{one[1]}|{next_one[1]}"] if one and next_one else []
        return [x.lower() for x in out + (["a|" + next_two[1]] if next_two else [])]

    for text in texts:
        text = text or ""
        base = brute(text)
        for kind in pii.KINDS:
            own = [m for k, m in base if k == kind]
            every = list({"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}[kind].finditer(text))
            for m in own:
                at = [x.start() for x in every].index(m.start())
                left, right = every[at - 1].end() if at else 0, every[at + 1].start() if at + 1 < len(every) else len(text)
                value = digits(m[0]) if kind in ("card", "phone") else m[0].lower()
                for p in around(text, m.start(), m.end(), left, right):
                    edges[pii.KINDS.index(kind), p, value] = 1.0
        tokens = list(re.finditer(pii.TOKEN.replace("++", "+"), text))
        for at, m in enumerate(tokens):
            value = re.sub(r"(?<![.,;:!?])[.,;:!?]+$", "", m[0])
            a, b = m.start(), m.start() + len(value)
            if any(s.start() < b and a < s.end() for _, s in base):
                continue
            left, right = tokens[at - 1].end() if at else 0, tokens[at + 1].start() if at + 1 < len(tokens) else len(text)
            for n, kind in enumerate(pii.KINDS):
                if re.search(pii.SHAPE[kind].replace("*+", "*"), value):
                    name = digits(value) if n > 1 else re.sub(r"\[at\]|\(at\)", "@", value).lower()
                    for p in around(text, a, b, left, right):
                        edges.setdefault((n, p, name), 0.0)
    return edges


def scores(edges, rounds=6, support=3, prior=0.05):
    sizes = {}
    for rank, p, _ in edges:
        sizes[rank, p] = sizes.get((rank, p), 0) + 1
    edges = {e: s for e, s in edges.items() if sizes[e[:2]] >= support}
    seed = {}
    for (rank, _, v), s in edges.items():
        seed[rank, v] = max(s, seed.get((rank, v), 0.0))
    score, pattern = {i: s or prior for i, s in seed.items()}, {}
    for _ in range(rounds):
        for key in {e[:2] for e in edges}:
            own = [score[r, v] for r, p, v in edges if (r, p) == key]
            pattern[key] = sum(own) / (len(own) + 1) if sum(x >= 0.7 for x in own) >= support else 0.0
        for i in score:
            lack = 1.0
            for r, p, v in edges:
                if (r, v) == i:
                    lack *= 1 - pattern[r, p]
            score[i] = 1.0 if seed[i] else max(prior, 1 - lack)
    return {(r, p, v): (pattern[r, p], score[r, v]) for r, p, v in edges if not seed[r, v]}


def planted():
    """Seeds after one cue; unseen numbers after it; others after a second cue that only found ones share; and clean rows."""
    rows = [f"Please call office line: +1 ({k:03d}) 555-{1000 + k} for help" for k in range(9)]
    rows += [f"Please call office line: 555-447-12{k:02d} for help" for k in range(4)]
    rows += [f"Visitors should dial 555-447-12{k:02d} at night" for k in range(4)]
    rows += [f"Visitors should dial 555-448-13{k:02d} at night" for k in range(3)]
    rows += [f"a stock of 555-449-14{k:02d} screws was counted" for k in range(8)]
    rows += [f"write to user{k}@mail.example.com about it" for k in range(4)] + ["write to someone[at]mail.example.com about it", "version 2024-01-15 is out", None, ""]
    return rows


def test_found_instances_induce_further_patterns(spark):
    rows = planted()
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.digests(pii.find(frame)).collect()}
    want = {k: t for k, t in enumerate(rows) if t and ("555-447" in t or "555-448" in t or "[at]" in t)}
    for k, t in want.items():
        value = re.search(r"555-44\d-\d{4}|\S+\[at\]\S+", t)
        assert found[k] == f"{'email' if '[at]' in t else 'phone'}:{value.start()}:{value.end()}", t
    base = {k for k, t in enumerate(rows) if brute(t)}
    assert {k for k, s in found.items() if s} == base | want.keys()  # recall and precision of 1


def test_graph_scores_equal_brute_force(spark):
    rows = planted()
    frame = spark.createDataFrame([(k, k, t) for k, t in enumerate(rows)], "rid long, doc_id long, text string")
    got = {(r["rank"], r.pattern, r.value): (r.pattern_score, r.instance_score) for r in pii.score_patterns(pii.extract(frame)).collect()}
    want = scores(graph(rows))
    assert got.keys() == want.keys() and len(want) > 20
    for key, (p, i) in want.items():
        assert abs(got[key][0] - p) < 1e-9 and abs(got[key][1] - i) < 1e-9, key


def test_cues_and_identifiers_of_any_length(spark):
    word = "w" * 300
    rows = [(k, f"the {word} office: +1 ({k:03d}) 555-{1000 + k}") for k in range(9)] + [(90, f"the {word} office: {'a' * 200}[at]example.com"), (91, f"the {word} office: 5-5-5-4-4-7-1-2-0-0")]
    rows += [(100 + k, f"mail {word} {k}user@example.com now") for k in range(9)] + [(120, f"mail {word} {'a' * 200}[at]example.com now")]
    found = {r.doc_id: r.spans for r in pii.digests(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert found[91].startswith("phone:") and found[120] == f"email:{6 + 300}:{6 + 300 + 215}"


def test_many_matches_in_one_text_are_located_in_time(spark):
    import time

    text = " ".join(f"{k:05d}" for k in range(40000)) + " 4111 1111 1111 1111"
    start = time.time()
    assert pii.digests(pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()[0].n_card == len([k for k, _ in brute(text) if k == "card"])
    many = " ".join(f"+1 ({k % 1000:03d}) 555-{k % 10000:04d}" + "," for k in range(20000))
    row = pii.digests(pii.find(spark.createDataFrame([(1, many)], "doc_id long, text string"))).collect()[0]
    base = brute(many)
    assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{m.start()}:{m.end()}" for k, m in base).encode()).hexdigest()
    assert time.time() - start < 60


def test_masking_many_and_overlapping_spans(spark):
    texts = ["a@b.c.d 1.2.3.4 a@1.2.3.4 x " * 300, "+1 (017) 555-7713 4111 1111 1111 1111 and 1.2.3.4", "4111111111111111@mail.example.com"]
    got = {r.doc_id: r.text for r in pii.mask(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        spans = sorted((m.start(), m.end(), pii.KINDS.index(kind)) for kind, m in brute(text))
        out, at = "", 0
        for a, b, rank in spans:
            if a >= at:
                out += text[at:a] + f"[{pii.KINDS[rank].upper()}]"
            at = max(at, b)
        assert got[k] == out + text[at:]
