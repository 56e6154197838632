import random

from pyspark.sql import functions as F

from citeweave.operators import citances, cluster, cocite, components, discover, evaluate, parse, resolve
from citeweave.plans import pipeline


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    for n, m in ((40, 30), (200, 150), (50, 49)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + ([(k, k + 1) for k in range(49)] if m == 49 else []) + [(3, 3), (1, 2), (1, 2)]
        root = list(range(n))
        for a, b in edges:
            root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
        got = {r.node: r.component for r in components.connected_components(spark.createDataFrame([*edges, (None, 1)], "src long, dst long")).collect()}
        assert all(got.get(k, k) == root[k] for k in range(n))
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def records(spark, rows):
    return cluster.block(spark.createDataFrame(rows, "ord long, cleaned string, surname string, year int, title string"))


def test_each_record_is_clustered_once(spark):
    rows = [(1, "a", "Smith", 2020, "Deep learning for citations"), (2, "b", "Smith", 2020, "Deep learning for citations"), (3, "c", "Smith", 2020, "Deep learning of citations"), (4, "d", "Smith", 2020, "Zebra"), (5, "e", "Smith", 2020, None), (6, "f", "Roe", None, "xy"), (7, "g", "Roe", None, "xy"), (8, "h", None, None, "No author at all"), (9, "i", "", None, "No author at all")]
    got = {r.ord: r for r in cluster.cluster(records(spark, rows)).collect()}
    assert len(got) == 9
    assert got[1].cluster_id == got[2].cluster_id == got[3].cluster_id == 1
    assert got[8].cluster_id == got[9].cluster_id == 8 and got[8].tier == "auto"
    assert {got[k].tier for k in (4, 5, 6, 7)} == {"singleton"} and got[6].cluster_id != got[7].cluster_id


def test_tiles_do_not_change_links(spark):
    rng = random.Random(2)
    base = ["graph of trees", "graphs of trees", "theory of numbers", "theories of numbers", "learning"]
    rows = [(k, str(k), "Smith", 2000, rng.choice(base) + rng.choice(["", "s", " again", " two"])) for k in range(80)]
    nodes = cluster.with_vectors(cluster.title_nodes(records(spark, rows)))
    whole = {(r.src, r.dst, round(r.score, 9)) for r in cluster.similar_pairs(nodes, ["block_key", "year"]).collect()}
    assert whole == {(r.src, r.dst, round(r.score, 9)) for r in cluster.similar_pairs(nodes, ["block_key", "year"], tile=3).collect()}
    for kind, least in (("auto", 0.95), ("all", 0.65)):
        want = {r.node: r.component for r in components.connected_components(spark.createDataFrame([(a, b) for a, b, s in whole if s >= least], "src long, dst long")).collect()}
        links = cluster.tile_links(nodes, ["block_key", "year"], tile=3).where(F.col("kind") == kind)
        assert {r.node: r.component for r in components.connected_components(links).collect()} == want


def test_decisions(spark):
    rows = [(1, "a", "Smith", 2020, "Graphs and trees of things"), (2, "b", "Smith", 2020, "Graphs and trees of thinks"), (3, "c", "Doe", 2001, None)]
    decided = resolve.decide(cluster.cluster(records(spark, rows)))
    by = {r.ord: r for r in decided.collect()}
    assert by[3].action == "review" and by[3].reason == "singleton with no title"
    assert by[1].action == by[2].action == "canonical" and by[1].group_id == by[2].group_id == 1
    assert resolve.canonical_rows(decided).first().raw_variants == ["a", "b"]


def test_sample_references(spark):
    sample = [
        ("paper-a", "Smith, J. (2020). Deep learning for citations. Journal A."), ("paper-b", "Smith J 2020. Deep learning for citations. J. A."), ("paper-a", "Hastie, T. and Tibshirani, R. (1990). Generalized Additive Models. Chapman."),
        ("paper-c", "Hastie, T. & Tibshirani, R. (1990). Generalized Additive Models. CRC"), ("paper-b", "Wood, S. (2006). Generalized additive models: an introduction with R. CRC."), ("paper-b", "23"),
    ]
    out = pipeline.resolve_refs(spark.createDataFrame([(k, *r) for k, r in enumerate(sample)], "ord long, citing_paper_id string, raw string"))
    got = [(r.canonical_id, r.cocitation_count) for r in out["ranked"].orderBy("rank").collect()]
    assert ("ca0da8b9decc", 1) in got and ("ab67afba67cd", 2) in got


def test_citances(spark):
    pages = spark.createDataFrame([("p", 1, "Prior work [1] and later work [2-3], again [1]. We follow Smith (2020) in our setup (see Doe, 2001; Roe, 1999)."), ("p", 2, "[9] and (2020).")], "paper string, page int, text string")
    refs = spark.createDataFrame([("p", 1, "J. Smith. 2020. A title."), ("p", 2, "Doe, J. (2001). Title one."), ("p", 3, "Doe, K. (2001). Title two.")], "paper string, ordinal int, raw_ref string")
    got = citances.link_all(pages, refs).collect()
    assert sorted((r.raw_marker, r.start) for r in got if r.style == "numbered_bracket" and r.raw_ref) == [("[1]", 11), ("[2-3]", 30), ("[2-3]", 30)]
    assert [r.link_method for r in got if r.raw_marker == "[9]"] == ["unlinked"]
    assert [(r.link_method, r.link_confidence) for r in got if r.style == "narrative_author_year"] == [("author_year_unique", 0.9)]
    assert [r.raw_ref for r in got if r.style == "paren_author_year"] == [None]
    assert citances.violations(citances.link_all(pages, refs)).count() == 0


def split(spark, section):
    return spark.createDataFrame([(section,)], "s string").select(parse.split_references(F.col("s")).alias("r")).first().r


def test_splitting(spark):
    assert split(spark, "noise\n[1] Smith, J. (2020). A long title.\n[2] Doe, K. (2021). Another\n long title.") == ["[1] Smith, J. (2020). A long title.", "[2] Doe, K. (2021). Another long title."]
    assert split(spark, "1. Smith, J. (2020). Title.\n\n2. Doe, K. (2021). Title.") == ["1. Smith, J. (2020). Title.", "2. Doe, K. (2021). Title."]
    assert split(spark, "Smith, J. (2020). A title.\nwith a tail\n\nDoe, K. (2021). A title.") == ["Smith, J. (2020). A title. with a tail", "Doe, K. (2021). A title."]
    assert split(spark, "Smith, J. (2020). A hyphen-\nated title.\nDoe, K. (2021). A title here.") == ["Smith, J. (2020). A hyphenated title.", "Doe, K. (2021). A title here."]
    assert split(spark, "") == []


def test_sections_and_quality(spark):
    pages = spark.createDataFrame([("p", 1, "On Things That Matter\ndoi:10.1234/abc.d. arXiv: 2101.01234v2 of 2019\nReferences are made."), ("p", 2, "Body.\n\nReferences\n[1] Smith, J. (2020). A title.\n[2] Doe, K. (2021). A title."), ("p", 3, "[3] Roe, L. (2022). A third one.\nAppendix\nmore"), ("q", 1, "none")], "paper string, page int, text string")
    docs = parse.reference_section(parse.documents(pages))
    section = {r.paper: r.section for r in docs.collect()}
    assert section["q"] is None and section["p"].start_page == 2 and section["p"].heading == "References"
    refs = parse.references(docs)
    assert refs.count() == 3
    quality = {r.paper: r for r in parse.quality(refs, docs).collect()}
    assert quality["q"].notes == ["no references extracted"] and quality["p"].n_refs == 3 and quality["p"].needs_fallback
    head = {r.paper: r for r in parse.header(docs).collect()}["p"]
    assert (head.doi, head.arxiv_id, head.year, head.title) == ("10.1234/abc.d", "2101.01234v2", 2019, "On Things That Matter")
    assert {r.page: r.text for r in parse.body_pages(docs).where("paper = 'p'").collect()}[2] == "Body.\n\n"


def test_discovery(spark):
    works = spark.createDataFrame([(1, 2018, 50, 1.0, "a.pdf"), (2, 2024, 10, 3.0, "b.pdf"), (3, 2010, 1000, 3.0, None)], "work_id long, year int, cited_by_count int, relevance_score double, pdf_url string")
    ids = lambda how, **more: [r.work_id for r in discover.search(works, 3, how, **more).collect()]
    assert ids("recency", require_pdf=False) == [2, 1, 3] and ids("citations", require_pdf=False) == [3, 1, 2]
    assert ids("relevance", require_pdf=False) == [3, 2, 1] and ids("citations") == [1, 2]
    people = spark.createDataFrame([("A111", "Jane Doe", 10), ("A222", "Jane Doe", 50000), ("A333", "Roe", 7)], "author_id string, display_name string, cited_by_count int")
    assert discover.resolve_author(people, "jane doe").first().author_id == "A222"
    assert discover.resolve_author(people, "https://x.org/A333").first().author_id == "A333"
    assert discover.resolve_author(people, "nobody").count() == 0


def test_evaluation(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None), ("c", None)], "gold string, predicted string")
    got = evaluate.pair_f1(rows).first()
    assert (got.tp, got.fp, got.fn, got.precision, got.recall) == (1, 1, 0, 0.5, 1.0)
    assert evaluate.purity(rows).first().purity == 0.75
    a = spark.createDataFrame([("p", 1, "Smith 2020 deep learning"), ("p", 2, "Unknown thing")], "paper string, ord int, ref string")
    b = spark.createDataFrame([("p", 1, "Smith, 2020: Deep Learning."), ("q", 1, "Other")], "paper string, ord int, ref string")
    assert {r.paper: (r.n_predicted, r.n_truth, r.matched) for r in evaluate.greedy_matches(a, b).collect()} == {"p": (2, 1, 1), "q": (0, 1, 0)}


def test_ranks_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(f"id{k}", k % 7, f"title {k % 5}") for k in range(100)], "canonical_id string, cocitation_count int, title string")
    one = {r.canonical_id: r["rank"] for r in cocite.rank_all(rows, partitions=1).collect()}
    assert one == {r.canonical_id: r["rank"] for r in cocite.rank_all(rows, partitions=7).collect()}
    assert sorted(one.values()) == list(range(1, 101))
    assert [r["rank"] for r in cocite.top(rows, 5).collect()] == [1, 2, 3, 4, 5]
