"""Clusters, URL verdicts and ranked search: against SQL, brute force and odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF, same_rows
from vidspark.llm import clustering, queries, ranking, urls
from vidspark.llm._common import read_table

VECTORS, PAGES, DOCS = "vec_id long, embedding array<double>, label int", "page_id long, url string, verdict int, extra string", "doc_id long, text string, rank string"


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_url_filters", "op13_ranked_search"])
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, name, sf):
    same_rows(queries.QUERIES[name](spark, sf), queries.SQL[name], sf)


# Clusters.


@pytest.mark.parametrize("kind", ["random", "grid", "equal", "large"])
def test_nearest_is_exact(kind):
    rng = np.random.default_rng(3)
    if kind == "grid":  # many ties
        centroids, vectors = rng.integers(0, 2, (40, 64)), rng.integers(0, 2, (500, 64))
        centroids[:, 6:], vectors[:, 6:] = 0, 0
    elif kind == "equal":
        centroids, vectors = np.ones((40, 64), int), rng.integers(-3, 3, (50, 64))
    elif kind == "large":
        centroids, vectors = (rng.integers(-(2**27), 2**27, (n, 64)) for n in (40, 300))
        vectors[:100] = centroids[rng.integers(0, 40, 100)] + rng.integers(-1, 2, (100, 64))
    else:
        centroids = np.repeat(rng.integers(-500, 500, (5, 64)), 8, 0) + rng.integers(-50, 50, (40, 64))
        vectors = centroids[rng.integers(0, 40, 3000)] + rng.integers(-9, 9, (3000, 64))
    square = ((vectors[:, None] - centroids[None]) ** 2).sum(2)
    visits = []
    which, best = clustering.nearest(clustering.build(centroids), vectors, visits)
    assert (which == square.argmin(1)).all() and (best == square.min(1)).all()
    if kind == "random":
        assert sum(visits) < 0.5 * square.size  # far subtrees are passed over


def test_tree_holds_each_centroid_once():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 40):
        tree = clustering.build(rng.integers(0, 3, (n, 64)))
        assert sorted(tree.point) == list(range(n))
        assert sorted(k for k in [*tree.inner, *tree.outer] if k > 0) == list(range(1, n))


def brute_clusters(rows, clusters, rounds):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "")
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(near(v)[1], []).append(v)
        for k, some in members.items():
            centroids[k] = [sum(xs) // len(some) for xs in zip(*some, strict=True)]
    out = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, k in out:
        inertia[k] += d
    return Counter((i, k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, d, k in out)


@pytest.mark.parametrize("clusters,rounds", [(7, 3), (40, 5), (200, 2)])
def test_clusters_of_odd_vectors_equal_brute_force(spark, clusters, rounds):
    rng = random.Random(clusters)
    sound = lambda: [rng.choice([-1.0, -0.3, 0.0, 0.004, 0.7]) for _ in range(64)]
    rows = [(i, sound()) for i in range(60)]
    rows += [rows[3], rows[3], (3, sound()), (None, sound()), (None, None), (70, []), (71, [0.5] * 63), (72, [0.5] * 65), (73, [None] * 64), (74, [float("nan")] * 64), (75, [float("inf"), *[0.0] * 63]), (76, [2.0**-1074] * 64)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS).repartition(3)
    out = clustering.cluster_vectors(frame, clusters, rounds)
    assert out.columns == ["vec_id", "embedding", "label", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, out.drop("embedding", "label").collect())) == brute_clusters(rows, clusters, rounds)


def test_no_vectors_and_clashing_columns(spark):
    empty = clustering.cluster_vectors(spark.createDataFrame([], VECTORS).withColumn("cluster", F.lit("x")))
    assert empty.count() == 0 and dict(empty.dtypes)["cluster"] == "int"
    huge = clustering.cluster_vectors(spark.createDataFrame([(1, [1e300] * 64, 0), (2, [-1e300] * 64, 0)], VECTORS), 1)
    assert huge.count() == 2


# URLs.


def test_hosts_paths_and_rules(spark):
    cases = {
        "https://WWW.Example.com/en/a?b#c": ("www.example.com", "/en/a", "www.example.com/en/"),
        "http://a.www.example.com/en/": ("a.www.example.com", "/en/", "www.example.com/en/"),
        "http://x.example.com/en/1": ("x.example.com", "/en/1", "example.com/en/"),
        "http://example.com/EN/1": ("example.com", "/EN/1", "com/"),
        "http://myexample.com/en/1": ("myexample.com", "/en/1", "com/"),
        "http://com/": ("com", "/", "com/"),
        "http://a.com": ("a.com", "", None),
        "http://a.net/es/x": ("a.net", "/es/x", "net/es/"),
        "http://a.net/esx": ("a.net", "/esx", None),
        "x://a.com?u=http://b.net/fr/": ("a.com", "", None),
        "//a.com/": ("", "", None),
        "": ("", "", None),
        "http://ÄÖ.com/ß\n/x": ("ÄÖ.com", "/ß\n/x", "com/"),
        None: ("", "", None),
    }
    rows = spark.createDataFrame([(u,) for u in cases], "url string")
    host, path = urls.host_and_path(F.col("url"))
    got = rows.withColumns({"host": host, "path": path}).withColumn("rule", urls.rule_of(F.col("host"), F.col("path"))[0]).collect()
    assert {r.url: (r.host, r.path, r.rule) for r in got} == cases


def brute_verdicts(pages):
    """Verdicts and mean scores, by the definitions."""
    facts = []
    for url in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [(len(h + p), said) for said, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        text = re.sub("[^a-z0./_%:~-]", "?", re.sub("[0-9]", "0", re.sub("[A-Z]", lambda c: c[0].lower(), host + path)))
        facts.append((max(fit)[1] if fit else None, hashlib.md5((url or "").encode()).hexdigest()[0] in urls.HELD_OUT, "\1" * urls.ORDER + text + "\2"))
    seen = {said: Counter() for said in ("allow", "block")}
    for said, held, text in facts:
        if said and not held:
            for i in range(urls.ORDER, len(text)):
                seen[said].update((text[i - k : i], text[i]) for k in range(urls.ORDER + 1))
    totals = {said: Counter() for said in seen}
    kinds = {said: Counter() for said in seen}
    for said, counts in seen.items():
        for (context, _), n in counts.items():
            totals[said][context] += n
            kinds[said][context] += 1

    def likelihood(said, context, c):
        below = likelihood(said, context[1:], c) if context else 1.0 / urls.ALPHABET
        if totals[said][context] < urls.MIN_SEEN:
            return below
        return (seen[said][context, c] + kinds[said][context] * below) / (totals[said][context] + kinds[said][context])

    means = []
    for _, _, text in facts:
        scores = [math.floor(1000 * (math.log(likelihood("allow", text[i - 3 : i], text[i])) - math.log(likelihood("block", text[i - 3 : i], text[i])))) for i in range(3, len(text))]
        means.append(math.floor(sum(scores) / len(scores)))
    a, b = ([m for m, (said, held, _) in zip(means, facts, strict=True) if held and said == want] for want in ("allow", "block"))
    gain = lambda t: sum(m >= t for m in a) * len(b) + sum(m < t for m in b) * len(a)
    least = min({0, *(t + k for t in {*a, *b} for k in (0, 1))}, key=lambda t: (-gain(t), abs(t), t)) if a and b else 0
    return [(said or ("allow" if m >= least else "block"), None if said else m) for (said, _, _), m in zip(facts, means, strict=True)]


def test_verdicts_equal_brute_force(spark):
    pages = [r.url for r in read_table(spark, SF, "pages").union(read_table(spark, "/root/testdata/sf0.01", "pages")).select("url").collect()]
    pages += [None, "", "no url", "http://x.org/" + "ab/" * 20_000, "http://Ü.org/%C3", pages[0], pages[0]]
    frame = spark.createDataFrame([(i, u, 7, None) for i, u in enumerate(pages)], PAGES)
    out = urls.filter_urls(frame)
    assert out.columns == ["page_id", "url", "extra", "host", "path", "rule", "verdict", "url_score"]
    got = {r.page_id: (r.verdict, r.url_score) for r in out.collect()}
    assert [got[i] for i in range(len(pages))] == brute_verdicts(pages)


def test_url_models_tell_hosts_apart(spark):
    """Held-out accuracy: hosts that no rule names, written like those that rules accept or reject."""
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    good, bad = ([f"http://{word(x)}.{top}" for _ in range(400)] for x, top in (("aeioulmn", "com/a"), ("xzqkwvjy", "net/es/a")))
    unseen = [(f"http://{word(x)}.org/a", want) for x, want in (("aeioulmn", "allow"), ("xzqkwvjy", "block")) for _ in range(100)]
    frame = spark.createDataFrame([(u,) for u in [*good, *bad, *(u for u, _ in unseen)]], "url string")
    got = {r.url: r.verdict for r in urls.filter_urls(frame).collect()}
    assert sum(got[u] == want for u, want in unseen) >= 190


def test_urls_without_rule_decided_pages_and_no_pages(spark):
    out = urls.filter_urls(spark.createDataFrame([(1, "http://a.org/", 0, "x"), (2, None, 0, "y")], PAGES)).collect()
    assert {(r.verdict, r.url_score, r.rule) for r in out} == {("allow", 0, None)}
    assert urls.filter_urls(spark.createDataFrame([], PAGES)).count() == 0


def test_url_plan_is_native(spark):
    plan = urls.filter_urls(read_table(spark, SF, "pages").select("page_id", "url"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Ranked search.


def brute_ranking(docs, items, top):
    terms = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    lower = lambda t: re.sub("[A-Z]", lambda c: c[0].lower(), t)
    bags = [(i, Counter(map(lower, terms(text)))) for i, text in docs]
    bags = [(i, bag) for i, bag in bags if bag]
    n_docs, n_terms, df = len(bags), sum(sum(b.values()) for _, b in bags), Counter(t for _, b in bags for t in b)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(map(lower, terms(text)))
    out = []
    for item, some in asked.items():
        scored = []
        for i, bag in bags:
            m = 100 - 50 + (50 * sum(bag.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in some if bag[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, i, -minus) for k, (minus, _, _, i) in enumerate(sorted(scored, key=lambda s: s[:3])[:top])]
    return Counter(out)


@pytest.mark.parametrize("leaf,docs_a_tree,levels", [(1, 1000, 48), (2, 40, 2), (32, 1 << 15, 48)])
def test_ranking_equals_brute_force(spark, monkeypatch, leaf, docs_a_tree, levels):
    rng = random.Random(leaf)
    word = lambda: f"w{min(int(rng.expovariate(0.15)), 60)}"
    docs = [(i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(300)]
    docs += [(400 + i, docs[5][1]) for i in range(80)] + [docs[7], docs[7], (None, docs[5][1]), (None, docs[9][1]), (500, None), (501, ""), (502, "-- !"), (503, "W1 Éa É W1 w1É"), (504, "w3 " * 30_000), (-5, docs[5][1])]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 12)))) for i in range(25)] + [(30, None), (31, "--"), (32, "nowhere"), (None, "w1 éa Éa"), (2, "w40 w41"), (33, docs[5][1])]
    for module_name, value in (("LEAF", leaf), ("TREE_DOCS", docs_a_tree), ("LEVELS", levels)):
        monkeypatch.setattr(ranking, module_name, value)
    vectors = ranking.term_vectors(spark.createDataFrame(docs, "doc_id long, text string"), np.zeros(0, np.uint64))
    assert vectors.count() == len(docs) - 3
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], DOCS).repartition(3)
    want = brute_ranking(docs, items, 20)
    for block in (1 << 22, 60):  # one block, and several
        got = ranking.ranked_search(frame, spark.createDataFrame(items, "item_id int, text string"), 20, block)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(map(tuple, got.collect())) == want


def test_search_passes_over_most_of_a_tree():
    rng = np.random.default_rng(6)
    rows = [np.unique(rng.zipf(1.3, 30) % 500) for _ in range(4000)]
    bounds = np.append(0, np.cumsum([len(r) for r in rows]))
    tree = ranking.DocumentTree(np.arange(4000), np.full(4000, 100), bounds, np.concatenate(rows), np.ones(bounds[-1], int))
    best = []
    nodes, docs = tree.search(np.array([3, 40, 400]), np.array([10, 500, 3000]), best, 5)
    scores = sorted((sum(w * ranking.measure(1, 100) for t, w in ((3, 10), (40, 500), (400, 3000)) if t in r), -i) for i, r in enumerate(rows))
    assert sorted(best) == scores[-5:] and docs < 2000 and nodes < len(tree.low)


def test_ranking_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert ranking.ranked_search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]
    assert ranking.ranked_search(spark.createDataFrame([(1, "a", "b")], DOCS), items).count() == 0
    assert ranking.ranked_search(docs, spark.createDataFrame([(1, "a")], items.schema)).count() == 0
    assert ranking.ranked_search(spark.createDataFrame([(1, "b c", "b")], DOCS), spark.createDataFrame([(1, "a")], items.schema)).count() == 0
