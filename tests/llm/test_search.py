"""Lexical search, whitening and nearest neighbours against brute force, with nulls, empties, ties, repeats and clashing columns."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hallspark.llm import ann, lexical, queries, whitening
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k=20):
    """(item position, rank, doc_id, score)"""
    counts = [(d, Counter(terms_of(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for at, (_, text) in enumerate(items):
        scored = []
        for d, c in counts:
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms_of(text) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(at, r + 1, None if no else d, -s) for r, (s, no, d) in enumerate(sorted(scored)[:k])]
    return out


def frame(spark, rows, schema):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], schema + ", q long, term string")


@pytest.mark.parametrize("options", [{}, {"shard_terms": 300, "block_items": 3, "k": 4}])
def test_search(spark, options):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["Ñandú", "ñandú", "naïve", "x9", "A_b", "東京"]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for k in range(150)]
    docs += [(k + 500, docs[7][1]) for k in range(30)] + [(7, docs[7][1]), (None, docs[7][1]), (None, docs[9][1])]
    docs += [(900, None), (901, ""), (902, " .,;\n\t"), (903, " ".join(rng.choice(words) for _ in range(50_000)))]
    rng.shuffle(docs)
    items = [(k % 7, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for k in range(10)] + [(20, None), (21, "..."), (22, "unknownterm"), (None, docs[0][1]), (23, (docs[1][1] or "") + " naïve" * 5)]
    k = options.get("k", 20)
    index = lexical.build_index(frame(spark, docs, "doc_id long, text string"), **{o: v for o, v in options.items() if o == "shard_terms"})
    rows = lexical.search(index, frame(spark, items, "item_id long, text string"), k=k, **{o: v for o, v in options.items() if o == "block_items"}).collect()
    expected = Counter((items[at][0], r, d, s) for at, r, d, s in brute_search(docs, items, k))
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in rows) == expected
    assert (index.count() > 5) == bool(options)


def test_search_empty(spark):
    docs, items = frame(spark, [(1, "a b")], "doc_id long, text string"), frame(spark, [(1, "a c")], "item_id long, text string")
    assert lexical.search(lexical.build_index(docs.where("false")), items).count() == 0
    assert lexical.search(lexical.build_index(docs), items.where("false")).count() == 0
    assert [tuple(r) for r in lexical.search(lexical.build_index(docs), items).collect()] == [(1, 1, 1, brute_search([(1, "a b")], [(1, "a c")])[0][3])]


def test_best_positions_stop_early_and_keep_ties():
    rng = np.random.default_rng(2)
    n = 4000
    doc = np.concatenate([np.arange(n), np.arange(n)])
    impact = np.concatenate([np.sort(rng.integers(1, 10**6, n))[::-1], np.sort(rng.integers(1, 10**6, n))[::-1]])
    impact[:40] = impact[n : n + 40] = 10**7  # equal sums: the ids decide
    lists = lexical.ImpactLists(np.repeat([0, 1], n), doc, impact, 2, n)
    top = lexical.Top(5)
    ids = np.arange(n)[::-1].copy()
    top.shard = ids, np.ones(n, bool)
    accessed = lists.search(np.array([0, 1]), np.array([1, 2]), top, 5)
    assert top.ids.tolist() == sorted(ids[:40])[:5] and (top.scores == 3 * 10**7).all()
    assert accessed < n


def test_search_query_is_whole(spark):
    rows = queries.op11_ranked_lexical_search(spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in rows) == Counter((items[at][0], r, d, s) for at, r, d, s in brute_search(docs, items))


VECTORS = "vec_id long, embedding array<float>, label int, x long, unit string"


def vectors_of(spark, vectors, ids=None):
    return spark.createDataFrame([(k if ids is None else ids[k], None if v is None else [None if c is None else float(c) for c in v], 1, 2, "u") for k, v in enumerate(vectors)], VECTORS)


BAD = [None, [], [1.0, None, 2.0, 1.0], [1.0, float("nan"), 0.0, 1.0], [float("inf"), 1.0, 1.0, 1.0]]


def brute_whitening(vectors):
    good = [v for v in vectors if v and None not in v and all(math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in good]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    d = np.array([[(n * a - b) / n for a, b in zip(r, s, strict=True)] for r in x])
    return n, deviation, d, *np.linalg.eigh(d.T @ d / n)


def test_whitening(spark):
    rng = np.random.default_rng(5)
    vectors = [*(rng.normal(size=(300, 4)) * [1, 0.5, 0.5, 0.01] + [0, 3, -7, 0.2]).astype(np.float32).tolist(), *BAD, [1.0, 2.0], [0.0, 0.0, 0.0, 0.0]]
    vectors += [vectors[3]] * 20
    ids = [*range(len(vectors) - 2), None, 4]
    n, deviation, d, values, x = brute_whitening([v for v in vectors if not v or len(v) == 4])
    rows = whitening.whiten(vectors_of(spark, vectors, ids).repartition(7), components=8).collect()
    taken = [i for i, v in zip(ids, vectors, strict=True) if v and len(v) == 4 and None not in v and all(math.isfinite(c) for c in v)]
    assert Counter((r.vec_id, r.n, r.deviation) for r in rows if r.component == 1) == Counter((i, n, e) for i, e in zip(taken, deviation, strict=True))
    assert len(rows) == 4 * n and {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9
    place = {i: k for k, i in enumerate(taken)}
    for c in (1, 2, 3, 4):
        own = {r.vec_id: r for r in rows if r.component == c}
        w = d @ x[:, -c] / math.sqrt(values[-c])
        sign = np.sign(own[0].whitened * w[0])
        assert all(abs(sign * r.whitened - w[place[i]]) < 1e-8 for i, r in own.items() if i != 4)
        assert all(abs(r.explained - values[-c] / values.sum()) < 1e-12 for r in own.values())


def test_whitening_edges(spark):
    assert whitening.whiten(vectors_of(spark, BAD)).count() == 0
    assert whitening.whiten(vectors_of(spark, [[1.0]]).where("false")).count() == 0
    rows = whitening.whiten(vectors_of(spark, [[1.0, 2.0, 3.0]] * 3)).collect()
    assert {(r.deviation, r.whitened, r.explained, r.identity_error) for r in rows} == {(0, 0.0, 0.0, 0.0)} and len(rows) == 9
    rows = whitening.whiten(vectors_of(spark, [[1.0, 2.0, 3.0], [2.0, 2.0, 3.0]])).collect()  # one dimension varies
    assert sorted((r.component, abs(round(r.whitened, 9)), r.explained) for r in rows) == [(1, 1.0, 1.0)] * 2 + [(2, 0.0, 0.0)] * 2 + [(3, 0.0, 0.0)] * 2
    big = [[2.0**39] * 4, [-(2.0**39)] * 4, [0.0] * 4]  # the exact sum has more than 64 bits
    assert {r.deviation for r in whitening.whiten(vectors_of(spark, big)).collect()} == {None, 0}
    assert whitening.whiten(vectors_of(spark, [[2.0**41, 1.0], [1.0, 2.0]])).select("vec_id").distinct().count() == 1


@pytest.mark.parametrize("values", [[1.0] * 5 + [2.0] * 5 + [3.0], [1, 1 + 1e-6, 1 + 2e-6, 5, 5 + 1e-9, 7] * 3, [1, 1 + 1e-12, 2, 2 + 1e-13, 1e-8, 3, 3 + 1e-7], list(range(1, 40))])
def test_clustered_eigenvalues(values):
    n = len(values)
    q = np.linalg.qr(np.random.default_rng(n).normal(size=(n, n)))[0]
    a = 1e6 * (q * np.array(values, float)) @ q.T
    a = (a + a.T) / 2
    e, x = whitening.eigenvectors(a)
    assert (np.diff(e) <= 0).all() and np.abs(e / 1e6 - np.sort(values)[::-1]).max() < 1e-13 * max(values)
    assert np.abs(x.T @ x - np.eye(n)).max() < 5e-15
    assert np.abs(a @ x - x * e).max() < 1e-14 * np.abs(a).max() * n


def brute_nearest(vectors, ids, k):
    good = [j for j, v in enumerate(vectors) if v and None not in v and all(math.isfinite(c) for c in v) and any(v)]
    out = Counter()
    for j in good:
        if ids[j] is not None and ids[j] % 50 == 0:
            a = np.array(vectors[j], float)
            near = [(-(a @ (b := np.array(vectors[i], float))) / np.linalg.norm(a) / np.linalg.norm(b), ids[i] is None, ids[i] or 0) for i in good if i != j and len(vectors[i]) == len(a)]
            near = sorted((round(s, 12), no, i) for s, no, i in near)[:k]
            out.update((ids[j], r + 1, None if no else i, round(-s, 9)) for r, (s, no, i) in enumerate(near))
    return out


@pytest.mark.parametrize("options", [{}, {"shard_rows": 100}])
def test_nearest(spark, options):
    rng = np.random.default_rng(6)
    vectors = [*rng.normal(size=(500, 12)).astype(np.float32).tolist(), *BAD, [0.0] * 12, [1.0, 2.0], [2.0, 1.0], [3.0, 3.0, 3.0]]
    vectors += [vectors[0]] * 300 + [[2 * c for c in vectors[0]]] * 3
    ids = [*range(len(vectors) - 3), None, 50, 50]
    ids[507], ids[508] = 5000, 5050  # a length of two, both queries; then a length of its own
    rows = ann.nearest(vectors_of(spark, vectors, ids).repartition(5), F.col("vec_id") % 50 == 0, **options).collect()
    found = Counter((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in rows)
    expected = brute_nearest(vectors, ids, 5)
    assert (found & expected).total() >= 0.98 * expected.total() and found.total() == expected.total()
    crowd = Counter({r: n for r, n in expected.items() if r[0] in (0, 550, 600)})  # copies tie: the least ids, exactly
    assert crowd <= found


def test_nearest_edges(spark):
    asked = F.col("vec_id") % 50 == 0
    assert ann.nearest(vectors_of(spark, BAD), asked).count() == 0
    assert ann.nearest(vectors_of(spark, [[1.0]]).where("false"), asked).count() == 0
    assert ann.nearest(vectors_of(spark, [[1.0, 2.0]]), asked).count() == 0
    rows = ann.nearest(vectors_of(spark, [[1e-300, 0.0], [1e30, 0.0], [0.0, 5.0]]), asked).collect()  # floats: the first is zero
    assert not rows


def test_every_vector_is_reached():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 8))
    x[200:700] = x[0] + 1e-4 * rng.normal(size=(500, 8))  # a crowd of near copies
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    graph = ann.Graph(x, degree=6, beam=12, alpha=1.2)
    assert graph.reached().all()
    assert all(len(set(r[r >= 0])) == (r >= 0).sum() and k not in r for k, r in enumerate(graph.edges))


def test_recall_of_the_query(spark):
    rows = queries.op13_nearest_neighbours(spark, SF).collect()
    given = queries.table(spark, SF, "embeddings").collect()
    expected = brute_nearest([r.embedding for r in given], [r.vec_id for r in given], 5)
    found = Counter((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in rows)
    assert found.total() == expected.total() and (found & expected).total() >= 0.95 * expected.total()
