import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendwise.llm import cross_polytope, merkle, queries, vector_codes

from .helpers import frame

VECTORS = "vec_id long, embedding array<float>, label int, code string, error string"


def vectors(spark, rows):
    """embeddings with columns whose names clash with those of the results"""
    return spark.createDataFrame([(i, v, lab, "x", "y") for i, v, lab in rows], VECTORS)


def odd_vectors(rng, n=700, dims=16):
    base = rng.normal(0, 1, (9, dims))
    rows = [(i, (base[i % 9] + rng.normal(0, 0.3, dims)).tolist(), int(i % 4)) for i in range(n)]
    rows += [(n + i, rows[5][1], 1) for i in range(300)]  # one very common vector
    rows += [(3, rows[3][1], 3), (3, rows[4][1], None), (None, rows[6][1], None), (9001, None, 1), (9002, [float("nan")] * dims, 1),
             (9003, [None] + [0.1] * (dims - 1), 2), (9004, [float("-inf")] * dims, 2), (9050, [0.0] * dims, None), (9006, [1.0] * (dims - 3), 2), (9007, [], 2)]
    return rows


def usable(rows):
    return [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]


def lloyd(rows, parts, entries, rounds, scale):
    """Every part against every entry, in plain Python integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, np.float32(r[1]).tolist()))
    dims = -(-max(len(r[1]) for r in rows) // parts) * parts
    x = np.zeros((len(rows), dims), object)
    for i, (_, v, _) in enumerate(rows):
        x[i, :len(v)] = [int(np.floor(scale * float(np.float32(c)))) for c in v]
    x = x.reshape(len(rows), parts, -1).transpose(1, 0, 2)
    books = [list(map(list, x[p][:entries])) for p in range(parts)]

    def assign():
        codes, errors = np.zeros((len(rows), parts), int), np.zeros(len(rows), object)
        for p in range(parts):
            for i, point in enumerate(x[p]):
                d = [sum((a - b) ** 2 for a, b in zip(point, c)) for c in books[p]]
                codes[i, p] = d.index(min(d))
                errors[i] += min(d)
        return codes, errors

    for _ in range(rounds):
        codes, _ = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = x[p][codes[:, p] == e]
                if len(own):
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    codes, errors = assign()
    text = ",".join(str(c) for p in books for e in p for c in e)
    return [(r[0], "".join(f"{c:02x}" for c in code), int(e), r[2]) for r, code, e in zip(rows, codes, errors)], hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("shard", [64, 2048])
def test_vector_codes_match_plain_lloyd(spark, shard):
    rows = odd_vectors(np.random.default_rng(4), n=260)
    expect, sha = lloyd(usable(rows), 8, 16, 6, 4096)
    by_label = {}
    for _, _, e, lab in expect:
        by_label[lab] = by_label.get(lab, 0) + e
    got = vector_codes.code_table(vectors(spark, rows).repartition(3), shard=shard).collect()
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, c, e, by_label[lab], sha) for i, c, e, lab in expect), key=key)


def test_vector_codes_few_none_and_huge(spark):
    few = [(2, [1.0, -2.0], 1), (1, [0.5, 0.25], None)]
    expect, sha = lloyd(few, 8, 16, 6, 4096)
    assert sorted((r.vec_id, r.code, r.error, r.codebooks_sha256) for r in vector_codes.code_table(vectors(spark, few)).collect()) == sorted(
        (i, c, e, sha) for i, c, e, _ in expect)
    assert vector_codes.code_table(vectors(spark, [])).count() == 0
    assert vector_codes.code_table(vectors(spark, [(1, None, 2)])).count() == 0
    with pytest.raises(Exception, match="too large"):
        vector_codes.code_table(vectors(spark, [(1, [3e30, 1.0], 2)])).count()


def test_cover_tree_invariants():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.integers(-900, 900, (500, 4)), np.full((80, 4), 7)])
    tree = vector_codes.CoverTree.build(points)
    assert sorted(tree.order) == list(range(len(points)))
    for i in range(len(tree.begin)):
        own = points[tree.order[tree.begin[i]:tree.end[i]]]
        assert (tree.total[i] == own.sum(0)).all()
        far = np.sqrt(((own - tree.centre[i]) ** 2).sum(1))
        assert far.max() == tree.radius[i]
        if tree.children[i]:
            kids = range(tree.child[i], tree.child[i] + tree.children[i])
            assert (tree.centre[kids[0]] == tree.centre[i]).all() and tree.begin[kids[0]] == tree.begin[i] and tree.end[kids[-1]] == tree.end[i]
            apart = [np.sqrt(((tree.centre[a] - tree.centre[b]) ** 2).sum()) for a in kids for b in kids if a < b]
            assert all(d > tree.radius[i] / 2 for d in apart) and all(tree.radius[k] <= tree.radius[i] / 2 for k in kids)
    book = rng.integers(-900, 900, (6, 4))
    whole = sum(len(w) for kind, w, _ in tree.assign(points, book) if kind == 0)
    assert whole  # some subtrees are assigned without looking at their points


def exact_neighbours(rows, k, every=50):
    own = {}
    for i, v, _ in usable(rows):
        if i is not None and any(v):
            own.setdefault(i, set()).add(tuple(np.float32(v).tolist()))
    dims = max(len(v) for vs in own.values() for v in vs)
    flat = [(i, np.pad(np.array(v), (0, dims - len(v)))) for i, vs in own.items() for v in vs]
    ids, x = np.array([i for i, _ in flat]), np.stack([v for _, v in flat])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in (i for i in own if i % every == 0):
        best = {}
        for row in np.flatnonzero(ids == q):
            for c, s in zip(ids, u @ u[row]):
                if c != q:
                    best[int(c)] = max(best.get(int(c), -2), s)
        out[q] = sorted(((-round(s, 9), c) for c, s in best.items()))[:k]
    return out


def test_cross_polytope_finds_what_brute_force_finds(spark):
    rows = odd_vectors(np.random.default_rng(6))
    rows += [(9100, [x * 4 for x in rows[100][1]], None), (9150, [-x for x in rows[150][1]], None), (9200, [1e30] * 16, None)]
    expect = exact_neighbours(rows, 5)
    v = cross_polytope.usable(vectors(spark, rows)).cache()
    for params in ({}, {"chunk": 40, "block": 3}):
        got = cross_polytope.nearest(v, v.where("id % 50 = 0"), 5, **params).collect()
        found = {}
        for r in sorted(got, key=lambda r: r["rank"]):
            found.setdefault(r.query_id, []).append((-round(r.score, 9), r.vec_id))
        assert set(found) == set(expect)
        assert all(len(x) == 5 and [s for s, _ in x] == sorted(s for s, _ in x) for x in found.values())
        hits = sum(len(set(expect[q]) & set(found[q])) for q in expect)
        assert hits / sum(map(len, expect.values())) >= 0.9
        assert found[700] == expect[700] and found[9100][0][0] == -1.0  # copies: ties go to smaller ids; a multiple of row 100


def test_cross_polytope_probing_every_bucket_is_exact(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(0, 1, 5).round(1).tolist(), None) for i in range(400)]
    expect = exact_neighbours(rows, 5)
    v = cross_polytope.usable(vectors(spark, rows))
    got = cross_polytope.nearest(v, v.where("id % 50 = 0"), 5, tables=1, probes=16).collect()
    assert {(r.query_id, r.vec_id) for r in got} == {(q, c) for q, best in expect.items() for _, c in best}


def test_cross_polytope_few_rows_and_odd_tables(spark):
    v = cross_polytope.usable(vectors(spark, [(0, [1.0, 0.0], 1), (1, [-1.0, 0.01], 1), (2, [0.0, -1.0], 1), (50, [0.3, 0.3], 2)]))
    got = cross_polytope.nearest(v, v.where("id % 50 = 0"), 5, tables=1, probes=1).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 50), (0, 2, 2), (0, 3, 1), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    none = v.where("id < 0")
    assert cross_polytope.nearest(none, none).count() == 0
    assert cross_polytope.nearest(v.where("id = 0"), v.where("id = 0")).count() == 0


def test_chained_functions_and_probe_order():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (4000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    h = cross_polytope.Hash(8, 4000, tables=3, bucket=20)
    assert h.width == [8, 8]
    b, p = h.buckets(x), h.probes(x, 6)
    assert (p[:, :, 0] == b).all() and p.shape == (4000, 3, 12)  # the own bucket is the cheapest
    assert all(len(set(r)) == 12 for r in p[:50, 0])
    assert np.bincount(b[:, 0]).max() < 200
    assert np.allclose(np.linalg.norm(cross_polytope.hadamard(x), axis=1), 1)


@pytest.mark.parametrize("name, least", [("sf0.001", 0.9), ("sf0.1", 0.9)])
def test_cross_polytope_recall_on_the_given_table(spark, name, least):
    d = f"/root/testdata/{name}"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    expect = exact_neighbours(rows, 5)
    got = queries.op12_cross_polytope(spark, d).collect()
    hits = sum((-round(r.score, 9), r.vec_id) in expect[r.query_id] for r in got)
    assert hits / sum(map(len, expect.values())) >= least


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def enc(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain_tree(nodes, fan):
    """Top and, per node, the (left, right) siblings of each level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p // fan * fan:p // fan * fan + fan]
            paths[i].append(("".join(run[:p % fan]), "".join(run[p % fan + 1:])))
        level = [sha(*level[i:i + fan]) for i in range(0, len(level), fan)]
        at = [p // fan for p in at]
    return level[0], paths


def plain_manifest(rows, fan=2):
    """rows: (doc_id, text, lang, source, n_chars)"""
    leaf = lambda r, more=0: sha(enc(r[0]), enc(r[3]), enc(r[2]), enc(None if r[4] is None else r[4] + more), enc(r[1]))
    trees, found = {}, []
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    keys = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    tops = {}
    for k in keys:
        trees[k].sort(key=lambda x: x[:3])
        tops[k] = plain_tree([x[2] for x in trees[k]], fan)
    root, above = plain_tree([tops[k][0] for k in keys], fan)
    for j, k in enumerate(keys):
        for (_, _, h, r), path in zip(trees[k], tops[k][1]):
            path = path + above[j]
            node = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for left, right in path:
                node = sha(left, node, right)
            found.append((r[0], h, tops[k][0], root, sha(*[a + b for a, b in path]), node, node == root))
    return sorted(found, key=str)


def odd_documents(n=150):
    rows = [(i, f"text {i % 40} é\n", ["en", "de", "zh-ß", None][i * i % 4], "s" if i % 5 else None, None if i % 6 == 0 else i) for i in range(n)]
    rows += [(7, "a", "en", "s", 1), (7, "a", "en", "s", 1), (7, "b", "en", "s", 1), (None, "x", "en", None, 3), (None, None, None, None, None),
             (500, "", "", "", 0), (501, "lone", "fr", "s", 2 ** 63 - 1), (-3, "long " * 60000, "en", "s", 300000)]
    return rows + [(600, "copy", "en", "s", 4)] * 90


@pytest.mark.parametrize("fan, step", [(2, 6), (2, 2), (3, 2)])
def test_manifest_matches_plain_hashing(spark, fan, step):
    rows = odd_documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 AS pos", "'x' AS leaf", "2 AS tree", "3 AS digest", "'y' AS root")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.when(hit, (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")).otherwise(F.col("n_chars").cast("string"))
    got = merkle.verify(merkle.manifest(docs.repartition(5), {"n_chars": more}, fan=fan, step=step))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_manifest(rows, fan)


def test_manifest_of_one_row_and_none(spark):
    one = merkle.verify(merkle.manifest(frame(spark, [(1, "a")]))).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == sha("")
    assert merkle.verify(merkle.manifest(frame(spark, []))).count() == 0
