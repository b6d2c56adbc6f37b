import numpy as np
from pyspark.sql import functions as F

from faultline.operators import cluster as C
from faultline.operators import regress as G
from faultline.operators import state as U


def test_failures_keep_unknown_results(spark):
    df = spark.createDataFrame([(1, "FAIL"), (2, "PASS"), (3, None)], "row_id int, result string")
    assert {r.row_id for r in G.failures(df).collect()} == {1, 3}


def test_regressions_multiply_on_duplicates(spark):
    new = spark.createDataFrame([(1, "r2", "t", "FAIL"), (2, "r2", "t", "FAIL")], "row_id int, run_id string, tc_uuid string, result string")
    old = spark.createDataFrame([(3, "r1", "t", "PASS"), (4, "r1", "t", "PASS"), (5, "r1", None, "PASS")], "row_id int, run_id string, tc_uuid string, result string")
    assert G.regressions(new, old).count() == 4
    assert G.regressions(new.limit(0), old).count() == 0


def test_requeue_trims_only_long_ledgers(spark):
    ledger = spark.range(10).select(F.col("id").cast("string").alias("run_id"), "id")
    failed = spark.createDataFrame([("3",)], "run_id string")
    assert G.requeue(ledger, failed, "run_id", "id").count() == 9
    assert {r.run_id for r in G.requeue(ledger, failed, "run_id", "id", most=5, trim=4).collect()} == {"5", "6", "7", "8", "9"}


def test_upsert_is_idempotent(spark):
    day = lambda d: F.to_date(F.lit(d))
    dim = spark.createDataFrame([("A ", "x")], "name string, kind string").withColumns({"created_at": day("2025-01-01"), "updated_at": day("2025-01-01")})
    new = spark.createDataFrame([("a", "X"), ("b", "y"), (" B", "y")], "name string, kind string")
    once = U.upserted(dim, new, ["name", "kind"], day("2025-02-02"))
    twice = U.upserted(once, new, ["name", "kind"], day("2025-02-02"))
    assert once.count() == 2
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_ema_stays_unit(spark):
    old = spark.createDataFrame([("t", [1.0, 0.0])], "k string, centroid array<double>")
    new = spark.createDataFrame([("t", [0.0, 1.0]), ("u", [0.6, 0.8])], "k string, centroid array<double>")
    got = {r.k: r.centroid for r in U.updated_centroids(old, new, ["k"]).collect()}
    assert abs(np.linalg.norm(got["t"]) - 1) < 1e-12 and got["u"] == [0.6, 0.8]


def test_hdbscan_finds_two_groups_and_noise():
    rng = np.random.default_rng(1)
    a, b = np.array([1.0, 0, 0]), np.array([0, 1.0, 0])
    x = np.r_[a + rng.normal(0, 0.01, (5, 3)), b + rng.normal(0, 0.01, (4, 3)), [[0, 0, 1.0]]]
    labels = C.hdbscan_labels(x)
    assert len(set(labels[:5])) == 1 and len(set(labels[5:9])) == 1 and labels[0] != labels[5] and labels[9] == -1
    assert (C.hdbscan_labels(x[:1]) == -1).all() and len(C.hdbscan_labels(x[:0])) == 0


def test_greedy_groups_do_not_chain():
    assert C.greedy_groups([(1, 2), (2, 3)], [1, 2, 3]) == {1: 1, 2: 1, 3: 3}


def test_indel_ratio_by_definition():
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for a, b in (("abcdef", "abxdf"), ("", "x"), ("same", "same"), ("kitten", "sitting")):
        assert abs(C.indel_ratio(a, b) - 200 * lcs(a, b) / (len(a) + len(b))) < 1e-9


def test_similar_texts_are_those_of_brute_force(spark):
    import random

    from faultline.operators import similar as N
    from faultline.operators.cluster import indel_ratio

    rng = random.Random(2)
    texts = ["".join(rng.choice("ab c1é") for _ in range(rng.randint(0, 40))) for _ in range(60)] + [f"crash in node {k} of {k * 7}" for k in range(40)]
    df = spark.createDataFrame([(k, "t", x) for k, x in enumerate(texts)], "row_id long, type string, text string")
    first = {}
    for k, x in enumerate(texts):
        first.setdefault(x, k)
    names = {k: x for x, k in first.items() if x}
    for least in (60.0, 85.0, 100.0):
        want = {(a, b) for a in names for b in names if a < b and (len(names[a]) <= 50) == (len(names[b]) <= 50) and indel_ratio(names[a], names[b]) >= least}
        assert {(r.a, r.b) for r in N.similar_texts(df, "type", "row_id", "text", least).collect()} == want


def test_indel_ratio_by_dynamic_programming():
    import random

    from faultline.operators.cluster import indel_ratio

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                row[j + 1], before = (before + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
        return row[-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert indel_ratio(a, b) == (100.0 if not a + b else 200.0 * lcs(a, b) / (len(a) + len(b)))


def test_density_clusters_with_core_distances(spark):
    import numpy as np

    from faultline.operators.cluster import hdbscan_labels

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (30, 2)), rng.normal(5, 0.1, (30, 2)), [[50.0, 50.0]]])
    labels = hdbscan_labels(x, 5, 0.0, 5, "euclidean")
    assert set(labels[:30]) == {0} and set(labels[30:60]) == {1} and labels[60] == -1


def test_outlier_neighbours_over_blocks_are_those_of_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (60, 4))
    x[7], x[31], x[8] = x[3], x[3], 0  # ties and a zero vector
    rows = [(k % 2, k, x[k].tolist()) for k in range(60)] + [(0, 99, None)]
    df = spark.createDataFrame(rows, "label int, vec_id long, embedding array<double>")
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(norms > 0, norms, 1)
    want = {a: sorted((max(0.0, 1 - sum(p * q for p, q in zip(u[a], u[b], strict=True))), b) for b in range(a % 2, 60, 2) if b != a)[:5] for a in range(60)}
    got = {}
    for r in C.neighbours(df, "label", "vec_id", "embedding", 5, block=7).collect():
        got.setdefault(r.a, []).append((r.d, r.b))
    assert got.keys() == want.keys()
    for a, near in got.items():
        assert np.allclose([d for d, _ in sorted(near)], [d for d, _ in want[a]])
        assert [b for _, b in sorted(near)] == [b for _, b in want[a]]


def test_ratios_of_many_texts_are_those_of_one(spark):
    import random

    rng = random.Random(4)
    texts = ["".join(rng.choice("ab c1é\0") for _ in range(rng.randint(0, 70))) for _ in range(80)]
    for a in texts[:40]:
        assert np.allclose(C.indel_ratios(a, texts), [C.indel_ratio(a, b) for b in texts])


def test_similar_groups_are_those_of_all_pairs(spark):
    from faultline.operators import similar as N

    texts = [f"crash in node {k % 37} of {k * 7919 % 1000} by İx{k % 5}" for k in range(150)] + ["x", "x", "unlike all others here"]
    df = spark.createDataFrame([(k, "t", x) for k, x in enumerate(texts)], "row_id long, type string, text string")
    pairs = [(a, b) for a in range(150) for b in range(a + 1, 150) if C.indel_ratio(texts[a], texts[b]) >= 90.0]
    found = C.greedy_groups(pairs, list(range(150)))
    want = {(r, x) for r, x in found.items() if list(found.values()).count(x) >= 2}
    assert {(r.row_id, r.anchor) for r in N.similar_groups(df, "type", "row_id", "text", 90.0).collect()} == want


def test_near_texts_are_those_of_each_pair():
    import random

    from faultline.operators import similar as N

    rng = random.Random(6)
    for letters, low, high in (("ab c1é", 1, 50), ("ab\0", 1, 9), ("ab", 51, 110), ("abcd😀ü", 60, 110), ("abc", 1, 110)):
        one, more = (["".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)] for n in (40, 25))
        for least in (20.0, 60.0, 100.0):
            for other in (one, more + one[:5]):
                pairs = {(k, j): C.indel_ratio(a, b) for k, b in enumerate(other) for j, a in enumerate(one) if other is not one or j < k}
                got = [((k, int(j)), ratio) for k, ratio, places in N.near_texts(one, other, least, other is one) for j in places]
                assert len(got) == len(dict(got)) and dict(got) == {p: r for p, r in pairs.items() if r >= least}


def test_similar_texts_meet_block_by_block(spark, monkeypatch):
    from faultline.operators import similar as N

    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "HELD", 64)
    texts = [f"Wait timeout: code 0x{100000 + k * 37} pid: {k * 37}" for k in range(150)] + [f"{'long ' * 12}text of {k * 7919 % 1000}" for k in range(60)]
    rows = [(f"r{k:04d}", kind, x) for kind in ("t", "u") for k, x in enumerate(texts)]
    df = spark.createDataFrame([*rows, ("r9", "t", texts[0]), ("r8", None, texts[0]), ("r7", "t", None)], "row_id string, type string, text string")
    want = {(a, b): round(C.indel_ratio(texts[a], texts[b]), 9) for b in range(210) for a in range(b) if (a < 150) == (b < 150) and C.indel_ratio(texts[a], texts[b]) >= 85.0}
    lists = N.similar_lists(df, "type", "row_id", "text", 85.0).cache()
    got = [(r.type, r.a, r.b, round(r.ratio, 9)) for r in N.similar_pairs(lists, "type").collect()]
    assert len(want) > 2000 and sorted(got) == sorted((kind, f"r{a:04d}", f"r{b:04d}", r) for kind in ("t", "u") for (a, b), r in want.items())
    assert lists.count() < len(got) / 2


def test_similar_texts_of_a_large_type_have_no_row_for_each_pair(spark):
    from faultline.operators import similar as N

    df = spark.range(3000).selectExpr("id AS row_id", "'t' AS type", "concat('Wait timeout: code 0x', 100000 + id * 7, ' pid: ', id * 7) AS text")
    pairs = N.similar_texts(df, "type", "row_id", "text", 85.0)
    assert len(pairs.collect()) > 100_000
    found, waiting = [], [pairs._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            waiting.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            waiting.append(node.plan())
        elif "Join" in node.nodeName():
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        waiting += [children.apply(k) for k in range(children.size())]
    assert 0 < sum(found) < 1000  # pairs of blocks; pairs of texts were 1,807,599 rows
