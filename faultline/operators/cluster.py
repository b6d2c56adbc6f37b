"""Clusters of failures: centroids, similarities, ranks, cohesion, outliers, grouping and density clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import vectors as V
from faultline.sources.shared import cut


def centroids(df: DataFrame, key: str = "label", vector: str = "embedding") -> DataFrame:
    """AG15: the unit-length mean vector of each cluster, by position."""
    flat = df.where(F.col(vector).isNotNull()).select(key, F.posexplode(vector).alias("pos", "x"))
    means = flat.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    whole = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("mean"))
    return whole.select(key, V.unit(F.col("mean")).alias("centroid"))


#: Centroids of one packed row, at most: what a task holds of the state at once.
PACKED = 2048


def _numbered(cents: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Centroids dealt to packs of about PACKED by a hash of their key, and the number of packs. They are computed once:
    counted and used on two sides, they would else be made out of all rows each time."""
    cents = cut(cents)
    n = max(1, -(-cents.count() // PACKED))
    return cents.withColumn("_p", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), n


def centroid_pairs(cents: DataFrame, least: float = 0.85, key: str = "label") -> DataFrame:
    """Pairs of centroids (one row per cluster; the smaller key first) at least that similar. Packs of centroids
    meet pack by pack, a triangle of them, so no task and no broadcast holds more than two."""
    numbered, n = _numbered(cents.select(key, "centroid"), key)
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = numbered.select(key, "centroid", "_p", other.alias("_q")).select(key, "centroid", F.least("_p", "_q").alias("_i"), F.greatest("_p", "_q").alias("_j"), "_p")
    a = sides.where("_p = _i").select("_i", "_j", F.col(key).alias("a"), F.col("centroid").alias("ca"))
    b = sides.where("_p = _j").select("_i", "_j", F.col(key).alias("b"), F.col("centroid").alias("cb"))
    found = a.join(b, ["_i", "_j"]).where(F.when(F.col("_i") == F.col("_j"), F.col("a") < F.col("b")).otherwise(True))
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), V.dot(F.col("ca"), F.col("cb")).alias("similarity"))
    return pairs.where(F.col("similarity") >= least)


def _best(u, cents, key: str):
    """The most similar of an array of centroids, ties to the least key."""
    scored = F.transform(cents, lambda x: F.struct(V.dot(u, x["c"]).alias("s"), (-x["k"]).alias("o"), x["k"].alias("k")))
    top = F.array_max(scored)
    return F.struct(top["s"].alias("similarity"), top["o"].alias("o"), top["k"].alias(key))


def nearest_centroid(df: DataFrame, cents: DataFrame, row: str = "vec_id", key: str = "label", vector: str = "embedding") -> DataFrame:
    """The most similar centroid of each row, ties to the least (numeric) key, found inside the row.

    The state travels as packs of at most about PACKED centroids. With one pack, which is checked by a count, it is
    broadcast and rows don't move; with more, each row meets the packs by their number, and its best of each are
    compared.
    """
    numbered, n = _numbered(cents.select(key, "centroid"), key)
    packs = numbered.groupBy("_p").agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col("centroid").alias("c"))).alias("cents"))
    rows = df.select(row, V.unit(F.col(vector)).alias("u"))
    if n == 1:
        return rows.join(F.broadcast(packs)).select(row, _best(F.col("u"), F.col("cents"), key).alias("b")).select(row, f"b.{key}", "b.similarity")
    spread = rows.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(packs, "_p")
    best = spread.select(row, _best(F.col("u"), F.col("cents"), key).alias("b")).groupBy(row).agg(F.max("b").alias("b"))
    return best.select(row, f"b.{key}", "b.similarity")


def hybrid_scores(rows: DataFrame, cents: DataFrame) -> DataFrame:
    """CL04, J15, SC27, W04: (row_id, type, cluster_name, cosine, sparse, score) of rows against the clusters of their
    type. rows has row_id, type, embedding and weights (token to weight); cents type, cluster_name, centroid and
    weights. The sparse product is scaled by the row's least and greatest over the clusters (none in range: 0); with one
    cluster, or a cluster stored without weights, the cosine stands alone."""
    u = rows.select("row_id", "type", V.unit(F.col("embedding")).alias("u"), F.map_entries("weights").alias("w"))
    c = cents.select("type", "cluster_name", "centroid", F.col("weights").alias("cw"))
    product = F.aggregate("w", F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at("cw", e["key"]), F.lit(0.0)))
    scored = u.join(c, "type").select("row_id", "type", "cluster_name", F.col("cw").isNull().alias("_bare"), V.dot(F.col("u"), F.col("centroid")).alias("cosine"), F.coalesce(product, F.lit(0.0)).alias("sparse"))
    w = Window.partitionBy("row_id")
    lo, hi, n = F.min("sparse").over(w), F.max("sparse").over(w), F.count(F.lit(1)).over(w)
    scaled = F.when(hi - lo < 1e-9, 0.0).otherwise((F.col("sparse") - lo) / (hi - lo))
    return scored.withColumns({"_s": scaled, "_n": n}).withColumn("score", F.when((F.col("_n") == 1) | F.col("_bare"), F.col("cosine")).otherwise(V.hybrid(F.col("cosine"), F.col("_s")))).drop("_s", "_n", "_bare")


def weight_maps(weights: DataFrame, row: str) -> DataFrame:
    """Long weights (row, token, weight) as one map for each row."""
    return weights.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("token", "weight"))).alias("weights"))


def ranked(df: DataFrame, cents: DataFrame, row: str = "vec_id", key: str = "label", vector: str = "embedding") -> DataFrame:
    """Similarity to the centroid, rank in the cluster, min-max score, and whether it is core (at or
    above the median score)."""
    sims = df.join(cents, key).select(row, key, V.cosine(F.col(vector), F.col("centroid")).alias("similarity"))
    ends = sims.groupBy(key).agg(F.min("similarity").alias("lo"), F.max("similarity").alias("hi"))
    scored = sims.join(ends, key).withColumn("score", F.when(F.col("hi") - F.col("lo") <= 1e-9, 1.0).otherwise((F.col("similarity") - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    medians = scored.groupBy(key).agg(F.percentile("score", 0.5).alias("median"))
    w = Window.partitionBy(key).orderBy(F.col("similarity").desc(), row)
    return scored.join(medians, key).select(row, key, "similarity", F.row_number().over(w).alias("rank"), "score", (F.col("score") >= F.col("median")).alias("is_core"))


def cohesion(df: DataFrame, key: str = "label", vector: str = "embedding", loose: float = 0.35) -> DataFrame:
    """AG17, AG18: mean pairwise cosine of a cluster from the norm of the sum of its unit vectors: no pairs are formed."""
    flat = df.select(key, F.posexplode(V.unit(F.col(vector))).alias("pos", "x"))
    sums = flat.groupBy(key, "pos").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    total = sums.groupBy(key).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("qq"))
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    value = F.when(F.col("n") < 2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("ss") - F.col("qq")) / (F.col("n") * (F.col("n") - 1)))))
    return total.join(sizes, key).select(key, "n", value.alias("cohesion")).withColumn("is_loose", (F.col("cohesion") < loose) & (F.col("n") > 5))


def exact_groups(df: DataFrame, row: str, text: str) -> DataFrame:
    """AG14: texts that two or more rows of a length bin share; the group's name is its least row."""
    from faultline.functions.text import length_bin

    binned = df.select(row, F.col(text).alias("_t"), length_bin(F.col(text)).alias("bin")).where("bin is not null")
    groups = binned.groupBy("bin", "_t").agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("first_row")).where("n >= 2")
    return groups.select("bin", "first_row", "n")


def token_weights(df: DataFrame, row: str, tokens) -> DataFrame:
    """X02 default: unit-length TF-IDF weights in long form (row, token, weight)."""
    flat = df.select(row, F.explode(tokens).alias("token"))
    tf = flat.groupBy(row, "token").agg(F.count(F.lit(1)).alias("tf"))
    n = df.select(row).distinct().agg(F.count(F.lit(1)).alias("n"))
    idf = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n)).select("token", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    raw = tf.join(idf, "token").select(row, "token", (F.col("tf") * F.col("idf")).alias("w"))
    norms = raw.groupBy(row).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, row).select(row, "token", (F.col("w") / F.col("norm")).alias("weight"))


def sparse_centroids(weights: DataFrame, row: str, key: str) -> DataFrame:
    """AG16: mean weights of a cluster's members; a token that a member lacks counts as 0."""
    members = weights.groupBy(key).agg(F.count_distinct(row).alias("m"))
    return weights.groupBy(key, "token").agg(F.sum("weight").alias("s")).join(members, key).select(key, "token", (F.col("s") / F.col("m")).alias("weight"))


def sparse_pairs(weights: DataFrame, row: str, least: float = 0.0, commonest: int | None = None) -> DataFrame:
    """Dot products of rows (a < b) that share a token. With `commonest`, tokens of more rows than that don't start
    a pair (an explicit parameter of the caller's; None computes all)."""
    use = weights
    if commonest is not None:
        rare = weights.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= commonest).select("token")
        use = weights.join(rare, "token", "left_semi")
    dots, members = sparse_classes(use, row)
    return spelt_out(dots.where(F.col("dot") >= least), members, "dot").where("a < b")


#: Rows of a class in one row of the exchange, at most, and the portions that a class is dealt to.
CHUNK, PORTIONS = 4096, 64


def sparse_classes(weights: DataFrame, row: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the same weights are one class, named by its least row: (ca, cb, dot) of all ordered pairs of classes
    that share a token, each with itself as well, and the classes' members (c, rows) in portions."""
    vector = F.array_sort(F.collect_list(F.struct("token", "weight")))
    of = weights.groupBy(F.col(row).alias("_r")).agg(vector.alias("_v"))
    portions = of.groupBy("_v", F.pmod(F.xxhash64("_r", F.lit(11)), F.lit(PORTIONS)).alias("_h")).agg(F.collect_list("_r").alias("_rows"))
    begins = F.sequence(F.lit(0), F.floor((F.size("_rows") - 1) / CHUNK).cast("int"))
    chunked = cut(portions.withColumn("_k", F.explode(begins)).select("_v", F.slice("_rows", F.col("_k") * CHUNK + 1, F.lit(CHUNK)).alias("rows")))
    names = cut(chunked.groupBy("_v").agg(F.min(F.array_min("rows")).alias("c")))
    classes = cut(names.withColumn("_w", F.explode("_v")).select("c", "_w.token", "_w.weight"))
    a, b = (classes.select("token", F.col("c").alias(c), F.col("weight").alias(f"w{c}")) for c in ("ca", "cb"))
    dots = a.join(b, "token").groupBy("ca", "cb").agg(F.sum(F.col("wca") * F.col("wcb")).alias("dot"))
    return dots, chunked.join(names, "_v").select("c", "rows")


def spelt_out(pairs: DataFrame, members: DataFrame, value: str) -> DataFrame:
    """(a, b, value) of all rows of pairs of classes (ca, cb, value), portion by portion: no join or aggregate sees them."""
    left, right = (members.select(F.col("c").alias(c), F.col("rows").alias(f"_{c}")) for c in ("ca", "cb"))
    # A number that is asked for isn't lowered: portions are small, what they become isn't.
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = pairs.join(left, "ca").join(right, "cb").repartition(tasks, "_ca", "_cb")
    # Compiled together, both explodes would hold copies of all pairs of two portions before one moves on. A lambda isn't
    # compiled, so the first explode hands on row by row, and what waits are the pairs of one row with one portion.
    rows = F.transform("_ca", lambda x: x)
    return both.select(F.explode(rows).alias("a"), "_cb", value).select("a", F.explode("_cb").alias("b"), value)


def hdbscan_labels(x: np.ndarray, min_size: int = 2, epsilon: float = 0.12, samples: int = 1, metric: str = "cosine") -> np.ndarray:
    """CL10, CL11: density clusters: minimum spanning tree of reachability, single linkage, condensed tree, excess of
    mass, and no split under epsilon. A point's core distance is that to its samples-th neighbour, itself being the
    first: with one, reachability is distance itself. The alternate settings are 5, 0.0, 5, "euclidean"."""
    n = len(x)
    labels = np.full(n, -1)
    if n < min_size or n < 2:
        return labels
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(norms > 0, norms, 1) if metric == "cosine" else x

    def distances(k: int) -> np.ndarray:
        return np.clip(1 - u @ u[k], 0, 2) if metric == "cosine" else np.sqrt(((u - u[k]) ** 2).sum(1))

    core = np.array([np.partition(distances(k), samples - 1)[samples - 1] for k in range(n)]) if 1 < samples <= n else np.zeros(n)
    # Prim's algorithm, a row of distances at a time
    best, link, seen = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    edges, at = [], 0
    for _ in range(n - 1):
        seen[at] = True
        d = np.maximum(np.maximum(distances(at), core), core[at])
        closer = ~seen & (d < best)
        best[closer], link[closer] = d[closer], at
        nxt = int(np.where(seen, np.inf, best).argmin())
        edges.append((best[nxt], int(link[nxt]), nxt))
        at = nxt
    # Single linkage: a binary tree of merges
    up, size, children, height = list(range(2 * n - 1)), [1] * n, {}, {}

    def root(a: int) -> int:
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for k, (w, a, b) in enumerate(sorted(edges)):
        ra, rb, node = root(a), root(b), n + k
        up[ra] = up[rb] = node
        children[node], height[node] = (ra, rb), w
        size.append(size[ra] + size[rb])

    def leaves(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            v = stack.pop()
            if v < n:
                out.append(v)
            else:
                stack += children[v]
        return out

    top = 2 * n - 2
    # Condensed clusters: (birth lambda, points as (point, lambda) that leave, child clusters)
    clusters: list[dict] = [{"node": top, "birth": 0.0, "mass": 0.0, "kids": [], "height": np.inf}]
    stack = [(0, top)]
    while stack:
        c, node = stack.pop()
        while node >= n:
            lam = 1 / max(height[node], 1e-12)
            a, b = children[node]
            big = [v for v in (a, b) if size[v] >= min_size]
            if len(big) == 2:
                clusters[c]["mass"] += (lam - clusters[c]["birth"]) * (size[a] + size[b])
                for v in big:
                    clusters.append({"node": v, "birth": lam, "mass": 0.0, "kids": [], "height": height[node]})
                    clusters[c]["kids"].append(len(clusters) - 1)
                    stack.append((len(clusters) - 1, v))
                break
            small = size[node] - sum(size[v] for v in big)
            clusters[c]["mass"] += (lam - clusters[c]["birth"]) * small
            if not big:
                break
            node = big[0]
    chosen: set[int] = set()
    value = [0.0] * len(clusters)
    for c in range(len(clusters) - 1, 0, -1):
        below = sum(value[k] for k in clusters[c]["kids"])
        # a split whose height is under epsilon isn't one
        merged = clusters[c]["kids"] and all(clusters[k]["height"] < epsilon for k in clusters[c]["kids"])
        if not clusters[c]["kids"] or merged or clusters[c]["mass"] >= below:
            value[c] = clusters[c]["mass"] if not merged else max(clusters[c]["mass"], below)
            drop, chosen_below = list(clusters[c]["kids"]), set()
            while drop:
                k = drop.pop()
                chosen_below.add(k)
                drop += clusters[k]["kids"]
            chosen -= chosen_below
            chosen.add(c)
        else:
            value[c] = below
    if not chosen and n >= min_size and max(height.values()) < epsilon:
        chosen = {0}
    for label, c in enumerate(sorted(chosen, key=lambda c: min(leaves(clusters[c]["node"])))):
        labels[leaves(clusters[c]["node"])] = label
    return labels


#: Rows of a block, at most about: a task holds two blocks and one block's distances to the other.
BLOCK = 1024


def neighbours(df: DataFrame, key: str, row: str, vector: str, k: int, block: int = BLOCK) -> DataFrame:
    """CL15: (a, b, d) of each row's k nearest rows of its cluster by cosine distance, ties to the least row.

    Clusters are dealt to blocks by a hash of the row. Every block meets every other one of its cluster, a pair of
    blocks for a task, by a product of matrices; only each row's k best of a block move on. Which are best is decided
    on sums in order of the places, so that equal vectors tie.
    """
    rows = df.where(F.col(vector).isNotNull()).select(key, F.col(row).alias("a"), F.col(vector).cast("array<double>").alias("x"))
    sizes = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_m"))
    dealt = cut(rows.join(sizes, key).withColumn("_p", F.pmod(F.xxhash64("a"), F.col("_m")).cast("int")))
    every = F.explode(F.sequence(F.lit(0), F.col("_m") - 1))
    left = dealt.select(key, F.col("_p").alias("_i"), every.alias("_j"), "a", "x")
    right = dealt.select(key, every.alias("_i"), F.col("_p").alias("_j"), "a", "x")
    kinds = dict(rows.dtypes)

    def units(pdf: pd.DataFrame) -> np.ndarray:
        x = np.array([np.asarray(v, float) for v in pdf["x"]])
        norms = np.sqrt((x * x).sum(1, keepdims=True))
        return x / np.where(norms > 0, norms, 1)

    def run(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if one.empty or other.empty:
            return pd.DataFrame({key: [], "a": [], "b": [], "d": []})
        other = other.sort_values("a")
        u, v, ids, names = units(one), units(other), one["a"].to_numpy(), other["a"].to_numpy()
        own = ids[:, None] == names[None, :]
        d = np.where(own, np.inf, 1 - u @ v.T)
        most = min(k, len(names))
        # A product's rounding differs by a few units in the last place: what is that near to the k-th is summed again.
        edge = np.partition(d, most - 1, axis=1)[:, most - 1 : most] + 1e-9
        at, to = np.nonzero((d <= edge) & ~own)
        exact = np.zeros(len(at))
        for p in range(u.shape[1]):
            exact += u[at, p] * v[to, p]
        exact = np.maximum(0.0, 1 - exact)
        order = np.lexsort((names[to], exact, at))
        at, to, exact = at[order], to[order], exact[order]
        first = np.r_[True, at[1:] != at[:-1]]
        place = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0)) if len(at) else at
        kept = place < k
        return pd.DataFrame({key: one[key].iloc[0], "a": ids[at[kept]], "b": names[to[kept]], "d": exact[kept]})

    found = left.groupBy(key, "_i", "_j").cogroup(right.groupBy(key, "_i", "_j")).applyInPandas(run, f"{key} {kinds[key]}, a {kinds['a']}, b {kinds['a']}, d double")
    best = Window.partitionBy(key, "a").orderBy("d", "b")
    return found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")


def density_clusters(df: DataFrame, group: str, row: str = "vec_id", vector: str = "embedding", min_size: int = 2, epsilon: float = 0.12, samples: int = 1, metric: str = "cosine") -> DataFrame:
    """CL10, CL11 per group: needs all pairs of a group's leftovers, so groups are the small residue of earlier stages."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row)
        x = np.array([np.asarray(v, float) for v in pdf[vector]])
        return pd.DataFrame({group: pdf[group].to_numpy(), row: pdf[row].to_numpy(), "int_cluster": hdbscan_labels(x, min_size, epsilon, samples, metric).astype("int32")})

    kinds = dict(df.dtypes)
    return df.where(F.col(vector).isNotNull()).select(group, row, vector).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {row} {kinds[row]}, int_cluster int")


def greedy_groups(pairs: list[tuple[int, int]], members: list[int]) -> dict[int, int]:
    """CL07, CL08, CL12: anchors in order take all similar rows not yet taken; no chaining."""
    near: dict[int, list[int]] = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    out: dict[int, int] = {}
    for anchor in sorted(members):
        if anchor not in out:
            out[anchor] = anchor
            for other in near.get(anchor, ()):
                out.setdefault(other, anchor)
    return out


def indel_ratio(a: str, b: str) -> float:
    """SC28: normalised indel similarity, 0 to 100, by the length of the longest common subsequence (bit-parallel)."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = masks.get(c, 0) & state
        state = (state + hit | state - hit) & full
    lcs = len(a) - state.bit_count()
    return 100.0 * 2 * lcs / (len(a) + len(b))


def indel_ratios(a: str, others: list[str]) -> np.ndarray:
    """indel_ratio(a, b) of each b: the same bit-parallel steps on all others at once, for an a of up to 63 characters;
    longer ones are taken one by one."""
    n = len(a)
    if n > 63 or not n:
        return np.array([indel_ratio(a, b) for b in others])
    lengths = np.fromiter(map(len, others), np.int64, len(others))
    width = int(lengths.max(initial=0))
    points = np.array(others, f"U{max(1, width)}").view(np.uint32).reshape(len(others), max(1, width))
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = np.uint64((1 << n) - 1)
    state = np.full(len(others), full)
    # Texts end where they do: what pads them is character 0, which changes nothing unless a has it.
    for p in range(width):
        column, hits = points[:, p], np.zeros(len(others), np.uint64)
        for c, mask in masks.items():
            hits[column == ord(c)] = mask
        hits[lengths <= p] = 0
        hit = hits & state
        state = (state + hit | state - hit) & full
    lcs = n - np.bitwise_count(state).astype(np.int64)
    return 100.0 * 2 * lcs / (n + lengths)
