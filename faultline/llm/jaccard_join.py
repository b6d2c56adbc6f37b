"""Exact Jaccard join of word-shingle sets: a metric-space join by pivots, Voronoi cells and triangle windows.

Jaccard distance is a metric, but unrelated texts all lie at distance 1 of each other and of any pivot, where no
triangle inequality tells them apart. So space is first cut into neighbourhoods that no link leaves: all shingles are
counted, each set is ordered from its rarest shingle on, and two sets that link share a shingle of the first
n - ceil(t n) + 1. Sets whose such prefix holds shingles of theirs alone are alone; the others form neighbourhoods,
connected by shared prefix shingles.

Inside a neighbourhood distances do tell. Pivots are chosen, each set measures its distance to each, goes to the cell
of its nearest pivot, and is replicated to every cell whose pivot is at most 2 eps farther: both ends of a link
(distance up to eps) then meet in the cell of either. Cells are cut again by pivots of their own while that makes them
smaller; in what is left, pairs are compared whose distances to all pivots differ by at most eps. Pairs already
connected aren't compared. A neighbourhood that is too large for a task is cut by the same rule as a Spark job first,
its members dealt in portions, and its links are connected by a distributed component search.

Equal sets are one vertex: copies never meet in a task.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocked, counted, cut, distinct, flat, from_planes, keep_only, summed, text_bytes, to_planes

LISTS = "bucket int, block int, planes binary, counts binary"
CLASSES = "block int, bucket int, classes binary"
SETS = "block int, row int, doc_id long, n_shingles long, v long, prefix array<long>"
MEMBERS = "region long, v long, body binary"
FOUND = "v long, comp long"
PIVOTS = 16
CELL = 48


#: Bytes of text whose words are numbered at once.
SLICE_BYTES = 4 << 20
#: A fixed random number of each place in a word.
_PLACES = np.frombuffer(b"".join(blake2b(k.to_bytes(4, "little"), digest_size=8, person=b"place").digest() for k in range(64)), "<u8")


def word_numbers(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A 64-bit number of each word (bytes data[edges[k] : edges[k + 1]]), the same in every process: the sum of its
    bytes times a fixed random number of their places, and of its end's. Long words are hashed one by one."""
    size = np.diff(edges)
    out = np.zeros(len(size), np.uint64)
    short = np.flatnonzero((size > 0) & (size < len(_PLACES)))
    with np.errstate(over="ignore"):
        if len(short):
            own, begin = size[short], edges[:-1][short]
            first = np.cumsum(own) - own
            place = np.arange(own.sum()) - np.repeat(first, own)
            values = data[place + np.repeat(begin, own)].astype(np.uint64) + np.uint64(1)
            values *= _PLACES[place]
            out[short] = np.add.reduceat(values, first) + _PLACES[own]
    for k in np.flatnonzero(size >= len(_PLACES)):
        out[k] = int.from_bytes(blake2b(data[edges[k] : edges[k + 1]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Each text's set of word shingles as sorted 64-bit numbers, the same in every process."""
    out: list[np.ndarray] = []
    some: list[bytes] = []
    size = 0
    for text in texts:
        some.append(text)
        size += len(text)
        if size > SLICE_BYTES:
            out += _shingles(some, words)
            some, size = [], 0
    return out + _shingles(some, words) if some else out


def _shingles(texts: list[bytes], k: int) -> list[np.ndarray]:
    lists = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.large_binary()).view(pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    data, edges = flat(coded.dictionary)
    hashes = word_numbers(data, edges)
    number = np.asarray(coded.indices)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
    empty = np.flatnonzero(np.diff(edges) == 0)
    if len(empty):  # white space at a text's edge leaves an empty word
        real = number != empty[0]
        number, owner = number[real], owner[real]
    codes = hashes[number]
    counts = np.bincount(owner, minlength=len(texts))
    ends = np.cumsum(counts)
    begins = ends - counts
    with np.errstate(over="ignore"):
        n = max(0, len(codes) - k + 1)
        h = codes[:n].copy()
        for j in range(1, k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
        h = _mixed(h)
        out = []
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            if b - a >= k:
                out.append(distinct(h[a : b - k + 1]))
            elif b > a:
                whole = np.uint64(b - a)
                for c in codes[a:b]:
                    whole = whole * np.uint64(0xC2B2AE3D27D4EB4F) + c
                out.append(_mixed(np.array([whole], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _bits(total_bytes: int) -> int:
    """Bits of a shingle's number by which its sets are counted: ten more than the corpus's bytes need, so that about
    one in a thousand shingles meets another at any size of the corpus. One that does only seems shared: its sets are
    compared in vain."""
    return min(64, max(16, int(total_bytes).bit_length() + 10))


def _dealt(sets: list[np.ndarray], buckets: int, bits: int):
    """A block's distinct shingles (the leading bits of their numbers) in order, in how many of its sets they are, and
    the edges of the buckets, which are ranges of numbers."""
    whole = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    values, n = counted(whole >> np.uint64(64 - bits))
    step = (1 << bits) // buckets + 1
    edges = np.searchsorted(values, np.array([k * step for k in range(1, buckets)], np.uint64))
    return values, n, np.r_[0, edges, len(values)]


def _lists(words: int, buckets: int, bits: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keep_only("shingles")
        values, n, edges = _dealt(shingle_sets(table["body"].to_pylist(), words), buckets, bits)
        rows = [(b, key[0].as_py(), to_planes(values[x:y]), np.minimum(n[x:y], 255).astype(np.uint8).tobytes()) for b, (x, y) in enumerate(zip(edges, edges[1:], strict=False)) if x < y]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({c: pa.array([r[k] for r in rows], kinds[k]) for k, c in enumerate(("bucket", "block", "planes", "counts"))})

    return run


def _classes(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For each block's shingles: 0 if no other set has it, else a class that grows with the number of sets."""
    lists = [from_planes(x) for x in table["planes"].to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint8) for x in table["counts"].to_pylist()])
    keep_only("shingles")
    whole = np.concatenate(lists)
    values, total = summed(whole, counts)
    level = np.minimum(255, np.ceil(8 * np.log2(np.maximum(1, total)))).astype(np.uint8)[np.searchsorted(values, whole)]
    edges = np.cumsum([0, *map(len, lists)])
    return pa.table({"block": table["block"], "bucket": table["bucket"], "classes": pa.array([level[x:y].tobytes() for x, y in zip(edges, edges[1:], strict=False)], pa.binary())})


def _prefixes(words: int, buckets: int, percent: int, bits: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, classes: pa.Table) -> pa.Table:
        keep_only("shingles")
        docs = docs.sort_by([("doc_id", "ascending"), ("body", "ascending")]) if docs.num_rows else docs
        sets = shingle_sets(docs["body"].to_pylist(), words)
        values, _, edges = _dealt(sets, buckets, bits)
        level = np.zeros(len(values), np.uint8)
        for b, raw in zip(classes["bucket"].to_pylist(), classes["classes"].to_pylist(), strict=True):
            level[edges[b] : edges[b + 1]] = np.frombuffer(raw, np.uint8)
        vertices, prefixes = [], []
        for own in sets:
            n = len(own)
            rank = level[np.searchsorted(values, own >> np.uint64(64 - bits))]
            take = n - -(-percent * n // 100) + 1 if n else 0
            first = np.lexsort((own, rank))[:take]
            shared = own[first[rank[first] > 0]]
            vertices.append(int.from_bytes(blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True) if len(shared) else None)
            prefixes.append(shared.view(np.int64))
        return pa.table(
            {
                "block": pa.array([key[0].as_py()] * len(sets), pa.int32()),
                "row": pa.array(range(len(sets)), pa.int32()),
                "doc_id": docs["doc_id"],
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "v": pa.array(vertices, pa.int64()),
                "prefix": pa.array(prefixes, pa.list_(pa.int64())),
            }
        )

    return run


def _bodies(words: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, wanted: pa.Table) -> pa.Table:
        keep_only("shingles")
        docs = docs.sort_by([("doc_id", "ascending"), ("body", "ascending")]) if docs.num_rows else docs
        rows = wanted["row"].to_pylist()
        texts = docs["body"].take(pa.array(rows, pa.int64())).to_pylist() if rows else []
        return pa.table({"region": wanted["region"], "v": wanted["v"], "body": pa.array([s.astype("<u8").tobytes() for s in shingle_sets(texts, words)], pa.binary())})

    return run


# --- the join inside a neighbourhood ------------------------------------------------------------------------------


class Union:
    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = int(up[a])
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


class Sets:
    """Sets over small numbers, one after another."""

    def __init__(self, raws: list[bytes]) -> None:
        lists = [np.frombuffer(r, "<u8") for r in raws]
        self.sizes = np.array([len(x) for x in lists], np.int64)
        self.edges = np.r_[0, np.cumsum(self.sizes)]
        values, self.ids = np.unique(np.concatenate(lists), return_inverse=True)
        self.mark = np.zeros(len(values), bool)

    def of(self, k: int) -> np.ndarray:
        return self.ids[self.edges[k] : self.edges[k + 1]]

    def overlaps(self, k: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set k with others."""
        self.mark[self.of(k)] = True
        sizes = self.sizes[others]
        starts = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum()) + np.repeat(self.edges[others] - starts, sizes)
        out = np.add.reduceat(self.mark[self.ids[place]].astype(np.int64), starts)
        self.mark[self.of(k)] = False
        return out

    def measure(self, k: int, others: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Jaccard distances of set k to others, and which of them link."""
        both = self.overlaps(k, others)
        either = self.sizes[k] + self.sizes[others] - both
        return 1 - both / either, 100 * both >= percent * either


def join_cell(sets: Sets, members: np.ndarray, percent: int, union: Union) -> None:
    """Connects all linked members, by pivots, cells and windows."""
    eps = 1 - percent / 100 + 1e-9
    stack = [members]
    while stack:
        cell = stack.pop()
        if len(cell) < 2:
            continue
        pivots = cell[:: max(1, len(cell) // PIVOTS)][:PIVOTS] if len(cell) > CELL else cell[:1]
        distances = np.empty((len(pivots), len(cell)))
        for i, p in enumerate(pivots):
            distances[i], links = sets.measure(int(p), cell, percent)
            for other in cell[links]:
                union.join(int(p), int(other))
        roots = np.array([union.root(int(x)) for x in cell])
        if (roots == roots[0]).all():
            continue
        if len(cell) > CELL:
            nearest = distances.min(0)
            inside = distances <= nearest + 2 * eps
            if inside.sum(1).max() <= 0.7 * len(cell):
                stack += [cell[row] for row in inside]
                continue
        for a in range(len(cell)):
            later = np.arange(a + 1, len(cell))
            later = later[(np.abs(distances[:, later] - distances[:, a : a + 1]) <= eps).all(0)]
            sizes, mine = sets.sizes[cell[later]], sets.sizes[cell[a]]
            later = later[(100 * np.minimum(sizes, mine) >= percent * np.maximum(sizes, mine)) & (roots[later] != roots[a])]
            if len(later):
                for b in later[sets.measure(int(cell[a]), cell[later], percent)[1]]:
                    union.join(int(cell[a]), int(cell[b]))
                roots = np.array([union.root(int(x)) for x in cell])


def _joined(percent: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keep_only("shingles")
        table = table.sort_by([("region", "ascending"), ("v", "ascending")])
        regions = table["region"].to_numpy()
        vs = table["v"].to_numpy()
        raws = table["body"].to_pylist()
        edges = np.flatnonzero(np.r_[True, regions[1:] != regions[:-1]])
        comp = vs.copy()
        for x, y in zip(edges, np.r_[edges[1:], len(vs)], strict=True):
            if y - x > 1:
                union = Union(y - x)
                join_cell(Sets(raws[x:y]), np.arange(y - x), percent, union)
                comp[x:y] = vs[x:y][[union.root(k) for k in range(y - x)]]
        return pa.table({"v": vs, "comp": comp})

    return run


# --- neighbourhoods too large for a task --------------------------------------------------------------------------

ASSIGNED = "parent long, region long, v long, body binary, link long"


def _assign(percent: int):
    """A portion of a large region's members against its pivots: rows for the cells (region renamed), and links."""

    def run(key: tuple[pa.Scalar, ...], members: pa.Table, pivots: pa.Table) -> pa.Table:
        eps = 1 - percent / 100 + 1e-9
        pivots = pivots.sort_by([("v", "ascending")])
        pv, vs = pivots["v"].to_pylist(), members["v"].to_pylist()
        sets = Sets([*pivots["body"].to_pylist(), *members["body"].to_pylist()])
        own = np.arange(len(pv), len(pv) + len(vs))
        out: dict[str, list] = {"parent": [], "region": [], "v": [], "body": [], "link": []}
        parent = key[0].as_py()
        distances = np.empty((len(pv), len(vs)))
        for i, p in enumerate(pv):
            distances[i], links = sets.measure(i, own, percent)
            for k in np.flatnonzero(links):
                if vs[k] != p:
                    for c, value in zip(out, (parent, None, vs[k], None, p), strict=True):
                        out[c].append(value)
        inside = distances <= distances.min(0) + 2 * eps
        raws = members["body"].to_pylist()
        for i, p in enumerate(pv):
            name = int.from_bytes(blake2b(f"{parent}/{p}".encode(), digest_size=8).digest(), "little", signed=True)
            for k in np.flatnonzero(inside[i]):
                if vs[k] != p:  # its links are known
                    for c, value in zip(out, (parent, name, vs[k], raws[k], None), strict=True):
                        out[c].append(value)
        kinds = {"parent": pa.int64(), "region": pa.int64(), "v": pa.int64(), "body": pa.binary(), "link": pa.int64()}
        return pa.table({c: pa.array(out[c], kinds[c]) for c in kinds})

    return run


def _links(percent: int):
    """A portion of a dense region against another: links only."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left["v"].to_pylist(), right["v"].to_pylist()
        out: list[tuple[int, int]] = []
        if a and b:
            sets = Sets([*left["body"].to_pylist(), *right["body"].to_pylist()])
            own = np.arange(len(a), len(a) + len(b))
            union = Union(len(a) + len(b))
            for i in range(len(a)):
                for k in np.flatnonzero(sets.measure(i, own, percent)[1]):
                    if a[i] != b[k] and union.root(i) != union.root(len(a) + k):
                        union.join(i, len(a) + k)
                        out.append((a[i], b[k]))
        return pa.table({"v": pa.array([x for x, _ in out], pa.int64()), "link": pa.array([y for _, y in out], pa.int64())})

    return run


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(v, comp) of every vertex of the edges: comp is the component's least vertex. Labels spread over edges and
    jump to their labels' labels, so rounds grow with the logarithm of a component's diameter."""
    both = cut(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(b, a)).distinct())
    labels = cut(both.groupBy("x").agg(F.least(F.first("x"), F.min("y")).alias("comp")).withColumnRenamed("x", "v"))
    while True:
        near = both.join(labels.select(F.col("v").alias("y"), F.col("comp").alias("l")), "y").select(F.col("x").alias("v"), "l")
        lowest = near.groupBy("v").agg(F.min("l").alias("l")).join(labels, "v").select("v", "comp", F.least("l", "comp").alias("l"))
        hooks = lowest.filter("l < comp").groupBy(F.col("comp").alias("v")).agg(F.min("l").alias("h"))
        # Cut here, so that the join by label reads plain rows of which Spark can split a hot label's.
        hooked = cut(lowest.join(hooks, "v", "left").select("v", "comp", F.least("l", F.coalesce("h", "l")).alias("l")))
        jumped = hooked.join(hooked.select(F.col("v").alias("l"), F.col("l").alias("ll")), "l", "left").select("v", F.least("l", F.coalesce("ll", "l")).alias("new"), "comp")
        step = cut(jumped)
        changed = step.filter("new <> comp").limit(1).count()
        labels = step.select("v", F.col("new").alias("comp"))
        if not changed:
            return labels


def _portions(members: DataFrame, portion_bytes: int) -> DataFrame:
    """members with their region's size, and a portion number that no more than about portion_bytes share."""
    sizes = members.groupBy("region").agg(F.sum(F.octet_length("body") + 64).alias("bytes"), F.count(F.lit(1)).alias("m"))
    sized = members.join(sizes, "region")
    return sized.withColumn("parts", F.ceil(F.col("bytes") / portion_bytes).cast("int")).withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))


def join_regions(members: DataFrame, percent: int, region_bytes: int = 16 << 20) -> DataFrame:
    """(v, comp) of all members that the links within regions connect; members of one region meet in one task up to
    region_bytes, larger regions are cut by distributed pivots, and one that pivots can't cut is compared portion by
    portion."""
    spark = members.sparkSession
    rest, done, links = cut(members), [], []
    while True:
        sized = cut(_portions(rest, region_bytes))
        small = sized.filter("parts = 1")
        total = small.agg(F.sum(F.octet_length("body") + 64).alias("b")).first()["b"] or 0
        groups = max(4, -(-total // (4 << 20)))
        done.append(cut(small.select((F.pmod(F.xxhash64("region"), F.lit(groups))).cast("int").alias("grp"), "region", "v", "body").groupBy("grp").applyInArrow(_joined(percent), FOUND)))
        large = sized.filter("parts > 1")
        if not large.limit(1).count():
            break
        # Few regions are large, and each has at most PIVOTS pivots: the sets with the least numbers, which are hashes.
        order = F.struct("v", "body")
        chosen = large.groupBy("region", "parts").agg(F.slice(F.array_sort(F.collect_list(F.when(F.pmod(F.xxhash64("v", F.lit(7)), F.greatest(F.lit(1), F.floor(F.col("m") / (PIVOTS * 4)))) == 0, order))), 1, PIVOTS).alias("p"))
        pivots = chosen.withColumn("p", F.explode("p")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("region", "part", F.col("p.v").alias("v"), F.col("p.body").alias("body"))
        assigned = cut(large.select("region", "part", "v", "body").groupBy("region", "part").cogroup(pivots.groupBy("region", "part")).applyInArrow(_assign(percent), ASSIGNED))
        links.append(assigned.filter("link is not null").select("v", "link"))
        cells = assigned.filter("link is null").select("parent", "region", "v", "body").distinct()
        # Each region is judged for itself: one that its pivots don't make smaller isn't replicated any further.
        after = cells.groupBy("parent", "region").count().groupBy("parent").agg(F.max("count").alias("after"))
        before = large.groupBy(F.col("region").alias("parent")).agg(F.max("m").alias("before"))
        smaller = cut(before.join(after, "parent", "left").filter(F.coalesce("after", F.lit(0)) <= 0.7 * F.col("before")).select("parent"))
        rest = cut(cells.join(smaller, "parent", "left_semi").select("region", "v", "body"))
        # What pivots can't cut: portion against portion, a triangle of portions for each region.
        dense = cut(large.join(smaller.withColumnRenamed("parent", "region"), "region", "left_anti"))
        left = dense.select("region", "parts", "part", "v", "body")
        pair = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        upper = pair.select("region", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "v", "body")
        first = upper.filter("part = i").select("region", "i", "j", "v", "body")
        second = upper.filter("part = j").select("region", "i", "j", "v", "body")
        links.append(cut(first.groupBy("region", "i", "j").cogroup(second.groupBy("region", "i", "j")).applyInArrow(_links(percent), "v long, link long")))
    local = done[0]
    for more in done[1:]:
        local = local.union(more)
    if not links:
        return local
    edges = local.filter("v <> comp").select("v", F.col("comp").alias("link"))
    for more in links:
        edges = edges.union(more)
    if not edges.limit(1).count():
        return spark.createDataFrame([], FOUND)
    return components(edges, "v", "link")


def components_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, percent: int = 80, block_bytes: int = 8 << 20, region_bytes: int = 16 << 20) -> DataFrame:
    """Groups of documents connected by links: 100 * intersection >= percent * union of their sets of word shingles.

    Words are runs of other than ASCII white space, of text lower-cased for A-Z; a text with fewer words than a
    shingle has its whole sequence as its one shingle. Returns doc_id, n_shingles and component_id (the least
    doc_id of the group), one row per input row. Null, empty and wordless texts have the empty set and no links; a
    missing id is never a component's name unless all ids of the component are missing; rows that share an id are
    told apart by text; an empty table gives no rows; other columns are ignored. Shingles are told apart by 64-bit
    hashes of 64-bit word hashes.
    """
    total = text_bytes(docs, text_column)
    blocks, bits = max(1, -(-total // block_bytes)), _bits(total)
    buckets = max(4, blocks)
    rows = blocked(docs, id_column, text_column, blocks)
    lists = rows.groupBy("block").applyInArrow(_lists(words, buckets, bits), LISTS)
    classes = lists.groupBy("bucket").applyInArrow(_classes, CLASSES)
    sets = cut(rows.groupBy("block").cogroup(classes.groupBy("block")).applyInArrow(_prefixes(words, buckets, percent, bits), SETS))
    vertices = sets.filter("v is not null").groupBy("v").agg(F.min(F.struct("block", "row")).alias("at"), F.first("prefix").alias("prefix"))
    tokens = cut(vertices.select("v", F.explode("prefix").alias("token")))
    pivots = tokens.groupBy("token").agg(F.min("v").alias("pivot"), F.max("v").alias("last")).filter("pivot < last").select("token", "pivot")
    edges = cut(tokens.join(pivots, "token").filter("v <> pivot").select("v", "pivot").distinct())
    regions = components(edges, "v", "pivot").withColumnRenamed("comp", "region")
    wanted = vertices.join(regions, "v").select(F.col("at.block").alias("block"), F.col("at.row").alias("row"), "region", "v")
    members = rows.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(_bodies(words), MEMBERS)
    comps = join_regions(members, percent, region_bytes)
    named = sets.select("doc_id", "n_shingles", "v").join(comps, "v", "left").select("doc_id", "n_shingles", F.coalesce("comp", "v").alias("comp"))
    alone = named.filter("comp is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    groups = named.filter("comp is not null")
    least = groups.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return groups.join(least, "comp").select("doc_id", "n_shingles", "component_id").union(alone)


def brute_force(texts: dict[int, str], words: int, percent: int) -> dict[int, tuple[int, int]]:
    """(n_shingles, component) of each of a few texts, from the definition."""
    sets = {}
    for i, text in texts.items():
        w = text.encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    up = {i: i for i in texts}

    def root(a: int) -> int:
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}
