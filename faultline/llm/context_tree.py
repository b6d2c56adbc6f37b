"""Context-tree weighting of bytes: a language model whose code length per byte mixes all context depths.

A byte is eight binary decisions, most significant bit first; a decision is a node of the byte's binary tree, named
by the bits before it. For every context (the d bytes before, for each d up to the depth) and node, training counts
zeros and ones, and a Krichevsky-Trofimov estimator prices them. The weighted probability of a context's node is
half its own estimate and half the product of those of the contexts one byte longer. A decision's probability is
then a mix over the depths, in which each weight follows from how well its depth priced the training text. A context
that training has not met defers to the deepest one that it has.

Texts are lower-cased (A-Z); a text is preceded by end bytes (0xFF, which no UTF-8 text has) as context and followed
by one, which is priced as well, so that probabilities of all texts sum to at most 1.

How it is distributed. A block of texts lists its distinct strings of depth + 1 bytes (context and byte) with their
training counts. Lists meet by a hash of the whole string, so that no context is hot, and are summed; the distinct
strings then meet by their last two context bytes, and each group builds its part of the tree in sorted arrays. What
lies above (at most 256 * 255 nodes for one byte of context) is summed by an aggregate and mixed on the driver; that
bound holds for any input. Prices of the strings go back the same ways to the blocks, which add them up by text.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, counted, dealt, distinct, flat, from_planes, keep_only, stored, summed, to_planes

END = 0xFF
LN2 = float(np.log(2.0))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 0.5, by Stirling's series after shifting small arguments up by 8."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    small = x < 8
    z = np.where(small, x + 8, x)
    if small.any():
        s = x[small]
        product = np.ones_like(s)
        for k in range(8):
            product *= s + k
        shift[small] = np.log(product)
    inv = 1 / z
    inv2 = inv * inv
    series = inv * (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 / 1680)))
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + series - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of that many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - float(np.log(np.pi))


def strings(data: np.ndarray, depth: int) -> np.ndarray:
    """For each place from `depth` on: the byte before it, the one before that, ..., and itself as the lowest byte."""
    n = len(data) - depth
    out = data[depth:].astype(np.uint64)
    for j in range(1, depth + 1):
        out |= data[depth - j : depth - j + n].astype(np.uint64) << np.uint64(8 * (depth + 1 - j))
    return out


def positions(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted value is in the sorted, distinct keys, which have them all: by a hash table, then, for the few
    whose slot another key took, by bisection."""
    bits = max(10, int(len(keys)).bit_length() + 3)
    spread, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)
    slots = np.zeros(1 << bits, np.int32)
    slots[(keys * spread) >> shift] = np.arange(len(keys), dtype=np.int32)
    out = np.empty(len(wanted), np.int32)
    for a in range(0, len(wanted), 1 << 18):  # pieces that stay in the cache
        some = wanted[a : a + (1 << 18)]
        at = slots[(some * spread) >> shift]
        missed = np.flatnonzero(keys[at] != some)
        at[missed] = np.searchsorted(keys, some[missed])
        out[a : a + len(some)] = at
    return out


class Level:
    """Nodes of all contexts of one depth: for each bit, groups of (context, bits before), in sorted order."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray) -> None:
        self.pairs = pairs  # context << 8 | byte, sorted, distinct
        self.groups, self.zeros, self.ones, self.of = [], [], [], []
        for j in range(8):
            group = pairs >> np.uint64(8 - j)
            fresh = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
            first = np.flatnonzero(fresh)
            one = (pairs >> np.uint64(7 - j)) & np.uint64(1) == 1
            total = np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)
            up = np.add.reduceat(np.where(one, counts, 0), first) if len(first) else np.zeros(0, np.int64)
            self.groups.append(group[first])
            self.zeros.append(total - up)
            self.ones.append(up)
            self.of.append(np.cumsum(fresh) - 1)


def up_a_level(pairs: np.ndarray, counts: np.ndarray, context_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) pairs with the oldest byte of the context left out."""
    shorter = (pairs >> np.uint64(16)) << np.uint64(8) | (pairs & np.uint64(255))
    return summed(shorter, counts)


class Subtree:
    """The part of the tree below contexts of `root` bytes, from distinct strings and their training counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, root: int) -> None:
        self.depth, self.root = depth, root
        self.levels: dict[int, Level] = {}
        pairs = keys
        for d in range(depth, root - 1, -1):
            self.levels[d] = Level(pairs, counts)
            if d > root:
                pairs, counts = up_a_level(pairs, counts, d)
        self.parent: dict[tuple[int, int], np.ndarray] = {}
        self.ratio: dict[tuple[int, int], np.ndarray] = {}
        self.weighted: dict[tuple[int, int], np.ndarray] = {}
        for d in range(depth, root - 1, -1):
            level = self.levels[d]
            for j in range(8):
                own = np.where(level.zeros[j] + level.ones[j] > 0, log_kt(level.zeros[j], level.ones[j]), 0.0)
                if d == depth:
                    self.weighted[d, j] = own
                    continue
                below = self.weighted[d + 1, j]
                product = np.bincount(self.parent[d + 1, j], weights=below, minlength=len(own))
                self.weighted[d, j] = np.logaddexp(own, product) - LN2
                self.ratio[d, j] = own - product
                if d + 1 < depth:
                    self.weighted.pop((d + 1, j))
            if d > root:
                above = self.levels[d - 1]
                for j in range(8):
                    low = level.groups[j] & np.uint64((1 << j) - 1)
                    self.parent[d, j] = np.searchsorted(above.groups[j], (level.groups[j] >> np.uint64(8 + j)) << np.uint64(j) | low)

    def root_nodes(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each bit: groups at the root's depth, zeros, ones, ln of the weighted probability."""
        level = self.levels[self.root]
        return [(level.groups[j], level.zeros[j], level.ones[j], self.weighted[self.root, j]) for j in range(8)]

    def prices(self, above: Upper) -> np.ndarray:
        """log10 of the probability of each string's byte after its context."""
        deepest = self.levels[self.depth]
        out = np.zeros(len(deepest.pairs))
        for j in range(8):
            at = np.arange(len(deepest.groups[j]))
            known = np.zeros(len(at), bool)
            p = np.full(len(at), 0.5)  # of a one
            for d in range(self.depth, self.root - 1, -1):
                level = self.levels[d]
                n0, n1 = level.zeros[j][at], level.ones[j][at]
                seen = n0 + n1 > 0
                own = (n1 + 0.5) / (n0 + n1 + 1.0)
                if d < self.depth:
                    weight = 1 / (1 + np.exp(np.clip(-self.ratio[d, j][at], -700, 700)))
                    mixed = weight * own + (1 - weight) * p
                else:
                    mixed = own
                p = np.where(seen, np.where(known, mixed, own), p)
                known |= seen
                if d > self.root:
                    at = self.parent[d, j][at]
            group = self.levels[self.root].groups[j][at]
            p = above.mix(j, group, self.root, p, known)
            one = (deepest.pairs >> np.uint64(7 - j)) & np.uint64(1) == 1
            mine = p[deepest.of[j]]
            out += np.log10(np.where(one, mine, 1 - mine))
        return out


class Upper:
    """The tree above contexts of two bytes: dense tables for one byte of context and for none, by node (the bits
    before with a leading 1)."""

    def __init__(self, zeros: np.ndarray, ones: np.ndarray, product: np.ndarray) -> None:
        """Arrays [256, 256] for one byte of context: counts, and the sum over longer contexts' ln probabilities."""
        own = np.where(zeros + ones > 0, log_kt(zeros, ones), 0.0)
        self.zeros, self.ones = [zeros.sum(0), zeros], [ones.sum(0), ones]
        weighted = np.logaddexp(own, product) - LN2
        top = np.where(self.zeros[0] + self.ones[0] > 0, log_kt(self.zeros[0], self.ones[0]), 0.0)
        self.ratio = [top - weighted.sum(0), own - product]

    def mix(self, j: int, group: np.ndarray, root: int, p: np.ndarray, known: np.ndarray) -> np.ndarray:
        node = ((group & np.uint64((1 << j) - 1)) | np.uint64(1 << j)).astype(np.int64)
        context = (group >> np.uint64(j)).astype(np.int64) >> (8 * (root - 1))
        for d in (1, 0):
            pick = (lambda a: a[context, node]) if d else (lambda a: a[node])
            n0, n1 = pick(self.zeros[d]), pick(self.ones[d])
            seen = n0 + n1 > 0
            own = (n1 + 0.5) / (n0 + n1 + 1.0)
            weight = 1 / (1 + np.exp(np.clip(-pick(self.ratio[d]), -700, 700)))
            p = np.where(seen, np.where(known, weight * own + (1 - weight) * p, own), p)
            known = known | seen
        return p


# --- the stages -------------------------------------------------------------------------------------------------

LISTS = "bucket int, block int, keys binary, counts binary, words binary, word_counts binary"
DISTINCT = "ctx int, bucket int, keys binary, counts binary, words binary, word_counts binary, n long, v long"
PRICED = "bucket int, keys binary, prices binary, words binary, word_counts binary"
REPLIES = "block int, bucket int, prices binary, word_counts binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, score double, bits_per_byte double, log_counts double"
#: What stands for the end of a text among the words: it can't be one.
END_WORD = b"\n"


class Block:
    """A block's texts: all places to be priced, the distinct strings, and the distinct words in order."""

    def __init__(self, table: pa.Table, depth: int, buckets: int) -> None:
        keep_only("context tree")
        self.learn = np.array(table["learn"].to_pylist(), bool)
        texts = [t.lower() for t in table["body"].to_pylist()]
        pad = bytes([END]) * depth
        data = np.frombuffer(pad + b"".join(t + pad for t in texts), np.uint8)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        begins = np.cumsum(self.sizes + depth - 1) - (self.sizes + depth - 1)
        places = np.arange(self.sizes.sum()) + np.repeat(begins - (np.cumsum(self.sizes) - self.sizes), self.sizes)
        self.places = strings(data, depth)[places]
        self.keys = distinct(self.places)
        of = self.keys >> np.uint64(8 * max(1, depth - 3))
        of = (of * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        of = (of % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[order], np.arange(buckets + 1))
        self.key_places = {b: order[edges[b] : edges[b + 1]] for b in range(buckets) if edges[b] < edges[b + 1]}
        # Words: the distinct ones in order, and each text's words as numbers of these.
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        ranked = pc.array_sort_indices(coded.dictionary)
        rank = np.empty(len(ranked), np.int64)
        rank[np.asarray(ranked)] = np.arange(len(ranked))
        self.names = coded.dictionary.take(ranked).view(pa.large_binary()).to_pylist()
        owner = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
        number = rank[np.asarray(coded.indices)]
        if self.names and not self.names[0]:  # white space at a text's edge leaves an empty word
            owner, number, self.names = owner[number > 0], number[number > 0] - 1, self.names[1:]
        self.owner, self.number = owner, number
        self.word_bucket: dict[int, list[int]] = {}
        for k, word in enumerate([*self.names, END_WORD]):
            self.word_bucket.setdefault(crc32(word) % buckets, []).append(k)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """How often the texts to learn from have each of the keys, and each of the words (and ends, the last)."""
        seen, n = counted(self.places[np.repeat(self.learn, self.sizes)])
        keys = np.zeros(len(self.keys), np.int64)
        keys[np.searchsorted(self.keys, seen)] = n
        return keys, np.r_[np.bincount(self.number[self.learn[self.owner]], minlength=len(self.names)), self.learn.sum()]


def _join(words: list[bytes]) -> bytes:
    return b" ".join(words)


def _split(joined: bytes | None) -> list[bytes]:
    return joined.split(b" ") if joined else []


def _lists(depth: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = Block(table, depth, buckets)
        counts, word_counts = block.counts()
        names, rows = [*block.names, END_WORD], []
        for b in sorted({*block.key_places, *block.word_bucket}):
            at, words = block.key_places.get(b, np.zeros(0, np.int64)), block.word_bucket.get(b, [])
            rows.append((b, key[0].as_py(), to_planes(block.keys[at]), counts[at].astype("<u4").tobytes(), _join([names[k] for k in words]), word_counts[words].astype("<u4").tobytes()))
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 4
        names = ["bucket", "block", "keys", "counts", "words", "word_counts"]
        return pa.table({n: pa.array([r[k] for r in rows], kinds[k]) for k, n in enumerate(names)})

    return run


def _distinct(depth: int, groups: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keep_only("context tree")
        keys = np.concatenate([from_planes(x) for x in table["keys"].to_pylist()])
        values, sums = summed(keys, flat(table["counts"])[0].view("<u4"))
        words: Counter[bytes] = Counter()
        for joined, n in zip(table["words"].to_pylist(), table["word_counts"].to_pylist(), strict=True):
            for word, k in zip(_split(joined), np.frombuffer(n, "<u4").tolist(), strict=True):
                words[word] += k
        bucket = key[0].as_py()
        names = list(words)
        numbers = np.array([words[w] for w in names], "<i8")
        rows = [(-1 - bucket, bucket, b"", b"", _join(names), numbers.tobytes(), int(numbers.sum()), int((numbers > 0).sum()))]
        of = ((values >> np.uint64(8 * (depth - 1))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
        of = (of % np.uint64(groups)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[order], np.arange(groups + 1))
        for g in range(groups):
            some = order[edges[g] : edges[g + 1]]
            if len(some):
                rows.append((g, bucket, to_planes(values[some]), sums[some].astype("<i8").tobytes(), b"", b"", 0, 0))
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 4 + [pa.int64()] * 2
        names = ["ctx", "bucket", "keys", "counts", "words", "word_counts", "n", "v"]
        return pa.table({n: pa.array([r[k] for r in rows], kinds[k]) for k, n in enumerate(names)})

    return run


def _subtree(table: pa.Table, depth: int) -> tuple[Subtree, np.ndarray, np.ndarray]:
    """The subtree of a group; its keys, which are distinct, and their order."""
    keep_only("context tree")
    keys, counts = np.concatenate([from_planes(x) for x in table["keys"].to_pylist()]), flat(table["counts"])[0].view("<i8")
    order = np.argsort(keys)
    return Subtree(keys[order], counts[order], depth, 2), keys, order


def _tops(depth: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tree = _subtree(table, depth)[0]
        slots, zeros, ones, products = [], [], [], []
        for j, (group, n0, n1, weighted) in enumerate(tree.root_nodes()):
            slot = (group >> np.uint64(j + 8)) << np.uint64(8) | (group & np.uint64((1 << j) - 1)) | np.uint64(1 << j)
            some, at = np.unique(slot, return_inverse=True)
            slots.append(some)
            for out, values in ((zeros, n0), (ones, n1), (products, weighted)):
                out.append(np.bincount(at, weights=values, minlength=len(some)))
        return pa.table({"slot": pa.array(np.concatenate(slots).astype(np.int64)), "zeros": np.concatenate(zeros).astype(np.int64), "ones": np.concatenate(ones).astype(np.int64), "product": np.concatenate(products)})

    return run


def _priced(depth: int, upper: Upper):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kinds = {"bucket": pa.int32(), "keys": pa.binary(), "prices": pa.binary(), "words": pa.binary(), "word_counts": pa.binary()}
        if key[0].as_py() < 0:
            empty = pa.array([b""] * table.num_rows, pa.binary())
            return pa.table({"bucket": table["bucket"], "keys": empty, "prices": empty, "words": table["words"], "word_counts": table["word_counts"]})
        tree, keys, order = _subtree(table, depth)
        prices = np.empty(len(keys))
        prices[order] = tree.prices(upper)
        edges = flat(table["keys"])[1] // 8
        parts = [(b, to_planes(keys[x:y]), prices[x:y].astype("<f8").tobytes(), b"", b"") for b, x, y in zip(table["bucket"].to_pylist(), edges, edges[1:], strict=False)]
        return pa.table({n: pa.array([p[k] for p in parts], kind) for k, (n, kind) in enumerate(kinds.items())})

    return run


def _reply(key: tuple[pa.Scalar, ...], lists: pa.Table, priced: pa.Table) -> pa.Table:
    keep_only("context tree")
    keys = np.concatenate([from_planes(x) for x in priced["keys"].to_pylist()] or [np.zeros(0, np.uint64)])
    prices = flat(priced["prices"])[0].view("<f8")
    order = np.argsort(keys)
    keys, prices = keys[order], prices[order]
    counts: dict[bytes, int] = {}
    for joined, n in zip(priced["words"].to_pylist(), priced["word_counts"].to_pylist(), strict=True):
        counts.update(zip(_split(joined), np.frombuffer(n, "<i8").tolist(), strict=True))
    out = {"block": lists["block"], "bucket": lists["bucket"], "prices": [], "word_counts": []}
    for some, words in zip(lists["keys"].to_pylist(), lists["words"].to_pylist(), strict=True):
        out["prices"].append(prices[np.searchsorted(keys, from_planes(some))].tobytes())
        out["word_counts"].append(np.array([counts[w] for w in _split(words)], "<i8").tobytes())
    return pa.table({"block": out["block"], "bucket": out["bucket"], "prices": pa.array(out["prices"], pa.binary()), "word_counts": pa.array(out["word_counts"], pa.binary())})


def _scored(depth: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, replies: pa.Table) -> pa.Table:
        block = Block(docs, depth, buckets)
        prices, learned = np.zeros(len(block.keys)), np.zeros(len(block.names) + 1, np.int64)
        for b, p, n in zip(replies["bucket"].to_pylist(), replies["prices"].to_pylist(), replies["word_counts"].to_pylist(), strict=True):
            if b in block.key_places:
                prices[block.key_places[b]] = np.frombuffer(p, "<f8")
            learned[block.word_bucket.get(b, [])] = np.frombuffer(n, "<i8")
        each = prices[positions(block.keys, block.places)]
        score = np.add.reduceat(each, np.cumsum(block.sizes) - block.sizes) if len(block.sizes) else np.zeros(0)
        texts, logs = len(block.sizes), np.log10(learned + 0.5)
        n_tokens = np.bincount(block.owner, minlength=texts) + 1
        n_known = np.bincount(block.owner, weights=learned[block.number] > 0, minlength=texts).astype(np.int64) + (learned[-1] > 0)
        log_counts = np.bincount(block.owner, weights=logs[block.number], minlength=texts) + logs[-1]
        return pa.table(
            {
                "doc_id": docs["doc_id"],
                "held_out": pa.array(~block.learn),
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "score": pa.array(score, pa.float64()),
                "bits_per_byte": pa.array(-score / np.log10(2) / block.sizes, pa.float64()),
                "log_counts": pa.array(log_counts, pa.float64()),
            }
        )

    return run


def score_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", folds: int = 5, held_fold: int = 1, depth: int = 5, block_bytes: int = 8 << 20) -> DataFrame:
    """Trains the tree on the documents outside the held fold (crc32 of the id as text, modulo folds), and scores all.

    Returns doc_id, held_out, n_tokens (words and one end), n_known (those met in training), train_tokens,
    base_score (log10 of a smoothed word unigram model's probability), score (log10 of this model's probability of
    the text and its end) and bits_per_byte. depth is 2 to 7 context bytes.

    Null and empty texts are scored by their end alone. A missing id counts as the empty text, so it is learned
    from. Repeated rows are learned from and scored each time. An empty table gives no rows; with no document to
    learn from, every decision has probability 1/2. Other columns are ignored.
    """
    if not 2 <= depth <= 7:
        raise ValueError("depth must be from 2 to 7")
    blocks = bucket_count(docs, text_column, block_bytes)
    buckets = max(4, blocks)
    rows = docs.select(
        dealt(id_column, text_column, blocks).alias("block"),
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary").alias("body"),
        (F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds != held_fold).alias("learn"),
    )
    lists = stored(rows.groupBy("block").applyInArrow(_lists(depth, buckets), LISTS), "context-lists")
    whole = stored(lists.groupBy("bucket").applyInArrow(_distinct(depth, buckets), DISTINCT), "context-strings")
    totals = whole.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = totals["n"] or 0, totals["v"] or 0
    tops = whole.filter("ctx >= 0").groupBy("ctx").applyInArrow(_tops(depth), "slot long, zeros long, ones long, product double")
    zeros, ones, product = np.zeros(65536, np.int64), np.zeros(65536, np.int64), np.zeros(65536)
    for r in tops.groupBy("slot").agg(F.sum("zeros"), F.sum("ones"), F.sum("product")).collect():  # 65,280 rows at most
        zeros[r[0]], ones[r[0]], product[r[0]] = r[1], r[2], r[3]
    upper = Upper(zeros.reshape(256, 256), ones.reshape(256, 256), product.reshape(256, 256))
    priced = whole.groupBy("ctx").applyInArrow(_priced(depth, upper), PRICED)
    replies = lists.groupBy("bucket").cogroup(priced.groupBy("bucket")).applyInArrow(_reply, REPLIES)
    scored = rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_scored(depth, buckets), SCORES)
    norm = float(np.log10(n + 0.5 * (v + 1)))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("log_counts") - F.col("n_tokens") * norm).alias("base_score"), "score", "bits_per_byte")
