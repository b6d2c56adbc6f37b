"""Fuzzy similarity of short texts below equality: blocks in order of length, and the exact ratio of all that can meet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.text import length_bin
from faultline.operators.cluster import indel_ratios
from faultline.sources.shared import cut

LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "

#: Texts of a block, about; characters whose places a task keeps; pairs of a batch, about; bits of a word, of which the
#: 63rd takes the carry.
BLOCK, KEPT, HELD, WORD = 4096, 512, 1 << 20, 63


def _masks(points: np.ndarray, lengths: np.ndarray, words: int) -> Callable[[int], np.ndarray | None]:
    """The places of a character in every text, as bits of `words` words for each text; None if no text has it."""
    rows, places = np.nonzero(np.arange(points.shape[1]) < lengths[:, None])
    chars = points[rows, places]
    order = np.argsort(chars, kind="stable")
    rows, places, chars = rows[order], places[order], chars[order]
    kept: dict[int, np.ndarray | None] = {}

    def mask(char: int) -> np.ndarray | None:
        if char not in kept:
            if len(kept) >= KEPT:
                kept.clear()
            lo, hi = np.searchsorted(chars, [char, char + 1])
            kept[char] = None
            if hi > lo:
                kept[char] = out = np.zeros((words, len(points)), np.uint64)
                np.bitwise_or.at(out, (places[lo:hi] // WORD, rows[lo:hi]), np.uint64(1) << (places[lo:hi] % WORD).astype(np.uint64))
        return kept[char]

    return mask


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, a row for each, padded with 0, and the texts' lengths."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    width = max(1, int(lengths.max(initial=0)))
    return np.array(texts, f"U{width}").view(np.uint32).reshape(len(texts), width), lengths


def near_texts(one: list[str], other: list[str], least: float, same: bool = False) -> Iterator[tuple[int, float, np.ndarray]]:
    """(place in `other`, ratio, places in `one`) of all pairs whose ratio is at least `least`; if both are the same list,
    of each pair once. Texts of up to 127 characters.

    The bit-parallel steps of indel_ratio run for all texts of `one` at once, a character of an `other` at a time. Others
    are taken in order, so what they share with the one before is not computed again.
    """
    points, sizes = _points(one)
    words = -(-points.shape[1] // WORD)
    mask = _masks(points, sizes, words)
    full = np.array([[(1 << min(max(n - WORD * w, 0), WORD)) - 1 for n in sizes.tolist()] for w in range(words)], np.uint64)
    order = sorted(range(len(other)), key=other.__getitem__)
    theirs, lengths = _points([other[k] for k in order])
    differ = np.c_[theirs[1:] != theirs[:-1], np.ones(len(order) - 1, bool)].argmax(1)
    shared = np.r_[0, np.minimum(np.minimum(lengths[1:], lengths[:-1]), differ)].tolist()
    states = np.empty((theirs.shape[1] + 1, words, len(one)), np.uint64)
    states[0] = full
    hit, rest, low = (np.empty(len(one), np.uint64) for _ in range(3))
    kinds, kind = np.unique(sizes, return_inverse=True)
    base = (kind << 8).astype(np.uint16)
    able: dict[int, np.ndarray] = {}
    for k, n, start, chars in zip(order, lengths.tolist(), shared, theirs.tolist(), strict=True):
        for d in range(start, n):
            at, to, places = states[d], states[d + 1], mask(chars[d])
            if places is None:
                to[:] = at
            elif words == 1:
                np.bitwise_and(at[0], places[0], out=hit)
                np.bitwise_xor(at[0], hit, out=rest)
                np.add(at[0], hit, out=hit)
                np.bitwise_or(hit, rest, out=to[0])
            else:
                low[:] = 0
                for w in range(words):
                    np.bitwise_and(at[w], places[w], out=hit)
                    np.bitwise_xor(at[w], hit, out=rest)
                    np.add(at[w], hit, out=hit)
                    np.add(hit, low, out=hit)
                    np.right_shift(hit, np.uint64(WORD), out=low)
                    np.bitwise_or(hit, rest, out=hit)
                    np.bitwise_and(hit, np.uint64((1 << WORD) - 1), out=to[w])
        missed = np.bitwise_count(np.bitwise_and(states[n][0], full[0], out=hit))
        for w in range(1, words):
            missed += np.bitwise_count(np.bitwise_and(states[n][w], full[w], out=hit))
        if n not in able:
            lcs = np.maximum(kinds[:, None] - np.arange(kinds[-1] + 1), 0)
            able[n] = (100.0 * 2 * lcs / (kinds[:, None] + n) >= least - 1e-9).sum(1).astype(np.uint8)[kind]
        found = np.flatnonzero(missed < able[n])
        if same:
            found = found[: np.searchsorted(found, k)]
        if not len(found):
            continue
        keys = base[found] + missed[found]
        by = np.argsort(keys, kind="stable")
        found, keys = found[by], keys[by]
        ends = np.flatnonzero(np.r_[keys[1:] != keys[:-1], True]) + 1
        begin = 0
        for end in ends.tolist():
            key = int(keys[begin])
            size = int(kinds[key >> 8])
            yield k, 100.0 * 2 * (size - (key & 255)) / (size + n), found[begin:end]
            begin = end


def similar_lists(df: DataFrame, group: str, row: str, text: str, least: float) -> DataFrame:
    """J16, packed: (group, bin, b, ratio, others): distinct texts, each named by its least row, whose ratio to b is
    that. Each pair is in one list, under either of its rows; similar_pairs() spells them out.

    A bin's texts are dealt to blocks in order of length. Blocks meet pair by pair where their lengths allow the ratio,
    so no task holds more than two blocks, and pairs are not rows before they are known to be near.
    """
    rows = df.select(group, row, F.col(text).alias("_t"), length_bin(F.col(text)).alias("bin")).where("bin is not null")
    texts = cut(rows.groupBy(group, "bin", "_t").agg(F.min(row).alias(row)).withColumn("_n", F.length("_t")))
    before = Window.partitionBy(group, "bin").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    sizes = texts.groupBy(group, "bin", "_n").agg(F.count(F.lit(1)).alias("_m")).withColumn("_from", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    block = F.floor((F.col("_from") + F.pmod(F.xxhash64(row), F.col("_m"))) / BLOCK).alias("_k")
    dealt = texts.join(sizes, [group, "bin", "_n"]).select(group, "bin", block, "_n", row, "_t")
    blocks = cut(dealt.groupBy(group, "bin", "_k").agg(F.min("_n").alias("_lo"), F.max("_n").alias("_hi"), F.collect_list(F.struct(F.col(row).alias("r"), F.col("_t").alias("t"))).alias("_texts")))
    one = blocks.select(group, "bin", F.col("_k").alias("_i"), "_hi", F.col("_texts").alias("_one"))
    other = blocks.select(group, "bin", F.col("_k").alias("_j"), "_lo", F.col("_texts").alias("_other"))
    meet = one.join(other, [group, "bin"]).where(f"_i <= _j and _lo <= floor(_hi * {200.0 / least - 1.0} + 1e-9)")
    # A number that is asked for isn't lowered: blocks are small, what they take isn't.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at, bin_, i, j, left, right = (batch.column(c)[k] for c in (group, "bin", "_i", "_j", "_one", "_other"))
                names, those = (x.values.field("r") for x in (left, right))
                ours, theirs = (x.values.field("t").to_pylist() for x in (left, right))
                found: list[tuple[int, float, np.ndarray]] = []
                held = 0

                def packed(found: list) -> pa.RecordBatch:
                    bs, ratios, places = zip(*found, strict=True)
                    ends = np.cumsum([0, *map(len, places)]).astype(np.int32)
                    others = pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(np.concatenate(places))))
                    same = (pa.repeat(x, len(bs)) for x in (at, bin_))
                    return pa.RecordBatch.from_arrays([*same, those.take(pa.array(bs)), pa.array(ratios, pa.float64()), others], [group, "bin", "b", "ratio", "others"])

                for near in near_texts(ours, theirs, least, i == j):
                    found.append(near)
                    held += len(near[2]) + 16  # a list has a cost of its own
                    if held >= HELD:
                        yield packed(found)
                        found, held = [], 0
                if found:
                    yield packed(found)

    schema = f"{group} {kinds[group]}, bin string, b {kinds[row]}, ratio double, others array<{kinds[row]}>"
    return meet.drop("_lo", "_hi").repartition(tasks, group, "bin", "_i", "_j").mapInArrow(run, schema)


def similar_pairs(lists: DataFrame, group: str) -> DataFrame:
    """The pairs (a < b) of similar_lists(), one row for each."""
    pairs = lists.select(group, "bin", F.explode("others").alias("_a"), "b", "ratio")
    return pairs.select(group, "bin", F.least("_a", "b").alias("a"), F.greatest("_a", "b").alias("b"), "ratio")


def similar_texts(df: DataFrame, group: str, row: str, text: str, least: float) -> DataFrame:
    """Pairs (a < b, of distinct texts, each named by its least row) of one group and length bin whose ratio is
    at least `least` (over 0, up to 100)."""
    return similar_pairs(similar_lists(df, group, row, text, least), group)


def similar_groups(df: DataFrame, group: str, row: str, text: str, least: float) -> DataFrame:
    """CL07: (row of a distinct text, anchor): anchors in row order take all similar texts not yet taken, per group and
    bin. Which texts an anchor takes depends on the anchors before it, so a bin's distinct texts meet in one task: an
    anchor is compared with what no anchor before it took, so work grows with texts times anchors, not with pairs."""
    rows = df.select(group, row, F.col(text).alias("_t"), length_bin(F.col(text)).alias("bin")).where("bin is not null")
    texts = rows.groupBy(group, "bin", "_t").agg(F.min(row).alias(row))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row)
        names, words = pdf[row].to_numpy(), pdf["_t"].to_numpy()
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        bags = np.array([[w.count(c) for c in LETTERS] for w in words], np.int32).reshape(len(words), len(LETTERS))
        bags = np.c_[bags, sizes - bags.sum(1)]
        left, out = np.arange(len(words)), []
        while len(left):
            k, left = left[0], left[1:]
            both = sizes[k] + sizes[left]
            able = left[200.0 * np.minimum(sizes[k], sizes[left]) >= least * both - 1e-9]
            able = able[200.0 * (np.minimum(bags[k], bags[able]).sum(1)) >= least * (sizes[k] + sizes[able]) - 1e-9]
            taken = able[indel_ratios(words[k], list(words[able])) >= least - 1e-9] if len(able) else able
            if len(taken):
                out += [(names[k], names[k]), *((names[j], names[k]) for j in taken)]
                left = np.setdiff1d(left, taken, assume_unique=True)
        return pd.DataFrame(out, columns=[row, "anchor"]).astype("int64")

    return texts.groupBy(group, "bin").applyInPandas(run, f"{row} long, anchor long")
