"""Benchmark decontamination over a distributed positional inverted index.

The index is sharded by documents. A shard numbers its words one after another, with a gap between documents, so one
integer is a posting: document and place at once. A shard keeps, for each term, its sorted postings; terms that no
benchmark item has may be left out when the index is made for one benchmark only. A phrase is found by intersecting
the postings of its terms, each moved back by the term's offset, from the rarest term on; a proximity query keeps
the places of the rarest term around which every other term has a posting in reach.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_only, scratch

#: Bytes that are no word characters become spaces, A-Z become a-z: what is left are ASCII letters, digits, and all beyond ASCII.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INDEX = "doc_ids binary, missing binary, begins binary, lengths binary, terms array<string>, counts binary, postings binary"
HITS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start:long,end:long>>"
#: Text bytes of a shard, and benchmark bytes that one search step sends to the tasks at most.
SHARD_BYTES = 4 << 20
PIECE_BYTES = 8 << 20
GAP = 1 << 10


def words(text: bytes) -> list[bytes]:
    """Words of lower-cased text: runs of ASCII letters, ASCII digits and characters beyond ASCII."""
    return text.translate(_TABLE).split()


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", terms: set[bytes] | None = None) -> DataFrame:
    """One row per shard: its documents (id, first place, number of words) and its postings by term.

    A shard is a run of about SHARD_BYTES of text of one input partition. With `terms`, only their postings are kept.
    Null and empty texts are documents without words.
    """

    def shard(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        begins, lengths, at = [], [], 0
        codes: list[np.ndarray] = []
        number: dict[bytes, int] = {t: k for k, t in enumerate(sorted(terms))} if terms is not None else {}
        for text in texts:
            found = words(text)
            begins.append(at)
            lengths.append(len(found))
            if terms is None:
                for w in found:
                    number.setdefault(w, len(number))
            codes.append(np.fromiter((number.get(w, -1) for w in found), np.int64, len(found)))
            at += len(found) + GAP
        begin = np.array(begins, np.int64)
        size = np.array(lengths, np.int64)
        code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        place = np.arange(len(code)) + np.repeat(begin - (np.cumsum(size) - size), size)
        kept = code >= 0
        code, place = code[kept], place[kept]
        order = np.argsort(code, kind="stable")
        counts = np.bincount(code, minlength=len(number)) if len(number) else np.zeros(0, np.int64)
        have = np.flatnonzero(counts)
        names = list(number)
        gone = np.array([i is None for i in ids], bool)
        row = [np.array([i or 0 for i in ids], "<i8").tobytes(), gone.tobytes(), begin.astype("<i8").tobytes(), size.astype("<i8").tobytes(), [names[k].decode("utf-8", "surrogateescape") for k in have], counts[have].astype("<i4").tobytes(), place[order].astype("<i4").tobytes()]
        kinds = [pa.binary()] * 4 + [pa.list_(pa.string())] + [pa.binary()] * 2
        return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["doc_ids", "missing", "begins", "lengths", "terms", "counts", "postings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("index")
        ids: list = []
        texts: list[bytes] = []
        size = 0
        for batch in batches:
            for i, text in zip(batch["doc_id"].to_pylist(), batch["body"].to_pylist(), strict=True):
                ids.append(i)
                texts.append(text)
                size += len(text) + GAP
                if size > SHARD_BYTES:
                    yield shard(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield shard(ids, texts)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary").alias("body")).mapInArrow(run, INDEX)


class Shard:
    """A shard's postings, for queries."""

    def __init__(self, row: dict) -> None:
        self.ids = [None if m else i for i, m in zip(np.frombuffer(row["doc_ids"], "<i8").tolist(), np.frombuffer(row["missing"], bool), strict=True)]
        self.begins, self.lengths = np.frombuffer(row["begins"], "<i8"), np.frombuffer(row["lengths"], "<i8")
        edges = np.r_[0, np.cumsum(np.frombuffer(row["counts"], "<i4"), dtype=np.int64)]
        places = np.frombuffer(row["postings"], "<i4")
        self.places = {t.encode("utf-8", "surrogateescape"): places[a:b] for t, a, b in zip(row["terms"], edges[:-1].tolist(), edges[1:].tolist(), strict=True)}

    def phrase(self, terms: tuple[bytes, ...]) -> np.ndarray:
        """The first places of all occurrences."""
        lists = []
        for offset, term in enumerate(terms):
            if (places := self.places.get(term)) is None:
                return np.zeros(0, np.int32)
            lists.append((len(places), offset, places))
        lists.sort(key=lambda x: x[:2])
        starts = lists[0][2] - lists[0][1]
        for _, offset, places in lists[1:]:
            at = np.searchsorted(places, starts + offset)
            starts = starts[places[np.minimum(at, len(places) - 1)] == starts + offset]
            if not len(starts):
                break
        return starts

    def near(self, terms: tuple[bytes, ...], reach: int) -> np.ndarray:
        """The places of the rarest term that have every other term at most `reach` words away."""
        lists = [self.places.get(t) for t in set(terms)]
        if any(x is None for x in lists):
            return np.zeros(0, np.int32)
        lists.sort(key=len)
        at = lists[0]
        for places in lists[1:]:
            after = np.searchsorted(places, at)
            right = np.abs(places[np.minimum(after, len(places) - 1)].astype(np.int64) - at)
            left = np.abs(places[np.maximum(after - 1, 0)].astype(np.int64) - at)
            at = at[np.minimum(left, right) <= reach]
        return at

    def owner(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, places, "right") - 1


def windows(text: bytes, width: int) -> set[tuple[bytes, ...]]:
    found = words(text)
    if not found:
        return set()
    if len(found) < width:
        return {tuple(found)}
    return {tuple(found[k : k + width]) for k in range(len(found) - width + 1)}


def search(index: DataFrame, items: list[tuple[str, bytes]], width: int = 10, reach: int | None = None, keyed: bool = False) -> DataFrame:
    """Per document of the index: which items occur, and which words they hit; with `keyed`, also the index's shard
    and the document's place in it, which tell all rows apart.

    Exact phrases of `width` words (a shorter item is one phrase); with `reach`, proximity matches instead: the hits
    are then places of an item window's rarest term.
    """
    where: dict[tuple[bytes, ...], list[str]] = {}
    for name, text in items:
        for window in windows(text, width):
            where.setdefault(window, []).append(name)
    phrases = sorted(where.items())
    # Each phrase as numbers of its terms, filled up by one that every shard has: a shard finds the phrases of which it
    # has all terms at once, and looks at no others.
    number = {t: k for k, t in enumerate(sorted({t for phrase, _ in phrases for t in phrase}))}
    needs = np.full((len(phrases), max((len(p) for p, _ in phrases), default=1)), len(number), np.int32)
    for k, (phrase, _) in enumerate(phrases):
        needs[k, : len(phrase)] = [number[t] for t in phrase]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                names: list[set[str]] = [set() for _ in shard.ids]
                spans: list[list[tuple[int, int]]] = [[] for _ in shard.ids]
                present = np.zeros(len(number) + 1, bool)
                present[[len(number), *(number[t] for t in shard.places if t in number)]] = True
                able = np.ones(len(phrases), bool)
                for column in needs.T:
                    able &= present[column]
                for phrase, found in (phrases[k] for k in np.flatnonzero(able).tolist()):
                    starts = shard.phrase(phrase) if reach is None else shard.near(phrase, reach)
                    if len(starts):
                        size = len(phrase) if reach is None else 1
                        owners = shard.owner(starts)
                        for place, k in zip((starts - shard.begins[owners]).tolist(), owners.tolist(), strict=True):
                            names[k].update(found)
                            spans[k].append((place, place + size))
                merged = [_union(x) for x in spans]
                n_hit = [sum(b - a for a, b in x) for x in merged]
                key = [pa.array([row["shard"]] * len(shard.ids), pa.int64()), pa.array(range(len(shard.ids)), pa.int64())] if keyed else []
                yield pa.record_batch(
                    [
                        pa.array(shard.ids, pa.int64()),
                        pa.array(shard.lengths, pa.int64()),
                        pa.array(n_hit, pa.int64()),
                        pa.array([len(x) for x in names], pa.int64()),
                        pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in names], pa.string()),
                        pa.array([n > 0 for n in n_hit], pa.bool_()),
                        pa.array([sorted(x) for x in names], pa.list_(pa.string())),
                        pa.array([[{"start": a, "end": b} for a, b in x] for x in merged], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        *key,
                    ],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans", *["shard", "place"][: len(key)]],
                )

    return index.mapInArrow(run, HITS + ", shard long, place long" if keyed else HITS)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def benchmark_pieces(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text", piece_bytes: int = PIECE_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in pieces of bounded size, streamed from the executors a partition at a time."""
    rows = benchmark.select(F.col(id_column).cast("string").alias("item_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("body"))
    held: list[tuple[str, bytes]] = []
    size = 0
    for row in rows.toLocalIterator():
        body = row["body"].encode()
        held.append(("" if row["item_id"] is None else row["item_id"], body))
        size += len(body) + 64
        if size >= piece_bytes:
            yield held
            held, size = [], 0
    yield held


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 10, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Exact occurrences of benchmark windows in documents.

    Returns doc_id, n_words, n_hit (words inside any occurrence), n_items, items_sha256, contaminated, items (sorted
    ids) and spans (merged word ranges), a row for each document. A benchmark within piece_bytes is sent to the
    tasks whole; a larger one is searched piece by piece over one stored index of all terms, and the pieces' findings
    are merged by the row's shard and place in it. Null and empty texts have no words and no hits; an empty benchmark hits nothing; items that share an
    id count as one; a missing item id is the empty string; rows are kept apart, also if they share or lack an id.
    """
    pieces = benchmark_pieces(benchmark, text_column="text", piece_bytes=piece_bytes)
    first = next(pieces)
    second = next(pieces, None)
    if second is None or not second:
        return search(build_index(docs, id_column, text_column, _terms(first)), first, width)
    path = scratch(docs.sparkSession, "decontaminate-index")
    # Numbered once and stored: every piece sees the same shards.
    build_index(docs, id_column, text_column).withColumn("shard", F.monotonically_increasing_id()).write.parquet(path)
    index = docs.sparkSession.read.parquet(path)
    whole = search(index, first, width, keyed=True)
    while second:
        whole = whole.unionByName(search(index, second, width, keyed=True))
        second = next(pieces, None)
    ranges = F.expr("""aggregate(array_sort(flatten(collect_list(spans))), cast(array() as array<struct<start:bigint,end:bigint>>), (acc, s) ->
        if(size(acc) = 0 or s.start > element_at(acc, -1).end, concat(acc, array(s)),
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, s.end))))))""")
    grouped = whole.groupBy("shard", "place").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), ranges.alias("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return grouped.withColumn("n_hit", n_hit).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items", "spans"
    )


def _terms(items: list[tuple[str, bytes]]) -> set[bytes]:
    return {w for _, text in items for w in words(text)}


def brute_force(texts: list[bytes], items: list[tuple[str, bytes]], width: int) -> list[tuple[int, int, int, str]]:
    out = []
    for text in texts:
        found, hit, names = words(text), set(), set()
        for name, item in items:
            for window in windows(item, width):
                for k in range(len(found) - len(window) + 1):
                    if tuple(found[k : k + len(window)]) == window:
                        hit.update(range(k, k + len(window)))
                        names.add(name)
        out.append((len(found), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()))
    return out
