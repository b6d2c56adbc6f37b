"""Exact removal of repeated substrings by a distributed, common-prefix-aware merge sort of suffixes.

Which suffixes are sorted. A string of `length` bytes has one anchor: the leftmost of its smallest hashed
k-grams. Equal strings have equal anchors at equal places, so strings can only be equal where their anchors'
hashes are. The windows that share one anchor form a slot: a suffix that starts at the first of these windows and
ends with the last one. Only slots whose anchor hash occurs twice or more in the corpus can hold a repeat; all
others are left out before any text moves.

How they are sorted. Every block sorts its candidate suffixes, keeps the first of equal ones (later ones are
repeats already), cuts the sorted run by anchor hash into buckets and front-codes each piece: the length of the
prefix shared with the suffix before, and the rest. A bucket's runs meet in one task and are combined by a loser
tree whose nodes carry known common prefixes, so that no byte known to be equal is compared again. Suffixes that
come out with a common prefix as long as themselves are one class; its earliest member is the original. Where an
anchor hash has several classes (the borders of repeats), their windows are compared one by one.

A hot passage costs one suffix for each block, not one for each document. Nothing is hashed where equality is
decided: results are exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, blocked, bucket_count, counted, distinct, flat, keep_only

GRAM = 40
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
CHUNK = 1 << 18
PLACE_BITS = 28


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all `gram` bytes long substrings, made by doubling."""
    with np.errstate(over="ignore"):
        power, whole, taken, piece, width = BASE, None, 0, data.astype(np.uint64) + np.uint64(1), 1
        while True:
            if gram & width:
                if whole is None:
                    whole, taken = piece, width
                else:
                    n = len(data) - taken - width + 1
                    if n <= 0:
                        return np.zeros(0, np.uint64)
                    whole = whole[:n] * np.uint64(pow(BASE, width, 1 << 64)) + piece[taken : taken + n]
                    taken += width
            if width * 2 > gram:
                break
            n = len(piece) - width
            if n <= 0:
                return np.zeros(0, np.uint64)
            piece = piece[:n] * np.uint64(power) + piece[width : width + n]
            power, width = power * power & MASK, width * 2
        whole = whole[: max(0, len(data) - gram + 1)]
        whole = whole ^ (whole >> np.uint64(32))
        whole = whole * np.uint64(0xD6E8FEB86659FD93)
        return whole ^ (whole >> np.uint64(29))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def _pieces(offsets: np.ndarray, length: int):
    """(first row, last row, begin, end): whole rows of about CHUNK bytes together, or a part of a long row, whose
    windows overlap no other part's."""
    row, n = 0, len(offsets) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[last])
        if hi - lo <= 2 * CHUNK:
            yield row, last, lo, hi
        else:  # one long row
            for at in range(lo, max(lo + 1, hi - length + 1), CHUNK):
                yield row, last, at, min(hi, at + CHUNK + length - 1)
        row = last


def slots(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For each slot: row, first window's start, number of windows (both in the whole data), anchor hash; and the rows,
    starts and numbers of windows of slots that are left out.

    Left out is a slot equal to the one that ends where it begins (text with a short period): all of its strings
    start earlier in the same row, too. So a text of one letter is a few slots.
    """
    gram = max(1, min(GRAM, length // 2))
    width = length - gram + 1
    found: list[tuple[np.ndarray, ...]] = []
    gone: list[tuple[np.ndarray, ...]] = []
    for row, last, lo, hi in _pieces(offsets, length):
        part = data[lo:hi]
        at = np.minimum(offsets[row : last + 1], hi) - lo
        at[0] = 0
        sizes = np.diff(at)
        windows = np.maximum(0, sizes - length + 1)
        if not windows.sum():
            continue
        hashes = gram_hashes(part, gram)
        tagged = (hashes & ~np.uint64((1 << PLACE_BITS) - 1)) | np.arange(len(hashes), dtype=np.uint64)
        anchor = (sliding_min(tagged, width) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        owner = np.repeat(np.arange(len(sizes)), windows)
        before = np.cumsum(windows) - windows
        start = np.arange(windows.sum()) - before[owner] + at[owner]
        of = anchor[start]
        fresh = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (owner[1:] != owner[:-1])])
        rows, firsts, counts, keys = owner[fresh], start[fresh], np.diff(np.r_[fresh, len(of)]), hashes[of[fresh]]
        again = _periodic(part, rows, firsts, counts, keys, length)
        found.append((rows[~again] + row, firsts[~again] + lo, counts[~again], keys[~again]))
        gone.append((rows[again] + row, firsts[again] + lo, counts[again]))
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) + tuple(np.concatenate(x) for x in zip(*gone, strict=True))


def _periodic(data: np.ndarray, rows: np.ndarray, firsts: np.ndarray, counts: np.ndarray, keys: np.ndarray, length: int) -> np.ndarray:
    """Which slots are equal, byte by byte, to the slot before, which ends where they begin."""
    out = np.zeros(len(rows), bool)
    maybe = 1 + np.flatnonzero((rows[1:] == rows[:-1]) & (keys[1:] == keys[:-1]) & (counts[1:] == counts[:-1]) & (firsts[1:] == firsts[:-1] + counts[:-1]))
    for period in distinct(counts[maybe]).tolist():
        some = maybe[counts[maybe] == period]
        differs = np.r_[0, np.cumsum(data[:-period] != data[period:])]
        begin = firsts[some] - period
        out[some] = differs[begin + period + length - 1] == differs[begin]
    return out


def in_order(table: pa.Table) -> pa.Table:
    """A block's rows by id (missing first), then by text; the row's number is its name in the block from here on."""
    return table.sort_by([("doc_id", "ascending"), ("body", "ascending")]) if table.num_rows else table


def row_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: its id (missing: the least), and its place among rows of that id: a hash of its text, then its
    number among equal rows, which share a block."""
    ids = np.array([np.iinfo(np.int64).min if v is None else v for v in table["doc_id"].to_pylist()], np.int64)
    names = np.array([text_order(t) for t in table["body"].to_pylist()], np.int64)
    _, pair = np.unique(np.stack([ids, names], 1), axis=0, return_inverse=True) if len(ids) else (None, ids)
    return ids, names + np.minimum(_number(pair.ravel()), (1 << 24) - 1)


def text_order(text: bytes) -> int:
    """What orders rows that share an id, or lack one: 39 bits of a hash, with room for 24 more."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little") >> 25 << 24


def _number(values: np.ndarray) -> np.ndarray:
    """Each value's number among equal ones."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    fresh = np.r_[True, ranked[1:] != ranked[:-1]] if len(values) else np.zeros(0, bool)
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - (np.maximum.accumulate(np.where(fresh, np.arange(len(values)), 0)) if len(values) else 0)
    return out


def _cut(keys: np.ndarray, buckets: int):
    """(bucket, positions of its keys) for each bucket that has any."""
    if not len(keys):
        return
    of = (keys >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(of, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0])
    for a, b in zip(edges, np.r_[edges[1:], len(of)], strict=True):
        yield int(of[order[a]]), order[a:b]


# --- sorted runs: front coding and the loser tree ---------------------------------------------------------------


def front_code(matrix: np.ndarray, sizes: np.ndarray) -> tuple[bytes, bytes]:
    """Of sorted strings in a zero-padded matrix: the lengths of the prefixes shared with the one before (uint16,
    with the strings' own lengths), and the remaining bytes."""
    shared = np.zeros(len(sizes), np.int64)
    if len(sizes) > 1:
        same = matrix[1:] == matrix[:-1]
        shared[1:] = np.where(same.all(1), matrix.shape[1], same.argmin(1))
        shared[1:] = np.minimum(shared[1:], np.minimum(sizes[1:], sizes[:-1]))
    place = np.arange(matrix.shape[1])
    rest = matrix[(place >= shared[:, None]) & (place < sizes[:, None])]
    return np.stack([shared, sizes], 1).astype("<u4").tobytes(), rest.tobytes()


def decode(lengths: bytes, rest: bytes):
    """The strings of a front-coded run, each with the length of the prefix it shares with the one before."""
    last, at = b"", 0
    for shared, size in np.frombuffer(lengths, "<u4").reshape(-1, 2).tolist():
        last = last[:shared] + rest[at : at + size - shared]
        at += size - shared
        yield shared, last


def common(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix, of which `known` bytes are known."""
    most = min(len(a), len(b))
    if a[known:most] == b[known:most]:
        return most
    step = 8
    while a[known : known + step] == b[known : known + step]:
        known += step
        step *= 2
    while a[known] == b[known]:
        known += 1
    return known


def merge(runs: list):
    """Merges sorted runs of (shared, string) by a loser tree of common prefixes; yields (run, shared with the
    string before, string). Each inner node keeps the loser of its match and the prefix that it shares with the
    winner; where two prefixes differ, the longer one wins without a look at the strings."""
    width = 1
    while width < len(runs):
        width *= 2
    heads: list = [None] * width
    lcp = [0] * width
    for k, run in enumerate(runs):
        first = next(run, None)
        if first is not None:
            heads[k] = first[1]

    def beats(a: int, b: int) -> tuple[int, int, int]:
        """(winner, loser, prefix that they share): ties go to the earlier run."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a, 0) if x is None and (y is not None or b < a) else (a, b, 0)
        h, g = lcp[a], lcp[b]
        if h != g:
            return (a, b, g) if h > g else (b, a, h)
        n = common(x, y, h)
        if n == len(x) and n == len(y):
            return (a, b, n) if a < b else (b, a, n)
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            return a, b, n
        return b, a, n

    tree = [0] * width
    winners = list(range(width))
    level, base = width, winners
    while level > 1:
        level //= 2
        ahead = []
        for k in range(level):
            won, lost, n = beats(base[2 * k], base[2 * k + 1])
            lcp[lost] = n
            tree[level + k] = lost
            ahead.append(won)
        base = ahead
    top = base[0]
    while heads[top] is not None:
        yield top, lcp[top], heads[top]
        step = next(runs[top], None) if top < len(runs) else None
        heads[top], lcp[top] = (None, 0) if step is None else (step[1], step[0])
        k = (width + top) // 2
        while k >= 1:
            other = tree[k]
            x = heads[other]
            if x is not None:
                h, g = lcp[top], lcp[other]
                if heads[top] is None or g > h:
                    tree[k], top = top, other
                elif g == h:
                    won, lost, n = beats(top, other)
                    lcp[lost] = n
                    tree[k], top = lost, won
            k //= 2


# --- the stages -------------------------------------------------------------------------------------------------

KEYS = "bucket int, block int, hashes binary, twice binary"
FOUND = "block int, hashes binary"
RUNS = "bucket int, block int, lengths binary, rest binary, facts binary, done binary"
SPANS = "block int, spans binary"
FACTS = np.dtype([("hash", "<u8"), ("id", "<i8"), ("rank", "<i8"), ("start", "<i8"), ("row", "<i8"), ("at", "<i8"), ("count", "<i8")])


def _keys(length: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keep_only("suffixes")
        data, offsets = flat(table["body"])
        hashes, n = counted(slots(data, offsets, length)[3])
        out = {"bucket": [], "block": [], "hashes": [], "twice": []}
        for bucket, at in _cut(hashes, buckets):
            out["bucket"].append(bucket)
            out["block"].append(key[0].as_py())
            out["hashes"].append(hashes[at].tobytes())
            out["twice"].append(hashes[at[n[at] > 1]].tobytes())
        return pa.table(out, schema=pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("hashes", pa.binary()), ("twice", pa.binary())]))

    return run


def _found(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Of each block: those of its anchor hashes that occur again, there or elsewhere."""
    data, offsets = flat(table["hashes"])
    whole = data.view("<u8")
    keep_only("suffixes")
    values, n = counted(whole)
    hit = among(whole, distinct(np.concatenate([values[n > 1], flat(table["twice"])[0].view("<u8")])))
    edges = offsets // 8
    return pa.table({"block": table["block"], "hashes": pa.array([whole[a:b][hit[a:b]].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())})


def _runs(length: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, found: pa.Table) -> pa.Table:
        out = {n: [] for n in ("bucket", "block", "lengths", "rest", "facts", "done")}
        schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("lengths", pa.binary()), ("rest", pa.binary()), ("facts", pa.binary()), ("done", pa.binary())])
        keep_only("suffixes")
        docs = in_order(docs)
        data, offsets = flat(docs["body"])
        row, first, count, hashes, gone_row, gone_first, gone_count = slots(data, offsets, length)
        if len(gone_row):
            begin = gone_first - offsets[gone_row]
            for name, value in zip(out, (0, key[0].as_py(), b"", b"", b"", spans_of(gone_row, begin, begin + gone_count + length - 1)), strict=True):
                out[name].append(value)
        wanted = among(hashes, np.sort(flat(found["hashes"])[0].view("<u8"))) if found.num_rows else np.zeros(len(hashes), bool)
        row, first, count, hashes = row[wanted], first[wanted], count[wanted], hashes[wanted]
        ids, rank = row_keys(docs)
        for bucket, at in _cut(hashes, buckets):
            facts = np.zeros(len(at), FACTS)
            facts["hash"], facts["row"], facts["count"] = hashes[at], row[at], count[at]
            facts["id"], facts["rank"] = ids[row[at]], rank[row[at]]
            facts["start"] = facts["at"] = first[at] - offsets[row[at]]
            sizes = count[at] + length - 1
            wide = int(sizes.max())
            matrix = np.lib.stride_tricks.sliding_window_view(np.r_[data, np.zeros(wide, np.uint8)], wide)[first[at]]
            matrix[np.arange(wide) >= sizes[:, None]] = 0
            order = np.lexsort((facts["start"], facts["rank"], facts["id"], sizes, matrix.view(f"S{wide}").ravel() if wide else sizes))
            matrix, sizes, facts = matrix[order], sizes[order], facts[order]
            new = np.r_[True, (matrix[1:] != matrix[:-1]).any(1) | (sizes[1:] != sizes[:-1])]
            lengths, rest = front_code(matrix[new], sizes[new])
            done = facts[~new]
            for name, value in (("bucket", bucket), ("block", key[0].as_py()), ("lengths", lengths), ("rest", rest), ("facts", facts[new].tobytes()), ("done", spans_of(done["row"], done["at"], done["at"] + done["count"] + length - 1))):
                out[name].append(value)
        return pa.table(out, schema=schema)

    return run


def spans_of(row, start, end) -> bytes:
    return np.stack([row, start, end], 1).astype("<i8").tobytes() if len(row) else b""


def _merged(length: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keep_only("suffixes")
        blocks = table["block"].to_pylist()
        facts = [np.frombuffer(x, FACTS) for x in table["facts"].to_pylist()]
        lists = [x.tolist() for x in facts]
        taken = [0] * len(lists)
        spans: dict[int, list] = {b: [] for b in blocks}
        for b, x in zip(blocks, table["done"].to_pylist(), strict=True):
            spans[b] += [x] if x else []
        later: dict[int, list] = {b: [] for b in spans}
        classes: dict[int, list] = {}
        members: list = []
        last = None

        def close() -> None:
            if not members:
                return
            least = min(members, key=lambda m: m[1][1:4])
            for block, fact in members:
                if fact is not least[1]:
                    later[block].append((fact[4], fact[5], fact[5] + fact[6] + length - 1))
            classes.setdefault(least[1][0], []).append((least[1], least[0], last))

        for k, shared, string in merge([decode(a, b) for a, b in zip(table["lengths"].to_pylist(), table["rest"].to_pylist(), strict=True)]):
            fact = lists[k][taken[k]]
            taken[k] += 1
            if last is not None and shared == len(string) == len(last):
                members.append((blocks[k], fact))
            else:
                close()
                members, last = [(blocks[k], fact)], string
        close()
        for group in classes.values():
            if len(group) < 2:
                continue
            first: dict[bytes, tuple] = {}
            for fact, _, string in group:
                for j in range(fact[6]):
                    window, name = string[j : j + length], (fact[1], fact[2], fact[3] + j)
                    if window not in first or name < first[window]:
                        first[window] = name
            for fact, block, string in group:
                run = None
                for j in range(fact[6]):
                    if first[string[j : j + length]] < (fact[1], fact[2], fact[3] + j):
                        run = j if run is None else run
                    elif run is not None:
                        later[block].append((fact[4], fact[5] + run, fact[5] + j - 1 + length))
                        run = None
                if run is not None:
                    later[block].append((fact[4], fact[5] + run, fact[5] + fact[6] - 1 + length))
        for block, found in later.items():
            if found:
                spans[block].append(np.array(found, "<i8").tobytes())
        pairs = [(b, b"".join(x)) for b, x in spans.items() if x]
        return pa.table({"block": pa.array([b for b, _ in pairs], pa.int32()), "spans": pa.array([x for _, x in pairs], pa.binary())})

    return run


def _apply(carry: bool):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, found: pa.Table) -> pa.Table:
        keep_only("suffixes")
        docs = in_order(docs)
        data, offsets = flat(docs["body"])
        edges = np.zeros(len(data) + 1, np.int32)
        spans = flat(found["spans"])[0].view("<i8").reshape(-1, 3)
        if len(spans):
            np.add.at(edges, offsets[spans[:, 0]] + spans[:, 1], 1)
            np.add.at(edges, offsets[spans[:, 0]] + spans[:, 2], -1)
        gone = np.cumsum(edges[:-1]) > 0
        kept = data[~gone]
        removed = np.r_[0, np.cumsum(gone)][offsets]
        begins = gone & ~np.r_[False, gone[:-1]] if len(gone) else gone
        some = offsets[:-1][np.diff(offsets) > 0]
        begins[some] = gone[some]
        runs = np.r_[0, np.cumsum(begins)][offsets]
        left = offsets - removed
        raw = kept.tobytes()
        parts = [raw[a:b] for a, b in zip(left[:-1], left[1:], strict=True)]
        out = {
            "doc_id": docs["doc_id"],
            "n_bytes": pa.array(np.diff(offsets), pa.int64()),
            "n_removed": pa.array(np.diff(removed), pa.int64()),
            "n_spans": pa.array(np.diff(runs), pa.int64()),
            "kept": pa.array(parts, pa.binary()),
        }
        if carry:
            out["kept_text"] = pa.array([x.decode("utf-8", "ignore") for x in parts], pa.string())
            out["carried"] = docs["carried"]
        return pa.table(out)

    return run


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = 100, block_bytes: int = 8 << 20, carry: list[str] | None = None) -> DataFrame:
    """Removes every byte that lies in a `length` bytes long string which also starts earlier in the corpus.

    Texts count as UTF-8 bytes; earlier means a smaller id, or the same row and an earlier start; matches may
    overlap and never cross rows; all strings are judged on the input. Rows without an id come before all others; rows
    that share an id, or lack one, are ordered by a hash of their text (text_order), equal rows in any way. Null and empty texts have no bytes and lose none. An empty table gives an
    empty one; further columns are ignored.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the remaining bytes), a row for
    each input row; with `carry`, kept_text (kept without cut characters) and carried (a struct of those columns of
    the row) as well.
    """
    blocks = bucket_count(docs, text_column, block_bytes)
    buckets = max(4, blocks)
    rows = blocked(docs, id_column, text_column, blocks)
    keys = rows.groupBy("block").applyInArrow(_keys(length, buckets), KEYS)
    found = keys.groupBy("bucket").applyInArrow(_found, FOUND)
    runs = rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_runs(length, buckets), RUNS)
    spans = runs.groupBy("bucket").applyInArrow(_merged(length), SPANS)
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    if carry:
        held = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried"), F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
        rows = blocked(held, "_id", "_text", blocks, "carried")
        out += f", kept_text string, carried {held.schema['carried'].dataType.simpleString()}"
    return rows.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_apply(bool(carry)), out)


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int) -> list[tuple[int, int, bytes]]:
    """(n_removed, n_spans, kept) of each text, for small inputs in order."""
    seen: set[bytes] = set()
    out = []
    for text in texts:
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            window = text[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((sum(gone), spans, bytes(c for c, g in zip(text, gone, strict=True) if not g)))
    return out

