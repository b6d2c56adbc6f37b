"""Token ids of whole texts, by the tokenizers library, with a bounded memory of words met before."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import cached, flat, give_back, keep_only

#: Distinct words whose ids a worker remembers at most (some 25 MB); beyond that it keeps those of the latest batch.
REMEMBERED = 500_000
#: Bytes of text handled at once.
BATCH_BYTES = 2 << 20

#: Words of these characters alone (no apostrophes, and line feeds only one by one inside) are cut into pre-tokens here:
#: runs of letters, of digits (each alone in a word-level file), and of others, as both kinds of file have it.
_SAFE = "^[{0}]+(\n[{0}]+)*$".format("!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff")
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0
_CLASS[48:58], _CLASS[10] = 1, 3
#: The pre-tokenizer pattern of a word-level file that is cut so.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A space beside white space or at an end: there it isn't certain that a new pre-token begins with the space.
_UNSURE = r"^ | $| [\s\x0b\x1c-\x1f\x85\pZ]|[\s\x0b\x1c-\x1f\x85\pZ] "
_SURE = re.compile(r"(?<=\S) (?=\S)")


def _byte_names() -> dict[int, str]:
    """Of safe characters (and the space): the characters that stand for their UTF-8 bytes in a byte-level file, where
    a printable byte other than the space is itself, and the others count up from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    names = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}
    return {c: "".join(names[b] for b in chr(c).encode()) for c in [10, *range(32, 127), *range(192, 256)]}


def _gather(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """pool's slices one after another, and their edges."""
    edges = np.r_[0, np.cumsum(size)]
    return pool[np.arange(edges[-1]) + np.repeat(begin - edges[:-1], size)], edges


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all lists, and the lists' sizes."""
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum())), size


class WordEncoder:
    """Encodes texts word by word. A single space between two characters other than white space always begins a new
    pre-token in both kinds of file (with the word after it in a byte-level one, dropped in the other), so a text's
    ids are those of its words in turn. Texts with other spaces are cut at those spaces alone; texts with what may be
    an added token, and all texts for a file of another kind, are encoded whole.

    A batch's words become numbers of its distinct words by a hash table; the library merges the pre-tokens of the
    new ones among these, and the ids of all words are then gathered by number.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        before = json.loads(self.library.to_str())["pre_tokenizer"] or {}
        first = before.get("pretokenizers", [before])[0]
        self.byte_level = self.library.normalizer is None and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space", False)
        self.by_words = self.byte_level or first.get("pattern") == {"Regex": _WORD_PATTERN}
        self.names = _byte_names()
        self.marks = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.ids, self.edges = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _units(self, words: pa.Array, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of safe words, by the library's merges of their pre-tokens."""
        if not len(words):
            return _flat([])
        if not self.byte_level:
            words = pc.utf8_lower(words)
        elif spaced:
            words = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), words, pa.scalar(" ", pa.large_string()))
        data, edges = flat(words)
        kind = _CLASS[data]
        if self.byte_level and spaced:  # the space belongs to what follows
            kind[edges[:-1]] = kind[edges[:-1] + 1]
        fresh = np.r_[True, kind[1:] != kind[:-1]]
        if not self.byte_level:
            fresh |= kind == 1
        fresh[edges[:-1]] = True
        begins = np.flatnonzero(fresh)
        units = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.r_[begins, len(data)].astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        names, merged = self.names, self.model.tokenize
        if not self.byte_level:
            merged = lambda u: self.model.tokenize(u) if u != names[10] else []  # noqa: E731 (white space is dropped)
        pool, sizes = _flat([[t.id for t in merged(u if u.isascii() and u[0] > " " else u.translate(names))] for u in units.dictionary.to_pylist()])
        number = np.asarray(units.indices)
        ids, ends = _gather(pool, (np.cumsum(sizes) - sizes)[number], sizes[number])
        return ids, np.diff(ends[np.r_[np.searchsorted(begins, edges[:-1]), len(begins)]])

    def _lists(self, words: pa.Array, spaced: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' numbers in an order of its own, their ids and sizes: of safe ones by pre-tokens, of others as texts."""
        safe = pc.match_substring_regex(words, _SAFE)
        plain, rest = words.filter(safe), words.filter(pc.invert(safe))
        ids, sizes = self._units(plain, spaced)
        lead = " " if spaced and self.byte_level else ""
        more, n = _flat([x.ids for x in self.library.encode_batch_fast([lead + w for w in rest.to_pylist()], add_special_tokens=False)])
        order = np.argsort(~safe.to_numpy(zero_copy_only=False), kind="stable")
        return order, np.concatenate([ids, more]), np.concatenate([sizes, n])

    def encode(self, texts: pa.Array | list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers, in order."""
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        size = pc.cumulative_sum(pc.fill_null(pc.binary_length(column), 0)).to_numpy(zero_copy_only=False) if len(column) else np.zeros(0)
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH_BYTES, "right")))
            yield from self._encode(column.slice(at, end - at))
            give_back()  # three workers' free memory is a tenth of what an executor has
            at = end

    def _encode(self, column: pa.Array) -> Iterator[bytes]:
        whole = pa.array([not self.by_words] * len(column), pa.bool_())
        for mark in self.marks:
            whole = pc.or_(whole, pc.match_substring(column, mark))
        unsure = pc.match_substring_regex(column, _UNSURE)
        kinds = np.where(whole.to_numpy(zero_copy_only=False), 2, unsure.to_numpy(zero_copy_only=False)).astype(np.int8)
        done: list[Iterator[bytes]] = [
            self._by_words(pc.split_pattern(column.filter(pa.array(kinds == 0)), " ")),
            self._by_words(pa.array([_SURE.split(t) for t in column.filter(pa.array(kinds == 1)).to_pylist()], pa.large_list(pa.large_string()))),
            (self._ids(t).tobytes() for t in column.filter(pa.array(kinds == 2)).to_pylist()),
        ]
        for kind in kinds.tolist():
            yield next(done[kind])

    def _places(self, distinct: pa.Array) -> np.ndarray:
        """Numbers of distinct words among those remembered, which learn the new ones."""
        known = pc.index_in(distinct, value_set=self.words)
        place = np.asarray(known.fill_null(-1)).astype(np.int64)
        fresh = np.flatnonzero(place < 0)
        if not len(fresh):
            return place
        if len(self.words) + len(fresh) > REMEMBERED:
            kept = np.sort(place[place >= 0])
            self.words = self.words.take(pa.array(kept))
            self.ids, self.edges = _gather(self.ids, self.edges[kept], np.diff(self.edges)[kept])
            place[place >= 0] = np.searchsorted(kept, place[place >= 0])
        new = distinct.take(pa.array(fresh))
        order, ids, sizes = self._lists(new, True)
        place[fresh[order]] = len(self.words) + np.arange(len(order))
        self.words = pa.concat_arrays([self.words, new.take(pa.array(order))])
        self.ids = np.concatenate([self.ids, ids])
        self.edges = np.concatenate([self.edges, self.edges[-1] + np.cumsum(sizes)])
        return place

    def _by_words(self, lists: pa.Array) -> Iterator[bytes]:
        if not len(lists):
            return
        first = np.asarray(lists.offsets)[:-1].astype(np.int64) - int(np.asarray(lists.offsets)[0])
        words = lists.flatten().cast(pa.large_string())
        coded = words.dictionary_encode()
        place = self._places(coded.dictionary)[np.asarray(coded.indices)]
        begin, size, pool = self.edges[place], np.diff(self.edges)[place], self.ids
        if self.byte_level:  # the first word has no space before it
            heads = words.take(pa.array(first)).dictionary_encode()
            order, found, sizes = self._lists(heads.dictionary, False)
            at = np.argsort(order)[np.asarray(heads.indices)]
            begin[first], size[first] = (len(pool) + np.cumsum(sizes) - sizes)[at], sizes[at]
            pool = np.concatenate([pool, found])
        ids, ends = _gather(pool, begin, size)
        raw, edges = ids.astype("<u4").tobytes(), (4 * ends[np.r_[first, len(words)]]).tolist()
        for a, b in zip(edges, edges[1:], strict=False):
            yield raw[a:b]


_encoders: dict[str, WordEncoder] = cached("tokens", {})


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker and file."""
    keep_only("tokens")
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
