"""Toxicity scores by a subsequence string kernel, Nystroem landmarks and a support vector machine.

Two words are as similar as the subsequences of three characters that they share: one whose characters span s places
weighs decay**s in a word, and no two of its characters may have more than `gap` others between them. So an insult
with characters put in or left out still shares most of its subsequences with the insult itself. The kernel is
normalised: a word's similarity with itself is 1.

Landmarks are words that labelled toxic texts have far more often than others. A text's kernel with a landmark is that
of its best matching word; a second kernel adds up all good matches, and a third relates them to the text's length.
The kernels with the landmarks are whitened by the landmarks' own kernel matrix (the Nystroem map), and a linear SVM
with squared hinge loss is trained on them; a sigmoid turns its margin into a probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, keep_only, sql_ascii_lower

DECAY = 0.7
GAP = 2
#: Similarities below this count as none.
LEAST = 0.3
LANDMARKS = 96
SAMPLE = 12_000
#: Words of the sample from which landmarks are chosen, those most of toxic texts first; and of these again, by signed
#: chi-square, so many for each landmark.
CANDIDATES, FOR_EACH = 4_000, 6
#: A word that similar to a stronger landmark is none itself.
ALIKE = 0.9
#: Texts of which a task holds the vectors at once.
SLICE = 200
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_MARKS = re.compile(r"[\W_]+")
_SPELLED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")


class Kernel:
    """Similarities of words with landmarks, many words at once."""

    def __init__(self, landmarks: list[str]) -> None:
        self.landmarks = landmarks
        codes, weights, owner = self._features(landmarks)
        self.norms = self._norms(codes, weights, owner, len(landmarks))
        self.features, at = np.unique(codes, return_inverse=True)
        self.table = np.zeros((len(self.features) + 1, len(landmarks)))
        np.add.at(self.table, (at, owner), weights)
        self.table /= np.maximum(self.norms, 1e-12)
        self.top = self.table.max(1) if landmarks else np.zeros(1)
        # Most subsequences are no landmark's: a small table of hashes tells before they are looked up.
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self._hash(self.features)] = True

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        return (codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)

    @staticmethod
    def _features(words: list[str], start: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each subsequence occurrence: its code, weight and word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        codes, weights, owners = [], [], []
        n = len(chars)
        for a in range(1, GAP + 2):
            for b in range(1, GAP + 2):
                span = a + b
                if n <= span:
                    continue
                whole = owner[: n - span] == owner[span:]
                i = np.flatnonzero(whole)
                codes.append(chars[i] << 42 | chars[i + a] << 21 | chars[i + span])
                weights.append(np.full(len(i), DECAY ** (span + 1)))
                owners.append(owner[i])
        if not codes:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        return np.concatenate(codes), np.concatenate(weights), np.concatenate(owners)

    @staticmethod
    def _norms(codes: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        order = np.lexsort((codes, owner))
        codes, weights, owner = codes[order], weights[order], owner[order]
        if not len(codes):
            return np.zeros(n)
        first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])])
        return np.sqrt(np.bincount(owner[first], weights=np.add.reduceat(weights, first) ** 2, minlength=n))

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the words that are similar to any landmark, their similarities)."""
        codes, weights, owner = self._features(words)
        hit = np.flatnonzero(self.maybe[self._hash(codes)])
        at = np.searchsorted(self.features, codes[hit])
        same = self.features[np.minimum(at, len(self.features) - 1)] == codes[hit] if len(self.features) else np.zeros(0, bool)
        hit, at = hit[same], at[same]
        # The norm is at least the root of the sum of squared weights, and no landmark's share exceeds its table entry.
        low = np.sqrt(np.bincount(owner, weights=weights**2, minlength=len(words)))
        bound = np.bincount(owner[hit], weights=weights[hit] * self.top[at], minlength=len(words))
        able = (bound >= LEAST * np.maximum(low, 1e-12)) & (low > 0)
        numbers = np.flatnonzero(able)
        if not len(numbers):
            return numbers, np.zeros((0, len(self.landmarks)))
        place = np.full(len(words), -1)
        place[numbers] = np.arange(len(numbers))
        mine = able[owner]
        norms = self._norms(codes[mine], weights[mine], place[owner[mine]], len(numbers))
        keep = able[owner[hit]]
        hit, at = hit[keep], at[keep]
        of = place[owner[hit]]
        order = np.argsort(of, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0])
        out = np.zeros((len(numbers), len(self.landmarks)))
        out[of[order[first]]] = np.add.reduceat(weights[hit[order]][:, None] * self.table[at[order]], first)
        out /= norms[:, None]
        out[out < LEAST] = 0
        good = out.any(1)
        return numbers[good], np.minimum(out[good], 1)


class Matcher:
    """Kernel vectors of texts; remembers the words it has met, a bounded number of them."""

    def __init__(self, landmarks: list[str], remembered: int = 200_000) -> None:
        self.kernel, self.remembered = Kernel(landmarks), remembered
        self.known: dict[str, np.ndarray | None] = {}

    @staticmethod
    def words(text: str) -> list[str]:
        low = text.lower()
        found = low.split()
        found += [re.sub(r"\s", "", m) for m in _SPELLED.findall(low)]
        return found

    def vectors(self, texts: list[str]) -> np.ndarray:
        split = [self.words(t) for t in texts]
        if len(self.known) > self.remembered:
            self.known.clear()
        new = [w for w in {w for s in split for w in s} if w not in self.known]
        cores = [_EDGE.sub("", w) for w in new]
        names = list(new)
        for word, core in zip(new, list(cores), strict=True):  # marks between letters may be put in: the letters alone, too
            if not core.isalnum() and core:
                names.append(word)
                cores.append(_MARKS.sub("", core))
        self.known.update(dict.fromkeys(new))
        for at in range(0, len(cores), 8192):  # bounded memory
            numbers, rows = self.kernel.rows(cores[at : at + 8192])
            for k, row in zip((numbers + at).tolist(), rows.astype(np.float32), strict=True):
                have = self.known[names[k]]
                self.known[names[k]] = row if have is None else np.maximum(have, row)
        m = len(self.kernel.landmarks)
        out = np.zeros((len(texts), 3 * m))
        get = self.known.__getitem__
        for k, some in enumerate(split):
            hits = [r for r in map(get, some) if r is not None]
            if hits:
                all_ = np.array(hits)
                total = (all_**4).sum(0)
                out[k, :m] = all_.max(0)
                out[k, m : 2 * m] = np.log1p(total)
                out[k, 2 * m :] = np.log1p(100 * total / len(some))
        return out


class Model:
    """The trained classifier; small and picklable."""

    def __init__(self, landmarks: list[str], vectors: np.ndarray, labels: np.ndarray, penalty: float = 0.02) -> None:
        self.landmarks = landmarks
        m = len(landmarks)
        kernel = np.eye(m)
        numbers, rows = Kernel(landmarks).rows(landmarks) if m else (np.zeros(0, np.int64), np.zeros((0, 0)))
        kernel[numbers] = rows
        values, basis = np.linalg.eigh((kernel + kernel.T) / 2 + 1e-3 * np.eye(m))
        self.whiten = basis @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ basis.T
        x = self._map(vectors)
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        x = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        y = np.where(labels > 0, 1.0, -1.0)
        self.weights = _squared_hinge(x, y, penalty)
        self.slope, self.shift = _sigmoid(x @ self.weights, labels)

    def _map(self, vectors: np.ndarray) -> np.ndarray:
        m = len(self.landmarks)
        return np.concatenate([vectors[:, k * m : (k + 1) * m] @ self.whiten for k in range(3)], 1) if m else np.zeros((len(vectors), 0))

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        x = np.c_[(self._map(vectors) - self.mean) / self.scale, np.ones(len(vectors))]
        return 1 / (1 + np.exp(-np.clip(self.slope * (x @ self.weights) + self.shift, -500, 500)))


def _squared_hinge(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """Newton's method on the primal; penalty per row."""
    n, d = x.shape
    w = np.zeros(d)
    for _ in range(40):
        margin = y * (x @ w)
        active = margin < 1
        xa = x[active]
        gradient = penalty * n * w - xa.T @ (y[active] * (1 - margin[active]))
        step = np.linalg.solve(penalty * n * np.eye(d) + xa.T @ xa + 1e-9 * np.eye(d), gradient) if n else np.zeros(d)
        w = w - step
        if np.abs(step).max(initial=0) < 1e-6:
            break
    return w


def _sigmoid(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Platt's sigmoid, by Newton's method on softened targets."""
    pos, neg = float((labels > 0).sum()), float((labels <= 0).sum())
    if not pos or not neg:
        return 0.0, float(np.log((pos + 0.5) / (neg + 0.5)))
    t = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        g = np.array([(margin * (p - t)).sum() + 1e-3 * a, (p - t).sum()])
        q = p * (1 - p) + 1e-9
        h = np.array([[(q * margin**2).sum() + 1e-3, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(a), float(b)


def choose_landmarks(counts: list[tuple[str, int, int]], toxic: int, other: int, most: int = LANDMARKS) -> list[str]:
    """From (word, toxic texts with it, other texts with it): the strongest by signed chi-square, none nearly the
    same as a stronger one."""
    merged: dict[str, list[int]] = {}
    for word, a, b in counts:
        core = _EDGE.sub("", word.lower())
        if len(core) >= 3:
            have = merged.setdefault(core, [0, 0])
            have[0] += a
            have[1] += b
    scored = []
    n = toxic + other
    for word, (a, b) in merged.items():
        a, b = min(a, toxic), min(b, other)
        if a * other > 3 * b * toxic:
            expected = (a + b) * toxic / n
            scored.append(((a - expected) ** 2 / (expected + 0.5), word))
    ranked = [word for _, word in sorted(scored, key=lambda s: (-s[0], s[1]))[: FOR_EACH * most]]
    alike = np.eye(len(ranked))
    if ranked:
        numbers, rows = Kernel(ranked).rows(ranked)
        alike[numbers] = rows
    chosen: list[int] = []
    for k in range(len(ranked)):
        if len(chosen) < most and not (alike[k, chosen] > ALIKE).any():
            chosen.append(k)
    return [ranked[k] for k in chosen]


def _fold(id_column: str, folds: int):
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", folds: int = 4, held_fold: int = 2, sample: int = SAMPLE) -> Model:
    """Fits the model on at most `sample` labelled texts outside the held fold, those whose ids have the least hashes.

    The bound keeps what the driver sees small: the counts of at most CANDIDATES words and the kernel vectors of the
    sample. Rows without a label, an id or a text aren't used; with one class only, or none, the model returns the
    class's share.
    """
    known = labels.select(F.col(id_column).alias("label_id"), F.col(label_column).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("label_id").isNotNull())
    known = known.where(_fold("label_id", folds) != held_fold).groupBy("label_id").agg(F.max("label").alias("label"))
    # Ids first: the sample is drawn from labels of documents that exist, then their texts are fetched.
    present = known.join(docs.select(F.col(id_column).alias("label_id")).distinct(), "label_id", "left_semi")
    drawn = present.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    texts = docs.select(F.col(id_column).alias("label_id"), F.col(text_column).cast("string").alias("body")).join(F.broadcast(drawn), "label_id").where(F.col("body").isNotNull()).select("label", "body").persist()
    try:
        sizes = {r["label"]: r["n"] for r in texts.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
        toxic, other = sizes.get(1, 0), sizes.get(0, 0)
        words = texts.select((F.col("label") > 0).cast("long").alias("y"), F.explode(F.array_distinct(F.split(sql_ascii_lower(F.col("body")), SPACE))).alias("word")).where("word <> ''")
        counts = words.groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where("a >= 3")
        counts = counts.orderBy((F.col("a") / (F.col("b") + 1)).desc(), "word").limit(CANDIDATES).collect() if toxic and other else []
        landmarks = choose_landmarks([(r["word"], r["a"], r["b"]) for r in counts], toxic, other)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keep_only("toxicity")
            matcher = Matcher(landmarks)
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    vectors = matcher.vectors(part["body"].to_pylist())
                    yield pa.record_batch([part["label"], pa.array([v.astype("<f4").tobytes() for v in vectors], pa.binary())], names=["label", "vector"])

        rows = texts.repartition(16).mapInArrow(run, "label int, vector binary").collect()
    finally:
        texts.unpersist()
    vectors = np.array([np.frombuffer(r["vector"], "<f4") for r in rows], np.float64).reshape(len(rows), 3 * len(landmarks))
    return Model(landmarks, vectors, np.array([r["label"] for r in rows], np.int64))


def probability(model: Model, text: Column) -> Column:
    """The toxicity of whole texts, 0 to 1; null counts as empty. Only the texts go through Python."""

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keep_only("toxicity")
        matcher = Matcher(model.landmarks)
        for batch in batches:
            found = [np.zeros(0)]
            for at in range(0, len(batch), SLICE):
                found.append(model.scores(matcher.vectors(["" if t is None else t for t in batch.slice(at, SLICE).to_pylist()])))
            yield pa.array(np.concatenate(found))

    return scores.asNondeterministic()(text.cast("string"))


def score(docs: DataFrame, model: Model, text_column: str = "text", threshold: float = 0.3) -> DataFrame:
    """Adds toxicity (0 to 1) and toxic (int) to every row, from its whole text; columns of these names are replaced.

    Null texts are scored as empty ones; repeated rows each get the same score; a score equal to the threshold is
    toxic; an empty table gives no rows.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("toxicity", "toxic")]
    scored = docs.select(*kept, probability(model, F.col(text_column)).alias("toxicity"))
    return scored.withColumn("toxic", (F.col("toxicity") >= threshold).cast("int"))


def predictions(docs: DataFrame, labels: DataFrame, folds: int = 4, held_fold: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted of every document: a thin view of train() and score().

    A missing id counts as the empty text in the fold's rule; nulls, repeated rows, ties and empty tables are as in
    train() and score().
    """
    model = train(docs, labels, folds=folds, held_fold=held_fold)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (_fold("doc_id", folds) == held_fold).alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic").alias("predicted"))
