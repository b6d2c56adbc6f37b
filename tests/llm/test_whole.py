"""Whole queries and pipeline stages against plain versions of themselves, very long texts, and repeated rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from faultline.llm import context_tree, decision_list, decontaminate, jaccard_join, license_digest, packing, suffix_dedup, token_ids, toxicity, wrapper_extract

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["an", "the", "ou", "tion", "é", "ß", "st", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(words))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def long_text():
    return prose(5, 200_000) + "\n" + "ha" * 300_000


def test_very_long_texts(spark, long_text):
    """A text of nearly two megabytes beside short ones, through every operator that reads texts."""
    rows = [(1, long_text), (2, "short text"), (3, long_text[:400_000])]
    docs = documents(spark, rows)
    scored = {r.doc_id: r for r in context_tree.score_documents(docs, depth=2).collect()}
    assert scored[1].n_tokens == len(long_text.split()) + 1 and math.isfinite(scored[1].score)
    stats = {r.doc_id: r.n_words for r in decision_list.statistics(docs).select("doc_id", "n_words").collect()}
    assert stats == {i: len(t.split()) for i, t in rows}
    sets = {r.doc_id: r.n_shingles for r in jaccard_join.components_of(docs, words=4, percent=85).collect()}
    words = long_text.lower().split()
    assert sets[1] == len({tuple(words[k : k + 4]) for k in range(len(words) - 3)}) and sets[2] == 1
    removed = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs).collect()}
    assert removed[2] == 0 and removed[3] == len(long_text[:400_000].encode()) and removed[1] >= 599_800
    bench = spark.createDataFrame([("a", " ".join(words[100_000:100_012]))], "item_id string, text string")
    found = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.decontaminate(docs, bench).collect()}
    assert found[1][1] >= 12 and found[2] == (2, 0)
    assert {r.doc_id: r.n_license_lines for r in license_digest.scan(documents(spark, [*rows, (4, long_text + "\nLicensed under the MIT License.")])).collect()} == {1: 0, 2: 0, 3: 0, 4: 1}
    page = spark.createDataFrame([(1, "http://h/", f"<article><p>{long_text}</p></article>")], "page_id long, url string, html string")
    assert wrapper_extract.extract_pages(page).first().text == " ".join(long_text.split())


def test_packed_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_ids.default_path("byte_bpe_50k.json"))
    rows = [(k, prose(k, 5 + 13 * k)) for k in range(40)] + [(7, prose(7, 3)), (90, None), (91, ""), (None, "a  b\n \n c "), (92, "\n\n"), (93, "x<|endoftext|>y")]
    got = sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in packing.pack_documents(documents(spark, rows), capacity=64).collect())
    want = []
    for i, text in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 64 or 64
        edges = [0, *range(min(first, len(ids)), len(ids) + 1, 64)]
        want += [(str(i), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert got == sorted(want)


def test_rules_apply_as_written(spark):
    """kept and rule of each row, from the list's conditions and the row's own statistics."""
    rows = [(k, prose(k, 4 + k) + " #" * (k % 7) + ("\nsame line" * (k % 3))) for k in range(60)] + [(5, prose(5, 9)), (99, None)]
    labels = spark.createDataFrame([(k, int(k % 7 < 4)) for k in range(60)], "doc_id long, quality int")
    docs = documents(spark, rows)
    rules = decision_list.train(docs, labels)
    assert rules.rules
    for r in decision_list.apply(docs, rules).collect():
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        x = np.array([[float(r[f]) for f in decision_list.FEATURES]])
        hit = [k for k, rule in enumerate(rules.rules, 1) if all(c.holds(x, decision_list.FEATURES)[0] for c in rule)]
        assert r.base_failed == failed and r.rule == (hit[0] if hit else 0) and r.kept == (not failed and not hit)


def _kernel(a, b):
    def parts(w):
        out = defaultdict(float)
        for i in range(len(w)):
            for p in range(1, toxicity.GAP + 2):
                for q in range(1, toxicity.GAP + 2):
                    if i + p + q < len(w):
                        out[w[i], w[i + p], w[i + p + q]] += toxicity.DECAY ** (p + q + 1)
        return out

    x, y = parts(a), parts(b)
    n = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    s = sum(v * y[k] for k, v in x.items()) / n if n else 0.0
    return s if s >= toxicity.LEAST else 0.0


def plain_scores(model, texts):
    """Scores by the definitions: each word's best spelling against each landmark, then the trained map."""
    m, out = len(model.landmarks), []
    for text in texts:
        words = toxicity.Matcher.words(text or "")
        rows = []
        for word in words:
            core = re.sub(r"^[\W_]+|[\W_]+$", "", word)
            spellings = {core} | ({re.sub(r"[\W_]+", "", core)} if core and not core.isalnum() else set())
            row = [max(min(1.0, _kernel(s, mark)) for s in spellings) for mark in model.landmarks]
            if any(row):
                rows.append(row)
        vector = np.zeros(3 * m)
        if rows:
            hits = np.array(rows)
            total = (hits**4).sum(0)
            vector = np.concatenate([hits.max(0), np.log1p(total), np.log1p(100 * total / len(words))])
        out.append(vector)
    return model.scores(np.array(out).reshape(len(texts), 3 * m))


def _corpus():
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(160):
        words = prose(100 + k, 25).split()
        if k % 4 == 0:
            w = rng.choice(["imbecile", "scoundrel", "moronic"])
            words[k % 25] = w if k % 8 else w[:3] + rng.choice("xq") + w[3:]
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 4 == 0)))
    return rows, labels


def test_toxicity_by_definition(spark):
    rows, labels = _corpus()
    rows += [(500, None), (501, ""), (502, "i-m-b-e-c-i-l-e! moro.nic"), (0, rows[0][1])]
    docs, known = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    assert model.landmarks
    got = sorted((str(r.doc_id), round(r.toxicity, 5)) for r in toxicity.score(docs, model).collect())
    want = plain_scores(model, [t for _, t in rows])
    assert [x for _, x in got] == pytest.approx([x for _, x in sorted((str(i), round(float(s), 5)) for (i, _), s in zip(rows, want))], abs=2e-4)


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage against a plain version of it, on what the stage before kept; repeated rows and missing ids among them."""
    import corpus_pipeline

    rows, labels = _corpus()
    base, shared = prose(900, 90), prose(901, 40)
    rows += [(600, base), (601, base + " x"), (602, base), (603, None), (604, ""), (605, prose(902, 30) + " " + shared + " " + prose(903, 20)), (606, prose(904, 30) + " " + shared + " " + prose(905, 20)), (607, prose(906, 60)), (608, shared[:200]), (None, prose(907, 50)), (610, prose(908, 50)), (610, prose(908, 50))]
    items = [("1", " ".join(rows[-5][1].split()[5:30])), ("2", None)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    have = list(rows)

    def key(pairs):
        return sorted(((str(i), t or "") for i, t in pairs))

    def after(k):
        nonlocal docs
        corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/s{k}")
        docs = spark.read.parquet(f"{tmp_path}/s{k}")
        return [(r.doc_id, r.text) for r in docs.collect()]

    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    have = [r for r, s in zip(have, plain_scores(model, [t for _, t in have])) if s < 0.3]
    assert key(after(0)) == key(have) and 600 in dict(have)

    unique = list(dict.fromkeys(have))
    comps = jaccard_join.brute_force({k: t or "" for k, (_, t) in enumerate(unique)}, 5, 80)
    groups = defaultdict(list)
    for k, row in enumerate(unique):
        groups[comps[k][1]].append(row)
    have = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    assert key(after(1)) == key(have) and 602 not in dict(have)

    have.sort(key=lambda r: (r[0] is not None, r[0] or 0, suffix_dedup.text_order((r[1] or "").encode())))
    cut = suffix_dedup.brute_force([(t or "").encode() for _, t in have], 100)
    left = [(i, t if n == 0 else kept.decode("utf-8", "ignore")) for (i, t), (n, _, kept) in zip(have, cut)]
    have = [(i, t) for (i, t), (n, _, _) in zip(left, cut) if n == 0 or t.strip(" ")]
    assert any(n for n, _, _ in cut) and key(after(2)) == key(have)

    hits = decontaminate.brute_force([(t or "").encode() for _, t in have], [(i, (t or "").encode()) for i, t in items], 10)
    have = [r for r, (_, hit, _, _) in zip(have, hits) if not hit]
    assert key(after(3)) == key(have) and 607 not in dict(have)

    packed = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect()
    assert Counter(str(r.doc_id) for r in packed if r.piece == 0) == Counter(str(i) for i, _ in have)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)


def test_repeated_rows_and_missing_ids(spark):
    """Rows without an id link, are looked up and are scored like others."""
    base = prose(40, 60)
    rows = [(None, base), (None, base), (None, base + " y"), (4, base), (4, base), (5, "Released under the MIT License.")] * 2
    got = jaccard_join.components_of(documents(spark, rows), words=4, percent=85).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter({(None, 4): 6, (4, 4): 4, (5, 5): 2})
    lone = jaccard_join.components_of(documents(spark, rows[:3]), words=4, percent=85).collect()
    assert [(r.doc_id, r.component_id) for r in lone] == [(None, None)] * 3
    assert sum(r.n_license_lines for r in license_digest.scan(documents(spark, rows)).collect()) == 2
    assert len({(r.doc_id, r.score) for r in context_tree.score_documents(documents(spark, rows), depth=2).collect()}) == 4
