"""The training-data operators against brute force, on hand-made tables: nulls, empty and long texts, ties, repeated
rows, empty tables, and extra columns with clashing names."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import context_tree, decision_list, decontaminate, jaccard_join, license_digest, packing, suffix_dedup, token_ids, token_store, toxicity, wrapper_extract
from faultline.llm.common import scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, block string, row int, hash string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, "clash", 7, None) for i, t in rows], DOCS)


def prose(seed, words, vocabulary=400):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["an", "the", "ou", "tion", "é", "ß"]) for _ in range(rng.randint(1, 4))) + str(rng.randint(0, vocabulary)) * (rng.random() < 0.2) for _ in range(words))


@pytest.fixture(scope="module")
def corpus():
    base = prose(1, 120)
    rows = [(1, base), (2, base), (3, base + " tail words here"), (4, None), (5, ""), (6, "x"), (7, prose(2, 80)), (8, "a" * 400), (9, prose(3, 3000)), (10, prose(4, 40) + " " + base[100:500]), (11, " \t\n "), (None, prose(5, 30)), (None, base), (12, "dup"), (12, "dup"), (13, base.replace("the", "THE", 3))]
    return rows


def test_suffix_dedup(spark, corpus):
    shared = prose(77, 40)
    lone = [(None, f"{prose(80 + k, 20)} {shared} {prose(90 + k, 15)}") for k in range(6)]
    odd = [(40, "ab" * 300), (41, "xyz" * 90 + prose(3, 30) + "xyz" * 90), (42, "a" * 700), (43, None), (44, prose(9, 3000))]
    rows = [*corpus, *lone, *odd]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, suffix_dedup.text_order((r[1] or "").encode())))
    for length, block in ((100, 8 << 20), (100, 3000), (24, 700)):
        got = suffix_dedup.remove_repeats(table(spark, rows), length=length, block_bytes=block, carry=["lang", "block"]).collect()
        want = suffix_dedup.brute_force([(t or "").encode() for _, t in ordered], length)
        assert sorted((str(r.doc_id), r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted((str(i), *w) for (i, _), w in zip(ordered, want, strict=True))
        assert {r.carried.block for r in got} == {"clash"}
    assert suffix_dedup.remove_repeats(table(spark, [])).count() == 0


def test_suffix_slots_of_degenerate_text():
    """A text of one letter, and parts of a long text: few slots, all windows covered once."""
    for text in (b"a" * 4_000_000, b"abcab" * 200_000, prose(5, 60_000).encode()):
        data = np.frombuffer(text, np.uint8)
        row, first, count, _, gone_row, gone_first, gone_count = suffix_dedup.slots(data, np.array([0, len(data)]), 100)
        whole = np.concatenate([np.stack([first, count], 1), np.stack([gone_first, gone_count], 1)])
        whole = whole[np.argsort(whole[:, 0])]
        assert whole[0, 0] == 0 and (whole[1:, 0] == whole[:-1, 0] + whole[:-1, 1]).all() and whole[-1].sum() == len(data) - 99
        assert len(first) < len(data) / (3 if b" " in text else 10_000)


def test_loser_tree_sorts_and_knows_prefixes():
    rng = random.Random(0)
    words = sorted("".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(300))
    runs = [sorted(rng.sample(words, 40)) for _ in range(7)]

    def coded(run):
        last = b""
        for w in run:
            yield suffix_dedup.common(last, w, 0) if last or w else 0, w
            last = w

    out = list(suffix_dedup.merge([coded(r) for r in runs]))
    assert [w for _, _, w in out] == sorted(w for r in runs for w in r)
    assert all(n == suffix_dedup.common(a[2], b[2], 0) for a, b in zip(out, out[1:]) for n in [b[1]])
    assert list(suffix_dedup.merge([])) == []


@pytest.mark.parametrize(("words", "percent", "region"), [(4, 85, 16 << 20), (5, 80, 16 << 20), (4, 85, 3000)])
def test_jaccard_join(spark, words, percent, region):
    rng = random.Random(7)
    rows = []
    for c in range(6):
        base = prose(c, 60).split()
        for k in range(14):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = f"edit{rng.random()}"
            rows.append((100 * c + k, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "\n"), (905, rows[0][1]), (905, rows[0][1])]
    want = jaccard_join.brute_force({i: t or "" for i, t in rows}, words, percent)
    got = jaccard_join.components_of(table(spark, rows), words=words, percent=percent, block_bytes=4000, region_bytes=region).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert jaccard_join.components_of(table(spark, []), words=words, percent=percent).count() == 0


def test_context_tree(spark, corpus):
    depth = 3
    rows = [r for r in corpus if len(r[1] or "") < 3000]
    got = context_tree.score_documents(table(spark, rows), depth=depth, block_bytes=1500).collect()
    counts = defaultdict(lambda: [0, 0])

    def walk(text):
        data = b"\xff" * depth + (text or "").encode().lower() + b"\xff"
        for p in range(depth, len(data)):
            node = 1
            for j in range(8):
                bit = data[p] >> (7 - j) & 1
                yield data[p - depth : p], node, bit
                node = node * 2 + bit

    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    for i, t in rows:
        if not held(i):
            for c, node, bit in walk(t):
                for k in range(depth + 1):
                    counts[c[depth - k :], node][bit] += 1
    below, own = defaultdict(float), {}
    for k in range(depth, -1, -1):
        for (c, node), (a, b) in list(counts.items()):
            if len(c) == k:
                e = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
                own[c, node] = e
                w = e if k == depth else np.logaddexp(e, below[c, node]) - math.log(2)
                if k:
                    below[c[1:], node] += w

    def score(text):
        total = 0.0
        for c, node, bit in walk(text):
            p = None
            for k in range(depth, -1, -1):
                q = (c[depth - k :], node)
                if q in counts:
                    o = (counts[q][bit] + 0.5) / (sum(counts[q]) + 1)
                    r = max(-700, min(700, below[q] - own[q]))
                    p = o if p is None else (o + math.exp(r) * p) / (1 + math.exp(r))
            total += math.log10(0.5 if p is None else p)
        return total

    tokens = Counter()
    for i, t in rows:
        if not held(i):
            tokens.update((t or "").encode().lower().split())
            tokens[b"\n"] += 1
    n, v = sum(tokens.values()), len(tokens)
    want = []
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), b"\n"]
        want.append((str(i), held(i), len(w), sum(x in tokens for x in w), n, sum(math.log10((tokens[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), score(t)))
    key = lambda r: (r[0], r[2], r[5])
    for a, b in zip(sorted([(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6], rel=1e-4, abs=1e-3)
    assert context_tree.score_documents(table(spark, [])).count() == 0
    assert context_tree.score_documents(table(spark, [(2, "held?")])).count() == 1


def test_word_encoder():
    from tokenizers import Tokenizer

    hard = ["", " ", "a ", " a", "a  b", "a\n b", "a \nb", "a\n\n b \n c", "it's  don't", "x<|endoftext|>y z", "é é ΑΣ ΑΣ. Σ", "a\tb \t c", "a  b", "漢字 かな", "👍🏽 x", "\x1c a \x1c b", "don't I'll 's a'", "É.\nÊ, ÿ9% 12", "4785380592391135$$$ de,&&&", prose(9, 500)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = token_ids.default_path(name)
        whole = Tokenizer.from_file(path)
        for text, got in zip(hard, token_ids.WordEncoder(path).encode(hard), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_token_store(spark, corpus):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_ids.default_path("word_bpe_49k.json"))
    path = scratch(spark, "orc-test")
    token_store.write(table(spark, corpus), path, file_bytes=4000)
    got = token_store.summary(spark, path).collect()
    by_id = defaultdict(list)
    for i, t in corpus:
        by_id[i].append(whole.encode(t or "", add_special_tokens=False).ids + [2])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, xs in by_id.items() for x in xs)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert token_store.read(spark, path).where("doc_id = 9").count() == 1
    empty = scratch(spark, "orc-empty")
    token_store.write(table(spark, []), empty)
    assert token_store.summary(spark, empty).count() == 0


def test_packing(spark, corpus):
    got = packing.pack_documents(table(spark, corpus), capacity=64, group_bytes=3000).collect()
    bins, docs = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.sequence_id].append(r)
        docs[r.doc_id].append(r)
    for pieces in bins.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    for r in (x for x in got if x.doc_id == 9):
        assert r.length == 64 or r.piece == 0
    assert [r.length for r in docs[4]] == [1] and [r.length for r in docs[5]] == [1]
    assert packing.pack_documents(table(spark, [])).count() == 0
    sizes = np.minimum(1023, np.random.default_rng(0).geometric(1 / 300, 3000))
    used, _ = packing.assign(sizes, 1024)
    assert used.max() + 1 <= 1.005 * sizes.sum() / 1024 + 2


def test_sum_of_squares_places_as_defined():
    rule, bins = packing.SumOfSquares(10), []
    for size in np.random.default_rng(3).integers(1, 11, 200).tolist():
        gaps = Counter(10 - sum(b) for b in bins if sum(b) < 10)
        options = sorted({g for g in gaps if g >= size})

        def cost(g):
            after = Counter(gaps)
            if g != 10 or gaps[10]:
                after[g] -= 1
            if g > size:
                after[g - size] += 1
            return sum(n * n for n in after.values())

        best = min(options, key=lambda g: (cost(g), g)) if options else None
        number, offset = rule.place(size)
        if best is None:
            assert number == len(bins)
            bins.append([size])
        else:
            assert 10 - sum(bins[number]) == best and offset == 10 - best
            bins[number].append(size)


def test_decontamination(spark, corpus):
    items = [("1", "an item of fewer words"), ("10", corpus[0][1][40:300]), ("2", None), ("3", ""), ("10", corpus[6][1][10:200]), (None, "tail words here")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = [*corpus[:12], (20, "see AN item, of fewer; words! an item of fewer words.")]
    for piece in (8 << 20, 60):
        got = decontaminate.decontaminate(table(spark, rows), bench, piece_bytes=piece).collect()
        want = decontaminate.brute_force([(t or "").encode() for _, t in rows], [(i or "", (t or "").encode()) for i, t in items], 10)
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got) == sorted((str(i), *w) for (i, _), w in zip(rows, want, strict=True))
    assert decontaminate.decontaminate(table(spark, []), bench).count() == 0
    assert decontaminate.decontaminate(table(spark, rows), bench.limit(0)).where("contaminated").count() == 0


def test_proximity(spark):
    index = decontaminate.build_index(table(spark, [(1, "cat one two dog"), (2, "cat a b c d e f g dog"), (3, "dog cat")]))
    got = {r.doc_id: r.contaminated for r in decontaminate.search(index, [("q", b"cat dog")], reach=3).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_statistics(spark, corpus):
    rows = [*corpus, (30, "one two three four five six one two three four five"), (31, "l\nl\n\nm\n l\nl"), (32, "# % a&b <x>|*$")]
    for r in decision_list.statistics(table(spark, rows)).collect():
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert r.block == "clash"
    assert decision_list.statistics(table(spark, [])).count() == 0


def test_decision_list_learns_and_explains(spark):
    rng = np.random.default_rng(0)
    x = rng.random((600, len(decision_list.FEATURES)))
    bad = (x[:, 2] > 0.7) & (x[:, 4] > 0.5) | (x[:, 6] > 0.9)
    rules = decision_list.learn(x, bad)
    verdict = np.zeros(600, bool)
    for rule in rules.rules:
        hit = np.ones(600, bool)
        for c in rule:
            hit &= c.holds(x, decision_list.FEATURES)
        verdict |= hit
    assert (verdict == bad).mean() > 0.95 and len(rules.rules) >= 2 and rules.text().endswith("else good")
    docs = table(spark, [(1, prose(1, 50)), (2, None)])
    assert {r.kept for r in decision_list.apply(docs, decision_list.DecisionList()).collect()} == {True, False}
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert decision_list.train(docs, labels).rules == []


def test_licenses(spark):
    known = license_digest.known_texts()
    assert all(re.search(license_digest.CLUES, t) and re.search(license_digest.CLUES, license_digest.canonical(t)) for _, t in known)
    mit = "Copyright (c) 2020 Someone\n\n" + license_digest._MIT.upper().replace("SUBLICENSE", "sub" + "licence").replace(",", " ,")
    rows = [(1, mit), (2, "Text.\nReleased under the MIT Licence!\n(C) 2019 x\nLicensed under CC BY-NC 4.0."), (3, None), (4, ""), (5, "a license but which"), (2, "SPDX-License-Identifier:  Apache-2.0")]
    got = sorted((r.doc_id, r.whole_license, r.n_license_lines, r.license_ids) for r in license_digest.scan(table(spark, rows)).collect() if r.doc_id != 2)
    assert got == [(1, "MIT", 0, ""), (3, None, 0, ""), (4, None, 0, ""), (5, None, 0, "")]
    two = sorted((r.whole_license or "", r.n_license_lines, r.license_ids) for r in license_digest.scan(table(spark, rows)).where("doc_id = 2").collect())
    assert two == [("", 2, "CC-BY-NC-4.0,MIT"), ("Apache-2.0", 1, "Apache-2.0")]
    assert license_digest.scan(table(spark, [])).count() == 0


def test_toxicity(spark):
    rng = random.Random(1)
    insults = ["wortless", "imbecile", "scoundrel"]
    rows, labels = [], []
    for i in range(400):
        words = prose(i, 30).split()
        bad = i % 4 == 0
        if bad:
            w = rng.choice(insults)
            if rng.random() < 0.4:
                k = rng.randrange(1, len(w))
                w = w[:k] + rng.choice(".-*") + w[k:]
            words[rng.randrange(30)] = w
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "x" * 5000), (None, "i.m.b.e.c.i.l.e"), (1003, "s c o u n d r e l"), (0, rows[0][1])]
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.predictions(table(spark, rows), known).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[1000] == by_id[1001] and by_id[None] > 0.3 and by_id[1003] > 0.3
    assert toxicity.predictions(table(spark, []), known).count() == 0
    assert toxicity.predictions(table(spark, rows[:3]), known.limit(0)).count() == 3


def test_kernel_by_definition():
    def kernel(a, b):
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
        return sum(v * y[k] for k, v in x.items()) / n if n else 0.0

    marks = ["idiot", "scum", "worthless"]
    words = ["idiot", "i.diot", "idioot", "scam", "worthies", "xyz", "ab", "", "wort-hless"]
    numbers, rows = toxicity.Kernel(marks).rows(words)
    got = np.zeros((len(words), len(marks)))
    got[numbers] = rows
    want = np.array([[kernel(w, m) for m in marks] for w in words])
    want[want < toxicity.LEAST] = 0
    assert np.allclose(got, want)


def test_wrapper_extraction(spark):
    def page(k, body, extra=""):
        return f"<html><head><title>t {k}</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home</a></li><li>N{k}</li></ul></nav><div class='ad box'>Buy {k}</div><article><h1>Title {k}</h1>{body}<p>Share this page</p></article>{extra}<aside>side {k}</aside><footer>&copy; host</footer></body></html>"

    rows = [(k, "https://h.example/x", page(k, f"<p>Text &amp; {k}<br>more\n  words<p>Second {prose(k, 20)}</p>", "<div id='comments'>mean words</div><form>f</form>")) for k in range(20)]
    rows += [(100, "https://h.example/", None), (101, None, page(7, "<p>Alone</p>")), (102, "no url", ""), (103, "https://h.example/y", "<p>bare text"), (104, "https://h.example/z", "<article><p>cut off &lt;here"), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = defaultdict(list)
    for r in wrapper_extract.extract_pages(pages).collect():
        got[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    assert got[3] == [f"Title 3\n\nText & 3 more words\n\nSecond {prose(3, 20)}"]
    assert len(got[0]) == 2 and got[100] == [""] and got[102] == [""]
    assert got[101] == ["Title 7\n\nAlone\n\nShare this page"]
    assert got[103] == ["bare text"] and got[104] == ["cut off <here"]
    assert wrapper_extract.extract_pages(pages.limit(0)).count() == 0


def test_tree_matching_counts_most_pairs():
    def tree(spec):
        slot = wrapper_extract.Slot(spec[0], False)
        slot.kids = [tree(s) for s in spec[1:]]
        return slot

    a = tree(("r", ("x", ("p",)), ("y",), ("x", ("p",), ("q",))))
    b = tree(("r", ("x", ("p",), ("q",)), ("z",)))
    assert wrapper_extract.matching(a.kids, b.kids) == (3, [(2, 0)])


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    base = prose(50, 150)
    rows = [(1, base), (2, base + " x"), (3, prose(51, 60)), (4, None), (5, ""), (6, prose(52, 60) + " " + base[:400]), (7, prose(53, 40) + " moronic " * 3), (None, "no id"), (8, prose(54, 40))]
    labels = [(100 + i, int(i % 2)) for i in range(200)]
    rows += [(100 + i, prose(1000 + i, 20) + (" moronic" if i % 2 else "")) for i in range(200)]
    table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(rows[8][1].split()[5:20]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {1, 3, 4, 5, 6, None} <= got and not {2, 7, 8} & got
    docs = table(spark, rows[:1]).limit(0).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0


def test_toxicity_keeps_gapped_insults_and_landmarks():
    for insult, gapped in (("stupid", "stxxupid"), ("trash", "tarabsh"), ("scum", "sacubm")):
        numbers, rows = toxicity.Kernel([insult]).rows([gapped])
        assert numbers.tolist() == [0] and rows[0, 0] > 0.3
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(80)})
    assert set(toxicity.choose_landmarks([(w, 10, 0) for w in words], 200, 800)) == set(words)


def test_decontamination_in_pieces_keeps_all_rows_apart(spark, corpus):
    items = [("1", corpus[0][1][40:300]), ("2", corpus[6][1][10:200]), ("3", corpus[0][1][200:500]), ("4", "tail words here")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = [*corpus, (None, prose(6, 30)), (None, prose(6, 30)), (21, corpus[0][1]), (21, "clean " * 120)]
    whole, cut = ([(str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, r["items"], [tuple(s) for s in r.spans]) for r in decontaminate.decontaminate(table(spark, rows), bench, piece_bytes=piece).collect()] for piece in (8 << 20, 60))
    assert len(cut) == len(rows)
    assert sorted(cut) == sorted(whole)


def test_wrapper_extraction_keeps_what_stands_beside_a_rich_child(spark):
    long = prose(9, 200)
    bodies = [
        (f"<article><h1>Head</h1><p>lead</p><div class=body><p>{long}</p></div></article>", ["Head", "lead", long]),
        (f"<article><h1>Head</h1><p>lead</p><ul><li>{long}</li><li>{long} b</li></ul></article>", ["Head", "lead", long, f"{long} b"]),
        (f"<article><p>{long}</p></article><article><p>{long} b</p></article>", [long, f"{long} b"]),
    ]
    for url in (None, "https://h.example/x"):
        pages = spark.createDataFrame([(k, url and f"{url}{k}", f"<body><nav>menu</nav>{b}<aside>side</aside></body>") for k, (b, _) in enumerate(bodies)], "page_id long, url string, html string")
        got = {r.page_id: r.text for r in wrapper_extract.extract_pages(pages).collect()}
        assert got == {k: "\n\n".join(want) for k, (_, want) in enumerate(bodies)}


def test_pipeline_keeps_one_row_of_each_group_whatever_its_id(spark):
    import corpus_pipeline

    a, b, c = prose(60, 120), prose(61, 120), prose(62, 120)
    rows = [(1, a), (None, a + " x"), (None, b), (None, b + " x"), (5, b[:20]), (6, c), (7, c + " x"), (7, prose(63, 60)), (None, None), (8, "")]
    got = {(r.doc_id, r.text) for r in corpus_pipeline.one_of_near_copies(spark, table(spark, rows), "").collect()}
    kept_b = {t for i, t in got if i is None and t and t.startswith(b)}
    assert len(kept_b) == 1
    assert got == {(1, a), *((None, t) for t in kept_b), (5, b[:20]), (6, c), (7, rows[7][1]), (None, None), (8, "")}


def test_pages_of_any_shape(spark):
    """Deep nesting, stray quotes, scripts with tags in them, and a node with more texts than it has counters."""
    import time

    deep = "<div>" * 20_000 + "core" + "</div>" * 10_000 + "<p>after</p><nav>menu</nav>"
    assert wrapper_extract.extract(deep, None).split("\n\n") == ["core", "after"]
    assert wrapper_extract.extract("<div>" * 300 + "<nav>" + "<div>" * 300 + "menu", None) == ""
    for stray in ("<p a='x>", '<p a="', "<a b=", "<a '", "<!--", "<p></i"):
        began = time.process_time()
        wrapper_extract.extract(stray * (1_000_000 // len(stray)), None)
        assert time.process_time() - began < 8
    assert wrapper_extract.extract("<p>one</p><script>if (a<b && c=\"</p>') {}</script><p>two</p>", None) == "one\n\ntwo"
    assert wrapper_extract.extract("<p it's>don't</p><p class='x'>can't</p>", None) == "don't\n\ncan't"
    menu = "".join(f"<li>link {k}</li>" for k in range(400))
    rows = [(k, "http://many.example/", f"<ul class=x>{menu}<li>text {k}</li></ul>") for k in range(40)]
    got = wrapper_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {k: f"text {k}" for k in range(40)}


def test_pipeline_stages_keep_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(100 + i, i % 2) for i in range(60)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no such words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(100 + i, prose(3000 + i, 30) + (" moronic" * 4 if i % 2 else ""), "en", "s", 7, f"row {i}", f"_row {i}", 0.5, 9, "block") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, _row string, toxicity double, toxic int, block string")
    clean = {r[0]: r for r in rows if not r[0] % 2}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = {r.doc_id: tuple(r) for r in out.collect()}
        assert all(got[i][5:] == r[5:] and got[i][1] == r[1] for i, r in clean.items()), name


def test_region_that_pivots_cannot_cut_is_not_replicated(spark, monkeypatch):
    """Beside a region in four groups, one of unrelated sets: the first is cut, the other compared portion by portion."""
    rng = np.random.default_rng(0)
    rows = []
    for g in range(4):
        base = rng.integers(1, 1 << 62, 60)
        for k in range(40):
            own = base.copy()
            own[rng.integers(0, 60, 2)] = rng.integers(1, 1 << 62, 2)
            rows.append((1, 100 * g + k, np.unique(own).astype("<u8").tobytes()))
    rows += [(2, 1000 + k, np.unique(rng.integers(1, 1 << 62, 60)).astype("<u8").tobytes()) for k in range(60)]
    seen = []
    real = jaccard_join._portions
    monkeypatch.setattr(jaccard_join, "_portions", lambda m, b: (seen.append(m.count()), real(m, b))[1])
    members = spark.createDataFrame(rows, jaccard_join.MEMBERS)
    got = {r.v: r.comp for r in jaccard_join.join_regions(members, 85, 12_000).collect()}
    sets = {v: set(np.frombuffer(b, "<u8").tolist()) for _, v, b in rows}
    up = {v: v for v in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert {v: got.get(v, v) for v in ids} == {v: root(v) for v in ids}
    assert max(seen) <= 2 * len(rows)


def test_whole_licence_texts_are_known(spark):
    """Texts that this machine has, as they are and with other case, white space and copyright lines."""
    from pathlib import Path

    folder = Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = [(code, (folder / name).read_text()) for name, code in names.items() if (folder / name).exists()]
    if not texts:
        pytest.skip("no licence texts here")
    rows = []
    for code, text in texts:
        rows += [(len(rows), text), (len(rows) + 1, "Copyright (c) 2024 Someone\n\n" + text.upper().replace("\n", "\n  "))]
    got = {r.doc_id: r.whole_license for r in license_digest.scan(table(spark, [*rows, (99, texts[0][1] + " and more")])).collect()}
    assert got == {**{k: texts[k // 2][0] for k in range(len(rows))}, 99: None}


def test_word_numbers_depend_on_the_word_alone():
    import random

    rng = random.Random(5)
    words = sorted({bytes(rng.choice(b"ab\xc3\xa9") for _ in range(rng.randint(1, 9))) for _ in range(3000)} | {b"x" * n for n in range(1, 140)})

    def numbers(some):
        return jaccard_join.word_numbers(np.frombuffer(b"".join(some), np.uint8), np.r_[0, np.cumsum([len(w) for w in some])]).tolist()

    once = dict(zip(words, numbers(words), strict=True))
    assert len(set(once.values())) == len(words)
    assert numbers(words[::-1]) == [once[w] for w in reversed(words)]
    assert len(numbers([b"", b"a", b""])) == 3 and numbers([b"", b"a", b""])[1] == once[b"a"]


def test_encoder_gives_memory_back_between_batches(monkeypatch):
    calls = []
    monkeypatch.setattr(token_ids, "give_back", lambda: calls.append(1))
    monkeypatch.setattr(token_ids, "BATCH_BYTES", 100)
    code = token_ids.WordEncoder(token_ids.default_path("byte_bpe_50k.json"))
    assert len(list(code.encode(["some words here " * 5] * 6))) == 6
    assert len(calls) >= 5
