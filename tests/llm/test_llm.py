import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import bpe, gsaca, licenses, minhash, mixing, mtree, pii, quality, substrings, toxicity, vectors

SCHEMA = "doc_id long, text string, source string, doc string"
WORDS = [w + e for w in ("alpha", "Beta", "gamma", "delta", "eps", "zeta", "über", "ñandu") for e in ("", "s", "ing", "ed", ",")]


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts with copies, near copies, shared passages; null, empty and long ones, repeated rows, extra columns."""
    r = random.Random(5)
    prose = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))
    passage = prose(90)
    texts = [prose(r.randint(1, 200)) for _ in range(40)] + [prose(30) + " " + passage + " " + prose(r.randint(0, 40)) for _ in range(8)]
    texts += texts[:6] + [None, "", " \n", "one", "two words", "a" * 3000, "ab " * 500, prose(6000)]
    for _ in range(10):
        w = texts[r.randrange(40)].split()
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    rows = [(i, t, r.choice(("b", "a", "c", None)), "x") for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffix_array():
    r = random.Random(2)
    for _ in range(400):
        t = [r.randint(0, r.choice((1, 2, 6))) for _ in range(r.randint(0, 40))]
        sa = gsaca.suffix_array(t)
        assert sa == sorted(range(len(t)), key=lambda i: t[i:])
        for a, b, n in zip(sa, sa[1:], gsaca.common_prefixes(t, sa)[1:]):
            assert t[a : a + n] == t[b : b + n] and t[a : a + n + 1] != t[b : b + n + 1]


def removed(rows):
    """(length, bytes removed, runs, digest of the rest) of each row (doc_id, text, ...), by plain counting."""
    texts = [(t or "").encode() for _, t, *_ in rows]
    count, out = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399)), Counter()
    for (i, *_), t in zip(rows, texts):
        gone = [False] * len(t)
        for k in range(len(t) - 399):
            if count[t[k : k + 400]] > 1:
                gone[k : k + 400] = [True] * 400
        kept = bytes(x for x, g in zip(t, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("bound", [2, 1000])
def test_substrings(spark, corpus, bound, monkeypatch):
    monkeypatch.setattr(substrings, "BOUND", bound)
    rows, df = corpus
    assert Counter(map(tuple, substrings.remove_repeats(df).collect())) == removed(rows)


@pytest.mark.parametrize("bound", [2, 1000])
def test_substrings_of_planted_passages(spark, bound, monkeypatch):
    """Passages of about 400 bytes in different surroundings, periods, runs of a byte, cut texts; ids that are null or shared."""
    monkeypatch.setattr(substrings, "BOUND", bound)
    r = random.Random(11)
    prose = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passages = [prose(n) for n in (380, 399, 400, 401, 430, 520, 900)]
    texts = [prose(r.randint(0, 300)) + p + prose(r.randint(0, 300)) for p in passages for _ in range(4)]
    texts += [p[a:] + prose(30) for p in passages for a in (0, 1, 20)] + [prose(9) + "x" * 399, "x" * 402, "xy" * 300, prose(3) + "xy" * 200, "é" * 250]
    near = prose(1500)
    texts += [near[:k] + "Z" + near[k + 1 :] for k in (10, 400, 401, 700, 1100, 1490)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(1, prose(900)), (2, texts[1]), (2, prose(1200)), (None, texts[5]), (None, prose(700)), (None, None), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, substrings.remove_repeats(df).collect())) == removed(rows)


def test_substrings_of_cells():
    """Groups of aligned cells, some settled, in one batch, against plain counting."""
    r = random.Random(3)
    for _ in range(150):
        batch, want = substrings.Batch(), set()
        for g in range(r.randint(1, 3)):
            w, letters = r.randint(0, 9), r.choice((b"a", b"ab", b"abcd"))
            side = lambda w=w, letters=letters: bytes(r.choice(letters) for _ in range(r.randint(0, w)))
            cells = sorted({(side(), side()) for _ in range(r.randint(2, 14))})
            group = [(None if r.random() < 0.2 else (g, k, 1000), a, b) for k, (a, b) in enumerate(cells)]
            windows = lambda a, b, w=w: {(n, a[len(a) - n :], b[: w - n]) for n in range(len(a) + 1) if 0 <= w - n <= len(b)}
            count = Counter(x for _, a, b in group for x in windows(a, b))
            for owner, a, b in group:
                want |= {(*owner[:2], x) for n, *sides in windows(a, b) if owner and count[n, *sides] > 1 for x in range(1000 - n, 1400 - n)}
            batch.add(w, group)
        assert {(doc, mark, x) for doc, mark, a, b in batch.repeats() for x in range(a, b)} == want


def test_substrings_cells_are_cut_by_their_own_partners_only():
    """Cells of two families that share nothing but the core: none has more symbols for the other family's columns."""
    r, w = random.Random(4), 91
    texts = [(bytes(r.choice(letters) for _ in range(w)), bytes(r.choice(letters) for _ in range(w))) for letters in (b"abcd", b"efgh")]
    family = lambda f: [((f, k, 1000), texts[f][0][w - k :], texts[f][1][: w + 3 - k]) for k in range(f + 5, w, 4)]
    sizes = []
    for group in (family(0), family(1), family(0) + family(1)):
        batch = substrings.Batch()
        batch.add(w, group)
        sizes.append(len(batch.text))
    assert sizes[0] > 100 and sizes[2] == sizes[0] + sizes[1]


def test_substrings_empty(spark):
    assert substrings.remove_repeats(empty(spark)).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_minhash(spark, corpus):
    rows, df = corpus
    sets = {i: shingles(t) for i, t, *_ in rows}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    low = min(label[a], label[b])
                    label[a] = label[b] = low
                    changed = True
    got = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_sketch_agreement():
    r = np.random.default_rng(1)
    x = np.unique(r.integers(0, 2**63, 1700).astype(np.uint64))
    a, b = minhash.sketches([x[:1500], x[200:]])
    assert abs((a == b).mean() - 1300 / len(x)) < 0.12


def plain_sketch(items):
    """The least (round, hash) of each coordinate, element by element."""
    mask, mix = (1 << 64) - 1, lambda x: int(minhash.mix64(np.array([x], np.uint64))[0])
    best = {}
    for k in range(2 * minhash.T):
        for x in items:
            h = mix((x + ((k + 1) * 0xD6E8FEB86659FD93 & mask)) & mask)
            at = (h >> 32) * minhash.T >> 32 if k < minhash.T else k - minhash.T
            best[at] = min(best.get(at, (k, mask)), (k, mix(h) >> minhash.ROUND_BITS))
        if len(best) == minhash.T:
            return [best[j] for j in range(minhash.T)]


def test_sketches_of_small_sets_match_a_plain_version():
    r = np.random.default_rng(3)
    sets = [r.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 3, 4, 5, 6, 7, 7, 8, 8, 9, 10)]
    got = minhash.sketches(sets)
    for items, row in zip(sets, got):
        want = plain_sketch([int(x) for x in items])
        assert [(int(v) >> 64 - minhash.ROUND_BITS, int(v) & (1 << 64 - minhash.ROUND_BITS) - 1) for v in row] == want
    late = [(row >> np.uint64(64 - minhash.ROUND_BITS)).max() for row in minhash.sketches([r.integers(0, 2**63, 7).astype(np.uint64) for _ in range(600)])]
    assert max(late) >= 256  # a round that eight bits can't hold


def test_mixing(spark, corpus):
    rows, df = corpus
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    by = Counter()
    for i, _, s, _ in rows:
        by[s] += size[i]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(by, key=lambda s: (s is None, s or "")))}
    target, total = {}, sum(by.values())
    while True:  # reshare until none is above
        free = [s for s in by if s not in target]
        rest = total - sum(target.values())
        over = [s for s in free if rest * weight[s] / sum(weight[f] for f in free) > 3 * by[s]]
        if not over:
            target |= {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
            break
        target |= {s: 3.0 * by[s] for s in over}
    taken = Counter()
    for i, _, s, _ in rows:
        assert (got[i].size, got[i].source_size) == (size[i], by[s]) and got[i].target == pytest.approx(target[s])
        assert 0 <= got[i].taken <= 3 * size[i]
        taken[s] += got[i].taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in by)
    assert {r.doc_id: r.taken for r in mixing.mix(df.repartition(5)).collect()} == {i: r.taken for i, r in got.items()}
    assert mixing.mix(empty(spark)).count() == 0


@pytest.mark.parametrize("text", ["x+y@a.b.com,c@d @e a@b.c@d.e", "1.2.3.4 256.1.1.1 1.2.3.4.5 0001.2.3.4", "1.2.3.4.5.6.7.8.9 1..2.3.4 1.2.3.4.5.6.7.300 .1.2.3.4. 9.9.9", "4539 1488 0343 6467 and 4539148803436467-1", "+1 (743) 555-3824 +12 +1234567890123456", "é +49 (0)30 1234567x 1." + "0" * 6000 + ".2.3", ""])
def test_pii_base(text):
    want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in pii.CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(sum(divmod(2 * c, 10)) if k % 2 else c for k, c in enumerate(d[::-1])) % 10 == 0:
            want.append(("card", *m.span()))
    want += [("phone", *m.span()) for m in pii.PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    assert pii.base_spans(text) == sorted(want, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii_field(spark, corpus):
    field = pii.Field(pii.trained())
    assert pii.all_spans("mail joe at example dot com or (555) 123-4567 now", field)[1] == [("email", 5, 27), ("phone", 31, 45)]
    assert pii.all_spans("on 2024-01-12 we sold 12345678 for 1.234.567", field) == ([], [])
    good = total = 0
    for text, gold in pii.sentences(60, seed=99):
        found = set(pii.all_spans(text, field)[1])
        good, total = good + len(found & gold), total + len(gold)
    assert good / total > 0.8
    rows, df = corpus
    assert pii.personal_data(df).count() == len(rows) and pii.redact(df).columns == df.columns
    assert pii.personal_data(empty(spark)).count() == 0


def test_bpe_matches_the_library(spark, corpus, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
    m = bpe.Merges(bpe.default_tokenizer())
    (tmp_path / "x").write_bytes(bpe.compile_lexicon((w, m.merge(w)) for w in {"the", "then", "oben", "don", "beta"}))
    c, r = bpe.Coder(m, bpe.Lexicon(str(tmp_path / "x"))), random.Random(1)
    for _ in range(800):
        s = "".join(r.choice("abAB eèéÜß'''sStTdDlLmM09²½  \t\x1c\x85 Σσςİı🙂漢<|>$̈") for _ in range(r.randint(0, 30))) + r.choice(("", "<|endoftext|>"))
        e = t.encode(s, add_special_tokens=False)
        assert np.frombuffer(c.encode(s), "<u4").tolist() == e.ids and c.decode(c.encode(s)).decode() == t.decode(e.ids, skip_special_tokens=False)
    rows, df = corpus
    for x in bpe.encode(df, lexicon_size=50).collect():
        e = t.encode(rows[x.doc_id][1] or "", add_special_tokens=False)
        assert x.ids == e.ids and x.decoded == t.decode(e.ids, skip_special_tokens=False)
    assert bpe.digest(empty(spark)).count() == 0


def test_lexicon_is_minimal(tmp_path):
    words = ["tap", "taps", "top", "tops"]
    (tmp_path / "x").write_bytes(bpe.compile_lexicon((w, [k]) for k, w in enumerate(words)))
    x = bpe.Lexicon(str(tmp_path / "x"))
    assert [x.find(w) for w in words] == [[0], [1], [2], [3]] and x.find("ta") is None and x.find("tapsx") is None
    assert len(x.final) == 5  # t, the vowels' one, p, s


def learnable(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = " ".join(r.choice(WORDS) for _ in range(60)) + (" " + " ".join(r.choice(("grobian", "lumpen")) for _ in range(3)) if bad else "")
        text = " ".join("###" for _ in range(40)) + text if i % 3 == 0 else text
        rows.append((i, text, "en", f"s{i % 5}", len(text)))
        if i % 2 == 0:
            labels.append((i, int(i % 3 != 0), int(bad)))
    return spark.createDataFrame([*rows, (1000, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("f, good", [(toxicity.toxicity, lambda i: i % 4 == 0), (quality.quality, lambda i: i % 3 != 0)])
def test_classifiers_held_out(spark, f, good):
    docs, labels = learnable(spark)
    got = [r for r in f(docs, labels).collect() if r.doc_id < 1000]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert np.mean([(r.predicted == 1) == good(r.doc_id) for r in got if r.held_out]) > 0.95
    assert f(docs.limit(0), labels).count() == 0 and f(docs, labels.limit(0)).count() == 601


def test_label_model_sees_through_copies_of_a_voter():
    """Ten copies of a poor voter and four good ones: with unlabelled rows the copies count as one; without, they decide."""
    r = np.random.default_rng(4)
    y = r.random(4000) < 0.3
    good = r.random((4000, 4)) < np.where(y[:, None], 0.7, 0.1)
    poor = r.random(4000) < np.where(y, 0.6, 0.25)
    x = np.column_stack([good, np.repeat(poor[:, None], 10, 1)])
    p = toxicity.Patterns(np.nonzero(x)[1], np.concatenate([[0], np.cumsum(x.sum(1))]), np.ones(4000))
    labelled = np.column_stack([x, np.ones(4000)])[:300].astype(float)
    mined = np.stack([(~y[:300]) @ labelled, y[:300] @ labelled])
    right = {w: np.mean((p.posterior(m := toxicity.label_model(mined, p.counts, p.company, w)) > 0.5) == y) for w in (0, 1.0)}
    assert right[1.0] > 0.85 and right[1.0] > right[0] + 0.05
    assert m.discount[:4].min() > 0.6 and m.discount[4:].max() < 0.2


def test_toxicity_learns_from_the_label_model(spark):
    docs, labels = learnable(spark)
    by = {t: {r.doc_id: r.score for r in toxicity.toxicity(docs, labels, t).collect()} for t in ("model", "votes", "gold")}
    assert by["model"] != by["votes"] and by["model"] != by["gold"]
    wide = docs.withColumns({"v": F.lit("x"), "gold": F.lit(1), "score": F.lit(0.5), "n": F.lit(2)})  # names that the operator uses itself
    assert {r.doc_id: r.score for r in toxicity.toxicity(wide, labels).collect()} == by["model"]
    again = docs.unionAll(docs)
    assert toxicity.toxicity(again, labels).count() == 2 * docs.count()


def test_vectors(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal((30, 16))
    x = [*base, *(base[0] + 0.1 * r.standard_normal((20, 16))), base[1], base[1] * 2, np.zeros(16)]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None]), (902, [float("nan")] * 16), (903, [])]
    got = {q.vec_id: q for q in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = np.array([v for _, v in rows[:52]])
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.9
    label = np.arange(52)
    for _ in range(52):
        label = np.array([label[near[k]].min() for k in range(52)])
    assert [(got[k].n_links, got[k].component_id) for k in range(52)] == [(near[k].sum() - 1, label[k]) for k in range(52)]
    assert all(got[k].n_links == 0 and got[k].kept for k in (52, 900, 901, 902, 903))


def test_vectors_cases(spark):
    """A vec_id with two vectors, repeated rows, columns with names of the operator's own, an empty table."""
    r = np.random.default_rng(3)
    a, b, c = r.standard_normal((3, 16))
    near = lambda v: v + 0.02 * r.standard_normal(16)
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (4, c), (4, c), (5, near(c)), (6, r.standard_normal(16))]
    rows = [(i, v.tolist(), "x", "y", 0) for i, v in rows] + [(None, a.tolist(), "x", "y", 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code string, key string, id int")
    got = sorted((q.vec_id or 0, q.n_links, q.component_id, q.kept) for q in vectors.near_vectors(df).collect())
    # both vectors of 1 have one link; 2 and 3 each reach 1
    assert got == [(0, 0, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 2, 4, True), (4, 2, 4, True), (5, 2, 4, False), (6, 0, 6, True)]
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_vectors_recall(spark):
    """Against brute force, on pairs close to the threshold."""
    r = np.random.default_rng(21)
    x = r.standard_normal((700, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = r.standard_normal((700, 32))
    y -= (x * y).sum(1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    t = r.uniform(0.88, 0.93, 700)[:, None]
    v = np.concatenate([x, t * x + np.sqrt(1 - t * t) * y, r.standard_normal((2000, 32))])
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    got = {q.vec_id: q.n_links for q in vectors.near_vectors(df).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = (u @ u.T >= 0.9).sum(1) - 1
    assert all(got[k] <= want[k] for k in got) and sum(got.values()) >= 0.99 * want.sum() > 700


def test_mtree(spark):
    r = np.random.default_rng(6)
    x = np.round(r.standard_normal((700, 8)), 1)  # with ties
    x[600:] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (950, [float("inf")] * 8)]
    got = mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    w = np.floor(256 * x.astype(np.float32).astype(float)).astype(int)
    want = set()
    for q in range(0, 700, 50):
        s = w @ w[q]
        for k, i in enumerate([i for i in np.lexsort((np.arange(700), -s)) if i != q][:5]):
            want.add((q, k + 1, i, s[i]))
    assert {(g.query_id, g["rank"], g.vec_id, g.score) for g in got} == want and len(got) == len(want)


def test_licenses(spark, corpus):
    s = licenses.Scanner(licenses.TEMPLATES)
    text = "x y Licensed under CC BY-NC 4.0. z Licensed under CC BY 4.0. All rights reserved"
    assert [f[0] for f in s(text)] == ["CC-BY-NC-4.0", "CC-BY-4.0", "ARR"]
    assert licenses.increasing([(0, 3), (1, 1), (2, 2), (3, 5), (4, 4)]) in ([(1, 1), (2, 2), (4, 4)], [(1, 1), (2, 2), (3, 5)])
    rows, df = corpus
    assert licenses.best(df).count() == len(rows) and licenses.best(empty(spark)).count() == 0


def test_pipeline_stages(spark, tmp_path, monkeypatch):
    import corpus_pipeline as p

    docs, labels = learnable(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    start = spark.read.parquet(str(tmp_path / "documents.parquet"))
    clean = p.remove_toxic(spark, start, str(tmp_path))
    assert clean.columns == p.COLUMNS and all("grobian" not in (r.text or "") for r in clean.collect())
    out = p.run(spark, str(tmp_path))
    assert out.count() > 0 and "ids_sha256" in out.columns


def test_queries_match_sql(spark):
    import duckdb

    from gradeloom.llm import queries

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        df, rel = queries.Q[name](spark, sf), con.sql(sql)
        assert sorted(df.columns) == sorted(rel.columns), name
        at = [rel.columns.index(c) for c in df.columns]
        assert sorted(map(tuple, df.collect())) == sorted(tuple(r[k] for k in at) for r in rel.fetchall()), name


def test_mtree_ties_and_large_components(spark):
    r = np.random.default_rng(8)
    x = r.integers(-3, 4, (400, 5)).astype(float) / 256  # many equal scores of unequal vectors
    x[:, 4] *= 2.0**20
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    w = [[int(np.floor(256 * c)) for c in v] for v in x]
    want = set()
    for q in range(0, 400, 50):
        s = {i: sum(a * b for a, b in zip(w[q], w[i])) for i in range(400) if i != q}
        want |= {(q, k + 1, i, s[i]) for k, i in enumerate(sorted(s, key=lambda i: (-s[i], i))[:5])}
    assert {(g.query_id, g["rank"], g.vec_id, g.score) for g in got} == want


def test_mtree_reads_a_part_of_clustered_rows():
    """The bounds leave most rows unscored: within a tree, and over the regions of the top."""
    r = np.random.default_rng(12)
    centers = r.standard_normal((40, 16)) * 100
    x = np.floor(np.concatenate([c + 4 * r.standard_normal((100, 16)) for c in centers]))
    most = float((x**2).sum(1).max())
    v = np.column_stack([x, np.sqrt(most - (x**2).sum(1))])
    ids, scored = np.arange(len(x)), []
    tops = mtree.pivots(v, 20)
    away = mtree.distances(v, tops)
    region = away.argmin(1)
    trees = {g: (mtree.build(ids[region == g], v[region == g]), away[region == g, g].max()) for g in range(len(tops)) if (region == g).any()}
    share = []
    for q in range(0, len(x), 50):
        want = sorted(((-int(s), i) for i, s in enumerate(x @ x[q]) if i != q))[:5]
        query, seen = np.append(x[q], 0.0), []
        got = mtree.search(mtree.build(ids, v), query, q, 5, most, None, seen)
        assert sorted((-s, i) for s, i in got) == want
        scored.append(sum(seen) / len(x))
        seen, least = [], sorted(got)[0][0]
        reach = math.sqrt(query @ query + most - 2 * least) + 1e-6
        found = [y for g, (tree, radius) in trees.items() if np.linalg.norm(tops[g] - query) - radius <= reach for y in mtree.search(tree, query, q, 5, most, least, seen)]
        assert sorted((-s, i) for s, i in found)[:5] == want
        share.append(sum(seen) / len(x))
    assert np.mean(scored) < 0.5 and np.mean(share) < 0.4


def test_mtree_cases(spark):
    """Repeated rows, a vec_id with two vectors, other columns, an empty table."""
    rows = [(0, [1.0, 2.0], "x"), (0, [1.0, 2.0], "y"), (50, [3.0, 1.0], "x"), (50, [0.0, 1.0], "x"), (7, [1.0, 1.0], "x"), (7, [1.0, 1.0], "x"), (8, [1.0], "x"), (None, [9.0, 9.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, d string")
    w = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v, _ in rows if i is not None]
    want = Counter()
    for q, v in {(i, tuple(v)) for i, v in w if i % 50 == 0}:
        best = sorted((-int(np.dot(v, u)), i) for i, u in w if i != q and len(u) == len(v))[:5]
        want.update((q, n + 1, i, -s) for n, (s, i) in enumerate(best))
    assert Counter(map(tuple, mtree.top_k(df).collect())) == want
    assert mtree.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("d", [4, 8])
def test_short_vectors_keep_their_links(spark, d):
    x = np.random.default_rng(9).standard_normal((1200, d))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {q.vec_id: q.n_links for q in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = (u @ u.T >= 0.9).sum(1) - 1
    assert all(got[k] <= want[k] for k in got) and sum(got.values()) >= 0.997 * want.sum()


@pytest.mark.parametrize("d", [2, 8, 64])
def test_bands_miss_no_more_than_stated(d):
    bits, bands = vectors.plan(3_000_000, 0.9)
    r = np.random.default_rng(10)
    x, y = (vectors.unit(r.standard_normal((4000, d))) for _ in range(2))
    y = vectors.unit(y - (x * y).sum(1)[:, None] * x)
    a, b = (vectors.band_values(v, bits, bands) for v in (x, 0.9 * x + np.sqrt(0.19) * y))
    assert (a != b).all(1).mean() < 0.008


@pytest.mark.parametrize("text, want", [
    ("Room 4 " + "." * 70 + " 555-123-4567 x", [("phone", "555-123-4567")]),
    ("call 3" + " " * 80 + "(555) 123-4567 now", [("phone", "(555) 123-4567")]),
    ("1" + " -" * 40 + " 555-123-4567", [("phone", "555-123-4567")]),
    ("write to joe (at) example.com now", [("email", "joe (at) example.com")]),
    ("it was joe[at]mail.example.org, then", [("email", "joe[at]mail.example.org")]),
    ("ask joe @ example.com please", [("email", "joe @ example.com")]),
    ("mail joe at example.com today", [("email", "joe at example.com")]),
    ("we looked at example.com today", []),
    ("a@b.com", [("email", "a@b.com")]),
    ("call 1" + "(.)" * 20 + "555-123-4567", [("phone", "555-123-4567")]),
    ("mail " + "j" * 90 + " at example dot com", [("email", "j" * 90 + " at example dot com")]),
])
def test_pii_windows(text, want):
    assert [(k, text[a:b]) for k, a, b in pii.all_spans(text, pii.Field(pii.trained()))[1]] == want


def test_pii_in_documents():
    """Entities of forms that no base pattern finds, put between words of real texts: found with their bounds and kinds, and little else."""
    import duckdb

    r, field = random.Random(77), pii.Field(pii.trained())
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name, host, top = (lambda: r.choice(("maria", "j.smith", "anna-lena", "tom88"))), (lambda: r.choice(("example", "mail-host", "acme"))), (lambda: r.choice(("com", "org", "de")))

    def card():
        while not pii.luhn(x := r.choice("345") + d(15)):
            pass
        return ".".join(x[i : i + 4] for i in range(0, 16, 4))

    forms = [
        ("email", lambda: f"{name()} at {host()} dot {top()}"), ("email", lambda: f"{name()}(at){host()}(dot){top()}"), ("email", lambda: f"{name()} @ {host()}.{top()}"),
        ("phone", lambda: f"({d(3)}) {d(3)}-{d(4)}"), ("phone", lambda: f"{r.randint(200, 999)}-{r.randint(200, 999)}-{d(4)}"), ("card", card),
    ]
    found = total = wrong = added = 0
    for (text,) in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' order by doc_id").fetchall():
        base, before = pii.all_spans(text, field)
        added += len(before) - len(base)
        w = text.split(" ")
        at = r.randrange(1, max(2, len(w) - 1))
        kind, make = r.choice(forms)
        head, entity = " ".join(w[:at]) + " ", make()
        if not head[-2:-1].isalpha():
            continue
        after = pii.all_spans(head + entity + " " + " ".join(w[at:]), field)[1]
        hit = (kind, len(head), len(head) + len(entity)) in after
        found, total, wrong = found + hit, total + 1, wrong + max(0, len(after) - len(before) - hit)
    assert total > 100 and found >= 0.97 * total and wrong <= 0.02 * total and added <= 4


@pytest.mark.parametrize("text", ["7" * 1_000_000, "1 " + "." * 1_000_000, "+1" + " " * 1_000_000, "1" + "a" * 1_000_000])
def test_pii_reads_long_runs_in_linear_time(text):
    began = time.time()
    assert pii.all_spans(text, pii.Field(pii.trained())) == ([], [])
    assert time.time() - began < 4


class Ungated(licenses.Scanner):
    """Windows at every word of a template, all aligned."""

    def __init__(self, templates):
        super().__init__(templates)
        self.keys = {k: {w: [j for j, x in enumerate(t) if x == w] for w in t} for k, t in self.templates.items()}

    def open(self, name, has):
        return True


def test_license_finds_whole_texts_with_insertions_and_changes():
    s, r = licenses.Scanner(licenses.TEMPLATES), random.Random(7)
    for name, whole in licenses.TEMPLATES.items():
        w = whole.split()
        if len(w) < 60:
            continue
        text = [x for k, x in enumerate(w) if k % 12] + ["tail"]  # a twelfth is missing
        text = "some words before\n" + "\n * ".join(" ".join(text[k : k + 9]) for k in range(0, len(text), 9)).upper()
        (found,) = [f for f in s(text) if f[0] == name]
        assert found[1] >= 0.85 and text[found[2] : found[3]].split()[0] == w[1].upper()
        more = w[: len(w) // 2] + [f"x{r.randrange(999)}" for _ in range(int(0.9 * len(w)))] + w[len(w) // 2 :]  # as many words put in, nearly
        assert [f[:2] for f in s(" ".join(more)) if f[0] == name] == [(name, 1.0)]


def test_license_rows(spark):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, None, "a"), (2, "", "b"), (3, f"x {mit} y", "c"), (3, f"x {mit} y", "c"), (4, "é " * 40_000 + mit, "d"), (None, "no notice", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string").withColumnRenamed("license", "coverage_")
    got = sorted((r.doc_id or 0, r.license, r.coverage, r.start, r.end, r.n_finds) for r in licenses.best(df).collect())
    n = len(mit) - 1
    assert got == [(0, None, None, None, None, 0), (1, None, None, None, None, 0), (2, None, None, None, None, 0), (3, "MIT", 1.0, 2, 2 + n, 1), (3, "MIT", 1.0, 2, 2 + n, 1), (4, "MIT", 1.0, 80_000, 80_000 + n, 1)]


def test_exchanged_labels_teach():
    """Two views that each tell little, and few labels: with the exchange the scores are better than without."""
    r = np.random.default_rng(2)
    right = {0: [], 4: []}
    for _ in range(8):
        truth = r.random(3000) < 0.5
        view = lambda: np.column_stack([r.standard_normal((3000, 12)) + np.where(truth, 1, -1)[:, None] * 0.55, np.ones(3000)])
        x, y = view(), view()
        label = np.where(np.arange(3000) < 24, truth, -1).astype(int)
        for rounds in right:
            a, b, mix = quality.co_train(x, y, label, rounds)
            right[rounds].append(np.mean((mix[0] * (x @ a) + mix[1] * (y @ b) + mix[2] > 0) == truth))
    assert np.mean(right[4]) > np.mean(right[0]) + 0.01


def test_quality_cases(spark):
    docs, labels = learnable(spark)
    plain = {r.doc_id: r.score for r in quality.quality(docs, labels).collect()}
    wide = docs.withColumns({"label": F.lit(1), "x": F.lit("x"), "score": F.lit(0.5)})
    assert {r.doc_id: r.score for r in quality.quality(wide, labels).collect()} == plain
    assert quality.quality(docs.unionAll(docs), labels).count() == 2 * docs.count()


def test_license_gate():
    s, every, r = licenses.Scanner(licenses.TEMPLATES), Ungated(licenses.TEMPLATES), random.Random(4)
    assert [f[:2] for f in s("This is licensed under the MIT License.")] == [("MIT", 0.8)]
    for name, t in s.templates.items():
        df = Counter(w for x in s.templates.values() for w in set(x))
        spare = max(m for m in range(len(t)) if (len(t) - m) / len(t) >= licenses.COVER)
        rare = sorted(range(len(t)), key=lambda j: (df[t[j]], -len(t[j]), t[j]))[:spare]
        for gone in [rare] + [r.sample(range(len(t)), spare) for _ in range(12)]:
            text = " ".join(["before"] * 5 + ["other" if j in gone else w for j, w in enumerate(t)] + ["after"] * 5)
            assert sorted({f[0] for f in s(text)}) == sorted({f[0] for f in every(text)}), (name, text)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_keeps_rows_apart(spark):
    import corpus_pipeline as p

    r = random.Random(12)
    prose = lambda: " ".join(r.choice(WORDS) + str(r.randrange(400)) for _ in range(60))
    texts = [prose() for _ in range(14)]
    rows = [(i, texts[i], "en", "ab"[i % 2], i) for i in range(8)]
    rows += [(None, texts[8], "en", "a", 0), (None, texts[9], "en", "b", 0), (None, texts[0], "en", "a", 0)]  # the last is a copy of 0
    rows += [(20, texts[10], "en", "a", 0)] * 3 + [(21, texts[11], "en", "b", 0), (21, texts[12], "en", "b", 0)] + [(22, "", "en", "a", 0)] * 2 + [(23, None, "en", "a", 0), (24, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    clean = p.remove_near_duplicates(spark, docs, "")
    assert Counter(map(tuple, clean.collect())) == Counter(set(rows) - {(None, texts[0], "en", "a", 0)})
    taken = Counter()
    for x in mixing.mix(docs, whole=True).collect():
        taken[x.doc_id, x.size] += x.copies
    size = lambda t: len((t or "").split())
    mixed = p.mix_sources(spark, docs, "").collect()
    assert Counter((x.doc_id, size(x.text)) for x in mixed) == +taken
    copies, least = Counter(map(tuple, mixed)), Counter(rows)
    assert all(copies[k] <= 3 * least[k] for k in copies) and any(k[0] is None for k in copies)


def plain_mix(rows, weights=(1, 2, 3), cap=3):
    """How often each row (doc_id, text, source) is taken whole, by reading each source in the order of its digests again and again."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    by = Counter()
    for (_, _, s), n in zip(rows, size):
        by[s] += n
    weight = {s: weights[k % 3] for k, s in enumerate(sorted(by, key=lambda s: (s is None, s or "")))}
    target, total = {}, sum(by.values())
    while True:
        free = [s for s in by if s not in target]
        rest = total - sum(target.values())
        over = [s for s in free if rest * weight[s] / sum(weight[f] for f in free) >= cap * by[s]]
        target |= {s: float(cap * by[s]) for s in over} if over else {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        if not over:
            break
    mark = [hashlib.md5(f"{'' if i is None else i} {t or ''}".encode()).hexdigest()[:16] for i, t, _ in rows]
    taken, begin = [0] * len(rows), Counter()
    for k in sorted(range(len(rows)), key=lambda k: (mark[k], -1 if rows[k][0] is None else rows[k][0])):
        s = rows[k][2]
        passes, left = divmod(round(target[s]), by[s]) if by[s] else (0, 0)
        if size[k]:
            taken[k] = passes + (passes < cap and begin[s] + size[k] / 2 <= left)
        begin[s] += size[k]
    return taken


def test_pipeline_matches_a_plain_version(spark, tmp_path):
    """run() against plain Python: planted toxic rows go, one row of each near-duplicate group stays, spans are masked, whole copies
    are taken by the plain mix, and ids are the library's."""
    import corpus_pipeline as p

    tokenizers = pytest.importorskip("tokenizers")
    r = random.Random(31)
    prose = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(300)) for _ in range(n))
    texts = []
    for i in range(300):
        toxic = " " + " ".join(r.choice(("grobian", "lumpen")) for _ in range(3)) if i % 4 == 0 else ""
        private = r.choice((" mail a.b@example.com now", " call +1 (555) 123-4567", " joe at example dot com", "", "")) if i % 3 == 0 else ""
        texts.append(prose(60) + toxic + private)
    rows = [(i, t, "en", "abc"[i % 3] if i % 50 else None, len(t)) for i, t in enumerate(texts)]
    for k in range(12):
        w = rows[4 * k + 1][1].split()
        w[-1] = "changed"
        rows += [(400 + k, " ".join(w), "en", "a", 7), (500 + k, rows[4 * k + 2][1], "de", "b", 7)]
    rows += [rows[5], rows[5], (None, rows[5][1], "en", "a", 0), (None, prose(50), "en", "b", 0), (600, None, None, None, None), (601, "", "en", "a", 0), (601, "", "en", "a", 0), (602, " \n", "en", "c", 3)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = [x for x in rows if "grobian" not in (x[1] or "") and "lumpen" not in (x[1] or "")]
    sets, group = [shingles(t) for _, t, *_ in left], list(range(len(left)))
    for a in range(len(left)):
        for b in range(a):
            alike = sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
            if alike or (not sets[a] and left[a] == left[b]):
                group = [group[a] if g == group[b] else g for g in group]
    first = {}
    for g, x in zip(group, left):
        first[g] = min(first.get(g, x), x, key=lambda x: (x[0] is None, x[0] or 0))
    field = pii.Field(pii.trained())

    def masked(t):
        out, end = "", 0
        for k, a, b in pii.all_spans(t, field)[1]:
            out, end = (out + t[end:a] + f"[{k.upper()}]", b) if a >= end else (out, max(end, b))
        return out + t[end:]

    kept = [(i, None if t is None else masked(t), lang, s) for i, t, lang, s, _ in first.values()]
    t, want = tokenizers.Tokenizer.from_file(bpe.default_tokenizer()), Counter()
    for (i, text, lang, s), n in zip(kept, plain_mix([(i, t, s) for i, t, _, s in kept])):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()
        want[i, lang, s, None if text is None else len(text), hashlib.sha256(ids).hexdigest()] += n
    got = Counter((x.doc_id, x.lang, x.source, x.n_chars, x.ids_sha256) for x in p.run(spark, str(tmp_path)).collect())
    assert got == +want and sum(got.values()) > 150


def test_mix_is_written_in_the_order_of_its_positions(spark):
    import corpus_pipeline as p

    r = random.Random(8)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(1, 30))), "en", "abc"[i % 3], i) for i in range(90)]
    docs = spark.createDataFrame(rows, DOCS)
    mixed = mixing.mix(docs, whole=True)
    due = sorted((x.position, x.doc_id, x.copy) for x in mixing.schedule(mixed).collect())
    assert len(due) == sum(x.copies for x in mixed.collect()) and 0 <= due[0][0] and due[-1][0] < 1
    for s, tilt in zip("abc", mixing.TILTS):  # a source with a rising schedule is due later on the whole
        mine = [at for at, i, _ in due if i % 3 == "abc".index(s)]
        assert (np.mean(mine) > 0.5) == (tilt > 0) or tilt == 0
    place = {}
    for k, (_, i, copy) in enumerate(due):
        place[i, copy] = k
    seen, order = Counter(), []
    for x in p.mix_sources(spark, docs, "").collect():
        order.append(place[x.doc_id, seen[x.doc_id]])
        seen[x.doc_id] += 1
    assert sorted(order) == list(range(len(due))) and sum(a > b for a, b in zip(order, order[1:])) <= len(due) // 20  # ties of rows aside


def test_pipeline_without_rows(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0


def test_pipeline_removes_near_copies_from_80_percent(spark):
    import corpus_pipeline as p

    w = [f"w{k}" for k in range(54)]  # 50 shingles; a changed end of 5 words leaves 45 of 55, of 6 words 44 of 56
    rows = [(0, " ".join(w), "en", "a", 1), (1, " ".join(w[:49] + [f"x{k}" for k in range(5)]), "en", "a", 1), (2, " ".join(w[:48] + [f"y{k}" for k in range(6)]), "en", "a", 1)]
    got = p.remove_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert sorted(r.doc_id for r in got.collect()) == [0, 2]
