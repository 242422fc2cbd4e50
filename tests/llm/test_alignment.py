import hashlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import alignment

SCHEMA = "doc_id long, text string, n_a string, pair string, row long, kept string"
FILES = alignment.public_files()


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES["a_path"])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES["b_path"])
    alphabet = alignment.byte_alphabet()
    of_a = lambda i: bytes(alphabet[c] for c in a.id_to_token(i))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def each(text):
        """(ids and byte ranges) of both sides, or nothing."""
        out = []
        if not text:
            return [], []
        for ids, of in ((a.encode(" " + text, add_special_tokens=False).ids, of_a), (b.encode(text), of_b)):
            at, side = 0, []
            for i in ids:
                side.append((i, at, at := at + len(of(i))))
            if b"".join(map(of, ids)) != (" " + text).encode():
                return [], []
            out.append(side)
        return out

    return each


def expected(plain, rows):
    docs, held = [], Counter()
    for doc_id, text in rows:
        a, b = plain(text)
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, links = [], []
        for begin, end in zip([0, *cuts], cuts):
            inside = lambda side: ",".join(str(i) for i, s, e in side if begin <= s and e <= end)  # noqa: B023, E731
            groups.append(f"{inside(a)}|{inside(b)}")
        for i, s, e in a:
            links += [(i, j) for j, t, f in b if s < f and t < e]
        held.update(set(links))
        docs.append((doc_id, len(a), len(b), len(cuts), groups, links))
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    return Counter(
        (i, n_a, n_b, n, len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for i, n_a, n_b, n, groups, links in docs
    )


def found(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


TEXTS = [
    "The cat sat. The cat sat on the mat, didn't it?", "The cat", "  two  spaces and a last one ", "\n a\n  b\t\tc \r\n", None, "", " ", "   ", "▁x y", "a▁b a b", "<|endoftext|> <s> </s> <unk> <0x41>",
    "Déjà vu: ñandú, Übermaß, ąę 漢字 かな 🙂🙂 ​ x", "\x00\x01 nul", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa " * 30, "x" * 3000, "été " * 400, "1234567 89 3.14 a1b2", "ﬁn ﬀ", "مرحبا ไทย हिन्दी", "café é",
]


NAMES = ["kept", "at", "stretches", "n_a", "n_b", "n_groups"]


def rows_of(texts):
    return [(i, t) for i, t in enumerate(texts)] + [(3, "The cat again"), (None, "The cat sat"), (None, "The cat sat")]


@pytest.mark.parametrize("most", [0, 5, 1 << 16])
def test_alignment(spark, plain, monkeypatch, most):
    monkeypatch.setattr(alignment, "MOST_SENT", most)
    monkeypatch.setattr(alignment.frequent, "__defaults__", (most,))
    rows = rows_of(TEXTS)
    df = spark.createDataFrame([(i, t, "x", "y", 7, "z") for i, t in rows], SCHEMA).repartition(3)
    got, want = found(alignment.digest(df, **FILES)), expected(plain, rows)
    assert sorted((got - want).items(), key=repr)[:9] == sorted((want - got).items(), key=repr)[:9]


def test_alignment_by_whole_texts(spark, plain, monkeypatch):
    """As with pieces that go over words, and by A's own library."""
    init = alignment.Tokenizers.__init__

    def whole(self, *args):
        init(self, *args[:2], None)
        self.by_word = False

    t = alignment.Tokenizers.__new__(alignment.Tokenizers)
    whole(t, FILES["a_path"], FILES["b_path"])
    for text in filter(None, TEXTS):
        a, b = t.tokens(t.words(text))
        want = plain(text)
        if want[0]:
            assert (a[0], b[0]) == ([i for i, *_ in want[0]], [i for i, *_ in want[1]])
        else:
            assert t.odd(t.words(text), a, b)


def test_alignment_query(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").where(F.length("text") < 4000).collect()]
    df = docs.where(F.length("text") < 4000)
    assert found(alignment.digest(df, **FILES)) == expected(plain, rows)


def test_alignment_empty(spark):
    assert alignment.digest(spark.createDataFrame([], SCHEMA), **FILES).count() == 0


def test_words_are_tokenised_alike_by_both_programs():
    """Up to LATIN every character between letters, digits, spaces and marks."""
    t = alignment.Tokenizers(**FILES)
    words = [f" {x}{chr(c)}{y}" for c in range(1, ord(alignment.LATIN)) for x in ("a", "1", "'", " ") for y in ("b", "2", "?", "")]
    assert [t.quick.encode_ordinary(w) for w in words] == [e.ids for e in t.a.encode_batch(words, add_special_tokens=False)]


@pytest.mark.parametrize("links", [1, 40, 1 << 18])
def test_alignment_by_blocks(plain, monkeypatch, links):
    """Blocks and parts of any size: the same documents, and links in order as different ones with their numbers."""
    monkeypatch.setattr(alignment, "LINKS", links)
    rows = rows_of(TEXTS)
    t = alignment.Tokenizers(**FILES)
    kept = pa.StructArray.from_arrays([pa.array([i for i, _ in rows], pa.int64())], ["doc_id"])
    blocks = [b for k in range(0, len(rows), 7) for b in alignment._block(t, kept.slice(k, 7), [x for _, x in rows[k : k + 7]])]

    def aligned(b):
        """Words by hand, as Spark's functions align them."""
        if b.column("at").null_count == 0:
            return pa.RecordBatch.from_arrays([b.column("kept"), b.column("at"), *(pa.nulls(b.num_rows, x) for x in (pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int32()))], names=NAMES)
        out = []
        for a, a_ends, c, c_ends in zip(*(b.column(n).to_pylist() for n in ("a_ids", "a_ends", "b_ids", "b_ends"))):
            i = j = 0
            x = []
            while i < len(a):
                end = min(a_ends[i], c_ends[j])
                flags = 2 * (a_ends[i] == end) + (c_ends[j] == end)
                x.append(a[i] | c[j] | flags)
                i, j = i + flags // 2, j + flags % 2
            out.append((x, len(a), len(c), len({*a_ends} & {*c_ends})))
        return pa.RecordBatch.from_arrays([b.column("kept"), b.column("at"), *(pa.array(x, kind) for x, kind in zip(zip(*out), (pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int32())))], names=NAMES)

    words = [aligned(b) for b in blocks]
    in_order, different = (pa.Table.from_batches(alignment.assembled(x)(iter(words))).to_pylist() for x in (False, True))
    want = expected(plain, rows)
    assert Counter((r["kept"]["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for r in in_order) == Counter((*w[:5], w[7]) for w in want.elements())
    for x, y in zip(in_order, different, strict=True):
        assert len(x["links"]) == x["n_links"] and Counter(x["links"]) == Counter(dict(zip(y["pairs"], y["times"])))
