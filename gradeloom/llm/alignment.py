"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Tokens of neither side go over the border of a word and the spaces after it, which `Tokenizers` checks in the files; so words are aligned,
and documents put together from them. Where B's pieces or its normalisation say otherwise, whole texts are the words.

A task deals its documents into blocks. Python tokenises each different word of a block once: a row gets the ids and the byte ends of its
tokens by A (a byte-level BPE) and by B (pieces with a leading space). Spark's array functions align each row. Ends that both have
(array_intersect) cut the tokens into groups. For the links, ends of both sides are merged by one sort of longs: the i-th of them, if it is
the j-th end of A, has i - j ends of B before it, so it lies in the token i - j of B, and likewise the other way round; every stretch
between two neighbouring ends is one link. So no token is compared with another one, and the work follows the number of tokens.
The rows of a block's words, with the documents after them, then come to Python once more, in the same task: there documents get the sums
over their words, what their words' groups say, and their words' links.

How many documents hold a pair linked is counted over all documents, from each document's different pairs and how often it has them.
Pairs that at least so many documents hold that no more than ``MOST_SENT`` pairs can (a histogram of counts says from where on) go to all
tasks; the rest of the pairs are joined.

Cases: texts that are null, empty, or whose tokens of either side do not give back the bytes of a space and the text, have no tokens: zeros
and an empty groups_sha256. Rows are documents of their own whatever their doc_id (null and repeated ones too). Very
long texts and words are read whole. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .shared import prepare, scratch, stored

#: Pairs that go to all tasks at most.
MOST_SENT = 1 << 16
#: Words that are tokenised at once.
AT_ONCE = 10_000
#: Rows of a batch, characters with which a block of documents ends, and links that are put together at once (of several documents).
ROWS, CHARS, LINKS = 1_000, 8_000_000, 1 << 18
#: Pairs are one number: A's id times this, plus B's.
SIDE = 1 << 31
#: Texts up to here in code points are split alike by both programs that know A's pattern.
LATIN = "ɐ"
WORD = re.compile(r"(?<=\S)(?= )")
#: Words that the second program may take one after another in a text: no spaces at their end go together with those of the next one.
PLAIN = re.compile(r"[\x00-ɏ]{1,499}(?<!\s)")


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """A and B in a worker: ids of texts, and the bytes of every id."""

    def __init__(self, a_path: str, b_path: str, pattern: str | None = None):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet, vocab = byte_alphabet(), model["vocab"]
        of = {i: bytes(alphabet[c] for c in s) for s, i in vocab.items() if all(c in alphabet for c in s)}
        self.a_bytes = [of.get(i, b"") for i in range(1 + max(vocab.values()))]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ranked = all(vocab[x + y] == 256 + i for i, (x, y) in enumerate(merges))  # then ids are ranks
        ranks = {b: i for i, b in of.items() if i < 256 + len(merges)}
        self.quick = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if ranked and pattern else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        ids = range(self.b.get_piece_size())
        pieces = [self.b.id_to_piece(i) for i in ids]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces)]
        self.space = self.b.piece_to_id("▁")
        #: No piece has a space after another character, and texts stay as they are: words are tokenised alike wherever they stand.
        self.by_word = not any(re.search("[^▁]▁", p) for p in pieces) and self.b.normalize(probe := "a  ﬁ é\n ") == "▁" + probe.replace(" ", "▁")
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int32) for t in (self.a_bytes, self.b_bytes))

    def words(self, text: str) -> list[str]:
        """A space and the text, cut before spaces that follow something else; all begin with a space."""
        return WORD.split(" " + text) if self.by_word else [" " + text]

    def tokens(self, words: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by A and by B of each word."""
        a: list[list[int]] = [[]] * len(words)
        plain = [i for i, w in enumerate(words) if PLAIN.fullmatch(w)] if self.quick else []
        for k in range(0, len(plain), 1000):
            some = plain[k : k + 1000]
            ids = self.quick.encode_ordinary("".join([words[i] for i in some]))
            ends, borders = self.a_len[ids].cumsum(), np.cumsum([len(words[i].encode()) for i in some])
            at = np.searchsorted(ends, borders)
            if at[-1] < len(ends) and (ends[at] == borders).all():
                for i, begin, end in zip(some, [0, *(at[:-1] + 1).tolist()], (at + 1).tolist()):
                    a[i] = ids[begin:end]
        if others := [i for i, x in enumerate(a) if not x]:
            for i, e in zip(others, self.a.encode_batch_fast([words[i] for i in others], add_special_tokens=False)):
                a[i] = e.ids
        b = self.b.encode([w[1:] for w in words], num_threads=1) if words else []
        return a, [x or [self.space] for x in b]  # an empty text has no tokens, a last space has one

    def odd(self, words: list[str], a: list[list[int]], b: list[list[int]]) -> set[str]:
        """Words whose tokens give other bytes."""
        all_said = [w.encode() for w in words]
        ends, whole = np.cumsum([len(w) for w in all_said], dtype=np.int64), b"".join(all_said)

        def same(ids: list[list[int]], of: list[bytes], n: np.ndarray) -> bool:
            flat, counts = _flat(ids)
            sums = np.append(0, n[flat].cumsum(dtype=np.int64))
            return (sums[counts.cumsum()] == ends).all() and b"".join(map(of.__getitem__, flat.tolist())) == whole

        if same(a, self.a_bytes, self.a_len) and same(b, self.b_bytes, self.b_len):
            return set()
        given = [(ids, of) for ids, of in ((a, self.a_bytes), (b, self.b_bytes))]
        return {w for k, w in enumerate(words) if any(b"".join([of[i] for i in ids[k]]) != all_said[k] for ids, of in given)}


_loaded: dict[tuple[str, str], Tokenizers] = {}
_INTS, _LONGS = ArrayType(IntegerType(), False), ArrayType(LongType(), False)
#: Words have ids (shifted to their places in a stretch) and ends, documents have the numbers of their words in the block.
WORDS = [StructField("at", _INTS), *(StructField(c, kind) for side in "ab" for c, kind in ((f"{side}_ids", _LONGS), (f"{side}_ends", _INTS)))]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(counts.sum())), counts


def _lists(values: np.ndarray | pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, counts.cumsum()).astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def _numbered(t: Tokenizers, texts: list[str | None]) -> tuple[list[str], list[np.ndarray]]:
    """The different words of texts, and of each text its words' numbers."""
    number: dict[str, int] = defaultdict()
    number.default_factory = number.__len__
    at, ends = array("i"), []
    for x in texts:
        if x:
            at.extend(map(number.__getitem__, x.split(" ") if t.by_word else [x]))
        ends.append(len(at))
    docs = np.split(np.frombuffer(at, np.int32), ends[:-1]) if at else [np.empty(0, np.int32)] * len(texts)
    if t.by_word and (loose := np.array([w == "" or w[-1].isspace() for w in number], bool)).any():
        for k in {bisect_right(ends, i) for i in np.flatnonzero(loose[np.frombuffer(at, np.int32)]).tolist()}:  # spaces after spaces
            docs[k] = np.array([number[w[1:]] for w in t.words(texts[k])], np.int32)
    return [" " + w for w in number], docs


def _block(t: Tokenizers, kept: pa.Array, texts: list[str | None]) -> Iterator[pa.RecordBatch]:
    words, docs = _numbered(t, texts)
    names = ["kept", *(f.name for f in WORDS)]

    def rows(a: list[list[int]], b: list[list[int]]) -> pa.RecordBatch:
        sides = []
        for ids, of, place in ((a, t.a_len, 33), (b, t.b_len, 2)):
            flat, counts = _flat(ids)
            ends = np.append(0, of[flat].cumsum(dtype=np.int64))
            before = ends[counts.cumsum() - counts]
            sides += [_lists(flat.astype(np.int64) << place, counts), _lists((ends[1:] - np.repeat(before, counts)).astype(np.int32), counts)]
        return pa.RecordBatch.from_arrays([pa.nulls(len(a), kept.type), pa.nulls(len(a), sides[1].type), *sides], names=names)

    odd = np.zeros(len(words), bool)
    for k in range(0, len(words), AT_ONCE):
        some = words[k : k + AT_ONCE]
        a, b = t.tokens(some)
        if found := t.odd(some, a, b):
            for i in (i for i, w in enumerate(some) if w in found):
                a[i] = b[i] = []  # no document has it
                odd[k + i] = True
        yield rows(a, b)
    if odd.any():
        whole: tuple[list[list[int]], list[list[int]]] = [], []
        for k in (k for k, at in enumerate(docs) if odd[at].any()):
            both = [[*chain.from_iterable(ids)] for ids in t.tokens([words[i] for i in docs[k].tolist()])]
            docs[k] = docs[k][:0]
            if all(b"".join([of[i] for i in ids]) == (" " + texts[k]).encode() for ids, of in zip(both, (t.a_bytes, t.b_bytes))):
                docs[k] = np.array([len(words) + len(whole[0])], np.int32)  # the text as one word
                for side, ids in zip(whole, both):
                    side.append(ids)
        if whole[0]:
            yield rows(*whole)
    at = _lists(np.concatenate(docs), np.array([len(x) for x in docs]))
    yield pa.RecordBatch.from_arrays([kept, at, *(pa.nulls(len(docs), pa.list_(x)) for x in (pa.int64(), pa.int32()) * 2)], names=names)


def tokenised(a_file: str, b_file: str, pattern: str | None) -> Callable:
    """For each block of documents, rows of its different words with ids and byte ends of their tokens, then its documents with the numbers of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_file, b_file) not in _loaded:
            _loaded[a_file, b_file] = Tokenizers(SparkFiles.get(a_file), SparkFiles.get(b_file), pattern)
        kept, texts, size = [], [], 0
        for batch in batches:
            begin, of_batch = 0, batch.column(1).to_pylist()
            for end, text in enumerate(of_batch, 1):
                size += len(text or "")
                if size >= CHARS or end == len(of_batch):
                    kept.append(batch.column(0).slice(begin, end - begin))
                    texts += of_batch[begin:end]
                    begin = end
                if size >= CHARS:
                    yield from _block(_loaded[a_file, b_file], pa.concat_arrays(kept), texts)
                    kept, texts, size = [], [], 0
                    pa.default_memory_pool().release_unused()
        if texts:
            yield from _block(_loaded[a_file, b_file], pa.concat_arrays(kept), texts)

    return run


def _said(x: np.ndarray, groups: np.ndarray) -> pa.Array:
    """`a1,a2|b1;a3|b2,b3` of words, from their stretches, the last of which is a cut, and the numbers of their groups."""

    def side(flag: int, ids: np.ndarray) -> pa.Array:
        own = (x & flag) != 0
        cuts = np.flatnonzero((x[own] & 3) == 3) + 1
        return pc.binary_join(_lists(ids[own], np.diff(cuts, prepend=0)).cast(pa.list_(pa.string())), ",")

    both = pc.binary_join_element_wise(side(2, x >> 33), side(1, (x >> 2) & (SIDE - 1)), "|")
    return pc.binary_join(_lists(both, groups), ";")


class _Aligned:
    """The aligned words of a block."""

    def __init__(self, parts: list[pa.RecordBatch], different: bool):
        column = lambda name: [p.column(name) for p in parts]
        numbers = lambda arrays, kind: np.concatenate([np.empty(0, kind), *(x.to_numpy(zero_copy_only=False) for x in arrays)]).astype(kind)
        self.n = [numbers(column(c), np.int64) for c in ("n_a", "n_b", "n_groups")]
        self.counts = numbers([pc.list_value_length(x) for x in column("stretches")], np.int64)
        self.begins = self.counts.cumsum() - self.counts
        stretches = numbers([x.flatten() for x in column("stretches")], np.int64)
        self.links, self.said = stretches >> 2, _said(stretches, self.n[2]).to_pylist()
        if different:
            self.pairs, codes = np.unique(self.links, return_inverse=True)
            self.codes = codes.astype(np.int32)

    def at(self, words: np.ndarray) -> np.ndarray:
        """Where the links of these words are, one word after another."""
        n = self.counts[words]
        return np.arange(n.sum()) + np.repeat(self.begins[words] - (n.cumsum() - n), n)


def _documents(w: _Aligned, kept: pa.Array, at: pa.ListArray, different: bool) -> Iterator[pa.RecordBatch]:
    """Documents, so many at once that they have no more than twice LINKS links; one with more than LINKS is alone."""
    words, sizes = at.flatten().to_numpy(), pc.list_value_length(at).to_numpy().astype(np.int64)
    ends = np.append(0, sizes.cumsum())
    sums = [np.append(0, x[words].cumsum())[ends] for x in (*w.n, w.counts)]
    large = np.diff(sums[3]) > LINKS
    cuts = np.flatnonzero((np.diff(sums[3][1:] // LINKS) > 0) | large[1:] | large[:-1]) + 1
    for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]):
        own, n = words[ends[begin] : ends[end]], [np.diff(x[begin : end + 1]) for x in sums]
        said = [";".join([w.said[i] for i in words[i:j].tolist()]) for i, j in zip(ends[begin:end], ends[begin + 1 : end + 1])]
        digests = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in said]
        if not different:
            found = [_lists(w.links[w.at(own)], n[3])]
        elif end - begin == 1:
            own, often = np.unique(own, return_counts=True)
            times = np.bincount(w.codes[w.at(own)], np.repeat(often, w.counts[own]), len(w.pairs)).astype(np.int64)
            has = np.flatnonzero(times)
            found = [_lists(x, np.array([len(has)])) for x in (w.pairs[has], times[has])]
        else:
            each = np.repeat(np.arange(end - begin), n[3]) * len(w.pairs) + w.codes[w.at(own)]
            each.sort()
            first = np.flatnonzero(np.diff(each, prepend=-1))
            doc, pair = np.divmod(each[first], max(1, len(w.pairs)))
            found = [_lists(x, np.bincount(doc, minlength=end - begin)) for x in (w.pairs[pair], np.diff(first, append=len(each)))]
        yield pa.RecordBatch.from_arrays([kept.slice(begin, end - begin), *map(pa.array, n), pa.array(digests, pa.string()), *found], names=["kept", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["pairs", "times"] if different else ["links"])])


def assembled(different: bool) -> Callable:
    """Documents from the aligned words of their block, which come before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, words = [], _Aligned([], different)
        for batch in batches:
            of_docs = batch.column("at").is_valid().to_numpy(zero_copy_only=False)
            cuts = (np.flatnonzero(of_docs[1:] != of_docs[:-1]) + 1).tolist()
            for begin, end in zip([0, *cuts], [*cuts, len(of_docs)]):
                part = batch.slice(begin, end - begin)
                if end > begin and not of_docs[begin]:
                    parts.append(part)
                elif end > begin:
                    if parts:
                        words = None  # those of the block before go first
                        words, parts = _Aligned(parts, different), []
                        pa.default_memory_pool().release_unused()
                    yield from _documents(words, part.column("kept"), part.column("at"), different)

    return run


def _marks(ends: Column, side: int) -> Column:
    """An end, a side and the token's number as one long."""
    return F.transform(ends, lambda e, j: F.shiftleft(e.cast("long"), 32) + (j + F.lit(side * SIDE).cast("long")))


def _number(mark: Column) -> Column:
    return mark.bitwiseAND(F.lit(SIDE - 1).cast("long")).cast("int")


def _second(mark: Column) -> Column:
    return mark.bitwiseAND(F.lit(SIDE).cast("long")) != 0


def _stretches(ends: Column) -> Column:
    """For each stretch between two neighbouring ends of either side, which is a link: A's id * 2^31 + B's id, times 4, plus 2 if A's token ends there, plus 1 if B's does."""
    code = lambda a, b, flags: F.get("a_ids", a).bitwiseOR(F.get("b_ids", b)).bitwiseOR(flags)
    long = lambda n: F.lit(n).cast("long")

    def stretch(x: Column, i: Column) -> Column:
        j, end = _number(x), F.shiftright(x, 32).cast("int")
        of_a = code(j, i - j, F.when(F.get("b_ends", i - j) == end, long(3)).otherwise(long(2)))
        return F.when(~_second(x), of_a).when(F.coalesce(F.get("a_ends", i - j - 1) != end, F.lit(True)), code(i - j, j, long(1)))

    return F.array_compact(F.transform(ends, stretch))


def public_files() -> dict[str, str]:
    """The two public tokenizers, and the pattern by which A cuts texts."""
    import public_tokenizers

    return {"a_path": public_tokenizers.path("byte_bpe_50k.json"), "b_path": public_tokenizers.path("piece_bpe_32k.model"), "pattern": public_tokenizers.PATTERN}


def aligned(docs: DataFrame, a_path: str, b_path: str, pattern: str | None = None, keep: tuple[str, ...] = ("doc_id",), different: bool = False) -> DataFrame:
    """docs(text), tokenizer files A and B; pattern is A's where a second program may be used for plain words.

    -> the columns of keep, n_a, n_b, n_groups, n_links, groups_sha256, and links: for each pair of tokens that overlap, in order, A's id * 2^31 + B's.
    In place of links, if different: pairs, the different ones, and times, how often each is there."""
    prepare(docs.sparkSession, ROWS)
    for path in (a_path, b_path):
        docs.sparkSession.sparkContext.addFile(path)
    rows = docs.select(F.struct(*keep).alias("kept"), "text")
    kept = StructField("kept", rows.schema["kept"].dataType)
    words = rows.mapInArrow(tokenised(os.path.basename(a_path), os.path.basename(b_path), pattern), StructType([kept, *WORDS]))
    merged = F.sort_array(F.concat(_marks(F.col("a_ends"), 0), _marks(F.col("b_ends"), 1)))
    words = words.select("kept", "at", _stretches(merged).alias("stretches"), *(F.size(x).alias(n) for x, n in (("a_ids", "n_a"), ("b_ids", "n_b"), (F.array_intersect("a_ends", "b_ends"), "n_groups"))))
    found = [("pairs", _LONGS), ("times", _LONGS)] if different else [("links", _LONGS)]
    schema = StructType([kept, *(StructField(c, LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")), StructField("groups_sha256", StringType()), *(StructField(*x) for x in found)])
    return words.mapInArrow(assembled(different), schema).select("kept.*", *schema.names[1:])


def counted(docs: DataFrame) -> DataFrame:
    """docs(pairs: different ones) -> pair, held (documents that hold it linked), best (as many as any pair of its A id)."""
    each = docs.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("held"))
    each = stored(each, "align-counts")
    most = each.groupBy(F.expr(f"pair div {SIDE}").alias("a")).agg(F.max("held").alias("most"))
    return each.join(most, F.expr(f"pair div {SIDE}") == F.col("a")).select("pair", "held", (F.col("held") == F.col("most")).cast("long").alias("best"))


def frequent(counts: DataFrame, most: int = MOST_SENT) -> int:
    """So many documents at least hold each of some pairs, which are ``most`` at most: from the sizes of counts by their length in 16ths of a power of two."""
    level = F.floor(F.log2("held") * 16).cast("int")
    found = sorted(((r["level"], r["n"], r["least"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("held").alias("least")).collect()), reverse=True)
    least, total = 1 << 62, 0
    for _, n, low in found:
        if (total := total + n) > most:
            break
        least = low
    return least


def digest(docs: DataFrame, a_path: str, b_path: str, pattern: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    numbers = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    with scratch() as keep:
        t = stored(aligned(docs, a_path, b_path, pattern, different=True).select(F.monotonically_increasing_id().alias("row"), *numbers, "pairs", "times"), "align")
        counts = stored(counted(t), "align-best")
        least = frequent(counts)
        each = t.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
        sent = counts.where(F.col("held") >= least)
        first = each.join(F.broadcast(sent), "pair", "left")
        summed = [F.sum(F.col("best") * F.col("times")).alias("n_best"), F.sum(F.col("held") * F.col("times")).alias("count_sum")]
        often = first.where("held is not null").groupBy("row").agg(*summed)
        rest = first.where("held is null").select("row", "pair", "times").join(counts.where(F.col("held") < least).hint("merge"), "pair").groupBy("row").agg(*summed)
        sums = often.unionAll(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        out = stored(t.select("row", *numbers).join(sums.hint("merge"), "row", "left").select(*numbers, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum"))), "align-out")
        keep(out)
    return out
