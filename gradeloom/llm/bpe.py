"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

1. The words of all documents are counted; those from a frequency level on (a 16th of a power of two), the least at
   which they are no more than ``lexicon_size``, go into the lexicon, each with the ids that the merges give.
2. The sorted words are compiled into the minimal acyclic automaton (equal suffixes share states). Every
   transition carries how many words sort before those behind it; summed along a path these outputs are the
   word's number, which points at its ids.
3. The file goes to the executors as a Spark file, is memory-mapped there, and shared by an executor's workers.
4. Words that the automaton doesn't have are merged exactly, pair of least rank first.

Cases: null and empty texts have no tokens, and the SHA-256 of nothing; whole texts of any length are encoded;
repeated rows are encoded each; an empty table gives an empty result; other columns stay out of the result
of ``encode`` unless named in ``keep``.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import struct
import tempfile
import unicodedata
import uuid
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare, stored

LEXICON_SIZE = 131_072
#: Entries of a worker's memos of words and of white-space separated strings; each is cleared when full.
MEMO = 700_000
ODD_SPACE = regex.compile(r"[\x1c-\x1f]")
NOT_SPACE = regex.compile(r"[^\t-\r \x85\xa0  -     　]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr({**{b: b for b in plain}, **{b: 256 + i for i, b in enumerate(rest)}}[b]) for b in range(256)]


class Merges:
    """The vocabulary: splitting into words, exact merging, and the strings of ids."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words_of = regex.compile(split["pattern"]["Regex"])
        self.letters = byte_letters()
        self.bytes_ = [self.vocab[x] for x in self.letters]
        self.last = [self.vocab[x + self.end] for x in self.letters]
        self.pairs = {self.vocab[a] << 20 | self.vocab[b]: r for (a, b), r in self.ranks.items()}
        self.made = [self.vocab[a + b] for a, b in self.ranks]
        self.text_of = {i: s.encode() for s, i in (self.vocab | self.special).items()}

    def split(self, string: str) -> Iterator[str | int]:
        """Normalised words, and ids of special tokens, of a string without white space."""
        at = 0
        for m in self.special_at.finditer(string) if "<" in string else ():
            yield from self._words(string[at : m.start()])
            yield self.special[m[0]]
            at = m.end()
        yield from self._words(string[at:])

    def _words(self, s: str) -> list[str]:
        if not s.isascii():
            s = unicodedata.normalize("NFC", s)
        s = s.lower() if "Σ" not in s else "".join(c.lower() for c in s)  # by character: no final sigma
        return [s] if s.isalpha() else self.words_of.findall(s)

    def merge(self, word: str) -> list[int]:
        """The pair of least rank first, the left one of equals; ranks are kept by pair of ids."""
        text = word.encode("utf-8")
        ids = [self.bytes_[b] for b in text[:-1]]
        ids.append(self.last[text[-1]])
        get, none = self.pairs.get, len(self.made)
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (r := min(ranks)) < none:
            i = ranks.index(r)
            ids[i : i + 2] = [self.made[r]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], none)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], none)
        return ids


def merge_long(m: Merges, word: str) -> list[int]:
    """merge() with a heap over linked parts: n log n for words of many bytes."""
    import heapq

    parts = [m.letters[b] for b in word.encode("utf-8")]
    parts[-1] += m.end
    n = len(parts)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := m.ranks.get((parts[i], parts[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if parts[i] == a else -1
        if j < 0 or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for x in (before[i], i):
            if x >= 0 and (y := after[x]) >= 0 and (r := m.ranks.get((parts[x], parts[y]))) is not None:
                heapq.heappush(heap, (r, x, parts[x], parts[y]))
    return [m.vocab[p] for p in parts if p is not None]


def compile_lexicon(entries: Iterable[tuple[str, list[int]]]) -> bytes:
    """The minimal acyclic automaton of the words' UTF-8 bytes, with numbering outputs, and the id lists.

    Words come in the order of their bytes; after each word, the states that no later word can change are
    replaced by an equal registered state, if there is one.
    """
    register: dict[tuple, int] = {}
    final: list[bool] = []
    arcs: list[tuple] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(arcs)
            final.append(node[0])
            arcs.append(key[1])
        return register[key]

    path, last, ids_at, ids = [[False, []]], b"", [0], []
    for word, out in sorted((w.encode("utf-8"), i) for w, i in entries):
        same = len(os.path.commonprefix([word, last]))
        while len(path) > same + 1:
            node = path.pop()
            path[-1][1][-1] = (path[-1][1][-1][0], settle(node))
        for b in word[same:]:
            path[-1][1].append((b, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
        ids += out
        ids_at.append(len(ids))
    while len(path) > 1:
        node = path.pop()
        path[-1][1][-1] = (path[-1][1][-1][0], settle(node))
    root = settle(path[0])
    words = [0] * len(arcs)
    for s, out in enumerate(arcs):  # a state follows those it leads to
        words[s] = final[s] + sum(words[t] for _, t in out)
    first = [0, *accumulate(map(len, arcs))]
    label, to, add = [], [], []
    for s, out in enumerate(arcs):
        n = int(final[s])
        for b, t in out:
            label.append(b)
            to.append(t)
            add.append(n)
            n += words[t]
    tables = [np.asarray(x, "<u4") for x in (first, to, add, ids_at, ids)] + [np.asarray(final, "u1"), np.asarray(label, "u1")]
    head = struct.pack("<8I", root, *map(len, tables))
    return head + b"".join(t.tobytes() for t in tables)


class Lexicon:
    """A compiled lexicon in a memory-mapped file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, *sizes = struct.unpack_from("<8I", self.data)
        at, tables = 32, []
        for k, n in enumerate(sizes):
            tables.append(memoryview(np.frombuffer(self.data, "<u4" if k < 5 else "u1", n, at)))
            at += n * (4 if k < 5 else 1)
        self.first, self.to, self.add, self.ids_at, self.ids, self.final, self.label = tables

    def find(self, word: str) -> list[int] | None:
        s, number, first, label = self.root, 0, self.first, self.label
        for b in word.encode("utf-8"):
            for k in range(first[s], first[s + 1]):
                if label[k] == b:
                    number += self.add[k]
                    s = self.to[k]
                    break
            else:
                return None
        return self.ids[self.ids_at[number] : self.ids_at[number + 1]].tolist() if self.final[s] else None


def pieces(text: str) -> list[str]:
    """The strings between white space (U+001C to U+001F are not white space here)."""
    return NOT_SPACE.findall(text) if ODD_SPACE.search(text) else text.split()


class Coder:
    def __init__(self, merges: Merges, lexicon: Lexicon):
        self.m, self.lexicon, self.memo, self.words = merges, lexicon, {}, {}

    def word(self, w: str) -> bytes:
        """Ids of a word: from the lexicon, or merged; remembered while there is room."""
        if (x := self.words.get(w)) is None:
            ids = self.lexicon.find(w)
            if ids is None:
                ids = self.m.merge(w) if len(w) < 200 else merge_long(self.m, w)
            x = array("I", ids).tobytes()
            if len(self.words) > MEMO:
                self.words.clear()
            if len(w) < 64:
                self.words[w] = x
        return x

    def string(self, s: str) -> bytes:
        return b"".join([self.word(w) if isinstance(w, str) else array("I", [w]).tobytes() for w in self.m.split(s)])

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        memo, strings = self.memo, pieces(text)
        out = list(map(memo.get, strings))
        if None in out:
            if len(memo) > MEMO:
                memo.clear()
            for k, x in enumerate(out):
                if x is None:
                    s = strings[k]
                    out[k] = x = memo.get(s) or self.string(s)
                    if len(s) < 64:
                        memo[s] = x
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the tokens' strings joined by spaces (this vocabulary names no decoder)."""
        return b" ".join(map(self.m.text_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_coders: dict[tuple[str, str], Coder] = {}


def _coder(lexicon: str, tokenizer: str) -> Coder:
    key = (SparkFiles.get(lexicon), SparkFiles.get(tokenizer))
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(Merges(key[1]), Lexicon(key[0]))
    return _coders[key]


def word_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(word, n) over all documents; each task adds up what it reads before anything is shuffled."""
    docs.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Merges(SparkFiles.get(name))
        seen: Counter[str] = Counter()

        def words() -> pa.RecordBatch:
            total: Counter[str] = Counter()
            for s, n in seen.items():
                for w in m.split(s):
                    if isinstance(w, str):
                        total[w] += n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(pieces(text or ""))
                if len(seen) > 700_000:
                    yield words()
        yield words()

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer: str, size: int = LEXICON_SIZE) -> str:
    """Count, compile and hand out the lexicon; returns the name of the Spark file."""
    # not orderBy().limit(): every task would send so many words to the driver
    counts = stored(word_counts(docs, tokenizer).where((F.col("n") > 1) & (F.length("word") <= 64)), "words")
    level = F.floor(F.log2("n") * 16).cast("int").alias("level")
    least, room = 1 << 30, size
    for r in sorted(counts.groupBy(level).count().collect(), reverse=True):
        if r["count"] > room:
            break
        least, room = r.level, room - r["count"]
    top = counts.where(level >= least).select("word").collect()
    m = Merges(tokenizer)
    data = compile_lexicon((r.word, m.merge(r.word)) for r in top)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="gradeloom-"), name)
    with open(path, "wb") as f:
        f.write(data)
    docs.sparkSession.sparkContext.addFile(path)
    return name


def encode(docs: DataFrame, tokenizer: str | None = None, lexicon_size: int = LEXICON_SIZE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, ids array<int> and the decoded text of every row of docs(text)."""
    return _coded(docs, tokenizer, lexicon_size, keep, digests=False)


def digest(docs: DataFrame, tokenizer: str | None = None, lexicon_size: int = LEXICON_SIZE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As encode(), but the number of ids and the digests of ids and decoded text only."""
    return _coded(docs, tokenizer, lexicon_size, keep, digests=True)


def _coded(docs: DataFrame, tokenizer: str | None, lexicon_size: int, keep: tuple[str, ...], digests: bool) -> DataFrame:
    prepare(docs.sparkSession)
    tokenizer = tokenizer or default_tokenizer()
    name, lexicon = os.path.basename(tokenizer), build_lexicon(docs, tokenizer, lexicon_size)
    docs = docs.select(*keep, F.col("text").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    added = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _coder(lexicon, name)
        for batch in batches:
            ids = [c.encode(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
            if digests:
                new = [
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string()),
                ]
            else:
                new = [pa.array([np.frombuffer(x, "<u4").astype("i4") for x in ids], pa.list_(pa.int32())), pa.array([c.decode(x).decode() for x in ids], pa.string())]
            names = [f.name for f in docs_schema] + [p.split()[0] for p in added.split(", ")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names)

    docs_schema = docs.schema.fields[:-1]
    return docs.mapInArrow(code, ", ".join(filter(None, [kept, added])))
