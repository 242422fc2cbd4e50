"""Personal data: fixed patterns, and what a semi-Markov conditional random field adds to them.

The base spans are the matches of four patterns, leftmost and non-overlapping per kind, that pass their check.
The field reads windows about long numbers, ``@`` before a dotted name and spelt-out addresses, as far around as a
segment can go. A segment of up to ``LONGEST`` tokens is
scored as a whole (its groups of digits, separators, check sum, address form, the word before it), single
tokens outside entities score 0, and the dynamic programme over ends of segments chooses boundaries and kinds
jointly. It is trained here, by gradient steps on the conditional likelihood over a fixed, generated sample of
``SENTENCES`` sentences, and as many of addresses with plain dots. Its spans are added where they touch no base span; base spans stay.

Cases: null and empty texts have no spans; texts are read whole; positions count code points; repeated rows
are searched each; an empty table gives an empty result; other columns pass through ``annotate``.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import prepare

KINDS = ("email", "ip", "card", "phone")
LONGEST = 16
MOST_DIGITS = 40
SENTENCES = 240

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """The pattern's matches: the letters before an @ back to the last match, and a dotted name after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def ips(text: str) -> Iterator[Span]:
    """The pattern's matches: four numbers at a time of each chain of dotted ones. The pattern itself would be tried at
    every digit of a long number."""
    for m in NUMBERS.finditer(text):
        if m[0].count(".") < 3:
            continue
        start, parts = m.start(), m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in four)):
                yield "ip", start, end
            start = end + 1


def base_spans(text: str) -> list[Span]:
    out = list(emails(text)) if "@" in text else []
    out += ips(text)
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := DIGITS.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(DIGITS.sub("", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=by_start)


def by_start(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


# ---------------------------------------------------------------------------------------------- the field

TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_|[^\W_]")
#: Windows are opened at long numbers, spelt dots, and at an @ or (at), [at], " at " before a dotted name.
SPELT = re.compile(r"[(\[]dot[)\]]|\sdot\s")
LONG_NUMBER = re.compile(r"[0-9][0-9\x20().-]{5,}[0-9]")
DOTTED = re.compile(r"(?:[(\[]at[)\]]|\sat\s|@)\s?[\w-]+\.[\w-]+")
ADDRESS = re.compile(r"[\w.+-]+\s?([(\[]at[)\]]|\sat\s|@)\s?[\w-]+(?:\.[\w-]+)+")
CONTEXT = 3
CUES = {"phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "whatsapp"}, "card": {"card", "visa", "credit", "mastercard", "payment"}, "email": {"email", "mail", "contact", "write", "reach"}, "ip": {"ip", "host", "server", "address"}}

Token = tuple[int, int, str]


def tokens(text: str, start: int, end: int) -> list[Token]:
    return [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text, start, end)]


def reach_back(text: str, at: int, n: int) -> int:
    """Where the n-th token before a place begins (0 if there are fewer)."""
    size = 32 * n
    while True:
        start = max(0, at - size)
        starts = [m.start() for m in TOKEN.finditer(text, start, at)]
        if not start or len(starts) > n:  # the first of a part may be the end of a longer one
            return starts[-n] if len(starts) >= n else 0
        size *= 4


def reach_ahead(text: str, at: int, n: int) -> int:
    """Where the n-th token after a place ends (the end if there are fewer)."""
    return next(islice((m.end() for m in TOKEN.finditer(text, at)), n - 1, None), len(text))


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of text that may hold an entity, with context; overlapping ones are joined."""
    found = [(reach_back(text, m.start(), CONTEXT + 2), reach_ahead(text, m.end(), 2)) for m in LONG_NUMBER.finditer(text) if len(DIGITS.sub("", m[0])) >= 7]
    for opener in (SPELT, DOTTED):
        found += [(reach_back(text, m.start(), LONGEST + CONTEXT), reach_ahead(text, m.end(), LONGEST)) for m in opener.finditer(text)]
    last: tuple[int, int] | None = None
    for a, b in sorted(found):
        if last and a <= last[1]:
            last = (last[0], max(b, last[1]))
            continue
        if last:
            yield last
        last = (a, b)
    if last:
        yield last


def segment_features(toks: list[Token], i: int, j: int, text: str) -> tuple[str, ...] | None:
    """Features of the segment of tokens i to j - 1; None where no entity can be (the search skips it)."""
    first, last = toks[i], toks[j - 1]
    s = text[first[0] : last[1]]
    head, tail = s[0], s[-1]
    if not (head.isalnum() or head in "(+" and s[1:2].isdigit() or s[:2] == "+(") or not tail.isalnum():
        return None
    digits = DIGITS.sub("", s)
    spelt = bool(SPELT.search(s))
    dotted = None if spelt else ADDRESS.fullmatch(s)
    if not spelt and not dotted and (len(digits) < 7 or any(c.isalpha() for c in s)):
        return None
    if (first[0] and text[first[0] - 1].isalnum()) or (last[1] < len(text) and text[last[1]].isalnum()):
        return None
    before = next((t[2].lower() for t in reversed(toks[max(0, i - CONTEXT) : i]) if t[2].isalpha()), "")
    out = ["1", f"spelt{spelt}", f"len{min(j - i, 9)}"]
    out += [f"cue-{k}" for k, words in CUES.items() if before in words]
    if dotted:
        mark = dotted[1].strip()
        out += [f"dotted{mark.strip('()[]')}", f"dotted-tail{2 <= len(last[2]) <= 6 and last[2].isalpha()}", f"dotted-cue{mark == 'at'}{before in CUES['email']}"]
        out.append(f"dotted-edge{bool(re.match(r'[.-]?\w', text[last[1] : last[1] + 2]) or re.search(r'\w[.+-]$', text[max(0, first[0] - 2) : first[0]]))}")
    elif spelt:
        at = bool(re.search(r"[(\[]at[)\]]|\sat\s|@", s))
        out += [f"at{at}", f"tail{2 <= len(last[2]) <= 6 and last[2].isalpha()}", f"gaps{min(len(s.split()), 8)}", f"begin{s.split()[0].isalnum() and len(s.split()) > 1}"]
        out.append("form" if re.fullmatch(r"[\w.+-]+\s?(?:@|[(\[]at[)\]]|\sat\s)\s?[\w-]+(?:\s?(?:\.|[(\[]dot[)\]]|\sdot\s)\s?[\w-]+)+", s) else "no-form")
    else:
        groups = [len(g) for g in re.findall(r"[0-9]+", s)]
        marks = "".join(sorted(set(re.sub(r"[0-9]", "", s))))
        n = len(digits)
        out += [f"n{n}", f"marks{marks}", f"plus{head == '+'}", f"groups{len(groups)}", f"paren{head == '('}"]
        out += ["shape" + "-".join(map(str, groups[:6]))]
        out.append(f"luhn{12 <= n <= 19 and luhn(digits)}")
        after, left = text[last[1] : last[1] + 2], text[max(0, first[0] - 2) : first[0]]
        out.append(f"edge{bool(re.match(r'[-.]?[0-9]', after) or re.search(r'[0-9][-.]$|[+(]$', left))}")
    return tuple(out)


class Field:
    def __init__(self, weights: dict[tuple[str, str], float] | None = None):
        self.w = weights if weights is not None else defaultdict(float)
        self.memo: dict[tuple[str, ...], tuple[str, float]] = {}

    def segments(self, toks: list[Token], text: str) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """Candidates: no token of an address and 7 to ``MOST_DIGITS`` digits, or such a token."""
        digits = [len(t) if t[0].isdigit() else 0 for *_, t in toks]
        letters = [t[0].isalpha() for *_, t in toks]
        marks = [t in ("dot", "at", "@") for *_, t in toks]
        for i in range(len(toks)):
            n, plain, marked = 0, True, False
            for j in range(i + 1, min(len(toks), i + LONGEST) + 1):
                n, plain, marked = n + digits[j - 1], plain and not letters[j - 1], marked or marks[j - 1]
                if n > MOST_DIGITS:
                    break
                if (marked or plain and n >= 7) and (f := segment_features(toks, i, j, text)):
                    yield i, j, f

    def score(self, kind: str, f: tuple[str, ...]) -> float:
        w = self.w
        return sum(w.get((kind, x), 0.0) for x in f)

    def kind(self, f: tuple[str, ...]) -> tuple[str, float]:
        """The best kind for a segment, and its score; remembered while there is room."""
        if (got := self.memo.get(f)) is None:
            if len(self.memo) > 100_000:
                self.memo.clear()
            k = max(KINDS, key=lambda k: self.score(k, f))
            got = self.memo[f] = (k, self.score(k, f))
        return got

    def best(self, toks: list[Token], text: str) -> list[Span]:
        """The highest-scoring segmentation."""
        ends = defaultdict(list)
        for i, j, f in self.segments(toks, text):
            ends[j].append((i, *self.kind(f)))
        if not ends:
            return []
        value, back = [0.0] * (len(toks) + 1), [None] * (len(toks) + 1)
        for j in range(1, len(toks) + 1):
            value[j] = value[j - 1]
            for i, k, s in ends.get(j, ()):
                if value[i] + s > value[j]:
                    value[j], back[j] = value[i] + s, (i, k)
        out, j = [], len(toks)
        while j:
            if back[j]:
                i, k = back[j]
                out.append((k, toks[i][0], toks[j - 1][1]))
                j = i
            else:
                j -= 1
        return out[::-1]

    def step(self, text: str, gold: set[Span], rate: float) -> None:
        """One gradient step: features of the true segmentation less their expectation."""
        toks = tokens(text, 0, len(text))
        segs = [(i, j, f, k, self.score(k, f)) for i, j, f in self.segments(toks, text) for k in KINDS]
        n = len(toks)
        fore, aft = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
        fore[0] = aft[n] = 0.0
        add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -math.inf else max(a, b)
        to, out = defaultdict(list), defaultdict(list)
        for x in segs:
            to[x[1]].append(x)
            out[x[0]].append(x)
        for j in range(1, n + 1):
            fore[j] = fore[j - 1]
            for i, _, _, _, s in to[j]:
                fore[j] = add(fore[j], fore[i] + s)
        for i in range(n - 1, -1, -1):
            aft[i] = aft[i + 1]
            for _, j, _, _, s in out[i]:
                aft[i] = add(aft[i], s + aft[j])
        change: dict[tuple[str, str], float] = defaultdict(float)
        for i, j, f, k, s in segs:
            p = math.exp(fore[i] + s + aft[j] - fore[n])
            d = ((k, toks[i][0], toks[j - 1][1]) in gold) - p
            if abs(d) > 1e-6:
                for x in f:
                    change[k, x] += d
        for key, d in change.items():
            self.w[key] += rate * (d - 0.002 * self.w[key])


def dotted_sentences(n: int = SENTENCES, seed: int = 8) -> Iterator[tuple[str, set[Span]]]:
    """More of them: addresses with plain dots. A bare "at" is taken as one after a word such as "mail" only."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abdeghilmnorstu") for _ in range(r.randint(2, 8)))
    for _ in range(n):
        text, gold = " ".join(word() for _ in range(r.randint(1, 4))) + " ", set()
        at = r.choice((" (at) ", "(at)", " [at] ", "[at]", " @ ", "@ ", " @", " at ", " at ", " at "))
        name = word() + r.choice(("", ".", "-")) + word() + at + r.choice(("", word() + ".")) + word() + "." + r.choice(("com", "org", "net", "de"))
        cue = r.random() < (0.5 if at == " at " else 0.3)
        if cue:
            text += r.choice(sorted(CUES["email"])) + r.choice((" ", ": "))
        if cue or at != " at ":
            gold.add(("email", len(text), len(text) + len(name)))
        yield text + name + r.choice((" ", ". ", ", ")) + word(), gold


def sentences(n: int = SENTENCES, seed: int = 7) -> Iterator[tuple[str, set[Span]]]:
    """Generated training sentences with their entities."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abdeghilmnorstu") for _ in range(r.randint(2, 8)))

    def card() -> str:
        while not luhn(x := r.choice("3456") + d(r.choice((14, 15, 15)))):
            pass
        return r.choice((x, "-".join(x[i : i + 4] for i in range(0, len(x), 4)), ".".join(x[i : i + 4] for i in range(0, len(x), 4))))

    def entity() -> tuple[str, str]:
        kind = r.choice(KINDS)
        if kind == "email":
            at, dot = r.choice(((" at ", " dot "), (" (at) ", " (dot) "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("@", "(dot)")))
            return kind, word() + r.choice(("", d(2))) + at + word() + dot + r.choice(("com", "org", "net", "de"))
        if kind == "ip":
            return kind, ".".join(str(r.randint(10, 255)) for _ in range(4))
        if kind == "card":
            return kind, card()
        return kind, r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{d(2)} {d(3)} {d(6)}"))

    def decoy() -> str:
        return r.choice((
            f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", d(r.randint(7, 20)), f"{d(3)} {d(3)} {d(3)}", f"{d(4)} {d(4)}", f"{d(1)}.{d(3)}.{d(3)}.{d(3)}",
            f"{r.randint(300, 999)}.{d(3)}.{d(2)}.{d(3)}", f"{d(2)}.{d(2)}.{d(4)} {d(2)}", f"{d(2)} {d(2)} {d(2)} {d(2)}", f"{d(4)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{word()} dot {word()}", "the dot at the end of", d(16), f"{d(5)}-{d(5)}-{d(5)}",
        ))

    for _ in range(n):
        text, gold = "", set()
        for _ in range(r.randint(1, 3)):
            text += " ".join(word() for _ in range(r.randint(1, 4))) + " "
            if r.random() < 0.55:
                kind, s = entity()
                if r.random() < 0.4:
                    text += r.choice(sorted(CUES[kind])) + r.choice((" ", ": "))
                gold.add((kind, len(text), len(text) + len(s)))
                text += s
            else:
                text += decoy()
            text += r.choice((" ", ". ", ", "))
        yield text + word(), gold


@lru_cache(1)
def trained() -> dict[tuple[str, str], float]:
    field, data = Field(), [x for two in zip(sentences(), dotted_sentences()) for x in two]
    for epoch in range(6):
        for text, gold in data:
            field.step(text, gold, 0.3 / (1 + epoch))
    return {k: round(v, 6) for k, v in sorted(field.w.items()) if abs(v) > 1e-3}


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans, by start."""
    base = base_spans(text)
    more, top = [], list(accumulate((b for *_, b in base), max))
    for a, b in windows(text):
        for s in field.best(tokens(text, a, b), text):
            n = bisect_left(base, s[2], key=lambda x: x[1])  # base spans that start before its end
            if not n or top[n - 1] <= s[1]:
                more.append(s)
    return base, sorted(base + more, key=by_start) if more else base


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def annotate(docs: DataFrame) -> DataFrame:
    """docs(..., text) with columns base_spans and all_spans: kind:start:end, joined by commas."""
    prepare(docs.sparkSession)
    at, weights = docs.columns.index("text"), trained()
    schema = StructType([*docs.schema.fields, StructField("base_spans", StringType()), StructField("all_spans", StringType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(weights)
        for batch in batches:
            found = [all_spans(t or "", field) for t in batch.column(at).to_pylist()]
            new = [pa.array([joined(f[k]) for f in found], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema.names)

    return docs.mapInArrow(search, schema)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans' counts by kind and digest, and all spans."""
    found = annotate(docs.select("doc_id", "text")).drop("text")
    count = lambda k: F.regexp_count("base_spans", F.lit(f"{k}:")).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2("base_spans", 256).alias("base_sha256"), F.col("all_spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; overlapping spans as one, by the first."""
    prepare(docs.sparkSession)
    at, weights, schema = docs.columns.index("text"), trained(), docs.schema

    def mask(text: str, field: Field) -> str:
        out, end = [], 0
        for k, a, b in all_spans(text, field)[1]:
            if a >= end:
                out += [text[end:a], f"[{k.upper()}]"]
            end = max(end, b)
        return "".join([*out, text[end:]]) if end else text

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(weights)
        for batch in batches:
            texts = [None if t is None else mask(t, field) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, schema.names[at], pa.array(texts, pa.string()))

    return docs.mapInArrow(masked, schema)

