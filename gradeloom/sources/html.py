"""Text of HTML pages, and source packs."""

from __future__ import annotations

import re
from html import entities
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..functions.urls import safe_url
from ..functions.workers import sent_by_value

sent_by_value(__name__)

SKIPPED = frozenset(("script", "style", "noscript", "svg", "nav", "footer"))
MAX_BYTES, PACK_CHARS = 1_500_000, 30_000
#: An ampersand with the reference that it begins, and what stands for one that begins none (no valid text has it).
REFERENCE, PLAIN = re.compile(r"&(#[0-9]+;|#[xX][0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)?"), "\udc00"


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skipped: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skipped.append(tag)

    def handle_endtag(self, tag):
        if tag in self.skipped:
            while self.skipped.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.skipped and (s := data.replace(PLAIN, "&").strip()):
            self.out.append(s)


def _closed(m: re.Match) -> str:
    said = m[1] or ""
    return m[0] if said[:1] == "#" or said in entities.html5 else PLAIN + said


def text_of(html: str | None, closed: bool = False) -> str:
    """Text of a page. References that lack their semicolon are read as browsers do, or stay as they are where closed ones are asked for."""
    p = _Text()
    p.feed(REFERENCE.sub(_closed, html or "") if closed else html or "")
    p.close()
    return "\n".join(p.out)


@F.pandas_udf(StringType())
def html_text(pages: pd.Series) -> pd.Series:
    return pages.map(text_of)


@F.pandas_udf(StringType())
def html_text_closed(pages: pd.Series) -> pd.Series:
    return pages.map(lambda page: text_of(page, True))


def is_html(content: Column) -> Column:
    return F.lower(F.substring(content, 1, 1000)).contains("<html")


def cut_text(content: Column, most: int = MAX_BYTES) -> Column:
    """Text of the first bytes; a character that the cut breaks is replaced."""
    cut = F.make_valid_utf8(F.substring(content.cast("binary"), 1, most).cast("string"))
    return F.when(F.octet_length(content) > most, cut).otherwise(content)


def acquire(pages: DataFrame, url: str = "url", body: str = "html", most: int = MAX_BYTES, closed: bool = False) -> DataFrame:
    """pages with text, status and error: unsafe URLs fail as rows, they don't stop the others; bodies are read up to most bytes.
    ``closed``: only references with their semicolon are read."""
    ok = safe_url(F.col(url))
    cut = cut_text(F.col(body), most)
    text = F.when(ok, F.when(is_html(F.col(body)), (html_text_closed if closed else html_text)(cut)).otherwise(cut))
    return pages.withColumns({"text": text, "status": F.when(ok, "ok").otherwise("failed"), "error": F.when(~ok, F.lit("unsafe URL"))})


def receive(fetched: DataFrame, most: int | None = None, closed: bool = False) -> DataFrame:
    """Responses (final_url, content_type, body, status, error, ...) with text. Where a redirect ended is checked once more; a body is a
    page by its type or by how it begins. ``most`` cuts bodies that weren't cut when they were read: after the chunk of 64 KiB that passes it.
    ``closed``: only references with their semicolon are read."""
    body = F.col("body") if most is None else F.substring(F.col("body"), 1, (most // 65_536 + 1) * 65_536)
    said = F.make_valid_utf8(body.cast("string"))
    ok = (F.col("status") == "ok") & safe_url(F.col("final_url"))
    page = F.contains(F.coalesce(F.lower("content_type"), F.lit("")), F.lit("html")) | F.contains(F.lower(F.make_valid_utf8(F.substring(F.col("body"), 1, 1000).cast("string"))), F.lit("<html"))
    text = F.when(ok, F.when(page, (html_text_closed if closed else html_text)(F.when(page, said))).otherwise(said))
    error = F.when(F.col("status") != "ok", F.coalesce("error", F.lit("failed"))).when(~ok, F.lit("redirected to an unsafe URL"))
    return fetched.withColumns({"text": text, "error": error, "status": F.when(ok, "ok").otherwise("failed")})


def source_evidence(sources: DataFrame, limit: int = 1500) -> DataFrame:
    """sources(identity_id, source_ord, url, text, status, error) -> with sample, sha256 and lengths, null for those that failed. An
    identity's sources, failed ones included, share its budget of characters."""
    n = F.count("*").over(Window.partitionBy("identity_id"))
    rows = sources.withColumn("__limit", F.least(F.lit(limit), T.sample_budget(n)))
    sample = T.sample_segments(F.col("text"), F.col("__limit"))
    ok = F.col("status") == "ok"
    return rows.select(
        "identity_id", "source_ord", "url", "status", "error", F.when(ok, F.col("text")).alias("text"), F.when(ok, sample).alias("sample"),
        F.when(ok, T.content_hash(F.col("text"))).alias("sha256"), F.when(ok, F.length("text")).alias("source_chars"), F.when(ok, F.length(sample)).alias("sample_chars"),
    )


def block(url: Column, text: Column) -> Column:
    """A source's text between its marks."""
    quoted = F.to_json(F.array(url))
    return F.concat(F.lit("<SOURCE url="), quoted.substr(F.lit(2), F.length(quoted) - 2), F.lit(">\n"), text, F.lit("\n</SOURCE>"))


def packs(evidence: DataFrame) -> DataFrame:
    """identity_id, pack: the blocks of its sources in order, cut; null where all failed."""
    piece = F.when(F.col("status") == "ok", F.struct("source_ord", block(F.col("url"), F.col("sample")).alias("b")))
    rows = evidence.groupBy("identity_id").agg(F.array_sort(F.collect_list(piece))["b"].alias("b"))
    return rows.select("identity_id", F.when(F.size("b") > 0, T.truncate(F.array_join("b", "\n\n"), PACK_CHARS)).alias("pack"))


def block_text(pack: Column, url: Column) -> Column:
    """What a pack says between a URL's first mark and the next end mark (so a literal end mark in a text ends it); empty if there is none."""
    quoted = F.to_json(F.array(url))
    mark = F.concat(F.lit("<SOURCE url="), quoted.substr(F.lit(2), F.length(quoted) - 2), F.lit(">"))
    rest = pack.substr(F.position(mark, pack) + F.length(mark), F.length(pack))
    end = F.position(F.lit("</SOURCE>"), rest)
    return F.when((F.position(mark, pack) > 0) & (end > 0), rest.substr(F.lit(1), end - 1)).otherwise("")
