"""Grounding: which claims are supported by which sources, lexically and verbatim."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from ..functions.tables import written
from ..functions.workers import sent_by_value

sent_by_value(__name__)


def lexical_support(name: Column, description: Column, source: Column) -> Column:
    """Name and the rest of the description are covered by the source's tokens."""
    n, s = T.tokens(name), T.tokens(source)
    rest = F.array_except(T.tokens(description), n)
    named = F.size(F.array_intersect(n, s)) >= F.when(F.size(n) == 1, 1).otherwise(2)
    half = F.greatest(F.lit(1), F.ceil(F.size(rest) * 0.5))
    return (F.size(n) > 0) & named & ((F.size(rest) == 0) | (F.size(F.array_intersect(rest, s)) >= half))


#: So many different tokens of claims, and claims, may go to all tasks; with more of either, both sides are shuffled.
SENT_TOKENS, SENT_CLAIMS = 20_000, 100_000


def token_overlap(claims: DataFrame, sources: DataFrame, share: float = 0.5, sent_tokens: int = SENT_TOKENS, sent_claims: int = SENT_CLAIMS) -> DataFrame:
    """claims(claim_id, text) x sources(source_id, text) -> pairs that share that part of the claim's tokens, with hits.

    Texts are read and tokenised once: what is kept of a source is its tokens that some claim has, in a table. How many sources
    have a token is counted there. A source with k of a claim's n tokens has one of any n - k + 1 of them: candidates come from a join on the
    claim's rarest ones, a pair at the rarest one that both have, so none is found twice and nothing is gathered by source or by pair.
    """
    c = claims.select("claim_id", T.tokens(F.col("text")).alias("t")).where(F.size("t") > 0).withColumn("need", F.greatest(F.lit(1), F.ceil(F.size("t") * share)).cast("int"))
    c = written(c, "claims")
    vocabulary = c.select(F.explode("t").alias("token")).distinct()
    some = [r["token"] for r in vocabulary.limit(sent_tokens + 1).collect()]
    small = len(some) <= sent_tokens and c.limit(sent_claims + 1).count() <= sent_claims
    s = sources.select("source_id", T.tokens(F.col("text")).alias("t"))
    if small:
        listed = ", ".join(f"'{w}'" for w in some) or "''"
        held = s.withColumn("t", F.expr(f"filter(t, x -> x in ({listed}))"))
    else:
        each = s.withColumn("row", F.monotonically_increasing_id()).select("row", "source_id", F.explode("t").alias("token"))
        held = each.join(vocabulary, "token", "left_semi").groupBy("row", "source_id").agg(F.collect_list("token").alias("t")).drop("row")
    held = written(held.where(F.size("t") > 0), "held")
    each = held.select("source_id", "t", F.explode("t").alias("token"))
    had = each.groupBy("token").agg(F.count("*").alias("n"))
    ranked = c.select("claim_id", "need", F.explode("t").alias("token")).join(had, "token", "left")
    ranked = ranked.groupBy("claim_id", "need").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")))["token"].alias("ranked"))
    rare = ranked.withColumn("rare", F.slice("ranked", F.lit(1), F.size("ranked") - F.col("need") + 1))
    rare = rare.select("claim_id", "need", "ranked", "rare", F.explode("rare").alias("token"))
    pairs = each.join(F.broadcast(rare) if small else rare, "token").where(F.get(F.array_intersect("rare", "t"), F.lit(0)) == F.col("token"))
    pairs = pairs.withColumn("hits", F.size(F.array_intersect("ranked", "t")).cast("long"))
    return pairs.where(F.col("hits") >= F.col("need")).select("claim_id", "source_id", "hits")


#: Bytes of quotes that one automaton holds; more are searched for in blocks, each in a pass of its own.
QUOTE_BYTES = 4 << 20


def _automaton(quotes: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for quote in quotes:
        out.add_word(quote, quote)
    out.make_automaton()
    return out


def _finds(sent: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes = sent.value  # a worker process has it once
        for batch in batches:
            at, said = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    mine = {quote for _, quote in quotes.iter(text)}
                    at += [k] * len(mine)
                    said += mine
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(said, pa.string())], names=["source_id", "quote"])

    return run


def verbatim(quotes: DataFrame, sources: DataFrame, least: int = 24, quote_bytes: int = QUOTE_BYTES) -> DataFrame:
    """quotes(quote_id, quote) x sources(source_id, text) -> pairs where the quote is in the text, white space aside.

    All different quotes are in one automaton, which reads each text once and finds them wherever they overlap; it is built from at most about
    ``quote_bytes``. With more of them the texts are read once for each block of quotes. No pair is a candidate that isn't a find.
    """
    q = written(quotes.select("quote_id", T.normalize_space(F.col("quote")).alias("quote")).where(F.length("quote") >= least), "quotes")
    every = q.select("quote").distinct()
    total = every.agg(F.sum(F.octet_length("quote"))).first()[0] or 0
    blocks, spark = max(1, -(-total // quote_bytes)), q.sparkSession
    s = sources.select("source_id", T.normalize_space(F.col("text")).alias("text")).where(F.length("text") >= least)
    schema, found = StructType([s.schema["source_id"], StructField("quote", StringType())]), None
    for k in range(blocks):
        listed = [r["quote"] for r in every.where(F.pmod(F.xxhash64("quote"), F.lit(blocks)) == k).collect()]
        if listed or not k:
            part = s.mapInArrow(_finds(spark.sparkContext.broadcast(_automaton(listed))), schema) if listed else s.where("false").select("source_id", F.col("text").alias("quote"))
            found = part if found is None else found.unionAll(part)
    return found.join(q, "quote").select("quote_id", "source_id")


def exact_evidence(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """claims(identity_id, cap_ord, name, description, evidence_url, evidence_quote) with a column supported: the quote is
    in the first block of that URL and identity, and the claim is lexically supported by that block alone."""
    first = blocks.groupBy("identity_id", "url").agg(F.min_by("text", "source_ord").alias("block"))
    j = claims.join(first.withColumnRenamed("url", "evidence_url"), ["identity_id", "evidence_url"], "left")
    quote = T.normalize_space(F.col("evidence_quote"))
    ok = (F.length(quote) >= 24) & F.contains(T.normalize_space(F.col("block")), quote) & lexical_support(F.col("name"), F.col("description"), F.col("block"))
    return j.withColumn("supported", F.coalesce(ok & (F.col("evidence_url") != ""), F.lit(False))).drop("block")


def keep_supported(claims: DataFrame, minimum: int = 3) -> DataFrame:
    """Supported claims, with an error on identities that keep fewer than minimum."""
    n = F.count("*").over(Window.partitionBy("identity_id"))
    return claims.where("supported").withColumn("error", F.when(n < minimum, F.lit("too few supported capabilities")))


def first_by_key(rows: DataFrame, partition: list[str], key: Column, order: Column) -> DataFrame:
    """The first row of each key; rows without a key go."""
    w = Window.partitionBy(*partition, "__key").orderBy(order)
    return rows.withColumn("__key", key).where("__key is not null").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__key", "__n")


def head(rows: DataFrame, partition: list[str], order: Column, n: int) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*partition).orderBy(order))).where(F.col("__n") <= n).drop("__n")


def tail(rows: DataFrame, partition: list[str], order: str, n: int) -> DataFrame:
    return head(rows, partition, F.desc(order), n)


def cap_critical(rows: DataFrame, partition: list[str], order: Column, most: int = 3) -> DataFrame:
    """Only the first critical rows stay critical."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("critical", F.col("critical") & (F.sum(F.col("critical").cast("int")).over(w) <= most))
