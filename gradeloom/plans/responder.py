"""Model calls as a seam: requests in, responses out.

A responder takes requests (request_hash, role, system, user, temperature, max_tokens, ...) and returns them with content and error.
replaying() answers from recorded responses by request hash; answering() from a Python function; live() from a local model server;
Ledger.through() keeps the responses of any of them, so that none is asked for twice.
Nothing calls a server unless live() is asked for, which refuses to where runs must not cost anything.
"""

from __future__ import annotations

import json
import os
import threading
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.jsonx import json_object
from ..functions.tables import written
from ..functions.workers import sent_by_value

sent_by_value(__name__)

FIELDS = ("role", "system", "user", "temperature", "max_tokens")
Responder = Callable[[DataFrame], DataFrame]
#: Seconds and attempts of a call, and the length of a response that is sent to be repaired.
LONG_SECONDS, SECONDS, LONG_FROM, REPAIR_CHARS = 300, 180, 550, 8_000


def assert_zero_cost(environment: dict[str, str] | None = None) -> None:
    """Refuse runs that aren't declared free of cost, and runs for a private repository on hosted machines."""
    env = os.environ if environment is None else environment
    if env.get("ZERO_COST", "true").lower() != "true":
        raise RuntimeError("ZERO_COST must be true")
    event = env.get("GITHUB_EVENT_PATH")
    if event and Path(event).exists() and (json.loads(Path(event).read_text(encoding="utf-8")).get("repository") or {}).get("private") is True:
        raise RuntimeError("hosted runs for a private repository are not free")


def requests(rows: DataFrame) -> DataFrame:
    return rows.withColumn("request_hash", F.sha2(F.to_json(F.struct(*FIELDS)), 256))


def plan(asked: DataFrame) -> DataFrame:
    """Requests with what each of two attempts sends: json_mode, first_tokens, second_tokens, first_seconds, second_seconds."""
    mode, first = T.expects_json(F.col("system")), T.token_budget(F.col("role"), F.col("max_tokens"))
    second = F.when(mode, T.retry_budget(first)).otherwise(first)
    seconds = lambda n: F.when(mode & (n > LONG_FROM), LONG_SECONDS).otherwise(SECONDS)
    return asked.withColumns({"json_mode": mode, "first_tokens": first, "second_tokens": second, "first_seconds": seconds(first), "second_seconds": seconds(second)})


def replay(asked: DataFrame, recorded: DataFrame, attempts: int = 2) -> DataFrame:
    """The first recorded attempt that wasn't cut off (finish_reason "length"), else an error."""
    usable = recorded.where((F.col("attempt") <= attempts) & (F.coalesce("finish_reason", F.lit("stop")) != "length"))
    first = usable.groupBy("request_hash").agg(F.min_by("content", "attempt").alias("content"))
    return asked.join(first, "request_hash", "left").withColumn("error", F.when(F.col("content").isNull(), F.lit("no response")))


def replaying(recorded: DataFrame, attempts: int = 2) -> Responder:
    return lambda asked: replay(asked, recorded, attempts)


def call(post: Callable[[dict, int], dict], r: dict, core: bool = False, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """Content or error of one planned request. The core profile makes three attempts alike; the other one two, of which the second may
    use more tokens in JSON mode, where a response that was cut off counts as none and is asked for again at once."""
    error = "no attempt"
    for attempt in range(3 if core else 2):
        tokens, seconds = (r["max_tokens"], SECONDS) if core else (r["second_tokens"], r["second_seconds"]) if attempt else (r["first_tokens"], r["first_seconds"])
        body = {
            "messages": [{"role": "system", "content": r["system"]}, {"role": "user", "content": r["user"] + "\n/no_think"}], "temperature": r["temperature"],
            "max_tokens": int(tokens), "stream": False, "chat_template_kwargs": {"enable_thinking": False},
        }
        if r["json_mode"] and not core:
            body["response_format"] = {"type": "json_object"}
        try:
            choice = post(body, int(seconds))["choices"][0]
            if r["json_mode"] and not core and choice.get("finish_reason") == "length":
                error = f"cut off at {tokens} tokens"
                continue
            return choice["message"]["content"], None
        except Exception as e:  # noqa: BLE001 - any failure of a call is a row's error
            error = f"{type(e).__name__}: {e}"
            sleep(2 + 2 * attempt)
    return None, error


class Pace:
    """Lets calls begin at most so often a second, in any number of threads."""

    def __init__(self, per_second: float | None):
        self.step, self.next, self.lock = 1 / per_second if per_second else 0.0, 0.0, threading.Lock()

    def wait(self) -> None:
        if self.step:
            with self.lock:
                now = time.monotonic()
                begin = max(now, self.next)
                self.next = begin + self.step
            time.sleep(max(0.0, begin - now))


#: Tasks that call at once, calls in flight in each of them, and requests that a task holds at a time.
TASKS, IN_FLIGHT, HELD = 8, 8, 64


def answering(answer: Callable[[dict], tuple[str | None, str | None]], tasks: int = TASKS, in_flight: int = IN_FLIGHT, per_second: float | None = None) -> Responder:
    """A responder that calls answer for each planned request: in ``tasks`` tasks with ``in_flight`` calls each, which begin at most ``per_second`` times
    a second all together. A call that waits or is tried again holds up no other one; responses are in the order of requests."""

    def run(asked: DataFrame) -> DataFrame:
        planned = plan(asked)
        names = planned.columns

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pace = Pace(per_second and per_second / tasks)

            def one(r: tuple) -> tuple[str | None, str | None]:
                pace.wait()
                return answer(dict(zip(names, r)))

            with ThreadPoolExecutor(in_flight) as pool:
                for batch in batches:
                    for k in range(0, len(batch), HELD):
                        b = batch.iloc[k : k + HELD]
                        got = list(pool.map(one, b.itertuples(index=False, name=None)))
                        yield b.assign(content=pd.Series([g[0] for g in got], index=b.index, dtype=object), error=pd.Series([g[1] for g in got], index=b.index, dtype=object))[[*names, "content", "error"]]

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in planned.schema.fields)
        out = planned.repartition(tasks, "request_hash").mapInPandas(rows, f"{schema}, content string, error string").select(*asked.columns, "content", "error")
        return out.withColumn("content", T.strip_reasoning(F.col("content")))

    return run


class Ledger:
    """Responses by request hash, in a table at path, which outlives a run.

    through() makes a responder of which no request is asked for again that has been answered: what is asked for is first reduced to one
    row for each hash and to those that the table lacks (anti-join). Calls are made and written in ``chunks`` parts, each a commit of its own,
    so a run that ends in between loses one part at most. Requests that failed are written with their errors and asked for again in
    the next run. A task that Spark runs again within a part calls again; no table can know what a lost task had asked for.
    """

    SCHEMA = "request_hash string, content string, error string, at timestamp"

    def __init__(self, spark: SparkSession, path: str, chunks: int = 4):
        self.spark, self.path, self.chunks = spark, path, chunks
        spark.createDataFrame([], self.SCHEMA).write.mode("append").parquet(path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def answered(self) -> DataFrame:
        return self.table().where("content is not null").groupBy("request_hash").agg(F.min_by("content", "at").alias("content"))

    def through(self, respond: Responder) -> Responder:
        def run(asked: DataFrame) -> DataFrame:
            new = asked.dropDuplicates(["request_hash"]).join(self.answered().select("request_hash"), "request_hash", "left_anti").select(*asked.columns)
            new = written(new.withColumn("__chunk", F.pmod(F.xxhash64("request_hash"), F.lit(self.chunks))), "asked")
            for r in new.groupBy("__chunk").count().orderBy("__chunk").collect():
                part = respond(new.where(F.col("__chunk") == r["__chunk"]).drop("__chunk"))
                part.select("request_hash", "content", "error", F.current_timestamp().alias("at")).write.mode("append").parquet(self.path)
            failed = self.table().where("content is null").groupBy("request_hash").agg(F.max_by("error", "at").alias("error"))
            out = asked.join(self.answered(), "request_hash", "left").join(failed, "request_hash", "left")
            error = F.when(F.col("content").isNull(), F.coalesce("error", F.lit("no response")))
            return out.select(*asked.columns, "content", error.alias("error"))

        return run


def live(url: str, model: str, core: bool = False, tasks: int = TASKS, in_flight: int = IN_FLIGHT, per_second: float | None = None) -> Responder:
    """Calls to a model server with the chat-completions protocol; Ledger.through() keeps the responses."""
    assert_zero_cost()

    def post(body: dict, seconds: int) -> dict:
        data = json.dumps({"model": model, **body}).encode()
        with urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json"}), timeout=seconds) as f:
            return json.load(f)

    return answering(lambda r: call(post, r, core), tasks, in_flight, per_second)


def with_json(answered: DataFrame, repairs: DataFrame) -> DataFrame:
    """The JSON object of each response, or of its recorded repair (request_hash, content)."""
    x = answered.withColumn("__j", json_object("content")).join(repairs.select("request_hash", F.col("content").alias("__r")), "request_hash", "left")
    x = x.withColumn("__k", json_object("__r"))
    return x.select(*answered.columns, F.coalesce("__j.json", "__k.json").alias("object"), F.when(F.coalesce("__j.json", "__k.json").isNull(), F.coalesce("__k.error", "__j.error")).alias("json_error"))


def complete(asked: DataFrame, respond: Responder, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Requests with content and error; kept() makes the responses a table, so that no call is made twice."""
    return kept(respond(requests(asked)))


def complete_json(asked: DataFrame, respond: Responder, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """As complete(), with object and json_error: what isn't an object is sent once to be repaired."""
    from .prompts import SYSTEMS

    answered = complete(asked, respond, kept)
    parsed = kept(answered.withColumn("__j", json_object("content")))
    broken = parsed.where("content is not null and __j.json is null")
    task = F.concat(F.lit("Convert this malformed response into the JSON that was asked for; keep what it says.\nMALFORMED:\n"), T.truncate(F.col("content"), REPAIR_CHARS))
    again = broken.select("identity_id", F.lit("repair").alias("role"), F.lit(SYSTEMS["repair"]).alias("system"), task.alias("user"), F.lit(0.0).alias("temperature"), "max_tokens", F.col("request_hash").alias("of"))
    repaired = complete(again, respond, kept).select(F.col("of").alias("request_hash"), "content").dropDuplicates(["request_hash"])
    return with_json(answered, repaired)
