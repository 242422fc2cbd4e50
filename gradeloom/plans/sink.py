"""Artifacts as files, one for each identity and name, published as a whole.

The data source ``artifact_set`` writes a set beside the one that is there: tasks write into a folder of their own, the commit checks that no file is there
twice, moves the files of the tasks that succeeded into the new set, writes its manifest, and then points CURRENT at it in one step. A job that
fails leaves CURRENT and its set as they were. The path is a folder that all executors have mounted.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.workers import sent_by_value

sent_by_value(__name__)

SCHEMA = "identity_id string, name string, content string"
#: Sets that stay: the current one and those before it.
KEPT = 2


def local(path: str) -> Path:
    if "://" in path and not path.startswith("file://"):
        raise ValueError("an artifact set needs a mounted folder; write the artifacts as a table where there is none")
    return Path(path.removeprefix("file://"))


@dataclass
class Files(WriterCommitMessage):
    files: list[tuple[str, str, str]] = field(default_factory=list)  # place in the set, where it is now, digest


class ArtifactSet(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artifact_set"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(str(local(self.options["path"])))


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.id = path, uuid.uuid4().hex

    @property
    def staging(self) -> Path:
        return Path(self.path, f".staging-{self.id}")

    def write(self, iterator: Iterator[Row]) -> Files:
        own, out = self.staging / uuid.uuid4().hex, Files()  # a task that is run again has another folder
        for row in iterator:
            place = f"{quote(row.identity_id, safe='')}/{quote(row.name, safe='')}"
            data = ((row.content or "").strip() + "\n").encode()
            (own / place).parent.mkdir(parents=True, exist_ok=True)
            with open(own / place, "xb") as f:
                f.write(data)
            out.files.append((place, str(own / place), hashlib.sha256(data).hexdigest()))
        return out

    def commit(self, messages: list[Files | None]) -> None:
        files = sorted(x for m in messages if m for x in m.files)
        if twice := [a[0] for a, b in zip(files, files[1:]) if a[0] == b[0]]:
            self.abort(messages)
            raise ValueError(f"more than one content for {twice[0]}")
        at = Path(self.path, "sets", self.id)
        at.mkdir(parents=True)
        for place, now, _ in files:
            (at / place).parent.mkdir(exist_ok=True)
            os.rename(now, at / place)
        (at / "MANIFEST.json").write_text(json.dumps({place: digest for place, _, digest in files}, indent=1))
        mark = Path(self.path, f".CURRENT-{self.id}")
        mark.write_text(self.id)
        before = Path(self.path, "CURRENT").read_text() if Path(self.path, "CURRENT").exists() else None
        os.replace(mark, Path(self.path, "CURRENT"))
        shutil.rmtree(self.staging, ignore_errors=True)
        for old in Path(self.path, "sets").iterdir():
            if old.name not in (self.id, before):
                shutil.rmtree(old, ignore_errors=True)

    def abort(self, messages: list[Files | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


def publish(artifacts: DataFrame, path: str) -> None:
    """artifacts(identity_id, name, content) as the new current set at path."""
    artifacts.sparkSession.dataSource.register(ArtifactSet)
    artifacts.select("identity_id", "name", "content").write.format("artifact_set").mode("append").save(path)


def published(spark: SparkSession, path: str) -> DataFrame:
    """identity_id, name, content of the current set."""
    at = local(path) / "sets" / (local(path) / "CURRENT").read_text()
    rows = spark.read.text(f"file://{at}/*/*", wholetext=True).select(F.split(F.col("_metadata.file_path"), "/").alias("p"), F.col("value").alias("content"))
    # the reader's path writes the names' escapes once more
    plain = lambda c: F.url_decode(F.url_decode(c))
    return rows.select(plain(F.element_at("p", -2)).alias("identity_id"), plain(F.element_at("p", -1)).alias("name"), "content")


def place(identity_id: str, name: str, path: str) -> Path:
    """Where the current set has an artifact."""
    return local(path) / "sets" / (local(path) / "CURRENT").read_text() / quote(identity_id, safe="") / quote(name, safe="")


def identity_of(folder: str) -> str:
    return unquote(folder)
