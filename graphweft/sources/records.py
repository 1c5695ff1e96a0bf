"""Tickets and session logs: small TOML files, and append-only JSON lines read from a byte offset."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from graphweft.functions.text import parse_time
from graphweft.sources.files import parsed

TICKET = 'id string, title string, status string, kind string, priority long, "order" long, parent string, shipped_at string, spec string, plan string'.replace('"', "`")
HEAD_BYTES = 4096
LINE = "path string, offset long, line string"
#: The fields of a line that are read; whatever has another type is null, whatever else a line holds is never decoded.
FIELDS = (
    "type string, uuid string, timestamp string, cwd string, gitBranch string, slug string, "
    "message struct<content: array<struct<type: string, id: string, name: string, tool_use_id: string, is_error: boolean, "
    "input: struct<file_path: string, offset: long, limit: long, planFilePath: string, taskId: string, status: string>>>>, "
    "toolUseResult struct<structuredPatch: array<struct<oldStart: long, oldLines: long, newStart: long, newLines: long>>, task: struct<id: string>>, _bad string"
)


def _ticket(path: str, text: str):
    table = tomllib.loads(text)
    text_of = lambda k: v if isinstance(v := table.get(k), str) else None
    whole = lambda k: v if isinstance(v := table.get(k), int) and not isinstance(v, bool) else None
    for key in ("id", "status"):
        if text_of(key) is None:
            raise ValueError(f"no `{key}`")
    yield text_of("id"), text_of("title") or "", text_of("status"), text_of("kind"), whole("priority"), whole("order"), text_of("parent"), text_of("shipped_at"), text_of("spec"), text_of("plan")


def read_tickets(files: DataFrame) -> DataFrame:
    """Tickets of files T-*.toml (path, text); a bad file is a row with its reason, never its text."""
    rows = parsed(files.where(F.substring_index("path", "/", -1).rlike(r"^T-.*\.toml$")), _ticket, TICKET.replace("`", ""))
    return rows


def discover_logs(spark: SparkSession, projects: str) -> DataFrame:
    """(path, project, session, subagent, length, mtime) of all logs: <project>/<session>.jsonl and <project>/<session>/subagents/<name>.jsonl."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(projects).select("path", "length", F.unix_micros("modificationTime").alias("mtime"))
    part = F.regexp_extract("path", r"([^/]+)/([^/]+?)(?:/subagents/[^/]+)?(?:\.jsonl)?$", 2)
    sub = F.col("path").rlike("/subagents/[^/]+$")
    return rows.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+?(?:/subagents/[^/]+)?\.jsonl$", 1).alias("project"), part.alias("session"), sub.alias("subagent"), "length", "mtime")


def complete_lines(data: bytes, start: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines in data that end; what has no end yet waits."""
    at = 0
    while (end := data.find(b"\n", at)) >= 0:
        yield start + at, data[at:end]
        at = end + 1


class _Piece(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


def _lines(piece: _Piece) -> Iterator[tuple]:
    """Lines of a byte range, a buffer at a time."""
    with open(piece.path, "rb") as f:
        f.seek(piece.start)
        at, rest = piece.start, b""
        while at + len(rest) < piece.end and (more := f.read(min(1 << 20, piece.end - at - len(rest)))):
            rest += more
            used = at
            for offset, line in complete_lines(rest, at):
                yield piece.path, offset, line.decode("utf-8", "replace")
                used = offset + len(line) + 1
            rest, at = rest[used - at :], used


def _ends(folder: str) -> dict[str, int]:
    """Byte after the last complete line of each log below a folder."""
    out = {}
    for base, _, names in os.walk(folder):
        for name in sorted(names):
            if name.endswith(".jsonl"):
                path = os.path.join(base, name)
                with open(path, "rb") as f:
                    size = at = os.path.getsize(path)
                    while at > 0:
                        step = min(1 << 16, at)
                        f.seek(at - step)
                        found = f.read(step).rfind(b"\n")
                        if found >= 0:
                            size = at - step + found + 1
                            break
                        at -= step
                    else:
                        size = 0
                out[path] = size
    return out


class _TailReader(DataSourceStreamReader):
    """Offsets are the consumed bytes of each log, so a batch is exactly what was appended since the last."""

    def __init__(self, options: dict) -> None:
        self.folder = options["path"]

    def initialOffset(self) -> dict:
        return {"ends": "{}"}

    def latestOffset(self) -> dict:
        return {"ends": json.dumps(_ends(self.folder), sort_keys=True)}

    def partitions(self, start: dict, end: dict):
        before, after = json.loads(start["ends"]), json.loads(end["ends"])
        # a log that got shorter was replaced: it is read again from its start
        return [_Piece(p, before.get(p, 0) if before.get(p, 0) <= e else 0, e) for p, e in sorted(after.items()) if e != before.get(p, 0)]

    def read(self, partition):
        return _lines(partition)

    def commit(self, end: dict) -> None:
        pass


class _WholeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.since = options["path"], json.loads(options.get("since", "{}"))

    def partitions(self):
        return [_Piece(p, self.since.get(p, 0), e) for p, e in sorted(_ends(self.folder).items()) if e > self.since.get(p, 0)] or [_Piece(os.devnull, 0, 0)]

    def read(self, partition):
        return _lines(partition)


class LogTail(DataSource):
    """Lines of append-only logs below a shared folder, in batches from given offsets (option since) or as a stream."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return LINE

    def reader(self, schema):
        return _WholeReader(self.options)

    def streamReader(self, schema):
        return _TailReader(self.options)


def skim(lines: DataFrame) -> DataFrame:
    """lines (path, offset, line) with their fields; bad: a line that is no JSON object. time: Unix milliseconds."""
    read = lines.withColumn("f", F.from_json("line", FIELDS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("f").isNull() | ~F.ltrim("line").startswith("{") | (F.try_parse_json("line").isNull())
    return read.select("path", "offset", "f.type", "f.uuid", parse_time(F.col("f.timestamp")).alias("time"), "f.cwd", F.col("f.gitBranch").alias("branch"), "f.slug", "f.message", "f.toolUseResult", bad.alias("bad"))


def calls_and_results(skimmed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log, call_id, at, name, file_path, ...) of tool calls, and (log, call_id, at, is_error) of their results."""
    parts = skimmed.where("not bad").select(F.col("path").alias("log"), F.col("offset").alias("at"), "time", F.explode("message.content").alias("c"))
    calls = parts.where("c.type = 'tool_use'").select("log", F.col("c.id").alias("call_id"), "at", "time", F.col("c.name").alias("name"), "c.input.*")
    return calls, parts.where("c.type = 'tool_result'").select("log", F.col("c.tool_use_id").alias("call_id"), "at", F.coalesce("c.is_error", F.lit(False)).alias("is_error"))
