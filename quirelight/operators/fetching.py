"""Downloads as a Spark job: a worker a share of hosts, partial files that go on.

Urls are dealt by host, and a host to so many tasks as its budget allows, so no
host is asked by more of them at once, whatever the number of its urls.  A file
is written beside its name, ``.part``, under a folder that all machines see, and
renamed when it is whole; a partial file that is there is continued where the
server allows, as ``downloads.resume`` decides, and files that are there whole
are not asked for again.
"""

from __future__ import annotations

import importlib
import os
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .downloads import CONTENT_TYPES, LEAST_BYTES, MOST_BYTES

TASKS, BUDGET, TRIES = 64, 2, 3
RETRIED = frozenset({429, 500, 502, 503, 504})
RESULT = "key string, url string, path string, success boolean, cached boolean, size long, content_type string, error string"


class Answer(NamedTuple):
    """What a transport gives for (url, first byte wanted): its status, headers in lower case, and the body in pieces."""

    status: int
    headers: dict[str, str]
    body: Iterator[bytes]


Transport = Callable[[str, int], Answer]


def http(url: str, start: int) -> Answer:
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        answer = urlopen(Request(url, headers={"Range": f"bytes={start}-"} if start else {}), timeout=60)  # noqa: S310
    except HTTPError as e:
        return Answer(e.code, {k.lower(): v for k, v in e.headers.items()}, iter(()))
    return Answer(answer.status, {k.lower(): v for k, v in answer.headers.items()}, iter(lambda: answer.read(1 << 16), b""))


def _size(value: str | None) -> int | None:
    return int(value) if value is not None and value.strip().isdecimal() else None


def _whole(answer: Answer, start: int) -> int | None:
    """The size that the whole file has, as far as the answer tells."""
    told = _size(answer.headers.get("content-range", "").rpartition("/")[2] or None)
    rest = _size(answer.headers.get("content-length"))
    return told if told is not None else start + rest if rest is not None and answer.status in (200, 206) else None


def _attempt(get: Transport, url: str, part: str) -> tuple[str, str | None]:
    """('done', content type), ('again', why) or ('failed', why) after one answer."""
    have = os.path.getsize(part) if os.path.exists(part) else 0
    answer = get(url, have)
    kind = answer.headers.get("content-type", "").split(";")[0].strip().lower() or None
    if answer.status == 416 and have:
        if _whole(answer, 0) == have:
            return "done", kind
        os.remove(part)
        return "again", "partial file does not fit"
    if answer.status in RETRIED:
        return "again", f"status {answer.status}"
    if answer.status not in (200, 206):
        return "failed", f"status {answer.status}"
    start = have if answer.status == 206 else 0
    whole, size = _whole(answer, start), start
    with open(part, "ab" if start else "wb") as out:
        for piece in answer.body:
            size += len(piece)
            if size > MOST_BYTES:
                break
            out.write(piece)
    if size > MOST_BYTES:
        os.remove(part)
        return "failed", "too large"
    if whole is not None and size < whole:
        return "again", f"{size} of {whole} bytes"
    if whole is not None and size > whole:
        os.remove(part)
        return "again", f"{size} bytes where {whole} were told"
    return "done", kind


def fetch_one(get: Transport, url: str, path: str, tries: int = TRIES, pause: float = 1.0) -> tuple[str, bool, bool, int, str | None, str | None]:
    """(path, success, cached, size, content type, error); the path has the extension that the content type asks for."""
    if os.path.exists(path) and os.path.getsize(path) >= LEAST_BYTES:
        return path, True, True, os.path.getsize(path), None, None
    part, why = f"{path}.part", "no tries"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    for attempt in range(tries):
        try:
            state, told = _attempt(get, url, part)
        except OSError as e:
            state, told = "again", str(e)
        if state == "done":
            size = os.path.getsize(part) if os.path.exists(part) else 0
            if size < LEAST_BYTES:
                os.remove(part)
                return path, False, False, size, told, "too small"
            wanted = CONTENT_TYPES.get(told or "")
            stem, has = os.path.splitext(path)
            final = stem + wanted if wanted and has.lower() != wanted else path
            os.replace(part, final)
            return final, True, False, size, told, None
        why = told
        if state == "failed":
            break
        if attempt + 1 < tries:
            time.sleep(pause * 2**attempt)
    return path, False, False, 0, None, why


def fetch_all(plan: DataFrame, root: str, transport: str = f"{__name__}:http", key: str = "key", budget: int = BUDGET, tasks: int = TASKS, tries: int = TRIES, pause: float = 1.0) -> DataFrame:
    """key, url, path, success, cached, size, content_type, error of every row of ``plan`` (key, url, path).

    ``transport`` names a callable as ``module:function``.  Of rows with one
    path the first by key and url is fetched; the others have its file.  ``root``
    must be a folder that every machine sees under this name.
    """
    host = F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1))
    rows = plan.select(F.col(key).cast("string").alias("key"), "url", "path").where("url is not null and path is not null")
    once = rows.groupBy("path").agg(F.min(F.struct("key", "url")).alias("first")).select("path", F.col("first.url").alias("url"))
    # a host's urls lie in ``budget`` of the tasks at most, each of which takes them one by one
    turn = F.pmod(F.xxhash64("path"), F.lit(budget))
    place = F.pmod(F.xxhash64(host) + turn, F.lit(tasks)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        module, _, name = transport.partition(":")
        get = getattr(importlib.import_module(module), name)
        for batch in batches:
            for row in batch.to_pylist():
                made = fetch_one(get, row["url"], f"{root}/{row['path']}", tries, pause)
                values = (row["path"], made[0].removeprefix(f"{root}/"), *made[1:])
                yield pa.RecordBatch.from_pylist([dict(zip(names, values, strict=True))], schema=schema)

    names = ["asked", "path", "success", "cached", "size", "content_type", "error"]
    kinds = [pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.string(), pa.string()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    done = once.withColumn("place", place).repartitionByRange(tasks, "place").drop("place").mapInArrow(run, "asked string, path string, success boolean, cached boolean, size long, content_type string, error string")
    return rows.select("key", "url", F.col("path").alias("of")).join(done, F.col("of") == F.col("asked")).select(*[c.split()[0] for c in RESULT.split(", ")])
