"""The RESP wire format, second and third version: one value at a time, and files of commands."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MAX_DEPTH, MAX_BULK, MAX_ITEMS = 32, 512 << 20, 1 << 20


class Incomplete(Exception):
    """More bytes are needed."""


def _line(data: bytes, at: int) -> tuple[bytes, int]:
    end = data.find(b"\r\n", at)
    if end < 0:
        raise Incomplete
    return data[at:end], end + 2


def decode(data: bytes, at: int = 0, depth: int = 0):
    """(value, place behind it). Errors come as ValueError objects; an inline command is a list of its words."""
    if depth > MAX_DEPTH:
        raise ValueError("nested too deeply")
    if at >= len(data):
        raise Incomplete
    kind, (head, at) = data[at : at + 1], _line(data, at + 1)
    if kind == b"+":
        return head.decode(), at
    if kind == b"-":
        return ValueError(head.decode()), at
    if kind == b":":
        return int(head), at
    if kind == b",":
        return float(head), at
    if kind == b"#":
        return head == b"t", at
    if kind == b"_":
        return None, at
    if kind in (b"$", b"="):
        n = int(head)
        if n < 0:
            return None, at
        if n > MAX_BULK:
            raise ValueError("a bulk string is too long")
        if len(data) < at + n + 2:
            raise Incomplete
        return data[at : at + n], at + n + 2
    if kind in (b"*", b"~", b"%"):
        n = int(head)
        if n < 0:
            return None, at
        if n > MAX_ITEMS:
            raise ValueError("an array is too long")
        out = []
        for _ in range(2 * n if kind == b"%" else n):
            value, at = decode(data, at, depth + 1)
            out.append(value)
        return (dict(zip(out[::2], out[1::2], strict=True)) if kind == b"%" else out), at
    words = (kind + head).split()
    return words, at


def encode(value, version: int = 2) -> bytes:
    if value is None:
        return b"_\r\n" if version == 3 else b"$-1\r\n"
    if isinstance(value, bool):
        return (b"#t\r\n" if value else b"#f\r\n") if version == 3 else b":%d\r\n" % value
    if isinstance(value, int):
        return b":%d\r\n" % value
    if isinstance(value, float):
        text = (str(int(value)) if value == int(value) and abs(value) < 1e17 else repr(value)) if abs(value) != float("inf") else ("inf" if value > 0 else "-inf")
        return b",%s\r\n" % text.encode() if version == 3 else encode(text.encode())
    if isinstance(value, str):
        return b"+%s\r\n" % value.encode()
    if isinstance(value, bytes):
        return b"$%d\r\n%s\r\n" % (len(value), value)
    if isinstance(value, dict):
        items = [x for pair in value.items() for x in pair]
        head = b"%%%d\r\n" % len(value) if version == 3 else b"*%d\r\n" % len(items)
        return head + b"".join(encode(x, version) for x in items)
    if isinstance(value, Exception):
        return b"-%s\r\n" % str(value).encode()
    return b"*%d\r\n" % len(value) + b"".join(encode(x, version) for x in value)


def command_files(spark: SparkSession, path: str) -> DataFrame:
    """file, seq, argv of every command in files of encoded commands, a file to a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                data, at, rows = bytes(content), 0, []
                while at < len(data):
                    argv, at = decode(data, at)
                    rows.append((file, len(rows), argv))
                yield pd.DataFrame(rows, columns=["file", "seq", "argv"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, seq long, argv array<binary>")
