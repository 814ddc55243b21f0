"""Logs that other hosts hold: over HTTP, or by a command such as ssh. Each address is one task, and lines stream out
of it in blocks, so no file is held in memory."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import shlex
import subprocess
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "source_file string, block long, id long, text string"
#: What unpacks a remote file on its own host, by suffix.
READERS = {".gz": "zcat", ".bz2": "bzcat", ".xz": "xzcat", ".zst": "zstdcat", ".zstd": "zstdcat", ".lz4": "lz4cat"}


def _blocks(name: str, stream, size: int = 4_000_000) -> Iterator[pd.DataFrame]:
    at, text = 0, io.TextIOWrapper(stream, encoding="utf-8", errors="replace", newline="\n")
    while lines := text.readlines(size):
        yield pd.DataFrame({"source_file": name, "block": 0, "id": range(at, at + len(lines)), "text": [x.rstrip("\r\n") for x in lines]})
        at += len(lines)


def _fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    openers = {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open}
    for batch in batches:
        for url in batch["address"]:
            with urllib.request.urlopen(url, timeout=60) as body:
                opener = next((o for s, o in openers.items() if url.split("?")[0].lower().endswith(s)), None)
                yield from _blocks(url, opener(body) if opener else body)


def http_lines(spark: SparkSession, urls: list[str]) -> DataFrame:
    """Lines of HTTP resources as raw_lines() gives them; gz, bz2 and xz by the address's suffix."""
    rows = spark.createDataFrame([(u,) for u in urls], "address string").repartition(max(1, len(urls)))
    return rows.mapInPandas(_fetch, SCHEMA)


def ssh_command(host: str, path: str, user: str | None = None, port: int = 22) -> list[str]:
    reader = next((r for s, r in READERS.items() if path.lower().endswith(s)), "cat")
    return ["ssh", "-p", str(port), "-o", "BatchMode=yes", f"{user}@{host}" if user else host, f"{reader} {shlex.quote(path)}"]


def command_lines(spark: SparkSession, commands: dict[str, list[str]]) -> DataFrame:
    """Lines that commands print, by the name each is to have as a file; a command that fails fails its task."""
    rows = spark.createDataFrame(list(commands.items()), "name string, command array<string>").repartition(max(1, len(commands)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, command in zip(batch["name"], batch["command"], strict=True):
                with subprocess.Popen(list(command), stdout=subprocess.PIPE) as p:
                    yield from _blocks(name, p.stdout)
                if p.returncode:
                    raise OSError(f"{command[0]} ended with {p.returncode}")

    return rows.mapInPandas(run, SCHEMA)
