"""Listing file trees and reading file bodies from executors that share a mount."""

from __future__ import annotations

import os
import stat
from collections import deque
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions import fixed, paths
from ..session import staged

_FOUND = T.StructType([T.StructField("root", T.StringType()), T.StructField("is_dir", T.BooleanType()), *schema.SCAN.fields])
DIRS_PER_TASK = 256
BATCH_BYTES = 32 << 20


def _pruned(name: str, names: frozenset[str], prefix: str) -> bool:
    return name in names or name.startswith(prefix)


def _list_dir(root: str, directory: str, names: frozenset[str], prefix: str) -> list[tuple]:
    """Regular files and directories of one directory; links and special files are left out, and so is anything
    that cannot be read."""
    rows = []
    try:
        entries = os.scandir(directory)
    except OSError:
        return rows
    with entries:
        for e in entries:
            try:
                info = e.stat(follow_symlinks=False)
            except OSError:
                continue
            if stat.S_ISDIR(info.st_mode):
                if not _pruned(e.name, names, prefix):
                    rows.append((root, True, e.path, directory, e.name, "", 0, 0))
            elif stat.S_ISREG(info.st_mode):
                ext = e.name.rpartition(".")[2].lower() if "." in e.name else ""
                rows.append((root, False, e.path, directory, e.name, ext, info.st_size, int(info.st_mtime)))
    return rows


def scan_files(spark: SparkSession, roots: Iterable[str], skip_names: Iterable[str] = fixed.SKIP_DIR_NAMES,
               skip_prefix: str = fixed.SKIP_DIR_PREFIX, dirs_per_task: int = DIRS_PER_TASK) -> DataFrame:
    """All regular files below the roots as scan rows.

    Directories are the unit of work. A task lists a bounded number of them and hands the rest back, which are
    spread evenly over all tasks of the next round, so one deep subtree never stays with one task. The first
    rounds are short to fan out quickly. A root itself is never pruned.
    """
    names = frozenset(skip_names)

    def walker(budget: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                todo = deque(zip(batch["root"], batch["path"]))
                left = max(budget, len(todo))
                while todo and left:
                    root, directory = todo.popleft()
                    left -= 1
                    rows = _list_dir(root, directory, names, skip_prefix)
                    todo.extend((root, r[2]) for r in rows if r[1])
                    yield pd.DataFrame([r for r in rows if not r[1]], columns=_FOUND.names)
                yield pd.DataFrame([(r, True, d, "", "", "", 0, 0) for r, d in todo], columns=_FOUND.names)

        return run

    frontier = spark.createDataFrame([(paths.clean_dir(r), paths.clean_dir(r)) for r in roots], "root string, path string")
    parts, budget = [], 1
    while True:
        found = staged(frontier.repartition("path").mapInPandas(walker(budget), _FOUND), "listing")
        parts.append(found.where(~F.col("is_dir")))
        frontier = found.where("is_dir").select("root", "path")
        if frontier.isEmpty():
            break
        budget = min(budget * 8, dirs_per_task)
    return reduce(DataFrame.unionByName, parts).select(*schema.SCAN.names)


def read_bodies(candidates: DataFrame, cap: int | None = None) -> DataFrame:
    """``(path, bytes)`` with at most ``cap`` bytes of each candidate; files that cannot be read are left out.

    Neighbouring paths are read together, and batches are cut by size rather than by number of rows.
    """
    out = T.StructType([T.StructField("path", T.StringType()), T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for batch in batches:
            for path in batch["path"]:
                try:
                    with open(path, "rb") as f:
                        rows.append((path, f.read(cap)))
                except OSError:
                    continue
                held += len(rows[-1][1])
                if held >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=out.names)
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=out.names)

    return candidates.select("path").repartitionByRange("path").mapInPandas(run, out)
