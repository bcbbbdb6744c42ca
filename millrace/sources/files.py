"""File sources and sinks: scanning checkouts, git history, snapshots, rendered contexts."""

from __future__ import annotations

import fnmatch
import os
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T

# Folders that are never scanned, and the size limit of a source file.
IGNORED_FOLDERS = ("target", "node_modules", "dist", "build", "out", "vendor", "venv", ".venv", "env", "__pycache__", ".git", ".hg", ".svn", ".idea", ".vscode", ".next", "coverage", "bin", "obj")
MAX_BYTES = 2 * 1024 * 1024
#: Version of the snapshot layout; another version is not read.
SNAPSHOT_VERSION = 1


def confined(root: str, path: str) -> str:
    """Absolute form of `path`, which must lie under `root` even after links are followed."""
    base = os.path.realpath(root)
    full = os.path.realpath(path if os.path.isabs(path) else os.path.join(base, path))
    if full != base and not full.startswith(base + os.sep):
        raise PermissionError(f"{path} is outside {root}")
    return full


def ignore_patterns(root: str) -> list[str]:
    """Patterns of the root's .gitignore as regular expressions over relative paths."""
    file = os.path.join(root, ".gitignore")
    out = []
    if os.path.exists(file):
        with open(file, encoding="utf-8", errors="replace") as f:
            for line in f:
                p = line.strip()
                if p and not p.startswith(("#", "!")):
                    body = fnmatch.translate(p.strip("/")).removesuffix("\\Z").removeprefix("(?s:").removesuffix(")")
                    out.append(("^" if p.startswith("/") else "(?:^|/)") + body + "(?:/|$)")
    return out


def scan(spark: SparkSession, root: str, languages: tuple[str, ...] | None = None, exclude: tuple[str, ...] = (), max_bytes: int = MAX_BYTES) -> DataFrame:
    """(file_path, language, length, content_hash, content) of the source files under a folder.

    Hidden files, ignored folders, .gitignore matches, other languages and files over
    the size limit are left out before their bytes are read.
    """
    base = confined(root, root)
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.*").load("file://" + base)
    rel = F.regexp_replace(F.col("path"), "^file:/*" + re.escape(base.rstrip("/")) + "/", "")
    f = f.where(F.col("length") <= max_bytes).withColumn("file_path", rel).withColumn("language", T.language_of(rel))
    f = f.where(F.col("language").isNotNull() & ~F.col("file_path").rlike(r"(?:^|/)\."))
    f = f.where(~F.col("file_path").rlike("(?:^|/)(?:" + "|".join(re.escape(x) for x in IGNORED_FOLDERS) + ")/"))
    for p in (*ignore_patterns(base), *(fnmatch.translate(x) for x in exclude)):
        f = f.where(~F.col("file_path").rlike(p))
    if languages:
        f = f.where(F.col("language").isin(*languages))
    return f.select("file_path", "language", "length", F.sha2("content", 256).alias("content_hash"), F.decode("content", "UTF-8").alias("content"))


def changed_since(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Files whose (path, content hash) the snapshot lacks; modification times are never trusted."""
    return files.join(snapshot.select("file_path", "content_hash").distinct(), ["file_path", "content_hash"], "left_anti")


def write_snapshot(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").parquet(os.path.join(folder, f"v{SNAPSHOT_VERSION}"))


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame | None:
    """The snapshot of this layout version, None where there is none."""
    path = os.path.join(folder, f"v{SNAPSHOT_VERSION}")
    return spark.read.parquet(path) if os.path.isdir(path.removeprefix("file://")) else None


def clean_snapshots(folder: str) -> None:
    import shutil

    shutil.rmtree(folder, ignore_errors=True)


_REVISION = re.compile(r"^[A-Za-z0-9._/~^@{}][A-Za-z0-9._/~^@{}-]*$")


def _git(root: str, *args: str) -> str:
    env = {**os.environ, "GIT_CONFIG_NOSYSTEM": "1", "GIT_TERMINAL_PROMPT": "0"}
    r = subprocess.run(["git", "-c", "core.hooksPath=/dev/null", "-C", root, *args], capture_output=True, text=True, errors="replace", env=env, check=False)
    return r.stdout if r.returncode == 0 else ""


def git_log(spark: SparkSession, root: str, commits: int = 200) -> DataFrame:
    """(key, log): the last commits with their diffs as one text, for history.parse_log."""
    text = _git(confined(root, root), "log", "-p", "--unified=0", f"-n{int(commits)}", "--format=COMMIT_DELIMITER %H %ct")
    return spark.createDataFrame([(root, text)], "key string, log string")


def git_diff(spark: SparkSession, root: str, revision: str | None = None) -> DataFrame:
    """(key, diff) of the checkout against a revision, HEAD, or its index."""
    base = confined(root, root)
    if revision is not None:
        if not _REVISION.match(revision.strip()):
            raise ValueError(f"not a revision: {revision!r}")
        text = _git(base, "diff", "--unified=0", revision.strip())
    else:
        text = _git(base, "diff", "--unified=0", "HEAD") or _git(base, "diff", "--unified=0")
    return spark.createDataFrame([(root, text)], "key string, diff string")


def symbol_source(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, source): the bytes of each symbol's span; only files with a wanted symbol are joined."""
    j = symbols.select("id", "file_path", "start_byte", "end_byte").join(files.select("file_path", F.encode("content", "UTF-8").alias("b")), "file_path")
    return j.select("id", F.decode(F.substring(F.col("b"), F.col("start_byte").cast("int") + 1, (F.col("end_byte") - F.col("start_byte")).cast("int")), "UTF-8").alias("source"))


def mermaid(edges: DataFrame, key: str = "query") -> DataFrame:
    """(key, diagram): edges (key, src_name, relation, dst_name) of each key as a flow chart."""
    line = F.concat(F.lit("  "), F.col("src_name"), F.lit(" -->|"), F.col("relation"), F.lit("| "), F.col("dst_name"))
    return edges.groupBy(key).agg(F.concat(F.lit("graph LR\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("diagram"))


def markdown(selected: DataFrame, key: str = "query") -> DataFrame:
    """(key, text): selected symbols (key, step, file_path, signature, docstring) as Markdown, grouped by file."""
    doc = F.when(F.col("docstring").isNotNull(), F.concat(F.lit("/// "), F.regexp_replace("docstring", "\n", "\n/// "), F.lit("\n"))).otherwise("")
    per = selected.groupBy(key, "file_path").agg(F.min("step").alias("first"), F.array_sort(F.collect_list(F.struct("step", F.concat(doc, F.col("signature")).alias("t")))).alias("rows"))
    block = F.concat(F.lit("## "), F.col("file_path"), F.lit("\n\n"), F.array_join(F.transform("rows", lambda r: r["t"]), "\n"))
    return per.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "file_path", block.alias("b")))), lambda r: r["b"]), "\n\n").alias("text"))
