"""Problem 5: source files that do not parse.

Every file is lexed and run through the parsing-expression grammar of the
language its extension names; it is valid only if the start rule consumes the
whole input. For an invalid file a second, tracing run reports the furthest
failure, and a cause is told from it: conflict markers, truncation, a text that
another language's grammar accepts, binary data, or plain syntax.

Defined cases: null content and files of other extensions are never flagged;
empty and comment-only content, byte-order marks and CRLF are valid; a repeated
load of a file is reported once; a text that nests too deep to be parsed is neither
valid nor invalid, and counted apart; an empty table gives an empty result. The
work is one pass without a shuffle of contents; rates are counted by repository
and language after the loads of a file are made one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grammars
from .common import arrow_map, language_of_path, spread, table

_CONFLICT = re.compile(r"^(?:<{7}(?: |$)|={7}$|>{7}(?: |$)|\|{7}(?: |$))", re.M)
_BINARY = re.compile(r"[\x00-\x08\x0e-\x1a\x1c-\x1f�]")


def cause_of(language: str, text: str, at: int) -> str:
    """Why `text` fails at offset `at`."""
    line = text.rfind("\n", 0, at) + 1
    near = text[text.rfind("\n", 0, max(line - 1, 0)) + 1 : at + 200]
    if _CONFLICT.search(near) or (_CONFLICT.search(text) and text.count("<<<<<<<") and text.count(">>>>>>>")):
        return "conflict_markers"
    if _BINARY.search(text):
        return "binary_data"
    if not text[at:].strip():
        return "truncated"
    for other in ("python", "go", "rust", "typescript", "javascript"):
        if other != language and not (other == "javascript" and language in ("typescript", "tsx")):
            try:
                if grammars.failure(other, text) is None:
                    return "other_language"
            except grammars.TooDeep:
                continue
    return "syntax"


def judge(path: str | None, content: str | None) -> tuple[str, bool | None, int | None, int | None, str | None] | None:
    """(language, valid, failure offset, failure row, cause) of a source file, None for what is not judged; `valid` is None for a text nested too deep."""
    language = language_of_path(path)
    if language is None or content is None:
        return None
    try:
        at = grammars.failure(language, content)
    except grammars.TooDeep:
        return language, None, None, None, "too_deep"
    if at is None:
        return language, True, None, None, None
    return language, False, at, content.count("\n", 0, at), cause_of(language, content, at)


def judged(files: DataFrame) -> DataFrame:
    """(file_id, repo_id, language, valid, failed_at, failed_row, cause) of each load of a judged file."""

    def rows(cols: dict[str, list]) -> Iterator[tuple]:
        for fid, repo, path, content in zip(cols["file_id"], cols["repo_id"], cols["file_path"], cols["content"], strict=True):
            j = judge(path, content)
            if j is not None:
                yield (fid, repo, *j)

    schema = "file_id bigint, repo_id bigint, language string, valid boolean, failed_at int, failed_row int, cause string"
    return arrow_map(spread(files.select("file_id", "repo_id", "file_path", "content")), rows, schema)


def rates(verdicts: DataFrame) -> DataFrame:
    """(repo_id, language, files, invalid, rate, causes...) over the files of each repository and language."""
    one = verdicts.groupBy("file_id", "repo_id", "language").agg(F.min("valid").alias("valid"), F.min("cause").alias("cause"))
    causes = ("conflict_markers", "truncated", "other_language", "binary_data", "syntax", "too_deep")
    bad = F.coalesce(~F.col("valid"), F.lit(False))
    return one.groupBy("repo_id", "language").agg(
        F.count("*").alias("files"),
        F.sum(bad.cast("int")).cast("bigint").alias("invalid"),
        F.round(F.avg(bad.cast("double")), 6).alias("rate"),
        *(F.sum(F.when(F.col("cause") == c, 1).otherwise(0)).cast("bigint").alias(c) for c in causes),
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "file_sources")).where("not valid").select("file_id").distinct()


def p5_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "file_sources")).where("not valid").select("file_id", "language", "failed_at", "failed_row", "cause").distinct()


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(judged(table(spark, sf_dir, "file_sources")))


QUERIES = {"p5_found": p5_found, "p5_failures": p5_failures, "p5_rates": p5_rates}
ORACLES: dict[str, str] = {}
