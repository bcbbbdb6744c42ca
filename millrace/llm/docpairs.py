"""Problem 4: functions paired with their documentation.

Comment spans, docstring spans, function spans and barriers (the last row of a
run of statements or blank rows) are extracted from each file independently.
An as-of join over (file, row) gives each function the nearest comment that
ends above it and the nearest barrier above it; the comment is attached only if
no barrier lies between (attribute and decorator rows are no barriers). Python
docstrings attach where a function's body begins. Documentation without
substance is dropped.

Defined cases: null content and files in no known language give no spans; a
function of public_apis that the content does not declare, or an API row with
null name or file, gives no pair; repeated loads and repeated API rows give one
pair per symbol; an empty table gives an empty result. The join shuffles
spans, never contents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, language_of_path, materialize, spread, table

_LEX = {
    "python": re.compile(r"(?P<c>\#[^\n]*)|(?P<s>(?i:[rbuf]{0,2})(?:'''(?:\\.|[^\\])*?'''|\"\"\"(?:\\.|[^\\])*?\"\"\"|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"))", re.S),
    "rust": re.compile(r"(?P<c>//[^\n]*|/\*.*?\*/)|(?P<s>b?r(?P<q>\#*)\".*?\"(?P=q)|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\[^\n]+?|[^'\\\n])')", re.S),
    "go": re.compile(r"(?P<c>//[^\n]*|/\*.*?\*/)|(?P<s>`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\[^\n]+?|[^'\\\n])')", re.S),
    "js": re.compile(
        r"(?P<c>//[^\n]*|/\*.*?\*/)|(?P<s>(?:(?<=[=(,:!&|?{;\[\n])|(?<=[=(,:!&|?{;\[] )|(?<=return ))/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
        r"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\")",
        re.S,
    ),
}

_DECL = {
    "python": re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)", re.M),
    "rust": re.compile(r"^[ \t]*(?:pub(?:[ \t]*\([^)\n]*\))?[ \t]+)?(?:default[ \t]+)?(?:const[ \t]+)?(?:async[ \t]+)?(?:unsafe[ \t]+)?(?:extern(?:[ \t]+\S+)?[ \t]+)?fn[ \t]+(?:r\#)?(\w+)", re.M),
    "go": re.compile(r"^func[ \t]+(?:\([^)\n]*\)[ \t]*)?(\w+)[ \t]*[(\[]", re.M),
    "js": re.compile(
        r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<f>[\w$]+)"
        r"|^[ \t]*(?:export[ \t]+)?(?:const|let|var)[ \t]+(?P<v>[\w$]+)[ \t]*(?::[^=\n]+)?=[ \t]*(?:async\b[ \t]*)?(?=\(|function\b|[\w$]+[ \t]*=>|<)"
        r"|^[ \t]*(?:(?:public|private|protected|static|override|abstract|readonly|async|get|set)[ \t]+)*\*?[ \t]*(?P<m>\#?[\w$]+)[ \t]*\??(?:<[^>\n(]*>)?[ \t]*\((?=[^\n]*)",
        re.M,
    ),
}
_NOT_METHODS = frozenset("if for while switch catch return function await typeof new super with do else throw yield delete void in of import constructor".split())
_ATTRIBUTE = {"rust": ("#[", "#!["), "python": ("@",), "js": ("@",), "go": ()}


def _family(language: str) -> str:
    return language if language in ("python", "rust", "go") else "js"


_BODY = re.compile(r"\s*(?::[^;{}]*(?:\{[^{}]*\}[^;{}]*)?)?\{")
_ENDED = re.compile(r"[ \t]*(?:;|\n|\Z|\#)")


def _balanced(text: str, at: int) -> int:
    """Offset after the bracket that closes the one at `at`, or -1."""
    depth = 0
    for m in re.compile(r"[()\[\]{}]").finditer(text, at):
        depth += 1 if m.group() in "([{" else -1
        if depth == 0:
            return m.end()
    return -1


def spans_of(path: str | None, content: str | None) -> list[tuple]:
    """Events of a file: (kind, row, first_row, name, text, body_row).

    Kinds: comment and docstring (`row` is the last row of a comment, the first
    of a docstring), barrier, function (`row` is its declaration).
    """
    language = language_of_path(path)
    if language is None or not content:
        return []
    fam = _family(language)
    text = content.lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    comments: list[tuple[int, int, str]] = []
    blank = []  # the text with comments and strings blanked, row structure kept
    at = 0
    strings: dict[int, tuple[int, str]] = {}
    for m in _LEX[fam].finditer(text):
        blank.append(text[at : m.start()])
        piece = m.group()
        fill = " " if m.group("c") is not None else "~"
        blank.append(re.sub(r"[^\n]", fill, piece))
        at = m.end()
        if m.group("c") is not None:
            comments.append((m.start(), m.end(), piece))
        elif fam == "python":
            strings[m.start()] = (m.end(), piece)
    blank.append(text[at:])
    code = "".join(blank)
    starts = [0] + [m.end() for m in re.finditer("\n", text)]

    def row(p: int) -> int:
        import bisect

        return bisect.bisect_right(starts, p) - 1

    code_rows = code.split("\n")
    raw_rows = text.split("\n")
    n = len(code_rows)
    kind = ["code" if code_rows[r].strip() else "blank" if not raw_rows[r].strip() else "comment" for r in range(n)]
    out: list[tuple] = []
    # comments that stand alone on their rows; adjacent ones make one span
    block: list | None = None
    for a, b, piece in comments:
        ra, rb = row(a), row(b)
        if any(kind[r] == "code" for r in range(ra, rb + 1)):
            continue
        for r in range(ra, rb + 1):  # a blank row inside a block comment belongs to it
            kind[r] = "comment"
        if block and ra <= block[1] + 1:
            block[1] = rb
            block[2] += "\n" + piece
        else:
            if block:
                out.append(("comment", block[1], block[0], None, block[2], None))
            block = [ra, rb, piece]
    if block:
        out.append(("comment", block[1], block[0], None, block[2], None))
    # attribute rows, with their continuations
    marks = _ATTRIBUTE[fam]
    r = 0
    while marks and r < n:
        s = code_rows[r].lstrip()
        if kind[r] == "code" and s.startswith(marks):
            p = starts[r] + len(code_rows[r]) - len(s)
            nxt = re.compile(r"[(\[]").search(code, p)
            end = p
            if nxt and row(nxt.start()) == r and (fam == "rust" or nxt.group() == "("):
                end = _balanced(code, nxt.start())
            last = row(end - 1) if end > p else r
            rest = code[end : starts[last + 1] - 1 if last + 1 < n else len(code)] if end > p else ""
            if not rest.strip():
                for k in range(r, last + 1):
                    kind[k] = "attribute"
                r = last
        r += 1
    # functions
    found = []
    for m in _DECL[fam].finditer(code):
        name = m.group(m.lastgroup) if fam == "js" else m.group(1)
        if fam == "js" and m.lastgroup == "m":
            if name in _NOT_METHODS:
                continue
            open_at = code.index("(", m.start("m"))
            close = _balanced(code, open_at)
            if close < 0 or not _BODY.match(code, close):
                continue
        r = row(m.start() + len(m.group()) - len(m.group().lstrip()))
        body = None
        if fam == "python":
            open_at = code.find("(", m.end())
            close = _balanced(code, open_at) if open_at >= 0 else -1
            colon = code.find(":", close) if close > 0 else -1
            while colon > 0 and code[close:colon].count("[") > code[close:colon].count("]"):
                colon = code.find(":", colon + 1)
            if colon > 0:
                p = re.compile(r"[ \t]*\n?(?:[ \t]*\n)*[ \t]*").match(code, colon + 1).end()
                while p < len(code) and code[p : p + 1] == " " or code[p : p + 1] == "\n":
                    p += 1
                if p in strings:
                    end, piece = strings[p]
                    if _ENDED.match(text, end) and not re.match(r"(?i)[rbuf]*[bf]", re.match(r"\w*", piece).group() or "-"):
                        body = row(p)
                        out.append(("docstring", body, body, name, piece, None))
        opening = code.find("(", m.end() - 1)
        after = _balanced(code, opening) if opening >= 0 else -1
        ending = re.compile(r"[{;]|\n").search(code, after) if after > 0 else None
        signature = re.sub(r"\s+", "", text[starts[r] : ending.start() if ending else starts[r] + len(code_rows[r])])
        found.append((r, name, body, signature))
    declared = {r for r, *_ in found}
    for r in range(n):
        if kind[r] in ("code", "blank"):
            nxt = kind[r + 1] if r + 1 < n else "end"
            if nxt in ("comment", "attribute") or (r + 1) in declared:
                out.append(("barrier", r, r, None, None, None))
    out.extend(("function", r, r, name, signature, body) for r, name, body, signature in found)
    return out


_EVENT = "file_id bigint, kind string, row int, first_row int, name string, text string, body_row int"


def events(files: DataFrame) -> DataFrame:
    """All spans of all loads of files."""

    def rows(cols: dict[str, list]) -> Iterator[tuple]:
        for fid, path, content in zip(cols["file_id"], cols["file_path"], cols["content"], strict=True):
            if fid is not None:
                for kind, r, first, name, text, body in spans_of(path, content):
                    yield fid, kind, r, first, name, text, body

    return arrow_map(spread(files.select("file_id", "file_path", "content")), rows, _EVENT)


def attach(spans: DataFrame) -> DataFrame:
    """(file_id, name, row, signature, comment, docstring) of every function, by the as-of join of its spans."""
    w = Window.partitionBy("file_id").orderBy("row", "rank").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.when(F.col("kind") == "function", 0).otherwise(1)  # what shares a function's row comes after it
    line = spans.where("kind <> 'docstring'").withColumn("rank", rank)
    comment = F.last(F.when(F.col("kind") == "comment", F.struct("first_row", "row", "text")), ignorenulls=True).over(w)
    barrier = F.last(F.when(F.col("kind") == "barrier", F.col("row")), ignorenulls=True).over(w)
    asof = line.withColumn("c", comment).withColumn("b", barrier).where("kind = 'function'")
    free = F.col("c").isNotNull() & (F.col("c.row") < F.col("row")) & (F.col("b").isNull() | (F.col("b") < F.col("c.first_row")))
    asof = asof.select("file_id", "name", "row", F.col("text").alias("signature"), "body_row", F.when(free, F.col("c.text")).alias("comment"))
    docs = spans.where("kind = 'docstring'").groupBy("file_id", F.col("row").alias("body_row")).agg(F.first("text").alias("docstring"))
    return asof.join(docs, ["file_id", "body_row"], "left").drop("body_row")


# -- substance ------------------------------------------------------------------

_DIRECTIVE = re.compile(
    r"^@?(?:eslint|tslint|prettier|biome|jshint|jslint|istanbul|c8|v8|stylelint|cspell|spell-?checker|codespell|nolint|noqa|nosec|nosonar|pylint|flake8|mypy|pyright|isort|ruff|black|bandit|yapf|pragma|type:\s*ignore|fmt:|"
    r"ts-(?:ignore|nocheck|expect-error|check)|rustfmt|clippy|allow\(|deny\(|go:|lint:|\+build|line |region|endregion|#region|vim?:|coding[:=]|-\*-|sonar|coverage:|webpack|jsx|flow|swc|vite|noinspection|checkstyle|suppress|cppcheck|clang-format|doctest:|skipcq|deepcode|hadolint|shellcheck|markdownlint|language=)",
    re.I,
)
_PLACEHOLDER = re.compile(
    r"^(?:todo|fixme|xxx|tbd|hack|wip|n/?a|none|nil|null|pass|\.{2,}|…|-+|\?+|desc(?:ription)?|summary|docs?|docstring|documentation|placeholder|lorem ipsum.*|stub|undocumented|missing|empty|comment|"
    r"(?:no|missing|add|write|insert|needs?|fill in|put)\s+(?:the\s+|a\s+|some\s+|your\s+)?(?:desc(?:ription)?|docs?|documentation|docstring|comment|summary|text)(?:\s+(?:yet|here|available|needed|provided|given|later|to follow))*|"
    r"(?:description|documentation|docs?)\s+(?:here|goes here|missing|pending|to follow|tbd|todo|needed|yet to come)|to be (?:documented|done|written|added)|coming soon|document (?:this|me)(?:\s+\w+)?|short description|type_description_?|_?summary_?|_?description_?|same as above|see above)\s*[.:!]*$",
    re.I,
)
_TODO = re.compile(r"^(?:@?todo|fixme|xxx|tbd|hack)\b", re.I)
_TAG = re.compile(r"^(?:[@\\](?P<t>[A-Za-z][\w-]*)|:(?P<f>\w+)(?:\s+[\w*.]+)*:)\s*(?P<rest>.*)$")
_META = re.compile(r"^(?:authors?|since|version|date|created(?: by)?|modified(?: by)?|last modified|copyright|licen[cs]e|owner|maintainer|file|module|package|signed-off-by|reviewed-by|ticket|jira|see)\s*[:=]\s*\S.*$", re.I)
_PARAM_TAGS = frozenset("param arg argument property prop typeparam template throws throw exception raises return returns yields".split())
_SECTION = re.compile(r"^(?:#+\s*)?(?:args?|arguments|parameters?|params|returns?|yields?|raises?|throws?|errors?|examples?|panics?|safety|notes?|see also|attributes|type parameters)\s*:?$", re.I)
_CODE = re.compile(
    r"^(?:(?:let|const|var|auto|int|return|if|elif|else|for|while|import|from|use|def|fn|func|function|class|struct|impl|pub|public|private|static|await|yield|raise|throw|assert|print|del|with|try|except|catch|switch|case|break|continue|defer|go|type|package)\b.*(?:[;{}=]|\)\s*[:;{]?|:)\s*$"
    r"|[\w.$\[\]\"']+(?:\s*,\s*[\w.$]+)*\s*(?::=|[-+*/|&%]?=(?!=)|\+\+|--)\s*\S.*$|[\w.$:]+\(.*\)\s*[;?{]*$|.*[;{]\s*$|[})\];,]+\s*$|@\w+(?:\(.*\))$|<<\w+|>>>|\$ .*)"
)
_FILLER = frozenset(
    "a an the this that these those it its is are be been was will shall can may does do did done of for to from by in on at as and or with into onto over per via method function func fn routine procedure helper utility implementation implements implement handles handle handler performs perform executes execute runs run "
    "call calls called which given specified some any all new our your their simply just basic main default private public internal operation used use uses here code class object struct value values".split()
)


def _lines(comment: str) -> list[str]:
    """Text lines of a comment or docstring without their marks."""
    c = comment
    m = re.match(r"(?i)[rbuf]{0,2}('''|\"\"\"|'|\")", c.strip())
    if m and c.strip().endswith(m.group(1)) and not c.lstrip().startswith(("//", "#", "/*")):
        s = c.strip()
        c = s[m.end() : -len(m.group(1))] if len(s) >= m.end() + len(m.group(1)) else ""
        rows = c.split("\n")
    else:
        rows = []
        for line in c.split("\n"):
            s = line.strip()
            s = re.sub(r"^(?:/\*[*!]*|//[/!]*|\#[!:]*(?!\[)|\*+/?)", "", s) if not s.startswith("*/") else ""
            s = re.sub(r"\*+/$", "", s)
            rows.append(s)
    return [re.sub(r"</?[A-Za-z][^<>]*>", " ", r).strip() for r in rows]


def _stem(w: str) -> str:
    w = w.lower()
    for end, put in (("ies", "y"), ("ied", "y"), ("sses", "ss"), ("ing", ""), ("ed", ""), ("es", ""), ("s", "")):
        if w.endswith(end) and len(w) - len(end) >= 2:
            w = w[: -len(end)] + put
            break
    if len(w) > 3 and w[-1] == w[-2]:
        w = w[:-1]
    return w[:-1] if len(w) > 3 and w[-1] == "e" else w


_FILLER_STEMS = frozenset(_stem(f) for f in _FILLER)


def _words(s: str) -> list[str]:
    return re.findall(r"[^\W\d_]+|\d+", re.sub(r"([a-z\d])([A-Z])", r"\1 \2", s))


def substance(name: str | None, comment: str | None) -> bool:
    """Whether documentation says more than its function's name."""
    if not comment:
        return False
    own = {_stem(w) for w in _words(name or "")}
    short = (name or "").lower()
    in_code = False
    kept: list[str] = []
    for raw in _lines(comment):
        line = raw.strip()
        if line.startswith(("```", "~~~")):
            in_code = not in_code
            continue
        if in_code:
            continue
        line = re.sub(r"^[-*•+>]\s+", "", line)
        if short and line.lower().startswith(short) and not re.match(r"[\w(]", line[len(short) :]):  # Go: the comment opens with the name
            line = line[len(short) :].lstrip(" :,-–—")
        line = re.sub(r"^(?:\w+\s*)?[-=~#*_]{3,}\s*", "", re.sub(r"\s*[-=~#*_]{3,}$", "", line)) if re.search(r"[-=~#*_]{3,}", line) else line
        if not re.search(r"\w", line) or _DIRECTIVE.match(line) or _PLACEHOLDER.match(line.strip(" *_`'\"()[]<>")) or _TODO.match(line) or _META.match(line) or _SECTION.match(line):
            continue
        tag = _TAG.match(line)
        if tag:
            t = (tag.group("t") or tag.group("f") or "").lower()
            rest = tag.group("rest")
            rest = re.sub(r"^\{[^{}]*\}\s*", "", rest)
            if t in ("param", "arg", "argument", "property", "prop", "typeparam", "template") and tag.group("t"):
                rest = re.sub(r"^\[?[\w.$=]+\]?\s*[-:–]?\s*", "", rest)
            if t in _PARAM_TAGS or t in ("description", "desc", "summary", "brief", "remarks", "note", "deprecated", "details"):
                if len(re.findall(r"[^\W\d_]{2,}", rest)) >= 2 and not _PLACEHOLDER.match(rest):
                    kept.append(rest)
            continue
        if _CODE.match(line) and not re.search(r"[a-z]{2,}[.!?]$", line):
            continue
        kept.append(line)
    words = [w for line in kept for w in _words(line)]
    left = [w for w in words if not w.isdigit() and w.lower() not in _FILLER and _stem(w) not in own and _stem(w) not in _FILLER_STEMS]
    return bool(left)


def documented(files: DataFrame, apis: DataFrame) -> DataFrame:
    """(symbol_id, name, kind, signature, documentation) of functions and methods whose source documents them."""
    wanted = apis.where("kind in ('Function', 'Method') and name is not null and file_id is not null and symbol_id is not null").select("symbol_id", "file_id", "name", "kind", "signature")
    wanted = wanted.groupBy("symbol_id", "file_id", "name", "kind").agg(F.max("signature").alias("signature"))
    # written once, read for the comments and for the docstrings; the spans of repeated loads are equal and do no harm
    spans = materialize(events(files))
    pairs = attach(spans).withColumnRenamed("signature", "declared")
    joined = wanted.join(pairs, ["file_id", "name"])
    # of several functions of one name, the one declared as the row's signature says
    same = F.col("declared").contains(F.regexp_replace("signature", r"\s+", ""))
    best = Window.partitionBy("symbol_id").orderBy(F.coalesce(same, F.lit(False)).desc(), "row")
    one = joined.withColumn("n", F.row_number().over(best)).where("n = 1 and (comment is not null or docstring is not null)")

    @F.pandas_udf("boolean")
    def says(name, comment, docstring):  # noqa: ANN001, ANN202 - pandas series
        import pandas as pd

        return pd.Series([substance(a, b) or substance(a, c) for a, b, c in zip(name, comment, docstring, strict=True)], dtype=bool)

    text = F.concat_ws("\n", "comment", "docstring")
    return one.where(says("name", "comment", "docstring")).select("symbol_id", "name", "kind", "signature", text.alias("documentation"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented(table(spark, sf_dir, "file_sources"), table(spark, sf_dir, "public_apis")).select("symbol_id")


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented(table(spark, sf_dir, "file_sources"), table(spark, sf_dir, "public_apis"))


QUERIES = {"p4_found": p4_found, "p4_pairs": p4_pairs}
ORACLES: dict[str, str] = {}
