"""Problem 3: generated, minified, vendored and data-only source files.

Every source file becomes the set of its five-token shingles with identifiers
and literals masked. Files of one set are one class; classes are grouped by
MinHash banding and every link is verified by the Jaccard similarity of the
whole sets (0.8 or more). The resulting families carry the evidence: what their
members declare about themselves (generator and licence notices, folders of
third-party code), how they spread within and over repositories, how much they
repeat themselves, and whether anything but literals is in them. A family whose
members are declared generated marks its silent members, one that is declared
or copied over repositories (the same names and literals in the same form) is
vendored, a literal-only one is data, and minified text shows in its own shape.

Defined cases: null content and other extensions are no cases; empty and
comment-only files are hand-written; a repeated load counts once; files without
a repository count as of none; an empty table gives an empty result. Scale:
contents are read once; sizes and parities of distinct classes go through the
buckets, shingle sets only of those that these don't rule out; a bucket of any
size is a sorted stream whose linked classes are not compared again.
"""

from __future__ import annotations

import itertools
import os
import re
import tempfile
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import language_of_path, materialize, spread, table
from .leakage import _PRIME

#: Tokens of a shingle, similarity of a family, MinHash bands and rows of a band.
SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 16, 4
#: How far below the similarity an estimate may lie for the pair to be verified.
SLACK = 0.2
#: Bytes of the shingle sets of one bucket that stay in memory.
SPOOL = 64 << 20
#: Places of the parities that go through the buckets, rows of a small bucket, comparisons of a tile.
PLACES, SMALL, TILE = 512, 64, 64 * 1024
#: Share of distinct shingles below which a text repeats itself; share of literal tokens from which it is data.
REPEATING, LITERAL = 0.2, 0.85
#: Least tokens of a repeating family member, least characters of a body of data and of a minified text.
FAMILY_TOKENS, DATA_CHARS, MINIFIED_CHARS = 40, 600, 200
#: Share of declared members from which a family passes its declaration on.
DECLARED = 0.3
#: Least tokens of a copy that was changed, share of its names and literals that copies elsewhere must have: the
#: masked form alone is shared by chance between short or stereotyped files.
COPY_TOKENS, COPIED = 80, 0.75

_MULTIPLIERS = np.array([xxhash.xxh64_intdigest(f"row {j}") | 1 for j in range(BANDS * ROWS)], dtype=np.uint64)

_LEX = {
    "python": r"(?:\#[^\n]*)|(?:(?i:[rbuf]{0,2})(?:'''(?:\\.|[^\\])*?'''|\"\"\"(?:\\.|[^\\])*?\"\"\"|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"))",
    "rust": r"(?://[^\n]*|/\*.*?\*/)|(?:b?r(?P<q>\#*)\".*?\"(?P=q)|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\[^\n]+?|[^'\\\n])')",
    "go": r"(?://[^\n]*|/\*.*?\*/)|(?:`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\[^\n]+?|[^'\\\n])')",
    "js": r"(?://[^\n]*|/\*.*?\*/)|(?:(?:(?<=[=(,:!&|?{;\[\n])|(?<=[=(,:!&|?{;\[] )|(?<=return ))/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\")",
}
#: Words at whose start no literal can begin, tried before the literals.
_PLAIN = {"python": r"(?![rbufRBUF]{1,2}['\"])[^\W\d][\w$]*", "rust": r"(?!b?r?\#*[\"'])[^\W\d][\w$]*", "go": r"[^\W\d][\w$]*", "js": r"[^\W\d][\w$]*"}
#: One token and the space before it. Most tokens are words and marks that open neither literal nor comment: these come first.
_TOKEN = {k: re.compile(rf"\s*+(?P<t>{_PLAIN[k.split()[-1]]}|\$[\w$]*|[^\s\w/\#'\"`]|{v}|\b\d[\w.]*|[^\W\d][\w$]*|[^\s\w])", re.S) for k, v in {**_LEX, "plain rust": _LEX["rust"].replace(r"(?P<q>\#*)", "").replace("(?P=q)", "")}.items()}
_KEYWORDS = frozenset(
    "fn pub let mut if else for in return use impl struct enum while loop match func package import type var const def class self this None True False null true false function range export async await default new try catch except finally switch case from as interface defer go chan map static mod trait where unsafe break continue raise with yield lambda pass del throw typeof void do not and or is super crate".split()
)
_SEPARATORS = frozenset("[](){},:;=-+&")

_GENERATED = re.compile(
    r"@generated\b|<auto-?generated|\bauto(?:matically)?[- ]?generated\b|\bcode generated (?:by|from)\b|\b(?:generated|produced|created|built|compiled|written|emitted) (?:automatically )?(?:by|with|from|using) (?!hand\b|the team\b|people\b)\S"
    r"|\bautomatically (?:created|produced|written|built)\b|\bmachine[- ](?:written|generated|made)\b|\bemitted (?:artifact|file|code|output)\b|\b(?:changes|edits|modifications) (?:are|will be|get) (?:lost|overwritten)"
    r"|\bdo not (?:edit|modify|change|touch)\b(?: this file)?(?:[.;!,]|\s*$|\s+(?:by hand|manually|directly|it)\b)|\bautomatisch (?:erzeugt|erstellt|generiert)|\bnicht (?:von hand )?(?:bearbeiten|ändern|editieren)\b"
    r"|\b(?:produit|généré|créé)e?s? (?:automatiquement )?par\b|\bne pas (?:modifier|éditer|toucher)\b|\b(?:generad|cread|producid)[oa] (?:automáticamente )?(?:por|con)\b|\bno (?:editar|modificar)\b|\bgenerat(?:o|a) (?:automaticamente )?da\b",
    re.I,
)
_BY_HAND = re.compile(
    r"\b(?:(?:ported|written|maintained|kept|edited|tuned|made) by hand|hand-?written|used to (?:ship|be)|replaces? the|instead of the|live[s]? in|lie[s]? in|not here|no longer|without (?:asking|talking|approval|review)|ported|rewritten|design notes|was once|were once)\b", re.I
)
_SOURCE = re.compile(r"^(?:source|input|template|schema|from)\s*:\s*\S+\.(?:proto|gql|graphql|ya?ml|json|tmpl|tpl|idl|thrift|avsc|xsd|wsdl|sql|g4|y|l|fbs|capnp|jinja2?|j2|mustache)\b", re.I)
_TOOL_VERSION = re.compile(r"^[\w.-]+ v?\d+\.\d+(?:\.\d+)?$")
_VENDORED = re.compile(
    r"\bcopyright (?:its|the respective|their) (?:authors?|owners?|contributors?)\b|\bvendored (?:from|copy)\b|\bbundled (?:copy|version) of\b|\bcopied (?:verbatim|unchanged|as is) from\b|\bverbatim copy of\b|\bupstream\s*:\s*\S|\bimported, keep in sync\b"
    r"|\bdistributed with this project\b|\bsee its own licen[cs]e\b|\bthird[- ]party (?:code|library|source|copy)\b|\blicen[cs]e:? permissive\b|\bfree licen[cs]e\b|^/?\*?!.*\bv?\d+\.\d+\.\d+\b.*\blicen[cs]e"
    r"|\b(?:MIT|BSD|Apache|ISC|MPL|zlib)\b.{0,20}\blicen[cs]e\b.{0,80}\bcopyright \(c\)",
    re.I,
)
#: Folders whose content is somebody else's or a tool's by convention (fixed values).
_VENDOR_FOLDERS = frozenset("vendor _vendor vendored third_party third-party thirdparty 3rdparty node_modules bower_components jspm_packages external extern externals deps site-packages dist-packages godeps pods carthage".split())
_GENERATED_FOLDERS = frozenset("generated gen __generated__ autogen codegen_out".split())
_GENERATED_NAME = re.compile(r"(?:_pb2(?:_grpc)?\.py|\.pb(?:\.gw)?\.go|_generated\.\w+|\.generated\.\w+|\.g\.(?:ts|tsx|js)|\.gen\.\w+|_gen\.go|_string\.go|\.designer\.\w+)$", re.I)
_MINIFIED_NAME = re.compile(r"(?:[.-]min|\.bundle|\.chunk|\.packed)\.(?:js|ts|css|mjs)$", re.I)


#: Kinds of tokens.
_COMMENT, _STRING, _NUMBER, _NAME, _KEYWORD, _SEPARATOR, _OTHER = range(7)
#: Distinct tokens of a language that a process keeps, characters of one that is kept.
VOCABULARY, KEPT_CHARS = 200_000, 200


class _Vocabulary(dict):
    """The number of each token of a language; by these numbers what is told of it: kind and length, hash as masked and as written."""

    def __init__(self, python: bool) -> None:
        self.python = python
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.told, self.masked, self.written = array("q"), array("Q"), array("Q")

    def kind(self, t: str) -> int:
        if t[0] == "#" if self.python else t[:2] in ("//", "/*"):
            return _COMMENT
        if len(t) > 1 and (t[-1] in "'\"`#" or t[0] == "/"):
            return _STRING
        if t[0].isdecimal():
            return _NUMBER
        if t[0].isalnum() or t[0] in "_$":
            return _KEYWORD if t in _KEYWORDS else _NAME
        return _SEPARATOR if t in _SEPARATORS else _OTHER

    def __missing__(self, t: str) -> int:
        kind, number = self.kind(t), len(self.told)
        self.told.append(len(t) << 3 | kind)
        self.masked.append(xxhash.xxh64_intdigest({_STRING: "S", _NUMBER: "0", _NAME: "I", _COMMENT: ""}.get(kind, t)))
        self.written.append(xxhash.xxh64_intdigest(t) if _STRING <= kind <= _NAME else 0)
        if len(t) <= KEPT_CHARS:
            self[t] = number
        return number


_vocabularies = {k: _Vocabulary(k == "python") for k in _LEX}


def _header(comments: list[str]) -> list[str]:
    """Lines of the comments before the first code."""
    out = []
    for c in comments:
        for line in c.split("\n"):
            s = re.sub(r"^\s*(?:/\*+!?|//+!?|\#+!?|\*+/?)|\*/\s*$", "", line).strip()
            if s:
                out.append(s)
    return out


def declared(header: list[str]) -> tuple[bool, bool]:
    """(generated, vendored) as the opening comments say."""
    generated = vendored = False
    source = any(_SOURCE.match(x) for x in header)
    for x in header:
        if _BY_HAND.search(x):
            continue
        if _GENERATED.search(x) or (source and _TOOL_VERSION.match(x)) or re.match(r"source: \S+\.proto, line \d+$", x):
            generated = True
        if _VENDORED.search(x):
            vendored = True
    return generated, vendored


def evidence(path: str, content: str) -> dict | None:
    """Shingles and evidence of one source file; None for what is no source file."""
    language = language_of_path(path)
    if language is None:
        return None
    fam = language if language in _TOKEN else "js"
    text = content.lstrip("\ufeff").replace("\r\n", "\n")
    vocabulary = _vocabularies[fam]
    if len(vocabulary.told) > VOCABULARY:
        vocabulary.empty()
    # the space at the end belongs to no token
    pattern = _TOKEN["plain rust" if fam == "rust" and "r#" not in text else fam]
    written = tokens = [m["t"] for m in pattern.finditer(text.rstrip())] if pattern.groups > 1 else pattern.findall(text.rstrip())
    ids = np.fromiter(map(vocabulary.__getitem__, written), dtype=np.int64, count=len(written))
    told = np.frombuffer(vocabulary.told, dtype=np.int64)[ids] if written else ids
    comment = told & 7 == _COMMENT
    comment_chars = int((told[comment] >> 3).sum())
    header = _header(written[: int(np.argmin(comment))] if not comment.all() else written)
    if comment_chars:
        written = list(itertools.compress(written, (~comment).tolist()))
        ids, told = ids[~comment], told[~comment]
    kind, n = told & 7, len(written)
    count = np.bincount(kind, minlength=7).tolist()
    literal_tokens = count[_STRING] + count[_NUMBER]
    other_tokens = n - literal_tokens - count[_SEPARATOR]
    literal_chars = int((told[(kind == _STRING) | (kind == _NUMBER)] >> 3).sum())
    names, short = count[_NAME], int(((kind == _NAME) & (told >> 3 <= 3)).sum())
    # a text shorter than a shingle is one shingle of its own
    h = rolled(np.frombuffer(vocabulary.masked, dtype=np.uint64)[ids], min(SHINGLE, n)) if n else np.zeros(0, dtype=np.uint64)
    h.sort()
    h = h[np.diff(h, prepend=~h[:1]) != 0]
    generated, vendored = declared(header)
    folders = [x.lower() for x in (path or "").replace("\\", "/").split("/")[:-1]]
    base = (path or "").rsplit("/", 1)[-1]
    rest = len(text) - comment_chars
    lines = max(text.count("\n") + (not text.endswith("\n")), 1)
    dense = False
    if len(text) / lines > 120 and names > 10 and short / names > 0.5:
        gone = [t for t in tokens if vocabulary.kind(t) <= _STRING]
        chars = len(text) - sum(map(len, gone))
        dense = chars > MINIFIED_CHARS and sum(map(len, text.split())) - sum(len(x) for t in gone for x in t.split()) > 0.9 * chars
    return {
        "hashes": h,
        "n_tokens": n,
        "generated": generated or bool(set(folders) & _GENERATED_FOLDERS),
        "named_generated": bool(_GENERATED_NAME.search(base)),
        "vendored": vendored or bool(set(folders) & _VENDOR_FOLDERS),
        "minified": dense or (bool(_MINIFIED_NAME.search(base)) and len(text) / lines > 120),
        "literal": literal_tokens > 0 and literal_chars >= min(DATA_CHARS, rest) * 0.3 and rest >= DATA_CHARS
        and (literal_tokens / max(literal_tokens + other_tokens, 1) >= LITERAL or literal_chars >= LITERAL * rest),
        "repeating": n >= FAMILY_TOKENS and len(h) / n <= REPEATING,
        "raw": xxhash.xxh64_intdigest("\0".join(written)) if n >= FAMILY_TOKENS else None,
        "names": np.unique(np.frombuffer(vocabulary.written, dtype=np.uint64)[ids[(kind >= _STRING) & (kind <= _NAME)]]) if n >= COPY_TOKENS else np.zeros(0, dtype=np.uint64),
    }


def rolled(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-token shingles in order, from the tokens' hashes."""
    h = np.zeros(len(w) - k + 1, dtype=np.uint64)
    for j in range(k):
        h = (h ^ w[j : j + len(h)]) * _PRIME[j % 3]
        h ^= h >> np.uint64(29)
    return h


def signature(h: np.ndarray) -> np.ndarray:
    """MinHash values of a shingle set, high halves."""
    least = (h[:4096, None] * _MULTIPLIERS).min(axis=0)
    for at in range(4096, len(h), 4096):
        least = np.minimum(least, (h[at : at + 4096, None] * _MULTIPLIERS).min(axis=0))
    return least >> np.uint64(32)


def band_keys(sig: np.ndarray) -> list[int]:
    """One key per band, the band's number within it."""
    rows = sig.astype(np.uint32).tobytes()
    return np.array([xxhash.xxh64_intdigest(rows[4 * ROWS * j : 4 * ROWS * (j + 1)], seed=j) for j in range(BANDS)], dtype=np.uint64).view(np.int64).tolist()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


_FILES = (
    "file_id bigint, repo_id bigint, class bigint, n_tokens int, generated boolean, named_generated boolean, vendored boolean, minified boolean, literal boolean, repeating boolean, raw bigint, "
    "names array<bigint>, hashes array<bigint>, sig array<int>, bands array<bigint>"
)
_LISTS = {"names": np.int64, "hashes": np.int64, "sig": np.int32, "bands": np.int64}


def _arrays(found: list[np.ndarray], dtype: type, as_type: pa.DataType) -> pa.Array:
    """A list column of numpy arrays, without a Python object per element."""
    flat = np.concatenate([np.zeros(0, dtype=dtype), *(x.view(dtype) for x in found)])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(flat), type=as_type)


def described(files: DataFrame) -> DataFrame:
    """Evidence, class and shingles of every source file; written to the shared folder."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(_FILES))
    none = np.zeros(0, dtype=np.uint64)

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_arrays([r[f.name] for r in rows], _LISTS[f.name], f.type) if f.name in _LISTS else pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[dict] = []
            for fid, repo, path, content in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                e = None if content is None or fid is None else evidence(path or "", content)
                if e is None:
                    continue
                h = e["hashes"]
                e |= {"file_id": fid, "repo_id": repo, "class": None, "sig": none, "bands": none, "raw": None if e["raw"] is None else _signed(e["raw"])}
                if len(h):
                    sig = signature(h)
                    e |= {"class": _signed(xxhash.xxh64_intdigest(h.tobytes())), "sig": sig.astype(np.uint32), "bands": np.array(band_keys(sig))}
                out.append(e)
                if len(out) >= 2000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    return materialize(spread(files.select("file_id", "repo_id", "file_path", "content")).mapInArrow(run, _FILES))


def parities(h: np.ndarray, places: int) -> np.ndarray:
    """Whether an odd number of the hashes falls on each of so many places, packed. Two sets differ
    in at least as many hashes as these bits differ, so it rules pairs out without their sets."""
    return np.packbits((np.bincount((h & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1).astype(np.uint8)).view(np.uint64)


def _folded(odd: np.ndarray, words: int) -> np.ndarray:
    """Parities on fewer places: each bit of the result holds those of several places."""
    return np.bitwise_xor.reduce(odd.reshape(len(odd), -1, words), axis=1)


def _differing(n: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    """The most hashes in which sets of n and m hashes differ that are similar."""
    return (1 - SIMILARITY) / (1 + SIMILARITY) * (n + m) + 1e-6


def near_pairs(key: np.ndarray, n: np.ndarray, odd: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j), j before i, of one key that neither sizes nor parities rule out; rows are sorted by key and size.

    None is left out that is similar. Rows of a small bucket are compared at all distances at once, those
    of a large one in tiles, on folded parities first; only sizes that allow the similarity meet.
    """
    if not len(key):
        return
    start = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    size = np.diff(start, append=len(key))
    end = np.repeat(start + size, size)

    def kept(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = np.bitwise_count(odd[i] ^ odd[j]).sum(axis=1) <= _differing(n[i], n[j])
        return i[ok], j[ok]

    j = np.flatnonzero(np.repeat(size <= SMALL, size))
    for d in range(1, SMALL):
        j = j[j + d < end[j]]
        j = j[n[j] >= SIMILARITY * n[j + d] - 1e-6]
        if not len(j):
            break
        yield kept(j + d, j)
    words = odd.shape[1]
    xor, ones, total = np.zeros(TILE, dtype=np.uint64), np.zeros(TILE, dtype=np.uint8), np.zeros(TILE, dtype=np.uint8)
    for s, m in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        sizes, folds = n[s : s + m], {}
        for a in range(0, m, 64):
            b = min(a + 64, m)
            # so few places that they are soon compared, so many that not all are odd by chance
            w = next((x for x in (2, 4, 8) if x < words and 64 * x >= (1 + (x < 4)) * sizes[b - 1]), words)
            if w not in folds:
                folds[w] = np.ascontiguousarray(_folded(odd[s : s + m], w).T)
            f = folds[w]
            for t in range(int(np.searchsorted(sizes, SIMILARITY * sizes[a] - 1e-6)), b, TILE // 64):
                u = min(t + TILE // 64, b)
                shape, k = (b - a, u - t), (b - a) * (u - t)
                x, c, differ = xor[:k].reshape(shape), ones[:k].reshape(shape), total[:k].reshape(shape)
                np.bitwise_count(np.bitwise_xor(f[0, a:b, None], f[0, None, t:u], out=x), out=differ)
                for q in range(1, w):
                    # beyond 255 it begins anew, which keeps a pair for the second look
                    np.add(differ, np.bitwise_count(np.bitwise_xor(f[q, a:b, None], f[q, None, t:u], out=x), out=c), out=differ)
                at = np.flatnonzero(differ <= min(int(_differing(sizes[b - 1], sizes[u - 1])), 255))
                i, j = at // (u - t) + a, at % (u - t) + t
                yield kept(i[j < i] + s, j[j < i] + s)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, sorted by their first column, cut at their last key; None where a key ends."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(0).to_numpy()
        cut = int(np.searchsorted(k, k[-1]))
        if cut:
            yield b.slice(0, cut)
        if last is not None and k[-1] != last:
            yield None
        yield b.slice(cut)
        last = k[-1]
    yield None


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and parities of each class (class, hashes, bands)."""
    for b in batches:
        hashes = b.column(1)
        odd = [parities(hashes[i].values.to_numpy().view(np.uint64), PLACES).tobytes() for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column(0), hashes.value_lengths(), pa.array(odd, pa.binary()), b.column(2)], names=["class", "n", "odd", "bands"])


def _resembling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, n, class, odd) arrive sorted by key and n; (key, class) of those leave that may have a similar one in their bucket."""
    parts: list[tuple] = []
    for b in _pieces(batches):
        if b is not None:
            odd = np.frombuffer(b"".join(b.column(3).to_pylist()), dtype=np.uint64).reshape(b.num_rows, -1)
            parts.append((*(b.column(i).to_numpy() for i in range(3)), odd))
        elif parts:
            key, n, cls, odd = (np.concatenate(x) for x in zip(*parts, strict=True))
            near, parts = np.zeros(len(key), dtype=bool), []
            for i, j in near_pairs(key, n, odd):
                near[i] = near[j] = True
            if near.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[near]), pa.array(cls[near])], names=["key", "class"])


class _Linkage:
    """Single linkage at SIMILARITY over the rows of some buckets: what is linked already is not compared again. `sets` has the shingle sets, at `where`."""

    def __init__(self, cls: np.ndarray, sig: np.ndarray, n: np.ndarray, where: np.ndarray, sets: tempfile.SpooledTemporaryFile) -> None:
        self.cls, self.sig, self.n, self.where, self.sets = cls, sig, n, where, sets
        self.group = np.arange(len(cls))
        self.members: dict[int, list[int]] = {}

    def _set(self, i: int) -> np.ndarray:
        self.sets.seek(int(self.where[i]))
        return np.frombuffer(self.sets.read(8 * int(self.n[i])), dtype=np.uint64)

    def _similar(self, h: np.ndarray, j: int) -> bool:
        other = self._set(j)
        common = len(np.intersect1d(h, other, assume_unique=True))
        return common >= SIMILARITY * (len(other) + len(h) - common)

    def _join(self, i: int, j: int) -> None:
        a, b = sorted((int(self.group[i]), int(self.group[j])), key=lambda x: len(self.members.get(x, ())))
        moved = self.members.pop(a, [a])
        self.members.setdefault(b, [b]).extend(moved)
        self.group[moved] = b

    def add(self, i: int, js: np.ndarray) -> list[int]:
        """Classes of `js` that row i is linked to: one of each group not linked to it yet."""
        linked, h = [], self._set(i)
        while len(js := js[self.group[js] != self.group[i]]):
            some, js = js[:16], js[16:]
            for j in some[np.count_nonzero(self.sig[some] == self.sig[i], axis=1) >= (SIMILARITY - SLACK) * BANDS * ROWS].tolist():
                if self.group[j] != self.group[i] and self._similar(h, j):
                    self._join(i, j)
                    linked.append(int(self.cls[j]))
        return linked


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, n, class, sig, hashes) arrive sorted by key and n; links verified on the whole sets leave."""
    parts: list[tuple] = []
    with tempfile.SpooledTemporaryFile(max_size=SPOOL) as sets:
        for b in _pieces(batches):
            if b is not None:
                hashes = [b.column(4)[i].values.to_numpy().view(np.uint64) for i in range(b.num_rows)]
                odd = np.stack([parities(h, 2 * PLACES) for h in hashes])
                at = sets.seek(0, os.SEEK_END)
                n = b.column(1).to_numpy()
                parts.append((b.column(0).to_numpy(), n, b.column(2).to_numpy(), b.column(3).flatten().to_numpy().reshape(-1, BANDS * ROWS).astype(np.uint16), odd, at + 8 * (np.cumsum(n, dtype=np.int64) - n)))
                for h in hashes:
                    sets.write(h.tobytes())
            elif parts:
                key, n, cls, sig, odd, where = (np.concatenate(x) for x in zip(*parts, strict=True))
                linkage, parts = _Linkage(cls, sig, n, where, sets), []
                a_out, b_out = [], []
                for i, j in near_pairs(key, n, odd):
                    open_ = linkage.group[i] != linkage.group[j]
                    i, j = i[open_], j[open_]
                    cuts = np.flatnonzero(np.diff(i)) + 1
                    for row, js in zip(i[np.concatenate([[0], cuts])].tolist() if len(i) else [], np.split(j, cuts), strict=False):
                        linked = linkage.add(row, js)
                        a_out += linked
                        b_out += [int(cls[row])] * len(linked)
                if a_out:
                    yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])
                sets.seek(0)
                sets.truncate()


def links(files: DataFrame) -> DataFrame:
    """(a, b) of similar classes, each verified on the whole shingle sets.

    Classes of one bucket with a similarity of SIMILARITY or more are linked,
    directly or over others. Sizes and parities, which go through the buckets
    first, rule out most classes exactly; the sets follow for the others only.
    A bucket is read as a sorted stream, so it may hold any number of classes:
    some 500 bytes of each are in memory, its set is on disk.
    """
    whole = files.where("class is not null")
    sketches = whole.select("class", "hashes", "bands").mapInArrow(_sketches, "class bigint, n int, odd binary, bands array<bigint>").dropDuplicates(["class"])
    rows = sketches.select(F.explode("bands").alias("key"), "n", "class", "odd")
    near = materialize(rows.repartition("key").sortWithinPartitions("key", "n").mapInArrow(_resembling, "key bigint, class bigint"))
    sets = whole.select("class", "sig", "hashes").join(near.select("class").distinct(), "class", "left_semi").dropDuplicates(["class"])
    rows = near.join(sets, "class").select("key", F.size("hashes").alias("n"), "class", "sig", "hashes")
    return materialize(rows.repartition("key").sortWithinPartitions("key", "n", "class").mapInArrow(_link, "a bigint, b bigint").distinct())


def families(files: DataFrame) -> DataFrame:
    """(class, family) of every class: the least class that verified links lead to."""
    own = files.where("class is not null").select("class").distinct().withColumn("family", F.col("class"))
    found = links(files)
    edges = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = materialize(edges)
    labels = materialize(edges.select(F.col("a").alias("class")).distinct().withColumn("family", F.col("class")))
    while True:
        least = edges.join(labels, edges["b"] == labels["class"]).groupBy("a").agg(F.min("family").alias("near"))
        step = labels.join(least, labels["class"] == least["a"]).select("class", "family", F.least("family", "near").alias("next"))
        # jump: take over the label of the label
        ahead = step.select(F.col("class").alias("next"), F.col("next").alias("further"))
        step = materialize(step.join(ahead, "next", "left").select("class", "family", F.least("next", F.coalesce("further", "next")).alias("next")))
        moved = step.where("family <> next").isEmpty()
        labels = step.select("class", F.col("next").alias("family"))
        if moved:
            break
    return own.join(labels.withColumnRenamed("family", "linked"), "class", "left").select("class", F.coalesce("linked", "family").alias("family"))


def shared_names(files: DataFrame) -> DataFrame:
    """(file_id, share) of files (file_id, repo_id, family, vendored, names): the share of a file's names and
    literals that its family has in another repository too, or, for a silent file, in a declared copy."""
    w = files.select("file_id", "repo_id", "family", "vendored", F.explode("names").alias("name"))
    seen = w.groupBy("family", "name").agg(F.min("repo_id").alias("low"), F.max("repo_id").alias("high"), F.max("vendored").alias("said"))
    shared = F.coalesce(F.col("low") < F.col("high"), F.lit(False)) | (F.col("said") & ~F.col("vendored"))
    return w.join(seen, ["family", "name"]).groupBy("file_id").agg(F.avg(shared.cast("double")).alias("share"))


def classified(files: DataFrame) -> DataFrame:
    """(file_id, repo_id, family, reason) of every source file; `reason` is null for hand-written ones."""
    d = described(files)
    one = d.drop("names", "hashes", "sig", "bands").dropDuplicates(["file_id"]).withColumn("said", F.col("generated") | F.col("named_generated"))
    one = materialize(one.join(families(d), "class", "left"))
    flag = lambda c: F.sum(F.col(c).cast("int"))
    per_repo = one.where("family is not null").groupBy("family", "repo_id").agg(
        F.count("*").alias("n"), flag("generated").alias("generated"), flag("named_generated").alias("named"), flag("said").alias("said"), flag("vendored").alias("vendored"), flag("literal").alias("literal"), flag("repeating").alias("repeating")
    )
    family = per_repo.groupBy("family").agg(
        F.sum("n").alias("f_n"), F.max("n").alias("f_most"), F.countDistinct("repo_id").alias("f_repos"), F.sum("generated").alias("f_generated"), F.sum("named").alias("f_named"), F.sum("said").alias("f_said"),
        F.sum("vendored").alias("f_vendored"), F.sum("literal").alias("f_literal"), F.sum("repeating").alias("f_repeating"),
    )
    local = per_repo.where("said > 1").select("family", F.col("repo_id").alias("said_repo"), F.col("said").alias("r_said"))
    copies = one.where("raw is not null").groupBy("raw").agg(F.countDistinct("repo_id").alias("copies"))
    wide = family.where("f_n > 1 and (f_repos > 1 or f_vendored > 0)").select("family")
    members = one.join(wide, "family", "left_semi").select("file_id", "repo_id", "family", "vendored")
    share = shared_names(members.join(d.select("file_id", "names").dropDuplicates(["file_id"]), "file_id"))
    j = one.join(family, "family", "left").join(copies, "raw", "left").join(share, "file_id", "left")
    j = j.join(local, (j["family"] == local["family"]) & j["repo_id"].eqNullSafe(F.col("said_repo")), "left").drop(local["family"])
    family_generated = (F.col("f_n") > 1) & ((F.col("f_generated") + F.col("f_named") >= DECLARED * F.col("f_n")) | ((F.col("f_most") >= 3) & (F.col("f_repeating") == F.col("f_n"))))
    # one declared member may be alike by chance: two of the same repository or three of any count
    told = (F.col("n_tokens") >= FAMILY_TOKENS) & (F.col("f_said") >= DECLARED * F.col("f_n")) & (F.col("r_said").isNotNull() | (F.col("f_said") >= 3))
    family_literal = F.col("f_literal") * 2 > F.col("f_n")
    copied = (F.coalesce("copies", F.lit(0)) > 1) | (F.coalesce("share", F.lit(0.0)) >= COPIED)
    reason = (
        F.when(F.col("minified"), "minified")
        .when(F.col("literal") & family_literal, "data")
        .when(F.col("vendored") | (copied & (F.col("f_vendored") * 2 > F.col("f_n"))), "vendored")
        .when(F.col("generated") | F.col("named_generated"), "generated")
        .when(F.col("repeating") & F.coalesce(family_generated, F.lit(False)), "generated")
        .when(F.coalesce(told, F.lit(False)), "generated")
        .when(copied, "vendored")
    )
    return j.select("file_id", "repo_id", "family", reason.alias("reason"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "file_sources")).where("reason is not null").select("file_id")


def p3_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per repository and reason."""
    return classified(table(spark, sf_dir, "file_sources")).groupBy("repo_id", F.coalesce("reason", F.lit("hand-written")).alias("reason")).agg(F.count("*").alias("files"))


def p3_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import rows (each once) that come from hand-written files, their paths brought to the files' spelling."""
    files = table(spark, sf_dir, "file_sources")
    clean = lambda c: F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^(?:\./|/)+", ""), r"/{2,}", "/"))
    hand = classified(files).where("reason is null").select("file_id")
    paths = files.where("file_path is not null").select("file_id", "repo_id", clean("file_path").alias("p")).distinct().join(hand, "file_id", "left_semi")
    imports = table(spark, sf_dir, "imports").withColumn("p", clean("file_path")).drop("file_path").distinct()
    return imports.join(paths, ["repo_id", "p"]).groupBy("file_id", "repo_id").agg(F.count("*").alias("imports"))


QUERIES = {"p3_found": p3_found, "p3_reasons": p3_reasons, "p3_imports": p3_imports}
ORACLES: dict[str, str] = {}
