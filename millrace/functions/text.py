"""Scalar functions over identifiers, texts and paths, as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words left out of queries.
STOPWORDS = (
    "a about above after again all am an and any are as at be because been before being below between both but by could did do does doing down during each few for from further had has have having he her here hers herself him himself his how "
    "i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those "
    "through to too under until up very was we were what when where which while who whom why with would you your yours yourself yourselves"
).split()

# Keywords of a task's kind, the first kind with a keyword wins.
TASK_KEYWORDS = {
    "bugfix": "fix bug error panic issue fail failure crash regression".split(),
    "test_creation": "test tests spec assert coverage benchmark".split(),
    "refactor": "refactor cleanup reorganize decouple rename simplify".split(),
    "feature": "add implement create support feature new extend".split(),
    "documentation": "doc docs documentation guide readme explain architecture comment".split(),
    "exploration": "where find locate trace how explore search".split(),
}

# Keywords of architectural layers, tried in this order on a subsystem's name and on its folder.
LAYER_KEYWORDS = (
    ("Presentation", "cli mcp api routes commands controllers components views".split(), "cli mcp routes controllers".split()),
    ("Infrastructure", "cache loader parser db storage io infra clients".split(), "cache loader storage db".split()),
    ("Core", "types error symbol tokens csr utils common core".split(), "common utils types".split()),
)

# Name parts of a model profile with its context window, least and most tokens and sensitivity, in the order they are tried.
MODEL_PROFILES = (
    ("sonnet|claude|anthropic", 200000, 800, 6000, 1.0),
    ("gpt|openai|4o", 128000, 600, 5000, 1.0),
    ("deepseek", 64000, 500, 4000, 1.1),
    ("ollama|local|llama|qwen", 16000, 400, 2000, 1.2),
    ("", 64000, 600, 4000, 1.0),
)

#: Extension -> language.
LANGUAGES = {"rs": "rust", "py": "python", "ts": "typescript", "tsx": "tsx", "js": "tsx", "jsx": "tsx", "mjs": "tsx", "cjs": "tsx", "go": "go"}

_OPERATORS = "::|->|=>|==|!=|<=|>="
_PUNCTUATION = r"[!-/:-@\[-`{-~]"


def tokenize_ident(c: Column) -> Column:
    """Lower-case words of identifiers and prose: breaks at case changes, digits and anything else."""
    x = F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")
    for pattern in (r"(\p{Lu}{2,})(\p{Lu}\p{Ll})", r"(\p{Ll})(\p{Lu})", r"([0-9])([^0-9 ])", r"([^0-9 ])([0-9])"):
        x = F.regexp_replace(x, pattern, "$1 $2")
    return F.filter(F.split(F.lower(F.trim(x)), " "), lambda t: t != "")


def query_terms(c: Column) -> Column:
    """Tokens of a query without stop words and single letters; all tokens if nothing else is left."""
    t = tokenize_ident(c)
    kept = F.filter(t, lambda x: ~x.isin(STOPWORDS) & (F.octet_length(x) > 1))
    return F.when(F.size(kept) > 0, kept).otherwise(t)


def char_ngrams(c: Column) -> Column:
    """Sorted distinct 3- to 5-grams of `<text>`; the whole string where it is too short."""
    x = F.concat(F.lit("<"), F.lower(F.trim(c)), F.lit(">"))

    def grams(n: int) -> Column:
        return F.when(F.length(x) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - (n - 1), F.lit(1))), lambda i: F.substring(x, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    found = F.array_distinct(F.concat(grams(3), grams(4), grams(5)))
    return F.array_sort(F.when(F.size(found) > 0, found).otherwise(F.array(x)))


def trigrams(c: Column) -> Column:
    x = F.lower(c)
    return F.array_sort(F.array_distinct(F.when(F.length(x) >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 2, F.lit(1))), lambda i: F.substring(x, i, F.lit(3)))).otherwise(F.array(x))))


def set_jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets: 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


#: What counts as a token, one character or operator each: operators, punctuation, the first character of a word,
#: of a part of a word after a change of case or between letters and digits, and any other visible character.
_COUNTED = "|".join(
    (
        _OPERATORS, _PUNCTUATION, r"(?<![\p{L}\p{N}])[\p{L}\p{N}]", r"(?<=\p{Ll})\p{Lu}", r"(?<=\p{L})[0-9]", r"(?<=[0-9])\p{L}", r"(?<=\p{Lu}\p{Lu})\p{Ll}",
        r"[^\p{L}\p{N}\s\x0b\x{85}\p{Z}!-/:-@\[-`{-~]",
    )
)


def token_estimate(c: Column) -> Column:
    """Tokens of a text by counting words, transitions and punctuation, in one pass over it; 0 for blank text."""
    n = F.regexp_count(c, F.lit(_COUNTED))
    return F.when(~c.rlike(r"[^\s\x0b\x{85}\p{Z}]"), 0).otherwise(F.greatest(n, F.ceil(F.octet_length(c) / 4))).cast("bigint")


def token_calibrated(raw: Column) -> Column:
    return F.greatest(F.floor(F.lit(0.96) * raw + 0.5), F.lit(1)).cast("bigint")


def normalized_path(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^(?:\./)+", "")


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext]


def node_type(name: Column, path: Column, kind: Column) -> Column:
    """Type of a graph node: a callable in a test place or with a test name is a Test, else by its kind."""
    in_tests = F.exists(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: p.isin("tests", "test") | p.endswith("_test.rs") | p.endswith("_test.go"))
    named = name.rlike(r"^(?:test_|Test|prop_)|(?:_test|Test)$")
    by_kind = F.create_map(*[F.lit(x) for x in ("Function", "Function", "Method", "Method", "Struct", "Struct", "Enum", "Type", "TypeAlias", "Type", "Trait", "Interface", "Module", "Module")])
    return F.when((in_tests | named) & kind.isin("Function", "Method"), "Test").otherwise(by_kind[kind])


def is_test(name: Column, path: Column, signature: Column, docstring: Column) -> Column:
    """Whether a symbol counts as a test in impact analysis (wider than node_type)."""
    p = F.lower(F.regexp_replace(path, r"\\", "/"))
    by_path = p.rlike(r"(?:^|/)tests/|test_|_test\.(?:rs|go)$|\.(?:test|spec)\.(?:ts|tsx|js)$")
    by_name = F.lower(name).rlike(r"^test_|_test$") | name.startswith("Test")
    marked = F.concat_ws(" ", signature, docstring).rlike(r"#\[(?:tokio::)?test\]")
    return by_path | by_name | marked


def subsystem(path: Column) -> Column:
    """Subsystem that a file's path names."""
    p = F.filter(F.split(normalized_path(path), "/"), lambda x: x != "")
    first = F.lower(F.get(p, F.lit(0)))
    deep = F.size(p) >= 2
    return (
        F.when(F.size(p) == 0, "root")
        .when(deep & first.isin("crates", "packages", "apps", "services", "modules"), F.concat(F.get(p, F.lit(0)), F.lit("-"), F.get(p, F.lit(1))))
        .when(deep & first.isin("src", "app", "lib", "pkg"), F.get(p, F.lit(1)))
        .when(deep, F.get(p, F.lit(0)))
        .otherwise("core")
    )


def subsystem_folder(path: Column) -> Column:
    p = F.filter(F.split(normalized_path(path), "/"), lambda x: x != "")
    first = F.lower(F.get(p, F.lit(0)))
    deep = F.size(p) >= 2
    two = first.isin("crates", "packages", "apps", "services", "modules", "src", "app", "lib", "pkg")
    return F.when(deep & two, F.concat_ws("/", F.get(p, F.lit(0)), F.get(p, F.lit(1)))).when(deep, F.get(p, F.lit(0))).otherwise(".")


def layer(name: Column, folder: Column, in_degree: Column, out_degree: Column) -> Column:
    """Architectural layer by keywords, else by the direction of the references."""
    n, d = F.lower(name), F.lower(folder)
    out = F.when(F.lit(False), "")
    for label, names, folders in LAYER_KEYWORDS:
        out = out.when(n.rlike("|".join(names)) | d.rlike("|".join(folders)), label)
    return out.when((out_degree > 0) & (in_degree == 0), "Presentation").when((in_degree > 0) & (out_degree == 0), "Core").otherwise("Domain")


def task_kind(query: Column) -> Column:
    """Kind of task that a request describes."""
    words = F.filter(F.split(F.lower(query), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    out = F.when(F.lit(False), "")
    for kind, keywords in TASK_KEYWORDS.items():
        out = out.when(F.arrays_overlap(words, F.array(*[F.lit(k) for k in keywords])), kind)
    return out.otherwise("general")


def path_distance(a: Column, b: Column) -> Column:
    """0 for one file, 1 within a folder, else the components that two paths do not share."""
    x, y = F.split(a, "/"), F.split(b, "/")
    folder = lambda p: F.regexp_replace(p, "/?[^/]*$", "")
    same = F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + F.when(s["on"] & e, 1).otherwise(0)).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])
    return F.when(a == b, 0).when(folder(a) == folder(b), 1).otherwise(F.size(x) + F.size(y) - 2 * same)


def scope_score(distance: Column) -> Column:
    return F.when(distance == 0, 1.0).when(distance == 1, 0.85).when(distance == 2, 0.6).otherwise(0.3)


def valid_revision(c: Column) -> Column:
    """Whether a text may be handed to git as a revision."""
    return F.trim(c).rlike(r"^[A-Za-z0-9._/~^@{}][A-Za-z0-9._/~^@{}-]*$")


def recency_weight(age_seconds: Column, half_life_days: float = 90.0) -> Column:
    w = F.pow(F.lit(2.0), -F.greatest(age_seconds, F.lit(0)).cast("double") / F.lit(half_life_days * 86400.0))
    return F.least(F.greatest(w, F.lit(0.001)), F.lit(1.0))


def model_profile(name: Column) -> Column:
    """STRUCT(context_window, min_tokens, max_tokens, sensitivity) of a model name; unknown names get the last profile."""
    n = F.lower(F.trim(name))
    out = None
    for parts, *values in MODEL_PROFILES[:-1]:
        hit = F.struct(*[F.lit(v).alias(k) for k, v in zip(("context_window", "min_tokens", "max_tokens", "sensitivity"), values, strict=True)])
        out = F.when(n.rlike(parts), hit) if out is None else out.when(n.rlike(parts), hit)
    return out.otherwise(F.struct(*[F.lit(v).alias(k) for k, v in zip(("context_window", "min_tokens", "max_tokens", "sensitivity"), MODEL_PROFILES[-1][1:], strict=True)]))
