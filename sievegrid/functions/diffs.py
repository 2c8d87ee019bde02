"""Unified diffs: parsing, tags, priorities, and budgeted views.

A commit is one row, and all of this works inside the row, on an array of its
changed files; nothing is shuffled. Changed files are structs (block, path,
is_binary, adds, dels, hunks, raw), later with tag and priority.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Line breaks as Python's splitlines knows them. Fixed values.
BREAKS = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85  ]"
HEADER = "diff --git "

# What a path says about its file. They must equal the published ones for equal results.
TEST_FOLDERS = ("tests", "test", "testing")
TEST_STARTS = ("test_", "tests_")
TEST_ENDS = ("_test.py", "_test.go", "_test.java", "_tests.py", ".test.js", ".test.ts", ".spec.js", ".spec.ts")
DOC_FOLDERS = ("docs", "doc")
DOC_FIRST_FOLDERS = ("docs", "doc", "documentation")
DOC_EXTENSIONS = ("md", "rst", "txt", "adoc")
DOC_NAMES = ("readme", "changelog", "changes", "notice", "license", "authors", "contributors")
CONFIG_NAMES = (
    "setup.py", "setup.cfg", "pyproject.toml", "Makefile", "makefile", "CMakeLists.txt", "configure", "configure.ac",
    "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Gemfile", "Gemfile.lock", "Cargo.toml", "Cargo.lock",
    "go.mod", "go.sum", "Dockerfile", ".dockerignore",
)
CONFIG_EXTENSIONS = ("yml", "yaml", "toml", "ini", "cfg", "conf", "lock")
SOURCE_EXTENSIONS = (
    "c", "h", "cc", "cpp", "hpp", "cxx", "py", "pyx", "pyi", "java", "kt", "scala", "js", "jsx", "ts", "tsx", "mjs", "cjs",
    "go", "rs", "rb", "php", "cs", "m", "mm", "swift", "lua", "pl", "sh", "bash", "zsh", "sql",
)
BASE_PRIORITY = {"source": 100, "test": 40, "config": 30, "doc": 10, "fixture": 0, "other": 20}
TAG_ORDER = ("source", "test", "config", "doc", "fixture", "other")
PATH_STOPWORDS = (
    "py", "src", "tests", "test", "lib", "libs", "include", "headers", "main", "java", "com", "net", "org", "io", "core",
    "common", "util", "utils", "modules", "module", "pkg", "package", "build", "dist",
)
#: Starts of the lines that a compressed block keeps. Fixed values.
KEPT_STARTS = (
    "diff --git", "index ", "--- ", r"\+\+\+ ", "@@", "new file mode", "deleted file mode", "old mode", "new mode", "similarity index",
    "dissimilarity index", "rename from", "rename to", "copy from", "copy to", "Binary files", r"\+(?!\+\+)", "-(?!--)",
)
MIDDLE_CUT = "\n... [middle truncated] ...\n"
MANIFEST_LINES = 50
MORE_FILES = (
    " more files not shown — typically low-priority (binaries, docs, etc.). Large commits with 50+ files are usually refactors or repo init, "
    "rarely security fixes. Call read_file_diff(commit_id, path) if you suspect a specific file you remember from elsewhere.]"
)
WORD = "[A-Za-z_][A-Za-z0-9_]+"


def told(*parts) -> Column:
    """Strings and columns as one text."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def lines(text: Column) -> Column:
    """Lines without a trailing empty one."""
    return bound(F.split(F.coalesce(text, F.lit("")), BREAKS), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def target_path(header: Column) -> Column:
    """The path after the change, of a block's first line."""
    named = stripped(F.regexp_extract(header, r"^diff --git a/(.+?) b/(.+?)$", 2))
    fourth = F.get(F.regexp_extract_all(header, F.lit(r"\S+"), F.lit(0)), F.lit(3))
    return F.coalesce(F.nullif(named, F.lit("")), F.regexp_replace(fourth, "^b/", ""), F.lit(""))


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once per row or element: inside lambdas nothing else shares it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def file_changes(text: Column) -> Column:
    """The changed files of a diff, in order; lines before the first are left out. Null and empty texts have none.

    The text is cut before each file's line once, and each file is read by itself, so time follows the text's length.
    """
    blocks = F.split(F.coalesce(text, F.lit("")), f"(?={HEADER})(?<=[{BREAKS.split('[')[1]})")

    def change(raw: Column, i: Column) -> Column:
        def read(b: Column) -> Column:
            count = lambda rule: F.size(F.filter(b, rule)).cast("long")
            return F.struct(
                (i + 1).cast("long").alias("block"),
                target_path(F.get(b, F.lit(0))).alias("path"),
                F.exists(b, lambda x: x.startswith("Binary files") & x.contains("differ")).alias("is_binary"),
                count(lambda x: x.startswith("+") & ~x.startswith("+++")).alias("adds"),
                count(lambda x: x.startswith("-") & ~x.startswith("---")).alias("dels"),
                count(lambda x: x.startswith("@@")).alias("hunks"),
                F.array_join(b, "\n").alias("raw"),
            )

        return bound(lines(raw), read)

    return F.transform(F.filter(blocks, lambda x: x.startswith(HEADER)), change)


def parse_diff(commits: DataFrame, key: str = "doc_id", text: str = "diff") -> DataFrame:
    """(key, block, path, is_binary, adds, dels, hunks, raw): one row per changed file."""
    return commits.select(key, F.inline(file_changes(F.col(text))))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"\.([^.]*)$", 1))


def file_tag(path: Column, is_binary: Column) -> Column:
    low = F.lower(path)
    name, ext, parts = F.substring_index(low, "/", -1), extension(path), F.split(low, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    among = lambda values: F.arrays_overlap(folders, F.array(*map(F.lit, values)))
    any_of = lambda tests: F.array_contains(F.array(*tests), True)
    test = among(TEST_FOLDERS) | any_of([name.startswith(x) for x in TEST_STARTS] + [name.endswith(x) for x in TEST_ENDS])
    doc = among(DOC_FOLDERS) | F.coalesce(F.get(folders, F.lit(0)).isin(*DOC_FIRST_FOLDERS), F.lit(False)) | ext.isin(*DOC_EXTENSIONS) | name.isin(*DOC_NAMES)
    config = F.substring_index(path, "/", -1).isin(*CONFIG_NAMES) | ext.isin(*CONFIG_EXTENSIONS)
    return F.when(is_binary, "fixture").when(test, "test").when(doc, "doc").when(config, "config").when(ext.isin(*SOURCE_EXTENSIONS), "source").otherwise("other")


def word_set(text: Column, least: int = 1) -> Column:
    """Distinct identifiers of a text in lower case, of `least` characters or more."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), F.lower))
    return F.filter(found, lambda x: F.length(x) >= least) if least > 1 else found


def file_priority(tag: Column, adds: Column, dels: Column, path: Column, words: Column) -> Column:
    """Base by tag, up to 20 for changed lines, less 10 beyond 500 of them, 15 more if `words` (of the description) has a part of the path."""
    base = F.coalesce(*(F.when(tag == k, F.lit(v)) for k, v in BASE_PRIORITY.items()), F.lit(0))
    changed = adds + dels
    names = F.array_except(word_set(path), F.array(*map(F.lit, PATH_STOPWORDS)))
    named = F.coalesce(F.arrays_overlap(names, words), F.lit(False))
    return (base + F.least(F.lit(20), changed) - F.when(changed > 500, 10).otherwise(0) + F.when(named, 15).otherwise(0)).cast("int")


def tagged(files: Column) -> Column:
    """files with tag alone, where nothing asks for priorities: a description's words cost more than all else."""
    return F.transform(files, lambda f: f.withField("tag", file_tag(f["path"], f["is_binary"])))


def classified(files: Column, description: Column) -> Column:
    """files with tag and priority."""

    def add(f: Column, words: Column) -> Column:
        return bound(file_tag(f["path"], f["is_binary"]), lambda tag: f.withField("tag", tag).withField("priority", file_priority(tag, f["adds"], f["dels"], f["path"], words)))

    return bound(word_set(description, 3), lambda words: F.transform(files, lambda f: add(f, words)))


def by_priority(files: Column) -> Column:
    """files, the highest priority first, else in order."""
    order = F.array_sort(F.transform(files, lambda f: F.struct((-f["priority"]).alias("p"), f["block"].alias("block"), f.alias("f"))))
    return F.transform(order, lambda x: x["f"])


def line_priority(line: Column) -> Column:
    """2 for file names, 3 for hunk headers, 4 for changed lines, 5 for the rest."""
    return F.when(line.startswith("--- ") | line.startswith("+++ "), 2).when(line.startswith("@@"), 3).when(line.startswith("+") | line.startswith("-"), 4).otherwise(5)


def truncate_by_priority(text: Column, budget: int) -> Column:
    """text if it fits or there is no budget; else its lines by priority, then place, while they fit (one that doesn't is skipped)."""
    if budget <= 0:
        return text
    rows = F.transform(lines(text), lambda x, i: F.struct(line_priority(x).alias("p"), i.alias("i"), x.alias("x")))
    start = F.struct(F.lit(budget).alias("room"), F.array().cast("array<string>").alias("kept"))
    fold = F.aggregate(F.array_sort(rows), start, lambda a, r: F.when(
        F.length(r["x"]) + 1 <= a["room"], F.struct((a["room"] - F.length(r["x"]) - 1).alias("room"), F.concat(a["kept"], F.array(r["x"])).alias("kept"))
    ).otherwise(a))
    return F.when(F.length(text) <= budget, text).otherwise(F.array_join(fold["kept"], "\n"))


def commit_text(message: Column, diff: Column, budget: int = 6000) -> Column:
    """What is embedded of a commit: its whole message, and its diff by priority."""
    return stripped(told("Commit message:\n", F.coalesce(message, F.lit("")), "\n\nDiff:\n", truncate_by_priority(F.coalesce(diff, F.lit("")), budget)))


def compress_block(raw: Column, budget: Column | int) -> Column:
    """Headers and changed lines only; if still too long, its head and its tail around a mark."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    half = F.greatest(F.lit(200), F.floor(budget / 2).cast("int") - 30)
    kept = F.array_join(F.filter(lines(raw), lambda x: x.rlike(f"^(?:{'|'.join(KEPT_STARTS)})")), "\n")
    return bound(kept, lambda k: F.when(F.length(k) <= budget, k).otherwise(F.concat(F.left(k, half), F.lit(MIDDLE_CUT), F.right(k, half))))


def padded(text: Column, width: int) -> Column:
    """Filled with blanks to width; longer texts stay whole."""
    return F.rpad(text, F.greatest(F.length(text), F.lit(width)), " ")


def file_manifest(files: Column) -> Column:
    """Counts by tag, then a line for each of the first files of a commit (classified, by priority)."""
    count = lambda t: F.size(F.filter(files, lambda f: f["tag"] == t))
    tags = F.array_join(F.filter(F.array(*(F.when(count(t) > 0, told(count(t), f" {t}")) for t in TAG_ORDER)), lambda x: x.isNotNull()), ", ")
    n = F.size(files)
    limited = F.when(n > MANIFEST_LINES, told(f"; showing top-{MANIFEST_LINES} by relevance")).otherwise("")

    def line(f: Column) -> Column:
        return told("  ", padded(f["path"], 60), "  ", padded(f["tag"], 8), "  ", F.when(f["is_binary"], "(binary)").otherwise(told("+", f["adds"], "/-", f["dels"])))

    shown = F.transform(F.slice(files, 1, MANIFEST_LINES), line)
    more = F.when(n > MANIFEST_LINES, F.array(told("  [+ ", n - MANIFEST_LINES, MORE_FILES))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(told("[Files changed: ", n, " — ", tags, limited, "]")), shown, more), "\n")


def render_commit(message: Column, files: Column, budget: int = 8000) -> Column:
    """The view of a commit: message, manifest, and its files' blocks by priority (classified files in that order).

    Binaries are counted only. A block that doesn't fit is compressed and ends the room; blocks that find 200 characters
    or less are named only.
    """
    text = stripped(F.coalesce(message, F.lit("")))
    head = F.array(F.when(text == "", "MSG: (empty)").otherwise(told("MSG: ", text)), F.lit(""), file_manifest(files), F.lit(""), F.lit(f"[Diff content, budget {budget} chars]"))
    none = F.array().cast("array<string>")

    def state(room, out, cut, binary) -> Column:
        return F.struct(room.cast("int").alias("room"), out.alias("out"), cut.alias("cut"), binary.cast("int").alias("binary"))

    def step(a: Column, f: Column) -> Column:
        title = told("--- ", f["path"], " ---")
        whole = told(title, "\n", f["raw"])
        small = compress_block(f["raw"], F.greatest(F.lit(400), a["room"] - F.length(title) - 1))
        note = told("[... ", f["path"], ": full diff ", F.length(f["raw"]), " chars, call read_file_diff to see complete content]")
        named = F.concat(a["cut"], F.array(f["path"]))
        return (
            F.when(f["is_binary"], state(a["room"], a["out"], a["cut"], a["binary"] + 1))
            .when(a["room"] <= 200, state(a["room"], a["out"], named, a["binary"]))
            .when(F.length(whole) <= a["room"], state(a["room"] - F.length(whole) - 1, F.concat(a["out"], F.array(whole)), a["cut"], a["binary"]))
            .otherwise(state(F.lit(0), F.concat(a["out"], F.array(title, small, note)), named, a["binary"]))
        )

    def finish(a: Column) -> Column:
        skipped = F.when(a["binary"] > 0, F.array(F.lit(""), told("[Binary files skipped: ", a["binary"], " (no content shown)]"))).otherwise(none)
        n = F.size(a["cut"])
        more = F.when(n > 5, told(" (+", n - 5, " more)")).otherwise("")
        cut = F.when(n > 0, F.array(told("[Files truncated — call read_file_diff to inspect: ", F.array_join(F.slice(a["cut"], 1, 5), ", "), more, "]"))).otherwise(none)
        return F.array_join(F.concat(head, a["out"], skipped, cut), "\n")

    return F.aggregate(files, state(F.lit(budget), none, none, F.lit(0)), step, finish)


def render_file(f: Column, budget: int = 16000) -> Column:
    """The view of one changed file, with a larger budget of its own."""
    title = told("--- ", f["path"], " ---")
    room = F.lit(budget) - F.length(title) - 1
    small = told(title, "\n", compress_block(f["raw"], room), "\n[... ", f["path"], ": original ", F.length(f["raw"]), " chars, compressed to fit budget]")
    binary = told(title, "\n[Binary file, no diff content. adds=", f["adds"], " dels=", f["dels"], "]")
    return F.when(f["is_binary"], binary).when(F.length(f["raw"]) <= room, told(title, "\n", f["raw"])).otherwise(small)


def first_line(text: Column, width: int = 80) -> Column:
    head = F.get(lines(text), F.lit(0))
    return F.when(F.length(head) > width, F.concat(F.left(head, F.lit(width - 3)), F.lit("..."))).otherwise(F.coalesce(head, F.lit("")))
