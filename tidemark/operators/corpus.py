"""Search, listing and slicing over a table of documents (doc_id, path, mtime, text).

Lines are handled inside the row: only those that match are exploded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import file_references, glob_regex, shell_references, utf16_length

# Fixed values.
MAX_LINE = 2000
MAX_LINES = 2000
MAX_BYTES = 50 * 1024
SEARCH_LIMIT = 100
IGNORED_FOLDERS = (
    "node_modules", "bower_components", ".pnpm-store", "vendor", ".npm", "dist", "build", "out", ".next", "target",
    "bin", "obj", ".git", ".svn", ".hg", ".vscode", ".idea", ".turbo", ".output", "desktop", ".sst", ".cache",
    ".webkit-cache", "__pycache__", ".pytest_cache", "mypy_cache", ".history", ".gradle",
)
IGNORED_FILES = (
    "**/*.swp", "**/*.swo", "**/*.pyc", "**/.DS_Store", "**/Thumbs.db", "**/logs/**", "**/tmp/**", "**/temp/**",
    "**/*.log", "**/coverage/**", "**/.nyc_output/**",
)
BINARY_HEAD = 4096
BINARY_SHARE = 0.3
BINARY_EXTENSIONS = (
    ".zip", ".tar", ".gz", ".exe", ".dll", ".so", ".class", ".jar", ".war", ".7z", ".doc", ".docx", ".xls", ".xlsx",
    ".ppt", ".pptx", ".odt", ".ods", ".odp", ".bin", ".dat", ".obj", ".o", ".a", ".lib", ".wasm", ".pyc", ".pyo",
)


def matches_glob(path: Column, glob: str) -> Column:
    return F.rlike(path, F.lit(glob_regex(glob)))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


# -- path filters ------------------------------------------------------------------


def is_ignored(path: Column, extra: tuple[str, ...] = (), whitelist: tuple[str, ...] = ()) -> Column:
    """Not whitelisted, and in an ignored folder or matching an ignored glob."""
    folders = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(f) for f in IGNORED_FOLDERS]))
    globs = _any([matches_glob(path, g) for g in (*IGNORED_FILES, *extra)])
    return ~_any([matches_glob(path, g) for g in whitelist]) & (folders | globs)


def filter_ignored_paths(paths: DataFrame, extra: tuple[str, ...] = (), whitelist: tuple[str, ...] = ()) -> DataFrame:
    return paths.where(~is_ignored(F.col("path"), extra, whitelist))


def is_hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda s: F.startswith(s, F.lit(".")) & (F.length(s) > 1))


def filter_hidden_paths(paths: DataFrame) -> DataFrame:
    return paths.where(~is_hidden(F.col("path")))


def is_binary(content: Column) -> Column:
    """Whether bytes do not look like text: a zero among the first ones, or too many control characters."""
    # The bytes as the characters of the same numbers.
    head = F.decode(F.substring(content, 1, BINARY_HEAD), "ISO-8859-1")
    control = F.length(head) - F.length(F.regexp_replace(head, r"[\x01-\x08\x0E-\x1F]", ""))
    return F.coalesce(F.contains(head, F.lit("\0")) | (control > F.length(head) * F.lit(BINARY_SHARE)), F.lit(False))


def filter_binary_files(paths: DataFrame, content: str | None = None) -> DataFrame:
    """Files that are not binary, by extension and by the bytes in the column ``content`` if one is named."""
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]*)\z", 1))
    binary = extension.isin(*BINARY_EXTENSIONS)
    return paths.where(~(binary | is_binary(F.col(content).cast("binary"))) if content else ~binary)


# -- search --------------------------------------------------------------------------


def _numbered_lines(text: Column) -> Column:
    return F.transform(F.split(text, "\r?\n"), lambda line, i: F.struct((i + 1).alias("number"), line.alias("text")))


def _clip(text: Column) -> Column:
    return F.when(F.length(text) > MAX_LINE, F.concat(F.left(text, F.lit(MAX_LINE)), F.lit("..."))).otherwise(text)


def grep(docs: DataFrame, pattern: str, include: str | None = None, limit: int | None = SEARCH_LIMIT) -> DataFrame:
    """Matching lines, newest documents first: (path, mtime, line_number, line). All of them without a ``limit``."""
    if include is not None:
        docs = docs.where(matches_glob(F.col("path"), include))
    hits = F.filter(_numbered_lines(F.col("text")), lambda l: F.rlike(l["text"], F.lit(pattern)))
    found = (
        docs.select("path", "mtime", F.explode(hits).alias("hit"))
        .select("path", "mtime", F.col("hit.number").alias("line_number"), _clip(F.col("hit.text")).alias("line"))
        .orderBy(F.desc("mtime"), "path", "line_number")
    )
    return found if limit is None else found.limit(limit)


def grep_submatches(docs: DataFrame, pattern: str, per_file: int | None = 10) -> DataFrame:
    """Every match with its byte range in the line and the byte offset of the line.

    ``per_file`` bounds the matching lines per document, in line order. The
    pattern must not match the empty string.
    """
    lines = F.split("text", "\n")
    sizes = F.transform(lines, lambda l: F.octet_length(l) + 1)
    hits = F.filter(
        F.transform(lines, lambda line, i: F.struct(i.alias("i"), line.alias("text"))),
        lambda l: F.rlike(l["text"], F.lit(pattern)),
    )
    if per_file is not None:
        hits = F.slice(hits, 1, per_file)
    before = F.aggregate(F.slice("sizes", F.lit(1), F.col("hit.i")), F.lit(0).cast("long"), lambda a, n: a + n)
    found = F.regexp_extract_all("line", F.lit(pattern), F.lit(0))
    gaps = F.split("line", pattern)
    length = lambda items, n: F.aggregate(F.slice(items, F.lit(1), n), F.lit(0), lambda a, s: a + F.octet_length(s))
    return (
        docs.select("path", sizes.alias("sizes"), F.explode(hits).alias("hit"))
        .select("path", (F.col("hit.i") + 1).alias("line_number"), before.alias("offset"), F.col("hit.text").alias("line"))
        .select("path", "line_number", "offset", F.posexplode(found).alias("n", "match"), found.alias("found"), gaps.alias("gaps"))
        .select(
            "path",
            "line_number",
            "offset",
            "match",
            (length("gaps", F.col("n") + 1) + length("found", F.col("n"))).alias("start"),
        )
        .withColumn("end", F.col("start") + F.octet_length("match"))
    )


def glob(docs: DataFrame, pattern: str, limit: int | None = SEARCH_LIMIT) -> DataFrame:
    found = docs.where(matches_glob(F.col("path"), pattern)).select("path", "mtime").orderBy(F.desc("mtime"), "path")
    return found if limit is None else found.limit(limit)


def _split_path(paths: DataFrame) -> DataFrame:
    return paths.select(F.regexp_extract("path", r"\A(.*)/[^/]*\z", 1).alias("dir"), F.regexp_extract("path", r"([^/]*)\z", 1).alias("base"))


def _pieces(text: Column, lengths: Column) -> Column:
    """The different pieces of a text that have one of the lengths."""
    fitting = F.filter(lengths, lambda n: n <= F.length(text))
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))
    return F.array_distinct(F.flatten(F.transform(fitting, cut)))


def suggest_paths(paths: DataFrame, wanted: DataFrame, n: int = 3) -> DataFrame:
    """Up to ``n`` names in the wanted directory that contain, or are contained in, the wanted name.

    Both ways are joins on equal names. An entry gives its pieces of the lengths that
    are asked for in its directory; those that are asked for are ranked, and only the
    ``n`` smallest entries per (directory, piece) go on. A wanted name gives all its
    pieces, and meets at most ``n`` entries under each.
    """
    entries = _split_path(paths).distinct().select("dir", F.col("base").alias("entry"), F.lower("base").alias("_e"))
    names = wanted.select("dir", "base", F.lower("base").alias("_w")).distinct()
    smallest = lambda df: (
        df.withColumn("rank", F.row_number().over(Window.partitionBy("dir", "_piece").orderBy("entry"))).where(F.col("rank") <= n).drop("rank")
    )
    asked = names.groupBy("dir").agg(F.collect_set(F.length("_w")).alias("_lengths"))
    pieces = entries.join(asked, "dir").select("dir", "entry", F.explode(_pieces(F.col("_e"), F.col("_lengths"))).alias("_piece"))
    pieces = pieces.hint("merge").join(names.select("dir", F.col("_w").alias("_piece")).distinct(), ["dir", "_piece"], "left_semi")
    inside = smallest(pieces).join(names.withColumnRenamed("_w", "_piece"), ["dir", "_piece"])
    whole = smallest(entries.select("dir", "entry", F.col("_e").alias("_piece")))
    lengths = F.sequence(F.lit(0), F.length("_w"))
    around = names.select("dir", "base", F.explode(_pieces(F.col("_w"), lengths)).alias("_piece")).hint("merge").join(whole, ["dir", "_piece"])
    first = Window.partitionBy("dir", "base").orderBy("entry")
    return (
        inside.select("dir", "base", "entry")
        .unionByName(around.select("dir", "base", "entry"))
        .distinct()
        .withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= n)
        .select("dir", "base", F.when(F.col("dir") == "", F.col("entry")).otherwise(F.concat("dir", F.lit("/"), "entry")).alias("suggestion"))
    )


def fuzzy_find(paths: DataFrame, query: str, n: int = SEARCH_LIMIT) -> DataFrame:
    """Paths with the letters of ``query`` in order, nearest by edit distance first."""
    letters = [c if c.isalnum() else "\\" + c for c in query.lower().strip()]
    subsequence = r"(?s)" + ".*".join(letters)
    distance = F.levenshtein(F.lower("path"), F.lit(query.lower().strip()))
    return (
        paths.where(F.rlike(F.lower("path"), F.lit(subsequence)))
        .select("path", distance.alias("distance"))
        .orderBy("distance", "path")
        .limit(n)
    )


def hidden_last(paths: DataFrame, query: str = "") -> DataFrame:
    """Directories with their rank; hidden ones last unless the query asks for them."""
    prefer_hidden = query.startswith(".") or "/." in query
    hidden = F.lit(False) if prefer_hidden else is_hidden(F.col("path"))
    return paths.select("path", hidden.alias("hidden")).orderBy("hidden", "path")


# -- listings ------------------------------------------------------------------------


def list_directory(paths: DataFrame, directory: str = "") -> DataFrame:
    """Entries of one directory, directories first: (name, path, type, ignored)."""
    prefix = directory.rstrip("/") + "/" if directory else ""
    rest = F.substr("path", F.lit(len(prefix) + 1))
    inside = paths.where(F.startswith("path", F.lit(prefix))).select(rest.alias("rest"))
    entry = inside.select(
        F.substring_index("rest", "/", 1).alias("name"),
        F.when(F.contains("rest", F.lit("/")), "directory").otherwise("file").alias("type"),
    ).distinct()
    full = F.concat(F.lit(prefix), "name")
    slash = F.when(F.col("type") == "directory", "/").otherwise("")
    return entry.select("name", full.alias("path"), "type", is_ignored(F.concat(full, slash)).alias("ignored")).orderBy("type", "name")


def directory_tree(paths: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Every directory above the first ``limit`` files, with its files in order."""
    files = paths.select("path").orderBy("path").limit(limit)
    parts = F.split(F.regexp_extract("path", r"\A(.*)/[^/]*\z", 1), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    dirs = files.select(F.explode(F.concat(F.array(F.lit(".")), F.filter(above, lambda d: d != ""))).alias("dir")).distinct()
    split = _split_path(files).withColumn("dir", F.when(F.col("dir") == "", ".").otherwise(F.col("dir")))
    listed = split.groupBy("dir").agg(F.sort_array(F.collect_list("base")).alias("files"))
    return dirs.join(listed, "dir", "left").withColumn("files", F.coalesce("files", F.array().cast("array<string>")))


def tree_preview(paths: DataFrame, n: int = 50) -> DataFrame:
    """At most ``n`` nodes breadth-first, taking siblings of all parents in turn.

    Returns (path, depth, position, truncated): ``truncated`` counts children left out.
    The order of all nodes is one sort key: depth, rank among the siblings, and the ranks
    of the nodes above. A sibling ranked beyond ``n`` is never shown, nor is a level with
    ``n`` nodes above it; so under ``n`` nodes with at most ``n`` children each get a key.
    """
    parts = F.split("path", "/")
    depth = F.size(parts)
    prefix = lambda d: F.array_join(F.slice(parts, F.lit(1), d), "/")
    level_paths = F.transform(
        F.sequence(F.lit(1), depth), lambda d: F.struct(prefix(d).alias("path"), d.alias("depth"), (d < depth).alias("dir"))
    )
    nodes = (
        paths.select(F.explode(level_paths).alias("n"))
        .groupBy("n.path", "n.depth")
        .agg(F.bool_or("n.dir").alias("is_dir"))
        .withColumn("parent", F.when(F.col("depth") > 1, F.regexp_extract("path", r"\A(.*)/[^/]*\z", 1)).otherwise(""))
    )
    children = nodes.groupBy("parent").agg(F.count("*").alias("children")).withColumnRenamed("parent", "path")
    rank = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("is_dir"), "path"))
    ranked = nodes.withColumn("rank", rank).where(F.col("rank") <= n)
    # One row per level.
    before = Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    levels = ranked.groupBy("depth").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    near = ranked.join(levels.where(F.col("_before") < n).select("depth"), "depth")
    above = near.where("depth > 1").select("path", F.explode(F.transform(F.sequence(F.lit(1), depth - 1), prefix)).alias("_above"))
    ranks = near.select(F.col("path").alias("_above"), F.struct(F.col("depth").alias("d"), F.col("rank").alias("r")).alias("_rank"))
    vectors = above.join(ranks, "_above").groupBy("path").agg(F.sort_array(F.collect_list("_rank")).alias("_ranks"))
    placed = near.join(vectors, "path", "left").where((F.col("depth") == 1) | (F.size("_ranks") == F.col("depth") - 1))
    shown = placed.select("path", "depth", "parent", F.struct("depth", "rank", F.col("_ranks.r").alias("above")).alias("_key")).orderBy("_key").limit(n)
    # From here on there are at most n rows.
    shown = shown.withColumn("position", F.row_number().over(Window.orderBy("_key"))).drop("_key")
    last = shown.agg(F.max("depth").alias("_last"), F.count("*").alias("_shown"))
    seen = shown.groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("seen"))
    root = shown.sparkSession.range(1).select(F.lit("").alias("path"), F.lit(0).alias("depth"), F.lit(0).alias("position"))
    listed = shown.select("path", "depth", "position").unionByName(root).join(children, "path", "left").join(seen, "path", "left").join(F.broadcast(last))
    is_open = (F.col("_shown") == n) & (F.col("depth") >= F.col("_last") - 1)
    cut = F.coalesce("children", F.lit(0)) - F.coalesce("seen", F.lit(0))
    return listed.select("path", "depth", "position", F.when(is_open, cut).otherwise(0).cast("long").alias("truncated"))


# -- slicing -------------------------------------------------------------------------


def _budget(lines: Column, max_bytes: Column) -> Column:
    """How many leading lines fit: struct(n, bytes, full)."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("bytes"), F.lit(False).alias("full"))

    def step(acc: Column, line: Column) -> Column:
        size = F.octet_length(line) + F.when(acc["n"] > 0, 1).otherwise(0)
        fits = acc["bytes"] + size <= max_bytes
        grown = F.struct((acc["n"] + 1).alias("n"), (acc["bytes"] + size).cast("long").alias("bytes"), F.lit(False).alias("full"))
        stopped = F.struct(acc["n"].alias("n"), acc["bytes"].alias("bytes"), F.lit(True).alias("full"))
        return F.when(acc["full"], acc).when(fits, grown).otherwise(stopped)

    return F.aggregate(lines, start, step)


def truncate_docs(docs: DataFrame, max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES, direction: str = "head") -> DataFrame:
    """Keep the head or the tail; report what went and in which unit."""
    lines = F.split("text", "\n")
    ordered = lines if direction == "head" else F.reverse(lines)
    kept = docs.withColumn("_lines", lines).withColumn(
        "_kept", _budget(F.slice(ordered, 1, max_lines), F.lit(max_bytes))
    )
    whole = (F.size("_lines") <= max_lines) & (F.octet_length("text") <= max_bytes)
    n = F.col("_kept.n")
    piece = F.slice("_lines", F.lit(1), n) if direction == "head" else F.slice("_lines", F.size("_lines") - n + 1, n)
    removed = F.when(F.col("_kept.full"), F.octet_length("text") - F.col("_kept.bytes")).otherwise(F.size("_lines") - n)
    return kept.select(
        *[c for c in docs.columns if c != "text"],
        F.when(whole, F.col("text")).otherwise(F.array_join(piece, "\n")).alias("text"),
        (~whole).alias("truncated"),
        F.when(whole, 0).otherwise(removed).cast("long").alias("removed"),
        F.when(~whole, F.when(F.col("_kept.full"), "bytes").otherwise("lines")).alias("unit"),
    )


def slice_docs(docs: DataFrame, offset: int = 0, limit: int = MAX_LINES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Numbered lines from ``offset``, long lines clipped, within the byte budget."""
    clipped = F.transform(
        F.split("text", "\n"),
        lambda l: F.when(utf16_length(l) > MAX_LINE, F.concat(F.left(l, F.lit(MAX_LINE)), F.lit("..."))).otherwise(l),
    )
    window = F.slice(clipped, offset + 1, limit)
    kept = docs.select("*", F.size(F.split("text", "\n")).alias("total_lines"), window.alias("_window"))
    kept = kept.withColumn("_kept", _budget(F.col("_window"), F.lit(max_bytes)))
    number = lambda i: (i + offset + 1).cast("string")
    padded = lambda i: F.when(F.length(number(i)) < 5, F.lpad(number(i), 5, "0")).otherwise(number(i))
    numbered = F.transform(
        F.slice("_window", F.lit(1), F.col("_kept.n")), lambda l, i: F.concat(padded(i), F.lit("| "), l)
    )
    last = F.col("_kept.n") + offset
    more = F.col("total_lines") > last
    return kept.select(
        *[c for c in docs.columns if c != "text"],
        F.array_join(numbered, "\n").alias("content"),
        last.alias("last_line"),
        "total_lines",
        (more | F.col("_kept.full")).alias("truncated"),
        F.col("_kept.full").alias("truncated_by_bytes"),
    )


def extract_references(docs: DataFrame) -> DataFrame:
    """One row per mention: (doc_id, kind, pos, reference)."""
    kinds = F.array(
        F.struct(F.lit("file").alias("kind"), file_references(F.col("text")).alias("found")),
        F.struct(F.lit("shell").alias("kind"), shell_references(F.col("text")).alias("found")),
    )
    return (
        docs.select("doc_id", F.explode(kinds).alias("k"))
        .select("doc_id", "k.kind", F.posexplode("k.found").alias("pos", "reference"))
    )


# -- versions ------------------------------------------------------------------------


def classify_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Net effect between two versions of (path, text): status, lines added and removed.

    The versions are first joined on path and digest, without the texts. Only
    the lines of paths that differ are then shuffled and compared as multisets.
    """
    digest = lambda df, name: df.select("path", F.sha2("text", 256).alias(name))
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").otherwise("modified")
    changed = (
        digest(before, "_old")
        .join(digest(after, "_new"), "path", "full_outer")
        .where(~F.col("_old").eqNullSafe(F.col("_new")))
        .select("path", status.alias("status"))
    )
    lines = lambda df, weight: df.select("path", F.explode(F.split("text", "\n")).alias("line"), F.lit(weight).alias("w"))
    sides = [lines(df.select("path", "text").join(changed.select("path"), "path", "left_semi"), w) for df, w in ((before, -1), (after, 1))]
    counts = (
        sides[0]
        .unionByName(sides[1])
        .groupBy("path", "line")
        .agg(F.sum("w").alias("net"))
        .groupBy("path")
        .agg(
            F.sum(F.greatest(F.col("net"), F.lit(0))).alias("additions"),
            F.sum(F.greatest(-F.col("net"), F.lit(0))).alias("deletions"),
        )
    )
    return changed.join(counts, "path")


def last_definition_wins(definitions: DataFrame) -> DataFrame:
    """Last (name, pos, location) per name, and whether the name was defined more than once."""
    return definitions.groupBy("name").agg(
        F.max_by("location", "pos").alias("location"), (F.count("*") > 1).alias("duplicate")
    )


def filter_completion_requests(
    traces: DataFrame, paths: tuple[str, ...], prefix: str, method: str = "POST"
) -> DataFrame:
    """Requests to one of the endpoint paths, or below ``prefix``."""
    path = F.try_parse_url("url", F.lit("PATH"))
    return traces.where((F.col("method") == method) & (path.isin(*paths) | F.startswith(path, F.lit(prefix))))
