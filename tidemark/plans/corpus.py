"""Queries over documents, pages and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import blocks as B
from tidemark.operators import corpus as C
from tidemark.operators import pages as P
from tidemark.operators import rules as R
from tidemark.plans.registry import query
from tidemark.plans.views import RULES, Views, _values

LINES = "string_split(text, chr(10))"
PATTERN = "tion[,.]"
PATTERNS = [("*", "all"), ("http://*", "plain"), ("*/en/*", "english"), ("https://m.*", "mobile"), ("*#top", "top"), ("*/e?/*", "two")]
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def wildcard_sql(pattern: str) -> str:
    """RE2 pattern for a wildcard, in DuckDB."""
    body = rf"replace(replace(regexp_replace({pattern}, '([.+^${{}}()|\[\]\\])', '\\\1', 'g'), '*', '.*'), '?', '.')"
    return f"CASE WHEN {body} LIKE '% .*' THEN left({body}, length({body}) - 3) || '( .*)?' ELSE {body} END"


def matches_sql(text: str, pattern: str) -> str:
    return f"regexp_full_match({text}, {wildcard_sql(pattern)}, 's')"


# -- paths -----------------------------------------------------------------------


@query(
    "filter_ignored_paths",
    r"""SELECT path FROM v_corpus WHERE regexp_full_match(path, '([^/]*/)*fr/[^/]*')
        OR NOT (len(list_intersect(string_split(path, '/'), ['node_modules', 'dist', 'build', 'out', 'target', 'bin', 'obj'])) > 0
                OR regexp_full_match(path, 'src1[0-9]*/de/.*') OR regexp_full_match(path, 'src2/.*'))""",
)
def _(v: Views):
    return C.filter_ignored_paths(v.corpus(), ("src1*/de/**", "src2/**"), ("**/fr/*",)).select("path")


@query("filter_hidden_paths", "SELECT path FROM v_corpus WHERE NOT regexp_matches(path, '(^|/)\\.[^/]')")
def _(v: Views):
    return C.filter_hidden_paths(v.corpus()).select("path")


_EXTENSIONS = "['.zip', '.txt', '.PYC', '.md', '.so', '']"


@query(
    "filter_binary_files",
    f"""SELECT path FROM (SELECT path || {_EXTENSIONS}[doc_id % 6 + 1] AS path, doc_id, strlen(text) AS n FROM v_corpus)
        WHERE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) NOT IN ('.zip', '.pyc', '.so')
          AND NOT CASE doc_id % 5 WHEN 0 THEN n < 4096 WHEN 1 THEN 100 > 0.3 * least(n + 100, 4096) ELSE false END""",
)
def _(v: Views):
    extensions = F.array(*[F.lit(e) for e in (".zip", ".txt", ".PYC", ".md", ".so", "")])
    named = F.concat("path", F.get(extensions, (F.col("doc_id") % 6).cast("int")))
    # Some texts end in a zero byte, some begin with control characters.
    k = F.col("doc_id") % 5
    content = F.when(k == 0, F.concat("text", F.lit("\0"))).when(k == 1, F.concat(F.lit("\x02" * 100), "text")).otherwise(F.col("text"))
    return C.filter_binary_files(v.corpus().select(named.alias("path"), content.cast("binary").alias("content")), "content").select("path")


@query("glob", "SELECT path, mtime FROM v_corpus WHERE regexp_full_match(path, 'src[1-9]/(.*/)?[^/]*7\\.txt') ORDER BY mtime DESC, path LIMIT 100")
def _(v: Views):
    return C.glob(v.corpus(), "src[1-9]/**/*7.txt")


_SPLIT = "regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS base"


@query(
    "suggest_paths",
    f"""WITH entries AS (SELECT DISTINCT dir, base AS entry FROM (SELECT {_SPLIT} FROM v_corpus)),
        wanted AS (SELECT DISTINCT dir, (doc_id % 50) || '.tx' AS base FROM (SELECT doc_id, {_SPLIT} FROM v_corpus))
        SELECT dir, base, dir || '/' || entry AS suggestion FROM (
          SELECT w.dir, w.base, e.entry, row_number() OVER (PARTITION BY w.dir, w.base ORDER BY entry) AS n
          FROM wanted w JOIN entries e USING (dir) WHERE contains(lower(entry), lower(w.base)) OR contains(lower(w.base), lower(entry)))
        WHERE n <= 3""",
)
def _(v: Views):
    corpus = v.corpus()
    wanted = corpus.select(
        F.regexp_extract("path", r"\A(.*)/[^/]*\z", 1).alias("dir"), F.concat(F.col("doc_id") % 50, F.lit(".tx")).alias("base")
    )
    return C.suggest_paths(corpus, wanted)


@query(
    "fuzzy_find",
    """SELECT path, CAST(levenshtein(lower(path), 'src3en7') AS INTEGER) AS distance FROM v_corpus
       WHERE regexp_matches(lower(path), '(?s)s.*r.*c.*3.*e.*n.*7') ORDER BY distance, path LIMIT 100""",
)
def _(v: Views):
    return C.fuzzy_find(v.corpus(), "src3en7")


@query(
    "hidden_last",
    """SELECT path, regexp_matches(path, '(^|/)\\.[^/]') AS hidden FROM v_corpus""",
)
def _(v: Views):
    return C.hidden_last(v.corpus(), "a")


@query(
    "list_directory",
    """SELECT DISTINCT string_split(rest, '/')[1] AS name, 'src1/' || string_split(rest, '/')[1] AS path,
         CASE WHEN contains(rest, '/') THEN 'directory' ELSE 'file' END AS type, false AS ignored
       FROM (SELECT path[6:] AS rest FROM v_corpus WHERE starts_with(path, 'src1/'))""",
)
def _(v: Views):
    return C.list_directory(v.corpus(), "src1")


@query(
    "directory_tree",
    f"""WITH files AS (SELECT path FROM v_corpus ORDER BY path LIMIT 100), s AS (SELECT {_SPLIT} FROM files),
        dirs AS (SELECT '.' AS dir UNION SELECT string_split(dir, '/')[1] FROM s UNION SELECT dir FROM s)
        SELECT d.dir, coalesce((SELECT string_agg(base, ',' ORDER BY base) FROM s WHERE s.dir = d.dir), '') AS files FROM dirs d""",
)
def _(v: Views):
    return C.directory_tree(v.corpus()).select("dir", F.array_join("files", ",").alias("files"))


@query(
    "tree_preview",
    """WITH parts AS (SELECT string_split(path, '/') AS p FROM v_corpus),
       nodes AS (
         SELECT path, depth, bool_or(is_dir) AS is_dir,
           CASE WHEN depth > 1 THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '' END AS parent
         FROM (SELECT array_to_string(p[1:d], '/') AS path, CAST(d AS INTEGER) AS depth, d < len(p) AS is_dir
               FROM (SELECT p, unnest(range(1, len(p) + 1)) AS d FROM parts)) GROUP BY 1, 2),
       ranked AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY is_dir DESC, path) AS rank FROM nodes),
       placed AS (
         SELECT path, depth, parent, rank, '' AS above, lpad(CAST(rank AS VARCHAR), 9, '0') AS own FROM ranked WHERE depth = 1
         UNION ALL
         SELECT r.path, r.depth, r.parent, r.rank, p.own, p.own || lpad(CAST(r.rank AS VARCHAR), 9, '0') FROM placed p JOIN ranked r ON r.parent = p.path),
       shown AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY depth, rank, above) AS INTEGER) AS position FROM placed) WHERE position <= 120),
       last AS (SELECT max(depth) AS d, count(*) AS n FROM shown),
       listed AS (SELECT path, depth, position FROM shown UNION ALL SELECT '', 0, 0)
       SELECT l.path, l.depth, l.position,
         CASE WHEN n = 120 AND l.depth >= d - 1 THEN (SELECT count(*) FROM nodes c WHERE c.parent = l.path) - (SELECT count(*) FROM shown c WHERE c.parent = l.path)
              ELSE 0 END AS truncated
       FROM listed l, last""",
)
def _(v: Views):
    return C.tree_preview(v.corpus(), 120)


# -- search ----------------------------------------------------------------------

_NUMBERED = f"SELECT path, mtime, unnest({LINES}) AS line, CAST(unnest(range(1, len({LINES}) + 1)) AS INTEGER) AS line_number, {LINES} AS lines FROM v_corpus"


@query(
    "grep",
    f"""SELECT path, mtime, line_number, CASE WHEN length(line) > 2000 THEN left(line, 2000) || '...' ELSE line END AS line
        FROM ({_NUMBERED}) WHERE regexp_matches(line, '{PATTERN}') AND regexp_full_match(path, '([^/]*/)*en/[^/]*')
        ORDER BY mtime DESC, path, line_number LIMIT 100""",
)
def _(v: Views):
    return C.grep(v.corpus(), PATTERN, "**/en/*")


_BYTES = "list_sum(list_transform({0}, lambda s: CAST(strlen(s) AS BIGINT)))"


@query(
    "grep_submatches",
    f"""WITH hits AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_number) AS nth FROM ({_NUMBERED}) WHERE regexp_matches(line, '{PATTERN}')),
        found AS (SELECT path, line_number, CAST(coalesce({_BYTES.format('lines[1:line_number - 1]')}, 0) + line_number - 1 AS BIGINT) AS "offset",
            regexp_extract_all(line, '{PATTERN}') AS m, string_split_regex(line, '{PATTERN}') AS gaps FROM hits WHERE nth <= 10),
        each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found)
        SELECT path, line_number, "offset", m[i] AS match, CAST(s AS INTEGER) AS start, CAST(s + strlen(m[i]) AS INTEGER) AS "end"
        FROM (SELECT *, {_BYTES.format('gaps[1:i]')} + coalesce({_BYTES.format('m[1:i - 1]')}, 0) AS s FROM each)""",
)
def _(v: Views):
    return C.grep_submatches(v.corpus(), PATTERN)


# -- slicing ---------------------------------------------------------------------


def _truncate_sql(direction: str) -> str:
    lines = LINES if direction == "head" else f"list_reverse({LINES})"
    kept = "ls[1:k]" if direction == "head" else "list_reverse(ls[1:k])"
    return f"""
        WITH d AS (SELECT doc_id, text, {lines} AS ls, strlen(text) AS size FROM documents),
        l AS (SELECT doc_id, i, sum(strlen(ls[i]) + CASE WHEN i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS bytes
              FROM (SELECT doc_id, ls, unnest(range(1, least(len(ls), 10) + 1)) AS i FROM d)),
        k AS (SELECT doc_id, count(*) FILTER (bytes <= 500) AS k, coalesce(max(bytes) FILTER (bytes <= 500), 0) AS kb, bool_or(bytes > 500) AS hit FROM l GROUP BY 1),
        j AS (SELECT d.*, k.*, len(ls) <= 10 AND size <= 500 AS whole FROM d JOIN k ON k.doc_id = d.doc_id)
        SELECT doc_id, md5(CASE WHEN whole THEN text ELSE coalesce(array_to_string({kept}, chr(10)), '') END) AS digest, NOT whole AS truncated,
          CAST(CASE WHEN whole THEN 0 WHEN hit THEN size - kb ELSE len(ls) - k END AS BIGINT) AS removed,
          CASE WHEN NOT whole THEN CASE WHEN hit THEN 'bytes' ELSE 'lines' END END AS unit
        FROM j"""


def _truncated(v: Views, direction: str):
    docs = v.table("documents").select("doc_id", "text")
    return C.truncate_docs(docs, 10, 500, direction).select("doc_id", F.md5("text").alias("digest"), "truncated", "removed", "unit")


@query("truncate_docs", _truncate_sql("head"))
def _(v: Views):
    return _truncated(v, "head")


@query("truncate_docs_tail", _truncate_sql("tail"))
def _(v: Views):
    return _truncated(v, "tail")


@query(
    "slice_docs",
    f"""WITH l AS (SELECT doc_id, i, n, CASE WHEN length(ls[i]) > 2000 THEN left(ls[i], 2000) || '...' ELSE ls[i] END AS line FROM (
            SELECT doc_id, {LINES} AS ls, len({LINES}) AS n, unnest(range(3, least(len({LINES}), 8) + 1)) AS i FROM documents)),
        c AS (SELECT *, sum(strlen(line) + CASE WHEN i > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS bytes FROM l),
        g AS (SELECT doc_id, md5(coalesce(string_agg(lpad(CAST(i AS VARCHAR), 5, '0') || '| ' || line, chr(10) ORDER BY i) FILTER (bytes <= 1500), '')) AS digest,
                count(*) FILTER (bytes <= 1500) AS k, bool_or(bytes > 1500) AS hit FROM c GROUP BY 1)
        SELECT d.doc_id, coalesce(g.digest, md5('')) AS digest, CAST(coalesce(k, 0) + 2 AS INTEGER) AS last_line, CAST(len({LINES}) AS INTEGER) AS total_lines,
          len({LINES}) > coalesce(k, 0) + 2 OR coalesce(hit, false) AS truncated, coalesce(hit, false) AS truncated_by_bytes
        FROM documents d LEFT JOIN g USING (doc_id)""",
)
def _(v: Views):
    docs = v.table("documents").select("doc_id", "text")
    return C.slice_docs(docs, 2, 6, 1500).withColumn("digest", F.md5("content")).drop("content")


@query(
    "extract_references",
    r"""WITH d AS (SELECT doc_id, 'see @' || path || ', then !`cat ' || path || '` ' || text AS text FROM v_corpus),
        m AS (SELECT doc_id, 'file' AS kind, regexp_extract_all(text, '(?:^|[^\w`])@(\.?[^\s`,.]*(?:\.[^\s`,.]+)*)', 1) AS found FROM d
              UNION ALL SELECT doc_id, 'shell', regexp_extract_all(text, '!`([^`]+)`', 1) FROM d)
        SELECT doc_id, kind, CAST(unnest(range(len(found))) AS INTEGER) AS pos, unnest(found) AS reference FROM m""",
)
def _(v: Views):
    text = F.concat(F.lit("see @"), "path", F.lit(", then !`cat "), "path", F.lit("` "), "text")
    return C.extract_references(v.corpus().select("doc_id", text.alias("text")))


# -- versions --------------------------------------------------------------------


@query(
    "classify_changes",
    """WITH old AS (SELECT path, text FROM v_corpus),
       new AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN text || chr(10) || 'extra' WHEN doc_id % 5 = 0 THEN replace(text, 'er', 'ER') ELSE text END AS text
               FROM v_corpus WHERE doc_id % 11 <> 0 UNION ALL SELECT 'new/' || path, text FROM v_corpus WHERE doc_id % 13 = 0),
       c AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS status,
               o.text AS a, n.text AS b FROM old o FULL JOIN new n ON n.path = o.path WHERE o.text IS DISTINCT FROM n.text),
       l AS (SELECT path, status, unnest(string_split(a, chr(10))) AS line, -1 AS w FROM c WHERE a IS NOT NULL
             UNION ALL SELECT path, status, unnest(string_split(b, chr(10))), 1 FROM c WHERE b IS NOT NULL),
       g AS (SELECT path, status, line, CAST(sum(w) AS BIGINT) AS net FROM l GROUP BY ALL)
       SELECT path, status, CAST(sum(greatest(net, 0)) AS BIGINT) AS additions, CAST(sum(greatest(-net, 0)) AS BIGINT) AS deletions FROM g GROUP BY 1, 2""",
)
def _(v: Views):
    old = v.corpus()
    text = (
        F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\nextra")))
        .when(F.col("doc_id") % 5 == 0, F.replace("text", F.lit("er"), F.lit("ER")))
        .otherwise(F.col("text"))
    )
    added = old.where("doc_id % 13 = 0").select(F.concat(F.lit("new/"), "path").alias("path"), "text")
    new = old.where("doc_id % 11 <> 0").select("path", text.alias("text")).unionByName(added)
    return C.classify_changes(old.select("path", "text"), new)


@query(
    "last_definition_wins",
    """SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS name, arg_max(url, page_id) AS location, count(*) > 1 AS duplicate
       FROM v_pages GROUP BY 1""",
)
def _(v: Views):
    name = F.regexp_extract("url", r"\Ahttps?://([^/?#]+)", 1)
    return C.last_definition_wins(v.pages().select(name.alias("name"), F.col("page_id").alias("pos"), F.col("url").alias("location")))


@query(
    "filter_completion_requests",
    """SELECT page_id, url FROM (SELECT *, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS p FROM v_pages)
       WHERE method = 'POST' AND (p IN ('/en/685', '/en/676') OR starts_with(p, '/fr/'))""",
)
def _(v: Views):
    return C.filter_completion_requests(v.pages(), ("/en/685", "/en/676"), "/fr/").select("page_id", "url")


# -- pages -----------------------------------------------------------------------

_TEXT_SQL = "html"
for _pattern, _with in (
    (r"(?s)<!--.*?(-->|\z)", "''"),
    *((rf"(?is)<{tag}\b[^>]*>.*?(</{tag}\s*>|\z)", "chr(1)") for tag in P.RAW_TEXT),
    (r"(?i)<(object|embed)\b[^>]*>", "chr(1)"),
    (r"<[A-Za-z][^>]*>", "chr(2)"),
    (r"<[/!?][^>]*>", "''"),
    (r"\x01[^\x02]*", "''"),
    (r"\x02", "''"),
):
    _TEXT_SQL = f"regexp_replace({_TEXT_SQL}, '{_pattern}', {_with}, 'g')"


@query("pages_to_text", f"SELECT page_id, md5(trim({_TEXT_SQL}, {SPACES})) AS digest FROM pages")
def _(v: Views):
    return P.pages_to_text(v.table("pages")).select("page_id", F.md5("text").alias("digest"))


@query("page_size_filter", "SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https?://') AND strlen(html) <= 6000")
def _(v: Views):
    return P.page_size_filter(v.table("pages"), 6000).select("page_id", "url")


# -- rules -----------------------------------------------------------------------

_RULES = f"rules AS (SELECT * FROM (VALUES {_values([(i, *r) for i, r in enumerate(RULES)])}) t(idx, permission, pattern, action))"
_REQUESTS = "req AS (SELECT page_id AS id, ['read', 'fetch', 'edit'][page_id % 3 + 1] AS permission, url AS pattern FROM pages)"
_BOTH = f"{matches_sql('q.permission', 'r.permission')} AND {matches_sql('q.pattern', 'r.pattern')}"


def rules(v: Views, rows=RULES):
    return v.spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "idx long, permission string, pattern string, action string"
    )


def _requests(v: Views):
    permission = F.get(F.array(F.lit("read"), F.lit("fetch"), F.lit("edit")), (F.col("page_id") % 3).cast("int"))
    return v.table("pages").select(F.col("page_id").alias("id"), permission.alias("permission"), F.col("url").alias("pattern"))


def _config_rules(v: Views):
    config = F.concat(F.lit('{"read":"allow","fetch":{"*":"ask","'), "url", F.lit('":"deny"}}'))
    return R.rules_from_config(v.table("pages").select(F.col("page_id").alias("source"), config.alias("config")))


_CONFIG = """
    config AS (SELECT page_id AS source, 0 AS pos, 'read' AS permission, '*' AS pattern, 'allow' AS action FROM pages
      UNION ALL SELECT page_id, 1048576, 'fetch', '*', 'ask' FROM pages
      UNION ALL SELECT page_id, 1048577, 'fetch', url, 'deny' FROM pages)"""


@query("rules_from_config", f"WITH {_CONFIG} SELECT source, CAST(pos AS BIGINT) AS pos, permission, pattern, action FROM config")
def _(v: Views):
    return _config_rules(v).withColumn("pos", F.col("pos.i") * 1048576 + F.col("pos.j").cast("long"))


@query(
    "merge_rulesets",
    f"""WITH {_CONFIG}, {_RULES} SELECT CAST(idx AS BIGINT) AS idx, permission, pattern, action FROM rules
        UNION ALL SELECT 1099511627776 + source * 2097152 + pos, permission, pattern, action FROM config""",
)
def _(v: Views):
    at = lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    own = rules(v).withColumn("pos", at(F.col("idx"), F.lit(0)))
    config = _config_rules(v).withColumn("pos", at(F.col("source"), F.col("pos.i") * 1048576 + F.col("pos.j")))
    merged = R.merge_rulesets(own, config)
    idx = F.col("idx.ruleset").cast("long") * 1099511627776 + F.when(F.col("idx.ruleset") == 0, F.col("idx.pos.a")).otherwise(F.col("idx.pos.a") * 2097152 + F.col("idx.pos.b"))
    return merged.select(idx.alias("idx"), "permission", "pattern", "action")


@query(
    "match_wildcard",
    f"""SELECT page_id, text, pattern, {matches_sql('text', 'pattern')} AS matched FROM (
          SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'ls' WHEN page_id % 5 = 1 THEN 'ls ' || url ELSE url END AS text,
            CASE page_id % 5 WHEN 0 THEN 'ls *' WHEN 1 THEN 'ls *' WHEN 2 THEN left(url, 12) || '*' || right(url, 2)
              WHEN 3 THEN '*.example.???/en/*' ELSE left(url, 9) || '*(' END AS pattern FROM pages)""",
)
def _(v: Views):
    k, url = F.col("page_id") % 5, F.col("url")
    text = F.when(k == 0, "ls").when(k == 1, F.concat(F.lit("ls "), url)).otherwise(url)
    pattern = (
        F.when(k < 2, "ls *")
        .when(k == 2, F.concat(F.left(url, F.lit(12)), F.lit("*"), F.right(url, F.lit(2))))
        .when(k == 3, "*.example.???/en/*")
        .otherwise(F.concat(F.left(url, F.lit(9)), F.lit("*(")))
    )
    return R.match_rules(v.table("pages").select("page_id", text.alias("text"), pattern.alias("pattern")))


@query(
    "evaluate_rules",
    f"""WITH {_RULES}, {_REQUESTS} SELECT q.id, q.permission, q.pattern, coalesce(arg_max(r.action, r.idx), 'ask') AS action
        FROM req q LEFT JOIN rules r ON {_BOTH} GROUP BY 1, 2, 3""",
)
def _(v: Views):
    return R.evaluate_rules(_requests(v), rules(v))


@query(
    "evaluate_rules_long",
    f"""WITH {_REQUESTS}, rules AS (
          SELECT page_id * 2 AS idx, 'fetch' AS permission, regexp_extract(url, '^(https?://[^/]+)', 1) || '/*' AS pattern,
            ['allow', 'deny', 'ask'][page_id % 3 + 1] AS action FROM pages
          UNION ALL SELECT page_id * 2 + 1, '*', '*' || right(url, 4), 'allow' FROM pages)
        SELECT q.id, q.permission, q.pattern, coalesce(arg_max(r.action, r.idx), 'ask') AS action
        FROM req q LEFT JOIN rules r ON {_BOTH} GROUP BY 1, 2, 3""",
)
def _(v: Views):
    pages = v.table("pages")
    actions = F.array(F.lit("allow"), F.lit("deny"), F.lit("ask"))
    hosts = pages.select(
        (F.col("page_id") * 2).alias("idx"),
        F.lit("fetch").alias("permission"),
        F.concat(F.regexp_extract("url", r"\A(https?://[^/]+)", 1), F.lit("/*")).alias("pattern"),
        F.get(actions, (F.col("page_id") % 3).cast("int")).alias("action"),
    )
    tails = pages.select(
        (F.col("page_id") * 2 + 1).alias("idx"),
        F.lit("*").alias("permission"),
        F.concat(F.lit("*"), F.right("url", F.lit(4))).alias("pattern"),
        F.lit("allow").alias("action"),
    )
    return R.evaluate_rules(_requests(v), hosts.unionByName(tails))


@query(
    "evaluate_requests",
    f"""WITH {_RULES}, many AS (
          SELECT page_id AS id, ['read', 'fetch', 'edit'][page_id % 3 + 1] AS permission, unnest([url, 'https://m.' || url, 'x/fr/y']) AS pattern,
            unnest([0, 1, 2]) AS pos FROM pages),
        v AS (SELECT q.id, q.pos, coalesce(arg_max(r.action, r.idx), 'ask') AS action FROM many q LEFT JOIN rules r ON {_BOTH} GROUP BY 1, 2)
        SELECT id, coalesce(arg_min(action, pos) FILTER (action <> 'allow'), 'allow') AS action FROM v GROUP BY 1""",
)
def _(v: Views):
    patterns = F.array("pattern", F.concat(F.lit("https://m."), "pattern"), F.lit("x/fr/y"))
    return R.evaluate_requests(_requests(v).select("id", "permission", patterns.alias("patterns")), rules(v))


_TOOLS = "tools AS (SELECT DISTINCT CASE p_partkey % 7 WHEN 0 THEN 'edit' WHEN 1 THEN 'write' WHEN 2 THEN 'patch' WHEN 3 THEN 'read' ELSE p_name END AS tool FROM part)"
_DENY = [("red *", "*", "deny"), ("* bolt", "*", "deny"), ("blue*", "*", "allow"), ("edit", "*", "deny"), ("read", "*", "deny"), ("read", "x", "deny")]


@query(
    "disabled_tools",
    f"""WITH {_TOOLS}, rules AS (SELECT * FROM (VALUES {_values([(i, *r) for i, r in enumerate(_DENY)])}) t(idx, permission, pattern, action)),
        l AS (SELECT tool, arg_max(r.pattern, r.idx) AS pattern, arg_max(r.action, r.idx) AS action FROM tools
              JOIN rules r ON {matches_sql("CASE WHEN tool IN ('edit', 'write', 'patch', 'multiedit') THEN 'edit' ELSE tool END", 'r.permission')} GROUP BY 1)
        SELECT tool FROM l WHERE pattern = '*' AND action = 'deny'""",
)
def _(v: Views):
    k = F.col("p_partkey") % 7
    tool = F.when(k == 0, "edit").when(k == 1, "write").when(k == 2, "patch").when(k == 3, "read").otherwise(F.col("p_name"))
    return R.disabled_tools(v.table("part").select(tool.alias("tool")).distinct(), rules(v, _DENY))


_SPECIFIC = f"""
    WITH p AS (SELECT * FROM (VALUES {_values(PATTERNS)}) t(pattern, value))
    SELECT page_id, url AS text, arg_max(value, struct_pack(n := length(pattern), p := pattern)) AS value
    FROM pages JOIN p ON {matches_sql('url', 'pattern')} GROUP BY 1, 2"""


@query("specific_pattern", _SPECIFIC)
def _(v: Views):
    patterns = v.spark.createDataFrame(PATTERNS, "pattern string, value string")
    return R.specific_pattern(v.table("pages").select("page_id", F.col("url").alias("text")), patterns)


@query("specific_pattern_long", _SPECIFIC)
def _(v: Views):
    patterns = v.spark.createDataFrame(PATTERNS, "pattern string, value string")
    return R.specific_pattern(v.table("pages").select("page_id", F.col("url").alias("text")), patterns)


_COMMANDS = ["git checkout", "docker compose up", "aws s3 ls", "npm run dev", "touch", "git remote add"]


@query(
    "command_prefix",
    f"""SELECT p_partkey, array_to_string(string_split(line, ' ')[1:[2, 3, 3, 3, 1, 3][p_partkey % 6 + 1]], ' ') AS prefix
        FROM (SELECT p_partkey, {_COMMANDS!r}[p_partkey % 6 + 1] || ' ' || p_name AS line FROM part)""",
)
def _(v: Views):
    commands = F.array(*[F.lit(c) for c in _COMMANDS])
    line = F.concat(F.get(commands, (F.col("p_partkey") % 6).cast("int")), F.lit(" "), "p_name")
    return v.table("part").select("p_partkey", F.array_join(R.command_prefix(F.split(line, " ")), " ").alias("prefix"))


# -- blocks ----------------------------------------------------------------------

# Blocks of two to five lines from anywhere in a document, shorter where it ends.
_FROM = f"(doc_id * 7) % len({LINES})"
_HEAD = f"{LINES}[{_FROM} + 1:{_FROM} + 2 + doc_id % 4]"
_WINDOWS = f"""
    w AS (SELECT doc_id, m AS n_lines, CAST(i AS INTEGER) AS start_line, ls[i + 1:i + m] AS part
          FROM (SELECT doc_id, ls, m, unnest(range(0, greatest(len(ls) - m + 1, 0))) AS i
                FROM (SELECT doc_id, {LINES} AS ls, unnest([1, 2, 3, 4, 5]) AS m FROM documents)))"""


def _docs(v: Views):
    docs = v.table("documents").select("doc_id", "text")
    # One small file is dealt out, so that more than one task has work; texts that many tasks read evenly are not shuffled.
    rows = [r["count"] for r in docs.groupBy(F.spark_partition_id()).count().collect()]
    even = len(rows) >= v.spark.sparkContext.defaultParallelism and max(rows) * len(rows) <= 4 * sum(rows)
    return docs if even else docs.repartition("doc_id")


def _blocks(v: Views, change):
    """A stretch of lines of every document, changed by ``change(lines)``."""
    lines = F.split("text", "\n")
    block = F.slice(lines, (F.col("doc_id") * 7 % F.size(lines) + 1).cast("int"), (2 + F.col("doc_id") % 4).cast("int"))
    return _docs(v).select(F.col("doc_id").alias("block_id"), change(block).alias("find"))


@query(
    "match_blocks_trimmed",
    f"""WITH {_WINDOWS},
        raw AS (SELECT doc_id AS block_id, list_transform({_HEAD}, lambda l: trim(l, {SPACES})) AS ls FROM documents),
        b AS (SELECT block_id, CASE WHEN ls[-1] = '' THEN ls[1:len(ls) - 1] ELSE ls END AS ls FROM raw)
        SELECT w.doc_id, b.block_id, w.start_line, w.n_lines FROM w
        JOIN b ON w.n_lines = len(b.ls) AND array_to_string(list_transform(w.part, lambda l: trim(l, {SPACES})), chr(10)) = array_to_string(b.ls, chr(10))""",
)
def _(v: Views):
    indented = lambda head: F.array_join(F.transform(head, lambda l: F.concat(F.lit("\t  "), l)), "\n")
    # A blank last line is only dropped from a block when nothing is in it.
    plain = lambda head: F.when(F.element_at(head, -1) == "", F.array_join(head, "\n")).otherwise(indented(head))
    return B.match_blocks_trimmed(_docs(v), _blocks(v, plain))


def _middle(head):
    """The head with its second line changed."""
    return F.array_join(F.transform(head, lambda l, i: F.when(i == 1, F.replace(l, F.lit("e"), F.lit("a"))).otherwise(l)), "\n")


_ENDED = f"""
    t AS (SELECT doc_id, list_transform({LINES}, lambda l: trim(l, {SPACES})) AS ls FROM documents),
    raw AS (SELECT doc_id AS block_id, list_transform(list_transform({_HEAD}, lambda l, i: CASE WHEN i = 2 THEN replace(l, 'e', 'a') ELSE l END),
              lambda l: trim(l, {SPACES})) AS ls, {_HEAD} AS head FROM documents WHERE len({_HEAD}) >= 3),
    b AS (SELECT block_id, CASE WHEN head[-1] = '' THEN ls[1:len(ls) - 1] ELSE ls END AS f FROM raw),
    starts AS (SELECT doc_id, ls, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM t),
    pairs AS (SELECT s.doc_id, b.block_id, s.ls, b.f, s.i, list_position(s.ls[s.i + 3:], b.f[-1]) AS p FROM starts s JOIN b ON b.f[1] = s.line),
    ended AS (SELECT doc_id, block_id, ls, f, CAST(i AS INTEGER) AS start_line, CAST(p + 2 AS INTEGER) AS n_lines FROM pairs WHERE p > 0)"""


@query(
    "match_blocks_anchored",
    f"""WITH {_ENDED},
        scored AS (SELECT *, count(*) OVER (PARTITION BY doc_id, block_id) AS several,
          CASE WHEN least(len(f), n_lines) - 2 > 0 THEN
            list_sum(list_transform(range(2, least(len(f), n_lines)), lambda k: CASE WHEN greatest(length(f[k]), length(ls[start_line + k])) = 0 THEN 0
              ELSE 1 - levenshtein(f[k], ls[start_line + k]) / greatest(length(f[k]), length(ls[start_line + k])) END)) / (least(len(f), n_lines) - 2)
          ELSE 1.0 END AS score FROM ended)
        SELECT doc_id, block_id, start_line, n_lines FROM (
          SELECT *, row_number() OVER (PARTITION BY doc_id, block_id ORDER BY score DESC, start_line) AS n FROM scored)
        WHERE n = 1 AND (several = 1 OR score >= 0.3)""",
)
def _(v: Views):
    return B.match_blocks_anchored(_docs(v), _blocks(v, _middle))


@query(
    "match_blocks_context",
    f"""WITH {_ENDED},
        mid AS (SELECT *, list_filter(range(2, len(f)), lambda k: f[k] <> '' OR ls[start_line + k] <> '') AS solid FROM ended WHERE n_lines = len(f))
        SELECT doc_id, block_id, start_line, n_lines FROM mid
        WHERE len(solid) = 0 OR len(list_filter(solid, lambda k: f[k] = ls[start_line + k])) * 2 >= len(solid)""",
)
def _(v: Views):
    return B.match_blocks_context(_docs(v), _blocks(v, _middle))


_COLLAPSE = lambda s: f"trim(regexp_replace({s}, '[\\s\\x0b]+', ' ', 'g'), {SPACES})"


@query(
    "match_blocks_normalized",
    f"""WITH {_WINDOWS}, b AS (SELECT doc_id AS block_id, len({_HEAD}) AS m, {_COLLAPSE(f"array_to_string({_HEAD}, chr(10))")} AS f FROM documents)
        SELECT w.doc_id, b.block_id, w.start_line, w.n_lines FROM w JOIN b ON b.m = w.n_lines AND b.f = {_COLLAPSE("array_to_string(w.part, chr(10))")}
        WHERE b.f <> ''""",
)
def _(v: Views):
    return B.match_blocks_normalized(_docs(v), _blocks(v, lambda head: F.replace(F.array_join(head, "\n"), F.lit(" "), F.lit(" \t"))))


_EXACT_WINDOWS = f"""WITH {_WINDOWS}, b AS (SELECT doc_id AS block_id, len({_HEAD}) AS m, array_to_string({_HEAD}, chr(10)) AS f FROM documents)
    SELECT w.doc_id, b.block_id, w.start_line, w.n_lines FROM w JOIN b ON b.m = w.n_lines AND b.f = array_to_string(w.part, chr(10))"""


@query("match_blocks_indented", f"SELECT * FROM ({_EXACT_WINDOWS})")
def _(v: Views):
    indent = lambda head: F.array_join(F.transform(head, lambda l: F.when(F.btrim(l) == "", l).otherwise(F.concat(F.lit("    "), l))), "\n")
    return B.match_blocks_indented(_docs(v), _blocks(v, indent))


@query("match_blocks_escaped", f"SELECT * FROM ({_EXACT_WINDOWS})")
def _(v: Views):
    return B.match_blocks_escaped(_docs(v), _blocks(v, lambda head: F.array_join(F.transform(head, lambda l: F.replace(l, F.lit("\\"), F.lit("\\\\"))), "\\n")))


_TRIMMED = lambda l: f"list_transform({l}, lambda x: trim(x, {SPACES}))"


def _unescaped(text: str) -> str:
    """Escapes as the characters they stand for, by nested replacements."""
    out = f"replace({text}, '\\\\', chr(1))"
    for escape, char in (("n", "chr(10)"), ("t", "chr(9)"), ("r", "chr(13)"), ("''", "''''"), ('"', "chr(34)"), ("`", "'`'"), ("$", "'$'")):
        out = f"replace({out}, '\\{escape}', {char})"
    return f"replace(replace({out}, '\\' || chr(10), chr(10)), chr(1), '\\')"


def _dedented(ls: str) -> str:
    solid = f"list_filter({ls}, lambda x: trim(x, {SPACES}) <> '')"
    indent = f"list_min(list_transform({solid}, lambda x: length(x) - length(ltrim(x, {SPACES}))))"
    return f"""CASE WHEN len({solid}) = 0 THEN array_to_string({ls}, chr(10)) ELSE
        array_to_string(list_transform({ls}, lambda x: CASE WHEN trim(x, {SPACES}) = '' THEN x ELSE x[{indent} + 1:] END), chr(10)) END"""


def _tier(tier: int, size: str, condition: str, extra: str = "true", first: int = 1) -> str:
    """Windows ``w`` of ``size`` lines, as text ``part``, for which ``condition`` holds."""
    return f"""SELECT edit_id, {tier} AS tier, i + {first} AS pos, part FROM (
        SELECT *, ls[i + 1:i + m] AS w, array_to_string(ls[i + 1:i + m], chr(10)) AS part FROM (
          SELECT *, {size} AS m, unnest(range(0, greatest(len(ls) - {size} + 1, 0))) AS i FROM f WHERE {extra} AND {size} > 0)) WHERE {condition}"""


_QUOTED = f"regexp_replace(trim(find, {SPACES}), " + r"'([.*+?^${}()|\[\]\\])', '\\\1', 'g')"
_EDIT_TIERS = f"""
    e AS (SELECT *, {LINES}[1:2] AS head, {LINES}[1:3] AS three, {LINES}[1] AS first, doc_id % 9 AS k FROM documents),
    f0 AS (SELECT doc_id AS edit_id, text, doc_id % 7 = 0 AS everywhere, '<edited>' AS repl, {LINES} AS ls, CASE k WHEN 0 THEN first
             WHEN 1 THEN array_to_string(list_transform(head, lambda x: '  ' || x), chr(10)) WHEN 2 THEN replace(first, ' ', '   ')
             WHEN 3 THEN array_to_string(head, '\\n') WHEN 4 THEN 'zzz not there' WHEN 5 THEN ' ' || first || chr(10)
             WHEN 6 THEN array_to_string(list_transform(three, lambda x, i: CASE WHEN i = 2 THEN replace(x, 'e', 'a') ELSE x END), chr(10))
             WHEN 7 THEN array_to_string(list_transform(three, lambda x, i: CASE WHEN i = 2 THEN '?' ELSE x END), chr(10)) ELSE '<edited>' END AS find FROM e),
    f1 AS (SELECT *, string_split(find, chr(10)) AS raw, {_TRIMMED("ls")} AS tr, {_unescaped("find")} AS plain FROM f0),
    f AS (SELECT *, len(raw) AS n, {_TRIMMED("CASE WHEN raw[-1] = '' THEN raw[1:len(raw) - 1] ELSE raw END")} AS wt FROM f1),
    starts AS (SELECT *, list_position(tr[i + 3:], wt[-1]) + 2 AS size FROM (SELECT *, unnest(range(len(ls))) AS i FROM f WHERE n >= 3) WHERE tr[i + 1] = wt[1]),
    ended AS (SELECT *, least(len(wt), size) - 2 AS middle FROM starts WHERE size > 2),
    scored AS (SELECT *, count(*) OVER (PARTITION BY edit_id) AS several, CASE WHEN middle > 0 THEN
          list_sum(list_transform(range(2, middle + 2), lambda j: CASE WHEN greatest(length(wt[j]), length(tr[i + j])) = 0 THEN 0
            ELSE 1 - levenshtein(wt[j], tr[i + j]) / greatest(length(wt[j]), length(tr[i + j])) END)) / middle ELSE 1.0 END AS score FROM ended),
    best AS (SELECT *, row_number() OVER (PARTITION BY edit_id ORDER BY score DESC, i) AS rank FROM scored),
    loose AS (SELECT *, {_COLLAPSE("line")} AS flat, {_COLLAPSE("find")} AS wanted FROM (SELECT edit_id, find, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM f)),
    c AS (
      SELECT edit_id, 0 AS tier, 0 AS pos, find AS part FROM f
      UNION ALL {_tier(1, "len(wt)", f"{_TRIMMED('w')} = wt")}
      UNION ALL SELECT edit_id, 2, i, array_to_string(ls[i + 1:i + size], chr(10)) FROM best WHERE rank = 1 AND (several = 1 OR score >= 0.3)
      UNION ALL SELECT edit_id, 3, i, CASE WHEN flat = wanted THEN line ELSE regexp_extract(line, regexp_replace({_QUOTED}, '\\s+', '\\\\s+', 'g')) END
        FROM loose WHERE wanted <> '' AND contains(flat, wanted)
      UNION ALL {_tier(3, "n", f"{_COLLAPSE('part')} = {_COLLAPSE('find')}", "n > 1", 1000000)}
      UNION ALL {_tier(4, "n", f"{_dedented('w')} = {_dedented('raw')}")}
      UNION ALL SELECT edit_id, 5, 0, plain FROM f WHERE contains(text, plain)
      UNION ALL {_tier(5, "len(string_split(plain, chr(10)))", f"{_unescaped('part')} = plain")}
      UNION ALL SELECT edit_id, 6, 0, trim(find, {SPACES}) FROM f WHERE trim(find, {SPACES}) <> find AND contains(text, trim(find, {SPACES}))
      UNION ALL {_tier(6, "n", f"trim(part, {SPACES}) = trim(find, {SPACES})", f"trim(find, {SPACES}) <> find")}
      UNION ALL SELECT edit_id, 7, i, array_to_string(ls[i + 1:i + size], chr(10)) FROM (
        SELECT *, list_filter(range(2, len(wt)), lambda j: wt[j] <> '' OR tr[i + j] <> '') AS solid FROM ended WHERE size = len(wt))
        WHERE len(solid) = 0 OR len(list_filter(solid, lambda j: wt[j] = tr[i + j])) * 2 >= len(solid)),
    found AS (SELECT f.*, c.tier, c.pos, c.part, strpos(text, part) AS place, everywhere OR strpos(text[strpos(text, part) + 1:], part) = 0 AS usable
              FROM f JOIN c USING (edit_id) WHERE part <> '' AND contains(text, part)),
    used AS (SELECT edit_id, min(tier) AS tier,
               arg_min(CASE WHEN everywhere THEN replace(text, part, repl) ELSE left(text, place - 1) || repl || substr(text, place + length(part)) END, tier * 10000000 + pos) AS edited
             FROM found WHERE usable GROUP BY 1)"""


@query(
    "apply_edits",
    f"""WITH {_EDIT_TIERS}
        SELECT edit_id, edit_id AS doc_id, status, CASE WHEN status = 'ok' THEN ['exact', 'trimmed', 'anchored', 'spacing', 'indentation', 'escapes', 'boundary', 'context'][tier + 1] END AS tier,
          md5(CASE WHEN status = 'ok' THEN edited ELSE text END) AS text
        FROM (SELECT f.edit_id, f.text, u.edited, u.tier, CASE WHEN find = repl THEN 'same' WHEN u.edit_id IS NOT NULL THEN 'ok'
                WHEN f.edit_id IN (SELECT edit_id FROM found) THEN 'multiple' ELSE 'not found' END AS status
              FROM f LEFT JOIN used u ON u.edit_id = f.edit_id)""",
)
def _(v: Views):
    docs = _docs(v)
    lines = F.split("text", "\n")
    head, three, first = F.slice(lines, 1, 2), F.slice(lines, 1, 3), F.element_at(lines, 1)
    k = F.col("doc_id") % 9
    other = lambda change: F.array_join(F.transform(three, lambda l, i: F.when(i == 1, change(l)).otherwise(l)), "\n")
    find = (
        F.when(k == 0, first)
        .when(k == 1, F.array_join(F.transform(head, lambda l: F.concat(F.lit("  "), l)), "\n"))
        .when(k == 2, F.replace(first, F.lit(" "), F.lit("   ")))
        .when(k == 3, F.array_join(head, "\\n"))
        .when(k == 4, "zzz not there")
        .when(k == 5, F.concat(F.lit(" "), first, F.lit("\n")))
        .when(k == 6, other(lambda l: F.replace(l, F.lit("e"), F.lit("a"))))
        .when(k == 7, other(lambda l: F.lit("?")))
        .otherwise("<edited>")
    )
    edits = docs.select(
        F.col("doc_id").alias("edit_id"), "doc_id", find.alias("find"), F.lit("<edited>").alias("replace"), (F.col("doc_id") % 7 == 0).alias("all")
    )
    return B.apply_edits(docs, edits).withColumn("text", F.md5("text"))
