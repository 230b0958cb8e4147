"""Rules, search, slicing and block matching."""

import random
import time

import pytest

from tidemark.operators import blocks as B
from tidemark.operators import corpus as C
from tidemark.operators import pages as P
from tidemark.operators import rules as R
from tidemark.operators.pending import pending_requests
from tidemark.plans import QUERIES

RULE = "idx long, permission string, pattern string, action string"


def rule_list(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], RULE)


@pytest.mark.parametrize(
    ("rules", "request_", "action"),
    [
        ([("bash", "rm", "deny")], ("bash", "rm"), "deny"),
        ([("bash", "*", "allow"), ("bash", "rm", "deny")], ("bash", "rm"), "deny"),
        ([("bash", "rm", "deny"), ("bash", "*", "allow")], ("bash", "rm"), "allow"),
        ([("edit", "*", "allow")], ("bash", "rm"), "ask"),
        ([], ("bash", "rm"), "ask"),
        ([("*", "*", "deny"), ("bash", "git *", "allow")], ("bash", "git"), "allow"),
        ([("mcp_*", "*", "allow"), ("mcp_danger*", "*", "deny")], ("mcp_dangerous", "x"), "deny"),
        ([("edit", "src/*", "allow"), ("edit", "*.secret", "deny")], ("edit", "src/a.secret"), "deny"),
    ],
)
def test_last_rule_wins(spark, rules, request_, action):
    requests = spark.createDataFrame([request_, request_], "permission string, pattern string")
    got = R.evaluate_rules(requests, rule_list(spark, *rules))
    assert [r.action for r in got.collect()] == [action, action]


def fits(text, pattern):
    """Whether a wildcard pattern fits, letter by letter."""
    if pattern.endswith(" *") and fits(text, pattern[:-2]):
        return True
    if not pattern:
        return not text
    if pattern[0] == "*":
        return fits(text, pattern[1:]) or bool(text) and fits(text[1:], pattern)
    return bool(text) and pattern[0] in ("?", text[0]) and fits(text[1:], pattern[1:])


def test_rules_against_brute_force(spark):
    rng = random.Random(2)
    words = ["a", "b", "ab", "ba", "a b", "b a b", "", "abab", "+(a)"]
    wild = ["*", "?", " *", "a*", "*b", "a?b", "*a*", "?*?"]
    text = lambda: "".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))
    pattern = lambda: "".join(rng.choice(words + wild) for _ in range(rng.randrange(1, 5)))
    rows = [(pattern(), pattern(), rng.choice(["allow", "deny"])) for _ in range(300)]
    asked = [(i, text(), text()) for i in range(300)]
    want = {}
    for i, permission, value in asked:
        hits = [a for p, v, a in rows if fits(permission, p) and fits(value, v)]
        want[i] = hits[-1] if hits else "ask"
    requests = spark.createDataFrame(asked, "id long, permission string, pattern string")
    assert {r.id: r.action for r in R.evaluate_rules(requests, rule_list(spark, *rows)).collect()} == want
    assert len(set(want.values())) == 3


def test_rules_find_a_literal_inside_a_pattern(spark):
    rules = rule_list(spark, ("bash", "*kubectl*", "deny"), ("bash", "?s *", "allow"))
    requests = spark.createDataFrame([(1, "bash", "sudo kubectl x"), (2, "bash", "ls"), (3, "bash", None), (4, None, "ls")], "id long, permission string, pattern string")
    assert {r.id: r.action for r in R.evaluate_rules(requests, rules).collect()} == {1: "deny", 2: "allow", 3: "ask", 4: "ask"}


def test_request_stops_at_the_first_pattern_not_allowed(spark):
    rules = rule_list(spark, ("bash", "*", "allow"), ("bash", "rm*", "deny"), ("bash", "cp*", "ask"))
    requests = spark.createDataFrame(
        [(1, "bash", ["ls", "cp x", "rm x"]), (2, "bash", ["ls"]), (3, "bash", []), (4, "bash", ["rm", "cp"])],
        "id long, permission string, patterns array<string>",
    )
    assert {r.id: r.action for r in R.evaluate_requests(requests, rules).collect()} == {1: "ask", 2: "allow", 3: "allow", 4: "deny"}


def test_disabled_tools(spark):
    rules = rule_list(spark, ("*", "*", "deny"), ("read", "*", "allow"), ("edit", "*", "deny"), ("bash", "rm", "deny"))
    tools = spark.createDataFrame([(t,) for t in ("read", "write", "multiedit", "bash", "grep")], "tool string")
    assert sorted(r.tool for r in R.disabled_tools(tools, rules).collect()) == ["grep", "multiedit", "write"]


def test_specific_pattern(spark):
    patterns = spark.createDataFrame([("*", "any"), ("git *", "git"), ("git c?*", "c"), ("gi? c*", "b")], "pattern string, value string")
    inputs = spark.createDataFrame([("git",), ("git co x",), ("ls",)], "text string")
    got = {r.text: r.value for r in R.specific_pattern(inputs, patterns).collect()}
    assert got == {"git": "git", "git co x": "c", "ls": "any"}


def test_rules_keep_the_order_of_the_text(spark):
    config = '{"b":"allow","a":{"z":"deny","*":"ask"}}'
    got = R.rules_from_config(spark.createDataFrame([(1, config)], "source long, config string")).orderBy("pos").collect()
    assert [(r.permission, r.pattern, r.action) for r in got] == [("b", "*", "allow"), ("a", "z", "deny"), ("a", "*", "ask")]


def test_pending_requests(spark):
    schema = "session_id long, seq long, kind string, id long, permission string, patterns array<string>, always array<string>, reply string"
    asked = lambda s, q, i, p, always=(): (s, q, "asked", i, "bash", [p], list(always), None)
    replied = lambda s, q, i, reply: (s, q, "replied", i, None, None, None, reply)
    events = spark.createDataFrame(
        [
            asked(1, 1, 1, "ls"), replied(1, 2, 1, "once"),
            asked(1, 3, 2, "rm a"), asked(1, 4, 3, "rm b"), replied(1, 5, 2, "reject"), asked(1, 6, 4, "rm c"),
            asked(2, 7, 5, "git a", ["git *"]), asked(2, 8, 6, "git b"), asked(2, 9, 7, "cp"), replied(2, 10, 5, "always"), asked(2, 11, 8, "git c"),
            asked(3, 12, 9, "git d"),
        ],
        schema,
    )
    assert sorted(r.id for r in pending_requests(events).collect()) == [4, 7, 8, 9]


# -- corpus ----------------------------------------------------------------------


def docs(spark, *texts):
    return spark.createDataFrame([(i, f"d/{i}.txt", i, t) for i, t in enumerate(texts)], "doc_id long, path string, mtime long, text string")


def test_grep_splits_both_line_endings_and_clips(spark):
    got = C.grep(docs(spark, "one\r\ntwo foo\r\nthree", "foo" + "x" * 3000, "none"), "foo|three$")
    assert [(r.mtime, r.line_number, len(r.line)) for r in got.collect()] == [(1, 1, 2003), (0, 2, 7), (0, 3, 5)]


def test_grep_submatch_ranges_are_bytes(spark):
    got = C.grep_submatches(docs(spark, "é ab é ab\nxx\nab"), "ab").collect()
    assert [(r.line_number, r.offset, r.start, r.end) for r in got] == [(1, 0, 3, 5), (1, 0, 9, 11), (3, 15, 0, 2)]


def truncated(spark, text, **options):
    row = C.truncate_docs(docs(spark, text), **options).first()
    return row.text, row.truncated, row.removed, row.unit


def test_truncation(spark):
    hundred = "\n".join(f"line{i}" for i in range(100))
    assert truncated(spark, "line1\nline2") == ("line1\nline2", False, 0, None)
    assert truncated(spark, hundred, max_lines=10) == ("\n".join(f"line{i}" for i in range(10)), True, 90, "lines")
    assert truncated(spark, "a" * 1000, max_bytes=100) == ("", True, 1000, "bytes")
    ten = "\n".join(f"line{i}" for i in range(10))
    assert truncated(spark, ten, max_lines=3, direction="tail") == ("line7\nline8\nline9", True, 7, "lines")
    assert truncated(spark, "a\nbb\nccc", max_bytes=4) == ("a\nbb", True, 4, "bytes")
    assert truncated(spark, "a\nbb\nccc", max_bytes=4, direction="tail") == ("ccc", True, 5, "bytes")


def test_slices(spark):
    text = "\n".join(f"line{i}" for i in range(100))
    row = C.slice_docs(docs(spark, text), limit=10).first()
    assert (row.content.split("\n")[0], row.last_line, row.total_lines, row.truncated) == ("00001| line0", 10, 100, True)
    row = C.slice_docs(docs(spark, "\n".join(f"line{i}" for i in range(20))), offset=10, limit=5).first()
    assert row.content.split("\n") == [f"{i + 1:05d}| line{i}" for i in range(10, 15)]
    row = C.slice_docs(docs(spark, "x" * 3000)).first()
    assert row.content == "00001| " + "x" * 2000 + "..." and not row.truncated
    row = C.slice_docs(docs(spark, "\n".join(["a" * 1000] * 100))).first()
    assert row.truncated_by_bytes and row.last_line == 51


def test_changes(spark):
    frame = lambda **t: spark.createDataFrame(list(t.items()), "path string, text string")
    got = C.classify_changes(frame(a="1\n2\n2", b="x", c="same"), frame(a="2\n1\n3\n3", d="p\nq", c="same"))
    assert sorted(map(tuple, got.collect())) == [("a", "modified", 2, 1), ("b", "deleted", 0, 1), ("d", "added", 2, 0)]


def test_listing(spark):
    paths = spark.createDataFrame([(p,) for p in ("b.txt", "a/x.log", "a/y.txt", "node_modules/m/i.js", ".hid/z")], "path string")
    got = [(r.name, r.type, r.ignored) for r in C.list_directory(paths).collect()]
    assert got == [(".hid", "directory", False), ("a", "directory", False), ("node_modules", "directory", True), ("b.txt", "file", False)]
    assert [(r.name, r.ignored) for r in C.list_directory(paths, "a").collect()] == [("x.log", True), ("y.txt", False)]
    assert [r.path for r in C.hidden_last(paths).collect()][-1] == ".hid/z"
    assert sorted(r.path for r in C.filter_ignored_paths(paths, whitelist=("*.log",)).collect()) == [".hid/z", "a/x.log", "a/y.txt", "b.txt"]


def test_tree_preview(spark):
    paths = spark.createDataFrame([(p,) for p in ("a/1", "a/2", "a/3", "b/1", "c")], "path string")
    got = {r.path: (r.position, r.truncated) for r in C.tree_preview(paths, 5).collect()}
    assert got == {"": (0, 0), "a": (1, 0), "b": (2, 0), "c": (3, 0), "a/1": (4, 0), "b/1": (5, 0)} | {"a": (1, 2)}
    assert {r.path: r.truncated for r in C.tree_preview(paths, 2).collect()} == {"": 1, "a": 3, "b": 1}
    assert all(r.truncated == 0 for r in C.tree_preview(paths, 50).collect())


def test_html(spark):
    html = (
        "<html><head><title>T</title><style>p{}</style></head><body><h1>Head <em>x</em></h1><script>a='<p>no</p>'</script> gone <p>Text &amp; <b>bold</b></p>"
        "<ul><li>one</li><li>two<ul><li>deep</li></ul></li></ul><pre>a\n  b</pre><a href='/u'>link</a><hr></body></html>"
    )
    pages = spark.createDataFrame([(1, "https://x", html)], "page_id long, url string, html string")
    assert P.pages_to_text(pages).first()["text"] == "THead xText &amp; boldonetwodeepa\n  blink"


# -- blocks ----------------------------------------------------------------------


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def stretches(trimmed, find):
    for i, line in enumerate(trimmed):
        if line == find[0]:
            for j in range(i + 2, len(trimmed)):
                if trimmed[j] == find[-1]:
                    yield i, j - i + 1
                    break


def brute(kind, text, find):
    """Matches (start, size) found by trying everything."""
    lines, raw = text.split("\n"), find.split("\n")
    wanted = raw[:-1] if raw[-1] == "" else raw
    trimmed, goal = [x.strip() for x in lines], [x.strip() for x in wanted]
    windows = lambda n: [(i, n) for i in range(len(lines) - n + 1)] if n else []
    block = lambda i, n: "\n".join(lines[i : i + n])
    if not goal:
        return []
    if kind == "trimmed":
        return [(i, n) for i, n in windows(len(goal)) if trimmed[i : i + n] == goal]
    if kind == "normalized":
        flat = " ".join(find.split())
        return [(i, n) for i, n in windows(len(raw)) if flat and " ".join(block(i, n).split()) == flat]
    if len(raw) < 3:
        return []
    found = list(stretches(trimmed, goal))
    if kind == "context":
        out = []
        for i, n in found:
            if n == len(goal):
                pairs = [(a, b) for a, b in zip(trimmed[i + 1 : i + n - 1], goal[1:-1]) if a or b]
                if not pairs or sum(a == b for a, b in pairs) / len(pairs) >= 0.5:
                    out.append((i, n))
        return out
    if len(found) < 2:
        return found
    scores = []
    for i, n in found:
        middle = min(n, len(goal)) - 2
        pairs = list(zip(trimmed[i + 1 : i + 1 + middle], goal[1 : 1 + middle])) if middle > 0 else []
        score = sum(1 - levenshtein(a, b) / max(len(a), len(b)) for a, b in pairs if a or b) / middle if middle > 0 else 1.0
        scores.append((score, -i, (i, n)))
    best = max(scores)
    return [best[2]] if best[0] >= 0.3 else []


@pytest.mark.parametrize("kind", ["trimmed", "normalized", "anchored", "context"])
def test_blocks_against_brute_force(spark, kind):
    rng = random.Random(4)
    words = ["a", "b", "", "ab c", "  a", "a ", "ab  c", "xyz"]
    text = lambda n: "\n".join(rng.choice(words) for _ in range(n))
    texts = [text(rng.randrange(1, 12)) for _ in range(60)]
    finds = [text(rng.randrange(1, 5)) for _ in range(40)]
    blocks = spark.createDataFrame(list(enumerate(finds)), "block_id long, find string")
    match = {"trimmed": B.match_blocks_trimmed, "normalized": B.match_blocks_normalized, "anchored": B.match_blocks_anchored, "context": B.match_blocks_context}
    got = sorted(map(tuple, match[kind](docs(spark, *texts), blocks).collect()))
    want = sorted((d, b, *m) for d, t in enumerate(texts) for b, f in enumerate(finds) for m in brute(kind, t, f))
    assert got == want and want


EDITS = [
    ("a\nb", "b", "x", False, ("ok", "exact", "a\nx")),
    ("a\nb\nb", "b", "x", False, ("multiple", None, "a\nb\nb")),
    ("a\nb\nb", "b", "x", True, ("ok", "exact", "a\nx\nx")),
    ("a\nb", "b", "b", False, ("same", None, "a\nb")),
    ("a\nb", "q", "x", False, ("not found", None, "a\nb")),
    ("  if a:\n    b\nend", "if a:\nb", "x", False, ("ok", "trimmed", "x\nend")),
    ("f {\n  one\n  two\n}\nz", "f {\n  onf\n  tws\n}", "x", False, ("ok", "anchored", "x\nz")),
    ("say  hello   world!", "hello world", "x", False, ("ok", "spacing", "say  x!")),
    ('p("a\nb")', 'p("a\\nb")', "x", False, ("ok", "escapes", "x")),
    ("one two\nthree", "\n two\n", "x", False, ("ok", "spacing", "one x\nthree")),
    ("aXa", " X\n", "y", False, ("ok", "spacing", "aya")),
    ("aa", "a", "b", False, ("multiple", None, "aa")),
]


@pytest.mark.parametrize(("text", "find", "new", "everywhere", "expected"), EDITS)
def test_edits(spark, text, find, new, everywhere, expected):
    edits = spark.createDataFrame([(1, 0, find, new, everywhere)], "edit_id long, doc_id long, find string, replace string, all boolean")
    row = B.apply_edits(docs(spark, text), edits).first()
    assert (row.status, row.tier, row.text) == expected


def test_edits_take_time_by_the_length_of_a_text(spark):
    text = "\n".join(f"  line {i}" for i in range(6000))
    edits = spark.createDataFrame(
        [(1, 0, "zzz not there\nb", "x", False), (2, 0, "line 7\nline 8", "x", False), (3, 0, "line 5999", None, False), (4, 0, None, "x", False)],
        "edit_id long, doc_id long, find string, replace string, all boolean",
    )
    start = time.perf_counter()
    got = {r.edit_id: (r.status, r.tier, r.text) for r in B.apply_edits(docs(spark, text), edits).collect()}
    assert time.perf_counter() - start < 20  # lines split anew for each window took minutes
    assert got == {
        1: ("not found", None, text),
        2: ("ok", "trimmed", text.replace("  line 7\n  line 8\n", "x\n")),
        3: ("ok", "exact", None),
        4: ("not found", None, text),
    }


def test_suggestions(spark):
    paths = spark.createDataFrame([(f"d/{n}",) for n in ("readme.md", "README.txt", "read", "other", "readme.md.bak")], "path string")
    wanted = spark.createDataFrame([("d", "ReadMe.md")], "dir string, base string")
    assert sorted(r.suggestion for r in C.suggest_paths(paths, wanted).collect()) == ["d/read", "d/readme.md", "d/readme.md.bak"]


def test_fuzzy_needs_the_letters_in_order(spark):
    paths = spark.createDataFrame([("src/main.py",), ("lib/niam.py",), ("main",)], "path string")
    assert [r.path for r in C.fuzzy_find(paths, "MAIN").collect()] == ["main", "src/main.py"]


def test_suggestions_against_every_pair(spark):
    rng = random.Random(9)
    name = lambda: "".join(rng.choice("abC.") for _ in range(rng.randrange(1, 6)))
    entries = sorted({(rng.choice("xy"), name()) for _ in range(120)})
    wanted = sorted({(rng.choice("xy"), name()) for _ in range(60)})
    paths = spark.createDataFrame([(f"{d}/{n}",) for d, n in entries], "path string")
    got = C.suggest_paths(paths, spark.createDataFrame(wanted, "dir string, base string"))
    near = lambda a, b: a.lower() in b.lower() or b.lower() in a.lower()
    want = [(d, b, f"{d}/{e}") for d, b in wanted for e in [e for f, e in entries if f == d and near(e, b)][:3]]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_block_matching_shuffles_no_text_for_each_pair(spark):
    line = "a line that stands in every document"
    docs = spark.createDataFrame([(i, f"  {line}\nx\ny{i}\n{line} end") for i in range(30)], "doc_id long, text string")
    find = f"{line}\nx\ny0\n{line} end"
    blocks = spark.createDataFrame([(i, find) for i in range(3)], "block_id long, find string")
    for match, rows in ((B.match_blocks_trimmed, 3), (B.match_blocks_anchored, 90), (B.match_blocks_context, 90), (B.match_blocks_indented, 0), (B.match_blocks_escaped, 0)):
        got = match(docs, blocks)
        assert got.count() == rows
        # Texts are exchanged by their document alone, and nothing wide after they met a block.
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not [l for l in plan.splitlines() if "Exchange hashpartitioning(block_id" in l]


def test_blocks_found_both_ways_are_listed_once(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (2, " a\nb ")], "doc_id long, text string")
    blocks = spark.createDataFrame([(1, " a\nb "), (2, "a\\nb"), (3, " ")], "block_id long, find string")
    got = sorted(tuple(r) for r in B.match_blocks_escaped(docs, blocks).collect())
    assert got == [(1, 1, 0, 2), (1, 2, 0, 2), (2, 1, 0, 2)]


def shuffled(spark):
    """Records and bytes that all stages so far have written to shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    gateway = spark.sparkContext._gateway
    none = gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, *none)
    stages = [stages.apply(i) for i in range(stages.size())]
    return sum(s.shuffleWriteRecords() for s in stages), sum(s.shuffleWriteBytes() for s in stages)


@pytest.mark.parametrize("match", [B.match_blocks_anchored, B.match_blocks_context])
def test_an_end_that_many_documents_share_makes_no_pairs(spark, match):
    line, n = "a line that stands in every document", 300
    texts = [f"{line}\nx\ny\nz{i}" for i in range(n)]
    blocks = spark.createDataFrame(list(enumerate(texts)), "block_id long, find string")
    corpus = spark.createDataFrame([(i or None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    before, _ = shuffled(spark)
    got = sorted(map(tuple, match(corpus, blocks).collect()), key=lambda r: r[1])
    assert got == [(i or None, i, 0, 4) for i in range(n)]
    assert shuffled(spark)[0] - before < n * n / 3  # one for each document and block before


@pytest.mark.parametrize("name", ["match_blocks_trimmed", "match_blocks_indented", "match_blocks_escaped", "match_blocks_normalized"])
def test_texts_in_many_files_are_not_shuffled(spark, tmp_path, name):
    rng = random.Random(3)
    text = lambda: "\n".join(f"{rng.getrandbits(4000):x}" for _ in range(10))
    docs = spark.createDataFrame([(i, text()) for i in range(64)], "doc_id long, text string")
    docs.repartition(16).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")  # a task for each file
    try:
        _, before = shuffled(spark)
        assert QUERIES[name](spark, str(tmp_path)).count() == 64
        assert shuffled(spark)[1] - before < 200_000  # 640 KB of text, once for each use before
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
