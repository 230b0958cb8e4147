"""Column functions on literal inputs."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import blocks, errors, money, text, time, usage
from tidemark.operators.rules import command_prefix


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("value", "tokens"), [("x" * 4000, 1000), ("y" * 20000, 5000), ("", 0), ("ab", 1), ("a", 0), ("😀😀", 1), (None, 0)])
def test_estimate_tokens(spark, value, tokens):
    assert one(spark, text.estimate_tokens(F.lit(value).cast("string"))) == tokens


def test_utf16_length_counts_pairs(spark):
    assert one(spark, text.utf16_length(F.lit("a😀é"))) == 4


@pytest.mark.parametrize(
    ("value", "pattern", "expected"),
    [
        ("file1.txt", "file?.txt", True),
        ("file12.txt", "file?.txt", False),
        ("foo+bar", "foo+bar", True),
        ("foobar", "foo+bar", False),
        ("ls", "ls *", True),
        ("ls -la", "ls *", True),
        ("lstmeval", "ls *", False),
        ("ls", "ls*", True),
        ("a\nb", "a*b", True),
        ("abc\n", "abc", False),
        ("a(b)[c]{d}|e^f$", "a(b)[c]{d}|e^f$", True),
        ("git status now", "git * *", True),
    ],
)
def test_wildcard(spark, value, pattern, expected):
    assert one(spark, text.match_wildcard(F.lit(value), F.lit(pattern))) is expected
    assert one(spark, F.rlike(F.lit(value), F.lit(text.wildcard_literal(pattern)))) is expected


@pytest.mark.parametrize(
    ("path", "glob", "expected"),
    [
        ("src/a.py", "*.py", True),
        ("src/a.py", "src/*.py", True),
        ("src/x/a.py", "src/*.py", False),
        ("src/x/a.py", "src/**/*.py", True),
        ("src/a.py", "src/**/*.py", True),
        ("a/b.tsx", "**/*.{ts,tsx}", True),
        ("a/b.tsy", "**/*.{ts,tsx}", False),
        ("a/b1", "a/b[0-9]", True),
        ("a/bx", "a/b[!0-9]", True),
    ],
)
def test_glob(spark, path, glob, expected):
    assert one(spark, F.rlike(F.lit(path), F.lit(text.glob_regex(glob)))) is expected


def test_references(spark):
    template = "See @src/a.ts, @./b.md. Not foo@bar.com nor `@code`; run !`ls -l` and !`pwd`"
    assert one(spark, text.file_references(F.lit(template))) == ["src/a.ts", "./b.md"]
    assert one(spark, text.shell_references(F.lit(template))) == ["ls -l", "pwd"]


def test_mask_and_titles(spark):
    assert one(spark, text.mask_secret(F.lit("sk-abcdefghijkl"))) == "sk-abcd...ijkl"
    assert one(spark, text.default_title(F.lit("New session - 2025-01-02T03:04:05.678Z"))) is True
    assert one(spark, text.default_title(F.lit("New session - today"))) is False


def test_money(spark):
    assert one(spark, money.cents_to_micro(F.lit(2000))) == 2_000_000_000
    assert one(spark, money.cents_to_micro(F.lit(0.0000005))) == 1
    assert str(one(spark, money.micro_to_dollars(F.lit(123456789)))) == "1.23456789"
    assert one(spark, money.processing_fee(F.lit(2000))) == 123


def test_id_timestamp(spark):
    ms = 1_767_225_600_123
    digits = format((ms * 4096 + 7) % (1 << 48), "012x")
    column = time.id_timestamp(F.lit(f"tool_{digits}abcdefghijklmn"), F.lit(ms + 1000))
    assert one(spark, column) == ms
    assert one(spark, time.id_timestamp(F.lit(f"tool_{digits}abc"))) == ms % (1 << 36)


def test_week_bounds_on_sunday(spark):
    row = one(spark, time.week_bounds(F.to_timestamp(F.lit("2024-01-07 12:00:00"))))
    assert (str(row.start), str(row.end)) == ("2024-01-01 00:00:00", "2024-01-08 00:00:00")


@pytest.mark.parametrize(
    ("usage_micro", "updated", "window", "expected"),
    [
        (10, "2024-01-10 11:00:00", 18000, ("ok", 14400, 1)),
        (2000, "2024-01-10 11:00:00", 18000, ("rate-limited", 14400, 100)),
        (2000, "2024-01-10 05:00:00", 18000, ("ok", 18000, 0)),
        (500, "2024-01-09 00:00:00", None, ("ok", 388800, 50)),
        (5000, "2024-01-07 23:59:59", None, ("ok", 388800, 0)),
    ],
)
def test_quota_status(spark, usage_micro, updated, window, expected):
    ts = lambda v: F.to_timestamp(F.lit(v))
    got = one(spark, time.quota_status(F.lit(usage_micro), ts(updated), F.lit(1000), ts("2024-01-10 12:00:00"), window))
    assert tuple(got) == expected


@pytest.mark.parametrize(("seconds", "expected"), [(90000, "1 day"), (180000, "2 days"), (3700, "1hr 2min"), (61, "2min"), (0, "0min")])
def test_retry_text(spark, seconds, expected):
    assert one(spark, time.retry_text(F.lit(seconds))) == expected


@pytest.mark.parametrize(
    ("inputs", "excludes", "expected"),
    [
        ((1000, 500, None, None, None), False, (1000, 500, 0, 0, 0)),
        ((1000, 500, None, 200, None), False, (800, 500, 0, 200, 0)),
        ((1000, 500, None, None, 300), True, (1000, 500, 0, 0, 300)),
        ((1000, 500, None, 200, None), True, (1000, 500, 0, 200, 0)),
        ((1000, 500, 100, None, None), False, (1000, 500, 100, 0, 0)),
        ((0, 0, None, None, None), False, (0, 0, 0, 0, 0)),
        ((float("nan"), float("inf"), None, None, None), False, (0, 0, 0, 0, 0)),
    ],
)
def test_session_tokens(spark, inputs, excludes, expected):
    columns = [F.lit(v).cast("double") for v in inputs]
    assert tuple(one(spark, usage.session_tokens(*columns, F.lit(excludes)))) == expected


def test_normalize_usage(spark):
    payload = '{"input_tokens":100,"output_tokens":50,"output_tokens_details":{"reasoning_tokens":20},"input_tokens_details":{"cached_tokens":30}}'
    assert tuple(one(spark, usage.normalize_usage(F.lit(payload), F.lit("openai")))) == (70, 30, 20, 30, None, None)
    payload = '{"prompt_tokens":100,"completion_tokens":50,"completion_tokens_details":{"reasoning_tokens":20},"cached_tokens":30}'
    assert tuple(one(spark, usage.normalize_usage(F.lit(payload), F.lit("oa-compat")))) == (70, 50, 20, 30, None, None)


def test_pick_weighted(spark):
    choices = [("a", 3), ("b", None), ("c", 2)]
    column = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).cast("int").alias("weight")) for n, w in choices])
    flat = [n for n, w in choices for _ in range(w or 1)]
    for session in ("ses_00ab", "xyz", "ses_ZZzz"):
        h = 0
        for ch in session[-4:]:
            h = (h * 31 + ord(ch)) & 0xFFFFFFFF
        assert one(spark, usage.pick_weighted(F.lit(session), column)) == flat[h % len(flat)]


@pytest.mark.parametrize(
    ("error", "reason"),
    [
        ('{"name":"APIError","data":{"isRetryable":true,"message":"Connection reset by server"}}', "Connection reset by server"),
        ('{"name":"APIError","data":{"isRetryable":true,"message":"Overloaded"}}', "Provider is overloaded"),
        ('{"name":"APIError","data":{"isRetryable":false,"message":"x"}}', None),
        ('{"name":"Other","data":{"message":"not json"}}', None),
        ('{"name":"Other","data":{"message":"{\\"code\\":\\"is_unavailable\\"}"}}', "Provider is overloaded"),
        ('{"name":"Other","data":{"message":"{\\"error\\":{\\"message\\":\\"no code\\"}}"}}', None),
    ],
)
def test_classify_retryable(spark, error, reason):
    assert one(spark, errors.classify_retryable(F.lit(error))) == reason


def test_error_message(spark):
    text_of = lambda status, message, body: one(
        spark, errors.error_message(F.lit(status).cast("int"), F.lit(message), F.lit(body).cast("string"))
    )
    assert text_of(404, "", None) == "Not Found"
    assert text_of(413, "", None) == "Payload Too Large"
    assert text_of(404, "Not Found", '{"error":"gone"}') == "Not Found: gone"
    assert text_of(404, "Not Found", '{"error":{"message":"gone"}}') == 'Not Found: {"error":{"message":"gone"}}'
    assert text_of(500, "boom", "<html>") == "boom"


@pytest.mark.parametrize(
    ("tokens", "expected"),
    [
        (["unknown", "command"], ["unknown"]),
        (["touch", "foo.txt"], ["touch"]),
        (["git", "checkout", "main"], ["git", "checkout"]),
        (["aws", "s3", "ls", "my-bucket"], ["aws", "s3", "ls"]),
        (["npm", "run", "dev", "script"], ["npm", "run", "dev"]),
        (["docker", "compose", "up", "service"], ["docker", "compose", "up"]),
        (["consul", "kv", "get", "config"], ["consul", "kv", "get"]),
        (["git"], ["git"]),
        ([], []),
    ],
)
def test_command_prefix(spark, tokens, expected):
    assert one(spark, command_prefix(F.array(*[F.lit(t) for t in tokens]).cast("array<string>"))) == expected


def test_unescape_is_one_pass(spark):
    assert one(spark, blocks.unescape(F.lit(r"a\\n\n\t\"\`\$"))) == 'a\\n\n\t"`$'
    assert one(spark, blocks.unescape(F.lit("\\\\\\n"))) == "\\\n"


def test_dedent(spark):
    assert one(spark, blocks.dedent(F.lit("    a\n\n      b\n    c"))) == "a\n\n  b\nc"
    assert one(spark, blocks.dedent(F.lit("  \n "))) == "  \n "
