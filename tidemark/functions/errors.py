"""Reading error payloads."""

from __future__ import annotations

from http.client import responses

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reason phrases that differ from Python's table.
REASONS = {**responses, 413: "Payload Too Large", 422: "Unprocessable Entity", 509: "Bandwidth Limit Exceeded"}


def status_reason(status: Column) -> Column:
    table = F.create_map(*[F.lit(v) for code, text in sorted(REASONS.items()) for v in (int(code), text)])
    return F.try_element_at(table, status.cast("int"))


def classify_retryable(error: Column) -> Column:
    """Why an error is worth another attempt, or null. The first rule that fits decides."""
    at = lambda path: F.get_json_object(error, path)
    message = at("$.data.message")
    inner = lambda path: F.get_json_object(message, path)
    is_error = F.coalesce(inner("$.type") == "error", F.lit(False))
    code = inner("$.code")
    detail = inner("$.error")
    nested = lambda cond: F.coalesce(cond, F.lit(False))
    from_json = (
        F.when(is_error & nested(inner("$.error.type") == "too_many_requests"), "Too Many Requests")
        .when(code.isNull(), F.lit(None).cast("string"))
        .when(code.contains("exhausted") | code.contains("unavailable"), "Provider is overloaded")
        .when(is_error & nested(inner("$.error.code").contains("rate_limit")), "Rate Limited")
        .when(
            nested(inner("$.error.message").contains("no_kv_space"))
            | nested(detail.isNotNull() & ~detail.isin("", "false", "0", "null")),
            "Provider Server Error",
        )
    )
    from_api = F.when(
        at("$.data.isRetryable") == "true",
        F.when(message.contains("Overloaded"), "Provider is overloaded").otherwise(message),
    )
    return F.when(at("$.name") == "APIError", from_api).otherwise(from_json)


def error_message(status: Column, message: Column, body: Column) -> Column:
    """Readable text from an HTTP status, a message and a response body."""
    reason = status_reason(status)
    has_body = body.isNotNull() & (body != "")
    field = F.coalesce(
        F.nullif(F.get_json_object(body, "$.message"), F.lit("")),
        F.nullif(F.get_json_object(body, "$.error"), F.lit("")),
    )
    is_text = field.isNotNull() & ~F.rlike(field, F.lit(r"\A[\{\[]"))
    specific = status.isNotNull() & (status != 0) & (F.coalesce(reason, F.lit("")) != message)
    text = (
        F.when((message == "") & has_body, body)
        .when(message == "", F.coalesce(reason, F.lit("Unknown error")))
        .when(~has_body | specific, message)
        .when(is_text, F.concat(message, F.lit(": "), field))
        .otherwise(F.concat(message, F.lit(": "), body))
    )
    return F.trim(text)
