"""Secret redaction of message texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"
# Token shapes, replaced in this order.
TOKEN_PATTERNS = (
    r"\bsk-(?:ant-)?[A-Za-z0-9_-]{16,}\b",
    r"\bsk-or-v1-[A-Za-z0-9]{16,}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{20,}\b",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b",
    r"\bAIza[0-9A-Za-z_-]{30,}\b",
    r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{16,}",
    r"\bnpm_[A-Za-z0-9]{20,}\b",
    r"\bya29\.[A-Za-z0-9._-]{20,}\b",
    r"\b1//0[A-Za-z0-9_-]{20,}\b",
    r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----",
    r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
)
# Fixed value: what stands in every token; a text without it has none.
_SIGNS = r"sk-|gh[pousr]_|github_pat_|AKIA|xox|AIza|(?i:bearer)|npm_|ya29\.|1//0|-----BEGIN |eyJ"
# Names whose assigned value may be a secret.
_NAME = r"\b[a-z0-9_-]*(?:key|token|secret|password|passwd|credential)[a-z0-9_-]*\b[\"']?"
_HINT = r"(?i)key|token|secret|password|passwd|credential"
#: The two shapes of an assignment: what stands before the value, without blanks before ``=`` and otherwise, and the value.
SHAPES = (
    (rf"{_NAME}=[\"']", rf"{_NAME}\s*[:=]\s*[\"']", r"[^\s\"']{8,}"),
    (rf"{_NAME}=\s*", rf"{_NAME}\s*[:=]\s*", r"[A-Za-z0-9_+/\-@#$%^&*!~]{8,}"),
)
#: Code points that stand around what an assignment holds while it is judged; a text that holds one or ``ESCAPE`` has them escaped.
A, B, C = "\ufdd0", "\ufdd1", "\ufdd2"
ESCAPE = "\ufdd3"
_ESCAPED = {ESCAPE: "\ufdd7", A: "\ufdd4", B: "\ufdd5", C: "\ufdd6"}


def redact_assignments(text: Column) -> Column:
    """An assigned value goes where nothing stands between name and ``=``, or where it has a digit.

    One pass marks all assignments from left to right, so one that stays still takes up its characters; then the marked
    values are judged.
    """
    for direct, other, value in SHAPES:
        text = F.regexp_replace(text, f"(?i)(?:({direct})|({other}))({value})", f"$1{A}$2{B}$3{C}")
        text = F.regexp_replace(text, f"{A}{B}[^{C}]*{C}", REDACTED)
        text = F.regexp_replace(text, f"{A}([^{B}]*){B}[^0-9{C}]*[0-9][^{C}]*{C}", f"$1{REDACTED}")
        text = F.translate(text, A + B + C, "")
    return text


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is worked out once however often ``use`` names it; an expression named twice is else worked out twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def redact_tokens(text: Column) -> Column:
    for pattern in TOKEN_PATTERNS:
        text = F.regexp_replace(text, pattern, F.lit(REDACTED))
    return text


def redact(text: Column, enabled: bool = True, redactor: Callable[[Column], Column] | None = None) -> Column:
    """Tokens, then assignments, where a text names a secret at all; ``redactor``, a user's function of a column, stands in for both."""
    if not enabled:
        return text
    if redactor is not None:
        return redactor(text)

    def judged(done: Column) -> Column:
        safe, back = done, lambda t: t
        for sign, code in _ESCAPED.items():
            safe = F.replace(safe, F.lit(sign), F.lit(ESCAPE + code))
        for sign, code in reversed(_ESCAPED.items()):
            back = (lambda f, sign, code: lambda t: F.replace(f(t), F.lit(ESCAPE + code), F.lit(sign)))(back, sign, code)
        marked = done.rlike(f"[{A}-{ESCAPE}]")
        return F.when(done.rlike(_HINT), F.when(marked, back(redact_assignments(safe))).otherwise(redact_assignments(done))).otherwise(done)

    return once(once(text, lambda t: F.when(t.rlike(_SIGNS), redact_tokens(t)).otherwise(t)), judged)
