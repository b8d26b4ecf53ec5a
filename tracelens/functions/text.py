"""Secret redaction; D7 analyzers (term extraction).

D11 is a chain of ``regexp_replace`` calls (JVM side, codegen'd), applied in order:
JWTs are tested before bearer tokens, so a JWT inside a bearer header ends up as
``Bearer [REDACTED:jwt]``. Callers may append rules (e.g. for ``token = "<hex>"``).

D12 redacts every string leaf of a JSON document. Running the regexes over the
serialized text would be wrong (after an escaped newline ``\\b`` fails, and keys would
change), so leaves are decoded first; that walk is a small Arrow-batched pandas UDF.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

# The ordered redaction rules (kind, Java/RE2/Python-compatible pattern).
REDACTION_RULES: list[tuple[str, str]] = [
    ("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+"),
    ("anthropic", r"sk-ant-[A-Za-z0-9_\-]{20,}"),
    ("openai", r"\bsk-[A-Za-z0-9]{32,}\b"),
    ("aws", r"\bAKIA[0-9A-Z]{16}\b"),
    ("github", r"\b(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{30,}\b"),
    ("github", r"\bgithub_pat_[A-Za-z0-9_]{20,}\b"),
    ("bearer", r"Bearer\s+[A-Za-z0-9\-_\.]{20,}"),
]

# An extra rule for assignment-style secrets seen in the test corpus (opt-in).
ASSIGNMENT_RULE = ("secret", r"(?i)\b(token|secret|password|api[_-]?key)\s*=\s*\"[0-9a-f]{8,}\"")


_ASCII_B = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


_W = "[A-Za-z0-9_]"

# The rules above in Java syntax with ASCII word boundaries (JavaScript/RE2 ``\b``;
# Java's ``\b`` would also count accented letters as word characters). Each starts with
# its literal so the matcher can scan for it; the boundary before the literal is a
# fixed-length lookbehind, the one after the run a lookahead.
JAVA_FORMS = {
    REDACTION_RULES[2][1]: "sk-(?<!" + _W + "sk-)[A-Za-z0-9]{32,}(?!" + _W + ")",
    REDACTION_RULES[3][1]: "AKIA(?<!" + _W + "AKIA)[0-9A-Z]{16}(?!" + _W + ")",
    REDACTION_RULES[4][1]: "gh[pousr]_(?<!" + _W + "gh[pousr]_)[A-Za-z0-9]{30,}(?!" + _W + ")",
    REDACTION_RULES[5][1]: "github_pat_(?<!" + _W + "github_pat_)[A-Za-z0-9_]{20,}(?!" + _W + ")",
}


def java_pattern(pattern: str) -> str:
    """Java form of a rule: the explicit one above, else every ``\b`` spelled out as an
    ASCII word boundary."""
    return JAVA_FORMS.get(pattern) or pattern.replace(r"\b", _ASCII_B)


# A literal that every match of the rule contains (each pattern starts with it); used
# as a cheap pre-test only, so it never changes a result.
RULE_GUARDS = {
    REDACTION_RULES[0][1]: "eyJ",
    REDACTION_RULES[1][1]: "sk-ant-",
    REDACTION_RULES[2][1]: "sk-",
    REDACTION_RULES[3][1]: "AKIA",
    REDACTION_RULES[4][1]: "gh",
    REDACTION_RULES[5][1]: "github_pat_",
    REDACTION_RULES[6][1]: "Bearer",
}


def _guard(pattern: str, text: Column) -> Column | None:
    if pattern == ASSIGNMENT_RULE[1]:
        low = F.lower(text)
        return (F.instr(low, "token") > 0) | (F.instr(low, "secret") > 0) | (
            F.instr(low, "password") > 0) | (F.instr(low, "key") > 0)
    lit = RULE_GUARDS.get(pattern)
    return None if lit is None else F.instr(text, lit) > 0


def redact(text: Column, extra_rules: list[tuple[str, str]] | None = None) -> Column:
    """D11 as a Column expression: one ``regexp_replace`` per rule, in order (a linear
    expression; ``redact_df`` adds cheap pre-tests)."""
    out = text
    for kind, pattern in REDACTION_RULES + list(extra_rules or []):
        out = F.regexp_replace(out, java_pattern(pattern), f"[REDACTED:{kind}]")
    return out


def redact_df(df, col: str, out: str | None = None, extra_rules: list[tuple[str, str]] | None = None):
    """D11 on a DataFrame column, one rule per projection step. A rule's regex runs only
    on texts containing its fixed prefix (``instr`` is a byte search). Each step
    references the previous text three times (test, replace, keep), so Spark keeps the
    steps apart instead of inlining: every text is scanned once per rule, never more."""
    target = out or col
    cur = col
    for i, (kind, pattern) in enumerate(REDACTION_RULES + list(extra_rules or [])):
        nxt = f"_redact_{i}"
        replaced = F.regexp_replace(F.col(cur), java_pattern(pattern), f"[REDACTED:{kind}]")
        g = _guard(pattern, F.col(cur))
        df = df.withColumn(nxt, replaced if g is None else F.when(g, replaced).otherwise(F.col(cur)))
        if cur.startswith("_redact_"):
            df = df.drop(cur)
        cur = nxt
    return df.withColumn(target, F.col(cur)).drop(cur)


def count_redactions(redacted: Column) -> Column:
    return F.size(F.regexp_extract_all(redacted, F.lit(r"\[REDACTED:[a-z]+\]"), 0))


_PY_RULES = [(k, re.compile(p, re.ASCII)) for k, p in REDACTION_RULES]


def redact_py(text: str, extra: list[tuple[str, re.Pattern]] | None = None) -> str:
    for kind, pat in _PY_RULES + list(extra or []):
        text = pat.sub(f"[REDACTED:{kind}]", text)
    return text


def _walk(value):
    if isinstance(value, str):
        return redact_py(value)
    if isinstance(value, list):
        return [_walk(v) for v in value]
    if isinstance(value, dict):
        return {k: _walk(v) for k, v in value.items()}
    return value


@pandas_udf(StringType())
def redact_json(docs: pd.Series) -> pd.Series:
    """Redact every string leaf of a JSON document; keys and structure are kept.
    Invalid JSON is redacted as plain text."""

    def one(s):
        if s is None:
            return None
        try:
            return json.dumps(_walk(json.loads(s)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return redact_py(s)

    return docs.map(one)


@pandas_udf(StringType())
def json_error(lines: pd.Series) -> pd.Series:
    """What is wrong with a line that is not JSON, and where."""

    def one(s):
        if s is None:
            return None
        try:
            json.loads(s)
        except ValueError as e:
            return str(e)
        return "not a JSON value"

    return lines.map(one)


def redact_json_column(df, col: str, out: str | None = None):
    """D12 on a DataFrame column (ships the package to the executors first)."""
    from ..session import ship_package

    ship_package(df.sparkSession)
    return df.withColumn(out or col, redact_json(F.col(col)))


# ---------------------------------------------------------------- analyzers

def simple_tokens(text: Column) -> Column:
    """Original-case tokens: maximal runs of letters and digits of any script."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+"), 0)


def simple_terms(text: Column) -> Column:
    """The 'simple' analyzer: lower-cased tokens (positions line up with simple_tokens)."""
    return F.transform(simple_tokens(text), lambda t: F.lower(t))


_TOKEN_RE = re.compile(r"[^\W_]+")


def query_terms(q: str) -> list[str]:
    """plainto_tsquery-style parsing of a search string: distinct terms, all required."""
    seen: list[str] = []
    for t in _TOKEN_RE.findall(q or ""):
        t = t.lower()
        if t not in seen:
            seen.append(t)
    return seen


# English stop words removed by the 'english' analyzer (the usual
# snowball list used by full-text search engines).
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as",
    "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through",
    "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off",
    "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how",
    "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should",
    "now",
]


@pandas_udf(StringType())
def porter_stem_udf(words: pd.Series) -> pd.Series:
    """Arrow-batched stemmer, applied to a vocabulary (distinct terms), never per posting."""
    from .stem import porter_stem

    return words.map(lambda w: None if w is None else porter_stem(w))


@pandas_udf(ArrayType(StringType()))
def porter_stems_udf(words: pd.Series) -> pd.Series:
    """Stems of a row's words; stop words have none."""
    from .stem import porter_stem

    stop = set(ENGLISH_STOP_WORDS)
    return words.map(lambda ws: None if ws is None else [None if w in stop else porter_stem(w) for w in ws])


def english_query_terms(q: str) -> list[str]:
    """plainto_tsquery('english')-style: stop words dropped, Porter stems, distinct."""
    from .stem import porter_stem

    stop = set(ENGLISH_STOP_WORDS)
    out: list[str] = []
    for t in query_terms(q):
        if t in stop:
            continue
        s = porter_stem(t)
        if s not in out:
            out.append(s)
    return out
