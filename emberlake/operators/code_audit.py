"""Audit of logged code texts: fences, risky constructs, unknown names. An audit, not a sandbox gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.functions.parsing import strip

# Risky constructs by name, as regular expressions over lower-case code.
RISKY = {
    "exec": r"\bexec\s*\(", "eval": r"\beval\s*\(", "compile": r"\bcompile\s*\(", "__import__": r"\b__import__\s*\(",
    "open": r"\bopen\s*\(", "file": r"\bfile\s*\(", "input": r"\binput\s*\(", "raw_input": r"\braw_input\s*\(",
    "system": r"\bsystem\s*\(", "subprocess": r"\bsubprocess\.", "os.system": r"\bos\.system\s*\(",
    "urllib": r"\burllib\.", "httplib": r"\bhttplib\.", "socket": r"\bsocket\.", "requests": r"\brequests\.",
    "pickle": r"\bpickle\.", "marshal": r"\bmarshal\.",
    "getattr": r"\bgetattr\s*\(", "setattr": r"\bsetattr\s*\(", "delattr": r"\bdelattr\s*\(", "hasattr": r"\bhasattr\s*\(",
    "globals": r"\bglobals\s*\(", "locals": r"\blocals\s*\(", "vars": r"\bvars\s*\(", "dir": r"\bdir\s*\(",
    "help": r"\bhelp\s*\(", "type": r"\btype\s*\(",
    "class": r"\bclass\s+\w+", "def": r"\bdef\s+\w+",
    "while": r"\bwhile\s+true:", "for": r"\bfor\s+\w+\s+in\s+range\(\d+,\s*\d+\):",
    "import": r"\bimport\s+\w+", "from": r"\bfrom\s+\w+\s+import",
}
TOLERATED_NAME_PARTS = ["temp", "result", "filtered", "search"]
COLUMN_REFERENCE = r"(?:df\d+|result)\[['\"]([^'\"]+)['\"]\]"
COLUMN_ASSIGNMENT = r"(?:df\d+|result)\[['\"]([^'\"]+)['\"]\]\s*="
FRAME_REFERENCE = r"\b(df\d+)\b"


def without_fences(code: Column) -> Column:
    """The code without a leading and trailing triple-backtick fence."""
    opened = F.regexp_replace(strip(code), r"(?i)^```(?:python)?\s*", "")
    return strip(F.regexp_replace(strip(opened), r"```$", ""))


def bare_code(code: Column) -> Column:
    """Lower-case code without comments and string contents."""
    out = F.regexp_replace(code, r"(?m)#.*$", "")
    for quoted in (r'(?s)""".*?"""', r"(?s)'''.*?'''", r'"[^"]*"', r"'[^']*'"):
        out = F.regexp_replace(out, quoted, "")
    return F.lower(out)


def risky_constructs(code: Column) -> Column:
    """Names of all risky constructs in the code; every rule is evaluated."""
    bare = bare_code(code)
    return F.array_compact(F.array(*[F.when(bare.rlike(p), F.lit(n)) for n, p in RISKY.items()]))


def risk_counts(df: DataFrame, code: str) -> DataFrame:
    """``rule, rows``: how many logged texts each rule fires on."""
    return df.select(F.explode(risky_constructs(F.col(code))).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))


def unknown_columns(code: Column, known: Sequence[str]) -> Column:
    """Referenced columns that are neither known nor assigned on the same or an earlier line.

    An assignment counts for the lines from its own on, so each line is checked against the
    assignments up to it.
    """
    lines = F.split(code, "\n")
    start = F.struct(
        F.array(*[F.lit(k) for k in known]).cast("array<string>").alias("valid"), F.array().cast("array<string>").alias("bad")
    )

    def step(acc: Column, line: Column) -> Column:
        valid = F.array_union(acc["valid"], F.regexp_extract_all(line, F.lit(COLUMN_ASSIGNMENT), 1))
        used = F.regexp_extract_all(line, F.lit(COLUMN_REFERENCE), 1)
        return F.struct(valid.alias("valid"), F.array_union(acc["bad"], F.array_except(used, valid)).alias("bad"))

    bad = F.aggregate(lines, start, step)["bad"]
    return F.filter(bad, lambda c: ~F.lower(c).rlike("|".join(TOLERATED_NAME_PARTS)))


def unknown_frames(code: Column, known: Sequence[str]) -> Column:
    found = F.array_distinct(F.regexp_extract_all(code, F.lit(FRAME_REFERENCE), 1))
    return F.array_except(found, F.array(*[F.lit(k) for k in known]).cast("array<string>"))
