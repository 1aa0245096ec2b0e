"""Secret scan: fixed patterns, then sliding-window Shannon entropy per character class with an allow-list."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import log2

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from veriframe.llm.shared import limit_arrow_batches

# The base kinds in their order. Letters of any case mean ASCII letters.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Candidate strings, window length, and the least bits per character in a window by class.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
THRESHOLDS = {"hex": 3.0, "alnum": 3.7, "base64": 3.9}
_HEX_DIGITS, _SIGNS = frozenset("0123456789abcdefABCDEF"), frozenset("+/_=-")

#: Strings that look random and are not secret: UUIDs and runs of words joined by signs.
ALLOWED = (
    re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I),
    # Parts are not empty and signs are not given back, so a run of signs has one reading and the match is linear.
    re.compile(r"[+/_=-]*+(?:(?:[A-Za-z][a-z]*+|[A-Z]++|[0-9]{1,8}+)(?:[+/_=-]++|\Z))*+"),
)
#: Marked examples: a part between signs that holds such a word is left out, what stands before and after is not.
EXAMPLE, PART = re.compile(r"example|sample|placeholder|changeme|dummy", re.I), re.compile(r"[^+/_=-]+")

_GAIN = [0.0, *(n * log2(n) for n in range(1, WINDOW + 1))]


def entropy_ranges(text: str) -> Iterator[tuple[int, int]]:
    """Unions of the windows of one candidate string whose entropy reaches the threshold of the window's own class.

    As the window moves on by one, the sum of n log n over character counts changes by two characters, and so do the
    counts of signs and of letters that no hex number has, which tell the class: a key is found beside a prefix as well.
    """
    # Entropy H = log2(W) - total / W, so H >= t means total <= W (log2(W) - t).
    hex_most, alnum_most, base64_most = (WINDOW * (log2(WINDOW) - THRESHOLDS[c]) + 1e-9 for c in ("hex", "alnum", "base64"))
    counts: dict[str, int] = {}
    total, begin, end, signs, letters = 0.0, -1, -1, 0, 0
    for at, new in enumerate(text):
        n = counts.get(new, 0)
        total += _GAIN[n + 1] - _GAIN[n]
        counts[new] = n + 1
        signs += new in _SIGNS
        letters += new not in _HEX_DIGITS
        if at >= WINDOW - 1:
            if total <= (base64_most if signs else alnum_most if letters else hex_most):
                first = at - WINDOW + 1
                if first > end:
                    if begin >= 0:
                        yield begin, end
                    begin = first
                end = at + 1
            old = text[at - WINDOW + 1]
            n = counts[old]
            total += _GAIN[n - 1] - _GAIN[n]
            counts[old] = n - 1
            signs -= old in _SIGNS
            letters -= old not in _HEX_DIGITS
    if begin >= 0:
        yield begin, end


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return sorted(spans + [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)])


def unmarked(text: str) -> list[tuple[int, str]]:
    """(start, string) of what lies between the marked examples of a candidate, if it has the length of a window."""
    if not EXAMPLE.search(text):
        return [(0, text)]
    found, at = [], 0
    for begin, end in [*(m.span() for m in PART.finditer(text) if EXAMPLE.search(m[0])), (len(text), len(text))]:
        if begin - at >= WINDOW:
            found.append((at, text[at:begin]))
        at = end
    return found


def entropy_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that the method adds: not inside a base span, not allowed."""
    found = []
    for m in CANDIDATE.finditer(text):
        for at, string in unmarked(m[0]):
            if any(rule.fullmatch(string) for rule in ALLOWED):
                continue
            for a, b in entropy_ranges(string):
                a, b = a + at + m.start(), b + at + m.start()
                if not any(start <= a and b <= end for start, _, end in base):
                    found.append((a, 3, b))
    return found


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """Text with every union of overlapping spans replaced by ``mark``."""
    parts, at = [], 0
    for start, _, end in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


SCAN_TYPE = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, clean_text string"


def scan(column: str = "text") -> Column:
    """Struct of SCAN_TYPE for a text column, the whole text (null: empty)."""

    @F.pandas_udf(SCAN_TYPE)
    def scanned(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base = base_spans(text)
            spans = sorted(base + entropy_spans(text, base))
            kinds = [kind for _, kind, _ in base]
            digest = hashlib.sha256(written(base).encode()).hexdigest()
            rows.append((kinds.count(0), kinds.count(1), kinds.count(2), digest, written(spans), redact(text, spans) if spans else text))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCAN_TYPE.split(", ")])

    return scanned(F.coalesce(F.col(column), F.lit("")))


def find_secrets(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans), one per row; repeated rows and null ids stay.

    Spans are kind:start:end in code points, end exclusive, by start, then kind. A text without secrets has empty
    spans and the digest of the empty string.
    """
    limit_arrow_batches(docs.sparkSession)
    return docs.select("doc_id", scan().alias("s")).select("doc_id", *(f"s.{c.split()[0]}" for c in SCAN_TYPE.split(", ")[:-1]))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """Documents with every found secret replaced by a mark; n_chars follows the text. Clean rows stay as they are."""
    limit_arrow_batches(docs.sparkSession)
    marked = docs.withColumn("_s", scan())
    dirty = F.col("_s.spans") != ""
    marked = marked.withColumn("text", F.when(dirty, F.col("_s.clean_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        marked = marked.withColumn("n_chars", F.when(dirty, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return marked.select(docs.columns)
