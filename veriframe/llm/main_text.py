"""Main text of web pages: the maximum-scoring contiguous run of words (positive) and tags (negative)."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from math import log

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from veriframe.llm.shared import hash_sample, limit_arrow_batches

#: Pages that the weights are learned from, at most about.
FIT_PAGES = 2_000

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[A-Za-z]?[a-z]+|[A-Z]+|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup, and elements that hold no article text.
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
OUTSIDE = frozenset("head nav footer aside form button select option datalist svg math canvas object audio video map dialog menu".split())
#: Those of OUTSIDE that may wrap the whole page.
WRAPPERS = frozenset("form canvas object dialog menu".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 head header hgroup hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - {"html", "body", "head", "td", "th", "tr", "caption", "tbody", "thead", "tfoot", "option"}
SCOPE = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of a class or id that mark what isn't article text; the second set only where no word of the third stands beside.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors cookie cookies "
    "consent gdpr newsletter subscribe subscription signup popup modal overlay comment comments commentlist disqus respond "
    "reply replies sidebar sidebars rail menu menus nav navbar navigation breadcrumb breadcrumbs toolbar topbar footer "
    "share sharing social related recommended pagination pager login signin paywall notice notices notification".split()
)
WEAK_MARKS = frozenset("header masthead banner promo promotion alert form search widget widgets copyright disclaimer feedback discussion".split())
CONTENT_MARKS = frozenset("article content post entry story main page body text".split())

LINKED_DEFAULT, PLAIN_DEFAULT, TAG_DEFAULT = -0.5, 0.5, -0.1
OUT_OF_SCOPE, ZONE = -2.0, -0.5
#: Tags within an article that the page names cost this share, so they don't cut it.
NAMED = 1e-4


class Run:
    """What stands between two block borders: its text parts, words, and cost of the tags before it."""

    __slots__ = ("parts", "plain", "linked", "name", "tags", "zones", "scoped")

    def __init__(self, name: str, scoped: bool):
        self.parts, self.plain, self.linked, self.name, self.tags, self.zones, self.scoped = [], 0, 0, name, [], 0, scoped


def _marked(name: str, attrs: str, scoped: bool) -> str:
    """"tag", "wrap" or "mark" if the element holds no article text, by its kind or by a class or id; else empty.

    "wrap" stands for a visible one of WRAPPERS.
    """
    if name in OUTSIDE - WRAPPERS or (name == "header" and not scoped):
        return "tag"
    if not attrs or name in ("html", "body", "main"):
        return "tag" if name == "dialog" else "wrap" if name in WRAPPERS else ""
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attrs)}
    if values.get("role", "").lower() in ROLES or "hidden" in values or values.get("aria-hidden") == "true":
        return "tag"
    if "display:none" in values.get("style", "").replace(" ", "").lower():
        return "tag"
    if name in WRAPPERS:
        return "tag" if name == "dialog" and "open" not in values else "wrap"
    words = {w.lower() for w in WORDS.findall(values.get("class", "") + " " + values.get("id", ""))}
    if words & MARKS or (words & WEAK_MARKS and not words & CONTENT_MARKS and not scoped):
        return "mark"
    return ""


def parse(page: str, learning: bool = False) -> tuple[list[Run], bool]:
    """Runs of text in page order, and whether the page names its article. One pass; unclosed tags are borne.

    Text of marked elements is left out. A mark on a class or id doesn't hold for an element around an article, and
    neither does the kind of a visible wrapper; in a page without an article, it doesn't hold for a form with over half
    of the plain words.
    ``learning`` keeps text of elements that their tag marks and takes marks on a class or id as before.
    """
    around: set[int] = set()  # where marked elements begin that turn out to hold the article
    while True:
        runs, has_scope, wrong, forms = _pass(page, learning, around)
        if not wrong and not has_scope and forms:
            outside = sum(run.plain for run in runs)
            wrong = {begin for begin, n in forms.items() if n > outside + sum(forms.values()) - n}
        if not wrong:
            return runs, has_scope
        around |= wrong


def _pass(page: str, learning: bool, around: set[int]) -> tuple[list[Run], bool, set[int], Counter[int]]:
    stack: list[tuple[str, int]] = []  # name, where a left-out element begins or -1
    blocks: list[str] = []  # the block elements of the stack
    depth: Counter[str] = Counter()
    out: list[tuple[str, int, str]] = []  # left-out elements open now
    runs, run, at, has_scope, wrong = [], Run("body", False), 0, False, set()
    forms: Counter[int] = Counter()  # plain words of left-out forms by where they begin

    def pop() -> None:
        name, begin = stack.pop()
        depth[name] -= 1
        if name in BLOCK:
            blocks.pop()
        if begin >= 0:
            out.pop()

    def border() -> None:
        nonlocal run
        scoped = depth["article"] + depth["main"] > 0
        if run.parts or run.tags or run.zones:
            runs.append(run)
        run = Run(blocks[-1] if blocks else "body", scoped)

    size, find = len(page), TAG.search
    while at < size:
        m = find(page, at)
        text = page[at : m.start() if m else size]
        if text and (not out or (learning and all(kind != "mark" for *_, kind in out))):
            text = html.unescape(text) if "&" in text else text
            n = len(text.split())
            if depth["a"] > 0:
                run.linked += n
            else:
                run.plain += n
            run.parts.append(text)
        elif text and depth["a"] == 0 and all(n == "form" and kind == "wrap" for n, _, kind in out):
            forms[out[0][1]] += len(text.split())
        if not m:
            break
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["close"] or m["close2"]:
            if not out:
                run.tags.append(name)
            if depth[name] > 0:
                block = name in BLOCK
                while stack:
                    last = stack[-1][0]
                    block = block or last in BLOCK
                    pop()
                    if last == name:
                        break
                if block:
                    border()
            continue
        attrs = (m["attrs"] if m["name"] else m["attrs2"]) or ""
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name in VOID:
            if name == "br" or name == "hr":
                run.parts.append("\n")
            if name == "hr":
                border()
            continue
        if attrs.endswith("/") and name not in BLOCK:
            continue
        if name in ENDS_P and depth["p"] > 0 or name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            ended = "p" if name in ENDS_P and depth["p"] > 0 else name
            while stack:
                last = stack[-1][0]
                pop()
                if last == ended:
                    break
        scoped = depth["article"] + depth["main"] > 0
        kind = "" if m.start() in around else _marked(name, attrs, scoped)
        if name in SCOPE and not kind:
            wrong |= {begin for _, begin, k in out if k != "tag"}
            has_scope = has_scope or not any(k == "tag" for *_, k in out)
        if kind:
            if not out:
                run.zones += 1
            out.append((name, m.start(), kind))
        elif not out:
            run.tags.append(name)
        stack.append((name, m.start() if kind else -1))
        depth[name] += 1
        if name in BLOCK:
            blocks.append(name)
            border()
    border()
    return runs, has_scope, wrong, forms


Weights = dict[tuple[str, str], float]


def word_weights(run: Run, weights: Weights, has_scope: bool) -> float:
    if has_scope and not run.scoped:
        return OUT_OF_SCOPE * (run.plain + run.linked)
    plain = weights.get(("plain", run.name), PLAIN_DEFAULT)
    linked = weights.get(("linked", run.name), LINKED_DEFAULT)
    if has_scope:  # the page says itself that this is article text
        plain, linked = max(plain, PLAIN_DEFAULT), max(linked, PLAIN_DEFAULT)
    return plain * run.plain + linked * run.linked


def main_text(page: str | None, weights: Weights) -> str:
    """The article's blocks, white space as one space, joined by an empty line; empty if nothing scores."""
    runs, has_scope = parse(page or "")
    best, best_range, total, begin = 0.0, (0, 0), 0.0, 0
    for i, run in enumerate(runs):
        if total <= 0:
            total, begin = 0.0, i
        else:
            cost = sum(weights.get(("tag", t), TAG_DEFAULT) for t in run.tags) + ZONE * run.zones
            if has_scope and run.scoped and runs[i - 1].scoped:
                total = max(total + NAMED * cost, NAMED)
            else:
                total += cost
            if total <= 0:
                total, begin = 0.0, i
        total += word_weights(run, weights, has_scope)
        if total > best:
            best, best_range = total, (begin, i + 1)
    blocks: list[list[str]] = [[]]
    for run in runs[slice(*best_range)]:
        if has_scope and not run.scoped:
            continue
        blocks.append(run.parts)
    return "\n\n".join(t for t in (" ".join("".join(b).split()) for b in blocks) if t)


def count_page(page: str) -> Counter:
    """(kind, name, inside) to words or tags of a page whose article is marked; other pages count nothing."""
    counts: Counter = Counter()
    runs, has_scope = parse(page, learning=True)
    for run in runs if has_scope else ():
        counts["plain", run.name, run.scoped] += run.plain
        counts["linked", run.name, run.scoped] += run.linked
        for tag in run.tags:
            if tag in BLOCK or tag in ("a", "b", "i", "em", "strong", "span", "u", "small", "code"):
                counts["tag", tag, run.scoped] += 1
    return counts


def train(pages: DataFrame, bound: int = FIT_PAGES) -> Weights:
    """Weights as log ratios inside and outside the article, from about ``bound`` pages that mark it with its element.

    Keys are names of known elements, so what reaches the driver has a fixed bound. Without such pages the defaults hold.
    """
    limit_arrow_batches(pages.sparkSession)
    sample = hash_sample(pages.where("html is not null"), "page_id", pages.count(), bound).select("html")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch["html"]:
                total.update(count_page(page))
        yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["kind", "name", "inside", "n"])

    known = sorted(BLOCK | {"a", "b", "i", "em", "strong", "span", "u", "small", "code"})
    rows = sample.mapInPandas(count, "kind string, name string, inside boolean, n long").where(F.col("name").isin(known))
    sums: dict[tuple[str, str], list[int]] = {}
    for r in rows.groupBy("kind", "name", "inside").agg(F.sum("n").alias("n")).collect():
        sums.setdefault((r["kind"], r["name"]), [0, 0])[r["inside"]] += r["n"]
    weights = {}
    for (kind, name), (outside, inside) in sums.items():
        if outside + inside >= 20:
            ratio = log((inside + 1) / (outside + 1)) / 4
            weights[kind, name] = min(max(ratio, -0.5), TAG_DEFAULT / 2) if kind == "tag" else min(max(ratio, -1.0), 1.0)
    return weights


def extract(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one per row of ``pages``; repeated rows and null ids stay.

    A null or empty page, and one without any article text, gives an empty text.
    """
    weights = train(pages)
    limit_arrow_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def extracted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda page: main_text(page, weights))

    rows = pages.select("page_id", "url", extracted(F.coalesce("html", F.lit(""))).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
