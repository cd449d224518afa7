"""HTML extraction by the maximum-scoring subsequence.

A page is a sequence of words and tags. A word scores a positive weight, less inside a link, and a tag a negative one by its
name; an article's or main element's own tags cost most, so that a region seldom runs over its border. The best contiguous
region is found by one linear scan and is the main text; inside it, elements that score as no content are left out. These
cost the scan next to nothing, so an advert or a menu amid an article doesn't cut it in two.

The weights are learned from labelled pages, pages whose main text is known: a word of the page is inside if a 3-word
window over it occurs in the text; a tag is inside if it lies between the first and the last such word or opens or closes
right beside them. A tag's weight is the log of how much likelier it is outside than inside, among tags that the scan decides
on, those in no element left out. An element's score comes from its features, its tag, role and whole class and id
tokens: a feature that in ``min_seen`` labelled pages or more held inside words in less than LOW of its words marks no content, one
that held them in HIGH or more marks content; fixed names are the prior where labelled pages say nothing. A token such as
"cookie-banner" counts as a fixed name if all its parts are known; "with-sidebar" doesn't. An element that holds an article,
a main element or a first heading, or without which the page would have no word left, is never left out.

Text: character references are decoded, white space in a block becomes one space, blocks are trimmed, empty ones go,
the others are joined by \\n in page order. Line breaks and table cells are white space; scripts and the like are skipped whole.

Defined cases: null or empty html gives the empty text; an element to be left out that is never closed ends where the article,
a main element or the first heading begins, else at its tag; so does a skipped one but for scripts and styles, which take the
rest of the page as browsers have it; a page without words gives the empty text; very long pages take linear time. Repeated
pages are extracted each; without labelled pages the weights are the defaults.
"""

from __future__ import annotations

import html as html_
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import some_of

#: Names of HTML elements by their part in a page, and class words that name what isn't content.
RAW = frozenset("script style noscript template iframe object svg canvas title textarea select audio video".split())
TO_END = frozenset("script style".split())
NO_CONTENT = frozenset("head nav footer aside form dialog menu button".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BORDERS = frozenset("article main body html".split())
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments reply replies respond disqus related recommended share sharing social newsletter subscribe subscription popup modal overlay login signup search pagination toolbar masthead topbar skip".split())
#: On a paragraph or the like only these.
STRONG = frozenset("ad ads advert adverts advertisement advertising sponsored cookie cookies".split())
#: What may stand beside a mark in a class token.
COMPANIONS = frozenset("list box bar block area section links buttons posts articles wrap wrapper container inner outer item items slot unit left right top bottom main site page global primary secondary form widget toggle widgets icons bars panel".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

#: What isn't a proper tag ends at the next "<" at the latest, so no character is read more than a few times.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|(?=<)|\Z)|<[a-zA-Z/!?][^<>]*(?:>|(?=<)|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
#: Of the labelled sample: pages, and the most frequent names whose counts the driver gets.
MAX_NAMES = 20_000
MAX_PAGES, MIN_SEEN, LEAST, LOW, HIGH = 1500, 20, 0.05, 0.02, 0.5
#: Limits of learned weights, so that a tag that is rare in labelled pages can't cut an article.
MOST, MOST_INLINE = 1.0, 0.5
BORDER, LINKED = -3.0, -0.3


def features(name: str, attributes: str) -> set[str]:
    """An element's features: its tag, "=role" and ".token" for whole class, id and label tokens, in lower case."""
    out = {name}
    for key, value in ATTRIBUTE.findall(attributes) if attributes else ():
        sign = "=" if key.lower() == "role" else "."
        out.update(sign + x for x in re.sub(r"([a-z])([A-Z])", r"\1-\2", value.strip("\"'")).lower().split())
    return out


def named(feature: str, name: str) -> bool:
    """Whether the fixed names say that a feature of an element ``name`` marks no content."""
    if feature[0] == "=":
        return feature[1:] in ROLES
    if feature[0] != ".":
        return feature in NO_CONTENT
    parts = [x for x in re.split(r"[_\-]+", feature[1:]) if x]
    marks = STRONG if name in TEXT_BLOCKS else MARKS
    return any(x in marks for x in parts) and all(x in MARKS or x in COMPANIONS or x.isdigit() for x in parts)


DEFAULT_TAGS = {"p": -0.1, "b": -0.1, "br": -0.1, "h1": -0.1, "i": -0.1, "em": -0.1, "strong": -0.1, "span": -0.1}


class Weights:
    """Scores of words and tags, and learned features of what is content and what isn't."""

    def __init__(self, word: float = 1.0, out: float = -0.02, tags: dict[str, float] | None = None, linked: float = LINKED, never: frozenset = frozenset(), always: frozenset = frozenset()):
        self.word, self.out, self.linked, self.never, self.always = word, out, linked, never, always
        self.tags = tags or DEFAULT_TAGS

    def tag(self, name: str) -> float:
        return self.tags.get(name, BORDER if name in BORDERS else -0.1 if name in INLINE or name in TEXT_BLOCKS else -0.3)

    def left_out(self, name: str, attributes: str) -> bool:
        """Whether an element's features say that it isn't content: what was learned goes before the fixed names."""
        got = features(name, attributes)
        if got & self.never:
            return True
        return any(named(f, name) for f in got - self.always)


def tokens(page: str) -> list[tuple[str, str, str]]:
    """(kind, name or text, attributes) with kind in "text", "open", "close"; raw elements are left out."""
    out, at, n = [], 0, len(page)
    unclosed: set[str] = set()
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            if page[m.start()] != "<" or m[0] == "<":
                out.append(("text", m[0], ""))
            continue
        name = name.lower()
        if m[1]:
            out.append(("close", name, ""))
        else:
            out.append(("open", name, m[3] or ""))
            if name in RAW and name not in unclosed and not (m[3] or "").rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?![\w-])[^<>]*(?:>|(?=<)|\Z)", re.I).search(page, at)
                if not end and name not in TO_END:
                    unclosed.add(name)
                    continue
                at = end.end() if end else n
                out.append(("close", name, ""))
    return out


def excluded(toks: list[tuple[str, str, str]], weights: Weights) -> list[bool]:
    """For each token, whether it lies in an element that is left out."""
    ends, inside = _ends(toks), 0
    words, main = [0], [0]
    for kind, name, _ in toks:
        words.append(words[-1] + (len(name.split()) if kind == "text" else 0))
        main.append(main[-1] + (kind == "open" and name in ("article", "main", "h1")))
    out, until, spans = [False] * len(toks), -1, []
    for i, (kind, name, attributes) in enumerate(toks):
        if name in ("article", "main") and kind != "text":
            inside += 1 if kind == "open" else -1
        if i <= until or kind != "open" or name in VOID or name in BORDERS or main[ends[i] + 1] > main[i]:
            continue
        if weights.left_out(name, attributes) or (name == "header" and name not in weights.always and inside <= 0):
            until = ends[i]
            spans.append((i, until))
    # Without these, something must be left.
    if words[-1] > sum(words[b + 1] - words[a] for a, b in spans) or all(_plainly(toks[a][1]) for a, _ in spans):
        for a, b in spans:
            out[a : b + 1] = [True] * (b + 1 - a)
    return out


def _plainly(name: str) -> bool:
    """Elements whose tag alone says that they aren't content, even if a page has nothing else."""
    return name in NO_CONTENT


def _ends(toks: list[tuple[str, str, str]]) -> list[int]:
    """For each opening tag, the place of its closing tag; for one never closed, of the last token before the main part."""
    ends, stacks = list(range(len(toks))), {}
    main = next((i for i, t in enumerate(toks) if t[0] == "open" and t[1] in ("article", "main", "h1")), None)
    for i, (kind, name, _) in enumerate(toks):
        if kind == "open" and name not in VOID:
            stacks.setdefault(name, []).append(i)
        elif kind == "close" and stacks.get(name):
            ends[stacks[name].pop()] = i
    for left in stacks.values():
        for i in left:
            if main is not None and i < main:
                ends[i] = main - 1
    return ends


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the greatest sum; the first and longest of equals. (0, 0) if no score is positive."""
    best, total, start, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if total < 0 or i == 0:
            total, start = 0.0, i
        total += s
        if total > best + 1e-12 or (found != (0, 0) and start == found[0] and total >= best - 1e-12):
            best, found = total, (start, i + 1)
    return found


def scored(toks: list[tuple[str, str, str]], out: list[bool], weights: Weights) -> list[float]:
    """The score of each token."""
    scores, links = [], 0
    for (kind, name, _), o in zip(toks, out, strict=True):
        if name == "a" and kind != "text":
            links = max(0, links + (1 if kind == "open" else -1))
        n = len(name.split()) if kind == "text" else 0
        scores.append(weights.out * max(1, n) if o else (weights.linked if links else weights.word) * n if kind == "text" else weights.tag(name))
    return scores


def extract(page: str | None, weights: Weights) -> str:
    """The main text of a page."""
    if not page:
        return ""
    toks = tokens(page)
    out = excluded(toks, weights)
    scores = scored(toks, out, weights)
    if not any(x > 0 for x in scores):
        # Nothing but links: then they are the text.
        scores = [weights.word if s < 0 and kind == "text" and not o and name.strip() else s for s, (kind, name, _), o in zip(scores, toks, out, strict=True)]
    a, b = best_region(scores)
    blocks, now = [], []
    for (kind, name, _), o in zip(toks[a:b], out[a:b], strict=True):
        if kind == "text":
            if not o:
                now.append(name)
        elif name in BLOCKS:
            blocks.append("".join(now))
            now = []
        elif name in ("br", "td", "th", "img", "option"):
            now.append(" ")
    blocks.append("".join(now))
    return "\n".join(x for x in (" ".join(html_.unescape(s).split()) for s in blocks) if x)


def counted(page: str | None, text: str | None, weights: Weights) -> Counter:
    """What a labelled page adds: ("tag", name, inside), ("word", "" or "a", inside), ("feature", name, inside) in words and ("page", feature, True)."""
    out: Counter = Counter()
    if not page or not text:
        return out
    w = text.split()
    there = set(zip(w, w[1:], w[2:], strict=False))
    toks = tokens(page)
    flat = [(i, x) for i, (kind, name, _) in enumerate(toks) if kind == "text" for x in html_.unescape(name).split()]
    inside = [False] * len(flat)
    for k in range(len(flat) - 2):
        if tuple(x for _, x in flat[k : k + 3]) in there:
            inside[k : k + 3] = [True] * 3
    if not any(inside):
        return out
    first, last = flat[inside.index(True)][0], flat[len(inside) - 1 - inside[::-1].index(True)][0]
    while first and toks[first - 1][0] == "open" and toks[first - 1][1] not in BORDERS:
        first -= 1
    while last + 1 < len(toks) and toks[last + 1][0] == "close" and toks[last + 1][1] not in BORDERS:
        last += 1
    yes, no = [0] * len(toks), [0] * len(toks)
    for (i, _), x in zip(flat, inside, strict=True):
        (yes if x else no)[i] += 1
    sums = [[0, *itertools.accumulate(v)] for v in (yes, no)]
    ends, left_out, links = _ends(toks), excluded(toks, weights), 0
    for i, (kind, name, attributes) in enumerate(toks):
        if name == "a" and kind != "text":
            links = max(0, links + (1 if kind == "open" else -1))
        if not left_out[i]:
            if kind == "text":
                out["word", "a" if links else "", True] += yes[i]
                out["word", "a" if links else "", False] += no[i]
            else:
                out["tag", name, first <= i <= last] += 1
        if kind == "open" and name not in VOID:
            for f in features(name, attributes):
                out["page", f, True] = 1
                for k, s in zip((True, False), sums, strict=True):
                    out["feature", f, k] += s[ends[i] + 1] - s[i]
    return out


def weights_of(n: Counter, least: float = LEAST, min_seen: int = MIN_SEEN) -> Weights:
    """Weights from the sum of what labelled pages add; the defaults without any. Where the fixed names exclude all inside words, tags keep their defaults, but features are learned."""
    total = {k: sum(v for (kind, _, x), v in n.items() if kind in ("tag", "word") and x == k) for k in (True, False)}

    def odds(kind: str, name: str) -> float:
        return math.log(((n[kind, name, True] + 1) / (total[True] + 1)) / ((n[kind, name, False] + 1) / (total[False] + 1)))

    scale = max(odds("word", ""), 0.3)
    tags = {}
    for t in {name for kind, name, _ in n if kind == "tag" and total[True]}:
        most = MOST_INLINE if t in INLINE else MOST
        tags[t] = BORDER if t in BORDERS else min(-least, max(-most, odds("tag", t) / scale))
    linked = n["word", "a", True] + n["word", "a", False] if total[True] else 0
    never, always = set(), set()
    for f in {name for kind, name, _ in n if kind == "page"}:
        held, all_ = n["feature", f, True], n["feature", f, True] + n["feature", f, False]
        if n["page", f, True] >= min_seen and all_ and f not in BORDERS and f not in TEXT_BLOCKS and f not in INLINE:
            # A bare tag such as div or ul says too little; its classes may say more.
            if held < LOW * all_ and (f[0] in ".=" or f in NO_CONTENT):
                never.add(f)
            elif held >= HIGH * all_:
                always.add(f)
    return Weights(1.0, -0.02, tags, min(1.0, max(-1.0, odds("word", "a") / scale)) if linked >= min_seen else LINKED, frozenset(never), frozenset(always))


def learn(pages: list[tuple[str, str]], least: float = LEAST, min_seen: int = MIN_SEEN) -> Weights:
    """Weights from (html, main text) pairs."""
    return weights_of(sum((counted(page, text, Weights()) for page, text in pages), Counter()), least, min_seen)


def fit(pages: DataFrame, texts: DataFrame, max_pages: int = MAX_PAGES) -> Weights:
    """Learn from at most max_pages of pages (page_id, html, doc_id) with texts (doc_id, text), by the hash order of page_id.

    Pages are counted where they are and counts are summed by Spark; only sums of names that several pages have get to the driver.
    """
    known = pages.where("doc_id is not null and html is not null").select("page_id", "doc_id", "html")
    ids = some_of(known.select("page_id", "doc_id"), "page_id", max_pages, known.count())
    some = texts.select("doc_id", "text").where("text is not null").join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi")
    mine = known.join(F.broadcast(ids.select("page_id").distinct()), "page_id", "left_semi")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = sum((counted(h, t, Weights()) for h, t in zip(b["html"], b["text"], strict=True)), Counter())
            if n:
                yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["kind", "name", "inside", "n"])

    sums = mine.join(some, "doc_id").select("html", "text").mapInPandas(count, "kind string, name string, inside boolean, n long").groupBy("kind", "name", "inside").agg(F.sum("n").alias("n"))
    seen = sums.where(f"kind = 'page' and n >= {MIN_SEEN}").orderBy(F.desc("n"), "name").select("name").limit(MAX_NAMES)
    rows = sums.where("kind in ('tag', 'word')").orderBy(F.desc("n"), "kind", "name", "inside").limit(MAX_NAMES).collect() + sums.where("kind in ('page', 'feature')").join(F.broadcast(seen), "name", "left_semi").select("kind", "name", "inside", "n").collect()
    return weights_of(Counter({(r.kind, r["name"], r.inside): r.n for r in rows}))


def html_extraction(pages: DataFrame, weights: Weights) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars."""
    sent = pages.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("string")
    def main_text(x: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in x:
            yield pd.Series([extract(p, sent.value) for p in batch], dtype=object)

    return pages.select("page_id", "url", main_text("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def doc_of_url(url: Column) -> Column:
    """The number that ends a url's path, the id of the document that the page shows; null if there is none."""
    return F.regexp_extract(url, r"^[^?#]*/(\d{1,18})(?:\.[a-z]+)?/?(?:[?#].*)?$", 1).try_cast("long")
