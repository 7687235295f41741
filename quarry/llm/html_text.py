"""Main text of web pages by the maximum-scoring subsequence.

A page is a row of words and tags. A word scores 1, a tag less than 0, by a weight learned from labelled pages: the
log-odds of standing outside the article, of its name or of the names in its class, id and role on average, whichever is
more. A name is worth the average of its parts (``related-work``: of two); a part that no labelled page holds is worth 0,
words of layout (``FRAME``) and names of unknown parts alone count for nothing, and one seen in fewer than ``SUPPORT`` parts
beside articles never speaks against an element. The contiguous run with the greatest sum is the article's region; a linear scan finds it. One region can't leave out what
stands within it, so an element whose odds pass ``CUT`` (a comment box, an advert) scores nothing, tags and all, and
isn't part of the text, wherever it stands: what follows it is reached for nothing. If the region holds a third of the words of an
element around it whose names tell that it holds an article (log-odds over ``CUT``), it is widened to that element. A form that holds over half of the
page's words is a wrapper and isn't cut, nor is an element that holds a third of them with the page's main element or its
only article. A button between words of a sentence is read. A header within an article element is the article's own and stays.

Markup is read by the rules of html, in time linear in the page: quoted and unquoted attribute values, comments, script
and style to their end tags (or the page's end), a paragraph to the next tag that isn't inline. Lenient beyond them: a quote that is never closed ends with its tag's
next ``>``, a title without an end tag at the next tag; an end tag closes up to its start tag, or nothing. A tag that
the page's end cuts off is dropped.

Text: character references are decoded; white space within a block becomes one space; blocks are trimmed, empty ones
dropped, the rest joined by one space in page order. Inline tags join their words to the neighbours', ``<br>`` parts
them. No text are scripts, styles, titles, templates, and what is shown in place of frames; all else (noscript, svg,
math, object, canvas, video, audio, ...) is read like any element. Words of scripts without spaces count as two letters.

A null or empty page, and one without words outside cut elements, gives the empty text. Of equal sums the first and
shortest run is taken. Other columns pass unread; repeated rows stay.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.llm._shared import lean, slices, task
from quarry.llm.html_labels import pages

#: Log-odds over which names cut an element out, and those of a tag that no labelled page holds.
CUT, UNSEEN = 3.0, -0.9
#: Parts beside articles that must bear a name before it can speak against one.
SUPPORT = 8
#: Words of layout in names, which tell nothing of what an element holds.
FRAME = set("area bar block bottom box center clear col cell fixed fluid frame full grid group hidden holder inner item items js layer layout left lg line link links list md middle outer panel pane region right root row section shell site slot sm sticky strip table top unit view wrap wrapper zone".split())
#: Elements of raw text that isn't shown, void elements, and elements that don't part blocks.
RAW = "script style title iframe noembed noframes".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that end before the start of others (a paragraph: of all that aren't inline).
PARTED = {"p": "", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr tbody tfoot", "td": "td th tr", "th": "td th tr", "option": "option optgroup"}
PARTED = {k: set(v.split()) for k, v in PARTED.items()}
_ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?+"""
_OPEN = re.compile("<(?=[a-zA-Z!?/])")
_TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE})*+)>")
_NAMED = re.compile(r"""(?:\A|[\s/"'])(?:(class|id|role)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)|[^\s/>=]++\s*+=\s*+(?:"[^"]*+"|'[^']*+'))""", re.I)
_ENDS = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in RAW}
_HOLDERS = re.compile("<(?:main|article)", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Letters of scripts that don't part words by spaces.
_DENSE = re.compile("[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")


def _named(attributes: str) -> tuple[tuple[str, ...], ...]:
    """The names in class, id and role, each as its parts, sorted."""
    names = {tuple(f".{x.lower()}" for x in _PART.findall(name)) for m in _NAMED.finditer(attributes) if m[1] for name in m[2].strip("\"'").split()}
    return tuple(sorted(x for x in names if x))


def _flat(names: tuple[tuple[str, ...], ...]) -> tuple[str, ...]:
    return tuple(sorted({part for name in names for part in name}))


_names = lru_cache(maxsize=20_000)(_named)


def tokens(page: str) -> Iterator[tuple[str, str, tuple[tuple[str, ...], ...]]]:
    """(kind, tag or text, names): kind is ``<`` for a start tag, ``/`` for an end tag, ``.`` for an element that closes
    itself, ``r`` for a whole element of raw text, ``t`` for text."""
    at, size, foreign = 0, len(page), 0
    last = page.rfind(">")
    endless: set[str] = set()
    while at < size:
        opened = _OPEN.search(page, at)
        low = opened.start() if opened else size
        if low != at:
            yield "t", page[at:low], ()
        if low == size:
            return
        first, second = page[low + 1], page[low + 2 : low + 3]
        if first in "!?" or first == "/" and not (second.isascii() and second.isalpha()):
            if page.startswith("<!--", low):
                empty = page.startswith(">", low + 4) or page.startswith("->", low + 4)
                end = page.find(">" if empty else "-->", low + 4)
                at = end + (1 if empty else 3) if end >= 0 else size
            else:
                at = page.find(">", low) + 1 or size
            continue
        if low > last:
            return
        m = _TAG.match(page, low)
        if m is None:  # a quote that isn't closed before the page's last tag ends
            at = page.find(">", low) + 1
            inner = page[low + 1 : at - 1].split()
            value, more, end_tag = (inner or [""])[0].strip("/").lower(), "", first == "/"
        else:
            at, value, more, end_tag = m.end(), m[2].lower(), m[3], bool(m[1])
        if end_tag:
            if value in ("svg", "math"):
                foreign = max(0, foreign - 1)
            yield "/", value, ()
            continue
        closed = more.endswith("/") and (foreign or value in ("svg", "math"))
        if value in ("svg", "math") and not closed:
            foreign += 1
        if value not in _ENDS:
            yield "." if closed or value in VOID else "<", value, (_names if len(more) < 500 else _named)(more)
        elif not closed:
            yield "r", value, ()
            end = None if value in endless else _ENDS[value].search(page, at)
            if end is None:
                endless.add(value)
                at = (page.find("<", at) + 1 or size + 1) - 1 if value == "title" else size
            else:
                at = page.find(">", end.end()) + 1 or size


def _ends(rows: list[tuple[str, str, tuple]]) -> list[int]:
    """For each start tag the last token of its element; of one that is never closed, the last of the page or of what it
    stands in. A paragraph also ends before a tag that isn't inline, a list item or a cell before the next of its kind."""
    ends, many = [len(rows) - 1] * len(rows), Counter()
    stack: list[int] = []
    blocks: list[int] = []  # the places in ``stack`` of tags that aren't inline

    def close(to: int, end: int) -> None:
        while len(stack) > to:
            x = stack.pop()
            ends[x] = end
            many[rows[x][1]] -= 1
        while blocks and blocks[-1] >= to:
            blocks.pop()

    for k, (kind, value, _) in enumerate(rows):
        if kind == "<":
            if value not in INLINE:
                if blocks and (top := rows[stack[blocks[-1]]][1]) in PARTED and (top == "p" or value in PARTED[top]):
                    close(blocks[-1], k - 1)
                blocks.append(len(stack))
            stack.append(k)
            many[value] += 1
        elif kind == "/" and many[value]:
            to = len(stack) - 1
            while rows[stack[to]][1] != value:
                to -= 1
            close(to, k)
    return ends


def weight(text: str) -> float:
    """How many words a text counts as."""
    words = len(text.split())
    return float(words) if text.isascii() else words + len(_DENSE.findall(text)) / 2


def best_run(score: list[float]) -> tuple[int, int]:
    """The first and shortest run (low, high) of the greatest sum over 0; (0, 0) where there is none."""
    best, low, high, total, start = 0.0, 0, 0, 0.0, 0
    for k, x in enumerate(score):
        if total <= 0:
            total, start = 0.0, k
        total += x
        if total > best:
            best, low, high = total, start, k + 1
    return low, high


@dataclass
class PageModel:
    odds: dict[str, float]
    cost: float
    holders: frozenset[str] = frozenset()

    def price(self, tag: str, names: tuple[tuple[str, ...], ...]) -> tuple[float, bool]:
        """The score of a tag with these names, and whether it cuts its element out."""
        worth = []
        for name in names:
            known = [self.odds[x] for x in name if x in self.odds]
            if known:
                worth.append(sum(known) / sum(x in self.odds or x[1:] not in FRAME for x in name))
        odds = self.odds.get(tag, UNSEEN)
        odds = max(odds, sum(worth) / len(worth)) if worth else odds
        return -self.cost * max(0.1, 1 + odds), odds > CUT and tag not in ("html", "head", "body")

    def widened(self, rows: list, ends: list[int], places: list[int], score: list[float], low: int, high: int) -> tuple[int, int]:
        """The run, or the least element around it whose name or names tell that it holds an article, if the run holds a
        third of its words: short blocks at an article's ends don't outweigh their tags."""
        if low == high:
            return low, high
        for x in range(low, -1, -1):
            kind, value, names = rows[places[x]]
            if kind == "<" and ends[places[x]] > places[high - 1] - (x == low):
                if any(k in self.holders for k in (value, *_flat(names))) and value not in ("html", "body"):
                    end = int(np.searchsorted(places, ends[places[x]], side="right"))
                    words = [sum(y for y in score[a:b] if y > 0) for a, b in ((low, high), (x, end))]
                    return (x, end) if 3 * words[0] >= words[1] else (low, high)
        return low, high

    def text(self, page: str | None) -> str:
        """The main text of one page."""
        rows = list(tokens(page or ""))
        words = [weight(value) if kind == "t" else 0.0 for kind, value, _ in rows]
        held = np.concatenate([[0.0], np.cumsum(words)])
        ends = _ends(rows)
        score: list[float] = []
        places: list[int] = []  # of each score, the token it stands for
        runs: list[str | None] = []  # text, or None where a block ends
        article, skip, spoken = 0, 0, 0
        known: dict[tuple, tuple[float, bool]] = {}
        wanted: list[int] = []
        if _HOLDERS.search(page or ""):
            starts = [(x[1], k) for k, x in enumerate(rows) if x[0] == "<" and x[1] in ("main", "article")]
            wanted = [k for tag, k in starts if tag == "main"] or ([k for _, k in starts] if len(starts) == 1 else [])

        def wraps(k: int, value: str) -> bool:
            share = (held[ends[k]] - held[k]) / held[-1] if held[-1] else 0.0
            return value == "form" and share > 0.5 or share > 1 / 3 and any(k < x <= ends[k] for x in wanted)

        def said(k: int) -> bool:
            near = [rows[x] for x in (k - 1, ends[k] + 1) if 0 <= x < len(rows)]
            return any(kind == "t" and value.strip() for kind, value, _ in near)

        for k, (kind, value, names) in enumerate(rows):
            if k < skip:
                continue
            if kind == "t":
                runs.append(html.unescape(value) if "&" in value else value)
                score.append(words[k])
                places.append(k)
                continue
            if kind == "r":
                runs.append(None)
                score.append(0.0)
                places.append(k)
                continue
            keys = ("own header" if value == "header" and article > k else value, names)
            if keys not in known:
                known[keys] = self.price(*keys)
            price, gone = known[keys]
            if value == "button" and kind != "." and (k < spoken or kind == "<" and said(k)):
                spoken = max(spoken, ends[k] + 1)
                runs.append("")
                score.append(0.0)
                places.append(k)
                continue
            if kind == "<" and (value == "template" or gone and not wraps(k, value)):
                runs.append(None)
                score.append(0.0)
                places.append(k)
                skip = ends[k] + 1
                continue
            if kind == "<" and value == "article":
                article = max(article, ends[k])
            runs.append("" if value in INLINE else None)
            score.append(price)
            places.append(k)
        low, high = self.widened(rows, ends, places, score, *best_run(score))
        blocks, line = [], []
        for run in [*runs[low:high], None]:
            if run is not None:
                line.append(run)
            elif line:
                block = " ".join("".join(line).split())
                if block:
                    blocks.append(block)
                line = []
        return " ".join(blocks)


def _overlap(a: str, b: str) -> float:
    x, y = Counter(a.split()), Counter(b.split())
    both = (x & y).total()
    return 2 * both / max(1, x.total() + y.total())


def truth(page: list[tuple[str, int]]) -> str:
    """The article's text of a labelled page."""
    plain = PageModel({}, 0.0)
    return plain.text("".join(markup for markup, label in page if label))


def _keys(page: list[tuple[str, int]]) -> Iterator[tuple[str, int, tuple[str, ...]]]:
    """(kind, label, tag and names) of each tag of a labelled page; a header within an article is an ``own header``."""
    article = 0
    for markup, label in page:
        for kind, value, names in tokens(markup):
            if kind in "<./":
                own = value == "header" and article
                article += (kind == "<") - (kind == "/") if value == "article" else 0
                yield kind, label, (f"own {value}" if own else value, *_flat(names))


def fit(labelled: list[list[tuple[str, int]]]) -> PageModel:
    """Log-odds of every tag and name, then the cost of a tag that extracts the labelled articles best."""
    within, outside, around, first = Counter(), Counter(), Counter(), Counter()
    for page in labelled:
        held: list[tuple[str, ...]] = []
        begun = False
        for kind, label, keys in _keys(page):
            if kind != "/":
                (within if label else outside).update(set(keys))
            # what encloses articles stands outside them, yet must not be cut
            if label:
                around.update({x for each in held for x in each})
                first.update([x for each in held for x in each] if not begun else [])
                begun = True
            elif kind == "<":
                held.append(keys)
            elif kind == "/":
                while held and held.pop()[0].split()[-1] != keys[0].split()[-1]:
                    pass
    odds = {key: float(np.log((outside[key] + 0.5) / (within[key] + around[key] + 0.5))) for key in {*within, *outside}}
    odds = {key: x for key, x in odds.items() if key[0] != "." or outside[key] >= SUPPORT or x <= 0}
    # the scan doesn't see what stands in a cut element: tags there don't count in its weights
    rough, seen = PageModel(odds, 0.0), Counter()
    for page in labelled:
        for markup, label in page:
            if label == 0:
                deep = 0
                for kind, _, keys in _keys([(markup, 0)]):
                    deep -= kind == "/" and deep > 0
                    if not deep and kind != "/":
                        seen.update(set(keys))
                    deep += kind == "<" and (deep > 0 or rough.price(keys[0], tuple((x,) for x in keys[1:]))[1])
    odds = {key: x if x > CUT else float(np.log((seen[key] + 0.5) / (within[key] + around[key] + 0.5))) for key, x in odds.items()}
    holders = frozenset(k for k, n in first.items() if np.log((n + 0.5) / (max(0, outside[k] - n) + 0.5)) > CUT)
    sample = labelled[:: max(1, len(labelled) // 60)]
    goals = [("".join(markup for markup, _ in page), truth(page)) for page in sample]
    return max((PageModel(odds, cost, holders) for cost in (0.25, 0.5, 1.0, 2.0, 4.0)), key=lambda m: sum(_overlap(m.text(p), t) for p, t in goals))


@lru_cache(maxsize=1)
def model() -> PageModel:
    """Learned once in the process that asks."""
    return fit(pages())


def extract(df: DataFrame, column: str = "html", learned: PageModel | None = None) -> DataFrame:
    """``df`` with the columns text string and n_chars bigint in place of ``column``; so named columns are replaced."""
    rest = [x for x in df.columns if x not in ("text", "n_chars", column)]
    df = lean(df.select(*rest, column), 500)
    told = df.sparkSession.sparkContext.broadcast(learned or model())

    @task("html_text")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, column):
                texts = [told.value.text(x) for x in batch.column(column).to_pylist()]
                own = [batch.column(x) for x in rest]
                yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*rest, "text", "n_chars"])

    kept = [x for x in df.schema.fields if x.name in rest]
    return df.mapInArrow(run, T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
