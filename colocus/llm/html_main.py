"""Main text of a page as the best-scoring run of words and tags.

A page is a sequence of words and tags. Words score by where they stand, tags
by how often labelled pages have them outside the main text; the run with the
largest sum, found in one linear scan, is the main region. An element that its
learned weight makes furniture (a menu, an advert, comments) counts nothing. All
weights are learned from labelled pages: of tags, of the words in class, id and
role names, and of words by their place. Only what HTML itself never shows
(comments, scripts, styles, titles, hidden elements) is left out by syntax.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
PLAIN = re.compile(r"[^>\"']*>")
QUOTE = re.compile(r"[\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS_OF_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_a-zA-Z]+")
# Element names by their role in HTML.
RAW = frozenset("script style textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = ("article", "main")


#: What a tag costs at least: where the page marks its article by an element (@in), and elsewhere.
LEAST_COST = {"@in": 0.001, "": 0.21}


class Page:
    """Tokens and elements of a page, read in one forward scan with a stack.

    Tokens are (kind, value, element): "text" or "tag". An end tag closes the
    nearest open element of its name and those inside; that of an inline element
    does not reach over a block. An element without an end tag stays in the tree
    but says nothing of its words.
    """

    def __init__(self, page: str):
        self.tokens: list[tuple[str, str, int]] = []
        self.tag, self.raw, self.parent, self.closed = [""], [""], [0], [False]
        self._read(page)
        n = len(self.tag)
        self.words, self.holds, linked = [0] * n, [False] * n, [0] * n
        for kind, value, e in self.tokens:
            if kind == "text":
                self.words[e] += len(value.split())
        for e in range(n - 1, 0, -1):
            if self.tag[e] == "a" and self.closed[e]:
                linked[e] = self.words[e]
            linked[self.parent[e]] += linked[e]
            self.words[self.parent[e]] += self.words[e]
            self.holds[self.parent[e]] |= self.holds[e] or self.tag[e] in CONTAINER
        self.links = [e > 0 and self.words[e] > 0 and linked[e] == self.words[e] for e in range(n)]  # all its words are links
        self.inside = [False] * n
        for e in range(1, n):
            self.inside[e] = self.inside[self.parent[e]] or self.tag[self.parent[e]] in CONTAINER

    def _read(self, page: str) -> None:
        at, n, stack, frames = 0, len(page), [0], [Counter()]
        blocks: Counter = Counter()
        gone: set[str] = set()  # what does not occur any more from here on

        def find(what: str, start: int) -> int:
            if what in gone:
                return -1
            found = page.find(what, start)
            if found < 0:
                gone.add(what)
            return found

        def text(value: str) -> None:
            if value:
                self.tokens.append(("text", value, stack[-1]))

        def pop() -> int:
            e = stack.pop()
            if self.tag[e] in BLOCK:
                blocks[self.tag[e]] -= 1
                frames.pop()
            else:
                frames[-1][self.tag[e]] -= 1
            return e

        while at < n:
            low = find("<", at)
            if low < 0:
                return text(page[at:])
            m = NAME.match(page, low)
            if m is None:
                if page.startswith("<!--", low):
                    text(page[at:low])
                    end = find("-->", low + 4)
                    at = n if end < 0 else end + 3
                elif page.startswith("<![CDATA[", low) and (end := find("]]>", low)) >= 0:
                    text(page[at:low] + html_lib.escape(page[low + 9 : end]))
                    at = end + 3
                elif page[low + 1 : low + 2] in ("!", "?", "/") and (end := find(">", low)) >= 0:
                    text(page[at:low])
                    at = end + 1
                else:
                    text(page[at : low + 1])
                    at = low + 1
                continue
            if find(">", m.end()) < 0:
                return text(page[at:])
            text(page[at:low])
            tag, start = m[2].lower(), m.end()
            at = start
            while (plain := PLAIN.match(page, at)) is None:  # quotes count after an equals sign
                quote = QUOTE.search(page, at).start()
                end = find(page[quote], quote + 1) if page[max(start, quote - 64) : quote].rstrip()[-1:] == "=" else quote
                if end < 0 or find(">", end) < 0:
                    plain = re.compile(">").search(page, at)
                    break
                at = end + 1
            at = plain.end()
            raw = page[start : at - 1]
            if m[1]:
                if tag in BLOCK and blocks[tag] or tag not in BLOCK and frames[-1][tag]:
                    self.tokens.append(("tag", tag, stack[-1]))
                    while self.tag[e := pop()] != tag:
                        pass
                    self.closed[e] = True
                else:
                    self.tokens.append(("tag", tag, stack[-1]))
                continue
            if tag in RAW:
                end = self._raw_end(page, tag, at, gone)
                if end is not None or tag in ("script", "style"):
                    at = n if end is None else end
                    continue
            if tag in VOID or raw.endswith("/"):
                self.tokens.append(("tag", tag, stack[-1]))
                continue
            self.tag.append(tag)
            self.raw.append(raw)
            self.parent.append(stack[-1])
            self.closed.append(False)
            stack.append(len(self.tag) - 1)
            if tag in BLOCK:
                blocks[tag] += 1
                frames.append(Counter())
            else:
                frames[-1][tag] += 1
            self.tokens.append(("tag", tag, stack[-1]))

    @staticmethod
    def _raw_end(page: str, tag: str, at: int, gone: set[str]) -> int | None:
        key = f"</{tag}"
        if key in gone:
            return None
        m = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
        if m is None:
            gone.add(key)
            return None
        return m.end()

    def names(self, e: int) -> tuple[bool, list[list[str]]]:
        """Whether an element is hidden, and the words of each name in its class, id and role."""
        if not self.raw[e].strip("/ "):
            return False, []
        attributes = {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(self.raw[e])}
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attributes.get("style", "")))
        names = f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('role', '')}".split()
        return hidden, [[w.lower() for w in WORDS_OF_NAME.findall(x)] for x in names]

    def outside(self, weights: dict[str, float]) -> list[bool]:
        """Which elements stand outside the main text: by their tag, or by a name of which every word is known.

        A name alone does not move an element that holds an article, main element or most of the page's words.
        """
        out = [False] * len(self.tag)
        for e in range(1, len(self.tag)):
            out[e] = out[self.parent[e]]
            if out[e] or not self.closed[e]:
                continue
            place = "@in" if self.inside[e] else ""
            hidden, names = self.names(e)
            out[e] = hidden or weights.get(f"<{self.tag[e]}{place}", 0.0) < -1
            if not out[e] and not self.holds[e] and 2 * self.words[e] <= self.words[0] and self.tag[e] not in ("html", "body"):
                out[e] = any(x and all(f".{w}{place}" in weights for w in x) and min(weights[f".{w}{place}"] for w in x) < -1 for x in names)
        return out

    def region(self, out: list[bool]) -> list[str]:
        """The place of each element's words: "@out" for what labelled tags exclude, "@in" for the article or main
        element with most of their words, "@beside" for the rest of such a page; where a page has none, "@link" for what
        only consists of links (a menu's entries, not a link in a sentence) and "" for all else."""
        held = [e for e in range(1, len(self.tag)) if self.tag[e] in CONTAINER and self.words[e] and not out[e]]
        articles = [e for e in held if self.tag[e] == "article"]
        most = max(held, key=lambda e: (self.words[e], -e), default=0)
        if articles and 2 * sum(self.words[e] for e in articles) >= self.words[most]:
            held = articles
        best = max(held, key=lambda e: (self.words[e], -e), default=0)
        alone = 2 * self.words[best] > sum(self.words[e] for e in held)
        place = [""] * len(self.tag)
        chosen = {best} if held and alone else set(held)
        for e in range(len(self.tag)):
            up = place[self.parent[e]] if e else ("@beside" if held else "")
            link = not held and self.links[e] and self.tag[e] != "a"
            place[e] = "@out" if out[e] else "@in" if e in chosen else "@link" if link else up
        return place


def fit_weights(labelled: list[tuple[str, str]], smooth: float = 0.5) -> dict[str, float]:
    """Log-odds of standing in the main text, from pages with their main text.

    "<tag", ".word": of elements by tag and by the words of their names, an
    element being inside if most of its words are; "@in" behind both for those in
    an article or main element. "tag": what a tag costs, LEAST_COST at least. "#" with
    a place: what a word there scores, from -1 to 1.
    """
    counts: dict[str, list[int]] = {}

    def count(seen: set[tuple[str, bool]]) -> None:
        """A key counts once a page and side."""
        for key, inside in seen:
            counts.setdefault(key, [0, 0])[inside] += 1

    read = []
    for page, main in labelled:
        parsed, wanted = Page(page), set(main.split())
        good = [0] * len(parsed.tag)
        marks = [sum(w in wanted for w in html_lib.unescape(v).split()) if k == "text" else -1 for k, v, _ in parsed.tokens]
        for (kind, _, e), hits in zip(parsed.tokens, marks, strict=True):
            if kind == "text":
                good[e] += hits
        seen = set()
        for e in range(len(good) - 1, 0, -1):
            good[parsed.parent[e]] += good[e]
            if parsed.words[e] and parsed.closed[e]:
                inside, place = 2 * good[e] > parsed.words[e], "@in" if parsed.inside[e] else ""
                names = [f".{w}{place}" for x in parsed.names(e)[1] for w in x]  # a name takes the evidence from the tag
                seen |= {(key, inside) for key in names or [f"<{parsed.tag[e]}{place}"]}
        count(seen)
        read.append((parsed, marks))
    odds = lambda key: math.log((counts[key][1] + smooth) / (counts[key][0] + smooth))
    weights = {key: max(odds(key), -1.0) if counts[key][1] else odds(key) for key in counts}  # what is inside even once is no furniture
    counts.clear()
    for parsed, marks in read:
        place, seen = parsed.region(parsed.outside(weights)), set()
        for i, (kind, value, e) in enumerate(parsed.tokens):
            if kind == "text":
                n = len(value.split())
                if n:
                    seen.add((f"#{place[e]}", 2 * marks[i] > n))
            else:
                near = [m > 0 for m, (k, v, _) in zip(marks[max(0, i - 3) : i + 4], parsed.tokens[max(0, i - 3) : i + 4], strict=True) if k == "text" and v.strip()]
                seen.add((f"{value}{place[e]}", bool(near) and 2 * sum(near) >= len(near)))
        count(seen)
    for key in counts:
        weights[key] = max(-1.0, min(1.0, odds(key))) if key[0] == "#" else min(-LEAST_COST["@in" if key.endswith("@in") else ""], odds(key))
    return {"#": 1.0, "#@in": 1.0, "#@beside": -1.0, "#@link": -1.0} | weights


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest sum, the first on ties; (0, 0) if none is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best + 1e-12:
            best, found = total, (start, i + 1)
    return found


def scored(page: str, weights: dict[str, float]) -> tuple[list[tuple[str, str, str]], list[float]]:
    """Tokens (kind, value, place) and what each adds to a run."""
    parsed = Page(page)
    place = parsed.region(parsed.outside(weights))
    scores = []
    for kind, value, e in parsed.tokens:
        if place[e] == "@out":
            scores.append(0.0)
        elif kind == "text":
            scores.append(weights[f"#{place[e]}"] * len(value.split()))
        else:
            scores.append(weights.get(f"{value}{place[e]}", -LEAST_COST["@in"] if place[e] == "@in" else -1.0))
    return [(kind, value, place[e]) for kind, value, e in parsed.tokens], scores


def main_text(page: str | None, weights: dict[str, float] | None = None) -> str:
    """The blocks of the best run, white space inside a block as one space, joined by newlines.

    Null, empty and pages without words give "". Of equal runs the first counts.
    Time and memory grow with the page's length, whatever stays open in it.
    """
    if not page:
        return ""
    tokens, scores = scored(page, weights or default_weights())
    low, high = best_run(scores)
    blocks, parts = [], []
    for kind, value, place in tokens[low:high]:
        if kind == "text":
            if place not in ("@out", "@beside"):
                parts.append(html_lib.unescape(value))
        elif value in BLOCK:
            blocks.append(" ".join("".join(parts).split()))
            parts = []
        elif value == "br":
            parts.append(" ")
    blocks.append(" ".join("".join(parts).split()))
    return "\n".join(b for b in blocks if b)


# Elements and words of names in which the labelled pages have what is not the article, and words of layout that they have on both sides.
FURNITURE_TAGS = "nav aside form menu dialog footer button fieldset label select datalist option object canvas svg audio video iframe noscript template math".split()
FURNITURE_WORDS = (
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside widget related recommended share sharing social "
    "comment comments reply replies disqus respond discussion newsletter subscribe signup login search popup modal overlay pagination pager skip "
    "complementary contentinfo"
).split()
PLACE_WORDS = "area bar block bottom box col column container content form global group icon icons inner item items left link links list outer page panel primary right row secondary section site slot text top unit wrap wrapper".split()


def labelled_pages() -> list[tuple[str, str]]:
    """Pages with their main text: each piece of page furniture stands beside and within the article once or more, names of
    place stand on both sides, and articles come as element, as columns and as tables, with lists, links and headings."""
    pages, furniture = [], [f"<{t}>" for t in FURNITURE_TAGS] + [f"<div class='{w}'>" for w in FURNITURE_WORDS]
    for i, opening in enumerate(furniture):
        closing = f"</{re.match('<([a-z]+)', opening)[1]}>"
        place = PLACE_WORDS[i % len(PLACE_WORDS)]
        both = opening.replace("'>", f" {place}'>") if "class" in opening else opening
        lines = [f"line{i}{k} runs over the hill and back again" for k in range(3 + i % 4)]
        items = lines[1:3]
        body = "".join(f"<p>{x} <a href='/a'>seen{i}</a> <span>there</span></p>" for x in lines) + "<div><ul>" + "".join(f"<li>{x}</li>" for x in items) + f"</ul></div><blockquote>{lines[0]}</blockquote><table><tr><td>{lines[-1]}</td></tr></table>"
        main = "\n".join([lines[0], *(f"{x} seen{i} there" for x in lines), *items, lines[0], lines[-1]])
        links = "".join(f"<li><a href='/{k}'>to{i}x{k}</a></li>" for k in range(4 + i % 3))
        other = f"{both}other{i} words stand{i} apart{i}{closing}"
        foot = f"<div><span>imprint{i}</span> <a href='/t'>terms{i}</a></div>"
        heading = f"<header class='header'><h1>{lines[0]}</h1></header>" if i % 2 else f"<div class='{place}'><h1>{lines[0]}</h1></div>"
        top = f"<header><p>welcome{i} here{i}</p></header><div class='header'>also{i} welcome{i}</div>"
        if i % 3 < 2:
            holder = CONTAINER[i % 2]
            pages.append((f"<html><body>{top}<div><ul>{links}</ul></div>{other}<{holder}>{heading}{body}{other}</{holder}>{foot}</body></html>", main))
        if i % 3 == 1:
            pages.append((f"<html><body>{top}<div><ul>{links}</ul></div>{other}<div class='{place}'><h1>{lines[0]}</h1>{body}</div>{other}<div><ul>{links}</ul></div></body></html>", main))
        if i % 3 == 2:
            pages.append((f"<html><body>{other}<article>{heading}{body}{other}</article>{foot}</body></html>", main))
            pages.append((f"<html><body>{top}<table><tr><td>{links}</td><td class='{place}'><h1>{lines[0]}</h1>{body}</td></tr></table>{foot}</body></html>", main))
    return pages


def layout_pages() -> list[tuple[str, str]]:
    """Pages with their main text in which every name of place stands around a part of the article and beside it."""
    pages = []
    for i, place in enumerate(PLACE_WORDS):
        first, rest = f"word{i} crosses the field at noon", [f"row{i}{k} of the story goes on from there" for k in range(4)]
        paragraphs = "".join(f"<p>{x}</p>" for x in rest)
        part = f"<div class='{place}'><p>{first}</p></div>"
        links = "".join(f"<li><a href='/{k}'>way{i}x{k}</a></li>" for k in range(5))
        main = "\n".join([f"Head {i}", *rest, first])
        pages.append((f"<html><body><nav class='{place}'><ul>{links}</ul></nav><article><h1>Head {i}</h1>{paragraphs}{part}</article></body></html>", main))
        pages.append((f"<html><body><div><ul>{links}</ul></div><div><h1>Head {i}</h1>{paragraphs}{part}</div></body></html>", main))
    return pages


@cache
def _fitted() -> tuple[tuple[str, float], ...]:
    return tuple(sorted(fit_weights(labelled_pages() + layout_pages()).items()))


def default_weights() -> dict[str, float]:
    return dict(_fitted())


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages, in place: no shuffle.

    pages needs page_id, url and html; other columns are left out. A null html
    gives an empty text; equal rows stay; an empty table gives no rows.
    """
    weights = weights or default_weights()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = [main_text(x, weights) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
