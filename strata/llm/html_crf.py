"""Main-text extraction from web pages with a linear-chain conditional random field.

A page is cut into DOM leaf blocks (runs of text between block-level tags); each block has features
of its ancestors' tags and class names and of its text; the chain's weights are learned on labelled
pages (numpy, log-likelihood by forward-backward) and Viterbi decoding marks the blocks to keep.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import slices, small_batches, unused, whole_text

#: Elements of the HTML standard by how they are read here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe svg textarea title xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math object q ruby rt rp s samp small span strike strong sub sup time tt u var".split()) | frozenset(
    "mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose mfenced msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction semantics annotation".split())
P_CLOSERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME_CLOSERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Where an implied end tag stops looking for the element it closes.
SCOPE = {"p": frozenset("article aside body div footer header html li main nav section table td th blockquote form".split()),
         "li": frozenset("ul ol menu body html".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]),
         "td": frozenset(["table", "tr"]), "th": frozenset(["table", "tr"]), "option": frozenset(["select"])}

#: A quotation mark opens a value only after '='; elsewhere it is a character like any other.  Nothing
#: is read twice (possessive), so a tag costs its own length.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
#: Raw elements that hold tags and comments; the others hold none.
MARKED = frozenset("template svg".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}
_END = re.compile(r"[.!?…:;\"”»)]$")


@dataclass(slots=True)
class Block:
    text: str
    own: str                 # the innermost open element that is not inline
    tags: tuple[str, ...]    # distinct open elements
    names: tuple[str, ...]   # distinct words of their class, id and role attributes
    linked: int              # characters of the text inside links


def _raw_end(page: str, tag: str, at: int) -> int:
    """Where reading goes on after the raw element ``tag`` whose content starts at ``at``: after its
    end tag, whatever '<' its content holds, and without one at the end of the page."""
    to = at
    while tag in MARKED and (m := _TOKEN.search(page, to)):
        to, name = m.end(), (m[2] or "").lower()
        if name == tag and m[1]:
            return to
        if name in RAW - MARKED and not m[1] and not m[3].rstrip().endswith("/"):
            if not (inner := _RAW_END[name].search(page, to)):
                break
            to = inner.end()
    m = _RAW_END[tag].search(page, at)
    return m.end() if m else len(page)


def blocks(page: str) -> list[Block]:
    """DOM leaf blocks in page order.  Character references are decoded once, white space inside a
    block becomes one space, empty blocks are left out; the content of scripts, styles and other
    raw elements, and comments, are no text.  Open elements are counted by tag and by name, so a
    block costs the distinct ones, however deep the page is nested."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    tags: dict[str, int] = {}
    names: dict[str, int] = {}
    parts: list[str] = []
    linked = pos = 0
    last = page.rfind(">") + 1  # no tag ends behind it

    def flush() -> None:
        nonlocal linked
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                own = next((t for t, _ in reversed(stack) if t not in INLINE), "none")
                out.append(Block(text, own, tuple(tags), tuple(names), min(linked, len(text))))
            parts.clear()
        linked = 0

    def opened(tag: str, attributes: str) -> None:
        # themes mark whole pages on these two ("has-comments"), which says nothing of a block
        words = frozenset() if tag in ("html", "body") else _attributes(attributes)
        stack.append((tag, words))
        tags[tag] = tags.get(tag, 0) + 1
        for w in words:
            names[w] = names.get(w, 0) + 1

    def closed(at: int, to: int) -> None:
        for tag, words in stack[at:to]:
            for counts, word in ((tags, tag), *((names, w) for w in words)):
                counts[word] -= 1
                if not counts[word]:
                    del counts[word]
        del stack[at:to]

    def close(kinds, scope=frozenset()) -> None:
        if tags.keys().isdisjoint(kinds):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in kinds:
                closed(i, len(stack))
                return
            if stack[i][0] in scope:
                return

    while m := _TOKEN.search(page, pos, last):
        tag = (m[2] or "").lower()
        if m.start() > pos:
            piece = page[pos:m.start()]
            parts.append(piece)
            if "a" in tags:
                linked += len(piece)
        pos = m.end()
        if not tag:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                pos = len(page)  # never closed
                break
            continue
        if tag in RAW and not m[1]:
            if not m[3].rstrip().endswith("/"):
                pos = _raw_end(page, tag, pos)
            parts.append(" ")
        elif tag in VOID:
            parts.append(" ")
            if tag == "hr":
                flush()
        elif tag in INLINE:
            if m[1]:
                if tag in tags:
                    for i in range(len(stack) - 1, -1, -1):  # the end of an inline element leaves blocks open
                        if stack[i][0] == tag:
                            closed(i, i + 1)
                            break
                        if stack[i][0] not in INLINE:
                            break
            else:
                opened(tag, m[3])
        else:
            flush()
            if m[1]:
                close({tag})
            else:
                if tag in P_CLOSERS:
                    close({"p"}, SCOPE["p"])
                if tag in SAME_CLOSERS:
                    close(SAME_CLOSERS[tag], SCOPE[tag])
                if not m[3].rstrip().endswith("/"):
                    opened(tag, m[3])
    parts.append(page[pos:].split("<!--", 1)[0])  # a comment without an end runs to the page's
    flush()
    return out


def _attributes(raw: str) -> frozenset[str]:
    if not raw or "=" not in raw:
        return frozenset()
    return frozenset(w for a in _ATTR.findall(raw) for w in _NAME.findall((a[1] or a[2] or a[3]).lower()) if len(w) > 1)


def features(page: list[Block]) -> list[list[str]]:
    """Of each block: ancestor tags and names, the own tag, and what its text looks like."""
    out = []
    for b in page:
        n, words = len(b.text), b.text.count(" ") + 1
        f = ["bias", f"own={b.own}", f"size={min(8, n.bit_length())}", f"links={round(3 * b.linked / n)}",
             "ends" if _END.search(b.text) else "open", "few" if words < 5 else "some" if words < 15 else "many"]
        f += [f"in={t}" for t in b.tags if t not in INLINE]
        f += [f"name={w}" for w in b.names]
        if b.text[0] in "©" or b.text.lower().startswith("copyright"):
            f.append("rights")
        out.append(f)
    return out


@dataclass
class Crf:
    weights: dict[str, float]            # of "keep" over "drop", by feature
    step: tuple[tuple[float, float], tuple[float, float]]  # log-weights of (from, to)

    def decode(self, page: list[list[str]]) -> list[bool]:
        """Viterbi."""
        if not page:
            return []
        get, ((s00, s01), (s10, s11)) = self.weights.get, self.step
        a, b, back = 0.0, sum(get(f, 0.0) for f in page[0]), []
        for block in page[1:]:
            e = sum(get(f, 0.0) for f in block)
            back.append((b + s10 > a + s00, b + s11 > a + s01))
            a, b = max(a + s00, b + s10), max(a + s01, b + s11) + e
        keep = [b > a]
        for from0, from1 in reversed(back):
            keep.append(from1 if keep[-1] else from0)
        return keep[::-1]


def train(pages: list[tuple[list[list[str]], list[bool]]], rounds: int = 150, rate: float = 0.15, ridge: float = 2e-3) -> Crf:
    """Maximum likelihood by Adam over whole chains; forward-backward runs on all pages at once."""
    index = {f: i for i, f in enumerate(sorted({f for p, _ in pages for b in p for f in b}))}
    n, t_max, n_pages = len(index), max(len(p) for p, _ in pages), len(pages)
    at = [(i, t, index[f]) for i, (p, _) in enumerate(pages) for t, b in enumerate(p) for f in b]
    pi, ti, fi = (np.array(x) for x in zip(*at, strict=True))
    gold = np.zeros((n_pages, t_max))
    mask = np.zeros((n_pages, t_max), bool)
    for i, (p, y) in enumerate(pages):
        gold[i, :len(p)], mask[i, :len(p)] = y, True
    pair = mask[:, 1:, None, None] * np.stack([np.stack([(1 - gold[:, :-1]) * (1 - gold[:, 1:]), (1 - gold[:, :-1]) * gold[:, 1:]], -1),
                                                np.stack([gold[:, :-1] * (1 - gold[:, 1:]), gold[:, :-1] * gold[:, 1:]], -1)], -2)
    theta = np.zeros(n + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for r in range(1, rounds + 1):
        score = np.zeros((n_pages, t_max, 2))
        np.add.at(score[:, :, 1], (pi, ti), theta[fi])
        step = theta[n:].reshape(2, 2)
        fw, bw = np.zeros_like(score), np.zeros_like(score)
        fw[:, 0] = score[:, 0]
        for t in range(1, t_max):
            new = np.logaddexp.reduce(fw[:, t - 1, :, None] + step, axis=1) + score[:, t]
            fw[:, t] = np.where(mask[:, t, None], new, fw[:, t - 1])
        for t in range(t_max - 2, -1, -1):
            new = np.logaddexp.reduce(step + (score[:, t + 1] + bw[:, t + 1])[:, None], axis=2)
            bw[:, t] = np.where(mask[:, t + 1, None], new, bw[:, t + 1])
        z = np.logaddexp.reduce(fw[:, -1], axis=1)
        keep = np.exp(fw[:, :, 1] + bw[:, :, 1] - z[:, None]) * mask
        both = np.exp(fw[:, :-1, :, None] + step + (score[:, 1:] + bw[:, 1:])[:, :, None] - z[:, None, None, None]) * mask[:, 1:, None, None]
        grad = np.zeros_like(theta)
        np.add.at(grad, fi, (gold - keep)[pi, ti])
        grad[n:] = (pair - both).sum((0, 1)).ravel()
        grad = grad / n_pages - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += rate * (m / (1 - 0.9 ** r)) / (np.sqrt(v / (1 - 0.99 ** r)) + 1e-8)
    s = theta[n:]
    return Crf({f: float(theta[i]) for f, i in index.items()}, ((float(s[0]), float(s[1])), (float(s[2]), float(s[3]))))


def labelled_pages(count: int = 400, seed: int = 5) -> list[tuple[list[list[str]], list[bool]]]:
    """Labelled training pages: layouts common on the web are put together at random from made-up
    words; text that belongs to the article starts with a mark that gives the label and is then
    taken off."""
    rnd = random.Random(seed)
    mark = "\ue000"

    def words(lo, hi):
        return " ".join("".join(rnd.choice("bcdfglmnprstv") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(lo, hi)))

    def para(lo=1, hi=60):
        return words(lo, hi).capitalize() + rnd.choice([".", ".", ".", "!", "?", "", ","])

    def attr(*names):
        return rnd.choice(["", *(f' class="{n}"' for n in names), *(f' id="{n}"' for n in names)])

    def named(*names):
        n = rnd.choice(names)
        return rnd.choice([f' class="{n}"', f' id="{n}"', f' class="box {n}"', f' class="{n}-{rnd.choice(["wrap", "inner", "box"])}"'])

    def links(lo, hi):
        return "<ul>" + "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(rnd.randint(lo, hi))) + "</ul>"

    def clutter():
        return rnd.choice([
            lambda: f"<div{named('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner')}>{para(1, 15)}</div>",
            lambda: f"<div{named('cookie', 'consent', 'notice', 'gdpr', 'alert', 'popup', 'modal')}><p>{para(4, 25)}</p><button>{words(1, 2)}</button></div>",
            lambda: f"<aside{attr('sidebar', 'related', 'widget')}><h3>{words(1, 4)}</h3>{links(2, 6)}<p>{para()}</p></aside>",
            lambda: f"<form{attr('newsletter', 'subscribe', 'search', 'login')}><label>{words(1, 4)}</label><p>{para(1, 20)}</p><button>{words(1, 2)}</button></form>",
            lambda: f"<nav{attr('menu', 'nav', 'breadcrumb', 'pagination', 'toc')}>{links(2, 8)}</nav>",
            lambda: f"<div{named('share', 'social', 'related', 'recommended', 'newsletter', 'subscribe', 'sidebar', 'widget', 'breadcrumb', 'menu', 'nav')}>{links(1, 5)}<p>{para(2, 20)}</p></div>"])()

    def comments():
        body = "".join(f"<div{attr('comment', 'reply')}><p>{para()}</p></div>" for _ in range(rnd.randint(1, 5)))
        return rnd.choice([f"<section{named('comments', 'comment', 'responses', 'discussion', 'disqus')}><h2>{words(1, 3)}</h2>{body}</section>",
                           f"<div{named('comments', 'comment', 'replies')}>{body}</div>"])

    def story():
        out = [f"<h1>{mark}{words(2, 12)}</h1>"] if rnd.random() < 0.9 else []
        for _ in range(rnd.randint(1, 18)):
            kind = rnd.random()
            if kind < 0.72:
                lead, tail = rnd.choice([("", "</p>"), ("<b>", "</b></p>"), ("<b>", "<br>"), ("", ""), ("<em>", "</em> x</p>")])
                out.append(f"<p>{lead}{mark}{para()}{tail}")
            elif kind < 0.80:
                out.append(f"<h2>{mark}{words(1, 7)}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{mark}{para(1, 20)}</li>" for _ in range(rnd.randint(1, 5))) + "</ul>")
            elif kind < 0.90:
                out.append(f"<blockquote><p>{mark}{para()}</p></blockquote>")
            elif kind < 0.93:
                out.append("<table><tr>" + "".join(f"<td>{mark}{words(1, 4)}</td>" for _ in range(3)) + "</tr></table>")
            elif kind < 0.95:
                out.append(f"<pre>{mark}{words(3, 20)}</pre>")
            else:
                out.append(clutter())
        return "".join(out)

    made = []
    for _ in range(count):
        head = f"<header{attr('header', 'masthead', 'top')}><div>{words(1, 4)}</div>{links(2, 6) if rnd.random() < .5 else ''}</header>" if rnd.random() < 0.4 else ""
        foot = f"<footer{attr('footer')}>{rnd.choice(['&copy; ', '© 2020 ', ''])}{para(2, 20)}{links(1, 4) if rnd.random() < .4 else ''}</footer>" if rnd.random() < 0.85 else f"<div{named('footer', 'copyright', 'bottom', 'legal')}>{rnd.choice(['&copy; ', 'Copyright '])}{para(2, 12)}</div>"
        body = story()
        if rnd.random() < 0.2:
            body += comments()
        wrap = rnd.random()
        body = f"<article{attr('post', 'entry', 'article')}>{body}</article>" if wrap < 0.7 else f"<main{attr('content')}>{body}</main>" if wrap < 0.8 else f"<div{named('content', 'article', 'post', 'entry', 'story', 'main')}>{body}</div>"
        before = "".join(clutter() for _ in range(rnd.randint(0, 3)))
        after = comments() * (rnd.random() < 0.3) + "".join(clutter() for _ in range(rnd.randint(0, 2)))
        page = f"<html><head><title>{words(2, 6)}</title></head><body>{head}<nav>{links(2, 8)}</nav>{before}{body}{after}{foot}</body></html>"
        got = blocks(page)
        labels = [b.text.startswith(mark) for b in got]
        for b in got:
            b.text = b.text.lstrip(mark) or "x"
        made.append((features(got), labels))
    return made


def main_text(page: str, crf: Crf) -> str:
    got = blocks(page)
    return "\n".join(b.text for b, keep in zip(got, crf.decode(features(got)), strict=True) if keep)


def extract(pages: DataFrame, crf: Crf | None = None, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Adds ``text`` (the kept blocks, one to a line; empty if none) to every row, from the whole
    html.  Null and empty pages give empty text; a column of that name is replaced; equal pages
    give equal texts, and rows are never dropped."""
    small_batches(pages)
    crf = crf or train(labelled_pages())
    pages = pages.drop(text_col) if text_col != html_col else pages
    names, source = pages.columns, unused(pages, "_html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, source):
                texts = [main_text(p, crf) for p in b.column(source).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(texts, pa.string())], names=[*names, text_col])

    return pages.withColumn(source, whole_text(html_col)).mapInArrow(run, pages.schema.add(text_col, "string"))
