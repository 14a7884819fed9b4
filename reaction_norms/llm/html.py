"""Main text of web pages by consensus of hosts (operator 10).

Each page is read once into blocks of text, each with the generalised path (tags and classes
without digits) of the container that holds it; menus, adverts, comments and the like never
become blocks. Every page scores its containers and votes for the path of the best one; Spark
counts the votes per host, and the pages are extracted anew by their host's winning path. A
page on which that path holds too little takes the next of all voted ones that holds enough.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reaction_norms.llm.common import by_batch, stored, table

# Tags of HTML by what they do to the text around them, and the parts of class
# names and ids that mark what is not the article.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINER = frozenset("html body article main section div td center table tbody tr blockquote ul ol dl details figure frameset fieldset form header footer nav aside".split())
DROPPED = frozenset("head script style noscript template nav header footer aside form iframe svg math canvas object audio video button select option textarea input label menu dialog title map frameset".split())
RAW = frozenset("script style textarea title noscript iframe xmp template svg math".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
DROPPED_NAMES = frozenset(
    "nav navbar navigation menu menus sidebar sidenav aside footer header masthead topbar ad ads adv advert adverts advertisement advertising banner banners promo promotion sponsor sponsored sponsors cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager comment comments commentlist disqus reply replies respond discussion widget widgets toolbar skip copyright disclaimer legal".split()
)
# Parts that may follow such a name, and parts that turn it into something else.
SUFFIXES = frozenset("bar box wrapper wrap container list area section block inner outer row column col group panel slot unit frame zone region left right top bottom links link buttons button icons icon items item posts post articles form message text title content body".split())
NEGATIONS = frozenset("has have with without no not non hide free".split())
# Names that mark an element in any part of a longer name, and names that do so only beside their like.
ANYWHERE = frozenset(
    "nav navbar navigation menu menus sidebar sidenav ad ads adv advert adverts advertisement advertising banner banners promo promotion sponsor sponsored sponsors cookie cookies consent gdpr newsletter subscribe subscription share sharing social related recommended recommendations breadcrumb breadcrumbs pagination comment comments commentlist disqus".split()
)
ALONE = frozenset("notice notices notification alert widget widgets legal copyright disclaimer".split())
BESIDE = SUFFIXES - frozenset("articles message text title content body".split()) | ALONE | frozenset("site page privacy".split())
MAIN_NAMES = frozenset("article content main post entry story text body".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
SCOPE = frozenset("ul ol dl table body html div article section main".split())
DEPTH = 64
#: A host's path gives a page's text if it holds this share of what the page's own best container is worth.
HELD = 0.9

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|\"[^\"]*\"|'[^']*'", re.S)
_READ = frozenset("class id role style hidden aria-hidden".split())
_PARTS = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_CLOSE_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}


def _attributes(text: str) -> dict[str, str]:
    if not text or text.isspace():
        return {}
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        if m[1] and (name := m[1].lower()) in _READ:
            found.setdefault(name, m[2] or m[3] or m[4] or "")  # the first of repeated ones counts
    return found


def _names(attributes: dict[str, str]) -> set[str]:
    return {p for key in ("class", "id") if attributes.get(key) for p in _PARTS.split(_CAMEL.sub("-", attributes[key]).lower())}


def _dropped(tag: str, attributes: dict[str, str]) -> bool:
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    return attributes.get("role", "").lower() in DROPPED_ROLES


def _named_so(attributes: dict[str, str]) -> bool:
    """Whether a class or id says that the element is not the article: a part of its name is of
    ``ANYWHERE``, or one of the other names ends it, up to suffixes such as -bar; those of ``ALONE``
    count only beside their like. Not has-sidebar or ad-free."""
    for key in ("class", "id"):
        for token in attributes.get(key, "").split():
            parts = [p for p in _PARTS.split(_CAMEL.sub("-", token).lower()) if p]
            if not NEGATIONS.isdisjoint(parts):
                continue
            if not ANYWHERE.isdisjoint(parts) or not ALONE.isdisjoint(parts) and BESIDE.issuperset(parts):
                return True
            while len(parts) > 1 and parts[-1] in SUFFIXES:
                parts.pop()
            if parts and parts[-1] in DROPPED_NAMES - ALONE:
                return True
    return False


def blocks(page: str) -> list[tuple[str, str, int, str]]:
    """(path, text, characters in links, path of the highest main tag or name that holds it) of each block.

    An element dropped for its name alone stays if it holds the page's only articles, or most
    of the text of a page that has none elsewhere.
    """
    out, parts = [], []
    # open elements: tag, path, whether dropped, path of the highest main container, elements above with such a name
    stack: list[tuple[str, str, bool, str, tuple[int, ...]]] = [("", "", False, "", ())]
    named, articles = 0, []
    linked, links, at, n = 0, 0, 0, len(page)
    opened: Counter[str] = Counter()

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((stack[-1][1], text, linked, stack[-1][3], stack[-1][4]))
            parts, linked = [], 0

    def pop(to: int):
        nonlocal links
        if stack[-1][4] != stack[to - 1][4]:
            flush()
        for tag, *_ in stack[to:]:
            links -= tag == "a"
            opened[tag] -= 1
        del stack[to:]

    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[0] == "<" and len(text) > 1:
                continue
            if not stack[-1][2]:
                parts.append(entities.unescape(text) if "&" in text else text)
                linked += len(text) * (links > 0)
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            for i in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[i][0] == tag:
                    pop(i)
                    break
            continue
        if tag in BLOCK:
            flush()
            if tag == "p" or tag in CONTAINER or tag[0] == "h" and tag[1:].isdigit():
                for i in range(len(stack) - 1, 0, -1) if opened["p"] > 0 else ():  # a block closes an open paragraph
                    if stack[i][0] == "p":
                        pop(i)
                        break
                    if stack[i][0] in CONTAINER:
                        break
            if tag in CLOSES:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in CLOSES[tag]:
                        pop(i)
                        break
                    if stack[i][0] in SCOPE:
                        break
        if tag in VOID:
            continue
        attributes = _attributes(m[3])
        above = stack[-1]
        dropped = above[2] or _dropped(tag, attributes)
        if tag in RAW:
            end = _CLOSE_RAW[tag].search(page, at)
            at = end.end() if end else n
            continue
        if m[3] and m[3].endswith("/") and tag not in BLOCK:
            continue
        path, main = above[1], above[3]
        if tag in CONTAINER and len(stack) < DEPTH:
            classes = ".".join(sorted(set(re.sub(r"\d+", "", attributes.get("class", "")).split())))
            path = f"{path}>{tag}" + (f".{classes}" if classes else "")
            if not main and (tag in ("article", "main") or attributes.get("role") == "main" or tag in ("div", "section", "td") and not _names(attributes).isdisjoint(MAIN_NAMES)):
                main = path
        marked, within = not dropped and tag not in ("html", "body") and bool(attributes) and _named_so(attributes), above[4]
        if tag in ("article", "main"):
            if not dropped and not marked:
                articles.append(within)
        elif marked:
            within = (*within, named)
            named += 1
        if dropped and not above[2] or within != above[4]:
            flush()
        stack.append((tag, path, dropped, main, within))
        links += tag == "a"
        opened[tag] += 1
    flush()
    worth = [0] * named
    for b in out if named else ():
        for i in b[4]:
            worth[i] += max(0, len(b[1]) - 2 * b[2])
    whole = sum(max(0, len(b[1]) - 2 * b[2]) for b in out)
    spared = {i for i in range(named) if all(i in w for w in articles) and (articles or 2 * worth[i] > whole)}
    return [b[:4] for b in out if spared.issuperset(b[4])]


def _worth(text: str, linked: int, main: str) -> int:
    """A block's characters less twice those in links, three times as much under a main tag or name."""
    return max(0, len(text) - 2 * linked) * (3 if main else 1)


def best_path(found: list[tuple[str, str, int, str]]) -> tuple[str | None, float, list[str]]:
    """Path of the best container, its score, and the paths of all containers that hold ``HELD`` of it.

    From the top the way goes down into the container that has most of the score where nothing but
    links lies beside it, or where it has seven tenths and leads to the page's one article or main tag. It ends
    at the highest main tag or name: title, lead and all else in there stay.
    """
    score: dict[str, float] = {}
    text_at: dict[str, int] = {}
    main_at: dict[str, int] = {}
    below: dict[str, set[str]] = {}
    tops: set[str] = set()
    for path, text, linked, main in found:
        worth, up = _worth(text, linked, main), ""
        tagged = main.rpartition(">")[2].partition(".")[0] in ("article", "main")
        for here in ["", *_prefixes(path)]:
            score[here] = score.get(here, 0) + worth
            text_at[here] = text_at.get(here, 0) + (worth > 0)
            main_at[here] = main_at.get(here, 0) + (worth > 0 and tagged)
            if here:
                below.setdefault(up, set()).add(here)
            up = here
        if main:
            tops.add(main)
    if not found:
        return None, 0.0, []
    at = ""
    while at in below and at not in tops and score[at]:
        child = max(below[at], key=lambda p: (score[p], p))
        alone = text_at[child] == text_at[at]
        to_main = main_at[child] == main_at[at] > 0 and score[child] >= 0.7 * score[at]
        if not alone and not to_main:
            break
        at = child
    return at, float(score[at]), sorted(p for p, s in score.items() if s >= HELD * score[at])


def _prefixes(path: str) -> list[str]:
    return [path[:i] for i in [k for k, c in enumerate(path) if c == ">" and k] + [len(path)] if i]


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path (vote), score, able (paths that hold enough), blocks (path, text, worth) of every page."""
    kind = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string()), ("worth", pa.int64())]))

    def rows(batch: pa.RecordBatch):
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            found = [blocks(h or "") for h in part["html"].to_pylist()]
            votes = [best_path(f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [part["page_id"], part["url"], part["host"], pa.array([v[0] for v in votes], pa.string()), pa.array([v[1] for v in votes], pa.float64()), pa.array([v[2] for v in votes], pa.list_(pa.string())), pa.array([[{"path": b[0], "text": b[1], "worth": _worth(*b[1:])} for b in f] for f in found], kind)],
                ["page_id", "url", "host", "path", "score", "able", "blocks"],
            )

    url = F.col("url").cast("string")
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    base = pages.select(F.col("page_id").cast("long"), url.alias("url"), host.alias("host"), F.col("html").cast("string"))
    return by_batch(base, rows, "page_id long, url string, host string, path string, score double, able array<string>, blocks array<struct<path:string,text:string,worth:bigint>>")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path (the one that gave the text), text of every page.

    Of the paths voted on a page's host, and that hold ``HELD`` of the page's own best score on it, the one
    with most votes wins; the page's own is among them. Null html gives an empty
    text. Pages without a host are one host. Equal votes: the higher summed score wins, then the
    greater path. Repeated rows count as votes and are extracted alike. No rows: no rows.
    Extra columns are not read.
    """
    read = stored(read_pages(pages), "pages")
    votes = read.filter("path is not null and score > 0").groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
    # pages of one template can take the same paths: a row per host and such list, not per page
    choices = read.select("host", "able").distinct().select("host", "able", F.explode("able").alias("path"))
    won = choices.join(votes, ["host", "path"]).groupBy("host", "able").agg(F.max_by("path", F.struct("votes", "score", "path")).alias("won"))
    inside = lambda p: F.filter("blocks", lambda b: (b["path"] == p) | b["path"].startswith(F.concat(p, F.lit(">"))))
    both = read.join(stored(won, "winners"), ["host", "able"], "left").withColumn("path", F.coalesce("won", "path"))
    text = F.coalesce(F.concat_ws(" ", F.transform(inside(F.col("path")), lambda b: b["text"])), F.lit(""))
    return both.select("page_id", "url", "host", "path", text.alias("text"))


def op10_html(spark, sf_dir) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
