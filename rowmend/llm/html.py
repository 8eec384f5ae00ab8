"""HTML extraction by consensus host paths.

Each page's containers are scored by the text they hold directly in paragraphs and headings, less link text. The best
container is lifted to the nearest article or main around it, or without one to the lowest container around all
paragraphs and headings that aren't mostly links. Its path, generalised to tags and classes without digits, is a vote of its page; per host the votes are summed
in Spark, and every page is extracted again from the elements on its host's winning paths and its own path. Blocks in boilerplate elements (menus, headers, footers, sidebars,
notices, adverts, forms, reader comments, and hidden elements) never count.

A header inside an article may hold its title, so `header` counts as boilerplate only outside of article and main.
Words in class, id or role don't bar an element that holds main or h1 or, on a page without an article or main outside of
such elements, an article or most of the paragraphs; layout words (with-sidebar, no-header) bar nothing. A page whose
blocks are all barred by words is read without them.

Inputs: null and empty html give an empty text; a null or odd url is its own host; markup is never required to be
well-formed. Repeated rows give equal rows, pages with one page_id each their own text; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmend.llm.common import save, small, small_batches

# Element kinds of HTML and words in class or id that mark boilerplate.
PROSE = set("p h1 h2 h3 blockquote pre".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math canvas object select xmp noembed noframes".split())
TEXT_ONLY = set("script style textarea title xmp".split())
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
BARRED = set("nav aside footer form button menu dialog label fieldset head".split())
CLOSES_P = BLOCK - set("html body".split())
SAME = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
BAR_WORDS = set("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar rail aside widget related recommended share sharing social cookie cookies consent notice notices notification popup modal overlay newsletter subscribe signup login search comment comments discussion respond replies disqus pagination pager skip copyright legal toolbar".split())
SALT = 16

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPACES = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")
_LAYOUT = re.compile(r"(?<![a-z])(?:with|no|has)[-_]+[a-z_-]+")


class Path:
    """A generalised path; `seen` holds one of each in a page, parents before children."""

    __slots__ = ("up", "step", "depth", "number", "hash")

    def __init__(self, up: Path | None, step: str, number: int):
        self.up, self.step, self.number = up, step, number
        self.depth = up.depth + 1 if up else 0
        digest = blake2b((up.hash.to_bytes(8, "little", signed=True) if up else b"") + step.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        self.hash = int.from_bytes(digest, "little", signed=True)


class Doubts(NamedTuple):
    """The elements around a block that words may bar: the innermost one's number, and those around it."""

    number: int
    up: Doubts | None


class Block:
    """A block's text with the generalised paths of the elements around it, and those of them that words may bar."""

    __slots__ = ("parts", "path", "tag", "linked", "doubts")

    def __init__(self, path: Path, tag: str, doubts: Doubts | None):
        self.parts: list[str] = []
        self.path, self.tag, self.linked, self.doubts = path, tag, 0, doubts


def blocks(html: str) -> list[tuple[Path, str, str, int]]:
    """(path, tag, text, linked characters) of all blocks outside of boilerplate, in page order. Linear in the page."""
    out: list[Block] = []
    root = Path(None, "", 0)
    seen: dict[tuple[Path, str], Path] = {}
    stack: list[tuple[str, Path, str, bool, Doubts | None]] = []  # (tag, path, innermost block tag, barred, elements that words may bar)
    doubtful, spared, wraps, plain = 0, set(), set(), False
    now: Block | None = None
    at, unclosed = 0, set()  # tags that don't end any more
    opened: Counter[str] = Counter()  # elements of each tag on the stack

    def text(s: str) -> None:
        nonlocal now
        if not s or (stack and stack[-1][3]):
            return
        if now is None:
            if not s.strip():
                return
            now = Block(*((stack[-1][1], stack[-1][2], stack[-1][4]) if stack else (root, "", None)))
            out.append(now)
        now.parts.append(s)
        if opened["a"]:
            now.linked += len(s.strip())

    def end_block() -> None:
        nonlocal now
        now = None

    for m in _TOKEN.finditer(html):
        if m.start() < at:
            continue
        token = m[0]
        text(unescape(html[at : m.start()]))
        at = m.end()
        if token[1] in "!?":
            if token.startswith("<![CDATA["):
                text(token[9:].removesuffix("]]>"))
            continue
        tag = _NAME.match(token)[1].lower()
        if token[1] == "/":
            if tag == "br":
                text(" ")
            elif opened[tag]:
                while stack:
                    t, *_ = stack.pop()
                    opened[t] -= 1
                    if t == tag:
                        break
            if tag in BLOCK:
                end_block()
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in BLOCK:
            end_block()
            if tag in CLOSES_P and opened["p"]:
                while stack:
                    t, *_ = stack.pop()
                    opened[t] -= 1
                    if t == "p":
                        break
            shut = SAME.get(tag, ())
            while stack and stack[-1][0] in shut:
                opened[stack.pop()[0]] -= 1
        if tag in RAW:
            if token.endswith("/>") and tag not in TEXT_ONLY:
                continue
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at) if tag not in unclosed else None
            if end is None:
                unclosed.add(tag)
            at = end.end() if end else (len(html) if tag in TEXT_ONLY else at)
            continue
        if tag in VOID or token.endswith("/>") and tag not in BLOCK:
            continue
        named = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(token[len(tag) + 1 : -1])}
        classes = _SPACES.sub(" ", re.sub(r"\d+", "", named.get("class", ""))).strip().lower()
        words = set(_WORD.findall(_LAYOUT.sub(" ", f"{classes} {named.get('id', '')} {named.get('role', '')}".lower())))
        inside = opened["article"] or opened["main"]
        barred = bool(stack and stack[-1][3]) or tag in BARRED or tag == "header" and not inside or "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", "").lower()
        path, around, doubts = (stack[-1][1], stack[-1][2], stack[-1][4]) if stack else (root, "", None)
        if tag not in ("html", "body", "main", "article", "h1") and words & BAR_WORDS:
            doubts, doubtful = Doubts(doubtful, doubts), doubtful + 1
        if not barred and tag in ("main", "h1"):
            _mark(spared, doubts)
        if not barred and (tag == "main" or tag == "article" and not words & BAR_WORDS):
            _mark(wraps, doubts)
            plain |= doubts is None
        opened[tag] += 1
        if tag in BLOCK:
            step = f"{tag}.{classes.replace(' ', '.')}" if classes else tag
            if (path, step) not in seen:
                seen[path, step] = Path(path, step, len(seen) + 1)
            path, around = seen[path, step], tag
        stack.append((tag, path, around, barred, doubts))
    if at < len(html):
        rest = html[at:]
        cut = rest.find("<")
        if cut >= 0 and re.match(r"</?[a-zA-Z!?]", rest[cut:]):
            rest = rest[:cut]
        text(unescape(rest))
    done = [(b.doubts, (b.path, b.tag, t, b.linked)) for b in out if (t := _SPACES.sub(" ", "".join(b.parts)).strip())]
    if doubtful and not plain:
        held, ups = [0] * doubtful, [-1] * doubtful
        for doubts, (_, tag, t, _) in done:
            if doubts and tag == "p":
                held[doubts.number] += len(t)
            while doubts and ups[doubts.number] == -1:
                ups[doubts.number] = doubts.up.number if doubts.up else -2
                doubts = doubts.up
        for d in range(doubtful - 1, -1, -1):  # the outer ones have lower numbers
            if ups[d] >= 0:
                held[ups[d]] += held[d]
        most = sum(len(t) for _, (_, tag, t, _) in done if tag == "p") / 2
        spared |= wraps | {d for d, n in enumerate(held) if n > most}
    clear: dict[int, bool] = {}
    return [b for doubts, b in done if _clear(doubts, spared, clear)] or [b for _, b in done]


def _mark(marked: set[int], doubts: Doubts | None) -> None:
    while doubts and doubts.number not in marked:
        marked.add(doubts.number)
        doubts = doubts.up


def _clear(doubts: Doubts | None, spared: set[int], known: dict[int, bool]) -> bool:
    """Whether all of `doubts` are spared."""
    way = []
    while doubts and doubts.number not in known:
        way.append(doubts.number)
        doubts = doubts.up
    clear = known[doubts.number] if doubts else True
    for d in reversed(way):
        clear = known[d] = clear and d in spared
    return clear


def best_path(found: list) -> tuple[Path, float] | None:
    """The container with the highest score: text of its own blocks, a share of nested blocks', less link text."""
    scores: dict[Path, float] = {}
    for path, tag, text, linked in found:
        worth = (len(text) - 2 * linked) * (1.5 if tag in PROSE else 1.0)
        holder = path.up if path.depth and tag not in ("body", "div", "article", "section", "main", "td") else path
        for key, share in ((holder, 1.0), (holder.up, 0.5)):
            if key and key.depth:
                bonus = 1.25 if _article(key) else 1.0
                scores[key] = scores.get(key, 0.0) + worth * share * bonus
    if not scores:
        return None
    key = max(scores, key=lambda k: (scores[k], -k.depth, -k.number))
    return _lifted(found, key), scores[key]


def _article(path: Path) -> bool:
    return path.step.split(".")[0] in ("article", "main")


def _lifted(found: list, key: Path) -> Path:
    """The nearest article or main around `key`, or else the lowest container around all prose without many links.

    That isn't the whole body where `key` holds at least half of this prose: what else the body holds is something else.
    """
    prose = [path for path, tag, text, linked in found if tag in PROSE and 2 * linked < len(text)]
    whole: Path | None = key
    while whole and whole.depth and not _article(whole):
        whole = whole.up
    if whole and whole.depth:
        within, inside = _under(prose, {whole.hash}), _under(prose, {key.hash})
        return whole if any(w and not i for w, i in zip(within, inside, strict=True)) else key
    below: dict[Path, int] = Counter(prose)
    for path in sorted(_around(found), key=lambda p: -p.number):  # children come before their parents
        if path.up and path in below:
            below[path.up] = below.get(path.up, 0) + below[path]
    lowest = key
    while lowest.depth and below.get(lowest, 0) < len(prose):
        lowest = lowest.up
    if lowest.depth and lowest.step.split(".")[0] in ("body", "html"):
        sizes = [len(text) for _, tag, text, linked in found if tag in PROSE and 2 * linked < len(text)]
        held = sum(n for n, inside in zip(sizes, _under(prose, {key.hash}), strict=True) if inside)
        return key if 2 * held >= sum(sizes) else lowest
    return lowest if lowest.depth else key


def _under(paths: list[Path], wanted: set[int]) -> list[bool]:
    """Whether each path or one around it has a wanted hash."""
    known: dict[Path, bool] = {}
    out = []
    for path in paths:
        way = []
        while path and path not in known:
            way.append(path)
            path = path.up
        inside = known[path] if path else False
        for p in reversed(way):
            inside = known[p] = inside or p.depth > 0 and p.hash in wanted
        out.append(inside)
    return out


def text_under(found: list, wanted: set[int]) -> str:
    """The text of the blocks under paths of the wanted hashes."""
    return "\n".join(b[2] for b, inside in zip(found, _under([b[0] for b in found], wanted), strict=True) if inside)


def _around(found: list) -> set[Path]:
    """All paths around a page's blocks."""
    out: set[Path] = set()
    for path, *_ in found:
        while path and path.depth and path not in out:
            out.add(path)
            path = path.up
    return out


def host(url):
    """Host of an url column; the url itself where it has none."""
    name = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(name != "", name).otherwise(F.coalesce(url, F.lit("")))


def extract(pages: DataFrame, share: float = 0.2, heaviest: float = 10_000.0) -> DataFrame:
    """`pages` (page_id, url, html) to (page_id, url, text). A path wins on a host with at least `share` of the best path's votes.

    A page's vote weighs as much as its container's score, but not more than `heaviest`, so that no page decides alone.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, votes, paths = [], [], []
            for h in batch.column(3).to_pylist():
                found = blocks(h) if h else []
                best = best_path(found)
                own.append(best[0].hash if best else None)
                votes.append(min(best[1], heaviest) if best else 0.0)
                paths.append([p.hash for p in _around(found)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.int64()), pa.array(votes, pa.float64()), pa.array(paths, pa.list_(pa.int64()))], names=["k1", "k2", "host", "own", "votes", "paths"])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for h, won in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                found = blocks(h) if h else []
                best = best_path(found)
                text = text_under(found, {*(won or ()), *([best[0].hash] if best else [])})
                texts.append(text or "\n".join(b[2] for b in found))  # no container at all
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    known = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    # Equal rows have equal keys and equal texts.
    known = known.withColumn("k1", F.xxhash64("page_id", "url", "html")).withColumn("k2", F.xxhash64(F.lit(7), "page_id", "url", "html"))
    votes = small_batches(known).select("k1", "k2", host(F.col("url")).alias("host"), "html").mapInArrow(vote, "k1 long, k2 long, host string, own long, votes double, paths array<long>")
    votes = save(votes)
    tally = votes.where("own is not null").groupBy("host", F.col("own").alias("path")).agg(F.sum("votes").alias("votes"))
    ballots = tally.groupBy("host").agg(F.max("votes").alias("most"))
    winners = save(tally.join(ballots, "host").where(F.col("votes") >= share * F.col("most")).select("host", "path"))
    # Each page's own paths meet the winning ones by host and path, the pages of a hot host in SALT parts.
    salted = small(winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))))
    mine = votes.withColumn("salt", F.pmod("k1", F.lit(SALT)).cast("int")).select("k1", "k2", "host", "salt", "own", F.explode("paths").alias("path")).where("own is null or path <> own")
    won = save(mine.join(salted, ["host", "path", "salt"]).groupBy("k1", "k2").agg(F.collect_set("path").alias("won")))
    out = known.join(small(won, 100_000), ["k1", "k2"], "left")
    return out.select("page_id", "url", "html", "won").mapInArrow(take, "page_id long, url string, text string")
