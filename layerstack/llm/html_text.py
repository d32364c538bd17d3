"""Main text of web pages, with boilerplate found by suffix arrays of hosts.

A page is read into blocks of text (paragraphs, headings, list items, cells) in page order. Markup says for
most blocks what they are: menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and comments go by their elements, or by words in class, id and role; where a page marks
its article (article, itemprop=articleBody, usual class names; else main or role=main), the rest goes too, and what is in it stays.

Every page also lies in the suffix array of its host. The token streams of a host's pages, menus and all, with a
sign at the end of each block, are taken together, and their suffixes are sorted (by prefix doubling) by their first
`RUN` tokens; neighbours that agree in these and are of different pages begin a repeated substring. Longer ones are
covered by those that begin within them, so the order of later tokens does not matter. A block that repeated substrings
cover to more than half is boilerplate, and unique runs stay. The markup then checks that: it keeps what is in a
page's article, as articles repeat each other's passages, and drops what it names, as adverts need not repeat.
On pages without a mark the array decides what stays of the blocks that markup does not name.

Pages are dealt to packs by host. A host of more than `PACK_BYTES` of html is dealt to several, each with an array of
its part; then parts exchange the beginnings of their suffixes, named by host and 64-bit hash, of which 48 bits beside
those of the range are sent. No pack holds more than one copy of a page from each task that reads; further copies are in
packs of their own that ask and tell nothing.

Defined results: a null page has an empty text; what cannot be parsed is read as text or tag, as browsers do;
unclosed elements end with their parents; rows are kept one to one; equal rows are one page to their
host; a null url is a host of its own; an input column named like a result column is replaced.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from layerstack.llm.common import gram_hashes, index_of, mix64, with_arrow, without
from layerstack.llm.packs import Answers, ask, join_answers

#: Bytes of html in a pack of pages, and of a suffix's name that packs of one host exchange (beside the bits of its range).
PACK_BYTES, NAME_BYTES = 16 << 20, 6
PAGE = pa.struct([("host", pa.string()), ("same", pa.int64()), ("kind", pa.int32()), ("blocks", pa.binary())])
#: Kinds of packs: hosts that are in one pack, a part of a larger host's pages, and further copies of such pages.
WHOLE, PART, COPIES = 0, 1, 2

#: Tokens (block ends among them) of the shortest repeated substring, and the share of a block that
#: repeats must cover.
RUN, COVERED = 6, 0.5

#: Elements whose content is no text of the page.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
DROPPED = RAW | {
    "nav", "header", "footer", "aside", "form", "noscript", "template", "svg", "math", "button", "select", "menu",
    "dialog", "object", "canvas", "audio", "video", "map", "head",
}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
#: What an element's start closes, if open in the same parent.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
    "tfoot": {"tr", "td", "th", "tbody"},
}
SCOPES = {"ul", "ol", "dl", "table", "select", "article", "main", "section", "div", "body", "blockquote"}
#: Open elements that a start tag looks for; others are passed over at once, however many are open.
LANDMARKS = SCOPES | {"p"}.union(*CLOSES.values())
#: Words in class, id or role that name boilerplate.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|promo(?:tion|s)?|banners?"
    r"|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|aside|widgets?|footers?|headers?|masthead"
    r"|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|newsletter|subscribe|subscription|signup|login"
    r"|comments?|commentlist|discussion|disqus|respond|replies|share|sharing|social|related|recommended"
    r"|toolbar|pagination|pager|skip|copyright|complementary|contentinfo|search)(?=$|[\s_-])",
    re.I,
)
MAIN_NAMES = re.compile(
    r"(?:^|[\s_-])(?:article|post|entry|story|main)[_-]?(?:body|content|text)(?=$|[\s_-])", re.I
)
TAG = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$))*+)(?:>|$)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block:
    """A block's text and its level: 2 within an article, 1 within the main part, else 0; -1 in what markup drops."""

    __slots__ = ("text", "level")

    def __init__(self, text: str, level: int):
        self.text, self.level = text, level


def _kind(name: str, attributes: str) -> str:
    """drop, article, main, or empty for an element that says nothing."""
    if name in DROPPED:
        return "drop"
    mark = name if name in ("article", "main") else ""
    if attributes and not attributes.isspace():
        values = {}
        for key, value in ATTRIBUTE.findall(attributes):
            values.setdefault(key.lower(), html.unescape(value.strip("\"'")) if value else "")
        if "hidden" in values or values.get("aria-hidden") == "true" or HIDDEN.search(values.get("style", "")):
            return "drop"
        names = " ".join(values.get(k, "") for k in ("class", "id", "role"))
        if "articlebody" in values.get("itemprop", "").lower() or MAIN_NAMES.search(names):
            return "article"
        if values.get("role") == "main":
            return "main"
        if names.strip():
            if name not in ("html", "body", "article", "main") and NAMES.search(names):
                return "drop"
            if name == "article" and re.search(r"(?:^|[\s_-])comments?(?=$|[\s_-])", names, re.I):
                return "drop"
    return mark


def blocks_of(page: str | None, whole: bool = False) -> list[Block]:
    """Blocks of text that no element marks as boilerplate, in page order; if `whole`, those others too."""
    page = page or ""
    out: list[Block] = []
    parts: list[str] = []
    lost: list[str] = []  # text in dropped elements
    stack: list[tuple[str, str]] = []  # element and its kind
    open_names: Counter = Counter()
    landmarks: list[int] = []  # places in the stack
    drop = main = article = 0
    at, end = 0, len(page)

    def flush() -> None:
        held = lost if drop else parts
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.append(Block(text, -1 if drop else 2 if article else int(main > 0)))

    def pop() -> str:
        nonlocal drop, main, article
        name, kind = stack.pop()
        open_names[name] -= 1
        if landmarks and landmarks[-1] == len(stack):
            landmarks.pop()
        if name in BLOCKS if not drop else lost and (name in BLOCKS or (kind == "drop" and drop == 1)):
            flush()
        drop -= kind == "drop"
        main -= kind == "main"
        article -= kind == "article"
        return name

    for m in TAG.finditer(page):
        begin = m.start()
        if begin < at:
            continue  # inside an element whose content is not markup
        if begin > at and (whole or not drop):
            (lost if drop else parts).append(html.unescape(page[at:begin]))
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            if open_names[name]:
                while pop() != name:
                    pass
            elif name in BLOCKS:
                flush()
            continue
        closes = CLOSES.get(name)
        if name in BLOCKS:
            # A block ends an open paragraph with all that is open in it.
            for i in reversed(landmarks):
                if stack[i][0] == "p":
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] in SCOPES:
                    break
            flush()
        if closes:
            for i in reversed(landmarks):
                if stack[i][0] in closes:
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] in SCOPES and stack[i][0] not in closes:
                    break
        if name in VOID:
            if name in BLOCKS:
                flush()
            elif name == "br" and (whole or not drop):
                (lost if drop else parts).append(" ")
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)", re.I).search(page, at)
            at = end if close is None else (page.find(">", close.end()) + 1 or end)
            continue
        kind = _kind(name, m.group(3) or "")
        if name in LANDMARKS:
            landmarks.append(len(stack))
        open_names[name] += 1
        stack.append((name, kind))
        drop += kind == "drop"
        main += kind == "main"
        article += kind == "article"
    if at < end and (whole or not drop):
        (lost if drop else parts).append(html.unescape(page[at:]))
    flush()
    if drop:
        drop = 0
        flush()
    return out


def main_text(blocks: list[Block]) -> str | None:
    """The text of a page whose markup tells its article; None where it does not."""
    level = max((b.level for b in blocks), default=2)
    return "\n\n".join(b.text for b in blocks if b.level == level) if level else None


def host_of(url: str | None) -> str | None:
    try:
        return urlsplit(url).hostname if url is not None else None
    except ValueError:
        return url


def stream(blocks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a page's tokens, with 0 at the end of each block, and the block of each token."""
    tokens, owner = [], []
    for i, block in enumerate(blocks):
        words = block.split()
        tokens += [xxhash.xxh3_64_intdigest(w.encode()) for w in words]
        tokens.append(0)
        owner += [i] * (len(words) + 1)
    return np.array(tokens, np.uint64), np.array(owner, np.int64)


def suffix_array(tokens: np.ndarray, host: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Places of all suffixes in order of host and first `run` tokens, and which agree in these with the one before.

    Prefix doubling: ranks by one token give ranks by two, these by four, up to `run`.
    """
    count = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1  # 0 is beyond the end
    depth = 1
    while depth < run:
        step = min(depth, run - depth)
        after = np.zeros(count, np.int64)
        after[: max(0, count - step)] = rank[step:]
        rank = np.unique(rank * (count + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        depth += step
    keys = host * (count + 2) + rank
    order = np.argsort(keys, kind="stable")
    agrees = np.zeros(count, bool)
    agrees[1:] = keys[order[1:]] == keys[order[:-1]]
    return order, agrees


def repeated_in(order: np.ndarray, agrees: np.ndarray, page: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Flags of suffixes that agree with one of a different page; only `whole` ones have all their tokens."""
    kept = whole[order]
    # A suffix that a page's end cuts short goes; the next one then agrees with the last before it.
    run = np.cumsum(~agrees)[kept]
    order = order[kept]
    out = np.zeros(len(page), bool)
    if len(order):
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        own = page[order]
        several = np.minimum.reduceat(own, starts) < np.maximum.reduceat(own, starts)
        out[order] = np.repeat(several, np.diff(np.r_[starts, len(order)]))
    return out


def shares_of(
    tokens: np.ndarray, owner: np.ndarray, repeated: np.ndarray, count: int, run: int = RUN
) -> np.ndarray:
    """The share of each of `count` blocks that repeated substrings (beginning at flagged suffixes) cover."""
    covered = np.zeros(len(tokens) + run + 1, np.int64)
    at = np.flatnonzero(repeated)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + run, -1)
    covered = (np.cumsum(covered)[: len(tokens)] > 0) & (tokens != 0)
    sizes = np.bincount(owner[tokens != 0], minlength=count)
    return np.bincount(owner[covered], minlength=count) / np.maximum(sizes, 1)


def unique_blocks(blocks: list[str], repeated: np.ndarray, run: int = RUN) -> list[str]:
    """Blocks that repeated substrings (beginning at flagged suffixes) cover to a half at most."""
    shares = shares_of(*stream(blocks), repeated, len(blocks), run)
    return [b for b, share in zip(blocks, shares) if share <= COVERED]


def judged(blocks: list[Block], shares: np.ndarray) -> str:
    """The blocks that the array leaves, checked by the markup: it keeps an article's and drops what it names."""
    level = max((b.level for b in blocks if b.level >= 0), default=2)
    return "\n\n".join(
        b.text for b, share in zip(blocks, shares) if b.level == level and (level or share <= COVERED)
    )


def packed(blocks: list[Block]) -> bytes:
    """Blocks as they are sent to other tasks: a line each, which begins with the level."""
    return zlib.compress("\n".join(f"{b.level + 1}{b.text}" for b in blocks).encode(), 4)


def unpacked(data: bytes) -> list[Block]:
    return [Block(line[1:], int(line[0]) - 1) for line in zlib.decompress(data).decode().split("\n") if line]


class Streams:
    """The token streams of a pack's pages, one after another, and what their suffix array says."""

    def __init__(self, pages: list[dict], run: int):
        each = [stream([b.text for b in unpacked(p["blocks"])]) for p in pages]
        sizes = np.array([len(t) for t, _ in each], np.int64)
        self.each, self.cuts = each, np.cumsum(np.r_[0, sizes])
        self.tokens = np.concatenate([t for t, _ in each])
        numbers: dict = {}
        # A page without a host is compared with none.
        hosts = [numbers.setdefault((i, None) if p["host"] is None else p["host"], i) for i, p in enumerate(pages)]
        number = np.repeat(np.arange(len(pages)), sizes)
        self.whole = np.arange(len(self.tokens)) + run <= self.cuts[1:][number]
        order, agrees = suffix_array(self.tokens, np.array(hosts, np.int64)[number], run)
        same = np.array([p["same"] for p in pages], np.int64)[number]
        self.repeated = repeated_in(order, agrees, same, self.whole)
        salts = [xxhash.xxh3_64_intdigest((p["host"] or "").encode()) for p in pages]
        self.salt = np.array(salts, np.uint64)[number]

    def names(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct names of the beginnings of all whole suffixes, ascending, and the place of each among them."""
        grams = np.zeros(len(self.tokens), np.uint64)
        found = gram_hashes(self.tokens, run)
        grams[: len(found)] = found
        return np.unique(mix64(grams ^ self.salt)[self.whole], return_inverse=True)


def _repeated_across(hashes: np.ndarray, payload: np.ndarray) -> np.ndarray:
    """Whether different pages have a suffix: two parts of the host, or two pages of one part, as its payload (1) says.

    Copies of a page have their first one in a part, so they (payload 2) are told what holds for that.
    """
    order = np.argsort(hashes, kind="stable")
    starts = np.flatnonzero(np.r_[True, hashes[order[1:]] != hashes[order[:-1]]])
    own = payload[order]
    several = np.add.reduceat(own != COPIES, starts, dtype=np.int64) > 1
    within = np.maximum.reduceat(own == 1, starts)
    sizes = np.diff(np.r_[starts, len(order)])
    out = np.empty(len(order), np.uint8)
    out[order] = np.repeat(several, sizes) | (np.repeat(within, sizes) & (own == COPIES))
    return out


def extract(
    df: DataFrame, page: str = "html", url: str = "url", out: str = "text", run: int = RUN,
    keep: list[str] | None = None, pack_bytes: int = PACK_BYTES,
) -> DataFrame:
    """The columns named by `keep` (else all) and the main text of each page."""
    pages = without(df, out)
    at, url_at = index_of(pages, page), index_of(pages, url)
    names = pages.columns
    kept = [i for i, c in enumerate(names) if keep is None or c.lower() in {k.lower() for k in keep}]
    bare = pages.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)])

    host = F.udf(host_of, "string", useArrow=True)
    sizes = bare.select(
        host(F.col(f"_c{url_at}").cast("string")).alias("host"),
        F.coalesce(F.octet_length(F.col(f"_c{at}").cast("string")), F.lit(0)).alias("size"),
    ).groupBy("host").agg(F.sum("size").alias("size"))
    # At most one host for each `pack_bytes` of input comes to the driver.
    large = F.col("host").isNotNull() & (F.col("size") > pack_bytes)
    total, hosts = sizes.agg(
        F.sum(F.when(large, 0).otherwise(F.col("size"))), F.collect_list(F.when(large, F.struct("host", "size")))
    ).first()
    bins = 1 + (total or 0) // pack_bytes
    parts, first = {}, bins
    for name, size in sorted(hosts):
        parts[name] = (first, 1 + size // pack_bytes)
        first += parts[name][1]
    copies = first - bins  # packs for further copies, after all others
    seen, turn = set(), 0  # of a task

    def read(batch: pa.RecordBatch) -> list[pa.Array]:
        nonlocal turn
        found, packs = [], []
        for source, address in zip(batch.column(at).to_pylist(), batch.column(url_at).to_pylist()):
            blocks = blocks_of(source, whole=True)
            host = host_of(address)
            turn += 1
            # Pages with the same text, but for what markup drops, are copies. A task's first one of a page goes
            # to the part that has them all; the others, which may be very many, tell that part nothing new.
            same = xxhash.xxh3_64_intdigest("\n".join(b.text for b in blocks if b.level >= 0).encode())
            if host is None:
                kind, number = WHOLE, turn % bins
            elif host not in parts:
                kind, number = WHOLE, xxhash.xxh3_64_intdigest(host.encode()) % bins
            elif (host, same) in seen:
                kind, number = COPIES, first + turn % copies
            else:
                seen.add((host, same))
                kind, number = PART, parts[host][0] + same % parts[host][1]
            packs.append(number)
            found.append({"host": host, "same": same - (1 << 63), "kind": kind, "blocks": packed(blocks)})
        return [pa.array(packs, pa.int64()), pa.array(found, PAGE)]

    added = StructType.fromDDL("pack long, _page struct<host: string, same: long, kind: int, blocks: binary>")
    parsed = with_arrow(bare, added, read)
    own = [f"_c{i}" for i in kept]
    packs = parsed.groupBy("pack").agg(
        F.collect_list(F.struct(F.lit(0).alias("_"), *own)).alias("ids"), F.collect_list("_page").alias("texts")
    )

    def entries(ids: list, texts: list) -> tuple[np.ndarray, np.ndarray]:
        if texts[0]["kind"] == WHOLE:  # settled there
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        streams = Streams(texts, run)
        distinct, place = streams.names(run)
        payload = np.full(len(distinct), COPIES, np.int64)
        if texts[0]["kind"] == PART:
            payload[place] = streams.repeated[streams.whole]
        return distinct, payload

    schema = StructType([pages.schema[i] for i in kept] + [StructField(out, StringType())])
    arrow = to_arrow_schema(StructType([StructField(f"_c{i}", pages.schema[i].dataType) for i in kept]))

    def make(ids: list, texts: list, answers: Answers) -> pa.RecordBatch:
        streams = Streams(texts, run)
        if texts[0]["kind"] != WHOLE:
            distinct, place = streams.names(run)
            streams.repeated[streams.whole] |= answers.to(distinct)[place] > 0
        result = []
        for p, (tokens, owner), a, b in zip(texts, streams.each, streams.cuts, streams.cuts[1:]):
            blocks = unpacked(p["blocks"])
            result.append(judged(blocks, shares_of(tokens, owner, streams.repeated[a:b], len(blocks), run)))
        columns = [pa.array([row[f.name] for row in ids], f.type) for f in arrow]
        return pa.RecordBatch.from_arrays([*columns, pa.array(result, pa.string())], names=schema.names)

    return join_answers(packs, ask(packs, entries, _repeated_across, NAME_BYTES), schema, make)
