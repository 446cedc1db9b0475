"""Main text of web pages: block structure, and a suffix array over each host's token streams.

A page becomes a stream of blocks. Markup decides what it names: containers of chrome (menus, headers, footers, sidebars,
notices, adverts, forms, comments) go, and an article's blocks stay, as a passage may well be quoted from page to page.
All other blocks are open, beside an article too. The open token streams of a host's pages are laid end to end and their
suffixes sorted; a string of tokens that stands in enough distinct pages of the host is boilerplate. Tokens that such
strings cover are removed and unique runs are kept; what is left, in page order, is the main text.

Pages are parsed where they are read, and those without open blocks are done then. Of pages with the same open stream one
goes on. A host's streams are cut into groups of bounded size; each group's suffix array gives the distinct pages of its
strings, and the groups' counts are added up over the host before anything is removed. How a host is cut changes nothing.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .common import mixed, read, stored, text_hashes

#: Bytes of open text in a group, on average.
GROUP_BYTES = 4 << 20
#: Tokens that a repeated string has at least (or all of a shorter block), and distinct pages of the host that it stands in.
LEAST_TOKENS, LEAST_PAGES = 4, 3

# Element names of HTML.
SKIPPED = frozenset("head script style noscript template svg math iframe object canvas audio video select option datalist button textarea".split())
CHROME = frozenset("nav header footer aside form menu dialog".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Words of a class, id or role that mark chrome, and those that mark the article.
CHROME_WORDS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer header menu menubar modal nav navbar navigation newsletter notice notices popup promo promoted related reply replies share sharing sidebar social sponsor sponsored subscribe toolbar widget complementary contentinfo consent gdpr masthead pagination pager respond alert dialog search".split())
ARTICLE_WORDS = frozenset("article main".split())
ARTICLE_ATTRIBUTES = ("articlebody",)

#: Elements that hold a text themselves: a class marks them as chrome only if all its words do.
TEXT_ELEMENTS = frozenset("p h1 h2 h3 h4 h5 h6 span a b i em strong blockquote pre q cite code time figure figcaption td th".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SPACE = re.compile(r"\s+")


def _role(name: str, attributes: str) -> str:
    """What an element says of its content: chrome, article, hidden, or nothing."""
    if name in CHROME:
        return "chrome"
    if name in ("article", "main"):
        kind = "article"
    else:
        kind = ""
    if not attributes.strip():
        return kind
    found = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", ""), re.I) or found.get("aria-hidden", "").lower() == "true":
        return "hidden"
    words = {w.lower() for k in ("class", "id", "role") for w in _WORD.findall(found.get(k, ""))}
    marks = words & CHROME_WORDS
    if name not in ("html", "body") and marks and not (name in TEXT_ELEMENTS and marks != words) and not (kind and not words & {"comment", "comments", "ad", "ads", "related", "sponsored", "promo", "reply", "replies"}):
        return "chrome"
    if words & ARTICLE_WORDS and name in ("div", "section", "td"):
        return "article"
    return kind or ("article" if found.get("itemprop", "").lower() in ARTICLE_ATTRIBUTES else "")


def page_blocks(source: str | None) -> list[tuple[str, bool, bool]]:
    """(text, in chrome, in article) of every block with text, in page order.

    Unclosed and misnested tags are taken as browsers do where it matters: an end tag closes up to its start tag, one
    without a start tag is ignored, and markup cut off at the end of the page is dropped.
    """
    out: list[tuple[str, bool, bool]] = []
    if not source:
        return out
    stack: list[tuple[str, str]] = []
    depth = {"chrome": 0, "article": 0, "hidden": 0, "": 0}
    pieces: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
        if text:
            out.append((text, depth["chrome"] > 0, depth["article"] > 0))
        pieces.clear()

    at, n = 0, len(source)
    while at < n:
        tag = source.find("<", at)
        if tag < 0:
            tag = n
        if tag > at and not depth["hidden"]:
            pieces.append(source[at:tag])
        if tag == n:
            break
        m = _TAG.match(source, tag)
        if not m:
            if not depth["hidden"]:
                pieces.append("<")
            at = tag + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if closing and all(n != name for n, _ in stack):
            continue
        if name in BLOCKS or name in SKIPPED:
            flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    for _, role in stack[k:]:
                        depth[role] -= 1
                    del stack[k:]
                    break
            continue
        role = "hidden" if name in SKIPPED else _role(name, m[3])
        if name in VOID or m[0].endswith("/>") and name not in BLOCKS and name not in SKIPPED:
            continue
        if name == "p" and stack and stack[-1][0] == "p":
            depth[stack.pop()[1]] -= 1
        if role:
            flush()
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(source, at)
            at = end.start() if end else n
            if end:
                at = source.find(">", end.start()) + 1 or n
            continue
        stack.append((name, role))
        depth[role] += 1
    flush()
    return out


def suffix_ranks(tokens: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of tokens by their first ``least`` or more (prefix doubling), and equal ranks for equal starts."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    order, step = np.argsort(rank, kind="stable"), 1
    while step < least:
        ahead = np.zeros(n, np.int64)
        gap = min(step, least - step)
        if gap < n:
            ahead[: n - gap] = rank[gap:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], (ordered[1:] != ordered[:-1]).astype(np.int64))))
        step += gap
    return order, rank


class Streams:
    """The open token streams of pages, end to end; a separator (-1) stands behind each block."""

    def __init__(self, pages: list[list[str]]):
        number: dict[str, int] = {}
        token, page, block = [], [], []
        self.sizes: list[int] = []
        for i, blocks in enumerate(pages):
            for text in blocks:
                words = text.split(" ")
                token += [number.setdefault(w, len(number)) for w in words]
                token.append(-1)
                page += [i] * (len(words) + 1)
                block += [len(self.sizes)] * (len(words) + 1)
                self.sizes.append(len(words))
        self.token, self.page, self.block = np.array(token, np.int64), np.array(page, np.int64), np.array(block, np.int64)
        self.names = text_hashes([w.encode("utf-8", "surrogatepass") for w in number])

    def strings(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and 64-bit name of every string of ``least`` tokens inside a block, and of every shorter block."""
        size = np.array(self.sizes, np.int64)
        first = np.cumsum(size + 1) - (size + 1)
        many = np.maximum(size - least + 1, 1)
        start = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        length = np.repeat(np.minimum(size, least), many)
        name = length.astype(np.uint64)
        with np.errstate(over="ignore"):
            for k in range(least):
                own = np.flatnonzero(length > k)
                name[own] = mixed(name[own] * np.uint64(0x9E3779B97F4A7C15) + self.names[self.token[start[own] + k]])
        return start, length, name


def string_pages(streams: Streams, least_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the distinct strings, and in how many distinct pages each stands: by runs of equal ranks in suffix order."""
    start, length, name = streams.strings(least_tokens)
    if not len(start):
        return name, start
    _, rank = suffix_ranks(streams.token, least_tokens)
    # A shorter block is a string of its own, whatever follows it.
    short = np.unique(name, return_inverse=True)[1] + len(streams.token)
    group = np.where(length == least_tokens, rank[start], short)
    page = streams.page[start]
    order = np.lexsort((page, group))
    group, page, name = group[order], page[order], name[order]
    fresh = np.concatenate(([True], group[1:] != group[:-1]))
    other = fresh | np.concatenate(([True], page[1:] != page[:-1]))
    first = np.flatnonzero(fresh)
    return name[first], np.add.reduceat(other.astype(np.int64), first)


def unique_runs(streams: Streams, repeated: np.ndarray, least_tokens: int) -> np.ndarray:
    """Which tokens no string with a name in ``repeated`` covers; separators are not kept."""
    start, length, name = streams.strings(least_tokens)
    hit = np.isin(name, repeated)
    edge = np.zeros(len(streams.token) + 1, np.int64)
    np.add.at(edge, start[hit], 1)
    np.add.at(edge, (start + length)[hit], -1)
    return (np.cumsum(edge)[:-1] == 0) & (streams.token >= 0)


def left_over(pages: list[list[dict]], repeated: np.ndarray, least_tokens: int) -> list[str]:
    """The texts of pages of blocks (text, open): tokens of open blocks that repeated strings cover are left out."""
    streams = Streams([[b["text"] for b in p if b["open"]] for p in pages])
    kept, at, out = unique_runs(streams, repeated, least_tokens), 0, []
    for p in pages:
        own = []
        for b in p:
            text = b["text"]
            if b["open"]:
                words = text.split(" ")
                text = " ".join(w for w, k in zip(words, kept[at : at + len(words)].tolist(), strict=True) if k)
                at += len(words) + 1
            if text:
                own.append(text)
        out.append(" ".join(own))
    return out


def judged_blocks(source: str | None) -> list[dict]:
    """The blocks that markup does not remove, and whether each is open. Neighbours that it keeps are one."""
    out: list[dict] = []
    for text, chrome, article in page_blocks(source):
        if chrome:
            continue
        if article and out and not out[-1]["open"]:
            out[-1]["text"] += " " + text
        else:
            out.append({"text": text, "open": not article})
    return out


def main_texts(pages: list[str | None], least_tokens: int = LEAST_TOKENS, least_pages: int = LEAST_PAGES) -> list[str]:
    """The main texts of all pages of one host, in one task: for small hosts and tests."""
    found = [judged_blocks(p) for p in pages]
    distinct = {tuple((b["text"], b["open"]) for b in p): [b["text"] for b in p if b["open"]] for p in found}
    names, n = string_pages(Streams(list(distinct.values())), least_tokens)
    return left_over(found, names[n >= least_pages], least_tokens)


BLOCKS_TYPE = pa.list_(pa.struct([("text", pa.string()), ("open", pa.bool_())]))


def _parsed(id_type: pa.DataType):
    """Rows (id, url, host, html) to (id, url, host, key, text, blocks): the text of a page without open blocks, else its blocks and their digest."""
    schema = pa.schema([("id", id_type), ("url", pa.string()), ("host", pa.string()), ("key", pa.binary()), ("text", pa.string()), ("blocks", BLOCKS_TYPE)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                batch = whole.slice(i, 64)
                key, text, blocks = [], [], []
                for source in batch.column(3).to_pylist():
                    found = judged_blocks(source)
                    if any(b["open"] for b in found):
                        digest = hashlib.blake2b(digest_size=16)
                        for b in found:
                            digest.update(b"%d%d " % (b["open"], len(b["text"])) + b["text"].encode("utf-8", "surrogatepass"))
                        key.append(digest.digest())
                        text.append(None)
                        blocks.append(found)
                    else:
                        key.append(None)
                        text.append(" ".join(b["text"] for b in found))
                        blocks.append(None)
                columns = [batch.column(0).cast(id_type), batch.column(1), batch.column(2), key, text, blocks]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return work


def extract_text(pages: DataFrame, id_col: str = "page_id", url: str = "url", source: str = "html", group_bytes: int = GROUP_BYTES, least_tokens: int = LEAST_TOKENS, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(id, url, text) for each row of ``pages``: the article's text, empty if there is none.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by one space.
    Null and empty html give an empty text. A page without a url is of the host "". Repeated rows give repeated rows, and
    count as one page; so do pages of a host whose blocks are all the same. An empty table gives no rows. Other columns
    than these three are not read. A page must fit in a Python worker's memory some ten times over, whatever its length.

    Strings are told apart by 64-bit names inside a host; page copies by 128-bit digests.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    kind = dict(pages.dtypes)[id_col]
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).cast("string").alias("url"), host.alias("host"), F.col(source).cast("string").alias("html"))
    id_type = to_arrow_type(rows.schema["id"].dataType)
    parsed = stored(rows.mapInArrow(_parsed(id_type), f"id {kind}, url string, host string, key binary, text string, blocks array<struct<text:string,open:boolean>>"))
    done, waiting = parsed.where("key is null"), parsed.where("key is not null")

    streams = waiting.groupBy("host", "key").agg(F.first("blocks").alias("blocks"))
    sized = streams.withColumn("n", F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + F.octet_length(b["text"])))
    parts = sized.groupBy("host").agg(F.ceil(F.sum("n") / F.lit(group_bytes)).cast("int").alias("parts"))
    dealt = stored(sized.join(parts, "host").select("host", "key", "blocks", "parts", F.pmod(F.xxhash64("key"), F.greatest("parts", F.lit(1))).cast("int").alias("part")))

    def counted(table: pa.Table) -> pa.Table:
        names, n = string_pages(Streams([[b["text"] for b in p if b["open"]] for p in table["blocks"].to_pylist()]), least_tokens)
        if table["parts"][0].as_py() <= 1:  # the host is here as a whole
            names, n = names[n >= least_pages], n[n >= least_pages]
        size = len(names)
        return pa.table({"host": pa.array([table["host"][0].as_py()] * size, pa.string()), "part": pa.array(np.full(size, table["part"][0].as_py()), pa.int32()), "name": pa.array(names.view(np.int64), pa.int64()), "n": pa.array(n, pa.int64())})

    strings = dealt.groupBy("host", "part").applyInArrow(counted, "host string, part int, name bigint, n bigint")
    over = strings.withColumn("total", F.sum("n").over(Window.partitionBy("host", "name"))).where(F.col("total") >= least_pages).select("host", "part", "name")

    def cleaned(table: pa.Table, found: pa.Table) -> pa.Table:
        texts = left_over(table["blocks"].to_pylist(), found["name"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), least_tokens)
        return pa.table({"host": table["host"], "key": table["key"], "text": pa.array(texts, pa.string())})

    clean = dealt.groupBy("host", "part").cogroup(over.groupBy("host", "part")).applyInArrow(cleaned, "host string, key binary, text string")
    judged = waiting.select("id", "url", "host", "key").join(clean, ["host", "key"])
    return done.select("id", "url", "text").unionByName(judged.select("id", "url", "text"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = extract_text(read(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


#: For pages whose article is one element with flat markup, as the driver's are.
OP7_SQL = r"""
WITH bare AS (
    SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '<[^>]*>|<[^>]*$', ' ', 'g') AS t FROM pages),
clean AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM bare)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM clean
"""
