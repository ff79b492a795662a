"""Main text of web pages, with boilerplate found by suffix arrays over each host's pages.

A page is cut into blocks at block-level tags. Markup votes on a block: main text (inside article
or main), none (menus, headers, footers, side bars, notices, adverts, forms, comments, by element,
by role, or by a class or id that says nothing else), doubted (a class or id inside main text that
has such a word among others), or no vote. On pages with main text such a word outside of it is a
vote against a block; on others it is none.

Then the repeated substrings decide. Pages' token streams are joined in runs of about
``RUN_TOKENS`` tokens, and a run's suffix array, sorted by the first ``DEPTH`` tokens, names its
substrings. Names are hashes, so the arrays of all runs of a host are merged by counting, for
each substring, the different pages it stands on; pages alike in all their text are one page.
What stands on ``PAGES`` pages of a host or more is repeated, wherever its pages lie, so the size
of runs and the order of rows change nothing.

* A block without a vote, or a doubted one, is left out when over half of its substrings are
  repeated. Of the substrings of a longer block those of least hash among ``WINDOW`` neighbours
  are compared. A block of fewer than ``DEPTH`` tokens is compared with what stands around it: by the
  substring that begins with it and by the one that ends with it.
* A block of main text of ``DEPTH`` tokens or more is compared by the whole chain of its substrings.
  Markup votes for it, and articles share lines, so it is left out as a notice only when its chain
  stands on ``ARTICLE_PAGES`` pages or more and on over half of the host's different pages. With
  ``articles`` it is enough that the chain is repeated. Either way main text stays whole where this
  holds for over half of its tokens: then the page has an article that others repeat. Without
  ``articles`` it also stays whole where over half of a sketch of its substrings (the ``SKETCH`` of
  least hash) is repeated: then it is a near copy, whose unchanged blocks are no notices.

The arrays cover all blocks of all pages, and each page counts for its host, whatever its markup.

Null html and empty pages give an empty text. A null or unreadable url is the host "". Repeated
rows keep a row each and are alike, whatever their order; an empty table gives no rows. Texts are
whole, however long. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_task, bound_batches, drop_table, materialise, pick
from quillspark.llm.suffixes import suffix_array

RUN_TOKENS = 1 << 17
DEPTH = 8
PAGES = 3
WINDOW = 4
#: Pages that a block of an article must stand on before it is taken for a notice.
ARTICLE_PAGES = 8
SKETCH = 16
#: In place of a block's number: a page's sketch, and its host.
OF_SKETCH, OF_HOST = -1, -2
#: A substring with so small a share of all compared ones or less goes through a shuffle; there are
#: fewer than its inverse of others, which are sent to all executors.
HOT_SHARE = 1e-3

# Element names of HTML.
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
MAIN = frozenset("article main".split())
OUTSIDE = frozenset("nav header footer aside form button select dialog menu search head fieldset datalist".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form tablist status".split())
#: Parts of class names and ids that mark what is no main text.
NAMES = frozenset("ad ads adv advert adverts advertisement advertising advertorial banner sponsor sponsored promo promotion sidebar sidebars aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register share sharing social related recommended recommendations comment comments respond disqus reply replies widget pagination pager skip search form copyright legal disclaimer".split())
#: Words that may stand beside those in a name that says nothing else.
BESIDE = frozenset("area bar block body bottom box btn button buttons col column container content footer group head holder icons inner item items left link links list main outer page panel post posts primary right row secondary section site slot text title top unit widget widgets wrap wrapper".split())
#: Elements that the start of another closes.
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>|<[!?][^>]*>|<(?:/?[a-zA-Z][^>]*)?\Z", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+))?")
_MAIN_MARK = re.compile(r"\b(?:role\s*=\s*[\"']?main\b|itemprop\s*=\s*[\"']?articleBody\b)", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

_RNG = np.random.default_rng(42)
_TIMES = _RNG.integers(0, 1 << 64, DEPTH, np.uint64) | np.uint64(1)
_MIX = _RNG.integers(0, 1 << 64, 2, np.uint64) | np.uint64(1)
_SKETCH_SEED = _RNG.integers(0, 1 << 64, dtype=np.uint64)

BOILER, WEAK, PLAIN, DOUBTED, MAIN_TEXT = range(5)


def _outside(name: str, attributes: str) -> int:
    """Whether an element's own attributes say that it is no main text: 2 if so, 1 if one of them hints at it."""
    if not attributes:
        return 0
    hint = 0
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return 2
        if key == "role" and value.lower() in ROLES:
            return 2
        if key in ("class", "id") and name not in ("html", "body", "article", "main"):
            for one in value.split():
                words = [w.lower() for w in _NAME.findall(one)]
                if any(w in NAMES for w in words):
                    if all(w in NAMES or w in BESIDE or w.isdigit() for w in words):
                        return 2
                    hint = 1
        if key == "style" and "display:none" in value.replace(" ", "").lower():
            return 2
    return hint


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of the blocks of a page that hold text, in page order."""
    page = page or ""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # name, kind inside, in main
    kind, inside = PLAIN, False

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((kind, text))

    def close(at: int) -> None:
        nonlocal kind, inside
        if any(n in BLOCK for n, _, _ in stack[at:]):
            flush()
        del stack[at:]
        kind, inside = (stack[-1][1], stack[-1][2]) if stack else (PLAIN, False)

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        parts.append(page[at : m.start()])
        at = m.end()
        if not m.group(2):
            continue
        name = m.group(2).lower()
        if m.group(1):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            else:
                if name in BLOCK:
                    flush()
            continue
        if name == "br":
            parts.append(" ")
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if name in VOID:
            if name in BLOCK:
                flush()
            continue
        if name in BLOCK:
            # A block ends an open paragraph, and some elements end their like.
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] in CLOSES.get(name, ()):
                    close(k)
                    break
                if stack[k][0] in BLOCK and stack[k][0] not in CLOSES.get(name, ()):
                    break
            flush()
        if name == "body":
            while stack and stack[-1][0] == "head":
                close(len(stack) - 1)
        if m.group(3).endswith("/") and name not in BLOCK:
            continue
        now, within = kind, inside
        if (name in MAIN or _MAIN_MARK.search(m.group(3))) and kind != BOILER:
            now, within = MAIN_TEXT, True
        vote = _outside(name, m.group(3))
        if name in OUTSIDE or vote == 2:
            now = BOILER
        elif vote == 1 and now != BOILER:
            now = DOUBTED if now in (MAIN_TEXT, DOUBTED) else WEAK
        if name in HEADING and inside and vote < 2 and any(n == "header" for n, _, _ in stack):
            head = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "header")
            # The article's own heading is part of it, also inside its header.
            if head and stack[head - 1][1] in (MAIN_TEXT, DOUBTED):
                now = stack[head - 1][1]
        stack.append((name, now, within))
        kind, inside = now, within
    flush()
    weak = BOILER if any(k in (MAIN_TEXT, DOUBTED) for k, _ in out) else PLAIN
    return [(weak if k == WEAK else k, text) for k, text in out]


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, well spread."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _host(host: str) -> int:
    """The number of a host, of which its pages' substrings have their names."""
    import xxhash

    return xxhash.xxh64_intdigest(host.encode("utf-8", "replace"))


def _compared(hosts: list[str], pages: list[list[tuple[int, str]]]) -> list[list[tuple[int, int, int]]]:
    """For each page of a run, the substrings that decide on its blocks and its sketch: (block, how many of its kind, name)."""
    import xxhash

    streams = [[t for _, text in blocks for t in text.split(" ")] for blocks in pages]
    ids: dict[str, int] = {}
    sizes = np.array([len(t) for t in streams], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    seq = np.empty(int(begin[-1]), np.int64)
    for k, tokens in enumerate(streams):
        seq[begin[k] : begin[k] + len(tokens)] = [ids.setdefault(t, len(ids)) for t in tokens]
        seq[begin[k + 1] - 1] = -1 - k  # each page ends with a symbol of its own
    order, rank = suffix_array(seq, DEPTH)
    # A group of the array is a substring; its first suffix gives its name, which all runs share.
    token = np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) for t in ids), np.uint64, len(ids))
    word = np.append(np.where(seq < 0, np.uint64(0), token[np.maximum(seq, 0)]) if len(ids) else np.zeros(len(seq), np.uint64), np.zeros(DEPTH, np.uint64))
    heads = np.unique(rank)
    named = np.zeros(len(seq), np.uint64)
    named[heads] = _mixed(sum(word[order[heads] + j] * _TIMES[j] for j in range(DEPTH)))
    named = named[rank]
    out = []
    for k, (host, blocks) in enumerate(zip(hosts, pages)):
        at, end = int(begin[k]), int(begin[k + 1]) - 1
        numbers, many, names, article = [], [], [named[:0]], []
        for number, (kind, text) in enumerate(blocks):
            n = text.count(" ") + 1
            own = named[:0]
            if kind == MAIN_TEXT and n >= DEPTH:
                article.append(named[at : at + n - DEPTH + 1])
                chain = np.append(article[-1][::DEPTH], article[-1][-1])
                own = np.array([xxhash.xxh64_intdigest(chain.tobytes(), seed=n)], np.uint64)
            elif kind in (PLAIN, DOUBTED) and n >= DEPTH:
                own = named[at : at + n - DEPTH + 1]
                own = np.unique(own if len(own) <= 2 * WINDOW else np.lib.stride_tricks.sliding_window_view(own, WINDOW).min(axis=1))
            elif kind in (PLAIN, DOUBTED):
                own = named[[i for i in sorted({at, at + n - DEPTH}) if begin[k] <= i <= end - DEPTH]]
            numbers += [number] * len(own)
            many += [len(own) if n >= DEPTH else 1] * len(own)
            names.append(own)
            at += n
        if article:
            own = np.unique(np.concatenate(article))[:SKETCH]
            numbers += [OF_SKETCH] * len(own)
            many += [len(own)] * len(own)
            names.append(own ^ _SKETCH_SEED)
        # The host is part of a substring's name.
        out.append(list(zip(numbers, many, _mixed(np.concatenate(names) ^ np.uint64(_host(host))).tolist())))
    return out


def _content(host: str, blocks: list[tuple[int, str]]) -> int:
    """What tells a page from others that repeat something: pages of one text are one."""
    import xxhash

    return xxhash.xxh64_intdigest("\n".join([host, *(text for _, text in blocks)]).encode("utf-8", "replace"))


def left(blocks: list[tuple[int, str]], repeated: set[int]) -> str:
    """The main text of a page, given the numbers of its blocks that are repeated, with ``OF_SKETCH`` if it is a near copy."""
    sizes = {k: text.count(" ") + 1 for k, (kind, text) in enumerate(blocks) if kind == MAIN_TEXT}
    if OF_SKETCH in repeated or 2 * sum(n for k, n in sizes.items() if k in repeated) > sum(sizes.values()):
        repeated = repeated.difference(sizes)
    return "\n".join(text for k, (kind, text) in enumerate(blocks) if kind != BOILER and k not in repeated)


def main_texts(pages: list[str | None], least: int = PAGES, articles: bool = False) -> list[str]:
    """The main texts of one host's pages, without Spark."""
    found = [blocks_of(p) for p in pages]
    rows = _compared([""] * len(found), found)
    own = [_content("", blocks) for blocks in found]
    on: dict[int, set[int]] = {}
    for page, some in zip(own, rows):
        for _, _, name in some:
            on.setdefault(name, set()).add(page)
    most = max(least, ARTICLE_PAGES, len(set(own)) // 2 + 1)
    out = []
    for blocks, some in zip(found, rows):
        hits: dict[tuple[int, int], set[int]] = {}
        for number, many, name in some:
            if number == OF_SKETCH and articles:
                continue
            if len(on[name]) >= (most if number != OF_SKETCH and blocks[number][0] == MAIN_TEXT and not articles else least):
                hits.setdefault((number, many), set()).add(name)
        out.append(left(blocks, {number for (number, many), x in hits.items() if 2 * len(x) > many}))
    return out


def _substrings(pages: DataFrame, run_tokens: int) -> DataFrame:
    """(row, block, many, name, page, host): the substrings compared for each row's blocks, its sketch and its host.

    Names of blocks of main text have the host, which is the name of its own row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str, list[tuple[int, str]]]] = []

        def finish() -> pa.RecordBatch:
            keys, hosts, found = zip(*held)
            rows = []
            for key, host, blocks, some in zip(keys, hosts, found, _compared(list(hosts), list(found))):
                own, of = _content(host, blocks), _host(host)
                at = np.uint64(of).astype(np.int64).item()
                rows += [(key, *r, own, at if r[0] >= 0 and blocks[r[0]][0] == MAIN_TEXT else None) for r in some]
                rows.append((key, OF_HOST, 1, of, own, None))
            row, block, many, name, page, of = zip(*rows)
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(block, pa.int32()), pa.array(many, pa.int32()), signed(name), signed(page), pa.array(of, pa.int64())], ["row", "block", "many", "name", "page", "host"])

        total = 0
        for b in batches:
            for key, host, page in zip(*(c.to_pylist() for c in b.columns)):
                blocks = blocks_of(page)
                held.append((key, host, blocks))
                total += 1 + sum(text.count(" ") + 1 for _, text in blocks)
                if total >= run_tokens:
                    yield finish()
                    held, total = [], 0
        if held:
            yield finish()

    return pages.select("row", "host", "html").mapInArrow(arrow_task(run), "row long, block int, many int, name long, page long, host long")


def _repeated(found: DataFrame, least: int, articles: bool) -> DataFrame:
    """(row, blocks): the numbers of the blocks that are repeated, where a row has any; ``OF_SKETCH`` for near copies."""
    names = found.groupBy("name").agg(F.count_distinct("page").alias("pages"), F.count(F.lit(1)).alias("rows"), F.max("host").alias("host"), F.max("block").alias("block")).where(F.col("pages") >= least)
    names = materialise(names, "html-counts")
    chains = names.where(F.col("host").isNotNull())
    if not articles:
        # Over half of a host's pages has as many binary digits as all of them, or one less. A host
        # has few chains on so many, however many it has in all.
        digits = F.length(F.bin("pages"))
        hosts = names.where(F.col("block") == OF_HOST).select(F.col("name").alias("host"), F.col("pages").alias("all"), F.explode(F.array(digits, digits - 1)).alias("digits"))
        chains = chains.where(F.col("pages") >= ARTICLE_PAGES).withColumn("digits", digits).join(hosts, ["host", "digits"]).where(2 * F.col("pages") > F.col("all"))
    others = names.where(F.col("host").isNull() & (F.col("block") >= (0 if articles else OF_SKETCH)))
    counted, names = names, materialise(chains.select("name", "rows").unionByName(others.select("name", "rows")), "html-names")
    drop_table(counted)
    hot = F.col("rows") > HOT_SHARE * found.count()
    # The rows of few names may be most of all rows: those names go to the rows, and there are few.
    rows = found.where(F.col("block") != OF_HOST).select("row", "block", "many", "name").distinct()
    often = rows.join(F.broadcast(names.where(hot).select("name")), "name", "left_semi")
    others = rows.join(F.broadcast(names.where(hot).select("name")), "name", "left_anti").join(names.where(~hot).select("name"), "name", "left_semi")
    hits = often.unionByName(others).groupBy("row", "block", "many").agg(F.count(F.lit(1)).alias("n")).where(2 * F.col("n") > F.col("many"))
    out = materialise(hits.groupBy("row").agg(F.collect_list("block").alias("blocks")), "html-repeated")
    drop_table(names)
    return out


def extract(pages: DataFrame, least: int = PAGES, run_tokens: int = RUN_TOKENS, articles: bool = False) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    bound_batches(pages.sparkSession)
    pages = pick(pages, "page_id", "url", "html")
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    # Pages stay where they are; names of substrings move, and numbers of repeated blocks come back.
    rows = pages.withColumn("row", F.xxhash64("page_id", "url", "html"))
    found = materialise(_substrings(rows.withColumn("host", host), run_tokens), "html-substrings")
    repeated = _repeated(found, least, articles)
    drop_table(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [left(blocks_of(page), set(numbers or ())) for page, numbers in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    joined = rows.join(repeated, "row", "left").select("page_id", "url", "html", "blocks")
    return joined.mapInArrow(arrow_task(run), f"page_id {kind}, url string, text string, n_chars long")
