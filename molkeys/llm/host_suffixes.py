"""Main text of web pages, with boilerplate found by suffix arrays of each host.

Markup is cut into blocks, and blocks are marked: ``main`` inside an article or main element, ``cut`` inside an element that by
its name, role, class or id is a menu, header, footer, sidebar, notice, advert, form, comment, script or style, and ``other``
elsewhere. Classes and ids of headings say nothing. A page that declares its article gives ``main`` blocks, other pages ``other`` blocks,
both without what repeats.

What repeats is found per host. Pages of equal ``main`` and ``other`` blocks are one page there, so copies are no evidence. A run
of ``LONG`` words or more inside a block is boilerplate when it recurs on ``PAGES`` different pages of the host and on one in
``SHARE`` of them; so is a whole shorter block, but never as a ``main`` block: headings and phrases of an article may recur.

The suffixes of a host's blocks are sorted by their words to the depth of ``LONG`` (a shorter block is one suffix, itself), as one
order over all hosts that is split by ranges. Neighbours with all these words in common are an interval, and an interval with
enough pages is boilerplate; its suffixes, laid over the pages, cover each maximal repeated run. Page is the last part of the order, so
an interval of many pages lies in several ranges, whose numbers of pages add up. Suffixes that cannot recur are not sorted: equal
ones have the same smallest hash of ``DEPTH`` words, so only those whose smallest one recurs as often are. Hashes choose what is
sorted, and words alone decide. Where repetition would leave less than one in ``LEFT`` of a page's words, the page is
taken for one of a family of near copies and stays whole.

Cases: null or empty html gives an empty text; a null url is a host of its own name, empty; unclosed and unmatched tags, broken
attributes, cut-off pages and unknown references are read as browsers do, as far as text goes; rows that share a page_id are
one page for repetition (one of its texts counts) and are reported one by one; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, byte_prefix, lean, materialise, mix, span_hash, text_of, words_of
from .winnow import bounded

#: Words of the substrings that stand for a repeated run, and of a run that is long.
DEPTH, LONG = 6, 20
#: Boilerplate recurs on so many different pages of a host, and on one in so many of them; one in so many words of a page is left.
PAGES, SHARE, LEFT = 3, 2, 10
#: Bytes of a table that is sent to all executors.
SMALL = 16 << 20

TAG = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z!/?][^>]*$""", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
# Fixed values of HTML and of common class names.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CUT = frozenset("nav footer aside form script style noscript template head button select textarea iframe dialog menu svg canvas object title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars widget widgets footer header masthead comment comments disqus respond reply replies newsletter subscribe signup login popup modal overlay share sharing social related recommended search toolbar copyright pagination skip site-header site-footer site-nav site-navigation main-nav main-menu main-navigation page-footer ad-slot ad-banner ad-container cookie-banner cookie-notice cookie-consent social-share share-buttons skip-link related-posts".split())
#: Elements whose own marks say nothing of the text in them, and those whose names (classes and ids) do not.
ROOTS = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _marked(attributes: str, named: bool = True) -> bool:
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "role" and value.strip() in ROLES:
            return True
        if named and name in ("class", "id") and not MARKS.isdisjoint(value.split()):
            return True
    return False


def blocks_of(page: str) -> tuple[list[tuple[str, str]], bool]:
    """(mark, text) of the blocks of a page in order, and whether it declares an article.

    Marks of an element with a main element in it are ignored, as are those of one with an article where no other is declared: comments
    and cards are articles too.
    """
    out, declared, mains, articles = _blocks(page, frozenset())
    if mains:
        out, declared, _, articles = _blocks(page, mains)
    if articles and not declared:
        out, declared, _, _ = _blocks(page, mains | articles)
    return out, declared


def _blocks(page: str, unmarked: frozenset[int]) -> tuple[list[tuple[str, str]], bool, frozenset[int], frozenset[int]]:
    """The blocks, whether an article is declared, and where the marked elements with a main element or an article in them begin.

    Marks of elements that begin at ``unmarked`` are ignored.
    """
    marked: list[int] = []  # where the marked elements of the stack begin
    holders: dict[str, set[int]] = {"main": set(), "article": set()}
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, cut, main, marked
    opened: Counter[str] = Counter()  # names on the stack
    parts: list[str] = []
    cut = main = declared = False
    at, end = 0, len(page)

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(("cut" if cut else "main" if main else "other", text))
            parts.clear()

    def pop() -> tuple[str, bool, bool, bool]:
        top = stack.pop()
        opened[top[0]] -= 1
        if top[3]:
            marked.pop()
        return top

    while at < end:
        m = TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        begin, at = m.start(), m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = (m[1] if m[2] else m[4]), (m[3] if m[2] else m[6]) or ""
        if name == "br":
            parts.append(" ")
            continue
        block = name in BLOCKS
        if closing:
            if opened[name]:
                ends = block
                if not ends:
                    for x in reversed(stack):
                        ends |= x[0] in BLOCKS or x[1]
                        if ends or x[0] == name:
                            break
                if ends:
                    close()
                while pop()[0] != name:
                    pass
                _, cut, main, _ = stack[-1] if stack else ("", False, False, False)
            elif block:
                close()
            continue
        by_mark = name not in ROOTS and begin not in unmarked and _marked(attributes, name not in HEADINGS)
        new_cut = cut or name in CUT or name == "header" and not main or by_mark
        new_main = main or name in ("article", "main")
        if block or new_cut != cut:
            close()
        if block and opened["p"]:
            while pop()[0] != "p":
                pass
            _, cut, main, _ = stack[-1] if stack else ("", False, False, False)
            new_cut = cut or name in CUT or name == "header" and not main or by_mark
            new_main = main or name in ("article", "main")
        declared |= new_main and not new_cut
        if name in holders:
            for x in reversed(marked):
                if x in holders[name]:  # and so are those around it
                    break
                holders[name].add(x)
        if name in RAW:
            stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
        elif name not in VOID and not attributes.rstrip().endswith("/") or name in BLOCKS and name != "hr":
            stack.append((name, new_cut, new_main, by_mark))
            opened[name] += 1
            if by_mark:
                marked.append(begin)
            cut, main = new_cut, new_main
    close()
    return out, declared, frozenset(holders["main"]), frozenset(holders["article"])


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _print(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def parse_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, row, host, stream, keep, loose, texts): blocks of each page, whether they are its text and whether they may go as short ones.

    Host and stream are hashes.
    """

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                hosts, streams, keep, loose, texts = [], [], [], [], []
                for url, page in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    blocks, declared = blocks_of(page or "")
                    host = host_of(url)
                    hosts.append(_print(host))
                    streams.append(_print(host, *(x for mark, x in blocks if mark != "cut")))
                    keep.append([mark == ("main" if declared else "other") for mark, _ in blocks])
                    loose.append([mark != "main" for mark, _ in blocks])
                    texts.append([x for _, x in blocks])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(hosts, pa.int64()), pa.array(streams, pa.int64()), pa.array(keep, pa.list_(pa.bool_())), pa.array(loose, pa.list_(pa.bool_())), pa.array(texts, pa.list_(pa.string()))], names=["page_id", "url", "row", "host", "stream", "keep", "loose", "texts"])

    rows = pages.select("page_id", "url", text_of("html").alias("html")).withColumn("row", F.xxhash64("page_id", "url", "html"))
    return rows.select("page_id", "url", "html", "row").mapInArrow(lean(run), "page_id bigint, url string, row bigint, host bigint, stream bigint, keep array<boolean>, loose array<boolean>, texts array<string>")


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k neighbouring words from those of the words."""
    n = max(len(words) - k + 1, 0)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc += words[j : j + n] * np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 + 2 * j & 0xFFFFFFFFFFFFFFFF | 1)
    return mix(acc)


def least_hashes(texts: list[str], loose: list[bool], depth: int, long: int) -> list[np.ndarray]:
    """Per block, of each of its suffixes of ``long`` words or more the smallest hash of ``depth`` words in the first ``long``.

    A shorter block that may go has one suffix, itself, and its hash; another has none.
    """
    data = [x.encode("utf-8", "surrogatepass") for x in texts]
    offsets = np.cumsum([0, *map(len, data)])
    raw = np.frombuffer(b"".join(data), np.uint8)
    prefix = byte_prefix(raw)
    starts, ends, row = words_of(raw, offsets, NOT_SPACE)
    words = span_hash(prefix, starts, ends)
    whole = span_hash(prefix, offsets[:-1], offsets[1:]).view(np.int64)
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    out = []
    for i, (a, b) in enumerate(zip(first, first[1:])):
        if b - a < long:
            out.append(whole[i : i + 1] if loose[i] else whole[:0])
        else:
            out.append(np.lib.stride_tricks.sliding_window_view(_grams(words[a:b], depth), long - depth + 1).min(1).view(np.int64))
    return out


def page_keys(blocks: DataFrame, depth: int, long: int) -> DataFrame:
    """(row, host, keys): the distinct ``least_hashes`` of each page."""

    def run(batches):
        for batch in batches:
            keys = [np.unique(np.concatenate([np.zeros(0, np.int64), *least_hashes(t, s, depth, long)])) for t, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))], names=["row", "host", "keys"])

    return blocks.select("row", "host", "texts", "loose").mapInArrow(lean(run), "row bigint, host bigint, keys array<bigint>").where(F.size("keys") > 0)


def suffixes(pages: DataFrame, depth: int, long: int) -> DataFrame:
    """(host, key, suffix, page): the first ``long`` words of each suffix whose key is among the ``known`` ones of its page."""

    def run(batches):
        for batch in batches:
            for host, page, texts, loose, known in zip(*(c.to_pylist() for c in batch.columns)):
                keys, found = [], []
                for text, least in zip(texts, least_hashes(texts, loose, depth, long)):
                    at = np.flatnonzero(np.isin(least, known))
                    words = text.split(" ") if len(at) else []
                    keys += least[at].tolist()
                    found += [" ".join(words[p : p + long]) for p in at.tolist()]
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([host] * n, pa.int64()), pa.array(keys, pa.int64()), pa.array(found, pa.string()), pa.array([page] * n, pa.int64())], names=["host", "key", "suffix", "page"])

    return pages.select("host", "page", "texts", "loose", "known").mapInArrow(lean(run), "host bigint, key bigint, suffix string, page bigint")


def intervals(found: DataFrame) -> DataFrame:
    """(host, key, suffix, c): the intervals of the suffix array and their numbers of pages, summed over the ranges that they lie in."""

    def run(batches):
        held = None
        for batch in batches:
            done = []
            for host, key, suffix, page in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None or held[2] != suffix or held[0] != host:
                    if held is not None:
                        done.append(held[:4])
                    held = [host, key, suffix, 1, page]
                elif held[4] != page:
                    held[3:] = held[3] + 1, page
            yield rows(done)
        if held is not None:
            yield rows([held[:4]])

    def rows(done):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64()))], names=["host", "key", "suffix", "c"])

    ordered = found.repartitionByRange("host", "suffix", "page").sortWithinPartitions("host", "suffix", "page")
    counted = ordered.mapInArrow(lean(run), "host bigint, key bigint, suffix string, c bigint")
    return counted.groupBy("host", "key", "suffix").agg(F.sum("c").alias("c"))


def uncovered(keep: list[bool], loose: list[bool], texts: list[str], repeated: list[str] | None, long: int) -> str:
    """The words of a page's text that no repeated suffix covers."""
    words = [x.split(" ") for x in texts]
    hits = [np.zeros(len(w), bool) for w in words]
    found = frozenset(repeated or ())
    for i in range(len(words) if found else 0):
        if keep[i] and len(words[i]) < long:
            hits[i][:] = loose[i] and texts[i] in found
        elif keep[i]:
            for p in range(len(words[i]) - long + 1):
                if " ".join(words[i][p : p + long]) in found:
                    hits[i][p : p + long] = True
    total = sum(len(w) for k, w in zip(keep, words) if k)
    left = sum(int((~hit).sum()) for k, hit in zip(keep, hits) if k)
    if left * LEFT < total:
        hits = [np.zeros(len(w), bool) for w in words]
    return " ".join(x for k, w, hit in zip(keep, words, hits) if k for x, c in zip(w, hit) if not c)


def small(df: DataFrame, size) -> DataFrame:
    """Broadcast a table whose summed bytes, by the column ``size``, are within ``SMALL``; leave the join to shuffle beyond it."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= SMALL else df


def often(counts: DataFrame, hosts: DataFrame) -> DataFrame:
    """Counts ``c`` that are enough pages of their host."""
    return counts.where(F.col("c") >= PAGES).join(hosts, "host").where(F.col("c") * SHARE >= F.col("n")).drop("c", "n")


def repeated_suffixes(blocks: DataFrame, depth: int, long: int) -> DataFrame:
    """(row, repeated): the suffixes that each page may share with enough pages of its host, for pages with any."""
    # one row for each different page: equal streams first, then texts of one page_id
    streams = blocks.groupBy("stream").agg(F.min(F.struct("row", "page_id", "host")).alias("x")).select("x.*")
    different = materialise(streams.groupBy(F.coalesce("page_id", "row").alias("page"), "host").agg(F.min("row").alias("row")), "different")
    hosts = materialise(different.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= PAGES), "hosts")
    hosts = bounded(hosts, hosts.count())
    every = materialise(page_keys(blocks.join(hosts, "host", "left_semi"), depth, long), "keys")
    one = every.join(different.select("row").distinct(), "row", "left_semi").select("host", F.explode("keys").alias("key"))
    keys = materialise(often(one.groupBy("host", "key").agg(F.count("*").alias("c")), hosts), "frequent")
    own = every.select("row", "host", F.explode("keys").alias("key")).join(bounded(keys, keys.count()), ["host", "key"])
    own = materialise(own.distinct(), "own")
    known = own.groupBy("row").agg(F.collect_list("key").alias("known")).join(different.select("row", "page"), "row")
    known = materialise(known, "known")
    # rows that are the same have one number; a page counts once in an interval
    found = materialise(suffixes(blocks.join(small(known, 8 * F.size("known")), "row"), depth, long), "suffixes", compression="zstd")
    boilerplate = materialise(often(intervals(found), hosts), "boilerplate")
    shared = own.join(small(boilerplate, F.octet_length("suffix") + 16), ["host", "key"])
    return materialise(shared.groupBy("row").agg(F.collect_list("suffix").alias("repeated")), "repeated", compression="zstd")


def main_text(pages: DataFrame, depth: int = DEPTH, long: int = LONG) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    blocks = materialise(parse_pages(pages), "blocks", compression="zstd")
    repeated = repeated_suffixes(blocks, depth, long)

    def run(batches):
        for batch in batches:
            texts = [uncovered(*x, long) for x in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    every = blocks.join(small(repeated, F.octet_length(F.array_join("repeated", " ")) + 8), "row", "left")
    out = every.select("page_id", "url", "keep", "loose", "texts", "repeated").mapInArrow(lean(run), "page_id bigint, url string, text string")
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
