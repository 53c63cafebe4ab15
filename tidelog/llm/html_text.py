"""HTML extraction: page structure names what may be the article, and a suffix array of the host takes its boilerplate out.

The markup is cut into text blocks. Containers vouch for their blocks (article, then main, then a container named after
content) or condemn them (menus, headers, footers, sidebars, notices, adverts, forms, reader comments, hidden parts, scripts,
styles); paragraphs and headings may condemn themselves. Outside of what something vouches for a listed word anywhere in a class name condemns; inside, only a
name made of such words and of words for shape and place ("related-posts", not "related-work"). Main wins over articles that have fewer words than it has
beside them. What a page's strongest vouching containers hold goes through an array of its host, see below. Where nothing vouches, the
undecided blocks are kept but for what the host repeats:

1. Pages of a host with equal blocks are one page text. In each partition the page texts' unvouched token streams are concatenated
   and their suffixes ranked by prefix doubling to ``RUN`` tokens: a suffix array of that depth. Neighbours of equal rank are
   repeats of ``RUN`` tokens; each gives one row, with the number of page texts, however often it occurs. A longer repeat
   is the union of its runs of that length; a shorter block counts as a whole.
2. The rows of all partitions are added up by host and repeat. Runs on ``MIN_PAGES`` or more page texts that are also ``SHARE`` or more
   of the host's are boilerplate, at any size of the host.
3. Open pages look up their own runs, covered tokens go, and the unique runs between them stay.

Vouched texts, equal ones of a host as one, are dealt by host, large hosts in buckets of about ``BUCKET_PAGES`` texts, and each bucket's
suffixes are ranked as above:

4. Runs on ``MIN_PAGES`` or more of a host's texts that are also ``VOUCHED_SHARE`` or more of them are boilerplate. A host of one
   bucket is decided there. A run on that share of a large host's texts is on that share of some bucket's, so those are
   its candidates, and each is counted over all its buckets.
5. The exact check: a block all of whose tokens boilerplate runs cover goes; one with a token of its own is prose that quotes and stays
   whole. Where more than half of a text's tokens would go, the pages are versions of one article, and the text stays whole.

The array alone can't tell a menu that only one page has from prose, nor a quotation from a notice (README has the figures), so what
containers condemn never comes back, and a block shorter than a run goes only as part of a longer repeat. Pages are parsed once, into a table in the shared folder; every step over a page is linear in its length.

Null or empty html gives the empty text. Null urls form one host. Repeated rows and null or repeated page_ids are rows of their
own with equal texts. A tag that never ends is text if no tag ends after it, else it ends at the next ">". An empty table gives
no rows. Whole pages are read, however long. Other columns than page_id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import html
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import read_table, shared_dir, slices, small, written

RUN = 8
MIN_PAGES = 3
SHARE = 0.1
VOUCHED_SHARE = 0.5
BUCKET_PAGES = 256
BUCKET_CHARS = 4_000_000
#: A quote opens a value only after "="; elsewhere it is a character like any other.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ASIDE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+)))?""")
_WORD = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
_RAW_END = {x: re.compile(f"</{x}", re.I) for x in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
_HELD = _BLOCK - {"p", "h1", "h2", "h3", "h4", "h5", "h6", "hr"} | {"span", "a", "button", "template", "svg", "canvas", "object", "label", "legend", "ins"}
_GONE = {"head", "nav", "footer", "aside", "form", "button", "select", "template", "svg", "canvas", "object", "dialog", "menu", "label", "fieldset"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
_BAD = set(
    "ad ads advert adverts advertisement advertising adsense adslot adbox sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription paywall signup login signin search menu submenu nav navbar navigation topbar breadcrumb breadcrumbs sidebar aside widget widgets related recommended recommendations share sharing social footer colophon copyright comment comments commentlist reply replies respond disqus discussion toolbar pagination pager toc masthead".split()
)
#: Words that say where or what shape a part has. Inside an article a class name condemns only if it has no others beside a listed one.
_SHAPE = set("area articles bar block body bottom box btn button buttons card cards center cnt col container content cta element field footer form frame grid group head heading holder icon icons inline inner item items large layer left link links list main mini mobile module outer page panel part placement post posts right row section side site slot small space sticky stories story strip text title tools top unit wrap wrapper zone".split())
_OWN = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
_HEAD = {"header", "head", "topheader", "pageheader", "siteheader"}
#: The level of an article within main.
IN_MAIN = 4
_GOOD = {"article", "content", "post", "entry", "story", "articlebody", "maincontent"}


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _condemned(names: list[list[str]], inside: bool) -> bool:
    """Whether class names (as their words) condemn: by any listed word, but within an article only by a name that says nothing else."""
    if not inside:
        return any(w in _BAD for words in names for w in words)
    return any(any(w in _BAD for w in words) and all(w in _BAD or w in _SHAPE or w.isdigit() for w in words) for words in names)


def _verdict(name: str, attributes: str, inside: bool = False) -> int | None:
    """-1 condemns, 1 to 3 vouch, the more the stronger; None says nothing. ``inside``: of what something vouches for already."""
    if name in _GONE:
        return -1
    good = {"article": 3, "main": 2}.get(name)
    if attributes and "=" in attributes or "hidden" in attributes:
        words: set[str] = set()
        names: list[list[str]] = []
        for key, a, b, c in _ATTR.findall(attributes):
            key, value = key.lower(), a or b or c
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return -1
            if key == "role":
                if value.lower() in _ROLES:
                    return -1
                if value.lower() == "main":
                    good = max(good or 0, 2)
            elif key == "itemprop" and value.lower() == "articlebody":
                good = max(good or 0, 3)
            elif key in ("class", "id"):
                # Letters are cut where capitals begin, so that camelCase names are words too.
                names += [_WORD.findall(_CAMEL.sub(" ", whole).lower()) for whole in value.split()]
                words |= {w for own in names for w in own}
        if name not in ("body", "html") and words:
            if _condemned(names, inside):
                return -1
            if name == "header" or words & _HEAD:
                return None if words & _GOOD else -1
            if words & _GOOD:
                good = max(good or 0, 1)
    return -1 if name == "header" and good is None else good


def markup(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, "/" of an end tag, name, attributes) of each tag, the last without a name; what holds no text goes."""
    at, n, last = 0, len(page), page.rfind(">")
    tag, seek, begun = _TAG, 0, 0
    while True:
        at = page.find("<", seek)
        if at < 0 or at + 1 >= n:
            break
        if page[at + 1] in "!?" or page[at + 1] == "/" and not page[at + 2 : at + 3].isalpha():
            yield page[begun:at], "", "", ""
            seek = begun = _ASIDE.match(page, at).end()
            continue
        m = tag.match(page, at) if at < last else None
        if m is None and at < last and tag is _TAG and (m := _LOOSE.match(page, at)):
            # A value that swallows the rest: from here on every tag ends at the next ">".
            tag = _LOOSE
        if m is None:
            seek = at + 1
            continue
        name = m[2].lower()
        yield page[begun:at], m[1], name, m[3]
        seek = begun = m.end()
        if not m[1] and name in _RAW:
            end = _RAW_END[name].search(page, begun)
            seek = begun = end.start() if end else n
    yield page[begun:], "", "", ""


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, verdict) of each block in page order; scripts, styles and markup are gone."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    held: Counter[str] = Counter()
    # What containers say, and what a paragraph or heading says of itself until the next block.
    state, own = 0, 0

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, own or state))

    for before, end, name, attributes in markup(page):
        if before:
            parts.append(before)
        if not name:
            continue
        if end:
            if name in _BLOCK:
                close()
                own = 0
            if held[name]:
                while True:
                    last, outer = stack.pop()
                    held[last] -= 1
                    if last == name:
                        break
                if outer != state:
                    close()
                state = outer
            continue
        if name in _RAW:
            continue
        if name == "br":
            parts.append("\n")
        if name in _BLOCK:
            close()
            own = -1 if name in _OWN and attributes and _verdict(name, attributes, state > 0) == -1 else 0
        if name in _VOID or name not in _HELD or attributes.endswith("/") and name in ("svg", "template", "object"):
            continue
        verdict = _verdict(name, attributes, state > 0)
        if verdict == 3 and state == 2:
            verdict = IN_MAIN
        if name == "header" and verdict == -1 and state >= 3 and not re.search(r"\b(?:class|id|role)\s*=", attributes):
            verdict = None
        if name == "li" and stack and stack[-1][0] == "li":
            stack.pop()
            held["li"] -= 1
        stack.append((name, state))
        held[name] += 1
        new = -1 if state == -1 or verdict == -1 else max(state, verdict or 0)
        if new != state:
            close()
            state = new
    close()
    return out


def _strongest(found: list[tuple[str, int]]) -> set[int]:
    """The levels that a page's text is taken from: the strongest one, but main where it has more words of its own than the articles have."""
    top = max((v for _, v in found), default=0)
    if top <= 0:
        return set()
    words = Counter()
    for text, v in found:
        words[v] += len(text.split())
    if top >= 3 and words[2] > words[top]:
        # Articles in main are a part of it; those beside it are teasers.
        return {2, IN_MAIN}
    return {top}


def split_page(page: str | None) -> tuple[str | None, list[str], list[str], int]:
    """(vouched text or None if open, undecided blocks, unvouched blocks, a hash of all blocks); the host's arrays decide on both."""
    found = blocks(page or "")
    kept = _strongest(found)
    mark = xxhash.xxh3_64_intdigest("\n".join(t for t, _ in found)) - (1 << 63)
    rest = [t for t, v in found if v <= 0]
    if kept:
        return "\n".join(t for t, v in found if v in kept), [], rest, mark
    undecided = [t for t, v in found if v == 0]
    return (None if undecided else ""), undecided, rest, mark


_PARSED = ("page_id", "url", "uid", "host", "text", "undecided", "rest", "mark", "whole", "lead")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uid = TaskContext.get().partitionId() << 36
    seen: set[int] = set()
    for batch in batches:
        for part in slices(batch, "html"):
            if len(seen) > 1_000_000:
                seen.clear()
            texts, undecided, rest, marks = zip(*[split_page(x.as_py()) for x in part.column(2)], strict=True)
            uids = pa.array(range(uid, uid + len(texts)), pa.int64())
            uid += len(texts)
            hosts = [host_of(u.as_py()) for u in part.column(1)]
            # A hash of host and vouched text; one row of each goes into the host's array for this partition.
            wholes = [xxhash.xxh3_64_intdigest(f"{h}\n{t}") - (1 << 63) if t else i for h, t, i in zip(hosts, texts, uids.to_pylist(), strict=True)]
            leads = []
            for t, w in zip(texts, wholes, strict=True):
                leads.append(bool(t) and w not in seen)
                seen.add(w)
            lists = [pa.array(x, pa.list_(pa.string())) for x in (undecided, rest)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), uids, pa.array(hosts, pa.string()), pa.array(texts, pa.string()), *lists, *[pa.array(x, pa.int64()) for x in (marks, wholes)], pa.array(leads)], names=_PARSED)


def _digest(host: str, words: list[str]) -> bytes:
    return hashlib.blake2b("\x00".join([host, *words]).encode(), digest_size=16).digest()


def ranked_runs(streams: list[tuple[str, list[str]]], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(place, pages) of each run of tokens in the concatenated streams (host, tokens), one stream a page; the stream of each place; the tokens."""
    words: dict[str, int] = {}
    hosts: dict[str, int] = {}
    ids, page, flat = [], [], []
    for k, (host, tokens) in enumerate(streams):
        hosts.setdefault(host, len(hosts))
        ids += [words.setdefault(t, len(words) + 1) for t in tokens] + [0]
        page += [k] * (len(tokens) + 1)
        flat += [*tokens, ""]
    if not ids:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), flat
    rank, own = np.array(ids, np.int64), np.array(page, np.int64)
    # A separator differs from all others, so that no run reaches into the next page.
    rank[rank == 0] = -1 - np.arange(int((rank == 0).sum()))
    host = np.array([hosts[h] for h, _ in streams], np.int64)[own]
    rank = np.unique(host * (1 << 40) + rank, return_inverse=True)[1].astype(np.int64)
    depth = 1
    while depth < run:
        step = min(depth, run - depth)
        after = np.full(len(rank), -1, np.int64)
        after[:-step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        depth += step
    ends = np.zeros(len(own), bool)
    ends[:-run] = own[run:] == own[:-run]
    ends &= np.concatenate([own[run - 1 :] == own[: len(own) - run + 1], np.zeros(run - 1, bool)])
    at = np.flatnonzero(ends)
    order = at[np.lexsort((own[at], rank[at]))]
    if not len(order):
        return order, order, own, flat
    new = np.concatenate(([True], rank[order][1:] != rank[order][:-1]))
    first = np.concatenate(([True], (rank[order][1:] != rank[order][:-1]) | (own[order][1:] != own[order][:-1])))
    counts = np.add.reduceat(first.astype(np.int64), np.flatnonzero(new))
    return order[new], counts, own, flat


def suffix_runs(streams: list[tuple[str, list[str]]], run: int) -> Iterator[tuple[bytes, int]]:
    """(digest, pages) for each run of tokens in the concatenated streams (host, tokens), one stream a page."""
    places, counts, own, flat = ranked_runs(streams, run)
    for start, n in zip(places.tolist(), counts.tolist(), strict=True):
        yield _digest(streams[own[start]][0], flat[start : start + run]), n


def short_blocks(blocks: list[str], run: int = RUN) -> list[tuple[int, list[str]]]:
    """(place of the first token, tokens) of the blocks that are shorter than a run."""
    out, at = [], 0
    for words in (b.split() for b in blocks):
        if len(words) < run:
            out.append((at, words))
        at += len(words)
    return out


def _block_digest(host: str, words: list[str]) -> bytes:
    return _digest(host, ["", *words])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[str, list[str]]] = []
    short: Counter[bytes] = Counter()
    total = 0

    def out() -> pa.RecordBatch:
        rows = [*suffix_runs(held, RUN), *short.items()]
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())], names=["run", "pages"])

    for batch in batches:
        for host, rest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tokens = " ".join(rest).split()
            held.append((host, tokens))
            short.update({_block_digest(host, words) for _, words in short_blocks(rest)})
            total += len(tokens)
            if total > 1_000_000:
                yield out()
                held, total = [], 0
                short.clear()
    yield out()


def _own_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, host, run, place, size) of each run and short block of the open pages."""
    for batch in batches:
        for uid, host, undecided in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            tokens = " ".join(undecided).split()
            for at in range(0, max(1, len(tokens) - RUN + 1), 50_000):
                places = range(at, max(at, min(at + 50_000, len(tokens) - RUN + 1)))
                found = [(_digest(host, tokens[i : i + RUN]), i, RUN) for i in places]
                if not at:
                    found += [(_block_digest(host, words), i, len(words)) for i, words in short_blocks(undecided)]
                runs, spots, sizes = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([uid] * len(runs), pa.int64()), pa.array([host] * len(runs), pa.string()), pa.array(runs, pa.binary()), pa.array(spots, pa.int32()), pa.array(sizes, pa.int32())], names=["uid", "host", "run", "place", "size"])


def unique_text(undecided: list[str], covered: list[tuple[int, int]]) -> str:
    """The blocks without the tokens of the covered runs (place, tokens)."""
    tokens = [b.split() for b in undecided]
    gone = np.zeros(sum(map(len, tokens)) + 1, np.int64)
    for i, n in covered:
        gone[i] += 1
        if i + n < len(gone):
            gone[i + n] -= 1
    hidden = np.cumsum(gone) > 0
    kept, at = [], 0
    for words in tokens:
        left = [w for w, h in zip(words, hidden[at : at + len(words)].tolist(), strict=True) if not h]
        at += len(words)
        if left:
            kept.append(" ".join(left))
    return "\n".join(kept)


def _reveal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [unique_text(u, [(x["place"], x["size"]) for x in c or []]) for u, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def covered_blocks(text: str, runs: set[str], firsts: set[str]) -> list[int]:
    """Places of the blocks of a vouched text that the runs cover whole; none if those hold more than half of its tokens.

    ``firsts`` are the first tokens of the runs.
    """
    blocks = [b.split() for b in text.split("\n")]
    tokens = [t for words in blocks for t in words]
    hidden, to = np.zeros(len(tokens), bool), 0
    for i, t in enumerate(tokens):
        if t in firsts and " ".join(tokens[i : i + RUN]) in runs:
            hidden[max(i, to) : i + RUN] = True
            to = i + RUN
    gone, lost, at = [], 0, 0
    for k, words in enumerate(blocks):
        if hidden[at : at + len(words)].all():
            gone.append(k)
            lost += len(words)
        at += len(words)
    return gone if 2 * lost <= len(tokens) else []


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, so that dealing them by host takes less than half the disk."""
    for batch in batches:
        for part in slices(batch, "text"):
            texts = [t.encode() for t in part.column("text").to_pylist()]
            packed = [pa.compress(t, "zstd", asbytes=True) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("host"), part.column("whole"), pa.array([len(t) for t in texts], pa.int64()), pa.array(packed, pa.binary())], names=["host", "whole", "size", "packed"])


def _unpacked(size: int, packed: bytes) -> str:
    return pa.decompress(packed, size, "zstd", asbytes=True).decode()


def _firsts(runs: Iterable[str]) -> set[str]:
    return {x.split(" ", 1)[0] for x in runs}


_FOUND = "host string, buckets int, whole bigint, gone array<int>, run string"


def _host_arrays(min_pages: int, share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From texts sorted by (host, bucket, whole): the blocks to cut on hosts of one bucket, the candidate runs of a bucket of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[tuple[str, int, list[tuple[int, str]]]] = []
        key, total = None, 0

        def out() -> Iterator[pa.RecordBatch]:
            streams, need = [], []
            asked = [(g, n) for g in groups if (n := len(g[2])) >= min_pages or g[1] > 1]
            for k, ((_, buckets, texts), n) in enumerate(asked):
                streams += [(str(k), text.split()) for _, text in texts]
                need += [max(1 if buckets > 1 else min_pages, share * n)] * n
            places, counts, own, flat = ranked_runs(streams, RUN)
            keep = counts >= np.array(need)[own[places]] if len(places) else np.empty(0, bool)
            runs: dict[int, set[str]] = {}
            for at in places[keep].tolist():
                runs.setdefault(int(streams[own[at]][0]), set()).add(" ".join(flat[at : at + RUN]))
            rows = []
            for k, found in runs.items():
                host, buckets, texts = asked[k][0]
                if buckets > 1:
                    rows += [(host, buckets, None, None, x) for x in sorted(found)]
                    continue
                firsts = _firsts(found)
                rows += [(host, 1, whole, gone, None) for whole, text in texts if (gone := covered_blocks(text, found, firsts))]
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["host", "buckets", "whole", "gone", "run"])

        for batch in batches:
            for part in slices(batch, "packed", 2_000_000):
                for host, bucket, buckets, whole, size, packed in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    if (host, bucket) != key:
                        if total > 5_000_000:
                            yield from out()
                            groups, total = [], 0
                        key = (host, bucket)
                        groups.append((host, buckets, []))
                    own = groups[-1][2]
                    if not own or own[-1][0] != whole:
                        own.append((whole, _unpacked(size, packed)))
                        total += size
        yield from out()

    return run


def _with_runs(cut: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows sorted by (host, bucket, page, whole), a bucket's runs before its texts: the blocks to cut, or how many texts hold each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, runs, firsts, texts = None, None, {}, set(), 0

        def counts() -> pa.RecordBatch:
            # The row without a run has the number of texts.
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * (len(runs) + 1), pa.string()), pa.array([*runs, None], pa.string()), pa.array([*runs.values(), texts], pa.int64())], names=["host", "run", "n"])

        for batch in batches:
            for part in slices(batch, "packed", 2_000_000):
                found = []
                for host, bucket, page, whole, size, packed in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    if (host, bucket) != key:
                        if key and not cut:
                            yield counts()
                        key, last, runs, firsts, texts = (host, bucket), None, {}, set(), 0
                    if not page:
                        runs[packed.decode()] = 0
                        firsts |= _firsts([packed.decode()])
                    elif whole != last:
                        last, texts, text = whole, texts + 1, _unpacked(size, packed)
                        if cut:
                            if gone := covered_blocks(text, runs.keys(), firsts):
                                found.append((whole, gone))
                            continue
                        tokens = text.split()
                        for x in {x for i, t in enumerate(tokens) if t in firsts and (x := " ".join(tokens[i : i + RUN])) in runs}:
                            runs[x] += 1
                if cut:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int32()))], names=["whole", "gone"])
        if key and not cut:
            yield counts()

    return run


def boilerplate(parsed: DataFrame, min_pages: int, share: float, bucket_pages: int) -> DataFrame:
    """(whole, gone): the blocks that the arrays of their hosts take out of vouched texts."""
    texts = parsed.where("lead").select("host", "whole", "text")
    packed = texts.mapInArrow(_packed, "host string, whole bigint, size bigint, packed binary")
    sizes = texts.groupBy("host").agg(F.greatest(F.ceil(F.count("*") / bucket_pages), F.ceil(F.sum(F.length("text")) / BUCKET_CHARS)).cast("int").alias("buckets"))
    large = written(sizes.where("buckets > 1"), "pages-hosts")
    bucket = F.pmod("whole", F.coalesce("buckets", F.lit(1))).cast("int").alias("bucket")
    dealt = packed.join(small(large), "host", "left").select("host", bucket, F.coalesce("buckets", F.lit(1)).alias("buckets"), "whole", "size", "packed")
    found = written(dealt.repartition("host", "bucket").sortWithinPartitions("host", "bucket", "whole").mapInArrow(_host_arrays(min_pages, share), _FOUND), "pages-arrays")
    cuts = found.where("gone is not null").select("whole", "gone")
    runs = found.where("run is not null").select("host", "buckets", "run").distinct()
    if runs.isEmpty():
        return cuts

    def met(runs: DataFrame, cut: bool, kind: str) -> DataFrame:
        first = runs.select("host", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), F.lit(False).alias("page"), F.lit(0).cast("bigint").alias("whole"), F.lit(0).cast("bigint").alias("size"), F.col("run").cast("binary").alias("packed"))
        own = dealt.join(small(written(runs.select("host").distinct(), "pages-asked")), "host", "left_semi").select("host", "bucket", F.lit(True).alias("page"), "whole", "size", "packed")
        return first.union(own).repartition("host", "bucket").sortWithinPartitions("host", "bucket", "page", "whole").mapInArrow(_with_runs(cut), kind)

    counted = written(met(runs, False, "host string, run string, n bigint").groupBy("host", "run").agg(F.sum("n").alias("n")), "pages-counts")
    totals = counted.where("run is null").select("host", F.col("n").alias("total"))
    common = counted.where("run is not null").join(totals, "host").where((F.col("n") >= min_pages) & (F.col("n") >= share * F.col("total")))
    common = written(common.join(large, "host").select("host", "buckets", "run"), "pages-common")
    return cuts if common.isEmpty() else cuts.union(met(common, True, "whole bigint, gone array<int>"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE, vouched_share: float = VOUCHED_SHARE, bucket_pages: int = BUCKET_PAGES) -> DataFrame:
    """(page_id, url, text) of every page."""
    spark = pages.sparkSession
    kind = dict(pages.dtypes)[id_col]
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    parsed = source.mapInArrow(_parse, f"page_id {kind}, url string, uid bigint, host string, text string, undecided array<string>, rest array<string>, mark bigint, whole bigint, lead boolean")
    path = f"{shared_dir(spark)}/tidelog/pages-{uuid.uuid4().hex}"
    parsed.write.option("compression", "zstd").parquet(path)
    parsed = spark.read.schema(parsed.schema).parquet(path)
    still_open = parsed.where("text is null")
    # Only hosts with an open page have anything to look up.
    wanted = still_open.select("host").distinct()
    texts = parsed.join(wanted, "host", "left_semi").groupBy("host", "mark").agg(F.first("rest").alias("rest"))
    texts = written(texts, "pages-texts")
    runs = texts.select("host", "rest").mapInArrow(_suffixes, "run binary, pages bigint").groupBy("run").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= min_pages)
    runs = written(runs, "pages-runs")
    least = texts.groupBy("host").agg((F.count("*") * share).alias("least"))
    own = still_open.select("uid", "host", "undecided").mapInArrow(_own_runs, "uid bigint, host string, run binary, place int, size int")
    repeated = own.join(runs, "run").join(least, "host").where("pages >= least")
    covered = repeated.groupBy("uid").agg(F.collect_set(F.struct("place", "size")).alias("covered"))
    revealed = still_open.join(covered, "uid", "left").select("page_id", "url", "undecided", "covered").mapInArrow(_reveal, f"page_id {kind}, url string, text string")
    vouched = parsed.where("text is not null").select("page_id", "url", "text", "whole")
    cuts = written(boilerplate(parsed, min_pages, vouched_share, bucket_pages), "pages-cuts")
    if not cuts.isEmpty():
        left = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("gone", i)), "\n")
        vouched = vouched.join(small(cuts), "whole", "left").withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left))
    return vouched.select("page_id", "url", "text").union(revealed)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(read_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


QUERIES = {"op3_html_extraction": op3_html_extraction}
ORACLES: dict[str, str] = {}
