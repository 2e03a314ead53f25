"""Main text of web pages: block structure, and a suffix array per host over the streams of its pages.

A page becomes blocks of text. Blocks in menus, headers, footers, sidebars, notices, adverts, forms
and comments, by element, role or class, are boilerplate. The tokens of all pages of a host are one
stream, with a mark after each block and one of its own after each page. Prose in a main container stays
in any case, so in the stream a mark of its own stands for it. A suffix array of the stream
(prefix doubling until all suffixes differ) and its longest common prefixes give, for each place, the
longest run that a distinct page has too; runs of RUN tokens or more are repeated. They decide:

* in a main container (main or article) a block goes if runs that half of the host's pages (and
  COMMON pages) have cover it whole, and it is not prose;
* outside it, on a page that has one, prose that no repeated run touches stays: all else goes;
* on a page without one, blocks go that repeated runs cover whole and that are not prose;
* the last first-level heading before a container that has none stays, unless runs that half of the host's
  pages have cover it: it is the article's title.

What an element, a role or hiding says of a block holds. A class or id name counts if it is made of words for
boilerplate and for parts only (comment-list, ad-slot), and, if these words also name what articles are about
(share), if all names beside it are; otherwise (related-work, market share) it counts for what is no prose, or is
outside the main container of a page that has one.

On pages without a container, prose that is repeated, and what stands between its heading and its last
paragraph, stays: an article that is published twice is no boilerplate, and a quoted sentence is not lost.

Plan: pages are dealt to groups: a host above seg_bytes to several, small hosts together. A group
builds its hosts' suffix arrays and sends, for hosts dealt to several groups, the digests of the runs
of RUN tokens with the number of pages that have them to buckets, which answer with those that two
groups have and all their pages. A place is covered by repeated runs exactly if it is covered by
repeated runs of RUN tokens, so the result is that of one array per host, and no task holds more than
a group, however pages are dealt. n_repeated counts covered tokens.

Defined results: null or empty html gives an empty text; a null url is a host of its own (""); rows
that repeat are pages of their own; null page_id is kept. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trowel.llm.arrays import U64, cut_by_top_bits, found_in, mix, pack_sorted, squeeze, tidy, unpack_sorted, unsqueeze
from trowel.session import input_bytes, ship_package, shuffle_parts

#: Tokens of a repeated run, at least: a power of two, so a level of the suffix array has its ranks.
RUN = 8

#: Pages that have a run, besides half of the host's, for it to go from a main container.
COMMON = 4

#: Words of a block of prose, at least; of one that ends as a sentence does.
PROSE, SENTENCE = 20, 8

#: Names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
HIDDEN = set("script style noscript template title head svg math iframe object canvas audio video select option button textarea input label datalist".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
CHROME = set("nav footer aside form menu dialog search".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id names that mark boilerplate, those of them that articles are also about, and words for parts.
MARKS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments commentlist disqus respond replies share sharing social related newsletter subscribe subscription popup modal paywall widget skip".split())
TOPICS = set("share sharing social related menu skip widget navigation promo banner sponsor sponsored advertising consent subscription paywall".split())
PARTS = set("area author bar block body bottom box btn button buttons card cards col column container content count container entry extra feed footer form group head header holder icon icons inner item items left level line link links list main media meta overlay panel post posts reply right row section signup site slot small stories text thread title to top unit wrap wrapper".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
HEADER_NAMES = {"header", "site-header", "page-header", "siteheader", "pageheader", "global-header"}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>""", re.S)
_NAMED = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[^a-z0-9]+")


@dataclass
class Page:
    """Blocks of a page in order: text, and whether each is in the main container; boilerplate blocks are not listed as text."""

    texts: list[str] = field(default_factory=list)
    inside: list[bool] = field(default_factory=list)  # in main or an article
    doubtful: list[bool] = field(default_factory=list)  # below a name that marks boilerplate or is what the article is about
    chrome: list[bool] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)  # the innermost block element
    linked: list[float] = field(default_factory=list)  # the share of the letters in links

    def main(self) -> bool:
        """Has the page a main element or an article with text?"""
        return any(i and not c for i, c in zip(self.inside, self.chrome, strict=True))

    def prose(self, b: int) -> bool:
        """Is the block running text, by its length and links?"""
        n = self.texts[b].count(" ") + 1
        return self.linked[b] < 0.5 and (n >= PROSE or (n >= SENTENCE and self.texts[b].rstrip("\"')\u201d\u2019\u00bb").endswith((".", "!", "?", "\u2026", "\u3002"))))

    def dropped(self, repeated: list[bool]) -> list[bool]:
        """Of blocks that repeated runs cover whole, those that go: not prose, nor part of repeated prose."""
        n = len(self.texts)
        out = [r and not self.prose(b) for b, r in enumerate(repeated)]
        known = [b for b in range(n) if repeated[b] and self.prose(b) and not self.chrome[b]]
        if not known:
            return out
        first = next((b for b in range(known[0], -1, -1) if self.tag[b] in HEADINGS), known[0])
        last = known[-1]
        while last + 1 < n and repeated[last + 1] and self.tag[last + 1] == "p" and self.linked[last + 1] < 0.5:
            last += 1
        return [gone and not first <= b <= last for b, gone in enumerate(out)]

    def settled(self, b: int) -> bool:
        """Does the block stay whatever is repeated: prose in the main container?"""
        return self.inside[b] and not self.chrome[b] and self.prose(b)

    def title(self) -> int | None:
        """The last first-level heading before the main container, if that has none."""
        own = [b for b, i in enumerate(self.inside) if i and not self.chrome[b]]
        if not own or any(self.tag[b] == "h1" for b in own):
            return None
        return next((b for b in range(own[0] - 1, -1, -1) if self.tag[b] == "h1" and not self.chrome[b] and not self.doubtful[b]), None)

    def kept(self, repeated: list[bool], common: list[bool], touched: list[bool]) -> list[str]:
        """Texts that stay. Of each block: is it covered whole by repeated runs, by common ones, and touched by any?"""
        if not self.main():
            gone = self.dropped(repeated)
        else:
            title = self.title()
            gone = [common[b] if b == title else common[b] and not self.prose(b) if inside else touched[b] or not self.prose(b) for b, inside in enumerate(self.inside)]
        main = self.main()
        gone = [g or (d and (not self.prose(b) or (main and not self.inside[b]))) for b, (g, d) in enumerate(zip(gone, self.doubtful, strict=True))]
        return [t for t, c, g in zip(self.texts, self.chrome, gone, strict=True) if not (c or g)]


def _mark(names: str) -> int:
    """Of class or id names: 2 if they mark boilerplate, 1 if one only holds a word that does, else 0."""
    each = [[w for w in _PART.split(name) if w and not w.isdigit()] for name in names.split()]
    plain = [all(w in MARKS or w in PARTS for w in words) for words in each]
    marks = [{w for w in words if w in MARKS} for words in each]
    if any(p and m - TOPICS for p, m in zip(plain, marks, strict=True)) or (all(plain) and any(marks)):
        return 2
    return int(any(marks))


def _chrome(tag: str, attributes: str, in_main: bool) -> int:
    """Is what an element holds boilerplate: 2 yes, 1 if it is no prose, 0 no?"""
    if tag in CHROME or (tag == "header" and not in_main):
        return 2
    found = 0
    for name, value in _NAMED.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" and value in ("", "hidden", "true"):
            return 2
        if name == "aria-hidden" and value == "true":
            return 2
        if name == "style" and "display:none" in value.replace(" ", ""):
            return 2
        if name == "role" and value in ROLES:
            return 2
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            if any(w in HEADER_NAMES for w in value.split()) and not in_main:
                return 2
            found = max(found, _mark(value))
    return found


def parse(source: str) -> Page:
    """Blocks of a page. Unclosed elements end with the element around them; a block start ends an open paragraph."""
    page = Page()
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # tag; main container; chrome; doubtful; hidden
    kind, chrome, doubtful, hidden = False, False, False, False
    buffer: list[str] = []
    anchors, links, letters = 0, 0, 0  # open links; letters of the block in links, and all
    at, n = 0, len(source)

    def flush() -> None:
        nonlocal links, letters
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                page.texts.append(text)
                page.inside.append(kind)
                page.chrome.append(chrome)
                page.doubtful.append(doubtful)
                page.tag.append(next((s[0] for s in reversed(stack) if s[0] in BLOCK), ""))
                page.linked.append(links / max(1, letters))
            links = letters = 0

    def pop_to(depth: int) -> None:
        nonlocal kind, chrome, doubtful, hidden, anchors
        anchors -= sum(s[0] == "a" for s in stack[depth:])
        del stack[depth:]
        kind, chrome, doubtful, hidden = stack[-1][1:] if stack else (False, False, False, False)

    while at < n:
        tag = _TAG.search(source, at)
        end = tag.start() if tag else n
        if end > at and not hidden:
            buffer.append(html.unescape(source[at:end]))
            size = len(buffer[-1].strip())
            letters += size
            links += size if anchors else 0
        if not tag:
            break
        at = tag.end()
        if tag[1] is not None:
            if not hidden:
                buffer.append(tag[1])
            continue
        name = tag[3] or tag[6]
        if name is None:
            continue
        name = name.lower()
        if tag[2] or tag[5]:
            block = name in BLOCK
            if block:
                flush()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    if (chrome, doubtful) != (stack[depth - 1][2:4] if depth else (False, False)):
                        flush()
                    pop_to(depth)
                    break
                if not block and stack[depth][0] in BLOCK:
                    break  # an inline end tag without its start
            continue
        attributes = tag[4] if tag[3] else tag[7]
        if name in BLOCK:
            flush()
            for depth in range(len(stack) - 1, -1, -1):  # what a block start ends
                open_tag = stack[depth][0]
                if open_tag == "p" or (open_tag == name and name in ("li", "tr", "dd", "dt")) or {open_tag, name} == {"dd", "dt"}:
                    pop_to(depth)
                    break
                if open_tag in BLOCK:
                    break
        elif name in ("br", "td", "th", "img"):
            if not hidden:
                buffer.append(" ")
        if name in VOID:
            continue
        if name in RAW:
            close = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(source, at)
            at = close.start() if close else n
            stack.append((name, kind, chrome, doubtful, True))
            hidden = True
            continue
        if attributes.endswith("/") and name in ("svg", "math"):
            continue
        inner_kind = kind or (name in ("main", "article") and not chrome and not doubtful)
        found = _chrome(name, attributes, kind)
        inner_chrome = chrome or found == 2
        skipped = hidden or name in HIDDEN
        if found == 1 and name in BLOCK and not doubtful:
            flush()
            doubtful = True
        if inner_chrome != chrome:
            if name in BLOCK:
                flush()
            else:  # within a block: its text is left out of the block
                inner_chrome, skipped = chrome, True
        kind, chrome, hidden = inner_kind, inner_chrome, skipped
        stack.append((name, kind, chrome, doubtful, hidden))
        anchors += name == "a"
    flush()
    return page


def host_of(url: str | None) -> str:
    found = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def suffix_ranks(tokens: np.ndarray) -> list[np.ndarray]:
    """Ranks of all places by their next 1, 2, 4, ... tokens, until all differ: the last are the suffix array's."""
    n = len(tokens)
    levels = [np.unique(tokens, return_inverse=True)[1].astype(np.int64)]
    while n and int(levels[-1].max()) < n - 1:
        step = 1 << (len(levels) - 1)
        ahead = np.concatenate((levels[-1][step:] + 1, np.zeros(min(step, n), np.int64)))[:n]
        levels.append(np.unique(levels[-1] * (n + 2) + ahead, return_inverse=True)[1].astype(np.int64))
    return levels


def common_prefixes(levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Tokens that each suffix shares with the next one in order, from the ranks of all widths."""
    n, a, b = len(order), order[:-1], order[1:]
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + out, b + out
        inside = (x < n) & (y < n)
        same = np.zeros(len(a), bool)
        same[inside] = levels[k][x[inside]] == levels[k][y[inside]]
        out += same.astype(np.int64) << k
    return out


def _until_change(prefix: np.ndarray, page: np.ndarray) -> np.ndarray:
    """For each suffix in order, the tokens that it shares with the nearest one before it that is of another page."""
    new = np.ones(len(page), bool)
    new[1:] = page[1:] != page[:-1]
    segment = np.cumsum(new)
    far = int(prefix.max(initial=0)) + 1
    # a running minimum that starts again at each change of page
    before = np.concatenate(([0], prefix)) - segment * far
    return np.minimum.accumulate(before) + segment * far


def shared_lengths(levels: list[np.ndarray], page: np.ndarray) -> np.ndarray:
    """For each place, the length of the longest run from there that another page has too."""
    n = len(page)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(levels[-1], kind="stable")
    prefix, own = common_prefixes(levels, order), page[order]
    ahead = _until_change(prefix, own)
    behind = _until_change(prefix[::-1], own[::-1])[::-1]
    out = np.empty(n, np.int64)
    out[order] = np.maximum(ahead, behind)
    return out


def pages_of(rank: np.ndarray, page: np.ndarray) -> np.ndarray:
    """For each place, the number of pages that have its rank: from the ranks by a width, those that have its next tokens."""
    if not len(rank):
        return np.zeros(0, np.int64)
    width = int(page.max()) + 1
    pairs = np.unique(rank * width + page)
    return np.bincount(pairs // width)[rank]


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places are in one of the runs."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.subtract.at(steps, np.minimum(starts + lengths, n), 1)
    return np.cumsum(steps)[:-1] > 0


def _token_hashes(words: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for w in words], U64)


class _Streams:
    """Token streams of a group's pages, host by host."""

    def __init__(self, pages: list[tuple[str, Page]]) -> None:
        known: dict[str, int] = {}
        words, sizes, blocks = [], [], []
        for _, own in pages:
            blocks.append(len(own.texts))
            main = own.main()
            for b, text in enumerate(own.texts):
                if main and own.settled(b):
                    words.append(-3)
                    sizes.append(1)
                    continue
                parts = text.split(" ")
                words += [known.setdefault(w, len(known)) for w in parts] + [-1]
                sizes.append(len(parts) + 1)
            words.append(-2)
        table, at = _token_hashes(list(known)), np.array(words, np.int64)
        self.tokens = np.empty(len(at), U64)
        self.tokens[at >= 0] = table[at[at >= 0]] if len(table) else 0
        self.tokens[at == -1] = U64(0x62D9F1A7C3B54E1D)  # the end of a block is a token of the stream
        self.ends = at == -2
        self.tokens[self.ends] = mix(np.arange(int(self.ends.sum()), dtype=U64) + U64(1 << 40))  # the end of a page is like no other token
        prose = at == -3  # and so is what stands for prose
        self.tokens[prose] = mix(np.arange(int(prose.sum()), dtype=U64) + U64(1 << 41))
        self.page = np.cumsum(self.ends) - self.ends
        names, host = np.unique(np.array([h for h, _ in pages], object).astype(str), return_inverse=True) if pages else (np.array([], str), np.zeros(0, np.int64))
        self.names, self.host_of_page = names, host
        self.host = host[self.page] if len(at) else self.page
        #: first token of each block, page by page, and of each page; a block's last token is its mark
        self.sizes, self.blocks = np.array(sizes, np.int64), np.array(blocks, np.int64)
        stop = np.flatnonzero(self.ends)
        self.whole = np.arange(len(at)) + RUN <= stop[self.page] if len(at) else np.zeros(0, bool)  # starts whose run stays within the page, and has no prose
        for k in range(min(RUN, len(at))):
            self.whole[: len(at) - k] &= ~prose[k:]

    def repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place, the longest run from there that another page has, and the number of pages that have its next RUN tokens; within the group."""
        length, pages = np.zeros(len(self.tokens), np.int64), np.zeros(len(self.tokens), np.int64)
        for h in range(len(self.names)):
            at = np.flatnonzero(self.host == h)
            levels = suffix_ranks(self.tokens[at])
            length[at] = shared_lengths(levels, self.page[at])
            pages[at] = pages_of(levels[min(RUN.bit_length() - 1, len(levels) - 1)], self.page[at])
        return length, pages

    def digests(self) -> np.ndarray:
        """Digest of host and run at each start; meaningful where whole."""
        names = self.name_digests()
        value = names[self.host] if len(self.tokens) else np.zeros(0, U64)
        n = len(self.tokens)
        for k in range(RUN):
            ahead = np.concatenate((self.tokens[k:], np.zeros(min(k, n), U64)))[:n]
            value = mix(value * U64(0x9FB21C651E98DF25) + ahead)
        return value

    def name_digests(self) -> np.ndarray:
        return _token_hashes(self.names.tolist())

    def sent(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted digests of the runs, and of the hosts themselves, with the pages of each."""
        digest, page = self.digests()[self.whole], self.page[self.whole]
        rank = np.lexsort((page, digest))
        digest, page = digest[rank], page[rank]
        new = np.ones(len(digest), bool)
        new[1:] = (digest[1:] != digest[:-1]) | (page[1:] != page[:-1])
        every, counts = np.unique(digest[new], return_counts=True)
        hosts, of_host = self.name_digests(), np.bincount(self.host_of_page, minlength=len(self.names))
        every, counts = np.concatenate((every, hosts)), np.concatenate((counts, of_host))
        rank = np.argsort(every)
        return every[rank], counts[rank]


def _unpack(blobs: list[bytes]) -> list[tuple]:
    import pickle

    rows = [r for b in blobs for r in pickle.loads(unsqueeze(b))]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
    return rows


def _dealt(pages: DataFrame, heavy: dict[str, int], groups: int) -> DataFrame:
    """(grp, split, pages): pages packed by group; split: is the group's host dealt to several?"""

    def stable(text: str) -> int:
        return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")

    def deal(batches):
        import pickle

        for batch in batches:
            by: dict[tuple[int, bool], list[tuple]] = {}
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                host = host_of(row[1])
                parts = heavy.get(host, 1)
                key = (stable(f"{host}\n{stable(f'{row[0]} {row[1]}') % parts}") >> 1, True) if parts > 1 else (stable(host) % groups, False)
                by.setdefault(key, []).append(row)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in by], pa.int64()), pa.array([k[1] for k in by], pa.bool_()), pa.array([squeeze(pickle.dumps(v, 5)) for v in by.values()], pa.binary())], ["grp", "split", "pages"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(tidy(deal), "grp long, split boolean, pages binary")


def _send(bits: int):
    def send(table: pa.Table) -> pa.Table:
        grp = table.column("grp")[0].as_py()
        own, pages = np.zeros(0, U64), np.zeros(0, np.int64)
        if table.column("split")[0].as_py():
            own, pages = _Streams([(host_of(r[1]), parse(r[2] or "")) for r in _unpack(table.column("pages").to_pylist())]).sent()
        cuts = cut_by_top_bits(own, bits)
        full = np.flatnonzero(np.diff(cuts))
        parts = [slice(cuts[b], cuts[b + 1]) for b in full]
        return pa.table({"bucket": pa.array(full, pa.int32()), "grp": pa.array([grp] * len(full), pa.int64()), "runs": pa.array([pack_sorted(own[x]) for x in parts], pa.binary()), "n": pa.array([_pack_counts(pages[x]) for x in parts], pa.binary())})

    return send


def _pack_counts(counts: np.ndarray) -> bytes:
    return squeeze(counts.astype("<u4").tobytes())


def _unpack_counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(unsqueeze(blob), "<u4").astype(np.int64)


def _reply(table: pa.Table) -> pa.Table:
    """To each group, those of its digests that another group has too, with the pages of all."""
    lists, counts = [unpack_sorted(x) for x in table.column("runs").to_pylist()], [_unpack_counts(x) for x in table.column("n").to_pylist()]
    every, place, groups = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    total = np.bincount(place, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)
    shared, total = every[groups > 1], total[groups > 1]
    out: dict[str, list] = {"grp": [], "runs": [], "n": []}
    for g, x in zip(table.column("grp").to_pylist(), lists, strict=True):
        mine = x[found_in(x, shared)]
        if len(mine):
            out["grp"].append(g)
            out["runs"].append(pack_sorted(mine))
            out["n"].append(_pack_counts(total[np.searchsorted(shared, mine)]))
    return pa.table({"grp": pa.array(out["grp"], pa.int64()), "runs": pa.array(out["runs"], pa.binary()), "n": pa.array(out["n"], pa.binary())})


def _texts(docs: pa.Table, replies: pa.Table) -> pa.Table:
    rows = _unpack(docs.column("pages").to_pylist())
    pages = [(host_of(r[1]), parse(r[2] or "")) for r in rows]
    streams = _Streams(pages)
    length, having = streams.repeats()
    in_host = np.bincount(streams.host_of_page, minlength=len(streams.names))
    if len(replies):
        known = np.concatenate([unpack_sorted(x) for x in replies.column("runs").to_pylist()])
        total = np.concatenate([_unpack_counts(x) for x in replies.column("n").to_pylist()])
        rank = np.argsort(known)
        known, total = known[rank], total[rank]
        digest = streams.digests()
        elsewhere = streams.whole & found_in(digest, known)
        having[elsewhere] = total[np.searchsorted(known, digest[elsewhere])]
        length[elsewhere] = np.maximum(length[elsewhere], RUN)
        hosts = streams.name_digests()
        there = found_in(hosts, known)
        in_host[there] = total[np.searchsorted(known, hosts[there])]
    n = len(streams.tokens)
    starts = np.flatnonzero(length >= RUN)
    covered = _covered(starts, length[starts], n)
    # of a run that is repeated, each part of RUN tokens is: those that enough pages have cover what is common
    often = np.flatnonzero(streams.whole & (length >= RUN) & (having >= np.maximum(COMMON, -(-in_host // 2))[streams.host])) if n else starts
    common = _covered(often, np.full(len(often), RUN), n)
    # blocks begin after the one before, or after the mark of the page before
    first = np.concatenate(([0], np.cumsum(streams.sizes)[:-1])) if len(streams.sizes) else streams.sizes
    first = first + np.repeat(np.arange(len(pages)), streams.blocks)
    inner = np.maximum(streams.sizes - 1, 0)
    sums = lambda flags: (lambda c: c[first + inner] - c[first])(np.concatenate(([0], np.cumsum(flags))))
    n_covered, n_common = (sums(x) for x in (covered, common)) if len(first) else (first, first)
    last = np.cumsum(streams.blocks)
    text, repeated = [], []
    bounds = np.searchsorted(streams.page, np.arange(len(pages) + 1))
    for p, (_, page) in enumerate(pages):
        own, lo, hi = slice(last[p] - streams.blocks[p], last[p]), bounds[p], bounds[p + 1]
        text.append("\n".join(page.kept((n_covered[own] == inner[own]).tolist(), (n_common[own] == inner[own]).tolist(), (n_covered[own] > 0).tolist())))
        repeated.append(int((covered[lo:hi] & ~streams.ends[lo:hi]).sum()))
    return pa.table(
        {
            "page_id": pa.array([r[0] for r in rows], pa.int64()),
            "url": pa.array([r[1] for r in rows], pa.string()),
            "text": pa.array(text, pa.string()),
            "n_chars": pa.array([len(t) for t in text], pa.int64()),
            "n_repeated": pa.array(repeated, pa.int64()),
        }
    )


#: Html of a group, at least, however small the input; groups that a task of a shuffle has, about.
LEAST_GROUP, GROUPS_A_TASK = 256 << 10, 4


def main_text(pages: DataFrame, seg_bytes: int = 8 << 20) -> DataFrame:
    """Per page: page_id, url, text, n_chars, n_repeated (tokens in runs that other pages of the host have).

    The driver holds one entry for each host above a group's bytes, at most their total / seg_bytes.
    """
    spark = pages.sparkSession
    ship_package(spark)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    size = input_bytes(pages)
    seg_bytes = min(seg_bytes, max(LEAST_GROUP, size // (GROUPS_A_TASK * shuffle_parts(spark))))
    sizes = pages.groupBy(host.alias("host")).agg(F.sum(F.octet_length("html")).alias("bytes")).where(F.col("bytes") > seg_bytes)
    heavy = {r["host"]: -(-r["bytes"] // (seg_bytes // 2)) for r in sizes.toLocalIterator()}
    groups = max(64, 4 * size // seg_bytes)
    bits = int(max(2 * shuffle_parts(spark), size // seg_bytes, 1) - 1).bit_length()
    dealt = _dealt(pages, heavy, groups)
    result = "page_id long, url string, text string, n_chars long, n_repeated long"
    if not heavy:
        nothing = pa.table({"runs": pa.array([], pa.binary()), "n": pa.array([], pa.binary())})
        return dealt.groupBy("grp").applyInArrow(lambda table: _texts(table, nothing), result)
    sent = dealt.groupBy("grp").applyInArrow(_send(bits), "bucket int, grp long, runs binary, n binary")
    replies = sent.groupBy("bucket").applyInArrow(_reply, "grp long, runs binary, n binary")
    return dealt.groupBy("grp").cogroup(replies.groupBy("grp")).applyInArrow(_texts, result)
