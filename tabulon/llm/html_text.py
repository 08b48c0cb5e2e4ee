"""Main text of web pages by host repeats and page structure.

A page becomes blocks of text, and its blocks one stream of tokens.  All suffixes
of the streams of a host, from every token on, are compared to the depth of
``RUN`` tokens: equal ones are brought together by hash, which is the part of a
suffix array that repeats need (no order is stored).  A cut suffix (a run) on two
distinct pages is a repeated substring; blocks that repeats cover are
boilerplate.  What the page itself
marks as menu, header, footer, sidebar, notice, advert, form, script, style or
comments goes as well, with the articles in it (but a form may wrap a page).

In an article or a main part, a run counts as a repeat only if it is on more
rows than the part itself is: than all but ``1 - COVER`` of the part's tokens.
So an article that was published twice stays whole, and what its host repeats
on further pages goes from it.  A part of which repeats on equally many rows
make up ``COVER`` or more cannot be told from a copy and stays.

Of what is left, the articles are the text if they have at least as many tokens
as the rest of the page; else the main part with its articles by the same rule;
else every block that neither structure nor repeats remove.

Pages are parsed once, in time linear in their length.  Their blocks are stored
compressed, bucketed by a slot that every task takes from one bucket, so that
they never move: what is found is sent to the slots of its pages.

1. The least of the grams of a run by hash is its anchor.  Equal runs have equal
   anchors, so only anchors on two pages can be those of repeats.  Anchors are
   cut to a part of their hash: two that fall together cost time, not results.
2. The runs of these anchors are compared by their whole hash, with the rows
   that they are on.  Of the key of a page 40 bits move: two pages are taken for
   one once in 2^40 pairs.

Both move as blobs of numbers by ranges of the hash.  An anchor on more than two
pages of a batch is known to be shared there: two of its pages go to its range
and the others straight back to their slots, so a host with a third of all pages
spreads over all tasks.

Defined results: null or empty html has empty text; unclosed tags end with
their parent; unclosed comments, scripts and styles run to the end; a ``<`` that
opens no tag stays as text; broken
references stay as written; a null or bare url shares one nameless host;
repeated rows each get their row and count as one page for repeats outside
articles and main parts.
"""

from __future__ import annotations

import collections
import functools
import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .storage import bucketed, collect_garbage, discard, materialise, n_parts

#: Tokens of a cut suffix.
RUN = 8
#: Tokens of the grams of which the least is a run's anchor.
GRAM = 4
#: Bits of a slot, the low ones of an anchor's entry.
SLOT_BITS = 18
SLOT = np.uint64((1 << SLOT_BITS) - 1)
#: Bytes that move of an entry, of a run, of the key that tells its page, and of a slot. The upper bits of the first two are their range's.
ENTRY, OF_RUN, OF_KEY, OF_SLOT = 6, 7, 5, 3
#: Entries that are dealt at once.
DEAL = 1 << 21
#: Share of a block's tokens that repeats must cover.
COVER = 0.8

# Fixed lists of HTML element names and of words in class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg select option".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOILER = frozenset("nav footer aside form menu dialog button head".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion related share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
CLOSES_P = BLOCK - frozenset("li dd dt td th tr tbody thead tfoot caption legend summary figcaption body html head".split())

#: A tag's name, and the rest of a tag: quotes count after an equals sign only. Neither gives back what it has read.
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+>")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)")

#: Kinds of blocks.
OUTSIDE, STRUCTURE, COMMENTS, FORM, ARTICLE, MAIN = range(6)


def marked(name: str, attributes: str) -> bool:
    """Whether an element is boilerplate by name or attributes."""
    if name in BOILER:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        if key.lower() == "role":
            if value in ROLES:
                return True
        elif not HINTS.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            return True
    return False


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of every tag and comment (without name), given back to move on behind it.

    The next start is sent in, as raw elements are skipped.
    """
    at, last, last_odd = 0, page.rfind(">"), page.rfind("--!>")
    while True:
        start = page.find("<", at)
        if start < 0:
            return
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4) + 3
            if last_odd >= start + 4 and 0 <= (odd := page.find("--!>", start + 4, end if end > 2 else len(page))):
                end = odd + 4
            found = (start, end if end > 2 else len(page), "", "", "")
        elif start > last:
            return
        elif page[start + 1 : start + 2] in ("!", "?"):
            found = (start, page.index(">", start) + 1, "", "", "")
        elif name := NAME.match(page, start + 1):
            rest = REST.match(page, name.end())
            # a quote that is open to the end quotes nothing
            end = rest.end() if rest else page.find(">", name.end()) + 1
            found = (start, end, name[1], name[2].lower(), page[name.end() : end - 1])
        else:
            at = start + 1
            continue
        at = (yield found) or found[1]


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, kind) of all blocks with text, in page order."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []  # (name, kind inside)
    opened: collections.Counter[str] = collections.Counter()  # names on the stack
    scopes: list[int] = []  # places of block elements on the stack
    kind = OUTSIDE
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((text, kind))

    def close(depth: int) -> None:
        nonlocal kind
        opened.subtract(name for name, _ in stack[depth:])
        del stack[depth:]
        while scopes and scopes[-1] >= depth:
            scopes.pop()
        kind = stack[-1][1] if stack else OUTSIDE

    at, walk, move = 0, tags(page), None
    while True:
        try:
            start, end, slash, name, attributes = walk.send(move)
        except StopIteration:
            held.append(page[at:])
            break
        held.append(page[at:start])
        at, move = end, None
        if not name:
            continue
        if slash:
            if name in BLOCK:
                flush()
            if opened[name] > 0:
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                if name in BLOCK or stack[depth][1] != kind or (stack[depth - 1][1] if depth else OUTSIDE) != kind:
                    flush()
                close(depth)
            continue
        if name in RAW and not attributes.endswith("/"):
            found = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = move = found.end() if found else len(page)
            continue
        if name == "br" or name == "wbr":
            held.append(" " if name == "br" else "")
            continue
        if name in BLOCK:
            flush()
        if name in VOID or attributes.endswith("/"):
            continue
        if name == "body" and opened["head"] > 0:
            close(next(i for i, (x, _) in enumerate(stack) if x == "head"))
        if name in CLOSES_P and scopes and stack[scopes[-1]][0] == "p":
            close(scopes[-1])
        inside = kind
        if name in ("article", "main"):
            if marked("", attributes) or (name == "article" and kind == STRUCTURE):
                inside = STRUCTURE
            elif name == "article":
                inside = COMMENTS if kind == COMMENTS else ARTICLE
            else:
                inside = COMMENTS if kind == COMMENTS else MAIN
        elif kind not in (STRUCTURE, COMMENTS) and (marked(name, attributes) or (name == "header" and kind != ARTICLE)):
            inside = COMMENTS if re.search("comment", attributes, re.I) else FORM if name == "form" else STRUCTURE
        if inside != kind:
            flush()
        kind = inside
        if name in BLOCK:
            scopes.append(len(stack))
        opened[name] += 1
        stack.append((name, kind))
    flush()
    return out


def chosen(found: list[tuple[str, int]], count: np.ndarray, off: np.ndarray) -> list[str]:
    """The page's text: ``count`` is on how many rows each token's most common run is (0: no repeat), ``off`` the tokens of each block."""
    kind = np.array([k for _, k in found], np.int64)
    size = np.diff(off)
    least = np.zeros(len(found), np.int64)
    inside = np.isin(kind, (ARTICLE, MAIN))
    own = np.sort(count[np.repeat(inside, size)])
    if len(own):
        # all but 1 - COVER of the part's tokens are on so many rows or more: on these the part itself lies
        least[inside] = own[int(len(own) * (1 - COVER))]
    sums = np.concatenate(([0], np.cumsum(count > np.repeat(least, size))))
    share = (sums[off[1:]] - sums[off[:-1]]) / np.maximum(size, 1)
    left = np.isin(kind, (OUTSIDE, ARTICLE, MAIN)) & (share < COVER)
    take = left
    for some in ((MAIN, ARTICLE), (ARTICLE,)):
        part = left & np.isin(kind, some)
        if size[part].sum() and 2 * size[part].sum() >= size[take].sum():
            take = part
    return [found[i][0] for i in np.flatnonzero(take)]


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


@functools.lru_cache(1 << 16)
def host_hash(host: str) -> np.uint64:
    data = np.frombuffer(host.encode() or b"\0", np.uint8)
    return K.Rolling(K.byte_values(1)[data], 1).slices(np.array([0]), np.array([len(data)]))[0]


def slots(spark: SparkSession, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All slots in the order of their buckets, of ``n``, and the first of each bucket in it."""
    found = spark.range(1 << SLOT_BITS).select(F.col("id").cast("int").alias("g"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("b")).toArrow()
    slot, bucket = (found.column(c).to_numpy() for c in ("g", "b"))
    order = np.lexsort((slot, bucket))
    return slot[order].astype(np.int32), np.searchsorted(bucket[order], np.arange(n + 1))


def packed(slot: np.ndarray, edge: np.ndarray):
    """(key, id, url, html, part) to (key, id, url, g, size, blocks): kinds and texts of the blocks, compressed, and the page's slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            raw = []
            for page in batch.column("html"):
                found = blocks(page.as_py())
                raw.append("\n".join(["".join(str(k) for _, k in found), *(x for x, _ in found)]).encode())
            bucket = np.asarray(batch.column("part")) % (len(edge) - 1)
            size = np.maximum(edge[bucket + 1] - edge[bucket], 1)
            g = slot[(edge[bucket] + np.asarray(batch.column("key")) % size) % len(slot)]
            sizes = pa.array([len(x) for x in raw], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "id", "url")), pa.array(g), sizes, pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary())],
                ["key", "id", "url", "g", "size", "blocks"],
            )

    return run


class Streams:
    """The streams of pages in a row: their texts, kinds of blocks, tokens, and the first tokens of pages and of blocks."""

    def __init__(self, raw: list[bytes], urls: list[str | None]):
        parts = [x.partition(b"\n") for x in raw]
        self.kinds, self.texts = [x[0].decode() for x in parts], [x[2] for x in parts]
        data = np.frombuffer(b"".join(self.texts), np.uint8)
        at = np.concatenate(([0], np.cumsum([len(x) for x in self.texts], dtype=np.int64)))
        s, e, self.pages = K.word_bounds(data, at, K.NOT_SPACE)
        self.token = K.word_hashes(data, s, e) if len(s) else np.zeros(0, np.uint64)
        begin = np.sort(np.concatenate((at[:-1][np.diff(at) > 0], np.flatnonzero(data == 10) + 1)))
        self.blocks = np.append(np.searchsorted(s, begin), len(s))
        self.host = np.array([host_hash(host_of(x)) for x in urls], np.uint64)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first token, page, anchor under the host, hash under the host) of every run."""
        n = len(self.token)
        if n < RUN:
            none = np.zeros(0, np.int64)
            return none, none, none.view(np.uint64), none.view(np.uint64)
        roll = K.Rolling(self.token)
        page = np.repeat(np.arange(len(self.host)), np.diff(self.pages))
        first = np.flatnonzero(np.arange(n) + RUN <= self.pages[1:][page])
        host = self.host[page]
        grams = K.mix64(roll.grams(GRAM) ^ host[: n - GRAM + 1])
        least = K.slide(grams, RUN - GRAM + 1, np.minimum)
        return first, page[first], least[first], K.mix64(roll.grams(RUN) ^ host[: n - RUN + 1])[first]


def streams(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[int, int, Streams]]:
    """(first row, end row, streams) of runs of whole pages, about ``most`` bytes each."""
    codec = pa.Codec("zstd")
    packs, urls, sizes = batch.column("blocks"), batch.column("url"), np.asarray(batch.column("size"))
    total = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, "right")) - 1)
        raw = [codec.decompress(packs[i].as_py(), int(sizes[i]), asbytes=True) if sizes[i] else b"" for i in range(lo, hi)]
        yield lo, hi, Streams(raw, urls.slice(lo, hi - lo).to_pylist())
        lo = hi


def distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def dealt(b: np.ndarray, **columns: tuple[np.ndarray, int]) -> pa.RecordBatch:
    """One row for each b, with the low bytes, as many as given, of its rows of each column of 64-bit numbers."""
    order = np.argsort(b, kind="stable")
    b = b[order]
    new = np.ones(len(b), bool)
    new[1:] = b[1:] != b[:-1]
    first = np.flatnonzero(new)
    edge = np.append(first, len(b))
    out = [pa.array(b[first].astype(np.int32))]
    for x, width in columns.values():
        data = np.ascontiguousarray(x[order]).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        out.append(pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((edge * width).astype(np.int32)), pa.py_buffer(data)]))
    return pa.RecordBatch.from_arrays(out, ["b", *columns])


def undealt(table: pa.Table, name: str, width: int) -> np.ndarray:
    low = np.frombuffer(b"".join(table.column(name).to_pylist()), np.uint8).reshape(-1, width)
    x = np.zeros((len(low), 8), np.uint8)
    x[:, :width] = low
    return x.view(np.uint64).ravel()


def gathered(batches: Iterator[pa.RecordBatch], of: Callable[[pa.RecordBatch], Callable[[int, Streams], tuple[np.ndarray, ...]]]) -> Iterator[list[np.ndarray]]:
    """The columns that ``of`` a batch finds in the streams from a row on, ``DEAL`` rows or more at once."""
    held, n = [], 0
    for batch in batches:
        found = of(batch)
        for lo, _, pages in streams(batch):
            held.append(found(lo, pages))
            n += len(held[-1][0])
            if n >= DEAL:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held, n = [], 0
    if n:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def cut(anchor: np.ndarray, bits: int) -> np.ndarray:
    """The part of an anchor that its range, the first ``bits``, and its entry tell."""
    return anchor & ~SLOT & np.uint64((1 << 8 * ENTRY) - 1 | ((1 << bits) - 1) << (64 - bits))


def anchors_of(bits: int):
    """(g, url, size, blocks) to (b, x): anchors of pages with their slots, by ranges; those known to be shared lie beyond the ranges."""

    def of(batch: pa.RecordBatch):
        g = np.asarray(batch.column("g")).astype(np.uint64)

        def found(lo: int, pages: Streams) -> tuple[np.ndarray, ...]:
            _, page, anchor, _ = pages.runs()
            page, anchor = distinct(page, cut(anchor, bits))
            return (anchor | g[lo + page],)

        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (x,) in gathered(batches, of):
            x = np.sort(x)
            anchor = x & ~SLOT
            ranged = np.arange(len(x)) - np.searchsorted(anchor, anchor) < 2
            if ranged.any():
                yield dealt((x[ranged] >> np.uint64(64 - bits)).astype(np.int64), x=(x[ranged], ENTRY))
            if not ranged.all():
                rest = x[~ranged]
                yield dealt((1 << bits) + ((rest & SLOT).astype(np.int64) & ((1 << bits) - 1)), x=(rest, 8))

    return run


def shared(bits: int):
    """(b, x) to (g, a): anchors on two pages or more and the slots of these."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        b = key[0].as_py()
        if b < 1 << bits:
            x = np.sort(undealt(table, "x", ENTRY)) | np.uint64(b << (64 - bits))
            same = (x[1:] & ~SLOT) == (x[:-1] & ~SLOT)
            x = x[np.append(same, False) | np.append(False, same)]
        else:
            x = undealt(table, "x", 8)
        return pa.table({"g": pa.array((x & SLOT).astype(np.int32)), "a": pa.array(K.signed(x & ~SLOT))})

    return run


def runs_of(bits: int):
    """(key, g, url, size, blocks, a) to (b, run, key, g): the distinct runs of each page whose anchors are shared."""

    def of(batch: pa.RecordBatch):
        known = np.unique(np.asarray(batch.column("a").flatten(), np.int64).view(np.uint64))
        key, g = np.asarray(batch.column("key")).view(np.uint64), np.asarray(batch.column("g")).astype(np.uint64)

        def found(lo: int, pages: Streams) -> tuple[np.ndarray, ...]:
            _, page, anchor, run = pages.runs()
            near = np.isin(cut(anchor, bits), known)
            page, run = distinct(page[near], run[near])
            return run, key[lo + page], g[lo + page]

        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, key, g in gathered(batches, of):
            order = np.argsort(run)  # equal ones side by side are compressed as they move
            run, key, g = run[order], key[order], g[order]
            yield dealt((run >> np.uint64(64 - bits)).astype(np.int64), run=(run, OF_RUN), key=(key, OF_KEY), g=(g, OF_SLOT))

    return run


def repeats(bits: int):
    """(b, run, key, g) to (g, run, n): runs on two distinct pages or more, on how many rows, and the slots of these."""

    def run(b: tuple, table: pa.Table) -> pa.Table:
        run, key, g = undealt(table, "run", OF_RUN), undealt(table, "key", OF_KEY), undealt(table, "g", OF_SLOT)
        order = np.lexsort((key, run))
        run, key, g = run[order], key[order], g[order]
        first, end = np.searchsorted(run, run), np.searchsorted(run, run, "right")
        some = key[first] != key[end - 1]
        # what the range tells lies above the bytes that move, or is the same there
        whole = run[some] | np.uint64(b[0].as_py() << (64 - bits))
        return pa.table({"g": pa.array(g[some].astype(np.int32)), "run": pa.array(K.signed(whole)), "n": pa.array((end - first)[some].astype(np.int32))})

    return run


def text_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, url, size, blocks, runs, counts) to (id, url, text)."""
    for batch in batches:
        known, place = np.unique(np.asarray(batch.column("runs").flatten(), np.int64).view(np.uint64), return_index=True)
        times = np.asarray(batch.column("counts").flatten(), np.int64)[place]
        out = []
        for lo, hi, pages in streams(batch):
            first, _, _, run = pages.runs()
            on = np.zeros(len(pages.token) + RUN - 1, np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, run), len(known) - 1)
                on[first + RUN - 1] = np.where(known[at] == run, times[at], 0)
            # the runs that cover a token begin at it or at one of the RUN - 1 before
            count = K.slide(on, RUN, np.maximum)
            block = 0
            for i in range(hi - lo):
                kinds = pages.kinds[i]
                if not kinds:
                    out.append("")
                    continue
                off = pages.blocks[block : block + len(kinds) + 1]
                block += len(kinds)
                found = [(x, int(k)) for x, k in zip(pages.texts[i].decode().split("\n"), kinds, strict=True)]
                out.append("\n".join(chosen(found, count[off[0] : off[-1]], off - off[0])))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(out, pa.string())], ["id", "url", "text"])


def free(spark: SparkSession, *stored: DataFrame) -> None:
    """Delete stored results and the shuffle files of the plans so far: the last plan is held until another one has run."""
    spark.range(1, numPartitions=1).groupBy().count().collect()
    if stored:
        discard(*stored)
    else:
        collect_garbage(spark)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text."""
    spark = pages.sparkSession
    n = n_parts(spark)
    bits = min(14, max(8, (8 * n - 1).bit_length()))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")
    ).withColumn("key", F.xxhash64("id", "url", "html")).withColumn("part", F.spark_partition_id())
    stored = bucketed(rows.mapInArrow(packed(*slots(spark, n)), "key long, id long, url string, g int, size int, blocks binary"), "g", "blocks")
    # each exchange is freed before the next one, so results are stored before they are sent to their slots
    anchors = materialise(stored.select("g", "url", "size", "blocks").mapInArrow(anchors_of(bits), "b int, x binary").groupBy("b").applyInArrow(shared(bits), "g int, a long"), "anchors")
    free(spark)
    near = anchors.repartition(n, "g").groupBy("g").agg(F.collect_list("a").alias("a"))
    runs = stored.select("key", "g", "url", "size", "blocks").join(near.hint("shuffle_hash"), "g").mapInArrow(runs_of(bits), "b int, run binary, key binary, g binary")
    repeated = materialise(runs.groupBy("b").applyInArrow(repeats(bits), "g int, run long, n int"), "repeats")
    free(spark, anchors)
    own = repeated.repartition(n, "g").groupBy("g").agg(F.collect_list(F.struct("run", "n")).alias("x")).select("g", F.col("x.run").alias("runs"), F.col("x.n").alias("counts"))
    return (
        stored.select("id", "url", "g", "size", "blocks").join(own.hint("shuffle_hash"), "g", "left")
        .select("id", "url", "size", "blocks", F.coalesce("runs", F.array().cast("array<long>")).alias("runs"), F.coalesce("counts", F.array().cast("array<int>")).alias("counts"))
        .mapInArrow(text_of, "id long, url string, text string")
    )
