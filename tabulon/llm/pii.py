"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds: e-mail addresses, IPv4 addresses, payment cards and phone numbers by
their formats.  Every token with a digit or an at-sign is a mention; its
patterns are contexts, namely the word before it, and the words before and
after it, and besides the word before it together with the token's shape.  A
long token with several digits has its form as one more pattern, whatever stands
around it: where most such tokens of a corpus are seeds, others of that form
(keys, numbers that fail their checksum) are identifiers too.  A context alone
leads to tokens of any shape, also of one that no seed has, but only if at least
``FIT`` of the tokens of that rough shape are where trusted patterns lead: what
stands everywhere, such as a year, is no identifier for a trusted context.

Patterns and instances (token texts) form a bipartite graph that is scored in
rounds until no further pattern is trusted: a pattern's confidence is the mean
score of its distinct instances (smoothed), an instance's score is the best
confidence among patterns that have enough support.  Instances that end above
``confidence`` without being seeds are discovered identifiers, reported with
kind ``extra``; seeds always stay.

Scores are per-key counts and sums (map-side combined); texts are read once,
each format searches a text once, and only mentions move.  Work on a text is
near linear in its length and its matches: places are running sums in blocks.

Spans are code points, end exclusive.  Defined results: null texts are empty;
texts without digits or at-signs have no spans; repeated rows each get their
row with the same spans; no rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialise

#: Fixed formats, as linear-time patterns: a match may start only where a run
#: of its characters starts (or where the last match ended), and never gives back.
FORMATS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that each format cannot do without: texts without it are not searched.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
KINDS = tuple(FORMATS)
EXTRA = "extra"
MENTION = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
CONFIDENCE = 0.6
SUPPORT = 3
#: Least share of the distinct tokens of a rough shape that trusted patterns must reach.
FIT = 0.5
#: A token of so many characters and digits has its form as a pattern.
LONG, DIGITS = 12, 3
SPAN = "array<struct<kind:string,start:long,end:long>>"
#: Stands around matches while a text is cut; a text that holds it gets another control character of no format.
MARK, OTHER = "\x01", "\x03"
#: Entries of a list that are summed at once, and characters that are cut at once.
BLOCK, CHARS = 256, 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and deep ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(entries: Column, zero: int, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative op over an array of longs, block by block: an array grows by copying."""
    return let(entries, lambda x: running_of(x, zero, op))


def running_of(entries: Column, zero: int, op: Callable[[Column, Column], Column]) -> Column:
    none = F.array().cast("array<long>")
    first = F.lit(zero).cast("long")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(entries) - 1) / BLOCK).cast("int")), lambda b: F.slice(entries, b * BLOCK + 1, F.lit(BLOCK)))
    inner = F.transform(
        blocks,
        lambda block: F.aggregate(
            block, F.struct(first.alias("at"), none.alias("out")),
            lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(op(acc["at"], x))).alias("out")),
        ),
    )

    def joined(inner: Column) -> Column:
        before = F.aggregate(
            inner, F.struct(first.alias("at"), none.alias("out")),
            lambda acc, x: F.struct(op(acc["at"], x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"],
        )
        return F.flatten(F.zip_with(inner, before, lambda x, b: F.transform(x["out"], lambda v: op(b, v))))

    whole = let(inner, joined)
    return F.when(F.size(entries) > 0, whole).otherwise(none)


def parts_of(text: Column, pattern: str, present: Column) -> Column:
    """The text in parts, gaps and matches in turn, by one search; nothing where a needed character is missing."""
    marked = F.regexp_replace(text, F.lit(f"({pattern})"), F.lit(f"{MARK}$1{MARK}"))
    return F.when(present, F.split(marked, MARK, -1)).otherwise(F.array().cast("array<string>"))


def ends_of(parts: Column) -> Column:
    """Where each part ends."""
    return running(F.transform(parts, lambda p: F.length(p).cast("long")), 0, lambda a, b: a + b)


def every_match(parts: Column) -> Column:
    """The places of matches among the parts."""
    return F.when(F.size(parts) > 2, F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))


def spans_of(kind: str) -> Column:
    """The valid matches of a kind as (kind, start, end), from its parts and their ends."""
    parts, ends = F.col(f"{kind}_parts"), F.col(f"{kind}_ends")
    good = F.filter(every_match(parts), lambda i: valid(kind, F.get(parts, i)))
    return F.transform(good, lambda i: F.struct(F.lit(kind).alias("kind"), F.get(ends, i - 1).alias("start"), F.get(ends, i).alias("end")))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    figures = F.reverse(F.split(number, ""))
    total = F.aggregate(
        F.transform(figures, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int"))),
        F.lit(0), lambda a, x: a + x,
    )
    return total % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = F.split(match, r"\.")
        return F.forall(part, lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.right(F.regexp_replace(p, "^0+", ""), F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        n = digits(match)
        return F.when(F.length(n).between(16, 19), luhn(n)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(match)).between(8, 15)
    return F.lit(True)


def shape(token: Column) -> Column:
    token = F.regexp_replace(token, "[0-9]+", "9")
    return F.regexp_replace(token, r"\p{L}+", "a")


def rough(token: Column) -> Column:
    """The shape with runs of digits told apart by their length: up to 3, 4, up to 7, up to 12, or more."""
    for least, sign in ((13, "#13"), (8, "#8"), (5, "#5"), (4, "#4"), (1, "#1")):
        token = F.regexp_replace(token, f"(?<![0-9#])[0-9]{{{least},}}", sign)
    return F.regexp_replace(token, r"\p{L}+", "a")


def form(token: Column) -> Column:
    """The pattern of a long token with several digits, null of others."""
    return F.when((F.length(token) >= LONG) & (F.length(digits(token)) >= DIGITS), F.lit("form long"))


def seeded(mentions: Column, base: Column) -> Column:
    """Whether each mention overlaps a base span, by one sweep over both."""
    ends = F.transform(mentions, lambda m: F.struct(m["end"].alias("at"), F.lit(0).alias("kind"), m["start"].alias("start"), F.lit(-1).cast("long").alias("upto")))
    starts = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("kind"), F.lit(-1).cast("long").alias("start"), b["end"].alias("upto")))
    events = F.array_sort(F.concat(ends, starts))
    furthest = running(F.transform(events, lambda x: x["upto"]), -1, lambda a, b: F.greatest(a, b))
    met = F.filter(F.arrays_zip(events.alias("e"), furthest.alias("f")), lambda z: z["e"]["kind"] == 0)
    return F.transform(met, lambda z: z["f"] > z["e"]["start"])


def scan(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, k1, k2, base, mentions) of every text; with ``carry`` also the text and those columns as a struct."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = [F.struct(*[F.col(c) for c in carry]).alias("carried"), F.col(text_col).isNull().alias("missing")] if carry else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), *kept)
    clean = F.when(F.contains("text", F.lit(MARK)), F.translate("text", MARK, OTHER)).otherwise(F.col("text"))
    rows = rows.withColumns({"clean": clean, "digit": F.col("text").rlike("[0-9]")})
    needs = {kind: F.contains("text", F.lit(NEEDS[kind])) if NEEDS[kind] else F.col("digit") for kind in KINDS}
    patterns = FORMATS | {"mention": MENTION}
    needs["mention"] = F.col("digit") | F.contains("text", F.lit("@"))
    # searches and sums become columns of their own, so that each runs once a text
    rows = rows.withColumns({f"{kind}_parts": parts_of(F.col("clean"), p, needs[kind]) for kind, p in patterns.items()})
    rows = rows.withColumns({f"{kind}_ends": ends_of(F.col(f"{kind}_parts")) for kind in patterns})
    parts, ends = F.col("mention_parts"), F.col("mention_ends")
    blank = lambda gap: F.trim(F.translate(gap, "\t\n\x0b\x0c\r", "     ")) == ""
    # between two mentions with only white space, each is the other's neighbour
    before = lambda i: F.when(blank(F.get(parts, i - 1)) & (i > 1), F.get(parts, i - 2)).otherwise(F.regexp_extract(F.get(parts, i - 1), r"(?<!\S)(\S++)\s*+$", 1))
    after = lambda i: F.when(blank(F.get(parts, i + 1)) & (i + 2 < F.size(parts)), F.get(parts, i + 2)).otherwise(F.regexp_extract(F.get(parts, i + 1), r"^\s*+(\S++)", 1))
    seen = F.transform(
        every_match(parts),
        lambda i: F.struct(F.get(ends, i - 1).alias("start"), F.get(ends, i).alias("end"), F.get(parts, i).alias("token"), F.lower(before(i)).alias("before"), F.lower(after(i)).alias("after")),
    )
    rows = rows.withColumns({"base": F.concat(*[spans_of(k) for k in KINDS]), "mentions": seen})
    return rows.select(
        "id", F.xxhash64(F.lit("one"), "id", "text").alias("k1"), F.xxhash64(F.lit("two"), "id", "text").alias("k2"),
        "base", "mentions", *(["text", "missing", "carried"] if carry else []),
    )


def patterns_of(mention: Column) -> Column:
    """Contexts and forms that a mention stands for."""
    token, led = mention["token"], mention["before"] != ""
    return F.array_compact(
        F.array(
            F.when(led, F.concat_ws(" ", F.lit("shape"), mention["before"], shape(token))), F.when(led, F.concat_ws(" ", F.lit("before"), mention["before"])),
            F.when(led, F.concat_ws(" ", F.lit("around"), mention["before"], mention["after"])), form(token),
        )
    )


def discover(scanned: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(k1, k2, extra): spans of instances that trusted patterns lead to."""
    zipped = F.arrays_zip(F.col("mentions").alias("m"), seeded(F.col("mentions"), F.col("base")).alias("seed"))
    seen = scanned.filter("size(mentions) > 0").select("k1", "k2", F.explode(zipped).alias("x")).select(
        "k1", "k2", "x.seed", F.col("x.m.start").alias("start"), F.col("x.m.end").alias("end"), F.col("x.m.token").alias("token"),
        rough(F.col("x.m.token")).alias("rough"), patterns_of(F.col("x.m")).alias("patterns"),
    )
    seen = materialise(seen, "mentions")
    pairs = seen.select(F.explode("patterns").alias("pattern"), "token", "rough", "seed")
    graph = materialise(pairs.groupBy("pattern", "token", "rough").agg(F.max("seed").alias("seed")), "graph")
    shapes = materialise(graph.groupBy("rough", "token").agg(F.lit(1).alias("one")).groupBy("rough").agg(F.sum("one").alias("n")), "shapes")
    scored, old, before, reached = graph.withColumn("score", F.col("seed").cast("double")), None, -1, None
    while True:
        trusted = (
            scored.groupBy("pattern")
            .agg((F.sum("score") / (F.count(F.lit(1)) + 1)).alias("conf"), F.count(F.when(F.col("score") >= confidence, 1)).alias("n"))
            .filter((F.col("n") >= support) & (F.col("conf") >= confidence))
            .select("pattern", "conf")
        )
        trusted = materialise(trusted, "trusted")
        n = trusted.count()
        if n == before:
            break
        before = n
        safe = F.col("pattern").startswith("shape ") | F.col("pattern").startswith("form ")
        reached = graph.join(trusted, "pattern").groupBy("token", "rough").agg(F.max("conf").alias("any"), F.max(F.when(safe, F.col("conf"))).alias("shaped"))
        reached = materialise(reached, "reached")
        fit = reached.groupBy("rough").agg(F.count(F.lit(1)).alias("k")).join(shapes, "rough").filter(F.col("k") >= F.col("n") * FIT).select("rough", F.lit(True).alias("fits"))
        best = reached.join(fit, "rough", "left").select("token", F.when(F.col("fits"), F.col("any")).otherwise(F.col("shaped")).alias("conf"))
        scored = materialise(
            graph.join(best, "token", "left").select("pattern", "token", "rough", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("conf", F.lit(0.0))).alias("score")),
            "scored",
        )
        discard(*(x for x in (old, reached, trusted) if x is not None))
        old = scored
    good = scored.filter((F.col("score") >= confidence) & ~F.col("seed")).select("token").distinct()
    found = seen.filter("not seed").join(good, "token").groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct(F.lit(EXTRA).alias("kind"), "start", "end"))).alias("extra"))
    found = materialise(found, "extra")
    discard(*(x for x in (seen, graph, shapes, trusted, old) if x is not None))
    return found


def with_extra(scanned: DataFrame, extra: DataFrame) -> DataFrame:
    """``scanned`` with the discovered spans; texts without mentions do not move."""
    none = F.array().cast(SPAN)
    some = scanned.filter("size(mentions) > 0").join(extra, ["k1", "k2"], "left").withColumn("extra", F.coalesce("extra", none))
    return some.unionByName(scanned.filter("size(mentions) = 0").withColumn("extra", none))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: id, base and extra spans (kind, start, end), by kind as listed and then start."""
    scanned = materialise(scan(docs, id_col, text_col), "pii")
    return with_extra(scanned, discover(scanned, **options)).select("id", "base", "extra")


def merged(rows: DataFrame) -> DataFrame:
    """Rows with sorted ``spans`` to the same with ``from`` and ``to``: firsts and ends of the disjoint spans that cover them."""
    rows = rows.withColumn("upto", running(F.transform("spans", lambda s: s["end"]), -1, lambda a, b: F.greatest(a, b)))
    rows = rows.withColumn("new", F.transform("spans", lambda s, i: (i == 0) | (s["start"] >= F.get("upto", i - 1))))
    starts = F.transform(F.filter(F.arrays_zip(F.col("spans").alias("s"), F.col("new").alias("new")), lambda z: z["new"]), lambda z: z["s"])
    ends = F.filter(F.transform("upto", lambda e, i: F.when((i == F.size("upto") - 1) | F.get("new", i + 1), e)), lambda e: e.isNotNull())
    return rows.withColumns({"from": starts, "to": ends}).drop("upto", "new")


def piece(blocks: Column, start: Column, end: Column) -> Column:
    """The characters from start to end of a text in blocks."""
    first, last = F.floor(start / CHARS).cast("int"), F.floor(end / CHARS).cast("int")
    block = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
    inside = lambda x: F.pmod(x, F.lit(CHARS)).cast("int")
    many = F.concat(F.substring(block(first), inside(start) + 1, F.lit(CHARS)), F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(block(last), F.lit(1), inside(end)))
    return F.when(first == last, F.substring(block(first), inside(start) + 1, (end - start).cast("int"))).otherwise(many)


def redacted(rows: DataFrame) -> DataFrame:
    """(text, spans, ...) with each span of the text replaced by its kind in brackets."""
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    rows = merged(rows.withColumn("spans", ordered))
    rows = rows.withColumns({"blocks": F.when(F.size("spans") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHARS}}}"), F.lit(0)))})
    gone = F.transform("from", lambda s, i: F.concat(piece(F.col("blocks"), F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("to", i - 1)), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    rest = piece(F.col("blocks"), F.element_at("to", -1), F.length("text").cast("long"))
    return rows.withColumn("text", F.when(F.size("spans") > 0, F.concat(F.array_join(gone, ""), rest)).otherwise(F.col("text"))).drop("from", "to", "blocks")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input with personal data replaced in the text; other columns unchanged, null texts stay null."""
    columns = tuple(docs.columns)
    others = tuple(c for c in columns if c != text_col) or (text_col,)
    scanned = materialise(scan(docs, id_col, text_col, others), "pii")
    extra = discover(scanned.drop("text", "carried", "missing"), **options)
    rows = with_extra(scanned, extra).select("carried", "missing", "text", F.concat("base", "extra").alias("spans"))
    clean = redacted(rows).withColumn("text", F.when(~F.col("missing"), F.col("text")))
    return clean.select(*[F.col("text").alias(c) if c == text_col else F.col("carried")[c].alias(c) for c in columns])


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
