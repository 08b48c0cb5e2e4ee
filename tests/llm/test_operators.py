"""Every operator against brute force on small tables with nulls, blanks, ties, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import ann, decontaminate, html_text, kernels, language, minhash, mixing, phrases, pii, toxicity
from tabulon.llm.components import components
from tabulon.llm.substring_dedup import substring_dedup
from tabulon.llm.suffix_dedup import suffix_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, h bigint, k1 string, cid string"
VOCAB = [f"w{i}" for i in range(400)]


def passage(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    shared, line = passage(rng, 60), passage(rng, 22)
    out = [passage(rng, rng.randint(1, 90)) for _ in range(25)]
    out += [f"{passage(rng, 15)} {shared} {passage(rng, 9)}" for _ in range(4)] + [f"{line}\n{passage(rng, 8)}\t{line}" for _ in range(3)]
    out += [out[3], out[3], out[26], "", "   \n", None, "a", "x " * 60, "x " * 45, "é😀 " * 30, passage(rng, 3000)]
    words = out[24].split() + passage(rng, 80).split()
    near = list(words)
    near[10] = "changed"
    return out + [" ".join(words), " ".join(near)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", ["s1", "s2", None, "s1"][i % 4], 5, "x", "y") for i, t in enumerate(texts)]
    rows += [(None, "null id " + " ".join(VOCAB[:30]), None, None, 1, "", ""), rows[3], rows[26]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(rows):
    return collections.Counter(rows)


def windows_removed(docs, width):
    rows = sorted(((r.doc_id if r.doc_id is not None else 1 << 60, (r.text or "").encode().split()) for r in docs.collect()), key=lambda x: x[0])
    first = {}
    for i, w in rows:
        for s in range(len(w) - width + 1):
            first.setdefault(tuple(w[s : s + width]), (i, s))
    out = []
    for i, w in rows:
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < (i, s):
                gone[s : s + width] = [True] * width
        out.append((None if i == 1 << 60 else i, len(w), b" ".join(x for x, g in zip(w, gone) if not g)))
    return bag(out)


@pytest.mark.parametrize("width", [20, 6])
def test_substring_dedup(docs, width):
    got = bag((r.id, r.n_units, bytes(r.kept)) for r in substring_dedup(docs, window=width).collect())
    assert got == windows_removed(docs, width)


@pytest.mark.parametrize("width", [40, 400])
def test_suffix_dedup(docs, width):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    count = collections.Counter(b[s : s + width] for _, b in rows for s in range(len(b) - width + 1))
    want = []
    for i, b in rows:
        gone = [False] * len(b)
        for s in range(len(b) - width + 1):
            if count[b[s : s + width]] > 1:
                gone[s : s + width] = [True] * width
        runs = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
        want.append((i, len(b), runs, bytes(x for x, g in zip(b, gone) if not g)))
    got = [(r.id, r.n_units, len(r.spans), bytes(r.kept)) for r in suffix_dedup(docs, window=width).collect()]
    assert bag(got) == bag(want)


def test_phrases_of_a_long_text_in_pieces(monkeypatch):
    # every window belongs to one phrase, whole or in pieces, and equal windows have one head
    rng = random.Random(6)
    raw = " ".join(rng.choice(VOCAB[:9]) for _ in range(900)).encode()
    data, offsets = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    for cut, units in ((phrases.Cut.of("word", 20, 5, 16), raw.split()), (phrases.Cut.of("byte", 60, 8, 40), raw)):
        heads = collections.defaultdict(set)
        for piece in (1 << 21, 130):
            monkeypatch.setattr(phrases, "PIECE", piece)
            parts = [(s + base, h) for vals, off, base in phrases.pieces(cut, data, offsets) for _, s, h, _ in [phrases.phrases(cut, vals, off)]]
            s, h = (np.concatenate(x) for x in zip(*parts))
            assert s[0] == 0 and (np.diff(s) > 0).all()
            owner = np.searchsorted(s, np.arange(len(units) - cut.width + 1), "right") - 1
            for i, o in enumerate(owner):
                w = units[i : i + cut.width]
                heads[w if cut.unit == "byte" else tuple(w)].add(int(h[o]))
        assert all(len(x) == 1 for x in heads.values())


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_decontaminate_both_ways(spark, docs, texts, kind):
    items = [(None, texts[27]), (None, texts[33]), (1, " ".join(texts[25].split()[10:40])), (2, texts[4].upper()), (3, "A"), (4, ""), (5, None), (6, "w1 w2"), (7, texts[30]), (7, texts[30])]
    if kind == "string":
        items = [(i and f"x{i}", t) for i, t in items]
    bench = spark.createDataFrame(items, f"item_id {kind}, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    held = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        m = min(10, len(w))
        for s in range(len(w) - m + 1 if m else 0):
            held[tuple(w[s : s + m])].add(i)
    want = []
    for r in docs.collect():
        w, hit, found = cut(r.text), set(), set()
        for m in {len(k) for k in held}:
            for s in range(len(w) - m + 1):
                if tuple(w[s : s + m]) in held:
                    hit |= set(range(s, s + m))
                    found |= held[tuple(w[s : s + m])]
        want.append((r.doc_id, len(w), len(hit), tuple(sorted((str(i) for i in found if i is not None))) + ((None,) if None in found else ())))
    for limit in (1 << 20, 0):
        got = [(r.id, r.n_words, sum(s.length for s in r.spans), tuple(r["items"])) for r in decontaminate.decontaminate(docs, bench, broadcast_bytes=limit).collect()]
        assert bag(got) == bag(want)


def near_by_brute_force(rows):
    """(id, class_id) of (id, words) rows."""
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} for i, w in rows if w}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = lambda i: 1 << 60 if i is None else i
    for a in sets:
        for b in sets:
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = sorted((root(a), root(b)), key=order)
                parent[y] = x
    return bag((i, root(i) if w else i) for i, w in rows)


def test_near_classes(docs):
    rows = [(r.doc_id, (r.text or "").split()) for r in docs.collect()]
    assert bag((r.id, r.class_id) for r in minhash.near_classes(docs).collect()) == near_by_brute_force(rows)


def test_near_classes_links_that_no_leader_shows(spark):
    # copies with one to three changed words each: many pairs just below the threshold, classes joined by chains
    rng = random.Random(5)
    rows = []
    for start in (0, 1000):
        base = [rng.choice(VOCAB) for _ in range(70)]
        for i in range(60):
            words = list(base)
            for _ in range(rng.randint(1, 3)):
                words[rng.choice((2, 15, 30, 45, 67))] = rng.choice(("one", "two", f"own{i}"))
            rows.append((start + i, words))
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")
    want = near_by_brute_force(rows)
    assert 2 < len({c for _, c in want}) < len(rows)
    assert bag((r.id, r.class_id) for r in minhash.near_classes(frame).collect()) == want


def test_dart_signatures_estimate_weighted_similarity():
    rng, agree = np.random.default_rng(3), []
    for _ in range(40):
        a = rng.integers(1, 1 << 62, 200).astype(np.uint64)
        two = np.concatenate([np.repeat(a, 2), a[:150]])  # weights 2 and 1 of which 150 are shared: similarity 150 / 400
        doc, el, w = minhash.elements(two, np.array([0, 400, 550]), "count")
        sig, has = minhash.signatures(doc, el, w, 2, 125)
        assert has.all() and (sig != 0).all()
        agree.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(agree) - 150 / 400) < 0.02


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 230)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in linked}


def test_mixing(docs, empty):
    rows = mixing.schedule(docs, carry=("source",)).select("id", "size", "source_size", "target", "taken", "carried.source").collect()
    assert len(rows) == docs.count()
    total = sum(r["size"] for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r["size"]
    targets = {k: v[0].target for k, v in by.items()}
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    for k, v in by.items():
        assert v[0].source_size == sum(r["size"] for r in v) and targets[k] <= 2 * v[0].source_size + 1e-9
        assert abs(sum(r.taken for r in v) - targets[k]) <= 1
    again = mixing.schedule(docs).select("id", "size", "taken").collect()
    assert bag(map(tuple, again)) == bag((r.id, r["size"], r.taken) for r in rows)
    assert mixing.schedule(empty).count() == 0


def test_mixing_stores_few_files(spark, docs, monkeypatch):
    """Every file costs processes that set its permissions, so their number follows the cores, not the partitions of the order of service."""
    stored = []

    def counted(df, name, store=mixing.materialise):
        stored.append((name, len((out := store(df, name)).inputFiles())))
        return out

    monkeypatch.setattr(mixing, "materialise", counted)
    few = mixing.schedule(docs).select("id", "size", "target", "taken").collect()
    stored.clear()
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    try:
        many = mixing.schedule(docs).select("id", "size", "target", "taken").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert bag(map(tuple, many)) == bag(map(tuple, few))
    most = mixing.FILES_PER_CORE * spark.sparkContext.defaultParallelism
    assert [name for name, _ in stored] == ["sizes", "placed", "packets", "served"]
    assert all(n <= most for name, n in stored if name in ("packets", "served"))


def luhn(number):
    digits = [int(c) for c in reversed(number)]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def plain_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for kind, pattern in (("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t):
            n = re.sub("[^0-9]", "", m.group())
            if 16 <= len(n) <= 19 and luhn(n) if kind == "card" else 8 <= len(n) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans(spark):
    rng = random.Random(5)
    bits = ["a.b@c.de", "x_y@d-e.f.g@h.i", "😀é", "1.2.3.4", "300.1.2.3", "1.2.3.4.5.6.7.8", "00001.2.3.0255", "4111 1111 1111 1111", "4111-1111 1111 1112", "+1 (222) 333-4444", "+12", "@", "+", "..", "9" * 40, "a%+b@q.r_s@t.u", "word", "\n", "5500005555555559"]
    made = ["".join(rng.choice(bits) + rng.choice(["", " ", "-", "."]) for _ in range(rng.randint(1, 9))) for _ in range(300)] + ["", None, "1" * 30000, "a" * 30000, "1 " * 9000]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string")
    got = {r.id: [tuple(s) for s in r.base] for r in pii.find_pii(docs).collect()}
    assert got == {i: plain_spans(t or "") for i, t in enumerate(made)}


def test_pii_patterns_discover_and_redact(spark):
    rows = [(i, f"write to me at user{i}@mail.org today") for i in range(6)] + [(10, "write to me at user77[at]mail today"), (11, "room 12 is free"), (12, None), (12, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert not any(r.extra for r in pii.find_pii(docs, support=100).collect())
    more = [(20 + i, f"card id {n} ok") for i, n in enumerate(["4111111111111111", "5500005555555559", "4012888888881881", "4222222222222222"])] + [(30, "card id 4111111111111112 ok")]
    found = {r.id: r for r in pii.find_pii(docs.union(spark.createDataFrame(more, docs.schema)), confidence=0.5).collect()}
    assert [tuple(s) for s in found[30].extra] == [("extra", 8, 24)] and not found[11].extra and not found[20].extra
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[0] == "write to me at [EMAIL] today" and clean[11] == "room 12 is free" and clean[12] is None


def test_pii_contexts_reach_unseen_forms(spark):
    rows = [(i, f"write to me at user{i}@mail.org today") for i in range(6)] + [(10, "write to me at user77[at]mail today"), (11, "be here at 12 today")]
    rows += [(20 + i, f"room {n} is free") for i, n in enumerate((12, 13, 14, 250))] + [(30, "the year 2001")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.id: [tuple(x) for x in r.extra] for r in pii.find_pii(docs).collect()}
    assert got.pop(10) == [("extra", 15, 29)] and not any(got.values())
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[10] == "write to me at [EXTRA] today" and clean[11] == "be here at 12 today"


def discovered_by_brute_force(rows, confidence=pii.CONFIDENCE):
    """Extra spans by the definition: graph of patterns and tokens, scored until the trusted patterns stay."""

    def shapes(token):
        out, i = "", 0
        for m in re.finditer(r"[0-9]+|[^0-9]+", token):
            n = len(m.group())
            out += "#" + str(next(x for x in (13, 8, 5, 4, 1) if n >= x)) if m.group()[0].isdigit() else m.group()
        return re.sub(r"[^\W\d_]+", "a", re.sub("[0-9]+", "9", token)), re.sub(r"[^\W\d_]+", "a", out)

    mentions, graph, seeds = [], collections.defaultdict(set), set()
    for i, text in rows:
        base, words = plain_spans(text or ""), [(m.group(), m.start(), m.end()) for m in re.finditer(r"\S+", text or "")]
        for j, (w, s, e) in enumerate(words):
            if re.search("[0-9@]", w):
                before, after = words[j - 1][0].lower() if j else "", words[j + 1][0].lower() if j + 1 < len(words) else ""
                seed = any(b < e and x > s for _, b, x in base)
                mentions.append((i, w, s, e, seed))
                names = [f"shape {before} {shapes(w)[0]}", f"before {before}", f"around {before} {after}"] if before else []
                for p in names + (["form long"] if len(w) >= pii.LONG and len(re.findall("[0-9]", w)) >= pii.DIGITS else []):
                    graph[p].add(w)
                    if seed:
                        seeds.add((p, w))
    score = {(p, w): float((p, w) in seeds) for p in graph for w in graph[p]}
    known = None
    while True:
        conf = {p: sum(score[p, w] for w in ws) / (len(ws) + 1) for p, ws in graph.items()}
        trusted = {p for p, ws in graph.items() if conf[p] >= confidence and sum(score[p, w] >= confidence for w in ws) >= pii.SUPPORT}
        if len(trusted) == known:
            break
        known = len(trusted)
        tokens = {w for ws in graph.values() for w in ws}
        reached = {w: [p for p in trusted if w in graph[p]] for w in tokens}
        total, met = collections.Counter(shapes(w)[1] for w in tokens), collections.Counter(shapes(w)[1] for w in tokens if reached[w])
        best = {w: max([conf[p] for p in ps if p.split(" ")[0] in ("shape", "form") or met[shapes(w)[1]] >= pii.FIT * total[shapes(w)[1]]], default=0.0) for w, ps in reached.items()}
        score = {(p, w): 1.0 if (p, w) in seeds else best[w] for p, w in score}
    good = {w for (p, w), x in score.items() if x >= confidence and (p, w) not in seeds}
    return {(i, s, e) for i, w, s, e, seed in mentions if w in good and not seed}


def test_pii_graph_is_the_defined_one(spark):
    rng = random.Random(11)
    made = {"mail": lambda i: f"u{i}@m.org", "ip": lambda i: f"10.0.{i % 250}.7", "key": lambda i: f"k{rng.randrange(10**15):015d}f", "id": lambda i: f"ID-{i}", "year": lambda i: str(1900 + i % 90)}
    rows = []
    for i in range(160):
        kind = rng.choice(["mail"] * 5 + ["ip", "ip", "key", "id", "year"])
        lead = rng.choice(["from", "at", "in", "Contact"]) if kind in ("mail", "id", "ip") else rng.choice(["in", "of", "since"])
        rows.append((i, f"{' '.join(rng.choice(['so', 'be', 'it']) for _ in range(3))} {lead}  {made[kind](i)} {rng.choice(['today', 'ok', made['year'](i)])}\n"))
    rows += [(500, None), (501, ""), (502, "\x01 at u1@m.org\x01"), (503, "at ID-5 in 1950 1951")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.id, x.start, x.end) for r in pii.find_pii(docs).collect() for x in r.extra}
    assert got and got == discovered_by_brute_force(rows)


def test_pii_redacts_many_mentions_in_one_text(spark):
    rng = random.Random(12)
    bits = ["u1@m.org", "é word", "10.0.0.1", "+1 (222) 333-4444", "4111 1111 1111 1111", "x" * 900, "4111111111111111@a.bc"]
    texts = [" ".join(rng.choice(bits) for _ in range(n)) for n in (3, 40, 9000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in pii.redact(docs, support=10**6).collect()}
    for i, t in enumerate(texts):
        out, at, spans = "", 0, []
        for s, e, k in sorted((s, e, k) for k, s, e in plain_spans(t)):
            if spans and s < spans[-1][1]:
                spans[-1][1] = max(e, spans[-1][1])
            else:
                spans.append([s, e, k])
        for s, e, k in spans:
            out, at = out + t[at:s] + f"[{k.upper()}]", e
        assert got[i] == out + t[at:]


def test_language(spark, empty):
    rng = random.Random(2)
    sounds = {"aa": ["ba", "ka", "lo"], "bb": ["zi", "xu", "qé"]}
    rows = [(i, " ".join("".join(rng.choice(sounds[k]) for _ in range(3)) for _ in range(rng.randint(3, 40))), k) for i, k in enumerate(["aa", "bb"] * 60)]
    rows += [(500, None, "aa"), (501, "123 !!", "aa"), (502, "ba ka", None), (None, "lo ba", "aa")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2
    got = {r.id: r for r in language.identify(docs, trainable=learn).collect()}
    held = [i for i, _, k in rows[:120] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i].lang_pred == rows[i][2] for i in held)
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[502].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(empty).count() == 0


def test_language_costs_are_the_frozen_code_lengths():
    import pyarrow as pa

    train = {"p": "abracadabra abra", "q": "banana bandana"}
    counts = []
    for k, t in train.items():
        b = b"\n\n\n" + t.encode()
        for g, n in collections.Counter(b[i - 3 : i + 1] for i in range(3, len(b))).items():
            counts.append((k, int.from_bytes(g, "big"), n))
    model = language.Model(pa.table([pa.array(x) for x in zip(*counts)], names=["lang", "gram", "n"]))
    text = "abandon cadab?z".encode()
    got = model.lengths(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]

    def bits(k):
        follow = [collections.defaultdict(collections.Counter) for _ in range(4)]
        b = b"\n\n\n" + train[k].encode()
        for i in range(3, len(b)):
            for o in range(4):
                follow[o][b[i - o : i]][b[i]] += 1
        total, t = 0.0, b"\n\n\n" + text
        for i in range(3, len(t)):
            cost = 0.0
            for o in (3, 2, 1, 0):
                seen = follow[o][t[i - o : i]]
                n, d = sum(seen.values()), len(seen)
                if n and seen[t[i]]:
                    cost -= np.log2(seen[t[i]] / (n + d))
                    break
                if n:
                    cost -= np.log2(d / (n + d))
            else:
                cost += 8
            total += cost
        return total

    assert got == pytest.approx([bits("p"), bits("q")], rel=1e-4)


def test_toxicity(spark, empty):
    rng = random.Random(4)
    bad = ["moronic", "idiotic", "scumbag"]
    rows, labels = [], []
    for i in range(240):
        w = passage(rng, 25).replace("w", "ve").split()
        if i % 4 == 0:
            w[rng.randint(0, 24)] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(900, "some i.d.i.o.t.i.c words"), (901, "m o r o n i c"), (902, ""), (903, None), (904, "plain words only")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id bigint, toxic int")
    got = {r.id: r.score for r in toxicity.score_toxicity(docs, labels, usable=F.col("rid") % 3 != 0).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in range(240))
    assert got[900] >= 0.7 and got[901] >= 0.7 and max(got[902], got[903], got[904]) < 0.7
    assert {r.score for r in toxicity.score_toxicity(docs, labels.filter("toxic = 0")).collect()} == {0.0}


def test_toxicity_in_long_and_glued_runs(spark):
    rng = random.Random(4)
    rows = [(i, passage(rng, 25).replace("w", "ve") + (" moronic" if i % 4 == 0 else "")) for i in range(240)]
    far = "plain veords only " * 6
    probes = {900: " ".join("youaremoronicreally"), 901: " ".join(far.replace(" ", "") + "moronic"), 902: far.replace(" ", "") + "moronic" + far.replace(" ", ""), 903: " ".join(far.replace(" ", "")), 904: far.replace(" ", "")}
    docs = spark.createDataFrame(rows + list(probes.items()), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id bigint, toxic int")
    got = {r.id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    assert min(got[900], got[901], got[902]) >= 0.7 and max(got[903], got[904]) < 0.7


def test_subsequence_kernel():
    def slow(a, b):
        def weights(w):
            x, out = [toxicity.LEAD, *toxicity.folded(w)], collections.Counter()
            for i in range(len(x)):
                for j in range(i + 1, len(x)):
                    for k in range(j + 1, min(len(x), i + toxicity.REACH + 1)):
                        out[x[i], x[j], x[k]] += toxicity.DECAY ** (k - i + 1)
            return out

        p, q = weights(a), weights(b)
        return sum(p[u] * q[u] for u in p) / np.sqrt(sum(v * v for v in p.values()) * sum(v * v for v in q.values()))

    for a, b in (("idiot", "idxiot"), ("loser", "looser"), ("clown", "town"), ("trash", "trash")):
        assert float(toxicity.profile(a) @ toxicity.profile(b)) == pytest.approx(slow(a, b), rel=1e-4)


def test_ann(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((12, 16))
    x = (base[rng.integers(0, 12, 600)] + 0.3 * rng.standard_normal((600, 16))).astype(np.float32)
    x[100:180] = x[100]  # one vector, eighty times
    rows = [(i, [float(v) for v in x[i]]) for i in range(600)] + [(700, None), (750, [0.0] * 16), (800, [float("nan")] * 16), (850, [1.0]), (900, [])]
    got = collections.defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("id") % 50 == 0).collect():
        got[r.query_id].append((r["rank"], r.id, r.score))
    assert set(got) == set(range(0, 600, 50))
    y = x.astype(float)
    u = y / np.linalg.norm(y, axis=1, keepdims=True)
    hits = 0
    for q, found in got.items():
        s = np.round(u @ u[q], 12)
        want = [i for i in sorted(range(600), key=lambda i: (-s[i], i)) if i != q][:5]
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        hits += len(set(want) & {f[1] for f in found})
        if q == 100:
            assert [f[1] for f in found] == [101, 102, 103, 104, 105]
        for _, i, score in found:
            assert score == pytest.approx(float(u[q] @ u[i]), abs=1e-12)
    assert hits / 60 >= 0.9


def test_ann_lengths_do_not_mix(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.standard_normal(3 if i % 2 else 5)], 1, "x") for i in range(40)] + [(100, [1.0], 0, ""), (100, [2.0, 1.0, 0.0], 0, ""), (150, None, 0, "")]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, t int, key string")
    got = collections.defaultdict(list)
    for r in ann.nearest(frame, F.col("id") % 10 == 0, probes=60).collect():
        got[r.query_id].append(r.id)
    even = set(range(0, 40, 2))
    assert set(got) == {0, 10, 20, 30}  # of id 100 the least vector counts, and no other has its length
    assert all(set(v) <= even - {q} for q, v in got.items())


def test_ann_visits_little_of_clustered_vectors():
    rng = np.random.default_rng(2)
    base = rng.standard_normal((200, 32))
    x = base[rng.integers(0, 200, 8000)] + 0.25 * rng.standard_normal((8000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    family, table = ann.Family(32, 5, 10, 1.0), ann.probe_table(10, 30)
    stored = family.keys(family.cells(x)[0])
    queries = np.arange(0, 8000, 50)
    keys = ann.probed_keys(family, table, x[queries])
    visited = found = 0
    for i, q in enumerate(queries):
        seen = np.unique(np.concatenate([np.flatnonzero(np.isin(stored[:, t], keys[:, i, t])) for t in range(5)]))
        visited += len(seen)
        near = np.argsort(-(x @ x[q]), kind="stable")
        found += len(set(near[near != q][:5].tolist()) & set(seen.tolist()))
    assert found / (5 * len(queries)) >= 0.9 and visited / (len(queries) * len(x)) < 0.1


def test_html(spark):
    menu = "<div>Start here to read all the news of the whole wide town today</div>"
    pages = [
        (1, "http://h.org/1", f"<html><head><title>T</title></head><body><nav>menu</nav><article><h1>A &amp; b</h1><p>One  <b>two</b><br>three<p>four</article><footer>f</footer></body></html>"),
        (2, "http://h.org/2", f"<body>{menu}<p>Only   here<script>if (a < b) x('</p>')</script></p><!-- c --><div class='side sidebar'>s</div><form>q</form></body>"),
        (3, "http://h.org/3", f"{menu}<p>Other text &copy; &bad; 1 < 2</p>"),
        (4, "http://other.org/", menu), (5, None, None), (6, "x", ""), (7, "http://h.org/7", "<main>m<div id=comments><article>c</article></div></main>"), (7, "http://h.org/7", "<main>m<div id=comments><article>c</article></div></main>"),
    ]
    df = spark.createDataFrame([(*p, 1, 2) for p in pages], "page_id bigint, url string, html string, key int, run int")
    got = bag((r.id, r.text) for r in html_text.main_text(df).collect())
    assert got == bag([(1, "A & b\nOne two three\nfour"), (2, "Only here"), (3, "Other text © &bad; 1 < 2"), (4, "Start here to read all the news of the whole wide town today"), (5, ""), (6, ""), (7, "m"), (7, "m")])


def test_html_repeats_in_articles_and_nested_cards(spark):
    rng = random.Random(8)
    note = "<p>Sign up here for the daily letter of our whole town desk</p>"
    own = [passage(rng, 60) for _ in range(5)]
    pages = [(i, f"http://h.org/{i}", f"<article><p>{t}</p>{note}</article><p>Top {i}</p>") for i, t in enumerate(own[:3])]
    pages += [(i, f"http://h.org/{i}", f"<nav>{i}</nav><article><p>{own[3]}</p>{note}</article>") for i in (10, 11)]
    card = "<article><p>Read this other story</p></article>"
    pages += [
        (20, "http://k.org/1", f"<main><p>{own[4]}</p>{card}</main>"), (21, "http://l.org/1", f"<div>{own[4]}</div>{card}"),
        (22, "http://m.org/1", f"<p>{own[4]}</p><aside>{card}</aside><div class='related'>{card}</div>"), (23, "http://n.org/1", f"<form><article>{own[4]}</article></form>"),
    ]
    got = {r.id: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert [got[i] for i in range(3)] == own[:3]
    assert got[10] == got[11] == own[3]
    assert got[20] == got[21] == own[4] + "\nRead this other story"
    assert got[22] == got[23] == own[4]


def test_html_broken_pages_take_linear_time():
    import time

    for make in (lambda n: "<a " * n, lambda n: "<b>" * n + "</i>" * n, lambda n: "<b>" * n + "<p></p>" * n, lambda n: '<a b="' * n + ">", lambda n: "<!-- c -->" * n, lambda n: "<p>" * n + "x" + "</p>" * n):
        began = time.perf_counter()
        html_text.blocks(make(60_000))
        assert time.perf_counter() - began < 8
    assert html_text.blocks('<p title=it\'s a="b>c">one<p x=">two</p>1 < 2 <3') == [("one", 0), ("two", 0), ("1 < 2 <3", 0)]
    assert html_text.blocks("<head><title>t<body>a<math><mi>x</mi></math><object>o</object>")[1:] == [("axo", 0)]


def test_html_repeats_decide_without_landmarks(spark):
    rng = random.Random(9)
    menus = {k: [passage(rng, 12) for _ in range(3)] for k in "abc"}
    own = [[passage(rng, 30) + "." for _ in range(4)] for _ in range(12)]
    pages = []
    for i, text in enumerate(own):
        top, side, foot = menus["abc"[i % 3]]
        pages.append((i, f"http://{'abc'[i % 3]}.org/{i}", f"<div>{top}</div><div>{side}</div>" + "".join(f"<p>{x}</p>" for x in text) + f"<div>{foot}</div>"))
    got = {r.id: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got == {i: "\n".join(x) for i, x in enumerate(own)}


def test_html_repeats_begin_at_every_token(spark):
    rng = random.Random(10)
    line = passage(rng, 25)
    own = [passage(rng, 30) for _ in range(40)]
    pages = [(i, f"http://h.org/{i}", f"<div>by {i} {i} {line} {i}</div><p>{t}</p>") for i, t in enumerate(own)]
    pages += [(100, "http://k.org/1", f"<div>{line}</div>"), *[(101, "http://l.org/1", f"<div>{line}</div>")] * 3]
    got = bag((r.id, r.text) for r in html_text.main_text(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect())
    assert got == bag([*enumerate(own), (100, line), *[(101, line)] * 3])


@pytest.mark.parametrize("parts, most", [(1, 1 << 21), (7, 1 << 21), (7, 50)])
def test_html_repeats_against_brute_force(spark, monkeypatch, parts, most):
    rng = random.Random(11)
    lines = [passage(rng, n) for n in (7, 8, 9, 14, 30)]
    pages = []
    for i in range(90):
        some = [f"{passage(rng, rng.randint(0, 4))} {rng.choice(lines)} {passage(rng, rng.randint(0, 6))}" if rng.random() < 0.6 else passage(rng, rng.randint(1, 40)) for _ in range(6)]
        tag = rng.choice(["div", "article", "main"])
        pages.append((i, f"http://{rng.choice('ab')}.org/{i}", f"<{tag}>" + "".join(f"<p>{x}</p>" for x in some[:4]) + f"</{tag}>" + "".join(f"<div>{x}</div>" for x in some[4:])))
    pages += [pages[0]] * 2 + [(200 + i, f"http://a.org/c{i}", pages[1][2]) for i in range(5)] + [(300, "", ""), (301, None, None)]
    found = [html_text.blocks(h or "") for _, _, h in pages]
    on, keys = collections.Counter(), collections.defaultdict(set)
    streams = [[t for x, _ in f for t in x.split()] for f in found]
    for page, tokens in zip(pages, streams):
        for w in {(html_text.host_of(page[1]), *tokens[s : s + 8]) for s in range(len(tokens) - 7)}:
            on[w] += 1
            keys[w].add(page)
    want = []
    for page, f, tokens in zip(pages, found, streams):
        count = np.zeros(len(tokens), np.int64)
        for s in range(len(tokens) - 7):
            w = (html_text.host_of(page[1]), *tokens[s : s + 8])
            if len(keys[w]) > 1:
                count[s : s + 8] = np.maximum(count[s : s + 8], on[w])
        off = np.cumsum([0, *(len(x.split()) for x, _ in f)])
        want.append((page[0], "\n".join(html_text.chosen(f, count, off)) if f else ""))
    monkeypatch.setattr(html_text, "DEAL", most)
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(parts)
    assert bag((r.id, r.text) for r in html_text.main_text(df).collect()) == bag(want)


@pytest.mark.parametrize("run", [substring_dedup, suffix_dedup, minhash.near_classes, pii.find_pii, pii.redact, mixing.mix])
def test_empty_tables(empty, run):
    assert run(empty).count() == 0


def test_empty_sides(spark, docs, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.decontaminate(docs, none).filter("size(spans) > 0").count() == 0
    assert decontaminate.decontaminate(empty, none, broadcast_bytes=-1).count() == 0
    assert ann.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), F.col("id") % 50 == 0).count() == 0
    assert html_text.main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    assert toxicity.score_toxicity(empty, spark.createDataFrame([], "doc_id bigint, toxic int")).count() == 0


def test_kernels():
    data = np.frombuffer("Ab cd\n ab  cd ab".encode(), np.uint8)
    s, e, off = kernels.word_bounds(data, np.array([0, 6, 16]), kernels.NOT_SPACE)
    assert [data[a:b].tobytes() for a, b in zip(s, e)] == [b"Ab", b"cd", b"ab", b"cd", b"ab"] and off.tolist() == [0, 2, 5]
    h = kernels.word_hashes(data, s, e)
    assert h[1] == h[3] and h[2] == h[4] and h[0] != h[2]
    assert phrases.runs(np.array([True, True, False, True]))[0].tolist() == [0, 3]
    x = np.array([5, 3, 9, 3, 8, 1, 7], np.uint64) * np.uint64(2) + np.uint64(1)
    for w in range(1, 8):
        want = sorted({i for j in range(len(x) - w + 1) for i in range(j, j + w) if x[i] == x[j : j + w].min()})
        assert kernels.minimisers(x, np.ones(len(x), bool), w).tolist() == want
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_scorers_on_long_texts_ties_repeated_rows_and_clashing_columns(spark):
    rng = random.Random(21)
    sounds = {"aa": ["ba", "ka", "lo"], "bb": ["zi", "xu", "qe"]}
    make = lambda k, n: " ".join("".join(rng.choice(sounds[k]) for _ in range(3)) for _ in range(n))
    rows = [(i, make("ab"[i % 2] * 2, 30), "ab"[i % 2] * 2, 1, "x", 0.5, 7) for i in range(80)]
    rows += [(200, make("aa", 40_000), None, 1, "x", 0.5, 7), (201, "é" * 300_000, None, 1, "x", 0.5, 7), (202, rows[0][1], "aa", 1, "x", 0.5, 7), (202, rows[0][1], "aa", 1, "x", 0.5, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, id int, carried string, score double, rid int")
    got = collections.defaultdict(list)
    for r in language.identify(docs, carry=("score", "carried")).collect():
        got[r.id].append((r.lang_pred, r.score, r.carried.score))
    assert got[200][0][0] == "aa" and len(got[201]) == 1 and len(got[202]) == 2 and got[202][0] == got[202][1] and got[0][0][2] == 0.5
    # two languages with the same counts cost the same: the first in order wins
    twins = docs.select("doc_id", "text", F.lit("cc").alias("lang")).union(docs.select("doc_id", "text", F.lit("bb").alias("lang")))
    assert {r.lang_pred for r in language.identify(twins).collect()} == {"bb"}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)] + [(1, 1, 0)], "doc_id bigint, toxic int, text int")
    scores = collections.defaultdict(list)
    for r in toxicity.score_toxicity(docs, labels).collect():
        scores[r.id].append(r.score)
    assert len(scores[202]) == 2 and scores[202][0] == scores[202][1] == scores[0][0] and len(scores[200]) == len(scores[201]) == 1
