"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

Kernel: two words are compared by their common subsequences of three symbols
(each word led by a marker), every occurrence weighted by ``DECAY`` to the
length it spans, at most ``REACH`` + 1, so that inserted characters and gaps
lower the similarity but do not void it.  Punctuation inside a token is
skipped, and neighbouring one-letter tokens are read as one word ("i d i o t").
Such runs, and words of more than ``LONGEST`` symbols, score as the best of
their windows, at every place and of every length that a toxic landmark has.
The normalised similarity is squared; values under ``FLOOR`` count as 0, and so
does a word's whole row if it reaches ``FLOOR`` at no landmark that marks toxic texts.

Landmarks: words that mark toxic training texts, and the clean words most like
them.  A word's kernel row is mapped by the inverse root of the landmarks' own
kernel (Nystroem), and a linear SVM (squared hinge) is trained on it.  A
sentence scores as its best word and a text as its best sentence, so labels of
texts train the words: those of clean texts are negative, and of each toxic
text the word that scores highest is its positive witness, chosen anew a few
times.  A logistic curve fitted on the training texts turns margins to scores.

A word's margin depends on the word alone, so each worker keeps the margins of
the words it met (at most ``CACHE`` of them) and computes only new ones.  Words
are dropped early only by a bound that proves all their similarities to be
under the floor.

The fit uses about ``sample_rows`` labelled rows of either label at most; all
texts are scored whole.

Defined results: null, empty and wordless texts score as texts without any
similar word; without usable labels every score is 0; repeated rows each get a
row; of repeated labels the highest counts, null labels none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import discard, materialise

DECAY = 0.6
REACH = 4
FLOOR = 0.45
LANDMARKS = 96
#: Groups of like landmarks that bound similarities.
FAMILIES = 10
SAMPLE_ROWS = 3000
CACHE = 1 << 21
THRESHOLD = 0.7
SYMBOLS = 32
PAIRS = [(i, j) for j in range(2, REACH + 1) for i in range(1, j)]
#: Longer words are compared by windows.
LONGEST = 64

#: Symbols: letters 0-25, digits 26, bytes of other letters 27-30, 31 leads every word; 255 is skipped, 254 ends a word.
SKIP, SPACE, LEAD = 255, 254, 31
FOLD = np.full(256, SKIP, np.uint8)
FOLD[0x61:0x7B] = np.arange(26)
FOLD[0x41:0x5B] = np.arange(26)
FOLD[0x30:0x3A] = 26
FOLD[0x80:] = 27 + np.arange(128) % 4
FOLD[list(K.SPACE_BYTES)] = SPACE


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all words in a row, start and end of each word in it, the word offsets of each text, and which words are runs of one-letter tokens."""
    folded = FOLD[data]
    keep = folded != SKIP
    symbol = folded[keep]
    bounds = np.concatenate(([0], np.cumsum(keep)))[offsets]
    s, e, off = K.word_bounds(symbol, bounds, FOLD_INSIDE)
    edge = np.concatenate(([0], np.cumsum(e - s)))
    single = e - s == 1
    glue = np.zeros(len(s), bool)
    glue[1:] = single[1:] & single[:-1]
    glue[off[:-1][off[:-1] < len(s)]] = False
    first = np.flatnonzero(~glue)
    start = edge[:-1][first]
    return symbol[FOLD_INSIDE[symbol]], start, np.append(start[1:], edge[-1]), np.searchsorted(first, off), np.diff(np.append(first, len(s))) > 1


def windows(start: np.ndarray, end: np.ndarray, widths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, start, end) of all windows of the given widths over the words."""
    parts = []
    for w in widths:
        n = np.maximum(end - start - w + 1, 0)
        word = np.repeat(np.arange(len(start)), n)
        s = start[word] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        parts.append((word, s, s + w))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


FOLD_INSIDE = np.zeros(256, bool)
FOLD_INSIDE[:SPACE] = True


def led(letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The given words one after another, each led by the marker: symbols, starts, ends."""
    n = np.minimum(end - start, LONGEST)
    edge = np.concatenate(([0], np.cumsum(n + 1)))
    out = np.full(edge[-1], LEAD, np.uint8)
    word = np.repeat(np.arange(len(start)), n)
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[edge[word] + 1 + step] = letters[start[word] + step]
    return out, edge[:-1], edge[1:]


def triples(symbol: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(word, code, weight) of all subsequences of three symbols of adjoining words, one offset pair at a time."""
    word = np.repeat(np.arange(len(start)), end - start)
    left = end[word] - np.arange(len(symbol))
    x = symbol.astype(np.int32)
    for i, j in PAIRS:
        at = np.flatnonzero(left > j)
        yield word[at], (x[at] * SYMBOLS + x[at + i]) * SYMBOLS + x[at + j], DECAY ** (j + 1)


#: How words are spelt in statistics: a character for each symbol.
SPELT = b"abcdefghijklmnopqrstuvwxyz0^~|_"


def folded(word: str) -> np.ndarray:
    """Symbols of a word as statistics spell it."""
    back = np.full(256, 0, np.uint8)
    back[np.frombuffer(SPELT, np.uint8)] = np.arange(len(SPELT))
    return back[np.frombuffer(word.encode(), np.uint8)]


def profile(word: str) -> np.ndarray:
    """Dense weights of one word's subsequences, scaled to length 1."""
    letters = folded(word)
    out = np.zeros(SYMBOLS**3, np.float32)
    for _, code, weight in triples(*led(letters, np.array([0]), np.array([len(letters)]))):
        np.add.at(out, code, weight)
    size = np.sqrt((out**2).sum())
    return out / size if size else out


class Landmarks:
    """Profiles of the landmarks, the toxic ones first, and of their families.

    A family's profile is the largest weight that any member gives each
    subsequence, so a word's product with it bounds its product with every member.
    """

    def __init__(self, words: list[str], n_toxic: int):
        self.words = words
        #: Widths of the windows over glued and long words: those of the toxic landmarks.
        self.widths = sorted({min(len(w), LONGEST) for w in words[:n_toxic]})
        self.table = np.stack([profile(w) for w in words], 1)
        toxic = self.table[:, :n_toxic]
        self.n_toxic = n_toxic
        like = toxic.T @ toxic
        heads = [0]
        while len(heads) < min(FAMILIES, n_toxic):
            heads.append(int(like[:, heads].max(1).argmin()))
        family = like[:, heads].argmax(1)
        self.family = np.stack([toxic[:, family == g].max(1) for g in np.unique(family)], 1)

    def gram(self) -> np.ndarray:
        return squared(self.table.T.astype(np.float64) @ self.table)

    def rows(self, letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words with a similarity of FLOOR or more to some toxic landmark, and their kernel rows."""
        live = np.arange(len(start))
        for table in (self.family.max(1)[:, None], self.family):  # a coarse bound, then one for each family
            symbol, s, e = led(letters, start[live], end[live])
            bound, least = np.zeros((len(live), table.shape[1]), np.float32), np.zeros(len(live))
            for word, code, weight in triples(symbol, s, e):
                if len(word):
                    some = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                    bound[word[some]] += np.add.reduceat(table[code], some, axis=0) * np.float32(weight)
                    least[word[some]] += np.diff(np.append(some, len(word))) * weight * weight
            live = live[(least > 0) & (bound.max(1) >= (FLOOR - 1e-5) * np.sqrt(least))]
            if not len(live):
                return live, np.zeros((0, len(self.words)))
        symbol, s, e = led(letters, start[live], end[live])
        keys, weights = [], []
        for word, code, weight in triples(symbol, s, e):
            keys.append(word * SYMBOLS**3 + code)
            weights.append(np.full(len(word), weight))
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        value = np.bincount(back, np.concatenate(weights))
        word, code = key // SYMBOLS**3, key % SYMBOLS**3
        edge = np.searchsorted(word, np.arange(len(live)))
        size = np.sqrt(np.add.reduceat(value * value, edge))
        out = np.add.reduceat(self.table[code] * value[:, None].astype(np.float32), edge, axis=0) / size[:, None]
        some = (out[:, : self.n_toxic] >= FLOOR).any(1)
        return live[some], squared(out[some].astype(np.float64))


def squared(similarity: np.ndarray) -> np.ndarray:
    return np.where(similarity >= FLOOR, similarity, 0.0) ** 2


class Model:
    """Landmarks, their inverse root kernel, the SVM and the logistic curve."""

    def __init__(self, marks: Landmarks):
        self.marks = marks
        value, vector = np.linalg.eigh(marks.gram())
        self.root = vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T
        self.weight, self.bias, self.slope, self.shift = np.zeros(len(value)), 0.0, 1.0, 0.0
        self.known = np.zeros(0, np.uint64)
        self.margin = np.zeros(0, np.float32)

    def word_margins(self, letters: np.ndarray, start: np.ndarray, end: np.ndarray, glued: np.ndarray | None = None) -> np.ndarray:
        """Margins of the words; of glued and long ones the best of the word and its windows."""
        out = self.plain_margins(letters, start, end)
        wide = np.flatnonzero((end - start > LONGEST) | (glued if glued is not None else False))
        for lo in range(0, len(wide), 200):
            part = wide[lo : lo + 200]
            word, s, e = windows(start[part], end[part], self.marks.widths)
            if len(word):
                h, first, which = np.unique(K.Rolling(K.byte_values(0)[letters]).slices(s, e), return_index=True, return_inverse=True)
                np.maximum.at(out, part[word], self.plain_margins(letters, s[first], e[first])[which])
        return out

    def plain_margins(self, letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.full(len(start), self.bias)
        for lo in range(0, len(start), 20_000):
            part = slice(lo, lo + 20_000)
            live, rows = self.marks.rows(letters, start[part], end[part])
            out[lo + live] = rows @ (self.root @ self.weight) + self.bias
        return out

    def text_margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The best word's margin of every text."""
        letters, start, end, off, glued = words_of(data, offsets)
        best = np.full(len(offsets) - 1, self.bias)
        if not len(start):
            return best
        # a glued run is scored in another way than a word of the same letters
        h = K.Rolling(K.byte_values(0)[letters]).slices(start, end) ^ glued.astype(np.uint64)
        h, first, which = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, h), max(len(self.known) - 1, 0))
        old = self.known[at] == h if len(self.known) else np.zeros(len(h), bool)
        margin = np.empty(len(h), np.float32)
        margin[old] = self.margin[at[old]]
        fresh = np.flatnonzero(~old)
        margin[fresh] = self.word_margins(letters, start[first[fresh]], end[first[fresh]], glued[first[fresh]])
        if len(self.known) + len(fresh) > CACHE:
            self.known, self.margin = h, margin
        elif len(fresh):
            place = np.searchsorted(self.known, h[fresh])
            self.known = np.insert(self.known, place, h[fresh])
            self.margin = np.insert(self.margin, place, margin[fresh])
        full = np.flatnonzero(np.diff(off) > 0)
        best[full] = np.maximum.reduceat(margin[which], off[full])
        return np.maximum(best, self.bias)

    def scores(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50)))

    def fit(self, words: pd.DataFrame, witnesses: list[list[int]], n_clean: int, turns: int = 4, ridge: float = 3e-5) -> None:
        """words: word, t, c. witnesses: of each toxic text, the places of its words in ``words``."""
        live, mapped = self.mapped(words["word"])
        t, c = words["t"].to_numpy(float), words["c"].to_numpy(float)
        lead = np.log((t + 0.5) / (c + 0.5))
        share = t.sum() / max(c.sum(), 1)
        strong = (t + 0.5) / (c + 0.5) > 20 * share
        for turn in range(turns):
            # the best word of each toxic text, and all its words that already stand out
            chosen = np.bincount(np.array([max(w, key=lead.__getitem__) for w in witnesses if w], int), minlength=len(words)).astype(float)
            chosen = np.where(strong | (lead > 0.5) & (turn > 0), t, chosen)
            # words without any similarity share one row, so that all words count and few are held
            x, y, weight = [], [], []
            for sign, amount in ((1.0, chosen / max(chosen.sum(), 1)), (-1.0, c / n_clean)):
                own = np.flatnonzero(amount[live] > 0)
                x += [mapped[own], np.zeros((1, mapped.shape[1]))]
                weight += [amount[live][own], [amount.sum() - amount[live].sum()]]
                y.append(np.full(len(own) + 1, sign))
            self.weight, self.bias = squared_hinge(np.concatenate(x), np.concatenate(y), np.concatenate(weight), ridge)
            lead = np.full(len(t), self.bias)
            lead[live] += mapped @ self.weight

    def mapped(self, words: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """The words similar to some toxic landmark, and their rows in the Nystroem space."""
        live, rows = [np.zeros(0, np.int64)], [np.zeros((0, len(self.root)))]
        for lo in range(0, len(words), 20_000):
            parts = [folded(w) for w in words.iloc[lo : lo + 20_000]]
            size = np.array([len(x) for x in parts])
            end = np.cumsum(size)
            at, row = self.marks.rows(np.concatenate(parts), end - size, end)
            live.append(lo + at)
            rows.append(row @ self.root)
        return np.concatenate(live), np.concatenate(rows)


def squared_hinge(x: np.ndarray, y: np.ndarray, c: np.ndarray, ridge: float, steps: int = 30) -> tuple[np.ndarray, float]:
    """Newton steps on ridge |w|^2 / 2 + sum c max(0, 1 - y f)^2."""
    xx = np.concatenate([x, np.ones((len(x), 1))], 1)
    penalty = np.full(xx.shape[1], ridge)
    penalty[-1] = 1e-8
    w = np.zeros(xx.shape[1])
    for _ in range(steps):
        active = y * (xx @ w) < 1
        a, ca = xx[active], c[active]
        new = np.linalg.solve((a * ca[:, None]).T @ a + np.diag(penalty), (a * ca[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def logistic(f: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and shift of the curve that fits labels to margins, with smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([f, np.ones(len(f))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (target - p) - 1e-6 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-6), float(w[1])


def text_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, toxic, text) to (rid, toxic, word): the distinct words of each text, as statistics spell them."""
    alphabet = np.frombuffer(SPELT, np.uint8)
    for batch in batches:
        for lo, hi, data, offsets in K.chunks(batch.column("text")):
            letters, start, end, off, _ = words_of(data, offsets)
            spelt = alphabet[letters].tobytes().decode()
            ids, found = [], []
            for i in range(hi - lo):
                own = {spelt[a:b] for a, b in zip(start[off[i] : off[i + 1]].tolist(), end[off[i] : off[i + 1]].tolist(), strict=True)}
                found += own
                ids.append(len(own))
            row = pa.array(np.repeat(np.arange(lo, hi), ids))
            yield pa.RecordBatch.from_arrays([batch.column("rid").take(row), batch.column("toxic").take(row), pa.array(found, pa.string())], ["rid", "toxic", "word"])


def choose_landmarks(words: pd.DataFrame, n_toxic: int, n_clean: int, most: int = LANDMARKS) -> tuple[list[str], int]:
    """Words that mark toxic texts (three quarters at most), then clean words most like them; how many are the former."""
    t, c = words["t"].to_numpy(float), words["c"].to_numpy(float)
    rate_t, rate_c = (t + 0.5) / (n_toxic + 1), (c + 0.5) / (n_clean + 1)
    odds = np.log(rate_t / (1 - rate_t)) - np.log(rate_c / (1 - rate_c))
    z = odds / np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
    marked = np.flatnonzero((t >= 2) & (z > 2.5) & (rate_t > 4 * rate_c))
    marked = marked[np.lexsort((words["word"].to_numpy()[marked], -(t * odds)[marked]))][: most * 3 // 4]
    if not len(marked):
        return [], 0
    chosen = words["word"].iloc[marked].tolist()
    table = np.stack([profile(w) for w in chosen], 1)
    common = np.flatnonzero((c >= max(2, n_clean // 200)) & (rate_t < 2 * rate_c))
    names = words["word"].iloc[common].tolist()
    like = np.array([(profile(w) @ table).max() for w in names]) if names else np.zeros(0)
    return chosen + [names[i] for i in np.argsort(-like, kind="stable")[: most - len(chosen)] if like[i] < 0.95], len(chosen)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, usable: Column | None, sample_rows: int) -> Model | None:
    marked = labels.select(F.col(id_col).cast("long").alias("rid"), F.col(label_col).cast("int").alias("toxic")).filter("rid is not null and toxic in (0, 1)")
    if usable is not None:
        marked = marked.filter(usable)
    marked = marked.groupBy("rid").agg(F.max("toxic").alias("toxic"))
    count = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if not count.get(0) or not count.get(1):
        return None
    below = F.when(F.col("toxic") == 1, F.lit(sample_rows / count[1])).otherwise(F.lit(sample_rows / count[0])) * 1_000_000
    chosen = marked.filter(F.pmod(F.xxhash64("rid"), F.lit(1_000_000)) < below)
    # about 2 * sample_rows ids at most: a bounded side
    texts = docs.select(F.col(id_col).cast("long").alias("rid"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "rid")
    sample = materialise(texts.select("rid", "toxic", "text"), "labelled")
    held = materialise(sample.mapInArrow(text_words, "rid long, toxic int, word string"), "words")
    totals = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.countDistinct("rid").alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return None
    stats = held.distinct().groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    # the words of the bounded sample
    words = stats.filter("t >= 2 or c > 0").toArrow().to_pandas().sort_values("word", ignore_index=True)
    chosen_words, n_marked = choose_landmarks(words, totals[1], totals[0])
    if not chosen_words:
        return None
    # words that may witness: more frequent among toxic texts; a bounded list of words, of a bounded sample of texts
    share = (words["t"] + 0.5) / (words["c"] + 0.5) > (totals[1] / totals[0])
    place = {w: i for i, w in enumerate(words["word"]) if share[i] and words["t"][i] >= 2}
    near = docs.sparkSession.createDataFrame(list(place.items()) or [("", 0)], "word string, place int")
    toxic_rows = held.filter("toxic = 1").distinct().join(F.broadcast(near), "word").select("rid", "place").toArrow().to_pandas()
    witnesses: dict[int, list[int]] = {}
    for rid, at in zip(toxic_rows["rid"].tolist(), toxic_rows["place"].tolist(), strict=True):
        witnesses.setdefault(rid, []).append(at)
    model = Model(Landmarks(chosen_words, n_marked))
    model.fit(words, [witnesses[r] for r in sorted(witnesses)], totals[0])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    margins = sample.select("rid", "toxic", "text").mapInArrow(margins_of(shared, ["rid", "toxic"]), "rid long, toxic int, margin double").toArrow().to_pandas()
    shared.destroy()
    discard(sample, held)
    model.slope, model.shift = logistic(margins["margin"].to_numpy(), margins["toxic"].to_numpy(float))
    return model


def margins_of(shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo, hi, data, offsets in K.chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in keep), pa.array(model.text_margins(data, offsets))], [*keep, "margin"])

    return run


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    usable: Column | None = None,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per input row: id, score. ``usable`` (over ``rid``) tells which labels may be learnt from."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    model = train(docs, labels, id_col, text_col, label_col, usable, sample_rows)
    if model is None:
        return rows.select("id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = rows.mapInArrow(margins_of(shared, ["id"]), "id long, margin double")
    return scored.select("id", (1 / (1 + F.exp(-(F.col("margin") * model.slope + model.shift)))).alias("score"))
