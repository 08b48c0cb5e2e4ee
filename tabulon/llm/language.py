"""Language identification by prediction by partial matching (PPM).

Per language a variable-order byte context tree of up to three bytes holds
frozen counts.  A byte costs -log2 p bits: in the longest context that the
language has seen, n / (total + distinct) if the byte occurred there, else an
escape of distinct / (total + distinct) and the cost in the next shorter
context; below the empty context all 256 bytes are equally likely (escape
method C, no exclusions).  A text's language is the one with the shortest
code.  The score is the posterior that the code lengths give, tempered to the
length of ``TEMPER`` bytes.

As counts are frozen, a byte's cost depends on it and three bytes before it
alone, so whole texts are scored by table look-ups: bytes that no language has
seen share one symbol (they all cost the same), contexts that no language has seen
fall back to the row of their last two bytes or one.  The tables hold seen
contexts only, so their size is bounded by the sample's.

Training takes a sample of about ``sample_rows`` labelled rows a language
(a hash of the id against the language's row count), whole texts; executors
count, the driver gets counts only.

Defined results: null texts and texts without a letter are ``und`` with score
0; ties go to the first language in order; repeated rows each get a row;
without any training row everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

UNKNOWN = "und"
ORDER = 3
PAD = 0x0A
#: Rows a language to train on; the bound of the fitted sample.
SAMPLE_ROWS = 500
TEMPER = 64
#: Up to so many languages their shares are broadcast.
MOST_LANGS = 10_000


def padded(data: np.ndarray, offsets: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts with ORDER pads before each, and the place of every byte."""
    place = np.arange(len(data)) + ORDER * (np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) + 1)
    out = np.full(len(data) + ORDER * (len(offsets) - 1), pad, data.dtype)
    out[place] = data
    return out, place


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, n): four-byte grams, the first ones of a text led by pads."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        code = np.asarray(langs.indices)
        for lo, hi, data, offsets in K.chunks(batch.column("text")):
            if not len(data):
                continue
            wide, place = padded(data, offsets, PAD)
            wide = wide.astype(np.uint64)
            gram = (wide[place - 3] << np.uint64(24)) | (wide[place - 2] << np.uint64(16)) | (wide[place - 1] << np.uint64(8)) | wide[place]
            doc = np.repeat(np.arange(lo, hi), np.diff(offsets))
            key, n = np.unique((code[doc].astype(np.uint64) << np.uint64(32)) | gram, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array((key >> np.uint64(32)).astype(np.int64))), pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n.astype(np.int64))],
                ["lang", "gram", "n"],
            )


class Model:
    """Cost tables of all languages: symbol map, row of each context, bits by (row, symbol, language)."""

    def __init__(self, counts: pa.Table):
        coded = counts.column("lang").combine_chunks().dictionary_encode()
        self.langs = sorted(coded.dictionary.to_pylist())
        gram, n = counts.column("gram").to_numpy(), counts.column("n").to_numpy()
        lang = np.searchsorted(self.langs, coded.dictionary.to_pylist())[np.asarray(coded.indices)]
        parts = [(gram >> s) & 255 for s in (24, 16, 8, 0)]
        used = np.unique(np.concatenate([*parts, [PAD]]))
        self.symbol = np.zeros(256, np.uint8)
        self.symbol[used] = np.arange(1, len(used) + 1)
        a = self.size = len(used) + 1
        p3, p2, p1, p0 = (self.symbol[p].astype(np.int64) for p in parts)
        n_langs = len(self.langs)

        def costs(shape: tuple[int, ...], where: tuple[np.ndarray, ...], shorter: np.ndarray) -> np.ndarray:
            """Bits by (context.., symbol) of one language from its counts and the costs in the shorter context."""
            bits = np.asarray(np.broadcast_to(shorter, shape), np.float32).copy()
            total, kinds = np.zeros(shape[:-1]), np.zeros(shape[:-1])
            have, at = np.unique(np.ravel_multi_index(where[:-1], shape), return_inverse=True)
            have_n = np.bincount(at, where[-1])
            np.add.at(total.reshape(-1), have // shape[-1], have_n)
            np.add.at(kinds.reshape(-1), have // shape[-1], 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            bits += escape[..., None].astype(np.float32)
            whole = (total + kinds).reshape(-1)[have // shape[-1]]
            bits.reshape(-1)[have] = -np.log2(have_n / whole)
            return bits

        contexts, pairs = np.unique((p3 * a + p2) * a + p1), np.unique(p2 * a + p1)
        one, two, three = [], [], []
        for i in range(n_langs):
            own = lang == i
            x3, x2, x1, x0, m = p3[own], p2[own], p1[own], p0[own], n[own]
            c0 = costs((a,), (x0, m), np.full(a, 8.0))
            c1 = costs((a, a), (x1, x0, m), c0)
            c2 = costs((a, a, a), (x2, x1, x0, m), c1)
            row = np.searchsorted(contexts, (x3 * a + x2) * a + x1)
            last = contexts % (a * a)
            c3 = costs((len(contexts), a), (row, x0, m), c2.reshape(a * a, a)[last])
            one.append(c1)
            two.append(c2.reshape(a * a, a)[pairs])
            three.append(c3)
        # a row for each context that some language has seen; others cost what the next shorter one costs
        self.bits = np.concatenate([np.stack(x, -1) for x in (one, two, three)]).reshape(-1, n_langs)
        shorter = np.tile(np.arange(a, dtype=np.int32), a)
        shorter[pairs] = a + np.arange(len(pairs), dtype=np.int32)
        self.row = np.tile(shorter, a)
        self.row[contexts] = a + len(pairs) + np.arange(len(contexts), dtype=np.int32)

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of every text in every language."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        if not len(data):
            return out
        a = self.size
        wide, place = padded(self.symbol[data], offsets, int(self.symbol[PAD]))
        wide = wide.astype(np.int32)
        context = (wide[place - 3] * a + wide[place - 2]) * a + wide[place - 1]
        at = self.row[context] * np.int64(a) + wide[place]
        filled = np.flatnonzero(np.diff(offsets) > 0)
        out[filled] = np.add.reduceat(self.bits[at], offsets[filled], axis=0, dtype=np.float64)
        return out


def predictor(shared, text_col: str = "text"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.langs, UNKNOWN], object)
        for batch in batches:
            kept = [c for c in batch.schema.names if c not in ("lettered", "text")]
            letters = batch.column("lettered").to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in K.chunks(K.texts_in(batch, text_col), 1 << 18):
                bits = model.lengths(data, offsets)
                best = bits.argmin(1)
                n = np.maximum(np.diff(offsets), 1)[:, None]
                gap = (bits - bits.min(1, keepdims=True)) * np.minimum(1.0, TEMPER / n)
                score = 1.0 / np.exp2(-gap).sum(1)
                known = letters[lo:hi].astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in kept), pa.array(names[np.where(known, best, len(model.langs))], pa.string()), pa.array(np.where(known, score, 0.0))],
                    [*kept, "lang_pred", "score"],
                )

    return run


def train(docs: DataFrame, text_col: str, lang_col: str, key: Column, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.pmod(F.xxhash64(key), F.lit(1_000_000)).alias("draw")).filter("lang is not null and text is not null")
    share = rows.groupBy("lang").agg(F.ceil(F.lit(sample_rows) * 1_000_000 / F.count(F.lit(1))).alias("below"))
    if share.count() <= MOST_LANGS:  # a bounded side; the texts stay where they are
        share = F.broadcast(share)
    sample = rows.join(share, "lang").filter("draw < below").select("lang", "text")
    counts = sample.mapInArrow(gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    return Model(counts) if counts.num_rows else None


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    trainable: Column | None = None,
    carry: tuple[str, ...] = (),
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per input row: id, ``carry`` as a struct if any, lang_pred, score.

    ``trainable`` tells which rows may be learnt from (all by default).
    """
    usable = docs if trainable is None else docs.filter(trainable)
    model = train(usable, text_col, lang_col, F.col(id_col), sample_rows)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    columns = [F.col(id_col).cast("long").alias("id"), *([F.struct(*carry).alias("carried")] if carry else [])]
    rows = docs.select(*columns, text.rlike(r"\p{L}").alias("lettered"), text.alias("text"))
    if model is None:
        return rows.select(*rows.columns[:-2], F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    # a text among the carried columns travels once
    once = rows.drop("text") if text_col in carry and dict(docs.dtypes)[text_col] == "string" else rows
    return once.mapInArrow(predictor(shared, text_col), f"{fields}, lang_pred string, score double")
