"""Tokeniser fertility as a quality rule.

Each text is measured with a public vocabulary: characters per token, share of
byte-fallback tokens, and entropy of its tokens relative to the most that
so many tokens can have.  A language's band for each measure is
[q25 - 3 IQR, q75 + 3 IQR] over all its documents that pass the base rules
(the reach is never under ``REACH``), however few; texts outside a band are rejected.

Words are ``[^\\x20\\x09-\\x0D]+`` and tokens are those of the single words.  Rows:
null or word-free text has zero counts, no measures and fails the base rule;
a null language is one of its own; repeated rows are measured each.  An
empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.words import Words, mix, ranges, slices, span_hash
from citeweave.session import cut_lineage, ship_package

TOKENIZERS = "/opt/tokenizers"
FENCE = 3.0
MEASURES = ("chars_per_token", "byte_share", "token_entropy")

REACH = {"chars_per_token": 0.25, "byte_share": 0.05, "token_entropy": 0.05}

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_models: dict = {}


def _processor(model: bytes):
    if model not in _models:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        is_byte = np.array([sp.is_byte(i) for i in range(sp.vocab_size())])
        _models[model] = (sp, is_byte)
    return _models[model]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def base_counts(w: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n_docs, n = len(w.offsets) - 1, len(w.start)
    inside = np.zeros(len(w.data) + 1, dtype=np.int64)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.end, -1)
    inside = np.cumsum(inside)[:-1]
    lead = ((w.data & 0xC0) != 0x80).astype(np.int64)
    docs = np.repeat(np.arange(n_docs), np.diff(w.first))
    # words covered by 3-word windows that occur twice or more in their text
    covered = np.zeros(n, dtype=bool)
    if n >= 3:
        at = np.flatnonzero(docs[:-2] == docs[2:])
        grams, offs = w.shingles(3)
        grams = grams[np.repeat(np.diff(w.first) >= 3, np.diff(offs))]
        _, back, count = np.unique(mix(grams ^ mix(docs[at].astype(np.uint64))),
                                   return_inverse=True, return_counts=True)
        twice = at[count[back] >= 2]
        for j in range(3):
            covered[twice + j] = True
    # lines with a word that equal an earlier line of their text
    breaks = np.flatnonzero(w.data == 10)
    start = np.sort(np.concatenate([w.offsets[:-1], breaks + 1]))
    end = np.sort(np.concatenate([w.offsets[1:], breaks]))
    worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end = start[worded], end[worded]
    line_doc = np.searchsorted(w.offsets, start, side="right") - 1
    _, first = np.unique(mix(span_hash(w.data, start, end) ^ mix(line_doc.astype(np.uint64))),
                         return_index=True)
    lines = np.bincount(line_doc, minlength=n_docs) - np.bincount(line_doc[first], minlength=n_docs)
    return {"n_words": np.diff(w.first), "word_chars": _sums(lead * inside, w.offsets),
            "n_symbols": _sums(_SYMBOL[w.data], w.offsets), "n_dup_lines": lines,
            "n_repeat_words": _sums(covered.astype(np.int64), w.first)}


def token_measures(w: Words, model: bytes) -> dict[str, np.ndarray]:
    """n_tokens, n_byte_tokens, token_entropy (share of the most) of each text."""
    sp, is_byte = _processor(model)
    n_docs = len(w.offsets) - 1
    _, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
    raw = w.data.tobytes()
    kinds = [raw[s:e].decode("utf-8", "replace") for s, e in zip(w.start[at].tolist(), w.end[at].tolist())]
    coded = sp.encode(kinds, num_threads=1) if kinds else []
    size = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
    flat = np.fromiter(chain.from_iterable(coded), dtype=np.int64, count=int(size.sum()))
    many = size[back]
    ids = flat[ranges((np.cumsum(size) - size)[back], many)]
    doc = np.repeat(np.repeat(np.arange(n_docs), np.diff(w.first)), many)
    n = np.bincount(doc, minlength=n_docs)
    pairs, count = np.unique(doc * len(is_byte) + ids, return_counts=True)
    spread = np.bincount(pairs // len(is_byte), weights=count * np.log2(count), minlength=n_docs)
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = np.log2(n) - spread / n
        entropy = np.where(n > 1, bits / np.log2(n), np.where(n == 1, 1.0, np.nan))
    return {"n_tokens": n, "token_entropy": entropy,
            "n_byte_tokens": np.bincount(doc, weights=is_byte[ids], minlength=n_docs).astype(np.int64)}


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_byte_tokens")


def measured(documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id, lang, the base counts and the token measures of every text."""
    ship_package(documents.sparkSession)
    with open(model_path, "rb") as f:  # a vocabulary file of fixed size
        model = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                w = Words.of(part.column("text"), lower=False)
                got = {**base_counts(w), **token_measures(w, model.value)}
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("lang"),
                     *[pa.array(got[c].astype(np.int64)) for c in _COUNTS],
                     pa.array(got["token_entropy"], mask=np.isnan(got["token_entropy"]))],
                    names=["doc_id", "lang", *_COUNTS, "token_entropy"])
    schema = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", token_entropy double"
    return documents.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, schema)


def quality_rules(documents: DataFrame, model_path: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    """doc_id, lang, the counts, measures, base_failed and kept of every row."""
    tokens = F.when(F.col("n_tokens") > 0, F.col("n_tokens"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = cut_lineage(measured(documents, model_path)
                       .withColumns({"chars_per_token": F.col("word_chars") / tokens,
                                     "byte_share": F.col("n_byte_tokens") / tokens,
                                     "base_failed": failed}))
    good = rows.where("NOT base_failed")
    quartiles = lambda c: F.percentile_approx(c, [0.25, 0.75], 10_000).alias(f"q_{c}")
    bands = cut_lineage(good.groupBy(F.col("lang").alias("band_lang")).agg(*[quartiles(c) for c in MEASURES]))
    ok = F.lit(True)
    for c in MEASURES:
        low, high = F.get(f"q_{c}", 0), F.get(f"q_{c}", 1)
        reach = F.greatest(FENCE * (high - low), F.lit(REACH[c]))
        ok = ok & F.col(c).between(low - reach, high + reach)
    return (rows.join(bands, F.col("lang").eqNullSafe(F.col("band_lang")), "left")
            .withColumn("kept", F.coalesce(~F.col("base_failed") & ok, F.lit(False)))
            .select("doc_id", "lang", *_COUNTS, *MEASURES, "base_failed", "kept"))
