"""Language identification by rank-order profiles (operator 9).

A language's profile is the list of its most frequent letter n-grams (1 to 3 letters, words padded with a space) in
order. A document's own list is compared with each profile by out-of-place distance: the difference of ranks, or the
profile's length where an n-gram is missing. The language at the least distance wins, the smaller name on a tie.

Profiles are learned from at most about `per_lang` labelled documents of each language, chosen by a hash of the id. Only
the profiles (profile_size n-grams for each language) come to the driver and are sent to the tasks.

Nulls: a null text, or one without letters, is `und` with score 0; a null label isn't learned from. With no labelled row
every text is `und`. Long texts are counted whole, in slices. Rows that repeat are each answered; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import held_out, pieces

PER_LANG = 1500
PROFILE_SIZE = 400
DOC_SIZE = 300
BATCH_BYTES = 2 << 20
#: A long text is counted in slices of so many letters, so that memory doesn't grow with it.
SLICE = 4 << 20
OUT = "doc_id long, held_out boolean, lang_pred string, score double"


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, with one space (32) for each run of anything but letters, and at both ends."""
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter(codes)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    return np.where(letter, codes, 32)[keep]


_known = np.zeros(0x110000, np.int8)


def _is_letter(codes: np.ndarray) -> np.ndarray:
    """str.isalpha for each code, remembered by code point."""
    got = _known[codes]
    if not got.all():
        for c in np.unique(codes[got == 0]):
            _known[c] = 2 if chr(c).isalpha() else 1
        got = _known[codes]
    return got == 2


def _grams(codes: np.ndarray) -> np.ndarray:
    """Keys of all n-grams of 1 to 3 code points that hold a letter; a space stands only at an end."""
    c = codes.astype(np.int64)
    one = c[c != 32]
    two = (c[:-1] << 21) | c[1:]
    mid = c[1:-1] != 32
    three = ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[mid]
    return np.concatenate((one, two, three))


def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text and how often each occurs."""
    codes = _letters(text)
    if len(codes) <= SLICE:
        return np.unique(_grams(codes), return_counts=True)
    # Neighbouring slices share two codes, less the n-grams that lie wholly inside what they share.
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for k in range(0, len(codes) - 2, SLICE):
        part = codes[k : k + SLICE + 2]
        k1, n1 = np.unique(_grams(part), return_counts=True)
        if k + SLICE + 2 < len(codes):
            k2, n2 = np.unique(_grams(part[-2:]), return_counts=True)
            n1[np.searchsorted(k1, k2)] -= n2
        both, at = np.unique(np.concatenate((keys, k1)), return_inverse=True)
        counts = np.bincount(at, np.concatenate((counts, n1)), len(both)).astype(np.int64)
        keys = both
    return keys[counts > 0], counts[counts > 0]


def learn(docs: DataFrame, per_lang: int = PER_LANG, profile_size: int = PROFILE_SIZE) -> dict[str, list[int]]:
    """Each language's most frequent n-grams, in order, from docs(doc_id, text, lang) that aren't held out."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    share = {r.lang: per_lang / r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not share:
        return {}
    limit = F.create_map(*[F.lit(x) for lang, s in share.items() for x in (lang, float(s))])[F.col("lang")]
    chosen = labelled.where(F.pmod(F.xxhash64(F.lit("profiles"), F.col("doc_id")), F.lit(1 << 30)) < limit * (1 << 30))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in pieces(batches, BATCH_BYTES):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums.setdefault(lang, []).append(_counted(text))
                if len(sums[lang]) > 200:
                    sums[lang] = [_added(sums[lang])]
        for lang, parts in sums.items():
            keys, counts = _added(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], names=["lang", "gram", "n"])

    counted = chosen.select("lang", "text").mapInArrow(local, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counted.withColumn("rank", rank).where(F.col("rank") <= profile_size).orderBy("lang", "rank").collect()
    profiles: dict[str, list[int]] = {}
    for r in top:
        profiles.setdefault(r.lang, []).append(r.gram)
    return profiles


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def identify(docs: DataFrame, profiles: dict[str, list[int]], doc_size: int = DOC_SIZE) -> DataFrame:
    """doc_id, held_out, lang_pred, score (how much farther the second language is, 0 to 1) for each row of docs."""
    langs = sorted(profiles)
    most = max((len(p) for p in profiles.values()), default=0)
    grams = np.unique(np.concatenate([np.asarray(p, np.int64) for p in profiles.values()])) if langs else np.zeros(0, np.int64)
    ranks = np.full((len(grams) + 1, len(langs)), -1, np.int32)
    for k, lang in enumerate(langs):
        ranks[np.searchsorted(grams, np.asarray(profiles[lang], np.int64)), k] = np.arange(len(profiles[lang]))

    def one(text: str | None) -> tuple[str, float]:
        if not text or not langs:
            return "und", 0.0
        keys, counts = _counted(text)
        real = keys != 32
        keys, counts = keys[real], counts[real]
        if not len(keys):
            return "und", 0.0
        if len(keys) > doc_size:
            edge = np.partition(counts, -doc_size)[-doc_size]
            top = np.flatnonzero(counts >= edge)
        else:
            top = np.arange(len(keys))
        top = top[np.argsort(-counts[top], kind="stable")][:doc_size]
        at = np.searchsorted(grams, keys[top])
        at[at == len(grams)] = 0
        at = np.where(grams[at] == keys[top], at, len(grams))
        theirs = ranks[at]
        apart = np.where(theirs < 0, most, np.abs(theirs - np.arange(len(top))[:, None])).sum(axis=0)
        order = np.argsort(apart, kind="stable")
        best = int(apart[order[0]])
        second = int(apart[order[1]]) if len(langs) > 1 else most * len(top)
        return langs[order[0]], float(min(1.0, max(0.0, (second - best) / second))) if second else 0.0

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, BATCH_BYTES):
            got = [one(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(answer, OUT)
