"""Toxicity scores (operator 2).

A lexicon is learned from labelled rows: words, and stems that longer words begin with, that toxic documents hold far more
often than others (likelihood-ratio test). Every distinct word of a batch that shares half a term goes through a
Levenshtein automaton walked together with the lexicon's trie, so that misspelled terms count too; ordinary words an edit
away from a term, found in clean labelled texts, are no misspellings. Each hit is judged in a
window of words: quotation marks and words of reporting speak for quotation, second persons and further hits for abuse.
Quoted hits are counted apart and add nothing to the term weights; what they tell is left to the regression. A logistic regression over the counts gives the score.

Learned from at most about TRAIN_DOCS labelled rows, chosen by a hash of the id, never from held-out ones. What comes to
the driver is the lexicon (MOST_TERMS at most) and one short row of counts for each of those rows. Scoring is one map.

Nulls: a null text is empty and gets the score of a text without hits; a null label isn't learned from. Without labels of
both kinds every score is the share of toxic labels (0.0 without labels). Texts are read whole. Rows that repeat are each
scored; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import held_out, pieces, sampled

TRAIN_DOCS = 8000
MOST_TERMS = 2000
#: Least likelihood ratio (p about one in two million) and least number of toxic documents for a term.
LEAST_G, LEAST_DOCS = 25.0, 4
#: Least log odds: a shorter stem that clean texts hold too gives way to longer ones.
LEAST_ODDS = 3.0
STEMS = range(4, 9)
#: Words from this length on may differ from a term by one edit.
FUZZY = 5
WINDOW = 5
THRESHOLD = 0.3
BATCH_BYTES = 8 << 20

# Marks that open and close a quotation, words of reporting, and words of address.
OPENING = "\"'“«„‘‹"
CLOSING = "\"'”»“’›"
REPORTING = frozenset("said says saying quote quoted quotes wrote writes called sagte sagt schrieb zitat dit écrit citation dijo dice escribió cita".split())
ADDRESS = frozenset("you your yours you're ur u yourself du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes".split())
#: Marks around a word that aren't part of it.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”„«»‹›‘’‚…–—¡¿·•"


class Trie:
    """A lexicon as a trie; a term ends at a word's end, a stem wherever a longer word passes it."""

    def __init__(self, terms: dict[str, float]):
        """terms: weight by term; a stem ends in *. A word of weight 0 is an ordinary one: it is no misspelled term."""
        self.ordinary = {t for t, w in terms.items() if not w}
        self.terms = terms = {t: w for t, w in terms.items() if w}
        self.root: dict = {}
        for term in terms:
            node = self.root
            for c in term.rstrip("*"):
                node = node.setdefault(c, {})
            node["*" if term.endswith("*") else "$"] = term
        self.exact = {t for t in terms if not t.endswith("*")}
        self.stems: dict[int, set[str]] = {}
        self.heads: dict[int, dict[int, set[str]]] = {}
        self.tails: dict[int, dict[int, set[str]]] = {}
        for term in terms:
            if term.endswith("*"):
                self.stems.setdefault(len(term) - 1, set()).add(term[:-1])
            elif len(term) >= FUZZY:
                h = len(term) // 2
                for n in range(len(term) - 1, len(term) + 2):
                    self.heads.setdefault(n, {}).setdefault(h, set()).add(term[:h])
                    self.tails.setdefault(n, {}).setdefault(len(term) - h, set()).add(term[h:])

    def maybe(self, word: str) -> bool:
        """Whether a word can match: one within an edit of a term holds the term's first half at its start or its second
        half at its end."""
        n = len(word)
        if word in self.ordinary:
            return False
        if word in self.exact or any(n > k and word[:k] in s for k, s in self.stems.items()):
            return True
        heads = self.heads.get(n)
        return heads is not None and (any(word[:h] in s for h, s in heads.items()) or any(word[-k:] in s for k, s in self.tails[n].items()))

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its distance (0 or 1). The automaton's states are a place in the word and the edits so far;
        they move along the trie's edges, so only beginnings that some term shares are followed."""
        found: list[tuple[int, str]] = []
        n, fuzzy = len(word), len(word) >= FUZZY - 1
        stack = [(self.root, 0, 0)]
        while stack:
            node, at, edits = stack.pop()
            if at == n:
                term = node.get("$")
                if term is not None and (edits == 0 or len(term) >= FUZZY):
                    found.append((edits, term))
            elif edits == 0 and "*" in node:
                found.append((0, node["*"]))
            if at < n and (after := node.get(word[at])) is not None and word[at] not in "$*":
                stack.append((after, at + 1, edits))
            if edits == 0 and fuzzy:
                if at < n:
                    stack.append((node, at + 1, 1))  # a letter too many
                for c, after in node.items():
                    if c not in "$*":
                        stack.append((after, at, 1))  # a letter too few
                        if at < n and c != word[at]:
                            stack.append((after, at + 1, 1))  # another letter
        if not found:
            return None
        edits, term = min(found)
        return term, edits


FEATURES = ("weight", "rate", "distinct", "misspelled", "quoted", "abusive", "stems")


def is_quoted(around: list[str], k: int, hits: int) -> bool:
    """Whether the word at k of its window is quoted rather than meant. For quotation speak marks that open before it and
    close after it (2) and words of reporting (1); for abuse words of address (1) and further hits in the window (1)."""
    opened = any(w[:1] and w[0] in OPENING for w in around[: k + 1])
    closed = any(w.rstrip(".,;:!?")[-1:] and w.rstrip(".,;:!?")[-1] in CLOSING for w in around[k:])
    bare = [w.strip(MARKS) for w in around]
    quotation = 2 * (opened and closed) + any(w in REPORTING for w in bare)
    return quotation > any(w in ADDRESS for w in bare) + (hits > 1)


def features(column: pa.Array, trie: Trie, cache: dict) -> np.ndarray:
    """One row of counts for each text of an Arrow column. A quoted hit counts as such and for nothing else."""
    n = len(column)
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(column, "")))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat, many = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((n, len(FEATURES)))
    if not len(flat) or not trie.terms:
        return out
    coded = flat.dictionary_encode()
    found: dict[int, tuple[str, int]] = {}
    for k, word in enumerate(pc.utf8_trim(coded.dictionary, MARKS).to_pylist()):
        if trie.maybe(word):
            if word not in cache:
                if len(cache) > 200_000:
                    cache.clear()
                cache[word] = trie.match(word)
            if cache[word]:
                found[k] = cache[word]
    if not found:
        return out
    codes = coded.indices.to_numpy(zero_copy_only=False)
    is_hit = np.zeros(len(coded.dictionary), bool)
    is_hit[list(found)] = True
    hits = np.flatnonzero(is_hit[codes])
    ends = np.cumsum(many)
    doc = np.searchsorted(ends, hits, side="right")
    seen: dict[int, set[str]] = {}
    for at, d in zip(hits.tolist(), doc.tolist()):
        term, distance = found[int(codes[at])]
        begin, end = max(int(ends[d] - many[d]), at - WINDOW), min(int(ends[d]), at + WINDOW + 1)
        around = flat.slice(begin, end - begin).to_pylist()
        k = at - begin
        many_hits = int(is_hit[codes[begin:end]].sum())
        row = out[d]
        if is_quoted(around, k, many_hits):
            row[4] += 1
            continue
        row[0] += trie.terms[term]
        row[1] += 1
        row[3] += distance
        row[5] += any(w.strip(MARKS) in ADDRESS for w in around) or many_hits > 1
        row[6] += term.endswith("*")
        seen.setdefault(d, set()).add(term)
    for d, terms in seen.items():
        out[d, 2] = len(terms)
    out[:, 1] *= 100 / np.maximum(many, 1)
    return np.log1p(out)


def learn_lexicon(rows: DataFrame, most_terms: int = MOST_TERMS, least_odds: float = LEAST_ODDS) -> dict[str, float]:
    """Terms with their log odds, from rows(text, toxic): the `most_terms` that tell most. They come from a bounded sample,
    whose words bound them anyway. Ordinary words that a term's misspellings would take in have 0."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in pieces(batches, BATCH_BYTES):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = {w.strip(MARKS) for w in (text or "").lower().split()} - {""}
                terms = words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}
                for t in terms:
                    counts.setdefault(t, [0, 0])[toxic] += 1
        names = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[t][0] for t in names], pa.int64()), pa.array([counts[t][1] for t in names], pa.int64())], names=["term", "clean", "toxic"])

    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    if not clean or not toxic:
        return {}
    counted = rows.select("text", "toxic").mapInArrow(local, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    a, b = F.col("toxic"), F.col("clean")
    share = lambda x, m: F.when(x > 0, x * F.log(x * (clean + toxic) / ((a + b) * m))).otherwise(0.0)
    rest = lambda x, m: F.when(m - x > 0, (m - x) * F.log((m - x) * float(clean + toxic) / ((clean + toxic - a - b) * float(m)))).otherwise(0.0)
    g = 2 * (share(a, toxic) + share(b, clean) + rest(a, toxic) + rest(b, clean))
    odds = F.log(((a + 0.5) / (toxic + 1)) / ((b + 0.5) / (clean + 1)))
    # A word goes before a stem that says little more: words are also found with an edit.
    rank = F.col("g") * F.when(F.col("term").endswith("*"), 1.0).otherwise(1.15)
    top = counted.where(a >= LEAST_DOCS).select("term", g.alias("g"), odds.alias("odds")).where((F.col("g") >= LEAST_G) & (F.col("odds") >= least_odds)).orderBy(rank.desc(), "term").limit(most_terms)
    terms: dict[str, float] = {}
    for r in top.collect():
        name = r.term.rstrip("*")
        # A stem that is taken already counts for longer stems that begin with it. Words stay beside their stem: it finds
        # them as they are, their own entry finds them misspelled. match() gives one term, so a word is one hit.
        if not r.term.endswith("*") or not (any(name[:k] + "*" in terms for k in range(1, len(name) + 1)) or any(t.startswith(name) for t in terms)):
            terms[r.term] = float(r.odds)
    trie = Trie(terms)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w for w in batch.column(0).to_pylist() if trie.maybe(w) and (trie.match(w) or ("", 0))[1]]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], names=["term"])

    # Words that clean texts hold as often as toxic ones, and that lie within an edit of a term.
    ordinary = counted.where(~F.col("term").endswith("*") & (odds < 0)).select("term").mapInArrow(near, "term string")
    return terms | {r.term: 0.0 for r in ordinary.collect()}


def learn_weights(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the constant."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w)) * penalty
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _features(batches: Iterator[pa.RecordBatch], trie: Trie) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    cache: dict = {}
    for batch in pieces(batches, BATCH_BYTES):
        yield batch, features(batch.column(batch.schema.get_field_index("text")), trie, cache)


def learn(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, most_terms: int = MOST_TERMS, least_odds: float = LEAST_ODDS) -> tuple[dict[str, float], np.ndarray]:
    """The lexicon and the weights, from docs(doc_id, text) and labels(doc_id, toxic)."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    # A document with both labels is toxic.
    ids = sampled(known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")), train_docs, "toxic")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    # Copies would make the words of one text look like words of many: of texts that share their least shingle, one stays.
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")
    shingles = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 4, F.lit(0))), lambda k: F.xxhash64(F.slice(w, k + 1, F.lit(4))))
    shingle = F.transform(F.array(words), shingles)[0]  # the words are split once, not for each shingle
    rows = rows.withColumn("least", F.array_min(shingle)).groupBy("least", "toxic").agg(F.min(F.struct("doc_id", "text"))["text"].alias("text")).select("text", "toxic")
    rows = rows.cache()
    try:
        terms = learn_lexicon(rows, most_terms, least_odds)
        trie = Trie(terms)

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, x in _features(batches, trie):
                yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int64()), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["toxic", "x"])

        got = rows.mapInArrow(counted, "toxic long, x array<double>").collect()
    finally:
        rows.unpersist()
    if not got:
        return {}, np.array([0.0] * len(FEATURES) + [-30.0])
    # In order, so that sums come out the same however the rows were spread.
    told = np.array(sorted([*r.x, float(r.toxic)] for r in got))
    return terms, learn_weights(told[:, :-1], told[:, -1])


def score(docs: DataFrame, terms: dict[str, float], weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text)."""
    trie = Trie(terms)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _features(batches, trie):
            p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")
