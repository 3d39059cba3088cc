"""The pipeline, stage by stage, against plain versions."""

import random
import re

import pytest

import corpus_pipeline
from paperloom.llm import decontamination

from . import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(11)
    words = [f"{a}{b}{c}" for a in ("ba", "ko", "ri", "ten") for b in ("lo", "ma", "su") for c in ("n", "r", "s", "t", "")]
    line = lambda n: " ".join(r.choice(words) + str(r.randrange(90)) for _ in range(n)) + "."
    texts, bench = [], [line(15) for _ in range(5)]
    for i in range(30):
        texts.append("\n".join(line(20) for _ in range(4)))
    texts += [texts[0], texts[1] + " end", texts[2] + "\n" + texts[2].split("\n")[0]]
    texts += [texts[3] + "\n" + bench[1] + "\ntoken = deadbeefdeadbeef99", "x | y | z | w | v\n" * 20 + line(60), line(5), None, ""]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), dict(enumerate(texts)), bench


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def cleaned(text):
    """The text without failing lines, or None if the document is rejected."""
    if brute.quality(text)[5]:
        return None
    seen, kept, lost, whole = set(), [], 0, 0
    for line in text.split("\n"):
        w = line.split()
        fails = bool(w) and (line in seen or line.count(" | ") >= 3 or (len(re.findall(r"[#*$%&|<>]", line)) >= 3 and len(re.findall(r"[#*$%&|<>]", line)) > 0.3 * len(w)))
        seen.add(line)
        lost += len(line) * fails
        whole += len(line) * bool(w)
        if not fails:
            kept.append(line)
    return "\n".join(kept) if lost <= 0.5 * whole else None


def test_stages(spark, corpus):
    d, texts, bench = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    want = {i: cleaned(t) for i, t in texts.items()}
    want = {i: t for i, t in want.items() if t is not None}
    assert 0 < len(want) < len(texts)
    docs = stages["quality_rules"](spark, docs, d).cache()
    assert docs.columns == COLUMNS and texts_of(docs) == want
    told = brute.components(sorted(want.items()))
    want = {i: t for i, t in want.items() if told[i][1] == i}
    docs = stages["ngram_jaccard_join"](spark, docs, d).cache()
    assert docs.columns == COLUMNS and texts_of(docs) == want and 30 not in want and 31 not in want
    items = list(enumerate(bench))
    hit = brute.decontaminated(sorted(want.items()), items)
    docs = stages["benchmark_decontamination"](spark, docs, d).cache()
    got = texts_of(docs)
    assert docs.columns == COLUMNS and set(got) == set(want)
    assert not any(v[4] for v in brute.decontaminated(sorted(got.items()), items).values())
    for i, t in want.items():
        left = len(brute.BENCH_WORD.findall(brute.lower(got[i])))
        assert (got[i] == t) if not hit[i][4] else left == hit[i][0] - hit[i][1]
    before = got
    docs = stages["secret_scans"](spark, docs, d).cache()
    got = texts_of(docs)
    assert docs.columns == COLUMNS and got == {i: re.sub("token = deadbeefdeadbeef99", "[SECRET]", t) for i, t in before.items()}
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    last = {r.doc_id: r for r in stages["mixing"](spark, docs, d).collect()}
    whole = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    assert whole == last and set(last) <= set(got)
    assert all(0 < r.mix_taken <= 3 * r.mix_words and r.text == got[i] for i, r in last.items())


def test_stage_names_and_oracle():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "mixing"]
    assert corpus_pipeline.ORACLE_SQL is None and decontamination.WINDOW == 10


def test_empty_tables(spark, corpus, tmp_path):
    d, _, _ = corpus
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    for name, documents, benchmark in (("a", docs.limit(0), bench.limit(0)), ("b", docs.limit(0), bench), ("c", docs, bench.limit(0))):
        documents.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        benchmark.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(got) == (name == "c") and all(r.text for r in got)


def test_a_long_line_of_links_costs_no_executor(spark, tmp_path):
    prose = " ".join(f"word{k} went to text{k}" for k in range(40)) + "."
    texts = [(1, "home " * 100_000 + "\n" + prose, "en", "s", 1), (2, prose + "\n" + "next » " * 5, "en", "s", 1)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [(r.doc_id, r.text) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] == [(2, prose)]
