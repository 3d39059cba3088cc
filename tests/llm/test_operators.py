"""Every operator against a plain version on texts with edges: null, empty, very long, repeated, clashing columns."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

from paperloom.llm import (chat, decontamination, language, mixing, ngram_jaccard, quality_rules, secrets, substring_dedup,
                           token_counts, toxicity)

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, spans string, n_words long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), -1, "x", -1) for i, t in brute.TEXTS]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, *names):
    return {r.doc_id: tuple(r[n] for n in names) for r in df.collect()}


def test_jaccard(docs, empty):
    got = rows(ngram_jaccard.join(docs), "n_shingles", "component_id", "n_links")
    assert got == brute.components(brute.TEXTS)
    assert ngram_jaccard.join(empty).count() == 0


def test_jaccard_repeated_rows(spark):
    data = [(5, brute.BASE), (5, brute.BASE), (None, brute.BASE), (9, "z"), (None, None)]
    got = ngram_jaccard.join(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert len(got) == 5
    assert sorted((r.doc_id or 0, r.component_id or 0, r.n_links) for r in got) == [(0, 0, 0), (0, 5, 2), (5, 5, 2), (5, 5, 2), (9, 9, 0)]


def test_jaccard_large_group_over_blocks(spark, monkeypatch):
    """Near copies in more than one block, linked only through each other."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 8)
    words = brute.BASE.split() * 3
    words = [f"{w}{k}" for k, w in enumerate(words)]
    texts = []
    for i in range(60):
        w = list(words)
        for k in range(i % 12):
            w[(i * 7 + k) % len(w)] = f"edit{i}x{k}"
        texts.append((i, " ".join(w)))
    got = rows(ngram_jaccard.join(spark.createDataFrame(texts, "doc_id long, text string")), "n_shingles", "component_id", "n_links")
    assert got == brute.components(texts)


def test_one_of_each(docs):
    kept = {r.doc_id for r in ngram_jaccard.one_of_each(docs).collect()}
    told = brute.components(brute.TEXTS)
    assert kept == {i for i, (_, c, _) in told.items() if i == c}


def test_suffix_dedup(docs, empty):
    got = rows(substring_dedup.dedup(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.substring_dedup(brute.TEXTS)
    assert substring_dedup.dedup(empty).count() == 0


def test_suffix_dedup_shared_ids(spark):
    data = [(1, brute.BASE), (1, brute.BASE), (None, brute.BASE), (2, brute.BASE + " " + brute.BASE)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.dedup(spark.createDataFrame(data, "doc_id long, text string")).collect())
    n = len(brute.BASE)
    assert got[:3] == [(0, 0), (1, n), (1, n)] and got[3][1] >= 2 * n


def test_suffix_dedup_long_text_in_pieces(spark, monkeypatch):
    from paperloom.llm import anchors

    monkeypatch.setattr(anchors, "PIECE", 1000)
    import random

    r = random.Random(5)
    a = "".join(r.choice("abcdef ") for _ in range(5000))
    b = a[700:2900] + "".join(r.choice("uvwxyz ") for _ in range(900)) + a[1500:4200]
    import numpy as np

    data = np.frombuffer(a.encode(), np.uint8)
    c = anchors.cover(data, np.array([0, len(data)]))
    assert c["count"].sum() == len(a) - 99 and sorted(c["start"].tolist()) == c["start"].tolist()
    texts = [(1, a), (2, b)]
    got = rows(substring_dedup.dedup(spark.createDataFrame(texts, "doc_id long, text string")), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.substring_dedup(texts)


def test_secrets(docs, empty):
    got = rows(secrets.report(docs), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    for i, t in brute.TEXTS:
        counts, listed = brute.secrets(t)
        assert got[i][:4] == counts
        assert set(filter(None, listed.split(","))) <= set(got[i][4].split(","))
    assert secrets.report(empty).count() == 0


def test_secrets_found_by_randomness(spark):
    import random
    import string

    r = random.Random(3)
    keys = ["".join(r.choice(string.ascii_letters + string.digits) for _ in range(40)) for _ in range(40)]
    data = [(i, f"here is the thing {k} and so on") for i, k in enumerate(keys)] + [(100 + i, "internationalization2 straightforwardness77 " * 3) for i in range(40)]
    got = rows(secrets.report(spark.createDataFrame(data, "doc_id long, text string")), "n_random", "spans")
    assert sum(got[i][0] for i in range(40)) >= 36
    assert all(got[100 + i][0] == 0 for i in range(40))
    assert got[0][1] in ("random:18:58", "")


def test_redact(docs):
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    got = rows(out, "text", "n_chars", "spans")
    assert got[16][0] == '[SECRET]" token: x [SECRET] [SECRET] AKIAX'
    assert got[16][1] == len(got[16][0]) and got[16][2] == "x"
    assert got[14][0] == "[SECRET]" and got[15][0] == "[SECRET]" + brute.BASE  # runs of hex digits
    assert {i: v[0] for i, v in got.items() if i not in (14, 15, 16)} == {i: t for i, t in brute.TEXTS if i not in (14, 15, 16)}


def test_many_matches_keep_their_places(spark):
    text = " ".join(f"é token={'k' * (8 + k % 5)}" for k in range(300))
    got = secrets.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.base_sha256 == brute.secrets(text)[0][3]


ITEMS = [(1, brute.BASE[:60]), (2, "lazy dog"), (3, None), (4, ""), (5, " ".join(brute.BASE.split()[8:30])), (5, "seven foxes dig"), (7, "中文 текст")]


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute.decontaminated(brute.TEXTS, ITEMS)
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(decontamination.report(docs, bench), *names) == want
    assert rows(decontamination.report(docs, bench, block_words=5), *names) == want
    assert decontamination.report(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontamination.report(docs, bench.limit(0)).collect())


def test_decontamination_clean(spark, docs):
    bench = spark.createDataFrame([(1, "over the lazy dog while nine silent owls watch from an old")], "item_id long, text string")
    got = rows(decontamination.clean(docs, bench), "text", "n_chars", "size")
    assert got[6][0] == "the quick brown fox jumps  oak tree" + brute.BASE.split("oak tree")[1]
    assert got[6][1] == len(got[6][0]) and got[1][0] is None and got[11][0] == brute.LONG


def test_decontamination_clean_is_the_same_in_blocks(spark):
    w = [f"w{k}" for k in range(40)]
    # b overlaps a, c follows a word on word elsewhere, and d lies on both sides of a.
    items = [("a", " ".join(w[:12])), ("b", " ".join(w[8:20])), ("c", " ".join(w[20:32])), ("d", "p q r s t u v x y z")]
    texts = ["Start, " + ", ".join(w[:22]) + " end", " ".join(w[:12] + w[20:32]) + ".", "p q r s t " + " ".join(w[:12]) + " u v x y z", "clean", None, "é " + " ".join(w[5:36])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    want = rows(decontamination.clean(docs, bench), "text", "n_chars")
    hit = {r.doc_id: (r.n_words, r.n_hit) for r in decontamination.report(docs, bench, block_words=12).collect()}
    for size in (5, 12, 24):
        assert rows(decontamination.clean(docs, bench, block_words=size), "text", "n_chars") == want
    assert want[0][0] == "Start, , w20, w21 end" and want[1][0] == "." and want[2][0] == "p q r s t  u v x y z"
    for i, (t, _) in want.items():
        assert len(brute.BENCH_WORD.findall(brute.lower(t or ""))) == hit[i][0] - hit[i][1]


def test_index_locates_every_occurrence():
    import numpy as np

    r = np.random.default_rng(1)
    number, doc = r.integers(0, 4, 3000), np.repeat(np.arange(30), 100)
    phrases = decontamination.Phrases([("a", np.array([1, 2, 3, 1], np.uint64)), ("b", np.array([3, 3], np.uint64)), ("c", np.array([1, 1, 2, 2, 3, 1, 1, 2, 3, 3, 1, 2], np.uint64))])
    place, which = decontamination.occurrences(number, doc, phrases)
    want = set()
    for w in range(len(phrases.length)):
        n = int(phrases.length[w])
        p = phrases.words[w, :n][::-1]
        want |= {(s, w) for s in range(len(number) - n + 1) if doc[s] == doc[s + n - 1] and (number[s : s + n] == p).all()}
    assert set(zip(place.tolist(), which.tolist())) == want and len(place) == len(want)


def test_quality(docs, empty):
    got = rows(quality_rules.report(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for i, t in brute.TEXTS:
        assert got[i][:6] == brute.quality(t), i
        assert not (got[i][5] and got[i][6])
    assert quality_rules.report(empty).count() == 0


def test_quality_clean_removes_lines(spark):
    good = "\n".join(" ".join(f"{w}{k}" for w in brute.BASE.split()) + "." for k in range(3))
    data = [(1, good + "\nHome | News | Sport | Login | Help\nAll rights reserved 2024\n" + good.split("\n")[0], 0), (2, "a | b | c | d | e\n" * 30 + good, 0)]
    got = {r.doc_id: (r.text, r.n_chars) for r in quality_rules.clean(spark.createDataFrame(data, "doc_id long, text string, n_chars long")).collect()}
    assert got == {1: (good, len(good))}


def test_quality_keeps_prose_that_mentions_notices(spark):
    base = " ".join(f"{w}{k}" for k in range(2) for w in brute.BASE.split())
    kept = [base + f" {m} " + base[::-1] for m in ("the copyright of songs", "a cookie jar", "people subscribe to it", "some javascript", "catalog in", "design up", "please log in")]
    # Words that only hold a notice's letters fail no short line either.
    kept += [base + "\nThe dialog in the catalog in question", base + "\nShe will redesign up to six"]
    lost = ["Copyright 2024", "We use cookies.", "Log in | Sign up", "Privacy policies", "Licensed under CC BY 4.0", "log in, sign up, subscribe, " * 12]
    data = list(enumerate(kept + [base + "\n" + n for n in lost]))
    got = {r.doc_id: r.text for r in quality_rules.clean(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {i: t if i < len(kept) else base for i, t in data}


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    words = {i: len(brute.WORD.findall(t or "")) for i, t in brute.TEXTS}
    assert len(got) == len(brute.TEXTS) and all(r.size == words[r.doc_id] and 0 <= r.taken <= 3 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    total = sum(words.values())
    sizes = {s: sum(r.size for r in rs) for s, rs in by.items()}
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    target, capped = {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        parts = sum(weight[s] for s in sizes if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else weight[s] * left / parts for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] >= 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s, rs in by.items():
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == sizes[s] for r in rs)
        assert abs(sum(r.taken for r in rs) - target[s]) <= 1
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    assert mixing.mix(empty).count() == 0


def test_taken_documents(docs):
    out = mixing.taken_documents(docs)
    assert out.columns == [*docs.columns, "mix_words", "mix_epochs", "mix_taken"]
    want = {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}
    assert {r.doc_id: r.mix_taken for r in out.collect()} == want


def test_heavier_documents_are_taken_more_often(spark):
    """The sampler's first draws favour weight: clean texts before texts of symbols."""
    data = [(i, "s", "word " * 20) for i in range(300)] + [(1000 + i, "s", "#$% " * 20) for i in range(300)] + [(5000 + i, "t", "x " * 400) for i in range(60)]
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, source string, text string"), cap=3, weights=(1, 5)).where("source = 's'").collect()
    clean, junk = (sum(r.taken for r in got if (r.doc_id < 1000) == side) for side in (True, False))
    assert clean > junk


def test_language(spark, empty):
    import random

    r = random.Random(2)
    stems = {"en": "the of and ing tion with that".split(), "de": "der und sch ein ung mit über".split(), "fr": "le les ment eau dans pour été".split()}
    data = []
    for i in range(400):
        lang = r.choice(list(stems))
        data.append((i, " ".join(r.choice(stems[lang]) + r.choice(stems[lang]) for _ in range(60)), lang if i % 5 else None, lang))
    data += [(900, None, "en", "und"), (901, "123 --- 😀", "en", "und"), (902, "", None, "und")]
    df = spark.createDataFrame([d[:3] for d in data], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {x.doc_id: x for x in language.identify(df, language.learn(df)).collect()}
    for i, _, _, want in data:
        assert got[i].lang_pred == want and 0 <= got[i].score <= 1
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert language.learn(empty) == {} and language.identify(empty, {}).count() == 0


def test_language_counts_long_texts_in_slices(monkeypatch):
    whole = language._counted(brute.LONG + " é " + brute.BASE)
    monkeypatch.setattr(language, "SLICE", 50)
    parts = language._counted(brute.LONG + " é " + brute.BASE)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_tokens(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in brute.TEXTS}
    assert rows(token_counts.count_tokens(docs, path), "n_bytes", "n_tokens") == want
    assert rows(token_counts.count_tokens(docs, path, table_size=3, cache_size=2), "n_bytes", "n_tokens") == want
    assert token_counts.count_tokens(empty, path).count() == 0


def test_toxicity(spark, empty):
    import random

    r = random.Random(4)
    plain = "river stone garden window morning paper yellow candle market bridge".split()
    bad = "idiotic scumbag loserish".split()
    data, labels = [], []
    for i in range(600):
        w = [r.choice(plain) + r.choice(plain) for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            for k in range(4):
                w[r.randrange(60)] = r.choice(bad)
        data.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    data += [(1000, " ".join(plain * 6) + " you idiotik scumbagg, loserish"), (1001, None), (1002, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    terms, weights = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {x.doc_id: x for x in toxicity.score(docs, terms, weights).collect()}
    assert all(got[i].predicted == t for i, t in labels)
    assert got[1000].predicted == 1 and got[1001].predicted == 0 and got[1002].score == got[1001].score
    none = toxicity.learn(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, *none).agg(F.max("score")).first()[0] < 0.01 and toxicity.score(empty, *none).count() == 0


def test_words_under_a_stem_are_found_misspelled(spark):
    forms = "idiotic idiotism idiotes idiotize".split()
    data = [(f"river stone garden {forms[i // 6 % 4] if i % 6 == 0 else 'paper'} window", int(i % 6 == 0)) for i in range(600)]
    terms = toxicity.learn_lexicon(spark.createDataFrame(data, "text string, toxic int"))
    trie = toxicity.Trie(terms)
    assert "idio*" in terms and [t for t in terms if t.endswith("*")] == ["idio*"]
    for w, want in (("idjotic", ("idiotic", 1)), ("ldiotism", ("idiotism", 1)), ("iidiotize", ("idiotize", 1)), ("idiotic", ("idio*", 0)), ("idiotically", ("idio*", 0))):
        assert trie.maybe(w) and trie.match(w) == want


def test_automaton_finds_one_edit():
    import itertools
    import string

    trie = toxicity.Trie({"moron": 1.0, "idiot": 2.0, "sch*": 1.0, "ass": 1.0})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
            row = new
        return row[-1]

    pool = {"moron", "mor0n", "moroon", "mron", "idiots", "idjot", "ass", "as", "asss", "school", "sch", "mirror", ""}
    for w, k, c in itertools.product(("moron", "idiot"), range(6), string.ascii_lowercase[:6]):
        pool |= {w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w[:k] + w[k + 1 :]}
    for w in pool:
        near = [(distance(w, t), t) for t in ("moron", "idiot") if distance(w, t) <= 1 and (distance(w, t) == 0 or len(w) >= 4)]
        near += [(0, "ass")] * (w == "ass") + [(0, "sch*")] * (w.startswith("sch") and len(w) > 3)
        assert trie.match(w) == ((min(near)[1], min(near)[0]) if near else None), w
        if near and w:
            assert trie.maybe(w)


def cheapest(roles):
    """Least cost over all legal ways, by trying every one."""
    best = [float("inf")]

    def go(k, state, cost):
        if k == len(roles):
            best[0] = min(best[0], cost + chat.final(state) / chat.UNIT / 100)
            return
        for c, to, _, _ in chat.choices(roles[k], state):
            go(k + 1, to, cost + c)

    go(0, chat.START, 0.0)
    return best[0]


def test_chat_least_cost():
    import itertools

    for n in range(1, 5):
        for roles in itertools.product(("system", "user", "assistant", None), repeat=n):
            path = chat.repaired([(r, k) for k, r in enumerate(roles)])
            cost = sum(c[0] for _, c in path) + chat.final(path[-1][1][1]) / chat.UNIT / 100
            assert abs(cost - cheapest(roles)) < 1e-9


def rendered(df):
    by = {}
    for r in df.collect():
        by.setdefault(r.conv_id, []).append((r.place, r.rendered, r.cost))
    return {k: ("".join(x[1] for x in sorted(v)), round(sum(x[2] for x in v), 6)) for k, v in by.items()}


def test_chat_repair(spark):
    data = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 1, "assistant", "hello"), (2, 0, "assistant", "first"), (2, 1, "user", None),
        (3, 0, "user", "a"), (3, 1, "user", "b"), (3, 2, "bot", "c <|im_end|>"), (4, 0, "system", "rules"), (None, None, None, "x"), (5, 0, "", ""),
    ]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("clash"))
    got = rendered(chat.repair(df))
    assert got[1][0] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n" and got[1][1] == 0
    assert got[3][0] == "<|im_start|>user\na\nb<|im_end|>\n<|im_start|>assistant\nc < |im_end|><|im_end|>\n"
    assert got[4][0].endswith("<|im_start|>user\n<|im_end|>\n")
    for text, _ in got.values():
        roles = re.findall(r"<\|im_start\|>(\w+)", text)
        state = chat.START
        for r in roles:
            assert chat.ROLES[r] in chat.LEGAL[state]
            state = chat.ROLES[r]
    assert chat.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_stretches_agree_with_one_pass(spark):
    import random

    r = random.Random(7)
    data = [(c, t, r.choice(("user", "assistant", "system", "x", None)), f"t{t}") for c in range(3) for t in range(90)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    whole, cut = rendered(chat.repair(df)), rendered(chat.repair(df, span=8))
    assert whole == cut  # texts too
    for text, _ in cut.values():
        state = chat.START
        for role in re.findall(r"<\|im_start\|>(\w+)", text):
            assert chat.ROLES[role] in chat.LEGAL[state]
            state = chat.ROLES[role]


def test_targets_of_more_words_than_an_int_holds(spark):
    sizes = spark.createDataFrame([("a", 10**9), ("b", 2 * 10**8), ("c", 9 * 10**8)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got == {"a": 3.75e8, "b": 6e8, "c": 1.125e9}


def test_quality_shouting_lines(spark):
    """Twenty letters, more than four fifths of them capitals; both bounds are exact."""
    lines = ["A" * 17 + "b" * 3, "A" * 16 + "b" * 4, "A" * 19, "A" * 20]
    df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    judged = quality_rules.judge(df).first()["_rules_lines"]
    assert [x.fails for x in judged] == [True, False, False, True]
