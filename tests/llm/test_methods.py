"""What the methods themselves decide, against plain versions: windows, batteries, draws, distances, verdicts, stretches."""

import collections
import math
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import chat, common, decontamination, language, mixing, ngram_jaccard, quality_rules, secrets, token_counts, toxicity

from . import brute


def frame(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns)


# Toxicity: the same terms, quoted and meant.
PLAIN = "river stone garden window morning paper yellow candle market bridge".split()


def quoted_and_meant(seed=4):
    r = random.Random(seed)
    data, labels = [], []
    for i in range(900):
        w = [r.choice(PLAIN) + r.choice(PLAIN) for _ in range(40)]
        bad = r.choice(("idiotic", "scumbag", "loserish"))
        if i % 6 == 0:
            w[10:10] = ["you", bad, "you", bad]
        elif i % 6 == 1 and i % 3:
            w[10:10] = [f'"{bad}"', "she", "said"]
        data.append((i, " ".join(w)))
        labels.append((i, int(i % 6 == 0)))
    return data, labels


def test_quotation_is_told_from_abuse(spark, monkeypatch):
    data, labels = quoted_and_meant()
    docs, known = frame(spark, data), frame(spark, labels, "doc_id long, toxic int")
    terms, weights = toxicity.learn(docs, known, least_odds=1.0)
    assert {"idiotic", "scumbag", "loserish"} & {t.rstrip("*") for t in terms} or any(t.endswith("*") for t in terms)
    probe = [(5000 + k, " ".join(PLAIN * 4) + " " + tail) for k, tail in enumerate(('and "scumbag" she said then', "and you scumbag are here", 'he wrote “idiotic” once', "you idiotic you"))]
    got = {x.doc_id: x.score for x in toxicity.score(frame(spark, probe), terms, weights).collect()}
    assert got[5000] < toxicity.THRESHOLD <= got[5001] and got[5002] < toxicity.THRESHOLD <= got[5003]
    # Without the window a quoted term counts like any other.
    monkeypatch.setattr(toxicity, "is_quoted", lambda around, k, hits: False)
    import pyarrow as pa

    x = toxicity.features(pa.array([probe[0][1]]), toxicity.Trie(terms), {})
    assert x[0, 0] > 0 and x[0, 4] == 0


def test_quotation_scores():
    says = lambda text, word, hits=1: toxicity.is_quoted(text.lower().split(), text.lower().split().index(word), hits)
    assert says('they called him "moron" once', '"moron"') and says("he said moron loudly", "moron")
    assert not says("you moron he said", "moron") and not says("moron", "moron") and not says("he said moron loudly", "moron", 2)
    assert says('"you moron" he said', "moron\"")


def plain_features(text, terms):
    """The counts of a text, by trying every term on every word."""

    def near(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
            row = new
        return row[-1]

    words = text.lower().split()
    found = {}
    for k, w in enumerate(words):
        w, best = w.strip(toxicity.MARKS), []
        for t in terms:
            if t.endswith("*"):
                best += [(0, t)] * (w.startswith(t[:-1]) and len(w) >= len(t))
            else:
                d = near(w, t)
                best += [(d, t)] * (d == 0 or (d == 1 and len(t) >= toxicity.FUZZY and len(w) >= toxicity.FUZZY - 1))
        if best:
            found[k] = min(best)
    out, seen = [0.0] * 7, set()
    for k, (d, t) in found.items():
        low, high = max(0, k - toxicity.WINDOW), min(len(words), k + toxicity.WINDOW + 1)
        around, hits = words[low:high], sum(low <= j < high for j in found)
        if toxicity.is_quoted(around, k - low, hits):
            out[4] += 1
            continue
        out[0] += terms[t]
        out[1] += 100 / len(words)
        out[3] += d
        out[5] += any(w.strip(toxicity.MARKS) in toxicity.ADDRESS for w in around) or hits > 1
        out[6] += t.endswith("*")
        seen.add(t)
    out[2] = len(seen)
    return np.log1p(out)


def test_features_against_a_plain_version():
    import pyarrow as pa

    r = random.Random(1)
    terms = {"moron": 2.0, "idiotic": 3.0, "scum*": 1.5, "ass": 1.0}
    pool = PLAIN + ["moron", "mor0n", "idiotik", "scumbag", "ass", "asses", '"moron"', "said", "you", "«idiotic»,", "scum"]
    texts = [" ".join(r.choice(pool) for _ in range(r.randrange(0, 40))) for _ in range(60)] + ["", None]
    got = toxicity.features(pa.array(texts, pa.string()), toxicity.Trie(terms), {})
    for row, t in zip(got, texts):
        assert np.allclose(row, plain_features(t or "", terms)), t


def test_ordinary_words_are_no_misspellings(spark):
    data = [(f"river {'morons' if i % 6 == 0 else 'morose' if i % 2 else 'garden'} {'morens' if i % 12 == 0 else 'maroons'} window", int(i % 6 == 0)) for i in range(600)]
    terms = toxicity.learn_lexicon(frame(spark, [*data, *[("more moronss here", 0)] * 30], "text string, toxic int"))
    trie = toxicity.Trie(terms)
    assert terms["morons"] > 0 and terms["moronss"] == 0 and not trie.maybe("moronss")
    assert trie.match("morans")[1] == 1 and trie.maybe("morans")


def test_toxicity_labels_with_gaps(spark):
    data, labels = quoted_and_meant(9)
    odd = [(*x, "e", "q") for x in data] + [(None, "x", "e", "q"), (data[0][0], data[0][1], "e", "q"), (7777, "word " * 50_000, "e", "q")]
    docs = frame(spark, odd, "doc_id long, text string, held_out string, score string")
    known = frame(spark, [*labels, (3, None), (None, 1), (6, 0), (5000, 7)], "doc_id long, toxic int")
    first = toxicity.learn(docs, known)
    again = toxicity.learn(docs.repartition(7), known.repartition(5))
    assert first[0] == again[0] and np.allclose(first[1], again[1])
    got = toxicity.score(docs, *first).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    one_sided = toxicity.learn(docs, frame(spark, [(i, 1) for i, _ in labels], "doc_id long, toxic int"))
    assert toxicity.score(docs, *one_sided).where("score < 0.5").count() == 0


# Secrets: the battery and the false-discovery rule.
def plain_test(found):
    """Length class and p-value bin of a candidate."""
    body = found.rstrip("=")
    enc = "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", body) else "base32" if re.fullmatch("[A-Z2-7]+", body) else "base64"
    if enc == "hex":
        v = [int(c, 16) * 4 for c in body]
    elif enc == "base32":
        v = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ234567".index(c) * 2 for c in body]
    else:
        v = [secrets.BASE64.index({"-": "+", "_": "/"}.get(c, c)) if c not in "=" else -1 for c in body]
    n = len(v)
    two = lambda z: 2 / (1 + math.exp(0.07056 * abs(z) ** 3 + 1.5976 * abs(z)))
    bins = collections.Counter(x // 8 for x in v)
    chi = sum((bins[b] - n / 8) ** 2 / (n / 8) for b in range(8))
    z = ((chi / 7) ** (1 / 3) - (1 - 2 / 63)) / math.sqrt(2 / 63)
    turns = sum((a >= 32) != (b >= 32) for a, b in zip(v, v[1:]))
    serial = sum((a - 31.5) * (b - 31.5) for a, b in zip(v, v[1:])) / (math.sqrt(n - 1) * (64 * 64 - 1) / 12)
    least = min(two(z) if z > 0 else 1.0, two((turns - (n - 1) / 2) / math.sqrt((n - 1) / 4)), two(serial))
    size = {"hex": 16, "base32": 32, "base64": 64}[enc]
    kind = lambda c: 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3
    width = lambda c: {2: 10.0, 3: 4.0}.get(kind(c), 6.0 if enc == "hex" else 26.0)
    ratio = sum(math.log10(width(b) / ((0.9 if kind(a) == kind(b) else 0.1 / 3) * size)) for a, b in zip(body, body[1:]))
    long = 2 if n >= 64 else 1 if n >= 32 else 0
    return long, 0 if least * 3 < secrets.BATTERY else max(0, min(secrets.MOST_BINS, math.floor(10 * ratio)))


def plain_discoveries(tests):
    """Benjamini and Hochberg's rule for each length class, over (key, class, bin)."""
    out = set()
    for long in {t[1] for t in tests}:
        mine = [t for t in tests if t[1] == long]
        limit = None
        for b in sorted({t[2] for t in mine if t[2] > 0}, reverse=True):
            if 10 ** (-b / 10) <= secrets.FDR * sum(t[2] >= b for t in mine) / len(mine):
                limit = b
        out |= {t[0] for t in mine if limit is not None and t[2] >= limit}
    return out


def test_random_spans_against_a_plain_version(spark):
    r = random.Random(8)
    words = ["internationalization2x", "straightforwardness77", "AAAAAAAAAAAAAAAAAAAAAAAA1", "abababababababababababab12", "user-name-of-the-year-2023", "0000000000aaaaaaaaaa1111111"]
    pick = {"b64": string.ascii_letters + string.digits + "+/", "b32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "HEX": "0123456789ABCDEF", "low": string.ascii_lowercase + "1"}
    keys = ["".join(r.choice(pick[k]) for _ in range(r.choice((20, 24, 33, 40, 64, 90)))) for k in ("b64", "b32", "HEX", "low") for _ in range(25)] + words * 4
    keys = [k for k in keys if re.fullmatch(secrets.CANDIDATE, k)]
    data = [(i, f"here is {k} to see") for i, k in enumerate(keys)]
    tests = [(i, *plain_test(k)) for i, k in enumerate(keys) if not brute.secrets(data[i][1])[1]]
    want = plain_discoveries(tests)
    got = {x.doc_id for x in secrets.report(frame(spark, data)).where("n_random > 0").collect()}
    assert got == want and 20 < len(want) < len(tests)
    # What the battery rejects is no discovery, however unlike ordinary text it is.
    assert not any(i in got for i, _, b in tests if b == 0)


def test_columns_with_the_operators_own_names(spark):
    clash = ("_secret", "_secret_all", "_SECRET_base", "_rules", "_rules_lines", "_rules_kept", "_mix_id", "mix_words", "mix_taken")
    rows = [(i, t, "s", *["x"] * len(clash)) for i, t in brute.TEXTS + [(6, brute.BASE), (16, brute.TEXTS[15][1])]]
    docs = frame(spark, rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in clash))
    for out in (secrets.redact(docs), quality_rules.clean(docs)):
        assert out.columns == docs.columns and {r[c] for r in out.collect() for c in clash} <= {"x"}
    assert secrets.redact(docs).count() == len(rows)
    out = mixing.taken_documents(docs)
    assert out.columns == [*[c for c in docs.columns if c not in mixing.TAKEN], *mixing.TAKEN]


# Quality: the verdict.
def plain_fails(text):
    """Lines with a word, in order, and whether each fails."""
    seen, out = set(), []
    notice = re.compile(quality_rules.BOILERPLATE.replace("(?iu)", "").replace(r"\p{L}", r"[^\W\d_]"), re.I)
    links = re.compile(quality_rules.NAVIGATION.replace("(?iu)", ""), re.I)
    for line in text.split("\n"):
        if not brute.WORD.search(line):
            continue
        n = len(re.split(r"[\x20\x09-\x0d]+", line.strip(" ")))
        symbols = len(re.findall(quality_rules.SYMBOLS, line))
        marks = len(line) - len(line.replace("!!", "!"))
        letters, upper = sum(c.isalpha() for c in line), sum(c.isupper() for c in line)
        left = [w for w in brute.WORD.findall(notice.sub(" ", line)) if any(c.isalnum() for c in w)]
        fails = (
            line in seen or (symbols >= 3 and symbols > 0.3 * n) or len(re.findall(quality_rules.BARS, line)) >= 3 or bool(links.match(line)) or (marks >= 3 and marks >= 0.3 * n)
            or len(re.findall(quality_rules.CODE, line)) > quality_rules.MOST_CODE * len(line) or (letters >= 20 and upper > 0.8 * letters)
            or (bool(notice.search(line)) and (n <= quality_rules.NOTICE_WORDS or 2 * len(left) <= n))
        )
        seen.add(line)
        out.append((line, fails))
    return out


JUNK = [
    "Home | News | Sport | Login | Help", "home » about us » contact", "Impressum", "Mentions légales", "Todos los derechos reservados 2024", "WE SHOUT AT YOU IN THIS LINE", "if (x[0] == {y: 1}) { z(); }",
    "# * $ % & | < >", "wow!! great!! now!! yes!!", "Startseite", "We use cookies on this site.", "Back to top", "",
]


def test_verdicts_against_a_plain_version(spark):
    r = random.Random(3)
    prose = lambda k: " ".join(f"{w}{r.randrange(99)}" for w in r.sample(brute.BASE.split(), 12)) + (". The catalog includes paper." if k % 3 else ", they share a cookie recipe over tea and go on to say much more about it than this line has room for, as lines do.")
    texts = []
    for k in range(80):
        lines = [prose(k) for _ in range(r.randrange(3, 8))] + [r.choice(JUNK) for _ in range(r.randrange(0, 14))]
        lines += lines[:1] * (k % 4 == 0)
        r.shuffle(lines)
        texts.append((k, "\n".join(lines)))
    texts += [(100, None), (101, ""), (0, texts[0][1])]
    got = {}
    for x in quality_rules.report(frame(spark, texts)).collect():
        got.setdefault(x.doc_id, set()).add(x.kept)
    cleaned = {x.doc_id: x.text for x in quality_rules.clean(frame(spark, texts)).collect()}
    for i, t in texts:
        judged = plain_fails(t or "")
        lost, whole = sum(len(x) * f for x, f in judged), sum(len(x) for x, _ in judged)
        want = not brute.quality(t)[5] and lost <= 0.5 * max(whole, 1)
        assert got[i] == {want}, t
        if want:
            assert [x for x in cleaned[i].split("\n") if brute.WORD.search(x)] == [x for x, f in judged if not f]
        else:
            assert i not in cleaned
    assert 10 < sum(v == {True} for v in got.values()) < 70


def test_clean_lines_stay(spark):
    base = " ".join(f"{w}{k}" for k in range(2) for w in brute.BASE.split())
    kept = ["The catalog includes paper.", "They share a cookie recipe.", "Analog input stage.", "See section (3) of it [a].", "NATO and the EU met in May.", "Next year we go home.", "C'est plus tard."]
    got = quality_rules.clean(frame(spark, [(i, base + "\n" + line) for i, line in enumerate(kept)])).collect()
    assert {r.doc_id: r.text for r in got} == {i: base + "\n" + line for i, line in enumerate(kept)}


# Mixing: the draw.
def test_draw_against_a_sort_by_key(spark, monkeypatch):
    r = random.Random(5)
    data = [(i, r.choice(("a", "b", "c", None)), "good line of words. " * r.randrange(1, 30) if i % 3 else "#$% ** 11 " * 9, "t") for i in range(400)] + [(7, "a", "twice", "t"), (7, "a", "twice", "t"), (None, "b", "no id", "t")]
    docs = frame(spark, data, "doc_id long, source string, text string, taken string")
    monkeypatch.setattr(mixing, "DOCS_A_RANGE", 3)
    got = mixing.mix(docs).collect()
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(8), F.col("doc_id"), F.length("text")), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = docs.select("doc_id", "source", F.size(F.split(F.trim("text"), " +")).alias("n"), (-F.log(uniform) / mixing.quality(F.col("text"))).alias("key")).collect()
    want = collections.Counter()
    for s in {x.source for x in got}:
        mine = [x for x in got if x.source == s]
        size, target = mine[0].source_size, mine[0].target
        assert size == sum(x.size for x in mine)
        epochs, rest = int(target // size), round(target) - int(target // size) * size
        for x in sorted((x for x in keyed if x.source == s), key=lambda x: (x.key, x.doc_id is not None, x.doc_id or 0, x.n)):
            part = max(0, min(x.n, rest))
            rest -= part
            want[s, x.doc_id, epochs * x.n + part] += 1
    assert collections.Counter((x.source, x.doc_id, x.taken) for x in got) == want


def test_sources_are_ranked_in_order(spark):
    names = [f"s{k:03d}" for k in range(200)] + ["Ä", "z", "é", "😀", "", None]
    sizes = frame(spark, [(n, 100 + k) for k, n in enumerate(names)], "source string, source_size long").repartition(5)
    got = {x.source: x.place for x in mixing.ranked(sizes).collect()}
    assert got == {n: k for k, n in enumerate(sorted(names, key=lambda n: (n is None, n)))}


def test_rows_that_share_everything_keep_the_target(spark):
    data = [(1, "a", "w " * 50, 0)] * 40 + [(2, "b", "v " * 10, 0)] * 90 + [(3, None, None, 0)]
    docs = frame(spark, data, "doc_id long, source string, text string, n int")
    mixed = mixing.mix(docs)
    want = collections.Counter(x.taken for x in mixed.where("taken > 0").collect())
    assert collections.Counter(x.mix_taken for x in mixing.taken_documents(docs).collect()) == want
    assert mixing.taken_documents(frame(spark, [], "doc_id long, source string, text string")).count() == 0


# Language: the distance.
def test_out_of_place_distance_against_a_plain_version(spark):
    r = random.Random(2)
    stems = {"en": "the of and ing tion with that".split(), "de": "der und sch ein ung mit über".split(), "fr": "le les ment eau dans pour été".split()}
    texts = [(i, " ".join(r.choice(stems[lang]) + r.choice(stems[r.choice(list(stems))]) for _ in range(r.randrange(1, 60))), lang) for i in range(150) for lang in [r.choice(list(stems))]]
    texts += [(900, None, "en"), (901, "123 -- 😀", "en"), (902, "Ünï 中文", None), (5, texts[5][1], "de"), (903, "word " * 300_000, None)]
    docs = frame(spark, texts, "doc_id long, text string, lang string")

    def grams(text):
        out = collections.Counter()
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            out.update(w)
            for n in (2, 3):
                p = f" {w} "
                out.update(p[k : k + n] for k in range(len(p) - n + 1))
        return out

    code = lambda g: sum(ord(c) << (21 * k) for k, c in enumerate(reversed(g)))
    profiles = language.learn(docs, profile_size=60)
    for lang in stems:
        total = collections.Counter()
        for i, t, known in texts:
            if known == lang and t is not None and brute.crc(i) % 4 != 2:
                total.update(grams(t))
        assert profiles[lang] == [code(g) for g in sorted(total, key=lambda g: (-total[g], code(g)))][:60]
    for x in language.identify(docs, profiles, doc_size=25).collect():
        text = next(t for i, t, _ in texts if i == x.doc_id)
        own = grams(text)
        top = [code(g) for g in sorted(own, key=lambda g: (-own[g], code(g)))][:25]
        if not top:
            assert x.lang_pred == "und" and x.score == 0
            continue
        apart = sorted((sum(abs(p.index(g) - k) if g in p else 60 for k, g in enumerate(top)), lang) for lang, p in profiles.items())
        assert x.lang_pred == apart[0][1] and abs(x.score - (apart[1][0] - apart[0][0]) / apart[1][0]) < 1e-9


# Tokens.
def test_frequent_pieces_and_tables(spark):
    data = [(i, "aa aa bb " + f"c{i}") for i in range(50)] + [(None, None)]
    assert token_counts.frequent(frame(spark, data), table_size=2) == ["aa", "bb"]
    import pyarrow as pa

    table = token_counts.Table(["x", "y"], [3, 4])
    assert table.get(pa.array(["y", "z", "x"])).tolist() == [4, -1, 3] and token_counts.Table([], []).get(pa.array(["a"])).tolist() == [-1]


def test_tokenizers_that_keep_white_space_are_refused(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.BPE({c: k for k, c in enumerate(pre_tokenizers.ByteLevel.alphabet())}, []))
    t.pre_tokenizer = pre_tokenizers.ByteLevel()
    t.save(f"{tmp_path}/keeps.json")
    with pytest.raises(ValueError):
        token_counts.count_tokens(frame(spark, [(1, "a")]), f"{tmp_path}/keeps.json")


def test_repeated_rows_are_counted_each(spark):
    import public_tokenizers

    docs = frame(spark, [(1, "some words here")] * 3 + [(None, None)] * 2)
    assert [tuple(r) for r in token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).orderBy("doc_id").collect()][2:] == [(1, 15, 3)] * 3
    assert secrets.report(docs).count() == quality_rules.report(docs).count() == 5


# Chat: stretches of rows without a number, and of one number.
def test_stretches_dont_change_the_result(spark):
    r = random.Random(6)
    data = [(1, None, r.choice(("user", "assistant", "x", None)), f"t{k}") for k in range(300)] + [(1, 5, "user", f"u{k}") for k in range(90)] + [(1, t, "assistant", "a") for t in range(30)]
    data += [(None, None, r.choice(("user", "bot")), None if k == 7 else f"n{k}") for k in range(60)] + [(2, 0, "user", "hi")] + [(3, t, r.choice(("user", "user", "system")), "same") for t in range(50)]
    df = frame(spark, data, "conv_id long, turn long, role string, text string")
    told = {}
    for span in (10, 16, 40, 4096):
        got = chat.repair(df, span=span).collect()
        told[span] = sorted(((x.conv_id or 0, x.place, x.turn, x.role_in, x.role, x.action, x.inserted, x.cost, x.rendered) for x in got), key=repr)
        assert len(got) == len(set(data))
    assert told[10] == told[16] == told[40] == told[4096]
    for c in (0, 1, 2, 3):
        mine = sorted((x for x in told[10] if x[0] == c), key=lambda x: x[1])
        assert [m[1] for m in mine] == list(range(len(mine)))
        plain = sorted({(t, x, s) for i, t, x, s in data if (i or 0) == c}, key=lambda m: (m[0] is not None, m[0] or 0, m[1] is None, m[1] or "", m[2] is None, m[2] or ""))
        path = chat.repaired([(x, chat.lots(t, x, s)) for t, x, s in plain])
        assert [(m[2], m[3], m[7]) for m in mine] == [(t, x, p[1][0]) for (t, x, _), p in zip(plain, path)]
        state = chat.START
        for role in re.findall(r"<\|im_start\|>(\w+)", "".join(m[8] for m in mine)):
            assert chat.ROLES[role] in chat.LEGAL[state]
            state = chat.ROLES[role]


def test_crowds_are_cut_by_role_and_text(spark):
    data = [(1, None, "user", f"t{k}") for k in range(200)] + [(1, 1, "user", "x")]
    df = frame(spark, data, "conv_id long, turn long, role string, text string").withColumn("part", F.floor(chat.number() / 16).cast("long"))
    crowds = df.groupBy("conv_id", "part", "turn").count().where("count > 16").drop("count")
    stretches = [sorted(x.text for x in rows) for rows in _grouped(chat._slots(df, crowds, 16).collect(), chat.STRETCH)]
    assert max(map(len, stretches)) <= 16 and sum(map(len, stretches)) == len(data)
    assert sum((s for s in stretches if s != ["x"]), []) == sorted(x[3] for x in data[:-1])


def _grouped(rows, by):
    import itertools

    key = lambda x: tuple(x[c] for c in by)
    return [list(g) for _, g in itertools.groupby(sorted(rows, key=key), key=key)]


# Lines and texts of any length.
def test_long_lines_of_links(spark):
    prose = " ".join(f"word{k} went to text{k}" for k in range(40)) + "."
    texts = [(1, "home " * 100_000), (2, "contact us | " * 100_000 + "\n" + prose), (3, "home" * 100_000), (4, prose + "\n" + "read more » " * 100_000 + "and words\n" + prose + " too")]
    got = {r.doc_id: r for r in quality_rules.report(frame(spark, texts)).collect()}
    assert {k: r.base_failed for k, r in got.items()} == {1: True, 2: True, 3: True, 4: True}
    short = [(1, "home | news\n" + prose + "\n" + prose.replace("word", "page").replace("text", "tail")), (2, "contact us » back to top\n" + prose), (3, "homes and news\n" + prose)]
    left = {r.doc_id: r.text.split("\n")[0][:5] for r in quality_rules.clean(frame(spark, short)).collect()}
    assert left == {1: "word0", 2: "word0", 3: "homes"}
    assert quality_rules.clean(frame(spark, texts)).count() == 0


def test_clean_keeps_columns_named_like_its_own_over_blocks(spark):
    item = " ".join(f"item{k}" for k in range(12))
    bench = frame(spark, [("a", item), ("b", item.replace("item", "other"))], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"before {item} behind", "mine")], "doc_id long, text string, _spans string")
    for words in (12, 1 << 20):
        assert [tuple(r) for r in decontamination.clean(docs, bench, words).collect()] == [(1, "before  behind", "mine")]


# Jaccard: blocks by shingles.
def test_blocks_weigh_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 4)
    monkeypatch.setattr(ngram_jaccard, "UNIT", 20)
    monkeypatch.setattr(ngram_jaccard, "SHARD_SHINGLES", 50)
    words = [f"{w}{k}" for k, w in enumerate(brute.BASE.split() * 3)]
    texts = [(i, " ".join([*words[: 60 + i % 3], *[f"e{i}"] * (i % 4)])) for i in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_jaccard.join(frame(spark, texts)).collect()}
    assert got == brute.components(texts)


# The shared folder.
def test_written_tables_are_cleared(spark):
    import os

    common.cut(frame(spark, [(1, "a")]))
    path = common._written[-1].removeprefix("file://")
    assert os.path.isdir(path)
    common.clear(spark)
    assert not os.path.isdir(path) and not common._written


def test_clusters_without_a_shared_folder_are_refused():
    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        common.shared_folder(Session)


def test_blocks_meet_only_where_sizes_allow_a_link(spark):
    """A component of 20 blocks on five levels of size: each block meets those of its own level and of the next ones."""
    r = random.Random(2)
    rows = [(k, 0, n, 1) for k, n in enumerate(10 * 2**level for level in range(5) for _ in range(4 * 1024))]
    rows += [(100_000 + k, 100_000, 50, 1) for k in range(30)]
    df = spark.createDataFrame(rows, "node long, component long, n long, weight long")
    got = ngram_jaccard.blocked(df, 3)
    blocks = {(x.part, x.block): set(x.others) for x in got.select("part", "block", "others").distinct().collect()}
    large = {b: o for (p, b), o in blocks.items() if p == 0}
    assert len(large) == 20 and all(b in o for b, o in large.items())
    assert all(b in large[c] for b, o in large.items() for c in o)  # both sides know of each other
    assert {len(o) for o in large.values()} == {4}  # levels a factor of two apart don't meet: 4 of 20
    assert len({x.part for x in got.where("cls >= 100000").collect()}) == 1
    sizes = {(x.part, x.block): [] for x in got.collect()}
    for x in got.join(df.withColumnRenamed("node", "cls"), "cls").collect():
        sizes[x.part, x.block].append(x.n)
    for a, o in large.items():
        for b in set(large) - o:
            assert max(sizes[0, a]) < 0.8 * min(sizes[0, b]) or max(sizes[0, b]) < 0.8 * min(sizes[0, a])
    near = spark.createDataFrame([(k, 0, 100 + k % 60, 1) for k in range(5000)], "node long, component long, n long, weight long")
    got = {x.block: (x.others, x.n) for x in ngram_jaccard.blocked(near, 1).groupBy("block").agg(F.first("others").alias("others"), F.count("*").alias("n")).collect()}
    assert len({b >> 32 for b in got}) == 3 and all(set(o) <= set(got) for o, _ in got.values())
