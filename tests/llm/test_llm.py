"""The training-data operators against brute force on small fixtures."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tideglass.llm import bpe, chunking, common, components, lm, media, mixing, ngram_join, quality, substring, toxicity, warc, wordpiece

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, keys string"


def words(rng, n, k=400):
    return [f"w{rng.randrange(k)}" for _ in range(n)]


def rows():
    """Documents with copies, near copies, shared passages, nulls, empty and long texts, repeated rows."""
    rng = random.Random(5)
    texts = [" ".join(words(rng, rng.choice([3, 12, 60, 200]), 5000)) for _ in range(60)]
    base = words(rng, 120, 5000)
    for i in range(8):
        near = list(base)
        near[rng.randrange(120)] = f"x{i}"
        texts.append(" ".join(near))
    passage = " ".join(words(rng, 70, 9000))
    for _ in range(6):
        texts.append(" ".join(words(rng, 90, 5000)) + " " + passage + "\n" + " ".join(words(rng, 80, 5000)))
    texts += [texts[0], texts[0], texts[3].upper(), "", None, "a", "é ü ñ 日本 語", "line one here\nline one here\n\nx y", " ".join(["one two three four five six"] * 9), "z" * 3000 + " " + " ".join(words(rng, 3000, 9000)), "a b c d"]
    out = [(i, t, ("en", "fr", None, "xx")[i % 4], ("s1", "s1", "s0", None)[i % 4], None, 7, "clash") for i, t in enumerate(texts)]
    return [*out, out[5], (None, "no id at all", "en", "s1", None, 1, "k"), (None, texts[0], None, None, None, 1, "k")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe(docs, none):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(RANKS, public_tokenizers.PATTERN).ranks, special_tokens={})
    encoded = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, with_ids=True)
    want = collections.Counter()
    for r in rows():
        ids = enc.encode_ordinary(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert collections.Counter(tuple(x)[:4] for x in encoded.collect()) == want
    back = collections.Counter((r.doc_id, r.text) for r in bpe.decode_documents(encoded, RANKS, public_tokenizers.PATTERN).collect())
    assert back == collections.Counter((r[0], r[1] or "") for r in rows())
    assert bpe.encode_documents(none, RANKS, public_tokenizers.PATTERN).count() == 0
    assert bpe.codec(RANKS, public_tokenizers.PATTERN).encode(["q" * 5000])[0] == np.array(enc.encode_ordinary("q" * 5000), "<u4").tobytes()


def test_bpe_merges_alike_on_matrix_and_heap():
    """The two ways of merging give the library's ids on random pieces of all lengths around the switch."""
    c = bpe.codec(RANKS, public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=c.ranks, special_tokens={})
    rng = random.Random(17)
    alphabets = ["ab", "aeinrst", "etaoinshrdlucmfw", " \n\t", "éàü日本", "0123456789"]
    pieces = ["".join(rng.choices(rng.choice(alphabets), k=rng.choice([2, 3, 7, 16, 17, 40, 200, bpe.LONG - 1, bpe.LONG, bpe.LONG + 1]))).encode() for _ in range(120)]
    want = [np.array(enc.encode_ordinary(p.decode()), "<u4").tobytes() for p in pieces]
    assert [c._heap(p) for p in pieces] == want
    assert c.encode_pieces(pieces) == want
    assert [c._matrix([p])[0] for p in pieces[:60]] == want[:60]


def test_wordpiece(docs, none):
    a = wordpiece.automaton(RANKS)
    with open(RANKS, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f]
    first, rest = {t[1:] for t in tokens if t[:1] == b" "} - {b""}, {t for t in tokens if t[:1] != b" "}

    def greedy(w, pieces, rest):
        n = 0
        while w:
            k = next((k for k in range(len(w), 0, -1) if w[:k] in pieces), 0)
            if not k:
                return None
            w, pieces, n = w[k:], rest, n + 1
        return n

    for r in rows():
        for w in (r[1] or "").encode().split():
            g = greedy(w, first, rest)
            assert a.count(w) == (wordpiece.UNKNOWN + 1 if g is None else g)
    rng = random.Random(1)
    for _ in range(200):  # vocabularies with unknown words
        f = {bytes(rng.choices(b"ab", k=rng.randint(1, 4))) for _ in range(4)}
        s = {bytes(rng.choices(b"abc", k=rng.randint(1, 4))) for _ in range(5)}
        auto = wordpiece.Automaton(f, s)
        for _ in range(40):
            w = bytes(rng.choices(b"abc", k=rng.randint(1, 9)))
            g = greedy(w, f, s)
            assert auto.count(w) == (wordpiece.UNKNOWN + 1 if g is None else g), (f, s, w)
    want = collections.Counter()
    for r in rows():
        found = [greedy(w, first, rest) for w in (r[1] or "").encode().split()]
        want[r[0], len((r[1] or "").encode()), len(found), sum(1 if g is None else g for g in found), sum(g is None for g in found)] += 1
    assert collections.Counter(tuple(x) for x in wordpiece.count_tokens(docs, RANKS).collect()) == want
    assert wordpiece.count_tokens(none, RANKS).count() == 0


def test_mix(spark, docs, none):
    import duckdb

    got = mixing.mix(docs).collect()
    assert len(got) == len(rows())
    sizes = collections.Counter()
    for r in rows():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    assert {(r.source, r.source_size) for r in got} == set(sizes.items())
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(1.5 * sum(sizes.values()))
    weight = {"s0": 3, "s1": 1, None: 2}
    targets = {r.source: r.target for r in got}
    free = {s: t / weight[s] for s, t in targets.items() if t < 2 * sizes[s]}
    assert len({round(x, 6) for x in free.values()}) <= 1
    for s in sizes:
        taken = sum(r.taken for r in got if r.source == s)
        assert abs(taken - targets[s]) <= max(r.size for r in got if r.source == s)
    assert all(r.taken <= 2 * r.size for r in got)
    assert collections.Counter(map(tuple, mixing.mix(docs.repartition(5)).collect())) == collections.Counter(map(tuple, got))
    unique = spark.createDataFrame([r for r in {r[0]: r for r in rows()}.values() if r[0] is not None], SCHEMA)
    documents = unique.toPandas()
    documents["text"] = documents["text"].where(documents["text"].notna(), None)
    con = duckdb.connect()
    con.register("documents", documents)
    key = lambda r: r[0]
    want = sorted(con.execute(mixing.oracle_sql()).fetchall(), key=key)
    assert sorted((tuple(r) for r in mixing.mix(unique).select("doc_id", "size", "source_size", "target", "taken").collect()), key=key) == want
    copies = {r.doc_id: r.copies for r in mixing.mix(unique).collect()}
    assert {r.doc_id: r["count"] for r in mixing.expand(unique, mixing.mix(unique)).groupBy("doc_id").count().collect()} == {k: v for k, v in copies.items() if v}
    assert mixing.mix(none).count() == 0


def test_expand_keeps_null_ids_and_repeated_rows(spark, docs):
    """Each row comes as often as its share of the mix, whatever its id."""
    again = docs.unionByName(spark.createDataFrame([rows()[7]] * 30 + [(None, "some words without an id", "en", "s0", 1, 1, "k")] * 5, SCHEMA))
    mixed = mixing.mix(again)
    got = collections.Counter((r.doc_id, r.source, r.text) for r in mixing.expand(again, mixed).collect())
    tie = {r.text: r.tie for r in again.selectExpr("text", "xxhash64(text) AS tie").collect()}
    want = collections.Counter()
    for r in mixed.collect():
        want[r.doc_id, r.source, r.tie] += r.copies
    assert {(i, s, tie[t]): n for (i, s, t), n in got.items()} == {k: n for k, n in want.items() if n}
    assert any(i is None for i, _, _ in got) and mixing.expand(again, mixed).columns == again.columns


def test_pipeline_takes_null_ids_and_repeated_rows(spark, tmp_path):
    import corpus_pipeline

    rs = [(i, f"own words {i} " + " ".join(words(random.Random(i), 40, 10**6)), "en", "s", 1) for i in (1, 2, 3, 3, 3, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    out = collections.Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, spark.createDataFrame(rs, schema), "").collect())
    copies = collections.Counter()
    for r in mixing.mix(spark.createDataFrame(rs, schema)).collect():
        copies[r.doc_id] += r.copies
    assert out == copies and out[None] > 0 and out[3] <= 6


def test_quality(docs, none):
    def base(text):
        w = WORD.findall(text or "")
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)

    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(docs).collect())
    want = collections.Counter()
    for r in rows():
        b = base(r[1])
        want[r[0], *b, b[0] < 10 or 100 * b[4] > 20 * b[0]] += 1
    assert got == want
    assert all(not (r.base_failed and r.kept) for r in quality.judge(docs).collect())
    assert quality.judge(none).count() == 0


def quality_truth(rs):
    """Both distances and the verdict of (id, text, lang) rows, from dictionaries."""
    import regex

    classes = [regex.compile(c) for c in quality.CLASSES]
    own = {}
    for k, (_, text, lang) in enumerate(rs):
        text, lang = text or "", lang if lang in quality.COMMON_WORDS else ""
        w = WORD.findall(text)
        chars = [len(c.findall(text)) for c in classes]
        listed = quality.COMMON_WORDS[lang or "en"]
        counts = collections.Counter(x.lower() for x in w)
        words_ = [counts[x] for x in listed]
        windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        own[k] = lang, w, [*chars, len(text) - sum(chars)], words_, covered, len(text)

    def jsd(p, q):
        p, q = [x / (sum(p) or 1) for x in p], [x / (sum(q) or 1) for x in q]
        kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b, strict=True) if x > 0)
        m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
        return math.sqrt(max(0.0, (kl(p, m) + kl(q, m)) / 2))

    out = []
    for k, (i, _, _) in enumerate(rs):
        lang, w, chars, words_, covered, n = own[k]
        same = [o for o in own.values() if o[0] == lang or not lang]
        class_distance = jsd(chars, [sum(o[2][j] for o in same) for j in range(len(chars))]) if n >= quality.LEAST_CHARS else None
        word_distance, few = None, False
        if len(w) >= quality.LEAST_WORDS and lang:
            reference = [sum(o[3][j] for o in same) for j in range(20)]
            if sum(words_) >= quality.LEAST_COMMON:
                word_distance = jsd(words_, reference)
            few = sum(words_) < quality.LEAST_COMMON_SHARE * len(w) * sum(reference) / sum(len(o[1]) for o in same)
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        odd = (class_distance or 0) > quality.MOST_CLASS_DISTANCE or (word_distance or 0) > quality.MOST_WORD_DISTANCE or few
        out.append((i, failed, not failed and not odd, class_distance, word_distance))
    return out


def test_quality_distances_and_verdicts(spark):
    rng = random.Random(41)

    def text(lang, n, share=0.25):
        return " ".join(rng.choice(quality.COMMON_WORDS[lang]).title() if rng.random() < share else "".join(rng.choices("etaoinshrdluÉñß", k=rng.randint(2, 9))) + rng.choice(["", "", ".", ",", "7", " €"]) for _ in range(n))

    rs = [(i, text(rng.choice(list(quality.COMMON_WORDS)), rng.choice([30, 80, 300])), rng.choice(list(quality.COMMON_WORDS))) for i in range(40)]
    rs = [(i, t, next(iter(quality.COMMON_WORDS)) if i % 3 else lang) for i, t, lang in rs]
    rs += [(50, text("en", 90) + " " + "% $ # " * 400, "en"), (51, text("de", 200), "xx"), (52, text("fr", 200), None), (53, None, "en"), (54, "", None), (55, "one two three four five " * 30, "en"), (56, text("en", 200, 0.0), "en"), (57, "by " * 100 + text("en", 200, 0.0), "en"), (None, text("es", 100), "es"), (58, "a b c d e a b c d x a b c d e y z u v w q r s t", "en")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rs, "doc_id long, text string, lang string").repartition(3)).collect()}
    want = quality_truth(rs)
    assert len(got) == len(want)
    for i, failed, kept, class_distance, word_distance in want:
        assert (got[i].base_failed, got[i].kept) == (failed, kept), i
        assert got[i].class_distance == (None if class_distance is None else pytest.approx(class_distance, abs=1e-7))
        assert got[i].word_distance == (None if word_distance is None else pytest.approx(word_distance, abs=1e-7))
    assert {x for _, _, x, _, _ in want} == {True, False} and sum(w is not None for *_, w in want) > 5


def test_quality_finds_odd_histograms(spark):
    rng = random.Random(2)
    clean = [(i, " ".join(rng.choice(["the", "of", "and", "anding", "theory", "to", "instance", "rewhing."]) + rng.choice(["", "x", "yz"]) for _ in range(300)), "en") for i in range(40)]
    junk = (99, " ".join(f"{w}%%% $$$" for w in clean[0][1].split()), "en")
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame([*clean, junk], "doc_id long, text string, lang string")).collect()}
    assert not kept.pop(99) and all(kept.values())


def test_quality_finds_texts_without_common_words(spark):
    """Word salad, texts in another language and texts made of one common word fail; characters alone look normal."""
    rng = random.Random(7)

    def text(lang, n=300):
        return " ".join(rng.choice(quality.COMMON_WORDS[lang]) if rng.random() < 0.22 else "".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 9))) for _ in range(n))

    clean = [(i, text("en", rng.choice([60, 100, 300])), "en") for i in range(40)] + [(50 + i, text("de"), "de") for i in range(10)]
    salad = "".join(c if c == " " else rng.choice("etaoinshrdlu") for c in text("en"))
    odd = [(90, salad, "en"), (91, text("de"), "en"), (92, " ".join("by" if rng.random() < 0.22 else "".join(rng.choices("etaoinshrdlu", k=5)) for _ in range(300)), "en")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame([*clean, *odd], "doc_id long, text string, lang string")).collect()}
    assert all(r.class_distance is None or r.class_distance <= quality.MOST_CLASS_DISTANCE for r in got.values())
    assert [i for i in got if not got[i].kept and not got[i].base_failed] and {i for i in got if not got[i].kept} == {90, 91, 92}


def link_truth(rs):
    sets = []
    for r in rs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rs):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return collections.Counter((r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rs))


def test_ngram_join(docs, none, monkeypatch):
    got = collections.Counter(tuple(r) for r in ngram_join.link_documents(docs).collect())
    assert got == link_truth(rows())
    assert ngram_join.link_documents(none).count() == 0


@pytest.mark.parametrize("spread", [1, 12])
def test_ngram_join_at_the_threshold(spark, monkeypatch, spread):
    """Many texts about as alike as the threshold, that share frequent passages."""
    monkeypatch.setattr(ngram_join, "SPREAD", spread)
    rng = random.Random(9)
    passages = [words(rng, 12, 10**6) for _ in range(3)]
    bases = [words(rng, rng.choice([8, 20, 45]), 10**6) for _ in range(4)]
    rs = []
    for i in range(120):
        t = list(rng.choice(bases))
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
        if rng.random() < 0.6:
            t = t + rng.choice(passages) if rng.random() < 0.5 else rng.choice(passages) + t
        rs.append((i, " ".join(t)))
    got = collections.Counter(tuple(r) for r in ngram_join.link_documents(spark.createDataFrame(rs, "doc_id long, text string").repartition(4)).collect())
    assert got == link_truth(rs)


def test_ngram_join_of_two_families_with_a_bridge(spark):
    """Bridges just above the threshold, whose keys lie at hubs of both families: each half alone is under the bound."""
    rs = []
    for seed in (6, 13, 14, 16, 20, 25):
        rng = random.Random(seed)
        w, before, after = words(rng, 90, 10**6), words(rng, 14, 10**6), words(rng, 14, 10**6)
        a, b = [*w[11:], after[0]], [before[-1], *w[:-11]]
        for t in (before + w, w + after, a, [*a, "a1"], [*a, "a2"], [*a, "a3"], b, ["b1", *b], ["b2", *b], ["b3", *b]):
            rs.append((len(rs), " ".join(t)))
    want = link_truth(rs)
    assert {c for _, _, c in want} == set(range(0, len(rs), 10))
    assert collections.Counter(tuple(r) for r in ngram_join.link_documents(spark.createDataFrame(rs, "doc_id long, text string")).collect()) == want


def test_prefix_keys_meet():
    """Sets at the threshold always share a key, whichever tokens are frequent."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        universe = common.mix64(np.arange(1, 200, dtype=np.uint64))
        x = rng.choice(universe, n, replace=False)
        y = np.concatenate((x[int(rng.integers(0, n // 4 + 1)) :], rng.choice(universe, int(rng.integers(0, n // 5 + 1)), replace=False)))
        x, y = np.unique(x), np.unique(y)
        common_ = len(np.intersect1d(x, y))
        if len(y) and 100 * common_ >= 75 * (len(x) + len(y) - common_) and not np.array_equal(x, y):
            frequent = np.sort(rng.choice(universe, int(rng.integers(0, 150)), replace=False))
            assert len(np.intersect1d(ngram_join.prefix_keys(x, frequent)[0], ngram_join.prefix_keys(y, frequent)[0]))


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)] + [(200 + rng.randrange(30), 200 + rng.randrange(30)) for _ in range(25)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chunks_fall_into_step():
    rng = random.Random(6)
    a = " ".join(words(rng, 2000, 10**6)).encode()
    b = b"an insertion at the front " + a
    cut = lambda t: {t[x:y] for e in chunking.cuts([t], 5, 24, 512) for x, y in zip([0, *e], e, strict=False)}
    assert len(cut(a) - cut(b)) <= 4
    for t in (b"", b"a", a, "日本語テキスト".encode() * 400):
        (ends,) = chunking.cuts([t], 5, 24, 512)
        parts = [t[x:y] for x, y in zip([0, *ends], ends, strict=False)]
        assert b"".join(parts) == t and all(0 < len(p) <= 512 for p in parts)
        [p.decode() for p in parts]
        assert chunking.cuts([a, t, a], 5, 24, 512)[1] == ends


def substring_truth(rs, least=substring.LEAST_RUN):
    """Of each row, the text without repeats, the spans and the ids of first occurrence: plain dictionaries over the chunks' bytes."""
    key = lambda r: (r[0] is None, r[0] or 0, substring._row_key(r[0], (r[1] or "").encode()))
    chunks = {}
    for r in rs:
        t = (r[1] or "").encode()
        (ends,) = chunking.cuts([t], substring.BITS, substring.LEAST, substring.MOST)
        chunks[key(r)] = [(a, b, t[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
    first = {}
    for k in sorted(chunks):
        for a, _, x in chunks[k]:
            first.setdefault(x, (k, a))
    out = []
    for r in rs:
        t, spans, ids = (r[1] or "").encode(), [], []
        for a, b, x in chunks[key(r)]:
            if first[x] != (key(r), a):
                if spans and spans[-1][1] == a:
                    spans[-1][1] = b
                    ids[-1].add(first[x][0][:2])
                else:
                    spans.append([a, b])
                    ids.append({first[x][0][:2]})
        keep = [b - a >= least for a, b in spans]
        spans, ids = [tuple(s) for s, k in zip(spans, keep, strict=True) if k], [i for i, k in zip(ids, keep, strict=True) if k]
        rest = b"".join(t[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(t)], strict=True))
        out.append((r[0], None if r[1] is None else rest.decode(), len(t), len(t) - len(rest), tuple(spans), tuple(sorted({i for s in ids for null, i in s if not null}))))
    return collections.Counter(out)


def test_substring(docs, none):
    got = substring.dedup_substrings(docs)
    assert got.columns[: len(docs.columns)] == docs.columns
    assert collections.Counter((r.doc_id, r.text, r.n_bytes, r.removed_bytes, tuple(map(tuple, r.spans)), tuple(r.first_ids or ())) for r in got.collect()) == substring_truth(rows())
    removed = {r.doc_id: r.removed_bytes for r in got.collect() if r.doc_id is not None}
    assert removed[68] == 0 and all(removed[i] > 200 for i in range(69, 74))  # a passage stays where it came first
    assert substring.dedup_substrings(none).count() == 0


def test_substring_keeps_columns_of_any_name(spark):
    text = " ".join(words(random.Random(3), 80, 10**6))
    docs = spark.createDataFrame([(2, text, 1, 2, 3, "a"), (1, text, 4, 5, 6, "b")], "doc_id long, text string, row_key int, span_of int, span_of_key int, spans string")
    got = {r.doc_id: r for r in substring.dedup_substrings(docs).collect()}
    assert (got[1].row_key, got[1].span_of, got[1].span_of_key) == (4, 5, 6) and got[1].text == text and got[2].text == ""


def test_media(docs, none):
    """A row for each row; payloads, features and stored forms against plain recomputation."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=6).compress
    got = collections.Counter(tuple(r) for r in media.media_documents(docs).collect())
    want = collections.Counter()
    for r in rows():
        text = (r[1] or "").encode()
        p = text + b"\xff" * ((-len(text)) % 576 or (0 if text else 576))
        (ends,) = chunking.cuts([p], media.BITS, media.LEAST, media.MOST, characters=False)
        stored = [squeeze(p[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        a = list(p)
        mean = sum(a) / len(a)
        dev = math.sqrt(sum((x - mean) ** 2 for x in a) / len(a))
        crossings = sum((x >= 128) != (y >= 128) for x, y in zip(a, a[1:], strict=False))
        want[r[0], len(text), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), sum(map(len, stored)), hashlib.sha256(b"".join(stored)).hexdigest(), f"mean={mean:.4f};dev={dev:.4f};crossings={crossings}", len(ends)] += 1
    assert got == want
    assert media.media_documents(none).count() == 0


def test_media_stores_a_chunk_once_and_finds_damage(spark):
    rng = random.Random(13)
    text = " ".join(words(rng, 20000, 10**6))
    docs = spark.createDataFrame([(i, text[i:]) for i in range(6)], "doc_id long, text string")
    manifest = common.written(media.store(docs), "manifest")
    rs = manifest.collect()
    assert len({r.digest for r in rs}) == len({(r.file, r.offset) for r in rs}) < 0.25 * len(rs)
    r = rs[len(rs) // 2]
    path = r.file.removeprefix("file:")
    with open(path, "r+b") as f:
        f.seek(r.offset + r.length // 2)
        old = f.read(1)
        f.seek(r.offset + r.length // 2)
        f.write(bytes([old[0] ^ 1]))
    with pytest.raises(Exception, match="damaged"):
        media.read_back(manifest).collect()
    with pytest.raises(Exception, match="missing|whole"):
        media.read_back(manifest.where(f"not (medium = {r.medium} and seq = {r.seq})").where(f"digest != X'{r.digest.hex()}'")).collect()


PAGES = "page_id long, url string, html string, key string"


def pages():
    rs = [(i, f"http://{'abc'[i % 3]}.Example.com:80/p{i}?q=é", f"<p>{i % 7}</p>" * (i % 5), "k") for i in range(40)]
    return [*rs, (50, None, None, "k"), (51, "http://[bad", "x", "k"), (52, "http://[bad", "x", "k"), (54, "http://[bad<\tx", "t", "k"), (55, "http://a:99999/x\ty", "t", "k"), (3, "http://a.Example.com:80/p3?q=é", "<p>3</p>" * 3, "k"), *[(60, "http://r/", "<p>again</p>", "k")] * 4, *[(61, "http://r/", "<p>again</p>", "k")] * 2, (None, "http://n/", "<p>1</p>", "k"), (53, "nonsense \n", "日本" * 5000, "k")]


def test_warc(spark, none):
    df = spark.createDataFrame(pages(), PAGES).repartition(3)
    got = collections.Counter(tuple(r) for r in warc.archive_pages(df).collect())
    first = {}
    for r in sorted(pages(), key=lambda r: (r[0] is None, r[0])):
        first.setdefault(r[2] or "", r[0])
    want, responses = collections.Counter(), set()
    for r in sorted(pages(), key=lambda r: (r[0] is None, r[0])):
        p = (r[2] or "").encode()
        revisit = first[r[2] or ""] != r[0] or p in responses
        responses.add(p)
        want[r[0], len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", first[r[2] or ""] if revisit else None] += 1
    assert got == want
    assert all(r.record_type == "response" for r in warc.archive_pages(df, least=10**9).collect())
    index = warc.build_index(warc.write_archives(df), 2)
    key = warc.capture_key(pages()[4][1], 4)
    assert [r.page_id for r in warc.lookup(index, spark.createDataFrame([(key,), ("nothing",)], "key string")).collect()] == [4]
    assert warc.url_key("http://A.b.example.com:80/x?y=1") == "com,example,b,a)/x?y=1"
    assert warc.archive_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_lm(docs, none):
    got = lm.score_documents(docs).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False
    counts = collections.Counter()
    for r in rows():
        if not held(r[0]):
            counts.update(lm.normal((r[1] or "").encode()).split())
            counts["end"] += 1
    n, v = sum(counts.values()), len(counts)  # all tokens and distinct tokens, the end being one
    want, seen = collections.Counter(), collections.Counter()
    for r in rows():
        tokens = [*lm.normal((r[1] or "").encode()).split(), "end"]
        want[r[0], held(r[0]), len(tokens), sum(counts[t] > 0 for t in tokens), n, round(sum(math.log10((counts[t] + 1) / (n + 1 * (v + 1))) for t in tokens), 6)] += 1
    for r in got:
        seen[r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)] += 1
        assert r.score < 0 and math.isfinite(r.score)
    assert seen == want
    assert lm.score_documents(none).count() == 0
    untrained = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")
    assert untrained.count() and all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in lm.score_documents(untrained).collect())


def ctw_probability(training: list[bytes], text: bytes, depth: int) -> float:
    """log10 probability of a text from dictionaries of counts and plain recursion over the tree of each decision."""
    counts = collections.defaultdict(lambda: [0, 0])
    seq = lambda t: bytes([255]) * depth + t + b"\xff"
    for t in training:
        s = seq(t)
        for i in range(depth, len(s)):
            for j in range(8):
                for d in range(depth + 1):
                    counts[s[i - d : i], 1 << j | s[i] >> (8 - j)][s[i] >> (7 - j) & 1] += 1
    below = collections.defaultdict(list)
    for c, d in counts:
        if c:
            below[c[1:], d].append(c)
    kt = lambda z, o: (math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(z + o + 1)) / math.log(2)
    known = {}

    def weighted(c, d):
        if (c, d) not in known:
            own = kt(*counts[c, d])
            known[c, d] = own if len(c) == depth else float(np.logaddexp2(own, sum(weighted(x, d) for x in below[c, d]))) - 1
        return known[c, d]

    def predict(c, d, context):
        """Probability of a one at the node c on the path of context."""
        if (c, d) not in counts:
            return 0.5
        z, o = counts[c, d]
        own = (o + 0.5) / (z + o + 1)
        if len(c) == depth:
            return own
        stop = 2 ** (kt(z, o) - 1 - weighted(c, d))
        return stop * own + (1 - stop) * predict(context[depth - len(c) - 1 :], d, context)

    s, total = seq(text), 0.0
    for i in range(depth, len(s)):
        for j in range(8):
            one = predict(b"", 1 << j | s[i] >> (8 - j), s[i - depth : i])
            total += math.log10(one if s[i] >> (7 - j) & 1 else 1 - one)
    return total


@pytest.mark.parametrize("depth", [2, 4, 6])
def test_lm_scores_are_those_of_the_tree(spark, depth):
    """The query's scores of trained and held-out texts against the plain tree."""
    rng = random.Random(depth)
    rs = [(i, " ".join(words(rng, 6, 30))) for i in range(14)] + [(14, ""), (15, None), (None, "The w1 The")]
    got = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(rs, "doc_id long, text string").repartition(2), depth).collect()}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    texts = {i: lm.normal((t or "").encode()) for i, t in rs}
    training = [t for i, t in texts.items() if not held(i)]
    assert any(held(i) for i in texts)
    for i, t in texts.items():
        assert got[i].score == pytest.approx(ctw_probability(training, t, depth), rel=1e-5)
        assert got[i].code_bits_per_byte == pytest.approx(-got[i].score / math.log10(2) / (len(t) + 1))


def test_lm_is_context_tree_weighting():
    """The batch form equals sequential weighting: the product of its predictions is the root's weighted probability."""
    text = b"abracadabra abra"
    strings, _ = lm.strings_of([text])
    k, c = lm._count(strings)
    parts = collections.defaultdict(list)
    for x, y in zip(k, c, strict=True):
        parts[int(x) >> 24].append((x, y))
    trees = {p: lm.subtree(np.array([a for a, _ in e], np.uint64), np.array([b for _, b in e])) for p, e in parts.items()}

    def weighted(depth, pairs, decision):
        """log2 of the weighted probability of a decision's bits, by plain recursion."""
        bits = [b for _, b in pairs]
        own = float(lm.block_probability(np.array([bits.count(0)], float), np.array([bits.count(1)], float))[0])
        if depth == lm.DEPTH:
            return own
        below = collections.defaultdict(list)
        for ctx, b in pairs:
            below[ctx[depth]].append((ctx, b))
        deep = sum(weighted(depth + 1, p, decision) for p in below.values())
        return float(np.logaddexp2(own, deep)) - 1

    data = collections.defaultdict(list)
    for s in strings.tolist():
        ctx = tuple(s >> (8 * j) & 255 for j in (4, 3, 2, 1))
        for j in range(8):
            data[(1 << j) | ((s & 255) >> (8 - j))].append((ctx, (s & 255) >> (7 - j) & 1))
    tops = [lm.top(t["k2"], t["zeros"], t["ones"], t["whole"]) for t in ([{x: np.concatenate([t[x] for t in trees.values()]) for x in ("k2", "zeros", "ones", "whole")}])]
    k0, _, z0, o0, below = lm._up(tops[0]["k1"], 8, tops[0]["zeros"], tops[0]["ones"], tops[0]["whole"])
    whole, _ = lm.weigh(z0, o0, below)
    for d, w in zip((k0 & np.uint64(255)).tolist(), whole.tolist(), strict=True):
        assert w == pytest.approx(weighted(0, data[d], d), abs=1e-9)
    a, g = lm.root(tops[0])
    assert ((a >= 0) & (a + g <= 1 + 1e-12)).all()


def test_lm_probabilities_sum_to_one(tmp_path, spark):
    texts = [b"the theory of the thing", b"other things there"]
    strings, _ = lm.strings_of(texts)
    k, c = lm._count(strings)
    rs = []
    for p in sorted({int(x) >> 24 for x in k}):
        hit = [(x, y) for x, y in zip(k, c, strict=True) if int(x) >> 24 == p]
        rs.append((p, np.array([x for x, _ in hit], np.uint64).tobytes(), np.array([y for _, y in hit], np.int64).tobytes()))
    model = lm.train(spark.createDataFrame([(p, bytearray(a), bytearray(b)) for p, a, b in rs], "part int, keys binary, counts binary"))
    for context in (b"the ", b"xxxx", b"zthe"):
        base = np.uint64(int.from_bytes(context[::-1], "big") << 8)
        every = base | np.arange(256, dtype=np.uint64)
        part = np.concatenate([lm.Shard(model, 0).score(every)])
        assert float((10.0**part).sum()) == pytest.approx(1.0, abs=1e-4)
    whole = lm.score_texts(model, texts)
    small = dict(model, id="small", shards=[[x] for s in model["shards"] for x in s])
    assert lm.score_texts(small, texts) == pytest.approx(whole)


def test_toxicity(spark, docs, none):
    rng = random.Random(8)
    rs, ls = [], []
    for i in range(600):
        bad = i % 8 == 0
        w = words(rng, 60, 3000)
        for _ in range(3 * bad):
            w.insert(rng.randrange(len(w)), rng.choice(["vileword", "nastyword", "awfulword"]))
        rs.append((i, " ".join(w), "en", "s", 0, 1, "k"))
        ls.append((i, 0, int(bad), "clash"))
    rs += [(None, "vileword", None, None, None, 1, "k"), (700, None, None, None, None, 1, "k"), (701, "", None, None, None, 1, "k")]
    labels = spark.createDataFrame([*ls, (1, 0, None, "x"), (None, 0, 1, "x"), ls[8]], "doc_id long, quality int, toxic int, text string")
    got = {r.doc_id: r for r in toxicity.score_documents(spark.createDataFrame(rs, SCHEMA).repartition(3), labels).collect()}
    assert len(got) == len(rs)
    assert all(got[i].predicted == int(i % 8 == 0) for i in range(600))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(600))
    assert got[None].predicted == 1 and got[None].neighbours and got[700].score == got[701].score < 0.2
    assert not any(got[n].held_out for n in got[8].neighbours)
    empty = labels.limit(0)
    assert {r.score for r in toxicity.score_documents(docs, empty).collect()} == {0.0}
    assert toxicity.score_documents(none, labels).count() == 0


def test_toxicity_by_likeness(spark):
    """Copies of toxic examples whose words are in no other text are found by their whole texts."""
    rng = random.Random(12)
    rs = [(i, " ".join(words(rng, 60, 3000))) for i in range(300)]
    toxic = [i for i in range(300) if i % 20 == 0 and zlib.crc32(str(i).encode()) % 3 != 1]
    for k, i in enumerate(toxic):
        rs[i] = (i, " ".join(f"own{k}x{j}" for j in range(30)))
        rs.append((1000 + k, rs[i][1] + " and a few words more"))
    labels = spark.createDataFrame([(i, 0, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(spark.createDataFrame(rs, "doc_id long, text string"), labels).collect()}
    assert all(got[1000 + k].predicted == 1 and got[1000 + k].neighbours[0] == i for k, i in enumerate(toxic))
    assert not any(got[i].predicted for i in range(300) if i not in toxic)


def toxicity_truth(rs, ls, step=toxicity.RATIO_STEP, least=toxicity.LEAST_RATIO, k=toxicity.NEIGHBOURS):
    """Score and neighbours of each row from dictionaries: every cosine, votes, and the curve by bisection of its gradient."""
    import regex

    terms = lambda t: collections.Counter(regex.findall(r"[\p{L}\p{N}]+", (t or "").lower()))
    learn = {}
    for i, y in ls:
        if i is not None and y is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            learn[i] = max(y, learn.get(i, 0))
    merged = {}
    for i, t in sorted((r for r in rs if r[0] in learn), key=lambda r: (r[0], r[1] or "")):
        merged.setdefault(frozenset(terms(t).items()), []).append(i)
    examples = [(ids[0], dict(v), sum(learn[i] for i in ids) / len(ids)) for v, ids in merged.items()]
    df = collections.Counter(w for _, t in rs for w in terms(t))
    n1, n = sum(y for _, _, y in examples), len(examples)
    seen, bad = collections.Counter(w for _, v, _ in examples for w in v), collections.Counter()
    for _, v, y in examples:
        for w in v:
            bad[w] += y

    def ratio(w):
        m, a = seen[w], bad[w]
        if not 0 < n1 < n or a <= m * n1 / n:
            return 0.0
        return 2 * (a * math.log(a / (m * n1 / n)) + ((m - a) * math.log((m - a) / (m * (1 - n1 / n))) if m > a else 0))

    weight = {w: (math.log((1 + len(rs)) / (1 + df[w])) + 1) * (1 + max(0, ratio(w) - least) / step) for w in seen}

    def unit(v):
        u = {w: (1 + math.log(c)) * weight.get(w, math.log((1 + len(rs)) / 2) + 1) for w, c in v.items()}
        norm = math.sqrt(sum(x * x for x in u.values()))
        return {w: x / norm for w, x in u.items()}

    units = [(i, unit(v), y) for i, v, y in examples]
    rate = n1 / n
    empty = [y for _, v, y in examples if not v]
    empty_rate = sum(empty) / len(empty) if empty else rate

    def near(u, skip=None):
        every = sorted((-round(sum(x * e[w] for w, x in u.items() if w in e), 9), i, y) for i, e, y in units if i != skip)
        return [(-c, i, y) for c, i, y in every if c < 0][:k]

    def share(found):
        w = [1 / (1.05 - min(c, 1)) ** 2 for c, _, _ in found]
        return (sum(a * y for a, (_, _, y) in zip(w, found, strict=True)) + rate) / (sum(w) + 1) if found else empty_rate

    odds = lambda p: math.log(min(max(p, 1e-3), 1 - 1e-3) / (1 - min(max(p, 1e-3), 1 - 1e-3)))
    points = np.array([(odds(share(near(u, i))), y) for i, u, y in units if u])

    def loss(a, b):
        z = a * points[:, 0] + b
        return (np.logaddexp(0, z) - points[:, 1] * z).sum() + ((a - 1) ** 2 + b * b) / 2

    a, b, size = 1.0, 0.0, 1.0
    while size > 1e-9:  # pattern search of a convex loss
        here = loss(a, b)
        better = min(((loss(x, y), x, y) for x in (a - size, a, a + size) for y in (b - size, b, b + size)), key=lambda p: p[0])
        if better[0] < here:
            _, a, b = better
        else:
            size /= 2
    out = []
    for i, t in rs:
        found = near(unit(terms(t)))
        s = share(found)
        out.append((i, 1 / (1 + math.exp(-(max(a, 0) * odds(s) + b))) if found else s, [j for _, j, _ in found[:5]]))
    return out


def test_toxicity_is_the_search_of_all_examples(spark):
    rng = random.Random(21)
    rs = []
    for i in range(160):
        w = words(rng, rng.choice([2, 15, 60]), 300)
        if i % 6 == 0:
            w += rng.choices(["vile", "nasty", "awful"], k=2)
        rs.append((i, " ".join(w)))
    rs += [(200, rs[5][1]), (201, rs[5][1]), (202, ""), (203, None), (204, "?!"), (5, rs[5][1] + " more"), (205, "unheard words only"), (None, "vile"), (206, " ".join(words(rng, 4000, 900)))]
    ls = [(r[0], int(r[0] % 6 == 0)) for r in rs if r[0] is not None and r[0] not in (200,)] + [(201, 1), (5, 1), (None, 1), (7, None)]
    labels = spark.createDataFrame([(i, 0, y) for i, y in ls], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(spark.createDataFrame(rs, "doc_id long, text string").repartition(3), labels).collect()
    want = toxicity_truth(rs, ls)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    pairs = list(zip(sorted(((r.doc_id, round(r.score, 6), r.neighbours) for r in got), key=key), sorted(((i, round(s, 6), n) for i, s, n in want), key=key), strict=True))
    assert all(a[0] == b[0] and a[2] == b[2] for a, b in pairs)
    assert [a[1] for a, _ in pairs] == pytest.approx([b[1] for _, b in pairs], abs=2e-6)


def test_toxicity_bounds_of_the_fit(spark):
    """Rows beyond the documented bounds are not learned from; those within are the ones of least hash, in any order of rows."""
    rs = [(i, f"a{i} b{i} c{i % 7}") for i in range(300)]
    docs = spark.createDataFrame(rs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 7 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    m, _ = toxicity.fit(docs, labels, max_examples=50)
    again, _ = toxicity.fit(docs.repartition(7), labels, max_examples=50)
    assert len(m.index.ids) == 50 and np.array_equal(m.index.ids, again.index.ids)
    m, _ = toxicity.fit(docs, labels, max_postings=30)
    assert len(m.index.ids) == 10


def test_block_max_search_is_exact():
    """Against all cosines, with frequent and rare terms, ties, queries without terms, and fewer examples than a block."""
    rng = np.random.default_rng(3)
    for n, terms in ((1, 5), (40, 30), (900, 40), (700, 3000)):
        dense = np.zeros((n, terms))
        for i in range(n):
            at = np.concatenate((rng.integers(0, terms, rng.integers(1, 20)), rng.integers(0, 5, 3)))
            dense[i, at] = rng.integers(1, 6, len(at))
        dense[n // 2 :] = dense[: n - n // 2] if n > 100 else dense[n // 2 :]  # ties
        dense /= np.sqrt((dense * dense).sum(1, keepdims=True))
        row, term = np.nonzero(dense)
        ids, labels = rng.permutation(10 * n)[:n], rng.integers(0, 2, n).astype(float)
        index = toxicity.BlockMaxIndex(row, term, dense[row, term], ids, labels, terms)
        queries = np.where(rng.random((150, terms)) < 8 / terms, rng.random((150, terms)), 0.0)
        queries[:, :5] += rng.random((150, 5))
        queries[7] = 0
        qr, qt = np.nonzero(queries)
        found, cosines = index.search(qr, qt, queries[qr, qt], 150, 10)
        every = np.round(queries @ dense.T, 9)
        for q in range(150):
            best = [i for i in np.lexsort((ids, -every[q])) if every[q, i] > 0][:10]
            assert index.ids[found[q][found[q] >= 0]].tolist() == ids[best].tolist()
            assert cosines[q][: len(best)] == pytest.approx(every[q, best], abs=2e-9)


def test_pipeline_stages_tell_rows_apart_by_text(spark):
    """Repeated and null ids: what happens to one row's text has no effect on another text of its id."""
    import corpus_pipeline

    rng = random.Random(31)
    a, b, c = (" ".join(words(rng, 60, 10**6)) for _ in range(3))
    rs = [(5, a, "en", "s", 1), (3, b, "en", "s", 1), (5, b, "fr", "s", 1), (None, c, "en", "s", 1), (None, c, "en", None, None), (9, c + " x", "en", "s", 1), (7, None, "en", "s", 1), (7, None, "en", "s", 1), (8, " \n", None, "s", 1), (3, b, "en", "s", 1)]
    docs = spark.createDataFrame(rs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect())
    assert got == collections.Counter([(5, a), (3, b), (9, c + " x"), (7, None), (7, None), (8, " \n")])
    clashing = docs.selectExpr("*", "1 AS first_id", "2 AS text_key", "3 AS node")
    out = ngram_join.one_of_each(clashing)
    assert out.columns == clashing.columns and out.count() == 6
    assert ngram_join.one_of_each(docs.limit(0)).count() == 0
    clash = docs.selectExpr("*", "1 AS mixed_own", "2 AS copies", "3 AS epoch", "4 AS tie", "5 AS size")
    assert mixing.expand(clash, mixing.mix(clash)).columns == clash.columns


def test_reject_toxic_judges_rows(spark, tmp_path):
    """A clean row stays though another text of its id goes; null ids and texts take part."""
    import corpus_pipeline

    rng = random.Random(33)
    rs = [(i, " ".join(words(rng, 40, 3000) + (["vile", "nasty"] if i % 8 == 0 else [])), "en", "s", 1) for i in range(400)]
    spark.createDataFrame([(r[0], 0, int(r[0] % 8 == 0)) for r in rs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held = next(i for i in range(0, 400, 8) if zlib.crc32(str(i).encode()) % 3 == 1)  # its texts are no examples
    rs += [(held, "a clean text of a toxic id w1 w2", "en", "s", 1), (None, "vile nasty w5", "en", "s", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rs, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.reject_toxic(spark, docs, str(tmp_path))
    assert out.columns == corpus_pipeline.COLUMNS
    want = collections.Counter((r[0], r[1]) for r in rs if "vile" not in (r[1] or ""))
    assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == want


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    rs = [r for r in {r[0]: r for r in rows()}.values() if r[0] is not None]
    spark.createDataFrame(rs, SCHEMA).select(*corpus_pipeline.COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rs], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    truth = link_truth(rs)
    kept = {i for i, _, c in truth if c == i}
    survivors = [r for r in rs if r[0] in kept]
    cut = {r.doc_id: r.text for r in substring.dedup_substrings(spark.createDataFrame(survivors, SCHEMA)).collect()}
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame([(i, t, r[3]) for r in survivors for i, t in [(r[0], cut[r[0]])]], "doc_id long, text string, source string")).collect()}
    enc = bpe.codec(RANKS, public_tokenizers.PATTERN)
    want = collections.Counter()
    for i, c in copies.items():
        if c:
            want[i, len(enc.encode([cut[i] or ""])[0]) // 4] += c
    assert collections.Counter((r.doc_id, r.n_tokens) for r in out) == want


def _by_sql(sql, tables):
    """Rows of DuckDB SQL over pandas frames."""
    import duckdb

    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    found = con.sql(sql)
    order = sorted(found.columns)
    return collections.Counter(tuple(r[found.columns.index(c)] for c in order) for r in found.fetchall())


def _by_spark(df):
    order = sorted(df.columns)
    return collections.Counter(tuple(r) for r in df.select(*order).collect())


def test_sql_of_operators_on_nulls_ties_and_repeated_rows(docs, spark):
    import pyarrow as pa

    from tideglass.llm import oracle

    names = [f.split()[0] for f in SCHEMA.split(", ")]
    # as in the tables, columns are of Arrow types, so that null ids stay null
    table = pa.table({n: pa.array([r[i] for r in rows()], pa.int64() if f.endswith("long") else pa.string()) for i, (n, f) in enumerate(zip(names, SCHEMA.split(", "), strict=True))})
    assert _by_spark(ngram_join.link_documents(docs)) == _by_sql(oracle.ngram_join(), {"documents": table})
    assert _by_spark(quality.judge(docs)) == _by_sql(oracle.quality_rules(), {"documents": table})
    pages = [(7, "http://a/x", "one"), (7, "http://a/x", "one"), (3, "http://b/", "é"), (9, None, "one"), (None, "http://c/", "one"), (None, "http://d/", None), (4, "http://e/", ""), (5, "http://f/", "alone")]
    table = pa.table({"page_id": pa.array([p[0] for p in pages], pa.int64()), "url": [p[1] for p in pages], "html": [p[2] for p in pages]})
    assert _by_spark(warc.archive_pages(spark.createDataFrame(pages, "page_id long, url string, html string"))) == _by_sql(oracle.warc(), {"pages": table})
