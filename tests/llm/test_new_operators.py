"""Spelling variants, tokenizer alignment and language prediction against brute force, on tables with nulls, copies and ties."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import log2

import numpy as np
import pytest

from stagelog.llm import alignment, languages, spelling
from stagelog.llm.common import configure_llm

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, word string, id string, score string, n_a string, groups string, k string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    configure_llm(spark)
    return spark.createDataFrame([(i, t, x, "s", 1, 7, "w", "i", "c", "a", "g", "k") for i, t, x in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    stems = ["".join(rng.choice(list("aabcß"), rng.integers(6, 10))) for _ in range(60)]
    out = []
    for _ in range(80):
        own = []
        for _ in range(rng.integers(5, 60)):
            w = list(stems[int(rng.integers(0, 60) ** 1.5) % 60])
            at = int(rng.integers(0, len(w)))
            if rng.random() < 0.3:
                w[at:at + int(rng.integers(0, 2))] = list(rng.choice(list("abcÀ"), rng.integers(0, 2)))
            own.append("".join(w))
        out.append(" ".join(own))
    long = "ab" * 50
    out += [None, "", " \n ", "aaaaaaa aaaaaaaa aaaaaaaaa " * 3, "AAAAAAA-aaaaaaaa×÷éééé", f"{long} {long} {long}a {long}a {long[:70]}x{long[71:]} " * 2]
    out += [" ".join(["x" * k] * 2) for k in range(60, 70)] + ["y" * 3000 + " " + "y" * 3001] * 2
    return out


def counted(rows):
    n = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += len(w) >= 7
    return {w: c for w, c in n.items() if c >= 2}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def test_spelling_variants(spark, texts):
    rows = [(i if i % 9 else None, t, "en") for i, t in enumerate(texts)] + [(5, texts[5], "en")] * 30
    got = {r["word"]: r for r in spelling.variants(frame(spark, rows)).collect()}
    n = counted(rows)
    assert len(n) > 100 and set(got) == set(n)
    near = {w: [u for u in n if abs(len(u) - len(w)) < 2 and is_near(u, w)] for w in n}
    form = {}
    for w in n:
        top = min(near[w], key=lambda u: (-n[u], u), default=None)
        form[w] = top if top is not None and n[top] >= 10 * n[w] else None
    assert sum(f is not None for f in form.values()) > 10
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        assert tuple(got[w]) == (w, form[w], root, n[w], len(near[w]), n.get(form[w]))


def test_spelling_of_few_texts(spark):
    assert spelling.variants(frame(spark, [(1, None, None)])).count() == 0
    assert spelling.variants(frame(spark, [(1, "a", "b")]).limit(0)).count() == 0


ODD = ["a", " lead", "tail ", "a  b   c\n\nd\te", "x<|endoftext|>y </s><s> z", "日本語 テキスト 🙂🙂 é", "null\x00byte", "a b　c", "one▁two", "İstanbul ǅ ﬁ", "<0x41> <unk>",
       "​ ﻿ x", "don't I'll we've 123 4567", "🙂", " ", "\n", "é ä", "a" * 5000, ("word " * 3000)]


def whole(tools, text):
    """Token bytes and ids of both sides, each encoded as one text."""
    if not text:
        return None
    full = (" " + text).encode()
    a = tools.a.encode(" " + text, add_special_tokens=False).ids
    b = tools.b.encode(text)
    raw_a, raw_b = [tools.bytes_a[k] for k in a], [tools.bytes_b[k] for k in b]
    return (a, raw_a, b, raw_b) if b"".join(raw_a) == full == b"".join(raw_b) else None


def brute_alignment(texts):
    tools = alignment.Aligner(None, None, 10)
    counts, links, out = Counter(), [], []
    for t in texts:
        found = whole(tools, t)
        own, groups = [], []
        if found:
            a, raw_a, b, raw_b = found
            ends_a, ends_b = np.cumsum([len(r) for r in raw_a]).tolist(), np.cumsum([len(r) for r in raw_b]).tolist()
            own = [(x, y) for x, e, r in zip(a, ends_a, raw_a) for y, f, s in zip(b, ends_b, raw_b) if e - len(r) < f and f - len(s) < e] if len(a) < 400 else None
            if own is None:  # one word over and over, and one long run: walk both sides
                own, i, j = [], 0, 0
                while i < len(a):
                    own.append((a[i], b[j]))
                    x, y = ends_a[i], ends_b[j]
                    i, j = i + (x <= y), j + (y <= x)
            last = 0
            for cut in sorted(set(ends_a) & set(ends_b)):
                side = [",".join(str(k) for k, e in zip(ids, ends) if last < e <= cut) for ids, ends in ((a, ends_a), (b, ends_b))]
                groups.append("|".join(side))
                last = cut
        links.append(own)
        counts.update(own)
        out.append((len(found[0]) if found else 0, len(found[2]) if found else 0, len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(*o, sum(counts[x] == best[x[1]] for x in own), sum(counts[x] for x in own)) for o, own in zip(out, links)], counts


def test_alignment(spark, texts):
    own = [None, "", *ODD, *texts[:12], texts[0], texts[0]]
    df = frame(spark, [(i, t, None) for i, t in enumerate(own)] + [(None, texts[3], None)])
    want, counts = brute_alignment([*own, texts[3]])
    for size in (200, 1 << 20):
        found, pairs = alignment.align_and_count(df, chunk_bytes=size, remembered=30 if size == 200 else 1000)
        got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"], r["n_best"], r["count_sum"]) for r in found.collect()}
        assert [got[i] for i in range(len(own))] == want[:-1] and got[None] == want[-1]
        assert {(r["a_id"], r["b_id"]): r["n"] for r in pairs.collect()} == dict(counts)
    spans = {r["doc_id"]: r["groups"] for r in alignment.align(df).collect()}
    for i, t in enumerate(own):
        text = ";".join(",".join(map(str, g["a"])) + "|" + ",".join(map(str, g["b"])) for g in spans[i])
        assert (hashlib.sha256(text.encode()).hexdigest() if text else "") == want[i][4]
        assert not text or (spans[i][0]["begin"], spans[i][-1]["end"]) == (0, len((" " + t).encode()))
    assert alignment.align_and_count(df.limit(0))[0].count() == 0


def test_cut_points_agree_with_the_tokenizers_own_spans():
    """Refined byte ends equal the sums of decoded bytes, also where tokens share characters."""
    tools = alignment.Aligner(None, None, 10)
    for t in ODD:
        if whole(tools, t) is None:
            continue
        part = " " + t
        e = tools.a.encode(part, add_special_tokens=False)
        sizes = np.array([len(tools.bytes_a[k]) for k in e.ids])
        assert alignment.character_ends(np.array(e.offsets), sizes, part.encode()).tolist() == np.cumsum(sizes).tolist()
        spans = tools.b.encode(t, return_type="proto").pieces
        sizes = np.array([len(tools.bytes_b[p.id]) for p in spans])
        assert alignment.span_ends(np.array([(p.begin, p.end) for p in spans]), sizes).tolist() == np.cumsum(sizes).tolist()


def brute_bits(train, text, order):
    """Code length by recursion over plain counts."""
    seen = defaultdict(Counter)
    for t in train:
        data = bytes([255] * order) + t.encode()
        for at in range(order, len(data)):
            for k in range(order + 1):
                seen[data[at - k:at]][data[at]] += 1

    def p(context, byte):
        own = seen.get(context)
        low = (lambda s: p(context[1:], s)) if context else (lambda s: 1 / 256)
        if not own:
            return low(byte)
        d, t = len(own), sum(own.values())
        if byte in own:
            return own[byte] / (t + d)
        return d / (t + d) * low(byte) / (1 - sum(low(s) if not context else seen[context[1:]][s] / (sum(seen[context[1:]].values()) + len(seen[context[1:]])) for s in own))

    data = bytes([255] * order) + text.encode()
    return -sum(log2(p(data[at - order:at], data[at])) for at in range(order, len(data)))


def test_language_code_lengths(spark):
    train = {"x": ["abra cadabra", "abc abd", "", "é"], "y": ["zebra zoo", "zzz"], "ä": ["abab"]}
    df = frame(spark, [(i, t, x) for i, (x, t) in enumerate([(x, t) for x, ts in train.items() for t in ts] + [(None, "abracadabra"), ("x", None)])])
    for order in (1, 2, 4):
        trees = languages.learn(df, order=order)
        assert trees.langs == ["x", "y", "ä"]
        texts = ["abra zoo", "q", "cadé", "", "zebra" * 9]
        got = trees.code_lengths([t.encode() for t in texts])
        want = [[brute_bits(train[x], t, order) for x in trees.langs] for t in texts]
        assert np.allclose(got, want, rtol=1e-5, atol=1e-4)
        # probabilities of each context add up to one
        for before in ("", "ab", "zq"):
            rest = [languages.grams((before.encode() + bytes([s])), order)[-1] for s in range(256)]
            bits = trees._cost(order, np.array(rest, dtype=np.uint64))
            assert np.allclose(np.exp2(-bits).sum(axis=0), 1, atol=1e-4)


def test_pieces_of_long_texts_know_what_is_before_them():
    texts = [b"abc" * 700, b"", b"x", b"hello " * 300]
    parts = list(languages.pieces(texts, 4, 64))
    flat = [(int(o), int(g)) for own, found in parts for o, g in zip(own, found)]
    assert flat == [(k, int(g)) for k, t in enumerate(texts) for g in languages.grams(t, 4)]


def test_language_prediction(spark):
    rng = np.random.default_rng(1)
    sound = {"de": "eiichsch", "en": "thhewio", "fr": "ouaiéèu"}

    def text(x, n):
        return " ".join("".join(rng.choice(list(sound[x]), rng.integers(2, 7))) for _ in range(n))

    rows = [(i, text(x, 30), x) for i, x in enumerate(["de", "en", "fr"] * 60)]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 ... \n", "de"), (None, rows[0][1], "de"), (0, rows[0][1], "de"), (1003, text("fr", 20000), None)]
    df = frame(spark, rows)
    trees = languages.learn(df.where(~languages.held_out(languages.F.col("doc_id"))))
    found = languages.predict(df.select("doc_id", "text", "n", "score"), trees).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    got = {r["doc_id"]: r for r in found}
    right = [got[i]["lang_pred"] == x for i, _, x in rows[:180]]
    assert np.mean(right) > 0.97
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert got[1003]["lang_pred"] == "fr" and got[None]["lang_pred"] == "de" and got[0]["n"] == 7
    nothing = languages.learn(df.limit(0))
    assert {r["lang_pred"] for r in languages.predict(df, nothing).collect()} == {"und"}
    assert languages.predict(df.limit(0), trees).count() == 0


def test_frequent_grams_stay_within_their_bound(spark):
    configure_llm(spark)
    rows = [("a", g, n) for g, n in enumerate([9, 9, 5, 5, 5, 1, 1, 1])] + [("b", g, 2) for g in range(3)]
    counts = spark.createDataFrame(rows, "lang string, gram bigint, n bigint")
    kept = Counter(r["lang"] for r in languages.frequent(counts, 20).collect())
    assert kept == {"a": 5, "b": 3}


def test_registered_columns(spark):
    """Names and types of the queries' results."""
    from stagelog.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    kinds = {name: dict(QUERIES[name](spark, folder).dtypes) for name in ("op11_spelling_variants", "op12_tokenizer_alignment", "op13_language")}
    assert kinds["op11_spelling_variants"] == dict(word="string", form="string", root="string", n="bigint", n_near="bigint", form_n="bigint")
    assert kinds["op12_tokenizer_alignment"] == dict(
        doc_id="bigint", n_a="bigint", n_b="bigint", n_groups="bigint", n_links="bigint", n_best="bigint", count_sum="bigint", groups_sha256="string")
    assert kinds["op13_language"] == dict(doc_id="bigint", held_out="boolean", lang_pred="string", score="double")


def test_hashing_a_piece_takes_bounded_memory():
    """op7: six tasks hash pieces at once within an executor."""
    import tracemalloc

    from stagelog.llm import suffixes

    text = bytes(range(32, 127)) * (suffixes.PIECE // 95)
    suffixes.anchors([text])  # tables of powers are kept
    tracemalloc.start()
    suffixes.anchors([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
