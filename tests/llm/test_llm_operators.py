"""Training-data operators against brute force on small tables with nulls, copies, ties and extra columns."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stagelog.llm import chats, convnet, decontaminate, katz, mixing, rules, setjoin, suffixes, token_counts, warc
from stagelog.llm.common import configure_llm

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, score string, n string, v string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(t):
    return [w for w in re.split("[ \t-\r]+", (t or "").translate(LOW)) if w]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(400)]
    prose = [" ".join(rng.choice(vocabulary, rng.integers(30, 90))) for _ in range(40)]
    passage = " ".join(rng.choice(vocabulary, 30))
    out = list(prose)
    out += [prose[0]] * 5 + [prose[1] + " tail", "head " + prose[1], prose[1].upper()]
    out += [f"{p} {passage} {q}" for p, q in zip(prose[5:12], prose[12:19])]
    out += [None, "", " \n\t ", "one", "one", "one two three", "é" * 30 + "ü" * 40, "é" * 30 + "ü" * 40 + "x", "a" * 700, " ".join(prose[:30])]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    configure_llm(spark)
    rows = [(i, t, "en", [None, "b", "a", "c"][i % 4], len(t or ""), "x", "y", "z", "w") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_token_counts(docs, none, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = by_id(token_counts.count_tokens(docs, batch_bytes=64))
    assert all(got[i]["n_tokens"] == len(library.encode(t or "", add_special_tokens=False)) for i, t in enumerate(texts))
    assert got[0]["size"] == "x" and token_counts.count_tokens(none).count() == 0


@pytest.mark.parametrize("text", ["a  b \n c", " lead", "tail ", "x<|endoftext|>y z", "don't I'll", "a  b c d", "1 2 \t 3", "ß ǘ é"])
def test_cut_texts_count_the_same(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = len(Tokenizer.from_file(path).encode(text, add_special_tokens=False))
    assert token_counts.Lengths(path, 8, 10)([text]) == [whole]


def test_mix(docs, none, texts):
    rows = mixing.mix(docs).collect()
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}
    sizes = {i: len(tokens(t)) for i, t in enumerate(texts)}
    assert all(r["size"] == sizes[r["doc_id"]] and r["taken"] <= 3 * r["size"] for r in rows)
    total = sum(sizes.values())
    sources = {s: [r for r in rows if r["source"] == s] for s in {r["source"] for r in rows}}
    weight = {"a": 1, "b": 2, "c": 3, None: 1}
    want, capped = {}, set()
    while True:  # cap what is above three times its size, share the rest anew
        left = total - sum(3 * sources[s][0]["source_size"] for s in capped)
        free = sum(w for s, w in weight.items() if s not in capped)
        want = {s: 3 * sources[s][0]["source_size"] if s in capped else left * w / free for s, w in weight.items()}
        above = {s for s in weight if want[s] > 3 * sources[s][0]["source_size"]}
        if not above:
            break
        capped |= above
    for s, own in sources.items():
        assert abs(own[0]["target"] - want[s]) < 1e-6
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    assert abs(sum(own[0]["target"] for own in sources.values()) - total) < 1e-6
    assert mixing.mix(none).count() == 0


def test_mix_with_unequal_chances(docs):
    rows = mixing.mix(docs.drop("size"), priority="n_chars").collect()
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)


def test_mix_goes_on_behind_a_large_document(spark):
    """A document larger than what is left is passed over; those ranked after it fill the size."""
    configure_llm(spark)
    for k in range(3):
        texts = [("a", 700), *[("a", 10)] * 40, *[("b", 10)] * 35, *[("c", 10)] * 35]
        rows = [(i, " ".join([f"w{k}"] * n), s) for i, (s, n) in enumerate(texts)]
        got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).where("source = 'a'").collect()
        assert abs(got[0]["target"] - 300) < 1e-9 and sum(r["taken"] for r in got) == 300 and all(r["copies"] <= 1 for r in got)


def test_mix_numbers_equal_rows(spark):
    """Of many equal rows a share is taken, as many each time; unequal chances too."""
    configure_llm(spark)
    rows = [(None, "w " * 10, "a")] * 100 + [(i, f"x{i} y", "b") for i in range(100)] + [(7, "same text", None)] * 5
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(7)
    for priority in (None, mixing.variety(F.col("text"))):
        got = [mixing.mix(docs, priority=priority).collect() for _ in range(2)]
        assert all(len(g) == 205 for g in got)
        taken = [sorted((str(r["source"]), r["taken"]) for r in g) for g in got]
        assert taken[0] == taken[1]
        for s in ("a", "b", None):
            own = [r for r in got[0] if r["source"] == s]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)


def test_mix_prefers_varied_words(spark):
    configure_llm(spark)
    rows = [(i, " ".join(f"w{k if i % 2 else 0}" for k in range(20)), "abc"[i % 3]) for i in range(1200)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), priority=mixing.variety(F.col("text")))
    own = [r for r in got.where("source = 'a'").collect()]
    varied, dull = ([r["taken"] for r in own if r["doc_id"] % 2 == b] for b in (1, 0))
    assert sum(varied) > 5 * sum(dull) > 0


def test_chats(spark):
    rows = [
        (1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "bot", "yes"), (3, 0, "user", "hi"), (3, 1, "bot", "yes"), (3, 2, "user", "more"),
        (4, 0, "user", "hi"), (4, 1, "bot", "no"), (5, 0, "user", "hi"), (5, 1, "bot", "no"), (5, 1, "bot", "no"),
        (6, None, None, None), (None, 0, "user", "alone"), (7, 5, "user", "hi"), (7, 2, "user", "first")]
    rows += [(8, k, "user", f"t{k}") for k in range(2500)] + [(9, k, "user", f"t{k}") for k in range(1300)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, n string")
    got = {(r["conv_id"], r["part"]): (r["n_turns"], r["rendered"]) for r in chats.collapse_and_render(df).collect()}
    assert {k[0] for k in got} == {3, 4, 6, 7, 8, None}
    assert [got[8, p][0] for p in (0, 1, 2)] == [1024, 1024, 452]
    assert got[7, 0][1].index("first") < got[7, 0][1].index("hi")
    assert got[6, 0] == (1, "<|im_start|>unknown\n<|im_end|>\n")
    assert chats.collapse_and_render(df.limit(0)).count() == 0


def test_warc(spark):
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, "http://c\r\nX: y", ""), (5, "http://d", "é" * 200_000), (None, "u", "same")]
    noise = [(10 + i, f"http://{i}", hashlib.sha256(str(i).encode()).hexdigest() * 40) for i in range(60)]
    pages = spark.createDataFrame([(*r, "x") for r in rows + noise], "page_id bigint, url string, html string, sum string").repartition(3)
    files = warc.write_warc(pages, warc.new_folder(spark, "warc-test"), file_bytes=20_000)
    for size in (700, 5000, 1 << 20):  # ranges inside, around and beyond members
        found = warc.read_warc(files, range_bytes=size).collect()
        assert len(found) == 66 and all(r["digest_ok"] for r in found)
        at = {r["record_id"].rpartition("/")[2]: r for r in found}
        assert at["5"]["payload"].decode() == "é" * 200_000 and at["5"]["payload_bytes"] == 400_000
        assert at["2"]["record_type"] == "revisit" and at["2"]["refers_to_id"].endswith("/1") and at["2"]["payload_bytes"] == 4
        assert at["1"]["record_type"] == "response" and at[""]["record_type"] == "revisit"
        assert at["4"]["record_type"] == "revisit" and at["4"]["refers_to_id"].endswith("/3")
        assert at["3"]["payload_digest"] == base64.b32encode(hashlib.sha1(b"").digest()).decode()
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_warc_of_broken_archives(spark, tmp_path):
    """A member cut off at the end or damaged in the middle has a status; the other records are read."""
    rows = [(i, f"http://{i}", "".join(hashlib.sha256(f"{i} {k}".encode()).hexdigest() for k in range(60))) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    folder = warc.new_folder(spark, "warc-test")
    files = warc.write_warc(pages, folder, file_bytes=1 << 30).collect()
    path, size = files[0]["path"], files[0]["size"]
    whole = {r["offset"]: r["record_id"] for r in warc.read_warc(spark.createDataFrame(files, "path string, size bigint, records bigint")).collect()}
    data = open(path.removeprefix("file:"), "rb").read()
    at = sorted(whole)
    hurt = bytearray(data)
    middle = (at[10] + at[11]) // 2 + 60
    hurt[middle:middle + 20] = b"\xff" * 20
    for name, body, lost in (("cut", data[:-20], at[-1]), ("hurt", bytes(hurt), at[10])):
        (tmp_path / name).write_bytes(body)
        made = spark.createDataFrame([(str(tmp_path / name), len(body))], "path string, size bigint")
        for step in (900, 1 << 20):
            got = {r["offset"]: (r["record_id"], r["status"]) for r in warc.read_warc(made, range_bytes=step).collect()}
            assert got == {k: (v, "truncated" if k == lost else "complete") for k, v in whole.items()}


def test_statistics(docs, texts):
    got = by_id(rules.statistics(docs))
    for i, t in enumerate(texts):
        w = [x for x in re.split("[ \t-\r]+", t or "") if x]
        windows = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        many = Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if many[x] > 1 for j in range(5)}
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))


def test_rules_are_learned(spark, docs, none):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        words = ["".join(rng.choice(list("abcde"), 5)) for _ in range(40)]
        bad = i % 4 == 0
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in words), int(not bad)))
    made = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    judged, found = rules.judge(made.drop("quality"), made.select("doc_id", "quality"))
    assert found and all(r["kept"] == (r["doc_id"] % 4 != 0) for r in judged.collect())
    judged, found = rules.judge(docs, made.select("doc_id", "quality").limit(0))
    assert not found and judged.where("kept and base_failed").count() == 0
    assert rules.judge(none, made.select("doc_id", "quality"))[0].count() == 0


def test_covering_goes_on_behind_an_impure_kind(spark):
    """The start of highest gain is impure; two smaller pure kinds are found behind it."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(3000):
        f = dict.fromkeys(rules.FEATURES, 0.0)
        f |= {"variety": float(rng.random()), "upper_share": float(i % 10 < 3), "symbol_share": float(i % 50 == 3), "mark_share": float(i % 50 == 7)}
        bad = i % 50 in (3, 7) or (i % 10 < 3 and rng.random() < 0.8)
        rows.append((*f.values(), int(bad), i % 3))
    made = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in rules.FEATURES) + ", bad int, part int")
    found = [str(r) for r in rules.learn(made)]
    assert any("symbol_share" in r for r in found) and any("mark_share" in r for r in found)
    assert not any(r.startswith("upper_share >") and " and " not in r for r in found)


def components(texts):
    sets = []
    for t in texts:
        w = tokens(t)
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return [(len(s), top(i)) for i, s in enumerate(sets)]


def test_set_join(docs, none, texts):
    got = by_id(setjoin.components(docs))
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == components(texts)
    assert setjoin.components(none).count() == 0
    kept = {r["doc_id"] for r in setjoin.one_of_each(docs).collect()}
    assert kept == {i for i, (n, c) in enumerate(components(texts)) if c == i or not n}


def test_set_join_meets_the_middle_of_a_group(spark, monkeypatch):
    """Copies that link with a few middle texts only: pairs read grow with the copies, not with their square."""
    configure_llm(spark)
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(150)]

    def copy(i, changed):
        words = list(base)
        for at in rng.choice(np.arange(5, 145), changed, replace=False):
            words[at] = f"c{i}at{at}"
        return " ".join(words)

    texts = [copy(i, 1 if i % 15 == 7 else 2) for i in range(180)]
    read, links = [], setjoin._links
    monkeypatch.setattr(setjoin, "_links", lambda pairs, of: (read.append(pairs.count()), links(pairs, of))[1])
    got = by_id(setjoin.components(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")))
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == components(texts)
    assert sum(read) <= 12 * len(texts)


def test_one_of_each_by_id_and_text(spark):
    """Ids with two texts, null ids and repeated rows: one row of each component is left."""
    configure_llm(spark)
    one, two, three, four = (" ".join(f"{c}{k}" for k in range(30)) for c in "abcd")
    rows = [(1, one), (2, one + " tail"), (2, two), (None, three), (None, three), (None, three + " tail"), (4, four), (4, four), (5, ""), (5, "")]
    got = setjoin.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    left = Counter((r["doc_id"], r["text"]) for r in got)
    assert {t for d, t in left if d is None} <= {three, three + " tail"} and sum(n for (d, _), n in left.items() if d is None) == 1
    assert {k: n for k, n in left.items() if k[0] is not None} == {(1, one): 1, (2, two): 1, (4, four): 1, (5, ""): 2}


def test_suffixes(docs, none, texts):
    got, seen = by_id(suffixes.remove_repeats(docs, rest=True)), set()
    for i, t in enumerate(texts):
        b = (t or "").encode()
        cover, strings = bytearray(len(b)), [b[k:k + 50] for k in range(len(b) - 49)]
        for k, x in enumerate(strings):
            if x in seen:
                cover[k:k + 50] = b"\1" * 50
        seen.update(strings)
        left = bytes(c for c, m in zip(b, cover) if not m)
        spans = len(re.findall(b"\1+", bytes(cover)))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["rest"]) == (len(b), sum(cover), spans, left)
        assert got[i]["kept_sha256"] == hashlib.sha256(left).hexdigest()
    assert suffixes.remove_repeats(none).count() == 0


def test_suffixes_of_a_document_in_two_chunks(spark, monkeypatch):
    """A document has a gram in two chunks, the string another one repeats only in the first."""
    configure_llm(spark)
    rng = np.random.default_rng(11)

    def noise(n):
        return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))

    def anchor(t):
        return int(suffixes.anchors([t.encode()])[0][0])

    string = noise(50)
    gram = next(string[k:k + 24] for k in range(27) if anchor(string[k:k + 24].center(50)) == anchor(string))
    other = next(t for t in iter(lambda: noise(13) + gram + noise(13), None) if anchor(t) == anchor(string))
    long = (noise(300) + string + noise(2000))[:2000] + noise(60) + other
    monkeypatch.setattr(suffixes, "PIECE", 2000)
    monkeypatch.setattr(suffixes, "CHUNK", 60)
    for short, removed in ((1, {5: 50, 1: 0}), (9, {5: 0, 9: 50})):
        rows = spark.createDataFrame([(5, long), (short, string)], "doc_id bigint, text string").coalesce(1)
        assert {r["doc_id"]: r["n_removed"] for r in suffixes.remove_repeats(rows).collect()} == removed


def test_suffixes_of_one_id_with_several_texts(spark):
    """Each text is cut by its own repeats; copies and nulls under a shared id, repeated rows and null ids are no exception."""
    configure_llm(spark)
    rng = np.random.default_rng(23)
    a, x, y, z = ("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 300)) for _ in range(4))
    s = a[:120]
    rows = [(1, s), (5, s + x), (5, y), (5, None), (5, s), (6, z), (6, z), (7, y + z), (7, x), (None, x), (None, None), (8, ""), (9, z[100:200] + s + y[50:]), (9, s)]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), rest=True).collect()

    def expected(doc, text):
        earlier = [(t or "").encode() for d, t in rows if d is not None and (doc is None or d < doc)]
        seen = {t[k:k + 50] for t in earlier for k in range(len(t) - 49)}
        b = (text or "").encode()
        cover = bytearray(len(b))
        for k in range(len(b) - 49):
            if b[k:k + 50] in seen:
                cover[k:k + 50] = b"\1" * 50
        return bytes(c for c, m in zip(b, cover) if not m)

    assert Counter((r["doc_id"], r["text"], bytes(r["rest"])) for r in got) == Counter((d, t, expected(d, t)) for d, t in rows)


def test_deep_shallow_sorts():
    rng = np.random.default_rng(2)
    rows = rng.integers(97, 99, (500, 50), dtype=np.uint8)
    rows[100:200, :40] = rows[0, :40]
    rows[200:300] = rows[1]
    order, group = suffixes.deep_shallow(rows)
    strings = [rows[k].tobytes() for k in order]
    assert len(set(zip(group, strings))) == len(set(strings)) == group[-1] + 1


def test_leaks(spark, docs, none, texts):
    items = [(0, texts[3]), (1, " ".join(texts[4].split()[5:35])), (2, None), (3, ""), (4, "one two three"), (1, " ".join(texts[4].split()[5:35]))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, benchmark).collect()}
    want = set()
    for d, t in enumerate(texts):
        w = tokens(t)
        for i, x in items:
            x = tokens(x)
            width = min(5, len(x))
            if not x:
                continue
            wanted = Counter(tuple(x[k:k + width]) for k in range(len(x) - width + 1))
            for s in range(max(1, len(w) - len(x) + 1)):
                own = w[s:s + len(x)]
                have = Counter(tuple(own[k:k + width]) for k in range(len(own) - width + 1))
                if have and sum((have & wanted).values()) >= 0.8 * sum((have | wanted).values()):
                    want.add((d, i))
    assert got == want and len(want) > 3
    assert decontaminate.find_leaks(none, benchmark).count() == 0
    assert decontaminate.without_leaks(docs, benchmark.limit(0)).count() == len(texts)


def test_fingerprints_in_a_small_plan(spark):
    rng = np.random.default_rng(8)
    values = [int(v) for v in rng.integers(-(1 << 63), (1 << 63) - 1, 60)]
    sets = [values[:1], [-1], values[:2], values[:2] * 3, values[:7], values, values[5:40] + values[5:9] * 4, [values[0], -1 - values[0]]]
    rows = spark.createDataFrame(list(enumerate(sets)), "k bigint, h array<bigint>")
    found = decontaminate.fingerprints(rows, ["k"], "h")
    other = {r["x"]: r["y"] for r in rows.select(F.explode("h").alias("x")).select("x", F.xxhash64(F.lit(77), "x").alias("y")).collect()}

    def majority(hashes):
        bits = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
        return bits - (bits >> 63 << 64)

    got = {r["k"]: (r["f0"], r["f1"]) for r in found.collect()}
    assert got == {k: (majority(s), majority([other[x] for x in s])) for k, s in enumerate(sets)}
    prints = found.select("k", "f0", "f1")
    near = decontaminate.in_blocks(prints, "f0", "f1", near=True).groupBy("k", "block").agg(F.collect_set("value").alias("v"))
    for r in near.collect():
        byte = got[r["k"]][r["block"] // 8] >> 8 * (r["block"] % 8) & 255
        assert set(r["v"]) == {byte, *[byte ^ 1 << k for k in range(8)]}
    assert near.count() == 16 * len(sets)
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 10_000  # written out bit by bit it had 16,482


def test_katz(docs, none, texts):
    import math
    import zlib

    got = by_id(katz.score(docs))
    said = {i: [*tokens(t), "</s>"] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in said}
    pairs = {i: list(zip(["<s>", *w[:-1]], w)) for i, w in said.items()}
    c = Counter(w for i in said if not held[i] for w in said[i])
    c2 = Counter(p for i in said if not held[i] for p in pairs[i])
    context = Counter()
    for (a, _), r in c2.items():
        context[a] += r
    n, d1, d2 = sum(c.values()), katz.good_turing(Counter(c.values())), katz.good_turing(Counter(c2.values()))
    word = {w: d1.get(r, 1.0) * r / (n + 1) for w, r in c.items()}
    unknown = 1 - sum(word.values())
    kept, known = Counter(), Counter()
    for (a, b), r in c2.items():
        kept[a] += d2.get(r, 1.0) * r / (context[a] + 1)
        known[a] += word[b]

    def p(a, b):
        if (a, b) in c2:
            return d2.get(c2[a, b], 1.0) * c2[a, b] / (context[a] + 1)
        return word.get(b, unknown) * ((1 - kept[a]) / (1 - known[a]) if a in context else 1)

    assert all(abs(sum(p(a, b) for b in [*c, "never seen"]) - 1) < 1e-9 for a in ["<s>", *list(c)[:20]] if a in context)
    for i, w in said.items():
        assert abs(got[i]["score"] - sum(math.log10(p(a, b)) for a, b in pairs[i])) < 1e-6
        assert abs(got[i]["base_score"] - sum(math.log10((c[x] + 1) / (n + len(c) + 1)) for x in w)) < 1e-6
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"], got[i]["held_out"]) == (len(w), sum(x in c for x in w), n, held[i])
    assert katz.score(none).count() == 0


def test_katz_takes_texts_in_pieces(texts):
    data = [(t or "").encode() for t in texts]
    pieces = list(katz._hashed(data * 40))
    h, counts = np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces])
    own = [np.append(katz.hashing.word_hashes([t])[0], katz.END) for t in data] * 40
    assert counts.tolist() == [len(o) for o in own] and (h == np.concatenate(own)).all()
    assert len(pieces) < 3

    ids = [np.array(x, np.uint32).tobytes() for x in ([7, 8, 1], [], [9], [1, 1])]
    (pair, text), = katz._pairs(ids)
    start = katz.START_ID
    assert [(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in pair] == [(start, 7), (7, 8), (8, 1), (start, 9), (start, 1), (1, 1)]
    assert text.tolist() == [0, 0, 0, 2, 3, 3]
    assert "array" not in katz.PART  # counts are flat columns, which Spark writes and reads faster


def test_katz_refuses_more_words_than_ids(spark, monkeypatch):
    configure_llm(spark)
    rows = spark.createDataFrame([(1, "one two three"), (3, "four five")], "doc_id bigint, text string")
    monkeypatch.setattr(katz, "START_ID", 4)
    with pytest.raises(ValueError, match="distinct words"):
        katz.score(rows, held_out=F.lit(False))


def test_convnet_learns(spark, none):
    rng = np.random.default_rng(4)
    rows = [(i, "".join(rng.choice(list("abcdef "), 1500)) + (" ###" * 5 if i % 2 else ""), 1 - i % 2) for i in range(800)]  # enough for some hundred steps
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    weights = convnet.train(df.drop("quality"), df.select("doc_id", "quality"))
    scored = convnet.classify(df, weights).collect()
    held = [r for r in scored if __import__("zlib").crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum((r["score"] >= 0.5) == bool(r["quality"]) for r in held) >= 0.9 * len(held)
    net = convnet.Network.load(weights)
    assert 0 <= net.score([b""])[0] <= 1 and abs(net.score([b"abc" * 900, b"x"])[0] - net.score([b"abc" * 900])[0]) < 1e-6
    assert convnet.train(df.limit(0), df.select("doc_id", "quality")) is None
    assert convnet.classify(none, None).count() == 0
