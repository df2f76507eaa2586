"""Each operator against brute force, a library or an exact round trip."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.llm import bpe, chat, exact, leaks, quality, simhash, similar, substrings, token_counts, urls
from sievework.llm.common import load, new_path
from sievework.llm.graph import components
from sievework.llm.queries import QUERIES, URL_RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def made(seed, n, vocabulary=40, longest=60):
    """Texts that share passages."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passages = [[r.choice(words) for _ in range(r.randrange(10, 30))] for _ in range(6)]
    out = []
    for _ in range(n):
        text = [r.choice(words) for _ in range(r.randrange(longest))]
        for _ in range(r.randrange(3)):
            at = r.randrange(len(text) + 1)
            text[at:at] = r.choice(passages)
        out.append(" ".join(text))
    return out


# Chat


def test_chat_round_trip(spark):
    r = random.Random(3)
    bits = ["</turn>", "\\", "### ", "#", "<", "/turn>", "User: ", "\n", "x", "### Assistant: ", "<\\/turn>", "#\\## ", "é"]
    rows = [(c, t, r.choice(["user", "assistant", "system", "weird", "User"]), "".join(r.choice(bits) for _ in range(r.randrange(12)))) for c in range(150) for t in range(r.randrange(1, 5))]
    read = {x["conv_id"]: x for x in chat.read_chats(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for c, turns in itertools.groupby(rows, key=lambda x: x[0]):
        turns = list(turns)
        assert [(t["role"], t["text"]) for t in read[c]["turns"]] == [(t[2], t[3]) for t in turns]
        assert read[c]["round_trip"] and read[c]["loss_text"] == "".join(t[3] for t in turns if t[2] == "assistant")
        # no control string of a text survives
        assert read[c]["formatted"].count("</turn>") == len(turns)
        assert len(re.findall("### ", read[c]["formatted"])) == len(turns)


def test_chat_reader_refuses_damage(spark):
    one = spark.createDataFrame([("### User: a</turn>\n### Assistant: b",), ("### User: ### x</turn>\n",), ("User: a</turn>\n",)], "f string")
    assert [[t["ok"] for t in x[0]] for x in one.select(chat.parsed(F.col("f"))).collect()] == [[True, False], [False], [False]]


# Exact


def test_exact_index_compaction():
    r = random.Random(1)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(300)]
    rows = [(r.choice(keys), r.randrange(1000)) for _ in range(2000)]
    runs = []
    for i in range(0, len(rows), 90):
        part = rows[i : i + 90]
        one = np.ones(len(part), np.int64)
        runs.append(exact.Run(*exact.merged(exact._keys(b"".join(k for k, _ in part)), np.array([x for _, x in part]), one, one)))
    got = exact.compact(runs)
    want = collections.defaultdict(list)
    for k, i in rows:
        want[k].append(i)
    raw = exact._bytes(got.digests)
    found = {raw[32 * i : 32 * i + 32]: (int(got.ids[i]), int(got.counts[i]), int(got.kept[i])) for i in range(len(got.ids))}
    assert found == {k: (max(v), len(v), v.count(max(v))) for k, v in want.items()}
    assert list(found) == sorted(found)


@pytest.mark.parametrize("bits", [256, 4])
def test_exact_with_collisions(spark, bits):
    """With digests of four bits nearly everything collides, and the bytes decide."""
    r = random.Random(2)
    rows = [(i, f"text {r.randrange(60)}") for i in range(300)] + [(299, "text 1")]
    want = collections.defaultdict(list)
    for i, t in rows:
        want[t].append(i)
    got = exact.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), digest_bits=bits).collect()
    assert len(got) == len(rows)
    by = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    for x in got:
        group = by[x["text_sha256"]]
        assert (x["keep_id"], x["group_size"]) == (max(group), len(group))
    assert sum(x["kept"] for x in got) == len(want)


# Substrings


def brute_substrings(rows, window=13):
    first, words = {}, {i: WORD.findall(t or "") for i, t in rows}
    for i, w in words.items():
        for k in range(len(w) - window + 1):
            p = tuple(w[k : k + window])
            first[p] = min(first.get(p, i), i)
    out = {}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(window)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("block", [200, 8 << 20])
def test_substrings(spark, block):
    rows = list(enumerate(made(5, 80)))
    random.Random(0).shuffle(rows)
    got = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=block).collect()
    assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_text"]) for x in got} == brute_substrings(rows)
    texts = {i: WORD.findall(t) for i, t in rows}
    for x in got:
        for f in x["factors"]:  # the whole of every factor is there in its source, in one piece
            n = f["stop"] - f["start"]
            assert n >= 13 and f["source"] < x["doc_id"] and texts[f["source"]][f["source_start"] : f["source_start"] + n] == texts[x["doc_id"]][f["start"] : f["stop"]]


def test_substring_factors_are_contiguous(spark):
    """Two phrases of one document that stand apart there are two factors, not one."""
    w = [f"w{i}" for i in range(14)]
    rows = [(0, " ".join([*w[:13], "x", *w[1:]])), (1, " ".join(w))]
    got = {x["doc_id"]: x for x in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(f) for f in got[1]["factors"]] == [(0, 13, 0, 0), (1, 14, 0, 14)] and got[1]["n_removed"] == 14


def test_substring_places_packed():
    r = np.random.default_rng(3)
    docs = np.sort(r.integers(-50, 60, 400))
    docs[-5:] = substrings.LAST_ID
    places = r.integers(0, 2**31 - 1, 400)
    for n in (0, 1, 400):
        d, p = substrings.unpacked(substrings.packed(docs[:n], places[:n]))
        assert (d == docs[:n]).all() and (p == places[:n]).all()


# Decontamination


def test_masks_hit():
    def missed(length, changes):
        places = [{s + i for i, c in enumerate(m) if c == "1"} for m in leaks.MASKS for s in range(length - len(m) + 1)]
        return [c for c in itertools.combinations(range(length), changes) if all(p & set(c) for p in places)]

    assert not missed(13, 2) and not missed(15, 3)


def test_leaks_planted(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    items = [(i, [word() for _ in range(r.choice([8, 12, 15, 25, 50]))]) for i in range(40)]
    docs, want = [], set()
    for d in range(200):
        text = [word() for _ in range(r.randrange(5, 200))]
        if d % 2:
            i, passage = r.choice(items)
            cut = passage if len(passage) < 25 or d % 3 else passage[5:20]
            cut = list(cut)
            for k in r.sample(range(1, len(cut) - 1), {8: 0, 12: 1, 15: 2, 25: 3, 50: 5}.get(len(cut), 2)):
                cut[k] = word()
            at = r.randrange(len(text) + 1)
            text[at:at] = [w.upper() + "," for w in cut]
            want.add((d, i))
        docs.append((d, " ".join(text)))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (8 << 20, 500):
        got = {(x["doc_id"], x["item_id"]) for x in leaks.find_leaks(frame, bench, block_bytes=block).collect()}
        assert got == want


def test_leaks_against_all_offsets(spark, data):
    """Every document against every passage at every offset: a span of 13 words or more, four in five of them equal, is found; what is found is such a span. Documents with several passages and parts of them too."""
    r = random.Random(14)
    items = [(x["item_id"], leaks.words_of(x["text"])) for x in load(spark, data, "benchmark").collect()][:25]
    docs = []
    for d in range(120):
        text = [b"q%d" % r.randrange(5000) for _ in range(r.randrange(20, 90))]
        for _ in range(r.randrange(3)):
            w = r.choice(items)[1]
            n = r.randrange(8, len(w) + 1)
            s = r.randrange(len(w) - n + 1)
            part = [b"z" if r.random() < r.choice([0, 0.1, 0.25]) else x for x in w[s : s + n]]
            at = r.randrange(len(text))
            text[at:at] = part
        docs.append((d, text))
    found = collections.defaultdict(list)
    table = spark.createDataFrame([(i, b" ".join(w).decode()) for i, w in items], "item_id long, text string")
    for x in leaks.find_leaks(spark.createDataFrame([(d, b" ".join(t).decode()) for d, t in docs], "doc_id long, text string"), table).collect():
        found[x["doc_id"], x["item_id"]].append((x["start"], x["start"] + x["n_words"], x["n_equal"]))
    for d, text in docs:
        for i, w in items:
            for s, e, n in found[d, i]:
                assert e - s >= 13 and n >= 0.8 * (e - s)
                assert any(sum(a == b for a, b in zip(text[s:e], w[o : o + e - s], strict=False)) == n for o in range(len(w) - (e - s) + 1))
            for offset in range(-len(w) + 13, len(text) - 12):
                lo, hi = max(0, offset), min(len(text), offset + len(w))
                equal = np.array([text[k] == w[k - offset] for k in range(lo, hi)])
                for k in range(len(equal) - 12):  # the guarantee: 13 words with up to two substitutions, both ends equal
                    if equal[k] and equal[k + 12] and equal[k : k + 13].sum() >= 11:
                        assert any(s <= lo + k + 12 and lo + k < e for s, e, _ in found[d, i])


# Quality


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op4_quality"](spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    out = got[got.held_out]
    rank = out.score.rank()
    good = out.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.95 and (out.predicted == out.quality).mean() > 0.9
    assert ((got.predicted == 1) == (got.score >= 0.3)).all()


def test_quality_ignores_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = load(spark, sf, "documents"), load(spark, sf, "labels")
    other = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, labels) == quality.fit(docs, other)


def test_quality_by_hand(spark):
    """The whole of op4 fitted and scored again in plain Python: sample, dictionaries, curve, prior."""
    import zlib

    import zstandard

    sf = "/root/testdata/sf0.01"
    got = {x["doc_id"]: x for x in QUERIES["op4_quality"](spark, sf).collect()}
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    texts = {int(i): t or "" for i, t in zip(docs.doc_id, docs.text, strict=True)}
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    known = {int(i): int(y) for i, y in zip(labels.doc_id, labels.quality, strict=True) if not out(i) and int(i) in texts}
    at = {i: np.uint64(xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 42)).astype(np.int64) for i in known}
    order = sorted(known, key=lambda i: (at[i], i))
    chosen = [i for y in (0, 1) for i in [j for j in order if known[j] == y][:3000]]

    def spread(t):
        step = (len(t) - 512) / 15
        return t if len(t) <= 8192 else "".join(t[int(i * step) : int(i * step) + 512] for i in range(16))

    def trained(y):
        pieces = [d[k : k + 512] for d in (spread(texts[i]).encode() for i in sorted(chosen, key=lambda i: (at[i], i)) if known[i] == y and at[i] % 2 == 0) for k in range(0, len(d), 512)]
        return zstandard.ZstdCompressor(level=1, dict_data=zstandard.train_dictionary(min(32 << 10, max(256, sum(map(len, pieces)) // 4)), pieces), write_content_size=False, write_checksum=False, write_dict_id=False)

    good, bad = trained(1), trained(0)

    def difference(t):
        d = t.encode()
        return sum(len(bad.compress(d[k : k + 512])) - len(good.compress(d[k : k + 512])) for k in range(0, len(d), 512))

    half = [i for i in chosen if at[i] % 2]
    y = np.array([known[i] for i in half], float)
    mean = sum(difference(texts[i]) for i in half if known[i]) / sum(len(texts[i].encode()) for i in half if known[i])
    number = lambda t: (difference(t) + 150 * mean) / (len(t.encode()) + 150)
    x = np.array([number(texts[i]) for i in half])
    spread_x, w, b = x.std(), 0.0, 0.0
    for _ in range(200):  # Newton's steps for one weight and the offset, with the same small ridge
        p = 1 / (1 + np.exp(-(w * x / spread_x + b)))
        v = p * (1 - p)
        h = np.array([[(v * x * x).sum() / spread_x**2 + 1e-3, (v * x).sum() / spread_x], [(v * x).sum() / spread_x, v.sum() + 1e-3]])
        w, b = np.array([w, b]) + np.linalg.solve(h, [((y - p) * x).sum() / spread_x - 1e-3 * w, (y - p).sum() - 1e-3 * b])
    share, prior = y.mean(), np.mean(list(known.values()))
    b += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    assert set(got) == set(texts)
    for i, t in texts.items():
        want = 1 / (1 + np.exp(-(w / spread_x * number(t) + b)))
        assert abs(got[i]["score"] - want) < 1e-6 and got[i]["held_out"] == out(i) and got[i]["predicted"] == int(got[i]["score"] >= 0.3)


# URLs


def test_urls_by_hand(spark, data):
    """The whole of op6 in plain Python: word counts, splits, class counts, verdicts."""
    import regex

    pages = pd.read_parquet(f"{data}/pages.parquet")
    counts = collections.Counter()
    for h in pages.html:
        counts.update(w for w in regex.split(r"[^\p{L}]+", re.sub("<[^>]*>", " ", h or "").lower()) if 0 < len(w) <= 24)
    total = sum(counts.values())

    def split(label):
        best = [(0.0, [])]
        for e in range(1, len(label) + 1):
            each = []
            for s in range(max(0, e - 24), e):
                n = counts.get(label[s:e])
                each.append((best[s][0] + (np.log(total) - np.log(n) if n else np.log(total) + (e - s) * np.log(10)), s))
            cost, s = min(each)
            best.append((cost, [*best[s][1], label[s:e]]))
        return best[-1][1]

    def tokens(host, path):
        out = []
        for part in re.split(r"[.\-_:@]+", host):
            for run in re.findall(r"\d+|\D+", part):
                out += ["h:0"] if run.isdecimal() else ["h:" + w for w in split(run)]
        return out + ["p:0" if run[0].isdecimal() else "p:" + run for run in re.findall(r"\d+|[^\W\d_]+", path.lower())]

    judged = {}
    for i, url in zip(pages.page_id, pages.url, strict=True):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        judged[int(i)] = host, path, max(fits) if fits else None, tokens(host, path)
    classes = collections.Counter(r[2] for _, _, r, _ in judged.values() if r)
    words = {c: collections.Counter(t for _, _, r, ts in judged.values() if r and r[2] == c for t in ts) for c in classes}
    size = len({t for c in words.values() for t in c}) + 1

    def odds(ts):
        out = np.log(classes["block"]) - np.log(classes["allow"])
        for t in ts:
            out += np.log((words["block"][t] + 1) / (sum(words["block"].values()) + size)) - np.log((words["allow"][t] + 1) / (sum(words["allow"].values()) + size))
        return out

    got = {x["page_id"]: x for x in QUERIES["op6_url_filter"](spark, data).collect()}
    assert set(got) == set(judged) and set(classes) == {"allow", "block"}
    for i, (host, path, rule, ts) in judged.items():
        x = got[i]
        assert (x["host"], x["path"], x["rule"]) == (host, path, rule and rule[1])
        if rule:
            assert x["verdict"] == rule[2] and x["score"] is None
        else:
            assert abs(x["score"] - odds(ts)) < 1e-9 and x["verdict"] == ("block" if x["score"] > 0 else "allow")


def test_url_parts_and_rules(spark):
    def brute(url):
        host = path = ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        best = None
        for verdict, h, p in URL_RULES:
            if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
                best = h + p, verdict
        return host, path, best

    r = random.Random(6)
    urls_ = [None, "", "://", "http:/x"] + ["".join(r.choice(["http", "://", "/", "?", "#", "en/", "es/", "fr/", "www.", "example.com", "Example.COM", "a.net", "net", "com", ".", "É", "\n"]) for _ in range(r.randrange(8))) for _ in range(500)]
    urls_ += [f"http://{h}{p}" for h in ("example.com", "www.example.com", "x.www.example.com", "a.net", "net", "notexample.com") for p in ("/en/1", "/es/2", "/fr/", "", "/", "?/en/")]
    pages = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string")
    model = urls.fit_classes(pages, urls.WordModel({"a": 1}, 1), URL_RULES)
    for x in urls.judge_urls(pages, model, URL_RULES).collect():
        host, path, best = brute(urls_[x["page_id"]])
        assert (x["host"], x["path"], x["rule"]) == (host, path, best and best[0])
        assert x["verdict"] == (best[1] if best else "block" if x["score"] > 0 else "allow")


def test_viterbi_is_best():
    model = urls.WordModel({"the": 50, "rapist": 2, "therapist": 9, "car": 20, "cart": 5, "art": 9, "s": 3}, 98)

    def cost(words):
        return sum(model.cost.get(w, model.log_total + len(w) * np.log(10)) for w in words)

    def splits(s):
        return [[]] if not s else [[s[:i], *rest] for i in range(1, len(s) + 1) for rest in splits(s[i:])]

    for s in ("therapist", "carts", "thecarart", "xtheq", "cartherapist"[:9], ""):
        assert abs(cost(model.split(s)) - min(cost(x) for x in splits(s))) < 1e-9
    assert model.split("thecart") == ["the", "cart"]


def test_bayes_counts():
    m = urls.WordModel({"good": 5, "bad": 5}, 10, {"allow": 3, "block": 2}, {"allow": {"h:good": 3, "p:x": 1}, "block": {"h:bad": 2}})
    assert m.score("good", "/x") < 0 < m.score("bad", "/")
    v = 3 + 1
    want = np.log(2 / 5) - np.log(3 / 5) + np.log(3 / (2 + v)) - np.log(1 / (4 + v))
    assert abs(m.score("bad", "") - want) < 1e-9


def test_url_counts_are_whole(spark):
    """Rare words split hosts, and pairs of class and word that stand once count, however many there are."""
    many = "/".join(chr(97 + i // 26**3 % 26) + chr(97 + i // 26**2 % 26) + chr(97 + i // 26 % 26) + chr(97 + i % 26) for i in range(60_000))
    rows = [(1, f"http://a.good/{many}", "zebra lion lion"), (2, f"http://b.bad/{many}/zzzzq", "<p>lion</p>"), (3, "http://zebralion.org/zzzzq", None), (4, "http://lion.org/aaab", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = [("allow", "good", "/"), ("block", "bad", "/")]
    words = urls.fit_words(pages)
    assert words.counts == {"zebra": 1, "lion": 3} and words.total == 4 and words.split("zebralion") == ["zebra", "lion"]
    model = urls.fit_classes(pages, words, rules)
    assert model.classes == {"allow": 1, "block": 1} and model.words["block"] == {"p:zzzzq": 1, "p:aaab": 1} and model.totals["block"] == model.totals["allow"] + 1
    verdicts = {r["page_id"]: r["verdict"] for r in urls.judge_urls(pages, model, rules).collect()}
    assert verdicts == {1: "allow", 2: "block", 3: "block", 4: "allow"}


# SimHash


def brute_fingerprint(text, size=3):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_simhash_query(spark, data):
    docs = pd.read_parquet(f"{data}/documents.parquet")
    fp = {i: brute_fingerprint(t) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    want = grouped([(a, b) for a, b in itertools.combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 2], fp)
    got = QUERIES["op7_simhash"](spark, data).collect()
    assert {x["doc_id"]: (x["fingerprint"], x["component_id"]) for x in got} == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


@pytest.mark.parametrize("crowd", [32, 2])
def test_simhash_links(spark, crowd):
    r = random.Random(7)
    found = {r.getrandbits(64) for _ in range(40)} | {0, 1 << 63, (1 << 63) | 1}
    for x in list(found)[:20]:
        for _ in range(30):
            x ^= 1 << r.randrange(64)
            found.add(x)
    signed = {simhash._signed(x): x for x in found}
    want = grouped([(a, b) for a, b in itertools.combinations(signed, 2) if (signed[a] ^ signed[b]).bit_count() <= 2], signed)
    roots = components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), crowd=crowd)).collect()
    got = {x: x for x in signed} | {x["node"]: x["root"] for x in roots}
    assert got == want


def test_ring_keys_cover():
    """Whatever two bits differ, some key is equal and its chain within the budgets."""
    keys = simhash.masks()
    for a, b in itertools.combinations_with_replacement(range(64), 2):
        diff = (1 << a) | (1 << b)
        assert any(not diff & m and all((diff & s).bit_count() <= (j + 1) * 2 // 6 for j, s in enumerate(steps)) for m, steps in keys)


def test_components(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(200)] + [(r.randrange(300, 500), r.randrange(300, 500)) for _ in range(120)] + [(7, 7)]
    nodes = {x for e in edges for x in e}
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = grouped(edges, nodes)
    assert got == {n: w for n, w in want.items() if n != w}


# Similar texts


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
    return words


def near_groups(docs, least=0.8):
    """id -> smallest id of its group, by all pairs: similarity of five-word shingles, or fingerprints that differ in two bits at most. docs: id -> words."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in docs.items()}
    fps = {i: simhash.fingerprint(" ".join(w).encode()) for i, w in docs.items()}
    alike = lambda a, b: (both := len(sets[a] & sets[b])) and both >= least * len(sets[a] | sets[b])
    return grouped([(a, b) for a, b in itertools.combinations(docs, 2) if (fps[a] ^ fps[b]).bit_count() <= 2 or alike(a, b)], set(docs))


@pytest.mark.parametrize("few,block,leaders", [(16, 192, 64), (2, 8, 3), (1, 3, 1)])
def test_similar(spark, monkeypatch, few, block, leaders):
    """Equal to all pairs, whatever the sizes at which a key is dealt in tiles."""
    for name, value in (("FEW", few), ("BLOCK", block), ("LEADERS", leaders), ("BLOCK_SHINGLES", block * 100)):
        monkeypatch.setattr(similar, name, value)
    r = random.Random(9)
    docs = []
    for _ in range(60):
        base = [f"v{r.randrange(5000)}" for _ in range(r.choice([9, 40, 120, 400]))]
        docs += [base, *(edited(r, base, r.randrange(1, 1 + max(1, len(base) // 30))) for _ in range(r.choice([0, 0, 1, 2, 12])))]
    docs += [["one"], ["one", "two"], ["one"], [], []]
    r.shuffle(docs)
    docs = dict(enumerate(docs))
    kept = {x["doc_id"] for x in simhash.one_of_each(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")).collect()}
    assert kept == {i for i, w in near_groups(docs).items() if i == w}


def test_prefixes_meet():
    """Two sets of similarity 0.8 share a shingle of their prefixes in any order."""
    r = np.random.default_rng(4)
    for _ in range(300):
        n = int(r.integers(1, 60))
        a = r.choice(200, n, replace=False).astype(np.uint64)
        b = np.unique(np.concatenate([a[: n - n // 9], r.choice(200, n // 9).astype(np.uint64)]))
        a = np.sort(a)
        both = len(np.intersect1d(a, b))
        order = similar.Order(r.permutation(200)[: int(r.integers(0, 200))].astype(np.uint64))
        if similar.enough(np.int64(both), len(a), len(b), 0.8):
            assert set(order.prefix(a, 0.8).tolist()) & set(order.prefix(b, 0.8).tolist())


def test_overlaps(monkeypatch):
    monkeypatch.setattr(similar, "COLUMNS", 7)
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 90, int(n)).astype(np.uint64)) for n in r.integers(0, 60, 30)]
    got = similar.overlaps(sets[:13], sets[13:])
    assert [[len(np.intersect1d(a, b)) for b in sets[13:]] for a in sets[:13]] == got.tolist()


def families(seed, size):
    """Two families of size near copies each; across them the similarity is 0.8 to 0.9, within them over 0.99."""
    base = [f"v{seed}x{i}" for i in range(600)]
    other = [f"y{i}" if i % 55 == 30 else w for i, w in enumerate(base)]
    return [[*b, f"z{f}x{i}"] for f, b in enumerate((base, other)) for i in range(size)]


def test_similar_families(spark):
    """Each document has more than ten nearer ones in its own family, and only farther ones link the two."""
    docs = families(5, 30)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in docs]
    across = [len(a & b) / len(a | b) for a in sets[:30] for b in sets[30:]]
    assert 0.8 <= min(across) and max(across) < 0.9
    kept = simhash.one_of_each(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")).collect()
    assert [x["doc_id"] for x in kept] == [0]


def test_similar_crowd(spark, monkeypatch):
    """A key far larger than a tile: every document of the group is linked to it."""
    monkeypatch.setattr(similar, "BLOCK", 20)
    r = random.Random(12)
    base = [f"v{i}" for i in range(400)]
    docs = [edited(r, base, 2) for _ in range(400)]
    kept = simhash.one_of_each(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")).collect()
    assert [x["doc_id"] for x in kept] == [0]


# Byte pairs


@pytest.fixture(scope="module")
def coder():
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.ranks_of(path)
    return bpe.Codec(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(), st.text(max_size=6), st.integers(0, 50), st.integers(0, 10))
def test_bpe_like_library(coder, text, more, start, size):
    own, library = coder
    assert own.encode(text) == library.encode_ordinary(text)
    assert own.decode(own.packed(text)) == text.encode()
    d = bpe.Document(own, text)
    d.append(more)
    assert d.ids() == library.encode_ordinary(text + more)
    changed = (text + more)[:start] + more + (text + more)[start + size :]
    d.replace(min(start, len(text + more)), min(start + size, len(text + more)), more)
    assert d.ids() == library.encode_ordinary(changed)


def test_bpe_table_of_bytes(coder):
    own, _ = coder
    r = random.Random(10)
    data = bytes(r.choice(b"abthe in\xc3\xa9") for _ in range(400))
    table = bpe.Table(own)
    for i in range(0, 400, 7):
        table.append(data[i : i + 7])
    for end in (0, 1, 9, 200, 400):  # each prefix's entry is the last token of its own encoding
        assert table.last[end] == (own.merged(data[:end])[-1] if end else -1)
    assert table.ids() == own.merged(data)
    table.replace(100, 130, b"qq the")
    assert table.ids() == own.merged(data[:100] + b"qq the" + data[130:])


def test_bpe_query(spark, data, coder):
    got = {x["doc_id"]: x for x in QUERIES["op9_byte_bpe"](spark, data).collect()}
    for i, t in pd.read_parquet(f"{data}/documents.parquet")[["doc_id", "text"]].itertuples(index=False):
        ids = coder[1].encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


# Token counts


def test_token_counts_and_cache(spark, data):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = load(spark, data, "documents")
    table = docs.toPandas()
    want = {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in zip(table.doc_id, table.text, strict=True)}
    cache = new_path(spark, "cache")
    half = docs.filter("doc_id % 2 = 0")
    token_counts.count_tokens(half, P.path("byte_bpe_50k.json"), cache).collect()
    held = token_counts.read_cache(spark, cache).count()
    got = token_counts.count_tokens(docs, P.path("byte_bpe_50k.json"), cache).collect()
    assert {x["doc_id"]: x["n_tokens"] for x in got} == want
    cached = token_counts.read_cache(spark, cache)
    assert held == half.select("text").distinct().count() and cached.count() == docs.select("text").distinct().count()
    # a filter that is too full holds back most texts; each digest is encoded once all the same
    full = new_path(spark, "cache")
    for times in (1, 2):
        got = token_counts.count_tokens(docs.unionAll(docs.filter("doc_id < 100")), P.path("byte_bpe_50k.json"), full, bloom_bits=64 * times).collect()
        assert {x["doc_id"]: x["n_tokens"] for x in got} == want and len(got) == docs.count() + docs.filter("doc_id < 100").count()
        assert token_counts.read_cache(spark, full).count() == cached.count()
    special = spark.createDataFrame([(1, "a<|endoftext|>b"), (2, None)], "doc_id long, text string")
    assert {x["doc_id"]: x["n_tokens"] for x in token_counts.count_tokens(special, P.path("byte_bpe_50k.json"), cache).collect()} == {1: 3, 2: 0}


def test_other_tokenizers(spark):
    rows = spark.createDataFrame([(1, "Hello world"), (2, None)], "doc_id long, text string")
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        got = {x["doc_id"]: x["n_tokens"] for x in token_counts.count_tokens(rows, P.path(name), new_path(spark, "cache")).collect()}
        assert got[1] >= 2 and got[2] == 0


# Pipeline


def test_pipeline(spark, data):
    import corpus_pipeline
    import tiktoken

    got = {x["doc_id"]: x for x in corpus_pipeline.run(spark, data).collect()}
    docs = load(spark, data, "documents")
    good = {x["doc_id"] for x in quality.score_documents(docs, quality.fit(docs, load(spark, data, "labels"))).collect() if x["predicted"]}
    texts = {x["doc_id"]: x["text"] or "" for x in docs.collect() if x["doc_id"] in good}
    last = {t: i for i, t in sorted(texts.items())}
    texts = {i: t for i, t in texts.items() if last[t] == i}
    low = {i: WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) for i, t in texts.items()}
    root = near_groups(low)
    texts = {i: t for i, t in texts.items() if root[i] == i}
    items = [leaks.words_of(x["text"]) for x in load(spark, data, "benchmark").collect()]

    def leaked(text):
        w = b" " + b" ".join(leaks.words_of(text)) + b" "
        return any(b" " + b" ".join(i[k : k + 13]) + b" " in w for i in items if len(i) >= 13 for k in range(len(i) - 12))

    texts = {i: t for i, t in texts.items() if not leaked(t)}
    assert set(got) == set(texts)
    ranks = bpe.ranks_of(P.path("byte_bpe_multi_50k.tiktoken"))
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(got[i]["n_tokens"] == len(e.encode_ordinary(t)) for i, t in texts.items())
    assert all(f.__module__ == "corpus_pipeline" for _, f in corpus_pipeline.STAGES)


def test_queries_are_registered():
    import __spark_entry__

    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in __spark_entry__.queries()} and "pipeline" in __spark_entry__.queries()


def test_sketches_bound_overlaps():
    r = np.random.default_rng(3)
    for k in range(60):
        pool = r.integers(0, 1 << 63, 400).astype(np.uint64) << np.uint64(k % 2) | (r.integers(0, 3, 400).astype(np.uint64) << np.uint64(48))
        pool = pool if k % 3 else r.integers(0, 400, 400).astype(np.uint64)  # all of one upper part
        a, b = (np.unique(r.choice(pool, int(r.integers(1, 300)))) for _ in range(2))
        x, y = (similar.marks(similar.sketch(s)) for s in (a, b))
        assert len(np.unique(x)) == len(a) and len(similar.sketch(b)) == 2 * len(b)
        assert len(np.intersect1d(a, b)) <= len(np.intersect1d(x, y)) <= min(len(a), len(b))


def test_loose_copies_send_no_whole_sets(spark, monkeypatch):
    """Of a crowded group of loose copies, whole sets are made of those only that are alike."""
    r, made, write = np.random.default_rng(5), {}, similar.written

    def recorded(df, name):
        out = write(df, name)
        made[name] = made.get(name, 0) + (out.count() if name in ("sketches", "shingle-sets") else 0)
        return out

    monkeypatch.setattr(similar, "written", recorded)
    monkeypatch.setattr(similar, "FEW", 4)
    base = [f"w{i}" for i in range(60)]
    docs = [base[:24] + [f"u{i}x{j}" for j in range(12)] for i in range(30)]  # 20 of 32 shingles in common: a similarity of 0.45
    docs += [docs[7][:-1] + ["end"], docs[9][:-2]]
    kept = simhash.one_of_each(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string").repartition(3)).collect()
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in docs]
    assert sorted(x["doc_id"] for x in kept) == [i for i in range(32) if not any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in range(i))] == list(range(30))
    assert made["sketches"] > 8 and made["shingle-sets"] <= 8


def test_memory_is_handed_back(spark):
    """What a task freed goes back to the system though a later allocation lies above it, and every executor's JVM collects its garbage at a release."""
    from types import SimpleNamespace

    from sievework.llm import common

    def resident():
        return int(re.search(r"Pss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

    seen = []

    def run(batches):
        held = [b"x" * 2000 + bytes([i % 256]) for i in range(100_000)]
        seen.append(held[-1])  # stays, and keeps malloc from giving up what is below it
        seen.append(resident())
        del held
        yield from batches

    assert list(common.lean(run)([1, 2])) == [1, 2]
    assert resident() < seen[1] - 150

    management = spark.sparkContext._jvm.java.lang.management.ManagementFactory
    collected = lambda: sum(b.getCollectionCount() for b in management.getGarbageCollectorMXBeans())
    context = SimpleNamespace(master="spark://host:7077", _jvm=spark.sparkContext._jvm, defaultParallelism=3)
    before = collected()
    common.release(SimpleNamespace(sparkContext=context, range=spark.range))
    assert collected() >= before + 4  # the driver's own, and one of each task


def test_pipeline_stages_release_before_python_work(spark, data, monkeypatch):
    import corpus_pipeline

    docs, calls = load(spark, data, "documents"), []
    monkeypatch.setattr(corpus_pipeline, "release", calls.append)
    for stage in (corpus_pipeline.decontaminate_stage, corpus_pipeline.encode_stage):
        stage(spark, docs, data)
    assert calls == [spark, spark]
