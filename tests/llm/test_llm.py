"""The corpus operators against brute force, exact round trips and held-out accuracy; odd rows."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import op1_langid, op2_media, op3_sharding, op4_mix, op5_bpe, op6_toxicity, op7_pii, op8_spotsigs, op9_neardup, op10_lm

SF = "/root/testdata/sf0.001"
ODD = [(1, "the cat sat on the mat and looked at the bird", "en", "a"), (1, "the cat sat on the mat and looked at the bird", "en", "a"), (None, "a word", None, None), (2, None, "de", "b"), (3, "", "en", None), (4, " \n\t", "fr", "a"), (5, "x" * 30000 + " mail me@ex.org", "en", "b")]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 7, "clash") for r in ODD], "doc_id long, text string, lang string, source string, n_chars long, key string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_langid(spark, odd, empty):
    rows = op1_langid.op1_langid(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.9
    assert op1_langid.predict(empty.selectExpr("doc_id", "text", "false held_out"), op1_langid.fit(odd.selectExpr("doc_id key", "text", "lang"))).count() == 0
    none = op1_langid.fit(empty.selectExpr("doc_id key", "text", "lang"))
    got = op1_langid.predict(odd.selectExpr("doc_id", "text", "false held_out"), none).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got} == {"und"}


def test_media_round_trip_and_carving(spark, odd):
    rows = op2_media.media_digest(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    for i, t, *_ in ODD:
        raw = (t or "").encode()
        pad = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        assert by[i].payload_sha256 == hashlib.sha256(pad).hexdigest() and by[i].tail_crc32 == zlib.crc32(pad[-64:]) and by[i].n_bytes == len(raw)
    assert op2_media.media_digest(odd.where("false")).count() == 0 and {r.feature.split(";")[0] for r in rows} == {"type=audio/wav"}
    for hostile in (b"%PDF-1" * 40000, b"\xff\xd8\xff\xe0\0\x02\xff\xda\0\x02" * 20000, b"OggS\0" * 40000, b"\0\0\0\x08ftyp" * 30000):
        began = __import__("time").time()
        op2_media.sniff(hostile, op2_media.automaton())
        assert __import__("time").time() - began < 2
    inner = op2_media.to_wav(b"abcd" * 16)
    blob = b"junk" + inner + b"RIFFxxxx" + b"BM"
    hits = op2_media.sniff(blob, op2_media.automaton())
    assert op2_media.carve(blob, hits) == [("audio/wav", inner)] and op2_media.correct_type("image/png", hits) == "image/png"


def test_sharding(spark, odd, empty):
    rows = op3_sharding.op3_sharding(spark, SF).collect()
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s])) for s in counts)
    assert rows and sorted(map(tuple, op3_sharding.op3_sharding(spark, SF).collect())) == sorted(map(tuple, rows))
    for n in (1, 2, 3, 17, 1000):
        assert sorted(op3_sharding.feistel(np.arange(n), n, 5)) == list(range(n))
    assert op3_sharding.shards(empty.select("doc_id"), ["doc_id"]).count() == 0


def test_sharding_of_repeated_rows(spark):
    """Rows that are all alike, besides a column named like the operator's own, are spread and numbered."""
    alike = spark.range(0, 4000, 1, 4).selectExpr("7L doc_id", "id __tie")
    sizes = [r["count"] for r in op3_sharding.ranged(alike, ["doc_id"], 8).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1500
    got = op3_sharding.shards(alike, ["doc_id"]).collect()
    assert sorted(r["row_no"] for r in got) == list(range(4000)) and sorted(r["__tie"] for r in got) == list(range(4000))
    assert len({(r["shard"], r["slot"]) for r in got}) == 4000


def test_sharding_by_brute_force(spark, texts):
    """Rows in the order of (id, crc, size), each number walked through the permutation one by one."""
    order = sorted((i, zlib.crc32(t.encode()), len(t.encode()) + 8) for i, t in texts.items())
    n = len(order)

    def place(x):
        b = op3_sharding.half_bits(n)
        while True:
            left, right = x >> b, x & ((1 << b) - 1)
            for k in op3_sharding.round_keys(op3_sharding.SEED):
                f = (right + k) % op3_sharding._P * op3_sharding._A % op3_sharding._P
                f = (f ^ (f >> 15)) * op3_sharding._B % op3_sharding._P
                left, right = right, left ^ (f & ((1 << b) - 1))
            x = (left << b) | right
            if x < n:
                return x

    want = sorted((i, size, crc, "rows", place(k) % 24, place(k) // 24, None) for k, (i, crc, size) in enumerate(order))
    assert sorted(map(tuple, op3_sharding.op3_sharding(spark, SF).collect())) == want


def test_sharding_of_odd_rows(odd):
    rows = op3_sharding.shards(odd.select("doc_id", "key", F.lit(8).alias("size")), ["doc_id", "size"]).collect()
    assert len(rows) == len(ODD) and len({(r.shard, r.slot) for r in rows}) == len(ODD) and next(r.row_no for r in rows if r.doc_id is None) == 0


def fill(budget, nodes):
    """Water-filling by repetition: nodes (name, cap, weight)."""
    out, left = {}, list(nodes)
    while True:
        w = sum(x[2] for x in left)
        full = [x for x in left if x[1] * w <= x[2] * budget]
        if not full:
            return out | {n: x * budget // w for n, _, x in left}
        for n, c, _ in full:
            out[n], budget = c, budget - c
        left = [x for x in left if x not in full]
        if not left:
            return out


def test_mixing_against_brute_force(spark, odd, empty):
    p = op4_mix.MixParams()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    h32 = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16)
    tree, got = {}, Counter((r.doc_id, r.epoch) for r in op4_mix.op4_mix(spark, SF).collect())
    for r in docs.collect():
        path = (f"d{h32(r.source) % p.domains}", r.lang, r.source)
        tree.setdefault(path, []).append((r.doc_id, len(words(r.text))))
    size = {k: sum(n for _, n in v) for k, v in tree.items()}
    budget, want = {(): sum(size.values()) * p.percent // 100}, Counter()
    for depth, level in enumerate(op4_mix.LEVELS):
        new = {}
        for parent, b in budget.items():
            kids = {}
            for k, n in size.items():
                if k[:depth] == parent:
                    kids[k[depth]] = kids.get(k[depth], 0) + n * p.max_epochs
            shares = fill(b, [(n, c, p.weights[level].get(n, p.default_weight)) for n, c in sorted(kids.items())])
            new |= {(*parent, n): s for n, s in shares.items()}
        budget = new
    for k, docs_ in tree.items():
        whole = min(budget[k] // size[k], p.max_epochs)
        for e in range(whole):
            want.update((i, e) for i, _ in docs_)
        rest = budget[k] - whole * size[k]
        if whole < p.max_epochs:
            for i, n in sorted(docs_, key=lambda d: (h32(f"{p.seed}:{whole}:{d[0]}"), d[0])):
                if (rest := rest - n) < 0:
                    break
                want[i, whole] += 1
    assert got == want
    assert op4_mix.select(empty).count() == 0 and set(odd.columns) <= set(op4_mix.select(odd).columns)


def test_bpe_equals_the_library(spark, odd, texts):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    more = ["a \x1c b\x85c 　d", " ", "x ", "\n x", "x\n\n  y  ", "中文 🙂🙂 \x00", "don't 'll  12 3", "a" * 5000]
    bpe = op5_bpe.codec(path, P.PATTERN)()
    every = [*texts.values(), *more]
    assert [list(x) for x in bpe.encode_batch(every)] == [enc.encode_ordinary(t) for t in every]
    for r in op5_bpe.digests(odd, path, P.PATTERN).collect():
        t = next(x[1] for x in ODD if x[0] == r.doc_id) or ""
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() and r.n_tokens == len(enc.encode_ordinary(t))
    back = op5_bpe.decode(op5_bpe.encode(odd, path, P.PATTERN), path).collect()
    assert {(r.doc_id, bytes(r.content).decode()) for r in back} == {(x[0], x[1] or "") for x in ODD}


def test_toxicity(spark, odd, empty):
    docs = spark.createDataFrame([(i, f"quiet words number{i % 7} here {'you utter moron' if i % 5 == 0 else ''}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(0, 400, 2)], "doc_id long, low_quality int, toxic int")
    model = op6_toxicity.fit(docs, labels)
    assert all(r.toxic == (r.doc_id % 5 == 0) for r in op6_toxicity.predict(docs, model).collect())
    assert op6_toxicity.predict(odd, model).count() == len(ODD)
    kept = op6_toxicity.reject_toxic(odd, op6_toxicity.fit(empty, labels))
    assert kept.count() == len(ODD) and kept.columns == odd.columns


def test_toxicity_features_are_chosen_outside_the_fold(spark):
    draw = np.random.default_rng(1)
    rows = [(i, i % 3, 0.0, float(i % 4 == 0), [1] * (i % 4 == 0) + [2] * (i % 4 == 0 and i % 3 == 0) + [10 + int(x) for x in draw.integers(0, 40, 6)]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, fold int, low_quality double, toxic double, at array<long>")
    every, *outside = op6_toxicity.telling(df, ["low_quality", "toxic"], op6_toxicity.ToxicityParams())
    assert {1, 2} <= set(every) and 2 not in outside[0] and 2 in outside[1] and all(1 in o for o in outside)


def test_toxicity_chain_uses_the_earlier_category(spark):
    draw = np.random.default_rng(2)
    n = 600
    kept = [[1, 2], [1, 2], [1, 2], [1, 2]]
    low = draw.random(n) < 0.5
    rows = [np.array([1] if x else [2]) for x in low]
    y = np.stack([low, low & (draw.random(n) < 0.8)], axis=1).astype(float)
    m = op6_toxicity.fit_chain(rows, y, np.ones(n), np.arange(n) % 3, kept, op6_toxicity.ToxicityParams())
    assert len(m.links[0][1]) == 0 and len(m.links[1][1]) == 1 and m.links[1][1][0] > 0.1


def test_toxicity_of_few_labels_leaves_clean_texts(spark):
    draw = np.random.default_rng(5)
    made = [" ".join(f"w{''.join('abcdefghij'[int(d)] for d in str(k))}" for k in draw.integers(0, 3000, 60)) + (" moron" if i % 8 == 0 else "") for i in range(1000)]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 8 == 0)) for i in range(88)], "doc_id long, low_quality int, toxic int")
    wrong = [r.doc_id for r in op6_toxicity.predict(docs, op6_toxicity.fit(docs, labels)).collect() if r.toxic != (r.doc_id % 8 == 0)]
    assert len(wrong) <= 10


RULES = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain(t):
    def good(k, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": all(int(x) <= 255 for x in s.split(".")) if k == "ip" else 0, "card": 14 <= len(d) <= 19 and op7_pii.luhn(d), "phone": 10 <= len(d) <= 15}[k]

    return sorted([(k, m.start(), m.end()) for k, r in RULES for m in re.finditer(r, t) if good(k, m[0])], key=lambda s: (s[1], op7_pii.KINDS.index(s[0])))


def test_base_spans(texts):
    made = ["a@b.c@d.e.f", "x@y", "@a.b", "1.2.3.4.5.6.7.8 256.1.1.1", "4111 1111-1111 1111 +1 (555) 010-9999.", "++1234567890 é@é.é ü.b@c-d.ee", "a@b..c a@b.c."]
    for t in [*texts.values(), *made]:
        assert op7_pii.base_spans(t) == plain(t)


@pytest.fixture(scope="module")
def pii(spark):
    return op7_pii.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_personal_data_columns(spark, texts, odd, empty, pii):
    rows = op7_pii.op7_pii(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        said = [f"{k}:{s}:{e}" for k, s, e in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in base) for k in op7_pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest() and set(said) <= set(filter(None, r.spans.split(",")))
        assert r.spans == op7_pii.written(pii.spans(texts[r.doc_id])[1])  # the model, too, is the same in any run
    by = {r.doc_id: r for r in op7_pii.find(odd, pii).collect()}
    assert by[5].n_email == 1 and by[2].spans == by[3].spans == "" and op7_pii.find(empty, pii).count() == 0


def test_trees_accept_what_no_base_rule_finds(pii):
    found = {"please write to jane.miller (at) example (dot) org about it": "email", "our host 2001:db8:11:a2:0:12:ff:1 answers": "ip", "login from 10[.]22[.]3[.]44 today": "ip", "paid with card 4111.1111.1111.1111 then": "card", "call (212) 555-0187 after noon": "phone"}
    for text, kind in found.items():
        base, every = pii.spans(text)
        assert not base and [s[0] for s in every] == [kind], text
    for text in ("on 2024-03-17 we met", "version 2.14.3.4711 of it", "the sum of 1,234,567.89 in 1990-2005", "at 12:31:07:220 it ended", "order 4711 0815 1234 done"):
        assert pii.spans(text)[1] == [], text
    assert all(n and recall > 0.8 and precision > 0.98 for n, recall, precision in pii.report.values())


def test_accepted_spans_by_brute_force(texts, pii):
    draw = __import__("random").Random(3)
    for t in list(texts.values())[:60]:
        made, _, _ = op7_pii.with_plants(t, draw)
        base, every = pii.spans(made)
        free = [c for c in op7_pii.candidates(made) if all(c[2] <= s or e <= c[1] for _, s, e in base)]
        prob = pii.trees.score(np.array([op7_pii.features(made, *c) for c in free])) if free else []
        more = []
        for q, c in sorted(zip(prob, free), key=lambda z: (-z[0], z[1][1], z[1])):
            if q >= pii.thresholds[c[0]] and all(c[2] <= s or e <= c[1] for _, s, e in more):
                more.append(c)
        assert sorted(base + more, key=lambda s: (s[1], op7_pii.KINDS.index(s[0]), s[2])) == every and base == plain(made)


def test_redaction(spark, odd, empty):
    assert op7_pii.fit(empty).trees is None
    out = {r.doc_id: r for r in op7_pii.redact(odd, op7_pii.PiiModel(op7_pii.PiiParams())).collect()}
    assert out[5].text.endswith("mail [EMAIL]") and out[5].n_chars == len(out[5].text) and out[2].text is None
    assert op7_pii.redact_text("a b c", [("ip", 0, 3), ("card", 2, 5)]) == "[IP]"


@pytest.mark.parametrize("blocks", [1, 3, 50])
def test_edited_neighbours(spark, texts, blocks):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    ids = sorted(texts)
    got = {r[0]: r[1] for r in op8_spotsigs.in_order(docs, lambda i, t, n: (i, hashlib.sha256(n.encode()).hexdigest()), "doc_id long, h string", blocks).collect()}
    assert got == {i: hashlib.sha256(texts[ids[(k + 1) % len(ids)]].encode()).hexdigest() for k, i in enumerate(ids)}


@pytest.mark.parametrize("blocks", [1, 4, 9])
def test_neighbours_of_ids_with_many_rows(spark, blocks):
    made = [(None, f"text {k}") for k in range(40)] + [(7, f"seven {k % 25}") for k in range(40)] + [(k, f"one {k}") for k in range(20, 30)]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    order = sorted(((-(1 << 63) if i is None else i), zlib.crc32(t.encode()), t) for i, t in made)
    want = Counter((t, order[(k + 1) % len(order)][2]) for k, (_, _, t) in enumerate(order))
    assert Counter(map(tuple, op8_spotsigs.in_order(docs, lambda i, t, n: (t, n), "t string, n string", blocks).collect())) == want


def test_spotsigs_columns(spark, texts):
    ids = sorted(texts)
    p = op8_spotsigs.SpotParams()

    def plain_signatures(t):
        ws = re.findall(r"\w+", t.lower())
        out = set()
        for i, w in enumerate(ws):
            if w in p.anchors or zlib.crc32(w.encode()) % p.sampled == 0:
                chain = [x for x in ws[i + 1 :] if x not in p.anchors][: p.chain]
                if len(chain) == p.chain:
                    out.add((w, *chain))
        return out or ({("", *ws)} if ws else set())

    rows = {r.doc_id: r for r in op8_spotsigs.op8_spotsigs(spark, SF).collect()}
    assert len(rows) == len(ids)
    for k, i in enumerate(ids):
        t, n = texts[i], texts[ids[(k + 1) % len(ids)]]
        new = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        a, b, c = map(plain_signatures, (t, new, n))
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        for got, x in ((r.near_edited, b), (r.near_next, c)):
            assert abs(got - (len(a & x) / len(a | x) if a | x else 1.0)) < 1e-9  # no two signatures share a hash here


def test_spotsigs(spark, odd, empty):
    assert op8_spotsigs.fingerprints(odd).count() == len(ODD) and op8_spotsigs.fingerprints(empty).count() == 0
    sets = {1: {1, 2, 3, 4}, 2: {1, 2, 3, 5}, 3: {9, 8}, 4: {1, 2, 3, 4, 5, 6, 7, 8, 9}}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "fp_id long, sigs array<long>")
    want = {(a, b) for a in sets for b in sets if a < b and op8_spotsigs.likeness(sets[a], sets[b]) >= 0.5}
    assert {(r.a, r.b) for r in op8_spotsigs.near_pairs(df).collect()} == want
    copies = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()] + [(100 + k, [5, 3, 2, 1, 1]) for k in range(50)] + [(200, []), (201, [])], "fp_id long, sigs array<long>")
    members, pairs = op8_spotsigs.near_classes(copies)
    assert {(r.a, r.b) for r in pairs.collect()} == want
    assert {r.fp_id: r["class"] for r in members.collect()} == {k: k for k in sets} | {100 + k: 2 for k in range(50)} | {200: 200, 201: 200}


def brute(docs):
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in docs:
        for b in docs:
            k = len(sets[a] & sets[b])
            if a < b and k and 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in docs}


@pytest.mark.parametrize("p", [op9_neardup.NearDupParams(), op9_neardup.NearDupParams(leaf=8, block=16)])
def test_near_duplicates(spark, p):
    draw = np.random.default_rng(6)
    base = [f"w{x}" for x in draw.integers(0, 500, 120)]
    docs = {}
    for i in range(90):
        w = list(base)
        for at in draw.choice(120, int(draw.integers(0, 7)), replace=False):
            w[at] = f"z{i}x{at}"
        docs[i] = " ".join(w)
    docs |= {100 + i: " ".join(f"q{x}" for x in draw.integers(0, 9000, 60)) for i in range(40)} | {200: "", 201: None, 202: "two words", 203: "Two  words", 204: docs[3].upper()}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op9_neardup.near_duplicates(df, p).collect()} == brute(docs)


def test_near_duplicates_of_odd_rows(odd, empty):
    rows = op9_neardup.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and {r.component_id for r in rows if r.doc_id == 1} == {1}
    kept = op9_neardup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted(map(str, [r.doc_id for r in kept.collect()])) == ["1", "2", "3", "4", "5", "None"]
    assert op9_neardup.near_duplicates(empty).count() == 0


def test_dropping_rows_of_one_id_with_several_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    docs = spark.createDataFrame([(5, a, 1), (5, b, 2), (5, b, 2), (6, a, 3), (9, b + " more", 4)], "doc_id long, text string, `__near_id` int")
    got = op9_neardup.drop_near_duplicates(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [(5, a, 1), (5, b, 2)]


def test_counts_of_hot_keys(spark):
    rows = spark.createDataFrame([(k % 3 if k < 6000 else k // 2, k) for k in range(8001)], "key long, rep long")
    got = {(r.key, r.rep): r["count"] for r in op9_neardup._counted(rows, 8001).collect()}
    n = Counter(k % 3 if k < 6000 else k // 2 for k in range(8001))
    assert got == {(key, k): n[key] for k in range(8001) if n[key := k % 3 if k < 6000 else k // 2] > 1}


def test_language_model(spark, odd, texts):
    rows = {r.doc_id: r for r in op10_lm.op10_lm(spark, SF, op10_lm.LmParams(head=300)).collect()}
    train = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*words(t), ""])
    n, v = sum(train.values()), len(train)
    for i, t in texts.items():
        tokens = [*words(t), ""]
        assert abs(rows[i].base_score - sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens)) < 1e-6
        assert (rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) == (len(tokens), sum(w in train for w in tokens), n)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_does_not_depend_on_partitions(spark, texts):
    docs = spark.createDataFrame([(i, zlib.crc32(str(i).encode()) % 7 == 2, t) for i, t in texts.items() for _ in range(1 + (i % 50 == 0))], "doc_id long, held_out boolean, text string")
    p = op10_lm.LmParams(dims=8, warm_docs=30, warm_epochs=1, shard_tokens=9000)  # several shards

    def scores(df):
        return sorted((r.doc_id, r.score, r.base_score) for r in op10_lm.scored(df, p).collect())

    first = scores(docs.coalesce(1))
    for n in (4, 7):
        for x, y in zip(first, scores(docs.repartition(n, F.xxhash64("doc_id")))):
            assert x[0] == y[0] and abs(x[1] - y[1]) <= 1e-9 * abs(x[1]) and abs(x[2] - y[2]) <= 1e-9 * abs(x[2])


def test_language_model_of_odd_rows(odd, empty):
    rows = op10_lm.scored(odd.withColumn("held_out", F.lit(False))).collect()
    assert len(rows) == len(ODD) and all(r.n_tokens == len(words(t)) + 1 for i, t, *_ in ODD for r in rows if r.doc_id == i and i != 1)
    assert {r.train_tokens for r in rows} == {sum(len(words(t)) + 1 for i, t, *_ in ODD if i is not None)}
    assert op10_lm.scored(empty.withColumn("held_out", F.lit(False))).count() == 0
    none = op10_lm.scored(odd.withColumn("held_out", F.lit(True))).where("doc_id = 3").collect()  # nothing to learn from: uniform
    assert none[0].n_known == 0 and abs(none[0].base_score) < 1e-9


def test_frequent_words_of_equal_counts(spark):
    docs = spark.createDataFrame([(i, f"w{i} v{i} u{i}") for i in range(400)], "key long, text string")
    stats = op10_lm.gather(docs, op10_lm.LmParams(head=300))
    assert 200 < len(stats.frequent) <= 300 and stats.frequent[0] == (b"", 400) and stats.distinct == 1201


def test_language_model_is_normalised():
    p = op10_lm.LmParams(own=5, endings=3, dims=4)
    m = op10_lm.LogBilinear(p)
    ctx = np.zeros((8, 2), dtype=np.int32)
    assert abs((10 ** m.log10(ctx, np.arange(8))).sum() - 1) < 1e-9


def test_language_model_units_follow_the_corpus():
    frequent = [(f"{i}same".encode(), 4000 // (i + 4)) for i in range(3000)]  # one ending for all
    tokens = sum(c for _, c in frequent)
    p = op10_lm.LmParams(coverage=0.9).sized(frequent, tokens)
    assert sum(c for _, c in frequent[: p.own]) >= 0.9 * tokens > sum(c for _, c in frequent[: p.own - 1]) and p.own > 1000
    assert op10_lm.LmParams(coverage=0.9).sized(frequent[:300], tokens).own == 300
    vocab = op10_lm.Vocabulary(frequent, p)
    draw = np.random.default_rng(0)
    firsts = draw.permutation(400)[:40] + 200  # each word is followed by the next one
    docs = [vocab.look_up([frequent[k][0], frequent[k + 1][0]])[1] for k in np.repeat(firsts, 100)]
    m = op10_lm.LogBilinear(p)
    m.start(np.ones(p.units))
    ctx, y = m.contexts(docs)
    g = np.full_like(m.flat, 1e-4)
    for _ in range(20):
        m.train(ctx, y, op10_lm.Noise(p, np.ones(p.units)), draw, g)
    every = np.repeat(ctx[1:2], p.units, axis=0)
    assert abs((10 ** m.log10(every, np.arange(p.units))).sum() - 1) < 1e-6
    right, wrong = m.log10(ctx[1::200], y[1::200]), m.log10(ctx[1::200], np.roll(y[1::200], 1))
    assert right.mean() > wrong.mean() + 0.5


def test_lm_sums_of_runs_and_tables_made_once():
    draw = np.random.default_rng(8)
    for most in (1, 3, 40, 5000):
        keys, x = draw.integers(0, most, 3000), draw.normal(size=(3000, 5))
        order = op10_lm._order(keys)
        first = op10_lm._starts(keys[order])
        assert np.allclose(op10_lm._run_sums(x, order, first), np.add.reduceat(x[order], first, axis=0))
    big = np.array([70_000, 4464, 70_000, 1])  # beyond 16 bits
    assert op10_lm._order(big).tolist() == [3, 1, 0, 2]
    p = op10_lm.LmParams(own=40, endings=9)
    m = op10_lm.LogBilinear(p)
    ctx, y = m.contexts([draw.integers(0, p.units, 900)])
    assert (m.log10(ctx, y, tables=m.tables()) == m.log10(ctx, y)).all()
    # a step moves the parameters by the gradient of all rows, noise that is drawn twice included
    before, g = m.flat.copy(), np.full_like(m.flat, 1e-4)
    m.train(ctx, y, op10_lm.Noise(p, np.ones(p.units)), draw, g)
    assert np.isfinite(m.flat).all() and ((g > np.float32(1e-4)) <= (m.flat != before)).mean() > 0.99


def test_release_trims_the_drivers_native_heap(spark):
    from tessera.llm.common import release

    runtime = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getRuntimeMXBean()
    if int(str(runtime.getSpecVersion()).split(".")[0]) < 17:
        pytest.skip("no such command")
    assert re.search(r"Trim native heap|[Nn]ot available", release(spark))


def test_components(spark):
    from tessera.llm.common import components

    draw = np.random.default_rng(4)
    edges = [tuple(x) for x in draw.integers(0, 400, (260, 2)).tolist()] + [(1000, k) for k in range(1001, 1300)] + [(k, k + 1) for k in range(2000, 2040)]
    low = {v: v for e in edges if e[0] != e[1] for v in e}
    for _ in range(len(low)):
        for a, b in edges:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.v: r.component for r in got} == low and len(got) == len(low)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forests_of_few_edges_take_few_tasks(spark, monkeypatch):
    from tessera.llm import common

    tasks, plain = [], common.materialise
    monkeypatch.setattr(common, "materialise", lambda df: tasks.append(df.rdd.getNumPartitions()) or plain(df))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert common.components(spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")).count() == 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert tasks[0] <= 2


def test_batches_of_texts_are_small(spark):
    from tessera.llm import common

    name, default, ours = common.BATCH
    before = spark.conf.get(name)
    try:
        for set_to, then in ((default, ours), ("777", "777")):  # a session's own number stays
            spark.conf.set(name, set_to)
            sizes = common.map_rows(spark.range(3000).coalesce(1), lambda: lambda cols: [(len(cols["id"]),)], "n long", 1 << 20).collect()
            assert spark.conf.get(name) == then and max(r.n for r in sizes) == int(then)
    finally:
        spark.conf.set(name, before)


def test_bpe_remembers_bytes_and_joins_batches():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = op5_bpe.codec(path, P.PATTERN)()
    every = ["", None, " ".join(f"qx{i}zzvk\xff{i}" for i in range(700)), "\xff  \n", "b" * 70 + " c"]  # more pre-tokens than one call takes
    ids = bpe.encode_batch(every)
    assert [x.tolist() for x in ids] == [enc.encode_ordinary(t or "") for t in every]
    assert [bytes(x) for x in bpe.texts_of(ids)] == [",".join(map(str, x.tolist())).encode() for x in ids]
    assert [bytes(x) for x in bpe.decode_batch(ids)] == [(t or "").encode() for t in every]
    assert all(type(x) is bytes for x in bpe.known.values()) and max(map(len, bpe.known)) <= op5_bpe.CACHE_LENGTH
    assert [bytes(x) for x in bpe.decode_batch(bpe.encode_batch(["", None]))] == [b"", b""]


def test_lm_trains_on_every_position(spark, monkeypatch):
    """In the shards, each token of each training document is a target once, in batches that lose no rest."""
    seen = []
    plain = op10_lm.LogBilinear.train
    monkeypatch.setattr(op10_lm.LogBilinear, "train", lambda self, ctx, y, *rest: seen.append(len(y)) or plain(self, ctx, y, *rest))
    p = op10_lm.LmParams(own=20, endings=4, dims=4, warm_docs=0, batch=64)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 17}" for k in range(1, 9 + i % 40)), False) for i in range(60)], "doc_id long, text string, held_out boolean")
    stats = op10_lm.gather(docs, p)
    units = op10_lm.units_of(stats, p)
    encoded = op10_lm.materialise(op10_lm.encode(docs, units))
    blocks = []
    # the shards' function runs here, over their rows in order
    monkeypatch.setattr(type(encoded), "mapInArrow", lambda self, run, ddl: blocks.extend(run(self.toArrow().to_batches())) or spark.createDataFrame([], ddl))
    op10_lm.fit(encoded, stats, units)
    assert sum(seen) == stats.tokens and sum(b.column("seen")[0].as_py() for b in blocks) == stats.tokens


def test_lm_class_scores_far_apart():
    """Products of exponentials that vanish give way to plain sums."""
    p = op10_lm.LmParams(own=6, endings=3, dims=4)
    m = op10_lm.LogBilinear(p)
    m.r[:] = 0
    m.r[0, 0], m.r[1, 1] = 30, 30
    m.a[:] = 0
    m.a[0, 0], m.a[1, 1] = 30, 30
    ctx = np.array([[0, 1]] * p.units, dtype=np.int32)
    got = m.log10(ctx, np.arange(p.units))
    z = (m.embedded(ctx[:1]) @ m.a[:, :-1].T + m.a[:, -1]).astype(float)[0]
    of_class = z - z.max() - np.log(np.exp(z - z.max()).sum())
    assert np.isfinite(got).all() and np.allclose(np.log10(np.add.reduceat(10.0 ** got, np.arange(0, p.units, p.width)))[:2], of_class[:2] / np.log(10), atol=1e-6)
    assert abs((10.0 ** got).sum() - 1) < 1e-6
