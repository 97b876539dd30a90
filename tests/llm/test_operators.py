"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
import sylvan.llm.components as module
from sylvan.llm import bpe, covertree, langid, licenses, lm, media, mixing, simhash, substring, warc
from sylvan.llm.components import components
from sylvan.llm.eliasfano import EliasFano
from sylvan.llm.entry import tokenizer_path
from sylvan.llm.shared import fresh_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, key long, rep long, held_out string"


def texts():
    rng = random.Random(7)
    words = ["the", "Of", "anst", "erthe", "né", "über", "日本", "x", "tion,", "shall"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(12)]
    shared = " ".join(rng.choice(words) + str(i) for i in range(40))
    return [*base, base[3], base[5] + " more", None, "", "   \n\t", "a " * 30_000, shared, "start " + shared + " end", shared + "\n" + base[1], "GNU General Public License", "no spaces" * 3]


def table(spark, rows=None):
    rows = [(i, t, ["en", "de", None][i % 3], "s", 0, 1, 2, 3, "h") for i, t in enumerate(texts())] if rows is None else rows
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def test_substring(docs, empty):
    got = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
    words = {i: (t or "").encode().split() for i, t in enumerate(texts())}
    first = {}
    for i, w in words.items():
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        assert (got[i].n_words, got[i].n_removed) == (len(w), len(gone))
        assert got[i].kept_text == b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
    assert substring.remove_repeats(empty).count() == 0


def test_layout_keeps_clean_texts(docs):
    got = {r.doc_id: r.kept_text for r in substring.remove_repeats(docs, layout=True).where("n_removed = 0").collect()}
    assert all(v == (texts()[i] or "") for i, v in got.items())


def test_simhash(docs, empty):
    def fp(text):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    want = [fp(t) for t in texts()]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    label = list(range(len(want)))
    for _ in want:
        label = [min(label[j] for j in range(len(want)) if (want[i] ^ want[j]).bit_count() <= 3) for i in range(len(want))]
    assert all(got[i].fingerprint == f"{f:016x}" and got[i].component_id == label[i] for i, f in enumerate(want))
    assert simhash.near_duplicates(empty).count() == 0


def test_pigeonhole_loses_no_pair():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            y[i] ^= np.uint64(1 << int(b))
    bits = simhash.unpack(np.r_[x, y]).astype(float)
    for n in (800, 10**6, 10**9):
        parts = simhash.plan(bits.T @ bits * n / len(bits), n)
        assert np.any([a == b for a, b in zip(simhash.keys(x, parts), simhash.keys(y, parts))], axis=0).all()


def test_large_buckets(monkeypatch):
    """Buckets that are compared block by block, dense ones among them, give the components of all pairs."""
    rng = np.random.default_rng(5)
    dense = rng.integers(0, 1 << 63, 1, dtype=np.uint64) ^ np.array([sum(1 << int(b) for b in rng.choice(64, 2)) for _ in range(40)], np.uint64)
    x = np.r_[dense, rng.integers(0, 1 << 63, 25, dtype=np.uint64), dense[:3] ^ np.uint64(7 << 20)]
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    label = np.arange(len(x))
    for _ in x:
        label = np.array([label[row].min() for row in near])
    monkeypatch.setattr(simhash, "BLOCK", 4)
    assert simhash.bucket_links(np.zeros(len(x), np.int64), x, 3).tolist() == label.tolist()


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5)]
    label = {v: v for p in links for v in p if p[0] != p[1]}
    for _ in range(200):
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.vertex: r.component_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == label


def test_components_take_few_rounds(spark, monkeypatch):
    """A chain of 5,000 links in any order of names, and a star of 100,000 leaves under its largest vertex."""
    rounds = []
    kept = module.cut
    monkeypatch.setattr(module, "cut", lambda df, what: (rounds.append(what), kept(df, what))[1])
    names = random.Random(3).sample(range(5001), 5001)
    for chain in (range(5001), names):
        rounds.clear()
        links = spark.createDataFrame(list(zip(chain[:-1], chain[1:])), "a long, b long")
        assert [tuple(r) for r in components(links).groupBy("component_id").count().collect()] == [(0, 5001)]
        assert rounds.count("labels") <= 15 and len(rounds) <= 60
    rounds.clear()
    star = spark.range(100_000).selectExpr("id as a", "100000L as b")
    assert [tuple(r) for r in components(star).groupBy("component_id").count().collect()] == [(0, 100_001)]
    assert rounds.count("labels") <= 3


def test_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    x[20:40] = x[:20] + rng.normal(size=(20, 8)) * 0.1
    x[40:45] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(60, None), (61, [0.0] * 8), (62, [1.0, None] * 4), (63, [float("nan")] * 8), (64, [1.0, 2.0])]
    got = {r.vec_id: r for r in covertree.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    label = np.arange(60)
    for _ in range(60):
        label = np.array([label[near[i]].min() for i in range(60)])
    assert all(got[i].n_links == near[i].sum() - 1 and got[i].component_id == label[i] for i in range(60))
    assert all(got[i].n_links == 0 and got[i].kept for i in range(60, 65))



def brute_links(x, ids, cos=0.95):
    """Links and smallest reachable id of each row of x."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= cos
    label = np.array(ids)
    while True:
        new = np.array([label[near[i]].min() for i in range(len(x))])
        if (new == label).all():
            return near.sum(1) - 1, label
        label = new


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_of_many_blocks_move_a_fixed_number_of_times(spark, monkeypatch, kind):
    """Clusters, a dense group, copies and scaled copies over about a hundred blocks: brute force's links, and a shuffle in proportion to the vectors."""
    monkeypatch.setattr(covertree, "BLOCK", 32)
    monkeypatch.setattr(covertree, "PIVOTS", 20)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3200, 64))
    x[:400] = x[0] + rng.normal(size=(400, 64)) * 0.1
    x[400:700] = x[700:1000] + rng.normal(size=(300, 64)) * rng.uniform(0.1, 0.4, size=(300, 1))
    x[1000:1200], x[1200:1300] = x[2000], x[1300:1400] * 4
    x = x.astype(np.float32)[rng.permutation(len(x))].astype(np.float64)
    ids = rng.permutation(10 * len(x))[: len(x)].tolist()
    vectors = spark.createDataFrame(list(zip(ids, x.tolist())), f"vec_id long, embedding array<{kind}>").repartition(7).cache()
    assert vectors.count() == len(x)

    def moved():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = moved()
    got = {r.vec_id: r for r in covertree.near_vectors(vectors).collect()}
    n, label = brute_links(x, ids)
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in ids] == [(a, b, i == b) for i, a, b in zip(ids, n.tolist(), label.tolist())]
    assert moved() - before < 4 * x.nbytes


def test_vectors_in_ranges_of_shelves(spark, monkeypatch):
    """Tiles of several shelves of several blocks, for two lengths of vectors; ids in two rows."""
    for name, value in (("BLOCK", 4), ("PIVOTS", 12), ("SHELF", 2)):
        monkeypatch.setattr(covertree, name, value)
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(900, 5)), rng.normal(size=(60, 20))
    y[30:] = y[:30] * 3 + rng.normal(size=(30, 20)) * 0.3
    for cos in (0.95, 0.6):
        rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v.tolist()) for i, v in enumerate(y)]
        got = {r.vec_id: r for r in covertree.near_vectors(spark.createDataFrame([*rows, (5000, [0.0] * 5), (5001, [1.0] * 5), (5001, [1.0] * 20)], "vec_id long, embedding array<double>"), cos).collect()}
        n, label = brute_links(np.r_[x, np.ones((1, 5))], [*range(900), 5001], cos)
        m, other = brute_links(np.r_[y, np.ones((1, 20))], [*range(1000, 1060), 5001], cos)
        assert [got[i].n_links for i in range(900)] == n[:900].tolist() and [got[1000 + i].n_links for i in range(60)] == m[:60].tolist()
        assert got[5001].n_links == n[900] + m[60]  # one id, a vector of either length
        if not m[60]:
            assert [got[i].component_id for i in range(900)] == label[:900].tolist() and [got[1000 + i].component_id for i in range(60)] == other[:60].tolist()
        assert got[5000].n_links == 0 and got[5000].kept


def test_vector_tiles_hold_each_pair_of_shelves_once():
    pivots = {3: np.ones((7, 3)), 9: np.ones((1, 9))}
    layout = covertree.Layout(pivots, {(3, c): 2048 * 150 * c + 1 for c in range(7)})
    seen = Counter()
    for t in range(layout.tile0[-1]):
        _, left, right = layout.tile(t)
        seen.update((a, b) for a in left for b in right if a <= b)
    shelves = [range(layout.shelf0[s], layout.shelf0[s] + layout.shelves[s]) for s in (3, 9)]
    assert layout.side[3] > 1 and seen == Counter((a, b) for own in shelves for a in own for b in own if a <= b)


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = {r.doc_id: r for r in bpe.encode_decode(docs, tokenizer_path(), ["doc_id"]).collect()}
    for i, text in enumerate(texts()):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_decode(empty, tokenizer_path(), ["doc_id"]).count() == 0


def test_bpe_joins():
    """Any cuts, with the chunks' encodings known or not, give what the tokenizer gives for the whole text."""
    e, rng = bpe.encoder(tokenizer_path()), random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("abzA's09,.-éßİ́日<|>\n\t  ") for _ in range(rng.randint(2, 300)))
        data = text.encode()
        cuts = sorted(rng.sample(range(1, len(data)), min(rng.randint(1, 9), len(data) - 1)))
        known = [e.chunk(data[a:b]) if rng.random() < 0.5 else None for a, b in zip([0, *cuts], [*cuts, len(data)])]
        ids, back = e.encode(data, cuts, known)
        want = e.tokenizer.encode(text, add_special_tokens=False).ids
        assert ids == np.array(want, "<u4").tobytes() and back == e.decode(want)


def test_bpe_mends_joins_that_disagree(monkeypatch):
    """Chunks whose first whole word is encoded wrongly are taken together with the next until the encodings agree."""
    e = bpe.encoder(tokenizer_path())
    data = b"one two three four five six seven eight nine ten"
    cuts = [14, 30]
    known = [e.chunk(data[a:b]) for a, b in zip([0, *cuts], [*cuts, len(data)])]
    known[1] = (b"\1\0\0\0", b"x", *known[1][2:])
    ids, _ = e.encode(data, cuts, known)
    assert ids == np.array(e.tokenizer.encode(data.decode(), add_special_tokens=False).ids, "<u4").tobytes()


def test_bpe_encodes_shared_chunks_once(spark):
    rng = random.Random(12)
    prose = " ".join(rng.choice(["anst", "erthe", "shall", "né", "日本"]) + str(rng.randint(0, 99)) for _ in range(4000))
    rows = [(i, t) for i, t in enumerate([prose, "begin " + prose, prose[:9000] + " other", "x" * 5000, None, ""])] + [(1, prose), (None, prose), (None, "zz " * 3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    store = bpe.shared_chunks(table, tokenizer_path(), "doc_id")
    held = store.shard(0)
    assert len(held[0]) > 20 and len(set(zip(held[0].tolist(), held[1].tolist()))) == len(held[0])
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = sorted((r.doc_id is None, r.doc_id, r.ids) for r in bpe.encode_decode(table, tokenizer_path(), ["doc_id"], digests=False).collect())
    assert got == sorted((i is None, i, t.encode(x or "", add_special_tokens=False).ids) for i, x in rows)


def test_media(docs):
    for n in (64, 128, 4096, 4160, 40_960):
        payload = bytes(range(256)) * 160
        assert media.read(media.write(payload[:n]))["payload"] == payload[:n]
    broken = bytearray(media.write(payload[:8192]))
    del broken[188 * 5 : 188 * 6]
    with pytest.raises(ValueError):
        media.read(bytes(broken))
    for r in media.inspect(media.store(docs, ["doc_id"]), ["doc_id", "n_bytes"]).collect():
        data = (texts()[r.doc_id] or "").encode()
        assert r.n_bytes == len(data) and r.payload_sha256 == hashlib.sha256(media.padded(data)).hexdigest()


def test_warc(spark):
    record = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:sylvan:page:7>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a b\r\n", record + "x"), (2, None, record * 3), (3, "u", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n"), (6, "u", record + "x"), (7, "u", "日本")]
    path = fresh_path(spark, "test")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = {r.page_id: r for r in warc.read(spark, path).collect()}
    last = {h or "": i for i, _, h in rows}
    for i, _, h in rows:
        body = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if last[h or ""] == i else ("revisit", last[h or ""]))


def test_elias_fano():
    rng = np.random.default_rng(0)
    for universe in (1, 10, 1000, 10**12):
        v = np.unique(rng.integers(0, universe, 300))
        e = EliasFano.of(v, universe)
        q = np.r_[v, rng.integers(0, universe, 300)]
        place = {int(x): i for i, x in enumerate(v)}
        assert (e.get(np.arange(len(v))) == v).all() and e.find(q).tolist() == [place.get(int(x), -1) for x in q]


def test_lm(docs, empty):
    rows = lm.train_and_score(docs).collect()
    assert len(rows) == len(texts()) and all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert all(r.n_tokens == len((texts()[r.doc_id] or "").encode().split()) + 1 for r in rows)
    assert lm.train_and_score(empty).count() == 0
    words = [[*"".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split(), None] for t in texts()]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(words))]
    c = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    for r in rows:
        want = sum(math.log10((c[w] + 1) / (c.total() + 1 * (len(c) + 1))) for w in words[r.doc_id])
        assert (r.held_out, r.train_tokens, r.n_known) == (held[r.doc_id], c.total(), sum(c[w] > 0 for w in words[r.doc_id]))
        assert math.isclose(r.base_score, want, rel_tol=1e-9)


def test_lm_keeps_every_ngram(spark):
    rng = random.Random(4)
    words = [[*(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))), None] for _ in range(24)]
    rows = [(i, " ".join(w[:-1])) for i, w in enumerate(words)]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(words))]
    c = [Counter(tuple(([None] + w)[j - k + 1 : j + 1]) for w, h in zip(words, held) if not h for j in range(max(1, k - 1), len(w) + 1)) for k in (1, 2, 3)]
    assert any(n == 1 for n in c[1].values()) and any(n == 1 for n in c[2].values()) and max(map(len, c)) <= 256

    def p(gram):
        if len(gram) == 1:
            return (c[0][gram] + 1) / (c[0].total() + len(c[0]) + 1)
        known = [n for g, n in c[len(gram) - 1].items() if g[:-1] == gram[:-1]]
        below = p(gram[1:])
        if not known:
            return below
        whole = c[len(gram) - 2][gram[:-1]]
        return max(c[len(gram) - 1][gram] - lm.DISCOUNT, 0) / whole + (1 - sum(n - lm.DISCOUNT for n in known) / whole) * below

    table = spark.createDataFrame(rows, "doc_id long, text string")
    got, near = ({r.doc_id: r.score for r in lm.train_and_score(table, quantised=q).collect()} for q in (False, True))
    for i, w in enumerate(words):
        seen = [None] + w
        want = sum(math.log10(p(tuple(seen[max(0, j - 2) : j + 1]))) for j in range(1, len(seen)))
        assert math.isclose(got[i], want, rel_tol=1e-6, abs_tol=1e-6) and abs(near[i] - want) < 5e-4 * len(w)


def test_lm_splits_contexts_and_shards_alike(docs):
    """Shards of a few tokens and contexts split over several give the same scores."""
    whole, split = ({r.doc_id: r.score for r in lm.train_and_score(docs, **x).collect()} for x in ({}, {"most": 50, "each": 20_000}))
    assert split.keys() == whole.keys() and all(math.isclose(split[i], whole[i], rel_tol=1e-12) for i in whole)


def test_langid(docs, empty):
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == len(texts())
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in texts()[i] or "")) for i, r in got.items())
    assert langid.identify(empty).count() == 0


def test_langid_against_brute_force(spark):
    """Bundles added trigram by trigram, prototypes document by document."""
    rng = random.Random(11)
    known = {"en": "the of shall being with", "de": "und über nicht schon weiß", "ja": "日本 東京 の は"}
    rows = [(i, " ".join(rng.choice(known[lang].split()) for _ in range(rng.randint(1, 40))), lang) for i, lang in enumerate(["en", "de", "ja", "en"] * 12)]
    rows += [(50, "the the über", None), (51, None, "en"), (52, "12 3", "de"), (53, "Nicht", "de"), (53, "Nicht", "de"), (None, "shall", "en")]

    def bundle(text):
        letters = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        letters = "".join(c for i, c in enumerate(letters) if c != " " or i == 0 or letters[i - 1] != " ")
        grams = Counter(letters[i : i + 3] for i in range(len(letters) - 2))
        vector = lambda c, n: np.roll(langid.letter(ord(c)).astype(np.int64), n)
        return sum((n * vector(g[0], 2) * vector(g[1], 1) * vector(g[2], 0) for g, n in grams.items()), np.zeros(langid.DIM)), math.sqrt(sum(n * n for n in grams.values()))

    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    prototypes = {lang: np.zeros(langid.DIM) for lang in sorted(known)}
    for i, text, lang in rows:
        if not held(i) and lang and text and any(c.isalpha() for c in text):
            b, norm = bundle(text)
            prototypes[lang] += b / norm
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.held_out, r.lang_pred, r.score) for r in langid.identify(table).collect()))
    want = []
    for i, text, _ in rows:
        if not text or not any(c.isalpha() for c in text):
            want.append((i, held(i), "und", 0.0))
            continue
        b, _ = bundle(text)
        cos = {lang: b @ p / np.linalg.norm(b) / np.linalg.norm(p) for lang, p in prototypes.items()}
        best = max(cos, key=cos.get)
        want.append((-1 if i is None else i, held(i), best, min(1, max(0, cos[best]))))
    for g, w in zip(got, sorted(want)):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-6


def test_langid_is_close_to_exact_trigram_cosines():
    rng = random.Random(5)
    short = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randint(3, 60))) for _ in range(60)]
    short += ["", "123", "Avec.", "a\tb", "日本 über"]
    x, has, distinct = langid.bundles(short)
    counts = []
    for t in short:
        letters = "".join(c if c.isalpha() else " " for c in f" {t.lower()} ")
        letters = "".join(c for i, c in enumerate(letters) if c != " " or i == 0 or letters[i - 1] != " ")
        counts.append(Counter(letters[i : i + 3] for i in range(len(letters) - 2)))
    grams = {g: i for i, g in enumerate(sorted(set().union(*counts)))}
    exact = np.zeros((len(short), len(grams)))
    for i, c in enumerate(counts):
        exact[i, [grams[g] for g in c]] = list(c.values())
    assert distinct.tolist() == [len(c) for c in counts]
    got, want = langid.unit(x), langid.unit(exact)
    assert np.abs(got @ got.T - want @ want.T)[np.ix_(has, has)].max() < 0.07


def test_language_id_keeps_short_texts(spark):
    rng = random.Random(6)
    known = {"en": ["the", "of", "shall", "being"], "de": ["und", "über", "nicht", "schon"]}
    rows = [(i, " ".join(rng.choice(known[lang]) for _ in range(80)), lang) for i, lang in enumerate(["en", "de"] * 10)]
    unseen = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 5 == 0]
    short = list(zip(unseen, ["Qxqx.", "zz", "VJKW!! VJKW!! VJKW!!"], ["en", "de", "en"]))
    gone = [(200, "123 ...", "en"), (201, None, "de"), (202, "".join(rng.choice("bcdfgjkmpqvwxyz") for _ in range(3000)), None)]
    docs = spark.createDataFrame(rows + short + gone, "doc_id long, text string, lang string")
    found = corpus_pipeline.language_id(spark, docs, "")
    assert found.columns == docs.columns and sorted(r.doc_id for r in found.collect()) == [r[0] for r in rows + short]


def test_licenses(docs):
    got = {r.doc_id: r for r in licenses.scan_licenses(docs, ["doc_id"]).collect()}
    hit = got[texts().index("GNU General Public License")]
    assert (hit.n_base, hit.first_word, hit.base_labels, hit.score) == (1, 0, "gpl", 1.0)
    assert licenses.scan(b"licenced under the Apche License")[5] == "apache" and licenses.scan(b"mit license cc by cc by")[1] == 3


def test_mixing(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(12)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = mixing.mix(docs, labels).collect()
    assert len(rows) == len(texts()) and all(r.rate >= 0 and abs(r.p_clean + r.p_low + r.p_toxic - 1) < 1e-6 for r in rows)
    assert mixing.mix(docs, labels.limit(0)).count() == len(texts()) and mixing.mix(empty, labels).count() == 0
    assert mixing.dealt(docs, labels).columns == docs.columns


@pytest.mark.parametrize("shares", [(9900, 90, 10), (9850, 100, 50), (9989, 1, 10)])
def test_mixing_meets_targets_for_rare_domains(spark, shares):
    rows = [(n, *[float(j == k) for j in range(3)]) for k, n in enumerate(shares)] + [(0, 0.2, 0.3, 0.5)]
    found = mixing.fit_rates(spark.createDataFrame(rows, "n_tokens long, p_clean double, p_low double, p_toxic double"), mixing.TARGET).collect()
    for d in mixing.DOMAINS:
        assert abs(sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in found) / sum(shares) - mixing.TARGET[d]) < 2e-4


def test_mixing_rates_against_another_solver(spark):
    """The rates of the regularised problem, by Newton's method on its dual: r = max(0, 1 - p.y)."""
    rng = np.random.default_rng(4)
    n, p, ridge = rng.integers(0, 900, 300), rng.dirichlet([4, 0.6, 0.3], 300), 1e-3
    share, w, y = np.array([mixing.TARGET[d] for d in mixing.DOMAINS]), n / n.sum(), np.zeros(3)
    for _ in range(200):
        r = np.maximum(0, 1 - p @ y)
        gradient, slope = share + ridge * y - (w * r) @ p, (p * (w * (r > 0))[:, None]).T @ p + ridge * np.eye(3)
        y = y - 0.5 * np.linalg.solve(slope, gradient)
    rows = [(i, int(k), *map(float, x)) for i, (k, x) in enumerate(zip(n, p))]
    table = spark.createDataFrame(rows, "i long, n_tokens long, p_clean double, p_low double, p_toxic double")
    found, reached = mixing.fitted(table, mixing.TARGET, ridge, 1e-9)
    got = np.array([x.rate for x in found.orderBy("i").collect()])
    assert (r == 0).any() and np.abs(got - r).max() < 1e-4
    assert np.allclose([reached[d] for d in mixing.DOMAINS], (w * got) @ p)


def test_mixing_without_a_way_to_the_targets(spark):
    third = [(10, 1 / 3, 1 / 3, 1 / 3)] * 3
    found = mixing.fit_rates(spark.createDataFrame(third, "n_tokens long, p_clean double, p_low double, p_toxic double"), mixing.TARGET).collect()
    assert all(abs(r.rate - 1) < 1e-2 for r in found)
