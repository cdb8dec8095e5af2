"""Operators against brute force, on small fixtures with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quadloom.llm import bpe, common, ctph, graph, html, lines, mixing, pii, quality, rules, simhash, token_counts
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
EXTRA = ["h", "u", "v", "k", "c", "n", "m", "s", "t", "fp", "root", "bucket", "size", "target", "words", "spans", "ids", "x", "page", "host"]


def rows_of(texts, ids=None):
    ids = ids or list(range(len(texts)))
    return [(i, t, "en", "src" if t is None else f"src{len(t) % 3}", len(t or "")) for i, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, a very long one, ties and a fully repeated row, and many extra columns."""
    words = [f"w{i % 977}" for i in range(60_000)]
    rows = rows_of(["", None, " \n\t", "One two three.", "naïve 日本語 text ß", " ".join(words), "x" * 70_000, "a b c d\n" * 30]) + rows_of(["One two three."], [3])
    rows += [(None, "no id", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    for name in EXTRA:
        df = df.withColumn(name, F.lit(1))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ---- 8 and 1


def test_bpe_equals_the_library_and_round_trips(odd, none, corpus):
    import public_tokenizers

    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS))
    for df in (odd, corpus):
        got = sorted(map(tuple, bpe.digests(df).collect()), key=str)
        want = []
        for i, t in texts_of(df):
            ids = np.array(enc.encode_ordinary(t or ""), "<u4")
            want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        assert got == sorted(want, key=str)
    assert bpe.digests(none).isEmpty()


def test_safe_pieces_give_the_same_ids():
    import public_tokenizers

    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS))
    rnd = random.Random(3)
    for _ in range(200):
        text = "".join(rnd.choice(["a", "Zz", " ", "  ", "\n", " ", "'s", "12", "é", "日", "　", "!", "\x1c", "\t"]) for _ in range(rnd.randrange(80)))
        pieces = list(bpe.safe_pieces(text, 5))
        assert "".join(pieces) == text and list(bpe.encode_text(enc, text, 5)) == enc.encode_ordinary(text)


def slow_sections(enc, text, rule):
    """Token by token and byte by byte."""
    spans, at, out = [(a, b) for a, b in token_counts.line_sections(text)], 0, {}
    byte = [len(text[:i].encode()) for i in range(len(text) + 1)]
    for token in enc.encode_ordinary(text):
        n = len(enc.decode_single_token_bytes(token))
        share = {k: min(byte[b], at + n) - max(byte[a], at) for k, (a, b) in enumerate(spans)}
        share = {k: v for k, v in share.items() if v > 0}
        k = (min(share) if rule == "first" else max(share) if rule == "last" else max(share, key=lambda k: (share[k], -k))) if share else -1
        a, b = out.get(k, (0, 0))
        out[k] = (a + 1, b + (len(share) > 1))
        at += n
    return {k: out.get(k, (0, 0)) for k in range(-1, len(spans))}


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_tokens(spark, rule):
    import public_tokenizers

    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS))
    texts = ["", "a\n\n\nb c\nß日\n!?\n", "one\n two\n\tthree", "\n\n", "é\né", "word.\n\n\n;\n;;\n"]
    df = spark.createDataFrame(rows_of(texts), DOCS)
    got = {}
    for r in token_counts.section_token_counts(df, rule).collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.n_tokens, r.n_crossing)
    assert got == {i: slow_sections(enc, t, rule) for i, t in enumerate(texts)}


def test_section_tokens_add_up_and_take_given_spans(spark, odd, none):
    counts = {(r.doc_id): r.n_tokens for r in token_counts.per_document(token_counts.section_token_counts(odd.dropDuplicates(["doc_id", "text"]).where("doc_id is not null"))).collect()}
    assert counts == {r.doc_id: r.n_tokens for r in bpe.encode(odd).collect() if r.doc_id is not None}
    assert token_counts.section_token_counts(none).isEmpty()
    df = spark.createDataFrame([(1, "alpha beta", [(6, 10), (0, 7), None, (3, 99)]), (2, "x", None)], "doc_id long, text string, own array<struct<start:int,end:int>>")
    got = {(r.doc_id, r.section): (r.start_char, r.end_char) for r in token_counts.section_token_counts(df, sections="own").collect() if r.section >= 0}
    assert got == {(1, 0): (0, 7), (1, 1): (7, 10), (1, 2): (10, 10)}
    with pytest.raises(ValueError):
        token_counts.section_token_counts(df, rule="other")


# ---- 2


def test_quality_classifier(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    known = [(got[r.doc_id], r.quality) for r in labels.collect()]
    held = [(g.predicted, q) for g, q in known if g.held_out]
    assert len(held) > 50 and sum(p == q for p, q in held) >= 0.97 * len(held)
    assert all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.5) for g in got.values())
    # held-out labels have no influence
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.classify(docs, turned).collect()}
    assert all(abs(again[k] - g.score) < 1e-9 for k, g in got.items())
    assert quality.classify(odd, labels.limit(0)).where("score = 0.5").count() == odd.count()
    assert quality.classify(none, labels).isEmpty() and quality.keep_good(none, labels).isEmpty()
    kept = quality.keep_good(docs.withColumn("h", F.lit(2)), labels)
    assert kept.columns == [*docs.columns, "h"] and {r.doc_id for r in kept.collect()} == {k for k, g in got.items() if g.predicted}


def test_discriminant_equals_dense_formula():
    rng = np.random.default_rng(1)
    sums, data = {}, {}
    for c, n in ((0, 50), (1, 80)):
        x = data[c] = rng.normal(c, 1 + c, (n, quality.N_FEATURES))
        sums[c] = (n, x.sum(0), x.T @ x)
    model, x = quality.fit(sums, 0.0, 0.0), rng.normal(size=(5, quality.N_FEATURES))

    def density(c):
        s, d = np.cov(data[c].T, bias=True), x - data[c].mean(0)
        return np.log(len(data[c]) / 130) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1]

    assert np.allclose(model.difference(x), density(1) - density(0))
    assert quality.fit({1: sums[1]}) is None
    assert quality.best_shift({-9: (5, 0), -3: (1, 0), 4: (0, 7)}) == pytest.approx(-1.0, abs=1.1)


def test_statistics_equal_plain_counts(odd, none, corpus):
    for df in (odd, corpus):
        got = sorted((str(r.doc_id), [round(v, 9) for v in r.x]) for r in quality.features(df).collect())
        assert got == sorted((str(i), [round(v, 9) for v in brute.statistics(t or "")]) for i, t in texts_of(df))
    assert quality.features(none).isEmpty()


def test_scores_equal_the_textbook(spark, odd, corpus):
    """A trained model on all of a corpus and on odd rows; a label row that repeats counts again, one without an id or label does not."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    labels = labels.unionByName(labels.where("doc_id % 5 = 0")).unionByName(spark.createDataFrame([(None, 1), (3, None)], labels.schema))
    model = quality.train(quality.features(corpus), labels)
    texts = dict(texts_of(corpus))
    known = [(texts[r.doc_id], r.quality) for r in labels.where(~quality.held_out(F.col("doc_id"))).where("quality is not null").collect() if r.doc_id in texts]
    vectors, classes = [brute.statistics(t or "") for t, _ in known], [q for _, q in known]
    for df in (corpus, odd):
        rows = texts_of(df)
        want = brute.discriminant(vectors, classes, [brute.statistics(t or "") for _, t in rows], quality.POOLED, quality.RIDGE) + model.shift
        got = sorted((str(r.doc_id), round(r.score, 5)) for r in quality.score(quality.features(df), model).collect())
        assert got == sorted((str(i), round(float(0.5 + 0.5 * d / (quality.SCALE + abs(d))), 5)) for (i, _), d in zip(rows, want, strict=True))


# ---- 3


def slow_fingerprint(raw):
    cuts = {}

    def values():
        for i in range(len(raw)):
            w = [raw[j] if j >= 0 else 0 for j in range(i, i - ctph.WINDOW, -1)]
            h3 = 0
            for k, b in enumerate(w):
                h3 ^= (b << 5 * k) & 0xFFFFFFFF
            yield (sum(w) + sum((ctph.WINDOW - k) * b for k, b in enumerate(w)) + h3) & 0xFFFFFFFF

    rolled = list(values())

    def ends(block):
        if block not in cuts:
            cuts[block] = [i + 1 for i, v in enumerate(rolled) if ((v + 1) & 0xFFFFFFFF) % block == 0]
        return cuts[block]

    block = ctph.LEAST_BLOCK
    while block * ctph.LENGTH < len(raw):
        block *= 2
    while block > ctph.LEAST_BLOCK and len(ends(block)) < ctph.LENGTH // 2 - 1:
        block //= 2
    return f"{block}:{ctph.signature(raw, ends(block))}:{ctph.signature(raw, ends(2 * block))}"


def test_ctph(spark, odd, none, corpus):
    raws = [(t or "").encode()[:9000] for _, t in texts_of(corpus)[:60]] + [b"", b"a", b"aaaaaaaaaaaaaaaa" * 40, bytes(range(256))]
    assert ctph.fingerprints(raws) == [slow_fingerprint(r) for r in raws]
    for df in (corpus, odd):
        got = [tuple(r) for r in ctph.edits(df).collect()]
        order = sorted(((i, t or "") for i, t in texts_of(df)), key=lambda x: (x[0] is None, -(x[0] or 0), np.uint64(xxhash.xxh64_intdigest(x[1].encode(), 42)).astype(np.int64)))
        want = []
        for k, (i, t) in enumerate(order):
            e = ctph.edited(t, order[(k + 1) % len(order)][1]).encode()
            want.append((i, len(t), hashlib.sha256(e).hexdigest(), *ctph.fingerprints([t.encode(), e, order[(k + 1) % len(order)][1].encode()])))
        assert sorted(got, key=str) == sorted(want, key=str)
    assert ctph.edits(none).isEmpty() and ctph.fingerprint(none).isEmpty()
    lone = spark.createDataFrame(rows_of(["abcdef"]), DOCS)
    assert ctph.edits(lone).first().edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_ctph_likeness(spark):
    rows = [("3:ABC:AB", "3:ABC:AB", 1.0), ("3:ABCD:AB", "3:ABXD:AB", 0.75), ("6:ABCDEFGH:QQ", "3:ZZZZ:ABCDEFGH", 1.0), ("3:ZZZZ:ABCDEFGX", "6:ABCDEFGH:QQ", 0.875), ("6:A:A", "3:ZZZZ:A", 0.0), ("12:ABCDEFGH:QQ", "3:ZZZZ:ABCDEFGH", 0.0), ("3::", "3::", 1.0), ("3:ABCDEFGH:ABCDEFG", "3:QRSTUVWX:ABCDEFG", 1.0)]
    df = spark.createDataFrame(rows, "a string, b string, want double")
    assert all(r[0] == r[1] for r in df.select(ctph.likeness(F.col("a"), F.col("b")), "want").collect())
    got = spark.read.parquet(f"{SF}/documents.parquet")
    near = ctph.op3_ctph(got.sparkSession, SF).where("n_chars > 400").agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert near[0] > 0.55 and near[1] < 0.2


# ---- 6


def test_simhash_equals_brute_force(odd, none, corpus):
    for df in (corpus, odd):
        rows = texts_of(df)
        fps = [brute.simhash(t) for _, t in rows]
        roots = brute.components(sorted(set(fps)), lambda a, b: (a ^ b).bit_count() <= 2)
        least = {}
        for (i, _), fp in zip(rows, fps, strict=True):
            if i is not None:
                least[roots[fp]] = min(i, least.get(roots[fp], i))
        want = sorted(((i, fp, least.get(roots[fp])) for (i, _), fp in zip(rows, fps, strict=True)), key=str)
        for limit in (simhash.MAX_BUCKET, 1):
            got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.components(df, max_bucket=limit).collect()]
            assert sorted(got, key=str) == want
    assert simhash.components(none).isEmpty()


@pytest.mark.parametrize("limit", [4, simhash.MAX_BUCKET])
def test_links_lose_nothing(spark, limit):
    rnd = random.Random(limit)
    fps = {rnd.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:10]:
        for _ in range(25):
            g = f
            for b in rnd.sample(range(64), rnd.randrange(1, 5)):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    got = {r.node & (1 << 64) - 1: r.root for r in graph.connected_components(simhash.links(df, max_bucket=limit)).collect()}
    want = brute.components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    groups = {}
    for f in fps:
        groups.setdefault(want[f], []).append(f)
    for members in groups.values():
        assert len({got.get(f) for f in members}) == 1 and (len(members) == 1) == (got.get(members[0]) is None)


def test_bit_slices_with_many_buckets():
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps, ends = [], []
    for c in centre:
        n = int(rng.integers(1, 140))
        for _ in range(n):
            f = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                f ^= 1 << int(b)
            fps.append(f)
        ends += [len(fps)] * n
    for radius in (0, 1, 2, 3):
        label = simhash.linked(np.array(fps, np.uint64)[:, None], np.array(ends), radius)
        for a in sorted(set(ends)):
            own = [i for i, e in enumerate(ends) if e == a]
            want = brute.components(own, lambda i, j, r=radius: (fps[i] ^ fps[j]).bit_count() <= r)
            assert [int(label[i]) for i in own] == [want[i] for i in own]


def test_keep_one(odd, none, corpus):
    for groups in (lambda d: simhash.similar(d), lambda d: simhash.components(d)):
        got = simhash.keep_one(odd, groups(odd))
        assert got.columns == odd.columns
        # 0: "", null and blank texts; the repeated row once; others alone
        assert sorted((r.doc_id, (r.text or "")[:5]) for r in got.collect() if r.doc_id is not None) == [(0, ""), (3, "One t"), (4, "naïve"), (5, "w0 w1"), (6, "xxxxx"), (7, "a b c")]
        assert [r.text for r in got.where("doc_id is null").collect()] == ["no id"]
        assert simhash.keep_one(none, groups(none)).isEmpty()
    ids = {r.component_id for r in simhash.similar(corpus).collect()}
    assert {r.doc_id for r in simhash.keep_one(corpus).collect()} == ids


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.mark.parametrize("limit", [40, simhash.MAX_BUCKET])
def test_similar_texts_meet_and_others_do_not(spark, limit):
    rnd = random.Random(11)
    texts = [[f"w{rnd.randrange(4000)}" for _ in range(rnd.choice([12, 60, 300]))] for _ in range(120)]
    texts += [[w if rnd.random() > 0.01 else "edit" for w in texts[k % 40]] for k in range(160)]
    texts += [[w if rnd.random() > 0.004 else f"e{k}" for w in texts[2]] for k in range(150)]
    texts = [" ".join(t) for t in texts]
    own = [shingles(t) for t in texts]
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows_of(texts), DOCS), max_bucket=limit).collect()}
    like = lambda a, b: len(own[a] & own[b]) / len(own[a] | own[b])
    pairs = {(a, b): like(a, b) for a in range(len(texts)) for b in range(a)}
    near = [got[a] == got[b] for (a, b), j in pairs.items() if j >= 0.8]
    assert len(near) > 300 and sum(near) >= 0.97 * len(near)
    # texts share a component only through texts that are alike
    chained = brute.components(list(range(len(texts))), lambda a, b: pairs[max(a, b), min(a, b)] >= 0.4)
    assert all(chained[a] == chained[got[a]] for a in got)


def test_every_pair_of_a_crowded_bucket_is_compared(spark, monkeypatch):
    rnd = random.Random(12)
    texts = [" ".join(f"w{rnd.randrange(4000)}" for _ in range(100)) for _ in range(400)]
    texts += [f"{t} end" for t in texts]
    monkeypatch.setattr(simhash, "tables", lambda n: [0])  # one bucket
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows_of(texts), DOCS), max_bucket=50).collect()}
    assert got == {k: k % 400 for k in range(800)}


@pytest.mark.parametrize("group", [simhash.GROUP, 12])
def test_only_texts_of_enough_common_shingles_are_joined(spark, monkeypatch, group):
    rnd = random.Random(13)
    texts = []
    for k in range(60):
        base = [f"w{rnd.randrange(4000)}" for _ in range(400)]
        # the last words differ: common shingles of all, about 0.95, 0.82, 0.77, 0.7
        texts += [" ".join(base[:n] + [f"x{k}_{n}_{i}" for i in range(400 - n)]) for n in (400, 390, 360, 348, 330)]
    texts += ["", " ", None]
    own = [shingles(t or "") for t in texts]
    monkeypatch.setattr(simhash, "tables", lambda n: [0])  # one bucket
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows_of(texts), DOCS), group=group).collect()}
    assert got == brute.components(list(range(len(texts))), lambda a, b: len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b]))


def test_recall_on_documents(spark):
    """Of all pairs of different texts with a similarity of 0.8, nine in ten at least end in one component, and components are no wider
    than chains of such pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.component_id for r in simhash.similar(docs).collect()}
    sets = {}
    for i, t in texts_of(docs):
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + simhash.SHINGLE]) for k in range(max(1, len(w) - simhash.SHINGLE + 1))}
    where, links = {}, []
    for i, own in sets.items():
        for x in own:
            where.setdefault(x, []).append(i)
    for i, own in sets.items():
        common = {}
        for x in own:
            for j in where[x]:
                common[j] = common.get(j, 0) + 1
        links += [(i, j) for j, n in common.items() if j < i and n >= simhash.LIKE * (len(own) + len(sets[j]) - n)]
    linked = set(links)
    want = brute.components(sorted(sets), lambda a, b: (max(a, b), min(a, b)) in linked)
    assert len(links) > 20 and sum(got[a] == got[b] for a, b in links) >= 0.9 * len(links)
    assert all(want[i] == want[c] for i, c in got.items())


def test_tables_keep_their_recall():
    for n in (10, 10**6, 10**10):
        masks = simhash.tables(n)
        width = (masks[0] & (1 << 64) - 1).bit_count()
        assert 1 - (1 - simhash.KEY_SHARE**width) ** len(masks) >= simhash.CHANCE and n >> width <= 16


def test_components_of_chains_and_hubs(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(600, 700)] + [(7, 7), (None, 3), (900, 800), (800, 900)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {500: 500} | {i: 500 for i in range(600, 700)} | {800: 800, 900: 800}
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).isEmpty()


# ---- 7


def test_targets(spark):
    def targets(sizes):
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        out = {r.source: r.target for r in mixing.targets(rows).collect()}
        assert out == pytest.approx(brute.targets(sizes))
        return out

    rnd = random.Random(9)
    for n in (0, 1, 2, 7, 60):
        targets({None if k == 5 else f"s{k}": rnd.choice([0, 1, 9, 100, 5000]) for k in range(n)})
    got = targets({"a": 100, "b": 1000, None: 10, "c": 0})
    # a, b, c, null weigh 5, 2, 1, 5; a and null are full at twice their size, c has nothing, b takes the rest
    assert got == {"a": 200.0, "b": 1445.0, "c": 0.0, None: 20.0}
    assert sum(got.values()) == 1.5 * 1110
    assert targets({"b": 10, "a": 10, "c": 10}) == {"a": 20.0, "b": pytest.approx(50 / 3), "c": pytest.approx(25 / 3)}


def slow_mix(rows, seed_order):
    """taken by doc, walking each source's documents in order, twice round; then one document more or less."""
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    wanted, out = brute.targets(sizes), {}
    for s, total in sizes.items():
        own = [(i, n) for i, src, n in seed_order if src == s]
        at, copies = 0, {}
        for lap in (0, 1):
            for i, n in own:
                if n and at + n / 2 < wanted[s]:
                    copies[i] = copies.get(i, 0) + 1
                at += n
        out |= {i: (copies.get(i, 0), n) for i, n in own}
        gap = wanted[s] - sum(c * n for c, n in (out[i] for i, _ in own))
        spare = [(abs(abs(gap) - n), k, i) for k, (i, n) in enumerate(own) if n and abs(abs(gap) - n) < abs(gap) and (out[i][0] < 2 if gap > 0 else out[i][0] > 0)]
        if spare:
            i = min(spare)[2]
            out[i] = (out[i][0] + (1 if gap > 0 else -1), out[i][1])
    return {i: c for i, (c, _) in out.items()}


def test_mix(spark, odd, none, corpus, monkeypatch):
    for bucket in (mixing.BUCKET_ROWS, 3):
        monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
        got = {r.doc_id: r for r in mixing.plan(corpus).collect()}
        order = mixing._sized(corpus).withColumn("h", F.md5(F.concat_ws(":", F.lit(mixing.SEED), "doc_id", "size"))).orderBy("h").collect()
        want = slow_mix([(r.doc_id, r.source, r.size) for r in order], [(r.doc_id, r.source, r.size) for r in order])
        assert {i: r.copies for i, r in got.items()} == want
        assert all(len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions) for r in got.values())
    mixed = mixing.mix(corpus.withColumn("size", F.lit("clash")))
    assert mixed.columns == [*corpus.columns, "size"] and mixed.count() == sum(want.values())
    assert mixing.plan(none).isEmpty() and mixing.mix(none).isEmpty()
    rows = mixing.plan(odd).collect()
    assert sum(r.n for r in rows) == odd.count() and all(r.copies <= 2 for r in rows)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    names = "doc_id, size, source_size, target, taken, position"
    assert sorted(map(tuple, mixing.op7_curriculum_mix(spark, SF).select(*names.split(", ")).collect()), key=str) == sorted(con.sql(f"select {names} from ({mixing.OP7_SQL})").fetchall(), key=str)
    query = mixing.op7_curriculum_mix(spark, SF)
    assert query.count() == corpus.count() and query.where("taken > 2 * size").isEmpty()


def test_schedule_moves_heavy_sources_forward(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two three four five").alias("text"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"))
    place = {r.source: r.p for r in mixing.plan(docs, share=0.3).select("source", F.explode("positions").alias("p")).groupBy("source").agg(F.avg("p").alias("p")).collect()}
    assert place["s0"] < 0.45 < place["s1"] < 0.55 < place["s2"]


def test_join_hot_equals_join(spark, monkeypatch):
    rnd = random.Random(2)
    rows = spark.createDataFrame([(rnd.choice(["a"] * 20 + ["b", "c", "d", None]), i) for i in range(200)], "k string, i long")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top"))
    want = sorted(map(tuple, rows.join(groups, "k").select("k", "i", "n", "top").collect()))
    for keys in (1, 10, 1000):
        monkeypatch.setattr(common, "HOT_KEYS", keys)
        assert sorted(map(tuple, common.join_hot(rows, groups, "k", "n", 200).collect())) == want
        assert sorted(map(tuple, common.join_hot(rows, groups.withColumn("i2", F.col("n")), ["k"], "n", 200).drop("i2").collect())) == want
    assert common.join_hot(rows.limit(0), groups, "k", "n", 0).isEmpty()


# ---- 10


def test_blocks_are_ranked_in_the_order_of_their_halves(spark):
    rnd = random.Random(6)
    pairs = [(rnd.randrange(6), rnd.randrange(6)) for _ in range(60)]
    got = lines.ranked(spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k long, a long, b long")).collect()
    twice = [p for p in pairs if pairs.count(p) > 1]
    assert sorted(r.k for r in got) == [k for k, p in enumerate(pairs) if p in twice]
    order = {}
    for r in got:
        assert order.setdefault(pairs[r.k], r.r) == r.r
    assert [order[p] for p in sorted(order)] == sorted(order.values()) and len(set(order.values())) == len(order)


def test_repeated_rows_and_long_runs(spark):
    """Fully equal rows stay alike; runs of many lines of one word, in one document or several, with and without ids."""
    long = "\n".join(f"w{i % 7}" for i in range(400))
    other = "\n".join(f"v{i}" for i in range(70))
    texts = [(1, other + "\n" + long), (1, other + "\n" + long), (2, "x\n" + other + "\ny"), (None, other), (3, long)]
    df = spark.createDataFrame(rows_of([t for _, t in texts], [i for i, _ in texts]), DOCS)
    got = sorted((str(r.doc_id), len(r["__ql_removed"])) for r in lines.remove_repeats(df).collect())
    gone = brute.removed_lines([(1, texts[0][1]), (2, texts[2][1]), (3, long), (9, other)], 50)
    assert got == sorted([("1", len(gone[1])), ("1", len(gone[1])), ("2", len(gone[2])), ("3", len(gone[3])), ("None", len(gone[9]))])


def test_lines_equal_brute_force(spark, odd, none, corpus):
    rnd = random.Random(4)
    vocabulary = [" ".join(f"t{rnd.randrange(5)}" for _ in range(rnd.randrange(1, 5))) for _ in range(7)] + ["", "  "]
    for least in (1, 4, 9):
        texts = ["\n".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 14))) for _ in range(40)]
        texts = [t for k, t in enumerate(texts) if t not in texts[:k]]
        df = spark.createDataFrame(rows_of(texts), DOCS)
        got = {r.doc_id: (set(r["__ql_removed"]), r.text) for r in lines.remove_repeats(df, least).collect()}
        want = brute.removed_lines(list(enumerate(texts)), least)
        worded = {d: {i for i, x in enumerate(t.split("\n")) if x.strip()} for d, t in enumerate(texts)}
        assert {d: g[0] & worded[d] for d, g in got.items()} == want
        assert all(g[0] == set() or min(want[d]) <= min(g[0]) <= max(g[0]) <= max(want[d]) for d, g in got.items())
        assert all(got[d][1] == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in got[d][0]) for d, t in enumerate(texts))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    assert sorted(map(tuple, lines.op10_line_runs(spark, SF).collect())) == sorted(con.sql(f"select doc_id, n_lines, n_removed, removed, text from ({lines.OP10_SQL})").fetchall())
    out = lines.remove_repeats(odd)
    assert out.columns == [*odd.columns, "__ql_lines", "__ql_removed"] and out.count() == odd.count()
    assert out.where("doc_id = 1").first().text is None and out.where("doc_id = 3 and size(__ql_removed) = 0").count() == 2
    assert lines.remove_repeats(none).isEmpty()


# ---- 9


def test_rules_equal_brute_force(odd, none, corpus):
    weights = [0] * rules.BUCKETS
    for df in (odd, corpus):
        got = [tuple(r)[:7] for r in rules.rules(df, weights).collect()]
        assert sorted(got, key=str) == sorted(((i, *brute.rules(t)) for i, t in texts_of(df)), key=str)
    assert rules.rules(none, weights).isEmpty()


def test_likelihood_ratio(spark, none, corpus, monkeypatch):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counted = {r.bucket: (r.target, r.raw) for r in rules.counts(docs, labels.where("quality = 1")).collect()}
    monkeypatch.setattr(rules, "BROADCAST_IDS", 0)
    assert counted == {r.bucket: (r.target, r.raw) for r in rules.counts(docs, labels.where("quality = 1")).collect()}
    assert sum(r for _, r in counted.values()) == 2 * sum(len(brute.WORD.findall(t)) for _, t in texts_of(docs))
    got = rules.rules(docs, rules.weights(rules.counts(docs, labels.where("quality = 1")))).join(labels, "doc_id").where("not base_failed")
    share = {r.quality: r.k for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] > 0.99 and share[0] < 0.1
    assert rules.weights(rules.counts(none, labels)) == [0] * rules.BUCKETS
    assert rules.weights(rules.counts(corpus, labels.limit(0))) == [0] * rules.BUCKETS


def test_likelihood_ratio_equals_plain_counts(spark, odd, corpus):
    """Weights of a corpus with trusted ids that repeat or are null, applied to it and to odd rows."""
    import math

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    trusted = labels.where("quality = 1").select("doc_id")
    trusted = trusted.unionByName(trusted.limit(5)).unionByName(spark.createDataFrame([(None,)], "doc_id long"))
    ids = {r.doc_id for r in trusted.collect()}
    target, raw = [0] * rules.BUCKETS, [0] * rules.BUCKETS
    for i, t in texts_of(corpus):
        for b in brute.gram_buckets(t, rules.BUCKETS):
            raw[b] += 1
            target[b] += i in ids
    a, z = sum(target) + rules.BUCKETS, sum(raw) + rules.BUCKETS
    want = [round(1000 * (math.log((t + 1) / a) - math.log((r + 1) / z))) for t, r in zip(target, raw, strict=True)]
    assert rules.weights(rules.counts(corpus, trusted)) == want
    for df in (corpus, odd):
        got = sorted(((r.doc_id, r.llr, r.kept) for r in rules.rules(df, want).collect()), key=str)
        expected = []
        for i, t in texts_of(df):
            n, failed = len(brute.WORD.findall(t or "")), brute.rules(t)[-1]
            total = sum(want[b] for b in brute.gram_buckets(t, rules.BUCKETS))
            expected.append((i, total / (2 * n) if n else None, not failed and total >= rules.THRESHOLD * 2 * n))
        assert got == sorted(expected, key=str)


# ---- 5

TRICKY = [
    "a@b.c@d.e x@y z.@-.- mail me: j.doe+x@mail-1.example.co.uk, and a@b",
    "1.2.3.4.5.6.7.8 255.256.1.1 0255.1.1.1 001.002.003.004 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 378282246310005 4111111111111111 4111111111111111",
    "+1 (555) 123-4567 +49.30.1234567 +1 +12 +1234567890123456 ++1 (2)34567890)",
    "é\U0001f600 ann@ex.org \x01 +1 (555) 123-4567\x01 9" * 3,
    "1" * 30000 + " " + "a" * 30000 + "@" + "1." * 20000,
    "",
]


def test_base_spans_equal_brute_force(spark, odd, none, corpus):
    model = pii.train(spark, 600)
    df = spark.createDataFrame(rows_of(TRICKY), DOCS)
    for d in (df, odd, corpus):
        found = pii.personal_data(d, model)
        got = sorted((str(r.doc_id), r.b) for r in found.select("doc_id", pii.listed(F.col("base")).alias("b")).collect())
        assert got == sorted((str(i), ",".join(brute.base_spans(t))) for i, t in texts_of(d))
    assert pii.personal_data(none, model).isEmpty()


def test_trees_select_and_redact(spark):
    trees, bounds = pii.train(spark)
    cells = pii.examples(spark, 520).select("label", "s", F.explode(pii.candidates(F.col("text"))).alias("c")).where("abs(c.s - s) <= 1").select("label", "c.*", pii._score(trees, F.col("c")).alias("v")).collect()
    assert all(abs(pii.value(trees, tuple(r[f] for f in pii.FEATURES)) - r.v) < 1e-9 for r in cells)
    assert sum((r.v > 0) == bool(r.label) for r in cells) > 0.9 * len(cells)
    text = 'Write ann (at) mail (dot) com, token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", call 030 1234567 or +1 (555) 123-4567. Version 2.0 of 2024-05-17.'
    found = pii.personal_data(spark.createDataFrame(rows_of([text]), DOCS), (trees, bounds))
    out = pii.redact(found).first().text
    assert "24be6443" not in out and "123-4567" not in out and "Version 2.0 of 2024-05-17." in out and out.startswith("Write ") and "[PHONE]" in out
    spans = found.first()
    assert not any(a.s < b.e and b.s < a.e for a in spans.added for b in spans.base)


def test_selection_equals_plain_python(spark, odd, corpus):
    """Scores, bounds and overlaps of all candidates of whole tables, with ties between candidates of one span."""
    trees, bounds = pii.train(spark)
    made = spark.createDataFrame(rows_of(["password=ann@example.org key: 0123456789abcdef0123 token=4111111111111111", "tel 030 1234567 030 1234567", "1" * 80 + "a" * 20, "a" * 40 + "_key=" + "x9" * 10]), DOCS)
    for df, model in ((corpus, (trees, bounds)), (odd, (trees, bounds)), (made, (trees, bounds)), (made, ([], [0.0] * len(bounds)))):
        rows = df.select(F.coalesce("text", F.lit("")).alias("text")).select("text", pii.base_spans(F.col("text")).alias("base"), pii.candidates(F.col("text")).alias("c")).collect()
        want = []
        for r in rows:
            chosen = [(c.s, c.e, c.k) for c in r.c if pii.value(model[0], tuple(c[f] for f in pii.FEATURES)) >= model[1][c.gen]]
            want.append((r.text, brute.added_spans([(b.s, b.e) for b in r.base], chosen)))
        got = [(r.text, [(x.s, x.k, x.e) for x in r.added]) for r in pii.personal_data(df, model).collect()]
        assert sorted(got) == sorted(want)


def test_calibration_holds_on_examples_not_seen(spark):
    """Precision and recall over examples with other numbers than those that were fitted or calibrated on."""
    trees, bounds = pii.train(spark)
    seen = pii.examples(spark).select("text")
    fresh = pii.examples(spark, 3 * pii.N_EXAMPLES).join(seen, "text", "left_anti")
    rows = fresh.select("label", "s", F.explode(pii.candidates(F.col("text"))).alias("c")).where("abs(c.s - s) <= 1").select("label", "c.*").collect()
    chosen = [r.label for r in rows if pii.value(trees, tuple(r[f] for f in pii.FEATURES)) >= bounds[r.gen]]
    assert len(rows) > 1000 and sum(chosen) >= 0.95 * len(chosen) and sum(chosen) >= 0.7 * sum(r.label for r in rows)


def test_all_of_overlapping_candidates_is_redacted(spark):
    model = ([], [0.0] * len(pii.GENERATORS))  # all candidates count
    texts = ["password=xy-ann@example.org/9f8e7d6c end", "key: 4111111111111111abcdefabcdefabcdefabcdef end", "token = 0123456789/abcdefabcdefabcdef end"]
    df = spark.createDataFrame(rows_of(texts), DOCS)
    found = pii.personal_data(df, model)
    wanted = {r.doc_id: r.c for r in df.select("doc_id", pii.candidates(F.col("text")).alias("c")).collect()}
    for r in found.collect():
        spans = sorted((x.s, x.e) for x in [*r.base, *r.added])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert all(any(s <= i < e for s, e in spans) for c in wanted[r.doc_id] for i in range(c.s, c.e))
    assert all(r.text.endswith("] end") for r in pii.redact(found).collect())


# ---- 4

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="search-page"><header class="masthead"><p>Site</p></header>
<nav><ul><li><a href="/x">Home</a><li>Two</ul></nav><div class="cookie-notice">We use cookies</div><aside>Side</aside><main><article><h1>Title &amp; more</h1>
<p>First <b>bold</b>
 text&nbsp;here &lt;3<br>second line<p>Unclosed <a href="a>b">link</a><ul><li>one</li><li>two</li></ul><div class="ad">Buy</div><form><p>Name</p><input></form>
<table><tr><td>cell</td></tr></table></article><section id="comments"><p>First!</p></section></main><footer>&copy; me</footer></body></html>"""


def test_main_text(spark):
    got = html.extract(PAGE, None)
    assert got.split("\n") == ["Title & more", "First bold text here <3", "second line", "Unclosed link", "one", "two", "cell"]
    assert html.extract("", None) == "" and html.extract("just text", None) == "just text"
    assert html.extract("<p>a<!-- x <p>y</p> --><script>1<p>", []) == "a"
    rows = [(1, "http://a.example/1", PAGE), (2, "http://a.example/2", PAGE), (2, "http://a.example/2", PAGE), (3, None, None), (4, "http://b.example", ""), (None, "x", "<article>" + "<p>long " * 20000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("template", F.lit(2)).withColumn("token", F.lit(2))
    out = sorted(((r.page_id or 0, r.text) for r in html.main_text(df).collect()), key=str)
    assert [t for i, t in out if i in (1, 2)] == [got] * 3 and [t for i, t in out if i in (3, 4)] == ["", ""] and out[0][1].count("long") == 20000
    assert html.main_text(df.limit(0)).isEmpty()


def test_long_paths_keep_their_text(spark):
    wide = " ".join(f"utility{i}" for i in range(60))
    deep = f"<article><h1>Title</h1>{f'<div class="{wide}">' * 4}<p>inner</p>{'</div>' * 4}<p>last</p></article><p>beside</p>"
    piled = f"<article><p>first</p>{'<font color=red>x ' * 300}<div>end</div></article>"
    for page, want in ((deep, ["Title", "inner", "last"]), (piled, ["first", " ".join("x" * 300), "end"])):
        assert html.extract(page, None).split("\n") == want
    tokens = html.templates(spark.createDataFrame([(1, "http://h.example/", deep)], "page_id long, url string, html string")).first().template
    assert len([x for x in tokens if x[:1] in "/#"]) == 9 and max(map(len, tokens)) < 3000


def test_pages_without_one_article_element_stay_whole():
    long = "long text " * 30
    for page in (
        f"<body><nav>n</nav><div id=content><h1>T</h1><p>{long}</p><ul><li>one</li></ul><p>end</p></div><footer>f</footer></body>",
        f"<body><div class=sidebar>s</div><div><h1 class=article-title>T</h1><div class=article-body><p>{long}</p><ul><li>one</ul><p>end</div></div></body>",
        f"<main><article id=a><h1>T</h1><p>{long}</p></article><article id=b><p>one</p><p>end</p></article></main>",
        f"<article></article><div><h2>T</h2><p>{long}<p>one<p>end</div>",
    ):
        assert html.extract(page, None).split("\n") == ["T", long.strip(), "one", "end"]


def test_constant_text_goes_and_copied_articles_stay(spark):
    rnd = random.Random(5)
    words = lambda n: " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))
    bodies = [[words(40) for _ in range(3)] for _ in range(8)]
    copied = [words(40) for _ in range(4)]
    edited = [[p if rnd.random() > 0.2 else f"{p} edit{k}" for p in copied] for k in range(8)]
    page = lambda ps: f"<body><p>Subscribe to our daily letter</p><div>{''.join(f'<p>{p}</p>' for p in ps)}</div><p>All rights reserved</p></body>"
    rows = [(k, f"http://own.example/{k}", page(ps)) for k, ps in enumerate(bodies)] + [(10 + k, f"http://copy.example/{k}", page(ps)) for k, ps in enumerate(edited)]
    got = {r.page_id: r.text.split("\n") for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == ps for k, ps in enumerate(bodies))
    assert all([x for x in got[10 + k] if x in ps] == ps for k, ps in enumerate(edited))


def test_template_decides_where_no_name_tells(spark):
    rnd = random.Random(8)
    words = lambda n: " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))
    own = [[words(6), words(25), words(8), words(14)] for _ in range(8)]
    menu = [words(1) for _ in range(4)]
    notice = words(20)
    page = lambda k, ps: (
        f"<body><div><span>{menu[k % 4]}</span><div>{menu[(k + 1) % 4]}</div></div><div><div>{ps[0]}</div><div>{ps[1]}</div><div><div>{ps[2]}</div></div><div>{ps[3]}</div></div>"
        f"<div>{notice}</div><div><div><a href=x>{words(3)}</a></div><div><a href=y>{words(3)}</a></div><div><a href=z>{words(3)}</a></div></div><div>imprint</div></body>"
    )
    rows = [(k, f"http://plain.example/{k}", page(k, ps)) for k, ps in enumerate(own)]
    got = {r.page_id: r.text.split("\n") for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, ps in enumerate(own):
        left = [x for x in got[k] if x not in menu]
        assert left == ps and len(got[k]) <= len(ps) + 2
        assert {"imprint", notice} < set(html.extract(rows[k][2], None).split("\n"))


def test_words_inside_articles_do_not_decide():
    text = "some text " * 20
    page = f"<body class='no-sidebar'><div class='menu-layout'><article class='has-sidebar'><div class=entry-header><h1>Title</h1></div><p class=form>{text}</p><footer>by me</footer></article><article class=second><p>more</p></article></div><div class=search>find</div></body>"
    assert html.extract(page, None).split("\n") == ["Title", text.strip(), "more"]
    deep = f"<article>{'<div class=x>' * 100}<p>{text}</p>{'</div>' * 100}<article class=comment><p>first!</p></article></article>"
    assert html.extract(deep, None) == text.strip()


def test_vectors_of_many_pages_stay_apart(spark):
    """Against plain Python: classes are tokens with equal counts on all pages."""
    pages = [(i, "http://h.example/", f"<div>{'<p>x</p>' * (i % 2 + 1)}{'<hr>' * (i % 2 + 1)}<ul>{'<li>y' * 2}</ul>{'<img>' if i < 2 else ''}</div>") for i in range(6)]
    got = html.occurrences(spark.createDataFrame(pages, "page_id long, url string, html string")).where("substring(token, 1, 1) = '/'").collect()
    by_vector, want = {}, {}
    for r in got:
        by_vector.setdefault((r.n_pages, r.vector), set()).add(r.token)
    counts = [dict(html.slots(x)[0]) for *_, x in pages]
    for t in {t for c in counts for t in c}:
        want.setdefault(tuple(c.get(t, 0) for c in counts), set()).add(t)
    assert sorted(map(sorted, by_vector.values())) == sorted(map(sorted, want.values())) and len(want) == 4


def test_template_classes(spark):
    pages = [(i, f"http://h.example/{i}", f"<html><nav>{'<li>x' * (i % 3 + 1)}</nav><article><h1>t</h1>{'<p>y</p>' * (i + 1)}</article>{'<hr>' if i == 0 else ''}</html>") for i in range(6)]
    tokens = html.templates(spark.createDataFrame(pages, "page_id long, url string, html string")).first().template
    assert [x for x in tokens if x.endswith(("html", "nav", "article", "h1"))] == ["/html", "/html/nav", "/html/article", "/html/article/h1"]
    assert not any(x.endswith("hr") for x in tokens)


def test_pages_equal_their_articles(spark):
    import re
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in html.op4_main_text(spark, SF).collect():
        parts = re.split(r"</?(?:p|h1|br)>", re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1])
        want = "\n".join(x for x in (" ".join(unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in parts) if x)
        assert r.text == want and r.n_chars == len(want)


def test_blocks_meet_the_template_instead_of_pages(spark):
    """Only an article's blocks and a template's text tokens are shuffled, not the page."""
    texts = ["a\nb é\U0001f600 \ud800", "", "x" * 500]
    page = "".join(f"<p>{t}</p>" for t in texts)
    assert html.unpacked(html.packed(page)) == [(t, x) for t, x, _ in html.slots(page)[1]] and html.unpacked(html.packed("")) == []
    shell = "<nav>" + "<a href='/somewhere/else'>away</a>" * 50 + "</nav>"
    rows = [(1, "http://h.example/1", f"{shell}<article><p>one</p></article>"), (2, None, None), (2, None, None), (None, "http://h.example/1", f"{shell}<article><p>two</p></article>")]
    out = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted(map(str, ((r.page_id, r.text) for r in out.collect()))) == sorted(map(str, [(1, "one"), (2, ""), (2, ""), (None, "two")]))
    joined = out._jdf.queryExecution().analyzed().children().apply(0).schema().simpleString()
    assert "html" not in joined and "blocks:binary" in joined
