"""Operator 6: SimHash near-duplicates by bit-sliced comparison.

Fingerprints that differ in at most `radius` bits agree on some BLOCKS - radius of BLOCKS bit blocks. Each distinct fingerprint
is filed under every such choice. Within a bucket, bit planes are stored vertically, one machine word holding one bit of 64
fingerprints; the distances of all fingerprints to their s-th neighbours are counted at once by carry-save bitwise counters,
and words whose lanes all exceed the radius, or are joined already, are abandoned. Buckets over `max_bucket` fingerprints take an
exact linear way.

Beside these exact links at a few bits, `similar` finds near-duplicates whose five-word shingles have a Jaccard similarity of 0.8.
Candidates are found at 75 % of equal bits, by the same comparison: there no choice of blocks is exact and cheap, so buckets come
from sampled bits, with as many tables as a stated recall needs. Candidates are then compared by the shingles themselves.
"""

from __future__ import annotations

import math
import random
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm.common import join_hot, saved, slices, small_batches, table, text_of
from quadloom.llm.graph import connected_components

BITS, SEED = 64, 42
WIDTH, RADIUS = 3, 2
#: Bit blocks, as widths.
BLOCKS = (13, 13, 13, 13, 12)
MAX_BUCKET = 1 << 15
#: Planes between two looks at which words can be abandoned.
STRIDE = 8

#: `similar`: words a shingle, the least Jaccard similarity of two texts' shingles, and the least share of equal bits at which it
#: is looked at (at 0.8, the share is 0.85 with a deviation of 0.03).
SHINGLE, LIKE, SHARE = 5, 0.8, 0.75
#: Texts, and characters of texts, that are compared in one task.
GROUP, GROUP_CHARS = 2048, 1 << 24
#: Bits a table's key samples at least (more as the corpus grows), and the chance that a pair whose key fingerprints agree in
#: KEY_SHARE of their bits meets in some table.
KEY_BITS, KEY_SHARE, CHANCE = 20, 0.87, 0.99
TABLE_SEED = 6
#: Tables of the first pass over candidates; the others then skip pairs that are in one component already.
FIRST = 8


def simhash(raw: bytes, width: int = WIDTH) -> int:
    """The fingerprint of UTF-8 text: bits set in over half of the XXH64 of its word shingles; 0 without words."""
    import numpy as np
    import xxhash

    words = raw.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(x + 1 for x in ends[:-1])]
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :] or ends[-1:], strict=False)], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, h (a hash of the text, to tell rows of one id apart), fp (the 64 bits as a signed long) of each row.

    Null and wordless texts have fp 0.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("h", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches, "text"):
            fps = np.array([simhash(x.encode(), width) for x in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "h", "fp"])

    return small_batches(docs).select("doc_id", F.xxhash64(docs["text"]).alias("h"), text_of(docs).alias("text")).mapInArrow(run, schema)


def mixed(x):
    """The finaliser of SplitMix64 over a uint64 array: a hash of each element."""
    import numpy as np

    u = np.uint64
    x = x + u(0x9E3779B97F4A7C15)
    x = (x ^ (x >> u(30))) * u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> u(27))) * u(0x94D049BB133111EB)
    return x ^ (x >> u(31))


def vote(hashes) -> int:
    """Bits set in over half of the hashes; a tie takes a bit that depends on all of them."""
    import numpy as np

    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    tie = np.unpackbits(mixed(hashes.sum(dtype=np.uint64, keepdims=True)).view(np.uint8), bitorder="little").astype(bool)
    bits = (2 * counts > len(hashes)) | ((2 * counts == len(hashes)) & tie)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def shingle_hashes(raw: bytes, *widths: int) -> list:
    """For each width, the hashes of UTF-8 text's word shingles of that width as a uint64 array; of all words if there are fewer."""
    import numpy as np
    import xxhash

    own = np.array([xxhash.xxh64_intdigest(w, SEED) for w in raw.lower().split()], np.uint64)

    def shingles(width):
        n = len(own) - min(width, len(own)) + 1
        out = own[:n]
        for j in range(1, len(own) - n + 1):
            out = mixed(out) ^ own[j : j + n]
        return mixed(out)

    return [shingles(w) for w in widths]


def wide_simhash(raw: bytes, shingle: int = SHINGLE) -> tuple[int, int, int]:
    """A 64-bit fingerprint of word pairs, for keys, and 128 bits of `shingle`-word shingles, for comparison; 0 without words."""
    pairs, long = shingle_hashes(raw, 2, shingle)
    if not len(long):
        return 0, 0, 0
    return vote(pairs), vote(long), vote(mixed(long))


def wide_fingerprint(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, h (as in fingerprint), key, a, b (the words of wide_simhash as signed longs), size (in characters) of each row."""
    names = ("key", "a", "b")
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(x, T.LongType()) for x in ("h", *names, "size"))])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches, "text"):
            texts = batch.column(2).to_pylist()
            fps = np.array([wide_simhash(x.encode(), shingle) for x in texts], np.uint64).reshape(-1, 3).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(fps[:, i]) for i in range(3)), pa.array([len(x) for x in texts], pa.int64())], schema.names)

    return small_batches(docs).select("doc_id", F.xxhash64(docs["text"]).alias("h"), text_of(docs).alias("text")).mapInArrow(run, schema)


def _planes(fps):
    """(64 x columns, words) array: bit i of word w of plane b is bit b of fingerprint 64 w + i; one zero word at the end."""
    import numpy as np

    padded = np.zeros(((len(fps) + 127) // 64 * 64, fps.shape[1]), np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def linked(fps, ends, radius: int, start=None):
    """For sorted buckets of fingerprints, the least row of each row's component inside its bucket.

    fps: uint64 array, (rows, columns of 64 bits); ends: for each row, the end of its bucket; start: for each row, the least row of
    its bucket that is known to be in its component (itself if none). Pairs that are in one component already are not compared.
    """
    import numpy as np

    n = len(fps)
    planes, label, left = _planes(fps), np.arange(n) if start is None else start, ends - np.arange(n)
    parent = label.tolist()

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    n_counters = (radius + 1).bit_length()
    last = planes.shape[1] - 1
    for s in range(1, int(left.max(initial=0))):
        lanes = np.zeros(planes.shape[1] * 64, bool)
        lanes[: n - s] = (left[: n - s] > s) & (label[: n - s] != label[s:])
        valid = np.packbits(lanes, bitorder="little").view(np.uint64)
        words = np.nonzero(valid)[0]
        valid = valid[words]
        jump, shift = s // 64, np.uint64(s % 64)
        counters, over = [np.zeros(len(words), np.uint64) for _ in range(n_counters)], ~valid
        for b in range(len(planes)):
            if not len(words):
                break
            low = planes[b, np.minimum(words + jump, last)]
            if shift:
                low = (low >> shift) | (planes[b, np.minimum(words + jump + 1, last)] << (np.uint64(64) - shift))
            carry = planes[b, words] ^ low
            for k in range(n_counters):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
            if b % STRIDE == STRIDE - 1:
                # lanes with a count over the radius: compare the counters, from the highest down
                more, equal = np.zeros_like(over), ~np.zeros_like(over)
                for k in reversed(range(n_counters)):
                    if radius >> k & 1:
                        equal &= counters[k]
                    else:
                        more |= equal & counters[k]
                        equal &= ~counters[k]
                over |= more
                keep = np.nonzero(~over)[0]
                if len(keep) < len(words):
                    words, over, counters = words[keep], over[keep], [c[keep] for c in counters]
        if len(words):
            hit = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
            for i in (words[:, None] * 64 + np.arange(64))[hit].tolist():
                a, z = find(i), find(i + s)
                if a != z:
                    parent[max(a, z)] = min(a, z)
            label = np.array(parent)
            while (label[label] != label).any():
                label = label[label]
    return label


def bucket_edges(keyed: DataFrame, columns: list[str], radius: int, known: str | None = None) -> DataFrame:
    """Edges between fingerprints (long `columns`) that share a bucket (c, k) and differ in at most `radius` bits: u_ and v_ of each
    column. A bucket gives a spanning forest of its pairs, never all of them; it is held in one task as 8 bytes a column. known: a
    long column that is equal for fingerprints that are in one component already; these get no edges between them."""

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        held = None

        def flush(c, k, *fp):
            new = np.ones(len(c), bool)
            new[1:] = (c[1:] != c[:-1]) | (k[1:] != k[:-1])
            bounds = np.append(np.nonzero(new)[0], len(c))
            sizes = np.diff(bounds)
            several = np.repeat(sizes > 1, sizes)
            fps, sizes = np.stack(fp[: len(columns)], axis=1)[several], sizes[sizes > 1]
            start = np.arange(len(fps))
            if known:
                part = np.stack([np.repeat(np.arange(len(sizes)), sizes), fp[-1][several]], axis=1)
                _, least, which = np.unique(part, axis=0, return_index=True, return_inverse=True)
                start = least[which.reshape(-1)] if len(fps) else start
            label = linked(fps.view(np.uint64), np.repeat(np.cumsum(sizes), sizes), radius, start)
            joined = np.nonzero((label != start) & (start == np.arange(len(fps))))[0]  # what is known goes with its least row
            ends = (fps[joined], fps[label[joined]])
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[:, i])) for e in ends for i in range(len(columns))], names)

        for batch in batches:
            now = [batch.column(x).to_numpy(zero_copy_only=False) for x in range(batch.num_columns)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if len(held[0]) >= 1 << 16:  # all but the last bucket is complete
                c, k = held[:2]
                cut = int(np.nonzero((c != c[-1]) | (k != k[-1]))[0].max(initial=-1)) + 1
                if cut:
                    yield flush(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held is not None:
            yield flush(*held)

    names = [f"{e}_{x}" for e in "uv" for x in columns]
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = small_batches(keyed).select("c", "k", *columns, *([known] if known else [])).repartition(parts, "c", "k").sortWithinPartitions("c", "k", *columns)
    return dealt.mapInArrow(compare, ", ".join(f"{x} long" for x in names))


def links(fps: DataFrame, radius: int = RADIUS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """u, v: edges between distinct fingerprints (column fp, long), whose components are those of all pairs within `radius`.

    Each bucket gives a spanning forest of its pairs, never all of them.
    """
    masks, free = [], []
    edges_of = [sum(BLOCKS[:i]) for i in range(len(BLOCKS) + 1)]
    for chosen in combinations(range(len(BLOCKS)), len(BLOCKS) - radius):
        mask = sum(((1 << BLOCKS[i]) - 1) << edges_of[i] for i in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
        free.append([b for b in range(BITS) if not mask >> b & 1])
    keyed = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks))).alias("c", "k"))
    crowded = saved(keyed.groupBy("c", "k").agg(F.count("*").alias("n")).where(F.col("n") > max_bucket).select("c", "k"))
    usual = keyed if crowded.isEmpty() else keyed.join(crowded, ["c", "k"], "left_anti")
    found = bucket_edges(usual, ["fp"], radius).select(F.col("u_fp").alias("u"), F.col("v_fp").alias("v"))
    if not crowded.isEmpty():
        # two fingerprints within the radius agree once the same `radius` of the free bits are cleared
        cleared = F.array(*(F.array(*(F.lit(_signed(~sum(1 << b for b in bits))).cast("long") for bits in combinations(own, radius))) for own in free))
        rest = keyed.join(crowded, ["c", "k"], "left_semi").select("fp", F.explode(F.get(cleared, F.col("c"))).alias("clear")).select("fp", "clear", F.col("fp").bitwiseAND(F.col("clear")).alias("key")).distinct()
        heads = rest.groupBy("clear", "key").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
        found = found.union(rest.join(heads, ["clear", "key"]).where("fp != v").select(F.col("fp").alias("u"), "v"))
    return found


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _grouped(own: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, h, fp, root, component_id of own (doc_id, h, fp; saved) with edges (u, v) between its fps."""
    firsts = own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    roots = connected_components(edges).withColumnRenamed("node", "fp")
    firsts = saved(firsts.join(roots, "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")))
    least = saved(firsts.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("fps")))
    rows, texts = firsts.agg(F.sum("n"), F.count("*")).first()
    placed = saved(join_hot(firsts, least, "root", "fps", texts).select("fp", "n", "root", "component_id"))
    return join_hot(own.select("doc_id", "h", "fp"), placed, "fp", "n", rows or 0).select("doc_id", "h", "fp", "root", "component_id")


def components(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """doc_id, h, fp, root, component_id: the least doc_id that links of fingerprints within `radius` bits reach.

    h is as in fingerprint(), root the component's least fp. Null and wordless texts have fp 0 and link like any other. Rows with
    a null doc_id are members like others; if no member has an id, component_id is null. Repeated rows stay.
    """
    own = saved(fingerprint(docs, width))
    return _grouped(own, links(own.select("fp").distinct(), radius, max_bucket))


def tables(n: int, seed: int = TABLE_SEED) -> list[int]:
    """Masks of the key bits of each table for n distinct fingerprints: more bits for more of them, so that buckets of unrelated
    texts stay small, and as many tables as CHANCE asks for at that width."""
    width = min(48, max(KEY_BITS, n.bit_length() - 4))
    number = math.ceil(math.log(1 - CHANCE) / math.log(1 - KEY_SHARE**width))
    rnd = random.Random(seed)
    return [_signed(sum(1 << b for b in rnd.sample(range(BITS), width))) for _ in range(number)]


def block_pairs(place: Column, blocks: Column) -> Column:
    """The pairs (low, high) of blocks that the block of a row, by the hash `place`, is in: any two rows have one in common."""
    mine = F.pmod(place, blocks)
    others = F.filter(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: j != mine)
    return F.transform(others, lambda j: F.struct(F.least(j, mine).alias("low"), F.greatest(j, mine).alias("high")))


def joined(hashes: list, sets: list, radius: int, like: float) -> list[int]:
    """For each text, by its fingerprint words and its sorted set of shingle hashes, the least place of its component: pairs that
    differ in at most `radius` bits are joined if their sets' Jaccard similarity is `like` or more."""
    import numpy as np

    fps, label, sizes = np.array(hashes, np.uint64).reshape(-1, 2), np.arange(len(sets)), np.array([len(x) for x in sets])
    for i in range(1, len(sets)):
        bits = np.bitwise_count(fps[:i] ^ fps[i]).sum(axis=1, dtype=np.int64)
        small, large = np.minimum(sizes[:i], sizes[i]), np.maximum(sizes[:i], sizes[i])
        near = np.nonzero((bits <= radius) & (small >= like * large))[0]
        for j in near[np.argsort(bits[near], kind="stable")].tolist():
            if label[i] == label[j]:
                continue
            both = len(sets[i]) + len(sets[j])
            common = np.intersect1d(sets[i], sets[j], assume_unique=True).size
            if common >= like * (both - common):
                low, high = sorted((label[i], label[j]))
                label[: i + 1][label[: i + 1] == high] = low
    return label.tolist()


def alike(docs: DataFrame, members: DataFrame, radius: int, like: float, shingle: int) -> DataFrame:
    """u, v: edges between texts, by h, as `joined` says among the members (h, doc_id of a row with that text, root, pairs of blocks)
    of a root's pair of blocks. Each such pair is held in one task, and gives a spanning forest."""

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        at, ids, hashes, sets = None, [], [], []

        def flush():
            label = joined(hashes, sets, radius, like)
            us, vs = [ids[i] for i, k in enumerate(label) if i != k], [ids[k] for i, k in enumerate(label) if i != k]
            return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

        for batch in slices(batches, "text"):
            for *key, h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != at and at is not None:
                    yield flush()
                    ids, hashes, sets = [], [], []
                at = key
                if ids and ids[-1] == h:  # a repeated row
                    continue
                own = shingle_hashes(text.encode(), shingle)[0]
                ids.append(h)
                hashes.append((vote(own), vote(mixed(own))) if len(own) else (0, 0))
                # no words: one shared element, as such texts are equal
                sets.append(np.unique(own) if len(own) else np.zeros(1, np.uint64))
        if ids:
            yield flush()

    wanted = members.select(F.col("h").alias("__ql_h"), F.col("doc_id").alias("__ql_id"), "root", "pairs")
    texts = docs.select("doc_id", F.xxhash64(docs["text"]).alias("h"), text_of(docs).alias("text"))
    rows = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["__ql_id"]) & (texts["h"] == wanted["__ql_h"])).select("root", F.explode("pairs").alias("p"), "h", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["root", "low", "high"]
    dealt = small_batches(rows).select("root", "p.low", "p.high", "h", "text").repartition(parts, *key).sortWithinPartitions(*key, "h")
    return dealt.mapInArrow(compare, "u long, v long")


def similar(docs: DataFrame, share: float = SHARE, shingle: int = SHINGLE, max_bucket: int = MAX_BUCKET, like: float = LIKE, group: int = GROUP) -> DataFrame:
    """Components as in components(), of texts whose sets of five-word shingles have a Jaccard similarity of `like` at least. fp is h.

    Texts whose 128-bit fingerprints of those shingles agree in `share` of their bits are candidates; inside each component of
    candidates, pairs of texts are compared by their shingles. Fingerprints are compared where sampled bits of their word-pair
    fingerprints agree, in as many tables as `tables` says; recall is that of those tables, at any size. A few tables come first, so
    that the others need not tell again that the members of a large group are alike. A bucket over max_bucket is dealt in blocks of
    half that size, and each block is compared with each other one, so that no pair of a bucket is left out.
    """
    own = saved(wide_fingerprint(docs, shingle).select("doc_id", "h", "key", "a", "b", "size", F.xxhash64("a", "b").alias("fp")))
    distinct = saved(own.select("key", "a", "b", F.xxhash64("a", "b").alias("fp")).distinct())
    masks, radius = tables(distinct.count()), math.floor((1 - share) * 2 * BITS)
    loose = None
    for part in (masks[:FIRST], masks[FIRST:]):
        marked = distinct.withColumn("part", F.col("fp")) if loose is None else distinct.join(loose, "fp", "left").withColumn("part", F.coalesce("root", "fp"))
        keyed = marked.select("a", "b", "part", F.posexplode(F.array(*(F.col("key").bitwiseAND(F.lit(m)) for m in part))).alias("c", "k"))
        crowded = saved(keyed.groupBy("c", "k").agg(F.count("*").alias("n")).where(F.col("n") > max_bucket))
        usual = keyed
        if not crowded.isEmpty():
            pair = F.explode(block_pairs(F.xxhash64("a", "b", "c"), F.ceil(2 * F.col("n") / max_bucket))).alias("p")
            split = keyed.join(crowded, ["c", "k"]).select("a", "b", "part", "c", "k", pair).select("a", "b", "part", "c", F.xxhash64("k", "p.low", "p.high").alias("k"))
            usual = keyed.join(crowded, ["c", "k"], "left_anti").select("a", "b", "part", "c", "k").union(split)
        found = bucket_edges(usual, ["a", "b"], radius, "part").select(F.xxhash64("u_a", "u_b").alias("u"), F.xxhash64("v_a", "v_b").alias("v"))
        if loose is not None:  # what is known is one edge a fingerprint
            found = found.union(loose.where("fp != root").select(F.col("fp").alias("u"), F.col("root").alias("v")))
        loose = saved(connected_components(found).select(F.col("node").alias("fp"), "root"))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("one")
    texts = own.groupBy("h", "fp").agg(one, F.first("size").alias("size")).join(loose, "fp", "left").select("h", "one.doc_id", "size", F.coalesce("root", "fp").alias("root"))
    texts = saved(texts)
    groups = texts.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("chars")).where("n > 1")
    blocks = F.greatest(F.ceil(2 * F.col("n") / group), F.ceil(2 * F.col("chars") / GROUP_CHARS))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high")))
    pairs = F.when((F.col("n") <= group) & (F.col("chars") <= GROUP_CHARS), whole).otherwise(block_pairs(F.xxhash64("h"), blocks))
    members = join_hot(texts, saved(groups), "root", "n", texts.count()).select("h", "doc_id", "root", pairs.alias("pairs"))
    found = alike(docs, members, radius, like, shingle)
    return _grouped(own.select("doc_id", "h", F.col("h").alias("fp")), found)


def keep_one(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The rows of docs, one of each component: that with the least doc_id (null last), at a tie any one text of that id.

    groups: components() or similar() of docs; the latter if None. Columns stay as they are, clashing names included.
    """
    groups = saved((similar(docs) if groups is None else groups).select("doc_id", "h", "root"))
    kept = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("k")).select(F.col("k.doc_id").alias("__ql_id"), F.col("k.h").alias("__ql_h"))
    one = docs.join(kept, docs["doc_id"].eqNullSafe(kept["__ql_id"]) & (F.xxhash64(docs["text"]) == kept["__ql_h"]), "left_semi")
    repeated = groups.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1")
    return one if repeated.isEmpty() else one.dropDuplicates(["doc_id", "text"])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
