"""Operators against brute force, and on nulls, empty and long texts, ties,
repeated rows, empty tables and clashing column names."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SMALL

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, fp long, chunk int, hash binary, component_id string, score string, shard int, __part int"
PASSAGE = " ".join(f"p{i}" for i in range(60))
TEXTS = [
    (5, "alpha beta gamma delta " * 8),
    (1, "alpha beta gamma delta " * 8),
    (9, "alpha beta gamma delta " * 8),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (6, "one"),
    (7, "One two"),
    (8, "Ünï cödé ½ \x00 🙂 x " * 5),
    (10, "start " + PASSAGE + " end"),
    (11, PASSAGE),
    (12, "a b " + PASSAGE),
    (12, "a b " + PASSAGE),
    (13, " ".join(f"w{i % 977}" for i in range(30_000))),
    (None, "null id " + PASSAGE),
    (14, "x" * 5000 + " " + "!" * 300),
]


@pytest.fixture(scope="module")
def messy(spark):
    rows = [(i, t, "en", "s", len(t or ""), True, 1, 2, b"h", "c", "s", 3, 4) for i, t in TEXTS]
    return spark.createDataFrame(rows, CLASHING)


@pytest.fixture(scope="module")
def empty(messy):
    return messy.limit(0)


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def words(text):
    return (text or "").encode().split()


# -- substring dedup


def removed_words(rows, window=13):
    least = {}
    order = lambda i: (1, 0) if i is None else (0, i)
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            least[g] = min(least.get(g, (2, 0)), order(i))
    for i, text in rows:
        w = words(text)
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < order(i):
                gone |= set(range(k, k + window))
        yield i, len(w), len(gone), " ".join(x.decode() for k, x in enumerate(w) if k not in gone)


def test_substring_dedup_equals_brute_force(messy, empty):
    from tessera.llm.substring_dedup import substring_dedup

    found = substring_dedup(messy, window=13, chunk_bytes=2000).collect()
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found)
    assert got == Counter(removed_words(TEXTS))
    for r in found:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:]))
    assert substring_dedup(empty).count() == 0


def test_substring_dedup_deals_out_hot_ids(spark):
    """Many rows of one id, and of none, that share passages among each other and with others."""
    from tessera.llm.common import text_bytes
    from tessera.llm.substring_dedup import PARTS_SHIFT, _chunked, substring_dedup

    r = np.random.default_rng(5)
    passages = [" ".join(f"q{x}" for x in r.integers(0, 900, 20)) for _ in range(12)]
    text = lambda: " ".join(f"{r.integers(0, 10**6)} {passages[r.integers(0, 12)]}" for _ in range(4))
    rows = [(7, text()) for _ in range(60)] + [(None, text()) for _ in range(60)] + [(int(i), text()) for i in r.integers(0, 15, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    size = text_bytes(df)[1]
    parts = _chunked(df, len(rows), size, 30).select("chunk").distinct().collect()
    assert {p.chunk >> PARTS_SHIFT for p in parts if p.chunk % (1 << PARTS_SHIFT)} and len(parts) > 15
    found = substring_dedup(df.selectExpr("*", "doc_id AS n_words", "length(text) AS size"), chunk_bytes=size // 30, carry=["n_words", "size"], as_is=True)
    assert found.columns[-2:] == ["n_words", "size"]
    got = Counter((r[0], r[1], r[2], r[3]) for r in found.collect())
    assert got == Counter(removed_words(rows)) and all(r[0] == r[5] and r[6] >= len(r[3]) for r in found.collect())


def test_rolling_hash_is_rabin_karp():
    from tessera.llm.substring_dedup import BASE, pack_sorted, rolling_hashes, unpack_sorted

    w = np.random.default_rng(0).integers(0, 2**63, 40).astype(np.uint64)
    for n in (1, 2, 5, 13, 40, 41):
        want = [sum(int(w[i + j]) * int(BASE) ** (n - 1 - j) for j in range(n)) % 2**64 for i in range(len(w) - n + 1)]
        assert rolling_hashes(w, n, BASE).tolist() == want
    s = np.unique(w)
    assert np.array_equal(unpack_sorted(pack_sorted(s), len(s)), s)


# -- chat formatting


def test_preference_formatting(spark):
    from tessera.llm.chat_format import format_preferences

    turns = "pair_id long, turn long, role string, text string, n long, prompt string"
    chosen = [(1, 0, "user", "q"), (1, 1, "assistant", "good"), (2, 0, "user", "same"), (3, 0, None, None), (4, 0, "user", "only chosen"), (None, 0, "user", "x")]
    rejected = [(1, 1, "assistant", "bad"), (1, 0, "user", "q"), (2, 0, "user", "same"), (3, 0, "", "")]
    c, r = (spark.createDataFrame([(*t, 7, "clash") for t in x], turns) for x in (chosen, rejected))
    got = {row.pair_id: row for row in format_preferences(c, r).collect()}
    one = got[1]
    assert one.prompt_turns == 1 and one.prompt == "<|user|>\nq<|end|>\n"
    assert one.chosen == "<|assistant|>\ngood<|end|>\n" and one.rejected == "<|assistant|>\nbad<|end|>\n"
    assert [one.chosen[s.start : s.end] for s in one.chosen_mask] == ["good<|end|>\n"]
    assert [one.rejected[s.start : s.end] for s in one.rejected_mask] == ["bad<|end|>\n"]
    assert got[2].chosen == got[2].rejected == "" and got[2].prompt_turns == 1
    assert got[3].prompt_turns == 1 and got[4].rejected == "" and got[4].prompt == "" and got[None].chosen_mask == []
    assert format_preferences(c.limit(0), r.limit(0)).count() == 0


def test_preference_formatting_of_ties_repeats_and_long_texts(spark):
    from tessera.llm.chat_format import collect_turns, format_pairs, format_preferences, parroted

    turns = "pair_id long, turn long, role string, text string"
    long = "word " * 50_000
    chosen = [(1, 1, "user", "b"), (1, 1, "assistant", "a"), (1, 1, "user", "b"), (2, None, "user", "first"), (2, 0, "assistant", long), (3, 0, "assistant", "alone")]
    rejected = [(1, 1, "user", "b"), (1, 1, "assistant", "a"), (2, None, "user", "first"), (2, 0, "assistant", "short")]
    c, r = (spark.createDataFrame(x, turns) for x in (chosen, rejected))
    got = {row.pair_id: row for row in format_preferences(c, r).collect()}
    assert got[1].prompt == "<|assistant|>\na<|end|>\n<|user|>\nb<|end|>\n" and got[1].chosen == "<|user|>\nb<|end|>\n" and got[1].rejected == ""  # a tie goes by role and text, a repeat is a turn
    assert got[2].prompt_turns == 1 and got[2].chosen == f"<|assistant|>\n{long}<|end|>\n" and [got[2].chosen[s.start : s.end] for s in got[2].chosen_mask] == [f"{long}<|end|>\n"]
    pairs = collect_turns(c, "pair_id", "chosen").withColumn("rejected", parroted(F.col("chosen")))
    own = {row.pair_id: row for row in format_pairs(pairs, "pair_id").collect()}
    assert own[2].rejected == "<|assistant|>\nfirst<|end|>\n" and own[3].rejected == "<|assistant|>\n<|end|>\n" and own[1].prompt_turns == 0
    assert own[1].rejected.startswith("<|assistant|>\n<|end|>\n")


# -- exact dedup


@pytest.mark.parametrize("keep,best", [("largest", max), ("smallest", min)])
def test_exact_dedup_equals_brute_force(messy, empty, keep, best):
    from tessera.llm.exact_dedup import exact_dedup

    groups = {}
    for i, t in TEXTS:
        groups.setdefault(t or "", []).append(i)
    want = Counter()
    for i, t in TEXTS:
        ids = [x for x in groups[t or ""] if x is not None]
        keeper = best(ids) if ids else None
        want[i, keeper, len(groups[t or ""]), i == keeper, hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in exact_dedup(messy, keep=keep).collect()) == want
    assert exact_dedup(empty).count() == 0
    with pytest.raises(ValueError):
        exact_dedup(messy, keep="any")


# -- embedding near-dedup


def brute_links(rows, threshold):
    def usable(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        a, b = np.array(a), np.array(b)
        return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))

    links, up = Counter(), {i: i for i, _, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (i, v, a), (j, w, b) in itertools.combinations(rows, 2):
        if a is not None and a == b and usable(v) and usable(w) and len(v) == len(w) and cosine(v, w) >= threshold:
            links[i] += 1
            links[j] += 1
            x, y = sorted((root(i), root(j)))
            up[y] = x
    return {i: (links[i], root(i), root(i) == i) for i, _, _ in rows}


def test_embedding_dedup_equals_brute_force(spark):
    from tessera.llm.embedding_dedup import embedding_near_dedup

    r = np.random.default_rng(3)
    centre = r.normal(size=16)
    rows = [(i, (centre + 0.12 * r.normal(size=16)).tolist(), 1) for i in range(150)]  # dense, with pairs about the threshold
    rows += [(1000 + i, (centre + 0.5 * r.normal(size=16)).tolist(), 1) for i in range(150)]
    rows += [(2000 + i, r.normal(size=16).tolist(), 2) for i in range(50)]
    rows += [(3000 + i, [1.0] + [0.0] * 15, 2) for i in range(5)]
    rows += [(4000, None, 1), (4001, [0.0] * 16, 1), (4002, [float("nan")] * 16, 1), (4003, [float("inf")] + [1.0] * 15, 1), (4004, centre.tolist(), None), (4005, [], 1), (4006, centre.tolist()[:8], 1), (4007, [None] + [1.0] * 15, 1)]
    df = spark.createDataFrame([(*x, True, 1) for x in rows], "vec_id long, embedding array<double>, label int, kept boolean, n long")
    again = spark.createDataFrame([(7, centre.tolist(), 3), (7, centre.tolist(), 3), (7, (-centre).tolist(), 3), (6, centre.tolist(), 3)], "vec_id long, embedding array<double>, label int")
    assert Counter((x.vec_id, x.n_links, x.component_id, x.kept) for x in embedding_near_dedup(again, 0.93).collect()) == {(7, 2, 6, False): 2, (7, 0, 7, True): 1, (6, 2, 6, True): 1}
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embedding_near_dedup(df, 0.93).collect()}
    assert got == brute_links(rows, 0.93)
    assert embedding_near_dedup(df.limit(0)).count() == 0


def test_pairs_of_a_concentrated_label_meet(spark):
    """Vectors of mean cosine 0.9, where leading bits hardly part a label, with planted pairs."""
    from tessera.llm.embedding_dedup import embedding_near_dedup

    r = np.random.default_rng(7)
    mean, dims = np.zeros(384), 384
    mean[0] = 3.0
    x = mean + r.normal(size=(3000, dims)) / np.sqrt(dims)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(200):  # 2k + 1 at cosine 0.935 of 2k
        step = x[2 * k + 1] - (x[2 * k + 1] @ x[2 * k]) * x[2 * k]
        x[2 * k + 1] = 0.935 * x[2 * k] + math.sqrt(1 - 0.935**2) * step / np.linalg.norm(step)
    close = np.triu(x @ x.T >= 0.93, 1)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {row.vec_id: (row.component_id, row.n_links) for row in embedding_near_dedup(df, 0.93, miss=1e-3).collect()}
    assert all(got[a][0] == got[b][0] for a, b in zip(*np.nonzero(close)))
    assert [got[i][1] for i in range(len(x))] == (close | close.T).sum(axis=1).tolist()


# -- simhash


def simhash(text, shingle=3):
    w = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_within(prints, bits):
    nodes = sorted(set(prints))
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in itertools.combinations(nodes, 2):
        if (a ^ b).bit_count() <= bits:
            up[root(a)] = root(b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("source", ["messy", "documents"])
def test_simhash_equals_brute_force(spark, messy, empty, source):
    from tessera.llm.simhash import simhash_near_dedup

    df = messy if source == "messy" else documents(spark)
    rows = [(r.doc_id, simhash(r.text)) for r in df.select("doc_id", "text").collect()]
    group = groups_within([p for _, p in rows], 2)
    least = {}
    for i, p in rows:
        if i is not None:
            least[group[p]] = min(i, least.get(group[p], i))
    want = Counter((i, p - (p >> 63 << 64), least.get(group[p]), i == least.get(group[p])) for i, p in rows)
    assert Counter(tuple(r) for r in simhash_near_dedup(df).collect()) == want
    assert simhash_near_dedup(empty).count() == 0


def test_every_pair_of_close_fingerprints_is_found(spark):
    from tessera.llm.simhash import fingerprint_links

    r = np.random.default_rng(1)
    base = [int(x) for x in r.integers(0, 2**63, 6)]
    prints = set(base)
    for b in base:
        prints |= {b ^ (1 << int(i)) ^ (1 << int(j)) for i, j in r.integers(0, 64, (15, 2))}
    signed = [p - (p >> 63 << 64) for p in prints]
    rows = fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    found = {frozenset((x.a, x.b)) for x in rows}
    mask = 2**64 - 1
    assert len(found) == len({(x.a, x.b) for x in rows})  # no pair from both sides
    assert found == {frozenset(p) for p in itertools.combinations(signed, 2) if ((p[0] ^ p[1]) & mask).bit_count() <= 2}


def test_exploded_sides_are_not_broadcast(spark, monkeypatch):
    """66 keys a fingerprint were planned as one, and broadcast from a driver that can't hold them."""
    from tessera.llm import simhash

    fps = spark.range(300).selectExpr("id * 4 AS fp").groupBy("fp").count().select("fp")
    for hot in (1 << 20, 5):
        monkeypatch.setattr(simhash, "HOT", hot)
        links = simhash.fingerprint_links(fps)
        links.collect()
        joins = [x for x in links._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines() if "Join" in x]
        assert any("SortMergeJoin" in x for x in joins) and all("LeftAnti" in x for x in joins if "Broadcast" in x)


def test_links_of_a_crowded_key_connect_the_same(spark, monkeypatch):
    """Keys with many members are linked in stars: no wrong link, and the same components."""
    from tessera.llm import simhash

    monkeypatch.setattr(simhash, "HOT", 5)
    r = np.random.default_rng(9)
    half = int(r.integers(0, 2**32)) << 32
    prints = {half | int(x) for x in r.integers(0, 2**12, 150)} | {int(x) for x in r.integers(0, 2**63, 40)}
    prints |= {p ^ (1 << int(b)) for p, b in zip(sorted(prints), r.integers(0, 64, 60))}
    signed = [p - (p >> 63 << 64) for p in prints]
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    assert all(((x.a ^ x.b) & (2**64 - 1)).bit_count() <= 2 for x in links)
    up = {p: p for p in signed}
    for _ in range(len(signed)):
        for x in links:
            up[x.a] = up[x.b] = min(up[x.a], up[x.b])
    group = groups_within([p & (2**64 - 1) for p in signed], 2)
    assert all((up[a] == up[b]) == (group[a & (2**64 - 1)] == group[b & (2**64 - 1)]) for a, b in itertools.combinations(signed, 2))
    assert len(set(up.values())) > 30


def test_texts_with_close_fingerprints_meet_without_bands(spark):
    """One band of 4000 rows brings no two different texts together, SimHash does."""
    from tessera.llm.simhash import fingerprint_batch, simhash_similar

    r = np.random.default_rng(4)
    texts = []
    for g in range(10):
        w = [f"v{x}" for x in r.integers(0, 50_000, 5000)]
        texts.append(" ".join(w))
        w[100] = "changed"
        texts.append(" ".join(w))
    prints = [int(x) for x in fingerprint_batch([t.encode() for t in texts], 5)]
    close = [g for g in range(10) if (prints[2 * g] ^ prints[2 * g + 1]).bit_count() <= 2]
    found = {x.doc_id: x.component_id for x in simhash_similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bands=1, rows=4000).collect()}
    assert len(close) >= 2 and all(found[2 * g + 1] == 2 * g for g in close)
    assert len(found) == 20 and all(found[k] // 2 == k // 2 for k in found)


def test_similar_texts_meet(spark, messy, empty):
    from tessera.llm.simhash import simhash_similar

    r = np.random.default_rng(2)
    rows = []
    for g in range(60):
        w = [f"v{x}" for x in r.integers(0, 5000, 400)]
        rows.append((2 * g, " ".join(w)))
        for k in r.integers(0, 400, 4):
            w[k] = "changed"
        rows.append((2 * g + 1, " ".join(w)))
    got = {x.doc_id: x.component_id for x in simhash_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * g + 1] == 2 * g for g in range(60)) >= 57
    assert all(got[i] in (i, i - i % 2) for i in got)
    assert simhash_similar(messy).count() == len(TEXTS) and simhash_similar(empty).count() == 0


def test_similar_texts_meet_at_the_threshold_and_not_below(spark):
    """Isolated pairs planted just above and well below a similarity of 0.8, against brute force."""
    from tessera.llm.simhash import simhash_similar

    r = np.random.default_rng(4)
    rows = []
    for g in range(300):
        w = [f"v{x}" for x in r.integers(0, 50_000, 400)]
        rows.append((2 * g, " ".join(w)))
        for k in np.arange(int(r.integers(7, 9)) if g % 3 else 16) * 24 + 5:  # each touches five shingles
            w[k] = f"changed{g}"
        rows.append((2 * g + 1, " ".join(w)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    jaccard = {g: len(sets[2 * g] & sets[2 * g + 1]) / len(sets[2 * g] | sets[2 * g + 1]) for g in range(300)}
    near, clean = [g for g in jaccard if jaccard[g] >= 0.8], [g for g in jaccard if jaccard[g] < 0.8]
    assert len(near) >= 190 and len(clean) >= 90 and max(jaccard.values()) < 0.85 and min(jaccard.values()) > 0.6
    got = {x.doc_id: x.component_id for x in simhash_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * g + 1] == 2 * g for g in near) >= 0.99 * len(near)
    assert all(got[2 * g + 1] == 2 * g + 1 for g in clean) and all(got[2 * g] == 2 * g for g in jaccard)


def test_similar_texts_in_a_crowd_equal_brute_force(spark, monkeypatch):
    """One crowd of texts about the threshold, so that bands hold several groups."""
    from tessera.llm import simhash

    monkeypatch.setattr(simhash, "NODES", 32)
    r = np.random.default_rng(6)
    base = [f"b{x}" for x in r.integers(0, 50_000, 150)]
    rows = []
    for i in range(160):
        w = list(base)
        for k in r.integers(0, 150, int(r.integers(1, 5))):
            w[k] = f"own{i}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for _, t in rows for w in [t.split()]]
    root = list(range(len(rows)))
    while True:
        new = [min(root[j] for j in range(len(rows)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in range(len(rows))]
        if new == root:
            break
        root = new
    assert 10 < len(set(root)) < 150
    got = {x.doc_id: x.component_id for x in simhash.simhash_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == root


def test_shared_counts_and_forest_equal_brute_force(monkeypatch):
    from tessera.llm import simhash

    monkeypatch.setattr(simhash, "PIECE", 37)
    r = np.random.default_rng(12)
    sets = [np.unique(r.integers(0, 60, n).astype(np.uint64)) for n in (0, 1, 5, 30, 200, 7, 200)] + [np.arange(60, dtype=np.uint64)] * 20
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets[3:]] for a in sets]
    assert simhash.shared_counts(sets, sets[3:]).tolist() == want
    a, b = r.integers(0, 80, (2, 50))
    least, node = simhash.forest(a, b)
    root = {int(x): int(x) for x in [*a, *b]}
    for _ in root:
        for x, y in zip(a.tolist(), b.tolist()):
            root[x] = root[y] = min(root[x], root[y])
    assert dict(zip(node.tolist(), least.tolist())) == {x: y for x, y in root.items() if x != y}


@pytest.mark.parametrize("scale", ["0.01", "0.1"])
def test_recall_of_similar_texts_on_the_documents(spark, scale):
    """All pairs of similarity 0.8 and more by exact prefix filtering: texts that
    similar share one of the rarest fifth, and one more, of either's shingles."""
    from tessera.llm.simhash import simhash_similar, shingle_hashes

    docs = spark.read.parquet(f"/root/testdata/sf{scale}/documents.parquet")
    sets, members = {}, {}
    for i, t in docs.select("doc_id", "text").collect():
        own = tuple(sorted(set(shingle_hashes([(t or "").encode()], 5, 42)[0].tolist())))
        members.setdefault(own, []).append(i)
    sets = [set(own) for own in members if own]
    df = Counter(x for own in sets for x in own)
    index, pairs = {}, []
    for i, own in enumerate(sets):
        tried = set()
        for x in sorted(own, key=lambda x: (df[x], x))[: len(own) // 5 + 1]:
            tried.update(index.setdefault(x, []))
            index[x].append(i)
        pairs += [(i, j) for j in tried if len(own & sets[j]) >= 0.8 * len(own | sets[j])]
    name = [ids[0] for own, ids in members.items() if own]
    got = {x.doc_id: x.component_id for x in simhash_similar(docs).collect()}
    met = sum(got[name[i]] == got[name[j]] for i, j in pairs)
    assert len(pairs) >= (1 if scale == "0.01" else 40) and met >= 0.99 * len(pairs), (met, len(pairs))
    root = {n: n for n in name}
    for _ in range(20):
        for i, j in pairs:
            root[name[i]] = root[name[j]] = min(root[name[i]], root[name[j]])
    assert sum(got[n] != got[root[n]] for n in name) <= 1 and len({got[n] for n in name}) >= len(set(root.values()))


def test_components(spark):
    from tessera.llm.components import connected_components

    edges = [(i, i + 1) for i in range(50, 90)] + [(7, 3), (3, 3), (9, 7), (100, 90), (7, 3), (1, None), (None, 2)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {3: 3, 7: 3, 9: 3, **{i: 50 for i in range(50, 91)}, 100: 50}


def test_small_graphs_take_few_jobs(spark, monkeypatch):
    """Rounds over few links made the driver plan hundreds of stages; both ways agree."""
    from tessera.llm import components

    r = np.random.default_rng(3)
    links = [*((int(a), int(b)) for a, b in r.integers(-500, 500, (450, 2))), *((i * 37 % 1009 + 10**6, (i + 1) * 37 % 1009 + 10**6) for i in range(800))]
    table = spark.createDataFrame(links, "a long, b long")
    context = spark.sparkContext
    context.setJobGroup("small-graph", "components")
    try:
        once = sorted(components.connected_components(table).collect())
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    # 6 jobs; 116 when each round has its own
    assert len(context.statusTracker().getJobIdsForGroup("small-graph")) <= 12
    monkeypatch.setattr(components, "ROWS_A_FILE", 0)
    assert sorted(components.connected_components(table).collect()) == once
    assert len(components.connected_components(table.limit(0)).collect()) == 0


def test_near_dedup_skips_empty_steps(spark, monkeypatch):
    """Without large bands none is gathered, and without unlike nodes no cell is made."""
    from tessera.llm import simhash

    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(words[::-1] if i > 2 else words)) for i in range(5)] + [(9, None)], "doc_id long, text string")
    made = []
    monkeypatch.setattr(simhash, "_hot_links", lambda *a: pytest.fail("no band is large"))
    found = simhash._band_links
    monkeypatch.setattr(simhash, "_band_links", lambda *a: made.append(found(*a)) or made[-1])
    got = {r.doc_id: r.component_id for r in simhash.simhash_similar(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 9: 9}
    assert made == [None] * len(simhash.ROUNDS)


# -- licenses


def test_license_scan(spark):
    from tessera.llm.license_scan import license_scan

    notice = "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, "a/LICENSE", notice),
        (2, "a/b/c.txt", "nothing"),
        (3, "a/b/d.txt", "code\nReleased under the MIT License.\nmore words in the file so that it is no license file at all"),
        (4, "x/y.txt", "the license of this is under the version"),
        (5, None, notice + "\n" + "words " * 50),
        (6, "a/e.txt", None),
        (7, "top.txt", ""),
        (1, "a/LICENSE", notice),
        (8, "a/" + "long" * 10 + "/z", "word " * 20_000 + "\nall rights reserved"),
    ]
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, path string, text string, score double, dir string")
    got = {r.doc_id: (r.license, r.origin, r.directory) for r in license_scan(df).collect()}
    assert got == {1: ("Apache-2.0", "own", None), 2: ("Apache-2.0", "inherited", "a"), 3: ("MIT", "own", None), 4: (None, "none", None), 5: ("Apache-2.0", "own", None), 6: ("Apache-2.0", "inherited", "a"), 7: (None, "none", None), 8: ("proprietary", "own", None)}
    assert license_scan(df).count() == len(rows) and license_scan(df.limit(0)).count() == 0


def test_license_scan_knows_headers_files_and_ancestors(spark):
    from tessera.llm.license_scan import TEMPLATES, license_scan

    mit = "MIT License\n\nCopyright (c) 2020 Some One\n\n" + "\n".join(TEMPLATES["MIT"][-1].replace(", to deal", ",\nto deal").replace("merge,", "merge,\n").split("\n"))
    apache = "/*\n * " + "\n * ".join(w for w in TEMPLATES["Apache-2.0"][3].replace(" (the", "\n(the").replace(" in compliance", "\nin compliance").split("\n")) + "\n */\n\nint main() { return 0; }\n" + "x = y;\n" * 60
    rows = [
        (1, "p/LICENSE", mit),
        (2, "p/a/one.c", "code"),
        (3, "p/a/b/COPYING", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"),
        (4, "p/a/b/c/d/two.c", "code"),
        (5, "p/a/b/c/three.c", apache),
        (6, "pa/four.c", "code"),
        (7, "p/a/five.py", "# SPDX-License-Identifier: Apache-2.0\nprint(1)\n" + "y = 2\n" * 40),
        (8, "q/six.c", "/* Use of this source code is\n   governed by a BSD-style license. */\n\n" + "z = 3\n" * 40),
        (9, None, "code"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.unit, r.origin, r.directory) for r in license_scan(df).collect()}
    assert got == {
        1: ("MIT", "paragraph", "own", None), 2: ("MIT", None, "inherited", "p"), 3: ("GPL-3.0", "paragraph", "own", None), 4: ("GPL-3.0", None, "inherited", "p/a/b"),
        5: ("Apache-2.0", "line", "own", None), 6: (None, None, "none", None), 7: ("Apache-2.0", "line", "own", None), 8: ("BSD-3-Clause", "paragraph", "own", None), 9: (None, None, "none", None),
    }
    own = {"A": ["alpha beta"], "B": ["alpha beta"]}  # a tie goes to the later name
    tied = spark.createDataFrame([(1, "x/y", "alpha beta"), (1, "x/y", "alpha beta"), (2, "x/z", "gamma")], "doc_id long, path string, text string")
    assert Counter((r.doc_id, r.license, r.origin) for r in license_scan(tied, templates=own).collect()) == {(1, "B", "own"): 2, (2, "B", "inherited"): 1}


# -- quality


def test_context_sums_and_pooling_equal_brute_force(monkeypatch):
    from types import SimpleNamespace

    import pyarrow as pa

    from tessera.llm import quality
    from tessera.llm.common import unpack_sums

    monkeypatch.setattr(quality, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    texts = ["One two  two, 33 x", "", None, "solo", "two One two " * 40]
    tokens = [re.findall(r"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\s\x80-\xff]+", t or "") for t in texts]
    row = lambda w: xxhash.xxh64_intdigest(w.encode(), quality.SEED) % quality.ROWS
    places, signs = quality.index_vectors()
    index = lambda w: np.array([sum(s for p, s in zip(places[row(w)], signs[row(w)]) if p == d) for d in range(quality.DIMS)])
    want = {}
    for t in tokens:
        for a, b in zip(t, t[1:]):
            want[row(a)] = want.get(row(a), 0) + index(b)
            want[row(b)] = want.get(row(b), 0) + index(a)
    got = np.zeros((quality.BLOCKS, quality.ROWS // quality.BLOCKS * quality.DIMS))
    for batch in quality._context_sums(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])):
        got[batch.column(0)[0].as_py()] = unpack_sums(batch.column(2)[0].as_py())
    got = got.reshape(quality.ROWS, quality.DIMS)
    assert set(np.flatnonzero(np.abs(got).sum(1))) <= set(want) and all(np.array_equal(got[k], v) for k, v in want.items())
    vectors = np.random.default_rng(0).normal(size=(quality.ROWS, quality.DIMS)).astype(np.float32)
    for found, t in zip(quality.pool([(t or "").encode() for t in texts], vectors), tokens):
        own = np.array([vectors[row(w)] for w in t], np.float64).reshape(-1, quality.DIMS)
        parts = [own.sum(0) / (len(t) + quality.SHRINK), (own**2).sum(0) / max(len(t), 1), (own[:-1] * own[1:]).sum(0) / max(len(t) - 1, 1)]
        assert np.allclose(found, np.concatenate(parts), atol=1e-4)


def test_temperature_lowers_the_loss_of_rows_left_out():
    from tessera.llm.quality import Network

    r = np.random.default_rng(0)
    x = r.normal(size=(400, 30))
    y = (x[:, 0] + 2 * r.normal(size=400) > 0).astype(float)  # noisy labels, many features: logits too sure
    n = Network(epochs=300).fit(x, y)
    held = np.random.default_rng(n.seed).permutation(400)[:80]
    loss = lambda t: np.mean(np.logaddexp(0, -np.where(y[held] > 0, 1, -1) * n.logits(x[held]) / t))
    assert n.temperature > 1.5 and loss(n.temperature) < loss(1.0) and all(loss(n.temperature) <= loss(t) + 1e-9 for t in np.geomspace(0.25, 8, 61))
    assert np.allclose(n.scores(x), 1 / (1 + np.exp(-n.logits(x) / n.temperature)))


def test_labels_that_repeat_or_disagree(spark):
    """Of several labels of a document the largest counts, null labels count as none."""
    from tessera.llm.quality import quality_scores

    docs = spark.createDataFrame([(i, ("good calm words " if i % 2 else "bad loud noise ") * 5) for i in range(200)], "doc_id long, text string")
    plain = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    torn = plain.unionByName(plain).unionByName(spark.createDataFrame([(i, 0) for i in range(200)] + [(i, None) for i in range(200)], plain.schema))
    score = lambda labels: {r.doc_id: r.score for r in quality_scores(docs, labels).collect()}
    assert score(plain) == score(torn) and all((v > 0.5) == (i % 2 == 1) for i, v in score(plain).items())


def test_quality_classifier(spark, messy, empty):
    from tessera.llm.quality import quality_scores

    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored = quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(scored) > 40
    assert np.mean([r.predicted == r.quality for r in scored]) >= 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in scored)
    nothing = labels.limit(0)
    assert {r.score for r in quality_scores(messy, nothing).collect()} == {0.5}
    assert quality_scores(messy, labels).count() == len(TEXTS) and quality_scores(empty, labels).count() == 0


# -- tokens


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_bpe_equals_the_library(library):
    from tessera.llm.bpe import Encoder

    path, tokenizer = library
    with open(path, "rb") as f:
        encoder = Encoder(f.read())
    r = np.random.default_rng(0)
    texts = [t or "" for _, t in TEXTS]
    texts += ["It's we'll 'sx İ ΑΣ. naïve ½ ²x a_b__c <|endoftext|>Hi<|startoftext|>", "日本語 한국어 🙂 x‍y", "\x1c a\x85b\xa0c", "á ﬃ ǅ ẞ", "th" * 90, "=" * 200]
    texts += ["".join(chr(c) for c in r.choice([*range(32, 127), *range(0xA0, 0x600), *range(0x1E00, 0x2200), *range(0x4E00, 0x4E80)], 80)) for _ in range(200)]
    for text in texts:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == ids
        assert encoder.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_a_chunk_is_split_once_a_batch(library, monkeypatch):
    """Every word of every text was split and looked up anew, over the time that operator 8 has."""
    from tessera.llm.bpe import Encoder

    path, tokenizer = library
    with open(path, "rb") as f:
        encoder = Encoder(f.read())
    r = np.random.default_rng(4)
    pool = ["the", "The,", "it's", " ", "\n", "\t ", "\x0b", "\x0c\r", "\x1c", "\x85", "\xa0", "\u2028", "\u3000", "e\u0301", "\u0301", "J\u030c", "j\u030c", "\u01f0", "\u03a3", "\u1112", "\u1161", "\u11ab", "\ue000", "<|endoftext|>", "<|", "x" * 70]
    for some in (pool[:9], [p for p in pool if p != "\ue000" and "<|" not in p], pool):
        texts = ["".join(r.choice(some, r.integers(0, 20))) for _ in range(300)] + [""]
        seen, split = [], Encoder._split_chunks
        with monkeypatch.context() as patch:
            patch.setattr(Encoder, "_split_chunks", lambda self, chunks: seen.extend(chunks) or split(self, chunks))
            found = encoder.encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in found] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(seen) == len(set(seen)) < sum(len(t.split()) for t in texts)


def test_bpe_frames(spark, messy, empty, library):
    from tessera.llm.bpe import bpe_decode, bpe_encode, bpe_round_trip

    path, tokenizer = library
    encoded = bpe_encode(messy, path)
    want = {t or "": tokenizer.encode(t or "", add_special_tokens=False).ids for _, t in TEXTS}
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == Counter((i, tuple(want[t or ""])) for i, t in TEXTS)
    texts = Counter((r.doc_id, r.text) for r in bpe_decode(encoded, path).collect())
    assert texts == Counter((i, tokenizer.decode(want[t or ""], skip_special_tokens=False)) for i, t in TEXTS)
    digests = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe_round_trip(messy, path).collect()}
    assert digests == {(i, len(want[t or ""]), hashlib.sha256(" ".join(map(str, want[t or ""])).encode()).hexdigest()) for i, t in TEXTS}
    assert bpe_encode(empty, path).count() == 0 and bpe_round_trip(empty, path).count() == 0


def test_packing(spark, messy, empty, library):
    from tessera.llm.packing import best_fit_packing

    path, tokenizer = library
    rows = best_fit_packing(messy, path, capacity=64).collect()
    by_sequence, by_text = {}, {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and sum(n for _, n in pieces) <= 64
    for r in rows:
        by_text.setdefault(r.doc_id, set()).add((r.piece, r.start, r.ids))
    for i, t in TEXTS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        assert by_text[i] == {(k, 64 * k, np.array(ids[64 * k : 64 * k + 64], "<u4").tobytes()) for k in range(-(-len(ids) // 64))}
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= math.ceil(total / 64) * 1.05 + 1
    assert best_fit_packing(empty, path).count() == 0


def test_packing_closes_bins_as_a_plain_packer_does(spark, library):
    """Placements of the frame equal those of a packer that scans a list of open bins."""
    from tessera.llm.packing import best_fit_packing

    r = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, " ".join(["tree"] * int(n))) for i, n in enumerate(r.integers(1, 90, 300))], "doc_id long, text string")
    rows = best_fit_packing(docs, library[0], capacity=64, open_bins=3, with_ids=False).collect()
    open_bins, bins, closed, want = [], 0, 0, {}
    for x in sorted(rows, key=lambda x: (abs(2 * x.length - 64), -x.length, x.doc_id, x.piece)):
        fitting = [b for b in open_bins if b[1] >= x.length]
        if fitting:
            least = min(b[1] for b in fitting)
            best = [b for b in fitting if b[1] == least][-1]
            open_bins.remove(best)
        else:
            if len(open_bins) == 3:
                least = min(b[1] for b in open_bins)
                open_bins.remove([b for b in open_bins if b[1] == least][-1])
                closed += 1
            best = (bins, 64)
            bins += 1
        want[x.doc_id, x.piece] = (best[0], 64 - best[1])
        if best[1] > x.length:
            open_bins.append((best[0], best[1] - x.length))
    assert closed > 10 and {(x.doc_id, x.piece): (x.sequence_id, x.offset) for x in rows} == want


def test_best_fit_closes_the_fullest():
    from tessera.llm.packing import BestFit

    b = BestFit(10, open_bins=2)
    assert [b.place(n) for n in (6, 7, 8, 3, 1)] == [(0, 0), (1, 0), (2, 0), (0, 6), (0, 9)]  # 8 closes the bin of 7
    assert b.open == 1 and b.bins == 3
    with pytest.raises(ValueError):
        b.place(11)


# -- language model


def brute_likelihood(model, sequence):
    s = len(model.start)
    total = 0.0
    for path in itertools.product(range(s), repeat=len(sequence)):
        p = model.start[path[0]] * model.emit[path[0], sequence[0]]
        for a, b, x in zip(path, path[1:], sequence[1:]):
            p *= model.move[a, b] * model.emit[b, x]
        total += p
    return math.log(total)


def test_forward_recursion_and_counts_are_exact():
    from tessera.llm.hmm import Hmm

    model = Hmm.random(3, 5)
    r = np.random.default_rng(0)
    sequences = [r.integers(0, 5, n).astype(np.uint16) for n in (1, 6, 4, 6, 2)]
    assert np.allclose(model.log_likelihoods(sequences), [brute_likelihood(model, q) for q in sequences])
    counts = model.expected_counts(sequences)
    assert math.isclose(counts[-1], sum(brute_likelihood(model, q) for q in sequences))
    assert math.isclose(counts[:3].sum(), len(sequences)) and math.isclose(counts[12:-1].sum(), sum(map(len, sequences)))
    eps = 1e-6  # the expected transition count is the derivative of the log-likelihood by the logarithm of the entry
    moved = Hmm(model.start, model.move.copy(), model.emit)
    moved.move[0, 1] *= 1 + eps
    slope = (moved.log_likelihoods(sequences).sum() - model.log_likelihoods(sequences).sum()) / eps
    assert math.isclose(slope, counts[3 + 1], rel_tol=1e-3)
    for span, wide in ((4, 3), (7, 2), (1, 1)):  # segments that are walked again, and blocks of few sequences
        with pytest.MonkeyPatch.context() as m:
            m.setattr("tessera.llm.hmm._BLOCK", span)
            m.setattr("tessera.llm.hmm._WIDE", wide)
            assert np.allclose(model.expected_counts(sequences), counts)
    long = [r.integers(0, 5, 900).astype(np.uint16) for _ in range(3)]
    likelihoods = []
    for _ in range(5):
        c = model.expected_counts(long)
        likelihoods.append(c[-1])
        model = model.updated(c)
    assert likelihoods == sorted(likelihoods)


def test_words_to_classes_to_score_equal_brute_force(spark):
    """Counts, classes, one pass of training and the likelihood of short texts, each computed plainly."""
    from tessera.llm.hmm import OFTEN, TAIL_SEED, TAILS, TOPS, WORD_SEED, Hmm, hmm_scores

    texts = ["a B c", "b c", "", "a a", "zz yy", "c", "B", "a yy c", "qq", "a c b"]
    rows = [(i, texts[i % len(texts)]) for i in range(40)]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    split = {i: t.lower().split() for i, t in rows}
    counts = Counter(w for i, t in split.items() if i not in held for w in t)
    ends = len(rows) - len(held)
    total = sum(counts.values()) + ends
    often = sorted((w for w in counts if counts[w] >= OFTEN * total), key=lambda w: -counts[w])[:TOPS]
    by_hash = sorted(often, key=lambda w: xxhash.xxh64_intdigest(w.encode(), WORD_SEED))
    tail = lambda w: 1 + xxhash.xxh64_intdigest(w.encode()[-3:], TAIL_SEED) % TAILS
    kind = lambda w: 1 + TAILS + by_hash.index(w) if w in by_hash else tail(w)
    # a tail class holds the known words that are no class of their own, each with count + 1, and one share for all others
    rest = [w for w in counts if w not in by_hash]
    share = lambda w: 1.0 if w in by_hash else (counts[w] + 1) / (sum(counts[v] + 1 for v in rest if tail(v) == tail(w)) + 1)
    model = Hmm.random(2, 1 + TAILS + TOPS)
    coded = {i: np.array([*map(kind, t), 0], np.uint16) for i, t in split.items()}
    model = model.updated(model.expected_counts([coded[i] for i, _ in rows if i not in held]))
    found = hmm_scores(spark.createDataFrame(rows, "doc_id long, text string"), states=2, passes=1).collect()
    assert len(found) == len(rows) and held
    for r in found:
        want = brute_likelihood(model, coded[r.doc_id]) / math.log(10) + sum(math.log10(share(w)) for w in split[r.doc_id])
        assert math.isclose(r.score, want, rel_tol=1e-6), r


def test_hmm_scores(spark, messy, empty):
    from tessera.llm.hmm import hmm_scores

    for rows, df in ((TEXTS, messy), ([(r.doc_id, r.text) for r in documents(spark).collect()], documents(spark))):
        lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
        split = [(i, [*(t or "").encode().translate(lower).split(), None]) for i, t in rows]
        held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
        counts = Counter(w for i, t in split if not held(i) for w in t)
        n, v = sum(counts.values()), len(counts)
        found = sorted(hmm_scores(df, passes=4, chunk_bytes=100_000).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens))
        split.sort(key=lambda x: (x[0] is None, x[0] or 0, len(x[1])))
        for r, (i, t) in zip(found, split, strict=True):
            assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, held(i), len(t), sum(counts[w] > 0 for w in t), n)
            assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
            assert r.score < 0 and math.isfinite(r.score)
    out = [r for r in found if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert hmm_scores(empty).count() == 0
