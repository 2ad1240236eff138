"""The pipeline's stages on the smallest documents and on a hard table, each
against a plain version of what it promises."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.conftest import SMALL
from tests.llm.test_operators import removed_words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(text):
    w = (text or "").lower().encode().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def near_groups(rows):
    """Component of each row by exact Jaccard similarity of all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    while True:
        new = [min(root[j] for j in range(len(rows)) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in range(len(rows))]
        if new == root:
            return root
        root = new


def order(row):
    return row[0] is None, row[0] or 0


@pytest.fixture(scope="module")
def hard(spark):
    """Repeated and null ids, repeated rows, ties, empty and long texts, near pairs about the threshold, shared passages."""
    r = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in r.integers(0, 40_000, n)]
    passage = " ".join(word(60))
    texts = [(1, None), (2, ""), (2, "  "), (3, "same text here"), (3, "same text here"), (3, "another text"), (None, "same text here"), (None, "alone"), (None, "alone"), (4, "same text here")]
    for g in range(30):  # planted near pairs: 7 or 8 changes touch five shingles each of 396, 16 are clean
        w = word(400)
        texts.append((100 + 2 * g, " ".join(w)))
        for k in np.arange([7, 8, 16][g % 3]) * 24 + 5:
            w[k] = f"changed{g}"
        texts.append((101 + 2 * g if g % 4 else 100 + 2 * g, " ".join(w)))  # some share the id of their copy
    texts += [(300 + k, " ".join(word(30)) + " " + passage + " " + " ".join(word(200))) for k in range(5)]
    texts += [(400, " ".join(word(20_000))), (9, " ".join(["tab\tand", "new\nline"] * 20))]
    rows = [(i, t, "en", f"s{n % 3}", len(t) if t else None, n, "x", True) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp long, component_id string, kept boolean")


def plain(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_exact_keeps_one_row_of_each_text(spark, hard):
    import corpus_pipeline as p

    rows = plain(hard)
    found = p.exact(spark, hard, SMALL)
    assert found.columns == COLUMNS
    best = {}
    for row in rows:
        text = row[1] or ""
        if text not in best or order(row) < order(best[text]):
            best[text] = row
    assert Counter((i, t or "") for i, t in plain(found)) == Counter((best[t][0], t) for t in best)
    assert p.exact(spark, hard.limit(0), SMALL).count() == 0


def test_near_keeps_one_row_of_each_group(spark, hard):
    import corpus_pipeline as p

    docs = p.exact(spark, hard, SMALL).cache()
    rows = plain(docs)
    roots = near_groups(rows)
    groups = {}
    for row, root in zip(rows, roots):
        groups.setdefault(root, []).append(row)
    found = p.near(spark, docs, SMALL)
    assert found.columns == COLUMNS
    kept = plain(found)
    assert len(kept) == len(set(kept)) == len(groups)
    for members in groups.values():
        own = [row for row in kept if row in members]
        assert len(own) == 1 and order(own[0])[:2] == min(order(m) for m in members)
    assert any(len(m) > 1 for m in groups.values()) and sum(t.count("changed") > 0 for _, t in kept if t) >= 10
    assert p.near(spark, hard.limit(0), SMALL).count() == 0


def test_substring_keeps_every_row_and_its_columns(spark, hard):
    import corpus_pipeline as p

    given = [(r.doc_id, r.text, r.source) for r in hard.collect()]
    found = p.substring(spark, hard, SMALL)
    assert found.columns == COLUMNS
    want = Counter()
    for (i, t, source), (_, _, removed, kept) in zip(given, removed_words([(i, t) for i, t, _ in given])):
        text = kept if removed else t
        want[i, text, source, None if text is None else len(text)] += 1
    assert Counter((r.doc_id, r.text, r.source, r.n_chars) for r in found.collect()) == want
    assert p.substring(spark, hard.limit(0), SMALL).count() == 0


def test_quality_judges_each_row_by_its_own_text(spark, hard):
    import corpus_pipeline as p
    from tessera.llm.quality import quality_scores

    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select(*COLUMNS)
    both = hard.select(*COLUMNS).unionByName(documents.withColumn("doc_id", documents.doc_id + 1000)).cache()
    labels = labels.withColumn("doc_id", labels.doc_id + 1000)
    judged = {}
    for r in quality_scores(both, labels, threshold=0.3).collect():
        assert judged.setdefault((r.doc_id, r.text_md5), r.predicted) == r.predicted
    rows = plain(both)
    want = Counter((i, t) for i, t in rows if judged[i, hashlib.md5((t or "").encode()).hexdigest()])
    assert Counter(plain(p._keep(both, quality_scores(both, labels, threshold=0.3).where("predicted = 1")))) == want
    assert 0 < sum(want.values()) < len(rows)


def test_packing_places_every_token_once(spark, hard):
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(p.vocabulary_path())
    found = p.packing(spark, hard, SMALL).collect()
    want = Counter()
    for i, t in plain(hard):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[i, n, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and sum(n for _, n in pieces) <= 2048
    assert len(sequences) <= math.ceil(sum(r.length for r in found) / 2048) + 2


def test_stages_in_order(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    for number, (name, stage) in enumerate(p.STAGES):
        docs = spark.createDataFrame(stage(spark, docs, SMALL).toPandas()) if number < 4 else stage(spark, docs, SMALL)
        if number == 4:
            break
        assert docs.columns == COLUMNS
        kept = {r.doc_id: r.text for r in docs.collect()}
        assert set(kept) <= set(rows) and len(kept) > 0.5 * len(rows), name
        if name == "exact dedup":
            assert len(set(kept.values())) == len(kept) and set(kept.values()) == set(rows.values())
            assert all(i == min(j for j, t in rows.items() if t == kept[i]) for i in kept)
        if name == "SimHash near-dedup":
            ordered = sorted(rows.items())
            roots = near_groups(ordered)
            assert set(kept) == {ordered[k][0] for k in set(roots)}
        if name == "substring dedup":
            assert set(kept) == set(rows)
            assert kept == {i: k if n else rows[i] for i, _, n, k in removed_words(sorted(rows.items()))}
        elif number:
            assert all(kept[i] == rows[i] for i in kept)
        rows = kept
    placed = docs.collect()
    assert {r.doc_id for r in placed} == set(rows)


def test_run_returns_pieces(spark):
    import corpus_pipeline as p

    found = p.run(spark, SMALL)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(found.columns) and found.count() > 0
