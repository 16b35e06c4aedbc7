import random
import re

import numpy as np

from stopwise.llm import ngram_join as m
from stopwise.llm.shingles import shingles


def sets(rows):
    out = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
        n = min(5, len(words))
        out.append((i, {tuple(words[j : j + n]) for j in range(len(words) - n + 1)} if words else set()))
    return out


def brute(rows):
    found = sets(rows)
    label = list(range(len(found)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, (_, s) in enumerate(found):
        for b, (_, t) in enumerate(found[:a]):
            both = len(s & t)
            if s and t and 100 * both >= 80 * (len(s) + len(t) - both):
                label[max(top(a), top(b))] = min(top(a), top(b))
    ids = {}
    for a, (i, _) in enumerate(found):
        ids.setdefault(top(a), []).append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return sorted([(i, len(s), least[top(a)] if s else i) for a, (i, s) in enumerate(found)], key=str)


def near_copies():
    """Chains and groups of edited texts around the threshold."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4_000)]
    rows, n = [], 0
    for size in (1, 2, 4, 5, 6, 8, 9, 10, 13, 20, 33, 60, 120, 400, 1200):
        base = rng.choices(vocabulary, k=size)
        for copies in range(14):
            text = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                at = rng.randrange(len(text))
                if rng.random() < 0.5:
                    text[at] = rng.choice(vocabulary)
                else:
                    text.insert(at, rng.choice(vocabulary))
            if copies % 5 == 4:
                base = text
            rows.append((n, " ".join(text)))
            n += 1
    return rows


def test_equals_brute_force(spark, odd_docs):
    rows = near_copies() + [(None if i is None else 10_000 + i, t) for i, t in odd_docs.select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, m.join(docs).collect()), key=str) == brute(rows)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(2)
    for size in (4, 5, 9, 10, 30, 100, 500, 3_000):
        for _ in range(40):
            base = rng.integers(0, 2**63, size).astype(np.uint64)
            # The greatest difference at which sets of this size still link.
            fresh = size - -(-160 * size // 180)
            other = np.concatenate([base[fresh:], rng.integers(0, 2**63, fresh).astype(np.uint64)])
            assert len(np.intersect1d(m.signatures(np.unique(base)), m.signatures(np.unique(other))))


def test_bands_cover_sizes_once():
    found = m.bands(10_000)
    assert all(a[1] + 1 == b[0] for a, b in zip(found, found[1:], strict=False)) and found[0][0] == 1


def test_shingles_are_ascii_lower_case_and_split():
    assert np.array_equal(shingles("A b C\x0bd e F"), shingles("a b c d  e f"))
    assert len(shingles("Ä b c d e")) == 1 and not np.array_equal(shingles("Ä b"), shingles("ä b"))
    assert len(shingles("a\xa0b c")) == 1 and len(shingles(" \n")) == 0


def test_one_of_each_group_stays(spark, odd_docs, no_docs):
    left = m.keep_one(odd_docs)
    assert left.columns == odd_docs.columns
    # 7 is 6 with one more word; 1 and 2 have equal words; texts without words stay.
    assert {r.doc_id for r in left.collect()} == {1, 3, 4, 5, 6, 8, None}
    assert m.join(no_docs).collect() == []


def test_word_hashes_are_those_of_the_words(monkeypatch):
    """A word's hash tells words apart and does not depend on its place, also over cut texts."""
    from stopwise.llm import shingles as h

    texts = ["", " \t\n", "aB ab\x00 \x00 é É a\u00a0b", "x" * 5_000 + " ab " + "y z " * 3_000, "ba ab aab aba baa a aa"]
    seen = {}
    for piece in (1 << 20, 7):
        monkeypatch.setattr(h, "PIECE", piece)
        for text in texts:
            words, found = text.encode().lower().split(), h.word_hashes(text).tolist()
            assert len(words) == len(found)
            for word, value in zip(words, found, strict=True):
                assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_a_label_meets_others_of_a_signature_once(spark, monkeypatch):
    import zstandard

    words = [f"w{i}" for i in range(400)]
    texts = [" ".join([*words[:i], f"x{i}", *words[i + 1 :]]) for i in range(100, 140)]
    packed = [zstandard.ZstdCompressor().compress(t.encode()) for t in texts]
    # One large component and two nodes of their own, all near copies.
    label = [0] * 38 + [38, 39]
    apart = spark.createDataFrame([(i, 390, label[i]) for i in range(40)], "node long, n_shingles long, label long")
    rows = spark.createDataFrame(list(enumerate(packed)), "node long, packed binary")
    edges, find = [], m.components

    def counted(found):
        edges.append(found.where("a <> b").count())
        return find(found)

    monkeypatch.setattr(m, "components", counted)
    links = m._families(apart, rows).collect()
    assert {frozenset((label[r.a], label[r.b])) for r in links} >= {frozenset((0, 38)), frozenset((0, 39))}
    # Each node meets its label, and each label the smallest one, not every node every signature.
    assert sum(edges) <= 37 + 2 * 2


def packed_rows(spark, texts):
    import zstandard

    rows = [(i, zstandard.ZstdCompressor().compress(t.encode())) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "node long, packed binary")


def test_linked_sets_share_one_of_their_rarest_shingles(spark, monkeypatch):
    """Each two sets that link, whether their shingles fill one row or several."""
    monkeypatch.setattr(m, "ROW", 7)
    monkeypatch.setattr(m, "ROWS", 1_000)
    texts = list({frozenset(shingles(t).tolist()): t for _, t in near_copies()}.values())
    found = [set(shingles(t).view(np.int64).tolist()) for t in texts]
    # Some labels have several nodes; links inside of these are known.
    label = [i - i % 3 if i < 60 else i for i in range(len(texts))]
    rows = [(i, 0, label[i]) for i in range(len(texts))]
    apart = spark.createDataFrame(rows, "node long, n_shingles long, label long")
    rare = {r.node: r for r in m._rarest(apart, packed_rows(spark, texts)).collect()}
    assert all(r.n_shingles == len(found[i]) and set(r.signs) <= found[i] for i, r in rare.items())
    links = 0
    for i, s in enumerate(found):
        for j, t in enumerate(found[:i]):
            both = len(s & t)
            if label[i] != label[j] and 100 * both >= 80 * (len(s) + len(t) - both):
                links += 1
                assert set(rare[i].signs) & set(rare[j].signs)
    assert links > 40


def test_a_common_passage_makes_no_family(spark, monkeypatch):
    """Texts with a passage in common and most words of their own are not compared with each other."""
    line = " ".join(f"w{i}" for i in range(20))
    texts = [" ".join([line, *(f"x{k}y{i}" for i in range(22))]) for k in range(60)]
    texts += [f"{texts[0]} end", f"{texts[1]} end"]
    members, write = [], m.stored

    def seen(df, name):
        table = write(df, name)
        if name == "family-members":
            members.extend(table.collect())
        return table

    monkeypatch.setattr(m, "stored", seen)
    apart = spark.createDataFrame([(i, 0, i) for i in range(62)], "node long, n_shingles long, label long")
    links = m._families(apart, packed_rows(spark, texts)).collect()
    assert {frozenset(r) for r in links} == {frozenset((0, 60)), frozenset((1, 61))}
    assert sorted(r.node for r in members) == [0, 1, 60, 61]
    assert len({r.family for r in members}) == 2


def test_pairs_of_blocks_are_dealt_out_in_turns(spark, monkeypatch):
    """A large family is compared as a whole, a bounded part of the pairs of its blocks at a time."""
    # Texts link to the next five on either side.
    texts = [" ".join(f"w{i}" for i in range(2 * k, 2 * k + 100)) for k in range(40)]
    tables, write = [], m.stored

    def seen(df, name):
        tables.append((name, write(df, name)))
        return tables[-1][1]

    monkeypatch.setattr(m, "stored", seen)
    monkeypatch.setattr(m, "BLOCK_SHINGLES", 400)
    monkeypatch.setattr(m, "TIMES", 2)
    monkeypatch.setattr(m, "FEW_SHINGLES", 1)
    apart = spark.createDataFrame([(i, 96, i) for i in range(40)], "node long, n_shingles long, label long")
    found = [set(shingles(t).tolist()) for t in texts]
    links = m._families(apart, packed_rows(spark, texts)).collect()
    pairs = [(i, j) for i in range(40) for j in range(i)]
    linked = {frozenset((i, j)) for i, j in pairs if 100 * len(found[i] & found[j]) >= 80 * len(found[i] | found[j])}
    assert {frozenset(r) for r in links} == linked and len(linked) == 5 * 40 - 15
    assert [name for name, _ in tables].count("links") > 3


def test_copies_of_a_large_family_go_in_turns(spark, monkeypatch):
    """The pipeline's stage, with a family of several blocks and turns."""
    monkeypatch.setattr(m, "BLOCK_SHINGLES", 100)
    monkeypatch.setattr(m, "TIMES", 1)
    monkeypatch.setattr(m, "FEW_SHINGLES", 1)
    rows = [r for r in near_copies() if len(r[1].split()) < 200]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {i for i, _, component in brute(rows) if i == component}
    assert {r.doc_id for r in m.keep_one(docs).collect()} == kept
