import hashlib
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

from stopwise.llm import bpe as m
from stopwise.llm import words as w
from stopwise.llm.words import chunks, cut, default_path, words_of

TEXTS = [
    "", " \n", "don't stop' x'll İstanbul! İ! a<|startoftext|>b <|endoftext|>", "́abc é! 12ab34,5 ñ̃.",
    "漢字かな　テスト\x85a\x1cb", "a" * 3000, "ΑΣ ΟΔΟΣ. ß ŉx ſt! ﬁ ǅ", "x​y­z  ﻿ q", "tab\tcr\rlf\n  two",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


def test_ids_of_words_in_a_row_are_those_of_the_text(library):
    words = words_of(default_path())
    for text in TEXTS:
        ids = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert words.ids(text) == ids
        assert b"".join(words.encode([w for c in chunks(text) for w in cut(c)])) == ids


@pytest.mark.parametrize("head", [0, 3, m.HEAD])
def test_equals_the_library(spark, odd_docs, library, head):
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").union(more).union(more.limit(1))
    expected = []
    for i, text in docs.collect():
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        raw = np.array(ids, "<u4").tobytes()
        expected.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = m.digest_tokens(docs, head=max(1, head)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_operator_returns_ids_and_text(spark, library):
    docs = spark.createDataFrame([(1, "Hello there, world 42!")], "doc_id long, text string")
    row = m.encode(docs).first()
    ids = library.encode("Hello there, world 42!", add_special_tokens=False).ids
    assert np.frombuffer(row.ids, "<u4").tolist() == ids
    assert row.decoded == library.decode(ids, skip_special_tokens=False)


def test_empty_table(spark, no_docs):
    assert m.digest_tokens(no_docs).collect() == []


def test_words_encoded_together_are_those_encoded_alone():
    words = words_of(default_path())
    texts = ["Straße ſo ŉ été it's", "", "a" * 3_000 + " b", "İstanbul x́ naïve,naïve", " ".join(map(str, range(600)))]
    found = list(words.each(texts * 2))
    for text, ids in zip(texts * 2, found, strict=True):
        alone = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert ids == np.array(alone, "<u4").tobytes()
    plain = [f"{a}{b}" for a in "bcdfg" for b in ("ab", "éß", "ſt", "ÿ")] * 40
    alone = [np.array(words.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in plain]
    assert words.encode(plain) == alone


def test_words_are_remembered_once_however_they_are_joined(monkeypatch):
    monkeypatch.setattr(w, "REMEMBERED", 40)
    monkeypatch.setattr(w, "AT_ONCE", 60)
    words = w.Words(default_path())
    texts = [f"zebra.{n % 9} zebra,%{n % 7}\x0bx{n % 90}y naïve;zebra\u00a0a" for n in range(200)]
    for text, ids in zip(texts, words.each(texts), strict=True):
        assert ids == np.array(words.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    held = words.known.keys() | words.older.keys()
    assert {"zebra", "naïve"} <= held
    assert all(cut(x) == [x] for x in held)


def test_rows_without_an_id_or_with_the_same_one_keep_their_words(spark, library):
    texts = [f"zq{n}xw common{n % 3} wv{n % 7}k" for n in range(40)] * 5
    rows = [(None if n % 2 else 7, t) for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = m.encode(docs, head=2).collect()
    expected = sorted(
        (i is None, np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()) for i, t in rows
    )
    assert sorted((r.doc_id is None, bytes(r.ids)) for r in found) == expected


def test_no_stage_sends_its_rows_through_python_twice(spark, capsys):
    """Each such step has a process of its own beside the executor: two in a row take twice the memory."""
    texts = [(n, f"zq{n}xw common{n % 3}, wv{n % 7}k") for n in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for df in (m.digest_tokens(docs), m.encode(docs)):
        capsys.readouterr()
        df.explain("simple")
        plan = [re.sub(r"^[\s:+|*()\d-]*", "", x).split(" ")[0] for x in capsys.readouterr().out.splitlines()]
        steps = [x for x in plan if x in ("MapInArrow", "Exchange", "SortMergeJoin", "BroadcastHashJoin", "Scan")]
        assert steps.count("MapInArrow") == 4
        assert ("MapInArrow", "MapInArrow") not in set(zip(steps, steps[1:], strict=False))


def test_words_and_their_ids_travel_in_one_column(spark, library):
    words = ["zq", "zq", "naïve", "12ab;", "漢字\x85x", "a" * 90]
    rows = spark.createDataFrame(list(enumerate(words)), "of long, word string").coalesce(1)
    for ordered in (rows, rows.sortWithinPartitions("word")):
        found = m.encode_words(ordered, default_path())
        assert found.columns == ["of", "pair"]
        apart = [(r.of, *m._apart([bytes(r.pair)]).popitem()) for r in found.collect()]
        assert sorted((of, w) for of, w, _ in apart) == list(enumerate(words))
        for _, w, ids in apart:
            kind = words_of(default_path()).narrow()
            assert np.frombuffer(ids, kind).tolist() == library.encode(w, add_special_tokens=False).ids
