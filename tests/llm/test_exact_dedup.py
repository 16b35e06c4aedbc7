import re

from stopwise.llm import exact_dedup as m


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((i, text or ""))
    out = []
    for same in groups.values():
        order = sorted(same, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        out += [(i, order[0][0], len(same), i == order[0][0]) for i, _ in same]
    return sorted(out, key=str)


def test_equals_brute_force_with_any_share_of_frequent_digests(spark, odd_docs):
    expected = brute([tuple(r) for r in odd_docs.select("doc_id", "text").collect()])
    for heavy in (1, 2, 1000):
        got = m.find_copies(odd_docs, heavy, max(heavy, 4)).drop("text_sha256").collect()
        assert sorted(map(tuple, got), key=str) == expected


def test_one_row_of_each_text_stays_with_all_columns(spark, odd_docs):
    left = m.drop_copies(odd_docs)
    assert left.columns == odd_docs.columns
    rows = left.collect()
    keys = [re.sub(r"\s", "", r.text or "") for r in rows]
    assert len(keys) == len(set(keys)) == 6
    assert {r.doc_id for r in rows} == {2, 5, 6, 7, 8, None}


def test_empty_table(spark, no_docs):
    assert m.find_copies(no_docs).collect() == [] and m.drop_copies(no_docs).collect() == []
