import numpy as np
import pytest

from dasyspark.llm import suffix_dedup as S


def plain(docs, length=100):
    """Removed byte ranges per document, judged on every window."""
    first, out = {}, {}
    for i, text in sorted(docs):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if first.setdefault(raw[p : p + length], (i, p)) != (i, p):
                gone[p : p + length] = True
        out[i] = bytes(b for b, g in zip(raw, gone, strict=True) if not g), int((np.diff(np.pad(gone, 1).astype(int)) == 1).sum())
    return out


def passages(seed):
    rng = np.random.default_rng(seed)

    def words(n):
        return " ".join("".join(chr(97 + c) for c in rng.integers(0, 6, rng.integers(1, 7))) for _ in range(n))

    shared = [words(int(n)) for n in (12, 20, 30, 60, 200)]
    docs = []
    for i in range(60):
        part = [words(int(rng.integers(0, 60)))]
        for _ in range(rng.integers(0, 4)):
            p = str(rng.choice(shared))
            a = int(rng.integers(0, max(1, len(p) - 90)))
            part += [p[a : a + int(rng.integers(80, 400))], words(int(rng.integers(0, 20)))]
        docs.append((i * 7 % 61, "é".join(part)))
    docs += [(100, "ab" * 300), (101, "ab" * 90), (102, "z" * 99), (103, "z" * 100), (104, "z" * 101), (105, None), (106, "")]
    docs += [(107, docs[0][1]), (108, shared[4] * 2)]
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_to_looking_at_every_window(spark, make, seed):
    docs = passages(seed)
    rows = S.remove_repeats(make(docs).repartition(5)).collect()
    assert {r.doc_id: (bytes(r.kept), len(r.spans)) for r in rows} == plain(docs)


def test_other_lengths_agree(make):
    docs = passages(9)
    for length in (40, 300):
        rows = S.remove_repeats(make(docs), length).collect()
        assert {r.doc_id: (bytes(r.kept), len(r.spans)) for r in rows} == plain(docs, length)


def test_multikey_order_sorts_and_counts_common_words():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 3, (500, 6)).astype(np.uint64)
    order, equal = S.multikey_order(words)
    rows = [tuple(w) for w in words[order].tolist()]
    assert rows == sorted(rows)
    for a, b, n in zip(rows, rows[1:], equal[1:].tolist(), strict=False):
        assert a[:n] == b[:n] and (n == 6 or a[n] != b[n])


def test_odd_rows(odd, nothing):
    rows = S.remove_repeats(odd).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 11 and by[1].kept == by[2].kept == b"" and by[None].kept == b"no id at all"
    # A run of one letter repeats itself from its second start on: the first byte stays.
    assert by[9].kept == b"a" and [tuple(s) for s in by[9].spans] == [(1, 5000)]
    assert sum(bytes(r.kept) == "Same Text here é 漢 ▁ x".encode() for r in rows) == 3
    assert bytes(by[7].kept) == plain([(7, by[7].text)])[7][0] != by[7].text.encode()
    assert S.remove_repeats(nothing).count() == 0


def test_rows_repeated_as_a_whole_are_one_document(make):
    text = "".join(chr(97 + int(i)) for i in np.random.default_rng(8).integers(0, 26, 400))
    rows = S.remove_repeats(make([(1, text), (1, text), (2, text)])).collect()
    assert sorted((r.doc_id, len(r.kept)) for r in rows) == [(1, 400), (1, 400), (2, 0)]
    loop = "abcdefghijklmnopqrstuvw" * 20
    rows = S.remove_repeats(make([(1, loop), (1, loop)])).collect()
    assert [len(r.kept) for r in rows] == [23, 23]
