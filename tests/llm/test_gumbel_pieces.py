import itertools
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from dasyspark.llm import gumbel_pieces as G

PATH = public_tokenizers.path("piece_bpe_32k.model")


def all_segmentations(vocab, text):
    """Every segmentation of a text with its log weight."""
    if not text:
        return [((), 0.0)]
    out = []
    for j in range(1, len(text) + 1):
        piece = vocab.pieces.get(text[:j])
        if piece is not None:
            out += [((piece, *rest), vocab.weight[piece] + w) for rest, w in all_segmentations(vocab, text[j:])]
    if text[0] not in vocab.pieces:
        coded = text[0].encode()
        ids = tuple(vocab.bytes[b] for b in coded)
        out += [((*ids, *rest), len(ids) * vocab.byte_weight + w) for rest, w in all_segmentations(vocab, text[1:])]
    return out


@pytest.fixture(scope="module")
def vocab():
    return G.vocabulary(PATH)


def test_first_sample_follows_the_distribution_and_the_second_excludes_it(vocab):
    text = "an it"
    every = all_segmentations(vocab, " " + text)
    weights = np.exp(np.array([w for _, w in every]))
    p = dict(zip([s for s, _ in every], weights / weights.sum(), strict=True))
    n = 6000
    lattices = G.Lattices(vocab)
    rows = G.sample_batch(lattices, [text] * n, G.mix(np.arange(1, n + 1, dtype=np.uint64)), 2)
    pairs = Counter()
    for row in rows:
        a, b = (tuple(x for q in s["paths"] for x in q) for s in row.found)
        assert a != b and row.found[0]["g"] >= row.found[1]["g"]
        assert abs(np.exp(row.found[1]["logp"].sum()) - p[b]) < 1e-9
        pairs[a, b] += 1
    likely = sorted(p, key=p.get)[-4:]
    for a, b in itertools.permutations(likely, 2):
        want = p[a] * p[b] / (1 - p[a])
        assert abs(pairs[a, b] / n - want) < 4 * np.sqrt(want / n) + 1e-3


def test_all_segmentations_come_out_once_and_then_no_more(vocab):
    for text in ("ab", "é", "日x", "the", "▁a"):
        every = {s for s, _ in all_segmentations(vocab, " " + text)}
        row = G.sample_batch(G.Lattices(vocab), [text], G.mix(np.uint64([5])), len(every) + 5)[0]
        found = [tuple(x for q in s["paths"] for x in q) for s in row.found]
        assert len(found) == len(every) and set(found) == every
        gs = [s["g"] for s in row.found]
        assert gs == sorted(gs, reverse=True)


def test_samples_decode_to_their_text_and_repeat_for_equal_keys(spark, make, odd, nothing):
    texts = ["", "a  b ", " x", "\n\tÄ é 漢　ﬁ ▁ \U0001f600", "x" * 3000, " " * 40, "the same", "the same"]
    docs = make([(i, t) for i, t in enumerate(texts[:-1])] + [(6, texts[-1])]).union(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    found = G.sample_segmentations(docs, PATH, k=3).cache()
    decoded = G.decode_segmentations(found, PATH).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert all(r.decoded == (r.text or "") for r in decoded if r.doc_id not in (1, 2, 3, 4, 5, 6))
    by = {}
    for r in G.sample_segmentations(odd, PATH, k=3).collect():
        by.setdefault((r.doc_id, r.sample), []).append(tuple(r.ids))
    assert by[1, 1] == [()] and (1, 2) not in by and by[5, 1][0] == by[5, 1][1]
    assert len({by[7, 1][0], by[7, 2][0], by[7, 3][0]}) == 3
    assert G.sample_segmentations(nothing, PATH).count() == 0
    assert G.decode_segmentations(found.limit(0), PATH).count() == 0


def test_query_round_trips(spark):
    from dasyspark.llm.queries import QUERIES

    found = QUERIES["op7_gumbel_segmentations"](spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = G.decode_segmentations(found, PATH).join(docs, "doc_id").collect()
    assert {r.sample for r in rows} == {1, 2} and all(r.decoded == r.text and 0 <= r.inclusion <= 1 for r in rows)
    assert len({(r.doc_id, tuple(r.ids)) for r in rows}) == len(rows)


def test_chunks_of_a_batch_are_built_together_and_only_regions_that_can_be_opened_are_kept(vocab):
    chunks = [" the", " é日x", "a", " ", " \n\tz", "an", " word"]
    lattices = G.Lattices(vocab)
    assert lattices.numbers(chunks + chunks[:2]).tolist() == [*range(len(chunks)), 0, 1]
    assert lattices.numbers([" new", "a"]).tolist() == [len(chunks), 2]
    share, pred, piece, weight, start, end, mass, ways, begin, degree = lattices.ready()
    assert len(share) == len(pred) == len(piece) == len(weight) == degree.sum() and len(ways) == len(begin) == lattices.nodes
    assert (share[(begin + degree - 1)[degree > 0]] > 1).all() and (np.delete(begin, start) < len(share)).all()
    for i, chunk in enumerate([*chunks, " new"]):
        every = all_segmentations(vocab, chunk)
        assert abs(np.logaddexp.reduce([w for _, w in every]) - mass[i]) < 1e-9
        assert ways[end[i]] == len(every) and ways[start[i]] == 1
    rows = G.sample_batch(lattices, ["one long text of many words " * 50, "x"], G.mix(np.arange(2, dtype=np.uint64)), 3)
    assert all(len(row.found) == 3 and len(row.heap) <= 5 for row in rows[:1])
