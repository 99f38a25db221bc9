import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dasyspark.llm import packing, tokens


def power(n):
    return n & (n - 1) == 0


def check(rows, sizes, window):
    """Every id once, sequences gapless, padding only where unavoidable."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert {d: sorted((r["start"], r["length"]) for r in x)[0][0] for d, x in by_doc.items()} == dict.fromkeys(sizes, 0)
    for doc, x in by_doc.items():
        at = 0
        for r in sorted(x, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0
            at += r["length"]
        assert at == sizes[doc]
    padding = 0
    for x in by_sequence.values():
        at = 0
        for r in sorted(x, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += 0 if power(at) else window - at
    return padding


def test_choice_leaves_the_least_sum_of_squares():
    rng = np.random.default_rng(1)
    levels = packing.Levels(16)
    for size in rng.integers(1, 17, 400).tolist():
        options = {0: None} | {h: None for h in range(1, 17 - size) if levels.count[h]} | ({16 - size: None} if size < 16 and levels.count[16 - size] else {})
        for h in options:
            c = levels.count.copy()
            if h:
                c[h] -= 1
            if h + size < 16:
                c[h + size] += 1
            options[h] = int((c[1:16] ** 2).sum())
        level = levels.place(size)
        assert options[level] == min(options.values())
        content = levels.take(level)
        if level + size < 16:
            levels.put(level + size, content)


@pytest.mark.parametrize("window", [8, 64])
def test_every_id_lies_in_one_piece_without_padding(window):
    rng = np.random.default_rng(window)
    for n in (0, 1, 2, 50, 700):
        docs = [(i, rng.integers(0, 50_000, int(s)).astype(np.uint32)) for i, s in enumerate(rng.integers(1, 3 * window, n))]
        rows = []
        for columns in packing.pack_partition(iter(docs), 0, window, rows=10):
            rows += [dict(zip(columns, x, strict=True)) for x in zip(*columns.values(), strict=True)]
        assert check(rows, {i: len(x) for i, x in docs}, window) == 0
        for r in rows:
            ids = docs[r["doc_id"]][1][r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(ids.astype("<u4").tobytes())


def encoder():
    return tokens.byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_ids_equal_those_of_the_json_vocabulary(spark):
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    known.encode_special_tokens = True
    texts = ["", " ", "a  b\n\n c \t d", "it's 12,5 é 漢字 \u3000 ﬁ", "x" * 3000, "<|endoftext|> y", "\x00\x0b"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    for text, ids in zip(texts, encoder()()(texts), strict=True):
        assert known.encode(text, add_special_tokens=False).ids == ids.tolist()


def test_added_tokens_get_their_ids_as_in_the_json_vocabulary():
    path = public_tokenizers.path("byte_bpe_50k.json")
    known = Tokenizer.from_file(path)
    make = tokens.byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, tokens.added_tokens(path))
    texts = ["<|endoftext|> y", "a  <|endoftext|><|endoftext|>\n b", "x<|endoftext|", "é<|endoftext|>", "plain  text"]
    for text, ids in zip(texts, make()(texts), strict=True):
        assert known.encode(text, add_special_tokens=False).ids == ids.tolist()
    assert make()(texts)[0][0] == known.token_to_id("<|endoftext|>")


def test_the_query_counts_an_added_token_once(spark, tmp_path):
    from dasyspark.llm.queries import QUERIES

    rows = [(1, "one <|endoftext|> two", "en", "a", 21)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = QUERIES["op6_sum_of_squares_packing"](spark, str(tmp_path)).collect()
    assert {r["doc_tokens"] for r in found} == {len(known.encode(rows[0][1], add_special_tokens=False).ids) + 1}  # and the end


def test_documents_with_odd_rows(odd, nothing):
    rows = [r.asDict() for r in packing.pack_documents(odd.where("doc_id <> 5"), encoder()).collect()]
    sizes = {r["doc_id"]: r["doc_tokens"] for r in rows}
    assert sizes[1] == sizes[2] == 1 and sizes[7] > 80_000
    # One rest a task at most, and that one is cut at powers of two.
    assert check(rows, sizes, 1024) == 0
    assert packing.pack_documents(odd, encoder()).where("doc_id = 5 AND start = 0").count() == 2
    assert packing.pack_documents(odd, encoder()).where("doc_id IS NULL").count() >= 1
    assert packing.pack_documents(nothing, encoder()).count() == 0
