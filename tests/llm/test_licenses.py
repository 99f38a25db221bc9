import random
import re

import pytest
from pyspark.sql import functions as F

from dasyspark.llm import licenses as L
from dasyspark.llm.common import LOWER_AZ


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER_AZ))


def plain(text, rows, least=L.LEAST_COVER):
    """Every template against every place of the text, diagonal by diagonal."""
    have, out = words(text), []
    for label, notice, base in rows:
        want = words(notice)
        k = min(L.WIDTH, len(want))
        votes = {}
        for at in range(len(want) - k + 1):
            for pos in range(len(have) - k + 1):
                if have[pos : pos + k] == want[at : at + k]:
                    votes.setdefault(pos - at, set()).add(at)
        groups = []
        for d in sorted(votes):
            if groups and (d - groups[-1][-1]) * L.SLACK <= len(want):
                groups[-1].append(d)
            else:
                groups.append([d])
        for ds in groups:
            start = min(d + min(votes[d]) for d in ds)
            length = max(d + max(votes[d]) + k for d in ds) - start
            covered = {a + i for d in ds for a in votes[d] for i in range(k)}
            cover = len(covered) / max(len(want), length)
            if cover >= least:
                out.append((start, length, label, base, cover))
    return sorted(out)


ROWS = [*((*p, True) for p in L.PHRASES), *((*n, False) for n in L.NOTICES), ("one", "solo", False)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    mit = L.NOTICES[14][1]
    cut = mit.split()
    out = {
        1: "x All Rights Reserved. all rights, reserved", 2: "cc by cc by CC-BY", 3: f"start {mit} end", 4: f"{mit} {mit} twice",
        5: "a " + " ".join(cut[:9] + ["really"] + cut[9:]) + " b", 6: " ".join(cut[:5] + cut[6:]), 7: " ".join(cut[:8]), 8: "cc", 9: "solo é solo",
        10: "the gnu general public license, version 3 or GNU Lesser General Public License", 11: "all rights are reserved", 12: "é" + mit,
    }
    pool = [w for _, t, _ in ROWS for w in words(t)] + ["noise"] * 20
    for i in range(100, 160):
        parts = [rng.choice([rng.choice(ROWS)[1], " ".join(rng.choices(pool, k=rng.randint(1, 12)))]) for _ in range(4)]
        out[i] = " . ".join(parts)
    return out


def test_scan_matches_plain(make, spark, texts):
    docs = make([*texts.items(), (900, texts[4]), (901, texts[4])])
    rows = {r["doc_id"]: r for r in L.scan(docs, L.templates(spark, ROWS)).collect()}
    for key, text in [*texts.items(), (900, texts[4]), (901, texts[4])]:
        expected = plain(text, ROWS)
        assert sorted((s["start"], s["length"], s["label"], s["base"], s["cover"]) for s in rows[key]["licenses"]) == expected, text
        assert rows[key]["n_words"] == len(words(text))
        assert rows[key]["score"] == max((e[-1] for e in expected), default=0.0)
    assert [s["label"] for s in rows[5]["licenses"]] == ["mit"] and not rows[7]["licenses"] and not rows[11]["licenses"]


def test_shuffled_join_gives_the_same(make, spark, texts, monkeypatch):
    docs = make(list(texts.items()))
    small = {r["doc_id"]: r["licenses"] for r in L.scan(docs).collect()}
    monkeypatch.setattr("dasyspark.llm.common.small", lambda *_: False)
    assert {r["doc_id"]: r["licenses"] for r in L.scan(docs).collect()} == small


def test_odd_rows(odd, nothing, spark):
    clashing = odd.withColumns({n: F.lit("extra") for n in ("n_words", "licenses", "template", "pos", "words", "h", "base")})
    out = L.scan(clashing)
    rows = out.collect()
    assert len(rows) == clashing.count() and set(out.columns) == set(clashing.drop("node").columns) | {"score"}
    for r in rows:
        assert r["n_words"] == len(words(r["text"])) and r["licenses"] == [] and r["score"] == 0 and r["template"] == "extra"
    assert L.scan(nothing).count() == 0
    none = L.templates(spark, [("blank", " - ", False)])
    assert none.count() == 0 and {r["score"] for r in L.scan(odd, none).collect()} == {0.0}


def test_no_python_on_the_way(make, texts):
    plan = L.scan(make(list(texts.items())))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
