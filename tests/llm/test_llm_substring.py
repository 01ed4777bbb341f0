import hashlib
from collections import Counter

import pytest
from edge import WORD, collect, documents

from tidemark.llm.substring import COVER, PERIOD, repeated_passages


def brute(data, width):
    words = [WORD.findall(t or "") for _, t in data]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(data, words):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_every_shift_pair_has_an_anchor():
    for i in range(PERIOD):
        for j in range(PERIOD):
            assert any((i + s) % PERIOD in COVER and (j + s) % PERIOD in COVER for s in range(PERIOD))


@pytest.mark.parametrize("width", [24, 35])
def test_against_brute_force(spark, width):
    docs = documents(spark)
    got = collect(repeated_passages(docs, width=width))
    data = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute(data, width)
    assert any(0 < r["n_removed"] < r["n_words"] for r in got)
    for r in got:
        assert sum(s["end_word"] - s["first_word"] for s in r["removed_spans"]) == r["n_removed"]


def test_empty_table_and_narrow_window(spark):
    assert collect(repeated_passages(documents(spark).limit(0))) == []
    with pytest.raises(ValueError):
        repeated_passages(documents(spark), width=10)
