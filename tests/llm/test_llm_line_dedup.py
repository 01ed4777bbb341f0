import random

import pytest
from edge import SCHEMA, WORD, collect, documents, rows, sentence, vocabulary

from tidemark.llm.line_dedup import dedup_lines, one_edit_apart


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def near(w, e):
    """At most one edit apart: in words from eight words on, else in characters from sixteen characters on."""
    if w == e:
        return True
    if (len(w) >= 8) != (len(e) >= 8):
        return False
    a, b = (w, e) if len(w) >= 8 else (" ".join(w), " ".join(e))
    return (len(w) >= 8 or min(len(a), len(b)) >= 16) and abs(len(a) - len(b)) <= 1 and levenshtein(a, b) <= 1


def brute(data):
    """data: (id, text) in order; the expected texts."""
    earlier, out = [], []
    for _, t in data:
        lines, kept, gone = (t.split("\n") if t else []), [], 0
        for line in lines:
            w = WORD.findall(line)
            again = bool(w) and any(near(w, e) for e in earlier)
            if w:
                earlier.append(w)
            gone += again
            if not again:
                kept.append(line)
        out.append(("\n".join(kept) if gone else t, len(lines), gone))
    return out


def respell(r, line):
    """Some characters put in, cut or replaced."""
    for _ in range(r.choice((0, 0, 1, 1, 2))):
        i = r.randrange(len(line) + 1)
        line = line[:i] + r.choice(["", "x", " ", "\u4e2d", "\U0001f600"]) + line[i + r.choice((0, 1, 1)) :]
    return line


def short_corpus(seed=7):
    """Lines of one to fourteen words, lines without spaces, and variants of them by characters."""
    r = random.Random(seed)
    words = vocabulary(seed, 60)
    base = [sentence(r, words, n) for n in range(1, 15) for _ in range(3)]
    base += ["".join(r.choice("\u4e00\u4e8c\u4e09\u56db\u4e94\u516d\u4e03") for _ in range(n)) for n in (3, 8, 15, 16, 17, 40, 300)]
    return ["\n".join(respell(r, r.choice(base)) for _ in range(r.randint(0, 5))) for _ in range(90)]


def corpus(seed=2):
    r = random.Random(seed)
    words = vocabulary(seed, 60)
    base = [sentence(r, words, r.randint(1, 14)) for _ in range(25)]
    texts = []
    for _ in range(45):
        lines = []
        for _ in range(r.randint(0, 6)):
            w = r.choice(base).split()
            for _ in range(r.choice((0, 0, 1, 1, 2))):
                k, i = r.choice(("put", "cut", "swap")), r.randrange(len(w)) if w else 0
                w = w[:i] + ([r.choice(words)] if k == "put" else []) + (w[i:] if k == "put" else w[i + 1 :] if k == "cut" else [r.choice(words)] + w[i + 1 :])
            lines.append(r.choice((" ", "  ", "\t")).join(w))
        texts.append("\n".join(lines))
    return texts


def test_edit_distance():
    r = random.Random(1)
    for _ in range(3000):
        a, b = ([r.choice("ab") for _ in range(r.randint(0, 5))] for _ in range(2))
        assert one_edit_apart(a, b) == (levenshtein(a, b) <= 1)


def test_against_brute_force(spark):
    docs = spark.createDataFrame(rows([None, "", "\n \n", *corpus()]), SCHEMA).repartition(5)
    got = dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    found = {r["doc_id"]: r for r in collect(got)}
    data = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    expected = brute(data)
    assert [(found[d]["text"], found[d]["n_lines"], found[d]["n_removed"]) for d, _ in data] == expected
    assert sum(x[2] for x in expected) > 25
    assert all(r["kb"] == "k" and r["_c0"] == "c" and r["part"] == 3 for r in found.values())


def test_short_lines_and_lines_without_spaces_against_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(short_corpus())), "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: r for r in collect(dedup_lines(docs))}
    data = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    expected = brute(data)
    assert [(found[d]["text"], found[d]["n_lines"], found[d]["n_removed"]) for d, _ in data] == expected
    exact, seen = 0, set()
    for line in (x for _, t in data for x in t.split("\n")):
        exact += line in seen
        seen.add(line)
    assert sum(x[2] for x in expected) > exact + 10


def test_repeated_rows_and_null_ids(spark):
    long = "one two three four five six seven eight nine"
    data = rows([long + "\nshort", long.replace("nine", "ten"), "a b c d e\nx"])
    data += [data[2], data[2], (None, *data[0][1:]), (None, "f g h i j", *data[0][2:])]
    got = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in collect(dedup_lines(spark.createDataFrame(data, SCHEMA).repartition(4)))), key=str)
    # the earliest copy of a repeated row stays; rows without an id come last
    assert got == sorted([(0, long + "\nshort", 0), (1, "", 1), (2, "a b c d e\nx", 0), (2, "", 2), (2, "", 2), (None, "", 2), (None, "f g h i j", 0)], key=str)


def test_awkward_documents_and_empty_table(spark):
    docs = documents(spark)
    got = collect(dedup_lines(docs))
    assert len(got) == docs.count()
    assert collect(dedup_lines(docs.limit(0))) == []
    with pytest.raises(ValueError):
        dedup_lines(docs, edit_words=2)
