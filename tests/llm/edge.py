"""Awkward documents for all operators, and plain helpers."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# columns that clash with names the operators use inside
SCHEMA = "doc_id long, text string, lang string, ka long, kb string, bucket int, id string, _text string, _c0 string, owners binary, n_words string, part long, url string"


def vocabulary(seed: int, n: int = 400) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(r.randint(2, 9))) for _ in range(n)]


def sentence(r: random.Random, words: list[str], n: int) -> str:
    return " ".join(r.choice(words) for _ in range(n))


def texts(seed: int = 5) -> list[str | None]:
    r = random.Random(seed)
    words = vocabulary(seed)
    base = [sentence(r, words, r.randint(3, 160)) for _ in range(25)]
    out: list[str | None] = [None, "", " ", "\n\n\t \r\n", "one", "One", "one two", "...", "ÄÖ ü", "a" * 5000, "\x00   \U0001f600 x"]
    out += base + base[:6]  # copies
    for t in base[:12]:  # near copies
        w = t.split(" ")
        w[len(w) // 2] = r.choice(words)
        out.append(" ".join(w))
    passage = sentence(r, words, 60)
    out += [f"{sentence(r, words, 20)}\n{passage}\n{sentence(r, words, 9)}" for _ in range(5)]
    out += ["same words " * 300, "\n".join(base[:8] + base[:3]), base[0].upper(), base[1].replace(" ", "  ")]
    out.append("\n".join(sentence(r, words, 40) for _ in range(1500)))  # very long
    return out


def rows(values: list[str | None], first_id: int = 0) -> list[tuple]:
    return [(first_id + i, t, None, 7, "k", 1, "i", "other", "c", b"o", "n", 3, "http://a.com/") for i, t in enumerate(values)]


def documents(spark, values=None, repeat: bool = True, null_id: bool = True):
    data = rows(texts() if values is None else values)
    if repeat:
        data += data[11:14] + data[11:12]  # repeated rows
    if null_id:
        data += [(None, *data[15][1:]), (None, "only the row without an id has this text")]  if len(data[0]) == 2 else [(None, *data[15][1:]), (None, "only the row without an id has this text", *data[0][2:])]
    return spark.createDataFrame(data, SCHEMA)


def collect(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]
