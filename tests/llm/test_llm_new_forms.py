"""Periodic runs, fill-in-the-middle and token files against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from edge import WORD, collect, documents, texts
from tokenizers import Tokenizer

from tidemark.llm import queries, runs, token_file
from tidemark.llm.fim import ERROR, RankIndex, boundaries, fill_in_middle, restored
from tidemark.llm.tables import scratch_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

# --- periodic runs --------------------------------------------------------------------------------


def plain_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def test_runs_of_many_small_texts():
    r = random.Random(1)
    for _ in range(400):
        made = []
        for _ in range(r.randint(1, 6)):
            k, n = r.choice([1, 2, 2, 3, 5, 30]), r.choice([0, 1, 5, 20, 60, 120])
            w = [r.randrange(k) for _ in range(n)]
            if n and r.random() < 0.5:
                a = r.randrange(n)
                p = 1 + (n - a) // (3 + r.randrange(8))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            made.append(w)
        least = r.choice([1, 2, 4, 12])
        row = np.repeat(np.arange(len(made)), [len(w) for w in made])
        first = np.concatenate([[0], np.cumsum([len(w) for w in made])])
        got = runs.runs_of(runs.number_words(np.array([x for w in made for x in w], np.uint64), row), first[row + 1], least)
        want = [(s + int(first[k]), n, q) for k, w in enumerate(made) for s, n, q in plain_runs(w, least)]
        assert [tuple(x) for x in got.tolist()] == sorted(want, key=lambda x: (x[0], x[2]))


def test_long_periodic_texts_take_no_square_time():
    n = 200_000
    for w, want in ((np.zeros(n, np.uint64), [(0, n, 1)]), (np.arange(n, dtype=np.uint64) % 700, [(0, n, 700)])):
        assert [tuple(x) for x in runs.runs_of(runs.number_words(w, np.zeros(n, int)), np.full(n, n)).tolist()] == want


def test_periodic_runs_of_awkward_documents(spark):
    more = ["x " * 40, "a b c " * 7 + "a", "\n".join(["one two three"] * 30), "é ü " * 9 + "z", ("p q r s " * 4) * 3 + "t u v"]
    docs = documents(spark, [*texts(), *more])
    got = Counter((r["doc_id"], r["n_words"], tuple((x["start"], x["length"], x["period"]) for x in r["runs"]), r["collapsed"]) for r in collect(runs.periodic_runs(docs)))
    want = Counter()
    for d, t in docs.select("doc_id", "text").collect():
        w = WORD.findall(t or "")
        found = plain_runs(w) if len(w) < 5000 else []
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        want[(d, len(w), tuple(sorted(found, key=lambda x: (x[0], x[2]))), " ".join(x for i, x in enumerate(w) if i not in gone))] += 1
    assert got == want and any(k[2] for k in got)
    assert collect(runs.periodic_runs(docs.limit(0))) == []


def test_planted_periods_as_the_contract_says(spark):
    docs = documents(spark).where("doc_id is null or doc_id < 60")
    got = Counter((r["doc_id"], tuple(WORD.findall(r["text"] or ""))) for r in collect(queries._planted_periods(docs)))
    want, changed = Counter(), 0
    for d, t in docs.select("doc_id", "text").collect():
        w = WORD.findall(t or "")
        h, n = zlib.crc32(str(d).encode()), len(w)
        if d is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            changed += 1
        want[(d, tuple(w))] += 1
    assert got == want and changed


# --- fill in the middle ---------------------------------------------------------------------------


@pytest.mark.parametrize("error", [0, 1, ERROR])
def test_rank_index_is_exact_and_bounded(error):
    r = np.random.default_rng(2)
    for gaps in ([], [5], [1] * 1000, r.integers(1, 400, 5000), np.r_[np.ones(300, int), 100_000, np.full(300, 77), r.integers(1, 9, 300)]):
        offsets = np.concatenate([[0], np.cumsum(np.array(gaps, np.int64))])
        index = RankIndex.fit(offsets, error)
        assert [index.locate(k) for k in range(len(offsets))] == offsets.tolist()
        assert np.abs(index.residual).max() <= error + 1
    assert len(RankIndex.fit(np.arange(0, 70_000, 7)).first) == 1


def plain_fim(d, t, seed="7", rate=100, spm=50):
    t = t or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return d, len(u), "plain", None, None, t
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h4 % 100 < spm:
        return d, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return d, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_of_awkward_documents(spark):
    more = ["\n", "\n\n\n", "a\r\nb\r\nc", "x<P>y\nz", "<S>", "a\n<M", "<P\n>S<\nM>", "no break at the end\nlast", "ends so\n", "\U0001f600\n\U0001f600é\n" * 50, "<S\n<S\n<P\n<M\n" * 3]
    docs = documents(spark, [*texts(), *more])
    data = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    for rate, spm in ((100, 50), (40, 0), (100, 100), (0, 50)):
        got = collect(fill_in_middle(docs, rate=rate, spm_rate=spm).withColumn("back", restored()))
        assert Counter(tuple(r[k] for k in names) for r in got) == Counter(plain_fim(d, t, "7", rate, spm) for d, t in data)
        assert Counter((r["doc_id"], r["back"]) for r in got) == Counter((d, t or "") for d, t in data)
        assert all((r["n_segments"] is None) == (r["form"] == "plain") for r in got)
    assert collect(fill_in_middle(docs.limit(0))) == []


def test_fill_in_middle_by_characters(spark):
    docs = documents(spark)
    for r in collect(fill_in_middle(docs, unit="char").withColumn("back", restored())):
        assert r["n"] == len(r["back"])
    assert boundaries("a\nb").tolist() == [0, 2, 3] and boundaries("", "char").tolist() == [0]
    with pytest.raises(ValueError):
        fill_in_middle(docs, unit="word")


# --- token files ----------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [1, 3, 7, 8, 13, 16, 17, 24, 31, 32])
def test_packing_of_bits(width):
    r = np.random.default_rng(width)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = r.integers(0, 1 << width, n)
        data = token_file.pack_ids(ids, width)
        assert len(data) == -(-n // 64) * 8 * width and token_file.unpack_ids(data, width, n).tolist() == ids.tolist()
    with pytest.raises(ValueError):
        token_file.pack_ids(np.array([1 << width]), width)
    assert [token_file.bits_for(x) for x in (0, 1, 2, 255, 256, 49_407)] == [1, 1, 2, 8, 9, 16]


def in_order(docs):
    data = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    return sorted(data, key=lambda x: (x[0] is None, x[0]))


ODD = ["don't we'll I'M x'd", "1234 5,6 ½ ①", "a\x0bb\x0cc\x1cd\x85e\xa0f　g", "ǅ İ ς ΣΑΣ", "é ́x y ́", "<|endoftext|> <|startoftext|>x", "½½ ²x", "中文 字", "a‍b", "!!!??  --", "\x00"]


def test_token_files_hold_all_ids_in_order(spark):
    docs = documents(spark, [*texts(), *ODD]).repartition(5)
    folder = scratch_path(spark, "ids")
    manifest = token_file.write_token_ids(docs, folder, TOKENIZER, 1, file_ids=4000, block_ids=256)
    assert manifest.count() > 8
    t = Tokenizer.from_file(TOKENIZER)
    got = collect(token_file.read_documents(manifest))
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    want = {}
    for d, text in in_order(docs):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert {d: sorted((r["n_tokens"], r["ids_crc32"]) for r in x) for d, x in by_id.items()} == {d: sorted(x) for d, x in want.items()}
    # places go on without a gap, ids ascend
    at, last = 0, None
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and (last is None or r["doc_id"] is None or r["doc_id"] >= last)
        at, last = at + r["n_tokens"], r["doc_id"]
    # random access: ranges over blocks and files, and single documents
    whole = [x for _, text in in_order(docs.where("doc_id is not null").dropDuplicates(["doc_id"])) for x in [*t.encode(text or "", add_special_tokens=False).ids, 1]]
    alone = token_file.write_token_ids(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), scratch_path(spark, "ids"), TOKENIZER, 1, file_ids=4000, block_ids=256)
    ranges = [(0, 1), (255, 257), (3990, 4300), (len(whole) - 3, len(whole) + 9), (1000, 9000)]
    pieces = sorted((r["start"], r["at"], r["ids"]) for r in collect(token_file.read_ranges(alone, ranges)))
    for start, stop in ranges:
        assert [x for s, _, ids in pieces if s == start for x in ids] == whole[start:stop]
    path = alone.orderBy("part", "number").first()["path"]
    f = token_file.TokenFile(path)
    assert f.width == 16 and f.document(0).tolist() == whole[: int(f.ends[0])] and f.ids(5, 5).tolist() == []


def test_whole_texts_and_words_give_the_same_ids(spark):
    r = random.Random(8)
    marks = [" ", "\n", "\x0b", "\x0c", "\t", "\r", "\x1c", "\x85", "\xa0", " ", "'s", "'", "a", "B", "é", "é", "́", "7", "½", "-", "ǅ", "İ", "Σ", "ß", "中", "<|endoftext|>", "<|", "\U0001f600", "ͅ", "ﬁ", "\x02"]
    values = ["".join(r.choice(marks) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    with open(TOKENIZER, encoding="utf-8") as f:
        content = f.read()
    letters = [c for c in map(chr, range(0x41, 0x260)) if c.isprintable()]
    values += ["".join(r.choice([*letters, " ", "́", "."]) for _ in range(30)) for _ in range(2000)]
    values += [" ".join(c + x for c in letters for x in ("", "a", "A.", "!?", "́", "'s", ")-")), " ".join("x" + c for c in letters)]
    data = pa.array([*values, None, "", " \n"])
    a, n = token_file._Encoder(content, 1, True).encode(data)
    b, m = token_file._Encoder(content, 1, False).encode(data)
    assert a.tolist() == b.tolist() and n.tolist() == m.tolist()
    plain = pa.array([v.replace("\x02", "") for v in values])  # many words encoded together
    assert token_file._Encoder(content, 1, True).encode(plain)[0].tolist() == token_file._Encoder(content, 1, False).encode(plain)[0].tolist()


def test_token_files_of_nothing_and_damage(spark, tmp_path):
    docs = documents(spark)
    none = token_file.write_token_ids(docs.limit(0), scratch_path(spark, "ids"), TOKENIZER, 1)
    assert none.count() == 0 and collect(token_file.read_documents(none)) == []
    text_ids = docs.selectExpr("cast(doc_id as string) as doc_id", "text").where("length(text) < 100")
    got = collect(token_file.read_documents(token_file.write_token_ids(text_ids, scratch_path(spark, "ids"), TOKENIZER, 1), "string"))
    assert sorted((r["doc_id"] or "~", r["n_tokens"]) for r in got) and {r["doc_id"] for r in got} == {r[0] for r in text_ids.select("doc_id").collect()}
    path = str(tmp_path / "x.bin")
    w = token_file.TokenFileWriter(path, 5, 64)
    w.close()
    assert token_file.TokenFile(path).n_ids == 0
    data = open(path, "rb").read()
    for broken in (data[:-1], data[:20], data[:8] + bytes([data[8] ^ 1]) + data[9:]):
        open(path, "wb").write(broken)
        with pytest.raises(ValueError):
            token_file.TokenFile(path)


def test_a_file_of_a_lost_attempt_is_not_read(spark):
    docs = documents(spark).where("doc_id < 20").dropDuplicates(["doc_id"])
    folder = scratch_path(spark, "ids")
    manifest = token_file.write_token_ids(docs, folder, TOKENIZER, 1)
    lost = token_file.TokenFileWriter(token_file.join(folder, "ids-000000-0000-lost.bin"), 16)
    lost.close()
    assert len(collect(token_file.read_documents(token_file.read_manifest(spark, folder)))) == docs.count() == len(collect(token_file.read_documents(manifest)))
