"""Decontamination, quality rules, language ID, packing, WARC, URL filters and HTML extraction."""

import hashlib
import os
import random
import re
import time
from collections import Counter
from html import unescape

import numpy as np
import pytest
from edge import WORD, collect, documents, sentence, texts, vocabulary

from tidemark.llm import decontam, langid, packing, pages, quality, url_rules, warc
from tidemark.llm.html_tree import blocks, parse

# --- decontamination ------------------------------------------------------------------------------


def item_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shout(t):
    return re.sub("[a-z]", lambda m: m[0].upper(), t)


def leaked(data, items, window):
    windows = {}
    for i, t in items:
        w = item_words(t)
        size = min(len(w), window)
        for k in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for d, t in data:
        w, hit, ids = item_words(t), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    ids |= windows[tuple(w[k : k + size])]
        out.append((d, len(w), len(hit), len(ids - {None}), hashlib.sha256(",".join(sorted(str(i) for i in ids - {None})).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("limit", [decontam.SLICE_LIMIT, 300])
def test_decontamination_against_brute_force(spark, limit):
    docs = documents(spark)
    t = [x for x in texts() if x and len(WORD.findall(x)) > 30]
    w = t[3].split()
    items = [(1, " ".join(w[3:20])), (2, shout(t[5])), (10, " ".join(w[5:9])), (11, "..."), (12, None), (3, ""), (2, shout(t[5])), (None, " ".join(t[6].split()[:12])), (4, "never seen " * 8)]
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = collect(decontam.find_matches(docs, tests, slice_limit=limit))
    data = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    keys = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert Counter(tuple(r[k] for k in keys) for r in got) == leaked(data, items, 10)
    long = max((m for r in got for m in r["matches"]), key=lambda m: m["longest"])
    assert long["longest"] == len(item_words(t[5])) and long["item_id"] == "2"
    clean = decontam.decontaminate(docs, tests, slice_limit=limit)
    assert clean.columns == docs.columns
    bad = {k[0] for k in leaked(data, items, 10) if k[5]}  # repeated ids have one text, NULL ids are told apart below
    assert Counter((r["doc_id"], r["text"]) for r in collect(clean) if r["doc_id"] is not None) == Counter(x for x in data if x[0] is not None and x[0] not in bad)
    free = [x for x in data if x[0] is None and next(iter(leaked([x], items, 10)))[5] is False]
    assert Counter(r["text"] for r in collect(clean) if r["doc_id"] is None) == Counter(x[1] for x in free)


def verbatim(w, items, window):
    """Maximal verbatim matches (place, words) of a document's words with any item."""
    best = [0] * len(w)
    for v in items:
        for p in range(len(w)):
            for k in range(len(v)):
                n = 0
                while p + n < len(w) and k + n < len(v) and w[p + n] == v[k + n]:
                    n += 1
                if n >= window or n == len(v):
                    best[p] = max(best[p], n)
    return {(p, n) for p, n in enumerate(best) if n and not (p and best[p - 1] == n + 1)}


def test_longest_matches_and_spans_against_brute_force(spark):
    r = random.Random(6)
    words = vocabulary(3, 12)
    items = [(i, sentence(r, words[:9], r.randint(4, 30))) for i in range(12)] + [(50, "a b c d")]
    texts_ = []
    for _ in range(60):
        parts = [sentence(r, words, r.randint(0, 12))]
        for _ in range(r.randint(0, 3)):
            v = r.choice(items)[1].split()
            a = r.randrange(len(v))
            parts += [" ".join(v[a : a + r.randint(1, 30)]), sentence(r, words, r.randint(0, 3))]
        texts_.append(" ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    for limit in (decontam.SLICE_LIMIT, 200):
        got = {x["doc_id"]: x for x in collect(decontam.find_matches(docs, tests, window=6, slice_limit=limit))}
        assert any(len(x["matches"]) > 1 for x in got.values())
        for d, t in enumerate(texts_):
            x, w = got[d], item_words(t)
            for m in x["matches"]:
                v = item_words(dict((str(i), y) for i, y in items)[m["item_id"]])
                assert w[m["doc_word"] : m["doc_word"] + m["longest"]] == v[m["item_word"] : m["item_word"] + m["longest"]]
            assert sum(s["end_word"] - s["first_word"] for s in x["spans"]) == x["n_hit"]
            want = verbatim(w, [item_words(y) for _, y in items], 6)
            if limit == decontam.SLICE_LIMIT:
                found = {(m["doc_word"], m["longest"]) for m in x["matches"]}
                assert {m for m in found if m[1] >= 6} == {m for m in want if m[1] >= 6}
            assert x["longest_match"] == max([n for _, n in want], default=0)


def test_equal_words_and_shared_lines_are_not_paired(spark):
    shared = sentence(random.Random(1), vocabulary(9), 15)
    items = [(1, "w " * 1000)] + [(i, f"{shared} item {i} asks") for i in range(2, 3000)]
    docs = spark.createDataFrame([(1, "w " * 20_000), (2, "x " + "w " * 9), (3, f"{shared} and more"), (4, None)], "doc_id long, text string")
    begun = time.monotonic()
    got = {r["doc_id"]: r for r in collect(decontam.find_matches(docs, spark.createDataFrame(items, "item_id long, text string")))}
    assert time.monotonic() - begun < 30
    assert [(got[d]["n_hit"], got[d]["n_items"], got[d]["longest_match"]) for d in (1, 2, 3, 4)] == [(20_000, 1, 1000), (0, 0, 0), (15, 2998, 15), (0, 0, 0)]
    assert len(got[3]["matches"]) == 1


def test_decontamination_of_nothing(spark):
    docs, none = documents(spark), spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in collect(decontam.find_matches(docs, none)))
    assert collect(decontam.find_matches(docs.limit(0), none)) == []


# --- quality rules --------------------------------------------------------------------------------


def measures(t):
    t = t or ""
    w = WORD.findall(t)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(covered)


def test_quality_measures_and_base_rules(spark):
    docs = documents(spark)
    got = collect(quality.quality(docs))
    data = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    keys = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r["doc_id"], *(r[k] for k in keys)) for r in got) == Counter((d, *measures(t)) for d, t in data)
    for r in got:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"]) and (r["p_good"] is None) == failed
    assert collect(quality.quality(docs.limit(0))) == []


def test_estimates_find_the_accuracies_of_simulated_rules():
    r = np.random.default_rng(3)
    good = r.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.6])
    votes = np.where(r.random((20_000, 5)) < right, np.where(good, 1, 2)[:, None], np.where(good, 2, 1)[:, None])
    votes[r.random(votes.shape) < 0.2] = 0
    patterns, count = np.unique(votes, axis=0, return_counts=True)
    e = quality.fit(patterns, count.astype(float))
    assert np.abs(e.accuracy() - right).max() < 0.08
    assert ((e.posterior(votes) >= 0.5) == good).mean() > 0.93
    assert quality.fit(np.zeros((0, 5), int), np.zeros(0)).prior == quality.PRIOR


# --- language ID ----------------------------------------------------------------------------------

STEMS = {"aa": "the ing tion ness over and with".split(), "bb": "der ung keit schaft und mit".split(), "cc": "que aux ment elle les dans".split()}


def speak(r, lang, n):
    return " ".join("".join(r.choice(STEMS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_language_id_held_out_and_code_switched(spark):
    r = random.Random(4)
    train = [(i, speak(r, lang, 40), lang, 1) for i, lang in enumerate(list(STEMS) * 40)]
    test = [(i, speak(r, lang, r.randint(3, 60)), lang, 2) for i, lang in enumerate(list(STEMS) * 60)]
    test += [(900, speak(r, "aa", 30) + " " + speak(r, "bb", 20), "aa", 2), (901, None, "aa", 2), (902, " 12 --- ", "bb", 2), (903, speak(r, "cc", 60_000), "cc", 2)]
    ddl = "doc_id long, text string, lang string, score int"
    labelled, docs = spark.createDataFrame(train, ddl), spark.createDataFrame(test, ddl)
    got = {x["doc_id"]: x for x in collect(langid.identify(docs, labelled, with_spans=True))}
    plain = [t for t in test if t[0] < 900]
    assert sum(got[t[0]]["lang_pred"] == t[2] for t in plain) >= 0.98 * len(plain)
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert (got[901]["lang_pred"], got[901]["score"]) == ("und", 0.0) and got[902]["lang_pred"] == "und"
    spans = got[900]["spans"]
    assert [s["lang"] for s in spans] == ["aa", "bb"] and abs(spans[0]["end_word"] - 30) <= 2
    assert got[903]["lang_pred"] == "cc" and got[903]["spans"][-1]["end_word"] == 60_000
    same = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in collect(langid.identify(docs.repartition(7), labelled))}
    assert same.keys() == got.keys() and all(same[k][0] == got[k]["lang_pred"] for k in same)


def test_language_id_without_labels_or_rows(spark):
    docs = documents(spark)
    assert {x["lang_pred"] for x in collect(langid.identify(docs, docs))} == {"und"}
    assert collect(langid.identify(docs.limit(0), docs)) == []
    full = langid.identify(docs, docs, id_col=None)
    assert full.columns == [*docs.columns, "lang_pred", "score"]


def test_forward_backward_against_enumeration():
    r = np.random.default_rng(1)
    e, step, begin = r.normal(size=(1, 4, 3)), r.normal(size=(3, 3)), r.normal(size=3)
    total, marginal = 0.0, np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        w = np.exp(begin[path[0]] + sum(e[0, t, path[t]] for t in range(4)) + sum(step[a, b] for a, b in zip(path, path[1:])))
        total += w
        for t in range(4):
            marginal[t, path[t]] += w
    padded = np.concatenate([e, np.zeros((1, 2, 3))], axis=1)
    gamma = langid.forward_backward(padded, np.array([4]), step, begin)[0]
    assert np.allclose(gamma[0, :4], marginal / total)


# --- packing --------------------------------------------------------------------------------------


def test_packing_places_every_token_once(spark):
    docs = documents(spark)
    lengths = (16, 64, 128)
    got = collect(packing.pack(docs, lengths=lengths, shard_tokens=20_000, with_tokens=True))
    with open(packing.VOCABULARY, "rb") as f:
        encode = packing.load_encoding(f.read()).encode_ordinary
    expected = Counter()
    for r in docs.select("doc_id", "text").collect():
        tokens = encode(r["text"] or "")
        for s in range(0, len(tokens), 128):
            expected[(r["doc_id"], s, tuple(tokens[s : s + 128]))] += 1
    assert Counter((r["doc_id"], r["start"], tuple(r["tokens"])) for r in got) == expected
    bins = {}
    for r in got:
        bins.setdefault((r["bin_id"], r["bin_length"]), []).append((r["offset"], r["n_tokens"]))
    assert len(bins) == len({b for b, _ in bins})
    for (_, size), parts in bins.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert size in lengths and at <= size and not any(x for x in lengths if at <= x < size)
    assert sum(n for p in bins.values() for _, n in p) / sum(s for _, s in bins) > 0.93
    made = collect(packing.sequences(packing.pack(docs.limit(20), lengths=lengths, with_tokens=True)))
    assert all(len(r["tokens"]) <= r["bin_length"] for r in made)
    assert collect(packing.pack(docs.limit(0))) == []


def test_best_fit_and_least_cost():
    # the piece of 3 goes into the fullest bin that takes it
    b, offset, size = packing.pack_pieces([(7, 0), (6, 1), (3, 2), (1, 3)], (10,), fill=0.1)
    assert b[2] == b[0] and offset[2] == 7 and b[3] == b[1] and size == [10, 10]
    assert packing.cheapest_length(100, 0, (128, 1024), overhead=0) == 128  # nothing else to fill the long bin
    assert packing.cheapest_length(600, 100_000, (1024, 4096), overhead=64) == 4096
    assert packing.cheapest_length(1020, 100_000, (1024, 4096), overhead=0) == 1024
    with pytest.raises(ValueError):
        packing.pack(None, lengths=())


# --- WARC -----------------------------------------------------------------------------------------


def page_rows():
    r = random.Random(8)
    words = vocabulary(8)
    out = [(i, f"http://h{i % 3}.com/{i}", f"<p>{sentence(r, words, r.randint(1, 400))}</p>", "x", 5) for i in range(60)]
    out += [(60, None, None, "x", 5), (None, "u", "", "x", 5), (61, "http://é.com/", "ü" * 30_000, "x", 5), out[3], out[3], (5, "http://h2.com/5", "other", "x", 5)]
    return out


PAGES = "page_id long, url string, html string, file string, offset int"


def test_warc_files_round_trip(spark, tmp_path):
    p = spark.createDataFrame(page_rows(), PAGES)
    place = {(r["file"], r["offset"]): r for r in collect(warc.layout(p, per_file=20))}
    for r in warc.warc_files(p, per_file=20).collect():
        (tmp_path / f"{r['file']}.warc").write_bytes(bytes(r["content"]))
    read = collect(warc.read_warc(spark, str(tmp_path)))
    assert Counter((int(r["file"].rsplit("/", 1)[1][:-5]), r["offset"], r["length"], r["uri"]) for r in read) == Counter((f, o, r["length"], r["url"] or "") for (f, o), r in place.items())
    assert {bytes(r["payload"]).decode() for r in read} == {r[2] or "" for r in page_rows()}
    assert sum(r["copies"] for r in place.values()) == len(page_rows())


def test_audit_finds_exactly_the_differences(spark):
    p = spark.createDataFrame(page_rows(), PAGES)
    a = warc.layout(p, per_file=20).select("file", "offset", "length", "digest").cache()
    recs = sorted(collect(a), key=lambda r: (r["file"], r["offset"]))
    changed, lost = {(r["file"], r["offset"]) for r in recs[::9]}, {(r["file"], r["offset"]) for r in recs[4::17]}
    b = [(r["file"], r["offset"], r["length"], "0" * 64 if (r["file"], r["offset"]) in changed else r["digest"]) for r in recs if (r["file"], r["offset"]) not in lost]
    b += [(99, 0, 5, "f" * 64)]
    found = collect(warc.audit(a, spark.createDataFrame(b, "file long, offset long, length long, digest string"), range_bytes=2000, fan=2))
    kinds = {(r["file"], r["offset"]): r["kind"] for r in found}
    assert kinds == {**{k: "changed" for k in changed - lost}, **{k: "missing" for k in lost}, (99, 0): "extra"}
    assert collect(warc.audit(a, a)) == [] and collect(warc.audit(a.limit(0), a.limit(0))) == []
    whole = collect(warc.audit(a, a.limit(0)))
    assert {r["kind"] for r in whole} == {"missing"} and len(whole) == len(recs)


# --- URL filters ----------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "http://example.com", "http://example.com/", "HTTP://WWW.Example.COM/en/x?q=/es/", "https://a.b.example.com/en/1#top", "http://notexample.com/en/",
    "http://x.net/es/1", "http://x.net/ES/1", "http://x.net/fr", "http://net/fr/", "http://foo.org/a.example.com/en/", "http://spam-farm.org/", "http://www.spam-farm.example.com/en/z",
    "http://u@example.com:80/en/", "a://b://com/", "http://x.org/casinos/", "http://x.org/online_casino?x", "http://example.com?/en/", "http://ünï.com/\n/x", "http://example.com/en/" + "y" * 100_000,
]


def url_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    fit = max(((len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    words = "spam.farm|casino|porn|xxx|viagra|payday.loans|free.download|wp.login|phishing|malware".replace(".", "[^a-z0-9]")
    own = "block" if re.search(rf"(?i)(^|[^a-z0-9])({words})($|[^a-z0-9])", host + path) else "allow"
    return host, path, fit[1] if fit else None, fit[2] if fit else own


def test_url_filters_against_brute_force(spark):
    data = [(i, u, "a", 1) for i, u in enumerate(URLS)] + [(4, URLS[4], "a", 1), (None, URLS[7], "a", 1)]
    p = spark.createDataFrame(data, "page_id long, url string, host string, token int")
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in collect(url_rules.judge(p)))
    assert got == Counter((i, *url_verdict(u)) for i, u, *_ in data)
    free = url_rules.UrlRule("block", r"/\d{3,}$", (), "long numbers")
    assert [r["pattern_rules"] for r in collect(url_rules.judge(spark.createDataFrame([(1, "http://q.org/1234")], "page_id long, url string"), host_rules=(), other_rules=(free,)))] == [["long numbers"]]
    assert collect(url_rules.judge(p.limit(0))) == []


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([(["com", "example", "en"],)] * 5 + [(["com", "example"],)] * 3 + [(["com"],)], "tokens array<string>")
    filed = dict((r.text, t) for t, r in url_rules.rule_index(urls, url_rules.HOST_RULES))
    assert filed["com/"] == "com" and filed["example.com/en/"] == "en" and filed["www.example.com/en/"] == "www"


# --- HTML -----------------------------------------------------------------------------------------


def body_text(source):
    return " | ".join(blocks(parse(source), lambda _: False))


@pytest.mark.parametrize("source,expected", [
    ("<p>a<p>b<b>c</p>d", "a | bc | d"),
    ("<p>1 &lt; 2 &amp; &eacute;&#33; <!-- x > y --> z</p>", "1 < 2 & é! z"),
    ("<script>var t='</p>';</script ><p title='a > b'>x</p><style>p{}</style>", "x"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a | b | c | d"),
    ("a < b <3 c<br>d", "a < b <3 c d"),
    ("<table><tr><td>1<td>2<tr><th>3</table>", "1 | 2 | 3"),
    ("<p>cut <a href='x", "cut"),
    ("<!-- never closed <p>x", ""),
    ("<div>" * 3000 + "deep", "deep"),
    ("<p>un\n\t closed   <i>tags", "un closed tags"),
    ("x<!>y<?php ?>z", "xyz"),
])
def test_html_reader(source, expected):
    assert body_text(source) == expected


def site(host, n, seed, article=True):
    r = random.Random(seed)
    words = vocabulary(seed)
    out = []
    for i in range(n):
        h, a, b = (sentence(r, words, k) for k in (4, 12, 15))
        main = f"<h1>{h}</h1><p>{a}<p><b>{b}</p>"
        main = f"<article>{main}</article>" if article else f"<div>{main}</div>"
        out.append((f"http://{host}/{i}", f"<html><body><div class=x><a href=/>home {host}</a></div>{main}<section>about {host}</section></body></html>", f"{h} {a} {b}"))
    return out


@pytest.mark.parametrize("limit", [pages.SEND_LIMIT, 0])
def test_templates_go_and_articles_stay(spark, limit):
    data = site("a.com", 8, 1) + site("b.com", 8, 2, article=False) + [site("c.com", 1, 3)[0]] * 9
    extra = [("http://d.com/", "<nav>menu</nav><header>top</header><p>text</p><div class='ads'>buy</div><form>f</form><footer>end</footer>", "text"), (None, None, ""), ("x", "", ""), (None, "plain", "plain")]
    extra.append(("http://e.com/", "<article><header><h1>T</h1></header><p>x " + "long " * 200_000 + "</p><div class='comments'>c</div></article><p>out</p>", "T x " + ("long " * 200_000).strip() + " out"))
    rows_ = [(i, u, h, "t", 3, t) for i, (u, h, t) in enumerate(data + extra)]
    p = spark.createDataFrame(rows_, "page_id long, url string, html string, text string, templates int, expected string")
    got = {r["page_id"]: r for r in collect(pages.main_text(p.drop("expected"), send_limit=limit))}
    for i, u, _, _, _, t in rows_:
        if u and "c.com" in u:  # copies of one page are no template of its site
            assert t in got[i]["text"]
        else:
            assert (got[i]["text"], got[i]["url"]) == (t, u), i
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert collect(pages.main_text(p.limit(0))) == []


def test_templates_are_counted_by_host_and_page(spark):
    p = spark.createDataFrame([(u, h) for u, h, _ in site("a.com", 6, 1, article=False) + site("b.com", 1, 1, article=False) * 5], "url string, html string")
    found = {r["template"] for r in collect(pages.site_templates(p))}
    root = parse(site("a.com", 1, 1, article=False)[0][1])
    shared = [x for x in pages.walk(root) if x.tag in ("section",) or "x" in x.words]
    assert {pages.template_hash("a.com", x) for x in shared} <= found
    assert not {pages.template_hash("b.com", x) for x in pages.walk(root)} & found


def counted_templates(data, share=0.5):
    """Plain counts over (url, html): template hashes by host, place and page."""
    seen, pieces = {}, {}
    for u, h in data:
        host, root = pages.host_of(u), parse(h or "")
        for x in pages.walk(root):
            if pages.countable(x):
                seen.setdefault((host, x.place), {}).setdefault(pages.template_hash(host, x), set()).add(pages._body(root))
                pieces[(host, x.place)] = x.tag in pages.PIECES
    out = set()
    for key, of in seen.items():
        n_pages, n = len(set().union(*of.values())), sum(len(v) for v in of.values())
        again = sum(len(v) for v in of.values() if len(v) > 1)
        for t, v in of.items():
            if len(v) > 1 and (len(v) >= share * n_pages or not pieces[key] and again >= share * n):
                out.add(t)
    return out


def planted_site(r, host, n, article):
    """Pages with a fixed notice, a menu and an advert drawn from some versions, and section menus on a twentieth of them."""
    words = vocabulary(17)
    say = lambda k: sentence(r, words, k)
    menus = ["<div><ul>" + "".join(f"<li><a href=/{k}>{say(2)}</a></li>" for k in range(5)) + "</ul></div>" for _ in range(6)]
    adverts, notice = [f"<section><p>{say(9)}</p><p>{say(3)}</p></section>" for _ in range(8)], f"<div class=n><p>{say(12)}</p></div>"
    section = f"<div class=s><b>{say(3)}</b><ul><li>{say(1)}</li><li>{say(1)}</li></ul></div>"
    out = []
    for i in range(n):
        title, lines = say(4), [say(r.randint(15, 40)) for _ in range(r.randint(2, 5))]
        body = f"<h1>{title}</h1>" + "".join(f"<p>{x}</p>" for x in lines)
        body = f"<article>{body}</article>" if article else f"<div class=c>{body}</div>"
        html = f"<html><body>{r.choice(menus)}{notice}{section if i % 20 == 3 else ''}{body}{r.choice(adverts)}</body></html>"
        out.append((f"http://{host}/{i}", html, " ".join([title, *lines])))
    return out


def test_templates_alone_remove_what_a_site_repeats(spark):
    r = random.Random(12)
    data = planted_site(r, "small.com", 60, True) + planted_site(r, "div.com", 60, False) + planted_site(r, "large.com", 600, False)
    p = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(data)], "page_id long, url string, html string")
    found = {x["template"] for x in collect(pages.site_templates(p))}
    assert found == counted_templates([(u, h) for u, h, _ in data])
    for limit in (pages.SEND_LIMIT, 0):
        got = {x["page_id"]: x["text"] for x in collect(pages.main_text(p, send_limit=limit, by_words=False))}
        assert sum(got[i] == t for i, (_, _, t) in enumerate(data)) >= 0.99 * len(data)


def test_recurring_headings_items_and_lines_of_articles_stay(spark):
    r = random.Random(6)
    words = vocabulary(6)
    say = lambda n: sentence(r, words, n)
    data = []
    for i in range(8):
        teaser, a, b = say(6), say(40), say(50)
        # the text stands beside a teaser article
        data.append((f"http://t.com/{i}", f"<article><p>{teaser}</p></article><div>{a}</div><section>about t</section>", f"{teaser} {a}"))
        # links that come back go from an article, other lines stay
        data.append((f"http://in.com/{i}", f"<article><h1>{teaser}</h1><p>{a}</p><p><a href=/>read more on in.com</a></p><p>{b}</p><p>Les.</p></article>", f"{teaser} {a} {b} Les."))
        recipe = f"<h1>{teaser}</h1><h2>Ingredients</h2><ul><li>salt</li><li>{say(3)}</li></ul><h2>Method</h2><p>{b}</p>"
        want = f"{teaser} Ingredients salt {re.findall('<li>(.*?)</li>', recipe)[1]} Method {b}"
        data.append((f"http://cook.com/{i}", f"<div><a href=/>all recipes</a></div><article>{recipe}</article>", want))
    for i in range(5):
        for j in range(5):  # one title on several pages
            a = say(30)
            data.append((f"http://same.com/{i}{j}", f"<article><h1>title {i}</h1><p>{a}</p><table><tr><td>yes<td>no</table></article>", f"title {i} {a} yes no"))
    shared = [say(30) for _ in range(9)]
    for i in range(8):  # near copies of an article: a changed paragraph each
        own = [*shared[:i], say(30), *shared[i + 1 :]]
        data.append((f"http://copy.com/{i}", "<main>" + "".join(f"<p>{p}</p>" for p in own) + "</main>", " ".join(own)))
    a, b = say(5), say(40)  # nothing to count
    data.append(("http://one.com/", f"<article>{a}</article><div>{b}</div>", f"{a} {b}"))
    p = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(data)], "page_id long, url string, html string")
    for limit in (pages.SEND_LIMIT, 0):
        got = {x["page_id"]: x["text"] for x in collect(pages.main_text(p, send_limit=limit))}
        assert [got[i] for i in range(len(data))] == [t for *_, t in data]


def plain_article(html):
    """The text of the one article of a generated page: blocks joined by one space."""
    inside = re.search(r"<article>(.*?)(</article>|$)", html, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", inside.replace("<br>", " "))
    parts = [" ".join(unescape(re.sub(r"</?b>", "", x)).split()) for x in parts]
    return " ".join(x for x in parts if x)


def test_pages_of_the_test_data_give_their_articles(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("test data not present")
    table = spark.read.parquet(f"{sf}/pages.parquet")
    got = {x["page_id"]: x["text"] for x in collect(pages.main_text(table))}
    want = {x["page_id"]: plain_article(x["html"]) for x in table.select("page_id", "html").collect()}
    assert got == want


def test_language_sample_counts_copies_of_a_text_once(spark):
    r = random.Random(9)
    data = [("the same text over and over", "aa")] * 6000 + [(speak(r, "aa", 12), "aa") for _ in range(600)] + [(speak(r, "bb", 12), "bb") for _ in range(30)]
    sample = Counter(lang for lang, _ in langid.sample_labelled(spark.createDataFrame(data, "text string, lang string"), "text", "lang", texts=200))
    assert sample["aa"] > 130 and sample["bb"] == 30


def test_urls_without_a_host_meet_the_pattern_rules(spark):
    data = [(1, "file:///casino/x"), (2, "file:///home/x"), (3, "file://")]
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in collect(url_rules.judge(spark.createDataFrame(data, "page_id long, url string")))}
    assert got == {(i, *url_verdict(u)) for i, u in data} and any(x[-1] == "block" for x in got)


def test_decontamination_carries_one_slice_at_a_time(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "v w x y z")], "doc_id long, text string")
    tests = spark.createDataFrame([(i, f"item{i} " * 40) for i in range(20)] + [(99, "b c d")], "item_id long, text string")
    found = decontam.find_matches(docs, tests, slice_limit=500)
    assert found._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1  # the summary
    assert {r["doc_id"]: r["contaminated"] for r in collect(found)} == {1: True, 2: False}
