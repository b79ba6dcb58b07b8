"""Passages, token counts, WARC revisits, HTML extraction and the pipeline against brute force."""

import itertools
import random
import time
from collections import Counter

import numpy as np
import pytest

from latticegraph.llm import html, substring, tokencount, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, source string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "s") for i, t in rows], SCHEMA).repartition(3)


def words(rng, n):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(n))


# ---------------------------------------------------------------- passages


def brute_windows(values, window):
    """All (c, l, r) by definition: maximal boxes of stretches of at least window places with their minimum at c."""
    out = set()
    for c in range(len(values)):
        l = r = c
        while l > 0 and values[l - 1] > values[c]:
            l -= 1
        while r + 1 < len(values) and values[r + 1] > values[c]:
            r += 1
        if r - l + 1 >= window:
            out.add((c, l, r))
    return out


def test_compact_windows_by_definition():
    rng = np.random.default_rng(4)
    sh = rng.integers(1, 2**63, 300, dtype=np.uint64)
    sh[[40, 41, 150]] = 0
    value, c, left, right = substring.compact_windows(sh, 1, 10)
    from latticegraph.llm.common import mix

    v = mix(sh ^ np.uint64(0x9E3779B97F4A7C15))
    want, at = set(), 0
    for stretch in (range(0, 40), range(42, 150), range(151, 300)):
        own = (v[list(stretch)] | np.uint64(1 << 63)).tolist()
        want |= {(a + stretch.start, b + stretch.start, d + stretch.start) for a, b, d in brute_windows(own, 10)}
    assert set(zip(c.tolist(), left.tolist(), right.tolist())) == want


def test_passages_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(8)
    rows = [(k, words(rng, 300)) for k in range(30)]
    exact, near = words(rng, 80), words(rng, 150).split()
    for k in range(100, 112):
        rows.append((k, f"{words(rng, 60)} {exact} {words(rng, 60)}"))
    changed = list(near)
    for j in (40, 100):
        changed[j] = "other"
    rows += [(200, " ".join([*words(rng, 70).split(), *near])), (201, " ".join([*changed, *words(rng, 20).split()])), (300, None), (301, ""), (302, words(rng, 49)), (303, "a " * 500)]
    got = substring.duplicate_passages(table(spark, rows)).collect()
    assert {r.doc_id for r in got} == {*range(101, 112), 201}
    for r in got:
        t, s = dict(rows)[r.doc_id].split(), dict(rows)[r.source_doc_id].split()
        own, other = t[r.start_word : r.end_word], s[r.source_start : r.source_end]
        assert len(own) == len(other) >= 50 and r.similarity >= 0.8
        assert own[0] == other[0] and own[-1] == other[-1]
        if r.doc_id < 200:
            assert r.source_doc_id in (100, r.doc_id - 1) and own == exact.split()
    assert {r.doc_id for r in got if r.source_doc_id == 100} == set(range(101, 112))
    assert substring.duplicate_passages(table(spark, rows).limit(0)).count() == 0


def test_passages_with_ties_and_nulls(spark):
    rng = random.Random(3)
    p = words(rng, 90)
    rows = [(5, p), (5, p), (None, p + " tail"), (9, p)]
    got = {r.doc_id for r in substring.duplicate_passages(table(spark, rows)).collect()}
    assert got == {5, 9}


# ---------------------------------------------------------------- token counts


def brute_tokens(word, pieces, byte_score):
    """Best cut over all cuts; ties as documented (the last piece is shortest)."""
    text, best = tokencount.MARK + word, {0: (0.0, 0)}
    for end in range(1, len(text) + 1):
        options = []
        for start in range(end - 1, -1, -1):
            if text[start:end] in pieces:
                options.append((best[start][0] + pieces[text[start:end]], best[start][1] + 1))
        width = len(text[end - 1].encode())
        if text[end - 1] not in pieces:
            options.append((best[end - 1][0] + width * byte_score, best[end - 1][1] + width))
        best[end] = max(options, key=lambda o: o[0])
    return best[len(text)][1]


def test_token_counts(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    trie = tokencount.CountingTrie(tokencount.load_pieces(path))
    rng = random.Random(6)
    rows = [(k, " ".join("".join(rng.choices("thearing🙂漢é\x01", k=rng.randint(1, 14))) for _ in range(40))) for k in range(20)]
    rows += [(100, None), (101, ""), (102, " \n"), (103, "the thing the"), (103, "the thing the"), (104, "x" * 5000)]
    for nodes in (tokencount.NODES, 50):
        got = sorted(tuple(r) for r in tokencount.token_counts(table(spark, rows), path, nodes=nodes).collect())
        want = sorted((i, len((t or "").split()), sum(brute_tokens(w, trie.pieces, trie.byte_score) for w in (t or "").split(" \n") and (t or "").split())) for i, t in rows)
        assert got == want
    assert tokencount.token_counts(table(spark, rows).limit(0), path).count() == 0


def test_levels_count_like_one_node_at_a_time():
    pieces = {"▁": -2.0, "a": -1.0, "b": -1.5, "ab": -1.2, "▁a": -1.1, "ba": -0.9, "aba": -3.3, "aab": -1.7, "漢b": -2.5}
    rng = random.Random(9)
    some = sorted({tokencount.MARK + "".join(rng.choices("abc漢🙂é\U0010ffff", k=rng.randint(0, 9))) for _ in range(3000)})
    trie = tokencount.CountingTrie(pieces)
    assert tokencount.LevelTrie(pieces).count(some).tolist() == [trie.insert(w) for w in some]
    assert tokencount.LevelTrie(pieces).count([]).tolist() == []
    counter = tokencount.Counter(pieces, 10)
    for w in some[:40]:
        assert counter.counts([w[1:].encode(), b"", (w[1:] + " x").encode()])[1][0] == (trie.insert(w) if len(w) > 1 else 0)


def test_every_cut_of_small_words():
    pieces = {"▁": -2.0, "a": -1.0, "b": -1.5, "ab": -1.2, "▁a": -1.1, "ba": -0.9, "aba": -3.3}
    trie = tokencount.CountingTrie(pieces)
    for n in range(1, 7):
        for w in map("".join, itertools.product("ab", repeat=n)):
            text, found = "▁" + w, {}
            for cut in itertools.product((0, 1), repeat=n):
                parts, last = [], 0
                for k, c in enumerate(cut, 1):
                    if c:
                        parts.append(text[last:k])
                        last = k
                parts.append(text[last:])
                if all(p in pieces for p in parts):
                    found.setdefault(round(sum(pieces[p] for p in parts), 9), set()).add(len(parts))
            assert trie.insert(text) in found[max(found)]


# ---------------------------------------------------------------- WARC


def test_canonical_urls(spark):
    cases = {
        "HTTP://WWW.Example.com:80/a/b/?b=2&utm_source=x&a=1#top": "example.com/a/b?a=1&b=2",
        "https://example.com/": "example.com",
        "https://m.example.com/A.html#x": "m.example.com/A.html",
        "example.com/a?": "example.com/a",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "url string")
    got = {r[0]: r[1] for r in df.select("url", warc.canonical_url(df.url)).collect()}
    assert got == cases | {None: None}


RECORDS = "id long, url string, at long, type string, status int, etag string, last_modified string, headers map<string,string>, payload string"


def brute_resolve(rows):
    out = {}
    for r in rows:
        if r[3] != "revisit":
            out[r[0]] = ("full" if r[3] == "response" and r[4] == 200 else "other", None, r[8])
            continue
        earlier = [f for f in rows if f[3] == "response" and f[4] == 200 and f[1] == r[1] and r[1] is not None and (f[2], f[0]) < (r[2], r[0])]
        if not earlier:
            out[r[0]] = ("missing", None, None)
            continue
        f = max(earlier, key=lambda x: (x[2], x[0]))
        pairs = [(a.removeprefix("W/") if a else a, b.removeprefix("W/") if b else b) for a, b in ((r[5], f[5]), (r[6], f[6]))]
        both = [(a, b) for a, b in pairs if a is not None and b is not None]
        o = "unchecked" if not both else "resolved" if all(a == b for a, b in both) else "changed"
        out[r[0]] = (o, f[0] if o == "resolved" else None, f[8] if o == "resolved" else None)
    return out


def test_revisits_match_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        kind = rng.choice(["response", "revisit", "revisit"])
        url = rng.choice(["h.com/hot"] * 6 + ["h.com/a", "h.com/b", None])
        tag = rng.choice(['"1"', 'W/"1"', '"2"', None])
        rows.append((i, url, rng.randrange(200), kind, rng.choice([200, 200, 404]) if kind == "response" else 304, tag, rng.choice([None, "d1"]), {"date": f"d{i}", "content-type" if kind == "response" else "x-cache": "v"}, f"p{i}" if kind == "response" else None))
    rows.append((900, "h.com/hot", 500, "request", None, None, None, None, None))
    got = warc.resolve_revisits(spark.createDataFrame(rows, RECORDS).repartition(4)).collect()
    want = brute_resolve(rows)
    assert {r.id: (r.outcome, r.source_id, r.payload) for r in got} == want and len(got) == len(rows)
    for r in got:
        if r.outcome == "resolved":
            assert r.headers == {"date": f"d{r.id}", "content-type": "v"}
    assert warc.resolve_revisits(spark.createDataFrame([], RECORDS)).count() == 0


def test_revisits_with_repeated_ids_and_null_times(spark):
    row = lambda i, at, kind, p: (i, "h.com/x", at, kind, 200 if p else 304, '"1"', None, None, p)
    rows = [row(1, None, "response", "b"), row(1, None, "response", "a"), row(2, 5, "revisit", None), row(2, 5, "revisit", None)]
    got = warc.resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect()
    assert len(got) == 4 and [r.payload for r in got if r.type == "revisit"] == ["a", "a"]


def brute_rows(rows):
    """Outcome, source id and payload of every record by the definition, ids being no names."""
    small = lambda x: (x is not None, x if x is not None else 0)
    when = lambda r: (small(r[2]), small(r[0]))
    out = []
    for r in rows:
        if r[3] != "revisit":
            out.append((r[0], r[1], r[2], "full" if r[3] == "response" and r[4] == 200 else "other", None, r[8]))
            continue
        earlier = [f for f in rows if f[3] == "response" and f[4] == 200 and f[1] == r[1] and r[1] is not None and when(f) < when(r)]
        if not earlier:
            out.append((r[0], r[1], r[2], "missing", None, None))
            continue
        last = max(map(when, earlier))
        f = min((f for f in earlier if when(f) == last), key=lambda f: f[8])
        outcome = "unchecked" if r[5] is None or f[5] is None else "resolved" if r[5] == f[5] else "changed"
        out.append((r[0], r[1], r[2], outcome, *((f[0], f[8]) if outcome == "resolved" else (None, None))))
    return sorted(map(repr, out))


def resolved(spark, rows, extra=False):
    df = spark.createDataFrame(rows, RECORDS).repartition(4)
    if extra:
        df = df.selectExpr("*", "'z' AS canonical_url", "1 AS source_id", "'y' AS canonical", "2 AS block", "3 AS `_0`")
    return sorted(repr((r.id, r.url, r.at, r.outcome, r.source_id, r.payload)) for r in warc.resolve_revisits(df).collect())


def test_ids_that_repeat_across_urls_and_times(spark):
    row = lambda i, url, at, kind, p=None: (i, url, at, kind, 200 if kind == "response" else 304, '"1"', None, None, p)
    rows = [row(5, "a.com", 9, "revisit"), row(5, "b.com", 9, "revisit"), row(1, "a.com", 1, "response", "zzz"), row(1, "b.com", 1, "response", "aaa"), row(None, "a.com", 9, "revisit"), row(None, "c.com", 0, "response", "n"), row(None, "c.com", 1, "revisit")]
    rows += [row(7, "a.com", 3, "response", "later"), row(7, "a.com", 4, "revisit"), row(7, "a.com", 2, "revisit"), row(7, "a.com", 3, "revisit")]
    got = resolved(spark, rows)
    assert got == brute_rows(rows) and len(got) == len(rows)
    assert got == resolved(spark, rows, extra=True)


def test_random_repeated_ids_match_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for k in range(600):
        kind = rng.choice(["response", "revisit"])
        rows.append((rng.choice([None, 1, 2, 3]), rng.choice(["h.com/a"] * 3 + ["h.com/b", None]), rng.choice([None, *range(12)]), kind, rng.choice([200, 200, 404]) if kind == "response" else 304, rng.choice(['"1"', '"2"', None]), None, None, f"p{k}" if kind == "response" else None))
    rows += rows[:40]
    # payloads of one (url, time, id) come with one tag, so the smallest payload decides alone
    rows = [(*r[:5], f'"{(r[2] or 0) % 2}"' if r[5] else None, *r[6:]) for r in rows]
    assert resolved(spark, rows) == brute_rows(rows)


# ---------------------------------------------------------------- HTML


@pytest.fixture(scope="module")
def model():
    return html.trained()


def test_held_out_accuracy(model):
    x, y = html.training_set(120, 4242)
    assert ((model.score(x) > 0) == y).mean() > 0.985


@pytest.mark.parametrize("kind", dict.fromkeys(html.KINDS))
def test_held_out_layouts(kind):
    """Trees that saw no page of a kind, on pages of that kind: share of words found, and of words found that belong."""
    model = html.trained(600, 10, tuple(k for k in html.KINDS if k != kind))
    found = wanted = right = 0
    for nodes in html.generated(60, 777, (kind,)):
        got = Counter(html.main_text(nodes, html.decode(nodes, model.score(html.features(nodes)))).split())
        want = Counter(html.main_text(nodes, [int(n.label) for n in nodes]).split())
        found, wanted, right = found + got.total(), wanted + want.total(), right + (got & want).total()
    assert right >= 0.95 * wanted and right >= 0.95 * found


def test_plain_layouts_are_not_empty(model):
    text = "This is a sentence of some length, with a clause. " * 6
    for page in ("<section><p>{}</p></section>", "<h1>T</h1><p>{}</p>", "<div><div><p>{}</p></div></div>", "<table><tr><td><font size=2>{}</font></td></tr></table>", "<body>{}</body>", "<div><p>{}</p><div class=sidebar><a href=x>a</a></div></div>", "{}", "<body><noscript>x<template><p>{}</p>"):
        assert text.strip() in html.extract_page(page.format(text), model), page


def test_parsing_is_linear():
    def seconds(n):
        began = time.perf_counter()
        nodes = html.parse("<div>" * n + "</span>" * n + "<noscript>" * n + "<p>" + "<b>" * n + "<p>x" * n + "<li>" * n)
        return time.perf_counter() - began, nodes

    seconds(100)
    assert seconds(40_000)[0] < 40 * max(seconds(4_000)[0], 0.005)


def test_pages_of_many_kinds(model):
    long = "This is a sentence of some length, with a clause. " * 6
    cases = [
        (f'<body><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy this now.</div><article><h1>Title &amp; more</h1><p><b>Bold.<br><p>{long}</p><p>End.</p></article><footer>&copy; me</footer>', f"Title & more Bold. {long.strip()} End."),
        (f"<html><body><header><h1>Site</h1></header><main><article><h1>T</h1><p>{long}</p><script>var a='</p>';</script></article></main><aside><p>{long}</p></aside></body></html>", f"T {long.strip()}"),
        (f'<body><article><p>{long}</p><div class="comments"><h3>Comments</h3><p>I liked it.</p></div></article></body>', long.strip()),
        (f'<body><article><p>One<i>two</i>\n three&nbsp;four</p><form><label>Mail</label><input></form><p>{long}</p></article></body>', f"Onetwo three four {long.strip()}"),
        (None, ""),
        ("", ""),
        ("<script>never closed", ""),
    ]
    assert html.extract_pages([c[0] for c in cases], model) == [c[1] for c in cases]


LONG = "This is a sentence of some length, with a clause and more. " * 6


@pytest.mark.parametrize("tag", ["article", "main"])
@pytest.mark.parametrize("head", ["header", 'header class="entry-header"', 'div class="article-header"', 'div class="entry-header"'])
def test_the_header_of_an_article_belongs_to_it(model, tag, head):
    for n in (1, 2, 6):
        body = f"<{head}><h1>Headline of it</h1><p>A standfirst here.</p></{head.split()[0]}>" + f"<p>{LONG}</p>" * n
        page = f"<html><body><header><h1>Site</h1><nav><ul><li><a href=/a>A</a></li></ul></nav></header><{tag}>{body}</{tag}><footer>c</footer></body></html>"
        assert html.extract_page(page, model) == "Headline of it A standfirst here. " + " ".join([LONG.strip()] * n)


@pytest.mark.parametrize("mark", [' class="responses"', ' class="feedback"', ' class="opinions"', ' class="user-posts"', ""])
def test_comments_without_marks_go(model, mark):
    for outer, inner in (("section", "div"), ("div", "div"), ("ul", "li")):
        for n in (1, 3, 10):
            items = "".join(f"<{inner}><b>Ann {k}</b> <time>2 May</time><p>I think that this was a very nice read, thank you {k}.</p><a href=#>Reply</a></{inner}>" for k in range(n))
            talk = f"<{outer}{mark}><h2>Responses</h2>{items}</{outer}>"
            for inside in (True, False):
                page = f"<html><body><header><h1>Site</h1></header><article><h1>T</h1><p>{LONG}</p><p>{LONG}</p>{talk if inside else ''}</article>{'' if inside else talk}</body></html>"
                assert html.extract_page(page, model) == f"T {LONG.strip()} {LONG.strip()}"


def test_hidden_elements_go_and_details_stay(model):
    page = f"<article><h1>T</h1><p>{LONG}</p><p hidden>no</p><div style='display:none'><p>no</p></div><p data-hidden='x'>Yes, this.</p><details><summary>More</summary><p>{LONG}</p></details></article>"
    assert html.extract_page(page, model) == f"T {LONG.strip()} Yes, this. More {LONG.strip()}"


def test_decoding_is_consistent_and_best(model):
    nodes = html.parse("<body><div><p>a</p><p>b<b>c</b></p></div><nav><a>d</a></nav></body>")
    rng = np.random.default_rng(1)
    parent = {id(n): k for k, n in enumerate(nodes)}
    for _ in range(20):
        odds = rng.normal(0, 2, len(nodes))
        yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        cost = lambda s: sum((no[k] / 2 if n.tag in html.HOLDERS else -1e6) if s[k] == 0 else yes[k] if s[k] == 1 else no[k] for k, n in enumerate(nodes))
        ok = lambda s: all(n.parent is None or s[k] in {0: (0, 1, 2), 1: (1, 2), 2: (2,)}[s[parent[id(n.parent)]]] for k, n in enumerate(nodes))
        best = max(cost(s) for s in itertools.product((0, 1, 2), repeat=len(nodes)) if ok(s))
        state = html.decode(nodes, odds)
        assert ok(state) and abs(cost(state) - best) < 1e-9


def test_extract_table(spark):
    rows = [(1, "u", "<article><p>Hello there, you.</p></article>"), (1, "u", "<article><p>Hello there, you.</p></article>"), (2, None, None), (None, "v", "<p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html.extract(df).collect()
    assert len(got) == 4 and [r.n_chars for r in got if r.page_id == 1] == [17, 17] and all(r.n_chars == len(r.text) for r in got)
    assert html.extract(df.limit(0)).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from tests.llm import test_dedup_ops as t

    rng = random.Random(12)
    passage, item = words(rng, 60), words(rng, 20)
    docs = [(k, f"{words(rng, 120)}.", "en", "s", 0) for k in range(20)]
    docs += [(50, docs[3][1] + " x", "en", "s", 0), (60, f"{words(rng, 80)} {passage}", "en", "s", 0), (61, f"{words(rng, 80)} {passage} {words(rng, 80)}", "en", "s", 0)]
    docs += [(70, f"{words(rng, 80)} {item}", "en", "s", 0), (80, "# $ " * 100, "en", "s", 0), (90, "short", "en", "s", 0), (91, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "suffix_dedup", "decontamination", "bpe"]
    # brute force, stage by stage
    texts = {d[0]: d[1] for d in docs if d[0] not in (80, 90, 91)}
    comp = t.brute_components({i: t.brute_fingerprint(x) for i, x in texts.items()})
    texts = {i: x for i, x in texts.items() if comp[i] == i}
    seen = set()
    for i in sorted(texts):
        raw = texts[i].encode()
        cover = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                cover[p : p + 100] = True
            seen.add(raw[p : p + 100])
        texts[i] = bytes(np.frombuffer(raw, np.uint8)[~cover]).decode()
    del texts[70]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(t.BPE_PATH)
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: library.encode(x, add_special_tokens=False).ids for i, x in texts.items()}
    assert 50 not in got and len(texts[61]) < len(docs[22][1]) - 100
