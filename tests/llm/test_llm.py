"""Small tables with the awkward cases, each operator against brute force."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from evenkeel.llm import bpe, components, decontaminate, exact_dedup, html_text, induced_sort, language_id, ngram_join, oracle, quality_crf, queries, sample, shingles, suffix_dedup, token_histogram, toxicity
from evenkeel.llm.arrow import text_array
from tests.oracle import expected, rows_of

FOLDER = "/root/testdata/sf0.001"
RANKS = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
SCHEMA = "doc_id long, text string, lang string, _id long, text_hash string, n string"
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
BASE = " ".join(f"word{i}" for i in range(80))
AWKWARD = [
    (3, "a  b\tc"), (1, "a b c"), (2, "a b\nc"), (4, None), (5, ""), (6, "   \n"), (7, BASE), (8, BASE.replace("word40", "other")), (9, BASE + " more"),
    (10, LONG), (11, LONG), (12, "É à ß 日本語 😀 it's 123"), (13, "x"), (13, "x"), (14, "x y"), (None, "x"), (15, "Aa " * 400), (16, "\x00\x01 zero"), (17, BASE.upper()),
]


def table(spark, rows=AWKWARD):
    return spark.createDataFrame([(i, t, "en", 1, "h", "n") for i, t in rows], SCHEMA)


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_oracle(spark, name):
    got = queries.queries()[name](spark, FOLDER)
    want, columns = expected(oracle.oracle_sql()[name], FOLDER)
    assert sorted(got.columns) == columns and rows_of(got) == want


# 1 and 3


def test_bpe_against_tiktoken(spark):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    rng = random.Random(0)
    extra = [(100 + i, "".join(rng.choice("aeiourstln  .,'\n\té😀0123") for _ in range(rng.randrange(300)))) for i in range(60)] + [(200, "z" * 5000), (201, "<|endoftext|>")]
    rows = AWKWARD + extra
    got = sorted(map(tuple, bpe.round_trip(table(spark, rows), RANKS, P.PATTERN).collect()), key=str)
    want = []
    for i, t in rows:
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    assert got == sorted(want, key=str)
    ids = bpe.encode(table(spark, rows), RANKS, P.PATTERN)
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(ids, RANKS).collect()}
    assert all(back[i] == (t or "").encode() for i, t in rows if i is not None)
    assert bpe.round_trip(table(spark, []), RANKS, P.PATTERN).count() == 0


def test_bpe_refuses_a_table_without_some_byte(spark):
    with pytest.raises(ValueError):
        bpe.round_trip(table(spark), {b"a": 0, b"b": 1, b"ab": 2}, P.PATTERN)


def test_perfect_hash_is_minimal():
    whole = bpe.PerfectHash(list(RANKS)[:5000])
    assert sorted(whole.slots) == list(range(5000))
    assert all(whole.index(t) == i for i, t in enumerate(list(RANKS)[:5000]))


def test_token_histogram(spark):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    n = np.array([len(own.encode_ordinary(t or "")) for _, t in AWKWARD])
    sums = token_histogram.suffix_sums(token_histogram.histogram(table(spark), RANKS, P.PATTERN))
    for r in sums.collect():
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == ((n == r.length).sum(), (n >= r.length).sum(), n[n >= r.length].sum())
        assert (r.truncated_total, r.docs_total, r.tokens_total) == (np.minimum(n, r.length).sum(), len(n), n.sum())
    assert tuple(token_histogram.totals(sums).first()) == (len(n), n.sum())
    for limit in (0, 2, 7, 10**6):
        assert token_histogram.truncated_total(sums, limit).first().tokens == np.minimum(n, limit).sum()
    for q in (0.1, 0.5, 0.9, 1.0):
        assert token_histogram.quantile(sums, q).first().length == np.sort(n)[int(np.ceil(q * len(n))) - 1]
    none = token_histogram.suffix_sums(token_histogram.histogram(table(spark, []), RANKS, P.PATTERN))
    assert none.count() == 0 and tuple(token_histogram.totals(none).first()) == (0, 0) and token_histogram.quantile(none, 0.5).first().length is None


# 2


def test_suffix_order():
    rng = np.random.default_rng(0)
    for _ in range(150):
        t = rng.integers(0, int(rng.integers(1, 5)) + 1, int(rng.integers(1, 70)))
        assert induced_sort.suffixes(t, 10**6).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        near = [t[i : i + 5].tolist() for i in induced_sort.suffixes(t, 5)]
        assert near == sorted(near) and len(near) == len(t)


def brute_spans(rows, length):
    """Of each (id, text), in order: the spans to remove."""
    first, out = {}, []
    order = sorted(set(rows), key=lambda r: (r[0], sha(r[1])))
    for i, t in order:
        for s in range(len(t) - length + 1):
            first.setdefault(t[s : s + length], (i, t, s))
    for i, t in rows:
        gone = np.zeros(len(t) + 2, bool)
        for s in range(len(t) - length + 1):
            if first[t[s : s + length]] != (i, t, s):
                gone[s + 1 : s + 1 + length] = True
        edge = np.flatnonzero(gone[1:] != gone[:-1])
        out.append([(int(a), int(z)) for a, z in zip(edge[::2], edge[1::2])])
    return out


@pytest.mark.parametrize("together,shard,remembered", [(4000, 1 << 20, 100_000), (2, 600, 100_000), (2, 600, 3)])
def test_suffix_dedup(spark, monkeypatch, together, shard, remembered):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    monkeypatch.setattr(suffix_dedup, "REMEMBERED", remembered)
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    long = LONG[:20_000]
    rows = [*AWKWARD[:9], (10, long), (11, long), *AWKWARD[11:], (None, passage), (None, "n " + passage)]
    for i in range(40):
        own = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        rows.append((50 + i, " ".join(own[:20]) + (" " + passage[rng.randrange(100) :] if i % 2 else "") + " " + " ".join(own[20:])))
    rows += [(100, "ab" * 300), (101, "c" * 250), (102, passage), (103, passage[:150] + "!" + passage[151:])]
    last = suffix_dedup.LAST  # null ids
    got = sorted((last if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, tuple(map(tuple, r.spans))) for r in suffix_dedup.report(table(spark, rows)).collect())
    raw = [(last if i is None else i, (t or "").encode()) for i, t in rows]
    want = []
    for (i, t), spans in zip(raw, brute_spans(raw, 100)):
        kept, at = b"", 0
        for a, z in spans:
            kept, at = kept + t[at:a], z
        want.append((i, len(t), sum(z - a for a, z in spans), len(spans), sha(kept + t[at:]), tuple(spans)))
    assert got == sorted(want)
    assert suffix_dedup.report(table(spark, [])).count() == 0
    with pytest.raises(TypeError):
        suffix_dedup.report(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_suffix_dedup_is_not_misled_by_strings_that_weak_hashes_mix_up(spark):
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word[:1024] + "x" * 10), (2, word[1024:] + "y" * 10), (3, "z" + word[:1024])]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in suffix_dedup.report(table(spark, rows)).collect()}
    assert got == dict(zip((1, 2, 3), brute_spans([(i, t.encode()) for i, t in rows], 100)))


def test_suffix_dedup_parts_stay_small(spark, monkeypatch):
    """One passage in all documents, in different surroundings: what is sorted together doesn't grow with them."""
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 50)
    made = {}
    for n in (500, 4000):
        rng = random.Random(3)
        passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
        rows = [(i, f"{rng.random()}" + passage + f"{rng.random()}") for i in range(n)]
        sizes, frame = [], type(spark.range(1))
        old = frame.sortWithinPartitions
        monkeypatch.setattr(frame, "sortWithinPartitions", lambda df, *by: (sizes.append(df.filter("part >= 0").groupBy("gram", "part").count().agg(F.max("count")).first()[0]) if "part" in df.columns else None, old(df, *by))[1])
        got = suffix_dedup.report(table(spark, rows)).agg(F.sum("n_removed")).first()[0]
        monkeypatch.setattr(frame, "sortWithinPartitions", old)
        assert got >= 400 * (n - 1)
        made[n] = max(sizes)
    assert made[4000] <= 2 * made[500] <= 400


def test_gram_hashes_cover_all_bytes():
    rng = np.random.default_rng(1)
    for gram in (8, 11, 16, 30, 36, 47):
        data = rng.integers(0, 256, 90).astype(np.uint8)
        base = suffix_dedup.grams(data, gram)
        assert len(base) == 90 - gram + 1
        for at in range(90):
            other = data.copy()
            other[at] ^= 1
            changed = suffix_dedup.grams(other, gram) != base
            assert changed.tolist() == [i <= at < i + gram for i in range(len(base))]


@pytest.mark.parametrize("piece", [1 << 20, 300])
def test_suffix_dedup_repeated_rows(spark, monkeypatch, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rng = random.Random(9)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    long, part = some(400), some(150)
    rows = [(1, long), (2, some(200) + part), (3, part + some(90)), (1, long), (4, "z" + long[50:300]), (2, "own " + part), (3, "x"), (3, "x"), (1, long), (5, long), (5, long)]
    got = sorted((r.doc_id, r.n_bytes, tuple(map(tuple, r.spans))) for r in suffix_dedup.report(table(spark, rows)).collect())
    raw = [(i, t.encode()) for i, t in rows]
    assert got == sorted((i, len(t), tuple(s)) for (i, t), s in zip(raw, brute_spans(raw, 100)))
    assert [g for g in got if g[0] == 1] == [(1, 400, ())] * 3


def test_suffix_dedup_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    rng = random.Random(1)
    part = "".join(rng.choice("abcdefgh ") for _ in range(900))
    rows = [(1, part + "".join(rng.choice("ijkl") for _ in range(3000)) + part), (2, "q" + part[300:])]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in suffix_dedup.report(table(spark, rows)).collect()}
    want = brute_spans([(i, t.encode()) for i, t in rows], 100)
    assert got == {1: want[0], 2: want[1]}


# 4

PAGE = "<html><body><nav><a href=/>Home</a></nav><div class=ad>Buy</div><article><h1>{0}</h1><p>{1}<p>Caf&eacute; &lt;b&gt;\n two  spaces<script>no()</script></article><footer>f</footer></body></html>"


@pytest.mark.parametrize("limit", [None, 10])
def test_html(spark, monkeypatch, limit):
    if limit:
        monkeypatch.setattr(html_text, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(html_text, "LINES_HELD", limit)
    rows = [(i, "http://h.example/a", PAGE.format(f"T{i}", f"text {i}")) for i in range(4)]
    rows += [(20 + i, "http://H6.example/a", PAGE.format(f"T{i}", f"text {i}")) for i in range(6)]
    rows += [(10, "http://h.example/b", None), (11, None, "<p>plain"), (12, "http://other.example", ""), (13, "http://o.example", "<body><article></article><div>else</div>"), (13, "http://o.example", "<!-- open"), (14, "http://s.example", "<div id=main><p>x</p><div class=comments>c</div><aside>s</aside></div>")]
    rows += [(30, "http://r.example", "<p>same")] * 2 + [(None, "http://n.example", "<p>no id")] + [(40 + i, "http://copies.example", PAGE.format("T", "copy")) for i in range(7)]
    docs = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, html string, host string, guide string").repartition(3)
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_text.extract(docs).collect()), key=str)
    want = [(i, f"T{i}\n\ntext {i}\n\nCafé <b> two spaces") for i in range(4)] + [(10, ""), (11, "plain"), (12, ""), (13, ""), (13, "else"), (14, "x"), (30, "same"), (30, "same"), (None, "no id")]
    want += [(20 + i, f"T{i}\n\ntext {i}") for i in range(6)]  # the line that all six pages have is the host's
    want += [(40 + i, "T\n\ncopy\n\nCafé <b> two spaces") for i in range(7)]  # copies of one page have no other text
    assert [(a, b) for a, b, _ in got] == sorted(want, key=str) and all(len(b) == c for _, b, c in got)
    assert html_text.extract(docs.filter("false")).count() == 0


@pytest.mark.parametrize("tag", ["span", "div", "font"])
def test_html_deep_pages_and_open_quotes(spark, tag):
    deep = f"<{tag}>" * 50_000 + "deep text"
    quote = "<p>before</p><p title=" + "x " * 40 + '"open>after</p>'
    rows = [(1, "http://d.example/1", deep), (2, "http://d.example/2", deep + "<p>more"), (3, "http://q.example", quote), (4, "http://c.example", "<p>a <b or <!-- c"), (5, "http://v.example", '<p title="never closed>a<p>b')]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(docs).collect()}
    assert got == {1: "deep text", 2: "deep text\n\nmore", 3: "before\n\nafter", 4: "a", 5: "a\n\nb"}


@pytest.mark.parametrize(
    "page,text",
    [
        ("<p>kept</p>more <a href=http://example.com/" + "x" * 100_000, "kept\n\nmore"),
        ("<p>kept" + '<a "' * 100_000, "kept"),
        ("<p>kept" + '<a href="' * 100_001, "kept"),
        ("<p>kept" + "<!--" * 100_000, "kept"),
        ("<p>kept" + "<a x=''" * 100_000, "kept"),
        ("<p>" + "<" * 100_000, "<" * 100_000),
        ("<p>kept" + "<button>" * 50_000, "kept"),
        ("<script>" * 50_000, ""),
        ("".join(f"<div class=c{chr(97 + i % 26) * (i // 26 + 1)}>t{i}</div>" for i in range(2000)), "\n\n".join(f"t{i}" for i in range(2000))),
    ],
)
def test_html_takes_linear_time(page, text):
    start = time.time()
    stream = html_text.tokens(page)
    w = html_text.bounded(html_text.merge(html_text.fold(stream), html_text.fold(stream)))
    assert html_text.main_text(stream, html_text.Guide.of(html_text.guide(html_text.loads(html_text.dumps(w))))) == text
    assert time.time() - start < 10


def host_texts(*pages):
    """The texts of one host's pages."""
    streams = [html_text.tokens(x) for x in pages]
    w = html_text.fold(streams[0])
    for s in streams[1:]:
        w = html_text.merge(w, html_text.fold(s))
    g = html_text.Guide.of(html_text.guide(html_text.loads(html_text.dumps(w))))
    return [html_text.main_text(s, g) for s in streams]


def test_html_place_holds_all_text():
    p = "".join(f"<p>{'long text ' * 20}{{0}}{i}" for i in range(6))
    long = ["long text " * 20 + f"{{0}}{i}" for i in range(6)]
    said = lambda *parts: ["\n\n".join(parts).format(i) for i in "ab"]
    both = lambda body: host_texts(*(body.format(i) for i in "ab"))
    bare = "<body><nav>n</nav><div><h1>t{0}</h1>" + p + "<ul><li>l{0}<li>m</ul><table><tr><td>c{0}</table><blockquote>q{0}</blockquote></div><footer>f</footer></body>"
    assert both(bare) == said("t{0}", *long, "l{0}", "m", "c{0}", "q{0}")
    beside = "<body><article><p>teaser of some length {0}</article><section>" + p + "</section></body>"
    assert both(beside) == said("teaser of some length {0}", *long)
    inside = "<body><div>site {0}</div><main><article>" + p + "</article><section><h2>h{0}</h2>" + p + "</section></main></body>"
    assert both(inside) == said(*long, "h{0}", *long)
    several = "<body><article>" + p + "</article><article>" + p + "</article></body>"
    assert both(several) == said(*long, *long)


def test_html_wrapper_decides():
    boilerplate = "the same on every page of the host and much longer than any story, " * 9
    pages = [f"<body><div><p>{boilerplate}</p></div><div><p>story {i}</p><p>of two lines {i * i}</p></div><div>{boilerplate}</div></body>" for i in range(6)]
    assert host_texts(*pages) == [f"story {i}\n\nof two lines {i * i}" for i in range(6)]
    # Names alone take nothing out of an article, nor out of its lines.
    named = "<body><div class=ad>own advert {0}</div><article><h1>t{0}</h1><div class=related-work>rw {0}</div><div class='story search'>ss {0}</div><div class='post comments-on-method'>cm {0}</div><p class=banner-story>x <a class=share href=x>sh{0}</a> <math><mi>m{0}</mi></math> <svg><text>s{0}</text></svg><canvas>c{0}</canvas></p></article><div class=comments><p>c{0}</div></body>"
    assert host_texts(*(named.format(i) for i in range(3))) == [f"t{i}\n\nrw {i}\n\nss {i}\n\ncm {i}\n\nx sh{i} m{i} s{i}c{i}" for i in range(3)]
    # Without elements that say what they are: a list of links, reader comments that come again, a form around all.
    bare = lambda i: f"<body><form><ul>{''.join(f'<li><a href=/{k}>menu {k} of {i}</a>' for k in range(5))}</ul><div><h1>t{i}</h1><p>{'story ' * 40}{i}</p><p>see <a href=x>this</a> and that {i}</p></div><div class=comments>{''.join(f'<div><p>comment {k} on {i}</p></div>' for k in range(i))}</div><input><button>Go</button></form></body>"
    assert host_texts(*map(bare, range(1, 5))) == [f"t{i}\n\n{'story ' * 40}{i}\n\nsee this and that {i}" for i in range(1, 5)]


def brute_wrapper(pages):
    """Of each path of kinds: pages that have it, whether it comes again below one element, lines of all of these pages."""
    found = {}
    for x in pages:
        own, path, inner = {(): [False, set()]}, [], [[]]
        for t in html_text.tokens(x):
            if not t:
                path.pop()
                inner.pop()
            elif len(t) == 1:
                path.append(t[0])
                at = own.setdefault(tuple(path), [False, set()])
                at[0] |= t[0] in inner[-1]
                inner[-1].append(t[0])
                inner.append([])
            else:
                own[tuple(path)][1].add(html_text.digest(t[0]))
        for k, (again, texts) in own.items():
            n, a, s = found.get(k, (0, False, texts))
            found[k] = (n + 1, a or again, s & texts)
    return found


def flat(w):
    out, todo = {}, [((), w)]
    while todo:
        path, x = todo.pop()
        out[path] = (x.pages, x.again, set(x.texts))
        todo += [((*path, k), kid) for k, kid in x.kids.items()]
    return out


@pytest.mark.parametrize("seed", range(5))
def test_html_wrapper_against_brute_force_in_any_split(seed):
    rng = random.Random(seed)

    def some(depth):
        parts = []
        for _ in range(rng.randrange(4)):
            tag = rng.choice(["div", "p", "ul", "div class=a", "h2"])
            parts.append(f"<{tag}>" + (some(depth - 1) if depth and tag != "p" else "") + rng.choice(["", "fixed", f"t{rng.randrange(4)}"]) + f"</{tag.split()[0]}>")
        return "".join(parts)

    pages = [some(3) for _ in range(9)]
    folds = [html_text.fold(html_text.tokens(x)) for x in pages]
    while len(folds) > 1:
        a, b = (folds.pop(rng.randrange(len(folds))) for _ in range(2))
        folds.append(html_text.loads(html_text.dumps(html_text.merge(a, b))))
    assert flat(folds[0]) == brute_wrapper(pages)


def test_html_wrapper_expression():
    w = html_text.merge(html_text.fold(html_text.tokens("<ul><li>a<li>b</ul><p>same</p>")), html_text.fold(html_text.tokens("<ul><li>c</ul><h2>t</h2><p>same</p>")))
    assert html_text.expression(w) == '<html><ul>(<li>#</li>)+</ul>(<h2>#</h2>)?<p>"fixed"</p></html>'


def test_html_query_against_the_template(spark):
    got = {r.page_id: r.text for r in queries.op4_html_text(spark, FOLDER).collect()}
    import html

    for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        own = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split("</?(?:p|h1)>", own)]
        assert got[r.page_id] == "\n\n".join(b for b in parts if b)


# 5


@pytest.mark.parametrize("hot", [1000, 1])
def test_exact_dedup(spark, hot):
    rows = AWKWARD + [(30 + i, "copy  of") for i in range(20)]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    got = exact_dedup.groups(table(spark, rows), hot_rows=hot).collect()
    assert len(got) == len(rows)
    for r in got:
        own = next(g for t, g in groups.items() if sha(t.encode()) == r.text_sha256)
        assert r.keep_id == min(i for i in own if i is not None) and r.group_size == len(own) and r.doc_id in own
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact_dedup.keep_first(table(spark, rows), hot_rows=hot)
    assert kept.columns == table(spark).columns and kept.count() == len(groups)
    assert exact_dedup.groups(table(spark, [])).count() == 0


# 6


def word_sets(t, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, percent=85, k=4):
    ids = sorted({i for i, _ in rows if i is not None})
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    known = [(i, word_sets(t, k)) for i, t in rows if i is not None]
    for n, (i, a) in enumerate(known):
        for j, b in known[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("seed", range(2))
def test_ngram_join(spark, monkeypatch, seed):
    monkeypatch.setattr(ngram_join, "PAIRS_A_TASK", 7)
    monkeypatch.setattr(ngram_join, "TOGETHER", 5)
    monkeypatch.setattr(ngram_join, "FIRST_HUBS", 1)
    monkeypatch.setattr(ngram_join, "MORE", 6)
    rng = random.Random(seed)
    rows = [*AWKWARD]
    passage = [f"p{i}" for i in range(40)]
    for family in range(6):
        base = [f"f{family}w{rng.randrange(500)}" for _ in range(rng.choice((3, 6, 20, 60, 150)))]
        for _ in range(rng.choice((5, 25))):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                at = rng.randrange(len(own))
                rng.choice((lambda: own.pop(at) if len(own) > 1 else None, lambda: own.__setitem__(at, f"e{rng.randrange(9)}")))()
            if rng.random() < 0.3:
                own += passage
            rows.append((rng.randrange(100, 100_000), " ".join(own)))
    got = ngram_join.classes(table(spark, rows)).collect()
    want = brute_components(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert sorted((r.doc_id, r.n_shingles) for r in got if r.doc_id is not None) == sorted((i, len(word_sets(t))) for i, t in rows if i is not None)
    kept = ngram_join.keep_one(table(spark, rows))
    assert {r.doc_id for r in kept.collect()} == set(want.values()) | {None}


def test_ngram_join_repeated_rows_and_ids_with_several_texts(spark):
    some = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    half = some("h", 60)
    rows = [(2, half + " " + some("a", 60)), (2, half + " " + some("a", 60)), (3, half + " " + some("b", 60)), (3, half + " " + some("b", 60))]  # not linked
    rows += [(10, some("c", 50)), (11, some("c", 50)), (11, some("d", 50)), (12, some("d", 49) + " other"), (11, some("e", 50)), (13, some("e", 50)), (14, some("f", 40))]
    got = ngram_join.classes(table(spark, rows)).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == brute_components(rows) == {2: 2, 3: 3, **dict.fromkeys((10, 11, 12, 13), 10), 14: 14}
    kept = sorted((r.doc_id, r.text) for r in ngram_join.keep_one(table(spark, rows)).collect())
    assert kept == sorted(r for n, r in enumerate(rows) if n not in (5, 7, 9))


def test_ngram_join_empty(spark):
    assert ngram_join.classes(table(spark, [])).count() == 0
    assert {r.component_id for r in ngram_join.classes(table(spark, [(1, None), (2, ""), (None, None)])).collect()} == {1, 2, None}
    with pytest.raises(TypeError):
        ngram_join.classes(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_ngram_join_is_not_misled_by_words_that_weak_hashes_mix_up(spark):
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, "one two three " + word), (2, "one two three " + other), (3, "ONE two\tthree " + word)]
    assert {r.doc_id: r.component_id for r in ngram_join.classes(table(spark, rows)).collect()} == {1: 1, 2: 2, 3: 1}


def chained(n, common=40, own=5):
    """Texts in one passage with own words in the middle: near the threshold, many in a group and few of them linked."""
    rng = random.Random(n)
    base = [f"b{i}" for i in range(common)]
    out = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(common), rng.randrange(own)):
            words[at] = f"o{rng.randrange(3)}"
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("first,more", [(2, 4), (16, 64)])
def test_ngram_join_groups_with_many_components(spark, monkeypatch, first, more):
    monkeypatch.setattr(ngram_join, "FIRST_HUBS", first)
    monkeypatch.setattr(ngram_join, "MORE", more)
    rows = chained(150)
    got = {r.doc_id: r.component_id for r in ngram_join.classes(table(spark, rows)).collect()}
    assert got == brute_components(rows) and 3 < len(set(got.values())) < 150


def test_ngram_join_work_grows_in_proportion(spark, monkeypatch):
    """Documents that share four fifths of their text, none of them linked, bring no pairs but chance ones."""
    tested = []
    judge = ngram_join.overlaps
    monkeypatch.setattr(ngram_join, "overlaps", lambda docs, pairs, n, order, k: (tested.append(n), judge(docs, pairs, n, order, k))[1])
    passage = " ".join(f"p{i}" for i in range(80))
    for n in (1000, 20_000):
        tested.clear()
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit(passage), F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.concat(F.lit("w"), F.col("id").cast("string"), F.lit("x"), i.cast("string"))).cast("array<string>")).alias("text"))
        assert ngram_join.classes(docs).filter("component_id <> doc_id").isEmpty() and sum(tested) <= n // 10


def test_shingles():
    texts = [t or "" for _, t in AWKWARD]
    for t, s in zip(texts, shingles.sets(text_array(pa.array(texts)), 4)):
        assert len(s) == len(word_sets(t))


@pytest.mark.parametrize("few", [0, 200_000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1080)] + [(2000, i) for i in range(2001, 2100)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    up = {}
    groups = []
    for a, b in edges:
        if a == b:
            continue
        joined = {a, b}
        rest = []
        for g in groups:
            (joined.update(g) if g & joined else rest.append(g))
        groups = [*rest, joined]
    for g in groups:
        up |= {n: min(g) for n in g}
    assert got == up


# 7, 8 and 10


def test_labelled_sample(spark, monkeypatch):
    monkeypatch.setattr(sample, "BYTES", 1000)
    rows = [(i, "x" * 90, "a", i) for i in range(30)] + [(7, "other", "b", 0), (None, "n", "c", 0), (31, None, "d", 0), (32, "y" * 1001, "e", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _label long").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(33)] + [(7, 5), (8, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    got = sample.labelled(docs, labels, "toxic", sample.remainder(F.col("doc_id"), 3) != 1)
    assert got == sample.labelled(docs, labels, "toxic", sample.remainder(F.col("doc_id"), 3) != 1)
    allowed = [i for i in range(33) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert 9 <= len(got) <= 12 and sum(len(t) for t, _ in got) <= 1000 and {y for _, y in got} <= {0, 1, 5}
    monkeypatch.setattr(sample, "BYTES", 1 << 20)
    every = sample.labelled(docs, labels, "toxic", sample.remainder(F.col("doc_id"), 3) != 1)
    assert len(every) == sum(i <= 30 and i < 30 or i == 32 for i in allowed) + (7 in allowed) and ("y" * 1001, 0) in every or 32 not in allowed
    assert len(sample.labelled(docs, labels, "toxic", F.lit(True), rows=5)) == 5
    assert sample.labelled(docs.filter("false"), labels, "toxic", F.lit(True)) == []


def test_quality_gradient_against_differences():
    """The gradient of training is that of the log likelihood of the labels, by finite differences."""
    rng = np.random.default_rng(2)
    at, moves, y = np.array([0, 3, 5]), rng.normal(size=(2, 2)), np.array([1, 0])
    u = rng.normal(size=5)

    def loss(u, moves):
        total = 0.0
        for (a, z), label in zip(zip(at, at[1:]), y):
            paths = [[(n >> i) & 1 for i in range(z - a)] for n in range(1 << (z - a))]
            w = [sum(u[a + i] * p for i, p in enumerate(path)) + sum(moves[s, t] for s, t in zip(path, path[1:])) for path in paths]
            total += np.log(np.exp(w).sum()) - w[-1 if label else 0]
        return total

    good, expected = quality_crf.marginals(u, at, moves)
    step = 1e-6
    for i in range(5):
        moved = u.copy()
        moved[i] += step
        assert (loss(moved, moves) - loss(u, moves)) / step == pytest.approx(good[i] - np.repeat(y, np.diff(at))[i], abs=1e-4)
    seen = np.array([[1.0, 0], [0, 2.0]])  # the moves along the labels
    for s, t in ((0, 0), (0, 1), (1, 0), (1, 1)):
        moved = moves.copy()
        moved[s, t] += step
        assert (loss(u, moved) - loss(u, moves)) / step == pytest.approx((expected - seen)[s, t], abs=1e-4)


def test_quality_features_of_a_line():
    x, length, at = quality_crf.lines(text_array(pa.array(["Ab ab! ab 12\n\n  \nx", None])))
    assert at.tolist() == [0, 2, 3] and length.tolist() == [13, 1, 0]
    line = x[0]
    assert line[0] == pytest.approx(np.log1p(13)) and line[1] == pytest.approx(4 / 13)  # with its line feed
    assert line[2] == pytest.approx(1 / 13) and line[3] == pytest.approx(5 / 13) and line[4] == pytest.approx(2 / 13) and line[6] == pytest.approx(1 / 13)
    assert (x[2] == -1).all()


def brute_grams(text, sizes):
    points = [ord(c) for c in f" {text} "]  # each text stands between spaces
    return [tuple(points[i : i + n]) for n in sizes for i in range(len(points) - n + 1)]


def test_language_weights_against_brute_force():
    """TF-IDF, the proximal step and the temperature, recomputed gram by gram."""
    rows = [("aab", "p"), ("bba", "q"), ("abab", "p"), ("bb", "q")] * 6
    model = language_id.fit(rows)
    names, back = ["p", "q"], int(len(rows) * language_id.HELD_BACK)
    grams = [Counter(brute_grams(t, language_id.SIZES)) for t, _ in rows]
    df = Counter(g for c in grams for g in c)
    idf = {g: np.log((1 + len(rows)) / (1 + n)) + 1 for g, n in df.items()}
    z, n2 = {}, {}
    zb, nb = np.zeros(2), np.zeros(2)

    def weight(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((language_id.BETA + np.sqrt(n)) / language_id.ALPHA + language_id.L2))

    order = np.random.default_rng(0)
    for _ in range(language_id.PASSES):
        for i in order.permutation(np.arange(back, len(rows))):
            total = sum(grams[i].values())
            x = {g: language_id.SCALE * c / total * idf[g] for g, c in grams[i].items()}
            w = {g: weight(z.get(g, np.zeros(2)), n2.get(g, np.zeros(2)), language_id.L1) for g in x}
            wb = weight(zb, nb, 0.0)
            s = wb + sum(w[g] * v for g, v in x.items())
            d = np.exp(s - s.max())
            d = d / d.sum()
            d[names.index(rows[i][1])] -= 1
            for g, v in x.items():
                old = n2.get(g, np.zeros(2))
                z[g] = z.get(g, np.zeros(2)) + v * d - (np.sqrt(old + (v * d) ** 2) - np.sqrt(old)) / language_id.ALPHA * w[g]
                n2[g] = old + (v * d) ** 2
            zb = zb + d - (np.sqrt(nb + d * d) - np.sqrt(nb)) / language_id.ALPHA * wb
            nb = nb + d * d
    for text in ("aab", "ba", "bbbb"):
        c = Counter(brute_grams(text, language_id.SIZES))
        want = weight(zb, nb, 0.0) + sum(language_id.SCALE * v / sum(c.values()) * weight(z[g], n2[g], language_id.L1) * idf[g] for g, v in c.items() if g in z)
        assert model.logits(text_array(pa.array([text])))[0][0] == pytest.approx(want, rel=1e-4, abs=1e-5)
    logits = np.array([model.logits(text_array(pa.array([t])))[0][0] for t, _ in rows[:back]])
    loss = lambda t: -np.mean([np.log(language_id.softmax(x[None] / t)[0][names.index(y)]) for x, (_, y) in zip(logits, rows[:back])])
    assert all(loss(model.temperature) <= loss(t) + 1e-9 for t in np.geomspace(0.05, 20, 60))



def test_quality(spark):
    good = ["The cat sat here.\nIt was a calm day, and so on."] * 30
    bad = ["BUY!! NOW!! FREE!!\nWIN!! WIN!!"] * 30
    model = quality_crf.fit([(t, 1) for t in good] + [(t, 0) for t in bad])
    got = {r.doc_id: r.score for r in quality_crf.scores(table(spark, [*AWKWARD, (90, good[0]), (91, bad[0])]), model).collect()}
    assert got[90] > 0.5 > got[91] and all(0 <= s <= 1 for s in got.values()) and got[4] == got[5]
    assert quality_crf.fit([]).score(text_array(pa.array(["a"]))).tolist() == [0.0]
    assert quality_crf.fit([("a", 1)]).score(text_array(pa.array(["a", None]))).tolist() == [1.0, 1.0]
    assert quality_crf.scores(table(spark, []), model).count() == 0


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    at, moves = np.array([0, 3, 4, 9]), rng.normal(size=(2, 2))
    u = rng.normal(size=9)
    good, expect = quality_crf.marginals(u, at, moves)
    want, pairs = np.zeros(9), np.zeros((2, 2))
    for a, z in zip(at, at[1:]):
        paths = [[(n >> i) & 1 for i in range(z - a)] for n in range(1 << (z - a))]
        w = np.array([np.exp(sum(u[a + i] * y for i, y in enumerate(p)) + sum(moves[x, y] for x, y in zip(p, p[1:]))) for p in paths])
        w /= w.sum()
        for p, x in zip(paths, w):
            want[a:z] += x * np.array(p)
            for y1, y2 in zip(p, p[1:]):
                pairs[y1, y2] += x
    assert good == pytest.approx(want) and expect == pytest.approx(pairs)


def test_language(spark):
    rows = [("the cat and the dog are here", "en"), ("der hund und die katze sind hier", "de")] * 20
    model = language_id.fit(rows)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(table(spark, [(1, "the dog"), (2, "die katze und"), (3, None), (4, "123 !!"), (5, "")]), model).collect()}
    assert (got[1][0], got[2][0]) == ("en", "de") and got[3] == got[4] == got[5] == ("und", 0.0) and 0.5 < got[1][1] <= 1
    assert language_id.predict(table(spark), language_id.fit([])).filter("lang_pred <> 'und'").isEmpty()
    assert language_id.predict(table(spark, []), model).count() == 0


def test_toxicity(spark):
    rows = [(f"what a fine day number {i}", 0) for i in range(40)] + [(f"you utter blockhead number {i}", 1) for i in range(40)]
    model = toxicity.fit(rows)
    docs = table(spark, [(1, "a fine evening " * 3000), (2, "Blockhead!"), (3, None), (4, ""), (2, "Blockhead!")])
    got = {r.doc_id: r.score for r in toxicity.scores(docs, model).collect()}
    assert got[1] < 0.5 < got[2] and got[3] == got[4]
    assert sorted(r.doc_id for r in toxicity.keep_civil(docs, model).collect()) == sorted({1} | {i for i in (3, 4) if got[i] < 0.5})
    assert toxicity.fit([]).score(text_array(pa.array(["x"]))).tolist() == pytest.approx([0.0])
    assert toxicity.fit([("x", 1)]).score(text_array(pa.array(["x"]))).tolist() == [1.0]


def test_toxicity_is_learned_off_the_driver(spark, monkeypatch):
    docs = table(spark, [(i, f"you utter blockhead number {i}" if i % 2 else f"what a fine day number {i}") for i in range(80)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    want = toxicity.fit(sample.labelled(docs, labels, "toxic", F.lit(True)))
    here = os.getpid()
    whole = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda rows: pytest.fail("on the driver") if os.getpid() == here and rows else whole(rows))
    model = toxicity.learned(docs, labels, F.lit(True))
    assert model.weights.any() and np.array_equal(model.weights, want.weights) and model.bias == want.bias
    assert toxicity.learned(docs.filter("false"), labels, F.lit(True)).bias == -500
    assert toxicity.learned(docs, labels.filter("toxic = 1"), F.lit(True)).bias == 500


@pytest.mark.parametrize("name,label,least", [("op7_quality", "quality", 0.95), ("op10_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    folder = "/root/testdata/sf0.01"
    rows = queries.queries()[name](spark, folder)
    assert rows.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", label)
    held = rows.filter("held_out").join(labels, "doc_id")
    assert held.filter(F.col("predicted") == F.col(label)).count() >= least * held.count() > 0


def test_held_out_languages(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op8_language_id(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    assert rows.filter("lang = lang_pred").count() >= 0.97 * rows.count() > 0


# 9


def bench_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_report(docs, items):
    out = []
    for i, t in docs:
        w = bench_words(t)
        hit, found = set(), set()
        for item, own in ((n, bench_words(x)) for n, x in items):
            size = min(13, len(own))
            spans = {tuple(own[a : a + size]) for a in range(len(own) - size + 1)} if own else set()
            for a in range(len(w) - size + 1) if own else ():
                if tuple(w[a : a + size]) in spans:
                    hit.update(range(a, a + size))
                    if item is not None:
                        found.add(str(item))
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_decontamination(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    rng = random.Random(7)
    vocabulary = [f"t{i}" for i in range(30)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, some(rng.randrange(13, 40))) for i in range(12)] + [(20, "short item Here"), (21, "x"), (22, None), (23, " .,"), (None, some(20)), (3, some(15)), (24, "É à ß und so")]
    docs = [*AWKWARD]
    for i in range(60):
        text = items[rng.randrange(12)][1].split()
        a = rng.randrange(0, 12)
        docs.append((40 + i, f"{some(rng.randrange(0, 300))}, {'; '.join(text[a : a + rng.choice((12, 13, 20))]).upper()}! {some(5)}" + (" Short, item: here" if i % 5 == 0 else "")))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(table(spark, docs), bench).collect()
    assert sorted(map(tuple, got), key=str) == brute_report(docs, items)
    clean = decontaminate.keep_clean(table(spark, docs), bench)
    assert clean.count() == sum(not r[5] for r in brute_report(docs, items)) and clean.columns == table(spark).columns
    assert decontaminate.report(table(spark, []), bench).count() == 0
    assert decontaminate.report(table(spark, docs), bench.filter("false")).filter("n_hit > 0").isEmpty()


# Pipeline


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in corpus_pipeline.drop_toxic(spark, docs, folder).collect()]
    assert 0 < len(rows) <= docs.count()
    first = {}
    for i, t in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), (i, t))
    rows = list(first.values())
    parts = brute_components(rows, 80, 5)
    rows = [(i, t) for i, t in rows if parts[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute_report(rows, items) if r[5]}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    want = {i: own.encode_ordinary(t or "") for i, t in rows if i not in bad}
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == want and len(corpus_pipeline.STAGES) == 5
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, folder)
        assert stage.columns == docs.columns


def test_pipeline_stages_on_awkward_rows(spark):
    """Nulls, empty and long texts, repeated rows, an empty table, further columns: rows stay or go whole."""
    import corpus_pipeline

    toxic = spark.read.parquet(f"{FOLDER}/documents.parquet").join(spark.read.parquet(f"{FOLDER}/labels.parquet").filter("toxic = 1").select("doc_id"), "doc_id").first().text
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0).unionByName(table(spark, [*AWKWARD, (500, toxic)]), allowMissingColumns=True)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    rows = {name: f(spark, docs, FOLDER) for name, f in corpus_pipeline.STAGES[1:4]}
    assert all(r.columns == docs.columns for r in rows.values())
    assert rows["exact_dedup"].count() == len({norm(t) for _, t in [*AWKWARD, (0, toxic)]})
    near = brute_components([*AWKWARD, (500, toxic)], 80, 5)
    assert sorted((r.doc_id for r in rows["ngram_jaccard_join"].collect()), key=str) == sorted([i for i, _ in [*AWKWARD, (500, toxic)] if i is None or near[i] == i], key=str)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert rows["decontamination"].count() == sum(not r[5] for r in brute_report([*AWKWARD, (500, toxic)], items))
    encoded = corpus_pipeline.encode(spark, docs, FOLDER)
    assert encoded.count() == len(AWKWARD) + 1 and encoded.filter("doc_id = 4").first().n_tokens == 0
    for _, f in corpus_pipeline.STAGES[1:]:
        assert f(spark, docs.filter("false"), FOLDER).count() == 0
    assert corpus_pipeline.drop_toxic(spark, docs.filter("false"), FOLDER).count() == 0


def test_pipeline_near_copies_are_judged_on_five_words(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(100)]
    edited = lambda *at: " ".join(f"e{w}" if i in at else w for i, w in enumerate(base))
    rows = [(1, edited()), (2, edited(30, 60)), (3, edited(20, 50, 80))]
    a, b, c = (word_sets(t, 5) for _, t in rows)
    assert 10 * len(a & b) >= 8 * len(a | b) and 10 * len(a & c) < 8 * len(a | c) and 10 * len(b & c) < 8 * len(b | c)
    assert 100 * len(word_sets(rows[0][1]) & word_sets(rows[1][1])) < 85 * len(word_sets(rows[0][1]) | word_sets(rows[1][1]))
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, table(spark, rows), FOLDER).collect()} == {1, 3}


def test_bytes_that_are_not_utf8():
    from evenkeel.llm import ngrams

    raw = pa.array([b"abc", b"\xff\xfe x", b"\xc3"], pa.large_binary())
    texts = pa.LargeStringArray.from_buffers(3, raw.buffers()[1], raw.buffers()[2])
    points, at = ngrams.code_points(texts)
    assert at.tolist() == [0, 5, 11, 14] and ngrams.has_letter(points, at).tolist() == [True, True, False]
