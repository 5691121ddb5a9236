"""Quality, near-duplicates, repeats, pages, search and the pipeline against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.conftest import DOCS, prose, same_rows
from tidemark.llm import bpe, html, mixing, neardup, quality, repeats, search


def brute_model(texts):
    """Interpolated modified Kneser-Ney over characters, in dicts: probability of a symbol after its context."""
    order = quality.ORDER
    tables = {order: Counter()}
    for t in texts:
        w = [quality.START] * (order - 1) + [*map(ord, t), quality.END]
        tables[order].update(tuple(w[k : k + order]) for k in range(len(t) + 1))
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])

    def discounts(t):
        n = Counter(t.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        return [min(max(k - (k + 1) * y * n[k + 1] / n[k], quality.LEAST), float(k)) if n[1] and n[k] else k / 2 for k in (1, 2, 3)]

    d = {k: discounts(t) for k, t in tables.items()}
    context = {k: defaultdict(list) for k in tables}
    for k, t in tables.items():
        for g, n in t.items():
            context[k][g[:-1]].append(n)

    def p(g):
        k = len(g)
        below = 1 / (len(tables[1]) + 1) if k == 1 else p(g[1:])
        own = context[k].get(g[:-1])
        if not own:
            return below
        n = tables[k].get(g, 0)
        first = max(n - d[k][min(n, 3) - 1], 0) if n else 0
        return (first + sum(d[k][min(x, 3) - 1] for x in own) * below) / sum(own)

    def perplexity(t):
        w = [quality.START] * (order - 1) + [*map(ord, t), quality.END]
        bits = [-math.log2(p(tuple(w[k : k + order]))) for k in range(len(t) + 1)]
        return 2 ** (sum(bits) / len(bits))

    return perplexity


def brute_judged(rows, trusted, fold):
    """doc_id -> perplexity, threshold, kept of every row with text, given the trusted ids and the folds."""
    models, score, own = {}, [], defaultdict(list)
    for doc_id, text, lang, *_ in rows:
        others = [r for r in rows if r[0] in trusted and fold[r[0]] != fold[doc_id] and r[1]]
        mine = [r[1] for r in others if r[2] == lang and lang]
        name = lang if mine else ""
        key = name, fold[doc_id]
        if key not in models:
            models[key] = brute_model(mine or [r[1] for r in others]) if others else None
        found = models[key](text) if text and models[key] else None
        score.append((doc_id, name, found))
        if found and doc_id in trusted:
            own[name].append(found)
            own[None].append(found)

    def limit(values):
        bins = sorted(math.floor(math.log(round(v, 6)) / 0.001) for v in values)
        at = next(b for k, b in enumerate(bins) if sum(x <= b for x in bins) >= quality.QUANTILE * len(bins))
        return math.exp((at + 1) * 0.001) * quality.MARGIN

    limits = {name: limit(v) for name, v in own.items()}
    return [(doc_id, found, limits.get(name, limits.get(None))) for doc_id, name, found in score]


def test_perplexity_and_threshold_against_dicts(spark, monkeypatch):
    """All languages that have trusted text, in any script, have models and limits of their own; the others go by all trusted text."""
    rng = random.Random(11)
    scripts = ["the of and Red", "дом и сад на", "το και σπίτι", "日本語の本を読む", "ab ba abba", "🙂 x 🙃"]
    langs = [*(f"l{k}" for k in range(27)), None]
    rows = [(k, " ".join(rng.choice(scripts[k % len(langs) % 6].split()) for _ in range(rng.randrange(1, 9))), langs[k % len(langs)], "s", 0) for k in range(8 * len(langs))]
    rows += [(1000, "scum of the house", "l0", "s", 0), (1001, "the Red", "unheard", "s", 0), (1002, "", "l0", "s", 0), (1003, None, "l1", "s", 0), rows[0], rows[0], (1004, "the " * 900, "l0", "s", 0)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(6 * len(langs))] + [(1002, 1, 0), (1001, 0, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, DOCS).repartition(2)
    trusted = {r["doc_id"] for r in quality.trusted_ids(labels).collect()}
    fold = {r["doc_id"]: r["f"] for r in docs.select("doc_id", quality.fold_of().alias("f")).collect()}
    want = brute_judged(rows, trusted, fold)
    monkeypatch.setattr(quality, "BLOCK", 2000)  # several blocks a task
    found = quality.classify(docs, labels).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    got = {r["doc_id"]: r for r in found}
    for doc_id, perplexity, threshold in want:
        r = got[doc_id]
        assert (r["perplexity"] is None) == (perplexity is None) and math.isclose(r["threshold"], threshold, rel_tol=2e-3)
        if perplexity is not None:
            assert math.isclose(r["perplexity"], perplexity, rel_tol=1e-4)
        assert r["kept"] == (perplexity is not None and r["perplexity"] <= r["threshold"])
    assert len({r["threshold"] for r in found}) > 20


@pytest.mark.parametrize("kinds", [3, 300, 0x10000])
def test_numbers_of_grams(kinds):
    rng = np.random.default_rng(2)
    texts = ["".join(map(chr, rng.integers(0x20, 0x20 + kinds, n))).encode("utf-8", "ignore").decode() for n in (3000, 1, 9000)]
    symbols, at = quality.symbols_of(texts)
    grams, suffixes, ends, which = quality.orders(symbols)
    assert len(ends) == sum(len(t) + 1 for t in texts)
    for k, rows in enumerate(grams):
        n = quality.ORDER - k
        want = {tuple(symbols[e - n + 1 : e + 1].tolist()) for e in ends.tolist()}
        assert [tuple(r) for r in rows.tolist()] == sorted(want)
    assert (grams[0][which] == np.stack([symbols[ends - k] for k in range(quality.ORDER - 1, -1, -1)], 1)).all()
    for k, place in enumerate(suffixes):
        assert (grams[k + 1][place] == grams[k][:, 1:]).all()


def test_classify(docs, rows, labels, clashing, no_docs, spark):
    got = quality.classify(docs, labels)
    found = got.collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    for r in found:
        assert (r["perplexity"] is None) == (r["n_symbols"] == 0)
        assert r["kept"] == (r["n_symbols"] > 0 and r["perplexity"] <= r["threshold"])
    kept = {r["doc_id"] for r in found if r["kept"]}
    assert set(range(12)) <= kept and 500 not in kept and 400 not in kept and 401 not in kept
    stayed = quality.filter_documents(docs, labels)
    assert stayed.columns == docs.columns
    assert Counter(r["doc_id"] for r in stayed.collect()) == Counter(r["doc_id"] for r in found if r["kept"])
    assert same_rows(got, quality.classify(clashing, labels))
    assert quality.classify(no_docs, labels).count() == 0 and quality.filter_documents(no_docs, labels).count() == 0
    untaught = quality.classify(docs, labels.limit(0)).collect()
    assert all(r["kept"] == (r["n_symbols"] > 0) for r in untaught)


def shingles(text):
    words = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(k)
    out = {}
    for g in groups.values():
        least = min((rows[k][0] for k in g if rows[k][0] is not None), default=None)
        out |= {k: least if sets[k] else rows[k][0] for k in g}
    return Counter((rows[k][0], len(sets[k]), out[k], rows[k][0] == out[k]) for k in out)


def test_near_duplicates(docs, rows, clashing, no_docs):
    got = neardup.document_components(docs)
    assert Counter(tuple(r) for r in got.collect()) == brute_components(rows)
    assert same_rows(got, neardup.document_components(clashing)) and neardup.document_components(no_docs).count() == 0


def test_large_groups_lose_no_link(spark, monkeypatch):
    """Many near copies of few texts, with nodes and groups that must branch and be dealt in blocks."""
    rng = random.Random(3)
    rows = []
    for b in range(3):
        words = prose(rng, 160).split()
        for _ in range(90):
            own = words[:]
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = prose(rng, 1)
            rows.append((len(rows) + 1000 * b, " ".join(own), "en", "s", 0))
    # a chain, each text near the next only, and texts that share much with one group but link with nothing
    chain = prose(rng, 200).split()
    for k in range(60):
        for place in range(4):
            chain[(7 * k + 50 * place) % 200] = f"c{k}{place}"
        rows.append((9000 + k, " ".join(chain), "en", "s", 0))
    base = rows[0][1].split()
    rows += [(9500 + k, " ".join(base[:100] + prose(rng, 60).split()), "en", "s", 0) for k in range(20)]
    df = spark.createDataFrame(rows, DOCS)
    for settings in ({"LEAF": 16, "GROUP": 32, "DEPTH": 3, "BLOCK_NODES": 40}, {"LEAF": 8, "GROUP": 7, "DEPTH": 4, "AGREE": 30}, {"GROUP": 3}):
        with monkeypatch.context() as m:
            for name, value in settings.items():
                m.setattr(neardup, name, value)
            assert Counter(tuple(r) for r in neardup.document_components(df).collect()) == brute_components(rows), settings


def test_recall_of_the_trees(spark, monkeypatch):
    """Pairs at the threshold, in nodes that must branch: how many are found as candidates."""
    rng, rows = random.Random(12), []
    for _ in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        other = words[:]
        other[60] = "changed"
        other[20] = "changed"
        rows += [(len(rows) + k, " ".join(t), "en", "s", 0) for k, t in enumerate((words, other))]
    monkeypatch.setattr(neardup, "LEAF", 2)
    df = spark.createDataFrame(rows, DOCS)
    classes = neardup.classes_of(neardup.materialise(neardup.sketches(df), "sketches"))
    of = {r["cid"]: r["rep"] for r in classes.collect()}
    found = {frozenset((of[r["a"]], of[r["b"]])) for r in neardup.tree_links(classes).collect()}
    assert sum(frozenset((k, k + 1)) in found for k in range(0, 600, 2)) == 300


def test_one_of_each(docs, rows, no_docs):
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {c for (d, n, c, own) in brute_components(rows) if n}
    got = Counter(r["doc_id"] for r in kept.collect() if shingles(r["text"]))
    assert set(got) == want and max(got.values()) == 1
    assert neardup.one_of_each(no_docs).count() == 0


def test_stage_links_at_eighty(spark):
    """The pipeline's stage against brute force at 80 percent, with pairs between 80 and 85; the query still links at 85."""
    rng, rows = random.Random(8), []
    for _ in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        other = words[:]
        for k in rng.sample(range(5, 95), rng.randrange(1, 4)):
            other[k] = "changed"
        rows += [(len(rows) + k, " ".join(t), "en", "s", 0) for k, t in enumerate((words, other))]
    sets = [shingles(r[1]) for r in rows]
    ratio = [100 * len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) for k in range(0, len(sets), 2)]
    assert sum(80 <= x < 85 for x in ratio) > 5 and any(x < 80 for x in ratio)
    df = spark.createDataFrame(rows, DOCS)
    want = {rows[2 * k + j][0] for k, x in enumerate(ratio) for j in range(1 if x >= 80 else 2)}
    assert {r["doc_id"] for r in neardup.one_of_each(df).collect()} == want
    assert Counter(tuple(r) for r in neardup.document_components(df).collect()) == brute_components(rows)


def test_star_rounds(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200 + rng.randrange(30), 200 + rng.randrange(30)) for _ in range(60)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if x in got} and {x for x in root if find(x) != x} <= set(got)
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(texts, w=200):
    c = Counter(t[k : k + w] for t in texts for k in range(len(t) - w + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - w + 1):
            if c[t[k : k + w]] > 1:
                gone[k : k + w] = True
        out.append(gone)
    return out


def test_suffix_array():
    rng = random.Random(1)
    assert repeats.suffix_array([]) == [] and repeats.suffix_array([5]) == [0]
    for _ in range(300):
        a = [rng.randrange(1, rng.choice([2, 3, 6])) for _ in range(rng.randrange(1, 50))]
        assert repeats.suffix_array(a) == sorted(range(len(a)), key=lambda k: a[k:])


def test_repeats(docs, rows, clashing, no_docs):
    texts = [(r[1] or "").encode() for r in rows]
    want = Counter()
    for r, t, gone in zip(rows, texts, brute_repeats(texts), strict=True):
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        want[r[0], len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    got = repeats.document_repeats(docs)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert sum(k[2] > 0 for k in want) > 10
    assert same_rows(got, repeats.document_repeats(clashing)) and repeats.document_repeats(no_docs).count() == 0


def test_hot_anchors_are_dealt_by_windows(spark, monkeypatch):
    """A passage in many texts with different surroundings, beside others: the windows of its anchors go another way."""
    rng = random.Random(10)
    passage = prose(rng, 90)
    rows = [(k, f"{prose(rng, rng.randrange(1, 30))} {passage} {prose(rng, rng.randrange(1, 30))}") for k in range(40)]
    other = prose(rng, 80)
    rows += [(100 + k, f"{prose(rng, 20)} {other[k * 30 :]} {prose(rng, 20)}") for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    texts = [t.encode() for _, t in rows]
    want = {k: hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest() for (k, _), t, gone in zip(rows, texts, brute_repeats(texts), strict=True)}
    for hot in (3, 4096):
        monkeypatch.setattr(repeats, "HOT", hot)
        assert {r["doc_id"]: r["kept_sha256"] for r in repeats.document_repeats(df).collect()} == want


def test_repeats_at_every_overlap(spark):
    rng, rows = random.Random(9), []
    for case in range(30):
        letters = ["ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyz"][case % 3]
        base = "".join(rng.choice(letters) for _ in range(1500))
        for _ in range(rng.randrange(2, 5)):
            t = "".join(base[(a := rng.randrange(1200)) : a + rng.randrange(195, 260)] + "".join(rng.choice(letters) for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(1, 4)))
            rows.append((len(rows), t))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in repeats.document_repeats(df).collect()}
    texts = [t.encode() for _, t in rows]
    for (k, _), t, gone in zip(rows, texts, brute_repeats(texts), strict=True):
        assert got[k] == (int(gone.sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())


def test_removed_texts(docs, rows, no_docs):
    texts = [(r[1] or "").encode() for r in rows]
    want = Counter()
    for r, t, gone in zip(rows, texts, brute_repeats(texts), strict=True):
        if not t or not gone.all():
            left = np.frombuffer(t, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
            want[r[0], left, r[2], r[3], len(left)] += 1
    assert Counter(tuple(r) for r in repeats.remove_repeats(docs).collect()) == want
    assert repeats.remove_repeats(no_docs).count() == 0


PAGE = '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Home</li></ul></nav><div class="ad">Buy</div>%s<footer>&copy; x</footer></body></html>'


def plain(page):
    return html.main_text(html.lines_of(page), None)


def test_article_of_a_page():
    article = "<article><h1>A &amp; B</h1><p><b>One\n two<br><p>th<i>re</i>e</p><aside>side</aside><div class='comments'>me too</div><form>f</form><p>Shared &eacute;&#x41;</p></article>"
    lines = html.lines_of(PAGE % article)
    assert html.main_text(lines, None) == "A & B\nOne two\nthree\nShared éA"
    assert html.main_text(lines, lines) == html.main_text(lines, None)
    assert html.lines_of("") == [] and html.main_text([], None) == ""
    assert plain("plain <b>text") == "plain text"
    assert plain("<p>cut here <a hr") == "cut here"
    assert plain('<script>var t="</p>";</script><!-- x --><p>a<p>b') == "a\nb"


def test_no_text_is_lost_to_broken_markup():
    assert plain('<p>before</p><svg class="icon"/><p>Body</p>') == "before\nBody"
    for tag in ("button", "svg", "select", "object", "title", "textarea", "iframe", "script", "style"):
        assert plain(f"<p>before</p><{tag}>x<p>Body</p><div>More</div>") == "before\nBody\nMore", tag
        assert plain(f"<p>before</p><{tag}>x</{tag}><p>Body</p>") == "before\nBody", tag
    assert plain("<p>before</p><!-- x <p>Body</p>") == "before\nBody"
    assert plain("<p>a < b and c > d</p>") == "a < b and c > d"
    assert plain('<p title="a > b">x</p><p title="open>y</p>') == "x\ny"


def test_class_words():
    assert plain("<article><p>Text</p><article class='comment'><p>reader</p></article></article>") == "Text"
    assert plain("<div class='entry-header'><h1>Title</h1></div><div class='content no-sidebar'><p>Text</p></div>") == "Title\nText"
    assert plain("<div class='sidebar-left'>a</div><div id='comment_list'>b</div><header>logo</header><div role='navigation'>c</div><p>Text</p>") == "Text"
    assert plain("<article><header><h1>Title</h1></header><p>Text</p></article><div class='post-comments'>c</div>") == "Title\nText"


@pytest.mark.parametrize("piece", ["<a ", "<a '", '<p title="', "<!--", "<script>", "<", "<button>", "<svg><p>", "<div>", "&amp", "</div>", "<a '>", '<x y="<b>" '])
def test_time_is_linear_in_the_page(piece):
    import time

    began = time.process_time()
    html.lines_of(piece * 20_000)
    assert time.process_time() - began < 5


def test_shared_lines_go():
    one, two = (html.lines_of(PAGE % f"<div><p>Read more here</p><p>{t}</p><p>Call us</p></div>") for t in ("First story", "Second story"))
    assert html.main_text(one, two) == "First story" and html.main_text(one, None) == "Read more here\nFirst story\nCall us"
    assert html.main_text(one, one) == "Read more here\nFirst story\nCall us"  # a copy is no template
    page = "<div><p>Top %s</p><p>Repeated</p><p>End %s</p></div><div><p>Call us</p></div>"
    one, two = (html.lines_of(PAGE % (page % (t, t))) for t in ("one", "two"))
    assert html.main_text(one, two) == "Top one\nRepeated\nEnd one"  # a passage within the text that only the page has


def test_differencing_decides_beside_a_declared_article():
    one, two = (html.lines_of(PAGE % f"<div><p>Read more here</p><p>Lead {t}</p></div><article><p>{t}</p><p>Shared</p></article><div><p>More {t}</p><p>Call us</p></div>") for t in ("one", "two"))
    assert html.main_text(one, two) == "Lead one\none\nShared\nMore one"
    part = html.lines_of(PAGE % "<div><p>Read more here</p><p>Story</p></div><main><p>Only a part</p></main>")
    assert html.main_text(part, two) == "Story\nOnly a part"
    # an element that is declared, but holds next to nothing that only this page has, is template
    one, two = (html.lines_of(f"<main><p>Our shop is open</p><p>{t}</p></main><div><p>{t * 50}</p></div>") for t in "xy")
    assert html.main_text(one, two) == "x\n" + "x" * 50


def test_longest_common_lines():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = sorted(html.common_lines(a, b))
        rest = iter(b)
        assert len(found) == best[-1][-1] and all(a[k] in rest for k in found)


def brute_pages(rows):
    """Every page against all pages of its host: neighbours by sorting, tables of lengths for common lines."""
    def place(url):
        rest = url.split("//", 1)[1]
        host, _, path = rest.partition("/")
        return host.lower(), "/" + path.split("?")[0].split("#")[0]

    order = sorted((*place(u), i, html.lines_of(h)) for i, u, h in rows)
    out = {}
    for at, (host, path, ident, lines) in enumerate(order):
        mine = [t for kind, _, t in lines if kind == html.OPEN]
        best = (-1, None)
        for step in (1, 2):
            for other in (at - step, at + step):
                if 0 <= other < len(order) and order[other][0] == host and [t for kind, _, t in order[other][3] if kind == html.OPEN] != mine:
                    common = 0
                    while common < min(len(path), len(order[other][1])) and path[common] == order[other][1][common]:
                        common += 1
                    if common > best[0]:
                        best = common, order[other][3]
        near = best[1]
        out[ident] = html.main_text(lines, near)
        if near is not None:
            texts = {t for _, _, t in near}
            kept = out[ident].split("\n")
            assert all(t in kept for t in mine if t not in texts)  # what only this page has stays
    return out


def test_pages_are_compared_alike_however_they_are_dealt(spark):
    rng = random.Random(8)
    rows = []
    for k in range(150):
        host = "big.org" if k % 3 else f"h{k % 7}.org"
        top, end = f"<p>Welcome to {host}</p>", f"<p>Imprint of {host}</p>"
        body = "".join(f"<p>{prose(rng, 6)}</p>" for _ in range(rng.randrange(1, 5)))
        rows.append((k, f"http://{host}/{rng.choice('abc')}/{rng.randrange(40)}?x={k}", f"<body>{top}<div>{body}</div>{end}</body>"))
    rows += [(200 + k, f"http://big.org/b/{k % 5}", rows[1][2]) for k in range(30)]  # copies
    want = brute_pages(rows)
    assert sum("Welcome" in t for t in want.values()) < 40
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    conf = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            assert {r["page_id"]: r["text"] for r in html.extract_pages(df.repartition(n)).collect()} == want, n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", conf)


def test_pages(spark):
    story = "<div><p>Read more here</p><p>%s</p></div>"
    rows = [(k, f"http://x.org/en/{k}?q=1", PAGE % (story % f"Story {k}"), "x", 1, 2, b"z") for k in range(6)]
    only = "https://y.org/a", PAGE % "<main><p>Only</p></main>", None, 1, 2, b"z"
    rows += [(10, None, None, "x", 1, 2, b"z"), (11, "not a url", "", "y", 1, 2, b"z"), (12, *only), (12, *only), (None, "http://z.org", "<p>No id</p>", "", 1, 2, b"z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, part int, host int, lines binary").repartition(3)
    got = html.extract_pages(df).collect()
    assert Counter((r["page_id"], r["url"], r["text"]) for r in got) == Counter([(k, f"http://x.org/en/{k}?q=1", f"Story {k}") for k in range(6)] + [(10, None, ""), (11, "not a url", ""), (12, "https://y.org/a", "Only"), (12, "https://y.org/a", "Only"), (None, "http://z.org", "No id")])
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.extract_pages(df.limit(0)).count() == 0


def brute_top(rows, k=10):
    held = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in held if i % 100 == 0}:
        own = min(v for i, v in held if i == q)
        near = sorted((-sum(map(int.__mul__, own, v)), i) for i, v in held if i != q and len(v) == len(own))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(near)}
    return out


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(k, (rng.normal(size=12) * rng.gamma(1.0)).tolist()) for k in range(700)]
    rows += [(700 + k, rows[3][1]) for k in range(150)] + [(900, None), (901, [1.0, None]), (1000, [float("nan")] * 12), (1100, [1.0, 2.0]), (1101, [3.0, -1.0]), (None, rows[0][1]), (1200, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, label int, length int").repartition(5)
    want = brute_top(rows)
    assert {tuple(r) for r in search.embedding_neighbours(df).collect()} == want
    for name, value in (("BLOCK", 64), ("QUERIES", 2), ("STEP", 16), ("SEED", 20), ("AT_ONCE", 1)):
        monkeypatch.setattr(search, name, value)
    assert {tuple(r) for r in search.embedding_neighbours(df).collect()} == want
    assert search.embedding_neighbours(df.limit(0)).count() == 0
    found = search.embedding_neighbours(df)
    found.collect()
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_top_k_of_large_components(spark):
    values = [(0, 70000.0), (1, 1e9), (2, 3e12), (3, 4e12), (4, -5e15), (100, 2e11), (5, 1e300), (6, -1.0)]
    most = (1 << 63) - 1
    got = sorted(map(tuple, search.embedding_neighbours(spark.createDataFrame([(k, [v]) for k, v in values], "vec_id long, embedding array<double>")).collect()))
    whole = {k: max(-most - 1, min(most, math.floor(1024 * v))) for k, v in values}
    want = []
    for q in (0, 100):
        best = sorted((-whole[k] * whole[q], k) for k in whole if k != q)
        want += [(q, rank + 1, k, max(-most, min(most, -s))) for rank, (s, k) in enumerate(best)]
    assert got == want


def test_pruning_leaves_work_out():
    rng = np.random.default_rng(6)
    vector = (rng.normal(size=(4000, 32)) * np.linspace(4, 0.1, 32) * 300 * rng.gamma(0.5, size=(4000, 1))).astype(np.int64)
    query = vector[:20]
    turn = search.rotation(vector[:500])
    best = search.search_block(np.arange(20), query, np.full(20, -np.inf), np.arange(4000), vector, turn, 10)
    for q in range(20):
        score = vector @ query[q]
        score[q] = -(1 << 62)
        assert best.rows[q][0].tolist() == sorted(score.tolist(), reverse=True)[:10]
    assert np.allclose(turn.T @ turn, np.eye(32))


def test_stages_take_empty_tables_and_clashing_columns(spark, docs, rows, labels, clashing, no_docs, tmp_path):
    """All stages on no rows, and the operators that keep further columns beside the same rows without them."""
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, no_docs, str(tmp_path))
        assert found.count() == 0 and (k == 4 or found.columns == no_docs.columns)
    keep = [c.split()[0] for c in DOCS.split(", ")]
    for run in (lambda d: quality.filter_documents(d, labels), neardup.one_of_each, repeats.remove_repeats):
        wide = run(clashing)
        assert wide.columns == clashing.columns
        assert sorted(map(repr, (tuple(r[c] for c in keep[:4]) for r in wide.collect()))) == sorted(map(repr, (tuple(r[c] for c in keep[:4]) for r in run(docs).collect())))
    assert same_rows(bpe.encode_documents(docs), bpe.encode_documents(clashing))


def test_pipeline(spark, rows, labels, tmp_path):
    """Each stage against brute force on what the stage before it kept."""
    sf = tmp_path / "sf"
    long = [(600 + k, prose(random.Random(k), 300), "en", f"src{k % 4}", 0) for k in range(8)]
    spark.createDataFrame([*rows, *long], DOCS).write.parquet(str(sf / "documents.parquet"))
    labels.write.parquet(str(sf / "labels.parquet"))
    docs, kept = spark.read.parquet(str(sf / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"stage{k}")
        stage(spark, docs, str(sf)).write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append([tuple(r) for r in docs.collect()])
        assert k == 4 or docs.columns == [c.split()[0] for c in DOCS.split(", ")]
    whole = quality.classify(spark.read.parquet(str(sf / "documents.parquet")), labels)
    assert Counter(r[0] for r in kept[0]) == Counter(r["doc_id"] for r in whole.filter("kept").collect())
    assert {r[0] for r in kept[1] if shingles(r[1])} == {c for (d, n, c, own) in brute_components(kept[0]) if n}
    texts = [(r[1] or "").encode() for r in kept[1]]
    left = [np.frombuffer(t, np.uint8)[~g].tobytes().decode("utf-8", "ignore") for t, g in zip(texts, brute_repeats(texts), strict=True) if not t or not g.all()]
    assert Counter(r[1] for r in kept[2]) == Counter(left)
    third = spark.read.parquet(str(tmp_path / "stage2"))
    words = lambda rows_: sum(len((r[1] or "").encode().split()) for r in rows_)
    assert words(kept[3]) == sum(r["taken"] for r in mixing.document_mix(third, labels).collect())
    assert Counter(r[0] for r in kept[4]) == Counter(r[0] for r in kept[3])
    assert Counter(r[0] for r in corpus_pipeline.run(spark, str(sf)).collect()) == Counter(r[0] for r in kept[4])


def test_rows_of_large_nodes_are_branched_once(spark, monkeypatch, tmp_path):
    """However often the children are read: their sizes, and they themselves."""
    whole, log = neardup._branch, str(tmp_path / "branched")

    def noted(batches):
        for batch in batches:
            with open(log, "a") as f:
                f.writelines(f"{k} {c}\n" for k, c in zip(batch.column("key").to_pylist(), batch.column("cid").to_pylist(), strict=True))
            yield from whole([batch])

    monkeypatch.setattr(neardup, "LEAF", 4)
    monkeypatch.setattr(neardup, "_branch", noted)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    text = " ".join(rng.choices(words, k=60))
    rows = [(k, f"{text} " + " ".join(rng.choices(words, k=60))) for k in range(60)]
    classes = neardup.classes_of(neardup.materialise(neardup.sketches(spark.createDataFrame(rows, "doc_id long, text string")), "sketches"))
    neardup.tree_links(classes).count()
    with open(log) as f:
        made = Counter(f)
    assert made and max(made.values()) == 1


def least_nodes(links):
    """The least node of the component of each linked node, by plain search."""
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    root = {}
    for k in sorted(near):
        todo = [] if k in root else [k]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = k
                todo += near[x]
    return root


@pytest.mark.parametrize("few", [0, 60, neardup.FEW])
def test_components_in_rounds_and_on_the_driver(spark, monkeypatch, few):
    """All in rounds, the last ones on the driver, and all on the driver; negative ids, repeated links, loops, a hub and a chain."""
    rng = random.Random(5)
    links = [(k + 1, k) for k in range(50)] + [(k, 500) for k in range(501, 600)] + [(-(1 << 62) + rng.randrange(40), rng.randrange(600, 700)) for _ in range(90)]
    links += [*links[:60], (7, 7), (900, 900)]
    monkeypatch.setattr(neardup, "FEW", few)
    got = neardup.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == least_nodes(links) and len(got) == len(least_nodes(links))
    none = neardup.components(spark.createDataFrame([(3, 3)], "a long, b long"))
    assert none.count() == 0 and none.columns == ["node", "root"]


@pytest.mark.parametrize("few", [0, neardup.FEW])
def test_neardup_whichever_way_components_are_found(spark, monkeypatch, docs, rows, few):
    monkeypatch.setattr(neardup, "FEW", few)
    monkeypatch.setattr(neardup, "GROUP", 3)
    assert Counter(tuple(r) for r in neardup.document_components(docs).collect()) == brute_components(rows)


def test_components_of_few_links_take_few_tasks(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(300)], "a long, b long").cache()
    links.count()
    spark.sparkContext.setJobGroup("few links", "components")
    try:
        assert {r["root"] for r in neardup.components(links).collect()} == {0}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    status = spark.sparkContext.statusTracker()
    stages = {k for job in status.getJobIdsForGroup("few links") for k in status.getJobInfo(job).stageIds}
    assert 0 < sum(status.getStageInfo(k).numCompletedTasks for k in stages if status.getStageInfo(k)) < 40


def test_a_child_is_made_once():
    """Also where a node chooses the same coordinate of its tree twice."""
    rng = np.random.default_rng(2)
    n = 2000
    columns = [pa.array(rng.integers(-(1 << 62), 1 << 62, n)), pa.array(rng.integers(0, neardup.TREES, n), pa.int32()), pa.array(range(n), pa.int64())]
    sketch = pa.array([x.tobytes() for x in rng.integers(0, 256, (n, neardup.COORDINATES), np.uint8)], pa.binary())
    made = pa.Table.from_batches(neardup._branch([pa.RecordBatch.from_arrays([*columns, sketch], names=["key", "tree", "cid", "sketch"])]))
    children = Counter(zip(made["key"].to_pylist(), made["cid"].to_pylist(), strict=True))
    assert max(children.values()) == 1 and {c for _, c in children} == set(range(n)) and n < len(children) < 2 * n
