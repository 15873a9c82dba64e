"""Media columns, HTML extraction, URL filters and embeddings against brute force."""

import hashlib
import html as html_lib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from barloom.llm import html_extract, media, pq_near, url_filter


def test_media_round_trip(spark):
    texts = [None, "", "a", "é" * 97, "x" * 192, "y" * 193, "line\nP6\n\n" * 50, "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/media-test/documents.parquet")
    out = {r["doc_id"]: r for r in media.op5_media_columns(spark, path.rsplit("/", 1)[0]).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-16:])
        stored = media.store(payload)
        assert media.read_back(stored) == payload
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert (r["position"], r["caption"]) == (1 if (t or "").strip() else 0, f"payload of {len(raw)} bytes")
    assert out[2]["feature"] == out[7]["feature"] and len({r["feature"] for r in out.values()}) > 4


def test_interleaved_sequence_keeps_positions_and_captions():
    seq = media.interleave('<p>One<figure><img src="sha256:ab" alt="alt"><figcaption>The <b>cap</b></figcaption></figure><script>no</script>two <img src="u.png" alt="x">three')
    assert [(s["position"], s["kind"], s["text"], s["caption"]) for s in seq] == [(0, "text", "One", None), (1, "img", None, "The cap"), (2, "text", "two", None), (3, "img", None, "x"), (4, "text", "three", None)]
    assert seq[1]["digest"] == "ab" and len(seq[3]["digest"]) == 64


@pytest.mark.parametrize(
    "html,want",
    [
        ('<figure><img src="sha256:aa"><figcaption>cap</figure><p>after text</p>', [("img", None, "cap"), ("text", "after text", None)]),
        ('<figure><figcaption>cap</figcaption><img src="sha256:aa"><img src="sha256:bb" alt="x"></figure>z', [("img", None, "cap"), ("img", None, "cap"), ("text", "z", None)]),
        ("a<figure><table><tr><td>1</table><figcaption>cap</figcaption></figure>z", [("text", "a", None), ("text", "1", None), ("text", "cap", None), ("text", "z", None)]),
        ("<p>a<figcaption>stray <b>words</b></figcaption>z", [("text", "a", None), ("text", "stray words", None), ("text", "z", None)]),
        ('<figure><img src="u"><figcaption>one<p>two<br>three', [("img", None, "one two three")]),
        ('<figure><figure><img src="u"><figcaption>in</figcaption></figure><img src="v" alt="w"><figcaption>out</figure>', [("img", None, "in"), ("img", None, "out")]),
        ("a<noscript><img src=u>b</noscript>c<template/>d", [("text", "acd", None)]),
    ],
)
def test_captions_that_are_not_closed_or_stand_alone(html, want):
    seq = media.interleave(html)
    assert [(s["kind"], s["text"], s["caption"]) for s in seq] == want and [s["position"] for s in seq] == list(range(len(want)))


@pytest.mark.parametrize("seed", range(40))
def test_no_words_are_lost_on_unbalanced_pages(seed):
    """Random tags, opened and closed anywhere: every visible word appears once, in page order."""
    rng, parts = np.random.default_rng(seed), []
    for k in range(60):
        tag = rng.choice(["p", "div", "b", "figure", "figcaption", "li", "ul", "td", "table", "span", "h2", "article", "i", "a"])
        parts.append(rng.choice([f"<{tag}>", f"</{tag}>", f"<{tag} class=k>", '<img src="u">', "<br/>", "<svg><path d=x/><path d=y/><g><path/></g></svg>"]))
        parts.append(f" w{k} ")
    html = "".join(parts)
    words = [f"w{k}" for k in range(60)]
    shown = [w for s in media.interleave(html) for w in (s["text"] or "").split()]
    captions = {w for s in media.interleave(html) for w in (s["caption"] or "").split()}
    assert len(shown) == len(set(shown)) and sorted({*shown} | captions) == sorted(words)
    nodes = html_extract.tree_of(html)
    assert html_extract.text_of(nodes, ~html_extract.silent(nodes)).split() == words


@pytest.mark.parametrize("n", [3, 9, 40])
def test_self_closing_and_unclosed_elements_hide_nothing_else(n):
    keep = lambda html: html_extract.text_of(nodes := html_extract.tree_of(html), ~html_extract.silent(nodes))
    assert keep("<article><p>A</p><svg>" + '<path d="x"/>' * n + "</svg><p>B</p></article>") == "A\n\nB"
    assert keep("<p>A<noscript>" + "<b>no " * n + "</noscript><p>B") == "A\n\nB"
    assert keep("<html><head><title>T</title><meta x><p>A" + "<b>" * n + "</p>B") == "A\n\nB"
    assert keep("<head><style>s</style>A" + "<div/>" * n + "B") == "A\n\nB"


def test_digest_join_leaves_unknown_media(spark):
    pages = spark.createDataFrame([(1, '<img src="sha256:00"><img src="sha256:%s">' % hashlib.sha256(b" " * 192).hexdigest())], "page_id long, html string")
    stored = media.resolved(media.media_table(spark.createDataFrame([(bytearray(b" " * 192),)], "payload binary")))
    rows = media.references(media.sequences(pages, ["page_id"]), ["page_id"]).join(stored, "digest", "left").orderBy("position").collect()
    assert [r["payload_bytes"] for r in rows] == [None, 192]


NOISE = '<div class="cookie-notice"><p>We use cookies.</p></div><nav><ul><li><a href="/a">Home</a></li></ul></nav><aside class="sidebar"><p>Other stories</p></aside>'


def page(i: int, style: str = "article") -> tuple[str, str]:
    body = [f"Paragraph {i} {k} with some words, and a clause." * (1 + k) for k in range(4)]
    inside = f"<h1>Title {i}</h1>" + "".join(f"<p>{b}</p>" for b in body[:2]) + f'<div class="ad">Buy {i}</div>' + "".join(f"<p>{b}<br>" for b in body[2:])
    comments = '<section class="comments"><p>First! A reader comment.</p></section><form><label>Mail</label></form>'
    opening, closing = {"article": ("<article>", "</article>"), "div": ('<div class="post-content">', "</div>")}[style]
    html = f"<html><head><title>T</title><script>var t='</p>'</script></head><body>{NOISE}{opening}{inside}{closing}{comments}<footer>&copy; x</footer></body></html>"
    return html, "\n\n".join([f"Title {i}", *body])


def test_extraction_of_pages_and_layouts():
    model = html_extract.fit([page(i, "article" if i % 2 else "div")[0] for i in range(60)])
    html, want = page(100)
    assert html_extract.extract(html, model) == want
    assert html_extract.extract("", model) == "" and html_extract.extract(None, None) == ""


def test_decoding_is_consistent():
    nodes = html_extract.tree_of("<div><p>a</p><div><p>b</p></div></div>")
    kept = html_extract.decode(nodes, np.zeros(len(nodes), bool), np.array([1, 1, 1, -3, 2.0]))
    assert kept.tolist() == [True, True, True, False, False]


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    model = html_extract.Boosted(x, y, np.ones(2000))
    assert ((model.logits(x) > 0) == (y > 0)).mean() > 0.95


def test_extraction_on_the_given_pages(spark):
    import re

    out = html_extract.op9_html_extract(spark, "/root/testdata/sf0.001").collect()
    html = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    for r in out:
        inside = re.search(r"<article>(.*?)(</article>|$)", html[r["page_id"]], re.S)[1]
        words = html_lib.unescape(re.sub(r"<[^>]+>", " ", inside)).split()
        assert r["text"].split() == words and r["n_chars"] == len(r["text"])


def host_and_path(url):
    import re

    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return ("", "") if not m else ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2])


def test_url_rules(spark):
    urls = [None, "x", "http://a.com/en/1", "https://EXAMPLE.com/en/7/x?q", "http://notexample.com/en/7", "http://b.net/de/", "ftp://example.net/de/8#f", "http://x.org/es/", "http://com/en/", "a://b://c.com/en/", "http://h.com?/en/", "http://z.org/en/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    for r in url_filter.judge(pages).collect():
        host, path = host_and_path(urls[r["page_id"]])
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"]) == (host, path)
        if fits:
            assert (r["rule"], r["verdict"]) == max(fits)[1:]
        else:
            assert r["rule"] is None and r["verdict"] in ("allow", "block")


def settle(seed, edges):
    """Personalised PageRank by power iteration; edges: (src, dst) to pages."""
    out, now = {}, dict(seed)
    for (s, _), n in edges.items():
        out[s] = out.get(s, 0) + n
    for _ in range(300):
        then = {h: 0.15 * s for h, s in seed.items()}
        for (s, d), n in edges.items():
            then[d] = then.get(d, 0) + 0.85 * now.get(s, 0) * n / out[s]
        now = then
    return now


def test_propagation_matches_power_iteration(spark):
    edges = {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1, ("c", "a"): 3, ("c", "d"): 1, ("e", "a"): 1}
    seeds = spark.createDataFrame([("trust", "a", 0.75), ("trust", "e", 0.25), ("distrust", "d", 1.0)], "kind string, host string, seed double")
    shares = url_filter.directed_shares(spark.createDataFrame([(*e, n) for e, n in edges.items()], "src string, dst string, n long"))
    rank = {(r["kind"], r["host"]): r["rank"] for r in url_filter.propagate(seeds, shares).collect()}
    assert {h: v for (k, h), v in rank.items() if k == "trust"} == pytest.approx(settle({"a": 0.75, "e": 0.25}, edges))
    assert {h: v for (k, h), v in rank.items() if k == "distrust"} == pytest.approx(settle({"d": 1.0}, {e[::-1]: n for e, n in edges.items()}))


def test_links_lead_to_their_hosts(spark):
    links = {'<a href="https://b.com/">': {"b.com"}, "<a href='//C.com/x?y'>": {"c.com"}, "<img src=http://d.com:8/p.png>": {"d.com:8"}, '<a href="/x">': {"a.com"}, '<a href="x:y/z">': set(), '<a href="page.html#t">': {"a.com"}}
    links |= {'<a href="mailto:x@e.com">': set(), '<a href="#top">': set(), '<a href="">': set(), '<a href="javascript:go()">': set(), '<a href=" HTTPS://f.com ">': {"f.com"}, 'text href="https://g.com/"': set(), '<a\nclass=k href="?q=https://h.com/">': {"a.com"}, '<p data-href="https://i.com/">': set()}
    pages = [(i, "a.com", tag) for i, tag in enumerate(links)] + [(99, "a.com", "".join(links)), (100, "", "".join(links)), (101, "a.com", None)]
    out = url_filter.host_edges(spark.createDataFrame(pages, "page_id long, host string, html string")).collect()
    want = {}
    for to in [*links.values(), set().union(*links.values())]:
        for host in to:
            want[host] = want.get(host, 0) + 1
    assert {r["dst"]: r["n"] for r in out} == want and {r["src"] for r in out} == {"a.com"}


def test_verdicts_on_a_graph_match_brute_force(spark):
    """50 hosts, links of all kinds, rules and ranks against a plain version."""
    rng = np.random.default_rng(3)
    hosts = [f"h{k}.{t}" for k, t in enumerate(rng.choice(["com", "net", "org", "info"], 50))]
    rows, edges, votes = [], {}, {"allow": {}, "block": {}}
    for i in range(400):
        host, path = hosts[rng.integers(50)], rng.choice(["/en/1", "/de/8", "/es/2", "/fr/3", ""])
        to = set(rng.choice(hosts, rng.integers(0, 4)).tolist()) - {host}
        tags = [rng.choice([f'<a href="https://{h}/x">', f"<img src='//{h}'>", f"<a href=http://{h.upper()}?q>"]) for h in sorted(to)]
        local = rng.random() < 0.3
        rows.append((i, f"https://{host}{path}", " ".join([*tags, *tags, '<a href="/own">' * bool(local), '<a href="mailto:m@x.org">'])))
        for d in [*to, *[host] * bool(local)]:
            edges[host, d] = edges.get((host, d), 0) + 1
        for h, p, v in url_filter.RULES:
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                votes[v][host] = votes[v].get(host, 0) + 1
    share = lambda v: {h: n / sum(v.values()) for h, n in v.items()}
    trust, distrust = settle(share(votes["allow"]), edges), settle(share(votes["block"]), {e[::-1]: n for e, n in edges.items()})
    seen = set()
    for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert (r["trust"], r["distrust"]) == pytest.approx((trust.get(r["host"], 0), distrust.get(r["host"], 0)), abs=1e-8)
        if r["rule"] is None and abs(r["trust"] - r["distrust"]) > 1e-7:
            assert r["verdict"] == ("block" if r["distrust"] > r["trust"] else "allow")
            seen.add(r["verdict"])
    assert seen == {"allow", "block"}


def test_distrust_reaches_hosts_that_link_to_blocked_ones(spark):
    rows = [(1, "http://bad.org/es/1", ""), (2, "http://friend.info/", '<a href="http://bad.org/x">'), (3, "http://good.net/de/", '<a href="//liked.info/">'), (4, "http://liked.info/", "")]
    out = {r["host"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {"bad.org": "block", "friend.info": "block", "good.net": "allow", "liked.info": "allow"}


def test_distrust_settles_on_a_chain_of_hosts(spark):
    """Each host links to the one before it, the first to nothing; the first is blocked. A limit too small raises."""
    hosts = [f"h{k}.info" if k else "bad.org" for k in range(15)]
    rows = [(k, f"http://{h}/es/", f'<a href="//{hosts[k - 1]}/">' if k else "") for k, h in enumerate(hosts)]
    out = {r["host"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [out[h]["distrust"] for h in hosts] == pytest.approx([0.15 * 0.85**k for k in range(15)])
    assert {r["verdict"] for r in out.values()} == {"block"}
    shares = url_filter.directed_shares(spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, n long"))
    with pytest.raises(RuntimeError):
        url_filter.propagate(spark.createDataFrame([("trust", "a", 1.0)], "kind string, host string, seed double"), shares, rounds=10)


def test_near_vectors_match_brute_force(spark, monkeypatch):
    """Small lists and blocks, a large clique, vectors of any length."""
    monkeypatch.setattr(pq_near, "BLOCK", 32)
    monkeypatch.setattr(pq_near, "LIST_SIZE", 64)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 64))
    x[100:300] = x[0] + rng.normal(size=(200, 64)) * 0.08
    x[300:400] = x[1:101] + rng.normal(size=(100, 64)) * 0.2
    x *= rng.random((900, 1)) * 5 + 0.1
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = {r["vec_id"]: r for r in pq_near.near_vectors(df).collect()}
    found = sum(r["n_links"] for r in out.values())
    assert 0.99 <= found / (linked.sum() - 900) <= 1
    assert all(out[i]["n_links"] <= linked[i].sum() - 1 for i in out)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out.values())


@pytest.mark.parametrize("dim", [64, 6])
def test_near_vectors_of_a_group_over_many_lists(spark, monkeypatch, dim):
    """A third of the vectors in one group of over 30 lists; in few dimensions lists have many neighbours."""
    monkeypatch.setattr(pq_near, "BLOCK", 128)
    monkeypatch.setattr(pq_near, "LIST_SIZE", 20)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2400, dim))
    x[:800] = x[0] / np.linalg.norm(x[0]) + rng.normal(size=(800, dim)) * 0.17 / np.sqrt(dim)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert 0.96 <= (u[:800] @ u[:800].T).mean() <= 0.99
    assert len(set(((u[:800, None] - pq_near.k_means(u, 120)[None]) ** 2).sum(2).argmin(1))) > 30
    linked = u @ u.T >= 0.95
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = sum(r["n_links"] for r in pq_near.near_vectors(df).collect())
    assert 0.999 <= found / (linked.sum() - 2400) <= 1
    out = {r["vec_id"]: r for r in pq_near.near_vectors(df, miss=0).collect()}
    assert {i: r["n_links"] for i, r in out.items()} == dict(enumerate(linked.sum(1) - 1))
    classes = np.arange(2400)
    while True:
        then = np.where(linked, classes[None], 2400).min(1)
        if (then == classes).all():
            break
        classes = then
    assert {i: r["component_id"] for i, r in out.items()} == dict(enumerate(classes))


def test_recall_of_pairs_at_the_threshold(spark):
    """Partners at cosines of 0.95 to 0.97 in random directions, the hardest for the probes; a group of copies."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(10_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    way = rng.normal(size=x.shape)
    way -= (way * x).sum(1, keepdims=True) * x
    cosine = rng.uniform(0.95, 0.97, (len(x), 1))
    rows = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * way / np.linalg.norm(way, axis=1, keepdims=True), np.repeat(x[:1], 3000, axis=0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    out = {r["vec_id"]: r for r in pq_near.near_vectors(df).collect()}
    assert out[0]["n_links"] == 3001 and all(out[i]["n_links"] == 3001 and out[i]["component_id"] == 0 and not out[i]["kept"] for i in range(20_000, 23_000))
    assert sum(out[i]["n_links"] >= 1 and out[i + 10_000]["component_id"] == i for i in range(10_000)) >= 9_990


def test_near_vectors_of_each_dimension(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.99, 0.01, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [1.0, 0.0]), (5, [2.0, 0.1]), (6, [3.0]), (7, [1.0, 0.1, 0.0, 0.0])]
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pq_near.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert out == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (0, 7)}


def test_rows_that_repeat_an_id_are_compared_like_others(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.01]), (5, [-1.0, 0.0]), (5, [-1.0, 0.0]), (None, [1.0, 0.0]), (6, None)]
    out = pq_near.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in out), key=repr) == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (5, 1, 5, True), (5, 1, 5, True), (0, 0, None, True), (6, 0, 6, True)], key=repr)


def made_page(rng, marked):
    """A page of divs with class names of no meaning, and its article."""
    word = lambda: "".join(rng.choice("абвгдежзик") for _ in range(rng.randrange(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    name = lambda: f"{word()[:2]}{rng.randrange(99)}"
    links = lambda n: "".join(f'<li><a href="/{i}">{word()} {word()}</a></li>' for i in range(n))
    blocks = [prose(rng.randrange(25, 70)) for _ in range(rng.randrange(3, 9))]
    body = "".join(f"<p>{b}</p>" for b in blocks)
    article = f"<article>{body}</article>" if marked else f'<div class="{name()}">{body}</div>'
    menu, side, foot = f'<div class="{name()}"><ul>{links(8)}</ul></div>', f'<div id="{name()}"><ul>{links(5)}</ul></div>', f'<div class="{name()}"><a href="/i">{word()}</a> <a href="/c">{word()}</a></div>'
    return f"<html><body>{menu}<div>{article}{side}</div>{foot}</body></html>", blocks


def overlap(got, want):
    got, want = Counter(got.split()), Counter(" ".join(want).split())
    both = (got & want).total()
    return 2 * both / max(1, got.total() + want.total())


@pytest.mark.parametrize("share", [0.0, 0.5])
def test_articles_of_pages_without_marks(share):
    rng = random.Random(12)
    pages = [made_page(rng, rng.random() < share) for _ in range(160)]
    model = html_extract.fit([html for html, _ in pages[:60]])
    scores = [overlap(text, want) for text, (_, want) in zip(html_extract.extract_all([html for html, _ in pages[60:]], model), pages[60:], strict=True)]
    assert model is not None and sum(scores) / len(scores) > 0.95


def told_page(rng, marked, mixed):
    """Paragraphs of an article among notices that only their class tells apart, and its paragraphs."""
    word = lambda: "".join(rng.choice("abcdefghik") for _ in range(rng.randrange(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    blocks = [prose(rng.randrange(25, 70)) for _ in range(rng.randrange(3, 9))]
    kept = [f'<p class="vorn">{b}</p>' for b in blocks]
    notices = [f'<p class="zqx">{prose(rng.randrange(25, 70))}</p>' for _ in range(rng.randrange(1, 4))]
    if mixed:
        for notice in notices:
            kept.insert(rng.randrange(len(kept)), notice)
    menu = "<ul>" + "".join(f'<li><a href="/{i}">{word()}</a></li>' for i in range(8)) + "</ul>"
    opening, closing = ("<article>", "</article>") if marked else (f'<div class="k{rng.randrange(99)}">', "</div>")
    return f"<html><body><div>{menu}</div><div>{opening}{''.join(kept)}{closing}{'' if mixed else ''.join(notices)}</div></body></html>", blocks


def test_meaning_of_attribute_tokens_is_learned():
    """Where pages mark their article, notices stand outside; where they don't, only the token zqx tells a notice."""
    rng = random.Random(5)
    model = html_extract.fit([told_page(rng, True, False)[0] for _ in range(100)])
    zqx, vorn, unknown = (model.odds[html_extract.bucket(t)] for t in ("zqx", "vorn", "wharp"))
    assert zqx < -1 < unknown == 0 < vorn
    pages = [told_page(rng, False, True) for _ in range(100)]
    texts = html_extract.extract_all([html for html, _ in pages], model)
    got, want = [set(text.split("\n\n")) for text in texts], [set(blocks) for _, blocks in pages]
    notices = sum(html.count("zqx") for html, _ in pages)
    assert all(w <= g for g, w in zip(got, want, strict=True))
    assert sum(len(g - w) for g, w in zip(got, want, strict=True)) < notices / 3
