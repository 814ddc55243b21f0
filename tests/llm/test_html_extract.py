import pytest

from sawmill.llm import html_extract as H


@pytest.mark.parametrize(
    "source, text",
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
        ("<body><nav>menu</nav><article><h1>T</h1><p>a  b\n c<p>d<br>e</article><footer>f</footer>", "T\na b c\nd e"),
        ('<div class="sidebar">x</div><main><div>one</div><div class="ad">buy</div>two</main>', "one\ntwo"),
        ("<article><p>1 &lt; 2 &eacute;&nbsp;&#x41;</p><script>if (a<b) {'</p>'}</script><style>p{}</style><p>3</p></article>", "1 < 2 é A\n3"),
        ('<article><p>x <span class="promo">no</span> y</p><section class="comments"><p>nice</p></section><article class="comment">me too</article></article>', "x y"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a\nb\nc\nd\ne"),
        ("<p>never closed <b>bold<!-- comment", "never closed bold"), ("</div></p>stray<p hidden>h</p>", "stray"), ("a < b and c > d", "a < b and c > d"),
    ],
)
def test_main_text(source, text):
    assert H.main_text(source, None) == text


def page(i, words):
    paras = "".join(f"<div class='t{i % 2}'><p>{w} {i}</p></div>" for w in words)
    return f"<html><head><title>t</title></head><body><div id='top'><a href='/'>Home</a></div><div id='body-{i}'><h1>Head {i}</h1>{paras}</div><div class='foot'>Copyright somebody</div></body></html>"


def test_the_template_tells_the_main_slot(spark):
    rows = [(i, f"https://x.example/{i}", page(i, ["some words of text " * 5, "and further ones " * 7]), "clash") for i in range(6)]
    rows += [(10, "https://y.example/a", "<body><article>A</article></body>", ""), (11, None, None, None), (11, None, None, None)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")
    out = {r["page_id"]: r for r in H.extract(d).collect()}
    assert out[3]["text"].split("\n")[0] == "Head 3" and "Home" not in out[3]["text"] and "Copyright" not in out[3]["text"]
    assert out[3]["n_chars"] == len(out[3]["text"]) and out[10]["text"] == "A" and out[11]["text"] == "" and out[11]["n_chars"] == 0
    assert H.extract(d).count() == len(rows) and H.extract(d.limit(0)).count() == 0
    assert {r["page_id"]: r["text"] for r in H.extract(d, broadcast_slots=0).collect()} == {i: r["text"] for i, r in out.items()}
    valid = [r for r in H.classes(H.tokens(d)).collect() if r["pages"] == 6]
    assert len({r["class_id"] for r in valid}) == 1 and sum(not r["text"] for r in valid) == 4 and sum(r["text"] for r in valid) == 2


def vectors(sources):
    """Brute force: the occurrence vector of every token of a host's pages, built outright."""
    out = {}
    for i, source in enumerate(sources):
        p = H.Page(source or "")
        for path, _, _, slots, _, never, _ in p.elements:
            if not never and slots and slots[-1] == path:
                out.setdefault((False, path), [0] * len(sources))[i] += 1
        for text, at in p.blocks:
            out.setdefault((True, H.hash_path(p.elements[at][0], text)), [0] * len(sources))[i] += 1
    return {k: tuple(v) for k, v in out.items()}


def unnamed(i, comments=""):
    """A page whose containers have no telling names."""
    story = "".join(f"<p>Part {k} of {i} {'tale ' * (5 + (7 * i + k) % 9)}</p>" for k in range(4))
    tip = ["Buy one and get two.", "Never again be late.", "Read more tomorrow."][i % 3]
    return f"<body><div class='a'><p>Start</p><p>Contact</p></div><div class='b'><p>{tip}</p></div><div class='c'><h1>Story {i}</h1>{story}<div class='d'><p>Prices include tax.</p></div>{comments}</div><div class='e'>Rights reserved</div></body>"


def test_classes_are_those_of_equal_vectors(spark):
    import random

    rng = random.Random(2)
    sources = [unnamed(i) for i in range(9)] + [unnamed(9).replace("<div class='e'>", "<div class='f'>"), None, "<p>odd", unnamed(3).replace("Start", "Begin") + "<div class='a'>two</div>"]
    sources += [f"<body>{''.join(rng.choice(['<div class=q>', '<ul>', '<p>x</p>', '</div>', '<section>', 'text']) for _ in range(30))}" for _ in range(4)]
    d = spark.createDataFrame([(i, f"https://h.example/{i}", s) for i, s in enumerate(sources)], "page_id long, url string, html string").repartition(3)
    want = vectors(sources)
    holders: dict = {}
    for token, v in want.items():
        holders.setdefault(v, set()).add(token)
    n = sum(any(v[i] for v in want.values()) for i in range(len(sources)))
    valid = {v: t for v, t in holders.items() if len(t) > 1 and 2 * sum(x > 0 for x in v) > n and 2 * sum(x == 1 for x in v) > sum(x > 0 for x in v)}
    got: dict = {}
    for r in H.classes(H.tokens(d)).collect():
        assert r["host_pages"] == n
        got.setdefault(r["class_id"], set()).add((r["text"], r["token"]))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, valid.values())) and got


def test_classes_tell_unnamed_boilerplate(spark):
    """Menus, rotating notices and notes within the main slot go without any name; without classes they stay."""
    rows = [(i, f"https://u.example/{i}", unnamed(i)) for i in range(12)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    told = {r["page_id"]: r["text"] for r in H.extract(d).collect()}
    off = {r["page_id"]: r["text"] for r in H.extract(d, members=10**9).collect()}
    for i in range(12):
        assert told[i].split("\n")[0] == f"Story {i}" and len(told[i].split("\n")) == 5 and all(x.startswith("Part") for x in told[i].split("\n")[1:])
        assert "Start" in off[i] and "Rights" in off[i]


def test_lists_only_break_ties(spark):
    """Varying comments go by their name; an article in a container of such a name stays, as all varying text is there."""
    rows = [(i, f"https://v.example/{i}", unnamed(i, f"<div class='comments'><p>I liked it {i} {'so ' * i}</p></div>")) for i in range(8)]
    rows += [(100 + i, f"https://w.example/{i}", unnamed(i).replace("class='c'", "class='social share'")) for i in range(8)]
    out = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("liked" not in out[i] and out[i].startswith(f"Story {i}\nPart 0") and "Prices" not in out[i] for i in range(8))
    assert all(out[100 + i].startswith(f"Story {i}\nPart 0") and "Start" not in out[100 + i] for i in range(8))


def test_odd_pages_leave_the_template(spark):
    rows = [(i, f"https://x.example/{i}", page(i, ["some words of text " * 5, "and further ones " * 7])) for i in range(6)]
    odd = [None, "", "<p>oops", "<html><body><h1>Not found</h1></body></html>", page(9, ["more of it " * 9]).replace("<div id='body-9'>", "<div id='body-9'>intro</div><div id='body-9'>")]
    for some in ([o] for o in odd[:4]), [odd]:
        for extra in some:
            d = spark.createDataFrame(rows + [(20 + k, f"https://x.example/o{k}", o) for k, o in enumerate(extra)], "page_id long, url string, html string")
            out = {r["page_id"]: r["text"] for r in H.extract(d).collect()}
            assert all(out[i].startswith(f"Head {i}") and "Home" not in out[i] and "Copyright" not in out[i] for i in range(6))
            assert all(o is None or o == "" or out[20 + k] for k, o in enumerate(extra))


def test_equal_text_within_the_main_slot_is_template(spark):
    same = "<div class='info'>All prices include tax.</div>"
    sources = [f"<body><div class='text'><p>Story {i} {'word ' * 30}</p>{same}<p>End {i}</p></div></body>" for i in range(7)]
    d = spark.createDataFrame([(i, f"http://s.example/{i}", x) for i, x in enumerate(sources)] + [(90 + i, f"http://t.example/{i}", sources[0]) for i in range(7)], "page_id long, url string, html string")
    for most in (200_000, 0):
        out = {r["page_id"]: r["text"] for r in H.extract(d, broadcast_slots=most).collect()}
        assert all(out[i].startswith(f"Story {i} word") and out[i].endswith(f"End {i}") and "prices" not in out[i] for i in range(7))
        assert all("prices" in out[90 + i] for i in range(7))


def test_copies_keep_their_text(spark):
    same = "<body><article><p>same</p></article></body>"
    d = spark.createDataFrame([(i, "http://z.example/", same) for i in range(5)], "page_id long, url string, html string")
    assert [r["text"] for r in H.extract(d).collect()] == ["same"] * 5


def test_deep_and_long():
    assert H.main_text("<div>" * 20_000 + "x" + "</div>" * 20_000, None) == "x"
    assert len(H.main_text("<p>" + "word " * 300_000, None)) == 5 * 300_000 - 1
