import random

from gradeloom.llm.template_extraction import blocks_of, extract_main_text, host_of

RNG = random.Random(7)


def prose(n):
    return " ".join(f"w{RNG.randrange(5000)}" for _ in range(n))


def page(host, i, body, close=True):
    menu = "".join(f"<li><a href='/{k}'>Menu {k}</a></li>" for k in range(3 + i % 3))
    html = (
        f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>"
        f"<nav><ul>{menu}</ul></nav><!-- x --><div class=ad>Buy now {host}</div><div id='content'>{body}"
        f"<div class='comments'><p>First! {prose(40)}</p></div></div><footer>&copy; {host}</footer>"
    )
    return (i, f"http://{host}/{i}", html + ("</body></html>" if close else ""))


def test_articles_are_found_on_each_host(spark):
    rows, wanted = [], {}
    for i in range(40):
        first, second = prose(30), prose(25)
        host = "a.example" if i % 4 else "b.example"
        body = f"<h1>Title {i} &amp; more</h1><p>{first}\n  <b>bold</b><p>{second}<br>x<aside>See also</aside>"
        rows.append(page(host, i, body, close=i % 5 > 0))
        wanted[i] = f"Title {i} & more\n{first} bold\n{second} x"
    rows.append(page("a.example", 1, rows[1][2], True)[:2] + (rows[1][2],))
    rows += [(100, None, None), (101, "http://[broken", ""), (102, "http://c.example/", "no markup at all &lt;b&gt;")]
    schema = "page_id long, url string, html string"
    got = extract_main_text(spark.createDataFrame(rows, schema).repartition(3)).collect()
    assert len(got) == len(rows)
    for row in got:
        expected = {100: "", 101: "", 102: "no markup at all <b>"}.get(row.page_id, wanted.get(row.page_id))
        assert row.text == expected


def test_long_page_empty_table_and_clashing_names(spark):
    text = prose(60_000)
    schema = "page_id long, url string, html string, text int, _group int"
    row = extract_main_text(spark.createDataFrame([(1, "http://x/", f"<body><article><p>{text}", 3, 4)], schema)).first()
    assert row.text == text
    assert extract_main_text(spark.createDataFrame([], schema)).count() == 0


def test_blocks_and_hosts():
    found = [(p, t) for p, out, t in blocks_of("<body><p>a<p>b<ul><li>c<li>d</ul>e<script>x</script><") if t and not out]
    assert found == [("/body/p", "a"), ("/body/p", "b"), ("/body/ul/li", "c"), ("/body/ul/li", "d"), ("/body", "e")]
    assert host_of("HTTP://User@Ex.Com:80/p") == "ex.com" and host_of(None) == host_of("http://[x") == ""


SCHEMA = "page_id long, url string, html string"


def texts_of(spark, rows):
    got = extract_main_text(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    return {r.page_id: r.text for r in got}


def test_copies_and_small_vocabularies_keep_their_texts(spark):
    articles = [(f"Title {i}", prose(30), prose(25)) for i in range(20)]
    rows, wanted = [], {}
    for i in range(1000):
        title, first, second = articles[i % 20]
        rows.append((i, "http://copies.example/", f"<body><nav>Menu</nav><article><h1>{title}</h1><p>{first}<p>{second}</article>"))
        wanted[i] = f"{title}\n{first}\n{second}"
        rows.append((1000 + i, "http://one.example/", f"<body><article><h1>Only title</h1><p>{articles[0][1]}</article>"))
        wanted[1000 + i] = f"Only title\n{articles[0][1]}"
    for i in range(300):
        text, told = prose(30), ("Yes", "No")[i % 2]
        html = f"<body><div id=content><h2>Background</h2><p>{text}</p><h3>{told}</h3><div class=motto>Same words</div></div>"
        rows.append((3000 + i, "http://few.example/", html))
        wanted[3000 + i] = f"Background\n{text}\n{told}"
    assert texts_of(spark, rows) == wanted


def test_names_do_not_remove_the_article(spark):
    rows, wanted = [], {}
    shapes = [
        "<article><header class='entry-header'><h1>{t}</h1></header><p>{p}</p>{c}</article>",
        "<article><div class='post-header'><h1>{t}</h1></div><p>{p}</p>{c}</article>",
        "<div id=content><h1 class='page-header'>{t}</h1><p>{p}</p>{c}</div>",
        "<article class='legal'><h1>{t}</h1><p>{p}</p>{c}</article>",
        "<div id='discussion'><h1>{t}</h1><p>{p}</p></div>{c}",
        "<div><article class='widget'><h1>{t}</h1><p>{p}</p></article></div>{c}",
    ]
    for k, shape in enumerate(shapes):
        for i in range(12):
            title, text = f"Title {i}", prose(60)
            body = shape.format(t=title, p=text, c=f"<div class='comments'><p>{prose(8)}</p></div>")
            rows.append((100 * k + i, f"http://h{k}.example/", f"<body><nav>Menu</nav>{body}<footer>x</footer>"))
            wanted[100 * k + i] = f"{title}\n{text}"
    assert texts_of(spark, rows) == wanted


def test_ids_name_an_element_as_a_whole_only(spark):
    rows, wanted = [], {}
    heads = ["<h2 id='social-effects'>{h}</h2>", "<h2 id='discussion'>{h}</h2>", "<section id='menu-planning'><p>{h}</p></section>"]
    for k, head in enumerate(heads):
        for i in range(12):
            title, text, h = f"Title {i}", prose(60), prose(4)
            body = f"<article><h1>{title}</h1>{head.format(h=h)}<p>{text}</p></article><div id='sidebar'><p>{prose(5)}</p></div>"
            rows.append((100 * k + i, f"http://i{k}.example/", f"<body><nav>Menu</nav>{body}<footer>x</footer>"))
            wanted[100 * k + i] = f"{title}\n{h}\n{text}"
    assert texts_of(spark, rows) == wanted
