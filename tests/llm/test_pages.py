import pytest

from crawlweave.llm import body as B
from crawlweave.llm import pagetree as P
from crawlweave.llm import prose, residue, spam

TEXT = "The slow backup shows the catalogue of the ticket in the small office."


def page(body, head="How the page works", box='div class="main"', extra=""):
    h = f"<h1>{head}</h1>" if head else ""
    return f"""<html><head><title>{head}</title></head><body>
<ul><li><a href="/">Home</a></li><li><a href="/help">Help</a></li></ul>
<{box}>
{h}
{body}
</{box.split()[0]}>
<div class="side"><h3>Popular</h3><li><a href="/x">Some other page</a></li><p>{TEXT}</p></div>
<div class="foot"><p>&copy; 2020 Site</p>{extra}</div></body></html>"""


def lines(raw, **k):
    s = B.split_page(raw, "http://s.test/a", **k)
    return [s.text(n - 1) for n in sorted([*s.body, *s.closing])]


def test_body_without_boilerplate():
    raw = page(f'<div class="by">By Ann Bee on 2022-01-02</div>\n<p>{TEXT}\nSecond line of it.</p>\n<div class="rel">Read also: <a href="/y">Another article of this site</a></div>\n<pre><code>x = 1</code></pre>\n<p>Price: 12.5 credits</p>\n<div class="share">Like this? Share it</div>\n<li><a href="http://o.test/share?u=1" class="soc">Share</a></li>')
    assert lines(raw) == ["How the page works", TEXT, "Second line of it.", "x = 1", "Price: 12.5 credits"]


def test_plain_byline_and_prompt_without_classes():
    raw = page(f'<p>Written by Ann Bee, 12 comments</p>\n<p>{TEXT}</p>\n<span>Tell others about it</span>\n<li><a href="http://o.test/share?u=1">+1</a></li>')
    assert B.split_page(raw, "http://s.test/a").lines == ["How the page works", TEXT]


def test_heading_in_a_page_header():
    raw = f"<body><header>\n<h1>Title</h1>\n<a href='/'>Home</a></header>\n<nav><a href='/a'>Some menu entry</a></nav>\n<div id='w'>\n<p>{TEXT}</p>\n<p>{TEXT}</p>\n</div>\n<aside><p>{TEXT * 9}</p></aside>\n<footer>&copy; x</footer>"
    assert lines(raw) == ["Title", TEXT, TEXT]


def test_page_without_heading_uses_the_sites_block(spark):
    bad = page("<p>404 - Page not found.</p>", head="")
    assert lines(bad, site_block='div class="main"') == ["404 - Page not found."]
    rows = [(k, "http://s.test/a", "S.test", page(f"<p>{TEXT}</p>")) for k in range(3)] + [(9, "http://www.s.test/b", None, bad), (10, None, None, bad), (11, "u", "s.test", None), (12, "u", "s.test", ""), (13, "u", "d", "<<<>>> & < no page")]
    df = spark.createDataFrame(rows, "item_id bigint, url string, domain string, raw_content string")
    df = df.selectExpr("*", "1 as site", "2 as block", "3 as lines", "4 as raw")
    got = {}
    for r in B.body_lines(df).collect():
        got.setdefault(r.item_id, []).append(r.line_no)
    assert sorted(got[0]) == [4, 5] and len(got[9]) == 1 and 11 not in got and 12 not in got
    assert {r.item_id: r.body for r in B.body_text(df).collect()}[9] == "404 - Page not found."
    assert B.body_lines(df.limit(0)).count() == 0
    assert B.visible_text(df).where("item_id = 0").first().text.count("Popular") == 1


@pytest.mark.parametrize("raw", ["", "<", "</p></div>", "<p><p><li><td>x", "<table><td>a<td>b</table>" * 50, "<div>" * 3000 + "x", "<!-- never closed <p>x", "<script>if (a<b) {", "x" * 500_000, "<a href=" * 2000])
def test_any_text_parses(raw):
    P.render(P.parse(raw))
    B.split_page(raw, None)


def test_implied_tags_and_visibility():
    p = P.parse("<ul><li>a<li>b</ul><p>c<p>d<div>e</div><div style='display: none'>no</div><script>no</script><noscript>n</noscript>")
    assert P.render(p) == "- a\n- b\n\nc\n\nd\n\ne\n\nn"


def test_tables_are_aligned():
    p = P.parse("<table><tr><td>name<td>n</tr><tr><td>a<td>12</tr></table>")
    assert P.render(p) == "name  n\na     12"


def spam_items(spark):
    words = ["cheap", "watches", "online", "sale", "buy", "best"]
    stuffed = " | ".join(f"{words[k % 6]} {words[(k * 5 + 1) % 6]} watches" for k in range(80))
    links = "\n".join(f'<li><a href="/c/{k}">watches {words[k % 6]} model {k}</a></li>' for k in range(60))
    prose_ = "\n".join(f"<p>{TEXT} If the user of a page asks for it, the list is shown to them in both versions, and they are told.</p>" for _ in range(4))
    rows = [(k, f"http://s{k % 7}.test/", None, page(prose_.replace("user", f"user{k}"))) for k in range(30)]
    rows += [(100, "http://s1.test/", None, page(f"<p>{stuffed}</p>", "cheap watches")), (101, "http://s1.test/", None, page(links, "watches watches")), (102, "http://s2.test/", None, page(f"{links}\n<p>{TEXT}</p>\n<p>{TEXT}</p>\n<p>{TEXT}</p>", "A list"))]
    rows += [(103, "http://s2.test/", None, page("\n".join(f"<p>{{{{ title }}}} {{{{ price{k} }}}}</p>" for k in range(20)), "{{ name }}")), (104, "u", None, None), (105, "u", None, ""), (106, "http://s2.test/", None, page("")), (100, "http://s1.test/", None, page(f"<p>{stuffed}</p>", "cheap watches"))]
    return spark.createDataFrame(rows, "item_id bigint, url string, domain string, raw_content string").selectExpr("*", "1 as row", "2 as lang", "3 as words", "4 as ref")


def test_spam_pages(spark):
    df = spam_items(spark)
    assert sorted(r.item_id for r in spam.spam_pages(df).collect()) == [100, 101]
    assert spam.spam_pages(df.limit(0)).count() == 0


def test_fit_matches_least_squares(spark):
    import numpy as np

    df = spam_items(spark)
    got = {r.item_id: r for r in spam.curves(spam.page_rows(df)).where("item_id in (0, 101)").collect()}
    for i, raw in ((0, df.where("item_id = 0").first().raw_content), (101, df.where("item_id = 101").first().raw_content)):
        counts = {}
        for line in lines(raw):
            for w in prose.tokens(line):
                counts[w] = counts.get(w, 0) + 1
        f = np.array(sorted(counts.values(), reverse=True), float)
        rank = np.arange(1, len(f) + 1, dtype=float)
        for v in set(f):  # ranks of equal frequencies are their middle
            rank[f == v] = rank[f == v].mean()
        want = np.polyfit(np.log(rank), np.log(f), 1)[0]
        assert got[i].slope == pytest.approx(want, rel=1e-6)


def test_sentences():
    own = prose.SETS["en"]
    assert prose.sentences(TEXT, own) == 1 and prose.sentences("buy a | best b | cheap c | sale d", own) == 0
    assert prose.sentences("Price 712.891 credits", own) == 0 and prose.sentences(f"{TEXT} {TEXT}…", own) == 2
    assert prose.language("der Hund und die Katze") == "de" and prose.language("") == "und"


def residue_items(spark):
    rows = [(k, f"http://s{k % 9}.test/", None, page(f"<p>{TEXT.replace('slow', 'slow' + chr(97 + k % 26) * (1 + k // 26))} And more of it stands here.</p>")) for k in range(40)]
    rows += [
        (100, "http://s1.test/", None, page(f"<p>Dear {{{{ first_name }}}}, {TEXT}</p>")),
        (101, "http://s1.test/", None, page(f"<p>{TEXT}</p>\n<pre><code>{{{{ name }}}}</code></pre>")),
        (102, "http://s2.test/", None, page("", "404 - Page not found.")),
        (103, "http://s3.test/", None, page(f"<p>404 - Page not found - {TEXT} {TEXT} {TEXT}</p>")),
        (104, "http://s4.test/", None, page("<p>Lorem ipsum dolor sit amet, velum fugam magnum.</p>\n<p>Velum ipsum magnum fugam dolor.</p>", "")),
        (105, "http://s5.test/", None, page("<p>Please enable JavaScript to view this site.</p>", "")),
        (106, "u", None, None),
        (107, "u", None, ""),
    ]
    rows += [(110 + k, f"http://s{k}.test/", None, page("<p>The wombat has left the building</p>", "")) for k in range(4)]
    return spark.createDataFrame([*rows, rows[40]], "item_id bigint, url string, domain string, raw_content string").selectExpr("*", "1 as row", "2 as place", "3 as reason")


def test_residue(spark):
    df = residue_items(spark)
    got = {r.item_id: r.reason for r in residue.residue(df).collect()}
    assert got == {100: "slot", 102: "message", 104: "filler", 105: "message", 110: "message", 111: "message", 112: "message", 113: "message"}
    assert residue.residue(df.limit(0)).count() == 0


def test_an_article_on_many_sites_is_no_message(spark):
    story = f"{TEXT} If the user of a page asks for it, the list is shown to them in both versions, and they are told so by letter."
    rows = [(k, f"http://s{k}.test/", None, page(f"<p>{story}</p>", "The story of the list")) for k in range(6)]
    df = spark.createDataFrame(rows, "item_id bigint, url string, domain string, raw_content string")
    assert residue.residue(df).count() == 0


def test_a_long_stack_trace_is_a_message(spark):
    trace = "\n".join(f"<p>#{k} app.module.call(file:{k}) of the server loop</p>" for k in range(200))
    df = spark.createDataFrame([(1, "http://s.test/", None, page(f"<p>Fatal error: call to undefined function</p>\n{trace}", ""))], "item_id bigint, url string, domain string, raw_content string")
    assert [r.reason for r in residue.residue(df).collect()] == ["message"]


SERVER = "The server encountered an internal error or misconfiguration and was unable to complete your request. Please contact the server administrator at {} and inform them of the time the error occurred, and of anything you might have done that may have caused it."
WALL = "We have noticed some odd traffic from your part of the network lately, so that for now every visit is held back until one of our people has had a look at what you were up to and let you go on with it."


def test_messages_of_one_long_paragraph(spark):
    rows = [(k, f"http://s{k}.test/", None, page(f"<p>{SERVER.format(f'a{k}@x.test')}</p>", "Internal Server Error")) for k in range(3)]
    rows += [(10 + k, f"http://one.test/{k}", None, page(f"<p>{SERVER.format('us').replace('done', 'typed')}</p>", "")) for k in range(5)]
    rows += [(20 + k, f"http://w{k % 3}.test/{k}", None, page(f"<p>{WALL}</p>", "")) for k in range(6)]
    # Own prose after a known sentence is no message, nor is a body of three sentences that comes whole at one address a site.
    rows += [(30, "http://p.test/", None, page(f"<p>{SERVER.format('them')} {TEXT} So I told my sister of it.</p>", "My server story"))]
    rows += [(40 + k, f"http://v{k}.test/", None, page(f"<p>{WALL.replace('odd', 'strange')} {WALL.replace('odd', 'weird')} {WALL.replace('odd', 'queer')}</p>", "")) for k in range(4)]
    rows += [(50 + k, f"http://{d}.test/p{k}", None, page(f"<p>{TEXT.replace('slow', 'slow' + chr(97 + k))}</p>", "A page like others")) for k, d in enumerate(["s0", "s1", "s2", "one", "w0", "w1", "w2", "p", "v0", "v1", "v2", "v3"])]
    df = spark.createDataFrame(rows, "item_id bigint, url string, domain string, raw_content string")
    got = {r.item_id: r.reason for r in residue.residue(df).collect()}
    assert got == {k: "message" for k in (0, 1, 2, 10, 11, 12, 13, 14, 20, 21, 22, 23, 24, 25)}


def test_standard_signs_pass_every_standard_wording():
    for word in ("not found", "fehler 404", "erro 500", "ошибка 404", "404 - gone", "zugriff verweigert", "activate script", "#1 a.b(", "bad gateway", "erreur interne", "stack trace"):
        assert residue.STANDARD.search(word) and residue.standard_sign(word.lower()), word


def test_a_constant_placeholder_is_no_slot(spark):
    rows = [(k, "http://s.test/", None, page("<p>Write {{ name }} here</p>\n" + "\n".join(f"<div>{TEXT.replace('slow', f'slow{k}{n}')}</div>" for n in range(4)))) for k in range(5)]
    df = spark.createDataFrame(rows, "item_id bigint, url string, domain string, raw_content string")
    assert residue.residue(df).count() == 0


@pytest.mark.parametrize("head,line", [("{{title}}", TEXT), ("How the page works", "Dear user {{name}}, your order is on its way."), ("How the page works", "Type: {{type}}")])
def test_a_template_broken_on_every_page(spark, head, line):
    rows = [(k, f"http://s.test/{k}", None, page(f"<p>{line}</p>", head)) for k in range(5)] + [(9, "http://other.test/", None, page(f"<p>{line}</p>", head)), (10, "http://other.test/", None, page(f"<p>{line}</p>", head))]
    df = spark.createDataFrame(rows, "item_id bigint, url string, domain string, raw_content string")
    assert {r.item_id: r.reason for r in residue.residue(df).collect()} == {k: "slot" for k in (0, 1, 2, 3, 4, 9, 10)}


@pytest.mark.parametrize("text", ["{{ a }}", "{% x %}", "<%= y %>", "${z.w}", "[[price]]", "%%shop%%", "@@n@@", "%user_name%", "[insert city here]", "#{t}", "__NAME__", "[first_name]", "{USERNAME}", "[product.title]", "{insert city here}"])
def test_placeholders(text):
    assert residue.PLACEHOLDER.search(f"see {text} now") and residue.SIGN.search(text)


@pytest.mark.parametrize("text", ["100% of 50% off", "a [1] b", "snake_case __init__", "f(x) { return; }", "{x}", "5 < 6 > 4", "me@x.test", "[sic]", "[A] {B}", "{name}"])
def test_no_placeholders(text):
    assert not residue.PLACEHOLDER.search(text)


def frame(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, url string, domain string, raw_content string")


NOTICE = "We are sorry to tell you that the thing you came for is no longer kept at this place, and that nobody here can say where it went or when it may come back to us"


def test_a_long_notice_on_three_sites_is_a_message(spark):
    """No list of wordings and no limit of length: repetition of the whole body alone tells it."""
    rows = [(k, f"http://s{k}.test/x", None, page(f"<p>{NOTICE}.</p>", "Gone")) for k in range(3)]
    assert {r.item_id for r in residue.residue(frame(spark, rows)).collect()} == {0, 1, 2}
    assert residue.residue(frame(spark, rows[:2])).count() == 0


def test_alignment_decides_doubtful_names_defaults_and_blanks(spark):
    line = "Dear {}, your order {} is on its way"
    names = "Ann Bee Cid Dan Eve Fay Gil Hal Ian Joy Kim Lea Max Ned Oda Pia Quy Rae Sam Tom Uma Val Wes Xia".split()
    rows = [(k, f"http://s.test/{k}", None, page(f"<p>{line.format(w, 100 + k)}</p>\n<p>{TEXT.replace('slow', w)}</p>", f"Order of {w}")) for k, w in enumerate(names)]
    rows += [
        (100, "http://s.test/a", None, page(f"<p>{line.format('[name]', 7)}</p>", "A")),
        (101, "http://s.test/b", None, page(f"<p>{line.format('Zoe', 'null')}</p>", "B")),
        (102, "http://s.test/c", None, page(f"<p>{line.format('', 7)}</p>", "C")),
        (103, "http://s.test/d", None, page("<p>He wrote [name] and null in a letter</p>", "D")),
    ]
    found = {r.item_id: r.reason for r in residue.residue(frame(spark, rows)).collect()}
    assert found == {100: "slot", 101: "slot", 102: "slot"}
    # Without the other records there is nothing to align with, and no slot.
    assert residue.residue(frame(spark, [rows[-4], rows[-1]])).count() == 0


def test_the_curve_decides(spark):
    """Ablation: without the curve test all prose would come out too; the check of sentences then leaves out the list with running text."""
    df = spam_items(spark)
    page_ = spam.page_rows(df)
    scored = spam.scores_of(spam.curves(page_))
    left = residue.residue_of(page_).select("item_id")
    every = {r.item_id for r in scored.select("item_id").join(left, "item_id", "left_anti").collect()}
    off = {r.item_id for r in scored.where(spam.off_prose()).select("item_id").join(left, "item_id", "left_anti").collect()}
    assert off == {100, 101, 102} and set(range(30)) <= every
    assert sorted(r.item_id for r in spam.spam_pages(df, most_sentences=None).collect()) == [100, 101, 102]


def test_a_short_list_of_links_is_not_too_short(spark):
    links = "\n".join(f'<li><a href="/c/{k}">cheap watches</a></li>' for k in range(5))
    prose_ = "\n".join(f"<p>{TEXT} If the user of a page asks for it, the list is shown to them in both versions, and they are told.</p>" for _ in range(4))
    rows = [(k, f"http://s{k % 7}.test/", None, page(prose_.replace("user", f"user{k}"))) for k in range(30)] + [(200, "http://s1.test/", None, page(links, "watches"))]
    assert [r.item_id for r in spam.spam_pages(frame(spark, rows)).collect()] == [200]


def test_prompts_are_told_by_many_sites(spark):
    ask = "Bring this to everybody you know"
    soc = '<li><a href="http://o.test/share?u=1" class="soc">+1</a></li>'
    rows = [(k, f"http://s{k}.test/", None, page(f"<p>{TEXT}</p>\n<p>{ask}</p>\n{soc}")) for k in range(3)] + [(9, "http://s9.test/", None, page(f"<p>{TEXT}</p>\n<p>No full stop here</p>\n{soc}"))]
    df = frame(spark, rows)
    text = {r.item_id: r.body for r in B.body_text(df).collect()}
    assert all(ask not in text[k] and TEXT in text[k] for k in range(3)) and "No full stop here" in text[9]
    assert df.count() and B.body_lines(df).count() == 3 * 2 + 3
    assert B.body_lines(df.limit(2)).count() == 2 * 3  # two sites don't tell


def test_a_body_line_is_cut_into_words_once(monkeypatch):
    read = []

    class Counted:
        def findall(self, text, inner=prose.WORD):
            read.append(text)
            return inner.findall(text)

    s = B.split_page(page(f"<p>{TEXT} {TEXT}</p>\n<p>{TEXT} Price 12.5.</p>\n<p>404 times HTTP was on the 500 pages.</p>"), None)
    monkeypatch.setattr(prose, "WORD", Counted())
    row = spam.page_row(1, "s", None, s)[0]
    body = [s.text(n - 1) for n in sorted([*s.body, *s.closing])]
    assert sum(map(len, read)) <= sum(map(len, body))
    monkeypatch.undo()
    assert row[3] == sum(len(prose.tokens(x)) for x in body) and row[12] == sum(prose.sentences(x, prose.SETS["en"]) for x in body) == 4


def test_source_lines_beside_raw_text_and_wide_tags():
    p = P.parse("a\n<script>\nif (a<b) {<p>\n</script>b\n<!--\n\n<p>--><div\nid='x'>c\n\n d<br></div\n>e\n<textarea>f<b>\ng</b></textarea>h<style>\nx")
    assert [(row, text) for _, row, text, _ in p.pieces] == [(0, "a"), (2, "if (a<b) {<p>"), (3, "b"), (7, "c"), (9, " d"), (9, "\n"), (10, "e"), (11, "f<b>"), (12, "g</b>"), (12, "h"), (13, "x")]
    assert [(t, n) for t, n in zip(p.tag, p.line)] == [("#root", 0), ("script", 1), ("div", 6), ("br", 9), ("textarea", 11), ("style", 12)]


@pytest.mark.parametrize("raw", ["<div>" * 10_000 + "x", "<table>" + "<tr><td>a<td>12</tr>" * 2000 + "</table>", "<p><td>" + "<div>" * 9000 + "</p>" * 9000, "<b>" * 9000 + "<hr>" * 9000, "<a><b>" * 9000, "<div><h1>" * 5000])
def test_page_work_is_linear(raw):
    import time

    began = time.perf_counter()
    s = B.split_page(raw, None)
    residue.page_row(1, "s", None, s)
    P.render_blocks(s.page, s.blocks)
    assert time.perf_counter() - began < 2
