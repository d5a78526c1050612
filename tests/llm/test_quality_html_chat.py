"""Operators 1, 7 and 8."""

import numpy as np
import pytest

from skein.llm import chat, html, quality

DOCS = "doc_id long, text string, quality int, score string, id string, _text int"


def documents(n=240):
    rng = np.random.default_rng(4)
    words = ["the", "and", "ending", "otion", "therble", "onnd", "whin", "er", "shes", "at"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words, 60))
        bad = i % 4 == 0
        rows.append((i, " ".join(w.upper() + "!!" for w in text.split()) if bad else text.capitalize() + ".", int(not bad)))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    rows = documents()
    df = spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    return rows, df, quality.fit(df, labels)


def test_held_out_accuracy(fitted, spark):
    import zlib

    rows, df, model = fitted
    got = {r.doc_id: r for r in quality.score(df, model).collect()}
    assert len(got) == len(rows)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    held = [(q, got[i].predicted) for i, _, q in rows if got[i].held_out]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_scores_against_a_plain_vote(fitted, spark):
    """Every document against every labelled one in a loop, with the neighbours in order of cosine, then place."""
    rows, df, model = fitted
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    unit = lambda v: v / max(float(np.linalg.norm(v)), 1e-12)
    for i, text, _ in rows[::7]:
        mine = unit(unit(quality.terms(text) * model.idf) @ model.project)
        near = sorted((-float(mine @ v), j) for j, v in enumerate(model.vectors))[: quality.NEIGHBOURS]
        weights = [max(-c, 1e-6) ** 12 for c, _ in near]
        assert got[i] == pytest.approx(sum(w * model.labels[j] for w, (_, j) in zip(weights, near, strict=True)) / sum(weights), abs=1e-3)


def test_texts_without_terms_score_as_such_labelled_texts():
    rows = np.zeros((4, quality.TERMS), np.float32)
    rows[:2, 3] = 1
    model = quality.Model(rows, np.array([1, 1, 0, 1]))
    assert model.scores(np.zeros((1, quality.TERMS), np.float32)).tolist() == [0.5]
    assert quality.Model(rows[:2], np.array([1, 0])).blank == 0.5 and quality.Model(np.empty((0, quality.TERMS)), np.empty(0)).blank == 0.5


def test_held_out_labels_are_never_learnt(spark):
    import zlib

    rows = documents(60)
    df = spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t, _ in rows], DOCS)
    held = [(i, 1 - q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    model = quality.fit(df, spark.createDataFrame(held, "doc_id long, quality int"))
    assert len(model.labels) == 0 and {r.score for r in quality.score(df, model).collect()} == {0.5}


def test_odd_rows(fitted, spark):
    _, _, model = fitted
    prior = float(np.mean(model.labels))
    odd = [(None, None, None, None, None, None), (1, "", 1, "x", "y", 2), (1, "x", 1, "x", "y", 2), (1, "x", 1, "x", "y", 2), (2, "Long text. " * 300000, 1, "x", "y", 2)]
    df = spark.createDataFrame(odd, DOCS)
    got = quality.score(df, model).collect()
    assert len(got) == 5 and [r.score for r in got if r.doc_id is None or r.doc_id == 1][:2] == pytest.approx([prior, prior])
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in got)
    assert quality.score(spark.createDataFrame([], DOCS), model).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert len(quality.fit(df, none).labels) == 0


def test_the_bound_holds(spark):
    rows = documents(80)
    df = spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] * 2 + [(5, None)], "doc_id long, quality int")
    assert len(quality.fit(df, labels, max_labelled=20).labels) == 20


# --- operator 7

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><article>x</article>";</script></head><body>'
    "<header>Site</header><nav><ul><li><a href='/a'>A</a><li>B</ul></nav><!-- ad --><div class='ad'>Buy {0}</div>"
    '<div id="cookie-notice">Cookies</div>{1}<aside>Side</aside><form><input><label>Mail</label></form>'
    '<section class="comments"><p>First!</p></section><footer>&copy; foot</footer></body></html>'
)


def test_article_of_a_page():
    page = PAGE.format(1, "<article><h1>A &amp; B</h1><p>One<b>two</b>  three<br>four\n five<p>six <i>se</i>ven &lt;x&gt;<ul><li>i<li>ii</ul><div class=ads>no</div><table><tr><td>c<td>d</table></article>")
    assert html.extract(page, None) == "A & B\n\nOnetwo three four five\n\nsix seven <x>\n\ni\n\nii\n\nc\n\nd"


def test_pages_without_an_article_use_the_slots():
    pages = [PAGE.format(i, f"<div class=wrap><div class=x>Menu</div><div class=body-{i % 2}><p>{'text %d ' % i * 30}</p><p>{'more %d ' % i * 20}</p></div></div>") for i in range(4)]
    path = html.region(html.infer(pages))
    assert path[:2] == ["html", "body"]
    for i, p in enumerate(pages):
        text = html.extract(p, path)
        assert f"text {i}" in text and f"more {i}" in text and not any(w in text for w in ("Site", "Buy", "Cookies", "First!", "foot", "Mail", "Side"))


def test_wrapper_is_a_union_free_expression():
    a = "<body><h1>Same</h1><p>a</p><p>b</p><hr><i>x</i></body>"
    b = "<body><h1>Same</h1><p>c</p><h2>z</h2></body>"
    text = html.expression(html.infer([a, b]))
    assert "'Same'" in text and "(<p>#</>)+" in text and "(<h2>" in text and ")?" in text
    groups = html.expression(html.infer(["<body>" + "<dt>k</dt><dd>v</dd>" * 5 + "</body>"]))
    assert groups.count("<dt>") == 1 and groups.count("<dd>") == 1


def test_damaged_markup():
    for page in (None, "", "plain <b>text", "<p", "<p>a<script>never closed <p>", "<!-- open", "a < b & c", "<div style='display:none'>h</div><p>v</p>", "<a title=\"x>y\">z</a>", "</p></div>x"):
        assert isinstance(html.extract(page, ["html", "body"]), str)
    assert html.extract("a < b & c", None) == "a < b & c" and html.extract("<div style='display:none'>h</div><p>v</p>", None) == "v"
    assert html.extract("x" * 3_000_000, None) == "x" * 3_000_000


def test_damage_takes_linear_time():
    import time

    for page in ("<div>" * 100_000 + "deep", "<a " * 350_000, "<h1>" * 100_000, "<div>" * 50_000 + "</section>" * 50_000, "<div><p>" * 50_000, '<a "' * 200_000 + ">", "<script " * 100_000, "<" * 500_000):
        began = time.process_time()
        html.extract(page, None)
        html.items_of(html.parse(page))
        assert time.process_time() - began < 30, page[:20]
    assert html.extract("<div>" * 100_000 + "deep", None) == "deep"
    assert html.extract("<p>a</p><div" + " class=x" * 10, None) == "a"


def made_pages(n=60):
    """(page, article): a template without telling names; what is the article is known, not found."""
    import random

    r = random.Random(6)
    some = lambda k: " ".join(r.choice("stone river light under garden over seven paper" .split()) + str(r.randrange(50)) for _ in range(k))
    out = []
    for i in range(n):
        blocks = [some(r.randrange(8, 40)) for _ in range(r.randrange(2, 7))]
        title = some(5)
        items = "".join(f"<li>{some(2)}</li>" for _ in range(r.randrange(3)))
        listed = f"<ul>{items}</ul>" if items else ""
        quote = some(9) if i % 3 else ""
        inner = f"<h1>{title}</h1><div class=q1>Read this with our reader</div>" + "".join(f"<p>{b}</p>" for b in blocks) + listed + (f"<blockquote>{quote}</blockquote>" if quote else "") + "<div class=q7>Tell your friends</div>"
        page = f"<html><body><div class=a1>The daily page</div><div class=b2><div class=k>{inner}</div></div><div class=z>Made by us</div></body></html>"
        import re

        out.append((page, "\n\n".join([title, *blocks, *re.findall("<li>(.*?)</li>", listed), *([quote] if quote else [])])))
    return out


def test_the_wrapper_decides_where_no_name_does():
    pages = made_pages()
    wrapper = html.infer(p for p, _ in pages)
    path = html.region(wrapper)
    template = html.constants(wrapper, path)
    assert path == ["html", "body", "div.b2", "div.k"] and sorted(t for _, t in template) == ["Read this with our reader", "Tell your friends"]
    assert "(<blockquote>#</>)?" in html.expression(wrapper) and "(<p>#</>)+" in html.expression(wrapper)
    for page, want in pages:
        assert html.extract(page, path, template) == want
        alone = html.extract(page, None)  # without the wrapper the template's texts stay
        assert alone != want and "Tell your friends" in alone


def test_copies_of_a_page_are_no_template():
    page = PAGE.format(1, "<article><h1>Title</h1><p>All of this text is the same on every page of the host.</p></article>")
    wrapper = html.infer([page] * 9)
    assert html.constants(wrapper, html.region(wrapper)) == []
    few = html.infer(p for p, _ in made_pages(html.CONSTANT_PAGES - 1))
    assert html.constants(few, html.region(few)) == []


def test_the_query_reads_pages_through_wrappers(spark):
    pages = made_pages()
    df = spark.createDataFrame([(i, f"http://same.org/{i}", p) for i, (p, _) in enumerate(pages)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.main_text(df.repartition(5)).collect()} == {i: want for i, (_, want) in enumerate(pages)}


def test_headers_and_marks_inside_an_article():
    page = "<body><header>Site</header><article><header><h1>Title</h1></header><p class='share-price alert-level'>Text</p><p class=ad>Buy</p><div class=share>Share</div><footer>By me</footer></article></body>"
    assert html.extract(page, None) == "Title\n\nText"


def test_page_rows(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.format(i, f"<article><p>text {i}</p></article>"), "t", 1) for i in range(40)]
    rows += [(40, None, None, "t", 1), (None, "odd", "<p>a</p>", "t", 1), rows[0], (41, "http://h0.org/q", "<html><body><p>no region here</p></body></html>", "t", 1)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, path int")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and all(by[i].text == f"text {i}" for i in range(40))
    assert by[40].text == "" and by[None].text == "a" and by[41].text == "no region here" and all(r.n_chars == len(r.text) for r in got)
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- operator 8


def test_chats_come_back(spark):
    import random

    r = random.Random(5)
    bits = [*chat.CONTROLS, "\\", "\n", "é", "日", "x", "<", "|", "[", "n", "/INST]", "\\n"]
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "a\nb\\n<s>"]), "".join(r.choice(bits) for _ in range(r.randrange(12))) or None) for c in range(60) for t in range(r.randrange(1, 6))]
    rows += [(None, 1, "assistant", "n"), (None, None, "user", "m"), (7, 0, "assistant", "again"), (7, 0, "assistant", "again"), (99, 0, "assistant", "long " * 500000)]
    df = spark.createDataFrame([(*x, 1, "f") for x in rows], "conv_id long, turn int, role string, text string, n_turns int, formatted string")
    made = {x.conv_id: x for x in chat.format_chats(df).collect()}
    low = lambda v: (v is not None, v or "")
    for c in {x[0] for x in rows}:
        turns = sorted((x for x in rows if x[0] == c), key=lambda x: ((x[1] is not None, x[1] or 0), low(x[2]), low(x[3])))
        assert chat.parse(made[c].formatted) == [(x[2] or "", x[3] or "") for x in turns]
        learnt = [chat.unescape(made[c].formatted[s.start : s.end]) for s in made[c].loss]
        assert learnt == [x[3] or "" for x in turns if x[2] == "assistant"] and made[c].n_turns == len(turns)
        inner = made[c].formatted.replace(chat.START, "", len(turns)).replace(chat.END, "", len(turns))
        assert not any(k in inner for k in ("</s>", "[INST]", "[/INST]", "<<SYS>>"))
    assert chat.chat_digest(chat.format_chats(df.limit(0))).count() == 0
    assert chat.chat_digest(chat.format_chats(df)).count() == len(made)


def test_chats_are_cut_by_bytes(spark, monkeypatch):
    import pyarrow as pa

    rows = [(c, t, "assistant" if t % 2 else "user", f"é{c}<s>" * (50 if c == 3 else c % 4)) for c in range(30) for t in range(3)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows])], ["conv_id", "role", "text"])
    whole = list(chat._groups([batch]))
    assert len(whole) == 1
    for name, value in (("SCATTER_BYTES", 7), ("GROUP_BYTES", 40)):
        monkeypatch.setattr(chat, name, value)
    parts = list(chat._groups([batch.slice(0, 50), batch.slice(50)]))
    assert len(parts) > 10 and pa.Table.from_batches(parts).to_pylist() == whole[0].to_pylist()
    monkeypatch.setattr(chat, "MOST_BYTES", 200)
    with pytest.raises(ValueError, match="conversation 3 "):
        list(chat._groups([batch]))
