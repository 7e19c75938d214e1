"""Operators on pages, and the pipeline."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import extract, language_id
from ledgerloom.llm.labelled_pages import labelled_pages


def test_extract_by_hand(spark):
    html = (
        "<html><head><title>t</title></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy now.</div><article><h1>A &amp; B</h1><p><b>One\n two<br><p>Three</p>"
        "<script>var x='<p>no</p>'</script><ul><li>item</li></ul><form><p>Mail?</p><input></form></article><section class='comments'><p>I like it.</p></section><footer>&copy; us</footer>"
    )
    rows = [(1, "u", html), (2, "u", None), (3, None, ""), (1, "u", html), (None, "u", "<article><p>x</p></article><p"), (4, "u", "no markup at all")]
    got = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert got[0].text == "A & B\n\nOne two\n\nThree\n\nitem" and got[0].n_chars == len(got[0].text) and got[3].text == got[0].text
    assert got[1].text == "" and got[2].n_chars == 0 and got[4].text == "x" and len(got) == 6
    assert extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("broken", ["<datalist id=x><option value=a>A<option value=b>B</datalist>", "<div><button>Share</div>", "<div><object data=x></div>", "<div><iframe src=x></div>", "<div><select><option>A<option>B</div>", "<div><svg><path d=x></div>"])
def test_unclosed_elements_end_with_their_parents(broken):
    """What follows such an element stays, also where its end tag comes much later; what it holds is no text."""
    model = extract.default_model()
    for last in ("", "<p><select><option>C</option></select> <button>D</button> <object></object>"):
        page = "<body><article><p>" + "First words of it. " * 9 + "</p>{}<p>" + "More of the same. " * 9 + "</p></article>" + last + "</body>"
        want = model.extract(page.format(""))
        assert len(want) == 2 and model.extract(page.format(broken)) == want


def test_formulas_are_text():
    page = f"<body>{BAR}<article><h1>Energy</h1><p>{FIRST}</p><p>Energy is <math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi></mrow><annotation encoding='application/x-tex'>E=m</annotation></semantics></math> where it holds.</p><p>{SECOND}</p></article>{END}"
    assert extract.default_model().extract(page) == ["Energy", FIRST, "Energy is E=m where it holds.", SECOND]


def test_held_out_pages():
    model, wrong, total = extract.default_model(), 0, 0
    for source in labelled_pages(80, 31):
        page = extract.Page(source)
        for text, label, p in zip(page.text, page.label, model.marginals(page), strict=True):
            if text is not None:
                total += 1
                wrong += bool(label) != (p >= 0.5)
    assert total > 500 and wrong <= 0.01 * total


def test_messages_equal_enumeration():
    """Marginals by messages against sums over all assignments of a small tree."""
    import itertools
    import math

    model = extract.default_model()
    page = extract.Page("<body><div class='ad'>x</div><p>yy</p><ul><li>z</li></ul></body>")
    n, weight, on = len(page.parent), 0.0, [0.0] * len(page.parent)
    for states in itertools.product((0, 1), repeat=n):
        w = 1.0
        for i, s in enumerate(states):
            if s:
                w *= math.exp(sum(model.odds.get(f, 0.0) for f in page.features[i][1:]))
            if i:
                w *= model.step(page.features[i])[states[page.parent[i]]][s]
        weight += w
        for i, s in enumerate(states):
            on[i] += w * s
    assert model.marginals(page) == pytest.approx([x / weight for x in on], rel=1e-6)


@pytest.mark.parametrize("broken", ["<article>" + "<b>x</i>" * 30_000, "<p>" + "<span>y<div>" * 15_000 + "</em>" * 15_000, "<iframe>" * 20_000 + "z", "<ul>" + "<li><b>w" * 20_000])
def test_broken_pages_take_linear_time(broken):
    import time

    began = time.perf_counter()
    extract.Page(broken)
    assert time.perf_counter() - began < 5


BAR = "<div id='masthead'><a href='/'>The Herald</a><ul class='nav'><li><a href='/w'>World</a><li><a href='/s'>Sport</a></ul></div>"
END = "<footer><p>&copy; 2024 The Herald</p><ul><li><a href='/about'>About us</a></li></ul></footer>"
FIRST, SECOND = "The council met on Tuesday to discuss the new bridge, which has been planned for eleven years.", "Nobody spoke against it, and work is to begin in the spring of next year."
# pages as sites write them, with the blocks that a reader would keep
BY_HAND = [
    (f"<html><body>{BAR}<main><article class='post'><h1>A bridge at last</h1><p>{FIRST}</p><div class='ad'><p>Buy two, get one.</p></div><p>{SECOND}</p></article><aside class='related'><h3>More</h3><ul><li><a href='/1'>Old bridge closed</a></li></ul></aside></main>{END}</body></html>", ["A bridge at last", FIRST, SECOND]),
    (f"<body><div class='cookie-notice'><p>We use cookies.</p><button>Fine</button></div>{BAR}<div class='content'><h2>Bridge</h2><p>{FIRST}<blockquote>It is time.</blockquote><p>{SECOND}</div><section id='comments'><h3>2 comments</h3><div class='comment'><p>About time, I say, and I have said so for many years now.</p></div></section>{END}", ["Bridge", FIRST, "It is time.", SECOND]),
    (f"<body>{BAR}<article><h1>Q&amp;A</h1><p>{FIRST}<table><tr><td>Length<td>90 m<tr><td>Cost<td>&euro;4m</table><ol><li>Plan<li>Build</ol></article><form class='newsletter'><label>Mail</label><input></form>{END}", ["Q&A", FIRST, "Length", "90 m", "Cost", "\u20ac4m", "Plan", "Build"]),
]


@pytest.mark.parametrize(("page", "want"), BY_HAND)
def test_pages_by_hand(page, want):
    """Against blocks chosen by hand, and against the standard library's parser for the words of each block."""
    from html.parser import HTMLParser

    assert extract.default_model().extract(page) == want

    class Words(HTMLParser):
        heard = ""

        def handle_data(self, data):
            self.heard += data

    reader = Words()
    reader.feed(page)
    heard = " ".join(reader.heard.split())
    assert all(block in heard for block in want)


def test_deep_page():
    model = extract.default_model()
    assert model.extract("<div>" * 3000 + "<p>deep</p>") in (["deep"], [])


def test_language_id(spark):
    en, de = "the cat and the dog are in the house with them", "der hund und die katze sind mit ihnen in dem haus"
    docs = spark.createDataFrame([(i, en if i % 2 else de, "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    page = lambda i, lang, text, host="a.example.com": (i, f"http://{host}/{lang}/1", f"<html lang='{lang}'><p>{text}</p>")
    rows = [page(1, "en", en), page(2, "de", de), page(3, "en", de * 3), (4, None, None), (5, "http://a.example.com/x", ""), page(1, "en", en), (None, "u", "<p>x"), *[page(10 + i, "de", de, "b.example.org") for i in range(9)], (30, "http://b.example.org/", "<p>1 2 3</p>")]
    letters = language_id.train(docs)
    got = language_id.language_id(spark.createDataFrame(rows, "page_id long, url string, html string"), letters).collect()
    by_id = {r.page_id: r for r in got}
    assert len(got) == len(rows) and by_id[1].lang == "en" and by_id[2].lang == "de" and by_id[3].text_lang == "de"
    assert by_id[30].lang == "de"  # by its host alone
    assert all(0 <= r.probability <= 1 + 1e-9 for r in got)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert language_id.language_id(empty, letters).count() == 0
    assert language_id.language_id(empty, language_id.train(docs.limit(0))).count() == 0


def test_language_sample_at_any_size(spark):
    """The share drawn follows the count of labels, however large it is."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.lit("en").alias("lang"))
    assert 1500 < language_id.sample(rows, 2_000, 20_000).count() <= 2_000
    place = rows.select((F.xxhash64("doc_id", "text").cast("double") / 2.0**64 + 0.5).alias("x")).agg(F.min("x"), F.max("x")).first()
    assert 0 <= place[0] < 0.001 and 0.999 < place[1] <= 1
    # of 1e11 texts, 4,000 are wanted: the share is small but not nothing
    assert 0 < 0.9 * 4_000 / 1e11 < 1e-7
    plan = language_id.sample(rows, 4_000, 10**11)._jdf.queryExecution().optimizedPlan().toString()
    assert "3.6E-8" in plan or "3.5999" in plan


def test_language_tables_from_tasks(spark):
    """Trigrams counted in tasks give the tables of the texts themselves; a language whose texts have no letter counts."""
    rows = [("EN", "the cat and the dog"), ("de", "der Hund und die Katze"), ("en", "a dog"), ("xx", "123"), (None, "none"), ("fr", None)]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    one, two = language_id.train(df), language_id.Letters([(lang.lower(), t) for lang, t in rows if lang and t])
    assert one.languages == two.languages == ["de", "en", "xx"] and (one.table == two.table).all()


def test_language_posterior_by_brute_force(spark):
    """Every page's posterior against plain Python over the same evidence."""
    import math
    import random

    r = random.Random(4)
    words = {"en": "the cat and dog are in this house with them all".split(), "de": "der hund und die katze sind mit ihnen im haus".split(), "fr": "le chat et la maison sont avec nous dans les bois".split()}
    text = lambda lang, n: " ".join(r.choice(words[lang]) for _ in range(n))
    letters = language_id.Letters([(lang, text(lang, 40)) for lang in words for _ in range(5)])
    rows = []
    for i in range(60):
        lang = r.choice(list(words))
        declared = r.choice([lang, "xx", None])
        url = f"http://{r.choice(['a', 'b', 'www'])}.{lang if r.random() < 0.7 else 'x'}site.{r.choice(['com', 'de'])}/{r.choice([lang, 'news'])}/{i}"
        rows.append((i, url, f"<html{f' lang={declared}' if declared else ''}><p>{text(lang, r.randrange(6))}</p>"))
    got = {x.page_id: x for x in language_id.language_id(spark.createDataFrame(rows, "page_id long, url string, html string"), letters).collect()}
    power, cell, to_all, to_domain = language_id.POWER, language_id.CELL, language_id.TO_ALL, language_id.TO_DOMAIN
    n = range(len(letters.languages))
    facts = {}
    for i, url, html in rows:
        score = letters.score(language_id.MARKUP.sub(" ", html))
        soft = [math.exp(power * (x - max(score))) for x in score]
        host = url.split("/")[2]
        path = url.split("/")[3]
        declared = html[len("<html lang=") :].split(">")[0] if " lang=" in html else None
        facts[i] = score, [x / sum(soft) for x in soft], host, ".".join(host.split(".")[::-1][:2]), declared, path if len(path) == 2 else host.split(".")[-1]
    total = [sum(f[1][k] for f in facts.values()) for k in n]
    prior = [(x + cell) / (sum(total) + cell * len(total)) for x in total]
    for i, (score, soft, host, domain, declared, suffix) in facts.items():
        without = lambda place, value: [max(sum(f[1][k] for f in facts.values() if f[place] == value) - soft[k], 0.0) for k in n]  # noqa: E731, B023
        d, h = without(3, domain), without(2, host)
        by_domain = [(d[k] + to_all * prior[k]) / (sum(d) + to_all) for k in n]
        by_host = [(h[k] + to_domain * by_domain[k]) / (sum(h) + to_domain) for k in n]
        logs = [power * score[k] + math.log(by_host[k]) for k in n]
        for place, value in ((4, declared), (5, suffix)):
            if value is not None:
                kinds = len({f[place] for f in facts.values()} - {None}) + 1
                for k in n:
                    logs[k] += math.log((sum(f[1][k] for f in facts.values() if f[place] == value) + cell) / (total[k] + cell * kinds))
        p = [math.exp(x - max(logs)) for x in logs]
        p = [x / sum(p) for x in p]
        assert got[i].probability == pytest.approx(max(p), rel=1e-9) and got[i].lang == letters.languages[p.index(max(p))]


def test_pipeline_by_brute_force(spark, tmp_path):
    """Each stage on a small table against plain Python on what the stage before left."""
    import random

    from tokenizers import Tokenizer

    import corpus_pipeline
    from ledgerloom.llm import bpe
    from tests.llm.test_documents import SPACE, mix_brute, near_brute, quality_brute

    r = random.Random(9)
    rows = []
    for i in range(60):
        w = [f"word{r.randrange(400)}" for _ in range(r.randrange(5, 60))]
        rows.append((i, " ".join(w), "en", f"s{i % 4}"))
        if i % 5 == 0:
            rows.append((100 + i, "  ".join(w), "en", "s1"))
        if i % 7 == 0:
            rows.append((200 + i, " ".join([*w, "more"]), "en", "s2"))
    rows += [(900, None, None, None), (901, "a b " * 40, "en", "s0")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {i: t for i, t, *_ in rows}
    source = {i: x for i, _, _, x in rows}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{n}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs, before = spark.read.parquet(path), docs.columns
        ids = sorted(x.doc_id for x in docs.select("doc_id").collect())
        if name == "quality_rules":
            kept = {i: t for i, t in kept.items() if (m := quality_brute(t))[0] >= 10 and 100 * m[4] <= 20 * m[0]}
        elif name == "exact_dedup":
            best = {}
            for i, t in kept.items():
                key = SPACE.sub("", t)
                if key not in best or (-len(t), i) < (-len(kept[best[key]]), best[key]):
                    best[key] = i
            kept = {i: kept[i] for i in best.values()}
        elif name == "near_dedup":
            kept = {i: t for i, t in kept.items() if near_brute(kept.items(), 5, 80)[i][1] == i}
        elif name == "mixing":
            want = mix_brute([(i, t, source[i]) for i, t in kept.items()])
        if name == "mixing":
            assert ids == want
        elif name == "bpe":
            tok = Tokenizer.from_file(bpe.public_file())
            assert sorted((x.doc_id, x.n_tokens) for x in docs.select("doc_id", "n_tokens").collect()) == sorted((i, len(tok.encode(kept[i]).ids)) for i in want)
        else:
            assert ids == sorted(kept), name
        if name != "bpe":
            assert docs.columns == before
