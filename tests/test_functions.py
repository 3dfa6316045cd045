"""Golden values of text and statistics functions."""

import math

import pytest
from pyspark.sql import functions as F

from cairn.functions import stats as S
from cairn.functions import text as T
from cairn.functions import udfs as U
from cairn.operators import corpus as C
from cairn.operators import evidence as E
from cairn.operators import resolve as R
from cairn.operators import scoring as P
from cairn.sources import readers, sinks


def one(spark, *columns, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(1).alias("__"))
    row = df.select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def strings(spark, f, inputs):
    df = spark.createDataFrame(list(enumerate(inputs)), "i int, x string")
    return [r[0] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_rarity(spark):
    df = spark.createDataFrame([(0,), (2000,), (10**7,), (-5,), (50,)], "x long")
    got = [r[0] for r in df.select(S.rarity_from_df(F.col("x"))).collect()]
    assert got == pytest.approx([1, 0, 0, 1, 1 - math.log(51) / math.log(2001)])
    with pytest.raises(ValueError):
        S.rarity_from_df(F.col("x"), 0)
    assert one(spark, S.rarity_from_df(F.lit(3), 200)) == pytest.approx(1 - math.log(4) / math.log(201))


def test_idf_and_npmi(spark):
    assert one(spark, S.idf(F.lit(8110), F.lit(0)), S.idf(F.lit(8110), F.lit(8110)), S.idf(F.lit(0), F.lit(0))) == pytest.approx((math.log(8111), 0, 0))
    n = lambda *x: S.npmi(*map(F.lit, x))
    got = one(spark, n(100, 5, 5, 0), n(10, 10, 10, 10), n(0, 1, 1, 1), n(100, 10, 10, 1), n(100, 5, 9, 50))
    assert got[:3] == (-1.0, 1.0, None) and got[3] == pytest.approx(0) and got[4] == pytest.approx(math.log(0.05 * 10000 / 45) / -math.log(0.05))
    assert one(spark, *(S.atypicality(F.lit(x).cast("double")) for x in (-1, 0, 1, None, -7))) == (1, 0.5, 0, None, 1)


def test_idea_terms_and_cliches(spark):
    terms = T.idea_terms(F.lit("A beehive monitor that warns gardeners by radio"))
    assert sorted(one(spark, terms)) == ["beehive", "gardener", "monitor", "radio", "warn"]
    share = lambda *c: T.cliche_overlap(terms, F.array(*map(F.lit, c)) if c else F.array().cast("array<string>"))
    assert one(spark, share("gardener", "radio", "sensor"), share(), share("bees", "beehives", "radios", "warn", "gard")) == pytest.approx((0.4, 0.0, 0.8))


def test_rerank_scores_and_grades(spark):
    raw = [one(spark, S.from_rerank(F.lit(x))) for x in (1.4, 1.0, 0.5, 0.0, -2.0)]
    assert raw == pytest.approx([0.4, 0.0, math.log(0.5), -1.0, -1.0])
    floors = {"same": F.lit(0.4), "close": F.lit(0.2)}
    g = lambda s, name: one(spark, S.graded(F.lit(s), F.lit(name).cast("string"), floors))
    assert [g(-0.04, "same"), g(0.9, "same"), g(0.1, "close"), g(-0.5, None), g(1.5, "other")] == pytest.approx([0.39, 0.9, 0.225, 0.0, 1.0])
    assert one(spark, S.match_scale(F.lit(0.156)), S.match_scale(F.lit(0.365))) == pytest.approx((0.5, 0.9))
    sizes = spark.createDataFrame([(8000,), (52_400,), (99_999,), (100_000,), (10**7,)], "n long")
    assert [r[0] for r in sizes.select(C.effective_min_global(F.col("n"))).collect()] == [25, 100, 191, 500, 500]
    m = one(spark, S.moments(F.array(F.lit(math.log(0.5)), F.lit(math.log(0.25)))))
    mean = (2 * math.log(0.5) + math.log(0.25)) / 3
    assert m["mean"] == pytest.approx(mean) and m["variance"] == pytest.approx((2 * (math.log(0.5) - mean) ** 2 + (math.log(0.25) - mean) ** 2) / 3)
    assert one(spark, S.moments(F.array(F.lit(-1.0)))) is None
    agree = lambda a, b: one(spark, S.detector_agreement(F.lit(a).cast("string"), F.lit(b).cast("string")))
    assert [agree("mixed", "ai"), agree("human", "ai"), agree("ai", "human"), agree(None, "ai"), agree("human", "human")] == ["agree", "disagree", "disagree", "unknown", "agree"]
    assert [one(spark, S.curvature_class(F.lit(x).cast("double"))) for x in (0.95, 0.949, None)] == ["ai", "human", None]
    drawn = spark.range(4000).select(S.resample_count(F.lit(50), F.lit(1000), F.col("id")).alias("k")).agg(F.avg("k"), F.stddev("k")).first()
    assert abs(drawn[0] - 50) < 0.6 and abs(drawn[1] - math.sqrt(50 * 0.95)) < 0.5


def test_terms_by_provenance(spark):
    f = lambda listed, block, prose: tuple(one(spark, T.extract_terms(F.array(*map(F.lit, listed)) if listed else F.lit(None).cast("array<string>"), F.lit(block).cast("string"), F.lit(prose).cast("string"))))
    assert f([" Rust ", "rust", ""], "x", "y") == (["rust"], "source")
    assert f([], "Flask, Redis\nFlask", "react") == (["flask", "redis"], "normalized")
    assert f([], None, "We wrote it in ReactJS, C++ and golang, on AWS; no javascripty things.") == (["react", "c++", "go", "amazon-web-services"], "imputed")
    assert f([], None, "nothing") == ([], None)
    sites = [["https://github.com/a/b", "https://demo.vercel.app/x", "https://own.example/"], ["https://youtu.be/q"], []]
    rows = spark.createDataFrame([(x,) for x in sites], "l array<string>")
    assert [r[0] for r in rows.select(T.product_site(F.col("l"))).collect()] == ["https://own.example/", None, None]
    assert strings(spark, T.plain_url, ["HTTPS://www.Own.example/a/?q=1", "own.example/a#b", None]) == ["own.example/a", "own.example/a", ""]
    assert strings(spark, lambda c: T.activity(c, F.lit("2024-06-01").cast("date")), ["2022-11-01T00:00:00Z", "2024-01-01T00:00:00Z", "soon", None]) == ["dormant", "active", "unknown", "unknown"]


def test_cuts_and_places(spark):
    text = "One sentence stands here. Another one follows it. A third."
    cut = lambda n: one(spark, T.cut_at_sentence(F.lit(text), n))
    assert [cut(100), cut(50), cut(30), cut(20)] == [text, "One sentence stands here. Another one follows it.", "One sentence stands here.", "One sentence stands"]
    body = "Team photo\n\nhttps://own.example/pic\n\nWe measure the water in rivers and tell the town about it.\n\nMap\n\nIt runs on solar power."
    assert one(spark, T.first_paragraphs(F.lit(body))) == "We measure the water in rivers and tell the town about it.\nMap\nIt runs on solar power."
    assert one(spark, T.first_paragraphs(F.lit("Team photo\n\nMap"))) == ""
    plain = U.PlainText("A  “quoted”\nWord – here")
    assert plain.text == 'a "quoted" word - here' and plain.find('"QUOTED" word') == (3, 16) and plain.find("word", 13) is None and plain.find("absent") is None
    assert U.located_one("First one. Second – one. First one.", ["First one.", "second - ONE.", "First one.", "Nowhere."]) == [(0, 10), (11, 24), (25, 35), None]
    one_by_one = [len(r) for r in one(spark, F.transform(T.running_sums(F.sequence(F.lit(1), F.lit(1000))), lambda x: F.array(x)))]
    assert len(one_by_one) == 1000 and one(spark, T.running_sums(F.sequence(F.lit(1), F.lit(1000))))[999] == 999 * 1000 // 2
    assert one(spark, T.clean_text(F.lit("a &amp; b \\textbf{bold} $\\frac{1}{2}$"))) == "a & b bold 1/2"


def test_crowding_and_midrank(spark):
    sims = F.array(*(F.lit(x).cast("double") for x in (0.2, 0.9, None, 0.8, 0.7, 0.1, 0.05)))
    assert one(spark, S.crowding_lite(sims)) == pytest.approx(0.6 * 0.9 + 0.4 * (0.9 + 0.8 + 0.7 + 0.2 + 0.1) / 5)
    assert one(spark, S.crowding_lite(F.array().cast("array<double>"))) == 0
    values = spark.createDataFrame([(1, 0.1), (2, 0.3), (3, 0.4), (4, 0.9)], "id int, value double")
    reference = spark.createDataFrame([(0.2,), (0.4,), (0.4,), (0.8,)], "value double")
    assert {r.id: r.percentile for r in P.percentiles(values, reference).collect()} == {1: 0, 2: 0.25, 3: 0.5, 4: 1}


def test_intervals_and_tails(spark):
    assert one(spark, *(F.round(S.dkw(F.lit(n)), 3) for n in (300, 1000, 0))) == (0.078, 0.043, 1.0)
    sf = lambda *x: S.gpd_survival(*(F.lit(float(v)) for v in x))
    assert one(spark, sf(-1, 1, 1), sf(2, 0, 1), sf(1, 1, 1), sf(9, -0.5, 1), sf(1, 1, 0)) == pytest.approx((1, math.exp(-2), 0.5, 0, 0))
    lo, hi = S.wilson(F.lit(0), F.lit(0))
    assert one(spark, lo, hi) == (0.0, 1.0)
    n = 2000
    x = spark.range(n).select(F.lit("e").alias("g"), (-2 * F.log(1 - (F.col("id") + 0.5) / n)).alias("x"))
    fit = P.gpd_fit(x, "g").first()
    assert abs(fit["shape"]) < 0.08 and abs(fit["scale"] - 2) < 0.2
    assert P.gpd_fit(x.limit(5), "g").first()["shape"] is None
    assert P.gpd_fit(x.limit(15), "g").first()["shape"] is not None and P.tail_fit(x.limit(19), "g").first()["shape"] is None and P.tail_fit(x.limit(20), "g").first()["shape"] is not None
    assert one(spark, S.confidence(F.lit(1.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)), S.confidence(F.lit(1.0), F.lit(0.35), F.lit(1.0), F.lit(1.0))) == pytest.approx((1, 0.75))


def test_urls_and_names(spark):
    urls = ["HTTPS://www.github.com/Oak-Lab/TideClock.git/", "https://github.com", "http://a.org/x/?q=1#top", "https://news.ycombinator.com/item?id=7", "a.org"]
    assert strings(spark, T.norm_url, urls) == ["github.com/oak-lab/tideclock", None, "a.org/x", "news.ycombinator.com/item?id=7", "a.org"]
    assert strings(spark, T.norm_name, ["Ask HN: TideClock — when to sail", "oak-lab/tideclock", "A, b"]) == ["tideclock", "tideclock", "a"]
    assert one(spark, T.jaccard(T.trigrams(F.lit("idearadar")), T.trigrams(F.lit("idearadar")))) == 1.0
    links = F.array(*map(F.lit, ("github.com", "https://github.com/a/b.git", "https://github.com/a/b", "https://x.org/p?utm_source=a&k=1")))
    assert one(spark, T.normalise_links(links)) == ["https://github.com/a/b", "https://x.org/p?k=1"]
    assert strings(spark, T.slug_from_url, ["https://x.org/Software/My-App?ref=1"]) == ["my-app"]
    assert strings(spark, T.host_is_public, ["http://10.0.0.1/x", "https://a.org", "ftp://a.org", "http://localhost/"]) == [False, True, False, False]


def test_lists_and_text(spark):
    assert strings(spark, T.parse_listish, ["['c#', 'unity']", "[]", "nan", "a, b"]) == [["c#", "unity"], [], [], ["a", "b"]]
    long = "One sentence here. " * 100
    assert len(one(spark, T.truncate_at_sentence(F.lit(long), 300))) <= 300
    assert strings(spark, T.guess_lang, ["short", "the cat is on the mat and it was with the dog in the house", "der Hund ist nicht auf dem Dach und die Katze ist mit von zu", "Сегодня мы идём в лес за грибами", "今日は天気がいいので散歩に行きましょうねとても", "o barco não sai com mau tempo mas os homens que vivem em terra, para sua sorte, por mais uma noite"]) == ["und", "en", "de", "ru", "ja", "pt"]
    spans = one(spark, T.sentence_spans(F.lit("One. Two! Three")))
    assert [(s["start"], s["end"], s["sentence"]) for s in spans] == [(0, 4, "One."), (5, 9, "Two!"), (10, 15, "Three")]
    assert one(spark, T.strip_markdown_inline(F.lit("**b** [t](u) `c`"))) == "b t c"
    assert one(spark, T.clean_text(F.lit("a<b>x</b>\r\n\n\n\nb"))) == "a x \n\nb"
    assert one(spark, T.broaden(F.lit("a find friendly neighbourhood gardens")))[0] == "neighbourhood"


def test_sections_and_pitch():
    text = "Intro line here.\n## What it does\nIt finds ideas.\nCHALLENGES:\nMany of them.\n**2. What it does**\nAnd more.\n## Odd Thing\nx\n## Empty\nHow we built it: with glue and a lot of patience\nBuilt with: flask and other things of the kind\n"
    got = U.sections_one(text)
    assert got == {"preamble": "Intro line here.", "what_it_does": "It finds ideas.\nAnd more.", "challenges": "Many of them.", "other:odd_thing": "x", "how_we_built_it": "with glue and a lot of patience\nBuilt with: flask and other things of the kind"}
    assert U.known_heading("🚀 What’s next for TideClock?") == "whats_next" and U.heading_of("This is a prose line about what we learned today.") is None and U.known_heading("What is TideClock") == "what_it_does"
    pitch = U.pitch_one("TideClock", "tells when to sail", {"what_it_does": "It works. " * 400})
    assert pitch.startswith("TideClock. tells when to sail. It works.") and 1400 < len(pitch) <= 1500 and "\n" not in pitch and pitch.endswith(".")
    assert U.pitch_one("TideClock", "Reads the tide tables of harbours", {"problem": "Reads the tide tables of harbours and warns sailors."}) == "TideClock. Reads the tide tables of harbours and warns sailors."
    assert U.html_to_text_one("<h2>A &amp; B</h2><p>x<li>y<script>z</script>") == "## A & B\n\nx\n- y"
    assert U.html_to_text_one("<div>one</div><div>two<br>three</div><figure>no</figure>") == "one\n\ntwo\nthree"


def test_quotes(spark):
    source = "the quick brown fox jumps over the lazy dog near the old river bank today"
    found = lambda q: one(spark, E.quote_found(F.lit(q), F.lit(source)))
    assert found("Quick brown fox jumps") and found("quick brown … lazy dog") and not found("brown fox") and not found("fox brown quick the")
    eleven = "the quick brown fox jumps over a lazy dog near the old"
    assert U.fuzzy_contains_one(eleven, source) >= 0.9 and U.fuzzy_contains_one("dog lazy the over jumps fox brown quick", source) < 0.9 and U.fuzzy_contains_one("quick brown fox", source) == 0


def test_resolution(spark):
    names = spark.createDataFrame([("idearadar",), ("idearadars",), ("other",), ("",)], "name string")
    assert [(r.a, r.b) for r in R.name_pairs(names).collect()] == [("idearadar", "idearadars")]
    nodes = spark.createDataFrame([(i,) for i in range(1, 9)], "id long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in R.components(nodes, edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"items": [{"id": 1, "name": "x"}, {"id": 2, "name": null}]}')
    assert readers.json_array(spark, str(tmp_path / "a.json"), "items array<struct<id:int,name:string>>", "items").count() == 2
    (tmp_path / "l.jsonl").write_text('{"event_id": 1}\n{"event_id": 2}\n')
    assert readers.jsonl(spark, str(tmp_path / "l.jsonl"), "event_id long").count() == 2
    rows = spark.createDataFrame([(2020, "b"), (None, "a"), (2021, "c"), (2020, "a")], "year int, rid string")
    page = sinks.keyset_page(rows, "year", "rid", (2020, "a"), 10)
    assert [tuple(r) for r in page.collect()] == [(2020, "b"), (None, "a")]
    site = spark.createDataFrame([("x", None, 200), (None, "Verify you are human", 200), (None, "ok", 404), (None, "ok", 401), (None, "domain is for sale", 200)], "e string, t string, s int")
    assert [r[0] for r in site.select(T.site_class(F.col("e"), F.col("t"), F.col("s"))).collect()] == ["dead", "blocked", "dead", "alive", "parked"]


def test_suffix_gain_of_long_texts(spark, tmp_path):
    from cairn.plans.catalog import ALL

    texts = [" ".join(f"w{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(n)) for n in (300, 401, 5000)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.gain for r in ALL["suffix_gain"].run(spark, str(tmp_path)).collect()}
    assert len(got) == 3 and None not in got.values()


def test_short_quotes_in_long_documents(spark):
    from cairn.operators import evidence as E

    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "five six seven eight"), (3, "four five six and seven eight")], "rid long, text string")
    items = [(10, "five six seven eight"), (11, "Ten, eleven twelve!"), (12, "nine ten eleven twelve"), (13, "two three four five six seven"), (14, "two three four five six seven eight nine ten"), (15, "five six and seven eight")]
    got = E.contained_quotes(spark.createDataFrame(items, "item_id long, text string"), docs).collect()
    assert sorted(map(tuple, got)) == [(10, 1), (10, 2), (12, 1), (13, 1), (14, 1), (15, 3)]
    assert E.contained_quotes(spark.createDataFrame([], "item_id long, text string"), docs).count() == 0


def test_fuzzy_quote_without_its_longest_words(spark, tmp_path):
    from cairn.plans.catalog import ALL

    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(33)]
    quote = list(words)
    for at in (3, 14, 25):
        quote[at] = f"longestwords{at}"
    for name, key, rows in (("documents", "doc_id", [(1, "Before this " + " ".join(words) + " after."), (2, "nothing of it")]), ("benchmark", "item_id", [(7, " ".join(quote))])):
        spark.createDataFrame(rows, f"{key} long, text string").write.parquet(str(tmp_path / f"{name}.parquet"))
    got = ALL["quote_fuzzy"].run(spark, str(tmp_path)).collect()
    assert [(r.item_id, r.rid, r.exact) for r in got] == [(7, 1, False)] and got[0].share >= 0.9


PROJECT_PAGE = """<html><head><meta property="og:title" content="Meta title"><meta property="og:description" content="Meta line"></head><body>
<div id="software-header"><h1 id="app-title"> Tide  Clock </h1><p class="large">Tells when to &amp; where to sail</p></div>
<div id="app-details-left"><div id="gallery">no</div><div><h2>What it does</h2><p>It reads tide tables.</p><ul><li>fast</ul></div>
<div id="built-with"><span class="cp-tag">Rust</span><span class="cp-tag recognized">rust</span><span class="cp-tag">SQLite</span></div>
<nav><ul data-role="software-urls"><li><a href="https://tide.example/">site</a><li><a href="https://github.com/oak/tide">code</a></ul></nav></div>
<div id="submissions"><div class="software-list-content"><p><a href="https://harbour-2023.events.example/">Harbour Days</a></p><ul><li><span class="winner">Winner</span> Best use of water</li><li>Entered</li></ul></div></div>
<div id="app-team"><div class="software-team-member"></div><div class="software-team-member"></div></div><a class="like-button"><span class="side-count">17</span></a>
<time datetime="2023-05-09T10:00:00Z"></time><time datetime="2023-05-02T10:00:00Z"></time><time datetime="soon"></time></body></html>"""
LISTING = """<div class="gallery-item"><a class="link-to-software" href="https://events.example/software/tide?ref=1"></a><h5>Tide</h5><p class="tagline">Sails</p><aside><img class="winner"></aside></div>
<div class="gallery-item"><a class="link-to-software" href="https://events.example/software/tide/"></a></div><div class="gallery-item"><a class="link-to-software" href="/about">x</a></div>
<ul class="pagination"><li class="next"><a href="/software?page=3">Next</a></li></ul>"""


def test_pages_to_records(spark):
    from cairn.sources import pages

    rows = spark.createDataFrame([(1, PROJECT_PAGE), (2, None), (3, "<p>x")], "page_id long, html string")
    got = {r.page_id: r.x for r in rows.select("page_id", pages.project_page("html").alias("x")).collect()}
    x = got[1]
    assert (x.title, x.tagline, x.tech, x.links) == ("Tide Clock", "Tells when to & where to sail", ["rust", "sqlite"], ["https://tide.example/", "https://github.com/oak/tide"])
    assert (x.hackathon, x.hackathon_id, x.prizes, x.is_winner, x.team_size, x.likes, x.started, x.year) == ("Harbour Days", "harbour-2023", ["Best use of water"], True, 2, 17, "2023-05-02", 2023)
    assert x.body == "## What it does\n\nIt reads tide tables.\n\n- fast" and got[3].title is None and got[3].is_winner is False and got[2].title is None
    listing = spark.createDataFrame([(LISTING, "https://events.example/software?page=2"), ("", None)], "html string, url string").select(pages.gallery_page("html", "url").alias("g")).collect()
    assert [(e.url, e.title, e.tagline, e.is_winner) for e in listing[0].g.entries] == [("https://events.example/software/tide", "Tide", "Sails", True)]
    assert listing[0].g.next_page == "https://events.example/software?page=3" and listing[1].g.entries == [] and listing[1].g.next_page is None


def test_dimensions_filters_and_documents(spark, tmp_path):
    import json

    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "name": "x", "themes": [{"id": 5}]}, {"id": None, "name": "y"}, {"id": 1, "name": "x", "themes": [{"id": 5}]}]))
    (tmp_path / "o.json").write_text(json.dumps({"events": [{"id": 7, "name": "z"}, {"id": 8, "name": None}]}))
    assert [(r.id, r.name, r.themes[0].id) for r in readers.json_dimension(spark, str(tmp_path / "a.json"), "id:bigint,name:string,themes:array<struct<id:bigint>>", "id").collect()] == [(1, "x", 5)]
    assert sorted((r.id, r.name) for r in readers.json_dimension(spark, str(tmp_path / "o.json"), "id:bigint,name:string", "id", "events").collect()) == [(7, "z"), (8, None)]
    urls = ["https://own.example/a", "https://http/www", "https://directory.example/own"]
    assert strings(spark, lambda u: readers.is_page(u, ("directory.example",)), urls) == [True, False, False]
    records = spark.createDataFrame([(1, "Tide Clock: home", "https://t.example"), (2, "x", "https://tide-clock.example"), (3, "Cerebrum", "https://c.example")], "rid long, title string, url string")
    names = spark.createDataFrame([("Tide Clock (app)",), ("Cere",), ("ab",), ("Cerebras",)], "name string")
    assert sorted(map(tuple, readers.lookup(names, records).collect())) == [("Cere", 3), ("Tide Clock (app)", 1)]
    rows = spark.createDataFrame([("r1", 2020, None, ["a", "b"], {}), ("r2", None, None, [], {"x": "y"})], "rid string, year int, date date, prizes array<string>, sections map<string,string>")
    docs = sinks.documents(rows).withColumn("line", F.to_json(F.struct(F.col("*"))))
    assert [json.loads(r.line) for r in docs.orderBy("rid").collect()] == [{"rid": "r1", "year": 2020, "prize": "a; b", "is_winner": True, "first_seen_at": "2020-01-01"}, {"rid": "r2", "sections": {"x": "y"}, "is_winner": False}]
    sinks.write_jsonl(docs.drop("line"), str(tmp_path / "lines"))
    assert readers.jsonl(spark, str(tmp_path / "lines"), "rid string, prize string").orderBy("rid").collect()[0].prize == "a; b"
