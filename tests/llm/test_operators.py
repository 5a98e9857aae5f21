"""Small tables with nulls, empties, ties, repeats, clashing columns and planted cases."""

import base64
import hashlib
import inspect
import random
import string

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strata.llm import ann, chat, decontam, html_crf, jaccard, language, packing, repeats, secrets, toxicity
from strata.llm.common import gathered, id_fold
from strata.llm.queries import TOKENIZER

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    a, b = words(1, 120), words(2, 60)
    rows = [(1, a), (2, a), (3, a.replace(" ", " x ", 2)), (4, None), (5, ""), (6, b + " " + a), (6, b + " " + a), (None, b), (7, words(3, 4000)), (8, "one two")]
    return spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], DOCS)


def test_trigram_queries():
    assert secrets.trigram_query(r"[0-9a-f]+") is None
    assert secrets.trigram_query(r"AKIA[A-Z0-9]+") == [["aki", "kia"]]
    q = secrets.trigram_query(secrets.RULES[0].pattern)
    assert ["ken", "oke", "tok"] in q and all("passwd x".find(t) >= 0 for t in ["pas", "ass", "ssw", "swd"])


def test_secret_scan_and_redaction(spark):
    key = "AKIA" + "Q" * 16
    text = f"\U0001f600 Token = 'abcdef12' {key} " + "a1" * 12 + " secret=token:abcdefgh password=abc"
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, "api_key: zzzzzz"), (4, "nothing")]
    df = spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, spans string")
    got = secrets.scan(df).orderBy("doc_id").collect()
    assert len(got) == 6
    by = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in got}
    at = text.index
    assert by[1] == [("assign", at("Token"), at("abcdef12") + 8), ("access", at(key), at(key) + 20), ("hex", at("a1a1"), at("a1a1") + 24)]
    assert by[None] == [("assign", 0, 15)] and by[2] == by[3] == by[4] == []
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(secrets.scan(df)).collect()}
    assert key not in clean[1] and clean[2] is None and clean[4] == "nothing" and clean[1].count("[secret]") == 3
    assert secrets.scan(df.limit(0)).count() == 0


def test_pages():
    crf = html_crf.train(html_crf.labelled_pages(150))
    page = ("<html><head><title>no</title></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class='ad'>Buy now this.</div>"
            "<article><h1>A &amp; B</h1><p><b>First line of the text here.<br><p>Second\n  one &lt;b&gt; of it goes on.</p><script>x='</p>'</script></article>"
            "<footer>&copy; me</footer>")
    assert html_crf.main_text(page, crf) == "A & B\nFirst line of the text here.\nSecond one <b> of it goes on."
    assert html_crf.main_text("", crf) == "" and html_crf.main_text("<<< <p", crf) is not None


@pytest.mark.parametrize("raw", ["<script>for(var i=0;i<n;i++){f(i)}</script>", "<script>if(a<b){x()}</SCRIPT >", "<script><!-- a='</p>'</script>",
                                 "<style>/* <a \" ' */</style>", "<script>if(a<b){x('</scripted>')}</script>", "<noscript><!-- <p '</noscript>", "<template><script>if(a<b){it's}</script>no</template>",
                                 "<svg><style>a<b</style><!-- </svg> --><text>no</text></svg>", "<svg><path d='</svg>"])
def test_text_after_raw_elements_stays(raw):
    page = f"<body>{raw}<article><p>One {raw}two.</p></article>"
    assert [b.text for b in html_crf.blocks(page)] == ["One two."]


def test_text_of_formulas_and_fallbacks_stays():
    page = "<article><p>As <math display='block'><mi>E</mi><mo>=</mo><mrow><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></mrow></math> says.</p><object data=x><param name=a><p>No film here.</p></object>"
    assert [b.text for b in html_crf.blocks(page)] == ["As E=mc2 says.", "No film here."]


THEMES = ["comments-open", "no-sidebar has-comments", "single-post postid-7 comments", "home nav-open", "footer-fixed", "menu-open sidebar-right", "cookie-notice", "ads-enabled", "has-widgets subscribe", "page related-posts"]


@pytest.fixture(scope="module")
def crf():
    return html_crf.train(html_crf.labelled_pages())


@pytest.mark.parametrize("theme", THEMES)
def test_classes_of_the_whole_page_lose_no_article(crf, theme):
    story = [words(i, 45).capitalize() + "." for i in range(6)]
    page = f"<html class='{theme}'><body class='{theme}'><nav class='menu'><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>A title of it</h1>" + "".join(f"<p>{p}</p>" for p in story) + "</article></body></html>"
    assert html_crf.main_text(page, crf) == "\n".join(["A title of it", *story])


def test_quotation_marks_that_open_nothing():
    def texts(page):
        return [b.text for b in html_crf.blocks(page)]

    assert texts("<p title=don't>First article text.</p><p>It isn't lost.</p><p>Third</p>") == ["First article text.", "It isn't lost.", "Third"]
    assert texts("<p title='a > b' class = \"c>d\" x>One</p><p a\"b>Two</p>") == ["One", "Two"]
    assert texts("<p>One</p><!-- > never closed <p>Two</p> > three") == ["One"]
    assert texts("a < b and <p>c</p> d <e") == ["a < b and", "c", "d <e"]


def test_deep_and_broken_pages_cost_their_length():
    import time

    def spent(page):
        at = time.process_time()
        got = html_crf.features(html_crf.blocks(page))
        return time.process_time() - at, len(got)

    for unit, n, blocks in (("<div>x", 100_000, 100_000), ("<a '", 100_000, 1), ("<a b=\"", 100_000, 1), ("<b>x</i>", 50_000, 1), ("<div>x</p>", 50_000, 50_000), ("<li><div>", 50_000, 0), ("<!--", 50_000, 0)):
        seconds, found = spent(unit * n)
        assert found == blocks and seconds < 10, unit


def test_columns_named_like_the_work_columns(spark, crf):
    df = spark.createDataFrame([(1, "<article><p>Some text that is long enough to stay here.</p></article>", 7, "x")], "page_id long, html string, _html int, __HTML string")
    row = html_crf.extract(df, crf).first()
    assert row["_html"] == 7 and row["__HTML"] == "x" and row["text"].startswith("Some text")
    docs = spark.createDataFrame([(i, words(i, 40), "aa", i) for i in range(6)], "doc_id long, text string, lang string, _text int")
    got = language.identify(docs, language.fit(docs.select("text", "lang"))).collect()
    assert sorted(r["_text"] for r in got) == list(range(6)) and {r["lang_pred"] for r in got} <= {"aa", "und"}
    bench = spark.createDataFrame([(1, docs.filter("doc_id = 3").first()["text"])], "item_id long, text string")
    assert sorted(r["_text"] for r in decontam.clean(docs, bench).collect()) == [0, 1, 2, 4, 5]


def test_letters_of_any_plane(spark):
    assert language.grams(["\U00030000 \U000313af", "123 \U0001f600", ""])[1].tolist() == [True, False, False]


def test_pages_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y")], "page_id long, html string, text string")
    assert [r["text"] for r in html_crf.extract(df).collect()] == ["", ""]


def test_crf_viterbi_is_the_best_path():
    crf = html_crf.Crf({"a": 1.0, "b": -1.5}, ((0.3, -0.2), (-0.4, 0.6)))
    page = [["a"], ["b"], ["a"], ["b"], ["b"]]

    def value(y):
        return sum(crf.weights[f] for f, k in zip("ababb", y) if k) + sum(crf.step[p][q] for p, q in zip(y, y[1:]))

    best = max(([(n >> i) & 1 for i in range(5)] for n in range(32)), key=value)
    page = [[f] for f in "ababb"]
    assert crf.decode(page) == [bool(k) for k in best]


def test_word_cache_equals_the_tokenizer():
    texts = ["Don't STOP... cafe\u0301 na\u00efve!!", "", " ", "A_b \u0130x \u03a3\u03a3 12ab <|endoftext|>z", "tab\there\nnew\u2028x"]
    cache = packing.WordCache(TOKENIZER)
    ids, at = cache.encode(texts)
    for i, t in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == [*cache.tokenizer.encode(t, add_special_tokens=False).ids, 0]


def test_packing_plan():
    rnd = random.Random(4)
    for _ in range(20):
        sizes = [rnd.randint(1, 100) for _ in range(rnd.randint(1, 400))]
        counts = {s: sizes.count(s) for s in sizes}
        room = {}
        seen = {}
        for size, first, n, per, start, offset in packing.plan_packing(counts, 100):
            for k in range(n):
                room.setdefault(start + k // per, []).append((offset + k % per * size, size))
            assert seen.get(size, 0) == first
            seen[size] = first + n
        assert seen == counts
        for parts in room.values():
            end = 0
            for o, s in sorted(parts):
                assert o == end
                end = o + s
            assert end <= 100
            assert sum(3 * s > 100 for _, s in parts) <= 2
        assert len(room) <= 1.1 * sum(sizes) / 100 + 2


def test_packing_table(docs):
    got = packing.pack(docs, TOKENIZER).toPandas()
    assert len(got[got.doc_id == 6]) == 2 and (got[got.doc_id == 5].length == 1).all()
    g = got.sort_values(["sequence_id", "offset"])
    assert ((g.groupby("sequence_id").length.cumsum() - g.length) == g.offset).all() and g.groupby("sequence_id").length.sum().max() <= 2048
    assert packing.pack(docs.limit(0), TOKENIZER).count() == 0


def test_languages(spark):
    rnd = random.Random(2)
    said = {"aa": "lo mi ta rena", "bb": "schk pfen urt zag"}
    rows = [(" ".join(rnd.choice(v.split()) for _ in range(30)), k) for k, v in said.items() for _ in range(40)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    df = spark.createDataFrame([(1, "mi ta rena lo", 5.0), (2, "zag urt schk", 1.0), (3, None, 1.0), (4, "123 !?", 1.0)], "doc_id long, text string, score double")
    got = {r["doc_id"]: r for r in language.identify(df, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["aa", "bb", "und", "und"]
    assert got[3]["rejected"] and not got[1]["rejected"] and all(0 <= r["score"] <= 1 for r in got.values())
    empty = language.fit(spark.createDataFrame([], "text string, lang string"))
    assert empty.predict(["abc"])[3].all()


def test_unlearned_languages_go_and_held_out_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", id_fold("doc_id", 3) == 1)
    model = language.fit(docs.filter("not held").select("text", "lang"))
    rnd = random.Random(7)
    foreign = ["Il governo ha annunciato ieri che le nuove misure entreranno in vigore dal prossimo anno, mentre le opposizioni chiedono un dibattito in parlamento.",
               "Rząd ogłosił wczoraj, że nowe przepisy wejdą w życie w przyszłym roku, podczas gdy opozycja domaga się debaty w parlamencie.",
               "Hükümet dün yeni önlemlerin gelecek yıldan itibaren yürürlüğe gireceğini duyurdu, muhalefet ise mecliste bir tartışma istiyor.",
               inspect.getsource(language.grams), base64.b64encode(rnd.randbytes(900)).decode(), " ".join("".join(rnd.choices(string.ascii_lowercase, k=6)) for _ in range(80))]
    assert model.predict(foreign)[3].all()
    held = language.identify(docs.filter("held and text rlike '[a-z]'"), model).select("rejected").collect()
    assert len(held) > 250 and sum(r["rejected"] for r in held) <= len(held) // 100


def test_jaccard_against_brute_force(docs):
    got = {r["doc_id"]: r for r in jaccard.join(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.filter("doc_id is not null").collect()}
    sets = dict(zip(texts, (set(s.tolist()) for s in jaccard.shingles([t or "" for t in texts.values()]))))
    for i in texts:
        linked = [j for j in texts if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        assert got[i]["n_links"] == len(linked)
        assert got[i]["class_id"] == min([i, *linked])
    assert jaccard.join(docs.limit(0)).count() == 0


def test_jaccard_blocks_and_components(spark):
    base = words(9, 200).split()
    rows = [(i, " ".join(base[:k] + [f"w{i}"] + base[k:])) for i, k in enumerate(random.Random(1).choices(range(200), k=60))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, jaccard.join(df).collect()))
    assert whole == sorted(map(tuple, jaccard.join(df, block=8).collect())) and all(r[1] == 0 and r[3] == 59 for r in whole)
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "a long, b long")
    assert {tuple(r) for r in jaccard.components(chain).collect()} == {(i, 0) for i in range(41)} | {(90, 90), (100, 90)}


def test_tiles():
    item = list(range(1, 21))
    assert decontam.tiles(item, [0, *item, 0]) == [(0, 1, 20)]
    assert sum(n for *_, n in decontam.tiles(item, item[10:] + [99, 98] + item[:10])) == 20
    assert decontam.tiles(item, item[::-1]) == []
    assert decontam.tiles([1, 2, 3, 4] * 3, [1, 2, 3, 4]) == [(0, 0, 4)]


def test_decontamination(spark):
    item = words(30, 40)
    half = item.split()
    rows = [(1, words(31, 50) + " " + item.upper() + ". " + words(32, 20)), (2, " ".join(half[25:] + ["x"] + half[:25])), (3, words(33, 300)), (4, None), (5, ""), (6, " ".join(half[:9]))]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "a b")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.matches(df, bench).collect()} == {(1, 7), (2, 7)}
    assert {r["doc_id"] for r in decontam.clean(df, bench).collect()} == {3, 4, 5, 6}
    assert decontam.clean(df, bench.limit(0)).count() == 6 and decontam.matches(df.limit(0), bench).count() == 0


def test_gradients():
    net = toxicity.Net.fresh()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    some = toxicity.Words.of(["ab", "cde", "f"])
    at, on, y = np.array([[0, 1, 2], [2, 1, 0]]), np.array([[1, 1, 1], [1, 1, 0]], bool), np.array([1.0, 0.0])

    def loss():
        x = net.inputs(some)[at]
        hs = {d: toxicity._gru_forward(x[:, t] @ net.p[f"w{d}"] + net.p[f"c{d}"], net.p[f"u{d}"], on[:, t])[0][:, t] for d, t in (("f", slice(None)), ("b", slice(None, None, -1)))}
        both = np.concatenate([hs["f"], hs["b"]], axis=2)
        a = np.exp(np.where(on, both @ net.p["pool"], -1e9))
        p = toxicity._sigmoid(((a / a.sum(1, keepdims=True))[:, :, None] * both).sum(1) @ net.p["out"] + net.p["bias"])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = net.step(some, at, on, y, on)
    for k, spot in (("uf", (1, 2)), ("wb", (3, 5)), ("pool", (4,)), ("out", (7,))):
        was = net.p[k][spot]
        net.p[k][spot] = was + 1e-4
        up = loss()
        net.p[k][spot] = was - 1e-4
        down = loss()
        net.p[k][spot] = was
        assert abs((up - down) / 2e-4 - g[k][spot]) < 1e-4


def test_toxicity_learns_and_handles_empties(spark):
    rows = [(i, words(i, 40) + (" vilefoo " if i % 2 else " ") + words(i + 999, 30)) for i in range(600)]
    docs = spark.createDataFrame([(i, t, 9.0) for i, t in [*rows, (900, None), (901, "")]], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)] + [(5, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(got) == 602 and got[900] == got[901] == 0
    assert sum(got[i] == i % 2 for i in range(500, 600)) >= 90


def test_sample_ranks_a_label_in_parts(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))
    got = toxicity.sample(docs, labels, per_label=5)
    first = labels.orderBy(F.xxhash64("doc_id"))
    want = {(f"t {r['doc_id']}", y) for y in (0, 1) for r in first.filter(f"toxic = {y}").limit(5).collect()}
    assert {tuple(r) for r in got.collect()} == want
    assert "_salt" in got._jdf.queryExecution().optimizedPlan().toString()


def _net_and_logit():
    net = toxicity.Net.fresh()

    def logit(text):
        """By the network that training uses."""
        codes, some, _ = toxicity.tokens([text])
        x, on = net.inputs(some)[codes][None], np.ones((1, len(codes)), bool)
        hs = {d: toxicity._gru_forward(x[:, t] @ net.p[f"w{d}"] + net.p[f"c{d}"], net.p[f"u{d}"], on[:, t])[0][:, t] for d, t in (("f", slice(None)), ("b", slice(None, None, -1)))}
        both = np.concatenate([hs["f"], hs["b"]], axis=2)
        a = np.exp(both @ net.p["pool"])
        return float((((a / a.sum(1, keepdims=True))[:, :, None] * both).sum(1) @ net.p["out"] + net.p["bias"])[0])

    return net, logit


def test_every_window_start_is_scored_as_in_training():
    net, logit = _net_and_logit()
    texts = [words(40, 60), "one two", "", words(41, 24), "x", words(42, 1400), words(43, 25)]
    codes, some, sizes = toxicity.tokens(texts)
    text, start, size = toxicity.windows(sizes)
    assert [(text == i).sum() for i in range(7)] == [37, 1, 0, 1, 1, 1377, 2]
    flat = " ".join(texts).split()
    got = net.logits(some, codes, start, size)
    assert max(abs(got[i] - logit(" ".join(flat[start[i]:start[i] + size[i]]))) for i in range(0, len(got), 7)) < 1e-5


def test_a_passage_counts_wherever_it_stands():
    net, logit = _net_and_logit()
    passage, filler = words(50, toxicity.WINDOW), ["a"] * 120
    if logit(passage) < logit("a " * toxicity.WINDOW):
        net.p["out"] *= -1
    texts = [" ".join(filler[:i]) + f" {passage} " + " ".join(filler[i:]) for i in range(40)]
    model = toxicity.Model(net, 1.0, 0.0)
    least = toxicity._sigmoid(logit(passage))
    assert (model.score(texts) >= least - 1e-6).all()


def test_scoring_stays_in_single_precision(monkeypatch):
    seen, heads = set(), toxicity._gru_heads
    monkeypatch.setattr(toxicity, "_gru_heads", lambda xs, mix, on=None: seen.update({mix.dtype, *(x.dtype for x in xs)}) or heads(xs, mix, on))
    model = toxicity.Model(toxicity.Net.fresh(), 1.0, 0.0)
    texts = [words(60, 300), "a b", "", "  ", f"\u2003{words(61, 30)} \x1c x\u00a0y ", words(60, 300)]
    got = model.score(pa.array(texts))
    assert seen == {np.dtype(np.float32)}
    assert np.allclose(got, model.score(texts), rtol=0, atol=1e-7) and got[2] == got[3] < 1e-9 and got[0] == got[5]


def test_words_are_split_alike_in_arrow():
    texts = ["", " a  B. b!\u2003a\x85", "\x1f", "one " * 30, "c\u00a0d\u3000"]
    (a, x, m), (b, y, n) = toxicity.tokens(texts), toxicity.tokens(pa.array(["cut", *texts]).slice(1))
    assert a.tolist() == b.tolist() and m.tolist() == n.tolist() and x.word.tolist() == y.word.tolist() and x.gram.tolist() == y.gram.tolist()


def test_gathered_batches_keep_rows_and_bounds():
    batches = [pa.RecordBatch.from_arrays([pa.array(["x" * 100] * n, pa.string())], ["t"]) for n in (1, 2, 50, 3, 0, 4)]
    got = list(gathered(iter(batches), 1000))
    assert [b.num_rows for b in got] == [3, 50, 7] and list(gathered(iter([]), 10)) == []


@pytest.mark.parametrize("rows", [1, 2, 6, 11, 20])
def test_few_vectors_are_all_found(spark, rows):
    x = np.random.default_rng(rows).normal(size=(rows, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, df.filter("vec_id % 5 = 0")).collect()
    for q in range(0, rows, 5):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(rows), d)) if i != q][:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, len(want) + 1))
        if rows <= 11:
            assert [m[1] for m in mine] == want and np.allclose([m[2] for m in mine], d[want])


def test_vectors_of_any_norm(spark):
    rows = [(0, [1e200, 0.0]), (1, [1.2e200, 0.0]), (2, [0.0, 1e-200]), (3, [0.0, 3e-200]), (4, [5e-324, 0.0]), (5, [1.7e308, -1.7e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.search(df, df).collect()}
    assert len(got) == 30 and got[0, 1] == (1, pytest.approx(2e199)) and got[2, 1] == (4, pytest.approx(1e-200)) and got[3, 1] == (2, pytest.approx(2e-200))
    assert got[5, 5][1] > 1e308


def test_a_bucket_of_many_classes_has_a_fingerprint(spark):
    """60,000 classes with the same values: one bucket, whichever band, and no sum to overflow."""
    cls = spark.range(60_000).select(F.col("id").alias("cls"), F.lit(9).alias("n"), F.unhex(F.lit("ab" * 4 * jaccard.BANDS * jaccard.ROWS)).alias("sig"))
    assert jaccard.meetings(cls, block=1 << 20).count() == 60_000
    assert spark.range(1_000_000).agg(F.bit_xor(F.xxhash64("id"))).first()[0] is not None


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 12)) * rng.choice([0.1, 1, 30], size=(600, 1))
    x[50:80] = x[50]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1100, [0.0] * 12), (1200, [float("nan")] * 12), (None, [1.0] * 12), (50, [float(v) for v in x[50]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, df.filter("vec_id % 50 = 0")).toPandas()
    assert set(got.query_id) == set(range(0, 600, 50))
    hit = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort([np.arange(600), d])[:10]
        hit += len(set(best) & set(g.vec_id))
        assert np.allclose(g.sort_values("rank").score, np.sort(d[g.vec_id]))
    assert hit >= 0.9 * 10 * 12
    assert got[got.query_id == 50].sort_values("rank").vec_id.tolist() == list(range(51, 61))


def brute_spans(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s:s + 100]
            if w in seen:
                gone[s:s + 100] = b"\x01" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("occurrences", [100_000, 2])
def test_repeats_against_brute_force(spark, occurrences):
    common = words(70, 30)
    texts = {i: words(100 + i, 20) + " " + common + " " + words(200 + i % 5, 25) for i in range(25)}
    texts |= {30: texts[3], 31: "ab " * 90, 32: None, 33: "", 34: "\u00e9" * 130, 35: "\u00e9" * 130 + "x"}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, lo int")
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.dedup(df, with_text=False, occurrences=occurrences).collect()}
    assert got == brute_spans(texts)
    assert repeats.dedup(df.limit(0)).count() == 0
    twice = df.filter("doc_id = 1").union(df.filter("doc_id = 1"))
    assert [r["n_removed"] for r in repeats.dedup(twice).collect()] == [0, 0]


def test_suffix_classes():
    rng = np.random.default_rng(3)
    buf = np.r_[(piece := rng.integers(97, 99, 300).astype(np.uint8)), piece[40:], np.full(400, 65, np.uint8)]
    at = np.arange(len(buf) - 99)
    got = repeats.classes(buf, at)
    true = [buf[i:i + 100].tobytes() for i in at]
    assert len(set(zip(got.tolist(), true))) == len(set(got.tolist())) == len(set(true))


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "back\\slash <|end|> <<SYS>>", "", None, "a\n<|turn|>b\\"]
    rows = [(1, i, "assistant" if i % 2 else "user", t, 0) for i, t in enumerate(odd)] + [(2, None, None, "x", 0), (None, 1, "user", "y", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, message int")
    done = chat.format_chats(df)
    read = chat.read_back(done).withColumnRenamed("conv_id", "id")
    got = {r["conv_id"]: r for r in done.join(read, done["conv_id"].eqNullSafe(read["id"])).collect()}
    assert all(r["chars"] == len(r["formatted"]) for r in got.values())
    assert [(t["role"], t["text"]) for t in got[1]["t"]] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(odd)]
    for r in got.values():
        for t, m in zip(r["t"], r["loss"]):
            assert (m is None) == (t["role"] != "assistant")
            if m:
                assert r["formatted"][m["start"]:m["end"]].replace("\\\\", "\\") is not None and t["learned"] == t["text"]
    assert "</s>" not in got[1]["formatted"] and "[INST]" not in got[1]["formatted"]


def test_learned_text_is_read_at_the_masks_place(spark):
    df = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", f"text number {i} \U0001f600", 0) for i in range(6)], "conv_id long, turn long, role string, text string, message int")
    done = chat.format_chats(df)

    def learned(shift_start, shift_end):
        moved = F.transform("loss", lambda m: F.when(m.isNotNull(), F.struct((m["start"] + shift_start).alias("start"), (m["end"] + shift_end).alias("end"))))
        return [t["learned"] for t in chat.read_back(done.withColumn("loss", moved)).first()["t"]]

    assert learned(0, 0) == [f"text number {i} \U0001f600" if i % 2 else None for i in range(6)]
    assert learned(2, -1) == [f"xt number {i} " if i % 2 else None for i in range(6)]
    for shift in ((1000, 1000), (-1000, 0), (0, 1000)):
        with pytest.raises(Exception, match="outside its turn"):
            learned(*shift)
    assert chat.read_back(done.limit(0)).count() == 0


def test_chat_events(spark):
    log = [(1, 1, 1, "message", "user", "hel"), (1, 2, 1, "delta", None, "lo"), (1, 3, 2, "message", "assistant", ""), (1, 4, 2, "delta", None, "bad"),
           (1, 5, 2, "regenerate", None, None), (1, 6, 2, "delta", None, "go"), (1, 7, 2, "delta", None, "od"), (1, 8, 1, "edit", None, "HELLO"),
           (1, 9, 3, "message", "user", "gone"), (1, 10, 3, "delete", None, None), (1, 11, None, "delta", None, "stray")]
    df = spark.createDataFrame(log, "conv_id long, seq long, message long, event string, role string, text string")
    assert [(r["role"], r["text"]) for r in chat.fold(df).orderBy("first_seq").collect()] == [("user", "HELLO"), ("assistant", "good")]


def test_packing_looks_up_distinct_words_once():
    """Each distinct word of a slice is looked up once, in whatever form it stands."""
    class Counted(dict):
        seen = 0

        def get(self, key, other=None):
            Counted.seen += 1
            return dict.get(self, key, other)

        def __contains__(self, key):
            raise AssertionError("a second look-up")

    cache = packing.WordCache(TOKENIZER)
    texts = ["known words Known, words! stra\u00dfe \u00c9t\u00e9 x1", "words known", "", "Known, \u4e2d words"]
    want = [cache.tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    for _ in range(2):
        ids, offsets = cache.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == want
    cache.at = Counted(cache.at)
    cache.encode(texts)
    assert Counted.seen == 9  # the empty text is a word


def test_repeats_settles_a_text_s_copies_as_one_range(spark):
    """Stretches that equal earlier ones of their batch and meet travel as one row, not one for each anchor."""
    rng = np.random.default_rng(5)
    passage = "".join(chr(97 + c) for c in rng.integers(0, 26, 2000))
    _, place, _, _ = repeats.anchors(np.frombuffer(passage.encode(), np.uint8), np.zeros(2000, np.int64))
    spots = [(int(p), 1) for p in place]
    assert len(spots) > 20
    rows = spark.createDataFrame([(1, 0, passage, spots), (2, 0, passage, spots)], "k long, dh int, text string, spots array<struct<place:int,salts:long>>")
    got = repeats.contexts(rows.coalesce(1), 16).filter("ctx is null").collect()
    assert [(r["k"], r["lo"], r["n"]) for r in got] == [(2, 0, 2000)]


def test_known_words_are_bounded_and_frequent_ones_stay():
    cache, plain, added = packing.WordCache(TOKENIZER, 300), packing.WordCache(TOKENIZER), []
    add = cache.add
    cache.add = lambda ws: added.extend(ws) or add(ws)
    often = [f"often{i}" for i in range(50)] + ["Hi!", "\u00e9t\u00e9"]
    for k in range(30):
        texts = [" ".join([*often, *(f"rare{k}x{i}" for i in range(100))]), "", words(k, 20)]
        (a, x), (b, y) = cache.encode(texts), plain.encode(texts)
        assert a.tolist() == b.tolist() and x.tolist() == y.tolist()
        assert len(cache.at) <= 300 + 400 and len(cache.ids) <= 1 << 16
    assert all(added.count(w) == 1 for w in often)


def test_marks_stand_alone_and_after_a_word_in_one_slice():
    cache = packing.WordCache(TOKENIZER)
    texts = ["!! abc!! def ghi. jkl .", "mno? ? Été... ... ß,", "NEW new. pqr STU!!"]
    for _ in range(2):
        ids, offsets = cache.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [cache.tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_letters_of_forgotten_words_are_not_encoded_again():
    """Forms of a word share its letters, and these outlast the words made of them."""
    cache, seen = packing.WordCache(TOKENIZER, 60), []

    class Counted:
        def encode_batch_fast(self, texts, **how):
            seen.extend(w for t in texts for w in t.split())
            return real.encode_batch_fast(texts, **how)

    real, cache.tokenizer = cache.tokenizer, Counted()
    letters = ["".join(chr(97 + (i // 26 ** k) % 26) for k in range(3)) + "x" for i in range(100)]
    for form in ("{}", "{}.", "{}!", "({}"):
        texts = [" ".join(form.format(w.upper() if i % 2 else w) for i, w in enumerate(letters)), ""]
        ids, offsets = cache.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [real.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert all(seen.count(w) == 1 for w in letters)
    assert len(cache.at) <= 60 + 202 and len(cache.letters) == 100


def test_words_that_differ_in_case_and_marks_are_projected_once(monkeypatch):
    rows, inputs = [], toxicity.Net.inputs
    monkeypatch.setattr(toxicity.Net, "inputs", lambda net, some: rows.append(len(some.word)) or inputs(net, some))
    model = toxicity.Model(toxicity.Net.fresh(), 1.0, 0.0)
    got = model.score(pa.array(["Aa b AA, b! aa" * 9, "aA! B. !? ?", "", "!?"]))
    assert rows == [5]  # a word of marks alone stays as it is
    assert np.allclose(got, model.score(["aa b aa b aa" * 9, "aa b !? ?", "", "!?"]), rtol=0, atol=1e-7)


def test_words_are_cleaned_alike_in_arrow():
    rng = np.random.default_rng(6)
    letters = list("abXYZ_01!?.,-'\"éÉßİı中٣²ª·\x00\x7f́\U0001f642")
    some = sorted({"".join(rng.choice(letters[:15] if k % 2 else letters, 1 + k % 6)) for k in range(3000)})
    assert toxicity._cleaned(pa.array(some)).to_pylist() == [toxicity._clean(w) for w in some]
    assert len(toxicity._cleaned(pa.array([], pa.string()))) == 0


def test_states_begin_cache_lines():
    for n in (1, 7, 1024):
        rooms = toxicity._on_lines(n, 8, 24, 26)
        assert all(r.ctypes.data % 64 == 0 and r.flags.c_contiguous for r in rooms)
        assert [r.shape for r in rooms] == [(8, 2, n), (24, 2, n), (26, 2, n)]
        for i, r in enumerate(rooms):
            r[:] = i
        assert all((r == i).all() for i, r in enumerate(rooms))
