"""Operators over single rows, each against a plain version of its contract; odd inputs of all kinds."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.llm import decontaminate, html_extract, language_id, license_scan, order_minhash, secret_scan, token_store
from nearfield.llm import sentencepiece_sampling as sampling
from nearfield.llm.common import shared_dir, words_of
from nearfield.llm.queries import tokenizer_path

LONG = "lorem ipsum dolor " * 4000
ODD = [
    (1, None, None), (2, "", "en"), (3, "word", "en"), (4, " \n\t ", None), (5, LONG, "en"), (6, "same text here", "en"),
    (7, "same text here", "en"), (7, "same text here", "en"), (None, "no id", "en"), (8, "日本語 テキスト", "ja"), (9, "\x00\x1c<|endoftext|> ▁ 𐍈", None),
]
SCHEMA = "doc_id long, text string, lang string, source string, score double, label string, h string, row string, words array<string>"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, and columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, lang, "s", 1.0, "x", "y", "z", ["w"]) for i, t, lang in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


@given(st.text())
@settings(max_examples=200)
def test_words_of(text):
    text = text.encode("utf-8", "replace").decode()
    assert [w.decode() for w in words_of(text)] == plain_words(text)


# 1: licences


def test_licence_scan(spark, odd, empty):
    texts = {
        1: "Released under the MIT License.\nand more: mit, license; GNU general-public  license",
        2: "the ſame apache\n\nLicense and cc by",
        3: "gnu general public licenses, xmit license",
        4: "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles",
        5: "this work is licensed under the gnu general public licence version 3",
    }
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(rows).collect()}
    assert (got[1]["n_base"], got[1]["base_labels"], got[1]["first_word"], got[1]["last_word"]) == (3, ["gpl", "mit"], 3, 9)
    assert "MIT" in got[1]["labels"] and got[1]["score"] == 1.0
    assert (got[2]["n_base"], got[2]["base_labels"]) == (2, ["apache", "cc-by"])
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["labels"]) == (0, None, [])
    assert got[4]["labels"] == ["MIT"] and got[4]["n_base"] == 0 and 0.8 <= got[4]["score"] <= 1
    assert got[5]["labels"] == ["GPL"]
    for d, t in texts.items():
        assert got[d]["n_words"] == len(plain_words(t))
    out = license_scan.scan_licenses(odd).collect()
    assert sorted(r["n_words"] for r in out) == sorted(len(plain_words(t)) for _, t, _ in ODD)
    assert license_scan.scan_licenses(empty).count() == 0


def test_licence_wrapped(spark):
    """Notices over many lines, with marker lines and blank lines between, have their labels and scores."""
    rows, want = [], {}
    for label, text in license_scan.TEMPLATES:
        words = text.split()
        for each in (1, 2, 4):
            for mark, gap in (("", ""), ("# ", "#"), (" * ", " *"), ("// ", "  \t")):
                lines = [mark + " ".join(words[i : i + each]) for i in range(0, len(words), each)]
                want[len(rows)] = label
                rows.append((len(rows), "Some words before it.\n" * 5 + f"\n{gap}\n".join(lines) + "\nand some words after it" * 5))
    rows.append((len(rows), "\n".join("permission is granted to any person who has a copy of this book to read it".split()) * 9))
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[i]["labels"] and got[i]["score"] == 1.0 for i, label in want.items())
    assert got[len(rows) - 1]["labels"] == []


@pytest.mark.parametrize("containment", [0.8, 0.5])
def test_licence_pairs(spark, containment):
    """Every block at the threshold is found, and no other, whatever the frequencies of words."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(12)]
    templates = [(f"t{n}", " ".join(rng.choice(words, n))) for n in (1, 2, 4, 5, 7, 9)]
    texts = {i: " ".join(rng.choice([*words, "x", "y-z"], rng.integers(0, 40), p=np.r_[np.arange(1, 13) / 104, 0.125, 0.125])) for i in range(60)}
    sets = license_scan.template_words(templates, containment)
    want = {}
    for d, text in texts.items():
        w = plain_words(text)
        for number, (_, distinct, need, reach) in enumerate(sets):
            most = max((len(set(w[i : i + reach]) & set(distinct)) for i in range(len(w))), default=0)
            if most >= need:
                want[d, number] = most / len(distinct)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("text_hash", F.xxhash64("text"))
    got = {}
    for r in license_scan.match_templates(docs, templates, containment).collect():
        assert plain_words(texts[r["doc_id"]])[r["word"]] in sets[r["template"]][1]
        got[r["doc_id"], r["template"]] = max(r["containment"], got.get((r["doc_id"], r["template"]), 0))
    assert got == want and len(want) > 50


# 4: secrets


def plain_secrets(text):
    text, spans = text or "", []
    for rank, (kind, rx, group, least) in enumerate(secret_scan.BASE_KINDS):
        spans += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(rx, text) if len(m[group]) >= least]
    return ",".join(s for *_, s in sorted(spans))


def test_secret_scan(spark, odd, empty):
    key = "AKIA" + "Z9" * 8
    texts = [
        (1, "a", f"𐍈 password: secret: abcdefghijklmnop and {key} PassWord='0123456789abcdef01'"),
        (2, "b", f"token = x api_key=ghp_{'a1B2' * 9} {'deadbeef' * 4} {'f' * 40}"),
        (3, "c", f"{key} AKIA{key} deadbee{'f' * 5}"),
        (4, "d", f"{key}{'0' * 15} ghp_{'Zz9y' * 9}"),
        (5, "e", f"ghp_{'Zz9y' * 9}"), (6, "f", f"ghp_{'Zz9y' * 9}"), (7, "g", f"xoxb-{'wxyz' * 4}"),
    ]
    rows = spark.createDataFrame(texts, "doc_id long, source string, text string")
    out = secret_scan.scan_secrets(rows).select("doc_id", secret_scan.joined(F.col("base")).alias("b"), secret_scan.joined(F.col("spans")).alias("s"), "n_copied")
    got = {r["doc_id"]: r for r in out.collect()}
    for d, _, t in texts:
        assert got[d]["b"] == plain_secrets(t)
        assert set(got[d]["b"].split(",")) <= set(got[d]["s"].split(",")) or not got[d]["b"]
    assert got[7]["s"] == "slack:0:21"  # one owner: added
    assert got[5]["s"] == "" and got[5]["n_copied"] == 1  # three owners: a copied example
    out = secret_scan.scan_secrets(odd.withColumn("source", F.lit(None).cast("string")))
    assert out.count() == len(ODD) and secret_scan.scan_secrets(empty).count() == 0


def test_secret_ownership(spark):
    """A value is a copied example from three owners on, or from ten repositories of fewer owners; else it is added."""
    value = lambda n: hashlib.sha256(str(n).encode()).hexdigest().upper()[:40]
    rows = [(i, f"o{i % 3}", f"see {value(1)}") for i in range(3)]  # three owners
    rows += [(10 + i, f"o{i % 2}", f"see {value(2)}") for i in range(9)]  # nine repositories of two owners
    rows += [(30 + i, "o1", f"see {value(3)}") for i in range(10)]  # ten repositories of one owner
    rows += [(50, "o1", f"see {value(4)}"), (50, "o1", f"see {value(4)}"), (51, "o2", f"see {value(4)} {'AB' * 20} {value(5).lower()}")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(docs).select("doc_id", secret_scan.joined(F.col("spans")).alias("s"), "n_copied").collect()}
    assert {d for d, r in got.items() if r["s"]} == {*range(10, 19), 50, 51} and got[50]["s"] == "random:4:44"
    assert got[51]["s"] == "random:4:44,hex:86:126"
    assert {d for d, r in got.items() if r["n_copied"]} == {0, 1, 2, *range(30, 40)}


def test_secret_keys(spark):
    """Private keys are told apart by their bodies, not by the header that all of a type share."""
    head, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    body = lambda i: ["MII" + hashlib.sha256(f"{i} {j}".encode()).hexdigest()[:61].translate(str.maketrans("0123456789", "ghijklmnop")).upper() for j in range(400)]
    key = lambda i, sep="\n": sep.join([head, *body(i), end])
    locked = lambda i: "\n".join([head, "Proc-Type: 4,ENCRYPTED", f"DEK-Info: AES-128-CBC,{i}", "", *body(f"e{i}"), end])
    texts = [(i, f"s{i}", f"𐍈 my key:\n{key(i)}\nand\n{locked(i)}") for i in range(5)]
    # One key of three owners, its lines broken, escaped and indented, and one that is cut off.
    texts += [(10, "a", key("x")), (11, "b", f'"{key("x", chr(92) + "n")}"'), (12, "c", key("x", "\r\n    ")), (13, "d", f"{head}\n{body('y')[0]}")]
    rows = spark.createDataFrame(texts, "doc_id long, source string, text string")
    out = secret_scan.scan_secrets(rows).select("doc_id", secret_scan.joined(F.col("spans")).alias("s"), "n_live", "n_copied")
    got = {r["doc_id"]: r for r in out.collect()}
    for i, _, t in texts[:5]:
        assert [x for x in got[i]["s"].split(",") if "pem" in x] == [f"pem:{m.start()}:{m.end()}" for m in re.finditer(head, t)]
        assert got[i]["n_copied"] == 0 and got[i]["n_live"] >= 2
    assert all("pem" not in got[i]["s"] and got[i]["n_copied"] == 1 for i in (10, 11, 12))
    assert got[13]["s"] == "pem:0:31" and got[13]["n_copied"] == 0


# 8: decontamination


def plain_hits(text, items, window=10):
    words, hit, found = plain_words(text), set(), set()
    for item, body in items:
        w = plain_words(body)
        n = min(window, len(w))
        wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in wins:
                hit.update(range(i, i + n))
                found.add(item)
    return len(hit), sorted(found)


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=8), max_size=4), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(2, 4))
@settings(max_examples=300, deadline=None)
def test_suffix_automaton(items, words, window):
    pairs = [(i, " ".join(w)) for i, w in enumerate(items)]
    automaton = decontaminate.SuffixAutomaton.of([(i, words_of(t)) for i, t in pairs], window)
    starts, ends, found = automaton.hits(words_of(" ".join(words)))
    assert (sum(ends) - sum(starts), sorted(found)) == plain_hits(" ".join(words), pairs, window)


def test_decontamination(spark, odd, empty):
    item = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(1, item), (2, "Short item"), (3, None), (4, ""), (5, item)], "item_id long, text string")
    texts = [(1, f"Before. {item.upper()}! After it all there is more of a text that nobody has seen before."), (2, "a short, ITEM here"), (3, "clean words"), (4, item), (None, None)]
    docs = spark.createDataFrame([(d, t, len(t or "")) for d, t in texts], "doc_id long, text string, n_chars long")
    for most in (decontaminate.MAX_WORDS, 12):  # one pass and several
        got = {r["doc_id"]: r for r in decontaminate.find_contamination(docs, items, max_words=most).collect()}
        for d, t in texts:
            assert (got[d]["n_hit"], got[d]["items"]) == plain_hits(t, [(1, item), (2, "Short item"), (5, item)])
        kept = {r["doc_id"]: r for r in decontaminate.remove_contamination(docs, items, max_words=most).collect()}
        assert set(kept) == {1, 2, 3, None}  # all of document 4 is a test item
        assert kept[1]["text"] == "Before. ! After it all there is more of a text that nobody has seen before." and kept[1]["n_chars"] == len(kept[1]["text"])
        assert kept[3]["text"] == "clean words" and kept[None]["text"] is None
    none = items.limit(0)
    assert {r["n_hit"] for r in decontaminate.find_contamination(odd, none).collect()} == {0}
    assert decontaminate.remove_contamination(odd, items).columns == odd.columns
    assert decontaminate.find_contamination(empty, items).count() == 0


# 10: token files


@given(st.lists(st.text(alphabet=st.sampled_from(list("aéİΣσ \t\n.,'sS<|>日́\x1c\x85\xa0ªǅ½?!'")), max_size=30), max_size=5))
@settings(max_examples=300, deadline=None)
def test_word_encoder(texts):
    coder = token_store.encoder(tokenizer_path("word_bpe_49k.json"))
    assert coder.encode(texts) == [coder.whole(t) for t in texts]


def test_word_encoder_marks():
    """Words between runs of marks are encoded together, and the runs once; a cache that is emptied loses nothing."""
    coder, singly = token_store.WordEncoder(tokenizer_path("word_bpe_49k.json")), []
    each = coder._learn_each
    coder._learn_each = lambda parts: (singly.extend(parts), each(parts))
    words = [f"{a}{b}{c}" for a in "abcdefgé" for b in ("or", "Is", "um") for c in "stlnm"]
    texts = [" ".join(f"{a}{w}{b}" for w in words for a, b in [("", "###"), ("(", ")!!"), ('"', "...")]), "it's o'er (262) a-b x@y.z '' don't!"]
    assert coder.encode(texts) == [coder.whole(t) for t in texts]
    assert len(singly) <= 12
    small = token_store.WordEncoder(tokenizer_path("word_bpe_49k.json"), cache_words=30)
    for batch in (texts[1:], [texts[1] + " new words", *texts, None], texts[1:]):
        assert small.encode(batch) == [small.whole(t or "") for t in batch]


def test_token_files(spark, odd, empty):
    path = token_store.write_tokens(odd, shared_dir(spark), tokenizer_path("word_bpe_49k.json"))
    got = sorted(token_store.token_index(spark, path).collect(), key=lambda r: r["start"])
    coder, at = token_store.encoder(tokenizer_path("word_bpe_49k.json")), 0
    for r, (d, t, _) in zip(got, sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        raw = coder.whole(t or "") + np.array([1], "<u4").tobytes()
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, at, len(raw) // 4, zlib.crc32(raw))
        at += len(raw) // 4
    assert token_store.lookup(spark, path, [7]).count() == 2
    assert token_store.token_index(spark, token_store.write_tokens(empty, shared_dir(spark), tokenizer_path("word_bpe_49k.json"))).count() == 0


# 2: HTML


def test_html(spark):
    w = html_extract.count(html_extract.fixed_pages())
    page = (
        '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a href=x>Home</a></nav><!-- c --><div class="ad">Buy this now</div>'
        "<article><h1>Head &amp; line</h1><p><b>First  para\n with words&nbsp;here and more.<br>again<p>Second para &lt;b&gt; of text goes on here.</p>"
        '<aside>Read this too</aside><p>Third one ends the story of it.</p></article><section id="comments"><p>Me too, I say</p></section><footer>&copy; x</footer>'
    )
    want = "Head & line\nFirst para with words here and more. again\nSecond para <b> of text goes on here.\nThird one ends the story of it."
    assert html_extract.main_text(page, w) == want
    assert html_extract.main_text(page.replace("article>", "div>"), w) == want
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<script>never closed"), (5, "u", "<p" * 2000), (6, "u", page), (6, "u", page)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = html_extract.extract(pages).orderBy("page_id").collect()
    assert [r["text"] for r in got] == [want, "", "", "", html_extract.main_text("<p" * 2000, w), want, want]
    assert html_extract.extract(pages.limit(0)).count() == 0


@given(st.text(alphabet=st.sampled_from(list("<>/ap =\"'!-&;x\n"))))
@settings(max_examples=300, deadline=None)
def test_html_never_fails(page):
    html_extract.main_text(page, html_extract.count([]))


HTML_PAGES = {
    "named paragraph": ('<article><p>One two three four.</p><p class="ad">Buy now and save</p><p>Five six seven eight.</p></article>', "One two three four.\nFive six seven eight."),
    "part of a name": ('<article><p>One two three four.</p><section class="related-work"><p>Others did this too.</p></section><p>Five six.</p></article>', "One two three four.\nOthers did this too.\nFive six."),
    "long advert": ('<div><p>One two three four.</p><div class="promo">' + "buy it " * 5000 + "</div><p>Five six.</p></div>", "One two three four.\nFive six."),
    "link in a text": ("<article><h2>Head</h2><p>See <a>a rather long title of a piece</a> now</p><p>Five six.</p></article>", "Head\nSee a rather long title of a piece now\nFive six."),
    "beside the text": ("<div><div><div>My site</div></div></div><div><div><div><p>The first paragraph of this page is long enough.</p><p>And the second.</p></div></div></div><div><div><div>Powered by</div></div></div>", "The first paragraph of this page is long enough.\nAnd the second."),
    "all kinds": ("<main><article><header><h1>Title</h1></header><p>Some text.</p><ul><li>one point</li></ul><aside>Not this</aside><table><tr><td>cell</td></tr></table><pre>code</pre><p>Bye.</p></article></main><section id=comments><article><p>Great!</p></article></section>", "Title\nSome text.\none point\ncell\ncode\nBye."),
    "no main text": ("<nav><a>Home</a></nav><footer>All rights reserved</footer>", ""),
}


def test_html_pages():
    """Hand-labelled pages come out right, and one of them only by the scan."""
    w = html_extract.count(html_extract.fixed_pages())
    for name, (page, want) in HTML_PAGES.items():
        assert html_extract.main_text(f"<body>{page}</body>", w) == want, name
    for page, labelled in zip(html_extract.LABELLED, html_extract.fixed_pages(), strict=True):
        assert html_extract.main_text(re.sub("[{}]", "", page), w) == "\n".join(b.text for b, main in labelled if main)
    page, want = HTML_PAGES["beside the text"]
    unscanned = "\n".join(b.text for b in html_extract.parse(page) if w.word(b) > 0)
    assert unscanned != want and "My site" in unscanned


@given(st.lists(st.tuples(st.floats(-2, 0), st.floats(0, 3)), max_size=12))
def test_html_region(scored):
    """The scan finds the greatest sum of all contiguous regions."""
    total = lambda a, b: sum(t + x for t, x in scored[a:b]) - scored[a][0]
    best = max([0.0, *(total(a, b) for a in range(len(scored)) for b in range(a + 1, len(scored) + 1))])
    low, high = html_extract.best_region(scored)
    assert (total(low, high) if high > low else 0.0) == pytest.approx(best)


def test_html_articles(spark, sf_dir):
    """On the test pages the article element is the main text."""
    for r in html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        import html

        parts = [" ".join(html.unescape(re.sub("<br>", " ", x).replace("<b>", "")).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(p for p in parts if p)


# 3: language identification


def test_language(spark, odd, empty, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.train(docs)
    out = language_id.classify(docs.withColumn("held", language_id.held_out(F.col("doc_id"))), model).collect()
    held = [r for r in out if r["held"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    got = language_id.classify(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 4)} == {"und"}
    assert len({r["score"] for r in got if r["doc_id"] in (6, 7)}) == 1
    assert language_id.classify(empty, model).count() == 0
    assert {r["lang_pred"] for r in language_id.classify(odd, language_id.train(empty)).collect()} == {"und"}


def test_language_rejection(spark):
    """Whole texts in scripts and languages that were not learned are rejected; the rows kept from training stay."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")  # as many rows as are trained on at most
    model = language_id.train(docs)
    foreign = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
        "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
        "bcdfghj klmnpqr stvwxzb cdfghkl mnpqrst vwxzbcd fghjklm npqrstv " * 5,
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(foreign)], "doc_id long, text string")
    assert all(r["rejected"] for r in language_id.classify(rows, model).collect())
    held = docs.where(language_id.held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    assert not any(r["rejected"] for r in language_id.classify(held, model).collect())


def test_language_letters(sf_dir, spark):
    """Only characters of Unicode's letter categories are letters."""
    model = language_id.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert model.predict(["½", "① ²", "Ⅷ", "12 !?", "\u0301"]) == (["und"] * 5, [0.0] * 5, [True] * 5)
    assert "und" not in model.predict(["ʰ", "ª", "中", "ǅ", "x½"])[0]


def test_language_calibration(spark):
    """The temperature lies inside the grid, scores say how often predictions are right, and doubt alone rejects."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs)
    assert language_id.TEMPERATURES[5] < model.temperature < language_id.TEMPERATURES[-5]
    assert np.isfinite(model.table).all() and np.abs(model.table).max() < 1e4
    rows = docs.where(language_id.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).collect()
    parts = language_id._excerpts([(r["text"], r["lang"]) for r in rows], np.random.default_rng(1)) * 1
    langs, scores, _ = model.predict([t for t, _ in parts])
    right = np.array([a == b for a, (_, b) in zip(langs, parts, strict=True)])
    assert abs(np.mean(scores) - right.mean()) < 0.05
    model.least_seen = (0.0,) * len(language_id.LENGTHS)
    _, scores, rejected = model.predict(["Dzień dobry, to jest zwykły tekst po polsku o pogodzie i przyrodzie " * 8])
    assert rejected == [True] and scores[0] < 0.5


def test_language_blocks(monkeypatch):
    """Scores are the same however texts are cut into blocks, and beside whatever other texts."""
    model = language_id.fit([("the one of them and the other", "en"), ("der eine von ihnen und der andere", "de")] * 3)
    texts = ["the", "der eine " * 50, "x1y2 " * 40, "é", "a" * 63, "one of them", "Ω" * 200]
    whole = model.logits(texts)
    for k, t in enumerate(texts):
        assert all(np.array_equal(a[0], b[k]) for a, b in zip(model.logits([t]), whole, strict=True))
    for block in (5, 64, 65):
        monkeypatch.setattr(language_id, "BLOCK", block)
        assert all(np.allclose(a, b) for a, b in zip(model.logits(texts), whole, strict=True))


def test_language_repeated_id(spark):
    """An id in very many rows takes no training rows from other languages."""
    rows = [(0, f"the one of them {i}", "en") for i in range(3000)] + [(i, f"der eine von ihnen {i}", "de") for i in range(1, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    assert language_id.train(docs, 40).langs == ["de", "en"]


def test_language_few_rows():
    """Fewer rows than any can be kept from: no text is rejected for its n-grams."""
    model = language_id.fit([("the one of them", "en"), ("der eine von ihnen", "de")])
    assert set(model.least_seen) == {0.0}


# 5: order MinHash


def test_order_minhash(spark, odd, empty):
    words = [f"w{i}" for i in range(300)]
    one, swapped = " ".join(words), " ".join(words[150:] + words[:150])
    f = order_minhash.fingerprints([one, one, swapped, "x " * 50, "x " * 60, "", None, "ab"])
    like = lambda i, j: order_minhash.likeness(f[i : i + 1], f[j : j + 1])[0]
    assert like(0, 1) == 1 and like(0, 2) < 0.85 and like(0, 3) < 0.1 and like(5, 6) == 1
    small = " ".join(words[:290] + ["z"] + words[291:])
    assert 0.75 < order_minhash.likeness(f[:1], order_minhash.fingerprints([small]))[0] < 1
    got = order_minhash.fingerprint_documents(odd).collect()
    order = sorted(((d is not None, d or 0, t is not None, t or "") for d, t, _ in ODD), reverse=True)
    following = order[1:] + order[:1]
    want = sorted((x[1] if x[0] else None, hashlib.sha256(order_minhash.edited(x[3], y[3]).encode("utf-8", "replace")).hexdigest()) for x, y in zip(order, following, strict=True) if x[0])
    assert sorted((r["doc_id"], r["edited_sha256"]) for r in got if r["doc_id"] is not None) == want
    assert all(r["near_edited"] == 1.0 for r in got if r["n_chars"] == 0) and len(got) == len(ODD)
    assert order_minhash.fingerprint_documents(empty).count() == 0


# 9: SentencePiece sampling


@pytest.mark.parametrize(("said", "k"), [("an at", 3), ("a it a it", 5)])
def test_sampling_law(said, k):
    """First samples follow the lattice's law; sets that of draws without replacement; inclusion is unbiased."""
    v, n, samples = sampling.vocabulary(tokenizer_path("piece_bpe_32k.model")), 8000, k
    text, ways = sampling.MARK + said.replace(" ", sampling.MARK), {}
    pieces = {}
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for i in range(m.get_piece_size()):
        if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i)):
            pieces[m.id_to_piece(i)] = i

    def cut(at, ids, logp):
        if at == len(text):
            ways[tuple(ids)] = logp
        for k in range(1, len(text) - at + 1):
            if text[at : at + k] in pieces:
                cut(at + k, [*ids, pieces[text[at : at + k]]], logp + v.logp[pieces[text[at : at + k]]])

    cut(0, [], 0.0)
    total = np.logaddexp.reduce(list(ways.values()))
    p = {k: np.exp(x - total) for k, x in ways.items()}
    first, weighed = dict.fromkeys(p, 0.0), dict.fromkeys(p, 0.0)
    for got in sampling.sample([said] * n, list(range(n)), v, samples):
        keys = [tuple(s[0].tolist()) for s in got]
        assert len(set(keys)) == samples and [s[2] for s in got] == sorted((s[2] for s in got), reverse=True)
        first[keys[0]] += 1 / n
        for k, s in zip(keys, got, strict=True):
            assert abs(np.log(p[k]) - s[1]) < 1e-6
            weighed[k] += p[k] / s[3] / n
    assert all(abs(first[k] - p[k]) < 0.025 for k in p)
    assert abs(sum(weighed.values()) - 1) < 0.05
    # More than there are segmentations: all of them.
    assert len(sampling.sample(["x"], [1], v, 9)[0]) == 2


def test_sampling_seed():
    """Samples depend on key and text alone: not on what else is in the batch, nor on the machine."""
    v = sampling.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    texts = ["the cat and the hat and the cat", "the the the", "", "hat", "x" * 300]
    together = sampling.sample(texts, [7, 8, 9, 10, None], v, 3)
    for i, key in enumerate([7, 8, 9, 10, None]):
        for a, b in zip(together[i], sampling.sample([texts[i]], [key], v, 3)[0], strict=True):
            assert (a[0].tolist(), a[1:]) == (b[0].tolist(), b[1:])
    said = "|".join(" ".join(map(str, s[0].tolist())) for s in together[1])
    assert said == "272 261 265 272|261 265 272 272|272 272 261 265"


@given(st.text(max_size=40), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_sampling_decodes(text, k):
    text = text.encode("utf-8", "ignore").decode()
    v = sampling.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    got = sampling.sample([text, "other text", text], [5, 6, 5], v, k)
    assert [s[0].tolist() for s in got[0]] == [s[0].tolist() for s in got[2]]
    for s in got[0]:
        assert sampling.decode(v, s[0].tolist()) == text.replace(sampling.MARK, " ")
    assert [s[0].tolist() for s in sampling.sample([text], [5], v, k)[0]] == [s[0].tolist() for s in got[0]]


def test_sampling_rows(spark, odd, empty):
    got = sampling.sample_documents(odd, tokenizer_path("piece_bpe_32k.model")).collect()
    assert len(got) == len(ODD) and all(r["decoded"] for r in got)
    assert [len(r["ids"]) for r in got if r["doc_id"] in (1, 2)] == [0, 0]
    assert sampling.sample_documents(empty, tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_token_files_prune(spark, tmp_path):
    """A reader skips row groups by the Bloom filter on doc_id, within the range of ids that a file has."""
    docs = spark.range(20_000).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    path = token_store.write_tokens(docs, str(tmp_path / "t"), tokenizer_path("word_bpe_49k.json"))

    def read(ids):
        found = token_store.lookup(spark, path, ids)
        rows = found.collect()
        leaf = found._jdf.queryExecution().executedPlan().collectLeaves().head()
        return [r["doc_id"] for r in rows], leaf.metrics().apply("numOutputRows").value()

    assert read([5000]) == ([5000], 1000)  # one row group of ORC's 1,000 rows
    assert sum(read([i])[1] for i in range(5001, 5041, 2)) <= 2000  # of 20 absent ids nearly none reads any
    stripes = [jvm_reader(spark, f) for f in tmp_path.glob("t/*.orc")]
    assert all(kind == "ZSTD" and stride == 1000 for kind, stride in stripes) and stripes


def jvm_reader(spark, path):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(path)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    return reader.getCompressionKind().toString(), reader.getRowIndexStride()


@given(st.lists(st.sampled_from(["a", "b", "cc", "\u00e9"]), max_size=40).map(" ".join))
@settings(max_examples=60, deadline=None)
def test_order_minhash_plain(text):
    """The fingerprint by plain loops over occurrence-numbered k-mers."""
    from nearfield.llm.hashing import kmers, mix, odd

    hashes = [int(h) for h in kmers([text], order_minhash.K, order_minhash.BLANKS)[0]]
    mask, seen, own = (1 << 64) - 1, {}, []
    one = lambda x: int(mix(np.array([x & mask], np.uint64))[0])
    for h in hashes:
        seen[h] = seen.get(h, -1) + 1
        own.append((h + one(seen[h])) & mask if seen[h] else h)
    want = []
    for c in (int(x) for x in odd(order_minhash.HASHES, 11)):
        keys = []
        for x in own:
            y = x * c & mask
            keys.append(((y ^ (y >> 29)) * c & mask) >> 32)
        least = sorted(range(len(own)), key=lambda i: (keys[i], i))[: order_minhash.TUPLE]
        if not least:
            want.append(0)
            continue
        a, b = min(least), max(least)
        want.append(one((hashes[a] * 3 & mask) + one(hashes[b]) + c) >> 48)
    assert order_minhash.fingerprints([text])[0].tolist() == want
