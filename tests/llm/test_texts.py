"""Words, rules, tokens, languages and pages against brute force, and their edge cases."""

import hashlib
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keytide.llm import bpe, html_text, langid, quality
from keytide.llm.words import gram_hashes, slices, within, word_hashes, words

EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d " * 30), (6, "x" * 5000), (7, "a\n\na\nb \na"), (7, "a\n\na\nb \na"), (None, "null id # $")]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("ab é\xa0\n\t\x1c中Z"), max_size=40)), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    for limit in (1, 1 << 20):
        at = 0
        for t in slices(pa.array(texts, pa.string()), limit):
            w = words(t)
            h = word_hashes(t.data, w)
            for i in range(t.rows):
                want = WORD.findall(texts[at + i] or "")
                got = [t.data[a:b].tobytes().decode() for a, b in zip(w.start[w.at[i] : w.at[i + 1]], w.end[w.at[i] : w.at[i + 1]])]
                assert got == want
            flat = [x for i in range(t.rows) for x in WORD.findall(texts[at + i] or "")]
            assert len(set(h.tolist())) == len(set(flat))
            at += t.rows
        assert at == len(texts)


def test_gram_hashes_tell_runs_apart():
    h = np.random.default_rng(0).integers(0, 4, 300).astype(np.uint64)
    for k in (1, 2, 3, 5, 8, 50):
        g = gram_hashes(h, k)
        runs = [tuple(h[i : i + k]) for i in range(len(h) - k + 1)]
        assert len(g) == len(runs) and len(set(g.tolist())) == len(set(runs))


def brute_rules(text):
    w = WORD.findall(text or "")
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + j for places in grams.values() if len(places) > 1 for i in places for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs):
    name = lambda n: "".join("abcdefghij"[int(c)] for c in str(n))
    good = [(100 + i, " ".join("the" + name((i * 7 + j * j) % 997) for j in range(80))) for i in range(60)]
    bad = [(200 + i, " ".join("the" + name((i * 5 + j * j) % 991) + "###" for j in range(80))) for i in range(12)]
    rows = EDGE + good + bad
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (5, None, 1), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality(docs(rows), labels).collect()
    assert len(out) == len(rows)
    have = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out}
    assert have == {(i, *brute_rules(t)) for i, t in rows}
    for r in out:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    kept = {r["doc_id"] for r in out if r["kept"]}
    assert kept >= {i for i, _ in good} and not kept & {i for i, _ in bad}
    passed = {r["doc_id"] for r in quality.passing(docs(rows), labels).collect()}
    assert passed == kept
    none = quality.quality(docs(rows), labels.limit(0)).where("kept").count()
    assert none == len(good) + len(bad)  # without labels only the base rules count
    assert quality.quality(docs([]), labels).count() == 0


def test_bpe_equals_the_library(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows = EDGE + [(20, "It's 12 o'clock<|endoftext|>  é中文🎉\r\n\x1c aaaaaaaa"), (21, "ß" * 3000), (22, "  　\x85 x")]
    out = bpe.encoded(docs(rows), path).collect()
    assert len(out) == len(rows)
    want = {(i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows}
    assert {(r["doc_id"], tuple(r["ids"])) for r in out} == want
    assert {(r["doc_id"], r["decoded"]) for r in out} == {(i, t or "") for i, t in rows}
    digest = {r["doc_id"]: r for r in bpe.digests(bpe.encoded(docs([(1, "hello world")]), path)).collect()}[1]
    ids = library.encode("hello world", add_special_tokens=False).ids
    assert digest["n_tokens"] == len(ids) and digest["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    small = bpe.Encoder(bpe.Bpe(path), most=3)  # a cache that is always full
    for text in ("a bb ccc dddd", "ccc a bb", ""):
        ids, at = small.encode([text, text])
        assert ids[at[0] : at[1]].tolist() == ids[at[1] : at[2]].tolist() == library.encode(text, add_special_tokens=False).ids
    assert bpe.encoded(docs([]), path).count() == 0


def test_long_words_merge_as_the_library_does():
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    library, worker, rng = tokenizers.Tokenizer.from_file(path), bpe.Encoder(bpe.Bpe(path)), np.random.default_rng(8)
    texts = ["a" * 3001, "ab" * 900 + "aaa" * 333, "x" * 513 + " y " + "the" * 700 + "é中" * 300, "".join(chr(97 + i) for i in rng.integers(0, 26, 200_000))]
    texts += ["".join(rng.choice(["the", "ing", "er", "on", "aa", "a", "é"], 400)) for _ in range(20)]
    began = time.perf_counter()
    ids, at = worker.encode(texts)
    assert time.perf_counter() - began < 10
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


def test_language_id(spark, docs):
    seed = {"en": "the and of to with this that from", "de": "der die und nicht mit sich auch für", "fr": "le la les des une avec pour dans"}
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(seed[x].split(), 30)), x, "s", 0) for i in range(240) for x in [list(seed)[i % 3]]]
    rows += [(900, None, "en", "s", 0), (901, "", "de", "s", 0), (902, "123 ---", "fr", "s", 0), (903, "the with und", None, "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long")
    model = langid.learned(df.where(langid.fold() != 1))
    out = {r["doc_id"]: r for r in langid.predicted(df, model).collect()}
    assert all(out[r[0]]["lang_pred"] == r[2] for r in rows if r[0] < 240)
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in out.values())
    nothing = langid.learned(df.limit(0))
    assert {r["lang_pred"] for r in langid.predicted(df, nothing).collect()} == {"und"}
    one = langid.learned(df.where("lang = 'en'"))
    assert {r["lang_pred"] for r in langid.predicted(df, one).collect()} == {"en", "und"}
    for k in (2, 3, 6, 9):
        code = langid.codewords(k)
        assert len({tuple(r) for r in code}) == k and (np.abs(code.sum(axis=0)) < k).all()


PAGES = [
    ("", ""),
    (None, ""),
    ("plain &amp; text", "plain & text"),
    ("<body><header>Top</header><nav>Menu</nav><main><h1>T</h1><p>one  two</p><section><p>three</section></main><aside>no</aside><footer>f</footer>", "T\none two\nthree"),
    ("<div class='cookie-notice'>We use cookies</div><article><h1>Title</h1><p>A <b>bold<br>text</p><p>x &lt; y</article><div id='comments'><p>" + "me too " * 80 + "</div>", "Title\nA bold text\nx < y"),
    ("<script>var t='</p>';</script><style>p{}</style><p>only this<!-- no --></p><form>Search <input></form>", "only this"),
    ("<ul><li>a<li>b</ul>", "a\nb"),
    ("<article><p>unclosed <b>bold<p>next", "unclosed bold\nnext"),
    ("<p>a<b>&#10;</b>c</p><p>&#32;</p><p>d&nbsp;e</p>", "a c\nd e"),
    ("<<<a < b>>", None),
    ("<p " * 3000, None),
    ("<div>" * 3000 + "deep", "deep"),
]


def test_main_text_of_pages(spark):
    rows = [(i, f"u{i}", h) for i, (h, _) in enumerate(PAGES)]
    got = {r["page_id"]: r for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert want is None or got[i]["text"] == want
        assert got[i]["n_chars"] == len(got[i]["text"])


TEXT = "A paragraph of the article with some words in it, which nobody wants to lose. " * 3
WRAPPED = [f"<{tag} {mark}>{{}}</{tag}>" for tag, mark in [("div", 'class="elementor-widget-container"'), ("div", 'class="content no-sidebar"'), ("section", 'id="discussion"'), ("section", 'id="related-work"'), ("div", 'id="related-work"'), ("section", "id=search"), ("div", 'class="has-comments withoutSharing"')]]
ROLE = ['class="share-buttons"', 'class="post-ad"', 'id="newsletter-signup"', 'class="x related-posts"', 'class="entry-comments"', "class=sidebar"]


@pytest.mark.parametrize("outer", ["article", "main"])
def test_wrappers_inside_an_article_stay(outer):
    p = " ".join(TEXT.split())
    page = lambda inner: f"<body><div class='ad'>Buy</div><{outer}><h1>T</h1>{inner}</{outer}><div id=footer>f</div></body>"
    for wrapper in WRAPPED:
        part = wrapper.format(f"<p>{TEXT}</p>")
        assert html_text.main_text(page(part)) == f"T\n{p}"  # all of the text
        assert html_text.main_text(page(part * 3 + f"<p>{TEXT}</p>")) == "\n".join(["T"] + [p] * 4)  # a quarter of it each
    for mark in ('class="widget"', 'class="content sidebar"', "id=promo"):  # a role, but most of the text
        assert html_text.main_text(page(f"<div {mark}><p>{TEXT}</p></div><aside><p>{TEXT * 3}</p></aside>")) == f"T\n{p}"
    for mark in ROLE:
        assert html_text.main_text(page(f"<p>{TEXT}</p><div {mark}><p>Tell your friends</p></div>")) == f"T\n{p}"
    assert html_text.main_text(page(f"<p>{TEXT}</p><section id=comments><p>{TEXT * 5}</p></section>")) == f"T\n{p}"
    assert html_text.main_text(f"<main><article><h1>T</h1><p>{TEXT}</p></article><div class=related><p>{TEXT * 5}</p></div></main>") == f"T\n{p}"
    assert html_text.main_text(f"<article><h2 id=sharing>T</h2><p>{TEXT}</p></article>") == f"T\n{p}"
