"""Tokenising, packing, extraction, language, licences and URLs: libraries, optima and planted cases."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lucidgraph.llm import bpe, html_text, language_id, license_scan, packing, url_filter

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n\n a  b\t c\r\n", "naïve café ß 漢字 🙂🙂 ́x\x1c\x85  y'll", "a" * 3000, "x\x00y\t\t 12345 -- '' 's", "<|endoftext|> a<|startoftext|>b", "ΣΑΣ Σ İI ﬁ é", "１２ ½ ²"]


@pytest.fixture(scope="module")
def codec():
    return bpe.ByteBpe(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(RANKS))}, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn", "Co"])))
def test_bpe_equals_the_library(codec, reference, text):
    ids = codec.encode(text)
    assert ids == reference.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_bpe_query(spark, codec, reference):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate([None, *ODD])], "doc_id long, text string, ids int")
    for r in bpe.bpe_digests(docs, RANKS, public_tokenizers.PATTERN).collect():
        text = [None, *ODD][r.doc_id] or ""
        ids = reference.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    back = bpe.bpe_decode(bpe.bpe_encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.bytes).decode() for r in back.collect()} == {i: t or "" for i, t in enumerate([None, *ODD])}


def test_words_equal_the_library():
    from tokenizers import Tokenizer

    with open(WORDS, encoding="utf-8") as f:
        words = packing.WordTokenizer(f.read())
    whole = Tokenizer.from_file(WORDS)
    whole.encode_special_tokens = True
    rng = random.Random(2)
    odd = ["".join(chr(rng.randrange(1, 0x2500)) for _ in range(400)) for _ in range(20)] + ["don't I'LL Œuvre Ÿ÷× ÀÉ'S 3.14%%%"]
    for text in [*ODD, *odd]:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def optimum(sizes, room):
    """Least number of bins, by subsets."""
    n = len(sizes)
    best = [(n + 1, 0)] * (1 << n)
    best[0] = (0, room)
    for mask in range(1 << n):
        k, used = best[mask]
        for i in range(n):
            if not mask >> i & 1:
                new = (k, used + sizes[i]) if used + sizes[i] <= room else (k + 1, sizes[i])
                best[mask | 1 << i] = min(best[mask | 1 << i], new)
    return best[-1][0]


def test_packing_is_optimal_on_small_cases():
    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.randrange(10, 60) for _ in range(rng.randrange(1, 11))]
        bins = packing.pack_sizes(sizes, 100)
        assert sorted(itertools.chain(*bins)) == sorted(sizes) and all(sum(b) <= 100 for b in bins)
        assert len(bins) == optimum(sizes, 100)


def test_fillings_of_any_number_of_pieces():
    assert next(packing.fillings(packing._Stock([50, 45, 26, 24], 100), 100)) == (50, 26, 24)
    rng = random.Random(6)
    for _ in range(40):
        sizes, room = [rng.randrange(3, 40) for _ in range(9)], rng.randrange(40, 120)
        sums = {sum(c) for n in range(10) for c in itertools.combinations(sizes, n)}
        got = [sum(f) for f in packing.fillings(packing._Stock(sizes, 120), room) if f is not None]
        assert got[0] == max(x for x in sums if x <= room) and got == sorted(got, reverse=True)


@pytest.mark.parametrize("many, bins, least, most", [(5, 200, 700, 950), (7, 150, 400, 800), (10, 100, 300, 520)])
def test_packing_fills_bins_of_many_pieces(many, bins, least, most):
    rng, sizes = random.Random(1), []
    while len(sizes) < many * bins:
        part = [rng.randint(least, most) for _ in range(many - 1)]
        if least <= 4096 - sum(part) <= most:
            sizes += [*part, 4096 - sum(part)]
    rng.shuffle(sizes)
    got = packing.pack_sizes(sizes, 4096)
    assert sorted(itertools.chain(*got)) == sorted(sizes) and all(sum(b) <= 4096 for b in got)
    assert bins <= len(got) <= bins + 1 < len(packing.best_fit(sizes, 4096))


@pytest.mark.parametrize("block", [1000, 7])
def test_packing(spark, block):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma9"]) for _ in range(rng.randrange(0, 90)))) for i in range(60)] + [(90, None), (91, "x " * 500), (5, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = packing.tokenized_pieces(docs, WORDS, length=64)
    assert "ids" in pieces.columns
    got = packing.pack_pieces(pieces, length=64, block=block).toPandas()
    assert len(got[got.doc_id == 91]) == -(-501 // 64) and list(got[got.doc_id == 90]["length"]) == [1]
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == list(g["length"].cumsum() - g["length"]) and g["length"].sum() <= 64
    assert got.sequence_id.nunique() <= got["length"].sum() / 64 * 1.1 + 3
    clash = packing.pack_pieces(pieces.selectExpr("doc_id", "length as size", "'o' as offset", "'r' as _row", "'b' as _block", "'a' as _again", "1 as sequence_id", "2 as c0"), length=64, block=block, size_col="size")
    assert clash.columns == ["doc_id", "size", "_row", "_block", "_again", "c0", "sequence_id", "offset"] and clash.filter("_row = 'r' and _block = 'b' and c0 = 2").count() == len(got)
    assert packing.pack_pieces(packing.tokenized_pieces(docs.limit(0), WORDS, length=64), length=64).count() == 0


def test_packing_query(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(9)
    texts = [None, "", "a", "x " * 9000, "one two three", "one two three", "Ünï 漢字 " * 700] + [" ".join(rng.choice(["alpha", "beta's", "9 8"]) for _ in range(rng.randrange(2500))) for _ in range(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.op4_best_fit_packing(spark, str(tmp_path)).toPandas()
    whole = Tokenizer.from_file(WORDS)
    for i, t in enumerate(texts):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        cut = [ids[at : at + 4096] for at in range(0, len(ids), 4096)]
        mine = got[got.doc_id == i].sort_values("piece")
        assert mine[["piece", "start", "length", "ids_crc32"]].to_numpy().tolist() == [[k, 4096 * k, len(c), zlib.crc32(np.array(c, "<u4").tobytes())] for k, c in enumerate(cut)]
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == (g["length"].cumsum() - g["length"]).tolist() and g["length"].sum() <= 4096
    assert got.sequence_id.nunique() <= len(packing.best_fit(got["length"].tolist(), 4096))


class PlainPpm:
    """The same statistics without tables: counts by context, escapes and exclusions worked out for each byte."""

    def __init__(self, texts):
        self.seen = [{} for _ in range(4)]
        for t in texts:
            t = b"\n\n\n" + t
            for i in range(3, len(t)):
                for o in range(4):
                    self.seen[o].setdefault(t[i - o : i], {}).setdefault(t[i], 0)
                    self.seen[o][t[i - o : i]][t[i]] += 1

    def probability(self, context, byte, order):
        if order < 0:
            return 1 / 256
        own = self.seen[order].get(context[3 - order :])
        if own is None:
            return self.probability(context, byte, order - 1)
        total = sum(own.values()) + len(own)
        if byte in own:
            return own[byte] / total
        escape = len(own) / total
        left = 1 - sum(self.probability(context, b, order - 1) for b in own) if order else 1 - len(own) / 256
        return escape * self.probability(context, byte, order - 1) / left

    def bits(self, text):
        text = b"\n\n\n" + text
        return -sum(np.log2(self.probability(text[i - 3 : i], text[i], 3)) for i in range(3, len(text)))


def test_code_lengths_equal_a_plain_model(monkeypatch):
    monkeypatch.setattr(language_id, "LEAST_SEEN", (1, 1, 1))
    rng = random.Random(3)
    texts = {k: [toy(k, rng, 25).encode() for _ in range(4)] for k in ("xx", "yy")}
    # all bytes of the tests are learned, so that none is only known as any other byte
    known = sorted(set(b"".join(sum(texts.values(), [])) + b"\n"))
    counts = {k: np.unique(np.concatenate([language_id._grams(t) for t in ts]), return_counts=True) for k, ts in texts.items()}
    model = language_id.fit_tables(counts)
    new = [toy("xx", rng, 6).encode(), toy("yy", rng, 6).encode(), bytes(rng.choice(known) for _ in range(40))]
    got = model.code_lengths(new)
    for j, k in enumerate(model.langs):
        plain = PlainPpm(texts[k])
        assert np.allclose(got[:, j], [plain.bits(t) for t in new], rtol=1e-4)


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>Head&amp;line</h1></header><p>First <b>bo</b>ld&nbsp;&eacute;\n  text.<br><p>Short.<div class="ad">Buy now</div><p>Last &lt;one&gt;.</p>
<section id="comments"><article><p>Nice post!</p></article></section></article>
<aside>Related things</aside><form><p>Sign up</p></form><footer>&copy; us</footer></body></html>"""


def test_html():
    assert html_text.main_text(PAGE) == "Head&line First bold é text. Short. Last <one>."
    assert html_text.main_text(None) == "" == html_text.main_text("<p") == html_text.main_text("<script>x")
    plain = "<body><div><a href=x>Home</a></div>" + "<p>" + "word " * 40 + "</p><p>a b</p>" + "<div><a href=y>" + "link " * 30 + "</a></div></body>"
    assert html_text.main_text(plain) == ("word " * 40 + "a b").strip()
    assert html_text.main_text("<article>" + "<div>" * 5000 + "deep</article>") == "deep"


def plain_text(html, window=3, surge=80):
    """The extractor again, by the parser of the standard library and sums over all windows. For well-formed pages."""
    from html.parser import HTMLParser

    beside = {"nav", "footer", "aside", "form", "script", "style", "title", "button"}

    class Lines(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.lines, self.text, self.chars = [], [], "", 0

        def end(self):
            text = " ".join(self.text.split())
            if text:
                home = any(t in ("article", "main") for t, _ in self.open)
                self.lines.append((text, self.chars, not any(bad for _, bad in self.open), home))
            self.text, self.chars = "", 0

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                return self.end()
            if tag not in ("a", "b", "i", "em", "span"):
                self.end()
            home = any(t in ("article", "main") for t, _ in self.open)
            names = set((dict(attrs).get("class") or "").split())
            bad = tag in beside or tag == "header" and not home or bool(names & {"ad", "comments", "cookie-notice", "sidebar"}) and (tag not in ("article", "main") or home)
            self.open.append((tag, bad))

        def handle_endtag(self, tag):
            if tag not in ("a", "b", "i", "em", "span"):
                self.end()
            while self.open.pop()[0] != tag:
                pass

        def handle_data(self, data):
            self.text += data
            if not any(t == "a" for t, _ in self.open):
                self.chars += len(data.strip())

    p = Lines()
    p.feed(html)
    p.end()
    named = any(fit and home for _, _, fit, home in p.lines)
    weight = [0 if not fit else len(t) * surge * home if named else chars for t, chars, fit, home in p.lines]
    sums = [sum(weight[i : i + window]) for i in range(len(weight))]
    surge = surge if max(sums, default=0) >= surge else 1
    keep, inside, stretch = [], False, []
    for i in range(len(weight) + 1):
        if i < len(weight) and (sums[i] >= surge or inside and sums[i] > 0):
            inside = True
            stretch.append(i)
        elif inside:
            full = [k for k in stretch if weight[k]]
            keep += [k for k in stretch if full[0] <= k <= full[-1] and p.lines[k][2] and (weight[k] or not named)]
            inside, stretch = False, []
    return " ".join(p.lines[k][0] for k in keep)


def test_html_equals_brute_force():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeiou") for _ in range(rng.randint(2, 9)))
    some = lambda k: " ".join(word() for _ in range(k))

    def block(depth):
        kind = rng.randrange(11)
        if kind < 4:
            return f"<p>{some(rng.randint(1, 40))} <b>{some(2)}</b> <a href=u>{some(2)}</a></p>"
        if kind == 4:
            return "<ul>" + "".join(f"<li><a href=u>{some(2)}</a></li>" for _ in range(rng.randint(1, 6))) + "</ul>"
        if kind == 5:
            return rng.choice([f"<div class=ad>{some(12)}</div>", f"<aside><p>{some(30)}</p></aside>", f"<div class='cookie-notice'>{some(9)}</div>", f"<form><p>{some(4)}</p></form>"])
        if kind == 6:
            return f"<section class=comments><article><p>{some(30)}</p></article></section>"
        if kind == 7:
            return f"<article class='{rng.choice(['ad', 'card'])}'><p>{some(15)}</p></article>" if depth < 3 else some(3)
        if kind == 8:
            deep = rng.choice([1, 3, 700])
            return "<div>" * deep + some(rng.randint(1, 9)) + "</div>" * deep
        return "<div>" + "".join(block(depth + 1) for _ in range(rng.randint(1, 5))) + "</div>" if depth < 4 else some(5)

    pages = []
    for i in range(80):
        body = "".join(block(0) for _ in range(rng.randint(1, 9)))
        if i % 2:
            body = rng.choice([f"<main>{body}</main>", f"<main>{body}</main>" + block(0), f"<div>{block(0)}<article><header><h1>{some(3)}</h1></header>{body}</article>{block(0)}</div>"])
        pages.append(f"<html><head><title>t</title></head><body><header>{some(4)}</header><nav><a href=u>{some(3)}</a></nav>{body}<footer>{some(20)}</footer></body></html>")
    pages += [f"<body><p>{some(3)}</p></body>", "<body></body>", f"<body><nav>{some(60)}</nav></body>"]
    for page in pages:
        assert html_text.main_text(page) == plain_text(page)
    assert sum(bool(plain_text(p)) for p in pages) > 60


def test_html_names_are_read_as_a_whole():
    body = "word " * 30 + "end"
    for name in ("article-header-wrapper", "legal-analysis", "notice-of-motion", "shared-values"):
        assert html_text.main_text(f"<body><div class='{name}'><p>{body}</p></div></body>") == body
        assert html_text.main_text(f"<article><p class='{name}'>{body}</p></article>") == body
    for name in ("cookie-notice", "site-header", "legal", "page-sidebar", "ad-slot-top", "search-wrapper"):
        assert html_text.main_text(f"<body><p>{body}</p><div class='{name}'><p>none of it, whatever it says at length here or there</p></div></body>") == body
    assert html_text.main_text("<main><p>One.</p><article class=related><p>Two</p></article><article class='ad'>Three</article></main>") == "One."
    assert html_text.main_text("<body>" + "<div>" * 600 + "<nav>Menu of a hundred things</nav><p>Short page only.</p>") == "Short page only."


def test_html_keeps_all_stretches():
    links = "".join(f"<div><a href=x>link {i}</a></div>" for i in range(5))
    first, second = "word " * 40 + "one", "more " * 25 + "two"
    assert html_text.main_text(f"<body>{links}<p>{first}</p>{links}<p>{second}</p>{links}</body>") == f"{first} {second}"
    assert html_text.main_text(f"<body>{links}<p>A short text.</p>{links}</body>") == "A short text."


def test_html_query(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 6)], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_text.extract_pages(pages.drop("text")).collect()}
    assert got[1].n_chars == len(got[1].text) > 0 and (got[2].text, got[2].n_chars) == ("", 0)
    assert html_text.extract_pages(pages).columns == ["page_id", "url", "text", "n_chars"]
    clash = pages.selectExpr("page_id", "html", "'h' as _html", "'r' as _row", "'t' as _text", "3 as n_chars")
    assert html_text.extract_pages(clash).columns == ["page_id", "_html", "_row", "_text", "text", "n_chars"]
    assert {r.page_id: (r._html, r.n_chars) for r in html_text.extract_pages(clash.unionAll(clash)).collect()} == {i: ("h", g.n_chars) for i, g in got.items()}
    assert html_text.extract_pages(clash.limit(0)).count() == 0


def toy(language, rng, n):
    parts = {"xx": "lo mu ra ti ne".split(), "yy": "sch erf ung pfe ein".split(), "zz": "ção ñar lla éo qui".split()}[language]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(6)
    rows = [(i, toy(lang, rng, 30), lang) for i, lang in zip(range(300), itertools.cycle(["xx", "yy", "zz"]))] + [(900, None, "xx"), (901, "123 !?", "xx"), (902, "", None), (None, "lo mu", "xx"), (903, "schein", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_language_model(docs)
    likely = (2.0 ** -model.bits.astype(float)).reshape(-1, model.n_symbols, len(model.langs))
    assert np.allclose(likely[:, :-1].sum(1) + likely[:, -1] * (257 - model.n_symbols), 1, atol=1e-5)
    got = {r.doc_id: r for r in language_id.predict_languages(docs, model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows[:300]) >= 297
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and got[903].lang_pred == "yy"
    assert language_id.identify(None, ["lo"]) == (["und"], [0.0]) and language_id.fit_language_model(docs.limit(0)) is None
    clash = language_id.predict_languages(docs.selectExpr("*", "1 as score", "'x' as _pred", "2 as _row", "3 as _found"), model)
    assert clash.columns == ["doc_id", "text", "lang", "_pred", "_row", "_found", "lang_pred", "score"] and clash.filter("_pred = 'x'").count() == len(rows)
    assert language_id.predict_languages(docs.limit(0), model).count() == 0
    long = toy("xx", rng, 200)
    whole = model.code_lengths([long.encode() * 50])
    language_id.SEGMENT, kept = 997, language_id.SEGMENT
    assert np.allclose(model.code_lengths([long.encode() * 50, b"x"])[:1], whole)
    language_id.SEGMENT = kept


def test_languages_are_not_capped(spark):
    rng = random.Random(12)
    rows = [(10 * k + i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{rng.choice('aeiou')}" for _ in range(40)), f"l{k:03}") for k in range(205) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_language_model(docs)
    learned = {r.lang for r in docs.filter(language_id.fold_of("doc_id") != 0).select("lang").distinct().collect()}
    assert len(learned) > 200 and model.langs == sorted(learned)


def test_contexts_do_not_vanish_as_languages_are_added():
    rng = np.random.default_rng(2)
    texts = {f"l{k}": bytes(rng.integers(33 + 3 * k, 45 + 3 * k, 30_000, dtype=np.uint8)) for k in range(60)}
    counts = {lang: np.unique(language_id._grams(t), return_counts=True) for lang, t in texts.items()}
    few, many = (language_id.fit_tables({k: counts[k] for k in sorted(counts)[:n]}) for n in (2, 60))
    # a context kept for some languages is kept beside others too: no shorter one stands for it
    at = lambda m, t: m.context[(m.symbol[t[0]] * m.n_symbols + m.symbol[t[1]]) * m.n_symbols + m.symbol[t[2]]]
    longest = lambda m: {g for g in {texts["l0"][i : i + 3] for i in range(3000)} if at(m, g) != at(m, bytes([255]) + g[1:])}
    assert longest(few) and longest(few) <= longest(many)


def test_licenses(spark):
    filler = "one two three four five six seven eight nine ten "
    grant = license_scan.TEMPLATES["MIT-grant"]
    rows = [(1, filler * 3 + "Released under the MIT license! " + filler), (2, filler + grant.upper() + " " + filler), (3, filler * 20), (4, None), (5, ""), (6, grant.replace("documentation", "other")), (7, " ".join(grant.split()[:12]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as license")
    got = {(r.doc_id, r.license): r for r in license_scan.license_matches(docs).collect()}
    assert set(got) == {(1, "MIT"), (2, "MIT-grant"), (6, "MIT-grant")} and got[2, "MIT-grant"].containment == 1
    assert license_scan.license_matches(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        license_scan.license_matches(docs, {"x": "too short"})


def test_urls(spark):
    rows = [(1, "http://A.example.com/en/7?x"), (2, "https://b.com/en/1"), (3, "x://example.net/de/88"), (4, "x://net/de/"), (5, None), (6, "nothing"), (7, "y://notcom/en/"), (8, "h://o.org?/es/"), (9, "h://o.org/es/#a")]
    rows += [(100 + i, f"h://bad.spam.io/{i}") for i in range(60)] + [(200 + i, f"h://good.fine.io/{i}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' as host", "0 as bad")
    outcomes = spark.createDataFrame([(100 + i, 1) for i in range(50)] + [(200 + i, 0) for i in range(50)] + [(1, None), (None, 1)], "page_id long, bad int")
    got = {r.page_id: r for r in url_filter.url_verdicts(pages, outcomes).collect()}
    assert len(got) == len(rows)
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(1, 10)] == [
        ("a.example.com", "/en/7", "example.com/en/7", "allow"), ("b.com", "/en/1", "com/en/", "block"), ("example.net", "/de/88", "example.net/de/8", "block"), ("net", "/de/", "net/de/", "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("notcom", "/en/", None, "allow"), ("o.org", "", None, "allow"), ("o.org", "/es/", "org/es/", "block"),
    ]
    assert {got[100 + i].verdict for i in range(60)} == {"block"} and {got[200 + i].verdict for i in range(60)} == {"allow"}
    assert url_filter.url_verdicts(pages.limit(0), outcomes.limit(0)).count() == 0
    few = spark.createDataFrame([(1, "h://a.co.uk/"), (2, "h://b.co.uk/"), (3, None)], "page_id long, url string")
    # hosts without an outcome of their own are never blocked
    assert {r.page_id: r.verdict for r in url_filter.url_verdicts(few, spark.createDataFrame([(2, 1)], "page_id long, bad int")).collect()} == {1: "allow", 2: "block", 3: "allow"}
    # b.co.uk and c.co.uk are registered domains of their own: what the one does says little of the other
    hosts = spark.createDataFrame([(f"h{i}.{d}", int(d == "b.co.uk")) for i in range(9) for d in ("b.co.uk", "c.co.uk")] + [("x.c.co.uk", None)], "host string, bad int")
    found = {r.host: r for r in url_filter.host_reputation(hosts).collect()}
    assert found["x.c.co.uk"].n == 0 and found["x.c.co.uk"].mean < 0.3 < found["h1.b.co.uk"].mean
