import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crawlmill.llm import encoding, flat, language, main_content, packing, residue, signs, site_lines, tokens

ROOT = "/root/testdata/sf0.001"
PAGE = "id long, url string, domain string, title string, summary string, language string, status string"


def pages_of(spark, rows):
    full = [(i, f"https://{h}/{i}" if h else None, h, t, s, None, None) for i, h, t, s in rows]
    return spark.createDataFrame(full, PAGE).withColumn("line_no", F.lit("clash")).withColumn("lang", F.lit("clash")).withColumn("host", F.lit("clash"))


# --- flat lines


def test_flat_lines():
    f = flat.Flat(["a\n\n  b c \xa0", None, "", "x😀"])
    assert f.text.tolist() == [0, 0, 0, 1, 2, 3] and f.number.tolist() == [1, 2, 3, 1, 1, 1] and f.size.tolist() == [1, 0, 3, 0, 0, 2]


# --- problem 3

SENTENCES = {
    "pt": "O painel de controle transforma o cálculo das rotas para quem está começando e não há dúvida de que a prefeitura acompanha os resultados.",
    "en": "The control panel transforms the planning of routes for those who are just starting and there is no doubt that the town hall follows it.",
    "de": "Die Gemeinschaft der Entwickler verkürzt die Fußzeile des Portals und das Rathaus vergleicht die Messung der Wassergüte seit gestern.",
}


@pytest.fixture(scope="module")
def profiles(spark):
    return language.fit_profiles(spark.read.parquet(f"{ROOT}/lang_samples.parquet"), spark.read.parquet(f"{ROOT}/pages.parquet"))


def test_language_held_out(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{ROOT}/lang_samples.parquet").orderBy("sample_id").collect()]
    fitted = language.Profiles.fit(rows[::2])
    sums, n, _ = fitted.scores(flat.Flat([t for _, t in rows[1::2]]))
    assert np.mean([fitted.langs[k] == lang for k, (lang, _) in zip(sums.argmax(1), rows[1::2])]) > 0.97


def test_trigram_table_is_the_bundled_dot_product():
    langs, vectors = language.prototypes([("a", "abc abd the cat"), ("b", "xyz xyw der hund"), ("c", "o gato come")])
    fitted = language.Profiles.of(langs, vectors)
    texts = ["abc xyz", "the cat the cat the cat and der hund", "o gato come o gato come", "123", ""]
    sums, n, norms = fitted.scores(flat.Flat(texts))
    for i, text in enumerate(texts):
        codes, _ = language.trigrams(flat.Flat([text]))
        bundle = language.trigram_vectors(codes).sum(0)
        assert n[i] == len(codes)
        assert np.allclose(sums[i], bundle @ vectors.T / np.sqrt(language.DIMENSIONS), atol=1e-3)
        assert abs(norms[i] - np.linalg.norm(bundle) / np.sqrt(language.DIMENSIONS)) <= 0.05 * norms[i]


def test_languages_of_pages_and_lines(spark, profiles):
    mixed = "\n".join([SENTENCES["pt"]] * 3 + ["", SENTENCES["de"]])
    rows = [(1, "h", None, mixed), (2, "h", "t", SENTENCES["en"] * 400), (3, "h", "t", None), (4, "h", "t", " \n "), (5, "h", None, "12345"), (6, "h", None, mixed)]
    got = language.label_languages(pages_of(spark, rows), profiles).collect()
    assert {(r.id, r.line_no, r.lang) for r in got} == {(1, 0, "pt"), (1, 5, "de"), (2, 0, "en"), (6, 0, "pt"), (6, 5, "de")}
    assert all(0 < r.confidence <= 1 for r in got)
    assert language.label_languages(pages_of(spark, rows).limit(0), profiles).count() == 0


def test_title_decides_where_the_summary_has_no_letters(spark, profiles):
    rows = [(1, "h", SENTENCES["pt"], None), (2, "h", SENTENCES["de"], " \n "), (3, "h", SENTENCES["en"], "123"), (4, "h", None, None), (5, "h", SENTENCES["en"], SENTENCES["en"])]
    pages = pages_of(spark, rows)
    labels = language.label_languages(pages, profiles)
    got = {r.id: r for r in labels.collect()}
    assert {i: (r.line_no, r.lang, r.chars > 0) for i, r in got.items()} == {1: (0, "pt", False), 2: (0, "de", False), 3: (0, "en", False), 5: (0, "en", True)}
    assert all(0 < got[i].confidence < got[5].confidence for i in (1, 2, 3))
    assert {r.id for r in language.language_faults(pages.drop("line_no", "lang"), labels).collect()} == {5}


def test_stored_labels(spark):
    cases = [("PT", "pt"), ("pt_br", "pt"), ("eng", "en"), (" es-419 ", "es"), ("DEU", "de"), ("xx", None), ("", None), (None, None), ("unknown", None), ("und", None)]
    rows = spark.createDataFrame([(a,) for a, _ in cases], "l string").select(language.labelled_as(F.col("l")).alias("x")).collect()
    assert [r.x for r in rows] == [b for _, b in cases]


# --- problem 5

GOOD = "O projeto Siva mostra que o painel de controle transforma o cálculo das rotas."
#: Pages that tell by themselves, whatever other pages say.
MARKED = [
    ("{{ title }}", GOOD), ("[[CONTENT]] - Site", GOOD), ("t", "Hello ${user.first_name}, see how it works."), ("t", f"Menu\n%(name)s\n{GOOD}"), ("t", f"{GOOD}\n<titulo>"),
    ("t", "Vestor nulla integre polor donac. Quamet erat ipsum lorem vestor."), ("t", "sample text sample text sample text"), ("t", "asdf test qwer asdf test qwer 1234"),
    ("t", "DONAC LOREM PULVIS FAUCET."),
]
SOUND = [
    ("Title of a page", GOOD), (None, None), ("", " \n "), ("t", "In the template engine the mark {{ name }} gives way to a value, and the town hall follows it."),
    ("t", "O texto lorem ipsum serve de enchimento, mas a fabricante descreve o portal."), ("t", f"Please enable JavaScript to view the comments on this page.\n{GOOD}"),
    ("t", "Quando aparece o erro 404, a prefeitura revisa as previsões para a região."), ("t", "Quem desliga o JavaScript nota que a rede publica o portal."),
    ("t", "for (let i = 0; i < 10; i++) run(i);\nconst x = 404;\nSELECT id FROM t WHERE n > 508;"), ("Home", "Home · Forum · Courses\n© 2024 X. All rights reserved."),
]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.read.parquet(f"{ROOT}/lang_samples.parquet")


def test_function_words_of_all_samples(spark, samples):
    rows = [(i, "xx", "comum " + ("" if i < 2000 else "tarde Straße") + ("cedo" if i < 320 else "")) for i in range(2500)]
    rows += [(3000, "yy", "12"), (3001, "yy", " "), (3002, "zz", "só"), (3003, None, "nada"), (3004, None, "nada"), (3005, "yy", None)]
    hash_of = lambda *x: set(signs.Words(flat.Flat(list(x))).hash.tolist())
    schema = "sample_id long, lang string, text string"
    got = set(signs.function_words(spark.createDataFrame(rows, schema).repartition(5)).tolist())
    # tarde stands in 500 of 2,500, none of them among the first 2,000; cedo in 320 of them, which is less than the share of all
    assert got == hash_of("comum", "tarde", "strasse")
    assert signs.function_words(spark.createDataFrame([], schema)).tolist() == []
    given, by_lang = {}, {}
    for r in samples.collect():
        words = signs.Words(flat.Flat([r.text.replace("ß", "ss")]))
        by_lang[r.lang] = by_lang.get(r.lang, 0) + 1
        for w in set(words.hash[~words.number].tolist()):
            given[r.lang, w] = given.get((r.lang, w), 0) + 1
    assert set(signs.function_words(samples).tolist()) == {w for (lang, w), n in given.items() if n >= max(2, 0.15 * by_lang[lang])}


def content(g):
    """A sentence that no other page has."""
    return f"O projeto {g.randrange(10**9)} da {g.choice(['rede', 'prefeitura'])} mostra que o {g.choice(['painel', 'portal'])} N{g.randrange(10**9)}x{''.join(g.choices('abcdefg', k=9))} transforma o cálculo das rotas."


def site_pages(n=60, hosts=6):
    """Sound pages with the same furniture on several hosts."""
    g = random.Random(3)
    return [(1000 + i, f"h{i % hosts}.example", f"Assunto {''.join(g.choices('abcdefgh', k=9))}", f"Home · Forum\n{content(g)}\nPlease enable JavaScript to view the comments on this page.\n© 2024 H{i % hosts}. All rights reserved.") for i in range(n)]


def residue_of(spark, samples, rows, queue=None):
    return {(r.id, r.kind) for r in residue.evidence(signs.line_signs(pages_of(spark, rows), samples), queue).collect()}


def test_pages_that_tell_by_themselves(spark, samples):
    rows = [(i, f"h{i}.example", t, s and s.replace(GOOD, content(random.Random(i)))) for i, (t, s) in enumerate(MARKED + SOUND)]
    got = residue_of(spark, samples, rows)
    assert {i for i, _ in got} == set(range(len(MARKED))) and {k for _, k in got} == {"placeholder", "filler"}
    crlf = [(i, h, t, s.replace("\n", "\r\n") + " \u00a0\r\n" if s else s) for i, h, t, s in rows]
    assert residue_of(spark, samples, crlf) == got
    lines = signs.line_signs(pages_of(spark, rows).limit(0), samples)
    assert residue.residue_pages(lines).count() == 0
    sound = residue.without_residue(spark.range(len(rows)), residue.residue_pages(signs.line_signs(pages_of(spark, rows), samples)))
    assert sound.count() == len(SOUND)


def test_responses_by_the_evidence_of_hosts(spark, samples):
    """No word of the response is known; what leaves pages silent on several hosts is one, what stands beside content is none."""
    said = "Glimp vorda, the trebel is away and we do not know it (ref 12)."
    bad = [(i, f"h{i % 4}.example", "A topic of its own", f"Home · Forum\n{said.replace('12', str(i))}\n© 2024 H{i % 4}. All rights reserved.") for i in range(8)]
    furniture = [(50 + i, f"h{i}.example", "Another topic", f"Home · Forum\n© 2024 H{i}. All rights reserved.") for i in range(3)]
    got = residue_of(spark, samples, site_pages() + bad + furniture)
    assert got == {(i, "response") for i in range(8)}
    # beside content it is none
    both = [(i, h, t, f"{s}\n{content(random.Random(i))}") for i, h, t, s in bad]
    assert residue_of(spark, samples, site_pages() + both + furniture) == set()


def test_responses_need_less_where_scripts_are_needed_and_more_where_terms_are_shared(spark, samples):
    bad = [(i, f"h{i}.example", "A topic of its own", "Glimp vorda trebel") for i in range(3)]
    queue = spark.createDataFrame([(f"https://h{i}.example/{i}", True) for i in range(3)] + [(None, None)], "url string, needs_js boolean")
    assert residue_of(spark, samples, site_pages() + bad) == set()
    assert residue_of(spark, samples, site_pages() + bad, queue) == {(i, "response") for i in range(3)}
    more = [(i, f"h{i % 4}.example", "A topic of its own", "Glimp vorda trebel") for i in range(8)]
    assert len(residue_of(spark, samples, site_pages() + more)) == 8
    related = [(i, h, f"{chr(97 + i) * 7} vorda trebel", s) for i, h, _, s in more]
    assert residue_of(spark, samples, site_pages() + related) == set()


def test_responses_of_one_host(spark, samples):
    """One host's evidence counts where most of its pages are otherwise sound; a host of silent pages only proves nothing."""
    bad = [(i, "h0.example", "A topic of its own", "Glimp vorda trebel") for i in range(12)]
    sound = [(2000 + i, "h0.example", t, s) for i, _, t, s in site_pages(40, 1)]
    assert residue_of(spark, samples, site_pages() + sound + bad) == {(i, "response") for i in range(12)}
    alone = [(i, "quiet.example", "A topic of its own", "Menu vorda trebel") for i in range(12)]
    assert residue_of(spark, samples, site_pages() + alone) == set()


# --- problem 6


def fold(line):
    import re

    return re.sub("[0-9]+", "0", " ".join(line.casefold().split()))


def test_repeated_lines_against_brute_force(spark, samples):
    g = random.Random(4)
    stock = ["© 2024 Site. All  rights", "© 1999 SITE. ALL RIGHTS", "Share\xa0this 12", "share this 7\r", "Straße 5a12", "STRASSE 6a7", "Rare", "", "  ", "…", "..", "NAMES of It"]
    rows = []
    for i in range(300):
        rows.append((i, g.choice(["A.example", "a.example:80", "b.example", None]), "Rare", "\n".join(g.choice(stock) for _ in range(6)) if g.random() > 0.05 else None))
    pages = pages_of(spark, rows)
    got = {tuple(r) for r in site_lines.repeated_lines(signs.line_signs(pages, samples), 40).collect()}
    hosts, seen = {"A.example": "a", "a.example:80": "a", "b.example": "b"}, {}
    lines = [(i, n, hosts.get(h, f"?{i}"), fold(x), f"{h}/{i}") for i, h, _, s in rows if s for n, x in enumerate(s.split("\n"), 1) if x.strip()]
    for _, _, h, k, u in lines:
        seen.setdefault((h, k), set()).add(u)
    assert got == {(i, n) for i, n, h, k, _ in lines if len(seen[h, k]) >= 40} and got
    assert site_lines.repeated_lines(signs.line_signs(pages.limit(0), samples)).count() == 0


def test_repeated_lines_come_from_clusters(spark, samples, monkeypatch):
    """Lines come from buckets of enough documents and by clusters of both bands; the exact count decides among the texts of these alone."""
    schema = "id long, line_no int, host string, url_hash long, k1 long, k2 long, b0 int, b1 int, bins long, parity long"
    row = lambda i, host, b0, b1, url: (i, 1, host, url, 5, 6, b0, b1, 7, 3)
    masked = [row(i, "a", i, 1, i) for i in range(12)]  # the band of the masked words alone brings them together
    copies = [row(100 + i, "b", 2, 2, i % 6) for i in range(12)]  # twelve lines of six documents
    cased = [row(200 + i, "c", i, 1 + i // 10, i) for i in range(12)]  # two lines in a sparse bucket count in their text's cluster
    lines = spark.createDataFrame(masked + copies + cased + [(r[0], 0, *r[2:]) for r in masked], schema)
    assert {tuple(r) for r in site_lines.repeated_lines(lines).collect()} == {(r[0], 1) for r in masked + cased}
    assert site_lines.crowded(lines, "b0").count() == 0
    assert {r.host for r in site_lines.crowded(lines, "b0", 6).collect()} == {"b"}
    report = site_lines.cluster_report(site_lines.clusters(lines, 6), lines).collect()
    assert sorted((r.host, r.lines, r.documents) for r in report) == [("a", 12, 12), ("b", 12, 6), ("c", 12, 12)]
    # bylines with changing names are a cluster of the same site, but no text of it is on ten pages
    real = site_lines.clusters
    pages = signs.line_signs(pages_of(spark, named_pages(spark)), samples)
    monkeypatch.setattr(site_lines, "clusters", lambda *a: real(*a).where("pages < 10"))
    assert site_lines.repeated_lines(pages).count() == 0


def named_pages(spark):
    """Bylines that no two pages share, a notice that all have, and sentences of their own."""
    g = random.Random(8)
    name = lambda: "".join(g.choices("abcdefgh", k=6)).capitalize()
    rows = [(i, "a.example", "t", f"Por {name()} {name()}, da redação do Site\n{content(g)}\nTodos os direitos reservados") for i in range(15)]
    return rows + [(99, "b.example", "t", f"Por {name()} {name()}, da redação do Site"), (98, "a.example", None, None), (97, "a.example", None, "")]


def test_clusters_remove_lines_with_changing_names(spark, samples):
    rows = named_pages(spark)
    pages = pages_of(spark, rows)
    lines = signs.line_signs(pages, samples)
    found = site_lines.clusters(lines)
    for limit in (1000, 0):  # by broadcast and by join
        got = {r.id: r.kept for r in site_lines.without_texts(pages, lines, found, limit).collect()}
        want = {i: s and "\n".join(x for x in s.split("\n") if i == 99 or "projeto" in x) for i, _, _, s in rows}
        assert got == want
    report = sorted((r.texts, r.documents) for r in site_lines.cluster_report(found, lines).collect())
    assert report == [(1, 15), (15, 15)]
    # the exact lines alone leave the bylines
    exact = {tuple(r) for r in site_lines.repeated_lines(lines).collect()}
    assert exact == {(i, 3) for i in range(15)}
    assert site_lines.clusters(lines.limit(0)).count() == 0
    assert site_lines.without_texts(pages, lines, found.limit(0)).where("kept is not null").count() == 17


def test_lines_removed(spark):
    pages = pages_of(spark, [(1, "h", None, "a\nb\n\nc"), (2, "h", None, None), (3, "h", None, "x")])
    gone = spark.createDataFrame([(1, 2), (1, 2), (3, 1)], "id long, line_no int")
    assert {r.id: r.kept for r in site_lines.without_lines(pages, gone).collect()} == {1: "a\n\nc", 2: None, 3: ""}


# --- problem 7


def furnished(n=40, hosts=4):
    """Pages of a menu, a byline, text, a list, a sub-headline, code, related links behind a lead, a box of headlines and a notice; and their labels."""
    g = random.Random(6)
    name = lambda: "".join(g.choices("abcdefgh", k=7)).capitalize()
    word = lambda: name().lower()
    head = lambda: f"A {word()} {word()} o {word()} de {word()} com {name()}"
    rows, labels = [], []
    for i in range(n):
        lines = [("Início · Fórum · Contato", 1), (f"Por {name()} {name()}, da redação", 1), (content(g), 0), (head(), 0), ("", None), (f"- o {word()} da {word()} ({name()})", 0), (f"{word()} {word()} = {word()}({i})", 0), (content(g), 0)]
        lines += [(f"Leia também: {head()}", 1), ("Mais lidas", 1), (head(), 1), (head(), 1), (f"© {2000 + i} Todos os direitos reservados.", 1)]
        rows.append((i, f"h{i % hosts}.example", head(), "\n".join(x for x, _ in lines)))
        labels += [(i, k, y) for k, (_, y) in enumerate(lines, 1) if y is not None]
    return rows, labels


def test_labels_by_structure(spark, samples):
    rows, want = furnished()
    pages = pages_of(spark, rows)
    lines = signs.line_signs(pages, samples)
    drawn = pages.where("id < 10").select("id")
    got = {(r.id, r.line_no): r.label for r in main_content.structural_labels(lines, drawn).collect()}
    assert got == {(i, k): y for i, k, y in want if i < 10}
    assert main_content.structural_labels(lines.limit(0), drawn).count() == 0


def test_labeller_learns_from_structure(spark, samples):
    rows, want = furnished(160)
    pages = pages_of(spark, rows)
    fitted = main_content.fit_labeller(pages.where("id < 120"), signs.line_signs(pages.where("id < 120"), samples))
    held = pages.where("id >= 120")
    got = {(r.id, r.line_no): r.furniture > 0.5 for r in main_content.label_blocks(held, fitted).collect()}
    held_labels = {(i, k): y == 1 for i, k, y in want if i >= 120}
    assert got.keys() == held_labels.keys() and np.mean([got[k] == y for k, y in held_labels.items()]) > 0.97
    main = {r.id: r.main_text for r in main_content.main_text(held, fitted).collect()}
    for i, _, _, text in rows[120:]:
        assert main[i] == "\n".join(x for k, x in enumerate(text.split("\n"), 1) if not got.get((i, k), False))
    assert main_content.fit_labeller(pages.where("id < 120"), signs.line_signs(pages.where("id < 120"), samples)) is fitted


def test_gradient():
    net = main_content.BlockLabeller()
    leaves = main_content.Leaves(["t", None], ["Home | News\nA sentence of the text.\n- item", "Share this\nMore"])
    y = np.array([1, 0, 0, 1, 0], np.float32)

    def loss():
        out = net.forward(net.inputs(leaves), leaves.page)[0].astype(np.float64)
        return np.mean(np.log1p(np.exp(-np.where(y > 0, out, -out))))

    out, full, parts = net.forward(net.inputs(leaves), leaves.page, True)
    grads, _ = net._backward(net.inputs(leaves), ((1 / (1 + np.exp(-out)) - y) / 5).astype(np.float32), full, parts)
    for name in ("Wf", "Ub", "cf", "O"):
        at = np.unravel_index(np.argmax(np.abs(grads[name])), grads[name].shape)
        old = net.w[name][at]
        net.w[name][at] = old + 1e-2
        up = loss()
        net.w[name][at] = old - 1e-2
        slope = (up - loss()) / 2e-2
        net.w[name][at] = old
        assert abs(slope - grads[name][at]) < 0.02 * max(1, abs(slope)) + 2e-3


def test_blocks_of_odd_pages(spark):
    rows = [(1, None, None, None), (2, "h", None, ""), (3, "h", "t", " \n\r\n"), (4, "h", None, "x\n" * 3000), (5, "h", None, "word " * 20_000), (6, "h", None, "😀\n​")]
    got = main_content.label_blocks(pages_of(spark, rows), main_content.BlockLabeller()).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in got} == {4: 3000, 5: 1, 6: 2}
    main = {r.id: r.main_text for r in main_content.main_text(pages_of(spark, rows), main_content.BlockLabeller(), 2.0).collect()}
    assert main == {i: s for i, _, _, s in rows}


# --- problem 8


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.vocabulary())


ODD = ["", "a", " ", "\n\n  \n", "x" * 999, " " * 500, "don't we'll it'S  <|endoftext|>  ok", "😀👩‍💻" * 60, "a b c\x85d\x1ce " * 30, "1234567890" * 40, "検索結果は毎朝更新されます。" * 30]


@pytest.mark.parametrize("text", ODD)
@pytest.mark.parametrize("leaf", [1, 7, 64])
def test_tree_equals_whole(encoder, text, leaf):
    assert encoder.encode(text, leaf) == encoder.leaf(text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'sátx1. 😀"), st.characters(exclude_categories=["Cs"])), max_size=120), st.integers(1, 30))
def test_tree_equals_whole_for_any_text(encoder, text, leaf):
    ids = encoder.encode(text, leaf)
    assert ids == encoder.leaf(text) and encoder.decode(ids) == text


def test_ids_of_documents(spark, encoder):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    texts = [*ODD, None, "repeated", "repeated", "long words and some more of them, " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in tokens.token_ids(docs, spread=1000).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == (other.encode(t, add_special_tokens=False).ids if t else [])
    assert tokens.token_ids(docs.limit(0)).count() == 0


# --- problem 9


def check_packing(rows, sizes, capacity):
    used = {}
    for r in rows:
        assert 0 < r.length and 0 <= r.place and r.place + r.length <= capacity
        used.setdefault(r.container, []).append((r.place, r.place + r.length))
    for spans in used.values():
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    whole = {}
    for r in rows:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
        assert sizes[r.doc_id] > capacity or r.length == sizes[r.doc_id]
    assert whole == {k: v for k, v in sizes.items() if v}
    assert sorted(used) == list(range(len(used)))
    return len(used)


def rounds_by_hand(sizes, capacity):
    """Containers of the same rounds, bracket by bracket."""
    items, rooms, before = sorted(sizes, reverse=True), [], None
    while items:
        if before in (None, len(items)):
            rooms += [capacity] * -(-sum(items) // capacity)
        before, stack, rest, todo, longest = len(items), [], [], [], items[0]
        for c, room in enumerate(rooms):
            n = max(1, room // longest)
            todo += [(longest, c)] * (n - 1) + [(room - (n - 1) * longest, c)] * (room > 0)
        todo.sort()
        for s in items:
            while todo and todo[-1][0] >= s:
                stack.append(todo.pop())
            if stack:
                rooms[stack.pop()[1]] -= s
            else:
                rest.append(s)
        items = rest
    return len(rooms)


@pytest.mark.parametrize("run", [20, 50_000])
def test_packing(spark, monkeypatch, run):
    monkeypatch.setattr(packing, "ROWS_PER_RUN", run)
    g = random.Random(5)
    sizes = {i: g.choice([0, 3, 3, 3, 17, 50, 64, 40, 130, 64 * 3, 21]) for i in range(200)}
    counts = spark.createDataFrame(list(sizes.items()), "doc_id long, tokens int").withColumn("length", F.lit("clash"))
    packed = packing.pack(counts, 64)
    n = check_packing(packed.collect(), sizes, 64)
    parts = [64] * sum(v // 64 for v in sizes.values()) + [v % 64 for v in sizes.values() if v % 64]
    assert n == rounds_by_hand(parts, 64) and n <= 1.1 * sum(sizes.values()) / 64
    filled = packing.fill(packed, 64).first()
    assert (filled.containers, filled.tokens, filled.unused) == (n, sum(sizes.values()), n * 64 - sum(sizes.values()))
    assert tuple(packing.faults(counts, packed, 64).first()) == (0, 0, 0, 0)


def test_faults_of_a_packing(spark):
    counts = spark.createDataFrame([(1, 5), (1, 5), (2, 20), (3, None), (None, 2)], "doc_id long, tokens int").withColumn("place", F.lit("clash"))
    columns = "container long, place long, length int, doc_id long, piece int, start int"
    right = [(0, 0, 16, 2, 0, 0), (1, 0, 5, 1, 0, 0), (1, 5, 5, 1, 0, 0), (1, 10, 4, 2, 1, 16), (1, 14, 2, None, 0, 0)]

    def found(rows):
        return tuple(packing.faults(counts, spark.createDataFrame(rows, columns), 16).first())

    assert found(right) == (0, 0, 0, 0)
    assert found(right[1:]) == (1, 0, 0, 0)
    assert found([*right, (2, 0, 5, 1, 0, 0)]) == (0, 1, 0, 0)
    assert found([*right[:2], (1, 4, 5, 1, 0, 0), *right[3:]]) == (0, 0, 0, 1)
    assert found([(1, 16, 16, 2, 0, 0), *right[1:]]) == (0, 0, 1, 0)
    assert found([*right[:1], (1, 0, 3, 1, 0, 0), (1, 3, 2, 1, 1, 3), *right[2:]]) == (1, 2, 0, 0)
    assert tuple(packing.faults(counts.limit(0), spark.createDataFrame([], columns), 16).first()) == (0, 0, 0, 0)


def test_packing_of_little(spark):
    counts = spark.createDataFrame([(1, None), (2, 0)], "doc_id long, tokens int")
    assert packing.pack(counts).count() == 0 and packing.pack(counts.limit(0)).count() == 0
    assert packing.fill(packing.pack(counts)).first().containers == 0
    twice = spark.createDataFrame([(1, 5), (1, 5), (None, 3)], "doc_id long, tokens int")
    got = packing.pack(twice, 8).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 3), (1, 5), (1, 5)]
    spans = {(r.container, p) for r in got for p in range(r.place, r.place + r.length)}
    assert len(spans) == 13


# --- problem 10


@pytest.fixture(scope="module")
def restorer(spark):
    return encoding.Restorer(encoding.Lengths(encoding.fit_dictionaries(spark.read.parquet(f"{ROOT}/lang_samples.parquet"))))


WRONG = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp1251"), ("cp1252", "mac_roman"), ("cp1252", "koi8_r"), ("cp1252", "cp850")]


@pytest.mark.parametrize("right,wrong", WRONG)
def test_round_trips(restorer, right, wrong):
    text = "A atualização de março não altera as previsões para a região.\nPlain line.\nO índice de busca reduz o consumo de memória após três meses."
    table = encoding.MAPS[wrong]
    garbled = "".join(c if ord(c) < 128 else "".join(table[b] for b in c.encode(right)) for c in text)
    found, fixed, chain = restorer.text(garbled)
    assert found and fixed == text and chain


def test_twice_garbled_and_in_part(restorer):
    line = "A produção de café não altera a configuração padrão."
    once = line.encode().decode("cp1252", "replace")
    twice = "".join(encoding.MAPS["cp1252"][b] for b in once.encode())
    found, fixed, _ = restorer.text(f"{line}\n{twice}")
    assert found and fixed == f"{line}\n{line}"
    assert restorer.text("navega&Atilde;&sect;&Atilde;&pound;o do portal")[1] == "navegação do portal"
    assert restorer.text("B&Atilde;&frac14;cherei")[1] == "Bücherei"


def test_wrong_readings_that_give_usual_letters(restorer):
    """No letter here stands in an unusual place; the dictionaries alone tell."""
    assert restorer.text("El compilador revisa el c·lculo de las rutas y las c·maras de la estaciÛn")[1] == "El compilador revisa el cálculo de las rutas y las cámaras de la estación"


def test_the_bound_drops_no_chain(restorer):
    """The chain found is the shortest of all chains of one step, worked out without the bound."""
    for line in ("nÃ£o hÃ¡ dÃºvida", "A polÌtica e o Ìndice das p·ginas", "a configuraзгo padrгo", "É\xa0proibida a cópia", "preço £214 ou ¢214"):
        spans, of = encoding.SPAN.findall(line), restorer.lengths.of
        costs = [(sum(map(of, spans)).min(), line)]
        for step in (*(f"{c}>utf-8" for c in encoding.SINGLE_BYTE), *sorted(encoding.OTHERS)):
            ways = [encoding.undo(step, s) for s in spans]
            if any(w[0] != s for w, s in zip(ways, spans)):
                extra = sum(restorer.lengths.extra(s, w, n, (step,)) for s, (w, n) in zip(spans, ways))
                parts = iter(w for w, _ in ways)
                costs.append((sum(of(w) for w, _ in ways).min() + encoding.step_cost(step) + extra, encoding.SPAN.sub(lambda _: next(parts), line)))
        assert restorer.line(line)[0] == min(costs, key=lambda x: x[0])[1]


@pytest.mark.parametrize(
    "text",
    [
        "A & B &amp; C", "Ã Â © ® ¬ √ ├ ┤ ░ Ð þ.", "Сервер обновлён, новые страницы доступны всем.", "Η σελίδα ενημερώθηκε χθες το βράδυ.", "页面已经更新，请稍后查看。",
        "sayfa dün gece güncellendi, şimdi daha hızlı açılıyor.", "¿QUÉ PASÓ EN N? ¡ADIÓS, MAÑANA!", "GRÖSSE ÜBER 87 §, ÄNDERUNG Ø 87 µ.", "café e ação, preço £214 ou ¢214", "",
    ],
)
def test_unusual_by_right(restorer, text):
    assert restorer.text(text) == (False, text, [])


def test_garbled_documents(spark):
    rows = [(1, "pol�tica"), (2, None), (3, ""), (4, "nÃ£o hÃ¡ dÃºvida de que a comissÃ£o"), (4, "nÃ£o hÃ¡ dÃºvida de que a comissÃ£o"), (5, "limpo"), (6, "é " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chain", F.lit("clash"))
    found = encoding.fit_dictionaries(spark.read.parquet(f"{ROOT}/lang_samples.parquet"))
    got = sorted(tuple(r) for r in encoding.restored(docs, found).collect())
    assert got == [(1, "pol�tica", "")] + [(4, "não há dúvida de que a comissão", "cp1252>utf-8")] * 2
    assert encoding.restored(docs.limit(0), found).count() == 0
