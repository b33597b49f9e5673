"""Operators 1, 2, 3, 5, 7, 8 and 10 and the pipeline against brute force, on small fixtures with odd rows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from emberline.llm import decontaminate, fingerprint, html, neardup, pii, quality, viterbi

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "one two", "same text here", "same text here"]


def frame(spark, texts, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in enumerate(texts)], schema)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


# -- 1 ---------------------------------------------------------------------------------------------------------------
def word_sets(texts, width=5):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def grouped(sets, percent):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(i) for i in range(len(sets))]


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(4)
    texts = list(ODD) + ["É À x"]
    base = prose(rng, 150).split()
    for rate in (0, 0.004, 0.01, 0.02, 0.04):  # copies that drift away from one text, and chains of copies
        for _ in range(8):
            texts.append(" ".join(w.upper() if rng.random() < 0.1 else "new" + str(rng.random()) if rng.random() < rate else w for w in base))
    chain = list(base)
    for i in range(10):
        chain = [*chain[6:], *prose(rng, 6).split()]
        texts.append(" ".join(chain))
    texts += [prose(rng, 40) for _ in range(10)]
    sets = word_sets(texts)
    for percent in (80, 85):
        want = grouped(sets, percent)
        rows = {r.doc_id: r for r in neardup.near_duplicates(frame(spark, texts), percent).collect()}
        assert [(rows[i].n_shingles, rows[i].component_id, rows[i].kept) for i in range(len(texts))] == [(len(s), w, w == i) for i, (s, w) in enumerate(zip(sets, want))]
    kept = neardup.keep_one(frame(spark, texts), 80)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and sorted(r.doc_id for r in kept.collect()) == sorted(set(grouped(sets, 80)))
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


def test_null_and_repeated_keys_decide_for_no_other_row(spark):
    rng = random.Random(9)
    a, b, c, d, item = (prose(rng, 30) for _ in range(5))
    rows = [(None, a), (None, b), (1, c), (1, c), (2, d), (2, c), (None, d), (None, d + " " + item), (3, a + " " + item), (3, b)]
    df = spark.createDataFrame([(k, t, "en", "x", len(t)) for k, t in rows], SCHEMA)
    name = lambda r: (r[0] is None, r[0] or 0, r[1])
    kept = neardup.keep_one(df, 80)
    assert kept.columns == df.columns
    assert sorted(map(name, kept.collect())) == sorted(map(name, [(None, a), (1, c), (2, d), (3, b), (None, d + " " + item), (3, a + " " + item)]))
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert sorted(map(name, decontaminate.clean(df, bench).collect())) == sorted(map(name, [r for r in rows if item not in r[1]]))


def test_signatures_estimate_similarity(spark):
    a, b = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(200, 1200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    df = spark.createDataFrame([(neardup.packed(neardup.minima(a)).tolist(), neardup.packed(neardup.minima(b)).tolist())], "a array<long>, b array<long>")
    assert abs(df.select(neardup.estimate(df.a, df.b)).first()[0] - 800 / 1200) < 0.2
    assert df.select(neardup.estimate(df.a, df.a)).first()[0] == 1


# -- 2 ---------------------------------------------------------------------------------------------------------------
def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    digits = lambda v: re.sub("[^0-9]", "", v)
    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", lambda v: all(int(p) <= 255 for p in v.split("."))),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", lambda v: 12 <= len(digits(v)) <= 19 and luhn(digits(v))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
    }
    found = [(m.start(), k, m.end(), kind) for k, (kind, (p, ok)) in enumerate(tests.items()) for m in re.finditer(p, text) if ok(m[0])]
    return [f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found)]


PERSONAL = [*ODD, "mail a.b+c@d-e.co.uk, x@y z@w.. or 😀q@r.st!", "ips 1.2.3.4 300.1.1.1 001.002.003.004.5 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 0000000000000", "call +1 (555) 123-4567 or +12 3 +49.30.1234567-8 +1", "a@b.c@d.e", "1" * 3000, "a" * 3000 + "@", "+1" * 200]


def test_base_entities_against_regular_expressions(spark):
    rows = {r.doc_id: r for r in pii.find_personal_data(frame(spark, PERSONAL)).collect()}
    for i, text in enumerate(PERSONAL):
        want = base_spans(text or "")
        assert rows[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert [rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]
        assert set(want) <= set(rows[i].spans.split(",")) | {""}
    assert pii.find_personal_data(frame(spark, [])).count() == 0


def test_patterns_discover_what_seeds_do_not_cover(spark):
    texts = [f"please send it to phone +1 555 12345{i:02d} today" for i in range(30)] + ["please send it to phone 555-867-5309x today", "about 1234567 things"]
    rows = {r.doc_id: r for r in pii.find_personal_data(frame(spark, texts)).collect()}
    assert rows[30].n_phone == 0 and rows[30].n_discovered == 1 and rows[30].spans.startswith("phone:24:")
    assert rows[31].n_discovered == 0
    out = {r.doc_id: r.text for r in pii.redact(frame(spark, [*texts, None])).collect()}
    assert out[0] == "please send it to phone [PHONE] today" and out[30] == "please send it to phone [PHONE] today" and out[32] is None


# -- 3 ---------------------------------------------------------------------------------------------------------------
def page(title, paragraphs):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"<html><head><title>{title}</title><script>var a = '<p>no</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>About</a></li></ul></nav><article><h1>{title}</h1>{body}</article><aside class='sidebar'><p>Related links here</p></aside><footer><p>All rights reserved</p></footer></body></html>"


def test_blocks_decode_and_join(spark):
    got = html.blocks("<div>A &amp;\n B<br>c<p>d <b>e</b><!-- x --><style>p{}</style> f</p></div><p>g &lt;h")
    assert [t for _, t, _ in got] == ["A & B c", "d e f", "g <h"]
    assert html.blocks("") == [] and html.blocks("<p") is not None


def test_silent_elements_end(spark):
    text = lambda h: [t for _, t, _ in html.blocks(h)]
    for name in ("svg-icon", "video-player", "object-x", "title-bar", "select-box", "template-x"):
        assert text(f"<article><{name} a='b'></{name}><p>Whole article text</p></article>") == ["Whole article text"]
    assert text("<html><head><meta charset=x><title>T</title><script>a = '<p>no</p>'</script><p>One</p><p>Two") == ["One", "Two"]
    for name in ("svg", "math", "object", "select", "video", "noscript"):
        assert text(f"<div><p>a</p><{name}><path>x</path><p>b</p></div>c") == ["a", "b", "c"]
        assert text(f"<div>a<{name}>x</div>c") == ["a", "c"]
        assert text(f"<p>a</p><{name}>x<b>y</b></{name}><p>b</p>") == ["a", "b"]
    assert text("<select><option>x<option>y<p>b") == ["b"] and text("<p>a</p><script>x<p>b</p>") == ["a"] and text("<svg><body><p>b") == ["b"]
    assert text("<svg>" * 20_000 + "<p>b") == ["b"]


def test_pages_keep_the_article_only(spark):
    rng = random.Random(2)
    pages = [(i, f"u{i}", page(f"Title {i}", [prose(rng, 30) + "." for _ in range(5)])) for i in range(60)] + [(60, None, None), (61, "u", ""), (61, "u", "")]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, n_chars long")
    rows = html.extract_text(df).collect()
    assert len(rows) == 63
    for r in rows:
        assert r.n_chars == len(r.text) and "Related" not in r.text and "Home" not in r.text and "rights" not in r.text
        if r.page_id < 60:
            assert r.text.split("\n") == [re.sub("<[^>]*>", "", x) for x in re.findall(r"<(?:h1|p)>(.*?)</", pages[r.page_id][2].split("<article>")[1].split("</article>")[0])]
    assert html.extract_text(df.where("false")).count() == 0


def test_a_third_teaches_without_structural_names(spark, monkeypatch):
    taught = []
    monkeypatch.setattr(html.Labeller, "fit", lambda self, data: taught.extend(data) or self)
    rng = random.Random(5)
    made = [page(f"Title {i}", [prose(rng, 12) + "."]).replace("<article>", "<article class='post x7'>") for i in range(60)]
    html.train(spark.createDataFrame(list(enumerate(made)), "page_id long, html string"))
    names = lambda path: tuple("div" if t in ("article", "aside", "nav", "footer") else t for t in path if t not in (".post", ".sidebar"))
    whole = {html.vectors(html.blocks(h)).tobytes(): html.blocks(h) for h in made}
    plain = {html.vectors([(names(p), t, s) for p, t, s in b]).tobytes(): b for b in whole.values()}
    label = lambda b: [html.own_label(p) or 0 for p, _, _ in b]
    first, second = ([(x, y) for x, y in taught if x.tobytes() in known] for known in (whole, plain))
    assert len(first) == 60 and 10 <= len(second) <= 30 and len(taught) == 60 + len(second)
    for known, data in ((whole, first), (plain, second)):
        assert all(y.tolist() == label(known[x.tobytes()]) for x, y in data)


def test_pages_without_structural_elements(spark):
    rng = random.Random(3)
    made = [page(f"Title {i}", [prose(rng, 30) + "." for _ in range(5)]) for i in range(90)]
    plain = [re.sub("<(/?)(?:article|nav|aside|footer)[^>]*>", r"<\1div>", h) for h in made[60:]]
    df = spark.createDataFrame([(i, "u", h, 0) for i, h in enumerate([*made[:60], *plain])], "page_id long, url string, html string, n_chars long")
    rows = {r.page_id: r.text for r in html.extract_text(df).collect()}
    for i in range(60, 90):
        kept = set(rows[i].split("\n"))
        assert kept >= set(re.findall("<p>(.*?)</p>", made[i].split("<article>")[1].split("</article>")[0]))
        assert not kept & {"Home", "About", "Related links here", "All rights reserved"}


# -- 5 ---------------------------------------------------------------------------------------------------------------
def test_counts_against_plain_viterbi(spark):
    rng = random.Random(1)
    vocabulary = {"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 4))): -rng.random() * 9 for _ in range(40)} | {c: -9.5 for c in "abc▁"}
    counting = viterbi.CountingViterbi(list(vocabulary.items()), byte_fallback=False)

    def plain(text):
        best = [(0.0, 0)] + [(float("-inf"), 0)] * len(text)
        for end in range(1, len(text) + 1):
            for at in range(end):
                score = vocabulary.get(text[at:end])
                if score is not None and best[at][0] + score > best[end][0]:
                    best[end] = (best[at][0] + score, best[at][1] + 1)
        return best[len(text)][1]

    for _ in range(300):
        text = "".join(rng.choice("abc▁") for _ in range(rng.randint(0, 25)))
        assert counting.count(text) == plain(text)
    assert counting.count("a?b") == counting.count("a??b") == 3  # a run of unknown characters is one token


def test_count_tokens_of_odd_rows(spark):
    import public_tokenizers

    rows = {r.doc_id: r for r in viterbi.count_tokens(frame(spark, ODD), public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert rows[0].n_tokens == rows[1].n_tokens == 0 and rows[4].n_tokens == rows[5].n_tokens > 0


# -- 7 ---------------------------------------------------------------------------------------------------------------
def test_planted_items_are_found(spark):
    rng = random.Random(3)
    items = [prose(rng, 20) for _ in range(6)] + ["", None, "short"]
    edited = list(items[1])
    for at in (10, 40, 70):
        edited[at] = "#"
    texts = [*ODD, prose(rng, 100) + " " + items[0] + " " + prose(rng, 50), "x " + "".join(edited) + " y", items[2].upper().replace(" ", "\n"), items[3][: len(items[3]) // 2], prose(rng, 3000), items[4] + " " + items[4]]
    bench = spark.createDataFrame([(i, t, "z") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    found = decontaminate.contamination(frame(spark, texts), bench).collect()
    assert sorted({(r.doc_id, r.item_id) for r in found}) == [(6, 0), (7, 1), (8, 2), (11, 4)]
    assert {r.doc_id: r.edits for r in found} == {6: 0, 7: 3, 8: 0, 11: 0} and sum(r.doc_id == 11 for r in found) == 2
    exact = next(r for r in found if r.doc_id == 6)
    assert texts[6][exact.start : exact.end] == items[0]
    kept = decontaminate.clean(frame(spark, texts), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 9, 10]
    assert decontaminate.contamination(frame(spark, []), bench).count() == decontaminate.contamination(frame(spark, texts), bench.where("false")).count() == 0


def test_alignment_against_the_full_table():
    rng = random.Random(9)
    for _ in range(200):
        item = [rng.choice("ab") for _ in range(rng.randint(8, 20))]
        text = [rng.choice("ab") for _ in range(rng.randint(8, 30))]
        rows = [[0] * (len(text) + 1)]
        for i, c in enumerate(item, 1):
            rows.append([i])
            for j, d in enumerate(text, 1):
                rows[i].append(min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (c != d)))
        got = decontaminate.align(np.array([ord(c) for c in item]), np.array([ord(c) for c in text]), 3)
        assert (got is None) == (min(rows[-1]) > 3) and (got is None or got[2] == min(rows[-1]))


# -- 8 ---------------------------------------------------------------------------------------------------------------
def test_quality_learns_from_labels_that_are_not_held_out(spark):
    rng = random.Random(5)
    good = [prose(rng, 120) + "." for _ in range(150)]
    bad = [" ".join(["buy now!!! $$$"] * 40) + prose(rng, 5) for _ in range(150)]
    texts = [t for pair in zip(good, bad) for t in pair] + [None, "", "x" * 200_000]
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(300)] + [(300, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.classify(frame(spark, texts), labels).collect()}
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    held = [i for i in range(300) if rows[i].held_out]
    assert 30 < len(held) < 90 and np.mean([rows[i].predicted == 1 - i % 2 for i in held]) > 0.95
    none = quality.classify(frame(spark, texts), labels.where("false")).collect()
    assert {round(r.score, 6) for r in none} == {0.5}
    assert quality.classify(frame(spark, []), labels).count() == 0


# -- 10 --------------------------------------------------------------------------------------------------------------
def test_fingerprints_against_plain_python(spark):
    rng = random.Random(6)
    texts = [*ODD, prose(rng, 300), prose(rng, 5000), "aaaa" * 100, "é😀" * 50, prose(rng, 20)]
    rows = {r.doc_id: r for r in fingerprint.fingerprint_documents(frame(spark, texts)).collect()}
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        after = plain[i - 1]  # the next lower id; after the lowest the highest
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert rows[i].near_next == pytest.approx(fingerprint.likeness(rows[i].fingerprint, rows[i - 1 if i else len(plain) - 1].fingerprint))
    assert rows[4].fingerprint == rows[5].fingerprint and rows[0].fingerprint == rows[1].fingerprint == ""
    assert rows[7].near_edited > 0.25 > rows[7].near_next
    assert fingerprint.fingerprint_documents(frame(spark, [])).count() == 0


def test_entropy_of_windows():
    data = np.frombuffer(bytes(random.Random(7).choices(range(6), k=200)), np.uint8)
    for at, got in enumerate(fingerprint.entropy_bins(data)):
        n = np.bincount(data[at : at + fingerprint.WINDOW])
        p = n[n > 0] / fingerprint.WINDOW
        assert abs(got / fingerprint.BINS - float(-(p * np.log2(p)).sum()) / 4) < 0.003


# -- pipeline --------------------------------------------------------------------------------------------------------
def test_pipeline_stages_keep_the_columns(spark, tmp_path):
    rng = random.Random(8)
    good = [prose(rng, 90) + "." for _ in range(60)]
    item = prose(rng, 25)
    texts = [*good, good[0] + " extra", good[1] + " " + item, good[2], *[" ".join(["win cash!!!"] * 60)] * 40, None]
    docs = frame(spark, [t if i % 7 else t for i, t in enumerate(texts)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, int(i < 63), 0) for i in range(103)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, str(tmp_path))
        assert seen.columns == docs.columns, name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert 61 not in ids and 60 not in ids and 62 not in ids and set(range(60)) <= ids and not ids & set(range(63, 103))
