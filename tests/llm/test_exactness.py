"""Operators against slower, plainer ways to the same results, and the rows that are odd in other ways."""

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from emberline.llm import decontaminate, fingerprint, html, neardup, pii, quality, tokenfile, treebpe, viterbi

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


# -- 5: against the library's unigram model over the same pieces -----------------------------------------------------------
@pytest.fixture(scope="module")
def unigram():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    return Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=" ▁\t\nabetin.é漢龘😀", max_size=80) | st.text(max_size=40).filter(lambda t: "<" not in t))
def test_counts_equal_the_library(unigram, text):
    assert viterbi.counter(PIECES).of_text(text) == (len(unigram.encode("▁" + text.replace(" ", "▁")).ids) if text else 0)


def test_counts_equal_the_library_on_documents(spark, unigram):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in viterbi.count_tokens(docs, PIECES).collect()}
    assert got == {r.doc_id: len(unigram.encode("▁" + r.text.replace(" ", "▁")).ids) if r.text else 0 for r in docs.collect()}


def test_long_stretches_and_pieces_that_are_no_text():
    counting = viterbi.counter(PIECES)
    short, viterbi.SHORT = viterbi.SHORT, 1
    try:
        few = [counting.count(t) for t in ("▁hello", "x龘龘y", "▁▁▁▁▁a")]
    finally:
        viterbi.SHORT = short
    assert few == [counting.count(t) for t in ("▁hello", "x龘龘y", "▁▁▁▁▁a")]
    assert counting.of_text("<s>") > 1 and counting.of_text("<0x41>") > 1
    assert counting.count("ab" * 100_000) == counting.count("ab" * 1000) * 100


# -- 2: identifiers that no base pattern sees -------------------------------------------------------------------------------
def luhn_card(rng):
    body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(body + x for x in "0123456789" if sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(body + x))) % 10 == 0)


def test_discovery_on_planted_identifiers(spark):
    rng = random.Random(3)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    cues = {"phone": ["call me at", "my phone is", "reach us under"], "email": ["write to", "mail goes to", "contact address is"], "ip": ["host runs on", "connect to server", "blocked address"], "card": ["charge card number", "paid with card", "visa ending"]}
    seen = {"phone": lambda: f"+1 {d(3)} {d(7)}", "email": lambda: f"{prose(rng, 1)}{d(2)}@{prose(rng, 1)}.com", "ip": lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), "card": lambda: luhn_card(rng)}
    unseen = {"phone": lambda: f"({d(3)}) {d(3)} {d(4)}", "email": lambda: f"{prose(rng, 1)}{d(2)}(at){prose(rng, 1)}.com", "ip": lambda: f"fe80::{d(4)}:{d(3)}", "card": lambda: f"4{d(3)}-XXXX-XXXX-{d(4)}"}
    rows, want = [], set()
    for i in range(1200):
        parts = [prose(rng, rng.randint(5, 40))]
        for _ in range(rng.randint(0, 3)):
            kind = rng.choice(sorted(cues))
            cue, u = rng.choice(cues[kind]), rng.random()
            value = seen[kind]() if u < 0.6 else unseen[kind]() if u < 0.75 else rng.choice([d(4), f"{d(1)}.{d(1)}.{d(2)}", f"{d(2)} of {d(3)}", d(12)])
            if u >= 0.75:
                cue = rng.choice(["in the year", "about", "room number", "version"])
            at = len(" ".join([*parts, cue])) + 1
            if 0.6 <= u < 0.75:
                want.add((i, kind, at, at + len(value)))
            parts += [cue, value, prose(rng, rng.randint(1, 30))]
        rows.append((i, " ".join(parts), "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_id string")
    got = pii.find_personal_data(docs).collect()
    spans = {(r.doc_id, k, int(a), int(b)) for r in got for k, a, b in (s.split(":") for s in r.spans.split(",") if s)}
    found = sum(r.n_discovered for r in got)
    assert len(want & spans) >= 0.9 * len(want) and len(want & spans) >= 0.9 * found
    # what is redacted is what is listed, discovered spans too
    texts = {i: text for i, text, _ in rows}
    for r in got:
        out, at = "", 0
        for kind, a, b in sorted((s.split(":") for s in r.spans.split(",") if s), key=lambda s: int(s[1])):
            if int(a) >= at:
                out += texts[r.doc_id][at : int(a)] + f"[{kind.upper()}]"
            at = max(at, int(b))
        texts[r.doc_id] = out + texts[r.doc_id][at:]
    odd = docs.unionByName(docs.where("doc_id < 3")).unionByName(spark.createDataFrame([(None, None, None), (7, "", "")], docs.schema))
    again = pii.redact(odd)
    assert again.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in again.collect()) == sorted([*((str(i), t) for i, t in texts.items()), *((str(i), texts[i]) for i in range(3)), ("None", "None"), ("7", "")])


def test_masks_and_sums_over_many_spans(spark):
    text = "".join(f"x{i}@y.com, 1.2.3.{i % 256}\n" for i in range(3000)) + "end"
    docs = spark.createDataFrame([(1, text, "k"), (1, text, "k"), (None, "a@b.cc", None)], "doc_id long, text string, _new string")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert sorted(r.text for r in out.collect()) == sorted(["[EMAIL], [IP]\n" * 3000 + "end"] * 2 + ["[EMAIL]"])
    big = pii.find_personal_data(docs).where("doc_id = 1").first()
    spans = big.spans.split(",")
    assert big.n_email == big.n_ip == 3000 and all(text[int(a) : int(b)].startswith("x" if k == "email" else "1.2.3.") for k, a, b in (s.split(":") for s in spans))
    edge = spark.createDataFrame([("abcdef", [("ip", 1, 4), ("card", 2, 3), ("phone", 3, 5)]), ("abc", []), ("abc", [("ip", 0, 3)])], "t string, f array<struct<kind:string,start:int,end:int>>")
    assert [r[0] for r in edge.select(pii.masked(edge.t, edge.f)).collect()] == ["a[IP]f", "abc", "[IP]"]


# -- 7: the whole search against the full table of edits ---------------------------------------------------------------------
def least_edits(item, text):
    a, b = decontaminate.characters(item.strip()), decontaminate.characters(text)
    before = [0] * (len(b) + 1)
    for i, c in enumerate(a, 1):
        now = [i]
        for j, x in enumerate(b, 1):
            now.append(min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (c != x)))
        before = now
    return min(before)


@pytest.mark.parametrize("together, hits", [(1 << 17, 1 << 20), (16, 5)])
def test_search_against_brute_force(monkeypatch, together, hits):
    monkeypatch.setattr(decontaminate, "TOGETHER", together)
    monkeypatch.setattr(decontaminate, "HITS", hits)
    rng = random.Random(5)
    for _ in range(60):
        items = [(i, "".join(rng.choice("ab c") for _ in range(rng.choice([1, 2, 5, 7, 8, 11, 13, 14, 15, 20, 26, 40])))) for i in range(4)]
        texts = []
        for _ in range(4):
            x = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(x) + 1)
                x[k : k + rng.randint(0, 1)] = rng.choice(["", "z"])
            texts.append("".join(rng.choice("ab c") for _ in range(rng.randint(0, 60))) + "".join(x) + "".join(rng.choice("ab c") for _ in range(rng.randint(0, 30))))
        for text, got in zip(texts, decontaminate.Items(items).find(texts)):
            best = {}
            for item, start, end, edits in got:
                best[item] = min(best.get(item, 99), edits)
            want = {i: least_edits(x, text) for i, x in items if x.strip()}
            assert best == {i: w for i, w in want.items() if w <= int(decontaminate.EDITS * len(items[i][1].strip()))}


def test_short_items_and_full_budgets(spark):
    bench = spark.createDataFrame([(0, "short"), (1, "abcdefghijklmn"), (2, " \n"), (3, None)], "item_id long, text string")
    docs = spark.createDataFrame([(0, "a Short\ttext"), (1, "x abcdefgXijklmn y"), (None, None), (2, "s h o r t")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.edits) for r in decontaminate.contamination(docs, bench).collect()) == [(0, 0, 0), (1, 1, 1)]


# -- 6 ------------------------------------------------------------------------------------------------------------------------
def test_files_keep_null_and_negative_keys(spark, tmp_path):
    rows = [(-3, "b"), (None, "a b"), (-1, ""), (7, "z"), (7, "hello there"), (7, "z"), (None, None), (2**40, "x y")]
    library = Tokenizer.from_file(WORDS)
    tokenfile.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, str(tmp_path / "f"), file_ids=4)
    got = tokenfile.read_tokens(spark, str(tmp_path / "f"), outputs=True).orderBy("start").collect()
    name = lambda k, ids: (k is not None, k or 0, ids)
    want = sorted(name(k, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for k, t in rows)
    assert sorted(name(r.doc_id, r.ids) for r in got) == want
    assert [name(r.doc_id, 0)[:2] for r in got] == [w[:2] for w in want]
    stream = [i for r in got for i in r.ids]
    assert [r.start for r in got] == [sum(len(x.ids) for x in got[:i]) for i in range(len(got))]
    asked = spark.createDataFrame([(i,) for i in range(-2, len(stream) + 2)] + [(None,), (3,)], "position long")
    assert {r.position: r.token for r in tokenfile.tokens_at(spark, str(tmp_path / "f"), asked).collect()} == dict(enumerate(stream))


# -- 3 ------------------------------------------------------------------------------------------------------------------------
def test_gradients_of_the_labeller():
    rng = np.random.default_rng(1)
    net = html.Labeller()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, mask = html.pad([rng.normal(0, 1, (n, html.PATH + html.WORDS + html.OTHER)).astype(np.float32) for n in (4, 2)])
    y = np.array([[1, 0, 1, 0], [0, 1, -1, -1]], np.float64)
    loss = lambda: -sum(math.log(p if t else 1 - p) for p, t in zip(net.forward(x, mask)[0].ravel(), y.ravel()) if t >= 0)
    p, both, kf, kb = net.forward(x, mask)
    d = np.where(y >= 0, p - y, 0)
    grads = {k: np.zeros_like(v) for k, v in net.w.items()}
    dout = d[:, :, None] * net.w["o"]
    net._back("f", x, mask, dout[:, :, : html.STATES], kf, grads)
    net._back("b", x, mask, dout[:, :, html.STATES :], kb, grads)
    for k in ("fx", "fh", "fb", "bx", "bh", "bb"):
        flat = net.w[k].reshape(-1)
        for at in rng.integers(0, flat.size, 6):
            old, step = flat[at], 1e-3
            flat[at] = old + step
            up = loss()
            flat[at] = old - step
            slope = (up - loss()) / (2 * step)
            flat[at] = old
            assert grads[k].reshape(-1)[at] == pytest.approx(slope, rel=2e-2, abs=2e-3)


def test_paths_stay_short():
    found = html.blocks("<div class='a b'>" * 5000 + "x" + "<p>y</p>" * 100 + "</div>" * 5000 + "<p>z")
    assert [t for _, t, _ in found] == ["x", *["y"] * 100, "z"] and max(len(p) for p, _, _ in found) <= 3 * html.DEPTH and found[-1][0] == ("p",)


# -- 8 ------------------------------------------------------------------------------------------------------------------------
def test_running_attention_equals_the_direct_one(monkeypatch):
    rng = random.Random(2)
    texts = [prose(rng, n).encode() for n in (3, 500, 4000)] + [b"", b"ab"]
    model = quality.fit(np.zeros(0, np.int64), np.zeros((0, quality.BUCKETS), np.uint8), np.zeros(0, np.float32))
    monkeypatch.setattr(quality, "SLAB", 3)
    for text, got in zip(texts, model.scores(texts)):
        parts = [c for _, c in quality.slabs([text])]
        logit = model.out0[0]
        if parts:
            h, _, _, e = model.passages(quality.vectors(np.concatenate(parts)))
            a = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
            logit = logit + (a @ h) @ model.out
        assert got == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-4)


# -- 10 -----------------------------------------------------------------------------------------------------------------------
def plain_digest(text, ranks):
    """Features and filters step by step, from entropies counted window by window."""
    w, s = fingerprint.WINDOW, fingerprint.SPAN
    if len(text) < w:
        return None
    bins = []
    for i in range(len(text) - w + 1):
        total = sum(fingerprint._G[n] for n in Counter(text[i : i + w]).values())
        bins.append(int((fingerprint._G[w] - total) * fingerprint.BINS // fingerprint._G[w]))
    keys = [(int(ranks[b]), i) for i, b in enumerate(bins)]
    wins = Counter(min(keys[max(0, a) : a + s])[1] for a in range(-s + 1, len(keys)))
    chosen = [i for i in range(len(keys)) if wins[i] >= fingerprint.POPULAR and keys[i][0] <= fingerprint.BINS] or [0]
    hashes, held = [], set()
    for i in chosen:
        h = int(fingerprint._hash(np.frombuffer(text[i : i + w], np.uint8)[None, :])[0])
        if h not in held:
            held.add(h)
            hashes.append(h)
    out = []
    for i in range(0, len(hashes), fingerprint.PER_FILTER):
        bits = 0
        for h in hashes[i : i + fingerprint.PER_FILTER]:
            for k in range(5):
                bits |= 1 << (fingerprint.BITS - 1 - ((h >> (11 * k)) & (fingerprint.BITS - 1)))
        out.append(f"{bits:0{fingerprint.BITS // 4}x}")
    return ":".join(out)


def test_digests_step_by_step():
    rng = random.Random(4)
    texts = [prose(rng, n).encode() for n in (10, 200, 3000)] + ["é😀ü".encode() * 30, b"aaaa" * 40, prose(rng, 3).encode()[:16]]
    ranks = fingerprint.ranks_of(fingerprint.count_bins(texts))
    assert fingerprint.digests(texts, ranks) == [plain_digest(t, ranks) for t in texts]
    assert fingerprint.likeness(plain_digest(texts[0], ranks), "0" * 512) == 0
    one, two = 0b1111 << 2044, 0b110 << 2044  # four bits and two of them, of 2,048
    chance = 4 * 2 / 2048
    assert fingerprint.likeness(f"{one:0512x}", f"{two:0512x}") == pytest.approx((2 - chance) / (2 - chance))


# -- null, negative and repeated keys, clashing names --------------------------------------------------------------------------
def test_keys_of_any_kind(spark):
    docs = spark.createDataFrame([(None, "one two three four five six", 1, "a"), (-4, "one two three four five six", 2, "b"), (-4, "other words stand here now", 3, "c"), (None, None, 4, "d")], "doc_id long, text string, component_id long, _text string")
    groups = [(r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()]
    assert sorted(groups, key=repr) == sorted([(None, 2, -4), (-4, 2, -4), (-4, 1, -4), (None, 0, None)], key=repr)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.keep_good(docs, labels).columns == docs.columns
    for out in (viterbi.count_tokens(docs, PIECES), treebpe.encode_documents(docs, WORDS), fingerprint.fingerprint_documents(docs), quality.classify(docs, labels)):
        assert sorted((r.doc_id for r in out.collect()), key=repr) == [-4, -4, None, None]
