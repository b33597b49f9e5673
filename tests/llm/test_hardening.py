"""Hot keys, depth, many blocks, empty tables and odd rows; the arithmetic of operators 2 and 8 in plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from emberline.llm import decontaminate, html, neardup, pii, quality
from emberline.operators import common

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


# -- 1 ---------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("percent", [80, 85])
def test_groups_in_small_tiles_and_runs(spark, monkeypatch, percent):
    """Copies that drift apart from one text, so that buckets hold several groups; the result doesn't hang on how they are dealt."""
    rng = random.Random(12)
    base = prose(rng, 120).split()
    texts = []
    for rate in (0, 0.005, 0.01, 0.02, 0.03):
        texts += [" ".join(w if rng.random() > rate else "new" + str(rng.random()) for w in base) for _ in range(12)]
    want = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, texts), percent).collect()}
    monkeypatch.setattr(neardup, "_TILE", 5)
    monkeypatch.setattr(neardup, "_DEALT", 3)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, texts), percent).collect()} == want
    sets = [set(neardup.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert want == dict(enumerate(root)) and len(set(root)) > 1


def test_rows_alike_in_key_and_text_are_told_by_their_other_columns(spark):
    text = prose(random.Random(1), 30)
    rows = [(1, text, "en", s, 5) for s in ("a", "b", "c")]
    kept = {neardup.keep_one(spark.createDataFrame(rows[k:] + rows[:k], SCHEMA).repartition(3)).first().source for k in range(3)}
    assert len(kept) == 1


# -- 2 ---------------------------------------------------------------------------------------------------------------
def plain_scores(edges, rounds, confident, support, weak):
    """The graph's scores by loops over dictionaries."""
    edge = {}
    for p, v, kind in edges:
        edge[p, v] = max(filter(None, (edge.get((p, v)), kind)), default=None)
    size = Counter(p for p, _ in edge)
    seeds = [(p, v, k, 1.0) for (p, v), k in edge.items() if k]
    known, patterns = seeds, {}
    for i in range(rounds):
        total, sure = Counter(), Counter()
        for p, _, k, c in known:
            total[p, k] += c
            sure[p, k] += c >= confident
        patterns = {pk: total[pk] / size[pk[0]] for pk in total if sure[pk] >= support}
        if i + 1 == rounds:
            break
        lifted = [(p, v, k, -30.0 if c >= 1 else math.log(1 - c)) for (p, v), kind in edge.items() if kind is None for (q, k), c in patterns.items() if q == p and c >= weak]
        doubt = Counter()
        for _, v, k, d in lifted:
            doubt[v, k] += d
        best = {}
        for p, v, k, d in lifted:
            best[p, v] = max(best.get((p, v), (-1.0, "")), (min(1 - math.exp(min(doubt[v, k] - d, 0.0)), 0.999), k))
        certain = {}
        for (v, k), d in doubt.items():
            c = 1 - math.exp(d)
            if c >= confident:
                certain[v] = max(certain.get(v, (-1.0, "")), (c, k))
        named = {p for p, _ in patterns}
        known = seeds + [(p, v, k, c) for (p, v), (c, k) in best.items()]
        known += [(p, v, certain[v][1], min(certain[v][0], 0.999)) for (p, v), kind in edge.items() if kind is None and p not in named and v in certain]
    return {pk: c for pk, c in patterns.items() if c >= confident}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pattern_scores_in_plain_python(spark, seed):
    rng = random.Random(seed)
    edges = []
    for v in range(60):
        kind = rng.choice([None, None, "email", "phone"])
        home = {"email": range(0, 6), "phone": range(4, 9)}.get(kind, range(0, 14))
        edges += [(f"p{rng.choice(home)}", f"v{v}", kind) for _ in range(rng.randint(1, 5))]
    edges += [("p0", f"hot{i}", None) for i in range(rng.choice([0, 2]))]
    df = spark.createDataFrame(edges, "p string, value string, kind string")
    options = {"rounds": 3, "confident": 0.5, "support": 2}
    got = {(r.p, r.kind): r.confidence for r in pii.score_patterns(df, **options).collect()}
    want = plain_scores(edges, **options, weak=pii.WEAK)
    assert set(got) == set(want) and want and all(got[k] == pytest.approx(want[k]) for k in want)


# -- 3 ---------------------------------------------------------------------------------------------------------------
def test_paths_are_true_at_any_depth():
    """Menus deeper than a path is long, all ended properly, are in no later block's path."""
    deep = "<nav>" + "<div>" * 255 + "".join(f"<p>menu {i}" for i in range(1000)) + "</div>" * 255 + "</nav>"
    found = html.blocks(f"<body>{deep}<article><div><p>The text.</p></div></article></body>")
    assert found[-1][:2] == (("body", "article", "div", "p"), "The text.") and html.own_label(found[-1][0]) == 1
    assert all("nav" in path for path, _, _ in found[:-1]) and len(found) == 1001
    nested = "<div>" * 30_000 + "x" + "</b></i>" * 30_000 + "</div>" * 30_000 + "<p>y</p>" + "<b>" * 30_000 + "z</u>" * 3
    assert [t for _, t, _ in html.blocks(nested)] == ["x", "y", "zzz"]


def layout(rng):
    """A page of plain ``div``s with class names that no list has, and the blocks that are its article."""
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(200)]
    line = lambda n: " ".join(rng.choices(words, k=n)).capitalize()
    text = lambda n: " ".join(line(rng.randint(6, 18)) + "." for _ in range(n))
    kept, body = [], []
    for _ in range(rng.randint(4, 12)):
        kept.append(text(rng.randint(3, 7)))
        body.append(f"<p>{kept[-1]}</p>")
    links = lambda n: "".join(f'<div><a href="/{k}">{line(4)}</a></div>' for k in range(n))
    column, article = f'<div class="spalte">{links(5)}</div>', f'<div class="rahmen">{"".join(body)}</div>'
    middle = article + column if rng.random() < 0.5 else column + article
    return f'<html><body><div class="kopf">{links(6)}</div>{middle}<div class="fuss"><div>Copyright {line(3)}</div>{links(2)}</div></body></html>', kept


def test_pages_unlike_those_that_teach(spark):
    """Paragraphs of pages that mark nothing are found among links and notices."""
    rng = random.Random(1)
    planted = [layout(rng) for _ in range(40)]
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    teach = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    mine = spark.createDataFrame([(10**7 + i, "u", h) for i, (h, _) in enumerate(planted)], pages.schema)
    got = {r.page_id: r.text.split("\n") for r in html.extract_text(teach.unionByName(mine)).where(F.col("page_id") >= 10**7).collect()}
    right = wrong = lost = 0
    for i, (_, kept) in enumerate(planted):
        a, b = Counter(got[10**7 + i]), Counter(kept)
        right, wrong, lost = right + sum((a & b).values()), wrong + sum((a - b).values()), lost + sum((b - a).values())
    assert right / (right + lost) > 0.97 and right / (right + wrong) > 0.8  # some lines of the footer stay


# -- 7 ---------------------------------------------------------------------------------------------------------------
def test_many_blocks_find_what_one_does(spark, monkeypatch):
    rng = random.Random(3)
    items = [prose(rng, n) for n in (2, 5, 12, 30, 30, 60)] + [None, "  ", "ab"]
    texts = [None, "", prose(rng, 200)]
    for k in range(25):
        words = rng.choice(items[:6]).split()
        words[rng.randrange(len(words))] = "x"
        texts.append(" ".join([prose(rng, 20), *words, prose(rng, rng.randint(1, 50)), rng.choice(items[:6])]))
    bench = spark.createDataFrame([(i if i != 3 else None, t, 1) for i, t in enumerate(items)], "item_id long, text string, doc_id int")
    docs = frame(spark, texts)
    rows = lambda df: sorted(map(repr, df.collect()))
    want = rows(decontaminate.contamination(docs, bench))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 120)
    monkeypatch.setattr(decontaminate, "PASS_CHARS", 900)
    assert rows(decontaminate.contamination(docs, bench)) == want and len(want) > 25


# -- 8 ---------------------------------------------------------------------------------------------------------------
def test_first_step_goes_down_the_slope():
    """Adam's first step is the sign of the gradient: held against differences of the loss, in double precision."""
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 5, 12)
    owner = np.repeat(np.arange(12), sizes)
    counts = rng.integers(0, 4, (len(owner), quality.BUCKETS)).astype(np.uint8) * (rng.random((len(owner), quality.BUCKETS)) < 0.05)
    labels = (np.arange(12) % 2).astype(np.float32)
    start, after = (quality.fit(owner, counts, labels, epochs=e, batch=99) for e in (0, 1))
    x = quality.vectors(counts.astype(np.float32)).astype(float)
    at = np.cumsum(sizes) - sizes

    def loss(m):
        h, _, _, e = m.passages(x)
        a = np.exp(e - np.maximum.reduceat(e, at)[owner])
        a /= np.add.reduceat(a, at)[owner]
        z = np.add.reduceat(a[:, None] * h, at) @ m.out + m.out0[0]
        return float(np.mean(np.logaddexp(0, z) - labels * z) + 5e-5 * ((m.enc**2).sum() + (m.out**2).sum()))

    checked = 0
    for name in start.__dataclass_fields__:
        moved = getattr(after, name).astype(float) - getattr(start, name)
        for k in rng.choice(moved.size, min(moved.size, 25), replace=False):
            ends = []
            for d in (1e-5, -1e-5):
                m = quality.Model(*(getattr(start, n).astype(float).copy() for n in start.__dataclass_fields__))
                getattr(m, name).ravel()[k] += d
                ends.append(loss(m))
            slope = (ends[0] - ends[1]) / 2e-5
            if abs(slope) > 1e-5:
                assert moved.ravel()[k] * slope < 0, (name, k)
                checked += 1
    assert checked > 40


# -- the pipeline ----------------------------------------------------------------------------------------------------
def tables(spark, folder, docs, labels, bench):
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{folder}/{name}.parquet")


def test_pipeline_of_empty_tables_and_odd_rows(spark, tmp_path):
    labels, bench = "doc_id long, quality int, toxic int", "item_id long, text string"
    tables(spark, tmp_path / "none", frame(spark, []), spark.createDataFrame([], labels), spark.createDataFrame([], bench))
    before = common.cuts_made()
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
    assert common.cuts_made() == before + 1  # only the result's table is left
    rng = random.Random(2)
    a, b, item = prose(rng, 60), prose(rng, 60), prose(rng, 20)
    rows = [(None, a), (None, b), (1, a), (1, a), (2, None), (3, ""), (4, b + " " + item), (5, prose(rng, 3000)), (None, None)]
    docs = spark.createDataFrame([(k, t, None, None, None, 7) for k, t in rows], SCHEMA + ", _row int")
    tables(spark, tmp_path / "odd", docs, spark.createDataFrame([(1, None, 0), (None, 1, 0)], labels), spark.createDataFrame([(1, item), (None, None)], bench))
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    # a's three rows are one, b is one, null and empty texts are nobody's copies, the item's document goes
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in got) == [-1, -1, 1, 2, 3, 5]
    assert sum(r.n_tokens > 0 for r in got) == 3
