"""Operators 11, 12 and 13 against brute force, on small fixtures with odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from emberline.llm import conversation, simhash, whitening

TALK = "conv_id long, turn long, role string, text string"


# -- 11 --------------------------------------------------------------------------------------------------------------
def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def faults_of(rows):
    out, seen = [], set()
    for role, text in rows:
        m = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("B" if not m else "D" if (role, text) in seen else "T" if m[-1] not in ".!?" else ".")
        seen.add((role, text))
    return out


def least(rows, faults):
    """Every edit of every row, and up to two rows put in before each and at the end: the least (cost, audit) and its result."""
    best = None
    gap = ["", "I", "II"]
    n = len(rows)
    for edits in itertools.product("KRD", repeat=n):
        if any(f in "BD" and e != "D" for e, f in zip(edits, faults)):
            continue
        for holes in itertools.product(range(3), repeat=n + 1):
            audit = "".join(gap[h] + e for h, e in zip(holes, edits)) + gap[holes[-1]]
            cost = sum({"K": 0, "R": 1, "D": 2, "I": 5}[e] for e in audit) + sum(5 for e, f in zip(edits, faults) if f == "T" and e != "D")
            if best is not None and (cost, audit) >= best[:2]:
                continue
            left, at = [], 0
            for e in audit:
                if e in "KR":
                    left.append((rows[at][0] if e == "K" else None, rows[at][1]))
                elif e == "I":
                    left.append((None, ""))
                at += e != "I"
            shape = "s" * (len(left) % 2) + "ua" * (len(left) // 2) if len(left) != 1 else "x"
            if all((r is None and want in "ua") or (r or "")[:1] == want for (r, _), want in zip(left, shape)):
                text = "\n".join(f"{r or {'u': 'user', 'a': 'assistant'}[want]}:{t}" for (r, t), want in zip(left, shape))
                best = (cost, audit, text)
    return best


def wanted(rows):
    out = {}
    held = damaged(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in held if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        turns = {r[1] for r in mine if r[1] is not None}
        pairs = [(r[2], r[3]) for r in mine]
        faults = faults_of(pairs)
        initials = [p[0][:1] for p in pairs]
        cost, audit, text = least(pairs, faults)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("B"), faults.count("D"), faults.count("T"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in rows}


def talks(rng, count, most=4):
    rows = []
    for conv in range(count):
        turn = 0
        for _ in range(rng.randint(1, most)):
            turn += rng.choice([1, 1, 1, 2, 5])
            rows.append((conv, turn, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "User"]), rng.choice(["Yes.", "No!", "Why?", "so it", "", " \n", None, "Done. ", "é."])))
    return rows


def test_repair_against_every_edit(spark):
    rows = talks(random.Random(3), 70) + [(None, 1, "user", "Hm."), (None, None, "assistant", "Oh."), (900, None, "user", "A."), (900, None, "user", "A.")]
    table = spark.createDataFrame([(*r, 1) for r in rows], TALK + ", blank int")
    assert got(conversation.repair_damaged(table.repartition(3))) == wanted(rows)


def test_repair_in_segments_is_the_same(spark):
    """Segments of two rows, and turns that several segments share."""
    rng = random.Random(8)
    rows = talks(rng, 25) + [(77, t // 2, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "No.", "so", f"{t}."])) for t in range(4)]
    held = [(c, t, r or " ", x or " ") for c, t, r, x in rows if x != ""]
    table = spark.createDataFrame(held, "conv long, turn long, role string, text string")
    found = table.repartition(1).sortWithinPartitions("conv", "turn", "role", "text").rdd.map(tuple).collect()
    parts, sizes = [], {}
    for c, t, r, x in found:
        k = sizes[c] = sizes.get(c, -1) + 1
        parts.append((c, c << 8 | k // 2, k % 2, t, r, x))
    segments = spark.createDataFrame(parts, "conv long, segment long, place int, turn long, role string, text string")
    for row in conversation._long(segments).collect():
        mine = [(r, x) for c, t, r, x in found if c == row["conv"]]
        cost, audit, text = least(mine, faults_of(mine))
        assert (row["cost"], row["audit"], row["repaired_sha256"]) == (cost, audit, hashlib.sha256(text.encode()).hexdigest())


def test_one_conversation_of_most_rows(spark):
    """A conversation of thousands of rows, over many tasks, equals the same rows parsed at once."""
    rng = random.Random(5)
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "so", "", f"{i}.", f"{i}!", f"Well {i % 40}."])) for i in range(3000)]
    rows += [(2, 1, "user", "A?"), (2, 2, "assistant", "B."), (3, 5, "user", "dropped")]
    table = spark.createDataFrame(rows, "conv long, turn long, role string, text string").withColumn("text", F.when(F.col("conv") != 3, F.col("text")))
    found = {r["conv"]: r for r in conversation.repair_conversations(table).collect()}
    want = conversation._whole(rows[:3000])
    assert {c: found[1][c] for c in want} == want
    assert (found[2]["cost"], found[2]["audit"]) == (0, "KK")
    assert (found[3]["cost"], found[3]["audit"], found[3]["gaps"], found[3]["repaired_sha256"]) == (0, "", 0, hashlib.sha256(b"").hexdigest())


def test_repair_of_an_empty_table(spark):
    assert conversation.repair_damaged(spark.createDataFrame([], TALK)).collect() == []


# -- 12 --------------------------------------------------------------------------------------------------------------
def test_eigen_against_numpy():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 40):
        for rank in {1, n}:
            a = rng.normal(size=(n, rank))
            v = a @ a.T
            values, vectors = whitening.eigen(v)
            assert np.allclose(values, np.linalg.eigvalsh(v)[::-1], atol=1e-12 * np.abs(v).max() * n)
            assert np.allclose(vectors @ vectors.T, np.eye(n), atol=1e-12)
            assert np.allclose(v @ vectors.T, vectors.T * values, atol=1e-11 * np.abs(v).max() * n)


def test_parallel_formula():
    rng = np.random.default_rng(1)
    x = rng.integers(-500, 900, (301, 5))
    parts = [whitening.Spread(5) for _ in range(4)]
    for i, row in enumerate(x):
        parts[i % 3].add(row.astype(float))
    total = whitening.Spread(5)
    for p in parts:
        total.merge(p)
    assert total.n == 301 and np.allclose(total.covariance(), np.cov(x.T, bias=True), rtol=1e-12)


VECTORS = "vec_id long, embedding array<float>, component int"


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(2)
    base = (rng.normal(size=(200, 6)) * [3, 2, 1, 0.5, 0.2, 0.1]).astype(np.float32)
    rows = [(i, [float(v) for v in x], 1) for i, x in enumerate(base)] + [(1000 + i, [float(v) for v in base[7]], 1) for i in range(90)]
    odd = [(2001, None, 1), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2003, [float("nan")] * 6, 1), (2004, [float("inf")] + [0.0] * 5, 1), (2005, [], 1), (2006, [3e38] + [0.0] * 5, 1)]
    rows.append((None, [float(v) for v in base[9]], 1))
    out = whitening.whiten(spark.createDataFrame(rows + odd, VECTORS).repartition(7)).collect()
    x = {k: np.floor(256 * np.array(v, float)).astype(np.int64) for k, v, _ in rows}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, sums = len(fit), fit.sum(0)
    v = np.cov(fit.T, bias=True)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors.T[::-1]
    assert len(out) == 4 * len(rows)
    signs = {}
    for r in out:
        k, held = r["component"] - 1, x[r["vec_id"]]
        want = (held - sums / n) @ vectors[k] / values[k] ** 0.5
        if abs(want) > 1e-6:
            assert signs.setdefault(k, np.sign(want * r["whitened"])) == np.sign(want * r["whitened"])
        assert abs(abs(want) - abs(r["whitened"])) < 1e-9
        assert r["n"] == n and r["deviation"] == int(((n * held - sums) ** 2).sum())
        assert abs(r["explained"] - values[k] / np.trace(v)) < 1e-12 and r["identity_error"] < 1e-10


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    alike = whitening.whiten(spark.createDataFrame([(i, [0.5, 0.25], 1) for i in range(3)], VECTORS)).collect()
    assert len(alike) == 6 and all(r["whitened"] is None and r["deviation"] == 0 and r["n"] == 1 and r["explained"] == 0 for r in alike)
    mixed = [(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [5.0], 1), (4, [7.0], 1), (5, [1e15, 0.0, 0.0], 1), (6, [0.0, 0.0, 0.0], 1)]
    found = whitening.whiten(spark.createDataFrame(mixed, VECTORS)).collect()
    by = {(r["vec_id"], r["component"]): r for r in found}
    assert by[3, 1]["n"] == 2 and abs(abs(by[3, 1]["whitened"]) - 1) < 1e-12 and by[3, 1]["deviation"] == 512 * 512
    assert by[1, 2]["whitened"] is None and abs(by[1, 1]["explained"] - 1) < 1e-12  # two points lie on a line
    assert by[5, 1]["deviation"] is None  # beyond a long
    with pytest.raises(Exception, match="lengths"):
        whitening.whiten(spark.createDataFrame([(i, [1.0] * i, 1) for i in range(1, 70)], VECTORS)).collect()


# -- 13 --------------------------------------------------------------------------------------------------------------
def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def groups(values):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= 4:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(values))]


def test_simhash_of_texts(monkeypatch):
    rng = random.Random(1)
    texts = [None, "", " \n\t ", "One TWO", "É a B c d e", "a b c d", "x " * 5000] + [" ".join(rng.choices("abcdefg hij klm".split(), k=k)) for k in (3, 4, 5, 300)]
    for t in texts:
        assert simhash.simhash(t or "") == plain_simhash(t)
    monkeypatch.setattr(simhash, "_TEXT_BLOCK", 40)
    for t in texts:
        assert simhash.simhash(t or "") == plain_simhash(t)


def test_gray_order():
    fp = np.random.default_rng(0).integers(0, 1 << 63, 500, dtype=np.uint64)
    for choice in range(15):
        assert (simhash.from_rank(simhash.gray_rank(fp, choice), choice) == fp).all()
    bits = simhash.from_rank(np.arange(64, dtype=np.uint64), 0)
    assert (np.bitwise_count(bits[1:] ^ bits[:-1]) == 1).all()


def near(rng, center, count, most):
    out = []
    for _ in range(count):
        x = center
        for b in rng.choices(range(64), k=rng.randint(0, most)):
            x ^= 1 << b
        out.append(x)
    return out


@pytest.mark.parametrize(("run", "piece"), [(simhash.RUN, simhash.SLICE), (300, 20), (16, 5)])
def test_links_against_all_pairs(spark, monkeypatch, run, piece):
    """Balls, far points and a cell that goes over runs; the same groups whatever the sizes of runs and slices."""
    rng = random.Random(run)
    values = sorted({*near(rng, rng.getrandbits(64), 250, 6), *near(rng, rng.getrandbits(64), 200, 12), *(rng.getrandbits(64) for _ in range(200)), *near(rng, 0, 60, 9)})
    source = spark.createDataFrame([(v - ((v >> 63) << 64),) for v in values], "fp long")
    ranked = source.mapInArrow(simhash._ranked, "choice int, rank long").collect()
    by = {}
    for r in ranked:
        by.setdefault(r["choice"], []).append(r["rank"] % (1 << 64) ^ (1 << 63))
    # runs of these sizes in this process, then slices met as Spark meets them
    monkeypatch.setattr(simhash, "SLICE", piece)
    pairs, slices = [], []
    for choice, ranks in by.items():
        ranks = np.sort(np.array(ranks, np.uint64))
        for i in range(0, len(ranks), run):
            for batch in simhash._found(choice, ranks[i : i + run], i):
                for r in batch.to_pylist():
                    (pairs if r["choice"] is None else slices).append(r)
    met = [{"x": x["members"], "rx": x["roots"], "y": y["members"], "ry": y["roots"]} for x, y in itertools.combinations(slices, 2) if (x["choice"], x["cell"]) == (y["choice"], y["cell"]) and x["run"] != y["run"] and ((x["pattern"] ^ y["pattern"]) & x["mask"] & y["mask"]).bit_count() <= 4]
    links = [(p["a"], p["b"]) for p in pairs]
    if met:
        kind = pa.schema([(c, pa.binary()) for c in ("x", "rx", "y", "ry")])
        for batch in simhash._across(iter([pa.RecordBatch.from_pylist(met, schema=kind)])):
            links += [(r["a"], r["b"]) for r in batch.to_pylist()]
    place = {v - ((v >> 63) << 64): i for i, v in enumerate(values)}
    root = np.arange(len(values))
    for a, b in links:
        simhash.unite(root, np.array([place[a]]), np.array([place[b]]))
    assert root.tolist() == groups(values)
    assert run < 1000 or len(links) <= 15 * len(values)


def test_groups_of_documents(spark):
    rng = random.Random(9)
    base = [" ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(120)) for _ in range(4)]
    texts = [None, "", " \n", "one", "One", "one two three", *base, *base]
    for t in base:
        words = t.split()
        for k in range(12):
            texts.append(" ".join(w if rng.random() > 0.01 * (k % 4) else "new" for w in words))
    rows = [(i * 3 + 5, t, "x", 1) for i, t in enumerate(texts)] + [(None, base[0], "x", 1), (5, "one", "y", 2), (5, "one", "y", 2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, fp string, root int")
    found = simhash.near_duplicates(table.repartition(3)).collect()
    values = [plain_simhash(r[1]) for r in rows]
    by_group = {}
    for r, g in zip(rows, groups(values)):
        by_group.setdefault(g, []).append(r[0])
    want = sorted(((r[0] if r[0] is not None else -1), f"{v:016x}", min(k for k in by_group[g] if k is not None)) for r, v, g in zip(rows, values, groups(values)))
    assert sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["fingerprint"], r["component_id"]) for r in found) == want
    assert simhash.near_duplicates(table.limit(0)).collect() == []
