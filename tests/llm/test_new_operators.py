"""Divergence, neighbour descent and fill-in-middle against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from spanloom.llm import divergence, fill_middle, neighbours
from tests.llm.cases import frame, odd_rows

CLASHING = "lang string, source string, text string, p0 string, term long, block string, kept boolean"


def plain_divergence(rows, least, top):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    rows = [(lang or "", source or "", terms(text)) for lang, source, text in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        docs, groups = Counter(), {}
        for r in (r for r in rows if r[0] == lang):
            docs.update(set(r[2]))
            groups.setdefault(r[1], Counter()).update(r[2])
        kept = [t for t in docs if docs[t] >= least]
        p = {}
        for name, counts in [*groups.items(), (None, sum(groups.values(), Counter()))]:
            n = sum(counts[t] for t in kept)
            p[name] = {t: 1 + 10**9 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for g in groups:
            pairs = [(-sum(f(p[g][t], p[h][t]) for t in kept), h) for h in groups if h != g]
            special = [(-f(p[g][t], p[None][t]), t) for t in kept if groups[g][t] and p[g][t] > p[None][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(special, key=lambda x: (x[0], x[1].encode()))[:top])):
                out |= {(lang, g, part, item, -value, rank) for rank, (value, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize(("groups", "terms"), [(16, 4096), (2, 3)])
def test_divergence(spark, groups, terms, monkeypatch):
    """Many blocks and one, against plain counting: nulls, empty and long texts, ties, a group without terms, a language that keeps none."""
    rng = random.Random(5)
    words = "Door door FIRE wall été 漢字 a1b z 🙂 Ünder".split()
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "é", None, "z"]), " ".join(rng.choices(words, k=rng.randint(0, 12)))) for _ in range(200)]
    rows += [("en", "blank", ""), ("en", "none", None), ("fr", "a", "seul"), ("fr", "b", None), ("it", "alone", "uno"), ("en", "a", "door wall\x00" * 20_000)]
    rows += [("en", "a", "door")] * 50
    monkeypatch.setattr(divergence, "ENTRIES", 7)
    df = spark.createDataFrame([(*r, "x", 1, "y", True) for r in rows], CLASHING).repartition(3)
    found = divergence.audit(df, 10, 10, groups, terms).collect()
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == plain_divergence(rows, 10, 10)
    assert divergence.audit(df.limit(0)).count() == 0


def test_shares_are_exact_beyond_doubles(spark):
    row = spark.range(1).select(divergence.share(*[divergence.F.lit(x).cast("long") for x in (3 * 10**12 + 1, 7 * 10**12 + 3, 11)]).alias("p")).first()
    assert row.p == 1 + 10**9 * (3 * 10**12 + 3) // (7 * 10**12 + 25)


def plain_nearest(rows, answers=5):
    """Every row against every other, in doubles."""
    held = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for k, (i, v) in enumerate(held):
        if i % 50 == 0:
            scored = [(float(v @ w) / (float(np.sqrt(v @ v)) * float(np.sqrt(w @ w))), j) for m, (j, w) in enumerate(held) if m != k and len(w) == len(v)]
            out.setdefault(i, []).append(sorted(scored, key=lambda x: (-x[0], x[1]))[:answers])
    return out


VECTORS = "vec_id long, embedding array<float>, label int, node string, code int, sim int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "n", 1, 2) for i, v in rows], VECTORS).repartition(4)


def test_neighbours_recall(spark):
    """A table of several leaves: recall over all queries, and every score is the exact one."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + rng.normal(size=24) * (0.2 if i % 3 else 2)]) for i in range(3000)]
    shape = neighbours.Shape(k=12, reverse=8, leaf=64, beam=64)
    found = {}
    for r in neighbours.nearest(vectors(spark, rows), shape=shape).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    expect = {i: x[0] for i, x in plain_nearest(rows).items()}
    assert found.keys() == expect.keys() and all(sorted(r[0] for r in x) == [1, 2, 3, 4, 5] for x in found.values())
    hits = sum(len({j for _, j, _ in found[i]} & {j for _, j in expect[i]}) for i in expect)
    assert hits >= 0.95 * 5 * len(expect)
    exact = {i: dict((j, s) for s, j in plain_nearest(rows, 3000)[i][0]) for i in list(expect)[:5]}
    assert all(abs(s - exact[i][j]) < 1e-12 for i in exact for _, j, s in found[i])


def test_neighbours_cases(spark):
    """Unusable vectors, a large group of copies, repeated ids, other lengths, parallel vectors, few candidates, no rows."""
    one, two = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [(i, one) for i in range(0, 400, 2)] + [(50, two), (50, one), (50, one), (101, [2.0, 4.0, 6.0]), (151, [0.5, 0.0, 9.0])]
    rows += [(100, None), (200, [0.0, 0.0, 0.0]), (250, []), (300, [1.0, None, 2.0]), (350, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 0.0, 1.0]), (None, one), (150, [1.0, 2.0])]
    found = neighbours.nearest(vectors(spark, rows)).collect()
    expect = plain_nearest(rows)
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r["rank"], round(r.score, 12), r.vec_id))
    for i, lists in expect.items():
        assert sorted(got.get(i, [])) == sorted((k, round(s, 12), j) for x in lists for k, (s, j) in enumerate(x, 1)), i
    assert got.keys() == {i for i, x in expect.items() if any(x)}
    assert neighbours.nearest(vectors(spark, rows).limit(0)).count() == 0
    few = neighbours.nearest(vectors(spark, [(0, one), (1, two)])).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in few] == [(0, 1, 1)]


def plain_fill(doc_id, text, draw):
    h = [int(hashlib.sha256(f"{draw.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= draw.rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < draw.spm
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("draw", [fill_middle.Draw(), fill_middle.Draw(3, 60, 20)])
def test_fill_middle(spark, draw, monkeypatch):
    """Outputs are those of slicing, and come back exactly: sentinels in the text, pieces of sentinels at cuts, wide characters, long lines."""
    monkeypatch.setattr(fill_middle, "CHUNK", 5)
    rng = random.Random(2)
    texts = ["", None, "\n", "\n\n\n", "one", "a\nb", "été\n漢字\n🙂\n", "<P>\nx", "a <M", "a<\nS>\n<M\n>P\n<", "\r\n\x00\n", "x" * 50_000 + "\n" + "é" * 50_000 + "\ntail"]
    texts += ["".join(rng.choices("ab<>PSM\n\né", k=rng.randint(1, 60))) for _ in range(150)]
    rows = [*enumerate(texts), (3, texts[6]), (3, texts[6]), (None, "p\nq\nr\n")]
    df = spark.createDataFrame([(i, t, "n", "f") for i, t in rows], "doc_id long, text string, n string, form string").repartition(3)
    made = fill_middle.transform(df, draw)
    found = Counter((r.doc_id, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in made.collect())
    assert found == Counter((i, plain_fill(i, t, draw)) for i, t in rows)
    assert Counter((r.doc_id, r.text) for r in fill_middle.restore(made).collect()) == Counter((i, t or "") for i, t in rows)
    assert {r[1][1] for r in found} == {"plain", "psm", "spm"}
    assert fill_middle.transform(df.limit(0), draw).count() == 0


def test_fill_middle_on_the_common_cases(spark):
    rows = odd_rows()
    made = fill_middle.transform(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.output) for r in made) == Counter((r[0], plain_fill(r[0], r[1], fill_middle.Draw())[4]) for r in rows)
