"""Embedding near-dedup and chat formatting: small tables against brute force."""

from __future__ import annotations

import numpy as np

from specloom.llm import chat, embdedup
from tests.llm import util


def vectors(seed=3):
    g = np.random.default_rng(seed)
    rows = []
    for c in range(12):
        centre = g.normal(size=16)
        for _ in range(int(g.integers(1, 30))):
            rows.append((centre + g.normal(size=16) * g.choice([0.05, 0.2, 0.3])).tolist())
    rows += [rows[0], rows[0], [2 * x for x in rows[0]]]  # copies
    rows += [[0.0] * 16, None, [], [1.0, None] + [0.0] * 14, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0]]
    return [(i, x) for i, x in enumerate(rows)]


def test_embeddings_against_all_pairs(spark):
    rows = vectors()
    good = {i: np.array(x, float) for i, x in rows if x and None not in x and np.isfinite(x).all() and any(x)}
    links = []
    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]):
                x, y = good[a], good[b]
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95 - 1e-12:
                    links.append((a, b))
    root = util.groups([i for i, _ in rows], links)
    n = {i: sum(i in p for p in links) for i, _ in rows}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS label", "'x' AS k", "'x' AS v", "'x' AS h", "'x' AS m")
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embdedup.near_duplicates(df).collect()}
    assert out == {i: (n[i], root[i], root[i] == i) for i, _ in rows}
    assert max(n.values()) > 16  # some lists are saturated
    assert embdedup.near_duplicates(df.limit(0)).count() == 0


def test_equal_rows_are_one_vector(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    out = sorted(((r.vec_id, r.n_links, r.component_id) for r in embdedup.near_duplicates(df).collect()), key=repr)
    assert out == sorted([(1, 1, 1), (2, 1, 1), (None, 0, None)], key=repr)


TURNS = [
    (1, 0, "system", "Be kind"),
    (1, 1, "ann", "Hi <|im_start|> there"),
    (1, 2, "bob", None),
    (1, 3, "ann", "a\nb"),
    (1, 3, "ann", "a\nb"),
    (1, None, "cleo", "early"),
    (2, 5, None, "who"),
    (2, 300, "ann", "late"),
    (3, 1, "system", "alone"),
    (None, 1, "ann", "no id"),
]


def brute(turns):
    out = []
    for c in {t[0] for t in turns}:
        own = [(t[1], t[2] if t[2] is not None else "unknown", t[3] or "") for t in turns if t[0] == c]
        parts = {}
        for t in own:
            parts.setdefault((t[0] or 0) // 256, []).append(t)
        for who in {r for _, r, _ in own} - {"system"}:
            for part, msgs in parts.items():
                text, mask = "", []
                for _, role, said in sorted(msgs, key=lambda m: (m[0] is not None, m[0] or 0, m[1], m[2])):
                    name = "system" if role == "system" else "assistant" if role == who else f"user name={role}"
                    text += f"<|im_start|>{name}\n"
                    body = said.replace("<|", "< |") + "<|im_end|>\n"
                    if role == who:
                        mask.append((len(text), len(text) + len(body)))
                    text += body
                out.append((c, who, part, len(msgs), text, mask))
    return sorted(out, key=repr)


def test_rotation(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS c", "'x' AS part", "'x' AS perspective", "'x' AS msgs")
    out = [(r.conv_id, r.perspective, r.part, r.n_turns, r.rendered, [(m.start, m.end) for m in r.mask]) for r in chat.rotate(df).collect()]
    assert sorted(out, key=repr) == brute(TURNS)
    assert chat.rotate(df.limit(0)).count() == 0


def test_embedding_links_between_full_groups(spark):
    """Two clumps of 40 with links across, none of which is among any vector's 16 nearest."""
    g = np.random.default_rng(3)
    a = np.zeros(64)
    a[0] = 1
    b = np.zeros(64)
    b[:2] = 0.965, np.sqrt(1 - 0.965**2)
    x = np.concatenate([c + g.normal(0, 0.003, (40, 64)) for c in (a, b)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T >= embdedup.THRESHOLD
    np.fill_diagonal(s, False)
    assert s[:40, 40:].any() and s[:40, :40].sum() == 40 * 39
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embdedup.near_duplicates(df).collect()}
    assert out == {i: (int(s[i].sum()), 0, i == 0) for i in range(80)}
