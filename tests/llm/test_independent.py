"""Scores of the chain, the randomness battery and long conversations against plain Python that shares no code with them."""

from __future__ import annotations

import itertools
import math
import random
import re
import string
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from specloom.llm import chat, secrets, toxicity
from tests.llm import util

# --- toxicity --------------------------------------------------------------------------------------


def _chain(words, weights, bias, trans, start):
    """P(T) of each word of a window: sums over all paths, tag by tag, in logarithms."""
    e = []
    for w in words:
        spelt = {"=" + w, *("^" + w[:k] for k in (3, 4, 5, 6, 7, 8) if k < min(len(w), 9)), *("$" + w[-k:] for k in (3, 4, 5, 6) if k < min(len(w), 7))}
        e.append(bias + sum(weights.get(f, 0.0) for f in spelt))
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    n = len(words)
    f = [[0.0, start + e[0]]]
    for t in range(1, n):
        f.append([add(f[-1][0] + trans[0][0], f[-1][1] + trans[1][0]), add(f[-1][0] + trans[0][1], f[-1][1] + trans[1][1]) + e[t]])
    b = [[0.0, 0.0]]
    for t in range(n - 1, 0, -1):
        b.insert(0, [add(trans[i][0] + b[0][0], trans[i][1] + e[t] + b[0][1]) for i in (0, 1)])
    return [1 / (1 + math.exp(f[t][0] + b[t][0] - f[t][1] - b[t][1])) for t in range(n)]


def test_scores_against_a_plain_chain(spark):
    """Windows with strong, weak and no features, short and long texts, no text."""
    g = random.Random(4)
    weights = {"=bad": 6.0, "^vil": 4.0, "$ugh": 2.5, "^the": 0.2, "=of": -0.3, "$ing": 0.1}
    trans, start, bias, head = np.array([[0.4, -1.0], [-0.5, 0.9]]), -0.7, -5.0, (0.8, 0.3, 1.1)
    vocabulary = ["bad", "vilest", "laugh", "there", "of", "sing", "plain", "words", "here", "été", "x"]
    rows = [(i, " ".join(g.choices(vocabulary, [1, 1, 1, 6, 6, 6, 20, 20, 20, 5, 5], k=n))) for i, n in enumerate([1, 2, 63, 64, 65, 128, 200, 500, 7, 30])]
    rows += [(20, "plain words"), (21, ""), (22, None), (23, "plain " * 64), (24, "plain " * 70)]
    model = toxicity.ChainModel(weights, bias, trans, start, head)
    got = {r.doc_id: r for r in toxicity.score(util.documents(spark, rows), model).collect()}
    for i, t in rows:
        words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
        p = [x for a in range(0, len(words), 64) for x in _chain(words[a : a + 64], weights, bias, trans, start)]
        top = min(max(max(p, default=0.0), 1e-6), 1 - 1e-6)
        z = head[0] * math.log(top / (1 - top)) + head[1] * math.log1p(sum(p)) + head[2]
        assert math.isclose(got[i].score, 1 / (1 + math.exp(-z)), rel_tol=1e-9), i
        assert got[i].n_toxic == sum(x > 0.5 for x in p)


def test_thinned_windows_keep_the_bias():
    """The fitted share of toxic tokens is that of all windows, though most windows without a feature are left out."""
    g = random.Random(8)
    docs = []
    for i in range(240):
        w = [g.choice(util.WORDS) for _ in range(640)]
        if i % 3 == 0:
            w[g.randrange(640)] = "grubblish"
        docs.append((" ".join(w).encode(), int(i % 3 == 0)))
    model = toxicity.fit_chain(docs, 1 / 3, steps=200)
    learn = [d for i, d in enumerate(docs) if i % 3 != 2]
    _, total, _ = model.tag([t for t, _ in learn])
    assert 0.5 < total.sum() / sum(y for _, y in learn) < 2


# --- secrets ---------------------------------------------------------------------------------------

_SETS = (("0123456789abcdef", "0123456789ABCDEF"), (string.ascii_uppercase + "234567",), (string.ascii_lowercase, string.ascii_uppercase), (string.digits,), (string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits), (string.ascii_letters,), (string.ascii_letters + string.digits,), (string.ascii_letters + string.digits + "+/_-",))
_LONG = (24, 32, 64, 48, 28, 40, 20, 20)


def _kind(c):
    return "a" if c in string.ascii_lowercase else "A" if c in string.ascii_uppercase else "0" if c in string.digits else "-"


def _battery(run):
    """(p-value, whether it is long enough) of a run."""
    s = run.rstrip("=")
    k = next((i for i, sets in enumerate(_SETS) if any(set(s) <= set(x) and s for x in sets)), len(_SETS) - 1)
    letters = _SETS[k][0] if k < 7 else string.ascii_letters + string.digits + "+/"  # or the two signs of addresses
    n, size = max(len(s), 2), len(letters)
    tail = lambda z: max(0.5 * math.erfc(z / math.sqrt(2)), 1e-20)
    chi = max(0.0, sum(c * c for c in Counter(s).values()) * size / n - n)
    df = size - 1
    p_chi = tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    shares = [c / size for c in Counter(map(_kind, letters)).values()]
    same = sum(x * x for x in shares)
    changes = len(list(itertools.groupby(s, _kind))) - 1
    p_runs = 1.0 if same >= 1 else min(1.0, 2 * tail(abs(changes - (n - 1) * (1 - same)) / math.sqrt(max((n - 1) * (1 - same) * same, 1e-9))))
    x = np.array([ord(c) for c in s], float)
    d = x - x.sum() / n if len(x) else x
    var = float((d * d).sum())
    r = float((d[1:] * d[:-1]).sum()) / var if var > 1e-9 else 1.0
    p_serial = min(1.0, 2 * tail(abs(r + 1 / n) * math.sqrt(n)))
    return min(1.0, 3 * min(p_chi, p_runs, p_serial)), len(s) >= _LONG[k]


def _planted():
    g = random.Random(12)
    draw = lambda letters, n: "".join(g.choice(letters) for _ in range(n))
    made = [draw(string.ascii_letters + string.digits + "+/", g.randint(40, 60)) + g.choice(["", "=", "=="]) for _ in range(30)]
    made += [draw("0123456789ABCDEF", g.randint(40, 64)) for _ in range(20)] + [draw(string.ascii_uppercase + "234567", g.randint(40, 56)) for _ in range(20)]
    names = ["_".join(g.choice(["customer", "order", "history", "archive", "backup", "server"]) for _ in range(5)) for _ in range(30)] + ["a" * 30, "ab" * 15, "0123456789" * 4, "=" * 25]
    return made, names


def test_battery_against_plain_python(spark):
    made, names = _planted()
    runs = sorted({*made, *names})
    df = spark.createDataFrame([(x,) for x in runs], "s string")
    got = {r.s: r.p for r in df.select("s", secrets.p_value(F.col("s")).alias("p")).collect()}
    for s in runs:
        want = _battery(s)[0]
        assert math.isclose(got[s], want, rel_tol=0.02, abs_tol=3e-7), (s, got[s], want)


def test_planted_secrets_in_prose(spark):
    """Runs that no pattern matches, in prose: the declared spans are those of the plain battery with plain false-discovery control."""
    made, names = _planted()
    g = random.Random(2)
    rows = [(i, f"{util.words(g, 8)} {x} {util.words(g, 8)}") for i, x in enumerate(made + names)]
    got = {r.doc_id: [(s.start, s.end) for s in r.random] for r in secrets.scan(util.documents(spark, rows)).collect()}
    found, by = {}, {}
    for i, t in rows:
        for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t):
            p, long = _battery(m[0])
            stratum = min((len(m[0]) - 20) // 8, secrets.STRATA - 1)
            by.setdefault(stratum, []).append(min(math.floor(-math.log10(p) * 20), secrets.BINS))
            if not re.search("[0-9a-f]{24,}", m[0]):
                found.setdefault(i, []).append((m.start(), m.end(), p, long, stratum))
    limit = {}
    for s, bins in by.items():
        bins.sort(reverse=True)
        ok = [10 ** (-b / 20) for k, b in enumerate(bins, 1) if (k == len(bins) or bins[k] != b) and 10 ** (-b / 20) <= secrets.FDR * k / len(bins)]
        limit[s] = max(ok, default=-1.0)
    want = {i: [(a, b) for a, b, p, long, s in x if long and p > limit[s]] for i, x in found.items()}
    assert {i: x for i, x in got.items() if x} == {i: x for i, x in want.items() if x}
    assert sum(bool(got[i]) for i in range(len(made))) >= 0.9 * len(made)
    assert sum(bool(got[i]) for i in range(len(made), len(rows))) <= 2


def test_positions_of_very_many_matches(spark):
    """More matches than a chunk holds, in a text of some 200,000 characters."""
    text = " ".join(f"x{i} token=abcdef{i}" for i in range(8_000))
    (r,) = secrets.scan(util.documents(spark, [(1, text)])).collect()
    assert [(s.start, s.end) for s in r["assign"]] == [m.span() for m in re.finditer(r"token=[a-z0-9]+", text)]


# --- conversations ---------------------------------------------------------------------------------


def test_conversations_of_very_many_turns_come_in_bounded_pieces(spark):
    """A third of all turns in one conversation, a thousand without a number, repeated ones among them."""
    rows = [("hot", i, "ann" if i % 2 else "bob", f"t{i}") for i in range(900)]
    rows += [("null", None, "ann", f"n{i % 400}") for i in range(1000)] + [("null", 1, "bob", "one")]
    rows += [("same", 3, "ann", "again")] * 300 + [(f"c{i}", 0, "ann", "hi") for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    out = chat.rotate(df, part=100, most=128).collect()
    assert max(r.n_turns for r in out) <= 128
    for conv, own in itertools.groupby(sorted(rows, key=lambda r: r[0]), key=lambda r: r[0]):
        own = list(own)
        speakers = {r[2] for r in own}
        for who in speakers:
            parts = [r for r in out if (r.conv_id, r.perspective) == (conv, who)]
            assert sum(r.n_turns for r in parts) == len(own)
            said = Counter(x for r in parts for x in re.findall(r"<\|im_start\|>[^\n]*\n(.*?)<\|im_end\|>\n", r.rendered))
            assert said == Counter(r[3] for r in own)
            masked = sum(s.end - s.start for r in parts for s in r.mask)
            assert masked == sum(len(r[3]) + len("<|im_end|>\n") for r in own if r[2] == who)
    hot = sorted((r for r in out if r.conv_id == "hot" and r.perspective == "ann"), key=lambda r: r.part)
    assert [r.part for r in hot] == list(range(9)) and all(r.piece == 0 for r in hot)
    assert [x for r in hot for x in re.findall(r"\n(t\d+)<", r.rendered)] == [f"t{i}" for i in range(900)]
