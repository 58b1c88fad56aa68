"""Ids, positions, table versions and refreshed highlights on small tables."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from specloom.functions import display, text
from specloom.operators import catalog, locate
from specloom.operators import relational as rel
from specloom.schemas import SPECS
from specloom.sources import tables


def _one_by_one(rows, taken):
    """The first free id of each row, in order."""
    seen, out = set(taken), {}
    for order, base in sorted(rows):
        i, n = base, 2
        while i in seen:
            i, n = f"{base}-{n}", n + 1
        seen.add(i)
        out[order] = i
    return out


def test_ids_are_the_first_free_ones(spark):
    g = random.Random(3)
    cases = [
        ([("a", "datasheet"), ("b", "r"), ("c", "r"), ("d", "r-2")], ["datasheet-2024"]),
        ([("a", "r-2"), ("b", "r"), ("c", "r"), ("d", "r")], []),
        ([("a", "x"), ("b", "x"), ("c", "x")], ["x", "x-3", "x-2-2", "x-03"]),
        ([(f"{i:02d}", g.choice(["m", "m-2", "m-3", "n", "m-2-2"])) for i in range(24)], ["m", "m-4", "n-2", "m-2-3"]),
    ]
    for rows, taken in cases:
        df = spark.createDataFrame(rows, "url string, base string")
        held = spark.createDataFrame([(x,) for x in taken], "id string")
        got = {r.url: r.id for r in rel.unique_ids(df, "base", "url", held).collect()}
        assert got == _one_by_one(rows, taken)


def test_positions_over_ranges(spark):
    g = random.Random(1)
    rows = [(i, g.randint(0, 30) if g.random() < 0.8 else None) for i in range(700)]
    df = spark.createDataFrame(rows, "id int, v int")
    got = {r.id: r.pos for r in rel.positions(df, [F.col("v").isNull(), F.coalesce(-F.col("v"), F.lit(0)), F.col("id")], "pos").collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: i for i, r in enumerate(want, 1)}
    assert rel.positions(df.limit(0), [F.col("id")], "pos").count() == 0


def test_long_digit_runs_have_keys_of_their_own(spark):
    names = ["A9", "A10", "a010", "A12345678901", "A12345678900", "A2-b", "A"]
    df = spark.createDataFrame([(x,) for x in names], "s string")
    k = {r.s: r.k for r in df.select("s", text.natural_key(F.col("s")).alias("k")).collect()}
    assert k["A9"] < k["A10"] == k["a010"] < k["A12345678900"] < k["A12345678901"]
    assert k["A"] < k["A2-b"] < k["A9"]


def test_a_table_has_whole_versions_only(spark, tmp_path):
    at = f"file://{tmp_path}/t.parquet"
    assert tables.read(spark, at) is None
    for n in (1, 2, 3, 4):
        tables.swap_in(spark.range(n), at)
        assert tables.read(spark, at).count() == n
    assert tables.versions(spark, at) == [3, 4]
    half = tmp_path / "t.parquet" / f"{tables.VERSION}{5:012d}"
    half.mkdir()  # a writer that died has left no mark
    assert tables.read(spark, at).count() == 4


def test_a_version_written_from_the_one_before(spark, tmp_path):
    at = f"file://{tmp_path}/u.parquet"
    tables.swap_in(spark.range(2), at)
    for _ in range(3):
        now = tables.read(spark, at)
        tables.swap_in(now.unionByName(now), at)
    assert tables.read(spark, at).count() == 16


def test_highlights_are_refreshed_where_due(spark):
    line = lambda n, x0, x1, y, t: ("r2", 3, 600.0, 800.0, n, float(x0), float(y), float(x1), float(y + 10), t)
    lines = spark.createDataFrame([line(0, 50, 130, 100, "Weight of it"), line(1, 300, 340, 100, "640 kg"), line(2, 50, 90, 300, "Other")], "sha256 string, page int, width double, height double, line_no int, x0 double, y0 double, x1 double, y1 double, text string")
    base = spark.createDataFrame([("due", "r2", 3), ("fresh", "r2", 3), ("away", "r1", 3), ("lost", "r2", 3), ("none", "r2", None)], "id string, revision string, page long")
    old = lambda rev: F.struct(F.lit(rev).alias("revision"), F.lit(3).cast("long").alias("page"), F.lit("i").alias("image"), F.lit(None).cast("array<double>").alias("row"), F.lit(None).cast("array<double>").alias("cell"))
    said = F.when(F.col("id") == "lost", "Height of it 9").otherwise("Weight of it 640 kg")
    specs = base.withColumns({"value": F.lit("640"), "evidence": said, "highlight": F.when(F.col("id") == "fresh", old("r2")).when(F.col("id") == "due", old("r1"))})
    full = specs.select(*[(F.col(f.name) if f.name in specs.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SPECS.fields])
    got = {r.id: r.highlight for r in locate.refresh(full, lines).collect()}
    assert got["fresh"].image == "i" and got["away"] is None and got["none"] is None
    assert (got["due"].revision, got["due"].page, got["due"].image) == ("r2", 3, "datasheets/r2/page-3.jpg")
    assert got["due"].row == [round(48.5 / 600, 4), round(98.5 / 800, 4), round(341.5 / 600, 4), round(111.5 / 800, 4)]
    assert got["lost"].revision == "r2" and got["lost"].row is None


def test_names_of_countries(spark):
    df = spark.createDataFrame([("NL",), ("SE",), ("KR",), ("XX",), (None,)], "c string")
    got = {r.c: r.n for r in df.select("c", display.country_name(F.col("c")).alias("n")).collect()}
    assert got == {"NL": "Netherlands", "SE": "Sweden", "KR": "South Korea", "XX": "XX", None: None}
    assert catalog.country_facet(spark.createDataFrame([("a", ("SE", ("DE",))), ("b", ("AT", None))], "id string, company struct<hq_country:string,parent:struct<country:string>>")).select("name").collect()[0].name == "Austria"
