"""Laid-out document text to typed values: pages, lines, cells, headers, rules, candidates.

Every step is a DataFrame: order is semantic here, so rows carry page, line, label, rule, cell and column ordinals. All
windows partition by document and order by page and line, so one shuffle serves them. The rules are patterns known
when the plan is made: each is compiled once, and a union of all labels drops most cells before any rule is tried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.fixed import CONTINUATION_LINES, CONTINUATION_SLACK, FOOTNOTE, LONE_HEADER, RULES, TABLE_LEFT_SLACK, Rule
from specloom.functions import text as tx
from specloom.functions import values as vl
from specloom.operators.columns import assigned
from specloom.operators.relational import carry_forward, once, preferred_rows

CELLS = "array<struct<start:int,end:int,text:string>>"
#: What parts lines, besides the form feed that parts pages.
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
_ROW = ["document", "page", "line", "label_no", "rule_no"]


def split_pages(texts: DataFrame, document: str = "document", text: str = "text") -> DataFrame:
    """(document, page, text): pages from 1, parted by form feeds; one blank page at the end goes."""
    parts = F.split(F.coalesce(text, F.lit("")), "\f")
    kept = F.when((F.size(parts) > 1) & F.regexp_like(F.element_at(parts, -1), F.lit(r"(?U)^\s*$")), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    pages = texts.select(F.col(document).alias("document"), F.posexplode(kept).alias("p", "text"))
    return pages.select("document", (F.col("p") + 1).alias("page"), "text")


def placed_cells(line: Column) -> Column:
    """Cells of a line with their character positions: runs of text that two or more blanks part; a tab is four blanks."""
    flat = F.replace(line, F.lit("\t"), F.lit("    "))
    body = F.trim(flat)
    lead = F.length(flat) - F.length(F.ltrim(flat))
    gaps = F.regexp_extract_all(body, F.lit(" {2,}"), F.lit(0))
    both = F.arrays_zip(F.split(body, " {2,}").alias("t"), F.transform(gaps, F.length).alias("g"))
    start = F.struct(lead.alias("at"), F.lit(None).cast(CELLS).alias("cells"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["t"])
        cell = F.array(F.struct(acc["at"].alias("start"), end.alias("end"), x["t"].alias("text")))
        return F.struct((end + F.coalesce(x["g"], F.lit(0))).alias("at"), F.coalesce(F.concat(acc["cells"], cell), cell).cast(CELLS).alias("cells"))

    return F.when(F.length(body) > 0, F.aggregate(both, start, step, lambda a: a["cells"])).otherwise(F.array().cast(CELLS))


def header_of(line: Column, pattern: Column) -> Column:
    """Model names of a header line with their centres and the first start; null if the line is no header.

    A lone model is a header only behind words that say so. A null pattern finds none.
    """
    found = F.regexp_extract_all(line, pattern, F.lit(0))
    both = F.arrays_zip(found.alias("m"), F.slice(F.split(line, pattern, -1), F.lit(1), F.size(found)).alias("g"))
    start = F.expr("named_struct('at', 0, 'centers', cast(array() as array<double>))")

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["g"])
        end = at + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["centers"], F.array((at + end) / 2.0)).alias("centers"))

    first = F.length(F.element_at(F.split(line, pattern, -1), 1))
    named = F.regexp_like(F.substring(line, F.lit(1), first), F.lit(f"(?iuU){LONE_HEADER}"))
    ok = (F.size(found) > 1) | ((F.size(found) == 1) & named)
    return F.when(ok, F.struct(found.alias("models"), F.aggregate(both, start, step, lambda a: a["centers"]).alias("centers"), first.alias("start")))


def lines(pages: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """(document, page, line, text, cells, is_header, header, multi) from pages (document, page, text).

    patterns: (document, model_pattern). header is the one in force, carried over pages until the next; multi says
    whether any header of the document names several models.
    """
    # whole pages are dealt by document, as the windows need it: less travels than lines with their cells, and all that follows is parallel
    pages = pages.select("document", "page", "text").repartition("document")
    split = pages.select("document", "page", F.posexplode(F.split(tx.normalize(F.col("text")), LINE_BREAKS)).alias("line", "text"))
    if patterns is None:
        split = split.withColumn("pattern", F.lit(None).cast("string"))
    else:
        split = split.join(patterns.select("document", F.nullif("model_pattern", F.lit("")).alias("pattern")), "document", "left")
    own = split.select("document", "page", "line", "text", placed_cells(F.col("text")).alias("cells"), header_of(F.col("text"), F.col("pattern")).alias("own"))
    order = [F.col("page"), F.col("line")]
    out = carry_forward(own, ["document"], order, F.col("own"), "header")
    whole = Window.partitionBy("document")
    return out.select("document", "page", "line", "text", "cells", F.col("own").isNotNull().alias("is_header"), "header", F.coalesce(F.max(F.size("own.models")).over(whole) > 1, F.lit(False)).alias("multi"))


def _by_rule(rule_no: Column, value) -> Column:
    """A null-safe CASE over the rules: value(rule) is a literal or a Column, None gives null."""
    out = F.lit(None)
    for i, r in enumerate(RULES):
        v = value(r)
        if v is not None:
            out = F.when(rule_no == i, v).otherwise(out)
    return out


def _like(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(f"(?iuU){pattern}"))


def _labelled(ls: DataFrame) -> DataFrame:
    """A row for each cell that a rule's label matches, with the lines where its value may be (options)."""
    w = Window.partitionBy("document").orderBy("page", "line")

    def near(k: int) -> Column:
        at = F.struct("page", "line", "text", "cells")
        x = F.lead(at, k).over(w) if k > 0 else F.lag(at, -k).over(w)
        return F.when((x["page"] == F.col("page")) & (x["line"] == F.col("line") + k), x)

    around = ls.withColumns({"next1": near(1), "next2": near(2), "next3": near(3), "before": near(-1)}).where(~F.col("is_header"))
    each = around.select("*", F.posexplode("cells").alias("label_no", "label"))
    # a column below the generator, which would work it out anew for each rule
    each = each.withColumn("label_key", F.regexp_replace(F.trim(F.col("label.text")), ":+$", ""))
    key = F.col("label_key")
    each = each.where(_like(key, "|".join(f"(?:{r.label})" for r in RULES)))
    matched = F.array_compact(F.array(*[F.when(_like(key, r.label), F.lit(i)) for i, r in enumerate(RULES)]))
    each = each.withColumn("rule_no", F.explode(matched))

    same = F.filter(F.slice("cells", F.col("label_no") + 2, F.greatest(F.size("cells"), F.lit(1))), lambda c: ~F.regexp_like(c["text"], F.lit(FOOTNOTE)))

    def wrapped(x: str) -> Column:
        ok = F.col(x).isNotNull() & (F.size(f"{x}.cells") > 0) & F.forall(f"{x}.cells", lambda c: c["start"] > F.col("label.end"))
        return F.when(ok, F.struct(F.col(f"{x}.line").alias("line"), F.col(f"{x}.text").alias("text"), F.col(f"{x}.cells").alias("cells")))

    here = F.array(F.struct(F.col("line").alias("line"), F.col("text").alias("text"), same.alias("cells")))
    options = F.when(F.size(same) > 0, here).otherwise(F.array_compact(F.array(wrapped("next1"), wrapped("before"), wrapped("next2"))))
    return each.withColumn("options", options).drop("before")


def _with_note(parsed: Column, label: Column, rule_no: Column) -> Column:
    note = _by_rule(rule_no, lambda r: F.regexp_extract(label, f"(?iuU){r.label_note}", 1) if r.label_note else None)
    return F.when(F.length(F.coalesce(note, F.lit(""))) > 0, F.transform(parsed, lambda v: F.struct(F.concat(v["text"], F.lit(" ("), note, F.lit(")")).alias("text"), v["number"].alias("number")))).otherwise(parsed)


def _candidate(field: Column, value: Column, numeric: Column, evidence: Column, anchor: Column, conditions: Column, model: Column) -> list[Column]:
    return [field.alias("field"), value.alias("value"), numeric.alias("numeric"), evidence.alias("evidence"), anchor.alias("anchor"), conditions.alias("conditions"), model.alias("model")]


def read_rows(ls: DataFrame, tables: bool = True) -> DataFrame:
    """Candidates of all rows, each option that gives any; before the first option, untied values and repeats are chosen.

    A row is read once, as a table's or as one model's; tables: whether there may be headers of several models.
    """
    rule = F.col("rule_no")
    each = _labelled(ls).select("*", F.inline(F.transform("options", lambda x, i: F.struct(i.alias("option"), x["line"].alias("o_line"), x["text"].alias("o_text"), x["cells"].alias("o_cells"))))).drop("options", "cells", "text", "label_key")
    row_text = F.concat_ws(" ", F.col("label.text"), F.array_join(F.transform("o_cells", lambda c: c["text"]), " "))
    out = _by_rule(rule, lambda r: _like(row_text, r.exclude) if r.exclude else None)
    need = _by_rule(rule, lambda r: _like(row_text, r.require) if r.require else None)
    each = each.where(~F.coalesce(out, F.lit(False)) & F.coalesce(need, F.lit(True)))
    field = _by_rule(rule, lambda r: F.lit(r.field))
    kind = _by_rule(rule, lambda r: F.lit(r.parse))
    how = _by_rule(rule, lambda r: F.lit(r.pick))
    first = F.element_at("o_cells", 1)
    each = each.withColumns({"field_name": field, "kind": kind, "how": how, "label_text": tx.squeeze(F.col("label.text")), "line_text": tx.squeeze(F.col("o_text")), "same_line": F.col("o_line") == F.col("line")})
    # every text that may be a value is parsed once: the option's cells, then, after a colon, the first cells of the lines below
    each = each.withColumn("goes_on", F.col("same_line") & F.endswith(F.rtrim(F.col("label.text")), F.lit(":")))
    below = [F.get(f"next{k}.cells", F.lit(0))["text"] for k in range(1, CONTINUATION_LINES + 1)]
    texts = F.concat(F.transform("o_cells", lambda c: c["text"]), F.when(F.col("goes_on"), F.array(*below)).otherwise(F.array().cast("array<string>")))
    each = once(each, "parsed", F.transform(texts, lambda t: F.coalesce(vl.parse(F.col("kind"), t), F.array().cast(vl.RESULT))))
    each = once(each, "parsed", F.transform("parsed", lambda v: _with_note(v, F.col("label_text"), rule)))
    in_table = F.coalesce((F.size("header.models") > 1) & (first["start"] >= F.col("header.start") - TABLE_LEFT_SLACK), F.lit(False))
    each = _single_value(each.withColumn("in_table", in_table if tables else F.lit(False)))
    if tables:
        each = _table_values(each)
    found = F.when(F.col("in_table"), F.col("of_table")).otherwise(F.col("of_one")) if tables else F.col("of_one")
    return each.select(*_ROW, "option", "multi", F.inline(found))


_FOUND = "array<struct<cell_no:int,column_no:int,field:string,value:string,numeric:double,evidence:string,anchor:string,conditions:string,model:string>>"


def _table_values(each: DataFrame) -> DataFrame:
    """each with of_table, in multi-model tables: each cell's value for every model column that the cell covers."""
    with_values = F.transform("o_cells", lambda c, i: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["text"].alias("text"), F.get("parsed", i).alias("values")))
    each = each.withColumn("table", F.when(F.col("in_table"), F.filter(with_values, lambda c: c["start"] >= F.col("header.start") - TABLE_LEFT_SLACK)))
    each = each.withColumn("groups", assigned(F.transform("table", lambda c: (c["start"] + c["end"]) / 2.0), F.when(F.col("in_table"), F.col("header.centers"))))
    met = F.arrays_zip(F.col("table").alias("cell"), F.col("groups.firsts").alias("a"), F.col("groups.lasts").alias("b"))
    picked = F.transform(met, lambda z, i: F.struct(i.alias("cell_no"), z["a"].alias("a"), z["b"].alias("b"), z["cell"]["text"].alias("text"), vl.pick(z["cell"]["values"], F.col("how")).alias("v")))
    each = once(each, "cells_read", F.when(F.col("groups").isNotNull(), F.filter(picked, lambda z: z["v"].isNotNull())))
    conditions = vl.conditions(F.col("label_text"))

    def of_model(z: Column, column_no: Column) -> Column:
        model = F.get("header.models", column_no)
        evidence = F.concat(F.col("label_text"), F.lit(" — "), model, F.lit(": "), tx.squeeze(z["text"]))
        return F.struct(z["cell_no"].alias("cell_no"), column_no.alias("column_no"), *_candidate(F.col("field_name"), z["v"]["text"], z["v"]["number"], evidence, F.col("line_text"), conditions, model))

    found = F.flatten(F.transform("cells_read", lambda z: F.transform(F.sequence(z["a"], z["b"]), lambda n: of_model(z, n))))
    return each.withColumn("of_table", found.cast(_FOUND))


def _single_value(each: DataFrame) -> DataFrame:
    """each with of_one, of rows in no table: the first value cell and, after a colon, the lines aligned under it."""
    each = each.withColumns({"first": F.element_at("o_cells", 1), "n_cells": F.size("o_cells")})
    lead = F.get(F.get("parsed", F.lit(0)), F.lit(0))["number"]
    others = F.flatten(F.slice("parsed", F.lit(2), F.greatest(F.col("n_cells") - 1, F.lit(0))))
    clash = lead.isNotNull() & F.col("same_line") & F.exists(others, lambda v: v["number"].isNotNull() & (v["number"] != lead))
    usable = ~F.col("in_table") & ~F.coalesce(clash, F.lit(False))

    start, end = F.col("first.start"), F.col("first.end")
    good, extra = F.col("goes_on"), []
    for k in range(1, CONTINUATION_LINES + 1):
        cell = F.get(f"next{k}.cells", F.lit(0))
        good = good & F.coalesce((F.abs(cell["start"] - start) <= CONTINUATION_SLACK) | (F.abs(cell["end"] - end) <= CONTINUATION_SLACK), F.lit(False))
        extra.append(F.when(good, F.struct(cell["text"].alias("text"), F.get("parsed", F.col("n_cells") + k - 1).alias("values"))))
    own = F.struct(F.col("first.text").alias("text"), F.get("parsed", F.lit(0)).alias("values"))
    each = once(each, "read", F.when(usable, F.array_compact(F.array(own, *extra))))
    found = F.flatten(F.transform("read", lambda x: F.transform(x["values"], lambda v: F.struct(v["text"].alias("text"), v["number"].alias("number"), x["text"].alias("of")))))
    each = once(each.withColumn("texts", F.transform("read", lambda x: x["text"])), "found", found)
    each = once(each, "best", vl.pick(F.col("found"), F.col("how")))
    head, many = F.get("found", F.lit(0)), F.size("texts") > 1
    is_text = head["number"].isNull()
    joined = F.array_join(F.array_distinct(F.transform("found", lambda v: v["text"])), "; ")
    best = F.col("best")
    value = F.when(is_text & many, joined).when(is_text, head["text"]).otherwise(best["text"])
    number = F.when(~is_text, best["number"])
    cell_text = F.when(is_text, F.array_join("texts", " ")).otherwise(best["of"])
    first_flat = tx.squeeze(F.col("first.text"))
    evidence = F.when(many, F.concat(F.col("label_text"), F.lit(" "), F.array_join(F.transform("texts", tx.squeeze), " / "))).otherwise(F.concat_ws(" ", "label_text", first_flat))
    anchor = F.when(many, first_flat).otherwise(F.col("line_text"))
    model = F.when(F.size("header.models") == 1, F.get("header.models", F.lit(0)))
    conditions = vl.conditions(F.concat_ws(" ", F.col("label_text"), cell_text))
    one = F.struct(F.lit(0).alias("cell_no"), F.lit(0).alias("column_no"), *_candidate(F.col("field_name"), value, number, evidence, anchor, conditions, model))
    return once(each, "of_one", F.when(F.size("found") > 0, F.array(one)).cast(_FOUND))


def _preferred(field: Column, evidence: Column) -> Column:
    prefer: dict[str, str] = {}
    for r in RULES:
        if r.prefer:
            prefer.setdefault(r.field, r.prefer)
    out = F.lit(False)
    for name, pattern in prefer.items():
        out = F.when(field == name, F.regexp_like(evidence, F.lit(f"(?U){pattern}"))).otherwise(out)
    return out


def candidates(pages: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """(document, model, field, value, numeric, page, evidence, anchor, conditions, ord) from laid-out pages.

    Of the places where a row's value may be, the first that gives any counts. In a document with a header of several
    models, values without a model go. Each (model, field) keeps the row that its rule prefers, else the first; ord
    says where the pair was first seen. Documents without text or matching labels give no rows.
    """
    rows = read_rows(lines(pages, patterns), tables=patterns is not None)
    first = rows.withColumn("best", F.min("option").over(Window.partitionBy(*_ROW))).where("option = best")
    tied = first.where(~F.col("multi") | F.col("model").isNotNull())
    place = F.struct("page", "line", "label_no", "rule_no", "cell_no", "column_no")
    key = ["document", "model", "field"]
    placed = tied.withColumn("place", place)
    placed = placed.withColumn("seen", F.min("place").over(Window.partitionBy(*key)))
    ranked = preferred_rows(placed, key, _preferred(F.col("field"), F.col("evidence")), F.col("place"))
    ranked = ranked.withColumn("ord", F.row_number().over(Window.partitionBy("document").orderBy("seen", "place")))
    return ranked.select("document", "model", "field", "value", "numeric", "page", "evidence", "anchor", "conditions", "ord")


def rule_table(rules: tuple[Rule, ...] = RULES) -> list[tuple]:
    """The rules as rows, for reports."""
    return [(i, r.field, r.label, r.parse, r.exclude, r.require, r.pick, r.prefer, r.label_note) for i, r in enumerate(rules)]
