"""The catalog's queries: a QuerySpec becomes a chain of DataFrame operations. Views return rows, not pages.

Tables are a dict: suppliers, models, fields (with ord), documents, specs, changes, status.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.fixed import DEFAULT_COLUMNS, EFFICIENCY_OF, KPI_FIELDS, MAX_COLUMNS_SHOWN, MAX_COMPARED, PRESET_COLUMNS, PRESET_GROUPS
from specloom.functions import display, text
from specloom.operators import catalog as cat
from specloom.operators import relational as rel
from specloom.sources.tables import cut

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class QuerySpec:
    """What the catalog view is asked for; an address's query string and back."""

    q: str = ""
    show: str = "all"
    supplier: str = ""
    sort: str = "featured"
    direction: str = ""
    countries: tuple[str, ...] = ()
    hide: bool = False
    columns: tuple[str, ...] = ()
    differing: bool = False
    field: str = ""

    @classmethod
    def parse(cls, query: str) -> QuerySpec:
        got = {k: v[-1] for k, v in parse_qs(query.lstrip("?"), keep_blank_values=True).items()}
        listed = lambda k: tuple(x for x in got.get(k, "").split(",") if x)
        show = got.get("show", "all")
        return cls(
            q=got.get("q", ""),
            show=show if show in ("all", "reviewed", "auto", "none") else "all",
            supplier=got.get("supplier", ""),
            sort=got.get("sort", "featured"),
            direction=got.get("dir", "") if got.get("dir") in ("asc", "desc") else "",
            countries=listed("only") or listed("hide"),
            hide=not listed("only") and bool(listed("hide")),
            columns=listed("cols"),
            differing=got.get("diff") == "1",
            field=got.get("f", ""),
        )

    def to_query(self) -> str:
        """The query string without what is default."""
        pairs = {"q": self.q, "show": "" if self.show == "all" else self.show, "supplier": self.supplier, "sort": "" if self.sort == "featured" else self.sort, "dir": self.direction, "hide" if self.hide else "only": ",".join(self.countries), "cols": ",".join(self.columns), "diff": "1" if self.differing else "", "f": self.field}
        return urlencode({k: v for k, v in pairs.items() if v})


@dataclass(frozen=True)
class ShownColumn:
    id: str
    keys: tuple[str, ...]
    numeric: bool
    group: str = field(default="", compare=False)

    @property
    def sort_keys(self) -> tuple[str, ...]:
        return self.keys[:2] if self.id == "grid" else self.keys


def known_columns(t: Tables) -> dict[str, ShownColumn]:
    """Columns that may be shown: fields that have a value, and defaults; combined ones head their field group. The table of fields is a small definition table."""
    used = t["specs"].select(F.col("field").alias("key")).distinct()
    rows = t["fields"].join(used.withColumn("used", F.lit(True)), "key", "left").orderBy("ord").select("key", "kind", "group", "used").collect()
    out: dict[str, ShownColumn] = {}
    groups = set()
    preset = lambda k: ShownColumn(k, PRESET_COLUMNS[k], True, PRESET_GROUPS[k])
    for r in rows:
        if r.group not in groups:
            groups.add(r.group)
            out |= {k: preset(k) for k, g in PRESET_GROUPS.items() if g == r.group}
        if r.used or r.key in DEFAULT_COLUMNS:
            out[r.key] = ShownColumn(r.key, (r.key,), r.kind == "number", r.group)
    return out | {k: preset(k) for k in PRESET_COLUMNS if k not in out}


def shown_columns(known: dict[str, ShownColumn], wanted: tuple[str, ...]) -> list[ShownColumn]:
    """The first eight wanted columns that exist, in canonical order; the defaults if there are none."""
    picked = list(dict.fromkeys(c for c in wanted if c in known))[:MAX_COLUMNS_SHOWN]
    ids = [c for c in known if c in picked] or [c for c in DEFAULT_COLUMNS if c in known]
    return [known[c] for c in ids]


def values_by_model(t: Tables, columns: list[ShownColumn]) -> DataFrame:
    """(id, then a struct for each column: field, numeric, text, evidence): the first of the column's fields that the model has.

    One aggregate over the values: a field counts by being there, also without a number.
    """
    keys = sorted({k for c in columns for k in c.keys})
    s = cat.with_field(t["specs"].where(F.col("field").isin(*keys)), t["fields"])
    own = F.struct("field", "numeric", display.format_value(F.col("value"), F.col("unit")).alias("text"), "evidence", "unit")
    s = s.withColumn("v", own)
    per = s.groupBy(F.col("product").alias("id")).agg(*[F.any_value(F.when(F.col("field") == k, F.col("v")), ignoreNulls=True).alias(f"f_{k}") for k in keys])

    def value(c: ShownColumn) -> Column:
        first = F.coalesce(*[F.col(f"f_{k}") for k in c.keys])
        if c.id != "grid":
            return first
        hertz = F.col("f_frequency_hz")
        return F.when(first.isNotNull(), F.struct(*[first[k].alias(k) for k in ("field", "numeric", "text", "evidence", "unit")], hertz["text"].alias("second"), hertz.alias("hertz")))

    return per.select("id", *[value(c).alias(f"c_{c.id}") for c in columns], *[F.coalesce(*[F.col(f"f_{k}") for k in c.sort_keys]).alias(f"s_{c.id}") for c in columns])


def models_view(t: Tables) -> DataFrame:
    """Every product with its supplier, review kind and counts, family, and whether it is a container."""
    products = cat.all_products(t["suppliers"], t["models"])
    counts = cat.spec_counts(products, t["specs"])
    fams = cat.families(products, t["specs"])
    sup = t["suppliers"].select(F.col("id").alias("supplier"), F.col("name").alias("supplier_name"), display.countries().alias("countries"))
    rolled = cat.rolled_review(counts, fams).select("id", F.col("review").alias("_r"), F.col("n_check").alias("_c"), "members")
    out = counts.join(fams.select("id", "is_container"), "id").join(sup, "supplier").join(rolled, "id", "left")
    docs = cat.document_products(t["documents"]).groupBy(F.col("product").alias("id")).agg(F.count("*").alias("n_documents"))
    out = out.join(docs, "id", "left").withColumns({"review": F.coalesce("_r", "review"), "n_check": F.coalesce("_c", "n_check"), "n_documents": F.coalesce("n_documents", F.lit(0))})
    return out.drop("_r", "_c")


def pill(n_check: Column, review: Column) -> Column:
    return F.when(n_check > 0, F.concat(n_check.cast("string"), F.lit(" under review"))).when(review == "reviewed", "Reviewed").when(review == "auto", "Auto-read").otherwise("Datasheet only")


def subline(m: DataFrame) -> Column:
    facts = F.concat_ws(", ", "kind", "market")
    found = F.concat_ws(", ", "market", F.lit("found in a datasheet table"))
    on_file = F.when(F.col("n_documents") > 0, F.concat(display.plural(F.col("n_documents"), "datasheet"), F.lit(" on file"))).otherwise(F.lit("datasheet coming soon"))
    waiting = F.concat(F.coalesce("kind", F.lit("Model")), F.lit(", "), on_file)
    return F.when(F.col("auto"), found).when((F.col("n_specs") == 0) & ~F.col("is_container"), waiting).otherwise(facts)


def _filters(spec: QuerySpec) -> tuple[Column, Column]:
    """(conditions on the supplier, all conditions) of a query."""
    place = F.lit(True)
    if spec.supplier:
        place = place & (F.col("supplier") == spec.supplier)
    if spec.countries:
        hit = F.arrays_overlap("countries", F.array(*map(F.lit, spec.countries)))
        place = place & (~hit if spec.hide else hit)
    every = place & text.has_all_tokens(text.search_text("model", "supplier_name", "kind", "market", "summary"), spec.q.strip())
    if spec.show != "all":
        every = every & (F.col("review") == spec.show)
    return place, every


def catalog(t: Tables, spec: QuerySpec | None = None) -> DataFrame:
    """The catalog's rows: row_no (their order), group_key, entry_no, member_no, id, entry, is_member, model, supplier, subline, pill and the shown columns.

    Top-level entries are products outside containers; a container brings its matching members. A search or a review
    filter keeps a container only for its members. Groups are suppliers by reviewed and all values, the products
    without values last; sorting by a column ranks all entries together. Entries are ranked range by range, never all
    in one task; what the ranking reads several times is written once.
    """
    spec = spec or QuerySpec()
    known = known_columns(t)
    columns = shown_columns(known, spec.columns)
    by_column = next((c for c in columns if c.id == spec.sort), None)
    place, every = _filters(spec)
    narrowed = bool(spec.q.strip()) or spec.show != "all"

    m = cut(models_view(t).join(values_by_model(t, columns), "id", "left").withColumns({"fits": every, "placed": place}), "entries")
    boxes = m.where("is_container").select(F.col("id").alias("family"))
    members = m.where("NOT is_container").join(boxes, "family", "left_semi")
    tops = m.join(boxes, "family", "left_anti")
    member_sums = members.groupBy(F.col("family").alias("id")).agg(
        F.count_if("fits").alias("hits"),
        F.sum(F.when(F.col("fits"), F.col("n_reviewed") * 1000 + F.col("n_specs"))).alias("hit_rank"),
        *[F.sort_array(F.collect_list(F.when(F.col(f"c_{c.id}").isNotNull(), F.struct(text.natural_key(F.col("model")).alias("k"), F.col(f"c_{c.id}").alias("v"))))).alias(f"m_{c.id}") for c in columns],
        *[F.max(f"s_{c.id}.numeric").alias(f"n_{c.id}") for c in columns],
        *[F.min_by(f"s_{c.id}.text", F.when(F.col(f"s_{c.id}").isNotNull(), text.natural_key(F.col("model")))).alias(f"t_{c.id}") for c in columns],
    )
    tops = tops.join(member_sums, "id", "left")
    shown = F.when(F.col("is_container"), (F.col("hits") > 0) | (F.col("placed") if not narrowed else F.lit(False))).otherwise(F.col("fits"))
    tops = tops.where(shown)
    cell = lambda c: F.when(F.col("is_container"), _cell_of_members(c.id)).otherwise(shown_cell(c.id, F.col(f"c_{c.id}")))
    number = lambda c: F.when(F.col("is_container"), F.col(f"n_{c.id}")).otherwise(F.col(f"s_{c.id}.numeric"))
    words = lambda c: F.lower(F.when(F.col("is_container"), F.col(f"t_{c.id}")).otherwise(F.col(f"s_{c.id}.text")))
    weight = F.when(F.col("is_container"), F.coalesce("hit_rank", F.lit(0))).otherwise(F.col("n_reviewed") * 1000 + F.col("n_specs"))

    def sort_keys(key: Column) -> list[Column]:
        """Ascending expressions without nulls, the id last."""
        name = [text.natural_key(F.coalesce("model", F.lit(""))), F.col("id")]
        if by_column is None:
            return name if spec.sort == "name" else [-F.col("n_reviewed"), F.col("auto").cast("int"), -F.col("n_specs"), *name]
        down = (spec.direction or ("desc" if by_column.numeric else "asc")) == "desc"
        if by_column.numeric:
            return [key.isNull(), F.coalesce(-key if down else key, F.lit(0.0)), *name]
        return [key.isNull(), F.coalesce(key, F.lit("")), *name]

    main = lambda df: number(by_column) if by_column.numeric else text.natural_key(words(by_column))
    collecting = (F.col("review") == "none") & F.lit(spec.show != "none")
    group = F.lit("_all") if by_column else F.when(collecting, F.lit("_collecting")).otherwise(F.col("supplier"))
    tops = tops.withColumns({"group_key": group, "weight": weight, "sort_key": main(tops) if by_column else F.lit(None).cast("double")})
    downward = bool(by_column) and not by_column.numeric and spec.direction == "desc"
    ranks = tops.groupBy("group_key").agg(F.sum("weight").alias("group_rank"), F.count("*").alias("group_size"))
    # groups are suppliers: their place in the order is a table of one small row each
    ranks = ranks.withColumn("group_no", F.row_number().over(Window.orderBy((F.col("group_key") == "_collecting").asc(), F.desc("group_rank"), "group_key")))
    before = F.sum("group_size").over(Window.orderBy("group_no").rowsBetween(Window.unboundedPreceding, -1))
    ranks = ranks.select("group_key", "group_no", F.coalesce(before, F.lit(0)).alias("before"))
    tops = cut(tops.join(ranks, "group_key"), "tops")
    keys = sort_keys(F.col("sort_key"))
    tops = rel.positions(tops, [F.col("group_no"), *keys], "place")
    if downward:  # texts have no negative: entries with one are numbered from the other end, those of equal texts by name
        tops = _reversed(tops, keys)
    tops = tops.withColumn("entry_no", (F.col("place") - F.col("before")).cast("int"))
    own = tops.select("group_key", "place", "entry_no", F.lit(0).alias("member_no"), "id", F.col("id").alias("entry"), F.lit(False).alias("is_member"), "model", "supplier", subline(tops).alias("subline"), pill(F.col("n_check"), F.col("review")).alias("pill"), *[cell(c).alias(c.id) for c in columns])
    heads = tops.where("is_container").select(F.col("id").alias("_top"), "group_key", "place", "entry_no")
    inside = members.where("fits").join(heads, F.col("family") == F.col("_top"))
    inside = inside.withColumn("sort_key", F.when(F.lit(bool(by_column)), (F.col(f"s_{by_column.id}.numeric") if by_column.numeric else text.natural_key(F.lower(F.col(f"s_{by_column.id}.text")))) if by_column else F.lit(None).cast("double")))
    inner = sort_keys(F.col("sort_key"))
    inside = inside.withColumn("member_no", F.row_number().over(Window.partitionBy("family").orderBy(*(inner if not downward else [inner[0], F.desc("sort_key"), *inner[2:]]))))
    rows = own.unionByName(inside.select("group_key", "place", "entry_no", "member_no", "id", F.col("family").alias("entry"), F.lit(True).alias("is_member"), "model", "supplier", subline(inside).alias("subline"), pill(F.col("n_check"), F.col("review")).alias("pill"), *[shown_cell(c.id, F.col(f"c_{c.id}")).alias(c.id) for c in columns]))
    rows = rel.positions(cut(rows, "rows"), [F.col("place"), F.col("member_no")], "row_no")
    return rows.select("row_no", *[c for c in rows.columns if c not in ("row_no", "place")]).orderBy("row_no")


def _reversed(tops: DataFrame, keys: list[Column]) -> DataFrame:
    """tops with place for descending texts: largest texts first, those of equal texts by name, entries without one last."""
    rest = keys[2:]
    texts = tops.groupBy("group_no", keys[1].alias("_text"), keys[0].alias("_none")).agg(F.min("place").alias("_low"), F.count("*").alias("_same"))
    sizes = tops.groupBy("group_no").agg(F.count_if(~keys[0]).alias("_texts"), F.min("place").alias("_first"))
    met = tops.withColumns({"_text": keys[1], "_none": keys[0]}).join(texts, ["group_no", "_text", "_none"]).join(sizes, "group_no")
    turned = F.col("_first") + F.col("_texts") - (F.col("_low") - F.col("_first")) - F.col("_same") + (F.col("place") - F.col("_low"))
    return met.withColumn("place", F.when(F.col("_none"), F.col("place")).otherwise(turned)).drop("_text", "_none", "_low", "_same", "_texts", "_first")


def shown_cell(column: str, value: Column) -> Column:
    """The text of a column's value of one model: the grid column has its frequency behind it, power its condition, efficiency what it is of."""
    text_ = value["text"]
    if column == "grid":
        return F.nullif(F.concat_ws(", ", F.when(value["field"] != "frequency_hz", text_), value["second"]), F.lit(""))
    if column == "power":
        at = F.replace(display.condition_of(value["evidence"]), F.lit(" "), F.lit(""))
        return F.concat(text_, F.when(at.isNotNull(), F.concat(F.lit(" @"), at)).otherwise(F.lit("")))
    if column == "eff":
        return F.concat(text_, F.when(value["field"] == "efficiency_max_pct", F.lit(EFFICIENCY_OF[0])).otherwise(F.lit(EFFICIENCY_OF[1])))
    return text_


def _cell_of_members(column: str) -> Column:
    """The same of a container: the range of its members' values of the first field that any of them has."""
    values = F.transform(f"m_{column}", lambda x: x["v"])
    if column != "grid":
        span = range_of(values)
        if column != "eff":
            return F.when(F.size(f"m_{column}") > 0, span)
        of = F.when(F.get(values, F.lit(0))["field"] == "efficiency_max_pct", F.lit(EFFICIENCY_OF[0])).otherwise(F.lit(EFFICIENCY_OF[1]))
        return F.when(F.size(f"m_{column}") > 0, F.concat(span, of))
    of = lambda k: F.filter(values, lambda v: v["field"] == k)
    high, low = of("mv_voltage_kv"), of("ac_voltage_v")
    main = F.when(F.size(high) > 0, high).otherwise(low)
    seconds = F.filter(F.transform(values, lambda v: v["hertz"]), lambda v: v.isNotNull())
    each = [F.when(F.size(x) > 0, range_of(x)) for x in (main, seconds)]
    return F.when(F.size(values) > 0, F.nullif(F.concat_ws(", ", *each), F.lit("")))


def range_of(values: Column) -> Column:
    """Smallest to largest number with the first value's unit, else the one text, else 'Varies'."""
    nums = F.filter(F.transform(values, lambda v: v["numeric"]), lambda n: n.isNotNull())
    show = lambda n: F.regexp_replace(F.format_number(n, 2), r"\.?0+$", "")
    first = F.get(values, F.lit(0))
    lo, hi = F.array_min(nums), F.array_max(nums)
    unit = F.when(F.coalesce(first["unit"], F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(" "), first["unit"]))
    span = F.concat(show(lo), F.when(lo == hi, F.lit("")).otherwise(F.concat(F.lit("-"), show(hi))), unit)
    texts = F.array_distinct(F.transform(values, lambda v: v["text"]))
    return F.when(F.size(nums) > 0, span).when(F.size(texts) == 1, F.get(texts, F.lit(0))).when(F.size(texts) > 1, F.lit("Varies"))


def facets(t: Tables) -> DataFrame:
    """(show, n): products outside containers by review kind, and all."""
    leaves = models_view(t).where("NOT is_container").select("review")
    return leaves.groupBy(F.col("review").alias("show")).agg(F.count("*").alias("n")).unionByName(leaves.select(F.lit("all").alias("show")).groupBy("show").agg(F.count("*").alias("n")))


def model_values(t: Tables, product: str) -> DataFrame:
    """Values of a model in field order, by field group: label, text, condition, status label, previous value, whether an older revision gives it."""
    fields = cat.field_order(t["fields"]).select(F.col("key").alias("field"), "label", "unit", "group", "field_ord")
    s = t["specs"].where(F.col("product") == product).join(fields, "field", "left")
    latest = cat.current_revision(t["documents"]).select("document", F.col("sha256").alias("latest"))
    s = s.join(latest, "document", "left")
    text_ = display.format_value(F.col("value"), F.coalesce("unit", F.lit("")))
    previous = F.get("history", F.lit(0))["value"]
    return s.orderBy(F.col("field_ord").asc_nulls_last(), "field").select("field", F.coalesce("label", "field").alias("label"), "group", text_.alias("text"), display.condition_of(F.col("evidence")).alias("condition"), "status", display.status_label(F.col("status")).alias("status_label"), previous.alias("previous_value"), (F.col("revision") != F.col("latest")).alias("from_older_revision"), "page", "evidence", "document")


def headline(t: Tables, product: str) -> DataFrame:
    """(label, field, text): up to four headline numbers of a model; none if it has only one."""
    wanted = [ShownColumn(f"k{i}", keys, True) for i, keys in enumerate(KPI_FIELDS.values())]
    one = dict(t, specs=t["specs"].where(F.col("product") == product))
    v = values_by_model(one, wanted)
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(label).alias("label"), F.col(f"c_k{i}.field").alias("field"), F.col(f"c_k{i}.text").alias("text")) for i, label in enumerate(KPI_FIELDS)]))
    got = v.select(rows.alias("r")).select("r.*").where("field IS NOT NULL")
    return got.withColumn("n", F.count("*").over(Window.partitionBy())).where("n >= 2").orderBy("ord").select("label", "field", "text")  # four rows at most


def relatives(t: Tables, product: str) -> DataFrame:
    """(id, model): members of the same family, and the family itself where it is no container; the model left out."""
    m = models_view(t).select("id", "model", "family", "is_container")
    own = m.where(F.col("id") == product).select(F.coalesce("family", "id").alias("_f"))
    both = m.join(own, F.col("family") == F.col("_f")).unionByName(m.where("NOT is_container").join(own, F.col("id") == F.col("_f")))
    return both.where(F.col("id") != product).select("id", "model").distinct()


def compare(t: Tables, products: list[str], differing: bool = False) -> DataFrame:
    """(field, label, group, a text for each of at most four products, differs), in field order."""
    ids = list(dict.fromkeys(products))
    s = cat.with_field(t["specs"].where(F.col("product").isin(*ids)), t["fields"])
    cell = F.struct(display.format_value(F.col("value"), F.col("unit")).alias("text"), F.coalesce(F.col("numeric").cast("string"), F.col("value")).alias("same"))
    wide = rel.pivot_compare(s, "field", "product", cell, ids)
    table = wide.select("field", *[F.col(f"`{p}`.text").alias(p) for p in ids], rel.differs(*[F.col(f"`{p}`.same") for p in ids]).alias("differs"))
    fields = cat.field_order(t["fields"]).select(F.col("key").alias("field"), "label", "group", "field_ord")
    out = table.join(fields, "field", "left")
    if differing:
        out = out.where("differs")
    return out.orderBy(F.col("field_ord").asc_nulls_last(), "field").select("field", F.coalesce("label", "field").alias("label"), "group", *[F.col(f"`{p}`") for p in ids], "differs")


def compare_candidates(t: Tables, chosen: list[str]) -> DataFrame:
    """(id, model, supplier): products that have values and aren't chosen yet."""
    p = cat.all_products(t["suppliers"], t["models"]).where(~F.col("id").isin(*chosen) if chosen else F.lit(True))
    return p.join(t["specs"].select(F.col("product").alias("id")), "id", "left_semi").select("id", "model", "supplier")


def candidate_groups(t: Tables, chosen: list[str]) -> DataFrame:
    """(supplier, name, models): what may still be compared, by supplier; models are (model, id) by their names."""
    names = t["suppliers"].select(F.col("id").alias("supplier"), "name")
    each = compare_candidates(t, chosen).join(names, "supplier")
    listed = F.sort_array(F.collect_list(F.struct(text.natural_key(F.coalesce("model", F.lit(""))).alias("k"), "model", "id")))
    return each.groupBy("supplier", "name").agg(F.transform(listed, lambda x: F.struct(x["model"], x["id"])).alias("models")).orderBy("name")


def older_revisions(t: Tables, document: str) -> DataFrame:
    """(rev_no, sha256, file, captured_at) of a document's revisions but its current one, newest first."""
    own = cat.revisions(t["documents"].where(F.col("id") == document))
    return own.where("NOT is_current").orderBy(F.desc("rev_no")).select("rev_no", "sha256", "file", "captured_at")


def revision_count(t: Tables) -> DataFrame:
    """(n): revisions of all documents."""
    return t["documents"].agg(F.coalesce(F.sum(F.size(F.coalesce("revisions", F.array()))), F.lit(0)).alias("n"))


def revision_of(t: Tables, sha256: str) -> DataFrame:
    """(document, rev_no, is_current, title, file) of the revision with a digest."""
    docs = t["documents"].select(F.col("id").alias("document"), "title")
    return cat.revisions(t["documents"]).where(F.col("sha256") == sha256).join(docs, "document").select("document", "rev_no", "is_current", "title", "file")


def library(t: Tables, q: str = "") -> DataFrame:
    """Documents whose title or product holds the text, with their current revision."""
    products = cat.all_products(t["suppliers"], t["models"]).select(F.col("id").alias("product"), "model")
    d = t["documents"].join(products, "product", "left").join(cat.current_revision(t["documents"]).select(F.col("document").alias("id"), "sha256", "bytes", "pages", "captured_at"), "id", "left")
    hay = F.lower(F.concat_ws(" ", "title", "model"))
    return d.where(F.contains(hay, F.lit(q.strip().lower()))).select("id", "supplier", "product", "title", "url", F.size("revisions").alias("n_revisions"), "sha256", display.file_size(F.col("bytes")).alias("size"), "pages", "captured_at")


def waiting_suppliers(t: Tables) -> DataFrame:
    return t["suppliers"].join(t["documents"].select(F.col("supplier").alias("id")), "id", "left_anti").select("id", "name")


#: Events of a day come in this order of their kinds.
EVENT_ORDER = ("needs-check", "value-changed", "datasheet-revised", "new-datasheet", "new-model", "values-extracted", "import")


def updates(t: Tables) -> DataFrame:
    """Events of the change log, newest day first: single values for needs-check and value-changed, counts by supplier for the other kinds."""
    docs = t["documents"].select(F.col("id").alias("document"), F.col("supplier").alias("ds"))
    prods = cat.all_products(t["suppliers"], t["models"]).select(F.col("id").alias("product"), F.col("supplier").alias("ps"))
    c = t["changes"].join(docs, "document", "left").join(prods, "product", "left")
    c = c.withColumns({"supplier": F.coalesce("ds", "ps", F.lit("")), "day": F.to_date(F.substring("at", 1, 10))})
    single = c.where(F.col("type").isin("needs-check", "value-changed", "import")).select("day", "at", "type", "supplier", "product", "field", "previous_value", "value", F.lit(1).cast("long").alias("n"), F.lit(None).cast("long").alias("total"))
    none = lambda x: F.lit(None).cast("string").alias(x)
    grouped = c.where(F.col("type").isin("datasheet-revised", "new-datasheet", "new-model", "values-extracted")).groupBy("day", "type", "supplier").agg(F.max("at").alias("at"), F.count("*").alias("n"), F.sum("count").alias("total"))
    grouped = grouped.select("day", "at", "type", "supplier", none("product"), none("field"), none("previous_value"), none("value"), "n", "total")
    kinds = F.array(*map(F.lit, EVENT_ORDER))
    return single.unionByName(grouped).orderBy(F.desc("day"), F.array_position(kinds, F.col("type")), F.desc("at"), "supplier", "product", "field")


def updates_by_day(t: Tables) -> DataFrame:
    """(day, events): the same grouped by day, newest first; a day's events are in their order."""
    columns = [c for c in updates(t).columns if c != "day"]
    kinds = F.array(*map(F.lit, EVENT_ORDER))
    each = updates(t).withColumn("_o", F.struct(F.array_position(kinds, F.col("type")).alias("a"), (-F.unix_timestamp(F.to_timestamp("at"))).alias("b"), "supplier", "product", "field"))
    listed = F.sort_array(F.collect_list(F.struct("_o", F.struct(*columns).alias("e"))))
    return each.groupBy("day").agg(F.transform(listed, lambda x: x["e"]).alias("events")).orderBy(F.desc("day"))


def example(specs: DataFrame) -> DataFrame:
    """One value with a usable highlight: rated power that was reviewed, else any reviewed one, else rated power, else any."""
    usable = specs.where((F.col("highlight.row").isNotNull()) & (F.col("highlight.revision") == F.col("revision")))
    reviewed, power = F.col("status") != "extracted", F.col("field") == "rated_kva"
    tier = F.when(power & reviewed, 0).when(reviewed, 1).when(power, 2).otherwise(3)
    return usable.orderBy(tier, "id").limit(1)


def source_status(t: Tables, now: Column) -> DataFrame:
    """(name, url, files, ok, problem, last_run, stale): sources of the last run."""
    s = t["status"].select("last_run_finished", "interval_hours", F.explode("sources").alias("s"))
    stale = display.is_stale(F.to_timestamp("last_run_finished"), F.col("interval_hours"), now)
    return s.select("s.name", "s.url", "s.files", "s.ok", F.when(F.col("s.error").isNotNull(), display.error_kind(F.col("s.error"))).alias("problem"), F.col("last_run_finished").alias("last_run"), stale.alias("stale"))


def selected_value(t: Tables, product: str, wanted: str = "") -> DataFrame:
    """The value that a model's page opens with: the wanted field, else the first headline one, else the first in field order."""
    heads = [k for keys in KPI_FIELDS.values() for k in keys]
    fields = cat.field_order(t["fields"]).select(F.col("key").alias("field"), "field_ord")
    s = t["specs"].where(F.col("product") == product).join(fields, "field", "left")
    place = F.array_position(F.array(*map(F.lit, heads)), F.col("field"))
    tier = F.when(F.col("field") == wanted, 0).when(place > 0, place).otherwise(len(heads) + 1)
    return s.orderBy(tier, F.col("field_ord").asc_nulls_last(), "field").limit(1)


def only_existing(t: Tables, chosen: list[str]) -> list[str]:
    """Chosen ids that still exist; at most four are looked up."""
    ids = list(dict.fromkeys(chosen))[:MAX_COMPARED]
    found = {r.id for r in cat.all_products(t["suppliers"], t["models"]).where(F.col("id").isin(*ids)).select("id").collect()}
    return [i for i in ids if i in found]


def toggled(chosen: list[str], product: str) -> list[str]:
    """The chosen ids with the product put in or taken out; a fifth isn't put in."""
    if product in chosen:
        return [x for x in chosen if x != product]
    return [*chosen, product] if len(chosen) < MAX_COMPARED else list(chosen)


def with_order(fields: DataFrame) -> DataFrame:
    """fields with ord, their place in the file that defines them."""
    return fields.withColumn("ord", F.monotonically_increasing_id()) if "ord" not in fields.columns else fields


def sorted_by(spec: QuerySpec, column: str, known: dict[str, ShownColumn]) -> QuerySpec:
    """The query sorted by a column: largest numbers or first texts at first, the other way round when asked again."""
    first = "desc" if known[column].numeric else "asc"
    now = (spec.direction or first) if spec.sort == column else ""
    return replace(spec, sort=column, direction={"desc": "asc", "asc": "desc"}.get(now, first) if now else first)
